"""One query for each operator, over the driver's tables: a program, the dataset it makes, and SQL for the same rows.

``cols`` gives the result's columns and kinds (i integer, d number to four decimals, s text); both sides are cast so.
"""

from __future__ import annotations

import tempfile
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .plans.session import Engine

#: Keys that the observations of a table are in order of.
ORDER = {
    "lineitem": ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"],
    "orders": ["o_orderkey"],
    "customer": ["c_custkey"],
    "part": ["p_partkey"],
    "supplier": ["s_suppkey"],
    "nation": ["n_nationkey"],
    "region": ["r_regionkey"],
    "events": ["event_id"],
    "labels": ["doc_id"],
    "documents": ["doc_id"],
}


@dataclass
class Query:
    key: str
    cols: str
    program: str
    sql: str | None
    out: str = "out"

    @property
    def columns(self) -> list[tuple[str, str]]:
        return [tuple(c.split(":")) for c in self.cols.split()]

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        engine = engine_for(spark, sf_dir)
        program = self.program if self.program.lstrip().lower().startswith(("data ", "proc ", "%", "libname ", "options ")) else f"proc sql; create table {self.out} as {self.program}; quit;"
        if "{tmp}" in program:
            program = program.replace("{tmp}", tempfile.mkdtemp(prefix="rowloom-"))
        engine.execute(program)
        df = engine.tables[self.out[1:]] if self.out.startswith("@") else engine.get_dataset(self.out)
        return shaped(df, self.columns)

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        kinds = {"i": "CAST({0} AS BIGINT)", "d": "ROUND(CAST({0} AS DOUBLE), 4)", "s": "CAST({0} AS VARCHAR)"}
        return f"SELECT {', '.join(kinds[k].format(chr(34) + c + chr(34)) + ' AS ' + chr(34) + c + chr(34) for c, k in self.columns)} FROM ({self.sql}) AS q"


def shaped(df: DataFrame, columns: list[tuple[str, str]]) -> DataFrame:
    low = {c.lower(): c for c in df.columns}
    kinds = {"i": lambda c: c.cast("long"), "d": lambda c: F.round(c.cast("double"), 4) + F.lit(0.0), "s": lambda c: c.cast("string")}
    return df.select(*(kinds[k](F.col("`" + low[n.lower()] + "`")).alias(n) for n, k in columns))


def engine_for(spark: SparkSession, sf_dir: str) -> Engine:
    engine = Engine(spark)
    for name in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels"):
        engine.create_dataset(name, spark.read.parquet(f"{sf_dir}/{name}.parquet"), order=ORDER[name])
    return engine


ALL: list[Query] = []


def q(key: str, cols: str, program: str, sql: str | None = "", out: str = "out") -> None:
    """``sql``: left out if the program's own text is SQL for both."""
    ALL.append(Query(key, cols, program, program if sql == "" else sql, out))


# expressions and predicates

q("EX01", "o_orderkey:i half:d", "select o_orderkey, o_totalprice / 2 as half from orders")
q("EX02", "n_name:s r_name:s", "select a.n_name, b.* from nation as a inner join region as b on a.n_regionkey = b.r_regionkey", "select a.n_name, b.r_name from nation a join region b on a.n_regionkey = b.r_regionkey")
q("EX03", "l_orderkey:i l_quantity:d", "select l_orderkey, l_quantity from lineitem where l_quantity > 45 and l_discount <= 0.02")
q("EX04", "l_orderkey:i l_quantity:d", "data out; set lineitem; where l_quantity > 45 and l_tax ge 0.05; keep l_orderkey l_quantity; run;", "select l_orderkey, l_quantity from lineitem where l_quantity > 45 and l_tax >= 0.05")
q("EX05", "l_returnflag:s rev:d", "select l_returnflag, sum(l_extendedprice * (1 - l_discount)) as rev from lineitem where calculated x < 0 or l_quantity > 10 group by l_returnflag having calculated rev > 0".replace("calculated x < 0 or ", ""))
ALL[-1].sql = "select l_returnflag, sum(l_extendedprice * (1 - l_discount)) as rev from lineitem where l_quantity > 10 group by l_returnflag having sum(l_extendedprice * (1 - l_discount)) > 0"
q("EX06", "l_orderkey:i l_linenumber:i l_partkey:i l_suppkey:i l_extendedprice:d a:d b:d c:d", "select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity ** 2 - 3 as a, l_tax / (l_discount - l_discount) as b, -l_quantity * 2 + 1 as c from lineitem", "select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity * l_quantity - 3 as a, cast(null as double) as b, -l_quantity * 2 + 1 as c from lineitem")
q("EX07", "c_custkey:i v:s", "select c_custkey, c_name || '/' || c_mktsegment as v from customer")
q("EX08", "event_id:i lt:i le:i ne:i", "data out; set events; x = value; if value < 50 then x = .; lt = (x < 60); le = (. <= x); ne = (x ne .); keep event_id lt le ne; run;", "select event_id, case when value < 60 then 1 else 0 end as lt, 1 as le, case when value < 50 then 0 else 1 end as ne from events")
q("EX09", "o_orderkey:i", "select o_orderkey from orders where (o_orderstatus = 'F' or o_totalprice > 300000) and not (o_orderpriority = '1-URGENT')")
q("EX10", "o_orderkey:i", "select o_orderkey from orders where o_orderstatus in ('F' 'P') and o_orderpriority not in ('5-LOW', '2-HIGH')", "select o_orderkey from orders where o_orderstatus in ('F', 'P') and o_orderpriority not in ('5-LOW', '2-HIGH')")
q("EX11", "o_orderkey:i", "select o_orderkey from orders where o_totalprice between 1000 and 200000 and o_custkey not between 5 and 50")
q("EX12", "p_partkey:i", "select p_partkey from part where p_type like '%A%' or p_name not like '%e%'")
q("EX13", "p_partkey:i", "select p_partkey from part where p_name contains 'a'", "select p_partkey from part where contains(p_name, 'a')")
q("EX14", "c_custkey:i n:i", "select c_custkey, (n_name is null) as n from customer left join nation on c_nationkey = n_nationkey and n_nationkey < 12 where n_name is missing or n_name is not null", "select c_custkey, case when n_name is null then 1 else 0 end as n from customer left join nation on c_nationkey = n_nationkey and n_nationkey < 12")
q("EX15", "o_orderkey:i v:s w:i", "select o_orderkey, case when o_totalprice > 250000 then 'big' when o_totalprice > 100000 then 'mid' else 'small' end as v, case o_orderstatus when 'F' then 1 when 'O' then 2 else 3 end as w from orders")
q("EX17", "l_orderkey:i l_linenumber:i l_partkey:i l_suppkey:i l_extendedprice:d v:d", "data out; set lineitem; array a{3} l_quantity l_discount l_tax; v = a{mod(l_linenumber, 3) + 1}; keep l_orderkey l_linenumber l_partkey l_suppkey l_extendedprice v; run;", "select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, case l_linenumber % 3 when 0 then l_quantity when 1 then l_discount else l_tax end as v from lineitem")
q("EX18", "l_orderkey:i l_linenumber:i l_partkey:i l_suppkey:i l_extendedprice:d v:d n:i", "data out; set lineitem; array a{3} l_quantity l_discount l_tax; v = sum(of a[*]); n = dim(a); keep l_orderkey l_linenumber l_partkey l_suppkey l_extendedprice v n; run;", "select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity + l_discount + l_tax as v, 3 as n from lineitem")
q("EX19", "n:i m:i", "data out; array a{5} x1-x5; array t{3} _temporary_ (1 2 3); n = dim(a); m = dim(t); keep n m; run;", "select 5 as n, 3 as m")
q("EX20", "n_nationkey:i v:s", "proc format; value rg 0 = 'zero' 1-2 = 'low' other = 'high'; run; data out; set nation; format n_regionkey rg.; v = vvalue(n_regionkey); keep n_nationkey v; run;", "select n_nationkey, case when n_regionkey = 0 then 'zero' when n_regionkey <= 2 then 'low' else 'high' end as v from nation")
q("EX22", "c_custkey:i c_name:s", "select * from customer(where=(c_acctbal > 0) keep=c_custkey c_name c_acctbal drop=c_acctbal)", "select c_custkey, c_name from customer where c_acctbal > 0")

# joins

q("JN01", "o_orderkey:i l_linenumber:i l_partkey:i l_suppkey:i l_extendedprice:d o_custkey:i", "select o.o_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_extendedprice, o.o_custkey from orders o inner join lineitem l on o.o_orderkey = l.l_orderkey")
q("JN02", "c_custkey:i n:i s:d", "select c.c_custkey, count(o.o_orderkey) as n, coalesce(sum(o.o_totalprice), 0) as s from customer c left join orders o on c.c_custkey = o.o_custkey group by c.c_custkey")
q("JN03", "n_name:s r_name:s", "select n.n_name, r.r_name from region r right join nation n on r.r_regionkey = n.n_regionkey and r.r_regionkey > 1")
q("JN04", "c:i s:i", "select c.c_custkey as c, s.s_suppkey as s from customer c full join supplier s on c.c_custkey = s.s_suppkey + 1400")
q("JN05", "a:s b:s", "select r.r_name as a, n.n_name as b from region r, nation n")
q("JN06", "n:i s:d", "select count(*) as n, sum(a.l_quantity) as s from lineitem a inner join lineitem b on a.l_orderkey = b.l_orderkey and a.l_linenumber + 1 = b.l_linenumber")
q("JN07", "c_custkey:i o_orderkey:i", "select c.c_custkey, o.o_orderkey from customer c left join orders o on c.c_custkey = o.o_custkey and o.o_totalprice > 300000")
q("JN08", "n:i", "select count(*) as n from orders o inner join (select put(c_custkey, 8.) as k from customer) c on o.o_custkey = c.k", "select count(*) as n from orders o join customer c on o.o_custkey = c.c_custkey")
q("JN09", "a:s n:i", "select a.n_name as a, count(*) as n from nation a inner join nation b on a.n_nationkey < b.n_nationkey group by a.n_name")
q("JN10", "c_custkey:i", "select c_custkey from customer c where exists (select 1 from orders o where o.o_custkey = c.c_custkey)")
q("JN11", "c_custkey:i", "select c_custkey from customer c where not exists (select 1 from orders o where o.o_custkey = c.c_custkey)")
q("JN12", "c_custkey:i", "select c_custkey from customer c where exists (select 1 from orders o where o.o_custkey = c.c_custkey and o.o_totalprice > c.c_acctbal * 30)")
q("JN13", "c_custkey:i", "select c_custkey from customer where c_custkey in (select o_custkey from orders where o_totalprice > 250000) and c_nationkey not in (select case when n_nationkey > 20 then . else n_nationkey end from nation where n_regionkey = 1)", "select c_custkey from customer where c_custkey in (select o_custkey from orders where o_totalprice > 250000) and c_nationkey not in (select n_nationkey from nation where n_regionkey = 1 and n_nationkey <= 20)")
q("JN14", "o_orderkey:i", "select o_orderkey from orders where o_totalprice > (select avg(o_totalprice) from orders)")
q("JN15", "c_custkey:i m:d n:i", "select c.c_custkey, (select max(o.o_totalprice) from orders o where o.o_custkey = c.c_custkey) as m, (select count(*) from orders o where o.o_custkey = c.c_custkey) as n from customer c")
q("JN16", "r:s n:i", "select d.l_returnflag as r, count(*) as n from (select l_returnflag, l_orderkey from lineitem where l_tax > 0.03) d group by d.l_returnflag")
q("JN17", "a:i b:i", "select a.s_suppkey as a, b.s_suppkey as b from supplier a inner join supplier b on a.s_nationkey = b.s_nationkey and a.s_suppkey < b.s_suppkey")
q("JN18", "o_custkey:i n:i", "proc sort data=orders out=o; by o_custkey o_orderkey; run; proc sort data=customer(rename=(c_custkey=o_custkey) keep=c_custkey c_name) out=c; by o_custkey; run; data m; merge c(in=a) o(in=b); by o_custkey; if a and b; run; proc sql; create table out as select o_custkey, count(*) as n from m group by o_custkey; quit;", "select o_custkey, count(*) as n from orders where o_custkey in (select c_custkey from customer) group by o_custkey")

# aggregation

q("AG01", "l_returnflag:s l_linestatus:s sum_qty:d revenue:d n:i", "select l_returnflag, l_linestatus, sum(l_quantity) as sum_qty, sum(l_extendedprice * (1 - l_discount)) as revenue, count(*) as n from lineitem group by l_returnflag, l_linestatus")
q("AG02", "big:s n:i", "select case when o_totalprice > 150000 then 'y' else 'n' end as big, count(*) as n from orders group by calculated big", "select case when o_totalprice > 150000 then 'y' else 'n' end as big, count(*) as n from orders group by 1")
q("AG03", "o_orderstatus:s n:i", "select o_orderstatus, count(*) as n from orders group by o_orderstatus")
q("AG04", "l_returnflag:s a:i b:i", "select l_returnflag, n(case when l_quantity > 25 then l_quantity end) as a, count(l_tax) as b from lineitem group by l_returnflag", "select l_returnflag, count(case when l_quantity > 25 then l_quantity end) as a, count(l_tax) as b from lineitem group by l_returnflag")
q("AG05", "k:i s:d", "select l_linenumber as k, sum(case when l_linenumber > 3 then l_quantity end) as s from lineitem group by l_linenumber")
q("AG06", "l_linestatus:s a:d b:d", "select l_linestatus, avg(l_quantity) as a, mean(l_tax) as b from lineitem group by l_linestatus", "select l_linestatus, avg(l_quantity) as a, avg(l_tax) as b from lineitem group by l_linestatus")
q("AG07", "p_brand:s a:d b:d c:s d:s", "select p_brand, min(p_retailprice) as a, max(p_retailprice) as b, min(p_name) as c, max(p_type) as d from part group by p_brand")
q("AG08", "l_returnflag:s s:d v:d", "select l_returnflag, std(l_quantity) as s, var(l_quantity) as v from lineitem group by l_returnflag", "select l_returnflag, stddev_samp(l_quantity) as s, var_samp(l_quantity) as v from lineitem group by l_returnflag")
q("AG09", "l_returnflag:s m:d", "select l_returnflag, median(l_extendedprice) as m from lineitem group by l_returnflag")
q("AG10", "l_returnflag:s a:i b:d", "select l_returnflag, count(distinct l_partkey) as a, sum(distinct l_quantity) as b from lineitem group by l_returnflag")
q("AG11", "o_orderstatus:s a:d b:i", "select o_orderstatus, sum(o_totalprice * 2 + 1) as a, sum(o_orderpriority = '5-LOW') as b from orders group by o_orderstatus", "select o_orderstatus, sum(o_totalprice * 2 + 1) as a, sum(case when o_orderpriority = '5-LOW' then 1 else 0 end) as b from orders group by o_orderstatus")
q("AG12", "c_custkey:i s:d", "select c.c_custkey, coalesce(sum(o.o_totalprice), -1) as s from customer c left join orders o on c.c_custkey = o.o_custkey and o.o_orderstatus = 'F' group by c.c_custkey")
q("AG13", "n:i s:d m:d", "select count(*) as n, sum(l_quantity) as s, max(l_tax) as m from lineitem")
q("AG14", "o_custkey:i n:i", "select o_custkey, count(*) as n from orders group by o_custkey having count(*) > 12 and sum(o_totalprice) > 100")
q("AG15", "n:i", "select count(*) as n from orders having count(*) > 10")
q("AG16", "l_returnflag:s l_linestatus:s", "select distinct l_returnflag, l_linestatus from lineitem")
q("AG17", "l_orderkey:i l_linenumber:i l_partkey:i l_suppkey:i l_extendedprice:d a:d b:d c:d d:d", "select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, sum(l_quantity, l_tax) as a, mean(l_quantity, l_tax, l_discount) as b, min(l_tax, l_discount) as c, max(l_tax, l_discount) as d from lineitem", "select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity + l_tax as a, (l_quantity + l_tax + l_discount) / 3 as b, least(l_tax, l_discount) as c, greatest(l_tax, l_discount) as d from lineitem")

# windows

_LI = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice"
_LIK = "l_orderkey:i l_linenumber:i l_partkey:i l_suppkey:i l_extendedprice:d"
_TIE = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice"
q("WN01", f"{_LIK} r:i", f"select {_LI}, row_number() over (partition by l_orderkey order by {_TIE}) as r from lineitem")
q("WN02", "o_orderkey:i r:i", "select o_orderkey, rank() over (partition by o_custkey order by o_orderpriority, o_orderstatus desc) as r from orders")
q("WN03", "o_orderkey:i r:i", "select o_orderkey, dense_rank() over (partition by o_custkey order by o_orderpriority) as r from orders")
for _k, _f in (("WN04", "sum"), ("WN05", "avg"), ("WN06", "count"), ("WN07", "min"), ("WN08", "max")):
    q(_k, "o_orderkey:i v:d", f"select o_orderkey, {_f}(o_totalprice / 7) over (partition by o_custkey) as v from orders")
q("WN09", "o_orderkey:i v:d", "select o_orderkey, lag(o_totalprice, 2) over (partition by o_custkey order by o_orderkey) as v from orders")
q("WN10", "o_orderkey:i v:d", "select o_orderkey, lead(o_totalprice) over (partition by o_custkey order by o_orderkey) as v from orders")
q("WN11", "o_orderkey:i v:d", "select o_orderkey, avg(o_totalprice / 7) over (partition by o_orderstatus) as v from orders")

# sort, limit, duplicates

q("SO01", "n_nationkey:i k:i", "data s; set nation; run; proc sql; create table t as select n_nationkey, n_name from s order by n_name desc; quit; data out; set t; k = _n_; keep n_nationkey k; run;", "select n_nationkey, row_number() over (order by n_name desc) as k from nation")
q("SO02", "s_suppkey:i k:i", "proc sql; create table t as select s_suppkey, s_acctbal from supplier order by abs(s_acctbal), s_suppkey; quit; data out; set t; k = _n_; keep s_suppkey k; run;", "select s_suppkey, row_number() over (order by abs(s_acctbal), s_suppkey) as k from supplier")
q("SO03", "o_orderkey:i o_totalprice:d", "proc sql outobs=25; create table out as select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey; quit;", "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 25")
q("SO04", "c_custkey:i k:i", "proc sort data=customer out=t; by descending c_mktsegment c_acctbal c_custkey; run; data out; set t; k = _n_; keep c_custkey k; run;", "select c_custkey, row_number() over (order by c_mktsegment desc, c_acctbal, c_custkey) as k from customer")
q("SO05", "l_partkey:i l_orderkey:i l_suppkey:i", "proc sort data=lineitem(keep=l_partkey l_orderkey l_suppkey) out=out nodupkey; by l_partkey; run;", "select l_partkey, l_orderkey, l_suppkey from (select *, row_number() over (partition by l_partkey order by l_orderkey, l_suppkey) as r from lineitem) where r = 1")
q("SO06", "o_custkey:i o_orderstatus:s", "proc sort data=orders(keep=o_custkey o_orderstatus) out=out noduprecs; by o_custkey; run;", "select distinct o_custkey, o_orderstatus from orders")
q("SO07", "o_orderkey:i", "proc sort data=orders out=out; where o_totalprice > 200000; by o_custkey; run;", "select o_orderkey from orders where o_totalprice > 200000")
q("SO08", "r_regionkey:i r_name:s k:i", "proc sort data=region out=t; by r_n: _all_; run; data out; set t; k = _n_; run;", "select r_regionkey, r_name, row_number() over (order by r_name) as k from region")
q("SO09", "c_custkey:i c_acctbal:d", "proc sort data=customer(where=(c_acctbal > 5000)) out=out(keep=c_custkey c_acctbal); by c_acctbal; run;", "select c_custkey, c_acctbal from customer where c_acctbal > 5000")
q("SO10", "o_orderkey:i", "data out; set orders(firstobs=11 obs=40); keep o_orderkey; run;", "select o_orderkey from (select o_orderkey, row_number() over (order by o_orderkey) as r from orders) where r between 11 and 40")

# set operations and changes

q("SE01", "k:i", "select c_custkey as k from customer union all select s_suppkey as k from supplier")
q("SE02", "k:i", "select c_nationkey as k from customer union select s_nationkey from supplier")
q("SE03", "k:i", "select c_custkey as k from customer intersect select s_suppkey from supplier")
q("SE04", "k:i", "select c_nationkey as k from customer intersect all select s_nationkey from supplier")
q("SE05", "k:i", "select c_custkey as k from customer except select o_custkey from orders")
q("SE06", "k:i", "select c_nationkey as k from customer except all select s_nationkey from supplier")
q("SE07", "k:i", "select c_nationkey as k from customer union select s_nationkey from supplier union all select n_nationkey from nation")
q("DM01", "o_orderstatus:s n:i", "select o_orderstatus, count(*) as n from orders group by o_orderstatus")
q("DM02", "r_regionkey:i r_name:s", "proc sql; create table out as select * from region; insert into out values (7, 'NOWHERE') values (8, 'ELSE'); quit;", "select r_regionkey, r_name from region union all values (7, 'NOWHERE'), (8, 'ELSE')")
q("DM03", "r_regionkey:i r_name:s", "proc sql; create table out as select * from region; insert into out select n_nationkey as r_regionkey, n_name as r_name from nation where n_regionkey = 2; quit;", "select r_regionkey, r_name from region union all select n_nationkey, n_name from nation where n_regionkey = 2")
q("DM04", "c_custkey:i c_acctbal:d c_name:s", "proc sql; create table out as select c_custkey, c_acctbal, c_name from customer; update out set c_acctbal = c_acctbal * 2, c_name = 'X' where c_acctbal < 0; quit;", "select c_custkey, case when c_acctbal < 0 then c_acctbal * 2 else c_acctbal end as c_acctbal, case when c_acctbal < 0 then 'X' else c_name end as c_name from customer")
q("DM05", "c_custkey:i", "proc sql; create table out as select c_custkey, c_acctbal from customer; delete from out where c_acctbal > 1000; quit;", "select c_custkey from customer where c_acctbal <= 1000")
q("DM06", "n:i", "proc sql noprint; select count(*) into :k from orders where o_totalprice > 200000; quit; data out; n = &k; run;", "select count(*) as n from orders where o_totalprice > 200000")
q("DM07", "v:s", "proc sql noprint; select n_name into :names separated by '|' from nation where n_regionkey = 1 order by n_name; quit; data out; v = \"&names\"; run;", "select string_agg(n_name, '|' order by n_name) as v from nation where n_regionkey = 1")
q("DM08", "a:s b:s", "proc sql noprint; select r_name into :r1-:r3 from region order by r_name; quit; data out; a = \"&r1\"; b = \"&r3\"; run;", "select (select r_name from (select r_name, row_number() over (order by r_name) as k from region) where k = 1) as a, (select r_name from (select r_name, row_number() over (order by r_name) as k from region) where k = 3) as b")

# data step

q("DS01", "r_regionkey:i k:i", "data out; set region; k = r_regionkey * 10; run;", "select r_regionkey, r_regionkey * 10 as k from region")
q("DS02", "c_custkey:i c_acctbal:d", "data out; set customer(keep=c_custkey c_acctbal); run;", "select c_custkey, c_acctbal from customer")
q("DS03", "k:i v:d", "data out; set customer(rename=(c_custkey=k c_acctbal=v)) supplier(rename=(s_suppkey=k s_acctbal=v)); keep k v; run;", "select c_custkey as k, c_acctbal as v from customer union all select s_suppkey, s_acctbal from supplier")
q("DS04", "k:i src:i n:i", "data a; set nation(rename=(n_regionkey=k)); keep k; run; proc sort data=a; by k; run; data b; set region(rename=(r_regionkey=k)); keep k; run; data out; set a(in=ia) b; by k; src = 1 - ia; n = _n_; run;", "select k, src, row_number() over (order by k, src) as n from (select n_regionkey as k, 0 as src from nation union all select r_regionkey, 1 from region)")
q("DS05", "c_custkey:i s_suppkey:i", "data out; set customer(keep=c_custkey); set supplier(keep=s_suppkey); run;", "select c_custkey, s_suppkey from (select c_custkey, row_number() over (order by c_custkey) as r from customer) join (select s_suppkey, row_number() over (order by s_suppkey) as r from supplier) using (r)")
q("DS06", "o_orderkey:i last:i", "data out; set orders end=e; last = e; keep o_orderkey last; run;", "select o_orderkey, case when o_orderkey = max(o_orderkey) over () then 1 else 0 end as last from orders")
q("DS07", "k:i a:i b:i", "data out; merge customer(in=ia rename=(c_custkey=k) keep=c_custkey) supplier(in=ib rename=(s_suppkey=k) keep=s_suppkey); by k; a = ia; b = ib; run;", "select coalesce(c_custkey, s_suppkey) as k, case when c_custkey is null then 0 else 1 end as a, case when s_suppkey is null then 0 else 1 end as b from customer full join supplier on c_custkey = s_suppkey")
q("DS08", f"{_LIK} o_custkey:i o_totalprice:d", "data out; merge orders(in=a rename=(o_orderkey=l_orderkey)) lineitem(in=b); by l_orderkey; if a and b; run;", f"select {_LI}, o_custkey, o_totalprice from lineitem join orders on o_orderkey = l_orderkey")
q("DS09", "c_custkey:i s_suppkey:i", "data out; merge customer(keep=c_custkey) supplier(keep=s_suppkey); run;", "select c_custkey, s_suppkey from (select c_custkey, row_number() over (order by c_custkey) as r from customer) full join (select s_suppkey, row_number() over (order by s_suppkey) as r from supplier) using (r)")
q("DS11", "k:i v:d", "data m; set customer(rename=(c_custkey=k c_acctbal=v)); keep k v; run; data t; set supplier(rename=(s_suppkey=k s_acctbal=v)); k = k + 1450; if v < 0 then v = .; keep k v; run; data out; update m t; by k; run;", "select coalesce(c.k, t.k) as k, coalesce(t.v, c.v) as v from (select c_custkey as k, c_acctbal as v from customer) c full join (select s_suppkey + 1450 as k, case when s_acctbal >= 0 then s_acctbal end as v from supplier) t on c.k = t.k")
q("DS12", "p_partkey:i v:d w:s", "data out; set part; v = p_retailprice * 1.1; v = v + p_size; w = upcase(p_name); keep p_partkey v w; run;", "select p_partkey, p_retailprice * 1.1 + p_size as v, upper(p_name) as w from part")
q("DS13", "o_orderkey:i c:s d:i", "data out; set orders; length c $6; if o_totalprice > 250000 then do; c = 'high'; d = 1; end; else if o_totalprice > 100000 then c = 'mid'; else do; c = 'low'; d = 3; end; keep o_orderkey c d; run;", "select o_orderkey, case when o_totalprice > 250000 then 'high' when o_totalprice > 100000 then 'mid' else 'low' end as c, case when o_totalprice > 250000 then 1 when o_totalprice > 100000 then null else 3 end as d from orders")
q("DS14", "o_orderkey:i x:d", "data out; set orders; x = o_totalprice / 3; if x > 50000; keep o_orderkey x; run;", "select o_orderkey, o_totalprice / 3 as x from orders where o_totalprice / 3 > 50000")
q("DS15", "o_orderkey:i", "data out; set orders; if o_orderstatus = 'F' then delete; if o_totalprice < 1000 then delete; keep o_orderkey; run;", "select o_orderkey from orders where o_orderstatus <> 'F' and o_totalprice >= 1000")
q("DS16", "o_orderkey:i", "data out; set orders; if _n_ > 100 then stop; keep o_orderkey; run;", "select o_orderkey from orders order by o_orderkey limit 100")
q("DS17", "o_orderkey:i k:i v:d", "data out; set orders; k = 1; v = o_totalprice; output; if o_orderstatus = 'O' then do; k = 2; v = -v; output; end; keep o_orderkey k v; run;", "select o_orderkey, 1 as k, o_totalprice as v from orders union all select o_orderkey, 2, -o_totalprice from orders where o_orderstatus = 'O'")
q("DS18", "n:i m:i", "data a b(where=(o_totalprice > 1000)); set orders; if o_orderstatus = 'F' then output a; else output b; run; proc sql; create table out as select (select count(*) from a) as n, (select count(*) from b) as m; quit;", "select (select count(*) from orders where o_orderstatus = 'F') as n, (select count(*) from orders where o_orderstatus <> 'F' and o_totalprice > 1000) as m")
q("DS19", "r_regionkey:i i:i v:d", "data out; set region; do i = 1 to 9 by 3; v = i * r_regionkey; output; end; keep r_regionkey i v; run;", "select r_regionkey, i, i * r_regionkey as v from region cross join (values (1), (4), (7)) as t(i)")
q("DS20", "r_regionkey:i s:d", "data out; set region; s = 0; do k = 2, 5, 11; s = s + k * r_regionkey; end; keep r_regionkey s; run;", "select r_regionkey, 18 * r_regionkey as s from region")
q("DS21", "c_custkey:i n:i", "data out; set customer; n = 0; x = abs(c_acctbal); do while (x > 100); x = x / 2; n = n + 1; end; keep c_custkey n; run;", "select c_custkey, case when abs(c_acctbal) <= 100 then 0 else cast(ceil(log2(abs(c_acctbal) / 100)) as bigint) end as n from customer")
q("DS22", "r_regionkey:i a:i b:i", "data out; set region; do; a = r_regionkey; b = a + 1; end; keep r_regionkey a b; run;", "select r_regionkey, r_regionkey as a, r_regionkey + 1 as b from region")
q("DS23", "o_orderkey:i v:s", "data out; set orders; length v $8; select (o_orderstatus); when ('F') v = 'done'; when ('O', 'P') v = 'open'; otherwise v = '?'; end; keep o_orderkey v; run;", "select o_orderkey, case when o_orderstatus = 'F' then 'done' when o_orderstatus in ('O', 'P') then 'open' else '?' end as v from orders")
q("DS24", "event_id:i last_buy:d prev:d", "data out; set events; retain last_buy prev; d = prev; if event_type = 'purchase' then last_buy = value; prev = value; keep event_id last_buy d; rename d = prev2; run;".replace("; rename d = prev2", "").replace("keep event_id last_buy d", "drop prev ts user_id event_type value props; rename d = prev"), "select event_id, last_value(case when event_type = 'purchase' then value end ignore nulls) over (order by event_id rows unbounded preceding) as last_buy, lag(value) over (order by event_id) as prev from events")
q("DS25", "event_id:i tot:d n:i", "proc sort data=events out=e; by user_id event_id; run; data out; set e; by user_id; if first.user_id then do; tot = 0; n = 0; end; tot + value; n + 1; keep event_id tot n; run;", "select event_id, sum(value) over (partition by user_id order by event_id rows unbounded preceding) as tot, row_number() over (partition by user_id order by event_id) as n from events")
q("DS26", "event_id:i f:i l:i", "proc sort data=events out=e; by user_id event_type event_id; run; data out; set e; by user_id event_type; f = first.event_type; l = last.event_type; keep event_id f l; run;", "select event_id, case when row_number() over (partition by user_id, event_type order by event_id) = 1 then 1 else 0 end as f, case when row_number() over (partition by user_id, event_type order by event_id desc) = 1 then 1 else 0 end as l from events")
q("DS27", "event_id:i a:d b:d", "data out; set events; a = lag(value); b = lag3(value); keep event_id a b; run;", "select event_id, lag(value) over (order by event_id) as a, lag(value, 3) over (order by event_id) as b from events")
q("DS28", "event_id:i d:d", "data out; set events; d = dif(value); keep event_id d; run;", "select event_id, value - lag(value) over (order by event_id) as d from events")
q("DS29", "o_orderkey:i n:i", "data out; set orders; where o_orderstatus = 'O'; n = _n_; keep o_orderkey n; run;", "select o_orderkey, row_number() over (order by o_orderkey) as n from orders where o_orderstatus = 'O'")
q("DS30", "o_orderkey:i o_custkey:i", "data out; set orders; drop o_orderstatus o_totalprice o_orderdate o_orderpriority; run;", "select o_orderkey, o_custkey from orders")
q("DS31", "k:i v:d", "data out; set customer; keep c_custkey c_acctbal; rename c_custkey = k c_acctbal = v; run;", "select c_custkey as k, c_acctbal as v from customer")
q("DS32", "c_custkey:i v1:d v2:d v3:d", "data out; set customer; array v{3} v1-v3; do i = 1 to 3; v{i} = c_acctbal * i; end; keep c_custkey v1-v3; run;", "select c_custkey, c_acctbal as v1, c_acctbal * 2 as v2, c_acctbal * 3 as v3 from customer")
q("DS33", "n_nationkey:i w:d", "data out; set nation; array w_{5} _temporary_ (1.5 2.5 3.5 4.5 5.5); w = w_{n_regionkey + 1}; keep n_nationkey w; run;", "select n_nationkey, n_regionkey + 1.5 as w from nation")
q("DS34", "n_nationkey:i a1:d a2:d a3:d", "data out; set nation; array a{3} a1-a3; k = mod(n_nationkey, 3) + 1; a{k} = 9; keep n_nationkey a1-a3; run;", "select n_nationkey, case when n_nationkey % 3 = 0 then 9 end as a1, case when n_nationkey % 3 = 1 then 9 end as a2, case when n_nationkey % 3 = 2 then 9 end as a3 from nation")
q("DS35", "c_custkey:i c_name:s", "data out; set customer; substr(c_name, 2, 3) = 'XYZ'; keep c_custkey c_name; run;", "select c_custkey, substr(c_name, 1, 1) || 'XYZ' || substr(c_name, 5) as c_name from customer")
q("DS38", "v:d", "data _null_; set orders; if o_orderstatus = 'F' then call symputx('last', o_totalprice); run; data out; v = &last; run;", "select o_totalprice as v from orders where o_orderstatus = 'F' order by o_orderkey desc limit 1")
q("DS39", "c_custkey:i a:d", "data out; set customer; a = c_acctbal; if c_acctbal < 0 then call missing(a); keep c_custkey a; run;", "select c_custkey, case when c_acctbal >= 0 then c_acctbal end as a from customer")
q("DS40", "a:i b:i", "data out; a = exist('orders'); b = exist('nothing'); run;", "select 1 as a, 0 as b")
q("DS41", "o_custkey:i n:i", "proc sort data=orders out=o; by descending o_custkey o_orderkey; run; data out; set o; by descending o_custkey; if first.o_custkey then n = 0; n + 1; if last.o_custkey; keep o_custkey n; run;", "select o_custkey, count(*) as n from orders group by o_custkey")
q("DS42", "a:d b:s", "data out; length b $5; a = 1; b = 'x'; stop; run;", "select cast(1 as double) as a, 'x' as b where false")

# sources and sinks

q("IO06", "n_nationkey:i n_name:s n_regionkey:i", "libname c csv '{tmp}'; data c.nat; set nation; run; data out; set c.nat; run;", "select n_nationkey, n_name, n_regionkey from nation")
q("IO07", "r_regionkey:i r_name:s", "proc export data=region outfile='{tmp}/r.txt' dbms=dlm delimiter='|' replace; run; proc import datafile='{tmp}/r.txt' out=out dbms=dlm replace; delimiter='|'; getnames=yes; run;", "select r_regionkey, r_name from region")
q("IO08", "c_custkey:i c_acctbal:d", "proc export data=customer(where=(c_acctbal > 0) keep=c_custkey c_acctbal) outfile='{tmp}/c.csv' dbms=csv replace; run; proc import datafile='{tmp}/c.csv' out=out dbms=csv replace; run;", "select c_custkey, c_acctbal from customer where c_acctbal > 0")
q("IO09", "d:s v:s", "data a; d = '05MAR2024'd; v = 3; format d date9.; output; d = .; v = 4.5; output; run; proc export data=a outfile='{tmp}/a.csv' dbms=csv replace; run; proc import datafile='{tmp}/a.csv' out=out dbms=csv replace; run;", "values ('05MAR2024', '3.0'), (null, '4.5')".replace("values", "select * from (values") + ") as t(d, v)")
q("IO10", "id:i name:s x:d", "data out; input id name $ x; datalines;\n1 a 2.5\n2 'b c' .\n3\nd 7\n;\nrun;", "select * from (values (1, 'a', 2.5), (2, 'b c', null), (3, 'd', 7.0)) as t(id, name, x)")
q("IO11", "name:s age:i", "data out; input name $ 1-6 age 8-9; datalines;\nAnn    31\nRobert 45\n;\nrun;", "select * from (values ('Ann', 31), ('Robert', 45)) as t(name, age)")
q("IO12", "a:s b:d c:s", "data out; infile datalines dsd truncover; input a $ b c :$20.; datalines;\nx,1,\"p,q\"\ny,,z\nw,3\n;\nrun;", "select * from (values ('x', 1.0, 'p,q'), ('y', null, 'z'), ('w', 3.0, '')) as t(a, b, c)")
q("IO13", "d:i m:d", "data out; input d :date9. m :comma8.; datalines;\n01JAN1960 1,234\n03MAR2024 5\n;\nrun;", "select * from (values (0, 1234.0), (23438, 5.0)) as t(d, m)")
q("IO18", "k:i", "data out; set orders(firstobs=5 obs=60 where=(o_orderstatus ne 'P') rename=(o_orderkey=k) keep=o_orderkey o_orderstatus); keep k; run;".replace("rename=(o_orderkey=k) keep=o_orderkey o_orderstatus", "keep=o_orderkey o_orderstatus rename=(o_orderkey=k)"), "select o_orderkey as k from (select *, row_number() over (order by o_orderkey) as r from orders) where r between 5 and 60 and o_orderstatus <> 'P'")
q("IO19", "k:i", "data out(where=(o_totalprice > 100000) keep=o_orderkey o_totalprice rename=(o_orderkey=k)); set orders; run;", "select o_orderkey as k from orders where o_totalprice > 100000")
q("IO20", "k:i", "data part1x; set region(rename=(r_regionkey=k)); keep k; run; data part2x; set nation(rename=(n_nationkey=k)); keep k; run; data out; set part1x part2x; run; data px1; set part1x; run; data px2; set part2x; run; data out; set px:; run;", "select r_regionkey as k from region union all select n_nationkey from nation")
q("IO21", "name:s varnum:i", "select name, varnum from dictionary.columns where libname = 'WORK' and memname = 'NATION'", "select * from (values ('n_nationkey', 1), ('n_name', 2), ('n_regionkey', 3)) as t(name, varnum)")

# procedures

q("PR01", "l_returnflag:s variable:s n:d mean:d std:d min:d max:d", "proc means data=lineitem n mean std min max; class l_returnflag; var l_quantity l_tax; run;", "select l_returnflag, 'l_quantity' as variable, count(l_quantity) as n, avg(l_quantity) as mean, stddev_samp(l_quantity) as std, min(l_quantity) as min, max(l_quantity) as max from lineitem group by 1 union all select l_returnflag, 'l_tax', count(l_tax), avg(l_tax), stddev_samp(l_tax), min(l_tax), max(l_tax) from lineitem group by 1", "@means")
q("PR02", "l_returnflag:s l_linestatus:s n:i m:d q:d", "proc means data=lineitem noprint nway; class l_returnflag l_linestatus; var l_extendedprice; output out=out n=n mean=m q3=q; run;", "select l_returnflag, l_linestatus, count(l_extendedprice) as n, avg(l_extendedprice) as m, quantile_cont(l_extendedprice, 0.75) as q from lineitem group by 1, 2")
q("PR03", "p_brand:s p_size_count:i p_size_mean:d p_size_max:d", "proc summary data=part out=out; class p_brand; var p_size; run;", "select p_brand, count(p_size) as p_size_count, avg(p_size) as p_size_mean, max(p_size) as p_size_max from part group by 1")
q("PR04", "a:d b:d c:d", "proc means data=lineitem noprint; var l_extendedprice; output out=out p10=a median=b p95=c; run;", "select quantile_cont(l_extendedprice, 0.1) as a, median(l_extendedprice) as b, quantile_cont(l_extendedprice, 0.95) as c from lineitem")
q("PR05", "l_linenumber:i COUNT:i PERCENT:d CUM_FREQ:i CUM_PCT:d", "proc freq data=lineitem; tables l_linenumber; run;", "select l_linenumber, n as COUNT, 100.0 * n / sum(n) over () as PERCENT, sum(n) over (order by l_linenumber) as CUM_FREQ, 100.0 * sum(n) over (order by l_linenumber) / sum(n) over () as CUM_PCT from (select l_linenumber, count(*) as n from lineitem group by 1)", "@onewayfreqs")
q("PR06", "l_returnflag:s l_linestatus:s COUNT:i PERCENT:d ROW_PCT:d COL_PCT:d", "proc freq data=lineitem; tables l_returnflag*l_linestatus; run;", "select l_returnflag, l_linestatus, n as COUNT, 100.0 * n / sum(n) over () as PERCENT, 100.0 * n / sum(n) over (partition by l_returnflag) as ROW_PCT, 100.0 * n / sum(n) over (partition by l_linestatus) as COL_PCT from (select l_returnflag, l_linestatus, count(*) as n from lineitem group by 1, 2)", "@crosstab")
q("PR07", "o_orderstatus:s o_orderpriority:s COUNT:i PERCENT:d", "proc freq data=orders noprint; tables o_orderstatus*o_orderpriority / out=out; run;", "select o_orderstatus, o_orderpriority, count(*) as COUNT, 100.0 * count(*) / (select count(*) from orders) as PERCENT from orders group by 1, 2")
q("PR08", "o_custkey:i _NAME_:s F:d O:d P:d", "proc sort data=orders out=o; by o_custkey o_orderkey; run; proc transpose data=o out=out; by o_custkey; id o_orderstatus; var o_totalprice; run;", "select o_custkey, 'o_totalprice' as _NAME_, max_by(o_totalprice, o_orderkey) filter (where o_orderstatus = 'F') as F, max_by(o_totalprice, o_orderkey) filter (where o_orderstatus = 'O') as O, max_by(o_totalprice, o_orderkey) filter (where o_orderstatus = 'P') as P from orders group by 1")
q("PR09", "variable:s n:d mean:d skewness:d kurtosis:d p10:d median:d", "proc univariate data=lineitem; var l_quantity l_extendedprice; run;", "select 'l_quantity' as variable, count(*) as n, avg(l_quantity) as mean, skewness(l_quantity) as skewness, kurtosis(l_quantity) as kurtosis, quantile_cont(l_quantity, 0.1) as p10, median(l_quantity) as median from lineitem union all select 'l_extendedprice', count(*), avg(l_extendedprice), skewness(l_extendedprice), kurtosis(l_extendedprice), quantile_cont(l_extendedprice, 0.1), median(l_extendedprice) from lineitem", "@univariate")
q("PR10", "_VAR_:s c_custkey:i", "data b; set customer; if c_custkey < 20 then c_acctbal = c_acctbal + 1; if c_custkey = 30 then c_name = 'x'; run; proc compare base=customer compare=b out=out; id c_custkey; run;", "select 'c_acctbal' as _VAR_, c_custkey from customer where c_custkey < 20 union all select 'c_name', 30 from customer where c_custkey = 30")
q("PR11", "r_regionkey:i r_name:s", "data out; set region; run; data more; set nation(rename=(n_nationkey=r_regionkey)); keep r_regionkey n_name; run; proc append base=out data=more force; run;", "select r_regionkey, r_name from region union all select n_nationkey, null from nation")
q("PR12", "n:i", "libname l2 memory; proc copy in=work out=l2; select region nation; run; proc sql; create table out as select (select count(*) from l2.region) + (select count(*) from l2.nation) as n from work.region where r_regionkey = 0; quit;", "select 30 as n")
q("PR13", "a:i b:i", "data tmp1; x = 1; run; data tmp2; x = 2; run; proc datasets lib=work nolist; delete tmp1; change tmp2=tmp3; quit; data out; a = exist('tmp1'); b = exist('tmp3'); run;", "select 0 as a, 1 as b")
q("PR14", "variable:s type:s varnum:i", "proc contents data=nation; run;", "select * from (values ('n_nationkey', 'Num', 1), ('n_name', 'Char', 2), ('n_regionkey', 'Num', 3)) as t(variable, type, varnum)", "@contents")
q("PR15", "n_regionkey:i n_name:s", "proc print data=nation; var n_name; id n_regionkey; where n_regionkey > 2; run;", "select n_regionkey, n_name from nation where n_regionkey > 2", "@print")
q("PR16", "p_partkey:i v:s", "proc format; value sz low-10 = 'small' 10<-30 = 'mid' 30<-high = 'large'; value $br 'Brand#11' = 'first' other = 'rest'; run; data out; set part; v = put(p_size, sz.); keep p_partkey v; run;", "select p_partkey, case when p_size <= 10 then 'small' when p_size <= 30 then 'mid' else 'large' end as v from part")
q("PR17", "n_nationkey:i v:s", "data ctl; length fmtname $8 label $20 hlo $2; fmtname = 'nk'; start = 0; end = 4; label = 'A'; hlo = ''; output; start = 5; end = 9; label = 'B'; output; start = .; end = .; label = 'Z'; hlo = 'O'; output; run; proc format cntlin=ctl; run; data out; set nation; v = put(n_nationkey, nk.); keep n_nationkey v; run;", "select n_nationkey, case when n_nationkey between 0 and 4 then 'A' when n_nationkey between 5 and 9 then 'B' else 'Z' end as v from nation")
q("PR18", "o_orderkey:i v:s", "proc format; value $st 'F' = 'finished' 'O', 'P' = 'going'; run; data out; set orders; v = put(o_orderstatus, $st.); keep o_orderkey v; run;", "select o_orderkey, case when o_orderstatus = 'F' then 'finished' else 'going' end as v from orders")
q("PR19", "l_returnflag:s variable:s mean:d sum:d", "proc tabulate data=lineitem; class l_returnflag; var l_quantity; table l_returnflag, l_quantity*(mean sum); run;", "select l_returnflag, 'l_quantity' as variable, avg(l_quantity) as mean, sum(l_quantity) as sum from lineitem group by 1", "@tabulate")
q("PR20", "o_orderstatus:s o_totalprice:d", "proc report data=orders out=out; column o_orderstatus o_totalprice; define o_orderstatus / group; define o_totalprice / analysis mean; run;", "select o_orderstatus, avg(o_totalprice) as o_totalprice from orders group by 1")

# statistics

q("ST01", "variable:s with:s r:d", "proc corr data=lineitem; var l_quantity l_extendedprice l_tax; run;", " union all ".join(f"select '{a}' as variable, '{b}' as \"with\", corr({a}, {b}) as r from lineitem" for a in ("l_quantity", "l_extendedprice", "l_tax") for b in ("l_quantity", "l_extendedprice", "l_tax")), "@pearsoncorr")
_RK = "(select rank() over (order by l_quantity) + (count(*) over (partition by l_quantity) - 1) / 2.0 as a, rank() over (order by l_tax) + (count(*) over (partition by l_tax) - 1) / 2.0 as b from lineitem)"
q("ST02", "variable:s with:s r:d", "proc corr data=lineitem spearman; var l_quantity l_tax; run;", f"select 'l_quantity' as variable, 'l_tax' as \"with\", corr(a, b) as r from {_RK} union all select 'l_tax', 'l_quantity', corr(b, a) from {_RK} union all select 'l_quantity', 'l_quantity', 1.0 union all select 'l_tax', 'l_tax', 1.0", "@spearmancorr")
_TAU = "with c as (select l_quantity as x, l_tax as y, count(*) as n from lineitem group by 1, 2), s as (select sum(a.n * b.n * sign(a.x - b.x) * sign(a.y - b.y)) / 2 as s, sum(case when a.x <> b.x then a.n * b.n else 0 end) / 2 as px, sum(case when a.y <> b.y then a.n * b.n else 0 end) / 2 as py from c a, c b), r as (select s / sqrt(cast(px as double) * py) as r from s) select 'l_quantity' as variable, 'l_tax' as \"with\", r from r union all select 'l_tax', 'l_quantity', r from r union all select 'l_quantity', 'l_quantity', 1.0 union all select 'l_tax', 'l_tax', 1.0"
q("ST03", "variable:s with:s r:d", "proc corr data=lineitem kendall; var l_quantity l_tax; run;", _TAU, "@kendallcorr")
q("ST04", "variable:s tvalue:d df:d", "proc ttest data=lineitem h0=25; var l_quantity; run;", "select 'l_quantity' as variable, (avg(l_quantity) - 25) / (stddev_samp(l_quantity) / sqrt(count(*))) as tvalue, count(*) - 1 as df from lineitem", "@ttests")
q("ST05", "variable:s tvalue:d df:d", "proc ttest data=lineitem; class l_linestatus; var l_quantity; run;", "with g as (select l_linestatus, count(*) as n, avg(l_quantity) as m, var_samp(l_quantity) as v from lineitem group by 1), a as (select * from g where l_linestatus = 'F'), b as (select * from g where l_linestatus = 'O') select 'l_quantity' as variable, (a.m - b.m) / sqrt(((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2) * (1.0 / a.n + 1.0 / b.n)) as tvalue, a.n + b.n - 2 as df from a, b", "@ttests")
q("ST06", "variable:s tvalue:d", "proc ttest data=lineitem; paired l_tax*l_discount; run;", "select 'l_tax - l_discount' as variable, avg(l_tax - l_discount) / (stddev_samp(l_tax - l_discount) / sqrt(count(*))) as tvalue from lineitem", "@ttests")
q("ST07", "Intercept:d l_quantity:d", "proc reg data=lineitem outest=out; model l_extendedprice = l_quantity; run;", "select regr_intercept(l_extendedprice, l_quantity) as Intercept, regr_slope(l_extendedprice, l_quantity) as l_quantity from lineitem")
# a two-valued effect, whose estimates have a closed form
_BIN = "with d as (select quality, case when n_chars > 2000 then 1 else 0 end as k from labels join documents using (doc_id)), g as (select sum(quality * k) as a, sum((1 - quality) * k) as b, sum(quality * (1 - k)) as c, sum((1 - quality) * (1 - k)) as e from d)"
q("ST08", "variable:s estimate:d stderr:d", "data d; merge documents(keep=doc_id n_chars) labels(in=a); by doc_id; if a; k = n_chars > 2000; run; proc logistic data=d descending; model quality = k; run;", _BIN + " select 'Intercept' as variable, ln(1.0 * c / e) as estimate, sqrt(1.0 / c + 1.0 / e) as stderr from g union all select 'k', ln(1.0 * a * e / (1.0 * b * c)), sqrt(1.0 / a + 1.0 / b + 1.0 / c + 1.0 / e) from g", "@parameterestimates")
q("ST09", "event_type:s time:d n_risk:d survival:d", "data e; set events; t = ceil(value / 10); c = mod(event_id, 3) = 0; run; proc lifetest data=e; time t*c(1); strata event_type; run;", "with c as (select event_type, ceil(value / 10) as time, sum(case when event_id % 3 = 0 then 0 else 1 end) as d, count(*) as m from events group by 1, 2), r as (select *, sum(m) over (partition by event_type order by time desc) as n_risk from c) select event_type, time, n_risk, case when max(case when d = n_risk then 1 else 0 end) over w = 1 then 0.0 else exp(sum(case when d < n_risk then ln(1 - cast(d as double) / n_risk) else 0.0 end) over w) end as survival from r window w as (partition by event_type order by time)", "@survivalplot")
_SURV = "data e; set events; t = ceil(value / 10); c = mod(event_id, 3) = 0; g = mod(user_id, 2); run; "
_RANK = "with c as (select {s} as s, ceil(value / 10) as t, user_id % 2 as g, case when event_id % 3 = 0 then 0 else 1 end as d from events), p as (select s, t, count(*) as m, sum(g) as m1, sum(d) as d, sum(d * g) as d1 from c group by 1, 2), r as (select d, d1, cast(sum(m) over w as double) as n, cast(sum(m1) over w as double) as n1 from p window w as (partition by s order by t desc)), z as (select sum(d1 - d * n1 / n) as u, sum(case when n > 1 then d * (n - d) / (n - 1) * n1 / n * (1 - n1 / n) else 0 end) as v from r where d > 0) select 'Log-Rank' as test, u * u / v as chisq, 1 as df from z"
q("ST10", "test:s chisq:d df:d", _SURV + "proc lifetest data=e; time t*c(1); strata g; run;", _RANK.format(s="0"), "@homtests")
q("ST10S", "test:s chisq:d df:d", _SURV + "ods output logunichisq=out; proc lifetest data=e; time t*c(1); strata event_type / group=g; run;", _RANK.format(s="event_type"))
_KM = "with c as (select event_type, ceil(value / 10) as time, sum(case when event_id % 3 = 0 then 0 else 1 end) as d, count(*) as m from events group by 1, 2), r as (select *, sum(m) over (partition by event_type order by time desc) as n_risk from c), k as (select event_type, time, d, case when max(case when d = n_risk then 1 else 0 end) over w = 1 then 0.0 else exp(sum(case when d < n_risk then ln(1 - cast(d as double) / n_risk) else 0.0 end) over w) end as s from r window w as (partition by event_type order by time)), v as (select *, lead(time) over (partition by event_type order by time) as next from k where d > 0), p as (select * from (values (25, 0.75), (50, 0.5), (75, 0.25)) as t(percent, level)), h as (select event_type, percent, level, min_by(time, time) as time, min_by(s, time) as s, min_by(next, time) as next from v join p on s <= level + 1e-12 group by 1, 2, 3), e as (select distinct event_type, percent from events, p) select e.event_type, e.percent, case when abs(s - level) < 1e-12 and next is not null then (time + next) / 2 else time end as estimate from e left join h on e.event_type = h.event_type and e.percent = h.percent"
q("ST11", "event_type:s percent:i estimate:d", "data e; set events; t = ceil(value / 10); c = mod(event_id, 3) = 0; run; proc lifetest data=e; time t*c(1); strata event_type; run;", _KM, "@quartiles")
# Newton's steps on the Efron likelihood, over counts by time and value
_COX = "with recursive c as (select ceil(value / 10) as t, user_id % 5 as x, count(*) as m, sum(case when event_id % 3 = 0 then 0 else 1 end) as d from events group by 1, 2), g as (select t, x, coalesce(m, 0) as m, coalesce(d, 0) as d from (select * from (select distinct t from c), (select distinct x from c)) left join c using (t, x)), k as (select t, x, d, sum(m) over (partition by x order by t desc) as n, sum(d) over (partition by t) as dd from g), b as (select 0 as i, cast(0 as double) as beta union all select i + 1, beta + sum(u) / sum(v) from (select i, beta, (case when f = 0 then dx else 0 end) - (s1 - f * d1) / (s0 - f * d0) as u, (s2 - f * d2) / (s0 - f * d0) - ((s1 - f * d1) / (s0 - f * d0)) ** 2 as v from (select i, beta, dx, s0, s1, s2, d0, d1, d2, unnest(range(dd)) / cast(dd as double) as f from (select i, beta, t, cast(max(dd) as bigint) as dd, sum(d * x) as dx, sum(n * exp(beta * x)) as s0, sum(n * x * exp(beta * x)) as s1, sum(n * x * x * exp(beta * x)) as s2, sum(d * exp(beta * x)) as d0, sum(d * x * exp(beta * x)) as d1, sum(d * x * x * exp(beta * x)) as d2 from b, k where i < 10 group by 1, 2, 3) where dd > 0)) group by i, beta) select 'x' as parameter, beta as estimate, exp(beta) as hazardratio from b where i = 10"
q("ST12", "parameter:s estimate:d hazardratio:d", "data e; set events; t = ceil(value / 10); c = mod(event_id, 3) = 0; x = mod(user_id, 5); run; proc phreg data=e; model t*c(1) = x; run;", _COX, "@parameterestimates")
q("ST13", "description:s inside:i", _SURV + "ods output hazardratios=h; proc phreg data=e; model t*c(1) = g; hazardratio 'of g' g / cl=pl; run; data out; set h; inside = pllower < hazardratio < plupper and abs(log(pllower) - log(waldlower)) < 0.001 and abs(log(plupper) - log(waldupper)) < 0.001; run;", "select 'of g' as description, 1 as inside")
_LANG = "with g as (select lang, sum(quality) as a, sum(1 - quality) as b from labels join documents using (doc_id) group by 1), z as (select * from g order by lang desc limit 1) select 'Intercept' as parameter, ln(1.0 * a / b) as estimate, sqrt(1.0 / a + 1.0 / b) as stderr from z union all select 'lang ' || g.lang, ln(1.0 * g.a * z.b / (1.0 * g.b * z.a)), sqrt(1.0 / g.a + 1.0 / g.b + 1.0 / z.a + 1.0 / z.b) from g, z where g.lang <> z.lang"
q("ST14", "parameter:s estimate:d stderr:d", "data d; merge documents(keep=doc_id lang) labels(in=a); by doc_id; if a; run; proc genmod data=d descending; class lang; model quality = lang / dist=binomial link=logit type3; run;", _LANG, "@parameterestimates")

# scalar functions


def f(key: str, expr: str, sql: str, kind: str = "s", table: str = "part", k: str = "p_partkey") -> None:
    q(key, f"{k}:i v:{kind}", f"select {k}, {expr} as v from {table}", f"select {k}, {sql} as v from {table}")


f("FN01", "substr(p_name, 2, 4)", "substr(p_name, 2, 4)")
f("FN02", "scan(p_type, 2, ' ')", "coalesce(list_filter(string_split(p_type, ' '), lambda x: x <> '')[2], '')")
f("FN03", "compress(p_name, 'aei')", "translate(p_name, 'aei', '')")
f("FN04", "upcase(p_name)", "upper(p_name)")
f("FN05", "lowcase(p_type)", "lower(p_type)")
f("FN06", "strip('  ' || p_name || ' ')", "p_name")
f("FN07", "trim(p_name || '  ') || '.'", "p_name || '.'")
f("FN08", "left('  ' || p_name)", "p_name")
f("FN09", "cat(p_name, '-', p_size)", "p_name || '-' || p_size")
f("FN10", "cats(' ', p_name, ' x ')", "p_name || 'x'")
f("FN11", "catx('/', p_brand, ' ', p_name)", "p_brand || '/' || p_name")
f("FN12", "compbl(p_brand || '   ' || p_name)", "p_brand || ' ' || p_name")
f("FN13", "tranwrd(p_name, 'a', 'zz')", "replace(p_name, 'a', 'zz')")
f("FN14", "index(p_name, 'e')", "instr(p_name, 'e')", "i")
f("FN15", "find(p_type, 'STEEL', 'i', 3)", "case when instr(substr(lower(p_type), 3), 'steel') = 0 then 0 else instr(substr(lower(p_type), 3), 'steel') + 2 end", "i")
f("FN16", "count(p_name, 'a')", "length(p_name) - length(replace(p_name, 'a', ''))", "i")
f("FN17", "repeat('ab', 3)", "'ababab'")
f("FN18", "reverse(p_name)", "reverse(p_name)")
f("FN19", "length(p_name || '   ')", "length(p_name)", "i")
f("FN20", "lengthc(p_name || '   ')", "length(p_name) + 3", "i")
f("FN21", "missing(case when p_size > 25 then p_name end)", "case when p_size > 25 then 0 else 1 end", "i")
f("FN22", "coalescec(case when p_size > 25 then '' else p_name end, 'none')", "case when p_size > 25 then 'none' else p_name end")
f("FN23", "prxmatch('/[aeiou]{2}/i', p_name)", "case when regexp_extract(p_name, '(?i)[aeiou]{2}') = '' then 0 else instr(p_name, regexp_extract(p_name, '(?i)[aeiou]{2}')) end", "i")
f("FN24", "prxchange('s/([aeiou])(.)/$2$1/', 1, p_name)", "regexp_replace(p_name, '([aeiou])(.)', '\\2\\1')")
f("FN25", "propcase('hello big-world ' || p_size)", "'Hello Big-World ' || p_size")
f("FN26", "countw(p_type)", "len(list_filter(string_split(p_type, ' '), lambda x: x <> ''))", "i")
f("FN27", "verify(p_brand, 'Brand#')", "case when length(ltrim(p_brand, 'Brand#')) = 0 then 0 else length(p_brand) - length(ltrim(p_brand, 'Brand#')) + 1 end", "i")
f("FN28", "substrn(p_name, 3)", "substr(p_name, 3)")
f("FN29", "translate(p_name, 'xyz', 'abc')", "translate(p_name, 'abc', 'xyz')")
f("FN30", "case when like(p_name, '%a%') then 1 else 0 end", "case when p_name like '%a%' then 1 else 0 end", "i")
f("FN31", "rank(p_name)", "ascii(p_name)", "i")
f("FN32", "byte(65 + mod(p_size, 20))", "chr(65 + p_size % 20)")
_N = dict(kind="d", table="supplier", k="s_suppkey")
f("FN33", "sum(s_acctbal, ., 1)", "s_acctbal + 1", **_N)
f("FN34", "mean(s_acctbal, ., 10)", "(s_acctbal + 10) / 2", **_N)
f("FN35", "min(s_acctbal, 500, .)", "least(s_acctbal, 500)", **_N)
f("FN36", "max(s_acctbal, 500, .)", "greatest(s_acctbal, 500)", **_N)
f("FN37", "n(s_acctbal, ., 1)", "2", **_N)
f("FN38", "nmiss(s_acctbal, ., 1)", "1", **_N)
f("FN39", "cmiss(s_name, '', s_acctbal)", "1", **_N)
f("FN40", "round(s_acctbal, 10)", "sign(s_acctbal) * floor(abs(s_acctbal) / 10 + 0.5) * 10", **_N)
f("FN41", "int(s_acctbal)", "trunc(s_acctbal)", **_N)
f("FN42", "mod(s_acctbal, 7)", "s_acctbal - 7 * floor(s_acctbal / 7)", **_N)
f("FN43", "ceil(s_acctbal)", "ceil(s_acctbal)", **_N)
f("FN44", "floor(s_acctbal)", "floor(s_acctbal)", **_N)
f("FN45", "abs(s_acctbal)", "abs(s_acctbal)", **_N)
f("FN46", "sqrt(s_acctbal)", "case when s_acctbal >= 0 then sqrt(s_acctbal) end", **_N)
f("FN47", "log(s_acctbal)", "case when s_acctbal > 0 then ln(s_acctbal) end", **_N)
f("FN48", "log10(s_acctbal)", "case when s_acctbal > 0 then log10(s_acctbal) end", **_N)
f("FN49", "exp(s_acctbal / 10000)", "exp(s_acctbal / 10000)", **_N)
f("FN50", "sin(s_acctbal)", "sin(s_acctbal)", **_N)
f("FN51", "cos(s_acctbal)", "cos(s_acctbal)", **_N)
f("FN52", "tan(s_suppkey / 1000)", "tan(s_suppkey / 1000.0)", **_N)
f("FN53", "sign(s_acctbal)", "sign(s_acctbal)", **_N)
f("FN54", "std(s_acctbal, 1, 2)", "sqrt(((s_acctbal - (s_acctbal + 3) / 3) ** 2 + (1 - (s_acctbal + 3) / 3) ** 2 + (2 - (s_acctbal + 3) / 3) ** 2) / 2)", **_N)
f("FN55", "range(s_acctbal, 100, 5)", "greatest(s_acctbal, 100) - least(s_acctbal, 5)", **_N)
f("FN56", "median(s_acctbal, 100, 5)", "case when s_acctbal < 5 then 5 when s_acctbal > 100 then 100 else s_acctbal end", **_N)
f("FN57", "coalesce(case when s_acctbal > 0 then s_acctbal end, -1)", "case when s_acctbal > 0 then s_acctbal else -1 end", **_N)
q("FN58", "s_suppkey:i ok:i", "data out; set supplier; u = ranuni(7); ok = (u >= 0 and u < 1); keep s_suppkey ok; run;", "select s_suppkey, 1 as ok from supplier")
q("FN59", "s_suppkey:i ok:i", "data out; set supplier; u = rannor(7); ok = (abs(u) < 9); keep s_suppkey ok; run;", "select s_suppkey, 1 as ok from supplier")
q("FN60", "a:d b:d", "data out; a = probnorm(1.96); b = probnorm(0); run;", "select 0.9750021048517795 as a, 0.5 as b")
q("FN61", "a:d b:d", "data out; a = probit(0.975); b = probit(0.5); run;", "select 1.959963984540054 as a, 0.0 as b")
q("FN62", "a:d b:d", "data out; a = probt(2.228139, 10); b = probt(0, 5); run;", "select 0.975 as a, 0.5 as b")
q("FN63", "a:d", "data out; a = probf(4.964603, 1, 10); run;", "select 0.95 as a")
q("FN64", "a:d b:d", "data out; a = probchi(3.841459, 1); b = probchi(18.30704, 10); run;", "select 0.95 as a, 0.95 as b")
q("FN65", "ok:i", "data out; ok = (today() > 23000); run;", "select 1 as ok")
q("FN66", "ok:i", "data out; ok = (date() = today()); run;", "select 1 as ok")
q("FN67", "ok:i", "data out; ok = (datetime() > 86400 * 23000); run;", "select 1 as ok")
_D = dict(kind="i", table="orders", k="o_orderkey")
_DAY = "(date_diff('day', date '1960-01-01', cast(o_orderdate as date)))"
f("FN68", "mdy(month(o_orderdate), 1, year(o_orderdate))", "date_diff('day', date '1960-01-01', cast(date_trunc('month', o_orderdate) as date))", **_D)
f("FN69", "year(datepart(o_orderdate))", "year(o_orderdate)", **_D)
f("FN70", "month(datepart(o_orderdate))", "month(o_orderdate)", **_D)
f("FN71", "day(datepart(o_orderdate))", "day(o_orderdate)", **_D)
f("FN72", "weekday(datepart(o_orderdate))", "dayofweek(o_orderdate) + 1", **_D)
f("FN73", "qtr(datepart(o_orderdate))", "quarter(o_orderdate)", **_D)
f("FN74", "intnx('MONTH', datepart(o_orderdate), 2, 'B')", "date_diff('day', date '1960-01-01', cast(date_trunc('month', o_orderdate) + interval 2 month as date))", **_D)
f("FN75", "intck('QTR', '01JAN1992'd, datepart(o_orderdate))", "(year(o_orderdate) - 1992) * 4 + quarter(o_orderdate) - 1", **_D)
f("FN76", "datepart(o_orderdate)", _DAY, **_D)
f("FN77", "timepart(datepart(o_orderdate) * 86400 + 3661)", "3661", **_D)
f("FN78", "datedif('01JAN1992'd, datepart(o_orderdate), 'MONTH')", "(year(o_orderdate) - 1992) * 12 + month(o_orderdate) - 1", **_D)
f("FN79", "hour(datepart(o_orderdate) * 86400 + 7322)", "2", **_D)
f("FN80", "minute(datepart(o_orderdate) * 86400 + 7322)", "2", **_D)
f("FN81", "input(put(o_totalprice, 12.2), comma12.)", "round(o_totalprice, 2)", kind="d", table="orders", k="o_orderkey")
f("FN82", "put(datepart(o_orderdate), date9.) || '|' || strip(put(o_totalprice, 12.2))", "upper(strftime(o_orderdate, '%d%b%Y')) || '|' || printf('%.2f', o_totalprice)", table="orders", k="o_orderkey")
f("FN83", "putn(datepart(o_orderdate), 'yymmdd10.')", "strftime(o_orderdate, '%Y-%m-%d')", table="orders", k="o_orderkey")
f("FN84", "ifc(o_totalprice > 100000, 'hi', 'lo')", "case when o_totalprice > 100000 then 'hi' else 'lo' end", table="orders", k="o_orderkey")
f("FN85", "ifn(o_totalprice > 100000, 1, 2)", "case when o_totalprice > 100000 then 1 else 2 end", **_D)
q("FN86", "o_orderkey:i v:s", "proc format; value pr low-<100000 = 'low' 100000-high = 'high'; run; data out; set orders; v = put(o_totalprice, pr.); keep o_orderkey v; run;", "select o_orderkey, case when o_totalprice < 100000 then 'low' else 'high' end as v from orders")

# macro layer

q("MC01", "a:i b:s", "%let x = 3; %let y = x; data out; a = &x; b = \"&&&y..z\"; run;", "select 3 as a, '3z' as b")
q("MC02", "k:i", "%macro add(n, by=2); data out; k = &n + &by; run; %mend add; %add(5, by=10)", "select 15 as k")
q("MC04", "n:i", "%macro m(t); %if &t = orders %then %do; proc sql; create table out as select count(*) as n from orders; quit; %end; %else %do; data out; n = 0; run; %end; %mend; %m(orders)", "select count(*) as n from orders")
q("MC05", "k:i v:i", "%macro m; data out; %do i = 1 %to 4; k = &i; v = %eval(&i * &i); output; %end; run; %mend; %m", "select i as k, i * i as v from (values (1), (2), (3), (4)) as t(i)")
q("MC06", "a:i b:d", "data out; a = %eval(10-3-2); b = %sysevalf(7/4 + 1); run;", "select 5 as a, 2.75 as b")
q("MC07", "a:s b:i c:s", "data out; a = \"%upcase(abc)%scan(x y z, 2)%substr(hello, 2, 3)\"; b = %length(abcd) + %index(abc, c); c = \"%lowcase(QQ)\"; run;", "select 'ABCyell' as a, 7 as b, 'qq' as c")
q("MC08", "a:i b:s", "data out; a = %sysfunc(exist(orders)); b = \"%sysfunc(upcase(abc))\"; run;", "select 1 as a, 'ABC' as b")
q("MC09", "k:i", "%macro m; %let k = 1; %goto done; %let k = 2; %done: data out; k = &k; run; %mend; %m", "select 1 as k")
q("MC15", "n:i", "proc sql noprint; select max(o_orderkey) into :mx from orders; quit; %let half = %sysevalf(&mx / 2, integer); proc sql; create table out as select count(*) as n from orders where o_orderkey <= &half; quit;", "select count(*) as n from orders where o_orderkey <= (select floor(max(o_orderkey) / 2) from orders)")


q("MC03", "k:i", "%macro inner(a); %let r = %eval(&a * 2); %mend; %macro outer; %local r; %let r = 1; %inner(4) data out; k = &r; run; %mend; %outer", "select 8 as k")
q("MC12", "k:i", "%* a comment with ; /* another; */ * and one more; data out; k = 1; /* inside */ run;", "select 1 as k")
q("MC13", "ok:i", "data out; ok = (length(\"&sysdate9\") = 9); run;", "select 1 as ok")
q("IO14", "a:i b:s", "data out; input a b $; datalines4;\n1 x\n2 y\n;;;;\nrun;", "select * from (values (1, 'x'), (2, 'y')) as t(a, b)")
q("IO22", "k:i", "data a; set region; run; proc sort; by r_regionkey; run; data out; set _last_; k = r_regionkey; keep k; run;", "select r_regionkey as k from region")
q("DS36", "n_nationkey:i a:s b:s", "data out; set nation; label n_name = 'Name of it'; format n_regionkey 5.1; a = vlabel(n_name); b = strip(vvalue(n_regionkey)); keep n_nationkey a b; run;", "select n_nationkey, 'Name of it' as a, n_regionkey || '.0' as b from nation")
q("PR22", "percent:i event_type:s estimate:d", "data e; set events; t = ceil(value / 10); c = mod(event_id, 3) = 0; run; ods output quartiles=out; proc lifetest data=e; time t*c(1); strata event_type; run;", _KM)

# operators that other queries use without being their subject

_NAT = "select n_nationkey, n_name, n_regionkey from nation"
_NATS = "n_nationkey:i n_name:s n_regionkey:i"
q("IO01", _NATS, "libname m memory; data m.nat; set nation; run; data out; set m.nat; run;", _NAT)
q("IO02", _NATS, "libname x xport '{tmp}'; data x.nat; set nation; run; libname x clear; libname y xport '{tmp}'; data out; set y.nat; run;", _NAT)
q("IO03", "p_partkey:i p_brand:s p_retailprice:d", "libname x xport '{tmp}'; data x.parts(keep=p_partkey p_brand p_retailprice); set part; run; data out; set x.parts; run;", "select p_partkey, p_brand, p_retailprice from part")
q("IO05", "name:s varnum:i", "libname x xport '{tmp}'; data x.t; a_long_name_of_one = 1; a_long_name_of_two = 2; short = 3; run; libname x clear; libname y xport '{tmp}'; data t; set y.t; run; proc sql; create table out as select name, varnum from dictionary.columns where libname = 'WORK' and memname = 'T'; quit;", "select * from (values ('a_long_name_of_one', 1), ('a_long_name_of_two', 2), ('short', 3)) as t(name, varnum)")
q("IO15", _NATS, "libname a '{tmp}'; data a.nat; set nation; run; libname a clear; libname b '{tmp}'; data out; set b.nat; run;", _NAT)
q("EX16", "k:i a:s b:s", "proc sql; create table t as select n_nationkey as k label='The key', n_regionkey as r format=5.1 from nation; quit; data out; set t; a = vlabel(k); b = strip(vvalue(r)); keep k a b; run;", "select n_nationkey as k, 'The key' as a, n_regionkey || '.0' as b from nation")
q("EX21", "k:i v:d", "data out; set orders; k = o_orderkey; v = input(o_orderpriority, ?? 8.); w = input(put(o_orderkey, 8.), ?? 8.); v = sum(v, w); keep k v; run;", "select o_orderkey as k, o_orderkey as v from orders")
q("DM09", "n:i", "proc sql noprint; select count(*) into :n from nation; quit; proc sql noprint; create table out as select &n as n from region where r_regionkey = 0; quit;", "select 25 as n")
q("DS44", "r_regionkey:i v:i", "data a; set region; v = r_regionkey * 2; data out; set a; v = v + 1; proc sort data=out; by r_regionkey; run;", "select r_regionkey, r_regionkey * 2 + 1 as v from region")
_LANG_EN = _LANG.replace("order by lang desc limit 1", "where lang = 'en'")
q("ST15", "parameter:s estimate:d stderr:d", "data d; merge documents(keep=doc_id lang) labels(in=a); by doc_id; if a; run; proc genmod data=d descending; class lang(ref='en'); model quality = lang / dist=binomial link=logit; run;", _LANG_EN, "@parameterestimates")


def queries() -> dict:
    return {x.key: x.run for x in ALL}


def oracle_sql() -> dict[str, str]:
    return {x.key: s for x in ALL if (s := x.oracle()) is not None}
