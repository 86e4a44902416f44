import io

import pytest

from rowloom.__main__ import main
from rowloom.plans.session import Engine
from rowloom.reporter import Reporter


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "a.sas").write_text("data user.t; x = 2; output; x = 3; output; run;")
    assert main([str(tmp_path / "a.sas"), "--workdir", str(tmp_path / "w")], spark) == 0
    assert "No errors or warnings" in capsys.readouterr().err
    e = Engine(spark)
    e.execute(f"libname u '{tmp_path / 'w'}';")
    assert [r.x for r in e.get_dataset("u.t").collect()] == [2, 3]
    assert main(["-e", "data a; set nowhere; run; data b; x = 1; run;", "--quiet"], spark) == 1
    assert "ERROR" in capsys.readouterr().err
    assert main(["--version"], spark) == 0
    assert main([str(tmp_path / "missing.sas")], spark) == 1


def test_typed_programs(spark, monkeypatch, capsys):
    monkeypatch.setattr("sys.stdin", io.StringIO("data a; x = 1;\nrun;\n%put it is &syslast;\n"))
    assert main(["-i"], spark) == 0
    assert "it is WORK.A" in capsys.readouterr().err


def test_reporter_modes(spark):
    out = io.StringIO()
    r = Reporter(out, color=True, quiet=True, stop_on=("warning",))
    r.say("note", "a")
    assert not r.stops and out.getvalue() == ""
    r.say("warning", "b")
    assert r.stops and "WARNING: b" in out.getvalue() and "\033[33m" in out.getvalue() and r.summary() == "1 warning(s)"
    e = Engine(spark, fail_fast=False, reporter=Reporter(io.StringIO(), stop_on=("error",)))
    got = e.execute("data a; set nowhere; run; data b; x = 1; run;")
    assert [s.ok for s in got.steps] == [False] and not e.exists("b")


def test_many_to_many_merges_are_listed(spark):
    e = Engine(spark)
    e.execute("data l; input id a; datalines;\n1 10\n1 20\n2 5\n;\nrun; data r; input id b; datalines;\n1 1\n1 2\n1 3\n2 5\n2 6\n;\nrun; data s; input id c; datalines;\n2 1\n2 1\n;\nrun;")
    e.execute("data m; merge l r s; by id; run;")
    assert not e.warnings()
    e.execute("options mergewarn; data m; merge l r s; by id; run;")
    assert len(e.warnings()) == 2
    assert "ID=1" in e.warnings()[0] and "WORK.L (2 observations), WORK.R (3 observations)" in e.warnings()[0]
    assert "ID=2" in e.warnings()[1] and "WORK.R (2 observations), WORK.S (2 observations)" in e.warnings()[1]


def test_long_names_in_transport_files(spark, tmp_path):
    e = Engine(spark)
    e.execute(f"libname x xport '{tmp_path}'; data x.t; a_very_long_name_1 = 1; a_very_long_name_2 = 2; short = 3; run;")
    e = Engine(spark)
    e.execute(f"libname x xport '{tmp_path}';")
    assert [c.lower() for c in e.get_dataset("x.t").columns] == ["a_very_long_name_1", "a_very_long_name_2", "short"]
    path = tmp_path / "t.xpt"
    path.write_bytes(path.read_bytes() + b" " * 80)
    with pytest.raises(Exception, match="was changed"):
        e.get_dataset("x.t").collect()


def test_delimited_files_are_joined_in_order(spark, tmp_path):
    e = Engine(spark)
    e.create_dataset("n", spark.range(5000).repartition(7).toDF("k"), order=["k"])
    e.execute(f"proc export data=n outfile='{tmp_path}/n.csv' dbms=csv replace; run;")
    lines = (tmp_path / "n.csv").read_text().splitlines()
    assert lines == ["k", *map(str, range(5000))] and [p.name for p in tmp_path.iterdir() if not p.name.endswith(".crc")] == ["n.csv"]


def test_diagnostics_of_data_steps(spark):
    e = Engine(spark)
    e.execute("options diagnostics; data s; input id; datalines;\n1\n2\n0\n;\nrun; data r; set s; a = never + id; b = 10 / id; c = sqrt(id - 1); d = 'ID' || id; if '2' = id then f = '12' + 1; g = 'no number' * 2; run;")
    found = "\n".join(e.warnings())
    for text in ("Variable never is uninitialized", "occurred 3 times", "division by zero occurred 1 time", "SQRT", "numeric-to-character conversion in concatenation", "character-to-numeric conversion in comparison", "character-to-numeric conversion in arithmetic", "invalid numeric data"):
        assert text.lower() in found.lower(), (text, found)
    quiet = Engine(spark)
    quiet.execute("data s; x = 0; run; data r; set s; b = 10 / x; run;")
    assert not quiet.warnings()
