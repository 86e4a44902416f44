import random

from rowloom.llm import suffixes


def _repeated(docs, least=50):
    seen, out = set(), {}
    for key in sorted(docs):
        w, hit = docs[key].split(), set()
        for i in range(len(w) - least + 1):
            win = tuple(w[i : i + least])
            if win in seen:
                hit |= set(range(i, i + least))
            seen.add(win)
        out[key] = hit
    return out


def test_nested_and_overlapping_fragments_are_brute_force(spark):
    r = random.Random(11)
    text = lambda n: [f"w{r.randrange(4000)}" for _ in range(n)]
    docs = {}
    for n in (50, 52, 55, 60, 65, 69, 80, 130):
        for _ in range(4):
            p = text(n)
            cuts = [p[:49], p[-49:], *(p[a : a + k] for k in (20, 30, 49) for a in [r.randrange(n - k + 1)]), p, p, p[: n - 3], text(2) + p[2:]]
            r.shuffle(cuts[:5])
            for c in cuts:
                docs[len(docs)] = " ".join(text(r.randrange(40)) + c + text(r.randrange(40)))
    p = text(60)  # one document meets only pieces of another's repeats
    docs[len(docs)] = " ".join([*p[:30], *text(9), *p, *text(9), *p[20:], *text(9), *p[3:]])
    docs[len(docs)] = " ".join([*text(9), *p[1:], *text(9), *p[:55]])
    docs[len(docs)] = " ".join(["tick", "tock"] * 100)
    rows = [*docs.items(), (3, docs[3])]
    want = _repeated(docs)
    got = suffixes.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows) and sum(map(len, want.values())) > 5000
    wrong = {x.doc_id: len({p for a, z in x.removed for p in range(a, z)} ^ want[x.doc_id]) for x in got}
    assert not sum(wrong.values()), wrong
