import itertools
import random
import re

import numpy as np
import pytest
import xxhash

from rowloom.llm import simhash, suffixes
from rowloom.llm.components import components


def _fingerprint(text):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in h) > len(h))


TEXTS = ["", None, " \n", "One", "one TWO", "a b c", "Ä b\x0bc d e", "x y z x y z x y z", "w " * 20_000, "　 \x1c a"]


def test_fingerprints():
    for t in TEXTS:
        assert simhash.fingerprint(None if t is None else t.encode()) == _fingerprint(t)


def _classes(values, radius=2):
    label = list(range(len(values)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(values):
            for j, b in enumerate(values):
                if (a ^ b).bit_count() <= radius and label[j] < label[i]:
                    label[i], changed = label[j], True
    return label


@pytest.mark.parametrize("most", [4096, 3])
def test_links_lose_no_class(spark, most):
    r = random.Random(2)
    values = {0, 1, 3, 1 << 63}
    for _ in range(25):
        v = r.getrandbits(64)
        for _ in range(6):
            values.add(v)
            for _ in range(r.choice([1, 2, 2, 3])):
                v ^= 1 << r.randrange(64)
    values = sorted(values)
    df = spark.createDataFrame([(int(np.uint64(v).astype(np.int64)),) for v in values], "fp long")
    links = simhash.near_links(df, most=most)
    pairs = [(r.a, r.b) for r in links.collect()]
    assert all((int(np.int64(a).astype(np.uint64)) ^ int(np.int64(b).astype(np.uint64))).bit_count() <= 2 for a, b in pairs)
    root = {r.node: r.root for r in components(links).collect()}
    label = _classes(values)
    got = {}
    for v, k in zip(values, label, strict=True):
        s = int(np.uint64(v).astype(np.int64))
        assert got.setdefault(k, root.get(s, s)) == root.get(s, s)
    assert len(set(got.values())) == len(set(label))


def test_components_of_a_long_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(100, 150)] + [(7, i) for i in range(200, 260)] + [(5, 5)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 100 for i in range(100, 151)} | {i: 7 for i in [7, *range(200, 260)]}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_near_classes(spark):
    base = " ".join(f"word{i}" for i in range(400))
    rows = [(9, base, ""), (4, base, ""), (6, base + " more", ""), (2, "quite another text with words", ""), (3, None, ""), (1, "", ""), (None, base, ""), (2, "third one", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    label = _classes([_fingerprint(t) for _, t, _ in rows])
    least = {k: min(d for (d, _, _), x in zip(rows, label, strict=True) if x == k and d is not None) for k in label}
    want = sorted(((d is not None, d or 0, least[k]) for (d, _, _), k in zip(rows, label, strict=True)))
    got = sorted(((r.doc_id is not None, r.doc_id or 0, r.component_id) for r in simhash.near_classes(docs).collect()))
    assert got == want and want[0] == (False, 0, 4) and (True, 3, 1) in want
    assert sorted(r.doc_id for r in simhash.keep_one(docs).collect()) == sorted(d for d, _, c in ((b, b, c) for a, b, c in want if a) if d == c)
    assert simhash.near_classes(docs.limit(0)).collect() == []


def test_gram_hashes_do_not_depend_on_the_place():
    h = np.random.default_rng(0).integers(0, 1 << 63, 200).astype(np.uint64)
    twice = np.concatenate([h, h[:50], h])
    for n in (1, 2, 3, 5, 30, 31, 64):
        g = suffixes.gram_hashes(twice, n)
        assert len(g) == len(twice) - n + 1 and (g[: 200 - n + 1] == g[250 : 450 - n + 1]).all() and len(set(g.tolist())) > 150


def _repeated(docs, least):
    """Words inside a passage of ``least`` words that an earlier place has."""
    seen, out = {}, {}
    for key in sorted(docs):
        w = docs[key].split()
        hit = set()
        for i in range(len(w) - least + 1):
            win = tuple(w[i : i + least])
            if win in seen:
                hit |= set(range(i, i + least))
            else:
                seen[win] = (key, i)
        out[key] = hit
    return out


def test_repeats_are_brute_force(spark):
    r = random.Random(3)
    text = lambda n: [f"w{r.randrange(5000)}" for _ in range(n)]
    passages = [text(n) for n in (50, 51, 60, 75, 49, 45, 130)]
    docs = {}
    for i in range(40):
        body = text(r.randrange(0, 120))
        for p in r.sample(passages, r.randrange(0, 3)):
            at = r.randrange(len(body) + 1)
            body[at:at] = p
        docs[i] = " ".join(body)
    docs[40] = docs[7] + "\n" + docs[7]
    docs[41] = " ".join(["tick"] * 300)
    docs[42] = ""
    rows = [(i, t, "x") for i, t in docs.items()] + [(7, docs[7], "x"), (43, None, "x")]
    got = suffixes.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string, n_words string")).collect()
    assert len(got) == len(rows)
    want = _repeated(docs, 50)
    for x in got:
        if x.doc_id == 43:
            continue
        places = {p for a, z in x.removed for p in range(a, z)}
        assert places <= want[x.doc_id], x.doc_id
        stays = sorted(want[x.doc_id] - places)  # only where a third document's passage ends nearby
        runs = [list(g) for _, g in itertools.groupby(stays, key=lambda p, at=iter(range(10**6)): p - next(at))]
        assert all(len(g) < suffixes.W for g in runs) and (x.doc_id == 40 or not runs), x.doc_id
        kept = [w for i, w in enumerate((docs[x.doc_id]).split()) if i not in places]
        assert x.text.split() == kept and x.n_removed == len(places)


def test_repeats_of_nothing(spark):
    assert suffixes.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []
