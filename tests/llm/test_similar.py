import random

import numpy as np

from rowloom.llm import similar


def _set(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def _jaccard(a, b):
    return 1.0 if not a and not b else len(a & b) / len(a | b)


def test_near_copies_from_80_to_95_percent_go(spark):
    r = random.Random(5)
    text = lambda n: [f"w{r.randrange(3000)}" for _ in range(n)]
    common = text(40)  # in many documents that are no near copies
    rows, planted = [], 0
    for n in (50, 100, 200, 400):
        for k in range(3):
            base = text(n)
            rows.append((len(rows), " ".join(base)))
            for _ in range(4):
                w = list(base)
                for at in r.sample(range(n), r.randrange(1, max(2, n // 50 + 1))):
                    w[at] = "new"
                rows.append((len(rows), " ".join(w)))
                planted += 0.8 <= _jaccard(_set(rows[-1][1]), _set(" ".join(base))) <= 0.95
    for k in range(60):
        rows.append((len(rows), " ".join(text(60) + common)))
    hot = text(300)
    for k in range(60):
        w = list(hot)
        w[k * 4] = "other"
        rows.append((len(rows), " ".join(w)))
    rows += [(len(rows), None), (len(rows) + 1, ""), (len(rows) + 2, "one two")]
    sets = [_set(t) for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if label[i] != label[j] and _jaccard(sets[i], sets[j]) >= 0.8:
                label = [min(label[i], label[j]) if x in (label[i], label[j]) else x for x in label]
    assert planted >= 20
    got = similar.keep_one_similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(x.doc_id for x in got) == sorted(set(label))


def test_one_row_of_each_class(spark):
    base = " ".join(f"word{i}" for i in range(400))
    rows = [(1, base), (1, base), (1, base.upper()), (2, base), (3, "quite another text"), (3, base), (None, "of no id"), (None, "of no id"), (None, base)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((x.doc_id or 0, x.text.lower()) for x in similar.keep_one_similar(docs).collect()) == [(0, "of no id"), (1, base), (3, "quite another text")]
    assert similar.keep_one_similar(docs.limit(0)).collect() == []


def test_fingerprints_and_shards_of_similar_sets():
    r = np.random.default_rng(3)
    lost = beyond = pairs = 0
    for n in (60, 120, 300, 1000):
        for _ in range(150):
            a = r.integers(0, 1 << 63, n).astype(np.uint64)
            b = np.concatenate([a[n // 9 :], r.integers(0, 1 << 63, n // 9).astype(np.uint64)])
            pairs += 1
            lost += not (similar.shard_keys(a) == similar.shard_keys(b)).any()
            beyond += (similar.bit_majority(a) ^ similar.bit_majority(b)).bit_count() > similar.RADIUS
    assert lost <= 3 and beyond <= 3, (lost, beyond, pairs)


def test_class_links_join_what_is_near():
    fps = [0b0, 0b1, 0b11 << 40, (1 << 64) - 1]
    assert similar.class_links([5, 6, 7, 8], fps, [5, 6, 7, 8], [True] * 4, 3) in ([(5, 6), (5, 7)], [(5, 6), (6, 7)])
    assert similar.class_links([5, 6, 7, 8], fps, [5, 5, 7, 8], [False, False, True, True], 3) == [(5, 7)]
    assert similar.class_links([5, 6], [4, 4], [5, 6], [False, True], 0) == [(5, 6)]


def test_large_shards_are_dealt_to_several_trees(spark):
    r = random.Random(9)
    base = [f"w{i}" for i in range(200)]
    rows = [(k, " ".join(base[:k] + ["new"] + base[k + 1 :])) for k in range(60)]
    rows += [(100 + k, " ".join([f"x{r.randrange(3000)}" for _ in range(80)])) for k in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: x.root for x in similar.similar_classes(docs, most=7).collect()}
    assert len({got[k] for k in range(60)}) == 1 and len(set(got.values())) == 11
