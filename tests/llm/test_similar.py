"""The near-duplicate stage of the pipeline against planted copies and all pairs."""

import random

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from omicsgraph.llm import similar


def shingles(t, words=5):
    parts = (t or "").lower().split()
    return {tuple(parts[k : k + words]) for k in range(max(1, len(parts) - words + 1))} if parts else set()


def brute_kept(rows):
    """The smallest doc_id of each component of rows (doc_id, text)."""
    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            met = len(sets[a] & sets[b])
            if sets[a] == sets[b] or 5 * met >= 4 * (len(sets[a]) + len(sets[b]) - met):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return [rows[k][0] for k in range(len(rows)) if find(k) == k]


def planted():
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(5000)}"
    boilerplate = [word() for _ in range(120)]
    rows = []
    for size in (12, 40, 300, 1000):
        for of in range(30):
            text = [word() for _ in range(size)]
            if of % 3 == 0:
                text[: min(120, size // 3)] = boilerplate[: size // 3]
            rows.append(" ".join(text))
            for changed in (size // 300, size // 100, size // 50, size // 40, size // 30):
                copy = list(text)
                for k in rng.sample(range(size), changed):
                    copy[k] = word()
                rows.append(" ".join(copy))
    rng.shuffle(rows)
    return list(enumerate([*rows, "", None, "two words", "Two  WORDS"]))


def test_near_copies_go(spark, monkeypatch):
    rows = planted()
    docs = spark.createDataFrame([(k, t, "en", "a", len(t or "")) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    want = brute_kept(rows)
    assert len(want) < len(rows) / 2
    out = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == want
    monkeypatch.setattr(similar, "SAMPLE", 1)  # shingles have another order then
    assert len(similar.common_shingles(docs)[0]) > 50
    assert sorted(r.doc_id for r in similar.drop_similar(docs).collect()) == want


def test_bitmaps_exclude_no_similar_pair():
    rng = random.Random(5)
    for size in (1, 5, 64, 65, 700):
        for _ in range(60):
            a = {rng.getrandbits(64) for _ in range(size)}
            b = set(rng.sample(sorted(a), rng.randint(0, size))) | {rng.getrandbits(64) for _ in range(rng.randint(0, size))}
            x, y = (np.array(sorted(s), np.uint64) for s in (a, b))
            assert similar.most_shared(similar.bitmap(x), similar.bitmap(y), len(a), len(b)) >= len(a & b)
    far = [np.unique(np.array([rng.getrandbits(64) for _ in range(300)], np.uint64)) for _ in range(2)]
    assert similar.most_shared(*map(similar.bitmap, far), 300, 300) < 260  # unrelated sets are told apart


def test_clashing_columns(spark):
    """Extra columns with names that the stage uses inside stay as they are."""
    names = ["node", "n", "fp", "bits", "first", "a", "b", "root", "class", "shingle", "keep"]
    rows = [(k, t, *[f"{c}{k}" for c in names]) for k, t in planted()[:60]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{c} string" for c in names))
    out = similar.drop_similar(docs)
    assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == brute_kept([r[:2] for r in rows])
    assert all(r.node == f"node{r.doc_id}" for r in out.collect())


def test_bitmaps_exclude_pairs_below_the_similarity():
    rng = random.Random(6)
    for size in (60, 200, 900):
        excluded = 0
        for _ in range(50):
            a = [rng.getrandbits(64) for _ in range(size)]
            b = a[: int(0.8 * size)] + [rng.getrandbits(64) for _ in range(size - int(0.8 * size))]  # a similarity of 2/3
            x, y = (np.array(sorted(s), np.uint64) for s in (a, b))
            excluded += 9 * similar.most_shared(similar.bitmap(x), similar.bitmap(y), size, size) < 4 * 2 * size
        assert excluded >= 48


def near_family(n, rng):
    """Copies of one text of 150 words with one to four words changed: pairs are just above or below the similarity."""
    base = [f"w{k}" for k in range(150)]
    rows = []
    for _ in range(n):
        copy = list(base)
        for k in rng.sample(range(150), rng.choice((1, 2, 2, 3, 3, 4))):
            copy[k] = f"x{rng.randrange(10**9)}"
        rows.append(" ".join(copy))
    return list(enumerate(rows))


@pytest.mark.parametrize("cell", [None, 4096])
def test_pairs_of_a_large_group_are_not_listed(spark, monkeypatch, cell):
    rows = near_family(600, random.Random(7))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    written, write = [], similar.materialize
    monkeypatch.setattr(similar, "ROUNDS", 0)  # most nodes are left to the last step
    if cell:
        monkeypatch.setattr(similar, "CELL", cell)

    def counted(df, tag):
        out = write(df, tag)
        written.append((out.count(), tag))
        return out

    monkeypatch.setattr(similar, "materialize", counted)
    assert sorted(r.doc_id for r in similar.drop_similar(docs).collect()) == brute_kept(rows)
    shared = next(n for n, tag in written if tag == "shared")
    assert len(rows) < shared < 40 * len(rows)
    assert max(n for n, tag in written if cell is None or tag != "cells") <= shared


def test_forest_connects_what_is_similar():
    rng = random.Random(8)
    for _ in range(40):
        base = [rng.getrandbits(63) for _ in range(60)]
        sets = []
        for _ in range(30):
            gone = rng.randint(0, 9)
            sets.append(np.unique(np.array(rng.sample(base, 60 - gone) + [rng.getrandbits(63) for _ in range(gone)], np.int64)))
        label = np.array([rng.randrange(rng.choice((3, 30))) for _ in sets])
        near = [(a, b) for a in range(30) for b in range(a) if 5 * (m := len(np.intersect1d(sets[a], sets[b]))) >= 4 * (len(sets[a]) + len(sets[b]) - m)]
        found = similar.forest(sets, label)
        assert {(max(p), min(p)) for p in found} <= set(near) and len(found) < 30
        same = [(a, b) for a in range(30) for b in range(a) if label[a] == label[b]]
        assert roots(30, found + same) == roots(30, near + same)


def roots(n, links):
    root = list(range(n))
    for a, b in links:
        root = [min(root[a], root[b]) if r in (root[a], root[b]) else r for r in root]
    return root


def test_long_sets_are_told_apart_by_bitmaps():
    rng = random.Random(10)
    sets = [np.unique(np.array([rng.getrandbits(64) for _ in range(900)], np.uint64)) for _ in range(4)]
    sets.append(np.unique(np.concatenate([sets[0][30:], sets[1][:30]])))  # similar to the first
    table = pa.table({"cell": [1] * 5, "node": list(range(5)), "n": [len(x) for x in sets], "root": list(range(5)), "bits": [similar.bitmap(x) for x in sets]})
    assert similar._told_apart(table).column("node").to_pylist() == [0, 4]


def test_parities_exclude_no_similar_pair():
    rng = random.Random(9)
    for size in (1, 40, 500, 3000):
        for _ in range(30):
            a = {rng.getrandbits(64) for _ in range(size)}
            b = set(rng.sample(sorted(a), rng.randint(0, size))) | {rng.getrandbits(64) for _ in range(rng.randint(0, size))}
            x, y = (similar.parities(np.array(sorted(s), np.uint64)).view(np.uint64) for s in (a, b))
            assert len(x) == similar.ODD_BITS // 64 and np.bitwise_count(x ^ y).sum() <= len(a ^ b)
