"""Who is taken: certain copies by class of size, then every document that still fits, in order of odds ratios."""

import collections
import math
import random

import pytest

from omicsgraph.llm import mixing


def brute_rates(sizes, target, cap=3.0):
    """Rate of each class of a source: caps are given to the smallest classes until no other is above."""
    words = collections.Counter()
    for n in sizes:
        words[n.bit_length()] += n
    weight = {k: 2.0 ** (-mixing.SLOPE * k) for k in words}
    capped = set()
    while True:
        free = sum(weight[k] * words[k] for k in words if k not in capped)
        c = (target - cap * sum(words[k] for k in capped)) / free if free else math.inf
        over = {k for k in words if k not in capped and words[k] and c * weight[k] > cap}
        if not over:
            return {k: cap if k in capped else (max(0.0, c * weight[k]) if words[k] else 0.0) for k in words}
        capped.add(min(over))


@pytest.mark.parametrize("finish", [0, 300, 200_000])
def test_what_fits_is_taken(spark, monkeypatch, finish):
    """In rounds of cuts, in one pass, and with sources that change from one to the other."""
    monkeypatch.setattr(mixing, "FINISH", finish)
    rng = random.Random(4)
    rows = []
    for source, small, large in (("a", 3000, 12), ("b", 1500, 3), ("c", 40, 0), (None, 500, 2)):
        rows += [(len(rows) + k, "w " * rng.randint(0, 6), source) for k in range(small)]
        rows += [(len(rows) + k, "w " * rng.randint(2000, 9000), source) for k in range(large)]
    rows += [r for r in rows if r[0] % 50 == 0] + [(9000, None, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    us = {(r.doc_id, r.text): r.u for r in docs.select("doc_id", "text", mixing.uniform(1).alias("u")).collect()}
    times = collections.Counter(rows)
    got = mixing.mix(docs).collect()
    copies = {(r.doc_id, r.source): r.copies for r in got}
    plan = {r.source: r.target for r in got}
    for source, target in plan.items():
        own = [r for r in rows if r[2] == source]
        rate = brute_rates([len((t or "").split()) for _, t, _ in own], target)
        assert len({round(x, 6) for k, x in rate.items() if k}) > 1 or target >= 3 * sum(len((t or "").split()) for _, t, _ in own) - 1e-6
        rest, units = target, []
        for (i, t, s), n in times.items():
            if s == source:
                size = len((t or "").split())
                whole = math.floor(rate[size.bit_length()] + 1e-12)
                p, u = rate[size.bit_length()] - whole, us[i, t]
                rest -= whole * size * n
                if p > 1e-9 and size:
                    units.append((u / (1 - u) / (p / (1 - p)), i, size * n, whole))
                elif size:
                    assert copies[i, source] == whole
        left = []
        for _, i, words, whole in sorted(units):
            take = words <= rest + 1e-6
            rest -= words if take else 0
            assert copies[i, source] == whole + take
            left += [] if take else [words]
        assert not left or rest < min(left)
    out = collections.Counter(r.doc_id for r in mixing.mixed_documents(docs).collect())
    want = collections.Counter()
    for r in got:
        want[r.doc_id] += r.copies
    assert out == +want


def test_short_documents_are_wanted_more_often(spark):
    rows = [(k, "w " * (4 if k % 2 else 500), "ab"[k % 3 == 0]) for k in range(6000)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    share = lambda size: sum(r.copies for r in got if r.size == size and r.source == "a") / sum(r.size == size and r.source == "a" for r in got)
    assert share(4) > 1.5 * share(500)
