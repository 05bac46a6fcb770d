"""Mixing sources to target weights with Pareto order sampling.

A document of a source is wanted rate = c * 2^(-class * SLOPE) times, where the class is the number of bits of its size:
short documents are wanted more often than long ones, so that a few long ones don't fill a source's share. c makes the
source's rates times sizes add up to its target, with no rate above the cap. The whole part of a rate gives certain
copies; its fraction p is the document's inclusion probability for one more. Documents are ranked by the odds ratio
(U/(1-U)) / (p/(1-p)), U uniform from a hash, and taken in that order, each that still fits into what certain copies
leave of the target: rounds of cuts, where a cut is the place at which the running sum exceeds the gap, and the next
round goes on after it with the documents that fit the smaller gap. A cut is found on sums per source and bucket of the
ranks, 12 bits at a time, so no task holds a whole source. Sources whose documents that may still fit are FINISH at most go
through all their rounds in one task; documents are then compared with the rounds of their source.

Null texts have size 0. Null is a source of its own, the last one. Rows that repeat, or that share id and text, share
their U and are taken or left together; of documents with equal ranks too all or none are taken. An empty table gives an
empty one. Columns other than doc_id, text and source are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranking import number_rows
from .common import broadcast_if_small, materialize

#: What counts as a word.
WORD = r"[^\x20\x09-\x0D]+"
#: Source tables of up to this many rows are broadcast.
MAX_SOURCES = 100_000
#: How fast rates fall with size: by 2^-SLOPE where sizes double.
SLOPE = 0.25
#: Ranks are logarithms of odds ratios in so many bits: STEPS to 1, from -FLOOR on.
RANK_BITS, STEPS, FLOOR = 53, 2**44, 256
BITS, LEVELS = 12, 2
#: Ranks of a source that one task goes through (some 16 bytes each).
FINISH = 200_000


def uniform(seed: int) -> Column:
    """The document's U, above 0 and below 1."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id"), F.coalesce(F.col("text"), F.lit(""))), 12)
    return (bits + 0.5) / 2.0**52


def rank(u: Column, p: Column) -> Column:
    """The odds ratio's place in order, as a whole number; null where p is 0. u and p are above 0 and below 1."""
    odds = F.ln(u / (1 - u)) - F.ln(p / (1 - p))
    return F.when(p > 0, F.floor((odds + FLOOR) * STEPS).cast("long"))


def size_class(size: Column) -> Column:
    """The bits of the size."""
    return F.when(size > 0, F.length(F.bin(size))).otherwise(0)


def targets(sources: DataFrame, cap: float = 3.0, cycle: int = 3) -> DataFrame:
    """(source, source_size, target): shares by weight 1..cycle in order of source, none above cap times its size.

    What is above is shared out again by weight until none is. Sources are numbered by ranges and the common level is
    found in rounds of sums, so no task holds them all.
    """
    numbered = number_rows(sources, [], [F.col("source").asc_nulls_last()], "number")
    weighed = materialize(numbered.withColumn("weight", (F.col("number") - 1) % cycle + 1).withColumn("most", cap * F.col("source_size")), "weighed")
    total = weighed.agg(F.sum("source_size")).first()[0] or 0
    level, over = float("-inf"), -1
    while True:
        capped = F.col("most") < level * F.col("weight")
        row = weighed.agg(F.count_if(capped), F.sum(F.when(capped, F.col("most"))), F.sum(F.when(~capped, F.col("weight")))).first()
        if row[0] == over or not row[2]:
            break
        over, level = row[0], (total - (row[1] or 0.0)) / row[2]
    return weighed.select("source", "source_size", F.least(F.col("most"), F.lit(level) * F.col("weight")).alias("target"))


def rates(classes: DataFrame, plan: DataFrame, cap: float = 3.0) -> DataFrame:
    """(source, class, source_size, target, whole, p) of classes (source, class, words), each source at its target."""
    named = plan.withColumnRenamed("source", "s")
    rows = classes.join(named, classes["source"].eqNullSafe(named["s"])).drop("s").withColumn("w", F.pow(F.lit(2.0), -SLOPE * F.col("class")))
    own, upto = Window.partitionBy("source"), Window.partitionBy("source").orderBy("class")  # some 60 classes at most
    before = F.sum("words").over(upto) - F.col("words")
    weight = F.sum(F.col("w") * F.col("words"))
    rest = weight.over(own) - weight.over(upto) + F.col("w") * F.col("words")
    rows = rows.withColumn("c", F.when(rest > 0, (F.col("target") - cap * before) / rest))
    # the classes before the first that isn't at the cap are
    rows = rows.withColumn("c", F.coalesce(F.min(F.when(F.col("c") * F.col("w") <= cap, F.struct("class", "c"))).over(own)["c"], F.lit(float("inf"))))
    rate = F.when(F.col("words") > 0, F.least(F.lit(cap), F.greatest(F.lit(0.0), F.col("c") * F.col("w")))).otherwise(0.0)
    whole = F.floor(rate + 1e-12)
    return rows.select("source", "class", "source_size", "target", whole.alias("whole"), F.greatest(F.lit(0.0), rate - whole).alias("p"), (whole * F.col("words")).alias("certain"))


def _with(rows: DataFrame, plan: DataFrame, *keys: str, few: bool | None = None) -> DataFrame:
    """rows with the columns of their source (and class). few: whether the plan may be broadcast; None: it is counted."""
    plan = plan.withColumnsRenamed({k: f"plan_{k}" for k in keys})
    plan = broadcast_if_small(plan, MAX_SOURCES) if few is None else F.broadcast(plan) if few else plan
    same = [rows[k].eqNullSafe(plan[f"plan_{k}"]) for k in keys]
    return rows.join(plan, same).drop(*[f"plan_{k}" for k in keys])


def word_count() -> Column:
    return F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")


def next_cut(units: DataFrame, left: DataFrame, few: bool) -> DataFrame:
    """A round of the sources that have units: (source, after, most, cut, gap).

    left: (source, cut, gap), where the round before ended; these become after and most. The new cut is the last rank up
    to which the words of the units fit into the gap, and the new gap what is left of it. One job: what a level finds is
    carried to the next, so each reads the units once.
    """
    carried = lambda *columns: [F.first(c).alias(c) for c in columns]
    plan = left.select("source", F.col("cut").alias("after"), F.col("gap").alias("most"), F.col("gap").alias("rest"), F.lit(0).cast("long").alias("prefix"))
    for level in range(1, LEVELS + 1):
        low = RANK_BITS - BITS * level
        rows = _with(units, plan, "source", few=few).where(F.shiftright("rank", low + BITS) == F.col("prefix"))
        sums = rows.groupBy("source", F.shiftright("rank", low).alias("bucket")).agg(F.sum("words").alias("words"), *carried("after", "most", "rest"))
        sums = sums.withColumn("upto", F.sum("words").over(Window.partitionBy("source").orderBy("bucket")))
        # the first bucket that fills the rest; if sums fall short, the last one
        bucket = F.struct("bucket", "upto", "words")
        picked = F.coalesce(F.min(F.when(F.col("upto") >= F.col("rest"), bucket)), F.max(bucket))
        found = sums.groupBy("source").agg(picked.alias("b"), *carried("after", "most", "rest"))
        plan = found.select("source", "after", "most", (F.col("rest") - F.col("b.upto") + F.col("b.words")).alias("rest"), F.col("b.bucket").alias("prefix"))
    low = RANK_BITS - BITS * LEVELS
    rows = _with(units, plan, "source", few=few).where(F.shiftright("rank", low) == F.col("prefix"))
    rows = rows.withColumn("upto", F.sum("words").over(Window.partitionBy("source").orderBy("rank")))
    last = F.max(F.when(F.col("upto") <= F.col("rest"), F.struct("rank", "upto")))
    found = rows.groupBy("source").agg(last.alias("last"), *carried("after", "most", "rest", "prefix"))
    below = F.shiftleft("prefix", low) - 1
    return materialize(found.select("source", "after", "most", F.coalesce("last.rank", below).alias("cut"), (F.col("rest") - F.coalesce("last.upto", F.lit(0))).alias("gap")), "cuts")


def _finish(key: tuple, units: pd.DataFrame) -> pd.DataFrame:
    """All rounds of a source from its few units (source, rank, words, cut, gap) in order of rank."""
    units = units.sort_values("rank")
    ranks, words = units["rank"].to_numpy(np.int64), units["words"].to_numpy(np.int64)
    after, gap, at, out = int(units["cut"].iloc[0]), float(units["gap"].iloc[0]), 0, []
    while True:
        fit = at + np.flatnonzero(words[at:] <= gap)
        if not len(fit):
            break
        sums = np.cumsum(words[fit])
        n = int(np.searchsorted(sums, gap, side="right"))  # one at least
        cut = int(ranks[fit[n - 1]])
        out.append((after, cut, gap))
        after, gap, at = cut, gap - float(sums[n - 1]), int(fit[n - 1]) + 1
    rounds = pd.DataFrame(out, columns=["after", "cut", "most"])
    rounds.insert(0, "source", units["source"].iloc[0])
    return rounds


def mixing_plan(docs: DataFrame, seed: int = 1) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(doc_id, source, size, u) of the documents; of each source and class source_size, target, whole copies, p and the
    rounds (after, cut, most) of the sample; (source, rank, words) of the ranks with several rows."""
    sized = docs.select(F.col("doc_id").cast("long"), "source", word_count().alias("size"), uniform(seed).alias("u"))
    sized = materialize(sized, "sized")
    classes = materialize(sized.groupBy("source", size_class(F.col("size")).alias("class")).agg(F.sum("size").alias("words")), "classes")
    plan = materialize(rates(classes, targets(classes.groupBy("source").agg(F.sum("words").alias("source_size")))), "plan")
    ranked = _with(sized.withColumn("class", size_class(F.col("size"))), plan.select("source", "class", "p"), "source", "class")
    units = materialize(ranked.select("source", rank(F.col("u"), F.col("p")).alias("rank"), "size").where("rank is not null").groupBy("source", "rank").agg(F.sum("size").alias("words"), F.count("*").alias("n")), "units")
    repeats = units.where("n > 1").select("source", "rank", "words")
    left = plan.groupBy("source").agg((F.first("target") - F.sum("certain")).alias("gap")).select("source", F.lit(-1).cast("long").alias("cut"), "gap")
    left = materialize(left, "left")
    few = left.limit(MAX_SOURCES + 1).count() <= MAX_SOURCES
    rounds = left.limit(0).select("source", F.col("cut").alias("after"), "cut", F.col("gap").alias("most"))
    schema = "source string, after long, cut long, most double"
    while True:  # each round takes a document of each of its sources at least
        units = _with(units.select("source", "rank", "words"), left, "source", few=few).where("rank > cut and words > 0 and words <= gap")
        units = materialize(units.select("source", "rank", "words", "cut", "gap"), "units")
        sizes = materialize(units.groupBy("source").agg(F.count("*").alias("n")), "sizes")
        short = _with(units, sizes.where(F.col("n") <= FINISH).select("source"), "source", few=few)
        rounds = rounds.union(short.groupBy("source").applyInPandas(_finish, schema))
        long = sizes.where(F.col("n") > FINISH).select("source")
        if long.isEmpty():
            break
        units = materialize(_with(units.select("source", "rank", "words"), long, "source", few=few), "units")
        new = next_cut(units, _with(left, long, "source", few=few), few)
        rounds = rounds.union(new.select("source", "after", "cut", "most"))
        left = new.select("source", "cut", "gap")
    of_source = rounds.groupBy(F.col("source").alias("s")).agg(F.sort_array(F.collect_list(F.struct("after", "cut", "most"))).alias("rounds"))  # as many as rounds
    plan = plan.join(of_source, plan["source"].eqNullSafe(of_source["s"]), "left").drop("s", "certain")
    return sized, materialize(plan, "plan"), repeats


def _with_copies(rows: DataFrame, repeats: DataFrame, plan: str = "") -> DataFrame:
    """rows (__u, __size, source, the plan's columns) with __copies: how many copies of a row are taken."""
    of = lambda c: F.col(plan + c)
    named = broadcast_if_small(repeats.select(F.col("source").alias("__s"), F.col("rank").alias("__r"), F.col("words").alias("__all")), MAX_SOURCES)
    ranked = rows.withColumn("__rank", rank(F.col("__u"), of("p")))
    joined = ranked.join(named, (ranked["__rank"] == named["__r"]) & ranked["source"].eqNullSafe(named["__s"]), "left")
    words = F.coalesce("__all", "__size")
    fits = lambda r: (F.col("__rank") > r["after"]) & (F.col("__rank") <= r["cut"]) & (words > 0) & (words <= r["most"])
    copies = of("whole") + F.coalesce(F.exists(of("rounds"), fits), F.lit(False)).cast("long")
    return joined.withColumn("__copies", copies).drop("__s", "__r", "__all", "__rank")


def mix(docs: DataFrame, seed: int = 1) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) of every document."""
    sized, plan, repeats = mixing_plan(docs, seed)
    rows = _with(sized.withColumn("class", size_class(F.col("size"))), plan, "source", "class")
    out = _with_copies(rows.withColumn("__u", F.col("u")).withColumn("__size", F.col("size")), repeats)
    return out.select("doc_id", "source", "size", "source_size", "target", F.col("__copies").alias("copies"), (F.col("__copies") * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, seed: int = 1) -> DataFrame:
    """The documents of the mix, each as often as it is taken, with the columns of docs."""
    _, plan, repeats = mixing_plan(docs, seed)
    named = broadcast_if_small(plan.select(F.struct(*plan.columns).alias("__plan")), MAX_SOURCES)
    rows = docs.withColumn("__u", uniform(seed)).withColumn("__size", word_count()).withColumn("__class", size_class(F.col("__size")))
    rows = rows.join(named, rows["source"].eqNullSafe(named["__plan.source"]) & (rows["__class"] == named["__plan.class"]))
    rows = _with_copies(rows, repeats, "__plan.").withColumn("__n", F.col("__copies").cast("int"))
    return rows.where("__n > 0").withColumn("__copy", F.explode(F.array_repeat(F.lit(0), F.col("__n")))).select(*docs.columns)
