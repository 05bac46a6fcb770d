"""Quality rules per document and per host, in DataFrame operations only.

Host verdicts: the failures of each rule are summed by host; their rates are shrunk with a beta prior fitted to all
hosts by moments; a host with a shrunk rate above `max_rate` fails as a whole, and its documents with it.

Null texts have no words. Null is a host of its own. Repeated rows stay. Documents without words fail the length rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, materialize

#: White space, symbols and window of the rules.
SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 5
#: Host tables of up to this many failing hosts are broadcast.
MAX_HOSTS = 100_000
RULES = ("short", "repeats", "symbols", "dup_lines")


def _let(value: Column, use) -> Column:
    """use(value), with value evaluated once."""
    return F.transform(F.array(value), use)[0]


def repeated_words(words: Column, n: int = WINDOW) -> Column:
    """How many words lie in windows of n words found twice or more.

    Windows are compared by the hash of their words' hashes. Only where hashes repeat are (hash, place) pairs sorted;
    the places of equal neighbours, in order, give the words that they cover.
    """

    def covered(pairs: Column) -> Column:
        same = lambda k: (F.get(pairs, k)["h"].eqNullSafe(F.get(pairs, k - 1)["h"])) | (F.get(pairs, k)["h"].eqNullSafe(F.get(pairs, k + 1)["h"]))
        marked = F.transform(F.filter(F.sequence(F.lit(0), F.size(pairs) - 1), same), lambda k: F.get(pairs, k)["p"])
        start = F.struct(F.lit(-n).alias("last"), F.lit(0).alias("sum"))
        add = lambda acc, p: F.struct(p.alias("last"), (acc["sum"] + F.least(F.lit(n), p - acc["last"])).alias("sum"))
        return F.aggregate(F.sort_array(marked), start, add, lambda acc: acc["sum"])

    def count(windows: Column) -> Column:
        pairs = F.sort_array(F.transform(windows, lambda h, p: F.struct(h.alias("h"), p.alias("p"))))
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(_let(pairs, covered))

    def windows(hashes: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(hashes) - n), lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(n)]))

    some = _let(_let(F.transform(words, lambda w: F.xxhash64(w)), windows), count)
    return F.when(F.size(words) > n, some).otherwise(0).cast("long")


def document_rules(docs: DataFrame, host: str = "source") -> DataFrame:
    """doc_id, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and a flag for each failed rule."""
    text = docs.select("doc_id", F.col(host).alias("host"), F.coalesce("text", F.lit("")).alias("text"))
    split = text.withColumn("words", F.array_remove(F.split("text", SPACE), "")).withColumn("lines", F.filter(F.split("text", "\n"), lambda x: F.length(F.btrim(x, F.lit(" \t\n\x0b\x0c\r"))) > 0))
    counted = split.select(
        "doc_id",
        "host",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
    )
    return counted.select(
        "*",
        (F.col("n_words") < 10).alias("short"),
        (100 * F.col("n_repeat_words") > 20 * F.col("n_words")).alias("repeats"),
        (10 * F.col("n_symbols") > 3 * F.col("word_chars")).alias("symbols"),
        (3 * F.col("n_dup_lines") > F.col("n_words")).alias("dup_lines"),
    )


def host_verdicts(rules: DataFrame, max_rate: float = 0.5, strength: float = 10.0) -> DataFrame:
    """One row per host: host, n, for each rule its shrunk failure rate, and failed.

    The prior of a rule has the mean and the precision of the hosts' rates; where these don't vary, or too much for
    a beta distribution, the precision is `strength`.
    """
    hosts = rules.groupBy("host").agg(F.count("*").alias("n"), *[F.count_if(r).alias(r) for r in RULES])
    rate = lambda r: F.col(r) / F.col("n")
    prior = hosts.agg(*[x for r in RULES for x in (F.avg(rate(r)).alias(f"mean_{r}"), F.var_samp(rate(r)).alias(f"var_{r}"))])
    both = hosts.crossJoin(F.broadcast(prior))  # the prior is one row

    def shrunk(r: str) -> Column:
        mean, var = F.col(f"mean_{r}"), F.col(f"var_{r}")
        fitted = F.when(var > 0, mean * (1 - mean) / var - 1)
        weight = F.when(fitted > 0, fitted).otherwise(strength)
        return ((F.col(r) + mean * weight) / (F.col("n") + weight)).alias(f"rate_{r}")

    rated = both.select("host", "n", *[shrunk(r) for r in RULES])
    return rated.withColumn("failed", F.greatest(*[F.col(f"rate_{r}") for r in RULES]) > max_rate)


def judge(docs: DataFrame, host: str = "source", max_rate: float = 0.5) -> DataFrame:
    """document_rules of every document with base_failed, host_failed and kept.

    docs needs doc_id, text and the host column; other columns are ignored; an empty table gives an empty one.
    """
    rules = materialize(document_rules(docs, host), "rules")
    failed = host_verdicts(rules, max_rate).where("failed").select(F.struct("host").alias("bad"))
    failed = broadcast_if_small(materialize(failed, "hosts"), MAX_HOSTS)
    joined = rules.join(failed, rules["host"].eqNullSafe(failed["bad.host"]), "left")
    base = F.col("short") | F.col("repeats")
    return joined.withColumn("base_failed", base).withColumn("host_failed", F.col("bad").isNotNull()).withColumn("kept", ~base & F.col("bad").isNull()).drop("bad")
