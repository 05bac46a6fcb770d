"""SimHash near-duplicates, found with BK-trees.

Documents with equal fingerprints are one node. Two fingerprints that differ in at most 2 of 64 bits agree in at least one
of three blocks of bits, so each is dealt to three shards, by the first bits of each block: as many bits as give shards of
about SHARD fingerprints, whatever the number of all. A shard is a BK-tree, whose children are keyed by the Hamming distance
to their parent; its members search it and follow only the edges within the radius. Trees stay in the tasks that build
them: to broadcast them all would send every fingerprint through the driver. Shards that are still large are dealt further by
the distance to a root, which is a tree's top level made on Spark, or, where that hardly divides them, by pairs of
parts. Each shard gives a spanning forest of its links (stars), which keeps every connection, and stars are joined to
components by rounds of pointing neighbours at smaller nodes.

Null texts have no words, hence fingerprint zero. Null ids never name a component unless it has no other id.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, by_bytes, doc_key, map_arrow, materialize

RADIUS = 2
#: Bits of the blocks: RADIUS + 1 of them, so near fingerprints agree in one.
BLOCKS = (22, 21, 21)
#: Fingerprints of a shard, about, where the blocks' bits suffice.
SHARD = 2048
SEED = 42
SLICE = 1 << 20
#: Fingerprints of a tree at most, and keys of larger groups that are broadcast.
MAX_TREE, MAX_LARGE = 20_000, 500_000
#: Nodes with links up to which rounds of components broadcast them.
MAX_POINTED = 100_000


def shingle_hashes(text: str | None, words: int = 3) -> list[int]:
    """XXH64 of the shingles, repeats included."""
    parts = (text or "").encode().lower().split()  # of bytes: A-Z only, and ASCII white space
    if len(parts) <= words:
        return [xxhash.xxh64_intdigest(b" ".join(parts), SEED)] if parts else []
    digest = xxhash.xxh64_intdigest
    return [digest(b" ".join(p), SEED) for p in zip(*(parts[k:] for k in range(words)))]


def fingerprints_of(texts: list[str | None], words: int = 3) -> np.ndarray:
    """A bit is set if it is set in over half of the text's shingle hashes."""
    hashes = [shingle_hashes(t, words) for t in texts]
    counts = np.array([len(h) for h in hashes], np.int64)
    out = np.zeros(len(texts), np.uint64)
    if not counts.sum():
        return out
    flat = np.fromiter((x for h in hashes for x in h), np.uint64, int(counts.sum()))
    full = np.flatnonzero(counts)
    at = np.cumsum(np.r_[0, counts[full][:-1]])
    for bit in range(64):
        ones = np.add.reduceat(((flat >> np.uint64(bit)) & np.uint64(1)).astype(np.int64), at)
        out[full] |= (2 * ones > counts[full]).astype(np.uint64) << np.uint64(bit)
    return out


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, text_key, fp long) of every document."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("fp", pa.int64())])

    def run(batches):
        for whole in batches:
            for batch in by_bytes(whole, "text", SLICE):
                fp = fingerprints_of(batch.column(2).to_pylist(), words)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fp.view(np.int64))], schema=schema)

    id_, key = doc_key()
    return map_arrow(docs.select(id_.cast("long").alias("doc_id"), key, "text"), run, "doc_id long, text_key long, fp long")


def shard_keys(fp: Column, n: int) -> Column:
    """The shards of a fingerprint among n: a block's number and its first bits."""
    bits = max(0, (max(1, n // SHARD) - 1).bit_length())
    starts = [sum(BLOCKS[:k]) for k in range(len(BLOCKS))]
    cut = [F.shiftrightunsigned(fp, start).bitwiseAND(F.lit((1 << min(bits, size)) - 1)) for start, size in zip(starts, BLOCKS)]
    return F.array(*[c * len(BLOCKS) + k for k, c in enumerate(cut if bits else cut[:1])])


class BKTree:
    """Distinct fingerprints; children are keyed by their Hamming distance to the parent."""

    def __init__(self, values: np.ndarray):
        self.values = values.astype(np.uint64)
        ints = self.values.tolist()
        children: list[dict[int, int]] = [{} for _ in ints]
        for k in range(1, len(ints)):
            node = 0
            while True:
                d = (ints[node] ^ ints[k]).bit_count()
                below = children[node].get(d)
                if below is None:
                    children[node][d] = k
                    break
                node = below
        edges = sorted((node * 65 + d, child) for node, of in enumerate(children) for d, child in of.items())
        self.keys = np.array([e[0] for e in edges], np.int64)
        self.child = np.array([e[1] for e in edges], np.int64)

    def links(self, radius: int, block: int = 4096) -> tuple[np.ndarray, np.ndarray]:
        """All pairs (a, b) of places with a > b within the radius; all members search at once, level by level.

        `visited` counts the nodes that searches have met.
        """
        out_a, out_b, self.visited = [], [], 0
        for start in range(0, len(self.values), block):
            query = np.arange(start, min(start + block, len(self.values)))
            node = np.zeros(len(query), np.int64)
            while len(query):
                self.visited += len(query)
                d = np.bitwise_count(self.values[query] ^ self.values[node]).astype(np.int64)
                near = (d <= radius) & (query > node)
                out_a.append(query[near])
                out_b.append(node[near])
                lo = np.searchsorted(self.keys, node * 65 + np.maximum(d - radius, 0))
                hi = np.searchsorted(self.keys, node * 65 + np.minimum(d + radius, 64), side="right")
                n = hi - lo
                query = np.repeat(query, n)
                node = self.child[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(int(n.sum()))]
        return np.concatenate(out_a), np.concatenate(out_b)


def stars(values: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Links (member, least member) that connect what links within the radius connect, without the lone ones."""
    a, b = BKTree(values).links(radius)
    root = np.arange(len(values))
    while True:  # point both ends of a link at the lower root until nothing changes
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    moved = np.flatnonzero(root != np.arange(len(values)))
    return values[moved], values[root[moved]]


def _search(batches):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    for batch in batches:
        for members in batch.column(0):
            values = members.values.to_numpy(zero_copy_only=False)
            a, b = stars(np.sort(values))
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], schema=schema)


def near_links(fps: DataFrame, most: int | None = None) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp) that connect all within the radius.

    A shard of more than `most` fingerprints is too large for one tree. Its top level is made on Spark: members are dealt
    by their distance to the least one, which is the root, and a new shard holds RADIUS + 1 neighbouring distances, as two
    members within the radius are at distances no further apart. Shards that are still too large are dealt again. Where
    that hardly makes them smaller, members are dealt to parts, and each two parts are a shard.
    """
    most = most or MAX_TREE
    n = fps.count()
    dealt = fps.select(F.explode(shard_keys(F.col("fp"), n)).alias("key"), "fp")
    found, before = [], None
    while True:
        sizes = dealt.groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("root"))
        large = materialize(sizes.where(F.col("n") > most), "large")
        largest = large.agg(F.max("n")).first()[0]
        if largest is None:
            found.append(dealt)
            break
        hot = dealt.join(large, "key")  # counted rows on both sides, so that Spark can split a hot key
        found.append(dealt.join(broadcast_if_small(large.select("key"), MAX_LARGE), "key", "left_anti"))
        if before is not None and largest > 0.7 * before:  # members are all as far from each other
            found.append(_in_parts(hot, most))
            break
        before = largest
        ring = F.bit_count(F.col("fp").bitwiseXOR(F.col("root")))
        rings = F.explode(F.transform(F.sequence(F.lit(0), F.lit(RADIUS)), lambda k: ring - k)).alias("ring")
        dealt = materialize(hot.select("key", "fp", rings).where("ring >= 0").select(F.xxhash64("key", "ring").alias("key"), "fp"), "dealt")
    every = reduce(DataFrame.union, found)
    groups = every.groupBy("key").agg(F.collect_list("fp").alias("members"))
    return map_arrow(groups.where(F.size("members") > 1).select("members"), _search, "a long, b long")


def _in_parts(hot: DataFrame, most: int) -> DataFrame:
    """Shards (key, fp) of at most about `most` members: the members of a large one (key, fp, n) in parts of half that size,
    each two of them together."""
    parts = F.ceil(F.col("n") * 2 / most).cast("int")
    mine = hot.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64(F.lit(7), "fp"), F.col("parts")).cast("int"))
    other = mine.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    low, high = F.least("part", "other"), F.greatest("part", "other")
    return other.select(F.xxhash64("key", low, high).alias("key"), "fp")


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node that has a link; root is the least node reachable.

    Each round points a node's larger neighbours, then its smaller ones, at the least of them; the links shrink to
    stars and never become more. Rounds grow with the logarithm of the longest path, and go on until all links are stars: every
    node has one neighbour, a smaller one, or larger ones only. The driver keeps a record of every task, so few nodes
    (MAX_POINTED) are looked up without dealing the links out anew.
    """
    edges = materialize(links.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("m")).where("v <> m").distinct(), "links")
    while True:
        both = edges.select(F.col("v").alias("u"), F.col("m").alias("w")).union(edges.select(F.col("m").alias("u"), F.col("v").alias("w")))
        least = materialize(both.groupBy("u").agg(F.min("w").alias("low"), F.max("w").alias("high")), "least")
        n, open_ = least.agg(F.count("*"), F.count_if((F.col("low") < F.col("u")) & (F.col("low") < F.col("high")))).first()
        if not open_:
            return least.where("low < u").select(F.col("u").alias("node"), F.col("low").alias("root"))
        few = F.broadcast if n <= MAX_POINTED else lambda df: df
        pointed = few(least.select(F.col("u").alias("m"), F.least("low", "u").alias("to")))
        large = edges.join(pointed, "m").select("v", F.col("to").alias("m"))
        lowest = few(large.groupBy("v").agg(F.min("m").alias("low")))
        small = large.join(lowest, "v").select(F.when(F.col("m") == F.col("low"), F.col("v")).otherwise(F.col("m")).alias("v"), F.col("low").alias("m"))
        edges = materialize(small, "links")


def near_duplicates(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, text_key, fingerprint, component_id, keep) of every document.

    component_id: the smallest doc_id reachable over links. keep: the (no_id, doc_id, text_key) of the component's
    document that stays; rows with both equal count as one document there.
    """
    found = materialize(fingerprints(docs, words), "fingerprints")
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")
    nodes = materialize(found.groupBy("fp").agg(F.min(first).alias("first")), "nodes")
    linked = components(near_links(nodes.select("fp")))
    rooted = nodes.join(linked, nodes["fp"] == linked["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    best = rooted.groupBy("root").agg(F.min("first").alias("keep"))
    of_fp = rooted.join(best, "root").select("fp", "keep")
    return found.join(of_fp, "fp").select("doc_id", "text_key", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("keep.doc_id").alias("component_id"), "keep")


def drop_near_duplicates(docs: DataFrame, words: int = 3) -> DataFrame:
    """One document of each component: the one with the smallest doc_id (of equal ids, the smallest hash of text)."""
    return keep_only(docs, near_duplicates(docs, words).select("keep").distinct())


def keep_only(docs: DataFrame, keep: DataFrame) -> DataFrame:
    """The documents named in keep (keep: no_id, doc_id, text_key), each once, with the columns of docs.

    Texts are shuffled once: what they are joined by is also what repeated rows are told by.
    """
    wanted = keep.select(F.col("keep.no_id").alias("__no"), F.coalesce("keep.doc_id", F.lit(0)).alias("__id"), F.col("keep.text_key").alias("__key"))
    id_, key = doc_key()
    keyed = docs.withColumn("__no", id_.isNull()).withColumn("__id", F.coalesce(id_.cast("long"), F.lit(0))).withColumn("__key", key)
    kept = keyed.join(wanted.hint("shuffle_hash"), ["__no", "__id", "__key"], "left_semi")
    return kept.dropDuplicates(["__no", "__id", "__key"]).select(*docs.columns)
