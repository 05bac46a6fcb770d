"""Near copies by exact similarity: documents whose sets of five-word shingles share 4 of 5 (Jaccard).

SimHash fingerprints in BK-trees find most near copies, but no radius of 64-bit fingerprints finds all: at 0.8 they differ in 10
bits on average and in up to 20 now and then. So further candidates come from a prefix filter, which misses none: with all
shingles in one fixed order, two sets that share 4/5 of their union share one of the first n - ceil(4n/5) + 1 of each.
Candidates are first compared by bitmaps of their sets, four to eight bits for each shingle: a bit that only one of them has stands
for a shingle that the other lacks, so what this excludes is certain. The rest is compared as whole sets, made of the texts,
in a join.

Any order gives the same links. Shingles that a sample of the documents shows to be common come last, so that
boilerplate is seldom among the first. Documents with equal sets are one node. In each group of nodes with a common
shingle all are first compared with the smallest one, then, in rounds, with one that a hash picks. Nodes that this leaves in
different components are never listed in pairs, whose number grows with the square of a group. A semi-join first leaves the nodes that
may be similar to some other one, by sizes, places and parities of the sets' bits, which exclude with certainty. Groups of shingles whose least
node (by a hash) is the same are one group. Its nodes go to tasks with their bitmaps, which leave some of the long ones, then with
their whole sets: those tasks count what they share and return only links that connect them, fewer than nodes. Large groups are
dealt to cells of two parts each.

Null texts have no words; documents without words are copies of each other.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, by_bytes, doc_key, forget, map_arrow, materialize
from .simhash import SEED, SLICE, components, keep_only, near_links, shingle_hashes

WORDS = 5
#: Least similarity, as a fraction.
SHARE, OF = 4, 5
#: One in SAMPLE documents is looked at for common shingles: those in COMMON of them, MAX_COMMON at most (this only orders).
SAMPLE, COMMON, MAX_COMMON = 64, 8, 100_000
#: Ratio of sizes of a class; over OF / SHARE, so that similar sets are in the same class or in neighbouring ones.
CLASS = 1.26
#: Rounds in which a shingle's nodes are compared with one that a hash picks.
ROUNDS = 2
#: Bits of a bitmap at least, and for each shingle (to twice that): the more, the fewer pairs are left to whole sets.
LEAST_BITS, BITS_EACH = 64, 4
#: Bits of the parities: sets of some hundred shingles are told apart by them.
ODD_BITS = 512
#: Shingles of a cell, about, and how many a node counts for at least: cells hold some 500 nodes, or fewer long ones.
CELL, LEAST_WEIGHT = 1 << 20, 2048
#: Nodes of candidates, and shingles that several nodes have, are broadcast up to these numbers.
MAX_NODES, MAX_SHINGLES = 1_000_000, 2_000_000


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """The distinct shingle hashes, sorted."""
    return np.unique(np.array(shingle_hashes(text, words), np.uint64))


def node_of(shingles: np.ndarray) -> int:
    """A hash of the set."""
    return xxhash.xxh64_intdigest(shingles.tobytes(), SEED)


def fingerprint(shingles: np.ndarray) -> int:
    """The SimHash of the set, as a signed number."""
    ones = np.unpackbits(shingles.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(shingles), bitorder="little").view("<i8")[0])


def bitmap(shingles: np.ndarray) -> bytes:
    """A bit for each shingle by its last bits, of BITS_EACH times as many as there are shingles or up to twice that."""
    size = max(LEAST_BITS, 1 << max(0, BITS_EACH * len(shingles) - 1).bit_length())
    bits = np.zeros(size, np.uint8)
    bits[(shingles & np.uint64(size - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def most_shared(a: bytes, b: bytes, na: int, nb: int) -> int:
    """No more shingles are in both sets, by their bitmaps; the longer one is folded to the size of the other."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    size = min(len(x), len(y))
    x, y = (np.bitwise_or.reduce(v.reshape(-1, size), axis=0) for v in (x, y))
    return min(na - int(np.bitwise_count(x & ~y).sum()), nb - int(np.bitwise_count(y & ~x).sum()))


def parities(shingles: np.ndarray) -> np.ndarray:
    """A bit for each end that shingles can have: whether an odd number has it, as signed numbers.

    Each shingle that only one of two sets has changes one bit, so the sets differ in at least as many as their bits do.
    """
    odd = np.bincount((shingles & np.uint64(ODD_BITS - 1)).astype(np.int64), minlength=ODD_BITS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def first_of(shingles: np.ndarray, common: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The first shingles in the fixed order; `common` is sorted, `rank` are the places of its members after all others."""
    n = len(shingles)
    if len(common) and n:
        at = np.minimum(np.searchsorted(common, shingles), len(common) - 1)
        shingles = shingles[np.lexsort((shingles, np.where(common[at] == shingles, rank[at], 0)))]
    return shingles[: n + (-SHARE * n) // OF + 1] if n else shingles


def common_shingles(docs: DataFrame, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Common shingles, sorted, and their places in order of how common they are."""

    def run(batches):
        schema = pa.schema([("shingle", pa.int64())])
        for whole in batches:
            for batch in by_bytes(whole, "text", SLICE):
                sets = [shingle_set(t, words) for t in batch.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64))], schema=schema)

    some = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE)) == 0).select("text")
    counts = map_arrow(some, run, "shingle long").groupBy("shingle").count().where(F.col("count") >= COMMON)
    top = [r[0] for r in counts.orderBy(F.col("count").desc(), "shingle").limit(MAX_COMMON).collect()]
    found = np.array(top, np.int64).view(np.uint64)
    order = np.argsort(found)
    return found[order], (len(found) - np.arange(len(found)))[order]


def prefixes(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, text_key, node, n, fp, bits, odd, first) of every document: its set's hash, size, SimHash, bitmap and parities, and its first shingles."""
    shared = docs.sparkSession.sparkContext.broadcast(common_shingles(docs, words))
    schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("node", pa.int64()), ("n", pa.int64()), ("fp", pa.int64()), ("bits", pa.binary()), ("odd", pa.list_(pa.int64())), ("first", pa.list_(pa.int64()))])

    def run(batches):
        common, rank = shared.value
        for whole in batches:
            for batch in by_bytes(whole, "text", SLICE):
                sets = [shingle_set(t, words) for t in batch.column(2).to_pylist()]
                nodes = np.array([node_of(s) for s in sets], np.uint64).view(np.int64)
                first = [first_of(s, common, rank).view(np.int64) for s in sets]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(nodes), pa.array([len(s) for s in sets], pa.int64()), pa.array([fingerprint(s) for s in sets], pa.int64()), pa.array([bitmap(s) for s in sets], pa.binary()), pa.array([parities(s) for s in sets], pa.list_(pa.int64())), pa.array(first, pa.list_(pa.int64()))], schema=schema)

    id_, key = doc_key()
    return map_arrow(docs.select(id_.cast("long").alias("doc_id"), key, "text"), run, "doc_id long, text_key long, node long, n long, fp long, bits binary, odd array<long>, first array<long>")


def may_be_similar(a: str, b: str) -> Column:
    """Whether sets (n, at with these endings) can share enough if their first common shingle has the places `at`."""
    na, nb, at_a, at_b = (F.col(c + x) for c in ("n_", "at_") for x in (a, b))
    fit = OF * F.least(na, nb) >= SHARE * F.greatest(na, nb)
    return fit & ((SHARE + OF) * F.least(na - at_a, nb - at_b) >= SHARE * (na + nb))


def few_odd(a: str, b: str) -> Column:
    """Whether sets (n, odd with these endings) may be similar by their parities."""
    differ = sum((F.bit_count(F.col(f"odd_{a}")[k].bitwiseXOR(F.col(f"odd_{b}")[k])) for k in range(ODD_BITS // 64)), F.lit(0))
    return (OF + SHARE) * differ <= (OF - SHARE) * (F.col(f"n_{a}") + F.col(f"n_{b}"))


def _by_bitmaps(batches):
    """The pairs (a, b) of rows (a, b, n_a, n_b, bits_a, bits_b) that their bitmaps don't exclude."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    for batch in batches:
        na, nb, xa, xb = (batch.column(k).to_pylist() for k in range(2, 6))
        may = pa.array([(SHARE + OF) * most_shared(x, y, n, m) >= SHARE * (n + m) for n, m, x, y in zip(na, nb, xa, xb)], pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(may), batch.column(1).filter(may)], schema=schema)


def _compare(words: int):
    """The pairs (a, b) of rows (a, b, ta, tb) whose texts have similar sets. Sets are kept while the next rows need them."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        sets: dict[int, np.ndarray] = {}
        for whole in batches:
            for batch in by_bytes(whole, "ta", SLICE):
                a, b = (batch.column(k).to_pylist() for k in (0, 1))
                of = {}
                for nodes, texts in ((a, batch.column(2)), (b, batch.column(3))):
                    for k, node in enumerate(nodes):
                        if node not in of:
                            of[node] = sets[node] if node in sets else shingle_set(texts[k].as_py(), words)
                met = np.array([len(np.intersect1d(of[x], of[y], assume_unique=True)) for x, y in zip(a, b)])
                both = np.array([len(of[x]) + len(of[y]) for x, y in zip(a, b)])
                near = pa.array(OF * met >= SHARE * (both - met))
                sets = {node: of[node] for node in b}  # rows come in order of b
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(near), batch.column(1).filter(near)], schema=schema)

    return run, "a long, b long"


def _texts(docs: DataFrame, used: DataFrame) -> DataFrame:
    """(node, text) of nodes (node, first); a row for each that repeats its document."""
    id_, key = doc_key()
    wanted = broadcast_if_small(used.select("node", F.col("first.no_id").alias("__no"), F.coalesce("first.doc_id", F.lit(0)).alias("__id"), F.col("first.text_key").alias("text_key")), MAX_NODES)
    keyed = docs.select(id_.isNull().alias("__no"), F.coalesce(id_.cast("long"), F.lit(0)).alias("__id"), key, "text")
    return keyed.join(wanted, ["__no", "__id", "text_key"]).select("node", "text")


def similar(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, words: int = WORDS) -> DataFrame:
    """The pairs (a, b) of nodes that are similar: by their bitmaps, then by their whole sets, made of the texts of their documents."""
    every = materialize(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "candidates")
    with_a = every.join(nodes.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("bits").alias("bits_a")), "a")
    both = with_a.join(nodes.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("bits").alias("bits_b")), "b")
    pairs = materialize(map_arrow(both.select("a", "b", "n_a", "n_b", "bits_a", "bits_b"), _by_bitmaps, "a long, b long"), "pairs")
    forget(every)
    used = materialize(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes.select("node", "first"), "node"), "used")
    texts = _texts(docs, used)
    left = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a")
    both = left.join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b").select("a", "b", "ta", "tb").sortWithinPartitions("b")
    run, schema = _compare(words)
    out = materialize(map_arrow(both, run, schema).distinct(), "similar")  # rows that repeat have a text each
    forget(pairs, used)
    return out


def by_fingerprint(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes whose SimHash is equal, or connected by links within the radius."""
    of_fp = materialize(nodes.groupBy("fp").agg(F.min("node").alias("least")), "fingerprints")
    equal = nodes.join(of_fp, "fp").select(F.col("node").alias("a"), F.col("least").alias("b"))
    linked = near_links(of_fp.select("fp")).toDF("fp_a", "fp_b").distinct()
    ends = [of_fp.select(F.col("fp").alias(f"fp_{x}"), F.col("least").alias(x)) for x in "ab"]
    return equal.union(linked.join(ends[0], "fp_a").join(ends[1], "fp_b").select("a", "b")).where("a <> b")


def links(docs: DataFrame, nodes: DataFrame, words: int = WORDS) -> DataFrame:
    """Links (a, b) that connect all similar nodes; nodes has (node, n, fp, bits, odd, first_shingles, first)."""
    met = materialize(nodes.select(F.explode("first_shingles").alias("shingle")).groupBy("shingle").count().where("count > 1").select("shingle"), "met")
    listed = nodes.select("node", "n", F.posexplode("first_shingles").alias("at", "shingle"))
    shared = materialize(listed.join(broadcast_if_small(met, MAX_SHINGLES), "shingle"), "shared")
    forget(met)
    lead = materialize(shared.groupBy("shingle").agg(F.min(F.struct("n", "node", "at")).alias("lead")), "leads")  # counted rows, so that a hot one is split
    stars = shared.join(lead, "shingle").select(F.col("node").alias("a"), F.col("lead.node").alias("b"), *[F.col(p + c).alias(f"{c}_{x}") for c in ("n", "at") for x, p in (("a", ""), ("b", "lead."))])
    stars = stars.where((F.col("a") != F.col("b")) & may_be_similar("a", "b")).select("a", "b")
    near = similar(stars.union(by_fingerprint(nodes)), docs, nodes, words)
    for k in range(ROUNDS + 1):
        rooted = materialize(components(near), "roots")
        near = rooted.select(F.col("node").alias("a"), F.col("root").alias("b"))  # a link for each node, however many there were
        if k < ROUNDS:
            near = near.union(_with_picked(shared, rooted, k, docs, nodes, words))
    placed = materialize(shared.join(rooted, "node", "left").select("shingle", "node", "n", "at", F.coalesce("root", "node").alias("root")), "placed")
    forget(shared, lead)
    open_ = placed.groupBy("shingle").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("shingle")
    size_class = F.floor(F.log("n") / float(np.log(CLASS))).cast("int").alias("class")
    rest = materialize(placed.join(materialize(open_, "open"), "shingle").join(nodes.select("node", "odd"), "node").select("shingle", "node", "n", "at", "root", "odd", size_class), "rest")
    forget(placed)
    a, b = (rest.select(*[F.col(c).alias(f"{c}_{side}") for c in rest.columns]) for side in "ab")
    b = b.withColumn("class_b", F.explode(F.array(*[F.col("class_b") + k for k in (-1, 0, 1)])))
    same = (F.col("shingle_a") == F.col("shingle_b")) & (F.col("class_a") == F.col("class_b"))
    met = a.join(b, same & (F.col("root_a") != F.col("root_b")) & may_be_similar("a", "b") & few_odd("a", "b"), "left_semi")
    met = materialize(met.select(*[F.col(f"{c}_a").alias(c) for c in ("shingle", "node", "n", "root")]), "met")
    forget(rest)
    return near.union(_within_groups(met, docs, nodes, words))


def _cells(members: DataFrame) -> DataFrame:
    """(cell, node) for members (key, node, n, root) of groups, so that each two of a group with different roots meet in a cell.

    Large groups are dealt to parts. The most frequent root has parts of its own, which meet the others but not each other.
    """
    weight = F.sum(F.greatest("n", F.lit(LEAST_WEIGHT)))
    of_root = members.groupBy("key", "root").agg(weight.alias("w"))
    of_key = of_root.groupBy("key").agg(F.max(F.struct("w", "root")).alias("top"), F.sum("w").alias("w"), F.count("*").alias("roots")).where("roots > 1")
    parts = lambda w: F.when(F.col("w") <= CELL, 1).otherwise(F.ceil(2 * w / CELL)).cast("int")
    of_key = materialize(of_key.select("key", F.col("top.root").alias("top"), (F.col("w") > CELL).alias("large"), parts(F.col("top.w")).alias("p"), parts(F.col("w") - F.col("top.w")).alias("q")), "groups")
    dealt = members.join(of_key, "key").withColumn("h", F.xxhash64(F.lit(7), "node"))
    part = lambda n: F.pmod(F.col("h"), F.col(n)).cast("int")
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    cell = lambda kind, x, y: F.xxhash64("key", F.lit(kind), x, y)
    of_top = F.transform(upto("q"), lambda y: cell(0, part("p"), y))
    of_rest = F.concat(F.transform(upto("p"), lambda x: cell(0, x, part("q"))), F.transform(upto("q"), lambda z: cell(1, F.least(z, part("q")), F.greatest(z, part("q")))))
    cells = F.when(~F.col("large"), F.array(F.xxhash64("key"))).when(F.col("root") == F.col("top"), of_top).otherwise(of_rest)
    return dealt.select(F.explode(cells).alias("cell"), "node")


def forest(sets: list[np.ndarray], label: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of places whose sets are similar, so many that they connect all similar ones. Equal labels: connected already."""
    sizes = np.array([len(x) for x in sets])
    owner, begin = np.repeat(np.arange(len(sets)), sizes), np.cumsum(sizes) - sizes
    _, shingle, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner, start = owner[np.argsort(shingle, kind="stable")], np.cumsum(often) - often
    _, label, members = np.unique(label, return_inverse=True, return_counts=True)
    out = []
    for k in np.flatnonzero(label != members.argmax()):  # of two with different labels, one is such
        mine = shingle[begin[k] : begin[k] + sizes[k]]
        n = often[mine]
        met = np.bincount(owner[np.repeat(start[mine] - np.cumsum(n) + n, n) + np.arange(n.sum())], minlength=len(sets))
        near = np.flatnonzero((OF * met >= SHARE * (sizes[k] + sizes - met)) & (label != label[k]))
        found, at = np.unique(label[near], return_index=True)
        out += [(int(k), int(x)) for x in near[at]]
        label[np.isin(label, found)] = label[k]
    return out


def _told_apart(table: pa.Table) -> pa.Table:
    """The (cell, node) of a cell that may be similar to another one: by bitmaps where sets are too large for the parities."""
    n, root = (table.column(c).to_numpy() for c in ("n", "root"))
    bits, keep = table.column("bits").to_pylist(), n <= ODD_BITS
    for k in np.flatnonzero(~keep):
        for x in np.flatnonzero((OF * np.minimum(n[k], n) >= SHARE * np.maximum(n[k], n)) & (root != root[k])) if not keep[k] else ():
            if (SHARE + OF) * most_shared(bits[k], bits[x], int(n[k]), int(n[x])) >= SHARE * int(n[k] + n[x]):
                keep[[k, x]] = True
                break
    return table.select(["cell", "node"]).filter(pa.array(keep))


def _connect(table: pa.Table) -> pa.Table:
    node, root = (table.column(c).to_numpy() for c in ("node", "root"))
    sets = [x.values.to_numpy() for x in table.column("shingles")]
    found = forest(sets, root)
    return pa.table({"a": pa.array([node[a] for a, _ in found], pa.int64()), "b": pa.array([node[b] for _, b in found], pa.int64())})


def _within_groups(met: DataFrame, docs: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """Links (a, b) that connect all similar nodes that share a shingle in met (shingle, node, n, root) and differ in root."""
    hub = materialize(met.groupBy("shingle").agg(F.min(F.struct(F.xxhash64("node").alias("h"), "node")).alias("hub")), "hubs")
    members = materialize(met.join(hub, "shingle").select(F.col("hub.node").alias("key"), "node", "n", "root").distinct(), "members")
    dealt = materialize(_cells(members), "cells")
    about = materialize(members.select("node", "root").distinct().join(nodes.select("node", "n", "bits", "first"), "node"), "about")
    cells = materialize(dealt.join(about.drop("first"), "node").groupBy("cell").applyInArrow(_told_apart, "cell long, node long"), "cells")
    used = materialize(cells.select("node").distinct().join(about.select("node", "root", "first"), "node"), "used")
    forget(met, hub, members, dealt, about)
    schema = pa.schema([("node", pa.int64()), ("shingles", pa.list_(pa.int64()))])

    def run(batches):
        for whole in batches:
            for batch in by_bytes(whole, "text", SLICE):
                sets = [shingle_set(t, words).view(np.int64) for t in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, schema.field("shingles").type)], schema=schema)

    texts = _texts(docs, used).groupBy("node").agg(F.first("text").alias("text"))  # rows that repeat have a text each
    sets = map_arrow(texts, run, "node long, shingles array<long>").join(used.select("node", "root"), "node")
    sets = materialize(sets, "sets")
    out = materialize(cells.join(sets, "node").groupBy("cell").applyInArrow(_connect, "a long, b long"), "similar")
    forget(cells, used, sets)
    return out


def _with_picked(shared: DataFrame, rooted: DataFrame, k: int, docs: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """More links: of nodes to one that the k-th hash picks among those with a common shingle, if in different components yet."""
    placed = materialize(shared.join(rooted, "node", "left").select("shingle", "node", "n", "at", F.coalesce("root", "node").alias("root")), "placed")
    pick = materialize(placed.groupBy("shingle").agg(F.min(F.struct(F.xxhash64(F.lit(k), "node").alias("h"), "node", "n", "at", "root")).alias("pick")), "picks")
    met = placed.join(pick, "shingle").where(F.col("root") != F.col("pick.root"))
    pairs = met.select(F.col("node").alias("a"), F.col("pick.node").alias("b"), *[F.col(p + c).alias(f"{c}_{x}") for c in ("n", "at") for x, p in (("a", ""), ("b", "pick."))])
    out = similar(pairs.where(may_be_similar("a", "b")).select("a", "b"), docs, nodes, words)
    forget(placed, pick)
    return out


def drop_similar(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """One document of each component of similar ones: the one with the smallest doc_id (of equal ids, the smallest hash of text)."""
    found = prefixes(docs, words)
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")
    nodes = materialize(found.groupBy("node").agg(F.min(first).alias("first"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("bits").alias("bits"), F.first("odd").alias("odd"), F.first("first").alias("first_shingles")), "nodes")
    linked = components(links(docs, nodes, words))
    rooted = nodes.join(linked, "node", "left").select("first", F.coalesce("root", "node").alias("root"))
    keep = materialize(rooted.groupBy("root").agg(F.min("first").alias("keep")).select("keep"), "keep")
    forget(nodes)
    return keep_only(docs, keep)
