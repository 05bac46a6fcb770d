"""Exact substring dedup with suffix arrays.

Two equal strings of `length` bytes have the same smallest k-gram (by hash, leftmost) at the same place. Every
start of such a string in a document is therefore put into the run of neighbouring starts that share that k-gram;
a run with the bytes it spans is a *piece*. Equal strings lie in pieces of the same k-gram, so:

* k-grams seen once are dropped, and equal pieces are counted before anything is sorted: every string in them repeats;
* the distinct pieces of each remaining k-gram go to one shard. A shard is sorted by induced sorting (suffix types,
  leftmost-smaller substrings, names, the same sorting of the names, induction), and its permuted common prefixes tell
  which strings repeat;
* a k-gram with more than `max_group` distinct pieces would make its shard too large. Its pieces are cut into shorter
  runs of starts, dealt by the bytes that all strings of a run share, down to single strings if need be, and go to
  shards like others; nothing is capped.

Null texts are empty; texts shorter than `length` keep all bytes; repeated rows are documents of their own (so they
lose all that is long enough); documents are identified by (doc_id, hash of text), so null ids are allowed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, doc_key, map_arrow, materialize, text_bytes

#: Positions handled at once while pieces are cut.
BLOCK = 1 << 20
SHARD_BYTES = 1 << 20
#: Starts of the runs into which pieces of very frequent k-grams are cut, one after another.
RUNS = (16, 1)


# ---------------------------------------------------------------- pieces


def kgram_size(length: int) -> int:
    """Bytes of the k-grams: the largest power of two of up to a third of the length."""
    return 1 << ((length // 3).bit_length() - 1)


def _kgram_hashes(buf: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of the `size` bytes at each position, made of the hashes of its halves."""
    h = np.ndarray((len(buf) - 7,), "<u8", buf, 0, (1,)) * np.uint64(0x9E3779B97F4A7C15)
    have = 8
    while have < size:
        h = (h[:-have] ^ (h[:-have] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + h[have:]
        have *= 2
    h ^= h >> np.uint64(32)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _smallest_at(h: np.ndarray, width: int) -> np.ndarray:
    """For each window of `width` positions, where its smallest hash is (leftmost; the low 20 bits aren't compared)."""
    m = (h & ~np.uint64(0xFFFFF)) | np.arange(len(h), dtype=np.uint64)
    have = 1
    while have < width:
        step = min(have, width - have)
        m = np.minimum(m[:-step], m[step:])
        have += step
    return (m & np.uint64(0xFFFFF)).astype(np.int64)


def _pieces_of_block(buf: np.ndarray, length: int, last: np.ndarray) -> tuple:
    """Runs of valid starts with the same smallest k-gram: first start, starts, k-gram's hash, its distance from the
    first start. last: of each start, the last start in its document."""
    size = kgram_size(length)
    h = _kgram_hashes(buf, size)
    at = _smallest_at(h, length - size + 1)
    starts = np.arange(len(at))
    ok = np.flatnonzero(starts <= last[: len(at)])
    if not len(ok):
        return (ok,) * 4
    p = at[ok]
    new = np.flatnonzero(np.r_[True, (p[1:] != p[:-1]) | (ok[1:] != ok[:-1] + 1)])
    count = np.diff(np.r_[new, len(ok)])
    return ok[new], count, h[p[new]].view(np.int64), p[new] - ok[new]


def _digests(view: memoryview, begin: list[int], end: list[int]) -> np.ndarray:
    """128-bit hashes of stretches of bytes, as rows of two numbers."""
    return np.frombuffer(b"".join([xxhash.xxh3_128_digest(view[a:b]) for a, b in zip(begin, end)]), np.int64).reshape(-1, 2)


def cut_pieces(buf: np.ndarray, off: np.ndarray, length: int) -> Iterator[tuple]:
    """(document index, start in document, number of starts, k-gram hash, its distance, digest) arrays of pieces."""
    doc_of = np.repeat(np.arange(len(off) - 1), np.diff(off))
    pos = 0
    while pos + length <= len(buf):
        end = min(pos + BLOCK, len(buf))
        docs = doc_of[pos:end]
        start, count, h, at = _pieces_of_block(np.ascontiguousarray(buf[pos:end]), length, off[docs + 1] - length - pos)
        if len(start):
            digest = _digests(memoryview(buf[pos:end]), start.tolist(), (start + count + length - 1).tolist())
            doc = docs[start]
            yield doc, start + pos - off[doc], count, h, at, digest
        pos = end - length + 1 if end < len(buf) else end


def _find_pieces(length: int):
    schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("start", pa.int64()), ("n", pa.int32()), ("kgram", pa.int64()), ("at", pa.int32()), ("d1", pa.int64()), ("d2", pa.int64())])

    def run(batches):
        for whole in batches:
            for batch in by_bytes(whole, "text", BLOCK):
                buf, off = text_bytes(batch.column(2))
                for doc, start, count, h, at, digest in cut_pieces(buf, off, length):
                    ids = [batch.column(k).take(pa.array(doc)) for k in (0, 1)]
                    yield pa.RecordBatch.from_arrays([*ids, pa.array(start), pa.array(count.astype(np.int32)), pa.array(h), pa.array(at.astype(np.int32)), pa.array(digest[:, 0]), pa.array(digest[:, 1])], schema=schema)

    return run, "doc_id long, text_key long, start long, n int, kgram long, at int, d1 long, d2 long"


# ---------------------------------------------------------------- suffix arrays

#: From so many symbols on buckets are scanned together.
MANY = 512


def _next_true(mask: np.ndarray) -> np.ndarray:
    """Index of the first True at or after each position (len(mask) if none)."""
    at = np.where(mask, np.arange(len(mask)), len(mask))
    return np.minimum.accumulate(at[::-1])[::-1]


def suffix_types(s: np.ndarray) -> np.ndarray:
    """True where the suffix is smaller than the next one; the last symbol must be the single smallest."""
    differs = np.r_[s[1:] != s[:-1], True]
    k = _next_true(differs)
    up = np.r_[s[:-1] < s[1:], True]
    return up[k]


def _grouped(sym: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A stable order by symbol, the symbols in it, their counts, and each element's place within its symbol."""
    order = np.argsort(sym, kind="stable")
    kinds, first, counts = np.unique(sym[order], return_index=True, return_counts=True)
    return order, kinds, counts, np.arange(len(sym)) - np.repeat(first, counts)


def induce(s: np.ndarray, small: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """The order of all suffixes induced from that of the leftmost-smaller ones, bucket by bucket.

    What a bucket holds at one time is moved on together: entries are scanned in order, and what they induce goes to
    the fronts (then to the backs) of the buckets in that order. Of a large alphabet several buckets are scanned
    together, as far as none of them gets anything from the others.
    """
    n, k = len(s), int(s.max()) + 1
    size = np.bincount(s, minlength=k)
    end = np.cumsum(size)
    begin = end - size
    sa = np.full(n, -1, np.int64)
    order, kinds, counts, place = _grouped(s[lms])
    sa[np.repeat(end[kinds] - counts, counts) + place] = lms[order]
    lms_from = end.copy()
    lms_from[kinds] -= counts
    front, back = begin.copy(), end.copy()
    used = np.flatnonzero(size)
    widest = len(used) if len(used) > MANY else 1

    def induced(got: np.ndarray, smaller: bool) -> np.ndarray:
        j = got[got > 0] - 1
        return j[small[j] == smaller]

    def push_front(j: np.ndarray) -> None:
        if len(j):
            order, kinds, counts, place = _grouped(s[j])
            sa[np.repeat(front[kinds], counts) + place] = j[order]
            front[kinds] += counts

    def push_back(j: np.ndarray) -> None:
        if len(j):
            order, kinds, counts, place = _grouped(s[j])
            sa[np.repeat(back[kinds], counts) - 1 - place] = j[order]
            back[kinds] -= counts

    at, width = 0, 1
    while at < len(used):
        take = used[at : at + width]
        c, upto = int(take[0]), int(end[take[-1]])
        j = induced(sa[begin[c] : upto], False) if width > 1 else None
        least = int(s[j].min()) if j is not None and len(j) else k
        if width == 1 or least == c:  # a bucket that may get more from itself
            done = begin[c]
            while done < front[c]:
                stop = int(front[c])
                push_front(induced(sa[done:stop], False))
                done = stop
            push_front(induced(sa[lms_from[c] : end[c]], False))
            at, width = at + 1, min(widest, 2 * width) if width == 1 else max(1, width // 2)
        elif least > take[-1]:
            push_front(j)
            at, width = at + len(take), min(widest, 2 * width)
        else:
            push_front(induced(sa[begin[c] : begin[least]], False))
            at, width = at + int(np.searchsorted(take, least)), max(1, width // 2)
    sa[(sa >= 0) & small[np.maximum(sa, 0)]] = -1
    at, width = len(used), 1
    while at > 0:
        take = used[max(0, at - width) : at]
        c, first = int(take[-1]), int(begin[take[0]])
        j = induced(sa[first : end[c]][::-1], True) if width > 1 else None
        most = int(s[j].max()) if j is not None and len(j) else -1
        if width == 1 or most == c:
            done = end[c]
            while done > back[c]:
                stop = int(back[c])
                push_back(induced(sa[stop:done][::-1], True))
                done = stop
            push_back(induced(sa[begin[c] : front[c]][::-1], True))
            at, width = at - 1, min(widest, 2 * width) if width == 1 else max(1, width // 2)
        elif most < take[0]:
            push_back(j)
            at, width = at - len(take), min(widest, 2 * width)
        else:
            push_back(induced(sa[end[most] : end[c]][::-1], True))
            at, width = at - len(take) + int(np.searchsorted(take, most, side="right")), max(1, width // 2)
    sa[0] = n - 1
    return sa


def _same_substrings(s: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the substrings of `size` symbols at a and b are equal."""
    same = np.ones(len(a), bool)
    live, t = np.arange(len(a)), 0
    while len(live):
        live = live[size[live] > t]
        ok = s[a[live] + t] == s[b[live] + t]
        same[live[~ok]] = False
        live, t = live[ok], t + 1
    return same


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Suffixes of s in order; s ends with a single smallest symbol."""
    small = suffix_types(s)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    is_lms = np.zeros(len(s), bool)
    is_lms[lms] = True
    if len(lms) < 2:
        return induce(s, small, lms)
    first = induce(s, small, lms)
    first = first[is_lms[first]]
    size = np.zeros(len(s), np.int64)
    size[lms] = np.r_[np.diff(lms) + 1, 1]
    a, b = first[:-1], first[1:]
    same = size[a] == size[b]
    at = np.flatnonzero(same)
    same[at] = _same_substrings(s, a[at], b[at], size[a[at]])
    name = np.zeros(len(s), np.int64)
    name[first] = np.cumsum(np.r_[False, ~same])
    return induce(s, small, lms[suffix_array(name[lms])] if same.any() else first)


def permuted_prefixes(s: np.ndarray, sa: np.ndarray, direct: np.ndarray, cap: int) -> tuple[np.ndarray, np.ndarray]:
    """For each position the common prefix with the suffix before it in sa, up to cap, and that suffix.

    Compared symbol by symbol only where the symbols before both differ, or where `direct` says so; elsewhere it is
    one less than at the position before.
    """
    n = len(s)
    before = np.empty(n, np.int64)
    before[sa[1:]] = sa[:-1]
    before[sa[0]] = -1
    other = np.maximum(before - 1, 0)
    i = np.arange(n)
    compare = direct | (before <= 0) | (i == 0)
    compare[1:] |= s[:-1] != s[other[1:]]
    at = np.flatnonzero(compare & (before >= 0))
    plcp = np.zeros(n, np.int64)
    padded = np.r_[s.astype(np.int64), -1 - np.arange(cap + 1)]
    live, t = at, 0
    while len(live) and t < cap:
        live = live[padded[live + t] == padded[before[live] + t]]
        t += 1
        plcp[live] = t
    last = np.maximum.accumulate(np.where(compare, i, 0))
    return np.maximum(plcp[last] - (i - last), 0), before


def repeated_starts(pieces: list[bytes], length: int) -> list[np.ndarray]:
    """For each piece a mask over its starts: whether the string there also starts elsewhere in these pieces."""
    sizes = np.array([len(p) for p in pieces], np.int64)
    joined = np.frombuffer(b"\xff".join(pieces) + b"\xff\xff", np.uint8).astype(np.int16)  # 0xff is never in UTF-8
    s = joined + 2
    s[joined == 255] = 1
    s[-1] = 0
    begin = np.cumsum(np.r_[0, sizes[:-1] + 1])
    sa = suffix_array(s)
    direct = np.zeros(len(s), bool)
    direct[begin] = True
    plcp, before = permuted_prefixes(s, sa, direct, int(sizes.max()) + 1)
    hit = plcp >= length
    hit[before[np.flatnonzero(hit)]] = True
    return [hit[b : b + z - length + 1] for b, z in zip(begin.tolist(), sizes.tolist())]


def _runs(mask: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Byte spans covered by the strings at the True starts."""
    edge = np.flatnonzero(np.diff(np.r_[False, mask, False].astype(np.int8)))
    return [(a, b - 1 + length) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist())]


# ---------------------------------------------------------------- the job


PIECE = "kgram long, d1 long, d2 long, times long, pieces long, n int, at int, piece binary"
_PIECE = pa.schema([("kgram", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("times", pa.int64()), ("pieces", pa.int64()), ("n", pa.int32()), ("at", pa.int32()), ("piece", pa.binary())])


def _take_pieces(length: int):
    """The wanted pieces of each document with their bytes."""

    def run(batches):
        given = set()  # of rows that repeat, one gives the bytes
        for whole in batches:
            for batch in by_bytes(whole, "text", BLOCK):
                buf, off = text_bytes(batch.column(0))
                rows = []
                for k, want in enumerate(batch.column(1).to_pylist()):
                    base = int(off[k])
                    key = (want[0]["d1"], want[0]["d2"])
                    if key in given:
                        continue
                    given.add(key)
                    for w in want:
                        begin = base + w.pop("start")
                        rows.append(w | {"piece": buf[begin : begin + w["n"] + length - 1].tobytes()})
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=_PIECE)

    return run, PIECE


def _sort_shard(length: int):
    spans = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))
    schema = pa.schema([("d1", pa.int64()), ("d2", pa.int64()), ("spans", spans)])

    def run(table: pa.Table) -> pa.Table:
        # groups of one k-gram stay together; a shard of many is sorted in parts, for memory
        table = table.sort_by([("kgram", "ascending"), ("d1", "ascending"), ("d2", "ascending")])
        d1, d2 = table.column("d1").to_numpy(), table.column("d2").to_numpy()
        table = table.filter(pa.array(np.r_[True, (d1[1:] != d1[:-1]) | (d2[1:] != d2[:-1])]))
        kgram = table.column("kgram").to_numpy()
        pieces = table.column("piece").to_pylist()
        used = np.cumsum([len(p) for p in pieces])
        new = np.flatnonzero(np.r_[True, kgram[1:] != kgram[:-1]])
        out, start = [], 0
        while start < len(pieces):
            base = used[start - 1] if start else 0
            fit = new[(new > start) & (used[new - 1] - base <= 2 * SHARD_BYTES)]
            rest = new[new > start]
            stop = len(pieces) if used[-1] - base <= 2 * SHARD_BYTES else int(fit[-1]) if len(fit) else int(rest[0]) if len(rest) else len(pieces)
            out += [[{"s": a, "e": b} for a, b in _runs(m, length)] for m in repeated_starts(pieces[start:stop], length)]
            start = stop
        return pa.table([table.column("d1"), table.column("d2"), pa.array(out, spans)], schema=schema)

    return run, "d1 long, d2 long, spans array<struct<s:int,e:int>>"


def _cut_finer(length: int, starts: int):
    """Pieces cut into runs of up to `starts` starts, by how far these are before the k-gram.

    All strings of a run hold the same bytes around the k-gram; their hash takes the place of the k-gram.
    """
    schema = pa.schema([("p1", pa.int64()), ("p2", pa.int64()), ("s", pa.int32()), *[f for f in _PIECE if f.name not in ("times", "pieces")]])

    def run(batches):
        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("kgram", "d1", "d2", "n", "at", "piece")]
            rows = []
            for kgram, p1, p2, n, at, piece in zip(*columns):
                view, begin = memoryview(piece), 0
                while begin < n:
                    block = (at - begin) // starts
                    stop = min(n, at - block * starts + 1)
                    low = at - block * starts
                    shared = view[low : low - starts + 1 + length]
                    key = xxhash.xxh64_intdigest(b"%d:%d:" % (kgram, block) + shared) - (1 << 63)
                    d1, d2 = _digests(view, [begin], [stop - 1 + length])[0].tolist()
                    rows.append((p1, p2, begin, key, d1, d2, stop - begin, at - begin, piece[begin : stop - 1 + length]))
                    begin = stop
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return run, "p1 long, p2 long, s int, kgram long, d1 long, d2 long, n int, at int, piece binary"


def _spans_inside(pieces: DataFrame, length: int, max_group: int, runs: tuple[int, ...]) -> DataFrame:
    """(d1, d2, spans) of distinct pieces with strings that repeat. times: how often a piece is there; pieces: distinct
    ones of its k-gram."""
    whole = F.array(F.struct(F.lit(0).alias("s"), (F.col("n") + (length - 1)).alias("e")))
    twice = pieces.where("times > 1").select("d1", "d2", whole.alias("spans"))
    small = pieces.where(F.col("pieces") <= max_group) if runs else pieces
    shards = max(1, int(small.agg(F.sum(F.col("n") + length)).first()[0] or 0) // SHARD_BYTES)
    run, schema = _sort_shard(length)
    dealt = small.select("kgram", "d1", "d2", "piece", F.pmod(F.xxhash64("kgram"), F.lit(shards)).alias("shard"))
    out = twice.unionByName(dealt.groupBy("shard").applyInArrow(run, schema))
    large = pieces.where(F.col("pieces") > max_group)
    if not runs or large.isEmpty():
        return out
    run, schema = _cut_finer(length, runs[0])
    parts = materialize(map_arrow(large, run, schema), "parts")
    kinds = materialize(parts.groupBy("kgram", "d1", "d2").agg(F.count("*").alias("times"), F.first("n").alias("n"), F.first("at").alias("at"), F.first("piece").alias("piece")), "part_kinds")
    group = materialize(kinds.groupBy("kgram").agg(F.count("*").alias("pieces"), F.sum("times").alias("seen")).where("seen > 1").drop("seen"), "groups")
    inner = _spans_inside(materialize(kinds.join(group, "kgram"), "finer"), length, max_group, runs[1:]).where(F.size("spans") > 0)
    met = parts.select("p1", "p2", "s", "d1", "d2").join(inner, ["d1", "d2"])
    moved = F.transform("spans", lambda x: F.struct((x["s"] + F.col("s")).alias("s"), (x["e"] + F.col("s")).alias("e")))
    return out.unionByName(met.select(F.col("p1").alias("d1"), F.col("p2").alias("d2"), moved.alias("spans")))


def repeated_spans(docs: DataFrame, length: int = 400, max_group: int = 4096) -> DataFrame:
    """(doc_id, text_key, spans array<struct<s,e>>) of the documents with bytes in repeated strings of `length`."""
    if length < 24:
        raise ValueError("length must be 24 at least")
    keyed = docs.select(*doc_key(), "text")
    run, schema = _find_pieces(length)
    found = materialize(map_arrow(keyed, run, schema), "pieces")
    digest = F.struct("d1", "d2")
    kgrams = found.groupBy("kgram").agg(F.count("*").alias("seen"), (F.min(digest) == F.max(digest)).alias("alike")).where("seen > 1").drop("seen")
    kgrams = materialize(kgrams, "kgrams")  # so that Spark can split the partition of a very frequent k-gram in the join
    repeated = materialize(found.join(kgrams, "kgram"), "repeated")
    alike = repeated.where("alike").select("doc_id", "text_key", F.col("start").alias("s"), (F.col("start") + F.col("n") + (length - 1)).alias("e"))

    # pieces of the other k-grams: one of each goes to a shard
    mixed = repeated.where("not alike")
    kinds = mixed.groupBy("kgram", "d1", "d2").agg(F.count("*").alias("times"), F.min(F.struct("doc_id", "text_key", "start", "n", "at")).alias("of"))
    kinds = materialize(kinds, "kinds")
    group = materialize(kinds.groupBy("kgram").agg(F.count("*").alias("pieces")), "groups")
    wanted = (
        kinds.join(group, "kgram")
        .groupBy("of.doc_id", "of.text_key")
        .agg(F.collect_list(F.struct("kgram", "d1", "d2", "times", "pieces", "of.n", "of.at", "of.start")).alias("want"))
    )
    run, schema = _take_pieces(length)
    same = lambda a, b: a["doc_id"].eqNullSafe(b["doc_id"]) & (a["text_key"] == b["text_key"])
    with_text = keyed.join(wanted.hint("shuffle_hash"), same(keyed, wanted))
    pieces = materialize(map_arrow(with_text.select("text", "want"), run, schema), "shards")
    inner = _spans_inside(pieces, length, max_group, RUNS).where(F.size("spans") > 0)
    inside = (
        mixed.select("doc_id", "text_key", "start", "d1", "d2")
        .join(inner, ["d1", "d2"])
        .select("doc_id", "text_key", "start", F.explode("spans").alias("x"))
        .select("doc_id", "text_key", (F.col("start") + F.col("x.s")).alias("s"), (F.col("start") + F.col("x.e")).alias("e"))
    )
    return alike.unionByName(inside).groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("s", "e")).alias("spans"))


def merge_spans(spans: list[dict]) -> list[tuple[int, int]]:
    """Maximal runs that the spans cover, in order."""
    out: list[list[int]] = []
    for s, e in sorted((x["s"], x["e"]) for x in spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def _remove(batches):
    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("kept", pa.binary()), ("removed", spans_type), ("text", pa.string())])
    for whole in batches:
        for batch in by_bytes(whole, "text", 4 * BLOCK):
            buf, off = text_bytes(batch.column(1))
            kept, removed = [], []
            for k, spans in enumerate(batch.column(2).to_pylist()):
                runs = merge_spans(spans or [])
                base = int(off[k])
                cut = [base, *(base + x for r in runs for x in r), int(off[k + 1])]
                kept.append(b"".join([buf[a:b].tobytes() for a, b in zip(cut[::2], cut[1::2])]))
                removed.append([{"start": a, "end": b} for a, b in runs])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(off)), pa.array(kept, pa.binary()), pa.array(removed, spans_type), pa.array([k.decode("utf-8", "ignore") for k in kept])], schema=schema)


def remove_repeats(docs: DataFrame, length: int = 400, max_group: int = 4096) -> DataFrame:
    """One row per document: doc_id, n_bytes, kept (binary), removed (array of byte spans, end exclusive), text (what is
    kept as a string, without characters that are cut apart).

    docs needs doc_id and text; other columns are ignored. An empty table gives an empty one.
    """
    keyed = docs.select(*doc_key(), "text")
    spans = repeated_spans(docs, length, max_group)
    joined = keyed.join(spans.hint("shuffle_hash"), keyed["doc_id"].eqNullSafe(spans["doc_id"]) & (keyed["text_key"] == spans["text_key"]), "left")
    return map_arrow(joined.select(keyed["doc_id"].cast("long"), "text", "spans"), _remove, "doc_id long, n_bytes long, kept binary, removed array<struct<start:long,end:long>>, text string")


def brute_force(texts: list[str | None], length: int = 400) -> list[tuple[int, int, int, str]]:
    """(n_bytes, n_removed, n_spans, sha256 of the rest) of each text; for tests."""
    raw = [(t or "").encode() for t in texts]
    seen: dict[bytes, int] = {}
    for b in raw:
        for k in range(len(b) - length + 1):
            seen[b[k : k + length]] = seen.get(b[k : k + length], 0) + 1
    out = []
    for b in raw:
        runs = merge_spans([{"s": k, "e": k + length} for k in range(len(b) - length + 1) if seen[b[k : k + length]] > 1])
        kept, at = b"", 0
        for s, e in runs:
            kept, at = kept + b[at:s], e
        kept += b[at:]
        out.append((len(b), len(b) - len(kept), len(runs), hashlib.sha256(kept).hexdigest()))
    return out
