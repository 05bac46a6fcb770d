"""The text operators against brute force, on odd rows, on the smallest tables and on empty ones."""

import collections
import hashlib
import random
import re
from itertools import chain
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
import regex
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from omicsgraph.llm import bpe, langid, license_scan, mixing, quality, queries, secret_scan, simhash, suffix_dedup, token_counts, topk

SF = "/root/testdata/sf0.001"
FILE = public_tokenizers.path("byte_bpe_50k.json")


def multiset(rows):
    return collections.Counter(map(tuple, rows))


def texts(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


@pytest.fixture(params=["edge", "small"])
def docs(request, edge_docs, small_docs):
    return {"edge": edge_docs, "small": small_docs}[request.param]


# ---------------------------------------------------------------- suffix arrays


@pytest.mark.parametrize("many", [0, 512])
def test_suffix_array(monkeypatch, many):
    monkeypatch.setattr(suffix_dedup, "MANY", many)
    rng = random.Random(1)
    for _ in range(200):
        s = [rng.randint(1, rng.choice([2, 3, 20])) for _ in range(rng.randint(1, 60))] + [0]
        assert suffix_dedup.suffix_array(np.array(s, np.int16)).tolist() == sorted(range(len(s)), key=lambda i: s[i:])


@pytest.mark.parametrize(("length", "max_group"), [(400, 8192), (400, 0), (64, 8192)])
def test_suffix_dedup(docs, length, max_group):
    rows = texts(docs)
    want = multiset((i, *b) for (i, _), b in zip(rows, suffix_dedup.brute_force([t for _, t in rows], length)))
    got = suffix_dedup.remove_repeats(docs, length, max_group).collect()
    assert multiset((r.doc_id, r.n_bytes, sum(x.end - x.start for x in r.removed), len(r.removed), hashlib.sha256(r.kept).hexdigest()) for r in got) == want


# ---------------------------------------------------------------- tokens


def test_bpe(docs):
    lib = Tokenizer.from_file(FILE)
    want = multiset((i, tuple(lib.encode(t or "", add_special_tokens=False).ids), t or "") for i, t in texts(docs))
    vocabulary = Path(FILE).read_text(encoding="utf-8")
    assert multiset((r.doc_id, tuple(r.ids), r.text) for r in bpe.encode(docs, vocabulary, decoded=True).collect()) == want
    assert multiset((r.doc_id, tuple(r.ids), r.text) for r in bpe.decode(bpe.encode(docs, vocabulary), vocabulary).collect()) == want


def test_bpe_on_random_text():
    lib = Tokenizer.from_file(FILE)
    vocabulary = bpe.Vocabulary(Path(FILE).read_text(encoding="utf-8"))
    encode = bpe.Encoder(vocabulary)
    rng = random.Random(2)
    samples = ["".join(rng.choice("ab c'  \n\t1é<|endoftext|>llstreve.,!?漢🙂́_-՘࢏") for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    samples += ["a" * 3000, " " * 500, "x<|endoftext|> y", "don't we'LL"]
    assert encode(samples) == [e.ids for e in lib.encode_batch(samples, add_special_tokens=False)]
    ids = rng.sample(sorted(vocabulary.id_of.values()), 300)
    assert all(vocabulary.apart(a, b) == (vocabulary.merge(vocabulary.bytes_of[a] + vocabulary.bytes_of[b]) == [a, b]) for a, b in zip(ids, ids[1:]))


def test_words_are_forgotten_within_bounds(monkeypatch):
    monkeypatch.setattr(bpe, "KEEP_WORDS", 3)
    lib = Tokenizer.from_file(FILE)
    encode = bpe.Encoder(bpe.Vocabulary(Path(FILE).read_text(encoding="utf-8")))
    for k in range(6):
        batch = [f"word{k} again {'long' * 40}", "other words again"]
        assert encode(batch) == [lib.encode(t, add_special_tokens=False).ids for t in batch]


def test_token_counts(docs):
    lib = Tokenizer.from_file(FILE)
    n = lambda t: len(lib.encode(t, add_special_tokens=False).ids)
    vocabulary = Path(FILE).read_text(encoding="utf-8")
    rows = texts(docs)
    got = token_counts.count_tokens(docs, vocabulary, limit=50).collect()
    assert multiset((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in got) == multiset((i, len((t or "").encode()), n(t or ""), n(t or "") > 50) for i, t in rows)
    full = dict(rows)
    for r in token_counts.truncate(docs, vocabulary, 9).collect():
        assert (full[r.doc_id] or "").startswith(r.text) and r.n_tokens == n(r.text) <= 9
        assert r.n_tokens >= min(3, n(full[r.doc_id] or ""))


# ---------------------------------------------------------------- mixing


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    target, free, left = {}, set(names), float(sum(sizes.values()))
    while free:
        total = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / total > 3 * sizes[s]}
        if not over:
            return target | {s: left * weight[s] / total for s in free}
        target |= {s: 3.0 * sizes[s] for s in over}
        left -= sum(target[s] for s in over)
        free -= over
    return target


def test_mixing(docs):
    rows = docs.select("doc_id", "text", "source").collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = collections.Counter()
    for r in rows:
        sizes[r.source] += size(r.text)
    target = brute_targets(dict(sizes))
    got = mixing.mix(docs).collect()
    assert multiset((r.doc_id, r.source, r.size, r.source_size) for r in got) == multiset((r.doc_id, r.source, size(r.text), sizes[r.source]) for r in rows)
    taken = collections.Counter()
    for r in got:
        assert abs(r.target - target[r.source]) < 1e-6 * max(1, r.target) and 0 <= r.taken <= 3 * r.size and r.taken == r.copies * r.size
        taken[r.source] += r.taken
    largest = collections.defaultdict(int)
    for r in rows:
        largest[r.source] = max(largest[r.source], size(r.text))
    assert all(abs(taken[s] - target[s]) <= largest[s] + 1 for s in sizes)
    assert multiset(map(tuple, mixing.mix(docs.repartition(5)).collect())) == multiset(map(tuple, got))
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns and out.count() == sum(r.copies for r in got)


def test_mixing_targets_with_caps(spark):
    for case in ({"a": 100, "b": 1, "c": 1, "d": 10, None: 5}, {"a": 5}, {"a": 0, "b": 0}, {"x": 7, "y": 7, "z": 7}):
        df = spark.createDataFrame(list(case.items()), "source string, source_size long")
        got = {r.source: r.target for r in mixing.targets(df).collect()}
        want = brute_targets(case)
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


# ---------------------------------------------------------------- secrets


def base_spans(t):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    found = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
    return [(secret_scan.KINDS[k], s, e) for s, k, e in sorted(found)]


def test_secret_spans(docs):
    formats = secret_scan.train(docs)
    got = secret_scan.scan(docs, formats).collect()
    keep = lambda spans: tuple((x.kind, x.start, x.end) for x in spans if x.kind in secret_scan.KINDS)
    assert multiset((r.doc_id, keep(r.spans)) for r in got) == multiset((i, tuple(base_spans(t or ""))) for i, t in texts(docs))
    masked = secret_scan.mask(docs, formats)
    assert masked.columns == docs.columns and masked.count() == docs.count()
    assert all(r.text is None or (not base_spans(r.text.replace(secret_scan.MASK, "")) or secret_scan.MASK in r.text) for r in masked.collect())


def test_secret_patterns():
    for t in ["token: secret: abcdefghij", "API_KEY='a.b-c_d=e+f/g'", "é token=12345678 AKIA" + "B" * 12 + "x" + "a1" * 16, "ſecret=12345678", "token= token=abcdefgh"]:
        assert [s for s in secret_scan.spans_of(t, secret_scan.Formats({})) if s[0] in secret_scan.KINDS] == base_spans(t)


def test_formats_are_learned():
    """Held-out credentials of a format score above ordinary words."""
    rng = random.Random(3)
    made = ["tk_" + "".join(rng.choice("0123456789ABCDEF") for _ in range(28)) for _ in range(400)]
    long = ["L" + "".join(rng.choice("0123456789") for _ in range(100)) for _ in range(50)]
    plain = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(8, 30))) + rng.choice(["", "", "."]) for _ in range(400)]
    formats = secret_scan.fit({"key": made[:200], "number": long[:40], "ordinary": plain[:200]})
    assert len(formats.automata["key"].states) > 2  # the prefix isn't merged with the rest
    assert sum(formats.judge(t)[0] >= 0 for t in made[200:]) >= 180 and all(formats.judge(t)[1] == "key" for t in made[200:])
    assert not any(formats.judge(t)[0] >= 0 for t in plain[200:])
    assert formats.judge(long[45])[0] >= 0 and formats.judge(long[45]) > formats.judge(long[45][:60])  # whole values were learned
    text = f"see {made[300]} and {plain[300]}"
    assert secret_scan.spans_of(text, formats) == [("like_key", 4, 4 + len(made[300]))]
    assert secret_scan.mask_text("a secret b", [("x", 2, 8)]) == f"a {secret_scan.MASK} b"


def test_formats_outside_the_patterns(spark, small_docs):
    """Values of a format that documents show after a keyword are found where no keyword is; other documents stay clean."""
    rng = random.Random(11)
    live = lambda: "live-" + "".join(rng.choice("0123456789") for _ in range(4)) + "-" + "".join(rng.choice("ghjkmnpqrstvwxyzGHJKMNPQRSTVWXYZ23456789") for _ in range(20))
    labelled = [(10_000 + k, f"set token={live()} now", "en", "a", 9) for k in range(150)]
    bare = {20_000 + k: live() for k in range(100)}
    docs = small_docs.union(spark.createDataFrame([*labelled, *[(k, f"we saw {v} there", "en", "a", 9) for k, v in bare.items()]], small_docs.schema))
    got = {r.doc_id: r.spans for r in secret_scan.scan(docs, secret_scan.train(docs)).collect()}
    found = sum([(x.kind, x.start, x.end) for x in got[k]] == [("like_assign", 7, 7 + len(v))] for k, v in bare.items())
    wrong = sum(x.kind.startswith("like_") for k, spans in got.items() if k < 10_000 for x in spans)
    assert found >= 90 and wrong <= 2
    assert all(x.score is not None for k, spans in got.items() if k >= 10_000 for x in spans)


# ---------------------------------------------------------------- top-k


def brute_top(vectors, k):
    ok = [(i, [int(np.floor(64 * float(x))) for x in v]) for i, v in vectors if v is not None and all(x is not None and np.isfinite(64 * float(x)) for x in v)]
    out = []
    for a, (i, v) in enumerate(ok):
        if i is not None and i % 20 == 0:
            scored = sorted((-sum(x * y for x, y in zip(v, w)), j) for b, (j, w) in enumerate(ok) if b != a and len(w) == len(v))[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scored)]
    return multiset(out)


def test_topk(spark):
    rng = np.random.default_rng(4)
    rows = [(k, rng.normal(0, 0.3, 8).round(2).tolist()) for k in range(300)]
    rows += [(300, rows[0][1]), (0, rows[0][1]), (320, None), (340, [0.1] * 7 + [None]), (360, [0.1] * 7 + [float("nan")]), (380, [0.1] * 7 + [float("inf")]), (400, [0.0] * 8), (420, [1.0, 2.0])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, score string")
    asks = F.col("vec_id") % 20 == 0
    assert multiset(map(tuple, topk.top_k(df, asks, k=7).collect())) == brute_top(rows, 7)
    assert topk.top_k(df.limit(0), asks).count() == 0
    # products beyond 2^53, beyond a long, and of the largest doubles; equal vectors
    large = [(0, [4e9, 4e9]), (20, [2e9, 3e9]), (40, [1.0, 1.0]), (60, [2.0**40 + 1, 1e9]), (80, [2.0**40, 1e9]), (1, [1e300, -1e300]), (100, [1e300, 1e300]), (3, [1e308, 7.0]), (5, [0.0, 0.0]), (120, [0.0, 0.0])]
    large += [(200 + k, [1.0, 1.0]) for k in range(30)] + [(300 + k, [3e8 + k, 5e8 - k]) for k in range(40)]
    df = spark.createDataFrame(large, "vec_id long, embedding array<double>")
    clipped = collections.Counter()
    for (i, r, j, score), n in brute_top(large, 6).items():
        clipped[i, r, j, min(max(score, -(2**63)), 2**63 - 1)] += n
    assert multiset(map(tuple, topk.top_k(df, asks, k=6).collect())) == clipped
    assert topk.top_k(spark.createDataFrame([(0, [1e308]), (1, [1.0])], "vec_id long, embedding array<double>"), asks).count() == 0  # not finite once scaled


def test_topk_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_BYTES", 2000)
    monkeypatch.setattr(topk, "STEP", 16)
    emb = spark.read.parquet(f"{SF}/embeddings.parquet").limit(100)
    rows = [(r.vec_id, r.embedding) for r in emb.collect()]
    assert multiset(map(tuple, topk.top_k(emb, F.col("vec_id") % 20 == 0).collect())) == brute_top(rows, 20)


def test_reading_stops_when_the_kth_is_certain(spark, monkeypatch):
    """Vectors are read in order of their bounds, fewer than there are candidates, and never too few."""
    rng = np.random.default_rng(17)
    rows = [(k, (rng.standard_normal(16) * (1 + 3 * (k % 50 == 0))).tolist()) for k in range(600)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    seen = []
    read = topk._read_in_order
    monkeypatch.setattr(topk, "_read_in_order", lambda pairs, *a: seen.append((pairs.count(), read(pairs, *a))) or seen[-1][1])
    got = topk.top_k(df, F.col("vec_id") % 20 == 0, k=5, scale=4.0)
    assert sorted(tuple(r) for r in got.collect()) == sorted(brute_top_of(rows, 5, 4.0))
    candidates, found = seen[0]
    n_read = sum(r.n_read for r in found.where("rank = 1").collect())
    assert 5 * 30 <= n_read <= candidates


def brute_top_of(rows, k, scale):
    whole = {i: [int(np.floor(scale * x)) for x in v] for i, v in rows}
    for q in (i for i in whole if i % 20 == 0):
        scores = sorted((-sum(a * b for a, b in zip(whole[q], v)), i) for i, v in whole.items() if i != q)[:k]
        yield from ((q, r + 1, i, -s) for r, (s, i) in enumerate(scores))


def test_bounds_hold():
    rng = np.random.default_rng(8)
    for size in (1.0, 1e5, 1e14, 1e120):
        v, q = (np.floor(rng.normal(0, size, (50, 9)) * 64) for _ in range(2))
        scan = topk.Scan(*topk.approximate(v))
        middle, off = scan.bounds(q, slice(0, 50))
        scale = [2.0 ** -int(np.frexp(np.abs(x).max())[1]) for x in q]
        for a in range(50):
            for b in range(50):
                exact = sum(int(x) * int(y) for x, y in zip(q[a], v[b]))
                assert abs(middle[a, b] - exact / 2**64 * scale[a]) <= off[a, b] * (1 + 1e-9)


# ---------------------------------------------------------------- licences


def test_license_phrases_and_templates(docs):
    def brute(t):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        at = [(k, label) for p, label in license_scan.PHRASES.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        return len(w), len(at), min((a for a, _ in at), default=None), max((a for a, _ in at), default=None), tuple(sorted({x for _, x in at}))

    def labels(t):
        w, found = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), []
        for label, template in license_scan.TEMPLATES.items():
            step, words = license_scan.half_block(template), set(template.split())
            blocks = [set(w[max(b, 0) : b + 2 * step]) for b in range(-step, len(w) + 1, step)]
            if any(len(words & b) >= license_scan.needed(len(words), 0.8) for b in blocks):
                found.append(label)
        return tuple(sorted(found))

    got = license_scan.scan(docs).collect()
    assert multiset((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, tuple(sorted(set(r.base)))) for r in got) == multiset((i, *brute(t)) for i, t in texts(docs))
    assert multiset((r.doc_id, tuple(sorted(r.found))) for r in got) == multiset((i, labels(t)) for i, t in texts(docs))
    assert all(0 <= r.score <= 1 for r in got)


def test_license_notices(spark):
    mit = license_scan.TEMPLATES["mit"].split()
    texts = ["the painter under contract released twelve works. license to the sea is a song", "x " * 37 + "Released under the MIT License. " + "y " * 9, "z " * 90 + " ".join(w for k, w in enumerate(mit) if k % 9) + " end", " ".join(mit[:20]), "general public \u212aicense"]
    got = {r.doc_id: sorted(r.found) for r in license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {0: [], 1: ["mit-line"], 2: ["mit"], 3: [], 4: []}


# ---------------------------------------------------------------- language ID


class SlowKneserNey:
    """The same model from plain dictionaries."""

    def __init__(self, words):
        grams = collections.Counter(f"   {w} "[k : k + 4] for w in words for k in range(len(w) + 1))
        self.levels = {4: grams}
        for size in (3, 2, 1):
            self.levels[size] = collections.Counter(g[1:] for g in self.levels[size + 1])
        self.d, self.context = {}, {}
        for size, level in self.levels.items():
            once, twice = (sum(n == k for n in level.values()) for k in (1, 2))
            self.d[size] = once / (once + 2 * twice) if once and twice else 0.5
            for g, n in level.items():
                total, kinds = self.context.get((size, g[:-1]), (0, 0))
                self.context[size, g[:-1]] = total + n, kinds + 1

    def p(self, gram):
        if not gram:
            return 1 / (len(self.levels[1]) + 1)
        size = len(gram)
        if (size, gram[:-1]) not in self.context:
            return self.p(gram[1:])
        total, kinds = self.context[size, gram[:-1]]
        return max(self.levels[size][gram] - self.d[size], 0) / total + self.d[size] * kinds / total * self.p(gram[1:]) if gram in self.levels[size] else self.d[size] * kinds / total * self.p(gram[1:])


def test_kneser_ney(spark, small_docs, monkeypatch):
    """Entropies and languages equal those of a slow model, with one shard and with several; chances sum to one."""
    words = lambda t: regex.findall(r"\p{L}+", (t or "").lower())
    rows = small_docs.select("doc_id", "text", "lang", langid.fold().alias("fold")).collect()
    slow = {lang: SlowKneserNey([w for r in rows if r.fold > 1 and r.lang == lang for w in words(r.text)]) for lang in {r.lang for r in rows if r.lang}}
    model = slow[min(slow)]
    for context in ("   ", "  a", " ab", "qqq"):
        assert abs(sum(model.p(context + c) for c in model.levels[1]) + model.p(context + "\u3042") - 1) < 1e-9
    seen = []
    for shard_rows in (None, 3000):
        identifier = langid.train(small_docs, shard_rows=shard_rows)
        assert (identifier.languages.shards > 3) == bool(shard_rows)
        seen.append(sorted(map(tuple, langid.identify(small_docs, identifier).collect())))
    assert seen[0] == seen[1]
    got = {r[0]: r for r in seen[0]}
    for r in rows[:60]:
        w = words(r.text)
        n = sum(len(x) + 1 for x in w)
        if n:
            bits = {lang: -sum(np.log2(m.p(f"   {x} "[k : k + 4])) for x in w for k in range(len(x) + 1)) / n for lang, m in slow.items()}
            best = min(sorted(bits), key=bits.get)
            assert got[r.doc_id][1] == best and abs(got[r.doc_id][3] - bits[best]) < 1e-6
            assert abs(got[r.doc_id][2] - 1 / sum(2 ** -((b - bits[best]) * min(n, 50)) for b in bits.values())) < 1e-5


def test_language_id(spark, edge_docs):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    identifier = langid.train(docs)
    got = langid.identify(docs, identifier).join(docs.select("doc_id", "lang", langid.fold().alias("fold")), "doc_id")
    held = got.where("fold = 0")
    assert held.where("lang = lang_pred").count() >= 0.98 * held.count()
    assert got.where("rejected").count() <= 0.005 * got.count()
    noise = spark.createDataFrame([(1, " ".join("".join(random.Random(k).choices("bcdfghjklmnpqrstvwxz", k=9)) for k in range(80)))], "doc_id long, text string")
    assert langid.identify(noise, identifier).first().rejected
    odd = langid.identify(edge_docs, identifier).collect()
    assert multiset((r.doc_id,) for r in odd) == multiset((i,) for i, _ in texts(edge_docs))
    assert all((r.lang_pred == "und") == (r.doc_id in (2, 3, 6, 7)) and 0 <= r.score <= 1 for r in odd)
    kept = langid.keep_identified(edge_docs, identifier)
    assert kept.columns == edge_docs.columns and {2, 3, 6, 7}.isdisjoint(r.doc_id for r in kept.collect())


def test_many_languages(spark):
    """Limits and names of any number of languages are one literal in the plan."""
    values = {f"l{k}": k / 7 for k in range(20_000)}
    rows = spark.createDataFrame([("l5",), ("l19999",), ("no",), (None,)], "lang string")
    got = {r.lang: r.v for r in rows.select("lang", langid._looked_up(values, F.col("lang")).alias("v")).collect()}
    assert got == {"l5": 5 / 7, "l19999": 19999 / 7, "no": None, None: None}


def test_language_id_uses_training_rows_only(spark):
    """Changing the language of held-out rows changes nothing."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    other = docs.withColumn("lang", F.when(langid.fold() == 0, "xx").otherwise(F.col("lang")))
    a, b = (sorted(map(tuple, langid.identify(x, langid.train(x)).select("doc_id", "lang_pred", "score").collect())) for x in (docs, other))
    assert a == b


# ---------------------------------------------------------------- SimHash


def brute_fingerprint(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    sh = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in sh]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_components(fps, radius=2):
    root = list(range(len(fps)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= radius:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return [find(k) for k in range(len(fps))]


def test_simhash(docs):
    rows = texts(docs)
    fps = [brute_fingerprint(t) for _, t in rows]
    roots = brute_components(fps)
    least = {r: min((i for (i, _), q in zip(rows, roots) if q == r and i is not None), default=None) for r in set(roots)}
    want = multiset((i, f"{fp:016x}", least[r]) for (i, _), fp, r in zip(rows, fps, roots))
    got = simhash.near_duplicates(docs)
    assert multiset((r.doc_id, r.fingerprint, r.component_id) for r in got.collect()) == want
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(roots))


def test_bk_tree_finds_all_links():
    rng = np.random.default_rng(6)
    base = rng.integers(0, 2**63, 20, dtype=np.uint64)
    values = np.unique(np.concatenate([base ^ (np.uint64(1) << rng.integers(0, 64, 20).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 20).astype(np.uint64)) for _ in range(30)]))
    a, b = simhash.BKTree(values).links(2, block=37)
    want = {(k, j) for k in range(len(values)) for j in range(k) if int(values[k] ^ values[j]).bit_count() <= 2}
    assert set(zip(a.tolist(), b.tolist())) == want and len(a) == len(want)


def test_searches_visit_few_nodes():
    """Edges outside the radius aren't followed: a search in a shard of random fingerprints meets a small part of it."""
    values = np.random.default_rng(16).integers(0, 2**63, simhash.SHARD * 2, dtype=np.uint64)
    tree = simhash.BKTree(values)
    tree.links(simhash.RADIUS)
    assert tree.visited < 0.25 * len(values) ** 2


@pytest.mark.parametrize("most", [10, 150])
def test_large_groups_are_split(spark, most):
    rng = random.Random(9)
    base = rng.getrandbits(64)
    fps = sorted({base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 6))) for _ in range(900)})
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    roots = brute_components(fps)
    linked = {r.node % 2**64: r.root % 2**64 for r in simhash.components(simhash.near_links(df, most)).collect()}
    of = [linked.get(x, x) for x in fps]
    assert len(set(zip(of, roots))) == len(set(of)) == len(set(roots))


def test_shards_and_components(spark, monkeypatch):
    """Near fingerprints share a shard, however many there are."""
    rng = random.Random(7)
    pairs = []
    for _ in range(500):
        a = rng.getrandbits(64)
        pairs.append((a, a ^ sum(1 << b for b in rng.sample(range(64), 2))))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(a), signed(b)) for a, b in pairs], "a long, b long")
    for n in (0, 1, 5000, 10**6, 10**10, 10**13):
        keys = [simhash.shard_keys(F.col(c), n) for c in "ab"]
        assert df.where(~F.arrays_overlap(*keys)).count() == 0
    monkeypatch.setattr(simhash, "SHARD", 4)  # many shards
    some = sorted({x for p in pairs for x in p})
    roots = brute_components(some)
    linked = {r.node % 2**64: r.root % 2**64 for r in simhash.components(simhash.near_links(spark.createDataFrame([(signed(x),) for x in some], "fp long"))).collect()}
    of = [linked.get(x, x) for x in some]
    assert len(set(zip(of, roots))) == len(set(of)) == len(set(roots))
    path = [(k, k + 1) for k in range(60)] + [(100, 101), (101, 102), (100, 102)]
    rng.shuffle(path)
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(path, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(1, 61)} | {101: 100, 102: 100}
    assert simhash.components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---------------------------------------------------------------- quality


def test_quality(docs):
    def brute(t):
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        c = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        covered = set(chain.from_iterable(range(i, i + 5) for i in range(len(w) - 4) if c[tuple(w[i : i + 5])] > 1))
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), len(w) < 10 or 100 * len(covered) > 20 * len(w)

    got = quality.judge(docs).collect()
    assert multiset((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == multiset((i, *brute(t)) for i, t in texts(docs))
    assert all(not (r.kept and r.base_failed) for r in got)


def test_host_verdicts(spark):
    good = "one two three four five six seven eight nine ten eleven"
    rows = [(k, good, "fine") for k in range(40)] + [(100 + k, "too short", "bad") for k in range(40)] + [(200, good, "bad"), (300, "short", "tiny"), (301, good, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: (r.base_failed, r.kept) for r in quality.judge(df).collect()}
    assert got[0] == (False, True) and got[200] == (False, False) and got[301] == (False, True) and got[100] == (True, False)
    rates = {r.host: r.rate_short for r in quality.host_verdicts(quality.document_rules(df)).collect()}
    assert 0 < rates["fine"] < 0.2 and 0.8 < rates["bad"] < 1 and 0.3 < rates["tiny"] < 1


# ---------------------------------------------------------------- all


def test_empty_tables(spark, edge_docs, tmp_path):
    empty = edge_docs.limit(0)
    vocabulary = Path(FILE).read_text(encoding="utf-8")
    identifier = langid.train(empty)
    results = [
        suffix_dedup.remove_repeats(empty),
        bpe.encode(empty, vocabulary),
        token_counts.count_tokens(empty, vocabulary),
        mixing.mix(empty),
        mixing.mixed_documents(empty),
        secret_scan.scan(empty, secret_scan.train(empty)),
        license_scan.scan(empty),
        langid.identify(empty, identifier),
        simhash.near_duplicates(empty),
        simhash.drop_near_duplicates(empty),
        quality.judge(empty),
    ]
    assert [df.count() for df in results] == [0] * len(results)
    assert langid.identify(edge_docs, identifier).where("lang_pred = 'und'").count() == edge_docs.count()


def test_queries_return_their_columns(spark):
    want = {
        "op1_suffix_dedup": "doc_id n_bytes n_removed n_spans kept_sha256",
        "op2_bpe": "doc_id n_tokens ids_sha256 decoded_sha256",
        "op3_mixing": "doc_id size source_size target taken",
        "op4_token_counts": "doc_id n_bytes n_tokens over_limit",
        "op5_secret_scan": "doc_id n_assign n_access n_hex base_sha256 spans",
        "op6_topk": "query_id rank vec_id score",
        "op7_license_scan": "doc_id n_words n_base first_word last_word base_labels labels score",
        "op8_language_id": "doc_id held_out lang_pred score",
        "op9_simhash": "doc_id fingerprint component_id",
        "op10_quality_rules": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    }
    kinds = dict(doc_id="bigint", n_bytes="bigint", n_removed="bigint", n_spans="bigint", n_tokens="bigint", size="bigint", source_size="bigint", target="double", taken="bigint", over_limit="boolean", n_assign="bigint", n_access="bigint", n_hex="bigint", query_id="bigint", rank="int", vec_id="bigint", n_words="bigint", n_base="bigint", first_word="bigint", last_word="bigint", held_out="boolean", component_id="bigint", word_chars="bigint", n_symbols="bigint", n_dup_lines="bigint", n_repeat_words="bigint", base_failed="boolean", kept="boolean")
    assert set(queries.QUERIES) == set(want)
    for name, columns in want.items():
        df = queries.QUERIES[name](spark, SF)
        assert df.columns[: len(columns.split())] == columns.split(), name
        assert all(dict(df.dtypes)[c] == k for c, k in kinds.items() if c in columns.split()), name
        assert not name.startswith("op1_") or df.count() == 200
