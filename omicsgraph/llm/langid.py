"""Language identification with interpolated Kneser-Ney character models.

Words (runs of letters, in lower case, with spaces around) are cut into 4-grams of characters. Their counts by
language are summed over all training documents. The highest order is discounted by count, the lower ones by the
number of characters seen before them, each interpolated with the next lower one, the lowest with the uniform
distribution. All orders are computed on Spark, over all n-grams. A model is a set of sorted arrays of packed n-grams.
They are read in shards of up to `shard_rows` rows, dealt by the middle two characters of a 4-gram: each shard is
broadcast and adds the logarithms of its n-grams to the sums of the texts, which are whole numbers, so that any number
of shards gives the same sums.

A text goes to the language with the lowest cross-entropy per character (of equal ones the first by name). It is
rejected if its excess over that language's mean, times the root of its length, is above that language's limit, which is
set by its calibration documents. The score is the probability of the language among all, on evidence of 50
characters at most (a longer text counts like one of 50 with its mean entropy).

Null texts and texts without letters have language `und`, score 0, and are rejected. Rows that repeat stay. An empty
table gives an empty one, and without labelled rows every document is `und`. Characters above U+FFFF share the code
points of the private use area.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import broadcast_if_small, by_bytes, map_arrow, materialize

ORDER = 4
FOLDS = 5
SLICE = 2 << 20
NONE = "und"
#: Bits of a character in a packed n-gram.
BITS = 16
#: The private use area, where higher code points are put.
PRIVATE, PRIVATE_SIZE = 0xE000, 0x1900
#: Logarithms are held in whole units of 2^-LOG_BITS.
LOG_BITS = 24
#: Rows of models that are broadcast at once (some 32 bytes each), and languages whose numbers are (others are joined).
SHARD_ROWS, MAX_LANGS = 4_000_000, 10_000
FLUSH = 1_000_000

# ---------------------------------------------------------------- n-grams


def distinct_words(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct words, and for each word of the texts its number and its text's number."""
    texts = texts.cast(pa.large_string()) if not pa.types.is_large_string(texts.type) else texts
    parts = pc.split_pattern_regex(pc.utf8_lower(texts.fill_null("")), r"[^\p{L}]+")
    of_text = pc.list_parent_indices(parts).to_numpy(zero_copy_only=False)
    coded = pc.dictionary_encode(parts.flatten())
    words = coded.dictionary.to_pylist()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    keep = np.array([w != "" for w in words], bool)[codes] if len(words) else np.zeros(0, bool)
    return words, codes[keep], of_text[keep]


def word_grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Packed 4-grams of the words in order, and how many each word has: one for each character and one for its end."""
    pad = " " * (ORDER - 1)
    joined = "".join([pad + w + " " for w in words])
    code = np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(np.uint64)
    code = np.where(code > 0xFFFF, PRIVATE + code % PRIVATE_SIZE, code).astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    grams = np.zeros(max(0, len(code) - ORDER + 1), np.uint64)
    for k in range(ORDER):
        grams = (grams << np.uint64(BITS)) | code[k : k + len(grams)]
    begin = np.cumsum(sizes + ORDER - 1) - (sizes + ORDER - 1)
    at = np.repeat(begin - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))
    return grams[at], sizes


def _sum_by(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    kinds, inverse = np.unique(keys, return_inverse=True)
    return kinds, np.bincount(inverse, values, len(kinds))


def _count_grams(batches):
    schema = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())])
    held: dict[str, list] = {}

    def give(lang):
        keys, n = _sum_by(np.concatenate([k for k, _ in held[lang]]), np.concatenate([v for _, v in held[lang]]))
        held[lang] = [(keys, n)]
        return keys, n

    def batch_of(lang, keys, n):
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], schema=schema)

    for whole in batches:
        for batch in by_bytes(whole, "text", SLICE):
            langs = batch.column(1)
            for lang in pc.unique(langs).to_pylist():
                words, codes, _ = distinct_words(batch.column(0).filter(pc.equal(langs, lang)))
                times = np.bincount(codes, minlength=len(words))
                words, times = [w for w, n in zip(words, times) if n], times[times > 0]  # the empty string is no word
                grams, sizes = word_grams(words)
                held.setdefault(lang, []).append(_sum_by(grams, np.repeat(times, sizes).astype(float)))
                if len(held[lang]) > 8:
                    keys, n = give(lang)
                    if len(keys) > FLUSH:
                        yield batch_of(lang, keys, n)
                        del held[lang]
    for lang in list(held):
        yield batch_of(lang, *give(lang))


# ---------------------------------------------------------------- models


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in sorted keys, and whether they hold what is wanted."""
    at = np.minimum(np.searchsorted(keys, wanted), max(0, len(keys) - 1))
    return at, keys[at] == wanted if len(keys) else np.zeros(len(wanted), bool)


@dataclass
class Order:
    """One order of a model: n-grams with their probabilities, contexts with the weights of the next lower order."""

    grams: np.ndarray
    p: np.ndarray
    contexts: np.ndarray
    back: np.ndarray


@dataclass
class KneserNey:
    """One language's orders, lowest first (those of 3 and 4 characters as far as a shard has them)."""

    orders: list[Order]
    uniform: float

    def probability(self, grams: np.ndarray, size: int = ORDER) -> np.ndarray:
        """Of the last character of each n-gram (its lowest `size` characters) given the others."""
        if size == 0:
            return np.full(len(grams), self.uniform)
        order = self.orders[size - 1]
        keys = grams & np.uint64((1 << (BITS * size)) - 1) if size < 4 else grams
        at, found = _find(order.grams, keys)
        out = np.where(found, order.p[at] if len(order.p) else 0.0, 0.0)
        rest = np.flatnonzero(~found)
        if len(rest):
            c, known = _find(order.contexts, keys[rest] >> np.uint64(BITS))
            weight = np.where(known, order.back[c] if len(order.back) else 1.0, 1.0)
            out[rest] = weight * self.probability(grams[rest], size - 1)
        return out


def middle(grams: np.ndarray) -> np.ndarray:
    """The middle two characters of 4-grams."""
    return (grams >> np.uint64(BITS)) & np.uint64((1 << (2 * BITS)) - 1)


@dataclass
class Shard:
    """What the 4-grams whose middle falls into this shard need of all models."""

    names: list[str]
    models: list[KneserNey]
    number: int
    shards: int

    def sums(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Of each text the sum of the logarithms of this shard's n-grams under each model, and how many n-grams it has
        in all shards."""
        words, codes, of_text = distinct_words(texts)
        per_word = np.zeros((len(words), len(self.models)), np.int64)
        sizes = np.zeros(len(words), np.int64)
        for k in range(0, len(words), 20_000):
            grams, n = word_grams(words[k : k + 20_000])
            sizes[k : k + 20_000] = n
            if len(grams):
                kinds, inverse = np.unique(grams, return_inverse=True)
                logs = np.zeros((len(kinds), len(self.models)), np.int64)
                mine = np.flatnonzero(middle(kinds) % np.uint64(self.shards) == np.uint64(self.number))
                for m, model in enumerate(self.models):
                    logs[mine, m] = np.rint(np.log2(model.probability(kinds[mine])) * 2.0**LOG_BITS)
                per_word[k : k + 20_000] = np.add.reduceat(logs[inverse], np.cumsum(n) - n, axis=0)
        order = np.argsort(of_text, kind="stable")
        begin = np.searchsorted(of_text[order], np.arange(len(texts) + 1))
        running = np.concatenate([np.zeros((1, len(self.models)), np.int64), np.cumsum(per_word[codes[order]], axis=0)])
        return running[begin[1:]] - running[begin[:-1]], np.bincount(of_text, sizes[codes], len(texts)).astype(np.int64)


# ---------------------------------------------------------------- the job


def fold(id_col: str = "doc_id") -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS


@dataclass
class Languages:
    """The models as tables: grams (lang, size, gram, p) and contexts (lang, size, context, back); by language the
    probability that the lowest order falls back on."""

    names: list[str]
    uniform: dict[str, float]
    grams: DataFrame | None
    contexts: DataFrame | None
    shards: int

    def shard(self, number: int) -> Shard:
        """One shard's rows, read to the driver; their number is bounded by SHARD_ROWS, besides what all shards have."""
        mine = (F.col("size") < 3) | (F.pmod(F.col("mid"), F.lit(self.shards)) == number)
        grams = self.grams.where(mine).select("lang", "size", "key", "p").toPandas()
        contexts = self.contexts.where(mine).select("lang", "size", "key", "back").toPandas()
        of = {k: g for k, g in grams.groupby(["lang", "size"])}
        ctx = {k: g for k, g in contexts.groupby(["lang", "size"])}

        def arrays(table: dict, lang: str, size: int, value: str) -> tuple[np.ndarray, np.ndarray]:
            if (lang, size) not in table:
                return np.zeros(0, np.uint64), np.zeros(0)
            keys = table[lang, size]["key"].to_numpy(np.int64).view(np.uint64)
            order = np.argsort(keys)
            return keys[order], table[lang, size][value].to_numpy(float)[order]

        models = [KneserNey([Order(*arrays(of, lang, k, "p"), *arrays(ctx, lang, k, "back")) for k in range(1, ORDER + 1)], self.uniform[lang]) for lang in self.names]
        return Shard(self.names, models, number, self.shards)


@dataclass
class Identifier:
    languages: Languages
    means: dict[str, float]
    limits: dict[str, float]


def count_ngrams(docs: DataFrame) -> DataFrame:
    """(lang, gram, n) over all documents with text and lang."""
    labelled = docs.where("text is not null and lang is not null").select("text", "lang")
    return map_arrow(labelled, _count_grams, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _lower(size: int) -> Column:
    """Column gram without its first character; size: of what is left."""
    return F.col("gram").bitwiseAND(F.lit((1 << (BITS * size)) - 1))


def fit(docs: DataFrame, shard_rows: int | None = None) -> Languages:
    """Models of all languages of docs (text, lang)."""
    counts = {ORDER: materialize(count_ngrams(docs), "grams")}
    for size in range(ORDER - 1, 0, -1):  # the count of a shorter n-gram is how many characters it was seen after
        counts[size] = materialize(counts[size + 1].groupBy("lang", _lower(size).alias("gram")).agg(F.count("*").alias("n")), "grams")
    kinds = counts[1].groupBy("lang").agg(F.count("*").alias("k")).orderBy("lang").collect()  # a row per language
    uniform = {r["lang"]: 1 / (r["k"] + 1) for r in kinds}
    if not uniform:
        return Languages([], {}, None, None, 1)
    lower = None
    grams, contexts = [], []
    for size in range(1, ORDER + 1):
        of = counts[size]
        d = of.groupBy("lang").agg(F.count_if(F.col("n") == 1).alias("once"), F.count_if(F.col("n") == 2).alias("twice"))
        d = d.select("lang", F.when((F.col("once") > 0) & (F.col("twice") > 0), F.col("once") / (F.col("once") + 2 * F.col("twice"))).otherwise(0.5).alias("d"))
        d = broadcast_if_small(materialize(d, "discounts"), MAX_LANGS)  # a row per language
        context = F.shiftrightunsigned("gram", BITS) if size > 1 else F.lit(0).cast("long")
        of = of.withColumn("context", context)
        ctx = of.groupBy("lang", "context").agg(F.sum("n").alias("total"), F.count("*").alias("kinds")).join(d, "lang")
        ctx = materialize(ctx.select("lang", "context", "total", "d", (F.col("d") * F.col("kinds") / F.col("total")).alias("back")), "contexts")
        rows = of.join(ctx, ["lang", "context"])
        if lower is None:
            rows = rows.withColumn("below", _looked_up(uniform, F.col("lang")))
        else:
            rows = rows.withColumn("suffix", _lower(size - 1)).join(lower.select("lang", F.col("gram").alias("suffix"), F.col("p").alias("below")), ["lang", "suffix"])
        p = F.greatest(F.lit(0.0), F.col("n") - F.col("d")) / F.col("total") + F.col("back") * F.col("below")
        lower = materialize(rows.select("lang", "gram", p.alias("p")), "order")
        # of abcd the middle is bc; bcd and the contexts abc and bc have it too
        mid = {ORDER: F.shiftrightunsigned("gram", BITS), ORDER - 1: F.shiftrightunsigned("gram", BITS)}.get(size, F.lit(0).cast("long"))
        pair = (1 << (2 * BITS)) - 1
        grams.append(lower.select("lang", F.lit(size).alias("size"), F.col("gram").alias("key"), "p", mid.bitwiseAND(F.lit(pair)).alias("mid")))
        contexts.append(ctx.select("lang", F.lit(size).alias("size"), F.col("context").alias("key"), "back", F.col("context").bitwiseAND(F.lit(pair)).alias("mid")))
    every = [reduce(DataFrame.unionByName, t) for t in (grams, contexts)]
    rows = sum(t.count() for t in every)
    return Languages(list(uniform), uniform, *every, max(1, -(-rows // (shard_rows or SHARD_ROWS))))


def _shard_sums(rows: DataFrame, shard: Shard) -> DataFrame:
    """(__row, __sums, __n) of rows (__row, text): a shard's sums, and the number of n-grams."""
    shared = rows.sparkSession.sparkContext.broadcast(shard)
    schema = pa.schema([("__row", pa.int64()), ("__sums", pa.list_(pa.int64())), ("__n", pa.int64())])

    def run(batches):
        for whole in batches:
            for batch in by_bytes(whole, "text", SLICE):
                sums, n = shared.value.sums(batch.column(1))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(sums), pa.list_(pa.int64())), pa.array(n)], schema=schema)

    return map_arrow(rows.select("__row", "text"), run, "__row long, __sums array<long>, __n long")


def _one_shard(docs: DataFrame, shard: Shard) -> DataFrame:
    """docs with __sums and __n where one shard holds all models: nothing is joined."""
    shared = docs.sparkSession.sparkContext.broadcast(shard)
    place = docs.columns.index("text")

    def run(batches):
        for whole in batches:
            for batch in by_bytes(whole, "text", SLICE):
                sums, n = shared.value.sums(batch.column(place))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(sums), pa.list_(pa.int64())), pa.array(n)], names=[*batch.schema.names, "__sums", "__n"])

    return map_arrow(docs, run, T.StructType([*docs.schema.fields, T.StructField("__sums", T.ArrayType(T.LongType())), T.StructField("__n", T.LongType())]))


def _many_shards(docs: DataFrame, languages: Languages) -> DataFrame:
    """docs with __sums and __n: texts are written once, with a number; each shard reads them and writes only sums, which are
    added up by number and joined to the texts once."""
    numbered = materialize(docs.withColumn("__row", F.monotonically_increasing_id()), "texts")
    parts = [materialize(_shard_sums(numbered, languages.shard(k)), "sums") for k in range(languages.shards)]
    every = reduce(DataFrame.union, parts).groupBy("__row").agg(F.collect_list("__sums").alias("__parts"), F.first("__n").alias("__n"))  # a list per shard
    zero = F.transform(F.get("__parts", F.lit(0)), lambda _: F.lit(0).cast("long"))
    added = F.aggregate("__parts", zero, lambda acc, x: F.zip_with(acc, x, lambda p, q: p + q))
    return numbered.join(every.select("__row", added.alias("__sums"), "__n"), "__row").drop("__row")


def _looked_up(values: dict[str, float], key: Column) -> Column:
    """The value of a key; null where there is none. One literal, however many keys there are."""
    if not values:
        return F.lit(None).cast("double")
    return F.try_element_at(F.map_from_arrays(F.lit(list(values)), F.lit([float(v) for v in values.values()])), key)


def _scores(docs: DataFrame, languages: Languages) -> DataFrame:
    """docs with __best (language), __entropy, __n and __score of text; null and 0 if there are no letters."""
    if not languages.names:
        out = docs.withColumn("__sums", F.lit(None).cast("array<long>")).withColumn("__n", F.lit(0).cast("long"))
    else:
        out = _one_shard(docs, languages.shard(0)) if languages.shards == 1 else _many_shards(docs, languages)
    bits = F.transform("__sums", lambda x: -x / F.greatest(F.col("__n"), F.lit(1)) / 2.0**LOG_BITS)
    some = F.col("__n") > 0 if languages.names else F.lit(False)
    out = out.withColumn("__bits", F.when(some, bits)).withColumn("__entropy", F.array_min("__bits"))
    names = F.lit(languages.names) if languages.names else F.array().cast("array<string>")
    best = F.get(names, F.array_position("__bits", F.col("__entropy")).cast("int") - 1)
    others = F.aggregate("__bits", F.lit(0.0), lambda acc, x: acc + F.pow(F.lit(2.0), -F.least(F.lit(60.0), (x - F.col("__entropy")) * F.least(F.col("__n"), F.lit(50)))))
    return out.withColumn("__best", best).withColumn("__score", F.coalesce(1 / others, F.lit(0.0))).drop("__sums", "__bits")


def train(docs: DataFrame, rejected: float = 0.001, spread: float = 8.0, shard_rows: int | None = None) -> Identifier:
    """Models from the training folds but one, means and limits from that one (fold 0 isn't looked at).

    A limit is passed by a share `rejected` of the calibration documents. As few documents show no such quantile, it is
    `spread` times the distance from the median to the 84 % quantile above the median at least.
    """
    labelled = docs.select("text", "lang", fold().alias("fold")).where("lang is not null and text is not null")
    languages = fit(labelled.where("fold > 1"), shard_rows)
    if not languages.names:
        languages = fit(labelled.where("fold > 0"), shard_rows)
    own = materialize(_scores(labelled.where("fold = 1").select("text", "lang"), languages).where("__best = lang").select("lang", "__entropy", "__n"), "calibration")
    means = {r["lang"]: r["m"] for r in own.groupBy("lang").agg((F.sum(F.col("__entropy") * F.col("__n")) / F.sum("__n")).alias("m")).collect()}  # a row per language
    points = F.percentile_approx(_excess(F.col("lang"), means), [1 - rejected, 0.84, 0.5], 10_000)
    limits = own.groupBy("lang").agg(points.alias("q")).collect()
    return Identifier(languages, means, {r["lang"]: max(r["q"][0], r["q"][2] + spread * (r["q"][1] - r["q"][2])) for r in limits})


def _excess(lang: Column, means: dict[str, float]) -> Column:
    return (F.col("__entropy") - _looked_up(means, lang)) * F.sqrt("__n")


def _judged(docs: DataFrame, identifier: Identifier) -> DataFrame:
    above = F.coalesce(_excess(F.col("__best"), identifier.means) > _looked_up(identifier.limits, F.col("__best")), F.lit(False))
    return _scores(docs, identifier.languages).withColumn("__rejected", F.col("__best").isNull() | above)


def identify(docs: DataFrame, identifier: Identifier) -> DataFrame:
    """doc_id, lang_pred, score, entropy and rejected of every document; other columns are ignored.

    rejected: no letters, or a cross-entropy above what documents of the language have at this length.
    """
    out = _judged(docs.select("doc_id", "text"), identifier)
    return out.select("doc_id", F.coalesce("__best", F.lit(NONE)).alias("lang_pred"), F.col("__score").alias("score"), F.col("__entropy").alias("entropy"), F.col("__rejected").alias("rejected"))


def keep_identified(docs: DataFrame, identifier: Identifier) -> DataFrame:
    """The documents that aren't rejected, with the columns of docs."""
    return _judged(docs, identifier).where("not __rejected").select(*docs.columns)
