"""Byte-level BPE by prefix-sharing traversal of a trie of distinct words.

A sequence of tokens is what BPE makes of its bytes exactly if BPE leaves every two neighbours as they are. So the
encoding of a prefix is known from its *last token*: the longest vocabulary token that ends the prefix and that BPE
leaves apart from the last token of the prefix before it. Words in sorted order are the trie in depth-first order:
states of shared prefixes are kept on a stack and computed once.

Texts are split at the tokenizer's added tokens first, then into words by its pattern. Null texts are empty.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Callable, Iterable
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import tokenizers
from pyspark.sql import DataFrame

from .common import by_bytes, kept, map_arrow

#: The word pattern of byte-level BPE.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A generation of words that a worker keeps with their values, the bytes of the longest of them, and pairs kept.
KEEP_WORDS, KEEP_BYTES, KEEP_PAIRS = 220_000, 64, 400_000
SLICE = 2 << 20


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary file: itself if printable, else the next free one."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Vocabulary:
    """Tokens, merge ranks and added tokens of a byte-level BPE file (its JSON text)."""

    def __init__(self, text: str):
        spec = json.loads(text)
        model = spec["model"]
        if model["type"] != "BPE" or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["normalizer"] or spec["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError("not a plain byte-level BPE file")
        letters = _byte_letters()
        raw = lambda token: bytes(letters[c] for c in token)
        self.id_of = {raw(t): i for t, i in model["vocab"].items()}
        self.bytes_of = {i: t for t, i in self.id_of.items()}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.rank = {(self.id_of[raw(a)], self.id_of[raw(b)]): (k, self.id_of[raw(a + b)]) for k, (a, b) in enumerate(pairs)}
        self.after: dict[int, dict[int, int]] = {}  # ranks by left, then right token
        self.made: dict[int, tuple[int, int, int]] = {}  # left, right and rank of the merge that makes a token
        for (a, b), (k, t) in self.rank.items():
            self.after.setdefault(a, {})[b] = k
            self.made.setdefault(t, (a, b, k))
        self.sizes = {i: len(t) for t, i in self.id_of.items()}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of |= {i: t.encode() for t, i in self.added.items()}
        #: every end of a token, with its id if it is a token: how far back the search for last tokens has to go
        self.ends = {t[k:]: -1 for t in self.id_of for k in range(1, len(t))} | self.id_of
        self._apart: dict[tuple[int, int], bool] = {}
        self._alone: dict[int, bool] = {}
        self._right: dict[int, list] = {}
        self._left: dict[int, list] = {}

    def merge(self, data: bytes) -> list[int]:
        """Plain BPE by merging the pair of least rank again and again; for short strings."""
        ids = [self.id_of[bytes([b])] for b in data]
        while len(ids) > 1:
            best = min((self.rank[p] for p in zip(ids, ids[1:]) if p in self.rank), default=None)
            if best is None:
                break
            out, k = [], 0
            while k < len(ids):
                if k + 1 < len(ids) and self.rank.get((ids[k], ids[k + 1])) == best:
                    out.append(best[1])
                    k += 2
                else:
                    out.append(ids[k])
                    k += 1
            ids = out
        return ids

    def edge(self, token: int, side: int) -> list[tuple[int, float]]:
        """The parts that stand at one end (0 left, 1 right) while the token is merged, with the ranks that end them."""
        out, ends = [], float("inf")
        while True:
            out.append((token, ends))
            if token not in self.made:
                return out
            ends = self.made[token][2]
            token = self.made[token][side]

    def apart(self, a: int, b: int) -> bool:
        """Whether BPE leaves the tokens a, b as they are when they stand together.

        It doesn't if a part at a's end and one at b's start merge before either is used up inside its token; of
        equal merges the left one comes first.
        """
        found = self._apart.get((a, b))
        if found is None:
            if len(self._apart) >= KEEP_PAIRS:
                self._apart.clear()
            right = self._right.get(a) or self._right.setdefault(a, self.edge(a, 1))
            left = self._left.get(b) or self._left.setdefault(b, self.edge(b, 0))
            found = self.alone(b)
            for x, ends in right if found else ():
                ranks = self.after.get(x)
                if ranks and any((k := ranks.get(y)) is not None and k < ends and k <= until for y, until in left):
                    found = False
                    break
            self._apart[a, b] = found
        return found

    def alone(self, a: int) -> bool:
        found = self._alone.get(a)
        if found is None:
            found = self._alone[a] = self.merge(self.bytes_of[a]) == [a]
        return found

    def last_token(self, word: bytes, end: int, last: list[int]) -> int:
        """The last token of word[:end], where last has those of the shorter prefixes."""
        ends, fits, begin = self.ends, [], end - 1
        while begin >= 0 and (t := ends.get(word[begin:end])) is not None:
            if t >= 0:
                fits.append((begin, t))
            begin -= 1
        pairs = self._apart
        for begin, t in reversed(fits):
            if begin:
                before = last[begin]
                fine = pairs.get((before, t))
                if self.apart(before, t) if fine is None else fine:
                    return t
            elif self.alone(t):
                return t
        raise ValueError("a byte has no token")

    def walk(self, words: Iterable[bytes]):
        """(word, last tokens by prefix length, token counts by prefix length), depth first through the trie of words.

        The two lists are the traversal's stack: they change with the next word.
        """
        last, count, before = [-1], [0], b""
        last_token, sizes = self.last_token, self.sizes
        for word in sorted(set(words)):
            shared, most = 0, min(len(before), len(word))
            while shared < most and before[shared] == word[shared]:
                shared += 1
            del last[shared + 1 :], count[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                t = last_token(word, end, last)
                last.append(t)
                count.append(count[end - sizes[t]] + 1)
            before = word
            yield word, last, count

    def encode_words(self, words: Iterable[bytes]) -> dict[bytes, tuple[int, ...]]:
        out, sizes = {}, self.sizes
        for word, last, _ in self.walk(words):
            ids, end = [], len(word)
            while end:
                t = last[end]
                ids.append(t)
                end -= sizes[t]
            ids.reverse()
            out[word] = tuple(ids)
        return out


class Splitter:
    """Splits texts into words; added tokens are words of their own.

    Where a text has code points that are new to Unicode, the tokenizers library splits it by its own tables.
    """

    def __init__(self, added: dict[str, int]):
        self.words = regex.compile(WORDS)
        self.common: set[str] = set()  # characters that are surely alike in all tables
        self.library = tokenizers.pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
        self.added = added
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")") if added else None

    def plain(self, text: str) -> list[str]:
        if text.isascii():
            return self.words.findall(text)
        new = set(text) - self.common
        self.common.update(c for c in new if unicodedata.category(c) != "Cn")
        if new <= self.common:
            return self.words.findall(text)
        return [text[a:b] for _, (a, b) in self.library.pre_tokenize_str(text)]

    def __call__(self, text: str) -> list[str]:
        if self.special is None or not any(t in text for t in self.added):
            return self.plain(text)
        return [w for part in self.special.split(text) for w in ([part] if part in self.added else self.plain(part))]


class Words:
    """Values of words, computed for all new ones of a batch together; common ones are kept, in two generations."""

    def __init__(self, compute: Callable[[set[str]], dict[str, tuple]]):
        self.compute = compute
        self.young: dict[str, tuple] = {}
        self.old: dict[str, tuple] = {}
        self.long: set[str] = set()

    def __call__(self, split: list[list[str]]) -> dict[str, tuple]:
        """A dictionary with all words of the batch."""
        for w in self.long:
            self.young.pop(w, None)
        if len(self.young) > KEEP_WORDS:
            self.young, self.old = {}, self.young
        need = set().union(*split) - self.young.keys()
        known = need & self.old.keys()
        self.young.update((w, self.old[w]) for w in known)
        new = need - known
        self.young.update(self.compute(new))
        self.long = {w for w in new if len(w) > KEEP_BYTES}
        return self.young


class Encoder:
    """Encodes texts batch by batch."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.split = Splitter(vocabulary.added)
        self.words = Words(self._encode)

    def _encode(self, words: set[str]) -> dict[str, tuple[int, ...]]:
        added = self.vocabulary.added
        raw = {w: w.encode() for w in words if w not in added}
        found = self.vocabulary.encode_words(raw.values())
        return {w: found[b] for w, b in raw.items()} | {w: (added[w],) for w in words if w in added}

    def __call__(self, texts: list[str]) -> list[list[int]]:
        split = [self.split(t) for t in texts]
        ids = self.words(split)
        return [list(chain.from_iterable(map(ids.__getitem__, words))) for words in split]


class Decoder:
    """Decodes ids; unknown ones are skipped, wrong UTF-8 is replaced."""

    def __init__(self, vocabulary: Vocabulary):
        self.bytes_of = [vocabulary.bytes_of.get(i, b"") for i in range(max(vocabulary.bytes_of) + 1)]

    def __call__(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


def kept_by_worker(make: Callable[[Vocabulary], object], vocabulary: str):
    """make(Vocabulary(vocabulary)), made once by each Python worker."""
    return kept("bpe", (make.__qualname__, hash(vocabulary)), lambda: make(Vocabulary(vocabulary)))


def _both(vocabulary: Vocabulary) -> tuple[Encoder, Decoder]:
    return Encoder(vocabulary), Decoder(vocabulary)


def encode(docs: DataFrame, vocabulary: str, decoded: bool = False) -> DataFrame:
    """(doc_id, ids array<int>) of every whole text; vocabulary: the text of a byte-level BPE file.

    decoded: also `text`, decoded from the ids. Null or empty texts have no ids; repeated rows stay; columns other
    than doc_id and text are ignored; an empty table gives an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    fields = [("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))] + [("text", pa.string())] * decoded

    def run(batches):
        encoder, decoder = kept_by_worker(_both, shared.value)
        for whole in batches:
            for batch in by_bytes(whole, "text", SLICE):
                ids = encoder([t or "" for t in batch.column(1).to_pylist()])
                off = np.cumsum([0, *map(len, ids)], dtype=np.int32)
                flat = np.fromiter(chain.from_iterable(ids), np.int32, int(off[-1]))
                columns = [batch.column(0), pa.ListArray.from_arrays(off, flat)]
                if decoded:
                    columns.append(pa.array(map(decoder, ids), pa.string()))
                yield pa.RecordBatch.from_arrays(columns, schema=pa.schema(fields))

    return map_arrow(docs.selectExpr("cast(doc_id as long) doc_id", "text"), run, "doc_id long, ids array<int>" + ", text string" * decoded, keeps="bpe")


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """encoded (doc_id, ids) with `text`: the bytes of the ids joined; null ids count as none."""
    shared = encoded.sparkSession.sparkContext.broadcast(vocabulary)
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("text", pa.string())])

    def run(batches):
        _, decoder = kept_by_worker(_both, shared.value)
        for batch in batches:
            texts = [decoder(ids or []) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], schema=schema)

    return map_arrow(encoded.select("doc_id", "ids"), run, "doc_id long, ids array<int>, text string", keeps="bpe")
