"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

A text is normalised with the model's own rules and cut into words that no piece can span. An agenda of the adjacent
symbol pairs that make a piece, best score first and the left one of equals, encodes a word: the best pair is merged, which
puts the pairs with its new neighbours on the agenda, until it is empty. New words of a batch run in lock-step, those of one
length as rows of a matrix, each taking its best pair in a round; words of over LONG characters have an agenda that is a heap.
Symbols that are no piece fall back to their bytes. Common words are kept by the worker.

In each Arrow batch the sentencepiece library encodes all new words too (or, if asked for, all whole texts), and every row
says whether both agree.
"""

from __future__ import annotations

import re
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame

from .bpe import SLICE
from .common import by_bytes, kept, map_arrow

#: The mark of a space, what an unknown piece decodes to, and what stands for a byte that is no UTF-8.
SPACE, UNKNOWN, REPLACED = "▁", " ⁇ ", "�"
#: Characters from which on a word's agenda is a heap; the place of pairs that make nothing.
LONG, NONE = 128, 1 << 40
#: Characters of words that a worker keeps between batches.
KEEP_CHARS = 6_000_000


def ragged(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (count[0] of them), then the same for the others."""
    before = np.cumsum(count) - count
    return np.repeat(start - before, count) + np.arange(int(count.sum()))


def flat_lists(lists: list) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of lists of whole numbers, and their entries one after another."""
    count = np.fromiter(map(len, lists), np.int64, len(lists))
    return count, np.fromiter(chain.from_iterable(lists), np.int32, int(count.sum()))


class Pieces:
    """Pieces, scores and kinds of a model (the bytes of its file)."""

    def __init__(self, model: bytes):
        lib = self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        ids = range(lib.get_piece_size())
        self.text = [lib.id_to_piece(i) for i in ids]
        self.end, self.unknown = lib.eos_id(), lib.unk_id()
        self.controls = {i for i in ids if lib.is_control(i)}
        if any(lib.is_unused(i) for i in ids):
            raise ValueError("a vocabulary with unused pieces")
        self.byte_ids = {int(self.text[i][3:5], 16): i for i in ids if lib.is_byte(i)}
        self.byte_of = {i: b for b, i in self.byte_ids.items()}
        plain = [i for i in ids if not (i in self.controls or i == self.unknown or i in self.byte_of)]
        self.id_of = {self.text[i]: i for i in plain}
        self.score = {self.text[i]: lib.get_score(i) for i in plain}
        inside = any(re.search(f"[^{SPACE}]{SPACE}", t) for t in self.id_of)
        self.words = re.compile(r"(?s).+" if inside else f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
        self.marks = lib.normalize("a").startswith(SPACE)  # a space mark is put before a text
        self._number()

    def _number(self) -> None:
        """Symbols as numbers: pieces by id, other characters of pieces after them; the table of merges by pair of symbols."""
        n = len(self.text)
        symbols = {**self.id_of, **{c: n + k for k, c in enumerate(sorted({c for t in self.id_of for c in t} - self.id_of.keys()))}}
        self.base = n + len(symbols)
        place = {s: k for k, s in enumerate(sorted(set(self.score.values()), reverse=True))}
        merges = sorted((symbols[t[:k]] * self.base + symbols[t[k:]], place[self.score[t]], i) for t, i in self.id_of.items() for k in range(1, len(t)) if t[:k] in symbols and t[k:] in symbols)
        self.keys, self.places, self.made = (np.array(x, np.int64) for x in zip(*merges)) if merges else (np.zeros(1, np.int64) - 1,) * 3
        #: by code point: the symbol; a single byte's id where a character is no piece; -1 where several bytes stand for it
        self.symbol_of = np.full(0x110000, -1, np.int64)
        for b, i in self.byte_ids.items():
            if b < 128:
                self.symbol_of[b] = i
        for t, i in symbols.items():
            if len(t) == 1:
                self.symbol_of[ord(t)] = i if i < n or not self.byte_ids else -1

    def merges(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of pairs of symbols the place of what they make in the order of scores (NONE if nothing), and its id."""
        key = left * self.base + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.places[at], NONE), self.made[at]

    def lock_step(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of one length, given as rows of symbols (see flat_lists): each round merges every row's best pair, the
        first of equals."""
        count, done, number = np.zeros(len(rows), np.int64), [], np.arange(len(rows))
        place, made = self.merges(rows[:, :-1], rows[:, 1:])
        while len(rows):
            size = rows.shape[1]
            best = place.argmin(axis=1) if size > 1 else np.zeros(len(rows), np.int64)
            on = place[np.arange(len(rows)), best] < NONE if size > 1 else np.zeros(len(rows), bool)
            count[number[~on]] = size
            done.append((number[~on], rows[~on]))
            rows, number, place, made, best = rows[on], number[on], place[on], made[on], best[on]
            if not len(rows):
                break
            each, size = np.arange(len(rows)), size - 1
            rows[each, best] = made[each, best]
            later = np.arange(size) > best[:, None]
            rows = np.where(later, rows[:, 1:], rows[:, :-1])
            place, made = (np.where(later[:, 1:], x[:, 1:], x[:, :-1]) for x in (place, made))
            for side in (best - 1, best):
                fits = np.nonzero((side >= 0) & (side < size - 1))[0]
                at = side[fits]
                place[fits, at], made[fits, at] = self.merges(rows[fits, at], rows[fits, at + 1])
        flat, start = np.zeros(int(count.sum()), np.int32), np.cumsum(count) - count
        for number, rows in done:
            flat[start[number][:, None] + np.arange(rows.shape[1])] = rows
        return count, flat

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words in order of length, as flat_lists gives them."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        edges = [0, *(np.nonzero(np.diff(sizes))[0] + 1).tolist(), len(words)]
        parts = [self._same_size(words[a:b]) for a, b in zip(edges, edges[1:]) if a < b]
        return tuple(np.concatenate(x) for x in zip(*parts)) if parts else flat_lists([])

    def _same_size(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(words[0]) > LONG:
            return flat_lists([self.ids(w) for w in words])
        symbols = self.symbol_of[np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)].reshape(len(words), -1)
        plain = (symbols >= 0).all(axis=1)
        some, flat = self.lock_step(symbols[plain])
        if plain.all():
            return some, flat
        others, rest = flat_lists([self.ids(words[k]) for k in np.nonzero(~plain)[0].tolist()])
        count = np.zeros(len(words), np.int64)
        count[plain], count[~plain] = some, others
        start, out = np.cumsum(count) - count, np.zeros(int(count.sum()), np.int32)
        out[ragged(start[plain], some)], out[ragged(start[~plain], others)] = flat, rest
        return count, out

    def wrong(self, words: list[str], count: np.ndarray, flat: np.ndarray) -> np.ndarray:
        """Places of the words for which the library has other ids; those that it would normalise in another way are left out."""
        if not self.marks:
            return np.zeros(0, np.int64)
        bare = [w[1:] for w in words]
        asked = np.fromiter((w == n for w, n in zip(words, self.library.normalize(bare))), bool, len(words))
        if not asked.all():
            bare = [w for w, ask in zip(bare, asked.tolist()) if ask]
        theirs, found = flat_lists(self.library.encode(bare, num_threads=1))
        at, start = np.nonzero(asked)[0], np.cumsum(count) - count
        same = count[at] == theirs
        ours = flat[ragged(start[at], np.where(same, theirs, 0))]
        differs = ours != found[ragged((np.cumsum(theirs) - theirs)[same], theirs[same])]
        return np.concatenate([at[~same], np.unique(np.repeat(at[same], theirs[same])[differs])])

    def agenda(self, text: str) -> list[str]:
        """The symbols that are left when no pair of neighbours makes a piece."""
        score, symbols = self.score, list(text)
        n = len(symbols)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        agenda = [(-s, k, a, b) for k, (a, b) in enumerate(zip(symbols, symbols[1:])) if (s := score.get(a + b)) is not None]
        heapify(agenda)
        while agenda:
            _, left, a, b = heappop(agenda)
            if symbols[left] != a or (right := after[left]) < 0 or symbols[right] != b:
                continue  # one of them is part of another symbol now
            symbols[left], symbols[right] = a + b, ""
            follows = after[left] = after[right]
            if follows >= 0:
                before[follows] = left
                if (s := score.get(a + b + symbols[follows])) is not None:
                    heappush(agenda, (-s, left, a + b, symbols[follows]))
            if (leads := before[left]) >= 0 and (s := score.get(symbols[leads] + a + b)) is not None:
                heappush(agenda, (-s, leads, symbols[leads], a + b))
        return [t for t in symbols if t]

    def ids(self, stretch: str) -> tuple[int, ...]:
        known, out = self.id_of.get, []
        for symbol in self.agenda(stretch) if len(stretch) > 1 else [stretch]:
            if (i := known(symbol)) is not None:
                out.append(i)
            elif self.byte_ids:
                out.extend(self.byte_ids[b] for b in symbol.encode())
            else:
                out.append(self.unknown)
        return tuple(out)

    def decode_bytes(self, data: bytes) -> str:
        """UTF-8, with a mark for each byte that is part of no character."""
        try:
            return data.decode()
        except UnicodeDecodeError as wrong:
            return data[: wrong.start].decode() + REPLACED + self.decode_bytes(data[wrong.start + 1 :])


class Encoder:
    """Encodes texts batch by batch, with the end id last."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self._forget()

    def _forget(self) -> None:
        self.number: dict[str, int] = {}
        self.start, self.count, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.wrong, self.chars = np.zeros(0, np.int64), 0

    def _learn(self, new: set[str]) -> None:
        words = sorted(new, key=len)
        count, flat = self.pieces.encode_words(words)
        known = len(self.number)
        self.wrong = np.concatenate([self.wrong, known + self.pieces.wrong(words, count, flat)])
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(count) - count])
        self.count, self.flat = np.concatenate([self.count, count]), np.concatenate([self.flat, flat])
        self.number.update(zip(words, range(known, known + len(words))))
        self.chars += sum(map(len, words))

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of ids by text, all ids, and by text whether the library agrees on its words."""
        split = [self.pieces.words.findall(t) for t in self.pieces.library.normalize(texts)]
        if self.chars > KEEP_CHARS:
            self._forget()
        self._learn(set().union(*split) - self.number.keys())
        n_words = np.fromiter(map(len, split), np.int64, len(split))
        of = np.fromiter(map(self.number.__getitem__, chain.from_iterable(split)), np.int64, int(n_words.sum()))
        sums = np.append(0, np.cumsum(self.count[of]))
        ends = np.cumsum(n_words)
        count = sums[ends] - sums[ends - n_words]
        flat = np.full(int(count.sum()) + len(texts), self.pieces.end, np.int32)
        flat[ragged((np.cumsum(count + 1) - count - 1), count)] = self.flat[ragged(self.start[of], self.count[of])]
        bad = np.append(0, np.cumsum(np.isin(of, self.wrong))) if len(self.wrong) else np.zeros(len(of) + 1, int)
        return count + 1, flat, bad[ends] == bad[ends - n_words]


class Decoder:
    """Decodes ids: control ids are nothing, runs of byte ids their UTF-8; the space mark that encoding adds goes."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.shown = ["" if i in pieces.controls else UNKNOWN if i == pieces.unknown else t.replace(SPACE, " ") for i, t in enumerate(pieces.text)]
        for i, b in pieces.byte_of.items():
            self.shown[i] = chr(b) if b < 128 else ""
        self.high = {i: b for i, b in pieces.byte_of.items() if b >= 128}
        raw = [t.encode() for t in self.shown]
        self.count, self.raw = np.array(list(map(len, raw)), np.int64), np.frombuffer(b"".join(raw), np.uint8)
        self.start = np.cumsum(self.count) - self.count
        self.slow, self.marked = np.zeros(len(raw), bool), np.array([t.startswith(SPACE) for t in pieces.text]) & pieces.marks
        self.slow[list(self.high)] = True
        self.control = np.zeros(len(raw), bool)
        self.control[list(pieces.controls)] = True

    def one(self, ids: list[int]) -> str:
        out, run = [], bytearray()
        for i in ids:
            b = self.high.get(i)
            if b is not None:
                run.append(b)
                continue
            if run:
                out.append(self.pieces.decode_bytes(bytes(run)))
                run.clear()
            out.append(self.shown[i])
        out.append(self.pieces.decode_bytes(bytes(run)))
        first = next((i for i in ids if i not in self.pieces.controls), None)
        text = "".join(out)
        return text[1:] if first is not None and self.marked[first] else text

    def __call__(self, count: np.ndarray, flat: np.ndarray) -> pa.Array:
        """Texts of lists of ids (see flat_lists); those with bytes of longer characters, or with a control id first, one by one."""
        ends = np.cumsum(count)
        some = count > 0
        first = np.zeros(len(count), np.int64)
        first[some] = flat[(ends - count)[some]]
        slow = np.zeros(len(count), bool)
        slow[np.repeat(np.arange(len(count)), count)[self.slow[flat]]] = True
        slow |= some & self.control[first]
        shown = np.where(np.repeat(slow, count), 0, self.count[flat])
        raw = self.raw[ragged(self.start[flat], shown)]
        edges = np.append(0, np.cumsum(shown))[np.append(0, ends)]
        mark = some & ~slow & self.marked[first]
        raw = np.delete(raw, edges[:-1][mark])
        edges = edges - np.append(0, np.cumsum(mark))
        out = pa.StringArray.from_buffers(len(count), pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(raw))
        one_by_one = [self.one(flat[e - n : e].tolist()) for e, n in zip(ends[slow].tolist(), count[slow].tolist())]
        return pc.replace_with_mask(out, pa.array(slow), pa.array(one_by_one, pa.string())) if one_by_one else out


def _worker(model: bytes) -> tuple[Encoder, Decoder, sentencepiece.SentencePieceProcessor]:
    def make():
        pieces = Pieces(model)
        return Encoder(pieces), Decoder(pieces), pieces.library

    return kept("sentencepiece", hash(model), make)


def encode(docs: DataFrame, model: bytes, whole_texts: bool = False) -> DataFrame:
    """(doc_id, ids array<int>, text, agrees) of every whole text: its ids with the end id last, what they decode to, and
    whether the library agrees: on the ids of all words of the text or, with whole_texts, on its ids and what they decode to.

    model: the bytes of a model file of merge type. Null and empty texts have the end id only; repeated rows stay;
    columns other than doc_id and text are ignored; an empty table gives an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("text", pa.string()), ("agrees", pa.bool_())])

    def run(batches):
        encoder, decoder, library = _worker(shared.value)
        for whole in batches:
            for batch in by_bytes(whole, "text", SLICE):
                texts = [t or "" for t in batch.column(1).to_pylist()]
                count, flat, agrees = encoder(texts)
                decoded = decoder(count, flat)
                ids = pa.ListArray.from_arrays(np.append(0, np.cumsum(count)).astype(np.int32), flat)
                if whole_texts:
                    ours, lists = zip(ids.to_pylist(), decoded.to_pylist()), library.encode(texts, add_eos=True, num_threads=1)
                    agrees = [one == other for one, other in zip(ours, zip(lists, library.decode(lists, num_threads=1)))]
                yield pa.RecordBatch.from_arrays([batch.column(0), ids, decoded, pa.array(agrees, pa.bool_())], schema=schema)

    return map_arrow(docs.selectExpr("cast(doc_id as long) doc_id", "text"), run, "doc_id long, ids array<int>, text string, agrees boolean", keeps="sentencepiece")


def decode(encoded: DataFrame, model: bytes) -> DataFrame:
    """encoded (doc_id, ids) with `text`; null ids count as none."""
    shared = encoded.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("text", pa.string())])

    def run(batches):
        _, decoder, _ = _worker(shared.value)
        for batch in batches:
            texts = decoder(*flat_lists([ids or [] for ids in batch.column(1).to_pylist()]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), texts], schema=schema)

    return map_arrow(encoded.select("doc_id", "ids"), run, "doc_id long, ids array<int>, text string", keeps="sentencepiece")
