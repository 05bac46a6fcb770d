"""Secrets by fixed patterns and by inferred formats.

Training: values found by the patterns are labelled credentials. Those of a kind make a prefix tree over character
classes, whose states are merged where their counts are statistically compatible (Hoeffding bounds, red states and
blue fringe), giving a probabilistic automaton per kind, which also knows where values end. Scanning: every token of
MIN_VALUE or more of the characters that values consist of is scored, those of base spans too: by the logarithm of its
likelihood under an automaton against that under ordinary tokens, which are modelled over the same characters. A token
that no base span touches gets a span like_<kind> if its score reaches that kind's limit; where several do, the kind
whose score is furthest above its limit counts (of equal ones the first by name).

The automata are fitted on a bounded sample: of each kind the `max_labelled` distinct values with the smallest hash,
whole, and the `max_ordinary` distinct ordinary tokens with the smallest hash. Everything else covers all rows and whole
texts. Null texts are empty. Repeated rows stay. An empty table gives an empty one. With no labelled values no format
spans are added. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, map_arrow, materialize

#: The patterns; on bytes with A-Z lowered for assignments.
ASSIGN = re.compile(rb"(?:password|passwd|secret|token|api_?key)[\"']? *[:=] *[\"']?([a-z0-9+/_.=-]+)")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{32,}")  # runs are maximal, so shorter ones need no look
KINDS = ("assign", "access", "hex")
KEYS = (b"passw", b"secret", b"token", b"api")
MIN_VALUE, MIN_ACCESS = 8, 16
#: Tokens that the automata score.
TOKEN = re.compile(rb"[A-Za-z0-9+/_.=-]{8,}")
#: Distinct tokens whose scores a worker keeps.
KEEP_SCORES = 300_000
SLICE = 4 << 20
MASK = "[SECRET]"

# ---------------------------------------------------------------- patterns


def base_matches(raw: bytes) -> list[tuple[int, int, int, int]]:
    """(kind, start, end, start of the value) in bytes, by start, then kind."""
    out = []
    low = raw.lower()  # A-Z only
    if any(k in low for k in KEYS):
        out += [(0, m.start(), m.end(), m.start(1)) for m in ASSIGN.finditer(low) if m.end(1) - m.start(1) >= MIN_VALUE]
    if b"AKIA" in raw:
        out += [(1, m.start(), m.end(), m.start()) for m in ACCESS.finditer(raw) if m.end() - m.start() >= MIN_ACCESS]
    out += [(2, m.start(), m.end(), m.start()) for m in HEX.finditer(raw)]
    return sorted(out, key=lambda m: (m[1], m[0]))


def code_points(raw: bytes, places: list[int]) -> dict[int, int]:
    """Byte places as places of code points."""
    out, at, chars = {}, 0, 0
    for p in sorted(set(places)):
        chars += len(raw[at:p].decode("utf-8"))
        out[p], at = chars, p
    return out


def free_tokens(raw: bytes, base: list[tuple]) -> list[tuple[int, int]]:
    """Tokens that no pattern span touches."""
    if not base:
        return [m.span() for m in TOKEN.finditer(raw)]
    taken, found, k = [], [], 0
    for s, e in sorted((s, e) for _, s, e, _ in base):  # spans of several kinds may overlap
        if taken and s <= taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], e)
        else:
            taken.append([s, e])
    for m in TOKEN.finditer(raw):
        while k < len(taken) and taken[k][1] <= m.start():
            k += 1
        if k == len(taken) or taken[k][0] >= m.end():
            found.append(m.span())
    return found


# ---------------------------------------------------------------- automata

#: Character classes with their sizes; other characters are classes of their own.
CLASSES = {**dict.fromkeys("abcdef", ("h", 6)), **dict.fromkeys("ghijklmnopqrstuvwxyz", ("l", 20)), **dict.fromkeys("ABCDEF", ("H", 6)), **dict.fromkeys("GHIJKLMNOPQRSTUVWXYZ", ("U", 20)), **dict.fromkeys("0123456789", ("d", 10)), **{c: (c, 1) for c in "+/_.=-"}}
SYMBOLS = "hlHUd+/_.=-"
UNKNOWN = -math.log(len(CLASSES) + 1)


@dataclass
class State:
    seen: int = 0
    ends: int = 0
    next: dict[str, int] = field(default_factory=dict)
    uses: dict[str, int] = field(default_factory=dict)


class Automaton:
    """A probabilistic automaton inferred from strings; states[0] is the start."""

    def __init__(self, strings: list[str], alpha: float = 0.05):
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        self.states = [State()]
        for s in strings:
            self._add("".join(CLASSES[c][0] for c in s if c in CLASSES))
        self._merge_states()

    def _add(self, symbols: str) -> None:
        at = 0
        for c in symbols:
            state = self.states[at]
            state.seen += 1
            state.uses[c] = state.uses.get(c, 0) + 1
            if c not in state.next:
                state.next[c] = len(self.states)
                self.states.append(State())
            at = state.next[c]
        self.states[at].seen += 1
        self.states[at].ends += 1

    def _differ(self, f1: int, n1: int, f2: int, n2: int) -> bool:
        return abs(f1 / n1 - f2 / n2) > self.bound * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))

    def _compatible(self, a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            x, y = (self.states[k] for k in todo.pop())
            if self._differ(x.ends, x.seen, y.ends, y.seen):
                return False
            for c in set(x.uses) | set(y.uses):
                if self._differ(x.uses.get(c, 0), x.seen, y.uses.get(c, 0), y.seen):
                    return False
                if c in x.next and c in y.next:
                    todo.append((x.next[c], y.next[c]))
        return True

    def _fold(self, a: int, b: int) -> None:
        """Add the tree under b to a."""
        todo = [(a, b)]
        while todo:
            i, j = todo.pop()
            x, y = self.states[i], self.states[j]
            x.seen += y.seen
            x.ends += y.ends
            for c, n in y.uses.items():
                x.uses[c] = x.uses.get(c, 0) + n
                if c in x.next:
                    todo.append((x.next[c], y.next[c]))
                else:
                    x.next[c] = y.next[c]

    def _merge_states(self) -> None:
        red = [0]
        while True:
            fringe = [(r, c, self.states[r].next[c]) for r in red for c in sorted(self.states[r].next) if self.states[r].next[c] not in red]
            if not fringe:
                break
            parent, symbol, blue = max(fringe, key=lambda f: self.states[f[2]].seen)
            same = next((r for r in red if self._compatible(r, blue)), None)
            if same is None:
                red.append(blue)
            else:
                self.states[parent].next[symbol] = same
                self._fold(same, blue)
        number = {r: k for k, r in enumerate(red)}
        kept = [self.states[r] for r in red]
        for s in kept:
            s.next = {c: number[t] for c, t in s.next.items()}
        self.states = kept

    def likelihood(self, token: str) -> float:
        """Logarithm; characters without a transition cost more than any of all characters would."""
        at, total = 0, 0.0
        for c in token:
            kind, size = CLASSES[c]
            state = self.states[at]
            if kind not in state.next:
                total += UNKNOWN - 1
                continue
            total += math.log((state.uses[kind] + 0.1) / (state.seen + 0.1 * (len(SYMBOLS) + 1))) - math.log(size)
            at = state.next[kind]
        return total + math.log((self.states[at].ends + 0.1) / (self.states[at].seen + 0.1 * (len(SYMBOLS) + 1)))


class Ordinary:
    """Ordinary tokens: the class of a character, or the end, given the two before."""

    def __init__(self, tokens: list[str]):
        self.uses: dict[tuple[str, str], int] = {}
        self.seen: dict[str, int] = {}
        for t in tokens:
            before = "^^"
            for c in [*(CLASSES[c][0] for c in t if c in CLASSES), "$"]:
                self.uses[before, c] = self.uses.get((before, c), 0) + 1
                self.seen[before] = self.seen.get(before, 0) + 1
                before = before[1] + c

    def likelihood(self, token: str) -> float:
        total, before = 0.0, "^^"
        for c in token:
            kind, size = CLASSES[c]
            total += math.log((self.uses.get((before, kind), 0) + 0.5) / (self.seen.get(before, 0) + 0.5 * (len(SYMBOLS) + 1))) - math.log(size)
            before = before[1] + kind
        return total + math.log((self.uses.get((before, "$"), 0) + 0.5) / (self.seen.get(before, 0) + 0.5 * (len(SYMBOLS) + 1)))


@dataclass
class Formats:
    """What training gives; its size is bounded by the sample."""

    automata: dict[str, Automaton]
    ordinary: Ordinary | None = None
    limits: dict[str, float] = field(default_factory=dict)

    def score(self, token: str, kind: str) -> float:
        """Log-likelihood ratio of a kind against ordinary tokens."""
        return self.automata[kind].likelihood(token) - self.ordinary.likelihood(token)

    def judge(self, token: str) -> tuple[float, str]:
        """How far the best kind's score is above its limit, and that kind."""
        base = self.ordinary.likelihood(token)
        found = [(a.likelihood(token) - base - self.limits.get(kind, math.inf), kind) for kind, a in sorted(self.automata.items())]
        return max(found, key=lambda x: x[0])


def _labelled(most: int):
    """Labelled values, and of each task the `most` distinct ordinary tokens with the smallest hash, with how many
    documents have them: the same tokens in every task, so their numbers add up."""
    schema = pa.schema([("kind", pa.string()), ("token", pa.string()), ("h", pa.int64()), ("n", pa.int64())])
    digest = lambda t: xxhash.xxh64_intdigest(t) >> 1

    def rows(found: dict[tuple[str, bytes], int]) -> pa.RecordBatch:
        columns = [k for k, _ in found], [t.decode() for _, t in found], [digest(t) for _, t in found], list(found.values())
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    def run(batches):
        smallest: dict[bytes, int] = {}
        limit = 1 << 63
        for whole in batches:
            for batch in by_bytes(whole, "text", SLICE):
                labelled: dict = {}
                for text in batch.column(0).to_pylist():
                    raw = (text or "").encode()
                    base = base_matches(raw)
                    for k, _, e, v in base:
                        labelled[KINDS[k], raw[v:e]] = labelled.get((KINDS[k], raw[v:e]), 0) + 1
                    for t in {raw[s:e] for s, e in free_tokens(raw, base)}:
                        if t in smallest:
                            smallest[t] += 1
                        elif digest(t) < limit:
                            smallest[t] = 1
                if len(smallest) > most:
                    kept = sorted(smallest, key=digest)[:most]
                    smallest, limit = {t: smallest[t] for t in kept}, digest(kept[-1]) + 1
                yield rows(labelled)
        yield rows({("ordinary", t): n for t, n in smallest.items()})

    return run, "kind string, token string, h long, n long"


def fit(sample: dict[str, list[str]], repeated: list[str] | None = None, quantile: float = 0.05, margin: float = 3.0, rounds: int = 3) -> Formats:
    """Automata of the kinds in `sample` against its `ordinary` tokens, with their limits.

    Among the ordinary tokens may be credentials that no pattern shows. So, in `rounds` rounds, those that an automaton gives a
    higher likelihood than the model of ordinary tokens are left out and that model is fitted again; tokens that several
    documents have (`repeated`; None: all) stay. A limit is `margin` above every ordinary token that is left. Where all but
    `quantile` of the kind's values are further up, it is midway.
    """
    automata = {k: Automaton(v) for k, v in sample.items() if k != "ordinary" and v}
    tokens = sorted(set(sample["ordinary"]))
    often = set(tokens if repeated is None else repeated)
    best = {t: max((a.likelihood(t) for a in automata.values()), default=-math.inf) for t in tokens}
    formats, left = Formats(automata, Ordinary(tokens)), tokens
    for _ in range(rounds):
        left = [t for t in tokens if t in often or best[t] <= formats.ordinary.likelihood(t)]
        formats.ordinary = Ordinary(left)
    for kind in automata:
        scores = sorted(formats.score(t, kind) for t in sample[kind])
        low, high = max((formats.score(t, kind) for t in left), default=-math.inf) + margin, scores[int(quantile * len(scores))]
        formats.limits[kind] = low if low >= high else high if low == -math.inf else (low + high) / 2
    return formats


def train(docs: DataFrame, max_labelled: int = 1000, max_ordinary: int = 10_000) -> Formats:
    """Automata of the labelled kinds and the limits of format spans."""
    run, schema = _labelled(max_ordinary)
    found = materialize(map_arrow(docs.select("text"), run, schema).groupBy("kind", "token", "h").agg(F.sum("n").alias("n")), "labelled")
    sample = {}
    for kind in (*KINDS, "ordinary"):
        top = found.where(F.col("kind") == kind).orderBy("h", "token").limit(max_ordinary if kind == "ordinary" else max_labelled)
        sample[kind] = [(r["token"], r["n"]) for r in top.collect()]
    return fit({k: [t for t, _ in v] for k, v in sample.items()}, [t for t, n in sample["ordinary"] if n > 1])


# ---------------------------------------------------------------- the job


def _judge(formats: Formats, token: bytes, known: dict[bytes, tuple[float, str]]) -> tuple[float, str]:
    if token not in known:
        if len(known) >= KEEP_SCORES:
            known.clear()
        known[token] = formats.judge(token.decode())
    return known[token]


def scored_spans(text: str | None, formats: Formats, known: dict | None = None) -> list[tuple[str, int, int, float | None]]:
    """(kind, start, end, score) in code points of all spans, by start, then kind as listed; formats come last.

    The score is that of a base span's value under its own kind (null if that has no automaton), or of a format span's
    token, as far as it is above the kind's limit.
    """
    raw, known = (text or "").encode(), {} if known is None else known
    base = base_matches(raw)
    value = lambda k, v, e: formats.score(raw[v:e].decode(), KINDS[k]) - formats.limits[KINDS[k]] if KINDS[k] in formats.automata else None
    found = [(KINDS[k], s, e, k, value(k, v, e)) for k, s, e, v in base]
    if formats.automata:
        for s, e in free_tokens(raw, base):
            above, kind = _judge(formats, raw[s:e], known)
            if above >= 0:
                found.append((f"like_{kind}", s, e, len(KINDS), above))
    if not found:
        return []
    at = code_points(raw, [p for f in found for p in f[1:3]])
    return [(k, at[s], at[e], x) for k, s, e, _, x in sorted(found, key=lambda f: (f[1], f[3]))]


def spans_of(text: str | None, formats: Formats, known: dict | None = None) -> list[tuple[str, int, int]]:
    """scored_spans() without the scores."""
    return [f[:3] for f in scored_spans(text, formats, known)]


SPANS = "array<struct<kind:string,start:long,end:long,score:double>>"
_SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))


def scan(docs: DataFrame, formats: Formats) -> DataFrame:
    """(doc_id, spans) of every document; columns other than doc_id and text are ignored."""
    shared = docs.sparkSession.sparkContext.broadcast(formats)
    schema = pa.schema([("doc_id", pa.int64()), ("spans", _SPAN_TYPE)])

    def run(batches):
        known: dict = {}
        for whole in batches:
            for batch in by_bytes(whole, "text", SLICE):
                spans = [[{"kind": k, "start": s, "end": e, "score": x} for k, s, e, x in scored_spans(t, shared.value, known)] for t in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, _SPAN_TYPE)], schema=schema)

    return map_arrow(docs.selectExpr("cast(doc_id as long) doc_id", "text"), run, f"doc_id long, spans {SPANS}")


def mask_text(text: str, spans: list[tuple[str, int, int]]) -> str:
    out, at = [], 0
    for _, s, e in spans:
        if s >= at:
            out += [text[at:s], MASK]
        at = max(at, e)
    return "".join([*out, text[at:]])


def mask(docs: DataFrame, formats: Formats) -> DataFrame:
    """docs with every span in text replaced by MASK (runs of overlapping spans by one); null texts stay null.

    n_chars, if there, becomes the length of a text that changed.
    """
    shared = docs.sparkSession.sparkContext.broadcast(formats)

    @F.pandas_udf("string")
    def masked(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict = {}
        for texts in parts:
            yield texts.map(lambda t: t if t is None else mask_text(t, spans_of(t, shared.value, known)))

    out = docs.withColumn("__masked", masked("text"))
    changed = {"text": F.col("__masked").alias("text")}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        changed["n_chars"] = F.when(F.col("__masked") != F.col("text"), F.length("__masked").cast(kind)).otherwise(F.col("n_chars")).alias("n_chars")
    return out.select(*[changed.get(c, F.col(c)) for c in docs.columns])
