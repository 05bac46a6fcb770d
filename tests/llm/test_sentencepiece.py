"""Encoding and decoding against the sentencepiece library."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from omicsgraph.llm import sentencepiece_bpe as sp

MODEL = open(public_tokenizers.path("piece_bpe_32k.model"), "rb").read()
LIBRARY = sentencepiece.SentencePieceProcessor(model_proto=MODEL)
BITS = ["a", "b", "th", "e ", " ", "  ", "▁", "\n", "\t", "漢", "🙂", "é", "é", "\0", "<unk>", "</s>", "<0x0A>", "�", "ﬁ", "     ", "the", "ing", "\xa0", "12", "ß", "\U0010ffff", "\x85", "zzzzz"]


def lists(count, flat):
    return [x.tolist() for x in np.split(flat, np.cumsum(count)[:-1])]


def random_texts():
    rng = random.Random(4)
    some = ["".join(rng.choice(BITS) for _ in range(rng.randint(0, 30))) for _ in range(5000)]
    return some + ["".join(rng.choice("abcdething") for _ in range(rng.randint(0, 600))) for _ in range(300)] + ["x" * 3000, "0" * 129, " " * 500]


@pytest.mark.parametrize("long", [128, 0])
def test_random_texts(monkeypatch, long):
    """In lock-step, and with a heap for every word."""
    monkeypatch.setattr(sp, "LONG", long)
    pieces, texts = sp.Pieces(MODEL), random_texts()
    count, flat, agrees = sp.Encoder(pieces)(texts)
    want = LIBRARY.encode(texts, add_eos=True)
    assert lists(count, flat) == want and agrees.all()
    assert sp.Decoder(pieces)(count, flat).to_pylist() == LIBRARY.decode(want)


def test_random_ids():
    rng = random.Random(5)
    ids = [[rng.choice([rng.randrange(32_000), rng.randrange(262)]) for _ in range(rng.randint(0, 9))] for _ in range(5000)]
    assert sp.Decoder(sp.Pieces(MODEL))(*sp.flat_lists(ids)).to_pylist() == [LIBRARY.decode(i) for i in ids]


def test_words_are_forgotten_within_bounds(monkeypatch):
    monkeypatch.setattr(sp, "KEEP_CHARS", 200)
    encoder, texts = sp.Encoder(sp.Pieces(MODEL)), random_texts()
    for at in range(0, 1000, 50):
        count, flat, _ = encoder(texts[at : at + 50])
        assert lists(count, flat) == LIBRARY.encode(texts[at : at + 50], add_eos=True)
        assert encoder.chars < 200 + sum(map(len, texts[at : at + 50])) + 50


def test_disagreement_is_seen():
    """A wrong score order is found by the check on words."""
    pieces = sp.Pieces(MODEL)
    pieces.places = -pieces.places
    texts = ["nothing", "international understanding", ""]
    count, flat, agrees = sp.Encoder(pieces)(texts)
    assert agrees.tolist() == [a == b for a, b in zip(lists(count, flat), LIBRARY.encode(texts, add_eos=True))] and not agrees.all()


@pytest.mark.parametrize("whole_texts", [False, True])
def test_documents(spark, edge_docs, whole_texts):
    want = sorted((str(r.doc_id), LIBRARY.encode(r.text or "", add_eos=True)) for r in edge_docs.collect())
    got = sp.encode(edge_docs, MODEL, whole_texts=whole_texts)
    rows = got.collect()
    assert sorted((str(r.doc_id), r.ids) for r in rows) == want and all(r.agrees for r in rows)
    assert all(r.text == LIBRARY.decode(r.ids) for r in rows)
    assert sorted((str(r.doc_id), r.text) for r in sp.decode(got, MODEL).collect()) == sorted((str(r.doc_id), r.text) for r in rows)
    assert sp.encode(edge_docs.limit(0), MODEL).count() == 0


def test_query(spark):
    from omicsgraph.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in QUERIES["op12_sentencepiece"](spark, sf).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = LIBRARY.encode(r.text or "", add_eos=True)
        assert (got[r.doc_id].n_tokens, got[r.doc_id].ids_sha256, got[r.doc_id].decoded_sha256, got[r.doc_id].agrees) == (len(ids), sha(" ".join(map(str, ids))), sha(LIBRARY.decode(ids)), True)
