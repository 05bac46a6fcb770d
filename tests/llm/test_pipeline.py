"""The pipeline stage by stage, each on what the one before it kept."""

import collections

import corpus_pipeline
from omicsgraph.llm.common import materialize

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    from test_similar import brute_kept
    from test_text_operators import base_spans

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = {r.doc_id: r for r in docs.collect()}
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, SF), name)
        kept.append(docs.collect())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    language, near, secrets, mixed, encoded = kept
    assert len(language) >= 0.98 * len(before) and all(before[r.doc_id] == r for r in language)
    rows = sorted(language, key=lambda r: r.doc_id)
    assert sorted(r.doc_id for r in near) == sorted(brute_kept([(r.doc_id, r.text) for r in rows]))
    assert sorted(r.doc_id for r in secrets) == sorted(r.doc_id for r in near)
    for r in secrets:
        old = before[r.doc_id]
        assert (r.text != old.text) >= bool(base_spans(old.text)) and (r.n_chars == len(r.text) or r.text == old.text)
    copies = collections.Counter(r.doc_id for r in mixed)
    assert max(copies.values()) <= 3 and set(copies) <= {r.doc_id for r in secrets}
    clean = {r.doc_id: r.text for r in secrets}
    assert collections.Counter(r.doc_id for r in encoded) == copies and all(r.text == clean[r.doc_id] and r.ids for r in encoded if clean[r.doc_id])


def test_odd_rows(spark, edge_docs):
    docs = edge_docs.select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in corpus_pipeline.STAGES[1:]:
        docs = materialize(stage(spark, docs, SF), name)
    assert docs.columns == ["doc_id", "ids", "text"]
    empty = edge_docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        empty = materialize(stage(spark, empty, SF), name)
    assert empty.count() == 0


def test_run(spark):
    import __spark_entry__

    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run
    assert corpus_pipeline.run(spark, SF).count() > 50
