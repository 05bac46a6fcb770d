"""Files, intervals, graph and score operators on small cases."""

import gzip
import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from omicsgraph.functions import vectors as V
from omicsgraph.operators import chains, enrichment, evaluation, genome, graph, grid, ranking, scoring, variants
from omicsgraph.operators.embed import TokenTable, embed_sequences
from omicsgraph.plans import reference_graph
from omicsgraph.sources import tables, text


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_fasta(spark, tmp_path):
    (tmp_path / "g.fa").write_text(">Chr1 first\r\nACG\r\nTac\r\n>Chr2\nGG\n\n>Chr3\n")
    g = text.read_fasta(spark, str(tmp_path / "g.fa"))
    assert rows(g) == [("Chr1", "ACGTac"), ("Chr2", "GG"), ("Chr3", "")]
    assert rows(text.tile_genome(g, 4)) == [("Chr1", 0, 1, "ACGT"), ("Chr1", 1, 5, "AC"), ("Chr2", 0, 1, "GG")]


def test_lines_and_labels(spark, tmp_path):
    with gzip.open(tmp_path / "l.txt.gz", "wt") as f:
        f.write("sample_id\tlabel\r\nA\t1.5\r\nB\t2\r\nA\t3\r\n")
    lines = text.read_lines(spark, str(tmp_path / "l.txt.gz"), partitions=3)
    assert rows(text.parse_labels(lines)) == [("A", 3.0), ("B", 2.0)]


def test_vcf(spark):
    head = ["##x", "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "Q", "F", "I", "FORMAT", "S1", "S2"])]
    body = ["\t".join(["1", "5", ".", "A", "T,G", ".", ".", ".", "GT:DP", "0/1:3", "./."]), "\t".join(["1", "6", ".", "A", ".", ".", ".", ".", "GT", "1", "1|2"])]
    lines = spark.createDataFrame(list(enumerate(head + body)), "line_no long, line string")
    site, calls = text.parse_vcf(lines)
    assert rows(site) == [(2, "1", 5, "A", ["T", "G"]), (3, "1", 6, "A", [])]
    assert rows(calls) == [(2, "S1", 0, 1), (2, "S2", -1, -1), (3, "S1", 1, 1), (3, "S2", 1, 2)]
    assert rows(text.parse_vcf(lines, ["S2", "S9"])[1]) == [(2, "S2", -1, -1), (3, "S2", 1, 2)]


def test_tables(spark, tmp_path):
    df = spark.createDataFrame([("S", "gene", "g", [1.0, 2.0]), ("S", "region", "r", [0.5, 0.0])], "sample_id string, node_type string, node_id string, x array<double>")
    tables.write_embeddings(df, str(tmp_path / "e"))
    back = tables.read_embeddings(spark, str(tmp_path / "e"))
    assert rows(back.select(*df.columns)) == rows(df)
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "sample_A.1_mutant_graph.pt").write_text("x")
    assert [r[0] for r in tables.discover_samples(tables.list_files(spark, str(tmp_path / "f"))).collect()] == ["A.1"]


def test_merge_and_hits(spark):
    loci = spark.createDataFrame([("c", a, b) for a, b in ((1, 10), (5, 8), (11, 20), (30, 40))], "chrom string, start long, end long")
    got = {g: [(r.start, r.end) for r in variants.merge_intervals(loci, g).orderBy("start").collect()] for g in (0, 1, 10)}
    assert got == {0: [(1, 10), (11, 20), (30, 40)], 1: [(1, 20), (30, 40)], 10: [(1, 40)]}
    for stretch in (4, 10, 30):  # runs that go on over stretches
        assert {g: [(r.start, r.end) for r in variants.merge_intervals(loci, g, stretch).orderBy("start").collect()] for g in (0, 1, 10)} == got
    rng = np.random.default_rng(1)
    many = [("gene", f"g{k}", "c", int(s), int(s + w), "+") for k, (s, w) in enumerate(zip(rng.integers(1, 20_000, 80), rng.integers(0, 9000, 80)))]
    snps = [(f"s{k % 5}", "c", int(p)) for k, p in enumerate(rng.integers(1, 30_000, 60))]
    hit = variants.loci_hit_by_snps(spark.createDataFrame(many, "kind string, locus_id string, chrom string, start long, end long, strand string"), spark.createDataFrame(snps, "sample_id string, chrom string, pos long"), 512)
    assert {(r.sample_id, r.locus_id) for r in hit.collect()} == {(s, m[1]) for s, _, p in snps for m in many if m[3] <= p <= m[4]}


def test_apply_snps(spark):
    seqs = spark.createDataFrame([("gene", "p", "c", 10, 15, "+", "ACGTAC"), ("gene", "m", "c", 10, 15, "-", "ACGTAC")], "kind string, locus_id string, chrom string, start long, end long, strand string, seq string")
    snps = spark.createDataFrame([("s", "c", 12, "T"), ("s", "c", 15, "G"), ("s", "c", 20, "A")], "sample_id string, chrom string, pos long, alt string")
    assert rows(variants.apply_snps(seqs, snps).select("locus_id", "seq")) == [("m", "CTAAGT"), ("p", "ACTTAG")]


def test_loci_sequence_clamps(spark):
    tiles = text.tile_genome(spark.createDataFrame([("c", "ACGTACGTAC")], "chrom string, seq string"), 4)
    loci = spark.createDataFrame([("a", "c", -3, 2), ("b", "c", 3, 99), ("x", "c", 50, 60), ("y", "z", 1, 2), ("r", "c", 5, 4)], "locus_id string, chrom string, start long, end long")
    assert rows(genome.extract_locus_seq(loci, tiles, 4).select("locus_id", "seq")) == [("a", "AC"), ("b", "GTACGTAC")]


def test_regions_and_edges(spark):
    one = spark.createDataFrame([("Chr1:1-5",)], "region_id string")
    got = graph.collect_regions({"motif": one, "promoter500": one, "chip": one})
    assert rows(got) == [("Chr1:1-5", "Chr1", 1, 5, "promoter_500")]
    nodes = spark.createDataFrame([("gene", k) for k in "dbca"] + [("tf", "z")], "node_type string, node_id string")
    assert {(r.node_type, r.node_id): r.node_ix for r in graph.assign_node_index(nodes).collect()} == {("gene", "a"): 0, ("gene", "b"): 1, ("gene", "c"): 2, ("gene", "d"): 3, ("tf", "z"): 0}


def test_sync_tf_is_strict(spark):
    nodes = spark.createDataFrame([(1, "gene", "g", [1.0]), (1, "tf", "g", [0.0]), (1, "tf", "h", [5.0])], "sample_id long, node_type string, node_id string, x array<double>")
    with pytest.raises(Exception, match="TF without gene"):
        graph.sync_tf(nodes).collect()
    assert (1, "tf", "h", [5.0]) in rows(graph.sync_tf(nodes, strict=False))


@pytest.mark.parametrize("mode", ["mean", "attention"])
def test_gradient(spark, mode):
    """The closed form against finite differences."""
    rng = np.random.default_rng(2)
    z = rng.normal(size=(5, 4))
    w1, b1, w2 = rng.normal(size=(3, 4)), rng.normal(size=3), rng.normal(size=3)
    a, b = rng.normal(size=4), 0.3

    def y(z):
        w = np.exp(z @ a + b)
        g = z.mean(axis=0) if mode == "mean" else (w / w.sum()) @ z
        return w2 @ np.maximum(w1 @ g + b1, 0)

    grad = np.zeros_like(z)
    for i in np.ndindex(z.shape):
        e = np.zeros_like(z)
        e[i] = 1e-6
        grad[i] = (y(z + e) - y(z - e)) / 2e-6
    df = spark.createDataFrame([(1, k, z[k].tolist()) for k in range(5)], "sample_id long, gene_id long, z array<double>")
    got = scoring.gradient_x_input(df, scoring.Head(w1.tolist(), b1.tolist(), w2.tolist()), mode, (a.tolist(), b) if mode == "attention" else None)
    assert np.allclose([r.score for r in got.orderBy("gene_id").collect()], np.abs(z * grad).sum(axis=1), atol=1e-6)


def test_scores_and_ranks(spark):
    z = spark.createDataFrame([(1, "gene", "a", [1.0, -2.0]), (1, "tf", "b", [3.0, 4.0])], "sample_id long, node_type string, node_id string, z array<double>")
    e = spark.createDataFrame([(1, "gene", "r", "tf", "a", "b"), (2, "gene", "r", "tf", "a", "b")], "edge_ix long, src_type string, rel string, dst_type string, src_id string, dst_id string")
    assert [r.score for r in scoring.interaction_scores(e, z).collect()] == [11.0, 11.0]
    s = spark.createDataFrame([(1, "g", 2.0), (2, "g", 4.0), (1, "h", 3.0)], "sample_id long, gene_id string, score double")
    assert rows(scoring.gene_importance(s)) == [("g", 3.0, 1), ("h", 1.5, 2)]
    many = spark.range(0, 5000).select(F.col("id").cast("string").alias("id"), (F.col("id") % 7).cast("double").alias("score")).repartition(5)
    ranked = ranking.rank_genes(many).orderBy("rank").collect()
    assert [r.rank for r in ranked] == list(range(1, 5001))
    assert [(-r.score, r.id) for r in ranked] == sorted((-r.score, r.id) for r in ranked)


def test_enrichment(spark):
    df = spark.createDataFrame([(2, 10, 4, 3), (4, 10, 4, 3), (0, 10, 4, 3)], "k long, m long, n long, b long")
    p = [r[0] for r in df.select(enrichment.hypergeom_sf(*map(F.col, ("k", "m", "n", "b")))).collect()]
    assert np.allclose(p, [1 / 3, 0, 1])
    q = enrichment.bh_fdr(spark.createDataFrame([("s", x) for x in (0.01, 0.04, 0.03, 0.005)], "s string, pvalue double"), ["s"])
    assert [round(r.fdr, 9) for r in sorted(q.collect(), key=lambda r: r.pvalue)] == [0.02, 0.02, 0.04, 0.04]
    g = spark.createDataFrame([("s", "a", 1.0), ("s", "b", 2.0), ("s", "c", None)], "s string, gene_id string, weight double")
    assert rows(enrichment.overlap_gene_list(g, ["s"], 2)) == [("s", "b,a")]
    assert rows(enrichment.overlap_gene_list(g, ["s"], 0)) == [("s", "")]


def test_tails_of_large_backgrounds(spark):
    """Digits are not lost with the background's size: to 1e-8 of exact sums of fractions."""
    cases = [(3, 1_000_000, 50, 1000), (2, 1_200_000, 400, 2000), (40, 1_150_001, 20_000, 1500)]
    exact = [float(sum(Fraction(math.comb(n, x) * math.comb(m - n, b - x), math.comb(m, b)) for x in range(k, min(n, b, k + 60) + 1))) for k, m, n, b in cases]
    df = spark.createDataFrame(cases, "k long, m long, n long, b long").coalesce(1)
    p = [r[0] for r in df.select(enrichment.hypergeom_sf(*map(F.col, ("k", "m", "n", "b")))).collect()]
    assert np.allclose(p, exact, rtol=1e-8, atol=0)


def test_sets(spark):
    one = lambda s: spark.createDataFrame([(c,) for c in s], "gene_id string")
    ops = chains.gene_set_ops(one("abca"), one("bcde"))
    assert rows(ops["intersection"]) == [("b",), ("c",)] and rows(ops["added_by_chip"]) == [("d",), ("e",)]
    assert rows(chains.overlap(one("aab"), one("bc"), one("b"))) == [("b",)]


def test_evaluation(spark):
    log = spark.createDataFrame([(1, 3.0), (2, float("nan")), (3, 2.0), (4, 2.0)], "epoch int, val_mse double")
    assert rows(evaluation.best_epoch(log)) == [(3, 2.0)]
    m = evaluation.regression_metrics(spark.createDataFrame([(1.0, 2.0)], "y_true double, y_pred double")).first()
    assert m.mse == 1.0 and m.r2 is None
    with pytest.raises(ValueError):
        evaluation.match_labels(spark.createDataFrame([("a",)], "sample_id string"), spark.createDataFrame([("b", 1.0)], "sample_id string, label double"))


def test_embedding(spark):
    e = TokenTable({"A": [1.0, 0.0], "C": [0.0, 1.0]})
    df = spark.createDataFrame([("x", "AC", 4), ("e", "", 0), ("n", None, 0)], "k string, seq string, fixed_len int")
    got = {r.k: r.x for r in embed_sequences(df, e, 2, ["k"], strands=None).collect()}
    assert got == {"x": [0.25, 0.25], "e": [0.0, 0.0], "n": [0.0, 0.0]}
    tokens = spark.createDataFrame([(1, 0, [1.0, 0.0], False), (1, 1, [0.0, 1.0], False), (1, 2, [9.0, 9.0], True), (2, 0, [9.0, 9.0], True)], "s int, token_ix int, x array<double>, is_pad boolean")
    assert rows(V.pool_tokens(tokens, ["s"])) == [(1, [0.5, 0.5]), (2, [0.0, 0.0])]
    assert rows(V.pool_tokens(tokens.where("s = 1"), ["s"], "cls")) == [(1, [1.0, 0.0])]


def test_fasta_by_lines(spark, tmp_path):
    """Tiles made of lines equal those of whole records, however lines fall into chunks and files into splits."""
    rng = np.random.default_rng(4)
    (tmp_path / "fa").mkdir()
    for k in range(3):
        body = ["; no header yet", ""] if k == 2 else []
        for c in range(5):
            seq = "".join(rng.choice(list("ACGTacgtn"), rng.integers(0, 400)))
            body += [f">chr{k}_{c} x", *[seq[a : a + 17] + (" " if a % 3 else "") for a in range(0, len(seq), 17)], ""]
        (tmp_path / "fa" / f"{k}.fa").write_bytes(("\r\n" if k else "\n").join(body).encode())
    want = rows(text.tile_genome(text.read_fasta(spark, str(tmp_path / "fa")).where("chrom like 'chr%'"), 50))
    assert len(want) > 30
    for chunk in (1, 3, 1000):
        assert rows(text.read_fasta_tiles(spark, str(tmp_path / "fa"), 50, chunk)) == want
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300b")
    try:
        assert rows(text.read_fasta_tiles(spark, str(tmp_path / "fa"), 50, 7)) == want
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_vcf_files(spark, tmp_path):
    """Two files with the same samples in another order: genotypes, carriers and counts go by each file's header."""
    head = "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "Q", "F", "I", "FORMAT"])
    rec = lambda chrom, pos, *calls: "\t".join([chrom, str(pos), ".", "A", "T", ".", ".", ".", "GT", *calls])
    (tmp_path / "v").mkdir()
    (tmp_path / "v" / "1.vcf").write_text("\n".join(["##x", head + "\tS1\tS2", rec("1", 5, "0/1", "0/0"), rec("1", 9, "./.", "1")]) + "\n")
    (tmp_path / "v" / "2.vcf").write_text("\n".join(["##x", head + "\tS2\tS1\tS3", rec("2", 7, "1|1", "0|0", "2/1")]) + "\n")
    lines = text.read_lines(spark, str(tmp_path / "v"))
    site, calls = text.parse_vcf(lines)
    got = site.join(calls, "rec_ix").select("chrom", "pos", "sample_id", "a1", "a2")
    want = [("1", 5, "S1", 0, 1), ("1", 5, "S2", 0, 0), ("1", 9, "S1", -1, -1), ("1", 9, "S2", 1, 1), ("2", 7, "S1", 0, 0), ("2", 7, "S2", 1, 1), ("2", 7, "S3", 2, 1)]
    assert rows(got) == want
    sparse, names = text.parse_vcf_carriers(lines)
    assert rows(variants.carried_snps(sparse, names)) == rows(variants.sample_snps(site, calls)) == [("S1", "1", 5, "T"), ("S2", "1", 9, "T"), ("S2", "2", 7, "T"), ("S3", "2", 7, "T")]
    assert rows(variants.carried_snps(sparse, names.where("sample_id = 'S3'"))) == [("S3", "2", 7, "T")]
    checked = sparse.withColumn("ref_ok", F.col("pos") != 9)
    plain = variants.snp_extraction_stats(site, calls).drop("ref_mismatch")
    assert rows(variants.carried_stats(checked, names).drop("ref_mismatch")) == rows(plain)
    assert {(r.sample_id, r.chrom): r.ref_mismatch for r in variants.carried_stats(checked, names).collect()}["S2", "1"] == 1


def test_headers_of_files(spark, tmp_path):
    (tmp_path / "l").mkdir()
    (tmp_path / "l" / "1.txt").write_text("sample_id\tlabel\nA\t1\n")
    (tmp_path / "l" / "2.txt").write_text("label\tx\tsample_id\n2\t-\tB\n")
    lines = text.read_lines(spark, str(tmp_path / "l"))
    assert rows(text.parse_labels(lines)) == [("A", 1.0), ("B", 2.0)]
    assert rows(text.parse_pairs(lines)) == [("2", "-"), ("A", "1")]


def test_bins_hold_wide_loci(spark):
    """A locus is one row after binning, however wide; every pair is found once."""
    rng = np.random.default_rng(6)
    spans = [(int(s), int(s + w)) for s, w in zip(rng.integers(-500, 3_000_000, 200), 10 ** rng.uniform(0, 6.5, 200))] + [(1, 10**9), (4095, 4096), (7, 7)]
    places = [int(p) for p in rng.integers(1, 4_000_000, 300)] + [1, 4095, 4096, 7]
    loci = spark.createDataFrame([("c", k, a, b) for k, (a, b) in enumerate(spans)], "chrom string, k long, start long, end long")
    sites = spark.createDataFrame([("c", p, i) for i, p in enumerate(places)], "chrom string, pos long, i long")
    got = sorted((r.i, r.k) for r in variants.sites_in_loci(sites, loci, 64).collect())
    assert got == sorted((i, k) for i, p in enumerate(places) for k, (a, b) in enumerate(spans) if a <= p <= b)
    inside = variants.snps_in_intervals(sites, loci.where("k % 2 = 1"), 64)
    assert sorted(r.i for r in inside.collect()) == [i for i, p in enumerate(places) if any(a <= p <= b for k, (a, b) in enumerate(spans) if k % 2)]


def test_splicing_over_tiles(spark):
    rng = np.random.default_rng(8)
    seq = "".join(rng.choice(list("ACGT"), 900))
    loci = [("gene" if k % 3 else "region", f"l{k}", "c", int(a), int(a + w), "-" if k % 2 else "+") for k, (a, w) in enumerate(zip(rng.integers(-20, 950, 60), rng.integers(0, 120, 60)))]
    snps = {(f"s{s}", int(p)): "ACGT"[int(p + s) % 4] for s in range(4) for p in rng.integers(1, 1000, 30)}
    tiles = text.tile_genome(spark.createDataFrame([("c", seq)], "chrom string, seq string"), 64)
    made, seqs = variants.mutated_loci(spark.createDataFrame(loci, "kind string, locus_id string, chrom string, start long, end long, strand string"), tiles, spark.createDataFrame([(s, "c", p, a) for (s, p), a in snps.items()], "sample_id string, chrom string, pos long, alt string"), 64)
    got = {(r.sample_id, r.locus_id): r.seq for r in made.join(seqs, ["kind", "locus_id", "h1", "h2"]).collect()}
    want = {}
    for s in {s for s, _ in snps}:
        for kind, name, _, a, b, strand in loci:
            mine = [p for q, p in snps if q == s and a <= p <= b]
            if mine and max(a, 1) <= min(b, len(seq)):
                base = [snps.get((s, p), seq[p - 1]) for p in range(max(a, 1), min(b, len(seq)) + 1)]
                want[s, name] = "".join(base) if kind == "region" or strand == "+" else "".join(base)[::-1].translate(str.maketrans("ACGT", "TGCA"))
    assert got == want


def test_stored_embeddings_meet_without_shuffle(spark, tmp_path):
    """Tables in buckets: few files whatever the number of samples, and no exchange of either table in the overlay's joins."""
    nodes = spark.range(200).selectExpr("'gene' node_type", "cast(id as string) node_id", "array(double(id)) x")
    delta = spark.range(2000).selectExpr("cast(id % 50 as string) sample_id", "'gene' node_type", "cast(id % 210 as string) node_id", "array(double(-id)) x").dropDuplicates(["sample_id", "node_id"])
    for name, df in (("stored_nodes", nodes), ("stored_delta", delta)):
        tables.store_embeddings(df, name, 4, str(tmp_path / name))
        assert len(list((tmp_path / name).glob("*.parquet"))) <= 4
    samples = spark.range(60).selectExpr("cast(id as string) sample_id")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = graph.overlay_stored(spark.table("stored_nodes"), spark.table("stored_delta"), samples)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(node_type" not in plan and "SortMergeJoin" in plan
        assert rows(got) == rows(graph.overlay_deltas(nodes, delta, samples).selectExpr("sample_id", "node_type", "node_id", "x"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.sql("drop table stored_nodes")
        spark.sql("drop table stored_delta")


def random_graph(spark, n_nodes=60, n_edges=400, n_samples=7, dim=5):
    rng = np.random.default_rng(12)
    z = {k: rng.normal(size=dim) * rng.choice([0.1, 1, 5]) for k in range(n_nodes)}
    kind = lambda k: "gene" if k % 3 else "region"
    edges = [(e, kind(a), "r", kind(b), str(a), str(b)) for e, (a, b) in enumerate(zip(rng.integers(0, n_nodes, n_edges) ** 2 // n_nodes, rng.integers(0, n_nodes + 5, n_edges)))]
    own = {(s, k): rng.normal(size=dim) for s in range(n_samples - 2) for k in range(n_nodes + 3) if rng.random() < 0.15}
    schema = "edge_ix long, src_type string, rel string, dst_type string, src_id string, dst_id string"
    frame = lambda rows, first: spark.createDataFrame(rows, first + "node_type string, node_id string, z array<double>")
    full = frame([(s, kind(k), str(k), own.get((s, k), z[k]).tolist()) for s in range(n_samples) for k in z], "sample_id long, ")
    return spark.createDataFrame(edges + edges[:9], schema), frame([(kind(k), str(k), v.tolist()) for k, v in z.items()], ""), frame([(s, kind(k), str(k), v.tolist()) for (s, k), v in own.items()], "sample_id long, "), full, n_samples


@pytest.mark.parametrize("cells", [None, (1, 1), (4, 3), (8, 7)])
def test_scores_over_a_grid(spark, monkeypatch, cells):
    """Equal scores whatever the grid, for whole samples and for sparse ones; hot cells are dealt further."""
    edges, base, own, full, n = random_graph(spark)
    if cells:
        monkeypatch.setattr(grid, "shape", lambda *_: cells)
        monkeypatch.setattr(grid, "CELL_EDGES", 10)
    z = {(r.sample_id, r.node_id): np.array(r.z) for r in full.collect()}
    want = sorted((r.edge_ix, round(float(np.mean([np.abs(z[s, r.src_id] * z[s, r.dst_id]).sum() for s in range(n)])), 9)) for r in edges.collect() if (0, r.src_id) in z and (0, r.dst_id) in z)
    assert sorted((r.edge_ix, round(r.score, 9)) for r in scoring.interaction_scores(edges, full).collect()) == want
    assert sorted((r.edge_ix, round(r.score, 9)) for r in scoring.sparse_interaction_scores(edges, base, own, n).collect()) == want


def test_grid_shape():
    assert grid.shape(10, 1, 10, 0, 1) == (1, 1)
    blocks, groups = grid.shape(10**9, 1000, 10**13, 10**10, 4000)
    assert 2 * (10**13 / groups + 10**10) <= grid.CELL_BYTES * blocks and groups <= 1000 and blocks**2 * groups >= 4000
    assert grid.shape(100, 3, 1000, 1000, 8)[0] ** 2 * grid.shape(100, 3, 1000, 1000, 8)[1] >= 8


def test_top_edges_by_bounds(spark):
    """Exact, with fewer edges scored than there are."""
    edges, base, own, _, n = random_graph(spark, n_edges=3000)
    top, scored = scoring.top_interactions(edges, base, own, n, 5, first=1)
    want = ranking.top_edges(scoring.sparse_interaction_scores(edges, base, own, n), 5)
    key = lambda r: (r.src_type, r.dst_type, r["rank"], r.edge_ix, round(r.score, 9))
    assert sorted(map(key, top.collect())) == sorted(map(key, want.collect()))
    assert scored < 0.6 * edges.count()


def test_bh_by_ranges(spark):
    rng = np.random.default_rng(13)
    p = np.concatenate([rng.random(3000) ** 3, np.full(1500, 0.25), np.ones(500)])
    df = spark.createDataFrame([("a" if k % 4 else None, k, float(v)) for k, v in enumerate(p)] + [("a", -1, None)], "s string, k long, pvalue double").repartition(8)
    got = {r.k: r.fdr for r in enrichment.bh_fdr(df, ["s"]).collect()}
    for group in (np.arange(len(p)) % 4 == 0, np.arange(len(p)) % 4 != 0):
        at = np.flatnonzero(group)
        order = at[np.argsort(p[at], kind="stable")]
        q = np.minimum.accumulate((p[order] * len(at) / np.arange(1, len(at) + 1))[::-1])[::-1]
        assert np.allclose([got[k] for k in order.tolist()], np.minimum(1, q), rtol=1e-12)
    assert got[-1] is None
    assert enrichment.bh_fdr(df.select("k", "pvalue").limit(0), []).count() == 0


def test_bitmaps(spark):
    rng = np.random.default_rng(14)
    genes = [f"g{k}" for k in range(300)]
    fg = [(f"s{s}", g, float(rng.integers(0, 5))) for s in range(3) for g in rng.choice(genes + ["x1", "x2"], 80)]
    ann = [(g, f"t{t}") for t in range(20) for g in rng.choice(genes + ["y"], 40)]
    sets, terms = {}, {}
    for s, g, _ in fg:
        sets.setdefault(s, set()).add(g)
    for g, t in ann:
        terms.setdefault(t, set()).add(g)
    frames = spark.createDataFrame(fg, "set_name string, gene_id string, weight double"), spark.createDataFrame([(g,) for g in genes * 2], "gene_id string"), spark.createDataFrame(ann, "gene_id string, go_id string")
    bg = set(genes)
    want = sorted((s, t, len(a & b & bg), len(b & bg), len(a & bg), 300) for s, a in sets.items() for t, b in terms.items() if len(a & b & bg) >= 6 and len(b & bg) >= 30)
    assert rows(enrichment.go_counts(*frames, 30, 6)) == sorted(want, key=str)
    found = enrichment.go_enrichment(*frames, min_bg=30, min_overlap=6).collect()
    assert len(found) == len(want) and all(set(r.overlap_genes.split(",")) == sets[r.set_name] & terms[r.go_id] & bg for r in found)


def repeated_genes(spark):
    """Frames of gene sets, background and annotation where rows repeat ids, and counts (k, n, big_n, m) of rows by set and term."""
    rng = np.random.default_rng(15)
    bg = [f"g{k}" for k in range(200) for _ in range(1 + 70 * (k == 3) + k % 3)]
    fg = [(f"s{s}", bg[k], float(rng.integers(0, 5))) for s in range(3) for k in np.flatnonzero(rng.random(len(bg)) < 0.3)]
    ann = [(g, f"t{t}") for t in range(12) for g in sorted({f"g{k}" for k in rng.integers(0, 210, 40)})]
    want = {}
    for t in sorted({t for _, t in ann}):
        of = {g for g, x in ann if x == t}
        for s in sorted({s for s, _, _ in fg}):
            mine = [g for x, g, _ in fg if x == s]
            want[s, t] = (sum(g in of for g in mine), sum(g in of for g in bg), len(mine), len(bg))
    frames = spark.createDataFrame(fg, "set_name string, gene_id string, weight double"), spark.createDataFrame([(g,) for g in bg], "gene_id string"), spark.createDataFrame(ann, "gene_id string, go_id string")
    return frames, fg, ann, want


def test_go_counts_of_repeated_genes(spark):
    """Each row of an id counts, as in SQL over rows."""
    frames, _, _, want = repeated_genes(spark)
    got = {(r.set_name, r.go_id): (r.k, r.n, r.big_n, r.m) for r in enrichment.go_counts(*frames, repeats=True).collect()}
    assert got == {at: c for at, c in want.items() if c[0]}
    once = enrichment.go_counts(*frames).collect()
    assert {r.m for r in once} == {200}  # without repeats an id counts once


def test_enrichment_of_repeated_genes(spark):
    """Each row of an id counts and is listed."""
    frames, fg, ann, want = repeated_genes(spark)
    found = enrichment.go_enrichment(*frames, max_genes=1000, repeats=True).collect()
    assert {(r.set_name, r.go_id): (r.overlap_k, r.bg_with_go_n, r.fg_n, r.bg_m) for r in found} == {at: c for at, c in want.items() if c[0]}
    for r in found:
        mine = sorted((-w, g) for s, g, w in fg if s == r.set_name and (g, r.go_id) in set(ann))
        assert r.overlap_genes.split(",") == [g for _, g in mine]


def test_loci_of_genes_that_share_an_id(spark):
    genes = spark.createDataFrame([("g", k, "Chr1", 10 * k, 10 * k + 5, "+") for k in (1, 2, 3)], "gene_id string, gene_key long, chrom string, gstart long, gend long, strand string")
    none = spark.createDataFrame([], "region_id string, chrom string, rstart long, rend long, rtype string"), spark.createDataFrame([], "window_id string, chrom string, wstart long, wend long")
    starts = lambda **by: sorted(r.start for r in variants.build_loci(genes, *none, genes.where("gene_key=2"), **by).collect())
    assert starts(by=("gene_key",)) == [20]
    assert starts() == [10, 20, 30]


def test_generated_code_compiles(spark):
    """Plans of the interval joins stay within the size of a method; with fallback they would only be slow."""
    from omicsgraph.queries import QUERIES

    spark.conf.set("spark.sql.codegen.fallback", "false")
    try:
        for name in ("j2_loci_hit_by_snps", "a7_delta_stats", "j1_build_loci"):
            QUERIES[name](spark, "/root/testdata/sf0.001").collect()
    finally:
        spark.conf.unset("spark.sql.codegen.fallback")


def test_token_table_counts_letters():
    table = {"A": [1.0, 0.0], "C": [0.0, 1.0], "N": [0.5, 0.5]}
    seqs = ["ACCA", "", "NX", "漢A", "C" * 5000]
    slow = [np.mean([table.get(c, [0.0, 0.0]) for c in s] or [[0.0, 0.0]], axis=0) for s in seqs]
    assert np.allclose(TokenTable(table)(seqs), slow) and TokenTable(table)([]).shape == (0, 2)
    assert np.allclose(TokenTable(table, "cls")(seqs), [table.get(s[:1], [0.0, 0.0]) for s in seqs])


def test_embedding_options_of_plans(spark):
    """Pooling of a long gene's windows, strands and the length that the embedder takes come from the sizes."""
    e = TokenTable({"A": [1.0, 0.0], "C": [0.0, 1.0]})
    df = spark.createDataFrame([("gene", "g", "AAAACC", 0), ("region", "r", "AC", 4)], "kind string, locus_id string, seq string, fixed_len int")
    got = lambda **how: {r.locus_id: r.x for r in reference_graph.embed_kinds(df, e, 2, ["kind", "locus_id"], reference_graph.Sizes(gene_short=2, gene_window=2, gene_stride=2, strands=None, **how)).collect()}
    assert got() == {"g": [2 / 3, 1 / 3], "r": [0.25, 0.25]}
    assert got(window_pooling="max")["g"] == [1.0, 1.0] and got(window_pooling="last")["g"] == [0.0, 1.0]
    assert got(max_length=2)["r"] == [0.5, 0.0]
