"""The jobs end to end on a small genome."""

import random

from pyspark.sql import functions as F

from omicsgraph.operators import ranking, scoring
from omicsgraph.operators.embed import TokenTable
from omicsgraph.operators.scoring import Head
from omicsgraph.plans import interpretation, reference_graph, sample_deltas
from omicsgraph.sources import text

TABLE = TokenTable({"A": [1.0, 0.0], "C": [0.0, 1.0], "G": [0.5, 0.5], "T": [0.25, 0.0]})


def lines(spark, rows, name="f"):
    return spark.createDataFrame([((name, 0, k), r) for k, r in enumerate(rows)], "line_no struct<file:string,block:long,row:long>, line string")


def test_whole_run(spark, tmp_path):
    rng = random.Random(0)
    seq = "".join(rng.choice("ACGT") for _ in range(9000))
    genome = spark.createDataFrame([("Chr1", seq)], "chrom string, seq string")
    sizes = reference_graph.Sizes(tile=1000)
    tiles = text.tile_genome(genome, sizes.tile)
    genes = {f"AT1G0000{k}": (500 * k + 1, 500 * k + 400) for k in range(6)}
    gff = lines(spark, ["\t".join(["chr1", "s", "gene", str(a), str(b), ".", "-" if k % 2 else "+", ".", f"ID={g}"]) for k, (g, (a, b)) in enumerate(genes.items())])
    regions = [f"Chr1:{600 * k + 50}-{600 * k + 250}" for k in range(5)]
    ids = list(genes)
    files = {
        "gff": gff,
        "motif": lines(spark, [f"{ids[k]}\t{r}\t0.{k}" for k, r in enumerate(regions)] + [f"AT9G00001\t{regions[0]}"]),
        "chip": lines(spark, [f"{r}\t{ids[-1 - k]}" for k, r in enumerate(regions)]),
        "promoter1000": lines(spark, [f"{r}\t{ids[k]}\t2" for k, r in enumerate(regions[:3])]),
        "ppi": lines(spark, ["gene1\tgene2\tscore", f"{ids[0]}\t{ids[1]}\t900", f"{ids[0]}\t{ids[0]}\t900", f"{ids[2]}\t{ids[3]}\t100"]),
    }
    loci, pairs = reference_graph.reference_loci(files, genome, sizes)
    vectors = reference_graph.embed_loci(loci, tiles, TABLE, 2, sizes)
    nodes, edges = reference_graph.build_graph(files, vectors, pairs, min_ppi=400)
    assert {(r.node_type, r["count"]) for r in nodes.groupBy("node_type").count().collect()} >= {("gene", 6), ("region", 5), ("tf", 6)}
    rels = {r.rel: r["count"] for r in edges.groupBy("rel").count().collect()}
    assert rels["ppi"] == 2 and rels["motif"] == rels["rev_motif"] == 6 and rels["chip"] == 5 and rels["promoter1000"] == 3 and rels["contains"] == 5

    at = [60, 700, 1300]
    other = {"A": "C", "C": "G", "G": "T", "T": "A"}
    records = ["\t".join(["1", str(p), ".", seq[p - 1], other[seq[p - 1]], ".", ".", ".", "GT", "0/1", "0/0"]) for p in at]
    wrong = ["\t".join(["1", "80", ".", other[seq[79]], "A", ".", ".", ".", "GT", "1/1", "1/1"])]
    vcf = lines(spark, ["\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "Q", "F", "I", "FORMAT", "S1", "S2"]), *records, *wrong])
    snps = sample_deltas.sample_snp_table(vcf, genome, tiles, loci, sizes)
    assert sorted((r.sample_id, r.pos) for r in snps.collect()) == [("S1", p) for p in at]
    delta = sample_deltas.sample_deltas(snps, loci, tiles, TABLE, 2, sizes)
    hit = {r.node_id for r in delta.where("node_type = 'gene'").collect()}
    assert hit == {g for g, (a, b) in genes.items() if any(a <= p <= b for p in at)}
    samples = spark.createDataFrame([("S1",), ("S2",)], "sample_id string")
    for done, left in (([], ["S1", "S2"]), (["S1"], ["S2"])):
        job = sample_deltas.pending_deltas(samples, spark.createDataFrame([(s,) for s in done], "sample_id string"), vcf, genome, tiles, loci, TABLE, 2, sizes)
        assert sorted(r.sample_id for r in job["samples"].collect()) == left
        assert {(r.sample_id, r.seen, r.gt_alt, r.ref_mismatch) for r in job["extraction"].collect()} == {("S1", 4, 4, 1), ("S2", 4, 1, 1)} & {(s, 4, n, 1) for s in left for n in (1, 4)}
        assert {r.sample_id: r.n_gene for r in job["changed"].collect()} == {s: len(hit) if s == "S1" else 0 for s in left}
    few = sample_deltas.pending_deltas(samples, samples.limit(0), vcf, genome, tiles, loci, TABLE, 2, sizes, max_samples=1)
    assert [r.sample_id for r in few["samples"].collect()] == ["S1"]
    features = sample_deltas.sample_features(nodes, delta, samples, strict_tf=False)
    assert features.count() == 2 * nodes.count()
    kept = sample_deltas.pending_deltas(samples, samples.limit(0), vcf, genome, tiles, loci, TABLE, 2, sizes, kept=snps)  # S1 isn't read again
    assert sorted((r.sample_id, r.pos) for r in kept["snps"].collect()) == [("S1", p) for p in at]
    assert {r.sample_id for r in kept["extraction"].collect()} == {"S2"}

    head = Head([[1.0, 0.5], [-1.0, 2.0]], [0.1, 0.1], [1.0, -1.0])
    importance, top = interpretation.score_interactions(nodes, delta, samples, edges, head, top_genes=4, top_edges=3, strict_tf=False)
    z = features.withColumnRenamed("x", "z")
    genes_z = z.where("node_type = 'gene'").select("sample_id", F.col("node_id").alias("gene_id"), "z")
    for mode, attention in (("mean", None), ("attention", ([0.3, -0.2], 0.1))):  # sparse vectors against the full overlay
        sparse, best = interpretation.score_interactions(nodes, delta, samples, edges, head, 4, 3, mode, attention, strict_tf=False)
        full = scoring.gene_importance(scoring.gradient_x_input(genes_z, head, mode, attention))
        assert {r.id: round(r.score, 9) for r in sparse.collect()} == {r.id: round(r.score, 9) for r in full.collect()}
        masked = scoring.mask_edges_by_top_genes(edges, ranking.top_ids(sparse, 4)).select("edge_ix", "src_type", "rel", "dst_type", "src_id", "dst_id")
        want = ranking.top_edges(scoring.interaction_scores(masked, z), 3)
        key = lambda r: (r.src_type, r.rel, r.dst_type, r["rank"], round(r.score, 9))
        assert sorted(map(key, best.collect())) == sorted(map(key, want.collect()))
    one, _ = interpretation.score_interactions(nodes, delta, samples, edges, head, 4, 3, strict_tf=False, only=["S2", "S9"])
    assert {r.id: round(r.score, 9) for r in one.collect()} == {r.id: round(r.score, 9) for r in scoring.gene_importance(scoring.gradient_x_input(genes_z.where("sample_id = 'S2'"), head)).collect()}
    assert importance.count() == 6 and max(r.rank for r in top.collect()) <= 3
    tf_region = top.where("rel = 'motif'").select("src_id", "dst_id", "score", "rank")
    gene2go = spark.createDataFrame([(g, f"GO:{k % 2}") for k, g in enumerate(ids)], "gene_id string, go_id string")
    out = interpretation.interpret(nodes, edges, importance, tf_region, top.where("rel = 'ppi'"), gene2go, min_bg=1, min_overlap=1)
    assert {k: df.count() >= 0 for k, df in out.items()}
    assert out["enrichment"].where("pvalue > 1 or fdr < pvalue - 1e-12").count() == 0
    interpretation.write_results(str(tmp_path), importance, top, out["hits"], out["enrichment"])
    assert [r.split("\t")[0] for r in text_lines(spark, tmp_path / "gene_importance")][1:] == [r.id for r in importance.orderBy("rank").collect()]


def text_lines(spark, folder):
    return [line for f in sorted(folder.glob("part-*.csv")) for line in f.read_text().splitlines()]
