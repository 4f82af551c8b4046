"""Hand-checked fixtures."""

import gzip
import math
import struct
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kmerloom import catalog
from kmerloom.functions import seq
from kmerloom.operators import classify, compactors, fdr, lookup, pairs, satc, stats_group, stats_native
from kmerloom.plans import config, pipeline, postprocess
from kmerloom.sources import reads as R
from kmerloom.sources import sinks, tables
from kmerloom.streaming import counts as streaming


def reads(spark, *seqs):
    return spark.createDataFrame([(i, s) for i, s in enumerate(seqs)], "read_id long, seq string")


def counts(spark, *rows):
    return spark.createDataFrame(rows, "sample_id int, anchor string, target string, count long")


def one(df, *cols):
    r = df.select(*cols).collect()
    assert len(r) == 1
    return tuple(r[0]) if len(cols) > 1 else r[0][0]


def test_pairs(spark):
    got = pairs.enumerate_pairs(reads(spark, "ACGTACGTAC"), 2, 3, 1).orderBy("pos").collect()
    assert len(got) == 5 and (got[0]["anchor"], got[0]["target"]) == ("AC", "TAC")
    got = pairs.enumerate_pairs(reads(spark, "ACGNACG", "AC", ""), 2, 1).collect()
    assert [(r["anchor"], r["target"]) for r in got] == [("AC", "G"), ("AC", "G")]


@pytest.mark.parametrize("n", [127, 128, 129, 400])
def test_chunks_lose_no_window(spark, n):
    s = "".join("ACGT"[i * i % 7 % 4] for i in range(n))
    got = {(r["pos"], r["window"]) for r in pairs.windows(reads(spark, s), 9).collect()}
    assert got == {(i + 1, s[i : i + 9]) for i in range(n - 8)}


def test_sequence_functions(spark):
    df = spark.createDataFrame([("AACG",)], "s string")
    assert one(df, seq.revcomp(F.col("s")), seq.canonical(F.col("s"))) == ("CGTT", "AACG")
    df = spark.createDataFrame([("ACGT", "AGGA")], "a string, b string")
    assert one(df, seq.hamming(F.col("a"), F.col("b")), F.levenshtein("a", "b")) == (2, 2)
    assert one(df, seq.hamming_packed(seq.pack(F.col("a")), seq.pack(F.col("b"))), seq.unpack(seq.pack(F.col("a")), 4)) == (2, "ACGT")
    df = spark.createDataFrame([("AAAAAAAC",)], "s string")
    assert one(df, seq.has_run(F.col("s"), 8), seq.has_run(F.col("s"), 7), seq.has_run(F.col("s"), 0)) == (False, True, False)
    df = spark.createDataFrame([("ACAC",), ("AAAA",), ("A",)], "s string").select(seq.seq_entropy(F.col("s"), 2))
    assert [round(r[0], 4) for r in df.collect()] == [0.9183, 0, 0]
    assert seq.murmur_finaliser(0) == 0 and seq.murmur_finaliser(1) == 0xB456BCFC34C2CB2C


def test_entropy_and_distances(spark):
    c = counts(spark, (0, "X", "AA", 1), (1, "X", "AC", 1), (0, "X", "CC", 2))
    assert one(stats_native.target_entropy(c), "target_entropy") == pytest.approx(1.5)
    c = counts(spark, (0, "X", "AA", 2), (1, "X", "AC", 1))
    assert one(stats_native.all_pairs_hamming(c), "avg_hamming_distance_all_pairs") == pytest.approx(2 / 3)
    assert one(stats_native.all_pairs_edit(c), "avg_edit_distance_all_pairs") == pytest.approx(2 / 3)
    c = counts(spark, (0, "X", "AC", 3), (1, "X", "AA", 3))
    assert one(satc.top_targets(c, 1), "target") == "AA"
    assert one(stats_native.distance_to_top(c), "avg_hamming_distance_max_target") == pytest.approx(0.5)


def test_strict_thresholds(spark):
    c = counts(spark, (0, "X", "AA", 25), (1, "X", "AC", 25), (0, "Y", "AA", 26), (1, "Y", "AC", 25))
    assert {r["anchor"] for r in satc.anchor_filter(c).collect()} == {"Y"}
    assert {r["anchor"] for r in satc.anchors_above(c, 25).collect()} == {"Y"}


def test_finite_p(spark):
    c = counts(spark, (0, "X", "A", 10), (1, "X", "C", 10), (0, "Z", "A", 10), (1, "Z", "C", 10))
    v = spark.createDataFrame([(0, 1.0), (1, -1.0)], "sample_id int, c double")
    f = spark.createDataFrame([("X", "A", 1.0), ("X", "C", 0.0), ("Z", "A", 1.0), ("Z", "C", 1.0)], "anchor string, target string, f double")
    k = stats_native.effect_sizes(stats_native.finite_p(stats_native.contrasts(c, v, f))).orderBy("anchor").collect()
    assert k[0]["pval"] == pytest.approx(2 * math.exp(-10)) and k[0]["effect_size_bin"] == 1 and k[1]["pval"] == 1
    flat = spark.createDataFrame([(0, 1.0), (1, 1.0)], "sample_id int, c double")
    assert stats_native.finite_p(stats_native.contrasts(c, flat, f)).first()["pval"] == 1
    x = np.diag([10.0, 10.0])
    assert stats_group.p_finite(x, np.array([1.0, -1.0]), np.array([1.0, 0.0])) == pytest.approx(2 * math.exp(-10))
    a = stats_native.asymptotic_p(stats_native.contrasts(c, v, f)).orderBy("anchor").first()
    assert a["pval_asymp"] == pytest.approx(stats_group.p_asymptotic(x, np.array([1.0, -1.0]), np.array([1.0, 0.0])), rel=1e-9)


def test_erfc(spark):
    xs = [0.0, 0.1, 1.0, 2.4, 2.6, 5.0, 20.0]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select(stats_native.erfc(F.col("x"))).collect()
    assert [r[0] for r in got] == pytest.approx([math.erfc(x) for x in xs], rel=1e-9, abs=1e-300)


def test_group_statistics():
    rng = stats_group.seed_of("ACGT")
    x = np.array([[8.0, 0], [0, 3]])
    t = stats_group.split_table(x, 0.25, rng)
    assert (t <= x).all() and t.sum(0).tolist() == [2, 0]
    p, c, f, test = stats_group.optimise(np.array([[40.0, 40, 1, 2], [1, 2, 40, 40]]), "A", 0.25, 10, 50, 1)
    assert p < 1e-6 and set(np.sign(c)) == {1, -1} and test.sum() < 166
    null = [stats_group.optimise(np.random.default_rng(i).multinomial(40, [0.5, 0.5], 8).T.astype(float), str(i), 0.25, 10, 50, 1)[0] for i in range(60)]
    assert np.mean(np.array(null) < 0.05) <= 0.05
    h = stats_group.helmert(np.array([3, 2, 5]))
    assert np.allclose((h[1:] * [3, 2, 5]).sum(1), 0) and np.allclose(h * [3, 2, 5] @ h.T, np.eye(3))
    assert stats_group.chi2_survival(3.841458820694124, 1) == pytest.approx(0.05) and stats_group.chi2_survival(31.41043284, 20) == pytest.approx(0.05, rel=1e-6)


def test_results_do_not_depend_on_partitions(spark):
    c = counts(spark, *[(s, a, t, (s * 7 + i) % 5 + 1) for s in range(6) for a in ("AC", "GT") for i, t in enumerate(("AA", "CC", "GG"))])
    a = stats_group.optimised_stats(c.repartition(1)).toPandas().sort_values("anchor", ignore_index=True)
    b = stats_group.optimised_stats(c.repartition(5)).toPandas().sort_values("anchor", ignore_index=True)
    pd.testing.assert_frame_equal(a, b)


def test_sparse_tables_agree_with_dense_ones():
    rng = np.random.default_rng(3)
    x = rng.poisson(1.0, (30, 8)).astype(float)
    x[:, 5] = x[4] = 0
    row, col = (a.ravel() for a in np.nonzero(x.T)[::-1])
    y = stats_group.Sparse(row, col, x[row, col], x.shape)
    c, f = rng.choice([-1.0, 1.0], 8), rng.integers(0, 2, 30).astype(float)
    for g in (stats_group.p_finite, stats_group.p_old, stats_group.p_asymptotic, stats_group.effect_bin, stats_group.effect_cts):
        assert g(y, c, f) == pytest.approx(g(x, c, f), rel=1e-9)
    a, b = (stats_group.best_cf(t, 5, 50, stats_group.seed_of("A")) for t in (x, y))
    assert np.allclose(a[0], b[0]) and np.allclose(a[1], b[1]) and a[1].any()
    assert stats_group.base_p(y, 9, stats_group.seed_of("A")) == pytest.approx(stats_group.base_p(x, 9, stats_group.seed_of("A")))
    t = stats_group.split_table(y, 0.25, rng)
    assert (t.n <= y.n).all() and t.sum(0).tolist() == np.floor(x.sum(0) * 0.25).tolist()


def test_anchor_beyond_five_million_cells_has_statistics(spark):
    """260,000 targets by 20 samples, of which the targets of the first ten samples are others than those of the rest."""
    c = spark.range(260_000).selectExpr("cast(id % 20 as int) as sample_id", "'X' as anchor", "cast(id as string) as target", "1L as count")
    common = spark.range(20).selectExpr("cast(id as int) as sample_id", "'X' as anchor", "if(id < 10, 'A', 'C') as target", "20000L as count")
    r = stats_group.optimised_stats(c.unionAll(common)).first()
    assert r["anchor"] == "X" and all(v is not None for v in r) and r["pval_opt"] < 1e-6 and r["effect_size_bin"] > 0.5


def test_queries_over_whole_texts(spark, tmp_path):
    """Anchors inside the texts are linked and clustered, and rare targets count, as by brute force."""
    rng = np.random.default_rng(4)
    texts = ["".join(rng.choice(list("acgt"), n)) for n in (5, 9, 25, 40, 60)]
    bases = [t.translate(str.maketrans("abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTAC")) for t in texts]
    spark.createDataFrame([(i, t, "en", f"s{i % 2}", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    run = lambda name: [tuple(r) for r in catalog.QUERIES[name](spark, str(tmp_path)).collect()]
    all_of = lambda k: {b[i : i + k] for b in bases for i in range(len(b) - k + 1)}
    link = lambda a, b, most: next((k for k in range(1, most + 1) if a != b and a[k:] == b[: len(b) - k]), None)
    short = all_of(6)
    assert sorted(run("j12_shifted_anchors_whole")) == sorted((a, b, k) for a in short for b in short if (k := link(a, b, 5)))
    cluster = {a: a for a in all_of(10)}
    while True:
        low = {a: min([cluster[a], *[cluster[b] for b in cluster if link(a, b, 3) or link(b, a, 3)]]) for a in cluster}
        if low == cluster:
            break
        cluster = low
    assert sorted(run("j12_anchor_clusters_whole")) == sorted(cluster.items()) and len(set(cluster.values())) < len(cluster)
    seen = {(f"s{j % 2}", b[i : i + 3], b[i + 3 : i + 6]) for j, b in enumerate(bases) for i in range(len(b) - 5)}
    assert sorted(run("f4_hamming_whole")) == sorted({(s, a) for s, a, t in seen for s2, a2, u in seen if (s, a) == (s2, a2) and all(x != y for x, y in zip(t, u, strict=True))})
    top = dict(run("w6_pseudo_alignment_whole"))
    anchors = {a for _, a, _ in seen}
    assert {s: len(v.split("\n", 1)[1].replace("\n", "")) for s, v in top.items()} == {s: 9 * len(anchors) for s in ("s0", "s1")}
    spark.catalog.clearCache()


@pytest.mark.parametrize("one_task", [2_000_000, 5])
def test_correction(spark, one_task):
    df = spark.createDataFrame([("a", 0.01), ("b", 0.02), ("c", 0.03)], "anchor string, p double")
    assert [r["p_corrected"] for r in fdr.benjamini_yekutieli(df, "p", one_task).collect()] == pytest.approx([0.055] * 3)
    rows = [(f"a{i:03}", ((i * 37) % 101) / 101) for i in range(200)]
    df = spark.createDataFrame([*rows, ("none", None)], "anchor string, p double")
    got = {r["anchor"]: r["p_corrected"] for r in fdr.benjamini_yekutieli(df, "p", one_task).collect()}
    order = sorted(rows, key=lambda x: (x[1], x[0]))
    h, low, want = sum(1 / i for i in range(1, 201)), 1.0, {}
    for k in range(200, 0, -1):
        low = min(low, order[k - 1][1] * 200 * h / k)
        want[order[k - 1][0]] = low
    assert got.pop("none") is None and got == pytest.approx(want)
    assert fdr.benjamini_yekutieli(df.where("p < 0"), "p").count() == 0


def test_lookup(spark):
    s = spark.createDataFrame([("f1", "t1.1 (g1)", "ACGTTGCA"), ("f2", "t2", "ACGTT")], "file string, header string, seq string")
    look = lookup.genome_table(s, 5)
    by = {(r["kmer"], r["file"]): r for r in look.collect()}
    assert by["AACGT", "f1"]["category"] == 3 and by["AACGT", "f2"]["labels"] == ["t2"]
    q = spark.createDataFrame([(1, "acgttn"), (2, "AAAAAA"), (3, "ACG"), (4, "CCTCC")], "qid long, seq string")
    hits = {(r["qid"], r["pos"]): r["code"] for r in lookup.query(q, look, 5, run=5).collect()}
    assert hits == {(1, 1): "3", (1, 2): "N", (2, 1): "P", (2, 2): "P", (4, 1): "U"}
    names = spark.createDataFrame([("NM_1.2 Homo thing (ABC), transcript variant 3, mRNA",), ("xyz-7 no",)], "h string")
    assert [r[0] for r in names.select(lookup.gene_of(F.col("h"))).collect()] == ["ABC", "xyz"]


def test_files(spark, tmp_path):
    fq = tmp_path / "a.fq.gz"
    fq.write_bytes(gzip.compress(b"@r1 x\r\nACGT\r\n+\r\n@@@@\r\n@r2\r\nGGNN\r\n+\r\nIIII\r\n"))
    assert [tuple(r) for r in R.read_sequences(spark, str(fq)).select("header", "seq").orderBy("header").collect()] == [("r1 x", "ACGT"), ("r2", "GGNN")]
    fa = tmp_path / "a.fa"
    fa.write_text(">s1 a\nAC\nGT\n>s2\nTTTT\n")
    assert [tuple(r) for r in R.read_sequences(spark, str(fa)).select("header", "seq").orderBy("header").collect()] == [("s1 a", "ACGT"), ("s2", "TTTT")]
    rec = struct.pack("<iiBBHHHiiii", -1, -1, 3, 0, 0, 0, 4, 5, -1, -1, 0) + b"q1\0" + bytes([0x12, 0x48, 0xF0]) + b"\0" * 5
    body = b"BAM\1" + struct.pack("<ii", 0, 0) + struct.pack("<i", len(rec)) + rec
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    (tmp_path / "a.bam").write_bytes(z.compress(body) + z.flush())
    assert [tuple(r) for r in R.read_sequences(spark, str(tmp_path / "a.bam")).select("header", "seq").collect()] == [("q1", "ACGTN")]
    sheet = tmp_path / "s.txt"
    sheet.write_text("s1 /a\ns2 /b\n")
    assert [r["sample_name"] for r in tables.read_samples(spark, str(sheet)).orderBy("sample_id").collect()] == ["s1", "s2"]
    sheet.write_text("s1 /a\ns1 /b\n")
    with pytest.raises(ValueError):
        tables.read_samples(spark, str(sheet))
    (tmp_path / "l.txt").write_text("ACG\nAC\n")
    with pytest.raises(ValueError):
        tables.read_anchors(spark, str(tmp_path / "l.txt"))


def test_dump_round_trip(spark):
    c = spark.createDataFrame([("s_1", "ACGT", "AAA", "CCC", 7)], "sample_name string, barcode string, anchor string, target string, count long").withColumn("sample_id", F.lit(0))
    for flavour in ("satc", "counts"):
        r = tables.undump(sinks.dump_lines(c, flavour), 3).first()
        assert tuple(r) == ("s_1", "ACGT", "AAA", "CCC", 7)


def test_followers_stop_at_first_invalid(spark):
    s = spark.createDataFrame([("ACG",)], "seed string")
    r = reads(spark, "ACGTTNTTT", "ACGTTCCGG", "ACGTT")
    got = {x["read_id"]: x["followers"] for x in pairs.followers(r, s, 3, 2, 3).collect()}
    assert got == {0: ["TT", None, None], 1: ["TT", "CC", "GG"]}


def test_compactor_rules():
    rules = compactors.Rules(kmer_len=4, num_kmers=1, lower_bound=2, poly=4)
    s = compactors.active_set(["ACGT"] * 1000 + ["ACGA"] + ["TTTT"] * 5, rules)
    assert s["ACGA"] == ("ACGT", 1) and s["TTTT"][0] == "TTTT"
    got = compactors.chosen([("ACGT",)] * 1000 + [("ACGA",)] + [("TTTT",)] * 5 + [("GGCC",)] * 4, 100, rules)
    assert [(x[0], x[1], x[2]) for x in got] == [(("ACGT",), 1001, 1000), (("GGCC",), 4, 4)]
    assert compactors.active_set([None, None], rules) is None
    assert compactors.poisson_cdf(3, 2.0) == pytest.approx(0.857123460) and compactors.binomial_cdf(2, 4, 0.5) == pytest.approx(11 / 16)


def test_compactor_tree(spark):
    body = "ACGGTCATTGCAAGCTTGACCGATGCATCGGA"
    r = reads(spark, *[body] * 12, *["ACGGTC" + "GGATCC" + "TAGCTA" + "CCATGG"] * 11)
    a = spark.createDataFrame([("ACGGTC",), ("TTTTTT",)], "anchor string")
    rules = compactors.Rules(kmer_len=6, num_kmers=2, lower_bound=5, max_length=30, min_specificity=0.9)
    got = compactors.assemble(r, a, 6, rules).orderBy("id").collect()
    roots = [x for x in got if x["parent_id"] == -1]
    assert {x["compactor"] for x in roots} == {body[:18], "ACGGTCGGATCCTAGCTA"} and [x["support"] for x in roots] == [12, 11]
    kids = [x for x in got if x["parent_id"] == roots[0]["id"]]
    assert [x["compactor"] for x in kids] == [body[:30]] and kids[0]["expected_read_count"] == 12 and kids[0]["cumulated_support"] == "12,12"


def test_edit_scripts(spark):
    assert classify.edit_script("ACGT", "ACT") in ("MMDM",) and classify.edit_script("AC", "AG", 100).count("D") == 1
    df = spark.createDataFrame([("X", "ACA"), ("X", "GCG")], "anchor string, target string")
    assert one(classify.base_edit(df), "edit") == "G_to_A"


def test_config_rules():
    with pytest.raises(ValueError):
        config.Config(anchor_len=32).resolve()
    with pytest.raises(ValueError):
        config.Config(technology="x").resolve()
    assert config.Config(supervised=True, n_most_freq_targets=1).resolve().n_most_freq_targets == 2


def test_planted_signal_is_found(spark):
    rows = [(s, f"ACGTAC{'CATT' if s < 4 else 'GGAA'}") for s in range(8) for _ in range(20)] + [(s, f"TTGACA{'CATT' if i % 2 else 'GGAA'}") for s in range(8) for i in range(20)]
    r = spark.createDataFrame(rows, "sample_id int, seq string")
    got = pipeline.run(r, config.Config(anchor_len=6, target_len=4))
    assert {x["anchor"] for x in got.scores.collect()} == {"ACGTAC"} and got.stats.count() == 2
    assert pipeline.retained(got.satc, got.top_effect_size).select("anchor").distinct().count() == 1


def test_postprocess(spark):
    with pytest.raises(KeyError):
        postprocess.run_postprocess('[{"name": "no"}]', {})
    with pytest.raises(ValueError):
        postprocess.run_postprocess([{"name": "x", "command": "rm"}], {})


def test_streamed_counts(spark, tmp_path):
    data = spark.createDataFrame([(0, "ACGTACGT"), (1, "ACGTACGA")], "sample_id int, seq string")
    data.write.parquet(str(tmp_path / "in"))
    got = []
    s = streaming.read_stream(spark, str(tmp_path / "in"), data.schema, 1)
    q = streaming.to_batches(streaming.stream_counts(s, 2, 2), str(tmp_path / "check"), lambda df, _: got.extend(df.collect()), once=True)
    q.awaitTermination(120)
    want = satc.count_satc(pairs.enumerate_pairs(data, 2, 2)).collect()
    last = {(r["sample_id"], r["anchor"], r["target"]): r["count"] for r in got}
    assert last == {(r["sample_id"], r["anchor"], r["target"]): r["count"] for r in want}
