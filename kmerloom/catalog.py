"""Queries by name, and the SQL that gives the same rows. Names begin with the ids of the operator inventory."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import seq
from .operators import classify, compactors, fdr, lookup, pairs, satc, stats_group, stats_native, supervised
from .plans import config, pipeline, postprocess
from .session import scratch
from .sources import reads as R
from .sources import sinks, tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

_READS = """reads AS (SELECT source AS sample_name, lang AS "group", doc_id AS read_id,
 translate(regexp_replace(lower(text), '[^a-z]', '', 'g'), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC') AS seq FROM documents)"""
_WIN6 = _READS + """, win AS (SELECT sample_name, read_id, i AS pos, substr(seq, i, 6) AS w FROM (SELECT *, unnest(range(1, length(seq) - 4)) AS i FROM reads))"""
_SATC = _WIN6 + """, satc AS (SELECT sample_name AS sample_id, substr(w, 1, 3) AS anchor, substr(w, 4, 3) AS target, count(*) AS count FROM win GROUP BY ALL)"""
_STAR = """star AS (SELECT s_nationkey AS sample_id, p_brand || '-' || p_size AS anchor, l_returnflag || l_linestatus || l_linenumber AS target, count(*) AS count
 FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL)"""
_TGT = ", tgt AS (SELECT anchor, target, sum(count) AS t FROM satc GROUP BY ALL)"
_TOP = ", rk AS (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY t DESC, target) AS r FROM tgt)"
_STGT = ", tgt AS (SELECT anchor, target, sum(count) AS t FROM star GROUP BY ALL)"
#: c of a nation, f of a target, and X in columns, for the tests with given vectors.
_CF = _STAR + """, x AS (SELECT s.*, (s.sample_id % 3 - 1)::DOUBLE AS c, CASE WHEN target LIKE 'R%' THEN 1.0 WHEN target LIKE 'A%' THEN 0.5 ELSE 0.0 END AS f FROM star s),
col AS (SELECT anchor, sample_id, c, sum(count) AS n, sum(f * count) AS fx, sum(f * f * count) AS ffx FROM x GROUP BY ALL),
k AS (SELECT anchor, sum(n) AS m, sum(fx) AS fr, sum(ffx) AS ffr, sum(c * fx / sqrt(n)) - sum(fx) / sum(n) * sum(c * sqrt(n)) AS s, sum(c * sqrt(n)) AS cn, sum(c * c) AS cc, min(c) = max(c) AS flat_c,
 sum(CASE WHEN c > 0 THEN fx END) / sum(CASE WHEN c > 0 THEN n END) AS ep, sum(CASE WHEN c < 0 THEN fx END) / sum(CASE WHEN c < 0 THEN n END) AS en, sum(c * fx) AS fxc, sum(abs(c) * n) AS xc FROM col GROUP BY anchor),
ff AS (SELECT anchor, min(f) = max(f) AS flat_f FROM x GROUP BY anchor), z AS (SELECT * FROM k JOIN ff USING (anchor))"""
_SEQS = """seqs AS (SELECT 'file' || (item_id % 3) AS file, 'tx' || item_id || '.1 (g' || (item_id % 40) || '), transcript variant ' || item_id AS header,
 translate(regexp_replace(lower(text), '[^a-z]', '', 'g'), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC') AS seq FROM benchmark),
km AS (SELECT file, header, least(w, reverse(translate(w, 'ACGT', 'TGCA'))) AS kmer FROM (SELECT file, header, substr(seq, unnest(range(1, length(seq) - 5)), 7) AS w FROM seqs)),
hk AS (SELECT file, header, kmer, count(*) AS n FROM km GROUP BY ALL)"""
_GENOME = _SEQS + """, fk AS (SELECT kmer, file, sum(n) AS c, list_sort(list(DISTINCT split_part(header, ' ', 1))) AS labels FROM hk GROUP BY ALL),
g AS (SELECT *, count(*) OVER (PARTITION BY kmer) AS files FROM fk),
look AS (SELECT kmer, CASE WHEN files = 1 AND c = 1 THEN 1 WHEN files = 1 THEN 2 WHEN c <= 1 THEN 3 ELSE 4 END AS category, file, labels, c AS cnt FROM g),
one AS (SELECT DISTINCT ON (kmer) kmer, category, file, CASE WHEN category IN (1, 3) THEN array_to_string(labels, '|') ELSE '' END AS label, cnt FROM look ORDER BY kmer, category, file),
hits AS (SELECT q.qid, q.pos, q.w, CASE WHEN regexp_matches(w, 'A{5}|C{5}|G{5}|T{5}') THEN 'P' WHEN o.kmer IS NULL THEN 'U' ELSE o.category::VARCHAR END AS code, o.file, o.label, o.cnt
 FROM (SELECT conv_id * 1000 + turn AS qid, i AS pos, substr(s, i, 7) AS w FROM (SELECT *, unnest(range(1, length(s) - 5)) AS i FROM
  (SELECT conv_id, turn, translate(regexp_replace(lower(text), '[^a-z]', '', 'g'), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC') AS s FROM conversations))) q
 LEFT JOIN one o ON o.kmer = least(w, reverse(translate(w, 'ACGT', 'TGCA')))),
ht AS (SELECT *, CASE WHEN code IN ('1', '3') THEN code || ':' || file || ':' || label WHEN code = '2' THEN code || ':' || file || ':' || cnt ELSE code END AS what FROM hits)"""


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Data:
    """The bridges from the tables to this engine's own."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return _read(self.spark, self.dir, name)

    @property
    def reads(self) -> DataFrame:
        d = self.table("documents")
        return R.text_bridge(d.repartition(self.spark.sparkContext.defaultParallelism, "doc_id"))

    @property
    def satc(self) -> DataFrame:
        r = self.reads.select(F.col("sample_name").alias("sample_id"), "seq")
        return satc.count_satc(pairs.enumerate_pairs(r, 3, 3).drop("pos"))

    @property
    def star(self) -> DataFrame:
        return R.star_bridge(self.table("lineitem"), self.table("part"), self.table("supplier"))

    @property
    def contrasts(self) -> DataFrame:
        s = self.star
        c = s.select("sample_id").distinct().withColumn("c", (F.col("sample_id") % 3 - 1).cast("double"))
        f = s.select("anchor", "target").distinct().withColumn("f", F.when(F.col("target").startswith("R"), 1.0).when(F.col("target").startswith("A"), 0.5).otherwise(0.0))
        return stats_native.contrasts(s, c, f)

    @property
    def vectors(self) -> DataFrame:
        n = self.table("nation").select(F.col("n_nationkey").alias("sample_id"))
        return n.select("sample_id", F.explode(F.sequence(F.lit(0), F.lit(1))).alias("j")).withColumn("c", ((F.col("sample_id") + F.col("j")) % 3 - 1).cast("double"))

    @property
    def seqs(self) -> DataFrame:
        i = F.col("item_id")
        header = F.concat(F.lit("tx"), i, F.lit(".1 (g"), i % 40, F.lit("), transcript variant "), i)
        return self.table("benchmark").select(F.concat(F.lit("file"), i % 3).alias("file"), header.alias("header"), seq.letters_to_bases(F.col("text")).alias("seq"))

    @property
    def hits(self) -> DataFrame:
        q = self.table("conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("qid"), seq.letters_to_bases(F.col("text")).alias("seq"))
        return lookup.query(q, lookup.genome_table(self.seqs, 7), 7, run=5)

    @property
    def samples(self) -> DataFrame:
        return self.table("nation").select(F.col("n_nationkey").alias("sample_id"), F.concat_ws("-", "n_name", F.col("n_nationkey").cast("string")).alias("sample_name"))

    @property
    def anchor_stats(self) -> DataFrame:
        """Totals, effect and p of the star table's anchors, the p of a given contrast."""
        p = stats_native.effect_sizes(stats_native.finite_p(self.contrasts, "pval_opt")).select("anchor", "pval_opt", "effect_size_bin")
        return satc.anchor_totals(self.star).join(p, "anchor")


def query(name: str, sql: str | None = None, ints: tuple[str, ...] = ()) -> Callable:
    """Register a query; `ints` are columns that are INTEGER here and BIGINT in the SQL as it stands."""
    if sql:
        sql = sql if sql.lstrip().startswith(("WITH", "SELECT")) else f"WITH {sql}"
        if ints:
            sql = f"SELECT * REPLACE ({', '.join(f'CAST({c} AS INTEGER) AS {c}' for c in ints)}) FROM ({sql})"

    def add(f: Callable[[Data], DataFrame]) -> Callable[[Data], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: f(Data(spark, sf_dir))
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def r6(c: Column | str) -> Column:
    """Rounded, so that sums in another order compare equal."""
    return F.round(c, 6)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs, counts, filters, totals and entropy of the text bridge: the ten anchors of largest target entropy."""
    d = Data(spark, sf_dir)
    r = d.reads.select(F.col("sample_name").alias("sample_id"), "seq")
    return pipeline.minimum_slice(r, 6, 4)


# --- pipeline ---------------------------------------------------------------------------------------------------


@query("m0_minimum_slice", _READS + """, win AS (SELECT sample_name AS sample_id, substr(w, 1, 6) AS anchor, substr(w, 7, 4) AS target FROM (SELECT sample_name, substr(seq, unnest(range(1, length(seq) - 8)), 10) AS w FROM reads)),
satc AS (SELECT sample_id, anchor, target, count(*) AS count FROM win GROUP BY ALL),
s1 AS (SELECT * FROM satc QUALIFY sum(count) OVER (PARTITION BY sample_id, anchor) > 5),
ok AS (SELECT anchor, sum(count)::BIGINT AS M, count(DISTINCT target) AS u, count(DISTINCT sample_id) AS n FROM s1 GROUP BY anchor HAVING sum(count) > 50 AND count(DISTINCT target) > 1 AND count(DISTINCT sample_id) > 1),
t AS (SELECT anchor, target, sum(count) AS c FROM s1 GROUP BY ALL),
e AS (SELECT anchor, log2(sum(c)) - sum(c * log2(c)) / sum(c) AS h FROM t GROUP BY anchor),
top AS (SELECT DISTINCT ON (anchor) anchor, target, c FROM t ORDER BY anchor, c DESC, target)
SELECT anchor, M, u AS anch_uniqTargs, n AS number_nonzero_samples, round(h, 6) AS target_entropy, target AS most_freq_target_1, c::BIGINT AS cnt_most_freq_target_1 FROM ok JOIN e USING (anchor) JOIN top USING (anchor) ORDER BY round(h, 9) DESC, anchor LIMIT 10""")
def _(d: Data) -> DataFrame:
    return flagship(d.spark, d.dir).withColumn("target_entropy", r6("target_entropy"))


@query("m1_whole_pipeline")
def _(d: Data) -> DataFrame:
    r = d.reads.select(F.col("sample_name").alias("sample_id"), "seq")
    got = pipeline.run(r, config.Config(anchor_len=3, target_len=3, poly_ACGT_len=3, n_most_freq_targets=2))
    return got.scores.select("anchor", "M", "pval_opt", "pval_opt_corrected", "effect_size_bin", "target_entropy")


@query("m3_supervised_pipeline")
def _(d: Data) -> DataFrame:
    """The pipeline with metadata, fixed vectors, compactors and a lookup table: what each adds, counted."""
    d_ = d.reads.where(F.col("sample_name").isNotNull() & F.col("group").isNotNull())
    r = d_.select(F.concat_ws("-", "sample_name", "group").alias("sample_id"), "read_id", "seq")
    meta = r.select("sample_id", F.element_at(F.split("sample_id", "-"), -1).alias("group")).distinct()
    vectors = meta.select("sample_id", F.lit(0).alias("j"), F.when(F.col("group") == "en", 1.0).otherwise(-1.0).alias("c"))
    cfg = config.Config(anchor_len=4, target_len=3, poly_ACGT_len=4, supervised=True, compactors=True, top_target_entropy=5, top_effect_size_bin=5, lookup_kmer_len=6, compactors_config={"kmer_len": 3, "lower_bound": 3, "max_length": 20, "max_child": 2, "max_anchor": 10})
    got = pipeline.run(r, cfg, vectors=vectors, metadata=meta, genome=lookup.genome_table(d.seqs, 6))
    out = [got.more["fixed_vectors"].agg(F.lit("fixed_vectors").alias("what"), F.count("*").alias("n")), got.more["annotated_compactors"].agg(F.lit("annotated_compactors").alias("what"), F.count("*").alias("n")), got.more["annotated"].agg(F.lit("annotated").alias("what"), F.count("*").alias("n"))]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("s4_bam", "SELECT 'read' || o_orderkey AS header, repeat('ACGTN', (1 + o_custkey % 5)::INT) AS seq FROM orders")
def _(d: Data) -> DataFrame:
    """Reads laid out as BAM files of several members each, and read back."""
    o = d.table("orders").select(F.concat(F.lit("read"), F.col("o_orderkey")).alias("header"), F.expr("repeat('ACGTN', cast(1 + o_custkey % 5 as int))").alias("seq"))
    return R.bam_reads(sinks.bam_files(o.repartition(3))).select("header", "seq")


@query("m2_postprocess", "SELECT 'n_anchors' AS what, count(DISTINCT p_brand || '-' || p_size)::BIGINT AS n FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey")
def _(d: Data) -> DataFrame:
    name = f"count-{uuid.uuid4().hex}"
    postprocess.register_postprocess(name, lambda r: r["satc"].select("anchor").distinct().agg(F.count("*").alias("n")).select(F.lit("n_anchors").alias("what"), "n"))
    try:
        return postprocess.run_postprocess([{"name": name}], {"satc": d.star})[name]
    finally:
        postprocess.unregister_postprocess(name)


# --- sources ----------------------------------------------------------------------------------------------------


@query("s1_fastq", _READS + " SELECT read_id || ' ' || sample_name AS header, seq FROM reads WHERE length(seq) > 0")
def _(d: Data) -> DataFrame:
    at = scratch(d.spark, "fastq")
    r = d.reads.where(F.length("seq") > 0).select(F.concat(F.lit("@"), F.col("read_id").cast("string"), F.lit(" "), "sample_name", F.lit("\n"), "seq", F.lit("\n+\n"), F.repeat(F.lit("@"), F.length("seq"))).alias("value"))
    r.write.text(at)
    return R.read_fastq(d.spark, at).select("header", "seq")


@query("s2_fasta", _READS + " SELECT read_id || ' ' || sample_name AS header, seq FROM reads")
def _(d: Data) -> DataFrame:
    at = scratch(d.spark, "fasta")
    wrapped = F.regexp_replace("seq", "(.{60})(?=.)", "$1\n")
    d.reads.select(F.concat(F.lit(">"), F.col("read_id").cast("string"), F.lit(" "), "sample_name", F.lit("\n"), wrapped).alias("value")).write.text(at)
    return R.read_fasta(d.spark, at).select("header", "seq")


@query("s3_format", "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'fastq' WHEN 1 THEN 'fasta' WHEN 2 THEN 'bam' END AS format, CASE doc_id % 2 WHEN 0 THEN 'fastq' ELSE 'fasta' END AS by_first FROM documents")
def _(d: Data) -> DataFrame:
    names = F.array(*[F.lit(x) for x in ("a.fq.gz", "b.fa", "c.bam", "d.txt")])
    x = d.table("documents")
    return x.select("doc_id", R.format_of(F.element_at(names, (F.col("doc_id") % 4 + 1).cast("int"))).alias("format"), R.sniff(F.when(F.col("doc_id") % 2 == 0, "@x").otherwise(">x")).alias("by_first"))


@query("s5_headers", "SELECT doc_id FROM documents WHERE regexp_full_match(source || '-' || lang, 'src1[0-9]-(en|fr)')")
def _(d: Data) -> DataFrame:
    return R.allowed_headers(d.table("documents").withColumn("header", F.concat_ws("-", "source", "lang")), "src1[0-9]-(en|fr)").select("doc_id")


_DUMPED = _SATC + " SELECT sample_id AS sample, NULL::VARCHAR AS barcode, anchor, target, count FROM satc"


@query("s6_satc_parquet", _SATC + " SELECT sample_id, anchor, target, count FROM satc")
def _(d: Data) -> DataFrame:
    at = scratch(d.spark, "satc")
    sinks.write_satc(d.satc, at, bins=8)
    return tables.read_satc(d.spark, at).drop("bin")


@query("s7_undump_tabs", _DUMPED)
def _(d: Data) -> DataFrame:
    return tables.undump(sinks.dump_lines(d.satc, "satc"), 3)


@query("s7_undump_spaces", _SATC + " SELECT sample_id AS sample, 'ACGT' AS barcode, anchor, target, least(count, 100) AS count FROM satc")
def _(d: Data) -> DataFrame:
    return tables.undump(sinks.dump_lines(d.satc.withColumn("barcode", F.lit("ACGT")), "counts"), 3, count_cap=100)


@query("s8_first_seen", "SELECT source, row_number() OVER (ORDER BY f, source) - 1 AS id FROM (SELECT source, min(doc_id) AS f FROM documents GROUP BY source)", ints=("id",))
def _(d: Data) -> DataFrame:
    return tables.first_seen_ids(d.table("documents"), "source", "doc_id")


@query("s9_kmer_listing", _WIN6 + " SELECT w AS kmer, count(*) AS count FROM win GROUP BY w ORDER BY w")
def _(d: Data) -> DataFrame:
    return pairs.kmers(d.reads.select("seq"), 6).groupBy("kmer").agg(F.count("*").alias("count")).orderBy("kmer")


@query("s10_dsv", "SELECT n_nationkey::VARCHAR AS n_nationkey, n_name FROM nation")
def _(d: Data) -> DataFrame:
    at = scratch(d.spark, "dsv")
    d.table("nation").select("n_nationkey", "n_name").write.csv(at, sep="\t", header=True)
    return tables.read_dsv(d.spark, at)


@query("s11_anchor_list", _SATC + " SELECT DISTINCT anchor FROM satc")
def _(d: Data) -> DataFrame:
    at = scratch(d.spark, "anchors")
    d.satc.select("anchor").distinct().coalesce(1).withColumn("x", F.lit("1")).write.csv(at, sep="\t", header=True)
    return tables.read_anchors(d.spark, at)


@query("s12_extendors", _SATC + _TGT + _TOP + " SELECT anchor, r AS i, anchor || target AS extendor FROM rk WHERE r <= 3", ints=("i",))
def _(d: Data) -> DataFrame:
    return tables.extendors(satc.frequent_targets(d.satc, 3))


@query("s13_compactor_table", "SELECT n_name AS compactor FROM nation")
def _(d: Data) -> DataFrame:
    return tables.compactor_sequences(d.table("nation").withColumnRenamed("n_name", "compactor"))


@query("s14_vectors", "SELECT n_nationkey AS sample_id, j, CASE j WHEN 0 THEN n_nationkey % 3 - 1 ELSE n_nationkey % 2 END::DOUBLE AS c FROM nation, (SELECT unnest([0, 1]) AS j)")
def _(d: Data) -> DataFrame:
    n = d.samples
    sheet = n.select(F.concat_ws(", ", "sample_name", (F.col("sample_id") % 3 - 1).cast("string"), (F.col("sample_id") % 2).cast("string")).alias("value"))
    return tables.column_vectors(sheet, n)


@query("s15_cell_types", "SELECT n_nationkey AS sample_id, 'BC' || n_nationkey AS barcode, 'type' || (n_nationkey % 4) AS cell_type FROM nation")
def _(d: Data) -> DataFrame:
    n = d.samples
    sheet = n.select(F.concat(F.lit("type"), F.col("sample_id") % 4, F.lit(","), F.lit("BC"), F.col("sample_id"), F.lit(","), "sample_name").alias("value"))
    return tables.cell_types(sheet, n)


@query("s16_artifacts", "SELECT DISTINCT unnest(string_split_regex(text, '\\s+')) AS artifact FROM benchmark")
def _(d: Data) -> DataFrame:
    return tables.artifacts(d.table("benchmark").select(F.col("text").alias("value")), most=64).where("artifact <> ''")


@query("s17_adapters", "WITH a AS (SELECT unnest([" + ", ".join(f"'{a}'" for a in tables.ADAPTERS) + "]) AS s), b AS (SELECT s FROM a UNION ALL SELECT reverse(translate(s, 'ACGT', 'TGCA')) FROM a) SELECT DISTINCT substr(s, i, 12) AS artifact FROM (SELECT s, unnest(range(1, length(s) - 10)) AS i FROM b)")
def _(d: Data) -> DataFrame:
    return tables.adapter_dictionary(d.spark)


@query("s18_auto_gap", _READS + " SELECT greatest(0, (length(seq) - 54) // 2)::BIGINT AS gap FROM reads ORDER BY read_id LIMIT 1")
def _(d: Data) -> DataFrame:
    return d.spark.createDataFrame([(R.auto_gap(d.reads.orderBy("read_id"), 27, 27),)], "gap long")


# --- sinks ------------------------------------------------------------------------------------------------------


@query("w2_dump", _SATC + " SELECT sample_id || chr(9) || anchor || chr(9) || target || chr(9) || count AS value FROM satc")
def _(d: Data) -> DataFrame:
    return sinks.dump_lines(d.satc)


@query("w3_sentinels", "SELECT n_nationkey::VARCHAR AS n_nationkey, CASE WHEN n_regionkey = 1 THEN '-' ELSE n_name END AS n_name FROM nation")
def _(d: Data) -> DataFrame:
    return sinks.with_sentinels(d.table("nation").select("n_nationkey", F.when(F.col("n_regionkey") != 1, F.col("n_name")).alias("n_name")))


@query("w5_fasta", _SATC + _TGT + _TOP + " SELECT anchor, r AS i, '>' || chr(10) || anchor || target AS value FROM rk WHERE r <= 2", ints=("i",))
def _(d: Data) -> DataFrame:
    return sinks.fasta_of_extendors(satc.frequent_targets(d.satc, 3), 2)


@query("w6_pseudo_alignment", _SATC + """, rk AS (SELECT *, row_number() OVER (PARTITION BY sample_id, anchor ORDER BY count DESC, target) AS r FROM satc WHERE count > 3),
g AS (SELECT s.sample_id, a.anchor FROM (SELECT DISTINCT sample_id FROM satc WHERE count > 3) s, (SELECT DISTINCT anchor FROM satc WHERE count > 3) a),
p AS (SELECT g.sample_id, g.anchor, g.anchor || coalesce(max(CASE WHEN r = 1 THEN target END), 'NNN') || coalesce(max(CASE WHEN r = 2 THEN target END), 'NNN') AS p FROM g LEFT JOIN rk USING (sample_id, anchor) GROUP BY g.sample_id, g.anchor)
SELECT sample_id, '>' || sample_id || chr(10) || regexp_replace(string_agg(p, '' ORDER BY anchor), '(.{60})', '\\1' || chr(10), 'g') AS value FROM p GROUP BY sample_id""")
def _(d: Data) -> DataFrame:
    s = d.satc.where("count > 3").persist()
    return sinks.pseudo_alignment(s, s.select("anchor").distinct(), 2, 3)


@query("w6_pseudo_alignment_whole", _SATC + """, rk AS (SELECT *, row_number() OVER (PARTITION BY sample_id, anchor ORDER BY count DESC, target) AS r FROM satc),
g AS (SELECT s.sample_id, a.anchor FROM (SELECT DISTINCT sample_id FROM satc) s, (SELECT DISTINCT anchor FROM satc) a),
p AS (SELECT g.sample_id, g.anchor, g.anchor || coalesce(max(CASE WHEN r = 1 THEN target END), 'NNN') || coalesce(max(CASE WHEN r = 2 THEN target END), 'NNN') AS p FROM g LEFT JOIN rk USING (sample_id, anchor) GROUP BY g.sample_id, g.anchor)
SELECT sample_id, '>' || sample_id || chr(10) || rtrim(regexp_replace(string_agg(p, '' ORDER BY anchor), '(.{60})', '\\1' || chr(10), 'g'), chr(10)) AS value FROM p GROUP BY sample_id""")
def _(d: Data) -> DataFrame:
    s = d.satc.persist()
    return sinks.pseudo_alignment(s, s.select("anchor").distinct(), 2, 3)


@query("w7_compactor_fasta", "SELECT n_nationkey AS id, '>compactor-' || n_nationkey || chr(10) || n_name AS value FROM nation")
def _(d: Data) -> DataFrame:
    return sinks.fasta_of_compactors(d.table("nation").select(F.lit("").alias("anchor"), F.col("n_nationkey").alias("id"), F.col("n_name").alias("compactor"))).drop("anchor")


@query("w8_run_report")
def _(d: Data) -> DataFrame:
    report = sinks.RunReport()
    report.timed("star", lambda: d.star)
    return d.spark.createDataFrame([(report.to_json(),)], "report string")


@query("w9_read_stats", _READS + " SELECT count(*) AS n_reads, sum(length(seq))::BIGINT AS n_bases, count(*) AS n_valid_reads FROM reads")
def _(d: Data) -> DataFrame:
    return R.read_stats(d.reads)


# --- k-mers -----------------------------------------------------------------------------------------------------

_BY_ANCHOR = "count(*) AS n, sum(pos)::BIGINT AS positions, count(DISTINCT target) AS targets"


def _by_anchor(p: DataFrame) -> DataFrame:
    return p.groupBy("sample_name", "anchor").agg(F.count("*").alias("n"), F.sum("pos").cast("bigint").alias("positions"), F.countDistinct("target").alias("targets"))


@query("k1_pairs", _READS + f", w AS (SELECT sample_name, i AS pos, substr(seq, i, 3) AS anchor, substr(seq, i + 5, 3) AS target FROM (SELECT *, unnest(range(1, length(seq) - 6)) AS i FROM reads)) SELECT sample_name, anchor, {_BY_ANCHOR} FROM w GROUP BY ALL")
def _(d: Data) -> DataFrame:
    return _by_anchor(pairs.enumerate_pairs(d.reads.select("sample_name", "seq"), 3, 3, 2))


@query("k2_gap_shortening", _READS + ", w AS (SELECT sample_name, substr(seq, i, 3) AS anchor, substr(seq, i + 9, 3) AS target FROM (SELECT *, unnest(range(1, length(seq) - 10)) AS i FROM reads)) SELECT sample_name, anchor, target, count(*) AS count FROM w GROUP BY ALL")
def _(d: Data) -> DataFrame:
    r = pairs.shorten_gap(d.reads.select("sample_name", "seq"), 3, 3, 6, 1)
    return pairs.enumerate_pairs(r, 3, 3, 1).groupBy("sample_name", "anchor", "target").agg(F.count("*").alias("count"))


@query("k3_canonical", _WIN6 + " SELECT least(w, reverse(translate(w, 'ACGT', 'TGCA'))) AS kmer, count(*) AS n FROM win GROUP BY ALL")
def _(d: Data) -> DataFrame:
    return pairs.kmers(d.reads.select("seq"), 6, as_canonical=True).groupBy("kmer").agg(F.count("*").alias("n"))


@query("k4_invalid_kept", _READS + ", n AS (SELECT read_id, replace(seq, 'TT', 'NT') AS seq FROM reads), w AS (SELECT read_id, i AS pos, substr(seq, i, 5) AS k FROM (SELECT *, unnest(range(1, length(seq) - 3)) AS i FROM n)) SELECT read_id, count(*) AS n, count(*) FILTER (WHERE k NOT LIKE '%N%') AS n_valid, sum(pos)::BIGINT AS positions FROM w GROUP BY read_id")
def _(d: Data) -> DataFrame:
    r = d.reads.select("read_id", F.replace("seq", F.lit("TT"), F.lit("NT")).alias("seq"))
    return pairs.kmers(r, 5, keep_invalid=True).groupBy("read_id").agg(F.count("*").alias("n"), F.count_if("is_valid").alias("n_valid"), F.sum("pos").cast("bigint").alias("positions"))


@query("k5_reverse_complement", _READS + " SELECT read_id, reverse(translate(seq, 'ACGT', 'TGCA')) AS rc FROM reads")
def _(d: Data) -> DataFrame:
    return d.reads.select("read_id", seq.revcomp(F.col("seq")).alias("rc"))


@query("k6_pack", _WIN6 + ", k AS (SELECT DISTINCT w FROM win) SELECT w AS kmer, list_sum(list_transform(range(1, 7), lambda i: (strpos('ACGT', substr(w, i, 1)) - 1) * 4 ** (6 - i)))::BIGINT AS packed, w AS again FROM k")
def _(d: Data) -> DataFrame:
    k = pairs.kmers(d.reads.select("seq"), 6).select("kmer").distinct().withColumn("packed", seq.pack(F.col("kmer")))
    return k.withColumn("again", seq.unpack(F.col("packed"), 6))


@query("k7_dictionary_pairs", _SATC + ", t AS (SELECT anchor, target, sum(count)::BIGINT AS count FROM satc WHERE anchor IN ('ACG', 'TTA', 'GGC') GROUP BY ALL) SELECT anchor, target, count FROM (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY count DESC, target) AS r FROM t) WHERE r <= 2")
def _(d: Data) -> DataFrame:
    a = d.spark.createDataFrame([("ACG",), ("TTA",), ("GGC",)], "anchor string")
    return pairs.dictionary_pairs(d.reads.select("seq"), F.broadcast(a), 3, 3, 2)


@query("k8_read_selection", _READS + ", p AS (SELECT read_id, seq, strpos(seq, 'ACGTAC') AS a, strpos(seq, 'TTGACA') AS b FROM reads), q AS (SELECT read_id, seq, CASE WHEN a = 0 THEN b WHEN b = 0 THEN a ELSE least(a, b) END AS pos FROM p WHERE a + b > 0) SELECT read_id, substr(seq, pos, 6) AS anchor, pos, substr(seq, greatest(1, pos - 2)) AS part FROM q", ints=("pos",))
def _(d: Data) -> DataFrame:
    a = d.spark.createDataFrame([("ACGTAC",), ("TTGACA",)], "anchor string")
    return pairs.select_reads(d.reads, F.broadcast(a), 6, "suffix", 2)


@query("k9_followers", _READS + ", p AS (SELECT read_id, seq, strpos(seq, 'ACGTAC') AS pos FROM reads WHERE length(seq) >= 14) SELECT read_id, 'ACGTAC' AS seed, pos, CASE WHEN pos + 10 <= length(seq) + 1 THEN substr(seq, pos + 6, 4) END AS f1, CASE WHEN pos + 14 <= length(seq) + 1 THEN substr(seq, pos + 10, 4) END AS f2 FROM p WHERE pos > 0", ints=("pos",))
def _(d: Data) -> DataFrame:
    f = pairs.followers(d.reads, d.spark.createDataFrame([("ACGTAC",)], "seed string"), 6, 4, 2)
    return f.select("read_id", "seed", "pos", F.col("followers")[0].alias("f1"), F.col("followers")[1].alias("f2"))


@query("k10_predecessors", _WIN6 + " SELECT s.w AS pred, count(*) AS n FROM win e JOIN win s ON s.read_id = e.read_id AND s.pos = e.pos - 8 WHERE e.w = 'ACGTAC' GROUP BY s.w")
def _(d: Data) -> DataFrame:
    p = pairs.predecessors(d.reads, d.spark.createDataFrame([("ACGTAC",)], "extender string"), 6, 2)
    return p.groupBy("pred").agg(F.count("*").alias("n"))


_BAR = _READS + """, b AS (SELECT sample_name AS sample_id, substr(seq, 1, 3) AS barcode, substr(seq, 4, 4) AS umi, substr(seq, 8) AS r2 FROM reads WHERE length(seq) >= 7),
ok AS (SELECT sample_id, barcode FROM b GROUP BY ALL HAVING count(*) >= 2), bw AS (SELECT DISTINCT sample_id, barcode, umi, substr(r2, i, 2) AS anchor, substr(r2, i + 2, 2) AS target FROM (SELECT b.*, unnest(range(1, length(r2) - 2)) AS i FROM b JOIN ok USING (sample_id, barcode)))"""


@query("k11_barcoded_counts", _BAR + " SELECT sample_id, barcode, anchor, target, count(*) AS count FROM bw GROUP BY ALL")
def _(d: Data) -> DataFrame:
    r = d.reads.where(F.length("seq") >= 7).select(F.col("sample_name").alias("sample_id"), F.substring("seq", 1, 7).alias("r1"), F.expr("substring(seq, 8)").alias("r2"))
    return pairs.barcoded_counts(r, 2, 2, 3, 4, threshold=2)


# --- filters ----------------------------------------------------------------------------------------------------

_COLS = " SELECT sample_id, anchor, target, count FROM "


@query("f1_anchor_count", _SATC + _COLS + "satc QUALIFY sum(count) OVER (PARTITION BY sample_id, anchor) > 400")
def _(d: Data) -> DataFrame:
    return satc.anchors_above(d.satc, 400)


@query("f2_runs", _SATC + _COLS + "satc WHERE NOT regexp_matches(anchor, 'A{2}|C{2}|G{2}|T{2}')")
def _(d: Data) -> DataFrame:
    return satc.without_runs(d.satc, 2)


@query("f3_artifacts", _SATC + _COLS + "satc WHERE anchor NOT LIKE '%AC%' AND anchor NOT LIKE '%GTT%'")
def _(d: Data) -> DataFrame:
    return satc.without_artifacts(d.satc, d.spark.createDataFrame([("AC",), ("GTT",), ("ACGT",)], "artifact string"))


@query("f4_hamming", _SATC + " SELECT DISTINCT a.sample_id, a.anchor FROM satc a JOIN satc b ON a.sample_id = b.sample_id AND a.anchor = b.anchor AND a.target < b.target WHERE a.count > 30 AND b.count > 30 AND hamming(a.target, b.target) >= 3")
def _(d: Data) -> DataFrame:
    return satc.hamming_filter(d.satc.where("count > 30"), 3).select("sample_id", "anchor").distinct()


@query("f4_hamming_whole", _SATC + " SELECT DISTINCT a.sample_id, a.anchor FROM satc a JOIN satc b ON a.sample_id = b.sample_id AND a.anchor = b.anchor AND a.target < b.target WHERE hamming(a.target, b.target) >= 3")
def _(d: Data) -> DataFrame:
    return satc.hamming_filter(d.satc, 3).select("sample_id", "anchor").distinct()


@query("f5_accept_list", _SATC + _COLS + "satc WHERE anchor IN ('ACG', 'TTA')")
def _(d: Data) -> DataFrame:
    return satc.accept(d.satc, d.spark.createDataFrame([("ACG",), ("TTA",)], "anchor string"))


@query("f6_anchor_filter", _STAR + _COLS + "star WHERE anchor IN (SELECT anchor FROM star GROUP BY anchor HAVING sum(count) > 50 AND count(DISTINCT target) > 12 AND count(DISTINCT sample_id) > 12)")
def _(d: Data) -> DataFrame:
    return satc.anchor_filter(d.star, 50, 12, 12)


@query("f7_rich_samples", _STAR + _COLS + "star WHERE sample_id IN (SELECT sample_id FROM star GROUP BY sample_id HAVING count(DISTINCT anchor) > 700)")
def _(d: Data) -> DataFrame:
    return satc.rich_samples(d.star, 700)


@query("f8_cell_types", _STAR + " SELECT sample_id, 'B' || (count % 3) AS barcode, anchor, target, count, 'T' || sample_id AS cell_type FROM star WHERE count % 3 = 1 AND sample_id < 10")
def _(d: Data) -> DataFrame:
    s = d.star.withColumn("barcode", F.concat(F.lit("B"), F.col("count") % 3))
    t = d.samples.where("sample_id < 10").select("sample_id", F.lit("B1").alias("barcode"), F.concat(F.lit("T"), "sample_id").alias("cell_type"))
    return satc.with_cell_type(s, t)


_FDR = _CF + """, p AS (SELECT anchor, m, abs(coalesce(ep - en, 0)) AS eff, CASE WHEN flat_c OR flat_f OR cc - cn * cn / m <= 0 THEN 1.0 ELSE least(1.0, 2 * exp(-2 * s * s / (cc - cn * cn / m))) END AS pv FROM z),
q AS (SELECT *, round(pv, 9) AS p9, row_number() OVER (ORDER BY round(pv, 9), anchor) AS rn, count(*) OVER () AS mm FROM p),
h AS (SELECT sum(1.0 / i) AS hm FROM (SELECT unnest(range(1, (SELECT max(mm) FROM q) + 1)) AS i)),
c AS (SELECT q.*, least(1.0, min(p9 * mm * hm / rn) OVER (ORDER BY rn DESC)) AS corr FROM q, h)"""


def _corrected(d: Data) -> DataFrame:
    s = d.anchor_stats.withColumn("pval_opt", F.round("pval_opt", 9)).persist()
    return fdr.benjamini_yekutieli(s, "pval_opt")


@query("f10_significant", _CF + """, p AS (SELECT anchor, round(exp(-m * abs(coalesce(ep - en, 0))), 9) AS p9 FROM z),
q AS (SELECT *, row_number() OVER (ORDER BY p9, anchor) AS rn, count(*) OVER () AS mm FROM p),
h AS (SELECT sum(1.0 / i) AS hm FROM (SELECT unnest(range(1, (SELECT max(mm) FROM q) + 1)) AS i)),
c AS (SELECT q.*, least(1.0, min(p9 * mm * hm / rn) OVER (ORDER BY rn DESC)) AS corr FROM q, h)
SELECT anchor, round(corr, 6) AS corrected FROM c WHERE corr < 0.05""")
def _(d: Data) -> DataFrame:
    # A stand-in for a p-value that is small for some anchors: those of the table itself are noise.
    s = d.anchor_stats.withColumn("p", F.round(F.exp(-F.col("M") * F.col("effect_size_bin")), 9)).persist()
    return fdr.significant(fdr.benjamini_yekutieli(s, "p"), "p", 0.05).select("anchor", r6("p_corrected").alias("corrected"))


_LONG = _SATC + _TGT + _TOP + """, lg AS (SELECT rk.anchor, r AS i, target, t::BIGINT AS target_count, n FROM rk JOIN (SELECT anchor, count(DISTINCT sample_id) AS n FROM satc GROUP BY anchor) USING (anchor) WHERE r <= 2 AND anchor IN (SELECT anchor FROM rk WHERE r = 2))"""


def _long(d: Data) -> DataFrame:
    s = d.satc.persist()
    return classify.long_targets(satc.frequent_targets(s, 2).join(satc.anchor_totals(s), "anchor"))


@query("f11_run_extendors", _LONG + " SELECT anchor, target FROM (SELECT *, count(target) OVER (PARTITION BY anchor) AS k FROM (SELECT *, anchor || target AS e FROM lg) WHERE NOT regexp_matches(e, 'A{3}|C{3}|G{3}|T{3}')) WHERE k > 1")
def _(d: Data) -> DataFrame:
    return classify.without_run_extendors(_long(d), 3).select("anchor", "target")


@query("f12_candidates", _STAR + ", st AS (SELECT anchor, count(DISTINCT sample_id) AS n, sum(count)::DOUBLE AS eff FROM star GROUP BY anchor) SELECT anchor FROM st WHERE n > 0.4 * (SELECT max(n) FROM st) ORDER BY eff DESC, anchor LIMIT 20")
def _(d: Data) -> DataFrame:
    s = satc.anchor_totals(d.star).select("anchor", "number_nonzero_samples", F.lit(6.0).alias("avg_hamming_distance_max_target"), F.col("M").cast("double").alias("effect_size_bin"))
    return supervised.candidates(s, n=20).select("anchor")


# --- joins ------------------------------------------------------------------------------------------------------


@query("j1_merge", _STAR + " SELECT sample_id, anchor, target, (count * CASE WHEN sample_id < 5 THEN 2 ELSE 1 END)::BIGINT AS count FROM star")
def _(d: Data) -> DataFrame:
    return satc.merge(d.star, d.star.where("sample_id < 5"))


@query("j2_anti_list", _STAR + _COLS + "star WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_size > 10 AND p_brand || '-' || p_size = star.anchor)")
def _(d: Data) -> DataFrame:
    big = d.table("part").where("p_size > 10").select(F.concat_ws("-", "p_brand", F.col("p_size").cast("string")).alias("anchor")).distinct()
    return d.star.join(big, "anchor", "left_anti").select("sample_id", "anchor", "target", "count")


@query("j3_sample_names", _STAR + " SELECT n_name || '-' || n_nationkey AS sample_name, sum(count)::BIGINT AS n FROM star JOIN nation ON sample_id = n_nationkey GROUP BY ALL")
def _(d: Data) -> DataFrame:
    return satc.sample_names(d.star, d.samples).groupBy("sample_name").agg(F.sum("count").cast("bigint").alias("n"))


@query("j4_untyped_cells", _STAR + " SELECT DISTINCT sample_id, 'B' || (count % 3) AS barcode FROM star WHERE NOT (count % 3 = 1 AND sample_id < 10)")
def _(d: Data) -> DataFrame:
    s = d.star.withColumn("barcode", F.concat(F.lit("B"), F.col("count") % 3))
    return satc.untyped(s, d.samples.where("sample_id < 10").select("sample_id", F.lit("B1").alias("barcode"), F.lit("T").alias("cell_type")))


@query("j5_vectors", _STAR + " SELECT anchor, j, round(sum(count * ((sample_id + j) % 3 - 1))::DOUBLE, 6) AS s FROM star, (SELECT unnest([0, 1]) AS j) GROUP BY ALL")
def _(d: Data) -> DataFrame:
    return d.star.join(d.vectors, "sample_id").groupBy("anchor", "j").agg(r6(F.sum(F.col("count") * F.col("c"))).alias("s"))


@query("j9_metadata", _STAR + " SELECT CASE WHEN sample_id < 12 THEN 'low' ELSE 'mid' END AS \"group\", sum(count)::BIGINT AS n FROM star WHERE sample_id < 20 GROUP BY ALL")
def _(d: Data) -> DataFrame:
    m = d.samples.where("sample_id < 20").select("sample_name", F.when(F.col("sample_id") < 12, "low").otherwise("mid").alias("group"))
    return supervised.with_metadata(satc.sample_names(d.star, d.samples), m).groupBy("group").agg(F.sum("count").cast("bigint").alias("n"))


@query("j10_neighbours", _LONG + " SELECT a.anchor, a.target, b.target AS target_lead, levenshtein(a.target, b.target) AS lev_dist, hamming(a.target, b.target) AS ham_dist FROM lg a JOIN lg b ON a.anchor = b.anchor AND a.i = 1 AND b.i = 2", ints=("ham_dist", "lev_dist"))
def _(d: Data) -> DataFrame:
    return classify.neighbours(_long(d).withColumnRenamed("i", "extendor_order"))


@query("j11_annotation", "SELECT n_nationkey, n_name, r_name FROM nation LEFT JOIN (SELECT * FROM region WHERE r_regionkey < 3) ON n_regionkey = r_regionkey")
def _(d: Data) -> DataFrame:
    r = d.table("region").where("r_regionkey < 3").withColumnRenamed("r_regionkey", "n_regionkey")
    return classify.annotate(d.table("nation"), r.unionAll(r), "n_regionkey").select("n_nationkey", "n_name", "r_name")


_IV = "WITH iv AS (SELECT p_brand AS chrom, p_partkey AS id, (p_retailprice * 10)::BIGINT AS s, (p_retailprice * 10)::BIGINT + 1 + p_size AS e FROM part)"


@query("j11_overlaps", _IV + " SELECT a.id AS a_id, b.id AS b_id FROM iv a JOIN iv b ON a.chrom = b.chrom AND a.s < b.e AND b.s < a.e WHERE a.id % 2 = 0 AND b.id % 2 = 1")
def _(d: Data) -> DataFrame:
    s = F.round(F.col("p_retailprice") * 10).cast("bigint")
    iv = d.table("part").select(F.col("p_brand").alias("chrom"), F.col("p_partkey").alias("id"), s.alias("start"), (s + 1 + F.col("p_size")).alias("end"))
    return classify.overlapping(iv.where("id % 2 = 0"), iv.where("id % 2 = 1"), 100)


@query("j12_shifted_anchors", _READS + ", a AS (SELECT DISTINCT substr(seq, 1, 6) AS a FROM reads WHERE length(seq) >= 6), s AS (SELECT unnest(range(1, 6)) AS shift) SELECT x.a, y.a AS b, min(shift)::INT AS shift FROM a x, a y, s WHERE x.a <> y.a AND substr(x.a, shift + 1) = substr(y.a, 1, 6 - shift) GROUP BY ALL")
def _(d: Data) -> DataFrame:
    return classify.shifted_anchors(d.reads.where(F.length("seq") >= 6).select(F.substring("seq", 1, 6).alias("anchor")))


@query("j12_anchor_clusters", _READS + ", a AS (SELECT DISTINCT substr(seq, 1, 10) AS a FROM reads WHERE length(seq) >= 10) SELECT count(*) AS n FROM a")
def _(d: Data) -> DataFrame:
    c = classify.anchor_clusters(d.reads.where(F.length("seq") >= 10).select(F.substring("seq", 1, 10).alias("anchor")), 3)
    return c.agg(F.count("*").alias("n"))


# The two above take a text's first window and, as their SQL says, return no clusters; these take all windows of the whole texts.


def anchors_of(reads: DataFrame, length: int) -> DataFrame:
    return pairs.windows(reads.select("seq"), length).select(F.col("window").alias("anchor")).distinct()


@query("j12_shifted_anchors_whole")
def _(d: Data) -> DataFrame:
    return classify.shifted_anchors(anchors_of(d.reads, 6))


@query("j12_anchor_clusters_whole")
def _(d: Data) -> DataFrame:
    return classify.anchor_clusters(anchors_of(d.reads, 10), 3)


# --- aggregates -------------------------------------------------------------------------------------------------


@query("a1_count", _SATC + _COLS + "satc")
def _(d: Data) -> DataFrame:
    return d.satc


@query("a2_totals", _STAR + " SELECT anchor, sum(count)::BIGINT AS M, count(DISTINCT target) AS anch_uniqTargs, count(DISTINCT sample_id) AS number_nonzero_samples FROM star GROUP BY anchor")
def _(d: Data) -> DataFrame:
    return satc.anchor_totals(d.star)


@query("a3_top_targets", _SATC + _TGT + _TOP + ", b AS (SELECT anchor, sum(t)::BIGINT AS m, count(*) AS u FROM tgt GROUP BY anchor) SELECT sample_id, anchor, target, count, m AS M_before_filter, u AS anch_uniqTargs_before_filter FROM satc JOIN rk USING (anchor, target) JOIN b USING (anchor) WHERE r <= 3")
def _(d: Data) -> DataFrame:
    return satc.top_targets(d.satc, 3)


@query("a4_dump_targets", _STAR + _STGT + _TOP + " SELECT sample_id, anchor, target, count FROM star JOIN rk USING (anchor, target) WHERE r <= 5")
def _(d: Data) -> DataFrame:
    return satc.top_targets(d.star, 5).select("sample_id", "anchor", "target", "count")


@query("a5_frequent_targets", _STAR + _STGT + _TOP + " SELECT anchor, max(CASE WHEN r = 1 THEN target END) AS most_freq_target_1, max(CASE WHEN r = 1 THEN t END)::BIGINT AS cnt_most_freq_target_1, max(CASE WHEN r = 2 THEN target END) AS most_freq_target_2, max(CASE WHEN r = 2 THEN t END)::BIGINT AS cnt_most_freq_target_2 FROM rk GROUP BY anchor")
def _(d: Data) -> DataFrame:
    return satc.frequent_targets(d.star, 2)


@query("a6_target_entropy", _STAR + _STGT + ", p AS (SELECT anchor, t / sum(t) OVER (PARTITION BY anchor) AS p FROM tgt) SELECT anchor, round(-sum(p * log2(p)), 6) + 0.0 AS target_entropy FROM p GROUP BY anchor")
def _(d: Data) -> DataFrame:
    return stats_native.target_entropy(d.star).withColumn("target_entropy", r6("target_entropy") + 0.0)


@query("a7_run_fraction", _SATC + _TGT + " SELECT anchor, round(sum(CASE WHEN regexp_matches(target, 'A{2}|C{2}|G{2}|T{2}') THEN t ELSE 0 END) / sum(t), 6) AS avg_no_homopolymer_targets FROM tgt GROUP BY anchor")
def _(d: Data) -> DataFrame:
    return stats_native.run_fraction(d.satc, 2).withColumn("avg_no_homopolymer_targets", r6("avg_no_homopolymer_targets"))


@query("a8_distance_to_top", _SATC + _TGT + _TOP + " SELECT a.anchor, round(sum(hamming(a.target, b.target) * a.t) / sum(a.t), 6) AS avg_hamming_distance_max_target, round(sum(levenshtein(a.target, b.target) * a.t) / sum(a.t), 6) AS avg_edit_distance_max_target FROM rk a JOIN rk b ON a.anchor = b.anchor AND b.r = 1 GROUP BY a.anchor")
def _(d: Data) -> DataFrame:
    return stats_native.distance_to_top(d.satc).select("anchor", *[r6(c).alias(c) for c in ("avg_hamming_distance_max_target", "avg_edit_distance_max_target")])


_PAIRS = ", m AS (SELECT anchor, sum(t)::DOUBLE AS m FROM tgt GROUP BY anchor) SELECT a.anchor, round(sum({f}(a.target, b.target) * a.t * b.t) / max(m * (m - 1)), 6) AS {n} FROM tgt a JOIN tgt b USING (anchor) JOIN m USING (anchor) GROUP BY a.anchor"


@query("a9_all_pairs_edit", _SATC + _TGT + _PAIRS.format(f="levenshtein", n="avg_edit_distance_all_pairs"))
def _(d: Data) -> DataFrame:
    return stats_native.all_pairs_edit(d.satc).withColumn("avg_edit_distance_all_pairs", r6("avg_edit_distance_all_pairs"))


@query("a10_all_pairs_hamming", _SATC + _TGT + _PAIRS.format(f="hamming", n="avg_hamming_distance_all_pairs"))
def _(d: Data) -> DataFrame:
    return stats_native.all_pairs_hamming(d.satc).withColumn("avg_hamming_distance_all_pairs", r6("avg_hamming_distance_all_pairs"))


@query("a11_sampled_edit")
def _(d: Data) -> DataFrame:
    return stats_group.sampled_edit(d.satc, limit=20)


@query("a12_vector_signs", _STAR + ", s AS (SELECT DISTINCT anchor, sample_id FROM star), v AS (SELECT anchor, (sample_id + j) % 3 - 1 AS c FROM s, (SELECT unnest([0, 1]) AS j)) SELECT anchor, count(*) FILTER (WHERE c < 0) AS num_Cj_lt_0, count(*) FILTER (WHERE c >= 0) AS num_Cj_gt_eq_0 FROM v GROUP BY anchor")
def _(d: Data) -> DataFrame:
    return stats_native.vector_signs(d.star, d.vectors)


@query("a13_files_of_kmers", _SEQS + " SELECT kmer, count(DISTINCT file) AS n_files FROM hk GROUP BY kmer")
def _(d: Data) -> DataFrame:
    return lookup.all_kmers(d.seqs, 7)


_GENES = _SEQS + """, tv AS (SELECT file, kmer, regexp_extract(header, '\\(([^()]*)\\)', 1) AS gene, split_part(header, ' ', 1) AS variant FROM hk),
tg AS (SELECT file, kmer, count(DISTINCT gene) AS genes, count(DISTINCT (gene, variant)) AS variants, min(gene) AS gene, min(variant) AS variant FROM tv GROUP BY ALL)"""


@query("a14_transcript_groups", _GENES + " SELECT * FROM tg")
def _(d: Data) -> DataFrame:
    return lookup.transcript_groups(d.seqs, 7).withColumn("variants", F.col("variants").cast("bigint"))


@query("a15_pivot", _STAR + " SELECT anchor, target, coalesce(sum(CASE WHEN sample_id = 1 THEN count END), 0)::BIGINT AS \"N1\", coalesce(sum(CASE WHEN sample_id = 2 THEN count END), 0)::BIGINT AS \"N2\" FROM star GROUP BY ALL")
def _(d: Data) -> DataFrame:
    return supervised.pivot_samples(d.star.withColumn("sample_name", F.concat(F.lit("N"), "sample_id")), ["N1", "N2"])


@query("a16_regroup", _STAR + " SELECT anchor, target, 'R' || (sample_id % 5) AS sample_name, sum(count)::BIGINT AS count FROM star GROUP BY ALL")
def _(d: Data) -> DataFrame:
    return supervised.regroup(d.star.withColumn("sample_name", F.concat(F.lit("R"), F.col("sample_id") % 5)))


@query("a17_effect_threshold", _FDR + " SELECT round(quantile_cont(eff, 0.9), 6) AS threshold FROM c WHERE corr < 2 AND m > 40")
def _(d: Data) -> DataFrame:
    return supervised.effect_threshold(_corrected(d), "pval_opt_corrected", "effect_size_bin", 0.9, 2.0, 40).select(r6("threshold").alias("threshold"))


@query("a18_gene_summary", "SELECT r_name AS gene, count(DISTINCT n_name) AS num_extendor_gene, count(DISTINCT n_nationkey % 3) AS num_anchor_gene, string_agg(DISTINCT 'j' || (n_nationkey % 4), ',' ORDER BY 'j' || (n_nationkey % 4)) AS junctions FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name", ints=("num_anchor_gene", "num_extendor_gene"))
def _(d: Data) -> DataFrame:
    n = d.table("nation").join(d.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return classify.gene_summary(n.select(F.col("r_name").alias("gene"), F.col("n_name").alias("extendor"), (F.col("n_nationkey") % 3).alias("anchor"), F.concat(F.lit("j"), F.col("n_nationkey") % 4).alias("junction")))


# --- statistics -------------------------------------------------------------------------------------------------


@query("p1_split", _STAR + ", n AS (SELECT anchor, sample_id, sum(count) AS n FROM star GROUP BY ALL) SELECT anchor, sum(floor(n * 0.25))::BIGINT AS n_train, sum(n)::BIGINT AS n FROM n GROUP BY anchor")
def _(d: Data) -> DataFrame:
    def run(p):
        x, targets, cols = stats_group.dense(p, ["sample_id"])
        t = stats_group.split_table(x, 0.25, stats_group.seed_of(p["anchor"].iloc[0]))
        return p[:1][["anchor"]].assign(n_train=int(t.sum()), n=int(x.sum()))

    return d.star.groupBy("anchor").applyInPandas(run, "anchor string, n_train long, n long")


@query("p2_p3_p6_p7_p11_optimised")
def _(d: Data) -> DataFrame:
    return stats_group.optimised_stats(satc.anchor_filter(d.star), splits=2)


@query("p4_finite", _CF + " SELECT anchor, round(CASE WHEN flat_c OR flat_f OR cc - cn * cn / m <= 0 THEN 1.0 ELSE least(1.0, 2 * exp(-2 * s * s / (cc - cn * cn / m))) END, 6) AS pval FROM z")
def _(d: Data) -> DataFrame:
    return stats_native.finite_p(d.contrasts).select("anchor", r6("pval").alias("pval"))


@query("p5_old", _CF + ", y AS (SELECT *, coalesce(round(cn, 9) ** 2 / (nullif(cc, 0) * m), 0) AS g FROM z) SELECT anchor, round(CASE WHEN flat_c OR flat_f THEN 1.0 ELSE least(1.0, 2 * exp(-2 * (1 - CASE WHEN g > 0 THEN 1 / (1 + 1 / sqrt(g)) ELSE 0 END) * s * s / cc) * CASE WHEN g > 0 THEN 2 ELSE 1 END) END, 6) AS pval_base_old FROM y")
def _(d: Data) -> DataFrame:
    return stats_native.old_p(d.contrasts).select("anchor", r6("pval_base_old").alias("pval_base_old"))


@query("p6_asymptotic")
def _(d: Data) -> DataFrame:
    return stats_native.asymptotic_p(d.contrasts).select("anchor", r6("pval_asymp").alias("pval_asymp"))


@query("p8_p9_effects", _CF + " SELECT anchor, round(abs(coalesce(ep - en, 0)), 6) AS effect_size_bin, round(coalesce(abs(fxc / nullif(xc, 0)), 0), 6) AS effect_size_cts FROM z")
def _(d: Data) -> DataFrame:
    return stats_native.effect_sizes(d.contrasts).select("anchor", r6("effect_size_bin").alias("effect_size_bin"), r6("effect_size_cts").alias("effect_size_cts"))


@query("p10_spectral", _STAR + """, n AS (SELECT anchor, sample_id, sum(count)::DOUBLE AS n FROM star GROUP BY ALL), m AS (SELECT anchor, sum(n) AS m, count(*)::DOUBLE AS k FROM n GROUP BY anchor),
p AS (SELECT anchor, target, sum(count) / any_value(m) AS p FROM star JOIN m USING (anchor) GROUP BY ALL),
cells AS (SELECT n.anchor, p, coalesce(s.count, 0) / n AS q FROM n JOIN p USING (anchor) LEFT JOIN star s ON s.anchor = n.anchor AND s.sample_id = n.sample_id AND s.target = p.target),
t AS (SELECT anchor, sum((q - p) * (q - p)) / any_value(k) AS t FROM cells JOIN m USING (anchor) GROUP BY anchor),
a AS (SELECT anchor, sum(p * (1 - p)) AS q, sum(p * p) AS d, sum((p * (1 - p)) ** 2) AS e FROM p GROUP BY anchor),
b AS (SELECT anchor, sum(1 / n) AS i1, sum(n ** -2) AS i2, sum(n ** -3) AS i3, sum((3 * n - 6) / n ** 3) AS i4, sum((n - 2) / n ** 3) AS i5 FROM n GROUP BY anchor),
w AS (SELECT anchor, t, q * i1 / k AS mu, (q * i3 + e * i4 + i3 + (1 - 2 * d + 3 * d * d) * i5 + (i1 * i1 - i2) * q * q) / (k * k) AS v FROM t JOIN a USING (anchor) JOIN b USING (anchor) JOIN m USING (anchor)),
s AS (SELECT *, v - mu * mu AS sg FROM w)
SELECT anchor, round(t, 6) AS statistic, round(CASE WHEN sg > 0 AND v > 0 THEN least(exp(-sg * ((1 + t / sg) * ln(1 + t / sg) - t / sg)), exp(-(t - mu) ** 2 / (2 * v)), CASE WHEN t > mu THEN sg / (t - mu) ** 2 ELSE 1 END, 1.0) ELSE 1.0 END, 6) AS pval_sample_spectral_sum FROM s""")
def _(d: Data) -> DataFrame:
    s = satc.count_satc(d.star)
    return stats_native.spectral_p(s).select("anchor", r6("statistic").alias("statistic"), r6("pval_sample_spectral_sum").alias("pval_sample_spectral_sum"))


@query("p12_signs", _CF + ", r AS (SELECT anchor, target, sum(c * count / sqrt(n)) AS a, sum(count) AS r FROM x JOIN (SELECT anchor, sample_id, n FROM col) USING (anchor, sample_id) GROUP BY ALL), k2 AS (SELECT anchor, cn, m FROM k) SELECT anchor, target, (sign(round(a - r * cn / m, 12)) + 1) / 2 AS f FROM r JOIN k2 USING (anchor)")
def _(d: Data) -> DataFrame:
    s = d.star
    return stats_native.signs_from(s, s.select("sample_id").distinct().withColumn("c", (F.col("sample_id") % 3 - 1).cast("double")))


@query("p13_supervised")
def _(d: Data) -> DataFrame:
    return stats_group.supervised_stats(satc.anchor_filter(d.star), d.vectors)


@query("p14_cell_types")
def _(d: Data) -> DataFrame:
    return stats_group.cell_type_stats(satc.anchor_filter(d.star).withColumn("cell_type", F.concat(F.lit("T"), F.col("sample_id") % 3)))


@query("p15_sequence_entropy", _SATC + ", g AS (SELECT anchor, substr(anchor, unnest([1, 2]), 2) AS g FROM (SELECT DISTINCT anchor FROM satc)), h AS (SELECT anchor, g, count(*) AS n FROM g GROUP BY ALL) SELECT anchor, round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 6) + 0.0 AS anchor_2mer_seq_entropy FROM h GROUP BY anchor")
def _(d: Data) -> DataFrame:
    return stats_native.sequence_entropies(d.satc, 2).withColumn("anchor_2mer_seq_entropy", r6("anchor_2mer_seq_entropy") + 0.0)


@query("p16_chi_square", _STAR + ", n AS (SELECT anchor, sample_id, sum(count)::DOUBLE AS n FROM star GROUP BY ALL), r AS (SELECT anchor, target, sum(count)::DOUBLE AS r FROM star GROUP BY ALL), m AS (SELECT anchor, sum(n) AS m, count(*) AS k FROM n GROUP BY anchor), l AS (SELECT anchor, count(*) AS l FROM r GROUP BY anchor) SELECT anchor, round(any_value(m) * (sum(count * count / (n * r)) - 1), 6) AS chi2, ((any_value(k) - 1) * (any_value(l) - 1))::BIGINT AS dof FROM star JOIN n USING (anchor, sample_id) JOIN r USING (anchor, target) JOIN m USING (anchor) JOIN l USING (anchor) GROUP BY anchor")
def _(d: Data) -> DataFrame:
    return stats_native.chi_square(d.star).withColumn("chi2", r6("chi2"))


@query("p16_chi_square_p")
def _(d: Data) -> DataFrame:
    return stats_group.chi2_p(stats_native.chi_square(d.star))


@query("p16_eigenvectors")
def _(d: Data) -> DataFrame:
    return stats_group.eigen_stats(satc.anchor_filter(d.star))


@query("p17_sparse_model")
def _(d: Data) -> DataFrame:
    # Samples are the languages of each source, and a sample's group is its language, which its letters tell.
    r = d.reads.where(F.col("sample_name").isNotNull() & F.col("group").isNotNull()).select(F.concat_ws("-", "sample_name", "group").alias("sample_id"), "seq")
    s = satc.count_satc(pairs.enumerate_pairs(r, 3, 3).drop("pos")).withColumnRenamed("sample_id", "sample_name")
    m = s.select("sample_name", F.element_at(F.split("sample_name", "-"), -1).alias("group")).distinct()
    return supervised.fit_groups(supervised.target_shares(supervised.with_metadata(s, m), group_size=2), least=0.5)


@query("w4_column_vectors")
def _(d: Data) -> DataFrame:
    return stats_group.column_vectors(satc.anchor_filter(d.star))


# --- scalars ----------------------------------------------------------------------------------------------------

_TT = _SATC + ", tt AS (SELECT DISTINCT target AS a FROM satc), ab AS (SELECT x.a, y.a AS b FROM tt x, tt y WHERE x.a < y.a)"


def _two(d: Data) -> DataFrame:
    t = d.satc.select(F.col("target").alias("a")).distinct()
    return t.join(t.withColumnRenamed("a", "b"), F.col("a") < F.col("b"))


@query("d1_hamming", _TT + " SELECT a, b, hamming(a, b) AS d, hamming(a, b) AS by_bits FROM ab", ints=("by_bits", "d"))
def _(d: Data) -> DataFrame:
    a, b = F.col("a"), F.col("b")
    return _two(d).select("a", "b", seq.hamming(a, b).alias("d"), seq.hamming_packed(seq.pack(a), seq.pack(b)).alias("by_bits"))


@query("d2_levenshtein", _TT + " SELECT a, b, levenshtein(a, b) AS d FROM ab", ints=("d",))
def _(d: Data) -> DataFrame:
    return _two(d).select("a", "b", F.levenshtein("a", "b").alias("d"))


@query("d3_bins", "SELECT true AS all_in_range, count(DISTINCT p_brand || '-' || p_size)::BIGINT AS n FROM part")
def _(d: Data) -> DataFrame:
    a = d.table("part").select(F.concat_ws("-", "p_brand", F.col("p_size").cast("string")).alias("a")).distinct().withColumn("bin", seq.bin_of(F.col("a"), 128))
    return a.agg((F.min("bin") >= 0).alias("all_in_range"), F.count("*").alias("n"))


@query("d4_edit_runs")
def _(d: Data) -> DataFrame:
    return classify.edit_runs(classify.neighbours(_long(d).withColumnRenamed("i", "extendor_order")))


@query("d5_base_edit", _LONG + ", b AS (SELECT unnest(['A', 'C', 'G', 'T']) AS v, unnest([0, 1, 2, 3]) AS i), e AS (SELECT anchor, x.i * 4 + y.i AS k, x.v || '_to_' || y.v AS edit, replace(target, x.v, y.v) AS t FROM lg, b x, b y WHERE x.v <> y.v), o AS (SELECT anchor, k, edit FROM e GROUP BY ALL HAVING count(DISTINCT t) = 1) SELECT anchor, arg_max(edit, k) AS edit FROM o GROUP BY anchor")
def _(d: Data) -> DataFrame:
    return classify.base_edit(_long(d))


@query("d6_distributions", """WITH k AS (SELECT unnest(range(0, 21))::INT AS n),
m AS (SELECT n, exp(n * ln(2.5) - 2.5 - lgamma(n + 1)) AS p, exp(lgamma(21) - lgamma(n + 1) - lgamma(21 - n)) * 0.1 ** n * 0.9 ** (20 - n) AS b FROM k)
SELECT n, round(p, 9) AS poisson_pmf, round(least(1.0, sum(p) OVER (ORDER BY n)), 9) AS poisson_cdf, round(b, 9) AS binomial_pmf, round(least(1.0, sum(b) OVER (ORDER BY n)), 9) AS binomial_cdf,
 round(lgamma(21) - lgamma(n + 1) - lgamma(21 - n), 9) + 0.0 AS log_choose FROM m""", ints=("n",))
def _(d: Data) -> DataFrame:
    rows = [(n, compactors.poisson_pmf(n, 2.5), compactors.poisson_cdf(n, 2.5), compactors.binomial_pmf(n, 20, 0.1), compactors.binomial_cdf(n, 20, 0.1), compactors.log_choose(20, n)) for n in range(21)]
    t = d.spark.createDataFrame(rows, "n int, poisson_pmf double, poisson_cdf double, binomial_pmf double, binomial_cdf double, log_choose double")
    return t.select("n", *[(F.round(c, 9) + 0.0).alias(c) for c in t.columns[1:]])


# --- order and sets ---------------------------------------------------------------------------------------------


@query("o1_correction", _FDR + " SELECT anchor, round(corr, 6) AS corrected FROM c")
def _(d: Data) -> DataFrame:
    return _corrected(d).select("anchor", r6("pval_opt_corrected").alias("corrected"))


@query("o2_sort", "SELECT n_name, row_number() OVER (ORDER BY n_regionkey DESC, n_name DESC) AS r FROM nation", ints=("r",))
def _(d: Data) -> DataFrame:
    s = fdr.sort_rows(d.table("nation").select("n_regionkey", "n_name"), "n_regionkey", descending=True)
    return s.coalesce(1).withColumn("r", F.row_number().over(Window.orderBy(F.desc("n_regionkey"), F.desc("n_name")))).select("n_name", "r")


@query("o3_limit", "SELECT c_custkey::VARCHAR AS c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey::VARCHAR DESC LIMIT 25")
def _(d: Data) -> DataFrame:
    return fdr.limit_rows(d.table("customer").select(F.col("c_custkey").cast("string").alias("c_custkey"), "c_acctbal"), "c_acctbal", 25)


@query("o4_top_entropy", _STAR + _STGT + ", h AS (SELECT anchor, round(log2(sum(t)) - sum(t * log2(t)) / sum(t), 6) AS target_entropy FROM tgt GROUP BY anchor) SELECT anchor, target_entropy FROM h ORDER BY target_entropy DESC, anchor DESC LIMIT 30")
def _(d: Data) -> DataFrame:
    e = stats_native.target_entropy(d.star).withColumn("target_entropy", r6("target_entropy"))
    return fdr.limit_rows(e, "target_entropy", 30)


@query("o6_top_by_sample", _STAR + " SELECT sample_id, anchor, target, count FROM (SELECT *, row_number() OVER (PARTITION BY sample_id, anchor ORDER BY count DESC, target) AS r FROM star) WHERE r <= 2")
def _(d: Data) -> DataFrame:
    return satc.top_targets_by_cell(d.star, 2)


@query("o7_ranks", _LONG + ", ai AS (SELECT anchor, row_number() OVER (ORDER BY max(n) DESC, anchor) AS anchor_index FROM lg GROUP BY anchor) SELECT anchor, target, anchor_index, row_number() OVER (PARTITION BY anchor ORDER BY target_count DESC, target) AS extendor_order FROM lg JOIN ai USING (anchor)", ints=("anchor_index", "extendor_order"))
def _(d: Data) -> DataFrame:
    return classify.ranks(_long(d)).select("anchor", "target", "anchor_index", "extendor_order")


@query("o8_lead", _STAR + " SELECT sample_id, anchor, target, lead(target) OVER (PARTITION BY sample_id, anchor ORDER BY target) AS target_lead FROM star")
def _(d: Data) -> DataFrame:
    return d.star.select("sample_id", "anchor", "target", F.lead("target").over(Window.partitionBy("sample_id", "anchor").orderBy("target")).alias("target_lead"))


@query("o9_prune", "SELECT n_nationkey, n_name FROM nation")
def _(d: Data) -> DataFrame:
    return classify.prune(d.table("nation").withColumnRenamed("n_regionkey", "x_seq_entropy"))


@query("u1_union", _STAR + " SELECT anchor, sum(count)::BIGINT AS n FROM (SELECT * FROM star UNION ALL SELECT * FROM star) GROUP BY anchor")
def _(d: Data) -> DataFrame:
    return d.star.unionByName(d.star).groupBy("anchor").agg(F.sum("count").cast("bigint").alias("n"))


@query("u2_unpivot", _LONG + " SELECT anchor, i, target, target_count, anchor || target AS extendor FROM lg", ints=("i",))
def _(d: Data) -> DataFrame:
    return _long(d).select("anchor", "i", "target", "target_count", "extendor")


@query("u3_unique_to_file", _SEQS + " SELECT kmer, min(file) AS file FROM hk GROUP BY kmer HAVING count(DISTINCT file) = 1")
def _(d: Data) -> DataFrame:
    return lookup.unique_to_file(d.seqs, 7)


@query("u4_first_occurrence", "SELECT source, min(doc_id) AS doc_id FROM documents GROUP BY source")
def _(d: Data) -> DataFrame:
    w = Window.partitionBy("source").orderBy("doc_id")
    return d.table("documents").select("source", "doc_id", F.row_number().over(w).alias("r")).where("r = 1").drop("r")


# --- lookup -----------------------------------------------------------------------------------------------------


@query("l1_genome_table", _GENOME + " SELECT kmer, category, file, CASE WHEN category IN (1, 3) THEN array_to_string(labels, '|') ELSE '' END AS labels, cnt::BIGINT AS cnt FROM look")
def _(d: Data) -> DataFrame:
    return lookup.genome_table(d.seqs, 7).withColumn("labels", F.array_join("labels", "|"))


@query("l2_transcriptome_table", _GENES + ", f AS (SELECT *, count(*) OVER (PARTITION BY kmer) AS files, CASE WHEN variants = 1 THEN variant WHEN genes = 1 THEN gene END AS label FROM tg) SELECT kmer, CASE WHEN label IS NOT NULL AND files = 1 THEN 1 WHEN label IS NOT NULL THEN 3 WHEN files = 1 THEN 2 ELSE 4 END AS category, file, coalesce(label, '') AS labels, genes AS cnt FROM f")
def _(d: Data) -> DataFrame:
    return lookup.transcriptome_table(d.seqs, 7).withColumn("labels", F.array_join("labels", "|"))


@query("l3_l4_names", "SELECT item_id, 'g' || (item_id % 40) AS gene, 'tx' || item_id || '.1' AS short, 'x' || item_id || '.fa' AS base FROM benchmark")
def _(d: Data) -> DataFrame:
    i = F.col("item_id")
    header = F.concat(F.lit("tx"), i, F.lit(".1 (g"), i % 40, F.lit("), transcript variant "), i)
    return d.table("benchmark").select("item_id", lookup.gene_of(header).alias("gene"), lookup.short_header(header).alias("short"), lookup.base_name(F.concat(F.lit("/a/b/x"), i, F.lit(".fa"))).alias("base"))


@query("l5_query", _GENOME + " SELECT code, count(*) AS n, count(DISTINCT qid) AS queries, sum(pos)::BIGINT AS positions FROM hits GROUP BY code")
def _(d: Data) -> DataFrame:
    return d.hits.groupBy("code").agg(F.count("*").alias("n"), F.countDistinct("qid").alias("queries"), F.sum("pos").cast("bigint").alias("positions"))


@query("l6_plain", _GENOME + " SELECT qid, string_agg(what, ', ' ORDER BY pos) AS query_res FROM ht GROUP BY qid")
def _(d: Data) -> DataFrame:
    return lookup.report_plain(d.hits)


@query("l6_ids", _GENOME + " SELECT qid, string_agg(code, ', ' ORDER BY pos) AS query_res FROM ht GROUP BY qid")
def _(d: Data) -> DataFrame:
    return lookup.report_ids(d.hits)


@query("l6_empty", _GENOME + " SELECT DISTINCT qid, '' AS query_res FROM ht")
def _(d: Data) -> DataFrame:
    return lookup.report_empty(d.hits)


@query("l6_concise", _GENOME + ", i1 AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY pos) - 1 AS i, row_number() OVER (PARTITION BY qid ORDER BY pos) - row_number() OVER (PARTITION BY qid, what ORDER BY pos) AS isl FROM ht), rn AS (SELECT qid, what, code, min(i) AS s, count(*) AS n FROM i1 WHERE code IN ('1', '2', '3', '4') GROUP BY qid, what, code, isl), o AS (SELECT qid, string_agg(code || ':<' || s || ':' || n || '>' || CASE WHEN length(what) > 1 THEN substr(what, 2) ELSE '' END, ', ' ORDER BY s) AS r FROM rn GROUP BY qid) SELECT q.qid, coalesce(r, '') AS query_res FROM (SELECT DISTINCT qid FROM ht) q LEFT JOIN o USING (qid)")
def _(d: Data) -> DataFrame:
    return lookup.report_concise(d.hits)


@query("l7_stats", _GENOME + " SELECT qid, '1: ' || count(*) FILTER (WHERE code = '1') || ', 2: ' || count(*) FILTER (WHERE code = '2') || ', 3: ' || count(*) FILTER (WHERE code = '3') || ', 4: ' || count(*) FILTER (WHERE code = '4') || ', U: ' || count(*) FILTER (WHERE code = 'U') || ', P: ' || count(*) FILTER (WHERE code = 'P') || ', N: 0' AS query_stats FROM hits GROUP BY qid")
def _(d: Data) -> DataFrame:
    return lookup.report_stats(d.hits)


@query("l8_l9_extendors")
def _(d: Data) -> DataFrame:
    r = d.reads.select(F.col("sample_name").alias("sample_id"), "seq")
    s = satc.anchor_filter(satc.count_satc(pairs.enumerate_pairs(r, 5, 5).drop("pos")), 2000)
    return lookup.annotate_extendors(satc.frequent_targets(s, 2), lookup.genome_table(d.seqs, 7), 2, 7)


@query("l10_query_many", _GENOME + " SELECT 'conversations' AS input, count(*) AS n FROM hits UNION ALL SELECT 'again', count(*) FROM hits")
def _(d: Data) -> DataFrame:
    q = d.table("conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("qid"), seq.letters_to_bases(F.col("text")).alias("seq"))
    many = lookup.query_many({"conversations": q, "again": q}, lookup.genome_table(d.seqs, 7), 7, 5)
    a, b = (v.agg(F.count("*").alias("n")).select(F.lit(k).alias("input"), "n") for k, v in many.items())
    return a.unionByName(b)


# --- compactors -------------------------------------------------------------------------------------------------


def _compactors(d: Data) -> DataFrame:
    seeds = d.spark.createDataFrame([("ACGTACGT",), ("CATTCATT",), ("TATATATT",)], "anchor string")
    rules = compactors.Rules(kmer_len=6, num_kmers=2, lower_bound=2, max_length=44, poly=6, num_extenders=2, min_specificity=0.5)
    return compactors.assemble(d.reads.select("read_id", "seq"), seeds, 8, rules)


@query("c1_c9_compactors")
def _(d: Data) -> DataFrame:
    return _compactors(d)


@query("c10_leaves")
def _(d: Data) -> DataFrame:
    return compactors.leaves(_compactors(d))
