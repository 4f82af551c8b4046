"""Small text tables: sample sheets, count tables as text, lists of anchors and artifacts, vectors, cell types."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def numbered(lines: DataFrame) -> DataFrame:
    """Adds _n, the order of lines in a small file that one task reads."""
    return lines.coalesce(1).withColumn("_n", F.monotonically_increasing_id())


def require_unique(df: DataFrame, *keys: str) -> DataFrame:
    """`df`, or an error that names a repeated key."""
    row = df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").first()
    if row:
        raise ValueError(f"{', '.join(keys)} repeated: {', '.join(str(row[k]) for k in keys)}")
    return df


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """Sample sheet, `name path` a line: sample_id (0-based order), sample_name, path; names are unique."""
    lines = numbered(spark.read.text(path).where(F.trim("value") != ""))
    parts = F.split(F.trim("value"), r"\s+", 2)
    out = lines.select((F.row_number().over(Window.orderBy("_n")) - 1).alias("sample_id"), parts[0].alias("sample_name"), parts[1].alias("path"))
    return require_unique(out, "sample_name")


def read_sample_files(spark: SparkSession, path: str) -> DataFrame:
    """Barcoded sample file, `R1,R2` a line: r1, r2."""
    parts = F.split(F.trim("value"), r"\s*,\s*")
    return spark.read.text(path).where(F.trim("value") != "").select(parts[0].alias("r1"), parts[1].alias("r2"))


def first_seen_ids(rows: DataFrame, name: str, order: str) -> DataFrame:
    """Name and its 0-based id in the order of first appearance."""
    first = rows.groupBy(name).agg(F.min(order).alias("_first"))
    return first.select(name, (F.row_number().over(Window.orderBy("_first", name)) - 1).alias("id"))


def undump(lines: DataFrame, anchor_len: int, count_cap: int | None = None) -> DataFrame:
    """A count table from text lines (column value): sample, barcode, anchor, target, count.

    Tabs: sample [barcode] anchor target count. Spaces: count anchor+target sample[_barcode]. The flavour is each
    line's own, by its tabs; a barcode is null where the line has none.
    """
    tab, space = F.split("value", "\t"), F.split(F.trim("value"), " +")
    is_tab = F.col("value").contains("\t")
    bc = F.size(tab) == 5
    at = lambda i: F.get(tab, F.lit(i))
    last = lambda i: F.get(tab, F.size(tab) - i)
    cell = F.get(space, F.lit(2))
    barcode = F.nullif(F.regexp_extract(cell, "_([ACGT]+)$", 1), F.lit(""))
    both = F.get(space, F.lit(1))
    count = F.when(is_tab, last(1)).otherwise(F.get(space, F.lit(0))).cast("bigint")
    return lines.where(F.trim("value") != "").select(
        F.when(is_tab, at(0)).otherwise(F.regexp_replace(cell, "_[ACGT]+$", "")).alias("sample"),
        F.when(is_tab & bc, at(1)).when(~is_tab, barcode).alias("barcode"),
        F.when(is_tab, last(3)).otherwise(F.substring(both, 1, anchor_len)).alias("anchor"),
        F.when(is_tab, last(2)).otherwise(F.expr(f"substring({_sql(space)}[1], {anchor_len + 1})")).alias("target"),
        (F.least(count, F.lit(count_cap).cast("bigint")) if count_cap else count).alias("count"),
    )


def _sql(_: Column) -> str:
    return "split(trim(value), ' +')"


def read_dsv(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """A table with a header, all columns text."""
    return spark.read.csv(path, sep=sep, header=True)


def read_anchors(spark: SparkSession, path: str) -> DataFrame:
    """Anchors of a plain list, or of the `anchor` column of a table cut by tabs, semicolons or commas.

    All have one length, or it is an error.
    """
    head = spark.read.text(path).first()
    out = None
    for sep in "\t;,":
        if head and "anchor" in head["value"].split(sep) and (sep in head["value"] or head["value"] == "anchor"):
            out = read_dsv(spark, path, sep).select("anchor")
            break
    if out is None:
        out = spark.read.text(path).select(F.explode(F.split("value", r"\s+")).alias("anchor"))
    out = out.where(F.trim("anchor") != "").distinct()
    n = out.agg(F.min(F.length("anchor")).alias("a"), F.max(F.length("anchor")).alias("b")).first()
    if n["a"] != n["b"]:
        raise ValueError("the anchors have different lengths")
    return out


def extendors(stats: DataFrame) -> DataFrame:
    """Anchor, i, extendor of all most_freq_target_i columns, without `-` and nulls."""
    import re

    cols = sorted((int(m[1]), c) for c in stats.columns if (m := re.fullmatch(r"most_freq_target_([1-9][0-9]*)", c)))
    x = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(c).alias("t")) for i, c in cols]))
    return stats.select("anchor", x.alias("x")).where(F.col("x.t").isNotNull() & (F.col("x.t") != "-")).select("anchor", "x.i", F.concat("anchor", "x.t").alias("extendor"))


def compactor_sequences(table: DataFrame) -> DataFrame:
    """S13."""
    return table.select("compactor")


def column_vectors(sheet: DataFrame, samples: DataFrame) -> DataFrame:
    """(sample_id, j, c) of lines (value) `name, c1, c2, ...`: each sample once, all there, as many values each."""
    parts = F.transform(F.split("value", ","), lambda x: F.trim(x))
    rows = sheet.where(F.trim("value") != "").select(parts[0].alias("sample_name"), F.slice(parts, F.lit(2), F.size(parts)).alias("cs"))
    require_unique(rows, "sample_name")
    bad = samples.select("sample_name").exceptAll(rows.select("sample_name")).first()
    if bad:
        raise ValueError(f"no vector for sample {bad['sample_name']}")
    n = rows.agg(F.min(F.size("cs")).alias("a"), F.max(F.size("cs")).alias("b")).first()
    if n["a"] != n["b"]:
        raise ValueError("the samples have different numbers of values")
    j = rows.join(samples.select("sample_id", "sample_name"), "sample_name")
    return j.select("sample_id", F.posexplode("cs").alias("j", "c")).select("sample_id", "j", F.col("c").cast("double").alias("c"))


def cell_types(sheet: DataFrame, samples: DataFrame) -> DataFrame:
    """(sample_id, barcode, cell_type) of lines (value) `cell_type,barcode,sample`; a cell has one type."""
    p = F.transform(F.split("value", ","), lambda x: F.trim(x))
    rows = sheet.where(F.trim("value") != "").select(p[0].alias("cell_type"), p[1].alias("barcode"), p[2].alias("sample_name"))
    return require_unique(rows.join(samples.select("sample_id", "sample_name"), "sample_name").select("sample_id", "barcode", "cell_type"), "sample_id", "barcode")


def artifacts(lines: DataFrame, most: int = 32) -> DataFrame:
    """Distinct tokens of text lines (value), of up to `most` symbols; a longer one is an error."""
    out = lines.select(F.explode(F.split("value", r"\s+")).alias("artifact")).where("artifact <> ''").distinct()
    if row := out.where(F.length("artifact") > most).first():
        raise ValueError(f"artifact of more than {most} symbols: {row['artifact']}")
    return out


def artifacts_file(spark: SparkSession, path: str) -> DataFrame:
    """artifacts() of a text file."""
    return artifacts(spark.read.text(path))


# Public sequencing adapters and primers, from which the dictionary's 12-mers are cut.
ADAPTERS = (
    "AGATCGGAAGAGCACACGTCTGAACTCCAGTCA",
    "AGATCGGAAGAGCGTCGTGTAGGGAAAGAGTGT",
    "CTGTCTCTTATACACATCT",
    "TGGAATTCTCGGGTGCCAAGG",
    "GATCGTCGGACTGTAGAACTCTGAAC",
    "AATGATACGGCGACCACCGAGATCTACAC",
    "CAAGCAGAAGACGGCATACGAGAT",
    "AATGATACGGCGACCACCGAGATCTACACTCTTTCCCTACACGACGCTCTTCCGATCT",
    "CAAGCAGAAGACGGCATACGAGATCGGTCTCGGCATTCCTGCTGAACCGCTCTTCCGATCT",
    "GATCGGAAGAGCGGTTCAGCAGGAATGCCGAG",
    "GATCGGAAGAGCACACGTCTGAACTCCAGTCAC",
    "ATCTCGTATGCCGTCTTCTGCTTG",
    "TCGTCGGCAGCGTCAGATGTGTATAAGAGACAG",
    "GTCTCGTGGGCTCGGAGATGTGTATAAGAGACAG",
    "GTTCAGAGTTCTACAGTCCGACGATC",
)


def adapter_dictionary(spark: SparkSession, k: int = 12, adapters: Iterable[str] = ADAPTERS) -> DataFrame:
    """K-mers of adapters and their reverse complements, as a list of artifacts; `adapters` takes any other list."""
    comp = str.maketrans("ACGT", "TGCA")
    words = {s[i : i + k] for a in adapters for s in (a, a.translate(comp)[::-1]) for i in range(len(s) - k + 1)}
    return spark.createDataFrame([(w,) for w in sorted(words)], "artifact string")


def read_satc(spark: SparkSession, path: str) -> DataFrame:
    """A count table in this engine's own format, Parquet."""
    return spark.read.parquet(path)


def lookup_hits(counts: DataFrame, lookup: DataFrame) -> DataFrame:
    """A listing of (kmer, count) in order, with its category or U."""
    return counts.join(lookup.select("kmer", "category"), "kmer", "left").select("kmer", "count", F.coalesce(F.col("category").cast("string"), F.lit("U")).alias("category")).orderBy("kmer")
