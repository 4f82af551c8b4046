"""Sequence files as tables: FASTQ, FASTA, BAM, sample sheets, and the text bridge."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.seq import letters_to_bases

#: Columns of a table of reads.
READS = ("file", "header", "seq")


def format_of(path: Column) -> Column:
    """S3: fastq, fasta or bam by the file's name, with or without .gz; null for others."""
    p = F.regexp_replace(F.lower(path), r"\.gz$", "")
    return F.when(p.rlike(r"\.(fastq|fq)$"), "fastq").when(p.rlike(r"\.(fasta|fa|fna|fas)$"), "fasta").when(p.rlike(r"\.bam$"), "bam")


def sniff(first: Column) -> Column:
    """S3: the format by a file's first character."""
    return F.when(first.startswith("@"), "fastq").when(first.startswith(">"), "fasta")


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """Records of four lines, LF or CR LF, plain or gz: file, header, seq.

    A record may straddle two splits of a file, so lines are told apart by number and not by their first character:
    lines are numbered inside their file by a running count over splits, a pass over lengths alone.
    """
    raw = spark.read.text(path, wholetext=False).select(F.input_file_name().alias("file"), F.expr("input_file_block_start()").alias("_at"), F.monotonically_increasing_id().alias("_id"), F.rtrim("value").alias("value"))
    block = raw.groupBy("file", "_at").agg(F.count("*").alias("n"), F.min("_id").alias("_first"))
    before = block.withColumn("_before", F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    n = raw.join(F.broadcast(before), ["file", "_at"]).withColumn("n", F.col("_id") - F.col("_first") + F.col("_before"))  # a row a split
    rec = n.where("n % 4 < 2").groupBy("file", F.floor(F.col("n") / 4).alias("record")).agg(F.max(F.when(F.col("n") % 4 == 0, F.expr("substring(value, 2)"))).alias("header"), F.max(F.when(F.col("n") % 4 == 1, F.upper("value"))).alias("seq"))
    return rec.select("file", "record", "header", "seq")


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """Multi-FASTA with sequences over any number of lines: file, header, seq (order is not kept).

    A record begins at a `>` that begins a line; others belong to the header they stand in. What comes before the
    first record of a file is none.
    """
    raw = spark.read.option("lineSep", "\n>").text(path).select(F.input_file_name().alias("file"), F.expr("input_file_block_start()").alias("_at"), F.monotonically_increasing_id().alias("_id"), "value")
    # Of a file's first piece alone the `>` is not cut off by the separator.
    first = raw.where("_at = 0").groupBy("file").agg(F.min("_id").alias("_first"))
    raw = raw.join(F.broadcast(first), "file", "left")  # a row a file
    lead = F.coalesce(F.col("_id") == F.col("_first"), F.lit(False))
    raw = raw.where(~lead | F.col("value").startswith(">")).select("file", F.when(lead, F.expr("substring(value, 2)")).otherwise(F.col("value")).alias("value"))
    head = F.regexp_extract("value", r"^([^\r\n]*)", 1)
    body = F.upper(F.regexp_replace(F.expr("substring(value, length(regexp_extract(value, '^([^\\r\\n]*)', 1)) + 1)"), r"\s", ""))
    return raw.select("file", head.alias("header"), body.alias("seq"))


def _bam_records(data: bytes) -> Iterator[tuple[str, str]]:
    """Names and sequences of the public BAM layout: BGZF members of little-endian records."""
    out, at = [], 0
    while at < len(data):
        d = zlib.decompressobj(31)
        out.append(d.decompress(data[at:]))
        at = len(data) - len(d.unused_data)
    b = b"".join(out)
    if b[:4] != b"BAM\1":
        raise ValueError("not a BAM file")
    at = 8 + struct.unpack_from("<i", b, 4)[0]
    n = struct.unpack_from("<i", b, at)[0]
    at += 4
    for _ in range(n):
        at += 8 + struct.unpack_from("<i", b, at)[0]
    codes = "=ACMGRSVTWYHKDBN"  # fixed by the format
    while at < len(b):
        size = struct.unpack_from("<i", b, at)[0]
        name_len, n_ops, length = b[at + 12], struct.unpack_from("<H", b, at + 16)[0], struct.unpack_from("<i", b, at + 20)[0]
        p = at + 36
        name = b[p : p + name_len - 1].decode()
        p += name_len + 4 * n_ops
        seq = "".join(codes[x >> 4] + codes[x & 15] for x in b[p : p + (length + 1) // 2])[:length]
        yield name, seq
        at += 4 + size


def bam_reads(files: DataFrame) -> DataFrame:
    """Names and sequences of BAM files (path, content): file, header, seq."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for file, data in zip(p["path"], p["content"], strict=True):
                records = _bam_records(bytes(data))
                while rows := list(islice(records, 100_000)):
                    yield pd.DataFrame({"file": file, "header": [r[0] for r in rows], "seq": [r[1] for r in rows]})

    return files.select("path", "content").mapInPandas(run, "file string, header string, seq string")


def read_bam(spark: SparkSession, path: str) -> DataFrame:
    """bam_reads() of files, a file a task; a file has at most 2 GB."""
    return bam_reads(spark.read.format("binaryFile").load(path))


def read_sequences(spark: SparkSession, path: str) -> DataFrame:
    """S3: any of the formats by the file's name: file, header, seq."""
    p = path.lower().removesuffix(".gz")
    if p.endswith((".fastq", ".fq")):
        return read_fastq(spark, path).select(*READS)
    if p.endswith(".bam"):
        return read_bam(spark, path)
    return read_fasta(spark, path).select(*READS)


def allowed_headers(reads: DataFrame, pattern: str) -> DataFrame:
    """Reads whose whole header matches."""
    return reads.where(F.col("header").rlike(f"^(?:{pattern})$"))


def auto_gap(reads: DataFrame, anchor_len: int, target_len: int) -> int:
    """max(0, (length of the first read - both lengths) // 2)."""
    row = reads.select(F.length("seq").alias("n")).limit(1).first()
    return max(0, (row["n"] - anchor_len - target_len) // 2) if row else 0


def read_stats(reads: DataFrame) -> DataFrame:
    """n_reads, n_bases, n_valid_reads of a table of reads."""
    return reads.agg(F.count("*").alias("n_reads"), F.coalesce(F.sum(F.length("seq")), F.lit(0)).cast("bigint").alias("n_bases"), F.count_if(~F.col("seq").rlike("[^ACGT]")).alias("n_valid_reads"))


def text_bridge(documents: DataFrame) -> DataFrame:
    """Documents as reads: sample_name their source, read_id their id, seq their letters as bases."""
    return documents.select(F.col("source").alias("sample_name"), F.col("lang").alias("group"), F.col("doc_id").alias("read_id"), letters_to_bases(F.col("text")).alias("seq"))


def star_bridge(lineitem: DataFrame, part: DataFrame, supplier: DataFrame) -> DataFrame:
    """A count table of sales: anchor brand and size, target line number and flags, sample the supplier's nation."""
    x = lineitem.join(part, lineitem["l_partkey"] == part["p_partkey"]).join(supplier, lineitem["l_suppkey"] == supplier["s_suppkey"])
    target = F.concat("l_returnflag", "l_linestatus", F.col("l_linenumber").cast("string"))
    rows = x.select(F.col("s_nationkey").alias("sample_id"), F.concat_ws("-", "p_brand", F.col("p_size").cast("string")).alias("anchor"), target.alias("target"))
    return rows.groupBy("sample_id", "anchor", "target").agg(F.count("*").alias("count"))
