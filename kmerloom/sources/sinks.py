"""Writers: count tables, statistics, vectors, FASTA, and the report of a run."""

from __future__ import annotations

import json
import resource
import struct
import time
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.seq import bin_of
from ..operators.satc import cell
from .tables import extendors

#: Orders of a count table's rows: sample first, anchor first, target first.
ORDERS = {"SBATC": ("sample_id", "anchor", "target"), "ATSBC": ("anchor", "target", "sample_id"), "TASBC": ("target", "anchor", "sample_id")}


def write_satc(satc: DataFrame, path: str, bins: int = 128, order: str = "ATSBC") -> None:
    """Parquet in hash bins of the anchor, rows in one of ORDERS inside each."""
    b = satc.withColumn("bin", bin_of(F.col("anchor"), bins))
    b.repartition(bins, "bin").sortWithinPartitions("bin", *ORDERS[order]).write.partitionBy("bin").option("compression", "zstd").parquet(path)


def write_satc_table(satc: DataFrame, name: str, bins: int = 128, order: str = "ATSBC") -> None:
    """W1 as a bucketed table: joins and groups on the anchor then need no shuffle."""
    satc.write.bucketBy(bins, "anchor").sortBy(*ORDERS[order]).format("parquet").saveAsTable(name)


def dump_lines(satc: DataFrame, flavour: str = "satc") -> DataFrame:
    """One text column: `satc`, with tabs: sample [barcode] anchor target count.

    `counts`, with spaces: count anchor+target sample[_barcode]. undump() reads both.
    """
    names = F.col("sample_name") if "sample_name" in satc.columns else F.col("sample_id").cast("string")
    bc = [F.col("barcode")] if "barcode" in satc.columns else []
    n = F.col("count").cast("string")
    if flavour == "satc":
        return satc.select(F.concat_ws("\t", names, *bc, "anchor", "target", n).alias("value"))
    return satc.select(F.concat_ws(" ", n, F.concat("anchor", "target"), F.concat_ws("_", names, *bc)).alias("value"))


def with_sentinels(stats: DataFrame) -> DataFrame:
    """Nulls as `-`, floats of entropies kept narrow; all columns as text."""
    return stats.select(*[F.coalesce(F.col(c).cast("string"), F.lit("-")).alias(c) for c in stats.columns])


def significant_digits(c: Column, digits: int = 6) -> Column:
    """The compatible rendering of statistics with so many significant digits."""
    return F.when(c == 0, F.lit(0.0)).otherwise(F.format_string(f"%.{digits - 1}e", c.cast("double")).cast("double"))


def write_stats(stats: DataFrame, path: str) -> None:
    with_sentinels(stats).write.csv(path, sep="\t", header=True)


def write_vectors(vectors: DataFrame, path: str) -> None:
    """Gzipped TSV of anchor, sample, [barcode], cj."""
    vectors.write.csv(path, sep="\t", header=True, compression="gzip")


def fasta_of_extendors(stats: DataFrame, n: int) -> DataFrame:
    """FASTA records of an anchor's first n targets, without missing ones: anchor, i, value."""
    return extendors(stats).where(F.col("i") <= n).select("anchor", "i", F.concat(F.lit(">\n"), "extendor").alias("value"))


def fasta_of_compactors(compactors: DataFrame) -> DataFrame:
    """`>compactor-<id>` records."""
    return compactors.select("anchor", "id", F.concat(F.lit(">compactor-"), F.col("id").cast("string"), F.lit("\n"), F.col("compactor")).alias("value"))


def pseudo_alignment(satc: DataFrame, anchors: DataFrame, n: int, target_len: int, with_anchors: bool = True, wrap: int = 60) -> DataFrame:
    """Per sample (cell) one sequence: for each anchor of the list, in order, the anchor and its n most counted
    targets there, absent ones as N: the cell's columns, value. Anchors outside the list are an error.

    Each sample meets each listed anchor once: that is the result's own size.
    """
    keys = cell(satc)
    listed = anchors.select("anchor").distinct()
    if row := satc.select("anchor").distinct().join(listed, "anchor", "left_anti").first():
        raise ValueError(f"anchor {row['anchor']} is not in the list")
    order = Window.partitionBy(*keys, "anchor").orderBy(F.desc("count"), "target")
    top = satc.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= n)
    got = top.groupBy(*keys, "anchor").agg(F.array_sort(F.collect_list(F.struct("_r", "target"))).alias("ts"))
    grid = satc.select(*keys).distinct().crossJoin(listed)  # the cells of the alignment
    j = grid.join(got, [*keys, "anchor"], "left")
    none = F.lit("N" * target_len)
    targets = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.coalesce(F.get(F.col("ts"), i)["target"], none)), "")
    piece = F.concat("anchor", targets) if with_anchors else targets
    seq = j.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("anchor", piece.alias("piece")))).alias("a"))
    whole = F.array_join(F.transform("a", lambda x: x["piece"]), "")
    wrapped = F.regexp_replace(whole, f"(.{{{wrap}}})(?=.)", "$1\n") if wrap else whole
    return seq.select(*keys, F.concat(F.lit(">"), F.concat_ws("_", *keys), F.lit("\n"), wrapped).alias("value"))


def bam_files(reads: DataFrame, member_bytes: int = 60_000) -> DataFrame:
    """Reads (header, seq) as BAM files without alignments, one a partition: path, content. sources.reads.bam_reads() reads them."""
    code = {c: i for i, c in enumerate("=ACMGRSVTWYHKDBN")}  # fixed by the format

    def record(name: str, seq: str) -> bytes:
        codes = [code[c] for c in seq] + [0] * (len(seq) % 2)
        body = bytes(a << 4 | b for a, b in zip(codes[::2], codes[1::2], strict=True))
        head = struct.pack("<iiBBHHHiiii", -1, -1, len(name) + 1, 0, 4680, 0, 4, len(seq), -1, -1, 0)
        data = head + name.encode() + b"\0" + body + b"\xff" * len(seq)
        return struct.pack("<i", len(data)) + data

    def member(data: bytes) -> bytes:
        z = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = z.compress(data) + z.flush()
        head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(body) + 25)
        return head + body + struct.pack("<II", zlib.crc32(data), len(data))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        data, out = b"BAM\1" + struct.pack("<ii", 0, 0), []
        for p in parts:
            for name, seq in zip(p["header"], p["seq"], strict=True):
                data += record(name, seq)
                while len(data) > member_bytes:
                    out.append(member(data[:member_bytes]))
                    data = data[member_bytes:]
        out += [member(data), member(b"")]
        yield pd.DataFrame({"path": [f"part-{TaskContext.get().partitionId():05}.bam"], "content": [b"".join(out)]})

    return reads.select("header", "seq").mapInPandas(run, "path string, content binary")


class RunReport:
    """Seconds, rows and sizes of a run's steps, as JSON."""

    def __init__(self) -> None:
        self.values: dict[str, float] = {}

    def timed(self, name: str, step: Callable[[], DataFrame]) -> DataFrame:
        t = time.time()
        out = step()
        self.values[f"N_{name}"] = out.count()
        self.values[f"T_{name}"] = round(time.time() - t, 3)
        return out

    def sized(self, name: str, df: DataFrame, path: str) -> int:
        """S_<name>: MiB of the files below a path, in whatever store Spark reaches it."""
        jvm = df.sparkSession._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        fs = at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration())
        size = fs.getContentSummary(at).getLength()
        self.values[f"S_{name}"] = round(size / (1 << 20), 3)
        return size

    def to_json(self) -> str:
        peak = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024
        return json.dumps(self.values | {"M_driver": round(peak, 1)}, sort_keys=True)
