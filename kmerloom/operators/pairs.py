"""Windows, k-mers, followers: the table functions that turn sequences into rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.seq import canonical, has_run, is_valid

#: New positions in one chunk of a sequence: substring() walks from the start of its string.
CHUNK = 128


def chunks(reads: DataFrame, width: int, seq: str = "seq", chunk: int = CHUNK) -> DataFrame:
    """Cut sequences into overlapping pieces, so that each window of `width` lies in one: adds _piece and _at.

    _at is the 1-based position of the piece in the sequence. Sequences shorter than `width` give no piece.
    """
    last = F.length(seq) - (width - 1)
    starts = F.sequence(F.lit(1), last, F.lit(chunk))
    out = reads.where(F.length(seq) >= width).withColumn("_at", F.explode(starts))
    return out.withColumn("_piece", F.substr(F.col(seq), F.col("_at"), F.lit(chunk + width - 1)))


def windows(reads: DataFrame, width: int, seq: str = "seq") -> DataFrame:
    """All windows of `width` symbols with their 1-based position: columns of `reads` without `seq`, pos, window."""
    keep = [c for c in reads.columns if c != seq]
    c = chunks(reads, width, seq).drop(seq)
    at = F.explode(F.sequence(F.lit(1), F.length("_piece") - (width - 1))).alias("_i")
    w = c.select(*keep, "_at", "_piece", at)
    return w.select(*keep, (F.col("_at") + F.col("_i") - 1).alias("pos"), F.substr("_piece", "_i", F.lit(width)).alias("window"))


def enumerate_pairs(reads: DataFrame, anchor_len: int, target_len: int, gap: int = 0, seq: str = "seq") -> DataFrame:
    """Anchor, gap, target of every window without invalid symbols (K1): adds pos, anchor, target."""
    w = windows(reads, anchor_len + gap + target_len, seq).where(is_valid(F.col("window")))
    keep = [c for c in w.columns if c != "window"]
    return w.select(*keep, F.substring("window", 1, anchor_len).alias("anchor"), F.substring("window", anchor_len + gap + 1, target_len).alias("target"))


def shorten_gap(reads: DataFrame, anchor_len: int, target_len: int, gap: int, short: int, seq: str = "seq") -> DataFrame:
    """Pseudo-reads whose windows with gap `short` are the reads' windows with `gap` (K2).

    Each window becomes a read of its own: anchor, the first `short` symbols of the gap, target.
    """
    w = windows(reads, anchor_len + gap + target_len, seq)
    keep = [c for c in w.columns if c not in ("window", "pos")]
    return w.select(*keep, F.concat(F.substring("window", 1, anchor_len + short), F.substring("window", anchor_len + gap + 1, target_len)).alias(seq))


def kmers(reads: DataFrame, k: int, keep_invalid: bool = False, as_canonical: bool = False, seq: str = "seq") -> DataFrame:
    """k-mer walk: invalid ones skipped (K3), or kept at their positions with is_valid false (K4)."""
    w = windows(reads, k, seq).withColumnRenamed("window", "kmer")
    w = w.withColumn("is_valid", is_valid(F.col("kmer"))) if keep_invalid else w.where(is_valid(F.col("kmer")))
    return w.withColumn("kmer", canonical(F.col("kmer"))) if as_canonical else w


def dictionary_pairs(reads: DataFrame, anchors: DataFrame, anchor_len: int, target_len: int, n: int = 1) -> DataFrame:
    """Targets next to the anchors of a dictionary, the n most counted of each: anchor, target, count (K7)."""
    p = enumerate_pairs(reads, anchor_len, target_len).join(anchors.select("anchor").distinct(), "anchor", "left_semi")
    c = p.groupBy("anchor", "target").agg(F.count("*").alias("count"))
    order = Window.partitionBy("anchor").orderBy(F.desc("count"), "target")
    return c.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n).drop("rank")


def select_reads(reads: DataFrame, anchors: DataFrame, anchor_len: int, mode: str = "whole", offset: int = 0, first: bool = True) -> DataFrame:
    """Reads that hold an anchor of the list (K8): read_id, anchor, pos, part.

    `part` is the read up to the anchor's end plus `offset` symbols ("prefix"), from the anchor's start less
    `offset` on ("suffix"), or all of it. `first` takes a read's first anchor only.
    """
    hits = kmers(reads.select("read_id", "seq"), anchor_len).withColumnRenamed("kmer", "anchor").join(anchors.select("anchor").distinct(), "anchor", "left_semi")
    if first:
        hits = hits.groupBy("read_id").agg(F.min(F.struct("pos", "anchor")).alias("h")).select("read_id", "h.anchor", "h.pos")
    r = hits.join(reads.select("read_id", "seq"), "read_id")
    begin = F.greatest(F.lit(1), F.col("pos") - offset)
    part = {
        "prefix": F.substr("seq", F.lit(1), F.col("pos") + (anchor_len - 1 + offset)),
        "suffix": F.substr("seq", begin),
        "whole": F.col("seq"),
    }[mode]
    return r.select("read_id", "anchor", "pos", part.alias("part"))


def followers(reads: DataFrame, seeds: DataFrame, seed_len: int, k: int, n: int, first: bool = True) -> DataFrame:
    """After each seed, n k-mers one after another (K9): read_id, seed, pos, followers (array, null from the first invalid on).

    A read needs seed_len + n * k symbols; `first` takes the first occurrence of each read.
    """
    long_enough = reads.select("read_id", "seq").where(F.length("seq") >= seed_len + n * k)
    hits = kmers(long_enough, seed_len).withColumnRenamed("kmer", "seed").join(seeds.select("seed").distinct(), "seed", "left_semi")
    if first:
        hits = hits.groupBy("read_id").agg(F.min(F.struct("pos", "seed")).alias("h")).select("read_id", "h.seed", "h.pos")
    r = hits.join(long_enough, "read_id")
    cut = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.substr(F.col("seq"), F.col("pos") + seed_len + i * k, F.lit(k)))
    good = lambda x: (F.length(x) == k) & is_valid(x)
    bad_before = lambda i: F.exists(F.slice(F.col("f"), F.lit(1), i + 1), lambda y: ~good(y))
    r = r.withColumn("f", cut)
    return r.select("read_id", "seed", "pos", F.transform("f", lambda x, i: F.when(~bad_before(i), x)).alias("followers"))


def predecessors(reads: DataFrame, extenders: DataFrame, k: int, gap: int) -> DataFrame:
    """For an extender at a position, the k-mer that ends `gap` symbols before it (K10): read_id, extender, pos, pred."""
    hits = kmers(reads.select("read_id", "seq"), k).withColumnRenamed("kmer", "extender").join(extenders.select("extender").distinct(), "extender", "left_semi")
    r = hits.join(reads.select("read_id", "seq"), "read_id").where(F.col("pos") > gap + k)
    pred = F.substr("seq", F.col("pos") - (gap + k), F.lit(k))
    return r.select("read_id", "extender", "pos", pred.alias("pred")).where(is_valid(F.col("pred")))


def knee(reads: DataFrame) -> DataFrame:
    """(sample_id, least): reads of the last barcode before the bend of a sample's curve of reads by rank, both as logarithms.

    The bend is the point farthest above the straight line from the first to the last barcode; ties go to more
    reads. The curve is a histogram, a row for each number of reads, so the windows see no barcodes.
    """
    n = reads.groupBy("sample_id", "barcode").agg(F.count("*").alias("n")).groupBy("sample_id", "n").agg(F.count("*").alias("c"))
    down = Window.partitionBy("sample_id").orderBy(F.desc("n"))
    every = Window.partitionBy("sample_id")
    x = n.withColumn("x", F.log(F.sum("c").over(down))).withColumn("y", F.log("n"))
    x0, x1, y0, y1 = F.min("x").over(every), F.max("x").over(every), F.max("y").over(every), F.min("y").over(every)
    above = (F.col("y") - y0) * (x1 - x0) - (F.col("x") - x0) * (y1 - y0)
    return x.withColumn("above", F.round(above, 9)).groupBy("sample_id").agg(F.max(F.struct("above", "n"))["n"].alias("least"))


def barcoded_counts(pairs_of_reads: DataFrame, anchor_len: int, target_len: int, barcode_len: int = 16, umi_len: int = 12, threshold: int | str = 0, gap: int = 0) -> DataFrame:
    """Counts by (sample_id, barcode, anchor, target) of distinct molecules.

    `pairs_of_reads` has sample_id, r1 (barcode, then UMI) and r2. A molecule is a distinct (barcode, UMI, anchor,
    target); barcodes with fewer than `threshold` reads are left out, with "knee" those below a sample's knee().
    """
    r = pairs_of_reads.where(F.length("r1") >= barcode_len + umi_len).select("sample_id", F.substring("r1", 1, barcode_len).alias("barcode"), F.substring("r1", barcode_len + 1, umi_len).alias("umi"), F.col("r2").alias("seq"))
    if threshold == "knee":
        good = r.groupBy("sample_id", "barcode").agg(F.count("*").alias("n")).join(knee(r), "sample_id").where("n >= least")
        r = r.join(good.select("sample_id", "barcode"), ["sample_id", "barcode"], "left_semi")
    elif threshold:
        good = r.groupBy("sample_id", "barcode").agg(F.count("*").alias("n")).where(F.col("n") >= threshold)
        r = r.join(good.drop("n"), ["sample_id", "barcode"], "left_semi")
    p = enumerate_pairs(r, anchor_len, target_len, gap).select("sample_id", "barcode", "umi", "anchor", "target").distinct()
    return p.groupBy("sample_id", "barcode", "anchor", "target").agg(F.count("*").alias("count"))


def poly_filter(col: Column, n: int) -> Column:
    """keep sequences without a run of n equal bases; n = 0, or above the length, keeps all."""
    return ~has_run(col, n)
