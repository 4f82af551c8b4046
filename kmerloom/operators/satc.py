"""The count table (sample_id, barcode, anchor, target, count): counting, filters, top targets, unions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.seq import hamming
from .pairs import poly_filter


def cell(df: DataFrame) -> list[str]:
    """Columns that make a contingency table's column: the sample, and the barcode where there is one."""
    return ["sample_id", "barcode"] if "barcode" in df.columns else ["sample_id"]


def count_satc(pairs: DataFrame, count_cap: int | None = None) -> DataFrame:
    """A1: (sample_id[, barcode], anchor, target, count); partial sums are made before the shuffle.

    `count_cap` bounds a count as a 16-bit counter would.
    """
    n = F.sum("count") if "count" in pairs.columns else F.count("*")
    out = pairs.groupBy(*cell(pairs), "anchor", "target").agg(n.cast("bigint").alias("count"))
    return out.withColumn("count", F.least("count", F.lit(count_cap).cast("bigint"))) if count_cap else out


def anchors_above(satc: DataFrame, threshold: int = 5) -> DataFrame:
    """records of anchors that a sample counts more than `threshold` times.

    A running total beside each record rather than a join with the totals, so the counts are made once.
    """
    total = F.sum("count").over(Window.partitionBy(*cell(satc), "anchor"))
    return satc.withColumn("_n", total).where(F.col("_n") > threshold).drop("_n")


def without_runs(satc: DataFrame, n: int = 8) -> DataFrame:
    """F2. The predicate is on a grouping key, so it reaches below the aggregate."""
    return satc.where(poly_filter(F.col("anchor"), n))


def without_artifacts(satc: DataFrame, artifacts: DataFrame) -> DataFrame:
    """anchors that contain none of the listed strings, of whatever lengths.

    Distinct anchors are exploded into their substrings of the listed lengths and met with the list by hash, so a
    long list costs no more than a short one.
    """
    art = artifacts.select("artifact").distinct().withColumn("_n", F.length("artifact"))
    sizes = art.select("_n").distinct()
    a = satc.select("anchor").distinct().join(F.broadcast(sizes), F.col("_n") <= F.length("anchor"))  # at most one row a length
    sub = a.withColumn("_i", F.explode(F.sequence(F.lit(1), F.length("anchor") - F.col("_n") + 1))).select("anchor", F.substr("anchor", "_i", "_n").alias("artifact"))
    return satc.join(sub.join(art, "artifact", "left_semi").select("anchor").distinct(), "anchor", "left_anti")


def hamming_filter(satc: DataFrame, least: int) -> DataFrame:
    """anchors of a sample with two targets at least `least` apart; 0 keeps all, one target never suffices.

    The distance to the first target tells most groups apart by itself: one of `least` is a pair found, and if all are
    below half of it no two targets are `least` apart. Only groups in between compare their targets, and of those
    only one that is half as far from the first can be in a pair.
    """
    if least == 0:
        return satc
    every = Window.partitionBy(*cell(satc), "anchor")
    x = satc.withColumn("_d", hamming(F.col("target"), F.min("target").over(every))).withColumn("_far", F.max("_d").over(every))
    found = x.where(F.col("_far") >= least).drop("_d", "_far")
    open_ = x.where((F.col("_far") < least) & (2 * F.col("_far") >= least))
    keys = [*cell(satc), "anchor"]
    a = open_.select(*keys, "target", "_d").distinct()
    b = a.where(2 * F.col("_d") >= least).select(*keys, F.col("target").alias("_other"), F.col("_d").alias("_e"))
    far = a.join(b, keys).where((F.col("_d") + F.col("_e") >= least) & (hamming(F.col("target"), F.col("_other")) >= least))
    return found.unionByName(open_.drop("_d", "_far").join(far.select(*keys).distinct(), keys, "left_semi"))


def accept(satc: DataFrame, anchors: DataFrame) -> DataFrame:
    """Only anchors of the list."""
    return satc.join(anchors.select("anchor").distinct(), "anchor", "left_semi")


def anchor_totals(satc: DataFrame) -> DataFrame:
    """A2: anchor, M, anch_uniqTargs, number_nonzero_samples.

    Distinct targets and cells are counted in two steps each, which pre-aggregate, rather than by expansion.
    """
    t = satc.groupBy("anchor", "target").agg(F.sum("count").alias("m")).groupBy("anchor").agg(F.sum("m").cast("bigint").alias("M"), F.count("*").alias("anch_uniqTargs"))
    s = satc.groupBy("anchor", *cell(satc)).agg(F.lit(1).alias("x")).groupBy("anchor").agg(F.count("*").alias("number_nonzero_samples"))
    return t.join(s, "anchor")


def anchor_filter(satc: DataFrame, count: int = 50, targets: int = 1, samples: int = 1) -> DataFrame:
    """records of anchors that above_thresholds() keeps."""
    return satc.join(above_thresholds(anchor_totals(satc), count, targets, samples).select("anchor"), "anchor", "left_semi")


def above_thresholds(totals: DataFrame, count: int = 50, targets: int = 1, samples: int = 1) -> DataFrame:
    """Anchors with M > count, distinct targets > targets, samples > samples (all strict)."""
    return totals.where((F.col("M") > count) & (F.col("anch_uniqTargs") > targets) & (F.col("number_nonzero_samples") > samples))


def rich_samples(satc: DataFrame, least: int) -> DataFrame:
    """records of samples (cells) with more than `least` distinct anchors."""
    keys = cell(satc)
    n = satc.groupBy(*keys, "anchor").agg(F.lit(1).alias("x")).groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > least)
    return satc.join(n.drop("n"), keys, "left_semi")


def with_cell_type(satc: DataFrame, types: DataFrame) -> DataFrame:
    """Records whose (sample, barcode) has a cell type, with it. See untyped() for the others."""
    return satc.join(types.select("sample_id", "barcode", "cell_type"), ["sample_id", "barcode"])


def untyped(satc: DataFrame, types: DataFrame) -> DataFrame:
    return satc.select("sample_id", "barcode").distinct().join(types, ["sample_id", "barcode"], "left_anti")


def top_targets(satc: DataFrame, n: int) -> DataFrame:
    """A3, A4: records of each anchor's n most counted targets (ties by target), with the totals before the cut.

    Adds M_before_filter and anch_uniqTargs_before_filter.
    """
    t = satc.groupBy("anchor", "target").agg(F.sum("count").alias("_t"))
    order = Window.partitionBy("anchor").orderBy(F.desc("_t"), "target")
    every = Window.partitionBy("anchor")
    keep = t.select("anchor", "target", F.row_number().over(order).alias("_r"), F.sum("_t").over(every).cast("bigint").alias("M_before_filter"), F.count("*").over(every).alias("anch_uniqTargs_before_filter")).where(F.col("_r") <= n)
    return satc.join(keep.drop("_r"), ["anchor", "target"])


def frequent_targets(satc: DataFrame, n: int) -> DataFrame:
    """A5: one row an anchor, most_freq_target_i and cnt_most_freq_target_i for i up to n, null where there is none."""
    t = satc.groupBy("anchor", "target").agg(F.sum("count").cast("bigint").alias("c"))
    r = t.withColumn("r", F.row_number().over(Window.partitionBy("anchor").orderBy(F.desc("c"), "target"))).where(F.col("r") <= n)
    cols = [F.max(F.when(F.col("r") == i, F.col(x))).alias(f"{name}_{i}") for i in range(1, n + 1) for x, name in (("target", "most_freq_target"), ("c", "cnt_most_freq_target"))]
    return r.groupBy("anchor").agg(*cols)


def top_targets_by_cell(satc: DataFrame, n: int) -> DataFrame:
    """Each sample's (cell's) n most counted targets of an anchor, ties by target."""
    order = Window.partitionBy(*cell(satc), "anchor").orderBy(F.desc("count"), "target")
    return satc.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= n).drop("_r")


def merge(*tables: DataFrame) -> DataFrame:
    """The union of bins or samples as one table; different columns are an error."""
    if len({tuple(sorted(t.columns)) for t in tables}) != 1:
        raise ValueError("the tables have different columns")
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return count_satc(out)


def sample_names(satc: DataFrame, samples: DataFrame) -> DataFrame:
    """sample_name beside sample_id."""
    return satc.join(samples.select("sample_id", "sample_name"), "sample_id")
