"""Per-anchor statistics that DataFrame aggregates express; X is the table of targets by samples of one anchor."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.seq import BASES, hamming, has_run
from .satc import cell


def by_target(satc: DataFrame) -> DataFrame:
    return satc.groupBy("anchor", "target").agg(F.sum("count").alias("t"))


def target_entropy(satc: DataFrame) -> DataFrame:
    """Anchor, target_entropy in bits; 0 for a single target."""
    t = by_target(satc)
    m = t.groupBy("anchor").agg(F.sum("t").alias("m"), F.sum(F.col("t") * F.log2("t")).alias("tl"), F.count("*").alias("n"))
    return m.select("anchor", F.when(F.col("n") == 1, F.lit(0.0)).otherwise(F.log2("m") - F.col("tl") / F.col("m")).alias("target_entropy"))


def run_fraction(satc: DataFrame, run: int = 5) -> DataFrame:
    """Anchor, avg_no_homopolymer_targets: the share of counts whose target has a run of `run` equal bases."""
    t = by_target(satc)
    return t.groupBy("anchor").agg((F.sum(F.when(has_run(F.col("target"), run), F.col("t")).otherwise(0)) / F.sum("t")).alias("avg_no_homopolymer_targets"))


def distance_to_top(satc: DataFrame) -> DataFrame:
    """Mean Hamming and edit distance to the most counted target (ties: the first), over all counts."""
    t = by_target(satc)
    top = t.groupBy("anchor").agg(F.max_by("target", F.struct(F.col("t"), F.translate("target", "ACGT", "TGCA"))).alias("top"))
    # Of equal counts the smallest target is the one whose complement is largest.
    d = t.join(top, "anchor")
    mean = lambda x: F.sum(x * F.col("t")) / F.sum("t")
    return d.groupBy("anchor").agg(mean(hamming(F.col("target"), F.col("top"))).alias("avg_hamming_distance_max_target"), mean(F.levenshtein("target", "top")).alias("avg_edit_distance_max_target"))


def all_pairs_hamming(satc: DataFrame) -> DataFrame:
    """Mean Hamming distance of two counts of an anchor drawn without replacement.

    By histograms of the bases at each position: the sum over positions of h * (M - h), over M * (M - 1), which
    is exact for any number of targets and needs no pairs. Null for M = 1.
    """
    t = by_target(satc)
    p = t.select("anchor", "t", F.posexplode(F.split("target", "")).alias("pos", "base"))
    h = p.groupBy("anchor", "pos", "base").agg(F.sum("t").alias("h"))
    m = t.groupBy("anchor").agg(F.sum("t").cast("double").alias("m"))
    s = h.join(m, "anchor").groupBy("anchor", "m").agg(F.sum(F.col("h") * (F.col("m") - F.col("h"))).alias("s"))
    return s.select("anchor", (F.col("s") / F.nullif(F.col("m") * (F.col("m") - 1), F.lit(0.0))).alias("avg_hamming_distance_all_pairs"))


def all_pairs_edit(satc: DataFrame, limit: int = 200) -> DataFrame:
    """Mean edit distance over ordered pairs of counts, for anchors of at most `limit` targets.

    Larger anchors are sampled by stats_group.sampled_edit().
    """
    t = by_target(satc).withColumn("n", F.count("*").over(Window.partitionBy("anchor"))).where(F.col("n") <= limit).drop("n")
    m = t.groupBy("anchor").agg(F.sum("t").cast("double").alias("m"))
    o = t.select("anchor", F.col("target").alias("o"), F.col("t").alias("u"))
    s = t.join(o, "anchor").where("target < o").groupBy("anchor").agg(F.sum(2 * F.levenshtein("target", "o") * F.col("t") * F.col("u")).alias("s"))
    return m.join(s, "anchor", "left").select("anchor", (F.coalesce("s", F.lit(0)) / F.nullif(F.col("m") * (F.col("m") - 1), F.lit(0.0))).alias("avg_edit_distance_all_pairs"))


def vector_signs(satc: DataFrame, vectors: DataFrame) -> DataFrame:
    """Numbers of samples of an anchor with c < 0 and c >= 0, over all vectors j together."""
    s = satc.select("anchor", "sample_id").distinct().join(vectors.select("sample_id", "j", "c"), "sample_id")
    return s.groupBy("anchor").agg(F.count_if(F.col("c") < 0).alias("num_Cj_lt_0"), F.count_if(F.col("c") >= 0).alias("num_Cj_gt_eq_0"))


def signs_from(satc: DataFrame, c: DataFrame) -> DataFrame:
    """F of each target from a column vector: sign of its centred score, as 0, 1/2 or 1.

    f and 1 - f score alike but for the sign, as each centred column adds up to 0, and f wins the tie.
    """
    keys = cell(satc)
    x = satc.join(c, keys)
    n = x.groupBy("anchor", *keys).agg(F.sum("count").alias("n"))
    x = x.join(n, ["anchor", *keys])
    r = x.groupBy("anchor", "target").agg(F.sum(F.col("c") * F.col("count") / F.sqrt("n")).alias("a"), F.sum("count").alias("r"))
    t = n.join(c, keys).groupBy("anchor").agg(F.sum(F.col("c") * F.sqrt("n")).alias("cn"), F.sum("n").alias("m"))
    score = F.round(F.col("a") - F.col("r") * F.col("cn") / F.col("m"), 12)
    return r.join(t, "anchor").select("anchor", "target", ((F.signum(score) + 1) / 2).alias("f"))


def contrasts(satc: DataFrame, c: DataFrame, f: DataFrame) -> DataFrame:
    """The sums that P4 to P6, P8 and P9 take: one row an anchor.

    `c` has the columns of cell() and c; `f` has anchor, target, f. Rows without a partner in either are left out.
    """
    keys = cell(satc)
    x = satc.join(c, keys).join(f, ["anchor", "target"])
    col = x.groupBy("anchor", *keys, "c").agg(F.sum("count").alias("n"), F.sum(F.col("f") * F.col("count")).alias("fx"), F.sum(F.col("f") * F.col("f") * F.col("count")).alias("ffx"))
    pos, neg = F.col("c") > 0, F.col("c") < 0
    total = col.groupBy("anchor").agg(
        F.sum("n").alias("m"), F.sum("fx").alias("fr"), F.sum("ffx").alias("ffr"),
        F.sum(F.col("c") * F.col("fx") / F.sqrt("n")).alias("s1"), F.sum(F.col("c") * F.sqrt("n")).alias("cn"), F.sum(F.col("c") * F.col("c")).alias("cc"),
        (F.min("c") == F.max("c")).alias("flat_c"),
        F.sum(F.when(pos, F.col("fx"))).alias("fx_pos"), F.sum(F.when(pos, F.col("n"))).alias("n_pos"),
        F.sum(F.when(neg, F.col("fx"))).alias("fx_neg"), F.sum(F.when(neg, F.col("n"))).alias("n_neg"),
        F.sum(F.col("c") * F.col("fx")).alias("fxc"), F.sum(F.abs("c") * F.col("n")).alias("xc"),
    )
    flat = x.groupBy("anchor").agg((F.min("f") == F.max("f")).alias("flat_f"))
    return total.join(flat, "anchor").withColumn("s", F.col("s1") - F.col("fr") / F.col("m") * F.col("cn"))


def finite_p(x: DataFrame, name: str = "pval") -> DataFrame:
    """P4 on contrasts(): min(1, 2 exp(-2 S^2 / (sum c^2 - (sum c sqrt n)^2 / M))); 1 for a constant c or f."""
    spread = F.col("cc") - F.col("cn") * F.col("cn") / F.col("m")
    p = F.least(F.lit(1.0), 2 * F.exp(-2 * F.col("s") * F.col("s") / spread))
    return x.withColumn(name, F.when(F.col("flat_c") | F.col("flat_f") | (spread <= 0), F.lit(1.0)).otherwise(p))


def old_p(x: DataFrame, name: str = "pval_base_old") -> DataFrame:
    """P5: the older bound, which splits its budget by gamma."""
    # Rounded, as sums that cancel leave noise and the bound doubles for any gamma above 0.
    gamma = F.pow(F.round("cn", 9), 2) / (F.col("cc") * F.col("m"))
    xi = F.when(gamma > 0, 1 / (1 + 1 / F.sqrt(gamma))).otherwise(F.lit(0.0))
    p = 2 * F.exp(-2 * (1 - xi) * F.col("s") * F.col("s") / F.col("cc")) * F.when(gamma > 0, 2).otherwise(1)
    return x.withColumn(name, F.when(F.col("flat_c") | F.col("flat_f"), F.lit(1.0)).otherwise(F.least(F.lit(1.0), p)))


def erfc(x: Column) -> Column:
    """Complementary error function of x >= 0, by the continued fraction for large and the series for small x."""
    t = x * x
    steps = F.sequence(F.lit(60), F.lit(1), F.lit(-1))
    series = F.aggregate(steps, F.lit(1.0), lambda s, k: 1 + s * 2 * t / (2 * k + 1))
    small = 1 - 2 / math.sqrt(math.pi) * x * F.exp(-t) * series
    frac = F.aggregate(steps, x, lambda s, k: x + k / 2 / s)
    return F.when(x < 2.5, small).otherwise(F.exp(-t) / (math.sqrt(math.pi) * frac))


def asymptotic_p(x: DataFrame, name: str = "pval_asymp") -> DataFrame:
    """erfc(|S| / sqrt(2 var(f) (|c|^2 - (c sqrt n)^2 / M))); 1 where that is not positive."""
    var_f = F.col("ffr") / F.col("m") - F.pow(F.col("fr") / F.col("m"), 2)
    var = var_f * (F.col("cc") - F.col("cn") * F.col("cn") / F.col("m"))
    z = F.abs("s") / F.sqrt(2 * F.when(var > 1e-12, var))
    return x.withColumn(name, F.coalesce(erfc(z), F.lit(1.0)))


def effect_sizes(x: DataFrame) -> DataFrame:
    """P8 effect_size_bin (0 if one side is empty) and P9 effect_size_cts."""
    by_side = F.abs(F.col("fx_pos") / F.col("n_pos") - F.col("fx_neg") / F.col("n_neg"))
    return x.withColumn("effect_size_bin", F.coalesce(by_side, F.lit(0.0))).withColumn("effect_size_cts", F.coalesce(F.abs(F.col("fxc") / F.nullif(F.col("xc"), F.lit(0.0))), F.lit(0.0)))


def spectral_p(satc: DataFrame) -> DataFrame:
    """P10: anchor, statistic, pval_sample_spectral_sum, from sums over columns and rows alone.

    With p the row shares and n the column sums, the statistic is the mean over columns of |x / n - p|^2. The
    sparse entries give it: (x / n - p)^2 of each, and for the empty cells p^2 as often as a target is missing.
    """
    keys = cell(satc)
    x = satc.groupBy("anchor", "target", *keys).agg(F.sum("count").cast("double").alias("x"))
    n = x.groupBy("anchor", *keys).agg(F.sum("x").alias("n"))
    r = x.groupBy("anchor", "target").agg(F.sum("x").alias("r"))
    m = n.groupBy("anchor").agg(
        F.sum("n").alias("m"), F.count("*").cast("double").alias("k"), F.sum(1 / F.col("n")).alias("i1"), F.sum(1 / F.col("n") ** 2).alias("i2"),
        F.sum(1 / F.col("n") ** 3).alias("i3"), F.sum((3 * F.col("n") - 6) / F.col("n") ** 3).alias("i4"), F.sum((F.col("n") - 2) / F.col("n") ** 3).alias("i5"),
    )
    p = r.join(m.select("anchor", "m"), "anchor").withColumn("p", F.col("r") / F.col("m"))
    rows = p.groupBy("anchor").agg(F.sum(F.col("p") * (1 - F.col("p"))).alias("q"), F.sum(F.col("p") ** 2).alias("d"), F.sum((F.col("p") * (1 - F.col("p"))) ** 2).alias("e"))
    e = x.join(n, ["anchor", *keys]).join(p.select("anchor", "target", "p"), ["anchor", "target"])
    full = e.groupBy("anchor", "target", "p").agg(F.sum((F.col("x") / F.col("n") - F.col("p")) * (F.col("x") / F.col("n") - F.col("p"))).alias("w"), F.count("*").alias("c"))
    cross = full.join(m.select("anchor", F.col("k").alias("_k")), "anchor").groupBy("anchor").agg(F.sum(F.col("w") + (F.col("_k") - F.col("c")) * F.col("p") * F.col("p")).alias("w"))
    a = m.join(rows, "anchor").join(cross, "anchor")
    k, q, d = F.col("k"), F.col("q"), F.col("d")
    a = a.withColumn("t", F.col("w") / k).withColumn("mu", q * F.col("i1") / k)
    sig = q * F.col("i3") + F.col("e") * F.col("i4") + F.col("i3") + (1 - 2 * d + 3 * d * d) * F.col("i5") + (F.col("i1") ** 2 - F.col("i2")) * q * q
    a = a.withColumn("v", sig / (k * k)).withColumn("sigma", F.col("v") - F.col("mu") ** 2)
    ratio = F.col("t") / F.col("sigma")
    kl = F.exp(-F.col("sigma") * ((1 + ratio) * F.log(1 + ratio) - ratio))
    gauss = F.exp(-((F.col("t") - F.col("mu")) ** 2) / (2 * F.col("v")))
    cheb = F.when(F.col("t") > F.col("mu"), F.col("sigma") / (F.col("t") - F.col("mu")) ** 2).otherwise(F.lit(1.0))
    ok = (F.col("sigma") > 0) & (F.col("v") > 0)
    return a.select("anchor", F.col("t").alias("statistic"), F.when(ok, F.least(kl, gauss, cheb, F.lit(1.0))).otherwise(F.lit(1.0)).alias("pval_sample_spectral_sum"))


def chi_square(satc: DataFrame) -> DataFrame:
    """P16, the statistic: anchor, chi2, dof. The p-value is stats_group.chi2_p()."""
    keys = cell(satc)
    x = satc.groupBy("anchor", "target", *keys).agg(F.sum("count").cast("double").alias("x"))
    n = x.groupBy("anchor", *keys).agg(F.sum("x").alias("n"))
    r = x.groupBy("anchor", "target").agg(F.sum("x").alias("r"))
    m = n.groupBy("anchor").agg(F.sum("n").alias("m"), F.count("*").alias("k")).join(r.groupBy("anchor").agg(F.count("*").alias("l")), "anchor")
    s = x.join(n, ["anchor", *keys]).join(r, ["anchor", "target"]).groupBy("anchor").agg(F.sum(F.col("x") ** 2 / (F.col("n") * F.col("r"))).alias("s"))
    return s.join(m, "anchor").select("anchor", (F.col("m") * (F.col("s") - 1)).alias("chi2"), ((F.col("k") - 1) * (F.col("l") - 1)).alias("dof"))


def sequence_entropies(satc: DataFrame, m: int) -> DataFrame:
    """P15 of each anchor by positions: entropy of its m-mers, as DOUBLE (the sink casts to FLOAT)."""
    a = satc.select("anchor").distinct().where(F.length("anchor") >= m)
    g = a.select("anchor", F.explode(F.transform(F.sequence(F.lit(1), F.length("anchor") - (m - 1)), lambda i: F.substr("anchor", i, F.lit(m)))).alias("target"))
    return target_entropy(g.withColumn("count", F.lit(1))).withColumnRenamed("target_entropy", f"anchor_{m}mer_seq_entropy")


def base_shares(satc: DataFrame) -> DataFrame:
    """Share of each base at each position of an anchor's targets: the histogram behind all_pairs_hamming()."""
    p = by_target(satc).select("anchor", "t", F.posexplode(F.split("target", "")).alias("pos", "base"))
    one = [F.sum(F.when(F.col("base") == b, F.col("t")).otherwise(0)).alias(b) for b in BASES]
    return p.groupBy("anchor", "pos").agg(*one)
