"""Extendors of significant anchors: pairs of targets, edits, annotation joins, clusters of shifted anchors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.seq import BASES, hamming, has_run
from ..session import written
from .fdr import numbered

#: Columns that classification drops from an anchor table.
DROPPED = ("pval_opt", "pval_sample_spectral_sum", "pval_base", "avg_no_homopolymer_targets", "avg_hamming_distance_max_target", "avg_hamming_distance_all_pairs", "avg_edit_distance_max_target", "avg_edit_distance_all_pairs")


def prune(stats: DataFrame, names: tuple[str, ...] = DROPPED, pattern: str = "seq_entropy") -> DataFrame:
    """Without the named columns and those whose name holds `pattern`."""
    return stats.drop(*[c for c in stats.columns if c in names or pattern in c])


def long_targets(stats: DataFrame) -> DataFrame:
    """A row for each of an anchor's two most counted targets, where it has both: anchor, i, target, target_count, extendor and the other columns."""
    two = [f"{p}most_freq_target_{i}" for i in (1, 2) for p in ("", "cnt_")]
    both = stats.where(F.col("most_freq_target_1").isNotNull() & F.col("most_freq_target_2").isNotNull())
    x = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"most_freq_target_{i}").alias("target"), F.col(f"cnt_most_freq_target_{i}").alias("target_count")) for i in (1, 2)]))
    return both.withColumn("_x", x).drop(*two).select("*", "_x.*").drop("_x").withColumn("extendor", F.concat("anchor", "target"))


def ranks(rows: DataFrame) -> DataFrame:
    """anchor_index by (samples desc, anchor), extendor_order in the anchor by (count desc, target).

    The index counts distinct anchors, in ranges where they are many.
    """
    a = rows.groupBy("anchor").agg(F.max("number_nonzero_samples").alias("_s"))
    a = numbered(a, [("_s", True), ("anchor", False)], "anchor_index").drop("_s")
    return rows.join(a, "anchor").withColumn("extendor_order", F.row_number().over(Window.partitionBy("anchor").orderBy(F.desc("target_count"), "target")))


def without_run_extendors(rows: DataFrame, run: int = 9) -> DataFrame:
    """extendors without a run of `run` bases, of anchors that keep at least two targets."""
    kept = rows.where(~has_run(F.col("extendor"), run))
    n = F.size(F.collect_set("target").over(Window.partitionBy("anchor")))  # two targets at most
    return kept.withColumn("_n", n).where(F.col("_n") > 1).drop("_n")


def neighbours(rows: DataFrame) -> DataFrame:
    """Each anchor's target beside the next one by rank, with lev_dist and ham_dist."""
    w = Window.partitionBy("anchor").orderBy("extendor_order")
    n = rows.withColumn("target_lead", F.lead("target").over(w)).where(F.col("target_lead").isNotNull())
    return n.select("anchor", "target", "target_lead", F.levenshtein("target", "target_lead").alias("lev_dist"), hamming(F.col("target"), F.col("target_lead")).alias("ham_dist"))


def edit_script(a: str, b: str, substitution: int = 1) -> str:
    """Operations that turn a into b at least cost: M match, S substitute, D delete, I insert."""
    rows = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(rows[-1][j] + 1, row[j - 1] + 1, rows[-1][j - 1] + (0 if x == y else substitution)))
        rows.append(row)
    i, j, out = len(a), len(b), []
    while i or j:
        if i and j and rows[i][j] == rows[i - 1][j - 1] + (0 if a[i - 1] == b[j - 1] else substitution):
            i, j = i - 1, j - 1
            out.append("M" if a[i] == b[j] else "S")
        elif i and rows[i][j] == rows[i - 1][j] + 1:
            i -= 1
            out.append("D")
        else:
            j -= 1
            out.append("I")
    return "".join(reversed(out))


def edit_runs(pairs: DataFrame) -> DataFrame:
    """lev_operations, lcs_operations (no substitutions), and the longest runs of D and I in the first."""

    def run(parts):
        for p in parts:
            lev = [edit_script(a, b) for a, b in zip(p["target"], p["target_lead"], strict=True)]
            lcs = [edit_script(a, b, 100) for a, b in zip(p["target"], p["target_lead"], strict=True)]
            longest = lambda s, c: max((len(x) for x in "".join(k if k == c else " " for k in s).split()), default=0)
            yield p.assign(lev_operations=lev, lcs_operations=lcs, run_length_D=[longest(s, "D") for s in lev], run_length_I=[longest(s, "I") for s in lev])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pairs.schema)
    return pairs.mapInPandas(run, f"{fields}, lev_operations string, lcs_operations string, run_length_D int, run_length_I int")


def base_edit(targets: DataFrame) -> DataFrame:
    """Anchor, edit: the last of the 12 substitutions X to Y, in the bases' order, that makes all targets equal."""
    subs = [F.struct(F.lit(i * 4 + j).alias("k"), F.lit(f"{x}_to_{y}").alias("edit"), F.replace("target", F.lit(x), F.lit(y)).alias("t")) for i, x in enumerate(BASES) for j, y in enumerate(BASES) if x != y]
    e = targets.select("anchor", "target").distinct().select("anchor", F.explode(F.array(*subs)).alias("x")).select("anchor", "x.*")
    one = e.groupBy("anchor", "k", "edit").agg(F.min("t").alias("a"), F.max("t").alias("b")).where(F.col("a") == F.col("b"))
    return one.groupBy("anchor").agg(F.max_by("edit", "k").alias("edit"))


def annotate(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Left join with an annotation the caller brings, the first of repeated keys (U4) by all its columns."""
    w = Window.partitionBy(key).orderBy(*[c for c in table.columns if c != key])
    one = table.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1).drop("_r")
    return rows.join(one, key, "left")


def overlapping(a: DataFrame, b: DataFrame, width: int = 10_000) -> DataFrame:
    """Pairs of half-open intervals (chrom, start, end, id) of `a` and `b` that overlap: a_id, b_id.

    An interval falls into all bins of `width` that it touches; a pair counts in the bin where the later of the two
    begins, so none is listed twice and the join is on equal keys.
    """
    bins = lambda d, p: d.select("chrom", *[F.col(c).alias(f"{p}_{c}") for c in ("start", "end", "id")], F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("end") - 1) / width))).alias("bin"))
    j = bins(a, "a").join(bins(b, "b"), ["chrom", "bin"]).where("a_start < b_end and b_start < a_end")
    return j.where(F.col("bin") == F.floor(F.greatest("a_start", "b_start") / width)).select("a_id", "b_id")


def gene_summary(rows: DataFrame) -> DataFrame:
    """Per gene the number of distinct extendors and anchors, and its junctions, sorted and comma-joined."""
    return rows.groupBy("gene").agg(F.size(F.collect_set("extendor")).alias("num_extendor_gene"), F.size(F.collect_set("anchor")).alias("num_anchor_gene"), F.array_join(F.array_sort(F.collect_set("junction")), ",").alias("junctions"))


def shifted_anchors(anchors: DataFrame, most: int = 5) -> DataFrame:
    """Links a, b, shift: a without its first `shift` symbols is b without its last, 1 to `most`, the least shift."""
    a = anchors.select(F.col("anchor").alias("a")).distinct()
    s = F.explode(F.sequence(F.lit(1), F.lit(most))).alias("shift")
    tail = a.select("a", s).select("a", "shift", F.expr("substring(a, shift + 1)").alias("part"))
    head = a.select(F.col("a").alias("b"), s).select("b", "shift", F.expr("substring(b, 1, length(b) - shift)").alias("part"))
    return tail.join(head, ["shift", "part"]).where("a <> b").groupBy("a", "b").agg(F.min("shift").alias("shift"))


def anchor_clusters(anchors: DataFrame, most: int = 5) -> DataFrame:
    """Anchor, cluster: the smallest anchor reached over shifted_anchors() links, by repeated minimum."""
    e = shifted_anchors(anchors, most)
    both = written(e.select("a", "b").unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "shifted")
    c = written(anchors.select("anchor").distinct().withColumn("cluster", F.col("anchor")), "clusters")
    while True:
        low = both.join(c.select(F.col("anchor").alias("b"), "cluster"), "b").groupBy(F.col("a").alias("anchor")).agg(F.min("cluster").alias("low"))
        n = c.join(low, "anchor", "left").select("anchor", F.least("cluster", F.coalesce("low", "cluster")).alias("new"), F.col("cluster").alias("old"))
        # A cluster's own anchor may have moved on: follow it, which halves the way each round.
        up = n.select(F.col("anchor").alias("new"), F.col("new").alias("up"))
        n = written(n.join(up, "new", "left").select("anchor", F.least("new", F.coalesce("up", "new")).alias("cluster"), "old"), "clusters")
        c = n.select("anchor", "cluster")
        if n.where("cluster <> old").isEmpty():
            return c
