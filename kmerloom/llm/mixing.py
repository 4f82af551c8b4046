"""Mixing sources to target weights: hash-random order, distributed prefix sums, exact budgets, repeated epochs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, words

#: Documents in one range of a source, on average: what one running sum has to sort.
RANGE_ROWS = 5_000
WEIGHTS = (5, 2, 1)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, weight, target) from (source, source_size).

    Weights go to the sources by code point, null last, and repeat. The targets share `share` of all sizes by
    weight; none exceeds `most` times its source, and what is cut is shared among the others by weight until none
    is above: target = min(most * size, level * weight) at the one level that spends the budget. Sorted by
    size / weight, the capped sources are a prefix, so two running sums find it: the level is that of the first
    source that is not capped, and what the same sums give for those after it is less. One row for each source: the
    windows here see sources, not documents.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    total = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sizes.withColumn("weight", pick).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    by = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    s = s.select(
        "*",
        (F.sum("source_size").over(total) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(by), F.lit(0.0))).alias("left"),
        (F.sum("weight").over(total) - F.coalesce(F.sum("weight").over(by), F.lit(0.0))).alias("open"),
    )
    s = s.withColumn("full", F.col("cap") * F.col("open") <= F.col("weight") * F.col("left"))
    level = F.max(F.when(~F.col("full"), F.col("left") / F.col("open"))).over(total)
    return s.select("source", "source_size", "weight", F.when(F.col("full"), F.col("cap")).otherwise(F.least(F.col("cap"), level * F.col("weight"))).alias("target"))


def mix(docs: DataFrame, key: Column, size: Column, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, seed: str = "mix", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, source_size, target, taken, source (and the columns in `keep`) for every row of `docs`.

    Each document gets the hash of (seed, id) as a random key. Ranges of the key cut every source, hot ones most,
    into pieces of RANGE_ROWS or so; their totals give each piece its offset, and a running sum inside the one piece
    in which a source's budget ends finds the last document. A source is taken whole floor(target / size) times;
    the rest of its budget goes down the random order and cuts its last document at the word: a row is taken,
    cut or left by its place before, at or after that document, so rows and their texts stay where they
    are and only a row for each source goes to them. No sampling, so reruns and lost executors give the same rows.

    Null ids hash as empty text; null sources are a source of their own, the last; null and blank texts have size
    0 and take 0. Repeated rows tie and are summed one after another. No rows give no rows.
    """
    key_of = F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    lean = docs.select("doc_id", "source", size.cast("long").alias("size"), key.alias("_tie"), key_of.alias("_key"))
    per = lean.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("_rows"))
    cuts = source_targets(per.select("source", "source_size"), weights, share, most).join(per.select(F.col("source").alias("_s"), (F.ceil(F.col("_rows") / RANGE_ROWS)).alias("_ranges")), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    cuts = cuts.withColumn("_epochs", epochs).withColumn("_rest", F.round(F.col("target") - F.col("_epochs") * F.col("source_size")).cast("long"))
    # A row for each source. As a table its size is known, and Spark sends it to all tasks only if it is small.
    cuts = materialise(cuts.select(F.col("source").alias("_s"), "source_size", "target", "_epochs", "_rest", "_ranges"), "cuts")
    same = F.col("source").eqNullSafe(F.col("_s"))
    at = F.floor(F.conv(F.substring("_key", 1, 8), 16, 10).cast("long") * F.col("_ranges") / F.lit(2**32))
    totals = lean.join(cuts, same).groupBy("_s", at.alias("_range")).agg(F.sum("size").alias("_sum"), F.first("_rest").alias("_rest"), F.first("_ranges").alias("_ranges"))
    before = Window.partitionBy("_s").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("_offset", F.coalesce(F.sum("_sum").over(before), F.lit(0)))
    last = totals.where("_offset <= _rest and _rest < _offset + _sum").select("_s", "_range", "_offset", "_rest", "_ranges")
    last = materialise(last, "ranges")
    piece = lean.join(last, same & (at == F.col("_range")))
    inside = Window.partitionBy("_s").orderBy("_key", "doc_id", "size", "_tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    place = F.struct("_key", "doc_id", "size", "_tie")
    start = piece.select("*", (F.col("_offset") + F.sum("size").over(inside) - F.col("size")).alias("_start"), place.alias("_end"))
    # The rows that are equal to the last document, itself included: the first one's start, and how many they are.
    twins = start.groupBy("_s", "_end").agg(F.min("_start").alias("_start"), F.count("*").alias("_twins"), F.max(F.col("_start") + F.col("size")).alias("_stop"), F.first("_rest").alias("_rest"))
    ends = twins.where("_start <= _rest and _rest < _stop").select("_s", "_end", "_start", "_twins")
    cuts = materialise(cuts.join(ends.withColumnRenamed("_s", "_e"), F.col("_s").eqNullSafe(F.col("_e")), "left").drop("_e"), "cuts")

    rows = docs.select(
        "doc_id", "source", size.cast("long").alias("size"), key.alias("_tie"), key_of.alias("_key"), *[F.col(c).alias(f"_keep_{c}") for c in keep],
    )
    left = F.col("_rest") - F.col("_start")
    part = F.when(F.col("_end").isNull() | (place < F.col("_end")), F.col("size")).when(place > F.col("_end"), F.lit(0)).otherwise(F.least(F.col("size"), left))
    one = F.coalesce((F.col("_twins") == 1) | (place != F.col("_end")), F.lit(True))
    several = Window.partitionBy("source").orderBy("_key")
    among = F.greatest(F.lit(0), F.least(F.col("size"), left - (F.row_number().over(several) - 1) * F.col("size")))
    out = ["doc_id", "size", "source_size", "target"]
    rest = ["source", *[F.col(f"_keep_{c}").alias(c) for c in keep]]
    taken = lambda p: (F.col("_epochs") * F.col("size") + p).cast("long").alias("taken")
    single = rows.join(cuts, same).where(one).select(*out, taken(part), *rest)
    again = cuts.where("_twins > 1")  # seldom any
    equal = rows.join(again, same & F.col("doc_id").eqNullSafe(F.col("_end.doc_id"))).where(~one).withColumn("_part", among).select(*out, taken(F.col("_part")), *rest)
    return single.unionByName(equal)


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def mix_documents(docs: DataFrame, keep: tuple[str, ...] = (), **more) -> DataFrame:
    """mix() of documents by their words, ties by text; `keep` are further columns of `docs` to return."""
    tie = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    return mix(docs, tie, n_words(F.col("text")), keep=keep, **more)


ORACLE = """
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         md5('mix' || coalesce(doc_id::VARCHAR, '')) AS k FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight,
             source_size * 2.0::DOUBLE AS cap FROM s),
p AS (SELECT *, (sum(source_size) OVER ())::DOUBLE * 1.5 - coalesce(sum(cap) OVER o, 0) AS rest,
             (sum(weight) OVER ()) - coalesce(sum(weight) OVER o, 0) AS open
      FROM w WINDOW o AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, cap * open <= weight * rest AS full_ FROM p),
t AS (SELECT source, source_size, CASE WHEN full_ THEN cap ELSE least(cap, weight * max(CASE WHEN NOT full_ THEN rest / open END) OVER ()) END AS target FROM f),
r AS (SELECT d.*, t.source_size, t.target, sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id ROWS UNBOUNDED PRECEDING) - size AS start,
             CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS epochs
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (epochs * size + greatest(0, least(size, round(target - epochs * source_size) - start)))::BIGINT AS taken, source FROM r
"""
