"""Benchmark decontamination: size-partitioned MinHash containment search, then exact shingle containment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, materialise, words

WIDTH = 5
CONTAINMENT = 0.75


def shingle_structs(width: int, col: str = "_w") -> Column:
    """Array of structs of `width` adjacent entries of the array column `col`; empty if it is shorter."""
    n = F.greatest(F.size(col) - (width - 1), F.lit(0))
    return F.arrays_zip(*[F.slice(F.col(col), i + 1, n).alias(f"w{i}") for i in range(width)])


def _hashed(df: DataFrame, width: int, *keep: str) -> DataFrame:
    """One row (keep, h) for each shingle; words are hashed once, in generated code after explode()."""
    x = df.where(F.size("_w") >= width).select(*keep, F.explode(shingle_structs(width)).alias("x"))
    return x.select(*keep, F.xxhash64(F.lit(width), *[F.col(f"x.w{i}") for i in range(width)]).alias("h"))


def sketches(items: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """(item, width, n, h): per item the smallest hashes of its distinct shingles.

    Items fall into size partitions by doubling shingle counts. A partition whose largest item has n shingles
    keeps floor((1 - containment) * n) + 1 minimum hashes of each: a document that holds enough of an item can't
    miss all of these, so the search loses nothing whatever the length of the document.
    """
    d = items.groupBy("item", "width").agg(F.array_sort(F.collect_set("h")).alias("hs"))
    d = d.withColumn("n", F.size("hs"))
    top = F.pow(F.lit(2), F.ceil(F.log2("n"))).cast("int")
    keep = F.least(F.col("n"), F.floor((1 - F.lit(containment)) * top + F.lit(1e-9)).cast("int") + 1)
    return d.select("item", "width", "n", F.explode(F.slice("hs", F.lit(1), keep)).alias("h"))


def contained(docs: DataFrame, items: DataFrame, containment: float = CONTAINMENT, width: int = WIDTH) -> DataFrame:
    """(doc_id, item_id, n_item, n_shared, containment): items of which a document holds that share of shingles.

    Words are lower-cased (A to Z) and cut at white space. An item of fewer than `width` words is one shingle of
    its own length; an item without words or text is in nothing. Documents are read whole. Search: the hashes of
    a document meet the sketches; they are joined by broadcast only if Spark finds the sketches small, else by a
    shuffle that splits hot hashes. Verification: the words of the shingles themselves are compared, in the
    documents found. Every row is judged by its own text, and every item too; rows that share a doc_id and an
    item_id give one row, that of the largest containment. Null ids are kept as ids.
    """
    out = _found(docs, items, containment, width)
    best = out.groupBy("doc_id", "item_id").agg(F.max(F.struct("containment", "n_item", "n_shared")).alias("b"))
    return best.select("doc_id", "item_id", "b.n_item", "b.n_shared", "b.containment")


def _found(docs: DataFrame, items: DataFrame, containment: float, width: int) -> DataFrame:
    """As contained(), for each text: (doc_id, _t, item_id, n_item, n_shared, containment), _t the text's hash."""
    i = items.select("item_id", words(lower_ascii(F.col("text"))).alias("_w"))
    i = i.where(F.size("_w") > 0).withColumn("width", F.least(F.size("_w"), F.lit(width)))
    # Items of one text are one item for the search.
    i = i.withColumn("item", F.xxhash64("_w"))
    names = i.select("item", "item_id").distinct()
    i = i.select("item", "_w", "width").dropDuplicates(["item"])
    cut = lambda x: x.select("doc_id", F.xxhash64("text").alias("_t"), words(lower_ascii(F.col("text"))).alias("_w"))
    d = cut(docs)
    found = None
    for k in range(1, width + 1):  # the widths below the last serve items of fewer words only
        of = _hashed(i.where(F.col("width") == k), k, "item", "width")
        sk = sketches(of, containment).select("item", "h")
        if k < width and i.where(F.col("width") == k).isEmpty():
            continue
        hit = _hashed(d, k, "doc_id", "_t").join(sk, "h").select("doc_id", "_t", "item").distinct()
        found = hit if found is None else found.unionAll(hit).distinct()
    # A table, as the search is the costly part and three steps read what it found.
    found = materialise(found, "candidates")
    ids = found.select(F.col("doc_id").alias("_id"), F.col("_t").alias("_id_t")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("_id"))
    near = docs.select("doc_id", "text").join(ids, same & (F.xxhash64("text") == F.col("_id_t")), "left_semi")
    near = cut(near)
    out = None
    for k in range(1, width + 1):
        own = i.where(F.col("width") == k)
        if k < width and own.isEmpty():
            continue
        of = own.select("item", F.explode(shingle_structs(k)).alias("x")).distinct()
        n = of.groupBy("item").agg(F.count("*").alias("n_item"))
        have = near.where(F.size("_w") >= k).select("doc_id", "_t", F.explode(shingle_structs(k)).alias("x"))
        both = have.join(of, "x").select("doc_id", "_t", "item", "x").distinct().groupBy("doc_id", "_t", "item").agg(F.count("*").alias("n_shared"))
        pairs = found.select(F.col("doc_id").alias("_id"), F.col("_t").alias("_id_t"), F.col("item").alias("_i"))
        both = both.join(pairs, same & (F.col("_t") == F.col("_id_t")) & (F.col("item") == F.col("_i")), "left_semi")
        part = both.join(n, "item").where(F.col("n_shared") >= F.lit(containment) * F.col("n_item") - F.lit(1e-9))
        out = part if out is None else out.unionByName(part)
    out = out.join(names, "item")
    return out.select("doc_id", "_t", "item_id", F.col("n_item").cast("long").alias("n_item"), F.col("n_shared").cast("long").alias("n_shared"), (F.col("n_shared") / F.col("n_item")).alias("containment"))


def drop_contaminated(docs: DataFrame, items: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """`docs` without the rows that hold a benchmark item; each row is judged by its own text, whatever its id."""
    bad = _found(docs, items, containment, WIDTH).select(F.col("doc_id").alias("_bad_id"), F.col("_t").alias("_bad_text")).distinct()
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col("_bad_id")) & (F.xxhash64("text") == F.col("_bad_text")), "left_anti")


ORACLE = """
WITH i AS (SELECT item_id, string_split_regex(trim(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), E' \\t\\n\\x0b\\f\\r'), '[\\x20\\x09-\\x0D]+') AS w FROM benchmark),
s AS (SELECT DISTINCT item_id, array_to_string(w[k:k + 4], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 3)) AS k FROM i)),
n AS (SELECT item_id, count(*) AS n_item FROM s GROUP BY item_id),
d AS (SELECT doc_id, string_split_regex(trim(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), E' \\t\\n\\x0b\\f\\r'), '[\\x20\\x09-\\x0D]+') AS w FROM documents),
t AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS k FROM d)),
c AS (SELECT doc_id, item_id, count(*) AS n_shared FROM t JOIN s USING (g) GROUP BY ALL)
SELECT doc_id, item_id, n_item::BIGINT AS n_item, n_shared::BIGINT AS n_shared, n_shared / n_item AS containment
FROM c JOIN n USING (item_id) WHERE n_shared >= 0.75 * n_item - 1e-9
"""
