"""Embedding near-duplicates: a forest of random-projection trees with spill, compared within leaves."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, materialise, spanning

COSINE = 0.98
#: Trees of the forest; vectors of a leaf on average; width of the spill on each side of a cut, in standard
#: deviations of the difference that two vectors just similar enough have in a random direction.
TREES, LEAF, SPILL = 8, 400, 0.8
#: Rows of the fit: cuts are medians of at most so many vectors, the first by hash of the id.
FIT_ROWS = 20_000
#: Leaves larger than this are compared in pairs of blocks of this size, each pair a task's group of its own.
BLOCK = 3000


def _unit(p: pd.Series, dim: int) -> np.ndarray:
    v = np.array(p.tolist(), np.float64).reshape(len(p), dim)
    return v / np.sqrt((v * v).sum(1))[:, None]


def distinct_vectors(df: DataFrame) -> DataFrame:
    """(vec_id, label, embedding, _key): _key is null for vectors that link with nothing.

    Linking takes a label and at least one component, all components finite and not all zero. Rows that agree in
    label and vector have one key, as they are one point for the search.
    """
    v = F.col("embedding")
    fine = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    some = F.exists(v, lambda x: x != 0)
    ok = F.col("label").isNotNull() & v.isNotNull() & F.coalesce(~fine, F.lit(False)) & F.coalesce(some, F.lit(False))
    doubles = F.transform(v, lambda x: x.cast("double") + F.lit(0.0))
    # The sign of zeros is dropped, so equal vectors have equal text.
    return df.select("vec_id", "label", doubles.alias("embedding"), F.when(ok, F.sha2(F.concat_ws("|", F.col("label").cast("string"), F.concat_ws(",", doubles.cast("array<string>"))), 256)).alias("_key"))


def fit(points: DataFrame, trees: int = TREES, rows: int = FIT_ROWS) -> dict:
    """Cuts of the trees: {(label, dim): [{node: cut} of each tree]}, from a bounded sample of (label, embedding, depth).

    A tree halves its points at the median of their projections on a random direction, `depth` times. Nodes are
    numbered as in a heap, 1 the root; only those that the sample reaches have a cut, others cut at 0. So the model
    is bounded by the sample, whatever the number of vectors and labels.
    """
    sample = points.orderBy(F.xxhash64("_key"), "_key").limit(rows).select("label", "embedding", "depth").toPandas()
    model = {}
    for (label, dim), own in sample.groupby([sample["label"].astype(str), sample["embedding"].map(len)]):
        x, depth = _unit(own["embedding"], dim), int(own["depth"].max())
        model[(label, dim)] = cuts = [{} for _ in range(trees)]
        for t in range(trees):
            node = np.ones(len(x), np.int64)
            for d in range(depth):
                p = x @ direction(dim, t, d)
                for i in np.unique(node).tolist():
                    cuts[t][i] = float(np.median(p[node == i]))
                node = 2 * node + (p > np.array([cuts[t][i] for i in node.tolist()]))
    return model


@lru_cache(4096)
def direction(dim: int, tree: int, level: int) -> np.ndarray:
    """The random direction of a level of a tree, the same for all labels and in all tasks."""
    v = np.random.default_rng(xxhash.xxh64_intdigest(f"{dim}/{tree}/{level}".encode())).standard_normal(dim)
    return v / np.sqrt((v**2).sum())


def leaves(x: np.ndarray, cuts: list[dict[int, float]] | None, depth: int, trees: int, spill: float) -> list[list[tuple[int, int]]]:
    """For each vector the (tree, leaf) pairs it falls into; near a cut it goes to both sides."""
    out: list[list[tuple[int, int]]] = [[] for _ in range(len(x))]
    for t in range(trees):
        of = cuts[t] if cuts else {}
        row, node = np.arange(len(x)), np.ones(len(x), np.int64)
        for d in range(depth):
            p = x[row] @ direction(x.shape[1], t, d)
            u, back = np.unique(node, return_inverse=True)
            gap = p - np.array([of.get(i, 0.0) for i in u.tolist()])[back]
            # Vectors that are similar enough differ by so much in a random direction, in most cases.
            near = np.abs(gap) <= spill
            left, right = (gap <= 0) | near, (gap > 0) | near
            row, node = np.concatenate((row[left], row[right])), np.concatenate((2 * node[left], 2 * node[right] + 1))
        for r, n in zip(row.tolist(), node.tolist(), strict=True):
            out[r].append((t, n))
    return out


def _meet(leaves_of: list[np.ndarray]) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """For arrays of points i and j: whether two have a leaf in common, of the leaves given for each."""
    wide = max((len(e) for e in leaves_of), default=0)
    grid = np.full((len(leaves_of), wide), -1, np.int64)
    for row, e in zip(grid, leaves_of, strict=True):
        row[: len(e)] = e

    def run(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i), bool)
        step = max(1, 4_000_000 // max(1, wide * wide))
        for s in range(0, len(i), step):
            a, b = grid[i[s : s + step]], grid[j[s : s + step]]
            out[s : s + step] = ((a[:, :, None] == b[:, None, :]) & (a >= 0)[:, :, None]).any((1, 2))
        return out

    return run


def near_duplicates(df: DataFrame, cosine: float = COSINE, trees: int = TREES, leaf: int = LEAF, spill: float = SPILL) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of `df` (vec_id, embedding, label).

    Copies are one point. Points fall into leaves of all trees, of their label and length alone; leaves compare
    all their points in double precision. A pair that meets again and again counts in one leaf only: the first,
    by tree and leaf, that both have. Leaves return a point's number of linked rows and, for each point, one link
    to the smallest point it is linked with in a chain, so what moves grows with the points and not the pairs.
    Large leaves are compared by pairs of blocks. Vectors that can't link have 0 links and are their own
    component; so do rows with a null id, whose component is the smallest id they reach, if any.
    """
    rows = materialise(distinct_vectors(df), "vectors")
    points = rows.where("_key is not null").groupBy("_key").agg(F.first("label").alias("label"), F.first("embedding").alias("embedding"), F.count("*").alias("w"))
    points = materialise(points.withColumn("p", F.xxhash64("_key")), "points")
    # A label's trees are as deep as leaves of `leaf` vectors need; labels stay in a table, however many they are.
    deep = points.groupBy(F.col("label").alias("_label"), F.size("embedding").alias("_dim")).agg(F.greatest(F.ceil(F.log2(F.count("*") / F.lit(leaf))), F.lit(0)).cast("int").alias("depth"))
    deep = points.join(deep, (F.col("label") == F.col("_label")) & (F.size("embedding") == F.col("_dim"))).select("label", "embedding", "p", "w", "depth", "_key")
    model = fit(deep, trees)
    sent = df.sparkSession.sparkContext.broadcast(model)  # cuts of a bounded fit

    def assign(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            key = list(zip(p["label"].astype(str), p["embedding"].map(len), strict=True))
            out = []
            for k in dict.fromkeys(key):
                at = [i for i, x in enumerate(key) if x == k]
                own = p.iloc[at]
                x = _unit(own["embedding"], k[1])
                width = spill * np.sqrt((2 - 2 * cosine) / k[1])
                for i, (e, w, ls) in enumerate(zip(own["p"], own["w"], leaves(x, sent.value.get(k), int(own["depth"].iloc[0]), trees, width), strict=True)):
                    every = np.array(ls, np.int64)
                    packed = (every[:, 0] << 48 | every[:, 1]).tobytes()
                    vec = x[i].tobytes()
                    out += [(f"{k[0]}/{k[1]}/{t}/{n}", t << 48 | n, e, w, packed, vec) for t, n in ls]
            yield pd.DataFrame(out, columns=["leaf", "at", "p", "w", "every", "vec"])

    falls = materialise(deep.select("label", "embedding", "p", "w", "depth").mapInPandas(assign, "leaf string, at long, p long, w long, every binary, vec binary"), "leaves")
    size = falls.groupBy("leaf").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("nb"))
    blocked = falls.join(size, "leaf").withColumn("b", F.pmod(F.xxhash64("p", F.lit(7)), "nb").cast("int"))
    # Block b meets all blocks: as the lower or the upper one of a pair of blocks.
    cells = blocked.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).select("leaf", "at", "p", "w", "every", "vec", "b", F.least("b", "o").alias("lo"), F.greatest("b", "o").alias("hi"))

    def compare(p: pd.DataFrame) -> pd.DataFrame:
        at = int(p["at"].iloc[0])
        x = np.stack([np.frombuffer(v) for v in p["vec"]])
        earlier = _meet([(e := np.frombuffer(b, np.int64))[e < at] for b in p["every"]])
        ids, w = p["p"].to_numpy(np.int64), p["w"].to_numpy(np.int64)
        low = p["b"].to_numpy() == p["lo"].iloc[0]
        same = bool(p["lo"].iloc[0] == p["hi"].iloc[0])
        left, right = np.flatnonzero(low), np.flatnonzero(low if same else ~low)
        n = np.zeros(len(p), np.int64)
        linked = np.zeros((len(left), len(right)), bool)
        for s in range(0, len(left), 500):
            i, j = np.nonzero(x[left[s : s + 500]] @ x[right].T >= cosine)
            i += s
            if same:
                i, j = i[i < j], j[i < j]
            ok = ~earlier(left[i], right[j])
            i, j = i[ok], j[ok]
            n += np.bincount(left[i], w[right[j]], len(p)).astype(np.int64) + np.bincount(right[j], w[left[i]], len(p)).astype(np.int64)
            linked[i, j] = True
            if same:
                linked[j, i] = True
        tree = np.array(spanning(linked), np.int64).reshape(-1, 2)
        every = np.concatenate((ids[left], ids[right]))
        a_out, b_out = every[tree[:, 0]], every[tree[:, 1]]
        a_out, b_out = a_out[a_out != b_out], b_out[a_out != b_out]
        hit = np.flatnonzero(n)
        none = lambda k: pd.array([None] * k, "Int64")
        return pd.concat([
            pd.DataFrame({"p": ids[hit], "n": n[hit], "q": none(len(hit))}),
            pd.DataFrame({"p": a_out, "n": np.zeros(len(a_out), np.int64), "q": pd.array(b_out, "Int64")}),
        ], ignore_index=True)

    found = materialise(cells.groupBy("leaf", "lo", "hi").applyInPandas(compare, "p long, n long, q long"), "matches")
    comps = components(found.where("q is not null").select(F.col("p").alias("a"), F.col("q").alias("b")))
    links = found.where("q is null").groupBy("p").agg(F.sum("n").alias("n"))
    each = points.select("_key", "p", "w").join(links, "p", "left").join(comps.withColumnRenamed("node", "p"), "p", "left")
    each = each.select("_key", (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n_links"), F.coalesce("component", "p").alias("comp"))
    out = rows.select("vec_id", "_key").join(each, "_key", "left")
    low = out.where("comp is not null").groupBy(F.col("comp").alias("_c")).agg(F.min("vec_id").alias("low"))
    out = out.join(low, out["comp"] == low["_c"], "left")
    comp = F.when(F.col("comp").isNull(), F.col("vec_id")).otherwise(F.col("low")).cast("long")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), comp.alias("component_id")).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


#: All pairs of distinct points against each other, for small tables.
ORACLE = """
WITH RECURSIVE e AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS n
  FROM embeddings WHERE label IS NOT NULL),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id
      WHERE a.n > 0 AND b.n > 0 AND list_inner_product(a.v, b.v) / (a.n * b.n) >= 0.98),
r(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM c LEFT JOIN (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a) USING (vec_id)
"""
