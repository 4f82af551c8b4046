"""N-gram Jaccard join by vertical partitioning: fragments of the global n-gram order, partial overlaps, sums per pair."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, discard, input_bytes, materialise, release, spanning

WIDTH = 5
#: Similarity as a fraction of integers: linked when DENOMINATOR * overlap >= NUMERATOR * union.
NUMERATOR, DENOMINATOR = 75, 100
#: N-grams of one fragment of the global order: overlaps are counted fragment by fragment and added up.
FRAGMENT = 4096
#: N-grams that are ordered last for being frequent: this many at most are sent to all tasks, 8 bytes each.
MAX_FREQUENT = 500_000
#: Up to so many texts that share a prefix n-gram are paired at once; more are a crowd, compared block against block.
SMALL = 16
#: Texts in one block of a crowd; n-grams in one block of a cell, and of a block those that are counted together.
CROWD, BLOCK_GRAMS, COUNTED = 1024, 4 << 20, 1 << 20
#: Cells of up to so many pairs are counted many at a time, with so many n-grams together.
FEW, BIN_GRAMS = 4096, 512 << 10
#: Least and most bits of the sketch by which unlike texts of large buckets are told apart; between them at least one an n-gram.
BITS, MOST_BITS = 1024, 1 << 17
#: log2 of the most bits of the filter over the texts to compare; it lets all of them through, so it changes no result.
FILTER_BITS = 27
#: Class that marks, among postings, an n-gram whose bucket is known to be large.
LARGE = 255

_U = np.uint64
_SETS = "doc_id string, t long, n long, k long, sketch binary, frequent binary"


class Words(dict):
    """Word to 64-bit hash; forgotten when it has grown large."""

    def __missing__(self, w: bytes) -> int:
        if len(self) > 1_000_000:
            self.clear()
        h = self[w] = xxhash.xxh64_intdigest(w)
        return h


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingles(text: str | None, known: Words, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles; the whole sequence if it is shorter; nothing without words."""
    w = [known[x] for x in text.encode("utf-8", "surrogatepass").lower().split()] if text else []
    if not w:
        return np.zeros(0, _U)
    h = np.array(w, _U)
    k = min(width, len(h))
    s = np.full(len(h) - k + 1, k, _U)
    for i in range(k):
        s = s * _U(0x9E3779B97F4A7C15) + h[i : len(h) - k + 1 + i]
    return np.unique(mix(s))


def set_key(s: np.ndarray) -> int:
    """64-bit identity of a set, as a signed number; equal sets are one text for the join."""
    if not len(s):
        return 0
    k = (int(mix(s + _U(1)).sum(dtype=_U)) * 0x9E3779B97F4A7C15 + int(np.bitwise_xor.reduce(s)) + len(s)) & (1 << 64) - 1
    return k - (k >> 63 << 64)


def parity(s: np.ndarray) -> bytes:
    """Bits, each the parity of how many n-grams of the set fall to it: a power of 2 that is no less than the set's size.

    The sets of two texts differ in at least as many n-grams as their bits differ. In a fixed number of bits all
    long texts would look alike. Half as many bits of the same set are the first half xor the second.
    """
    bits = min(MOST_BITS, max(BITS, 1 << max(len(s) - 1, 0).bit_length()))
    return np.packbits(np.bincount(((s >> _U(10)) % _U(bits)).astype(np.int64), minlength=bits).astype(np.uint8) & 1).tobytes()


def halved(sketch: bytes, size: int) -> bytes:
    """The sketch of the same set in `size` bytes."""
    a = np.frombuffer(sketch, _U)
    while len(a) * 8 > size:
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    return a.tobytes()


def too_far(apart: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """At similarity t two sets differ in (1 - t) / (1 + t) of their sizes' sum at most, and at least in as many bits."""
    return apart.astype(np.int64) * (DENOMINATOR + NUMERATOR) > (DENOMINATOR - NUMERATOR) * sizes


def describe(docs: DataFrame) -> DataFrame:
    """A row (doc_id, t, n, k, sketch) for each row, and rows of packed n-grams that recur within a task's block of tokens.

    (doc_id, t), t a hash of the text, tells rows apart where ids are null or repeated.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, held, size = Words(), [], 0

        def frequent() -> pd.DataFrame:
            u, c = np.unique(np.concatenate(held), return_counts=True)
            u, c = u[c >= 3], c[c >= 3]
            return pd.DataFrame({"doc_id": [None], "t": [0], "n": [-1], "k": [0], "sketch": [None], "frequent": [np.concatenate((u, c.astype(_U))).tobytes()]})

        for p in parts:
            n, k, sketch = [], [], []
            for t in p["text"]:
                s = shingles(t, known)
                n.append(len(s))
                k.append(set_key(s))
                sketch.append(parity(s))
                held.append(s)
                size += len(s)
                if size > 3_000_000:
                    yield frequent()
                    held, size = [], 0
            yield pd.DataFrame({"doc_id": p["doc_id"], "t": p["t"], "n": n, "k": k, "sketch": sketch, "frequent": None})
        if held:
            yield frequent()

    # Ids travel as text: pandas has no integers beside nulls.
    out = _named(docs).mapInPandas(run, _SETS)
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))


def _never_null(doc_id: Column) -> Column:
    return F.coalesce(doc_id, F.lit("\0"))


def _named(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.xxhash64("text").alias("t"), "text")


def frequent_ngrams(described: DataFrame, most: int = MAX_FREQUENT) -> np.ndarray:
    """Rows (hash, class) of n-grams seen often, sorted by hash: the level is the lowest that keeps at most `most`.

    It only steers the global order (rare first), on which the join's speed depends and its result doesn't.
    """

    def unpack(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for b in p["frequent"]:
                a = np.frombuffer(b, _U)
                yield pd.DataFrame({"h": a[: len(a) // 2].astype(np.int64), "c": a[len(a) // 2 :].astype(np.int64)})

    c = described.where("n = -1").select("frequent").mapInPandas(unpack, "h long, c long").groupBy("h").agg(F.floor(F.log2(F.sum("c"))).cast("int").alias("c"))
    c = materialise(c, "frequent")
    total, level = 0, 64
    for row in sorted(c.groupBy("c").count().collect(), reverse=True):
        total += row["count"]
        if total > most:
            break
        level = row["c"]
    got = c.where(F.col("c") >= level).select("h", F.col("c").cast("long").alias("c")).toArrow()
    out = np.stack([got[x].to_numpy().view(_U) for x in ("h", "c")])
    return out[:, np.argsort(out[0])]


class Often:
    """The frequent n-grams: sorted hashes with their levels, behind a table of bits that most others fail."""

    def __init__(self, found: np.ndarray) -> None:
        self.hashes, self.level = found
        self.bits = np.zeros(1 << 22, bool)
        self.bits[(self.hashes >> _U(42)).astype(np.int64)] = True

    def rank(self, grams: np.ndarray) -> np.ndarray:
        """Places of sorted distinct n-grams in the global order among themselves."""
        at = np.minimum(np.searchsorted(self.hashes, grams), max(len(self.hashes) - 1, 0))
        level = np.where(self.hashes[at] == grams, self.level[at], _U(0)) if len(self.hashes) else np.zeros(len(grams), _U)
        out = np.empty(len(grams), np.int64)
        out[np.lexsort((grams, level))] = np.arange(len(grams))
        return out

    def prefix(self, s: np.ndarray) -> np.ndarray:
        """The rarest n-grams of a set, one of which any text similar enough has among its own.

        The order: n-grams that are not frequent by hash, then the frequent by level and hash.
        """
        size = prefix_size(len(s))
        maybe = np.flatnonzero(self.bits[(s >> _U(42)).astype(np.int64)])
        if len(maybe):
            at = np.minimum(np.searchsorted(self.hashes, s[maybe]), len(self.hashes) - 1)
            hit = self.hashes[at] == s[maybe]
            if hit.any():
                often, level = maybe[hit], self.level[at[hit]]
                return np.concatenate((np.delete(s, often), s[often[np.lexsort((s[often], level))]]))[:size]
        return s[:size]


def prefix_size(n: int) -> int:
    return n - -(-NUMERATOR * n // DENOMINATOR) + 1


def postings(docs: DataFrame, often: np.ndarray, parts_n: int) -> DataFrame:
    """Prefix n-grams in packed rows (part, toks, keys, classes): 13 bytes a posting, dealt by n-gram.

    A class is the logarithm of the set's size to the base 4/3; texts that are similar differ by one at most. Equal
    sets have equal keys and give equal postings, which the reader of a part drops. An n-gram of more than SMALL texts within
    one block of tokens has a large bucket: its postings leave as rows of part -1 (toks 64 bits wide) and only a
    mark goes to the part, so a part gets a bounded number of postings of an n-gram from each block.
    """
    sent = docs.sparkSession.sparkContext.broadcast(Often(often))  # MAX_FREQUENT n-grams

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Words()
        toks, keys, classes, size = [], [], [], 0

        def packed() -> pd.DataFrame:
            t = np.concatenate(toks)
            n = np.array([len(x) for x in toks])
            k, c = np.repeat(np.array(keys, np.int64), n), np.repeat(np.array(classes, np.uint8), n)
            part, t = (t % _U(parts_n)).astype(np.int64), (t // _U(parts_n)).astype(np.uint32)
            o = np.lexsort((k, t, part))
            part, t, k, c = part[o], t[o], k[o], c[o]
            new = np.ones(len(t), bool)
            new[1:] = (t[1:] != t[:-1]) | (part[1:] != part[:-1]) | (k[1:] != k[:-1])
            part, t, k, c = part[new], t[new], k[new], c[new]
            first = np.flatnonzero(np.concatenate(([True], (t[1:] != t[:-1]) | (part[1:] != part[:-1]))))
            n = np.diff(np.append(first, len(t)))
            large = np.repeat(n > SMALL, n)
            rows = []
            if large.any():
                wide = t[large].astype(np.int64) * parts_n + part[large]
                rows.append((-1, wide.tobytes(), k[large].tobytes(), c[large].tobytes()))
                mark = first[n > SMALL]
                c[mark], large[mark] = LARGE, False
                part, t, k, c = part[~large], t[~large], k[~large], c[~large]
            cut = np.searchsorted(part, np.arange(parts_n + 1))
            rows += [(j, t[a:b].tobytes(), k[a:b].tobytes(), c[a:b].tobytes()) for j, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if b > a]
            return pd.DataFrame(rows, columns=["part", "toks", "keys", "classes"])

        for p in parts:
            for text in p["text"]:
                s = shingles(text, known)
                if len(s):
                    toks.append(sent.value.prefix(s))
                    keys.append(set_key(s))
                    classes.append(int(np.log(len(s)) / np.log(4 / 3)))
                    size += len(toks[-1])
                    if size > 1_500_000:
                        yield packed()
                        toks, keys, classes, size = [], [], [], 0
        if toks:
            yield packed()

    return docs.select("text").mapInPandas(run, "part int, toks binary, keys binary, classes binary")


def buckets(posts: DataFrame, parts_n: int) -> DataFrame:
    """From postings, rows (what, x, y, n, tok).

    0: texts x and y share n prefix n-grams in small buckets of this part. 2: x is in the large bucket of n-gram tok.
    """

    def run(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        t = np.concatenate([np.frombuffer(b, np.uint32) for b in p["toks"]])
        k = np.concatenate([np.frombuffer(b, np.int64) for b in p["keys"]])
        c = np.concatenate([np.frombuffer(b, np.uint8) for b in p["classes"]]).astype(np.int64)
        marked = np.unique(t[c == LARGE])
        o = np.lexsort((k, t))
        o = o[c[o] != LARGE]
        t, k, c = t[o], k[o], c[o]
        new = np.ones(len(t), bool)
        new[1:] = (t[1:] != t[:-1]) | (k[1:] != k[:-1])
        t, k, c = t[new], k[new], c[new]
        first = np.flatnonzero(np.concatenate(([True], t[1:] != t[:-1]))) if len(t) else np.zeros(0, np.int64)
        n = np.diff(np.append(first, len(t)))
        known = np.repeat(np.isin(t[first], marked), n)
        many, begin = np.repeat(n, n), np.repeat(first, n)
        xs, ys = [], []
        few = np.flatnonzero((many > 1) & (many <= SMALL) & ~known)
        for d in range(1, SMALL):  # pairs d apart in a bucket
            a = few[few - begin[few] + d < many[few]]
            a = a[np.abs(c[a] - c[a + d]) <= 1]
            xs.append(k[a])
            ys.append(k[a + d])
        large = np.flatnonzero((many > SMALL) | known)
        x, y, count = _counted(np.concatenate(xs), np.concatenate(ys))
        row = lambda what, x, y, n, tok: pd.DataFrame({"what": what, "x": x, "y": y, "n": n, "tok": tok})
        return pd.concat([row(0, x, y, count, 0), row(2, k[large], 0, 0, t[large].astype(np.int64) * parts_n + int(key[0]))], ignore_index=True)

    def direct(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for t, k in zip(p["toks"], p["keys"], strict=True):
                yield pd.DataFrame({"what": 2, "x": np.frombuffer(k, np.int64), "y": 0, "n": 0, "tok": np.frombuffer(t, np.int64)})

    schema = "what int, x long, y long, n long, tok long"
    # A marked n-gram's own posting went with the direct rows, too.
    posts = materialise(posts, "postings")
    out = materialise(posts.where("part >= 0").groupBy("part").applyInPandas(run, schema).unionAll(posts.where("part < 0").mapInPandas(direct, schema)), "buckets")
    discard(posts)
    release(posts.sparkSession)
    return out


def _counted(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs and how often they occur."""
    o = np.lexsort((y, x))
    x, y = x[o], y[o]
    new = np.flatnonzero(np.concatenate(([True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])))) if len(x) else np.zeros(0, np.int64)
    return x[new], y[new], np.diff(np.append(new, len(x)))


def homes(large: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((x, home), (tok, x, home) of buckets in which texts of several homes meet, or those of their own home).

    A text's home is the largest of its large buckets, so that near copies, which share most of their prefixes, nearly
    all have one home however many they are.
    """
    large = large.distinct()
    size = large.groupBy("tok").agg(F.count("*").alias("_m"))
    home = large.join(size, "tok").groupBy("x").agg(F.max(F.struct("_m", "tok"))["tok"].alias("home"))
    home = materialise(home, "homes")
    m = large.join(home, "x")
    several = m.groupBy("tok").agg(F.count("*").alias("_m"), F.min("home").alias("_a"), F.max("home").alias("_b")).where("_m > 1 and (_a <> _b or _a = tok)")
    return home, m.join(several.select("tok", F.ceil(F.col("_m") / F.lit(CROWD)).cast("int").alias("_of")), "tok")


def crowd_cells(m: DataFrame, home: DataFrame, sizes: DataFrame) -> DataFrame:
    """(lo, hi, k): texts of two homes, lo and hi, that have a partner in the other one by size and sketch in some large bucket.

    lo = hi: texts that have one in their own home; they meet in its bucket. A bucket is dealt into blocks, and each
    two blocks meet in a group. What leaves a group grows with its texts and homes, not with its pairs.
    """
    m = m.withColumn("mine", F.pmod(F.xxhash64("x", "tok"), F.col("_of")).cast("int"))
    m = m.select("tok", "x", "home", "mine", F.explode(F.sequence(F.lit(0), F.col("_of") - 1)).alias("other"))
    m = m.select("tok", "x", "home", "mine", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"))
    m = m.join(_sketches(home, sizes).withColumnRenamed("k", "x"), "x")

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(["size", "x"])
        x, home, block, n = (p[c].to_numpy(np.int64) for c in ("x", "home", "mine", "size"))
        two, here = p["i"].iloc[0] != p["j"].iloc[0], int(p["tok"].iloc[0])
        # Sorted by size, partners of similar size follow each other, and sketches never get shorter.
        end = np.searchsorted(n, DENOMINATOR * n // NUMERATOR, "right")
        own = np.zeros(len(x), bool)
        lo, hi, ks, held = [], [], [], 0

        def packed() -> list[np.ndarray]:
            o = np.lexsort((np.concatenate(ks), np.concatenate(hi), np.concatenate(lo)))
            z = np.stack([np.concatenate(v)[o] for v in (lo, hi, ks)])
            return list(z[:, np.append(True, np.any(z[:, 1:] != z[:, :-1], axis=0))])

        length = p["sketch"].str.len().to_numpy()
        for size in np.unique(length):
            first, last = np.searchsorted(length, size), np.searchsorted(length, size, "right")
            stop = int(end[last - 1])
            bits = np.stack([np.frombuffer(halved(b, size), _U) for b in p["sketch"].iloc[first:stop]])
            for i in range(first, last):
                js = np.arange(i + 1, end[i])
                js = js[(home[js] != home[i]) | (home[i] == here)]
                if two:
                    js = js[block[js] != block[i]]
                if len(js):
                    js = js[~too_far(np.bitwise_count(bits[js - first] ^ bits[i - first]).sum(1), n[js] + n[i])]
                same = home[js] == home[i]
                if same.any():
                    own[js[same]] = own[i] = True
                    js = js[~same]
                if len(js):
                    there = np.unique(home[js])
                    for h, k in ((there, np.full(len(there), x[i])), (home[js], x[js])):
                        lo.append(np.minimum(h, home[i]))
                        hi.append(np.maximum(h, home[i]))
                        ks.append(k)
                        held += len(k)
                    if held > 1 << 20:
                        lo, hi, ks = ([v] for v in packed())
                        held = 0
        lo.append(home[own])
        hi.append(home[own])
        ks.append(x[own])
        lo, hi, ks = packed() if sum(map(len, ks)) else (np.zeros(0, np.int64),) * 3
        return pd.DataFrame({"lo": lo, "hi": hi, "k": ks})

    return m.groupBy("tok", "i", "j").applyInPandas(run, "lo long, hi long, k long").distinct()


def _sketches(home: DataFrame, sizes: DataFrame) -> DataFrame:
    """(k, size, sketch) of the texts of large buckets."""
    return sizes.join(home.select(F.col("x").alias("k")), "k", "left_semi").select("k", F.col("n").alias("size"), "sketch")


def alike(z: DataFrame, home: DataFrame, sizes: DataFrame) -> DataFrame:
    """Of the pairs (x, y, nx, ny, ...) of texts of large buckets those whose sketches leave room for enough overlap."""
    sketch = _sketches(home, sizes)
    fields = z.schema
    z = z.join(sketch.select(F.col("k").alias("x"), F.col("sketch").alias("sx")), "x").join(sketch.select(F.col("k").alias("y"), F.col("sketch").alias("sy")), "y")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            apart = np.zeros(len(p), np.int64)
            for i, (a, b) in enumerate(zip(p["sx"], p["sy"], strict=True)):
                size = min(len(a), len(b))
                apart[i] = (int.from_bytes(halved(a, size)) ^ int.from_bytes(halved(b, size))).bit_count()
            yield p[~too_far(apart, (p["nx"] + p["ny"]).to_numpy(np.int64))][fields.names]

    return z.mapInPandas(run, fields)


def cells(few: DataFrame, large: DataFrame, sizes: DataFrame) -> DataFrame:
    """(lo, hi, k, side): every pair of texts that may be similar lies in just one cell, that of its two homes.

    A text in no large bucket is a home of its own. side tells the home of k, 0 for lo. Of pairs from small buckets
    those go whose sizes, or the n-grams that their prefixes share, leave no room for enough overlap: with prefixes of p of
    |x| and q of |y| n-grams and s of them shared, the overlap is at most s + max(|x| - p, |y| - q). The s is
    known where one of the two is in no large bucket; where both are in one, their sketches tell.
    """
    home, crowds = homes(large)
    z = few.groupBy("x", "y").agg(F.sum("n").alias("n"))
    z = z.join(sizes.select(F.col("k").alias("x"), F.col("n").alias("nx")), "x").join(sizes.select(F.col("k").alias("y"), F.col("n").alias("ny")), "y")
    z = z.where(DENOMINATOR * F.least("nx", "ny") >= NUMERATOR * F.greatest("nx", "ny"))
    z = z.join(home.select("x", F.col("home").alias("hx")), "x", "left").join(home.select(F.col("x").alias("y"), F.col("home").alias("hy")), "y", "left")
    rest = lambda n: F.ceil(NUMERATOR * F.col(n) / F.lit(DENOMINATOR)) - 1
    need = F.ceil(NUMERATOR * (F.col("nx") + F.col("ny")) / F.lit(NUMERATOR + DENOMINATOR))
    both = F.col("hx").isNotNull() & F.col("hy").isNotNull()
    z = materialise(z.where((both & (F.col("hx") != F.col("hy"))) | (~both & (F.col("n") >= need - F.greatest(rest("nx"), rest("ny"))))), "pairs")
    z = z.where(~both).unionByName(alike(z.where(both), home, sizes))
    z = z.select("x", "y", F.coalesce("hx", "x").alias("hx"), F.coalesce("hy", "y").alias("hy")).where("hx <> hy")
    lo, hi = F.least("hx", "hy").alias("lo"), F.greatest("hx", "hy").alias("hi")
    z = z.select(lo, hi, F.explode(F.array(F.struct(F.col("x").alias("k"), F.col("hx").alias("h")), F.struct(F.col("y").alias("k"), F.col("hy").alias("h")))).alias("e")).select("lo", "hi", "e.k", "e.h")
    other = crowd_cells(crowds, home, sizes).join(home.select(F.col("x").alias("k"), F.col("home").alias("h")), "k").select("lo", "hi", "k", "h")
    return z.unionByName(other).select("lo", "hi", "k", F.when(F.col("h") == F.col("lo"), 0).otherwise(1).alias("side")).distinct()


def placed(members: DataFrame, sizes: DataFrame) -> DataFrame:
    """(bin, lo, hi, i, j, side, k, n, w): the texts of each cell in blocks, each two blocks of it a unit.

    A unit of many pairs is a bin of its own. Others share bins by the lowest home that their lower home meets, so that the
    cells of a small group, which share texts, mostly share a bin; where that is too much for one, by the lower home, too.
    """
    m = materialise(members.join(sizes.select("k", "n", "w"), "k"), "members")
    of = lambda s: F.greatest(F.ceil(F.sum(F.when(F.col("side") == s, 1)) / F.lit(CROWD)), F.ceil(F.sum(F.when(F.col("side") == s, F.col("n"))) / F.lit(BLOCK_GRAMS)), F.lit(1)).cast("int")
    size = m.groupBy("lo", "hi").agg(of(0).alias("_b0"), of(1).alias("_b1"), F.count("*").alias("_m"), F.sum("n").alias("_n"))
    size = size.where("_m > 1").withColumn("_few", (F.col("_m") * F.col("_m") <= FEW) & (F.col("_n") <= BLOCK_GRAMS))
    size = materialise(size, "cells")
    few = size.where("_few").select("lo", "hi")
    meets = few.select("lo", F.col("lo").alias("_at")).unionAll(few.select(F.col("hi").alias("lo"), F.col("lo").alias("_at"))).groupBy("lo").agg(F.min("_at").alias("_at"))
    # A text of several cells weighs once in the bin that they share.
    load = m.join(few.join(meets, "lo"), ["lo", "hi"]).select("_at", "k", "n").distinct().groupBy("_at").agg(F.sum("n").alias("_g"))
    load = materialise(load, "loads")
    bins = max(1, -(-load.agg(F.coalesce(F.sum("_g"), F.lit(0))).first()[0] // BIN_GRAMS))
    salts = load.select("_at", F.ceil(F.col("_g") / F.lit(BLOCK_GRAMS)).alias("_salt"))
    m = m.join(size.drop("_n", "_m").join(meets, "lo", "left").join(salts, "_at", "left"), ["lo", "hi"])
    mine = F.when(F.col("side") == 0, F.pmod(F.xxhash64("k", "hi"), "_b0")).otherwise(F.pmod(F.xxhash64("k", "lo"), "_b1")).cast("int")
    others = F.when((F.col("side") == 0) & (F.col("lo") != F.col("hi")), F.col("_b1")).otherwise(F.col("_b0"))
    m = m.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), others - 1)))
    same = F.col("lo") == F.col("hi")
    i = F.when(same, F.least("mine", "other")).when(F.col("side") == 0, F.col("mine")).otherwise(F.col("other"))
    j = F.when(same, F.greatest("mine", "other")).when(F.col("side") == 0, F.col("other")).otherwise(F.col("mine"))
    # In a unit of two blocks of one home the second block is the second side.
    side = F.when(same, (F.col("mine") != i).cast("int")).otherwise(F.col("side"))
    m = m.withColumn("i", i).withColumn("j", j).withColumn("side", side)
    shared = F.pmod(F.xxhash64("_at", F.pmod(F.xxhash64("lo", F.when(F.col("_salt") > 16, F.col("hi"))), "_salt")), F.lit(bins))
    at = F.when(F.col("_few"), shared).otherwise(F.xxhash64("lo", "hi", "i", "j").bitwiseOR(F.lit(-(1 << 63))))  # those of their own are negative
    return m.select(at.alias("bin"), "lo", "hi", "i", "j", "side", "k", "n", "w")


def overlaps(left: list[np.ndarray], right: list[np.ndarray], often: Often, same: bool) -> np.ndarray:
    """Sizes of the intersections of each left with each right set, COUNTED n-grams against COUNTED; `same`: left is right."""
    parts = [np.cumsum([len(x) for x in sets]) // COUNTED for sets in (left, right)]
    cuts = [[*np.flatnonzero(np.diff(p, prepend=-1)), len(p)] for p in parts]
    out = np.zeros((len(left), len(right)), np.int64)
    for a, b in zip(cuts[0], cuts[0][1:], strict=False):
        for c, d in zip(cuts[1], cuts[1][1:], strict=False):
            if same and d <= a:
                out[a:b, c:d] = out[c:d, a:b].T
            else:
                out[a:b, c:d] = _overlap(left[a:b], right[c:d], often)
    return out


def _overlap(left: list[np.ndarray], right: list[np.ndarray], often: Often) -> np.ndarray:
    """Partial counts by fragment of the global order, added up."""
    if len(left) * len(right) <= 16:
        out = np.zeros((len(left), len(right)), np.int64)
        for i, a in enumerate(left):
            for j, b in enumerate(right):
                small, wide = (a, b) if len(a) <= len(b) else (b, a)
                out[i, j] = (wide[np.minimum(np.searchsorted(wide, small), len(wide) - 1)] == small).sum()
        return out

    def flat(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])

    (g, a), (h, b) = flat(left), flat(right)
    both = np.intersect1d(g, h)  # an n-gram of one side only adds to no pair
    if not len(both):
        return np.zeros((len(left), len(right)), np.int64)
    rank = often.rank(both)

    def column(grams: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(both, grams), len(both) - 1)
        hit = both[at] == grams
        at, rows = rank[at[hit]], rows[hit]
        o = np.argsort(at, kind="stable")
        return at[o], rows[o]

    (ca, ra), (cb, rb) = column(g, a), column(h, b)
    total = np.zeros((len(left), len(right)), np.int64)
    for f in range(0, len(both), FRAGMENT):
        part = []
        for c, r, size in ((ca, ra, len(left)), (cb, rb, len(right))):
            s, e = np.searchsorted(c, (f, f + FRAGMENT))
            grid = np.zeros((size, min(FRAGMENT, len(both) - f)), np.float32)
            grid[r[s:e], c[s:e] - f] = 1
            part.append(grid)
        total += (part[0] @ part[1].T).astype(np.int64)  # counts up to FRAGMENT are exact
    return total


def wanted(bins: DataFrame) -> Callable[[Column], Column]:
    """Whether a text with hash t may be among `bins`: a text that can't be needn't be moved to the join.

    A text sets one bit of 16 or more, of 2**FILTER_BITS at most (16 MB); where there are more texts, more others pass.
    """
    shift = 64 - min(FILTER_BITS, max(16, (16 * bins.count()).bit_length()))
    spot = F.shiftrightunsigned("t", shift)
    set_ = bins.groupBy(F.shiftright(spot, 3).cast("int").alias("at")).agg(F.bit_or(F.expr(f"1 << cast(shiftrightunsigned(t, {shift}) & 7 as int)")).cast("short").alias("x")).toArrow()
    bits = np.zeros(1 << (64 - shift - 3), np.uint8)
    bits[set_["at"].to_numpy()] = set_["x"].to_numpy().astype(np.uint8)
    sent = bins.sparkSession.sparkContext.broadcast(bits)

    def among(t: pd.Series) -> pd.Series:
        at = t.to_numpy(np.int64).view(_U) >> _U(shift)
        return pd.Series(sent.value[(at >> _U(3)).astype(np.int64)] >> (at & _U(7)).astype(np.uint8) & 1 == 1)

    return F.pandas_udf(among, "boolean")


def counted(docs: DataFrame, sizes: DataFrame, place: DataFrame, often: np.ndarray, links: bool) -> DataFrame:
    """Rows (what, x, y, n) from the units of `place`. 0: x is linked with n rows of other texts. 1: x and y are connected.

    2, if `links`: x and y are linked. A text goes once to each bin. There its n-grams are numbered in the global
    order, which is cut into fragments; a unit's overlaps are counted in each fragment and summed by pair.
    """
    sent = docs.sparkSession.sparkContext.broadcast(Often(often))  # MAX_FREQUENT n-grams
    bins = place.groupBy("k").agg(F.collect_set("bin").alias("bins")).join(sizes.select("k", "rep"), "k")
    bins = materialise(bins.select("k", "bins", _never_null(F.col("rep.doc_id").cast("string")).alias("r"), F.col("rep.t").alias("t")), "bins")
    # Rows that agree in id and text are one; they are made so where the join has put them.
    texts = docs.select(_never_null(F.col("doc_id").cast("string")).alias("r"), F.xxhash64("text").alias("t"), "text")
    texts = texts.where(wanted(bins)(F.col("t"))).join(bins, ["r", "t"])
    texts = texts.groupBy("r", "t").agg(F.first("k").alias("k"), F.first("text").alias("text"), F.first("bins").alias("bins"))
    none = [F.lit(0).cast(t).alias(c) for c, t in (("what", "int"), ("lo", "long"), ("hi", "long"), ("i", "int"), ("j", "int"), ("side", "int"))]
    pieces = texts.select(F.explode("bins").alias("bin"), *none, "k", F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("w"), "text")
    asked = place.select("bin", F.lit(1).alias("what"), "lo", "hi", "i", "j", "side", "k", "n", "w", F.lit(None).cast("string").alias("text"))

    def count(p: pd.DataFrame) -> pd.DataFrame:
        known, have = Words(), p[p["what"] == 0].drop_duplicates("k")
        grams = {k: shingles(t, known) for k, t in zip(have["k"], have["text"], strict=True)}
        ask = p[p["what"] == 1].sort_values(["lo", "hi", "i", "j", "side", "k"])
        cols = {c: ask[c].to_numpy(np.int64) for c in ("lo", "hi", "i", "j", "side", "k", "n", "w")}
        head = np.ones(len(ask), bool)
        head[1:] = np.any([cols[c][1:] != cols[c][:-1] for c in ("lo", "hi", "i", "j")], axis=0)
        at = np.flatnonzero(head)
        what, xs, ys, ns = [], [], [], []

        def put(w: int, x: np.ndarray, y: np.ndarray, n: np.ndarray) -> None:
            what.append(np.full(len(x), w))
            xs.append(x)
            ys.append(y)
            ns.append(n)

        for a, b in zip(at, [*at[1:], len(ask)], strict=True):
            mid = a + int(np.searchsorted(cols["side"][a:b], 1))
            one = cols["lo"][a] == cols["hi"][a] and cols["i"][a] == cols["j"][a]
            left, right = slice(a, mid), slice(a, b) if one else slice(mid, b)
            kl, kr, nl, nr, wl, wr = (cols[c][s] for c in ("k", "n", "w") for s in (left, right))
            if not len(kl) or not len(kr):
                continue
            c = overlaps([grams[k] for k in kl.tolist()], [grams[k] for k in kr.tolist()], sent.value, one)
            linked = DENOMINATOR * c >= NUMERATOR * (nl[:, None] + nr[None, :] - c)
            if one:
                np.fill_diagonal(linked, False)
            if not linked.any():
                continue
            near = linked @ wr
            hit = np.flatnonzero(near)
            put(0, kl[hit], np.zeros(len(hit), np.int64), near[hit])
            if not one:
                near = linked.T @ wl
                hit = np.flatnonzero(near)
                put(0, kr[hit], np.zeros(len(hit), np.int64), near[hit])
            tree = np.array(spanning(linked), np.int64).reshape(-1, 2)
            every = np.concatenate((kl, kr))
            x, y = every[tree[:, 0]], every[tree[:, 1]]
            put(1, x[x != y], y[x != y], np.zeros(int((x != y).sum()), np.int64))
            if links:
                i, j = np.nonzero(np.triu(linked) if one else linked)
                put(2, kl[i], kr[j], np.zeros(len(i), np.int64))
        join = lambda v: np.concatenate(v) if v else np.zeros(0, np.int64)
        return pd.DataFrame({"what": join(what), "x": join(xs), "y": join(ys), "n": join(ns)})

    return pieces.unionByName(asked).groupBy("bin").applyInPandas(count, "what int, x long, y long, n long")


def _linked(docs: DataFrame, part_bytes: int, links: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(doc_id, t, n, k) of every row, sizes by key of the set, and counted() of all pairs that may be similar."""
    # Texts are read from `docs` three times; it should be a table.
    told = materialise(describe(docs), "sets")
    often = frequent_ngrams(told)
    # The row that stands for a set: the smallest id, nulls last, and of those the smallest hash of the text.
    rep = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("t"))).alias("rep")
    sizes = told.where("n > 0").groupBy("k").agg(rep, F.max("n").alias("n"), F.count("*").alias("w"), F.min("sketch").alias("sketch"))
    parts_n = max(8, min(1 << 16, -(-input_bytes(docs) // part_bytes)))
    found = buckets(postings(docs, often, parts_n), parts_n)
    sizes = materialise(sizes, "sizes")
    members = cells(found.where("what = 0").select("x", "y", "n"), found.where("what = 2").select("x", "tok"), sizes)
    place = materialise(placed(members, sizes), "places")
    release(docs.sparkSession)
    return told.where("n >= 0").select("doc_id", "t", "n", "k"), sizes, materialise(counted(docs, sizes, place, often, links), "links")


def jaccard_links(docs: DataFrame, part_bytes: int = 8 << 20) -> DataFrame:
    """(a, b): every link between different texts, each text by the smallest id of its copies (null: none has an id)."""
    _, sizes, found = _linked(docs, part_bytes, True)
    of = sizes.select("k", F.col("rep.doc_id").alias("rep"))
    z = found.where("what = 2").join(of.select(F.col("k").alias("x"), F.col("rep").alias("a")), "x").join(of.select(F.col("k").alias("y"), F.col("rep").alias("b")), "y")
    return z.select(F.least("a", "b").alias("a"), F.when(F.col("a").isNull() | F.col("b").isNull(), F.lit(None)).otherwise(F.greatest("a", "b")).alias("b"))


def _components(docs: DataFrame, part_bytes: int) -> DataFrame:
    """(doc_id, t, n, k, component, n_links) of every row; component is null for sets without n-grams."""
    mine, sizes, found = _linked(docs, part_bytes, False)
    comps = materialise(components(found.where("what = 1").select(F.col("x").alias("a"), F.col("y").alias("b"))), "components")
    others = found.where("what = 0").groupBy(F.col("x").alias("k")).agg(F.sum("n").alias("others"))
    each = sizes.select("k", "w").join(others, "k", "left").join(comps.withColumnRenamed("node", "k"), "k", "left")
    each = each.select("k", F.coalesce("component", "k").alias("component"), (F.col("w") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    # A text that a third of all rows hold is a hot key only here, where Spark can split it.
    return mine.join(each, "k", "left").select("doc_id", "t", "n", "k", "component", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def jaccard_components(docs: DataFrame, part_bytes: int = 8 << 20) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links for every row of `docs`.

    1. Equal sets become one text, whatever the ids of its rows. 2. Prefix n-grams, rare ones first, meet in buckets; pairs
    that share too little go, and texts of large buckets are cells, so that no list of a group's pairs is ever written.
    3. The global n-gram order is cut into fragments, in which the overlaps of all pairs of a cell are counted apart and
    summed, so no link is missed. 4. Links become components. n_links is the number of other rows that the row is
    linked with, copies of its own text among them. Empty and null texts link with nothing and are their own
    component. Rows with a null id link as others do and get the smallest id of their component, if any.
    """
    at = _components(docs, part_bytes)
    low = at.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("low"))
    out = at.join(low, "component", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("low")).otherwise(F.col("doc_id")).alias("component_id"), "n_links")


def keep_one(docs: DataFrame) -> DataFrame:
    """`docs` with one row of each component: that of the smallest id, nulls last, then of the smallest hash of the text.

    Rows that agree in id and text are one document, of which one row stays; so are all rows without words that
    share an id (null: each text of such rows).
    """
    at = materialise(_components(docs, 8 << 20), "rows")
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("t"))
    best = at.where("component is not null").groupBy("component").agg(F.min(key).alias("r")).select("r.doc_id", "r.t")
    keep = best.unionAll(at.where("component is null").select("doc_id", "t").distinct())
    keep = keep.select(F.col("doc_id").alias("_keep_id"), F.col("t").alias("_keep_t"))
    rows = docs.select(F.xxhash64("text").alias("_keep_h"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_keep_row"))
    ours = rows.join(keep, F.col("_keep_row.doc_id").eqNullSafe(F.col("_keep_id")) & (F.col("_keep_h") == F.col("_keep_t")), "left_semi")
    if not at.groupBy("doc_id", "t").count().where("count > 1").isEmpty():
        ours = ours.groupBy(F.col("_keep_row.doc_id").alias("_keep_id"), "_keep_h").agg(F.first("_keep_row").alias("_keep_row"))
    return ours.select("_keep_row.*")
