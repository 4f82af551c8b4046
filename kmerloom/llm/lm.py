"""LM scoring: quantised n-gram counts in a log-frequency Bloom filter that is broadcast and probed level by level."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import input_bytes, materialise, release

_U = np.uint64
#: Base of the count levels; bits for each entry; hash functions; bytes of filter that one pass broadcasts, which every
#: Python worker holds for itself.
BASE, BITS, HASHES, MAX_FILTER_BYTES = 1.5, 8, 4, 128 << 20
#: Documents with neighbouring ids form a block, which shares one dictionary of exact word counts.
BLOCK_IDS, BLOCK_BYTES, SEGMENT_BYTES, LEAST_BLOCKS = 2048, 8 << 20, 4 << 20, 64
#: Words of at least this share of a sample's tokens are dealt out as contexts by the word after them; texts of the sample.
HOT_SHARE, HOT_TEXTS = 0.002, 2000
#: Tokens that are counted together, and scored together; words whose hashes a worker remembers.
FLUSH, SCORED, REMEMBERED = 500_000, 200_000, 200_000
END, START = _U(0x5BD1E9955BD1E995), _U(0x2545F4914F6CDD1D)
PAIR, CONTEXT, FANOUT = _U(0x1000193), _U(0x2000289), _U(0x300038F)  # kinds of entries


class Words(dict):
    def __missing__(self, w: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        h = self[w] = xxhash.xxh64_intdigest(w)
        return h


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def level(c: np.ndarray) -> np.ndarray:
    """Quantised count: 1 + floor(log(c) / log(BASE)), 0 for 0."""
    return np.where(c > 0, 1 + np.floor(np.log(np.maximum(c, 1)) / np.log(BASE) + 1e-9), 0).astype(np.int64)


def _typical(levels: int = 120) -> np.ndarray:
    """The mean of the counts that share a level."""
    out = np.zeros(levels + 1)
    for q in range(1, levels + 1):
        lo, hi = np.ceil(BASE ** (q - 1) - 1e-6), np.ceil(BASE**q - 1e-6) - 1
        out[q] = (max(lo, 1) + max(hi, lo, 1)) / 2
    return out


TYPICAL = _typical()


def pair_key(h: np.ndarray, w: np.ndarray, segments: int) -> np.ndarray:
    """A bigram inside the segment of its context: 32 bits of the context and 32 of the word."""
    return ((h // _U(segments)) & _U(0xFFFFFFFF)) << _U(32) | w >> _U(32)


def segment_of(h: np.ndarray, w: np.ndarray, segments: int, hot: np.ndarray) -> np.ndarray:
    """Segments of bigrams: that of the context, or for the sorted contexts in `hot` one by the word, too."""
    seg = h % _U(segments)
    if len(hot):
        at = np.flatnonzero(hot[np.minimum(np.searchsorted(hot, h), len(hot) - 1)] == h)
        seg[at] = mix(h[at] * _U(3) + w[at]) % _U(segments)
    return seg.astype(np.int64)


class Filter:
    """Segments of bits; an n-gram's entries lie in the segment of its context, those of a hot context in all."""

    def __init__(self, segments: int, bits: dict[int, bytes]) -> None:
        self.segments = segments
        self.size = np.zeros(segments, _U)
        self.start = np.zeros(segments, _U)
        self.bits, at = np.zeros(sum(map(len, bits.values())), np.uint8), 0
        for s in sorted(bits):
            b = bits.pop(s)  # so that the segments are not held twice
            self.size[s], self.start[s] = len(b) * 8, at * 8
            self.bits[at : at + len(b)] = np.frombuffer(b, np.uint8)
            at += len(b)

    @staticmethod
    def hashes(key: np.ndarray, kind: np.uint64, j: int) -> tuple[np.ndarray, np.ndarray]:
        a = mix(key * _U(0x9E3779B97F4A7C15) + kind + _U(j * 0xD6E8FEB86659FD93 & (1 << 64) - 1))
        return a, a * _U(0xC2B2AE3D27D4EB4F) | _U(1)

    @staticmethod
    def place(h: np.ndarray, size: np.ndarray | np.uint64) -> np.ndarray:
        """A place below `size`, which is below 2**32, by the upper half of the hash."""
        return (h >> _U(32)) * size >> _U(32)

    @classmethod
    def build(cls, entries: list[tuple[np.ndarray, np.uint64, np.ndarray]], bits_per: float) -> bytes:
        """One segment from (keys, kind, levels): an entry for each level from 1 to the key's own."""
        n = int(sum(q.sum() for _, _, q in entries))
        size = _U(max(64, int(-(-n * bits_per // 8) * 8)))
        on = np.zeros(int(size), bool)
        for keys, kind, q in entries:
            j = 1
            while len(keys):
                a, b = cls.hashes(keys, kind, j)
                for i in range(HASHES):
                    on[cls.place(a + _U(i) * b, size)] = True
                keys, q = keys[q > j], q[q > j]
                j += 1
        return np.packbits(on, bitorder="little").tobytes()

    def probe(self, segment: np.ndarray, key: np.ndarray, kind: np.uint64) -> np.ndarray:
        """The level of each key: the last of the levels 1, 2, ... whose entry the filter has."""
        q = np.zeros(len(key), np.int64)
        at = np.flatnonzero(self.size[segment] > 0)
        j = 1
        while len(at) and j < len(TYPICAL):
            a, b = self.hashes(key[at], kind, j)
            size, start = self.size[segment[at]], self.start[segment[at]]
            for i in range(HASHES):
                p = self.place(a, size) + start
                on = np.flatnonzero(self.bits[(p >> _U(3)).view(np.int64)] >> (p & _U(7)).astype(np.uint8) & 1)
                at, a, b, size, start = at[on], a[on] + b[on], b[on], size[on], start[on]
            q[at] = j
            j += 1
        return q


def _is_training(doc_id: str | None, k: int, out: int) -> bool:
    return zlib.crc32((doc_id or "").encode()) % k != out


def hot_words(docs: DataFrame) -> np.ndarray:
    """Sorted hashes of the words of the largest shares in HOT_TEXTS texts: at most 1 / HOT_SHARE of them.

    They only say where counts are added up, so the sample changes no result.
    """
    known, c = Words(), {}
    for r in docs.select("text").limit(HOT_TEXTS).toLocalIterator():
        for w in (r["text"] or "").encode("utf-8", "surrogatepass").lower().split():
            c[known[w]] = c.get(known[w], 0) + 1
        c[int(END)] = c.get(int(END), 0) + 1
        c[int(START)] = c.get(int(START), 0) + 1
    total = sum(c.values())
    return np.array(sorted(w for w, n in c.items() if n >= HOT_SHARE * total), _U)


def count(docs: DataFrame, segments: int, hot: np.ndarray, fold: int = 10, out: int = 0) -> DataFrame:
    """Packed counts of each task, by segment: words with their blocks (`what` 0), bigrams of training texts (1).

    A word's row has every word of the block, trained on or not, as the block has to be told its count.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words()
        get = known.__getitem__
        ids: list[np.ndarray] = []
        blocks: list[int] = []
        train: list[bool] = []
        size = 0

        def packed() -> pa.RecordBatch:
            rows = []
            n = np.array([len(x) for x in ids])
            x, t = np.concatenate(ids), np.repeat(np.array(train), n)
            ids.clear()
            b = np.repeat(np.array(blocks, np.int64), n)
            for one in np.unique(blocks):
                at = b == one
                u, inv = np.unique(x[at], return_inverse=True)
                c = np.bincount(inv, t[at], len(u)).astype(np.uint32)
                rows += cut(0, (u % _U(segments)).astype(np.int64), u, c, int(one))
            del b, at, u, inv, c
            last = np.cumsum(n) - n
            h = np.empty_like(x)
            h[1:] = x[:-1]
            h[last] = START
            # Equal pairs have equal sums; the pairs themselves are those of the first places.
            h, x = h[t], x[t]
            _, first, c = np.unique(mix(h) * _U(3) + x, return_index=True, return_counts=True)
            h, w = h[first], x[first]
            rows += cut(1, segment_of(h, w, segments, hot), pair_key(h, w, segments), c.astype(np.uint32), -1)
            ints = [pa.array([r[i] for r in rows], pa.int32()) for i in range(3)]
            return pa.RecordBatch.from_arrays(ints + [pa.array([r[i] for r in rows], pa.binary()) for i in (3, 4)], ["what", "segment", "block", "keys", "counts"])

        def cut(what: int, seg: np.ndarray, keys: np.ndarray, c: np.ndarray, block: int) -> list[tuple]:
            o = np.argsort(seg, kind="stable")
            seg, keys, c = seg[o], keys[o], c[o]
            first = np.flatnonzero(np.diff(seg, prepend=-1))
            return [(what, int(seg[i]), block, keys[i:j].tobytes(), c[i:j].tobytes()) for i, j in zip(first, np.append(first, len(seg))[1:], strict=True)]

        for p in parts:
            for d, block, text in zip(p["d"], p["block"], p["text"], strict=True):  # one text at a time becomes a Python string
                d, block, text = d.as_py(), block.as_py(), text.as_py()
                w = text.encode("utf-8", "surrogatepass").lower().split() if text else []
                a = np.empty(len(w) + 1, _U)
                a[:-1] = list(map(get, w))
                a[-1] = END
                ids.append(a)
                blocks.append(block)
                train.append(_is_training(d, fold, out))
                size += len(a)
                if size > FLUSH:
                    yield packed()
                    ids, blocks, train, size = [], [], [], 0
        if ids:
            yield packed()

    return docs.mapInArrow(run, "what int, segment int, block int, keys binary, counts binary")


def gather(counts: DataFrame, bits_per: float, segments: int, hot: np.ndarray) -> DataFrame:
    """By segment: dictionaries for the blocks (`what` 0), the segment of the filter (1), statistics (2).

    Of hot contexts a segment has a part of the bigrams only: (3) tells the part's tokens and distinct words.
    """
    # A hot context is known in every segment by the 32 bits that pair_key() keeps of it.
    marks = (hot // _U(segments)) & _U(0xFFFFFFFF)
    order = np.argsort(marks, kind="stable")
    marks = marks[order]

    def run(p: pd.DataFrame) -> pd.DataFrame:
        seg = int(p["segment"].iloc[0])
        out = []
        words = p[p["what"] == 0]
        if len(words):
            keys = [np.frombuffer(b, _U) for b in words["keys"]]
            c = [np.frombuffer(b, np.uint32) for b in words["counts"]]
            u, inv = np.unique(np.concatenate(keys), return_inverse=True)
            total = np.bincount(inv, np.concatenate(c), len(u)).astype(np.int64)
            for block, k in pd.Series(keys).groupby(words["block"].to_numpy()):
                k = np.unique(np.concatenate(list(k)))
                out.append((0, seg, int(block), k.tobytes(), total[np.searchsorted(u, k)].tobytes()))
            # tokens, distinct words, words seen once and twice
            out.append((2, seg, -1, np.array([total.sum(), (total > 0).sum(), (total == 1).sum(), (total == 2).sum()], np.int64).tobytes(), b"w"))
        pairs = p[p["what"] == 1]
        if len(pairs):
            u, inv = np.unique(np.concatenate([np.frombuffer(b, _U) for b in pairs["keys"]]), return_inverse=True)
            total = np.bincount(inv, np.concatenate([np.frombuffer(b, np.uint32) for b in pairs["counts"]]), len(u)).astype(np.int64)
            ctx, start = np.unique(u >> _U(32), return_index=True)
            seen, fan = np.add.reduceat(total, start), np.diff(np.append(start, len(u)))
            if len(marks):
                at = np.minimum(np.searchsorted(marks, ctx), len(marks) - 1)
                spread = marks[at] == ctx
                part = np.stack([order[at[spread]], seen[spread], fan[spread]]).astype(np.int64)
                out.append((3, seg, -1, part.tobytes(), b""))
            bits = Filter.build([(u, PAIR, level(total)), (ctx, CONTEXT, level(seen)), (ctx, FANOUT, level(fan))], bits_per)
            out.append((1, seg, -1, bits, b""))
            out.append((2, seg, -1, np.array([total.sum(), len(u), (total == 1).sum(), (total == 2).sum()], np.int64).tobytes(), b"p"))
        return pd.DataFrame(out, columns=["what", "segment", "block", "keys", "counts"])

    return counts.groupBy("segment").applyInPandas(run, "what int, segment int, block int, keys binary, counts binary")


class Scorer:
    """Absolute discounting: p(w | h) = max(c(hw) - d, 0) / c(h) + d * fan-out(h) / c(h) * p(w), the counts by probes."""

    def __init__(self, filt: Filter, n: int, v: int, d1: float, d2: float, hot: np.ndarray | None = None, hot_seen: np.ndarray | None = None, hot_fan: np.ndarray | None = None) -> None:
        self.filter, self.n, self.v, self.d1, self.d2 = filt, n, v, d1, d2
        self.hot = np.zeros(0, _U) if hot is None else hot
        self.hot_seen, self.hot_fan = hot_seen, hot_fan  # exact

    def segments_of(self, h: np.ndarray, w: np.ndarray) -> np.ndarray:
        return segment_of(h, w, self.filter.segments, self.hot)

    def word_p(self, c: np.ndarray) -> np.ndarray:
        """From exact counts; unknown words share one class."""
        if not self.n:
            return np.full(len(c), 1 / (self.v + 1))
        c = c.astype(np.float64)
        return np.maximum(c - self.d1, 0) / self.n + self.d1 * self.v / self.n / (self.v + 1)

    def logp(self, h: np.ndarray, w: np.ndarray, c: np.ndarray) -> np.ndarray:
        """log10 p of each word after its context; equal pairs are probed once."""
        f = self.filter
        _, first, back = np.unique(mix(h) * _U(3) + w, return_index=True, return_inverse=True)
        hp, wp = h[first], w[first]
        ctx, cb = np.unique(hp, return_inverse=True)
        cseg = (ctx % _U(f.segments)).astype(np.int64)
        ckey = (ctx // _U(f.segments)) & _U(0xFFFFFFFF)
        seen = TYPICAL[f.probe(cseg, ckey, CONTEXT)]
        fan = np.minimum(TYPICAL[f.probe(cseg, ckey, FANOUT)], seen)
        if len(self.hot):
            at = np.minimum(np.searchsorted(self.hot, ctx), len(self.hot) - 1)
            mine = self.hot[at] == ctx
            seen[mine], fan[mine] = self.hot_seen[at[mine]], self.hot_fan[at[mine]]
        pair = np.zeros(len(hp))
        known = np.flatnonzero((seen * fan)[cb] > 0)
        pair[known] = TYPICAL[f.probe(self.segments_of(hp[known], wp[known]), pair_key(hp[known], wp[known], f.segments), PAIR)]
        seen, fan = seen[cb], fan[cb]
        pair = np.minimum(pair, seen)
        base = self.word_p(c[first])
        with np.errstate(divide="ignore", invalid="ignore"):
            p = np.where((seen > 0) & (fan > 0), np.maximum(pair - self.d2, 0) / seen + self.d2 * fan / seen * base, base)
        return np.log10(p)[back]


def _discount(n1: int, n2: int) -> float:
    return float(np.clip(n1 / (n1 + 2 * n2), 0.1, 0.95)) if n1 + n2 else 0.5


def lm_scores(docs: DataFrame, fold: int = 10, out: int = 0, max_filter_bytes: int = MAX_FILTER_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of `docs`.

    Words are lower-cased (A to Z); a text ends with one end token; null texts are empty. Words and bigrams of
    the training texts are counted by task, packed, and added up by segment of the context's hash. Exact word
    counts go back to the blocks that asked, as dictionaries; bigram counts, context counts and the number of
    words after a context go, by level, into the filter. The filter is broadcast. If it takes more than
    `max_filter_bytes`, its segments go out in as many passes, one after another, each of which scores the tokens whose
    bigrams it would hold and writes its sums; a broadcast never exceeds that bound, and it is destroyed after its pass.
    The bigrams of very frequent contexts are dealt over all segments. Repeated rows are scored each.
    Without training texts the filter is empty and all words are alike. Null ids hash as empty text; in blocks, ids that
    are no numbers go by their hash and null ids by that of the text.
    """
    spark = docs.sparkSession
    segments = max(16, min(1 << 18, -(-input_bytes(docs) // SEGMENT_BYTES)))
    n_blocks = max(LEAST_BLOCKS, min(1 << 20, -(-input_bytes(docs) // BLOCK_BYTES)))
    kind = docs.schema["doc_id"].dataType
    name = F.col("doc_id").cast("string")
    block = F.coalesce(F.floor(F.expr("try_cast(cast(doc_id as string) as double)") / BLOCK_IDS).cast("long"), F.xxhash64(name, F.when(name.isNull(), F.col("text"))))
    lean = docs.select(name.alias("d"), F.pmod(block, F.lit(n_blocks)).cast("int").alias("block"), "text")
    hot = hot_words(docs)
    got = materialise(gather(count(lean, segments, hot, fold, out), BITS, segments, hot), "ngrams")
    release(spark)
    sums = {"w": np.zeros(4, np.int64), "p": np.zeros(4, np.int64)}
    for r in got.where("what = 2").select("keys", "counts").toLocalIterator():  # four numbers a segment
        sums[bytes(r["counts"]).decode()] += np.frombuffer(r["keys"], np.int64)
    n, v = int(sums["w"][0]), int(sums["w"][1])
    discounts = _discount(*sums["w"][2:].tolist()), _discount(*sums["p"][2:].tolist())
    seen, fan = np.zeros(len(hot)), np.zeros(len(hot))
    for r in _hot_parts(got).collect():  # one row a hot context
        seen[r["i"]], fan[r["i"]] = r["seen"], r["fan"]
    sizes = sorted((r["segment"], r["n"]) for r in got.where("what = 1").select("segment", F.octet_length("keys").alias("n")).collect())
    passes: list[list[int]] = [[]]
    room = max_filter_bytes
    for s, b in sizes:
        if b > room and passes[-1]:
            passes.append([])
            room = max_filter_bytes
        passes[-1].append(s)
        room -= b
    words = got.where("what = 0").select("block", F.lit(0).alias("what"), F.lit(None).cast("string").alias("d"), F.lit(None).cast("string").alias("text"), "keys", "counts")
    texts = lean.select("block", F.lit(1).alias("what"), "d", "text", F.lit(None).cast("binary").alias("keys"), F.lit(None).cast("binary").alias("counts"))
    both = words.unionAll(texts).repartition(n_blocks, "block").sortWithinPartitions("block", "what")
    total = None
    for k, own in enumerate(passes):
        mine = np.zeros(segments, bool)
        mine[own] = True
        part = got.where("what = 1")
        if len(passes) > 1:
            at = spark.createDataFrame([(s,) for s in own] or [(-1,)], "segment int")
            part = part.join(F.broadcast(at), "segment", "left_semi")
        bits = {int(r["segment"]): bytes(r["keys"]) for r in part.select("segment", "keys").toLocalIterator()}
        scorer = Scorer(Filter(segments, bits), n, v, *discounts, hot, seen, fan)
        if k == 0:  # the tokens whose segments no pass holds fall to the first
            mine |= ~np.isin(np.arange(segments), [s for s, _ in sizes])
        sent = spark.sparkContext.broadcast((scorer, mine))  # at most max_filter_bytes of filter
        del scorer
        here = _score(both, sent, k == 0)
        if len(passes) > 1:
            here = materialise(here, "pass")
            sent.destroy()
            release(spark)
        total = here if total is None else total.unionAll(here)
    if len(passes) > 1:
        n_passes = len(passes)
        total = total.groupBy("d", "tie").agg(*[(F.sum(c) / F.count("*") * n_passes).cast(t).alias(c) for c, t in (("n_tokens", "long"), ("n_known", "long"), ("base_score", "double"), ("score", "double"))], F.expr(f"sequence(1, cast(count(*) / {n_passes} as int))").alias("_same"))
        total = total.withColumn("_one", F.explode("_same"))
    return total.select(F.col("d").cast(kind).alias("doc_id"), (F.crc32(F.coalesce("d", F.lit("")).cast("binary")) % fold == out).alias("held_out"), "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")


def _hot_parts(got: DataFrame) -> DataFrame:
    """(i, seen, fan): tokens after, and distinct words after, each hot context, summed over the segments."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for b in p["keys"]:
                x = np.frombuffer(b, np.int64).reshape(3, -1)
                yield pd.DataFrame({"i": x[0], "seen": x[1], "fan": x[2]})

    return got.where("what = 3").select("keys").mapInPandas(run, "i long, seen long, fan long").groupBy("i").agg(F.sum("seen").alias("seen"), F.sum("fan").alias("fan"))


def _score(both: DataFrame, sent: Broadcast, first: bool) -> DataFrame:
    """Sums by row of the tokens that the pass with (scorer, its segments) in `sent` is for."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, mine = sent.value
        known = Words()
        get = known.__getitem__
        block, told, have = None, [], None
        held: list[tuple] = []
        size = 0
        norm = s.n + 0.1 * (s.v + 1)

        def flush() -> pa.RecordBatch:
            n = np.array([len(x[2]) for x in held])
            w = np.concatenate([x[2] for x in held])
            begin = np.cumsum(n) - n
            h = np.empty_like(w)
            h[1:] = w[:-1]
            h[begin] = START
            u, inv = np.unique(w, return_inverse=True)
            at = np.searchsorted(have[0], u)
            if (have[0][np.minimum(at, len(have[0]) - 1)] != u).any():
                raise RuntimeError("a word of this block is not in its dictionary")
            c = have[1][at][inv]
            base = np.log10((c + 0.1) / norm)
            lp = np.zeros(len(w))
            own = np.flatnonzero(mine[s.segments_of(h, w)])
            lp[own] = s.logp(h[own], w[own], c[own])
            add = lambda x: np.add.reduceat(x, begin)
            k = 1 if first else 0
            ids = {"d": pa.array([x[0] for x in held], pa.string()), "tie": pa.array([x[1] for x in held], pa.int64())}
            return pa.RecordBatch.from_pydict(ids | {"n_tokens": n * k, "n_known": add((c > 0).astype(np.int64)) * k, "base_score": add(base) * k, "score": add(lp)})

        for p in parts:
            for b, what, d, text, keys, counts in zip(*[p.column(c) for c in ("block", "what", "d", "text", "keys", "counts")], strict=True):
                b = b.as_py()
                if b != block:
                    if held:
                        yield flush()
                        held, size = [], 0
                    block, told, have = b, [], None
                if what.as_py() == 0:
                    told.append((np.frombuffer(keys.as_py(), _U), np.frombuffer(counts.as_py(), np.int64)))
                    continue
                if have is None:
                    k, c = (np.concatenate([x[i] for x in told]) for i in (0, 1))
                    o = np.argsort(k)
                    have, told = (k[o], c[o]), []
                d, text = d.as_py(), text.as_py()
                raw = text.encode("utf-8", "surrogatepass") if text else b""
                w = raw.lower().split()
                a = np.empty(len(w) + 1, _U)
                a[:-1] = list(map(get, w))
                a[-1] = END
                held.append((d, xxhash.xxh64_intdigest(raw) - (1 << 63), a))
                size += len(a)
                if size > SCORED:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return both.mapInArrow(run, "d string, tie long, n_tokens long, n_known long, base_score double, score double")

