"""Language identification: each text is a mixture of languages, whose shares expectation-maximisation estimates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold

#: Cells of hashed n-grams, and the orders of the n-grams.
CELLS, ORDERS = 1 << 15, (1, 2, 3)
#: Penalty for each further language, in units of log(number of words).
PENALTY = 6.0
#: Characters that are worked on together.
BLOCK = 200_000


def _letters() -> np.ndarray:
    """Which code points are letters; made once a process."""
    global _LETTERS
    if _LETTERS is None:
        _LETTERS = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _LETTERS


_LETTERS: np.ndarray | None = None


def word_cells(texts: list[str]) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """([(cells, first place of each word) of each order], words of each text): the letter n-grams of all words.

    Letters are lower-cased, all else separates words, and a word has a space on both sides. Every word has
    n-grams of every order. A text without letters has no words.
    """
    low = [(t or "").lower() for t in texts]  # may change lengths, as each text is on its own
    a = np.frombuffer("\0".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[a]
    edge = np.diff(letter.astype(np.int8), prepend=0, append=0)
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(first):
        return [], np.zeros(len(texts), np.int64)
    begin = np.cumsum([0, *(len(t) + 1 for t in low)])  # by length: texts may hold the separator, too
    counts = np.diff(np.searchsorted(first, begin))
    # Words one after another with one space between them, before the first and after the last.
    n = last - first
    begin = np.cumsum(n + 1) - n
    out = np.full(int(n.sum() + len(n) + 1), 32, np.uint32)
    inside = np.ones(len(out), bool)
    inside[begin - 1] = inside[-1] = False
    out[inside] = a[letter]
    parts = []
    x = out.astype(np.uint64) + np.uint64(1)
    h = x
    for k in range(1, max(ORDERS) + 1):
        if k > 1:
            h = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + x[k - 1 :]
        if k not in ORDERS:
            continue
        # Kept are n-grams with no space but at their ends, which are those of one word.
        ok = inside.copy() if k == 1 else np.ones(len(h), bool)
        for i in range(1, k - 1):
            ok &= inside[i : i + len(h)]
        cells = (((h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(49)).astype(np.int32)[ok]
        # Of order k, a word of m letters has m for k = 1, else m + 2 - (k - 1), but one of m = 1 none for k > 3.
        many = n if k == 1 else np.maximum(n + 3 - k, 0)
        parts.append((cells, np.cumsum(many) - many))
    return parts, counts


class Mixture:
    """Log probabilities of cells by language, and the inference."""

    def __init__(self, langs: list[str], counts: np.ndarray) -> None:
        self.langs = langs
        total = counts.sum(1, keepdims=True)
        # Smoothed towards what all languages together do.
        pool = (counts.sum(0, keepdims=True) + 0.1) / (counts.sum() + 0.1 * counts.shape[1])
        self.logp = np.log((counts + 20 * pool) / (total + 20)).astype(np.float32).T.copy()  # cells x languages

    def infer(self, texts: list[str]) -> list[tuple[str, float, dict[str, float]]]:
        """Language, its share of the words, and the shares of all languages chosen, for each text.

        A word's likelihood is that of its n-grams; the words of a text are draws from the mixture. EM starts
        with all languages at equal shares; then the smallest share is taken out again and again, and of these
        sets and the best single language, the one of the best log likelihood less PENALTY * log(words) for
        each language after the first is the text's. Ties go to the smaller set and the
        first language by name. No letters: ("und", 0.0, {}).
        """
        n_lang = len(self.langs)
        none = ("und", 0.0, {})
        if not n_lang:
            return [none] * len(texts)
        parts, counts = word_cells(texts)
        live = np.flatnonzero(counts)
        if not len(live):
            return [none] * len(texts)
        like = sum(np.add.reduceat(self.logp[cells], starts, axis=0) for cells, starts in parts)
        first = (np.cumsum(counts) - counts)[live]
        size = counts[live]
        top = like.max(1)
        log_rest = np.maximum(like - top[:, None], -60)
        like = np.exp(log_rest)
        # One language: no EM. A mixture can't beat each word's best language, so many texts are settled by this.
        single = np.add.reduceat(log_rest, first, axis=0)
        best = np.zeros((len(live), n_lang))
        best[np.arange(len(live)), single.argmax(1)] = 1
        best_value = single.max(1).astype(np.float64)
        cost = PENALTY * np.log(np.maximum(size, 2))
        todo = np.flatnonzero(best_value < -cost)
        on = np.ones((len(live), n_lang), bool)
        for left in range(n_lang, 1, -1):
            if not len(todo):
                break
            share, value = self._em(like, first[todo], size[todo], on[todo])
            value -= cost[todo] * (left - 1)
            # A set is replaced only by a better one, so the smaller set wins a tie against later, larger ones.
            better = value > best_value[todo]
            best_value[todo[better]], best[todo[better]] = value[better], share[better]
            on[todo, np.where(on[todo], share, np.inf).argmin(1)] = False
        out = [none] * len(texts)
        for i, p in zip(live, best, strict=True):
            j = int(p.argmax())
            out[i] = (self.langs[j], float(min(1.0, p[j])), {self.langs[k]: float(p[k]) for k in np.flatnonzero(p > 0)})
        return out

    @staticmethod
    def _em(like: np.ndarray, first: np.ndarray, size: np.ndarray, on: np.ndarray, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
        at = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        text = np.repeat(np.arange(len(size)), size)
        begin = np.cumsum(size) - size
        own = like if len(at) == len(like) else like[at]
        share = (on / on.sum(1, keepdims=True)).astype(np.float32)
        one = np.ones(on.shape[1], np.float32)
        if on.sum(1).max() > 1:
            for _ in range(rounds):
                joint = own * share[text]
                total = joint @ one
                new = np.add.reduceat(joint / total[:, None], begin, axis=0) / size[:, None]
                done = np.abs(new - share).max() < 1e-4
                share = new
                if done:
                    break
        return share, np.add.reduceat(np.log((own * share[text]) @ one), begin)


def train(docs: DataFrame, k: int = 4, out_fold: int = 2) -> Mixture:
    """N-gram counts by language over all documents outside the fold, added up by task before the shuffle.

    What reaches the driver is CELLS counts a language, whatever the number of documents.
    """
    d = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold(F.col("doc_id"), k) != out_fold)).select("lang", "text")

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for p in parts:
            for lang, texts in p.groupby("lang")["text"]:
                every = list(texts)
                for i in range(0, len(every), 200):
                    for cells, _ in word_cells(every[i : i + 200])[0]:
                        sums[lang] = sums.get(lang, 0) + np.bincount(cells, minlength=CELLS)
        for lang, c in sums.items():
            at = np.flatnonzero(c)
            yield pd.DataFrame({"lang": lang, "cell": at.astype(np.int32), "n": c[at]})

    got = d.mapInPandas(count, "lang string, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n")).toArrow().to_pandas()
    langs = sorted(got["lang"].unique())
    table = np.zeros((len(langs), CELLS))
    table[np.searchsorted(langs, got["lang"]), got["cell"]] = got["n"]
    return Mixture(langs, table)


def identify(docs: DataFrame, model: Mixture) -> DataFrame:
    """doc_id, lang_pred, score, shares (map) for every row's whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # CELLS floats a language

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            texts = [t or "" for t in p["text"]]
            cuts, total = [0], 0
            for i, t in enumerate(texts):  # blocks of about BLOCK characters
                total += len(t)
                if total > BLOCK:
                    cuts.append(i + 1)
                    total = 0
            found = [x for a, b in zip(cuts, [*cuts[1:], len(texts)], strict=True) if b > a for x in sent.value.infer(texts[a:b])]
            yield pd.DataFrame({"doc_id": p["doc_id"], "lang_pred": [x[0] for x in found], "score": [x[1] for x in found], "shares": [x[2] for x in found]})

    kind = docs.schema["doc_id"].dataType.simpleString()
    # Ids travel as text: pandas has no integers beside nulls.
    out = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(run, "doc_id string, lang_pred string, score double, shares map<string,double>")
    return out.withColumn("doc_id", F.col("doc_id").cast(kind))


def language(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, n_langs: learned outside fold 2 of 4, applied to all rows.

    `und` with score 0 where the text is null or has no letter, or nothing could be learned. Null ids stay null.
    """
    out = identify(docs, train(docs))
    return out.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score", F.size("shares").cast("long").alias("n_langs"))
