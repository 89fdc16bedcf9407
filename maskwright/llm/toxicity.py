"""Toxicity: gradient-boosted trees over dense features, calibrated by isotonic regression.

The features of a whole text are densities of lexicon words, their closeness to second-person
words, capitals, punctuation and obfuscation rates. Besides a short fixed list, the lexicon is
learned: hashed words and word beginnings that toxic training rows hold far oftener than others.
The bounded sample of labelled rows is cut in ``FOLDS`` by text hash, copies counting once. A row's
features come from a lexicon of the other folds, and calibration is learned from margins of trees
of the other folds, so that nothing is weighed on what it was learned from.

Texts are featurised on the executors. The driver gets at most ``LEXICON`` hashed terms for each
fold's complement and for the whole, and ``ROWS`` rows of features.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskwright.llm.common import extended, held_out, in_arrow, texts, training_sample, word_runs, written
from maskwright.llm.stretches import Table

#: Plain English insults, and second-person words of four languages.
INSULTS = "idiot stupid moron loser trash scum pathetic worthless disgusting clown dumb fool jerk imbecile filth garbage creep freak coward liar".split()
SECOND_PERSON = "you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine ihr euch sie usted ustedes tú ti vosotros".split()
#: Characters that stand for letters in disguised words.
DISGUISES = str.maketrans("013457@$!|", "oieastasil")
#: Hash range of learned terms.
TERMS = 1 << 20
#: Lengths of word beginnings that are learned besides whole words.
BEGINNINGS = (4, 5, 6, 7)
#: Learned terms at most, the labelled rows (documents of distinct text) learned from at most.
LEXICON, ROWS = 2000, 12_000
FOLDS = 4
#: Documents in which a term must occur, and least log-odds, to be learned.
LEAST, ODDS = 4, 2.5
#: Words around a second-person word in which a lexicon word is near it.
NEAR = 5
FEATURES = ("listed", "whole", "begins", "whole_log", "begins_log", "weight", "heaviest", "second", "near", "capitals", "shouted", "exclaims", "asks", "symbols", "digits", "disguised", "mixed", "words_log")
TREES, DEPTH, SHRINK, BINS, LEAST_LEAF = 80, 3, 0.15, 32, 12

NOT_LETTER = re.compile(r"[\W\d_]+")


def core(word: str) -> str:
    """A word in lower case without what is no letter."""
    return NOT_LETTER.sub("", word.lower())


def unmasked(word: str) -> str:
    """The core of a word whose disguising characters are read as letters, between its outer punctuation."""
    return core(word.lower().strip(".,;:!?()[]\"'#%&*$").translate(DISGUISES))


def terms(own: str) -> list[int]:
    """Hashes of a core and its beginnings."""
    return [zlib.crc32(b"w" + own.encode()) % TERMS] + [zlib.crc32(b"b" + own[:n].encode()) % TERMS for n in BEGINNINGS if len(own) > n]


class Nearness:
    """Counts lexicon words within NEAR words of a second-person word, in a text whose words come in runs."""

    def __init__(self) -> None:
        self.hits = self.others = np.empty(0, dtype=np.int64)
        self.size = self.near = 0

    def add(self, hits: np.ndarray, others: np.ndarray, n: int) -> None:
        """The next ``n`` words. What may yet meet words of the run after it is kept."""
        hits, self.others = np.concatenate((self.hits, hits + self.size)), np.concatenate((self.others, others + self.size))
        self.size += n
        sure = np.searchsorted(hits, self.size - NEAR)
        self.decide(hits[:sure])
        self.hits, self.others = hits[sure:], self.others[np.searchsorted(self.others, self.size - 2 * NEAR) :]

    def decide(self, hits: np.ndarray) -> None:
        self.near += int((np.searchsorted(self.others, hits + NEAR, "right") > np.searchsorted(self.others, hits - NEAR)).sum())

    def total(self) -> int:
        self.decide(self.hits)
        self.hits = self.hits[:0]
        return self.near


class Featuriser:
    """Features of whole texts under a learned lexicon {hash: log-odds}; remembers what words hold."""

    #: What a word holds: listed, weight as whole, weight of its heaviest beginning, second person, capitals, disguised, mixed
    HELD = 7

    def __init__(self, lexicon: dict[int, float]) -> None:
        self.lexicon = lexicon
        self.listed, self.second = frozenset(INSULTS), frozenset(SECOND_PERSON)
        # the table gives a word's row in ``held``
        self.table = Table(self.register, most=1 << 18, emptied=self.forget)

    def forget(self) -> None:
        self.held, self.known = np.zeros((1024, self.HELD), dtype=np.float32), 0

    def register(self, words: list[str]) -> list[bytes]:
        """Rows of new words, as the table wants them."""
        at, need = self.known, self.known + len(words)
        if need > len(self.held):
            self.held = np.concatenate((self.held[:at], np.zeros((need, self.HELD), dtype=np.float32)))
        self.held[at:need] = [self.of_word(w.strip(" ")) for w in words]
        self.known = need
        raw = np.arange(at, need, dtype="<u4").tobytes()
        return [raw[i : i + 4] for i in range(0, len(raw), 4)]

    def of_word(self, word: str) -> tuple[float, ...]:
        own = core(word)
        clear = own if word.isalpha() else unmasked(word)
        plain, hidden = self.weights(own), self.weights(clear) if clear != own else (0.0, 0.0)
        listed = own in self.listed or clear in self.listed
        letters = sum(map(str.isalpha, word)) if not word.isalpha() else len(word)
        inner = word.strip(".,;:!?()[]\"'#%&*$")
        mixed = bool(inner) and not inner.isalpha() and letters > 0 and not inner.replace("-", "").replace("'", "").replace("’", "").isalpha()
        whole, begins = max(plain[0], hidden[0]), max(plain[1], hidden[1])
        return listed, whole, begins, own in self.second, letters > 1 and word.isupper(), clear != own and (clear in self.listed or hidden[0] > 0), mixed

    def weights(self, own: str) -> tuple[float, float]:
        if not own:
            return 0.0, 0.0
        found = [self.lexicon.get(t, 0.0) for t in terms(own)]
        return found[0], max(found[1:], default=0.0)

    def rows(self, runs: list[list[str]]) -> list[np.ndarray]:
        """What the words of each run hold."""
        return [self.held[i] for i in self.table.ids([" ".join(r).encode("utf-8", "replace") for r in runs])]

    def one(self, text: str, whole: np.ndarray | None = None) -> np.ndarray:
        """The features of a text; run by run, if what its words hold is not at hand."""
        sums, heaviest, n, nearness = np.zeros(self.HELD + 1), 0.0, 0, Nearness()
        for held in [whole] if whole is not None else (self.rows([r])[0] for r in word_runs(text)):
            marks = held > 0
            sums[: self.HELD] += marks.sum(axis=0)
            sums[self.HELD] += held[:, 1:3].sum(dtype=np.float64)
            if len(held):
                heaviest = max(heaviest, float(held[:, 1:3].max()))
            nearness.add(np.flatnonzero(marks[:, :3].any(axis=1)), np.flatnonzero(marks[:, 3]), len(held))
            n += len(held)
        raw = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8), minlength=256)
        size, per = max(1, int(raw.sum())), max(1, n)
        capitals, small = raw[65:91].sum(), raw[97:123].sum()
        symbols = raw[33:48].sum() + raw[58:65].sum() + raw[91:97].sum() + raw[123:127].sum()
        return np.array([
            sums[0] / per, sums[1] / per, sums[2] / per, np.log1p(sums[1]), np.log1p(sums[2]), sums[self.HELD] / per, heaviest,
            sums[3] / per, nearness.total() / per, capitals / max(1, capitals + small), sums[4] / per, raw[33] / size, raw[63] / size,
            (symbols - raw[33] - raw[63]) / size, raw[48:58].sum() / size, sums[5] / per, sums[6] / per, np.log1p(n),
        ])

    def many(self, whole: list[str]) -> np.ndarray:
        """The features of each text."""
        short = [i for i, t in enumerate(whole) if len(t) <= 1 << 16]
        held = {}
        for at in range(0, len(short), 256):
            some = short[at : at + 256]
            held |= zip(some, self.rows([whole[i].split() for i in some]), strict=True)
        return np.array([self.one(t, held.pop(i, None)) for i, t in enumerate(whole)]).reshape(len(whole), len(FEATURES))


class Trees:
    """Boosted trees of one depth for the logistic loss, grown on binned features."""

    def __init__(self, x: np.ndarray, y: np.ndarray) -> None:
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(self.edges, x.T, strict=True)], axis=1)
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(share / (1 - share)))
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        total = np.full(len(y), self.base)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-total))
            tree, leaf = self.grow(binned, p - y, p * (1 - p))
            self.trees.append(tree)
            total += tree[2][leaf]

    def grow(self, binned: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], np.ndarray]:
        """A complete binary tree: feature and threshold of each inner node, value of each leaf."""
        feature, bound = np.zeros(2**DEPTH - 1, dtype=np.int64), np.full(2**DEPTH - 1, np.inf)
        node = np.zeros(len(g), dtype=np.int64)
        for level in range(DEPTH):
            nodes = 2**level
            best = np.full(nodes, 1e-6)
            cut = np.full(nodes, BINS)
            for f, edges in enumerate(self.edges):
                if not len(edges):
                    continue
                cell = node * BINS + binned[:, f]
                sums = [np.cumsum(np.bincount(cell, w, nodes * BINS).reshape(nodes, BINS), axis=1) for w in (g, h, np.ones(len(g)))]
                left = [s[:, :-1] for s in sums]
                right = [s[:, -1:] - s[:, :-1] for s in sums]
                gain = left[0] ** 2 / (left[1] + 1) + right[0] ** 2 / (right[1] + 1) - sums[0][:, -1:] ** 2 / (sums[1][:, -1:] + 1)
                gain[(left[2] < LEAST_LEAF) | (right[2] < LEAST_LEAF)] = 0
                top = gain.argmax(axis=1)
                for k in np.flatnonzero(gain[np.arange(nodes), top] > best):
                    if top[k] < len(edges):
                        best[k], cut[k], feature[nodes - 1 + k], bound[nodes - 1 + k] = gain[k, top[k]], top[k], f, edges[top[k]]
            here = feature[nodes - 1 + node]
            node = node * 2 + (binned[np.arange(len(g)), here] > cut[node])
        leaves = 2**DEPTH
        value = -SHRINK * np.bincount(node, g, leaves) / (np.bincount(node, h, leaves) + 1)
        return (feature, bound, value), node

    def margins(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, bound, value in self.trees:
            node = np.zeros(len(x), dtype=np.int64)
            for level in range(DEPTH):
                at = 2**level - 1 + node
                node = node * 2 + (x[rows, feature[at]] > bound[at])
            total += value[node]
        return total


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators: knots of a rising curve from margins to shares of ones.

    A block's share counts one more row of the opposite kind in each direction, so none is 0 or 1.
    """
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []
    for a, b in zip(x[order].tolist(), y[order].tolist(), strict=True):
        blocks.append([b, 1.0, a, a])
        while len(blocks) > 1 and (blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1] or blocks[-2][3] == blocks[-1][2]):
            s, n, _, end = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + n, blocks[-1][2], end]
    share = [(s + 0.25) / (n + 0.5) for s, n, _, _ in blocks for _ in (0, 1)]
    return np.array([v for b in blocks for v in b[2:]]), np.maximum.accumulate(share) if share else np.array([])


class Model:
    """Lexicon, trees and calibration. Without both labels, a text's score is the share of ones (0 without rows)."""

    def __init__(self, lexicon: dict[int, float], x: np.ndarray, y: np.ndarray, folds: np.ndarray) -> None:
        self.lexicon, self.share = lexicon, float(y.mean()) if len(y) else 0.0
        self.trees, self.knots = None, None
        if 0 < y.sum() < len(y):
            self.trees = Trees(x, y.astype(float))
            margins, known = np.zeros(len(y)), np.zeros(len(y), dtype=bool)
            for fold in np.unique(folds):
                out = folds == fold
                if 0 < y[~out].sum() < (~out).sum():
                    margins[out], known[out] = Trees(x[~out], y[~out].astype(float)).margins(x[out]), True
            if 0 < y[known].sum() < known.sum():
                self.knots = isotonic(margins[known], y[known].astype(float))

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.full(len(x), self.share)
        margin = self.trees.margins(x)
        return np.interp(margin, *self.knots) if self.knots else 1 / (1 + np.exp(-margin))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = ROWS) -> Model:
    """Learns from at most ``rows`` labelled rows of ``docs`` (doc_id, text)."""
    key = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    drawn = written(training_sample(docs, labels, label, rows).withColumn("key", key), "toxic-drawn")
    # one row for a text, however often it occurs
    first = drawn.groupBy("key").agg(F.min(F.struct("doc_id", "label")).alias("first")).select("key", "first.doc_id")
    fold = F.pmod(F.xxhash64("key"), F.lit(FOLDS)).cast("int").alias("fold")
    sample = written(drawn.join(first, ["key", "doc_id"], "left_semi").dropDuplicates(["key"]).select("doc_id", "label", "text", fold), "toxic-sample")

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        tally = np.zeros((FOLDS, 2, TERMS), dtype=np.int16)
        for text, y, fold in zip(texts(batch.column("text")), batch.column("label").to_pylist(), batch.column("fold").to_pylist(), strict=True):
            cores = {core(w) for run in word_runs(text) for w in run} - {""}
            tally[fold, int(y == 1), list({t for c in cores for t in terms(c)})] += 1
        fold, seen = np.nonzero(tally.any(axis=1))
        return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int32)) for x in (fold, seen, tally[fold, 1, seen], tally[fold, 0, seen])], names=["fold", "term", "ones", "others"])

    counted = in_arrow(sample, count, "fold int, term int, ones int, others int", rows=256)
    wide = written(counted.groupBy("term").agg(*(F.sum(F.when(F.col("fold") == k, F.col(c)).otherwise(0)).alias(f"{c}{k}") for k in range(FOLDS) for c in ("ones", "others"))), "toxic-terms")
    sizes = {(r["fold"], r["one"]): r["count"] for r in sample.groupBy("fold", (F.col("label") == 1).alias("one")).count().collect()}

    def learned(folds: list[int]) -> dict[int, float]:
        """The lexicon of some folds: log-odds of the terms that toxic rows hold far oftener."""
        ones, others = (sum(F.col(f"{c}{k}") for k in folds) for c in ("ones", "others"))
        n, m = (sum(sizes.get((k, one), 0) for k in folds) for one in (True, False))
        odds = F.log((ones + 0.5) / (n + 1)) - F.log((others + 0.5) / (m + 1))
        best = wide.filter(ones >= LEAST).select("term", odds.alias("odds")).filter(F.col("odds") >= ODDS).orderBy(F.desc("odds"), "term").limit(LEXICON)
        return {r["term"]: r["odds"] for r in best.collect()}

    lexicons = [learned([k for k in range(FOLDS) if k != fold]) for fold in range(FOLDS)]
    data = featurised(sample, lexicons, "fold").select("doc_id", "label", "fold", "features").toArrow()
    order = np.argsort(data.column("doc_id").to_numpy(), kind="stable")
    x = data.column("features").combine_chunks().flatten().to_numpy().reshape(-1, len(FEATURES))[order]
    return Model(learned(list(range(FOLDS))), x, (data.column("label").to_numpy()[order] == 1).astype(int), data.column("fold").to_numpy()[order])


def featurised(docs: DataFrame, lexicons: list[dict[int, float]], which: str | None = None) -> DataFrame:
    """``docs`` with the dense ``features`` (array<double>, named in ``FEATURES``) in place of ``text``.

    ``which`` names a column that says which of the lexicons a row is read with; without, the first.
    """
    held: list[Featuriser] = []

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not held:
            held.extend(map(Featuriser, lexicons))
        whole = texts(batch.column("text"))
        if which:
            chosen = batch.column(which).to_numpy()
            x = np.zeros((len(whole), len(FEATURES)))
            for k in np.unique(chosen):
                mine = np.flatnonzero(chosen == k)
                x[mine] = held[k].many([whole[i] for i in mine])
        else:
            x = held[0].many(whole)
        column = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(FEATURES)).cast(pa.list_(pa.float64()))
        kept = [(n, c) for n, c in zip(batch.schema.names, batch.columns, strict=True) if n not in ("text", "features")]
        return pa.RecordBatch.from_arrays([*(c for _, c in kept), column], names=[*(n for n, _ in kept), "features"])

    return in_arrow(docs, work, extended(docs.drop("text", "features").schema, features=T.ArrayType(T.DoubleType())), over=held.clear)


def scored(docs: DataFrame, model: Model, threshold: float, score: str = "score") -> DataFrame:
    """``docs`` with ``score``, the calibrated probability of label 1 for the whole ``text``, and ``predicted``.

    One pass without a shuffle; the other columns pass through. Null counts as empty; an empty text
    has zero features and is scored like any other.
    """
    docs = docs.drop(score, "predicted")
    held: list[Featuriser] = []

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not held:
            held.append(Featuriser(model.lexicon))
        p = model.score(held[0].many(texts(batch.column("text"))))
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=[*batch.schema.names, score, "predicted"])

    return in_arrow(docs, work, extended(docs.schema, **{score: T.DoubleType()}, predicted=T.IntegerType()), over=held.clear)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``; learns from ``labels`` (doc_id, toxic).

    Null and empty texts are scored; repeated rows stay; an empty table gives none; further columns go.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = scored(own, fit(own, labels), threshold)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
