"""Quality classifier: supervised subword embeddings.

A text is the average of learned vectors, one for each word, for each of the word's character
n-grams, and for each word that repeats the one before it (the only word bigram kept: others are
too rare to learn). Words and n-grams share hashed buckets. A softmax over two classes reads the
average. Vectors and softmax are trained together on the driver by numpy stochastic gradient
descent over a bounded sample of labelled rows (``ROWS``); whole texts are featurised on the
executors, so the driver gets at most ``ROWS`` lists of at most ``BUCKETS`` counts.

To score, the two class scores of an average differ by the average of the buckets' own differences,
as both are linear; so a word or
n-gram costs a look-up of one number, in array operations, and the result is the softmax's.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskwright.llm.common import extended, held_out, in_arrow, texts, training_sample

BUCKETS = 1 << 16
#: Bucket of a word that repeats its predecessor.
REPEAT = 0
#: Lengths of character n-grams of a word with its boundary marks.
GRAMS = (3, 4)
DIMENSIONS = 8
#: Labelled rows that are learned from, at most.
ROWS = 6000
EPOCHS = 12
RATE = 0.5
#: Characters looked at together.
RUN = 1 << 18
WHITE = re.compile(r"\s")
#: Odd multipliers of the hashes.
STEP, SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
#: Characters that end words; above the last, none does.
SPACES = np.zeros(0x3002, dtype=bool)
SPACES[[i for i in range(len(SPACES) - 1) if chr(i).isspace()]] = True


def bucket(hashed: np.ndarray, kind: int) -> np.ndarray:
    """Buckets 1 to BUCKETS - 1 of hashes of words (kind 0) or n-grams (kind n)."""
    mixed = (hashed + np.uint64(kind)) * SPREAD
    mixed ^= mixed >> np.uint64(32)
    return (mixed * STEP >> np.uint64(40)).astype(np.int64) % (BUCKETS - 1) + 1


def features(whole: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of (index of the text, bucket) of every word, n-gram and repeated word.

    Texts are run together and cut at white space by array operations; none is cut off.
    """
    codes = np.frombuffer(" ".join(["", *whole, ""]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    # the text that a place belongs to; the space between two belongs to the first
    owner = np.repeat(np.arange(len(whole) + 1), [1, *(len(t) + 1 for t in whole)]) - 1
    space = SPACES[np.minimum(codes, len(SPACES) - 1)]
    kept = ~space
    kept[1:] |= ~space[:-1]
    kept[0] = True
    codes, owner, space = codes[kept].astype(np.uint64), owner[kept], space[kept]
    codes[space] = 32
    # from here, words stand between single spaces
    edge = np.flatnonzero(space)
    begins, ends = edge[:-1] + 1, edge[1:]
    if not len(begins):
        return
    forward = np.cumprod(np.full(len(codes), STEP, dtype=np.uint64))
    back = np.cumprod(np.full(len(codes), pow(int(STEP), -1, 1 << 64), dtype=np.uint64))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((codes + np.uint64(1)) * forward)))
    words = (sums[ends] - sums[begins]) * back[begins]
    of = owner[begins]
    yield of, bucket(words, 0)
    again = np.flatnonzero((words[1:] == words[:-1]) & (of[1:] == of[:-1])) + 1
    yield of[again], np.full(len(again), REPEAT)
    for n in GRAMS:
        last = len(codes) - n + 1
        if last <= 0:
            continue
        inner = ~space[1 : last + 1]
        hashed = codes[:last].copy()
        for k in range(1, n):
            hashed = hashed * STEP + codes[k : last + k]
            if 1 < k < n - 1:
                inner &= ~space[k : last + k]
        at = np.flatnonzero(inner)
        # an n-gram belongs to the text of its second character, the first inside the word
        yield owner[at + 1], bucket(hashed[at], n)


def parts(text: str) -> list[str]:
    """A text in parts cut at white space, of at most 2 * RUN characters each but for one longer word alone."""
    out, at = [], 0
    while len(text) - at > RUN:
        m = WHITE.search(text, at + RUN, at + 2 * RUN)
        if not m and len(text) - at > 2 * RUN:
            # a word goes on from here beyond the reach; what comes before it is a part of its own
            before = text[at : at + RUN].split(None)[-1:]
            begin = at + RUN - len(before[0]) if before and not text[at + RUN - 1].isspace() else at + RUN
            if begin > at:
                out.append(text[at:begin])
                at = begin
            m = WHITE.search(text, at + RUN)
        end = m.end() if m else len(text)
        out.append(text[at:end])
        at = end
    return [*out, text[at:]]


def pieces(part: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The features of one part; a word too long to be looked at together is read in windows, with the same result."""
    if len(part) <= 2 * RUN:
        yield from features([part])
        return
    word, hashed, power, step = part.strip(), 0, 1, int(STEP)
    whole = f" {word} "
    for at in range(0, len(word), RUN):
        some = word[at : at + RUN]
        codes = np.frombuffer(some.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
        ahead = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(len(codes) - 1, STEP, dtype=np.uint64))))
        hashed += power * int(((codes + np.uint64(1)) * ahead).sum())
        power = power * pow(step, len(codes), 1 << 64) % (1 << 64)
    yield np.zeros(1, dtype=np.int64), bucket(np.array([hashed % (1 << 64)], dtype=np.uint64), 0)
    for n in GRAMS:
        for at in range(0, len(whole) - n + 1, RUN):
            codes = np.frombuffer(whole[at : at + RUN + n - 1].encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
            last = len(codes) - n + 1
            mixed = codes[:last].copy()
            for k in range(1, n):
                mixed = mixed * STEP + codes[k : last + k]
            yield np.zeros(last, dtype=np.int64), bucket(mixed, n)


def repeats_between(some: list[str]) -> int:
    """Words that begin a part and repeat the word that ended the one before."""
    last = [x.rsplit(None, 1)[-1:] for x in some[:-1]]
    first = [x.split(None, 1)[:1] for x in some[1:]]
    return sum(bool(a) and a == b for a, b in zip(last, first, strict=True))


def counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The distinct buckets of a whole text and how often each occurs."""
    total = np.zeros(BUCKETS, dtype=np.int64)
    cut = parts(text)
    total[REPEAT] = repeats_between(cut)
    for part in cut:
        for _, b in pieces(part):
            total += np.bincount(b, minlength=BUCKETS)
    found = np.flatnonzero(total)
    return found, total[found]


def train(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = EPOCHS, rate: float = RATE, seed: int = 7) -> tuple[np.ndarray, float]:
    """Each bucket's difference of class scores, and the bias, by stochastic gradient descent.

    Without both labels every text gets the share of ones as its score (0.5 without any row).
    """
    y = np.asarray(labels, dtype=np.float64)
    share = float(y.mean()) if len(y) else 0.5
    if not len(y) or not 0 < share < 1:
        return np.zeros(BUCKETS), float(np.log((share + 1e-3) / (1 - share + 1e-3)))
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1, 1, (BUCKETS, DIMENSIONS)) / DIMENSIONS
    output = rng.normal(0, 1, (2, DIMENSIONS)) / DIMENSIONS
    bias = np.log([1 - share, share])
    steps, done = epochs * len(rows), 0
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            b, n = rows[i]
            w = (n / max(1, n.sum()))[:, None]  # not kept: doubles of all rows take twice the room of the counts
            pace = rate * (1 - done / steps)
            done += 1
            own = vectors[b]
            average = (own * w).sum(axis=0)
            z = output @ average + bias
            z -= z.max()
            p = np.exp(z)
            p /= p.sum()
            p[int(y[i])] -= 1
            back = p @ output
            output -= pace * np.outer(p, average)
            bias -= 0.1 * pace * p
            # a bucket's step by the root of its share: a plain share all but stops rare n-grams
            vectors[b] = own - pace * np.sqrt(w) * back
    return vectors @ (output[1] - output[0]), float(bias[1] - bias[0])


class Scorer:
    """Scores of whole texts under a trained model."""

    def __init__(self, difference: np.ndarray, bias: float) -> None:
        self.difference, self.bias = difference, bias

    def score(self, whole: list[str]) -> np.ndarray:
        total, n = np.zeros(len(whole)), np.zeros(len(whole))
        some: list[str] = []
        owners: list[int] = []
        size = 0
        for i, text in enumerate(whole):
            cut = parts(text)
            if len(cut) > 1:
                more = repeats_between(cut)
                total[i] += more * self.difference[REPEAT]
                n[i] += more
            for part in cut:
                if len(part) > 2 * RUN:
                    for _, b in pieces(part):
                        total[i] += self.difference[b].sum()
                        n[i] += len(b)
                    continue
                some.append(part)
                owners.append(i)
                size += len(part)
                if size >= RUN:
                    self.add(some, owners, total, n)
                    some, owners, size = [], [], 0
        self.add(some, owners, total, n)
        z = self.bias + total / np.maximum(n, 1)
        return 1 / (1 + np.exp(-np.clip(z, -700, 700)))

    def add(self, some: list[str], owners: list[int], total: np.ndarray, n: np.ndarray) -> None:
        """Adds the buckets' differences, and their number, of parts of texts."""
        for of, b in features(some) if some else ():
            np.add.at(total, owners, np.bincount(of, self.difference[b], minlength=len(some)))
            np.add.at(n, owners, np.bincount(of, minlength=len(some)))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = ROWS) -> tuple[np.ndarray, float]:
    """Trains on at most ``rows`` labelled rows of ``docs`` (doc_id, text)."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [counts(t) for t in texts(batch.column("text"))]
        lists = [pa.array([x[i].astype(np.int32) for x in found], pa.list_(pa.int32())) for i in (0, 1)]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), *lists], names=["doc_id", "label", "bucket", "n"])

    sample = in_arrow(training_sample(docs, labels, label, rows), work, "doc_id long, label int, bucket array<int>, n array<int>").toArrow()
    order = np.argsort(sample.column("doc_id").to_numpy(), kind="stable")
    lists = [sample.column(c).combine_chunks() for c in ("bucket", "n")]
    data = [(lists[0][i].values.to_numpy(), lists[1][i].values.to_numpy()) for i in order.tolist()]
    return train(data, sample.column("label").to_numpy()[order])


def scored(docs: DataFrame, model: tuple[np.ndarray, float], threshold: float, score: str = "score") -> DataFrame:
    """``docs`` with ``score``, the probability of label 1 for the whole ``text``, and ``predicted``.

    One pass without a shuffle; the other columns pass through. An empty or null text has no vectors
    and gets the score of the bias alone.
    """
    docs = docs.drop(score, "predicted")
    scorer = Scorer(model[0].astype(np.float64), model[1])

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        p = scorer.score(texts(batch.column("text")))
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=[*batch.schema.names, score, "predicted"])

    return in_arrow(docs, work, extended(docs.schema, **{score: T.DoubleType()}, predicted=T.IntegerType()))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``; learns from ``labels`` (doc_id, quality).

    Null and empty texts are scored; repeated rows stay; an empty table gives none; further columns go.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = scored(own, fit(own, labels), threshold)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
