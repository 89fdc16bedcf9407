"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

The rank file fixes everything: a token's id is its rank, and the next merge is the adjacent pair
whose joined bytes have the lowest rank, leftmost first. The queue keeps, for every rank in sight,
a bucket of linked-list positions; three levels of 64-bit words say which buckets hold anything,
so the next rank is three find-first-set steps away. Entries that a merge has made stale stay in
their buckets and are skipped when met. All pre-tokens of a call share one arena, list and queue:
pre-tokens never touch each other, so their merges interleave without effect, and a very long
pre-token costs its merges only.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from functools import cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskwright.llm.common import Shipped, extended, in_arrow, texts
from maskwright.llm.pretokens import PATTERN, Memory

#: Distinct pre-tokens, and slots for stretches of text, that a worker remembers; a pipeline's workers hold other things too.
REMEMBERED, SLOTS = 80_000, 1 << 21
NO_RANK = 1 << 30


class RankQueue:
    """Buckets of positions by rank, with a three-level bitmap over the ranks."""

    def __init__(self, ranks: int) -> None:
        words = -(-ranks // 64)
        self.low, self.mid, self.top = [0] * words, [0] * -(-words // 64), 0
        self.buckets: dict[int, list[int]] = {}

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is None:
            self.put(rank, [position])
        else:
            bucket.append(position)

    def put(self, rank: int, positions: list[int]) -> None:
        """A bucket that was empty."""
        self.buckets[rank] = positions
        self.low[rank >> 6] |= 1 << (rank & 63)
        self.mid[rank >> 12] |= 1 << (rank >> 6 & 63)
        self.top |= 1 << (rank >> 12)

    def pop(self) -> tuple[int, list[int]]:
        """The lowest rank, and its positions from left to right."""
        i = (self.top & -self.top).bit_length() - 1
        j = i << 6 | (self.mid[i] & -self.mid[i]).bit_length() - 1
        rank = j << 6 | (self.low[j] & -self.low[j]).bit_length() - 1
        self.low[j] &= self.low[j] - 1
        if not self.low[j]:
            self.mid[i] &= self.mid[i] - 1
            if not self.mid[i]:
                self.top &= self.top - 1
        positions = self.buckets.pop(rank)
        positions.sort()
        return rank, positions


class Codec:
    """Encoder and decoder of one rank file."""

    def __init__(self, lines: bytes, pattern: str = PATTERN) -> None:
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines.splitlines())}
        self.size = max(self.ranks.values()) + 1
        self.bytes_of = [b""] * self.size
        for token, rank in self.ranks.items():
            self.bytes_of[rank] = token
        self.decimal_of = [str(i) for i in range(self.size)]
        singles = [self.ranks[bytes([i])] for i in range(256)]
        self.single = np.array(singles, dtype=np.int64)
        self.pair = np.array([[self.ranks.get(bytes((a, b)), NO_RANK) for b in range(256)] for a in range(256)], dtype=np.int64)
        self.memory = Memory(self.encode_pieces, pattern, REMEMBERED, slots=SLOTS)

    def merge(self, pieces: list[bytes]) -> list[np.ndarray]:
        """The ids of each non-empty pre-token, all run through one queue."""
        raw = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        ends = np.cumsum([len(p) for p in pieces])
        n = len(raw)
        starts = np.concatenate(([0], ends[:-1]))
        first = np.full(n, NO_RANK)
        first[:-1] = self.pair[raw[:-1], raw[1:]]
        first[ends - 1] = NO_RANK
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[ends - 1], before[starts] = -1, -1
        queue = RankQueue(self.size)
        order = np.argsort(first, kind="stable")
        order = order[: np.searchsorted(first[order], NO_RANK)]
        if len(order):
            cuts = np.flatnonzero(np.diff(first[order])) + 1
            for run in np.split(order, cuts):
                queue.put(int(first[run[0]]), run.tolist())
        token, rank_at, after, before = self.single[raw].tolist(), first.tolist(), after.tolist(), before.tolist()
        rank_of, bytes_of, push = self.ranks.get, self.bytes_of, queue.push
        while queue.top:
            rank, positions = queue.pop()
            joined = bytes_of[rank]
            for k, at in enumerate(positions):
                if rank_at[at] != rank:  # stale
                    continue
                gone, lowest = after[at], rank
                token[at], token[gone], rank_at[gone] = rank, -1, NO_RANK
                right = after[at] = after[gone]
                if right >= 0:
                    before[right] = at
                    rank_at[at] = new = rank_of(joined + bytes_of[token[right]], NO_RANK)
                    if new != NO_RANK:
                        push(new, at)
                        lowest = min(lowest, new)
                else:
                    rank_at[at] = NO_RANK
                if (left := before[at]) >= 0:
                    rank_at[left] = new = rank_of(bytes_of[token[left]] + joined, NO_RANK)
                    if new != NO_RANK:
                        push(new, left)
                        lowest = min(lowest, new)
                if lowest < rank and k + 1 < len(positions):  # the merge made a pair that comes before the rest
                    queue.put(rank, positions[k + 1 :])
                    break
        ids = np.array(token, dtype=np.int64)
        kept = np.concatenate(([0], np.cumsum(ids >= 0)))
        ids = ids[ids >= 0].astype("<u4")
        return [ids[kept[a] : kept[b]] for a, b in zip(starts, ends, strict=True)]

    def encode_pieces(self, pieces: list[str]) -> list[bytes]:
        """The ids of distinct pre-tokens, as little-endian 32-bit words: one queue for all that are no token."""
        raw = [p.encode() for p in pieces]
        out = [b"" if (whole := self.ranks.get(r)) is None else whole.to_bytes(4, "little") for r in raw]
        hard = [i for i, x in enumerate(out) if not x]
        for i, ids in zip(hard, self.merge([raw[i] for i in hard]), strict=True) if hard else ():
            out[i] = ids.tobytes()
        return out

    def all_runs(self, whole: list[str]) -> Iterator[Iterator[np.ndarray]]:
        """The ids of each text, of a very long one some at a time."""
        return self.memory.all_runs(whole)

    def encode(self, text: str) -> np.ndarray:
        """All ids of a text."""
        return np.concatenate([*next(self.all_runs([text])), np.empty(0, "<u4")]).astype("<u4")

    def decode(self, ids: Iterable[int]) -> bytes:
        """The bytes of ids; an id outside the vocabulary raises IndexError."""
        return b"".join(map(self.bytes_of.__getitem__, ids))


def built(lines: bytes, suffix: str) -> Codec:
    return Codec(lines)


@cache
def codec(path: str) -> Codec:
    """The codec of a rank file of this machine."""
    return Codec(Path(path).read_bytes())


def encode_rows(df: DataFrame, path: str, text: str = "text", into: str = "ids", checked: str | None = None) -> DataFrame:
    """``df`` with the token ids of the whole text as array<int> in ``into``.

    Null counts as empty and gives an empty array. ``checked`` names a further boolean column that
    says whether the ids decode to the text's bytes. Columns already so named are replaced. One pass
    without a shuffle; the other columns pass through untouched.
    """
    df = df.drop(*({into, checked} - {None, text}))
    schema = extended(df.schema, **{into: T.ArrayType(T.IntegerType())}, **({checked: T.BooleanType()} if checked else {}))
    file = Shipped(df.sparkSession, path)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        own, whole = file.made(built), texts(batch.column(text))
        ids = [np.concatenate([*runs, np.empty(0, "<u4")]).astype(np.int32) for runs in own.all_runs(whole)]
        offsets = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
        new = [pa.ListArray.from_arrays(offsets, np.concatenate([*ids, np.empty(0, np.int32)]))]
        if checked:
            new.append(pa.array([own.decode(x.tolist()) == t.encode() for x, t in zip(ids, whole, strict=True)], pa.bool_()))
        return pa.RecordBatch.from_arrays([*batch.columns, *new], names=schema.names)

    return in_arrow(df, work, schema, rows=256)


def decode_rows(df: DataFrame, path: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """``df`` with the bytes of the ids in ``ids`` as binary in ``into``; null ids count as none."""
    df = df.drop(into)
    schema = extended(df.schema, **{into: T.BinaryType()})
    file = Shipped(df.sparkSession, path)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = file.made(built)
        out = pa.array([own.decode(x or []) for x in batch.column(ids).to_pylist()], pa.binary())
        return pa.RecordBatch.from_arrays([*batch.columns, out], names=[*batch.schema.names, into])

    return in_arrow(df, work, schema, rows=64)


def digests(df: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row: encodes, decodes and digests in one pass.

    A null text is empty; rows are kept one by one, repeated ones too, and other columns are dropped;
    an empty table gives none.
    """
    file = Shipped(df.sparkSession, path)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        own, out = file.made(built), []
        for runs in own.all_runs(texts(batch.column("text"))):
            n, ids_sha, text_sha, gap = 0, hashlib.sha256(), hashlib.sha256(), ""
            for ids in runs:
                plain = ids.tolist()
                if plain:
                    ids_sha.update((gap + " ".join(map(own.decimal_of.__getitem__, plain))).encode())
                    gap = " "
                text_sha.update(own.decode(plain))
                n += len(plain)
            out.append((n, ids_sha.hexdigest(), text_sha.hexdigest()))
        n, a, b = zip(*out, strict=True) if out else ((), (), ())
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    own = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return in_arrow(own, work, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
