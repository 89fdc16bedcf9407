"""Token-id output: whole texts encoded with the tokenizers library, written in Simple-8b blocks.

A token file is a Parquet table in ascending doc_id order (null first), one row a document: ``part``
and ``at`` say where it stands (range of doc_ids, ids before it in that range), ``n_tokens`` how many
ids it has, ``words`` its 64-bit little-endian words and ``blocks`` the offsets of each block's first
word. Parquet carries the bytes so that Spark's committer handles lost executors and any file system.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from maskwright.llm import simple8b
from maskwright.llm.common import Shipped, in_arrow, slices, texts
from maskwright.llm.pretokens import PATTERN, PIECES, Memory, settled

#: Slots for stretches of text that a worker remembers.
SLOTS = 1 << 21
#: Where a null doc_id stands in the order.
LOWEST = -(1 << 63)
#: The letters that stand for bytes in byte-level vocabularies.
SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
LETTERS = {b: chr(b) for b in SHOWN} | {b: chr(256 + i) for i, b in enumerate(sorted({*range(256)} - {*SHOWN}))}
FILE_SCHEMA = "part int, at long, doc_id long, n_tokens long, blocks array<int>, words binary"


class Encoder:
    """Ids of whole texts as ``Tokenizer.encode(text, add_special_tokens=False)`` gives them.

    Where the file is byte-level BPE with the public pattern, each distinct stretch is split here and its
    pre-tokens go through the library's model in byte letters, without its splitting, alignment and offsets;
    the ids are remembered. Any other file, and a text that holds the string of an added token, goes
    through the library whole.
    """

    def __init__(self, file: bytes) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_buffer(file)
        spec = json.loads(file)
        split = spec.get("pre_tokenizer") or {}
        model = spec["model"]
        self.by_piece = model["type"] == "BPE" and not any(model.get(x) for x in ("dropout", "continuing_subword_prefix", "end_of_word_suffix")) and not spec.get("normalizer") and not spec.get("truncation") and not spec.get("padding") and split.get("type") == "ByteLevel" and not split["add_prefix_space"] and split.get("use_regex", True)
        self.by_piece = self.by_piece and all(x in model["vocab"] for x in LETTERS.values())
        self.added = [x["content"] for x in spec.get("added_tokens") or ()]
        if self.by_piece:
            bare = spec | {"pre_tokenizer": None, "post_processor": None, "decoder": None, "added_tokens": []}
            self.bare = Tokenizer.from_str(json.dumps(bare))
            self.bare.model._resize_cache(0)  # only what is new comes here
            self.size = np.zeros(max(model["vocab"].values()) + 1, dtype=np.int64)
            for token, i in model["vocab"].items():
                self.size[i] = len(token)  # a letter a byte
        self.memory = Memory(self.encode_pieces, by_stretch=self.encode_stretches, slots=SLOTS)

    def encode_pieces(self, pieces: list[str]) -> list[bytes]:
        """The ids of distinct pre-tokens, as little-endian 32-bit words."""
        return self.encode_lists([[p] for p in pieces])

    def encode_stretches(self, stretches: list[str]) -> list[bytes]:
        """The ids of distinct stretches of plain text."""
        split = settled(PATTERN).findall
        return self.encode_lists([[s] if s.isalpha() or s[0] == " " and s[1:].isalpha() else split(s) for s in stretches])

    def encode_lists(self, lists: list[list[str]]) -> list[bytes]:
        """The ids of lists of pre-tokens."""
        out: list[bytes] = []
        for at in range(0, len(lists), PIECES):
            out += self.encode_some(lists[at : at + PIECES])
        return out

    def encode_some(self, lists: list[list[str]]) -> list[bytes]:
        flat = list(chain.from_iterable(lists))
        raw = "".join(flat).encode()
        begins = np.append(np.flatnonzero(np.frombuffer(raw, np.int8) >= -64), len(raw))  # of characters
        edges = begins[np.cumsum([0, *map(len, flat)])]
        shown, cuts = raw.decode("latin-1").translate(LETTERS), edges.tolist()
        letters = [shown[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        found = np.array(self.bare.encode_batch_fast([letters], is_pretokenized=True, add_special_tokens=False)[0].ids, dtype="<u4")
        last = np.cumsum(np.fromiter(map(len, lists), np.int64, len(lists)))
        ends = (np.searchsorted(np.cumsum(self.size[found]), edges[last], "right") * 4).tolist()
        ids = found.tobytes()
        return [ids[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.own.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        apart = [not self.by_piece or any(x in t for x in self.added) for t in texts]
        runs = self.memory.all_runs([t for t, a in zip(texts, apart, strict=True) if not a])
        return [self.whole(t) if a else np.concatenate([*next(runs), np.empty(0, np.uint32)]) for t, a in zip(texts, apart, strict=True)]


def built(file: bytes, suffix: str) -> Encoder:
    return Encoder(file)


@cache
def encoder(path: str) -> Encoder:
    """The encoder of a tokenizer file of this machine."""
    return Encoder(Path(path).read_bytes())


def limits_of(ids: DataFrame, parts: int) -> np.ndarray:
    """Ascending ids that cut the rows of ``ids`` (doc_id) into ``parts`` about even ranges.

    They come from a sketch of all ids, whose size depends on the number of parts alone. An id that
    fills several ranges occurs several times.
    """
    shares = [i / parts for i in range(1, parts)]
    found = ids.agg(F.percentile_approx("doc_id", shares, min(100 * parts, 1_000_000)).alias("limits")).first() if shares else None
    return np.array(found["limits"] if found and found["limits"] else [], dtype=np.int64)


def encoded(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """Rows of a token file for ``docs`` (doc_id, text; others are dropped): each whole text's ids and ``end_id``.

    A null text is empty and still gets its end id; a null doc_id comes first. Texts are encoded where
    they are read, and only packed words are shuffled, dealt into even ranges of doc_ids. Rows of one
    doc_id stand in the order of their texts' hashes; a doc_id that fills several ranges is dealt over
    them by turns, in that order within each. An empty table gives an empty file.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    whole = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole.alias("text"), F.xxhash64(whole).alias("tie"))
    file = Shipped(docs.sparkSession, path)
    limits = limits_of(own.select(F.coalesce("doc_id", F.lit(LOWEST)).alias("doc_id")), parts)

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn, end = TaskContext.get().partitionId(), np.array([end_id], dtype="<u4")
        for batch in slices(batches):
            lists = [np.concatenate((x, end)) for x in file.made(built).encode(texts(batch.column("text")))]
            words, begins, blocks = simple8b.encode(lists)
            stops = np.append(begins, len(words))[np.cumsum(blocks)]
            starts = np.concatenate(([0], stops[:-1]))
            per = np.split(begins, np.cumsum(blocks)[:-1])
            raw = words.astype("<u8").tobytes()
            ids = batch.column("doc_id").fill_null(LOWEST).to_numpy()
            low, high = (np.searchsorted(limits, ids, side) for side in ("left", "right"))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array((low + (turn + np.arange(len(ids))) % (high - low + 1)).astype(np.int32)),
                    batch.column("doc_id"),
                    batch.column("tie"),
                    pa.array([len(x) for x in lists], pa.int64()),
                    pa.array([(b - s).tolist() for b, s in zip(per, starts, strict=True)], pa.list_(pa.int32())),
                    pa.array([raw[a * 8 : b * 8] for a, b in zip(starts.tolist(), stops.tolist(), strict=True)], pa.binary()),
                ],
                names=["part", "doc_id", "tie", "n_tokens", "blocks", "words"],
            )
            turn += len(ids)

    def placed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = 0
        for batch in batches:
            sizes = batch.column("n_tokens").to_numpy()
            ends = at + np.cumsum(sizes)
            yield pa.RecordBatch.from_arrays([batch.column("part"), pa.array(ends - sizes), *(batch.column(c) for c in ("doc_id", "n_tokens", "blocks", "words"))], names=["part", "at", "doc_id", "n_tokens", "blocks", "words"])
            at += int(sizes.sum())

    packed = own.mapInArrow(encode, "part int, doc_id long, tie long, n_tokens long, blocks array<int>, words binary")
    return packed.repartitionById(parts, "part").sortWithinPartitions("doc_id", "tie").mapInArrow(placed, FILE_SCHEMA)


def write_tokens(docs: DataFrame, tokenizer: str, to: str, end_id: int) -> None:
    """Encodes ``docs`` and writes the token file ``to``."""
    encoded(docs, tokenizer, end_id).write.parquet(to)


def ids_of(batch: pa.RecordBatch) -> list[np.ndarray]:
    """The ids of each row of a token file, decoded together."""
    words, blocks = batch.column("words").to_pylist(), batch.column("blocks")
    sizes = np.array([len(w) // 8 for w in words], dtype=np.int64)
    per = np.diff(blocks.offsets.to_numpy())
    begins = blocks.flatten().to_numpy().astype(np.int64) + np.repeat(np.cumsum(sizes) - sizes, per)
    return simple8b.decode_lists(np.frombuffer(b"".join(words), dtype="<u8"), begins, batch.column("n_tokens").to_numpy())


def read_tokens(tokens: DataFrame) -> DataFrame:
    """The table of a token file with its decoded ``ids`` (array<long>) for words and blocks."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = pa.array([x.astype(np.int64) for x in ids_of(batch)], pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("part", "at", "doc_id", "n_tokens")), ids], names=["part", "at", "doc_id", "n_tokens", "ids"])

    return in_arrow(tokens, work, "part int, at long, doc_id long, n_tokens long, ids array<long>", rows=64)


def checksums(tokens: DataFrame) -> DataFrame:
    """part, at, doc_id, n_tokens, ids_crc32 of a token file's rows, from their decoded ids."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = ids_of(batch)
        crc = pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64())
        n = pa.array([len(x) for x in ids], pa.int64())
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("part", "at", "doc_id")), n, crc], names=["part", "at", "doc_id", "n_tokens", "ids_crc32"])

    return in_arrow(tokens, work, "part int, at long, doc_id long, n_tokens long, ids_crc32 long")


def with_starts(tokens: DataFrame, parts: DataFrame) -> DataFrame:
    """``start``: ids of all rows before, from ``at`` and the totals of the parts before.

    ``parts`` has a row for each range of the token file, not for each document, so that its one
    running sum and its broadcast are as small as the number of shuffle partitions.
    """
    totals = parts.groupBy("part").agg(F.max(F.col("at") + F.col("n_tokens")).alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("offset"))
    return tokens.join(F.broadcast(offsets), "part").withColumn("start", F.col("offset") + F.col("at")).drop("offset")
