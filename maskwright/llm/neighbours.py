"""Approximate nearest neighbours by inner product: a projection forest, then exact reranking.

The forest is fitted on a bounded sample; every row is indexed. Equal vectors are one class with its
few smallest ids, so that a vector held by a third of all rows is one entry and one candidate: the
ids beyond could never be among the nearest, as ties go to smaller ids. To make inner products
distances, indexed vectors get a further component that brings all to one length, queries a zero.
Vectors far longer than most would make that component drown the others, so the length is bounded by
the median's, and what is longer still is a candidate of every query.

Queries and classes meet in blocks of at most ``QUERY_BLOCK`` and about ``ROW_BLOCK``. In a block, a
query's candidates are the rows in its leaves; their inner products with the original vectors are
taken in double precision, summed in the order of the components as in the result, and the best kept, so
what leaves a block is a short list for each query.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from maskwright.llm.common import in_arrow, written
from maskwright.llm.forest import Forest

#: Rows that the forest is fitted on, at most.
SAMPLE = 16_384
TREES, LEAF = 16, 64
#: A query looks into leaves until they hold this share of all classes (a class counts in every
#: leaf looked into) and at least ``LEAST``. Vectors without structure need this much for the recall.
SHARE, LEAST = 1.0, 4000
QUERY_BLOCK, ROW_BLOCK = 1024, 8192
#: Vectors of more than this times the median length are looked at by every query.
FAR_LONGER = 16
#: Ways in which the copies of a vector are split while their smallest ids are found.
SALTS = 64


def usable(rows: DataFrame, id_column: str, vector: str, size: int | None = None) -> tuple[DataFrame, int]:
    """id, vec (array<double>) of the rows that take part, and the length of their vectors (0: none does).

    Null ids, null, empty or zero vectors and those with null or non-finite components do not; nor
    do vectors of another length than ``size`` or, without it, than most have (of equally frequent
    lengths, the smaller).
    """
    own = rows.select(F.col(id_column).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vec")).filter("id IS NOT NULL AND vec IS NOT NULL")
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    own = own.filter(finite & F.exists("vec", lambda x: x != 0))
    if size is None:
        lengths = own.groupBy(F.size("vec").alias("size")).count().orderBy(F.desc("count"), "size").limit(1).collect()
        size = lengths[0]["size"] if lengths else 0
    return own.filter(F.size("vec") == size), size


def classes(rows: DataFrame, ids: int) -> DataFrame:
    """class_id (its smallest id), ids (its smallest, ascending), vec: a row for each distinct vector."""
    exact = F.transform("vec", lambda x: x + F.lit(0.0))  # -0.0 is 0.0

    def fewest(groups: DataFrame, *by: str) -> DataFrame:
        return groups.groupBy(*by).agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, ids).alias("ids"))

    def combine(batch: pa.RecordBatch) -> pa.RecordBatch:
        flat = vectors(batch)
        own = batch.column("id").to_numpy()
        order = np.lexsort((own, *flat.T[:2]))
        groups: dict[bytes, list[int]] = {}
        for i in order.tolist():
            some = groups.setdefault(flat[i].tobytes(), [])
            if len(some) < ids:
                some.append(int(own[i]))
        found = np.frombuffer(b"".join(groups), dtype=np.float64).reshape(len(groups), -1)
        return pa.RecordBatch.from_arrays([pa.array(list(groups.values()), pa.list_(pa.int64())), as_lists(found)], names=["ids", "vec"])

    few = in_arrow(rows.select("id", exact.alias("vec")), combine, "ids array<long>, vec array<double>", rows=ROW_BLOCK)
    salted = fewest(few.withColumn("salt", F.pmod(F.element_at("ids", 1), F.lit(SALTS))), "vec", "salt")
    return fewest(salted, "vec").select(F.element_at("ids", 1).alias("class_id"), "ids", "vec")


def vectors(batch: pa.RecordBatch | pa.Table, column: str = "vec") -> np.ndarray:
    """The vectors of a batch as a matrix."""
    values = batch.column(column)
    values = values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values
    flat = values.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(values), len(flat) // len(values)) if len(values) else np.empty((0, 1))


def as_lists(x: np.ndarray) -> pa.Array:
    offsets = np.arange(0, x.size + 1, max(1, x.shape[1] if x.ndim == 2 else 1), dtype=np.int32)
    return pa.ListArray.from_arrays(offsets[: len(x) + 1], pa.array(x.ravel()))


def lifted(x: np.ndarray, longest: float) -> np.ndarray:
    """Vectors with the component that brings them to the longest length."""
    return np.column_stack((x, np.sqrt(np.maximum(0.0, longest - (x * x).sum(axis=1)))))


def nearest(rows: DataFrame, queries: DataFrame, k: int = 20, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for each row of ``queries`` among ``rows``.

    Both have an id and a vector; a candidate with the query's own id is left out. Order is by larger
    inner product, then smaller id; a query with fewer candidates gets all. Rows that repeat an id
    and a vector count once; a query id with several vectors asks with the least of them, component by
    component. Queries of another length than most rows have don't take part. No usable query or row
    gives an empty table.
    """
    spark = rows.sparkSession
    own, size = usable(rows, id_column, vector)
    index = written(classes(own, k + 1), "ann-classes")
    asked = written(usable(queries, id_column, vector, size)[0].groupBy("id").agg(F.min("vec").alias("vec")), "ann-queries")
    n, longest = index.agg(F.count("*"), F.max(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x))).first()
    n_asked = asked.count()
    if not n or not n_asked:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sample = vectors(index.orderBy(F.xxhash64("class_id"), "class_id").limit(SAMPLE).select("vec").toArrow())
    squares = (sample * sample).sum(axis=1)
    longest = min(longest, FAR_LONGER**2 * float(np.median(squares)))
    forest = Forest(lifted(sample[squares <= longest], longest), TREES, LEAF, seed=11)
    row_blocks, query_blocks = -(-n // ROW_BLOCK), -(-n_asked // QUERY_BLOCK)

    def place(batch: pa.RecordBatch) -> pa.RecordBatch:
        leaves = forest.leaves_of(lifted(vectors(batch), longest))
        return pa.RecordBatch.from_arrays([batch.column("class_id"), batch.column("vec"), pa.array([x.tobytes() for x in leaves.astype(np.int16)], pa.binary())], names=["class_id", "vec", "leaves"])

    placed = written(in_arrow(index.select("class_id", "vec"), place, "class_id long, vec array<double>, leaves binary", rows=ROW_BLOCK), "ann-leaves")
    counts = in_arrow(placed.select("leaves"), histogram(forest), "cell int, n long", rows=ROW_BLOCK).groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    held = np.zeros(forest.trees * forest.leaves, dtype=np.int64)
    held[counts.column("cell").to_numpy()] = counts.column("n").to_numpy()
    held = held.reshape(forest.trees, forest.leaves)
    enough = max(LEAST, SHARE * n)

    def probe(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = vectors(batch)
        looks = np.zeros((len(x), forest.trees, forest.leaves), dtype=bool)
        for i, found in enumerate(forest.probes(np.column_stack((x, np.zeros(len(x)))), held, enough)):
            looks[i][tuple(np.array(found).T)] = True
        packed = np.packbits(looks.reshape(len(x), -1), axis=1)
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array([p.tobytes() for p in packed], pa.binary())], names=[*batch.schema.names, "looks"])

    def blocks(count: int) -> F.Column:
        return F.explode(F.sequence(F.lit(0), F.lit(count - 1)))

    looking = in_arrow(asked.repartition("id"), probe, "id long, vec array<double>, looks binary", rows=256)
    left = looking.withColumn("qb", F.pmod(F.xxhash64("id"), F.lit(query_blocks)).cast("int")).withColumn("rb", blocks(row_blocks))
    right = placed.withColumn("rb", F.pmod(F.xxhash64("class_id"), F.lit(row_blocks)).cast("int")).withColumn("qb", blocks(query_blocks))

    def rerank(asks: pa.Table, there: pa.Table) -> pa.Table:
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if asks.num_rows and there.num_rows:
            x, ids = vectors(there), there.column("class_id").to_numpy()
            leaves = np.frombuffer(b"".join(there.column("leaves").to_pylist()), dtype=np.int16).reshape(len(x), forest.trees) + np.arange(forest.trees) * forest.leaves
            squares = (x * x).sum(axis=1)
            always, lengths = squares > longest, np.sqrt(squares)
            for q, v, looks in zip(asks.column("id").to_numpy(), vectors(asks), asks.column("looks").to_pylist(), strict=True):
                seen = np.unpackbits(np.frombuffer(looks, dtype=np.uint8)).view(bool)
                some = hopeful(x, v, np.flatnonzero(seen[leaves].any(axis=1) | always), lengths, k + 1)
                score = products(x[some], v)
                if len(some) > k + 1:
                    some, score = best_of(some, score, ids, k + 1)
                found.append((np.full(len(some), q), ids[some], score))
        q, c, s = (np.concatenate(z) for z in zip(*found, strict=True)) if found else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        return pa.table({"query_id": pa.array(q, pa.int64()), "class_id": pa.array(c, pa.int64()), "near": pa.array(s, pa.float64())})

    pairs = left.groupBy("qb", "rb").cogroup(right.groupBy("qb", "rb")).applyInArrow(rerank, "query_id long, class_id long, near double")
    order = Window.partitionBy("query_id").orderBy(F.desc("near"), "class_id")
    best = written(pairs.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= 2 * k + 1).select("query_id", "class_id"), "ann-best")
    both = best.join(index, "class_id").join(asked.select(F.col("id").alias("query_id"), F.col("vec").alias("asked")), "query_id")
    score = F.aggregate(F.zip_with("vec", "asked", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    scored = both.select("query_id", F.explode("ids").alias("vec_id"), score.alias("score")).filter("vec_id <> query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return scored.withColumn("rank", rank.cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def products(x: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Inner products, added from the first component to the last: the doubles that the result has."""
    return np.cumsum(x * v, axis=1)[:, -1] + 0.0


def hopeful(x: np.ndarray, v: np.ndarray, some: np.ndarray, lengths: np.ndarray, k: int) -> np.ndarray:
    """Those of some rows that may be among the k best, however a sum is rounded: a pair's error is at most its slack."""
    if len(some) <= k:
        return some
    rough = x[some] @ v
    slack = 2 * len(v) * np.finfo(np.float64).eps * lengths[some] * np.sqrt(v @ v) + 1e-300
    low = rough - slack
    bar = np.partition(np.where(np.isnan(low), -np.inf, low), -k)[-k]
    return some[~(rough + slack < bar)]


def best_of(some: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of some rows by score, then smaller id; however many tie, no more are kept."""
    least = np.partition(score, -k)[-k]
    over, tied = np.flatnonzero(score > least), np.flatnonzero(score == least)
    left = k - len(over)
    if len(tied) > left:
        tied = tied[np.argpartition(ids[some[tied]], left - 1)[:left]]
    kept = np.concatenate((over, tied))
    return some[kept], score[kept]


def histogram(forest: Forest):
    """Counts of each (tree, leaf) in a batch, by cell."""
    trees, leaves = forest.trees, forest.leaves

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = np.frombuffer(b"".join(batch.column("leaves").to_pylist()), dtype=np.int16).reshape(batch.num_rows, trees)
        n = np.bincount((own + np.arange(trees) * leaves).ravel(), minlength=trees * leaves)
        cell = np.flatnonzero(n)
        return pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(n[cell])], names=["cell", "n"])

    return work
