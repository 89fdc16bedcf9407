"""One pass over a table in Arrow batches, for work that built-in expressions can't do."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import DataType, StructField, StructType

#: Rows handled at a time.
ROWS = 64


def with_columns(df: DataFrame, make: Callable[..., tuple], inputs: tuple[str, ...], **new: DataType) -> DataFrame:
    """``df`` with new columns that ``make`` gives as a tuple for the values of each row's inputs.

    Columns already so named are replaced. Rows go through one by one, without a shuffle.
    """
    kept = [c for c in df.columns if c not in new]
    schema = StructType([*(df.schema[c] for c in kept), *(StructField(n, t) for n, t in new.items())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        kinds = [to_arrow_type(t) for t in new.values()]
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                made = [make(*row) for row in zip(*(part.column(c).to_pylist() for c in inputs), strict=True)]
                columns = [pa.array(c, k) for c, k in zip(zip(*made, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *columns], names=[*kept, *new])

    return df.mapInArrow(run, schema)
