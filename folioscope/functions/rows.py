"""Arrays to rows.

Spark adds a size check below an inner explode and pushes it towards the scan, which works the array out
twice. The outer form with the nulls dropped afterwards gives the same rows and works it out once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def explode_rows(df: DataFrame, keep: list, array: Column | str, name: str) -> DataFrame:
    return df.select(*keep, F.explode_outer(array).alias(name)).filter(F.col(name).isNotNull())


def posexplode_rows(df: DataFrame, keep: list, array: Column | str, pos: str, name: str) -> DataFrame:
    return df.select(*keep, F.posexplode_outer(array).alias(pos, name)).filter(F.col(pos).isNotNull())


def expand_rows(df: DataFrame, keep: list[str], inputs: list[str], fn: Callable[..., list[tuple]], columns: str, most: int = 4096) -> DataFrame:
    """``keep`` and the new ``columns`` for every tuple that ``fn`` returns for a row's ``inputs``.

    One pass over Arrow batches, map-only. The inputs are not copied onto the rows made from them, so the work stays
    linear in a long document; rows leave in parts of ``most``.
    """
    made = StructType.fromDDL(columns)
    schema = StructType([df.schema[c] for c in keep] + made.fields)
    to, new = to_arrow_schema(schema), to_arrow_schema(made)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def part(batch: pa.RecordBatch, of: list[int], rows: list[tuple]) -> pa.RecordBatch:
            at = pa.array(of, pa.int32())
            kept = [batch.column(c).take(at) for c in keep]
            return pa.RecordBatch.from_arrays(kept + [pa.array([r[i] for r in rows], f.type) for i, f in enumerate(new)], schema=to)

        for batch in batches:
            of, rows = [], []
            columns_in = [batch.column(c) for c in inputs]
            for i in range(batch.num_rows):
                found = fn(*(c[i].as_py() for c in columns_in))
                for j in range(0, len(found), most):
                    some = found[j:j + most]
                    of += [i] * len(some)
                    rows += some
                    if len(rows) >= most:
                        yield part(batch, of, rows)
                        of, rows = [], []
            if rows:
                yield part(batch, of, rows)

    return df.select(*dict.fromkeys([*keep, *inputs])).mapInArrow(run, schema)
