"""Ordered arrays of bounded length: a key with any number of rows as several chunks with running offsets."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from dairyframe.session import scratch_path

SIZE = 4096


def _changes(column: pa.Array) -> np.ndarray:
    """Where a value differs from the one before it, nulls being equal."""
    here, before = column.slice(1), column.slice(0, len(column) - 1)
    unlike = pc.fill_null(pc.not_equal(here, before), False)
    return np.asarray(pc.or_(unlike, pc.not_equal(pc.is_null(here), pc.is_null(before))))


def ordered_chunks(
    df: DataFrame, *, keys: Sequence[str], order: Sequence[str], fields: Sequence[str], size: int = SIZE
) -> DataFrame:
    """Rows to one row per (key, chunk): keys, chunk (from 0), offset, n, and each field as an array in ``order``.

    ``offset`` is how many rows of the key lie in earlier chunks. No chunk holds more than ``size`` rows, and every row is in one.
    Rows are dealt to tasks by ranges of keys and order, so a key with a third of all rows lies in many tasks, and a task
    holds one chunk at a time. A chunk may be short where a range ends. Ranges are cut between different (key, order), so
    ``order`` should tell rows apart. The chunks are written once; offsets are sums over one slim row per chunk.
    """
    spark = df.sparkSession
    names = list(dict.fromkeys([*keys, *order, *fields]))
    ranged = df.select(*names).repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    types = {f.name: f.dataType for f in ranged.schema}
    schema = T.StructType([T.StructField(k, types[k]) for k in keys])
    schema = schema.add("_part", "integer").add("_no", "long").add("n", "integer")
    for f in fields:
        schema = schema.add(f"_a_{f}", T.ArrayType(types[f]))
    arrow = to_arrow_schema(schema)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, no, held = TaskContext.get().partitionId(), 0, None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if held is None else pa.concat_tables([held, rows])
            rows = rows.combine_chunks()
            if not rows.num_rows:
                continue
            new = np.zeros(rows.num_rows, bool)
            new[0] = True
            for k in keys:
                new[1:] |= _changes(rows.column(k).combine_chunks())
            starts = np.flatnonzero(new)
            lengths = np.diff(np.append(starts, rows.num_rows))
            edges = np.concatenate([np.arange(s, s + n, size) for s, n in zip(starts, lengths)])
            # the last chunk may go on in the next batch
            yield out(rows.slice(0, int(edges[-1])), edges, part, no)
            no += len(edges) - 1
            held = rows.slice(int(edges[-1]))
        if held is not None:
            yield out(held, np.array([0, held.num_rows]), part, no)

    def out(rows: pa.Table, edges: np.ndarray, part: int, no: int) -> pa.RecordBatch:
        count = len(edges) - 1
        offsets = pa.array(edges, pa.int32())
        first = pa.array(edges[:-1], pa.int64())
        columns = [rows.column(k).combine_chunks().take(first) for k in keys]
        columns += [pa.array(np.full(count, part, np.int32)), pa.array(np.arange(no, no + count)), pa.array(np.diff(edges).astype(np.int32))]
        columns += [pa.ListArray.from_arrays(offsets, _flat(rows.column(f))) for f in fields]
        return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)

    path = scratch_path(spark, "chunks")
    ranged.mapInArrow(cut, schema).write.parquet(path)
    made = spark.read.schema(schema).parquet(path)
    slim = made.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_part").alias("_p"), F.col("_no").alias("_o"), F.col("n").alias("_n"))
    order_of = Window.partitionBy(*[f"_k_{k}" for k in keys]).orderBy("_p", "_o")
    running = F.coalesce(F.sum("_n").over(order_of.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    placed = slim.select("_p", "_o", (F.row_number().over(order_of) - 1).alias("chunk"), running.alias("offset"))
    joined = made.join(placed, (F.col("_part") == F.col("_p")) & (F.col("_no") == F.col("_o")))
    return joined.select(*keys, "chunk", "offset", "n", *[F.col(f"_a_{f}").alias(f) for f in fields])


def _flat(column: pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
