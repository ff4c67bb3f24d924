"""Blocks of rows that meet each other in tasks: each is stored once, packed, and pairs are made from what is stored, so that no row is shuffled
once for each block that it meets."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidewake.plans.storage import kept


def packed(rows: DataFrame, by: tuple[str, ...], blocks: int, name: str, shape: Callable[[pa.Table], pa.Table] | None = None) -> DataFrame:
    """(by, data): the rows of each block, without ``by``, as one compressed Arrow stream; ``shape`` may bring them into another form before."""
    kinds = [(c, to_arrow_type(rows.schema[c].dataType)) for c in by]

    def run(group: pa.Table) -> pa.Table:
        table = group.drop_columns(list(by)).combine_chunks()
        table, sink = shape(table) if shape else table, pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as out:
            out.write_table(table)
        return pa.table({c: pa.array([group.column(c)[0].as_py()], kind) for c, kind in kinds} | {"data": pa.array([sink.getvalue().to_pybytes()], pa.binary())})

    names = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in by)
    return kept(rows.repartition(max(1, min(blocks, 1024)), *by).groupBy(*by).applyInArrow(run, f"{names}, data binary"), name)


def unpacked(data: pa.Scalar) -> pa.Table:
    return pa.ipc.open_stream(data.as_buffer()).read_all().combine_chunks()


def side(blocks: DataFrame, name: str) -> DataFrame:
    """The blocks with ``name`` before each column's name."""
    return blocks.select(*(F.col(c).alias(f"{name}_{c}") for c in blocks.columns))


def met(left: DataFrame, right: DataFrame, when: Column | None = None) -> DataFrame:
    """Each row of ``left`` with each of ``right``, where ``when`` holds: tasks read pairs of stored partitions, nothing is shuffled or broadcast."""
    left = left.hint("shuffle_replicate_nl")
    return left.crossJoin(right) if when is None else left.join(right, when)
