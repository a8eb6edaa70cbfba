"""Row-wise Arrow stages that carry the other columns along."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import pieces

SLICE = 4 << 20  # bytes of text handled at once


def unused(df: DataFrame, name: str) -> str:
    """`name`, lengthened until `df` has no such column (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def with_columns(df: DataFrame, text: str, fields: list[T.StructField], compute: Callable[..., list[pa.Array]],
                 keep: list[str] | None = None, inputs: tuple[str, ...] = (), limit: int = SLICE) -> DataFrame:
    """`df` with new columns that `compute(text column, *input columns)` makes, a slice of rows at a time.

    `keep` names the columns to carry (default: all). A carried column of the same name as a
    new one gives way to it. Columns travel under positional names, so no name can clash inside."""
    new = {f.name for f in fields}
    kept = [c for c in (df.columns if keep is None else keep) if c not in new]
    needed = list(dict.fromkeys([text, *inputs]))
    plain = df.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(kept)],
                      *[F.col(f"`{c}`").alias(f"n{i}") for i, c in enumerate(needed)])
    at = {c: f"n{i}" for i, c in enumerate(needed)}
    order = [at[c] for c in (text, *inputs)]
    out = T.StructType([T.StructField(f"k{i}", plain.schema[f"k{i}"].dataType) for i in range(len(kept))]
                       + [T.StructField(f"r{i}", f.dataType) for i, f in enumerate(fields)])
    names = out.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, order[0], limit):
            made = compute(*[batch.column(batch.schema.get_field_index(c)) for c in order])
            carried = [batch.column(i) for i in range(len(names) - len(made))]
            yield pa.RecordBatch.from_arrays(carried + made, names=names)

    done = plain.mapInArrow(run, out)
    return done.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(kept)],
                       *[F.col(f"r{i}").alias(f.name) for i, f in enumerate(fields)])
