"""What the operators of this subpackage share: Arrow row mapping, lineage cuts and measured joins."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..lineage import cut, release  # noqa: F401
from ..shipping import ship

#: Words are runs of anything but space and ASCII control white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows in one Arrow batch; with whole texts in a row this bounds what a Python worker holds.
ARROW_ROWS = 256
#: Bytes after which a batch is closed; a longer text is a batch of its own.
ARROW_BYTES = "16m"
#: A lookup side is broadcast only if its counted rows, or the entries of its arrays, are no more than this.
BROADCAST_ROWS = 20_000


def native_words(text):
    """Column: the number of words of a text column, null counting as none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def small_batches(spark: SparkSession) -> None:
    """Before Python code on texts: ships this package, and makes Arrow batches small in rows and bytes, so that long texts do not add up."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)


def map_columns(df: DataFrame, inputs: list[str], fn: Callable[..., dict[str, list]], schema: T.StructType, keep: list[str] | None = None) -> DataFrame:
    """Rows of ``keep`` (default: all columns) with the columns of ``schema`` that ``fn`` makes.

    ``fn`` gets one list for each of ``inputs`` and returns a list for each new column, one entry a row.
    A new column takes the place of an input column of the same name (case aside).
    """
    small_batches(df.sparkSession)
    new = {f.name.lower() for f in schema}
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() not in new]
    chosen = [*kept, *(f"__in{i}" for i in range(len(inputs)))]
    source = df.select(*(F.col(f"`{c}`") for c in kept), *(F.col(f"`{c}`").alias(f"__in{i}") for i, c in enumerate(inputs)))
    kinds = [(f.name, to_arrow(f.dataType)) for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = fn(*(batch.column(len(kept) + i).to_pylist() for i in range(len(chosen) - len(kept))))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(len(kept))), *(pa.array(made[n], kind) for n, kind in kinds)],
                names=[*kept, *(n for n, _ in kinds)],
            )

    out = T.StructType([*(df.schema[c] for c in kept), *schema.fields])
    return source.mapInArrow(run, out)


def to_arrow(kind: T.DataType) -> pa.DataType:
    """The Arrow type of the few Spark types that operators here return."""
    if isinstance(kind, T.ArrayType):
        return pa.list_(to_arrow(kind.elementType))
    if isinstance(kind, T.StructType):
        return pa.struct([(f.name, to_arrow(f.dataType)) for f in kind])
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary()}[kind.simpleString()]


def join_lookup(big: DataFrame, lookup: DataFrame, on: list[str], how: str = "inner", entries: str | None = None) -> DataFrame:
    """Join ``big`` to a stored ``lookup``: broadcast if it is counted to be small, else shuffled (AQE splits hot keys).

    Rows are counted, or the entries of the array column ``entries`` where rows differ in length.
    """
    counted = lookup.count() if entries is None else lookup.agg(F.coalesce(F.sum(F.size(entries)), F.lit(0))).first()[0]
    if counted <= BROADCAST_ROWS:
        lookup = F.broadcast(lookup)
    return big.join(lookup, on, how)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
