"""Small helpers the operators of this package share."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WHITE = " \t\n\x0b\x0c\r"


_held: dict[str, object] = {}


def held(name: str, make: Callable[[], object]):
    """What an operator keeps on a worker between tasks: vocabularies, models and bounded caches.

    A worker serves many jobs, so only the latest operator's are kept.
    """
    if name not in _held:
        release()
        _held[name] = make()
    return _held[name]


def release() -> None:
    """Drop what an operator before this one kept on the worker."""
    if _held:
        _held.clear()
        gc.collect()


def small_batches(spark: SparkSession, rows: int = 1_000) -> None:
    """At most ``rows`` rows in an Arrow batch of this session: a row is a whole text here, and the default of 10 000 of
    them would fill an executor's memory outside the heap. A lower setting stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds))


def set_aside(docs: DataFrame, needed: Sequence[str] = ("doc_id", "text")) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``docs`` with the columns that are not ``needed`` under names no operator uses, and the way back."""
    own = {c if c in needed else f"__own{i}": c for i, c in enumerate(docs.columns)}

    def restored(df: DataFrame) -> DataFrame:
        return df.select(*[F.col(f"`{name}`").alias(c) for name, c in own.items()])

    return docs.toDF(*own), restored


def pick(docs: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Only the columns an operator reads, so that extra ones cannot clash with those it adds."""
    return docs.select(*[F.col(f"`{c}`") for c in columns])


def per_text(
    docs: DataFrame, keep: Sequence[str], prepare: Callable[[], Callable[[list[str]], dict]], fields: str,
    text: str = "text", rows: int = 1024, large_batches: bool = False,
) -> DataFrame:
    """New columns for each text, in Arrow batches; nothing is shuffled.

    ``prepare`` runs once in a task, takes what it keeps on a worker from ``held`` (or calls ``release``), and gives the
    function that takes up to ``rows`` texts (null: empty) and returns the columns that ``fields`` declares. The columns in ``keep`` pass through untouched, nulls and large ids too.
    """
    if not large_batches:
        small_batches(docs.sparkSession)
    read = text if text in keep else "__text"
    own = [] if text in keep else [F.col(f"`{text}`").alias("__text")]
    source = docs.select(*[F.col(f"`{c}`") for c in keep], *own)
    declared = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema[: len(keep)])
    kinds = dict(part.split() for part in fields.split(","))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = prepare()
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                some = batch.slice(start, rows)
                made = work([t or "" for t in some.column(read).to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [*some.columns[: len(keep)], *[pa.array(made[c], type=ARROW_KINDS[k]) for c, k in kinds.items()]],
                    names=[*keep, *kinds])

    return source.mapInArrow(run, f"{declared}, {fields}")


ARROW_KINDS = {
    "string": pa.string(), "binary": pa.binary(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(),
    "float": pa.float32(), "boolean": pa.bool_(), "array<bigint>": pa.list_(pa.int64()),
    "array<double>": pa.list_(pa.float64()), "array<int>": pa.list_(pa.int32()), "array<string>": pa.list_(pa.string()),
}
