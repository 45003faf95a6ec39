"""CSV readers and the spreadsheet-safe writer."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioguard.fixed_values import MAX_FILE_ROWS, NA_TOKENS
from folioguard.functions.scalars import NUMBER_TEXT, integral, num_text
from folioguard.operators.privacy import header_key, minimize, safe_cells
from folioguard.sources import ranges

_SHAPE = {"quote": '"', "escape": '"'}
_AS_WRITTEN = {
    # Nothing reads as null, white space stays.
    "nullValue": "\u0000", "emptyValue": "", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False,
}
BOM = "\ufeff"


class HeaderCollision(ValueError):
    """Two headers are the same once normalised."""


class EmptyHeader(ValueError):
    """A column has no name."""


def collision_free(headers: list[str]) -> list[str]:
    """Normalised headers; refuses a collision and an empty header."""
    if any(not h.strip() for h in headers):
        raise EmptyHeader("a header is empty")
    names = [header_key(h) for h in headers]
    twice = sorted(name for name, n in Counter(names).items() if n > 1)
    if twice:
        raise HeaderCollision(f"headers collide after normalisation: {', '.join(twice)}")
    return names


def suffixed(headers: list[str]) -> list[str]:
    """Normalised headers; a repeat gets ``_2``, ``_3``."""
    seen: Counter[str] = Counter()
    out = []
    for header in headers:
        base = header_key(header)
        seen[base] += 1
        out.append(base if seen[base] == 1 else f"{base}_{seen[base]}")
    return out


def has_embedded_newlines(spark: SparkSession, path: str | list[str]) -> bool:
    """Whether a quoted cell may run over a line end: some line has an odd number of quotes."""
    lines = spark.read.text(path)
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return not lines.where(quotes % 2 == 1).limit(1).isEmpty()


def header_record(spark: SparkSession, path: str | list[str], delimiter: str, multi_line: bool) -> list[str]:
    """The first record as it is written: repeated, empty and quoted headers stay what they are."""
    first = spark.read.options(
        header=False, sep=delimiter, multiLine=multi_line, recursiveFileLookup=True, maxColumns=1 << 20, **_SHAPE,
        **_AS_WRITTEN).csv(path).first()
    headers = [h or "" for h in first] if first else []
    return [headers[0].removeprefix(BOM), *headers[1:]] if headers else []


def read_lexical(
    spark: SparkSession, path: str | list[str], delimiter: str = ",", embedded_newlines: bool | None = None,
    rename=collision_free, path_column: str | None = None, range_bytes: int | None = None,
) -> DataFrame:
    """Every cell as the text it was written as: ``""``, ``N/A`` and leading zeros stay.

    Columns go by position, under the names ``rename`` makes of the header record; a row with fewer cells is filled with
    empty ones, a row with more fails the read. A large file is read in splits. Where quoted cells hold line ends, which is
    looked up in one pass over the lines if ``embedded_newlines`` does not tell, the splits are ranges of known quoting
    state. ``path_column`` adds the file a row came from. Files read together share one header record.
    """
    multi_line = has_embedded_newlines(spark, path) if embedded_newlines is None else embedded_newlines
    names = rename(header_record(spark, path, delimiter, multi_line))
    fields = ", ".join([*[f"c{i} string" for i in range(len(names))], "more string"])
    if multi_line:
        shape = {"sep": delimiter, "multiLine": True, "maxColumns": max(20480, len(names) + 2), **_SHAPE, **_AS_WRITTEN}
        shape = {k: str(v).lower() if isinstance(v, bool) else str(v) for k, v in shape.items()}
        records = ranges.records(spark, path, range_bytes).where("not header")
        raw = records.select("file", F.from_csv("record", fields, shape).alias("r")).select("file", "r.*")
    else:
        raw = spark.read.options(
            header=True, mode="PERMISSIVE", sep=delimiter, maxColumns=max(20480, len(names) + 2), **_SHAPE,
            **_AS_WRITTEN).schema(fields).csv(path).withColumn("file", F.xxhash64("_metadata.file_path"))
    if path_column:
        raw = raw.join(ranges.listed_files(spark, path).select("file", F.col("path").alias("__path")), "file")
    too_long = F.raise_error(F.lit("malformed row: more cells than headers")).cast("boolean")
    cells = [F.coalesce(F.col(f"c{i}"), F.lit("")).alias(name) for i, name in enumerate(names)]
    extra = [F.col("__path").alias(path_column)] if path_column else []
    return raw.where(F.when(F.col("more").isNotNull(), too_long).otherwise(True)).select(*cells, *extra)


def missing_token(c: Column) -> Column:
    return c.isin(*NA_TOKENS)


def infer_types(df: DataFrame) -> dict[str, str]:
    """Type of each text column from one aggregation: long, double, boolean or string."""
    checks = []
    for name in df.columns:
        c = F.col(name)
        there = ~missing_token(c)
        checks += [
            F.count(F.when(there, 1)).alias(f"{name}__n"),
            F.count(F.when(there & num_text(c).isNotNull(), 1)).alias(f"{name}__num"),
            F.count(F.when(there & c.rlike(r"^\s*[+-]?\d+\s*$"), 1)).alias(f"{name}__int"),
            F.count(F.when(there & c.isin("True", "TRUE", "true", "False", "FALSE", "false"), 1)).alias(
                f"{name}__bool"),
        ]
    one = df.agg(F.count("*").alias("__rows"), *checks).first()
    types = {}
    for name in df.columns:
        n, rows = one[f"{name}__n"], one["__rows"]
        if n and one[f"{name}__int"] == n == rows:
            types[name] = "long"
        elif n == 0 or one[f"{name}__num"] == n:
            types[name] = "double"
        elif one[f"{name}__bool"] == n == rows:
            types[name] = "boolean"
        else:
            types[name] = "string"
    return types


def apply_types(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Missing tokens to null, then the given types; text that does not fit becomes null, never zero."""
    out = []
    for name in df.columns:
        c = F.when(~missing_token(F.col(name)), F.col(name))
        kind = types.get(name, "string")
        if kind == "double":
            c = num_text(c)
        elif kind == "long":
            c = F.when(c.rlike(NUMBER_TEXT) & integral(num_text(c)), F.trim(c).try_cast("long"))
        elif kind == "boolean":
            c = F.lower(F.trim(c)).try_cast("boolean")
        out.append(c.alias(name))
    return df.select(out)


def read_typed(
    spark: SparkSession, path: str, delimiter: str = ",", types: dict[str, str] | None = None, rename=collision_free
) -> DataFrame:
    """Cells typed by ``types``, or by one pass over the text when none are given."""
    lexical = read_lexical(spark, path, delimiter, rename=rename)
    return apply_types(lexical, infer_types(lexical) if types is None else types)


def read_trusted(spark: SparkSession, path: str) -> DataFrame:
    """Typed read of an already trusted file; repeated headers get a suffix instead of a refusal."""
    return read_typed(spark, path, rename=suffixed)


def row_bound(df: DataFrame, maximum: int = MAX_FILE_ROWS) -> DataFrame:
    """One row: verdict on the number of rows; counting stops one past the bound."""
    n = F.count("*")
    return df.limit(maximum + 1).agg(
        F.when(n == 0, "empty_file").when(n > maximum, "too_many_rows").otherwise("accepted").alias("verdict"),
        F.least(n, F.lit(maximum + 1)).alias("counted_rows"))


def write_safe_csv(df: DataFrame, path: str, privacy: bool = False, single_file: bool = False) -> None:
    """Neutralised (and, on request, minimised) CSV with a byte-order mark in front of each file's header.

    The mark rides on the first header name. ``single_file`` is for exports a person opens; otherwise every
    partition writes its own file.
    """
    rows = safe_cells(minimize(df) if privacy else df)
    names = rows.columns
    marked = rows.toDF(BOM + names[0], *names[1:]) if names else rows
    if single_file:
        marked = marked.coalesce(1)
    marked.write.options(
        header=True, quote='"', escape='"', nullValue="", emptyValue="", ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False, quoteAll=False).csv(path)
