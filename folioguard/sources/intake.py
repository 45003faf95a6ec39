"""Audit of incoming files: one row per file, first reason for refusal, and the facts that identify it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioguard.fixed_values import DELIMITER_SAMPLE, DELIMITERS, MAX_FILE_BYTES, MAX_FILE_COLUMNS, MAX_FILE_ROWS
from folioguard.functions.scalars import normalized_header, txt
from folioguard.session import together
from folioguard.sources import ranges
from folioguard.sources.ranges import sniffer

# Split outside quotes: the rest of the line holds an even number of them.
_OUTSIDE_QUOTES = '(?=(?:[^"]*"[^"]*")*[^"]*$)'


@dataclass(frozen=True)
class FilePolicy:
    max_bytes: int = MAX_FILE_BYTES
    max_rows: int = MAX_FILE_ROWS
    max_columns: int = MAX_FILE_COLUMNS
    delimiters: tuple[str, ...] = DELIMITERS


def empty_files(spark: SparkSession, path: str) -> DataFrame:
    """Files without a byte, which Spark's own file listing leaves out."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    entries = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(folder, True)
    found = []
    while entries.hasNext():
        entry = entries.next()
        name = entry.getPath().getName()
        if entry.getLen() == 0 and not name.startswith(("_", ".")):
            found.append((entry.getPath().toString(), 0, bytearray()))
    return spark.createDataFrame(found, "path string, length long, content binary")


def read_files(spark: SparkSession, path: str, policy: FilePolicy = FilePolicy()) -> DataFrame:
    """``path, length, content``; files over the size limit are listed without being read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return bounded_content(files, policy).unionByName(empty_files(spark, path))


def bounded_content(files: DataFrame, policy: FilePolicy) -> DataFrame:
    """``path, length, content`` of listed files, without the content of those over the size limit.

    The limit is a filter on the length, which the reader applies before it opens a file.
    """
    small = files.where(F.col("length") <= policy.max_bytes).select("path", "length", "content")
    large = files.where(F.col("length") > policy.max_bytes).select(
        "path", "length", F.lit(None).cast("binary").alias("content"))
    return small.unionByName(large)


def detect_delimiter(sample: Column, policy: FilePolicy) -> Column:
    """Delimiter of a file by the first 64 Ki characters; ``unsupported`` where it is not allowed."""
    return F.pandas_udf(sniffer(policy.delimiters), "string")(sample)


def split_header(line: Column, delimiter: Column) -> Column:
    """Header cells of a line, quotes removed."""
    pattern = F.concat(
        F.when(delimiter == "|", r"\|").otherwise(delimiter), F.lit(_OUTSIDE_QUOTES))
    cells = F.split(line, pattern, -1)
    return F.transform(cells, lambda h: F.replace(F.regexp_replace(h, '^"|"$', ""), F.lit('""'), F.lit('"')))


FINDINGS = ("path", "file_name", "length", "sha256", "encoding", "delimiter", "column_count", "data_rows",
            "normalized_headers", "error_code")


def _judged(rows: DataFrame, policy: FilePolicy) -> DataFrame:
    """``FINDINGS`` from the facts of each file: header, delimiter, data_rows, long_row, is_open, has_bom, has_nul, is_utf8."""
    c = F.col
    rows = rows.withColumn("headers", split_header(c("header"), c("delimiter")))
    rows = rows.withColumn("normalized_headers", F.transform("headers", normalized_header))
    rows = rows.withColumn("column_count", F.size("headers"))
    code = (
        F.when(c("length") == 0, "empty_file")
        .when(~F.lower("file_name").endswith(".csv"), "unsupported_extension")
        .when(c("length") > policy.max_bytes, "file_too_large")
        .when(c("has_nul"), "binary_content")
        .when(~c("is_utf8"), "invalid_encoding")
        .when(c("delimiter") == "unsupported", "unsupported_delimiter")
        .when(c("column_count") > policy.max_columns, "too_many_columns")
        .when(F.exists("headers", lambda h: txt(h) == ""), "empty_header")
        .when(F.size(F.array_distinct("normalized_headers")) < c("column_count"), "header_collision")
        .when(c("is_open") | (c("widest") > c("column_count")), "parse_failed")
        .when(c("data_rows") > policy.max_rows, "too_many_rows")
        .when(c("data_rows") < 1, "empty_file")
    )
    encoding = F.when(c("is_utf8") & ~c("has_nul"), F.when(c("has_bom"), "utf-8-sig").otherwise("utf-8"))
    return rows.withColumns({"error_code": code, "encoding": encoding}).select(*FINDINGS)


def _file_name() -> Column:
    return F.element_at(F.split(F.replace(F.col("path"), F.lit("\\"), F.lit("/")), "/"), -1)


def audit_files(files: DataFrame, policy: FilePolicy = FilePolicy()) -> DataFrame:
    """``path, length`` and every finding of the audit; ``error_code`` is null for a usable file.

    For small files whose content is at hand: ``files`` has ``path``, ``length`` and ``content`` (null when too large to
    be read). ``audit_large_files`` has the same findings for files on disk, read in ranges.
    """
    c = F.col
    bom = F.lit(bytes([0xEF, 0xBB, 0xBF]))
    zero = F.lit(bytes([0]))
    rows = files.withColumns({
        "file_name": _file_name(),
        "sha256": F.sha2("content", 256),
        "has_bom": F.coalesce(F.startswith("content", bom), F.lit(False)),
        "has_nul": F.coalesce(F.contains("content", zero), F.lit(False)),
        "is_utf8": F.coalesce(F.is_valid_utf8(c("content").cast("string")), F.lit(False)),
    })
    rows = rows.withColumn(
        "__text", F.when(c("is_utf8") & ~c("has_nul"), F.regexp_replace(c("content").cast("string"), "^\ufeff", "")))
    rows = rows.withColumn("delimiter", detect_delimiter(F.substring("__text", 1, DELIMITER_SAMPLE), policy))
    # The header is the first record that is not blank; it ends at the first line end outside quotes.
    rows = rows.withColumn("header", F.regexp_extract("__text", r'^[\r\n]*+((?:[^"\r\n]++|"[^"]*+")*+)', 1))
    unquoted = F.regexp_replace("__text", '"[^"]*"', "q")
    rows = rows.withColumn("__body", F.filter(F.split(unquoted, "\r\n|\n|\r", -1), lambda line: line != ""))
    return _judged(rows.withColumns({
        "data_rows": (F.size("__body") - 1).cast("bigint"),
        "widest": F.array_max(F.transform("__body", lambda line: F.length(line) - F.length(
            F.replace(line, c("delimiter"), F.lit(""))))) + 1,
        "is_open": F.pmod(F.length("__text") - F.length(F.replace("__text", F.lit('"'), F.lit(""))), F.lit(2)) == 1,
    }), policy)


def audit_large_files(
    spark: SparkSession, path: str | list[str], policy: FilePolicy = FilePolicy(), range_bytes: int | None = None,
    with_empty: bool = True,
) -> DataFrame:
    """The findings of ``audit_files`` for files on disk, of any size: no file is held whole.

    Ranges of a file are read side by side; only its SHA-256 streams through one task. Files over ``policy.max_bytes``
    are not opened. A header record of over a million bytes counts as cut off there. ``with_empty`` adds files without a
    byte, which Spark does not list, if ``path`` is a folder.
    """
    files = ranges.listed_files(spark, path)
    size = range_bytes or ranges.range_bytes_for(files)
    maps, digests = together(
        lambda: ranges.range_maps(spark, path, size, policy.max_bytes),
        lambda: ranges.file_digests(spark, path, policy.max_bytes))
    facts = ranges.file_facts(maps, ranges.group_maps(maps))
    rows = files.join(facts, "file", "left").join(digests, "file", "left")
    c = F.col
    read = (c("length") <= policy.max_bytes) & ~F.coalesce(c("invalid"), F.lit(False))
    rows = rows.withColumns({
        "file_name": _file_name(),
        "has_bom": c("length") - F.coalesce("bytes", F.lit(0)) >= 2,  # the reader leaves the mark out
        "has_nul": F.coalesce("nul", F.lit(False)),
        "is_utf8": read,
        "sample": F.when(read & ~F.coalesce("nul", F.lit(False)), F.substring(
            F.coalesce("sample", F.lit("")), 1, DELIMITER_SAMPLE)),  # its last bytes may be half a character
        "header": F.when(read, F.coalesce(F.rtrim(c("header").cast("string"), F.lit("\r\n")), F.lit(""))),
        "data_rows": F.when(read, F.coalesce("n_records", F.lit(0)) - 1),
    }).withColumn("delimiter", detect_delimiter(c("sample"), policy))
    marks = F.array(*[F.lit(d) for d in DELIMITERS])
    widest = F.get("widest", F.array_position(marks, c("delimiter")).cast("int") - 1)
    found = _judged(rows.withColumns({
        "widest": F.coalesce(widest, F.lit(0)), "is_open": F.coalesce("is_open", F.lit(False)),
        # A file of a byte-order mark only has no line and so no digest of its own.
        "sha256": F.when((c("length") == 3) & c("bytes").isNull(), F.sha2(F.lit(bytes([0xEF, 0xBB, 0xBF])), 256)).otherwise(c("sha256")),
    }), policy)
    if not with_empty or not isinstance(path, str):
        return found
    return found.unionByName(audit_files(empty_files(spark, path), policy))


def with_privacy_gate(audited: DataFrame, findings: DataFrame) -> DataFrame:
    """Accepted files that hold restricted data are refused; ``findings`` has one row per file path and finding."""
    held = findings.groupBy("path").agg(F.count("*").alias("__n"))
    joined = audited.join(held, "path", "left")
    code = F.when(F.col("error_code").isNull() & F.col("__n").isNotNull(), "restricted_data").otherwise(
        F.col("error_code"))
    return joined.withColumn("error_code", code).drop("__n")
