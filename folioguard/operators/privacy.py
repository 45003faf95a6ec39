"""Privacy inspection, minimisation and spreadsheet-safe cells."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioguard.fixed_values import REDACTED, RESTRICTED_COLUMNS, VALUE_PATTERNS
from folioguard.functions.scalars import is_text, n_if


def header_key(name: str) -> str:
    """snake_case form of one header, for schema-level decisions."""
    return re.sub("[^0-9a-z]+", "_", name.strip().lower()).strip("_") or "unnamed"


# A match cannot do without this character; looking for it first spares most cells the pattern.
MARKS = {"email_pattern": "@", "international_phone_pattern": "+", "nigerian_phone_pattern": "0"}
_MARK_OF = {pattern: MARKS.get(name) for name, _, pattern in VALUE_PATTERNS}


def matches(c: Column, pattern: str) -> Column:
    """``pattern`` found anywhere in the cell; word and digit classes follow Unicode."""
    found = c.rlike(f"(?U){pattern}")
    mark = _MARK_OF.get(pattern)
    return c.contains(mark) & found if mark else found


def any_pattern(c: Column) -> Column:
    hit = F.lit(False)
    for _, _, pattern in VALUE_PATTERNS:
        hit = hit | matches(c, pattern)
    return hit


def restricted_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if header_key(c) in RESTRICTED_COLUMNS]


def inspected_columns(df: DataFrame) -> list[str]:
    held = set(restricted_columns(df))
    return [c for c in df.columns if c not in held and is_text(df, c)]


def privacy_findings(df: DataFrame, inspect_values: bool = True, max_rows: int | None = None) -> DataFrame:
    """Findings by column and detection with the number of rows, never a value.

    All rows are inspected unless ``max_rows`` asks for a bounded look. One aggregation covers every column and
    pattern.
    """
    rows = df if max_rows is None else df.limit(max_rows)
    checks: list[tuple[str, str, str, Column]] = [
        (RESTRICTED_COLUMNS[header_key(c)], c, "restricted_column", F.count("*")) for c in restricted_columns(df)]
    if inspect_values:
        checks += [
            (category, c, detection, n_if(matches(F.col(c), pattern)))
            for c in inspected_columns(df)
            for detection, category, pattern in VALUE_PATTERNS
        ]
    one = rows.agg(F.count("*").alias("inspected_rows"), *[n.alias(f"n{i}") for i, (*_, n) in enumerate(checks)])
    lines = F.array(*[
        F.struct(
            F.lit(i).alias("ordinal"), F.lit(category).alias("category"), F.lit(column).alias("column"),
            F.lit(detection).alias("detection"), F.col(f"n{i}").alias("affected_rows"))
        for i, (category, column, detection, _) in enumerate(checks)
    ])
    found = one.select("inspected_rows", F.inline(lines))
    return found.where((F.col("affected_rows") > 0) | (F.col("detection") == "restricted_column"))


def redact(c: Column) -> Column:
    """The whole cell goes when any pattern is in it."""
    return F.when(any_pattern(c), REDACTED).otherwise(c)


def minimize(df: DataFrame, inspect_values: bool = True) -> DataFrame:
    """Without the restricted columns, and with every matching text cell redacted."""
    kept = df.drop(*restricted_columns(df))
    if not inspect_values:
        return kept
    return kept.withColumns({c: redact(F.col(c)) for c in kept.columns if is_text(kept, c)})


def neutralize(c: Column) -> Column:
    """A quote in front of a cell a spreadsheet would run as a formula."""
    return F.when(c.rlike(r"^[\t\r]|^[ \t\r\n]*[=+\-@]"), F.concat(F.lit("'"), c)).otherwise(c)


def safe_cells(df: DataFrame) -> DataFrame:
    """Every text column neutralised; other columns as they are."""
    return df.withColumns({c: neutralize(F.col(c)) for c in df.columns if is_text(df, c)})
