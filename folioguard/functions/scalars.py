"""Parsing, rounding and formatting expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Accepted spellings of a number in a text cell.
NUMBER_TEXT = r"(?i)^\s*[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf|infinity)\s*$"
# Unicode white space plus the four ASCII separators; trimming by set looks at the ends of a cell only.
EDGE_SPACE = (
    " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009"
    "\u200a\u2028\u2029\u202f\u205f\u3000"
)
# Accepted date shapes: guard pattern, then the format tried. Month-first wins over day-first.
DATE_SHAPES = (
    (r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"),
    (r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/yyyy"),
    (r"^\d{1,2} [A-Za-z]{3} \d{4}$", "d MMM yyyy"),
    (r"^[A-Za-z]{3} \d{1,2}, \d{4}$", "MMM d, yyyy"),
    (r"^\d{8}$", "yyyyMMdd"),
)
ISO_TIMESTAMP = r"^\d{4}-\d{1,2}-\d{1,2}[T ]\d{1,2}:\d{2}(:\d{2}(\.\d+)?)?\s*(Z|[+-]\d{2}:?\d{2})?$"


def type_of(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def is_text(df: DataFrame, name: str) -> bool:
    return isinstance(type_of(df, name), T.StringType)


def txt(c: Column) -> Column:
    """Text with white space removed at both ends."""
    return F.btrim(c.cast("string"), F.lit(EDGE_SPACE))


def present_text(c: Column) -> Column:
    """True where the cell holds something other than white space."""
    return c.isNotNull() & (txt(c) != "")


def blank_to_null(c: Column) -> Column:
    stripped = txt(c)
    return F.when(stripped != "", stripped)


def num_text(c: Column) -> Column:
    """A text cell as double; anything that does not spell a number is null."""
    parsed = F.when(c.rlike(NUMBER_TEXT), F.trim(c).try_cast("double"))
    overflow = parsed.isin(float("inf"), float("-inf")) & ~F.lower(c).contains("inf")
    return F.when(~overflow, parsed)


def num(df: DataFrame, name: str) -> Column:
    """Column ``name`` as double, null where it is missing, NaN or unparseable. Never imputes."""
    kind = type_of(df, name)
    c = F.col(name)
    if isinstance(kind, T.StringType):
        return num_text(c)
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return F.when(~F.isnan(c), c.cast("double"))
    if isinstance(kind, (T.NumericType, T.BooleanType)):
        return c.cast("double")
    return F.lit(None).cast("double")


def missing(df: DataFrame, name: str) -> Column:
    """Null or NaN."""
    c = F.col(name)
    if isinstance(type_of(df, name), (T.FloatType, T.DoubleType)):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def ts_text(c: Column) -> Column:
    """A text cell as timestamp under the accepted shapes; time-only text is refused."""

    def parse(s: Column) -> Column:
        tries = [F.when(s.rlike(guard), F.try_to_timestamp(s, F.lit(fmt))) for guard, fmt in DATE_SHAPES]
        return F.coalesce(*tries, F.when(s.rlike(ISO_TIMESTAMP), s.try_cast("timestamp")))

    # The lambda binds the stripped text, so that it is worked out once and not for every shape.
    return F.get(F.transform(F.array(txt(c)), parse), F.lit(0))


def ts(df: DataFrame, name: str) -> Column:
    """Column ``name`` as timestamp; numeric columns hold no dates."""
    kind = type_of(df, name)
    if isinstance(kind, T.StringType):
        return ts_text(F.col(name))
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.col(name).cast("timestamp")
    return F.lit(None).cast("timestamp")


def r1(c: Column) -> Column:
    """Round to one decimal, ties to even."""
    return F.bround(c, 1)


def clip(c: Column, low: float, high: float) -> Column:
    """Bound ``c``; null stays null."""
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(low)), F.lit(high)))


def integral(c: Column) -> Column:
    return (c % 1) == 0


def n_if(condition: Column) -> Column:
    """How many rows meet ``condition``."""
    return F.count(F.when(condition, 1))


def thousands(c: Column) -> Column:
    return F.format_number(c.cast("long"), 0)


def percent1(c: Column) -> Column:
    return F.format_string("%.1f", c.cast("double"))


def money(currency: Column, c: Column) -> Column:
    """``NGN 1,234``: currency code and the amount rounded half-even to a whole number."""
    return F.concat_ws(" ", currency, F.format_number(F.bround(c, 0).cast("decimal(38,0)"), 0))


def fill(template: str, **parts: Column) -> Column:
    """Put column values in the ``{name}`` slots of a fixed text."""
    pieces: list[Column] = []
    rest = template
    while "{" in rest:
        head, tail = rest.split("{", 1)
        name, rest = tail.split("}", 1)
        if head:
            pieces.append(F.lit(head))
        pieces.append(parts[name].cast("string"))
    if rest:
        pieces.append(F.lit(rest))
    return F.concat(*pieces)


def band(c: Column) -> Column:
    """Risk level of a 0-100 score: cut points 0, 35, 65, 100, right-closed, lowest included."""
    return (
        F.when((c >= 0) & (c <= 35), "Low")
        .when((c > 35) & (c <= 65), "Medium")
        .when((c > 65) & (c <= 100), "High")
    )


def normalized_header(c: Column) -> Column:
    """snake_case header; ``unnamed`` when nothing is left."""
    lowered = F.lower(txt(c))
    name = F.regexp_replace(F.regexp_replace(lowered, "[^0-9a-z]+", "_"), "^_+|_+$", "")
    return F.when(name == "", "unnamed").otherwise(name)
