"""Benchmark decontamination by template: texts are compared after numbers, names and units became typed placeholders.

Everything is DataFrame expressions. A text's words are trimmed of punctuation and lower-cased; a number, a unit of
measure and a name (capitalised inside a sentence, or a sentence's first word that is capitalised inside one elsewhere
in the text) become a placeholder that keeps its value aside. Windows of ``WINDOW`` words are hashed and joined with the
benchmark's windows, at first as bare hashes; the documents this touches are read again with their slots. Windows that lie on one diagonal (place in the document less place in the item) are one
occurrence, and its slots must be consistent: a value of the item is replaced by one value throughout, with at most one
further replacement for every four values (two equal numbers of an item may be changed apart). A document is
contaminated by an item if consistent occurrences cover at least ``MIN_SHARE`` of the item's windows.

The benchmark is the small side. It is broadcast if its windows are counted to be few; else the join shuffles.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioguard.session import materialize

WINDOW = 8
MIN_LITERALS = 4
MIN_SHARE = 0.5
BROADCAST_WINDOWS = 1_000_000

WORD_GAP = r"[\x20\x09-\x0D]+"
TRIMMED = ".,;:!?\"'()[]{}«»“”‘’…*_|"
SENTENCE_ENDS = ".!?:"
NUMBER = r"^[+-]?[$€£]?[0-9][0-9.,:/-]*%?$"
NAME = r"^\p{Lu}\p{Ll}+$"
UNITS = (
    "mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams kilogram kilograms ounce ounces pound "
    "pounds ton tons ml l liter liters litre litres gallon gallons second seconds minute minutes hour hours day days "
    "week weeks month months year years dollar dollars euro euros cent cents percent degree degrees watt watts volt "
    "volts meter meters metre metres kilometer kilometers kilometre kilometres mph kmh"
).split()


def _quoted(values: Sequence[str]) -> str:
    return ", ".join("'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'" for v in values)


def _tokens(rows: DataFrame, key: Sequence[str], text: str) -> DataFrame:
    """``key``, __slots (word by word the kind and value behind a placeholder, null for a literal word), __marks (hashes
    of words, or of placeholders' kinds) and __eight (hashes of eight words from each on)."""
    words = rows.select(*[F.col(f"`{c}`") for c in key], F.array_remove(
        F.split(F.coalesce(F.col(f"`{text}`"), F.lit("")), WORD_GAP, -1), "").alias("__words"))
    trim, ends, name = _quoted([TRIMMED]), _quoted(list(SENTENCE_ENDS)), _quoted([NAME])
    inner_names = (
        "array_distinct(filter(transform(filter(__words, (w, i) -> not (ascii(w) between 97 and 122) and i > 0 "
        f"and not right(get(__words, i - 1), 1) in ({ends}) and w != lower(w)), w -> btrim(w, {trim})), "
        f"w -> w rlike {name}))")
    bare = words.select(*key, F.expr(inner_names).alias("__names"), F.expr(
        f"filter(transform(__words, w -> btrim(w, {trim})), w -> w != '')").alias("__bare"))
    lowered = bare.select("*", F.expr("transform(__bare, w -> lower(w))").alias("__lower"))

    def slots(is_name: str) -> str:
        return ("zip_with(__bare, __lower, (w, l) -> case "
                f"when (ascii(w) < 65 or ascii(w) in (163, 8364)) and w rlike {_quoted([NUMBER])} then concat('n ', w) "
                f"when l in ({_quoted(UNITS)}) then concat('u ', l) {is_name} end)")

    # a column that only a lambda uses would be computed anew for each element: it is also asked for outside
    with_names = "when w != l and array_contains(__names, w) then concat('N ', w)"
    slotted = lowered.select("*", F.expr(
        f"if(size(__names) = 0, {slots('')}, {slots(with_names)})").alias("__slots"))
    marks = ("if(exists(__slots, s -> s is not null), zip_with(__lower, __slots, (l, s) -> "
             "xxhash64(if(s is null, l, concat('\u0001', left(s, 1))))), transform(__lower, l -> xxhash64(l)))")
    marked = slotted.select(*key, "__slots", F.expr(marks).alias("__marks"))
    # hashes of 2, 4 and 8 words, each from two of half the length
    pairs = "zip_with({0}, slice({0}, {1}, greatest(size({0}) - {2}, 0)), (a, b) -> xxhash64(a, b))"
    return marked.select("*", F.expr(pairs.format("__marks", 2, 1)).alias("__two")).select(
        "*", F.expr(pairs.format("__two", 3, 2)).alias("__four")).select(
        *key, "__slots", "__marks", F.expr(pairs.format("__four", 5, 4)).alias("__eight"))


def _hashes(size: int) -> str:
    """Array of the hashes of all windows of ``size`` words, null where the text is shorter."""
    if size == 8:
        return "if(size(__marks) < 8, null, slice(__eight, 1, size(__marks) - 7))"
    return (f"if(size(__marks) < {size}, null, transform(sequence(0, size(__marks) - {size}), "
            f"i -> xxhash64(slice(__marks, i + 1, {size}))))")


def window_hashes(rows: DataFrame, key: Sequence[str], text: str, sizes: Sequence[int]) -> DataFrame:
    """``key`` and h of every window of ``sizes`` words."""
    none = F.expr("cast(array() as array<bigint>)")
    hashes = [F.coalesce(F.expr(_hashes(n)), none) for n in sizes]
    return _tokens(rows, key, text).select(*key, F.explode(F.concat(*hashes)).alias("h"))


def windows(rows: DataFrame, key: Sequence[str], text: str, sizes: Sequence[int]) -> DataFrame:
    """``key``, size, place, h and slots of every window of ``sizes`` words with enough literal words.

    ``slots`` has the window's part of the text's slots; it is null where the window has none. Null and empty texts
    have no windows, nor have texts shorter than a window.
    """
    none = F.expr("filter(array(named_struct('size', 0, 'place', 0, 'h', 0L, 'slots', array(''))), x -> false)")

    def of(size: int) -> Column:
        own = f"slice(__slots, i + 1, {size})"
        return F.coalesce(F.expr(
            f"transform({_hashes(size)}, (h, i) -> named_struct('size', {size}, 'place', i, 'h', h, "
            f"'slots', if(exists({own}, s -> s is not null), {own}, null)))"), none)

    out = _tokens(rows, key, text).select(*key, F.explode(F.concat(*[of(n) for n in sizes])).alias("__w")).select(
        *key, "__w.*")
    literals = F.col("size") - F.coalesce(F.size(F.filter("slots", lambda s: s.isNotNull())), F.lit(0))
    return out.where(F.col("slots").isNull() | (literals >= F.least(F.lit(MIN_LITERALS), F.col("size"))))


def matches(docs: DataFrame, benchmark: DataFrame, key: Sequence[str], min_share: float = MIN_SHARE) -> DataFrame:
    """``key``, item_id, n_windows (of the item), n_matched, share and n_replaced (slot values that differ from the
    item's) for every document and item that contaminates it. ``benchmark`` has item_id and text.

    Items shorter than a window are looked for by a window of their own length; those with fewer than
    ``MIN_LITERALS`` literal words in every window say too little and contaminate nothing. Repeated items are one.
    """
    items = benchmark.select("item_id", "text").distinct()
    length = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), WORD_GAP, -1), lambda w: F.btrim(
        w, F.lit(TRIMMED)) != ""))
    lengths = items.select(length.alias("n")).where((F.col("n") >= MIN_LITERALS) & (F.col("n") < WINDOW)).distinct()
    short = sorted(r["n"] for r in lengths.collect())  # at most WINDOW values
    sizes = [*short, WINDOW]
    item_windows = windows(items.select("item_id", "text", length.alias("n")), ["item_id", "n"], "text", sizes).where(
        F.col("size") == F.least(F.col("n"), F.lit(WINDOW))).select(
        "item_id", F.col("size").alias("item_size"), F.col("place").alias("item_place"), F.col("h").alias("item_h"),
        F.col("slots").alias("item_slots")).distinct()
    item_windows = materialize(item_windows, "item-windows")
    totals = item_windows.groupBy("item_id").agg(F.count_distinct("item_place").alias("n_windows"))
    few = item_windows.count() <= BROADCAST_WINDOWS
    side = F.broadcast if few else (lambda windows: windows)
    touched = materialize(window_hashes(docs, key, "text", sizes).join(
        side(item_windows.select("item_h").distinct()), F.col("h") == F.col("item_h"), "left_semi").select(
        *[F.col(c).alias(f"__of_{c}") for c in key]).distinct(), "touched")
    again = docs.join(touched, [F.col(c).eqNullSafe(F.col(f"__of_{c}")) for c in key], "left_semi")
    found = windows(again, key, "text", sizes).join(
        side(item_windows), (F.col("h") == F.col("item_h")) & (F.col("size") == F.col("item_size")))
    found = found.select(*key, "item_id", "item_place", "place", F.when(F.col("slots").isNotNull(), F.filter(
        F.arrays_zip("item_slots", "slots"), lambda z: z["slots"].isNotNull())).alias("replaced"))
    occurrences = found.groupBy(*key, "item_id", (F.col("place") - F.col("item_place")).alias("diagonal")).agg(
        F.collect_set("item_place").alias("places"), F.array_distinct(F.flatten(F.collect_set("replaced"))).alias("map"))
    values = F.size(F.array_distinct(F.transform("map", lambda m: m["item_slots"])))
    consistent = occurrences.where(4 * (F.size("map") - values) <= values)
    pairs = consistent.groupBy(*key, "item_id").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("places")))).cast("bigint").alias("n_matched"),
        F.min(F.size(F.filter("map", lambda m: m["item_slots"] != m["slots"]))).cast("bigint").alias("n_replaced"))
    share = F.col("n_matched") / F.col("n_windows")
    return pairs.join(totals, "item_id").where(share >= min_share).select(
        *key, "item_id", "n_windows", "n_matched", share.alias("share"), "n_replaced")


def keep_clean(docs: DataFrame, benchmark: DataFrame, min_share: float = MIN_SHARE) -> DataFrame:
    """Rows of ``docs`` (doc_id, text and any others) that no item contaminates; null ids and repeats are kept as they
    are. An empty benchmark keeps everything."""
    marked = docs.select("doc_id", F.xxhash64("text").alias("__mark"), "text")
    bad = materialize(matches(marked, benchmark, ["doc_id", "__mark"], min_share).select(
        F.col("doc_id").alias("__id"), F.col("__mark").alias("__text")).distinct(), "contaminated")
    return docs.join(bad, docs["doc_id"].eqNullSafe(F.col("__id")) & (F.xxhash64(docs["text"]) == F.col("__text")),
                     "left_anti")


# The twin knows windows of full length only; no item of the given tables is shorter.
ORACLE = rf"""
WITH src AS (SELECT 'd' AS side, doc_id AS id, coalesce(text, '') AS t FROM documents
    UNION ALL SELECT 'b', item_id, coalesce(text, '') FROM (SELECT DISTINCT item_id, text FROM benchmark)),
w AS (SELECT side, id, list_filter(string_split_regex(t, '{WORD_GAP}'), lambda x: x <> '') AS ws FROM src),
p AS (SELECT side, id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
u AS (SELECT side, id, i, trim(ws[i], '{TRIMMED.replace("'", "''")}') AS b, lower(b) AS l,
    i > 1 AND right(ws[i - 1], 1) NOT IN ('.', '!', '?', ':') AS inside FROM p),
n AS (SELECT DISTINCT side, id, b FROM u WHERE b <> l AND inside AND regexp_matches(b, '{NAME}')),
s AS (SELECT side, id, i, l, CASE WHEN regexp_matches(b, '{NUMBER}') THEN 'n ' || b
    WHEN l IN ({_quoted(UNITS)}) THEN 'u ' || l WHEN n.id IS NOT NULL THEN 'N ' || b END AS slot
    FROM u LEFT JOIN n USING (side, id, b) WHERE b <> ''),
r AS (SELECT side, id, i, list(coalesce(chr(1) || left(slot, 1), l)) OVER k AS marks, list(slot) OVER k AS slots,
    count(slot) OVER k AS n_slots FROM s
    WINDOW k AS (PARTITION BY side, id ORDER BY i ROWS BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING)),
win AS (SELECT * FROM r WHERE len(marks) = {WINDOW} AND {WINDOW} - n_slots >= {MIN_LITERALS}),
j AS (SELECT d.id AS doc_id, b.id AS item_id, d.i - b.i AS diagonal, b.i AS item_place, b.slots AS bs, d.slots AS ds
    FROM win d JOIN win b ON d.marks = b.marks WHERE d.side = 'd' AND b.side = 'b'),
m AS (SELECT DISTINCT * FROM (SELECT doc_id, item_id, diagonal, unnest(bs) AS x, unnest(ds) AS y FROM j)
    WHERE x IS NOT NULL),
o AS (SELECT doc_id, item_id, diagonal, count(*) AS n_map, count(DISTINCT x) AS n_val, sum((x <> y)::INT) AS n_rep
    FROM m GROUP BY ALL),
g AS (SELECT j.doc_id, j.item_id, item_place, coalesce(n_rep, 0) AS n_rep FROM j
    LEFT JOIN o ON j.doc_id = o.doc_id AND j.item_id = o.item_id AND j.diagonal = o.diagonal
    WHERE 4 * (coalesce(n_map, 0) - coalesce(n_val, 0)) <= coalesce(n_val, 0)),
c AS (SELECT doc_id, item_id, count(DISTINCT item_place) AS n_matched, min(n_rep)::BIGINT AS n_replaced
    FROM g GROUP BY ALL),
z AS (SELECT id AS item_id, count(DISTINCT i) AS n_windows FROM win WHERE side = 'b' GROUP BY id)
SELECT doc_id, item_id, n_windows, n_matched, n_matched / n_windows AS share, n_replaced
FROM c JOIN z USING (item_id) WHERE n_matched / n_windows >= {MIN_SHARE}
"""
