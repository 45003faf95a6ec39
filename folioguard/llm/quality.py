"""Quality rules on two levels: a document's own counts, and the record of the host it comes from.

Everything is DataFrame expressions. A document's counts come from arrays inside its row, so its text is read once and
never shuffled. The counts, a few numbers a row, are written to the shared folder; failures are then summed by host
(partial sums before the shuffle, so a host with a third of all rows costs no task more), each host's failure rate is
shrunk towards all hosts by a beta prior fitted to the hosts' rates by moments, and the verdicts are joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioguard.session import materialize

WORD_GAP = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 3
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_SYMBOL_PERCENT = 10
MAX_DUP_LINE_PERCENT = 30
MAX_HOST_RATE = 0.5
LEAST_STRENGTH = 2.0
MOST_STRENGTH = 1000.0

RULES = ("too_few_words", "repeated_words", "symbols", "repeated_lines")


def _packed_windows() -> Column:
    """Each window's hash with its place in the low ``__bits`` bits, sorted: equal windows are neighbours."""
    return F.expr(
        f"sort_array(transform(slice(__words, 1, n_words - {WINDOW - 1}), (w, i) -> "
        "shiftleft(xxhash64(w, __words[i + 1], __words[i + 2]), __bits) | cast(i as bigint)))")


def _repeated_places() -> Column:
    """The places of windows that equal a neighbour, in order."""
    return F.expr(
        "sort_array(transform(filter(__packed, (x, i) -> "
        "shiftright(x, __bits) = shiftright(get(__packed, i - 1), __bits) or "
        "shiftright(x, __bits) = shiftright(get(__packed, i + 1), __bits)), x -> x & __low))")


def _covered_words() -> Column:
    """Words under those windows: three for each, less where it overlaps the one before."""
    return F.expr(
        f"aggregate(__repeated, named_struct('last', -{WINDOW}L, 'n', 0L), (s, x) -> "
        f"named_struct('last', x, 'n', s.n + least(x - s.last, {WINDOW}L)), s -> s.n)")


def document_measures(docs: DataFrame, host: Column) -> DataFrame:
    """doc_id, host and the counts of every text: n_words, word_chars, n_symbols, n_lines, n_dup_lines,
    n_repeat_words.

    A null or empty text has zero in each. Repeated rows and null ids stay as they are.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(F.col("__text"), "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    bits = F.ceil(F.log2(F.col("n_words") + 1)).cast("int")
    return (
        docs.select("doc_id", host.cast("string").alias("host"), text.alias("__text"))
        .select(
            "doc_id", "host",
            F.array_remove(F.split("__text", WORD_GAP, -1), "").alias("__words"),
            F.regexp_count("__text", F.lit(SYMBOLS)).cast("bigint").alias("n_symbols"),
            lines.alias("__lines"))
        .select("*", F.size("__words").alias("n_words"),
                F.length(F.array_join("__words", "")).cast("bigint").alias("word_chars"))
        .select("*", bits.alias("__bits"))
        .select("*", F.expr("shiftleft(1L, __bits) - 1").alias("__low"),
                F.when(F.col("n_words") >= WINDOW, _packed_windows()).alias("__packed"))
        .select("*", _repeated_places().alias("__repeated"))
        .select(
            "doc_id", "host", F.col("n_words").cast("bigint").alias("n_words"), "word_chars", "n_symbols",
            F.size("__lines").cast("bigint").alias("n_lines"),
            (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("bigint").alias("n_dup_lines"),
            F.coalesce(_covered_words(), F.lit(0)).cast("bigint").alias("n_repeat_words"))
    )


def rule_failures() -> dict[str, Column]:
    """Each rule over the counts; true where a document fails it."""
    return {
        "too_few_words": F.col("n_words") < MIN_WORDS,
        "repeated_words": 100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"),
        "symbols": 100 * F.col("n_symbols") > MAX_SYMBOL_PERCENT * F.col("word_chars"),
        "repeated_lines": 100 * F.col("n_dup_lines") > MAX_DUP_LINE_PERCENT * F.col("n_lines"),
    }


def host_verdicts(measures: DataFrame, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """host, rule, n_docs, n_failed, rate, shrunk_rate and rejected, a row for each host and rule.

    The prior of a rule is a beta distribution with the mean and variance of its hosts' rates; its strength stays
    between ``LEAST_STRENGTH`` and ``MOST_STRENGTH`` documents, the latter also where all hosts have one rate.
    Documents without a host get no verdict. Rows of an empty table give none.
    """
    failures = rule_failures()
    hosts = measures.where(F.col("host").isNotNull()).groupBy("host").agg(
        F.count(F.lit(1)).alias("n_docs"),
        *[F.sum(failed.cast("bigint")).alias(rule) for rule, failed in failures.items()])
    long = hosts.unpivot(["host", "n_docs"], list(failures), "rule", "n_failed").withColumn(
        "rate", F.col("n_failed") / F.col("n_docs"))
    mean, spread = F.col("mean"), F.col("spread")
    strength = F.when(spread > 0, mean * (1 - mean) / spread - 1).otherwise(MOST_STRENGTH)
    prior = long.groupBy("rule").agg(F.avg("rate").alias("mean"), F.var_pop("rate").alias("spread")).select(
        "rule", "mean", F.least(F.greatest(strength, F.lit(LEAST_STRENGTH)), F.lit(MOST_STRENGTH)).alias("strength"))
    shrunk = (F.col("n_failed") + F.col("mean") * F.col("strength")) / (F.col("n_docs") + F.col("strength"))
    return long.join(prior, "rule").select(
        "host", "rule", "n_docs", "n_failed", "rate", shrunk.alias("shrunk_rate"),
        (shrunk > max_rate).alias("rejected"))


def judge_documents(docs: DataFrame, host: Column | None = None, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """The counts of every document with base_failed, host_rejected (on any rule) and kept.

    ``host`` is ``source`` unless given. A document without a host is judged by its own counts alone.
    """
    host = F.col("source") if host is None else host
    measures = materialize(document_measures(docs, host), "quality")
    rejected = materialize(  # a table, so that its size is known when the join is planned
        host_verdicts(measures, max_rate).where("rejected").select(F.col("host").alias("__host")).distinct(), "hosts")
    failures = rule_failures()
    joined = measures.join(rejected, F.col("host") == F.col("__host"), "left")
    return joined.select(
        "doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (failures["too_few_words"] | failures["repeated_words"]).alias("base_failed"),
        F.col("__host").isNotNull().alias("host_rejected"),
    ).withColumn("kept", ~F.col("base_failed") & ~F.col("host_rejected"))


ORACLE = r"""
WITH d AS (SELECT doc_id, source AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, host, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
p AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i], ws[i + 1], ws[i + 2]) AS n FROM p),
c AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words
    FROM g, (SELECT unnest([0, 1, 2]) AS k) WHERE n >= 2 GROUP BY doc_id),
m AS (SELECT w.doc_id, host, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, len(ls) AS n_lines,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
    FROM w LEFT JOIN c USING (doc_id)),
f AS (SELECT host, count(*) AS n, unnest([1, 2, 3, 4]) AS rule, unnest([
    sum((n_words < 50)::INT), sum((100 * n_repeat_words > 50 * n_words)::INT),
    sum((100 * n_symbols > 10 * word_chars)::INT), sum((100 * n_dup_lines > 30 * n_lines)::INT)]) AS bad
    FROM m WHERE host IS NOT NULL GROUP BY host),
q AS (SELECT rule, avg(bad / n) AS mu, var_pop(bad / n) AS v FROM f GROUP BY rule),
s AS (SELECT rule, mu, least(greatest(CASE WHEN v > 0 THEN mu * (1 - mu) / v - 1 ELSE 1000 END, 2), 1000) AS k FROM q),
r AS (SELECT DISTINCT host FROM f JOIN s USING (rule) WHERE (bad + mu * k) / (n + k) > 0.5)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
    NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND r.host IS NULL AS kept
FROM m LEFT JOIN r ON m.host = r.host
"""
