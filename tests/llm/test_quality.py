from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from folioguard.llm import quality


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


def counts(docs):
    got = quality.judge_documents(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()
    return sorted((str(r[0]), *r[1:]) for r in got)


def test_counts_against_plain_python(spark):
    rnd = random.Random(3)
    rows = [(i, "".join(rnd.choice(["a", "b", "b", " ", " ", "\n", "\t", "#", "é", "\x0b", "<"])
                        for _ in range(rnd.randint(0, 120)))) for i in range(150)]
    docs = spark.createDataFrame([(i, t, "h") for i, t in rows], "doc_id long, text string, source string")
    assert counts(docs) == sorted((str(i), *plain(t)) for i, t in rows)


def test_odd_rows(odd_docs, no_docs):
    small = odd_docs.where("text is null or length(text) < 1000")
    assert counts(small) == sorted((str(r["doc_id"]), *plain(r["text"])) for r in small.collect())
    assert quality.judge_documents(odd_docs).count() == odd_docs.count()
    assert quality.judge_documents(no_docs).count() == 0


def test_hosts_are_judged_by_shrunk_rates(spark):
    good = " ".join(f"word{i}" for i in range(60))
    rows = [(i, "short text" if i % 10 == 0 else good, f"h{i % 20}") for i in range(1, 2_000)]
    rows += [(5_000 + i, "short text" if i < 95 else good, "bad") for i in range(100)]
    rows += [(9_000, "short text", "new"), (9_001, good, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in quality.judge_documents(docs).collect()}
    assert not got[5_099]["kept"] and got[5_099]["host_rejected"] and not got[5_099]["base_failed"]
    assert not got[9_000]["host_rejected"]  # one failed document says little about a host
    assert got[9_001]["kept"] and got[1]["kept"]
    verdicts = quality.host_verdicts(quality.document_measures(docs, F.col("source")))
    rates = {r["host"]: r for r in verdicts.where("rule = 'too_few_words'").collect()}
    assert rates["new"]["rate"] == 1 and rates["new"]["shrunk_rate"] < 0.5 < rates["bad"]["shrunk_rate"] < rates["bad"]["rate"]


def test_another_host_column(spark):
    docs = spark.createDataFrame([(1, "x", "https://a.example/p"), (2, "y", "https://b.example/")],
                                 "doc_id long, text string, url string")
    got = quality.judge_documents(docs, F.expr("parse_url(url, 'HOST')")).collect()
    assert {r["host"] for r in got} == {"a.example", "b.example"}


@pytest.mark.parametrize("native", ["BatchEvalPython", "ArrowEvalPython", "MapInPandas", "MapInArrow", "PythonMapInArrow"])
def test_no_python_in_the_plan(spark, sf_dir, native):
    df = quality.document_measures(spark.read.parquet(f"{sf_dir}/documents.parquet"), F.col("source"))
    assert native not in df._jdf.queryExecution().toString()
