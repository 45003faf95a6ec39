from __future__ import annotations

import random

import corpus_pipeline as cp
import pytest
from tests.llm.test_decontamination import CHANGED, ITEM

from folioguard.llm import queries
from tools.check_twins import compare, connect


@pytest.fixture
def corpus(spark, tables):
    rnd = random.Random(8)
    words = {"en": "the house of river stone light under many old trees and walks".split(),
             "de": "der fluss und das haus unter vielen alten bäumen licht stein geht".split()}

    def text(lang, n):
        return " ".join(rnd.choice(words[lang]) + rnd.choice(["", "", "", str(rnd.randrange(99))]) for _ in range(n))

    rows = [(i, text(lang, rnd.randint(40, 120)), lang, "src0", 7, 0.5) for i, lang in enumerate(["en", "de"] * 20)]
    passage = text("en", 150)
    rows += [(100, rows[0][1], "en", "src1", 7, 0.5), (101, rows[2][1] + " one", "en", "src1", 7, 0.5),
             (102, "12 34 !!!", "en", "src1", 7, 0.5), (103, None, None, None, None, None), (104, "", "en", "s", 0, 0.5),
             (105, text("en", 50) + passage + text("en", 50), "en", "s", 7, 0.5),
             (106, text("en", 50) + passage + text("en", 60), "en", "s", 7, 0.5),
             (107, text("en", 40) + ". " + ITEM, "en", "s", 7, 0.5), (108, text("en", 40) + ". " + CHANGED, "en", "s", 7, 0.5),
             (None, text("de", 60), "de", "s", 7, 0.5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double")
    return tables(documents=docs, benchmark=spark.createDataFrame([(1, ITEM)], "item_id long, text string")), rows, passage


def test_each_stage_takes_effect_and_keeps_the_columns(spark, corpus):
    folder, rows, passage = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    seen = {}
    for name, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == columns
        seen[name] = {r["doc_id"]: r for r in docs.collect()}
        docs = spark.createDataFrame(list(seen[name].values()), docs.schema)
    assert {102, 103, 104}.isdisjoint(seen["language"]) and len(seen["language"]) == len(rows) - 3
    assert 100 not in seen["simhash"] and 0 in seen["simhash"]
    kept = seen["repeats"]
    assert passage[50:-50] not in kept[105]["text"] and kept[105]["n_chars"] == len(kept[105]["text"])
    assert kept[105]["text"][:40] == rows[[r[0] for r in rows].index(105)][1][:40]
    assert {107, 108}.isdisjoint(seen["decontamination"])
    assert set(seen["decontamination"]) == set(kept) - {107, 108}


def test_passages_of_over_fifty_short_words_go(spark, tables):
    """Planted passages of 51 to 60 words are cut out wherever they are met; shorter ones and other text stay."""
    rnd = random.Random(31)

    def words(n, letters="abcdefgh"):
        return " ".join("".join(rnd.choice(letters) for _ in range(rnd.randrange(2, 6))) for _ in range(n))

    passages = [words(n) for n in (51, 52, 55, 60) for _ in range(6)]
    short = [words(n) for n in (30, 45) for _ in range(4)]
    rows, own = [], {}
    for i, passage in enumerate(passages + short):
        for copy in range(2 + i % 3):
            before, after = words(60, "rstuvwxyz"), words(60, "ijklmnopq")
            own[len(rows)] = (before, passage if i >= len(passages) else None, after)
            rows.append((len(rows), f"{before} {passage}\n{after}", "en", "s", 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = {r["doc_id"]: r["text"] for r in cp.strip_repeated_passages(spark, docs, "").collect()}
    for i, (before, kept, after) in own.items():
        # A stretch may take the end of a neighbouring word along, where the copies' letters happen to agree.
        left = out[i].split()
        assert left[:58] == before.split()[:58] and left[-58:] == after.split()[-58:]
        assert len(left) <= 122 if kept is None else left == rows[i][1].split()


def test_the_whole_run(spark, corpus):
    folder, *_ = corpus
    got = cp.run(spark, folder)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and got.count() > 30


def test_an_empty_corpus(spark, tables):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    folder = tables(documents=docs, benchmark=spark.createDataFrame([], "item_id long, text string"))
    assert cp.run(spark, folder).count() == 0


def test_names_of_the_queries():
    numbers = sorted(int(name[2:].split("_")[0]) for name in queries.QUERIES)
    assert numbers == list(range(1, 14))
    assert set(queries.ORACLES) <= set(queries.QUERIES)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_twins(spark, sf_dir, name):
    assert compare(queries.QUERIES[name](spark, sf_dir), connect(sf_dir), queries.ORACLES[name]) is None
