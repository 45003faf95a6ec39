from __future__ import annotations

import pytest

from folioguard.llm import decontamination as dc

ITEM = ("On Monday Alice buys 5 apples and gives 2 of them to Bob, who then walks 3 km home. Alice eats one apple. "
        "How many apples does Alice have left?")
CHANGED = ("On Friday Carol buys 9 apples and gives 4 of them to Dave, who then walks 7 miles home. Carol eats one apple. "
           "How many apples does Carol have left?")
MIXED = ("On Friday Carol buys 9 apples and gives 4 of them to Dave, who then walks 7 miles home. Erin eats one apple. "
         "How many apples does Frank have left? Grace and Heidi do not know what Ivan may have left.")
CLEAN = "Nothing to see here at all, my dear friend, so please move along now and do not look back."


@pytest.fixture
def benchmark(spark):
    return spark.createDataFrame(
        [(1, ITEM), (1, ITEM), (2, "the quick brown fox jumped"), (3, None), (4, ""), (5, "1 2 3 4 5 6 7 8 9 10")],
        "item_id long, text string")


def found(spark, benchmark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return {(r["doc_id"], r["item_id"]): r for r in dc.matches(docs, benchmark, ["doc_id"]).collect()}


def test_verbatim_changed_and_clean(spark, benchmark):
    got = found(spark, benchmark, [
        (1, "Intro here. " + CHANGED + " Bye."), (2, ITEM), (4, CLEAN), (5, None), (6, ""),
        (7, "Yes, the quick brown fox, jumped over"), (8, "11 12 13 14 15 16 17 18 19 20"), (2, ITEM)])
    assert set(got) == {(1, 1), (2, 1), (7, 2)}
    assert got[2, 1]["share"] == 1 and got[2, 1]["n_replaced"] == 0
    assert got[1, 1]["share"] == 1 and got[1, 1]["n_replaced"] > 3


def test_slots_must_be_replaced_alike(spark):
    item = "Alice met Bob and Alice saw Bob while Alice and Bob ran past Alice and past Bob again"
    benchmark = spark.createDataFrame([(1, "so " + item)], "item_id long, text string")
    alike = item.replace("Alice", "Carol").replace("Bob", "Dave")
    names = iter("Carol Dave Erin Frank Grace Heidi Ivan Judy".split())
    apart = " ".join(next(names) if w in ("Alice", "Bob") else w for w in item.split())
    got = found(spark, benchmark, [(1, "so " + alike), (2, "so " + apart)])
    assert set(got) == {(1, 1)}


def test_a_changed_and_a_verbatim_copy_in_one_text(spark, benchmark):
    got = found(spark, benchmark, [(1, ITEM + " In between there are some words. " + CHANGED)])
    assert got[1, 1]["share"] == 1 and got[1, 1]["n_replaced"] == 0


def test_half_an_item_is_enough_and_less_is_not(spark, benchmark):
    words = ITEM.split()
    got = found(spark, benchmark, [(1, " ".join(words[:22])), (2, " ".join(words[:12]))])
    assert set(got) == {(1, 1)}


def test_a_join_without_broadcast_finds_the_same(spark, benchmark, monkeypatch):
    rows = [(1, CHANGED), (2, CLEAN), (3, "the quick brown fox jumped")]
    expected = found(spark, benchmark, rows)
    monkeypatch.setattr(dc, "BROADCAST_WINDOWS", 0)
    assert found(spark, benchmark, rows) == expected and set(expected) == {(1, 1), (3, 2)}


def test_clean_rows_are_kept_as_they_are(spark, odd_docs, no_docs, benchmark):
    kept = dc.keep_clean(odd_docs, benchmark)
    assert kept.columns == odd_docs.columns and kept.count() == odd_docs.count()
    extra = odd_docs.limit(1).selectExpr(*[f"'{ITEM.replace(chr(39), '')}' as text" if c == "text" else "null as doc_id"
                                           if c == "doc_id" else c for c in odd_docs.columns])
    assert dc.keep_clean(odd_docs.union(extra), benchmark).count() == odd_docs.count()
    assert dc.keep_clean(no_docs, benchmark).count() == 0
    assert dc.keep_clean(odd_docs, benchmark.limit(0)).count() == odd_docs.count()
