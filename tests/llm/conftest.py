from __future__ import annotations

import pytest

# Extra columns bear names that operators use inside.
ODD = ("doc_id long, text string, lang string, source string, n_chars long, score double, fp long, rank long, "
       "word string, kept string, key string, h long, size int, host string")


@pytest.fixture
def odd_docs(spark):
    """Nulls in any column, empty, blank and very long texts, ties, repeated rows, clashing column names."""

    def row(doc_id, text, lang="en", source="src0"):
        return (doc_id, text, lang, source, 0, 0.5, 1, 2, "w", "k", "x", 3, 4, "h")

    long_text = " ".join(f"word{i % 977} thing{i % 31}" for i in range(30_000))
    rows = [
        row(1, "The first text has a few plain words in it. And a second line.\nThird."), row(2, None), row(3, ""),
        row(4, " \t\n "), row(5, long_text), row(6, "x" * 100_000), row(None, "A text without an id."),
        row(None, None, None, None), row(7, "été ñandú größer 日本語 🙂 \x00 İΣ", "fr", None), row(8, "7 8 9 !!! ###"),
        row(1, "The first text has a few plain words in it. And a second line.\nThird."),
        row(9, "A text without an id.", None), row(2**60 + 1, "A large id"), row(10, "<|endoftext|> special"),
    ]
    return spark.createDataFrame(rows, ODD)


@pytest.fixture
def no_docs(spark):
    return spark.createDataFrame([], ODD)


@pytest.fixture
def tables(spark, tmp_path):
    """Write tables as a data folder and give its path."""

    def write(**frames):
        for name, df in frames.items():
            df.write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write
