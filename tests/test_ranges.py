"""CSV in byte ranges against a plain reader, with quotes and line ends at every place of a range."""

from __future__ import annotations

import csv
import hashlib
import io
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from folioguard.fixed_values import DELIMITERS
from folioguard.sources import csv as C
from folioguard.sources import intake as I
from folioguard.sources import ranges as R


def plain_records(text: str) -> list[str]:
    """Records by the quoting state, blank ones apart."""
    out, at, inside, i = [], 0, False, 0
    while i < len(text):
        c = text[i]
        if c == '"':
            inside = not inside
        elif c in "\r\n" and not inside:
            end = i
            if c == "\r" and text[i + 1 : i + 2] == "\n":
                i += 1
            if end > at:
                out.append(text[at:end])
            at = i + 1
        i += 1
    if at < len(text):
        out.append(text[at:])
    return out


def cells(record: str, mark: str) -> int:
    inside, n = False, 1
    for c in record:
        inside ^= c == '"'
        n += c == mark and not inside
    return n


def as_lines(text: str) -> bytes:
    raw = text.encode()
    return raw if raw.endswith(b"\n") else raw + b"\n"


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(alphabet='a,;"\r', max_size=6), min_size=1, max_size=8), st.integers(1, 4))
def test_maps_compose_to_the_whole(lines, per_range):
    text = "\n".join(lines) + "\n"
    state = R.EMPTY
    for i in range(0, len(lines), per_range):
        part = "\n".join(lines[i : i + per_range]) + "\n"
        state = R.compose(state, R.measure(np.frombuffer(part.encode(), dtype=np.uint8), i))
    found = plain_records(text)
    whole = state[0]
    assert whole.end == text.count('"') % 2
    closed = found[:-1] if whole.end else found
    assert whole.n == len(closed)
    if closed:
        assert whole.widest.tolist() == [max(cells(r, d) for r in closed) for d in DELIMITERS]
    if found:
        assert whole.first.decode().rstrip("\r\n") == found[0].rstrip("\r\n")
    one = R.measure(np.frombuffer(text.encode(), dtype=np.uint8), 0)
    assert [(s.end, s.closed, s.n, s.widest.tolist(), s.head.tolist(), s.tail.tolist(), s.first) for s in one] == [
        (s.end, s.closed, s.n, s.widest.tolist(), s.head.tolist(), s.tail.tolist(), s.first) for s in state]


@pytest.mark.parametrize("range_bytes", [5, 40, 1 << 20])
def test_records_of_any_range_size(spark, tmp_path, monkeypatch, range_bytes):
    monkeypatch.setattr(R, "GROUP_RANGES", 3)
    rnd = random.Random(range_bytes)
    expected: dict[str, list[str]] = {}
    for n in range(4):
        parts = []
        for _ in range(rnd.randrange(3, 25)):
            cell = rnd.choice(["x", "", '"a,b"', '"q ""in"" q"', '"two\nlines"', '"\n\n"', '"a\r\nb"', "é", '"very ' + "long\n" * 9 + '"'])
            parts.append(f"{cell},{rnd.randrange(99)}" if rnd.random() < 0.8 else cell)
            parts.append(rnd.choice(["\n", "\r\n", "\n\n", "\r"]))
        text = rnd.choice(["", "\n", "\n\n\n\n\n\n\n\n\n"]) + "".join(parts)
        text = text if n % 2 else text.rstrip("\r\n")
        (tmp_path / f"f{n}.csv").write_bytes((b"\xef\xbb\xbf" if n == 2 else b"") + text.encode())
        expected[f"f{n}.csv"] = plain_records(text)
    files = {r["file"]: r["path"].rsplit("/", 1)[1] for r in R.listed_files(spark, str(tmp_path)).collect()}
    got: dict[str, list] = {}
    heads = {}
    for r in R.records(spark, str(tmp_path), range_bytes).collect():
        got.setdefault(files[r["file"]], []).append(r["record"])
        if r["header"]:
            assert files[r["file"]] not in heads
            heads[files[r["file"]]] = r["record"]
    assert {f: sorted(v) for f, v in got.items()} == {f: sorted(x.rstrip("\r\n") for x in v) for f, v in expected.items() if v}
    assert heads == {f: v[0] for f, v in expected.items() if v}


def test_digests_are_of_the_bytes(spark, tmp_path):
    contents = [b"\n", b"a\n", b"a", b"\xef\xbb\xbfa\r\nb", b"\xef\xbb\xbfa\n", b"\xff\x00\n\n", b"a,b\n" * 50_000, b"\r", b"\xef\xbb\xbf\n"]
    for i, c in enumerate(contents):
        (tmp_path / f"f{i}.csv").write_bytes(c)
    files = R.listed_files(spark, str(tmp_path))
    got = {r["path"].rsplit("/", 1)[1]: r["sha256"] for r in files.join(R.file_digests(spark, str(tmp_path)), "file").collect()}
    assert got == {f"f{i}.csv": hashlib.sha256(c).hexdigest() for i, c in enumerate(contents)}


def test_digests_of_several_files_are_made_by_several_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(R, "RANGE_BYTES", 1 << 16)
    contents = [f"{i},b\n".encode() * 50_000 for i in range(4)]
    for i, c in enumerate(contents):
        (tmp_path / f"f{i}.csv").write_bytes(c)
    digests = R.file_digests(spark, str(tmp_path))
    assert len(digests.inputFiles()) == 4
    assert {r["sha256"] for r in digests.collect()} == {hashlib.sha256(c).hexdigest() for c in contents}


def test_split_reading_equals_a_plain_reader(spark, tmp_path):
    rnd = random.Random(4)
    rows = [[str(i), rnd.choice(["", "N/A", " pad ", 'say "hi", twice', "two\nlines", "cr\rhere", "a\r\nb", "ü;|\t"]),
             "x" * rnd.randrange(50)] for i in range(2000)]
    out = io.StringIO()
    writer = csv.writer(out, lineterminator="\r\n")
    writer.writerows([["Row Id", "Some\nNote", "Fill"], *rows])
    (tmp_path / "a.csv").write_bytes(out.getvalue().encode())
    got = C.read_lexical(spark, str(tmp_path), range_bytes=4096)
    assert got.columns == ["row_id", "some_note", "fill"]
    assert got.rdd.getNumPartitions() > 10
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, rows))


def test_large_file_is_audited_in_ranges_like_a_small_one(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(R, "GROUP_RANGES", 4)
    good = "\ufeffid;note;n\r\n" + "".join(f'{i};"a;b\r\nc ""{i}""";{i}\r\n' for i in range(300))
    files = {
        "good.csv": good.encode(), "long.csv": b"id,note\n" + b"1,2\n" * 200 + b"1,2,3\n", "open.csv": b'id,note\n1,"x\n' * 51,
        "nul.csv": b"id,note\n1,\x00\n", "latin.csv": b"id,note\n1,\xff\n", "twice.csv": b"Id,id \n1,2\n", "none.csv": b"",
        "blank.csv": b",x\n1,2\n", "caret.csv": b"a^b\n1^2\n3^4\n", "head.csv": b"id,note\n", "bom.csv": b"\xef\xbb\xbf",
        "text.txt": b"id,note\n1,2\n", "lines.csv": b"\n\n", "wide.csv": (",".join(f"c{i}" for i in range(300)) + "\n" + "," * 299 + "\n").encode(),
    }
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)
    columns = ["file_name", "length", "sha256", "encoding", "delimiter", "column_count", "data_rows", "normalized_headers", "error_code"]
    whole = {r["file_name"]: r for r in I.audit_files(I.read_files(spark, str(tmp_path))).select(columns).collect()}
    split = {r["file_name"]: r for r in I.audit_large_files(spark, str(tmp_path), range_bytes=64).select(columns).collect()}
    assert set(split) == set(whole) == set(files)
    for name in files:
        assert split[name]["error_code"] == whole[name]["error_code"], name
        assert split[name]["sha256"] == hashlib.sha256(files[name]).hexdigest(), name
        if whole[name]["error_code"] is None:
            assert split[name] == whole[name]
    assert split["good.csv"]["data_rows"] == 300 and split["good.csv"]["encoding"] == "utf-8-sig"
    assert {n for n in split if split[n]["error_code"] is None} == {"good.csv"}


def test_the_delimiter_comes_from_a_sample_of_many_lines(spark):
    # The first two lines alone would name the comma.
    text = "a,b;c\n1,2;3\n" + "4;5\n" * 50
    rows = spark.createDataFrame([("x.csv", len(text), bytearray(text.encode()))], "path string, length long, content binary")
    assert csv.Sniffer().sniff(text).delimiter == ";"
    assert I.audit_files(rows).first()["delimiter"] == ";"


def test_a_sample_may_end_inside_a_character(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,note\n" + "".join(f"{i},{'é' * 97}日\n" for i in range(3000)))
    found = I.audit_large_files(spark, str(tmp_path)).first()
    assert (found["delimiter"], found["data_rows"], found["error_code"]) == (",", 3000, None)
