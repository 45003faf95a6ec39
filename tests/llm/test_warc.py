from __future__ import annotations

import gzip
import random

import pytest

from folioguard.llm import warc

DATE = "2026-01-01T00:00:00Z"


def records(n=40):
    return [warc.build_record(i, f"http://x/{i}", (b"hello %d " % i) * random.Random(i).randint(0, 400), None, DATE)
            for i in range(n)]


def archive(kind):
    parts = [warc.gzip_member(r) + warc.EMPTY_MEMBER if kind == "gzip" else r for r in records()]
    return b"".join(parts), parts


def keys(found):
    return [warc.record_key(r["warc-record-id"]) for _, _, rows in found if not isinstance(rows, str) for r in rows]


@pytest.mark.parametrize("kind", ["gzip", "plain"])
def test_sound_archives(kind):
    data, _ = archive(kind)
    found = list(warc.salvage(data))
    assert keys(found) == list(range(40))
    assert not [f for f in found if isinstance(f[2], str)]
    if kind == "gzip":
        assert gzip.decompress(data) == b"".join(records())


@pytest.mark.parametrize("kind", ["gzip", "plain"])
def test_damage_costs_at_most_the_records_it_touches(kind):
    data, _ = archive(kind)
    rnd = random.Random(2)
    for _ in range(150):
        bad = bytearray(data)
        at, how = rnd.randrange(len(bad)), rnd.randrange(3)
        if how == 0:
            bad[at] ^= 1 << rnd.randrange(8)
        elif how == 1:
            del bad[at : at + rnd.randint(1, 50)]
        else:
            bad[at:at] = bytes(rnd.randrange(256) for _ in range(rnd.randint(1, 30)))
        found = list(warc.salvage(bytes(bad)))
        assert found[0][0] == 0 and found[-1][1] == len(bad)
        assert [f[0] for f in found[1:]] == [f[1] for f in found[:-1]]
        assert len(set(keys(found))) >= 38


def test_mixed_empty_and_hopeless_input():
    data = records()[0] + b"junk" * 10 + warc.gzip_member(records()[1]) + b"\x1f\x8b\x08 not a member"
    found = list(warc.salvage(data))
    assert keys(found) == [0, 1]
    assert [data[a:b][:4] for a, b, r in found if isinstance(r, str)] == [b"junk", b"\x1f\x8b\x08 "]
    assert list(warc.salvage(b"")) == []
    assert [r for *_, r in warc.salvage(b"nothing here")] == ["no version line"]


def test_round_trip_and_gaps(spark, tmp_path):
    rows = [(3, "http://a", "same"), (1, "http://b", "same"), (2, None, ""), (4, "u\r\nX: y", None), (5, "http://c", "other"),
            (None, "http://d", "same"), (1, "http://b", "same")]
    pages = spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, digest string")
    path = f"{tmp_path}/warc"
    got = [tuple(r)[:5] for r in warc.archive_round_trip(pages, path).collect()]
    same, none, other = (warc.base32_sha1(x) for x in (b"same", b"", b"other"))
    assert sorted(got, key=str) == sorted([
        (3, 4, same, "revisit", 1), (1, 4, same, "response", None), (1, 4, same, "response", None),
        (2, 0, none, "response", None), (4, 0, none, "revisit", 2), (5, 5, other, "response", None),
        (None, 4, same, "revisit", 1)], key=str)
    assert warc.read_gaps(spark, path).count() == 0
    texts = {r["record_id"]: bytes(r["payload"]) for r in warc.read_records(spark, path).collect()}
    assert texts["<urn:x-page:5>"] == b"other"


def test_long_payloads_alone_are_revisited(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")],
                                  "page_id long, url string, html string")
    got = warc.archive_round_trip(pages, f"{tmp_path}/w", min_revisit_bytes=3).collect()
    assert {r["page_id"]: r["refers_to"] for r in got} == {1: None, 2: None, 3: None, 4: 3}


def test_damaged_files_on_spark(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://p/{i}", f"text {i} " * 50) for i in range(30)],
                                  "page_id long, url string, html string").coalesce(1)
    warc.archive_round_trip(pages, f"{tmp_path}/w").count()
    file = next((tmp_path / "w").glob("part-*"))
    data = bytearray(file.read_bytes())
    at = warc.read_records(spark, f"{tmp_path}/w").where("record_id = '<urn:x-page:15>'").first()["offset"] + 60
    data[at] ^= 0xFF
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "part-0").write_bytes(bytes(data))
    kept = {r["page_id"] for r in warc.page_records(warc.read_records(spark, f"{tmp_path}/bad")).collect()}
    gaps = warc.read_gaps(spark, f"{tmp_path}/bad").collect()
    assert len(kept) == 29 and len(gaps) == 1
    assert gaps[0]["gap_start"] <= at < gaps[0]["gap_end"]


def test_empty_table(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.archive_round_trip(pages, f"{tmp_path}/none").count() == 0


def one_member():
    # Digits of a hash keep the compressed data long, so a fault in its middle has records before it.
    made = [warc.build_record(i, f"http://x/{i}", random.Random(i).randbytes(600).hex().encode(), None, DATE) for i in range(40)]
    return made, warc.gzip_member(b"".join(made))


def test_an_unsound_record_in_a_member_costs_only_itself():
    made, _ = one_member()
    bad = bytearray(made[7])
    bad[-40] ^= 1
    data = warc.gzip_member(b"".join(made[:7]) + bytes(bad) + b"".join(made[8:])) + warc.gzip_member(records()[3])
    found = list(warc.salvage(data))
    assert keys(found) == [*range(7), *range(8, 40), 3]
    reasons = [r for *_, r in found if isinstance(r, str)]
    start = sum(map(len, made[:7]))
    assert reasons == [f"block digest differs (bytes {start} to {start + len(bad)} of the member's content)"]


@pytest.mark.parametrize("how", ["cut", "damaged"])
def test_a_broken_member_keeps_the_records_before_the_fault(how):
    _, member = one_member()
    half = len(member) // 2
    after = warc.gzip_member(records()[3])
    broken = member[:half] if how == "cut" else member[:half] + b"\xff" * 400 + member[half + 400 :]
    found = list(warc.salvage(broken + after))
    got = keys(found)
    assert got[-1] == 3 and got[:-1] == list(range(len(got) - 1)) and len(got) > 15
    assert any("member is" in r for *_, r in found if isinstance(r, str))
    assert keys(warc.salvage(broken))[:15] == list(range(15))


def test_stored_records_of_a_broken_member_come_once():
    made, _ = one_member()
    member = warc.gzip_member(b"".join(made[:6]), level=0)
    broken = member[: len(member) - len(made[5]) // 2]
    assert keys(warc.salvage(broken)) == list(range(5))
    assert keys(warc.salvage(broken + warc.gzip_member(records()[3]))) == [*range(5), 3]
