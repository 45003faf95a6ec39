import pytest
from pyspark.sql import functions as F

from folioguard.operators import headers as H
from folioguard.operators import privacy as V
from folioguard.sources import artifacts as A
from folioguard.sources import csv as C
from folioguard.sources import intake as I

PAYLOADS = {
    "good.csv": (b"\xef\xbb\xbfCustomer ID;Transaction Amount\r\nC1;10\r\nC2;20\r\n", None),
    "plain.csv": (b"Customer ID,Amount,Optional\n00123,0100,\n00456,3.50,N/A\n", None),
    "quoted.csv": (b'"a,b",c\n"x\ny",2\n', None),
    "empty.csv": (b"", "empty_file"),
    "data.txt": (b"a,b\n1,2\n", "unsupported_extension"),
    "large.csv": (b"a,b\n" + b"1,2\n" * 400, "file_too_large"),
    "nul.csv": (b"a,b\n1,\x00\n", "binary_content"),
    "latin.csv": (b"a,b\n1,\xff\n", "invalid_encoding"),
    "caret.csv": (b"a^b\n1^2\n", "unsupported_delimiter"),
    "rows.csv": (b"a,b\n" + b"1,2\n" * 30, "too_many_rows"),
    "wide.csv": (b"a,b,c,d\n1,2,3,4\n", "too_many_columns"),
    "twice.csv": (b"Amount,amount \n1,2\n", "header_collision"),
    "blank.csv": (b"a,,c\n1,2,3\n", "empty_header"),
    "open.csv": (b'a,b\n"1,2\n', "parse_failed"),
    "long.csv": (b'a,b\n1,"x,y"\n1,2,3\n', "parse_failed"),
    "short.csv": (b"a,b\n1\n2,3\n", None),
    "lines.csv": (b'"a\nb",c\n1,2\n', None),
    "header.csv": (b"a,b\n", "empty_file"),
}
POLICY = I.FilePolicy(max_bytes=1000, max_rows=20, max_columns=3)


@pytest.fixture(scope="module")
def landing(tmp_path_factory):
    folder = tmp_path_factory.mktemp("landing")
    for name, (payload, _) in PAYLOADS.items():
        (folder / name).write_bytes(payload)
    return folder


def test_every_payload_gets_its_code(spark, landing):
    found = {r["file_name"]: r for r in I.audit_files(I.read_files(spark, str(landing), POLICY), POLICY).collect()}
    assert {n: r["error_code"] for n, r in found.items()} == {n: code for n, (_, code) in PAYLOADS.items()}
    good = found["good.csv"]
    assert (good["encoding"], good["delimiter"], good["data_rows"]) == ("utf-8-sig", ";", 2)
    assert good["normalized_headers"] == ["customer_id", "transaction_amount"]
    assert found["quoted.csv"]["normalized_headers"] == ["a_b", "c"] and found["quoted.csv"]["data_rows"] == 1


def test_large_files_are_not_read(spark, landing):
    row = I.read_files(spark, str(landing), POLICY).where("path like '%large.csv'").first()
    assert row["content"] is None and row["length"] > 1000


def test_restricted_files_are_refused(spark, landing):
    audited = I.audit_files(I.read_files(spark, str(landing), POLICY), POLICY)
    path = audited.where("file_name = 'plain.csv'").select("path")
    gated = I.with_privacy_gate(audited, path.withColumn("detection", F.lit("email_pattern")))
    codes = {r["file_name"]: r["error_code"] for r in gated.collect()}
    assert codes["plain.csv"] == "restricted_data" and codes["good.csv"] is None


def test_lexical_cells_stay(spark, landing):
    rows = C.read_lexical(spark, str(landing / "plain.csv")).orderBy("customer_id").collect()
    assert [tuple(r) for r in rows] == [("00123", "0100", ""), ("00456", "3.50", "N/A")]
    marked = C.read_lexical(spark, str(landing / "good.csv"), ";")
    assert marked.columns == ["customer_id", "transaction_amount"]
    assert C.read_lexical(spark, str(landing / "quoted.csv")).first()["a_b"] == "x\ny"
    assert C.read_lexical(spark, str(landing / "lines.csv")).columns == ["a_b", "c"]
    assert [tuple(r) for r in C.read_lexical(spark, str(landing / "short.csv")).collect()] == [("1", ""), ("2", "3")]
    assert not C.has_embedded_newlines(spark, str(landing / "plain.csv"))


def test_typed_cells(spark, landing):
    typed = C.read_typed(spark, str(landing / "plain.csv"))
    assert typed.dtypes == [("customer_id", "bigint"), ("amount", "double"), ("optional", "double")]
    assert [tuple(r) for r in typed.orderBy("customer_id").collect()] == [(123, 100.0, None), (456, 3.5, None)]


def test_bad_rows_fail(spark, tmp_path):
    (tmp_path / "bad.csv").write_text("a,b\n1,2\n1,2,3\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        C.read_lexical(spark, str(tmp_path / "bad.csv")).collect()


def test_colliding_headers(spark, landing, tmp_path):
    with pytest.raises(C.HeaderCollision):
        C.read_lexical(spark, str(landing / "twice.csv"))
    with pytest.raises(C.EmptyHeader):
        C.read_lexical(spark, str(landing / "blank.csv"))
    (tmp_path / "same.csv").write_text("Amount,Amount\n1,2\n")
    with pytest.raises(C.HeaderCollision):
        C.read_lexical(spark, str(tmp_path / "same.csv"))
    trusted = C.read_trusted(spark, str(tmp_path / "same.csv"))
    assert trusted.columns == ["amount", "amount_2"] and tuple(trusted.first()) == (1, 2)
    (tmp_path / "tick.csv").write_text("a`b,c\n1,2\n")
    assert len(C.read_lexical(spark, str(tmp_path / "tick.csv")).columns) == 2
    assert C.suffixed(["A b", "a_b", "a-b", "c"]) == ["a_b", "a_b_2", "a_b_3", "c"]


@pytest.mark.parametrize("cell, held", [
    ("write to Ann.Lee+x@mail.example.co now", True), ("call +234 803 555 0199 today", True),
    ("08035550199", True), ("x08035550199", True), ("108035550199", False), ("GB29NWBK60161331926819", True),
    ("a@b", False), ("nothing here", False), ("éa@x.com", False),
])
def test_patterns(spark, cell, held):
    df = spark.createDataFrame([("1", cell)], "customer_id string, notes string")
    assert V.minimize(df).first()["notes"] == ("[REDACTED]" if held else cell)


def test_findings_hold_no_values(spark):
    rows = [("c1", "a@b.co", "x", 5), ("c2", None, "08035550199", 6)]
    df = spark.createDataFrame(rows, "customer_id string, `Email Address` string, notes string, n long")
    found = [(r["column"], r["detection"], r["category"], r["affected_rows"]) for r in V.privacy_findings(df).orderBy(
        "ordinal").collect()]
    assert found == [
        ("Email Address", "restricted_column", "contact", 2), ("notes", "nigerian_phone_pattern", "contact", 1)]
    assert V.minimize(df).columns == ["customer_id", "notes", "n"]


def test_redaction_twice_is_redaction_once(spark):
    df = spark.createDataFrame([("a@b.co",), ("+234 803 555 0199",), ("fine",)], "notes string")
    once = V.minimize(df)
    assert V.minimize(once).collect() == once.collect()


def test_export_cells(spark, tmp_path):
    cells = ["=1+1", "+1", "-1", "@x", "\tlead", " =x", "safe", "a=b", 'say "hi"']
    df = spark.createDataFrame([(c, i) for i, c in enumerate(cells)], "cell string, n int")
    out = str(tmp_path / "export")
    C.write_safe_csv(df, out, single_file=True)
    part = next((tmp_path / "export").glob("*.csv")).read_bytes()
    assert part.startswith(b"\xef\xbb\xbfcell,n\n")
    back = {int(r["n"]): r["cell"] for r in C.read_lexical(spark, out).collect()}
    assert back == {i: (c if c in ("safe", "a=b", 'say "hi"') else f"'{c}") for i, c in enumerate(cells)}


def test_artifact_round_trip(spark, landing, tmp_path):
    lexical = C.read_lexical(spark, str(landing / "plain.csv"))
    entry = A.write_artifact(lexical, str(tmp_path / "artifact"), "v1", ["Customer ID", "Amount", "Optional"])
    again = A.write_artifact(lexical.repartition(3), str(tmp_path / "other"), "v1", ["Customer ID", "Amount",
                                                                                     "Optional"])
    for name in ("content_fingerprint", "schema_fingerprint", "row_count"):
        assert entry.first()[name] == again.first()[name]
    assert A.read_artifact(entry, ["customer_id", "amount"]).columns == ["amount", "customer_id"]
    assert A.verify_content(entry)
    with pytest.raises(A.ArtifactMismatch):
        A.read_artifact(entry.withColumn("row_count", F.lit(3)), ["amount"])
    with pytest.raises(A.ArtifactMismatch):
        A.read_artifact(entry, ["not_there"])


def test_row_bound(spark):
    verdicts = [C.row_bound(spark.range(n), 5).first()["verdict"] for n in (0, 5, 6)]
    assert verdicts == ["empty_file", "accepted", "too_many_rows"]


def test_schema_fingerprint_is_that_of_canonical_json(spark):
    import hashlib
    import json

    rows = [("v", 1, "Customer ID", "customer_id"), ("v", 2, 'A "b"', "a_b")]
    df = spark.createDataFrame(rows, "d string, position int, source_column string, normalized_column string")
    payload = json.dumps({"fields": [
        {"normalized": n, "source": s, "physical_type": "string", "nullable": False} for _, _, s, n in rows],
        "normalization_version": "1"}, ensure_ascii=False, separators=(",", ":"), sort_keys=True)
    got = H.schema_fingerprints(df.repartition(2), ["d"]).first()["schema_fingerprint"]
    assert got == hashlib.sha256(payload.encode()).hexdigest()
