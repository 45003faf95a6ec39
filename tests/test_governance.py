import datetime

import pytest
from pyspark.sql import functions as F

from folioguard.operators import audit as U
from folioguard.operators import mapping as P
from folioguard.operators import overrides as O
from folioguard.operators import tables as T
from folioguard.operators import validation as D
from folioguard.sources import catalogue as K

VALUES = ("1", "1.5", "true", "2026-08-25", "bad")
VALID = {
    "string": (1, 1, 1, 1, 1), "decimal": (1, 1, 0, 0, 0), "integer": (1, 0, 0, 0, 0), "boolean": (1, 0, 1, 0, 0),
    "date": (0, 0, 0, 1, 0), "datetime": (0, 0, 0, 1, 0),
}


@pytest.mark.parametrize("kind", list(VALID))
def test_type_matrix(spark, kind):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(VALUES)], "i int, v string")
    fixed = df.select("i", P.valid_value(F.col("v"), kind).alias("a"), P.valid_by_type(F.col("v"), F.lit(kind)).alias(
        "b"))
    rows = fixed.orderBy("i").collect()
    assert tuple(int(r["a"]) for r in rows) == VALID[kind] == tuple(int(r["b"]) for r in rows)


FIELDS = [
    P.Field("client", "customer_id", "string", False),
    P.Field("when", "date", "date", False),
    P.Field("amt", "transaction_amount", "decimal", True),
    P.Field("bad_flag", "defaulted", "boolean", True),
]


def lexical(spark):
    rows = [
        ("v1", " c1 ", "2026-01-01", "10", "TRUE"), ("v1", "c2", "2026-01-02", "x", "0"),
        ("v1", "c3", "2026-01-03", "y", ""), ("v1", "c4", "2026-01-03", "x", "1"),
        ("v2", "", "soon", "5", "maybe"), ("v2", "c9", "2026-01-02", " ", "1"),
    ]
    return spark.createDataFrame(rows, "v string, client string, when string, amt string, bad_flag string")


def test_canonical_values(spark):
    rows = P.canonicalize(lexical(spark), FIELDS, ["v"]).collect()
    assert [(r["customer_id"], r["transaction_amount"], r["defaulted"]) for r in rows[:3]] == [
        ("c1", "10", 1), ("c2", "x", 0), ("c3", "y", None)]
    assert rows[4]["customer_id"] is None


def test_runs_and_their_issues(spark):
    runs = {r["v"]: r for r in D.validate(lexical(spark), FIELDS, ["v"]).collect()}
    assert (runs["v1"]["verdict"], runs["v2"]["verdict"]) == ("passed", "blocked")
    assert runs["v1"]["dataset_status"] == "ready"
    first = runs["v1"]["issues"][0]
    assert (first["code"], first["affected_count"], first["override_allowed"]) == (
        "unparseable_optional_field", 3, True)
    assert len(first["masked_examples"]) == 2 and all(m.startswith("sha256:") for m in first["masked_examples"])
    assert [i["code"] for i in runs["v2"]["issues"]][:3] == [
        "missing_required_field", "unparseable_required_field", "unparseable_optional_field"]


def test_storing_twice_adds_nothing_and_changes_show(spark, tmp_path):
    details = D.detail_tables(D.validate(lexical(spark), FIELDS, ["v"]), "v")
    D.persist(details, str(tmp_path / "runs"))
    stored = D.persist(details, str(tmp_path / "runs"))
    assert {(r["missing"], r["unexpected"]) for r in D.verify(details, stored).collect()} == {(0, 0)}
    issues = stored["validation_issues"]
    assert issues.where("validation_run_id = 'v1'").agg(F.min("issue_ordinal")).first()[0] == 1
    changed = {**stored, "validation_issues": issues.withColumn("severity", F.lit("info"))}
    gaps = {r["detail"]: r["missing"] for r in D.verify(details, changed).collect()}
    assert gaps["validation_issues"] == issues.count() and gaps["validation_runs"] == 0
    other = {"validation_issues": details["validation_issues"].withColumn("severity", F.lit("info"))}
    with pytest.raises(ValueError, match="conflicts"):
        D.persist(other, str(tmp_path / "runs"))


def at(text):
    return datetime.datetime.fromisoformat(text)


def overrides(spark, rows):
    return spark.createDataFrame(
        [(i, "r1", 1, at(a), at(b)) for i, (a, b) in enumerate(rows)],
        "override_id int, validation_run_id string, issue_ordinal int, overridden_at timestamp, expires_at timestamp")


def test_one_of_two_warnings_overridden(spark):
    runs = spark.createDataFrame(
        [("r1", "d1", 90.0, 0, 2, 0), ("r2", "d2", 80.0, 0, 0, 1), ("r3", "d3", 10.0, 1, 1, 0)],
        "validation_run_id string, dataset_version_id string, composite_score double, block_count long, "
        "warn_count long, info_count long")
    held = overrides(spark, [("2026-01-01", "2026-02-01"), ("2025-01-01", "2026-01-15")])
    moment = F.lit(at("2026-01-15"))
    got = {r["validation_run_id"]: r for r in O.effective_quality(runs, held, moment).collect()}
    assert (got["r1"]["active_override_count"], got["r1"]["effective_warning_count"], got["r1"]["status"]) == (
        1, 1, "warn")
    assert (got["r2"]["status"], got["r3"]["status"]) == ("healthy", "blocked")


def test_overlap_is_half_open(spark):
    rows = overrides(spark, [
        ("2026-01-01", "2026-02-01"), ("2026-02-01", "2026-03-01"), ("2026-02-15", "2026-02-20"),
        ("2027-01-01", "2027-02-01")])
    assert {r["override_id"] for r in O.overlapping(rows, rows).collect()} == {1, 2}


def test_overlap_of_a_hot_issue_over_many_ranges(spark):
    """One issue with nearly all rows lies in several ranges; what they carry over finds the same as all pairs."""
    import random

    rnd = random.Random(12)
    rows = []
    for i in range(400):
        start = rnd.randrange(0, 60_000)
        length = rnd.choice([1, 3, 10, 30]) if i % 97 else 9_000
        issue = (1 if i % 10 else i % 3, "run") if i % 50 else (None, "run")
        rows.append((i, issue[1], issue[0], start, start + length))
    df = spark.createDataFrame(rows, "override_id int, validation_run_id string, issue_ordinal int, s int, e int").select(
        "override_id", "validation_run_id", "issue_ordinal", F.timestamp_seconds("s").alias("overridden_at"),
        F.timestamp_seconds("e").alias("expires_at"))
    expected = {a[0] for a in rows for b in rows if a[0] != b[0] and a[1:3] == b[1:3] and a[3] < b[4] and b[3] < a[4]}
    assert 0 < len(expected) < len(rows)
    for ranges in (1, 9, 150):
        assert {r["override_id"] for r in O.overlapping(df, df, ranges=ranges).collect()} == expected
    asked = df.where("override_id % 4 = 0")
    stored = df.where("override_id % 4 > 0")
    against = {a[0] for a in rows if a[0] % 4 == 0 for b in rows
               if b[0] % 4 and a[1:3] == b[1:3] and a[3] < b[4] and b[3] < a[4]}
    assert {r["override_id"] for r in O.overlapping(stored, asked, ranges=9).collect()} == against


def test_lifetimes_and_reasons(spark):
    df = spark.createDataFrame([
        (0, at("2026-01-01T00:00:00"), at("2026-01-01T00:15:00"), "long enough reason"),
        (1, at("2026-01-01T00:00:00"), at("2026-01-01T00:14:59"), " padded reason text"),
        (2, at("2026-01-01T00:00:00"), at("2026-04-01T00:00:00"), "short"),
        (3, at("2026-01-01T00:00:00"), at("2026-04-01T00:00:01"), "nul\u0000 in the reason"),
    ], "i int, overridden_at timestamp, expires_at timestamp, reason string")
    rows = df.select("i", O.lifetime_ok().alias("t"), O.bounded_text(F.col("reason"), 10).alias("r")).orderBy(
        "i").collect()
    assert [(r["t"], r["r"]) for r in rows] == [(True, True), (False, False), (True, False), (False, False)]


def test_conflicts_and_differences(spark):
    a = spark.createDataFrame([(1, "x"), (2, None), (2, None)], "k int, v string")
    b = spark.createDataFrame([(1, "y"), (2, None)], "k int, v string")
    assert [tuple(r) for r in T.conflicts(a, b, ["k"]).collect()] == [(1, "x")]
    assert sorted((r["k"], r["side"]) for r in T.difference(a, b).collect()) == [
        (1, "missing"), (1, "unexpected"), (2, "missing")]


def events(spark, n=40):
    rows = [("o", f"w{i % 3}", i, f"e{i}", at(f"2026-01-01T00:00:{i:02d}"), "actor", "act", "type", "id", f"q{i}",
             'said "so"\n', None, "sha256:1") for i in range(n)]
    return spark.createDataFrame(
        rows, "organization_id string, workspace_id string, audit_sequence long, event_id string, occurred_at "
              "timestamp, actor_id string, action string, target_type string, target_id string, request_id string, "
              "reason string, before_hash string, after_hash string")


def findings(checked):
    return {r["audit_sequence"]: r["findings"] for r in checked.collect() if r["findings"]}


def test_chain_links_each_workspace(spark):
    chained = U.build_chain(events(spark).repartition(5))
    first = chained.where("audit_sequence = 0").first()
    assert first["previous_event_hash"] == U.GENESIS
    import hashlib

    text = ('{"action": "act", "reason": "said \\"so\\"\\n", "actor_id": "actor", "event_id": "e0", "target_id": '
            '"id", "after_hash": "sha256:1", "request_id": "q0", "before_hash": null, "occurred_at": '
            '"2026-01-01T00:00:00+00:00", "target_type": "type", "workspace_id": "w0", "audit_sequence": 0, '
            f'"organization_id": "o", "previous_event_hash": "{U.GENESIS}"}}')
    assert first["event_hash"] == hashlib.sha256(text.encode()).hexdigest()
    second = chained.where("audit_sequence = 3").first()
    assert second["previous_event_hash"] == first["event_hash"]
    assert findings(U.check_chain(chained)) == {}


def test_tampering_shows(spark):
    chained = U.build_chain(events(spark)).persist()
    edited = chained.withColumn("reason", F.when(F.col("audit_sequence") == 7, "x").otherwise(F.col("reason")))
    assert findings(U.check_chain(edited)) == {7: ["altered"]}
    assert findings(U.check_chain(chained.where("audit_sequence <> 7"))) == {10: ["unlinked"]}
    doubled = chained.union(chained.where("audit_sequence = 7"))
    assert set(findings(U.check_chain(doubled))) == {7}
    chained.unpersist()


def test_mapping_hash_is_that_of_canonical_json(spark):
    import hashlib
    import json

    base = {n: f"x-{n}" for n in P.HASHED_FIELD} | {"nullable": True, "currency_code": None}
    rows = [("m", i, *[base[n] for n in P.HASHED_FIELD]) for i in (2, 1)]
    schema = "mapping_version_id string, position int, " + ", ".join(
        f"{n} {'boolean' if n == 'nullable' else 'string'}" for n in P.HASHED_FIELD)
    versions = spark.createDataFrame([("m", "why")], "mapping_version_id string, reason string")
    payload = json.dumps({"mapping_version_id": "m", "reason": "why", "fields": [base, base]}, sort_keys=True,
                         separators=(",", ":"))
    got = P.mapping_hashes(spark.createDataFrame(rows, schema), versions).first()["mapping_hash"]
    assert got == "sha256:" + hashlib.sha256(payload.encode()).hexdigest()


def by_walking(rows):
    """Place, reach and first broken event of every stored event, one step at a time."""
    own = {}
    for r in sorted(rows, key=lambda r: r["audit_sequence"], reverse=True):
        if r["event_hash"] is not None:
            own[r["workspace_id"], r["event_hash"]] = r
    out = {}
    for r in rows:
        at, seen, path = r, set(), []
        while True:
            path.append(at)
            if at["previous_event_hash"] == U.GENESIS:
                reaches = True
                break
            nxt = own.get((at["workspace_id"], at["previous_event_hash"]))
            if nxt is None:
                reaches = False
                break
            if nxt["audit_sequence"] in seen:
                path = None
                break
            seen.add(nxt["audit_sequence"])
            at = nxt
        if path is None:
            out[r["audit_sequence"]] = (None, False, None)
            continue
        broken = [e["audit_sequence"] for e in path if set(e["findings"]) & set(U.LOCAL_FINDINGS)]
        out[r["audit_sequence"]] = (len(path), reaches, broken[-1] if broken else None)
    return out


def test_places_by_pointer_doubling(spark):
    chained = U.build_chain(events(spark, 60).repartition(5)).cache()
    hash_of = {r["audit_sequence"]: r["event_hash"] for r in chained.collect()}

    def damaged(**changes):
        df = chained
        for column, values in changes.items():
            c = F.col(column)
            for at, value in values.items():
                c = F.when(F.col("audit_sequence") == at, F.lit(value)).otherwise(c)
            df = df.withColumn(column, c)
        return df

    cases = [
        chained, damaged(reason={7: "x", 30: "y"}), damaged(event_hash={9: None, 40: None}),
        damaged(previous_event_hash={10: None, 33: "nowhere"}), chained.where("audit_sequence not in (0, 12, 25)"),
        # a circle, a second successor, a link to a later event
        damaged(previous_event_hash={6: hash_of[18], 21: hash_of[9], 31: hash_of[43]}),
    ]
    for case in cases:
        got = U.place_events(case).collect()
        checked = U.check_chain(case).collect()
        assert {r["audit_sequence"]: (r["place"], r["reaches_genesis"], r["first_broken"]) for r in got} == by_walking(checked)
        assert len(got) == len(checked)
    circular = {r["audit_sequence"] for r in got if "circular" in r["findings"]}
    assert {6, 9, 12, 15, 18} <= circular
    whole = U.intact_prefixes(U.place_events(chained)).collect()
    assert all(r["intact_events"] == r["events"] and r["first_broken"] is None for r in whole)
    lost = U.intact_prefixes(U.place_events(cases[2])).collect()
    assert sum(r["unreachable_events"] for r in lost) > 0
    assert U.place_events(chained.limit(0)).count() == 0


@pytest.mark.parametrize("batch", [3, 10_000])
def test_places_over_batches_need_few_rounds(spark, monkeypatch, batch):
    chained = U.build_chain(events(spark, 60)).cache()
    hash_of = {r["audit_sequence"]: r["event_hash"] for r in chained.collect()}
    # a lost hash, a second successor, and circles within a batch and over several, with events that lead to them
    previous = F.col("previous_event_hash")
    for at_, to in {3: hash_of[6], 22: hash_of[55], 41: hash_of[8], 17: None}.items():
        previous = F.when(F.col("audit_sequence") == at_, F.lit(to)).otherwise(previous)
    labels = []
    plain = U.materialize
    monkeypatch.setattr(U, "materialize", lambda df, label, *more: labels.append(label) or plain(df, label, *more))
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(batch))
    try:
        for case in (chained, chained.withColumn("previous_event_hash", previous)):
            labels.clear()
            got = U.place_events(case, ["audit_sequence"]).collect()
            rounds = labels.count("chain-places")
            assert rounds <= (4 if batch == 3 else 2) or case is not chained
            assert {r["audit_sequence"]: (r["place"], r["reaches_genesis"], r["first_broken"]) for r in got} == by_walking(
                U.check_chain(case).collect())
            assert len(got) == 60
    finally:
        spark.conf.set(key, before)
    assert any("circular" in r["findings"] for r in got)
    chained.unpersist()


def test_derived_copies_are_made_by_several_tasks(spark, tmp_path, monkeypatch):
    spark.range(1000, numPartitions=1).select(
        F.when(F.col("id") % 10 > 0, 7).alias("c_custkey")).write.parquet(f"{tmp_path}/customer.parquet")
    plain = K.derive(spark, str(tmp_path), "mapping_fields")
    assert plain.rdd.getNumPartitions() == 1
    monkeypatch.setattr(K, "ROWS_PER_TASK", 1000)
    dealt = K.derive(spark, str(tmp_path), "mapping_fields")
    sizes = [r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 6000 and max(sizes) < 2000
    assert dealt.exceptAll(plain).isEmpty() and plain.exceptAll(dealt).isEmpty()


def test_cells_are_parsed_once_for_counts_and_examples(spark):
    names = ["version", *[f.normalized_column for f in FIELDS]]
    rows = spark.createDataFrame([("a", *["bad"] * len(FIELDS)), ("a", *[None] * len(FIELDS))], ", ".join(
        f"{n} string" for n in names))
    found = D.mapping_issues(rows, FIELDS, ["version"])
    assert found.inputFiles() and all("cell-counts" in f for f in found.inputFiles())
    runs = D.validate(rows, FIELDS, ["version"])
    assert all("cell-counts" in f or "canonical" in f for f in runs.inputFiles())
    assert runs.first()["verdict"] == "blocked"
