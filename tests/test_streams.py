import pandas as pd
from pyspark.sql import functions as F

from folioguard.sources import intake as I
from folioguard.streaming import admission as X
from folioguard.streaming.landing import header_folder, land

SECOND = 1_000_000


def requests(spark, rows, limit=2, window=60):
    df = spark.createDataFrame(
        [("s", subject, request, at * SECOND, kind, limit, window) for subject, request, at, kind in rows],
        "scope string, subject string, request_id string, at_micros long, kind string, max_requests int, "
        "window_seconds long")
    return df.repartition(3)


def outcomes(df):
    return [
        (r["outcome"], r["remaining"], r["retry_after_seconds"])
        for r in X.admit(df).orderBy("at_micros", "request_id").collect()]


def test_limit_then_recovery(spark):
    rows = [("a", f"r{i}", t, "consume") for i, t in enumerate((0, 10, 20, 59, 60, 61, 70))]
    assert outcomes(requests(spark, rows)) == [
        ("admitted", 1, 0), ("admitted", 0, 0), ("denied", 0, 40), ("denied", 0, 1), ("admitted", 0, 0),
        ("denied", 0, 9), ("admitted", 0, 0)]


def test_replay_counts_once(spark):
    rows = [("a", "same", 0, "consume"), ("a", "same", 5, "consume"), ("a", "other", 6, "consume"),
            ("a", "same", 61, "consume")]
    assert [o for o, _, _ in outcomes(requests(spark, rows))] == ["admitted", "replayed", "admitted", "admitted"]


def test_subjects_do_not_share(spark):
    rows = [(s, f"{s}{i}", i, "consume") for i in range(3) for s in ("a", "b")]
    found = X.admit(requests(spark, rows)).groupBy("subject", "outcome").count().collect()
    assert {(r["subject"], r["outcome"]): r["count"] for r in found} == {
        ("a", "admitted"): 2, ("a", "denied"): 1, ("b", "admitted"): 2, ("b", "denied"): 1}


def test_reset_clears(spark):
    rows = [("a", "1", 0, "consume"), ("a", "2", 1, "consume"), ("a", "x", 2, "reset"), ("a", "3", 3, "consume")]
    assert [o for o, _, _ in outcomes(requests(spark, rows))] == ["admitted", "admitted", "reset", "admitted"]


def test_idle_time_cuts_a_key_without_changing_decisions(spark):
    rows = [("a", f"r{i}", t, "consume") for i, t in enumerate((0, 1, 2, 59, 125, 126, 127, 300, 301, 302))]
    df = requests(spark, rows)
    assert X.independent_runs(df).select("run").distinct().count() == 3
    admitted, expected = [], []
    for _, request, at, _ in rows:
        admitted, outcome, remaining, wait = X.decide(admitted, at * SECOND, request, 2, 60 * SECOND)
        expected.append((outcome, remaining, wait))
    assert outcomes(df) == expected


def test_resets_cut_a_key_without_changing_decisions(spark):
    rows = [("a", f"r{i:02}", i // 2, "reset" if i in (4, 5, 13) else "consume") for i in range(24)]
    df = requests(spark, rows)
    assert X.independent_runs(df).select("run", "part").distinct().count() == 4
    admitted, expected = [], []
    for _, request, at, kind in rows:
        if kind == "reset":
            admitted = []
            expected.append(("reset", 2, 0))
            continue
        admitted, outcome, remaining, wait = X.decide(admitted, at * SECOND, request, 2, 60 * SECOND)
        expected.append((outcome, remaining, wait))
    assert outcomes(df) == expected


STREAM = ("scope string, subject string, request_id string, at_micros long, kind string, ts timestamp, "
          "max_requests int, window_seconds long")


def streamed(spark, tmp_path, batches, late_by, limit=2, window=60):
    """Decisions of a stream that gets one file of requests a micro-batch."""
    session = X.with_state_store(spark)
    folder = tmp_path / "in"
    for i, rows in enumerate(batches):
        df = spark.createDataFrame([
            (s, subject, request, at * SECOND, kind, limit if s == "s" else None, window if s == "s" else None)
            for s, subject, request, at, kind in rows],
            "scope string, subject string, request_id string, at_micros long, kind string, max_requests int, window_seconds long")
        df.withColumn("ts", F.timestamp_micros("at_micros")).select(
            *[part.split(" ")[0] for part in STREAM.split(", ")]).coalesce(1).write.parquet(str(folder / f"p{i}"))
    source = session.readStream.schema(STREAM).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(
        str(folder))
    job = X.admit_stream(source, late_by).writeStream.format("parquet").option("path", str(tmp_path / "out")).option(
        "checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    job.awaitTermination()
    return spark.read.schema(X.DECISION).parquet(str(tmp_path / "out"))


TICK = ("", "", "", 10**6, X.TICK)


def test_requests_out_of_order_are_decided_as_the_batch(spark, tmp_path):
    rows = [("s", subject, f"{subject}{i}", i * 7 + j, "reset" if i % 11 == 5 else "consume")
            for j, subject in enumerate(("a", "b", "c")) for i in range(40)]
    rows += [("other", "a", f"o{i}", i, "consume") for i in range(3)]
    # The second micro-batch is older than the first in part; all is within the allowed time.
    first = [r for i, r in enumerate(rows) if i % 3]
    second = [r for i, r in enumerate(rows) if i % 3 == 0]
    got = streamed(spark, tmp_path, [first, second, [TICK]], "1 hour")
    df = spark.createDataFrame([(*r[:3], r[3] * SECOND, r[4], 2 if r[0] == "s" else None, 60 if r[0] == "s" else None) for r in rows],
                               "scope string, subject string, request_id string, at_micros long, kind string, "
                               "max_requests int, window_seconds long")
    batch = X.admit(df)
    assert batch.where("outcome = 'denied'").count() > 0 and batch.where("outcome = 'reset'").count() > 0
    assert got.exceptAll(batch).isEmpty() and batch.exceptAll(got).isEmpty()


def test_late_requests_get_a_row(spark, tmp_path):
    first = [("s", "a", "r0", 100, "consume"), ("s", "a", "r1", 500, "consume"), ("s", "b", "x", 100, "consume")]
    second = [("s", "a", "r2", 490, "consume"), ("s", "a", "late1", 120, "consume"), ("s", "new", "late2", 1, "reset")]
    third = [("s", "a", "r3", 495, "consume"), ("s", "a", "late3", 100, "consume")]
    got = {r["request_id"]: (r["outcome"], r["remaining"]) for r in streamed(
        spark, tmp_path, [first, second, third, [TICK]], "60 seconds").collect()}
    assert got == {
        "r0": ("admitted", 1), "x": ("admitted", 1), "late1": ("late", 0), "late2": ("late", 0), "late3": ("late", 0),
        "r2": ("admitted", 1), "r3": ("admitted", 0), "r1": ("denied", 0)}


def test_stream_decides_as_the_batch(spark, sf_dir, tmp_path):
    from folioguard.plans.flows import admission_requests, admission_tick, policies
    from folioguard.sources.portfolio import table

    session = X.with_state_store(spark)
    events = table(spark, sf_dir, "events")
    span = events.selectExpr("max(ts) - min(ts) as s").first()["s"]
    for i in range(3):  # every micro-batch has events of the whole time
        events.where(f"event_id % 3 = {i}").coalesce(1).write.parquet(str(tmp_path / f"in/p{i}"))
    stream = session.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    admission_tick(events).write.parquet(str(tmp_path / "tick"))
    tick = session.readStream.schema(X.REQUEST).parquet(str(tmp_path / "tick"))
    asked = X.with_policy(admission_requests(stream), policies(session)).unionByName(X.with_policy(tick, policies(session)))
    job = X.admit_stream(asked, f"{span.days + 2} days").writeStream.format("parquet").option(
        "path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    job.awaitTermination()
    # The tick was in the first micro-batch, so what came in the others is behind the watermark.
    got = spark.read.schema(X.DECISION).parquet(str(tmp_path / "out"))
    assert got.count() == events.count()
    batch = X.admit(X.with_policy(admission_requests(events.where("event_id % 3 = 0")).drop("ts"), policies(spark)))
    assert got.where("outcome = 'late'").count() == events.where("event_id % 3 > 0").count()
    decided = got.where("outcome <> 'late'")
    assert decided.exceptAll(batch).isEmpty() and batch.exceptAll(decided).isEmpty()


def test_landing_is_incremental_and_idempotent(spark, tmp_path):
    landing = tmp_path / "landing"
    landing.mkdir()
    (landing / "a.csv").write_bytes(b"\xef\xbb\xbfID;Amount\n001;5\n002;N/A\n")
    (landing / "b.csv").write_text("Id,Amount\n003,7\n")
    (landing / "c.txt").write_text("x")
    (landing / "e.csv").write_text("")
    out = str(tmp_path / "out")

    def run():
        land(spark, str(landing), out, str(tmp_path / "cp"), I.FilePolicy()).awaitTermination()

    run()
    rows = spark.read.parquet(f"{out}/normalized/{header_folder(['id', 'amount'])}")
    assert sorted((r["id"], r["amount"]) for r in rows.collect()) == [("001", "5"), ("002", "N/A"), ("003", "7")]
    (landing / "d.csv").write_text("id,amount\n004,9\n")
    run()
    run()
    assert spark.read.parquet(f"{out}/normalized/{header_folder(['id', 'amount'])}").count() == 4
    audit = spark.read.parquet(f"{out}/audit").toPandas()
    assert sorted(audit["error_code"].fillna("ok")) == ["empty_file", "ok", "ok", "ok", "unsupported_extension"]
    # A fresh checkpoint delivers every file again: nothing is doubled.
    land(spark, str(landing), out, str(tmp_path / "cp2")).awaitTermination()
    assert spark.read.parquet(f"{out}/normalized/{header_folder(['id', 'amount'])}").count() == 4
    assert spark.read.parquet(f"{out}/audit").count() == 5


def test_bad_files_do_not_stop_the_others(spark, tmp_path):
    landing = tmp_path / "landing"
    landing.mkdir()
    (landing / "good.csv").write_text("id,amount\n1,5\n")
    (landing / "long.csv").write_text("id,amount\n1,5,9\n2,6\n")
    (landing / "short.csv").write_text("id,amount\n7\n8,4\n")
    (landing / "big.csv").write_text("id,amount\n" + "1,2\n" * 400)
    (landing / "quoted.csv").write_text('"id\nof row",amount\n9,"a\nb"\n')
    out = str(tmp_path / "out")
    for _ in range(2):
        land(spark, str(landing), out, str(tmp_path / "cp"), I.FilePolicy(max_bytes=1000)).awaitTermination()
    codes = {r["file_name"]: r["error_code"] for r in spark.read.parquet(f"{out}/audit").collect()}
    assert codes == {"good.csv": None, "long.csv": "parse_failed", "short.csv": None, "big.csv": "file_too_large",
                     "quoted.csv": None}
    rows = spark.read.parquet(f"{out}/normalized/{header_folder(['id', 'amount'])}").collect()
    assert sorted((r["id"], r["amount"]) for r in rows) == [("1", "5"), ("7", ""), ("8", "4")]
    quoted = spark.read.parquet(f"{out}/normalized/{header_folder(['id_of_row', 'amount'])}").first()
    assert (quoted["id_of_row"], quoted["amount"]) == ("9", "a\nb")


def test_files_over_size_and_rows_land_whole(spark, tmp_path):
    landing, out = tmp_path / "landing", str(tmp_path / "out")
    landing.mkdir()
    bounds = I.FilePolicy()
    n = bounds.max_rows + 1
    (landing / "large.csv").write_text("id,text\n" + "".join(f"{i},{'x' * 100}\n" for i in range(n)))
    (landing / "long.csv").write_text("id,text\n" + "".join(f"{i},\n" for i in range(n)))
    (landing / "small.csv").write_text("id,text\n1,a\n")
    assert (landing / "large.csv").stat().st_size > bounds.max_bytes
    land(spark, str(landing), out, str(tmp_path / "cp")).awaitTermination()
    audit = {r["file_name"]: r for r in spark.read.parquet(f"{out}/audit").collect()}
    assert {f: (r["error_code"], r["over_limit"]) for f, r in audit.items()} == {
        "large.csv": (None, "file_too_large"), "long.csv": (None, "too_many_rows"), "small.csv": (None, None)}
    rows = spark.read.parquet(f"{out}/normalized/{header_folder(['id', 'text'])}")
    assert {r["sha256"]: r["count"] for r in rows.groupBy("sha256").count().collect()} == {
        audit["large.csv"]["sha256"]: n, audit["long.csv"]["sha256"]: n, audit["small.csv"]["sha256"]: 1}


def test_wide_and_quoted_files_land_in_ranges(spark, tmp_path):
    landing, out = tmp_path / "landing", str(tmp_path / "out")
    landing.mkdir()
    names = [f"c{i}" for i in range(300)]
    (landing / "wide.csv").write_text(",".join(names) + "\n" + ",".join("1" * 300) + "\n")
    cells = "".join(f'{i},"line\none of {i}",{i}\n' for i in range(400))
    (landing / "quoted.csv").write_text("id,note,n\n" + cells)
    land(spark, str(landing), out, str(tmp_path / "cp"), range_bytes=512).awaitTermination()
    audit = {r["file_name"]: r for r in spark.read.parquet(f"{out}/audit").collect()}
    assert {f: (r["error_code"], r["over_limit"]) for f, r in audit.items()} == {
        "wide.csv": (None, "too_many_columns"), "quoted.csv": (None, None)}
    wide = spark.read.parquet(f"{out}/normalized/{header_folder(names)}")
    assert wide.count() == 1 and wide.first()["c299"] == "1"
    rows = spark.read.parquet(f"{out}/normalized/{header_folder(['id', 'note', 'n'])}").collect()
    assert sorted((int(r["id"]), r["note"], r["n"]) for r in rows) == [
        (i, f"line\none of {i}", str(i)) for i in range(400)]


def test_policies(spark):
    known = X.policy_dimension(spark).toPandas().set_index("scope")
    assert known.loc["login_account_failure"].tolist() == [5, 900]
    assert len(known) == 7 and isinstance(known, pd.DataFrame)
    unknown = spark.createDataFrame([("nope",)], "scope string")
    assert X.with_policy(unknown, X.policy_dimension(spark)).first()["max_requests"] is None


def test_every_request_gets_a_decision(spark):
    rows = [("nope", "s", f"r{i}", i * 1_000_000, "consume") for i in range(3)] + [
        ("login_account_failure", "s", "k", 5, "consume")]
    requests = spark.createDataFrame(rows, "scope string, subject string, request_id string, at_micros long, kind string")
    got = {r["request_id"]: r["outcome"] for r in X.admit(X.with_policy(requests, X.policy_dimension(spark))).collect()}
    assert got == {"r0": "unknown_scope", "r1": "unknown_scope", "r2": "unknown_scope", "k": "admitted"}


def test_clock_does_not_depend_on_the_session(spark):
    df = spark.sql("select timestamp_ntz'1970-01-01 00:00:01.5' as ts")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Africa/Lagos")
        assert df.select(X.micros("ts")).first()[0] == 1_500_000
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
