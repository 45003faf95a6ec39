"""Sliding-window admission per key: how many requests a subject may make inside a window.

The decision depends on which earlier requests were admitted, so a key is walked in time order; ``limit`` entries are
carried along, in the batch job and in the stream alike. The stream holds requests back until the watermark has passed
them and then decides them in order of time, so files that come out of order are decided as the batch job does. A request
that comes after the watermark has passed its time is not lost: its outcome is ``late``, and it counts nowhere.
"""

from __future__ import annotations

from collections import namedtuple
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from folioguard.fixed_values import ADMISSION_POLICIES

KEY = ["scope", "subject"]
MICROS = 1_000_000
DECISION = (
    "scope string, subject string, request_id string, at_micros long, kind string, outcome string, remaining int, "
    "retry_after_seconds long"
)
REQUEST = "scope string, subject string, request_id string, at_micros long, kind string, ts timestamp"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def policy_dimension(spark: SparkSession, policies: dict[str, tuple[int, int]] | None = None) -> DataFrame:
    """Scope, limit and window; a handful of rows."""
    rows = [(scope, limit, window) for scope, (limit, window) in (policies or ADMISSION_POLICIES).items()]
    return spark.createDataFrame(rows, "scope string, max_requests int, window_seconds long")


def with_policy(requests: DataFrame, policies: DataFrame) -> DataFrame:
    """Requests with the limit and window of their scope, null for a scope the policy table (a row each) lacks."""
    return requests.join(policies, "scope", "left")


def micros(column: str) -> Column:
    """Microseconds on the clock the column shows, whatever the session's time zone."""
    return F.expr(
        f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast({column} as timestamp_ntz))")


def decide(
    admitted: list[tuple[int, str]], now: int, member: str, limit: int, window: int
) -> tuple[list[tuple[int, str]], str, int, int]:
    """Admitted entries after this request, the outcome, what remains, and the wait in seconds."""
    live = [entry for entry in admitted if entry[0] > now - window]
    if any(entry[1] == member for entry in live):
        return live, "replayed", max(0, limit - len(live)), 0
    if len(live) < limit:
        return [*live, (now, member)], "admitted", limit - len(live) - 1, 0
    wait = -(-(live[0][0] + window - now) // MICROS)
    return live, "denied", 0, max(1, wait)


def independent_runs(requests: DataFrame) -> DataFrame:
    """``run`` and ``part`` per key: a new one after an idle window, and after each reset.

    Time is cut in slots of one window. After an empty slot nothing earlier is still alive, and a reset leaves nothing
    either, so the stretches between do not depend on each other and a busy key can be walked in several tasks. One window
    sees the used slots of a key, the other the requests of one slot; neither sees a key's whole history.
    """
    window = F.coalesce(F.col("window_seconds"), F.lit(1)) * MICROS
    is_reset = (F.col("kind") == "reset").cast("int")
    slotted = requests.withColumn("__slot", F.floor(F.col("at_micros") / window))
    slots = slotted.groupBy(*KEY, "__slot").agg(F.sum(is_reset).alias("__resets"))
    order = Window.partitionBy(*KEY).orderBy("__slot")
    fresh = (F.col("__slot") - F.lag("__slot").over(order) > 1).cast("int")
    runs = slots.withColumns({
        "run": F.sum(F.coalesce(fresh, F.lit(0))).over(order),
        "__before": F.sum("__resets").over(order) - F.col("__resets")}).drop("__resets")
    inside = Window.partitionBy(*KEY, "__slot").orderBy("at_micros", "request_id").rowsBetween(
        Window.unboundedPreceding, -1)
    counted = slotted.withColumn("__here", F.coalesce(F.sum(is_reset).over(inside), F.lit(0)))
    return counted.join(runs, [*KEY, "__slot"]).withColumn(
        "part", F.col("__before") + F.col("__here")).drop("__slot", "__before", "__here")


def admit(requests: DataFrame) -> DataFrame:
    """Decision for every request; one of an unknown scope is told so and counts nowhere.

    ``requests``: scope, subject, request_id, at_micros, kind (``consume`` or ``reset``), max_requests,
    window_seconds. Rows stream through sorted partitions; no key is held in memory.
    """
    rows = independent_runs(requests).select(
        *KEY, "run", "part", "request_id", "at_micros", "kind", "max_requests", "window_seconds")
    ordered = rows.repartition(*KEY, "run", "part").sortWithinPartitions(*KEY, "run", "part", "at_micros", "request_id")

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place, admitted = None, []
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                if (r.scope, r.subject, r.run, r.part) != place:
                    place, admitted = (r.scope, r.subject, r.run, r.part), []
                admitted, line = _step(admitted, r)
                out.append(line)
            yield pd.DataFrame(out, columns=COLUMNS)

    return ordered.mapInPandas(walk, DECISION)


COLUMNS = ["scope", "subject", "request_id", "at_micros", "kind", "outcome", "remaining", "retry_after_seconds"]


def _step(admitted: list[tuple[int, str]], r) -> tuple[list[tuple[int, str]], tuple]:
    head = (r.scope, r.subject, r.request_id, r.at_micros, r.kind)
    if pd.isna(r.max_requests):
        return admitted, (*head, "unknown_scope", 0, 0)
    if r.kind == "reset":
        return [], (*head, "reset", int(r.max_requests), 0)
    admitted, outcome, remaining, wait = decide(
        admitted, r.at_micros, r.request_id, int(r.max_requests), int(r.window_seconds) * MICROS)
    return admitted, (*head, outcome, remaining, wait)


PENDING = ["request_id", "at_micros", "kind", "max_requests", "window_seconds"]
PENDING_FIELDS = "request_id string, at_micros long, kind string, max_requests int, window_seconds long"
TICK = "tick"


class AdmissionProcessor(StatefulProcessor):
    """The same walk over a stream, in event time.

    A key's requests wait in state until a timer finds that the watermark has passed them; then they are decided in
    order of time. What is held at once is a key's requests between watermark and newest event, not a micro-batch. The
    admitted entries are dropped once their window is over.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entries = handle.getListState("admitted", "at_micros long, member string")
        self.pending = handle.getListState("pending", PENDING_FIELDS)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        for frame in rows:
            frame = frame[frame["kind"] != TICK]
            late = (frame["at_micros"] <= passed) & (passed > 0)  # the watermark is zero until it is known
            waiting = frame.loc[~late, PENDING]
            if len(waiting):
                limits = [(None if pd.isna(m) else int(m), None if pd.isna(w) else int(w))
                          for m, w in zip(waiting["max_requests"], waiting["window_seconds"])]
                self.pending.appendList([
                    (r, int(at), kind, *limit) for r, at, kind, limit in zip(
                        waiting["request_id"], waiting["at_micros"], waiting["kind"], limits)])
                self.handle.registerTimer(-(-int(waiting["at_micros"].min()) // 1000))
            if late.any():
                out = frame.loc[late, [*KEY, "request_id", "at_micros", "kind"]]
                yield out.assign(outcome="late", remaining=0, retry_after_seconds=0)[COLUMNS]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        due, waiting = [], []
        for r in self.pending.get():
            (due if r[1] <= passed else waiting).append(tuple(r))
        admitted = [(e[0], e[1]) for e in self.entries.get()]
        out = []
        for r in sorted(due, key=lambda r: (r[1], r[0])):
            admitted, line = _step(admitted, Request(*key, *r))
            out.append(line)
        if due:
            if waiting:
                self.pending.put(waiting)
                self.handle.registerTimer(-(-min(r[1] for r in waiting) // 1000))
            else:
                self.pending.clear()
            window = next((int(r[4]) for r in due if r[4] is not None), 0)
            if admitted:
                self.entries.put(admitted)
                self.handle.registerTimer(-(-admitted[-1][0] // 1000) + window * 1000)
            else:
                self.entries.clear()
        elif not waiting and admitted and admitted[-1][0] // 1000 < expiredTimerInfo.getExpiryTimeInMs():
            self.entries.clear()  # the timer set for the end of the last entry's window
        yield pd.DataFrame(out, columns=COLUMNS)

    def close(self) -> None:
        pass


Request = namedtuple("Request", [*KEY, *PENDING])


def with_state_store(spark: SparkSession, partitions: int | None = None) -> SparkSession:
    """A session for ``admit_stream``, with the state store it needs; the caller's settings stay as they are.

    ``partitions`` is the number of state stores, fixed for the life of a checkpoint (the session's shuffle partitions
    unless given). A store sets some megabytes of disk aside however little it holds.
    """
    session = spark.newSession()
    if partitions:
        session.conf.set("spark.sql.shuffle.partitions", str(partitions))
    session.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    # A batch writes its changes, not the whole store, and old versions go soon.
    session.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
    session.conf.set("spark.sql.streaming.minBatchesToRetain", "2")
    return session


def admit_stream(requests: DataFrame, late_by: str = "1 hour") -> DataFrame:
    """Streaming decisions; ``requests`` also has the event time ``ts``, of which ``at_micros`` is the same in UTC.

    A request is decided once the watermark, the newest event less ``late_by``, has passed it. One that comes after
    that gets the outcome ``late``; none is lost. A request of the kind ``tick`` is not decided, it only moves the
    watermark, so that what waits at the end of a bounded input comes out. Needs the RocksDB state store
    (``with_state_store``).
    """
    # The processor gets no watermark column, or rows behind the watermark would be dropped before it sees them.
    timed = requests.withWatermark("ts", late_by).withColumn("ts", F.unix_micros("ts"))
    return (
        timed.groupBy(*KEY)
        .transformWithStateInPandas(
            statefulProcessor=AdmissionProcessor(), outputStructType=DECISION, outputMode="Append",
            timeMode="EventTime")
    )
