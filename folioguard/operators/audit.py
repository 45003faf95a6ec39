"""Hash-chained audit events: building a chain per workspace and checking stored chains."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioguard.functions.scalars import n_if, type_of
from folioguard.session import discard, materialize, staging_path

GENESIS = hashlib.sha256(b"").hexdigest()
WORKSPACE = ["organization_id", "workspace_id"]
# Key order of the hashed text: by length, then by name. The previous hash comes last.
TEXT_KEYS = (
    "action", "reason", "actor_id", "event_id", "target_id", "after_hash", "request_id", "before_hash", "occurred_at",
    "target_type", "workspace_id", "audit_sequence", "organization_id",
)


def json_text(c: Column) -> Column:
    """A JSON string with its quotes, or ``null``."""
    inner = F.to_json(F.array(c))
    return F.substring(inner, F.lit(2), F.length(inner) - 2)


def chain_head(events: DataFrame) -> Column:
    """The hashed text up to the previous event's hash."""
    parts = []
    for name in TEXT_KEYS:
        c = F.col(name)
        if name == "audit_sequence":
            shown = c.cast("string")
        elif name == "occurred_at":
            if isinstance(type_of(events, name), T.TimestampType):
                c = F.to_utc_timestamp(c, F.current_timezone())
            stamp = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
            shown = F.concat(F.lit('"'), F.regexp_replace(stamp, r"\.?0+$", ""), F.lit('+00:00"'))
        else:
            shown = json_text(c)
        parts.append(F.concat(F.lit(f'"{name}": '), shown))
    return F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit(', "previous_event_hash": "'))


def event_hash(events: DataFrame, previous: str = "previous_event_hash") -> Column:
    return F.sha2(F.concat(chain_head(events), F.col(previous), F.lit('"}')), 256)


def build_chain(events: DataFrame) -> DataFrame:
    """Events with ``previous_event_hash`` and ``event_hash``.

    Every hash needs the one before it, so a workspace is walked in order. Rows stream through sorted partitions
    with one hash per workspace carried along; no workspace is ever held in memory.
    """
    columns = events.columns
    headed = events.withColumn("__head", chain_head(events))
    sorted_rows = headed.repartition(*WORKSPACE).sortWithinPartitions(*WORKSPACE, "audit_sequence")
    added = [T.StructField(n, T.StringType()) for n in ("previous_event_hash", "event_hash")]
    schema = T.StructType([*events.schema.fields, *added])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place: tuple | None = None
        last = GENESIS
        for batch in batches:
            before, after = [], []
            for org, workspace, head in zip(*[batch.column(c).to_pylist() for c in (*WORKSPACE, "__head")]):
                if (org, workspace) != place:
                    place, last = (org, workspace), GENESIS
                before.append(last)
                last = hashlib.sha256(f'{head}{last}"}}'.encode()).hexdigest()
                after.append(last)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in columns], pa.array(before, pa.string()), pa.array(after, pa.string())],
                names=schema.names)

    return sorted_rows.mapInArrow(walk, schema)


_ID, _ALTERED, _FIRST, _OWNER = "__id", "__altered", "__first", "__owner"


def _stored(chained: DataFrame, keep: Sequence[str], folder: str | None = None) -> DataFrame:
    """The columns to keep and those that links need, a number for each event, and whether its own hash is wrong. Written,
    as events are looked at from three sides and may be costly to make."""
    altered = ~event_hash(chained).eqNullSafe(F.col("event_hash")) | F.col("event_hash").isNull()
    columns = dict.fromkeys([*keep, *WORKSPACE, "audit_sequence", "event_hash", "previous_event_hash"])
    return materialize(chained.select(*columns, altered.alias(_ALTERED), F.monotonically_increasing_id().alias(_ID)),
                       "stored-chain", folder)


def _linked(stored: DataFrame) -> DataFrame:
    """Stored events with their findings, whether they are a first event, and the number of the event they follow."""
    key = [*WORKSPACE, "previous_event_hash"]
    parents = stored.where("event_hash is not null").groupBy(
        *WORKSPACE, F.col("event_hash").alias("previous_event_hash")).agg(
        F.min("audit_sequence").alias("__parent"), F.min(F.struct("audit_sequence", _ID)).alias("__least"))
    claims = stored.groupBy(*key).agg(F.count("*").alias("__claims"))
    is_first = F.col("previous_event_hash").eqNullSafe(F.lit(GENESIS))
    # First events all carry the same previous hash but differ in workspace; the key includes it. An event without a
    # previous hash finds no parent and no claim, and stays.
    joined = stored.join(parents, key, "left").join(claims, key, "left")
    findings = F.array_compact(F.array(
        F.when(F.col(_ALTERED), "altered"),
        F.when(~is_first & F.col("__parent").isNull(), "unlinked"),
        F.when(F.col("__parent") >= F.col("audit_sequence"), "out_of_order"),
        F.when(F.col("__claims") > 1, "forked"),
    ))
    return joined.select(*stored.columns, findings.alias("findings"), is_first.alias(_FIRST),
                         F.when(~is_first, F.col(f"__least.{_ID}")).alias(_OWNER))


def check_chain(chained: DataFrame) -> DataFrame:
    """Findings per event: ``altered``, ``unlinked``, ``out_of_order``, ``forked``; none means an intact chain.

    Links are looked up by hash, not by a window over a workspace, so a busy workspace is spread over all tasks. One
    genesis per workspace, a predecessor with a smaller sequence for every other event, and no hash with two
    successors together leave one chain in sequence order.
    """
    return _linked(_stored(chained, chained.columns)).select(*chained.columns, "findings")


def chain_summary(checked: DataFrame) -> DataFrame:
    """Events and findings per workspace."""
    return checked.groupBy(*WORKSPACE).agg(
        F.count("*").alias("events"), n_if(F.size("findings") > 0).alias("suspect_events"))


# An event with one of these is not what was written, or not where it was written.
LOCAL_FINDINGS = ("altered", "out_of_order", "forked")


def _follow(batches: Iterator[pa.RecordBatch], names: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """Links followed to the end of a batch: the event that the last one on the way follows (none: the chain starts there),
    the number of events on the way, the sequence of the earliest broken one, and whether the last is a first event.

    Pointers inside a batch are doubled, for as many rounds as its longest way can need. What still points on then is in a
    circle, or leads to one, and follows itself.
    """
    for batch in batches:
        n = batch.num_rows
        ids = batch.column(_ID).to_numpy()
        owner = batch.column(_OWNER)
        up = owner.fill_null(-1).to_numpy()
        order = np.argsort(ids, kind="stable")
        at = order[np.minimum(np.searchsorted(ids, up, sorter=order), n - 1)] if n else order
        after = np.where((up >= 0) & (ids[at] == up), at, -1)
        sequence = batch.column("audit_sequence")
        broken = batch.column("__broken").to_numpy(zero_copy_only=False).astype(bool)
        earliest = np.where(broken & sequence.is_valid().to_numpy(zero_copy_only=False), np.arange(n), -1)
        last, steps = np.arange(n), np.ones(n, dtype=np.int64)
        for _ in range(n.bit_length() + 1):
            on = np.flatnonzero(after >= 0)
            if not len(on):
                break
            to = after[on]
            steps[on] += steps[to]
            earliest[on] = np.where(earliest[to] >= 0, earliest[to], earliest[on])
            last[on] = last[to]
            after[on] = after[to]
        ends = np.where(after >= 0, ids, up[last])
        yield pa.RecordBatch.from_arrays(
            [*[batch.column(c) for c in names], pa.array(ends, mask=ends < 0), pa.array(steps),
             sequence.take(pa.array(earliest, mask=earliest < 0)), batch.column(_FIRST).take(pa.array(last))],
            names=[*names, "__up", "__place", "__earliest", "__start"])


def place_events(chained: DataFrame, keep: Sequence[str] | None = None) -> DataFrame:
    """Where every event of stored chains stands: place, reaches_genesis, first_broken and all findings.

    ``place`` counts the events from the start of an event's chain to itself, ``reaches_genesis`` tells whether that start
    is a genesis event, and ``first_broken`` is the sequence of the first event on the way (itself included) that is
    altered, out of order or forked. Added findings: ``unreachable`` (the chain of previous hashes ends before a genesis),
    ``broken_ancestor``, and ``circular`` (the hashes lead back to the event, or to such a circle; its place is null).

    Of the columns of ``chained``, those in ``keep`` come back (all, if it is not given).

    Events are dealt by ranges of their order and follow their links within a batch of it, where nearly all of them lead.
    Only the events that others point at from another batch then take part in list ranking by pointer doubling: each round
    an event takes over what the event it points at knows and points twice as far, so the rounds are the logarithm of the
    longest chain of such events, and no chain is walked by one task.
    """
    spark = chained.sparkSession
    names = [*dict.fromkeys([*(chained.columns if keep is None else keep), "audit_sequence"])]
    shown = chained.columns if keep is None else list(keep)
    folder = staging_path(spark, "chain")
    broken = F.arrays_overlap("findings", F.array(*[F.lit(f) for f in LOCAL_FINDINGS]))
    linked = materialize(_linked(_stored(chained, [*names, *WORKSPACE], folder)).select(
        *dict.fromkeys([*names, *WORKSPACE]), "findings", _ID, _OWNER, _FIRST, broken.alias("__broken")), "chain-links", folder)
    order = [*WORKSPACE, "audit_sequence", _ID]
    carried = [*names, "findings", _ID]
    kinds = {f.name: f.dataType for f in linked.schema}
    schema = T.StructType([T.StructField(c, kinds[c]) for c in carried] + [
        T.StructField("__up", T.LongType()), T.StructField("__place", T.LongType()),
        T.StructField("__earliest", kinds["audit_sequence"]), T.StructField("__start", T.BooleanType())])
    runs = materialize(linked.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(
        lambda batches: _follow(batches, carried), schema), "chain-runs")
    discard(spark, folder)

    pointed = runs.where(f"__up <> {_ID}").select(F.col("__up").alias("at")).distinct()
    state = materialize(runs.join(pointed, F.col(_ID) == F.col("at"), "left_semi").where(
        f"__up is null or __up <> {_ID}").select(
        _ID, F.col("__up").alias("up"), F.col("__place").alias("place"), F.col("__earliest").alias("broken"),
        F.col("__start").alias("genesis")), "chain-joints")
    done, waiting = [state.where("up is null")], state.where("up is not null")
    known = state
    left, longest = waiting.count(), state.count()
    while left and longest:
        further = known.select(
            F.col(_ID).alias("at"), F.col("up").alias("next"), F.col("place").alias("steps"),
            F.col("broken").alias("earlier"), F.col("genesis").alias("start"))
        moved = materialize(waiting.join(further, F.col("up") == F.col("at")).select(
            _ID, F.col("next").alias("up"), (F.col("place") + F.col("steps")).alias("place"),
            F.coalesce("earlier", "broken").alias("broken"), F.col("start").alias("genesis")), "chain-places")
        done.append(moved.where("up is null"))
        waiting = moved.where("up is not null")
        # What an event points at may be done or waiting; both know the same distance or all of the way.
        known = reduce(DataFrame.unionByName, done, waiting)
        left, longest = waiting.count(), longest // 2
    ahead = reduce(DataFrame.unionByName, done).select(
        F.col(_ID).alias("__at"), F.col("place").alias("__ahead"), F.col("broken").alias("__before"),
        F.col("genesis").alias("__from"))
    whole = runs.where("__up is null").select(
        *shown, "findings", F.col("__place").alias("place"), F.col("__start").alias("reaches_genesis"),
        F.col("__earliest").alias("first_broken"), F.col("audit_sequence").alias("__sequence"))
    rest = runs.where("__up is not null").join(ahead, F.col("__up") == F.col("__at"), "left").select(
        *shown, "findings", (F.col("__place") + F.col("__ahead")).alias("place"), F.col("__from").alias("reaches_genesis"),
        F.when(F.col("__at").isNotNull(), F.coalesce("__before", "__earliest")).alias("first_broken"),
        F.col("audit_sequence").alias("__sequence"))
    more = F.array_compact(F.array(
        F.when(F.col("place").isNull(), "circular").when(~F.col("reaches_genesis"), "unreachable"),
        F.when(F.col("first_broken") != F.col("__sequence"), "broken_ancestor")))
    return whole.unionByName(rest).withColumns({
        "reaches_genesis": F.coalesce("reaches_genesis", F.lit(False)), "findings": F.concat("findings", more)}).drop("__sequence")


def intact_prefixes(placed: DataFrame) -> DataFrame:
    """Per workspace: events, events of the longest intact stretch from a genesis, the sequence of the first broken event,
    and how many events have no way to a genesis."""
    intact = F.col("reaches_genesis") & F.col("first_broken").isNull()
    return placed.groupBy(*WORKSPACE).agg(
        F.count("*").alias("events"), F.coalesce(F.max(F.when(intact, F.col("place"))), F.lit(0)).alias("intact_events"),
        F.min("first_broken").alias("first_broken"), n_if(~F.col("reaches_genesis")).alias("unreachable_events"))
