"""Stateful request streams: admission, repeat suppression and session exchanges.

State per key is small (admitted times of five minutes, one timestamp, four exchanges) and expires
by event time. Keys are dealt to buckets, and a bucket's rows and states pass Python in one call, not key
by key. Each micro-batch sorts the rows of a key before applying them. A row that lies before
one already applied is marked ``late``, one behind the watermark is missing; ``run_in_order`` of the
flows computes the keys of both anew with the ``_again`` functions.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lodestone import fixed_values as fixed
from lodestone.functions import times
from lodestone.operators import dialogue
from lodestone.operators.scan import ordered_scan, text_result

STATE = "payload string"
# Calls into Python of a micro-batch. Keys are dealt to these by hash, so that a call serves many small keys; a key stays in one.
BUCKETS = 2_048

# What a row of a key gives: the key's payload (null: none yet) and the row's values -> the new payload, the results, and the time in ms after which the payload tells nothing.
RowStep = Callable[..., tuple[Any, tuple, int]]


def _by_key(rows: DataFrame, key: str, reads: list[str], result: str, step: RowStep) -> DataFrame:
    """``step`` over the rows of every key in the order of ``at`` and ``request_id``, with the columns ``reads``: key, request_id, ``result`` and late.

    The state of a bucket holds the payloads of its keys; those that tell nothing any more are left out.
    """

    def run(bucket: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = {name: entry for name, *entry in json.loads(state.get[0])} if state.exists else {}
        frames = list(pdfs)
        if not frames:
            return
        columns = {name: [value for frame in frames for value in frame[name].tolist()] for name in dict.fromkeys([key, "at", "request_id", *reads])}
        order = sorted(range(len(columns["at"])), key=lambda i: (columns["at"][i], columns["request_id"][i]))
        before = {name: held[name][1] for name in set(columns[key]) if name in held}
        found, late = [], []
        for i in order:
            name, place = columns[key][i], [int(columns["at"][i]), int(columns["request_id"][i])]
            end, last, payload = held.get(name, (0, None, None))
            payload, shown, over = step(payload, *[columns[column][i] for column in reads])
            held[name] = (max(end, over), place if last is None else max(last, place), payload)
            found.append(shown)
            # Before a row of an earlier micro-batch.
            late.append(name in before and place < before[name])
        now = state.getCurrentWatermarkMs()
        state.update((json.dumps([(name, *entry) for name, entry in held.items() if entry[0] > now], separators=(",", ":")),))
        state.setTimeoutTimestamp(max(now, *(entry[0] for entry in held.values())) + 1)
        shown = dict(zip(results, zip(*found, strict=True), strict=True))
        yield pd.DataFrame({key: [columns[key][i] for i in order], "request_id": [columns["request_id"][i] for i in order], **shown, "late": late})

    results = [field.split()[0] for field in result.split(", ")]
    dealt = rows.withColumn("__bucket", F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int"))
    return dealt.groupBy("__bucket").applyInPandasWithState(
        run, f"{key} string, request_id long, {result}, late boolean", STATE, "append", GroupStateTimeout.EventTimeTimeout
    )


def admission_stream(
    requests: DataFrame, window: int = fixed.ADMISSION_WINDOW_SECONDS, limit: int = fixed.ADMISSION_WINDOW_LIMIT,
    daily: int = fixed.ADMISSION_DAY_LIMIT, zone: str = fixed.LOCAL_ZONE, lateness: str = "1 minute",
) -> DataFrame:
    """STR-01: admitted or refused, and late or not, per request of a stream (``client, request_id, ts``)."""
    keyed = requests.withWatermark("ts", lateness).withColumn("at", F.unix_micros("ts")).withColumn("day", times.local_day("ts", zone).cast("string"))
    span = window * 1_000_000

    def step(payload: Any, at: int, today: str) -> tuple[Any, tuple, int]:
        recent, day, count = payload or ([], None, 0)
        at = int(at)
        if today != day:
            day, count = today, 0
        recent = [t for t in recent if t > at - span]
        good = len(recent) < limit and count < daily
        if good:
            recent, count = [*recent, at], count + 1
        # A day after the last request neither limit can depend on it any more.
        return (recent, day, count), ("admitted" if good else "refused",), at // 1000 + 86_400_000

    return _by_key(keyed, "client", ["at", "day"], "decision string", step)


def admission_again(rows: DataFrame) -> DataFrame:
    return dialogue.admission(rows.select("client", "request_id", "ts")).select("client", "request_id", "decision")


def repeat_stream(requests: DataFrame, ttl: int = fixed.REPEAT_TTL_SECONDS, lateness: str = "1 minute") -> DataFrame:
    """STR-02: computed or repeated, and late or not, per request of a stream (``repeat_key, request_id, ts``), measured from the first."""
    keyed = requests.withWatermark("ts", lateness).withColumn("at", F.unix_micros("ts"))
    span = ttl * 1_000_000

    def step(first: Any, at: int) -> tuple[Any, tuple, int]:
        fresh = first is None or int(at) - first >= span
        first = int(at) if fresh else first
        return first, ("computed" if fresh else "repeated",), first // 1000 + ttl * 1000

    return _by_key(keyed, "repeat_key", ["at"], "served string", step)


def repeat_again(rows: DataFrame) -> DataFrame:
    held = rows.select(F.col("repeat_key").alias("__key"), "request_id", "ts")
    return dialogue.suppress_repeats(held, ["__key"]).select(F.col("__key").alias("repeat_key"), "request_id", "served")


def exchange_stream(exchanges: DataFrame, keep: int = fixed.KEPT_EXCHANGES, gap: int = fixed.SESSION_GAP_SECONDS, lateness: str = "1 minute") -> DataFrame:
    """STR-04: revision and kept exchanges after each exchange (``session_id, request_id, ts``), late or not; idle sessions start over."""
    keyed = exchanges.withWatermark("ts", lateness).withColumn("at", F.unix_micros("ts"))
    span = gap * 1_000_000

    def step(payload: Any, at: int, request: int) -> tuple[Any, tuple, int]:
        last, revision, kept = payload or (None, 0, [])
        if last is not None and int(at) - last >= span:
            revision, kept = 0, []
        revision, kept, last = revision + 1, [*kept, int(request)][-keep:], int(at)
        return (last, revision, kept), (revision, ",".join(map(str, kept))), last // 1000 + gap * 1000

    return _by_key(keyed, "session_id", ["at", "request_id"], "revision int, kept string", step)


def exchange_again(rows: DataFrame, keep: int = fixed.KEPT_EXCHANGES, gap: int = fixed.SESSION_GAP_SECONDS) -> DataFrame:
    span = gap * 1_000_000

    def step(run: list[Any], state: Any) -> tuple[list[dict[str, Any]], Any]:
        last, revision, kept = state or [None, 0, []]
        found = []
        for row in run:
            at, request = row.at, row.request_id
            if last is not None and int(at) - last >= span:
                revision, kept = 0, []
            revision, kept, last = revision + 1, [*kept, int(request)][-keep:], int(at)
            found.append({"revision": str(revision), "kept": ",".join(map(str, kept))})
        return found, [last, revision, kept]

    held = rows.select("session_id", "request_id", F.unix_micros("ts").alias("at"))
    scanned = ordered_scan(held, "session_id", ["at", "request_id"], step, text_result("revision", "kept"), tuples=True)
    return scanned.select("session_id", "request_id", F.col("revision").cast("int").alias("revision"), "kept")
