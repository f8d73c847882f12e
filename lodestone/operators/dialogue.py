"""Order-dependent session logic over tables: dialogue inheritance, admission, repeats, session gaps."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone import fixed_values as fixed
from lodestone.functions import times
from lodestone.operators.planning import OUT_OF_SCOPE
from lodestone.operators.scan import ordered_scan, text_result
from lodestone.operators.skew import spread_join, top_rows
from lodestone.session import cut_lineage


def turn_facts(turns: DataFrame) -> DataFrame:
    """What each turn says by itself, before any earlier turn is looked at.

    ``own_intent`` is the intent that the turn can be planned with alone (null: none), ``fallback``
    the one that is shown when it cannot be planned, ``shows_period`` whether it then shows its own
    period, and ``inherits`` whether the intent of the last planned turn may take the place of its own.
    """
    yes = lambda name: F.coalesce(F.col(name), F.lit(False))
    topical = F.col("rule_intent") != OUT_OF_SCOPE
    named = F.col("security_id").isNotNull()
    silent = (F.coalesce("folded", F.lit("")) == "") | yes("prohibited")
    unplannable = silent | yes("multi_security") | yes("unclear_security")
    summary = F.when(named & yes("has_content") & ~yes("unsupported"), F.lit("multi_source_summary"))
    fallback = (
        F.when(F.coalesce("folded", F.lit("")) == "", F.lit(OUT_OF_SCOPE)).when(yes("prohibited"), F.lit("prohibited_advice"))
        .when(~yes("multi_security") & yes("unclear_security"), F.col("rule_intent")).otherwise(F.lit(OUT_OF_SCOPE))
    )
    as_text = lambda name: F.col(name).cast("string").alias(name)
    return turns.select(
        as_text("session_id"), "turn", "request_id", "security_id", as_text("period_start"), as_text("period_end"), yes("period_explicit").alias("period_explicit"),
        as_text("basis_day"), F.when(~unplannable, F.when(topical, F.col("rule_intent")).otherwise(summary)).alias("own_intent"), fallback.alias("fallback"),
        (~silent & (unplannable | yes("unsupported"))).alias("shows_period"),
        (~unplannable & ~topical & (yes("follow_up") | (named & yes("switch")))).alias("inherits"),
    )


def follow_up_plans(turns: DataFrame, rows_per_chunk: int = 100_000) -> DataFrame:
    """CMP-24: plan of each turn with security, period and intent inherited from earlier turns.

    ``turns``: session_id, turn and the columns of ``question_features``. The walk carries the
    security, intent and period of the last planned turn; a turn that needs clarification leaves
    them as they are, an inherited period is stored again, and a term's question keeps the period.
    """
    about_security = {name for name, (_, _, security) in fixed.INTENT_MATRIX.items() if security}

    def step(run: list[Any], state: Any) -> tuple[list[dict[str, Any]], Any]:
        security, intent, start, end = state or [None] * 4
        found = []
        for turn in run:
            taken = intent if turn.inherits and intent in about_security else turn.own_intent
            scoped = taken in about_security
            subject = turn.security_id or (security if scoped else None)
            planned = taken is not None and (subject is not None or not scoped)
            first, last = turn.period_start, turn.period_end if turn.period_start else None
            if planned:
                if scoped and not (first or turn.period_explicit):
                    first, last = start, end
                if taken == "price_move" and not first:
                    first = last = turn.basis_day
                security, intent = subject or security, taken
                if taken != "financial_term":
                    start, end = first, last
            elif taken is None and not turn.shows_period:
                first = last = None
            found.append({
                "plan_intent": taken or turn.fallback, "plan_security": subject if planned else None, "plan_start": first, "plan_end": last,
                "plan_clarify": "false" if planned else "true",
            })
        return found, [security, intent, start, end]

    result = text_result("plan_intent", "plan_security", "plan_start", "plan_end", "plan_clarify")
    facts = turn_facts(turns)
    planned = ordered_scan(facts, "session_id", ["turn"], step, result, rows_per_chunk, tuples=True)
    return planned.drop("own_intent", "fallback", "shows_period", "inherits")


def admission(
    requests: DataFrame, client: str = "client", window: int = fixed.ADMISSION_WINDOW_SECONDS, limit: int = fixed.ADMISSION_WINDOW_LIMIT,
    daily: int = fixed.ADMISSION_DAY_LIMIT, zone: str = fixed.LOCAL_ZONE, rows_per_chunk: int = 100_000,
) -> DataFrame:
    """STR-01 over a table: admitted or refused, refusals not counting towards the limits.

    ``requests``: the client, ``ts`` and ``request_id``. State is the admitted times of the last
    window and the count of the local day. Where ``requests`` has a column ``closed``, a request for
    which it is true is refused whatever its client did, and is not counted.
    """
    gated = "closed" in requests.columns
    rows = requests.withColumn("at", F.unix_micros("ts")).withColumn("day", times.local_day("ts", zone).cast("string")).withColumn(
        client, F.col(client).cast("string")
    )
    span = window * 1_000_000

    def step(run: list[Any], state: Any) -> tuple[list[dict[str, Any]], Any]:
        state = state or {"times": [], "day": None, "count": 0}
        recent, day, count = list(state["times"]), state["day"], state["count"]
        found = []
        for row in run:
            at, today, closed = int(row.at), row.day, gated and row.closed
            if today != day:
                day, count = today, 0
            recent = [t for t in recent if t > at - span]
            good = len(recent) < limit and count < daily and not closed
            if good:
                recent.append(at)
                count += 1
            found.append({"decision": "admitted" if good else "refused"})
        return found, {"times": recent, "day": day, "count": count}

    return ordered_scan(rows, client, ["at", "request_id"], step, text_result("decision"), rows_per_chunk, tuples=True).drop("at")


def admission_within_global_limit(
    requests: DataFrame, limit: int = fixed.ADMISSION_GLOBAL_DAY_LIMIT, zone: str = fixed.LOCAL_ZONE, rows_per_chunk: int = 100_000
) -> DataFrame:
    """STR-01 with the limit on all clients' requests of a local day; what it refuses fills no client's window.

    A day is open until its ``limit``-th admission; where that lies depends on the day before only.
    So the walk is repeated with the closing places found so far until they stay: one more time
    than days in a row whose closing changes the next one's.
    """
    rows = cut_lineage(requests.withColumn("__day", times.local_day("ts", zone).cast("string")))
    place = F.struct("ts", "request_id")
    closing = None
    while True:
        if closing is None:
            gated = rows.withColumn("closed", F.lit(False))
        else:
            gated = spread_join(rows, closing, ["__day"], "left").withColumn("closed", F.coalesce(place > F.col("__last"), F.lit(False))).drop("__last")
        decided = cut_lineage(admission(gated, zone=zone, rows_per_chunk=rows_per_chunk))
        held = decided.where("decision = 'admitted'")
        found = top_rows(held, ["__day"], [F.col("ts"), F.col("request_id")], limit, "__nth").where(F.col("__nth") == limit)
        found = cut_lineage(found.select("__day", place.alias("__last")))
        if closing is not None and found.exceptAll(closing).isEmpty() and closing.exceptAll(found).isEmpty():
            return decided.drop("closed", "__day")
        closing = found


def suppress_repeats(requests: DataFrame, keys: list[str], ttl: int = fixed.REPEAT_TTL_SECONDS, rows_per_chunk: int = 100_000) -> DataFrame:
    """STR-02 over a table: requests whose answer a request of the same key within ``ttl`` seconds already gave."""
    rows = requests.withColumn("repeat_key", F.sha2(F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}), 256)).withColumn("at", F.unix_micros("ts"))
    span = ttl * 1_000_000
    # Two results serve all rows.
    computed, repeated = {"served": "computed"}, {"served": "repeated"}

    def step(run: list[Any], state: Any) -> tuple[list[dict[str, Any]], Any]:
        found = []
        for row in run:
            fresh = state is None or int(row.at) - state >= span
            state = int(row.at) if fresh else state
            found.append(computed if fresh else repeated)
        return found, state

    return ordered_scan(rows, "repeat_key", ["at", "request_id"], step, text_result("served"), rows_per_chunk, [], tuples=True).drop("at", "repeat_key")


def session_gaps(requests: DataFrame, key: str, gap: int = fixed.SESSION_GAP_SECONDS, bucket_seconds: int = 86_400) -> DataFrame:
    """STR-03 over a table: session number of each request; a pause of ``gap`` seconds or more starts a new one.

    Windows span one (key, time bucket); the last time and the number of breaks of earlier buckets
    come from one row per bucket, so a hot key spreads over its buckets.
    """
    rows = requests.withColumn("__at", F.unix_micros("ts")).withColumn("__bucket", F.floor(F.unix_timestamp("ts") / bucket_seconds))
    inside = Window.partitionBy(key, "__bucket").orderBy("__at", "request_id")
    earlier = Window.partitionBy(key).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    bounds = rows.groupBy(key, "__bucket").agg(F.max("__at").alias("__last"))
    carried = bounds.select(key, "__bucket", F.max("__last").over(earlier).alias("__before"))
    linked = rows.join(carried, [key, "__bucket"])
    previous = F.coalesce(F.lag("__at").over(inside), F.col("__before"))
    flagged = linked.withColumn("__break", (previous.isNull() | (F.col("__at") - previous >= gap * 1_000_000)).cast("int"))
    breaks = flagged.groupBy(key, "__bucket").agg(F.sum("__break").alias("__breaks"))
    offsets = breaks.select(key, "__bucket", F.coalesce(F.sum("__breaks").over(earlier), F.lit(0)).alias("__offset"))
    number = F.sum("__break").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)) + F.col("__offset")
    return flagged.join(offsets, [key, "__bucket"]).withColumn("session_number", number.cast("bigint")).drop(
        "__at", "__bucket", "__before", "__break", "__offset"
    )
