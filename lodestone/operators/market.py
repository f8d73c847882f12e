"""Point-in-time prices: bar parsing, as-of joins, checkpoint grids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone import fixed_values as fixed
from lodestone.functions import times

PRICE = "decimal(18,6)"


def parse_bars(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SRC-04: minute bars from text columns, and the rejected rows with their reason.

    ``rows``: security_id, day, clock, price, open, high, low, volume (all text).
    """
    observed = F.to_utc_timestamp(F.try_to_timestamp(F.concat("day", "clock"), F.lit("yyyyMMddHHmmss")), fixed.LOCAL_ZONE)
    numbers = {name: F.col(name).try_cast(PRICE) for name in ("price", "open", "high", "low")}
    parsed = rows.withColumn("observed_at", observed).withColumns(numbers).withColumn("volume", F.col("volume").try_cast("bigint"))
    copies = parsed.groupBy("security_id", "observed_at").agg(F.count(F.lit(1)).alias("__copies"))
    joined = parsed.join(copies, ["security_id", "observed_at"], "left")
    low_side, high_side = F.least("open", "price"), F.greatest("open", "price")
    reason = (
        F.when(F.col("observed_at").isNull(), F.lit("time"))
        .when(F.col("price").isNull() | F.col("open").isNull() | F.col("high").isNull() | F.col("low").isNull(), F.lit("number"))
        .when(F.least("price", "open", "high", "low") <= 0, F.lit("not_positive"))
        .when(F.coalesce(F.col("volume") < 0, F.lit(True)), F.lit("volume"))
        .when((F.col("low") > low_side) | (high_side > F.col("high")), F.lit("range"))
        .when(F.col("__copies") > 1, F.lit("duplicate"))
    )
    judged = joined.withColumn("reason", reason).drop("__copies")
    return judged.where(F.col("reason").isNull()).drop("reason"), judged.where(F.col("reason").isNotNull())


def asof_join(
    left: DataFrame, right: DataFrame, on: Sequence[str], left_ts: str, right_ts: str, values: Sequence[str], bucket_seconds: int = 3600,
) -> DataFrame:
    """JOI-07: latest right row at or before each left row, per key; nulls when there is none.

    Time is cut into buckets so that a hot key spreads over many tasks: inside a bucket a window
    carries the last right row forward, and the last row of the earlier buckets enters as a row of
    its own. Only one row per (key, bucket) takes part in the carry.
    """
    def bucket(ts: str) -> Column:
        return F.floor(F.unix_timestamp(ts) / bucket_seconds)

    found = F.struct(F.col(right_ts).alias("matched_ts"), *values)
    bars = right.select(*on, F.col(right_ts).alias("__ts"), bucket(right_ts).alias("__bucket"), found.alias("__found"))
    asks = left.withColumn("__ts", F.col(left_ts)).withColumn("__bucket", bucket(left_ts))
    keys = [*on, "__bucket"]
    last = bars.groupBy(*keys).agg(F.max_by("__found", "__ts").alias("__last"))
    cells = asks.select(*keys).distinct().join(last, keys, "full_outer")
    earlier = Window.partitionBy(*on).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = cells.withColumn("__found", F.last("__last", ignorenulls=True).over(earlier)).where(F.col("__found").isNotNull())
    carry_rows = carried.select(*on, F.col("__found.matched_ts").alias("__ts"), "__bucket", "__found")
    payload = F.struct(*[F.col(name) for name in left.columns])
    events = (
        asks.select(*keys, "__ts", F.lit(1).alias("__side"), payload.alias("__left"), F.lit(None).cast(bars.schema["__found"].dataType).alias("__found"))
        .unionByName(bars.unionByName(carry_rows.select(*bars.columns)).withColumn("__side", F.lit(0)).withColumn(
            "__left", F.lit(None).cast(asks.select(payload.alias("p")).schema["p"].dataType)
        ))
    )
    spec = Window.partitionBy(*keys).orderBy("__ts", "__side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    matched = events.withColumn("__match", F.last("__found", ignorenulls=True).over(spec)).where(F.col("__side") == 1)
    return matched.select("__left.*", "__match.*")


def latest_in_range(snapshots: DataFrame, requests: DataFrame, bucket_days: int = 31) -> DataFrame:
    """JOI-08: newest snapshot of each request's security inside its day range.

    The newest one up to the end day is an as-of match on days, and it counts when it does not lie
    before the start day; so no request meets more than one snapshot of its security.
    """
    keys = ["security_id", "trading_date"]
    values = [name for name in snapshots.columns if name not in keys]
    newest = snapshots.groupBy(*keys).agg(F.max_by(F.struct(*values), "observed_at").alias("snapshot"))
    days = newest.withColumn("day_at", F.col("trading_date").cast("timestamp"))
    last_day = F.coalesce(F.col("end_day"), F.lit("9999-12-30").cast("date")).cast("timestamp")
    matched = asof_join(
        requests.withColumn("until", last_day), days, ["security_id"], "until", "day_at", ["trading_date", "snapshot"], bucket_days * 86_400
    )
    found = matched.where(F.col("trading_date").isNotNull() & (F.col("start_day").isNull() | (F.col("trading_date") >= F.col("start_day"))))
    return found.select(*requests.columns, "trading_date", "snapshot.*")


def daily_closes(bars: DataFrame, security: str = "security_id") -> DataFrame:
    """Last price of every local day."""
    return bars.withColumn("day", times.local_day("observed_at")).groupBy(security, "day").agg(
        F.max_by("price", "observed_at").alias("close")
    )


def price_changes(closes: DataFrame, security: str = "security_id") -> DataFrame:
    """WIN-12: change, percent and direction against the previous close; one row per security and day."""
    spec = Window.partitionBy(security).orderBy("day")
    rows = closes.withColumn("previous_close", F.lag("close").over(spec)).withColumn("change", F.col("close") - F.col("previous_close"))
    return rows.withColumn("change_percent", percent_change("close", "previous_close")).withColumn("direction", direction(F.col("change")))


def percent_change(price: str, previous: str) -> Column:
    """Percent against the previous price; null when that is zero."""
    return F.bround(F.try_divide(((F.col(price) - F.col(previous)) * 100).cast("decimal(30,12)"), F.col(previous)), 6)


def direction(change: Column) -> Column:
    return F.when(change > 0, F.lit("up")).when(change < 0, F.lit("down")).when(change == 0, F.lit("flat"))


def checkpoint_prices(bars: DataFrame, checkpoints: Sequence[str], security: str = "security_id") -> DataFrame:
    """JOI-09: last bar at or before each checkpoint of a fixed grid, per security; days without bars carry forward.

    A bar counts towards the first checkpoint it does not pass, so the bars shrink to one row per
    (security, checkpoint) on the map side before anything is shuffled or carried.
    """
    marks = sorted(checkpoints)
    grid = F.array(*[F.lit(mark).cast("timestamp") for mark in marks])
    place = F.size(F.filter(grid, lambda mark: mark < F.col("observed_at")))
    last = bars.where(place < len(marks)).groupBy(security, place.alias("place")).agg(
        F.max_by(F.struct("observed_at", "price"), "observed_at").alias("bar")
    )
    cells = bars.select(security).distinct().select(security, F.posexplode(grid).alias("place", "requested_as_of"))
    running = Window.partitionBy(security).orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = cells.join(last, [security, "place"], "left").withColumn("bar", F.last("bar", ignorenulls=True).over(running))
    return filled.select(security, "requested_as_of", F.col("bar.observed_at").alias("observed_at"), F.col("bar.price").alias("price"))


def previous_closes(closes: DataFrame, trading_days: Sequence[str], security: str = "security_id") -> DataFrame:
    """Close of the trading day before each trading day."""
    days = sorted(trading_days)
    table = F.array(*[
        F.struct(F.lit(day).cast("date").alias("day"), F.lit(nxt).cast("date").alias("next_day")) for day, nxt in zip(days, days[1:], strict=False)
    ])
    return closes.withColumn("step", F.get(F.filter(table, lambda s: s["day"] == F.col("day")), F.lit(0))).where(F.col("step").isNotNull()).select(
        security, F.col("step.next_day").alias("trading_date"), F.col("close").alias("previous_close")
    )


def market_checkpoints(bars: DataFrame, checkpoints: Sequence[str], trading_days: Sequence[str], security: str = "security_id") -> DataFrame:
    """CMP-19: snapshot rows over the checkpoint grid with previous close, change, session and status.

    On a closed day the last bar and the previous close of its own trading day carry forward.
    """
    prices = checkpoint_prices(bars, checkpoints, security)
    days = F.array(*[F.lit(day).cast("date") for day in sorted(trading_days)])
    is_trading = F.array_contains(days, times.local_day("requested_as_of"))
    rows = prices.withColumn("trading_date", times.local_day("observed_at")).join(
        previous_closes(daily_closes(bars, security), trading_days, security), [security, "trading_date"], "left"
    )
    change = F.col("price") - F.col("previous_close")
    return rows.select(
        security, times.checkpoint_id("requested_as_of").alias("checkpoint_id"), "requested_as_of", "trading_date", "observed_at", "price",
        "previous_close", change.alias("change"), percent_change("price", "previous_close").alias("change_percent"),
        times.market_session("requested_as_of", is_trading).alias("market_session"),
        times.market_status("requested_as_of", is_trading).alias("market_status"),
    )


def grid_gaps(snapshots: DataFrame, checkpoints: int, security: str = "security_id") -> DataFrame:
    """CMP-19: securities whose grid is incomplete or repeats a checkpoint."""
    counts = snapshots.groupBy(security).agg(F.count(F.lit(1)).alias("cells"), F.countDistinct("checkpoint_id").alias("distinct_cells"),
                                             F.count_if(F.col("price").isNull()).alias("without_price"))
    return counts.where((F.col("cells") != checkpoints) | (F.col("distinct_cells") != checkpoints) | (F.col("without_price") > 0))


def neighbours_within(rows: DataFrame, key: str, ts: str, seconds: int = fixed.EVENT_GAP_SECONDS, bucket_seconds: int = fixed.EVENT_GAP_SECONDS) -> DataFrame:
    """JOI-11: per row, how many other rows of its key lie at most ``seconds`` away, both ends included.

    Rank arithmetic: the rows of a key up to ``t + gap`` less those before ``t - gap``. Rows are counted per
    time first; running counts go over time buckets with one carry row each, so a hot key spreads
    over its buckets, whole rows are moved once and no pair or range window is formed. Rows without a key
    or a time have no neighbours and are left out.
    """
    gap = seconds * 1_000_000
    base = rows.withColumn("__at", F.unix_micros(F.col(ts))).where(F.col("__at").isNotNull() & F.col(key).isNotNull())
    times_of = base.groupBy(F.col(key).alias("__key"), F.col("__at").alias("__time")).agg(F.count(F.lit(1)).alias("__n"))
    # sign 0 counts the rows themselves; at equal times it comes before the looks at the two ends.
    mark = lambda sign, at, n: F.struct(F.lit(sign).alias("sign"), at.alias("at"), n.alias("n"))
    none = F.lit(0).cast("bigint")
    marks = times_of.select("__key", "__time", F.inline(F.array(
        mark(0, F.col("__time"), F.col("__n")), mark(1, F.col("__time") + gap, none), mark(-1, F.col("__time") - gap - 1, none)
    ))).withColumn("bucket", F.floor(F.col("at") / F.lit(bucket_seconds * 1_000_000)))
    inside = Window.partitionBy("__key", "bucket").orderBy("at", F.abs("sign")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.partitionBy("__key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    carry = marks.groupBy("__key", "bucket").agg(F.sum("n").alias("held")).select("__key", "bucket", F.coalesce(F.sum("held").over(earlier), F.lit(0)).alias("carry"))
    looks = marks.withColumn("upto", F.sum("n").over(inside)).where("sign <> 0").join(carry, ["__key", "bucket"])
    counted = looks.groupBy("__key", "__time").agg((F.sum(F.col("sign") * (F.col("upto") + F.col("carry"))) - 1).alias("neighbours"))
    same = (F.col(key) == F.col("__key")) & (F.col("__at") == F.col("__time"))
    return base.join(counted, same).drop("__at", "__key", "__time")
