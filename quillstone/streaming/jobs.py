"""Job state, rate limits, breakers and idempotent intake, for tables and streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..schemas import DEFAULTS, Params


def latest_state(events: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The current state of each job: its last event. Pre-aggregates, so it also runs on a
    stream in complete or update mode."""
    rest = [c for c in events.columns if c != key]
    last = events.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("s"))
    return last.select(key, *[F.col(f"s.{c}").alias(c) for c in rest])


def calls_in_window(events: DataFrame, key: str, at: str, seconds: int) -> DataFrame:
    """Adds ``in_window``: events of the key in the ``seconds`` up to each, the far end left out."""
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    w = Window.partitionBy(key).orderBy(micros).rangeBetween(-(seconds * 1_000_000 - 1), 0)
    return events.withColumn("in_window", F.count(F.lit(1)).over(w))


def within_limit(events: DataFrame, key: str, at: str, params: Params = DEFAULTS) -> DataFrame:
    return calls_in_window(events, key, at, 60).withColumn("allowed", F.col("in_window") <= params.calls_per_minute)


def breaker_state(events: DataFrame, key: str, at: str, cooldown: Column) -> DataFrame:
    """Adds ``is_open``: whether an earlier failure's cooldown (seconds, null for no failure)
    still runs at each event."""
    until = F.unix_micros(F.col(at).cast("timestamp")) + cooldown.cast("long") * 1_000_000
    earlier = Window.partitionBy(key).orderBy(at, "event_id").rowsBetween(Window.unboundedPreceding, -1)
    df = events.withColumn("__until", until).withColumn("__open_until", F.max("__until").over(earlier))
    is_open = F.coalesce(F.col("__open_until") > F.unix_micros(F.col(at).cast("timestamp")), F.lit(False))
    return df.withColumn("is_open", is_open).drop("__until", "__open_until")


def first_usable(columns: list[str]) -> Column:
    """A cascade of providers: the first one with a result."""
    return F.coalesce(*[F.col(c) for c in columns])


def cooldown_seconds(error_class: Column, params: Params = DEFAULTS) -> Column:
    return F.when(error_class == "quota", params.quota_cooldown_s).when(error_class == "unavailable", params.unavailable_cooldown_s)


def first_uploads(stream: DataFrame, key: list[str], event_time: str, lateness: str = "1 hour") -> DataFrame:
    """Drops repeats of a key within the lateness; state older than it is let go."""
    return stream.withWatermark(event_time, lateness).dropDuplicatesWithinWatermark(key)


def run_once(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str):
    """Hand all there is to ``apply`` batch by batch and stop; the checkpoint makes a rerun go on."""
    query = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def limiter_stream(stream: DataFrame, key: str, at: str, params: Params = DEFAULTS) -> DataFrame:
    """Calls of a key per minute with a flag for those over the limit, in event time."""
    minute = F.window(at, "60 seconds")
    counts = stream.withWatermark(at, "5 minutes").groupBy(key, minute).agg(F.count(F.lit(1)).alias("calls"))
    return counts.select(key, F.col("window.start").alias("minute"), "calls", (F.col("calls") > params.calls_per_minute).alias("over"))
