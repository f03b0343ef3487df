"""Streaming jobs: the batch checks, run continuously on arriving data.

Every job takes a streaming DataFrame, an output path and a checkpoint path, and returns
the started query. ``trigger`` is passed to the writer: ``processingTime`` in production,
``availableNow`` to drain what has landed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from dqengine.operators.learning import FULL_CONFIDENCE_ATTEMPTS
from dqengine.operators.profile import find_issues, quality_report
from dqengine.schemas import DEFAULT_THRESHOLDS, RULES, SeverityThresholds
from dqengine.sources.feeds import feed_records, records_table, rejected_payloads

EVERY_HALF_MINUTE = {"processingTime": "30 seconds"}
DRAIN = {"availableNow": True}


def landed_files(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """Parquet files arriving in a folder, with the schema of those already there."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def landed_payloads(spark: SparkSession, path: str) -> DataFrame:
    """Payload lines arriving in a folder, as ``payload``."""
    return spark.readStream.text(path).select(F.col("value").alias("payload"))


def _start(df: DataFrame, out: str, checkpoint: str, trigger: dict, mode: str = "append") -> StreamingQuery:
    return (
        df.writeStream.format("parquet")
        .outputMode(mode)
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )


def ingest_feed(
    payloads: DataFrame, schema: str, out: str, checkpoint: str, trigger: dict = EVERY_HALF_MINUTE
) -> StreamingQuery:
    """Rows of payloads of any shape as they land; the columns must be given.

    A series gives its rows also if it has only one. ``keep_rejected`` keeps the payloads
    that cannot be read.
    """
    return _start(records_table(feed_records(payloads, least=1), schema), out, checkpoint, trigger)


def keep_rejected(
    payloads: DataFrame, out: str, checkpoint: str, trigger: dict = EVERY_HALF_MINUTE
) -> StreamingQuery:
    """Payloads that cannot be read, with the reason, as they land."""
    return _start(rejected_payloads(payloads), out, checkpoint, trigger)


def score_batches(
    rows: DataFrame,
    name: str,
    out: str,
    checkpoint: str,
    trigger: dict = EVERY_HALF_MINUTE,
    limits: SeverityThresholds = DEFAULT_THRESHOLDS,
) -> StreamingQuery:
    """Profile every arriving batch; writes ``scores``, ``issues`` and ``alerts`` below ``out``.

    Each batch owns the folder of its id and overwrites it, so a replayed batch leaves the
    same result.
    """

    def profile(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        folder = f"batch_id={batch_id}"
        find_issues(batch, limits).write.mode("overwrite").parquet(f"{out}/issues/{folder}")
        issues = batch.sparkSession.read.parquet(f"{out}/issues/{folder}")
        report = quality_report(batch, name, issues)
        report.write.mode("overwrite").parquet(f"{out}/scores/{folder}")
        low = (F.col("quality_score") < RULES.alert_score) & (F.col("quality_score") > 0)
        batch.sparkSession.read.parquet(f"{out}/scores/{folder}").where(low).write.mode(
            "overwrite"
        ).parquet(f"{out}/alerts/{folder}")

    return (
        rows.writeStream.foreachBatch(profile)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )


def window_metrics(
    events: DataFrame,
    time: str,
    length: str = "1 hour",
    slide: str | None = None,
    delay: str = "10 minutes",
    keys: Sequence[str] = (),
    measures: Sequence[Column] = (),
) -> DataFrame:
    """Event-time metrics per tumbling or sliding window; later data than ``delay`` is dropped."""
    frame = F.window(time, length, slide) if slide else F.window(time, length)
    grouped = events.withWatermark(time, delay).groupBy(frame, *keys)
    return (
        grouped.agg(F.count("*").alias("rows"), *measures)
        .withColumns(
            {"window_start": F.col("window.start"), "window_end": F.col("window.end")}
        )
        .drop("window")
    )


def write_stream(
    df: DataFrame, out: str, checkpoint: str, trigger: dict = EVERY_HALF_MINUTE
) -> StreamingQuery:
    """Append a streaming result to a folder."""
    return _start(df, out, checkpoint, trigger)


STALL_MINUTES = 10


def stalled_jobs(
    events: DataFrame, is_start: Column, key: str, time: str, delay: str = "1 minute"
) -> DataFrame:
    """Starts that no later event of the same key followed within ten minutes.

    A left outer stream-stream join: the watermark, taken from all events, is the timer.
    The join key also holds the ten-minute slot, which spreads the events of one busy key
    over the state store.
    """
    seconds = STALL_MINUTES * 60

    def slot(column: str) -> Column:
        return F.floor(F.unix_seconds(F.col(column)) / seconds)

    timed = events.withWatermark(time, delay)
    begun = timed.where(is_start).withColumn("__slot", slot(time))
    later = timed.select(F.col(key).alias("__key"), F.col(time).alias("__later")).withColumn(
        "__at", F.explode(F.array(slot("__later"), slot("__later") - 1))
    )
    followed = (
        (F.col(key) == F.col("__key"))
        & (F.col("__slot") == F.col("__at"))
        & (F.col("__later") > F.col(time))
        & (F.col("__later") <= F.col(time) + F.expr(f"interval {STALL_MINUTES} minutes"))
    )
    return (
        begun.join(later, followed, "left_outer")
        .where("__key is null")
        .drop("__slot", "__key", "__later", "__at")
    )


def drop_repeated(events: DataFrame, keys: Sequence[str], time: str, delay: str = "1 hour") -> DataFrame:
    """First arrival of every key; state is kept for ``delay`` only."""
    return events.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(keys))


def count_patterns(
    outcomes: DataFrame, out: str, checkpoint: str, trigger: dict = EVERY_HALF_MINUTE
) -> StreamingQuery:
    """Running attempts and successes per agent and pattern; writes what changed per batch."""
    counted = outcomes.groupBy(
        "agent_name", F.concat_ws("_", "action_type", "context").alias("pattern")
    ).agg(
        F.count("*").alias("attempts"),
        F.count_if(F.col("success_score") == 1.0).alias("successes"),
    )

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    return (
        counted.writeStream.outputMode("update")
        .foreachBatch(save)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )


def current_patterns(spark: SparkSession, out: str) -> DataFrame:
    """Latest counts of every pattern written by ``count_patterns``."""
    state = F.struct("attempts", "successes")
    return (
        spark.read.parquet(out)
        .groupBy("agent_name", "pattern")
        .agg(F.max_by(state, "batch_id").alias("s"))
        .select(
            "agent_name",
            "pattern",
            "s.attempts",
            "s.successes",
            (F.col("s.successes") / F.col("s.attempts")).alias("success_rate"),
            F.least(F.col("s.attempts") / float(FULL_CONFIDENCE_ATTEMPTS), F.lit(1.0)).alias("confidence"),
        )
    )
