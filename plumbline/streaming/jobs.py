"""The reliability jobs over streams.

Event times must be ``timestamp``; tables written without a time zone load as
``timestamp_ntz`` and are cast first.  Checkpoints and sinks live in the shared
folder of the cluster, so a restarted driver or a lost executor resumes.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from plumbline.operators.assertions import Unique
from plumbline.operators.governance import check_compliance, decide
from plumbline.operators.probes import Probe
from plumbline.operators.replay import select_traces
from plumbline.operators.suites import Suite, run_suite
from plumbline.session import is_folder, path_exists, scratch_path
from plumbline.sources.documents import TRACE_SCHEMA


def file_stream(spark: SparkSession, folder: str, name: str, time_column: str = "ts", per_trigger: int | None = None, bytes_per_trigger: int | None = None) -> DataFrame:
    """The files of one table, a single file or a folder of part files, as a stream with a proper event time.

    ``per_trigger`` bounds the files of a micro-batch, or ``bytes_per_trigger`` their bytes, which suits files of any
    size and number; without them a backlog is one batch.
    """
    path = f"{folder}/{name}.parquet"
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    if bytes_per_trigger is not None:
        reader = reader.option("maxBytesPerTrigger", bytes_per_trigger)
    # a stream reads folders, so a single file is picked out of its own
    stream = reader.parquet(path) if is_folder(spark, path) else reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder)
    return stream.withColumn(time_column, F.col(time_column).cast("timestamp"))


def probe_windows(
    events: DataFrame,
    probes: Sequence[Probe],
    duration: str = "1 day",
    slide: str | None = None,
    delay: str = "1 hour",
    time_column: str = "ts",
) -> DataFrame:
    """All probes per time window; also runs on a static frame, where nothing is late."""
    checks = [p.check() for p in probes]
    aggregates, rows = [], []
    for i, check in enumerate(checks):
        aggregates += [c.alias(f"__c{i}_{n}") for n, c in check.aggregates.items()]
        rows.append(check.row(lambda n, i=i: F.col(f"__c{i}_{n}")))
    timed = events.withWatermark(time_column, delay) if events.isStreaming else events
    window = F.window(time_column, duration, slide) if slide else F.window(time_column, duration)
    totals = timed.groupBy(window.alias("w")).agg(*aggregates)
    return totals.select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), F.inline(F.array(*rows))
    )


def decision_stream(requests: DataFrame, contracts: DataFrame, strict: bool = True, breach_is_error: bool = True) -> DataFrame:
    """Decision on each incoming request; stateless, the contracts are a static side."""
    return decide(check_compliance(requests, contracts), strict, breach_is_error)


_BROKEN = "__broken"


def _trace_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of a growing folder with the trace each holds; the text stays for those that hold none."""
    schema = f"{TRACE_SCHEMA}, {_BROKEN} string"
    parsed = F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BROKEN})
    return spark.readStream.text(folder).where(F.trim("value") != "").select("value", parsed.alias("row"))


def _is_broken() -> Column:
    return F.col("row").isNull() | F.col(f"row.{_BROKEN}").isNotNull()


def trace_stream(spark: SparkSession, folder: str, delay: str = "1 hour") -> DataFrame:
    """Replayable traces of a growing folder, each trace id once within the delay; ``trace_rejects`` has the other lines."""
    traces = _trace_lines(spark, folder).where(~_is_broken()).select("row.*").drop(_BROKEN)
    return unique_traces(traces.withColumn("event_time", F.timestamp_seconds("timestamp")), delay)


def trace_rejects(spark: SparkSession, folder: str) -> DataFrame:
    """The malformed lines of the same folder, to be run into a table of their own."""
    return _trace_lines(spark, folder).where(_is_broken()).select(F.col("value").alias("line"))


def unique_traces(traces: DataFrame, delay: str = "1 hour", time_column: str = "event_time") -> DataFrame:
    timed = select_traces(traces).withWatermark(time_column, delay)
    return timed.dropDuplicatesWithinWatermark(["trace_id"])


def run_to_table(stream: DataFrame, label: str, path: str | None = None) -> str:
    """Process everything that is there now into a parquet folder and return it (append mode)."""
    spark = stream.sparkSession
    target = path or scratch_path(spark, label)
    query = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", f"{target}/_plumbline_checkpoint")
        .trigger(availableNow=True)
        .start(f"{target}/data")
    )
    query.awaitTermination()
    return f"{target}/data"


def suite_per_batch(
    stream: DataFrame, suite: Suite, target: str, tables: Callable[[], dict[str, DataFrame]] | None = None
) -> StreamingQuery:
    """Run a suite on each micro-batch; results land under their batch id.

    Each batch is judged on its own: ``Unique`` and ``Grain`` see repeats within a batch;
    :func:`suite_across_batches` sees those across batches as well.
    A batch that is retried overwrites its own folder, so results stay exact.
    """

    def check(batch: DataFrame, batch_id: int) -> None:
        batch.persist()  # read once for all assertions of the suite
        try:
            results = run_suite(batch, suite, tables() if tables else None)
            results.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(
                f"{target}/data/batch={batch_id:012d}"
            )
        finally:
            batch.unpersist()

    return (
        stream.writeStream.foreachBatch(check)
        .option("checkpointLocation", f"{target}/_plumbline_checkpoint")
        .trigger(availableNow=True)
        .start()
    )


def repeated_keys(stream: DataFrame, keys: Sequence[str], time: str | None = None, within: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Keys (none of them NULL) met more than once, whatever batches their rows came in: key columns, ``window_start``, ``n``.

    Counts are Spark's own keyed state: tasks add up their rows first, so a hot key is one
    row from each.  With ``within`` a key may occur once in each event-time window of
    that length, and the state of a window is dropped when the watermark, ``delay`` behind the latest
    event, has passed its end; later rows for it are dropped too.  Without it the state keeps every key for good.  To be
    written in update mode: a row is the count so far, and only repeated keys leave the state.
    """
    held = F.lit(True)
    for k in keys:
        held = held & F.col(k).isNotNull()
    rows = stream.where(held)
    names = [f"key{i}" for i in range(len(keys))]
    columns = [F.col(k).alias(n) for k, n in zip(keys, names, strict=True)]
    if within is None:
        counts = rows.groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).withColumn("window_start", F.lit(None).cast("timestamp"))
    else:
        slots = rows.withWatermark(time, delay).groupBy(F.window(time, within).alias("slot"), *columns)
        counts = slots.agg(F.count(F.lit(1)).alias("n")).withColumn("window_start", F.col("slot.start"))
    return counts.where("n > 1").select(*[F.col(n).alias(k) for n, k in zip(names, keys, strict=True)], "window_start", "n")


def suite_across_batches(
    stream: DataFrame,
    suite: Suite,
    target: str,
    tables: Callable[[], dict[str, DataFrame]] | None = None,
    time: str | None = None,
    within: str | None = None,
    delay: str = "1 hour",
) -> None:
    """Run a suite over everything that has arrived: ``Unique`` and ``Grain`` on keyed state, the others on each micro-batch.

    Runs to the end of what is there.  Each micro-batch walks through the whole state and stores it, so its size should be
    bounded by bytes, not by one file of many.  Called again with the same ``target``, also by a
    new driver, it goes on where it stopped: offsets, state and results are below it.  A retried batch overwrites its own folder.
    """
    keyed = [a for a in suite.assertions if isinstance(a, Unique)]
    rest = Suite(suite.name, [a for a in suite.assertions if a not in keyed])
    running = [suite_per_batch(stream, rest, f"{target}/rest", tables)] if rest.assertions else []
    for assertion in keyed:
        place = f"{target}/keyed/{assertion.label}"

        def store(batch: DataFrame, batch_id: int, place=place) -> None:
            batch.write.mode("overwrite").parquet(f"{place}/data/batch={batch_id:012d}")

        counts = repeated_keys(stream, assertion.columns, time, within, delay)
        query = counts.writeStream.outputMode("update").foreachBatch(store).option("checkpointLocation", f"{place}/_plumbline_checkpoint")
        running.append(query.trigger(availableNow=True).start())
    for query in running:
        query.awaitTermination()


def suite_so_far(spark: SparkSession, suite: Suite, target: str) -> DataFrame:
    """One row per assertion over all batches that :func:`suite_across_batches` has judged: suite, name, passed, violations, observed.

    A key's last count is its largest; an assertion without any result has nothing against it.
    """
    parts = []
    for assertion in suite.assertions:
        keyed = isinstance(assertion, Unique)
        place = f"{target}/keyed/{assertion.label}/data" if keyed else f"{target}/rest/data"
        if not path_exists(spark, place):
            parts.append(spark.range(1).select(F.lit(assertion.label).alias("name"), F.lit(0).cast("bigint").alias("violations"), F.lit(0.0).alias("observed")))
            continue
        stored_rows = spark.read.parquet(place)
        if keyed:
            found = stored_rows.groupBy(*assertion.columns, "window_start").agg(F.max("n").alias("n"))
            sums = F.count(F.lit(1)).alias("violations"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("double").alias("observed")
        else:
            found = stored_rows.where(F.col("name") == assertion.label)
            sums = F.coalesce(F.sum("violations"), F.lit(0)).alias("violations"), F.coalesce(F.sum("observed").cast("double"), F.lit(0.0)).alias("observed")
        parts.append(found.agg(*sums).select(F.lit(assertion.label).alias("name"), "violations", "observed"))
    rows = reduce(DataFrame.unionByName, parts)
    return rows.select(F.lit(suite.name).alias("suite"), "name", (F.col("violations") == 0).alias("passed"), "violations", "observed")


def closed_windows(result: DataFrame, latest: Column, delay: str = "1 hour") -> DataFrame:
    """Windows that a watermark at ``latest - delay`` has closed."""
    return result.where(F.col("window_end") <= latest - F.expr(f"INTERVAL {delay}"))
