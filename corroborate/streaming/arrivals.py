"""Release arrivals as streams: the batch operators on what has come since the last run.

Each stream runs over the files that are there (``availableNow``) and keeps its progress and state in a checkpoint, so a
restart goes on where the last run stopped and counts nothing twice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.evidence import tightest, with_roles
from ..sources.releases import scratch


#: Files a batch, for streams that take all that has come at once.
ALL_FILES = 1_000_000


def read_arrivals(spark: SparkSession, path: str, schema, files_a_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(path)


def run_available(stream: DataFrame, mode: str, path: str, checkpoint: str, each: Callable[[DataFrame, int], None] | None = None) -> None:
    """Process everything that has arrived and stop. Complete and update results are written a folder a batch."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if each is None and mode == "append":
        writer = writer.format("parquet").option("path", path)
    else:
        writer = writer.foreachBatch(each or (lambda batch, k: batch.withColumn("batch", F.lit(k)).write.mode("overwrite").parquet(f"{path}/batch={k}")))
    query = writer.start()
    query.awaitTermination()


def latest(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Of rows written in update mode, each key's last; a null is a key too."""
    rows = spark.read.option("basePath", path).parquet(path)
    others = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "batch").alias("__last")).select(*keys, *[F.col("__last")[c].alias(c) for c in others])


def curate_stream(events: DataFrame) -> DataFrame:
    """Row decisions of curation on a stream: kept or the first rule broken."""
    rule = F.when(F.col("event_type").isNull(), "missing_type").when(F.col("value").isNull(), "missing_value").when(F.col("value") <= 0, "no_magnitude")
    return events.withColumn("rule", rule)


def running_counts(events: DataFrame) -> DataFrame:
    return curate_stream(events).groupBy(F.coalesce("rule", F.lit("kept")).alias("rule"), "event_type").agg(F.count("*").alias("n"))


def distinct_keys(events: DataFrame, key: str, delay: str | None = None) -> DataFrame:
    """First sightings of each key. Without ``delay`` a key never comes twice, so the state holds every key: give the session the
    RocksDB store, which keeps it on disk. With ``delay``, keys are forgotten once repeats can no longer come.
    """
    if delay is None:
        return events.dropDuplicates([key]).select(key)
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark([key]).select(key)


def period_counts(events: DataFrame, width: str = "1 day", delay: str = "3 days") -> DataFrame:
    """Observations by the period of their own date; those that come more than ``delay`` after the newest are left out, and the
    state of a period ends then.
    """
    return events.withWatermark("ts", delay).groupBy(F.window("ts", width).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("period"), "n")


def running_intervals(obs: DataFrame) -> DataFrame:
    """Tightest bounds of each pair so far: the state is two bounds and a count, in any order of arrival."""
    lo, hi = tightest(F.col("c"))
    found = with_roles(obs).where("role = 'censored'").groupBy("item", "grp").agg(lo.alias("l"), hi.alias("h"), F.count("*").alias("n"))
    return found.select("item", "grp", "n", F.col("l.at").alias("lo"), F.col("h.at").alias("hi"))


def arrive_once(spark: SparkSession, registry: str, target: str) -> Callable[[DataFrame, int], None]:
    """A batch handler that takes each release once: it writes what each arrival is, and registers what is new.

    A release that is not known is absent, and loaded; one that is known by the same digest is no work; another digest of a
    known release is a conflict, and refused. Of several new digests in one batch the least is the release.

    Both folders hold one part a batch, and a batch reads the registry of the batches before it only. So a batch that runs
    again, because the query ended after the handler wrote and before the stream committed, finds what it found before.
    """

    def handle(batch: DataFrame, k: int) -> None:
        spark = batch.sparkSession
        spark.createDataFrame([], "release string, digest string").write.mode("overwrite").parquet(f"{registry}/batch=-1")
        earlier = spark.read.schema("release string, digest string, batch long").parquet(registry).where(F.col("batch") < k)
        known = earlier.groupBy("release").agg(F.min("digest").alias("known"))
        least = F.min("digest").over(Window.partitionBy("release"))
        came = batch.groupBy("release", "digest").agg(F.count("*").alias("times")).withColumn("least", least).join(known, "release", "left")
        state = F.when(F.coalesce("known", "least") != F.col("digest"), "conflict").when(F.col("known").isNotNull(), "ingested").otherwise("absent")
        came.select("release", "digest", state.alias("state")).write.mode("overwrite").parquet(f"{target}/batch={k}")
        written = spark.read.parquet(f"{target}/batch={k}")
        written.where("state = 'absent'").select("release", "digest").write.mode("overwrite").parquet(f"{registry}/batch={k}")

    return handle


def paths(spark: SparkSession, label: str) -> tuple[str, str]:
    """An output path and a checkpoint path."""
    base = scratch(spark, label)
    return f"{base}/out", f"{base}/checkpoint"


#: What a release goes through. ``arrived`` asks what is to be done with it, ``finished`` says that it was loaded.
EVENTS = "release string, digest string, event string, at timestamp"
_ANSWERS = "release string, digest string, state string, at timestamp"
_STATE = "digest string, finished boolean"


def release_machine(patience: str = "1 day"):
    """The registry of releases as keyed state: a value for each release, and a timer for one that is not finished.

    A release that nobody knows is ``absent`` and is loaded from now on; a known one is ``unparsed`` until it is said to be finished,
    then ``ingested`` and no work; another digest of it is a ``conflict``, whatever its state. Of several new digests in one batch the
    least is the release. Each answer bears the time of the last such arrival. When the stream's time passes ``patience`` after the last word of an unfinished release, it is ``stalled``.
    The state of a release is a digest and a flag; nothing is read again, however many releases there are.
    """
    from datetime import timedelta

    import pandas as pd
    from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

    amount, unit = patience.split()
    wait = int(timedelta(**{unit.rstrip("s") + "s": int(amount)}).total_seconds() * 1000)

    class Releases(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.known = handle.getValueState("known", _STATE)

        def handleInputRows(self, key, rows, timerValues: TimerValues):
            asked: dict[str, pd.Timestamp] = {}
            done: set[str] = set()
            latest = 0
            for frame in rows:
                for digest, event, at in zip(frame["digest"], frame["event"], frame["at"]):
                    latest = max(latest, int(at.timestamp() * 1000))
                    if event == "finished":
                        done.add(digest)
                    else:
                        asked[digest] = max(asked.get(digest, at), at)
            held = tuple(self.known.get()) if self.known.exists() else None
            fresh = held is None and bool(asked)
            if fresh:
                held = (min(asked), False)
            out = []
            for digest in sorted(asked):
                state = "conflict" if digest != held[0] else "absent" if fresh else "ingested" if held[1] else "unparsed"
                out.append((key[0], digest, state, asked[digest]))
            if held is not None:
                held = (held[0], held[1] or held[0] in done)
                self.known.update(held)
                for timer in list(self.handle.listTimers()):
                    self.handle.deleteTimer(timer)
                if not held[1]:
                    self.handle.registerTimer(latest + wait)
            yield pd.DataFrame(out, columns=["release", "digest", "state", "at"])

        def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo):
            held = tuple(self.known.get())
            over = pd.Timestamp(expiredTimerInfo.getExpiryTimeInMs(), unit="ms")
            yield pd.DataFrame([(key[0], held[0], "stalled", over)], columns=["release", "digest", "state", "at"])

        def close(self) -> None:
            pass

    return Releases()


def release_states(events: DataFrame, patience: str = "1 day", delay: str = "0 seconds") -> DataFrame:
    """The answers of ``release_machine`` to a stream of events (release, digest, event, at). The session needs the RocksDB state store."""
    return events.withWatermark("at", delay).groupBy("release").transformWithStateInPandas(release_machine(patience), _ANSWERS, "append", "EventTime")


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def state_on_disk(spark: SparkSession) -> Iterator[None]:
    """Streams that start within keep their state in RocksDB, so that a state of many keys does not fill the executors' memory."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def run_release_machine(spark: SparkSession, arrived: str, out: str, checkpoint: str, patience: str = "1 day") -> DataFrame:
    """Answer everything that has arrived in ``arrived`` and stop; returns all answers so far. A restart goes on with the state that it left."""
    with state_on_disk(spark):
        run_available(release_states(read_arrivals(spark, arrived, EVENTS), patience), "append", out, checkpoint)
    return spark.read.schema(_ANSWERS).parquet(out)
