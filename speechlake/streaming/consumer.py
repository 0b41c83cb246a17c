"""Jobs and heartbeats as streams: files that arrive in a folder are read in micro-batches, each handled once.

A checkpoint folder is the group of consumers: its offsets say what has been handed out, its
commits what has been acknowledged. A run that was stopped goes on with the batch that was not
committed; as every sink is a folder a batch, written over, nothing is lost or doubled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators import jobs

#: Seconds without a heartbeat after which a worker counts as lost: four heartbeats of 15 seconds.
SILENCE_S = 60


def arrivals(spark: SparkSession, folder: str, schema: StructType | str, prefetch: int = 1, fmt: str = "json") -> DataFrame:
    """The rows of the files that arrive in a folder, `prefetch` files a micro-batch."""
    return spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", prefetch).load(folder)


def batch_folder(sink: str, batch: int) -> str:
    return f"{sink}/batch={batch}"


def consume(rows: DataFrame, checkpoint: str, handle: Callable[[DataFrame], dict[str, DataFrame]], sinks: str, every: str | None = None) -> StreamingQuery:
    """Hands each micro-batch to `handle`, writes the tables it gives under `sinks`/<name>/batch=<n>, then commits.

    Without `every` (such as "15 seconds") it takes what has arrived by now and ends. A batch that
    comes again after a failure overwrites its own folders. An empty table leaves a folder without rows.
    """

    def one(batch: DataFrame, number: int) -> None:
        kept = batch.persist()
        try:
            for name, table in handle(kept).items():
                table.write.mode("overwrite").parquet(batch_folder(f"{sinks}/{name}", number))
        finally:
            kept.unpersist()

    writer = rows.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def outcomes(results: DataFrame, most: int = jobs.POISON) -> dict[str, DataFrame]:
    """Results of one batch (`jobs.route`) by where they go: acknowledged, dead or to be tried again."""
    routed = jobs.route(results, most)
    return {name: routed.where(F.col("sink") == sink) for name, sink in (("acked", "ACK"), ("dead", "DLQ"), ("retry", "RETRY"))}


def silent(beats: DataFrame, worker: str = "worker", at: str = "at", silence_s: int = SILENCE_S, late: str = "0 seconds") -> DataFrame:
    """(worker, first_beat, last_beat, lost_at, n_beats) of workers from whom nothing came for longer than allowed.

    A worker's heartbeats make a session that ends silence_s seconds after the last of them; on a
    stream in append mode a row comes out once the watermark is past that end. Heartbeats without
    a worker or a time count for nobody. Also runs on a plain table, where every session comes out.
    """
    known = beats.where(F.col(worker).isNotNull() & F.col(at).isNotNull()).withWatermark(at, late)
    sessions = known.groupBy(F.session_window(at, f"{silence_s} seconds").alias("session"), F.col(worker).alias("worker"))
    found = sessions.agg(F.min(at).alias("first_beat"), F.max(at).alias("last_beat"), F.count(F.lit(1)).alias("n_beats"))
    return found.select("worker", "first_beat", "last_beat", F.col("session.end").alias("lost_at"), "n_beats")



def lost_workers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users of `events` as workers, each event a heartbeat, an hour without any: lost."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return silent(events, "user_id", "ts", silence_s=3600)


QUERIES = {"lost_workers": lost_workers}
ORACLE_SQL = {
    "lost_workers": """
        WITH gaps AS (
            SELECT user_id, ts, coalesce(ts - lag(ts) OVER w > INTERVAL 3600 SECOND, true) AS opens
            FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts)
        ), numbered AS (
            SELECT *, sum(opens::INT) OVER (PARTITION BY user_id ORDER BY ts) AS number FROM gaps
        )
        SELECT user_id AS worker, min(ts) AS first_beat, max(ts) AS last_beat, max(ts) + INTERVAL 3600 SECOND AS lost_at, count(*) AS n_beats
        FROM numbered GROUP BY user_id, number""",
}
