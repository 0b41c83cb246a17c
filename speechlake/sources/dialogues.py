"""Made-up dialogues with a given share of overlapping speech: turns for any table of recordings.

Every number comes from a hash of seed, recording and turn, so a dialogue is the same however
the table is partitioned and whatever else it holds. Between turns there is either a pause or an
overlap; how far turns overlap is scaled in each recording so that the overlaps add up to
the target's share of its length. Where the boundaries dealt to overlap cannot hold that much, all do.
A turn loses at most half to each neighbour, so never more than two speak at once; a target
beyond what that allows (about 0.2) is met as far as it goes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Turns a recording has at most; no dialogue of 35 seconds has so many. FIRST are made for all, the others for those that these do not fill.
MOST, FIRST = 64, 16


def uniform(seed: int, record: Column, turn: Column, k: int) -> Column:
    """From 0 to 1: thirteen hex digits of an MD5."""
    text = F.concat_ws(":", F.lit(str(seed)), record.cast("string"), turn.cast("string"), F.lit(str(k)))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def dialogues(recordings: DataFrame, overlap: float = 0.08, seed: int = 42) -> DataFrame:
    """(record_id, seg_idx, speaker_id, start_us, end_us) of recordings (record_id): two speakers, three in every third, 15 to 35 seconds.

    A quarter of turns last 0.4 to 0.9 s, the others 2 to 7 s; neighbouring turns are of different speakers, pauses
    are 0.1 to 0.3 s. Repeated and null ids are one recording each and none.
    """
    u = lambda k: uniform(seed, F.col("record_id"), F.col("seg_idx"), k)
    us = lambda x: (F.floor(x * 100) * 10_000).cast("long")
    whole = 15 + F.floor(uniform(seed, F.col("record_id"), F.lit(-1), 0) * 21)
    voices = F.when(F.pmod(F.col("record_id"), F.lit(3)) == 0, 3).otherwise(2)
    ids = recordings.where("record_id IS NOT NULL").select("record_id").distinct()
    length = us(F.when(u(1) < 0.25, 0.4 + 0.5 * u(2)).otherwise(2.0 + 5.0 * u(2)))
    turns = lambda df, first, last: df.withColumn("seg_idx", F.explode(F.sequence(F.lit(first), F.lit(last)))).withColumn("d", length)
    record = Window.partitionBy("record_id")
    order = record.orderBy("seg_idx")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    passed = F.sum("d").over(upto) - F.col("d")
    begun = turns(ids, 0, FIRST - 1)
    open_ = begun.groupBy("record_id").agg(F.sum("d").alias("before")).where(F.col("before") < whole * 1_000_000)
    made = [begun.withColumn("passed", passed), turns(open_, FIRST, MOST - 1).withColumn("passed", F.col("before") + passed)]
    columns = ["record_id", "seg_idx", "d", "passed"]
    rows = made[0].select(columns).unionByName(made[1].select(columns)).where(F.col("passed") < whole * 1_000_000)
    rows = rows.withColumns(
        {
            # One to k - 1 places on from the speaker before: never the same.
            "voice": F.pmod(F.sum(1 + F.floor(u(3) * (voices - 1))).over(upto), voices).cast("int"),
            "room": F.when(F.lead("d").over(order).isNotNull(), F.floor((0.5 + 0.5 * u(4)) * F.least("d", F.lead("d").over(order)) / 2).cast("long")),
            "pause": F.when(F.lead("d").over(order).isNotNull(), us(0.1 + 0.2 * u(5))),
            "over": u(6) < min(1.0, 5.2 * overlap),
        }
    )
    total, some, every, rest = (F.coalesce(F.sum(x).over(record), F.lit(0)) for x in (F.col("d"), F.when(F.col("over"), F.col("room")), F.col("room"), F.when(~F.col("over"), F.col("pause"))))
    # share = o / (length - o), with o the overlaps' sum: so much of the room is used.
    part = lambda length, room: F.coalesce(F.try_divide(length * F.lit(overlap), room * F.lit(1 + overlap)), F.lit(2.0))
    rows = rows.withColumns({"some": part(total + rest, some), "every": F.least(F.lit(1.0), part(total, every))})
    gap = F.when(F.col("some") > 1, -F.floor(F.col("every") * F.col("room"))).when(F.col("over"), -F.floor(F.col("some") * F.col("room"))).otherwise(F.col("pause"))
    rows = rows.withColumn("step", (F.col("d") + F.coalesce(gap, F.lit(0))).cast("long"))
    start = F.sum("step").over(upto) - F.col("step")
    return rows.select("record_id", F.col("seg_idx").cast("long").alias("seg_idx"), F.format_string("SPEAKER_%02d", "voice").alias("speaker_id"), start.alias("start_us"), (start + F.col("d")).alias("end_us"))


def q_dialogues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialogues(spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("record_id")))


QUERIES = {"made_dialogues": q_dialogues}


def _u(turn: str, k: int) -> str:
    return f"(CAST('0x' || substr(md5(concat('42:', record_id, ':', {turn}, ':{k}')), 1, 13) AS BIGINT) / 4503599627370496.0)"


ORACLE_SQL = {
    "made_dialogues": f"""
        WITH turns AS (
            SELECT record_id, t, 15 + floor({_u("-1", 0)} * 21) AS whole, CASE WHEN record_id % 3 = 0 THEN 3 ELSE 2 END AS k,
                   CAST(floor(CASE WHEN {_u("t", 1)} < 0.25 THEN 0.4 + 0.5 * {_u("t", 2)} ELSE 2.0 + 5.0 * {_u("t", 2)} END * 100) AS BIGINT) * 10000 AS d
            FROM (SELECT c_custkey AS record_id, unnest(range(64)) AS t FROM customer) x
        ), kept AS (
            SELECT * FROM turns QUALIFY sum(d) OVER (PARTITION BY record_id ORDER BY t) - d < whole * 1000000
        ), dealt AS (
            SELECT record_id, t, d, sum(1 + floor({_u("t", 3)} * (k - 1))) OVER w % k AS voice, CASE WHEN nxt IS NOT NULL THEN floor((0.5 + 0.5 * {_u("t", 4)}) * least(d, nxt) / 2) END AS room,
                   CASE WHEN nxt IS NOT NULL THEN CAST(floor((0.1 + 0.2 * {_u("t", 5)}) * 100) AS BIGINT) * 10000 END AS pause, {_u("t", 6)} < 0.08 * 5.2 AS o
            FROM (SELECT *, lead(d) OVER (PARTITION BY record_id ORDER BY t) AS nxt FROM kept) y WINDOW w AS (PARTITION BY record_id ORDER BY t)
        ), sums AS (
            SELECT record_id, sum(d) AS all_d, coalesce(sum(room) FILTER (o), 0) AS some_r, sum(room) AS every_r, coalesce(sum(pause) FILTER (NOT o), 0) AS rest FROM dealt GROUP BY record_id
        ), scaled AS (
            SELECT *, coalesce((all_d + rest) * 0.08::DOUBLE / nullif(some_r * 1.08::DOUBLE, 0), 2.0) AS lam, least(1.0, coalesce(all_d * 0.08::DOUBLE / nullif(every_r * 1.08::DOUBLE, 0), 2.0)) AS lam_all FROM sums
        ), stepped AS (
            SELECT record_id, t, voice, d, d + CAST(coalesce(CASE WHEN lam > 1 THEN -floor(lam_all * room) WHEN o THEN -floor(lam * room) ELSE pause END, 0) AS BIGINT) AS step FROM dealt JOIN scaled USING (record_id)
        )
        SELECT record_id, t AS seg_idx, 'SPEAKER_' || lpad(CAST(CAST(voice AS INT) AS VARCHAR), 2, '0') AS speaker_id, sum(step) OVER w - step AS start_us, sum(step) OVER w - step + d AS end_us
        FROM stepped WINDOW w AS (PARTITION BY record_id ORDER BY t)""",
}
