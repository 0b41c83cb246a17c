"""Frames of signals: activity, noise, filters over labels, windows. One SQL text serves both engines for the simplest of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import intervals, vectors

#: Over frames(vec_id, frame, rms). Placeholders: the exact percentile and the base-10 logarithm's argument stay alike.
FLAGS = """
    thr AS (SELECT vec_id, greatest(1e-4, 1.5 * {p30}) AS t FROM frames GROUP BY vec_id),
    flags AS (SELECT f.vec_id, frame, CASE WHEN rms > t THEN 1 ELSE 0 END AS flag FROM frames f JOIN thr ON thr.vec_id = f.vec_id)"""
TEXTS = {
    "vad_flags": "WITH {frames}" + FLAGS + " SELECT vec_id, frame, flag FROM flags",
    "majority_filter": "WITH {frames}" + FLAGS + """ SELECT vec_id, frame, CASE WHEN lag(flag) OVER w IS NULL OR lead(flag) OVER w IS NULL THEN flag WHEN lag(flag) OVER w + flag + lead(flag) OVER w >= 2 THEN 1 ELSE 0 END AS flag
        FROM flags WINDOW w AS (PARTITION BY vec_id ORDER BY frame)""",
    "median_filter": """WITH {frames} d AS (SELECT vec_id, frame, rms AS b, coalesce(lag(rms) OVER w, 0.0) AS a, coalesce(lead(rms) OVER w, 0.0) AS c FROM frames WINDOW w AS (PARTITION BY vec_id ORDER BY frame))
        SELECT vec_id, frame, round(greatest(least(a, b), least(greatest(a, b), c)), 5) AS rms FROM d""",
    "ffill_labels": "WITH {frames}" + FLAGS + """, seen AS (SELECT vec_id, frame, CASE WHEN (vec_id + frame) % 3 = 0 THEN flag END AS flag FROM flags),
        filled AS (SELECT vec_id, frame, max(CASE WHEN flag IS NOT NULL THEN frame END) OVER (PARTITION BY vec_id ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS at, min(CASE WHEN flag IS NOT NULL THEN frame END) OVER (PARTITION BY vec_id) AS first_at FROM seen)
        SELECT l.vec_id, l.frame, s.flag FROM filled l JOIN seen s ON s.vec_id = l.vec_id AND s.frame = coalesce(l.at, l.first_at)""",
}
DUCK_FRAMES = "parts AS (SELECT vec_id, unnest(embedding::DOUBLE[]) AS x, unnest(range(len(embedding))) AS pos FROM embeddings), frames AS (SELECT vec_id, pos // 8 AS frame, sqrt(avg(x * x)) AS rms FROM parts GROUP BY vec_id, pos // 8),"


def frames(signals: DataFrame, size: int = 8) -> DataFrame:
    """(vec_id, frame, rms) of every whole frame; samples that fill no frame are left out."""
    whole = F.floor(F.size("embedding") / size).cast("int")
    energy = lambda i: F.aggregate(F.slice("embedding", i * size + 1, F.lit(size)), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    each = F.posexplode(F.transform(F.when(whole > 0, F.sequence(F.lit(0), whole - 1)).otherwise(F.array().cast("array<int>")), lambda i: F.sqrt(energy(i) / size)))
    return signals.select("vec_id", each.alias("frame", "rms")).withColumn("frame", F.col("frame").cast("long"))


def activity(frames: DataFrame, silent: int) -> DataFrame:
    """(vec_id, start_frame, end_frame): speech by frames louder than max(1e-4, 1.5 times the 30th percentile).

    It starts with its first loud frame and is closed by `silent` quiet ones in a row; then it
    ends where its last loud frame starts, and one of a single loud frame is none. What is not
    closed ends with the signal (end_frame null). A signal without any is speech as a whole.
    """
    own, w = Window.partitionBy("vec_id"), Window.partitionBy("vec_id").orderBy("frame")
    threshold = frames.groupBy("vec_id").agg(F.greatest(F.lit(1e-4), 1.5 * F.expr("percentile(rms, 0.3)")).alias("t"), F.count("*").alias("n"))
    loud = frames.join(threshold, "vec_id").where("rms > t")
    runs = intervals.islands(loud.withColumn("gap", F.col("frame") - F.lag("frame").over(w) - 1), ["vec_id"], ["frame"], F.col("gap") >= silent, "run")
    ends = runs.groupBy("vec_id", "run", "n").agg(F.min("frame").alias("start_frame"), F.max("frame").alias("last"))
    closed = F.col("last") + silent < F.col("n")
    found = ends.where(~closed | (F.col("last") > F.col("start_frame"))).select("vec_id", "start_frame", F.when(closed, F.col("last")).alias("end_frame"))
    rest = threshold.select("vec_id").join(found.select("vec_id"), "vec_id", "left_anti").select("vec_id", F.lit(0).cast("long").alias("start_frame"), F.lit(None).cast("long").alias("end_frame"))
    return found.unionByName(rest)


def snr(samples: Column, size: int) -> Column:
    """Decibels between the mean energy of the loudest 30 % of frames and of the quietest 20 %; 0 without samples, 30 below a frame, 40 without noise."""
    whole = F.floor(F.size(samples) / size).cast("int")
    energy = F.transform(F.sequence(F.lit(0), F.greatest(whole, F.lit(1)) - 1), lambda i: F.aggregate(F.slice(samples, i * size + 1, F.lit(size)), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")) / size)
    ordered = F.array_sort(energy)
    share = lambda part: F.greatest(F.lit(1), F.floor(whole * part).cast("int"))
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)
    loud, quiet = mean(F.slice(ordered, whole - share(0.3) + 1, share(0.3))), mean(F.slice(ordered, F.lit(1), share(0.2)))
    ratio = F.greatest(F.try_divide(loud, quiet), F.lit(1e-5))
    return F.when(samples.isNull() | (F.size(samples) == 0), 0.0).when(whole == 0, 30.0).when(quiet <= 1e-10, 40.0).otherwise(10 * F.log10(ratio))


def z_scores(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Each column as (x - mean) / (population deviation + 1e-6) within the keys."""
    w = Window.partitionBy(*keys)
    return rows.withColumns({c: (F.col(c) - F.avg(c).over(w)) / (F.stddev_pop(c).over(w) + 1e-6) for c in columns})


def loud_windows(frames: DataFrame) -> DataFrame:
    """Frames that are not below max(1e-5, the 5th percentile) of their signal."""
    floor = frames.groupBy("vec_id").agg(F.greatest(F.lit(1e-5), F.expr("percentile(rms, 0.05)")).alias("floor"))
    return frames.join(floor, "vec_id").where("rms >= floor").drop("floor")


def windows(samples: Column, size: int, step: int) -> Column:
    """Slices of `size` samples every `step`; what fills no slice is left out."""
    last = F.floor((F.size(samples) - size) / step).cast("int")
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.slice(samples, i * step + 1, F.lit(size)))).otherwise(F.array().cast("array<array<double>>"))


def median_of(rows: DataFrame, keys: list[str], order: str, value: str, size: int) -> DataFrame:
    """The median of `size` (odd) neighbours, zero beyond the ends."""
    w = Window.partitionBy(*keys).orderBy(order)
    half = size // 2
    return rows.withColumn(value, F.array_sort(F.array(*[F.coalesce((F.lag(value, -i) if i < 0 else F.lead(value, i)).over(w) if i else F.col(value), F.lit(0)) for i in range(-half, half + 1)]))[half])


def restore_vanished(rows: DataFrame, keys: list[str], order: str, raw: str, final: str) -> DataFrame:
    """Labels of `raw` that `final` lost come back on their longest run, the first of several."""
    w = Window.partitionBy(*keys).orderBy(order)
    runs = intervals.islands(rows.withColumn("new", F.col(raw) != F.lag(raw).over(w)), keys, [order], F.col("new"), "run").drop("new")
    kept = rows.select(*keys, F.col(final).alias(raw)).distinct()
    size = runs.groupBy(*keys, raw, "run").agg(F.count("*").alias("size"))
    gone = size.join(kept, [*keys, raw], "left_anti")
    best = gone.withColumn("rank", F.row_number().over(Window.partitionBy(*keys, raw).orderBy(F.desc("size"), "run"))).where("rank = 1").select(*keys, "run", F.col(raw).alias("back"))
    return runs.join(best, [*keys, "run"], "left").withColumn(final, F.coalesce("back", final)).drop("back", "run")


def locked_labels(rows: DataFrame, keys: list[str], order: str, label: str, energy: str, threshold: Column, ahead: int = 4) -> DataFrame:
    """rows with labels that change only where it is quiet, or where `ahead` windows (fewer at the end) agree and one of them is quiet.

    So each window has the label of the last one that was free to change; the first one always is.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    near = w.rowsBetween(Window.currentRow, ahead - 1)
    sure = (F.min(label).over(near) == F.max(label).over(near)) & (F.min(energy).over(near) < threshold)
    free = (F.col(energy) < threshold) | sure | (F.row_number().over(w) == 1)
    last = F.last(F.when(F.col("__free"), F.col(label)), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn("__free", free).withColumn(label, last).drop("__free")


def resampled(samples: Column, rate: int, to: int) -> Column:
    """Linear interpolation at the new rate."""
    n = F.floor(F.size(samples) * F.lit(to) / F.lit(rate)).cast("int")

    def at(i: Column) -> Column:
        place = i * F.lit(rate / to)
        low = F.least(F.floor(place).cast("int"), F.size(samples) - 1)
        a, b = F.get(samples, low), F.get(samples, F.least(low + 1, F.size(samples) - 1))
        return a + (b - a) * (place - low)

    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), at)).otherwise(F.array().cast("array<double>"))


def tone(seconds: float, hertz: float, rate: int = 16_000, loudness: float = 0.5) -> Column:
    """Samples of a sine."""
    return F.transform(F.sequence(F.lit(0), F.lit(int(seconds * rate) - 1)), lambda i: F.lit(loudness) * F.sin(F.lit(2 * 3.141592653589793 * hertz / rate) * i))


def query(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        own = frames(vectors.voices(spark, sf_dir))
        return spark.sql(TEXTS[name].format(frames="frames AS (SELECT * FROM {own}), ", p30="percentile(rms, 0.3)"), own=own)

    return run


def q_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return activity(frames(vectors.voices(spark, sf_dir)), 2)


def q_snr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.voices(spark, sf_dir).where("embedding is not null").select("vec_id", F.round(snr(F.col("embedding"), 8), 3).alias("snr"))


QUERIES = {name: query(name) for name in TEXTS} | {"vad_intervals": q_activity, "snr_db": q_snr}
ORACLE_SQL = {name: text.format(frames=DUCK_FRAMES, p30="quantile_cont(rms, 0.3)") for name, text in TEXTS.items()} | {
    "vad_intervals": "WITH " + DUCK_FRAMES + """ thr AS (SELECT vec_id, greatest(1e-4, 1.5 * quantile_cont(rms, 0.3)) AS t, count(*) AS n FROM frames GROUP BY vec_id),
        q AS (SELECT f.vec_id, frame, n, rms > t AS loud, NOT coalesce(lead(rms) OVER w > t, false) AND NOT rms > t AND lead(frame) OVER w IS NOT NULL AS quiet2
              FROM frames f JOIN thr ON thr.vec_id = f.vec_id WINDOW w AS (PARTITION BY f.vec_id ORDER BY frame)),
        c AS (SELECT *, count(*) FILTER (quiet2) OVER (PARTITION BY vec_id ORDER BY frame) AS cuts FROM q),
        r AS (SELECT vec_id, n, cuts, min(frame) AS a, max(frame) AS b FROM c WHERE loud GROUP BY vec_id, n, cuts),
        k AS (SELECT vec_id, a AS start_frame, CASE WHEN n - b > 2 THEN b END AS end_frame FROM r WHERE n - b <= 2 OR b > a)
        SELECT * FROM k UNION ALL SELECT vec_id, 0, NULL FROM thr WHERE vec_id NOT IN (SELECT vec_id FROM k)""",
    "snr_db": "WITH " + DUCK_FRAMES + """ r AS (SELECT vec_id, rms * rms AS e, row_number() OVER (PARTITION BY vec_id ORDER BY rms DESC, frame) AS down, row_number() OVER (PARTITION BY vec_id ORDER BY rms, frame) AS up, count(*) OVER (PARTITION BY vec_id) AS n FROM frames),
        m AS (SELECT vec_id, avg(CASE WHEN down <= greatest(1, floor(n * 0.3)) THEN e END) AS loud, avg(CASE WHEN up <= greatest(1, floor(n * 0.2)) THEN e END) AS quiet FROM r GROUP BY vec_id)
        SELECT vec_id, CASE WHEN quiet <= 1e-10 THEN 40.0 ELSE round(10.0 * log10(greatest(loud / quiet, 1e-5)), 3) END AS snr FROM m""",
}
