"""Voice features of signals: cepstra with deltas, pitch and centroid, filter-bank resampling, spherical two-way clustering.

A signal is a row (vec_id, samples). What works on frames runs over Arrow batches: a batch's
signals are taken one after another, so memory follows one signal. Clustering never has a
group in one task: vectors stay rows, and each round is an aggregate.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import gcd

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import workers

#: Length and step of a frame in seconds, points of the transform, filters, coefficients, range of voice pitch in hertz, silence.
FRAME_S, STEP_S, POINTS, FILTERS, COEFFICIENTS, LOW_HZ, HIGH_HZ, QUIET = 0.025, 0.010, 512, 26, 13, 100.0, 350.0, 1e-4


def mel_filters(rate: int, points: int = POINTS, filters: int = FILTERS) -> np.ndarray:
    """Triangles over the bins of the spectrum, evenly spaced in mel between 0 and half the rate: a row a filter."""
    mel = np.linspace(0, 2595 * np.log10(1 + rate / 2 / 700), filters + 2)
    edges = np.floor((points + 1) * 700 * (10 ** (mel / 2595) - 1) / rate)
    low, top, high = edges[:-2, None], edges[1:-1, None], edges[2:, None]
    k = np.arange(points // 2 + 1)[None]
    up = np.where((low <= k) & (k < top), (k - low) / np.maximum(top - low, 1), 0.0)
    return np.where((top <= k) & (k < high), (high - k) / np.maximum(high - top, 1), up)


def cosines(filters: int = FILTERS, coefficients: int = COEFFICIENTS) -> np.ndarray:
    """The cosine transform (type II) of the filters' levels, without its constant: a row a coefficient."""
    k, n = np.arange(1, coefficients + 1)[:, None], np.arange(filters)[None]
    return np.cos(np.pi * k * (2 * n + 1) / (2 * filters))


def cepstra(x: np.ndarray, rate: int, coefficients: int = COEFFICIENTS) -> np.ndarray:
    """(frames, 2 * coefficients): cepstral coefficients and their slopes from frame to frame. A signal below a frame has one row of zeros.

    The last frame is filled with zeros. Longer frames than POINTS are cut to it by the transform.
    """
    size, step = int(rate * FRAME_S), int(rate * STEP_S)
    if len(x) < max(size, 1):
        return np.zeros((1, 2 * coefficients))
    n = 1 + -(-(len(x) - size) // step)
    padded = np.append(x, np.zeros((n - 1) * step + size - len(x)))
    frames = np.lib.stride_tricks.sliding_window_view(padded, size)[::step] * np.hamming(size)
    power = np.abs(np.fft.rfft(frames, POINTS)) ** 2 / POINTS
    level = power @ mel_filters(rate).T
    level = 20 * np.log10(np.where(level == 0, np.finfo(float).eps, level))
    c = level @ cosines(coefficients=coefficients).T
    return np.hstack([c, np.gradient(c, axis=0) if len(c) > 2 else np.zeros_like(c)])


def pitch_and_centroid(x: np.ndarray, rate: int) -> tuple[float, float] | None:
    """(pitch, centroid) in hertz; None for silence. Pitch is the lag of the largest autocorrelation between HIGH_HZ and LOW_HZ, 0 where the window is too short for it."""
    if not len(x) or np.abs(x).max() < QUIET:
        return None
    size = np.abs(np.fft.rfft(x * np.hamming(len(x))))
    centroid = float((np.fft.rfftfreq(len(x), 1 / rate) * size).sum() / (size.sum() + 1e-6))
    first, last = int(rate / HIGH_HZ), int(rate / LOW_HZ)
    if not 0 < first < last < len(x):
        return 0.0, centroid
    # Only the lags that may be a voice's: two transforms in place of all products.
    room = 1 << (len(x) + last - 1).bit_length()
    f = np.fft.rfft(x, room)
    like = np.fft.irfft(f * np.conj(f), room)[first:last]
    return rate / (first + int(np.argmax(like))), centroid


def filter_bank(rate: int, to: int, half: int = 16) -> tuple[np.ndarray, int, int]:
    """(bank, up, down): a row of taps for each phase of the output, a Hann-windowed sinc that passes what both rates can hold."""
    common = gcd(rate, to)
    up, down = to // common, rate // common
    cut = min(1.0, to / rate)
    reach = int(np.ceil(half / cut))
    offset = np.arange(-reach + 1, reach + 1)[None] - np.arange(up)[:, None] / up
    taps = cut * np.sinc(cut * offset) * np.where(np.abs(offset) < reach, 0.5 + 0.5 * np.cos(np.pi * offset / reach), 0.0)
    return taps / taps.sum(1, keepdims=True), up, down


def resampled(x: np.ndarray, rate: int, to: int, half: int = 16) -> np.ndarray:
    """Samples at the new rate by the filter bank: output i lies at i * down / up, its phase picks the taps. Beyond the ends is silence."""
    if rate == to or not len(x):
        return np.asarray(x, float)
    bank, up, down = filter_bank(rate, to, half)
    reach = bank.shape[1] // 2
    n = -(-len(x) * up // down)
    padded = np.concatenate([np.zeros(reach - 1), x, np.zeros(reach + 1)])
    at = np.arange(n) * down
    whole, phase = at // up, at % up
    out = np.empty(n)
    for a in range(0, n, 1 << 16):  # a block of outputs at a time
        rows = slice(a, a + (1 << 16))
        out[rows] = (padded[whole[rows, None] + np.arange(2 * reach)] * bank[phase[rows]]).sum(1)
    return out


def _per_signal(signals: DataFrame, schema: str, run) -> DataFrame:
    """run(samples) gives columns of equal length for each signal that has samples, none of them null or not finite."""
    workers.ship(signals.sparkSession)
    names = [c.split()[0] for c in schema.split(", ")]

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = None
        for b in parts:
            for vec_id, x in zip(b.column(0), b.column(1)):
                x = np.asarray(x.values.to_numpy(zero_copy_only=False), float) if x.is_valid else np.zeros(0)
                if not len(x) or not np.isfinite(x).all():
                    continue
                columns = run(x)
                n = len(columns[0])
                kinds = kinds or [pa.int64(), *(pa.list_(pa.float64()) if t == "array<double>" else pa.int64() if t == "long" else pa.float64() for t in (c.split()[1] for c in schema.split(", ")[1:]))]
                yield pa.RecordBatch.from_arrays([pa.array([vec_id.as_py()] * n, kinds[0]), *(pa.array(c, k) for c, k in zip(columns, kinds[1:]))], names)

    return signals.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("samples").cast("array<double>").alias("samples")).mapInArrow(batches, schema)


def frame_features(signals: DataFrame, rate: int) -> DataFrame:
    """(vec_id, frame, features) of signals (vec_id, samples): a row a frame, coefficients before slopes. Signals without samples, or with any null or not finite, have none."""

    def run(x: np.ndarray) -> tuple:
        c = cepstra(x, rate)
        return range(len(c)), c.tolist()

    return _per_signal(signals, "vec_id long, frame long, features array<double>", run)


def pitch(signals: DataFrame, rate: int) -> DataFrame:
    """(vec_id, pitch, centroid) of signals (vec_id, samples); both null for silence. Signals as in frame_features."""

    def run(x: np.ndarray) -> tuple:
        found = pitch_and_centroid(x, rate) or (None, None)
        return [found[0]], [found[1]]

    return _per_signal(signals, "vec_id long, pitch double, centroid double", run)


def resample(signals: DataFrame, rate: int, to: int) -> DataFrame:
    """(vec_id, samples) at the new rate, by a filter bank. Signals as in frame_features; `signals.resampled` is the linear form."""
    return _per_signal(signals, "vec_id long, samples array<double>", lambda x: ([resampled(x, rate, to).tolist()],))


def _dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _unit(v: Column) -> Column:
    size = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)) + 1e-8
    return F.transform(v, lambda x: x / size)


def _sums(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """(keys, name): the rows' arrays summed place by place, combined before they are shuffled."""
    parts = rows.select(*keys, F.posexplode(name).alias("p", "x")).groupBy(*keys, "p").agg(F.sum("x").alias("x"))
    return parts.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "x"))), lambda s: s.x).alias(name))


def principal_axes(rows: DataFrame) -> DataFrame:
    """(key, axis) of rows (key, v): the direction in which a key's vectors differ most; its first component that isn't 0 is positive.

    Each batch gives the sum, the number and the products of its vectors of a key; those are added up by
    component, so what one task holds of a key is a matrix of its dimensions.
    """
    workers.ship(rows.sparkSession)

    def moments(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            keys = b.column(0).to_numpy(zero_copy_only=False)
            x = np.stack(b.column(1).to_numpy(zero_copy_only=False)) if b.num_rows else np.zeros((0, 0))
            for k in np.unique(keys):
                own = x[keys == k]
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([np.concatenate([[len(own)], own.sum(0), (own.T @ own).ravel()]).tolist()], pa.list_(pa.float64()))], ["key", "m"])

    def axis(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in parts:
            out = []
            for m in column.to_pylist():
                d = int((np.sqrt(4 * len(m) - 3) - 1) / 2)
                n, total, products = m[0], np.array(m[1 : d + 1]), np.array(m[d + 1 :]).reshape(d, d)
                a = np.linalg.eigh(products - np.outer(total, total) / n)[1][:, -1]
                out.append((a if a[np.abs(a) > 1e-9][0] > 0 else -a).tolist())
            yield pa.array(out, pa.list_(pa.float64()))

    sums = _sums(rows.select("key", "v").mapInArrow(moments, "key long, m array<double>"), ["key"], "m")
    return sums.select("key", F.arrow_udf(axis, "array<double>")(F.col("m")).alias("axis"))


def two_speakers(vectors_: DataFrame, key: str, rounds: int = 50) -> DataFrame:
    """(key, idx, label) of vectors (key, idx, v), key whole numbers: labels 0 and 1 by cosine 2-means started along the principal axis.

    The start cuts each key's vectors, of length one, at the median of their parts along the axis. In each round
    centres are summed and every vector goes to the one that is more alike (0 on a tie), until no label
    changes. A key that loses one of the labels goes back to those of the start. A key of one vector, or of
    vectors that are all alike, is labelled 0; vectors of different size fail; null vectors are left out.

    Nothing of a key is gathered but its axis and two centres. Rounds are checkpointed where the
    session has a folder for it.
    """
    spark = vectors_.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if folder and not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(folder)
    durable = context._jsc.sc().getCheckpointDir().isDefined()

    def step(df: DataFrame) -> DataFrame:
        kept = df.persist()
        if not durable:
            return kept
        done = kept.checkpoint()
        kept.unpersist()
        return done

    rows = vectors_.where("v IS NOT NULL").select(F.col(key).cast("long").alias("key"), "idx", _unit(F.col("v").cast("array<double>")).alias("v"))
    along = step(rows.join(principal_axes(rows), "key").select("key", "idx", "v", _dot("v", "axis").alias("w")))
    cut = along.groupBy("key").agg(F.median("w").alias("cut"))
    start = (F.col("w") > F.col("cut") + 1e-12).cast("int")
    labels = step(along.join(cut, "key").select("key", "idx", "v", start.alias("start"), start.alias("label"), F.lit(False).alias("fixed"), F.lit(True).alias("moved")))
    for _ in range(rounds):
        sums = _sums(labels.where("NOT fixed"), ["key", "label"], "v").select("key", "label", _unit(F.col("v")).alias("m"))
        centres = sums.groupBy("key").agg(F.max(F.when(F.col("label") == 0, F.col("m"))).alias("m0"), F.max(F.when(F.col("label") == 1, F.col("m"))).alias("m1"))
        lost = F.col("m0").isNull() | F.col("m1").isNull()
        new = F.when(lost, F.col("start")).otherwise((_dot("v", "m1") > _dot("v", "m0")).cast("int"))
        labels = step(labels.join(centres, "key", "left").select("key", "idx", "v", "start", new.alias("label"), lost.alias("fixed"), (new != F.col("label")).alias("moved")))
        if not labels.where("moved").limit(1).count():
            break
    return labels.select(F.col("key").alias(key), "idx", "label")


# Queries: each vector of `embeddings` is a signal of 64 samples.

#: Samples a second at which a vector of 64 samples has four whole frames.
RATE = 1_000


def _signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.col("embedding").alias("samples"))


def q_cepstra(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = frame_features(_signals(spark, sf_dir), RATE)
    return rows.select("vec_id", "frame", F.posexplode("features").alias("k", "value")).select("vec_id", "frame", "k", F.round("value", 4).alias("value"))


def q_pitch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitch(_signals(spark, sf_dir), RATE).select("vec_id", F.round("pitch", 4).alias("pitch"), F.round("centroid", 4).alias("centroid"))


def q_resampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = resample(_signals(spark, sf_dir), 3, 2)
    return rows.select("vec_id", F.posexplode("samples").alias("i", "value")).select("vec_id", "i", F.round("value", 6).alias("value"))


def q_two_speakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two labels among each 50 neighbouring vectors."""
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.floor(F.col("vec_id") / 50).alias("record_id"), F.col("vec_id").alias("idx"), F.col("embedding").alias("v"))
    return two_speakers(v, "record_id")


QUERIES = {"cepstral_features": q_cepstra, "pitch_centroid": q_pitch, "filter_resampled": q_resampled, "two_speakers": q_two_speakers}
DUCK = "s AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x, len(embedding) AS n FROM embeddings WHERE embedding IS NOT NULL)"
#: Everything from definitions: products for each lag, the discrete transform by sines and cosines, taps by their formula.
ORACLE_SQL = {
    "pitch_centroid": f"""WITH {DUCK}, lags AS (
            SELECT vec_id, k, list_sum(list_transform(range(1, n - k + 1), lambda i: x[i] * x[i + k])) AS c FROM s, range(2, 10) r(k) WHERE n > 10
        ), p AS (SELECT vec_id, 1000.0 / arg_max(k, round(c, 12)) AS pitch FROM lags GROUP BY vec_id),
        w AS (SELECT vec_id, n, list_transform(x, lambda v, i: v * (0.54 - 0.46 * cos(2 * pi() * (i - 1) / (n - 1)))) AS y FROM s),
        f AS (SELECT vec_id, n, k, sqrt(pow(list_sum(list_transform(y, lambda v, i: v * cos(2 * pi() * k * (i - 1) / n))), 2) + pow(list_sum(list_transform(y, lambda v, i: v * sin(2 * pi() * k * (i - 1) / n))), 2)) AS m FROM w, range(0, 33) r(k)),
        c AS (SELECT vec_id, sum(k * 1000.0 / n * m) / (sum(m) + 1e-6) AS centroid FROM f GROUP BY vec_id)
        SELECT vec_id, round(pitch, 4) AS pitch, round(centroid, 4) AS centroid FROM p JOIN c USING (vec_id)""",
    "filter_resampled": f"""WITH {DUCK}, taps AS (
            SELECT phase, j, (2 / 3.0) * CASE WHEN o = 0 THEN 1.0 ELSE sin(pi() * 2 / 3.0 * o) / (pi() * 2 / 3.0 * o) END * CASE WHEN abs(o) < 24 THEN 0.5 + 0.5 * cos(pi() * o / 24) ELSE 0.0 END AS t
            FROM (SELECT phase, j, j - phase / 2.0 AS o FROM range(0, 2) a(phase), range(-23, 25) b(j)) x
        ), bank AS (SELECT phase, j, t / sum(t) OVER (PARTITION BY phase) AS t FROM taps),
        places AS (SELECT vec_id, x, n, i, i * 3 // 2 AS whole, i * 3 % 2 AS phase FROM s, range(0, 43) r(i) WHERE i * 3 < n * 2)
        SELECT vec_id, CAST(i AS INT) AS i, round(sum(CASE WHEN whole + j BETWEEN 0 AND n - 1 THEN x[CAST(whole + j + 1 AS BIGINT)] * t ELSE 0.0 END), 6) AS value FROM places JOIN bank USING (phase) GROUP BY vec_id, i""",
}
