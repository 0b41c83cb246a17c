"""Speaker vectors: similarity, centroids, frames."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import workers
from ..sources.fixtures import view

#: Vectors of a block, and how many of them are multiplied with another block at once.
BLOCK, ROWS = 1000, 256


def dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: str, b: str) -> Column:
    """0 where either has no length."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms).otherwise(0.0)


def voices(spark: SparkSession, sf_dir: str) -> DataFrame:
    view(spark, sf_dir, "embeddings")
    return spark.sql("SELECT vec_id % 20 AS record_id, label AS speaker, vec_id, embedding FROM embeddings")


def alike_pairs(voices: DataFrame, least: float, block: int = BLOCK) -> DataFrame:
    """(record_id, vec_a, vec_b, cos) of voices (record_id, vec_id, embedding): every pair of one record, by ascending vec_id, with `cosine` of at least this.

    A record's vectors are dealt to blocks of about `block`, and a task takes two blocks: all pairs are looked at by a
    matrix product, and those near the bound or above are summed again term by term, as `cosine` does.
    Work is quadratic in a record's vectors, memory is two blocks and the pairs found of a few rows.
    """
    workers.ship(voices.sparkSession)
    rows = voices.where("embedding IS NOT NULL AND vec_id IS NOT NULL").select("record_id", F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    sizes = rows.groupBy("record_id").agg(F.ceil(F.count("*") / block).cast("int").alias("_n"))
    dealt = rows.join(sizes, "record_id").withColumn("_own", F.pmod(F.xxhash64("vec_id"), F.col("_n")).cast("int"))
    # A vector goes to the cell of its block with every other one: the lower block's number comes first.
    other = F.explode(F.sequence(F.lit(0), F.col("_n") - 1))
    cells = dealt.withColumn("_other", other).select("record_id", F.least("_own", "_other").alias("_low"), F.greatest("_own", "_other").alias("_high"), "_own", "vec_id", "embedding")

    def exact(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for k in range(x.shape[1]):
            total = total + x[:, k] * y[:, k]
        return total

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        record, low, high = (k.as_py() for k in key)
        by_size: dict[int, tuple[list, list, list]] = {}
        for b in batches:
            vectors = b.column(b.schema.get_field_index("embedding"))
            for own, vec, at in zip(b.column(b.schema.get_field_index("_own")).to_pylist(), b.column(b.schema.get_field_index("vec_id")).to_pylist(), range(b.num_rows)):
                v = vectors[at].values
                if v is not None and not v.null_count:
                    kept = by_size.setdefault(len(v), ([], [], []))
                    for into, value in zip(kept, (own, vec, v.to_numpy(zero_copy_only=False))):
                        into.append(value)
        for own, ids, x in by_size.values():
            own, ids, x = np.array(own), np.array(ids), np.stack(x)
            with np.errstate(all="ignore"):
                size = np.sqrt(exact(x, x))
                order = np.argsort(own, kind="stable")
                own, ids, x, size = own[order], ids[order], x[order], size[order]
                cut = len(own) if low == high else int(np.searchsorted(own, high))
                right = slice(0, None) if low == high else slice(cut, None)
                for at in range(0, cut, ROWS):
                    left = slice(at, min(at + ROWS, cut))
                    near = x[left] @ x[right].T
                    i, j = np.nonzero(~(near < (least - 1e-6) * size[left, None] * size[None, right]))
                    i, j = i + at, j + (0 if low == high else cut)
                    keep = ids[i] < ids[j] if low == high else ids[i] != ids[j]
                    i, j = i[keep], j[keep]
                    norms, dots = size[i] * size[j], exact(x[i], x[j])
                    cos = np.where(norms > 0, dots / norms, np.where(np.isnan(norms), dots / norms, 0.0))
                    keep = ~(cos < least)
                    i, j, cos = i[keep], j[keep], cos[keep]
                    a, b = np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a), record), pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(cos, pa.float64())], ["record_id", "vec_a", "vec_b", "cos"])

    return cells.groupBy("record_id", "_low", "_high").applyInArrow(run, "record_id long, vec_a long, vec_b long, cos double")


def cosine_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of one record's vectors of similarity 0.3 and more."""
    return alike_pairs(voices(spark, sf_dir), 0.3).select("record_id", "vec_a", "vec_b", F.round("cos", 4).alias("cos"))


def centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of each speaker's vectors in a record, a row per component."""
    each = voices(spark, sf_dir).select("record_id", "speaker", F.posexplode("embedding").alias("pos", "x"))
    return each.groupBy("record_id", "speaker", "pos").agg(F.round(F.avg(F.col("x").cast("double")), 5).alias("mean"), F.count("*").alias("n"))


def frame_rms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Root mean square of frames of eight samples, each vector taken as a signal."""
    each = voices(spark, sf_dir).select("vec_id", F.posexplode("embedding").alias("pos", "x"))
    return each.groupBy("vec_id", F.floor(F.col("pos") / 8).alias("frame")).agg(F.round(F.sqrt(F.avg(F.col("x").cast("double") * F.col("x").cast("double"))), 5).alias("rms"))


VOICES = "voices AS (SELECT vec_id % 20 AS record_id, label AS speaker, vec_id, embedding::DOUBLE[] AS e FROM embeddings), parts AS (SELECT record_id, speaker, vec_id, unnest(e) AS x, unnest(range(len(e))) AS pos FROM voices)"
QUERIES = {"cosine_pairs": cosine_pairs, "centroids": centroids, "frame_rms": frame_rms}
ORACLE_SQL = {
    "cosine_pairs": f"""WITH {VOICES} SELECT a.record_id, a.vec_id AS vec_a, b.vec_id AS vec_b, round(list_cosine_similarity(a.e, b.e), 4) AS cos
        FROM voices a JOIN voices b ON a.record_id = b.record_id AND a.vec_id < b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.3""",
    "centroids": f"WITH {VOICES} SELECT record_id, speaker, pos, round(avg(x), 5) AS mean, count(*) AS n FROM parts GROUP BY record_id, speaker, pos",
    "frame_rms": f"WITH {VOICES} SELECT vec_id, pos // 8 AS frame, round(sqrt(avg(x * x)), 5) AS rms FROM parts GROUP BY vec_id, pos // 8",
}
