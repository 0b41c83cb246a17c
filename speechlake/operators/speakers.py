"""Clustering of a record's speaker vectors: linkage, silhouette, eigengap and speaker count.

A record is one task. Of many vectors, similarities are taken a block of rows at a time: memory
grows with a record's vectors, time with their square, so callers pass a vector per interval, not
per frame.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from ..sources import workers
from ..sources.fixtures import PARTS
from . import vectors


#: Vectors whose similarities are held at once, similarities of a block of rows, columns of a step and at most of the basis, and the largest residual of an eigenvalue.
DENSE, CELLS, STEP, BASIS, RESIDUAL = 1000, 1 << 22, 32, 320, 1e-8
#: Clusters that look for their nearest at once, at least.
LOOKING = 64


def unit_vectors(x: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, size, out=np.zeros_like(x), where=size > 0)


def cosine_distances(x: np.ndarray) -> np.ndarray:
    unit = unit_vectors(x)
    return np.clip(1.0 - unit @ unit.T, 0.0, 2.0)


def row_blocks(n: int) -> list[slice]:
    """Rows of a square of n whose cells are held at once."""
    step = max(1, CELLS // n)
    return [slice(at, at + step) for at in range(0, n, step)]


def average_linkage(d: np.ndarray, least: int = 1, limit: float = np.inf, most: int | None = None, sizes: np.ndarray | None = None) -> dict[int, np.ndarray]:
    """Labels by number of clusters, from all apart down to `least`, or until the closest two are `limit` apart; those of more than `most` clusters are not kept.

    Each row keeps its nearest other, so that a step looks at one number a row, and at the rows whose nearest has changed.
    A row stands for as many points as `sizes` says.
    """
    n = len(d)
    most = n if most is None else most
    near, sizes, labels = d.astype(float).copy(), np.ones(n) if sizes is None else sizes.astype(float), np.arange(n)
    np.fill_diagonal(near, np.inf)
    best, low = near.argmin(1), near.min(1)
    unknown = bool(np.isnan(near).any())
    found = {n: labels.copy()} if n <= most else {}
    for k in range(n - 1, least - 1, -1):
        first = int(np.argmin(low))
        i, j = sorted((first, int(best[first])))
        if near[i, j] >= limit:
            break
        mean = (sizes[i] * near[i] + sizes[j] * near[j]) / (sizes[i] + sizes[j])
        near[i], near[:, i] = mean, mean
        near[i, i] = np.inf
        near[j], near[:, j] = np.inf, np.inf
        sizes[i] += sizes[j]
        labels[labels == j] = i
        now = near[:, i]
        changed = np.isin(best, (i, j)) & np.isfinite(low)
        closer = ~changed & ((now < low) | ((now == low) & (i < best)))
        best[closer], low[closer] = i, now[closer]
        again = np.arange(n) if unknown else np.union1d(np.flatnonzero(changed), (i, j))
        best[again] = near[again].argmin(1)
        low[again] = near[again, best[again]]
        if k <= most:
            found[k] = np.unique(labels, return_inverse=True)[1]
    return found


def cluster_means(unit: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(labels, sizes, means) of clusters, by ascending label."""
    own, place, sizes = np.unique(labels, return_inverse=True, return_counts=True)
    sums = np.zeros((len(own), unit.shape[1]))
    np.add.at(sums, place, unit)
    return own, sizes.astype(float), sums / sizes[:, None]


def first_members(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The first point of each point's cluster after merges of j into i."""
    into = np.arange(n)
    into[j] = i
    while (into[into] != into).any():
        into = into[into]
    return into


def close_merges(mean: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, distance) of average linkage, j being merged into i, of clusters of unit vectors given by their means, while two are less than 1 apart.

    The mean distance of two clusters is 1 less the product of their means, so no pair is held. Two that are each other's
    nearest are merged, whatever else is closer: a merge brings no cluster nearer to a third than its parts were, so that a
    nearest other stays the nearest until it is merged itself. Of those that have lost theirs, the closest look again first.
    Parts precede the whole, and are no further apart.
    """
    mean, sizes, at = mean.copy(), sizes.copy(), np.arange(len(mean))
    best, like, apart = np.zeros(len(mean), int), np.ones(len(mean)), np.zeros(len(mean))
    alive, lost = np.ones(len(mean), bool), np.ones(len(mean), bool)
    found, most = [(at[:0], at[:0], apart[:0])], len(mean)
    while True:
        rows = np.flatnonzero(lost)
        if len(rows) > most:
            rows = rows[np.argpartition(-like[rows], most - 1)[:most]]
        step = max(1, CELLS // max(1, len(mean)))
        for block in (rows[k : k + step] for k in range(0, len(rows), step)):
            each, alike = np.arange(len(block)), mean[block] @ mean.T
            alike[each, block] = -np.inf
            best[block] = alike.argmax(1)
            like[block] = alike[each, best[block]]
        lost[rows] = False
        # A mean of zeros, as merged ones have, is never nearer than 1.
        known = ~lost & (like > 0)
        i = np.flatnonzero(known)
        i = i[(best[best[i]] == i) & known[best[i]] & (i < best[i])]
        if not len(i) and lost.any():
            most = LOOKING
            continue
        if not len(i):
            if not known.any():
                return tuple(np.concatenate(c) for c in zip(*found))
            # Equal likenesses that rounding has put in a ring: the two closest.
            i = np.flatnonzero(known)
            i = i[[like[i].argmax()]]
        i, j = np.minimum(i, best[i]), np.maximum(i, best[i])
        apart[i] = np.maximum(1.0 - np.maximum(like[i], like[j]), np.maximum(apart[i], apart[j]))
        found.append((at[i], at[j], apart[i]))
        mean[i] = (sizes[i, None] * mean[i] + sizes[j, None] * mean[j]) / (sizes[i] + sizes[j])[:, None]
        sizes[i] += sizes[j]
        mean[j], like[j], alive[j] = 0.0, -1.0, False
        merged = np.zeros(len(mean), bool)
        merged[i] = merged[j] = True
        lost |= merged[best] & (like > 0)
        lost[i] = True
        most = max(LOOKING, 2 * len(i))
        if alive.sum() < 0.75 * len(mean):
            best = (np.cumsum(alive) - 1)[best]
            mean, sizes, at, best, like, apart, lost, alive = (v[alive] for v in (mean, sizes, at, best, like, apart, lost, alive))


def blockwise_linkage(x: np.ndarray, least: int = 1, limit: float = np.inf, most: int | None = None) -> dict[int, np.ndarray]:
    """`average_linkage` of the vectors' cosine distances, in memory that grows with the vectors; time is quadratic.

    Where distances are equal but for rounding, either merge can come first, as it can on the whole matrix.
    """
    n = len(x)
    most = n if most is None else most
    if n <= DENSE:
        return average_linkage(cosine_distances(x), least, limit, most)
    unit = unit_vectors(x)
    unknown = np.flatnonzero(np.isnan(unit).any(1))
    last: dict[int, np.ndarray] = {}
    if len(unknown):
        # A distance that is no number precedes all others: the first vector takes the first of those, then all others in order.
        j = np.array([v for v in dict.fromkeys((int(unknown[0]), *range(n))) if v])
        i, far = np.zeros_like(j), np.full(n - 1, np.nan)
    else:
        # Equal vectors first: those equal to nine digits are closer than a distance in double precision can tell.
        some, empty = np.flatnonzero(unit.any(1)), np.flatnonzero(~unit.any(1))
        first: dict[bytes, int] = {}
        own = np.array([first.setdefault(v.tobytes(), at) for at, v in zip(some.tolist(), unit[some].round(9) + 0.0)], int)
        copies = np.flatnonzero(own != some)
        copies = copies[np.argsort(own[copies], kind="stable")]
        lead, sizes, mean = cluster_means(unit[some], own)
        a, b, far = close_merges(mean, sizes)
        i, j, far = np.r_[own[copies], lead[a]], np.r_[some[copies], lead[b]], np.r_[np.zeros(len(copies)), far]
        order = np.argsort(far, kind="stable")
        i, j, far = i[order], j[order], far[order]
        # What is left is 1 apart or more, at most two clusters a component but for vectors without length. Those are 1 from all:
        # the first cluster takes the first that is 1 from it, until all of them are taken.
        own = first_members(n, i, j)
        lead, sizes, mean = cluster_means(unit[some], own[some])
        taken, sums = [], mean * sizes[:, None]
        if len(empty):
            if len(lead) and lead[0] == 0:
                into, lead, sums = sums[0], lead[1:], sums[1:]
            else:
                into, empty = np.zeros(x.shape[1]), empty[1:]
            while len(empty):
                level = np.flatnonzero(sums @ into >= 0)
                until = int(np.searchsorted(empty, lead[level[0]])) if len(level) else len(empty)
                taken += empty[:until].tolist()
                empty = empty[until:]
                if len(empty):
                    taken.append(int(lead[level[0]]))
                    into, lead, sums = into + sums[level[0]], np.delete(lead, level[0]), np.delete(sums, level[0], 0)
            i, j, far = np.r_[i, np.zeros(len(taken), int)], np.r_[j, np.array(taken, int)], np.r_[far, np.ones(len(taken))]
            own = first_members(n, i, j)
        lead, sizes, mean = cluster_means(unit, own)
        last = {k: labels[np.searchsorted(lead, own)] for k, labels in average_linkage(np.clip(1.0 - mean @ mean.T, 0.0, 2.0), least, limit, most, sizes).items()}
    near = int(np.argmax(far >= limit)) if (far >= limit).any() else len(far)
    found = {}
    for k in range(min(most, n), least - 1, -1):
        if n - k <= near:
            found[k] = np.unique(first_members(n, i[: n - k], j[: n - k]), return_inverse=True)[1]
        elif near == len(far) and k in last:
            found[k] = last[k]
    return found


def silhouette(d: np.ndarray, labels: np.ndarray) -> float:
    """Mean of (between - within) / max of both; 0 for a point alone in its cluster."""
    member = members(labels)
    return silhouette_of_sums(d @ member, member)


def members(labels: np.ndarray) -> np.ndarray:
    return labels[:, None] == np.unique(labels)[None, :]


def silhouette_of_sums(sums: np.ndarray, member: np.ndarray) -> float:
    """`silhouette` from each point's summed distances to each cluster."""
    count = member.sum(0)
    own = member.argmax(1)
    rows = np.arange(len(sums))
    within = sums[rows, own] / np.maximum(count[own] - 1, 1)
    others = np.where(member, np.inf, sums / count)
    between = others.min(1)
    score = (between - within) / np.maximum(np.maximum(within, between), 1e-300)
    return float(np.where(count[own] > 1, score, 0.0).mean())


def blockwise_silhouettes(x: np.ndarray, cuts: list[np.ndarray]) -> list[float]:
    """`silhouette` of the vectors' cosine distances for each of these labels, in memory that grows with the vectors; all distances are taken once."""
    if len(x) <= DENSE:
        d = cosine_distances(x)
        return [silhouette(d, labels) for labels in cuts]
    unit = unit_vectors(x)
    each = [members(labels) for labels in cuts]
    ends = np.cumsum([m.shape[1] for m in each])
    member = np.hstack(each).astype(float)
    sums = np.empty(member.shape)
    for rows in row_blocks(len(x)):
        d = 1.0 - unit[rows] @ unit.T
        sums[rows] = np.clip(d, 0.0, 2.0, out=d) @ member
    return [silhouette_of_sums(sums[:, end - m.shape[1] : end], m) for end, m in zip(ends, each)]


def centroid_gap(x: np.ndarray, labels: np.ndarray) -> float:
    """Smallest cosine distance between cluster means."""
    means = np.stack([x[labels == c].mean(0) for c in np.unique(labels)])
    apart = cosine_distances(means)
    return float(apart[np.triu_indices(len(means), 1)].min()) if len(means) > 1 else 0.0


def eigengaps(d: np.ndarray, most: int) -> np.ndarray:
    """Gaps between the smallest eigenvalues of the normalised Laplacian of clipped similarities."""
    like = np.clip(1.0 - d, 0.0, 1.0)
    scale = 1.0 / np.sqrt(np.maximum(like.sum(1), 1e-8))
    values = np.sort(np.linalg.eigvalsh(np.eye(len(d)) - scale[:, None] * like * scale[None, :]))
    return np.diff(values[: most + 1])


def largest_eigenvalues(product, n: int, count: int) -> np.ndarray:
    """The largest eigenvalues, descending, of a symmetric matrix given by its product with n rows of columns: block Lanczos.

    All columns of the basis stay orthogonal, and a full one starts again from its best vectors, so that memory grows with n
    alone. Each value is within RESIDUAL of an eigenvalue. More equal values than a step's columns are found as far as asked for.
    """
    rng = np.random.default_rng(42)
    step = max(STEP, count + 1)
    q = np.linalg.qr(rng.standard_normal((n, step)))[0]
    basis, h = q, np.zeros((0, 0))
    while True:
        w = product(q)
        column = basis.T @ w
        old = len(h)
        grown = np.zeros((basis.shape[1], basis.shape[1]))
        grown[:old, :old], grown[:, old:], grown[old:, :old] = h, column, column[:old].T
        h = (grown + grown.T) / 2
        rest = w - basis @ column
        values, vectors = np.linalg.eigh(h)
        off = np.linalg.norm(rest @ vectors[old:, -count:], axis=0)
        if off.max() <= RESIDUAL:
            return values[::-1][:count]
        if len(h) + step > min(BASIS, n):
            kept = min(count + step, len(h) - 1)
            basis, h = basis @ vectors[:, -kept:], np.diag(values[-kept:])
        # What is left of a product; of columns that are spent, new directions.
        spent = np.linalg.norm(rest, axis=0) <= 1e-13
        rest[:, spent] = rng.standard_normal((n, int(spent.sum())))
        for _ in range(3):
            rest -= basis @ (basis.T @ rest)
            rest = np.linalg.qr(rest)[0]
        q = rest
        basis = np.hstack([basis, q])


def blockwise_eigengaps(x: np.ndarray, most: int) -> np.ndarray:
    """`eigengaps` of the vectors' cosine distances, in memory that grows with the vectors; all similarities are taken, again for each step."""
    if len(x) <= DENSE:
        return eigengaps(cosine_distances(x), most)
    unit = unit_vectors(x)
    if np.isnan(unit).any():
        # As on the whole matrix: steps would not end.
        raise np.linalg.LinAlgError("Eigenvalues did not converge")

    def likened(columns: np.ndarray) -> np.ndarray:
        out = np.empty((len(x), columns.shape[1]))
        for rows in row_blocks(len(x)):
            like = unit[rows] @ unit.T
            out[rows] = np.clip(like, 0.0, 1.0, out=like) @ columns
        return out

    scale = 1.0 / np.sqrt(np.maximum(likened(np.ones((len(x), 1))), 1e-8))
    return np.diff(1.0 - largest_eigenvalues(lambda v: scale * likened(scale * v), len(x), min(most + 1, len(x))))


def count_speakers(x: np.ndarray, most: int = 6, same: float = 0.18, floor: float = 0.22, distinct: float = 0.14, method: str = "silhouette") -> tuple[int, str]:
    """Number of speakers and the rule that decided: few vectors, close means, weak silhouettes, then the best k."""
    n = len(x)
    if n <= 1:
        return 1, "insufficient_segments"
    most = min(most, n - 1)
    if most < 2:
        return (1 if cosine_distances(x[:2])[0, 1] < same else 2), "single_pair"
    cuts = blockwise_linkage(x, 2, most=most)
    tried = range(2, most + 1)
    fit = {k: (round(s, 4), round(centroid_gap(x, cuts[k]), 4)) for k, s in zip(tried, blockwise_silhouettes(x, [cuts[k] for k in tried]))}
    if fit[2][1] < same:
        return 1, "k1_centroid_distance_below_threshold"
    if max(s for s, _ in fit.values()) < floor:
        return 1, "k1_silhouette_floor"
    if method == "eigengap":
        gaps = blockwise_eigengaps(x, most)
        if len(gaps) >= 2:
            return int(np.argmax(gaps[1:])) + 2, "eigengap_max"
    apart = {k: v for k, v in fit.items() if v[1] >= distinct} or fit
    return max(apart, key=lambda k: apart[k][0]), "silhouette_max"


def greedy_clusters(x: np.ndarray, least: float = 0.75) -> np.ndarray:
    """Each vector joins the most similar running mean above `least`, else opens a cluster."""
    sums: list[np.ndarray] = []
    labels = np.zeros(len(x), int)
    for i, v in enumerate(x):
        like = [float(v @ s / max(np.linalg.norm(v) * np.linalg.norm(s), 1e-12)) for s in sums]
        best = int(np.argmax(like)) if like else -1
        if best < 0 or like[best] <= least:
            sums.append(np.zeros_like(v))
            best = len(sums) - 1
        sums[best] = sums[best] + v
        labels[i] = best
    return labels


def per_record(voices: DataFrame, schema: str, run) -> DataFrame:
    """run(record_id, ids, matrix) for each record, vectors in order of vec_id; gives rows of `schema`.

    Work grows faster than a record's bytes, so records are dealt to parts that are not merged by size.
    """

    workers.ship(voices.sparkSession)
    parts = max(PARTS, int(voices.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def group(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id", ignore_index=True)
        return pd.DataFrame(run(key[0], pdf["vec_id"].to_numpy(), np.stack([np.asarray(v, float) for v in pdf["embedding"]])))

    return voices.where("embedding IS NOT NULL").select("record_id", "vec_id", "embedding").repartition(parts, "record_id").groupBy("record_id").applyInPandas(group, schema)


def agglomerative(spark: SparkSession, sf_dir: str) -> DataFrame:
    def run(r, ids, x):
        cuts = blockwise_linkage(x, min(3, len(x)), most=min(3, len(x)))
        return {"record_id": r, "vec_id": ids, "cluster": cuts[min(cuts)]}

    return per_record(vectors.voices(spark, sf_dir), "record_id long, vec_id long, cluster int", run)


def speaker_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    def run(r, ids, x):
        k, rule = count_speakers(x)
        return {"record_id": [r], "k": [k], "rule": [rule]}

    return per_record(vectors.voices(spark, sf_dir), "record_id long, k int, rule string", run)


def eigengap(spark: SparkSession, sf_dir: str) -> DataFrame:
    def run(r, ids, x):
        gaps = blockwise_eigengaps(x, min(10, len(x)))
        return {"record_id": r, "i": range(len(gaps)), "gap": gaps.round(4)}

    return per_record(vectors.voices(spark, sf_dir), "record_id long, i int, gap double", run)


QUERIES = {"agglomerative": agglomerative, "speaker_count": speaker_count, "eigengap": eigengap}
