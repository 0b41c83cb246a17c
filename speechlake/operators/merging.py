"""Merging of small or superfluous speakers of a recording, by voice and by time.

Small speakers go to the major one whose voice is most alike, or stay if none is alike
enough and no count was asked for; without a voice they go to the major speaker nearest in
time. If more speakers than asked for are left, those without a voice are merged first, then
the most alike pairs, into the one that speaks longer.

A recording's intervals and its few speakers' vectors are one task: a recording has hours of
speech at most, not a share of the table. Everything else is planned by the engine.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import fixtures, workers
from . import coverage

#: Fixed value: voices less alike than this are not merged unless a count was asked for.
ALIKE = 0.5
SCHEMA = "record_id long, speaker_id string, start_us long, end_us long, n_merged long"


def unit(v: np.ndarray) -> np.ndarray:
    return v / (np.linalg.norm(v) + 1e-12)


def nearest(start: int, end: int, rows: list[tuple]) -> str:
    """The speaker of the interval (speaker, start, end) nearest in time: the first that overlaps, else the first of the smallest gap."""
    best, gap = None, None
    for speaker, a, b in rows:
        if a < end and start < b:
            return speaker
        far = max(a - end, start - b, 0)
        if gap is None or far < gap:
            best, gap = speaker, far
    return best


def to_majors(rows: list[tuple], small: set[str], voices: dict[str, np.ndarray], asked: int) -> dict[str, str]:
    """New speakers of the small ones; one that is alike none and not asked to go is left out."""
    major = [s for s in dict.fromkeys(r[0] for r in rows) if s not in small]
    intervals = [r for r in rows if r[0] in major]
    into: dict[str, str] = {}
    for s in sorted(small):
        likes = [(float(unit(voices[s]) @ unit(voices[m])), m) for m in major if s in voices and m in voices]
        if likes:
            best = max(likes, key=lambda x: x[0])
            if best[0] >= ALIKE or asked > 0:
                into[s] = best[1]
            continue
        longest = max((r for r in rows if r[0] == s), key=lambda r: r[2] - r[1])
        into[s] = nearest(longest[1], longest[2], intervals)
    return into


def down_to(rows: list[tuple], target: int, voices: dict[str, np.ndarray]) -> dict[str, str]:
    """Old to new speaker, until `target` are left."""
    names = sorted({r[0] for r in rows})
    into, left, voice = {s: s for s in names}, set(names), {s: v.copy() for s, v in voices.items()}
    time = {s: sum(max(0, b - a) for t, a, b in rows if t == s) for s in names}

    def move(gone: str, kept: str) -> None:
        for s, now in into.items():
            if now == gone:
                into[s] = kept
        left.remove(gone)

    for s in [s for s in names if s not in voice]:
        if len(left) <= target:
            break
        heard = [r for r in rows if r[0] in voice]
        own = next(r for r in rows if r[0] == s)
        kept = nearest(own[1], own[2], heard) if heard else max(sorted(left - {s}), key=time.get)
        kept = into[kept]
        move(s, kept)
        time[kept] += time[s]
    while len(left) > max(target, 1):
        known = sorted(s for s in left if s in voice)
        pairs = [(float(unit(voice[a]) @ unit(voice[b])), a, b) for i, a in enumerate(known) for b in known[i + 1 :]]
        if pairs:
            _, a, b = max(pairs, key=lambda p: p[0])
        else:
            b, a = sorted(sorted(left), key=time.get)[:2]
        kept, gone = (a, b) if time[a] >= time[b] else (b, a)
        move(gone, kept)
        if gone in voice:
            if kept in voice:
                voice[kept] = unit(voice[kept] + voice[gone])
            del voice[gone]
    return into


def capped(speakers: DataFrame, asked: int) -> DataFrame:
    """speakers (record_id, speaker_id, us, small): no more small ones than may go if `asked` are to be left, the shortest first."""
    if asked <= 0:
        return speakers
    from pyspark.sql import Window

    record = Window.partitionBy("record_id")
    rank = F.row_number().over(record.orderBy(F.desc("small"), "us", "speaker_id"))
    return speakers.withColumn("small", F.col("small") & (rank <= F.count("*").over(record) - asked))


def joined(rows: list[tuple], gap_us: int = 50_000) -> list[tuple]:
    """Neighbours (speaker, start, end, n) in order of start that are of one speaker and at most a gap apart become one."""
    out: list[tuple] = []
    for s, a, b, n in sorted(rows, key=lambda r: r[1]):
        if out and out[-1][0] == s and a <= out[-1][2] + gap_us:
            out[-1] = (s, out[-1][1], max(out[-1][2], b), out[-1][3] + n)
        else:
            out.append((s, a, b, n))
    return out


def merged(rows: list[tuple], small: set[str], voices: dict[str, np.ndarray], asked: int) -> list[tuple]:
    """The intervals (speaker, start, end, 1) of one recording after merging: as they came where nothing has to change."""
    names = {r[0] for r in rows}
    if len(names) <= max(1, asked):
        return rows
    into = to_majors([r[:3] for r in rows], small, voices, asked)
    if into:
        rows = joined([(into.get(s, s), a, b, n) for s, a, b, n in rows])
    if 0 < asked < len({r[0] for r in rows}):
        into = down_to([r[:3] for r in rows], asked, voices)
        rows = joined([(into[s], a, b, n) for s, a, b, n in rows])
    return rows


def merge_speakers(segments: DataFrame, voices: DataFrame, asked: int = 0, least_us: int = 0, share: float = 0.15) -> DataFrame:
    """(record_id, speaker_id, start_us, end_us, n_merged) of segments (record_id, seg_idx, speaker_id, start_us, end_us) and voices (record_id, speaker_id, voice).

    A recording of one speaker, of no more than asked, or without small speakers to be merged comes back as it
    was, interval by interval. Voices meet the intervals once a recording.
    """
    workers.ship(segments.sparkSession)
    told = capped(coverage.small_speakers(segments, least_us, share), asked).select("record_id", "speaker_id", "small")
    rows = segments.withColumn("record_id", F.col("record_id").cast("long")).join(told, ["record_id", "speaker_id"]).select("record_id", F.col("seg_idx").alias("seq"), "speaker_id", "start_us", "end_us", "small")
    heard = voices.where("voice IS NOT NULL").select("record_id", F.col("speaker_id").alias("own"), "voice")

    def run(key: tuple, own: pa.Table, heard: pa.Table) -> pa.Table:
        own = own.sort_by([("start_us", "ascending"), ("seq", "ascending")]).to_pydict()
        rows = [(s, a, b, 1) for s, a, b in zip(own["speaker_id"], own["start_us"], own["end_us"])]
        small = {s for s, is_small in zip(own["speaker_id"], own["small"]) if is_small}
        voice = {s: np.asarray(v, float) for s, v in zip(heard.column("own").to_pylist(), heard.column("voice").to_pylist())}
        out = merged(rows, small, voice, asked) if rows else []
        speaker, start, end, n = map(list, zip(*out)) if out else ([], [], [], [])
        record = [own["record_id"][0]] * len(out) if out else []
        return pa.Table.from_arrays([pa.array(record, pa.int64()), pa.array(speaker, pa.string()), *(pa.array(x, pa.int64()) for x in (start, end, n))], names)

    names = [c.split()[0] for c in SCHEMA.split(", ")]
    return rows.groupBy("record_id").cogroup(heard.groupBy("record_id")).applyInArrow(run, SCHEMA)


def first_usable(found: DataFrame, key: str, engines: list[str]) -> tuple[DataFrame, DataFrame]:
    """A fallback chain: of found (key, engine, n) each key's first engine with a result, and how often it fell from one to another."""
    from pyspark.sql import Window

    rank = F.array_position(F.array(*map(F.lit, engines)), F.col("engine"))
    first = F.row_number().over(Window.partitionBy(key).orderBy("rank"))
    chosen = found.withColumn("rank", rank).where("rank > 0 and n > 0").withColumn("first", first).where("first = 1").drop("first")
    fallen = chosen.where("rank > 1").groupBy(F.lit(engines[0]).alias("from"), F.col("engine").alias("to")).count()
    return chosen.drop("rank"), fallen


def escalate(records: DataFrame, count: str, known: str, unknown: str) -> DataFrame:
    """Adds engine: where the number of speakers is not known the stronger one."""
    return records.withColumn("engine", F.when(F.coalesce(F.col(count), F.lit(0)) > 0, F.lit(known)).otherwise(F.lit(unknown)))


def rescue_slices(gaps: DataFrame, duration: str = "duration_us") -> DataFrame:
    """Adds from_us and to_us: a gap with half a second around it, within the recording; those below a second are left out."""
    end = F.col("end_us") + 500_000
    own = gaps.withColumn("from_us", F.greatest(F.lit(0), F.col("start_us") - 500_000)).withColumn("to_us", F.when(F.col(duration) > 0, F.least(F.col(duration), end)).otherwise(end))
    return own.where(F.col("to_us") - F.col("from_us") >= 1_000_000)


def rescued(words: DataFrame, heard: DataFrame) -> DataFrame:
    """words with those of heard (record_id, word, start_us, end_us, from_us, to_us), shifted to their slice and within it, numbered anew by start."""
    from pyspark.sql import Window

    shift = heard.select("record_id", "word", *[(F.round((F.col(c) + F.col("from_us")) / 1e4) * 10_000).cast("long").alias(c) for c in ("start_us", "end_us")], "from_us", "to_us")
    good = shift.where((F.col("start_us") >= F.col("from_us") - 200_000) & (F.col("end_us") <= F.col("to_us") + 500_000))
    columns = ["record_id", "word", "start_us", "end_us"]
    both = words.select("w_idx", *columns).unionByName(good.select(F.lit(None).cast("long").alias("w_idx"), *columns))
    order = Window.partitionBy("record_id").orderBy("start_us", F.col("w_idx").asc_nulls_last(), "end_us", "word")
    return both.withColumn("w_idx", (F.row_number().over(order) - 1).cast("long"))


def _voices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two components of `embeddings` as voices of the users' event types, five vectors a user: the derived input of FIXTURES.md."""
    kinds = F.array(*map(F.lit, KINDS))
    own = spark.read.parquet(f"{sf_dir}/embeddings.parquet").withColumn("speaker_id", F.element_at(kinds, (F.col("vec_id") % 5 + 1).cast("int")))
    return own.select(F.floor(F.col("vec_id") / 5).alias("record_id"), "speaker_id", F.slice("embedding", 1, 2).cast("array<double>").alias("voice"))


def q_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge_speakers(fixtures.segments_ev(spark, sf_dir), _voices(spark, sf_dir))


def q_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most three speakers a record."""
    return merge_speakers(fixtures.segments_ev(spark, sf_dir), _voices(spark, sf_dir), asked=3)


#: The event types, in the order in which vectors are dealt to them.
KINDS = ("click", "error", "purchase", "signup", "view")
QUERIES = {"merged_speakers": q_merged, "enforce_target": q_target}
#: Behind segments_ev and small: each small speaker by voice, or by time to the major of its longest interval's neighbour.
MERGED_SQL = """, voices AS (
        SELECT vec_id // 5 AS record_id, ['click', 'error', 'purchase', 'signup', 'view'][CAST(vec_id % 5 AS INT) + 1] AS speaker_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings
    ), likes AS (
        SELECT s.record_id, s.speaker_id, m.speaker_id AS major, (a.x * b.x + a.y * b.y) / (sqrt(a.x * a.x + a.y * a.y) * sqrt(b.x * b.x + b.y * b.y)) AS alike
        FROM small s JOIN small m ON s.record_id = m.record_id AND s.small AND NOT m.small
        JOIN voices a ON a.record_id = s.record_id AND a.speaker_id = s.speaker_id JOIN voices b ON b.record_id = m.record_id AND b.speaker_id = m.speaker_id
    ), by_voice AS (
        SELECT record_id, speaker_id, max(alike) AS alike, arg_max(major, alike) AS major FROM likes GROUP BY record_id, speaker_id
    ), longest AS (
        SELECT s.* FROM segments_ev s JOIN small m ON s.record_id = m.record_id AND s.speaker_id = m.speaker_id AND m.small
        QUALIFY row_number() OVER (PARTITION BY s.record_id, s.speaker_id ORDER BY s.end_us - s.start_us DESC, s.start_us, s.seg_idx) = 1
    ), by_time AS (
        SELECT l.record_id, l.speaker_id, b.speaker_id AS major FROM longest l JOIN segments_ev b ON b.record_id = l.record_id JOIN small m ON m.record_id = b.record_id AND m.speaker_id = b.speaker_id AND NOT m.small
        WHERE NOT EXISTS (SELECT 1 FROM by_voice v WHERE v.record_id = l.record_id AND v.speaker_id = l.speaker_id)
        QUALIFY row_number() OVER (PARTITION BY l.record_id, l.speaker_id ORDER BY CASE WHEN b.start_us < l.end_us AND l.start_us < b.end_us THEN -1 ELSE greatest(0, l.start_us - b.end_us, b.start_us - l.end_us) END, b.start_us, b.seg_idx) = 1
    ), target AS (
        SELECT record_id, speaker_id, major FROM by_voice WHERE alike >= 0.5 UNION ALL SELECT * FROM by_time
    ), moved AS (
        SELECT s.record_id, seg_idx, coalesce(major, s.speaker_id) AS speaker_id, start_us, end_us, EXISTS (SELECT 1 FROM target c WHERE c.record_id = s.record_id) AS changed
        FROM segments_ev s LEFT JOIN target t ON t.record_id = s.record_id AND t.speaker_id = s.speaker_id
    ), runs AS (
        SELECT *, sum(new) OVER (PARTITION BY record_id ORDER BY start_us, seg_idx ROWS UNBOUNDED PRECEDING) AS run
        FROM (SELECT *, CASE WHEN changed AND speaker_id = lag(speaker_id) OVER (PARTITION BY record_id ORDER BY start_us, seg_idx) THEN 0 ELSE 1 END AS new FROM moved) x
    ), cut AS (
        SELECT *, CASE WHEN start_us <= max(end_us) OVER (PARTITION BY record_id, run ORDER BY start_us, seg_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 50000 THEN 0 ELSE 1 END AS opens FROM runs
    )
    SELECT record_id, min(speaker_id) AS speaker_id, min(start_us) AS start_us, max(end_us) AS end_us, count(*) AS n_merged
    FROM (SELECT *, sum(opens) OVER (PARTITION BY record_id, run ORDER BY start_us, seg_idx ROWS UNBOUNDED PRECEDING) AS island FROM cut) y GROUP BY record_id, run, island"""
ORACLE_SQL: dict[str, str] = {}
