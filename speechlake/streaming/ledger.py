"""Jobs as keyed state on a stream of events, and the same fold over a table.

events: job_id, at (timestamp), seq (breaks ties of at), kind, token, ok, permanent. Kinds:

* DELIVERED: one more delivery of the job's message; from the third on an unfinished job is FAILED (a poison message).
* CLAIM: a PENDING job becomes PROCESSING, held by the token.
* RESULT: counts if the job is PROCESSING and the token holds (`jobs.holds`). ok completes it; else an attempt
  is counted, and the job is FAILED if the failure is permanent or the last allowed one, PENDING if not.

A job PROCESSING for longer than allowed is taken from its worker when the time has passed: PENDING, or FAILED
without attempts left. Events without a job, a time or a known kind change nothing.

On a stream events wait in the state until the watermark has passed them, so they are applied in
order of time however they arrive; later ones are dropped. Deadlines are timers.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators import jobs
from ..sources import workers

KINDS = ("DELIVERED", "CLAIM", "RESULT")
EVENT = "at long, seq long, kind string, token string, ok boolean, permanent boolean"
STATE = "status string, attempts int, deliveries int, token string, since long"
CHANGE = "job_id string, at timestamp, action string, status string, attempts int, deliveries int"


def stale(s: tuple, now: int) -> bool:
    return s[0] == "PROCESSING" and now > s[4] + jobs.STALE_S * 1_000_000


def taken_back(s: tuple) -> tuple:
    return ("FAILED" if s[1] >= jobs.MAX_ATTEMPTS else "PENDING", s[1], s[2], None, None)


def applied(s: tuple, e: tuple) -> tuple[tuple, str | None]:
    """State (status, attempts, deliveries, token, since) after event (at, seq, kind, token, ok, permanent), and what was done, if anything."""
    status, attempts, deliveries, held, since = s
    at, _, kind, token, ok, permanent = e
    if kind == "DELIVERED":
        deliveries += 1
        if deliveries >= jobs.POISON and status not in ("COMPLETED", "FAILED"):
            return ("FAILED", attempts, deliveries, None, None), "POISON"
        return (status, attempts, deliveries, held, since), "DELIVERED"
    if kind == "CLAIM" and status == "PENDING":
        return ("PROCESSING", attempts, deliveries, token, at), "CLAIMED"
    if kind == "RESULT" and status == "PROCESSING" and ok is not None and (token is None or held is None or token == held):
        if ok:
            return ("COMPLETED", attempts, deliveries, None, None), "COMPLETED"
        attempts += 1
        final = bool(permanent) or attempts >= jobs.MAX_ATTEMPTS
        return ("FAILED" if final else "PENDING", attempts, deliveries, None, None), "FAILED" if final else "RETRY"
    return s, None


class Ledger(StatefulProcessor):
    """Per job: its state, and the events that the watermark has not passed."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", STATE)
        self.waiting = handle.getListState("waiting", EVENT)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        arrived = [(r.us, r.seq, r.kind, r.token, r.ok, r.permanent) for r in rows]
        self.waiting.appendList(arrived)
        for at in {a[0] for a in arrived}:
            self.handle.registerTimer(-(-at // 1000))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        import datetime

        # Whichever timer it is: all up to the watermark is known, and a deadline set on the way may be past it too.
        now = timerValues.getCurrentWatermarkInMs() * 1000
        s = self.state.get() if self.state.exists() else ("PENDING", 0, 0, None, None)
        s = tuple(s)
        waiting = [tuple(e) for e in self.waiting.get()] if self.waiting.exists() else []
        due = sorted((e for e in waiting if e[0] <= now), key=lambda e: (e[0], e[1]))
        out = []

        def changed(at: int, action: str) -> None:
            moment = datetime.datetime.fromtimestamp(at // 1_000_000, datetime.timezone.utc) + datetime.timedelta(microseconds=at % 1_000_000)
            out.append(Row(job_id=key[0], at=moment, action=action, status=s[0], attempts=s[1], deliveries=s[2]))

        for e in [*due, None]:
            at = now if e is None else e[0]
            if stale(s, at):
                over = s[4] + jobs.STALE_S * 1_000_000
                s = taken_back(s)
                changed(over, "TAKEN_BACK")
            if e is not None:
                s, action = applied(s, e)
                if action:
                    changed(at, action)
                if action == "CLAIMED":
                    self.handle.registerTimer((at + jobs.STALE_S * 1_000_000) // 1000 + 1)
        if due:
            left = [e for e in waiting if e[0] > now]
            if left:
                self.waiting.put(left)
            else:
                self.waiting.clear()
        self.state.update(s)
        return iter(out)


def known(events: DataFrame) -> DataFrame:
    """The events that count, the job as text."""
    return events.where(F.col("job_id").isNotNull() & F.col("at").isNotNull() & F.col("kind").isin(*KINDS)).withColumn("job_id", F.col("job_id").cast("string")).withColumn("seq", F.coalesce("seq", F.lit(0)).cast("long"))


def changes(events: DataFrame, late: str = "0 seconds") -> DataFrame:
    """The changes (CHANGE) of a stream of events, in append mode: each once the watermark, `late` behind the newest event, has passed it.

    The session's state store must be one that holds timers and lists (RocksDB).
    """
    workers.ship(events.sparkSession)
    rows = known(events).select("job_id", "at", F.unix_micros(F.col("at").cast("timestamp")).alias("us"), "seq", "kind", "token", "ok", "permanent")
    return rows.withWatermark("at", late).groupBy("job_id").transformWithState(Ledger(), CHANGE, "append", "EventTime")


def created(requests: DataFrame, key: str = "external_id", at: str = "at", late: str = "1 hour") -> DataFrame:
    """Requests on a stream, each key once: repeats that come within `late` of the first, in event time, are dropped. Requests without a key all pass."""
    marked = requests.withWatermark(at, late).withColumn("__key", F.coalesce(F.concat(F.lit("k"), F.col(key).cast("string")), F.concat(F.lit("n"), F.expr("uuid()"))))
    return marked.dropDuplicatesWithinWatermark(["__key"]).drop("__key")


def final(events: DataFrame, as_of_us: int | None = None) -> DataFrame:
    """(job_id, status, attempts, deliveries) of a table of events: the same fold, in order, at as_of_us (the newest event, where it isn't given).

    A job's events are sorted and folded by the engine's own array functions; those of one job are one row.
    """
    rows = known(events).select("job_id", F.struct(F.unix_micros(F.col("at").cast("timestamp")).alias("at"), "seq", "kind", "token", "ok", "permanent").alias("e"))
    if as_of_us is not None:
        rows = rows.where(F.col("e.at") <= as_of_us)
    end = rows.agg(F.max("e.at").alias("end")) if as_of_us is None else events.sparkSession.range(1).select(F.lit(as_of_us).cast("long").alias("end"))
    by = rows.groupBy("job_id").agg(F.array_sort(F.collect_list("e")).alias("es")).join(F.broadcast(end))  # one row

    def back(s, now):
        over = (s["status"] == "PROCESSING") & (now > s["since"] + jobs.STALE_S * 1_000_000)
        none = F.lit(None)
        return F.when(over, record(F.when(s["attempts"] >= jobs.MAX_ATTEMPTS, "FAILED").otherwise("PENDING"), s["attempts"], s["deliveries"], none, none)).otherwise(s)

    def record(status, attempts, deliveries, token, since):
        return F.struct(status.alias("status"), attempts.cast("int").alias("attempts"), deliveries.cast("int").alias("deliveries"), token.cast("string").alias("token"), since.cast("long").alias("since"))

    def fold(s0, e):
        s, none = back(s0, e["at"]), F.lit(None)
        more = s["deliveries"] + 1
        poison = (more >= jobs.POISON) & ~s["status"].isin("COMPLETED", "FAILED")
        tried = s["attempts"] + 1
        counts = (e["kind"] == "RESULT") & (s["status"] == "PROCESSING") & e["ok"].isNotNull() & jobs.holds(e["token"], s["token"])
        last = F.coalesce(e["permanent"], F.lit(False)) | (tried >= jobs.MAX_ATTEMPTS)
        return (
            F.when((e["kind"] == "DELIVERED") & poison, record(F.lit("FAILED"), s["attempts"], more, none, none))
            .when(e["kind"] == "DELIVERED", record(s["status"], s["attempts"], more, s["token"], s["since"]))
            .when((e["kind"] == "CLAIM") & (s["status"] == "PENDING"), record(F.lit("PROCESSING"), s["attempts"], s["deliveries"], e["token"], e["at"]))
            .when(counts & e["ok"], record(F.lit("COMPLETED"), s["attempts"], s["deliveries"], none, none))
            .when(counts, record(F.when(last, "FAILED").otherwise("PENDING"), tried, s["deliveries"], none, none))
            .otherwise(s)
        )

    first = record(F.lit("PENDING"), F.lit(0), F.lit(0), F.lit(None), F.lit(None))
    done = by.select("job_id", F.aggregate("es", first, fold, lambda s: back(s, F.col("end"))).alias("s"))
    return done.select("job_id", "s.status", "s.attempts", "s.deliveries")


# Query: the lines of an order are its events.


def line_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as jobs, each line an event: the derived input of FIXTURES.md."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    kind = F.when(F.col("l_linenumber") % 3 == 0, "RESULT").when(F.col("l_suppkey") % 4 == 0, "DELIVERED").otherwise("CLAIM")
    token = F.when(F.col("l_suppkey") % 3 != 0, (F.col("l_suppkey") % 2).cast("string"))
    at = F.col("l_shipdate") + F.make_interval(secs=(F.col("l_partkey") % 900).cast("int"))
    seq = (F.col("l_linenumber") * 100_000_000 + F.col("l_partkey") * 100 + F.col("l_suppkey") % 100).cast("long")
    return li.select(F.col("l_orderkey").alias("job_id"), at.alias("at"), seq.alias("seq"), kind.alias("kind"), token.alias("token"), (F.col("l_returnflag") == "N").alias("ok"), (F.col("l_linestatus") == "F").alias("permanent")).distinct()


def job_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return final(line_events(spark, sf_dir))


QUERIES = {"job_ledger": job_ledger}
ORACLE_SQL = {
    # A walk from event to event by recursion.
    "job_ledger": """
        WITH RECURSIVE ev AS (
            SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS job_id, epoch_us(l_shipdate + to_seconds(l_partkey % 900)) AS at_us, l_linenumber * 100000000 + l_partkey * 100 + l_suppkey % 100 AS seq,
                   CASE WHEN l_linenumber % 3 = 0 THEN 'RESULT' WHEN l_suppkey % 4 = 0 THEN 'DELIVERED' ELSE 'CLAIM' END AS kind,
                   CASE WHEN l_suppkey % 3 <> 0 THEN CAST(l_suppkey % 2 AS VARCHAR) END AS token, l_returnflag = 'N' AS ok, l_linestatus = 'F' AS permanent
            FROM lineitem
        ), numbered AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY at_us, seq, kind, token NULLS FIRST, ok, permanent) AS turn FROM ev
        ), walk AS (
            SELECT job_id, CAST(0 AS BIGINT) AS turn, 'PENDING' AS status, 0 AS attempts, 0 AS deliveries, CAST(NULL AS VARCHAR) AS held, CAST(NULL AS BIGINT) AS since FROM (SELECT DISTINCT job_id FROM ev) x
            UNION ALL
            SELECT job_id, turn,
                   CASE WHEN poison THEN 'FAILED' WHEN claims THEN 'PROCESSING' WHEN counts AND ok THEN 'COMPLETED' WHEN counts AND (permanent OR attempts >= 2) THEN 'FAILED' WHEN counts THEN 'PENDING' ELSE status END,
                   attempts + CASE WHEN counts AND NOT ok THEN 1 ELSE 0 END, deliveries + CASE WHEN kind = 'DELIVERED' THEN 1 ELSE 0 END,
                   CASE WHEN poison OR counts THEN NULL WHEN claims THEN token ELSE held END, CASE WHEN poison OR counts THEN NULL WHEN claims THEN at_us ELSE since END
            FROM (
                SELECT *, kind = 'DELIVERED' AND deliveries >= 2 AND status NOT IN ('COMPLETED', 'FAILED') AS poison, kind = 'CLAIM' AND status = 'PENDING' AS claims,
                       kind = 'RESULT' AND status = 'PROCESSING' AND (token IS NULL OR held IS NULL OR token = held) AS counts
                FROM (
                    SELECT n.job_id, n.turn, n.at_us, n.kind, n.token, n.ok, n.permanent, w.attempts, w.deliveries,
                           CASE WHEN w.status = 'PROCESSING' AND n.at_us > w.since + 1800000000 THEN CASE WHEN w.attempts >= 3 THEN 'FAILED' ELSE 'PENDING' END ELSE w.status END AS status,
                           CASE WHEN w.status = 'PROCESSING' AND n.at_us > w.since + 1800000000 THEN NULL ELSE w.held END AS held, w.since
                    FROM walk w JOIN numbered n ON n.job_id = w.job_id AND n.turn = w.turn + 1
                ) a
            ) b
        )
        SELECT job_id, CASE WHEN status = 'PROCESSING' AND (SELECT max(at_us) FROM ev) > since + 1800000000 THEN CASE WHEN attempts >= 3 THEN 'FAILED' ELSE 'PENDING' END ELSE status END AS status, attempts, deliveries
        FROM walk QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY turn DESC) = 1""",
}
