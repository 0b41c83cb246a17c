"""Jobs, deliveries and their children as tables: each operator takes DataFrames and gives the rows that come next.

jobs: job_id, status, attempts, updated_at, token (when a worker claimed it) and any other
columns, which stay. Time is a parameter (`as_of`), never the clock, so results can be
repeated. Updates give whole new tables: write them beside the old ones and swap (`commit`).
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Seconds and counts after which jobs and deliveries are given up, from the reference behaviour.
STALE_S, PENDING_STALE_S, MAX_ATTEMPTS, MAX_DELIVERIES, PER_HOST, POISON = 1800, 300, 3, 5, 5, 3


def before(as_of: Column, seconds: int) -> Column:
    return as_of - F.make_interval(secs=F.lit(seconds))


def is_claimable(as_of: Column, stale_s: int = STALE_S) -> Column:
    """PENDING, or PROCESSING for too long."""
    return (F.col("status") == "PENDING") | ((F.col("status") == "PROCESSING") & (F.col("updated_at") < before(as_of, stale_s)))


def claim(jobs: DataFrame, requests: DataFrame, as_of: Column, stale_s: int = STALE_S) -> DataFrame:
    """(job_id, worker, at, outcome): of several requests (job_id, worker, at) for a job the first claims it.

    COMPLETED jobs are told as such to everyone; the others get LOST, or UNKNOWN without such a job.
    """
    known = jobs.select("job_id", F.col("status").alias("was"), is_claimable(as_of, stale_s).alias("free"))
    turn = F.row_number().over(Window.partitionBy("job_id").orderBy("at", "worker"))
    told = requests.withColumn("turn", turn).join(known, "job_id", "left")
    outcome = F.when(F.col("was").isNull(), "UNKNOWN").when(F.col("was") == "COMPLETED", "COMPLETED").when(F.col("free") & (F.col("turn") == 1), "CLAIMED").otherwise("LOST")
    return told.select("job_id", "worker", "at", outcome.alias("outcome"))


def holds(token: Column, own: Column) -> Column:
    """A result counts if it carries no token, the job has none, or both are the same."""
    return token.isNull() | own.isNull() | (token == own)


def told(rows: DataFrame, results: DataFrame, key: str | list[str]) -> tuple[DataFrame, dict[str, Column]]:
    """rows with the one result of their key, and the result's columns by name: they may be called as columns of the rows are."""
    keys = [key] if isinstance(key, str) else key
    names = {c: f"__{c}" for c in results.columns if c not in keys}
    met = rows.join(results.withColumnsRenamed(names).withColumn("__told", F.lit(True)), keys, "left")
    return met, {c: F.col(n) for c, n in (names | {"told": "__told"}).items()}


def settle(jobs: DataFrame, results: DataFrame, as_of: Column, most: int = MAX_ATTEMPTS) -> DataFrame:
    """jobs after results (job_id, result_token, ok, permanent), one a job: fenced ones and those of jobs not PROCESSING change nothing.

    Success completes; a failure counts an attempt (null attempts are none so far) and makes the job FAILED if it is permanent or the last, else PENDING.
    """
    met, r = told(jobs, results, "job_id")
    counts = F.coalesce(r["ok"].isNotNull() & (F.col("status") == "PROCESSING") & holds(r["result_token"], F.col("token")), F.lit(False))
    tried = F.when(counts & ~r["ok"], F.coalesce(F.col("attempts"), F.lit(0)) + 1).otherwise(F.col("attempts"))
    final = F.coalesce(r["permanent"], F.lit(False)) | (tried >= most)
    status = F.when(~counts, F.col("status")).when(r["ok"], "COMPLETED").when(final, "FAILED").otherwise("PENDING")
    new = {"attempts": tried, "status": status, "updated_at": F.when(counts, as_of).otherwise(F.col("updated_at"))}
    return met.select(*[new[c].alias(c) if c in new else F.col(c) for c in jobs.columns])


def sweep(jobs: DataFrame, as_of: Column, lag: int = 0, most: int = MAX_ATTEMPTS, limit: int = 50) -> DataFrame:
    """(job_id, action): what a sweep does: PUBLISH old PENDING jobs (unless the queue still has some), REQUEUE or FAIL stale ones; the oldest first."""
    pending = jobs.where((F.col("status") == "PENDING") & (F.col("updated_at") < before(as_of, PENDING_STALE_S))).orderBy("updated_at", "job_id").limit(0 if lag > 0 else limit)
    stale = jobs.where((F.col("status") == "PROCESSING") & (F.col("updated_at") < before(as_of, STALE_S))).orderBy("updated_at", "job_id").limit(limit)
    action = F.when(F.col("attempts") < most, "REQUEUE").otherwise("FAIL")
    return pending.select("job_id", F.lit("PUBLISH").alias("action")).unionByName(stale.select("job_id", action.alias("action")))


def route(results: DataFrame, most: int = POISON) -> DataFrame:
    """Adds sink: DLQ for poison messages and failed jobs, RETRY with retry_s for those to be tried again, else ACK."""
    sink = F.when(F.col("deliveries") >= most, "DLQ").when(F.col("status").isin("COMPLETED", "SKIPPED"), "ACK").when(F.col("status") == "FAILED", "DLQ").otherwise("RETRY")
    return results.withColumn("sink", sink).withColumn("retry_s", F.when(F.col("sink") == "RETRY", F.least(F.lit(30.0), F.pow(F.lit(2.0), F.greatest(F.lit(0), F.col("attempts") - 1)))))


def retain(jobs: DataFrame, children: DataFrame, cutoff: Column, statuses: tuple[str, ...] = ("COMPLETED", "FAILED")) -> tuple[DataFrame, DataFrame]:
    """Jobs and children (job_id) that stay when finished jobs created before `cutoff` go."""
    gone = F.col("status").isin(*statuses) & (F.col("created_at") < cutoff)
    expired = jobs.where(gone).select("job_id").distinct()
    return jobs.where(~F.coalesce(gone, F.lit(False))), children.join(expired, "job_id", "left_anti")


def deliver(deliveries: DataFrame, results: DataFrame, as_of: Column, most: int = MAX_DELIVERIES) -> DataFrame:
    """deliveries (delivery_id, status, attempts, next_at) after results (delivery_id, ok): SUCCESS, DEAD after the last attempt, else PENDING with a pause that doubles from 5 s.

    Where there is no further attempt, next_at stays as it was.
    """
    met, r = told(deliveries, results, "delivery_id")
    tried = F.col("attempts") + F.when(r["ok"].isNull(), 0).otherwise(1)
    status = F.when(r["ok"].isNull(), F.col("status")).when(r["ok"], "SUCCESS").when(tried >= most, "DEAD").otherwise("PENDING")
    pause = F.make_interval(secs=F.lit(5) * F.pow(F.lit(2), F.greatest(F.lit(0), tried - 1)).cast("int"))
    new = {"attempts": tried, "status": status, "next_at": F.when(r["ok"].isNotNull() & (status == "PENDING"), as_of + pause).otherwise(F.col("next_at"))}
    return met.select(*[new[c].alias(c) if c in new else F.col(c) for c in deliveries.columns])


def in_rounds(rows: DataFrame, host: str, order: list[str], at_once: int = PER_HOST) -> DataFrame:
    """Adds round: so many rows of a host at once. The rows of one host are one task."""
    turn = F.row_number().over(Window.partitionBy(host).orderBy(*order))
    return rows.withColumn("round", F.floor((turn - 1) / at_once).cast("int"))


def newest(rows: DataFrame, order: Column, most: int) -> DataFrame:
    """The `most` newest messages: a bounded stream."""
    return rows.orderBy(order.desc()).limit(most)


def fits(objects: DataFrame, keys: list[str], size: str, order: list[Column], cap: int) -> DataFrame:
    """Of each store the newest objects whose sizes add up to the cap at most; the others are evicted. The objects of one store are one task."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return objects.withColumn("held", F.sum(size).over(w)).where(F.col("held") <= cap).drop("held")


def over_limit(events: DataFrame, key: str, ts: str, most: int, width: str = "1 minute", slide: str | None = None) -> DataFrame:
    """(key, start, n): windows with more than `most` events, tumbling or sliding."""
    span = F.window(ts, width, slide) if slide else F.window(ts, width)
    return events.groupBy(key, span.alias("w")).count().where(F.col("count") > most).select(key, F.col("w.start").alias("start"), F.col("count").alias("n"))


def key_digest(key: Column) -> Column:
    """The first 16 hex digits of a key's SHA-256."""
    return F.substring(F.sha2(key.cast("string"), 256), 1, 16)


def stream_ms(message_id: Column) -> Column:
    """Epoch milliseconds of a stream id (ms-sequence)."""
    return F.split_part(message_id, F.lit("-"), F.lit(1)).cast("long")


def latest(log: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key: the table that a log of updates stands for."""
    last = F.row_number().over(Window.partitionBy(key).orderBy(*[F.desc(c) for c in order]))
    return log.withColumn("last", last).where("last = 1").drop("last")


def nth(children: DataFrame, parent: str, order: list[str]) -> DataFrame:
    """Adds nth: a child's place in its parent, from 0. The children of one parent are one task."""
    return children.withColumn("nth", F.row_number().over(Window.partitionBy(parent).orderBy(*order)) - 1)


def update_nth(children: DataFrame, parent: str, order: list[str], changes: DataFrame, column: str) -> DataFrame:
    """children with `column` replaced where changes (parent, nth, new) say so, by null too."""
    own = children.withColumn("__at", F.row_number().over(Window.partitionBy(parent).orderBy(*order)) - 1)
    met, r = told(own, changes.withColumnRenamed("nth", "__at"), [parent, "__at"])
    return met.select(*[F.when(r["told"], r["new"]).otherwise(F.col(column)).alias(column) if c == column else F.col(c) for c in children.columns])


def delete_nth(children: DataFrame, parent: str, order: list[str], gone: DataFrame) -> DataFrame:
    """children without those that gone (parent, nth) names."""
    own = children.withColumn("__at", F.row_number().over(Window.partitionBy(parent).orderBy(*order)) - 1)
    return own.join(gone.select(parent, F.col("nth").alias("__at")), [parent, "__at"], "left_anti").select(children.columns)


def replace_children(children: DataFrame, fresh: DataFrame, parent: str) -> DataFrame:
    """All children of the parents in `fresh` replaced by theirs."""
    return children.join(fresh.select(parent).distinct(), parent, "left_anti").unionByName(fresh)


def upsert_missing(store: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """store with those of `rows` whose key it lacks, each key once: a repeated copy changes nothing."""
    return store.unionByName(rows.dropDuplicates([key]).join(store.select(key), key, "left_anti").select(store.columns))


def promoted(names: DataFrame, taken: DataFrame) -> DataFrame:
    """Adds target to names (stem, order): the stem, or the first of stem_1, stem_2 and on that is neither taken (name) nor another's target.

    Names of one stem are dealt its free numbers in their order, all at once: the number of free
    ones before a taken number is that number less its rank among the taken. Targets met by two
    stems (a_1 may be a stem too) stay with the name that comes first; they are taken for the other stem, and
    the numbers are dealt again, until no target is met twice. Names of one stem are one task.
    """
    numbered = F.regexp_extract("name", "^(.*)_([1-9][0-9]{0,8})$", 2)
    found = taken.where("name IS NOT NULL").select("name").distinct()
    blocked = found.select(F.col("name").alias("stem"), F.lit(0).alias("k")).unionByName(
        found.where(numbered != "").select(F.regexp_extract("name", "^(.*)_([1-9][0-9]{0,8})$", 1).alias("stem"), numbered.cast("int").alias("k"))
    )
    own = Window.partitionBy("stem")
    while True:
        dealt = names.select("*", (F.row_number().over(own.orderBy("order")) - 1).alias("__v"), F.lit(0).alias("__b"))
        gaps = blocked.distinct().select("stem", (F.col("k") - F.row_number().over(own.orderBy("k")) + 1).alias("__v"), F.lit(1).alias("__b"))
        before = F.sum("__b").over(own.orderBy("__v").rangeBetween(Window.unboundedPreceding, Window.currentRow))
        k = (F.col("__v") + before).cast("int")
        out = dealt.unionByName(gaps, allowMissingColumns=True).withColumn("__k", k).where("__b = 0")
        out = out.withColumn("target", F.when(F.col("__k") == 0, F.col("stem")).otherwise(F.concat_ws("_", "stem", F.col("__k").cast("string"))))
        late = out.withColumn("__turn", F.row_number().over(Window.partitionBy("target").orderBy("order", "stem"))).where("__turn > 1").select("stem", F.col("__k").alias("k"))
        if late.isEmpty():
            return out.select(*names.columns, "target")
        blocked = blocked.unionByName(late)


def payload(jobs: DataFrame, turns: DataFrame) -> DataFrame:
    """(job_id, payload): what a finished job tells its listener, as JSON: COMPLETED with its turns, FAILED with attempts and message."""
    said = turns.groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("start_time", "end_time", "speaker_id", "text"))).alias("utterances"))
    own = jobs.where("status in ('COMPLETED', 'FAILED')").join(said, "job_id", "left")
    none = F.array().cast("array<struct<start_time:double,end_time:double,speaker_id:string,text:string>>")
    done = F.to_json(F.struct(F.col("job_id").cast("string").alias("job_id"), "file_name", "status", F.coalesce("utterances", none).alias("utterances")))
    failed = F.to_json(F.struct(F.col("job_id").cast("string").alias("job_id"), "file_name", "status", "attempts", "error_message"))
    return own.select("job_id", F.when(F.col("status") == "COMPLETED", done).otherwise(failed).alias("payload"))


def signature(secret: str, stamp: Column, body: Column) -> Column:
    """sha256=HMAC-SHA256(secret, stamp.body), from the two nested hashes of its definition."""
    import hashlib

    key = secret.encode()
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytearray(b ^ x for b in key)) for x in (0x36, 0x5C))
    message = F.concat(stamp.cast("string"), F.lit("."), body).cast("binary")
    first = F.unhex(F.sha2(F.concat(inner, message), 256))
    return F.concat(F.lit("sha256="), F.sha2(F.concat(outer, first), 256))


def commit(spark: SparkSession, tables: dict[str, DataFrame], folder: str) -> dict[str, str]:
    """A unit of work: all tables are written to a folder of their own, whose name becomes valid by one last marker; nothing is seen before."""
    at = f"{folder}/{uuid.uuid4().hex}"
    for name, df in tables.items():
        df.write.parquet(f"{at}/{name}")
    spark.range(1).coalesce(1).write.parquet(f"{at}/_committed_marker")
    return {name: f"{at}/{name}" for name in tables}


# Queries over the derived jobs of FIXTURES.md.

AS_OF = "TIMESTAMP_NTZ '2001-08-02 00:00:00'"


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    status = F.when(F.col("o_orderstatus") == "O", "PENDING").when(F.col("o_orderstatus") == "P", "PROCESSING").otherwise("COMPLETED")
    return orders.select(
        F.col("o_orderkey").alias("job_id"), status.alias("status"), (F.col("o_custkey") % 4).alias("attempts"), F.col("o_orderdate").alias("created_at"),
        (F.col("o_orderdate") + F.make_interval(secs=F.col("o_custkey") % 5000)).alias("updated_at"), (F.col("o_custkey") % 4 + 1).alias("token"),
    )


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet")


def q_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = _lines(spark, sf_dir).select(F.col("l_orderkey").alias("job_id"), (F.col("l_suppkey") * 1_000_000 + F.col("l_partkey")).alias("worker"), F.col("l_shipdate").alias("at")).distinct()
    return claim(_jobs(spark, sf_dir), asked, F.expr(AS_OF), 86_400).groupBy("job_id", "outcome").agg(F.count("*").alias("n"), F.min("worker").alias("least_worker"))


def q_settled(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = _lines(spark, sf_dir).groupBy(F.col("l_orderkey").alias("job_id")).agg(F.min("l_linenumber").cast("long").alias("result_token"), (F.min("l_returnflag") == "A").alias("permanent"), (F.max("l_returnflag") == "N").alias("ok"))
    return settle(_jobs(spark, sf_dir), told, F.expr(AS_OF)).select("job_id", "status", "attempts", "updated_at")


def q_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sweep(_jobs(spark, sf_dir), F.expr(AS_OF))


def q_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1).alias("host"))
    return in_rounds(pages, "host", ["page_id"]).select("page_id", "host", "round")


def q_delivered(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _jobs(spark, sf_dir).select(F.col("job_id").alias("delivery_id"), F.lit("PENDING").alias("status"), (F.col("attempts") + 1).alias("attempts"), F.col("updated_at").alias("next_at"))
    told = _lines(spark, sf_dir).groupBy(F.col("l_orderkey").alias("delivery_id")).agg((F.max("l_returnflag") == "N").alias("ok"))
    return deliver(own, told, F.expr(AS_OF))


def q_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return over_limit(events, "user_id", "ts", 1, "1 hour", "30 minutes").select("user_id", F.unix_micros(F.col("start").cast("timestamp")).alias("start_us"), "n")


def q_evicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("source", "doc_id", "n_chars")
    return fits(docs, ["source"], "n_chars", [F.desc("doc_id")], 200_000).select("source", "doc_id")


def q_nth(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role")
    changes = turns.where("turn % 2 = 0").select("conv_id", F.floor(F.col("turn") / 2).cast("int").alias("nth"), F.lit("edited").alias("new"))
    changed = update_nth(turns, "conv_id", ["turn"], changes, "role")
    return delete_nth(changed, "conv_id", ["turn"], changes.where("nth = 1").select("conv_id", F.lit(0).alias("nth")).distinct())


def q_signed(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return turns.select("conv_id", "turn", signature("key", F.col("turn"), F.col("text")).alias("signature"), key_digest(F.col("conv_id")).alias("digest"))


def q_promoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_brand").alias("stem"), F.col("p_partkey").alias("order"))
    taken = names.where("order % 50 = 0").select(F.when(F.col("order") % 100 == 0, F.col("stem")).otherwise(F.concat_ws("_", "stem", (F.col("order") % 7 + 1).cast("string"))).alias("name"))
    return promoted(names, taken).select("order", "target")


QUERIES = {
    "job_claims": q_claims,
    "job_results": q_settled,
    "job_sweep": q_sweep,
    "host_rounds": q_rounds,
    "delivery_results": q_delivered,
    "rate_limit_sliding": q_sliding,
    "store_eviction": q_evicted,
    "nth_changes": q_nth,
    "signed_payloads": q_signed,
    "promoted_names": q_promoted,
}
_J = """j AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'O' THEN 'PENDING' WHEN 'P' THEN 'PROCESSING' ELSE 'COMPLETED' END AS s, o_custkey % 4 AS a,
        o_orderdate + to_seconds(o_custkey % 5000) AS u, o_custkey % 4 + 1 AS tok FROM orders)"""
ORACLE_SQL = {
    "job_claims": f"""WITH {_J}, r AS (SELECT DISTINCT l_orderkey AS id, l_suppkey * 1000000 + l_partkey AS w, l_shipdate AS t FROM lineitem),
        f AS (SELECT id, first(w ORDER BY t, w) AS fw, min(t) AS ft FROM r GROUP BY id),
        o AS (SELECT r.id, r.w, CASE WHEN j.id IS NULL THEN 'UNKNOWN' WHEN s = 'COMPLETED' THEN 'COMPLETED'
                WHEN r.w = fw AND r.t = ft AND (s = 'PENDING' OR u < TIMESTAMP '2001-08-01 00:00:00') THEN 'CLAIMED' ELSE 'LOST' END AS outcome
              FROM r JOIN f ON f.id = r.id LEFT JOIN j ON j.id = r.id)
        SELECT id AS job_id, outcome, count(*) AS n, min(w) AS least_worker FROM o GROUP BY id, outcome""",
    "job_results": f"""WITH {_J}, r AS (SELECT l_orderkey AS id, min(l_linenumber) AS t, bool_or(l_returnflag = 'A') AS p, bool_or(l_returnflag = 'R') AS has_r, bool_or(l_returnflag > 'N') AS above, bool_or(l_returnflag = 'N') AS has_n FROM lineitem GROUP BY l_orderkey),
        m AS (SELECT j.*, r.id IS NOT NULL AND s = 'PROCESSING' AND t = tok AS hit, has_n AND NOT above AS good, p FROM j LEFT JOIN r ON r.id = j.id)
        SELECT id AS job_id, CASE WHEN hit AND good THEN 'COMPLETED' WHEN hit AND (p OR a >= 2) THEN 'FAILED' WHEN hit THEN 'PENDING' ELSE s END AS status,
            a + CASE WHEN hit AND NOT good THEN 1 ELSE 0 END AS attempts, CASE WHEN hit THEN TIMESTAMP '2001-08-02 00:00:00' ELSE u END AS updated_at FROM m""",
    "job_sweep": f"""WITH {_J}
        SELECT job_id, action FROM (SELECT id AS job_id, 'PUBLISH' AS action FROM j WHERE s = 'PENDING' AND u < TIMESTAMP '2001-08-01 23:55:00' ORDER BY u, id LIMIT 50) x
        UNION ALL SELECT * FROM (SELECT id, CASE WHEN a = 3 THEN 'FAIL' ELSE 'REQUEUE' END FROM j WHERE s = 'PROCESSING' AND u < TIMESTAMP '2001-08-01 23:30:00' ORDER BY u, id LIMIT 50) y""",
    "host_rounds": """WITH h AS (SELECT page_id, CASE WHEN url IS NOT NULL THEN regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) END AS host FROM pages)
        SELECT page_id, host, CAST((row_number() OVER (PARTITION BY host ORDER BY page_id) - 1) // 5 AS INT) AS round FROM h""",
    "delivery_results": f"""WITH {_J}, r AS (SELECT l_orderkey AS id, max(l_returnflag) = 'N' AS ok FROM lineitem GROUP BY 1)
        SELECT j.id AS delivery_id, CASE WHEN ok IS NULL THEN 'PENDING' WHEN ok THEN 'SUCCESS' WHEN a + 2 >= 5 THEN 'DEAD' ELSE 'PENDING' END AS status,
            a + CASE WHEN ok IS NULL THEN 1 ELSE 2 END AS attempts,
            CASE WHEN ok IS NULL THEN u WHEN NOT ok AND a < 3 THEN TIMESTAMP '2001-08-02 00:00:00' + to_seconds(CAST(5 * 2 ** (a + 1) AS BIGINT)) ELSE u END AS next_at
        FROM j LEFT JOIN r ON r.id = j.id""",
    "rate_limit_sliding": """WITH e AS (SELECT user_id, epoch_us(ts) // 1800000000 AS half FROM events), w AS (SELECT user_id, half AS h FROM e UNION ALL SELECT user_id, half - 1 FROM e)
        SELECT user_id, h * 1800000000 AS start_us, count(*) AS n FROM w GROUP BY user_id, h HAVING count(*) > 1""",
    "store_eviction": "SELECT a.source, a.doc_id FROM (SELECT source, doc_id, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id DESC ROWS UNBOUNDED PRECEDING) AS held FROM documents) a WHERE held <= 200000",
    "nth_changes": """WITH n AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS k FROM conversations),
        c AS (SELECT conv_id, turn // 2 AS k FROM conversations WHERE turn % 2 = 0)
        SELECT conv_id, turn, CASE WHEN EXISTS (SELECT 1 FROM c WHERE c.conv_id = n.conv_id AND c.k = n.k) THEN 'edited' ELSE role END AS role
        FROM n WHERE NOT (k = 0 AND EXISTS (SELECT 1 FROM c WHERE c.conv_id = n.conv_id AND c.k = 1))""",
    # The two nested hashes over the key's bytes, padded to 64 and turned by 36 and 5c.
    "signed_payloads": """SELECT conv_id, turn, 'sha256=' || sha256(unhex('373925' || repeat('5c', 61)) || unhex(sha256(unhex('5d534f' || repeat('36', 61)) || encode(turn || '.' || text)))) AS signature, left(sha256(CAST(conv_id AS VARCHAR)), 16) AS digest FROM conversations""",
    # Free numbers by counting up to the names there are, less the taken ones.
    "promoted_names": """WITH t AS (SELECT DISTINCT CASE WHEN p_partkey % 100 = 0 THEN p_brand ELSE p_brand || '_' || (p_partkey % 7 + 1) END AS name FROM part WHERE p_partkey % 50 = 0),
        c AS (SELECT p_brand, unnest(range(n + 8)) AS k FROM (SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand) x),
        f AS (SELECT p_brand, CASE WHEN k = 0 THEN p_brand ELSE p_brand || '_' || k END AS target, row_number() OVER (PARTITION BY p_brand ORDER BY k) AS turn
              FROM c WHERE CASE WHEN k = 0 THEN p_brand ELSE p_brand || '_' || k END NOT IN (SELECT name FROM t))
        SELECT p_partkey AS "order", target FROM (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS turn FROM part) x JOIN f USING (p_brand, turn)""",
}
