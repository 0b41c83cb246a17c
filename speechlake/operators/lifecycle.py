"""Jobs as rows: pages, due and stale selections, transitions, retention, outbox, rate limits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.fixtures import view

AS_OF = "2001-08-02 00:00:00"

#: Spark SQL and DuckDB differ in these spellings only.
SPARK = {"int_div": "DIV", "seconds": "make_interval(0, 0, 0, 0, 0, 0, o_custkey % 5000)", "as_of": f"TIMESTAMP_NTZ '{AS_OF}'", "day": "date_trunc('day', ts)", "minute": "date_trunc('minute', ts)", "micros": "unix_micros(CAST(ts AS TIMESTAMP))"}
DUCK = {"int_div": "//", "seconds": "to_seconds(o_custkey % 5000)", "as_of": f"TIMESTAMP '{AS_OF}'", "day": "date_trunc('day', ts)", "minute": "date_trunc('minute', ts)", "micros": "epoch_us(ts)"}

JOBS = """jobs AS (
    SELECT o_orderkey AS job_id, o_custkey AS external_id, o_custkey % 4 AS attempts, o_orderdate AS created_at,
           o_orderdate + {seconds} AS updated_at,
           CASE o_orderstatus WHEN 'O' THEN 'PENDING' WHEN 'P' THEN 'PROCESSING' ELSE 'COMPLETED' END AS status
    FROM orders)"""

#: One text per query for both engines: declarative selections that the optimiser plans.
TEXTS = {
    "jobs_page": ("orders", "SELECT job_id, status, created_at FROM jobs ORDER BY created_at DESC, job_id LIMIT 50 OFFSET 20"),
    "stale_pending": ("orders", "SELECT job_id, attempts FROM jobs WHERE status = 'PENDING' AND updated_at < {as_of} - INTERVAL '1' DAY ORDER BY updated_at, job_id LIMIT 100"),
    "stale_processing": ("orders", "SELECT job_id, CASE WHEN attempts < 3 THEN 'REQUEUE' ELSE 'FAIL' END AS action FROM jobs WHERE status = 'PROCESSING' AND updated_at < {as_of} - INTERVAL '1' DAY"),
    "expired": ("orders", "SELECT job_id FROM jobs WHERE status IN ('COMPLETED', 'FAILED') AND created_at < {as_of} - INTERVAL '365' DAY"),
    "status_counts": ("orders", "SELECT status, count(*) AS n FROM jobs GROUP BY status"),
    "job_transition": ("orders", "SELECT job_id, attempts + 1 AS attempts, CASE WHEN job_id % 10 = 0 OR attempts + 1 >= 3 THEN 'FAILED' ELSE 'PENDING' END AS status FROM jobs WHERE status = 'PROCESSING'"),
    "idempotent_create": ("orders", "SELECT external_id, job_id FROM (SELECT external_id, job_id, row_number() OVER (PARTITION BY external_id ORDER BY created_at, job_id) AS rn FROM jobs) x WHERE rn = 1"),
    "backoff": ("orders", "SELECT job_id, least(30.0, power(2.0, greatest(0, attempts - 1))) AS retry_s, 5.0 * power(2.0, greatest(0, attempts - 1)) AS outbox_s FROM jobs"),
    "dead_letters": ("orders", "SELECT job_id, attempts, 'attempts exhausted' AS error_message FROM jobs WHERE status <> 'COMPLETED' AND attempts >= 3"),
    "outbox_due": ("orders", "SELECT job_id FROM jobs WHERE status = 'PENDING' AND attempts < 3 AND updated_at <= {as_of} ORDER BY updated_at, job_id LIMIT 100"),
    "retention_cascade": ("orders lineitem", "SELECT l_orderkey AS job_id, count(*) AS n_children FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM jobs WHERE job_id = l_orderkey AND status = 'COMPLETED' AND created_at < {as_of} - INTERVAL '365' DAY) GROUP BY l_orderkey"),
    "job_detail": ("orders lineitem", "SELECT job_id, status, count(l_orderkey) AS n_children, coalesce(max(l_linenumber), 0) AS last_line FROM jobs LEFT JOIN lineitem ON l_orderkey = job_id GROUP BY job_id, status"),
    "rate_limit_tumbling": ("events", "SELECT user_id, {minute} AS minute, count(*) AS n FROM events GROUP BY user_id, {minute} HAVING count(*) > 1"),
    "sessions": ("events", """SELECT user_id, session, min({micros}) AS start_us, max({micros}) AS end_us, count(*) AS n FROM (
            SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM (
                SELECT *, CASE WHEN {micros} - lag({micros}) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 1800000000 THEN 0 ELSE 1 END AS opens FROM events) a) b
        GROUP BY user_id, session"""),
    "stage_histogram": ("events", "SELECT event_type, le, sum(CASE WHEN value <= le THEN 1 ELSE 0 END) AS n FROM events CROSS JOIN (VALUES (1.0), (5.0), (10.0), (50.0), (100.0), (500.0)) b(le) GROUP BY event_type, le"),
    "queue_depth_lag": ("events", "SELECT event_type, count(*) AS depth, round(({as_of_us} - min({micros})) / 1e6, 3) AS oldest_s FROM events WHERE event_id % 3 <> 0 GROUP BY event_type"),
    "eval_summary": ("lineitem", "SELECT l_returnflag, round(avg(l_discount), 6) AS mean, round(stddev_pop(l_discount), 6) AS std, round(median(l_discount), 6) AS median, max(l_discount) AS worst FROM lineitem GROUP BY l_returnflag"),
}
AS_OF_US = 996710400000000


def text_of(name: str, words: dict[str, str]) -> str:
    tables, sql = TEXTS[name]
    jobs = f"WITH {JOBS} " if "orders" in tables else ""
    return (jobs + sql).format(**words, as_of_us=AS_OF_US)


def query(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        view(spark, sf_dir, *TEXTS[name][0].split())
        return spark.sql(text_of(name, SPARK))

    return run


QUERIES = {name: query(name) for name in TEXTS}
ORACLE_SQL = {name: text_of(name, DUCK) for name in TEXTS}
