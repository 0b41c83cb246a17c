"""Streams from files: each batch once, also after a failure; routing by outcome; silence on a stream."""

from __future__ import annotations

import datetime
import json
import os

import pytest

from speechlake.streaming import consumer

RESULT = "job_id string, status string, attempts int, deliveries int"


def put(folder, name, rows):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{name}.json", "w") as f:
        f.writelines(json.dumps(r) + "\n" for r in rows)


def result(job, status, attempts=1, deliveries=1):
    return {"job_id": job, "status": status, "attempts": attempts, "deliveries": deliveries}


def sink(spark, folder, name):
    if not os.path.isdir(f"{folder}/{name}"):
        return []
    return sorted(r.job_id for r in spark.read.parquet(f"{folder}/{name}").collect())


def test_batches_are_routed_once_and_resumed(spark, tmp_path):
    inbox, out, check = (f"file://{tmp_path}/{n}" for n in ("inbox", "out", "check"))
    local = f"{tmp_path}/inbox"
    put(local, "a", [result("1", "COMPLETED"), result("2", "FAILED"), result("3", "RETRY", attempts=2)])
    put(local, "b", [result("4", "SKIPPED"), result("5", "RETRY", deliveries=3)])
    failing = [True]

    def handle(batch):
        if failing[0] and batch.where("job_id = '4'").count():
            raise ValueError("stopped")
        return consumer.outcomes(batch)

    rows = lambda: consumer.arrivals(spark, inbox, RESULT)
    with pytest.raises(Exception, match="stopped"):
        consumer.consume(rows(), check, handle, out).awaitTermination()
    failing[0] = False
    for _ in range(2):  # the second run finds nothing new
        consumer.consume(rows(), check, handle, out).awaitTermination()
        assert sink(spark, f"{tmp_path}/out", "acked") == ["1", "4"]
        assert sink(spark, f"{tmp_path}/out", "dead") == ["2", "5"]
        assert sink(spark, f"{tmp_path}/out", "retry") == ["3"]
    put(local, "c", [result("6", "COMPLETED")])
    consumer.consume(rows(), check, handle, out).awaitTermination()
    assert sink(spark, f"{tmp_path}/out", "acked") == ["1", "4", "6"]


def test_silent_workers_come_out_when_the_watermark_passes(spark, tmp_path):
    inbox, out, check = (f"file://{tmp_path}/{n}" for n in ("inbox", "out", "check"))
    local = f"{tmp_path}/inbox"
    start = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)
    beat = lambda worker, s: {"worker": worker, "at": (start + datetime.timedelta(seconds=s)).isoformat()}
    put(local, "a", [beat("x", 0), beat("x", 15), beat("y", 10), {"worker": None, "at": None}])
    put(local, "b", [beat("y", 60), beat("y", 100)])
    lost = consumer.silent(consumer.arrivals(spark, inbox, "worker string, at timestamp"))
    query = lost.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    got = [(r.worker, (r.lost_at - r.last_beat).total_seconds(), r.n_beats) for r in spark.read.parquet(out).collect()]
    assert got == [("x", 60.0, 2)]
