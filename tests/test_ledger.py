"""Jobs as keyed state: in order however events arrive, over restarts, with late events dropped; the table's fold gives the same."""

from __future__ import annotations

import datetime
import json
import os
import random

import pytest

from speechlake.operators import jobs
from speechlake.streaming import consumer, ledger

EVENTS = "job_id string, at timestamp, seq long, kind string, token string, ok boolean, permanent boolean"
START = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.fixture
def stateful(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def event(job, s, kind, token=None, ok=None, permanent=None, seq=0):
    return {"job_id": job, "at": (START + datetime.timedelta(seconds=s)).isoformat(), "seq": seq, "kind": kind, "token": token, "ok": ok, "permanent": permanent}


def put(folder, name, rows):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{name}.json", "w") as f:
        f.writelines(json.dumps(r) + "\n" for r in rows)


def run(spark, tmp_path, late):
    rows = ledger.changes(consumer.arrivals(spark, f"file://{tmp_path}/inbox", EVENTS), late)
    writer = rows.writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/check")
    writer.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    out = spark.read.parquet(f"file://{tmp_path}/out").collect() if os.path.isdir(f"{tmp_path}/out") else []
    return sorted(((r.job_id, (r.at.replace(tzinfo=datetime.timezone.utc) - START).total_seconds(), r.action, r.status, r.attempts, r.deliveries) for r in out), key=lambda r: (r[0], r[1]))


def test_changes_over_restarts_and_deadlines(stateful, tmp_path):
    inbox = f"{tmp_path}/inbox"
    put(inbox, "a", [event("x", 10, "CLAIM", "t1"), event("x", 5, "DELIVERED"), event("y", 7, "CLAIM", "t2"), event("z", 8, "DELIVERED")])
    put(inbox, "b", [event("clock", 100, "DELIVERED")])
    first = run(stateful, tmp_path, "0 seconds")
    assert first == [("clock", 100.0, "DELIVERED", "PENDING", 0, 1), ("x", 5.0, "DELIVERED", "PENDING", 0, 1), ("x", 10.0, "CLAIMED", "PROCESSING", 0, 1), ("y", 7.0, "CLAIMED", "PROCESSING", 0, 0), ("z", 8.0, "DELIVERED", "PENDING", 0, 1)]
    # State is kept over the restart: deliveries and tokens are still known; what comes behind the watermark is dropped.
    put(inbox, "c", [event("x", 120, "RESULT", "t1", ok=False), event("x", 50, "RESULT", "t1", ok=True), event("z", 130, "DELIVERED"), event("z", 131, "DELIVERED")])
    put(inbox, "d", [event("clock", 7 + jobs.STALE_S + 1, "CLAIM", "c")])
    second = run(stateful, tmp_path, "0 seconds")[len(first) :] and run(stateful, tmp_path, "0 seconds")
    assert [r for r in second if r[0] == "x"][2:] == [("x", 120.0, "RETRY", "PENDING", 1, 1)]
    assert [r for r in second if r[0] == "z"][1:] == [("z", 130.0, "DELIVERED", "PENDING", 0, 2), ("z", 131.0, "POISON", "FAILED", 0, 3)]
    assert [r for r in second if r[0] == "y"][1:] == [("y", 7.0 + jobs.STALE_S, "TAKEN_BACK", "PENDING", 0, 0)]


def random_events(rng, n_jobs=12, n=140):
    out = []
    for i in range(n):
        kind = rng.choice(["DELIVERED", "CLAIM", "CLAIM", "RESULT", "RESULT", "OTHER"])
        out.append(event(f"j{rng.randrange(n_jobs)}", rng.randrange(0, 9000), kind, rng.choice([None, "a", "b"]), rng.choice([True, False, False, None]), rng.choice([None, False, False, True]), seq=i))
    return [*out, {**event("j0", 1, "CLAIM"), "at": None}, {**event("j0", 1, "CLAIM"), "job_id": None}]


def plain(events, end):
    state = {}
    for e in sorted((e for e in events if e["job_id"] and e["at"] and e["kind"] in ledger.KINDS), key=lambda e: (e["at"], e["seq"])):
        at = int((datetime.datetime.fromisoformat(e["at"]) - START).total_seconds())
        s = state.setdefault(e["job_id"], {"status": "PENDING", "attempts": 0, "deliveries": 0})
        expire(s, at)
        if e["kind"] == "DELIVERED":
            s["deliveries"] += 1
            if s["deliveries"] >= 3 and s["status"] in ("PENDING", "PROCESSING"):
                s["status"] = "FAILED"
        elif e["kind"] == "CLAIM" and s["status"] == "PENDING":
            s.update(status="PROCESSING", token=e["token"], since=at)
        elif e["kind"] == "RESULT" and s["status"] == "PROCESSING" and e["ok"] is not None and (e["token"] is None or s["token"] in (None, e["token"])):
            if e["ok"]:
                s["status"] = "COMPLETED"
            else:
                s["attempts"] += 1
                s["status"] = "FAILED" if e["permanent"] or s["attempts"] >= 3 else "PENDING"
    for s in state.values():
        expire(s, end)
    return {k: (s["status"], s["attempts"], s["deliveries"]) for k, s in state.items()}


def expire(s, at):
    if s["status"] == "PROCESSING" and at > s["since"] + jobs.STALE_S:
        s["status"] = "FAILED" if s["attempts"] >= 3 else "PENDING"


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_a_table_folds_to_the_same_rows(spark, seed):
    events = random_events(random.Random(seed))
    df = spark.createDataFrame([(e["job_id"], e["at"] and datetime.datetime.fromisoformat(e["at"]), e["seq"], e["kind"], e["token"], e["ok"], e["permanent"]) for e in events], EVENTS)
    got = {r.job_id: (r.status, r.attempts, r.deliveries) for r in ledger.final(df).collect()}
    end = max(int((datetime.datetime.fromisoformat(e["at"]) - START).total_seconds()) for e in events if e["at"] and e["job_id"] and e["kind"] in ledger.KINDS)
    assert got == plain(events, end)
    assert ledger.final(df.limit(0)).count() == 0


def test_a_stream_in_any_order_ends_as_the_table(stateful, tmp_path):
    rng = random.Random(9)
    events = random_events(rng)
    shuffled = rng.sample(events, len(events))
    for i in range(3):
        put(f"{tmp_path}/inbox", f"f{i}", shuffled[i::3])
        changes = run(stateful, tmp_path, "3 hours")  # a restart between the files
    put(f"{tmp_path}/inbox", "g", [event("clock", 9000 + 10_800 + jobs.STALE_S + 2, "DELIVERED")])
    changes = run(stateful, tmp_path, "3 hours")
    last = {}
    for job, at, action, status, attempts, deliveries in changes:
        last.setdefault(job, []).append((status, attempts, deliveries))
    want = {k: v for k, v in plain(events, 10**9).items() if v != ("PENDING", 0, 0) or k in last}
    assert {k: v[-1] for k, v in last.items() if k != "clock"} == want


def test_requests_with_a_key_are_created_once(stateful, tmp_path):
    inbox = f"{tmp_path}/inbox"
    at = lambda s: (START + datetime.timedelta(seconds=s)).isoformat()
    put(inbox, "a", [{"external_id": "k", "at": at(0), "n": 1}, {"external_id": "k", "at": at(5), "n": 2}, {"external_id": None, "at": at(1), "n": 3}, {"external_id": None, "at": at(1), "n": 4}])
    put(inbox, "b", [{"external_id": "k", "at": at(60), "n": 5}, {"external_id": "m", "at": at(60), "n": 6}])

    def go():
        rows = ledger.created(consumer.arrivals(stateful, f"file://{inbox}", "external_id string, at timestamp, n int"), late="10 minutes")
        rows.writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/check").trigger(availableNow=True).start().awaitTermination()
        return sorted(r.n for r in stateful.read.parquet(f"file://{tmp_path}/out").collect())

    found = go()
    assert found[1:] == [3, 4, 6] and found[0] in (1, 2)
    put(inbox, "c", [{"external_id": "m", "at": at(90), "n": 7}])
    assert go() == found
