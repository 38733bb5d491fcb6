"""Steps whose memory, reads and calls must not grow with a batch."""

import json

import pyarrow as pa

from driftlog.plans import stored
from driftlog.sources import bodies, views
from driftlog.sources.store import LogStore
from driftlog.streaming import queues
from driftlog.streaming.ingest import incoming


class Taken:
    """In place of a table: gives the function that would run in tasks."""

    def select(self, *columns):
        return self

    def mapInArrow(self, run, schema):
        return run


def test_bodies_are_parsed_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(bodies, "BLOCK_BYTES", 20_000, raising=False)
    ops = [{"opId": f"o{i}", "entity": "likes", "payload": {"n": "x" * 80}, "createdAt": i} for i in range(50)]
    texts = [json.dumps({"deviceId": f"d{k}", "ops": ops[: k % 51]}) if k % 7 else None for k in range(200)]
    columns = [pa.array(range(200), pa.int64()), pa.array(texts), pa.array([3] * 200)]
    whole, none = pa.RecordBatch.from_arrays(columns, names=["batch_id", "body", "depth"]), pa.RecordBatch.from_arrays([c[:0] for c in columns], names=["batch_id", "body", "depth"])
    parts = list(bodies.requests(Taken())(iter([whole, none, whole])))
    assert max(sum(len(o or ()) for o in p.column("ops").to_pylist()) for p in parts) < 400  # of 4,000 in a batch
    rows = pa.Table.from_batches(parts).to_pylist()
    assert [r["batch_id"] for r in rows] == 2 * list(range(200))
    for k, r in enumerate(rows[:200]):
        want = (False, f"d{k}", [o["opId"] for o in ops[: k % 51]]) if k % 7 else (True, None, None)
        assert (r["refused"], r["device_id"], r["ops"] and [o["op_id"] for o in r["ops"]]) == (*want[:2], want[2] or r["ops"])


class Source:
    """The part of a service that the streaming queries read."""

    def __init__(self, spark, ops):
        self.spark, self.ops = spark, ops


def test_deliveries_are_written_by_many_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stored, "shared_folder", lambda spark: f"file://{tmp_path}")
    ops = views.ops(spark, "/root/testdata/sf0.001").where("seq <= 600").repartition(6)
    got = stored.ingested(Source(spark, ops))
    rows = got.collect()
    files = [sum(f.name.endswith(".parquet") for f in d.iterdir()) for d in sorted(tmp_path.glob("driftlog-stream-*/in/*"))]
    assert len(files) == 3 and min(files) > 1  # as one file a delivery was one task's work
    assert sorted(r.seq for r in rows) == list(range(1, len(rows) + 1)) and len({(r.user_id, r.op_id) for r in rows}) == len(rows) == ops.select("user_id", "op_id").distinct().count()


def test_the_stream_of_queue_states_runs_no_python(spark, tmp_path):
    rows = spark.createDataFrame([(1, "queue_state", "d1", 5, "p", 9)], "user_id long, entity string, entity_id string, seq long, payload string, received_at long")
    rows.write.parquet(f"{tmp_path}/in")
    plan = queues.newest_states(incoming(spark, f"{tmp_path}/in", rows.schema))._jdf.queryExecution().analyzed().toString()
    assert "Aggregate" in plan and "Pandas" not in plan  # a call for each device and delivery before


def test_a_large_commit_is_sorted_and_written_by_many_tasks(spark, tmp_path):
    store = LogStore(spark, f"file://{tmp_path}/log")
    store.append(spark.range(600_000).selectExpr("id + 1 as seq", "cast(id as string) as op_id", "id % 900 as user_id", "'likes' as entity"))
    assert sum(1 for _ in tmp_path.glob("log/log/*/*/*.parquet")) > 1 and store.read().count() == 600_000
