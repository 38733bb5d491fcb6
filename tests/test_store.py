"""The stored log: what filters reach, what a failed write leaves, and numbering over restarts."""

import os
import random

import pytest
from pyspark.sql import functions as F

from driftlog.operators import log as L
from driftlog.operators import upkeep as U
from driftlog.plans import stored
from driftlog.plans.service import Service
from driftlog.sources import views as V
from driftlog.sources.store import LogStore
from driftlog.streaming.ingest import incoming, ingest

DIR = "/root/testdata/sf0.001"
OPS = "turn long, user_id long, op_id string, entity string, entity_id string, playlist_id string, received_at long"


@pytest.fixture
def store(spark, tmp_path):
    return LogStore(spark, f"file://{tmp_path}/store")


def put(store, rows, **more):
    """rows: (seq, user, entity, entity_id)"""
    df = store.spark.createDataFrame([(s, f"o{s}", u, e, i) for s, u, e, i in rows], "seq long, op_id string, user_id long, entity string, entity_id string")
    return store.append(df, **more)


def held(store, **where):
    return sorted((r.seq, r.user_id, r.entity) for r in store.read(**where).collect())


def files(store):
    root = store.path.removeprefix("file://")
    return {os.path.join(d, f) for d, _, names in os.walk(f"{root}/log") for f in names if f.endswith(".parquet")}


def told(store):
    """The summaries, after checking them against a full scan."""
    rows = store.read()
    full = rows.groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("entity") == "play_events").alias("play_events"))
    kept = {r.user_id: (r.n, r.play_events, r.head) for r in store.summaries().collect()}
    assert {u: x[:2] for u, x in kept.items() if x[0]} == {r.user_id: (r.n, r.play_events) for r in full.collect()}
    return kept


FIRST = [(1, 1, "likes", "a"), (2, 1, "play_events", "b"), (3, 2, "queue_state", "d"), (4, 2, "play_events", "c")]
SECOND = [(5, 2, "queue_state", "d"), (6, 1, "play_events", "e")]


def test_reads_see_recorded_commits_and_prune(store):
    assert held(store) == [] and store.summaries().count() == 0 and store.owners().count() == 0
    put(store, FIRST)
    put(store, SECOND)
    assert held(store) == sorted(r[:3] for r in FIRST + SECOND)
    assert held(store, since=4) == [r[:3] for r in SECOND] and held(store, since=6) == [] and held(store, entities=["likes"]) == [FIRST[0][:3]] and held(store, entities=["folders"]) == []
    assert told(store) == {1: (3, 2, 6), 2: (3, 1, 5)}
    plan = store.read(since=4, entities=["play_events"]).where("user_id = 1")._jdf.queryExecution().executedPlan().toString()
    filters = plan[plan.index("PartitionFilters") : plan.index("PushedFilters")]
    assert "entity" in filters and "commit" in filters and "GreaterThan(seq,4)" in plan and "EqualTo(user_id,1)" in plan
    only = store.read(since=4)
    assert {r.f.split("commit=")[1].split("/")[0] for r in only.select(F.input_file_name().alias("f")).collect()} == {"2"}


def test_a_rewrite_leaves_other_entities_files_alone(store):
    put(store, FIRST)
    put(store, SECOND)
    before = files(store)
    store.rewrite("play_events", store.read().where("seq <> 2"))
    assert held(store) == sorted(r[:3] for r in FIRST + SECOND if r[0] != 2)
    assert {f for f in before if "play_events" not in f} == {f for f in files(store) if "play_events" not in f}
    assert not {f for f in before if "play_events" in f} & files(store)
    assert told(store) == {1: (2, 1, 6), 2: (3, 1, 5)}
    store.rewrite("likes", store.read().where("false"))
    assert held(store, entities=["likes"]) == [] and store.seen().head == 6 and told(store)[1][2] == 6
    put(store, [(7, 1, "likes", "z")])
    assert held(store, entities=["likes"]) == [(7, 1, "likes")]


@pytest.mark.parametrize("step", ["_record", "_write"])
def test_a_write_that_fails_leaves_the_old_state(store, monkeypatch, step):
    put(store, FIRST)
    was, summary = held(store), told(store)
    real, calls = getattr(LogStore, step), []

    def broken(self, *args, **kwargs):
        calls.append(1)
        if step == "_record" or len(calls) > 1:  # the log is written, then it breaks
            raise OSError("lost")
        return real(self, *args, **kwargs)

    monkeypatch.setattr(LogStore, step, broken)
    for change in (lambda: put(store, SECOND), lambda: store.rewrite("play_events", store.read().where("seq = 4"))):
        calls.clear()
        with pytest.raises(OSError):
            change()
        assert held(store) == was and told(store) == summary
    monkeypatch.setattr(LogStore, step, real)
    put(store, [(5, 9, "likes", "x")])  # another write takes the number; nothing of the failed ones comes back
    assert held(store) == [*was, (5, 9, "likes")] and told(store) == summary | {9: (1, 0, 5)}


def test_a_batch_of_a_source_is_added_once(store):
    put(store, FIRST, source="s", batch=0)
    assert put(store, SECOND, source="s", batch=0) == 1 and held(store) == sorted(r[:3] for r in FIRST)
    put(store, SECOND, source="t", batch=0)
    assert len(held(store)) == 6
    put(store, [], source="t", batch=1)
    assert store.applied("t", 1) and not store.applied("t", 2)


def arrive(spark, folder, rows):
    spark.createDataFrame(rows, OPS).coalesce(1).write.mode("append").parquet(folder)


def test_ingest_numbers_on_over_failures_and_restarts(spark, store, tmp_path, monkeypatch):
    draw, seen, want, turn = random.Random(1), set(), [], 0
    real, fail = LogStore._record, {2, 3}

    def sometimes(self, told, commit, *rest):
        if commit in fail:
            fail.remove(commit)
            raise OSError("lost")
        return real(self, told, commit, *rest)

    monkeypatch.setattr(LogStore, "_record", sometimes)
    for k in range(4):
        rows = []
        for _ in range(12):
            turn += draw.randint(1, 5)
            entity = draw.choice(["playlists", "likes"])
            rows.append((turn, draw.randrange(3), f"o{draw.randrange(30)}", entity, "p1" if entity == "playlists" else "x", "p1" if entity == "playlists" else None, turn))
        arrive(spark, f"{tmp_path}/in", rows)
        for r in rows:
            if r[1:3] not in seen:
                seen.add(r[1:3])
                want.append((len(want) + 1, *r[1:4]))
        for _ in range(2):  # a failed run is started again
            try:
                ingest(incoming(spark, f"{tmp_path}/in", spark.createDataFrame([], OPS).schema), store, "s", f"{tmp_path}/marks").awaitTermination()
                break
            except Exception as e:
                assert "lost" in str(e)
        assert sorted((r.seq, r.user_id, r.op_id, r.entity) for r in store.read().collect()) == want
    assert not fail
    first = min((w for w in want if w[3] == "playlists"))
    assert [(r.playlist_id, r.owner_user_id) for r in store.owners().collect()] == [("p1", first[1])]
    ingest(incoming(spark, f"{tmp_path}/in", spark.createDataFrame([], OPS).schema), store, "again", f"{tmp_path}/other").awaitTermination()  # all of it sent again
    assert store.read().count() == len(want) and told(store)


def test_a_page_reads_two_tables_once(spark):
    s = Service(spark, DIR)
    store = stored.filled(s)
    owners = store.owners()
    owner_list, viewer = owners.where("owner_user_id = 3"), spark.createDataFrame([(3,)], "user_id long")
    none = spark.createDataFrame([], "playlist_id string, grantee_user_id long")
    page = L.page(L.visible(store.read(since=500), viewer, owner_list, none), 500, 10)
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") == 2 and "GreaterThan(seq,500)" in plan
    log = V.ops(spark, DIR)
    want = L.page(L.visible(log, viewer, L.first_writers(log).where("owner_user_id = 3"), none), 500, 10)
    assert sorted(r.seq for r in page.collect()) == sorted(r.seq for r in want.collect()) and want.count()


def test_prune_and_compaction_twice_change_nothing_more(spark):
    store = stored.compacted(stored.pruned(Service(spark, DIR)))
    was, summary = held(store), told(store)
    store.rewrite("play_events", U.prunable(store.read(), 8000, 1706000000000).where("not prunable"))
    stored.compacted(store)
    assert held(store) == was and told(store) == summary
