"""Queue states in any order of arrival; files that are refused unread."""

import hashlib
import os
import random

from pyspark.sql import functions as F

from driftlog.operators import log as L
from driftlog.sources import files
from driftlog.streaming import queues
from driftlog.streaming.ingest import incoming

OPS = "user_id long, entity string, entity_id string, seq long, payload string, received_at long, more string"


def test_newest_states_in_any_order(spark, tmp_path):
    draw = random.Random(6)
    rows = [(draw.randrange(3), draw.choice(["queue_state", "queue_state", "likes"]), draw.choice(["d1", "d2", ""]), s, draw.choice([None, f"p{s}"]), s * 10, "x") for s in range(1, 120)] + [(None, "queue_state", "d1", 500, "p", 1, "x"), (1, "queue_state", "d1", None, "p", 1, "x"), (1, "queue_state", "d1", 600, "p", None, "x")]
    draw.shuffle(rows)
    told = []
    for k in range(3):
        spark.createDataFrame(rows[k::3], OPS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = queues.newest_states(incoming(spark, f"{tmp_path}/in", spark.createDataFrame([], OPS).schema))
        stream.writeStream.outputMode("update").foreachBatch(lambda part, n: told.extend(part.collect())).option("checkpointLocation", f"{tmp_path}/marks").trigger(availableNow=True).start().awaitTermination()
        sound = spark.createDataFrame([r for j in range(k + 1) for r in rows[j::3]], OPS).where("entity = 'queue_state' and entity_id <> '' and seq is not null and received_at is not null")
        want = {(r.user_id, r.entity_id): (r.seq, r.payload, r.received_at) for r in L.latest(sound.drop("entity", "more"), ["user_id", "entity_id"], F.col("seq")).collect()}
        assert {(r.user_id, r.entity_id): (r.seq, r.payload, r.received_at) for r in told} == want and want
    seen = {}
    for r in told:  # a device is told of only when its newest state changes
        assert seen.get((r.user_id, r.entity_id), -1) < r.seq
        seen[r.user_id, r.entity_id] = r.seq


def test_oversized_files_are_refused_unread(spark, tmp_path):
    def put(name, data):
        (tmp_path / name).write_bytes(data)
        return hashlib.sha256(data).hexdigest()

    sound, _, empty = put("a.png", b"abc"), put("b.png", b"b" * 100), put("e.png", b"")
    put("big.png", b"")
    os.truncate(tmp_path / "big.png", 3 << 30)  # longer than the source can read at all
    rows = [("a.png", "image/png", sound.upper()), ("b.png", "image/png; x=1", sound), ("e.png", "image/webp", empty), ("big.png", "image/png", sound), ("none.png", "image/png", sound), ("a.png", "text/plain", sound), ("b.png", "image/jpeg", None), ("big.png", None, sound)]
    claims = spark.createDataFrame([(n, 1, i, m, h) for i, (n, m, h) in enumerate(rows)], "name string, user_id long, turn long, mime_type string, claimed_hash string")
    got = {r.turn: r for r in files.uploaded(spark, str(tmp_path), claims, 100).collect()}
    assert [got[i].reason for i in range(len(rows))] == [None, "hash", "missing", "size", "missing", "type", "hash_form", "type"]
    assert bytes(got[0].bytes) == b"abc" and got[0].image_hash == sound and got[3].bytes is None and got[3].image_hash is None
    kept = files.uploaded(spark, str(tmp_path), claims, 100).where("reason is null").repartition(1)
    kept.write.parquet(f"{tmp_path}/stored")
    image = files.stored_image(spark.read.parquet(f"{tmp_path}/stored"), 1, sound)
    plan = image._jdf.queryExecution().executedPlan().toString()
    assert [(r.mime, bytes(r.bytes)) for r in image.collect()] == [("image/png", b"abc")] and "EqualTo(user_id,1)" in plan and "EqualTo(image_hash," in plan
