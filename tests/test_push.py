"""Pushes against a plain loop over the batches, one after the other, and request bodies case by case."""

import random

import pytest
from pyspark.sql import functions as F

from driftlog.operators import joins
from driftlog.operators import push as P
from driftlog.sources import bodies as B

ROW = "batch_id long, turn long, user_id long, device_id string, session_device string, op_id string, entity string, operation string, entity_id string, payload string, created_at long, received_at long, playlist_id string"


def row(batch, turn, user, playlist, entity="playlist_items", device="d", session=None, op=None, entity_id="e", payload="{}"):
    return (batch, turn, user, device, session, f"o{turn}" if op is None else op, entity, "upsert", playlist if entity == "playlists" else entity_id, payload, 1, 100 + batch, playlist)


def plain_push(rows, owners, shares, log, max_ops):
    """One request at a time: gate, rules, permissions, claims, append."""
    owners, log, told, editable = dict(owners), list(log), {}, {(p, u) for p, u, edit in shares if edit}
    seen, head = {(u, o) for u, o, *_ in log}, max([0, *(x[2] for x in log)])
    for batch in sorted({r[0] for r in rows}):
        ops = sorted((r for r in rows if r[0] == batch), key=lambda r: r[1])
        if len(ops) > max_ops or not any((r[3] or "").strip() or (r[4] or "").strip() for r in ops):
            continue
        user, valid = ops[0][2], []
        for r in ops:
            told[r[1]] = None if (r[5] or "").strip() and (r[8] or "").strip() else "op_id" if not (r[5] or "").strip() else "entity_id"
            if told[r[1]] is None:
                valid.append(r)
        named = {r[12] for r in valid if r[12]}
        writable = {p for p in named if owners.get(p, (user,))[0] == user or (p, user) in editable}
        for r in valid:
            if named and r[12] is not None and r[12] not in writable:
                told[r[1]] = "denied"
        for p in writable:
            owners.setdefault(p, (user, ops[0][11]))
        for r in valid:
            if told[r[1]] is None and (user, r[5]) not in seen:
                seen.add((user, r[5]))
                head += 1
                log.append((user, r[5], head, r[6], r[8]))
    return told, owners, log


def frames(spark, owners, shares, log):
    made = lambda rows, schema: spark.createDataFrame(rows, schema)
    return (
        made([(p, u, t) for p, (u, t) in owners.items()], "playlist_id string, owner_user_id long, created_at long"),
        made([(p, u, int(e), 0) for p, u, e in shares], "playlist_id string, grantee_user_id long, can_edit int, created_at long"),
        made(log, "user_id long, op_id string, seq long, entity string, entity_id string"),
    )


@pytest.mark.parametrize("salted", [False, True])
def test_a_push_equals_a_plain_loop(spark, monkeypatch, salted):
    if salted:
        monkeypatch.setattr(joins, "BROADCAST_ROWS", 0)
        monkeypatch.setattr(P, "NUMBERED_TOGETHER", 7)
    draw = random.Random(3)
    rows, turn = [], 0
    for batch in range(60):
        user, device, session = draw.randrange(4), draw.choice(["d", " ", None, "d"]), draw.choice([None, "", "s"])
        for _ in range(draw.randint(1, 9)):
            turn += draw.randint(1, 400)
            entity = draw.choice(["playlists", "playlist_items", "playlist_items", "likes", "queue_state"])
            playlist = draw.choice(["p1", "p2", "p3", "p4", "p5", ""] if entity == "playlist_items" else ["p1", "p5", "p6"]) if entity.startswith("playlist") else None
            playlist = None if entity == "playlist_items" and draw.random() < 0.1 else playlist
            rows.append(row(batch, turn, user, playlist, entity, device, session, draw.choice([f"o{draw.randrange(40)}", f"x{turn}", " "]), draw.choice(["q1", "q2", "e"])))
    owners, shares = {"p1": (0, 5), "p2": (9, 6)}, [("p1", 1, True), ("p1", 2, False), ("p2", 0, True), ("p3", 3, True), ("p4", 2, True)]
    log = [(0, "o1", 3, "likes", "e"), (1, "o2", 9, "queue_state", "q1")]
    told, after, logged = plain_push(rows, owners, shares, log, 8)
    push = P.Push(spark.createDataFrame(rows, ROW).repartition(3), *frames(spark, owners, shares, log), max_ops=8)
    assert {r.turn: r.reason for r in push.judged.collect()} == told and {None, "denied", "op_id"} <= set(told.values())
    assert {r.playlist_id: (r.owner_user_id, r.created_at) for r in push.owners_now.collect()} == after
    assert sorted((r.user_id, r.op_id, r.seq) for r in push.appended.collect()) == sorted(x[:3] for x in logged[len(log) :])
    heads = {}
    for user, _, seq, *_ in logged:
        heads[user] = max(seq, heads.get(user, 0))
    assert {r.user_id: r.head for r in push.heads.collect()} == {u: h for u, h in heads.items() if u in {x[0] for x in logged[len(log) :]}}
    touched = {(r[2], r[8]) for r in rows if r[6] == "queue_state" and told.get(r[1], "x") is None}
    newest = {k: max(s for u, _, s, e, i in logged if e == "queue_state" and (u, i) == k) for k in touched}
    want = {(u, i, s) for u, _, s, e, i in logged if e == "queue_state" and (u, i) in newest and s < newest[u, i]}
    assert {(r.user_id, r.entity_id, r.seq) for r in push.superfluous.collect()} == want and want


def reasons(spark, rows, owners={}, shares=(), **more):
    push = P.Push(spark.createDataFrame(rows, ROW), *frames(spark, owners, list(shares), [])[:2], **more)
    return [r.reason for r in push.judged.orderBy("turn").collect()]


def test_the_first_of_two_users_claims_an_unowned_playlist(spark):
    rows = [row(1, 1, 7, "p"), row(2, 2, 8, "p"), row(3, 3, 9, "p"), row(4, 4, 7, "p")]
    assert reasons(spark, rows, shares=[("p", 9, True)]) == [None, "denied", None, None]
    assert reasons(spark, [row(1, 1, 7, "p", entity_id=" "), *rows[1:]]) == ["entity_id", None, "denied", "denied"]  # an unsound operation claims nothing


def test_an_item_without_a_playlist_name_is_denied_beside_named_ones_only(spark):
    assert reasons(spark, [row(1, 1, 7, ""), row(2, 2, 7, ""), row(2, 3, 7, "p"), row(3, 4, 7, ""), row(3, 5, 7, "p", entity_id="")]) == [None, "denied", None, None, "entity_id"]


def test_size_is_judged_before_the_device_and_blank_devices_are_none(spark):
    rows = [row(1, 1, 7, None, "likes", device=None), row(1, 2, 7, None, "likes", device=None), row(2, 3, 7, None, "likes", device="  "), row(3, 4, 7, None, "likes", device=" ", session="s"), row(4, 5, 7, None, "likes")]
    batches = spark.createDataFrame(rows, ROW)
    assert {r.batch_id: r.verdict for r in P.gated(batches, 1).collect()} == {1: "too_many", 2: "no_device", 3: "ok", 4: "ok"}
    assert {r.batch_id: r.verdict for r in P.gated(batches.drop("session_device"), 1).collect()}[3] == "no_device"


def test_a_push_plans_its_inputs_once(spark):
    push = P.Push(spark.createDataFrame([row(1, 1, 7, "p")], ROW), *frames(spark, {"q": (1, 1)}, [("q", 2, True)], [(1, "o", 1, "likes", "e")]), max_ops=5)
    for table in (push.judged, push.owners_now, push.appended):
        plan = table._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Scan parquet") == 1 and "Exchange" not in plan


def test_empty_pushes(spark):
    push = P.Push(spark.createDataFrame([], ROW), *frames(spark, {}, [], []), max_ops=5)
    assert push.judged.count() == push.owners_now.count() == push.appended.count() == push.heads.count() == push.superfluous.count() == 0


BODIES = {
    '{"deviceId":"d","ops":[]}': ("d", []),
    '{"deviceId":"d","ops":null}': ("d", []),
    ' {"DeviceID" : "d" }\n': ("d", []),
    "null": (None, []),
    '{"ops":[null]}': (None, [None]),
    '{"ops":[{"opId":"a","opId":"b","createdAt":"5","payload":{ "x": 1.10, "x":[ 2 ] },"more":{"a":[1,{}]}}]}': (None, [("b", None, None, None, '{ "x": 1.10, "x":[ 2 ] }', 5)]),
    '{"ops":[{"PAYLOAD":"a \\u00e9 \\" ]","ENTITYID":"\\u00e9","createdat":-3}]}': (None, [(None, None, None, "é", '"a \\u00e9 \\" ]"', -3)]),
    '{"ops":[{"payload":null}], "OPS":[{"payload":true},{}]}': (None, [(None, None, None, None, "true", 0), (None, None, None, None, None, 0)]),
}
REFUSED = ["", "{", "[]", "5", '{"ops":{}}', '{"ops":[5]}', '{"ops":[{"opId":5}]}', '{"deviceId":5}', '{"ops":[{"createdAt":1.5}]}', '{"ops":[{"createdAt":null}]}', '{"ops":[{"createdAt":"1e3"}]}']
REFUSED += ['{"ops":[]} x', '{"ops":[],}', '{"ops":[NaN]}', '{"x":01}', '{"a" "b"}', '{"x":"\t"}', '{"x":' + "[" * 128 + "]" * 128 + "}", '{"ops":[{"createdAt":9223372036854775808}]}']


def test_bodies_one_by_one(spark):
    for text, (device, ops) in BODIES.items():
        got = B.parsed(text)
        assert got[0] == device and [o and tuple(o[k.split()[0]] for k in B.OP.split(", ")) for o in got[1]] == ops, text
    texts = [*BODIES, *REFUSED, None]
    read = B.requests(spark.createDataFrame(list(enumerate(texts)), "batch_id long, body string").withColumn("refused", F.lit("other")))
    assert [r.refused for r in read.orderBy("batch_id").collect()] == [False] * len(BODIES) + [True] * (len(REFUSED) + 1)
    rows = B.operations(read).collect()
    assert len(rows) == sum(len(ops) for _, ops in BODIES.values()) and B.requests(read.selectExpr("batch_id", "'' as body").limit(0)).count() == 0


def test_a_deep_operation_is_refused_alone(spark):
    deep = '{"ops":[{"opId":"a","entity":"likes","operation":"upsert","entityId":"e","createdAt":1,"payload":' + '{"a":' * 100 + "1" + "}" * 100 + '},{"opId":"b","entity":"playlist_items","operation":"upsert","entityId":"e","createdAt":1,"payload":{"playlistId":"p"}}],"deviceId":"d"}'
    rows = B.operations(B.requests(spark.createDataFrame([(1, deep)], "batch_id long, body string"))).withColumns({"turn": F.col("nth"), "user_id": F.lit(1).cast("long"), "received_at": F.lit(1).cast("long")})
    push = P.Push(rows, *frames(spark, {}, [], [])[:2])
    assert [(r.op_id, r.playlist_id, r.reason) for r in push.judged.orderBy("nth").collect()] == [("a", None, "depth"), ("b", "p", None)]
