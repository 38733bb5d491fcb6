"""The export against a plain loop over playlists and a catalog that changes under it."""

import random

import pytest
from pyspark.sql import functions as F

from driftlog.operators import graph
from driftlog.operators import reconcile as R

LISTS = "user_id long, playlist_id string, seq long, name string, source_id string, is_smart boolean, deleted boolean, content_hash string, stored_hash string"
MAP = "user_id long, playlist_id string, target_item_id string, content_hash string"
ITEMS = "user_id long, item_id string, name string, stamp string"


def plain_export(lists, mapping, items):
    """Acts on a list of items one playlist after the other."""
    world = [dict(user=u, id=i, name=n, stamp=s) for u, i, n, s in items]
    known = {(u, p): (i, h) for u, p, i, h in mapping}
    get = lambda u, i: next((x for x in world if x["user"] == u and x["id"] == i), None)
    out = {}
    for u, p, _, name, source, smart, deleted, content, stored in sorted(lists, key=lambda r: (r[0], r[2], r[1])):
        mapped, old = known.get((u, p), (None, None))
        target = get(u, mapped) if mapped is not None else None
        if smart:
            out[u, p] = ("skipped_smart", mapped)
        elif deleted:
            if target and target["stamp"] is not None:
                world.remove(target)
                out[u, p] = ("deleted", mapped)
            else:
                out[u, p] = ("forgotten" if mapped is not None else "gone", mapped)
        elif target and old == content and target["stamp"] == p:
            out[u, p] = ("unchanged", mapped)
        elif target:
            target["stamp"], target["name"] = p, name
            out[u, p] = ("updated", mapped)
        else:
            found = get(u, source) if source is not None else None
            if not found or found["stamp"] not in (None, p):
                same = [x for x in world if x["user"] == u and x["name"].lower() == name.lower() and x["stamp"] is None]
                found = same[0] if len(same) == 1 else None
            if found:
                found["stamp"], found["name"] = p, name
                out[u, p] = ("adopted", found["id"])
            else:
                world.append(dict(user=u, id=f"new {p}", name=name, stamp=p))
                out[u, p] = ("created", None)
    return out


@pytest.mark.parametrize("bound", [R.USER_ROWS, 0])
def test_a_plan_equals_a_plain_loop(spark, monkeypatch, bound):
    monkeypatch.setattr(R, "USER_ROWS", bound)
    draw = random.Random(9)
    lists, mapping, items = [], [], []
    for user in range(25):
        n, m = draw.randint(0, 14), draw.randint(0, 9)
        ids = [f"i{k}" for k in range(m)]
        items += [(user, i, draw.choice("AbC"), draw.choice([None, None, None, "p0", "p1", "p9", "zz"])) for i in ids]
        for k in range(n):
            lists.append((user, f"p{k}", draw.randint(0, 30), draw.choice("aBcD"), draw.choice([None, None, *ids, "lost"]), draw.random() < 0.1, draw.random() < 0.15, "h", "h"))
            if draw.random() < 0.5:
                own = [i for u, i, _, stamp in items if (u, stamp) == (user, f"p{k}")]
                mapping.append((user, f"p{k}", draw.choice([*ids, "lost", *own * 9]), draw.choice(["h", "old"])))
    want = plain_export(lists, mapping, items)
    got = R.plan(spark.createDataFrame(lists, LISTS), spark.createDataFrame(mapping, MAP), spark.createDataFrame(items, ITEMS))
    assert {(r.user_id, r.playlist_id): (r.action, r.target_item_id) for r in got.collect()} == want
    assert {a for a, _ in want.values()} == {"skipped_smart", "gone", "deleted", "forgotten", "unchanged", "updated", "adopted", "created"}


def act(spark, lists, mapping, items):
    rows = [(1, p, seq, name, source, False, gone, "h", "h") for seq, (p, name, source, gone) in enumerate(lists)]
    got = R.plan(spark.createDataFrame(rows, LISTS), spark.createDataFrame([(1, *m) for m in mapping], MAP), spark.createDataFrame([(1, *i) for i in items], ITEMS))
    return [(r.action, r.target_item_id) for r in sorted(got.collect(), key=lambda r: [x[0] for x in lists].index(r.playlist_id))]


def test_adoptions_follow_each_other(spark):
    two = [("i1", "Mix", None), ("i2", "mix", None)]
    assert act(spark, [("p1", "MIX", None, False)], [], two) == [("created", None)]
    assert act(spark, [("p1", "mix", None, False), ("p2", "x", "i1", False), ("p3", "mix", None, False), ("p4", "mix", None, False)], [], two) == [("created", None), ("adopted", "i1"), ("adopted", "i2"), ("created", None)]
    assert act(spark, [("p1", "mix", None, False), ("p2", "y", "i1", False)], [], two[:1]) == [("adopted", "i1"), ("created", None)]
    assert act(spark, [("p1", "a", None, False), ("p2", "mix", None, False)], [("p1", "i1", "old")], two) == [("updated", "i1"), ("adopted", "i2")]


def test_any_stamp_lets_a_deleted_playlist_go_and_none_keeps_the_item(spark):
    items = [("i1", "a", "other"), ("i2", "b", None), ("i3", "c", "p3")]
    lists = [("p1", "a", None, True), ("p2", "b", None, True), ("p3", "c", None, True), ("p4", "d", None, True), ("p5", "e", "i1", False)]
    assert act(spark, lists, [("p1", "i1", "h"), ("p2", "i2", "h"), ("p3", "i3", "h")], items) == [("deleted", "i1"), ("forgotten", "i2"), ("deleted", "i3"), ("gone", None), ("created", None)]


def test_missing_artwork_is_tried_again(spark):
    lists = spark.createDataFrame([(1, "p1", "n", "h", [1, 2]), (1, "p2", "n", "g", [1, 2]), (1, "p3", "n", None, [2])], "user_id long, playlist_id string, name string, image_hash string, tracks array<bigint>")
    state = R.hashed(R.resolved(lists, spark.createDataFrame([(1,), (1,)], "track_id long")), spark.createDataFrame([(1, "h"), (2, "g"), (1, "G")], "user_id long, image_hash string"))
    rows = {r.playlist_id: r for r in state.collect()}
    assert [rows[p].artwork_missing for p in ("p1", "p2", "p3")] == [False, True, False] and [rows[p].unresolved for p in ("p1", "p2", "p3")] == [1, 1, 1]
    assert rows["p2"].stored_hash == rows["p2"].content_hash + R.PENDING and rows["p1"].stored_hash == rows["p1"].content_hash
    full = state.withColumns({"seq": F.lit(1).cast("long"), "source_id": F.lit(None).cast("string"), "is_smart": F.lit(False), "deleted": F.lit(False)})
    items = spark.createDataFrame([(1, f"i{k}", "n", f"p{k}", "h") for k in (1, 2, 3)], ITEMS + ", image string")
    last = spark.createDataFrame([(1, "p1", "i1", rows["p1"].stored_hash), (1, "p2", "i2", rows["p2"].stored_hash), (1, "p3", "i3", rows["p3"].stored_hash)], MAP)
    actions = R.plan(full, last, items)
    assert {r.playlist_id: r.action for r in actions.collect()} == {"p1": "unchanged", "p2": "updated", "p3": "unchanged"}
    settled = spark.createDataFrame([(1, "p2", "i2", rows["p2"].content_hash)], MAP)  # recorded when the image was there: nothing to do
    assert {r.playlist_id: r.action for r in R.plan(full, settled, items).where("playlist_id = 'p2'").collect()} == {"p2": "unchanged"}
    assert [(r.playlist_id, r.artwork) for r in R.artwork(full, actions, items).collect()] == [("p2", "missing")]
    told = R.report(actions, full, R.artwork(full, actions, items)).collect()
    assert [(r.unchanged, r.updated, r.unresolved, r.artwork_applied, r.artwork_missing) for r in told] == [(2, 1, 3, 0, 1)]
    after = {r.playlist_id: r.content_hash for r in R.mapping_after(last, actions).collect()}
    assert after["p2"].endswith(R.PENDING) and len(after) == 3


def test_one_broken_playlist_leaves_the_rest_alone(spark):
    lists = [(1, f"p{k}", k, "n", None, k == 3, k == 2, "h", "h") for k in range(5)]
    mapping = [(1, "p0", "i0", "old"), (1, "p1", "?", "h"), (1, "p2", "?", "h"), (1, "p3", "?", "h")]
    frame = spark.createDataFrame(lists, LISTS)
    actions = R.plan(frame, spark.createDataFrame(mapping, MAP), spark.createDataFrame([(1, "i0", "n", None)], ITEMS), lambda item: item != "?")
    assert {r.playlist_id: r.action for r in actions.collect()} == {"p0": "updated", "p1": "error", "p2": "error", "p3": "skipped_smart", "p4": "created"}
    after = {r.playlist_id: r.target_item_id for r in R.mapping_after(spark.createDataFrame(mapping, MAP), actions).collect()}
    assert after == {"p0": "i0", "p1": "?", "p2": "?", "p3": "?", "p4": None}
    full = frame.withColumns({"unresolved": F.lit(2).cast("long"), "image_hash": F.lit("x"), "artwork_missing": F.lit(False)})
    told = R.report(actions, full, R.artwork(full, actions, spark.createDataFrame([(1, "i0", "n", None, "x")], ITEMS + ", image string"))).collect()
    assert [(r.errors, r.unresolved, r.artwork_applied, r.artwork_missing) for r in told] == [(2, 6, 1, 0)]


def test_groups_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (102, 100), (200, 200)]
    got = {r.node: r.label for r in graph.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100, 200: 200}
    assert graph.connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_empty_exports(spark):
    none = lambda schema: spark.createDataFrame([], schema)
    assert R.plan(none(LISTS), none(MAP), none(ITEMS)).count() == 0
    assert act(spark, [("p1", "a", None, False)], [], []) == [("created", None)]
