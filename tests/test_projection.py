"""Playlists read from payloads, case by case; pages of many devices against a plain loop."""

import random

import pytest

from driftlog.operators import projection as J

LOG = "seq long, user_id long, entity string, entity_id string, operation string, payload string, created_at long, more string"


def seen(spark, *ops, user=1):
    """Each op: (entity, entity_id, payload) with operation and created_at after it, if other than upsert and 1."""
    rows = [(seq, user, *op[:2], op[3] if len(op) > 3 else "upsert", op[2], op[4] if len(op) > 4 else 1, "x") for seq, op in enumerate(ops, 1)]
    return {r.playlist_id: r for r in J.projected(spark.createDataFrame(rows, LOG)).collect()}


def song(id, track, position, **more):
    extra = "".join(f', "{k}": {v}' for k, v in more.items())
    return ("playlist_items", id, f'{{"playlist_id": "p", "jellyfin_id": "{track}", "position": "{position}"{extra}}}')


LIST = ("playlists", "p", '{"name": "Mix", "is_smart": 0, "deleted": 0, "updated_at": 5}')


def test_members_come_in_the_order_of_positions(spark):
    got = seen(spark, LIST, song("i1", "C", "a2"), song("i2", "A", "a0"), song("i3", "B", "a1"), song("i4", "A", "a0"), song("i5", "Z", "B"), ("playlists", "q", "{}"))
    assert got["p"].tracks == ["Z", "A", "A", "B", "C"] and got["q"].tracks == [] and got["q"].name == ""
    assert (got["p"].name, got["p"].is_smart, got["p"].deleted, got["p"].seq) == ("Mix", False, False, 1)


def test_the_last_writer_is_told_by_its_stamp(spark):
    late = lambda name, at: ("playlists", "p", f'{{"name": "{name}", "updated_at": {at}}}')
    assert seen(spark, late("new", 500), late("old", 100))["p"].name == "new"
    assert seen(spark, late("one", 7), late("two", 7))["p"].name == "two"
    assert seen(spark, ("playlists", "p", '{"name": "a", "updated_at": "900"}', "upsert", 3), late("b", 2))["p"].name == "a"  # a text is no stamp
    assert seen(spark, ("playlists", "p", '{"name": "a", "updated_at": null, "updatedAt": 900}', "upsert", 1), late("b", 2))["p"].name == "b"
    assert seen(spark, ("playlists", "p", '{"name": "a", "updatedAt": 900}', "upsert", 1), late("b", 2))["p"].name == "a"


def test_what_is_deleted_goes_and_deleted_playlists_stay_to_be_cleaned_up(spark):
    got = seen(spark, LIST, song("i1", "A", "a"), song("i1", "A", "a", deleted="true", updated_at=9), song("i2", "B", "b"), (*song("i2", "B", "b")[:3], "delete", 4), song("i3", "C", "c", deleted='"1"'), song("i4", "D", "d", deleted='"no"'))
    assert got["p"].tracks == ["D"]
    assert seen(spark, LIST, ("playlists", "p", "{}", "delete", 9))["p"].deleted and seen(spark, ("playlists", "p", '{"deleted": 2}'))["p"].deleted


def test_both_spellings_and_broken_rows(spark):
    got = seen(
        spark,
        ("playlists", "p", '{"name": 12, "isSmart": "TRUE", "sourceJellyfinId": "s", "source_jellyfin_id": "t", "imageHash": "h"}'),
        ("playlist_items", "i1", '{"playlistId": "p", "jellyfinId": 7, "position": 1}'),
        ("playlist_items", "i2", '{"playlist_id": null, "playlistId": "p", "jellyfin_id": "x"}'),
        ("playlist_items", "i3", '{"playlist_id": "p"}'), ("playlist_items", "i4", '{"playlist_id": "p", "jellyfin_id": ""}'), ("playlist_items", "i5", "[1]"), ("playlist_items", "i6", None), ("playlist_items", "", '{"playlist_id": "p", "jellyfin_id": "y"}'),
        ("playlists", "r", "[1]"), ("likes", "p", '{"name": "no"}'), ("playlist_items", "i7", '{"playlist_id": "gone", "jellyfin_id": "y"}'),
    )
    assert list(got) == ["p"] and got["p"].tracks == ["7"]
    assert (got["p"].name, got["p"].is_smart, got["p"].source_id, got["p"].image_hash) == ("12", True, "s", "h")


def test_users_are_apart_and_an_empty_log_has_none(spark):
    one = [(1, 1, *LIST[:2], "upsert", LIST[2], 1, ""), (2, 2, *LIST[:2], "upsert", '{"name": "other"}', 1, ""), (3, 2, *song("i", "A", "a")[:2], "upsert", song("i", "A", "a")[2], 1, "")]
    df = spark.createDataFrame(one, LOG)
    assert {(r.user_id, r.name, *r.tracks) for r in J.projected(df).collect()} == {(1, "Mix"), (2, "other", "A")}
    assert J.projected(df.limit(0)).count() == 0


def test_old_logs_are_routed_by_the_older_rule(spark):
    cases = {'{"playlistId": "a", "playlist_id": "b"}': "a", '{"playlistId": null, "playlist_id": "b"}': "b", '{"playlist_id": 5}': "5", '{"playlistId": true}': "1", '{"playlistId": false}': "0", "{}": None, "[1]": None, "{bad": None, None: None}
    rows = [(n, 1, "playlist_items", "i", "upsert", p, 1, "") for n, p in enumerate(cases, 10)] + [(1, 5, "playlists", "l", "upsert", '{"playlistId": "z"}', 1, ""), (2, 4, "playlists", "l", "upsert", "{}", 1, ""), (3, 4, "likes", "x", "upsert", '{"playlistId": "z"}', 1, "")]
    log = J.routed_anew(spark.createDataFrame(rows, LOG))
    got = {r.seq: r.playlist_id for r in log.collect()}
    assert [got[n] for n, _ in enumerate(cases, 10)] == list(cases.values()) and (got[1], got[2], got[3]) == ("l", "l", None)
    assert [tuple(r) for r in J.owners_anew(log).collect()] == [("l", 5, 1)]


@pytest.mark.parametrize("block, limit", [(5, 1), (16, 3), (1 << 16, 10)])
def test_pages_equal_a_plain_loop(spark, block, limit):
    draw = random.Random(block)
    log, seq = [], 0
    for _ in range(150):
        seq += draw.randint(1, 4)
        log.append((seq, f"o{seq}", draw.choice([1, 1, 1, 2, 3]), draw.choice([None, "p", "p", "q", "r"])))
    owners, shares = [("p", 1), ("q", 2), ("s", 3)], [("p", 2, 1), ("p", 3, 0), ("q", 1, 1), ("p", 1, 1)]
    cursors = [(u, f"d{k}", draw.choice([0, 0, 5, 100, seq - 3, seq, seq + 50])) for u in (1, 2, 3, 4) for k in range(5)]
    want, after = [], {}
    for user, device, cursor in cursors:
        lists = {p for p, u in owners if u == user} | {p for p, u, _ in shares if u == user}
        rows = [(s, o) for s, o, u, p in sorted(log) if s > cursor and (u == user or p in lists)][: limit + 1]
        want += [(user, device, s, o, n) for n, (s, o) in enumerate(rows, 1)]
        after[user, device] = (rows[:limit][-1][0] if rows else cursor, len(rows) > limit)
    made = (spark.createDataFrame(log, "seq long, op_id string, user_id long, playlist_id string"), spark.createDataFrame(cursors, "user_id long, device_id string, cursor long"))
    got = J.pages(*made, spark.createDataFrame(owners, "playlist_id string, owner_user_id long"), spark.createDataFrame(shares, "playlist_id string, grantee_user_id long, can_edit int"), limit, block)
    assert sorted(tuple(r) for r in got.collect()) == sorted(want) and want
    assert {(r.user_id, r.device_id): (r.cursor, r.has_more) for r in J.cursors_of(got, made[1], limit).collect()} == after
