"""Share requests against a plain loop, and the forms of ids."""

import random
import uuid

from driftlog.functions.columns import guid
from driftlog.operators import sharing as H
from driftlog.operators import upkeep as U
from pyspark.sql import functions as F

EVENT = "turn long, kind string, actor long, playlist_id string, grantee_user_id long, can_edit int, created_at long"
SHARE = "playlist_id string, grantee_user_id long, can_edit int, created_at long"


def plain_requests(events, shares, owners, users):
    now, told = {(p, g): (e, at) for p, g, e, at in shares}, {}
    for turn, kind, actor, playlist, grantee, edit, at in sorted(events):
        owner, key = owners.get(playlist), (playlist, grantee)
        if kind == "share":
            why = "playlist" if not (playlist or "").strip() else "user" if grantee not in users else "self" if grantee == actor else "unknown" if owner is None else "not_owner" if owner != actor else None
            if not why:
                now[key] = (1 if edit is None else edit, now[key][1] if key in now else at)
        else:
            why = "unknown" if owner is None else "not_yours" if actor not in (owner, grantee) else None if key in now else "no_share"
            if not why:
                del now[key]
        told[turn] = why
    return told, now


def test_requests_equal_a_plain_loop(spark):
    draw = random.Random(2)
    owners, users = {"p": 1, "q": 2}, [1, 2, 3]
    events = [(t, draw.choice(["share", "share", "revoke"]), draw.choice([1, 1, 2, 3]), draw.choice(["p", "p", "q", "r", " ", None]), draw.choice([1, 2, 3, 3, 9, None]), draw.choice([0, 1, None]), 10 * t) for t in range(400)]
    shares = [("p", 3, 0, 5), ("q", 1, 1, 6), ("old", 2, 1, 7)]
    told, now = plain_requests(events, shares, owners, users)
    made = spark.createDataFrame(shares, SHARE)
    rows = H.judged(spark.createDataFrame(events, EVENT), spark.createDataFrame(list(owners.items()), "playlist_id string, owner_user_id long"), spark.createDataFrame([(u,) for u in [*users, 1]], "user_id long"))
    assert {r.turn: r.reason for r in H.verdicts(rows, made).collect()} == told and len(set(told.values())) == 8
    assert {(r.playlist_id, r.grantee_user_id): (r.can_edit, r.created_at) for r in H.after(rows, made).collect()} == now
    assert H.after(rows.limit(0), made.limit(0)).count() == H.verdicts(rows.limit(0), made).count() == 0


def test_forms_of_ids(spark):
    one = uuid.UUID("0f8b1d3a-2c4e-4a6b-8d1f-3e5a7c9b2d40")
    d, n = str(one), one.hex
    sound = [n, n.upper(), d, d.upper(), f"{{{d}}}", f"({d})", f" \t{d} ", "{0x0f8b1d3a,0x2c4e,0x4a6b,{0x8d,0x1f,0x3e,0x5a,0x7c,0x9b,0x2d,0x40}}", "{0xF8B1D3A,0x2c4e,0x4a6b,{0x8d,0x1f,0x3e,0x5a,0x7c,0x9b,0x2d,0x40}}"]
    broken = [f"{{{d})", f"({d}}}", f"{{{d}", f"{d}}}", f"{{{n}}}", d.replace("-", "", 1), n[:4] + "-" + n[4:], n[:-1], n + "0", d.replace("0", "g"), "", None, "{" + "0x1," * 11 + "}"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(sound + broken)], "i int, t string").select("i", guid(F.col("t")).alias("g")).orderBy("i").collect()
    assert [r.g for r in rows] == [n] * len(sound) + [None] * len(broken)


def test_a_longer_limit_keeps_more_events_and_more_devices(spark):
    day = 86_400_000
    log = spark.createDataFrame([(s, 1, "play_events" if s < 9 else "likes", s * day) for s in range(1, 10)], "seq long, user_id long, entity string, received_at long")
    cursors = spark.createDataFrame([(1, "near", 8, 19 * day), (1, "far", 3, 12 * day)], "user_id long, device_id string, cursor long, updated_at long")
    gone = lambda days: sorted(r.seq for r in U.retention(log, cursors, 20 * day, days).where("prunable").collect())
    assert (gone(5), gone(10), gone(18), gone(30)) == (list(range(1, 9)), [1, 2, 3], [1], [])
    assert [U.retention_days(a, 90) for a in (None, 5, 90, 200)] == [90, 90, 90, 200]
