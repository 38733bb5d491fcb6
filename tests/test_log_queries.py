import duckdb
import pytest
from pyspark.sql import functions as F

from driftlog.functions.columns import first_fault, is_object, json_depth
from driftlog.operators import log as L
from driftlog.operators import push as P
from driftlog.operators import upkeep as U
from driftlog.plans import oracle, queries, service, service_oracle, stored
from driftlog.sources import views as V

DIR = "/root/testdata/sf0.01"
TABLES = "events documents labels part customer".split()
QUERIES, SQL = queries.QUERIES | service.QUERIES | stored.QUERIES, oracle.SQL | service_oracle.SQL


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    got = QUERIES[name](spark, DIR)
    cur = duck.execute(SQL[name])
    columns = [c[0] for c in cur.description]
    assert sorted(columns) == sorted(got.columns)
    want = sorted(map(repr, cur.fetchall()))
    assert sorted(repr(tuple(r)) for r in got.select(*columns).collect()) == want and want


def plain_depth(text):
    """Depth by a plain scan of the text."""
    depth = most = 0
    quoted = skip = False
    for c in text:
        if skip:
            skip = False
        elif quoted:
            skip, quoted = c == "\\", c != '"'
        elif c == '"':
            quoted = True
        elif c in "[{":
            depth += 1
            most = max(most, depth)
        elif c in "]}":
            depth -= 1
    return most


def test_json_depth(spark):
    texts = ["true", "[]", '{"[[": {}}', '{"q": "\\"}]{"}', '["\\\\", {"x": []}]', "[" * 32 + "]" * 32, "[" * 33 + "]" * 33, '{"z":' * 400 + "0" + "}" * 400, '{"s": "' + "\\n" * 200_000 + '{"}']
    rows = spark.createDataFrame([(t,) for t in texts], "p string").withColumn("got", json_depth(F.col("p"))).collect()
    assert [r.got for r in rows] == [plain_depth(r.p) for r in rows]


def test_whole_objects_only(spark):
    cases = {"{}": True, '\n {"a": 1}\t': True, "{bad": False, '{"a":1} trailing': False, '{"a":1},{"b":2}': False, '{"a":1}],[2': False, '{"a":1}},{"x":1': False, "[1]": False, "1": False, "": False, None: False}
    rows = spark.createDataFrame([(k, v) for k, v in cases.items()], "p string, want boolean").withColumn("got", is_object(F.col("p"))).collect()
    assert all(r.got == r.want for r in rows)


def test_lengths_are_utf16_units_and_an_empty_operation_is_none(spark):
    base = dict(op_id="a", entity="likes", operation="upsert", entity_id="e", payload="{}", created_at=1)
    cases = [(base, None), (base | {"op_id": "x" * 70 + "\U0001f600" * 50}, "op_id"), (base | {"op_id": "\U0001f600" * 64}, None), (base | {"entity_id": "\u2003\u00a0"}, "entity_id"), (dict.fromkeys(base), "op"), (base | {"payload": None}, "payload")]
    df = spark.createDataFrame([tuple(c[k] for k in base) for c, _ in cases], ", ".join(f"{k} {'long' if k == 'created_at' else 'string'}" for k in base))
    assert [r.reason for r in df.select(first_fault().alias("reason")).collect()] == [want for _, want in cases]


def test_empty_tables_nulls_and_repeats(spark):
    ops = "seq long, op_id string, user_id long, device_id string, entity string, entity_id string, playlist_id string, operation string, payload string, created_at long, received_at long, stamp long, track_id long, extra string"
    none = spark.createDataFrame([], ops)
    rows = [(1, "a", 1, "d", "playlists", "p1", "p1", "upsert", "{}", 1, 1, 5, 1, "x"), (1, "a", 1, "d", "playlists", "p1", "p1", "upsert", "{}", 1, 1, 5, 1, "x"), (2, None, None, None, None, None, None, None, None, None, None, None, None, None)]
    some = spark.createDataFrame(rows, ops)
    for log, owned in ((none, 0), (some, 1)):
        owners = L.first_writers(log)
        shares = spark.createDataFrame([], "playlist_id string, grantee_user_id long, can_edit int, created_at long")
        cursors = spark.createDataFrame([], "user_id long, device_id string, cursor long, updated_at long")
        assert owners.count() == owned and L.members(log).count() == owned
        judged = P.judged(log.withColumns({"batch_id": F.lit(1), "turn": F.col("seq")}), owners, shares, 10)
        assert judged.where("reason is null").count() == 2 * owned
        assert P.appended(log.limit(0), judged.where("reason is null"), "seq").count() == owned
        assert U.retention(log, cursors, 10, 1).where("prunable").count() == 0
        assert U.cursors_after(cursors, cursors.withColumn("turn", F.lit(1).cast("long"))).count() == 0


def test_numbers_run_on_over_ranges(spark, monkeypatch):
    monkeypatch.setattr(P, "NUMBERED_TOGETHER", 7)
    rows = P.numbered(spark.range(0, 100, 3).withColumnRenamed("id", "arrival"), "arrival", spark.range(1).select(F.lit(40).alias("head"))).collect()
    assert [r.seq for r in sorted(rows, key=lambda r: r.arrival)] == list(range(41, 41 + len(rows)))


def test_append_is_idempotent(spark):
    log = spark.createDataFrame([(1, "a", 7), (1, "b", 8)], "user_id long, op_id string, seq long")
    batch = spark.createDataFrame([(1, "b", 1), (1, "c", 2), (1, "c", 3), (2, "b", 4)], "user_id long, op_id string, arrival long")
    assert sorted((r.user_id, r.op_id, r.seq) for r in P.appended(log, batch, "arrival").collect()) == [(1, "c", 9), (2, "b", 10)]
