"""What the driver must not hold."""

import numpy as np

from driftlog.llm import common, minhash_dedup, perfect_hash
from driftlog.llm.common import connected_components, dealt, settled, stored


def test_the_driver_makes_no_perfect_hash(spark, monkeypatch):
    sizes, plain = [], perfect_hash.PerfectHash.__init__

    def told(self, keys):
        sizes.append(len(keys))
        plain(self, keys)

    monkeypatch.setattr(perfect_hash.PerfectHash, "__init__", told)
    monkeypatch.setattr(perfect_hash, "HELD", 2, raising=False)
    table = perfect_hash.Slots(spark.range(-1500, 1500).selectExpr("id * 7919 as key"), block_keys=100)
    assert max(sizes, default=0) == 0  # blocks that no key falls into
    keys = np.arange(-1500, 1500) * 7919
    slots = table.find(keys)
    assert table.blocks > 20 and sorted(slots.tolist()) == list(range(3000)) and (table.keys(slots) == keys).all() and len(table.held) <= 2


def test_well_compressed_tables_are_not_broadcast(spark):
    plans = []

    @settled
    def joined(rows):
        small = stored(rows.sparkSession.range(0, 1_000_000, 1, 4).selectExpr("id as slot", "id % 3 as f"))  # about 50 MB in a join's hash table
        out = rows.join(small, "slot")
        plans.append(out._jdf.queryExecution().executedPlan().toString())
        return out

    before = spark.conf.get("spark.sql.sources.fileCompressionFactor")
    assert joined(spark.range(3_000_000).selectExpr("id % 999 as slot")).count() == 3_000_000
    assert "BroadcastHashJoin" not in plans[0] and spark.conf.get("spark.sql.sources.fileCompressionFactor") == before


def test_salted_rows_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_ROWS", 100)
    pairs = stored(spark.range(40_000).selectExpr("id % 2000 as u", "id as v"))
    least = pairs.groupBy("u").agg({"v": "min"}).toDF("u", "m")  # few rows by the exchange before the salts
    for how in ("inner", "left"):
        out = dealt(pairs, least, ["u"], 2000, pairs.v, how)
        assert {(r.u, r.m) for r in out.collect()} == {(i, i) for i in range(2000)} and out.count() == 40_000
        plan = out._jdf.queryExecution().executedPlan().toString()  # the one that ran
        assert "isFinalPlan=true" in plan and "BroadcastExchange" not in plan, plan


def test_a_group_meets_its_parts_without_a_broadcast(spark, monkeypatch):
    monkeypatch.setattr(minhash_dedup, "BLOCK", 4)
    docs = spark.range(30).selectExpr("id as doc_id", "concat_ws(' ', transform(sequence(0, 60), x -> concat('w', x)), concat('z', id)) as text")
    nodes = minhash_dedup.signatures(docs).selectExpr("id as node", "id", "print", "n_shingles as n", "registers")
    placed = stored(minhash_dedup.band_rows(nodes).selectExpr("*", "node as component"))
    found = minhash_dedup.across_components(placed, stored(nodes), stored(docs.selectExpr("doc_id as node", "cast(text as binary) as text")))
    assert connected_components(found.toDF("u", "v")).where("component = 0").count() == 30
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "isFinalPlan=true" in plan and "BroadcastHashJoin [node#" not in plan, plan


def test_a_large_group_gets_few_ties(spark):
    members = spark.range(300).selectExpr("id as node", "explode(sequence(0L, 63L)) as band", "10L as n")
    ties = minhash_dedup.tied_neighbours(members)
    assert ties.groupBy("b").count().agg({"count": "max"}).first()[0] <= minhash_dedup.TIES  # about 60 before: one for each band
    assert connected_components(ties.toDF("u", "v")).where("component = 0").count() == 300


def test_a_round_of_components_is_one_small_plan(spark, monkeypatch):
    plans, plain = [], common.stored

    def told(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString().count("Exchange"))
        return plain(df)

    monkeypatch.setattr(common, "stored", told)
    path = spark.range(40).selectExpr("id as u", "id + 1 as v")
    found = {r.node: r.component for r in connected_components(path.unionByName(path.selectExpr("u + 100", "v + 100").toDF("u", "v"))).collect()}
    assert found == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(41)}
    assert max(plans) <= 10, plans  # 15 before: each round's plan held its steps twice
    assert connected_components(path.where("u < 0")).count() == 0
