"""Joins that deal a large side over salts give what a broadcast gives."""

import random

import pytest
from pyspark.sql import functions as F

from driftlog.llm import common, line_dedup, sharding


@pytest.mark.parametrize("limit", [common.BROADCAST_ROWS, 0])
def test_lines_and_components_do_not_depend_on_the_join(spark, monkeypatch, limit):
    monkeypatch.setattr(common, "BROADCAST_ROWS", limit)
    draw = random.Random(1)
    lines = [f"line {k}" for k in range(6)]
    rows = [(i, "\n".join(draw.choices(lines, k=4)) + f"\nown {i}", f"s{i % 3}", i // 2 * 2) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, component_id long")
    cut = {r.doc_id: r.text for r in line_dedup.without_boilerplate(docs.drop("component_id"), site=None, copies=docs.select("doc_id", "component_id")).collect()}
    first = {}
    for i, text, _, family in rows:
        for x in text.split("\n"):
            first.setdefault(x, []).append(family)
    for i, text, _, family in rows:
        kept = [x for x in dict.fromkeys(text.split("\n")) if len(set(first[x])) == 1 or family == first[x][0]]
        assert set(cut[i].split("\n")) == set(kept)
    edges = [(i, i + 1) for i in range(20) if i != 9] + [(50, k) for k in range(51, 80)]
    got = {r.node: r.component for r in common.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 if i < 10 else 10 for i in range(21)} | {i: 50 for i in range(50, 80)}


def test_shards_do_not_depend_on_the_join(spark, monkeypatch):
    docs = spark.range(500).withColumn("size", F.lit(1))
    monkeypatch.setattr(sharding, "BUCKET_ROWS", 20)
    found = []
    for limit in (common.BROADCAST_ROWS, 0):
        monkeypatch.setattr(common, "BROADCAST_ROWS", limit)
        found.append(sorted(tuple(r) for r in sharding.shuffled_shards(docs, "id", "size", 4).select("id", "shard", "slot").collect()))
    assert found[0] == found[1] and len(found[0]) == 500
