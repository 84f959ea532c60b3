"""Components against union-find, with hubs and long paths."""

import random

import pytest

from readloom.operators import graphs


def parts(edges):
    up = {}

    def top(v):
        while up.setdefault(v, v) != v:
            v = up[v]
        return v

    for a, b in edges:
        x, y = sorted((top(a), top(b)))
        up[y] = x
    return {v: top(v) for v in up}


def found(spark, edges, **how):
    rows = graphs.graph_components(spark.createDataFrame(edges, "a long, b long"), **how).collect()
    assert len({r.v for r in rows}) == len(rows)
    return {r.v: r.label for r in rows}


@pytest.mark.parametrize("hub", [graphs.HUB, 5])
def test_components(spark, hub):
    r = random.Random(hub)
    edges = [(r.randint(0, 900), r.randint(0, 900)) for _ in range(500)] + [(2000, 2000), (3000, 1), (3000, 3000)]
    edges += [(5000 + i, 5001 + i) for i in range(300)] + [(9999, 7000 + i) for i in range(400)] + [(6000, 6500 + i) for i in range(100)]
    r.shuffle(edges)
    assert found(spark, edges, hub=hub) == parts(edges)


def test_nothing_and_nulls(spark):
    assert found(spark, []) == {}
    assert found(spark, [(None, 1), (2, None), (4, 3)]) == {3: 3, 4: 3}
    with pytest.raises(RuntimeError, match="rounds"):
        found(spark, [(i, i + 1) for i in range(200)], rounds=1)


def test_a_star_is_dealt_out(spark):
    """A hub's edges are joined under keys of their own: no key has more than a few rows."""
    ways = spark.range(1, 100_001).selectExpr("0L AS u", "id AS v")
    hubs = spark.sql("SELECT 0L AS hub, 0L AS hub_least")
    keys = graphs.keyed(ways, hubs).groupBy("key", "spread").count()
    assert keys.agg({"count": "max"}).first()[0] == 1
    rows = graphs.with_least(ways, graphs._least(ways), 1000)
    assert rows.where("least = 1").count() == 100_000
