import random

import pytest
from pyspark.sql import functions as F

from threadlake.operators import hierarchy as h


def brute(rows):
    up = {}
    for k, p in rows:
        k = (k or "").strip().lower()
        p = (p or "").strip().lower()
        if k:
            up[k] = min([x for x in (up.get(k), p or None) if x], default=None)
    out = {}
    for k in up:
        seen, at = [], k
        while at in up and at not in seen and up[at] is not None:
            seen.append(at)
            at = up[at]
        if at in seen:
            ring = seen[seen.index(at) :]
            out[k] = (min(ring), seen.index(at), "circle")
        elif at not in up:
            out[k] = (seen[-1], len(seen) - 1, "orphan")
        else:
            out[k] = (at, len(seen), "root")
    return out


def run(spark, rows, **more):
    df = spark.createDataFrame([(k, p, "x") for k, p in rows], "k string, p string, pid string")
    return h.hierarchy(df, "k", "p", **more)


@pytest.mark.parametrize("small", [True, False])
def test_random_forests_match_following_parents(spark, monkeypatch, small):
    if not small:  # many chunks, hubs between them, hot parents
        monkeypatch.setattr(h, "SINGLE", 20)
        monkeypatch.setattr(h, "CHUNK", 25)
        monkeypatch.setattr(h, "HOT_CHILDREN", 5)
    rng = random.Random(5)
    names = [f"n{i:03d}" for i in range(220)]
    rows = []
    for i, n in enumerate(names):
        r = rng.random()
        p = None if r < 0.05 else "gone" if r < 0.08 else rng.choice(names) if r < 0.12 else names[0] if r < 0.35 else names[max(0, i - 1)]
        rows.append((n, p))
    rows += [rows[3], (" N004 ", rows[4][1]), (None, "n001"), ("  ", None), ("self", "self")]
    got = {r["key"]: (r["top"], r["depth"], r["kind"]) for r in run(spark, rows, positions=False).collect()}
    assert got == brute(rows)


def test_positions_give_ancestors_descendants_and_sizes(spark):
    rows = [("a", None), ("b", "a"), ("c", "a"), ("d", "b"), ("e", "d"), ("x", "y"), ("y", "x"), ("z", "x")]
    places = run(spark, rows).cache()
    sizes = {r["key"]: r["descendants"] for r in places.collect()}
    assert sizes["a"] == 4 and sizes["b"] == 2 and sizes["e"] == 0 and sizes["x"] == 1
    of = spark.createDataFrame([("e",), ("z",)], "key string")
    assert {(r["key"], r["ancestor"], r["ancestor_depth"]) for r in h.ancestors(places, of).collect()} == {("e", "a", 0), ("e", "b", 1), ("e", "d", 2), ("z", "x", 0)}
    assert {r["descendant"] for r in h.descendants(places, of.limit(1)).collect()} == set()
    below = h.descendants(places, spark.createDataFrame([("b",)], "key string")).collect()
    assert {r["descendant"] for r in below} == {"d", "e"}


def test_long_chain_and_empty_table(spark):
    rows = [(f"k{i:05d}", f"k{i - 1:05d}" if i else None) for i in range(3000)]
    got = run(spark, rows, positions=False).agg(F.max("depth"), F.count_distinct("top")).first()
    assert tuple(got) == (2999, 1)
    assert run(spark, []).count() == 0


def test_peeling_keeps_only_circles():
    import numpy as np

    on, least = h._peel(np.array([1, 2, 3, 4, 5]), np.array([2, 1, 2, 3, 5]))
    assert dict(zip(on.tolist(), least.tolist())) == {1: 1, 2: 1, 5: 5}
