"""Parent-child rows to full hierarchies: cycles, roots, depths, Euler tours, descendants.

Leaves are peeled to expose cycles, cycles are cut, and the Euler tour of every tree is ranked by
parallel list ranking. The tour's entry and exit positions give depth, root, ancestors and descendants.

List ranking works by contraction: links are laid out by locality (dense ids), every bounded chunk is
contracted by pointer jumping in one vectorised pass, and only the links that leave a chunk go on to the
next, much smaller round. Work is linear in the number of links and needs no round per level of depth.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from threadlake.session import cut, partitions_for, small

CHUNK = 200_000  # links contracted by one task at a time
SINGLE = 400_000  # so many links are ranked by one task
HOT_CHILDREN = 100_000  # children of one parent from which their order is computed in salted parts
SALTS = 64

_LINK = T.StructType(
    [
        T.StructField("a", T.LongType()),
        T.StructField("out", T.LongType()),
        T.StructField("tail", T.LongType()),
        T.StructField("hops", T.LongType()),
        T.StructField("total", T.LongType()),
    ]
)
END, LOOP = -1, -2


def canonical_id(value: Column) -> Column:
    """Lower case, without surrounding white space of any kind; blank becomes null."""
    return F.nullif(F.lower(F.regexp_replace(value, r"(?U)^\s+|\s+$", "")), F.lit(""))


def _contract(ids: np.ndarray, nxt: np.ndarray, hops: np.ndarray, total: np.ndarray):
    """Follow each link as far as the given links go.

    Returns out (the first id outside, END, or LOOP), tail (the last link passed) and the sums of hops
    and weights of all links passed, the own one included.
    """
    order = np.argsort(ids, kind="stable")
    ids, nxt, hops, total = ids[order], nxt[order], hops[order].copy(), total[order].copy()
    n = len(ids)
    at = np.clip(np.searchsorted(ids, nxt), 0, max(n - 1, 0))
    inside = ids[at] == nxt if n else np.zeros(0, bool)
    me = np.arange(n)
    ptr = np.where(inside, at, me)
    # own cost is added for each link passed; a tail points to itself and adds nothing
    own_hops, own_total = hops.copy(), total.copy()
    d_hops, d_total = np.where(inside, own_hops, 0), np.where(inside, own_total, 0)
    moving = np.flatnonzero(inside)
    for _ in range(max(1, int(np.ceil(np.log2(n + 1)))) + 1 if n else 0):
        if not len(moving):
            break
        to = ptr[moving]
        step_h, step_t, step_p = d_hops[to], d_total[to], ptr[to]
        d_hops[moving] += step_h
        d_total[moving] += step_t
        ptr[moving] = step_p
        moving = moving[inside[step_p]]
    looped = inside[ptr]
    out = np.where(looped, LOOP, nxt[ptr])
    return ids, out, ids[ptr], d_hops + own_hops[ptr], d_total + own_total[ptr]


def _contract_partition(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    parts = list(batches)  # one chunk of CHUNK links
    if not parts:
        return
    got = pd.concat(parts)
    arrays = [got[c].to_numpy(np.int64) for c in ("a", "out", "hops", "total")]
    a, out, tail, hops, total = _contract(*arrays)
    yield pd.DataFrame({"a": a, "out": out, "tail": tail, "hops": hops, "total": total})


def list_rank(links: DataFrame, rows: int | None = None) -> DataFrame:
    """Rank linked lists: links(a, out, hops, total), out the next a or END.

    Gives a, out (END or LOOP), tail (the last link of its list), hops and total (sums to the end of the
    list, own link included). Ids near each other should be linked to each other for speed; the result
    does not depend on it. An empty table gives an empty one.
    """
    spark = links.sparkSession
    links = links.select("a", "out", "hops", "total")
    rows = links.count() if rows is None else rows
    if rows <= SINGLE:
        return links.repartition(1).mapInPandas(_contract_partition, _LINK)
    chunked = links.repartitionByRange(partitions_for(rows, CHUNK, spark), "a")
    local = cut(chunked.mapInPandas(_contract_partition, _LINK), "links")
    entered = local.filter(F.col("out") >= 0).select(F.col("out").alias("a")).distinct()
    hubs = cut(local.join(entered, "a", "left_semi").select("a", "out", "tail", "hops", "total"), "hubs")
    left = hubs.count()
    ranked = _double(hubs, left) if left > 0.7 * rows else list_rank(hubs, left)
    # a hub's own row in the small ranking already sums whole stretches of its list
    tails = hubs.select(F.col("a").alias("last"), F.col("tail").alias("last_tail"))
    ranked = ranked.join(tails, F.col("tail") == F.col("last"), "left").select(
        F.col("a").alias("hub"), F.col("out").alias("h_out"), F.col("last_tail").alias("h_tail"), F.col("hops").alias("h_hops"), F.col("total").alias("h_total")
    )
    return local.join(ranked, local["out"] == ranked["hub"], "left").select(
        "a",
        F.coalesce("h_out", "out").alias("out"),
        F.coalesce("h_tail", "tail").alias("tail"),
        (F.col("hops") + F.coalesce("h_hops", F.lit(0))).alias("hops"),
        (F.col("total") + F.coalesce("h_total", F.lit(0))).alias("total"),
    )


def _double(links: DataFrame, rows: int) -> DataFrame:
    """Plain pointer doubling, for links without any locality."""
    now = links.select("a", "out", F.col("a").alias("tail"), "hops", "total")
    for turn in range(int(np.ceil(np.log2(rows + 1))) + 1):
        b = now.select(*(F.col(c).alias(f"b_{c}") for c in ("a", "out", "tail", "hops", "total")))
        now = now.join(b, F.col("out") == F.col("b_a"), "left").select(
            "a",
            F.coalesce("b_out", "out").alias("out"),
            F.coalesce("b_tail", "tail").alias("tail"),
            (F.col("hops") + F.coalesce("b_hops", F.lit(0))).alias("hops"),
            (F.col("total") + F.coalesce("b_total", F.lit(0))).alias("total"),
        )
        now = cut(now, "double")
        if not now.filter(F.col("out") >= 0).limit(1).count():
            return now
    return now.withColumn("out", F.when(F.col("out") >= 0, F.lit(LOOP)).otherwise(F.col("out")))


def _peel(ids: np.ndarray, nxt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of links that all run into circles: the ids that survive leaf peeling, and the smallest id of their circle.

    The m-fold parent map's image is what m rounds of peeling leave; squaring the map peels 1, 2, 4, ... layers.
    """
    order = np.argsort(ids)
    ids, nxt = ids[order], nxt[order]
    step = np.searchsorted(ids, nxt)
    jump, rounds = step.copy(), int(np.ceil(np.log2(len(ids) + 1)))
    for _ in range(rounds):
        jump = jump[jump]
    kept = np.unique(jump)
    least, jump = np.arange(len(ids)), step.copy()
    for _ in range(rounds):
        least = np.minimum(least, least[jump])
        jump = jump[jump]
    return ids[kept], ids[least[kept]]


def _peel_partition(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    parts = list(batches)
    if parts:
        got = pd.concat(parts)
        on, least = _peel(got["id"].to_numpy(np.int64), got["pid"].to_numpy(np.int64))
        yield pd.DataFrame({"id": on, "circle": least})


def circles(looped: DataFrame) -> DataFrame:
    """looped(id, pid), every chain of which runs into a circle: (id, circle) of the ids on circles."""
    rows = looped.count()
    if rows <= SINGLE:
        return looped.select("id", "pid").repartition(1).mapInPandas(_peel_partition, "id long, circle long")
    rounds = int(np.ceil(np.log2(rows + 1)))
    jump = looped.select("id", F.col("pid").alias("to"))
    for _ in range(rounds):
        hop = jump.select(F.col("id").alias("to"), F.col("to").alias("then"))
        jump = cut(jump.join(hop, "to").select("id", F.col("then").alias("to")), "peel")
    on = looped.join(jump.select(F.col("to").alias("id")).distinct(), "id", "left_semi")
    now = on.select("id", F.col("pid").alias("to"), F.col("id").alias("circle"))
    for _ in range(rounds):
        hop = now.select(F.col("id").alias("to"), F.col("to").alias("then"), F.col("circle").alias("other"))
        now = cut(now.join(hop, "to").select("id", F.col("then").alias("to"), F.least("circle", "other").alias("circle")), "circle")
    return now.select("id", "circle")


def _number(nodes: DataFrame, near: list[str], rows: int) -> DataFrame:
    """Dense-enough long ids in the order of the locality columns."""
    spark = nodes.sparkSession
    laid = nodes.repartitionByRange(partitions_for(rows, CHUNK, spark), *near).sortWithinPartitions(*near)
    return cut(laid.withColumn("id", F.monotonically_increasing_id()), "nodes")


def forest(rows: DataFrame, key: str, parent: str, near: list[str] | None = None) -> DataFrame:
    """Nodes of a parent-child table with their links as numbers, and cycles cut.

    Gives one row per distinct key: id, key, pid (parent's id; null at a root, at a node whose parent is
    not in the table, and on a circle), orphan (the parent is named but not in the table), circle (the
    smallest key of the circle the node stands on, else null).

    Keys are compared in lower case without surrounding white space; rows with a null or blank key are
    left out; a null or blank parent means a root. Of rows with the same key the smallest named parent
    counts. A node that is its own parent is a circle of one. near: columns in whose order related rows
    stand close to each other (any order gives the same result). Extra columns are ignored.
    """
    near = near or [key]
    picked = rows.select(canonical_id(F.col(key)).alias("key"), canonical_id(F.col(parent)).alias("up"), *(F.col(c).alias(f"near_{i}") for i, c in enumerate(near)))
    nodes = picked.filter(F.col("key").isNotNull()).groupBy("key").agg(F.min("up").alias("up"), F.min(F.struct(*(f"near_{i}" for i in range(len(near))))).alias("near"))
    count = rows.count()
    nodes = _number(nodes.select("key", "up", "near"), ["near", "key"], count).drop("near")
    up = nodes.filter(F.col("up").isNotNull()).select("id", "up")
    linked = up.join(nodes.select(F.col("key").alias("up"), F.col("id").alias("pid")), "up", "left").select("id", "pid", F.col("pid").isNull().alias("orphan"))
    linked = cut(nodes.filter(F.col("up").isNull()).select("id", F.lit(None).cast("long").alias("pid"), F.lit(False).alias("orphan")).unionByName(linked), "linked")
    ranked = list_rank(linked.select(F.col("id").alias("a"), F.coalesce("pid", F.lit(END)).alias("out"), F.lit(1).cast("long").alias("hops"), F.lit(0).cast("long").alias("total")))
    looped = cut(linked.join(ranked.filter(F.col("out") == LOOP).select(F.col("a").alias("id")), "id", "left_semi").select("id", "pid"), "looped")
    on = circles(looped)
    names = on.join(nodes, "id").select("id", "circle", "key")
    named = cut(names.join(names.groupBy("circle").agg(F.min("key").alias("least")), "circle").select("id", F.col("least").alias("circle")), "circles")
    whole = linked.join(named, "id", "left")
    return whole.select("id", F.when(F.col("circle").isNull(), F.col("pid")).alias("pid"), "orphan", "circle").join(nodes.select("id", "key"), "id")


def euler_tour(nodes: DataFrame) -> DataFrame:
    """Euler tours of a forest(id, pid), by parallel list ranking.

    Gives id, root (id), depth, entry, exit: in the tour of its tree, a node is entered at position entry
    and left at exit (counted from 0); x is an ancestor of y exactly if root is equal and
    x.entry < y.entry and y.exit < x.exit; a node has (exit - entry - 1) / 2 descendants. Siblings stand in
    the order of their ids.
    """
    child = nodes.filter(F.col("pid").isNotNull()).select("id", "pid")
    hot = small(child.groupBy("pid").count().filter(F.col("count") > HOT_CHILDREN).select("pid", F.lit(True).alias("hot")))
    child = child.join(hot, "pid", "left").withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).otherwise(F.lit(0)))
    part = Window.partitionBy("pid", "salt").orderBy("id")
    child = child.select("id", "pid", "salt", "hot", F.lead("id").over(part).alias("next"), (F.row_number().over(part) == 1).alias("head"))
    heads = child.filter("hot and head")
    order = Window.partitionBy("pid").orderBy("salt")  # at most SALTS rows a parent
    heads = heads.select("pid", "salt", F.lead("id").over(order).alias("next_part"), (F.row_number().over(order) == 1).alias("first_part"))
    child = cut(
        child.join(small(heads), ["pid", "salt"], "left").select(
            "id", "pid", F.coalesce("next", "next_part").alias("next"), (F.col("head") & F.coalesce("first_part", F.lit(True))).alias("first")
        ),
        "siblings",
    )
    leads = child.filter("first").select(F.col("pid").alias("id"), F.col("id").alias("child"))
    side = child.select("id", "next")
    whole = nodes.select("id", "pid").join(leads, "id", "left").join(side, "id", "left")
    enter, leave = F.col("id") * 2, F.col("id") * 2 + 1
    links = whole.select(
        F.explode(
            F.array(
                F.struct(enter.alias("a"), F.coalesce(F.col("child") * 2, leave).alias("out"), F.lit(1).cast("long").alias("hops"), F.lit(1).cast("long").alias("total")),
                F.struct(leave.alias("a"), F.coalesce(F.col("next") * 2, F.col("pid") * 2 + 1, F.lit(END)).alias("out"), F.lit(1).cast("long").alias("hops"), F.lit(-1).cast("long").alias("total")),
            )
        ).alias("l")
    ).select("l.*")
    ranked = list_rank(cut(links, "arcs"))
    return ranked.select((F.col("a") / 2).cast("long").alias("id"), (F.col("a") % 2 == 0).alias("enters"), F.floor(F.col("tail") / 2).alias("root"), "hops", "total")


def hierarchy(rows: DataFrame, key: str, parent: str, near: list[str] | None = None, positions: bool = True) -> DataFrame:
    """One row per distinct key: key, top, depth, kind, and with positions also tree, entry, exit, descendants.

    kind is 'root' (the chain of parents ends at a true root), 'orphan' (it ends at a row whose parent is
    not in the table) or 'circle' (it runs into a circle). top is the root's key, the last row's key, or the
    smallest key on the circle; depth counts the steps to the root, the last row, or the first row on the
    circle. For nulls, blanks, repeated rows and self-parents see forest(). An empty table gives no rows.
    """
    nodes = cut(forest(rows, key, parent, near), "forest")
    tour = euler_tour(nodes)
    if positions:
        tour = cut(tour, "tour")
        into = tour.filter("enters").select("id", "root", (-F.col("total")).alias("depth"), F.col("hops").alias("enter_hops"))
        back = tour.filter("not enters").select("id", F.col("hops").alias("leave_hops"))
        whole = into.join(back, "id")
        length = whole.filter(F.col("id") == F.col("root")).select("root", F.col("enter_hops").alias("length"))
        place = whole.join(length, "root").select(
            "id", "root", "depth", (F.col("length") - F.col("enter_hops")).alias("entry"), (F.col("length") - F.col("leave_hops")).alias("exit"), ((F.col("enter_hops") - F.col("leave_hops") - 1) / 2).cast("long").alias("descendants")
        )
    else:
        place = tour.filter("enters").select("id", "root", (-F.col("total")).alias("depth"))
    tops = nodes.filter(F.col("pid").isNull()).select(
        F.col("id").alias("root"), F.coalesce("circle", "key").alias("top"), F.when(F.col("circle").isNotNull(), "circle").when(F.col("orphan"), "orphan").otherwise("root").alias("kind")
    )
    kept = nodes.select("id", "key")
    extra = [F.col("root").alias("tree"), "entry", "exit", "descendants"] if positions else []
    return place.join(tops, "root").join(kept, "id").select("key", "top", F.col("depth").cast("int").alias("depth"), "kind", *extra)


def _nested(outer: DataFrame, inner: DataFrame) -> DataFrame:
    """outer(tree, entry, exit, ...) joined with those of inner(tree, at, ...) that stand inside.

    An interval is cut into blocks of 1, 2, 4, ... positions, of which exactly one holds each position inside, so
    that only rows that belong together meet.
    """
    lo, hi = F.col("entry") + 1, F.col("exit")
    size = lambda v: F.pow(F.lit(2.0), v).cast("long")

    def cover(v: Column) -> Column:
        first, last = F.ceil(lo / size(v)), F.floor(hi / size(v))
        some = first < last
        return F.array(F.struct(v.alias("level"), F.when(some & (first % 2 == 1), first).alias("block")), F.struct(v.alias("level"), F.when(some & (last % 2 == 1), last - 1).alias("block")))

    top = lambda length: F.floor(F.log2(length.cast("double"))).cast("int")
    wide = outer.filter(lo < hi)
    cut_up = wide.withColumn("c", F.explode(F.filter(F.flatten(F.transform(F.sequence(F.lit(0), top(hi - lo)), cover)), lambda x: x["block"].isNotNull())))
    cut_up = cut_up.withColumns({"level": F.col("c.level"), "block": F.col("c.block")}).drop("c")
    levels = wide.groupBy("tree").agg(F.max(top(hi - lo)).alias("top"))
    placed = inner.join(levels, "tree").withColumn("level", F.explode(F.sequence(F.lit(0), F.col("top")))).drop("top")
    return cut_up.join(placed.withColumn("block", F.floor(F.col("at") / size(F.col("level")))), ["tree", "level", "block"])


def ancestors(places: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """(key, ancestor, ancestor_depth) of the keys in of(key), or of all, from places made by hierarchy().

    Ordered by ancestor_depth they are the full path of a key, and those of all keys give each ancestor its
    descendants; the total length of paths is quadratic in deep chains.
    """
    low = places if of is None else places.join(of.select("key").distinct(), "key")
    high = places.select(F.col("key").alias("ancestor"), "tree", "entry", "exit", F.col("depth").alias("ancestor_depth"))
    return _nested(high, low.select("key", "tree", F.col("entry").alias("at"))).select("key", "ancestor", "ancestor_depth")


def descendants(places: DataFrame, of: DataFrame) -> DataFrame:
    """(key, descendant) of the keys in of(key), from places made by hierarchy()."""
    high = places.join(of.select("key").distinct(), "key").select("key", "tree", "entry", "exit")
    return _nested(high, places.select(F.col("key").alias("descendant"), "tree", F.col("entry").alias("at"))).select("key", "descendant")
