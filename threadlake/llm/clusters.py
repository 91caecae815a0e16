"""Clusters of mutually similar records, with their size and most typical members.

Every vector gets a number of min-wise hashes for angles: of WIDTH random directions the nearest. Vectors of a model that share
one are compared, all with all, in blocks. These bands are the same at any size of the table, and their number follows from the
least cosine: a pair at it shares one with the chance RECALL, a nearer pair more often. Hashes are sums of whole numbers, and a
cosine of the least one counts, so that no result hangs on how many vectors are multiplied at once. As each member of a cluster is linked to
half or more of the others, a cluster comes out whole where single links are missed. A block gives forests that connect
what it found, not pairs; links too near the least cosine to be told from rounded vectors are verified by exact ones.
The links' connected components are the groups. A group whose members are not mutually similar is split
around the member with the most links. Equal vectors are one record until the end.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadlake.functions.vector import cosine as similarity
from threadlake.llm.vectors import by_length, hash_name, matrix, pair_cosines, usable_vectors
from threadlake.session import cut, partitions_for, small, table

COSINE, SMALLEST, SESSIONS, TYPICAL = 0.74, 10, 3, 5
EXACT = 0  # not read any more: one method at every size; tests still set it
WIDTH = 512  # random directions of a band
RECALL = 0.99  # of pairs at the least cosine, from which the number of bands follows
BLOCK = 8_000  # vectors of a bucket in a block
SLOT = 20_000  # vectors of buckets that a task gets at once, about
HASHED = 4_000  # vectors hashed by one task
STEPS = 32_767  # of a coordinate of a vector of length 1, while it is compared in buckets
UNIT = 4_096  # steps of a coordinate, while it is hashed
TIE = 1e-12  # more than the order of sums, which differs by the size of a block, makes of a cosine
MERGED = 400_000  # links merged by one task
WIDE = 8_000  # vectors in a block of vectors
SEED = 20250202


@functools.cache
def band_success(cosine: float, width: int, pairs: int = 20_000) -> float:
    """How often a band finds a pair at the cosine, by simulating its products with the directions (for these, any dimension is alike)."""
    rng, same = np.random.default_rng(SEED), 0
    for _ in range(pairs // 500):
        x = rng.standard_normal((500, width), np.float32)
        y = cosine * x + math.sqrt(1 - cosine * cosine) * rng.standard_normal((500, width), np.float32)
        same += int((x.argmax(axis=1) == y.argmax(axis=1)).sum())
    return min(max(same / pairs, 1 / width), 0.99)


def band_count(cosine: float) -> int:
    """Bands, so that RECALL of the pairs at the cosine share a bucket, whatever the number of vectors."""
    return math.ceil(math.log(1 - RECALL) / math.log1p(-band_success(cosine, WIDTH)))


def directions(bands: int, dim: int, width: int) -> np.ndarray:
    """Random directions of the bands, in whole numbers so small that single precision holds any sum of their products with a vector in UNIT."""
    axes = np.random.default_rng((SEED, dim)).standard_normal((bands, dim, width), np.float32)
    return np.trunc(axes * np.float32(2**24 / 1.001 / UNIT / np.linalg.norm(axes, axis=1).max()))


def minhash_rows(vectors: DataFrame, rows: int, cosine: float) -> DataFrame:
    """(id, part, code, buckets): for each vector(id, model, vector) its bucket in each band, and its coordinates in STEPS.

    Parts are the models and lengths. The buckets don't depend on other vectors, nor, by rounding, on how many are hashed at
    once; `rows` is for the number of tasks only.
    """
    bands = band_count(cosine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        axes: dict[int, np.ndarray] = {}
        for whole in batches:
            for start in range(0, whole.num_rows, 1000):
                for batch in by_length(whole.slice(start, 1000), "vector"):
                    x = matrix(batch["vector"])
                    n, dim = x.shape
                    if dim not in axes:
                        if len(axes) == 8:
                            axes.clear()
                        axes[dim] = directions(bands, dim, WIDTH)
                    steps = np.trunc(x * UNIT).astype(np.float32)
                    buckets = np.stack([(steps @ axes[dim][k]).argmax(axis=1) + k * WIDTH for k in range(bands)], axis=1).astype(np.int32)
                    code = np.rint(x * STEPS).astype("<i2")
                    parts = pa.array([hash_name(f"{v}:{dim}") for v in batch["model"].to_pylist()], pa.int64())
                    at = pa.array(np.arange(n + 1, dtype=np.int32) * bands)
                    codes = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(n + 1, dtype=np.int32) * (2 * dim)), pa.py_buffer(code.tobytes())])
                    yield pa.RecordBatch.from_arrays([batch["id"], parts, codes, pa.ListArray.from_arrays(at, pa.array(buckets.ravel()))], ["id", "part", "code", "buckets"])

    spread, tasks = vectors.select("id", "model", "vector"), partitions_for(rows, HASHED, vectors.sparkSession)
    if spread.rdd.getNumPartitions() < min(tasks, vectors.sparkSession.sparkContext.defaultParallelism):
        spread = spread.repartition(tasks, "id")
    return spread.mapInArrow(run, "id long, part long, code binary, buckets array<int>")


def _block_links(x: np.ndarray, y: np.ndarray | None, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Links (i, j) that connect what the pairs of x and y (or of x) surely of the cosine connect, and all pairs too near it to tell, of those not connected so; j counts on from the last of x."""
    slack = 1.01 * math.sqrt(x.shape[1]) / STEPS + x.shape[1] * 2e-7  # of rounding, and of sums in single precision
    n, other = len(x), x if y is None else y
    near, doubt = np.zeros((n, len(other)), bool), [np.zeros((0, 2), np.int64)]
    rows, columns = np.zeros(n, bool), np.zeros(len(other), bool)
    for k in range(0, n, 250):
        after = k if y is None else 0
        c = x[k : k + 250] @ other[after:].T
        i, j = np.nonzero(c >= cosine - slack)
        if y is None:
            i, j = i[i < j], j[i < j]  # pairs once, none with itself
        sure = c[i, j] >= cosine + slack
        doubt.append(np.stack([k + i[~sure], after + j[~sure]], axis=1))
        i, j = k + i[sure], after + j[sure]
        near[i, j] = rows[i] = columns[j] = True
    ends = np.concatenate(doubt)
    if y is None:
        at = np.flatnonzero(rows | columns)
        some = near[np.ix_(at, at)]
        links = at[np.array(_spanning(some | some.T, True), np.int64).reshape(-1, 2)]
    else:
        at, to = np.flatnonzero(rows), np.flatnonzero(columns)
        links = np.concatenate([at, n + to])[np.array(_spanning(near[np.ix_(at, to)], False), np.int64).reshape(-1, 2)]
        ends[:, 1] += n
    if len(ends):
        group = _labels(links, n + (0 if y is None else len(y)))
        ends = ends[group[ends[:, 0]] != group[ends[:, 1]]]
    return links, ends


def _labels(links: np.ndarray, n: int) -> np.ndarray:
    """For each of n the least that links connect it with."""
    up = list(range(n))
    for i, j in links.tolist():
        while up[i] != i:
            up[i] = i = up[up[i]]
        while up[j] != j:
            up[j] = j = up[up[j]]
        up[max(i, j)] = min(i, j)
    for k in range(n):
        up[k] = up[up[k]]
    return np.array(up)


def proposed_links(hashed: DataFrame, rows: int, cosine: float) -> DataFrame:
    """(a, b, sure) of hashed(id, part, code, buckets), enough to connect what all pairs of a bucket with the cosine connect; those not sure are to be verified.

    All vectors of a bucket are compared, in blocks of BLOCK by BLOCK.
    """
    spark = hashed.sparkSession
    slots = max(spark.sparkContext.defaultParallelism, rows * band_count(cosine) // SLOT)
    each = hashed.select("part", "id", "code", F.explode("buckets").alias("bucket"))
    counts = each.groupBy("part", "bucket").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"), F.count("*").alias("count")).filter("count > 1").drop("count")
    numbered = each.join(small(counts), ["part", "bucket"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    spread = numbered.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    key = F.xxhash64("part", "bucket", F.least("block", "other"), F.greatest("block", "other"))
    key = F.shiftleft(key, 1) + (F.col("block") > F.col("other")).cast("long")  # odd: of the other block
    spread = spread.select(key.alias("key"), "id", "code").withColumn("slot", F.pmod(F.shiftright("key", 1), F.lit(slots)))

    def of_slot(got: pa.Table) -> pa.Table:
        order = np.argsort(got["key"].to_numpy())
        keys, ids = (got[c].to_numpy()[order] for c in ("key", "id"))
        keys, mine = keys >> 1, keys % 2 == 0
        codes, parts = got["code"].combine_chunks().take(pa.array(order)), []
        at, flat = (np.frombuffer(v, t) for v, t in zip(codes.buffers()[1:], ("<i4", "<i2")))
        borders = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
        for first, end in zip(borders, borders[1:]):
            last = first + int(mine[first:end].sum())  # of one block, followed by the other
            if end - first < 2 or last == first:
                continue
            block = flat[at[first] // 2 : at[end] // 2].reshape(end - first, -1).astype(np.float32) / np.float32(STEPS)
            links, doubt = _block_links(block[: last - first], block[last - first :] if last < end else None, cosine)
            place = ids[first:end]
            parts += [(place[links], True), (place[doubt], False)]
        ends = np.concatenate([p for p, _ in parts] or [np.zeros((0, 2), np.int64)])
        sure = np.concatenate([np.full(len(p), s) for p, s in parts] or [np.zeros(0, bool)])
        return pa.table({"a": pa.array(ends.min(axis=1), pa.int64()), "b": pa.array(ends.max(axis=1), pa.int64()), "sure": pa.array(sure, pa.bool_())})

    return spread.groupBy("slot").applyInArrow(of_slot, "a long, b long, sure boolean")


def verified_links(links: DataFrame, named: DataFrame, cosine: float) -> DataFrame:
    """(a, b) of links(a, b, sure) that are sure, or whose vectors, in named(gid, vector), have the cosine."""
    links = cut(links, "links")
    doubt = small(links.filter("not sure").select("a", "b").distinct())
    ends = small(doubt.select(F.col("a").alias("gid")).union(doubt.select("b")).distinct())
    named = cut(named.join(ends, "gid"), "doubtful")
    return links.filter("sure").select("a", "b").unionByName(pair_cosines(doubt, named).filter(F.col("cosine") >= cosine).select("a", "b"))


def _union(batches: Iterator[pd.DataFrame], edges: bool) -> Iterator[pd.DataFrame]:
    """A part's links reduced to those that join its components, or to a star around each component's smallest id."""
    parent: dict[int, int] = {}
    kept: list[tuple[int, int]] = []

    def find(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up]
            x = up
        return x

    for pdf in batches:
        for p, q in zip(pdf["a"].tolist(), pdf["b"].tolist()):
            a, b = find(p), find(q)
            if a != b:
                parent[max(a, b)] = min(a, b)
                kept.append((p, q))
    if not edges:
        kept = [(find(x), x) for x in parent if find(x) != x]
    yield pd.DataFrame(kept, columns=["a", "b"], dtype=np.int64)


def connected_components(links: DataFrame) -> DataFrame:
    """(id, component) of all ends of links(a, b); component is the smallest id in it.

    Each task first reduces its links to a forest, some of which are merged by fewer tasks; then large-star and
    small-star steps are repeated until nothing changes, a number of rounds that grows with the logarithm of the size.
    """
    now = cut(links.select("a", "b").mapInPandas(lambda it: _union(it, False), "a long, b long").distinct(), "forest")
    parts = partitions_for(now.count(), MERGED, links.sparkSession)
    now = _stars(cut(now.repartition(parts, "a").mapInPandas(lambda it: _union(it, False), "a long, b long"), "merged"), parts == 1)
    ends = now.select(F.col("b").alias("id"), F.col("a").alias("component"))
    return ends.unionByName(now.select(F.col("a").alias("id"), F.col("a").alias("component")).distinct())


def _stars(now: DataFrame, done: bool) -> DataFrame:
    """Links (a, b), a < b, turned into stars around the smallest id of each component; those that one task has made are stars already."""
    while not done:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("m").alias("a"), "b")
        large = cut(large.filter("a <> b").distinct(), "large")
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").select(F.col("m").alias("x"), "a", "b")
        small = small.select("x", F.col("a").alias("y")).unionByName(small.select("x", F.col("b").alias("y"))).filter("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()
        new = cut(small, "small")
        same = new.count() == now.count() and not new.join(now, ["a", "b"], "left_anti").limit(1).count()
        now, done = new, same
    return now


def _spanning(near: np.ndarray, within: bool) -> list[tuple[int, int]]:
    """Links (i, j) of a forest that connects what near connects; without `within` columns are other records, and j counts on from the rows."""
    n = len(near)
    total = n if within else n + near.shape[1]
    fresh, links = np.ones(total, bool), []
    for root in np.flatnonzero(near.any(axis=1)).tolist():
        if not fresh[root]:
            continue
        fresh[root], todo = False, [root]
        while todo:
            at = todo.pop()
            if within:
                reached = np.flatnonzero(near[at] & fresh)
            elif at < n:
                reached = np.flatnonzero(near[at] & fresh[n:]) + n
            else:
                reached = np.flatnonzero(near[:, at - n] & fresh[:n])
            fresh[reached] = False
            links += [(at, r) for r in reached.tolist()]
            todo += reached.tolist()
    return links


def _forest(x: np.ndarray, y: np.ndarray | None, cosine: float) -> list[tuple[int, int]]:
    """Links (i, j) that connect what the pairs of x and y (or of x) with the cosine connect; j counts on from the last of x."""
    near = np.zeros((len(x), len(x) if y is None else len(y)), bool)
    for start in range(0, len(x), 1000):
        near[start : start + 1000] = x[start : start + 1000] @ (x if y is None else y).T >= cosine
    if y is None:
        np.fill_diagonal(near, False)
    return _spanning(near, y is None)


def exact_links(members: DataFrame, cosine: float) -> DataFrame:
    """(a, b) of members(id, part, vector), enough to connect what all pairs of a part with the cosine connect.

    Every pair is compared, in blocks of WIDE by WIDE vectors, each by a task of its own.
    """
    parted = members.select("id", F.xxhash64("part", F.size("vector")).alias("part"), "vector")
    sizes = parted.groupBy("part").agg(F.ceil(F.count("*") / WIDE).alias("blocks"))
    numbered = parted.join(sizes, "part").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    spread = numbered.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    spread = spread.select("part", "id", "vector", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), (F.col("block") <= F.col("other")).alias("mine"))

    def link(got: pa.Table) -> pa.Table:
        mine, theirs = got.filter(got["mine"]), got.filter(pa.compute.invert(got["mine"]))
        flat = lambda t: matrix(t["vector"].combine_chunks())
        within = got["i"][0].as_py() == got["j"][0].as_py()
        links: list[tuple[int, int]] = []
        if mine.num_rows and (within or theirs.num_rows):
            links = _forest(flat(mine), None if within else flat(theirs), cosine)
        ids = np.concatenate([mine["id"].to_numpy(), theirs["id"].to_numpy()])
        ends = np.array(links, np.int64).reshape(-1, 2)
        return pa.table({"a": pa.array(ids[ends[:, 0]], pa.int64()), "b": pa.array(ids[ends[:, 1]], pa.int64())})

    return spread.groupBy("part", "i", "j").applyInArrow(link, "a long, b long")


def degrees(members: DataFrame, cosine: float) -> DataFrame:
    """(id, component, size, degree): with how many others of its component each of members(id, component, weight, vector) has the cosine.

    A member stands for `weight` equal ones, each of which counts. Exact. A component is compared in blocks of WIDE by WIDE
    vectors, each by a task of its own; nothing is emitted for a pair. Time is quadratic in the different vectors of a component.
    """
    sizes = members.groupBy("component").agg(F.ceil(F.count("*") / WIDE).alias("blocks"), F.sum("weight").alias("size"))
    numbered = members.join(sizes, "component").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    # each pair of blocks goes to one task, which counts for both
    spread = numbered.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    spread = spread.select("component", "id", "weight", "vector", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), (F.col("block") <= F.col("other")).alias("mine"))

    def count(got: pa.Table) -> pa.Table:
        got = got.combine_chunks()
        flat = lambda t: matrix(t["vector"].combine_chunks())
        weights = lambda t: t["weight"].to_numpy().astype(np.float64)
        if got["i"][0].as_py() == got["j"][0].as_py():  # a block with itself
            x, w = flat(got), weights(got)
            near = np.concatenate([(x[k : k + 1000] @ x.T >= cosine) @ w for k in range(0, len(x), 1000)])
            # copies are alike whatever rounding makes of their cosine
            own = np.einsum("ij,ij->i", x, x) >= cosine
            return pa.table({"id": got["id"], "degree": pa.array((near - own * w + w - 1).round().astype(np.int64))})
        mine, theirs = got.filter(got["mine"]), got.filter(pa.compute.invert(got["mine"]))
        if not mine.num_rows or not theirs.num_rows:
            return pa.table({"id": got["id"], "degree": pa.array(np.zeros(got.num_rows, np.int64))})
        x, y, rows, columns = flat(mine), flat(theirs), [], np.zeros(theirs.num_rows)
        for k in range(0, len(x), 1000):
            near = x[k : k + 1000] @ y.T >= cosine
            rows.append(near @ weights(theirs))
            columns += weights(mine)[k : k + 1000] @ near
        ids = pa.concat_arrays([mine["id"].combine_chunks(), theirs["id"].combine_chunks()])
        return pa.table({"id": ids, "degree": pa.array(np.concatenate([*rows, columns]).round().astype(np.int64))})

    counted = spread.groupBy("component", "i", "j").applyInArrow(count, "id long, degree long")
    total = counted.groupBy("id").agg(F.sum("degree").alias("degree"))
    return numbered.select("id", "component", "weight", "size").join(total, "id")


def cluster_vectors(vectors: DataFrame, cosine: float = COSINE, smallest: int = SMALLEST) -> DataFrame:
    """(model, id, component, size, degree) of the members of clusters.

    vectors(model, id, vector): ids unique, vectors nonzero (see vectors.usable_vectors()). A cluster has at least
    `smallest` vectors of one model, each with the cosine to half or more of the others. Equal vectors are
    members of their own. A loose group, in which a member has fewer links, is split: the member with the most
    links (then the smallest id) takes those linked to it (where all are, those with too few links leave),
    and what is left is grouped anew. No vectors give no clusters.
    """
    cosine -= TIE
    vectors = cut(vectors, "vectors")
    # equal vectors are one record, the one with the smallest id
    same = vectors.select("id", "model", F.xxhash64("vector").alias("h"), F.xxhash64("vector", F.lit(1)).alias("g"))
    firsts = same.groupBy("model", "h", "g").agg(F.min("id").alias("first"), F.count("*").alias("weight"))
    copies = cut(same.join(firsts, ["model", "h", "g"]).select("id", "model", "first", "weight"), "copies")
    firsts = copies.filter("id = first").select("id", "weight")
    rows = firsts.count()
    tasks = partitions_for(rows, HASHED, vectors.sparkSession)
    vectors = cut(vectors.repartition(tasks, "id").join(firsts.repartition(tasks, "id"), "id"), "distinct")
    links = proposed_links(cut(minhash_rows(vectors, rows, cosine), "hashed"), rows, cosine)
    groups = cut(connected_components(verified_links(links, vectors.select(F.col("id").alias("gid"), "vector"), cosine)), "groups")
    alone = vectors.filter(F.col("weight") >= smallest).select("id", F.col("id").alias("component")).join(groups, "id", "left_anti")
    groups = cut(groups.unionByName(alone), "groups")
    done = None
    while True:
        weighed = groups.join(vectors.select("id", "weight"), "id")
        sizes = weighed.groupBy("component").agg(F.sum("weight").alias("n")).filter(F.col("n") >= smallest).select("component")
        weighed = small(weighed.join(sizes, "component", "left_semi"))
        measured = cut(degrees(weighed.join(vectors.select("id", "vector"), "id"), cosine), "degrees")
        loose = measured.filter(2 * F.col("degree") < F.col("size") - 1).select("component").distinct()
        tight = measured.join(loose, "component", "left_anti")
        done = tight if done is None else done.unionByName(tight)
        rest = small(measured.join(loose, "component", "left_semi"))
        medoids = small(rest.groupBy("component").agg(F.max_by("id", F.struct("degree", -F.col("id"))).alias("medoid")))
        if not medoids.limit(1).count():
            break
        centre = medoids.join(vectors.select(F.col("id").alias("medoid"), F.col("vector").alias("centre")), "medoid")
        both = rest.select("id", "component").join(vectors.select("id", "vector"), "id").join(centre, "component")
        near = (F.col("id") == F.col("medoid")) | (similarity(F.col("vector"), F.col("centre")) >= cosine)
        parts = both.select("id", "component", "medoid", near.alias("near"))
        # where all are linked to the medoid, the members with too few links leave, so that every round makes groups smaller
        whole = parts.groupBy("component").agg(F.min("near").alias("all_near"))
        few = rest.select("id", (2 * F.col("degree") < F.col("size") - 1).alias("few"))
        parts = cut(parts.join(whole, "component").join(few, "id").select("id", "medoid", (F.col("near") & ~(F.col("all_near") & F.col("few"))).alias("in"), "all_near"), "parts")
        inside = parts.filter("in").select("id", F.col("medoid").alias("component"))
        out = small(parts.filter("not in").select("id", F.col("medoid").alias("part"))).join(vectors.select("id", "vector"), "id")
        apart = cut(connected_components(exact_links(out, cosine)), "apart")
        alone = out.join(vectors.select("id", "weight"), "id").filter(F.col("weight") >= smallest).select("id", F.col("id").alias("component")).join(apart, "id", "left_anti")
        groups = cut(inside.unionByName(apart).unionByName(alone), "groups")
    each = done.select(F.col("id").alias("first"), "component", "size", "degree")
    return copies.join(each, "first").select("model", "id", "component", "size", "degree")


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of clusters of message_vectors, of at least SESSIONS sessions: model, rowid, session_id, component, size, degree."""
    vectors = usable_vectors(table(spark, sf_dir, "message_vectors"))
    held = cut(vectors.select("model", "rowid", F.xxhash64("model", "rowid").alias("id"), "vector"), "usable")
    found = cut(cluster_vectors(held.select("model", "id", "vector")), "members")
    messages = table(spark, sf_dir, "messages").select("rowid", "session_id")
    rows = found.join(held.select("id", "rowid"), "id").join(messages, "rowid", "left")
    enough = rows.groupBy("component").agg(F.count_distinct("session_id").alias("sessions")).filter(F.col("sessions") >= SESSIONS)
    return rows.join(enough, "component")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cut(_members(spark, sf_dir), "clustered")
    first = rows.groupBy("component").agg(F.min("rowid").alias("first_rowid"))
    return rows.join(first, "component").select("model", "first_rowid", F.col("rowid").alias("message_rowid"))


def p6_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each cluster with its size, sessions, and most typical members (those with the most links, then the smallest rowid)."""
    rows = cut(_members(spark, sf_dir), "clustered")
    best = rows.withColumn("r", F.row_number().over(Window.partitionBy("component").orderBy(F.desc("degree"), "rowid"))).filter(F.col("r") <= TYPICAL)
    typical = best.groupBy("component").agg(F.array_sort(F.collect_list("rowid")).alias("typical"))
    facts = rows.groupBy("component", "model").agg(F.min("rowid").alias("first_rowid"), F.count("*").alias("size"), F.max("sessions").alias("sessions"))
    return facts.join(typical, "component").select("model", "first_rowid", "size", "sessions", "typical")


QUERIES = {"p6_found": p6_found, "p6_clusters": p6_clusters}
SQL: dict[str, str] = {}
