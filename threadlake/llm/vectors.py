"""The most similar vectors of every vector, by multiprobe p-stable hashing.

Vectors are scaled to length 1. Each table hashes them with Gaussian (2-stable) projections cut into bins of
one width; a search visits the own bucket and then buckets of neighbouring bins, in the order of their
estimated success. The candidates of all tables are merged and ranked by exact cosine. Copies of one vector
are searched once. The number of tables follows from that of the vectors, so that recall is the same at any size;
crowded buckets are compared exactly, block by block.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadlake.session import cut, table

PROBES = 16
RECALL = 0.995  # of pairs at the least cosine, from which the number of tables follows
SEED = 20250101
HOT = 4_000  # vectors in a bucket from which it is compared in blocks
BLOCK = 8_000


def usable_vectors(df: DataFrame) -> DataFrame:
    """(model, rowid, vector) of message_vectors: of repeated (message_rowid, model) the latest created_at counts (of
    equal times the greater vector); vectors that are null, of another length than dim, zero, or with NaN, infinite or
    null elements are left out."""
    rows = df.filter(F.col("message_rowid").isNotNull() & F.col("model").isNotNull())
    last = rows.groupBy("model", F.col("message_rowid").alias("rowid")).agg(F.max(F.struct("created_at", "vector", "dim")).alias("r")).select("model", "rowid", F.col("r.vector").alias("vector"), F.col("r.dim").alias("dim"))
    sound = F.forall("vector", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))) & F.exists("vector", lambda x: x != 0)
    return last.filter((F.size("vector") == F.col("dim")) & sound).select("model", "rowid", "vector")


def matrix(column: pa.Array) -> np.ndarray:
    """Lists of one length as rows, scaled to length 1."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    rows = flat.reshape(len(column), -1)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def by_length(batch: pa.RecordBatch, name: str) -> Iterator[pa.RecordBatch]:
    lengths = pa.compute.list_value_length(batch[name])
    for n in lengths.unique().to_pylist():
        yield batch.filter(pa.compute.equal(lengths, n))


def probe_order(width: int, probes: int) -> list[tuple[int, ...]]:
    """Sets of ranks of the 2 x width bin borders, nearest first, in order of the expected squared distance to cross them."""
    m = width
    cost = [j * (j + 1) / (4 * (m + 1) * (m + 2)) if j <= m else 1 - (2 * m + 1 - j) / (m + 1) + (2 * m + 1 - j) * (2 * m + 2 - j) / (4 * (m + 1) * (m + 2)) for j in range(1, 2 * m + 1)]
    out: list[tuple[int, ...]] = []
    heap = [(cost[0], (0,))]
    while heap and len(out) < probes:
        total, ranks = heapq.heappop(heap)
        if all(2 * m - 1 - r not in ranks for r in ranks):  # not both borders of one bin
            out.append(ranks)
        if (last := ranks[-1]) + 1 < 2 * m:
            heapq.heappush(heap, (total - cost[last] + cost[last + 1], (*ranks[:-1], last + 1)))
            heapq.heappush(heap, (total + cost[last + 1], (*ranks, last + 1)))
    return out


def bin_width(least: float) -> float:
    return 3.2 * math.sqrt(2 - 2 * least)


def hash_success(m: int, least: float, probes: int, pairs: int = 20_000) -> float:
    """How often one table finds a pair at the cosine `least`, by simulating the places of pairs in their bins."""
    rng = np.random.default_rng(SEED)
    at = rng.uniform(0, 1, (pairs, m))
    to = at + rng.standard_normal((pairs, m)) * math.sqrt(2 - 2 * least) / bin_width(least)
    found, moves = np.zeros(pairs, bool), np.concatenate([-np.eye(m), np.eye(m)])
    for p, q in ((at, to), (to, at)):
        step, rest = np.floor(q) - np.floor(p), p - np.floor(p)
        found |= (step == 0).all(axis=1)
        nearest = moves[np.argsort(np.concatenate([rest, 1 - rest], axis=1), axis=1)]
        for ranks in probe_order(m, probes):
            found |= (nearest[:, list(ranks)].sum(axis=1) == step).all(axis=1)
    return float(found.mean())


def hash_shape(rows: int, least: float, probes: int = PROBES) -> tuple[int, int]:
    """Projections of a table, so that few random vectors share a bucket, and tables, so that RECALL of the pairs at `least` are found."""
    r = bin_width(least) / math.sqrt(2)  # of vectors at a right angle
    meet = 1 - math.erfc(r / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))
    m = max(8, math.ceil(math.log(10 * max(rows, 2)) / -math.log(meet)))
    return m, max(2, math.ceil(math.log(1 - RECALL) / math.log1p(-min(hash_success(m, least, probes), 0.99))))


def _hashes(x: np.ndarray, m: int, width: float, tables: int, probes: int) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """Of each table: own bucket and probed buckets."""
    dim, order = x.shape[1], probe_order(m, probes)
    for t in range(tables):
        rng = np.random.default_rng((SEED, t, dim))
        axes, shift = rng.standard_normal((dim, m)), rng.uniform(0, 1, m)
        odd = rng.integers(-(2**62), 2**62, m) | 1
        at = x @ axes / width + shift
        bins = np.floor(at)
        rest = at - bins
        own = (bins.astype(np.int64) * odd).sum(axis=1) + odd[0] * (t + 1)
        moves = np.concatenate([-odd, odd])[np.argsort(np.concatenate([rest, 1 - rest], axis=1), axis=1)]
        yield own, [own + moves[:, list(ranks)].sum(axis=1) for ranks in order]


def greatest_of_rows(c: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the k greatest values of each row, of those from `least` on; of equal ones the leftmost."""
    keep = c >= least
    if c.shape[1] > k:
        keep &= c >= np.partition(c, c.shape[1] - k, axis=1)[:, c.shape[1] - k, None] - 1e-9
    row, column = np.nonzero(keep)
    order = np.lexsort((column, -np.round(c[row, column], 9), row))
    row, column = row[order], column[order]
    first = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[first], column[first]


def block_best(x: np.ndarray, x_ids: np.ndarray, y: np.ndarray, y_ids: np.ndarray, k: int, least: float, both: bool = True) -> pa.Table:
    """(a, b, cosine): of each x the k most similar of y and, for both, of each y those of x, never itself. The rows stand in the order that breaks ties."""
    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    place = {v: i for i, v in enumerate(y_ids.tolist())}
    same = np.array([place.get(v, -1) for v in x_ids.tolist()], np.int64)
    for start in range(0, len(x), 1000):
        c = x[start : start + 1000] @ y.T
        mine = np.flatnonzero(same[start : start + 1000] >= 0)
        c[mine, same[start + mine]] = -3
        i, j = greatest_of_rows(c, k, least)
        parts.append((x_ids[start + i], y_ids[j], c[i, j]))
        if both:
            j, i = greatest_of_rows(np.ascontiguousarray(c.T), k, least)
            parts.append((y_ids[j], x_ids[start + i], c[i, j]))
    return pa.table(dict(zip(("a", "b", "cosine"), (pa.array(np.concatenate([p[n] for p in parts] or [np.zeros(0)]), t) for n, t in enumerate((pa.int64(), pa.int64(), pa.float64()))))))


def _side(got: pa.Table, mine: bool) -> tuple[np.ndarray, np.ndarray]:
    """Vectors and ids of one side of a task, in the order of `first`."""
    rows = got.filter(got["mine"] if mine else pa.compute.invert(got["mine"])).sort_by("first").combine_chunks()
    if not rows.num_rows:
        return np.zeros((0, 1)), np.zeros(0, np.int64)
    return matrix(rows["vector"].combine_chunks()), rows["gid"].to_numpy()


def _crowded_pairs(visits: DataFrame, groups: DataFrame, k: int, least: float) -> DataFrame:
    """(a, b) of visits(gid, bucket, home): of each visitor the k most similar vectors at home in the bucket, and of those the k most similar visitors."""
    counts = visits.groupBy("bucket").agg(F.ceil(F.count(F.when(F.col("home"), 1)) / BLOCK).alias("is"), F.ceil(F.count("*") / BLOCK).alias("js"))
    numbered = visits.join(F.broadcast(counts), "bucket")
    block = lambda n: F.pmod(F.xxhash64("gid"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    homes = numbered.filter("home").select("gid", "bucket", block("is").alias("i"), every("js").alias("j"), F.lit(False).alias("mine"))
    spread = homes.unionByName(numbered.select("gid", "bucket", block("js").alias("j"), every("is").alias("i"), F.lit(True).alias("mine")))
    held = groups.select("gid", "vector", F.col("heads")[0].alias("first"), F.size("vector").alias("length"))

    def best(got: pa.Table) -> pa.Table:
        (x, x_ids), (y, y_ids) = _side(got, True), _side(got, False)
        if not len(x) or not len(y):
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        return block_best(x, x_ids, y, y_ids, k, least).select(["a", "b"])

    return spread.join(held, "gid").groupBy("bucket", "length", "i", "j").applyInArrow(best, "a long, b long")


def candidate_pairs(groups: DataFrame, rows: int, k: int, least: float, tables: int | None = None, probes: int = PROBES) -> DataFrame:
    """Distinct (a, b), a < b, of groups(model, gid, vector, heads) that share a visited bucket; of crowded buckets only those among the k best of either."""
    m, needed = hash_shape(rows, least, probes)
    width, tables = bin_width(least), tables or needed

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 2000):
                for batch in by_length(whole.slice(start, 2000), "vector"):
                    x, gid = matrix(batch["vector"]), batch["gid"].to_numpy()
                    seeds = np.array([hash_name(v) for v in batch["model"].to_pylist()], np.int64)
                    for own, probed in _hashes(x, m, width, tables, probes):
                        n = 1 + len(probed)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.tile(gid, n)), pa.array(np.concatenate([own, *probed]) + np.tile(seeds, n)), pa.array(np.repeat(np.arange(n) == 0, len(gid)))],
                            ["gid", "bucket", "home"],
                        )

    hashed = cut(groups.select("model", "gid", "vector").mapInArrow(run, "gid long, bucket long, home boolean"), "buckets")
    crowded = cut(hashed.filter("home").groupBy("bucket").count().filter(F.col("count") > HOT).select("bucket"), "crowded")  # at most rows x tables / HOT of them
    some = crowded.limit(1).count() > 0
    loose = hashed.join(F.broadcast(crowded), "bucket", "left_anti") if some else hashed
    index = loose.filter("home").select(F.col("gid").alias("b"), "bucket")
    found = loose.select(F.col("gid").alias("a"), "bucket").join(index, "bucket").filter("a <> b").select("a", "b")
    if some:
        found = found.unionByName(_crowded_pairs(hashed.join(F.broadcast(crowded), "bucket", "left_semi"), groups, k, least))
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def hash_name(name: str) -> int:
    """A fixed number for a name, so that vectors of different models never meet."""
    value = 1469598103934665603
    for byte in name.encode():
        value = (value ^ byte) * 1099511628211 % 2**64
    return value // 2 - 2**62


def pair_cosines(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """(a, b, cosine) of pairs(a, b) of groups(gid, vector)."""
    side = lambda k: groups.select(F.col("gid").alias(k), F.col("vector").alias(f"v_{k}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "v_a", "v_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in by_length(whole, "v_a"):
                cosine = np.einsum("ij,ij->i", matrix(batch["v_a"]), matrix(batch["v_b"]))
                yield pa.RecordBatch.from_arrays([batch["a"], batch["b"], pa.array(cosine)], ["a", "b", "cosine"])

    return both.mapInArrow(run, "a long, b long, cosine double")


def vector_groups(vectors: DataFrame, keep: int) -> tuple[DataFrame, DataFrame]:
    """Groups of equal vectors (model, gid, vector, heads: their `keep` smallest rowids) and members (model, gid, rowid)."""
    numbered = vectors.groupBy("model", "vector").agg(F.min("rowid").alias("first"))
    groups = cut(numbered.select("model", F.xxhash64("model", "first").alias("gid"), "vector", "first"), "groups")
    members = vectors.join(groups, ["model", "vector"]).select("model", "gid", "rowid")
    rank = Window.partitionBy("model", "gid").orderBy("rowid")
    heads = members.withColumn("r", F.row_number().over(rank)).filter(F.col("r") <= keep).groupBy("gid").agg(F.array_sort(F.collect_list("rowid")).alias("heads"))
    return groups.join(heads, "gid").select("model", "gid", "vector", "heads"), members


def similar_vectors(vectors: DataFrame, k: int = 5, least: float = 0.95, tables: int | None = None, probes: int = PROBES) -> DataFrame:
    """(model, rowid, near, cosine): up to k most similar others of each vector, of those with a cosine of at least `least`.

    vectors(model, rowid, vector) of nonzero vectors, see usable_vectors(); vectors of different models or
    lengths are never compared. Of equal cosines the smaller rowid comes first. Every vector is indexed and
    searched; of neighbours at the least cosine RECALL are found at any number of vectors, of nearer ones more
    (see tests). No vectors give no rows.
    """
    groups, members = vector_groups(vectors, k + 1)
    groups, members = cut(groups, "groups"), cut(members, "members")
    pairs = candidate_pairs(groups, groups.count(), k, least, tables, probes)
    close = cut(pair_cosines(pairs, groups).filter(F.col("cosine") >= least), "close")
    return _ranked(close.unionByName(close.select(F.col("b").alias("a"), F.col("a").alias("b"), "cosine")), groups, members, k)


def _ranked(both: DataFrame, groups: DataFrame, members: DataFrame, k: int) -> DataFrame:
    """(model, rowid, near, cosine) of the k best of both(a, b, cosine), the groups' neighbours, and of their own copies."""
    heads = groups.select(F.col("gid").alias("b"), "heads")
    # groups tied with the k-th are kept, so that ties are broken by rowid
    near = both.withColumn("r", F.rank().over(Window.partitionBy("a").orderBy(F.desc("cosine")))).filter(F.col("r") <= k).join(heads, "b")
    own = groups.filter(F.size("heads") > 1).select(F.col("gid").alias("a"), "heads", F.lit(1.0).alias("cosine"))
    options = near.select("a", "heads", "cosine").unionByName(own).select(F.col("a").alias("gid"), "cosine", F.explode("heads").alias("near"))
    first = Window.partitionBy("gid").orderBy(F.desc("cosine"), "near")
    options = options.withColumn("r", F.row_number().over(first)).filter(F.col("r") <= k + 1)
    mine = members.join(options, "gid").filter("rowid <> near")
    order = Window.partitionBy("model", "rowid").orderBy(F.desc("cosine"), "near")
    return mine.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k).select("model", "rowid", "near", "cosine")


def nearest_vectors(vectors: DataFrame, k: int = 5) -> DataFrame:
    """(model, rowid, near, cosine): the k most similar others of each vector, however far they are.

    As similar_vectors(), but exact: the nearest of most vectors are as far as random ones, which no hash tells
    apart. All vectors of a model and length are compared in blocks of BLOCK by BLOCK, each by a task of its own that
    gives only the k best of each row; time is quadratic. A vector with fewer others gets them all.
    """
    groups, members = vector_groups(vectors, k + 1)
    groups, members = cut(groups, "groups"), cut(members, "members")
    held = groups.select("gid", "vector", F.col("heads")[0].alias("first"), F.xxhash64("model", F.size("vector")).alias("part"))
    numbered = held.join(held.groupBy("part").agg(F.ceil(F.count("*") / BLOCK).alias("blocks")), "part").withColumn("block", F.pmod(F.xxhash64("gid"), F.col("blocks")))
    spread = numbered.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    spread = spread.select("part", "gid", "vector", "first", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), (F.col("block") <= F.col("other")).alias("mine"))

    def best(got: pa.Table) -> pa.Table:
        x, x_ids = _side(got, True)
        within = got["i"][0].as_py() == got["j"][0].as_py()
        y, y_ids = (x, x_ids) if within else _side(got, False)
        if not len(x) or not len(y):
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "cosine": pa.array([], pa.float64())})
        return block_best(x, x_ids, y, y_ids, k, -2, both=not within)

    both = cut(spread.groupBy("part", "i", "j").applyInArrow(best, "a long, b long, cosine double"), "nearest")
    return _ranked(both.withColumn("cosine", F.round("cosine", 9)), groups, members, k)


def p3_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_vectors(usable_vectors(table(spark, sf_dir, "message_vectors")))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = similar_vectors(usable_vectors(table(spark, sf_dir, "message_vectors")))
    return near.select("model", F.least("rowid", "near").alias("rowid_a"), F.greatest("rowid", "near").alias("rowid_b")).distinct()


QUERIES = {"p3_found": p3_found, "p3_neighbors": p3_neighbors}
SQL: dict[str, str] = {}
