"""Filling containers of fixed capacity with items, by minimum bin slack over the multiset of sizes.

However many items there are, they have at most `capacity` different sizes; only the counts of sizes go to the
driver. Each container takes the largest size left and the multiset of other sizes that comes closest to the
capacity, found by a subset-sum dynamic program over bitsets and read off by backtracking; a filling is then
repeated as often as the counts allow. The items are dealt to the fillings by their rank within their size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadlake.llm.tokens import count_tokens
from threadlake.session import cut, table

CAPACITY = 2048
SPREAD = 200_000  # pieces ranked by one task; a size with more is ranked in parts
MOST_PARTS = 512  # so that at most capacity x MOST_PARTS counts go to the driver


def best_filling(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of sizes from counts whose sum comes closest to room without passing it."""
    reach, mask, stages = 1, (1 << (room + 1)) - 1, []
    for size in sorted(counts, reverse=True):
        left = min(counts[size], room // size)
        lump = 1
        while left > 0:  # binary parts of the count
            take = min(lump, left)
            stages.append((size, take, reach))
            reach |= (reach << (size * take)) & mask
            left, lump = left - take, lump * 2
        if reach >> room & 1:
            break
    at, used = reach.bit_length() - 1, {}
    for size, take, before in reversed(stages):
        if not before >> at & 1:
            used[size] = used.get(size, 0) + take
            at -= size * take
    return used


def plan_fillings(counts: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """(times, filling) until all sizes are used up."""
    counts = {s: n for s, n in counts.items() if n > 0}
    plan = []
    while counts:
        largest = max(counts)
        rest = counts | {largest: counts[largest] - 1}
        if not rest[largest]:
            del rest[largest]
        used = best_filling(rest, capacity - largest)
        used[largest] = used.get(largest, 0) + 1
        times = min(counts[s] // n for s, n in used.items())
        plan.append((times, used))
        for s, n in used.items():
            counts[s] -= times * n
            if not counts[s]:
                del counts[s]
    return plan


def pack(items: DataFrame, key: str, size: str, capacity: int = CAPACITY) -> DataFrame:
    """(key, piece, n_pieces, piece_size, container) of all items(key, size).

    An item over the capacity by itself is cut into full containers and a rest, which is packed like any
    other; no other item is split. Items of size 0, null or less take no room: one piece, container null. Equal
    keys are items of their own. Containers are numbered from 0. An empty table gives no rows.
    """
    spark = items.sparkSession
    whole = F.coalesce(F.col(size), F.lit(0)).cast("long")
    sized = items.select(F.col(key), F.greatest(whole, F.lit(0)).alias("_n"))
    sized = sized.withColumn("n_pieces", F.greatest(F.ceil(F.col("_n") / capacity), F.lit(1)).cast("int"))
    pieces = sized.select(key, "n_pieces", "_n", F.explode(F.sequence(F.lit(0), F.col("n_pieces") - 1)).alias("piece"))
    pieces = pieces.withColumn("piece_size", F.least(F.lit(capacity), F.col("_n") - F.col("piece").cast("long") * capacity).cast("int")).drop("_n")
    pieces = cut(pieces, "pieces")
    most = pieces.groupBy("piece_size").count().agg(F.max("count")).first()[0] or 0
    salts = min(MOST_PARTS, max(1, -(-most // SPREAD)))
    pieces = pieces.withColumn("salt", F.pmod(F.xxhash64(key, "piece"), F.lit(salts)).cast("int"))
    # at most capacity x MOST_PARTS rows, whatever the input
    counted = pieces.filter("piece_size > 0").groupBy("piece_size", "salt").count().collect()
    by: dict[int, list[int]] = {}
    for s, salt, n in counted:
        by.setdefault(s, [0] * salts)[salt] = n
    offsets = [(s, k, sum(ns[:k])) for s, ns in by.items() for k in range(salts)]
    used: dict[int, int] = {}
    rows, first = [], 0
    for times, filling in plan_fillings({s: sum(ns) for s, ns in by.items()}, capacity):
        for s, n in filling.items():
            start = used.get(s, 0)
            rows.append((s, start, start + n * times, n, first))
            used[s] = start + n * times
        first += times
    place = spark.createDataFrame(offsets, "piece_size int, salt int, base long")
    plan = spark.createDataFrame(rows, "size int, low long, high long, each int, first long")
    rank = F.row_number().over(Window.partitionBy("piece_size", "salt").orderBy(key, "piece"))
    ranked = pieces.filter("piece_size > 0").withColumn("_r", rank).join(F.broadcast(place), ["piece_size", "salt"]).withColumn("_i", F.col("base") + F.col("_r") - 1)
    dealt = ranked.join(F.broadcast(plan), (F.col("piece_size") == F.col("size")) & (F.col("_i") >= F.col("low")) & (F.col("_i") < F.col("high")))
    container = F.col("first") + F.floor((F.col("_i") - F.col("low")) / F.col("each"))
    dealt = dealt.select(key, "piece", "n_pieces", "piece_size", container.cast("long").alias("container"))
    return dealt.unionByName(pieces.filter("piece_size = 0").select(key, "piece", "n_pieces", "piece_size", F.lit(None).cast("long").alias("container")))


def p9_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts of documents in containers of 2,048 tokens."""
    return pack(count_tokens(table(spark, sf_dir, "documents"), "doc_id", "text"), "doc_id", "n_tokens")


def containers(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(container, pieces, filled, slack) of pack()'s containers."""
    return packed.filter("container is not null").groupBy("container").agg(F.count("*").alias("pieces"), F.sum("piece_size").alias("filled")).withColumn("slack", F.lit(capacity) - F.col("filled"))


def p9_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every container with its number of pieces, tokens and unused space."""
    return containers(p9_pack(spark, sf_dir))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that the plan puts into more than one container."""
    put = p9_pack(spark, sf_dir).filter("container is not null").groupBy("doc_id").agg(F.count_distinct("container").alias("n"))
    return put.filter("n > 1").select("doc_id")


QUERIES = {"p9_found": p9_found, "p9_pack": p9_pack, "p9_containers": p9_containers}
SQL: dict[str, str] = {}
