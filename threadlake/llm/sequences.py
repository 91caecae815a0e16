"""Ordered patterns of steps that many entities share, other steps between them allowed.

Patterns are found by direct comparison of sequences. For a frequent prefix, every sequence that holds it is
kept under its smallest possible next step. With the sequences in that order, the first entry is compared with
the threshold-th: if they are the same step, the pattern is frequent, and its sequences move on to their next
step; if not, no step before the threshold-th entry can be frequent, and the sequences before it jump there.
Infrequent candidates are thus never counted.

Two things make this work at any size. Sequences are shortened before they are compared: a step can be left
out if no pattern of the wanted length is first completed there, which is seen from the steps before it and
needs no other sequence; long sequences are cut into pieces, shortened, joined and shortened again, so none
is ever held whole. And sequences are compared in blocks of bounded size: a pattern frequent overall is
frequent at the same rate in at least one block, so the blocks' patterns are all the candidates, which are
then counted exactly in every block.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlake.session import cut, partitions_for, table

SHORTEST, LONGEST = 3, 5
SHARE, LEAST = 0.02, 5
PIECE = 512  # steps of a sequence that are shortened together
FAN = 32  # shortened pieces that are joined and shortened again
BLOCK = 20_000  # sequences compared by one task


def shorten(steps: list, longest: int) -> list[int]:
    """Places of the steps that can complete a pattern of up to longest steps for the first time.

    Exact: every pattern of up to longest steps in the sequence is also in what is kept, and no other.
    """
    ready: dict = {}  # the fewest steps of a pattern that a step completes next
    low = 1
    kept = []
    for place, step in enumerate(steps):
        level = min(ready.get(step, low), longest + 1)
        if level <= longest:
            kept.append(place)
        ready[step] = level + 1
        # a pattern of `level` steps ends here: any other step may follow it as step level + 1
        for other, need in ready.items():
            if need > level + 1:
                ready[other] = level + 1
        if low > level + 1:
            low = level + 1
    return kept


def compare(sequences: list[list[int]], weights: list[int], threshold: int, longest: int) -> list[tuple[int, ...]]:
    """All patterns of up to longest steps held by sequences of a total weight of at least threshold."""
    found: list[tuple[int, ...]] = []

    def grow(prefix: tuple[int, ...], entries: list[tuple[int, int]]) -> None:
        # entries: sequence and the place after the first occurrence of the prefix
        options, heaps, total = {}, {}, 0
        for k, (s, at) in enumerate(entries):
            steps = sorted(set(sequences[s][at:]))
            if steps:
                options[k] = steps
                heaps.setdefault(steps[0], []).append(k)
                total += weights[s]
        keys = list(heaps)
        heapq.heapify(keys)
        while keys and total >= threshold:
            first = keys[0]
            weight, order = 0, []
            while weight < threshold:  # the threshold-th entry
                order.append(heapq.heappop(keys))
                weight += sum(weights[entries[k][0]] for k in heaps[order[-1]])
            limit = order[-1]
            frequent = limit == first
            if not frequent:
                heapq.heappush(keys, limit)
            for step in order if frequent else order[:-1]:
                members = heaps.pop(step)
                if frequent:
                    pattern = (*prefix, step)
                    found.append(pattern)
                    if len(pattern) < longest:
                        grow(pattern, [(entries[k][0], sequences[entries[k][0]].index(step, entries[k][1]) + 1) for k in members])
                for k in members:
                    steps = options[k]
                    i = bisect_right(steps, step) if frequent else bisect_left(steps, limit)
                    if i == len(steps):
                        total -= weights[entries[k][0]]
                        continue
                    if steps[i] not in heaps:
                        heaps[steps[i]] = []
                        heapq.heappush(keys, steps[i])
                    heaps[steps[i]].append(k)

    grow((), [(s, 0) for s in range(len(sequences))])
    return found


def holds(sequence: list[int], patterns: dict) -> Iterator[tuple[int, ...]]:
    """The patterns of a trie (step: (pattern or None, further steps)) that the sequence holds."""
    stack = [(patterns, 0)]
    while stack:
        node, at = stack.pop()
        rest = sequence[at:]
        for step in node.keys() & set(rest):
            pattern, further = node[step]
            if pattern is not None:
                yield pattern
            if further:
                stack.append((further, at + rest.index(step) + 1))


def _trie(patterns: list[tuple[int, ...]]) -> dict:
    root: dict = {}
    for p in patterns:
        node = root
        for i, step in enumerate(p):
            pattern, further = node.setdefault(step, (None, {}))
            if i == len(p) - 1:
                node[step] = (p, further)
            node = further
    return root


def _shortened(pieces: DataFrame, longest: int) -> DataFrame:
    """pieces(entity, part, steps) with shortened steps."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf["steps"] = [[steps[i] for i in shorten(steps, longest)] for steps in map(list, pdf["steps"])]
            yield pdf

    return pieces.mapInPandas(run, pieces.schema)


def shortened_sequences(steps: DataFrame, longest: int = LONGEST) -> DataFrame:
    """steps(entity, seq, tie, step) to (entity, steps): the steps that matter to patterns of up to longest steps.

    Ordered by seq; of a repeated seq the row with the greatest tie counts once. An entity may have any
    number of steps: at most PIECE of them, and then FAN shortened pieces, are held together.
    """
    part = F.floor(F.col("seq") / PIECE)
    # one shuffle serves both aggregations: those of a piece's repeated seqs and of the piece
    placed = steps.withColumn("part", part).repartition("entity", "part")
    once = placed.groupBy("entity", "part", "seq").agg(F.max_by("step", "tie").alias("step"))
    pieces = once.groupBy("entity", "part").agg(F.array_sort(F.collect_list(F.struct("seq", "step"))).alias("l"))
    pieces = cut(_shortened(pieces.select("entity", "part", F.transform("l", lambda x: x["step"]).alias("steps")), longest), "pieces")
    most = pieces.agg(F.max(F.abs("part"))).first()[0] or 0
    while True:
        last = most < FAN
        joined = pieces.groupBy("entity", (F.lit(0).cast("long") if last else F.floor(F.col("part") / FAN)).alias("part"))
        several = joined.agg(F.array_sort(F.collect_list(F.struct("part", "steps"))).alias("l")).select("entity", "part", F.flatten(F.transform("l", lambda x: x["steps"])).alias("steps"))
        pieces = _shortened(several, longest)
        if last:
            return pieces.select("entity", "steps")
        pieces, most = cut(pieces, "pieces"), most // FAN


def frequent_patterns(steps: DataFrame, shortest: int = SHORTEST, longest: int = LONGEST, share: float = SHARE, least: int = LEAST) -> DataFrame:
    """(pattern array<string>, support) of patterns of shortest to longest steps, in order, gaps allowed.

    steps(entity, seq, tie, step): an entity's steps by seq, see shortened_sequences(). A pattern is frequent
    if at least share (rounded up) of the entities with a row, and at least `least` of them, hold it; an
    entity counts once. Rows with a null entity or seq are left out; a null step is no step, but its entity
    counts. Equal steps may follow each other in a pattern if they do so in sequences. No rows give no patterns.
    """
    spark = steps.sparkSession
    steps = steps.filter("entity is not null and seq is not null")
    sequences = cut(shortened_sequences(steps, longest), "sequences")
    total = sequences.count()
    out = "pattern array<string>, support long"
    threshold = max(least, math.ceil(round(share * total, 9)))
    if total < threshold:
        return spark.createDataFrame([], out)
    single = sequences.select(F.explode(F.array_distinct("steps")).alias("step")).filter("step is not null").groupBy("step").count().filter(F.col("count") >= threshold)
    # sum of supports <= kept steps, each support >= share of the entities: at most (mean steps) / share names
    names = sorted(r[0] for r in single.select("step").collect())
    if not names:
        return spark.createDataFrame([], out)
    codes = {name: i for i, name in enumerate(names)}
    rate = threshold / total
    blocks = partitions_for(total, BLOCK, spark)

    def coded(batches: Iterator[pd.DataFrame]) -> dict[tuple[int, ...], int]:
        counts: dict[tuple[int, ...], int] = {}
        for pdf in batches:
            for raw in pdf["steps"]:
                known = [codes[s] for s in raw if s in codes]
                seq = tuple(known[i] for i in shorten(known, longest))
                counts[seq] = counts.get(seq, 0) + 1
        return counts

    def candidates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = coded(batches)
        here = sum(counts.values())
        if here:
            kept = [s for s in counts if len(s) >= shortest]
            patterns = compare([list(s) for s in kept], [counts[s] for s in kept], max(1, math.ceil(round(rate * here, 9))), longest)
            yield pd.DataFrame({"pattern": pd.Series([list(p) for p in patterns if len(p) >= shortest], dtype=object)})

    dealt = cut(sequences.select("steps").repartition(blocks), "dealt")
    laid = dealt.coalesce(blocks)
    found = [tuple(r[0]) for r in laid.mapInPandas(candidates, "pattern array<int>").distinct().collect()]

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trie, held = _trie(found), {}
        for seq, n in coded(batches).items():
            for p in holds(list(seq), trie):
                held[p] = held.get(p, 0) + n
        yield pd.DataFrame({"pattern": pd.Series([list(p) for p in held], dtype=object), "support": pd.Series(list(held.values()), dtype="int64")})

    supports = laid.mapInPandas(count, "pattern array<int>, support long").groupBy("pattern").agg(F.sum("support").alias("support")).filter(F.col("support") >= threshold)
    array = F.array(*(F.lit(n) for n in names))
    return supports.select(F.transform("pattern", lambda i: F.get(array, i)).alias("pattern"), "support")


def step_name(tool: Column, text: Column) -> Column:
    """The tool's name, trimmed, in lower case (without one the first word of the text); for bash also the command's first word."""
    trim = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    word = lambda c: F.nullif(F.regexp_extract(c, r"(?U)^\s*(\S+)", 1), F.lit(""))
    name = F.lower(F.coalesce(F.nullif(trim(tool), F.lit("")), word(text)))
    command = F.coalesce(F.get_json_object(F.regexp_extract(text, r"(?s)(\{.*)$", 1), "$.command"), F.lit(""))
    return F.when(name == "bash", F.concat(F.lit("bash:"), F.coalesce(word(command), F.lit("")))).otherwise(name)


def tool_steps(messages: DataFrame) -> DataFrame:
    used = messages.filter(F.lower(F.regexp_replace("kind", r"(?U)^\s+|\s+$", "")) == "tool_use")
    return used.select(F.col("session_id").alias("entity"), "seq", F.struct("indexed_at", "rowid").alias("tie"), step_name(F.col("tool_name"), F.col("text")).alias("step"))


def p4_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = frequent_patterns(tool_steps(table(spark, sf_dir, "messages")))
    return found.select(F.array_join("pattern", " > ").alias("pattern"), "support")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p4_patterns(spark, sf_dir).select("pattern")


QUERIES = {"p4_found": p4_found, "p4_patterns": p4_patterns}
SQL: dict[str, str] = {}
