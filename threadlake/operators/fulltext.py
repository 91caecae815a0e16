"""Full-text search: tokens, match, BM25 ranking, best hit per session, snippets.

A query is compiled to column expressions over a token array, so a search is one scan with all filters pushed
down; corpus statistics are one aggregation of a few numbers. build_index() writes an inverted table sorted by
term, whose row groups let score_indexed() skip to the terms of a query.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadlake.operators.search_language import And, Not, Or, Term, parse, terms

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
DEFAULT_LIMIT, POOL, POOL_TIMES = 20, 500, 10
SNIPPET_TOKENS = 12


@lru_cache(maxsize=1)
def _folding() -> tuple[str, str]:
    """Letters up to U+2FFF that are a base with marks, and their bases."""
    accented, base = [], []
    for code in range(0x80, 0x3000):
        ch = chr(code)
        parts = unicodedata.normalize("NFD", ch)
        if unicodedata.category(ch)[0] == "L" and len(parts) > 1 and all(unicodedata.category(c) == "Mn" for c in parts[1:]):
            accented.append(ch)
            base.append(parts[0])
    return "".join(accented), "".join(base)


_TOKEN = r"[\p{L}\p{N}\p{Co}]+"


def tokens(text: Column) -> Column:
    """Lower-case words of letters and digits without accents, in order; [] for null."""
    folded = F.lower(F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), *_folding()), r"\p{Mn}", ""))
    return F.regexp_extract_all(folded, F.lit(_TOKEN), F.lit(0))


def words(text: str) -> list[str]:
    """tokens() of a query's term, on the driver."""
    plain = "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn").lower()
    return re.findall(r"[^\W_]+", plain)


def _count(term: Term, toks: Column) -> Column:
    """How often the term occurs; overlapping occurrences of a phrase count."""
    parts = words(term.text)
    if not parts:
        return F.lit(0)
    if len(parts) == 1:
        hit = (lambda x: x.startswith(parts[0])) if term.prefix else (lambda x: x == parts[0])
        return F.size(F.filter(toks, hit))
    last = len(parts) - 1

    def starts(i: Column) -> Column:
        test = F.lit(True)
        for k, part in enumerate(parts):
            at = F.get(toks, i + k)
            test = test & F.coalesce(at.startswith(part) if term.prefix and k == last else at == part, F.lit(False))
        return test

    places = F.when(F.size(toks) >= len(parts), F.sequence(F.lit(0), F.size(toks) - len(parts))).otherwise(F.array().cast("array<int>"))
    return F.size(F.filter(places, starts))


def _needed(node) -> list[str]:
    """Whole words that every match holds; for pushing a cheap test below the scoring."""
    if isinstance(node, Term):
        parts = words(node.text)
        return parts[: len(parts) - 1] if node.prefix else parts
    if isinstance(node, And):
        return [w for p in node.parts for w in _needed(p)]
    return _needed(node.keep) if isinstance(node, Not) else []


def _is_void(node) -> bool:
    return isinstance(node, Term) and not words(node.text)


def _match(node, hits: dict[int, Column], ids: dict[int, int]) -> Column:
    if isinstance(node, Term):
        return hits[ids[id(node)]] > 0
    if isinstance(node, Not):
        return _match(node.keep, hits, ids) & ~_match(node.drop, hits, ids)
    parts = [_match(p, hits, ids) for p in node.parts]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole & p if isinstance(node, And) else whole | p
    return whole


def _score(node, gain: dict[int, Column], hits: dict[int, Column], ids: dict[int, int]) -> Column:
    """Sum over the terms, those in branches that don't match left out."""
    if isinstance(node, Term):
        return gain[ids[id(node)]]
    if isinstance(node, Not):
        return _score(node.keep, gain, hits, ids)
    total = F.lit(0.0)
    for p in node.parts:
        part = _score(p, gain, hits, ids)
        total = total + (part if isinstance(node, And) else F.when(_match(p, hits, ids), part).otherwise(0.0))
    return total


def _unshared(node):
    """Equal terms as objects of their own, so that each occurrence counts."""
    if isinstance(node, Term):
        return Term(node.text, node.phrase, node.prefix)
    if isinstance(node, Not):
        return Not(_unshared(node.keep), _unshared(node.drop))
    return type(node)(tuple(_unshared(p) for p in node.parts))


def score_matches(corpus: DataFrame, query: str, fuzzy: bool = False, text: str = "text", where: Column | None = None) -> DataFrame:
    """Rows of corpus that match the query, with score (BM25, negative, lower is better).

    Statistics are of the whole corpus, also where `where` narrows the result. Rows of null text count as empty
    ones and never match. A term without letters or digits matches nothing in an AND and is neutral in an OR.
    """
    tree = _unshared(parse(query, fuzzy))
    leaves = terms(tree)
    distinct = list(dict.fromkeys(leaves))
    toks = corpus.withColumn("_t", tokens(F.col(text)))
    stats = toks.agg(
        F.count("*").cast("double").alias("_n"),
        F.sum(F.size("_t")).cast("double").alias("_len"),
        *(F.sum((_count(t, F.col("_t")) > 0).cast("long")).cast("double").alias(f"_df{i}") for i, t in enumerate(distinct)),
    )
    rows = toks if where is None else toks.filter(where)
    for word in dict.fromkeys(_needed(tree)):
        rows = rows.filter(F.array_contains("_t", word))
    counted = rows.select(*corpus.columns, F.size("_t").alias("_dl"), *(_count(t, F.col("_t")).alias(f"_f{i}") for i, t in enumerate(distinct)))
    return _ranked(tree, leaves, distinct, counted, stats, corpus.columns)


def _ranked(tree, leaves: list, distinct: list, counted: DataFrame, stats: DataFrame, columns: list[str]) -> DataFrame:
    """Those of counted(columns, _dl, _f0, ...) that match, with their score; stats is one row of _n, _len, _df0, ..."""
    ids = {id(t): i for i, t in enumerate(leaves)}
    hits = {ids[id(t)]: F.col(f"_f{distinct.index(t)}") for t in leaves}
    matched = counted.filter(_match(tree, hits, ids)).crossJoin(F.broadcast(stats))  # one row of numbers
    gain = {}
    for t in leaves:
        i = distinct.index(t)
        f, df = F.col(f"_f{i}").cast("double"), F.col(f"_df{i}")
        idf = F.log((F.col("_n") - df + 0.5) / (df + 0.5))
        idf = F.when(idf <= 0, F.lit(LEAST_IDF)).otherwise(idf)
        gain[ids[id(t)]] = idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("_dl") / (F.col("_len") / F.col("_n"))))
    return matched.select(*columns, (-_score(tree, gain, hits, ids)).alias("score"))


def build_index(messages: DataFrame, key: str, path: str, partitions: int = 64) -> None:
    """Write the inverted table of messages to a folder: postings(term, key, positions) sorted by term, lengths(key, dl), totals(n, len)."""
    write_postings(postings(messages, [key]), f"{path}/postings", partitions)
    messages.select(key, F.size(tokens(F.col("text"))).alias("dl")).sort(key).write.mode("overwrite").parquet(f"{path}/lengths")
    lengths = messages.sparkSession.read.parquet(f"{path}/lengths")
    lengths.agg(F.count("*").cast("double").alias("_n"), F.sum("dl").cast("double").alias("_len")).write.mode("overwrite").parquet(f"{path}/totals")


def _placed(term: Term, found: Column) -> Column:
    """How often the term occurs, from found: an array of (term, positions) of a row."""
    parts = words(term.text)
    if not parts:
        return F.lit(0)

    def begins(k: int) -> Column:
        """Where the term would begin by the places of its k-th word."""
        open_ = term.prefix and k == len(parts) - 1
        mine = F.filter(found, lambda p: p["term"].startswith(parts[k]) if open_ else p["term"] == parts[k])
        return F.transform(F.flatten(F.transform(mine, lambda p: p["positions"])), lambda i: i - k)

    places = [begins(k) for k in range(len(parts))]
    if len(places) == 1:
        return F.size(places[0])
    whole = places[0]
    for p in places[1:]:
        whole = F.array_intersect(whole, p)
    return F.size(whole)


def score_indexed(spark: SparkSession, path: str, key: str, query: str, fuzzy: bool = False) -> DataFrame:
    """(key, score) of the rows that match, as score_matches() on the indexed table; only the terms of the query are read."""
    tree = _unshared(parse(query, fuzzy))
    leaves = terms(tree)
    distinct = list(dict.fromkeys(leaves))
    whole, open_ = set(), set()
    for t in distinct:
        parts = words(t.text)
        whole.update(parts[:-1] if t.prefix else parts)
        open_.update(parts[-1:] if t.prefix else [])
    wanted = F.col("term").isin(*whole) if whole else F.lit(False)
    for p in open_:
        wanted |= F.col("term").startswith(p)
    read = spark.read.parquet(f"{path}/postings").filter(wanted)
    found = read.groupBy(key).agg(F.collect_list(F.struct("term", "positions")).alias("_found"))  # one entry a term of the query and row
    counted = found.select(key, *(_placed(t, F.col("_found")).alias(f"_f{i}") for i, t in enumerate(distinct)))
    df = counted.agg(*(F.count_if(F.col(f"_f{i}") > 0).cast("double").alias(f"_df{i}") for i in range(len(distinct))))
    stats = spark.read.parquet(f"{path}/totals").crossJoin(F.broadcast(df))  # one row each
    placed = counted.join(spark.read.parquet(f"{path}/lengths").withColumnRenamed("dl", "_dl"), key)
    return _ranked(tree, leaves, distinct, placed, stats, [key])


def best_per(scored: DataFrame, owner: str, tie: list[str], limit: int = DEFAULT_LIMIT, pool: int | None = POOL) -> DataFrame:
    """The best row of each owner, best first, at most limit.

    pool: only so many best rows (at least POOL_TIMES the limit) are looked at, which is quick but may leave
    owners out; None looks at all.
    """
    if pool:
        scored = scored.orderBy("score", *tie).limit(max(pool, POOL_TIMES * limit))
    first = Window.partitionBy(owner).orderBy("score", *tie)
    return scored.withColumn("_r", F.row_number().over(first)).filter("_r = 1").drop("_r").orderBy("score", *tie).limit(limit)


def search(messages: DataFrame, sessions: DataFrame, query: str, limit: int = DEFAULT_LIMIT, fuzzy: bool = False, where: Column | None = None, pool: int | None = POOL, key: str = "rowid", index: str | None = None) -> DataFrame:
    """One hit per session: session columns, the message's key and text, and score. A blank query gives no rows.

    index: the folder of build_index() on the same messages; then only the query's terms are read, and the messages that match.
    """
    names = [c for c in ("title", "project_path", "started_at", "ended_at", "vendor", "record_kind") if c in sessions.columns]
    side = sessions.select(F.col("id").alias("session_id"), *names)
    if not query.strip():
        return messages.limit(0).join(side, "session_id").withColumn("score", F.lit(0.0))
    if index:
        scored = score_indexed(messages.sparkSession, index, key, query, fuzzy).join(messages if where is None else messages.filter(where), key)
    else:
        scored = score_matches(messages, query, fuzzy, where=where)
    hits = best_per(scored, "session_id", [key], limit, pool)
    return hits.join(side, "session_id", "inner").orderBy("score", key)


def postings(messages: DataFrame, keys: list[str]) -> DataFrame:
    """(term, keys..., positions): the inverted table; write it sorted by term within range partitions."""
    exploded = messages.select(*keys, F.posexplode(tokens(F.col("text"))).alias("pos", "term"))
    return exploded.groupBy("term", *keys).agg(F.array_sort(F.collect_list("pos")).alias("positions"))


def write_postings(table: DataFrame, path: str, partitions: int = 64) -> None:
    table.repartitionByRange(partitions, "term").sortWithinPartitions("term").write.mode("overwrite").parquet(path)


def snippet(text: str | None, query: str, fuzzy: bool = False, size: int = SNIPPET_TOKENS) -> str:
    """At most `size` words around the first match, matched words in brackets, … where text was cut.

    For the few rows of a result; see snippets().
    """
    text = text or ""
    places = [(m.start(), m.end(), (words(m.group()) or [""])[0]) for m in re.finditer(r"[^\W_]+", text)]
    wanted = [(words(t.text), t.prefix) for t in terms(parse(query, fuzzy))]
    marked: set[int] = set()
    for parts, prefix in wanted:
        for i in range(len(places) - len(parts) + 1 if parts else 0):
            same = [places[i + k][2] == p or prefix and k == len(parts) - 1 and places[i + k][2].startswith(p) for k, p in enumerate(parts)]
            if all(same):
                marked.update(range(i, i + len(parts)))
    first = min(marked, default=0)
    start = max(0, min(first - size // 3, len(places) - size))
    shown = places[start : start + size]
    if not shown:
        return text
    out = "… " if start else ""
    at = shown[0][0] if start else 0
    for k, (s, e, _) in enumerate(shown, start):
        out += text[at:s] + "[" * (k in marked and (k - 1 not in marked or k == start)) + text[s:e]
        out += "]" * (k in marked and (k + 1 not in marked or k + 1 == start + len(shown)))
        at = e
    return out + (" …" if start + size < len(places) else text[at:])


def snippets(hits: DataFrame, query: str, fuzzy: bool = False) -> DataFrame:
    """hits with a snippet column; meant for results that were cut to a limit."""

    @F.pandas_udf("string")
    def cut(texts):
        return texts.map(lambda t: snippet(t, query, fuzzy))

    return hits.withColumn("snippet", cut("text"))
