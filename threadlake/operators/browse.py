"""Browsing: recent sessions, pages, views of a thread, facets, orders and groups of hits."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadlake.functions.text import clamp
from threadlake.schemas import coerce_kind, known_vendor, vendor_label

PAGE, MOST_PAGE, PAGE_KINDS = 50, 200, ("text", "tool_use", "tool_result")


def recent_sessions(sessions: DataFrame, limit: int = 20, kind: str | None = None, project: str | None = None, vendor: str | None = None, since=None) -> DataFrame:
    """Sessions by their end, latest first; since compares with the end. An unknown vendor or kind means the default one."""
    rows = sessions
    if kind:
        rows = rows.filter(coerce_kind(F.col("record_kind")) == (kind if kind in ("chat", "plan") else "chat"))
    if project:
        rows = rows.filter(F.col("project_path") == project)
    if vendor:
        rows = rows.filter(F.col("vendor") == known_vendor(vendor))
    if since is not None:
        rows = rows.filter(F.col("ended_at") >= F.lit(since))
    return rows.orderBy(F.desc_nulls_last("ended_at"), "id").limit(limit)


def session_messages(messages: DataFrame, session_id: str) -> DataFrame:
    return messages.filter(F.col("session_id") == session_id).orderBy("seq", "rowid")


def page(messages: DataFrame, session_id: str, offset: int = 0, limit: int | None = None, kinds: tuple[str, ...] = PAGE_KINDS, sidechains: bool = False) -> DataFrame:
    """A page of a session's messages with place, total, has_more and next_offset on every row."""
    limit = clamp(limit, PAGE, MOST_PAGE)
    rows = messages.filter((F.col("session_id") == session_id) & F.col("kind").isin(*kinds))
    if not sidechains:
        rows = rows.filter(~F.coalesce("is_sidechain", F.lit(False)))
    total = rows.agg(F.count("*").alias("total"))  # one row
    shown = rows.orderBy("seq", "rowid").offset(offset).limit(limit)
    placed = shown.withColumn("place", F.row_number().over(Window.partitionBy("session_id").orderBy("seq", "rowid")) - 1 + offset).crossJoin(F.broadcast(total))
    more = F.col("total") > offset + limit
    return placed.withColumn("has_more", more).withColumn("next_offset", F.when(more, F.lit(offset + limit)))


def view_filter(name: str) -> Column:
    """Named views of a thread."""
    side, kind, role = F.coalesce("is_sidechain", F.lit(False)), F.col("kind"), F.col("role")
    return {
        "all": F.lit(True),
        "you": (kind == "text") & (role == "user") & ~side,
        "task": (kind == "text") & (role == "user") & side,
        "claude": (kind == "text") & (role == "assistant"),
        "thinking": kind == "thinking",
        "tool": kind == "tool_use",
        "result": kind == "tool_result",
        "sidechain": side,
    }[name]


def facets(hits: DataFrame) -> DataFrame:
    """Distinct project paths of hits, without empty ones."""
    return hits.filter(F.col("project_path").isNotNull() & (F.col("project_path") != "")).select("project_path").distinct().orderBy("project_path")


def filter_hits(hits: DataFrame, project: str | None = None, kind: str | None = None, vendor: str | None = None) -> DataFrame:
    for column, value in (("project_path", project), ("record_kind", kind), ("vendor", vendor)):
        if value:
            hits = hits.filter(F.col(column) == value)
    return hits


def sort_hits(hits: DataFrame, mode: str = "relevance") -> DataFrame:
    order = {
        "relevance": ["score", "id"] if "score" in hits.columns else ["id"],
        "last": [F.desc_nulls_last("ended_at"), "id"],
        "created": [F.desc_nulls_last("started_at"), "id"],
        "project": ["project_path", "title", "id"],
        "title": ["title", "id"],
    }[mode]
    return hits.orderBy(*order)


def group_hits(hits: DataFrame, by: str, place: str = "place") -> DataFrame:
    """hits with group label and opens (the first of its group), groups in order of their label, hits in their place within."""
    path = F.coalesce(F.nullif("project_path", F.lit("")), F.lit("(no path)"))
    label = {"path": path, "vendor": vendor_label(F.col("vendor")), "vendor+path": F.concat_ws(" · ", vendor_label(F.col("vendor")), path)}[by]
    grouped = hits.withColumn("label", label)
    order = Window.partitionBy("label").orderBy(place)
    return grouped.withColumn("opens", F.row_number().over(order) == 1).orderBy("label", place)


def find_lines(messages: DataFrame, needle: str) -> DataFrame:
    """(session_id, seq, line) of lines that hold the text, in any case."""
    lines = messages.select("session_id", "seq", F.posexplode(F.split("text", "\n")).alias("line", "content"))
    return lines.filter(F.contains(F.lower("content"), F.lit(needle.lower()))).select("session_id", "seq", "line", "content")


def highlight(text: Column, needle: str) -> Column:
    return F.regexp_replace(text, "(?i)" + re.sub(r"([\\^$.|?*+()\[\]{}\-])", r"\\\1", needle), "[$0]") if needle else text


def recent_queries(log: DataFrame, most: int = 100) -> DataFrame:
    """The last distinct queries of log(query, at), the latest last."""
    last = log.groupBy("query").agg(F.max("at").alias("at")).orderBy(F.desc("at"), "query").limit(most)
    return last.orderBy("at", F.desc("query"))


def tag(vendor: Column, record_kind: Column, has_transcript: Column) -> Column:
    """[Label], [Label plan] or [Label prompt-only]."""
    note = F.when(record_kind == "plan", "plan").when(~has_transcript, "prompt-only")
    return F.concat(F.lit("["), F.concat_ws(" ", vendor_label(vendor), note), F.lit("]"))


def fill_sessions(hits: DataFrame, sessions: DataFrame) -> DataFrame:
    """hits with their sessions' columns; hits of sessions that are gone stay, with nulls."""
    return hits.join(sessions.select(F.col("id").alias("session_id"), "title", "project_path", "vendor", "started_at"), "session_id", "left")


def merge_sources(rows: DataFrame) -> DataFrame:
    """One row per id of rows(id, source_rank, ...): the greatest source_rank wins, blanks are filled from lower ones."""
    fields = [c for c in rows.columns if c not in ("id", "source_rank")]
    filled = {c: F.nullif(F.col(c), F.lit("")) if dict(rows.dtypes)[c] == "string" else F.col(c) for c in fields}
    return rows.groupBy("id").agg(*(F.max_by(v, F.when(v.isNotNull(), F.col("source_rank"))).alias(c) for c, v in filled.items()))
