"""Incremental indexing: discover, skip what is unchanged, parse, replace, and note it in the ledger."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlake.operators.browse import merge_sources
from threadlake.session import cut
from threadlake.sources import transcripts as t
from threadlake.sources.store import Store, archive_plan, changed, fingerprints


@dataclass
class IndexConfig:
    """Where things are; only what is given is read."""

    claude: str | None = None
    desktop: str | None = None
    cursor: str | None = None
    opencode: str | None = None
    codex: str | None = None
    history: str | None = None
    plan_roots: list[str] = field(default_factory=list)
    cursor_plan_roots: list[str] = field(default_factory=list)
    plan_archive: str | None = None


@dataclass
class IndexStats:
    sessions: int = 0
    indexed: int = 0
    prompt_only: int = 0
    plans: int = 0
    skipped: int = 0
    messages: int = 0
    failed: list[str] = field(default_factory=list)
    elapsed: float = 0.0


def index(spark: SparkSession, store: Store, config: IndexConfig, deep: bool = True, force: bool = False) -> IndexStats:
    """One run over all sources. A source that fails is noted and the run goes on; running again changes nothing."""
    began, stats = time.time(), IndexStats()
    found: list[tuple[DataFrame, DataFrame]] = []
    notes: list[DataFrame] = []
    ledger = store.read("ledger")
    transcripts: DataFrame | None = None
    readers = {"claude": (t.claude, "*.jsonl"), "cursor": (t.cursor, "*.jsonl"), "codex": (t.codex, "rollout-*.jsonl")}
    for name, (reader, pattern) in readers.items():
        root = getattr(config, name)
        if not root:
            continue
        try:
            catalog = cut(fingerprints(spark, root, pattern, f"deep={deep}"), "catalog")
            fresh = changed(catalog, ledger, force).count()
            stats.skipped += catalog.count() - fresh
            if not fresh:
                continue
            sessions, messages = reader(spark, root, deep)
            sessions, messages = cut(sessions, "sessions"), cut(messages, "messages")
            if name == "claude":
                transcripts = sessions
            # sessions that have a changed file; their side files are read with them
            stale = changed(catalog, ledger, force).select("path")
            hit = F.regexp_extract("path", {"claude": r"/([^/]+)(?:/subagents/[^/]+)?(?:\.jsonl)?$", "cursor": r"/agent-transcripts/([^/]+)/", "codex": r"()"}[name], 1)
            if name != "codex":
                keys = stale.select(F.concat(F.lit("cursor:" if name == "cursor" else ""), F.regexp_replace(hit, r"\.jsonl$", "")).alias("id")).distinct()
                sessions = cut(sessions.join(keys, "id", "left_semi"), "sessions")
            found.append((sessions, messages))
            notes.append(catalog.select("path", F.lit("").alias("session_id"), "content_hash"))
        except Exception as e:  # one source's failure must not stop the others
            stats.failed.append(f"{name}: {e}")
    if config.desktop and transcripts is not None:
        try:
            over = cut(t.desktop(spark, config.desktop, transcripts), "desktop")
            sessions, messages = found[0]
            ranked = sessions.withColumn("source_rank", F.lit(0)).unionByName(over.withColumn("source_rank", F.lit(1)))
            found[0] = (cut(merge_sources(ranked).select(*sessions.columns), "merged"), messages)
        except Exception as e:
            stats.failed.append(f"desktop: {e}")
    if config.opencode:
        try:
            sessions, messages = t.opencode(spark, config.opencode, deep)
            catalog = sessions.select(F.concat(F.lit("opencode-db:"), "id").alias("path"), F.sha2(F.concat_ws("-", F.unix_millis("ended_at"), "message_count"), 256).alias("content_hash"), "id")
            fresh = cut(changed(catalog, ledger, force), "opencode")
            stats.skipped += catalog.count() - fresh.count()
            found.append((cut(sessions.join(fresh.select("id"), "id", "left_semi"), "sessions"), cut(messages, "messages")))
            notes.append(fresh.select("path", F.col("id").alias("session_id"), "content_hash"))
        except Exception as e:
            stats.failed.append(f"opencode: {e}")
    known = store.read("sessions").select("id")
    for sessions, _ in found:
        known = known.unionByName(sessions.select("id"))
    if config.history:
        log = t.prompts(spark, config.history)
        held = store.read("sessions").filter("has_transcript").select("id")
        for sessions, _ in found:
            held = held.unionByName(sessions.select("id"))
        sessions, messages = t.prompt_rows(log, held)
        digests = log.groupBy("session_id").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), "\n"), 256).alias("content_hash"))
        catalog = digests.join(sessions.select(F.col("id").alias("session_id")), "session_id", "left_semi").select(F.concat(F.lit("history:"), "session_id").alias("path"), "session_id", "content_hash")
        fresh = cut(changed(catalog, ledger, force), "prompts")
        stats.skipped += catalog.count() - fresh.count()
        sessions = cut(sessions.join(fresh.select(F.col("session_id").alias("id")), "id", "left_semi"), "sessions")
        stats.prompt_only = sessions.count()
        found.append((sessions, cut(messages, "messages")))
        notes.append(fresh)
    for roots, kind in ((config.plan_roots, False), (config.cursor_plan_roots, True)):
        paths = t.find_plans(roots, ending=".plan.md" if kind else None) if roots else []
        if not paths:
            continue
        read = cut(t.plans(spark, paths, kind), "plans")
        catalog = read.select(F.col("file_path").alias("path"), F.col("id").alias("session_id"), "content_hash")
        fresh = cut(changed(catalog, ledger, force), "fresh")
        new = read.join(fresh.select(F.col("path").alias("file_path")), "file_path", "left_semi")
        sessions, messages = t.plan_rows(new)
        found.append((sessions, messages))
        notes.append(fresh)
        stats.plans += fresh.count()
        stats.skipped += read.count() - fresh.count()
        if config.plan_archive:
            for row in new.select("id", "content").toLocalIterator():
                archive_plan(config.plan_archive, row["id"], row["content"].encode())
    if found:
        sessions, messages = found[0]
        for s, m in found[1:]:
            sessions, messages = sessions.unionByName(s, allowMissingColumns=True), messages.unionByName(m, allowMissingColumns=True)
        sessions = cut(sessions, "all-sessions")
        messages = cut(messages.join(sessions.select(F.col("id").alias("session_id")), "session_id", "left_semi"), "all-messages")
        counts = messages.agg(F.count("*").alias("m"), F.count_distinct("session_id").alias("s")).first()
        stats.sessions, stats.messages, stats.indexed = sessions.count(), counts["m"], counts["s"]
        if stats.messages:
            store.replace_sessions(sessions, messages)
    if notes:  # noted once, at the end: a run that breaks off is done again
        whole = notes[0]
        for n in notes[1:]:
            whole = whole.unionByName(n.select(*whole.columns))
        store.put_ledger(whole.withColumn("updated_at", F.current_timestamp()))
    stats.elapsed = time.time() - began
    return stats


def index_file(spark: SparkSession, store: Store, path: str, deep: bool = True) -> IndexStats:
    """Index one .jsonl file, whose format is detected, whether it changed or not."""
    sessions, messages = view_file(spark, path, deep)
    sessions, messages = cut(sessions, "sessions"), cut(messages, "messages")
    store.replace_sessions(sessions, messages)
    return IndexStats(sessions=sessions.count(), indexed=sessions.count(), messages=messages.count())


def view_file(spark: SparkSession, path: str, deep: bool = True) -> tuple[DataFrame, DataFrame]:
    """Session and messages of one file without storing them."""
    kind = t.detect_format(path)
    return {"claude": t.claude, "cursor": t.cursor, "codex": t.codex}[kind](spark, path, deep)
