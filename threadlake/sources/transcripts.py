"""Transcript readers: four line formats, desktop metadata and an embedded database, to sessions and messages.

Files are read whole, so that the order of lines is theirs, and split into lines and blocks by Spark. Every
reader gives blocks(session_id, file_rank, line, block, ...); number_blocks() turns them into messages whose seq
counts the kept blocks of a session over its main and side files. Lines that can't be parsed are skipped.
"""

from __future__ import annotations

import json
import os
import sqlite3

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadlake.functions.text import PAYLOAD_CAP, decode_project_dir, derive_title, epoch_to_timestamp, should_index, shrink
from threadlake.operators.hierarchy import hierarchy

_BLOCK = "array<struct<type string, text string, thinking string, name string, input string, id string, tool_use_id string, content string, is_error boolean, source string>>"
_ENVELOPE = "type string, sessionId string, uuid string, parentUuid string, timestamp string, cwd string, gitBranch string, isSidechain boolean, isMeta boolean, aiTitle string, customTitle string, message struct<role: string, content: string>, role string"
_NAMELESS = "type string, text string, thinking string, name string, input string, content string"


def read_lines(spark: SparkSession, paths: str | list[str], pattern: str | None = None) -> DataFrame:
    """(path, mtime, line, value) of the lines of whole files, blank ones left out; line counts from 0."""
    reader = spark.read.format("text").option("wholetext", True).option("recursiveFileLookup", True)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    files = reader.load(paths).select(F.regexp_replace("_metadata.file_path", "^file:/*", "/").alias("path"), F.col("_metadata.file_modification_time").alias("mtime"), "value")
    lines = files.select("path", "mtime", F.posexplode(F.split("value", "\r?\n")).alias("line", "value"))
    return lines.filter(F.trim("value") != "")


def set_time(at: Column) -> Column:
    """A time of year 1 or before means an unset one: null."""
    return F.when(F.year(at) > 1, at)


def _shape(value: Column, path: str) -> Column:
    """STRING, ARRAY<...>, OBJECT<...> or null: what stands at a path, which from_json can't tell."""
    return F.schema_of_variant(F.try_variant_get(F.try_parse_json(value), path, "variant"))


def _texts(content: Column, only: str | None = "text") -> Column:
    """A content of text or blocks as one text; what can't be parsed stays as it is."""
    parts = F.from_json(content, "array<struct<type string, text string>>")
    kept = F.filter(parts, lambda b: b["type"] == only) if only else parts
    return F.when(content.rlike(r"^\s*\[") & parts.isNotNull(), F.array_join(F.transform(kept, lambda b: F.coalesce(b["text"], F.lit(""))), "\n")).otherwise(content)


def _compact(value: Column) -> Column:
    return F.coalesce(value, F.lit("null"))


def _envelope_blocks(envelopes: DataFrame) -> DataFrame:
    """One row per block of envelopes(..., shape, content): kind, tool_name, text."""
    listed = F.when(F.col("shape").startswith("ARRAY"), F.from_json("content", _BLOCK)).otherwise(
        F.array(F.struct(F.lit("text").alias("type"), F.col("content").alias("text"), *(F.lit(None).cast("string").alias(n) for n in ("thinking", "name", "input", "id", "tool_use_id", "content")), F.lit(None).cast("boolean").alias("is_error"), F.lit(None).cast("string").alias("source")))
    )
    blocks = envelopes.select("*", F.posexplode(listed).alias("block", "b"))
    kind = F.when(F.col("b.type").isin("thinking", "tool_use", "tool_result", "image"), F.col("b.type")).otherwise("text")
    text = (
        F.when(F.col("b.type") == "text", F.col("b.text"))
        .when(F.col("b.type") == "thinking", F.col("b.thinking"))
        .when(F.col("b.type") == "tool_use", F.concat(F.coalesce("b.name", F.lit("")), F.lit(" "), _compact(F.col("b.input"))))
        .when(F.col("b.type") == "tool_result", _texts(F.col("b.content")))
    )
    return blocks.withColumn("kind", kind).withColumn("tool_name", F.when(F.col("b.type") == "tool_use", F.col("b.name"))).withColumn("text", F.coalesce(text, F.lit(""))).drop("b", "content", "shape")


def number_blocks(blocks: DataFrame, deep: bool = True, cap: int = PAYLOAD_CAP, drop_images: bool = True) -> DataFrame:
    """Messages of blocks(session_id, file_rank, line, block, uuid, ..., text): filtered, shortened and numbered by session."""
    kept = blocks.filter(should_index(F.col("role"), F.col("kind"), deep))
    if drop_images:
        kept = kept.filter(F.col("kind") != "image")
    order = Window.partitionBy("session_id").orderBy("file_rank", "line", "block")
    numbered = kept.withColumn("seq", (F.row_number().over(order) - 1).cast("long")).withColumn("text", shrink(F.col("kind"), F.col("text"), cap))
    return numbered.select("uuid", "parent_uuid", "session_id", "role", "kind", "tool_name", F.lit("transcript").alias("source"), "timestamp", "seq", "is_sidechain", "text")


def _stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)\.jsonl$", 1)


def claude(spark: SparkSession, root: str, deep: bool = True) -> tuple[DataFrame, DataFrame]:
    """Sessions and messages of <root>/<project>/<id>.jsonl with side files in <id>/subagents or subagents/agent-*.jsonl.

    The session is told by the file, not by the envelope. Title: the last custom title, else the last generated one,
    else from the first user text. Times fall back to the file's, the project to its folder.
    """
    return claude_lines(read_lines(spark, root, "*.jsonl"), deep)


def _claude_facts(main: DataFrame) -> DataFrame:
    last = lambda c: F.max_by(c, F.when(F.coalesce(c, F.lit("")) != "", F.col("line")))
    return main.groupBy("session_id").agg(
        F.min("at").alias("first"), F.max("at").alias("latest"), last(F.col("e.cwd")).alias("cwd"), last(F.col("e.gitBranch")).alias("git_branch"), last(F.col("e.customTitle")).alias("custom"), last(F.col("e.aiTitle")).alias("ai"), F.max("mtime").alias("mtime"), F.first("path").alias("file_path")
    )


def _claude_project() -> Column:
    return F.coalesce(F.nullif("cwd", F.lit("")), decode_project_dir(F.regexp_extract("file_path", r"/([^/]+)/[^/]+$", 1)))


def claude_meta(lines: DataFrame) -> DataFrame:
    """(id, title, project_path, git_branch, started_at, ended_at, envelopes) of main files' lines, without looking into messages; a title only where one was given."""
    read = lines.filter(~F.col("path").contains("/subagents/")).select("path", "mtime", "line", _stem(F.col("path")).alias("session_id"), F.from_json("value", _ENVELOPE).alias("e")).filter(F.col("e").isNotNull()).withColumn("at", set_time(F.try_to_timestamp("e.timestamp")))
    counts = read.groupBy("session_id").agg(F.count_if(F.col("e.type").isin("user", "assistant") & ~F.coalesce("e.isMeta", F.lit(False))).alias("envelopes"))
    facts = _claude_facts(read).join(counts, "session_id")
    blank = lambda c: F.nullif(F.col(c), F.lit(""))
    return facts.select(F.col("session_id").alias("id"), F.coalesce(blank("custom"), blank("ai"), F.lit("")).alias("title"), _claude_project().alias("project_path"), F.coalesce("git_branch", F.lit("")).alias("git_branch"), F.coalesce("first", "mtime").alias("started_at"), F.coalesce("latest", "mtime").alias("ended_at"), "envelopes")


def claude_lines(lines: DataFrame, deep: bool = True) -> tuple[DataFrame, DataFrame]:
    """claude() of lines(path, mtime, line, value)."""
    side = F.col("path").contains("/subagents/")
    owner = F.when(side, F.coalesce(F.nullif(F.regexp_extract("path", r"/([^/]+)/subagents/", 1), F.lit("")), F.lit(""))).otherwise(_stem(F.col("path")))
    read = lines.select("path", "mtime", "line", side.alias("side"), owner.alias("session_id"), F.from_json("value", _ENVELOPE).alias("e"), _shape(F.col("value"), "$.message.content").alias("shape"))
    read = read.filter(F.col("e").isNotNull()).withColumn("at", set_time(F.try_to_timestamp("e.timestamp")))
    talk = read.filter(F.col("e.type").isin("user", "assistant") & ~F.coalesce("e.isMeta", F.lit(False)))
    files = Window.partitionBy("session_id").orderBy("side", "path")
    envelopes = talk.select(
        "session_id", F.dense_rank().over(files).alias("file_rank"), "line", "shape", F.col("e.uuid").alias("uuid"), F.col("e.parentUuid").alias("parent_uuid"),
        F.coalesce("e.message.role", "e.type").alias("role"), F.coalesce("at", "mtime").alias("timestamp"), (F.col("side") | F.coalesce("e.isSidechain", F.lit(False))).alias("is_sidechain"), F.col("e.message.content").alias("content"),
    )
    messages = number_blocks(_envelope_blocks(envelopes), deep)
    main = read.filter(~F.col("side"))
    return _sessions(_claude_facts(main), messages, "claude", _claude_project()), messages


def _sessions(facts: DataFrame, messages: DataFrame, vendor: str, project: Column) -> DataFrame:
    counts = messages.groupBy("session_id").agg(F.count("*").cast("int").alias("message_count"), F.min_by("text", F.when((F.col("role") == "user") & (F.col("kind") == "text") & ~F.col("is_sidechain"), F.col("seq"))).alias("said"))
    whole = facts.join(counts, "session_id", "left")
    blank = lambda c: F.nullif(F.col(c), F.lit(""))
    titles = [blank(c) for c in ("custom", "ai", "title") if c in facts.columns]
    return whole.select(
        F.col("session_id").alias("id"), F.coalesce(*titles, derive_title(F.col("said"))).alias("title"), project.alias("project_path"), F.coalesce("git_branch", F.lit("")).alias("git_branch"),
        F.coalesce("first", "mtime").alias("started_at"), F.coalesce("latest", "mtime").alias("ended_at"), F.coalesce("message_count", F.lit(0)).alias("message_count"), "file_path", F.lit(True).alias("has_transcript"), F.lit("chat").alias("record_kind"), F.lit(vendor).alias("vendor"),
    )


def desktop(spark: SparkSession, root: str, transcripts: DataFrame) -> DataFrame:
    """Sessions of desktop metadata (local_*.json) laid over the transcripts they are linked to; without a link they are dropped."""
    schema = "sessionId string, cliSessionId string, cwd string, originCwd string, title string, createdAt long, lastActivityAt long"
    rows = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "local_*.json").json(root)
    return link_desktop(rows, transcripts)


def link_desktop(rows: DataFrame, transcripts: DataFrame) -> DataFrame:
    linked = rows.filter(F.coalesce("cliSessionId", F.lit("")) != "")
    last = Window.partitionBy("cliSessionId").orderBy(F.desc(F.coalesce("lastActivityAt", F.lit(0))), "sessionId")
    one = linked.withColumn("_r", F.row_number().over(last)).filter("_r = 1").select(
        F.col("cliSessionId").alias("id"), F.nullif("title", F.lit("")).alias("_t"), F.coalesce(F.nullif("cwd", F.lit("")), F.nullif("originCwd", F.lit(""))).alias("_p"), epoch_to_timestamp(F.col("createdAt")).alias("_s"), epoch_to_timestamp(F.col("lastActivityAt")).alias("_e")
    )
    both = transcripts.join(one, "id")
    laid = both.withColumns({"title": F.coalesce("_t", "title"), "project_path": F.coalesce("_p", "project_path"), "started_at": F.coalesce("_s", "started_at"), "ended_at": F.coalesce("_e", "ended_at"), "vendor": F.lit("claude-desktop")})
    return laid.drop("_t", "_p", "_s", "_e")


def cursor(spark: SparkSession, root: str, deep: bool = True) -> tuple[DataFrame, DataFrame]:
    """<root>/<project>/agent-transcripts/<chat>/<chat>.jsonl and subagents; lines without times, which get the file's plus a second a line."""
    return cursor_lines(read_lines(spark, root, "*.jsonl"), deep)


def cursor_lines(lines: DataFrame, deep: bool = True) -> tuple[DataFrame, DataFrame]:
    """cursor() of lines(path, mtime, line, value)."""
    lines = lines.filter(F.col("path").contains("/agent-transcripts/"))
    chat = F.regexp_extract("path", r"/agent-transcripts/([^/]+)/", 1)
    read = lines.select("path", "mtime", "line", F.col("path").contains("/subagents/").alias("is_sidechain"), F.concat(F.lit("cursor:"), chat).alias("session_id"), F.from_json("value", _ENVELOPE).alias("e"), _shape(F.col("value"), "$.message.content").alias("shape"))
    read = read.filter(F.col("e.message").isNotNull())
    files = Window.partitionBy("session_id").orderBy("is_sidechain", "path")
    envelopes = read.select("session_id", F.dense_rank().over(files).alias("file_rank"), "line", "shape", F.lit(None).cast("string").alias("parent_uuid"), F.coalesce("e.role", "e.message.role").alias("role"), (F.col("mtime") + F.make_dt_interval(secs=F.col("line"))).alias("timestamp"), "is_sidechain", F.col("e.message.content").alias("content"))
    blocks = _envelope_blocks(envelopes).withColumn("uuid", F.concat_ws("-", "session_id", "line", "block"))
    messages = number_blocks(blocks, deep)
    facts = read.filter(~F.col("is_sidechain")).groupBy("session_id").agg(F.min("mtime").alias("first"), F.max("mtime").alias("latest"), F.max("mtime").alias("mtime"), F.first("path").alias("file_path"), F.lit("").alias("git_branch"))
    return _sessions(facts, messages, "cursor", decode_project_dir(F.regexp_extract("file_path", r"/([^/]+)/agent-transcripts/", 1))), messages


_ITEM = "type string, role string, content string, summary string, text string, call_id string, name string, arguments string, input string, output string, command string, id string, cwd string, git struct<branch: string, sha: string>"


def codex_items(items: DataFrame) -> DataFrame:
    """Blocks of items(session_id, line, timestamp, p): texts, reasoning, calls and their outputs, which take the call's tool name."""
    kind_of = F.col("p.type")
    text = (
        F.when((kind_of == "message") & ~F.coalesce("p.role", F.lit("")).isin("", "system", "developer"), _texts(F.col("p.content"), None))
        .when(kind_of == "reasoning", F.coalesce(F.nullif("p.text", F.lit("")), _texts(F.col("p.summary"), None)))
        .when(kind_of.isin("function_call", "custom_tool_call", "local_shell_call"), F.concat_ws(" ", F.coalesce("p.name", F.lit("local_shell")), F.coalesce("p.arguments", "p.input", "p.command", F.lit(""))))
        .when(kind_of == "function_call_output", F.coalesce("p.output", F.lit("")))
    )
    kind = F.when(kind_of == "message", "text").when(kind_of == "reasoning", "thinking").when(kind_of == "function_call_output", "tool_result").otherwise("tool_use")
    rows = items.withColumn("text", text).withColumn("kind", kind).filter(F.coalesce("text", F.lit("")) != "")
    calls = rows.filter("kind = 'tool_use'").groupBy("session_id", F.col("p.call_id").alias("call")).agg(F.min_by("p.name", "line").alias("called"))
    named = rows.withColumn("call", F.col("p.call_id")).join(calls, ["session_id", "call"], "left")
    tool = F.when(F.col("kind") == "tool_use", F.col("p.name")).when(F.col("kind") == "tool_result", F.col("called"))
    role = F.when(F.col("kind") == "text", F.col("p.role")).when(F.col("kind") == "tool_result", "user").otherwise("assistant")
    return named.select("session_id", F.lit(0).alias("file_rank"), "line", F.lit(0).alias("block"), F.concat_ws("-", "session_id", "line").alias("uuid"), F.lit(None).cast("string").alias("parent_uuid"), role.alias("role"), "kind", tool.alias("tool_name"), "timestamp", F.lit(False).alias("is_sidechain"), "text")


def codex(spark: SparkSession, root: str, deep: bool = True) -> tuple[DataFrame, DataFrame]:
    """Rollouts (rollout-*.jsonl): the session is named by the first session_meta line; only response items give messages."""
    return codex_lines(read_lines(spark, root, "rollout-*.jsonl"), deep)


def codex_lines(lines: DataFrame, deep: bool = True) -> tuple[DataFrame, DataFrame]:
    """codex() of lines(path, mtime, line, value)."""
    read = lines.select("path", "mtime", "line", F.from_json("value", "timestamp string, type string, payload string").alias("e")).filter(F.col("e.type").isNotNull())
    read = read.select("path", "mtime", "line", "e.timestamp", "e.type", F.from_json("e.payload", _ITEM).alias("p"))
    meta = read.filter("type = 'session_meta'").groupBy("path").agg(F.min_by("p", "line").alias("m"))
    whole = read.join(meta, "path", "left").withColumn("session_id", F.concat(F.lit("codex:"), F.coalesce("m.id", F.regexp_extract("path", r"([^/]+)\.jsonl$", 1))))
    number = F.col("timestamp").try_cast("long")
    at = F.coalesce(set_time(F.try_to_timestamp("timestamp")), F.when(number.isNotNull(), epoch_to_timestamp(number)), F.col("mtime") + F.make_dt_interval(secs=F.col("line")))
    items = whole.filter("type = 'response_item'").select("session_id", "line", at.alias("timestamp"), "p")
    messages = number_blocks(codex_items(items), deep)
    facts = whole.groupBy("session_id").agg(F.min("mtime").alias("first"), F.max("mtime").alias("latest"), F.max("mtime").alias("mtime"), F.first("path").alias("file_path"), F.max("m.git.branch").alias("git_branch"), F.max("m.cwd").alias("cwd"))
    return _sessions(facts, messages, "codex", F.coalesce("cwd", F.lit(""))), messages


def opencode_parts(parts: DataFrame) -> DataFrame:
    """Blocks of parts(session_id, file_rank, line, uuid, role, timestamp, is_sidechain, data): texts, reasoning, tool uses and results, patches, files."""
    d = F.from_json("data", "type string, text string, tool string, callID string, state struct<input: string, output: string, metadata: struct<output: string>>, files array<string>, filename string, url string").alias("d")
    rows = parts.select("*", d)
    one = lambda kind, role, tool, text, suffix: F.struct(F.lit(kind).alias("kind"), role.alias("role"), tool.alias("tool_name"), text.alias("text"), F.concat("uuid", F.lit(suffix)).alias("uuid"))
    none, role, assistant = F.lit(None).cast("string"), F.col("role"), F.lit("assistant")
    output = F.coalesce(F.nullif("d.state.output", F.lit("")), F.col("d.state.metadata.output"), F.lit(""))
    use = one("tool_use", assistant, F.col("d.tool"), F.concat_ws(" ", "d.tool", F.coalesce("d.state.input", F.lit(""))), "-use")
    result = one("tool_result", F.lit("user"), F.col("d.tool"), output, "-result")
    blocks = (
        F.when(F.col("d.type") == "text", F.array(one("text", role, none, F.coalesce("d.text", F.lit("")), "")))
        .when(F.col("d.type") == "reasoning", F.array(one("thinking", assistant, none, F.coalesce("d.text", F.lit("")), "")))
        .when(F.col("d.type") == "tool", F.when(output != "", F.array(use, result)).otherwise(F.array(use)))
        .when(F.col("d.type") == "patch", F.array(one("text", role, none, F.array_join(F.coalesce("d.files", F.array().cast("array<string>")), "\n"), "")))
        .when(F.col("d.type") == "file", F.array(one("text", role, none, F.coalesce(F.nullif("d.filename", F.lit("")), F.col("d.url"), F.lit("")), "")))
    )
    split = rows.select("session_id", "file_rank", "line", "timestamp", "is_sidechain", F.posexplode(blocks).alias("block", "b"))
    return split.select("session_id", "file_rank", "line", "block", "b.uuid", F.lit(None).cast("string").alias("parent_uuid"), "b.role", "b.kind", "b.tool_name", "timestamp", "is_sidechain", "b.text")


def opencode(spark: SparkSession, path: str, deep: bool = True) -> tuple[DataFrame, DataFrame]:
    """Root sessions of an embedded database file, opened read-only; child sessions become side chains of their root."""
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
        ask = lambda sql: db.execute(sql).fetchall()
        session_rows = ask("select id, parent_id, directory, title, time_created, time_updated from session")
        message_rows = ask("select id, session_id, time_created, data from message")
        part_rows = ask("select id, message_id, session_id, time_created, data from part")
    sessions = spark.createDataFrame(session_rows, "id string, parent string, directory string, title string, created long, updated long")
    said = spark.createDataFrame(message_rows, "message_id string, sid string, m_created long, m_data string")
    parts = spark.createDataFrame(part_rows, "uuid string, message_id string, p_sid string, p_created long, data string")
    # children of any depth are followed to their root; keys are compared as they are, so not in lower case
    places = hierarchy(sessions.select(F.hex("id").alias("sid"), F.hex("parent").alias("up")), "sid", "up", positions=False)
    names = sessions.select("id", "created", F.lower(F.hex("id")).alias("key"))
    tops = names.select(F.col("key").alias("top"), F.col("id").alias("top_id"))
    roots = places.join(names, "key").join(tops, "top").select(F.col("id").alias("sid"), F.col("top_id").alias("top"), "created", (F.col("depth") > 0).alias("is_sidechain"))
    whole = parts.join(said, "message_id").join(roots, "sid")
    order = Window.partitionBy("sid").orderBy("m_created", "message_id", "p_created", "uuid")
    rows = whole.select(
        F.concat(F.lit("opencode:"), "top").alias("session_id"), F.struct("is_sidechain", "created", "sid").alias("file_rank"), F.row_number().over(order).alias("line"), "uuid",
        F.coalesce(F.get_json_object("m_data", "$.role"), F.lit("assistant")).alias("role"), F.timestamp_millis(F.col("p_created")).alias("timestamp"), "is_sidechain", "data",
    )
    messages = number_blocks(opencode_parts(rows), deep)
    top = sessions.filter("parent is null").select(F.concat(F.lit("opencode:"), "id").alias("session_id"), "title", F.timestamp_millis(F.col("created")).alias("first"), F.timestamp_millis(F.col("updated")).alias("latest"), F.col("directory").alias("cwd"), F.lit("").alias("git_branch"), F.lit(path).alias("file_path"))
    return _sessions(top.withColumn("mtime", F.col("latest")), messages, "opencode", F.coalesce("cwd", F.lit(""))), messages


def prompts(spark: SparkSession, path: str) -> DataFrame:
    """The prompt log as (session_id, project, text, timestamp, seq); a missing file gives no rows."""
    schema = "display string, pastedContents map<string, struct<id: string, type: string, content: string>>, timestamp long, project string, sessionId string"
    if not os.path.exists(path):
        return number_prompts(spark.createDataFrame([], schema + ", place long"))
    rows = read_lines(spark, path).select(F.from_json("value", schema).alias("e"), F.col("line").cast("long").alias("place")).filter(F.col("e.sessionId").isNotNull())
    return number_prompts(rows.select("e.*", "place"))


def number_prompts(log: DataFrame) -> DataFrame:
    """Prompts of log(display, pastedContents, timestamp, project, sessionId, place): pasted texts put in, numbered by session and time."""
    pasted = F.array_join(F.transform(F.array_sort(F.map_entries("pastedContents")), lambda e: F.coalesce(e["value"]["content"], F.lit(""))), "\n")
    text = F.when(F.col("display").contains("[Pasted text ") & (F.size(F.coalesce("pastedContents", F.create_map().cast("map<string,struct<id:string,type:string,content:string>>"))) > 0), pasted).otherwise(F.col("display"))
    order = Window.partitionBy("session_id").orderBy("timestamp", "place")
    rows = log.select(F.col("sessionId").alias("session_id"), "project", text.alias("text"), F.timestamp_millis(F.col("timestamp")).alias("timestamp"), "place")
    return rows.withColumn("seq", (F.row_number().over(order) - 1).cast("long")).drop("place")


PLAN_NAMES = ("PLAN.md", "PROGRESS.md")


def find_plans(roots: list[str], names: tuple[str, ...] = PLAN_NAMES, ending: str | None = None) -> list[str]:
    """Paths of plan files below the roots, in any case, sorted, without backups (*.original.md); hidden folders too."""
    wanted = {n.lower() for n in names}
    found = set()
    for root in roots:
        for folder, _, files in os.walk(os.path.expanduser(root)):
            for f in files:
                low = f.lower()
                if not low.endswith(".original.md") and (low.endswith(ending) if ending else low in wanted):
                    found.add(os.path.realpath(os.path.join(folder, f)))
    return sorted(found)


def plans(spark: SparkSession, paths: list[str], cursor_plans: bool = False, titles: dict[str, str] | None = None) -> DataFrame:
    """(id, title, project_path, file_path, content, mod_time, vendor, content_hash) of plan files.

    Title: given, else the front matter's name (cursor plans), else the first heading, else the file's name.
    """
    schema = "id string, title string, project_path string, file_path string, content string, mod_time timestamp, vendor string, content_hash string"
    if not paths:
        return spark.createDataFrame([], schema)
    files = spark.read.format("text").option("wholetext", True).load(paths).select(F.regexp_replace("_metadata.file_path", "^file:/*", "/").alias("file_path"), F.col("_metadata.file_modification_time").alias("mod_time"), F.col("value").alias("content"))
    return plan_files(files, cursor_plans, titles)


def plan_files(files: DataFrame, cursor_plans: bool = False, titles: dict[str, str] | None = None) -> DataFrame:
    """plans() of files(file_path, mod_time, content)."""
    given = F.lit(None).cast("string")
    for path, title in (titles or {}).items():
        given = F.when(F.col("file_path") == path, title).otherwise(given)
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    front = blank(F.regexp_extract("content", r"(?s)\A---\n.*?^name:\s*[\"']?([^\"'\n]+)".replace("^name", "(?m:^)name"), 1)) if cursor_plans else F.lit(None).cast("string")
    heading = blank(F.regexp_extract("content", r"(?m)^# (.+)$", 1))
    prefix = "cursor-plan:" if cursor_plans else "plan:"
    return files.select(
        F.concat(F.lit(prefix), F.substring(F.sha2("file_path", 256), 1, 16)).alias("id"), F.coalesce(given, front, heading, F.regexp_extract("file_path", r"([^/]+?)(?:\.plan)?\.md$", 1)).alias("title"), F.regexp_extract("file_path", r"^(.*)/[^/]+$", 1).alias("project_path"),
        "file_path", "content", "mod_time", F.lit("cursor" if cursor_plans else "claude").alias("vendor"), F.sha2("content", 256).alias("content_hash"),
    )


def plan_rows(plans_: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Plans as sessions of kind plan with one message each."""
    sessions = plans_.select("id", "title", "project_path", F.lit("").alias("git_branch"), F.col("mod_time").alias("started_at"), F.col("mod_time").alias("ended_at"), F.lit(1).alias("message_count"), "file_path", F.lit(False).alias("has_transcript"), F.lit("plan").alias("record_kind"), "vendor")
    messages = plans_.select(
        F.concat("id", F.lit("-content")).alias("uuid"), F.lit(None).cast("string").alias("parent_uuid"), F.col("id").alias("session_id"), F.lit("assistant").alias("role"), F.lit("text").alias("kind"), F.lit(None).cast("string").alias("tool_name"), F.lit("plan").alias("source"), F.col("mod_time").alias("timestamp"), F.lit(0).cast("long").alias("seq"), F.lit(False).alias("is_sidechain"), F.col("content").alias("text")
    )
    return sessions, messages


def prompt_rows(log: DataFrame, transcripts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sessions and messages of prompts whose session has no transcript."""
    alone = log.join(transcripts.select(F.col("id").alias("session_id")), "session_id", "left_anti")
    sessions = alone.groupBy(F.col("session_id").alias("id")).agg(
        F.min_by(derive_title(F.col("text")), "seq").alias("title"), F.min_by("project", "seq").alias("project_path"), F.lit("").alias("git_branch"), F.min("timestamp").alias("started_at"), F.max("timestamp").alias("ended_at"), F.count("*").cast("int").alias("message_count"), F.lit("").alias("file_path"), F.lit(False).alias("has_transcript"), F.lit("chat").alias("record_kind"), F.lit("claude").alias("vendor")
    )
    messages = alone.select(
        F.concat_ws("-", "session_id", F.lit("prompt"), "seq").alias("uuid"), F.lit(None).cast("string").alias("parent_uuid"), "session_id", F.lit("user").alias("role"), F.lit("text").alias("kind"), F.lit(None).cast("string").alias("tool_name"), F.lit("history").alias("source"), "timestamp", "seq", F.lit(False).alias("is_sidechain"), "text"
    )
    return sessions, messages


def detect_format(path: str) -> str:
    """claude, cursor or codex, by the first line of a .jsonl file that can be parsed; ValueError for anything else."""
    if not path.endswith(".jsonl") or os.path.isdir(path):
        raise ValueError(f"not a .jsonl file: {path}")
    with open(path, encoding="utf-8", errors="replace") as lines:
        for line in lines:
            try:
                e = json.loads(line)
            except ValueError:
                continue
            if not isinstance(e, dict):
                continue
            if e.get("type") in {"session_meta", "response_item", "event_msg", "turn_context", "compacted"}:
                return "codex"
            if e.get("sessionId") or e.get("type"):
                return "claude"
            if e.get("role") and e.get("message"):
                return "cursor"
    raise ValueError(f"no known format: {path}")
