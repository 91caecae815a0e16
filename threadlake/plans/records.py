"""Queries that run the readers, texts, vectors and condensing on the archive's raw tables, each with the SQL that says the same."""

from __future__ import annotations

from datetime import datetime, timezone

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlake.functions import text as x
from threadlake.functions.vector import cosine, normalize, squared_distance
from threadlake.operators import browse, condense, mining, retrieval
from threadlake.operators.search_language import parse, render
from threadlake.plans.archive import _COMMAND, _LINES, _NORMAL, _unit
from threadlake.session import table
from threadlake.sources import transcripts
from threadlake.sources.store import migrate

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def take(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return take


# ---- lines of transcripts, made of the raw tables ---------------------------------------------------------
def _quoted(c: Column) -> Column:
    """A text as a JSON string."""
    whole = F.to_json(F.struct(c.alias("x")))
    return F.when(c.isNull(), F.lit("null")).otherwise(F.substring(whole, F.lit(6), F.length(whole) - 6))


def _sample_lines(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "samples")
    content = F.col("message.content")
    listed = content.rlike(r"^\s*\[\s*\{") & F.try_parse_json(content).isNotNull()
    body = F.concat(F.lit('"message":{"role":'), _quoted(F.col("message.role")), F.lit(',"content":'), F.when(listed, content).otherwise(_quoted(content)), F.lit("}}"))
    rest = F.to_json(F.struct(*(c for c in rows.columns if c not in ("message", "rec_id"))))
    value = F.concat(F.substring(rest, F.lit(1), F.length(rest) - 1), F.lit(","), body)
    return rows.select(F.concat(F.lit("/srv/-srv-x/"), F.coalesce("sessionId", F.lit("")), F.lit(".jsonl")).alias("path"), F.lit("2026-01-01").cast("timestamp").alias("mtime"), F.col("rec_id").alias("line"), value.alias("value"))


_BLOCKS = """with e as (select rec_id, coalesce("sessionId", '') sid, coalesce(message.role, type) r, coalesce("isSidechain", false) side, message.content c,
  coalesce(regexp_matches(message.content, '^\\s*\\[\\s*\\{') and json_valid(message.content), false) listed from samples where type in ('user', 'assistant') and not coalesce("isMeta", false)),
u as (select *, unnest(range(json_array_length(c)::bigint)) k from e where listed),
b as (select rec_id, sid, r, side, 0 k, null::json j, c from e where not listed union all select rec_id, sid, r, side, k, c::json -> k::integer, null from u),
t as (select rec_id, sid, r, side, k, case when j ->> '$.type' in ('thinking', 'tool_use', 'tool_result', 'image') then j ->> '$.type' else 'text' end kind,
  case when j ->> '$.type' = 'tool_use' then j ->> '$.name' end tool_name,
  coalesce(case when j is null then c when j ->> '$.type' = 'text' then j ->> '$.text' when j ->> '$.type' = 'thinking' then j ->> '$.thinking'
    when j ->> '$.type' = 'tool_use' then coalesce(j ->> '$.name', '') || ' ' || coalesce((j -> '$.input')::varchar, 'null')
    when j ->> '$.type' = 'tool_result' then case when json_type(j -> '$.content') = 'ARRAY' then array_to_string(list_transform(list_filter((j -> '$.content')::json[], lambda x: x ->> '$.type' = 'text'), lambda x: coalesce(x ->> '$.text', '')), chr(10)) else j ->> '$.content' end end, '') "text"
  from b),
m as (select *, row_number() over (partition by sid order by rec_id, k) - 1 seq from t where kind <> 'image')"""


@query(f"{_BLOCKS} select sid session_id, seq, r as role, kind, tool_name, text, side is_sidechain from m")
def claude_messages(s, d):
    return transcripts.claude_lines(_sample_lines(s, d))[1].select("session_id", "seq", "role", "kind", "tool_name", "text", "is_sidechain")


_FACTS = """f as (select coalesce("sessionId", '') sid, min(try_cast(timestamp as timestamp)) a, max(try_cast(timestamp as timestamp)) z, arg_max(cwd, rec_id) filter (where cwd <> '') cwd, arg_max("gitBranch", rec_id) filter (where "gitBranch" <> '') branch,
  arg_max("customTitle", rec_id) filter (where "customTitle" <> '') custom, arg_max("aiTitle", rec_id) filter (where "aiTitle" <> '') ai, count(*) filter (where type in ('user', 'assistant') and not coalesce("isMeta", false)) envelopes from samples group by 1)"""
_TIMES = "coalesce(a, timestamp '2026-01-01') started_at, coalesce(z, timestamp '2026-01-01') ended_at"


@query(f"""{_BLOCKS}, {_FACTS}, n as (select sid, count(*) n, arg_min(text, seq) filter (where r = 'user' and kind = 'text' and not side) "text" from m group by sid),
l as (select sid, {_LINES} a from n)
select f.sid id, coalesce(custom, ai, case when length(l.a[1]) > 60 then left(l.a[1], 60) || '…' else l.a[1] end, '') title, coalesce(cwd, '//srv/x') project_path, coalesce(branch, '') git_branch, {_TIMES.replace("(a,", "(f.a,")}, coalesce(n, 0)::integer message_count
from f left join n using (sid) left join l using (sid)""")
def claude_sessions(s, d):
    return transcripts.claude_lines(_sample_lines(s, d))[0].select("id", "title", "project_path", "git_branch", "started_at", "ended_at", "message_count")


@query(f"with {_FACTS} select sid id, coalesce(custom, ai, '') title, coalesce(cwd, '//srv/x') project_path, coalesce(branch, '') git_branch, {_TIMES}, envelopes from f")
def claude_meta(s, d):
    return transcripts.claude_meta(_sample_lines(s, d))


def _rollout_lines(s: SparkSession, d: str) -> DataFrame:
    value = F.concat(F.lit('{"timestamp":'), _quoted(F.col("timestamp")), F.lit(',"type":'), _quoted(F.col("type")), F.lit(',"payload":'), F.coalesce("payload", F.lit("null")), F.lit("}"))
    return table(s, d, "envelopes").select(F.concat(F.lit("/r/"), "rollout_id", F.lit(".jsonl")).alias("path"), F.lit("2026-01-01").cast("timestamp").alias("mtime"), F.col("env_id").alias("line"), value.alias("value"))


_JOINED = "case when json_type(p -> '$.{0}') = 'ARRAY' then array_to_string(list_transform((p -> '$.{0}')::json[], lambda x: coalesce(x ->> '$.text', '')), chr(10)) else p ->> '$.{0}' end"


@query(f"""with v as (select env_id, rollout_id, type, payload::json p from (select * from envelopes where json_valid(payload)) where type is not null),
m as (select rollout_id, first(p ->> '$.id' order by env_id) id from v where type = 'session_meta' group by 1),
i as (select 'codex:' || coalesce(m.id, v.rollout_id) sid, env_id, p, p ->> '$.type' t from v left join m using (rollout_id) where type = 'response_item'),
b as (select sid, env_id, p ->> '$.call_id' call, p ->> '$.name' as name, p ->> '$.role' as role,
  case t when 'message' then 'text' when 'reasoning' then 'thinking' when 'function_call_output' then 'tool_result' else 'tool_use' end kind,
  case when t = 'message' then case when coalesce(p ->> '$.role', '') not in ('', 'system', 'developer') then {_JOINED.format("content")} end when t = 'reasoning' then coalesce(nullif(p ->> '$.text', ''), {_JOINED.format("summary")})
    when t in ('function_call', 'custom_tool_call', 'local_shell_call') then coalesce(p ->> '$.name', 'local_shell') || ' ' || coalesce(p ->> '$.arguments', p ->> '$.input', p ->> '$.command', '')
    when t = 'function_call_output' then coalesce(p ->> '$.output', '') end "text" from i),
k as (select * from b where coalesce(text, '') <> ''),
c as (select sid, call, arg_min(name, env_id) called from k where kind = 'tool_use' group by all)
select k.sid session_id, row_number() over (partition by k.sid order by env_id) - 1 seq, case kind when 'text' then role when 'tool_result' then 'user' else 'assistant' end as role, kind,
  case kind when 'tool_use' then name when 'tool_result' then called end tool_name, text from k left join c on c.sid = k.sid and c.call = k.call""")
def codex_messages(s, d):
    return transcripts.codex_lines(_rollout_lines(s, d))[1].select("session_id", "seq", "role", "kind", "tool_name", "text")


@query("""select "sessionId" session_id, row_number() over (partition by "sessionId" order by timestamp, hist_id) - 1 seq,
case when contains(display, '[Pasted text ') and cardinality("pastedContents") > 0 then array_to_string(list_transform(list_sort(map_keys("pastedContents")), lambda k: coalesce(map_extract("pastedContents", k)[1].content, '')), chr(10)) else display end "text"
from history where timestamp between 100000000000 and 99999999999999""")
def prompt_texts(s, d):
    log = table(s, d, "history").filter("timestamp between 100000000000 and 99999999999999").withColumn("place", F.col("hist_id"))
    return transcripts.number_prompts(log).select("session_id", "seq", "text")


def _plan_files(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "documents").filter("source = 'plan' and text is not null")
    return rows.select(F.concat(F.lit("/srv/p/"), "doc_id", F.lit("/PLAN.md")).alias("file_path"), F.col("created_at").alias("mod_time"), F.col("text").alias("content"))


_PLANS = """with p as (select '/srv/p/' || doc_id || '/PLAN.md' f, text c from documents where source = 'plan' and text is not null),
q as (select 'plan:' || left(sha256(f), 16) id, c, '/srv/p/' || split_part(f, '/', 4) project_path, coalesce(nullif(trim(regexp_extract(c, '(?:^|[\\r\\n\\x{85}\\x{2028}\\x{2029}])# ([^\\r\\n\\x{85}\\x{2028}\\x{2029}]+)', 1), ' '), ''), 'PLAN') title from p)"""


@query(f"{_PLANS} select id, title, project_path, 'plan' record_kind, sha256(c) content_hash, 1 messages from q")
def plan_sessions(s, d):
    read = transcripts.plan_files(_plan_files(s, d))
    sessions, messages = transcripts.plan_rows(read)
    counts = messages.groupBy("session_id").agg(F.count("*").cast("int").alias("messages"))
    return sessions.join(read.select("id", "content_hash"), "id").join(counts, F.col("id") == F.col("session_id")).select("id", "title", "project_path", "record_kind", "content_hash", "messages")


@query("""with s as (select id, title, project_path, case when starts_with(id, 'opencode:') then 'opencode' when starts_with(id, 'cursor:') or starts_with(id, 'cursor-plan:') then 'cursor' when starts_with(id, 'codex:') then 'codex' else 'claude' end vendor,
case when starts_with(id, 'plan:') or starts_with(id, 'cursor-plan:') then 'plan' else 'chat' end record_kind from sessions) select * from s""")
def migrated_sessions(s, d):
    return migrate(table(s, d, "sessions").drop("vendor", "record_kind"), "sessions").select("id", "title", "project_path", "vendor", "record_kind")


@query("""with u as (select message_rowid as rowid, model, text_hash, created_at, 0 fresh from message_vectors where message_rowid is not null union all
select message_rowid, model, 'new', timestamp '2030-01-01', 1 from message_vectors where message_rowid % 3 = 0),
r as (select *, row_number() over (partition by rowid, model order by fresh desc, created_at desc nulls last, text_hash nulls first) k from u) select rowid, model, text_hash from r where k = 1""")
def embedding_upsert(s, d):
    old = table(s, d, "message_vectors").filter("message_rowid is not null").select(F.col("message_rowid").alias("rowid"), "model", "text_hash", "created_at")
    new = old.filter("rowid % 3 = 0").withColumns({"text_hash": F.lit("new"), "created_at": F.lit("2030-01-01").cast("timestamp")})
    return retrieval.put_embeddings(old, new, ["rowid"]).select("rowid", "model", "text_hash")


# ---- hits, filters, texts ---------------------------------------------------------------------------------
@query("select id, title from sessions where vendor = 'claude' and record_kind = 'chat' and project_path = '/srv/work/kelp-kernel'")
def hit_filters(s, d):
    return browse.filter_hits(table(s, d, "sessions"), "/srv/work/kelp-kernel", "chat", "claude").select("id", "title")


@query("select m.rowid from messages m join sessions s on s.id = m.session_id where s.vendor = 'claude' and s.project_path like '/srv/%' and m.role = 'user' and m.kind in ('text', 'tool_result') and s.started_at >= timestamp '2025-10-01'")
def embed_filters(s, d):
    side = table(s, d, "sessions").filter("project_path like '/srv/%'").select(F.col("id").alias("session_id"), "vendor", "project_path", F.col("started_at").alias("timestamp"))
    rows = table(s, d, "messages").drop("timestamp").join(side, "session_id")
    return rows.filter(retrieval.matching("claude", None, datetime(2025, 10, 1, tzinfo=timezone.utc), ["user"], ["text", "tool_result"])).select("rowid")


@query(f"""with l as (select rowid, role, kind, tool_name, coalesce(array_to_string({_LINES}, chr(10)), '') c, {_COMMAND} cmd from messages where (kind = 'text' and role in ('user', 'assistant')) or (kind = 'tool_use' and tool_name = 'Bash'))
select rowid, case when kind = 'text' then case when length(case when role = 'assistant' then left(c, 2000) else c end) >= 15 then case when role = 'assistant' then left(c, 2000) else c end end else nullif(cmd, '') end embed_text from l""")
def embed_texts(s, d):
    return table(s, d, "messages").filter(retrieval.embeddable()).select("rowid", retrieval.embed_text().alias("embed_text"))


@query("select rowid, seq, role, kind from messages where session_id = '5e550000-0000-4000-a000-00000000cafe'")
def session_detail(s, d):
    return browse.session_messages(table(s, d, "messages"), "5e550000-0000-4000-a000-00000000cafe").select("rowid", "seq", "role", "kind")


@query("select id from sessions where ended_at >= timestamp '2026-02-28 22:30:00'")
def sessions_since(s, d):
    return browse.recent_sessions(table(s, d, "sessions"), 2**30, since=x.parse_since("25h30m", datetime(2026, 3, 2, tzinfo=timezone.utc))).select("id")


@query(f"with c as (select rowid, {_COMMAND} cmd from messages where kind = 'tool_use' and tool_name = 'Bash') select rowid, trim(regexp_replace(cmd, '\\s+', ' ', 'g')) in ('', 'ls', 'cat', 'pwd', 'git status') trivial from c")
def trivial_commands(s, d):
    return table(s, d, "messages").filter("kind = 'tool_use' and tool_name = 'Bash'").select("rowid", x.is_trivial_command(x.bash_command(F.col("text"))).alias("trivial"))


@query("select rowid, regexp_extract(text, '(?s)\\{.*\\}', 0) json, split_part(text, chr(10), 1) first, case when length(text) > 30 then '…' || right(text, 30) else text end tail from messages where text is not null")
def text_pieces(s, d):
    t = F.col("text")
    return table(s, d, "messages").filter("text is not null").select("rowid", x.extract_json(t).alias("json"), x.first_line(t).alias("first"), x.truncate_head(t, 30).alias("tail"))


@query("select id, case when contains(replace(project_path, '/', '-'), '-') and not regexp_full_match(replace(project_path, '/', '-'), '[0-9-]+') then '/' || replace(replace(project_path, '/', '-'), '-', '/') else replace(project_path, '/', '-') end decoded from sessions")
def decoded_projects(s, d):
    return table(s, d, "sessions").select("id", x.decode_project_dir(F.replace("project_path", F.lit("/"), F.lit("-"))).alias("decoded"))


@query("""select "sessionId" id, case when "createdAt" > 1000000000000 then make_timestamp("createdAt" * 1000) else make_timestamp("createdAt" * 1000000) end "at" from local_sessions where "createdAt" between 1000000000 and 99999999999999""")
def epoch_times(s, d):
    return table(s, d, "local_sessions").filter("createdAt between 1000000000 and 99999999999999").select(F.col("sessionId").alias("id"), x.epoch_to_timestamp(F.col("createdAt")).alias("at"))


@query("""select id, coalesce(strftime(started_at + interval 330 minute, '%Y-%m-%d %H:%M'), '') as "local", coalesce(strftime(started_at, '%Y-%m-%d %H:%M UTC'), '') as "utc", coalesce(strftime(started_at + interval 330 minute, '%Y-%m-%d'), '') as "date", '' as "off" from sessions""")
def time_displays(s, d):
    return table(s, d, "sessions").select("id", *(x.display_time(F.col("started_at"), m, "Asia/Kolkata").alias(m) for m in x.TIME_MODES))


@query("""with q as (select distinct tool_name a, kind b from messages where regexp_full_match(tool_name, '[A-Za-z]+') and kind is not null and lower(tool_name) not in ('and', 'or', 'not'))
select '(' || a || ' + ' || b || ') mine' as "query", '(' || a || ' AND ' || b || ') AND mine' compiled from q union all select a || ' -' || b || ' -mine', '(' || a || ' NOT ' || b || ') NOT mine' from q
union all select a || ' | "' || b || ' mine"', '(' || a || ' OR "' || b || ' mine")' from q""")
def query_language(s, d):
    @F.pandas_udf("string")
    def compiled(queries: pd.Series) -> pd.Series:
        return queries.map(lambda q: render(parse(q)))

    names = table(s, d, "messages").filter("tool_name rlike '^[A-Za-z]+$' and kind is not null and lower(tool_name) not in ('and', 'or', 'not')").select("tool_name", "kind").distinct()
    forms = [F.format_string(f, "tool_name", "kind") for f in ("(%s + %s) mine", "%s -%s -mine", '%s | "%s mine"')]
    return names.select(F.explode(F.array(*forms)).alias("query")).select("query", compiled("query").alias("compiled"))


# ---- vectors ----------------------------------------------------------------------------------------------
_LONG = [((i * 7) % 11 - 5) / 10 for i in range(128)]
_HALF = [((i * 5) % 13 - 6) / 10 for i in range(96)]
_L, _H = ("[" + ", ".join(f"{v}::double" for v in q) + "]" for q in (_LONG, _HALF))
_USABLE = """v as (select message_rowid as rowid, arg_max(vector, created_at) as vec from (select * from message_vectors where model = 'embed-s-96' and message_rowid is not null and dim = 96 and len(vector) = 96 and not list_bool_or(list_transform(vector, lambda e: e is null or isnan(e) or isinf(e))) and list_bool_or(list_transform(vector, lambda e: e <> 0))) group by 1)"""


def _used(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "message_vectors").filter("model = 'embed-s-96' and message_rowid is not null and dim = 96 and size(vector) = 96")
    sound = rows.filter(F.forall("vector", lambda e: F.coalesce(~F.isnan(e) & (F.abs(e) < float("inf")), F.lit(False))) & F.exists("vector", lambda e: e != 0))
    return sound.groupBy(F.col("message_rowid").alias("rowid")).agg(F.max_by("vector", "created_at").alias("vector"))


@query(f"select vec_id, round(list_sum(list_transform(list_zip(embedding, {_L}[1:64]), lambda z: (z[1]::double - z[2]) * (z[1]::double - z[2]))), 4) apart, round(list_dot_product(embedding::double[], {_L}[1:64]) / sqrt(list_dot_product(embedding::double[], embedding::double[])) / sqrt(list_dot_product({_L}, {_L})), 6) score from embeddings")
def vector_measures(s, d):
    q = F.array(*(F.lit(v) for v in _LONG))
    return table(s, d, "embeddings").select("vec_id", F.round(squared_distance(F.col("embedding"), F.slice(q, 1, 64)), 4).alias("apart"), F.round(cosine(q, F.col("embedding")), 6).alias("score"))


class _Fixed:
    """An embedder that gives one vector, so that a search can be said in SQL."""

    model = "embed-s-96"

    def embed(self, texts: list[str]) -> list[list[float]]:
        return [_HALF for _ in texts]


_HITS = f"""with {_USABLE}, c as (select rowid, session_id, seq, text, list_cosine_similarity(vec::double[], {_H}) score from v join messages using (rowid)), p as (select * from c order by round(score, 10) desc, rowid limit 48),
r as (select *, row_number() over (partition by session_id order by round(score, 10) desc, rowid) k from p)"""


def _placed(s: SparkSession, d: str) -> DataFrame:
    return _used(s, d).join(table(s, d, "messages").select("rowid", "session_id"), "rowid")


@query(f"""{_HITS}, h as (select * from r where k = 1 order by round(score, 10) desc, rowid limit 12), l as (select rowid, {_LINES} a from h)
select h.rowid, h.session_id, round(score, 6) score, left(coalesce(array_to_string(a, chr(10)), ''), 200) snippet, s.title, s.vendor from h join l using (rowid) left join sessions s on s.id = h.session_id""")
def semantic_hits(s, d):
    found = retrieval.semantic_search(_placed(s, d), table(s, d, "messages"), table(s, d, "sessions"), "anything", _Fixed())
    return found.select("rowid", "session_id", F.round("score", 6).alias("score"), "snippet", "title", "vendor")


@query(f"""{_HITS}, h as (select * from r where k <= 3 order by round(score, 10) desc, rowid limit 12), n as (select *, row_number() over (order by round(score, 10) desc, rowid) num from h),
g as (select n.num, m.seq, m.role, {_LINES.replace("(text,", "(m.text,")} a from n join messages m on m.session_id = n.session_id and m.seq between n.seq - 2 and n.seq + 2),
b as (select num, seq, role || ': ' || case when length(coalesce(array_to_string(a, chr(10)), '')) > 500 then left(array_to_string(a, chr(10)), 500) || '…' else coalesce(array_to_string(a, chr(10)), '') end line from g),
j as (select num, string_agg(line, chr(10) order by seq, line) body from b where line is not null group by num)
select n.num::integer num, n.session_id, round(score, 6) score, '[' || n.num || '] (' || coalesce(s.title, '') || ')' || chr(10) || body excerpt from n join j using (num) left join sessions s on s.id = n.session_id""")
def ask_excerpts(s, d):
    return retrieval.ask_context(_placed(s, d), table(s, d, "messages"), table(s, d, "sessions"), _HALF).select("num", "session_id", F.round("score", 6).alias("score"), "excerpt")


def _given_centers(s: SparkSession, d: str, k: int = 8) -> mining.Centers:
    """Centres that SQL can name: the unit vectors of the k smallest vec_ids."""
    rows = _unit(s, d).orderBy("vec_id").limit(k).collect()
    return mining.Centers(np.array([r["vector"] for r in rows], np.float64))


_CENTERS = """with n as (select vec_id, embedding, sqrt(list_dot_product(embedding::double[], embedding::double[])) z from embeddings), u as (select vec_id, list_transform(embedding, lambda e: (e::double / z)::float::double) u from n),
c as (select row_number() over (order by vec_id) - 1 as cluster, u as c from u order by vec_id limit 8),
a as (select vec_id, cluster, greatest(0, list_dot_product(u, u) - 2 * list_dot_product(u, c) + list_dot_product(c, c)) as distance, row_number() over (partition by vec_id order by distance, cluster) k from u, c)"""


@query(f"{_CENTERS} select vec_id, cluster::integer as cluster from a where k = 1")
def assign_to_centers(s, d):
    return mining.assign(_unit(s, d), _given_centers(s, d)).select("vec_id", F.col("cluster").cast("int").alias("cluster"))


@query(f"{_CENTERS}, t as (select vec_id, max(distance) filter (where k = 1) p, max(distance) filter (where k = 2) q from a group by 1) select round(avg(case when q > 0 then (q - p) / q else 0 end), 5) silhouette from t")
def silhouette(s, d):
    points = np.array([r["vector"] for r in _unit(s, d).select("vector").limit(mining.SAMPLE).collect()], np.float64)  # the measure is of a bounded sample
    return s.createDataFrame([(round(_given_centers(s, d).silhouette(points), 5),)], "silhouette double")


# ---- mining and condensing --------------------------------------------------------------------------------
def _latest(s: SparkSession, d: str) -> DataFrame:
    """Of rows indexed again the last."""
    rows = table(s, d, "messages")
    names = [c for c in rows.columns if c not in ("session_id", "seq")]
    return rows.groupBy("session_id", "seq").agg(F.max_by(F.struct(*names), F.struct("indexed_at", "rowid")).alias("r")).select("session_id", "seq", "r.*")


_LAST = "m as (select * from (select *, row_number() over (partition by session_id, seq order by indexed_at desc nulls last, rowid desc) latest from messages) where latest = 1)"


@query(f"""with {_LAST}, c as (select session_id, seq, {_NORMAL} command from m where kind = 'tool_use' and tool_name = 'Bash'),
w as (select session_id, command c0, seq, lead(command, 1) over w c1, lead(command, 2) over w c2, lead(command, 3) over w c3, lead(seq, 1) over w s1, lead(seq, 2) over w s2, lead(seq, 3) over w s3 from c window w as (partition by session_id order by seq)),
g as (select session_id, 2 n, c0 || ' && ' || c1 gram from w where s1 - seq <= 4 and c0 <> '' and c1 <> '' union all select session_id, 3, c0 || ' && ' || c1 || ' && ' || c2 from w where s2 - seq <= 8 and c0 <> '' and c2 <> ''
union all select session_id, 4, c0 || ' && ' || c1 || ' && ' || c2 || ' && ' || c3 from w where s3 - seq <= 12 and c0 <> '' and c3 <> '')
select gram as "name", count(distinct session_id) sessions, count(distinct session_id) * n as rank from g group by gram, n order by rank desc, gram limit 15""")
def mine_scripts(s, d):
    return mining.mine_scripts(_latest(s, d), least=1).select("name", "sessions", F.col("rank").cast("long").alias("rank"))


_SHORT = "case when length(coalesce(text, '')) > {0} then left(text, {0}) || ' …[truncated]' else coalesce(text, '') end"


@query(f"""with {_LAST}, b as (select session_id, seq, coalesce(role = 'user', false) must, '### ' || case when kind = 'tool_use' then case when coalesce(tool_name, '') <> '' then 'tool_use: ' || tool_name else 'tool_use' end when kind = 'tool_result' then 'tool_result' else coalesce(role, '') end || chr(10)
  || case when kind in ('tool_use', 'tool_result') then {_SHORT.format(400)} when role = 'user' then coalesce(array_to_string({_LINES}, chr(10)), '') when role = 'assistant' then {_SHORT.format(1500)} else coalesce(text, '') end || chr(10) || chr(10) t
  from m where kind not in ('thinking', 'image') and not coalesce(is_sidechain, false)),
h as (select id, '# ' || coalesce(title, '') || chr(10) || 'vendor: ' || coalesce(vendor, '') || chr(10) || 'project: ' || coalesce(project_path, '') || chr(10) || case when coalesce(git_branch, '') <> '' then 'branch: ' || git_branch || chr(10) else '' end
  || 'started: ' || coalesce(strftime(started_at, '%Y-%m-%dT%H:%M:%SZ'), '') || chr(10) || 'ended: ' || coalesce(strftime(ended_at, '%Y-%m-%dT%H:%M:%SZ'), '') || chr(10) || 'messages: ' || coalesce(message_count::varchar, '') || chr(10) || chr(10) header from sessions),
i as (select b.*, header, greatest(4000 - length(header), 0) room, row_number() over w - 1 i, count(*) over (partition by session_id) n, sum(length(t)) over w cs, sum(length(t)) over (partition by session_id) total from b join h on h.id = b.session_id window w as (partition by session_id order by seq)),
f as (select session_id, any_value(n) n, any_value(room) room, any_value(header) header, any_value(length(header) + total <= 4000) fits, coalesce(min(case when not must and cs > floor(room * 60 / 100) then i end), any_value(n)) front from i group by 1),
g as (select i.session_id, i.i, i.must, i.t, f.n, f.fits, case when f.fits then f.n else f.front end front, f.room - floor(f.room * 60 / 100) left_, sum(length(i.t)) over (partition by i.session_id order by i.i desc) rcs from i join f using (session_id)),
k as (select session_id, coalesce(max(case when not must and rcs > left_ and i >= front and not fits then i end) + 1, any_value(front)) back from g group by 1),
o as (select g.*, (g.i >= front and g.i < back and not must) out, min(case when g.i >= front and g.i < back and not must then g.i end) over (partition by g.session_id) first, count(*) filter (where g.i >= front and g.i < back and not must) over (partition by g.session_id) omitted from g join k using (session_id))
select session_id, any_value(h.header) || string_agg(case when out then case when i = first then chr(10) || '[... ' || omitted || ' blocks omitted ...]' || chr(10) else '' end else t end, '' order by i) "text", any_value(omitted) > 0 truncated, (any_value(n) - any_value(omitted))::integer kept, any_value(omitted)::integer omitted
from o join h on h.id = o.session_id group by session_id""")
def condensed_texts(s, d):
    return condense.condense(table(s, d, "sessions"), _latest(s, d), budget=4000)
