"""Queries of the engine's operators over the archive's tables, each with the SQL that says the same."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pyspark.sql.window import Window

from threadlake.functions import text as x
from threadlake.functions.vector import cosine, norm, normalize
from threadlake.operators import browse, condense, fulltext, mining, retrieval
from threadlake.schemas import coerce_kind, coerce_vendor, vendor_from_id
from threadlake.session import scratch_dir, table
from threadlake.sources import transcripts
from threadlake.sources.store import changed, upsert

QUERIES: dict = {}
SQL: dict[str, str] = {}
T0 = "2026-03-01"


def query(sql: str | None = None):
    def take(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return take


def _messages(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "messages")


def _sessions(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "sessions")


# ---- full-text search -------------------------------------------------------------------------------------
# kana with voicing marks are letters of their own, which strip_accents doesn't know
_TOKENS = "list_transform(regexp_extract_all(lower(regexp_replace(coalesce(text, ''), '\\p{Mn}', '', 'g')), '[\\p{L}\\p{N}]+'), lambda w: case when regexp_matches(w, '[\\x{3040}-\\x{30FF}]') then w else strip_accents(w) end)"
_TOK = f"with t as (select rowid, session_id, indexed_at, {_TOKENS} tk from messages)"


def _count(term: str) -> str:
    return f"len(list_filter(tk, lambda x: x = '{term}'))"


def _found(s: SparkSession, d: str, text: str, fuzzy: bool = False) -> DataFrame:
    return fulltext.score_matches(_messages(s, d), text, fuzzy).select("rowid")


@query(f"{_TOK} select rowid from t where list_contains(tk, 'checkpoint') and list_contains(tk, 'timeout')")
def search_and(s, d):
    return _found(s, d, "checkpoint timeout")


@query(f"{_TOK} select rowid from t where list_contains(tk, 'checkpoint') or list_contains(tk, 'naive')")
def search_or(s, d):
    return _found(s, d, "checkpoint | naïve")


@query(f"{_TOK} select rowid from t where list_contains(tk, 'registry') and not list_contains(tk, 'rows') and not list_contains(tk, 'line')")
def search_not(s, d):
    return _found(s, d, "registry -rows -line")


@query(f"{_TOK} select rowid from t where list_contains(list_transform(range(1, len(tk)), lambda i: tk[i] || ' ' || tk[i + 1]), 'connection reset')")
def search_phrase(s, d):
    return _found(s, d, '"connection reset"')


@query(f"{_TOK} select rowid from t where len(list_filter(tk, lambda x: starts_with(x, 'uploa'))) > 0 and list_contains(tk, 'line')")
def search_prefix(s, d):
    from threadlake.operators.search_language import And, Term

    tree = And((Term("uploa", prefix=True), Term("line")))
    toks = fulltext.tokens(F.col("text"))
    rows = _messages(s, d).withColumn("_t", toks)
    return rows.filter(reduce(lambda a, b: a & b, (fulltext._count(t, F.col("_t")) > 0 for t in tree.parts))).select("rowid")




_NEAR_LEAS = ", ".join(repr(v) for v in ["eas", "las", "les", "lea"] + [c + "eas" for c in "abcdefghijkmno"])


@query(f"{_TOK} select rowid from t where len(list_filter(tk, lambda x: starts_with(x, 'leas') or x in ({_NEAR_LEAS}))) > 0")
def search_fuzzy(s, d):
    return _found(s, d, "leas~")


def _bm25(terms: list[str], owner: str = "") -> str:
    df = ", ".join(f"sum(case when {_count(t)} > 0 then 1 else 0 end)::double df{i}" for i, t in enumerate(terms))
    idf = lambda i: f"(case when ln((n - df{i} + 0.5) / (df{i} + 0.5)) <= 0 then 1e-6 else ln((n - df{i} + 0.5) / (df{i} + 0.5)) end)"
    part = lambda i, t: f"{idf(i)} * {_count(t)} * 2.2 / ({_count(t)} + 1.2 * (0.25 + 0.75 * len(tk) / (total / n)))"
    return f"{_TOK}, st as (select count(*)::double n, sum(len(tk))::double total, {df} from t), h as (select rowid, session_id, -({' + '.join(part(i, t) for i, t in enumerate(terms))}) score from t, st where {' and '.join(f'{_count(t)} > 0' for t in terms)})"


def _index(s: SparkSession, d: str) -> str:
    """The inverted table of messages, in the shared folder; an engine keeps it beside its tables."""
    path = f"{scratch_dir(s)}/threadlake-index-{uuid.uuid4().hex}"
    fulltext.build_index(_messages(s, d), "rowid", path)
    return path


@query(_bm25(["stale", "lease"]) + " select rowid, round(score, 6) score from h order by round(score, 9), rowid limit 20")
def search_indexed_topk(s, d):
    hits = fulltext.score_indexed(s, _index(s, d), "rowid", "stale lease")
    return hits.orderBy(F.round("score", 9), "rowid").limit(20).select("rowid", F.round("score", 6).alias("score"))


@query(f"{_TOK} select rowid from t where list_contains(list_transform(range(1, len(tk)), lambda i: tk[i] || ' ' || tk[i + 1]), 'connection reset') and not list_contains(tk, 'line')")
def search_indexed_phrase(s, d):
    return fulltext.score_indexed(s, _index(s, d), "rowid", '"connection reset" -line').select("rowid")


@query(_bm25(["stale", "lease"]) + " select rowid, round(score, 6) score from h order by round(score, 9), rowid limit 20")
def search_bm25_topk(s, d):
    hits = fulltext.score_matches(_messages(s, d), "stale lease").select("rowid", "score")
    return hits.orderBy(F.round("score", 9), "rowid").limit(20).select("rowid", F.round("score", 6).alias("score"))


@query(
    _bm25(["checkpoint"])
    + ", b as (select *, row_number() over (partition by session_id order by round(score, 9), rowid) r from h) select b.rowid, b.session_id, s.title, round(b.score, 6) score from b join sessions s on s.id = b.session_id where r = 1 order by round(b.score, 9), b.rowid limit 20"
)
def search_one_per_session(s, d):
    scored = fulltext.score_matches(_messages(s, d), "checkpoint").select("rowid", "session_id", F.round("score", 9).alias("score"))
    titled = scored.join(_sessions(s, d).select(F.col("id").alias("session_id"), "title"), "session_id")
    return fulltext.best_per(titled, "session_id", ["rowid"], 20, None).select("rowid", "session_id", "title", F.round("score", 6).alias("score"))


@query(f"{_TOK} select rowid from t where list_contains(tk, 'manifest') and indexed_at >= timestamp '{T0}'")
def search_since(s, d):
    return fulltext.score_matches(_messages(s, d), "manifest", where=F.col("indexed_at") >= F.lit(T0).cast("timestamp")).select("rowid")


@query()
def search_snippets(s, d):
    return fulltext.snippets(fulltext.search(_messages(s, d), _sessions(s, d), "stale lease"), "stale lease").select("rowid", "session_id", "title", "score", "snippet")


@query(f"{_TOK}, e as (select rowid, unnest(tk) term from t) select term, count(distinct rowid) df, count(*) cf from e group by term")
def term_statistics(s, d):
    return fulltext.postings(_messages(s, d), ["rowid"]).groupBy("term").agg(F.count("*").alias("df"), F.sum(F.size("positions")).alias("cf"))



# ---- browsing ---------------------------------------------------------------------------------------------
@query("select id, title, ended_at from sessions where vendor = 'claude' and record_kind = 'chat' order by ended_at desc nulls last, id limit 20")
def recent_sessions(s, d):
    return browse.recent_sessions(_sessions(s, d).filter("record_kind = 'chat'"), 20, vendor="no such vendor").select("id", "title", "ended_at")


@query("select m.rowid, m.session_id, s.title, s.project_path from messages m left join sessions s on s.id = m.session_id where m.kind = 'tool_result'")
def sessions_by_ids(s, d):
    return browse.fill_sessions(_messages(s, d).filter("kind = 'tool_result'").select("rowid", "session_id"), _sessions(s, d)).select("rowid", "session_id", "title", "project_path")


@query("with f as (select *, row_number() over (order by seq, rowid) - 1 place, count(*) over () total from messages where session_id = '5e550000-0000-4000-a000-00000000cafe' and kind in ('text', 'tool_use', 'tool_result') and not coalesce(is_sidechain, false)) select rowid, place, total, true has_more, 150 next_offset from f where place between 100 and 149")
def session_page(s, d):
    return browse.page(_messages(s, d), "5e550000-0000-4000-a000-00000000cafe", 100, 50).select("rowid", F.col("place").cast("long").alias("place"), "total", "has_more", "next_offset")


@query("""select session_id, count(*) n_all, count(*) filter (where kind = 'text' and role = 'user' and not coalesce(is_sidechain, false)) n_you,
count(*) filter (where kind = 'text' and role = 'user' and coalesce(is_sidechain, false)) n_task, count(*) filter (where kind = 'text' and role = 'assistant') n_claude,
count(*) filter (where kind = 'thinking') n_thinking, count(*) filter (where kind = 'tool_use') n_tool, count(*) filter (where kind = 'tool_result') n_result, count(*) filter (where coalesce(is_sidechain, false)) n_sidechain
from messages group by session_id""")
def thread_views(s, d):
    views = ("all", "you", "task", "claude", "thinking", "tool", "result", "sidechain")
    return _messages(s, d).groupBy("session_id").agg(*(F.count_if(browse.view_filter(v)).alias(f"n_{v}") for v in views))


@query("select distinct project_path from sessions where project_path <> ''")
def facet_paths(s, d):
    return browse.facets(_sessions(s, d))


_LABEL = "case vendor when 'claude-desktop' then 'Claude Desktop' when 'cursor' then 'Cursor' when 'opencode' then 'OpenCode' when 'codex' then 'Codex' else 'Claude Code' end"


@query(f"with p as (select id, coalesce(nullif(project_path, ''), '(no path)') path, {_LABEL} v, ended_at from sessions), g as (select id, v || ' · ' || path as label, ended_at from p) select id, label, row_number() over (partition by label order by ended_at desc nulls last, id) = 1 opens from g")
def group_headers(s, d):
    placed = _sessions(s, d).withColumn("place", F.struct(F.col("ended_at").isNull(), -F.unix_micros(F.col("ended_at").cast("timestamp")), "id"))
    return browse.group_hits(placed, "vendor+path").select("id", "label", "opens")


@query("select id, title, project_path from sessions order by project_path nulls first, title nulls first, id limit 50")
def sort_modes(s, d):
    return browse.sort_hits(_sessions(s, d), "project").select("id", "title", "project_path").limit(50)


@query(f"select id, '[' || {_LABEL} || case when record_kind = 'plan' then ' plan' when not has_transcript then ' prompt-only' else '' end || ']' tag from sessions")
def session_tags(s, d):
    return _sessions(s, d).select("id", browse.tag(F.col("vendor"), F.col("record_kind"), F.coalesce("has_transcript", F.lit(True))).alias("tag"))


@query("with l as (select rowid, session_id, seq, string_split(text, chr(10)) a from messages where text is not null), u as (select session_id, seq, unnest(a) content, generate_subscripts(a, 1) - 1 line from l) select session_id, seq, line, content from u where contains(lower(content), 'exit status')")
def find_lines(s, d):
    return browse.find_lines(_messages(s, d), "EXIT status").select("session_id", "seq", F.col("line").cast("long").alias("line"), "content")


@query("select rowid, regexp_replace(text, '(exit status)', '[\\1]', 'gi') marked from messages where contains(lower(text), 'exit status')")
def highlight(s, d):
    return _messages(s, d).filter(F.lower("text").contains("exit status")).select("rowid", browse.highlight(F.col("text"), "Exit Status").alias("marked"))


@query("with l as (select display as q, max(hist_id) as last_id from history where display is not null group by display) select q as \"query\", last_id as \"at\" from l order by last_id desc, q limit 100")
def recent_queries(s, d):
    return browse.recent_queries(table(s, d, "history").filter("display is not null").select(F.col("display").alias("query"), F.col("hist_id").alias("at")))


# ---- joins and windows ------------------------------------------------------------------------------------
@query("with h as (select rowid hit, session_id, seq from messages where kind = 'thinking') select h.hit, m.session_id, m.seq, m.role, m.text from h join messages m on m.session_id = h.session_id and m.seq between h.seq - 2 and h.seq + 2")
def neighbors_band_join(s, d):
    return retrieval.neighbors(_messages(s, d).filter("kind = 'thinking'").select("rowid", "session_id", "seq"), _messages(s, d)).select("hit", "session_id", "seq", "role", "text")


@query("with p as (select *, row_number() over (partition by session_id order by seq, rowid) - 1 k from messages) select session_id, min(indexed_at) first_at, max(indexed_at) last_at, count(*) n, arg_max(role, struct_pack(a := seq, b := rowid)) last_role from messages where seq is not null group by session_id")
def session_rollup(s, d):
    return _messages(s, d).filter("seq is not null").groupBy("session_id").agg(F.min("indexed_at").alias("first_at"), F.max("indexed_at").alias("last_at"), F.count("*").alias("n"), F.max_by("role", F.struct("seq", "rowid")).alias("last_role"))


@query("select hist_id, \"sessionId\" as session_id, row_number() over (partition by \"sessionId\" order by timestamp nulls first, hist_id) - 1 seq from history")
def prompt_seq(s, d):
    order = Window.partitionBy("sessionId").orderBy("timestamp", "hist_id")
    return table(s, d, "history").select("hist_id", F.col("sessionId").alias("session_id"), (F.row_number().over(order) - 1).cast("long").alias("seq"))


@query("select \"sessionId\" id, count(*)::integer message_count, min(make_timestamp(timestamp * 1000)) started_at from history where timestamp between 100000000000 and 99999999999999 and \"sessionId\" is not null and \"sessionId\" not in (select id from sessions where has_transcript) group by 1")
def prompt_only_sessions(s, d):
    log = table(s, d, "history").filter("timestamp between 100000000000 and 99999999999999 and sessionId is not null")
    numbered = transcripts.number_prompts(log.withColumn("place", F.col("hist_id")))
    return transcripts.prompt_rows(numbered, _sessions(s, d).filter("has_transcript"))[0].select("id", "message_count", "started_at")


@query("""with r as (select *, row_number() over (partition by "cliSessionId" order by coalesce("lastActivityAt", 0) desc, "sessionId") k from local_sessions where coalesce("cliSessionId", '') <> '')
select s.id, coalesce(nullif(r.title, ''), s.title) title, coalesce(nullif(r.cwd, ''), nullif(r."originCwd", ''), s.project_path) project_path, 'claude-desktop' vendor from sessions s join r on r."cliSessionId" = s.id and k = 1""")
def desktop_link(s, d):
    sane = lambda c: F.when(F.col(c).between(10**9, 10**14), F.col(c)).alias(c)
    local = table(s, d, "local_sessions")
    order = Window.partitionBy("cliSessionId").orderBy(F.desc(F.coalesce("lastActivityAt", F.lit(0))), "sessionId")
    first = local.filter("coalesce(cliSessionId, '') <> ''").withColumn("k", F.row_number().over(order)).filter("k = 1").select("sessionId", "cliSessionId", "cwd", "originCwd", "title", sane("createdAt"), sane("lastActivityAt"))
    return transcripts.link_desktop(first, _sessions(s, d)).select("id", "title", "project_path", "vendor")


@query("""with u as (select id, 0 source_rank, nullif(title, '') title, nullif(project_path, '') project_path from sessions
union all select "cliSessionId", 1, nullif(title, ''), nullif(cwd, '') from local_sessions where "cliSessionId" in (select "cliSessionId" from local_sessions group by 1 having count(*) = 1) and "cliSessionId" <> '')
select id, arg_max(title, source_rank) filter (where title is not null) title, arg_max(project_path, source_rank) filter (where project_path is not null) project_path from u group by id""")
def source_override_coalesce(s, d):
    local = table(s, d, "local_sessions").filter("cliSessionId <> ''")
    once = local.join(local.groupBy("cliSessionId").count().filter("count = 1"), "cliSessionId", "left_semi")
    rows = _sessions(s, d).select("id", F.lit(0).alias("source_rank"), "title", "project_path").unionByName(once.select(F.col("cliSessionId").alias("id"), F.lit(1).alias("source_rank"), "title", F.col("cwd").alias("project_path")))
    return browse.merge_sources(rows).select("id", "title", "project_path")


@query("select summary, session_id, model from summaries where session_id in (select id from sessions)")
def orphan_sweep(s, d):
    return condense.sweep_orphans(table(s, d, "summaries"), _sessions(s, d)).select("summary", "session_id", "model")


@query("select id path, sha256(coalesce(title, '')) content_hash from sessions where not (id in (select id from sessions where vendor = 'codex') and title is not null)")
def ledger_skip(s, d):
    catalog = _sessions(s, d).select(F.col("id").alias("path"), x.text_hash(F.col("title")).alias("content_hash"), "vendor", "title")
    return changed(catalog.select("path", "content_hash"), catalog.filter("vendor = 'codex' and title is not null"))


@query("select session_id, model, case when model = 'recap-small' then 'new' else summary end summary from summaries")
def summary_upsert(s, d):
    old = table(s, d, "summaries")
    new = old.filter("model = 'recap-small'").withColumns({"summary": F.lit("new"), "created_at": F.lit("2030-01-01").cast("timestamp")})
    return upsert(old, new, ["session_id", "model"], "created_at").select("session_id", "model", "summary")


@query("select id, case when vendor in ('claude', 'claude-desktop', 'cursor', 'opencode', 'codex') then vendor else 'claude' end vendor, case when record_kind in ('chat', 'plan') then record_kind else 'chat' end record_kind, case when starts_with(id, 'cursor') then 'cursor' when starts_with(id, 'codex:') then 'codex' when starts_with(id, 'opencode:') then 'opencode' else 'claude' end guessed from sessions")
def vendor_coercion(s, d):
    return _sessions(s, d).select("id", coerce_vendor(F.col("vendor")).alias("vendor"), coerce_kind(F.col("record_kind")).alias("record_kind"), vendor_from_id(F.col("id")).alias("guessed"))


# ---- text functions ---------------------------------------------------------------------------------------
_NAME = "[A-Za-z_][A-Za-z0-9_.\\-]*"
_TAG = f"^<\\s*(/\\s*{_NAME}|{_NAME}([ \\t].*)?)\\s*>$"
_LINES = f"""list_filter(list_transform(list_filter(list_transform(string_split(text, chr(10)), lambda l: regexp_replace(l, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')),
 lambda l: l <> '' and not regexp_matches(l, '{_TAG}') and not regexp_matches(l, '^/\\s*$|^/\\s*[A-Za-z0-9_-]+([ \\t].*)?$') and not (starts_with(l, '[') and ends_with(l, ']'))),
 lambda l: regexp_replace(regexp_replace(l, '^(?:[ \\t]*<\\s*{_NAME}(?:[ \\t][^>]*)?\\s*>)+', ''), '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')), lambda l: l <> '')"""


@query(f"with l as (select rowid, {_LINES} a from messages where kind = 'text') select rowid, coalesce(case when length(a[1]) > 60 then left(a[1], 60) || '…' else a[1] end, '') title from l")
def derive_title(s, d):
    return _messages(s, d).filter("kind = 'text'").select("rowid", x.derive_title(F.col("text")).alias("title"))


@query(f"with l as (select rowid, {_LINES} a from messages where kind = 'text') select rowid, coalesce(array_to_string(a, chr(10)), '') clean from l")
def clean_text(s, d):
    return _messages(s, d).filter("kind = 'text'").select("rowid", x.clean_text(F.col("text")).alias("clean"))


@query("select rowid, case when starts_with(kind, 'tool_') and length(text) > 40 then left(text, 40) || '…[truncated]' else text end text from messages where kind = 'tool_result' or (kind = 'text' and role = 'user')")
def shrink_payload(s, d):
    rows = _messages(s, d).filter(x.should_index(F.col("role"), F.col("kind"), deep=False))
    return rows.select("rowid", x.shrink(F.col("kind"), F.col("text"), 40).alias("text"))


_PAYLOAD = "regexp_extract(text, '^\\S* ((?s:.*))$', 1)"
_COMMAND = f"coalesce(case when json_valid({_PAYLOAD}) then {_PAYLOAD}::json ->> '$.command' end, '')"


@query(f"select rowid, {_COMMAND} command from messages where kind = 'tool_use' and tool_name = 'Bash'")
def json_command_extract(s, d):
    return _messages(s, d).filter("kind = 'tool_use' and tool_name = 'Bash'").select("rowid", F.coalesce(x.bash_command(F.col("text")), F.lit("")).alias("command"))


_NORMAL = f"trim(regexp_replace({_COMMAND}, '\\b[0-9a-fA-F]{{6,}}\\b|\\b[0-9]+\\b', '<x>', 'g'))"


@query(f"select session_id, seq, {_NORMAL} command from messages where kind = 'tool_use' and tool_name = 'Bash'")
def normalize_command(s, d):
    return mining.commands(_messages(s, d))


@query("select rowid, sha256(coalesce(text, '')) hash from messages")
def text_hash(s, d):
    return _messages(s, d).select("rowid", x.text_hash(F.col("text")).alias("hash"))


@query("select id, coalesce(nullif(regexp_replace(regexp_replace(lower(trim(title)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'candidate') slug, left(id, 8) short from sessions")
def slugs(s, d):
    return _sessions(s, d).select("id", x.slugify(F.col("title")).alias("slug"), x.short_id(F.col("id")).alias("short"))


@query("select id, coalesce(strftime(started_at, '%Y-%m-%dT%H:%M:%SZ'), '') started from sessions")
def time_output(s, d):
    return _sessions(s, d).select("id", x.format_time(F.col("started_at")).alias("started"))


# ---- vectors ----------------------------------------------------------------------------------------------
_QUERY = [((i * 7) % 11 - 5) / 10 for i in range(64)]
_Q = "[" + ", ".join(f"{v}::double" for v in _QUERY) + "]"


def _vectors(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "embeddings").select(F.col("vec_id").alias("rowid"), F.col("embedding").alias("vector"), F.col("label").alias("session_id"))


_SCORED = f"with v as (select vec_id as rowid, label as session_id, list_cosine_similarity(embedding::double[], {_Q}) score from embeddings)"


@query(f"{_SCORED} select rowid, session_id, round(score, 6) score from v order by round(score, 9) desc, rowid limit 48")
def knn_cosine(s, d):
    return retrieval.nearest(_vectors(s, d), _QUERY, 48).select("rowid", "session_id", F.round("score", 6).alias("score"))


@query(f"{_SCORED}, p as (select * from v order by round(score, 9) desc, rowid limit 48), c as (select *, row_number() over (partition by session_id order by round(score, 9) desc, rowid) r from p) select rowid, session_id, round(score, 6) score from c where r <= 3 order by round(score, 9) desc, rowid limit 12")
def knn_cap_per_session(s, d):
    return retrieval.nearest_units(_vectors(s, d), _QUERY, 12, 3).select("rowid", "session_id", F.round("score", 6).alias("score"))


@query("select m.rowid from messages m where ((kind = 'text' and role in ('user', 'assistant')) or (kind = 'tool_use' and tool_name = 'Bash')) and not exists (select 1 from message_vectors v where v.message_rowid = m.rowid and v.model = 'embed-s-96')")
def unembedded_antijoin(s, d):
    vectors = table(s, d, "message_vectors").select(F.col("message_rowid").alias("rowid"), "model")
    return retrieval.unembedded(_messages(s, d), vectors, "embed-s-96", ["rowid"]).select("rowid")


@query("select v.message_rowid as rowid, v.model, m.session_id, m.seq, s.title from message_vectors v join messages m on m.rowid = v.message_rowid join sessions s on s.id = m.session_id")
def embeddings_with_context(s, d):
    side = _sessions(s, d).select(F.col("id").alias("session_id"), "title")
    vectors = table(s, d, "message_vectors").select(F.col("message_rowid").alias("rowid"), "model")
    return vectors.join(_messages(s, d).select("rowid", "session_id", "seq"), "rowid").join(side, "session_id").select("rowid", "model", "session_id", "seq", "title")


@query("with n as (select rowid + 1000000 new_rowid, session_id, seq, case when seq % 2 = 0 then text else text || '!' end text from messages) select n.new_rowid as rowid, v.model, v.text_hash from message_vectors v join messages o on o.rowid = v.message_rowid join n on n.session_id = o.session_id and n.seq = o.seq and coalesce(n.text, '') = coalesce(o.text, '')")
def embedding_carry_over(s, d):
    old = _messages(s, d).select("rowid", "session_id", "seq", "text")
    new = old.select((F.col("rowid") + 1_000_000).alias("rowid"), "session_id", "seq", F.when(F.col("seq") % 2 == 0, F.col("text")).otherwise(F.concat("text", F.lit("!"))).alias("text"))
    vectors = table(s, d, "message_vectors").select(F.col("message_rowid").alias("rowid"), "model", "text_hash")
    return retrieval.carry_over(old, vectors, new).select("rowid", "model", "text_hash")


@query("select vec_id, round(sqrt(list_sum(list_transform(embedding, lambda e: e::double * e::double))), 5) size, round(list_cosine_similarity(embedding::double[], embedding::double[]), 6) self from embeddings")
def vector_norms(s, d):
    v = table(s, d, "embeddings")
    return v.select("vec_id", F.round(norm(F.col("embedding")), 5).alias("size"), F.round(cosine(F.col("embedding"), F.col("embedding")), 6).alias("self"))


@query()
def semantic_search(s, d):
    rows = _messages(s, d).filter(retrieval.embeddable())
    embedder = retrieval.HashingEmbedder()
    vectors = retrieval.embed(rows.withColumn("embed_text", retrieval.embed_text()), embedder, ["rowid"]).join(rows.select("rowid", "session_id"), "rowid").select("rowid", "session_id", "vector")
    return retrieval.semantic_search(vectors, rows, _sessions(s, d), "why does the lease report broken pipe", embedder)


@query()
def ask_context(s, d):
    rows = _messages(s, d).filter(retrieval.embeddable())
    embedder = retrieval.HashingEmbedder()
    vectors = retrieval.embed(rows.withColumn("embed_text", retrieval.embed_text()), embedder, ["rowid"]).join(rows.select("rowid", "session_id"), "rowid").select("rowid", "session_id", "vector")
    return retrieval.ask_context(vectors, _messages(s, d), _sessions(s, d), embedder.embed(["stale checkpoint in the parser"])[0])


# ---- mining -----------------------------------------------------------------------------------------------
@query(f"""with c as (select session_id, seq, {_NORMAL} command, rowid from messages where kind = 'tool_use' and tool_name = 'Bash'),
o as (select *, row_number() over (partition by session_id order by seq, rowid) k from c),
w as (select session_id, command c0, seq, lead(command, 1) over w c1, lead(command, 2) over w c2, lead(command, 3) over w c3, lead(seq, 1) over w s1, lead(seq, 2) over w s2, lead(seq, 3) over w s3 from (select distinct session_id, seq, command from o) window w as (partition by session_id order by seq, command)),
g as (select session_id, unnest([case when s1 - seq <= 4 and c0 <> '' and c1 <> '' then c0 || ' && ' || c1 end, case when s2 - seq <= 8 and c0 <> '' and c2 <> '' then c0 || ' && ' || c1 || ' && ' || c2 end, case when s3 - seq <= 12 and c0 <> '' and c3 <> '' then c0 || ' && ' || c1 || ' && ' || c2 || ' && ' || c3 end]) gram from w)
select gram, count(distinct session_id) sessions from g where gram is not null group by gram having count(distinct session_id) >= 1""")
def ngram_support(s, d):
    cmds = mining.commands(_messages(s, d)).distinct()
    numbered = cmds.withColumn("seq", F.col("seq").cast("long"))
    return mining.command_ngrams(numbered, least=1).select(F.array_join("gram", " && ").alias("gram"), "sessions")


def _members(s: SparkSession, d: str) -> DataFrame:
    side = _sessions(s, d).select(F.col("id").alias("session_id"), "project_path")
    rows = _messages(s, d).filter("kind = 'tool_use' and tool_name is not null").select(F.lower(F.trim("tool_name")).alias("cluster"), "session_id")
    return rows.join(side, "session_id", "left")


@query("with m as (select lower(trim(tool_name, ' ')) as cluster, session_id, project_path from messages left join sessions on id = session_id where kind = 'tool_use' and tool_name is not null) select cluster, count(distinct session_id) sessions, count(distinct nullif(project_path, '')) projects, count(distinct session_id) * greatest(count(distinct nullif(project_path, '')), 1) as rank from m group by cluster having count(distinct session_id) >= 3")
def cluster_rank(s, d):
    return mining.rank_clusters(_members(s, d))


@query("""with p as (select label cl, vec_id, embedding, generate_subscripts(embedding, 1) i, unnest(embedding)::double e from embeddings),
m as (select cl, i, avg(e) a from p group by all), z as (select cl, sqrt(sum(a * a)) n from m group by cl), c as (select m.cl, i, (a / n)::float::double a from m join z using (cl)),
q as (select p.cl, vec_id, sum((e - a) * (e - a)) distance from p join c on c.cl = p.cl and c.i = p.i group by all), r as (select *, row_number() over (partition by cl order by round(distance, 7), vec_id) k from q)
select cl as cluster, vec_id, round(distance, 4) distance from r where k <= 5""")
def medoid_samples(s, d):
    near = mining.medoids(table(s, d, "embeddings").select(F.col("label").alias("cluster"), "vec_id", F.col("embedding").alias("vector")), "vec_id")
    return near.select("cluster", "vec_id", F.round("distance", 4).alias("distance"))


def _unit(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "embeddings").select("vec_id", normalize(F.col("embedding")).alias("vector"))


@query()
def kmeans_assign(s, d):
    v = _unit(s, d)
    return mining.assign(v, mining.kmeans(v, 8)).select("vec_id", "cluster", F.round("distance", 6).alias("distance"))


@query()
def pick_k(s, d):
    return s.createDataFrame([(mining.pick_k(_unit(s, d)),)], "k int")


@query()
def mine_skills(s, d):
    rows = _messages(s, d).filter("role = 'user' and kind = 'text'")
    vectors = retrieval.embed(rows.withColumn("embed_text", retrieval.embed_text()), retrieval.HashingEmbedder(), ["rowid"])
    side = _sessions(s, d).select(F.col("id").alias("session_id"), "project_path")
    units = vectors.join(rows.select("rowid", "session_id", "text"), "rowid").join(side, "session_id", "left").select(F.col("rowid").alias("key"), "session_id", "project_path", "vector", "text")
    return mining.mine_skills(units, k=8)


# ---- condensing -------------------------------------------------------------------------------------------
@query("""with b as (select session_id, count(*) n from messages where kind not in ('thinking', 'image') and not coalesce(is_sidechain, false) group by 1) select b.session_id, n::integer kept from b join sessions s on s.id = b.session_id""")
def condense_unlimited(s, d):
    return condense.condense(_sessions(s, d), _messages(s, d), budget=2**30).select("session_id", "kept")


# ---- relational shapes at the scale of the bench ----------------------------------------------------------
@query("select c_nationkey, count(*) orders, round(sum(o_totalprice), 2) total from orders join customer on c_custkey = o_custkey group by 1")
def owner_rollup(s, d):
    o, c = table(s, d, "orders"), table(s, d, "customer")
    return o.join(c, o.o_custkey == c.c_custkey).groupBy("c_nationkey").agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("with w as (select user_id, event_type, lead(event_type, 1) over q e1, lead(event_type, 2) over q e2 from events window q as (partition by user_id order by ts, event_id)) select event_type || ' > ' || e1 || ' > ' || e2 gram, count(distinct user_id) sessions from w where e2 is not null group by 1 having count(distinct user_id) >= 3")
def event_ngrams(s, d):
    e = table(s, d, "events")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    steps = e.select(F.col("user_id").alias("session_id"), F.row_number().over(order).cast("long").alias("seq"), F.col("event_type").alias("command"))
    return mining.command_ngrams(steps, 3, 3).select(F.array_join("gram", " > ").alias("gram"), "sessions")


