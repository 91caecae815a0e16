import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from threadlake.engine import Engine
from threadlake.operators import condense, mining, retrieval
from threadlake.plans.ingest import IndexConfig, view_file
from threadlake.sources import transcripts as t
from threadlake.sources.store import Store, archive_plan


def lines(path, *rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows) + "\n")
    return path


def said(kind, role, content, n, **more):
    return {"type": kind, "sessionId": "s1", "uuid": f"u{n}", "timestamp": f"2026-01-01T00:00:0{n}Z", "cwd": "/p", "gitBranch": "main", "message": {"role": role, "content": content}} | more


@pytest.fixture
def home(tmp_path):
    lines(
        tmp_path / "claude/-srv-x/s1.jsonl",
        said("user", "user", "Please fix the stale lease in the parser", 1),
        said("user", "user", [{"type": "text", "text": "two"}, {"type": "tool_result", "content": [{"type": "text", "text": "a"}, {"type": "image"}, {"type": "text", "text": "b"}]}, {"type": "tool_result", "is_error": True, "content": "bad"}, {"type": "image", "source": {"type": "x"}}], 2),
        said("assistant", "assistant", [{"type": "text", "text": "[1,2] plain"}, {"type": "thinking", "thinking": "hm"}], 3),
        said("assistant", "assistant", [{"type": "tool_use", "name": "Read", "input": {"file_path": "/srv/x/lease.go", "a": 1}}], 4),
        "{broken",
        {"type": "ai-title", "aiTitle": "Generated"},
        {"type": "custom-title", "customTitle": "Chosen"},
        said("user", "user", "meta", 5, isMeta=True),
    )
    lines(tmp_path / "claude/-srv-x/s1/subagents/agent-1.jsonl", said("assistant", "assistant", [{"type": "tool_use", "name": "Bash", "input": {"command": "go build"}}], 6, isSidechain=True))
    lines(tmp_path / "cursor/Users-me-demo/agent-transcripts/c1/c1.jsonl", {"role": "user", "message": {"role": "user", "content": [{"type": "text", "text": "<user_query>\nShow the date"}]}}, {"role": "assistant", "message": {"role": "assistant", "content": "It is late"}})
    lines(
        tmp_path / "codex/2026/rollout-1.jsonl",
        {"timestamp": "2026-01-01T00:00:00Z", "type": "session_meta", "payload": {"id": "t1", "cwd": "/q", "git": {"branch": "dev"}}},
        {"timestamp": "2026-01-01T00:00:01Z", "type": "response_item", "payload": {"type": "message", "role": "user", "content": [{"type": "input_text", "text": "hello there"}]}},
        {"timestamp": "2026-01-01T00:00:02Z", "type": "response_item", "payload": {"type": "reasoning", "summary": [{"type": "summary_text", "text": "hmm"}]}},
        {"timestamp": "2026-01-01T00:00:03Z", "type": "response_item", "payload": {"type": "function_call", "name": "bash", "call_id": "k", "arguments": "ls"}},
        {"timestamp": "2026-01-01T00:00:04Z", "type": "response_item", "payload": {"type": "function_call_output", "call_id": "k", "output": "files"}},
        {"timestamp": "2026-01-01T00:00:05Z", "type": "response_item", "payload": {"type": "message", "role": "assistant", "content": [{"type": "output_text", "text": "done"}]}},
        {"timestamp": "2026-01-01T00:00:05Z", "type": "response_item", "payload": {"type": "message", "role": "system", "content": [{"type": "text", "text": "no"}]}},
        {"timestamp": "2026-01-01T00:00:06Z", "type": "event_msg", "payload": {}},
    )
    lines(tmp_path / "history.jsonl", {"display": "[Pasted text #1]", "pastedContents": {"1": {"id": "1", "type": "text", "content": "real text"}}, "timestamp": 1767225600000, "project": "/p", "sessionId": "b1"}, {"display": "later", "timestamp": 1767225601000, "project": "/p", "sessionId": "b1"}, {"display": "x", "timestamp": 1767225601000, "project": "/p", "sessionId": "s1"})
    (tmp_path / "desk").mkdir()
    (tmp_path / "desk/local_1.json").write_text(json.dumps({"sessionId": "local_1", "cliSessionId": "s1", "cwd": "/desk", "title": "Desk title", "createdAt": 1767225600000, "lastActivityAt": 1767225700}))
    (tmp_path / "plans").mkdir()
    (tmp_path / "plans/PLAN.md").write_text("# The plan\nsteps of the lease")
    (tmp_path / "plans/plan.original.md").write_text("old")
    return tmp_path


def test_claude_lines(spark, home):
    sessions, messages = t.claude(spark, str(home / "claude"))
    got = [(r["kind"], r["text"], r["tool_name"], r["is_sidechain"]) for r in messages.orderBy("seq").collect()]
    assert got == [
        ("text", "Please fix the stale lease in the parser", None, False), ("text", "two", None, False), ("tool_result", "a\nb", None, False), ("tool_result", "bad", None, False), ("text", "[1,2] plain", None, False), ("thinking", "hm", None, False),
        ("tool_use", 'Read {"file_path":"/srv/x/lease.go","a":1}', "Read", False), ("tool_use", 'Bash {"command":"go build"}', "Bash", True),
    ]
    s = sessions.collect()
    assert len(s) == 1 and (s[0]["title"], s[0]["project_path"], s[0]["git_branch"], s[0]["message_count"]) == ("Chosen", "/p", "main", 8)
    quick = t.claude(spark, str(home / "claude"), deep=False)[1]
    assert [r["kind"] for r in quick.orderBy("seq").collect()] == ["text", "text", "tool_result", "tool_result"]


def test_cursor_and_codex_lines(spark, home):
    sessions, messages = t.cursor(spark, str(home / "cursor"))
    assert [(r["role"], r["text"]) for r in messages.orderBy("seq").collect()] == [("user", "<user_query>\nShow the date"), ("assistant", "It is late")]
    assert [(r["id"], r["title"], r["project_path"]) for r in sessions.collect()] == [("cursor:c1", "Show the date", "/Users/me/demo")]
    sessions, messages = t.codex(spark, str(home / "codex"))
    assert [(r["kind"], r["tool_name"]) for r in messages.orderBy("seq").collect()] == [("text", None), ("thinking", None), ("tool_use", "bash"), ("tool_result", "bash"), ("text", None)]
    assert [(r["id"], r["project_path"], r["git_branch"]) for r in sessions.collect()] == [("codex:t1", "/q", "dev")]


def test_opencode_database(spark, tmp_path):
    path = str(tmp_path / "o.db")
    with sqlite3.connect(path) as db:
        db.executescript("create table session(id, project_id, parent_id, directory, title, time_created, time_updated); create table message(id, session_id, time_created, time_updated, data); create table part(id, message_id, session_id, time_created, time_updated, data)")
        db.executemany("insert into session values (?,?,?,?,?,?,?)", [("r", "p", None, "/d", "", 1, 2), ("c", "p", "r", "/d", "child", 3, 4)])
        db.executemany("insert into message values (?,?,?,?,?)", [("m1", "r", 1, 1, '{"role":"user"}'), ("m2", "r", 2, 2, '{"role":"assistant"}'), ("m3", "c", 3, 3, '{"role":"assistant"}')])
        parts = [("a", "m1", "r", 1, {"type": "text", "text": "Find the bug"}), ("b", "m2", "r", 2, {"type": "reasoning", "text": "so"}), ("c", "m2", "r", 3, {"type": "tool", "tool": "read", "state": {"input": {"f": 1}, "output": "data"}}), ("d", "m2", "r", 4, {"type": "patch", "files": ["x", "y"]}), ("e", "m3", "c", 5, {"type": "text", "text": "child"}), ("f", "m2", "r", 6, {"type": "tool", "tool": "nostate"})]
        db.executemany("insert into part values (?,?,?,?,?,?)", [(i, m, s, n, n, json.dumps(d)) for i, m, s, n, d in parts])
    sessions, messages = t.opencode(spark, path)
    assert [(r["kind"], r["text"], r["is_sidechain"]) for r in messages.orderBy("seq").collect()] == [("text", "Find the bug", False), ("thinking", "so", False), ("tool_use", 'read {"f":1}', False), ("tool_result", "data", False), ("text", "x\ny", False), ("tool_use", "nostate ", False), ("text", "child", True)]
    assert [(r["id"], r["title"]) for r in sessions.collect()] == [("opencode:r", "Find the bug")]


def test_prompts_plans_and_detection(spark, home):
    log = t.prompts(spark, str(home / "history.jsonl"))
    assert [(r["session_id"], r["seq"], r["text"]) for r in log.orderBy("session_id", "seq").collect()] == [("b1", 0, "real text"), ("b1", 1, "later"), ("s1", 0, "x")]
    assert t.prompts(spark, str(home / "none.jsonl")).count() == 0
    paths = t.find_plans([str(home / "plans")])
    assert [p.rsplit("/", 1)[1] for p in paths] == ["PLAN.md"]
    plan = t.plans(spark, paths).first()
    assert plan["title"] == "The plan" and plan["id"].startswith("plan:") and len(plan["id"]) == 21
    assert t.detect_format(str(home / "codex/2026/rollout-1.jsonl")) == "codex" and t.detect_format(str(home / "cursor/Users-me-demo/agent-transcripts/c1/c1.jsonl")) == "cursor"
    assert view_file(spark, str(home / "claude/-srv-x/s1.jsonl"))[1].count() == 7
    with pytest.raises(ValueError):
        t.detect_format(str(home / "plans/PLAN.md"))


def test_indexing_twice_changes_nothing(spark, home, tmp_path):
    engine = Engine(spark, str(tmp_path / "store"))
    config = IndexConfig(claude=str(home / "claude"), desktop=str(home / "desk"), cursor=str(home / "cursor"), codex=str(home / "codex"), history=str(home / "history.jsonl"), plan_roots=[str(home / "plans")], plan_archive=str(tmp_path / "kept"))
    stats = engine.index(config)
    assert not stats.failed and stats.sessions == 5 and stats.messages == 8 + 2 + 5 + 2 + 1 and stats.prompt_only == 1 and stats.plans == 1
    titles = {r["id"]: (r["title"], r["vendor"]) for r in engine.store.read("sessions").collect()}
    assert titles["s1"] == ("Desk title", "claude-desktop") and titles["b1"][0] == "real text"
    assert engine.embed() > 0
    vectors = engine.store.read("embeddings").count()
    again = engine.index(config)
    assert again.indexed == 0 and again.skipped > 0 and engine.store.read("messages").count() == 18
    lines(home / "claude/-srv-x/s1.jsonl", said("user", "user", "Please fix the stale lease in the parser", 1), said("assistant", "assistant", "A wholly new answer to it", 2))
    changed = engine.index(config)
    assert changed.indexed == 1 and engine.store.read("messages").filter("session_id = 's1'").count() == 3
    assert 0 < engine.store.read("embeddings").count() < vectors + 1  # unchanged texts keep their vectors
    hits = engine.search_history("lease").collect()
    assert {h["session_id"] for h in hits} >= {"s1"} and "[lease]" in hits[0]["snippet"]
    assert engine.semantic_search("please fix stale in parser").first()["session_id"] == "s1"
    assert engine.list_sessions(limit=2).count() == 2 and engine.get_session("s1").count() == 2 and engine.get_session("s1", sidechains=True).count() == 3
    assert "### user" in engine.summarize_session("s1").first()["summary"]
    assert engine.ask_history("stale lease")[0][0]["num"] == 1 and engine.mine_patterns()[1] == []


def test_store_upserts(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    row = lambda h, at: spark.createDataFrame([("p", "s", h, None)], "path string, session_id string, content_hash string, updated_at timestamp").withColumn("updated_at", F.lit(at).cast("timestamp"))
    store.put_ledger(row("a", "2026-01-01"))
    store.put_ledger(row("b", "2026-01-02"))
    assert [r["content_hash"] for r in store.read("ledger").collect()] == ["b"]
    with pytest.raises(ValueError):
        store.put_embeddings(spark.createDataFrame([(1, "m", 1, [1.0], "h")], "rowid long, model string, dim int, vector array<float>, text_hash string"))
    assert archive_plan(str(tmp_path / "a"), "plan:1", b"x") is True and archive_plan(str(tmp_path / "a"), "plan:1", b"x") is False


def test_condensing_keeps_user_turns_and_one_marker(spark):
    rows = [("s", i, "user" if i % 4 == 0 else "assistant", "text", None, False, f"turn {i} " + "x" * (5 if i % 4 == 0 else 60)) for i in range(20)]
    messages = spark.createDataFrame(rows, "session_id string, seq int, role string, kind string, tool_name string, is_sidechain boolean, text string")
    sessions = spark.sql("select 's' id, 'T' title, 'claude' vendor, '/p' project_path, '' git_branch, timestamp'2026-01-01' started_at, timestamp'2026-01-02' ended_at, 20 message_count")
    r = condense.condense(sessions, messages, budget=600).first()
    assert r["truncated"] and r["kept"] + r["omitted"] == 20 and r["text"].count("blocks omitted") == 1
    assert all(f"turn {i} " in r["text"] for i in range(0, 20, 4)) and f"[... {r['omitted']} blocks" in r["text"]
    full = condense.condense(sessions, messages).first()
    assert not full["truncated"] and full["text"].startswith("# T\nvendor: claude\nproject: /p\nstarted: 2026-01-01T00:00:00Z\n")
    done = condense.summarize(condense.condense(sessions, messages), spark.createDataFrame([], "session_id string, model string, source_hash string, summary string"), "m", lambda texts: [t[:3] for t in texts])
    cache = spark.createDataFrame(done.collect(), done.schema)
    again = condense.summarize(condense.condense(sessions, messages), cache, "m", lambda texts: ["?"] * len(texts)).first()
    assert again["cached"] and again["summary"] == "# T"


def test_ngrams_and_clusters(spark):
    rows = [(f"s{k}", i, c) for k in range(3) for i, c in enumerate(["go build", "go test", "" if k else "x"])] + [("s9", 0, "go build"), ("s9", 30, "go test")]
    got = mining.command_ngrams(spark.createDataFrame(rows, "session_id string, seq long, command string")).collect()
    assert [(r["gram"], r["sessions"], r["rank"]) for r in got] == [(["go build", "go test"], 3, 6)]
    import numpy as np

    rng = np.random.default_rng(1)
    points = [(i, [float(x) for x in c + rng.normal(0, 0.01, 4)]) for i, c in enumerate(np.repeat(np.eye(4)[:3], 30, axis=0))]
    df = spark.createDataFrame(points, "key int, vector array<float>")
    model = mining.kmeans(df, 3)
    groups = {}
    for r in mining.assign(df, model).collect():
        groups.setdefault(r["cluster"], set()).add(r["key"] // 30)
    assert sorted(map(tuple, groups.values())) == [(0,), (1,), (2,)]
    assert mining.pick_k(df, (2, 3, 5)) == 3 and len(mining.kmeans(df.limit(2), 8).centers) == 2
    sums = mining._sums(df, model)
    assert sums["n"].tolist() == [30, 30, 30]


def test_neighbors_follow_seq(spark):
    messages = spark.createDataFrame([("s", i, "user", f"m{i}") for i in (0, 1, 2, 4)], "session_id string, seq long, role string, text string")
    hits = spark.createDataFrame([(7, "s", 2)], "rowid int, session_id string, seq long")
    assert sorted(r["seq"] for r in retrieval.neighbors(hits, messages, 1).collect()) == [1, 2]
