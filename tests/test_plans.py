"""Registered queries on small tables made for them."""

import pytest

from threadlake.plans import archive, general

MESSAGES = "rowid long, uuid string, parent_uuid string, session_id string, role string, kind string, tool_name string, text string, seq long"


def folder_of(spark, path, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/{name}.parquet")
    return str(path)


@pytest.mark.parametrize("query", ["semantic_search", "ask_context"])
def test_assistant_texts_and_commands_are_hits(spark, tmp_path, query):
    said = "why does the lease report broken pipe, stale checkpoint in the parser"
    rows = [
        (1, None, None, "s1", "user", "text", None, "something about the weather today", 0),
        (2, None, None, "s2", "assistant", "text", None, said, 0),
        (3, None, None, "s3", "assistant", "tool_use", "Bash", 'Bash {"command":"grep lease report broken pipe stale checkpoint parser"}', 0),
        (4, None, None, "s4", "assistant", "tool_use", "Read", "Read {}", 0),
        (5, None, None, "s5", "assistant", "thinking", None, said, 0),
    ]
    sessions = [(f"s{i}", "t", "/p", "claude", None) for i in range(1, 6)]
    d = folder_of(spark, tmp_path, messages=(rows, MESSAGES), sessions=(sessions, "id string, title string, project_path string, vendor string, started_at timestamp"))
    assert {r["session_id"] for r in archive.QUERIES[query](spark, d).collect()} == {"s1", "s2", "s3"}


def test_paths_and_sizes_of_both_tables(spark, tmp_path):
    up = {f"m{i:02d}": f"m{(i - 1) // 2 if i % 3 else max(i - 1, 0):02d}" if i else None for i in range(60)}
    messages = [(i, k, p, "s1", "user", "text", None, "x", i) for i, (k, p) in enumerate(up.items())]
    below = {"a": None, "b": "a", "c": "b", "x": "y", "y": "x", "z": "x"}
    samples = [(i, k, p, "s9") for i, (k, p) in enumerate(below.items())]
    d = folder_of(spark, tmp_path, messages=(messages, MESSAGES), samples=(samples, "rec_id long, uuid string, parentUuid string, sessionId string"))
    want, depth = {("samples", "b", "a", 0), ("samples", "c", "a", 0), ("samples", "c", "b", 1), ("samples", "z", "x", 0)}, {}
    for k, p in up.items():
        depth[k] = depth[p] + 1 if p else 0
        while p:
            want.add(("messages", k, p, depth[p]))
            p = up[p]
    got = [tuple(r) for r in general.QUERIES["p2_paths"](spark, d).select("src", "key", "ancestor", "ancestor_depth").collect()]
    assert len(got) == len(set(got)) and set(got) == want
    sizes = {(r["src"], r["key"]): r["descendants"] for r in general.QUERIES["p2_tree_sizes"](spark, d).collect()}
    assert sizes == {(src, k): sum(w[0] == src and w[2] == k for w in want) for src, keys in (("messages", up), ("samples", below)) for k in keys}
