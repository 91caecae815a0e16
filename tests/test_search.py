import sqlite3

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from threadlake.operators import fulltext
from threadlake.operators.search_language import MOST_VARIANTS, QueryError, parse, render, variants


@pytest.mark.parametrize(
    ("query", "text"),
    [
        ("(term1 + term2) term3", "(term1 AND term2) AND term3"), ("alpha beta", "alpha AND beta"), ("foo | bar", "(foo OR bar)"), ("foo OR bar", "(foo OR bar)"), ('"exact phrase"', '"exact phrase"'), ("foo -bar", "foo NOT bar"), ("foo -bar -baz", "(foo NOT bar) NOT baz"),
        ("(foo -bar) baz", "(foo NOT bar) AND baz"), ("claude-code", '"claude-code"'), ("src/main.go", '"src/main.go"'), ("a:b", '"a:b"'), ("#42", '"#42"'), ("and foo", "and AND foo"), ('foo NOT "x y"', 'foo NOT "x y"'),
    ],
)
def test_golden_queries(query, text):
    assert render(parse(query)) == text


@pytest.mark.parametrize("query", ["-foo", "foo | -bar", "(foo", "foo ~", "", "foo )", "foo & bar"])
def test_errors(query):
    with pytest.raises(QueryError):
        parse(query)


def test_fuzzy():
    assert "config*" in render(parse("config~")) and " OR " in render(parse("config~"))
    assert "deploy*" in render(parse("~deploy")) and "auth*" in render(parse("auth", fuzzy=True))
    assert [str(v) for v in variants("ab")] == ["ab"]
    assert [str(v) for v in variants("leas")][:6] == ["leas", "leas*", "eas", "las", "les", "lea"]


@settings(max_examples=50, deadline=None)
@given(st.text("abcdefgXY", min_size=1, max_size=20))
def test_variants_are_few_and_distinct(word):
    found = variants(word)
    assert len(found) <= MOST_VARIANTS and len(set(found)) == len(found)


TEXTS = ["the stale lease", "Stale RÉSUMÉ lease lease", "fox_trot café aa aa aa", "nothing here", None, "", "stale connection reset by peer", "connection was reset", "lease of a stale fox trot cafe"]


def fts5(query):
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table t using fts5(x, tokenize = 'unicode61 remove_diacritics 2')")
    for i, text in enumerate(TEXTS, 1):
        db.execute("insert into t(rowid, x) values (?, ?)", (i, text or ""))
    return {r: round(s, 9) for r, s in db.execute("select rowid, bm25(t) from t where t match ?", (query,))}


@pytest.mark.parametrize("query", ["stale lease", "stale | fox", "stale -lease", '"aa aa"', '"connection reset"', "resume", "lease lease", "(stale + lease) | cafe"])
def test_scores_equal_those_of_an_embedded_index(spark, query):
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(TEXTS, 1)], "rowid int, text string, score_old int")
    got = {r["rowid"]: round(r["score"], 9) for r in fulltext.score_matches(df, query).collect()}
    assert got == fts5(render(parse(query)))


def test_one_hit_per_session_blank_query_and_pool(spark):
    rows = [(1, "s1", "lease"), (2, "s1", "lease lease lease"), (3, "s2", "a lease of many words here"), (4, None, "x")]
    messages = spark.createDataFrame(rows, "rowid int, session_id string, text string")
    sessions = spark.createDataFrame([("s1", "one"), ("s2", "two")], "id string, title string")
    hits = fulltext.search(messages, sessions, "lease", pool=None).collect()
    assert {(r["rowid"], r["title"]) for r in hits} == {(2, "one"), (3, "two")}
    assert fulltext.search(messages, sessions, "  ").count() == 0
    assert fulltext.score_matches(messages, "-- | lease".replace("--", "...")).count() == 3


def test_snippets():
    text = "one two three four five six seven eight nine ten eleven twelve stale lease fourteen fifteen"
    cut = fulltext.snippet(text, '"stale lease"')
    assert "[stale lease]" in cut and cut.startswith("… ") and len(cut.replace("…", "").split()) <= 12
    assert fulltext.snippet("RÉSUMÉ of", "resume") == "[RÉSUMÉ] of"
    assert fulltext.snippet(None, "x") == ""


def test_postings_and_tokens(spark):
    df = spark.createDataFrame([(1, "Aa b aa"), (2, None)], "rowid int, text string")
    got = {(r["term"], r["rowid"]): r["positions"] for r in fulltext.postings(df, ["rowid"]).collect()}
    assert got == {("aa", 1): [0, 2], ("b", 1): [1]}
    assert [r["dl"] for r in fulltext.index_tokens(df, ["rowid"]).orderBy("rowid").collect()] == [3, 0]
    assert df.select(F.size(fulltext.tokens(F.col("text")))).count() == 2


@pytest.mark.parametrize("query", ["lease", "stale lease", "stale | parser", "lease -parser", '"stale lease"', "(lease + parser) | checkpoint", "lease lease", '"a b a" | stale', '"…" | stale', "nowhere"])
def test_the_inverted_table_scores_like_a_scan(spark, tmp_path, query):
    texts = ["the stale lease", "stale stale lease in the parser", "a b a b a", None, "", "Checkpoint of the parser; LEASE léase", "a b", "lease " * 30, "parser", "stale x lease"]
    rows = spark.createDataFrame(list(enumerate(texts)), "rowid long, text string")
    fulltext.build_index(rows, "rowid", str(tmp_path), 2)
    want = {r["rowid"]: round(r["score"], 9) for r in fulltext.score_matches(rows, query).collect()}
    assert {r["rowid"]: round(r["score"], 9) for r in fulltext.score_indexed(spark, str(tmp_path), "rowid", query).collect()} == want
