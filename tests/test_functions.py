from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from threadlake.functions import text as x
from threadlake.functions import vector as v


def one(spark, f, *values):
    names = [f"c{i}" for i in range(len(values))]
    df = spark.createDataFrame([values], ", ".join(f"{n} string" for n in names))
    return df.select(f(*(F.col(n) for n in names))).first()[0]


@pytest.mark.parametrize(
    ("text", "title"),
    [("<user_query>\nCan you show the date", "Can you show the date"), ("/caveman ultra", ""), ("[Image]\n[Image]\n<image_files>\nThe following", "The following"), ("@ops/x:510 what is this", "@ops/x:510 what is this"), ("<user_query>Can you plan", "Can you plan"), ("x" * 80, "x" * 60 + "…"), (None, ""), ("", ""), ("/a/b is a path", "/a/b is a path")],
)
def test_titles(spark, text, title):
    assert one(spark, x.derive_title, text) == title


def test_clean_text_and_tags(spark):
    assert one(spark, x.clean_text, "<a>\n  keep \n</a>\n/go\n[note]\n<b>this</b>") == "keep\nthis</b>"
    for line, tag in (("<br/>", False), ("<br />", True), ("</x>", True), ("<a b='c'>", True), ("< >", False), ("<1>", False)):
        assert one(spark, x.is_standalone_tag, line) is tag


def test_shrink_and_depth(spark):
    assert one(spark, lambda k, t: x.shrink(k, t, 5), "tool_use", "abcdefgh") == "abcde…[truncated]"
    assert one(spark, lambda k, t: x.shrink(k, t, 5), "text", "abcdefgh") == "abcdefgh"
    assert one(spark, lambda r, k: x.should_index(r, k, False), "assistant", "text") is False
    assert one(spark, lambda r, k: x.should_index(r, k, False), "user", "text") is True


def test_commands(spark):
    assert one(spark, x.bash_command, 'Bash {"command":"go test ./x"}') == "go test ./x"
    assert one(spark, x.bash_command, 'Bash {"command":"go te') == ""
    assert one(spark, lambda c: x.normalize_command(c, "/home/me"), "cat /home/me/a1 12 deadbeef7") == "cat ~/a1 <x> <x>"
    assert one(spark, x.is_trivial_command, " git  status ") is True and one(spark, x.is_trivial_command, "git push") is False


def test_small_ones(spark):
    assert one(spark, x.slugify, " Hello, World! ") == "hello-world" and one(spark, x.slugify, "!!") == "candidate"
    assert one(spark, x.extract_json, "a {b {c}} d") == "{b {c}}" and one(spark, x.first_line, "a\nb") == "a"
    assert one(spark, x.decode_project_dir, "Users-me-src") == "/Users/me/src" and one(spark, x.decode_project_dir, "2024-01") == "2024-01"
    assert one(spark, lambda c: x.truncate_head(c, 3), "abcdef") == "…def" and one(spark, x.strip, "   a ") == "a"
    assert x.clamp(None, 20, 100) == 20 and x.clamp(500, 20, 100) == 100 and x.clamp(-1, 20, 100) == 20


def test_since():
    now = datetime(2026, 1, 10, tzinfo=timezone.utc)
    assert x.parse_since("7d", now) == now - timedelta(days=7) and x.parse_since("1h30m", now) == now - timedelta(minutes=90) and x.parse_since("") is None
    with pytest.raises(ValueError):
        x.parse_since("soon")


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [3.0, 4.0], [0.0, 0.0], [1.0])], "a array<float>, b array<float>, z array<float>, s array<float>")
    c = F.col
    got = df.select(v.cosine(c("a"), c("b")), v.cosine(c("a"), c("z")), v.cosine(c("a"), c("s")), v.normalize(c("a")), v.normalize(c("z")), v.squared_distance(c("a"), c("z"))).first()
    assert got[0] == pytest.approx(1) and got[1] == 0 and got[2] is None and got[3] == pytest.approx([0.6, 0.8]) and got[4] == [0, 0] and got[5] == 25
