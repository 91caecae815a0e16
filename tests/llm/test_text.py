import random

import pytest
from pyspark.sql import functions as F

from threadlake.llm import lookalike, packing, tokens

PATH = f"{tokens.TOKENIZERS}/{tokens.VOCABULARY}.tiktoken"


@pytest.fixture(scope="module")
def encoder():
    return tokens.Encoder(tokens.read_ranks(PATH))


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{tokens.TOKENIZERS}/{tokens.VOCABULARY}.json")
    t.encode_special_tokens = True
    return lambda s: t.encode(s, add_special_tokens=False).ids


# ---- tokens
def test_encoding_is_that_of_the_public_library(encoder, reference):
    rng = random.Random(3)
    parts = ["a", "b", " ", "  ", "\n", "\r\n", "é", "日本", "'s", "the", "ing", "1", "23", "!!", "<|endoftext|>", "🚀", "​", "ß", "\x00"]
    for _ in range(200):
        s = "".join(rng.choice(parts) for _ in range(rng.randint(0, 50)))
        assert encoder.encode(s) == reference(s)
        assert encoder.count(s) == len(encoder.encode(s))
    long = "x" * 3000 + " " * 500 + "ab" * 2000
    assert encoder.encode(long) == reference(long)


def test_appending_and_editing(encoder):
    rng = random.Random(4)
    for _ in range(60):
        s = "".join(rng.choice(["the ", "lease", "é", " 12", "\n", "  "]) for _ in range(40))
        grown, k = tokens.Growing(encoder), 0
        while k < len(s):
            step = rng.randint(1, 9)
            grown.append(s[k : k + step])
            k += step
        assert grown.ids == encoder.encode(s)
        data = s.encode()
        table = tokens.PrefixTable(encoder, data)
        a = rng.randint(0, len(data))
        b = rng.randint(a, len(data))
        table.edit(a, b, b"stale")
        assert table.last == tokens.PrefixTable(encoder, data[:a] + b"stale" + data[b:]).last
    table = tokens.PrefixTable(encoder, b"lorem ipsum dolor " * 200)
    assert table.edit(10, 12, b"zz") < 400  # not the whole text again


def test_tables_of_texts(spark, reference):
    rows = [(1, "the stale lease", "x"), (2, "", "x"), (3, None, "x"), (3, "the stale lease", "x"), (None, "<|endoftext|>", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted(((r["doc_id"], list(r["ids"])) for r in tokens.encode_texts(df, "doc_id", "text").collect()), key=repr)
    assert got == sorted(((i, reference(t) if t else []) for i, t, _ in rows), key=repr)
    assert tokens.encode_texts(df.limit(0), "doc_id", "text").count() == 0


# ---- packing
def test_fillings_are_close_to_the_best():
    import itertools

    rng = random.Random(6)
    for _ in range(50):
        sizes = [rng.randint(1, 30) for _ in range(9)]
        counts = {s: sizes.count(s) for s in sizes}
        used = packing.best_filling(counts, 40)
        best = max(sum(c) for n in range(10) for c in itertools.combinations(sizes, n) if sum(c) <= 40)
        assert sum(s * n for s, n in used.items()) == best and all(n <= counts[s] for s, n in used.items())


def test_frequent_sizes_are_ranked_in_parts(spark, monkeypatch):
    monkeypatch.setattr(packing, "SPREAD", 50)
    rows = [(i, 30 if i % 3 else 41) for i in range(900)] + [(1000, 260)]
    packed = packing.pack(spark.createDataFrame(rows, "id long, n long"), "id", "n", 100)
    held = {r["container"]: (r["pieces"], r["filled"], r["slack"]) for r in packing.containers(packed, 100).collect()}
    total = sum(n for _, n in rows)
    assert sum(f for _, f, _ in held.values()) == total and all(f <= 100 and s == 100 - f for _, f, s in held.values())
    assert len(held) <= total / 100 * 1.16 and sum(p for p, _, _ in held.values()) == 903


def test_packing_keeps_all_items_and_the_capacity(spark):
    rng = random.Random(7)
    rows = [(i, rng.choice([0, 1, 7, 7, 7, 13, 40, 100, 101, 250, rng.randint(1, 99)])) for i in range(3000)] + [(9_001, None), (9_002, -5), (5, 7), (5, 7)]
    got = packing.pack(spark.createDataFrame(rows, "id long, n long"), "id", "n", 100).collect()
    load, whole = {}, {}
    for r in got:
        if r["container"] is None:
            assert r["piece_size"] == 0
        else:
            load[r["container"]] = load.get(r["container"], 0) + r["piece_size"]
        whole.setdefault(r["id"], []).append((r["n_pieces"], r["piece_size"]))
    assert max(load.values()) <= 100 and set(load) == set(range(len(load)))
    total = sum(max(n or 0, 0) for _, n in rows)
    assert sum(load.values()) == total and len(load) <= total / 100 + 2
    assert all(len(p) == 1 or sum(x for _, x in p) > 100 or k == 5 for k, p in whole.items())
    assert packing.pack(spark.createDataFrame([], "id long, n long"), "id", "n", 100).count() == 0


# ---- look-alikes
SAME = [("Ａbc１", "Abc1"), ("café", "café"), ("ﬁle", "file"), ("a​b﻿", "ab"), ("a b", "a b"), ("a‐b", "a-b"), ("раssport", "passport"), ("ΑΒ", "AB"), ("Kelvin", "Kelvin"), ("ⅰⅴ", "iv"), ("ё", "ë"), ("ﾊﾟ", "パ")]
OTHER = [("a", "A"), ("cafe", "café"), ("x²", "x2"), ("①", "1"), ("a\tb", "a b"), ("a\nb", "a b"), ("a  b", "a b"), ("👩‍💻", "👩💻"), ("a–b", "a-b"), ("ł", "l"), ("0", "O")]


@pytest.mark.parametrize(("a", "b"), SAME)
def test_same_looking(a, b):
    assert lookalike.consistent_text(a) == lookalike.consistent_text(b)


@pytest.mark.parametrize(("a", "b"), OTHER)
def test_different_looking(a, b):
    assert lookalike.consistent_text(a) != lookalike.consistent_text(b)


def test_forms_are_stable_and_folding_is_an_option():
    for text in [x for p in SAME + OTHER for x in p]:
        once = lookalike.consistent_text(text)
        assert lookalike.consistent_text(once) == once
    assert lookalike.consistent_text("Straße", fold_case=True) == "strasse" and lookalike.consistent_text("x²", compat=True) == "x2"


def test_a_run_by_itself_is_the_whole_text():
    """Cutting a text at ASCII characters changes nothing, and a class holds all texts of one form."""
    rng = random.Random(9)
    import unicodedata

    marks = ["a", "E", "i", " ", "\n", "́", "̈", "​", "\u200d", "👩", "💻", "️", "é", "Ａ", "ﬁ", "раs", "Å", "\ue000", "가", "ᄀ", "ᅡ", "ﾊ", "ﾟ", "İ", "ß", "ς", "²", "①", "\x01", "-", "‐", "\u2028"]
    for _ in range(3000):
        text = "".join(rng.choice(marks) for _ in range(rng.randint(0, 9)))
        parts = lookalike._JOINED_EMOJI.split(text.replace("\x01", ""))
        whole = "\u200d".join(unicodedata.normalize("NFC", unicodedata.normalize("NFD", p).translate(lookalike._mapping(False))) for p in parts)
        assert lookalike.consistent_text(text) == whole
        assert "\ue000" not in text or "\ue000" in whole
        twin = text.replace("a", "а").replace("é", "é")  # letters of another script, a composed accent
        assert lookalike.consistent_text(twin) == whole and lookalike.class_key(lookalike.consistent_text(twin)) == lookalike.class_key(whole)


def test_classes_of_same_looking_rows(spark):
    rows = [(5, "abc", "x"), (2, "abс", "x"), (3, "abc", "x"), (4, "ABC", "x"), (7, "АBC", "x"), (8, "x²", "x"), (9, "x2", "x"), (1, None, "x"), (6, " ", "x"), (None, "abc", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, key string")
    got = {tuple(r) for r in lookalike.look_classes(df, "doc_id", "text").select("id", "class_id", "n_texts", "n_rows").collect()}
    assert got == {(5, 2, 2, 3), (2, 2, 2, 3), (3, 2, 2, 3), (4, 4, 2, 2), (7, 4, 2, 2)}
    assert lookalike.look_classes(df.limit(0), "doc_id", "text").count() == 0


def test_links_between_same_looking_rows(spark):
    rows = [(1, "abc"), (2, "abс"), (3, "abc"), (4, "ａbc"), (5, None), (6, " "), (7, "​"), (8, ""), (None, "abc"), (9, "xyz")]
    got = {tuple(r) for r in lookalike.same_looking(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").collect()}
    assert got == {(1, 2), (2, 3), (1, 4), (3, 4), (2, 4)}
    assert lookalike.same_looking(spark.createDataFrame([], "doc_id long, text string"), "doc_id", "text").count() == 0
