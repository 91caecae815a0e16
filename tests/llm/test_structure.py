import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadlake.llm import clusters, conversations, sequences, vectors


# ---- subsequences
def holds(seq, pattern):
    it = iter(seq)
    return all(step in it for step in pattern)


def test_shortening_keeps_all_patterns():
    rng = random.Random(1)
    for _ in range(200):
        seq = [rng.choice("abcd") for _ in range(rng.randint(0, 40))]
        short = [seq[i] for i in sequences.shorten(seq, 3)]
        for n in (1, 2, 3):
            for p in itertools.product("abcd", repeat=n):
                assert holds(seq, p) == holds(short, p)


@pytest.mark.parametrize("block", [20_000, 7])
def test_patterns_against_counting_all(spark, monkeypatch, block):
    monkeypatch.setattr(sequences, "PIECE", 4)
    monkeypatch.setattr(sequences, "FAN", 2)
    monkeypatch.setattr(sequences, "BLOCK", block)
    rng = random.Random(2)
    db = {f"s{i}": [rng.choice("abc") for _ in range(rng.randint(0, 30 if i == 0 else 9))] for i in range(40)}
    rows = [(s, k, 1, x) for s, xs in db.items() for k, x in enumerate(xs)]
    rows += [("s1", 0, 0, "z"), (None, 1, 1, "a"), ("s2", None, 1, "a"), ("only-null", 0, 1, None)]
    got = {tuple(r["pattern"]): r["support"] for r in sequences.frequent_patterns(spark.createDataFrame(rows, "entity string, seq long, tie long, step string"), share=0.3, least=5).collect()}
    entities = [s for s in db if db[s]] + ["only-null"]
    least = max(5, -(-3 * len(entities) // 10))
    exact = {p: n for k in (3, 4, 5) for p in itertools.product("abc", repeat=k) if (n := sum(holds(db[s], p) for s in db)) >= least}
    assert got == exact and exact


def test_no_steps_give_no_patterns(spark):
    assert sequences.frequent_patterns(spark.createDataFrame([], "entity string, seq long, tie long, step string")).count() == 0


def test_step_names(spark):
    rows = [("Bash ", 'Bash {"command":"go test"}'), ("BASH", 'Bash {"timeout":1,"command":" npm  ci"}'), (None, 'Bash {"command":"jq ."}'), (None, "Read {}"), (" Grep", "x"), ("Bash", "Bash {broken"), (None, None)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string, x string").select(sequences.step_name(F.col("t"), F.col("x"))).collect()]
    assert got == ["bash:go", "bash:npm", "bash:jq", "read", "grep", "bash:", None]


# ---- conversations
def test_judging_sessions(spark):
    rows = []

    def add(session, *turns, at="2026-01-01"):
        for seq, role, text in turns:
            rows.append((len(rows), session, seq, role, "text", False, text, at))

    add("good", (0, " User", "hi"), (1, "ASSISTANT\n", "yo"))
    add("gap", (0, "user", "hi"), (2, "assistant", "yo"))
    add("late", (1, "user", "hi"), (2, "assistant", "yo"))
    add("mute", (0, "user", "hi"))
    add("alone", (0, "assistant", "yo"))
    add("open", (0, "user", "hi"), (1, "assistant", "yo"), (2, "user", "more"))
    add("blank", (0, "user", "hi"), (1, "assistant", " ​ "))
    add("copied", (0, "user", "hi"), (1, "assistant", "yo"))
    add("copied", (1, "assistant", ""), at="2026-01-02")
    add("nulls", (0, "user", "hi"), (None, "assistant", "yo"))
    add(None, (0, "user", "hi"))
    df = spark.createDataFrame(rows, "rowid long, session_id string, seq long, role string, kind string, is_sidechain boolean, text string, indexed_at string")
    times = df.select("rowid", (F.col("rowid") * 1_000_000).alias("epoch_us"))
    got = {r["session_id"]: r["reason"] for r in conversations.judge(conversations.sessionize(df, times)).collect()}
    assert got == {"good": None, "gap": "missing rows", "late": "missing rows", "mute": "no assistant turn", "alone": "no user turn", "open": "no reply", "blank": "no assistant turn", "copied": "no assistant turn", "nulls": "missing rows"}
    turns = [(r["session_id"], r["turn"], r["speaker"], r["text"]) for r in conversations.conversations(df, times).orderBy("session_id", "turn").collect()]
    assert turns == [("good", 0, "user", "hi"), ("good", 1, "assistant", "yo")]
    assert conversations.judge(conversations.sessionize(df.limit(0), times)).count() == 0 and conversations.conversations(df, times.limit(0)).count() == 2


@pytest.mark.parametrize("chunk", [4, 50_000])
def test_sessions_in_stretches(spark, monkeypatch, chunk):
    """A session over many stretches is that of one: turns, speakers, episodes against a plain loop."""
    monkeypatch.setattr(conversations, "CHUNK", chunk)
    rng, rows, want = __import__("random").Random(4), [], []
    for s in range(6):
        at, turn, episode, last, said = 0, 0, 0, None, []
        for seq in range(40):
            timed = rng.random() < 0.8
            at += timed * (10_000 if rng.random() < 0.03 else 1)
            said.append((seq, rng.choice(["user", "assistant", None, "tool"]) if seq < 39 else "assistant", at if timed else None))
        known = lambda seqs: next((r for q, r, _ in seqs if r in ("user", "assistant")), None)
        for seq, role, us in said:
            before, after = known(reversed(said[:seq])), known(said[seq + 1 :])
            if us is not None:
                episode += last is not None and us - last > 1_000
                last = us
            around = {before, after} - {None}
            other = {"user": "assistant", "assistant": "user"}[around.pop()] if role is None and len(around) == 1 else None
            who = role if role in ("user", "assistant") else other
            if who:
                want.append((f"s{s}", seq, turn, episode, who, role is None, f"t{seq}"))
                turn += 1
            rows.append((f"s{s}", seq, role, "text", None, f"t{seq}", "2026-01-01", us, s * 100 + seq))
    df = spark.createDataFrame(rows, "session_id string, seq long, role string, kind string, is_sidechain boolean, text string, indexed_at string, epoch_us long, rowid long")
    monkeypatch.setattr(conversations.sessionize, "__defaults__", (False, 0.9))
    got = sorted((r["session_id"], r["seq"], r["turn"], r["episode"], r["speaker"], r["inferred"], r["text"]) for r in conversations.conversations(df).collect())
    assert got == sorted(want)


def test_speakers_are_inferred(spark):
    rows = [("User", "text"), (None, "tool_use"), (" ", "tool_result"), (None, "text"), ("system", "text")]
    assert [r[0] for r in spark.createDataFrame(rows, "r string, k string").select(conversations.speaker(F.col("r"), F.col("k"))).collect()] == ["user", "assistant", "user", None, "system"]


# ---- vectors and clusters
def table_of(spark, rows):
    return spark.createDataFrame(rows, "message_rowid long, model string, dim int, vector array<float>, created_at string")


def test_usable_vectors(spark):
    nan = float("nan")
    rows = [(1, "m", 2, [1.0, 0.0], "1"), (1, "m", 2, [0.0, 1.0], "2"), (2, "m", 2, [0.0, 0.0], "1"), (3, "m", 2, [nan, 1.0], "1"), (4, "m", 2, [1.0], "1"), (5, "m", 2, None, "1"), (6, "m", 2, [1.0, None], "1"), (7, "m", 2, [float("inf"), 1.0], "1"), (8, "n", 1, [2.0], "1"), (9, None, 1, [2.0], "1"), (10, "m", 2, [], "1")]
    got = {(r["model"], r["rowid"], tuple(r["vector"])) for r in vectors.usable_vectors(table_of(spark, rows)).collect()}
    assert got == {("m", 1, (0.0, 1.0)), ("n", 8, (2.0,))}


def cloud(n=600, dim=32, seed=5):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    for i in range(0, n // 2, 5):  # near-copies and copies
        x[i + 1 : i + 4] = x[i] + rng.normal(size=(3, dim)) * 0.15
        x[i + 4] = x[i]
    return x.astype(np.float32)


def test_recall_of_similar_vectors_against_all_pairs(spark):
    x = cloud()
    x[590:600] = x[0]  # more copies than k
    df = spark.createDataFrame([("m", i, [float(v) for v in r]) for i, r in enumerate(x)] + [("other", 0, [1.0, 0.0])], "model string, rowid long, vector array<float>")
    got = {(r["rowid"], r["near"]) for r in vectors.similar_vectors(df).collect()}
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    c = u @ u.T
    want = set()
    for i in range(len(x)):
        order = sorted((j for j in range(len(x)) if j != i and c[i, j] >= 0.95), key=lambda j: (-round(c[i, j], 9), j))
        want |= {(i, j) for j in order[:5]}
    assert len(got & want) >= 0.97 * len(want) and len(got - want) <= 0.03 * len(want)


def test_hot_buckets_and_no_vectors(spark, monkeypatch):
    monkeypatch.setattr(vectors, "HOT", 20)
    x = cloud(200)
    df = spark.createDataFrame([("m", i, [float(v) for v in r]) for i, r in enumerate(x)], "model string, rowid long, vector array<float>")
    assert vectors.similar_vectors(df).count() > 100
    assert vectors.similar_vectors(df.limit(0)).count() == 0


def rows_of(spark, x):
    return spark.createDataFrame([("m", i, [float(v) for v in r]) for i, r in enumerate(x)], "model string, rowid long, vector array<float>")


def planted_pairs(n, dim, cosine, seed=11):
    """Rows 2i and 2i + 1 have the cosine."""
    rng = np.random.default_rng(seed)
    a, e = rng.normal(size=(n, dim)), rng.normal(size=(n, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    e -= (e * a).sum(axis=1, keepdims=True) * a
    e /= np.linalg.norm(e, axis=1, keepdims=True)
    return np.stack([a, cosine * a + np.sqrt(1 - cosine**2) * e], axis=1).reshape(2 * n, dim)


@pytest.mark.parametrize("rows", [78_000, 5_000_000])
def test_recall_at_the_least_cosine_at_any_size(spark, rows):
    x = planted_pairs(1000, 96, 0.951)
    groups, _ = vectors.vector_groups(rows_of(spark, x), 6)
    groups = groups.cache()
    number = {r["gid"]: r["heads"][0] for r in groups.collect()}
    got = {tuple(sorted((number[r["a"]], number[r["b"]]))) for r in vectors.candidate_pairs(groups, rows, 5, 0.95).collect()}
    assert sum((2 * i, 2 * i + 1) in got for i in range(1000)) >= 985


def test_recall_in_hot_buckets(spark, monkeypatch):
    monkeypatch.setattr(vectors, "HOT", 20)
    monkeypatch.setattr(vectors, "BLOCK", 64)
    rng = np.random.default_rng(4)
    x = (np.eye(96)[0] + rng.normal(size=(500, 96)) * 0.015).astype(np.float32)  # all near each other
    got = {(r["rowid"], r["near"]) for r in vectors.similar_vectors(rows_of(spark, x)).collect()}
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    c = u @ u.T
    np.fill_diagonal(c, -1)
    want = {(i, j) for i in range(500) for j in np.argsort(-c[i])[:5].tolist() if c[i, j] >= 0.95}
    assert len(want) == 2500 and len(got & want) >= 0.99 * len(want)


def test_nearest_of_every_vector_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 90)
    x = cloud(400)
    x[390:400] = x[0]  # more copies than k
    x[380:390] = 2 * x[3]  # equal cosines of vectors that are no copies
    other = spark.createDataFrame([("other", 0, [1.0, 0.0]), ("other", 1, [-1.0, 0.0])], "model string, rowid long, vector array<float>")
    got = {}
    for r in vectors.nearest_vectors(rows_of(spark, x).unionByName(other)).collect():
        got.setdefault((r["model"], r["rowid"]), set()).add(r["near"])
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    c = u @ u.T
    want = {("m", i): set(sorted((j for j in range(400) if j != i), key=lambda j: (-round(c[i, j], 9), j))[:5]) for i in range(400)}
    assert got == want | {("other", 0): {1}, ("other", 1): {0}}
    assert vectors.nearest_vectors(other.limit(0)).count() == 0


def test_probes_are_distinct_and_in_order():
    found = vectors.probe_order(10, 50)
    assert len(set(found)) == 50 and found[0] == (0,) and all(19 - r not in p for p in found for r in p)


def balls(sizes, dim=64, seed=9):
    rng = np.random.default_rng(seed)
    out = []
    for k, n in enumerate(sizes):
        centre = rng.normal(size=dim)
        centre /= np.linalg.norm(centre)
        for _ in range(n):
            e = rng.normal(size=dim)
            e -= (e @ centre) * centre
            e /= np.linalg.norm(e)
            out.append((k, 0.9 * centre + 0.435 * e))
    return out


def test_clusters_of_planted_groups(spark, monkeypatch):
    monkeypatch.setattr(clusters, "BLOCK", 16)
    planted = balls([60, 25, 10, 9, *[1] * 40])
    planted += [(1, planted[70][1])] * 6  # copies
    df = spark.createDataFrame([("m", i, [float(x) for x in v]) for i, (_, v) in enumerate(planted)], "model string, id long, vector array<float>")
    got = {}
    for r in clusters.cluster_vectors(df).collect():
        got.setdefault(r["component"], set()).add(r["id"])
    want = {}
    for i, (k, _) in enumerate(planted):
        want.setdefault(k, set()).add(i)
    assert sorted(map(sorted, got.values())) == sorted(sorted(g) for g in want.values() if len(g) >= 10)
    assert clusters.cluster_vectors(df.limit(0)).count() == 0


def planted_cases(groups, size, cosine, dim=96, seed=21):
    """Groups of which every two vectors have about the cosine, as many as meet the definition at 0.74."""
    rng = np.random.default_rng(seed)
    out = []
    while len(out) < groups:
        x = np.sqrt(cosine) * rng.normal(size=dim) + np.sqrt(1 - cosine) * rng.normal(size=(size, dim))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        if (2 * ((x @ x.T >= 0.74).sum(axis=1) - 1) >= size - 1).all():
            out.append(x)
    return np.concatenate(out)


@pytest.mark.parametrize(("exact", "block"), [(200_000, 2_000), (0, 40)])
@pytest.mark.parametrize("cosine", [0.755, 0.78])
def test_small_clusters_near_the_least_cosine_stay_whole(spark, monkeypatch, exact, block, cosine):
    shape = clusters.minhash_rows
    monkeypatch.setattr(clusters, "EXACT", exact)
    monkeypatch.setattr(clusters, "BLOCK", block)
    monkeypatch.setattr(clusters, "WIDE", 300)
    monkeypatch.setattr(clusters, "minhash_rows", lambda v, rows, c: shape(v, 77_760, c))  # the bands of a larger table
    x = planted_cases(100, 10, cosine)
    df = spark.createDataFrame([("m", i, [float(v) for v in r]) for i, r in enumerate(x)], "model string, id long, vector array<double>")
    got = {}
    for r in clusters.cluster_vectors(df).collect():
        got.setdefault(r["component"], set()).add(r["id"])
    assert sum(set(range(10 * k, 10 * k + 10)) in got.values() for k in range(100)) == 100


def test_equal_vectors_are_one_record_until_the_end(spark):
    x = planted_cases(2, 10, 0.8)
    many = [x[0]] * 500 + [x[3]] * 7 + [v for i, v in enumerate(x) if i not in (0, 3)]
    alone = np.random.default_rng(4).normal(size=96)
    rows = [("m", i, [float(v) for v in r]) for i, r in enumerate([*many, *[alone] * 11, *[-alone] * 9])] + [("n", 5_000 + i, [float(v) for v in alone]) for i in range(3)]
    df = spark.createDataFrame(rows, "model string, id long, vector array<double>")
    got = {}
    for r in clusters.cluster_vectors(df).collect():
        got.setdefault(r["component"], {})[r["id"]] = (r["size"], r["degree"])
    x = np.array([r for _, _, r in rows[: len(many)]])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    sizes = sorted(map(len, got.values()))
    assert sizes[0] == 10 and sizes[1] == 11 and all(len({s for s, _ in g.values()}) == 1 and len(g) == next(iter(g.values()))[0] for g in got.values())
    for members in got.values():
        if 0 in members:
            ids = sorted(members)
            for i in ids:
                assert members[i][1] == sum(j != i and (rows[i][2] == rows[j][2] or x[i] @ x[j] >= 0.74) for j in ids)


def test_loose_groups_are_split_around_medoids(spark):
    rng = np.random.default_rng(3)
    a, b = np.eye(48)[0], np.eye(48)[1]
    rows = [a + rng.normal(size=48) * 0.02 for _ in range(14)] + [b + rng.normal(size=48) * 0.02 for _ in range(12)]
    rows += [a + 0.88 * b]  # leans on both, so that they are one component
    df = spark.createDataFrame([("m", i, [float(x) for x in v]) for i, v in enumerate(rows)], "model string, id long, vector array<float>")
    got = {}
    for r in clusters.cluster_vectors(df, cosine=0.62).collect():
        got.setdefault(r["component"], set()).add(r["id"])
    assert sorted(map(len, got.values())) in ([12, 15], [13, 14])


def pairs_at(cosines, dim=96, seed=31):
    """Pairs of vectors with these cosines, each pair near no other."""
    rng = np.random.default_rng(seed)
    out = []
    for c in cosines:
        x, e = rng.normal(size=(2, dim))
        x /= np.linalg.norm(x)
        e -= (e @ x) * x
        out += [x, c * x + np.sqrt(1 - c * c) * e / np.linalg.norm(e)]
    return np.array(out)


def test_buckets_are_the_same_at_any_number_of_rows(spark):
    x = pairs_at([0.7401] * 300)
    df = spark.createDataFrame([("m", i, [float(v) for v in r]) for i, r in enumerate(x)], "model string, id long, vector array<double>")
    few, many = ({r["id"]: tuple(r["buckets"]) for r in clusters.minhash_rows(df, n, 0.74).collect()} for n in (600, 3_000_000))
    assert few == many
    assert sum(bool(set(few[2 * k]) & set(few[2 * k + 1])) for k in range(300)) >= 0.97 * 300
    # what a table of millions costs: few buckets for a vector, and few random vectors in each
    assert max(map(len, many.values())) <= 30
    assert np.mean([len(set(few[2 * k]) & set(few[2 * k + 3])) for k in range(298)]) < 0.1


@pytest.mark.parametrize("block", [8_000, 150])
def test_no_size_at_which_results_change(spark, monkeypatch, block):
    near = [0.74 + d for d in np.linspace(-3e-4, 3e-4, 100)]  # closer to the least cosine than rounded vectors tell
    x = np.concatenate([pairs_at(near), np.random.default_rng(5).normal(size=(1_000, 96))])
    monkeypatch.setattr(clusters, "BLOCK", block)
    monkeypatch.setattr(clusters, "WIDTH", 2)  # crowded buckets
    df = spark.createDataFrame([("m", i, [float(v) for v in r]) for i, r in enumerate(x)], "model string, id long, vector array<double>")
    found = {}
    for exact in (200_000, 0):
        monkeypatch.setattr(clusters, "EXACT", exact)
        got = {}
        for r in clusters.cluster_vectors(df, smallest=2).collect():
            got.setdefault(r["component"], set()).add(r["id"])
        found[exact] = sorted(map(sorted, got.values()))
    assert found[0] == found[200_000]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = [[2 * k, 2 * k + 1] for k in range(100) if x[2 * k] @ x[2 * k + 1] >= 0.74]
    assert all(g in want for g in found[0]) and len(found[0]) >= 0.95 * len(want)


def test_buckets_are_the_same_in_batches_of_any_size(spark):
    axes = np.random.default_rng((clusters.SEED, 96)).standard_normal((1, 96, clusters.WIDTH), np.float32)[0].T.astype(float)
    rng, rows = np.random.default_rng(8), []
    for i in range(300):  # as near to one direction as to another, so that rounding tells which is nearest
        p, q = axes[rng.choice(clusters.WIDTH, 2, replace=False)]
        v = p / np.linalg.norm(p) + q / np.linalg.norm(q)
        v -= v @ (p - q) / ((p - q) @ (p - q)) * (p - q)
        rows.append(("m", i, [float(e) for e in v]))
    df = spark.createDataFrame(rows, "model string, id long, vector array<double>")
    whole, parts = ({r["id"]: tuple(r["buckets"]) for r in clusters.minhash_rows(d, 300, 0.74).collect()} for d in (df.coalesce(1), df.repartition(60, "id")))
    assert whole == parts
    steps = clusters.directions(2, 1_536, clusters.WIDTH)
    assert (steps == np.rint(steps)).all() and clusters.UNIT * np.linalg.norm(steps.astype(float), axis=1).max() < 2**24


@pytest.mark.parametrize("block", [8_000, 7, 1])
def test_pairs_at_the_least_cosine_are_linked_in_blocks_of_any_size(spark, monkeypatch, block):
    monkeypatch.setattr(clusters, "BLOCK", block)
    monkeypatch.setattr(clusters, "WIDE", block)
    monkeypatch.setattr(clusters, "WIDTH", 1)  # one bucket
    rng, rows = np.random.default_rng(6), []
    for dim in (300, 600, 700):
        for _ in range(10):
            x = np.where(rng.random(dim) < 0.5, 1.0, -1.0)
            y = x.copy()
            y[rng.choice(dim, dim * 13 // 100, replace=False)] *= -1
            rows += [x, y]  # x @ y is 0.74 of dim
    df = spark.createDataFrame([("m", i, [float(e) for e in v]) for i, v in enumerate(rows)], "model string, id long, vector array<double>")
    got = {r["id"]: (r["component"], r["size"], r["degree"]) for r in clusters.cluster_vectors(df, smallest=2).collect()}
    assert got == {i: (i // 2 * 2, 2, 1) for i in range(60)}


@pytest.mark.parametrize("merged", [400_000, 5])
def test_components(spark, monkeypatch, merged):
    monkeypatch.setattr(clusters, "MERGED", merged)
    links = [(i, i + 1) for i in range(50)] + [(100, 60), (60, 61), (7, 3)]
    got = {r["id"]: r["component"] for r in clusters.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(51)}, 60: 60, 61: 60, 100: 60}
