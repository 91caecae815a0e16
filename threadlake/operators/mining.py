"""Recurring commands and prompts: n-grams of commands, k-means with a choice of k, ranking, typical members."""

from __future__ import annotations

import json
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadlake.functions.text import bash_command, is_trivial_command, normalize_command
from threadlake.functions.vector import normalize, squared_distance
from threadlake.session import cut

SHORTEST, LONGEST, GAP, LEAST_SESSIONS, SAMPLES, TOP = 2, 4, 3, 3, 5, 15
CHOICES, SAMPLE, ROUNDS, SEED = (8, 12, 16, 24, 32), 2000, 50, 42


def commands(messages: DataFrame, home: str = "") -> DataFrame:
    """(session_id, seq, command) of Bash blocks, normalised."""
    used = messages.filter((F.col("kind") == "tool_use") & (F.col("tool_name") == "Bash"))
    return used.select("session_id", "seq", normalize_command(bash_command(F.col("text")), home).alias("command"))


def command_ngrams(cmds: DataFrame, shortest: int = SHORTEST, longest: int = LONGEST, gap: int = GAP, least: int = LEAST_SESSIONS) -> DataFrame:
    """(gram array, sessions, rank): runs of consecutive commands that at least `least` sessions share.

    The seqs of a run of n span at most (n - 1) (gap + 1); its first and last command are not empty. Keyed by
    the array, so commands that hold " && " don't collide.
    """
    order = Window.partitionBy("session_id").orderBy("seq")
    ahead = cmds.select("session_id", "seq", *(F.lead("command", k).over(order).alias(f"c{k}") for k in range(longest)), *(F.lead("seq", k).over(order).alias(f"s{k}") for k in range(1, longest)))
    grams = F.array_compact(
        F.array(
            *(
                F.when((F.col(f"s{n - 1}") - F.col("seq") <= (n - 1) * (gap + 1)) & (F.col("c0") != "") & (F.col(f"c{n - 1}") != ""), F.array(*(F.coalesce(f"c{k}", F.lit("")) for k in range(n))))
                for n in range(shortest, longest + 1)
            )
        )
    )
    runs = ahead.select("session_id", grams.alias("grams")).select("session_id", F.explode("grams").alias("gram"))
    counted = runs.distinct().groupBy("gram").agg(F.count("*").alias("sessions")).filter(F.col("sessions") >= least)
    return counted.withColumn("rank", F.col("sessions") * F.size("gram"))


def rank_clusters(members: DataFrame, least: int = LEAST_SESSIONS) -> DataFrame:
    """(cluster, sessions, projects, rank) of members(cluster, session_id, project_path) with at least `least` sessions."""
    facts = members.groupBy("cluster").agg(F.count_distinct("session_id").alias("sessions"), F.count_distinct(F.nullif("project_path", F.lit(""))).alias("projects"))
    return facts.filter(F.col("sessions") >= least).withColumn("rank", F.col("sessions") * F.greatest("projects", F.lit(1)))


def centroids(members: DataFrame) -> DataFrame:
    """(cluster, centroid) of members(cluster, vector): the mean, scaled to length 1. Combined before the shuffle."""
    parts = members.select("cluster", F.posexplode("vector").alias("i", "x"))
    means = parts.groupBy("cluster", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    whole = means.groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("l"))
    return whole.select("cluster", normalize(F.transform("l", lambda p: p["m"])).alias("centroid"))


def medoids(members: DataFrame, key: str, most: int = SAMPLES) -> DataFrame:
    """(cluster, key, distance) of the members nearest to the centroid of their cluster."""
    near = members.join(F.broadcast(centroids(members)), "cluster").select("cluster", key, squared_distance(F.col("vector"), F.col("centroid")).alias("distance"))
    order = Window.partitionBy("cluster").orderBy("distance", key)
    return near.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= most).drop("_r")


class Centers:
    """k unit vectors, found by k-means++ seeding and Lloyd rounds."""

    def __init__(self, centers: np.ndarray) -> None:
        self.centers = centers

    def distances(self, points: np.ndarray) -> np.ndarray:
        return np.maximum(0, (points**2).sum(axis=1)[:, None] - 2 * points @ self.centers.T + (self.centers**2).sum(axis=1)[None, :])

    def silhouette(self, points: np.ndarray) -> float:
        """Mean of (b - a) / max(a, b) for the squared distances to the own and the next nearest centre."""
        if len(self.centers) < 2:
            return 0.0
        two = np.sort(self.distances(points), axis=1)[:, :2]
        top = two.max(axis=1)
        return float(np.mean(np.where(top > 0, (two[:, 1] - two[:, 0]) / np.where(top > 0, top, 1), 0)))


def _seed(points: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    chosen = [points[rng.integers(len(points))]]
    far = ((points - chosen[0]) ** 2).sum(axis=1)
    for _ in range(k - 1):
        p = far / far.sum() if far.sum() > 0 else None
        chosen.append(points[rng.choice(len(points), p=p)])
        far = np.minimum(far, ((points - chosen[-1]) ** 2).sum(axis=1))
    return np.stack(chosen)


def _lloyd(points: np.ndarray, k: int, seed: int, rounds: int) -> Centers:
    model = Centers(_seed(points, k, np.random.default_rng(seed)))
    for _ in range(rounds):
        own = model.distances(points).argmin(axis=1)
        new = model.centers.copy()
        for c in range(k):
            if (own == c).any():
                mean = points[own == c].mean(axis=0)
                new[c] = mean / (np.linalg.norm(mean) or 1)
        still = np.abs(new - model.centers).max() < 1e-6
        model = Centers(new)
        if still:
            break
    return model


def _sums(vectors: DataFrame, model: Centers) -> pd.DataFrame:
    """Per centre: count and sum of its points; each task combines its own, so k rows a task come back."""
    dim = model.centers.shape[1]

    def run(batches):
        total, count = np.zeros_like(model.centers), np.zeros(len(model.centers), np.int64)
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf["vector"].to_list()).astype(np.float64)
                own = model.distances(x).argmin(axis=1)
                np.add.at(total, own, x)
                count += np.bincount(own, minlength=len(count))
        yield pd.DataFrame({"cluster": range(len(count)), "n": count, "total": list(total)})

    sums = vectors.select("vector").mapInPandas(run, "cluster int, n long, total array<double>")
    added = sums.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.get("total", F.lit(i))) for i in range(dim))).alias("total"))
    return added.orderBy("cluster").toPandas()


def kmeans(vectors: DataFrame, k: int, seed: int = SEED, rounds: int = ROUNDS) -> Centers:
    """Fit on all vectors(vector, of length 1). Seeds come from a bounded sample; each round reads all rows and returns k sums.

    k is at most the number of vectors; a centre without points stays; ends when no centre moves.
    """
    vectors = cut(vectors.select("vector"), "points")  # read once a round
    seeds = np.stack([np.asarray(r[0], np.float64) for r in sample(vectors, seed).collect()])
    if vectors.count() <= SAMPLE:  # the sample is all there is
        return _lloyd(seeds, min(k, len(seeds)), seed, rounds)
    model = Centers(_seed(seeds, min(k, len(seeds)), np.random.default_rng(seed)))
    for _ in range(rounds):
        got = _sums(vectors, model)
        new = model.centers.copy()
        for cluster, n, total in zip(got["cluster"], got["n"], got["total"]):
            size = np.linalg.norm(total)
            if n and size > 0:
                new[cluster] = np.asarray(total) / size
        still = np.abs(new - model.centers).max() < 1e-6
        model = Centers(new)
        if still:
            break
    return model


def sample(vectors: DataFrame, seed: int = SEED, most: int = SAMPLE) -> DataFrame:
    """A repeatable sample of at most `most` vectors, by a hash of their content."""
    return vectors.select("vector").orderBy(F.xxhash64("vector", F.lit(seed)), "vector").limit(most)


def assign(vectors: DataFrame, model: Centers) -> DataFrame:
    """vectors with cluster (the nearest centre) and distance."""
    centers = F.array(*(F.array(*(F.lit(float(x)) for x in c)) for c in model.centers))
    options = F.transform(centers, lambda c, i: F.struct(squared_distance(F.col("vector"), c).alias("distance"), i.alias("cluster")))
    best = vectors.withColumn("_b", F.array_min(options))
    return best.withColumn("cluster", F.col("_b.cluster")).withColumn("distance", F.col("_b.distance")).drop("_b")


def pick_k(vectors: DataFrame, choices: tuple[int, ...] = CHOICES, seed: int = SEED) -> int:
    """The choice with the best simplified silhouette on a bounded sample; the smallest possible one if none applies."""
    points = np.stack([np.asarray(r[0], np.float64) for r in sample(vectors, seed).collect()])
    best, score = min(choices[0], len(points)), -2.0
    for k in choices:
        if 2 <= k <= len(points):
            if (s := _lloyd(points, k, seed, ROUNDS).silhouette(points)) > score:
                best, score = k, s
    return best


def mine_skills(units: DataFrame, k: int | None = None, top: int = TOP) -> DataFrame:
    """Candidates from clusters of users' prompts: units(key, session_id, project_path, vector, text) to (cluster, sessions, projects, rank, samples)."""
    vectors = cut(units.withColumn("vector", normalize(F.col("vector"))), "units")
    units = vectors
    members = assign(vectors, kmeans(vectors, k or pick_k(vectors)))
    ranked = rank_clusters(members).orderBy(F.desc("rank"), "cluster").limit(top)
    near = medoids(members, "key").join(units.select("key", "text"), "key")
    samples = near.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("distance", "key", "text"))), lambda x: x["text"]).alias("samples"))
    return ranked.join(samples, "cluster").orderBy(F.desc("rank"), "cluster")


def script_clusters(units: DataFrame, k: int | None = None, top: int = TOP) -> DataFrame:
    """(name, sessions, rank, samples) of clusters of commands: units as for mine_skills(), with the command as text; the most typical command names its cluster."""
    found = mine_skills(units, k, top)
    return found.select(F.coalesce(F.get("samples", F.lit(0)), F.lit("")).alias("name"), "sessions", "rank", "samples")


def label_candidates(candidates: list, chat, system: str) -> list[dict]:
    """Candidates (few rows, collected) with name and intent: asked of the model as JSON, else the first line of the most typical sample."""
    out = []
    for c in candidates:
        d = c.asDict() if hasattr(c, "asDict") else dict(c)
        samples = d.get("samples") or [d.get("name") or ""]
        label: dict = {}
        if chat is not None:
            found = re.search(r"\{.*\}", chat.chat(system, "\n".join(f"{i}. {s}" for i, s in enumerate(samples, 1))), re.DOTALL)
            try:
                label = json.loads(found.group()) if found else {}
            except ValueError:
                label = {}
        label = label if isinstance(label, dict) else {}
        first = next((line.strip() for line in (samples[0] or "").splitlines() if line.strip()), "")
        out.append(d | {"name": str(label.get("name") or d.get("name") or first or f"cluster-{d.get('cluster')}"), "intent": str(label.get("intent") or "")})
    return out


def mine_scripts(messages: DataFrame, clusters: DataFrame | None = None, home: str = "", top: int = TOP, least: int = LEAST_SESSIONS) -> DataFrame:
    """Candidates of scripts: command n-grams first, then clusters(name, sessions, rank, samples) of commands whose most typical one is not trivial."""
    grams = command_ngrams(commands(messages, home), least=least).select(F.array_join("gram", " && ").alias("name"), "gram", "sessions", "rank", F.lit(0).alias("place"))
    if clusters is not None:
        kept = clusters.filter(~is_trivial_command(F.get("samples", F.lit(0))))
        grams = grams.unionByName(kept.select("name", F.lit(None).cast("array<string>").alias("gram"), "sessions", "rank", F.lit(1).alias("place")))
    return grams.orderBy("place", F.desc("rank"), "name").limit(top).drop("place")


def slug(name: str) -> str:
    return re.sub("[^a-z0-9]+", "-", name.strip().lower()).strip("-") or "candidate"


def report_markdown(skills: list, scripts: list) -> str:
    """A report of candidates (few rows, collected)."""
    lines = []
    for title, items in (("Recurring prompts", skills), ("Recurring commands", scripts)):
        if items:
            lines += ["", f"# {title}"]
        for i, c in enumerate(items, 1):
            c = c.asDict() if hasattr(c, "asDict") else dict(c)
            lines += ["", f"## {i}. {c.get('name') or 'cluster-%s' % c.get('cluster')}", f"- Sessions: {c['sessions']}"]
            if c.get("intent"):
                lines.append(f"- Intent: {c['intent']}")
            if c.get("gram"):
                lines.append("- Steps: " + " → ".join(c["gram"]))
            if c.get("samples"):
                lines += ["- Typical:", *(f"  - {s.splitlines()[0] if s else ''}" for s in c["samples"])]
    return "\n".join(lines).lstrip("\n") + "\n"


def report_json(skills: list, scripts: list) -> str:
    """The same candidates as JSON."""
    plain = lambda c: c.asDict() if hasattr(c, "asDict") else dict(c)
    return json.dumps({"prompts": [plain(c) for c in skills], "commands": [plain(c) for c in scripts]}, ensure_ascii=False, default=str, indent=2)


def write_report(skills: list, scripts: list, folder: str) -> list[str]:
    """One file per candidate; gives their paths."""
    from pathlib import Path

    out = []
    for kind, items in (("prompt", skills), ("command", scripts)):
        for c in items:
            d = c.asDict() if hasattr(c, "asDict") else dict(c)
            path = Path(folder) / f"{kind}-{slug(str(d.get('name') or 'cluster-%s' % d.get('cluster')))}.md"
            path.parent.mkdir(parents=True, exist_ok=True)
            path.write_text(report_markdown(*(([c], []) if kind == "prompt" else ([], [c]))))
            out.append(str(path))
    return out
