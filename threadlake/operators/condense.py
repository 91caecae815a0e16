"""Condensing sessions to a budget of characters, and caching their summaries.

Each session's blocks are folded by Spark's own higher-order functions, in seq order: the front keeps blocks up
to 60 % of the budget, the back up to the rest, user turns always stay, and one marker tells how many were left
out.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlake.functions.text import clean_text, format_time, truncate

BUDGET, TOOL_CAP, ASSISTANT_CAP = 24_000, 400, 1_500
_CUT = " …[truncated]"


def header(title: Column, vendor: Column, project: Column, branch: Column, started: Column, ended: Column, messages: Column) -> Column:
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return F.concat(
        F.lit("# "), text(title), F.lit("\nvendor: "), text(vendor), F.lit("\nproject: "), text(project), F.lit("\n"),
        F.when(text(branch) != "", F.concat(F.lit("branch: "), branch, F.lit("\n"))).otherwise(F.lit("")),
        F.lit("started: "), format_time(started), F.lit("\nended: "), format_time(ended), F.lit("\nmessages: "), text(messages), F.lit("\n\n"),
    )


def block(role: Column, kind: Column, tool: Column, text: Column, tool_cap: int = TOOL_CAP, assistant_cap: int = ASSISTANT_CAP) -> Column:
    """A message's block: a label line and its text, by kind cleaned or cut."""
    text = F.coalesce(text, F.lit(""))
    label = F.when(kind == "tool_use", F.when(F.coalesce(tool, F.lit("")) != "", F.concat(F.lit("tool_use: "), tool)).otherwise("tool_use")).when(kind == "tool_result", "tool_result").otherwise(F.coalesce(role, F.lit("")))
    body = F.when(kind.isin("tool_use", "tool_result"), truncate(text, tool_cap, _CUT)).when(role == "user", clean_text(text)).when(role == "assistant", truncate(text, assistant_cap, _CUT)).otherwise(text)
    return F.concat(F.lit("### "), label, F.lit("\n"), body, F.lit("\n\n"))


def _run(blocks: Column, budget: Column) -> Column:
    """How many blocks from the start fit in a row; mandatory ones always fit and count."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("used"), F.lit(True).alias("open"))

    def step(s: Column, b: Column) -> Column:
        fits = s["open"] & (b["must"] | (s["used"] + F.length(b["text"]) <= budget))
        return F.struct((s["n"] + fits.cast("int")).alias("n"), (s["used"] + F.when(fits, F.length(b["text"])).otherwise(0)).alias("used"), fits.alias("open"))

    return F.aggregate(blocks, start, step, lambda s: s["n"])


def condense(sessions: DataFrame, messages: DataFrame, budget: int = BUDGET, tool_cap: int = TOOL_CAP, assistant_cap: int = ASSISTANT_CAP) -> DataFrame:
    """(session_id, text, truncated, kept, omitted) of sessions with messages.

    Thinking, images and sidechains are left out. Optional blocks are shortened before they are gathered, so a
    session's array holds at most its own shortened blocks.
    """
    kept = messages.filter(~F.col("kind").isin("thinking", "image") & ~F.coalesce("is_sidechain", F.lit(False)))
    blocks = kept.select("session_id", "seq", (F.col("role") == "user").alias("must"), block(F.col("role"), F.col("kind"), F.col("tool_name"), F.col("text"), tool_cap, assistant_cap).alias("text"))
    per = blocks.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("seq", "must", "text"))).alias("blocks"))
    heads = sessions.select(F.col("id").alias("session_id"), header(*(F.col(c) for c in ("title", "vendor", "project_path", "git_branch", "started_at", "ended_at", "message_count"))).alias("header"))
    whole = per.join(heads, "session_id").withColumn("blocks", F.transform("blocks", lambda b: F.struct(F.coalesce(b["must"], F.lit(False)).alias("must"), b["text"].alias("text"))))
    whole = whole.withColumn("n", F.size("blocks")).withColumn("full", F.concat("header", F.array_join(F.transform("blocks", lambda b: b["text"]), "")))
    whole = whole.withColumn("room", F.greatest(F.lit(budget) - F.length("header"), F.lit(0))).withColumn("fits", F.length("full") <= budget)
    share = F.floor(F.col("room") * 60 / 100).cast("int")
    whole = whole.withColumn("front", F.when(F.col("fits"), F.col("n")).otherwise(_run(F.col("blocks"), share)))
    tail = F.reverse(F.slice("blocks", F.col("front") + 1, F.greatest(F.col("n") - F.col("front"), F.lit(0))))
    whole = whole.withColumn("back", F.col("n") - F.when(F.col("fits"), 0).otherwise(_run(tail, F.col("room") - share)))
    out = lambda b, i: (i >= F.col("front")) & (i < F.col("back")) & ~b["must"]
    whole = whole.withColumn("omitted", F.size(F.filter("blocks", out)))
    first = F.get(F.filter(F.transform("blocks", lambda b, i: F.when(out(b, i), i)), lambda i: i.isNotNull()), F.lit(0))
    whole = whole.withColumn("first", first)
    marker = F.concat(F.lit("\n[... "), F.col("omitted").cast("string"), F.lit(" blocks omitted ...]\n"))
    shown = F.transform("blocks", lambda b, i: F.when(out(b, i), F.when(i == F.col("first"), marker).otherwise("")).otherwise(b["text"]))
    text = F.when(F.col("omitted") == 0, F.col("full")).otherwise(F.concat("header", F.array_join(shown, "")))
    return whole.select("session_id", text.alias("text"), (F.col("omitted") > 0).alias("truncated"), (F.col("n") - F.col("omitted")).alias("kept"), "omitted")


def summarize(condensed: DataFrame, cache: DataFrame, model: str, chat=None, refresh: bool = False) -> DataFrame:
    """(session_id, model, source_hash, summary, cached): summaries from the cache where the text is unchanged, others from the model.

    Without a model the condensed text is the summary and the cache is not used. chat(list of texts) gives a list of summaries.
    """
    hashed = condensed.select("session_id", F.lit(model).alias("model"), F.sha2("text", 256).alias("source_hash"), "text")
    if chat is None:
        return hashed.select("session_id", "model", "source_hash", F.col("text").alias("summary"), F.lit(False).alias("cached"))
    known = cache.filter(F.col("model") == model).select("session_id", "model", "source_hash", F.col("summary").alias("old")).dropDuplicates(["session_id", "model", "source_hash"])
    if refresh:
        known = known.limit(0)
    both = hashed.join(known, ["session_id", "model", "source_hash"], "left")
    hits = both.filter(F.col("old").isNotNull()).select("session_id", "model", "source_hash", F.col("old").alias("summary"), F.lit(True).alias("cached"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf[["session_id", "model", "source_hash"]].assign(summary=chat(pdf["text"].tolist()), cached=False)

    misses = both.filter(F.col("old").isNull()).select("session_id", "model", "source_hash", "text")
    return hits.unionByName(misses.mapInPandas(run, hits.schema))


def put_summaries(cache: DataFrame, new: DataFrame) -> DataFrame:
    """cache with the rows of new in place of those of the same session and model."""
    return cache.join(new.select("session_id", "model"), ["session_id", "model"], "left_anti").unionByName(new, allowMissingColumns=True)


def sweep_orphans(cache: DataFrame, sessions: DataFrame) -> DataFrame:
    """Without summaries of sessions that are gone."""
    return cache.join(sessions.select(F.col("id").alias("session_id")), "session_id", "left_semi")
