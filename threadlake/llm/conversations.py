"""Message rows to ordered conversations with speakers.

Rows are sessionized by their channel (session_id) and sorted; a pause between their times longer than a gap calibrated
on the whole table starts a new episode. Who speaks is told by the role, or inferred: from the kind of row, and for a
text between two turns of the same speaker from them. A session is kept if its episodes together are whole and
reciprocal: no row is missing, both sides speak, and the last of the user is answered. Others are dropped, with the reason.

A session may hold any share of all rows: rows are sorted in stretches of CHUNK seq values, each by a task of its own, and
what a stretch needs from those before it (last time, speaker, counts) comes from one row for each stretch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadlake.operators.timestamps import normalize_times
from threadlake.plans.general import YEARS, session_zones
from threadlake.session import cut, table

GAP_SHARE = 0.995  # share of pauses between rows that stay within an episode
CHUNK = 50_000  # seq values that are sorted together
_TRIM = r"(?U)^[\s\p{Cf}]+|[\s\p{Cf}]+$"
# fixed values: code points that show nothing though they are neither white space, control nor format characters
_SHOWS = r"[^\s\p{Z}\p{C}\x{034F}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180F}\x{2800}\x{3164}\x{FFA0}\x{FE00}-\x{FE0F}\x{E0000}-\x{E0FFF}]|[\p{Co}]"


def shows_something(text: Column) -> Column:
    """False for null, empty, and for text of white space and invisible characters only."""
    return F.coalesce(text.rlike(_SHOWS), F.lit(False))


def speaker(role: Column, kind: Column) -> Column:
    """The role, trimmed and in lower case; where it is null or blank, inferred from the kind; null for a text."""
    said = F.nullif(F.lower(F.regexp_replace(role, _TRIM, "")), F.lit(""))
    kind = F.lower(F.regexp_replace(kind, _TRIM, ""))
    return F.coalesce(said, F.when(kind.isin("tool_use", "thinking"), "assistant").when(kind == "tool_result", "user"))


def sessionize(messages: DataFrame, times: DataFrame | None, text: bool = False, gap_share: float = GAP_SHARE) -> DataFrame:
    """Sorted rows of all sessions: session_id, seq, turn (1 user, 2 assistant, 0 none), speaker, opens (a new episode starts), stretch, (text of turns).

    messages as the table of that name, with epoch_us (the row's instant, or null) where times is None, else times(rowid, epoch_us).
    Of rows with the same session and seq the latest indexed_at counts, then the greatest rowid. A turn is a row
    of kind text, not in a sidechain, of the user or the assistant, that shows something. A text that shows something but
    whose role is null or blank gets a speaker, the other one than those of the turns around it where these
    agree, but is no turn. Rows without session_id are left out; a row without seq stands in a stretch of its own, null.
    """
    if times is not None:
        messages = messages.join(times, "rowid", "left")
    kind = F.lower(F.regexp_replace("kind", _TRIM, ""))
    shown = (kind == "text") & ~F.coalesce("is_sidechain", F.lit(False)) & shows_something(F.col("text"))
    who = speaker(F.col("role"), F.col("kind"))
    code = F.when(shown & (who == "user"), 1).when(shown & (who == "assistant"), 2).when(shown & who.isNull(), 3).otherwise(0).cast("byte")
    texts = [F.when(shown, F.col("text")).alias("text")] if text else []
    rows = messages.filter(F.col("session_id").isNotNull()).select("session_id", F.floor(F.col("seq") / CHUNK).alias("stretch"), "seq", "indexed_at", "rowid", "epoch_us", code.alias("turn"), who.alias("speaker"), *texts)
    # stretches are brought together once, for the latest rows as for their order
    parted = rows.repartition("session_id", "stretch")
    kept = ["turn", "speaker", "epoch_us", *(["text"] if text else [])]
    last = parted.groupBy("session_id", "stretch", "seq").agg(F.max_by(F.struct(*kept), F.struct("indexed_at", "rowid")).alias("r")).select("session_id", "stretch", "seq", "r.*")
    order = Window.partitionBy("session_id", "stretch").orderBy("seq")
    # what follows is read backwards: a frame that ends with the partition is computed anew for every row
    before, after = (w.rowsBetween(Window.unboundedPreceding, -1) for w in (order, Window.partitionBy("session_id", "stretch").orderBy(F.desc("seq"))))
    turns = F.when(F.col("turn").isin(1, 2), F.col("turn"))
    told = last.select(
        "*", (F.col("epoch_us") - F.last("epoch_us", ignorenulls=True).over(before)).alias("pause"), F.last(turns, ignorenulls=True).over(before).alias("said"), F.last(turns, ignorenulls=True).over(after).alias("says"),
        F.row_number().over(order).alias("place"),
    )
    told = cut(told, "sessionized")
    # a stretch's edges: its first and last time, first and last speaker; at most one row for CHUNK rows or session
    turns = F.when(F.col("turn").isin(1, 2), F.col("turn"))
    edges = told.groupBy("session_id", "stretch").agg(
        F.min_by("epoch_us", F.when(F.col("epoch_us").isNotNull(), F.col("seq"))).alias("first_us"), F.max_by("epoch_us", F.when(F.col("epoch_us").isNotNull(), F.col("seq"))).alias("last_us"), F.min(F.when(F.col("epoch_us").isNotNull(), F.col("seq"))).alias("first_seq"),
        F.min_by("turn", F.when(F.col("turn").isin(1, 2), F.col("seq"))).alias("first_turn"), F.max_by("turn", F.when(F.col("turn").isin(1, 2), F.col("seq"))).alias("last_turn"),
    )
    along = Window.partitionBy("session_id").orderBy("stretch")
    past, ahead = (w.rowsBetween(Window.unboundedPreceding, -1) for w in (along, Window.partitionBy("session_id").orderBy(F.desc("stretch"))))
    edges = edges.select(
        "session_id", "stretch", "first_seq", (F.col("first_us") - F.last("last_us", ignorenulls=True).over(past)).alias("edge_pause"), F.last("last_turn", ignorenulls=True).over(past).alias("edge_said"), F.last("first_turn", ignorenulls=True).over(ahead).alias("edge_says"),
        F.count("*").over(Window.partitionBy("session_id")).alias("stretches"),
    ).filter("stretches > 1").drop("stretches")
    pause = F.coalesce("pause", F.when(F.col("seq") == F.col("first_seq"), F.col("edge_pause")))
    whole = told.join(edges, ["session_id", "stretch"], "left").withColumn("pause", pause)
    gap = whole.agg(F.percentile_approx("pause", gap_share, 1000).alias("gap")).first()["gap"]  # one number; the mean would be pulled up by late rows
    opens = F.lit(False) if gap is None else F.coalesce(F.col("pause") > gap, F.lit(False))
    said, says = F.coalesce("said", "edge_said"), F.coalesce("says", "edge_says")
    other = F.when((F.col("turn") == 3) & (F.coalesce(said, says) == F.coalesce(says, said)), F.when(F.coalesce(said, says) == 1, "assistant").otherwise("user"))
    return whole.select(
        "session_id", "stretch", "seq", F.when(F.col("turn") == 3, 0).otherwise(F.col("turn")).cast("byte").alias("turn"), (F.col("turn") == 3).alias("inferred"), F.coalesce("speaker", other).alias("speaker"), opens.alias("opens"), "place", *(["text"] if text else [])
    )


def judge(sorted_rows: DataFrame) -> DataFrame:
    """(session_id, reason, episodes) of every session of sessionize(): reason is null for a whole conversation.

    Reasons: 'missing rows' (the seq values of all its rows don't run from 0 to their greatest without a gap),
    'no user turn', 'no assistant turn', 'no reply' (nothing from the assistant after the last user turn). A row
    without seq makes its session one with missing rows. No rows give no sessions. Stretches are told first, each by a
    few numbers, and then sessions by their stretches.
    """
    seq = F.col("seq")
    parts = sorted_rows.groupBy("session_id", "stretch").agg(
        F.count("seq").alias("n"), F.count("*").alias("all"), F.min("seq").alias("low"), F.max("seq").alias("high"), F.sum(F.col("opens").cast("int")).alias("opens"),
        F.max(F.when(F.col("turn") == 1, seq)).alias("user"), F.max(F.when(F.col("turn") == 2, seq)).alias("assistant"),
    )
    facts = parts.groupBy("session_id").agg(F.sum("n").alias("n"), F.sum("all").alias("all"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum("opens").alias("opens"), F.max("user").alias("user"), F.max("assistant").alias("assistant"))
    whole = (F.col("n") == F.col("all")) & (F.col("low") == 0) & (F.col("high") == F.col("n") - 1)
    reason = (
        F.when(~F.coalesce(whole, F.lit(False)), "missing rows")
        .when(F.col("user").isNull(), "no user turn")
        .when(F.col("assistant").isNull(), "no assistant turn")
        .when(F.col("assistant") < F.col("user"), "no reply")
    )
    return facts.select("session_id", reason.alias("reason"), (F.col("opens") + 1).alias("episodes"))


def conversations(messages: DataFrame, times: DataFrame | None = None) -> DataFrame:
    """The turns of whole conversations: session_id, seq, turn, episode, speaker, inferred, text.

    See sessionize() for the arguments. turn counts from 0 within a session; episode counts the pauses longer than
    the calibrated gap. Texts whose speaker had to be inferred stand where they were said, marked; where it can't be,
    they are left out. Sessions that judge() gives a reason for are left out.
    """
    rows = cut(sessionize(messages, times, text=True), "sorted")
    kept = judge(rows).filter("reason is null").select("session_id")
    shown = ((F.col("turn") > 0) | F.col("inferred")) & F.col("speaker").isNotNull()
    parts = rows.groupBy("session_id", "stretch").agg(F.sum(shown.cast("long")).alias("n"), F.sum(F.col("opens").cast("long")).alias("o"))
    past = Window.partitionBy("session_id").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.join(kept, "session_id", "left_semi").select("session_id", "stretch", F.coalesce(F.sum("n").over(past), F.lit(0)).alias("n0"), F.coalesce(F.sum("o").over(past), F.lit(0)).alias("o0"))
    order = Window.partitionBy("session_id", "stretch").orderBy("seq")
    counted = rows.withColumn("turn_no", F.sum(shown.cast("long")).over(order) - 1).withColumn("episode", F.sum(F.col("opens").cast("long")).over(order)).filter(shown)
    return counted.join(offsets, ["session_id", "stretch"]).select("session_id", "seq", (F.col("n0") + F.col("turn_no")).alias("turn"), (F.col("o0") + F.col("episode")).alias("episode"), "speaker", "inferred", "text")


def _timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """messages with the instant of each row."""
    messages = table(spark, sf_dir, "messages")
    keep = ["rowid", "session_id", "seq", "role", "kind", "is_sidechain", "text", "indexed_at"]
    return normalize_times(messages.select(*keep, "timestamp"), "rowid", "timestamp", "session_id", session_zones(spark, sf_dir), YEARS, keep).drop("key", "told")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(sessionize(_timed(spark, sf_dir), None)).filter("reason is not null").select("session_id")


def p5_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations(_timed(spark, sf_dir))


def p5_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns of p5_conversations whose role is told, without their episodes."""
    return conversations(_timed(spark, sf_dir)).filter("not inferred").select("session_id", "seq", "speaker", "text")


_TEXT_SHOWS = "regexp_matches(text, '[^\\s\\p{Z}\\p{C}]')"
_LATEST = f"""
with a as (
  select session_id, seq, text, row_number() over (partition by session_id, seq order by indexed_at desc nulls last, rowid desc) k,
    case when lower(trim(kind)) = 'text' and not coalesce(is_sidechain, false) and {_TEXT_SHOWS}
      then regexp_replace(lower(role), '\\s', '', 'g') end who
  from messages where session_id is not null),
b as (select session_id, count(*) n, count(seq) m, min(seq) low, max(seq) high,
    max(case when who = 'user' then seq end) u, max(case when who = 'assistant' then seq end) s
  from a where k = 1 group by session_id)"""
_BROKEN = "n <> m or low <> 0 or high <> n - 1 or u is null or s is null or s < u"
SQL = {
    "p5_found": f"{_LATEST} select session_id from b where {_BROKEN}",
    "p5_turns": f"{_LATEST} select a.session_id, a.seq, who as speaker, text from a join b using (session_id) where k = 1 and who in ('user', 'assistant') and not coalesce({_BROKEN}, true)",
}
QUERIES = {"p5_found": p5_found, "p5_conversations": p5_conversations, "p5_turns": p5_turns}
