"""Queries of the general operators over the archive's tables: hierarchies (p2) and times (p7)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlake.operators.hierarchy import ancestors, hierarchy
from threadlake.operators.timestamps import USUAL, epoch_from_number, normalize_times
from threadlake.session import cut, table

DEEP = 100  # ancestors from which a record below a true root is reported


def _places(spark: SparkSession, sf_dir: str, src: str, positions: bool) -> DataFrame:
    key, parent, near = {"samples": ("uuid", "parentUuid", ["sessionId", "rec_id"]), "messages": ("uuid", "parent_uuid", ["session_id", "seq"])}[src]
    return hierarchy(table(spark, sf_dir, src), key, parent, near, positions)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = []
    for src in ("samples", "messages"):
        places = _places(spark, sf_dir, src, positions=False)
        told = places.filter((F.col("kind") != "root") | (F.col("depth") >= DEEP))
        found.append(told.select(F.lit(src).alias("src"), F.col("key").alias("uuid"), F.col("top").alias("top_uuid"), "depth"))
    return found[0].unionByName(found[1])


def _both(of_src) -> DataFrame:
    found = [of_src(src).select(F.lit(src).alias("src"), "*") for src in ("samples", "messages")]
    return found[0].unionByName(found[1])


def p2_tree_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record of samples and messages with its depth, root, place in the tour and number of descendants."""
    return _both(lambda src: _places(spark, sf_dir, src, positions=True).select("key", "top", "depth", "kind", "entry", "exit", "descendants"))


def p2_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record of samples and messages with each of its ancestors: by ancestor_depth its path, by ancestor the descendants."""
    return _both(lambda src: ancestors(cut(_places(spark, sf_dir, src, positions=True), "places")))


def session_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    zones = table(spark, sf_dir, "project_zones").select("project_path", "zone")
    return table(spark, sf_dir, "sessions").select(F.col("id").alias("owner"), "project_path").join(F.broadcast(zones), "project_path").select("owner", "zone")


def rollout_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    zones = table(spark, sf_dir, "project_zones").select("project_path", "zone")
    meta = table(spark, sf_dir, "envelopes").filter(F.col("type") == "session_meta")
    cwd = F.coalesce(F.get_json_object("payload", "$.cwd"), F.nullif(F.regexp_extract("payload", r'"cwd"\s*:\s*"([^"\\]*)"', 1), F.lit("")))
    named = meta.select(F.col("rollout_id").alias("owner"), cwd.alias("project_path"), "line_no").filter("project_path is not null")
    first = named.groupBy("owner").agg(F.min_by("project_path", F.struct("line_no", "project_path")).alias("project_path"))
    return first.join(F.broadcast(zones), "project_path").select("owner", "zone")


YEARS = (2025, 2027)  # all times of the tables lie in these years; a count of another time is none


def _times(spark: SparkSession, sf_dir: str, only: dict[str, Column]) -> DataFrame:
    """src, row_key, epoch_us, told of the rows of the four tables for which only[src] holds."""
    zones = {"messages": session_zones, "envelopes": rollout_zones}
    whole = None
    for src, key, column, owner in (("messages", "rowid", "timestamp", "session_id"), ("envelopes", "env_id", "timestamp", "rollout_id"), ("history", "hist_id", "timestamp", None), ("local_sessions", "sessionId", "createdAt", None)):
        rows = table(spark, sf_dir, src).filter(only.get(src, F.lit(True)))
        if owner:
            part = normalize_times(rows.select(key, column, owner), key, column, owner, zones[src](spark, sf_dir), YEARS)
        else:
            part = rows.select(F.col(key).cast("string").alias("key"), epoch_from_number(F.col(column), YEARS).alias("epoch_us")).withColumn("told", F.when(F.col("epoch_us").isNotNull(), "zone"))
        part = part.select(F.lit(src).alias("src"), F.col("key").alias("row_key"), "epoch_us", "told")
        whole = part if whole is None else whole.unionByName(part)
    return whole


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    spelt, counted = ~F.col("timestamp").rlike(USUAL), lambda c: ~F.col(c).between(10**11, 10**14 - 1)
    unusual = {"messages": spelt, "envelopes": spelt, "history": counted("timestamp"), "local_sessions": counted("createdAt")}
    return _times(spark, sf_dir, unusual).filter(F.col("epoch_us").isNotNull()).select("src", "row_key", "epoch_us")


def p7_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of the four tables with its instant and how it was found (null: it tells no time, or no zone is known)."""
    return _times(spark, sf_dir, {})


def p2_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p2_tree_sizes of records neither on a circle nor below one, without the places in the tour, which SQL does not have."""
    return p2_tree_sizes(spark, sf_dir).filter("kind <> 'circle'").drop("entry", "exit")


QUERIES = {"p2_found": p2_found, "p2_tree_sizes": p2_tree_sizes, "p2_sizes": p2_sizes, "p2_paths": p2_paths, "p7_found": p7_found, "p7_times": p7_times}
_TRIM = "nullif(lower(regexp_replace({0}, '^\\s+|\\s+$', '', 'g')), '')"
# up(src, key, anc): all ancestors, circles closed; what is its own ancestor stands on a circle
_CLOSED = f"""with recursive r as (select 'samples' src, {_TRIM.format("uuid")} as "key", {_TRIM.format('"parentUuid"')} p from samples union all select 'messages', {_TRIM.format("uuid")}, {_TRIM.format("parent_uuid")} from messages),
n as (select src, key, min(p) p from r where key is not null group by src, key),
e as (select a.src, a.key, a.p from n a join n b on b.src = a.src and b.key = a.p),
up as (select src, key, p anc from e union select up.src, up.key, e.p from up join e on e.src = up.src and e.key = up.anc),
ring as (select src, key from up where key = anc),
circle as (select r.src, r.key, min(up.anc) least from ring r join up on up.src = r.src and up.key = r.key group by all),
facts as (select n.src, n.key, n.p, c.least own, any_value(u.least) above, count(up.anc) n, count(u.key) on_circle from n left join circle c on c.src = n.src and c.key = n.key left join up on up.src = n.src and up.key = n.key left join circle u on u.src = up.src and u.key = up.anc group by all),
tops as (select f.src, f.key, g.key as top, g.p is not null orphan from facts f left join up on up.src = f.src and up.key = f.key join facts g on g.src = f.src and g.n = 0 and g.key = case when f.n = 0 then f.key else up.anc end where f.own is null and f.on_circle = 0),
told as (select f.src, f.key, coalesce(f.own, f.above, t.top) top, case when f.own is not null then 0 else f.n - f.on_circle + (f.on_circle > 0)::integer end::integer depth, case when f.own is not null or f.above is not null then 'circle' when t.orphan then 'orphan' else 'root' end kind from facts f left join (select distinct * from tops) t on t.src = f.src and t.key = f.key)"""
SQL: dict[str, str] = {
    "p2_found": f"{_CLOSED} select src, key as uuid, top as top_uuid, depth from told where kind <> 'root' or depth >= {DEEP}",
    "p2_paths": f"{_CLOSED} select up.src, up.key, anc as ancestor, told.depth as ancestor_depth from up join told on told.src = up.src and told.key = anc join told t on t.src = up.src and t.key = up.key where t.kind <> 'circle' or (t.depth > 0 and told.depth > 0) union all select x.src, y.key, n.p, 0 from told x join n on n.src = x.src and n.key = x.key join (select src, key, key a from told union all select src, key, anc from up) y on y.src = x.src and y.a = x.key where x.kind = 'circle' and x.depth = 1",
    "p2_sizes": f"{_CLOSED}, below as (select src, anc as key, count(*) d from up group by all) select told.src, told.key, top, depth, kind, coalesce(d, 0) descendants from told left join below on below.src = told.src and below.key = told.key where kind <> 'circle'",
}
