"""The archive on disk: Parquet tables, replacement of sessions, ledger, upserts.

A table is a folder of versions and a pointer file to the current one: a new version is written beside the old
one and then named by the pointer, so readers see either the old or the new table. messages are laid out in
buckets of the session id; replacing sessions rewrites only the buckets they fall in.
"""

from __future__ import annotations

import os
import re
import shutil
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadlake import schemas
from threadlake.operators.retrieval import carry_over, put_embeddings
from threadlake.schemas import coerce_kind, coerce_vendor, vendor_from_id

BUCKETS = 64
TABLES = {"sessions": schemas.SESSIONS, "messages": schemas.MESSAGES + ", rowid long", "embeddings": "rowid long, model string, dim int, vector array<float>, text_hash string, created_at timestamp", "summaries": schemas.SUMMARIES, "ledger": schemas.LEDGER}


class Store:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _pointer(self, name: str) -> str:
        return f"{self.root}/{name}/CURRENT"

    def read(self, name: str) -> DataFrame:
        """The current version; an empty table before the first write. Columns added later are filled (migration)."""
        schema = schemas.schema(TABLES[name])
        if not os.path.exists(self._pointer(name)):
            return self.spark.createDataFrame([], schema)
        with open(self._pointer(name)) as f:
            got = self.spark.read.parquet(f"{self.root}/{name}/{f.read().strip()}").drop("bucket")
        return migrate(got, name)

    def search_index(self) -> str:
        """Where the inverted table of the current messages stands, or is to be built."""
        with open(self._pointer("messages")) as f:
            return f"{self.root}/search/{f.read().strip()}"

    def write(self, name: str, rows: DataFrame) -> None:
        """Replace a table as a whole; the version before the last is removed."""
        schema = schemas.schema(TABLES[name])
        version = f"v-{uuid.uuid4().hex}"
        out = rows.select(*(F.col(f.name).cast(f.dataType) for f in schema))
        owner = {"messages": "session_id", "sessions": "id"}.get(name)
        target = f"{self.root}/{name}/{version}"
        if owner:
            bucket = F.pmod(F.xxhash64(owner), F.lit(BUCKETS)).cast("int")
            out.withColumn("bucket", bucket).repartition("bucket").sortWithinPartitions("bucket", owner).write.partitionBy("bucket").parquet(target)
        else:
            out.write.parquet(target)
        old = [d for d in os.listdir(f"{self.root}/{name}") if d.startswith("v-") and d != version]
        current = open(self._pointer(name)).read().strip() if os.path.exists(self._pointer(name)) else ""
        with open(f"{self._pointer(name)}.new", "w") as f:
            f.write(version)
        os.replace(f"{self._pointer(name)}.new", self._pointer(name))
        for d in old:
            if d != current:
                shutil.rmtree(f"{self.root}/{name}/{d}", ignore_errors=True)

    def replace_sessions(self, sessions: DataFrame, messages: DataFrame) -> None:
        """Put sessions with their messages in place of the old ones with the same ids; doing it again changes nothing.

        Vectors follow unchanged texts (same session, seq and text). Sessions without messages are left out.
        """
        old_sessions, old_messages, vectors = self.read("sessions"), self.read("messages"), self.read("embeddings")
        messages = messages.withColumn("rowid", F.xxhash64("session_id", "seq"))
        talking = messages.select(F.col("session_id").alias("id")).distinct()
        sessions = sessions.join(talking, "id", "left_semi").withColumns({"vendor": coerce_vendor(F.col("vendor")), "record_kind": coerce_kind(F.col("record_kind"))})
        ids = sessions.select("id").distinct()
        gone = old_messages.join(ids.withColumnRenamed("id", "session_id"), "session_id", "left_semi")
        moved = carry_over(gone, vectors, messages)
        kept = vectors.join(gone.select("rowid"), "rowid", "left_anti")
        new_vectors = kept.unionByName(moved)
        new_sessions = old_sessions.join(ids, "id", "left_anti").unionByName(sessions)
        mine = messages.join(ids.withColumnRenamed("id", "session_id"), "session_id", "left_semi")
        new_messages = old_messages.join(ids.withColumnRenamed("id", "session_id"), "session_id", "left_anti").unionByName(mine)
        self.write("embeddings", new_vectors)
        self.write("messages", new_messages)
        self.write("sessions", new_sessions)

    def put_embeddings(self, new: DataFrame) -> None:
        """Insert or update vectors; rows of missing messages are an error."""
        strangers = new.join(self.read("messages").select("rowid"), "rowid", "left_anti")
        if strangers.limit(1).count():
            raise ValueError("embeddings of messages that are not in the archive")
        stamped = new if "created_at" in new.columns else new.withColumn("created_at", F.current_timestamp())
        self.write("embeddings", put_embeddings(self.read("embeddings"), stamped, ["rowid"]))

    def put_ledger(self, entries: DataFrame) -> None:
        self.write("ledger", upsert(self.read("ledger"), entries, ["path"], "updated_at"))

    def put_summaries(self, new: DataFrame) -> None:
        self.write("summaries", upsert(self.read("summaries"), new, ["session_id", "model"], "created_at"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], at: str) -> DataFrame:
    """old with the latest row of new for each key in its place."""
    last = Window.partitionBy(*keys).orderBy(F.desc("_new"), F.desc_nulls_last(at))
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    return both.withColumn("_r", F.row_number().over(last)).filter("_r = 1").drop("_r", "_new")


def migrate(rows: DataFrame, name: str) -> DataFrame:
    """Columns that a table of an older version lacks: vendor by the id's prefix, kind chat, others null."""
    for field in schemas.schema(TABLES[name]):
        if field.name not in rows.columns:
            value = {"vendor": vendor_from_id(F.col("id")) if "id" in rows.columns else F.lit("claude"), "record_kind": F.when(F.col("id").rlike("^(?:cursor-)?plan:"), "plan").otherwise("chat") if "id" in rows.columns else F.lit("chat")}.get(field.name, F.lit(None))
            rows = rows.withColumn(field.name, value.cast(field.dataType))
    return rows.select(*(f.name for f in schemas.schema(TABLES[name])))


def changed(catalog: DataFrame, ledger: DataFrame, force: bool = False) -> DataFrame:
    """Entries of catalog(path, content_hash) that the ledger doesn't have with the same hash."""
    return catalog if force else catalog.join(ledger.select("path", "content_hash"), ["path", "content_hash"], "left_anti")


def fingerprints(spark: SparkSession, root: str, pattern: str = "*.jsonl", options: str = "") -> DataFrame:
    """(path, content_hash) of files by path, size and time; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root).select("path", "length", "modificationTime")
    hashed = F.sha2(F.concat_ws("|", F.lit(options), "path", "length", F.unix_millis("modificationTime")), 256)
    return files.select(F.regexp_replace("path", "^file:/*", "/").alias("path"), hashed.alias("content_hash"))


def group_fingerprints(files: DataFrame, owner) -> DataFrame:
    """(session_id, content_hash): one hash over all files of a session, in order of their paths."""
    per = files.groupBy(owner.alias("session_id")).agg(F.array_sort(F.collect_list(F.struct("path", "content_hash"))).alias("l"))
    return per.select("session_id", F.sha2(F.array_join(F.transform("l", lambda x: F.concat(x["path"], x["content_hash"])), "|"), 256).alias("content_hash"))


def archive_plan(folder: str, plan_id: str, data: bytes) -> bool:
    """Keep a copy of a plan; False if an identical one is there."""
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, re.sub(r"[^\w.\-]", "_", plan_id) + ".md")
    if os.path.exists(path) and open(path, "rb").read() == data:
        return False
    with open(path, "wb") as f:
        f.write(data)
    return True
