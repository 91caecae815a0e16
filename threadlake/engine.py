"""The archive's tools behind one object: search, semantic search, listing, paging, summaries, patterns, questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlake.functions.text import bash_command, clamp, parse_since
from threadlake.operators import browse, condense, fulltext, mining, retrieval
from threadlake.plans import ingest
from threadlake.session import cut
from threadlake.sources.store import Store


class Engine:
    def __init__(self, spark: SparkSession, root: str, embedder: retrieval.Embedder | None = None, chat: retrieval.ChatModel | None = None, system: dict[str, str] | None = None) -> None:
        """system: what the chat model is told to do, for 'ask', 'summarize' and 'label'."""
        self.spark, self.store = spark, Store(spark, root)
        self.embedder, self.chat, self.system = embedder or retrieval.HashingEmbedder(), chat, system or {}

    def _vectors(self) -> DataFrame:
        vectors = self.store.read("embeddings").filter(F.col("model") == self.embedder.model).select("rowid", "vector")
        side = self.store.read("sessions").select(F.col("id").alias("session_id"), "vendor", "project_path")
        return vectors.join(self.store.read("messages").select("rowid", "session_id", "role", "kind", "timestamp"), "rowid").join(side, "session_id")

    def index(self, config: ingest.IndexConfig, deep: bool = True, force: bool = False) -> ingest.IndexStats:
        stats = ingest.index(self.spark, self.store, config, deep, force)
        if stats.messages:
            self.build_search_index()
            self.store.write("summaries", condense.sweep_orphans(self.store.read("summaries"), self.store.read("sessions")))
        return stats

    def build_search_index(self) -> None:
        """Write the inverted table of the messages as they are now; searches use it until the messages change."""
        fulltext.build_index(self.store.read("messages"), "rowid", self.store.search_index())

    def _search_index(self) -> str | None:
        import os

        path = self.store.search_index() if os.path.exists(self.store._pointer("messages")) else None
        return path if path and os.path.exists(f"{path}/totals/_SUCCESS") else None

    def search_history(self, query: str, limit: int | None = None, fuzzy: bool = False, since: str = "") -> DataFrame:
        at = parse_since(since)
        where = None if at is None else F.col("timestamp") >= F.lit(at)
        hits = fulltext.search(self.store.read("messages"), self.store.read("sessions"), query, clamp(limit, 20, 100), fuzzy, where, index=self._search_index())
        return fulltext.snippets(hits, query, fuzzy) if query.strip() else hits

    def semantic_search(self, question: str, k: int | None = None, vendor: str | None = None, project: str | None = None, since: str = "") -> DataFrame:
        where = retrieval.matching(vendor, project, parse_since(since))
        vectors = self._vectors()
        if not vectors.limit(1).count():
            raise LookupError("no embeddings yet; run embed first")
        return retrieval.semantic_search(vectors, self.store.read("messages"), self.store.read("sessions"), question, self.embedder, clamp(k, 12, 50), where)

    def list_sessions(self, limit: int | None = None, project: str | None = None, vendor: str | None = None, kind: str | None = None, since: str = "") -> DataFrame:
        return browse.recent_sessions(self.store.read("sessions"), clamp(limit, 20, 200), kind, project, vendor, parse_since(since))

    def get_session(self, session_id: str, offset: int = 0, limit: int | None = None, kinds: tuple[str, ...] = browse.PAGE_KINDS, sidechains: bool = False) -> DataFrame:
        return browse.page(self.store.read("messages"), session_id, offset, limit, kinds, sidechains)

    def embed(self, force: bool = False, limit: int | None = None) -> int:
        """Embed what has no vector yet; with a limit only so many units, the next call goes on with the others."""
        units = retrieval.unembedded(self.store.read("messages"), self.store.read("embeddings"), self.embedder.model, ["rowid"], force)
        if limit:
            units = units.filter(F.col("embed_text").isNotNull()).orderBy("rowid").limit(limit)
        new = retrieval.embed(units, self.embedder, ["rowid"])
        new = cut(new, "embedded")
        self.store.put_embeddings(new)
        return new.count()

    def summarize_session(self, session_id: str, refresh: bool = False, budget: int = condense.BUDGET) -> DataFrame:
        one = condense.condense(self.store.read("sessions").filter(F.col("id") == session_id), self.store.read("messages").filter(F.col("session_id") == session_id), budget)
        chat = None if self.chat is None else lambda texts: [self.chat.chat(self.system.get("summarize", ""), t) for t in texts]
        done = condense.summarize(one, self.store.read("summaries"), getattr(self.chat, "model", "none"), chat, refresh)
        if chat is None:
            return done
        done = cut(done, "summary")
        fresh = done.filter("not cached").drop("cached").withColumn("created_at", F.current_timestamp())
        if fresh.limit(1).count():
            self.store.put_summaries(fresh)
        return done

    def mine_patterns(self, top: int | None = None, home: str = "") -> tuple[list, list]:
        top = clamp(top, 15, 50)
        vectors = self._vectors().filter((F.col("role") == "user") & (F.col("kind") == "text"))
        units = vectors.select(F.col("rowid").alias("key"), "session_id", "project_path", "vector").join(self.store.read("messages").select(F.col("rowid").alias("key"), "text"), "key")
        skills = mining.mine_skills(units, top=top).collect() if units.limit(3).count() >= 3 else []
        vectors = self._vectors().filter((F.col("kind") == "tool_use"))
        texts = self.store.read("messages").filter(F.col("tool_name") == "Bash").select(F.col("rowid").alias("key"), bash_command(F.col("text")).alias("text"))
        units = vectors.select(F.col("rowid").alias("key"), "session_id", "project_path", "vector").join(texts, "key")
        clusters = mining.script_clusters(units, top=top) if units.limit(3).count() >= 3 else None
        scripts = mining.mine_scripts(self.store.read("messages"), clusters, home, top).collect()
        label = self.system.get("label", "")
        return mining.label_candidates(skills, self.chat, label), mining.label_candidates(scripts, self.chat, label)

    def ask_history(self, question: str, k: int | None = None, vendor: str | None = None, project: str | None = None, since: str = "") -> tuple[list, str]:
        vectors = self._vectors()
        context = retrieval.ask_context(vectors, self.store.read("messages"), self.store.read("sessions"), self.embedder.embed([question])[0], clamp(k, 12, 50), retrieval.matching(vendor, project, parse_since(since)))
        return retrieval.ask(context, question, self.chat, self.system.get("ask", ""))
