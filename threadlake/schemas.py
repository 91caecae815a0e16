"""Tables of the archive, their closed vocabularies, and coercion on write."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SESSIONS = "id string, title string, project_path string, git_branch string, started_at timestamp, ended_at timestamp, message_count int, file_path string, has_transcript boolean, record_kind string, vendor string"
MESSAGES = "uuid string, parent_uuid string, session_id string, role string, kind string, tool_name string, source string, timestamp timestamp, seq long, is_sidechain boolean, text string"
PROMPTS = "session_id string, project string, text string, timestamp timestamp, seq long"
PLANS = "id string, title string, project_path string, file_path string, content string, mod_time timestamp, vendor string"
EMBEDDINGS = "session_id string, seq long, model string, dim int, vector array<float>, text_hash string, created_at timestamp"
SUMMARIES = "session_id string, model string, source_hash string, summary string, created_at timestamp"
LEDGER = "path string, session_id string, content_hash string, updated_at timestamp"

ROLES = ("user", "assistant")
KINDS = ("text", "thinking", "tool_use", "tool_result", "image")
SOURCES = ("transcript", "history", "plan")
RECORD_KINDS = ("chat", "plan")
VENDORS = {"claude": "Claude Code", "claude-desktop": "Claude Desktop", "cursor": "Cursor", "opencode": "OpenCode", "codex": "Codex"}


def schema(ddl: str) -> T.StructType:
    return T._parse_datatype_string(ddl)  # noqa: SLF001


def coerce_vendor(vendor: Column) -> Column:
    """An unknown vendor becomes the default one, on write and in filters alike."""
    return F.when(vendor.isin(*VENDORS), vendor).otherwise(F.lit("claude"))


def coerce_kind(kind: Column) -> Column:
    return F.when(kind.isin(*RECORD_KINDS), kind).otherwise(F.lit("chat"))


def known_vendor(vendor: str) -> str:
    return vendor if vendor in VENDORS else "claude"


def vendor_label(vendor: Column) -> Column:
    label = F.lit(VENDORS["claude"])
    for name, shown in VENDORS.items():
        label = F.when(vendor == name, shown).otherwise(label)
    return label


def vendor_from_id(session_id: Column) -> Column:
    """Vendor of rows from before the column existed, told by the prefix of the id."""
    return (
        F.when(session_id.startswith("cursor"), "cursor").when(session_id.startswith("codex:"), "codex").when(session_id.startswith("opencode:"), "opencode").otherwise("claude")
    )
