"""Text functions as column expressions (no Python runs per row)."""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

_NAME = r"[A-Za-z_][A-Za-z0-9_.\-]*"
_STANDALONE_TAG = rf"^<\s*(/\s*{_NAME}|{_NAME}([ \t].*)?)\s*>$"
_LEADING_TAGS = rf"^(?:[ \t]*<\s*{_NAME}(?:[ \t][^>]*)?\s*>)+"
_SLASH_COMMAND = r"^/\s*$|^/\s*[A-Za-z0-9_-]+([ \t].*)?$"
TITLE_LENGTH, PAYLOAD_CAP = 60, 2000


def strip(text: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def truncate(text: Column, length: int, marker: str = "…") -> Column:
    """The first `length` code points, and the marker if any were cut; null stays null."""
    return F.when(F.length(text) > length, F.concat(F.substring(text, 1, length), F.lit(marker))).otherwise(text)


def truncate_head(text: Column, length: int, marker: str = "…") -> Column:
    """The last `length` code points, behind the marker if any were cut (for paths)."""
    return F.when(F.length(text) > length, F.concat(F.lit(marker), F.call_function("right", text, F.lit(length)))).otherwise(text)


def is_standalone_tag(line: Column) -> Column:
    return line.rlike(_STANDALONE_TAG)


def is_slash_command(line: Column) -> Column:
    return line.rlike(_SLASH_COMMAND)


def is_bracket_metadata(line: Column) -> Column:
    return line.startswith("[") & line.endswith("]")


def strip_leading_tags(line: Column) -> Column:
    return F.regexp_replace(line, _LEADING_TAGS, "")


def _meaningful_lines(text: Column) -> Column:
    """Trimmed lines without blank ones, lone tags, slash commands and bracketed notes; opening tags are cut from their start."""
    lines = F.transform(F.split(text, "\n"), strip)
    kept = F.filter(lines, lambda x: (x != "") & ~is_standalone_tag(x) & ~is_slash_command(x) & ~is_bracket_metadata(x))
    return F.filter(F.transform(kept, lambda x: strip(strip_leading_tags(x))), lambda x: x != "")


def derive_title(text: Column, length: int = TITLE_LENGTH) -> Column:
    """The first meaningful line, shortened; '' if there is none or the text is null."""
    return F.coalesce(truncate(F.get(_meaningful_lines(text), F.lit(0)), length), F.lit(""))


def clean_text(text: Column) -> Column:
    """All meaningful lines; '' for null."""
    return F.coalesce(F.array_join(_meaningful_lines(text), "\n"), F.lit(""))


def should_index(role: Column, kind: Column, deep: bool = True) -> Column:
    """Deep keeps all blocks; quick keeps tool results and the user's texts."""
    return F.lit(True) if deep else (kind == "tool_result") | ((kind == "text") & (role == "user"))


def shrink(kind: Column, text: Column, cap: int = PAYLOAD_CAP, enabled: bool = True) -> Column:
    """Tool payloads cut to cap code points; other texts as they are."""
    if not enabled or cap <= 0:
        return text
    return F.when(kind.startswith("tool_"), truncate(text, cap, "…[truncated]")).otherwise(text)


def bash_command(text: Column) -> Column:
    """The command of a Bash block's text (name, blank, JSON object); '' if that is no valid JSON."""
    payload = F.regexp_extract(text, r"(?s)^\S* (.*)$", 1)
    valid = F.try_parse_json(payload)
    return F.coalesce(F.when(valid.isNotNull(), F.get_json_object(payload, "$.command")), F.lit(""))


def normalize_command(command: Column, home: str = "") -> Column:
    """The command with the home folder as ~ and numbers or longer hexadecimal words as <x>."""
    if home:
        command = F.replace(command, F.lit(home), F.lit("~"))
    return strip(F.regexp_replace(command, r"\b[0-9a-fA-F]{6,}\b|\b[0-9]+\b", "<x>"))


def is_trivial_command(command: Column) -> Column:
    squeezed = strip(F.regexp_replace(command, r"(?U)\s+", " "))
    return squeezed.isin("", "ls", "cat", "pwd", "git status")


def extract_json(text: Column) -> Column:
    """From the first { to the last }; '' without both."""
    return F.regexp_extract(text, r"(?s)\{.*\}", 0)


def first_line(text: Column) -> Column:
    return F.substring_index(text, "\n", 1)


def slugify(text: Column, default: str = "candidate") -> Column:
    slug = F.regexp_replace(F.regexp_replace(F.lower(strip(text)), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.coalesce(F.nullif(slug, F.lit("")), F.lit(default))


def number_lines(lines: Column) -> Column:
    return F.array_join(F.transform(lines, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n")


def short_id(session_id: Column, length: int = 8) -> Column:
    return F.substring(session_id, 1, length)


def text_hash(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def format_time(at: Column) -> Column:
    """RFC 3339 in UTC (session time zone UTC); '' for an unset time."""
    return F.coalesce(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(""))


TIME_MODES = ("local", "utc", "date", "off")


def display_time(at: Column, mode: str = "local", zone: str = "UTC") -> Column:
    """A time as it is shown: to the minute in the zone or in UTC, its date in the zone, or not at all; '' for an unset time (session time zone UTC)."""
    here = F.from_utc_timestamp(at, zone)
    shown = {"local": F.date_format(here, "yyyy-MM-dd HH:mm"), "utc": F.date_format(at, "yyyy-MM-dd HH:mm 'UTC'"), "date": F.date_format(here, "yyyy-MM-dd"), "off": F.lit("")}
    return F.coalesce(shown[mode], F.lit(""))


def decode_project_dir(name: Column) -> Column:
    """A folder name back to the path it stands for: - becomes / unless the name is a number."""
    return F.when(name.contains("-") & ~name.rlike("^[0-9-]+$"), F.concat(F.lit("/"), F.replace(name, F.lit("-"), F.lit("/")))).otherwise(name)


def epoch_to_timestamp(value: Column) -> Column:
    """Seconds or, from 10^12, milliseconds since 1970."""
    return F.when(value > 1_000_000_000_000, F.timestamp_millis(value)).otherwise(F.timestamp_seconds(value))


_UNITS = {"ns": 1e-9, "us": 1e-6, "µs": 1e-6, "ms": 1e-3, "s": 1, "m": 60, "h": 3600}


def parse_since(value: str, now: datetime | None = None) -> datetime | None:
    """A point in time from a duration before now: '7d', or parts like '1h30m'; None for ''."""
    value = value.strip()
    if not value:
        return None
    if m := re.fullmatch(r"(\d+)d", value):
        ago = timedelta(days=int(m[1]))
    else:
        parts = re.findall(r"(\d+(?:\.\d+)?)(ns|us|µs|ms|s|m|h)", value)
        if not parts or "".join(a + b for a, b in parts) != value.lstrip("+"):
            raise ValueError(f"no duration: {value!r}")
        ago = timedelta(seconds=sum(float(a) * _UNITS[b] for a, b in parts))
    return (now or datetime.now(timezone.utc)) - ago


def clamp(value: int | None, default: int, most: int) -> int:
    return default if not value or value <= 0 else min(value, most)
