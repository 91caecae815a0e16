"""Mixed spellings, units and zones of time to one UTC instant in microseconds.

Spellings are parsed with column expressions only. Times without an offset are local times of a zone: they
are joined as of their local time to the zone's intervals of constant offset. Where two intervals match, the
time is ambiguous (clocks were set back) and the first instant is meant; where none matches, it was skipped
(clocks were set forward) and is read with the offset before the change; else the one match gives the offset.
"""

from __future__ import annotations

from datetime import datetime, timedelta, timezone
from functools import lru_cache
from zoneinfo import ZoneInfo, available_timezones

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

YEARS = (1970, 2039)  # zone intervals are built for these years, or for those asked for
STEP = 7  # days; clocks are not changed and set back within so few
SALTS = 16

_ZONE = r"(Z|z|[A-Za-z]{2,5}|[+-]\d{2}(?::?\d{2})?)?(?:\[([^\]]+)\])?"
# each gives year|month|day|hour|minute|second|fraction|am or pm|zone|region
_SPELLINGS = {
    rf"^(\d{{4}})[-/](\d{{2}})[-/](\d{{2}})[Tt ]\s*(\d{{2}}):(\d{{2}})(?::(\d{{2}})(?:[.,](\d{{1,18}}))?)?\s*{_ZONE}$": "$1|$2|$3|$4|$5|$6|$7||$8|$9",
    rf"^(\d{{4}})(\d{{2}})(\d{{2}})[Tt](\d{{2}})(\d{{2}})(?:(\d{{2}})(?:[.,](\d{{1,18}}))?)?\s*{_ZONE}$": "$1|$2|$3|$4|$5|$6|$7||$8|$9",
    rf"^(?:[A-Za-z]{{3,9}},?\s+)?(\d{{1,2}})[ -]([A-Za-z]{{3}})[a-z]*[ -](\d{{4}}),?\s+(\d{{2}}):(\d{{2}})(?::(\d{{2}})(?:[.,](\d{{1,18}}))?)?\s*{_ZONE}$": "$3|$2|$1|$4|$5|$6|$7||$8|$9",
    rf"^(?:[A-Za-z]{{3,9}},?\s+)?([A-Za-z]{{3}})[a-z]*\.?\s+(\d{{1,2}}),?\s+(\d{{4}}),?\s+(\d{{1,2}}):(\d{{2}})(?::(\d{{2}})(?:[.,](\d{{1,18}}))?)?(?:\s*([AaPp])\.?[Mm]\.?)?\s*{_ZONE}$": "$3|$1|$2|$4|$5|$6|$7|$8|$9|$10",
}
# fixed values: minutes east of UTC of zone abbreviations
_ABBREVIATIONS = {
    "z": 0, "utc": 0, "gmt": 0, "ut": 0, "wet": 0, "west": 60, "bst": 60, "cet": 60, "cest": 120, "eet": 120, "eest": 180, "msk": 180,
    "est": -300, "edt": -240, "cst": -360, "cdt": -300, "mst": -420, "mdt": -360, "pst": -480, "pdt": -420, "akst": -540, "akdt": -480,
    "hst": -600, "brt": -180, "ist": 330, "jst": 540, "kst": 540, "sgt": 480, "hkt": 480, "awst": 480, "acst": 570, "acdt": 630, "aest": 600, "aedt": 660, "nzst": 720, "nzdt": 780,
}

USUAL = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{3}Z$"


@lru_cache(maxsize=4)
def zone_intervals(first: int = YEARS[0], last: int = YEARS[1]) -> tuple[tuple[str, int, int, int], ...]:
    """(zone, utc_from, utc_to, offset) in seconds for every IANA zone: the stretches of constant offset."""
    start, stop = datetime(first, 1, 1, tzinfo=timezone.utc), datetime(last, 1, 1, tzinfo=timezone.utc)
    days = [start + timedelta(days=d) for d in range(0, (stop - start).days + STEP, STEP)]
    found = []
    for name in sorted(available_timezones()):
        zone = ZoneInfo(name)
        offset = lambda t: int(t.astimezone(zone).utcoffset().total_seconds())  # noqa: B023, E731
        since, now = -(2**40), offset(days[0])
        for a, b in zip(days, days[1:]):
            if (then := offset(b)) != now:
                low, high = int(a.timestamp()), int(b.timestamp())
                while high - low > 1:
                    middle = (low + high) // 2
                    low, high = (middle, high) if offset(datetime.fromtimestamp(middle, timezone.utc)) == now else (low, middle)
                found.append((name, since, high, now))
                since, now = high, then
        found.append((name, since, 2**40, now))
    return tuple(found)


@lru_cache(maxsize=4)
def _segments(first: int, last: int) -> pd.DataFrame:
    by: dict[str, list[tuple[int, int, int]]] = {}
    for name, a, b, offset in zone_intervals(first, last):
        by.setdefault(name, []).append((a, b, offset))
    rows = []
    for name, spans in by.items():
        at = -(2**40)
        for k, (_, end, offset) in enumerate(spans):
            if k + 1 == len(spans):
                rows.append((name, at, 2**40, 1, offset))
                break
            after = spans[k + 1][2]
            last_here, first_there = end + offset, end + after  # local clock before and after the change
            if first_there >= last_here:  # set forward: a gap that no interval covers
                rows.append((name, at, last_here, 1, offset))
                rows.append((name, last_here, first_there, 0, offset))
            else:  # set back: both intervals cover the overlap
                rows.append((name, at, first_there, 1, offset))
                rows.append((name, first_there, last_here, 2, offset))
            at = max(last_here, first_there)
    rows = [(z, a * 1_000_000, b * 1_000_000, m, o * 1_000_000) for z, a, b, m, o in rows if a < b]
    return pd.DataFrame(rows, columns=["zone", "local_from", "local_to", "matches", "shift"])


def local_segments(spark: SparkSession, first: int = YEARS[0], last: int = YEARS[1]) -> DataFrame:
    """zone, local_from, local_to (microseconds), matches (0, 1 or 2 intervals), offset to read the time with.

    A few rows for each of the about 600 IANA zones, whatever the input: safe to broadcast.
    """
    return spark.createDataFrame(_segments(first, last), "zone string, local_from long, local_to long, matches long, shift long")


def _days(year: Column, month: Column, day: Column) -> Column:
    """Days since 1970-01-01 in the proleptic Gregorian calendar, without any session time zone."""
    y = year - F.when(month <= 2, 1).otherwise(0)
    era = F.floor(y / 400)
    yoe = y - era * 400
    doy = F.floor((153 * (month + F.when(month > 2, -3).otherwise(9)) + 2) / 5) + day - 1
    doe = yoe * 365 + F.floor(yoe / 4) - F.floor(yoe / 100) + doy
    return era * 146097 + doe - 719468


def _in_years(us: Column, years: tuple[int, int] | None) -> Column:
    if years is None:
        return us
    low = int(datetime(years[0], 1, 1, tzinfo=timezone.utc).timestamp()) * 1_000_000
    high = int(datetime(years[1] + 1, 1, 1, tzinfo=timezone.utc).timestamp()) * 1_000_000
    return F.when((us >= low) & (us < high), us)


def epoch_from_number(value: Column, years: tuple[int, int] | None = None) -> Column:
    """UTC microseconds of an integer count of seconds, milli-, micro- or nanoseconds; null where it is no time, or none of those years."""
    micros = _counted(value.cast("long"), F.lit(0))
    return _in_years(micros, years)


def parse_times(df: DataFrame, text: str) -> DataFrame:
    """df with at (microseconds; local ones where local), local, region (a zone named in brackets) for text, a spelling of time.

    at is null for null, blank, impossible dates and whatever is no time. Digits beyond microseconds are cut
    off, missing ones are zero. Impossible days, hours and minutes are no times. The steps are projections of
    their own, so that no expression is evaluated, or compiled, more than once.
    """
    # the usual spelling is read at once, and the rest of the way has nothing to do for it
    usual = F.when(F.col(text).rlike(USUAL), F.when(F.substring(F.col(text), 1, 4) > "0001", F.unix_micros(F.try_to_timestamp(F.concat(F.substring(F.col(text), 1, 23), F.lit("+00:00"))))).otherwise(0))
    own, keep = df.columns, [*df.columns, "_usual"]
    step = df.select(*own, usual.alias("_usual"))
    step = step.select(*keep, F.when(F.col("_usual").isNull(), F.regexp_replace(F.col(text), r"(?U)^[\s\p{Cf}]+|[\s\p{Cf}]+$", "")).alias("_s"))
    spelling = F.lit(None).cast("int")
    for k, pattern in reversed(list(enumerate(_SPELLINGS))):
        spelling = F.when(F.col("_s").rlike(pattern), k).otherwise(spelling)
    step = step.select(*keep, "_s", spelling.alias("_k"), F.col("_s").rlike(r"^\d{9,19}(?:[.,]\d{1,18})?$").alias("_digits"))
    fields = F.lit(None).cast("string")
    for k, (pattern, order) in reversed(list(enumerate(_SPELLINGS.items()))):
        fields = F.when(F.col("_k") == k, F.regexp_replace("_s", pattern, order)).otherwise(fields)
    step = step.select(*keep, "_s", "_digits", F.split(fields, r"\|", -1).alias("_f"))
    field = lambda k: F.try_element_at("_f", F.lit(k))
    number = lambda k: field(k).try_cast("int")
    step = step.select(
        *keep, "_digits",
        F.when(F.col("_digits"), F.regexp_extract("_s", r"^(\d+)", 1).try_cast("long")).alias("_whole"),
        F.when(F.col("_digits"), F.regexp_extract("_s", r"^\d+[.,](\d+)$", 1)).alias("_rest"),
        number(1).alias("_y"), number(2).alias("_mo"), F.lower(F.substring(field(2), 1, 3)).alias("_name"), number(3).alias("_d"), number(4).alias("_h"), number(5).alias("_mi"),
        F.coalesce(number(6), F.lit(0)).alias("_sec"), F.rpad(F.substring(field(7), 1, 6), 6, "0").try_cast("long").alias("_frac"), F.lower(field(8)).alias("_half"), F.lower(field(9)).alias("_zone"), F.nullif(field(10), F.lit("")).alias("region"),
    )
    place = F.instr(F.lit("jan feb mar apr may jun jul aug sep oct nov dec"), F.col("_name"))
    hour, half, zone, whole, rest = F.col("_h"), F.col("_half"), F.col("_zone"), F.col("_whole"), F.col("_rest")
    figures = F.regexp_replace(zone, r"[^0-9]", "")
    abbreviations = F.create_map(*(F.lit(x) for pair in _ABBREVIATIONS.items() for x in pair))
    step = step.select(
        *keep, "_digits", "_whole", "_y", "_d", "_mi", "_sec", "_frac", "_zone", "region",
        F.coalesce("_mo", F.when((place > 0) & (F.length("_name") == 3), F.floor((place - 1) / 4).cast("int") + 1)).alias("_mo"),
        F.when(half == "", hour).when(hour.between(1, 12), F.pmod(hour, F.lit(12)) + F.when(half == "p", 12).otherwise(0)).alias("_h"),
        F.when(whole < 10**11, F.rpad(F.substring(rest, 1, 6), 6, "0")).when(whole < 10**14, F.rpad(F.substring(rest, 1, 3), 3, "0")).try_cast("long").alias("_part"),
        F.substring(figures, 1, 2).try_cast("int").alias("_zh"), F.coalesce(F.nullif(F.substring(figures, 3, 2), F.lit("")).try_cast("int"), F.lit(0)).alias("_zm"), F.try_element_at(abbreviations, zone).alias("_ab"),
    )
    year, month, day = F.col("_y"), F.col("_mo"), F.col("_d")
    leap = ((year % 4 == 0) & (year % 100 != 0)) | (year % 400 == 0)
    longest = F.when(month.isin(4, 6, 9, 11), 30).when(month == 2, F.when(leap, 29).otherwise(28)).otherwise(31)
    possible = month.between(1, 12) & day.between(1, longest) & F.col("_h").between(0, 23) & F.col("_mi").between(0, 59) & F.col("_sec").between(0, 59) & (year > 1)
    clock = (_days(year, month, day).cast("long") * 86_400 + F.col("_h") * 3_600 + F.col("_mi") * 60 + F.col("_sec")) * 1_000_000 + F.col("_frac")
    sign = F.when(zone.startswith("-"), -1).otherwise(1)
    east = F.when(zone.rlike(r"^[+-]"), F.when((F.col("_zh") <= 14) & (F.col("_zm") < 60), sign * (F.col("_zh") * 60 + F.col("_zm")))).otherwise(F.col("_ab"))
    step = step.select(*keep, "_digits", _counted(whole, F.coalesce("_part", F.lit(0))).alias("_count"), F.when(possible, clock).alias("_clock"), F.coalesce(zone == "", F.lit(False)).alias("local"), east.cast("long").alias("_east"), "region")
    at = F.when(F.col("_digits"), F.col("_count")).otherwise(F.when(F.col("local"), F.col("_clock")).otherwise(F.col("_clock") - F.col("_east") * 60_000_000))
    return step.select(*own, F.coalesce(F.nullif("_usual", F.lit(0)), at).alias("at"), "local", "region")


def _counted(value: Column, part: Column) -> Column:
    """Microseconds since 1970 of a count whose size tells its unit (seconds to nanoseconds); zero and less are no time."""
    return (
        F.when(value <= 0, F.lit(None).cast("long"))
        .when(value < 10**11, value * 1_000_000 + part)
        .when(value < 10**14, value * 1_000 + part)
        .when(value < 10**17, value)
        .otherwise(F.call_function("div", value, F.lit(1000)))
        .cast("long")
    )


def resolve_local(df: DataFrame, at: str, zone: str, out: str, matches: str = "matches", years: tuple[int, int] | None = None) -> DataFrame:
    """Add out, the instant of the local time at (microseconds) in zone, and matches: of how many intervals of constant
    offset it is a time (1; 2: it occurs twice and the first is meant; 0: it was skipped). Both are null without a known
    zone. Rows are kept as they are."""
    span = (years[0] - 1, years[1] + 2) if years else YEARS
    seg = F.broadcast(local_segments(df.sparkSession, *span).withColumnsRenamed({c: f"_seg_{c}" for c in ("zone", "local_from", "local_to", "matches", "shift")}))
    hit = (F.col(zone) == F.col("_seg_zone")) & (F.col(at) >= F.col("_seg_local_from")) & (F.col(at) < F.col("_seg_local_to"))
    solved = df.join(seg, hit, "left").withColumns({out: F.col(at) - F.col("_seg_shift"), matches: F.col("_seg_matches").cast("int")})
    return solved.drop("_seg_zone", "_seg_local_from", "_seg_local_to", "_seg_matches", "_seg_shift")


def normalize_times(
    df: DataFrame, key: str, text: str, owner: str | None = None, zones: DataFrame | None = None, years: tuple[int, int] | None = None, keep: list[str] | None = None, salts: int = SALTS
) -> DataFrame:
    """(key, epoch_us, told, keep...) of every row of df whose text column tells a time.

    owner: the column that leads to a zone through zones(owner, zone), of one row per owner; without a zone
    a local time gives null. Null, blank, zero, negative, year 1 and no times give null, and so do times out of the
    years, if given. told says how the instant was found: 'zone' (the time tells its offset, or counts from 1970),
    'local' (one interval of its zone matches), 'ambiguous' (two match, the first instant is taken), 'skipped' (none
    matches, the offset before the change is taken), or null. Rows of df with the same key are rows of their own; df
    may have any further columns, of which those in keep come along. An owner that holds a large part of all rows is
    spread over `salts` tasks.
    """
    keep = keep or []
    aside = F.struct(*(F.col(c) for c in keep)) if keep else F.lit(None)
    picked = df.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text"), (F.col(owner) if owner else F.lit(None).cast("string")).alias("owner"), aside.alias("_keep"))
    parsed = parse_times(picked, "text").drop("text")
    if zones is not None:
        salted = parsed.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(salts)).cast("int"))
        spread = zones.filter(F.col("zone").isNotNull()).select(F.col("owner"), "zone").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        parsed = salted.join(spread, ["owner", "salt"], "left").select("key", "at", "local", F.coalesce("region", "zone").alias("zone"), "_keep")
    else:
        parsed = parsed.select("key", "at", "local", F.col("region").alias("zone"), "_keep")
    solved = resolve_local(parsed.select("key", "at", "local", F.when(F.col("local"), F.col("zone")).alias("zone"), "_keep"), "at", "zone", "shifted", years=years)
    epoch = _in_years(F.when(F.col("local"), F.col("shifted")).otherwise(F.col("at")), years)
    told = F.when(~F.col("local"), "zone").when(F.col("matches") == 1, "local").when(F.col("matches") == 2, "ambiguous").when(F.col("matches") == 0, "skipped")
    return solved.select("key", epoch.alias("epoch_us"), F.when(epoch.isNotNull(), told).alias("told"), *(F.col("_keep")[c].alias(c) for c in keep))
