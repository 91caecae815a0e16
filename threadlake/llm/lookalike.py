"""One consistent form for texts that look the same.

Compatibility normalisation in composed form, full case folding, mapped blanks, and removal of default-ignorable
characters give each text the key of a class (class_key). What the eye can tell apart though the key doesn't, such as
case, superscripts and circled digits, then splits the classes: consistent_text() is the form that keeps it, and only
unfolds what is drawn alike (full-width and half-width forms, ligatures, presentation forms, letters of other scripts).

Each distinct text is worked on once, and within texts each distinct run of characters beyond ASCII: what stands
between two ASCII characters is normalised by itself, since none of them composes with what precedes it.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlake.session import cut, table

# fixed values: letters of other scripts that are drawn like Latin ones, script by script
_DRAWN_ALIKE = (
    ("АВЕЅІЈКМНОРСТУХԚԜѴӀ", "ABESIJKMHOPCTYXQWVI"),
    ("аеорсухѕіјһԁԛԝѵӏ", "aeopcyxsijhdqwvl"),
    ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹϺϳϲονρ", "ABEZHIKMNOPTYXCMjcovp"),
    ("ՕՍօսոհցզյ", "OUounhgqj"),
    ("ᎠᎡᎢᎥᎪᎫᎬᎳᎷᎻᎽᏀᏃᏙᏚᏞᏟᏢᏦᏴᏏ", "DRTiAJEWMHYGZVSLCPKBb"),
    ("ⲞⲟⲤⲥⲢⲣⲎⲒⲔⲘⲚⲦⲀⲂⲈⲬⲨ", "OoCcPpHIKMNTABEXY"),
    ("ꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ", "BPDTGKJCZFMNLSRVHWXYAEIOU"),
    ("ɑα", "aa"),
    ("ɡµ", "gμ"),
)
_HYPHENS = "\u2010\u2011\ufe63\uff0d"  # fixed values: hyphens of any kind but the soft one, which shows nothing
_SHOWS_NOTHING = ((0x034F, 0x034F), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x2065, 0x2065), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFFA0, 0xFFA0), (0xE0000, 0xE0FFF))  # fixed values: default-ignorable code points that are not of category Cf
_UNFOLDED = ("<wide>", "<narrow>", "<initial>", "<medial>", "<final>", "<isolated>")
_BREAKS = "\t\n\v\f\r\x1c\x1d\x1e\x85\u2028\u2029"
_JOINED_EMOJI = re.compile("(?<=[\u2190-\u2bff\ufe0f\U0001f000-\U0001faff])\u200d(?=[\u2190-\u2bff\U0001f000-\U0001faff])")
_RUN = re.compile("[\x00-\x7f]?[^\x00-\x7f]+")
_CONTROL = re.compile("[\x00-\x08\x0e-\x1b\x7f]")  # of ASCII, those that show nothing


@lru_cache(maxsize=2)
def _mapping(compat: bool) -> dict[int, str]:
    table_: dict[int, str] = {}
    for code in range(0x110000):
        if 0xD800 <= code <= 0xDFFF:
            continue
        ch = chr(code)
        kind = unicodedata.category(ch)
        if kind == "Cf" or any(a <= code <= b for a, b in _SHOWS_NOTHING) or kind == "Cc" and ch not in _BREAKS:
            table_[code] = ""
        elif kind == "Zs" and code not in (0x20, 0x1680):
            table_[code] = " "
        elif code >= 0x80 and (parts := unicodedata.decomposition(ch)).startswith("<"):
            tag, *codes = parts.split()
            letters = "".join(chr(int(c, 16)) for c in codes)
            joined = tag == "<compat>" and kind[0] == "L" and len(letters) > 1 and letters.isalpha()
            numeral = 0x2160 <= code <= 0x217F
            if tag in _UNFOLDED or joined or numeral or compat:
                table_[code] = unicodedata.normalize("NFKD", ch)
    for drawn, latin in _DRAWN_ALIKE:
        table_ |= {ord(a): b for a, b in zip(drawn, latin, strict=True)}
    table_ |= {ord(ch): "-" for ch in _HYPHENS}
    return table_


@lru_cache(maxsize=100_000)
def _unfolded(run: str, compat: bool) -> str:
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", run).translate(_mapping(compat)))


def _short(run: str, compat: bool) -> str:
    """Runs that are long are rarely met again, and not kept."""
    return _unfolded(run, compat) if len(run) < 40 else _unfolded.__wrapped__(run, compat)


def consistent_text(text: str, fold_case: bool = False, compat: bool = False) -> str:
    if _CONTROL.search(text):
        text = _CONTROL.sub("", text)
    if not text.isascii():
        # a joiner between symbols changes what is drawn, any other shows nothing
        parts = _JOINED_EMOJI.split(text) if "\u200d" in text else [text]
        text = "\u200d".join(_RUN.sub(lambda m: _short(m.group(), compat), p) for p in parts)
    return class_fold(text) if fold_case else text


def class_fold(text: str) -> str:
    """Full case folding, composed."""
    return text.lower() if text.isascii() else unicodedata.normalize("NFC", unicodedata.normalize("NFD", text).casefold())


def class_key(shown: str) -> str:
    """The class of a text in its consistent form: compatibility normalisation, composed, and full case folding."""
    if shown.isascii():
        return shown.lower()
    return unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", shown).casefold())


def consistent_form(text: Column, fold_case: bool = False, compat: bool = False) -> Column:
    """The consistent form of each text; null stays null and '' stays ''. Whole texts of any length."""

    @F.pandas_udf("string")
    def form(values: pd.Series) -> pd.Series:
        unique = {v: consistent_text(v, fold_case, compat) for v in values.dropna().unique()}
        return values.map(unique)

    return form(text)


def _digest(text: str) -> str:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()


def digests(text: Column) -> Column:
    """(key, shown): 128 bits each of a text's class and of its consistent form; both null for null and for texts that show nothing."""

    @F.pandas_udf("key string, shown string")
    def both(values: pd.Series) -> pd.DataFrame:
        rows = []
        for v in values:
            form = consistent_text(v) if v else ""
            rows.append((_digest(class_key(form)), _digest(form)) if form.strip() else (None, None))
        return pd.DataFrame(rows, columns=["key", "shown"], dtype=object)

    return both(text)


def looks(df: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """rows(id, exact) of df, and texts(exact, key, shown, first, n): each distinct text with its digests, smallest id and number of rows.

    Texts that are null or show nothing are in rows only, and rows without id are left out. Each distinct text goes
    through Python once; after that only digests move.
    """
    rows = df.select(F.col(key).alias("id"), F.col(text).alias("text")).filter("id is not null and text is not null")
    distinct = rows.groupBy("text").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    exact = F.md5(F.encode("text", "UTF-8")).alias("exact")
    told = distinct.select(exact, digests(F.col("text")).alias("d"), "first", "n").select("exact", "d.key", "d.shown", "first", "n")
    return rows.select("id", exact), cut(told, "looks").filter("key is not null")  # filtered after writing: a filter on a text's digest would go below its grouping, and digest twice


def _classes(texts: DataFrame) -> DataFrame:
    """Those of looks()' texts that share their class, and within it their form, with another text, with the sizes of their class."""
    wide = texts.groupBy("key").agg(F.count("*").alias("t")).filter("t > 1").select("key")
    split = texts.join(wide, "key", "left_semi")
    sizes = split.groupBy("key", "shown").agg(F.count("*").alias("n_texts"), F.sum("n").alias("n_rows"), F.min("first").alias("class_id")).filter("n_texts > 1")
    return split.join(sizes, ["key", "shown"])


def same_looking(df: DataFrame, key: str, text: str) -> DataFrame:
    """Links (a, b), a < b, between rows whose texts look the same but are different strings.

    Every row is linked to the first row (smallest key) of each other string that looks like its own: all
    pairs, where strings occur once; of many copies of one string not the product with the copies of
    another, but no link between two different strings is lost (see look_classes() for membership). Rows with null
    keys, null texts and texts that show nothing are left out. Extra columns are ignored.
    """
    rows, texts = looks(df, key, text)
    classes = cut(_classes(texts).select("key", "shown", "exact", "first"), "classes")
    mine = rows.join(classes.select("key", "shown", "exact"), "exact")
    others = classes.select("key", "shown", F.col("exact").alias("other"), "first")
    linked = mine.join(others, ["key", "shown"]).filter(F.col("exact") != F.col("other"))
    return linked.select(F.least("id", "first").alias("a"), F.greatest("id", "first").alias("b")).distinct()


def look_classes(df: DataFrame, key: str, text: str) -> DataFrame:
    """(id, class_id, n_texts, n_rows) of every row with another string that looks like its own: class_id is the smallest id of all of them.

    Copies are members like any other. Nulls and texts that show nothing are left out, as in same_looking().
    """
    rows, texts = looks(df, key, text)
    return rows.join(_classes(texts).select("exact", "class_id", "n_texts", "n_rows"), "exact").drop("exact")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = same_looking(table(spark, sf_dir, "documents"), "doc_id", "text")
    return found.select(F.col("a").alias("doc_id_a"), F.col("b").alias("doc_id_b"))


def p10_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document whose text has look-alikes, with its class, the class's number of different strings and of documents."""
    return look_classes(table(spark, sf_dir, "documents"), "doc_id", "text").withColumnRenamed("id", "doc_id")


def p10_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its text in the consistent form."""
    return table(spark, sf_dir, "documents").select("doc_id", consistent_form(F.col("text")).alias("form"))


QUERIES = {"p10_found": p10_found, "p10_forms": p10_forms, "p10_classes": p10_classes}
SQL: dict[str, str] = {}
