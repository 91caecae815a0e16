"""Personal information in free text: found by a semi-Markov conditional random field and replaced by typed placeholders.

A text is cut into segments: entities of a type, and characters outside of entities. For every type all spans
between boundaries of the text's words and numbers are enumerated that keep the type's hard constraints (what it is
made of, and a greatest length); each is scored as a whole, by features of its form, of its words and of what
stands beside it, and by the type of the entity right before it. Dynamic programming over all these spans chooses
boundaries and types together. The weights are learned by maximum likelihood, with forward and backward sums over the
same spans, from sentences made by pii_training.

Whether a word is a usual one is told by the vocabulary of a public tokenizer: usual words are tokens of their own,
in lower case or, names of all kinds, only with a capital.
"""

from __future__ import annotations

import base64
import json
import math
import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from importlib.resources import files

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlake.llm.tokens import TOKENIZERS
from threadlake.session import table

TYPES = ("email", "phone", "id_number", "address", "name")
# greatest lengths; entities are bounded, texts are not
LOCAL, LABELS, GROUPS, CHUNKS, TAIL, WORDS, LONGEST = 64, 6, 7, 8, 12, 4, 160
NEAR = 4  # characters between two entities that know of each other


class _Plain(dict):
    """Full-width forms, digits of other scripts, blanks and hyphens to plain ones of the same length."""

    def __missing__(self, code: int) -> int:
        ch, to = chr(code), code
        if 0xFF01 <= code <= 0xFF5E:
            to = code - 0xFEE0
        elif (kind := unicodedata.category(ch)) == "Nd":
            to = 0x30 + unicodedata.decimal(ch)
        elif kind == "Zs":
            to = 0x20
        elif 0x2010 <= code <= 0x2013:
            to = 0x2D
        self[code] = to
        return to


_plain = _Plain()

# ---- words ------------------------------------------------------------------------------------------------
# given names known without a list; neither complete nor proof of a name
GIVEN = set(
    "adam agnes ahmed aisha alan albert alejandro alessandro alex alexander alice alicia amanda amelia amina ana andrea andreas andrew angela anna anne antonio arthur astrid barbara beatrice ben benjamin bernard brian camille carla carlos caroline catherine cecilia charles charlotte chiara christian christine claire claudia clara daniel david diana diego dmitri dominik edward elena elisabeth elizabeth emil emily emma enrique eric erik eva fatima felix fernando florian francesca francois frank fredrik gabriel george giovanni giulia grace gustav hannah hans harry heinrich helen helena henry hiroshi hugo ingrid irene isabel ivan jack jakub james jan jane javier jean jennifer jessica joachim joan johan john jonas jorge jose joseph juan julia julian karen karin karl katarzyna kate katharina kevin klaus kristina lars laura lena leo leon lisa louis louise lucas lucia luis magda magnus manuel marco margaret maria marie mark marta martin mary mateusz matthew max mei michael miguel mikhail mohammed monika natalia nicolas nicole nina nora olga oliver olivia omar oscar otto pablo patricia patrick paul paula pedro peter philip pierre piotr rachel raj rebecca richard robert roberto rosa ruth samuel sara sarah sebastian sergei silvia simon sofia sophie stefan stephen susan tatiana theresa thomas tim tom ursula vera victor vincent walter wei werner william wolfgang yuki zofia".split()
)
TITLES = set("mr mrs ms miss mx dr prof professor sir madam frau herr fräulein mme mlle monsieur madame mademoiselle señor señora señorita sr sra don doña senhor senhora signor signora sig dott pan pani fru fröken mevrouw meneer г-н г-жа".split())
PARTICLES = set("van von der den de del della di da dos du la le ten ter zu bin ibn al el af av".split())
STOP = set(
    "the a an and or but if for of to in on at is it its this that these those with from by as are was were be been being will would can could should may might must do does did done have has had not no yes so then than when where which who whom whose why how what all any each both few more most other some such only own same too very just now here there again once about above after before below between into through during under over up down out off i you he she we they me him her us them my your his our their let please thanks hello hi dear "
    "der die das den dem des ein eine einen einem einer und oder aber ist sind war nicht ich du er sie es wir ihr mit von für auf aus bei nach zu im am vom zum zur bitte heute gestern wenn als wie was wer wo "
    "le la les l un une des du de et ou est sont pas je tu il elle nous vous ils dans sur pour par avec ce cette qui que hier "
    "el los las un una unos y o es son no yo tú él ella nosotros en con por para se su lo al del ayer que "
    "o os as um uma e é são não eu ele ela em com por para na no do da "
    "i w z na do się jest nie to jak dla od po и в на не с к по из это как для от "
    "monday tuesday wednesday thursday friday saturday sunday january february march april june july august september october november december".split()
)
_WORD = re.compile(r"[^\W\d_](?:[^\W\d_]|[̀-ͯ]|(?:['’](?![sS]\b)|-)(?=[^\W\d_]))*")
_TOKEN = re.compile(r"[^\W\d_](?:[^\W\d_]|[̀-ͯ]|['’](?=[^\W\d_]))*|\d+|\n|[^\w\s]|_")

_usual: tuple[dict[str, int], dict[str, int]] = ({}, {})  # rank of words that are tokens, in lower case and with a capital
_extra: set[str] = set()


def read_usual(folder: str = TOKENIZERS, names: tuple[str, ...] = ("byte_bpe_50k", "byte_bpe_multi_50k")) -> tuple[dict[str, int], dict[str, int]]:
    """Words that are whole tokens of the vocabularies, with the least rank: in lower case, and with a capital. Some 50,000, whatever the input."""
    small: dict[str, int] = {}
    large: dict[str, int] = {}
    for name in names:
        with open(f"{folder}/{name}.tiktoken", "rb") as lines:
            for line in lines:
                code, rank = line.split()
                try:
                    word = base64.b64decode(code).decode()
                except UnicodeDecodeError:
                    continue
                if word[:1] == " " and len(word) > 2 and word[1:].isalpha():
                    word = word[1:]
                    if word.islower():
                        small[word] = min(int(rank), small.get(word, 1 << 30))
                    elif word.istitle():
                        large[word.lower()] = min(int(rank), large.get(word.lower(), 1 << 30))
    return small, large


def set_usual(words: tuple[dict[str, int], dict[str, int]]) -> None:
    global _usual
    _usual = words
    word_class.cache_clear()


def set_given_names(names: Iterable[str]) -> None:
    """More given names to know, beside the built-in ones."""
    new = {unicodedata.normalize("NFC", n.strip().lower()) for n in names if n and n.strip()}
    if new != _extra:
        _extra.clear()
        _extra.update(new)
        word_class.cache_clear()


@lru_cache(maxsize=200_000)
def word_class(word: str) -> tuple[str, str]:
    """(style, class). Styles: t title case, u upper case, l lower case, x mixed. Classes: T title, K particle, I initial,
    G given name, S function word, C usual word, Q usual more with a capital, P usual with a capital only, U none."""
    if not _usual[0]:
        set_usual(read_usual())
    word = unicodedata.normalize("NFC", word)
    low = word.lower()
    if len(word) == 1:
        return ("t" if word.isupper() else "l"), "I" if word.isupper() else "S"
    parts = [p for p in re.split(r"['’\-]", word) if p]
    if word.isupper():
        style = "u"
    elif word.islower():
        style = "l"
    elif all(p[0].isupper() and (len(p) == 1 or p[1:].islower() or re.fullmatch(r"(?:Mc|Mac|De|Di|Fitz)\w+", p) and p[:1] + p[-3:].lower() and sum(c.isupper() for c in p) == 2) for p in parts):
        style = "t"
    else:
        style = "x"
    if low in TITLES:
        return style, "T"
    if low in _extra or low in GIVEN or len(parts) > 1 and parts[0].lower() in GIVEN | _extra:
        return style, "G"
    if low in PARTICLES:
        return style, "K"
    if low in STOP:
        return style, "S"
    small, large = _usual
    a, b = small.get(low), large.get(low)
    if a is None and low.endswith("s"):
        a = small.get(low[:-1])
    for end in ("ed", "er", "ing", "ly", "es", "r", "d"):
        if a is None and low.endswith(end) and len(low) - len(end) > 3:
            a = small.get(low[: -len(end)])
    if a is None and b is None:
        return style, "U"
    if a is None:
        return style, "P"
    return style, "Q" if b is not None and 2 * b < a else "C"


# ---- what stands beside a span ----------------------------------------------------------------------------
_CUES = {
    "phone": re.compile(r"\b(?:tele?phones?|tel|téléphone|telefon\w*|teléfono|telefone|mobiles?|mobil|móvil|cell(?:ular|phone)?|handy|fax|call(?:ed|s|ing)?|ring|rang|dial(?:l?ed)?|anruf\w*|sms|whatsapp|voicemail|landline|hotline|phone ?number|rufnummer)\b"),
    "id_number": re.compile(r"\b(?:ssn|social security|sozialversicherung\w*|national (?:id|insurance|identity)|national[_-]id|nino|ni|passports?|passport[_ ]?n\w*|reisepass\w*|pass(?:-?nummer|nr)|pasaporte|passeport|passaporto|paszport\w*|dni|nif|nie|cpf|curp|tin|itin|tax(?:payer)?|steuer\w*|steuer-id\w*|fiscal\w*|pesel|bsn|id[ -]?card|identity|identification|identidad|personalausweis\w*|ausweis\w*|driv(?:er'?s?|ing) licen[cs]e|licen[cs]e|führerschein\w*|permis)\b"),
    "address": re.compile(r"\b(?:address(?:es)?|adresse|anschrift|lieferadresse|rechnungsadresse|direcci[oó]n|domicilio|indirizzo|endereço|adres|lives?|living|resid\w+|wohn\w*|habite|vive|located|based|moved?|deliver\w*|ship\w*|post(?:ed|al)?|mail(?:ed|ing)?|send|sent|billing|office)\b"),
    "email": re.compile(r"\b(?:e-?mails?|mail(?:ed|ing|to)?|correo|courriel|write|wrote|contact\w*|reach\w*|cc|bcc|reply|inbox|account|author)\b"),
    "name": re.compile(r"\b(?:by|from|to|with|for|cc|dear|hi|hello|ask(?:ed)?|name\w*|author|owner|contact|assignee|reviewer|manager|signed|von|bei|mit|an|laut|por|para|según|con|par|avec|selon|przez|dla|от|для|с)\b"),
}
_BEFORE_NAME = re.compile(_CUES["name"].pattern + r"[\s:=\"'(\[]{0,4}$", re.IGNORECASE)
_AGAINST = re.compile(r"\b(?:builds?|built|versions?|release|revision|rev|ports?|pid|commit\w*|sha|hash\w*|checksums?|tickets?|issues?|bugs?|traces?|lines?|rows?|offsets?|epoch|timestamps?|range|bytes?|size|steps?|uuid|guid|serial|batch|orders?|invoices?|ip|host|addr|cidr|listening|took|retr(?:y|ies)|page|section|id)\b")
_THING = re.compile(r"\s*(?:services?|servers?|tests?|suites?|modules?|packages?|releases?|clusters?|themes?|library|libraries|frameworks?|buttons?|pages?|rooms?|dashboards?|queues?|branch|plugins?|projects?|repos?|api|apps?|database|tables?|columns?|protocol|algorithm|compiler|runtime|engine|version|menus?|panels?|dialogs?|settings?|awards?|university|hospital|hotel|airport|station|park|river|lake|museum|bridge)\b", re.IGNORECASE)
_CLAUSE = re.compile(r"[.;!?|](?=\s)|\n")
_BIT = re.compile(r"[^\W\d_]+|\d+|[^\w\s]|\n")


def _left(text: str, s: int) -> tuple[list[str], str]:
    before = text[max(0, s - 48) : s]
    bits = _BIT.findall(before.lower())
    gap = "bos" if not before.strip(" \t") else "glued" if not before[-1].isspace() else "nl" if before.rstrip(" \t")[-1:] == "\n" else "blank"
    one = bits[-1] if bits else "^"
    two = bits[-2] if len(bits) > 1 else "^"
    clause = before
    for m in _CLAUSE.finditer(before):
        clause = before[m.end() :]
    low = clause.lower()
    near = low[-26:]
    out = [f"lg={gap}", f"l1={'9' if one.isdigit() else one}", f"lg1={gap}{one if not one.isalnum() else 'w'}"]
    out.append(f"l2={'9' if two.isdigit() else two},{'9' if one.isdigit() else one}" if not one.isalnum() else f"lw2={'9' if two.isdigit() else two}")
    for kind, cue in _CUES.items():
        if cue.search(near):
            out.append(f"cue={kind}")
        elif cue.search(low):
            out.append(f"far={kind}")
    if _AGAINST.search(low[-18:]):
        out.append("against")
    if not clause.strip(" \t\"'([{<-–—"):
        out.append("opens")
    return out, low


def _right(text: str, e: int) -> list[str]:
    after = text[e : e + 24]
    bits = _BIT.findall(after.lower())
    gap = "eos" if not after.strip() else "glued" if not after[0].isspace() else "blank"
    one = bits[0] if bits else "$"
    out = [f"rg={gap}", f"r1={'9' if one.isdigit() else one}", f"rg1={gap}{one if not one.isalnum() else 'w'}"]
    if len(bits) > 1 and one.isalpha():
        out.append(f"r2={'9' if bits[1].isdigit() else bits[1]}")
    if _THING.match(after):
        out.append("thing")
    return out


# ---- spans ------------------------------------------------------------------------------------------------
Span = tuple[int, int, str, list[str]]
_AT = re.compile(r"@|%40|&#64;|&commat;|\\u0040|[\[({<]\s?at\s?[\])}>]|(?<=\s)at(?=\s)", re.IGNORECASE)
_LOCAL = re.compile(r"(?:[\w+\-][\w.+'\-]*?)?[\w+\-]$")
_LOCAL_DOTS = re.compile(r"([\w+\-]+)(?:\s|\s?[\[({<]\s?)(?:dot|punkt)(?:\s|\s?[\])}>]\s?)$", re.IGNORECASE)
_DOT = r"(?:\.|\s?[\[({<]\s?(?:dot|punkt)\s?[\])}>]\s?|\s{1,2}(?:dot|punkt)\s{1,2})"
_LABEL = re.compile(r"\w[\w\-]{0,62}")
_NEXT = re.compile(rf"{_DOT}(?=\w)", re.IGNORECASE)
# fixed values: ends of host names, and of file names
_ENDS = set("com org net edu gov mil int info biz io dev co app me tv ai cloud mail email name pro museum example test invalid local localhost uk de fr es it pl ru jp cn in au br pt nl be se no fi dk ch at cz sk hu ro gr tr ie il za mx ar cl nz kr tw ua eu us ca".split())
_FILES = set("png jpg jpeg gif svg webp ico bmp js jsx ts tsx css scss py pyc md rst txt log json yaml yml xml go rs java c h cpp hpp cs sql sh bash rb kt swift toml ini cfg conf html htm php lock whl tgz zip gz tar jar exe dll so csv tsv parquet pdf doc docx".split())


def _emails(text: str) -> Iterator[Span]:
    for at in _AT.finditer(text):
        sign = at.group().lower()
        kind = "plain" if sign == "@" else "coded" if sign[0] in "%&\\" else "word" if sign == "at" else "bracket"
        pos = at.end()
        gap = re.compile(r"\s{0,2}").match(text, pos).end() if kind != "coded" else pos
        label = _LABEL.match(text, gap)
        if not label or kind == "plain" and gap > pos + 1:
            continue
        ends, end, dots = [], label.end(), set()
        for _ in range(LABELS):
            dot = _NEXT.match(text, end)
            label_ = dot and _LABEL.match(text, dot.end())
            if not label_:
                break
            dots.add("." if dot.group() == "." else "[" if re.search(r"[\[({<]", dot.group()) else "w")
            end = label_.end()
            ends.append((end, label_.group().lower(), "".join(sorted(dots))))
        if not ends:
            continue
        left_end = at.start()
        if kind != "coded":
            while left_end > 0 and text[left_end - 1] == " " and at.start() - left_end < 2:
                left_end -= 1
        head = text[max(0, left_end - LOCAL) : left_end]
        local = _LOCAL.search(head)
        if not local:
            continue
        starts = [left_end - len(local.group())]
        while len(starts) < 3 and (m := _LOCAL_DOTS.search(text[max(0, starts[-1] - 40) : starts[-1]])):
            starts.append(starts[-1] - len(m.group()))
        for s in starts:
            own = text[s:left_end]
            left, _ = _left(text, s)
            words = _WORD.findall(own)
            shape = "digits" if any(c.isdigit() for c in own) else "dotted" if re.search(r"[._+\-]", own) else "plain"
            base = [f"at={kind}", f"local={kind},{shape}", f"word={kind},{word_class(words[0])[1] if len(words) == 1 and shape == 'plain' else shape}", *left]
            if left_end != at.start():
                base.append(f"spaced={kind}")
            if own.lower() in {"git", "hg", "svn"}:
                base.append("repo")
            if re.search(r"://[^\s?]*$", text[max(0, s - 40) : s]):
                base.append("scheme")
            for n, (e, last, dots_) in enumerate(ends):
                end_kind = "digits" if last.isdigit() else "known" if last in _ENDS else "file" if last in _FILES else f"len{min(len(last), 4)}"
                out = [f"end={end_kind}", f"end={end_kind},{kind}", f"dot={dots_}", f"dot={dots_},{kind}", f"n={min(n, 3)}", *base]
                if n + 1 < len(ends):
                    out.append("cut")
                if len(starts) > 1 and s != starts[-1]:
                    out.append("cutleft")
                if text[gap].isdigit():
                    out.append("hostdigit")
                if re.match(r":[\w~/]|/\w", text[e : e + 2]):
                    out.append("path")
                yield s, e, "email", [*out, *_right(text, e)]


_RUN = re.compile(r"(?<![\w])[+(]{0,2}\d(?:[ \t().\-/]{0,3}\d)*")
_EXT = re.compile(r"\s{0,2},?\s?(?:ext|extension|x|durchwahl|dw|poste|anexo)\.?\s{0,2}\d{1,5}(?!\w)", re.IGNORECASE)
_GROUP = re.compile(r"\d+")


def _numbers(text: str) -> Iterator[Span]:
    for run in _RUN.finditer(text):
        if run.end() - run.start() < 7:
            continue
        groups = [(m.start(), m.end()) for m in _GROUP.finditer(text, run.start(), run.end())]
        for i, (gs, _) in enumerate(groups):
            s = gs
            if s > run.start() and text[s - 1] == "(":
                s -= 1
            if s > run.start() and text[s - 1] == "+":
                s -= 1
            if i and text[s - 1 : s] not in (" ", "\t", "/", "("):
                continue
            n, base = 0, None
            for j in range(i, min(i + GROUPS, len(groups))):
                n += groups[j][1] - groups[j][0]
                e = groups[j][1]
                if n < 7:
                    continue
                if n > 15:
                    break
                after = text[e : e + 1]
                if after.isalnum() or after == "_":
                    break
                if base is None:
                    base = _left(text, s)[0]
                    joined = text[max(0, s - 1) : s]
                    if text[max(0, s - 4) : s].lower() == "tel:":
                        base.append("tel")
                    elif joined and joined in "-./#@:$=" and text[max(0, s - 2) : s - 1].strip():
                        base.append(f"joined{joined}")
                out = _number_features(text[s:e], n, groups[i : j + 1], s) + base
                if i:
                    out.append("cutleft")
                if j + 1 < len(groups):
                    out.append("cut")
                right = _right(text, e)
                if re.match(r"[/:]\d", text[e : e + 2]):
                    out.append("port")
                yield s, e, "phone", out + right
                if ext := _EXT.match(text, e):
                    yield s, ext.end(), "phone", [*out, "ext", *_right(text, ext.end())]


def _number_features(span: str, n: int, groups: list[tuple[int, int]], s: int) -> list[str]:
    sizes = [b - a for a, b in groups]
    seps = {span[groups[k][1] - s : groups[k + 1][0] - s].strip() or " " for k in range(len(groups) - 1)}
    first = "+" if "+" in span[:2] else "00" if span.startswith("00") else "(" if span[0] == "(" else "0" if span[0] == "0" else "1" if span[0] == "1" and n == 11 else "d"
    sep = "none" if not seps else "".join(sorted(seps)) if len(seps) < 3 else "many"
    out = [f"digits={n}", f"first={first}", f"first={first},{n}", f"sizes={'-'.join(map(str, sizes)) if len(sizes) < 6 else 'many'}", f"sep={sep}", f"sep={sep},{first}", f"groups={min(len(sizes), 6)}"]
    if sizes[-2:] == [3, 4] or sizes[-3:] == [3, 3, 4]:
        out.append(f"north={'(' in span},{sep}")
    if len(sizes) == 4 and seps == {"."} and max(sizes) <= 3:
        out.append("ip")
    if len(sizes) > 2 and sizes[0] == 4 and sizes[1] <= 2 and sizes[2] <= 2 and span[0] in "12":
        out.append("date")
    if len(sizes) > 3 and set(sizes[-4:]) == {2}:
        out.append("pairs")
    if len(sizes) == 1:
        out.append(f"solid={first},{n}")
    return out


_CHUNK = re.compile(r"[A-Za-z]+|\d+")


def _codes(text: str) -> Iterator[Span]:
    chunks = [(m.start(), m.end(), m.group()) for m in _CHUNK.finditer(text)]
    for i, (s, e0, first) in enumerate(chunks):
        before = text[s - 1 : s]
        if before and (before.isalnum() or before == "_"):
            continue
        if first.isalpha() and (len(first) > 5 or i + 1 == len(chunks) or not (first.isupper() and chunks[i + 1][0] - e0 < 2 or chunks[i + 1][0] == e0)):
            continue
        digits = total = 0
        shape: list[str] = []
        base = None
        at = s
        for j in range(i, min(i + CHUNKS, len(chunks))):
            a, b, c = chunks[j]
            gap = text[at:a]
            if j > i and gap and (len(gap) > 1 or gap not in " -./·–"):
                break
            if c.isalpha() and (len(c) > 5 or not c.isupper() and gap):
                break
            shape += [gap, f"{'d' if c[0].isdigit() else 'A' if c.isupper() else 'a'}{b - a}"]
            at, total = b, total + b - a
            digits += (b - a) * c[0].isdigit()
            if total > 20:
                break
            after = text[b : b + 1]
            if total < 7 or digits < 5 or after.isalnum() or after == "_":
                continue
            if base is None:
                base, clause = _left(text, s)
                if before and before in "-./#@:$=" and text[max(0, s - 2) : s - 1].strip():
                    base.append(f"joined{before}")
                asked = bool(_CUES["id_number"].search(clause))
                if not asked:
                    base.append("unasked")
            form = "".join(shape)
            loose = re.sub(r"\d+", "", form)
            out = [f"shape={form}", f"shape={form},{asked}", f"loose={loose}", f"loose={loose},{asked}", f"digits={digits}", f"digits={digits},{asked}", *base]
            if after in ("-", ".", "/") and text[b + 1 : b + 2].isalnum():
                out.append("cut")
            elif after == " " and text[b + 1 : b + 2].isdigit():
                out.append("more")
            if i and s - chunks[i - 1][1] == 1 and before == " " and chunks[i - 1][2].isdigit():
                out.append("moreleft")
            yield s, b, "id_number", [*out, *_right(text, b)]


_AFTER_NUMBER = set("street st road rd lane ln avenue ave boulevard blvd court ct drive dr way place pl square sq terrace close crescent row highway hwy parkway pkwy circle trail mews walk".split())
_BEFORE_NUMBER = set("calle avenida avda plaza paseo camino via viale piazza corso largo rua travessa praça ul ulica al aleja os plac rue boulevard avenue place chemin impasse quai allée cours".split())
_SUFFIXES = ("straße", "strasse", "str", "weg", "gasse", "platz", "allee", "ufer", "damm", "ring", "straat", "laan", "plein", "gatan", "vägen", "vej", "gade", "gata")
_BOXES = re.compile(r"\b(?:p\.? ?o\.? ?box|post(?:fach| office box|bus)|apartado(?: de correos)?|casella postale|caixa postal|bo[iî]te postale|b\.?p\.?|skr(?:ytka|\.) poczt(?:owa|\.))(?= ?(?:n[º°o]\.? ?)?\d)", re.IGNORECASE)
_UNITS = set("flat apt apartment unit suite ste floor fl room no nr".split())
_PLACED = re.compile(r"\b(?:" + "|".join(sorted(_AFTER_NUMBER | _BEFORE_NUMBER)) + r")\b|(?:" + "|".join(_SUFFIXES) + r")\.? ?\d|box|post|apartado|casella|caixa|bo[iî]te|\bb\.?p|skr", re.IGNORECASE)


def _symbol(token: str) -> str:
    if token in (",", "\n"):
        return "c" if token == "," else "n"
    if token.isdigit():
        return f"d{min(len(token), 6)}"
    if not token[0].isalpha():
        return token
    low = token.lower()
    if low in _UNITS:
        return "u"
    style, kind = word_class(token)
    if style == "u" and len(token) <= 3:
        return "Z"
    return "S" if kind in "SK" and style == "l" else "w" if style != "l" else "l"


def _addresses(text: str) -> Iterator[Span]:
    if not _PLACED.search(text):
        return
    tokens = [(m.start(), m.end(), m.group()) for m in _TOKEN.finditer(text)]
    at = {t[0]: i for i, t in enumerate(tokens)}
    bodies: dict[tuple[int, int], str] = {}  # first and last token of street and number, and the kind
    number = lambda i: 0 <= i < len(tokens) and tokens[i][2].isdigit() and len(tokens[i][2]) <= 5
    word = lambda i: 0 <= i < len(tokens) and tokens[i][2][0].isalpha()
    for a, (s, e, w) in enumerate(tokens):
        low = w.lower()
        if low in _AFTER_NUMBER:
            for b in range(a - 2, max(-1, a - 7), -1):
                if tokens[b][2] in ("\n", ",", ";") or not (word(b) or number(b) or tokens[b][2] in ".-'"):
                    break
                if number(b):
                    bodies[b, a + (a + 1 < len(tokens) and tokens[a + 1][2] == "." and tokens[a + 1][0] == e)] = "number_first"
                    if b >= 3 and tokens[b - 1][2] == "," and tokens[b - 3][2].lower() in _UNITS:
                        bodies[b - 3, a] = "number_first"
                    break
        if low.endswith(_SUFFIXES) and (len(low) > 6 or low in _SUFFIXES):
            n = a + 1 + (a + 1 < len(tokens) and tokens[a + 1][2] == ".")
            if number(n):
                last = n + (word(n + 1) and len(tokens[n + 1][2]) == 1 and tokens[n + 1][0] - tokens[n][1] < 2)
                for first in range(a, max(-1, a - 4), -1):
                    if first < a and not (word(first) and (word_class(tokens[first][2])[0] != "l" or word_class(tokens[first][2])[1] != "S" and w.islower()) or tokens[first][2] == "-"):
                        break
                    if word(first):
                        bodies[first, last] = "number_last"
        if low in _BEFORE_NUMBER:
            for n in range(a + 1, min(a + 8, len(tokens))):
                if number(n):
                    if n > a + 1:
                        bodies[a, n] = "word_first"
                    break
                if not (word(n) or tokens[n][2] in ".-'," and n > a):
                    break
            for b in range(a - 1, max(-1, a - 4), -1):
                if number(b) and word(a + 1):
                    bodies[b, a + 1] = "number_word"
                    break
                if not (tokens[b][2] == "," or tokens[b][2].lower() in {"bis", "ter", "quater"} or len(tokens[b][2]) == 1 and word(b)):
                    break
    for m in _BOXES.finditer(text):
        if (a := at.get(m.start())) is None:
            continue
        n = next((k for k in range(a, min(a + 9, len(tokens))) if number(k) and tokens[k][0] >= m.end()), None)
        if n is not None:
            bodies[a, n] = "box"
    for (first, body), kind in bodies.items():
        s = tokens[first][0]
        if text[max(0, s - 1) : s].strip() and text[s - 1] in "_/.-@#":
            continue
        left, _ = _left(text, s)
        names = [word_class(t[2])[1] for t in tokens[first : body + 1] if t[2][0].isalpha() and t[2].lower() not in _AFTER_NUMBER | _BEFORE_NUMBER]
        own = [f"kind={kind}", f"street={kind},{''.join(sorted(set(names)))[:3]}", *left]
        tail: list[str] = []
        breaks = 0
        for k in range(body, min(body + TAIL + 1, len(tokens))):
            t = tokens[k][2]
            if k > body:
                sym = _symbol(t)
                if not (t[0].isalnum() or t in ",.-/#'ºª°\n"):
                    break
                breaks += t in ",\n"
                if breaks > 4 or t == "\n" and tail[-1:] == ["n"] or t == "." and k + 1 < len(tokens) and tokens[k + 1][0] > tokens[k][1] and not (len(tokens[k - 1][2]) < 4):
                    break
                tail.append(sym)
                if not (t[0].isalnum() or t in "ºª°"):
                    continue
            e = tokens[k][1]
            if e - s > LONGEST:
                break
            if text[e : e + 1] == "_" or text[e : e + 1].isalnum():
                continue
            nxt = [_symbol(x[2]) for x in tokens[k + 1 : k + 3]]
            town = next((i for i, x in enumerate(tail) if x in "cn" and any(y in ("w", "l") for y in tail[i + 1 : i + 3])), None)
            after = tail[town + 1 :] if town is not None else []
            out = [f"town={town is not None}", f"town={town is not None},{kind}", f"tail={''.join(tail[:8])}", f"last={tail[-1] if tail else '-'}", f"next={nxt[0] if nxt else '$'}", f"next2={''.join(nxt)}", f"lastnext={tail[-1] if tail else '-'},{nxt[0] if nxt else '$'}", f"len={len(tail)}", *own]
            out += [f"bi={a}{b}" for a, b in zip(tail, tail[1:])]
            if town is not None:
                out += [f"townwords={sum(x in ('w', 'l', 'S') for x in after)}", f"townlow={'l' in after},{tokens[first][2].islower() or text[s:e].islower()}"]
                if "S" in after:
                    out.append("townstop")
                if any(x in ("d4", "d5", "d3") for x in tail):
                    out.append("code")
            yield s, e, "address", out + _right(text, e)


def _names(text: str) -> Iterator[Span]:
    words = [(m.start(), m.end(), m.group()) for m in _WORD.finditer(text)]
    n = len(words)
    if n < 2:
        return
    info = [word_class(w[2]) for w in words]
    for i in range(n):
        style, kind = info[i]
        if style == "x" or kind in "SK":
            continue
        if style == "l" and kind not in "GTUP" and not (i + 1 < n and info[i + 1][1] == "G" and info[i + 1][0] == "l"):
            continue
        s, e, w = words[i]
        before = text[s - 1 : s]
        if before and (before in "@./\\_%+-$#&" or before.isalnum()):
            continue
        parts, gaps, base = [(w, style, kind)], [], None
        for j in range(i + 1, min(i + 1 + WORDS, n)):
            gap = text[e : words[j][0]]
            prev = parts[-1]
            if gap not in (" ", "  ") and not (gap == ", " and ", " not in gaps and prev[2] != "T") and not (gap in (".", ". ", ".  ") and prev[2] in "IT"):
                break
            w2, (style2, kind2) = words[j][2], info[j]
            if style2 == "x" or kind2 == "S" or kind2 == "T":
                break
            parts.append((w2, style2, kind2))
            gaps.append(gap)
            e = words[j][1]
            after = text[e : e + 1]
            if after and (after in "@_/\\%+=(" or after.isalnum()) or after in (".", "-") and text[e + 1 : e + 2].isalnum() and kind2 != "I":
                break
            if kind2 in "IK":
                continue  # neither an initial nor a particle is the end
            body = parts[1:] if parts[0][2] == "T" else parts
            styles = {p[1] for p in body if p[2] not in "IK"}
            if "l" in styles and (len(styles) > 1 or any(p[2] == "I" for p in body)):
                continue
            if "l" in styles and parts[0][2] != "T" and not any(p[2] == "G" for p in body) and (any(p[2] in "CQ" for p in body) or not _BEFORE_NAME.search(text[max(0, s - 24) : s])):  # small letters need a sign of a name
                continue
            if base is None:
                base = _left(text, s)[0]
                if i and words[i - 1][1] == s - 1 and before == " ":
                    base.append(f"before={info[i - 1][0]}{info[i - 1][1]}")
            yield s, e, "name", _name_features(parts, gaps, styles) + base + _after_name(text, e, words, info, j)


def _name_features(parts: list[tuple[str, str, str]], gaps: list[str], styles: set[str]) -> list[str]:
    titled = parts[0][2] == "T"
    body = parts[1:] if titled else parts
    comma = ", " in gaps
    classes = "".join(p[2] for p in body)
    case = "lower" if styles == {"l"} else "upper" if styles == {"u"} else "mixed" if len(styles) > 1 else "title"
    form = "title" if titled else "comma" if comma else ("initial." if gaps[len(parts) - len(body)].startswith(".") else "initial") if body[0][2] == "I" else "middle" if "I" in classes else f"words{len(body)}"
    out = [f"form={form}", f"case={case}", f"form={form},{case}", f"classes={classes}", f"classes={form},{classes}", f"classes={case},{classes}", f"first={classes[0]},{case}", f"last={classes[-1]},{case}", f"n={len(body)}"]
    if "G" in classes:
        out += ["given", f"given={form},{case}", f"given={classes.index('G') == 0},{comma}"]
    if "U" in classes:
        out.append("unusual")
    if not set(classes) & set("GUPQ"):
        out.append("usual")
    if "C" in classes:
        out.append(f"usualword={case},{form}")
    if titled:
        out.append(f"title={parts[0][0].lower()}")
    return out


def _after_name(text: str, e: int, words: list, info: list, j: int) -> list[str]:
    out = _right(text, e)
    if j + 1 < len(words) and words[j + 1][0] == e + 1 and text[e] == " ":
        out.append(f"then={info[j + 1][0]}{info[j + 1][1]}")
    elif text[e : e + 2] == ", " and j + 1 < len(words) and words[j + 1][0] == e + 2:
        out.append(f"comma={info[j + 1][0]}{info[j + 1][1]}")
    return out


def spans(text: str) -> list[Span]:
    """Every feasible entity (start, end, type, features) of a text."""
    out: list[Span] = []
    if "@" in text or "%40" in text or "&" in text or "\\u" in text or "t" in text or "T" in text:
        out += _emails(text)
    if any(d in text for d in "0123456789"):
        out += _numbers(text)
        out += _codes(text)
        out += _addresses(text)
    out += _names(text)
    return out


# ---- the model --------------------------------------------------------------------------------------------
Weights = dict[str, dict[str, float]]


@lru_cache(maxsize=1)
def _model() -> Weights:
    return json.loads(files("threadlake.llm").joinpath("pii_weights.json").read_text())


def _scored(text: str, weights: Weights) -> list[tuple[int, int, str, float]]:
    best: dict[tuple[int, int, str], float] = {}
    for s, e, kind, features in spans(text):
        own = weights[kind]
        value = own["bias"]
        for f in features:
            if f in own:
                value += own[f]
        if value > best.get((s, e, kind), -math.inf):
            best[s, e, kind] = value
    return sorted(((s, e, kind, v) for (s, e, kind), v in best.items()), key=lambda c: (c[1], c[0], c[2]))


def segments(text: str, weights: Weights | None = None) -> list[tuple[int, int, str]]:
    """The best segmentation's entities (start, end, type), in order."""
    weights = _model() if weights is None else weights
    order = _scored(text.translate(_plain) if not text.isascii() else text, weights)
    if not order:
        return []
    pairs = weights["pairs"]
    ends = [c[1] for c in order]
    value: list[float] = []  # best segmentation that ends with this entity
    back: list[int] = []
    top: list[tuple[float, int]] = [(0.0, -1)]  # best of the first n entities, or none
    for n, (s, _, kind, own) in enumerate(order):
        far = bisect_left(ends, s - NEAR + 1, 0, n) if s >= NEAR else 0
        best, chosen = top[far]
        for p in range(far, bisect_right(ends, s, 0, n)):
            if (v := value[p] + pairs.get(f"{order[p][2]}>{kind}", 0.0)) > best:
                best, chosen = v, p
        value.append(best + own)
        back.append(chosen)
        top.append(max(top[-1], (value[-1], n), key=lambda x: x[0]))
    out, n = [], top[-1][1]
    while n >= 0:
        out.append(order[n][:3])
        n = back[n]
    return out[::-1]


def redact_text(text: str, weights: Weights | None = None) -> str:
    out, at = [], 0
    for s, e, kind in segments(text, weights):
        out += [text[at:s], f"[{kind.upper()}]"]
        at = e
    return "".join([*out, text[at:]])


def train_weights(examples: list[tuple[str, list[tuple[int, int, str]]]], epochs: int = 8, rate: float = 0.2, l2: float = 2e-4, seen: int = 3) -> Weights:
    """Maximum likelihood of the examples' segmentations (text, entities), by AdaGrad; the same examples give the same weights.

    Features that fewer than `seen` examples have are left out.
    """
    lattices, counts = [], {}
    for text, gold in examples:
        merged: dict[tuple[int, int, str], set[str]] = {}
        for s, e, kind, features in spans(text.translate(_plain)):
            merged.setdefault((s, e, kind), set()).update(features)
        want = set(gold) & set(merged)
        order = sorted(merged, key=lambda c: (c[1], c[0], c[2]))
        lattices.append((order, [sorted(merged[c]) for c in order], want))
        for f in {(c[2], f) for c in order for f in merged[c]}:
            counts[f] = counts.get(f, 0) + 1
    index = {("pairs", f"{a}>{b}"): k for k, (a, b) in enumerate((a, b) for a in TYPES for b in TYPES)}
    for kind in TYPES:
        index[kind, "bias"] = len(index)
    for f in sorted(f for f, n in counts.items() if n >= seen):
        index[f] = len(index)
    ready = []
    for order, features, want in lattices:
        if order:
            ids = [[index[c[2], "bias"], *(index[c[2], f] for f in fs if (c[2], f) in index)] for c, fs in zip(order, features)]
            ends = [c[1] for c in order]
            near = [(bisect_left(ends, c[0] - NEAR + 1, 0, n) if c[0] >= NEAR else 0, bisect_right(ends, c[0], 0, n)) for n, c in enumerate(order)]
            chosen = [n for n, c in enumerate(order) if c in want]
            pair = [[index["pairs", f"{order[p][2]}>{c[2]}"] for p in range(*near[n])] for n, c in enumerate(order)]
            ready.append((ids, near, pair, chosen))
    weights, square = [0.0] * len(index), [1e-6] * len(index)
    for _ in range(epochs):
        for ids, near, pair, chosen in ready:
            psi = [math.exp(min(25.0, max(-25.0, sum(weights[f] for f in fs)))) for fs in ids]
            n = len(ids)
            into, upto = [0.0] * n, [1.0]  # sums over segmentations that end with an entity; with any of the first
            links = [[math.exp(weights[k]) for k in row] for row in pair]
            for c in range(n):
                low, high = near[c]
                into[c] = psi[c] * (upto[low] + sum(into[p] * t for p, t in zip(range(low, high), links[c])))
                upto.append(upto[-1] + into[c])
            whole = upto[-1]
            # backwards: d whole / d into, by the chain rule
            from_ = [1.0] * n
            tail = [0.0] * (n + 1)  # what flows back into upto[k]
            run = 0.0
            slope: dict[int, float] = {}
            for c in range(n - 1, -1, -1):
                run += tail[c + 1]
                from_[c] += run
                low, high = near[c]
                flow = from_[c] * psi[c]
                tail[low] += flow
                share = into[c] * from_[c] / whole
                for f in ids[c]:
                    slope[f] = slope.get(f, 0.0) - share
                for p, t, k in zip(range(low, high), links[c], pair[c]):
                    from_[p] += flow * t
                    slope[k] = slope.get(k, 0.0) - into[p] * t * flow / whole
            for k, c in enumerate(chosen):
                for f in ids[c]:
                    slope[f] = slope.get(f, 0.0) + 1
                if k and near[c][0] <= chosen[k - 1] < near[c][1]:
                    f = pair[c][chosen[k - 1] - near[c][0]]
                    slope[f] = slope.get(f, 0.0) + 1
            for f, g in slope.items():
                if abs(g) > 1e-5:
                    g -= l2 * weights[f]
                    square[f] += g * g
                    weights[f] += rate * g / math.sqrt(square[f])
    out: Weights = {k: {} for k in ("pairs", *TYPES)}
    for (kind, f), k in index.items():
        if f == "bias" or abs(weights[k]) >= 0.02:
            out[kind][f] = round(weights[k], 3)
    return out


# ---- on tables --------------------------------------------------------------------------------------------
def _known_names(given: DataFrame | None) -> list[str]:
    """Given names of a list whose size does not grow with the texts."""
    return [] if given is None else sorted(r[0] for r in given.select("given_name").filter("given_name is not null").distinct().collect())


def _worker(spark: SparkSession, names: list[str], tokenizers: str) -> Callable[[], Callable[[str], list[tuple[int, int, str]]]]:
    """What a task calls first: it sets up the words and gives segments() for texts, each distinct short text worked on once."""
    shared = spark.sparkContext.broadcast(read_usual(tokenizers))  # some 50,000 words, whatever the input

    def ready() -> Callable[[str], list[tuple[int, int, str]]]:
        if _usual is not shared.value:
            set_usual(shared.value)
        set_given_names(names)
        return segments

    return ready


def find_personal(df: DataFrame, key: list[str], text: str, given: DataFrame | None = None, tokenizers: str = TOKENIZERS) -> DataFrame:
    """(key..., pii_type) for every row and type of entity its text holds; null and empty texts hold none.

    Every row of the table goes through the model, with its whole text; no rows are moved. given(given_name): names known
    beside the built-in ones, a list of fixed size. Rows with equal keys are rows of their own.
    """
    rows = df.select(*key, F.col(text).alias("_text")).filter("_text is not null and _text <> ''")
    schema = ", ".join([*(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in key), "pii_type string"])
    ready = _worker(df.sparkSession, _known_names(given), tokenizers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = ready()
        for batch in batches:
            at, kinds = [], []
            codes = batch["_text"].dictionary_encode()
            found = [sorted({k for _, _, k in find(value)}) for value in codes.dictionary.to_pylist()]
            for i, code in enumerate(codes.indices.to_pylist()):
                for kind in found[code]:
                    at.append(i)
                    kinds.append(kind)
            taken = batch.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*(taken[k] for k in key), pa.array(kinds, pa.string())], [*key, "pii_type"])

    return rows.mapInArrow(run, schema)


def redact(df: DataFrame, text: str, given: DataFrame | None = None, tokenizers: str = TOKENIZERS) -> DataFrame:
    """df with each entity of the text replaced by [EMAIL], [PHONE], [ID_NUMBER], [ADDRESS] or [NAME]; null stays null, '' stays ''."""
    ready = _worker(df.sparkSession, _known_names(given), tokenizers)

    @F.pandas_udf("string")
    def replace(values):
        ready()
        done = {v: redact_text(v) if v else v for v in values.dropna().unique()}
        return values.map(done)

    return df.withColumn(text, replace(text))


def _all_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = table(spark, sf_dir, "messages").select(F.lit("messages").alias("src"), F.col("rowid").cast("string").alias("row_key"), "text")
    history = table(spark, sf_dir, "history").select(F.lit("history").alias("src"), F.col("hist_id").cast("string").alias("row_key"), F.col("display").alias("text"))
    summaries = table(spark, sf_dir, "summaries").select(F.lit("summaries").alias("src"), F.concat_ws("|", "session_id", "model").alias("row_key"), F.col("summary").alias("text"))
    return messages.unionByName(history).unionByName(summaries)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal(_all_texts(spark, sf_dir), ["src", "row_key"], "text", table(spark, sf_dir, "given_names"))


def p1_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redact(_all_texts(spark, sf_dir), "text", table(spark, sf_dir, "given_names"))


QUERIES = {"p1_found": p1_found, "p1_redacted": p1_redacted}
SQL: dict[str, str] = {}
