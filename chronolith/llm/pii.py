"""Problem 6: personal information in free text, by offset-preserving deobfuscation.

A text runs through transducers that normalise look-alike and wide characters, addresses spelled with ``at`` and
``dot``, and digits written as words. Each keeps, for every character it writes, the source characters it stands for.
Detectors work on the normalised text; what they find is mapped back, so that values are exact substrings of the
source and replacement leaves everything else as it was.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "address", "id_number", "phone", "name")

# Letters of other scripts that look like Latin ones.
LOOK_ALIKES = dict(
    zip("аАВсСԁеЕНіІјЈКМоОрРԛѕЅТхХуУԝαΑΒΕΗΙΚΜΝοΟρΡΤΥΧνι", "aABcCdeEHiIjJKMoOpPqsSTxXyYwaABEHIKMNoOpPTYXvi", strict=True)
)
# Digits as words.
DIGITS = dict(zip("zero oh one two three four five six seven eight nine".split(), "00123456789", strict=True))
#: the longest local part that a mail address may have
MOST_LOCAL = 64
INVISIBLE = "\u200b\u200c\u200d\u2060\ufeff\u00ad"

_WORD_DIGIT = "|".join(DIGITS)
_SPELLED = re.compile(rf"\b(?:{_WORD_DIGIT})(?:[\s-]+(?:{_WORD_DIGIT})){{5,}}\b", re.I)
_BRACKET_AT = re.compile(r"(?<!\s)\s*[\[({<]\s*at\s*[\])}>]\s*", re.I)
_BRACKET_DOT = re.compile(r"(?<!\s)\s*[\[({<]\s*dot\s*[\])}>]\s*", re.I)
_BARE = re.compile(r"(?<![\w+-])[\w+-]+(?: dot [\w+-]+)* at [\w-]+(?: dot [\w-]+)+", re.I)
_BARE_PART = re.compile(r" (at|dot) ", re.I)
_HINT = re.compile(r"\b(?:at|dot)\b", re.I)


class Normal:
    """A text and, for each of its characters, where its source begins and ends."""

    __slots__ = ("ends", "starts", "text")

    def __init__(self, text: str):
        self.text = text
        self.starts: list[int] | None = None
        self.ends: list[int] | None = None

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace spans (in order, not overlapping); a span's source stands for all it was replaced with."""
        if not edits:
            return
        starts = self.starts or list(range(len(self.text)))
        ends = self.ends or list(range(1, len(self.text) + 1))
        parts, new_starts, new_ends, at = [], [], [], 0
        for begin, end, by in edits:
            parts += [self.text[at:begin], by]
            new_starts += starts[at:begin] + [starts[begin]] * len(by)
            new_ends += ends[at:begin] + [ends[end - 1]] * len(by)
            at = end
        parts.append(self.text[at:])
        self.text, self.starts, self.ends = "".join(parts), new_starts + starts[at:], new_ends + ends[at:]

    def source(self, begin: int, end: int) -> tuple[int, int]:
        if self.starts is None or self.ends is None:
            return begin, end
        return self.starts[begin], self.ends[end - 1]


def _fold_letters(normal: Normal) -> None:
    text, edits = normal.text, []
    for i, c in enumerate(text):
        if c < "\x80":
            continue
        if c in INVISIBLE:
            edits.append((i, i + 1, ""))
        elif c in LOOK_ALIKES:
            around = text[max(i - 1, 0) : i] + text[i + 1 : i + 2]
            if any(x < "\x80" and x.isalnum() or x in "@." for x in around):
                edits.append((i, i + 1, LOOK_ALIKES[c]))
        elif unicodedata.east_asian_width(c) == "F" or c in "\u00a0\u2007\u202f\u2010\u2011":
            edits.append((i, i + 1, "-" if c in "\u2010\u2011" else unicodedata.normalize("NFKC", c)))
    normal.rewrite(edits)


def _sub(pattern: re.Pattern, by: str) -> Callable[[Normal], None]:
    return lambda normal: normal.rewrite([(m.start(), m.end(), by) for m in pattern.finditer(normal.text) if m.end() > m.start()])


def _bare(normal: Normal) -> None:
    edits = []
    for m in _BARE.finditer(normal.text):
        edits += [(p.start() + m.start(), p.end() + m.start(), "@" if p[1].lower() == "at" else ".") for p in _BARE_PART.finditer(m[0])]
    normal.rewrite(edits)


def _spelled(normal: Normal) -> None:
    """Digits in place of their words; what lies between them goes."""
    edits = []
    for m in _SPELLED.finditer(normal.text):
        for w in re.finditer(r"[a-z]+|[^a-z]+", m[0], re.I):
            edits.append((w.start() + m.start(), w.end() + m.start(), DIGITS.get(w[0].lower(), "")))
    normal.rewrite(edits)


_at, _dot = _sub(_BRACKET_AT, "@"), _sub(_BRACKET_DOT, ".")


def normalise(text: str) -> Normal:
    normal = Normal(text)
    if not text.isascii():
        _fold_letters(normal)
    if _HINT.search(normal.text):
        _at(normal)
        _dot(normal)
        _bare(normal)
    if _SPELLED.search(normal.text):
        _spelled(normal)
    return normal


_EMAIL = re.compile(r"(?<![\w.+%'-])[\w.+%'-]*\w@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}(?![\w-])")
_SERVICE = re.compile(
    r"(?:^|[._-])(?:no-?reply|do-?not-?reply|mailer-daemon|postmaster|announce|bot|bots|git|hg|svn|build|builds|ops|ci|root|list|lists|"
    r"security-alerts|notifications?|jira|jenkins)(?:[._+-]|@)|@(?:[\w-]+\.)*(?:noreply|lists?|bots?|git|groups|notifications)\.|(?:^|-)team@",
    re.I,
)

_U = "A-ZÀ-ÖØ-ÞĀĂĄĆĈĊČĎĐĒĔĖĘĚĜĞĠĢĤĦĨĪĬĮİĴĶĹĻĽĿŁŃŅŇŊŌŎŐŒŔŖŘŚŜŞŠŢŤŦŨŪŬŮŰŲŴŶŸŹŻŽ"
_W = rf"[{_U}][\w'’]*(?:-[\w'’]+)*"
_TOWN = rf"{_W}(?: {_W})?"
_POST = r"(?: [A-Z]{1,2}\d[A-Z\d]?(?: \d[A-Z]{2})?)?"
_STREET = r"(?:Street|St|Road|Rd|Lane|Ln|Avenue|Ave|Boulevard|Blvd|Drive|Dr|Way|Court|Ct|Place|Pl|Square|Sq|Terrace|Close|Crescent|Row)"
_ADDRESS = re.compile(
    rf"(?<![\w#])(?:"
    rf"P\.? ?O\.? Box \d+(?:, {_TOWN}?{_POST})?(?:,? [A-Z]{{2}} \d{{5}})?"
    rf"|(?:(?:Flat|Apt|Apartment|Unit|Suite)\.? \w+, )?\d{{1,5}}[A-Za-z]?(?: [NSEW]{{1,2}}\.?)?(?: {_W}){{1,3}} {_STREET}\b\.?"
    rf"(?:,? (?:Apt|Apartment|Unit|Suite|#)\.? ?\w+)?(?:, {_TOWN}?{_POST})?(?:,? [A-Z]{{2}} \d{{5}}(?:-\d{{4}})?)?"
    rf"|\d{{1,4}}(?: bis| ter| quater)?,? (?:rue|avenue|boulevard|place|chemin|impasse|quai|allée)(?: (?:du|de la|des|de|d'|de l'))? ?{_W}(?: {_W})?(?:, \d{{5}} {_TOWN})?"
    rf"|(?:Calle|Avenida|Plaza|Paseo|Via|Viale|Piazza|Corso|Rua) {_W}(?: {_W})?,? \d{{1,4}}(?:, \d{{4,5}} {_TOWN})?"
    rf"|[{_U}]\w*(?:weg|straße|strasse|str\.|platz|allee|gasse|ufer|ring) \d{{1,4}}[a-z]?, \d{{4,5}} {_TOWN}"
    rf")(?!\w)"
)

_ID = re.compile(
    r"(?<![\w.-])(?:\d{3}-\d{2}-\d{4}|[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D]|\d{8}-\d{2}[A-Z]|\d{2} \d{3} \d{3} \d{3})(?![\w-])"
)
_ANNOUNCED = re.compile(
    r"\b(?:SSN|social security(?: (?:no\.?|number|nr\.?|#))?|national id(?:entity)?(?: (?:no\.?|number|card))?|tax (?:id|number|no\.?)|passport(?: (?:no\.?|number))?|"
    r"(?:national )?insurance (?:no\.?|number)|NI (?:no\.?|number)|NINO|identity (?:card|number|no\.?)|id (?:card|number|no\.?)|driver'?s licen[cs]e(?: (?:no\.?|number))?|"
    r"personal (?:id|number)|Steuer-?ID|DNI|NIE)(?: is|:|=|#)? *(?P<id>[A-Z0-9]+(?:[ -](?=[A-Z0-9 -]*\d|[A-Z]\b)[A-Z0-9]+){0,5})",
    re.I,
)

_PHONE = re.compile(
    r"(?<![\w.+/#:@-])(?:"
    r"\+\d{1,3}(?:[ .-]?\(0\))?(?:[ ./-]?\(?\d{1,5}\)?){2,6}"
    r"|\(\d{3}\) ?\d{3}[ .-]\d{4}"
    r"|00\d{1,3}(?:[ .-]\d{2,5}){2,5}"
    r"|0[1-9]\d{1,3}(?:/\d{5,9}| \d{3,4} \d{3,4}|-\d{5,8})"
    r"|\d{3}([.-])\d{3}\1\d{4}"
    r")(?![\w/-]|\.\d)"
)

_ANNOUNCED_PHONE = re.compile(r"\b(?:tel(?:ephone)?|phone|mobile|cell|fax|call|dial|ring)\b[.:]? *(?P<phone>\+?\d{8,15})(?![\w-])", re.I)

_TITLE = r"(?:(?:Mr|Mrs|Ms|Miss|Dr|Prof|Herr|Frau|Mme|M)\.? )?"
_INITIALS = r"[A-Z](?:\.? ?[A-Z])?\."
_NAME = (
    rf"(?P<name>(?:{_INITIALS}|[A-Z]{{1,2}}|{_W})(?: (?:{_INITIALS}|[A-Z]\.?|van|von|de|der|den|da|di|la|le|bin|al)){{0,4}} {_W}"
    rf"|{_W}, (?:{_W}|{_INITIALS})(?: [A-Z]\.)?)"
)
_CUES = (
    r"(?:[Tt]hanks(?: again)?(?: goes| go)? to|[Tt]hank you,?|[Tt]hx to|[Cc]redits?(?: goes)? to|[Kk]udos to|[Pp]rops to|\b[A-Za-z]{3,12}(?:ed|en|und|ught)(?: independently)? by|"
    r"[Pp]air(?:ed|ing)? with|[Dd]iscuss(?:ed)? with|[Ss]poke (?:to|with)|[Tt]alked to|[Ww]ork(?:ed|ing) with|[Aa]sk(?:ed)?|[Pp]ing(?:ed)?|[Cc]ontact|[Cc]ourtesy of|"
    r"[Ss]uggestion (?:of|by|from)|[Pp]atch (?:by|from)|[Rr]eview (?:by|from)|[Rr]eport (?:by|from)|[Ii]dea (?:of|by|from)|[Oo]n behalf of|[Aa]ssigned to|[Pp]er|[Dd]ear|[Hh]i|[Hh]ello)"
)
_CUED = re.compile(rf"(?<!\w){_CUES} {_TITLE}{_NAME}(?![\w@])")
_TRAILER = re.compile(rf"^[ \t]*(?:[-*] )?(?:[A-Z][A-Za-z]*(?:-[A-Za-z]+)*-(?:[Bb]y|[Tt]o)|[Cc][Cc]|[Tt]o|[Aa]uthor|[Ff]rom|[Cc]ommitter): *{_TITLE}{_NAME}[ \t]*(?=<|\(|$|\r|,|[.;] )", re.M)
_NEAR_MAIL = re.compile(rf"(?:^|(?<=[,;\s])){_NAME}[ \t]+<[^<>\s]*@")
_IN_BRACKETS = re.compile(rf"@[\w.-]+ \({_NAME}\)")
# Words that make a name one of a group, a product or no name at all.
_NOT_PEOPLE = re.compile(
    r"\b(?:Team|Group|Guild|Bot|Build|Platform|Project|Foundation|Inc|Ltd|GmbH|LLC|Corp|Company|Department|Committee|Support|Router|Server|Service|Release|"
    r"Runtime|Tooling|Frontend|Backend|System|Security|Engineering|Infrastructure|Maintainers|Community|The|This|That|It|We|If|When|With|Without|Add|Fix|Update|Remove|"
    r"Refactor|Merge|Revert|Use|Make|Move|Rename|Both|Some|Only|Previously)\b"
)
_WORD = re.compile(rf"(?<![\w@.+-]){_W}(?![\w@])")
_DIGIT = re.compile(r"\d")


def _plain(word: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", word.lower()) if c.isalpha() and not unicodedata.combining(c))


def _addressed(text: str, addresses: list[str]) -> Iterator[tuple[int, int]]:
    """Two capitalised words, wherever they stand, of which an address in the same text is made: its owner's name."""
    words = [(m.start(), m.end(), _plain(m[0])) for m in _WORD.finditer(text)]
    long = {w for _, _, w in words if len(w) >= 4}
    # family name -> what is left of the local parts that hold it
    rest: dict[str, set[str]] = {}
    for local in {_plain(a.partition("@")[0]) for a in addresses}:
        for i in range(len(local) - 3 if len(local) <= MOST_LOCAL else 0):
            for j in range(i + 4, len(local) + 1):
                if local[i:j] in long:
                    rest.setdefault(local[i:j], set()).add(local[:i] + local[j:])
    if not rest:
        return
    for (begin, end, first), (after, last, second) in zip(words, words[1:], strict=False):
        if not (second in rest or first in rest) or after - end > 4 or not re.fullmatch(r" (?:[A-Z]\.? )?", text[end:after]):
            continue
        for family, given in ((second, first), (first, second)):
            if any(given[:k] in rest.get(family, ()) for k in range(1, len(given) + 1)):
                yield begin, last
                break


def _details(text: str) -> Iterator[tuple[str, int, int]]:
    """(kind, begin, end) of everything found in a normalised text; may overlap, earlier kinds come first."""
    addresses = []
    if "@" in text:
        for m in _EMAIL.finditer(text):
            addresses.append(m[0])
            begin = m.start()
            value = m[0].lstrip("'.-")
            begin = m.end() - len(value)
            if not _SERVICE.search(re.sub(r"\+[^@]*@", "@", value)) and text[m.end() : m.end() + 1] not in (":", "/"):
                yield "email", begin, m.end()
    if _DIGIT.search(text):
        for m in _ADDRESS.finditer(text):
            yield "address", m.start(), m.end()
        for m in _ANNOUNCED.finditer(text):
            if sum(c.isdigit() for c in m["id"]) >= 5:
                yield "id_number", m.start("id"), m.end("id")
        for m in _ID.finditer(text):
            yield "id_number", m.start(), m.end()
        for m in _ANNOUNCED_PHONE.finditer(text):
            yield "phone", m.start("phone"), m.end("phone")
        for m in _PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                yield "phone", m.start(), m.end()
    patterns = [_TRAILER] if ":" in text else []
    if "@" in text:
        patterns += [_NEAR_MAIL, _IN_BRACKETS]
    for pattern in [*patterns, _CUED]:
        for m in pattern.finditer(text):
            if not _NOT_PEOPLE.search(m["name"]):
                yield "name", m.start("name"), m.end("name")
    if addresses:
        for begin, end in _addressed(text, addresses):
            if not _NOT_PEOPLE.search(text, begin, end):
                yield "name", begin, end


def find(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, begin, end) in the source text, in order and without overlaps; nothing for a null or empty text."""
    if not text:
        return []
    normal = normalise(text)
    begins: list[int] = []
    taken: list[tuple[int, int, str]] = []
    for kind, begin, end in _details(normal.text):
        begin, end = normal.source(begin, end)
        i = bisect_left(begins, begin)
        if (i and taken[i - 1][1] > begin) or (i < len(taken) and taken[i][0] < end):
            continue
        begins.insert(i, begin)
        taken.insert(i, (begin, end, kind))
    return [(kind, begin, end) for begin, end, kind in taken]


BARE_ADDRESS = re.compile(r"\s*[^\s@<>()\[\],;:]+@[^\s@<>()\[\],;:]+\s*")


def find_in_address_field(text: str | None) -> list[tuple[str, int, int]]:
    """As ``find``, but nothing where the field is one bare address."""
    return [] if not text or BARE_ADDRESS.fullmatch(text) else find(text)


def replace(text: str | None, found: list[tuple[str, int, int]]) -> str | None:
    """The text with ``[EMAIL]``, ``[PHONE]``, ``[ID_NUMBER]``, ``[ADDRESS]`` and ``[NAME]`` in place of what was found."""
    if not found or text is None:
        return text
    parts, at = [], 0
    for kind, begin, end in found:
        parts += [text[at:begin], f"[{kind.upper()}]"]
        at = end
    return "".join([*parts, text[at:]])


FINDERS = {"text": find, "address": find_in_address_field}


def personal_items(df: DataFrame, key: str, fields: dict[str, str]) -> DataFrame:
    """``key, field, kind, value``, each once: the personal items in the given columns.

    ``fields`` maps a column to ``text`` (free text) or ``address`` (a field meant for one mail address, in which a
    bare address is no item). Null and empty fields have none; other columns are not read; texts are read whole.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at: list[int] = []
            rows: list[tuple[str, str, str]] = []
            for field, way in fields.items():
                finder = FINDERS[way]
                for i, text in enumerate(batch.column(field).to_pylist()):
                    for item, begin, end in finder(text):
                        at.append(i)
                        rows.append((field, item, text[begin:end]))
            columns = [pa.array([r[i] for r in rows], pa.string()) for i in range(3)]
            keys = batch.column(key).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([keys, *columns], names=[key, "field", "kind", "value"])

    columns = [F.col(c).cast("string").alias(c) for c in fields]
    found = df.select(key, *columns).mapInArrow(run, f"`{key}` {kind}, field string, kind string, value string")
    return found.distinct()


def redacted(df: DataFrame, key: str, fields: dict[str, str]) -> DataFrame:
    """``key`` and the given columns with typed placeholders; a row for every row, nulls stay null."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = []
            for field, way in fields.items():
                finder = FINDERS[way]
                columns.append(pa.array([replace(t, finder(t)) for t in batch.column(field).to_pylist()], pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column(key), *columns], names=[key, *fields])

    columns = [F.col(c).cast("string").alias(c) for c in fields]
    out = ", ".join(f"`{c}` string" for c in fields)
    return df.select(key, *columns).mapInArrow(run, f"`{key}` {kind}, {out}")
