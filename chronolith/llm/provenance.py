"""Problem 2: generated, minified, vendored and data files among source files, by winnowing.

The token stream of a file (comments left out) is normalised in two ways and fingerprinted by winnowing:

- its text: numbers and strings reduced to their kind, names kept. Most of a copied file's fingerprints recur in
  several unrelated repositories;
- its form: names reduced to their kind, too, in longer runs. What a program wrote repeats the same few forms over and
  over and everywhere; what a person wrote does not, save for short pieces.

Fingerprints decide first. What they leave open is decided by the file's own signs: a generator's notice, numbered
declarations in sequence, code without line breaks and blanks, literal data, the notice of a foreign author. A package
folder alone decides nothing: its package has to be named by a foreign notice somewhere, to carry a version, or to lie
in the package folders of several unrelated repositories.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolith.llm.sizes import attach, small_side
from chronolith.session import cut

#: tokens of a fingerprinted run, and runs of which one is kept: for a file's text and for its form
TEXT, FORM = (25, 16), (80, 40)
#: names that a run of text has to hold to say anything about where it comes from
NAMES = 5
#: this share of the fingerprints has to recur in at least so many other repositories; files of fewer fingerprints of
#: their text, or of fewer tokens, are left to their signs
COPIED, OTHERS, PRINTS, TOKENS = 0.6, 2, 6, 160

# Words of programming languages that belong to the form of a program.
WORDS = frozenset(
    "if else elif for while do switch match case default return break continue const let var int def class function func fn static struct enum "
    "import from require include export package new delete try catch except finally throw raise with as in is not and or await async yield void "
    "string number bool boolean char float double unsigned malloc free sizeof null none nil true false self this public private protected".split()
)

_LINE_COMMENT = re.compile(r"^\s*(?://|#(?!\s*(?:include|define|if|ifdef|ifndef|else|endif|pragma|undef)\b)|--(?!\S)|;;|%)")
_BLOCK_COMMENT = re.compile(r"/\*.*?\*/|<!--.*?-->", re.S)
_TOKEN = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|[^\W\d]\w*|\d[\w.]*|[^\w\s]")
_NUMBER = re.compile(r"[-+]?(?:0[xX][0-9a-fA-F]+|\d+(?:\.\d+)?(?:[eE][-+]?\d+)?)[uUlLfF]?")
_LITERALS = re.compile(rf"(?:{_NUMBER.pattern}[\s,;()\[\]{{}}]+){{5,}}{_NUMBER.pattern}[\s,;()\[\]{{}}]*")
_ENCODED = re.compile(r"[\"'`][A-Za-z0-9+/=_-]{40,}[\"'`]|(?:\\x[0-9a-fA-F]{2}){16,}")
_NUMBERED = re.compile(r"[A-Za-z]_?(\d{1,6})\b")
_NOTICE = re.compile(
    r"@generated\b|\bauto-?\s?generated\b|\bautomatically generated\b|\b(?:code|file) generated by\b|^[^\w\n]*generated (?:by|from|with)\b|"
    r"\bmachine-(?:made|generated)\b|\b(?:erzeugt|generiert) (?:von|mit|durch)\b|\bgénéré (?:par|automatiquement)\b|\bgenerado (?:por|automáticamente)\b|"
    r"\bсгенерирован|\bdo not (?:edit|modify)\b.{0,40}\b(?:generat|manual|by hand)|\b(?:changes|edits) will be (?:lost|overwritten)\b",
    re.I | re.M,
)
_FOREIGN = re.compile(
    r"\b(?:imported|copied|taken|vendored) (?:unchanged |verbatim |unmodified )?from (?!.*\bwe used\b)(?P<origin>[\w.-]+)|\bupstream release\b|\breport bugs upstream\b|"
    r"^[^\w\n]*version v?\d+(?:\.\d+)+ of (?P<product>[\w.-]+)|\bcopyright (?:\(c\) |© )?\d{4}(?:-\d{4})? (?:the |by )?(?P<who>[\w.-]+)(?P<kind> (?:authors|project|developers|contributors|team|foundation))?|"
    r"^[^\w\n]*(?:\(c\)|©) ?\d{4}(?:-\d{4})? (?:the )?(?P<by>[\w.-]+) (?:authors|project|developers|contributors|team|foundation)",
    re.I | re.M,
)
_GRANT = re.compile(r"\b(?:redistribution|redistributed|distributed|licensed|permitted|permission)\b", re.I)
_TERMS = re.compile(r"\b(?:licen[cs]e|terms)\b", re.I)
_LICENCE_PATH = re.compile(r"/licen[cs]e\b", re.I)
_PACKAGE_FOLDER = re.compile(
    r"(?:^|/)(?:vendor|vendored|third[_-]party|node_modules|bower_components|extern|externals?|deps|Godeps|Pods)/(?:@[^/]+/)?"
    r"(?P<package>[^/]+?)(?P<version>[-@_]?v?\d+(?:\.\d+)+)?/.*[^/]$"
)
_WORKSPACE = {"apps", "libs", "services", "crates", "packages", "modules", "pkg", "projects", "components"}


def repository(path: str) -> str:
    """The part of a tree that counts as one repository: its first folder, or two where the first only collects projects."""
    parts = path.split("/")
    return "/".join(parts[:2]) if parts[0] in _WORKSPACE and len(parts) > 2 else parts[0] if len(parts) > 1 else ""


def split_comments(text: str) -> tuple[str, str]:
    """(comments before the first code, all lines of code that are not blank) of a text."""
    head: list[str] = []
    plain = _BLOCK_COMMENT.sub(lambda m: "\n" * m[0].count("\n"), text)
    block = _BLOCK_COMMENT.match(text.lstrip())
    if block:
        head.append(block[0])
    code, seen = [], False
    for line in plain.splitlines():
        if _LINE_COMMENT.match(line):
            if not seen:
                head.append(line)
        elif line.strip():
            seen = True
            code.append(line)
    return "\n".join(head), "\n".join(code)


def licence_terms(head: str) -> bool:
    """Whether a line grants something and then names a licence or terms; each line is read once, however long."""
    if _LICENCE_PATH.search(head):
        return True
    grants = ((line, _GRANT.search(line)) for line in head.split("\n"))
    return any(m and _TERMS.search(line, m.end()) for line, m in grants)


def package(path: str) -> tuple[str | None, bool]:
    """The package whose folder a path lies in, in lower case, and whether the folder carries its version."""
    m = _PACKAGE_FOLDER.search(path)
    return (m["package"].lower(), m["version"] is not None) if m else (None, False)


def foreign_notices(head: str, own: frozenset[str] = frozenset()) -> tuple[bool, list[str]]:
    """Whether a head comment holds a notice of a foreign author, and who or what such notices name."""
    found, named = False, set()
    terms = None
    for m in _FOREIGN.finditer(head):
        who = (m["who"] or m["by"] or "").lower()
        if who:
            terms = licence_terms(head) if terms is None else terms
            if who in own or not (m["kind"] or m["by"]) or not terms:
                continue
        found = True
        named |= {x.lower().rstrip(".") for x in (who, m["origin"], m["product"]) if x}
    return found, sorted(named)


def own_signs(head: str, code: str, own: frozenset[str] = frozenset()) -> tuple[str | None, list[str]]:
    """``generated``, ``minified``, ``data`` or ``vendored`` if the text itself shows it, and the foreign names in its notices.

    The text comes as ``split_comments`` parts it; ``own`` are our own copyright holders.
    """
    foreign, named = foreign_notices(head, own)
    return _sign(head, code) or ("vendored" if foreign else None), named


def _sign(head: str, code: str) -> str | None:
    if _NOTICE.search(head):
        return "generated"
    size = len(code)
    if not size:
        return None
    lines = code.split("\n")
    blanks = 1 - sum(map(len, code.split())) / size
    literal = sum(len(m[0]) for m in _LITERALS.finditer(code)) + sum(len(m[0]) for m in _ENCODED.finditer(code))
    if literal >= 0.6 * size and size >= 200:
        return "data"
    if size >= 300 and blanks < 0.09 and size / len(lines) > 120:
        return "minified"
    if len(lines) >= 8:
        numbers = {int(n) for n in _NUMBERED.findall(code)}
        run = 0
        while run in numbers:
            run += 1
        shapes: dict[str, int] = {}
        for line in re.sub(r"\d+", "0", re.sub(r"[^\W\d]\w*", "w", code)).split("\n"):
            shape = line.strip()
            shapes[shape] = shapes.get(shape, 0) + 1
        top = sum(sorted(shapes.values(), reverse=True)[:4]) / len(lines)
        if run >= 6 and run * 6 >= len(lines) and top >= 0.6:
            return "generated"
    return None


_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 2**64)


def _powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.r_[np.uint64(1), np.full(max(n - 1, 0), base, np.uint64)], dtype=np.uint64)[:n]


def winnow(hashes: np.ndarray, run: int, window: int, telling: np.ndarray | None = None, least: int = 0) -> np.ndarray:
    """Winnowed 64-bit fingerprints of a stream of token hashes, each once; none for fewer tokens than a run.

    With ``telling`` flags, fingerprints of runs with fewer than ``least`` such tokens are left out.
    """
    n = len(hashes) - run + 1
    if n < 1:
        return np.empty(0, np.int64)
    summed = np.r_[np.uint64(0), np.cumsum(hashes * _powers(_BASE, len(hashes)), dtype=np.uint64)]
    rolled = (summed[run:] - summed[:-run]) * _powers(_BACK, n)
    rolled ^= rolled >> np.uint64(29)
    at = np.lib.stride_tricks.sliding_window_view(rolled, min(window, n)).argmin(axis=1)
    at = np.unique(at + np.arange(len(at)))
    if telling is not None:
        flags = np.r_[0, np.cumsum(telling)]
        at = at[flags[at + run] - flags[at] >= least]
    return np.unique(rolled[at]).view(np.int64)


def fingerprints(code: str) -> tuple[np.ndarray, np.ndarray, int]:
    """Fingerprints of the tokens of code without comments, those of its form, and the number of tokens."""
    tokens = _TOKEN.findall(code)
    kinds: dict[str, tuple[str, str]] = {}
    for token in set(tokens):
        first = token[0]
        plain = "0" if first.isdigit() else '""' if first in "\"'" and len(token) > 1 else token
        name = (first.isalpha() or first == "_") and token.lower() not in WORDS
        kinds[token] = (plain, "w" if name else plain)
    codes = {x: xxhash.xxh64_intdigest(x) for pair in kinds.values() for x in pair}
    kept, form = (np.array([codes[kinds[t][i]] for t in tokens], np.uint64) for i in (0, 1))
    names = np.array([kinds[t][1] == "w" for t in tokens], np.int64)
    return winnow(kept, *TEXT, names, NAMES), winnow(form ^ np.uint64(1), *FORM), len(tokens)


_READ = (
    "path string, repo string, sign string, named array<string>, package string, versioned boolean, tokens int, "
    "text array<long>, form array<long>"
)


def _read(own: frozenset[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for path, text in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                if path is None or text is None or not text.strip():
                    continue
                head, code = split_comments(text)
                sign, named = own_signs(head, code, own)
                kept, form, tokens = fingerprints(code)
                rows.append((path, repository(path), sign, named, *package(path), tokens, kept, form))
            strings, longs = pa.list_(pa.string()), pa.list_(pa.int64())
            types = [pa.string(), pa.string(), pa.string(), strings, pa.string(), pa.bool_(), pa.int32(), longs, longs]
            names = [c.split()[0] for c in _READ.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)

    return run


def _recurring(read: DataFrame) -> DataFrame:
    """``row, text_shared, form_shared``: how many of a file's fingerprints at least ``OTHERS`` other repositories have."""
    loose = read.select("row", "repo", F.lit("t").alias("kind"), F.explode("text").alias("print"))
    loose = loose.unionByName(read.select("row", "repo", F.lit("f").alias("kind"), F.explode("form").alias("print")))
    # files of a repository first, then repositories: no task receives all files of a fingerprint
    by_repo = loose.groupBy("kind", "print", "repo").agg(F.count(F.lit(1)).alias("files"))
    spread = by_repo.groupBy("kind", "print").agg(F.count(F.lit(1)).alias("repos"), F.sum("files").alias("files"))
    spread = cut(spread.where(F.col("repos") > OTHERS).select(F.concat("kind", F.col("print").cast("string")).alias("key"), "files"))
    total = read.agg(F.sum(F.size("text") + F.size("form"))).first()[0] or 0
    keyed = loose.select("row", "kind", F.concat("kind", F.col("print").cast("string")).alias("key"))
    shared = attach(keyed, spread, "key", "files", total)
    return shared.groupBy("row").agg(F.count_if(F.col("kind") == "t").alias("text_shared"), F.count_if(F.col("kind") == "f").alias("form_shared"))


def _packages(read: DataFrame) -> DataFrame:
    """``row`` of the files in a package folder whose package is known to be foreign."""
    inside = read.where("package is not null").select("row", "repo", "package", "versioned")
    several = inside.groupBy("package").agg(F.count_distinct("repo").alias("repos"), F.max("versioned").alias("versioned"))
    named = read.select(F.explode("named").alias("package"))
    known = cut(several.where((F.col("repos") > OTHERS) | F.col("versioned")).select("package").unionByName(named).distinct())
    return inside.join(small_side(known), "package", "left_semi").select("row")


def foreign_files(df: DataFrame, path: str, content: str, own: tuple[str, ...] = (), signs: bool = True) -> DataFrame:
    """``path, reason, evidence, recurring, form_recurring`` of every file with content; ``reason`` is null for hand-written ones.

    ``recurring`` and ``form_recurring`` are the shares of a file's fingerprints, of its text and of its form, found in
    at least ``OTHERS`` other repositories. ``evidence`` says what decided: ``copy`` (the text recurs), ``form`` (the
    form recurs), ``sign`` (the file's own signs) or ``package`` (its folder, confirmed). Without ``signs`` only
    fingerprints decide. Null, empty and blank contents and null paths are left out; a repeated path is judged row by
    row; other columns are not read.
    """
    source = df.select(F.col(path).cast("string").alias("path"), F.col(content).cast("string").alias("content"))
    read = cut(source.mapInArrow(_read(frozenset(map(str.lower, own))), _READ).withColumn("row", F.monotonically_increasing_id()))
    judged = read.select("row", "path", "sign", "tokens", F.size("text").alias("prints"), F.size("form").alias("forms"))
    judged = judged.join(_recurring(read).hint("merge"), "row", "left")
    share = lambda part, whole: F.coalesce(F.try_divide(F.col(part).cast("double"), F.col(whole)), F.lit(0.0))
    judged = judged.withColumns({"recurring": share("text_shared", "prints"), "form_recurring": share("form_shared", "forms")})
    copy = (F.col("recurring") >= COPIED) & (F.col("prints") >= PRINTS)
    form = (F.col("form_recurring") >= COPIED) & (F.col("tokens") >= TOKENS)
    evidence = F.when(copy, "copy").when(form, "form")
    if signs:
        judged = judged.join(_packages(read).withColumn("packaged", F.lit(True)).hint("merge"), "row", "left")
        evidence = evidence.when(F.col("sign").isNotNull(), "sign").when(F.col("packaged"), "package")
    made = F.col("sign") if signs else F.lit(None).cast("string")
    made = F.coalesce(F.when(made != "vendored", made), F.lit("generated"))
    reason = F.when(F.col("evidence").isin("copy", "package"), "vendored").when(F.col("evidence") == "form", made)
    judged = judged.withColumn("evidence", evidence).withColumn("reason", reason.otherwise(F.col("sign")) if signs else reason)
    return judged.select(F.col("path").alias(path), "reason", "evidence", "recurring", "form_recurring")
