"""Security patterns in commit messages: matches, findings and their risk.

All patterns are literals inside one projection: each is compiled once, no join and no shuffle is needed, and a
message is looked at where it lies.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolith.options import DEFAULT, Options

CVE, FIX = "CVE Reference", "Security Fix"


@dataclass(frozen=True)
class Pattern:
    ord: int
    name: str
    regex: str
    severity: str
    category: str
    cwe: str | None
    description: str = ""
    examples: tuple[str, ...] = ()


# Name, expression (case is ignored), severity, category, CWE, description, examples.
BUILTIN = (
    ("Use After Free", r"\b(use[-\s]after[-\s]free|uaf|dangling[-\s]pointer)\b", "Critical", "MemorySafety", "CWE-416",
     "Potential use-after-free vulnerability", ("Fix use after free", "UAF vulnerability")),
    ("Buffer Overflow", r"\b(buffer[-\s]overflow|stack[-\s]overflow|heap[-\s]overflow|bof|ovflw|StackO)\b", "Critical", "MemorySafety", "CWE-120",
     "Potential buffer overflow vulnerability", ("Fix buffer overflow", "Stack overflow protection")),
    ("Double Free", r"\b(double[-\s]free|free[-\s]after[-\s]free)\b", "High", "MemorySafety", "CWE-415",
     "Potential double-free vulnerability", ("Fix double free",)),
    ("Race Condition", r"\b(race[-\s]condition|data[-\s]race|concurrency[-\s]bug)\b", "High", "Concurrency", "CWE-362",
     "Potential race condition vulnerability", ("Fix race condition",)),
    ("Memory Leak", r"\b(memory[-\s]leak|mem[-\s]leak|resource[-\s]leak)\b", "Medium", "MemorySafety", "CWE-401",
     "Potential memory leak", ("Fix memory leak",)),
    ("Null Pointer Dereference", r"\b(null[-\s]pointer|nullptr[-\s]dereference|segfault|sigsegv)\b", "Medium", "MemorySafety", "CWE-476",
     "Potential null pointer dereference", ("Fix null pointer", "Segmentation fault")),
    ("Code Injection", r"\b(code[-\s]injection|command[-\s]injection|sql[-\s]injection|remote[-\s]code[-\s]execution|rce)\b", "Critical", "CodeInjection", "CWE-94",
     "Potential code injection vulnerability", ("Fix code injection", "SQL injection")),
    ("Type confusion", r"\b(type confusion|confused)\b", "Critical", "CodeInjection", "CWE-843",
     "Access of Resource Using Incompatible Type ('Type Confusion')", ("Fix code injection", "Type confusion")),
    ("Authentication Bypass", r"\b(auth[-\s]bypass|authentication[-\s]bypass|privilege[-\s]escalation)\b", "Critical", "AuthenticationAuthorization", "CWE-287",
     "Potential authentication bypass", ("Fix auth bypass",)),
    ("Cross-Site Scripting", r"\b(xss|cross[-\s]site[-\s]scripting)\b", "Medium", "WebSecurity", "CWE-79",
     "Potential XSS vulnerability", ("Fix XSS",)),
    ("Weak Cryptography", r"\b(weak[-\s]crypto|weak[-\s]cipher|broken[-\s]crypto|md5|sha1\b|des\b|rc4)\b", "Medium", "Cryptography", "CWE-327",
     "Weak cryptographic implementation", ("Replace weak crypto",)),
    ("CVE Reference", r"\bcve[-\s]?(\d{4}[-\s]?\d{4,})\b", "Info", "Generic", None,
     "CVE reference found", ("CVE-2021-1234",)),
    ("Security Fix", r"\b(security[-\s]fix|security[-\s]patch|vulnerability|exploit|malicious|vulnerable|fallthrough)\b", "Info", "Generic", None,
     "General security-related change", ("Security fix",)),
)
# Set -> category; ``all`` takes every pattern and any other name all but the generic ones.
SETS = {"memorysafety": "MemorySafety", "crypto": "Cryptography", "web": "WebSecurity"}


def builtin_patterns() -> list[Pattern]:
    return [Pattern(i, *row) for i, row in enumerate(BUILTIN)]


def pattern_set(name: str, options: Options = DEFAULT) -> list[Pattern]:
    """The patterns of a set, custom ones appended and numbered on; an unknown name gives all that are not generic."""
    chosen = builtin_patterns()
    if name in SETS:
        chosen = [p for p in chosen if p.category == SETS[name]]
    elif name != "all":
        chosen = [p for p in chosen if p.category != "Generic"]
    own = [
        Pattern(len(BUILTIN) + i, c.name, c.pattern, c.severity, c.category, None, c.description) for i, c in enumerate(options.custom_patterns)
    ]
    return chosen + own


def needed_words(regex: str) -> list[list[str]] | None:
    """For each alternative of an expression, words that every text it matches contains; None if that is not clear."""
    if re.search(r"\\[A-Z]", regex):
        return None
    body = regex.replace(r"\b", "")
    if body.startswith("(") and body.endswith(")") and body.count("(") == 1:
        body = body[1:-1]
    out = []
    for way in body.split("|"):
        plain = re.sub(r"\(.*|\[[^\]]*\][?*]?|\\.", " . ", way)
        words = [] if re.search(r"[*+?{}^$]", plain) else re.findall(r"[A-Za-z0-9]{2,}", plain)
        if not words:
            return None
        out.append([w.lower() for w in words])
    return out


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def _like(text: Column, regex: str) -> Column:
    """Whether an expression occurs, with words, blanks and case as in Unicode; plain ASCII text needs no such tables."""
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, F.regexp_like(text, F.lit(f"(?i){regex}"))).otherwise(F.regexp_like(text, F.lit(f"(?iuU){regex}")))


#: letters that are the same as ASCII ones to an expression that ignores case, but not in lower case
FOLDED = ("ſıİ", "sii")


def any_match(message: Column, patterns: list[Pattern]) -> Column:
    """Whether any pattern occurs.

    An expression is only tried where the words it needs are found in the folded text, which an array binds so that it
    is made once and which folds all that an expression ignoring case does. In plain ASCII text it is tried on the
    folded text.
    """
    if not patterns:
        return F.lit(False)
    text = F.coalesce(message, F.lit(""))
    plain = F.octet_length(text) == F.length(text)

    def tries(low: Column) -> Column:
        found = []
        for p in patterns:
            ways = needed_words(p.regex)
            like = F.when(plain, F.regexp_like(low, F.lit(p.regex.lower()))) if ways else F.when(plain, F.regexp_like(text, F.lit(f"(?i){p.regex}")))
            like = like.otherwise(F.regexp_like(text, F.lit(f"(?iuU){p.regex}")))
            has = [reduce(lambda a, b: a & b, (F.contains(low, F.lit(w)) for w in way)) for way in ways or []]
            found.append(_any(has) & like if has else like)
        return _any(found)

    return F.exists(F.array(F.lower(F.translate(text, *FOLDED))), tries)


def hits(message: Column, patterns: list[Pattern]) -> Column:
    """Array of ``at, text``: the places in ``patterns`` of those that occur in a message, with the first text that matches."""
    text = F.coalesce(message, F.lit(""))
    rows = [
        F.when(_like(text, p.regex), F.struct(F.lit(i).alias("at"), F.regexp_extract(text, f"(?iuU){p.regex}", 0).alias("text")))
        for i, p in enumerate(patterns)
    ]
    return F.filter(F.array(*rows), lambda x: x.isNotNull()) if rows else F.array().cast("array<struct<at:int,text:string>>")


def described(found: Column, patterns: list[Pattern]) -> Column:
    """``hits`` with all that is known of their patterns; nothing is matched again.

    The reference of a CVE goes with its own pattern and those behind it.
    """
    if not patterns:
        return F.array().cast(MATCHES)
    table = F.array(*(F.struct(F.lit(p.ord).alias("ord"), F.lit(p.name).alias("name"), F.lit(p.severity).alias("severity"), F.lit(p.category).alias("category")) for p in patterns))
    cve = next((i for i, p in enumerate(patterns) if p.name == CVE), None)
    none = F.array().cast("array<string>")
    if cve is None:
        references = none
    else:
        named = F.transform(F.filter(found, lambda m: m["at"] == cve), lambda m: F.concat(F.lit("CVE-"), F.regexp_extract(m["text"], f"(?iuU){patterns[cve].regex}", 1)))
        references = F.filter(named, lambda x: x != "CVE-")

    def row(m: Column) -> Column:
        p = F.element_at(table, m["at"] + 1)
        return F.struct(
            p["ord"].alias("ord"),
            p["name"].alias("pattern_name"),
            m["text"].alias("matched_text"),
            p["severity"].alias("severity"),
            p["category"].alias("category"),
            F.lit("commit_message").alias("file_path"),
            F.lit(None).cast("bigint").alias("line_number"),
            (F.when(m["at"] >= cve, references).otherwise(none) if cve is not None else none).alias("cve_references"),
        )

    return F.transform(found, row)


MATCHES = (
    "array<struct<ord:int,pattern_name:string,matched_text:string,severity:string,category:string,file_path:string,"
    "line_number:bigint,cve_references:array<string>>>"
)


def matches(message: Column, patterns: list[Pattern]) -> Column:
    """Array of structs for the patterns that occur in a message, in their order, with the first text that matches."""
    return described(hits(message, patterns), patterns)


def risk_score(matched: Column, files: Column, options: Options = DEFAULT) -> Column:
    """Severity weights times the root of the number of files, doubled by a CVE, 10 at most; 0 without files."""
    weights = F.create_map(*(x for k, v in options.severity_weights.items() for x in (F.lit(k), F.lit(v))))
    base = F.aggregate(matched, F.lit(0.0), lambda total, m: total + F.coalesce(F.try_element_at(weights, m["severity"]), F.lit(0.0)))
    cve = F.when(F.exists(matched, lambda m: m["pattern_name"] == CVE), 2.0).otherwise(1.0)
    return F.least(base * F.sqrt(F.coalesce(files, F.lit(0)).cast("double")) * cve, F.lit(10.0))


def matched(commits: DataFrame, options: Options = DEFAULT) -> DataFrame:
    """The commits whose message holds a pattern, with ``hits``; rows are matched where they lie, once."""
    chosen = pattern_set(options.patterns, options)
    return commits.where(any_match(F.col("message"), chosen)).withColumn("hits", hits(F.col("message"), chosen))


def findings(commits: DataFrame, files: DataFrame, options: Options = DEFAULT) -> DataFrame:
    """One row per commit with a match: its matches, files, risk and CVE references.

    ``commits`` has commit_id, message, author and authored_date, once a commit, and ``hits`` if it was ``matched``
    already; ``files`` commit_id and path. Commits without files have a risk of 0. Messages are matched before the
    join, so only commits with a match are shuffled.
    """
    chosen = pattern_set(options.patterns, options)
    hit = commits if "hits" in commits.columns else matched(commits, options)
    changed = files.groupBy("commit_id").agg(F.array_sort(F.collect_set("path")).alias("files_changed"))
    rows = hit.join(changed, "commit_id", "left").withColumn(
        "files_changed", F.coalesce("files_changed", F.array().cast("array<string>"))
    )
    rows = rows.withColumn("matches", described(F.col("hits"), chosen))
    references = F.array_distinct(F.flatten(F.transform("matches", lambda m: m["cve_references"])))
    return rows.select(
        "commit_id",
        F.col("message").alias("commit_message"),
        "author",
        F.col("authored_date").alias("date"),
        "files_changed",
        "matches",
        F.transform("matches", lambda m: m["pattern_name"]).alias("patterns_matched"),
        risk_score(F.col("matches"), F.size("files_changed"), options).alias("risk_score"),
        references.alias("cve_references"),
    )
