"""Source-code metrics of files.

A file is one row, so all its metrics come from one pass over its array of lines inside a projection
(``aggregate``): no line is ever shuffled, and a nesting level that depends on all lines before is just the state of
that pass. What scores is written down as rules, one per line:

    weight  what a trimmed line has to show

``'x'`` contains x, ``^'x'`` starts with x, ``!'x'`` does not contain x, ``2*'x'`` contains it twice at least,
``#'x'`` counts its occurrences; a comma means or, ``&`` means and between the groups so formed.
"""

from __future__ import annotations

import re
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolith.functions.paths import extension

# Languages that share rules, by file extension.
FAMILIES = {"rs": "rs", "py": "py", "js": "js", "ts": "js", "jsx": "js", "tsx": "js", "java": "java", "cpp": "c", "c": "c", "h": "c",
            "hpp": "c", "cc": "c", "cxx": "c", "go": "go", "rb": "rb", "php": "php", "cs": "cs"}
#: extensions whose files are analysed (case counts)
ANALYSED = ("rs", "py", "js", "ts", "java", "cpp", "c", "h", "hpp", "go", "rb", "php", "cs")

# Branches that add to the cyclomatic complexity of a line.
CYCLOMATIC = {
    "rs": """
1    'if '
1    'match '
1    'for ', 'while ', 'loop '
1    '?' & !'"'
0.5  '&&', '||'
0.5  #'=>'
""",
    "py": """
1    ^'if ', ' if '
1    ^'elif '
1    ^'for ', ^'while '
1    ^'try:', ^'except '
0.5  ' and ', ' or '
1    ' for ' & '[', '{'
""",
    "js": """
1    'if (', 'if('
1    'else if'
1    'for (', 'for('
1    'while (', 'while('
1    'switch '
0.5  'case '
1    'try {', 'catch ('
0.5  '&&', '||'
0.5  #'?'
""",
    "java": """
1    'if (', 'if('
1    'else if'
1    'for (', 'for('
1    'while (', 'while('
1    'switch ('
0.5  'case '
1    'try {', 'catch ('
0.5  '&&', '||'
""",
    "c": """
1    'if (', 'if('
1    'else if'
1    'for (', 'for('
1    'while (', 'while('
1    'do {'
1    'switch ('
0.5  'case ' & ':'
0.5  '&&', '||'
0.5  #'?'
1    'try {', 'catch (', 'throw '
1.5  'malloc(', 'calloc(', 'realloc('
1    'free('
1    'new ', 'delete '
1.5  '++', '--' & '*'
0.5  '++', '--' & !'*'
2    '(*' & ')('
0.5  '->'
1.5  '#define' & '(' & ')'
3    '__asm', 'asm('
2.5  'goto '
3    'setjmp(', 'longjmp('
1.5  'va_start', 'va_arg', '...'
2    'strcpy(', 'strcat(', 'sprintf(', 'gets(', 'scanf('
1    'strncpy(', 'strncat(', 'snprintf(', 'fgets('
2    'pthread_', 'mutex', 'semaphore'
2    'signal(', 'sigaction('
1    2*'(' & 'int*', 'char*', 'void*', '**)', '(*)'
""",
    "go": """
1    'if '
1    'for '
1    'switch '
0.5  'case '
1    'select {'
0.5  '&&', '||'
1    'if err != nil'
""",
    "rb": """
1    ^'if ', ' if '
1    ^'elsif '
1    ^'for ', ^'while '
0.5  ^'case ', ^'when '
0.5  ' and ', ' or '
0.5  ' do ', ' { '
""",
    "php": """
1    'if (', 'if('
1    'elseif '
1    'for (', 'foreach ('
1    'while ('
1    'switch ('
0.5  'case '
1    'try {', 'catch ('
0.5  '&&', '||'
""",
    "cs": """
1    'if (', 'if('
1    'else if'
1    'for (', 'foreach ('
1    'while ('
1    'switch ('
0.5  'case '
1    'try {', 'catch ('
0.5  '&&', '||'
0.5  '.Where(', '.Select('
""",
    "": """
0.5  #'if'
0.5  #'for'
0.5  #'while'
0.5  #'switch'
0.5  #'case'
0.5  #'catch'
0.5  '&&', '||'
""",
}
# Structures that cost one and the nesting level.
NESTED = {
    "": """
1    'if ', 'else if', 'elif '
1    'else' & !'if'
1    'for ', 'while ', 'do '
1    'switch '
1    'try', 'catch', 'except'
""",
    "rs": """
1    'match '
""",
    "js": """
1    '.then(', '.catch('
""",
    "c": """
1    '#if'
""",
}
# What adds to the cognitive complexity whatever the nesting level.
FLAT = {
    "": """
0.5  '&&', '||'
0.5  #'?'
""",
    "rs": """
1    '?' & !'"'
""",
    "js": """
1    'async ', 'await '
""",
    "c": """
3    'goto '
4    'setjmp', 'longjmp'
2    '(*' & ')('
""",
}
# Lines that begin a function.
FUNCTIONS = {
    "rs": "1 ^'fn ', ' fn ', ^'async fn '",
    "py": "1 ^'def ', ^'async def '",
    "js": "1 'function ', '=> {', 'async function', 'function*'",
    "java": "1 ' void ', ' int ', ' string ', ' bool ', ' double ', ' float ' & '(' & !'='",
    "cs": "1 ' void ', ' int ', ' string ', ' bool ', ' double ', ' float ' & '(' & !'='",
    "go": "1 ^'func ', ' func '",
    "rb": "1 ^'def ', ' def '",
    "php": "1 'function '",
    "": "1 'function ', 'def ', 'fn '",
}
# Either of these two begins a function in the C family.
C_FUNCTIONS = ("1 '(' & ')' & '{'", "1 ^'static ', ^'extern ', ' main(', 'void ', 'int '")
# Lines that open a level: in Python, elsewhere, and for the greatest depth.
PY_OPEN = "1 ^'if ', ^'for ', ^'while ', ^'try:', ^'with '"
DEPTH_OPEN = "1 ^'if ', ^'for ', ^'while '"

_RULE = re.compile(r"^(\d+(?:\.\d+)?)\s+(.*)$")
_ATOM = re.compile(r"(\^|!|#|2\*)?'([^']*)'")


def _parsed(rules: str) -> list[tuple[float, list[list[tuple[str, str]]]]]:
    out = []
    for line in rules.strip().splitlines():
        weight, rest = _RULE.match(line.strip()).groups()
        groups, last = [[]], 0
        for atom in _ATOM.finditer(rest):
            if "&" in rest[last : atom.start()]:
                groups.append([])
            groups[-1].append((atom[1] or "", atom[2]))
            last = atom.end()
        out.append((float(weight), groups))
    return out


# What follows writes SQL text: one expression is parsed at once, where thousands of column objects would be built one by one.


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _count(part: str) -> str:
    return f"((length(x) - length(replace(x, {_text(part)}, ''))) div {len(part)})"


def _shows(atom: tuple[str, str]) -> str:
    how, part = atom
    if how == "^":
        return f"startswith(x, {_text(part)})"
    if how == "2*":
        return f"{_count(part)} >= 2"
    return f"{'not ' if how == '!' else ''}contains(x, {_text(part)})"


def _all(groups: list[list[tuple[str, str]]]) -> str:
    return " and ".join(f"({' or '.join(map(_shows, group))})" for group in groups)


def _holds(rule: str) -> str:
    ((_, groups),) = _parsed(rule)
    return f"({_all(groups)})"


def _score(rules: str) -> str:
    terms = []
    for weight, groups in _parsed(rules):
        if groups[0][0][0] == "#":
            terms.append(f"{_count(groups[0][0][1])} * {weight}D")
        else:
            terms.append(f"if({_all(groups)}, {weight}D, 0D)")
    return f"({' + '.join(terms)})"


def _by_family(of: dict[str, str]) -> str:
    cases = " ".join(f"when {_text(name)} then {value}" for name, value in of.items() if name)
    return f"(case family {cases} else {of['']} end)"


def lines(content: Column) -> Column:
    """The lines of a text, without line ends; none for an empty or null text; a last line end begins no line."""
    parts = F.split(content, r"\r?\n", -1)
    whole = F.when(F.endswith(content, F.lit("\n")), F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    return F.when(content.isNull() | (content == ""), F.array().cast("array<string>")).otherwise(whole)


#: all characters that Unicode calls white space
BLANKS = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(BLANKS))


SKIPPED = "(x = '' or startswith(x, '//') or startswith(x, '#') or startswith(x, '/*') or startswith(x, '*'))"


def maintainability(cyclomatic: Column, count: Column) -> Column:
    """0 without lines, 100 for one line (the logarithms are infinite there), else clamped to 0..100."""
    size = F.ln(count.cast("double"))
    value = F.lit(171.0) - F.lit(5.2) * F.ln(size * 4.0) - F.lit(0.23) * cyclomatic - F.lit(16.2) * size
    return F.when(count == 0, 0.0).when(count == 1, 100.0).otherwise(F.least(F.greatest(value, F.lit(0.0)), F.lit(100.0)))


def _read() -> str:
    """What a trimmed line ``x`` adds, whatever comes before it; each part is evaluated once a line."""
    own = lambda rules: f"({_score(rules[''])} + {_by_family({k: _score(r) if k else '0D' for k, r in rules.items()})})"
    score = lambda value: f"if({SKIPPED}, 0D, {value})"
    starts = {k: _holds(rule) for k, rule in FUNCTIONS.items()} | {"c": f"({_holds(C_FUNCTIONS[0])} or {_holds(C_FUNCTIONS[1])})"}
    parts = {
        "cyclomatic": score(_by_family({name: _score(rules) for name, rules in CYCLOMATIC.items()})),
        "nested": score(own(NESTED)),
        "flat": score(own(FLAT)),
        "step": f"if({SKIPPED}, 0, if(family = 'py', int({_holds(PY_OPEN)}), int(contains(x, '{{')) - int(contains(x, '}}'))))",
        "back": f"int(not {SKIPPED} and (contains(x, '}}') or family = 'py'))",
        "opens": f"int(endswith(x, '{{') or {_holds(DEPTH_OPEN)})",
        "closes": "int(startswith(x, '}'))",
        "functions": f"int({_by_family(starts)})",
    }
    return "transform(lines, x -> named_struct(" + ", ".join(f"'{k}', {v}" for k, v in parts.items()) + "))"


def _pass(line: Column, state: Column) -> Column:
    """The state after a line: sums, and the levels, which never fall below zero."""
    level = F.greatest(state["level"] + line["step"], F.lit(0))
    depth = state["depth"] + line["opens"]
    return F.struct(
        (state["cyclomatic"] + line["cyclomatic"]).alias("cyclomatic"),
        (state["cognitive"] + line["nested"] * (1 + level) + line["flat"]).alias("cognitive"),
        F.greatest(level - line["back"], F.lit(0)).alias("level"),
        F.greatest(depth - line["closes"], F.lit(0)).alias("depth"),
        F.greatest(state["deepest"], depth * line["opens"]).alias("deepest"),
        (state["functions"] + line["functions"]).alias("functions"),
    )


def complexity(files: DataFrame) -> DataFrame:
    """Metrics of every row of ``files`` (path, content); a null content has zeros only.

    Any extension is taken, unknown ones by the general rules; filter with ``analysed`` first to keep to the known ones.
    """
    family = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in FAMILIES.items() for x in kv)), extension(F.col("path"))), F.lit(""))
    start = F.struct(
        F.lit(1.0).alias("cyclomatic"), F.lit(0.0).alias("cognitive"), F.lit(0).alias("level"),
        F.lit(0).alias("depth"), F.lit(0).alias("deepest"), F.lit(0).alias("functions"),
    )
    rows = files.select("path", F.col("content").isNull().alias("absent"), family.alias("family"), F.transform(lines(F.col("content")), trimmed).alias("lines"))
    read = rows.select("path", "absent", F.expr(_read()).alias("lines"))
    seen = read.select("path", "absent", F.size("lines").cast("long").alias("line_count"), F.aggregate("lines", start, lambda s, x: _pass(x, s)).alias("s"))
    zero = lambda value, of: F.when(F.col("absent"), F.lit(of)).otherwise(value)
    return seen.select(
        "path",
        zero(F.col("s.cyclomatic"), 0.0).alias("cyclomatic_complexity"),
        F.col("s.cognitive").alias("cognitive_complexity"),
        F.col("s.deepest").cast("long").alias("nesting_depth"),
        F.col("s.functions").cast("long").alias("function_count"),
        "line_count",
        zero(maintainability(F.col("s.cyclomatic"), F.col("line_count")), 0.0).alias("maintainability_index"),
    )


def analysed(files: DataFrame) -> DataFrame:
    return files.where(extension(F.col("path")).isin(*ANALYSED))


def source_lines(files: DataFrame) -> DataFrame:
    """``path, line_no, text``: every line of every file."""
    return files.select("path", F.posexplode(lines(F.col("content"))).alias("at", "text")).select(
        "path", (F.col("at") + 1).alias("line_no"), "text"
    )


def high_complexity(metrics: DataFrame) -> DataFrame:
    return metrics.where("cyclomatic_complexity > 10")


def risk_factors(metrics: DataFrame) -> DataFrame:
    """Files that are too complex (above 15, high above 25) or nested too deeply (above 5); a file may be both.

    With what is wrong in words and what to do about it; whole numbers are shown without a decimal point.
    """
    score = F.regexp_replace(F.col("cyclomatic_complexity").cast("string"), r"\.0$", "")
    branching = metrics.where("cyclomatic_complexity > 15").select(
        "path",
        F.lit("HighComplexity").alias("factor_type"),
        F.when(F.col("cyclomatic_complexity") > 25, "High").otherwise("Medium").alias("severity"),
        F.concat(F.lit("File "), "path", F.lit(" has high cyclomatic complexity ("), score, F.lit(")")).alias("description"),
        F.array("path").alias("affected_files"),
        F.lit("Consider refactoring to reduce complexity").alias("recommendation"),
    )
    nesting = metrics.where("nesting_depth > 5").select(
        "path",
        F.lit("DeepNesting").alias("factor_type"),
        F.lit("Medium").alias("severity"),
        F.concat(F.lit("File "), "path", F.lit(" has deep nesting (depth: "), F.col("nesting_depth").cast("string"), F.lit(")")).alias("description"),
        F.array("path").alias("affected_files"),
        F.lit("Consider extracting nested logic into separate functions").alias("recommendation"),
    )
    return branching.unionByName(nesting)


# Language names by extension.
LANGUAGES = {"rs": "Rust", "py": "Python", "js": "JavaScript", "ts": "TypeScript", "java": "Java", "cpp": "C++", "c": "C", "h": "C Header",
             "hpp": "C++ Header", "go": "Go", "rb": "Ruby", "php": "PHP", "cs": "C#"}


def language_stats(files: DataFrame) -> DataFrame:
    """Per language: files, lines, blank and comment lines, and its share of all lines in percent.

    A line is a comment if it begins with ``//``, ``#``, ``/*`` or ``*``; line classes of other tools may differ.
    """
    names = F.create_map(*(F.lit(x) for kv in LANGUAGES.items() for x in kv))
    rows = files.select(
        F.try_element_at(names, extension(F.col("path"))).alias("language"), F.transform(lines(F.col("content")), trimmed).alias("l")
    ).where("language is not null")
    counted = rows.select(
        "language",
        F.size("l").alias("lines"),
        F.size(F.filter("l", lambda x: x == "")).alias("blank"),
        F.expr(f"size(filter(l, x -> x <> '' and {SKIPPED}))").alias("comments"),
    )
    out = counted.groupBy("language").agg(
        F.count(F.lit(1)).alias("files"), F.sum("lines").alias("lines"), F.sum("blank").alias("blank_lines"), F.sum("comments").alias("comment_lines")
    )
    total = counted.agg(F.sum("lines")).scalar()
    return out.withColumn("line_percent", F.round(F.coalesce(F.try_divide(F.col("lines") * 100.0, total), F.lit(0.0)), 1))


def language_totals(stats: DataFrame) -> DataFrame:
    """One row: all lines and all files of ``language_stats``."""
    return stats.agg(F.coalesce(F.sum("lines"), F.lit(0)).alias("total_lines"), F.coalesce(F.sum("files"), F.lit(0)).alias("total_files"))
