"""Reports: every table as JSON lines, one JSON document, or an HTML page."""

from __future__ import annotations

import html
import json
from collections.abc import Callable, Iterator
from itertools import chain
from pathlib import Path
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Output(Protocol):
    """A way of rendering the tables of a report, as one text or in parts; register one's own in ``FORMATS``."""

    def __call__(self, tables: dict[str, DataFrame], cve_only: bool = False, include_stats: bool = False) -> str | Iterator[str]: ...


def write_tables(tables: dict[str, DataFrame], folder: str) -> None:
    """Each table as JSON lines in a folder of its own, written by the executors, replacing what was there."""
    for name, rows in tables.items():
        rows.write.mode("overwrite").json(f"{folder}/{name}")


def _rows(rows: DataFrame) -> Iterator[dict]:
    """All rows in order, one partition at a time in the driver."""
    for row in rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).toLocalIterator():
        yield json.loads(row[0])


def json_document(tables: dict[str, DataFrame], cve_only: bool = False, include_stats: bool = False) -> Iterator[str]:
    """All rows of all tables in one indented document, in parts; the options do not filter it."""
    yield "{"
    for n, (name, rows) in enumerate(tables.items()):
        yield f"{',' if n else ''}\n  {json.dumps(name, ensure_ascii=False)}: ["
        k = -1
        for k, row in enumerate(_rows(rows)):
            yield f"{',' if k else ''}\n    " + json.dumps(row, indent=2, ensure_ascii=False).replace("\n", "\n    ")
        yield "\n  ]" if k >= 0 else "]"
    yield "\n}"


SECTIONS = {
    "risk": "Risk", "git": "History", "top_contributors": "Top contributors", "single_author_files": "Files of one author", "totals": "Totals", "stats": "Statistics",
    "dependencies": "Dependencies", "risk_factors": "Risk factors", "code_quality": "Code quality", "heatmap": "Heat map",
    "single_author_extensions": "Extensions of files of one author", "stale_extensions": "Extensions of stale files", "priority_areas": "Priority areas", "vulnerabilities": "Findings", "tests": "Tests",
}
#: sections that are shown only with statistics
STATS_ONLY = {"totals", "stats", "dependencies", "risk_factors", "code_quality", "heatmap", "single_author_extensions", "stale_extensions", "tests"}


#: sections that can be searched, sorted and paged: rows of a page at first, and the columns with a drop-down of their values
PAGED = {"vulnerabilities": (10, ("severity_text", "author")), "code_quality": (50, ("extension",)), "heatmap": (50, ("extension",)), "priority_areas": (25, ())}
SIZES = (10, 25, 50, 100)

STYLE = (
    "body{font-family:sans-serif;margin:2em}table{border-collapse:collapse}td,th{border:1px solid #ccc;padding:.2em .5em;text-align:left}"
    "th{cursor:pointer}.tools{margin:.5em 0}.tools>*{margin-right:.5em}"
)
SCRIPT = """
for (const section of document.querySelectorAll('section[data-size]')) {
  const body = section.querySelector('tbody'), tools = section.querySelector('.tools');
  if (!body) continue;
  const rows = [...body.rows], heads = [...section.querySelectorAll('th')], choices = [...tools.querySelectorAll('select[data-column]')];
  const term = tools.querySelector('input'), size = tools.querySelector('select.size'), strip = tools.querySelector('.strip');
  const at = name => heads.findIndex(h => h.textContent === name), text = (row, k) => row.cells[k].textContent;
  let page = 1, order = null, down = false;
  for (const choice of choices)
    for (const value of [...new Set(rows.map(r => text(r, at(choice.dataset.column))))].sort()) choice.add(new Option(value || '(none)', '=' + value));
  const show = () => {
    const kept = rows.filter(r => r.textContent.toLowerCase().includes(term.value.toLowerCase())
      && choices.every(c => !c.value || c.value === '=' + text(r, at(c.dataset.column))));
    if (order !== null) kept.sort((a, b) => {
      const x = text(a, order), y = text(b, order), numbers = x !== '' && y !== '' && !isNaN(x) && !isNaN(y);
      return (down ? -1 : 1) * (numbers ? x - y : x.localeCompare(y));
    });
    const each = size.value === 'all' ? Math.max(kept.length, 1) : Number(size.value), last = Math.max(1, Math.ceil(kept.length / each));
    page = Math.min(Math.max(page, 1), last);
    body.replaceChildren(...kept.slice((page - 1) * each, page * each));
    const from = Math.max(1, Math.min(page - 2, last - 4));
    strip.replaceChildren(`${kept.length} rows, page `, ...Array.from({length: Math.min(5, last)}, (_, k) => {
      const button = document.createElement('button');
      button.textContent = from + k; button.disabled = from + k === page;
      button.onclick = () => { page = from + k; show(); };
      return button;
    }), ` of ${last}`);
  };
  heads.forEach((h, k) => h.onclick = () => { down = order === k && !down; order = k; page = 1; show(); });
  for (const control of [term, size, ...choices]) control.oninput = () => { page = 1; show(); };
  show();
}
"""


def _tools(size: int, choices: tuple[str, ...]) -> str:
    """The controls of a section; without a script all rows are shown and these do nothing."""
    sizes = "".join(f"<option{' selected' if n == size else ''}>{n}</option>" for n in SIZES) + "<option>all</option>"
    lists = "".join(f"<select data-column='{c}'><option value=''>{c}: all</option></select>" for c in choices)
    return f"<div class='tools'><input type='search' placeholder='Search'>{lists}<select class='size'>{sizes}</select><span class='strip'></span></div>"


def _table(rows: Iterator[dict]) -> Iterator[str]:
    first = next(rows, None)
    if first is None:
        yield "<p>No rows.</p>"
        return
    head = "".join(f"<th>{html.escape(c)}</th>" for c in first)
    show = lambda v: html.escape(v if isinstance(v, str) else json.dumps(v, ensure_ascii=False))
    yield f"<table><thead><tr>{head}</tr></thead><tbody>"
    for r in chain([first], rows):
        yield "<tr>" + "".join(f"<td>{'' if v is None else show(v)}</td>" for v in r.values()) + "</tr>"
    yield "</tbody></table>"


def html_document(tables: dict[str, DataFrame], cve_only: bool = False, include_stats: bool = False) -> Iterator[str]:
    """A page with a section per table and all its rows, in parts; findings only if there are any, statistics only if asked for.

    Long sections can be searched, filtered, sorted by a click on a column and leafed through in the browser.
    """
    yield f"<!doctype html><html><head><meta charset='utf-8'><title>Report</title><style>{STYLE}</style></head><body>"
    for name, title in SECTIONS.items():
        if name not in tables or (name in STATS_ONLY and not include_stats):
            continue
        shown = tables[name]
        if name == "vulnerabilities" and cve_only:
            shown = shown.where(F.size("cve_references") > 0)
        rows = _rows(shown)
        if name == "vulnerabilities":
            first = next(rows, None)
            if first is None:
                continue
            rows = chain([first], rows)
        size, choices = PAGED.get(name, (0, ()))
        choices = tuple(c for c in choices if c in shown.columns)
        yield f"<section id='{name}'{f' data-size={size}' if size else ''}><h2>{title}</h2>{_tools(size, choices) if size else ''}"
        yield from _table(rows)
        yield "</section>"
    yield f"<script>{SCRIPT}</script></body></html>"


FORMATS: dict[str, Output | Callable[..., str]] = {"html": html_document, "json": json_document}


def format_of(name: str) -> str:
    """The known format of a name in any case; HTML for others."""
    return name.lower() if name.lower() in FORMATS else "html"


def with_extension(path: str, kind: str) -> str:
    return path if path.endswith(f".{kind}") else f"{path}.{kind}"


def write_report(tables: dict[str, DataFrame], path: str, kind: str = "html", cve_only: bool = False, include_stats: bool = False) -> str:
    """Render and write a report, replacing the file; returns where it is."""
    kind = format_of(kind)
    target = with_extension(path, kind)
    made = FORMATS[kind](tables, cve_only, include_stats)
    part = Path(f"{target}.part")
    with part.open("w", encoding="utf-8") as file:
        file.writelines([made] if isinstance(made, str) else made)
    part.replace(target)
    return target
