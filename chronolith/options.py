"""Engine options with the defaults every query uses."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class CustomPattern:
    """A message pattern of one's own, appended to the built-in ones."""

    name: str
    pattern: str
    severity: str = "Medium"
    category: str = "Generic"
    description: str = ""


@dataclass(frozen=True)
class Options:
    """What a run can set.

    ``as_of`` replaces the clock, so that results can be repeated. ``compat_nan`` gives the overall risk of 10 for a
    repository without any file; by default a ratio without a denominator counts as 0.
    """

    patterns: str = "vuln"
    stale_days: int = 365
    as_of: str = "2026-05-01 00:00:00"
    max_commits: int = 20_000
    files_per_commit: int = 20
    compat_nan: bool = False
    include_stats: bool = True
    cve_only: bool = False
    output: str = "html"
    custom_patterns: tuple[CustomPattern, ...] = ()
    severity_weights: dict[str, float] = field(
        default_factory=lambda: {"Critical": 9.0, "High": 7.0, "Medium": 5.0, "Low": 3.0, "Info": 1.0}
    )


DEFAULT = Options()
