"""Web addresses of commits, files, diffs and issues on code hosts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Host -> path of each kind of page below the repository's address.
PAGES = {
    "GitHub": {"commit": "/commit/{id}", "file": "/blob/{ref}/{path}", "diff": "/commit/{id}.diff", "issue": "/issues/{id}"},
    "GitLab": {"commit": "/-/commit/{id}", "file": "/-/blob/{ref}/{path}", "diff": "/-/commit/{id}.diff", "issue": "/-/issues/{id}"},
    "Bitbucket": {"commit": "/commits/{id}", "file": "/src/{ref}/{path}", "diff": "/commits/{id}/raw", "issue": "/issues/{id}"},
}
# Display names.
NAMES = {"GitHub": "GitHub", "GitLab": "GitLab", "Bitbucket": "Bitbucket", "Other": "Git Repository", "Local": "Local Repository"}
# How a message refers to an issue, in order.
ISSUES = (r"#(\d+)", r"issue\s+#?(\d+)", r"fixes?\s+#?(\d+)", r"closes?\s+#?(\d+)", r"resolves?\s+#?(\d+)")


def repository_type(remote: Column) -> Column:
    """The host a remote address names; ``Local`` without one. The order decides for addresses that name several."""
    url = F.lower(remote)
    named = [F.when(F.contains(url, F.lit(host.lower())), host) for host in ("GitLab", "GitHub", "Bitbucket")]
    return F.when(remote.isNull(), "Local").otherwise(F.coalesce(*named, F.lit("Other")))


def base_url(remote: Column) -> Column:
    """The web address of a remote; null for none, or for an ssh remote that has no path."""
    ssh = r"^.*?git@([^:]+):(.+)$"
    web = F.when(remote.rlike(ssh), F.regexp_replace(remote, ssh, "https://$1/$2"))
    return F.regexp_replace(F.when(F.startswith(remote, F.lit("git@")), web).otherwise(remote), r"(?:\.git)$", "")


def repository_name(remote: Column) -> Column:
    kind = repository_type(remote)
    return F.coalesce(*(F.when(kind == k, name) for k, name in NAMES.items()))


def _page(remote: Column, kind: str, parts: dict[str, Column]) -> Column:
    host, base = repository_type(remote), base_url(remote)
    pages = []
    for name, pages_of in PAGES.items():
        template = pages_of[kind]
        pieces = [base]
        while template:
            text, brace, rest = template.partition("{")
            pieces += [F.lit(text)] if text else []
            if brace:
                field, _, template = rest.partition("}")
                pieces.append(parts[field])
            else:
                template = ""
        pages.append(F.when(host == name, reduce(lambda a, b: F.concat(a, b), pieces)))
    return F.coalesce(*pages)


def commit_url(remote: Column, commit: Column) -> Column:
    return _page(remote, "commit", {"id": commit})


def file_url(remote: Column, path: Column, commit: Column | None = None) -> Column:
    return _page(remote, "file", {"path": path, "ref": F.lit("main") if commit is None else F.coalesce(commit, F.lit("main"))})


def diff_url(remote: Column, commit: Column) -> Column:
    return _page(remote, "diff", {"id": commit})


def issue_url(remote: Column, issue: Column) -> Column:
    return _page(remote, "issue", {"id": issue})


def issue_references(message: Column) -> Column:
    """The issue numbers a message refers to, each once, in the order of the ways of referring."""
    text = F.coalesce(message, F.lit(""))
    return F.array_distinct(F.concat(*(F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in ISSUES)))
