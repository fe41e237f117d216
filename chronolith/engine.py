"""The whole analysis as one call, and as a command line."""

from __future__ import annotations

import argparse
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolith import schema
from chronolith.functions import links
from chronolith.functions.paths import extension
from chronolith.operators import complexity as cx
from chronolith.operators import history as hs
from chronolith.operators import patterns as pt
from chronolith.operators import risk as rk
from chronolith.operators import views as vw
from chronolith.options import DEFAULT, Options
from chronolith.sinks.report import write_report
from chronolith.sources.files import read_tree
from chronolith.sources.git import read_git, remote_url
from chronolith.sources.manifests import dependency_analysis, dependency_counts, read_manifests


@dataclass
class Analysis:
    """Inputs of an analysis; everything derived from them is lazy."""

    commits: DataFrame
    file_changes: DataFrame
    source_files: DataFrame | None = None
    manifests: DataFrame | None = None
    remote: str | None = None
    options: Options = DEFAULT

    def __post_init__(self) -> None:
        self.commits = hs.newest_commits(self.commits, self.options)
        self.files = hs.capped_files(self.file_changes, self.options)
        self.history = hs.file_history(self.commits, self.files)
        self.authors = hs.author_stats(self.commits, self.files)
        self.findings = pt.findings(self.commits, self.files, self.options)
        self.metrics = cx.complexity(cx.analysed(self.source_files)) if self.source_files is not None else None

    def tables(self) -> dict[str, DataFrame]:
        """The tables of a report by section name."""
        spark = self.commits.sparkSession
        counts = vw.heat_counts(self.files)
        out = {
            "risk": rk.overall_risk(
                rk.git_risk(self.history, self.options),
                rk.code_risk(self.metrics) if self.metrics is not None else None,
                rk.vulnerability_risk(self.findings),
                self.options,
            ),
            "git": hs.repository_totals(self.commits, self.files, self.options).select(
                "*", links.repository_name(F.lit(self.remote).cast("string")).alias("host")
            ),
            "top_contributors": hs.top_contributors(self.authors),
            "priority_areas": vw.priority_areas(self.findings, self.history, self.remote),
            "vulnerabilities": vw.vulnerabilities(self.findings, self.remote).orderBy(F.desc("risk_score"), "commit_id"),
            "heatmap": vw.heat_rows(counts, self.history, hs.author_names(self.commits, self.files), self.remote).orderBy(
                F.desc("commit_count"), "path"
            ),
            "single_author_files": hs.single_author_files(self.history).select("path", F.col("any_author").alias("author")).orderBy("path").limit(20),
            "single_author_extensions": vw.extension_distribution(hs.single_author_files(self.history)).orderBy("place"),
            "stale_extensions": vw.extension_distribution(hs.stale_files(self.history, self.options)).orderBy("place"),
            "tests": spark.createDataFrame([(0, [], [], False, [])], schema.TEST_ANALYSIS),
        }
        if self.metrics is not None:
            out["stats"] = cx.language_stats(self.source_files).orderBy("language")
            out["totals"] = cx.language_totals(out["stats"])
            named = F.coalesce(extension(F.col("path")), F.lit("no-ext"))
            out["code_quality"] = self.metrics.withColumn("extension", named).orderBy(F.desc("cyclomatic_complexity"), "path")
            out["risk_factors"] = cx.risk_factors(self.metrics).orderBy("path", "factor_type")
        if self.manifests is not None:
            out["dependencies"] = dependency_analysis(dependency_counts(self.manifests))
        return out


def analyse_repository(spark: SparkSession, repo: str, output: str, options: Options = DEFAULT) -> str:
    """Read a git repository, analyse it and write a report; returns the report's path."""
    limits = {"max_commits": options.max_commits, "files_per_commit": options.files_per_commit}
    analysis = Analysis(
        read_git(spark, repo, "commits", **limits),
        read_git(spark, repo, "file_changes", **limits),
        read_tree(spark, repo) if options.include_stats else None,
        read_manifests(spark, repo) if options.include_stats else None,
        remote_url(read_git(spark, repo, "remotes")),
        options,
    )
    return write_report(analysis.tables(), output, options.output, options.cve_only, options.include_stats)


def arguments(given: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="chronolith", description="Security-oriented history analysis of a git repository")
    parser.add_argument("-r", "--repo", required=True)
    parser.add_argument("-p", "--patterns", default="vuln", help="vuln, all, memorysafety, crypto or web")
    parser.add_argument("-o", "--output", default="html", help="html or json")
    parser.add_argument("--output-file", default="report")
    parser.add_argument("-c", "--cve-only", action="store_true")
    parser.add_argument("-s", "--stats", action="store_true")
    parser.add_argument("--stale-days", type=int, default=365)
    parser.add_argument("-v", "--verbose", action="store_true")
    parser.add_argument("-t", "--threads", type=int, default=0)
    return parser.parse_args(given)


def main(given: list[str] | None = None) -> str:
    from datetime import UTC, datetime

    from chronolith.session import local_session

    a = arguments(given)
    options = Options(
        patterns=a.patterns, output=a.output, cve_only=a.cve_only, include_stats=a.stats, stale_days=a.stale_days,
        as_of=f"{datetime.now(UTC):%Y-%m-%d %H:%M:%S}",
    )
    spark = local_session(a.threads or "*")
    spark.sparkContext.setLogLevel("INFO" if a.verbose else "ERROR")
    return analyse_repository(spark, a.repo, a.output_file, options)


if __name__ == "__main__":
    print(main())
