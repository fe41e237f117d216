"""Queries of the problems on tokens: ids of all documents (8), the mixture of sources (9).

And of the texts that were cut off (10) and the files that nobody here wrote (2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolith.llm.mixing import available, capacity, mix, reached, wanted, water_fill
from chronolith.llm.provenance import foreign_files
from chronolith.llm.tokens import token_counts, token_ids
from chronolith.llm.truncation import score_endings
from chronolith.session import cut, spread
from chronolith.sources.tables import table


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    return token_ids(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id", "text")


#: the share of its capacity to which the capped mixture is filled: some sources are clamped there, others not
FILL = 0.6


def _mixed(spark: SparkSession, sf_dir: str, fill: float | None = None) -> DataFrame:
    sized = cut(token_counts(spread(table(spark, sf_dir, "documents").select("doc_id", "source", "text")), ["doc_id", "source"], "text"))
    return mix(sized, table(spark, sf_dir, "mix_targets"), "doc_id", "source", "n_tokens", fill)


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of the mixture, their tokens and how often each is used."""
    return _mixed(spark, sf_dir)


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares that the mixture reaches, by source."""
    return reached(_mixed(spark, sf_dir), table(spark, sf_dir, "mix_targets"), "source", "n_tokens")


def p9_capped_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares of a larger mixture, in which sources at their most repeats leave the rest to the others."""
    return reached(_mixed(spark, sf_dir, FILL), table(spark, sf_dir, "mix_targets"), "source", "n_tokens")


def p9_capped_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each source is to give to a mixture filled to ``FILL``, in code points; clamped sources give all they may."""
    targets = wanted(table(spark, sf_dir, "mix_targets"))
    sizes = available(table(spark, sf_dir, "documents"), targets, "source", "n_chars")
    given = water_fill(sizes, targets, FILL * capacity(sizes, targets))
    rows = [(t.source, sizes.get(t.source, 0) * t.max_repeats, round(given[t.source], 3), given[t.source] >= sizes.get(t.source, 0) * t.max_repeats) for t in targets]
    return spark.createDataFrame(rows, "source string, most long, given double, clamped boolean")


def p9_capped_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether every source of such a mixture really gives its size, to within its longest document."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    used = reached(mix(documents, table(spark, sf_dir, "mix_targets"), "doc_id", "source", "n_chars", FILL), table(spark, sf_dir, "mix_targets"), "source", "n_chars")
    longest = documents.groupBy("source").agg(F.max("n_chars").alias("longest"))
    rows = p9_capped_plan(spark, sf_dir).join(used.select("source", "size_used", "most_repeats", "max_repeats"), "source").join(longest, "source", "left")
    near = (F.col("given") - F.col("size_used")).between(F.lit(-0.01), F.coalesce("longest", F.lit(0)))
    return rows.select("source", F.col("clamped"), near.alias("met"), (F.col("most_repeats") <= F.col("max_repeats")).alias("within_repeats"))


def _endings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose text stops before the writer's end."""
    return score_endings(_endings(spark, sf_dir), "doc_id", "text", "lang").where("truncated").select("doc_id")


def p10_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each source truncates: all documents, those with a text, the truncated ones and their share."""
    documents = table(spark, sf_dir, "documents")
    judged = score_endings(_endings(spark, sf_dir), "doc_id", "text", "lang")
    rows = documents.select("doc_id", "source").join(judged.select("doc_id", "truncated"), "doc_id", "left")
    counts = rows.groupBy("source").agg(
        F.count(F.lit(1)).alias("documents"), F.count("truncated").alias("with_text"), F.count_if("truncated").alias("truncated")
    )
    return counts.withColumn("truncated_share", F.try_divide("truncated", "with_text"))


def p2_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why each source file with content is not hand-written here, what decided, and its metrics; null if it is."""
    judged = foreign_files(spread(table(spark, sf_dir, "source_files").select("path", "content")), "path", "content")
    metrics = table(spark, sf_dir, "file_complexity").groupBy("path").agg(
        F.max("line_count").alias("line_count"), F.max("function_count").alias("function_count")
    )
    return judged.join(metrics, "path", "left")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = foreign_files(spread(table(spark, sf_dir, "source_files").select("path", "content")), "path", "content")
    return judged.where("reason is not null").select("path").distinct()


def p2_planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many copies fingerprints find without any sign: every file is planted in three other projects, as it is and edited.

    An edited copy lacks every 25th line of the file, each copy other ones, and has a line of its own at the end. Per kind of copy: those
    planted, those of 1,000 characters and more, and of these the ones found.
    """
    files = spread(table(spark, sf_dir, "source_files").where("trim(content) <> ''").select("path", "content"))
    edited = F.expr("concat(array_join(filter(split(content, '\\n'), (x, i) -> i % 25 <> 8 * (k - 4)), '\n'), '\nlast_', cast(k as string), ' = 1\n')")
    copies = files.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(6)))).select(
        F.format_string("planted-%d/%s", "k", "path").alias("path"), F.when(F.col("k") > 3, edited).otherwise(F.col("content")).alias("content"), (F.col("k") > 3).alias("edited")
    )
    # as it is and edited are two tables of their own, so that one kind of copy does not lend repositories to the other
    out = None
    for kind in (False, True):
        some = copies.where(F.col("edited") == kind)
        judged = foreign_files(files.unionByName(some.select("path", "content")), "path", "content", signs=False)
        known = some.select("path", (F.length("content") >= 1000).alias("long")).join(judged.select("path", "reason"), "path")
        found = F.col("long") & F.col("reason").isNotNull()
        rows = known.agg(F.lit(kind).alias("edited"), F.count(F.lit(1)).alias("planted"), F.count_if("long").alias("long"), F.count_if(found).alias("found"))
        out = rows if out is None else out.unionByName(rows)
    return out


QUERIES = {
    "p2_found": p2_found, "p2_planted": p2_planted,
    "p2_files": p2_files,
    "p8_ids": p8_ids, "p9_mix": p9_mix, "p9_shares": p9_shares,
    "p9_capped_shares": p9_capped_shares, "p9_capped_plan": p9_capped_plan, "p9_capped_sizes": p9_capped_sizes, "p10_found": p10_found, "p10_by_source": p10_by_source,
}
_FILLED = f"""
with recursive a as (select source, sum(n_chars) as n from documents where n_chars > 0 group by source),
t as (select source, target_share, cast(coalesce(n, 0) * max_repeats as bigint) as most from mix_targets left join a using (source)),
w as (select 0 as step, source, target_share, most, {FILL} * sum(most) over () as total, cast(case when most = 0 then 0 end as double) as given from t
  union all
  select step + 1, source, target_share, most, total, case when given is not null then given when (total - coalesce(sum(given) over (), 0)) * target_share
    / sum(case when given is null then target_share end) over () >= most then most end from w where step < 20),
g as (select source, most, coalesce(given, (total - coalesce(sum(given) over (), 0)) * target_share / sum(case when given is null then target_share end) over ()) as given
  from w where step = 20)
"""
ORACLES = {
    "p9_capped_plan": _FILLED + "select source, most, round(given, 3) as given, given >= most as clamped from g",
    "p9_capped_sizes": _FILLED + "select source, given >= most as clamped, true as met, true as within_repeats from g",
}
