"""Auditing a pile of claims against the code and itself: every claim goes through the decisions, and what happens to it is a finding."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import decide, reports, resolve
from factloom.plans.layout import cut, global_rank
from factloom.sources import ingest


@dataclass(slots=True)
class Audit:
    """What an audit of a pile found: findings with receipts, the scorecard, clusters of names, claims stated again, and the pile's size against a reader's window."""

    findings: DataFrame
    scorecard: DataFrame
    clusters: DataFrame
    restatements: DataFrame
    injection: DataFrame


def pile(spark: SparkSession, folders: list[tuple[str, str]]) -> DataFrame:
    """The files of several (folder, name pattern), each path once: ``path``, ``content``."""
    read = None
    for folder, glob in folders:
        one = ingest.text_files(spark, folder, glob)
        read = one if read is None else read.unionByName(one)
    return spark.createDataFrame([], "path string, content string") if read is None else read.dropDuplicates(["path"])


def name_clusters(claims: DataFrame) -> DataFrame:
    """The spellings of one normalised name among the subjects and entity objects of claims, where there are several: ``normalized``, ``names``."""
    named = claims.select(F.explode(F.array("subject", F.when(F.col("object_kind") == "entity", F.col("object")))).alias("name")).where("name IS NOT NULL")
    by = named.groupBy(resolve.norm_name(F.col("name")).alias("normalized")).agg(F.sort_array(F.collect_set("name")).alias("names"))
    return by.where("size(names) > 1")


def receipts(findings: DataFrame, claims: DataFrame) -> DataFrame:
    """Findings (``seq``, ``other_seq``) with where both sides are stated: file, place and quote, and ``other_…`` of the other; nulls where that is code."""
    at = lambda s, p: claims.select(F.col("seq").alias(s), *(F.col(c).alias(f"{p}{c}") for c in ("file", "place", "quote")))
    return findings.drop("file").join(at("seq", ""), "seq", "left").join(at("other_seq", "other_"), "other_seq", "left")


def audit_pile(files: DataFrame, code: DataFrame, extract: Callable[[DataFrame], DataFrame], registry: DataFrame, now: Column, judge: Callable[[DataFrame], DataFrame] | None = None) -> Audit:
    """Audit files (path, content): have their claims extracted by a function of (id, text) that gives replies (id, text), decide them against the code, and report.

    A finding tells file, place and quote of both its sides. A judge, a function of findings that adds ``relation``, may withdraw a contradiction or
    disagreement: those it calls ``compatible`` are left out.
    """
    said = ingest.json_lines(extract(files.select(F.col("path").alias("id"), F.col("content").alias("text"))), id="id", text="text")
    ready = ingest.prepare_candidates(said, kind="audit").where("accepted")
    claims = ready.select(F.col("id").alias("file"), "place", "subject", "predicate", "object", "object_kind", "epistemic", "confidence", "source_type", F.concat_ws(" ", "subject", "predicate", "object").alias("quote"))
    claims = cut(claims)
    findings, scorecard, told = _decided(code, claims, registry, now)
    full = receipts(findings, told)
    if judge is not None:
        judged = judge(full.where("kind IN ('contradiction', 'disagreement')"))
        full = full.join(judged.where("relation = 'compatible'").select("seq"), "seq", "left_anti")
    key = F.concat_ws("|", *(resolve.norm_name(F.col(c)) if c != "predicate" else F.col(c) for c in ("subject", "predicate", "object")))
    facts = code.select(key.alias("fact_id")).dropDuplicates().withColumn("code", F.lit(True))
    stated = claims.select(key.alias("fact_id"), "file").join(facts, "fact_id", "left").withColumn("code", F.coalesce("code", F.lit(False)))
    return Audit(cut(full), scorecard, name_clusters(claims), reports.restatements(stated), reports.injection_report(files.select("path", F.col("content").alias("text"))))


def audit(code: DataFrame, claims: DataFrame, registry: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(findings, scorecard). code: subject, predicate, object, object_kind …; claims: the same with ``file``; both like assertions but without seq.

    Code facts are asserted first, then the claims in order of file and place (``place``). A flagged claim is a contradiction, or stale where the other side
    is code; a superseding one a disagreement; a repeated one a restatement. Findings: file, kind, fact_id, other_id, subject, predicate, object.
    """
    findings, scorecard, _ = _decided(code, claims, registry, now)
    return findings.drop("seq", "other_seq"), scorecard


def _decided(code: DataFrame, claims: DataFrame, registry: DataFrame, now: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Findings with ``seq`` and ``other_seq``, the scorecard, and all that was decided, numbered."""
    mine = claims.withColumns({"file": F.coalesce("file", F.lit("")), "code": F.lit(False)})
    # code facts once each, in front of the claims, which follow file and place; numbers are exact, so no two rows share one
    facts = code.dropDuplicates(["subject", "predicate", "object", "object_kind"])
    both = facts.withColumns({"file": F.lit(None).cast("string"), "place": F.lit(None).cast("bigint"), "code": F.lit(True), "source_type": F.lit("code")}).unionByName(mine, allowMissingColumns=True)
    both = cut(global_rank(both, F.desc("code"), "file", "place", "subject", "predicate", "object").withColumnRenamed("rank", "seq"))
    done = cut(decide.assert_batch(both, registry, now))
    told = both.select("seq", "file", "code", "subject", "predicate", "object")
    of_code = told.where("code").select(F.concat(F.lit("f-"), "seq").alias("other_id"), F.lit(True).alias("other_is_code"))
    other = F.when(F.col("status") == "reinforce", F.col("fact_id")).otherwise(F.element_at(F.nullif("targets", F.array().cast("array<string>")), 1))
    seen = done.join(told, "seq").where("NOT code").withColumn("other_id", other).join(of_code, "other_id", "left").withColumn("code_side", F.coalesce("other_is_code", F.lit(False)))
    kind = F.when((F.col("status") == "flag") & F.col("code_side"), "stale").when(F.col("status") == "flag", "contradiction").when(F.col("status") == "supersede", "disagreement").when(F.col("status") == "reinforce", "restatement").when(F.col("status") == "error", "rejected")
    number = F.regexp_extract("other_id", "^f-([0-9]+)$", 1)
    findings = seen.where("status <> 'insert'").select("file", kind.alias("kind"), "fact_id", "other_id", "subject", "predicate", "object", "seq", F.nullif(number, F.lit("")).cast("bigint").alias("other_seq"))
    quoted = both if "quote" in both.columns else both.withColumn("quote", F.lit(None).cast("string"))
    return findings, reports.scorecard(seen), quoted.where("NOT code")
