"""Queries of the subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import format_duplicates, mixing, name_variants, packing, repetition
from factloom.llm.token_sizes import token_sizes
from factloom.plans.layout import cut
from factloom.sources.tables import table

ASSERTION = ["subject", "predicate", "object"]


def _literals(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "assertions").where("object_kind = 'literal'").dropna(subset=["subject", "object"])


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Literal assertions that are copies of an earlier one but for formatting."""
    groups = format_duplicates.format_groups(_literals(spark, folder), id="seq", fields=ASSERTION, listed=["object"])
    return groups.where("first <> id").select(F.col("first").alias("first_seq"), F.col("id").alias("seq"))


def p2_records(spark: SparkSession, folder: str) -> DataFrame:
    """Literal assertions without formatting copies, with the number of copies each had."""
    return format_duplicates.collapse(_literals(spark, folder), id="seq", fields=ASSERTION, listed=["object"])


_P2_CTE = r"""
WITH l AS (SELECT seq, subject, predicate, object, lower(subject) AS s, lower(predicate) AS p, lower(object) AS o FROM assertions
           WHERE object_kind = 'literal' AND subject IS NOT NULL AND object IS NOT NULL),
 d AS (SELECT seq, subject, predicate, object,
   regexp_replace(regexp_replace(s, '([0-9])\.([0-9])', '\1' || chr(1) || '\2', 'g'), '([0-9])\.([0-9])', '\1' || chr(1) || '\2', 'g') AS s,
   regexp_replace(regexp_replace(p, '([0-9])\.([0-9])', '\1' || chr(1) || '\2', 'g'), '([0-9])\.([0-9])', '\1' || chr(1) || '\2', 'g') AS p,
   regexp_replace(regexp_replace(o, '([0-9])\.([0-9])', '\1' || chr(1) || '\2', 'g'), '([0-9])\.([0-9])', '\1' || chr(1) || '\2', 'g') AS o FROM l),
 n AS (SELECT seq, subject, predicate, object, regexp_replace(s, '[^\p{L}\p{Nd}\x01]', '', 'g') AS s, regexp_replace(p, '[^\p{L}\p{Nd}\x01]', '', 'g') AS p,
   CASE WHEN regexp_full_match(o, '[^\p{L}\p{Nd}\x01:=]*[\p{L}\p{Nd}\x01]+[^\p{L}\p{Nd}\x01:=]*[:=][^\p{L}\p{Nd}\x01]*[\p{L}\p{Nd}\x01]+(?:[^\p{L}\p{Nd}\x01:=]+[\p{L}\p{Nd}\x01]+[^\p{L}\p{Nd}\x01:=]*[:=][^\p{L}\p{Nd}\x01]*[\p{L}\p{Nd}\x01]+)+[^\p{L}\p{Nd}\x01:=]*')
     THEN array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(o, '[\p{L}\p{Nd}\x01]+[^\p{L}\p{Nd}\x01:=]*[:=][^\p{L}\p{Nd}\x01]*[\p{L}\p{Nd}\x01]+'),
       lambda x: regexp_replace(x, '[^\p{L}\p{Nd}\x01]+', '=', 'g')))), ';')
     ELSE regexp_replace(o, '[^\p{L}\p{Nd}\x01]', '', 'g') END AS o FROM d),
 g AS (SELECT *, min(seq) OVER (PARTITION BY s, p, o) AS first FROM n)
"""


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of rows that name the same person or organisation."""
    return name_variants.linked_pairs(cut(name_variants.link_names(table(spark, folder, "entities"), table(spark, folder, "name_forms"))))


def p3_clusters(spark: SparkSession, folder: str) -> DataFrame:
    """Every row of a person or organisation with its cluster."""
    return name_variants.link_names(table(spark, folder, "entities"), table(spark, folder, "name_forms")).select("id", F.col("cluster").alias("cluster_id"))


def p3_recall(spark: SparkSession, folder: str) -> DataFrame:
    """What share of the spellings of a sample of key words, found by comparing with all, shares a bucket, by length."""
    return name_variants.candidate_recall(cut(name_variants.key_words(table(spark, folder, "entities"), table(spark, folder, "name_forms"))))


def _packs(spark: SparkSession, folder: str) -> DataFrame:
    sizes = token_sizes(table(spark, folder, "documents"), id="doc_id", text="text")
    return packing.pack(sizes, table(spark, folder, "pack_sizes"), id="doc_id", size="n_tokens", pack_id="pack_id", capacity="capacity_tokens")


def p6_packs(spark: SparkSession, folder: str) -> DataFrame:
    """The pack of every document, for every capacity."""
    return _packs(spark, folder)


def p6_fill(spark: SparkSession, folder: str) -> DataFrame:
    """How full the packs of each capacity are."""
    return packing.fill_report(_packs(spark, folder), table(spark, folder, "pack_sizes"), pack_id="pack_id", capacity="capacity_tokens")


def p6_kept(spark: SparkSession, folder: str) -> DataFrame:
    """What every packing keeps: all documents placed, no pack over its capacity, none cut that fits into one."""
    packed = _packs(spark, folder).join(F.broadcast(table(spark, folder, "pack_sizes")), "pack_id")
    bins = packed.groupBy("pack_id", "bin_id", "capacity_tokens").agg(F.sum("part_size").alias("n"))
    over = bins.groupBy("pack_id").agg(F.count_if(F.col("bin_id").isNotNull() & (F.col("n") > F.col("capacity_tokens"))).alias("over_capacity"))
    docs = packed.groupBy("pack_id", "doc_id", "capacity_tokens").agg(F.sum("part_size").alias("n"), F.count(F.lit(1)).alias("parts"))
    least = F.greatest(F.lit(1), F.ceil(F.col("n") / F.col("capacity_tokens")))
    kept = docs.groupBy("pack_id").agg(F.count(F.lit(1)).alias("documents"), F.count_if(F.col("parts") > least).alias("needless_cuts"))
    return kept.join(over, "pack_id").select("pack_id", "documents", "over_capacity", "needless_cuts")


def _uses(spark: SparkSession, folder: str, total: int | str) -> DataFrame:
    sizes = token_sizes(table(spark, folder, "documents"), id="doc_id", text="text", keep=["source", "lang", "kind"])
    return mixing.mix(
        sizes, table(spark, folder, "mix_targets"), id="doc_id", source="source", lang="lang", domain="kind", size="n_tokens", mix_id="mix_id", share="target_share",
        max_repeats="max_repeats", total_tokens=total,
    )


#: A mix is to be as large as its sources together: scarce ones run short and are repeated as often as they may be.
TOTAL = "all"


def p7_uses(spark: SparkSession, folder: str) -> DataFrame:
    """How often each mix uses each document."""
    return _uses(spark, folder, TOTAL)


def _shares(spark: SparkSession, folder: str, total: int | str) -> DataFrame:
    return mixing.shares(_uses(spark, folder, total), table(spark, folder, "mix_targets"), source="source", size="n_tokens", mix_id="mix_id", share="target_share")


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    """The share each source reaches in each mix, and what of it stays unused."""
    return _shares(spark, folder, TOTAL)


def p7_shares_met(spark: SparkSession, folder: str) -> DataFrame:
    """The same for mixes only so large that every source that has documents meets its share."""
    return _shares(spark, folder, "met")


def p7_kept(spark: SparkSession, folder: str) -> DataFrame:
    """What every mix keeps: its sources' documents once each, none used more often than its source allows."""
    goal = table(spark, folder, "mix_targets").select("mix_id", "source", "max_repeats")
    used = _uses(spark, folder, TOTAL).join(F.broadcast(goal), ["mix_id", "source"])
    return used.groupBy("mix_id").agg(F.count_distinct("doc_id").alias("documents"), F.count(F.lit(1)).alias("rows"), F.count_if(F.col("uses") > F.col("max_repeats")).alias("over_repeats"))


#: The label of a document: repetitive when at least this share of its words is repeated.
REPETITIVE = 0.2
#: Where nothing is certified.
DEFAULT = {"words": REPETITIVE}
STRATUM = ["lang"]
#: Cutoffs on both sides of the label's, and the false rejection that is allowed: of 10,000 good documents, with 5% risk over all languages.
FINE_GRID = (0.5, 0.4, 0.35, 0.3, 0.27, 0.25, 0.24, 0.23, 0.22, 0.21, 0.2, 0.19, 0.18, 0.17, 0.16, 0.15, 0.13, 0.1)
FINE_ALPHA = 0.0005
GRID = (0.2, 0.15, 0.1, 0.05, 0.02)
ALPHA = 0.02


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that the certified cutoff of their language on repeated words rejects."""
    measured = cut(repetition.measure(table(spark, folder, "documents"), id="doc_id", text="text", keep=["lang"], measures=("words",)))
    cutoffs = repetition.certify(
        measured, id="doc_id", stratum=STRATUM, bad=F.col("words") >= REPETITIVE, grid=FINE_GRID, alpha=FINE_ALPHA, default=DEFAULT, measures=("words",)
    )
    return repetition.reject(measured, cutoffs, STRATUM, DEFAULT).where("size(rejected_by) > 0").select("doc_id")


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    """The repeated share of every document."""
    measured = repetition.measure(table(spark, folder, "documents"), id="doc_id", text="text", measures=("words",))
    return measured.select("doc_id", "n_words", F.round("words", 9).alias("repeated_share"))


def p8_cutoffs(spark: SparkSession, folder: str) -> DataFrame:
    """The certified cutoffs per language on repeated words, sentences and paragraphs."""
    measured = cut(repetition.measure(table(spark, folder, "documents"), id="doc_id", text="text", keep=["lang"]))
    cutoffs = repetition.certify(measured, id="doc_id", stratum=STRATUM, bad=F.col("words") >= REPETITIVE, grid=GRID, alpha=ALPHA, default=DEFAULT)
    return cutoffs.select("lang", "measure", "cutoff", "certified", "n_good")


_P8_CTE = r"""
WITH w AS (SELECT doc_id, unnest(l) AS w, generate_subscripts(l, 1) AS i
     FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{Nd}]+') AS l FROM documents WHERE text IS NOT NULL)),
 g AS (SELECT doc_id, i, lead(i, 7) OVER (PARTITION BY doc_id ORDER BY i) AS j,
     list(w) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS gram FROM w),
 a AS (SELECT doc_id, i, j IS NOT NULL AND row_number() OVER (PARTITION BY doc_id, gram ORDER BY i) > 1 AS again FROM g),
 r AS (SELECT doc_id, max(again::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS rep FROM a),
 s AS (SELECT doc_id, count(*) AS n_words, avg(rep) AS share FROM r GROUP BY doc_id)
"""

#: The shares of units whose words occurred before in the text, and the cutoffs certified on all rows of a language (the holdout where it is that small).
_P8_CUTOFFS = (
    _P8_CTE.rstrip()
    + r""",
 u AS (SELECT doc_id, 'sentences' AS measure, unnest(x) AS unit, generate_subscripts(x, 1) AS i FROM (SELECT doc_id, regexp_split_to_array(lower(text), '[.!?\n]+') AS x FROM documents WHERE text IS NOT NULL)
   UNION ALL SELECT doc_id, 'paragraphs', unnest(x), generate_subscripts(x, 1) FROM (SELECT doc_id, regexp_split_to_array(lower(text), '\n\s*\n') AS x FROM documents WHERE text IS NOT NULL)),
 uw AS (SELECT doc_id, measure, i, array_to_string(regexp_extract_all(unit, '[\p{L}\p{Nd}]+'), ' ') AS k, len(regexp_extract_all(unit, '[\p{L}\p{Nd}]+')) AS n FROM u),
 us AS (SELECT doc_id, measure, sum(CASE WHEN nth > 1 THEN n ELSE 0 END) / sum(n) AS share FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, measure, k ORDER BY i) AS nth FROM uw WHERE n > 0) GROUP BY 1, 2),
 m AS (SELECT d.doc_id, d.lang, coalesce(s.share, 0) >= 0.2 AS bad, k.measure, coalesce(CASE WHEN k.measure = 'words' THEN s.share ELSE us.share END, 0) AS share
   FROM documents d CROSS JOIN (VALUES ('words'), ('sentences'), ('paragraphs')) k(measure) LEFT JOIN s ON s.doc_id = d.doc_id LEFT JOIN us ON us.doc_id = d.doc_id AND us.measure = k.measure),
 c AS (SELECT lang, measure, g, count(*) FILTER (NOT bad) AS n, count(*) FILTER (NOT bad AND share >= g) AS k FROM m CROSS JOIN (VALUES (0.2::DOUBLE), (0.15), (0.1), (0.05), (0.02)) x(g) GROUP BY 1, 2, 3),
 p AS (SELECT *, (SELECT count(*) FROM (SELECT DISTINCT lang FROM documents)) * 3 AS tests FROM c),
 b AS (SELECT *, n > 0 AND k < n AND list_sum(list_transform(range(0, k + 1), lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln(0.02) + (n - j) * ln(0.98)))) <= 0.05 / tests AS ok FROM p),
 r2 AS (SELECT *, bool_and(ok) OVER (PARTITION BY lang, measure ORDER BY g DESC) AS chain FROM b)
SELECT lang, measure, coalesce(min(g) FILTER (chain), CASE WHEN measure = 'words' THEN 0.2::DOUBLE END) AS cutoff, bool_or(chain) AS certified, max(n) AS n_good FROM r2 GROUP BY 1, 2"""
)

QUERIES = {
    "p2_found": p2_found, "p2_records": p2_records, "p3_found": p3_found, "p3_clusters": p3_clusters, "p3_recall": p3_recall,
    "p6_packs": p6_packs, "p6_fill": p6_fill, "p6_kept": p6_kept, "p7_uses": p7_uses, "p7_shares": p7_shares, "p7_shares_met": p7_shares_met, "p7_kept": p7_kept,
    "p8_found": p8_found, "p8_shares": p8_shares, "p8_cutoffs": p8_cutoffs,
}
SQL = {
    "p2_found": _P2_CTE + "SELECT first AS first_seq, seq FROM g WHERE first <> seq",
    "p2_records": _P2_CTE + "SELECT first AS seq, arg_min(subject, seq) AS subject, arg_min(predicate, seq) AS predicate, arg_min(object, seq) AS object, count(*) AS n_copies FROM g GROUP BY first",
    "p6_kept": "SELECT pack_id, (SELECT count(*) FROM documents) AS documents, 0 AS over_capacity, 0 AS needless_cuts FROM pack_sizes",
    "p7_kept": """SELECT mix_id, count(*) AS documents, count(*) AS rows, 0 AS over_repeats FROM mix_targets t JOIN documents d USING (source)
WHERE regexp_matches(d.text, '.') OR contains(d.text, chr(10)) GROUP BY mix_id""",
    "p8_cutoffs": _P8_CUTOFFS,
    "p8_found": _P8_CTE + "SELECT doc_id FROM s WHERE share >= 0.2",
    "p8_shares": _P8_CTE + "SELECT d.doc_id, coalesce(n_words, 0) AS n_words, round(coalesce(share, 0), 9) AS repeated_share FROM documents d LEFT JOIN s USING (doc_id)",
}
