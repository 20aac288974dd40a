"""Figures over results: medians, rates, and ranking of plain text by term weights as a baseline for retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def medians(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Per group the number of values, their exact median (the mean of the middle two of an even number) and the largest; nulls take no part."""
    return rows.where(F.col(value).isNotNull()).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.median(value).alias("median"), F.max(value).alias("most"))


def rates(rows: DataFrame, by: list[str], flag: str) -> DataFrame:
    """Per group how many rows there are, for how many the flag is true, and their share; a null flag isn't true."""
    hits = F.count_if(F.col(flag))
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), hits.alias("hits"), F.round(hits / F.count(F.lit(1)), 9).alias("rate"))


def majority(votes: DataFrame, by: list[str], value: str) -> DataFrame:
    """Per group the value most often given (of equals the least), and the share of votes that differ from it, ``flip_rate``. Null votes take no part."""
    n = votes.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("__n"))
    best = n.groupBy(*by).agg(F.max_by(value, F.struct("__n")).alias("__any"), F.max("__n").alias("__most"), F.sum("__n").alias("votes"))
    first = n.join(best.select(*by, F.col("__most").alias("__n")), [*by, "__n"], "left_semi").groupBy(*by).agg(F.min(value).alias(value))
    return best.join(first, by).select(*by, value, "votes", F.round(1 - F.col("__most") / F.col("votes"), 9).alias("flip_rate"))


def tf_idf(texts: DataFrame, terms: list[str], *, id: str, text: str) -> DataFrame:
    """Texts by the weight of query terms in them: ``id``, ``score``, those with a score above 0.

    The weight of a term is its share of the text's words times ln(1 + texts / texts that have it). Words are runs of letters and digits, lower-cased.
    Only the query's words are counted out of each text; the only shuffle is the counts of texts by term, a row per term.
    """
    asked = list(dict.fromkeys(t.lower() for t in terms))
    words = F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(r"[\p{L}\p{Nd}]+"), F.lit(0))
    counted = texts.select(F.col(id), words.alias("__w")).select(id, F.size("__w").alias("__n"), F.explode(F.filter("__w", lambda w: w.isin(*asked)) if asked else F.array().cast("array<string>")).alias("term"))
    tf = counted.groupBy(id, "__n", "term").agg(F.count(F.lit(1)).alias("__tf"))
    every = texts.select(F.count(F.lit(1)).alias("__all"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("__df")).join(F.broadcast(every))  # one row, joined to a row per term
    return tf.join(F.broadcast(df), "term").groupBy(id).agg(F.round(F.sum(F.col("__tf") / F.col("__n") * F.log(1 + F.col("__all") / F.col("__df"))), 9).alias("score"))
