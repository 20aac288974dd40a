import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm import repetition as R


def brute(words, run=8):
    seen, hit = set(), [False] * len(words)
    for i in range(len(words) - run + 1):
        g = tuple(words[i : i + run])
        if g in seen:
            hit[i : i + run] = [True] * run
        seen.add(g)
    return sum(hit)


@pytest.mark.parametrize("seed", range(12))
def test_words_equal_brute_force(seed):
    r = random.Random(seed)
    words = [f"w{r.randrange(1 + seed % 4)}" for _ in range(r.randrange(200))]
    base = [f"x{r.randrange(40)}" for _ in range(60)]
    words += base + base[10:40] + base
    assert R.shares(" ".join(words))[1] == pytest.approx(brute(words) / len(words))
    for run in (1, 2, 3, 5, 8, 13):
        assert R.repeated_words(words, run).sum() == brute(words, run)


def test_runs_of_one_number_are_told_apart(monkeypatch):
    monkeypatch.setattr(R, "MIX", np.zeros(64, np.uint64))  # all runs share their number
    r = random.Random(2)
    words = [r.choice("abc") for _ in range(150)]
    assert R.repeated_words(words, 5).sum() == brute(words, 5)


def test_words():
    assert R.words_of("A\u0301b \u00c4X\u00b2y _z9") == ["a", "b", "\u00e4x", "y", "z9"] and R.words_of("It's x_1") == ["it", "s", "x", "1"] and R.words_of(" ") == []


def test_shares_of_odd_texts():
    assert R.shares(None) == R.shares("") == R.shares("?! \n") == (0, 0.0, 0.0, 0.0)
    assert R.shares("one")[0] == 1 and R.shares("a_b-c")[0] == 3
    text = "The cache is cold.\n\nThe CACHE is cold!\n\nthe cache is warm."
    assert R.shares(text) == (12, 0.0, pytest.approx(4 / 12), pytest.approx(4 / 12))
    long = "eins zwei drei vier fünf sechs sieben acht. " * 20_000
    assert R.shares(long)[1:] == (pytest.approx(1 - 8 / 160_000),) * 2 + (0.0,)


def test_measure_keeps_every_row(spark):
    rows = [(1, None, "en", 5), (2, "", None, 5), (2, "", None, 5), (3, "a b c d e f g h a b c d e f g h", "de", 5)]
    got = R.measure(spark.createDataFrame(rows, "id bigint, text string, lang string, words int"), id="id", text="text", keep=["lang"]).collect()
    assert sorted((r.id, r.n_words, r.words) for r in got) == [(1, 0, 0.0), (2, 0, 0.0), (2, 0, 0.0), (3, 16, 0.5)]
    assert R.measure(spark.createDataFrame([], "id bigint, text string"), id="id", text="text").count() == 0


def test_binomial_bound_is_exact():
    for k, n, d in ((0, 100, 0.05), (3, 250, 0.01), (17, 40, 0.1)):
        p = R.binomial_upper(k, n, d)
        from math import comb

        assert sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)) == pytest.approx(d, rel=1e-6)
    assert R.binomial_upper(0, 100, 0.05) == pytest.approx(1 - 0.05 ** (1 / 100))
    assert R.binomial_upper(0, 0, 0.05) == R.binomial_upper(5, 5, 0.05) == 1.0


def test_cutoffs_limit_false_rejection(spark):
    r = random.Random(3)
    rows = []
    for i in range(6000):
        s = "small" if i % 50 == 0 else r.choice(["a", None])
        bad = r.random() < 0.2
        share = min(1.0, max(0.0, r.gauss(0.5 if bad else 0.05, 0.1)))
        rows.append((i, s, share, 0.0, share / 2, bad))
    df = spark.createDataFrame(rows, "id bigint, s string, words double, sentences double, paragraphs double, bad boolean")
    half, rest = df.where("id % 2 = 0"), df.where("id % 2 = 1")
    cut = R.choose_cutoffs(half, stratum=["s"], bad="bad", grid=(0.5, 0.4, 0.3, 0.2, 0.1), alpha=0.02, default={"words": 0.9})
    by = {(c.s, c.measure): c for c in cut.collect()}
    assert set(by) == {(s, m) for s in ("a", None, "small") for m in R.MEASURES}
    assert by["small", "words"].cutoff == 0.9 and not by["small", "words"].certified and by["small", "paragraphs"].cutoff is None
    assert by["a", "words"].certified and by[None, "words"].certified and by["a", "words"].bound <= 0.02
    got = R.reject(rest, cut, ["s"])
    assert got.count() == rest.count()
    good = got.where("NOT bad AND s = 'a'")
    assert good.where(F.array_contains("rejected_by", "words")).count() / good.count() <= 0.03
    assert got.where("bad AND s = 'a' AND size(rejected_by) > 0").count() > 100


def test_holdout_is_bounded(spark):
    df = spark.range(5000).withColumn("s", F.when(F.col("id") < 10, "few").otherwise("many")).withColumn("words", F.lit(0.3))
    n = {r.s: r["count"] for r in R.holdout(df, id="id", stratum=["s"], bad=F.col("words") > 0.2, per_stratum=500).groupBy("s").count().collect()}
    assert n["few"] == 10 and 400 < n["many"] < 600


def test_a_stratum_of_repetitive_documents_only(spark):
    rows = [(i, "spam", 0.9, 0.0, 0.0, True) for i in range(50)] + [(100 + i, "fine", 0.0, 0.0, 0.0, False) for i in range(50)]
    df = spark.createDataFrame(rows, "id bigint, s string, words double, sentences double, paragraphs double, bad boolean")
    cut = R.choose_cutoffs(df, stratum=["s"], bad="bad", grid=(0.5, 0.2), default={"words": 0.2})
    spam = {c.measure: c for c in cut.where("s = 'spam'").collect()}
    assert spam["words"].cutoff == 0.2 and spam["words"].n_good == 0 and not any(c.certified for c in spam.values()) and spam["sentences"].cutoff is None
    assert R.reject(df, cut, ["s"]).where("size(rejected_by) > 0").count() == 50
    assert R.reject(df, cut.where("s = 'fine'"), ["s"], {"words": 0.2}).where("size(rejected_by) > 0").count() == 50


@pytest.mark.parametrize("label", [0.2, 0.4])
def test_the_cutoff_decides_what_is_rejected(spark, label):
    r = random.Random(5)
    rows = [(i, "en" if i % 2 else None, r.random()) for i in range(6000)] + [(9000 + i, "spam", 0.9) for i in range(6)]
    df = spark.createDataFrame(rows, "id bigint, lang string, words double")
    cut = R.certify(df, id="id", stratum=["lang"], bad=F.col("words") >= label, grid=(0.6, 0.5, 0.4, 0.3, 0.2, 0.1), alpha=0.01, default={"words": 0.8}, per_stratum=4000, measures=("words",))
    assert {(c.lang, c.cutoff, c.certified) for c in cut.collect()} == {("en", label, True), (None, label, True), ("spam", 0.8, False)}
    got = {x.id for x in R.reject(df, cut, ["lang"]).where("size(rejected_by) > 0").collect()}
    assert got == {i for i, lang, w in rows if w >= (0.8 if lang == "spam" else label)}


def test_cutoffs_rest_on_all_rows(spark, tmp_path, monkeypatch):
    from factloom.llm import queries as Q

    n = 21_000  # 40 good ones between 0.25 and 0.3 are more than 0.1% of all
    rows = spark.range(n).select("id", F.lit("en").alias("lang"), F.when(F.col("id") < 40, 0.27).when(F.col("id") < 100, 0.6).otherwise(0.0).alias("words"))
    cut = R.certify(rows, id="id", stratum=["lang"], bad=F.col("words") >= 0.5, grid=(0.5, 0.3, 0.25), alpha=0.001, measures=("words",)).collect()
    assert [(c.n_good, c.cutoff, c.bound) for c in cut] == [(n - 60, 0.3, R.binomial_upper(0, n - 60, 0.05))]
    spark.range(n).select(F.col("id").alias("doc_id"), F.lit("de").alias("lang"), F.lit("eins zwei").alias("text")).write.parquet(f"{tmp_path}/documents.parquet")
    made, choose = [], R.choose_cutoffs
    monkeypatch.setattr(R, "choose_cutoffs", lambda *a, **k: made.append(choose(*a, **k)) or made[-1])
    assert Q.p8_found(spark, str(tmp_path)).count() == 0 and Q.p8_cutoffs(spark, str(tmp_path)).count() == 3
    assert [{r.n_good for r in c.collect()} for c in made] == [{n}, {n}]


def test_the_bound_of_many_rows():
    import time

    began = time.perf_counter()
    for k, n in ((4 * 10**6, 10**9), (10**6, 5 * 10**7), (0, 10**9)):
        above = R.binomial_upper(k, n, 0.01) - k / n
        sd = (k * (n - k) / n**3) ** 0.5
        assert above == pytest.approx(2.326 * sd, rel=0.01) if k else above == pytest.approx(4.605 / n, rel=0.01)
    assert time.perf_counter() - began < 20
