"""Repetition inside a document, and cutoffs on it whose error is controlled.

Three shares are measured in each text: of words in repeated runs of 8 words, of words in repeated sentences, of words in repeated
paragraphs. A cutoff on a share rejects the documents at or above it. Cutoffs are chosen per stratum on labelled rows, all there are: the lowest
cutoff whose false-rejection rate is at most ``alpha``, by an exact binomial upper bound, with the error probability ``delta`` shared out over
all strata and measures (Bonferroni) and cutoffs tested in fixed order from the strictest down.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.plans.shipping import ship

ASCII_WORDS = re.compile(r"[A-Za-z0-9]+")
WORDS = regex.compile(r"[\p{L}\p{Nd}]+")
SENTENCE_END = regex.compile(r"[.!?\n]+\s*|$")
PARAGRAPH_END = regex.compile(r"\n\s*\n")
MEASURES = ("words", "sentences", "paragraphs")
#: A table of strata is broadcast up to this many counted rows.
SMALL_ROWS = 10_000


#: Odd factors that mix the numbers of a run of words into one; runs of one number are compared word by word.
MIX = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) | 1 for k in range(64)], np.uint64)


def repeated_words(words: list[str], run: int = 8) -> np.ndarray:
    """Which words lie in a run of ``run`` (64 at most) words that already started earlier."""
    n = len(words)
    out = np.zeros(n, bool)
    starts = n - run + 1
    if starts < 2:
        return out
    ids = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
    mixed = ids[:starts] * MIX[0]
    for k in range(1, run):
        mixed += ids[k : k + starts] * MIX[k]
    order = np.argsort(mixed, kind="stable")
    same = mixed[order[1:]] == mixed[order[:-1]]
    if not same.any():
        return out
    # of each number the first place, then word by word: a number may stand for several runs
    held: dict[int, list[int]] = {}
    again = np.zeros(starts, bool)
    alike = np.zeros(starts, bool)
    alike[order[1:][same]] = True
    alike[order[:-1][same]] = True
    for i in np.flatnonzero(alike).tolist():
        firsts = held.setdefault(int(mixed[i]), [])
        mine = words[i : i + run]
        if any(words[f : f + run] == mine for f in firsts):
            again[i] = True
        else:
            firsts.append(i)
    edges = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(again)
    edges[at] += 1
    edges[at + run] -= 1
    return np.cumsum(edges[:-1]) > 0


def _units(ends: list[int], words: list[str], starts: np.ndarray) -> int:
    """Words in units (sentences, paragraphs; given by their ends) that occurred before, by their words."""
    seen: set[tuple[str, ...]] = set()
    total = i = 0
    for j in np.searchsorted(starts, ends).tolist():
        if j > i:
            unit = tuple(words[i:j])
            if unit in seen:
                total += j - i
            seen.add(unit)
            i = j
    return total


def words_of(text: str) -> list[str]:
    """The longest runs of letters and digits, lower-cased."""
    found = ASCII_WORDS.findall(text) if text.isascii() else WORDS.findall(text)
    return "\0".join(found).lower().split("\0") if found else []  # no word has a zero character


def shares(text: str | None, run: int = 8, measures: tuple[str, ...] = MEASURES) -> tuple[int, float, float, float]:
    """Number of words, and the repeated share by runs of words, by sentences, by paragraphs; zero where there is no word, or none of ``measures``."""
    words = words_of(text) if text else []
    n = len(words)
    if n < 2:
        return n, 0.0, 0.0, 0.0
    repeated = int(repeated_words(words, run).sum()) if "words" in measures else 0
    if measures == ("words",):
        return n, repeated / n, 0.0, 0.0
    starts = np.fromiter((m.start() for m in WORDS.finditer(text)), np.int64, n)
    sentences = _units([m.end() for m in SENTENCE_END.finditer(text)], words, starts) if "sentences" in measures else 0
    paragraphs = _units([*(m.end() for m in PARAGRAPH_END.finditer(text)), len(text)], words, starts) if "paragraphs" in measures else 0
    return n, repeated / n, sentences / n, paragraphs / n


def measure(documents: DataFrame, *, id: str, text: str, keep: list[str] | None = None, run: int = 8, measures: tuple[str, ...] = MEASURES) -> DataFrame:
    """For every document: ``id``, the columns ``keep``, ``n_words``, and the shares ``measures`` of ``words``, ``sentences``, ``paragraphs``.

    Words are the longest runs of letters and digits, lower-cased. A word is repeated when it lies in a run of ``run`` words that already
    started earlier in the text; a sentence or paragraph is repeated when its words occurred as a whole before. Whole texts are
    read. Null and empty texts have no words and share 0; repeated rows give a row each; other columns are ignored. No shuffle.
    """
    keep = keep or []
    rows = documents.select(id, *keep, F.col(text).alias("__text"))
    schema = rows.drop("__text").schema
    for c, t in (("n_words", "long"), *((m, "double") for m in measures)):
        schema = schema.add(c, t)
    at = [0, *(1 + MEASURES.index(m) for m in measures)]

    def run_over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [shares(t.as_py(), run, measures) for t in b.column(b.num_columns - 1)]
            new = [pa.array([g[i] for g in got], pa.int64() if i == 0 else pa.float64()) for i in at]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *new], names=[*b.schema.names[:-1], "n_words", *measures])

    ship(documents.sparkSession)
    return rows.mapInArrow(run_over, schema)


def binomial_upper(errors: int, n: int, delta: float) -> float:
    """The exact (Clopper-Pearson) upper bound at confidence 1 - delta of a rate of which ``errors`` in ``n`` were seen."""
    if n <= 0 or errors >= n:
        return 1.0
    log = math.lgamma(n + 1) - math.lgamma(errors + 1) - math.lgamma(n - errors + 1)

    def at_most(p: float) -> float:
        # above the seen rate the chances fall from ``errors`` down, so the sum ends where they no longer count, after a number like the root of ``errors``
        term = total = math.exp(log + errors * math.log(p) + (n - errors) * math.log1p(-p))
        for k in range(errors, 0, -1):
            term *= k / (n - k + 1) * (1 - p) / p
            total += term
            if term <= total * 1e-18:
                break
        return total

    low, high = errors / n, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        if 0 < mid < 1 and at_most(mid) > delta:
            low = mid
        else:
            high = mid
    return high


def choose_cutoffs(
    labelled: DataFrame, *, stratum: list[str], bad: str, grid: tuple[float, ...], alpha: float = 0.02, delta: float = 0.05, default: dict[str, float] | None = None, tests: int | None = None,
    measures: tuple[str, ...] = MEASURES,
) -> DataFrame:
    """Per stratum and measure the lowest certified cutoff: ``stratum``, ``measure``, ``cutoff``, ``certified``, ``n_good``, ``bound``.

    labelled: rows with the shares of :func:`measure` and the BOOLEAN label ``bad``. A good row at or above a cutoff is a false
    rejection. Cutoffs of ``grid`` are tested from the highest down and testing stops at the first whose bound exceeds ``alpha``; a fixed
    order needs no correction within a stratum and measure, and over the ``tests`` = strata x measures of them ``delta`` is divided.
    Where even the highest isn't certified, ``cutoff`` is the measure's ``default`` (none: reject nothing) and ``certified`` is false.

    Only counts by stratum, measure and grid step leave the tasks. Null labels take no part; a null stratum is a stratum of its own.
    """
    steps = sorted(grid, reverse=True)
    counts = [F.count_if(F.col(m) >= g).alias(f"{m}_{i}") for m in measures for i, g in enumerate(steps)]
    # a stratum without a good row has its default cutoffs too
    rows_of = labelled.where(f"`{bad}` IS NOT NULL").withColumns({m: F.when(~F.col(bad), F.col(m)) for m in measures})
    good = rows_of.groupBy(*stratum).agg(F.sum((~F.col(bad)).cast("bigint")).alias("n"), *counts)
    rows = good.collect()  # one row per stratum
    share = delta / max(1, tests or len(rows) * len(measures))
    out = []
    for r in rows:
        for m in measures:
            best = ((default or {}).get(m), False, 1.0)
            for i, g in enumerate(steps):
                bound = binomial_upper(r[f"{m}_{i}"], r["n"], share)
                if bound > alpha:
                    break
                best = (float(g), True, bound)
            out.append((*(r[s] for s in stratum), m, *best[:2], r["n"], best[2]))
    schema = good.select(*stratum).schema.add("measure", "string").add("cutoff", "double").add("certified", "boolean").add("n_good", "long").add("bound", "double")
    return labelled.sparkSession.createDataFrame(out, schema)


def _null_safe(stratum: list[str], a: str, b: str) -> Column:
    """Equality of the stratum columns of two aliased frames."""
    same = F.lit(True)
    for s in stratum:
        same = same & F.col(f"{a}.{s}").eqNullSafe(F.col(f"{b}.{s}"))
    return same


def _small(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast a table whose counted rows are few; a larger one is joined as the planner sees fit."""
    return F.broadcast(df) if rows <= SMALL_ROWS else df


def holdout(measured: DataFrame, *, id: str, stratum: list[str], bad: Column, per_stratum: int | None = None, seed: int = 7) -> DataFrame:
    """The labelled rows: all of them, or of each stratum about ``per_stratum`` at most, drawn by a hash of the id, where labels cost too much."""
    if per_stratum is None:
        return measured.withColumn("bad", bad)
    counted = measured.groupBy(*stratum).agg(F.count(F.lit(1)).alias("__n"))
    rows = counted.collect()  # one row per stratum
    n = measured.sparkSession.createDataFrame(rows, counted.schema)
    u = F.pmod(F.xxhash64(F.lit(seed), F.col(f"m.{id}")), F.lit(1 << 30)) / float(1 << 30)
    return measured.alias("m").join(_small(n, len(rows)).alias("n"), _null_safe(stratum, "m", "n")).where(u * F.col("__n") < per_stratum).select("m.*").withColumn("bad", bad)


def certify(
    measured: DataFrame, *, id: str, stratum: list[str], bad: Column, grid: tuple[float, ...], alpha: float, delta: float = 0.05, default: dict[str, float] | None = None, per_stratum: int | None = None,
    measures: tuple[str, ...] = MEASURES,
) -> DataFrame:
    """The cutoffs of :func:`choose_cutoffs` on all rows, or a :func:`holdout` of ``per_stratum``, which ``bad`` labels."""
    labelled = holdout(measured, id=id, stratum=stratum, bad=bad, per_stratum=per_stratum)
    return choose_cutoffs(labelled, stratum=stratum, bad="bad", grid=grid, alpha=alpha, delta=delta, default=default, measures=measures)


def reject(measured: DataFrame, cutoffs: DataFrame, stratum: list[str], default: dict[str, float] | None = None) -> DataFrame:
    """``measured`` with ``rejected_by``: the measures whose cutoff the document reaches, empty where none.

    A stratum without a cutoff of its own takes the measures' ``default`` ones.
    """
    wide = cutoffs.groupBy(*stratum).agg(F.map_from_entries(F.collect_list(F.struct("measure", "cutoff"))).alias("__cut"))
    rows = wide.collect()  # one row per stratum
    wide = _small(measured.sparkSession.createDataFrame(rows, wide.schema), len(rows))
    held = [m for m in MEASURES if m in measured.columns]
    usual = {m: F.lit((default or {}).get(m)).cast("double") for m in held}
    hit = F.array(*(F.when(F.col(f"m.{m}") >= F.when(F.col("__cut").isNull(), usual[m]).otherwise(F.element_at("__cut", F.lit(m))), F.lit(m)) for m in held))
    return measured.alias("m").join(wide.alias("c"), _null_safe(stratum, "m", "c"), "left").select("m.*", F.array_compact(hit).alias("rejected_by"))
