"""Column expressions of the fact model. All stay in the JVM, and instants are always passed in, never read from a clock."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.functions import constants as K


def at(instant: str) -> Column:
    """A literal instant, UTC."""
    return F.lit(instant).cast("timestamp")


def norm_name(name: Column) -> Column:
    """Lower case without white space, hyphens, underscores, points and slashes."""
    return F.regexp_replace(F.lower(name), r"[\s\-_./]+", "")


def keyword(text: Column) -> Column:
    """Trimmed, without a leading colon; empty becomes null."""
    return F.nullif(F.regexp_replace(F.trim(text), "^:", ""), F.lit(""))


def parse_instant(text: Column) -> Column:
    """An ISO instant, or a date as midnight UTC; blank is null and anything else an error."""
    got = F.coalesce(F.try_to_timestamp(text), F.try_to_timestamp(text, F.lit("yyyy-MM-dd")))
    blank = text.isNull() | (F.trim(text) == "")
    return F.when(blank, F.lit(None).cast("timestamp")).when(got.isNull(), F.raise_error(F.concat(F.lit("invalid-instant: "), text)).cast("timestamp")).otherwise(got)


def valid_at(now: Column, t_valid: str = "t_valid", t_invalid: str = "t_invalid") -> Column:
    """Half-open validity [t_valid, t_invalid); a null end is open, a null start never valid."""
    return F.coalesce((F.col(t_valid) <= now) & (F.col(t_invalid).isNull() | (F.col(t_invalid) > now)), F.lit(False))


def interval_ok(t_valid: Column, t_invalid: Column) -> Column:
    """Open, or of positive length."""
    return t_invalid.isNull() | t_valid.isNull() | (t_valid < t_invalid)


def _lookup(key: Column, table: dict, other) -> Column:
    pairs = [F.lit(x) for pair in table.items() for x in pair]
    return F.coalesce(F.create_map(*pairs)[F.coalesce(key, F.lit(""))], F.lit(other))


def trust(source_type: Column) -> Column:
    return _lookup(source_type, K.TRUST, K.TRUST_UNKNOWN)


def ceiling(source_type: Column) -> Column:
    return _lookup(source_type, K.CEILING, K.CEILING_UNKNOWN)


def effective_confidence(now: Column, half_life_days: float = K.HALF_LIFE_DAYS, floor: float = K.CONFIDENCE_FLOOR) -> Column:
    """Confidence halved for every half-life since the fact was last recorded or reinforced, not below the floor.

    Commitments, decision records and facts that were never recorded don't decay, and nothing does before its anchor.
    """
    anchor = F.greatest("recorded_at", "last_reinforced_at")
    periods = F.greatest(F.lit(0.0), (F.unix_micros(now) - F.unix_micros(anchor)) / F.lit(86_400e6 * half_life_days))
    exempt = (F.col("epistemic") == "commitment") | (F.col("source_type") == "decision-record") | F.col("recorded_at").isNull()
    return F.when(F.coalesce(exempt, F.lit(False)), F.col("confidence")).otherwise(F.greatest(F.lit(floor), F.col("confidence") * F.pow(F.lit(0.5), periods)))


def conflict_policy(new_epistemic: Column, any_commitment: Column, override: Column) -> Column:
    """An explicit override, else ``flag`` where a side is a commitment, else ``supersede``."""
    return F.coalesce(override, F.when((new_epistemic == "commitment") | any_commitment, F.lit("flag")).otherwise(F.lit("supersede")))


def query_tokens(text: Column) -> Column:
    """Distinct words of a query: split at white space, edges trimmed to letters and digits, short words and stopwords left out."""
    words = F.transform(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: F.regexp_replace(w, r"^[^\p{Alnum}]+|[^\p{Alnum}]+$", ""))
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= K.MIN_TOKEN) & ~F.lower(w).isin(*K.STOPWORDS)))


def walk_score(text: Column, tokens: Column, effective: Column) -> Column:
    """(1 + query tokens that the lower-cased text contains) times the effective confidence."""
    return (F.size(F.filter(tokens, lambda t: F.contains(F.lower(text), t))) + 1) * effective


def content_hash(text: Column) -> Column:
    """SHA-256 of the UTF-8 text, in hex."""
    return F.sha2(text.cast("binary"), 256)


def episode_ref(harness: Column, path: Column, digest: Column) -> Column:
    return F.concat(harness, F.lit(":"), path, F.lit("@"), digest)


def munge_path(path: Column) -> Column:
    return F.regexp_replace(path, "[^A-Za-z0-9]", "-")


def strip_section(text: Column, begin: str, end: str) -> Column:
    """A text without its managed section; a section that isn't closed runs to the end."""
    quote = lambda s: rf"\Q{s}\E"
    return F.regexp_replace(text, f"(?s){quote(begin)}.*?({quote(end)}|\\z)", "")


def admission(subject: Column, object_: Column, confidence: Column, epistemic: Column, predicate_known: Column, subject_known: Column) -> tuple[Column, Column]:
    """Whether a candidate is admitted, and its score: shape and floor decide, what is known about it scales the score."""
    length = lambda c: F.length(F.coalesce(c, F.lit("")))
    admit = (F.coalesce(confidence, F.lit(0.5)) >= K.ADMIT_FLOOR) & (length(subject) <= K.ADMIT_SUBJECT) & (length(object_) <= K.ADMIT_LITERAL)
    weight = _lookup(epistemic, K.CLASS_WEIGHT, K.CLASS_WEIGHT_OTHER)
    score = weight * (F.lit(0.6) + F.when(predicate_known, 0.25).otherwise(0.0) + F.when(subject_known, 0.15).otherwise(0.0))
    return admit, F.when(admit, score).otherwise(0.0)


def complete_json(text: Column) -> Column:
    """Whether a text is one JSON value and nothing else; false for null. Parsers stop at the end of a value, so it is read as an array's only element."""
    inside = F.concat(F.lit("["), text, F.lit("]"))
    return F.coalesce(F.json_array_length(inside) == 1, F.lit(False)) & F.try_parse_json(inside).isNotNull()


def one_line(text: Column) -> Column:
    return F.regexp_replace(text, r"\s*\n\s*", " ")


def short_name(id_: Column) -> Column:
    """The part of a namespaced id behind the slash."""
    return F.element_at(F.split(id_, "/"), -1)
