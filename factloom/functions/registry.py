"""The predicates a new store starts with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

REGISTRY = (
    "id string, label string, category string, object_kind string, cardinality string, inverse_of string, exclusion_group string, value_exclusivity string, status string, replaced_by string, "
    "default_epistemic string, definition string, maps_to string"
)

# Name, category, object kind, cardinality, default class, exclusion group, value exclusivity, inverse.
CORE = [
    ("depends-on", "structural", "entity", "many", "observation", None, None, "dependency-of"),
    ("dependency-of", "structural", "entity", "many", "observation", None, None, "depends-on"),
    ("imports", "structural", "entity", "many", "observation", None, None, None),
    ("defined-in", "structural", "entity", "one", "observation", None, None, None),
    ("contains", "structural", "entity", "many", "observation", None, None, "part-of"),
    ("part-of", "structural", "entity", "many", "observation", None, None, "contains"),
    ("implements", "structural", "entity", "many", "observation", None, None, None),
    ("written-in", "structural", "either", "many", "observation", None, None, None),
    ("has-version", "structural", "literal", "one", "observation", None, None, None),
    ("tested-by", "procedural", "entity", "many", "observation", None, None, None),
    ("built-with", "procedural", "entity", "many", "observation", None, None, None),
    ("generated-from", "procedural", "entity", "many", "observation", None, None, None),
    ("deployed-via", "procedural", "either", "many", "observation", None, None, None),
    ("failure-mode", "procedural", "literal", "many", "observation", None, None, None),
    ("supersedes", "decision", "entity", "many", "commitment", "revision", None, "superseded-by"),
    ("superseded-by", "decision", "entity", "many", "commitment", "revision", None, "supersedes"),
    ("decided-against", "decision", "either", "many", "commitment", "stance", None, None),
    ("prefers", "decision", "either", "many", "preference", "stance", "exclusive", None),
    ("motivated-by", "decision", "either", "many", "observation", None, None, None),
    ("has-status", "decision", "literal", "one", "commitment", None, None, None),
    ("derived-from", "provenance", "entity", "many", "observation", None, None, None),
    ("asserted-by", "provenance", "entity", "many", "observation", None, None, None),
    ("primary-source", "provenance", "either", "many", "observation", None, None, None),
]


def seed(spark: SparkSession) -> DataFrame:
    """The core predicates as registry rows."""
    words = lambda name: name.replace("-", " ")
    rows = [
        (f"core/{n}", words(n), category, kind, card, inverse and f"core/{inverse}", group, exclusive, "active", None, epistemic, f"the subject {words(n)} the object", None)
        for n, category, kind, card, epistemic, group, exclusive, inverse in CORE
    ]
    return spark.createDataFrame(rows, REGISTRY)
