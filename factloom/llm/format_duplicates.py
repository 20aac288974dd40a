"""Collapsing records that differ in formatting only.

Each field of a record becomes normalized (name, value) pairs. A pair is hashed, and the hashes of a record's pairs are added modulo a
prime in two lanes, so the fingerprint doesn't depend on the order of the pairs and nothing is sorted. Records are grouped by
fingerprint, and every record is then compared field by field with the one its group kept; records that only share a fingerprint are
told apart by their full normalized content.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.plans.layout import cut, sized

#: The modulus of the additive multiset hash, a Mersenne prime: sums of two residues stay below 2^62.
PRIME = (1 << 61) - 1

WORD = r"[\p{L}\p{Nd}]+(?:(?<=[0-9])\.(?=[0-9])[\p{L}\p{Nd}]+)*"
GAP = r"[^\p{L}\p{Nd}]"


def plain(text: Column) -> Column:
    """Lower case, without all that is neither letter nor digit; a point between two digits stays."""
    return F.regexp_replace(F.lower(text), r"(?<![0-9])\.|\.(?![0-9])|[^\p{L}\p{Nd}.]", "")


def parts_of(text: Column) -> Column:
    """The name/value parts of a text that lists two or more, as an array of structs (name, value); null for any other text.

    A list consists of parts only: a word or number, a gap with ``:`` or ``=``, a word or number; between parts no ``:`` or ``=``.
    """
    gap, sign, other = GAP, "[:=]", r"[^\p{L}\p{Nd}:=]"
    part = f"{WORD}{other}*{sign}{gap}*?{WORD}"
    lower = F.lower(text)
    may = F.contains(text, F.lit(":")) | F.contains(text, F.lit("="))  # spares most texts the expression
    whole = may & lower.rlike(f"^{other}*{part}(?:{other}+{part})+{other}*$")
    found = F.regexp_extract_all(lower, F.lit(f"({WORD}){other}*{sign}{gap}*?({WORD})"), F.lit(0))
    halves = lambda x: F.struct(F.regexp_extract(x, f"^({WORD})", 1).alias("name"), F.regexp_extract(x, f"({WORD})$", 1).alias("value"))
    return F.when(whole, F.array_distinct(F.transform(found, halves)))


def pairs_of(fields: list[str], listed: list[str]) -> Column:
    """The normalized pairs of a record: (field, name, value). Fields in ``listed`` may hold lists of parts."""
    def pairs(f: str) -> Column:
        pair = lambda name, value: F.struct(F.lit(f).alias("field"), name.alias("name"), value.alias("value"))
        whole = F.array(pair(F.lit(""), F.coalesce(plain(F.col(f)), F.lit("\0"))))
        return F.coalesce(F.transform(parts_of(F.col(f)), lambda p: pair(p["name"], p["value"])), whole) if f in listed else whole

    return F.concat(*map(pairs, fields))


def multiset_hash(pairs: Column) -> Column:
    """A fingerprint of 122 bits, the same for any order of the pairs."""
    prime = F.lit(PRIME)
    lane = lambda salt: F.aggregate(pairs, F.lit(0).cast("bigint"), lambda a, p: F.pmod(a + F.pmod(F.xxhash64(F.lit(salt), p["field"], p["name"], p["value"]), prime), prime))
    return F.struct(lane(1).alias("a"), lane(2).alias("b"))


def _same(a: Column, b: Column) -> Column:
    """Equality of two sets of pairs, without sorting either."""
    return (F.size(a) == F.size(b)) & (F.size(F.array_except(a, b)) == 0)


def format_groups(records: DataFrame, *, id: str, fields: list[str], listed: list[str] | None = None, fingerprint=multiset_hash) -> DataFrame:
    """Every record with the smallest id among the records that are the same but for formatting: columns ``first`` and ``id``.

    Two records are the same when each of ``fields`` agrees after :func:`plain`, or, for fields in ``listed``, when both list the same set
    of two or more name/value parts.

    Defined cases: a null field equals null only, an empty one also equals what has no letters or digits; records with a null id take no part;
    repeated rows (same id) count once each and give one row; a record without copies is its own first; empty tables give no rows.

    Records are normalized once and written with their fingerprints. The first of a group is a hash aggregate of numbers, which folds before
    the shuffle, so a group with a third of all records costs one row per map task. Records without a fellow are done then; the others are
    compared with their group's first by hash joins, broadcast where the counted groups are few, whose hot partitions the adaptive planner splits
    otherwise. Nothing is sorted.
    """
    rows = records.select(F.col(id).alias("__id"), *fields).dropna(subset=["__id"]).withColumn("__p", pairs_of(fields, listed or []))
    rows = cut(rows.select("__id", "__p", fingerprint(F.col("__p")).alias("__fp")).select("__id", "__p", F.col("__fp.a").alias("__a"), F.col("__fp.b").alias("__b")))
    fp = ["__a", "__b"]
    firsts = cut(rows.groupBy(*fp).agg(F.min("__id").alias("first"), F.count(F.lit(1)).alias("__n")))
    alone = firsts.where("__n = 1").select("first", F.col("first").alias("id"))
    groups = firsts.where("__n > 1").drop("__n")
    n = groups.count()
    members = cut(rows.join(sized(groups, n), fp))  # groups are rows of fixed width
    kept = members.where("__id = first").select(*fp, F.col("__p").alias("__k"))
    checked = members.join(kept.hint("shuffle_hash"), fp).withColumn("__ok", _same(F.col("__p"), F.col("__k")))
    agree = checked.where("__ok").select("first", F.col("__id").alias("id"))
    # records that share a fingerprint with others but not their content: grouped by the content itself
    odd = checked.where("NOT __ok").withColumn("__c", F.array_sort("__p")).select("__id", "__c")
    by_content = odd.groupBy("__c").agg(F.min("__id").alias("first")).hint("shuffle_hash")
    split = odd.join(by_content, "__c").select("first", F.col("__id").alias("id"))
    return alone.unionByName(agree.unionByName(split).distinct())


def collapse(records: DataFrame, *, id: str, fields: list[str], listed: list[str] | None = None) -> DataFrame:
    """One record for each group of :func:`format_groups`: the first one's id and fields as written, and ``n_copies``, its number of copies."""
    counted = format_groups(records, id=id, fields=fields, listed=listed).groupBy("first").agg(F.count(F.lit(1)).alias("n_copies"))
    kept = records.select(F.col(id).alias("first"), *fields).dropDuplicates(["first"])
    return counted.join(kept, "first").select(F.col("first").alias(id), *fields, "n_copies")
