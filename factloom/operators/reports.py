"""Views over the store for readers: what changed, what stands, what the pile of notes repeats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import constants as K
from factloom.functions.exprs import effective_confidence, one_line, short_name, valid_at
from factloom.plans.layout import cut


def recent_supersessions(facts: DataFrame, now: Column, days: int = K.SUPERSESSION_DAYS) -> DataFrame:
    """Facts closed by a superseding one within the window, with their successor (null where it is gone): old_id, new_id, at."""
    by = F.regexp_extract(F.coalesce("invalidation_reason", F.lit("")), r"^superseded by (\S+)$", 1)
    closed = facts.where(F.col("t_invalid") >= now - F.make_dt_interval(F.lit(days))).select(F.col("id").alias("old_id"), by.alias("by"), F.col("t_invalid").alias("at")).where("by <> ''")
    successor = facts.select(F.col("id").alias("new_id")).dropDuplicates()
    return closed.join(successor, F.col("by") == F.col("new_id"), "left").select("old_id", "new_id", "at")


def _object(kind: str, name: str) -> Column:
    return F.when(F.col(kind) == "entity", F.col(name)).otherwise(F.concat(F.lit('"'), one_line(F.coalesce(name, F.lit(""))), F.lit('"')))


def context_lines(hydrated: DataFrame, open_pairs: DataFrame, now: Column, most_facts: int = K.CONTEXT_FACTS) -> DataFrame:
    """The lines of the compiled view: section (1 decisions, 2 conflicts, 3 changes, 4 facts), place, line. hydrated: distinct facts."""
    live = hydrated.where(valid_at(now))
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    text = F.concat(F.lit("- "), "subject_name", F.lit(" "), short_name(F.col("predicate")), F.lit(" "), _object("object_kind", "object_name"))
    decisions = live.where("epistemic = 'commitment'").select(F.lit(1).alias("section"), F.struct(F.lit(0.0).alias("x"), F.unix_micros("t_valid").alias("y"), F.col("id").alias("z")).alias("o"), F.concat(text, F.lit(" (since "), day("t_valid"), F.lit(")")).alias("line"))
    side = lambda s: hydrated.select(F.col("id").alias(f"{s}_id"), F.col("subject_name").alias(f"{s}_subject"), F.col("predicate").alias(f"{s}_predicate"), _object("object_kind", "object_name").alias(f"{s}_object"))
    pairs = open_pairs.select(F.col("fact_id").alias("a_id"), F.col("candidate_id").alias("b_id")).join(side("a"), "a_id").join(side("b"), "b_id")
    head = lambda s: F.concat(F.lit("- "), f"{s}_subject", F.lit(" "), short_name(F.col(f"{s}_predicate")), F.lit(": "), f"{s}_object")
    conflicts = pairs.select(F.lit(2).alias("section"), F.struct(F.lit(0.0).alias("x"), F.lit(0).cast("bigint").alias("y"), F.concat_ws(" ", "a_id", "b_id").alias("z")).alias("o"), F.concat(head("a"), F.lit(" vs "), "b_object").alias("line"))
    changed = recent_supersessions(hydrated, now).select(F.col("old_id").alias("a_id"), F.col("new_id").alias("b_id"), "at").join(side("a"), "a_id").join(side("b"), "b_id", "left")
    to = F.when(F.col("b_object").isNull(), F.lit(" (no longer)")).otherwise(F.concat(F.lit(" → "), "b_object"))
    changes = changed.select(F.lit(3).alias("section"), F.struct(F.lit(0.0).alias("x"), (-F.unix_micros("at")).alias("y"), F.col("a_id").alias("z")).alias("o"), F.concat(head("a"), to, F.lit(" ("), day("at"), F.lit(")")).alias("line"))
    disputed = open_pairs.select(F.col("fact_id").alias("id"))
    best = live.where("epistemic IS DISTINCT FROM 'commitment' AND source_type IS DISTINCT FROM 'code'").join(disputed, "id", "left_anti").withColumn("eff", F.coalesce(effective_confidence(now), F.lit(0.0)))
    best = best.orderBy(F.desc("eff"), "subject_name", "id").limit(most_facts)
    top = best.select(F.lit(4).alias("section"), F.struct((-F.col("eff")).alias("x"), F.lit(0).cast("bigint").alias("y"), F.concat_ws(" ", "subject_name", "id").alias("z")).alias("o"), F.concat(text, F.format_string(" (%.2f)", "eff")).alias("line"))
    every = decisions.unionByName(conflicts).unionByName(changes).unionByName(top)
    return every.select("section", "o", "line")


HEADERS = {1: "What has been decided", 2: "Statements at odds", 3: "What changed lately", 4: "What holds, surest first"}


def fit(preamble: str, sections: list[tuple[str, list[str], int]], budget: int) -> str:
    """Sections (header, first lines, number of all lines) into at most ``budget`` UTF-8 bytes, in order of priority.

    A section that is cut says how many lines are missing, and gives up lines to make room for that; one without room even for it is left out.
    """
    size = lambda s: len(s.encode())
    out, used = preamble, size(preamble)
    for header, lines, total in sections:
        if not total:
            continue
        head = f"\n\n### {header}"
        kept, room = [], budget - used - size(head)
        for line in lines:
            if size(line) + 1 > room:
                break
            kept.append(line)
            room -= size(line) + 1
        if len(kept) < total:
            notice = lambda: f"- … {total - len(kept)} more"
            while kept and size(notice()) + 1 > room:
                room += size(kept.pop()) + 1
            if size(notice()) + 1 > room:
                continue
            kept.append(notice())
        out += head + "".join(f"\n{x}" for x in kept)
        used = size(out)
    return out


def compile_context(lines: DataFrame, preamble: str, budget: int = K.CONTEXT_BUDGET) -> str:
    """The compiled view as text. Only as many first lines of a section as the budget could hold reach the driver; the others are counted."""
    lines = cut(lines)
    counts = {r.section: r.n for r in lines.groupBy("section").agg(F.count(F.lit(1)).alias("n")).collect()}
    first: dict[int, list[str]] = {}
    most = budget // 4  # bytes of the shortest line with its break: more lines than this can't fit
    for s in counts:  # four sections at most; the first lines of each are a top-k of every partition, then of those
        first[s] = [r.line for r in lines.where(F.col("section") == s).orderBy("o", "line").limit(most).select("line").collect()]
    return fit(preamble, [(h, first.get(s, []), counts.get(s, 0)) for s, h in HEADERS.items()], budget)


def restatements(occurrences: DataFrame) -> DataFrame:
    """Facts stated more than once, or that the code states already. occurrences: fact_id, file, code (boolean): fact_id, files, n, restates_code."""
    per = occurrences.groupBy("fact_id").agg(F.sort_array(F.collect_set("file")).alias("files"), F.count(F.lit(1)).alias("n"), F.bool_or("code").alias("restates_code"))
    return per.where("n > 1 OR restates_code")


def injection_report(files: DataFrame, window: int = K.CONTEXT_BUDGET) -> DataFrame:
    """The bytes of a pile of files (path, text) against the window a reader gets: pile_bytes, over_budget, files_over_window."""
    b = F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint")
    return files.agg(F.coalesce(F.sum(b), F.lit(0)).alias("pile_bytes"), F.count_if(b > window).alias("files_over_window")).select("pile_bytes", (F.col("pile_bytes") > window).alias("over_budget"), "files_over_window")


def scorecard(statuses: DataFrame) -> DataFrame:
    """Counts of findings by kind. statuses: status, reason, code_side (boolean)."""
    kind = F.when((F.col("status") == "flag") & F.col("code_side"), "stale").when(F.col("status") == "flag", "contradiction").when(F.col("status") == "supersede", "disagreement").when(F.col("status") == "reinforce", "restatement").when(F.col("status") == "error", "rejected").otherwise("claim")
    return statuses.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def enrichment_candidates(entities: DataFrame, usage: DataFrame, most: int = K.ENRICH_ENTITIES) -> DataFrame:
    """The most used entities without an alias: id, name, n."""
    bare = entities.where(F.col("aliases").isNull() | (F.size("aliases") == 0))
    return bare.join(usage.select(F.col("entity_id").alias("id"), "n"), "id").orderBy(F.desc("n"), "name", "id").limit(most).select("id", "name", "n")


def roster(entities: DataFrame, usage: DataFrame, most: int = K.ROSTER_LIMIT) -> DataFrame:
    """The entities most used, then by name, with their number of facts: id, name, n."""
    return entities.join(usage.select(F.col("entity_id").alias("id"), "n"), "id", "left").select("id", "name", F.coalesce("n", F.lit(0)).alias("n")).orderBy(F.desc("n"), "name", "id").limit(most)


def promotion_candidates(registry: DataFrame, usage: DataFrame, least: int = K.PROMOTE_USAGE) -> DataFrame:
    """Predicates on trial that are used enough: id, n."""
    return registry.where("status = 'testing'").join(usage.select(F.col("predicate").alias("id"), "n"), "id").where(F.col("n") >= least).select("id", "n")


def precision_recall(found: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """Found against true rows by key: found, truth, hits, precision, recall."""
    f, t = found.select(*keys).dropDuplicates(), truth.select(*keys).dropDuplicates()
    n = f.withColumn("f", F.lit(1)).join(t.withColumn("t", F.lit(1)), keys, "full_outer").agg(F.count("f").alias("found"), F.count("t").alias("truth"), F.count_if(F.col("f").isNotNull() & F.col("t").isNotNull()).alias("hits"))
    part = lambda of: F.round(F.when(F.col(of) > 0, F.col("hits") / F.col(of)).otherwise(0.0), 9)
    return n.select("found", "truth", "hits", part("found").alias("precision"), part("truth").alias("recall"))
