"""Prompts for injected language models, and tolerant reading of what they reply. The engine itself calls none: callers pass functions of DataFrames."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.functions import constants as K
from factloom.functions.exprs import short_name

RELATIONS = ("contradicts", "duplicate", "supersedes", "compatible")


def judgment(reply: Column) -> Column:
    """struct(relation, confidence, rationale) of the first JSON line that names a known relation; ``unparseable`` with 0 where there is none."""
    lines = F.filter(F.transform(F.split(F.coalesce(reply, F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: x.startswith("{"))
    read = F.transform(lines, lambda x: F.from_json(x, "relation string, confidence double, rationale string"))
    known = F.filter(read, lambda r: F.lower(r["relation"]).isin(*RELATIONS))
    first = F.get(known, F.lit(0))
    sure = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(first["confidence"], F.lit(0.0))))
    return F.struct(F.coalesce(F.lower(first["relation"]), F.lit("unparseable")).alias("relation"), F.when(first.isNull(), 0.0).otherwise(sure).alias("confidence"), first["rationale"].alias("rationale"))


def summary(reply: Column, most: int = K.SUMMARY_CHARS) -> Column:
    """The reply on one line without fences and blank lines, cut with an ellipsis; null where nothing is left."""
    lines = F.transform(F.split(F.coalesce(reply, F.lit("")), "\n"), lambda x: F.trim(x))
    text = F.array_join(F.filter(lines, lambda x: (x != "") & ~x.startswith("```")), " ")
    return F.when(text == "", F.lit(None).cast("string")).when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("…"))).otherwise(text)


def aliases(reply: Column, name: Column, held: Column, most: int = K.ENRICH_ALIASES) -> Column:
    """The first JSON array of names in a reply, without blanks and the entity's own names, each once, at most ``most``."""
    raw = F.from_json(F.regexp_extract(F.coalesce(reply, F.lit("")), r"(?s)\[.*?\]", 0), "array<string>")
    own = F.transform(F.concat(F.array(name), F.coalesce(held, F.array().cast("array<string>"))), lambda x: F.lower(x))
    new = F.filter(F.transform(F.coalesce(raw, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: (x != "") & ~F.array_contains(own, F.lower(x)))
    return F.slice(F.array_distinct(new), 1, most)


def judgment_prompt() -> Column:
    """A prompt about a pair: columns subject_name, a_predicate, a_object, b_predicate, b_object."""
    return F.concat(
        F.lit("Two statements about a project may be at odds.\nNewer: "), "subject_name", F.lit(" "), short_name(F.col("a_predicate")), F.lit(" "), "a_object", F.lit("\nOlder: "), "subject_name", F.lit(" "), short_name(F.col("b_predicate")),
        F.lit(" "), "b_object", F.lit('\nReply with one line of JSON: {"relation": one of ' + ", ".join(RELATIONS) + ', "confidence": 0 to 1}'),
    )


#: What an extraction is told about its text, by kind.
ABOUT = {
    "session": "what this text tells for good about the project",
    "notes": "what these notes, which an assistant wrote for itself, tell for good about the project; they decide nothing",
    "failure": "what went wrong here and what to look out for, as failure modes of the part concerned",
    "audit": "every claim this file makes about the project, whether it holds or not",
}


def extraction_prompt(text: Column, predicates: list[str], roster: list[str], kind: str = "session") -> Column:
    """A prompt that asks for the durable facts in a text, as JSON lines. kind: session, notes, failure or audit."""
    head = (
        f"State {ABOUT[kind]}, one JSON object a line and nothing else.\nKeys: subject, predicate, object, object_kind (entity or literal), class (observation, commitment or preference), confidence.\n"
        "Predicates: " + ", ".join(predicates) + "\nKnown names: " + ", ".join(roster) + "\n\n"
    )
    return F.concat(F.lit(head), text)


def summary_prompt(lines: Column) -> Column:
    """A prompt for the summary of an episode, of the lines (an array) of the facts that came from it."""
    return F.concat(F.lit(f"Say in at most {K.SUMMARY_CHARS} characters and one paragraph what this stretch of work led to.\n"), F.array_join(lines, "\n"))


def alias_prompt(name: Column, lines: Column) -> Column:
    """A prompt for other names people use for an entity, with the lines (an array) of what is known of it."""
    return F.concat(F.lit("Which other names would somebody type for this? Reply with a JSON array of at most "), F.lit(K.ENRICH_ALIASES), F.lit(" strings, or [].\nName: "), name, F.lit("\n"), F.array_join(lines, "\n"))


def hook_output(briefing: Column, event: str = "PreToolUse") -> Column:
    """What an editor hook answers with: the briefing as additional context, or null where there is nothing to say."""
    inner = F.struct(F.lit(event).alias("hookEventName"), briefing.alias("additionalContext"))
    return F.when(F.trim(F.coalesce(briefing, F.lit(""))) != "", F.to_json(F.struct(inner.alias("hookSpecificOutput"))))


def hook_query(payload: Column) -> Column:
    """What an editor hook's JSON payload is about: its prompt, else the tool's file, command or pattern."""
    paths = ("$.prompt", "$.tool_input.file_path", "$.tool_input.command", "$.tool_input.pattern")
    return F.coalesce(*(F.nullif(F.get_json_object(payload, p), F.lit("")) for p in paths))
