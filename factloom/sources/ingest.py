"""Sources: tolerant JSON lines, transcripts, notes, decision records, source code, dumps."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.functions import constants as K
from factloom.functions.exprs import complete_json, content_hash, episode_ref, norm_name, parse_instant, strip_section, valid_at
from factloom.plans.shipping import ship

CANDIDATE = T.StructType([T.StructField(c, T.StringType()) for c in ("subject", "predicate", "object", "object_kind", "object-kind", "class", "epistemic", "scope")] + [T.StructField("confidence", T.DoubleType())])


def json_lines(texts: DataFrame, *, id: str, text: str) -> DataFrame:
    """The candidates in replies, one JSON object a line: prose, fences and broken lines are passed over. id, place, and the candidate's fields."""
    lines = texts.select(F.col(id), F.posexplode(F.split(F.col(text), "\n")).alias("place", "line")).withColumn("line", F.trim("line")).where("line LIKE '{%'")
    got = lines.where(complete_json(F.col("line"))).withColumn("c", F.from_json("line", CANDIDATE))
    kind = F.coalesce("c.object_kind", F.col("c.`object-kind`"))
    return got.select(id, "place", "c.subject", "c.predicate", "c.object", kind.alias("object_kind"), F.coalesce("c.epistemic", "c.class").alias("epistemic"), "c.confidence", "c.scope")


def complete(subject: Column, predicate: Column, object_: Column) -> Column:
    """Whether a candidate has all of a triple."""
    filled = lambda c: F.length(F.trim(F.coalesce(c, F.lit("")))) > 0
    return filled(subject) & filled(predicate) & filled(object_)


def prepare_candidates(candidates: DataFrame, *, kind: str) -> DataFrame:
    """Candidates with source type and capped confidence, ``accepted`` telling complete ones. kind: session, failure, notes or audit.

    Notes may not commit: their commitments become observations and are marked ``demoted``.
    """
    cap, default, source = {"session": (K.SESSION_CAP, K.SESSION_DEFAULT, "session-log"), "failure": (K.SESSION_CAP, K.SESSION_DEFAULT, "session-log"), "notes": (K.NOTES_CAP, K.NOTES_DEFAULT, "agent-note"), "audit": (K.NOTES_CAP, K.NOTES_DEFAULT, "agent-note")}[kind]
    demoted = F.coalesce(F.col("epistemic") == "commitment", F.lit(False)) if kind == "notes" else F.lit(False)
    return candidates.withColumns({
        "accepted": complete(F.col("subject"), F.col("predicate"), F.col("object")), "confidence": F.least(F.lit(cap), F.coalesce("confidence", F.lit(default))), "source_type": F.lit(source),
        "demoted": demoted, "epistemic": F.when(demoted, "observation").otherwise(F.col("epistemic")),
    })


def transcript(texts: DataFrame, *, id: str, text: str) -> DataFrame:
    """Session texts: where every line is JSON, its messages as ``role: text`` turns; any other text as it is."""
    lines = F.filter(F.split(F.col(text), "\n"), lambda x: F.trim(x) != "")
    message = "struct<role:string,content:string,message:struct<role:string,content:string>>"
    parsed = F.transform(lines, lambda x: F.from_json(x, message))
    all_json = (F.size(lines) > 0) & F.forall(lines, lambda x: x.startswith("{") & complete_json(x))
    turn = lambda m: F.concat(F.coalesce(m["message"]["role"], m["role"]), F.lit(": "), F.coalesce(m["message"]["content"], m["content"]))
    flat = F.array_join(F.filter(F.transform(parsed, turn), lambda x: x.isNotNull()), "\n\n")
    return texts.select(id, F.when(all_json, flat).otherwise(F.col(text)).alias("transcript"), F.coalesce(all_json, F.lit(False)).alias("flattened"))


def text_files(spark: SparkSession, folder: str, glob: str = "*.md") -> DataFrame:
    """The files below a folder whose names match, each whole: ``path``, ``content``."""
    read = spark.read.text(folder, wholetext=True, pathGlobFilter=glob, recursiveFileLookup=True)
    return read.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


def assertions(spark: SparkSession, path: str) -> DataFrame:
    """A file or folder of JSON lines as assertions, in order: snake or kebab keys, ``class`` for epistemic, valid-from and valid-until for the interval.

    An explicit epistemic wins over a class; broken lines are passed over; ``seq`` follows the order of files and lines.
    """
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("seq"), F.regexp_replace("value", r'"([A-Za-z]+)-([A-Za-z]+)"\s*:', r'"$1_$2":').alias("line")).where(complete_json(F.col("line")))
    names = ("subject", "subject_type", "predicate", "object", "object_type", "object_kind", "epistemic", "class", "scope", "source_type", "on_conflict", "valid_from", "valid_until", "t_valid", "t_invalid", "episode")
    read = lines.withColumn("r", F.from_json("line", T.StructType([*(T.StructField(n, T.StringType()) for n in names), T.StructField("confidence", T.DoubleType())])))
    r = lambda c: F.col(f"r.{c}")
    plain = [r(c).alias(c) for c in ("subject", "subject_type", "predicate", "object", "object_type", "object_kind", "scope", "confidence", "source_type", "on_conflict", "episode")]
    return read.where("r IS NOT NULL").select("seq", *plain, F.coalesce(r("epistemic"), r("class")).alias("epistemic"), parse_instant(F.coalesce(r("t_valid"), r("valid_from"))).alias("t_valid"), parse_instant(F.coalesce(r("t_invalid"), r("valid_until"))).alias("t_invalid"))


def splice_section(text: Column, section: Column, begin: str, end: str) -> Column:
    """A text with its managed section replaced, or added at the end; the rest stays as it is."""
    block = F.concat(F.lit(begin), section, F.lit(end))
    start = F.locate(begin, text)
    close = F.locate(end, text, 1)
    head = F.substring(text, F.lit(1), start - 1)
    tail = F.when(close > start, F.substring(text, close + len(end), F.length(text))).otherwise(F.lit(""))
    return F.when(start > 0, F.concat(head, block, tail)).otherwise(F.concat(text, block))


def notes(files: DataFrame, *, begin: str, end: str) -> DataFrame:
    """Note files (path, content) without their managed section, trimmed, blank ones left out, with ``hash``, the first 12 digits of SHA-256."""
    body = F.regexp_replace(strip_section(F.col("content"), begin, end), r"^\s+|\s+$", "")
    return files.select("path", body.alias("content")).where("content <> ''").withColumn("hash", F.substring(content_hash(F.col("content")), 1, 12))


def seen_hashes(episodes: DataFrame, harness: str) -> DataFrame:
    """The (path, hash) pairs that earlier passes of a harness left in the refs of its episodes: ``harness:path@hash``."""
    ref = F.col("ref")
    rows = episodes.where(ref.startswith(f"{harness}:"))
    path = F.regexp_extract(ref, r"^[^:]+:(.*)@([0-9a-f]+)$", 1)
    return rows.select(path.alias("path"), F.regexp_extract(ref, r"^[^:]+:(.*)@([0-9a-f]+)$", 2).alias("hash")).where("path <> ''").dropDuplicates()


def changed_notes(read: DataFrame, seen: DataFrame) -> DataFrame:
    """Notes whose content no earlier pass has seen under that path."""
    return read.join(seen, ["path", "hash"], "left_anti")


def note_ref(harness: str) -> Column:
    return episode_ref(F.lit(harness), F.col("path"), F.col("hash"))


def evidence(texts: DataFrame, *, text: str) -> DataFrame:
    """Content-addressed texts: one row for each different text, ``sha256`` and ``content``; nulls are left out."""
    return texts.select(content_hash(F.col(text)).alias("sha256"), F.col(text).alias("content")).where("content IS NOT NULL").groupBy("sha256").agg(F.first("content").alias("content"))


def _after(text: Column, mark: str) -> Column:
    """What follows the first ``mark`` in a text; null where it has none."""
    at_ = F.locate(mark, text)
    return F.when(at_ > 0, F.substring(text, at_ + len(mark), F.length(text)))


def _bare(text: Column, chars: str = " \"'") -> Column:
    return F.btrim(text, F.lit(chars))


def decision_records(files: DataFrame, *, name: str, text: str) -> DataFrame:
    """Decision records as they state themselves: name, record_id, title, status, supersedes, superseded_by, rejected.

    A record is Markdown. Its first heading of level one is the title, in front of which ``ADR``, a number and a dash or colon may stand; else the number is the
    one the file name begins with. Lines ``Key: value`` give status, supersedes, superseded by and rejected (alternatives), lists by commas; the
    status may also be the first word of a section of that name. Items of a section ``Options`` or ``Considered options`` that aren't the ``chosen option`` are
    rejected too. Keys and headings count in any case. Null texts give no row, what isn't stated is null or empty.
    """
    lines = F.transform(F.split(F.col(text), "\n"), lambda x: F.rtrim(F.rtrim(x), F.lit("\r")))
    values = lambda key: F.filter(
        F.transform(lines, lambda x: F.when(F.replace(F.lower(F.substring_index(x, ":", 1)), F.lit("-"), F.lit(" ")).isin(*key) & F.contains(x, F.lit(":")), F.trim(_after(x, ":")))), lambda v: v != ""
    )
    field = lambda *key: F.get(values(key), F.lit(0))
    listed = lambda *key: F.filter(F.transform(F.split(F.coalesce(field(*key), F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    # a heading and what follows it, up to the next
    blocks = F.slice(F.split(F.concat(F.lit("\n"), F.col(text)), "\n#+ *"), 2, 1_000_000)
    section = lambda *key: F.get(F.filter(F.transform(blocks, lambda b: F.when(F.lower(F.trim(F.substring_index(b, "\n", 1))).isin(*key), _after(b, "\n"))), lambda b: b.isNotNull()), F.lit(0))
    heading = F.trim(F.substring(F.get(F.filter(lines, lambda x: x.startswith("#") & ~x.startswith("##")), F.lit(0)), 2, 1 << 20))
    number = F.regexp_extract(heading, "(?i)^adr[ -]?[0-9]+", 0)
    rest = F.trim(F.substring(heading, F.length(number) + 1, F.length(heading)))
    parted = (number != "") & (rest.startswith(":") | rest.startswith("-") | rest.startswith("—"))
    title = F.nullif(F.when(parted, F.trim(F.substring(rest, 2, 1 << 20))).otherwise(heading), F.lit(""))
    by_file = F.nullif(F.regexp_extract(F.col(name), "^([0-9]{1,5})[^0-9]", 1), F.lit(""))
    record = F.coalesce(F.nullif(F.upper(F.replace(number, F.lit(" "), F.lit("-"))), F.lit("")), F.concat(F.lit("ADR-"), by_file.cast("bigint")), F.regexp_replace(F.col(name), "[.][^.]*$", ""))
    stated = field("status")
    status = F.lower(F.coalesce(F.when(stated.rlike("^[A-Za-z0-9_][A-Za-z0-9_ -]*$"), stated), F.nullif(F.regexp_extract(F.btrim(section("status"), F.lit(" \n\r\t")), "^[A-Za-z0-9_][A-Za-z0-9_-]*", 0), F.lit(""))))
    items = F.filter(F.transform(F.split(F.coalesce(section("options", "considered options"), F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: x.startswith("- ") | x.startswith("* "))
    options = F.transform(items, lambda x: _bare(F.substring(x, 3, 1 << 20)))
    said = F.lower(_bare(F.get(F.split(F.btrim(_after(F.lower(F.col(text)), "chosen option"), F.lit(" :\"'")), "[\"'\n,.]"), F.lit(0))))
    left = F.when(F.coalesce(said, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.filter(options, lambda x: F.lower(x) != said))
    return files.where(F.col(text).isNotNull()).select(
        F.col(name), record.alias("record_id"), title.alias("title"), status.alias("status"), listed("supersedes").alias("supersedes"), listed("superseded by").alias("superseded_by"),
        F.array_distinct(F.concat(left, listed("rejected", "rejected alternatives"))).alias("rejected"),
    )


def decision_facts(records: DataFrame) -> DataFrame:
    """One assertion for each thing a decision record states: subject, subject_type, predicate, object, object_type, object_kind, epistemic, on_conflict."""
    text = lambda v: F.lit(v).cast("string")
    row = lambda p, o, k, e=None, c=None: F.struct(
        F.lit(p).alias("predicate"), o.alias("object"), F.lit(k).alias("object_kind"), text("decision-record" if k == "entity" else None).alias("object_type"), text(e).alias("epistemic"), text(c).alias("on_conflict")
    )
    each = lambda column, p, k, e=None: F.transform(column, lambda x: row(p, x, k, e))
    rows = F.concat(
        F.filter(F.array(row("core/has-status", F.col("status"), "literal", None, "supersede")), lambda r: r["object"].isNotNull()),
        each("supersedes", "core/supersedes", "entity"), each("superseded_by", "core/superseded-by", "entity"), each("rejected", "core/decided-against", "literal", "commitment"),
    )
    return records.select(F.col("record_id").alias("subject"), F.lit("decision-record").alias("subject_type"), F.explode(rows).alias("r")).select("subject", "subject_type", "r.*", F.lit("decision-record").alias("source_type"), F.lit(1.0).alias("confidence"))


OPENING, CLOSING = "([{", ")]}"


def namespace_of(source: str | None) -> tuple[str, list[str]] | None:
    """The namespace of a Lisp source file and the ones it requires or uses, from its first ``(ns …)`` form; None without one."""
    tokens = re.finditer(r';[^\n]*|"(?:\\.|[^"\\])*"|\\.|[()\[\]{}]|[^\s()\[\]{}";,]+', source or "")
    stack: list[list] = []
    for m in tokens:
        t = m.group()
        if t[0] in ';"\\':
            continue
        if t in OPENING:
            stack.append([])
        elif t in CLOSING:
            if not stack:
                return None
            form = stack.pop()
            if not stack:
                return _requires(form) if form[:1] == ["ns"] else None
            stack[-1].append(form)
        elif stack:
            stack[-1].append(t)
        else:
            return None
    return None


def _requires(form: list) -> tuple[str, list[str]] | None:
    if len(form) < 2 or not isinstance(form[1], str):
        return None
    specs = [s for clause in form[2:] if isinstance(clause, list) and clause[:1] in ([":require"], [":use"]) for s in clause[1:]]
    names = [s if isinstance(s, str) else s[0] if s and isinstance(s[0], str) else None for s in specs]
    return form[1], list(dict.fromkeys(n for n in names if n and not n.startswith(":")))


def code_facts(files: DataFrame, *, path: str, text: str, scope: str = K.DEFAULT_SCOPE) -> DataFrame:
    """What source files say about their namespaces: defined-in, written-in, depends-on; dependencies on others' namespaces have scope ``external``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(p, *got) for p, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if (got := namespace_of(t))]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.string(), pa.list_(pa.string())), strict=True)], names=["file", "ns", "requires"])

    ship(files.sparkSession)
    read = files.select(F.col(path).cast("string"), text).mapInArrow(run, "file string, ns string, requires array<string>")
    local = read.select(F.col("ns").alias("object")).dropDuplicates().withColumn("local", F.lit(True))
    fact = lambda s, p, o, k: F.struct(s.alias("subject"), F.lit(p).alias("predicate"), o.alias("object"), F.lit(k).alias("object_kind"))
    own = read.select(F.explode(F.array(fact(F.col("ns"), "core/defined-in", F.col("file"), "entity"), fact(F.col("file"), "core/written-in", F.lit("clojure"), "literal"))).alias("f")).select("f.*", F.lit(scope).alias("scope"))
    needs = read.select("ns", F.explode("requires").alias("object")).join(local, "object", "left")
    needs = needs.select(F.col("ns").alias("subject"), F.lit("core/depends-on").alias("predicate"), "object", F.lit("entity").alias("object_kind"), F.when(F.col("local"), scope).otherwise("external").alias("scope"))
    return own.unionByName(needs).withColumns({"source_type": F.lit("code"), "confidence": F.lit(0.95), "epistemic": F.lit("observation")})


def stale_facts(hydrated: DataFrame, produced: DataFrame, now: Column, scopes: tuple[str, ...]) -> DataFrame:
    """Live code facts of the scopes whose subject, predicate and object the code no longer yields: ``id``."""
    live = hydrated.where(valid_at(now) & (F.col("source_type") == "code") & F.col("scope").isin(*scopes))
    key = produced.select(F.col("subject").alias("subject_name"), "predicate", F.col("object").alias("object_name")).dropDuplicates()
    return live.join(key, ["subject_name", "predicate", "object_name"], "left_anti").select("id").dropDuplicates()


def dump(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """A store as JSON lines: ``type`` and ``json``, kinds in the order given. A line names its kind as ``record``, since entities have a type of their own."""
    rows = [df.select(F.lit(kind).alias("type"), F.to_json(F.struct(F.lit(kind).alias("record"), *df.columns)).alias("json")) for kind, df in tables.items()]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def load(lines: DataFrame, kind: str, schema: T.StructType) -> DataFrame:
    """The rows of one kind in a dump (column ``json``)."""
    return lines.where(F.get_json_object("json", "$.record") == kind).select(F.from_json("json", schema).alias("r")).select("r.*")


def remint(entities: DataFrame, facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A dump's entities under ids of this store, made of scope and normalised name, and its facts pointing at them.

    Entities of one scope and normalised name become one, named as the one of the smallest id, with the other names and all aliases as aliases.
    """
    from factloom.operators.resolve import repoint

    key = F.concat_ws("\0", F.coalesce("scope", F.lit(K.DEFAULT_SCOPE)), F.coalesce(norm_name(F.col("name")), "id"))
    mapped = entities.withColumn("__new", F.concat(F.lit("e-"), F.substring(F.sha2(key, 256), 1, 12)))
    others = [c for c in entities.columns if c not in ("id", "name", "aliases")]
    known = F.array_distinct(F.flatten(F.collect_list(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>"))))))
    one = mapped.groupBy("__new").agg(F.min_by("name", "id").alias("name"), known.alias("aliases"), *(F.min_by(c, F.when(F.col(c).isNotNull(), F.col("id"))).alias(c) for c in others))
    one = one.withColumn("aliases", F.array_compact(F.array_except("aliases", F.array("name")))).withColumnRenamed("__new", "id").select(*entities.columns)
    return one, repoint(facts, mapped.select(F.col("id").alias("old"), F.col("__new").alias("new"))).drop("touched")
