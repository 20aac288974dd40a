"""Queries on logs, sources and reports. Each has its SQL beside it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.functions import exprs as X
from factloom.functions.exprs import complete_json
from factloom.operators import measures, oplog, reads, reports
from factloom.plans import knowledge_queries as kq
from factloom.plans.knowledge_queries import _CTE, _EFF, _NORM, _T, facts, hydrated, live, now
from factloom.plans.layout import shared_path
from factloom.sources import ingest
from factloom.sources.tables import table
from factloom.streaming import logs

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with the SQL that gives the same rows."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


# effect logs


def log(spark: SparkSession, folder: str) -> DataFrame:
    """The whole effects, of each (writer, seq) the content that landed last."""
    from factloom.operators.changes import latest_content

    return latest_content(table(spark, folder, "effects").where(complete_json(F.col("payload"))), keys=["writer", "seq"], content=["hlc", "t", "payload"], landed="landed_at")


_ONCE = '\'"([A-Za-z]+)_([A-Za-z_]+)"\\s*:\', \'"\\1-\\2":\', \'g\''
_LOG = f"""WITH log AS (SELECT writer, seq, arg_max(hlc, landed_at) AS hlc, arg_max(t, landed_at) AS t, regexp_replace(regexp_replace(arg_max(payload, landed_at), {_ONCE}), {_ONCE}) AS j FROM effects WHERE json_valid(payload) GROUP BY writer, seq)
"""


@query(_LOG + "SELECT writer, max(seq) AS high_water, count(DISTINCT seq) AS effects FROM log GROUP BY 1")
def highwater(spark, folder):
    return oplog.high_water(log(spark, folder))


@query(_LOG + ", m AS (SELECT writer, max(seq) // 2 AS hw FROM log GROUP BY 1) SELECT l.writer, l.seq, l.t FROM log l JOIN m USING (writer) WHERE l.seq > hw")
def unapplied_effects(spark, folder):
    rows = log(spark, folder)
    marks = oplog.high_water(rows).select("writer", F.expr("high_water div 2").alias("high_water"))
    return oplog.unapplied(rows, marks).select("writer", "seq", "t")


_REPLAY = _LOG + """, r AS (SELECT t, (hlc, writer, seq) AS o, CASE t WHEN 'insert-fact' THEN json_extract_string(j, '$.fact.id') ELSE json_extract_string(j, '$.fact-id') END AS id, j FROM log WHERE t IN ('insert-fact', 'invalidate', 'reinforce')),
 made AS (SELECT id, min(o) AS made, arg_min(j, o) AS j FROM r WHERE t = 'insert-fact' AND id IS NOT NULL GROUP BY 1),
 later AS (SELECT r.*, m.made FROM r JOIN made m USING (id) WHERE r.t <> 'insert-fact' AND r.o > m.made),
 inv AS (SELECT id, arg_max(json_extract_string(j, '$.at')::BIGINT, o) AS t_invalid_ms, arg_max(json_extract_string(j, '$.reason'), o) AS reason FROM later WHERE t = 'invalidate' GROUP BY 1),
 rei AS (SELECT id, arg_max(json_extract_string(j, '$.at')::BIGINT, o) AS last_reinforced_ms, arg_max(json_extract_string(j, '$.confidence')::DOUBLE, o) AS raised FROM later WHERE t = 'reinforce' GROUP BY 1)
"""


_KNOWN = """, men AS (SELECT id, min(o) AS since FROM (SELECT unnest([json_extract_string(j, '$.entity.id'), json_extract_string(j, '$.fact.subject.id'), json_extract_string(j, '$.fact.object-ref.id')]) AS id, (hlc, writer, seq) AS o
   FROM log WHERE t IN ('ensure-entity', 'insert-fact')) WHERE id IS NOT NULL GROUP BY 1),
 mv AS (SELECT (hlc, writer, seq) AS o, json_extract_string(j, '$.from') AS a, json_extract_string(j, '$.to') AS b FROM log WHERE t = 'repoint-facts'),
 mk AS (SELECT mv.* FROM mv JOIN men x ON x.id = a AND x.since < o JOIN men y ON y.id = b AND y.since < o WHERE a <> b)
"""


@query(
    (_REPLAY + _KNOWN).replace("WITH log", "WITH RECURSIVE log", 1) + """, side AS (SELECT id, made, 's' AS side, json_extract_string(j, '$.fact.subject.id') AS e FROM made UNION ALL SELECT id, made, 'o', json_extract_string(j, '$.fact.object-ref.id') FROM made),
 w(id, side, e, o) AS (SELECT id, side, e, made FROM side UNION ALL
   SELECT w.id, w.side, m.b, m.o FROM w JOIN mk m ON m.a = w.e AND m.o > w.o WHERE NOT EXISTS (SELECT 1 FROM mk n WHERE n.a = w.e AND n.o > w.o AND n.o < m.o)),
 fin AS (SELECT id, arg_max(e, o) FILTER (side = 's') AS subject, arg_max(e, o) FILTER (side = 'o') AS ref FROM w GROUP BY id)
SELECT m.id, fin.subject, json_extract_string(m.j, '$.fact.predicate') AS predicate,
 coalesce(json_extract_string(m.j, '$.fact.object-lit'), fin.ref) AS object, coalesce(raised, json_extract_string(m.j, '$.fact.confidence')::DOUBLE) AS confidence, coalesce(t_invalid_ms, 0) AS t_invalid_ms, reason, coalesce(last_reinforced_ms, 0) AS last_reinforced_ms
 FROM made m JOIN fin USING (id) LEFT JOIN inv USING (id) LEFT JOIN rei USING (id)"""
)
def oplog_replay(spark, folder):
    return oplog.facts(log(spark, folder)).fillna(0, ["t_invalid_ms", "last_reinforced_ms"])


@query(
    _LOG + _KNOWN + """, ep AS (SELECT coalesce(json_extract_string(j, '$.episode.id'), json_extract_string(j, '$.id')) AS id, min((hlc, writer, seq)) AS made FROM log WHERE t = 'open-episode' GROUP BY 1),
 fa AS (SELECT json_extract_string(j, '$.fact.id') AS id, min((hlc, writer, seq)) AS made FROM log WHERE t = 'insert-fact' GROUP BY 1),
 x AS (SELECT t, (hlc, writer, seq) AS o, json_extract_string(j, '$.fact.id') AS f0, json_extract_string(j, '$.fact-id') AS f1, json_extract_string(j, '$.id') AS e0, coalesce(json_extract_string(j, '$.episode.id'), json_extract_string(j, '$.id')) AS p0, json_extract_string(j, '$.from') AS a, json_extract_string(j, '$.to') AS b FROM log),
 y AS (SELECT x.t, CASE WHEN x.t IN ('ensure-entity', 'register-predicate', 'repoint-predicate') THEN 1
   WHEN x.t = 'insert-fact' THEN coalesce((SELECT made = x.o FROM fa WHERE fa.id = f0), false)::INT WHEN x.t = 'open-episode' THEN coalesce((SELECT made = x.o FROM ep WHERE ep.id = p0), false)::INT
   WHEN x.t IN ('update-entity', 'delete-entity') THEN coalesce((SELECT since < x.o FROM men WHERE men.id = e0), false)::INT WHEN x.t = 'close-episode' THEN coalesce((SELECT made < x.o FROM ep WHERE ep.id = p0), false)::INT
   WHEN x.t = 'repoint-facts' THEN (coalesce((SELECT since < x.o FROM men WHERE men.id = a), false) AND coalesce((SELECT since < x.o FROM men WHERE men.id = b), false))::INT
   WHEN x.t IN ('invalidate', 'reinforce', 'link-conflicts', 'unlink-conflicts') THEN coalesce((SELECT made < x.o FROM fa WHERE fa.id = f1), false)::INT ELSE -1 END AS s FROM x)
SELECT t, count(*) AS effects, count(*) FILTER (s = 1) AS applied, count(*) FILTER (s = 0) AS skipped, count(*) FILTER (s = -1) AS unknown FROM y GROUP BY 1"""
)
def replay_report(spark, folder):
    return oplog.replay_report(log(spark, folder))


@query(
    _LOG + """, e AS (SELECT json_extract_string(j, '$.fact-id') AS fact_id, unnest(from_json(json_extract(j, '$.ids'), '["VARCHAR"]')) AS candidate_id, t = 'link-conflicts' AS linked, (hlc, writer, seq) AS o FROM log WHERE t IN ('link-conflicts', 'unlink-conflicts'))
SELECT fact_id, candidate_id FROM e GROUP BY 1, 2 HAVING arg_max(linked, o)"""
)
def oplog_links(spark, folder):
    return oplog.conflict_links(log(spark, folder))


@query(
    _LOG + """, e AS (SELECT t, hlc, (hlc, writer, seq) AS o, coalesce(json_extract_string(j, '$.episode.id'), json_extract_string(j, '$.id')) AS id, coalesce(json_extract_string(j, '$.episode.summary'), json_extract_string(j, '$.summary')) AS summary, json_extract_string(j, '$.summary') AS s FROM log
   WHERE t IN ('open-episode', 'close-episode')), a AS (SELECT id, min(o) AS o0, min(hlc) AS opened_hlc, arg_min(summary, o) AS first_summary FROM e WHERE t = 'open-episode' AND id IS NOT NULL GROUP BY 1),
 b AS (SELECT e.id, max(e.hlc) AS closed_hlc, arg_max(s, o) AS closing FROM e JOIN a USING (id) WHERE t = 'close-episode' AND e.o > a.o0 GROUP BY 1)
SELECT a.id, opened_hlc, coalesce(closed_hlc, 0) AS closed_hlc, coalesce(closing, first_summary) AS summary FROM a LEFT JOIN b USING (id)"""
)
def oplog_episodes(spark, folder):
    return oplog.episodes(log(spark, folder)).fillna(0, ["closed_hlc"])


@query(_LOG + "SELECT t, count(*) AS n FROM log GROUP BY 1")
def stream_effects(spark, folder):
    """Kinds of effects, read as a stream of files and deduplicated as they come."""
    return logs.stream_counts(spark, f"{folder.rstrip('/')}/effects[.]parquet", shared_path(spark, "stream"))


# retrieval marks


@query(
    f"""WITH r AS (SELECT DISTINCT seq, type, fact_ids FROM retrievals), m AS (SELECT max(seq) AS mark FROM r WHERE type = 'outcome'), i AS (SELECT DISTINCT unnest(fact_ids) AS id FROM r, m WHERE type = 'read' AND (mark IS NULL OR seq > mark))
SELECT DISTINCT f.id, confidence, epoch_us({_T}) AS reinforced_us FROM facts f JOIN i USING (id)"""
)
def outcome_since_mark(spark, folder):
    return oplog.outcome(facts(spark, folder), table(spark, folder, "retrievals"), "accepted", now()).select("id", "confidence", F.unix_micros("last_reinforced_at").alias("reinforced_us"))


@query("SELECT seq, type, verb FROM (SELECT DISTINCT seq, type, verb FROM retrievals) ORDER BY seq DESC LIMIT 1000")
def trimmed_log(spark, folder):
    return oplog.trim_log(table(spark, folder, "retrievals").select("seq", "type", "verb").dropDuplicates(), 1000)


# sources


@query(
    """WITH l AS (SELECT doc_id, trim(unnest(string_split(text, chr(10)))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS place FROM documents WHERE text IS NOT NULL)
SELECT doc_id, place, json_extract_string(line, '$.subject') AS subject, json_extract_string(line, '$.predicate') AS predicate, json_extract_string(line, '$.object') AS object, json_extract_string(line, '$.confidence')::DOUBLE AS confidence FROM l
WHERE starts_with(line, '{') AND json_valid(line)"""
)
def parse_extraction(spark, folder):
    return ingest.json_lines(table(spark, folder, "documents"), id="doc_id", text="text").select("doc_id", "place", "subject", "predicate", "object", "confidence")


@query("SELECT doc_id, text AS transcript, false AS flattened FROM documents WHERE kind = 'session'")
def transcript_flatten(spark, folder):
    return ingest.transcript(table(spark, folder, "documents").where("kind = 'session'"), id="doc_id", text="text")


_CAND = """WITH l AS (SELECT doc_id, trim(unnest(string_split(text, chr(10)))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS place FROM documents WHERE text IS NOT NULL),
 c AS (SELECT doc_id, place, json_extract_string(line, '$.subject') AS subject, json_extract_string(line, '$.predicate') AS predicate, json_extract_string(line, '$.object') AS object, json_extract_string(line, '$.confidence')::DOUBLE AS confidence FROM l WHERE starts_with(line, '{') AND json_valid(line))
"""


@query(_CAND + "SELECT doc_id, place, least(0.7, coalesce(confidence, 0.6)) AS confidence, 'session-log' AS source_type, length(trim(coalesce(subject, ''))) > 0 AND length(trim(coalesce(predicate, ''))) > 0 AND length(trim(coalesce(object, ''))) > 0 AS accepted FROM c")
def prepared_candidates(spark, folder):
    got = ingest.json_lines(table(spark, folder, "documents"), id="doc_id", text="text")
    return ingest.prepare_candidates(got, kind="session").select("doc_id", "place", "confidence", "source_type", "accepted")


@query(
    f"""WITH n AS (SELECT DISTINCT {_NORM.format("name")} AS n FROM entities UNION SELECT DISTINCT {_NORM.format("a")} FROM (SELECT unnest(aliases) AS a FROM entities)), p AS (SELECT seq, subject, object, confidence, epistemic, replace(predicate, '_', '-') AS pred FROM assertions),
 s AS (SELECT p.*, pred IN (SELECT id FROM predicates) AS pk, coalesce({_NORM.format("subject")} IN (SELECT n FROM n WHERE n IS NOT NULL), false) AS sk FROM p),
 a AS (SELECT *, coalesce(confidence, 0.5) >= 0.3 AND length(coalesce(subject, '')) <= 80 AND length(coalesce(object, '')) <= 250 AS admit FROM s)
SELECT seq, admit, round(CASE WHEN admit THEN CASE epistemic WHEN 'commitment' THEN 1.0 WHEN 'preference' THEN 0.8 ELSE 0.5 END * (0.6 + CASE WHEN pk THEN 0.25 ELSE 0 END + CASE WHEN sk THEN 0.15 ELSE 0 END) ELSE 0 END, 6)::DOUBLE AS score FROM a"""
)
def admission_screen(spark, folder):
    from factloom.operators.resolve import entity_names

    names = entity_names(table(spark, folder, "entities")).where("kind = 2").select(F.col("key").alias("n")).dropDuplicates().withColumn("sk", F.lit(True))
    known = table(spark, folder, "predicates").select(F.col("id").alias("pred"), F.lit(True).alias("pk"))
    rows = table(spark, folder, "assertions").withColumns({"n": X.norm_name(F.col("subject")), "pred": F.replace("predicate", F.lit("_"), F.lit("-"))})
    rows = rows.join(names, "n", "left").join(known, "pred", "left")
    admit, score = X.admission(F.col("subject"), F.col("object"), F.col("confidence"), F.col("epistemic"), F.col("pk").isNotNull(), F.col("sk").isNotNull())
    return rows.select("seq", admit.alias("admit"), F.round(score, 6).alias("score"))


@query("SELECT sha256(text) AS sha256, count(*) AS documents FROM documents WHERE text IS NOT NULL GROUP BY 1")
def content_hashes(spark, folder):
    return table(spark, folder, "documents").where("text IS NOT NULL").groupBy(X.content_hash(F.col("text")).alias("sha256")).agg(F.count(F.lit(1)).alias("documents"))


@query("SELECT DISTINCT sha256(text) AS sha256, text AS content FROM documents WHERE text IS NOT NULL")
def evidence_store(spark, folder):
    return ingest.evidence(table(spark, folder, "documents"), text="text")


@query(
    """WITH n AS (SELECT 'notes/' || doc_id || '.md' AS path, left(sha256(regexp_replace(text, '^\\s+|\\s+$', '', 'g')), 12) AS hash, doc_id FROM documents WHERE kind = 'note' AND regexp_replace(text, '^\\s+|\\s+$', '', 'g') <> ''),
 e AS (SELECT 'pad:' || path || '@' || CASE WHEN doc_id % 5 = 0 THEN '0123456789ab' ELSE hash END AS ref FROM n WHERE doc_id % 3 <> 0),
 s AS (SELECT DISTINCT regexp_extract(ref, '^[^:]+:(.*)@([0-9a-f]+)$', 1) AS path, regexp_extract(ref, '^[^:]+:(.*)@([0-9a-f]+)$', 2) AS hash FROM e)
SELECT path, hash FROM n WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.path = n.path AND s.hash = n.hash)"""
)
def delta_changed_notes(spark, folder):
    """Notes that earlier passes, which are taken to have seen two thirds of them and some in older versions, haven't seen."""
    files = table(spark, folder, "documents").where("kind = 'note'").select(F.concat(F.lit("notes/"), "doc_id", F.lit(".md")).alias("path"), F.col("text").alias("content"), "doc_id")
    read = ingest.notes(files, begin="<!-- view:begin -->", end="<!-- view:end -->")
    number = F.regexp_extract("path", r"(\d+)", 1).cast("bigint")
    earlier = read.where(number % 3 != 0).withColumn("hash", F.when(number % 5 == 0, F.lit("0123456789ab")).otherwise(F.col("hash")))
    return ingest.changed_notes(read, ingest.seen_hashes(earlier.select(ingest.note_ref("pad").alias("ref")), "pad")).select("path", "hash")


_ADR = """WITH l AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x: trim(x)) AS ls FROM documents WHERE kind = 'adr' AND text IS NOT NULL),
 a AS (SELECT doc_id, nullif(lower(trim(substr(list_filter(ls, lambda x: starts_with(lower(x), 'status:'))[1], 8))), '') AS status,
   nullif(trim(substr(list_filter(ls, lambda x: starts_with(x, '#') AND NOT starts_with(x, '##'))[1], 2)), '') AS title FROM l)
"""


@query(_ADR + "SELECT doc_id, status, title FROM a")
def decision_records(spark, folder):
    files = table(spark, folder, "documents").where("kind = 'adr'").withColumn("name", F.concat(F.lpad(F.col("doc_id").cast("string"), 4, "0"), F.lit("-record.md")))
    got = ingest.decision_records(files.select("name", "text"), name="name", text="text")
    return got.select(F.regexp_extract("name", r"^0*(\d+)", 1).cast("bigint").alias("doc_id"), "status", "title")


@query(_ADR + "SELECT 'ADR-' || doc_id AS subject, 'core/has-status' AS predicate, status AS object FROM a WHERE status IS NOT NULL")
def decision_facts(spark, folder):
    files = table(spark, folder, "documents").where("kind = 'adr'").withColumn("name", F.concat(F.lit("0"), F.col("doc_id").cast("string"), F.lit("-record.md")))
    return ingest.decision_facts(ingest.decision_records(files.select("name", "text"), name="name", text="text")).select("subject", "predicate", "object")


@query(
    _CTE + f""", new AS (SELECT DISTINCT subject_name, predicate, object_name FROM h WHERE source_type = 'code' AND recorded_at >= TIMESTAMPTZ '2025-10-01 00:00:00+00')
SELECT id FROM live l WHERE source_type = 'code' AND scope IN ('project', 'external') AND NOT EXISTS (SELECT 1 FROM new n WHERE n.subject_name = l.subject_name AND n.predicate = l.predicate AND n.object_name = l.object_name)"""
)
def stale_reconcile(spark, folder):
    """Live code facts that no analysis since October states."""
    h = hydrated(spark, folder)
    since = h.where((F.col("source_type") == "code") & (F.col("recorded_at") >= X.at("2025-10-01 00:00:00")))
    produced = since.select(F.col("subject_name").alias("subject"), "predicate", F.col("object_name").alias("object"))
    return ingest.stale_facts(h, produced, now(), ("project", "external"))


_KINDS = "SELECT 'predicate' AS type, count(*) AS n FROM predicates UNION ALL SELECT 'entity', count(*) FROM entities UNION ALL SELECT 'episode', count(*) FROM episodes UNION ALL SELECT 'fact', count(*) FROM f"


def dumped(spark, folder) -> DataFrame:
    return ingest.dump(spark, {"predicate": table(spark, folder, "predicates"), "entity": table(spark, folder, "entities"), "episode": table(spark, folder, "episodes"), "fact": facts(spark, folder)})


@query(_CTE + _KINDS)
def dump_union(spark, folder):
    return dumped(spark, folder).groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@query(_CTE + "SELECT id, subject_id, predicate, object_ref, object_lit, epoch_us(t_valid)::VARCHAR AS t_valid, epoch_us(t_invalid)::VARCHAR AS t_invalid, epoch_us(recorded_at)::VARCHAR AS recorded_at, confidence FROM f")
def dump_load(spark, folder):
    """The facts of a dump, read back from its lines."""
    schema = T.StructType([f for f in facts(spark, folder).schema if f.name in ("id", "subject_id", "predicate", "object_ref", "object_lit", "t_valid", "t_invalid", "recorded_at", "confidence")])
    kept = {"fact": facts(spark, folder).withColumns({c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'") for c in ("t_valid", "t_invalid", "recorded_at")})}
    read = ingest.load(ingest.dump(spark, kept), "fact", schema)
    return read.select(*(F.unix_micros(f.name).cast("string").alias(f.name) if isinstance(f.dataType, T.TimestampType) else f.name for f in schema))


# reports


@query("SELECT coalesce(sum(strlen(text)), 0)::BIGINT AS pile_bytes, coalesce(sum(strlen(text)), 0) > 25000 AS over_budget, count(*) FILTER (strlen(text) > 25000) AS files_over_window FROM documents")
def injection_budget(spark, folder):
    return reports.injection_report(table(spark, folder, "documents"))


@query(
    f"""WITH o AS (SELECT {_NORM.format("subject")} || '|' || predicate || '|' || {_NORM.format("object")} AS fact_id, coalesce(episode, '-') AS file, coalesce(source_type = 'code', false) AS code FROM assertions WHERE subject IS NOT NULL AND object IS NOT NULL)
SELECT fact_id, array_to_string(list_sort(list(DISTINCT file)), ' ') AS files, count(*) AS n, bool_or(code) AS restates_code FROM o GROUP BY 1 HAVING count(*) > 1 OR bool_or(code)"""
)
def restatements(spark, folder):
    a = table(spark, folder, "assertions").dropna(subset=["subject", "object"])
    key = F.concat_ws("|", X.norm_name(F.col("subject")), "predicate", X.norm_name(F.col("object")))
    seen = a.select(key.alias("fact_id"), F.coalesce("episode", F.lit("-")).alias("file"), F.coalesce(F.col("source_type") == "code", F.lit(False)).alias("code"))
    return reports.restatements(seen).select("fact_id", F.array_join("files", " ").alias("files"), "n", "restates_code")


@query(
    kq.SQL["decide_action"].replace("SELECT id, p_id AS previous_id,", ", d AS (SELECT id,").replace(" AS reason FROM j", " AS reason FROM j)")
    + """ SELECT CASE WHEN action = 'flag' AND source_type = 'code' THEN 'stale' WHEN action = 'flag' THEN 'contradiction' WHEN action = 'supersede' THEN 'disagreement' ELSE 'restatement' END AS kind, count(*) AS n FROM d JOIN f USING (id) GROUP BY 1"""
)
def scorecard(spark, folder):
    decided = kq.decide_action(spark, folder).join(facts(spark, folder).select("id", "source_type"), "id")
    return reports.scorecard(decided.select(F.col("action").alias("status"), "reason", F.coalesce(F.col("source_type") == "code", F.lit(False)).alias("code_side")))


@query(
    _CTE + f""", c AS (SELECT id AS old_id, regexp_extract(coalesce(invalidation_reason, ''), '^superseded by (\\S+)$', 1) AS by_id, t_invalid AS "at" FROM f WHERE t_invalid >= {_T} - INTERVAL 30 DAYS)
SELECT old_id, n.id AS new_id, epoch_us("at") AS at_us FROM c LEFT JOIN f n ON n.id = by_id WHERE by_id <> ''"""
)
def recent_supersessions(spark, folder):
    return reports.recent_supersessions(facts(spark, folder), now()).select("old_id", "new_id", F.unix_micros("at").alias("at_us"))


_LINE = "'- ' || subject_name || ' ' || split_part(predicate, '/', -1) || ' ' || CASE WHEN object_kind = 'entity' THEN object_name ELSE '\"' || regexp_replace(coalesce(object_name, ''), '\\s*\\n\\s*', ' ', 'g') || '\"' END"
_OBJ = "CASE WHEN {0}.object_kind = 'entity' THEN {0}.object_name ELSE '\"' || regexp_replace(coalesce({0}.object_name, ''), '\\s*\\n\\s*', ' ', 'g') || '\"' END"
_HEAD = "'- ' || {0}.subject_name || ' ' || split_part({0}.predicate, '/', -1) || ': ' || " + _OBJ
_DAY = "strftime({0} AT TIME ZONE 'UTC', '%Y-%m-%d')"


@query(
    _CTE + f""", one AS (SELECT id FROM predicates WHERE value_exclusivity = 'exclusive'), ex AS (SELECT * FROM live WHERE predicate IN (SELECT id FROM one)),
 pr AS (SELECT CASE WHEN (coalesce(a.recorded_at, TIMESTAMPTZ '1900-01-01 00:00:00+00'), a.id) >= (coalesce(b.recorded_at, TIMESTAMPTZ '1900-01-01 00:00:00+00'), b.id) THEN a.id ELSE b.id END AS x, CASE WHEN (coalesce(a.recorded_at, TIMESTAMPTZ '1900-01-01 00:00:00+00'), a.id) >= (coalesce(b.recorded_at, TIMESTAMPTZ '1900-01-01 00:00:00+00'), b.id) THEN b.id ELSE a.id END AS y
   FROM ex a JOIN ex b ON a.subject_id = b.subject_id AND a.predicate = b.predicate AND a.id < b.id),
 ch AS (SELECT id AS o, regexp_extract(coalesce(invalidation_reason, ''), '^superseded by (\\S+)$', 1) AS n, t_invalid AS "at" FROM f WHERE t_invalid >= {_T} - INTERVAL 30 DAYS),
 top AS (SELECT *, coalesce({_EFF}, 0) AS eff FROM live WHERE epistemic IS DISTINCT FROM 'commitment' AND source_type IS DISTINCT FROM 'code' AND id NOT IN (SELECT x FROM pr) ORDER BY eff DESC, subject_name, id LIMIT 50)
SELECT 1 AS section, {_LINE} || ' (since ' || {_DAY.format("t_valid")} || ')' AS line FROM live WHERE epistemic = 'commitment'
UNION ALL SELECT 2, {_HEAD.format("a")} || ' vs ' || {_OBJ.format("b")} FROM pr JOIN h a ON a.id = x JOIN h b ON b.id = y
UNION ALL SELECT 3, {_HEAD.format("a")} || CASE WHEN b.id IS NULL THEN ' (no longer)' ELSE ' → ' || {_OBJ.format("b")} END || ' (' || {_DAY.format('"at"')} || ')' FROM ch JOIN h a ON a.id = o LEFT JOIN h b ON b.id = n WHERE n <> ''
UNION ALL SELECT 4, {_LINE} || printf(' (%.2f)', eff) FROM top"""
)
def context_sections(spark, folder):
    from factloom.operators import conflicts

    pairs = conflicts.exclusive_values(live(spark, folder), table(spark, folder, "predicates"))
    return reports.context_lines(hydrated(spark, folder), pairs, now()).select("section", "line")


@query()
def compiled_context(spark, folder):
    """The compiled view of the store as one text, with its size."""
    from factloom.operators import conflicts

    pairs = conflicts.exclusive_values(live(spark, folder), table(spark, folder, "predicates"))
    text = reports.compile_context(reports.context_lines(hydrated(spark, folder), pairs, now()), f"## What is known (as of {kq.NOW[:10]})")
    return spark.createDataFrame([(text, len(text.encode()))], "text string, bytes bigint")


@query(_CTE + ", u AS (SELECT e AS id, count(*) AS n FROM (SELECT subject_id AS e FROM f UNION ALL SELECT object_ref FROM f) WHERE e IS NOT NULL GROUP BY 1) SELECT id, name, n FROM u JOIN entities USING (id) WHERE aliases IS NULL OR len(aliases) = 0 ORDER BY n DESC, name, id LIMIT 20")
def enrichment_candidates(spark, folder):
    return reports.enrichment_candidates(table(spark, folder, "entities"), reads.entity_usage(facts(spark, folder)))


@query(_CTE + ", u AS (SELECT e AS id, count(*) AS n FROM (SELECT subject_id AS e FROM f UNION ALL SELECT object_ref FROM f) WHERE e IS NOT NULL GROUP BY 1) SELECT id, name, coalesce(n, 0) AS n FROM entities LEFT JOIN u USING (id) ORDER BY coalesce(n, 0) DESC, name, id LIMIT 200")
def entity_roster(spark, folder):
    return reports.roster(table(spark, folder, "entities"), reads.entity_usage(facts(spark, folder)))


@query(_CTE + "SELECT p.id, count(*) AS n FROM predicates p JOIN f ON f.predicate = p.id WHERE p.status = 'testing' GROUP BY 1 HAVING count(*) >= 3")
def promotion_candidates(spark, folder):
    return reports.promotion_candidates(table(spark, folder, "predicates"), reads.predicate_usage(facts(spark, folder)))


@query(
    _CTE + """, a AS (SELECT DISTINCT subject_id, object_ref FROM f WHERE predicate = 'core/imports' AND object_ref IS NOT NULL), b AS (SELECT DISTINCT subject_id, object_ref FROM f WHERE predicate = 'core/depends-on' AND object_ref IS NOT NULL),
 n AS (SELECT (SELECT count(*) FROM a) AS found, (SELECT count(*) FROM b) AS truth, (SELECT count(*) FROM a JOIN b USING (subject_id, object_ref)) AS hits)
SELECT found, truth, hits, round(hits / found, 9) AS precision, round(hits / truth, 9) AS recall FROM n"""
)
def precision_recall(spark, folder):
    """How far imports tell dependencies."""
    edge = lambda p: facts(spark, folder).where((F.col("predicate") == p) & F.col("object_ref").isNotNull())
    return reports.precision_recall(edge("core/imports"), edge("core/depends-on"), ["subject_id", "object_ref"])


@query("SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY GROUPING SETS ((1, 2), (1), ())")
def event_rollup(spark, folder):
    e = table(spark, folder, "events").withColumn("day", F.date_trunc("day", "ts"))
    return e.rollup("day", "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("SELECT source_type, count(*) AS n, median(confidence) AS median, max(confidence) AS most FROM (SELECT DISTINCT id, source_type, confidence FROM facts) WHERE confidence IS NOT NULL GROUP BY 1")
def confidence_medians(spark, folder):
    return measures.medians(facts(spark, folder), ["source_type"], "confidence")


@query("SELECT predicate, count(*) AS n, count(*) FILTER (t_invalid IS NOT NULL) AS hits, round(count(*) FILTER (t_invalid IS NOT NULL) / count(*), 9) AS rate FROM (SELECT DISTINCT id, predicate, t_invalid FROM facts) GROUP BY 1")
def closing_rates(spark, folder):
    return measures.rates(facts(spark, folder).withColumn("closed", F.col("t_invalid").isNotNull()), ["predicate"], "closed")


@query(
    """WITH v AS (SELECT subject_id, predicate, scope, count(*) AS c FROM (SELECT DISTINCT id, subject_id, predicate, scope FROM facts) WHERE scope IS NOT NULL GROUP BY ALL),
 g AS (SELECT subject_id, predicate, sum(c) AS votes, max(c) AS most FROM v GROUP BY ALL)
SELECT g.subject_id, g.predicate, min(v.scope) AS scope, any_value(votes)::BIGINT AS votes, round(1 - any_value(most) / any_value(votes), 9) AS flip_rate FROM g JOIN v ON v.subject_id = g.subject_id AND v.predicate = g.predicate AND v.c = g.most GROUP BY 1, 2"""
)
def scope_majorities(spark, folder):
    return measures.majority(facts(spark, folder), ["subject_id", "predicate"], "scope")


_TERMS = ("schema", "cache", "lock", "replica")


@query(
    f"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{Nd}}]+') AS l FROM documents), t AS (SELECT doc_id, len(l) AS n, unnest(l) AS term FROM w),
 f AS (SELECT doc_id, n, term, count(*) AS tf FROM t WHERE term IN {_TERMS} GROUP BY ALL), d AS (SELECT term, count(*) AS df FROM f GROUP BY 1)
SELECT doc_id, round(sum(tf / n * ln(1 + (SELECT count(*) FROM documents) / df)), 9) AS score FROM f JOIN d USING (term) GROUP BY 1"""
)
def tf_idf_scores(spark, folder):
    return measures.tf_idf(table(spark, folder, "documents"), list(_TERMS), id="doc_id", text="text")
