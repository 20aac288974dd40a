"""Queries on facts and entities: reads, resolution, decisions, conflicts, graph and search. Each has its SQL beside it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import exprs as X
from factloom.operators import conflicts, decide, graph, reads, resolve, retrieval, supersession
from factloom.sources.tables import table

#: The instant that queries take for now.
NOW = "2026-06-01 00:00:00"
#: What the search queries look for.
QUERY = "flaky outbox corelink-platform"

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


def now():
    return X.at(NOW)


def facts(spark: SparkSession, folder: str) -> DataFrame:
    return reads.distinct_facts(table(spark, folder, "facts"))


def hydrated(spark: SparkSession, folder: str) -> DataFrame:
    return reads.hydrate(facts(spark, folder), table(spark, folder, "entities"))


def live(spark: SparkSession, folder: str) -> DataFrame:
    return hydrated(spark, folder).where(X.valid_at(now()))


_T = f"TIMESTAMPTZ '{NOW}+00'"
_TRUST = "CASE {0} WHEN 'decision-record' THEN 3 WHEN 'user-assertion' THEN 3 WHEN 'code' THEN 3 WHEN 'agent-note' THEN 1 WHEN 'inferred' THEN 1 ELSE 2 END"
_EFF = f"""CASE WHEN epistemic = 'commitment' OR source_type = 'decision-record' OR recorded_at IS NULL THEN confidence
  ELSE greatest(0.05, confidence * pow(0.5, greatest(0.0, (epoch_us({_T}) - epoch_us(greatest(recorded_at, last_reinforced_at))) / 7776000000000.0))) END"""
_NORM = "regexp_replace(lower({0}), '[\\s\\-_./]+', '', 'g')"
_CTE = f"""WITH f AS (SELECT DISTINCT * FROM facts),
 h AS (SELECT f.*, coalesce(s.name, f.subject_id) AS subject_name, CASE WHEN object_kind = 'entity' THEN coalesce(o.name, f.object_ref) ELSE object_lit END AS object_name
       FROM f LEFT JOIN entities s ON s.id = f.subject_id LEFT JOIN entities o ON o.id = f.object_ref),
 live AS (SELECT *, {_NORM.format("object_name")} AS norm_object FROM h WHERE t_valid <= {_T} AND (t_invalid IS NULL OR t_invalid > {_T}))
"""


# reads


@query(_CTE + "SELECT id, subject_id, predicate, object_name FROM live")
def facts_as_of(spark, folder):
    return live(spark, folder).select("id", "subject_id", "predicate", "object_name")


@query(_CTE + f"SELECT id, round({_EFF}, 6) AS effective FROM f")
def effective_confidence(spark, folder):
    return facts(spark, folder).select("id", F.round(X.effective_confidence(now()), 6).alias("effective"))


@query(_CTE + f"SELECT id, predicate, scope FROM live WHERE scope = 'project' AND {_EFF} >= 0.5")
def min_confidence(spark, folder):
    return reads.filter_facts(facts(spark, folder), now(), min_confidence=0.5, scope="project").select("id", "predicate", "scope")


@query(_CTE + "SELECT id, subject_name, predicate, object_kind, object_name, episode FROM h")
def fact_summaries(spark, folder):
    return hydrated(spark, folder).select("id", "subject_name", "predicate", "object_kind", "object_name", "episode")


@query(
    _CTE + """SELECT id, subject_id, predicate, row_number() OVER w AS version, epoch_us(lead(t_valid) OVER w)::VARCHAR AS next_us FROM f
WINDOW w AS (PARTITION BY subject_id, scope, predicate ORDER BY t_valid NULLS FIRST, recorded_at NULLS FIRST, id)"""
)
def fact_history(spark, folder):
    return reads.history(facts(spark, folder)).select("id", "subject_id", "predicate", "version", F.unix_micros("next_t_valid").cast("string").alias("next_us"))


@query(_CTE + "SELECT id, predicate FROM f WHERE subject_id IN (SELECT id FROM entities WHERE type = 'tool') OR object_ref IN (SELECT id FROM entities WHERE type = 'tool')")
def facts_touching(spark, folder):
    return reads.touching(facts(spark, folder), table(spark, folder, "entities").where("type = 'tool'")).select("id", "predicate")


@query(_CTE + "SELECT object_ref AS entity_id, predicate, count(DISTINCT subject_id) AS subjects FROM live WHERE object_ref IS NOT NULL GROUP BY ALL")
def reverse_lookup(spark, folder):
    f = facts(spark, folder).where(X.valid_at(now())).where("object_ref IS NOT NULL")
    return f.groupBy(F.col("object_ref").alias("entity_id"), "predicate").agg(F.count_distinct("subject_id").alias("subjects"))


@query(
    _CTE + """SELECT id FROM f WHERE source_type = 'session-log' AND predicate IN ('core/depends-on', 'core/prefers') AND scope IN ('project', 'external') AND t_invalid IS NULL
 AND recorded_at < TIMESTAMPTZ '2026-01-01 00:00:00+00' AND episode IN (SELECT id FROM episodes WHERE closed_at IS NOT NULL)"""
)
def select_facts(spark, folder):
    return reads.select_facts(
        facts(spark, folder), source_type="session-log", predicates=["core/depends-on", "core/prefers"], scopes=["project", "external"],
        episodes=table(spark, folder, "episodes").where("closed_at IS NOT NULL"), recorded_before=X.at("2026-01-01 00:00:00"), open_only=True,
    ).select("id")


@query(_CTE + ", u AS (SELECT predicate, count(*) AS n FROM f GROUP BY 1) SELECT p.id, p.status, coalesce(n, 0) AS n FROM predicates p LEFT JOIN u ON u.predicate = p.id")
def predicate_usage(spark, folder):
    used = reads.predicate_usage(facts(spark, folder)).withColumnRenamed("predicate", "id")
    return table(spark, folder, "predicates").select("id", "status").join(used, "id", "left").select("id", "status", F.coalesce("n", F.lit(0)).alias("n"))


@query(_CTE + "SELECT entity_id, count(*) AS n FROM (SELECT subject_id AS entity_id FROM f UNION ALL SELECT object_ref FROM f) WHERE entity_id IS NOT NULL GROUP BY 1")
def entity_usage(spark, folder):
    return reads.entity_usage(facts(spark, folder))


@query(
    _CTE + """SELECT 'entities' AS measure, count(*) AS n FROM entities UNION ALL SELECT 'episodes', count(*) FROM episodes UNION ALL SELECT 'facts', count(*) FROM f
UNION ALL SELECT 'facts-valid', count(*) FROM f WHERE t_invalid IS NULL UNION ALL SELECT 'facts-invalidated', count(*) FROM f WHERE t_invalid IS NOT NULL
UNION ALL SELECT 'predicates-' || coalesce(status, 'none'), count(*) FROM predicates GROUP BY status"""
)
def kg_stats(spark, folder):
    return reads.stats(table(spark, folder, "entities"), facts(spark, folder), table(spark, folder, "episodes"), table(spark, folder, "predicates"))


@query(
    _CTE + """SELECT e.id, CASE WHEN count(f.id) > 0 THEN 'close' ELSE 'skip-empty' END AS action, count(f.id) AS facts FROM episodes e LEFT JOIN f ON f.episode = e.id
WHERE e.closed_at IS NULL GROUP BY e.id"""
)
def episode_plan(spark, folder):
    return reads.episode_plan(table(spark, folder, "episodes"), facts(spark, folder))


@query(
    _CTE + """, c AS (SELECT episode, predicate, count(*) AS n FROM f WHERE episode IS NOT NULL GROUP BY 1, 2),
 p AS (SELECT episode, sum(n)::BIGINT AS facts, string_agg(n || ' ' || predicate, ', ' ORDER BY n DESC, predicate) AS parts FROM c GROUP BY 1)
SELECT episode, e.source_type || ' episode' || CASE WHEN e.ref IS NULL THEN '' ELSE ' (' || e.ref || ')' END || ': ' || facts || ' facts — ' || parts AS summary
FROM p JOIN episodes e ON e.id = p.episode"""
)
def mechanical_summary(spark, folder):
    return reads.mechanical_summary(table(spark, folder, "episodes"), facts(spark, folder))


@query(_CTE + "SELECT f.id, e.source_type AS episode_source, e.ref FROM f JOIN episodes e ON e.id = f.episode WHERE f.source_type IS DISTINCT FROM e.source_type")
def fact_provenance(spark, folder):
    e = table(spark, folder, "episodes").select(F.col("id").alias("episode"), F.col("source_type").alias("episode_source"), "ref")
    return facts(spark, folder).join(e, "episode").where("NOT (source_type <=> episode_source)").select("id", "episode_source", "ref")


# single-valued predicates in bulk, over the event stream: a user's status

_EVENTS = """WITH e AS (SELECT *, event_id % 7 AS s, least(value / 100, 1.0) AS confidence FROM events),
 r AS (SELECT *, CASE s WHEN 0 THEN 'decision-record' WHEN 1 THEN 'user-assertion' WHEN 2 THEN 'code' WHEN 3 THEN 'session-log' WHEN 4 THEN 'failure-report' WHEN 5 THEN 'agent-note' ELSE 'inferred' END AS source_type FROM e),
 n AS (SELECT *, CASE WHEN event_type IS NOT DISTINCT FROM lag(event_type) OVER w AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS new FROM r WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
 i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS run FROM n),
 k AS (SELECT *, CASE first_value(source_type) OVER w WHEN 'decision-record' THEN 1.0 WHEN 'code' THEN 0.95 WHEN 'session-log' THEN 0.7 WHEN 'agent-note' THEN 0.65 WHEN 'inferred' THEN 0.6 ELSE 0.9 END AS top,
   row_number() OVER w AS place FROM i WINDOW w AS (PARTITION BY user_id, run ORDER BY ts, event_id)),
 v AS (SELECT user_id, run, any_value(event_type) AS status, min(ts) AS t_valid, max(ts) AS last_reinforced_at, count(*) AS statements,
   greatest(max(CASE WHEN place = 1 THEN confidence END), max(CASE WHEN place > 1 THEN least(top, confidence) END)) AS confidence FROM k GROUP BY user_id, run),
 s AS (SELECT *, lead(t_valid) OVER (PARTITION BY user_id ORDER BY run) AS t_invalid FROM v)
"""


def statuses(spark, folder):
    source = F.element_at(F.array(*map(F.lit, ("decision-record", "user-assertion", "code", "session-log", "failure-report", "agent-note", "inferred"))), (F.col("event_id") % 7 + 1).cast("int"))
    return table(spark, folder, "events").select("user_id", "event_id", "ts", F.col("event_type").alias("status"), F.least(F.col("value") / 100, F.lit(1.0)).alias("confidence"), source.alias("source_type"))


def status_versions(spark, folder):
    return supersession.versions(statuses(spark, folder), keys=["user_id"], value="status", at="ts", order=["ts", "event_id"], confidence="confidence", source="source_type")


@query(_EVENTS + "SELECT user_id, status, t_valid, t_invalid FROM s")
def version_supersession(spark, folder):
    return status_versions(spark, folder).select("user_id", "status", "t_valid", "t_invalid")


@query(_EVENTS + "SELECT user_id, status, t_valid, last_reinforced_at, statements FROM s")
def reinforcement_islands(spark, folder):
    return status_versions(spark, folder).select("user_id", "status", "t_valid", "last_reinforced_at", "statements")


@query(_EVENTS + "SELECT user_id, run, round(confidence, 9) AS confidence FROM s")
def reinforced_base(spark, folder):
    return status_versions(spark, folder).select("user_id", "run", F.round("confidence", 9).alias("confidence"))


@query(_EVENTS + "SELECT user_id, status, t_valid FROM s WHERE t_valid <= TIMESTAMP '2024-01-15' AND (t_invalid IS NULL OR t_invalid > TIMESTAMP '2024-01-15')")
def status_as_of(spark, folder):
    return status_versions(spark, folder).where(X.valid_at(X.at("2024-01-15 00:00:00"))).select("user_id", "status", "t_valid")


# scalar rules


@query(
    _CTE + f"""SELECT source_type, {_TRUST.format("source_type")} AS trust,
 CASE source_type WHEN 'decision-record' THEN 1.0 WHEN 'code' THEN 0.95 WHEN 'session-log' THEN 0.7 WHEN 'agent-note' THEN 0.65 WHEN 'inferred' THEN 0.6 ELSE 0.9 END::DOUBLE AS ceiling, count(*) AS n
 FROM f GROUP BY 1, 2, 3"""
)
def trust_and_ceiling(spark, folder):
    s = F.col("source_type")
    return facts(spark, folder).groupBy("source_type").agg(F.count(F.lit(1)).alias("n")).select("source_type", X.trust(s).alias("trust"), X.ceiling(s).alias("ceiling"), "n")


@query("SELECT coalesce(on_conflict, CASE WHEN epistemic = 'commitment' THEN 'flag' ELSE 'supersede' END) AS policy, count(*) AS n FROM assertions GROUP BY 1")
def conflict_policy(spark, folder):
    policy = X.conflict_policy(F.col("epistemic"), F.lit(False), F.col("on_conflict"))
    return table(spark, folder, "assertions").groupBy(policy.alias("policy")).agg(F.count(F.lit(1)).alias("n"))


# names


@query(f"SELECT id, {_NORM.format('name')} AS normalized, coalesce(norm_name <> {_NORM.format('name')}, true) AS out_of_date FROM entities")
def normalize_names(spark, folder):
    n = X.norm_name(F.col("name"))
    return table(spark, folder, "entities").select("id", n.alias("normalized"), F.coalesce(F.col("norm_name") != n, F.lit(True)).alias("out_of_date"))


@query(
    f"""SELECT scope, {_NORM.format("name")} AS normalized, count(*) AS n, array_to_string(list_sort(list(id)), ' ') AS ids FROM entities WHERE name IS NOT NULL
GROUP BY 1, 2 HAVING count(*) > 1"""
)
def duplicate_clusters(spark, folder):
    return resolve.duplicate_clusters(table(spark, folder, "entities")).select("scope", "normalized", "n", F.array_join("ids", " ").alias("ids"))


@query("SELECT id, array_to_string(list_sort(list_distinct(list_prepend(name, coalesce(aliases, [])))), '|') AS names FROM entities WHERE len(list_distinct(list_prepend(name, coalesce(aliases, [])))) > 1")
def alias_clusters(spark, folder):
    return resolve.alias_clusters(table(spark, folder, "entities")).select("id", F.array_join("names", "|").alias("names"))


_NAMES = f"""WITH names AS (SELECT id, scope, type, name AS key, 0 AS kind FROM entities UNION SELECT id, scope, type, unnest(aliases), 1 FROM entities
   UNION SELECT id, scope, type, {_NORM.format("name")}, 2 FROM entities UNION SELECT id, scope, type, {_NORM.format("a")}, 2 FROM (SELECT id, scope, type, unnest(aliases) AS a FROM entities)),
 m AS (SELECT DISTINCT subject AS name, 'project' AS scope, subject_type AS type FROM assertions WHERE subject IS NOT NULL),
 x AS (SELECT m.name, m.scope, m.type, n.id, n.kind FROM m JOIN names n ON n.scope = m.scope AND ((n.kind < 2 AND n.key = m.name) OR (n.kind = 2 AND n.key = {_NORM.format("m.name")} AND (m.type IS NULL OR n.type IS NULL OR m.type = n.type)))),
 r AS (SELECT name, scope, type, min(id) FILTER (kind = 0) AS x0, min(id) FILTER (kind = 1) AS x1, min(id) FILTER (kind = 2) AS x2, count(DISTINCT id) FILTER (kind = 2) AS n2 FROM x GROUP BY ALL),
 z AS (SELECT m.name, m.scope, m.type, coalesce(x0, x1, CASE WHEN n2 = 1 THEN x2 END) AS entity_id, coalesce(n2, 0) AS candidates,
   CASE WHEN x0 IS NOT NULL THEN 'exact' WHEN x1 IS NOT NULL THEN 'alias' WHEN n2 = 1 THEN 'normalized' WHEN n2 > 1 THEN 'ambiguous' ELSE 'none' END AS via
   FROM m LEFT JOIN r ON r.name = m.name AND r.scope = m.scope AND r.type IS NOT DISTINCT FROM m.type)
"""


def mentions(spark, folder):
    return table(spark, folder, "assertions").where("subject IS NOT NULL").select("seq", F.col("subject").alias("name"), F.lit("project").alias("scope"), F.col("subject_type").alias("type"))


@query(_NAMES + "SELECT name, scope, type, entity_id, via, candidates FROM z")
def resolve_mentions(spark, folder):
    return resolve.resolve(mentions(spark, folder), table(spark, folder, "entities"))


@query(
    _NAMES + f""", w AS (SELECT a.seq, z.name, {_NORM.format("z.name")} AS norm_name FROM assertions a JOIN z ON z.name = a.subject AND z.type IS NOT DISTINCT FROM a.subject_type WHERE via = 'none')
SELECT norm_name, arg_min(name, seq) AS name, count(DISTINCT name) - 1 AS aliases FROM w GROUP BY 1"""
)
def minted_entities(spark, folder):
    new, _ = resolve.ensure(mentions(spark, folder), table(spark, folder, "entities"))
    return new.select("norm_name", "name", F.size("aliases").cast("bigint").alias("aliases"))


@query(_NAMES + "SELECT DISTINCT entity_id, name AS alias FROM z WHERE via = 'normalized'")
def healed_aliases(spark, folder):
    return resolve.ensure(mentions(spark, folder), table(spark, folder, "entities"))[1]


_RAW = "regexp_replace(nullif(regexp_replace(trim(predicate), '^:', ''), ''), '_', '-', 'g')"
_PRED = f"""WITH t AS (SELECT DISTINCT predicate FROM assertions), r AS (SELECT predicate, CASE WHEN contains({_RAW}, '/') THEN {_RAW} ELSE 'core/' || {_RAW} END AS raw FROM t),
 v AS (SELECT r.predicate, coalesce(p.id, raw) AS id, p.status, CASE WHEN p.status = 'deprecated' THEN 'deprecated-predicate' WHEN p.id IS NOT NULL THEN 'ok' WHEN starts_with(raw, 'x/') THEN 'register' ELSE 'unknown-predicate' END AS verdict
   FROM r LEFT JOIN predicates p ON p.id = r.raw)
"""


@query(_PRED + "SELECT predicate, id, status, verdict FROM v")
def predicate_check(spark, folder):
    return resolve.resolve_predicates(table(spark, folder, "assertions"), table(spark, folder, "predicates")).select("predicate", "id", "status", "verdict")


@query(
    _PRED + """, u AS (SELECT v.id AS predicate, p.id AS suggestion, levenshtein(split_part(v.id, '/', -1), split_part(p.id, '/', -1)) AS distance FROM (SELECT DISTINCT id FROM v WHERE verdict = 'unknown-predicate') v, predicates p)
SELECT predicate, suggestion, distance, row_number() OVER (PARTITION BY predicate ORDER BY distance, suggestion) AS place FROM u WHERE distance <= 5 QUALIFY place <= 3"""
)
def did_you_mean(spark, folder):
    checked = resolve.resolve_predicates(table(spark, folder, "assertions"), table(spark, folder, "predicates"))
    unknown = checked.where("verdict = 'unknown-predicate'").select(F.col("id").alias("predicate"))
    return resolve.did_you_mean(unknown, table(spark, folder, "predicates"))


# merging


@query(
    _CTE + f""", d AS (SELECT scope, type, left({_NORM.format("name")}, 3) AS n, min(id) AS keep FROM entities WHERE name IS NOT NULL GROUP BY ALL HAVING count(*) > 1),
 m AS (SELECT e.id AS old, keep AS new FROM entities e JOIN d ON d.scope = e.scope AND d.type = e.type AND d.n = left({_NORM.format("e.name")}, 3) WHERE e.id <> keep)
SELECT f.id, coalesce(s.new, f.subject_id) AS subject_id, coalesce(o.new, f.object_ref) AS object_ref FROM f LEFT JOIN m s ON s.old = f.subject_id LEFT JOIN m o ON o.old = f.object_ref
WHERE s.new IS NOT NULL OR o.new IS NOT NULL"""
)
def merge_repoint(spark, folder):
    e = table(spark, folder, "entities").where("name IS NOT NULL AND type IS NOT NULL").withColumn("n", F.left(X.norm_name(F.col("name")), F.lit(3)))
    keep = e.groupBy("scope", "type", "n").agg(F.min("id").alias("new"))
    merges = e.join(keep, ["scope", "type", "n"]).select(F.col("id").alias("old"), "new").where("old <> new")
    return resolve.repoint(facts(spark, folder), resolve.merge_map(merges)).where("touched").select("id", "subject_id", "object_ref")


@query(
    _CTE + """, k AS (SELECT id, first_value(id) OVER (PARTITION BY subject_id, predicate, object_kind, CASE WHEN object_kind = 'entity' THEN object_ref ELSE object_lit END, scope, epistemic ORDER BY recorded_at, id) AS keep_id
  FROM live WHERE recorded_at IS NOT NULL) SELECT id, keep_id FROM k WHERE id <> keep_id"""
)
def collapse_duplicates(spark, folder):
    return conflicts.collapse_plan(facts(spark, folder).where("recorded_at IS NOT NULL"), now())



# conflicts

#: The instant for stances: the end of the event stream.
LATER = "2024-02-01 00:00:00"


def stances(spark, folder) -> DataFrame:
    """Stance facts of the event stream: purchases prefer, errors decide against, clicks depend on the thing that props name."""
    e = table(spark, folder, "events").where("event_type IN ('purchase', 'error', 'click')")
    kind = F.col("event_type")
    source = F.element_at(F.array(*map(F.lit, ("decision-record", "user-assertion", "code", "session-log", "failure-report", "agent-note", "inferred"))), (F.col("event_id") % 7 + 1).cast("int"))
    return e.select(
        F.concat(F.lit("v-"), F.lpad(F.col("event_id").cast("string"), 9, "0")).alias("id"), F.col("user_id").cast("string").alias("subject_id"),
        F.when(kind == "purchase", "core/prefers").when(kind == "error", "core/decided-against").otherwise("core/depends-on").alias("predicate"), F.lit("literal").alias("object_kind"), F.lit(None).cast("string").alias("object_ref"),
        F.concat(F.when(kind == "click", "Part K_").otherwise("part-k"), F.get_json_object("props", "$.k")).alias("object_lit"), F.when(kind == "error", "commitment").otherwise("observation").alias("epistemic"), source.alias("source_type"),
        F.col("ts").alias("t_valid"), F.when(F.col("event_id") % 5 == 0, F.col("ts") + F.expr("INTERVAL 10 DAYS")).alias("t_invalid"), F.col("ts").alias("recorded_at"),
    ).withColumn("object_name", F.col("object_lit"))


def live_stances(spark, folder) -> DataFrame:
    return stances(spark, folder).where(X.valid_at(X.at(LATER)))


_STANCES = f"""WITH f AS (SELECT 'v-' || lpad(event_id::VARCHAR, 9, '0') AS id, user_id::VARCHAR AS subject_id, CASE event_type WHEN 'purchase' THEN 'core/prefers' WHEN 'error' THEN 'core/decided-against' ELSE 'core/depends-on' END AS predicate,
   (CASE event_type WHEN 'click' THEN 'Part K_' ELSE 'part-k' END) || json_extract_string(props, '$.k') AS object_lit, ts AS t_valid, CASE WHEN event_id % 5 = 0 THEN ts + INTERVAL 10 DAYS END AS t_invalid, ts AS recorded_at
   FROM events WHERE event_type IN ('purchase', 'error', 'click')),
 live AS (SELECT *, {_NORM.format("object_lit")} AS norm_object FROM f WHERE t_valid <= TIMESTAMP '{LATER}' AND (t_invalid IS NULL OR t_invalid > TIMESTAMP '{LATER}'))
"""
_PAIR_CTE = """, excl AS (SELECT a.id AS a, b.id AS b, a.recorded_at AS ra, b.recorded_at AS rb FROM live a JOIN live b ON a.subject_id = b.subject_id AND a.predicate = b.predicate AND a.id < b.id
   WHERE a.predicate IN (SELECT id FROM predicates WHERE value_exclusivity = 'exclusive')),
 crss AS (SELECT a.id AS a, b.id AS b, a.recorded_at AS ra, b.recorded_at AS rb FROM live a JOIN live b ON a.subject_id = b.subject_id AND a.norm_object = b.norm_object AND a.predicate <> b.predicate AND a.id < b.id
   WHERE a.predicate IN (SELECT id FROM predicates WHERE category = 'decision') OR b.predicate IN (SELECT id FROM predicates WHERE category = 'decision')),
 stnc AS (SELECT a.id AS a, b.id AS b, a.recorded_at AS ra, b.recorded_at AS rb FROM live a JOIN live b ON a.subject_id = b.subject_id AND a.norm_object = b.norm_object AND a.predicate <> b.predicate AND a.id < b.id
   JOIN predicates p ON p.id = a.predicate JOIN predicates q ON q.id = b.predicate WHERE p.exclusion_group = q.exclusion_group)
"""
_PAIRS = _CTE + _PAIR_CTE
_STANCE_PAIRS = _STANCES + _PAIR_CTE


def _newer(source: str, more: str = "") -> str:
    newer = "coalesce(ra, '0001-01-01'::TIMESTAMPTZ) > coalesce(rb, '0001-01-01'::TIMESTAMPTZ) OR (ra IS NOT DISTINCT FROM rb AND a >= b)"
    return f"SELECT CASE WHEN {newer} THEN a ELSE b END AS fact_id, CASE WHEN {newer} THEN b ELSE a END AS candidate_id{more} FROM {source}"


@query(_PAIRS + _newer("excl"))
def exclusive_values(spark, folder):
    return conflicts.exclusive_values(live(spark, folder), table(spark, folder, "predicates"))


@query(
    _CTE + """, x AS (SELECT id, count(*) OVER w - 1 AS rivals, list(id ORDER BY recorded_at DESC NULLS LAST, id DESC) OVER (PARTITION BY subject_id, predicate) AS ids FROM live
  WHERE predicate IN (SELECT id FROM predicates WHERE value_exclusivity = 'exclusive') WINDOW w AS (PARTITION BY subject_id, predicate))
SELECT id, rivals, CASE WHEN ids[1] = id THEN ids[2] ELSE ids[1] END AS newest_rival FROM x WHERE rivals > 0"""
)
def rival_counts(spark, folder):
    return conflicts.rival_counts(live(spark, folder), table(spark, folder, "predicates"))


@query(_STANCE_PAIRS + _newer("crss"))
def cross_predicate_pairs(spark, folder):
    return conflicts.cross_predicate(live_stances(spark, folder), table(spark, folder, "predicates"))


@query(_STANCE_PAIRS + _newer("stnc"))
def stance_conflicts(spark, folder):
    return conflicts.stance_conflicts(live_stances(spark, folder), table(spark, folder, "predicates"))


@query(
    _STANCE_PAIRS + f""", l AS ({_newer("stnc")}), c AS ({_newer("excl", ", 'exclusive-values' AS reason")} UNION ALL {_newer("crss", ", 'cross-predicate' AS reason")})
SELECT fact_id, candidate_id, max(reason) AS reason FROM c WHERE NOT EXISTS (SELECT 1 FROM l WHERE (l.fact_id = c.fact_id AND l.candidate_id = c.candidate_id) OR (l.fact_id = c.candidate_id AND l.candidate_id = c.fact_id)) GROUP BY 1, 2"""
)
def conflict_candidates(spark, folder):
    l, p = live_stances(spark, folder), table(spark, folder, "predicates")
    return conflicts.candidates(l, p, conflicts.stance_conflicts(l, p))


def stance_links(spark, folder):
    """The conflict links that the stances of mid-January give rise to."""
    then = stances(spark, folder).where(X.valid_at(X.at("2024-01-15 00:00:00")))
    return conflicts.stance_conflicts(then, table(spark, folder, "predicates"))


_LINKS = _STANCE_PAIRS.replace(LATER, "2024-01-15 00:00:00") + f", links AS ({_newer('stnc')}), cur AS (SELECT * FROM f WHERE t_valid <= TIMESTAMP '{LATER}' AND (t_invalid IS NULL OR t_invalid > TIMESTAMP '{LATER}'))"


@query(_LINKS + " SELECT fact_id, candidate_id FROM links WHERE fact_id IN (SELECT id FROM cur) AND candidate_id IN (SELECT id FROM cur)")
def open_conflicts(spark, folder):
    return conflicts.open_conflicts(stances(spark, folder), stance_links(spark, folder), X.at(LATER))


@query(_LINKS + " SELECT id, predicate FROM cur WHERE id NOT IN (SELECT fact_id FROM links)")
def undisputed_current(spark, folder):
    return conflicts.undisputed(live_stances(spark, folder), stance_links(spark, folder)).select("id", "predicate")


_OBJ = "CASE WHEN object_kind = 'entity' THEN object_ref ELSE object_lit END"


@query(
    _CTE + f""", k AS (SELECT *, {_OBJ} AS o, coalesce(t_valid <= {_T} AND (t_invalid IS NULL OR t_invalid > {_T}), false) AS alive FROM f),
 g AS (SELECT subject_id, predicate, object_kind, o, count(*) FILTER (alive) AS ln, count(*) FILTER (NOT alive) AS dn FROM k GROUP BY ALL), a AS (SELECT subject_id, predicate, count(*) AS n FROM k WHERE alive GROUP BY ALL)
SELECT k.id, a.n - g.ln AS rivals FROM k JOIN g USING (subject_id, predicate, object_kind, o) JOIN a USING (subject_id, predicate)
WHERE k.alive AND dn > 0 AND a.n > ln AND {_TRUST.format("source_type")} < 3"""
)
def revenants(spark, folder):
    return conflicts.revenants(facts(spark, folder), now())


@query(
    _CTE + f""", k AS (SELECT id, first_value(id) OVER (PARTITION BY subject_id, predicate, object_kind, {_OBJ} ORDER BY recorded_at NULLS FIRST, id) AS existing_id FROM live)
SELECT id, existing_id FROM k WHERE id <> existing_id"""
)
def existing_duplicates(spark, folder):
    return conflicts.repeated_live(facts(spark, folder), now())


@query(
    _CTE + f""", k AS (SELECT id, object_kind, {_OBJ} AS o, epistemic, t_valid, {_TRUST.format("source_type")} AS tr, lag(id) OVER w AS p_id, lag(object_kind) OVER w AS pk, lag({_OBJ}) OVER w AS po, lag(t_valid) OVER w AS pt,
   lag({_TRUST.format("source_type")}) OVER w AS ptr, lag(epistemic) OVER w AS pe FROM f WHERE recorded_at IS NOT NULL AND t_valid IS NOT NULL AND predicate IN (SELECT id FROM predicates WHERE cardinality = 'one')
   WINDOW w AS (PARTITION BY subject_id, scope, predicate ORDER BY recorded_at, id)),
 j AS (SELECT *, object_kind IS NOT DISTINCT FROM pk AND o IS NOT DISTINCT FROM po AS same, coalesce(epistemic = 'commitment', false) OR coalesce(pe = 'commitment', false) AS com FROM k WHERE p_id IS NOT NULL)
SELECT id, p_id AS previous_id, CASE WHEN same THEN 'reinforce' WHEN com OR pt > t_valid OR ptr > tr THEN 'flag' ELSE 'supersede' END AS action,
 CASE WHEN same OR com THEN NULL WHEN pt > t_valid THEN 'backdated-overlap' WHEN ptr > tr THEN 'outranked' END AS reason FROM j"""
)
def decide_action(spark, folder):
    return conflicts.flag_reasons(facts(spark, folder), table(spark, folder, "predicates"))


@query(
    _STANCE_PAIRS + f""", c AS ({_newer("crss")}), d AS (SELECT *, right(fact_id, 6)::BIGINT AS n FROM c),
 v AS (SELECT *, CASE n % 6 WHEN 0 THEN 'contradicts' WHEN 1 THEN 'duplicate' WHEN 2 THEN 'supersedes' WHEN 3 THEN 'compatible' WHEN 4 THEN 'maybe' END AS relation, (n % 10) / 10.0 AS confidence FROM d),
 a AS (SELECT *, CASE WHEN relation = 'contradicts' THEN 'needs-human' WHEN relation IS NULL OR relation = 'maybe' THEN 'unparseable' WHEN confidence < 0.8 THEN 'low-confidence' WHEN relation = 'duplicate' THEN 'invalidate-newer'
   WHEN relation = 'supersedes' THEN 'invalidate-older' ELSE 'unlink' END AS action FROM v)
SELECT fact_id, candidate_id, action, CASE action WHEN 'invalidate-newer' THEN fact_id WHEN 'invalidate-older' THEN candidate_id END AS target_id FROM a"""
)
def resolution_plan(spark, folder):
    pairs = conflicts.cross_predicate(live_stances(spark, folder), table(spark, folder, "predicates"))
    n = F.right("fact_id", F.lit(6)).cast("bigint")
    relation = F.when(n % 6 == 0, "contradicts").when(n % 6 == 1, "duplicate").when(n % 6 == 2, "supersedes").when(n % 6 == 3, "compatible").when(n % 6 == 4, "maybe")
    return conflicts.resolution_plan(pairs.withColumns({"relation": relation, "confidence": (n % 10) / 10.0}))


# decisions in order: no SQL, tested against the decision table and the closed form


@query()
def assert_decisions(spark, folder):
    """The decision on every assertion."""
    done = decide.assert_batch(table(spark, folder, "assertions"), table(spark, folder, "predicates"), now())
    return done.select("seq", "status", "fact_id", F.array_join("targets", " ").alias("targets"), "effective_at", "reason", "confidence")


@query()
def assert_counts(spark, folder):
    """How many assertions were created, reinforced, superseding, flagged and wrong."""
    done = decide.assert_batch(table(spark, folder, "assertions"), table(spark, folder, "predicates"), now())
    return done.groupBy("status", "reason").agg(F.count(F.lit(1)).alias("n"))


# graph

_GRAPH = """WITH RECURSIVE g AS (SELECT DISTINCT id, subject_id, predicate, object_ref FROM facts WHERE object_kind = 'entity' AND subject_id IS NOT NULL AND object_ref IS NOT NULL),
 u AS (SELECT subject_id AS a, object_ref AS b FROM g UNION SELECT object_ref, subject_id FROM g),
 root AS (SELECT id FROM entities WHERE type = 'tool' AND scope = 'external'),
 d1 AS (SELECT DISTINCT b AS entity_id FROM u WHERE a IN (SELECT id FROM root)), d2 AS (SELECT DISTINCT b AS entity_id FROM u WHERE a IN (SELECT entity_id FROM d1)),
 x AS (SELECT id AS entity_id, 0 AS depth FROM root UNION ALL SELECT entity_id, 1 FROM d1 UNION ALL SELECT entity_id, 2 FROM d2)
"""


def roots(spark, folder):
    return table(spark, folder, "entities").where("type = 'tool' AND scope = 'external'").select("id")


@query(_GRAPH + "SELECT entity_id, min(depth) AS depth FROM x WHERE depth < 2 GROUP BY 1")
def bfs_1hop(spark, folder):
    return graph.neighborhood(table(spark, folder, "facts"), roots(spark, folder), 1)[0]


@query(_GRAPH + "SELECT entity_id, min(depth) AS depth FROM x GROUP BY 1")
def bfs_2hop(spark, folder):
    return graph.neighborhood(table(spark, folder, "facts"), roots(spark, folder), 2)[0]


@query(_GRAPH + "SELECT predicate, count(*) AS edges FROM g WHERE subject_id IN (SELECT entity_id FROM x WHERE depth < 2) OR object_ref IN (SELECT entity_id FROM x WHERE depth < 2) GROUP BY 1")
def neighborhood_edges(spark, folder):
    return graph.neighborhood(table(spark, folder, "facts"), roots(spark, folder), 2)[1].groupBy("predicate").agg(F.count(F.lit(1)).alias("edges"))


@query()
def guided_walk(spark, folder):
    """The facts a guided walk from the hot entity collects."""
    start = table(spark, folder, "entities").where("id = 'e-000000000'").select("id")
    return graph.guided_walk(hydrated(spark, folder), start, retrieval.tokens_of(spark, QUERY), now()).select("id", F.round("score", 6).alias("score"))


# search

_TOKENS = """list_filter(list_transform(regexp_split_to_array({0}, '\\s+'), lambda w: regexp_replace(w, '^[^[:alnum:]]+|[^[:alnum:]]+$', '', 'g')), lambda w: length(w) >= 3 AND lower(w) NOT IN
 ('the','and','for','with','into','from','that','this','does','are','was','our','not','use','uses','using','what','which','when','where','why','how','did','should','against','about','run','add','get','all','any'))"""


@query(f"SELECT doc_id, len(list_distinct({_TOKENS.format("coalesce(text, '')")})) AS tokens FROM documents")
def query_tokens(spark, folder):
    return table(spark, folder, "documents").select("doc_id", F.size(X.query_tokens(F.col("text"))).cast("bigint").alias("tokens"))


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'superseded what')")
def fts_documents(spark, folder):
    return retrieval.text_hits(table(spark, folder, "documents").select(F.col("doc_id").alias("id"), "text"), [F.col("text")], ["superseded what"]).select(F.col("id").alias("doc_id"))


@query(
    _CTE + """SELECT 'fact' AS what, id FROM f WHERE contains(lower(object_lit), 'outbox') UNION SELECT 'episode', id FROM episodes WHERE contains(lower(summary), 'outbox')
UNION SELECT 'entity', id FROM entities WHERE contains(lower(name), 'outbox') OR len(list_filter(aliases, lambda a: contains(lower(a), 'outbox'))) > 0"""
)
def full_text(spark, folder):
    hit = lambda what, df, cols: retrieval.text_hits(df, cols, ["outbox"]).select(F.lit(what).alias("what"), "id")
    aliases = F.array_join("aliases", "\n")
    return (
        hit("fact", facts(spark, folder), [F.col("object_lit")]).unionByName(hit("episode", table(spark, folder, "episodes"), [F.col("summary")])).unionByName(hit("entity", table(spark, folder, "entities"), [F.col("name"), aliases]))
    )


_SEARCH = _CTE + f""", terms AS (SELECT unnest(['{QUERY}', 'flaky', 'outbox', 'corelink-platform']) AS term, unnest([0, 1, 2, 3]) AS place),
 txt AS (SELECT f.id, min(place) AS key FROM f JOIN terms ON contains(lower(object_lit), lower(term)) GROUP BY 1),
 nm AS (SELECT id, name AS key, 0 AS kind, type FROM entities WHERE scope = 'project' UNION SELECT id, unnest(aliases), 1, type FROM entities WHERE scope = 'project' UNION SELECT id, {_NORM.format("name")}, 2, type FROM entities WHERE scope = 'project'
   UNION SELECT id, {_NORM.format("a")}, 2, type FROM (SELECT id, type, unnest(aliases) AS a FROM entities WHERE scope = 'project')),
 rs AS (SELECT term, min(id) FILTER (kind = 0) AS x0, min(id) FILTER (kind = 1) AS x1, min(id) FILTER (kind = 2) AS x2, count(DISTINCT id) FILTER (kind = 2) AS n2 FROM terms JOIN nm ON (kind < 2 AND key = term) OR (kind = 2 AND key = {_NORM.format("term")}) GROUP BY 1),
 en AS (SELECT DISTINCT coalesce(x0, x1, CASE WHEN n2 = 1 THEN x2 END) AS id FROM rs WHERE coalesce(x0, x1, CASE WHEN n2 = 1 THEN x2 END) IS NOT NULL),
 ef AS (SELECT *, {_EFF} AS eff FROM f), near AS (SELECT * FROM ef WHERE subject_id IN (SELECT id FROM en) OR object_ref IN (SELECT id FROM en)),
 ends AS (SELECT subject_id AS id FROM near UNION SELECT object_ref FROM near), hop AS (SELECT * FROM ef WHERE subject_id IN (SELECT id FROM ends WHERE id NOT IN (SELECT id FROM en))),
 rk AS (SELECT id, 1.0 AS w, row_number() OVER (ORDER BY key, id) AS rank FROM txt UNION ALL SELECT id, 1.2, row_number() OVER (ORDER BY -eff NULLS FIRST, id) FROM near UNION ALL SELECT id, 0.3, row_number() OVER (ORDER BY -eff NULLS FIRST, id) FROM hop),
 rrf AS (SELECT id, sum(w / (60 + rank)) AS rrf FROM rk GROUP BY 1),
 found AS (SELECT id, rrf * eff AS score FROM rrf JOIN ef USING (id) WHERE t_valid <= {_T} AND (t_invalid IS NULL OR t_invalid > {_T}))
"""


def found(spark, folder):
    return retrieval.search(QUERY, facts(spark, folder), table(spark, folder, "entities"), now())


@query(_SEARCH + "SELECT id, round(score, 8) AS score FROM found")
def rrf_search(spark, folder):
    return found(spark, folder).select("id", F.round("score", 8).alias("score"))


@query(_SEARCH + "SELECT CASE WHEN count(*) > 0 THEN 'facts' ELSE 'nothing' END AS tier, count(*) AS n FROM found")
def recall_tier(spark, folder):
    tier, rows = retrieval.recall(QUERY, facts(spark, folder), table(spark, folder, "entities"), table(spark, folder, "episodes"), now())
    return rows.agg(F.lit(tier).alias("tier"), F.count(F.lit(1)).alias("n"))


@query(
    """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL),
 h AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS place FROM l WHERE contains(lower(line), 'outbox') OR contains(lower(line), 'flaky'))
SELECT doc_id, place, line FROM h WHERE place < 5"""
)
def evidence_lines(spark, folder):
    return retrieval.evidence_lines(table(spark, folder, "documents"), ["outbox", "flaky"], id="doc_id", text="text")


@query()
def coach_gate(spark, folder):
    """What a task about the query should be told."""
    held, registry = live(spark, folder), table(spark, folder, "predicates")
    pairs = conflicts.exclusive_values(held, registry)
    terms = [QUERY, *retrieval.tokens_of(spark, QUERY)]
    return retrieval.coach(found(spark, folder), facts(spark, folder), pairs, retrieval.find_entities(table(spark, folder, "entities"), terms))
