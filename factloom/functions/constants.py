"""Fixed values of the data model. Plain values that results depend on; everything that reads them takes them from here."""

DEFAULT_SCOPE = "project"
EPISTEMIC = ("observation", "commitment", "preference")
DEFAULT_CONFIDENCE = 0.8
DEFAULT_SOURCE = "user-assertion"

# Trust of a source type; unknown ones have TRUST_UNKNOWN.
TRUST = {"decision-record": 3, "user-assertion": 3, "code": 3, "session-log": 2, "failure-report": 2, "agent-note": 1, "inferred": 1}
TRUST_UNKNOWN = 2
TRUST_FULL = 3

# How far reinforcement may raise the confidence of a fact of that source type; unknown ones have CEILING_UNKNOWN.
CEILING = {"decision-record": 1.0, "code": 0.95, "user-assertion": 0.9, "session-log": 0.7, "agent-note": 0.65, "inferred": 0.6}
CEILING_UNKNOWN = 0.9

HALF_LIFE_DAYS = 90
CONFIDENCE_FLOOR = 0.05

# Rank fusion.
RRF_K = 60
ROUTE_WEIGHTS = {"text": 1.0, "entity": 1.2, "hop": 0.3}
STOPWORDS = (
    "the", "and", "for", "with", "into", "from", "that", "this", "does", "are", "was",
    "our", "not", "use", "uses", "using", "what", "which", "when", "where", "why",
    "how", "did", "should", "against", "about", "run", "add", "get", "all", "any",
)
MIN_TOKEN = 3

# Guided walk.
WALK_BUDGET, WALK_BEAM, WALK_ROUNDS = 25, 8, 6

# Admission of extracted candidates.
ADMIT_FLOOR, ADMIT_SUBJECT, ADMIT_LITERAL = 0.3, 80, 250
CLASS_WEIGHT = {"commitment": 1.0, "preference": 0.8}
CLASS_WEIGHT_OTHER = 0.5

DID_YOU_MEAN_DISTANCE, DID_YOU_MEAN_TOP = 5, 3
JUDGE_GATE = 0.8
SESSION_CAP, SESSION_DEFAULT = 0.7, 0.6
NOTES_CAP, NOTES_DEFAULT = 0.65, 0.55
ROSTER_LIMIT = 200
PROMOTE_USAGE, SUMMARY_CHARS, ENRICH_ENTITIES, ENRICH_ALIASES = 3, 600, 20, 3
CONTEXT_BUDGET, SUPERSESSION_DAYS, CONTEXT_FACTS = 25_000, 30, 50
COACH_SECTION = 3
EVIDENCE_LINES = 5
