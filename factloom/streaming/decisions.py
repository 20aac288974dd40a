"""Deciding a stream of assertions: the same rules as in batches, with each subject's live facts as keyed state."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import astuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.operators.decide import Fact, Subject, predicate_rules, prepare

OUT = "seq bigint, status string, fact_id string, targets array<string>, effective_at bigint, reason string, confidence double"


def dump_state(s: Subject) -> str:
    """A subject's live facts and dead objects as text. History is in the sink; state grows with distinct objects only."""
    live = [astuple(f) for facts in s.live.values() for f in facts.values()]
    return json.dumps({"live": live, "dead": [[p, sorted(map(list, objects))] for p, objects in s.dead.items()]})


def load_state(text: str | None, now: int, single: set[str], mates: dict[str, set[str]]) -> Subject:
    s = Subject(now, single, mates)
    if text:
        held = json.loads(text)
        for id_, predicate, obj, *rest in held["live"]:
            s.hold(Fact(id_, predicate, tuple(obj), *rest))
        for predicate, objects in held["dead"]:
            s.dead.setdefault(predicate, set()).update(tuple(o) for o in objects)
    return s


def decide_stream(assertions: DataFrame, registry: DataFrame, now: Column) -> DataFrame:
    """The decisions on a stream of assertions with unique, rising ``seq``; columns as :func:`factloom.operators.decide.assert_batch`, ``effective_at`` in microseconds.

    Rows of one subject and predicate group are decided in order of seq within each micro-batch, on top of what earlier ones left. Rows with errors come out with
    status ``error``. State is kept for good, since facts never expire by themselves.
    """
    single, mates = predicate_rules(registry)
    rows = prepare(assertions, registry, now).withColumns({"t_valid": F.unix_micros("t_valid"), "t_invalid": F.unix_micros("t_invalid"), "now": F.unix_micros(now)})

    def decide(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(frames)).sort_values("seq").astype(object)
        batch = batch.where(batch.notna(), None)
        subject, out = None, []
        for r in batch.itertuples(index=False):
            if r.error is not None:
                out.append((r.seq, "error", None, [], None, r.error, None))
                continue
            if subject is None:
                subject = load_state(state.get[0] if state.exists else None, int(r.now), single, mates)
            fact = Fact(f"f-{r.seq}", r.predicate, (r.object_kind, r.object_key), r.loose, int(r.t_valid), None if r.t_invalid is None else int(r.t_invalid), r.confidence, r.epistemic, r.source_type)
            d = subject.decide(fact, r.on_conflict)
            again = d.action == "reinforce"
            out.append((r.seq, d.action, d.targets[0] if again else fact.id, [] if again else d.targets, d.effective_at, d.reason, d.confidence))
        if subject is not None:
            state.update((dump_state(subject),))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])

    keyed = rows.withColumns({"subject_key": F.coalesce("subject_key", F.lit("")), "group": F.coalesce("group", F.lit(""))})
    return keyed.groupBy("subject_key", "group").applyInPandasWithState(decide, OUT, "held string", "append", "NoTimeout")
