"""Mixing sources to target weights, by budgets on a tree.

A mix is a tree: the mix, its domains, their languages, and at the leaves the sources as they occur in a domain and language. A source's target
share is spread over its leaves by their sizes, and inner weights are sums. The total size goes down the tree by weight; a leaf holds its
size times the allowed repeats, and what a subtree can't hold goes to its siblings first and only what they can't hold goes up to the
ancestors' siblings. A leaf's budget is drawn as whole epochs and a prefix of one more, each epoch in an order of its own seed.
"""

from __future__ import annotations

from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from factloom.plans.layout import cut


def fill(budget: float, weights: list[float], rooms: list[float]) -> list[float]:
    """Share ``budget`` among siblings by weight, none above its room; a shortage goes to the siblings that have room left, by weight."""
    given = [0.0] * len(weights)
    open_ = [i for i, r in enumerate(rooms) if r > 0 and weights[i] > 0]
    left = min(budget, sum(rooms[i] for i in open_))
    while open_ and left > 1e-9:
        total = sum(weights[i] for i in open_)
        full = [i for i in open_ if given[i] + left * weights[i] / total >= rooms[i]]
        if not full:
            for i in open_:
                given[i] += left * weights[i] / total
            break
        for i in full:
            left -= rooms[i] - given[i]
            given[i] = rooms[i]
        open_ = [i for i in open_ if i not in set(full)]
    return given


def budgets(leaves: list[tuple[tuple[str, ...], float, float]], total: float) -> list[float]:
    """The budget of every leaf. leaves: (path from the root, weight, room); what a node's children can't hold its siblings get."""

    def down(at: list[int], depth: int, budget: float) -> None:
        if depth == len(leaves[at[0]][0]):
            out[at[0]] = budget
            return
        children: dict[str, list[int]] = defaultdict(list)
        for i in at:
            children[leaves[i][0][depth]].append(i)
        groups = [children[c] for c in sorted(children)]
        shares = fill(budget, [sum(leaves[i][1] for i in g) for g in groups], [sum(leaves[i][2] for i in g if leaves[i][1] > 0) for g in groups])
        for g, share in zip(groups, shares, strict=True):
            down(g, depth + 1, share)

    out = [0.0] * len(leaves)
    if leaves:
        down(list(range(len(leaves))), 0, total)
    return out


def plan(leaf_sizes: pd.DataFrame, targets: pd.DataFrame, total: float | str) -> pd.DataFrame:
    """The budgets of one mix: leaf_sizes (domain, lang, source, tokens), targets (source, share, repeats); see :func:`mix`."""
    held = leaf_sizes[leaf_sizes.tokens > 0]
    by_source = held.groupby("source").tokens.sum()
    share = dict(zip(targets.source, targets.share, strict=True))
    repeats = dict(zip(targets.source, targets.repeats, strict=True))
    present = [s for s in share if s in by_source.index and share[s] > 0 and repeats[s] > 0]
    weight = sum(share[s] for s in present)
    if not present:
        return pd.DataFrame({"domain": [], "lang": [], "source": [], "tokens": [], "budget": []})
    if total == "met":  # the most that leaves every source that has documents at its share of those that have
        total = min(by_source[s] * repeats[s] * weight / share[s] for s in present)
    elif total == "all":
        total = sum(by_source[s] for s in present)
    rows = held[held.source.isin(present)].sort_values(["domain", "lang", "source"]).reset_index(drop=True)
    leaves = [((r.domain, r.lang, r.source), share[r.source] * r.tokens / by_source[r.source], float(r.tokens) * repeats[r.source]) for r in rows.itertuples()]
    return rows.assign(budget=budgets(leaves, float(total)))


def mix(
    documents: DataFrame, targets: DataFrame, *, id: str, source: str, lang: str, domain: str, size: str, mix_id: str, share: str, max_repeats: str,
    total_tokens: int | str, seed: int = 5, bucket_rows: int = 5000,
) -> DataFrame:
    """How often each mix uses each document: ``mix_id``, ``id``, ``source``, ``size``, ``uses``; documents of a mix's sources that it doesn't use have 0.

    The total of a mix is ``total_tokens``: a number, or "all" for as many as its sources hold, or "met" for the most at which every source of the mix that
    has documents reaches its share, which the scarcest source decides and which may leave most of the others unused. What sources can't hold at
    ``max_repeats`` uses is shared out: to sources of the same domain and language, then to other languages of the domain, then to other domains.
    The shares of sources without any documents go to the others by weight.

    A leaf with a budget of k times its size and more is used k times, and the rest of the budget is the prefix of a seeded order. What the prefixes of
    a source's leaves leave over, as documents are whole, goes to the next documents behind their ends that fit, then to those of further epochs.

    Skew: an order is cut into buckets by its hash, about ``bucket_rows`` documents each; bucket sums tell where the prefix ends, and only that one
    bucket is sorted, so a leaf with a third of all documents is no larger a task than another.

    Defined cases: null sources never match a target; null language or domain is a branch of its own; documents of null, zero or negative size
    are never used; a null or negative share or repeats counts as 0; targets that name a source twice count the first by share; repeated rows of a document are
    taken together as one; empty tables give no rows; other columns are ignored.
    """
    spark = documents.sparkSession
    docs = documents.select(F.col(id).alias("__id"), F.col(source).alias("source"), F.coalesce(F.col(lang), F.lit("")).alias("lang"), F.coalesce(F.col(domain), F.lit("")).alias("domain"), F.col(size).cast("bigint").alias("tokens"))
    docs = cut(docs.where("tokens > 0").dropna(subset=["__id", "source"]).dropDuplicates(["__id"]))
    goal = targets.select(F.col(mix_id).cast("string").alias("mix"), F.col(source).alias("source"), F.greatest(F.coalesce(share, F.lit(0.0)), F.lit(0.0)).alias("share"), F.greatest(F.coalesce(max_repeats, F.lit(0)), F.lit(0)).cast("int").alias("repeats"))
    goal = goal.dropna(subset=["mix", "source"]).groupBy("mix", "source").agg(F.max(F.struct("share", "repeats")).alias("x")).select("mix", "source", "x.*")
    sizes = docs.groupBy("domain", "lang", "source").agg(F.sum("tokens").alias("leaf_tokens"), F.count(F.lit(1)).alias("leaf_rows"))
    leaves = goal.join(sizes, "source")

    schema = "mix string, domain string, lang string, source string, repeats int, leaf_tokens bigint, leaf_rows bigint, budget double"

    def of_mix(rows: pd.DataFrame) -> pd.DataFrame:  # a row per leaf of one mix: as many as sources, languages and domains, not documents
        t = rows.drop_duplicates("source")[["source", "share", "repeats"]]
        got = plan(rows[["domain", "lang", "source", "leaf_tokens", "leaf_rows"]].rename(columns={"leaf_tokens": "tokens"}), t, total_tokens)
        got = got.rename(columns={"tokens": "leaf_tokens"})
        return got.assign(mix=rows.mix.iloc[0]).merge(t[["source", "repeats"]])[[c.split()[0] for c in schema.split(", ")]] if len(got) else pd.DataFrame({c.split()[0]: pd.Series(dtype="object") for c in schema.split(", ")})

    budget = cut(leaves.groupBy("mix").applyInPandas(of_mix, schema))
    counted = budget.count()
    leaf = ["mix", "domain", "lang", "source"]
    epochs = budget.withColumn("epochs", F.floor(F.col("budget") / F.col("leaf_tokens") + 1e-9)).withColumn("rest", F.greatest(F.lit(0.0), F.col("budget") - F.col("epochs") * F.col("leaf_tokens"))).withColumn("buckets", F.ceil(F.col("leaf_rows") / bucket_rows))
    epochs = F.broadcast(epochs) if counted <= 100_000 else epochs
    order = F.pmod(F.xxhash64(F.lit(seed), "mix", "epochs", "__id"), F.lit(1 << 40))
    drawn = docs.join(epochs, ["domain", "lang", "source"]).withColumn("order", order).withColumn("bucket", F.floor(F.col("order") * F.col("buckets") / float(1 << 40)))
    drawn = drawn.select(*leaf, "__id", "tokens", "repeats", "epochs", "rest", "order", "bucket")
    upto = W.partitionBy(*leaf).orderBy("bucket")
    sums = drawn.groupBy(*leaf, "rest", "bucket").agg(F.sum("tokens").alias("t")).withColumn("end", F.sum("t").over(upto)).withColumn("begin", F.col("end") - F.col("t"))
    edge = sums.where("begin < rest AND rest <= end OR end = 0").select(*leaf, F.col("bucket").alias("edge"), "begin")
    placed = drawn.join(edge, leaf, "left")  # a bucket per leaf; none where the leaf's rest is 0
    inner = W.partitionBy(*leaf).orderBy("order", "__id")
    at_edge = placed.where("bucket = edge").withColumn("after", F.col("begin") + F.sum("tokens").over(inner)).withColumn("before", F.col("after") - F.col("tokens"))

    def ends(rows: pd.DataFrame) -> pd.DataFrame:  # the buckets in which one source's prefixes end: some bucket_rows for each leaf
        rows = rows.sort_values(["domain", "lang", "order", "__id"])
        take = (rows.after <= rows.rest).to_numpy().astype(int)
        cuts = rows.groupby(["domain", "lang"]).agg(rest=("rest", "first"), begin=("begin", "first"))
        over = float((cuts.rest - cuts.begin).sum()) - float(rows.tokens[take > 0].sum())
        tokens, most = rows.tokens.to_numpy(), (rows.repeats - rows.epochs).to_numpy()
        for use in range(1, int(most.max()) + 1):  # the next documents of any leaf that fit what rounding left, then those of the next epochs
            for i in range(len(rows)):
                if take[i] < min(use, most[i]) and tokens[i] <= over:
                    take[i] += 1
                    over -= tokens[i]
        free = [i for i in range(len(rows)) if take[i] < most[i]]
        if free and tokens[best := min(free, key=lambda i: (tokens[i], i))] < 2 * over:
            take[best] += 1
        return rows.assign(more=take)[["mix", "__id", "source", "tokens", "epochs", "more"]]

    kept = T.StructType([placed.schema[c] for c in ("mix", "__id", "source", "tokens", "epochs")] + [T.StructField("more", T.IntegerType())])
    decided = at_edge.groupBy("mix", "source").applyInPandas(ends, kept)
    others = placed.where("edge IS NULL OR bucket <> edge").withColumn("more", F.coalesce((F.col("bucket") < F.col("edge")).cast("int"), F.lit(0)))
    used = others.select(kept.names).unionByName(decided)
    uses = (F.col("epochs") + F.col("more")).cast("int")
    return used.select(F.col("mix").alias(mix_id), F.col("__id").alias(id), F.col("source").alias(source), F.col("tokens").alias(size), uses.alias("uses"))


def shares(uses: DataFrame, targets: DataFrame, *, source: str, size: str, mix_id: str, share: str) -> DataFrame:
    """Per mix and targeted source: the target share and the share reached, tokens drawn, documents used, most uses of one, and tokens that no use draws.

    Sources without documents have 0 of all.
    """
    used = F.col("uses") > 0
    drawn = uses.groupBy(mix_id, source).agg(F.sum(F.col(size) * F.col("uses")).alias("tokens"), F.count_if(used).alias("documents"), F.max("uses").alias("most_uses"), F.sum(F.when(~used, F.col(size))).alias("unused_tokens"))
    total = drawn.groupBy(mix_id).agg(F.sum("tokens").alias("__all"))
    goal = targets.select(mix_id, source, share).dropDuplicates([mix_id, source])
    full = goal.join(drawn, [mix_id, source], "left").join(total, mix_id, "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    reached = F.when(F.col("__all") > 0, zero("tokens") / F.col("__all")).otherwise(0.0)
    return full.select(mix_id, source, F.col(share), F.round(reached, 6).alias("reached_share"), *map(zero, ("tokens", "documents", "most_uses", "unused_tokens")))
