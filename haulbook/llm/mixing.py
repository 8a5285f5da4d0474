"""Mixing sources to target weights by hierarchical budgeting.

The leaves of a tree (by default domain, language, source) hold documents. A token budget goes down the tree: every node
shares its budget among its children by weight, no child getting more than what lies below it in the permitted number of
epochs; what a child cannot use is shared among its siblings, and only what a whole subtree cannot use goes to the
siblings of its root. Each leaf then gives whole epochs and, of one more epoch in seeded order, the longest prefix
that its budget holds.

The prefix is found without sorting a leaf: tokens are summed by the first bits of the position, then within the
decisive range by the next bits, and only the few documents of the last range are put in order. Every step is an aggregation
over all leaves at once, whatever the size of the largest.

Defined results: a null level counts as the empty name; null and empty texts have no tokens and come with the
positions before the cut; rows alike in id and text have one position and are taken together or not at all; a
weight of zero takes nothing; an empty table gives an empty result; other columns pass through, and those named like
the new ones are replaced.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haulbook.llm.common import stored, text_of, unused, words_of

LEVELS = ("domain", "lang", "source")
SEED = 42

#: Bits of a position, and bits that one narrowing step looks at.
POSITION_BITS, STEP_BITS = 60, 8


def named(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def token_count(text: Column) -> Column:
    return F.size(words_of(text)).cast("long")


def identity(docs: DataFrame) -> Column:
    """What a row's positions derive from: its id and whole text."""
    return F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), text_of("text")))


def position(key: Column, epoch: Column, seed: int = SEED) -> Column:
    """A row's place in an epoch, a number of 60 bits."""
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), key)), 1, POSITION_BITS // 4)
    return F.conv(digits, 16, 10).cast("long")


def weight(level: str, weights: Mapping[str, Mapping[str, float]]) -> Column:
    """Weight of a node among its siblings; names without a weight have 1."""
    known = weights.get(level)
    if not known:
        return F.lit(1.0)
    entries = [item for name, value in known.items() for item in (F.lit(name), F.lit(float(value)))]
    return F.coalesce(F.element_at(F.create_map(*entries), F.col(level)), F.lit(1.0))


def shared_out(nodes: DataFrame, parents: Sequence[str], name: str) -> DataFrame:
    """Adds ``budget``: the parent's budget ``given`` by ``weight``, filled up to ``capacity`` at most.

    Children are filled in the order of capacity per weight. Those before the first that is not full are full; the rest
    share what remains by weight.
    """
    group = Window.partitionBy(*parents) if parents else Window.partitionBy(F.lit(0))
    order = group.orderBy("ratio", name)
    ratio = F.when(F.col("weight") > 0, F.col("capacity") / F.col("weight")).otherwise(F.lit(float("inf")))
    nodes = nodes.withColumn("ratio", ratio)
    before = F.coalesce(F.sum("capacity").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    share = F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    nodes = nodes.withColumn("full", (F.col("weight") > 0) & (before + F.col("ratio") * share <= F.col("given")))
    taken = F.sum(F.when(F.col("full"), F.col("capacity")).otherwise(0.0)).over(group)
    rest = F.sum(F.when(F.col("full"), F.lit(0.0)).otherwise(F.col("weight"))).over(group)
    nodes = nodes.withColumns({"taken": taken, "rest": rest})
    part = F.when(F.col("rest") > 0, F.greatest(F.col("given") - F.col("taken"), F.lit(0.0)) * F.col("weight") / F.col("rest"))
    budget = F.when(F.col("full"), F.col("capacity")).otherwise(F.coalesce(part, F.lit(0.0)))
    return nodes.withColumn("budget", F.least(budget, F.col("capacity"))).drop("ratio", "full", "taken", "rest")


def budgets(
    leaves: DataFrame,
    levels: Sequence[str],
    weights: Mapping[str, Mapping[str, float]],
    budget_share: float,
    max_epochs: int,
) -> DataFrame:
    """Of every leaf (levels, tokens): ``whole`` epochs and ``rest`` tokens of the next."""
    given = leaves.agg(F.floor(F.sum("tokens") * F.lit(budget_share)).cast("double").alias("given"))
    above: DataFrame | None = None
    for depth, level in enumerate(levels):
        path, parents = list(levels[: depth + 1]), list(levels[:depth])
        nodes = leaves.groupBy(*path).agg((F.sum("tokens") * max_epochs).cast("double").alias("capacity"))
        nodes = nodes.withColumn("weight", weight(level, weights))
        nodes = nodes.join(above, parents) if above is not None else nodes.join(F.broadcast(given))
        nodes = shared_out(nodes, parents, level)
        above = nodes.select(*path, F.col("budget").alias("given"))
    tokens = F.col("tokens")
    out = leaves.join(above, list(levels)).withColumn("given", F.floor(F.col("given") + F.lit(1e-6)).cast("long"))
    out = out.withColumn("whole", F.when(tokens > 0, F.floor(F.col("given") / tokens)).otherwise(0).cast("int"))
    return out.withColumn("rest", F.col("given") - F.col("whole") * tokens)


def cuts(rows: DataFrame, plan: DataFrame, levels: Sequence[str], seed: int) -> DataFrame:
    """The plan with ``cut``: positions up to it belong to the prefix of the epoch after the whole ones."""
    levels = list(levels)
    leaf = Window.partitionBy(*levels)
    place = position(F.col("key"), F.col("whole"), seed)
    placed = rows.join(plan.select(*levels, "whole"), levels).select(*levels, "tokens", place.alias("place"))
    # start: first position of the range that decides; before: tokens of the positions below it.
    decisive = plan.select(*levels, "rest", F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("before"))
    bits = POSITION_BITS
    for _ in range(2):
        bits -= STEP_BITS
        bucket = F.shiftright("place", bits)
        inside = placed.join(decisive.select(*levels, "start"), levels).where(
            F.shiftright("place", bits + STEP_BITS) == F.shiftright("start", bits + STEP_BITS)
        )
        sums = inside.groupBy(*levels, bucket.alias("bucket")).agg(F.sum("tokens").alias("tokens"))
        sums = sums.join(decisive.select(*levels, "rest", "before"), levels)
        reached = F.sum("tokens").over(leaf.orderBy("bucket")) + F.col("before")
        sums = sums.withColumn("reached", reached).where(F.col("reached") > F.col("rest"))
        decisive = stored(
            sums.groupBy(*levels)
            .agg(F.min(F.struct("bucket", "reached", "tokens", "rest")).alias("at"))
            .select(
                *levels,
                F.col("at.rest").alias("rest"),
                F.shiftleft("at.bucket", bits).alias("start"),
                (F.col("at.reached") - F.col("at.tokens")).alias("before"),
            ),
            "range",
        )
    inside = placed.join(decisive, levels).where(F.shiftright("place", bits) == F.shiftright("start", bits))
    single = inside.groupBy(*levels, "rest", "start", "before", "place").agg(F.sum("tokens").alias("tokens"))
    reached = F.sum("tokens").over(leaf.orderBy("place")) + F.col("before")
    last = single.withColumn("reached", reached).groupBy(*levels).agg(
        F.coalesce(F.max(F.when(F.col("reached") <= F.col("rest"), F.col("place"))), F.min("start") - 1).alias("cut")
    )
    # A leaf without a decisive range has no tokens beyond its budget: all of its positions belong.
    return plan.join(last, levels, "left").withColumn("cut", F.coalesce("cut", F.lit(1 << POSITION_BITS)))


def mix(
    docs: DataFrame,
    levels: Sequence[str] = LEVELS,
    weights: Mapping[str, Mapping[str, float]] | None = None,
    budget_share: float = 0.5,
    max_epochs: int = 4,
    seed: int = SEED,
    added: tuple[str, str] = ("tokens", "epoch"),
) -> DataFrame:
    """The chosen rows with their columns, ``tokens`` and ``epoch``; a row comes once for each epoch it is chosen in.

    ``budget_share`` is the budget as a share of all tokens; ``added`` names the new columns.
    """
    levels = list(levels)
    names = [column for column in docs.columns if column not in added]
    inner = [unused(docs, f"__{level}") for level in levels]
    ready = docs.select(*names).withColumns({name: named(level) for name, level in zip(inner, levels)})
    rows = stored(
        ready.select(*inner, token_count(text_of("text")).alias("tokens"), identity(docs).alias("key")), "mix-rows"
    )
    leaves = stored(rows.groupBy(*inner).agg(F.sum("tokens").alias("tokens")), "mix-leaves")
    inner_weights = {name: (weights or {}).get(level, {}) for name, level in zip(inner, levels)}
    plan = stored(budgets(leaves, inner, inner_weights, budget_share, max_epochs), "mix-plan")
    plan = stored(cuts(rows, plan, inner, seed).select(*inner, "whole", "cut"), "mix-cuts")
    whole, cut = unused(docs, "__whole"), unused(docs, "__cut")
    chosen = ready.join(plan.withColumnsRenamed({"whole": whole, "cut": cut}), inner)
    copies = F.col(whole) + (position(identity(docs), F.col(whole), seed) <= F.col(cut)).cast("int")
    epochs = F.when(copies > 0, F.sequence(F.lit(0), copies - 1)).otherwise(F.array().cast("array<int>"))
    tokens = token_count(text_of("text"))
    return chosen.withColumn(added[0], tokens).select(*names, added[0], F.explode(epochs).alias(added[1]))
