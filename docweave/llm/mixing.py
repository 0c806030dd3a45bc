"""Mixing sources to target weights by iterative proportional fitting (raking).

Documents are first summed into cells, one for each combination of source, language, topic or whatever the margins are. Raking
scales the cells' weights to the target shares of each margin in turn, again and again, so that all margins come to hold
at once while the cells keep their interplay. A cell's weight against what it has gives the probability with which its documents are
sampled; whether a document is depends on its id and a seed alone, so that a sample can be repeated and grown.

A cell can't give more than it has. Where its weight asks for more, raking is bounded: cells give all they have at most, and the others
of their margins' values make up for it. That works up to a share of all tokens that the scarcest value sets, so STEPS shares are raked side by
side and the largest that holds all margins is taken, or the unbounded raking at the scale of its fullest cell if that is larger.

All of it is DataFrame functions; after the first aggregation only cells are shuffled. Their join back to documents leaves the choice of
a broadcast to Spark, which knows the cells' size.

Defined results: a null in a margin is a value of its own; values without a target get no weight, and neither do cells without
tokens; rows with the same id share their fate; a null id is hashed as an empty text; an empty table gives an empty result. Other columns pass through, but those named as an output.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweave.llm.common import stored

ROUNDS, SHARE, SEED = 10, 0.5, 7
#: Shares that are tried, and how far from its share without bounds, as a part of it, a value may be with them.
STEPS, OFF = 32, 0.01


def softened(cells: DataFrame, margin: str, power: float = 0.5, weight: str = "_tokens") -> DataFrame:
    """Target shares (value, share) of a margin: in proportion to a power of what each value has, so that large ones shrink."""
    sums = cells.groupBy(margin).agg(F.sum(weight).cast("double").alias("_sum"))
    powers = sums.select(F.col(margin).alias("value"), F.pow("_sum", F.lit(power)).alias("_power"))
    total = powers.agg(F.sum("_power").alias("_all"))
    return powers.crossJoin(F.broadcast(total)).select("value", (F.col("_power") / F.col("_all")).alias("share"))


def raked(cells: DataFrame, targets: dict[str, DataFrame], weight: str = "_tokens", rounds: int = ROUNDS, apart: tuple[str, ...] = (), total: Column | None = None, most: Column | None = None) -> DataFrame:
    """cells with _weight, of sum 1 or total, whose sums over each margin's values are the target shares as nearly as `rounds` get them.

    Rows that differ in the columns apart are raked by themselves, those that don't in one task; no weight is above most, where that isn't null.
    """
    out = cells
    for i, (margin, shares) in enumerate(targets.items()):
        out = out.join(shares.select(F.col("value").alias(f"_value{i}"), F.col("share").alias(f"_share{i}")), F.col(margin).eqNullSafe(F.col(f"_value{i}")), "left").drop(f"_value{i}")
    out = out.withColumn("_weight", F.col(weight).cast("double"))
    if apart:  # then no window has to deal out its rows anew
        out = out.repartition(*apart)
    held = F.col("_weight") if most is None else F.least("_weight", most)
    total = F.lit(1.0) if total is None else total
    for _ in range(rounds):
        for i, margin in enumerate(targets):
            have = F.sum(held).over(Window.partitionBy(*apart, margin))
            out = out.withColumn("_weight", F.when(have > 0, F.col("_weight") * total * F.coalesce(f"_share{i}", F.lit(0.0)) / have).otherwise(0.0))
    return out.withColumn("_weight", held).drop(*(f"_share{i}" for i in range(len(targets))))


def sampling_rates(cells: DataFrame, targets: dict[str, DataFrame], share: float = SHARE, rounds: int = ROUNDS) -> DataFrame:
    """The margins, as the targets name them, with _rate: of the sample with the largest share of tokens, up to `share`, that has the raked margins."""
    margins = list(targets)
    everything = cells.agg(F.sum("_tokens").cast("double").alias("_all"))
    step = F.col("_step")
    # Step 0 is raked without bounds.
    tried = cells.crossJoin(F.broadcast(everything)).select(*margins, (F.col("_tokens") / F.nullif("_all", F.lit(0.0))).alias("_has"), F.explode(F.sequence(F.lit(0), F.lit(STEPS))).alias("_step"))
    tried = tried.withColumn("_total", F.when(step == 0, 1.0).otherwise(step * share / STEPS))
    made = raked(tried, targets, "_has", rounds, ("_step",), F.col("_total"), F.when(step > 0, F.col("_has")))
    made = stored(made.withColumn("_free", F.max(F.when(step == 0, F.col("_weight"))).over(Window.partitionBy(*margins))))
    tests: DataFrame | None = None
    for m in margins:
        want = F.col("_total") * F.sum("_free")
        test = made.filter(step > 0).groupBy("_step", "_total", m).agg((F.abs(F.sum("_weight") - want) <= OFF * want).alias("_holds")).select("_step", "_total", "_holds")
        tests = test if tests is None else tests.unionByName(test)
    # One row each.
    best = tests.groupBy("_step", "_total").agg(F.bool_and(F.coalesce("_holds", F.lit(True))).alias("_holds")).filter("_holds").agg(F.max("_total").alias("_largest"), F.max("_step").alias("_best"))
    fullest = made.filter((step == 0) & (F.col("_has") > 0)).agg(F.max(F.col("_weight") / F.col("_has")).alias("_fullest"))
    chosen = best.crossJoin(fullest).withColumn("_scale", F.coalesce(F.least(F.lit(share), 1 / F.nullif("_fullest", F.lit(0.0))), F.lit(share)))
    chosen = chosen.select("_scale", F.when(F.col("_largest") > F.col("_scale"), F.col("_best")).otherwise(0).alias("_best"))
    given = F.when(step == 0, F.col("_weight") * F.col("_scale")).otherwise(F.col("_weight"))
    rate = F.when(F.col("_has") > 0, F.least(F.lit(1.0), given / F.col("_has"))).otherwise(0.0)
    return made.crossJoin(F.broadcast(chosen)).filter(step == F.col("_best")).select(*margins, rate.alias("_rate"))


def uniform(id_col: str, seed: int = SEED) -> Column:
    """A number in [0, 1) that depends on the id and the seed: the first 52 bits of a hash."""
    hexed = F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(f":{seed}")).cast("binary"))
    return F.conv(F.substring(hexed, 1, 13), 16, 10).cast("bigint").cast("double") / float(1 << 52)


def mix(docs: DataFrame, margins: list[str], tokens: str, id_col: str = "doc_id", targets: dict[str, DataFrame] | None = None, share: float = SHARE, rounds: int = ROUNDS, seed: int = SEED) -> DataFrame:
    """docs with _rate and _kept: the probability of each document's cell, and whether the document is in the sample.

    The sample is to have the raked margins and to hold `share` of all tokens, or as much less as the scarcest values allow. Without targets,
    shares go with the square root of what a margin's values have.
    """
    cells = stored(docs.groupBy(*margins).agg(F.sum(F.col(tokens).cast("bigint")).alias("_tokens")))
    targets = targets or {m: softened(cells, m) for m in margins}
    rates = stored(sampling_rates(cells, {m: targets[m] for m in margins}, share, rounds).select(*(F.col(m).alias(f"_m{i}") for i, m in enumerate(margins)), "_rate"))
    on = F.lit(True)
    for i, m in enumerate(margins):
        on = on & F.col(m).eqNullSafe(F.col(f"_m{i}"))
    made = docs.drop("_rate", "_kept").join(rates, on, "left").drop(*(f"_m{i}" for i in range(len(margins))))
    return made.withColumn("_rate", F.coalesce("_rate", F.lit(0.0))).withColumn("_kept", uniform(id_col, seed) < F.col("_rate"))


def report(mixed: DataFrame, margins: list[str], tokens: str, targets: dict[str, DataFrame] | None = None) -> DataFrame:
    """(margin, value, target, expected, held): what share of the sample's tokens each value is expected to have, and the part of all tokens that the sample holds.

    So targets that cells cannot meet show, whether as a smaller sample or as shares that are off.
    """
    cells = mixed.groupBy(*margins).agg(F.sum(F.col(tokens).cast("bigint")).alias("_tokens"), F.sum(F.col(tokens) * F.col("_rate")).alias("_given"))
    total = cells.agg(F.nullif(F.sum("_given"), F.lit(0.0)).alias("_all"), (F.sum("_given") / F.nullif(F.sum("_tokens"), F.lit(0))).alias("held"))
    out: DataFrame | None = None
    for m in margins:
        want = (targets or {}).get(m) or softened(cells, m)
        have = cells.groupBy(F.col(m).alias("_value")).agg(F.sum("_given").alias("_given"))
        both = want.join(have, F.col("value").eqNullSafe(F.col("_value")), "full").crossJoin(F.broadcast(total))  # one row
        one = both.select(F.lit(m).alias("margin"), F.coalesce("value", "_value").cast("string").alias("value"), F.coalesce("share", F.lit(0.0)).alias("target"), F.coalesce(F.col("_given") / F.col("_all"), F.lit(0.0)).alias("expected"), "held")
        out = one if out is None else out.unionByName(one)
    return out


def topic(text: Column) -> Column:
    """A topic of documents that name none: by what they look like."""
    size = F.char_length(text)
    return F.when(F.contains(text, F.lit(" | ")), "tables").when(size < 1000, "notes").when(size < 8000, "articles").otherwise("books")
