"""Size blocks and first-order Markov chains, fitted and scored as tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from burstlens.functions import labels

EPSILON = 1e-10
CLASSES = ("llm", "non_llm")


def value_frequencies(df: DataFrame, *, by: Sequence[str], value: str) -> DataFrame:
    return df.groupBy(*by, F.col(value).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def coverage(freq: DataFrame, *, by: Sequence[str], share: float = 0.9) -> DataFrame:
    """Rank values by count and mark those needed to cover ``share`` of all.

    The value that crosses the share is kept; ties in count go to the smaller
    value.  Works on the frequency table: at most 65,536 packet sizes a class.
    """
    ranked = Window.partitionBy(*by).orderBy(F.desc("n"), "value")
    upto = ranked.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cum = F.sum("n").over(upto)
    total = F.sum("n").over(Window.partitionBy(*by))
    return freq.select(
        *by, "value", "n", F.row_number().over(ranked).cast("long").alias("rank"), cum.alias("cum_n"),
        ((cum - F.col("n")) / total < share).alias("is_block"),
    )


def fit_blocks(df: DataFrame, *, by: Sequence[str], value: str, share: float = 0.9) -> DataFrame:
    """``blocks_of`` the values of a column."""
    return blocks_of(value_frequencies(df, by=by, value=value), by=by, share=share)


def blocks_of(freq: DataFrame, *, by: Sequence[str], share: float = 0.9) -> DataFrame:
    """Block of every seen value: itself when it is a block, else the nearest.

    The nearest block is one of the two neighbours on the number line, found by
    windows over the frequency table; at equal distance the more frequent one.
    """
    freq = coverage(freq, by=by, share=share)
    line = Window.partitionBy(*by).orderBy("value")
    own = F.when(F.col("is_block"), F.struct("value", "rank"))
    below = F.last(own, ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, 0))
    above = F.first(own, ignorenulls=True).over(line.rowsBetween(0, Window.unboundedFollowing))
    near = freq.withColumns({"_lo": below, "_hi": above})
    dlo, dhi = F.col("value") - F.col("_lo.value"), F.col("_hi.value") - F.col("value")
    take_lo = F.col("_hi").isNull() | (dlo < dhi) | ((dlo == dhi) & (F.col("_lo.rank") <= F.col("_hi.rank")))
    pick = F.when(F.col("_lo").isNotNull() & take_lo, F.col("_lo.value")).otherwise(F.col("_hi.value"))
    out = near.withColumn("block_value", pick).drop("_lo", "_hi", "cum_n")
    return out.withColumn("block", labels.block_label(F.col("block_value")))


def map_sizes(steps: DataFrame, blocks: DataFrame, *, on: Sequence[str] = ()) -> DataFrame:
    """Replace sizes by block labels in ``state`` and ``prev_state``.

    ``on`` names class columns for training (each class its own blocks); without
    it ``blocks`` is one map for all.  A size outside the map keeps its own
    label.  Gap states pass through.
    """
    is_size = F.col("attr") == "size_block"
    out = steps
    for c in ("state", "prev_state"):
        side = blocks.select(*on, F.col("value").cast("string").alias(c), F.col("block").alias(f"_{c}"))
        out = out.join(side, [*on, c], "left")
        own = F.when(F.col(c).isNotNull(), labels.block_label(F.col(c).try_cast("double")))
        out = out.withColumn(c, F.when(is_size, F.coalesce(F.col(f"_{c}"), own)).otherwise(F.col(c))).drop(f"_{c}")
    return out


def explode_sequence(
    df: DataFrame, array: Column, *, ident: Sequence[str], attr: str, before: Column | None = None, more: Column | None = None
) -> DataFrame:
    """Steps of a state array, without a window: the previous state is looked
    up in the same array.  For a part of a longer sequence ``before`` is the
    state ahead of the part, and ``more`` says that the sequence goes on."""
    ahead = F.lit(None).cast("string") if before is None else before
    goes_on = F.lit(False) if more is None else F.coalesce(more, F.lit(False))
    rows = df.select(*ident, array.alias("_a"), ahead.alias("_b"), goes_on.alias("_m")).select(
        *ident, "_a", "_b", "_m", F.posexplode("_a").alias("_p", "state")
    )
    prev = F.when(F.col("_p") > 0, F.get("_a", F.col("_p") - 1)).otherwise(F.col("_b"))
    return rows.select(
        *ident, F.lit(attr).alias("attr"), "state", prev.alias("prev_state"),
        ((F.col("_p") == 0) & F.col("_b").isNull()).alias("is_first"),
        ((F.col("_p") == F.size("_a") - 1) & ~F.col("_m")).alias("is_last"),
    )


def step_counts(steps: DataFrame, *, by: Sequence[str]) -> DataFrame:
    """Number of equal steps: by, attr, prev_state, state, n, n_start, n_end.

    Everything fitted below comes from this one combinable pass.
    """
    return steps.groupBy(*by, "attr", "prev_state", "state").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("is_first").cast("long")).alias("n_start"),
        F.sum(F.col("is_last").cast("long")).alias("n_end"),
    )


def merge_counts(counts: DataFrame, *, by: Sequence[str], plus: DataFrame | None = None, minus: DataFrame | None = None) -> DataFrame:
    """Step counts with those of ``plus`` added and those of ``minus`` taken off; steps that no sequence has any more go.

    Counts are sums, so a table kept per group (a capture) can be added to or taken out of a total without its steps.
    """
    numbers = ("n", "n_start", "n_end")
    key = [*by, "attr", "prev_state", "state"]
    parts = [(counts, 1), (plus, 1), (minus, -1)]
    rows = [df.select(*key, *[(F.col(c) * sign).alias(c) for c in numbers]) for df, sign in parts if df is not None]
    whole = rows[0]
    for more in rows[1:]:
        whole = whole.unionByName(more)
    return whole.groupBy(*key).agg(*[F.sum(c).alias(c) for c in numbers]).where("n > 0")


def transitions(counts: DataFrame, *, by: Sequence[str]) -> DataFrame:
    """Counts and row-normalised probabilities of state -> next state."""
    pairs = counts.where(F.col("prev_state").isNotNull()).groupBy(
        *by, "attr", F.col("prev_state").alias("state"), F.col("state").alias("next_state")
    ).agg(F.sum("n").alias("n"))
    total = F.sum("n").over(Window.partitionBy(*by, "attr", "state"))
    return pairs.withColumn("p", F.col("n") / total)


def sequence_ends(counts: DataFrame, *, by: Sequence[str], totals: DataFrame | None = None) -> DataFrame:
    """Start and end probability of each state over all sequences.

    ``totals`` (by, attr, n_sequences) gives the number of sequences when empty
    ones must count; without it every sequence with a first state counts.
    """
    group = [*by, "attr"]
    ends = counts.groupBy(*group, "state").agg(F.sum("n_start").alias("n_start"), F.sum("n_end").alias("n_end"))
    if totals is None:
        ends = ends.withColumn("n_sequences", F.sum("n_start").over(Window.partitionBy(*group)))
    else:
        ends = ends.join(totals.select(*group, "n_sequences"), group)
    out = ends.where((F.col("n_start") > 0) | (F.col("n_end") > 0))
    return out.withColumns({
        "p_start": F.col("n_start") / F.col("n_sequences"), "p_end": F.col("n_end") / F.col("n_sequences"),
    })


def lookup_table(trans: DataFrame, ends: DataFrame, *, cls: str, classes: Sequence[str] = CLASSES) -> DataFrame:
    """Probability of each step under each class, one column per class.

    A first step has the empty previous state.
    """
    rows = trans.select(cls, "attr", F.col("state").alias("prev_state"), F.col("next_state").alias("state"), "p")
    starts = ends.where(F.col("n_start") > 0).select(
        cls, "attr", F.lit("").alias("prev_state"), "state", F.col("p_start").alias("p"))
    both = rows.unionByName(starts)
    return both.groupBy("attr", "prev_state", "state").agg(
        *[F.max(F.when(F.col(cls) == c, F.col("p"))).alias(f"p_{c}") for c in classes]
    )


def score_markov(
    steps: DataFrame, table: DataFrame, *, ident: Sequence[str], classes: Sequence[str] = CLASSES
) -> DataFrame:
    """Length-normalised log-likelihood per sequence, attribute and class.

    Columns ll_time_<class>, ll_size_<class>; null for an empty sequence (clip
    turns it into the lower bound).
    """
    known = steps.withColumn("prev_state", F.coalesce("prev_state", F.lit("")))
    joined = known.join(table, ["attr", "prev_state", "state"], "left")
    out = []
    for c in classes:
        step = F.log(F.coalesce(F.col(f"p_{c}"), F.lit(0.0)) + EPSILON)
        for name, attr in (("time", "time_gap"), ("size", "size_block")):
            out.append(F.avg(F.when(F.col("attr") == attr, step)).alias(f"ll_{name}_{c}"))
    return joined.groupBy(*ident).agg(*out)
