"""Bursts: packets of one flow split where the idle gap exceeds a threshold."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from burstlens.operators.parts import CONTINUES, continued
from burstlens.operators.scan import AUTO, SLICE, TARGET_ROWS, Slicing, drop_slices, scan, sliced

STATISTICS = (
    "duration",
    "packet_count",
    "total_bytes",
    "inter_packet_time_mean",
    "inter_packet_time_std",
    "packet_size_mean",
    "packet_size_std",
)


def with_bursts(
    packets: DataFrame,
    *,
    key: Sequence[str],
    ts: str = "ts",
    order: Sequence[str] = (),
    gap: float = 0.1,
    slicing: Slicing | None | str = AUTO,
    keep_slices: bool = False,
    target_rows: int = TARGET_ROWS,
) -> DataFrame:
    """Add ``gap`` (to the previous packet of the flow) and ``flowlet_id`` 1..n.

    A burst opens at the first packet and wherever the gap is greater than the
    threshold.  ``gap`` is null at the first packet of the flow; ``opens``
    marks the first packet of each burst.  ``order`` breaks ties of ``ts``.
    ``keep_slices`` leaves the slice columns for a following scan of the same
    key, which then needs no exchange.
    """
    by = [ts, *order]
    cut = sliced(packets, key, ts, slicing, target_rows=target_rows)
    if SLICE in cut.columns:
        out = _bursts_over_slices(cut, list(key), by, gap)
        return out if keep_slices else drop_slices(out)
    gapped = scan(packets, key, by, lag={"_prev_ts": F.col(ts)})
    gapped = gapped.withColumn("gap", F.col(ts) - F.col("_prev_ts")).drop("_prev_ts")
    opened = gapped.withColumn("opens", F.col("gap").isNull() | (F.col("gap") > F.lit(gap)))
    return scan(opened, key, by, running={"flowlet_id": F.col("opens").cast("long")})


def _bursts_over_slices(packets: DataFrame, key: list[str], by: list[str], gap: float) -> DataFrame:
    """The same over slices of the busy keys, with one edge row per slice.

    A slice reports its first and last time and how many bursts open inside it;
    from these follow, for the next slices, the time of the previous packet and
    the number of bursts so far.
    """
    ts, part = F.col(by[0]), [*key, SLICE]
    w = Window.partitionBy(*part).orderBy(*by)
    local = packets.withColumn("_prev", F.lag(ts).over(w))
    inner = F.coalesce(ts - F.col("_prev") > F.lit(gap), F.lit(False)).cast("long")
    local = local.withColumn("_inner", F.sum(inner).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))

    hot = local.where("_hot") if "_hot" in packets.columns else local
    edges = hot.groupBy(*part).agg(F.min(ts).alias("_lo"), F.max(ts).alias("_hi"), F.max("_inner").alias("_opens"))
    over = (Window.partitionBy(*key) if key else Window.partitionBy()).orderBy(SLICE)
    edges = edges.withColumn("_before", F.lag("_hi").over(over))
    fresh = F.col("_before").isNull() | (F.col("_lo") - F.col("_before") > F.lit(gap))
    edges = edges.withColumn("_fresh", fresh.cast("long"))
    so_far = F.sum(F.col("_opens") + F.col("_fresh")).over(over.rowsBetween(Window.unboundedPreceding, -1))
    edges = edges.select(*part, "_before", "_fresh", so_far.alias("_base"))

    # A key that is not cut has no edge row: its first packet opens burst 1.
    joined = local.join(edges, part, "left")
    out = joined.withColumn("gap", ts - F.coalesce("_prev", "_before"))
    out = out.withColumns({
        "opens": F.col("gap").isNull() | (F.col("gap") > F.lit(gap)),
        "flowlet_id": F.coalesce("_base", F.lit(0)) + F.coalesce("_fresh", F.lit(1)) + F.col("_inner"),
    })
    return out.drop("_prev", "_inner", "_before", "_fresh", "_base")


def inner_gap() -> Column:
    """The gap inside a burst: null at the packet that opens it."""
    return F.when(~F.col("opens"), F.col("gap"))


def burst_features(
    bursts: DataFrame,
    *,
    key: Sequence[str],
    ts: str = "ts",
    size: str = "length",
    keep: Sequence[str] = (),
    first: Column | None = None,
) -> DataFrame:
    """One row per burst: times, counts, bytes, mean and sample deviation.

    Reuses the partitioning of ``with_bursts``, so no further exchange.  A null
    size counts as 0; undefined statistics are 0.  ``keep`` names columns that
    are constant per key; ``first`` adds its minimum as ``first_at``, the place
    of the burst in the input.
    """
    bytes_ = F.coalesce(F.col(size), F.lit(0))
    zero = F.lit(0.0)
    out = bursts.groupBy(*key, *keep, "flowlet_id").agg(
        F.min(ts).alias("start_ts"),
        F.max(ts).alias("end_ts"),
        F.count(F.lit(1)).alias("packet_count"),
        F.sum(bytes_.cast("long")).alias("total_bytes"),
        F.coalesce(F.avg(inner_gap()), zero).alias("inter_packet_time_mean"),
        F.coalesce(F.stddev_samp(inner_gap()), zero).alias("inter_packet_time_std"),
        F.coalesce(F.avg(bytes_), zero).alias("packet_size_mean"),
        F.coalesce(F.stddev_samp(bytes_), zero).alias("packet_size_std"),
        *([F.min(first).alias("first_at")] if first is not None else []),
    )
    return out.withColumn("duration", F.col("end_ts") - F.col("start_ts"))


def burst_sequences(
    bursts: DataFrame,
    *,
    key: Sequence[str],
    ts: str = "ts",
    order: Sequence[str] = (),
    size: str = "length",
    part_size: int = 100_000,
    slicing: Slicing | None | str = AUTO,
    target_rows: int = TARGET_ROWS,
) -> DataFrame:
    """Gap and size sequences in time order, in parts of ``part_size`` packets.

    A burst of at most ``part_size`` packets is one row with ``part`` 0, as in
    the nested record; a longer one continues in the following parts, so no
    task ever holds an unbounded list.  ``prev_size`` and ``prev_gap`` are those
    of the packet before the part, ``more`` says that packets follow it, so
    steps read from parts are those read from packets.
    """
    by = [ts, *order]
    ident = [*key, "flowlet_id"]
    cut = sliced(bursts, ident, ts, slicing, target_rows=target_rows)
    bytes_ = F.coalesce(F.col(size), F.lit(0)).cast("int")
    numbered = scan(
        cut, ident, by, running={"_n": F.lit(1)}, lag={"_ps": bytes_, "_pg": inner_gap()}, lead={"_follows": F.lit(True)})
    numbered = numbered.withColumn("part", F.floor((F.col("_n") - 1) / part_size).cast("int"))
    items = F.sort_array(F.collect_list(F.struct("_n", inner_gap().alias("g"), bytes_.alias("s"))))
    packed = drop_slices(numbered).groupBy(*ident, "part").agg(
        items.alias("_i"), F.min_by("_ps", "_n").alias("prev_size"), F.min_by("_pg", "_n").alias("prev_gap"),
        F.max_by(F.coalesce("_follows", F.lit(False)), "_n").alias("more"))
    return packed.select(
        *ident,
        "part",
        F.filter(F.col("_i.g"), lambda x: x.isNotNull()).alias("inter_packet_times"),
        F.col("_i.s").alias("packet_sizes"),
        *CONTINUES,
    )


def feature_records(
    flowlets: DataFrame, sequences: DataFrame | None = None, *, key: Sequence[str], flow_key: Sequence[str]
) -> DataFrame:
    """The exchanged burst record: flow key as a struct, sequences as arrays.

    ``key`` identifies a burst together with flowlet_id; ``flow_key`` names the
    fields of the struct.  A burst whose sequences have several parts is one
    record with the totals and the first part, and one record with the key and
    the sequences alone for each further part.
    """
    out = flowlets
    if sequences is not None:
        out = flowlets.join(sequences, [*key, "flowlet_id"], "left")
        out = continued(out, keep=[*key, *flow_key, "flowlet_id", "inter_packet_times", "packet_sizes", *CONTINUES])
    rest = [c for c in out.columns if c not in flow_key]
    return out.select(F.struct(*flow_key).alias("flow_key"), *rest)


def packet_steps(
    bursts: DataFrame,
    *,
    key: Sequence[str],
    ts: str = "ts",
    order: Sequence[str] = (),
    size: str = "length",
    gap_state: Column,
    slicing: Slicing | None | str = AUTO,
    target_rows: int = TARGET_ROWS,
) -> DataFrame:
    """Long form of both state sequences of each burst, without any array.

    Returns key, flowlet_id, ``attr`` ('size_block' or 'time_gap'), ``state``,
    ``prev_state`` (null at the first), ``is_first``, ``is_last``.  The size
    sequence has one step per packet, the gap sequence one per inner gap;
    ``gap_state`` maps the column ``gap`` to its label.
    """
    by = [ts, *order]
    base = bursts.select(
        *key, "flowlet_id", *by, "opens", *[c for c in (SLICE, "_hot") if c in bursts.columns],
        F.coalesce(F.col(size), F.lit(0)).cast("long").alias("_size"),
        F.when(~F.col("opens"), gap_state).alias("_gs"),
    )
    base = sliced(base, key, ts, slicing, target_rows=target_rows)
    seen = drop_slices(scan(
        base, key, by,
        lag={"_psize": F.col("_size"), "_pgs": F.col("_gs")},
        lead={"_nopens": F.col("opens")},
    ))
    last = F.coalesce(F.col("_nopens"), F.lit(True))
    fields = lambda a, s, p, f, ok: F.struct(
        F.lit(a).alias("attr"), s.cast("string").alias("state"), p.cast("string").alias("prev_state"),
        f.alias("is_first"), last.alias("is_last"), ok.alias("ok"))
    both = F.array(
        fields("size_block", F.col("_size"), F.when(~F.col("opens"), F.col("_psize")),
               F.col("opens"), F.lit(True)),
        fields("time_gap", F.col("_gs"), F.col("_pgs"), F.col("_pgs").isNull(), ~F.col("opens")),
    )
    # _pgs is null exactly when the previous packet opened the burst.
    return (
        seen.select(*key, "flowlet_id", F.inline(both)).where("ok").drop("ok")
    )
