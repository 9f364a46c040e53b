"""Longest-prefix match of addresses against a table of networks, as one sorted sweep.

Networks nest or are apart, so over the sorted addresses the innermost network changes only where one begins or ends. ``borders`` flattens
the nesting into those places with the network that holds from there on; ``match_networks`` merges them with the distinct
addresses in one order and carries the last border along. The sweep is a sliced ordered scan, so neither the networks nor the addresses
need to fit a task, and no address meets a network that does not hold it. IPv4 and IPv6 stand side by side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from burstlens.functions.addresses import ipv4_number, ipv6_hex
from burstlens.operators.scan import TARGET_ROWS, sliced_scan
from burstlens.session import settle


def place(ip: Column) -> Column:
    """Version and hex digits of an address: a text in the order of addresses; null when it is not valid."""
    four = F.concat(F.lit("4"), F.lpad(F.lower(F.hex(ipv4_number(ip))), 8, "0"))
    return F.when(ip.contains(":"), F.concat(F.lit("6"), ipv6_hex(ip))).otherwise(four)


def _filled(at: Column, length: Column, digit: str) -> Column:
    """``at`` (version, hex digits) with all bits behind ``length`` as in ``digit``, 0 or f."""
    whole, part = F.floor(length / 4).cast("int"), length % 4
    mask = F.element_at(F.array(*[F.lit(m) for m in (0, 8, 12, 14)]), (part + 1).cast("int"))
    own = F.conv(F.substr(at, whole + 2, F.lit(1)), 16, 10).cast("int")
    edge = own.bitwiseAND(mask) if digit == "0" else own.bitwiseOR(F.lit(15) - mask)
    head = F.concat(F.substr(at, F.lit(1), whole + 1), F.when(part > 0, F.lower(F.hex(edge.cast("long")))).otherwise(F.lit("")))
    return F.rpad(head, F.when(at.startswith("4"), 9).otherwise(33), digit)


def ranges(networks: DataFrame, *, cidr: str = "cidr", name: str = "name") -> DataFrame:
    """low, high (first and last place), length and name of each valid network; host bits are allowed, the least name of equal ones counts."""
    parts = F.split(F.trim(F.col(cidr)), "/")
    at = place(parts[0])
    width = F.when(at.startswith("4"), 32).otherwise(128)
    length = F.coalesce(F.get(parts, F.lit(1)).try_cast("int"), F.when(F.size(parts) == 1, width))
    rows = networks.select(at.alias("at"), length.alias("length"), width.alias("width"), F.col(name).alias("name"))
    valid = rows.where(F.col("at").isNotNull() & F.col("length").between(0, F.col("width")))
    both = valid.select(_filled(F.col("at"), F.col("length"), "0").alias("low"), _filled(F.col("at"), F.col("length"), "f").alias("high"), "length", "name")
    return both.groupBy("low", "high", "length").agg(F.min("name").alias("name"))


def borders(found: DataFrame) -> DataFrame:
    """``at`` and ``owner`` (name, length; null for none): who holds from this place up to the next.

    The place behind a network's last address is written as that address and ``~``, which sorts between it and its successor.
    """
    lengths = F.array(*[F.lit(r[0]) for r in found.select("length").distinct().collect()], F.lit(129))  # at most 130 numbers
    wider = found.select("low", "length", F.explode(F.filter(lengths, lambda n: n < F.col("length"))).alias("outer"))
    wider = wider.withColumn("outer_low", _filled(F.col("low"), F.col("outer"), "0"))
    other = found.select(F.col("low").alias("outer_low"), F.col("length").alias("outer"), F.struct("name", "length").alias("parent"))
    parents = wider.join(other, ["outer_low", "outer"]).groupBy("low", "length").agg(F.max_by("parent", "outer").alias("parent"))
    nested = found.join(parents, ["low", "length"], "left")
    begins = nested.select(F.col("low").alias("at"), F.lit(1).alias("kind"), F.col("length").alias("depth"), F.struct("name", "length").alias("owner"))
    # Of the networks that end at one place the widest one's parent goes on.
    ends = nested.select(F.concat("high", F.lit("~")).alias("at"), F.lit(0).alias("kind"), (-F.col("length")).alias("depth"), F.col("parent").alias("owner"))
    return begins.unionByName(ends).groupBy("at").agg(F.max_by("owner", F.struct("kind", "depth")).alias("owner"))


def match_networks(
    df: DataFrame, networks: DataFrame, *, ip: str, cidr: str = "cidr", name: str = "name", target_rows: int = TARGET_ROWS
) -> DataFrame:
    """Add ``network`` and ``prefix_length``: the narrowest network that holds the address; null without one."""
    held = settle(borders(settle(ranges(networks, cidr=cidr, name=name))))
    asked = df.select(F.col(ip).alias("_ip")).distinct().withColumn("at", place(F.col("_ip"))).where("at is not null")
    none = F.struct(F.lit(None).cast("string").alias("name"), F.lit(-1).alias("length"))
    change = F.struct(F.coalesce(F.col("owner"), none).alias("owner"))
    border = held.select("at", F.lit(None).cast("string").alias("_ip"), F.lit(0).alias("_asks"), change.alias("_change"))
    ask = asked.select("at", "_ip", F.lit(1).alias("_asks"), F.lit(None).cast(border.schema["_change"].dataType).alias("_change"))
    swept = sliced_scan(border.unionByName(ask), [], ["at", "_asks", "_ip"], target_rows=target_rows, carry={"_now": F.col("_change")})
    found = swept.where((F.col("_asks") == 1) & (F.col("_now.owner.length") >= 0)).select(
        "_ip", F.col("_now.owner.name").alias("network"), F.col("_now.owner.length").alias("prefix_length"))
    return df.join(found, df[ip] == found["_ip"], "left").drop("_ip")
