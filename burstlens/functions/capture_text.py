"""Column expressions that read one capture line: clock, protocol, ends, length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from burstlens.functions.binding import bind

# The line formats of a text capture.
CLOCK = r"(?i)^(\d{2}:\d{2}:\d{2}\.\d+)\s+(IP6|IP)\b"
CLOCK_SECONDS = r"^\d{2}:\d{2}:(\d{2}\.\d+)"
PROTOCOL = r"(?i)(?:proto|next-header)\s+([A-Za-z0-9_]+)"
PROTOCOL_NUMBER = r"(?i)(?:proto|next-header)\s+[A-Za-z0-9_]+\s*\((\d+)\)"
LENGTH = r"(?i)length\s+(\d+)"
HEADER = r"(?i)^LLM_IP\s+(\S+)\s+(\S+)$"
IP_PROTOCOLS = {1: "ICMP", 2: "IGMP", 6: "TCP", 17: "UDP", 58: "ICMP6"}


# Characters cut from both ends of a token.
_BLANKS = " \t\n\r\x0b\x0c"


def strip(c: Column) -> Column:
    return F.trim(c, F.lit(_BLANKS))


def group1(c: Column, pattern: str) -> Column:
    """First capture group, null when the pattern does not occur."""
    return F.nullif(F.regexp_extract(c, pattern, 1), F.lit(""))


def is_clock_line(line: Column) -> Column:
    return F.coalesce(line.rlike(CLOCK), F.lit(False))


def clock_seconds(line: Column) -> Column:
    """``hh:mm:ss.frac`` at the line start as seconds since midnight: the double nearest to the written time.

    Minutes are added to whole seconds, before the fraction: a sum of doubles may be off by a last digit, which moves
    gaps that equal a threshold.
    """
    seconds = F.regexp_extract(line, CLOCK_SECONDS, 1)
    whole = F.substring(line, 1, 2).try_cast("int") * 3600 + F.substring(line, 4, 2).try_cast("int") * 60
    whole = whole + F.substring(seconds, 1, 2).try_cast("int")
    return F.concat(whole.cast("string"), F.lit("."), F.substring_index(seconds, ".", -1)).try_cast("double")


def protocol(line: Column, *, by_number: bool = False) -> Column:
    """The word after ``proto``/``next-header`` in upper case, else UNKNOWN.

    ``by_number`` prefers the name of the number in parentheses, which repairs
    lines that carry the word ``Proto`` instead of a protocol name.
    """
    word = F.coalesce(F.upper(group1(line, PROTOCOL)), F.lit("UNKNOWN"))
    if not by_number:
        return word
    number = group1(line, PROTOCOL_NUMBER)
    names = F.coalesce(*[F.when(number == str(n), F.lit(w)) for n, w in IP_PROTOCOLS.items()])
    return F.coalesce(F.when(word == "PROTO", names), word)


def line_length(line: Column) -> Column:
    return group1(line, LENGTH).try_cast("int")


# Port digits at the end of a token; rule v2 leaves a plain dotted quad alone.
_PORT = {"v1": r"(?s)^.*\.(\d+)$", "v2": r"(?s)^(?!\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}$).*\.(\d+)$"}
_IPV6_TOKEN = r"^[0-9A-Fa-f.]*:[0-9A-Fa-f.]*:[0-9A-Fa-f:.]*$"


def clean_token(token: Column, rule: str = "v2") -> Column:
    """Trim; rule ``v2`` also cuts one trailing dot."""
    if rule not in _PORT:
        raise ValueError(f"unknown host/port rule {rule!r}")
    return F.regexp_replace(strip(token), r"\.$", "") if rule == "v2" else strip(token)


def port_digits(token: Column, rule: str = "v2") -> Column:
    """Digits after the last dot of a clean token, '' when it has no port."""
    return F.regexp_extract(token, _PORT[rule], 1)


def host_of(token: Column, digits: Column) -> Column:
    host = F.when(digits == "", token).otherwise(F.left(token, F.length(token) - F.length(digits) - 1))
    return F.when(token != "", host)


def port_of(digits: Column) -> Column:
    """Port number; 0, absent and unreadable are null."""
    return F.nullif(digits.try_cast("int"), F.lit(0))


def split_host_port(token: Column, rule: str = "v2") -> Column:
    """``struct(host, port)`` of ``host.port``.

    Rule ``v2`` cuts one trailing dot and keeps a plain dotted quad whole;
    rule ``v1`` splits at the last dot whenever digits follow it.
    """
    return bind(clean_token(token, rule), lambda t: bind(
        port_digits(t, rule), lambda d: F.struct(host_of(t, d).alias("host"), port_of(d).alias("port"))))


def source_token(line: Column) -> Column:
    """Text before the first ``>``; null when the line has none."""
    return F.when(F.contains(line, F.lit(">")), F.substring_index(line, ">", 1))


def after_arrow(line: Column) -> Column:
    return strip(F.substr(line, F.instr(line, ">") + 1))


def target_token(line: Column, right: Column, *, ipv6_compat: bool = False) -> Column:
    """The right end, given the text after the arrow.

    It stops at the first colon; an IPv6 address keeps its colons up to the
    next blank unless ``ipv6_compat`` asks for the cut after its first group.
    """
    cut = F.substring_index(right, ":", 1)
    if not ipv6_compat:
        token = F.regexp_replace(F.substring_index(right, " ", 1), ":$", "")
        cut = F.when(token.rlike(_IPV6_TOKEN), token).otherwise(cut)
    return F.when(F.contains(line, F.lit(">")), cut)


def address_ends(
    packets: DataFrame, line: str, *, rule: str = "v2", ipv6_compat: bool = False
) -> DataFrame:
    """Add src_ip, src_port, dst_ip, dst_port of an address line.

    In steps, so that each token is cut once per row.
    """
    c = F.col
    out = packets.withColumn("_right", after_arrow(c(line)))
    out = out.withColumns({
        "_src": clean_token(source_token(c(line)), rule),
        "_dst": clean_token(target_token(c(line), c("_right"), ipv6_compat=ipv6_compat), rule),
    })
    out = out.withColumns({"_sd": port_digits(c("_src"), rule), "_dd": port_digits(c("_dst"), rule)})
    return out.withColumns({
        "src_ip": host_of(c("_src"), c("_sd")), "src_port": port_of(c("_sd")),
        "dst_ip": host_of(c("_dst"), c("_dd")), "dst_port": port_of(c("_dd")),
    }).drop("_right", "_src", "_dst", "_sd", "_dd")
