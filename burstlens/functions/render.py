"""Column expressions that format values for text captures and displays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def epoch_clock(epoch: Column) -> Column:
    """Epoch seconds (text) as HH:MM:SS.ffffff; unparsable text stays as it is."""
    at = F.timestamp_micros(F.round(epoch.try_cast("decimal(28,6)") * 1_000_000).cast("long"))
    return F.coalesce(F.date_format(at, "HH:mm:ss.SSSSSS"), epoch)


def flag_letters(words: Column) -> Column:
    """TCP flag words as ``[SPFR.]``; none of them is ``[.]``."""
    up = F.upper(F.coalesce(words, F.lit("")))
    # Flag words and their letters, in output order.
    table = (("SYN", "S"), ("PSH", "P"), ("FIN", "F"), ("RST", "R"), ("ACK", "."))
    letters = F.concat(*[F.when(up.contains(w), x).otherwise("") for w, x in table])
    return F.concat(F.lit("["), F.when(letters == "", ".").otherwise(letters), F.lit("]"))


def iso_time(base: Column, seconds: Column) -> Column:
    """Base timestamp plus seconds as ISO text and Z, with microseconds unless they are 0."""
    micros = F.unix_micros(base) + F.round(seconds * 1_000_000).cast("long")
    at = F.timestamp_micros(micros)
    whole = F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return F.when(micros % 1_000_000 == 0, whole).otherwise(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))


def clock_label(seconds: Column) -> Column:
    s = F.floor(seconds).cast("long")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    hours = F.floor(s / 3600).cast("string")
    return F.concat_ws(
        ":", F.when(F.length(hours) < 2, F.lpad(hours, 2, "0")).otherwise(hours),
        two(F.floor(s % 3600 / 60)), two(s % 60),
    )


def size_label(count: Column) -> Column:
    return (
        F.when(count < 1024, F.concat(count.cast("string"), F.lit(" B")))
        .when(count < 1024 * 1024, F.format_string("%.1f KB", count / 1024))
        .otherwise(F.format_string("%.1f MB", count / (1024 * 1024)))
    )


def percent_label(share: Column) -> Column:
    """Share as whole percent; missing or zero is a dash."""
    shown = F.format_string("%.0f%%", share * 100)
    return F.when(share.isNull() | (share == 0), "-").otherwise(shown)


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def relative_path(path: Column, root: str) -> Column:
    """Path below ``root`` when it is absolute and lies there, else unchanged."""
    base = root.rstrip("/") + "/"
    return F.when(path.startswith(base), F.substr(path, F.lit(len(base) + 1))).otherwise(path)


def or_unknown(c: Column, word: str = "unknown") -> Column:
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(word))


def document_key(index: Column) -> Column:
    return F.format_string("flowlet_%06d", index)


def document_index(key: Column) -> Column:
    """Number of a document key; null when the key is not one."""
    return F.nullif(F.regexp_extract(key, r"^flowlet_(\d+)$", 1), F.lit("")).try_cast("long")


def packet_lines(r: dict[str, Column]) -> Column:
    """The two text lines of one decoded record, as one value with a line break.

    ``r`` maps the record's field names to columns; missing text is ''.
    """
    v = {k: F.coalesce(c.cast("string"), F.lit("")) for k, c in r.items()}
    proto = F.when(v["proto"] == "6", "TCP (6)").otherwise(F.format_string("Proto (%s)", v["proto"]))
    tos = F.when(v["dsfield"] == "", "0x0").otherwise(v["dsfield"])
    labelled = lambda word, c: F.when(c == "", "").otherwise(F.concat(F.lit(word + " "), c))
    first = F.format_string(
        "%s IP (tos %s, ttl %s, id %s, offset 0, flags [%s], proto %s, length %s)",
        epoch_clock(v["epoch"]), tos, v["ttl"], v["id"], v["flags"], proto, v["len"],
    )
    second = F.format_string(
        "    %s.%s > %s.%s: Flags %s, cksum %s, %s, %s, %s, length %s",
        v["src"], v["sport"], v["dst"], v["dport"], flag_letters(v["tcp_flags"]), v["checksum"],
        labelled("seq", v["seq"]), labelled("ack", v["ack"]), labelled("win", v["window"]), v["tcp_len"],
    )
    return F.concat_ws("\n", first, second)
