"""Column expressions over decoded payloads and name fields."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from burstlens.functions.binding import bind

# Characters that count as readable text.
UNREADABLE = r"[^\x09-\x0D\x20-\x7E]"


def detected_name(fields: Sequence[Column], keywords: Sequence[str]) -> Column:
    """Upper-cased first keyword of the list that occurs in any name field.

    The fields are joined by a blank, so that no keyword arises across two.
    """
    none = F.lit(None).cast("string")
    return bind(
        F.lower(F.concat_ws(" ", *fields)),
        lambda names: F.coalesce(*[F.when(names.contains(k.lower()), F.lit(k.upper())) for k in keywords], none),
    )


def hex_text(payload: Column) -> Column:
    """Text of a hex payload (colons allowed); null unless it is strict UTF-8."""

    def decode(digits: Column) -> Column:
        # unhex is null for other characters but would accept an odd length.
        whole = F.length(digits) % 2 == 0
        return F.try_validate_utf8(F.when(whole, F.unhex(digits)).cast("string"))

    return bind(F.replace(payload, F.lit(":"), F.lit("")), decode)


def is_readable(text: Column, threshold: float = 0.90) -> Column:
    """Share of printable ASCII above the threshold; empty text is not readable."""

    def share(t: Column) -> Column:
        return F.try_divide(F.length(F.regexp_replace(t, UNREADABLE, "")), F.length(t))

    return F.coalesce(bind(text, share) > threshold, F.lit(False))


def looks_structured(text: Column) -> Column:
    return F.coalesce(text.rlike("[{<]"), F.lit(False))


def first_payload(*fields: Column) -> Column:
    """The first non-empty payload field."""
    return F.coalesce(*[F.nullif(f, F.lit("")) for f in fields], F.lit(""))
