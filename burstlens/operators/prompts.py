"""Prompt chains: clean-up of answer text, filter, order, numbered steps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from burstlens.operators.scan import TARGET_ROWS, sliced_scan

# Line separators and blanks of plain text.
LINE_BREAK = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\u0085\u2028\u2029]"
BLANK = r"[\s\x1c-\x1f]"


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?U)^{BLANK}+|{BLANK}+$", "")


# A complete JSON list of strings.  JSON readers ignore what follows the list
# and turn numbers into text, so the form is checked first.
_JSON_STRING = r'"[^"\\\x00-\x1f]*+(?:\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4})[^"\\\x00-\x1f]*+)*+"'
_GAP = r"[ \t\n\r]*+"
JSON_STRINGS = rf"^{_GAP}\[{_GAP}(?:{_JSON_STRING}{_GAP}(?:,{_GAP}{_JSON_STRING}{_GAP})*+)?+\]{_GAP}\z"


def _string_list(text: Column) -> Column:
    """A JSON list whose entries are all strings, else null."""
    return F.when(text.rlike(JSON_STRINGS), F.from_json(text, "array<string>"))


def normalize_chain(text: Column) -> Column:
    """Prompts of an answer: a JSON list of strings, else the list between the
    first '[' and the last ']', else the cleaned lines."""
    inner = F.nullif(F.regexp_extract(text, r"(?s)\[.*\]", 0), F.lit(""))
    lines = F.transform(F.split(text, LINE_BREAK), _strip)
    kept = F.filter(lines, lambda x: (x != "") & ~x.rlike(r"^[\[{]") & ~x.rlike(r"^[\[\]{}.,]+$"))
    cleaned = F.transform(kept, lambda x: F.regexp_replace(x, r"^[-0-9. ]+", ""))
    return F.coalesce(_string_list(text), _string_list(inner), cleaned)


def bank_from_answers(answers: DataFrame, *, text: str, category: str, model: str) -> DataFrame:
    """Prompt-bank rows of raw answers."""
    out = answers.withColumn("prompts", normalize_chain(F.col(text)))
    out = out.withColumn("chain_length", F.size("prompts"))
    return out.withColumnsRenamed({category: "category", model: "model"}).drop(text)


def filter_chains(bank: DataFrame, categories: Sequence[str] | None = None) -> DataFrame:
    """Chains of the given categories, without regard to case."""
    if not categories:
        return bank
    wanted = [c.lower() for c in categories]
    return bank.where(F.lower(F.coalesce("category", F.lit("uncategorized"))).isin(wanted))


def first_chains(bank: DataFrame, n: int, *, order: Sequence[str], shuffle_seed: int | None = None) -> DataFrame:
    """The first ``n`` chains in input order, or in a seeded random order."""
    if shuffle_seed is None:
        return bank.orderBy(*order).limit(n)
    shuffled = F.md5(F.concat_ws(":", F.lit(str(shuffle_seed)), *[F.col(c).cast("string") for c in order]))
    return bank.orderBy(shuffled, *order).limit(n)


def prompt_steps(bank: DataFrame, *, order: Sequence[str], target_rows: int = TARGET_ROWS) -> DataFrame:
    """One row per prompt: chain number over the given chains, step 1..n."""
    numbered = sliced_scan(
        bank, [], list(order), target_rows=target_rows, running={"chain_id": F.lit(1).cast("long")}
    )
    return numbered.select(
        "chain_id",
        F.coalesce("category", F.lit("uncategorized")).alias("category"),
        F.coalesce("model", F.lit("unknown")).alias("model"),
        F.posexplode("prompts").alias("_p", "text"),
    ).select("chain_id", "category", "model", (F.col("_p") + 1).alias("step"), F.col("text").cast("string").alias("text"))
