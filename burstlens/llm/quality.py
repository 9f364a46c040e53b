"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document; the ledger keeps the measurements and one bit per failed rule. A policy is a
named, versioned set of rules: applying it is one bitwise test on the ledger, and ablations are counts per distinct bit
pattern, so neither reads a text again.

Defined results: a null or empty text has no words, all measurements 0 and fails ``few_words``; repeated rows are measured
row by row; an empty table gives an empty ledger; other columns, also ones named like a measurement, are not carried and not
read. Ties cannot occur. A text of any length is measured whole.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 8
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")

# Failure conditions over the measurements; the position in the list is the bit. New rules go to the end.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 20"),
    ("repeated_words", "100 * n_repeat_words > 30 * n_words"),
    ("many_symbols", "100 * n_symbols > 40 * n_words"),
    ("repeated_lines", "n_dup_lines >= 4 AND 100 * n_dup_lines > 60 * n_lines"),
    ("long_words", "word_chars > 30 * n_words"),
)
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}


@dataclass(frozen=True)
class Policy:
    """A version name and the rules whose failure rejects a document."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(BIT[r] for r in self.rules)


BASE = Policy("base-1", ("few_words", "repeated_words"))
CURRENT = Policy("full-1", tuple(name for name, _ in RULES))


def let(value: Column, body) -> Column:
    """``body(value)`` with the value evaluated once, not once per use or per element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")


def _covered(hashes: Column) -> Column:
    """Words in windows whose hash occurs twice or more: gaps between neighbouring starts, each at most a window."""

    def starts(ordered: Column) -> Column:
        same = lambda x, k, step: F.coalesce(F.get(ordered, k + F.lit(step))["h"] == x["h"], F.lit(False))
        return F.array_sort(F.transform(F.filter(ordered, lambda x, k: same(x, k, -1) | same(x, k, 1)), lambda x: x["i"]))

    ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return let(let(ordered, starts), lambda p: F.aggregate(
        F.transform(p, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW))).cast("long")),
        F.lit(0).cast("long"), lambda a, x: a + x))


def repeated_words(words: Column) -> Column:
    """How many words lie in a window of eight that occurs twice or more in the array, the first one included.

    Windows are compared by a 64-bit hash of their words.
    """

    def measure(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(1), F.size(w) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(w, i, F.lit(WINDOW))))
        found = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(_covered(h)))
        return F.when(F.size(w) > WINDOW, found).otherwise(F.lit(0).cast("long"))

    return let(words, measure)


def measurements(text: Column) -> Column:
    """A struct of the measurements of one text."""
    text = F.coalesce(text, F.lit(""))
    symbols = F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    by_words = let(words_of(text), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        repeated_words(w).alias("n_repeat_words")))
    by_lines = let(lines, lambda x: F.struct(
        F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    return F.struct(by_words.alias("w"), by_lines.alias("l"), symbols.cast("long").alias("n_symbols"))


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, measurements, ``failed`` with a bit for each failed rule."""
    m = docs.select(F.col(id_col), measurements(F.col(text_col)).alias("m")).select(
        id_col, "m.w.n_words", "m.w.word_chars", "m.n_symbols", "m.l.n_dup_lines", "m.w.n_repeat_words", "m.l.n_lines")
    bits = [F.when(F.expr(rule), F.lit(BIT[name])).otherwise(F.lit(0)).cast("long") for name, rule in RULES]
    failed = bits[0]
    for b in bits[1:]:
        failed = failed.bitwiseOR(b)
    return m.withColumn("failed", failed)


def rejected(policy: Policy, failed: str = "failed") -> Column:
    return F.col(failed).bitwiseAND(F.lit(policy.mask)) != 0


def ablations(rows: DataFrame, policy: Policy = CURRENT) -> DataFrame:
    """Per rule of the policy: documents that fail it, that only it rejects, and that are kept without it.

    Counts per bit pattern come first, so at most 2 ** rules rows meet the rules.
    """
    patterns = rows.groupBy("failed").agg(F.count(F.lit(1)).alias("n"))
    rules = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(BIT[r]).cast("long").alias("bit")) for r in policy.rules]))
    p = patterns.select("*", rules.alias("r")).select("n", "r.rule", "r.bit", F.col("failed").bitwiseAND(F.lit(policy.mask)).alias("f"))
    without = F.col("f").bitwiseAND(F.bitwise_not(F.col("bit")))
    return p.groupBy("rule").agg(
        F.sum(F.when(F.col("f").bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("fails"),
        F.sum(F.when(F.col("f") == F.col("bit"), F.col("n")).otherwise(0)).alias("only"),
        F.sum(F.when(without == 0, F.col("n")).otherwise(0)).alias("kept_without"),
    ).withColumn("policy", F.lit(policy.version))


def accepted(docs: DataFrame, policy: Policy = CURRENT, text_col: str = "text") -> DataFrame:
    """The rows that no rule of the policy rejects, with all their columns."""
    taken = {c.lower() for c in docs.columns}
    name = next(f"failed_{i}" for i in range(len(taken) + 1) if f"failed_{i}" not in taken)
    m = ledger(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{text_col}`").alias("text")), "row", "text")
    return m.select("row", F.col("failed").alias(name)).where(~rejected(policy, name)).select("row.*")
