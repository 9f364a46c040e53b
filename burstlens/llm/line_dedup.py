"""Line dedup by an exact set-similarity join, in DataFrame operations only.

A line's tokens are its distinct runs of ``SHINGLE`` words (lower case). With ``short``, as the queries ask, a line with fewer words has
one token, its whole word sequence: lines with the same token are the same class, so it needs no posting to be found; without, such a
line has none, matches nothing and stays. A line without words always stays. Two lines match when the Jaccard similarity of their token sets is at least ``similarity`` per cent. A line is removed when an earlier line
matches it; lines stand in order of document id (null first), hash of the text, line number. Rows with the same id and text count as one
document.

1. Lines with their tokens are written once to the shared folder, and deleted when their postings are known. Lines of the same words are one class, placed where it comes first.
2. Tokens are ordered by rarity: by how often the corpus holds their hash bucket (all lines counted, ``BUCKETS`` buckets in 128 levels), then by hash. A
   class posts its prefix, so many of its rarest tokens that two matching classes must share one.
3. Each class meets the earliest class of each of its posting lists. Classes that this does not settle then meet every earlier
   class of their lists. Both apply the length bound and the positional bound (what the two can still share from the
   posted token on) before a pair is made; pairs are then verified on the whole token sets.

A class that is settled needs no further partner, so a group of near copies costs about one pair a member, and nothing is
dropped for it. Copies of the commonest lines are left out before their tokens are posted (at most ``COMMON`` classes are known as such, a
bound by definition); tokens of buckets beyond ``SALT`` are spread over several lists for the search of lists with two classes.
Tokens are compared by 48-bit hashes, classes by 64-bit hashes of their words.

Defined results: null and empty texts have one empty line, which stays; an empty table gives no rows; other columns are carried
through ``dedup`` whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import discard, hint_if_small, scratch_path, stage
from .quality import let, words_of

SHINGLE = 5
SIMILARITY = 75
BUCKETS = 1 << 16
MASK = (1 << 48) - 1
COMMON = 100_000
SALT = 1_000_000


def _document(id_col: str, text_col: str) -> list[Column]:
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return [F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("h"), text.alias("t")]


def _written(df: DataFrame, path: str) -> DataFrame:
    """``df`` written and read again; hashes have no use for a dictionary, and as differences they take fewer bytes."""
    df.write.options(**{"parquet.enable.dictionary": "false", "parquet.writer.version": "v2"}).parquet(path)
    return df.sparkSession.read.parquet(path)


def _staged(df: DataFrame, name: str) -> DataFrame:
    return _written(df, scratch_path(df.sparkSession, name))


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_words(line: Column) -> Column:
    """Words of a line; the usual line is split at single blanks, which is faster than by a pattern."""
    plain = F.array_remove(F.split(line, " "), "")
    return F.when(line.rlike(r"[\t\x0B\x0C\r]"), words_of(line)).otherwise(plain)


def word_hashes(words: Column) -> Column:
    """64-bit hashes of the words: each word is hashed once, runs of words are hashed from these."""
    return F.transform(words, lambda x: F.xxhash64(x))


def tokens(hashes: Column) -> Column:
    """48-bit hashes of the distinct runs of ``SHINGLE`` words, given by their hashes; null below that."""
    run = lambda x, i: F.xxhash64(x, *[F.get(hashes, i + k) for k in range(1, SHINGLE)]).bitwiseAND(F.lit(MASK))
    return F.when(F.size(hashes) >= SHINGLE, F.array_distinct(F.transform(F.slice(hashes, F.lit(1), F.size(hashes) - (SHINGLE - 1)), run)))


def lines(docs: DataFrame, path: str, id_col: str, text_col: str, short: bool) -> DataFrame:
    """(id, h, line, c, n, sh): every line with a token, its class, and the tokens it may share with another class; written to ``path``."""
    one = docs.select(*_document(id_col, text_col)).select("id", "h", F.posexplode(_lines(F.col("t"))).alias("line", "s"))
    least = 1 if short else SHINGLE
    built = let(word_hashes(F.col("w")), lambda w: let(tokens(w), lambda x: F.struct(
        F.when(F.size(w) >= least, F.xxhash64(w)).alias("c"), F.when(F.size(w) >= least, F.coalesce(F.size(x), F.lit(1))).alias("n"), x.alias("sh"))))
    # lower case and words stand in selects of their own, which compile, unlike what a function of array elements holds
    words = one.withColumn("s", F.lower("s")).select("id", "h", "line", line_words(F.col("s")).alias("w"))
    return _written(words.select("id", "h", "line", built.alias("b")), path).where("b.n > 0").select("id", "h", "line", "b.c", "b.n", "b.sh")


def bucket_counts(held: DataFrame) -> list[int]:
    """Tokens per bucket (the first 16 bits) over all lines: ``BUCKETS`` numbers whatever the corpus."""
    counts = held.select(F.explode("sh").alias("t")).groupBy(F.shiftrightunsigned("t", 32).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    out = [0] * BUCKETS
    for r in counts.toLocalIterator():
        out[r["k"]] = r["n"]
    return out


def _constant(numbers: list[int], kind: str) -> Column:
    return F.split(F.lit(",".join(map(str, numbers))), ",").cast(f"array<{kind}>")


def prefix_size(n: Column, similarity: int) -> Column:
    return (n - F.ceil(n * similarity / 100) + 1).cast("int")


def postings(held: DataFrame, counts: list[int], similarity: int) -> DataFrame:
    """(t, c, pos) of the prefixes, for tokens that two classes post; places beyond 32,767 stand as that, a weaker bound.

    Tokens stand in order of their bucket's level, then of their hash. Levels follow the buckets' order by count, eight to each
    halving of the rank from the top: they fit in a byte, so that the table stays in a core's cache while every token is looked up.
    """
    levels = [0] * BUCKETS
    for place, k in enumerate(sorted(range(BUCKETS), key=lambda k: (-counts[k], k))):
        levels[k] = max(0, 127 - int(8 * math.log2(place + 1)))
    levels, lists = _constant(levels, "tinyint"), _constant([n // SALT for n in counts], "bigint")
    ranked = lambda t: F.shiftleft(F.get(levels, F.shiftrightunsigned(t, 32)).cast("bigint"), 48).bitwiseOR(t)
    ordered = F.slice(F.sort_array(F.transform("sh", ranked)), F.lit(1), prefix_size(F.col("n"), similarity))
    place = F.least("pos", F.lit((1 << 15) - 1)).cast("long")
    # what is shuffled is two numbers a posting: place (16 bits) and token, and class
    rows = held.select("c", F.posexplode(ordered).alias("pos", "t")).select(F.shiftleft(place, 48).bitwiseOR(F.col("t").bitwiseAND(F.lit(MASK))).alias("u"), "c")
    token = F.col("u").bitwiseAND(F.lit(MASK))
    more = F.get(lists, F.shiftrightunsigned(token, 32))
    # a token's list in the upper bits: 0, or from 1 on for a token that has several
    part = F.when(more > 0, 1 + F.pmod("c", F.least(more + 1, F.lit((1 << 15) - 2)))).otherwise(0)
    key = F.shiftleft(part, 48).bitwiseOR(token)
    dealt = rows.repartition(key).select(key.alias("k"), "c", F.shiftright("u", 48).cast("int").alias("pos"))
    # with several lists a token, a list of one class may have partners in another; few lists are left, so they are built and the rows probe them
    many = dealt.groupBy("k").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where(f"k > {MASK} or lo <> hi").select("k")
    return dealt.join(many.hint("shuffle_hash"), "k", "left_semi").select(F.col("k").bitwiseAND(F.lit(MASK)).alias("t"), "c", "pos").distinct()


def _may_match(similarity: int) -> Column:
    """Length and positional bounds of a posted token common to x and y."""
    n, m = F.col("x.n"), F.col("y.n")
    least = F.ceil(similarity * (n + m) / F.lit(100 + similarity))
    return (100 * F.least(n, m) >= similarity * F.greatest(n, m)) & (F.least(n - F.col("x.pos"), m - F.col("y.pos")) >= least)


def matches(pairs: DataFrame, first: DataFrame, texts: DataFrame, similarity: int) -> DataFrame:
    """Classes ``x`` of those pairs (x, y) that match, by their whole token sets; these are taken from the texts (id, h, t) again."""
    pairs = stage(pairs, "pairs")
    wanted = pairs.select(F.col("x").alias("c")).union(pairs.select("y")).distinct().join(first, "c").select("c", "first.*")
    at = hint_if_small(stage(wanted, "wanted"))
    found = texts.join(at, (texts["h"] == at["h"]) & texts["id"].eqNullSafe(at["id"])).select("c", F.get(_lines(F.col("t")), F.col("line")).alias("s"))
    words = found.dropDuplicates(["c"]).withColumn("s", F.lower("s")).select("c", line_words(F.col("s")).alias("w"))
    sets = stage(words.select("c", let(word_hashes(F.col("w")), tokens).alias("sh")), "sets")
    both = pairs.join(sets.select(F.col("c").alias("x"), F.col("sh").alias("a")), "x").join(sets.select(F.col("c").alias("y"), F.col("sh").alias("b")), "y")
    shared = F.size(F.array_intersect("a", "b"))
    return both.where(100 * shared >= similarity * (F.size("a") + F.size("b") - shared)).select("x").distinct()


def removed_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: int = SIMILARITY, short: bool = False) -> DataFrame:
    """(id, h, removed): per document with removed lines their numbers from 0; ``h`` is the hash of its text."""
    path = scratch_path(docs.sparkSession, "lines")
    held = lines(docs, path, id_col, text_col, short)
    places = _staged(held.select("id", "h", "line", "c"), "places")
    place = F.struct("id", "h", "line")
    classes = _staged(held.groupBy("c").agg(F.min(place).alias("first"), F.min("n").alias("n"), F.count(F.lit(1)).alias("copies")), "classes")
    first = classes.select("c", "first")
    total = classes.agg(F.sum("copies")).first()[0] or 0
    # fewer than COMMON classes can have more than this share of the lines
    common = F.broadcast(classes.where(F.col("copies") > total / COMMON).select(F.col("c").alias("cc"), F.col("first").alias("at")))
    alone = held.where("sh is not null").join(common, F.col("c") == F.col("cc"), "left").where(F.col("cc").isNull() | (place == F.col("at")))
    posted = _staged(postings(alone.select("c", "n", "sh"), bucket_counts(held), similarity), "postings")
    discard(docs.sparkSession, path)
    found = scratch_path(docs.sparkSession, "found")
    lists = _written(posted.join(classes.select("c", "first", "n"), "c"), found)

    texts = docs.select(*_document(id_col, text_col))
    rank = F.struct("first", "c", "n", "pos")
    pivots = lists.groupBy("t").agg(F.min(rank).alias("y"))
    followers = _staged(lists.alias("x").join(pivots.alias("y"), "t").where(F.col("x.c") != F.col("y.y.c")).select("x.*", "y.y"), "followers")
    discard(docs.sparkSession, found)
    pair = F.col("x.c").alias("x"), F.col("y.c").alias("y")
    near = followers.select(F.struct("c", "n", "pos").alias("x"), "y").where(_may_match(similarity)).select(*pair).distinct()
    settled = stage(matches(near, first, texts, similarity), "settled")
    # every pair with the earliest class of a list has been judged, so lists of two are done
    others = followers.drop("y")
    open_ = others.join(settled.withColumnRenamed("x", "c"), "c", "left_anti")
    rest = open_.alias("x").join(others.alias("y"), "t").where((F.col("y.first") < F.col("x.first")) & _may_match(similarity)).select(*pair).distinct()
    later = settled.union(matches(rest, first, texts, similarity)).distinct().select(F.col("x").alias("c"), F.lit(True).alias("gone"))

    # the only line of a class that matches no other stays, so such classes are left out
    judged = places.join(classes.join(later, "c", "left").where((F.col("copies") > 1) | F.col("gone")).select("c", "first", "gone"), "c")
    gone = judged.where(F.col("gone") | (place != F.col("first")))
    return stage(gone.groupBy("id", "h").agg(F.array_sort(F.collect_set("line")).alias("removed")), "removed")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: int = SIMILARITY, emptied: bool = True, short: bool = False) -> DataFrame:
    """``docs`` without the removed lines. ``emptied=False`` leaves out rows that lose their last word that way."""
    names = docs.columns
    gone = removed_lines(docs, id_col, text_col, similarity, short)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), *_document(id_col, text_col))
    both = rows.join(gone, rows["id"].eqNullSafe(gone["id"]) & (rows["h"] == gone["h"]), "left").select("row", "t", "removed")
    kept = let(_lines(F.col("t")), lambda x: F.array_join(F.transform(
        F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col("removed")), lambda i: F.get(x, i)), "\n"))
    both = both.withColumn("t", F.when(F.col("removed").isNull(), F.col(f"row.`{text_col}`")).otherwise(kept))
    if not emptied:
        both = both.where(F.col("removed").isNull() | F.col("t").rlike(r"\S"))
    return both.select(*[(F.col("t") if c == text_col else F.col(f"row.`{c}`")).alias(c) for c in names])


def line_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: int = SIMILARITY, short: bool = False) -> DataFrame:
    """Per row: id, n_lines, n_removed, and the numbers of the removed lines; the texts themselves are not shuffled."""
    gone = removed_lines(docs, id_col, text_col, similarity, short)
    rows = docs.select(*_document(id_col, text_col)).select("id", "h", F.size(_lines(F.col("t"))).cast("long").alias("n_lines"))
    both = rows.join(gone, rows["id"].eqNullSafe(gone["id"]) & (rows["h"] == gone["h"]), "left")
    return both.select(rows["id"].alias(id_col), "n_lines", F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"), F.coalesce("removed", F.array().cast("array<int>")).alias("removed"))
