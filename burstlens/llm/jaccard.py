"""N-gram Jaccard join as a blocked sparse product of the document by n-gram incidence.

Two documents link when the Jaccard similarity of their sets of word n-grams is at least ``similarity`` per cent. Equal sets are one
class; the join runs over classes.

1. A class can link only if enough of its n-grams, ``s n``, occur in some other class. All n-grams meet once, packed, in buckets; only the
   classes that pass go on. These send the postings of their prefix: with their n-grams in one fixed order, the rarest first, so
   many that two linked classes must share one (``n - ceil(s n) + 1``). The order puts n-grams that occur twice or more within a
   task behind the others, by their total; any order gives the same links, this one keeps the postings short.
2. Classes that share a posting are compared in two rounds. In the first, each posting list has a pivot, and a class meets the
   pivot that it shares most lists with. In the second, only lists that still hold several components go on: classes outside the
   largest component of the list meet all others of another component, by the overlap of their prefixes, and those that pass
   whole. So a group of copies costs one comparison a member, and no link between different components is left out.
3. Comparisons are block products: a block of left rows and one of right rows of the incidence matrix, overlap counts accumulated
   n-gram by n-gram; pairs whose sizes cannot reach the similarity are discarded before, the rest by the exact count after.
4. Components come from the links by alternating stars.

Blocks, buckets and salted lists have bounded sizes whatever the data; what is broadcast is bounded by ``FREQUENT`` n-grams and, for
the choice of rows whose sets are needed again and where they go, by ``BROADCAST_IDS`` rows (a shuffle join beyond).

N-grams are compared by 64-bit hashes, classes by a 64-bit hash of the set and its size. Defined results: null or empty texts, and
texts without words, have an empty set and link with nothing, their component is their own id; fewer words than n make one n-gram;
repeated rows are copies; a null id is never a component's id unless all its ids are null; an empty table gives no rows;
only the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .components import components
from .words import mix, shingles, word_hashes

N = 5
SIMILARITY = 75
FREQUENT = 1 << 18
BROADCAST_IDS = 500_000
# Buckets of n-grams: at least so many, and so many n-grams in each at most.
BUCKETS = 64
BUCKET_GRAMS = 1 << 21
BATCH_GRAMS = 1 << 20
BUCKET_POSTINGS = 1 << 20
SALT_POSTINGS = 1 << 20
BLOCK = 512
# Rows of long values that are turned into Python objects at once.
ROWS = 500
# n-grams counted at once in a task, and matches expanded at once in a product.
COUNTED = 1 << 21
EXPANDED = 1 << 22


def set_of(text: str | None, n: int) -> np.ndarray:
    return shingles(word_hashes(text), n) if text else np.zeros(0, np.uint64)


def class_of(grams: np.ndarray) -> int:
    """Signed 64-bit name of a set."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(grams.tobytes(), seed=len(grams))).astype(np.int64)) if len(grams) else 0


def prefix_size(n: int, similarity: int) -> int:
    return n - -(-similarity * n // 100) + 1


def _row(id_col: Column, text_col: Column) -> Column:
    """What finds a row again: its id, or a hash of its text where the id is null."""
    return F.coalesce(id_col.cast("string"), F.concat(F.lit("#"), F.xxhash64(text_col).cast("string")))


def measure(docs: DataFrame, n: int) -> DataFrame:
    """(id, row, h, n, c): size and class of every document's set."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            sizes, names = [], []
            for text in batch.column(3).to_pylist():
                grams = set_of(text, n)
                sizes.append(len(grams))
                names.append(class_of(grams))
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in range(3)], pa.array(sizes, pa.int64()), pa.array(names, pa.int64())], names=["id", "row", "h", "n", "c"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.select("id", "row", "h", "text").mapInArrow(run, f"id {kind}, row string, h long, n long, c long")


def _cut(keys: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, list[list[bytes]]]:
    """The distinct keys and, per column, the bytes of the rows of each key."""
    o = keys.argsort(kind="stable")
    keys = keys[o]
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    ends = np.append(starts[1:], len(keys))
    return keys[starts], [[x[a:b].tobytes() for a, b in zip(starts, ends)] for x in (c[o] for c in columns)]


def shared_counts(docs: DataFrame, n: int, buckets: int) -> DataFrame:
    """(c, shared): how many n-grams of a class some other class has too, or a few more.

    N-grams are dealt to buckets by hash and compared by 32 further bits; a false meeting can only raise a count.
    """
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        size = 0

        def packed() -> pa.RecordBatch:
            grams = np.concatenate(list(held.values()))
            place = np.repeat(np.arange(len(held), dtype=np.uint16), [len(x) for x in held.values()])
            names = np.array(list(held), np.int64).tobytes()
            held.clear()
            keys, (gram, where) = _cut((grams >> np.uint64(32)) % np.uint64(buckets), grams.astype(np.uint32), place)
            # per class the number of its n-grams in the bucket is enough: they stand in order of class
            counts = [np.bincount(np.frombuffer(w, np.uint16), minlength=len(names) // 8).astype(np.uint16).tobytes() for w in where]
            return pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int32)), pa.array(gram, pa.binary()), pa.array(counts, pa.binary()), pa.array([names] * len(keys), pa.binary())], names=["bucket", "g", "k", "c"])

        for batch in sliced(batches):
            for text in batch.column(0).to_pylist():
                grams = set_of(text, n)
                name = class_of(grams)
                if len(grams) and name not in held:
                    for a in range(0, len(grams), 60_000):  # a long set goes in parts, each with counts below 2 ** 16
                        if a:
                            yield packed()
                            size = 0
                        held[name] = grams[a : a + 60_000]
                        size += len(held[name])
                    if size > BATCH_GRAMS or len(held) >= 60_000:
                        yield packed()
                        size = 0
        if held:
            yield packed()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def give() -> pa.RecordBatch:
            gram, name = (np.concatenate(x) for x in zip(*held))
            held.clear()
            o = gram.argsort(kind="stable")
            gram, name = gram[o], name[o]
            same = gram[1:] == gram[:-1]
            many = np.append(same, False) | np.append(False, same)
            gram, name = gram[many], name[many]
            o = np.lexsort((name, gram))  # copies of other tasks are one class
            gram, name = gram[o], name[o]
            other = np.append(True, (gram[1:] != gram[:-1]) | (name[1:] != name[:-1]))
            gram, name = gram[other], name[other]
            same = gram[1:] == gram[:-1]
            name, times = np.unique(name[np.append(same, False) | np.append(False, same)], return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(name), pa.array(times.astype(np.int64))], names=["c", "shared"])

        now = None
        for batch in batches:
            for row in batch.to_pylist():
                if row["bucket"] != now and held:
                    yield give()
                now = row["bucket"]
                held.append((np.frombuffer(row["g"], np.uint32), np.repeat(np.frombuffer(row["c"], np.int64), np.frombuffer(row["k"], np.uint16))))
        if held:
            yield give()

    dealt = docs.select("text").mapInArrow(deal, "bucket int, g binary, k binary, c binary")
    parts = dealt.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(count, "c long, shared long")
    return parts.groupBy("c").agg(F.sum("shared").alias("shared"))


def repeated(docs: DataFrame, n: int) -> DataFrame:
    """(c, n): n-grams that occur twice or more within a task, and how often."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def counted() -> pa.RecordBatch:
            values = np.concatenate(held)
            held.clear()
            values.sort()
            starts = np.flatnonzero(np.append(True, values[1:] != values[:-1]))
            times = np.diff(np.append(starts, len(values)))
            many = times > 1
            return pa.RecordBatch.from_arrays([pa.array(values[starts[many]].view(np.int64)), pa.array(times[many].astype(np.int64))], names=["c", "n"])

        for batch in sliced(batches):
            for text in batch.column(0).to_pylist():
                held.append(set_of(text, n))
                size += len(held[-1])
                if size > COUNTED:
                    yield counted()
                    size = 0
        if held:
            yield counted()

    return docs.select("text").mapInArrow(run, "c long, n long")


def frequent(counts: DataFrame) -> np.ndarray:
    """The ``FREQUENT`` most counted n-grams, rarest first; of equal counts all or none."""
    sums = stage(counts.groupBy("c").agg(F.sum("n").alias("n")), "ngrams")
    room, least = FREQUENT, 1 << 62
    for r in sums.groupBy("n").count().orderBy(F.desc("n")).limit(FREQUENT).collect():
        room -= r["count"]
        if room < 0:
            break
        least = r["n"]
    rows = sums.where(F.col("n") >= least).orderBy("n", "c").toArrow()
    return np.stack([rows["c"].to_numpy().view(np.uint64), rows["n"].to_numpy().astype(np.uint64)])


class Order:
    """The fixed order of n-grams: those not known as frequent by hash, then the frequent ones by count."""

    def __init__(self, table: np.ndarray) -> None:
        order = table[0].argsort()
        self.names, self.place, self.times = table[0][order], order, table[1][order]

    def prefix(self, grams: np.ndarray, similarity: int) -> tuple[np.ndarray, np.ndarray]:
        """The first n-grams of a sorted set in this order, and how often each was counted (0: unknown)."""
        size = prefix_size(len(grams), similarity)
        if not len(self.names):
            return grams[:size], np.zeros(min(size, len(grams)), np.uint64)
        at = np.searchsorted(self.names, grams).clip(max=len(self.names) - 1)
        known = self.names[at] == grams
        rare = grams[~known][:size]
        times = np.zeros(len(rare), np.uint64)
        if len(rare) < size:
            at, often = at[known], grams[known]
            later = self.place[at].argsort()[: size - len(rare)]
            rare, times = np.concatenate((rare, often[later])), np.concatenate((times, self.times[at[later]]))
        return rare, times


def postings(docs: DataFrame, n: int, similarity: int, order: np.ndarray, buckets: int) -> DataFrame:
    """Prefix postings, packed per task and bucket: n-gram, salt, class, size and number of own n-grams as binary columns."""
    shared = docs.sparkSession.sparkContext.broadcast(order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rule = Order(shared.value)
        held: list[tuple] = []
        size = 0

        def packed() -> pa.RecordBatch:
            gram, salt, name, number, own = (np.concatenate(x) for x in zip(*held))
            held.clear()
            # copies within the task collapse here
            o = np.lexsort((name, gram))
            o = o[np.append(True, (gram[o][1:] != gram[o][:-1]) | (name[o][1:] != name[o][:-1]))]
            gram, salt, name, number, own = gram[o], salt[o], name[o], number[o], own[o]
            keys, columns = _cut(mix(gram + salt.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(buckets), gram, salt, name, number, own)
            return pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int32)), *[pa.array(x, pa.binary()) for x in columns]], names=["bucket", "g", "s", "c", "n", "o"])

        for batch in sliced(batches):
            for text, known in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                grams = set_of(text, n)
                if len(grams):
                    name = np.int64(class_of(grams)).view(np.uint64)
                    gram, times = rule.prefix(grams, similarity)
                    lists = times // np.uint64(SALT_POSTINGS) + np.uint64(1)
                    salt = np.where(lists > 1, name % lists + np.uint64(1), np.uint64(0))  # 0: the only list
                    held.append((gram, salt.astype(np.uint16), np.full(len(gram), name), np.full(len(gram), len(grams), np.uint32), np.full(len(gram), max(0, len(grams) - known), np.uint32)))
                    size += len(gram)
                    if size > BUCKET_POSTINGS:
                        yield packed()
                        size = 0
        if held:
            yield packed()

    return docs.select("text", "shared").mapInArrow(run, "bucket int, g binary, s binary, c binary, n binary, o binary")


def shared_lists(packed: DataFrame, buckets: int, similarity: int) -> DataFrame:
    """Rows (g, s, c, n, p) of the lists with two classes or more; ``p`` is the pivot that the class meets in the first round.

    The pivot is the class with the fewest n-grams of its own, as the origin of a group of edited copies has; classes whose size
    cannot link with it take the next of their kind.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def give() -> pa.RecordBatch:
            gram, salt, name, number, own = (np.concatenate(x) for x in zip(*held))
            held.clear()
            o = np.lexsort((name, own, salt, gram))
            gram, salt, name, number = gram[o], salt[o], name[o], number[o].astype(np.int64)
            same = (gram[1:] == gram[:-1]) & (salt[1:] == salt[:-1])
            fresh = np.append(True, ~(same & (name[1:] == name[:-1])))  # copies of other tasks
            gram, salt, name, number = gram[fresh], salt[fresh], name[fresh], number[fresh]
            same = (gram[1:] == gram[:-1]) & (salt[1:] == salt[:-1])
            # a class alone in its list may have partners in the other lists of the n-gram
            many = np.append(same, False) | np.append(False, same) | (salt > 0)
            gram, salt, name, number = gram[many], salt[many], name[many], number[many]
            starts = np.flatnonzero(np.append(True, (gram[1:] != gram[:-1]) | (salt[1:] != salt[:-1]))) if len(gram) else np.zeros(0, np.int64)
            pivot = np.zeros(len(gram), np.uint64)
            for a, b in zip(starts, np.append(starts[1:], len(gram))):
                left = np.arange(a, b)
                while len(left):
                    size = number[left[0]]
                    near = 100 * np.minimum(size, number[left]) >= similarity * np.maximum(size, number[left])
                    pivot[left[near]] = name[left[0]]
                    left = left[~near]
            return pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), pa.array(salt.astype(np.int32)), pa.array(name.view(np.int64)), pa.array(number), pa.array(pivot.view(np.int64))], names=["g", "s", "c", "n", "p"])

        now = None
        for batch in batches:
            for row in batch.to_pylist():
                if row["bucket"] != now and held:
                    yield give()
                now = row["bucket"]
                held.append([np.frombuffer(row[k], t) for k, t in (("g", np.uint64), ("s", np.uint16), ("c", np.uint64), ("n", np.uint32), ("o", np.uint32))])
        if held:
            yield give()

    return packed.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(run, "g long, s int, c long, n long, p long")


def block_product(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Overlap counts of each left with each right set: the product of two blocks of rows of the incidence matrix."""
    grams = np.concatenate(left)
    rows = np.repeat(np.arange(len(left)), [len(x) for x in left])
    o = grams.argsort(kind="stable")
    grams, rows = grams[o], rows[o]
    out = np.zeros((len(right), len(left)), np.int64)
    k = 0
    while k < len(right):
        # as many right rows as keep the expanded matches within bounds
        e, room = k + 1, EXPANDED // max(1, len(left)) - len(right[k])
        while e < len(right) and room > len(right[e]):
            room -= len(right[e])
            e += 1
        part = np.concatenate(right[k:e])
        lo, hi = np.searchsorted(grams, part, "left"), np.searchsorted(grams, part, "right")
        width = hi - lo
        row = np.repeat(np.repeat(np.arange(e - k), [len(x) for x in right[k:e]]), width)
        at = np.arange(width.sum()) - np.repeat(width.cumsum() - width, width) + np.repeat(lo, width)
        out[k:e] = np.bincount(row * len(left) + rows[at], minlength=(e - k) * len(left)).reshape(e - k, len(left))
        k = e
    return out.T


def whole(a: np.ndarray, b: np.ndarray, common: np.ndarray, similarity: int) -> np.ndarray:
    """Which overlaps of whole sets of these sizes reach the similarity."""
    return 100 * common >= similarity * (a + b - common)


def begun(a: np.ndarray, b: np.ndarray, common: np.ndarray, similarity: int) -> np.ndarray:
    """Which overlaps of prefixes allow it: of the n-grams that two sets share, only those that either lacks can lie beyond."""
    least = -(-similarity * (a + b) // (100 + similarity))
    beyond = np.maximum(a - prefix_size(a, similarity), b - prefix_size(b, similarity))
    return common >= np.maximum(1, least - beyond)


def linked(left: list[np.ndarray], right: list[np.ndarray], a: np.ndarray, b: np.ndarray, similarity: int, test: Callable) -> Iterator[tuple[int, int]]:
    """Index pairs of left and right rows, of sets with ``a`` and ``b`` n-grams, whose overlap passes the test."""
    a, b = a[:, None], b[None, :]
    possible = 100 * np.minimum(a, b) >= similarity * np.maximum(a, b)
    some_left, some_right = np.flatnonzero(possible.any(1)), np.flatnonzero(possible.any(0))
    if not len(some_left):
        return
    common = block_product([left[i] for i in some_left], [right[j] for j in some_right])
    passed = test(a[some_left], b[:, some_right], common, similarity) & possible[np.ix_(some_left, some_right)]
    for i, j in zip(*np.nonzero(passed)):
        yield int(some_left[i]), int(some_right[j])


def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return (batch.slice(k, ROWS) for batch in batches for k in range(0, len(batch), ROWS))


def packed48(grams: np.ndarray) -> bytes:
    """The upper 48 bits of each n-gram's hash."""
    return (grams >> np.uint64(16)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpacked48(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def products(rows: DataFrame, sets: DataFrame, similarity: int, test: Callable = whole) -> DataFrame:
    """Pairs (a, b) that pass the test in the comparisons ``rows``: (task, side, c, label); left rows of a task meet its right ones of
    another label.

    ``sets`` has (c, n, grams): the size of a class, and its n-grams or those of its prefix. A task has about a block of rows a side.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, sides, seen = None, ([], []), set()

        def found() -> pa.RecordBatch:
            a, b = [], []
            if sides[0] and sides[1]:
                sizes = [np.array([x[2] for x in s]) for s in sides]
                for i, j in linked([x[3] for x in sides[0]], [x[3] for x in sides[1]], *sizes, similarity, test):
                    if sides[0][i][1] != sides[1][j][1]:
                        a.append(sides[0][i][0])
                        b.append(sides[1][j][0])
            for s in sides:
                s.clear()
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in sliced(batches):
            for t, side, c, label, n, grams in zip(*[batch.column(k).to_pylist() for k in ("task", "side", "c", "label", "n", "grams")]):
                if t != task:
                    if task is not None:
                        yield found()
                    task = t
                if (side, c) not in seen:
                    seen.add((side, c))
                    sides[side].append((c, label, n, unpacked48(grams)))
        if task is not None:
            yield found()

    few = rows.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    full = sets.join(F.broadcast(rows) if few else rows, "c").select("task", "side", "c", "label", "n", "grams")
    return full.repartition("task").sortWithinPartitions("task", "side", "c").mapInArrow(run, "a long, b long")


def prefixes(lists: DataFrame) -> DataFrame:
    """(c, n, grams): the posted n-grams of each class that another class posts too; at most a prefix each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams = [packed48(np.array(g, np.int64).view(np.uint64)) for g in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(grams, pa.binary())], names=["c", "n", "grams"])

    return lists.groupBy("c", "n").agg(F.collect_set("g").alias("g")).mapInArrow(run, "c long, n long, grams binary")


def chosen(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The texts named by ``wanted`` (row, and what else it has); no other text is looked at again."""
    small = wanted.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return docs.select("row", "text").join(F.broadcast(wanted) if small else wanted, "row").drop("row")


def sets_of(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """(c, n, grams) of the wanted classes (row, c)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            names, sizes, found = [], [], []
            for text, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                grams = set_of(text, n)
                if class_of(grams) == c:
                    names.append(c)
                    sizes.append(len(grams))
                    found.append(packed48(grams))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(sizes, pa.int64()), pa.array(found, pa.binary())], names=["c", "n", "grams"])

    return chosen(docs, wanted.select("row", "c")).mapInArrow(run, "c long, n long, grams binary")


def _remaining(lists: DataFrame, labels: DataFrame) -> DataFrame:
    """Comparisons of the second round: (task, side, c, label)."""
    named = lists.select("g", "c").join(labels.select(F.col("node").alias("c"), "label"), "c", "left").withColumn("label", F.coalesce("label", "c"))
    per_label = named.groupBy("g", "label").agg(F.count(F.lit(1)).alias("k"), F.bit_xor(F.xxhash64("c")).alias("x"), F.bit_xor(F.xxhash64("c", F.lit(1))).alias("y"))
    per_list = per_label.groupBy("g").agg(F.max_by("label", F.struct("k", "label")).alias("main"), F.max("k").alias("inside"), F.sum("k").alias("all"), F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y")).where("inside < all")
    # lists with the same classes are compared once
    once = per_list.groupBy("x", "y", "all").agg(F.min(F.struct("g", "main", "inside")).alias("l")).select("l.g", "l.main", "l.inside", (F.col("all") - F.col("inside")).alias("outside"))
    rows = named.join(once, "g").withColumn("in", F.ceil(F.col("inside") / BLOCK)).withColumn("out", F.ceil(F.col("outside") / BLOCK)).withColumn("own", F.col("label") == F.col("main"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("c", F.lit(2)), F.when(F.col("own"), F.col("in")).otherwise(F.col("out"))))
    here, upto = F.col("block"), lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    task = lambda kind, i, j, side: F.struct(F.concat_ws(":", F.col("g"), F.lit(kind), i, j).alias("task"), F.lit(side).alias("side"))
    # a block outside the main component is on the left of all main blocks and of the outside blocks from itself on
    outside = F.concat(F.transform(upto("in"), lambda j: task("m", here, j, 0)), F.transform(F.sequence(here, F.col("out") - 1), lambda j: task("o", here, j, 0)), F.transform(F.sequence(F.lit(0).cast("long"), here), lambda i: task("o", i, here, 1)))
    inside = F.transform(upto("out"), lambda i: task("m", i, here, 1))
    return rows.select("c", "label", F.explode(F.when(F.col("own"), inside).otherwise(outside)).alias("t")).select("t.task", "t.side", "c", "label")


def _components_of_rows(docs: DataFrame, id_col: str, text_col: str, n: int, similarity: int) -> DataFrame:
    """Per row: id, h (hash of its text), n, first (smallest id of its component)."""
    i, t = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    source = docs.select(i.alias("id"), _row(i, t).alias("row"), F.xxhash64(t).alias("h"), t.alias("text"))
    rows = stage(measure(source, n), "sizes")
    total = rows.agg(F.sum("n")).first()[0] or 0
    shared = shared_counts(source, n, max(BUCKETS, -(-total // BUCKET_GRAMS)))
    keeper = rows.where("n > 0").groupBy("c", "n").agg(F.min("row").alias("row"))
    able = stage(keeper.join(shared, "c").where(F.col("shared") * 100 >= similarity * F.col("n")), "able")
    some = chosen(source, able.select("row", "shared"))
    order = frequent(repeated(some, n))
    posted = able.agg(F.sum(F.col("n") * (100 - similarity) / 100 + 1).cast("long")).first()[0] or 0
    buckets = max(1, -(-posted // BUCKET_POSTINGS))
    lists = stage(shared_lists(postings(some, n, similarity, order, buckets), buckets, similarity), "postings")

    def verified(pairs: DataFrame) -> DataFrame:
        """Those of the pairs (c, p) that link; a class p meets its partners in blocks."""
        sized = pairs.join(pairs.groupBy("p").agg(F.count(F.lit(1)).alias("k")), "p")
        sized = sized.select("c", "p", F.concat_ws(":", "p", F.pmod(F.xxhash64("c"), F.ceil(F.col("k") / BLOCK))).alias("task"))
        side = lambda who, s: sized.select("task", F.lit(s).alias("side"), F.col(who).alias("c"), F.col(who).alias("label"))
        tasks = stage(side("p", 0).distinct().union(side("c", 1)), "tasks")
        wanted = stage(able.join(tasks.select("c").distinct(), "c").select("row", "c"), "wanted")
        return stage(products(tasks, sets_of(source, wanted, n), similarity), "links")

    # First round: each class meets the pivot that it shares most lists with; pivots of the parts of a list meet the least one.
    met = lists.where("c <> p").groupBy("c", "p").agg(F.count(F.lit(1)).alias("k"))
    stars = met.groupBy("c").agg(F.max_by("p", F.struct("k", "p")).alias("p"))
    parts = lists.where("s > 0").select("g").distinct().join(lists.select("g", "s", "p").distinct(), "g")
    least = parts.groupBy("g").agg(F.min("p").alias("q"))
    stars = stars.union(parts.join(least, "g").where("p <> q").select(F.col("p").alias("c"), F.col("q").alias("p"))).distinct()
    links = verified(stars)

    # Second round: what is still apart in a list, first by prefixes, then whole. A label stands for its component.
    tasks = stage(_remaining(lists, components(links)), "tasks")
    apart = products(tasks, prefixes(lists), similarity, begun)
    more = verified(stage(apart.select(F.greatest("a", "b").alias("c"), F.least("a", "b").alias("p")).distinct(), "apart"))
    labels = stage(components(links.union(more)), "labels")

    named = rows.join(labels.select(F.col("node").alias("c"), "label"), "c", "left").select("id", "h", "n", F.when(F.col("n") > 0, F.coalesce("label", "c")).alias("label"))
    first = named.where("n > 0").groupBy("label").agg(F.min("id").alias("first"))
    return named.join(first, "label", "left").select("id", "h", "n", F.coalesce("first", "id").alias("first"))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, similarity: int = SIMILARITY) -> DataFrame:
    """Per row: id, n_shingles (size of its set), component_id (smallest id that links reach)."""
    rows = _components_of_rows(docs, id_col, text_col, n, similarity)
    return rows.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("first").alias("component_id"))


def first_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, similarity: int = SIMILARITY) -> DataFrame:
    """The document with the smallest id of each component, with all columns.

    Rows with the same id and text count as one document; rows without a word link with nothing and stay, as do
    components of null ids alone.
    """
    rows = _components_of_rows(docs, id_col, text_col, n, similarity)
    later = rows.where("n > 0 and not (id <=> first)").select("id", "h").distinct()
    same = F.col(f"`{id_col}`").eqNullSafe(later["id"]) & (F.xxhash64(F.col(f"`{text_col}`")) == later["h"])
    return docs.join(later, same, "left_anti")
