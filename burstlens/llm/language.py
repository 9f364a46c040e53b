"""Language by nearest centroid of TF-IDF character n-gram vectors.

Texts are lower-cased, everything but letters becomes one space, and runs of one to three characters are counted in
``DIMENSIONS`` hashed cells, over the whole text. Cell weights are log term frequency times inverse document frequency, scaled to
length one. The document frequencies cover all learned rows; the centroids (several per language, by spherical k-means) are fitted
on at most ``SAMPLE_PER_LANGUAGE`` labelled rows of each language and ``SAMPLE_ROWS`` in all, those with the smallest hash of
their id. A text gets the language of the centroid with the largest cosine; it is marked rejected when its distance is beyond
nearly all distances of that language's sample.

Defined results: null texts and texts without a letter are ``und`` with score 0 and rejected; a row with a null language or id is never learned from
(a null id is not held out); ties go to the language that sorts first; without any learnable row every text is ``und``;
repeated rows get equal predictions; only id, text and language columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIMENSIONS = 4096
SAMPLE_PER_LANGUAGE = 500
SAMPLE_ROWS = 4_000
CENTROIDS = 4
CHUNK = 256

_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Which code points are letters; made once per process."""
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


def counts(text: str | None) -> np.ndarray | None:
    """n-gram counts per cell, or None without letters."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = letters()[codes]
    if not is_letter.any():
        return None
    codes = np.where(is_letter, codes, np.uint32(32))
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]
    c = np.concatenate(([np.uint32(32)], codes[keep], [np.uint32(32)]))
    one = c * np.uint32(2654435761)
    two = one[:-1] * np.uint32(31) + one[1:] * np.uint32(2246822519)
    three = two[:-1] * np.uint32(37) + one[2:] * np.uint32(3266489917)
    total = np.zeros(DIMENSIONS, np.int64)
    for x in (one, two, three):
        total += np.bincount((x ^ (x >> np.uint32(15))) >> np.uint32(20), minlength=DIMENSIONS)
    return total


def vectors(texts: list[str | None], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of length one (zero without letters), and which texts have letters."""
    rows = np.zeros((len(texts), DIMENSIONS), np.float32)
    known = np.zeros(len(texts), bool)
    for i, t in enumerate(texts):
        n = counts(t)
        if n is not None:
            known[i] = True
            rows[i] = np.log1p(n)
    rows *= idf
    rows /= np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)
    return rows, known


def document_frequency(rows: DataFrame) -> tuple[np.ndarray, int]:
    """Documents per cell over all rows, and their number; each task sends one vector."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros(DIMENSIONS, np.int64), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                c = counts(text)
                if c is not None:
                    seen += c > 0
                    n += 1
        yield pa.RecordBatch.from_arrays([pa.array(range(DIMENSIONS + 1), pa.int32()), pa.array(np.append(seen, n))], names=["cell", "n"])

    parts = rows.select("text").mapInArrow(count, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    out = np.zeros(DIMENSIONS + 1, np.int64)
    for r in parts.collect():
        out[r["cell"]] = r["n"]
    return out[:-1], int(out[-1])


def sample(rows: DataFrame) -> list[tuple[str, str]]:
    """(language, text) of a bounded number of rows per language, by the smallest hash of the id."""
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(SAMPLE_ROWS).collect()}
    if not sizes:
        return []
    each = max(1, min(SAMPLE_PER_LANGUAGE, SAMPLE_ROWS // len(sizes)))
    # A share of each language somewhat above what is kept; the rest of the choice is among so few rows.
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, (3 * each + 50) / n))])[F.col("lang")]
    h = F.xxhash64(F.col("id").cast("string"), F.lit(7))
    near = rows.withColumn("h", h).where((F.pmod("h", F.lit(1_000_003)) / F.lit(1_000_003.0)) < share)
    picked = near.select("lang", "text", "h", F.expr("row_number() over (partition by lang order by h, text)").alias("k")).where(F.col("k") <= each)
    return [(r["lang"], r["text"]) for r in picked.orderBy("lang", "k").toLocalIterator()]


def cluster(rows: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means, begun from rows far from those chosen before."""
    chosen = [rows.mean(0)]
    while len(chosen) < min(k, len(rows)):
        chosen.append(rows[(rows @ np.array(chosen).T).max(1).argmin()])
    centres = np.array(chosen)
    for _ in range(15):
        nearest = (rows @ centres.T).argmax(1)
        centres = np.array([rows[nearest == j].sum(0) if (nearest == j).any() else centres[j] for j in range(len(centres))])
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-9)
    return centres


def fit(labelled: list[tuple[str, str]], df: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, list[str], np.ndarray]:
    """idf, centroids, their languages, and the largest distance that is not rejected, per centroid."""
    idf = np.log((1 + n) / (1 + df)).astype(np.float32) + 1
    centres, names, limits = [], [], []
    for lang in sorted({x for x, _ in labelled}):
        rows, known = vectors([t for x, t in labelled if x == lang], idf)
        rows = rows[known]
        if len(rows):
            c = cluster(rows, CENTROIDS)
            far = 1 - (rows @ c.T).max(1)
            centres.append(c)
            names += [lang] * len(c)
            limits += [min(1.0, float(np.quantile(far, 0.995)) + 0.05)] * len(c)
    return idf, np.vstack(centres) if centres else np.zeros((0, DIMENSIONS), np.float32), names, np.array(limits)


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string")) % 5 == 0, F.lit(False))


def languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Per row: id, held_out, lang_pred, score (cosine, 0 to 1) and rejected."""
    i, t = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    learn = docs.select(i.alias("id"), t.alias("text"), F.col(f"`{lang_col}`").alias("lang")).where(~held_out(i) & i.isNotNull() & F.col("lang").isNotNull() & t.isNotNull())
    df, n = document_frequency(learn)
    shared = docs.sparkSession.sparkContext.broadcast(fit(sample(learn), df, n))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, centres, names, limits = shared.value
        for batch in batches:
            best, score, far = [], [], []
            texts = batch.column(2).to_pylist()
            for k in range(0, len(texts), CHUNK):
                rows, known = vectors(texts[k : k + CHUNK], idf)
                for row, ok in zip(rows @ centres.T, known):
                    c = int(row.argmax()) if ok and names else -1
                    best.append(names[c] if c >= 0 else "und")
                    score.append(float(min(1.0, max(0.0, row[c]))) if c >= 0 else 0.0)
                    far.append(c < 0 or 1 - row[c] > limits[c])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(best, pa.string()), pa.array(score, pa.float64()), pa.array(far, pa.bool_())], names=[id_col, "held_out", "lang_pred", "score", "rejected"])

    kind = docs.select(i).schema[0].dataType.simpleString()
    return docs.select(i.alias(id_col), held_out(i).alias("held_out"), t.alias("text")).mapInArrow(predict, f"`{id_col}` {kind}, held_out boolean, lang_pred string, score double, rejected boolean")
