"""Fixtures and plain restatements that the operators are tested against."""

import random
import re

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}
EXTRA = ("h", "line", "row", "c", "n", "k", "g", "base", "spans", "slice", "failed", "hits_0", "items", "n_words")


def prose(seed: int, n: int, vocabulary: int = 40) -> str:
    r = random.Random(seed)
    words = [f"{'abcdefgh'[i % 8]}{'stuvw'[i % 5]}{'Éxyz'[i % 4]}{i}" if i % 3 else f"{'klmno'[i % 5]}or" for i in range(vocabulary)]
    return " ".join(r.choice(words) + r.choice(["", "", ",", ".\n"]) for _ in range(n))


def edited(text: str, seed: int, share: float) -> str:
    r = random.Random(seed)
    return " ".join(w if r.random() > share else f"new{r.randrange(1000)}" for w in text.split(" "))


def edge_rows() -> list[tuple]:
    """Ids and texts with nulls, empty and long texts, copies, repeated rows."""
    base = prose(1, 120)
    rows = [(1, base), (2, base), (2, base), (3, edited(base, 2, 0.01)), (4, edited(base, 3, 0.3)), (5, None), (6, ""), (7, "  \n\t\n "), (8, "one"),
            (9, "One"), (10, "one two three"), (None, base), (None, None), (11, prose(4, 6000, 400)), (12, "x" * 50_000), (13, "-".join(["1"] * 3000))]
    return rows + [(20 + i, edited(prose(i % 4 + 10, 60), i, 0.04 * (i % 3))) for i in range(30)]


def frame(spark, rows, id_col="doc_id"):
    """A table of the rows with further columns whose names the operators use inside."""
    wide = [(i, t, "en", *[f"{c}-{k}" for c in EXTRA]) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(wide, f"{id_col} long, text string, lang string, " + ", ".join(f"`{c}` string" for c in EXTRA)).repartition(3)


def sets(text, n=5):
    w = SPACED.findall((text or "").translate(LOWER))
    return frozenset([tuple(w)] if 0 < len(w) < n else zip(*[w[i:] for i in range(n)]))


def similar(a, b):
    return bool(a) and bool(b) and 100 * len(a & b) >= 75 * len(a | b)


def components(rows):
    """(id, set size, smallest reachable id) per row, by comparing all pairs."""
    all_sets = [sets(t) for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if similar(all_sets[i], all_sets[j]):
                a, b = label[i], label[j]
                label = [b if x == a else x for x in label]
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if label[j] == label[i] and rows[j][0] is not None]
        out.append((d, len(all_sets[i]), min(ids) if ids and all_sets[i] else d))
    return out


def key(row):
    return tuple((x is not None, x if x is not None else 0) for x in row)
