"""Secrets: fixed patterns, and two character Markov models compared by log-likelihood ratio.

The patterns give the base spans. One model is trained on random strings, the other on ordinary words and identifiers, both first
order over letters, digits and ``+/_=-``. A run of 20 or more such characters with a letter and a digit is added if
the mean log-likelihood ratio per character lies above a threshold set between the two kinds of labelled samples, and it
overlaps no base span. Of other runs of 12 or more, the pieces between the signs ``+/_=-`` and numbers of five or more digits are
judged, so that a key at the end of a path or link counts by itself: a piece of 12 or more letters and digits, not digits alone, is
added if its mean lies ``DEVIATIONS`` standard errors above that of ordinary words. The error shrinks with the length, so a short
piece needs a higher mean. Pieces in one case, or capitalised, are read in lower case.

The labelled samples: the values of base spans (random) and the other words of six or more letters (ordinary) of at most
``SAMPLE_DOCS`` documents that match a base pattern (those with the smallest hash), with the written ``IDENTIFIERS``. Everything else
reads all documents, each whole.

Defined results: null and empty texts have no spans; repeated rows get equal spans; a ratio equal to the threshold is not
added; an empty table trains on ``IDENTIFIERS`` against uniformly random strings and returns no rows; only the id and text columns are
read. All searches are linear in the length of a text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spans import Span, find_spans, sampled_texts

KINDS = ("assign", "access", "hex", "random")
SAMPLE_DOCS = 300
SAMPLE_WORDS = 20_000

ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
RUN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{12,}")
PIECE = re.compile(r"(?:[A-Za-z]|[0-9]{1,4}(?![0-9]))+")
WHOLE, SHORTEST = 20, 12
DEVIATIONS = 5.0
NAMES = ("passw", "secret", "token", "api")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
CODE = np.full(128, len(ALPHABET), np.int64)
CODE[[ord(c) for c in ALPHABET]] = np.arange(len(ALPHABET))

# Ordinary identifiers, as found in programs, paths and links.
IDENTIFIERS: tuple[str, ...] = (
    "get_user_name_by_id", "max_partition_bytes", "readStreamFromTable2", "utf8_general_ci", "application/octet-stream", "content-type-options",
    "HTTP_ACCEPT_LANGUAGE", "createDataFrameFromRows", "test_case_number_12", "en_US_UTF-8", "index_column_2024", "document-title-header1",
    "user/local/share/python3", "images/banner-large-2x", "chapter_03_section_2", "releases/download/v2", "total_price_with_tax", "isEmptyOrWhitespace",
    "session_window_duration", "x86_64-linux-gnu", "build-2024-05-01", "ISO_8859_1", "base64_encode_string", "sha256_of_document", "node_modules/package",
    "last_modified_timestamp", "backgroundColorPrimary", "articles/2024/05/spring-news", "customer_order_line_items", "mail-server-01-backup",
)


def base_spans(text: str) -> list[Span]:
    found: list[Span] = []
    lowered = text.lower() if "=" in text or ":" in text else ""
    if lowered and any(n in lowered for n in NAMES):
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    return found


@dataclass
class Ratio:
    """Log ratio of the two models per character pair, the threshold of whole runs, and mean and deviation of a pair in ordinary words."""

    table: np.ndarray
    threshold: float
    usual: float = 0.0
    spread: float = 1.0

    def mean(self, text: str) -> float:
        codes = CODE[np.frombuffer(text.encode("ascii"), np.uint8)]
        return float(self.table[codes[:-1], codes[1:]].mean())

    def is_random(self, piece: str) -> bool:
        """Whether a piece lies far enough above ordinary words of its length."""
        plain = piece.lower() if piece.isupper() or piece[1:].islower() else piece
        return self.mean(plain) > self.usual + DEVIATIONS * self.spread / (len(piece) - 1) ** 0.5


def transitions(samples: list[str]) -> np.ndarray:
    """Log probability of a character after another; half a count for those not seen."""
    n = len(ALPHABET)
    counts = np.full((n, n), 0.5)
    for s in samples:
        codes = CODE[np.frombuffer(s.encode("ascii"), np.uint8)]
        np.add.at(counts, (codes[:-1], codes[1:]), 1)
    return np.log(counts / counts.sum(1, keepdims=True))


def train(random: list[str], ordinary: list[str]) -> Ratio:
    """The ratio table, with the threshold half-way between high ordinary and low random samples, and above the former."""
    drawn = np.random.default_rng(0)
    # Uniform strings of usual alphabets, so that kinds of secrets that the sample lacks are known too.
    for letters in (ALPHABET[:62], ALPHABET[26:62], ALPHABET[:64], ALPHABET[:26] + ALPHABET[52:62]):
        random = [*random, *["".join(letters[i] for i in drawn.integers(0, len(letters), 40)) for _ in range(300)]]
    ordinary = [*ordinary, *IDENTIFIERS]
    ratio = Ratio(transitions(random) - transitions(ordinary), 0.0)
    high = np.quantile([ratio.mean(s) for s in ordinary if len(s) >= 12] or [0.0], 0.999)
    low = np.quantile([ratio.mean(s) for s in random if len(s) >= 12], 0.05)
    ratio.threshold = float(max((high + low) / 2, 0.0))
    codes = [CODE[np.frombuffer(s.encode("ascii"), np.uint8)] for s in ordinary]
    pairs = np.concatenate([ratio.table[c[:-1], c[1:]] for c in codes])
    ratio.usual, ratio.spread = float(pairs.mean()), float(pairs.std())
    return ratio


def samples(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[list[str], list[str]]:
    """Labelled strings (random, ordinary) of at most ``SAMPLE_DOCS`` documents with a base match."""
    text = F.col(f"`{text_col}`")
    matched = text.rlike(r"AKIA[A-Z0-9]{16}|[0-9a-f]{24}") | text.rlike(r"(?i)(?:passw|secret|token|api_?key)[a-z]*[\"']?\x20*[:=]")
    random: list[str] = []
    ordinary: list[str] = []
    for found in sampled_texts(docs, matched, id_col, text_col, SAMPLE_DOCS):
        spans = base_spans(found)
        for kind, a, b in spans:
            value = ASSIGN.match(found[a:b])[1] if kind == "assign" else found[a:b]
            random += re.findall("[A-Za-z0-9+/_=-]{6,}", value)[: SAMPLE_WORDS - len(random)]
        words = re.findall("[A-Za-z_-]{6,}", found)
        ordinary += [w for w in words if not any(w in found[a:b] for _, a, b in spans)][: SAMPLE_WORDS - len(ordinary)]
    return random, ordinary


def added_spans(text: str, base: list[Span], ratio: Ratio) -> list[Span]:
    def free(a: int, b: int) -> bool:
        return all(e <= a or b <= s for _, s, e in base)

    out = []
    for m in RUN.finditer(text):
        a, b = m.span()
        run = m[0]
        digit = any(c.isdigit() for c in run)
        if b - a >= WHOLE and digit and any(c.isalpha() for c in run) and free(a, b) and ratio.mean(run) > ratio.threshold:
            out.append(("random", a, b))
            continue
        for p in PIECE.finditer(run):
            first, last = a + p.start(), a + p.end()
            if last - first >= SHORTEST and not p[0].isdigit() and free(first, last) and ratio.is_random(p[0]):
                out.append(("random", first, last))
    return out


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", labelled: tuple[list[str], list[str]] | None = None) -> DataFrame:
    """Per row: id, text, base and added spans. ``labelled`` is (random, ordinary) strings; by default sampled from ``docs``."""
    ratio = train(*(samples(docs, id_col, text_col) if labelled is None else labelled))
    shared = docs.sparkSession.sparkContext.broadcast((ratio.table, ratio.threshold, ratio.usual, ratio.spread))

    def finder():
        model = Ratio(*shared.value)

        def find(texts: list[str]) -> list[tuple[list[Span], list[Span]]]:
            out = []
            for text in texts:
                base = base_spans(text)
                out.append((base, added_spans(text, base, model)))
            return out

        return find

    return find_spans(docs, finder, id_col, text_col)
