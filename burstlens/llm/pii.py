"""Personal data: fixed patterns, and a linear-chain conditional random field over word shapes.

The patterns give the base spans. The field labels words (runs without white space) as begin, inside or outside of each kind;
a word without a digit, an ``@`` or a written-out sign (``(at)``, ``[dot]``; the words beside it count too) can only be outside, a hard
constraint under which the chain falls into independent runs of the other words, so that decoding the runs is decoding the whole line.
Runs of equal length are decoded together by Viterbi in numpy. A decoded span is added if it has the digits or parts that its
kind needs and overlaps no base span; an email or address also if it contains base spans of its kind and is longer than each
(``o'neil@mail.example.com``, ``10.0.0.1:8080``).

The field is trained on a small labelled table: runs from at most ``SAMPLE_DOCS`` documents that hold a digit or ``@`` (those with
the smallest hash of text and id; texts are read for these alone), labelled by their base spans, and the hand-labelled ``FORMS``. Everything else reads all
documents, each whole.

Defined results: null and empty texts have no spans; repeated rows get equal spans; ties in Viterbi go to the label listed first; an
empty table trains on ``FORMS`` alone and returns no rows; only the id and text columns are read. All searches are linear in the
length of a text, whatever it holds.
"""

from __future__ import annotations

import ipaddress
import re
import zlib
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spans import Span, find_spans, sampled_texts

KINDS = ("email", "ip", "card", "phone")
LABELS = ("O", *[f"{p}-{k}" for k in KINDS for p in "BI"])
FEATURES = 1 << 13
SAMPLE_DOCS = 400
SAMPLE_RUNS = 4_000

MARKED = re.compile(r"[0-9@]|[(\[{](?:at|AT|At)[)\]}]")
# A word with a digit or @; tried at starts of words only, so long words cost their length.
WORD = re.compile(r"(?<!\S)[^\s0-9@]*[0-9@]\S*")
# Words around a written-out sign, and words that hold one.
SIGN = r"[(\[{](?:at|AT|At|dot|DOT|Dot)[)\]}]"
SPELT = re.compile(rf"(?<!\S)\S++(?:[\x20\t]{{1,2}}{SIGN}[\x20\t]{{1,2}}\S++)+")
JOINED = re.compile(rf"{SIGN}")
MAILBOX = re.compile(r"[A-Za-z0-9._%+'!#$*^`{|}~-]+@(?:[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+|[A-Za-z][A-Za-z0-9-]*)")
HOST = re.compile(r"([0-9]{1,3}(?:\.[0-9]{1,3}){3})(?::([0-9]{1,5})|/([0-9]{1,2}))?")
SIX = re.compile(r"[0-9A-Fa-f:]{5,39}(?:/[0-9]{1,3})?")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A number cannot begin inside a run of digits whose start did not fit: same matches, linear time.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Hand-labelled forms that the base patterns miss or cut; each is one run: (words, kind or None).
FORMS: tuple[tuple[str, str | None], ...] = (
    ("(212) 555-0143", "phone"), ("212-555-0143", "phone"), ("212.555.0143", "phone"), ("(020) 7946 0018", "phone"), ("0044 20 7946 0018", "phone"),
    ("001-212-555-0143", "phone"), ("tel:212-555-0143", "phone"), ("(523) 555-1055.", "phone"), ("0171 5550143", "phone"), ("06 12 34 56 78", "phone"),
    ("(771) 555-1655", "phone"), ("310-555-4510", "phone"), ("521.555.6210", "phone"), ("1-800-555-0199", "phone"), ("(030) 5550-1234", "phone"),
    ("o'neil.x@mail.example.com", "email"), ("<user7@host.example.org>", "email"), ("user@localhost", "email"), ("mailto:a.b@c.example.net", "email"), ("user#1@mail5.example.com,", "email"),
    ("4012.8888.8888.1881", "card"), ("4012/8888/8888/1881", "card"), ("10.0.0.1:8080", "ip"), ("192.168.0.0/16", "ip"), ("[172.16.254.1]", "ip"),
    ("172.16.5.9:443", "ip"), ("10.20.0.0/8", "ip"), ("2001:db8::8a2e:370:7334", "ip"), ("fe80::1ff:fe23:4567:890a", "ip"), ("2001:db8:85a3:8d3:1319:8a2e:370:7348", "ip"),
    ("[2001:db8::1]", "ip"), ("fd12:3456:789a:1::1", "ip"), ("2001:db8::/32", "ip"), ("fe80::2ab:cd:fe12:34a6", "ip"), ("2001:db8:0:0:8:800:200c:417a", "ip"), ("2001:db8:a::99", "ip"), ("00:1B:44:11:3A:B7", None), ("1:2:3:4", None), ("std::vector2", None),
    ("john (at) example (dot) com", "email"), ("mary.b [at] mail [dot] example [dot] org", "email"), ("info(at)example.net", "email"), ("sales[at]example[dot]com", "email"),
    ("j.doe (AT) example.org", "email"), ("o'brien7@host.example.com", "email"), ("root@localhost", "email"), ("admin@intranet", "email"),
    ("noon (at) home", None), ("lunch [at] 12:30", None), ("polka (dot) dress", None),
    ("2024", None), ("1984", None), ("3.14", None), ("12:30", None), ("2024-05-01", None), ("2.0", None), ("1,000", None), ("100%", None), ("v1.2.3", None),
    ("2.0.", None), ("page=12", None), ("$19.99", None), ("(1)", None), ("[12]", None), ("A4", None), ("3rd", None), ("10:15:20", None), ("#42", None),
    ("1 2 3 4", None), ("10 20 30", None), ("1995 1996 1997", None), ("2024-05-01 12:30:00", None), ("@user", None), ("@home", None), ("x@", None),
    ("123456", None), ("0x1f", None), ("12345678", None), ("4026083977531332", None), ("4785380592391139", None), ("24be64439e3e49cf46b2d7c90f3602a3d0b907ff", None),
)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[Span]:
    found: list[Span] = []
    at, end = text.find("@"), 0
    while at >= 0:
        first = at
        while first > end and text[first - 1] in LOCAL:
            first -= 1
        m = DOMAIN.match(text, at) if first < at else None
        if m:
            end = m.end()
            found.append(("email", first, end))
        at = text.find("@", max(at + 1, end))
    for m in IP.finditer(text):
        if all(len(p := x.lstrip("0")) <= 3 and int(p or "0") <= 255 for x in m[0].split(".")):
            found.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := digits_of(m[0])) <= 19 and luhn(d):
            found.append(("card", *m.span()))
    for m in PHONE.finditer(text):
        if 10 <= len(digits_of(m[0])) <= 15:
            found.append(("phone", *m.span()))
    return found


def runs_of(text: str) -> list[list[tuple[int, int]]]:
    """Runs of neighbouring marked words on a line, as (start, end) of each word."""
    runs: list[list[tuple[int, int]]] = []
    last = -1
    words = [m.span() for m in WORD.finditer(text)]
    spelt = spelt_words(text)
    for a, b in sorted({*words, *spelt}) if spelt else words:
        gap = text[last:a] if last >= 0 else "\n"
        if len(gap) <= 4 and gap.isspace() and "\n" not in gap:
            runs[-1].append((a, b))
        else:
            runs.append([(a, b)])
        last = b
    return runs


def spelt_words(text: str) -> list[tuple[int, int]]:
    """Words that hold or stand beside a written-out sign, as (start, end)."""
    out = []
    end = 0
    for m in JOINED.finditer(text):
        if m.start() < end:
            continue
        a, end = m.span()
        while a > 0 and not text[a - 1].isspace():
            a -= 1
        while end < len(text) and not text[end].isspace():
            end += 1
        out.append((a, end))
    if out:
        for m in SPELT.finditer(text):
            out += [(m.start() + w.start(), m.start() + w.end()) for w in re.finditer(r"\S+", m[0])]
    return out


def shape(word: str) -> str:
    """Letters to a or A, digits to 0, runs of a sign shortened to one."""
    kinds = "".join("0" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else c for c in word)
    return re.sub(r"(.)\1+", r"\1", kinds)


def features(words: list[str]) -> list[list[int]]:
    """Hashed features of each word of a run: its shape, its counts, and the shapes beside it."""
    shapes = ["<", *[shape(w) for w in words], ">"]
    rows = []
    for i, w in enumerate(words, 1):
        digits = digits_of(w)
        s = shapes[i]
        named = ["1", f"s{s}", f"p{shapes[i - 1]}|{s}", f"n{s}|{shapes[i + 1]}", f"d{min(len(digits), 20)}|{s}", f"c{min(len(digits), 20)}",
                 f"l{min(len(w), 30)}", f"a{'@' in w}{'.' in w.rpartition('@')[2]}", f"h{s[0]}", f"t{s[-1]}"]
        if ":" in w:
            named.append(f"x{min(w.count(':'), 8)}{'::' in w}{SIX.fullmatch(w.strip('[]')) is not None}")
        if JOINED.search(w):
            named.append(f"o{JOINED.fullmatch(w) is not None}{'.' in w}")
        if 14 <= len(digits) <= 19:
            named.append(f"k{luhn(digits)}")
        rows.append([zlib.crc32(n.encode()) % FEATURES for n in named])
    return rows


ALLOWED = np.array([[b == "O" or b[0] == "B" or a[2:] == b[2:] and a != "O" for b in LABELS] for a in LABELS])
BEGIN = np.array([not x.startswith("I") for x in LABELS])


class Field:
    """Weights of the features, of transitions, and the training of both."""

    def __init__(self) -> None:
        self.w = np.zeros((FEATURES, len(LABELS)))
        self.t = np.zeros((len(LABELS), len(LABELS)))

    def scores(self, batch: list[list[list[int]]]) -> np.ndarray:
        """(runs, words, labels) for runs of one length."""
        return np.array([[self.w[f].sum(0) for f in run] for run in batch])

    def decode(self, batch: list[list[list[int]]]) -> np.ndarray:
        """Best labels, by Viterbi over all runs of one length at once."""
        s = self.scores(batch)
        moves = np.where(ALLOWED, self.t, -1e9)
        best = s[:, 0] + np.where(BEGIN, 0, -1e9)
        back = []
        for i in range(1, s.shape[1]):
            reach = best[:, :, None] + moves
            back.append(reach.argmax(1))
            best = reach.max(1) + s[:, i]
        path = [best.argmax(1)]
        for b in reversed(back):
            path.append(b[np.arange(len(b)), path[-1]])
        return np.array(path[::-1]).T

    def fit(self, runs: list[tuple[list[list[int]], list[int]]], rounds: int = 40, rate: float = 0.5, decay: float = 1e-4) -> Field:
        """Gradient ascent on the log likelihood, with steps scaled by the gradients so far."""
        by_length = defaultdict(list)
        for f, y in runs:
            by_length[len(y)].append((f, y))
        seen_w, seen_t = np.full_like(self.w, 1e-6), np.full_like(self.t, 1e-6)
        moves_off = np.where(ALLOWED, 0, -1e9)
        for _ in range(rounds):
            gw, gt = -decay * len(runs) * self.w, -decay * len(runs) * self.t
            for n, group in by_length.items():
                s = self.scores([f for f, _ in group])
                y = np.array([y for _, y in group])
                m = self.t + moves_off
                fwd, bwd = [s[:, 0] + np.where(BEGIN, 0, -1e9)], [np.zeros_like(s[:, 0])]
                for i in range(1, n):
                    fwd.append(np.logaddexp.reduce(fwd[-1][:, :, None] + m, axis=1) + s[:, i])
                    bwd.append(np.logaddexp.reduce((bwd[-1] + s[:, n - i])[:, None, :] + m, axis=2))
                bwd.reverse()
                z = np.logaddexp.reduce(fwd[-1], axis=1)
                for i in range(n):
                    miss = -np.exp(fwd[i] + bwd[i] - z[:, None])
                    miss[np.arange(len(y)), y[:, i]] += 1
                    for row, (f, _) in zip(miss, group):
                        np.add.at(gw, f[i], row)
                    if i:
                        gt -= np.exp(fwd[i - 1][:, :, None] + m + (s[:, i] + bwd[i] - z[:, None])[:, None, :]).sum(0)
                        np.add.at(gt, (y[:, i - 1], y[:, i]), 1)
            seen_w += gw * gw
            seen_t += gt * gt
            self.w += rate * gw / np.sqrt(seen_w)
            self.t += rate * gt / np.sqrt(seen_t)
        return self


def labelled(text: str) -> list[tuple[list[str], list[str]]]:
    """Runs of a text as words with labels taken from the base spans."""
    spans = base_spans(text)
    out = []
    for run in runs_of(text):
        labels, before = [], None
        for a, b in run:
            hit = next((s for s in spans if s[1] < b and a < s[2]), None)
            labels.append("O" if hit is None else ("I-" if hit == before else "B-") + hit[0])
            before = hit
        out.append(([text[a:b] for a, b in run], labels))
    return out


def sample_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> list[tuple[list[str], list[str]]]:
    """The labelled table: runs of at most ``SAMPLE_DOCS`` documents, at most ``SAMPLE_RUNS`` in all."""
    out: list[tuple[list[str], list[str]]] = []
    for text in sampled_texts(docs, F.col(f"`{text_col}`").rlike("[0-9@]"), id_col, text_col, SAMPLE_DOCS):
        out += labelled(text)[: SAMPLE_RUNS - len(out)]
    return out


def train(runs: list[tuple[list[str], list[str]]]) -> Field:
    forms = [(w.split(), [("B-" if i == 0 else "I-") + k if k else "O" for i in range(len(w.split()))]) for w, k in FORMS]
    # Long runs of numbers add little; the field sees their first words.
    table = [(w[:12], y[:12]) for w, y in runs] + forms * max(1, len(runs) // (2 * len(forms)))
    return Field().fit([(features(w), [LABELS.index(x) for x in y]) for w, y in table])


def _six(text: str) -> bool:
    try:
        return ipaddress.ip_interface(text).version == 6
    except ValueError:
        return False


def _free(kind: str, a: int, b: int, base: list[Span]) -> bool:
    """No base span overlaps, or it is shorter, of the same kind and inside an email or address."""
    return all(e <= a or b <= s or kind in ("email", "ip") and k == kind and a <= s and e <= b and e - s < b - a for k, s, e in base)


def _plausible(kind: str, text: str) -> bool:
    n = len(digits_of(text))
    if kind == "email":
        if JOINED.search(text):
            said = re.sub(r"\s*[(\[{]at[)\]}]\s*", "@", re.sub(r"\s*[(\[{]dot[)\]}]\s*", ".", text, flags=re.I), flags=re.I)
            return MAILBOX.fullmatch(said) is not None and "." in said.rpartition("@")[2]
        return MAILBOX.fullmatch(text) is not None
    if kind == "ip":
        if m := HOST.fullmatch(text):
            return all(int(p) <= 255 for p in m[1].split(".")) and int(m[2] or 0) <= 65535 and int(m[3] or 0) <= 32
        return SIX.fullmatch(text) is not None and text.count(":") > 1 and sum(c.isalnum() for c in text) >= 5 and _six(text)
    if kind == "card":
        return 14 <= n <= 19 and luhn(digits_of(text))
    return 10 <= n <= 15 and re.fullmatch(r"(?:[a-z]{1,4}:)?[+(]?[0-9][-0-9().\x20/]*[0-9]", text) is not None


def added_spans(texts: list[str], base: list[list[Span]], field: Field) -> list[list[Span]]:
    """Spans that the field finds beside the base spans, for a batch of texts."""
    jobs = defaultdict(list)
    for i, text in enumerate(texts):
        if MARKED.search(text):
            for run in runs_of(text):
                jobs[len(run)].append((i, run))
    out: list[list[Span]] = [[] for _ in texts]
    for n, group in jobs.items():
        step = max(1, 4096 // n)
        for k in range(0, len(group), step):
            part = group[k : k + step]
            labels = field.decode([features([texts[i][a:b] for a, b in run]) for i, run in part])
            for (i, run), row in zip(part, labels):
                w = 0
                while w < n:
                    name = LABELS[row[w]]
                    first = w
                    w += 1
                    if name == "O":
                        continue
                    while w < n and LABELS[row[w]] == "I-" + name[2:]:
                        w += 1
                    a, b = run[first][0], run[w - 1][1]
                    if texts[i][a : a + 7].lower() == "mailto:":
                        a += 7
                    while b > a and texts[i][b - 1] in ".,;:!?)>]\"'" and not (texts[i][b - 1] == ")" and "(" in texts[i][a + 1 : b]):
                        b -= 1
                    while a < b and texts[i][a] in ("(<[\"'" if name[2:] in ("email", "ip") else "<[\"'"):
                        a += 1
                    if _plausible(name[2:], texts[i][a:b]) and _free(name[2:], a, b, base[i]):
                        out[i].append((name[2:], a, b))
    return out


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", runs: list[tuple[list[str], list[str]]] | None = None) -> DataFrame:
    """Per row: id, text, base and added spans. ``runs`` is the labelled table; by default it is sampled from ``docs``."""
    field = train(sample_runs(docs, id_col, text_col) if runs is None else runs)
    shared = docs.sparkSession.sparkContext.broadcast((field.w.astype(np.float32), field.t))

    def finder():
        model = Field()
        model.w, model.t = shared.value

        def find(texts: list[str]) -> list[tuple[list[Span], list[Span]]]:
            base = [base_spans(t) if MARKED.search(t) else [] for t in texts]
            return list(zip(base, added_spans(texts, base, model)))

        return find

    return find_spans(docs, finder, id_col, text_col)
