import zlib
from collections import defaultdict

import numpy as np
import pytest
from helpers import edge_rows, frame

from burstlens.llm import packing
from burstlens.llm.queries import ranks_path


def test_ids_equal_the_tokenizer():
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    encode = packing.encoder(ranks_path())
    texts = [x or "" for _, x in edge_rows()] + ["a  b\t\tc\u00a0 d\x1c e\r\n f", "it's <|endoftext|> 12'll   ", "日本語 🙂 ¿qué?"]
    for x in texts:
        assert np.frombuffer(encode(x), "<u4").tolist() == t.encode(x, add_special_tokens=False).ids


@pytest.mark.parametrize("group", [8192, 5])
def test_pieces_and_places(spark, monkeypatch, group):
    monkeypatch.setattr(packing, "GROUP_PIECES", group)
    rows = [(k, t) for k, (_, t) in enumerate(edge_rows())]
    got = packing.pack(frame(spark, rows), ranks_path(), capacity=256).collect()
    encode, by_doc, by_sequence = packing.encoder(ranks_path()), defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for k, t in rows:
        ids = encode(t) + packing.END
        parts = sorted(by_doc[k], key=lambda r: r.piece)
        assert [r.start for r in parts] == [sum(x.length for x in parts[:i]) for i in range(len(parts))] and sum(r.length for r in parts) * 4 == len(ids)
        assert all(r.length == 256 for r in parts[1:]) and all(r.ids_crc32 == zlib.crc32(ids[4 * r.start : 4 * (r.start + r.length)]) for r in parts)
    for parts in by_sequence.values():
        parts.sort(key=lambda r: r.offset)
        assert [r.offset for r in parts] == [sum(x.length for x in parts[:i]) for i in range(len(parts))] and sum(r.length for r in parts) <= 256
    least = -(-sum(r.length for r in got) // 256)
    assert len(by_sequence) <= least * 1.2 + 1
    assert packing.pack(frame(spark, rows).limit(0), ranks_path()).count() == 0


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_every_capacity_holds(rule):
    r = np.random.default_rng(1)
    tokens = r.integers(1, 100, 500)
    sizes = np.stack((tokens, np.ones(500), tokens**2), 1).astype(float)
    limits = np.array([100.0, 3.0, 4000.0])
    sizes = sizes[(sizes <= limits).all(1)]
    which, place = packing.best_fit(sizes, limits, np.array([1.0, 0.1, 0.1]), rule)
    for b in range(which.max() + 1):
        mine = which == b
        assert mine.any() and (sizes[mine].sum(0) <= limits).all()
        o = place[mine].argsort()
        assert (place[mine][o] == np.append(0, sizes[mine, 0][o].cumsum()[:-1])).all()


def test_ids_come_back(spark):
    docs = frame(spark, edge_rows()[:4])
    for r in packing.pieces(docs, ranks_path(), with_ids=True).collect():
        assert len(r.ids) == r.length and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32


def test_long_white_space(spark):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    encode = packing.encoder(ranks_path())
    long = packing.LONG_RUN
    texts = [" " * 2_000_000, "a" + " " * 1_500_000 + "b c", "\n" * 1_200_000 + "x", "a  " * 3 + "\t 　\u0085" * long + "<|endoftext|>  d" + " " * long + "\x1c.", " " * long + "é" + " " * (long - 1) + "!" + " " * (2 * long)]
    for x in texts:
        assert np.frombuffer(encode(x), "<u4").tolist() == t.encode(x, add_special_tokens=False).ids
    docs = frame(spark, list(enumerate(texts)))
    got = packing.pack(docs, ranks_path()).collect()
    assert sum(r.length for r in got if r.doc_id == 0) == len(encode(texts[0])) // 4 + 1


def naive_fit(sizes, limits, weights, rule):
    """One open bin after another is tried for every row."""
    bins, which, place = [], [0] * len(sizes), [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i][0]):
        best = None
        for j, left in enumerate(bins):
            if all(a >= x for a, x in zip(left, sizes[i])):
                rest = sum(w * ((a - x) / m) ** 2 for a, x, m, w in zip(left, sizes[i], limits, weights))
                dot = -sum(w * a * x / m**2 for a, x, m, w in zip(left, sizes[i], limits, weights))
                score = rest if rule == "norm" else dot
                if best is None or score < best[0] - 1e-12:
                    best = (score, j)
        if best is None:
            bins.append(list(limits))
        j = best[1] if best else len(bins) - 1
        which[i], place[i] = j, limits[0] - bins[j][0]
        bins[j] = [a - x for a, x in zip(bins[j], sizes[i])]
    return which, place


@pytest.mark.parametrize("rule", ["norm", "dot"])
@pytest.mark.parametrize("limits", [(64.0, 64.0, 4096.0), (64.0, 4.0, 1500.0)])
def test_best_fit_is_the_naive_one(rule, limits):
    tokens = np.random.default_rng(7).integers(1, 38, 400)
    sizes = np.stack((tokens, np.ones(400), tokens**2), 1).astype(float)
    which, place = packing.best_fit(sizes, np.array(limits), np.array([1.0, 0.125, 0.125]), rule)
    assert (which.tolist(), place.tolist()) == tuple(map(list, naive_fit(sizes.tolist(), limits, (1.0, 0.125, 0.125), rule)))
