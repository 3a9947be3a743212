import math
import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from vellumark.llm import packing, topk


def brute_top_k(rows, asked, k):
    whole = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            whole[i] = min(whole.get(i, v), v)
    ints = {i: [math.floor(256 * float(np.float32(x))) for x in v] for i, v in whole.items()}
    out = []
    for q in sorted({i for i in asked if i in ints}):
        scored = sorted((-sum(a * b for a, b in zip(ints[q], v, strict=False)), i) for i, v in ints.items() if i != q)
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return out


def found(df):
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in df.collect())


def test_top_k_matches_brute_force(spark):
    draw = random.Random(3)
    rows = [(i, [draw.uniform(-1, 1) for _ in range(7)]) for i in range(300)]
    rows += [(400 + i, rows[5][1]) for i in range(30)]  # copies
    rows += [(500, [1.0, None]), (501, None), (502, [float("nan")] * 7), (503, [float("inf")] * 7), (None, [1.0] * 7), (504, []), (505, [0.5]), (506, [-0.25] * 9)]
    rows += [rows[10], (11, [9.0] * 7)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    queries = df.filter("vec_id % 10 = 0 or vec_id > 400")
    asked = [i for i, _ in rows if i is not None and (i % 10 == 0 or i > 400)]
    rows32 = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    for size in (16_384, 20):
        assert found(topk.top_k(df, queries, k=5, round_size=size)) == brute_top_k(rows32, asked, 5)
    assert found(topk.top_k(df, queries, k=3, lists=3)) == brute_top_k(rows32, asked, 3)


def test_top_k_of_few_or_huge(spark):
    df = spark.createDataFrame([(0, [3e12, 1.0]), (50, [-1e3, 2.0]), (3, [5e-3, 1.0])], "vec_id long, embedding array<double>")
    got = found(topk.top_k(df, df.filter("vec_id % 50 = 0"), k=5))
    assert [g[:3] for g in got] == [(0, 1, 3), (0, 2, 50), (50, 1, 3), (50, 2, 0)]
    assert topk.top_k(df.limit(0), df.limit(0)).count() == 0
    assert topk.top_k(df, df.limit(0)).count() == 0


PATHS = (public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
TEXTS = ["", None, "Plain text, it's 12 o'clock.  Two  blanks \n\n\n and\ttabs\r\n", "Été ñandú straße", "日本語 текст 😀 mixed    x", "<|endoftext|> x", "a" * 9000, " ".join(f"w{i}" for i in range(9000)), "\x1c\x85 \x00"]


def test_ids_are_those_of_the_tokenizers_file():
    whole = Tokenizer.from_file(PATHS[0])
    whole.encode_special_tokens = True
    encode = packing.Encoder(*PATHS)
    for text in TEXTS:
        assert np.frombuffer(encode(text or ""), "<u4").tolist() == whole.encode(text or "", add_special_tokens=False).ids


def test_packing_keeps_every_id_once(spark):
    draw = random.Random(6)
    texts = TEXTS + [" ".join("word" + str(draw.randrange(50)) for _ in range(draw.randrange(1, 900))) for _ in range(120)] + ["same text"] * 3
    rows = [(None if i == 3 else 7 if i >= len(texts) - 2 else i, t) for i, t in enumerate(texts)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), *PATHS, group=150).collect()
    whole = Tokenizer.from_file(PATHS[0])
    whole.encode_special_tokens = True
    want, seen = [], []
    for d, t in rows:
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 1]
        at = 0
        for n in packing.cuts(len(ids)):
            want.append((d, at, n, zlib.crc32(np.asarray(ids[at : at + n], "<u4").tobytes()), len(ids)))
            at += n
        assert at == len(ids)
    by = {}
    for r in got:
        seen.append((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens))
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sorted(seen, key=str) == sorted(want, key=str)
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    assert sum(w[2] for w in want) / (2048 * len(by)) > 0.95
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), *PATHS).count() == 0


def test_differencing_is_near_equal_and_raises_the_count():
    draw = random.Random(8)
    sizes = sorted((draw.randrange(1, 513) for _ in range(900)), reverse=True)
    for k in (1, 2, 7, 100):
        groups = packing.differencing(sizes, k)
        sums = [sum(sizes[i] for i in g) for g in groups]
        assert len(groups) == k and sorted(i for g in groups for i in g) == list(range(900))
        assert max(sums) - min(sums) <= max(8, 3 * k // 2)
    assert packing.windows([2000, 2000, 90]) == [[0], [1], [2]] or len(packing.windows([2000, 2000, 90])) == 3
    assert packing.windows([1500, 1500]) == [[0], [1]]
    assert [len(packing.differencing([], 3)), len(packing.differencing([5], 3))] == [3, 3]


def test_cutoffs_leave_out_most_pairs_and_no_result(monkeypatch):
    draw = np.random.default_rng(5)
    middles = draw.normal(size=(8, 32))
    rows = np.floor(256 * (middles[draw.integers(0, 8, 4000)] + 0.2 * draw.normal(size=(4000, 32))))
    q = rows[::80]
    low = np.sort(q @ rows.T, axis=1)[:, -6]
    resolved = []
    exact = topk._pairs
    monkeypatch.setattr(topk, "_pairs", lambda q, rows, x, y: resolved.append(len(x)) or exact(q, rows, x, y))
    x, y, score = topk.sufficient(q, rows, low, topk.axes(q), [0, 16, 32])
    want = np.nonzero(q @ rows.T >= low[:, None])
    assert (x.tolist(), y.tolist()) == (want[0].tolist(), want[1].tolist()) and (score == (q @ rows.T)[want]).all()
    assert resolved[0] < 0.1 * len(q) * len(rows)
