"""Every stage of the pipeline, and the rates of mixing, against brute force on a small corpus."""

import random
import struct
from collections import Counter

import corpus_pipeline as cp
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from vellumark.llm import mixing, packing, rules, shared
from vellumark.llm.queries import TARGETS


def corpus():
    draw = random.Random(31)
    vocabulary = ["".join(draw.choice("aeioubcdfglmnprst") for _ in range(draw.randint(2, 8))) for _ in range(250)]
    prose = lambda n: " ".join(draw.choice(vocabulary) for _ in range(n)).capitalize() + "."
    docs, labels = [], []
    for i in range(120):
        lines = [prose(draw.randint(8, 30)) for _ in range(draw.randint(2, 6))]
        poor, toxic = i % 6 == 0, i % 5 == 3
        if poor:
            lines.append(" ".join(w + draw.choice(["***", "%%%", "###"]) for w in prose(25).split()))
        if toxic:
            lines[0] += " vile scum"
        if i % 4 == 1:
            lines.insert(1, "All rights to this line are shared.")
        docs.append((i, "\n".join(lines), "en"))
        labels.append((i, int(not poor), int(toxic)))
    near = lambda i: (300 + i, docs[i][1] + " tail", "en")
    long = prose(200)
    docs += [(500, long, "en"), (501, long + " changed", "en"), (502, long.replace(".", "") + " other end.", "en")]
    docs += [near(7), near(11), (400, docs[13][1], "de"), (401, "word " * 60, "x"), (402, None, "x"), (403, "", "x"), (404, "too short", "x"), (None, docs[14][1] + " Another line of its own for this row.", "x"), (None, "a row without an id that is like no other row of this whole corpus", "x"), (20, "another text on the same id, with ten words and a few more", "y"), (20, docs[20][1], "en")]
    return docs, labels[:90]


@pytest.fixture
def stages(spark, tmp_path):
    docs, labels = corpus()
    spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path), docs, {i: (q, t) for i, q, t in labels}


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def words_of(text):
    return (text or "").encode().split()


def buckets_of(text):
    for _, _, data, offsets in shared.slices(pa.array([text or ""])):
        starts, ends, counts = shared.words(data, offsets)
        return rules.features(data, starts, ends, counts)[0].tolist()


def brute_rules(docs, trusted):
    raw, target, each = Counter(), Counter(), []
    for d, t, _ in docs:
        each.append(buckets_of(t))
        raw.update(each[-1])
        if d in trusted:
            target.update(each[-1])
    n, m, b = sum(raw.values()), sum(target.values()), rules.BUCKETS
    prior = rules.PRIOR * m / n
    ratio = lambda x: np.log((target[x] + prior) / (m + prior * b)) - np.log((raw[x] + rules.PRIOR) / (n + rules.PRIOR * b))
    kept = []
    for row, own in zip(docs, each, strict=True):
        w = words_of(row[1])
        runs = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        times, covered = Counter(runs), set()
        for k, run in enumerate(runs):
            if times[run] > 1:
                covered |= set(range(k, k + 5))
        if len(w) >= 10 and 100 * len(covered) <= 20 * len(w) and sum(map(ratio, own)) / max(1, len(own)) >= rules.THRESHOLD:
            kept.append(row)
    return kept


def brute_lines(docs):
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    held = {}
    for d, t, _ in docs:
        for x in (t or "").split("\n"):
            if d is not None and len(key(x)) >= 10:
                held.setdefault(key(x), set()).add(d)
    stays = lambda d, x: d is None or len(key(x)) < 10 or len(held[key(x)]) < 2 or min(held[key(x)]) == d
    return [(d, "\n".join(x for x in (t or "").split("\n") if stays(d, x)), lang) for d, t, lang in docs]


def brute_near(docs):
    """One row of each group by runs of five words: the smallest id, rows without an id last."""
    sets = []
    for _, t, _ in docs:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    group = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    best = {}
    for i, g in enumerate(group):
        if sets[i]:
            best[g] = min(best.get(g, i), i, key=lambda k: (docs[k][0] is None, docs[k][0] or 0))
    return [d for i, d in enumerate(docs) if not sets[i] or best[group[i]] == i]


def test_every_stage_matches_brute_force(spark, stages):
    sf, docs, labels = stages
    frame = spark.read.parquet(f"{sf}/documents.parquet")
    trusted = {i for i, (q, _) in labels.items() if q == 1}
    for k, brute in enumerate((lambda d: brute_rules(d, trusted), brute_lines, brute_near)):
        out = cp.STAGES[k][1](spark, frame, sf).cache()
        docs = brute(docs)
        assert rows(out) == sorted(docs, key=repr), cp.STAGES[k][0]
        frame = out
    ids = [d for d, *_ in docs]
    assert 500 in ids and 501 not in ids and 502 not in ids and 20 in ids and None in ids
    kept = cp.STAGES[3][1](spark, frame, sf).cache()
    mixed = mixing.mix_documents(frame, mixing.domains_of_labels(spark.read.parquet(f"{sf}/labels.parquet")), TARGETS).collect()
    assert rows(kept) == sorted(((r.doc_id, r.text, r.lang) for r in mixed if r.copies >= 1), key=repr)
    pieces = cp.STAGES[4][1](spark, kept, sf).collect()
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    whole.encode_special_tokens = True
    want = Counter()
    for d, t, _ in map(tuple, kept.collect()):
        want[d] += len(whole.encode(t or "", add_special_tokens=False).ids) + 1
    got, filled = Counter(), Counter()
    for p in pieces:
        got[p.doc_id] += p.length
        filled[p.sequence_id] += p.length
    assert got == want and max(filled.values()) <= packing.WINDOW


def test_run_writes_its_stages_and_leaves_the_last(spark, stages):
    sf, docs, _ = stages
    import os

    root = shared.shared_folder(spark).removeprefix("file://")
    before = set(os.listdir(root)) if os.path.isdir(root) else set()
    out = cp.run(spark, sf)
    assert out.count() > 0
    (made,) = [d for d in set(os.listdir(root)) - before if d.startswith("corpus-")]
    assert os.listdir(f"{root}/{made}") == ["3"]


def u_of(doc_id):
    seed = xxhash.xxh64(struct.pack("<i", 29), seed=42).intdigest()
    return ((xxhash.xxh64(struct.pack("<q", doc_id), seed=seed).intdigest() if doc_id is not None else seed) >> 11) / float(1 << 53)


@pytest.mark.parametrize("most", [1.0, 3.0])
def test_rates_and_copies_match_brute_force(spark, stages, most):
    sf, docs, labels = stages
    frame = spark.read.parquet(f"{sf}/documents.parquet").withColumn("_id", F.lit("clash")).withColumn("p_good", F.lit(7))
    marks = mixing.domains_of_labels(spark.read.parquet(f"{sf}/labels.parquet"))
    got = mixing.mix_documents(frame, marks, TARGETS, max_rate=most).collect()
    p = np.array([[r[f"p_{d}"] for d in sorted(TARGETS)] for r in got])
    n = np.array([len(words_of(r.text)) for r in got], float)
    assert len(got) == len(docs) and np.allclose(p.sum(1), 1) and [r.n_tokens for r in got] == n.tolist()
    natural = n @ p
    goal = np.array([TARGETS[d] for d in sorted(TARGETS)]) * natural[0] / TARGETS["good"]
    assert np.allclose([got[0][f"goal_{d}"] for d in sorted(TARGETS)], goal)
    rate = np.array([r.rate for r in got])
    assert np.allclose([got[0][f"fitted_{d}"] for d in sorted(TARGETS)], (n * rate) @ p)
    distance = lambda r: ((((n * r) @ p - goal) ** 2) / natural).sum()
    best = np.ones(len(n))
    for _ in range(20_000):  # small steps of the plain projected gradient
        best = np.clip(best - 2e-2 * (p * n[:, None]) @ (((n * best) @ p - goal) / natural) / n.max(), 0, most)
    assert distance(rate) <= 1.1 * distance(best) + 1e-3 * distance(np.ones(len(n)))
    assert [r.copies for r in got] == [int(np.floor(r.rate + u_of(r.doc_id))) for r in got]
    labelled = {i: "toxic" if t else "good" if q else "poor" for i, (q, t) in labels.items()}
    assert all(r[f"p_{labelled[r.doc_id]}"] == 1.0 for r in got if r.doc_id in labelled)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_targets_are_met_on_labels_that_were_not_used(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").select("doc_id", "text")
    marks = mixing.domains_of_labels(spark.read.parquet(f"/root/testdata/{sf}/labels.parquet"))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    got = mixing.mix_documents(docs, marks.filter(~held), TARGETS, keep_text=False).join(marks.filter(held), "doc_id", "left").cache()
    one = got.first()
    tokens = sum(one[f"fitted_{d}"] for d in TARGETS)
    # Of the totals: good text is kept to a twentieth, poor text stays below its goal, little toxic text is left.
    assert one.fitted_good >= 0.95 * one.goal_good and one.fitted_poor <= 1.02 * one.goal_poor and one.fitted_toxic <= 0.08 * tokens
    kept = {r["domain"]: r["kept"] for r in got.filter("domain is not null").groupBy("domain").agg(F.avg((F.col("copies") >= 1).cast("int")).alias("kept")).collect()}
    assert kept["good"] >= 0.97 and kept["toxic"] <= 0.5
