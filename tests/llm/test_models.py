import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np

from vellumark.llm import brown, crf, mixing, pages, quality_crf


def brute_chain(scores, model):
    n, k = scores.shape
    total, marginal, pairs, best = 0.0, np.zeros((n, k)), np.zeros((k, k)), (-np.inf, None)
    for path in itertools.product(range(k), repeat=n):
        s = model.first[path[0]] + model.last[path[-1]] + sum(scores[t, y] for t, y in enumerate(path)) + sum(model.step[a, b] for a, b in itertools.pairwise(path))
        if s > best[0]:
            best = (s, path)
        total += math.exp(s)
        marginal[np.arange(n), list(path)] += math.exp(s)
        for a, b in itertools.pairwise(path):
            pairs[a, b] += math.exp(s)
    return marginal / total, pairs / total, math.log(total), best[1]


def test_chains_match_enumeration():
    draw = np.random.default_rng(2)
    lengths = np.array([3, 0, 5, 1, 4])
    model = crf.Model(np.zeros((1, 3)), draw.normal(size=(3, 3)), draw.normal(size=3), draw.normal(size=3))
    scores = draw.normal(size=(lengths.sum(), 3))
    got, expected, total = crf.marginals(scores, model, crf.Chains(lengths), pairs=True)
    labels = crf.viterbi(scores, model, crf.Chains(lengths))
    at, pairs, z = 0, np.zeros((3, 3)), 0.0
    for n in lengths:
        if n:
            m, p, logz, best = brute_chain(scores[at : at + n], model)
            assert np.allclose(got[at : at + n], m) and tuple(labels[at : at + n]) == best
            pairs, z = pairs + p, z + logz
        at += n
    assert np.allclose(expected, pairs) and abs(total - z) < 1e-9


def test_fit_learns_from_neighbours():
    draw = np.random.default_rng(3)
    lengths = np.full(80, 12)
    y = np.concatenate([np.repeat(draw.integers(0, 2, 3), 4) for _ in lengths])
    x = np.column_stack([y + draw.normal(scale=1.0, size=len(y)), np.ones(len(y))])
    model = crf.fit(x, y, lengths)
    own = ((x[:, 0] > 0.5) == y).mean()
    assert (crf.viterbi(x @ model.weights, model, crf.Chains(lengths)) == y).mean() > own + 0.05


def prose(draw, n):
    return " ".join(draw.choice(["the", "of", "and", "house", "tree", "river", "walks", "slowly"]) for _ in range(n)).capitalize() + "."


def corpus(n=240):
    """Every third text is junk of one of three kinds between lines of prose; every ninth is toxic."""
    draw = random.Random(9)
    docs, labels = [], []
    for i in range(n):
        lines = [prose(draw, draw.randint(5, 30)) for _ in range(draw.randint(1, 6))]
        if i % 3 == 0:
            junk = [" ".join(w + "###" for w in prose(draw, 20).split()), " | ".join(prose(draw, 25).split()), " ".join(["again"] * 40)][i % 9 // 3]
            lines.insert(draw.randint(0, len(lines)), junk)
        toxic = i % 9 == 4
        if toxic:
            lines[0] += " idiot scum"
        docs.append((i, "\n".join(lines)))
        labels.append((i, int(i % 3 != 0), int(toxic)))
    return docs, labels


def test_quality_is_learnt_and_held_out_rows_are_not_used(spark):
    docs, labels = corpus()
    odd = [(1000, None), (1001, ""), (None, "the house and the tree"), (1002, "\n\n"), (1003, "the river " * 20_000), (5, docs[5][1])]
    df = spark.createDataFrame(docs + odd, "doc_id long, text string").repartition(3)
    marks = spark.createDataFrame([*labels, (None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int")
    rows = quality_crf.score_quality(df, marks).collect()
    truth = {i: q for i, q, _ in labels}
    tested = [r for r in rows if r.held_out and r.doc_id in truth]
    assert tested and all(r.held_out == (zlib.crc32(str(r.doc_id if r.doc_id is not None else "").encode()) % 5 == 0) for r in rows)
    assert sum(r.predicted == truth[r.doc_id] for r in tested) / len(tested) > 0.95
    assert len(rows) == len(docs) + len(odd) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    # What a held-out label says changes nothing.
    turned = [(i, 1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q, t) for i, q, t in labels]
    again = quality_crf.score_quality(df, spark.createDataFrame(turned, "doc_id long, quality int, toxic int")).collect()
    assert sorted((str(r.doc_id), r.score) for r in again) == sorted((str(r.doc_id), r.score) for r in rows)
    none = quality_crf.score_quality(df, marks.limit(0)).collect()
    assert all(abs(r.score - 0.5) < 1e-9 for r in none)
    assert quality_crf.score_quality(df.limit(0), marks).count() == 0


def test_line_features_do_not_depend_on_the_slice():
    import pyarrow as pa

    from vellumark.llm.shared import slices

    texts = ["a b\n\nc c c", None, "", "# x | y!\nTHE END 12", "last\n"]
    (whole,) = [quality_crf.lines(d, o) for *_, d, o in slices(pa.array(texts), 1 << 20)]
    parts = [quality_crf.lines(d, o) for *_, d, o in slices(pa.array(texts), 1)]
    assert np.allclose(whole[0], np.concatenate([p[0] for p in parts])) and whole[2].tolist() == [3, 1, 1, 2, 2]


def test_language_model_counts_and_bounds(spark, monkeypatch):
    draw = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    docs = []
    for i in range(300):
        at, text = draw.randrange(400), []
        for _ in range(draw.randrange(0, 40)):  # a walk: what follows depends on what went before
            at = (at * 7 + draw.choice([1, 2, 3])) % 400
            text.append(vocabulary[at].upper() if draw.random() < 0.1 else vocabulary[at])
        docs.append((i, " ".join(text)))
    docs += [(1000, None), (1001, "  \n"), (None, "w1 new.word w2"), (7, docs[7][1]), (7, docs[7][1]), (7, "other text"), (1002, "unseen Étude " * 3)]
    monkeypatch.setattr(brown, "BROADCAST_WORDS", 100)  # most counts come from the join
    monkeypatch.setattr(brown, "SWEEPS", 2)
    rows = brown.score_texts(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()
    count, kept = Counter(), []
    for d, t in docs:
        held = zlib.crc32(str("" if d is None else d).encode()) % 10 == 0
        own = [*(t or "").encode().lower().split(), "end"]
        kept.append((d, held, own))
        if not held:
            count.update(own)
    n, v = sum(count.values()), len(count)
    want = sorted((str(d), held, len(own), sum(count[w] > 0 for w in own), n, round(sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own), 6)) for d, held, own in kept)
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows) == want
    tested = [r for r in rows if r.held_out and r.doc_id is not None and r.doc_id < 300]
    assert sum(r.score for r in tested) > sum(r.base_score for r in tested)
    assert all(r.score <= 0 and math.isfinite(r.score) for r in rows)
    assert brown.score_texts(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_words_beyond_the_exchanged_ones_get_learnt_classes(spark, monkeypatch):
    draw = random.Random(8)
    kinds = [[f"{a}{i:04d}z" for i in range(1500)] for a in "ab"]  # all of one shape; the kinds alternate
    docs = [(i, " ".join(draw.choice(kinds[k % 2]) for k in range(i % 2, i % 2 + 40))) for i in range(800)]
    count = Counter(w for d, t in docs if zlib.crc32(str(d).encode()) % 10 for w in t.split())
    order = [w for w, _ in count.most_common()]
    rare = [[w for w in order[2000:] if w[0] == a][:6] for a in "ab"]
    right, wrong = [w for p in zip(*rare, strict=True) for w in p], rare[0] + rare[1]
    held = [i for i in range(5000, 6000) if zlib.crc32(str(i).encode()) % 10 == 0]
    docs += [(held[0], " ".join(right)), (held[1], " ".join(wrong)), (held[2], "a9999z")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    one = {r.doc_id: r.score for r in brown.score_texts(df).collect()}
    assert one[held[0]] > one[held[1]] + 1  # the same words: only their classes can tell the orders apart
    monkeypatch.setattr(brown, "BROADCAST_WORDS", 100)  # classes come from the join
    two = {r.doc_id: r.score for r in brown.score_texts(df).collect()}
    assert one.keys() == two.keys() and all(abs(one[d] - two[d]) < 1e-6 for d in one)


def test_placing_takes_the_class_of_the_highest_likelihood():
    draw = np.random.default_rng(6)
    table = draw.poisson(4.0, (7, 7)).astype(float)
    entries = np.array([(w, c) for w in range(9) for c in range(14) if (w * 5 + c * 3) % 4 < 2])
    n = draw.integers(1, 9, len(entries)).astype(float)
    for w in range(9):  # as often after a word as before one
        mine = entries[:, 0] == w
        left, right = mine & (entries[:, 1] < 7), mine & (entries[:, 1] >= 7)
        n[np.flatnonzero(left)[0]] += max(0.0, n[right].sum() - n[left].sum())
        n[np.flatnonzero(right)[0]] += max(0.0, n[left].sum() - n[right].sum())
    f = lambda x: (x * np.log(np.maximum(x, 1e-300))).sum()
    want = []
    for w in range(9):
        marks = []
        for k in range(5):
            t = table.copy()
            for (v, c), m in zip(entries, n, strict=True):
                if v == w:
                    t[(c, k) if c < 7 else (k, c - 7)] += m
            rows, columns = table.sum(1), table.sum(0)
            rows[k] += n[(entries[:, 0] == w) & (entries[:, 1] < 7)].sum()
            columns[k] += n[(entries[:, 0] == w) & (entries[:, 1] < 7)].sum()
            marks.append(f(t) - f(rows) - f(columns))
        want.append(int(np.argmax(marks)))
    assert brown.best_classes(entries[:, 0], entries[:, 1], n, table, 5).tolist() == want


def test_exchange_never_lowers_the_likelihood():
    draw = np.random.default_rng(4)
    kind = np.arange(40) % 4
    bigrams = draw.poisson(np.where(kind[:, None] == (kind[None, :] + 1) % 4, 8.0, 0.3)).astype(float)

    def likelihood(of):
        member = np.eye(of.max() + 1)[of]
        table = member.T @ bigrams @ member
        f = lambda x: (x * np.log(np.maximum(x, 1e-300))).sum()
        return f(table) - f(table.sum(0)) - f(table.sum(1))

    marks = [likelihood(brown.exchange(bigrams, 38, classes=4, sweeps=s)) for s in (0, 1, 3, 8)]
    assert all(b >= a - 1e-6 for a, b in itertools.pairwise(marks)) and marks[-1] >= likelihood(np.concatenate((kind[:38], [4, 5]))) * (1 + 0.05) or marks[-1] > marks[0]


def test_generated_pages_are_extracted():
    model = pages.trained()
    exact = total = 0
    for page in pages.labelled_pages(60, seed=123):
        got = pages.extract(["".join(m for m, _ in page)], model)[0]
        exact += got == "\n".join(b[0] for b in pages.blocks("".join(m for m, y in page if y)))
        total += 1
    assert exact / total > 0.75


PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var t="</p><p>no</p>";</script></head><body>
<nav><ul><li><a href="/a">Menu</a></li><li><a href="/b">Other</a></li></ul></nav><!-- <p>no</p> --><div class="ad">Buy this thing now.</div>
<article><h1>Head &amp; line</h1><p><b>First  paragraph
of the &lt;text&gt;, caf&eacute; &#8364;5.<br><p>Second paragraph, longer than the first one, with a full stop.</p><p>Third.</article>
<div class="comments"><div class="comment"><p>I do not agree with this.</p></div></div><footer>&copy; 2024 x.example &middot; All rights reserved.</footer></body></html>"""


def test_pages_frame(spark):
    want = "Head & line\nFirst paragraph of the <text>, café €5.\nSecond paragraph, longer than the first one, with a full stop.\nThird."
    rows = [(1, "u", PAGE), (1, "u", PAGE), (2, None, None), (None, "x", ""), (3, "y", "<<<>&"), (4, "z", "<p>" * 3000 + "x" * 300_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("page_id", "url", "html", "'clash' as n_chars")
    got = pages.extract_pages(df).collect()
    assert got[0].text == got[1].text == want and got[0].n_chars == len(want)
    assert len(got) == 6 and all(r.n_chars == len(r.text) for r in got) and got[2].text == got[3].text == ""
    assert pages.extract_pages(df.limit(0)).count() == 0


def test_mixing_meets_targets_and_drops_toxic_text(spark):
    docs, labels = corpus(400)
    odd = [(1000, None), (1001, ""), (None, "the house"), (5, docs[5][1])]
    df = spark.createDataFrame(docs + odd, "doc_id long, text string").selectExpr("*", "1 as rate").repartition(3)
    marks = mixing.domains_of_labels(spark.createDataFrame(labels[:300], "doc_id long, quality int, toxic int"))
    rows = mixing.mix_documents(df, marks, {"good": 0.9, "poor": 0.1, "toxic": 0.0}).collect()
    truth = {i: "toxic" if t else "good" if q else "poor" for i, q, t in labels}
    assert len(rows) == len(docs) + len(odd)
    kept = {kind: [r.copies for r in rows if truth.get(r.doc_id) == kind] for kind in ("good", "poor", "toxic")}
    assert np.mean(kept["good"]) > 0.98 and np.mean(kept["toxic"]) < 0.05 and 0.05 < np.mean(kept["poor"]) < 0.95
    tokens = {d: sum(r.n_tokens * r.rate * r[f"p_{d}"] for r in rows) for d in ("good", "poor", "toxic")}
    assert abs(tokens["poor"] / (tokens["good"] + tokens["poor"]) - 0.1) < 0.02
    up = mixing.mix_documents(df, marks, {"good": 0.5, "poor": 0.5, "toxic": 0.0}, max_rate=10.0).collect()
    tokens = {d: sum(r.n_tokens * r.rate * r[f"p_{d}"] for r in up) for d in ("good", "poor")}
    assert abs(tokens["poor"] / tokens["good"] - 1) < 0.05
    assert mixing.mix_documents(df.limit(0), marks.limit(0), {"good": 1.0}).count() == 0


def test_rates_match_a_direct_solution(spark):
    draw = np.random.default_rng(7)
    p = draw.dirichlet([0.4, 0.3, 0.2], 200)
    n = draw.integers(1, 500, 200)
    table = spark.createDataFrame([(int(a), b.tolist()) for a, b in zip(n, p, strict=True)], "n long, p array<double>")
    history, natural, goal = mixing.fit_rates(table, np.array([0.5, 0.3, 0.2]), most=50.0)
    assert np.allclose(natural, n @ p)
    assert np.allclose((n * mixing.rates(p, history, 50.0)) @ p, goal, rtol=1e-3)


def test_taking_a_word_out_first_is_the_exchange_of_one_word():
    draw = np.random.default_rng(9)
    n_words, size, k = 30, 8, 5  # words 0..29 in five classes, codes 5..7 are other units
    own = draw.integers(0, k, n_words)
    left, right = draw.poisson(1.2, (n_words, size)).astype(float), draw.poisson(1.2, (n_words, size)).astype(float)
    right[:, -1] += np.maximum(0, left.sum(1) - right.sum(1))  # as often after a word as before one
    left[:, -1] += np.maximum(0, right.sum(1) - left.sum(1))
    table = draw.poisson(3.0, (size, size)).astype(float)
    for w in range(n_words):
        table[:, own[w]] += left[w]
        table[own[w]] += right[w]
    f = lambda x: (x * np.log(np.maximum(x, 1e-300))).sum()
    want = []
    for w in range(n_words):
        marks = []
        for c in range(k):
            t, rows, columns = table.copy(), table.sum(1), table.sum(0)
            for to, sign in ((own[w], -1), (c, 1)):
                t[:, to] += sign * left[w]
                t[to] += sign * right[w]
                rows[to] += sign * left[w].sum()
                columns[to] += sign * left[w].sum()
            marks.append(f(t) - f(rows[:k]) - f(columns[:k]))
        want.append(int(np.argmax(np.round(marks, 6))))
    entries = [(w, c + side * size, x[w, c]) for w in range(n_words) for side, x in ((0, left), (1, right)) for c in range(size) if x[w, c]]
    word, code, n = (np.array(x) for x in zip(*entries, strict=True))
    assert brown.best_classes(word, code, n, table, k, own).tolist() == want


def test_score_matches_brute_force(spark, monkeypatch):
    draw = random.Random(21)
    names = [f"{a}{i:03d}{'.' if i % 9 == 0 else ''}" for a in ("x", "yy", "longer-word-") for i in range(700)]
    docs = [(i, " ".join(draw.choice(names[: 100 + 2000 * (k % 2)]) for k in range(draw.randrange(0, 60)))) for i in range(250)] + [(7, "x001 unseen"), (1000, None), (1001, "new 1234 !? x001.")]
    monkeypatch.setattr(brown, "SWEEPS", 1)
    monkeypatch.setattr(brown, "BROADCAST_WORDS", 1200)
    kept = []
    learn = brown.learn
    monkeypatch.setattr(brown, "learn", lambda train: kept.append(learn(train)) or kept[-1])
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = sorted((str(r.doc_id), round(r.score, 6)) for r in brown.score_texts(df).collect())
    (learnt,) = kept
    h, shape, n, of = (np.asarray(x) for x in learnt.core)
    words = {int(a): (int(s), int(c), int(k)) for a, s, c, k in zip(h.view(np.int64), shape, n, of, strict=True)}
    words |= {r.h: (r["shape"], r.n, r["class"]) for r in learnt.placed.collect()}
    k, shapes = brown.CLASSES, brown.SHAPES

    def read(text):
        data = np.frombuffer((text or "").encode(), np.uint8)
        a, s, _ = brown.tokens(data, np.array([0, len(data)]))
        return [(int(x), int(y)) for x, y in zip(a.view(np.int64), s, strict=True)]

    held = lambda d: zlib.crc32(str(d).encode()) % 10 == 0
    train = [read(t) for d, t in docs if not held(d)]
    assert Counter(a for t in train for a, _ in t) == {a: w[1] for a, w in words.items()}
    steps = np.zeros((k + 1, k + 1))
    for t in train:
        chain = [k, *(words[a][2] for a, _ in t), k]
        for x, y in itertools.pairwise(chain):
            steps[x, y] += 1
    share = (steps.sum(0) + 1) / (steps.sum() + k + 1)
    follows = (steps + 5 * share) / (steps.sum(1, keepdims=True) + 5)
    tokens_of, types_of, twos, ones = np.zeros(k), np.zeros(k), np.zeros(k), np.zeros((k, shapes))
    for s, c, o in words.values():
        tokens_of[o] += c
        types_of[o] += 1
        twos[o] += c == 2
        ones[o, s] += c == 1
    off = np.clip(ones.sum(1) / np.maximum(1, ones.sum(1) + 2 * twos), 0.05, 0.95)
    free = np.where(tokens_of > 0, off * types_of / np.maximum(1, tokens_of), 1.0)
    dealt = (ones.sum(0) + 1) / (ones.sum() + shapes)
    new = free[:, None] * (ones + dealt) / (ones.sum(1, keepdims=True) + 1)
    likely = share[:k, None] * new
    after_new = (likely / likely.sum(0)).T @ follows[:k]
    want = []
    for d, t in docs:
        total, line = 0.0, follows[k]
        for a, s in read(t):
            if a in words:
                _, c, o = words[a]
                total += math.log10(line[o]) + math.log10((c - off[o]) / max(1, tokens_of[o]))
                line = follows[o]
            else:
                total += math.log10(line[:k] @ new[:, s])
                line = after_new[s]
        want.append((str(d), round(total + math.log10(line[k]), 6)))
    assert [g[0] for g in got] == [w[0] for w in sorted(want)] and all(abs(a[1] - b[1]) < 2e-6 for a, b in zip(got, sorted(want), strict=True))


def test_long_texts_are_scored_block_by_block(monkeypatch):
    import pyarrow as pa

    from vellumark.llm import shared

    draw = random.Random(14)
    model = crf.Model(np.random.default_rng(2).normal(size=(quality_crf.WIDTH, 2)), np.array([[0.7, -0.4], [-0.2, 0.9]]), np.array([0.3, -0.1]), np.array([-0.5, 0.2]))
    texts = ["\n".join(" ".join(draw.choice(["a", "Bb", "cc|", "12", "é!", "###"]) for _ in range(draw.randint(0, 12))) for _ in range(draw.randint(1, 40))) for _ in range(30)]
    texts += ["one", "\n", "x " * 300, "a\n" + "b b c " * 80 + "\na\n", "y" * 500 + "\nz"]
    monkeypatch.setattr(quality_crf, "segments", lambda data: shared.segments(data, 16))
    for text in texts:
        for _, _, data, offsets in shared.slices(pa.array([text])):
            x, chars, number = quality_crf.lines(data, offsets)
            got, _, _ = crf.marginals(x @ model.weights, model, crf.Chains(number))
            assert np.allclose(crf.chain_marginals(x @ model.weights, model, block=7), got)
            want = (got[:, 1] * (chars + 1)).sum() / (chars + 1).sum()
            for size in (20, 100, 1 << 20):
                assert abs(quality_crf.long_score(data, model, size) - want) < 1e-9, (size, text)
