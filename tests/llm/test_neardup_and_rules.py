import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from vellumark.llm import components, neardup, rules, shared


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def shingles(text, size):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def brute_components(docs, size, percent):
    sets = [(d, shingles(t, size)) for d, t in docs]
    root = {i: i for i in range(len(sets))}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i][1] & sets[j][1])
            if both and 100 * both >= percent * len(sets[i][1] | sets[j][1]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(sets):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, len(s), least[find(i)]) for i, (d, s) in enumerate(sets))


def corpus():
    draw = random.Random(4)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(5))
    docs = []
    for _ in range(12):
        base = [word() for _ in range(120)]
        docs.append(" ".join(base))
        for _ in range(draw.randint(0, 14)):  # copies of copies, from equal to far
            at = draw.randrange(len(base))
            base = base[:at] + [word() for _ in range(draw.choice([0, 1, 2, 6]))] + base[at + draw.choice([0, 1, 3]) :]
            docs.append(" ".join(base).upper() if draw.random() < 0.3 else "\t".join(base))
    docs += ["one two", "ONE  two", "one", "", None, " \n", "É é", "é É", "x " * 30_000, "x " * 31_000]
    draw.shuffle(docs)
    return [(1000 - 3 * i, t) for i, t in enumerate(docs)]


def test_near_duplicates_match_brute_force(spark):
    docs = corpus()
    for size in (4, 5):
        got = neardup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), shingle=size)
        assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
        rows = got.collect()
        assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in rows) == brute_components(docs, size, 80)
        assert all(r.kept == (r.doc_id == r.component_id) for r in rows)


def test_later_rounds_find_links_the_hub_does_not_have(spark):
    # A path of drifting copies: the smallest id links with few, the others with their neighbours.
    draw = random.Random(1)
    base = [f"w{i}" for i in range(150)]
    docs = []
    for i in range(40):
        docs.append((i, " ".join(base)))
        base[draw.randrange(150)] = f"n{i}"
    got = neardup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), shingle=4)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == brute_components(docs, 4, 80)


def test_near_duplicates_with_nulls_and_repeated_rows(spark):
    rows = [(None, "a b c d e f"), (7, "a b c d e f"), (7, "a b c d e f"), (9, None), (None, "")]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got.collect()), key=str) == sorted(
        [(None, 2, 7, False), (7, 2, 7, True), (7, 2, 7, True), (9, 0, 9, True), (None, 0, None, False)], key=str
    )
    assert neardup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 30)] + [(5, 5), (200, 201), (201, 200)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {100 + i: 100 for i in range(30)} | {200: 200, 201: 200}


def test_sketch_bounds_intersections():
    draw = np.random.default_rng(1)
    for _ in range(50):
        s, t = (np.unique(draw.integers(0, 3000, draw.integers(1, 1500)).astype(np.uint64)) for _ in range(2))
        a, b = neardup.sketch(shared.mix(s)), neardup.sketch(shared.mix(t))
        ones = lambda x: sum(int(v).bit_count() for v in x)
        assert len(np.intersect1d(s, t)) <= ones(a & b) + min(len(s) - ones(a), len(t) - ones(b))


TEXTS = ["", None, "one", "Same line\nsame line\nSame line\n\n\n", "a b c d e x a b c d e", "# $ * tokens é | <> \x85 &", "w " * 400, "a\nb", "b\n\n a \n a ", "long " * 200_000, "é\n"]


def test_measures_match_brute_force():
    for _, _, data, offsets in shared.slices(pa.array(TEXTS), most=1 << 30):
        got = rules.measures(data, offsets)
        got.pop("_features")
        for i, text in enumerate(TEXTS):
            text = text or ""
            w, seen, twice = words_of(text), set(), 0
            for line in text.split("\n"):
                if words_of(line):
                    twice += line in seen
                    seen.add(line)
            runs = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
            times, covered = Counter(runs), set()
            for k, run in enumerate(runs):
                if times[run] > 1:
                    covered |= set(range(k, k + 5))
            want = {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)), "n_dup_lines": twice, "n_repeat_words": len(covered)}
            assert {k: int(v[i]) for k, v in got.items()} == want


def test_words_do_not_depend_on_slices():
    for _, _, data, offsets in shared.slices(pa.array(["aB c", "d", "", "Ab"]), most=1 << 20):
        starts, ends, counts = shared.words(data, offsets)
        h = shared.hash_spans(data, starts, ends)
        assert counts.tolist() == [2, 1, 0, 1] and h[0] == h[3] and len(set(h.tolist())) == 3
    alone = [shared.hash_spans(d, *shared.words(d, o)[:2]) for _, _, d, o in shared.slices(pa.array(["aB c", "d", "", "Ab"]), most=1)]
    assert np.concatenate(alone).tolist() == h.tolist()


def test_likelihood_ratio_matches_brute_force_and_splits(spark):
    draw = random.Random(2)
    vocabulary = ["".join(draw.choice("abcdefgh") for _ in range(4)) for _ in range(60)]
    good = [(i, " ".join(draw.choice(vocabulary) for _ in range(40))) for i in range(60)]
    bad = [(100 + i, " ".join(draw.choice(vocabulary) + draw.choice(["***", "%%%", "###"]) for _ in range(40))) for i in range(20)]
    odd = [(900, None), (None, good[0][1]), (901, good[1][1]), (901, good[1][1])]
    docs = spark.createDataFrame(good + bad + odd, "doc_id long, text string")
    trusted = spark.createDataFrame([(i,) for i in range(40)] + [(None,), (3,)], "id long")
    got = rules.apply_rules(docs, trusted, threshold=-0.05).collect()
    raw, target = Counter(), Counter()
    each = []
    for d, t in good + bad + odd:
        w = (t or "").encode().lower().split()
        for _, _, data, offsets in shared.slices(pa.array([t or ""])):
            starts, ends, counts = shared.words(data, offsets)
            buckets = rules.features(data, starts, ends, counts)[0].tolist()
        assert len(buckets) == max(0, 2 * len(w) - 1)
        raw.update(buckets)
        if d is not None and d < 40:
            target.update(buckets)
        each.append((d, buckets))
    n, b = sum(raw.values()), rules.BUCKETS
    trusted_n, prior = sum(target.values()), rules.PRIOR
    share = trusted_n / n
    ratio = lambda x: np.log((target[x] + prior * share) / (trusted_n + prior * share * b)) - np.log((raw[x] + prior) / (n + prior * b))
    want = sorted((str(d), round(sum(map(ratio, x)) / max(1, len(x)), 6)) for d, x in each)
    assert sorted((str(r.doc_id), round(r.llr, 6)) for r in got) == want
    assert all(r.kept == (not r.base_failed and r.llr >= -0.05) for r in got)
    least = min(r.llr for r in got if r.doc_id is not None and r.doc_id < 40)
    assert least > max(r.llr for r in got if r.doc_id is not None and 100 <= r.doc_id < 900)


def test_every_trusted_row_is_counted(spark):
    texts = {i: f"aa{i % 701} bb{i % 89} cc{i % 13}" for i in range(21_000)}
    rows = [*texts.items(), (None, texts[0]), (7, texts[8]), (20_900, texts[9])]  # without an id, of one id twice
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    trusted = spark.createDataFrame([(i,) for i in [*range(20_500), None, 7, 30_000]], "id long")
    raw, target = np.zeros(rules.BUCKETS), np.zeros(rules.BUCKETS)
    for first, end, data, offsets in shared.slices(pa.array([t for _, t in rows])):
        buckets, number = rules.features(data, *shared.words(data, offsets))
        chosen = [d is not None and d < 20_500 for d, _ in rows[first:end]]
        raw += np.bincount(buckets, minlength=rules.BUCKETS)
        target += np.bincount(buckets[np.repeat(chosen, number)], minlength=rules.BUCKETS)
    share, b = target.sum() / raw.sum(), rules.BUCKETS
    want = np.log((target + rules.PRIOR * share) / (target.sum() + rules.PRIOR * share * b)) - np.log((raw + rules.PRIOR) / (raw.sum() + rules.PRIOR * b))
    assert np.allclose(rules.fit(docs, trusted), want, rtol=0, atol=1e-12)


def test_rules_without_trusted_rows_or_documents(spark):
    none = spark.createDataFrame([], "id long")
    docs = spark.createDataFrame([(1, "a b c d e f g h i j", 5)], "doc_id long, text string, n_words int")
    assert [(r.kept, r.llr, r.n_words) for r in rules.apply_rules(docs, none).collect()] == [(True, 0.0, 10)]
    assert rules.apply_rules(docs.limit(0), none).count() == 0


def test_hot_buckets_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(neardup, "SMALL", 1)  # every open bucket counts as hot
    draw = random.Random(12)
    word = lambda: "".join(draw.choice("abcdefghij") for _ in range(6))
    passage, other = [word() for _ in range(100)], [word() for _ in range(40)]
    docs = []
    for i in range(90):  # about the threshold: a passage that all hold, another that a third hold, own words at both ends
        own = [word() for _ in range(draw.choice([6, 10, 12, 20]))]
        text = own[: len(own) // 2] + passage[: draw.choice([100, 100, 90])] + (other[: draw.choice([20, 40])] if i % 3 == 0 else []) + own[len(own) // 2 :]
        docs.append((i * 7 % 90, " ".join(text)))
    docs += corpus()
    for percent in (80, 70):
        got = neardup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), shingle=4, percent=percent).collect()
        assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(docs, 4, percent)


def passages(n):
    """n texts with one long passage and nothing else in common, each pair just below the threshold."""
    draw = random.Random(n)
    word = lambda: "".join(draw.choice("abcdefghij") for _ in range(6))
    passage = [word() for _ in range(150)]
    return [(i, " ".join(passage + [word() for _ in range(20)])) for i in range(n)]


def test_a_common_passage_makes_no_pairs(spark, monkeypatch):
    made = []
    whole = neardup._hot_pairs

    def counted(*given):
        out = whole(*given)
        made.append(out.count())
        return out

    monkeypatch.setattr(neardup, "_hot_pairs", counted)
    for n in (200, 400):
        rows = neardup.near_duplicates(spark.createDataFrame(passages(n), "doc_id long, text string")).collect()
        assert len(rows) == n and all(r.kept for r in rows)
    assert len(made) == 2 and all(m <= n for m, n in zip(made, (200, 400), strict=True))


def test_long_texts_are_measured_in_parts(monkeypatch):
    draw = random.Random(17)
    vocabulary = ["".join(draw.choice("abcdé#") for _ in range(draw.randint(1, 6))) for _ in range(40)]
    texts = [" ".join(draw.choice(vocabulary) + draw.choice(["", "", "\n", "\n\n "]) for _ in range(draw.randint(0, 400))) for _ in range(60)]
    texts += ["", "\n", " \n\n", "x" * 900, "ab " * 300, "no end\n" * 50, "\n".join(["y" * 300, "z", "y" * 300, " "])]
    weights = np.random.default_rng(3).normal(size=rules.BUCKETS)
    for size, part in ((64, 50), (16, 1000)):
        monkeypatch.setattr(rules, "SLICE_BYTES", size)
        monkeypatch.setattr(rules, "PART", part)
        monkeypatch.setattr(rules, "segments", lambda data, size=size: shared.segments(data, 4 * size))
        for text in texts:
            for _, _, data, offsets in shared.slices(pa.array([text])):
                got, llr = rules.long_measures(data, weights)
                want = rules.measures(data, offsets)
                buckets, _ = want.pop("_features")
                assert got == {k: int(v[0]) for k, v in want.items()}, repr(text)
                assert abs(llr - weights[buckets].sum() / max(1, len(buckets))) < 1e-9


def test_long_spans_hash_alike(monkeypatch):
    data = np.frombuffer(("Ab" * 3000 + "end").encode(), np.uint8)
    spans = (np.array([0, 5, 4000]), np.array([6003, 5005, 6000]))
    want = shared.hash_spans(data, np.array([0]), np.array([6003])), [shared.hash_spans(data, np.array([a]), np.array([b]))[0] for a, b in zip(*spans, strict=True)]
    monkeypatch.setattr(shared, "SLICE_BYTES", 100)
    assert shared.hash_spans(data, np.array([0]), np.array([6003])) == want[0]
    assert [shared.hash_spans(data, np.array([a]), np.array([b]))[0] for a, b in zip(*spans, strict=True)] == want[1]
    assert [(a, b) for a, b in shared.segments(np.frombuffer(b"aa bb cccccccccc d", np.uint8), 4)] == [(0, 6), (6, 17), (17, 18)]
