import random
import re

import pytest

from vellumark.operators import kernels
from vellumark.options import SliceOptions


def options(**given):
    return SliceOptions(**given).resolved()


def prose(seed, n):
    draw = random.Random(seed)
    return "".join(draw.choice("abcdefgh    ..!?。\n") for _ in range(n))


@pytest.mark.parametrize("limit", [50, 200, 1000])
def test_pieces_tile_the_text(limit):
    text = prose(1, 20_000)
    pieces = kernels.budget_split(text, options(limit=limit))
    assert "".join(pieces) == text and all(len(p) <= limit for p in pieces)
    assert all(p[-1] in kernels.SENTENCE_ENDS for p in pieces[:-1])


def test_short_text_is_one_piece_even_if_blank():
    assert kernels.budget_split(" ", options(limit=100)) == [" "]
    assert kernels.budget_split("", options(limit=100)) == [""]
    assert kernels.budget_split(" " * 500, options(limit=100)) == []


def test_unbroken_run_is_cut_hard_and_overlap_advances():
    text = "x" * 5000
    assert [len(p) for p in kernels.budget_split(text, options(limit=200))] == [200] * 25
    pieces = kernels.budget_split(text, options(limit=500, overlap=249))
    assert all(b == text[: len(b)] for b in pieces) and sum(map(len, pieces)) > 5000


def test_a_stop_at_the_very_end_of_the_window_is_not_looked_at():
    text = "a" * 49 + "." + "b" * 60
    assert kernels.budget_split(text, options(limit=50))[0] == text[:50]
    text = "a" * 30 + "." + "a" * 18 + "." + "b" * 60
    assert kernels.budget_split(text, options(limit=50))[0] == text[:31]


@pytest.mark.parametrize("shift", range(0, 60, 7))
def test_references_and_table_rows_are_not_cut(shift):
    reference = "![a picture. here!](./oss/file/0123.png)"
    text = "w" * (145 + shift) + reference + "w" * 300
    assert any(reference in p for p in kernels.budget_split(text, options(limit=200)))
    rows = "intro text\n" + "".join(f"| row {i} | some cell. text |\n" for i in range(40))
    assert all(p.startswith(("intro", "| row")) for p in kernels.budget_split(rows, options(limit=100)))


def test_short_pieces_join_and_another_measure_bounds_words():
    pieces = kernels.budget_split(prose(3, 3000), options(limit=100, min_chunk=70))
    assert all(len(p) >= 70 for p in pieces[1:])
    text = " ".join(f"w{i}" for i in range(400))
    counted = kernels.budget_split(text, options(limit=50, length_fn=lambda s: len(s.split()), boundary=False))
    assert "".join(counted) == text and max(len(p.split()) for p in counted) <= 50


def test_heading_tree_chains_titles():
    text = "lead\n\n# A\n\nalpha\n\n## B\n\nbeta one\n\nbeta two\n\n# C\n\n## D\n\n```\n# not a heading\n```\n"
    got = kernels.slice_text(text, options(limit=1000))
    assert [(" ".join(t.split()), c) for t, c in got] == [("", "lead"), ("A", "alpha"), ("A B", "beta one"), ("A B", "beta two"), ("C D", "```\n# not a heading\n```")]
    assert got[2][0] == "A  B"


def test_headings_that_repeat_are_told_apart():
    text = "# A\n\none\n\n## A\n\ntwo\n\n# A\n\nthree\n\n# A\n"
    assert [c for _, c in kernels.slice_text(text, options(limit=1000))] == ["one", "two", "three"] or kernels.slice_text(text, options(limit=1000))[-1][1].endswith("A")


def test_long_leads_keep_their_order_and_are_not_repeated():
    lead = " ".join(f"Sentence number {i} of the lead." for i in range(60))
    text = f"# H\n{lead}\n\n## Sub\n\nend"
    body = [c for t, c in kernels.slice_text(text, options(limit=200)) if c != "end"]
    assert re.sub(r"\s", "", "".join(body)) == re.sub(r"\s", "", lead)
    plain = f"{lead}\n\nsecond"
    assert re.sub(r"\s", "", "".join(c for _, c in kernels.slice_text(plain, options(limit=200)))) == re.sub(r"\s", "", plain)


def test_an_empty_section_becomes_text_and_long_titles_spill():
    got = kernels.slice_text("# Only\n\n# Next\n\ntext", options(limit=1000))
    assert [c for _, c in got] == ["# Only", "text"]
    long = "# " + "t" * 400 + "\n\nbody"
    first, second = kernels.slice_text(long, options(limit=1000))
    assert first == ("t" * 253, "t" * 147) and second == ("t" * 253, "body")


@pytest.mark.parametrize("seed", range(40))
def test_nothing_is_lost_from_random_markdown(seed):
    draw = random.Random(seed)
    parts = ["# one", "## two", "### three", "text a.", "text b!", "```", "| a | b |", "| - | - |", "", "", "#nospace", "###### six", "####### seven"]
    text = "\n".join(draw.choice(parts) for _ in range(draw.randint(0, 40)))
    for limit in (50, 1000):
        out = kernels.slice_text(text, options(limit=limit))
        words = lambda s: set(re.findall(r"\w+", s))
        assert words(text) <= words(" ".join(t + " " + c for t, c in out)) | {"one", "two", "three", "six"}
        assert all(c.strip() for _, c in out)


def test_table_headers_are_carried():
    table = "| h |\n| --- |\n" + "".join(f"| row number {i} with text |\n" for i in range(60))
    blocks = list(kernels.carry_headers(kernels.budget_split(table, options(limit=200))))
    assert len(blocks) > 5 and all(b.startswith("| h |\n| --- |\n") for b in blocks)
    assert list(kernels.carry_headers(["text", "| a |"])) == ["text", "| a |"]


def test_overlap_runs_through_short_paragraphs():
    rows = [("", "one two three"), ("", "x"), ("", "end")]
    assert kernels.overlap_rows(rows, options(limit=100, overlap=8, overlap_boundary=False))[2][1] == " three x end"
    assert kernels.overlap_rows(rows, options(limit=100, overlap=8))[1][1] == "three x"
    apart = kernels.overlap_rows([("a", "one"), ("b", "two")], options(limit=100, overlap=9, overlap_within_section=True))
    assert apart == [("a", "one"), ("b", "two")]


def test_rows_are_packed_below_the_limit():
    rows = [f"| {i} |\n" for i in range(50)]
    packed = kernels.pack_rows("| h |\n| --- |\n", rows, 60, resplit=False)
    assert all(p.startswith("| h |\n| --- |\n") and len(p) < 60 for p in packed)
    assert "".join(p[14:] for p in packed) == "".join(rows)
    assert kernels.pack_rows("| h |\n", [], 60, False) == ["| h |\n"]
    long = kernels.pack_rows("| h |\n", ["| " + "x" * 300 + " |\n"], 100, resplit=True)
    assert len(long) == 4 and all(p.startswith("| h |\n") for p in long)


def test_settings_are_checked_and_held():
    assert SliceOptions(limit=1).resolved().limit == 50 and SliceOptions(limit=10**9).resolved().limit == 100_000
    assert SliceOptions(limit=100, overlap=90).resolved().overlap == 50
    assert SliceOptions(limit=1000, overlap_ratio=0.1).resolved().overlap == 100
    for wrong in ({"lookback": 1}, {"overlap": -1}, {"overlap_ratio": 2}):
        with pytest.raises(ValueError):
            SliceOptions(**wrong)
