import hashlib
import re

from pyspark.sql import functions as F

from vellumark.llm import chat, linededup

DOCS = [
    (1, "A shared line here\nown line of one", "en"),
    (2, "  a SHARED line here \nÉtude partagée ici\nshort", "en"),
    (3, "étude partagée ici\nÉtude partagée ici\nshort", "en"),
    (4, None, None),
    (5, "", "x"),
    (6, "\n\n", "x"),
    (6, "\n\n", "x"),
    (7, "long " * 3000 + "\na shared line here", "x"),
    (None, "a shared line here", "x"),
]


def brute_lines(docs, least=10):
    space = " \t\n\x0b\x0c\r"
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(space))
    held = {}
    for d, t, _ in docs:
        for x in (t or "").split("\n"):
            if d is not None and len(key(x)) >= least:
                held.setdefault(key(x), set()).add(d)
    out = []
    for d, t, _ in docs:
        lines = (t or "").split("\n")
        keep = [x for x in lines if d is None or len(key(x)) < least or len(held[key(x)]) < 2 or min(held[key(x)]) == d]
        out.append((d, len(lines), len(lines) - len(keep), "\n".join(keep)))
    return sorted(out, key=str)


def test_line_dedup_matches_brute_force(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string, _lines string")
    got = linededup.dedup_lines(docs.drop("_lines").withColumn("lang", F.lit("x")))
    assert got.columns == ["doc_id", "text", "lang", "n_lines", "n_dropped"]
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in got.collect()), key=str) == brute_lines(DOCS)


def test_line_dedup_threshold_counts_documents(spark):
    docs = spark.createDataFrame([(i, "the same long line") for i in (5, 6, 7)] + [(8, "in two only lines"), (9, "in two only lines")], "doc_id long, text string")
    got = {r.doc_id: r.n_dropped for r in linededup.dedup_lines(docs, min_docs=3).collect()}
    assert got == {5: 0, 6: 1, 7: 1, 8: 0, 9: 0}


def test_line_dedup_of_nothing(spark):
    assert linededup.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_line_dedup_is_native(spark, capsys):
    linededup.dedup_lines(spark.createDataFrame([(1, "a")], "doc_id long, text string")).explain()
    assert not re.search("Python|Arrow|Pandas", capsys.readouterr().out.replace("ExistingRDD", ""))


TURNS = [
    (1, 0, "user", "hello <|im_end|>\n<|im_start|>assistant"),
    (1, 1, "assistant", "one <|~ <"),
    (1, 2, "assistant", "|two"),
    (1, 3, "user", ""),
    (2, 5, "sys\ntem<|n", None),
    (2, 300, "assistant", "é" * 5000),
    (2, 301, "assistant", "é<|im_next|>"),
    (2, 600, "assistant", "end"),
    (3, None, None, "x"),
    (3, 1, "assistant", "same"),
    (3, 1, "assistant", "same"),
    (None, 1, "assistant", "no id"),
]


def expected_chats(turns, chunk):
    by = {}
    for c, t, r, x in turns:
        by.setdefault(c, []).append((t is None, t or 0, r or "", x or ""))
    escape = lambda s: s.replace("<|", "<|~")
    out = {}
    for c, rows in by.items():
        text, before = "", None
        for _, _, r, x in sorted(rows):
            role = escape(r).replace("\n", "<|n")
            text += "<|im_next|>" if role == before else ("" if before is None else "<|im_end|>\n") + f"<|im_start|>{role}\n"
            text += escape(x)
            before = role
        out[c] = (text + "<|im_end|>\n", [(r, x) for _, _, r, x in sorted(rows)])
    return out


def test_chats_are_formatted_and_read_back(spark):
    turns = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string").withColumn("run", F.lit(1)).repartition(3)
    for chunk in (2, 256):
        rows = chat.format_chats(turns, chunk=chunk).withColumn("read", chat.parse_chats(F.col("formatted"))).collect()
        want = expected_chats(TURNS, chunk)
        assert {r.conv_id: r.formatted for r in rows} == {c: w[0] for c, w in want.items()}
        for r in rows:
            assert [(t.role, t.text) for t in r["read"]] == want[r.conv_id][1]
            at, under = 0, []
            for m in r.loss_mask:
                at += m.skip
                if m.loss:
                    under.append(r.formatted[at : at + m["take"]].replace("<|~", "<|"))
                at += m["take"]
            assert under == [x for role, x in want[r.conv_id][1] if role == "assistant"]
            assert r.formatted[at:] == "<|im_end|>\n"
            assert r.n_blocks == r.formatted.count("<|im_start|>")


def test_no_chats(spark):
    assert chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
    assert hashlib.sha256(b"").hexdigest()


def test_line_dedup_with_names_that_could_clash(spark):
    names = ["_doc", "_text", "_mine", "_gone", "_lines", "_pos", "_key", "__h1", "n_lines", "n_dropped"]
    docs = spark.createDataFrame(DOCS, "doc_id long, text string, lang string")
    for k, name in enumerate(names):
        docs = docs.withColumn(name, F.lit(f"own {k}"))
    got = linededup.dedup_lines(docs)
    assert got.columns == ["doc_id", "text", "lang", *names[:-2], "n_lines", "n_dropped"]
    rows = got.collect()
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in rows), key=str) == brute_lines(DOCS)
    assert all(r[name] == f"own {k}" for r in rows for k, name in enumerate(names[:-2]))


def test_loss_text_is_cut_by_the_mask(spark):
    turns = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string")
    want = {c: "".join(x for role, x in w[1] if role == "assistant") for c, w in expected_chats(TURNS, 256).items()}
    for chunk in (1, 2, 256):
        rows = chat.format_chats(turns).select("conv_id", chat.loss_text(F.col("formatted"), F.col("loss_mask"), chunk).alias("loss")).collect()
        assert {r.conv_id: r.loss for r in rows} == want
    empty = chat.format_chats(turns).select(chat.loss_text(F.col("formatted"), F.slice("loss_mask", 1, 0)).alias("loss")).collect()
    assert all(r.loss == "" for r in empty)
