"""Chat formatting with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, NEXT, CLOSE = "<|im_start|>", "<|im_next|>", "<|im_end|>"
CHUNK = 256


def escape(text: Column) -> Column:
    """No control string can occur in the result: `<|` is always followed by `~`."""
    return F.replace(text, F.lit("<|"), F.lit("<|~"))


def unescape(text: Column) -> Column:
    return F.replace(text, F.lit("<|~"), F.lit("<|"))


def escape_role(role: Column) -> Column:
    """As escape(), and a role stays on one line."""
    return F.replace(escape(role), F.lit("\n"), F.lit("<|n"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("<|n"), F.lit("\n")))


def _mark(before: Column, role: Column) -> Column:
    """What stands between two texts: one block goes on, or it is closed and another opened."""
    return F.when(before == role, F.lit(NEXT)).otherwise(F.concat(F.lit(f"{CLOSE}\n{OPEN}"), role, F.lit("\n")))


def format_chats(turns: DataFrame, trained_role: str = "assistant", chunk: int = CHUNK) -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_mask (array<struct<skip, take, loss>>), n_blocks.

    Rows of `turns` (conv_id, turn, role, text) are sorted by turn, then role and text. Adjacent turns of one role
    are one block: `<|im_start|>role\\n`, the texts with `<|im_next|>` between them, `<|im_end|>\\n`. Texts and roles
    are escaped, so parse_chats reads everything back exactly. The loss mask has a run per turn: `skip` code points
    of marks that never count, then `take` code points of text that count if `loss`; the closing mark is outside it.

    Null turns come last; null roles and texts are empty; repeated rows are turns of their own; rows with a null
    conv_id are one conversation. Other columns are ignored; an empty table gives no rows.

    Turns are first gathered in runs of `chunk` turn numbers and formatted there, so that a conversation of very
    many turns is put together from a few long strings and not from all its rows.
    """
    rows = turns.select(
        "conv_id",
        F.coalesce(F.col("turn").cast("long"), F.lit(2**62)).alias("turn"),
        escape_role(F.coalesce("role", F.lit(""))).alias("role"),
        escape(F.coalesce("text", F.lit(""))).alias("text"),
    )
    runs = rows.groupBy("conv_id", F.expr(f"turn div {chunk}").alias("run")).agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    before = F.concat(F.array(F.lit(None).cast("string")), F.slice(F.col("turns")["role"], 1, F.size("turns") - 1))
    marked = runs.select(
        "conv_id",
        "run",
        F.zip_with("turns", before, lambda t, b: F.struct(t["role"].alias("role"), t["text"].alias("text"), F.when(b.isNull(), F.lit("")).otherwise(_mark(b, t["role"])).alias("mark"))).alias("parts"),
    )
    texts = marked.select(
        "conv_id",
        "run",
        F.get("parts", F.lit(0))["role"].alias("head"),
        F.element_at("parts", -1)["role"].alias("tail"),
        F.array_join(F.transform("parts", lambda t: F.concat(t["mark"], t["text"])), "").alias("body"),
        F.transform(
            "parts",
            lambda t: F.struct(F.length(t["mark"]).cast("long").alias("skip"), F.length(t["text"]).cast("long").alias("take"), (t["role"] == escape_role(F.lit(trained_role))).alias("loss")),
        ).alias("mask"),
        F.size(F.filter("parts", lambda t: t["mark"].startswith(CLOSE))).cast("long").alias("blocks"),
    )
    gathered = texts.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("run", "head", "tail", "body", "mask", "blocks"))).alias("runs"))
    ends = F.concat(F.array(F.lit(None).cast("string")), F.slice(F.col("runs")["tail"], 1, F.size("runs") - 1))
    joined = gathered.select(
        "conv_id",
        F.zip_with(
            "runs",
            ends,
            lambda r, b: F.struct(
                F.when(b.isNull(), F.concat(F.lit(OPEN), r["head"], F.lit("\n"))).otherwise(_mark(b, r["head"])).alias("mark"),
                r["body"].alias("body"),
                r["mask"].alias("mask"),
                r["blocks"].alias("blocks"),
            ),
        ).alias("runs"),
    )
    led = lambda r: F.transform(r["mask"], lambda m, i: m.withField("skip", m["skip"] + F.when(i == 0, F.length(r["mark"]).cast("long")).otherwise(F.lit(0))))
    return joined.select(
        "conv_id",
        F.concat(F.array_join(F.transform("runs", lambda r: F.concat(r["mark"], r["body"])), ""), F.lit(f"{CLOSE}\n")).alias("formatted"),
        F.flatten(F.transform("runs", led)).alias("loss_mask"),
        F.aggregate("runs", F.lit(0).cast("long"), lambda a, r: a + r["blocks"] + F.when(r["mark"] == NEXT, F.lit(0)).otherwise(F.lit(1))).alias("n_blocks"),
    )


def parse_chats(formatted: Column) -> Column:
    """The turns of a formatted conversation, array<struct<role, text, length>>, unescaped; length is that in the formatted text."""
    blocks = F.filter(F.split(formatted, r"<\|im_end\|>\n"), lambda b: b.startswith(OPEN))

    def turns(block: Column) -> Column:
        head = F.substring_index(block, "\n", 1)
        role = unescape_role(F.substr(head, F.lit(len(OPEN) + 1)))
        body = F.substr(block, F.length(head) + F.lit(2))
        return F.transform(F.split(body, r"<\|im_next\|>"), lambda t: F.struct(role.alias("role"), unescape(t).alias("text"), F.length(t).cast("long").alias("length")))

    return F.flatten(F.transform(blocks, turns))


def loss_text(formatted: Column, mask: Column, chunk: int = CHUNK) -> Column:
    """All text under the loss mask, unescaped and joined, cut out of `formatted` by the mask's runs alone.

    Runs are taken `chunk` at a time: their part of the text is cut out first, and each run out of that, so a
    conversation of n turns costs about n * chunk and n * n / chunk steps, not n * n.
    """
    size = lambda m: m["skip"] + m["take"]
    total = lambda runs: F.aggregate(runs, F.lit(0).cast("long"), lambda a, m: a + size(m))
    chunks = F.when(F.size(mask) > 0, F.transform(F.sequence(F.lit(1), F.size(mask), F.lit(chunk)), lambda i: F.slice(mask, i, F.lit(chunk))))
    starts = lambda lengths: F.aggregate(lengths, F.array(F.lit(0).cast("long")), lambda a, n: F.concat(a, F.array(F.element_at(a, -1) + n)))
    cut = lambda text, at, n: F.substr(text, (at + 1).cast("int"), n.cast("int"))

    def under(part: Column, runs: Column) -> Column:
        texts = F.zip_with(runs, starts(F.transform(runs, size)), lambda m, at: F.when(m["loss"], cut(part, at + m["skip"], m["take"])))
        return F.array_join(F.filter(texts, lambda t: t.isNotNull()), "")

    pieces = F.zip_with(chunks, starts(F.transform(chunks, total)), lambda runs, at: F.when(runs.isNotNull(), under(cut(formatted, at, total(runs)), runs)))
    return unescape(F.coalesce(F.array_join(F.filter(pieces, lambda t: t.isNotNull()), ""), F.lit("")))
