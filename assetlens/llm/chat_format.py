"""Chat formatting with Spark expressions only.

A conversation's rows are collected as structs, sorted, merged into blocks of
adjacent same-role turns, and concatenated:

    <|im_start|>role\\n text <|im_sep|> text <|im_end|>\\n

The separator keeps turns of a block apart, so the formatted text reads back
into the very rows it came from.  A text may hold control strings: every
``<`` + n backslashes + ``|`` gets one backslash more, so ``<|`` appears in
markers only, and reading takes that backslash out again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", r"<$1|")


def escape_role(role: Column) -> Column:
    """Roles stand on a line of their own: %, line feeds and < are written
    as %25, %0A and %3C."""
    for plain, coded in (("%", "%25"), ("\n", "%0A"), ("<", "%3C")):
        role = F.replace(role, F.lit(plain), F.lit(coded))
    return role


def unescape_role(role: Column) -> Column:
    for plain, coded in (("<", "%3C"), ("\n", "%0A"), ("%", "%25")):
        role = F.replace(role, F.lit(coded), F.lit(plain))
    return role


def merge_turns(conversations: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """(conv_id, blocks): blocks of adjacent same-role turns, in turn order.

    Turns sort by (turn, role, text), nulls first, so ties have one order.
    Each turn lies in exactly one block's slice: the work is linear in turns.
    """
    turns = conversations.select(
        "conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"),
                            F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    sorted_turns = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    starts = sorted_turns.select("conv_id", "turns", F.expr(
        "filter(sequence(0, size(turns) - 1), i -> i = 0 OR turns[i].role != turns[greatest(i - 1, 0)].role)"
    ).alias("starts"))
    return starts.select("conv_id", F.expr("""
        transform(starts, (s, k) -> named_struct(
            'role', turns[s].role,
            'texts', transform(slice(turns, s + 1, coalesce(try_element_at(starts, k + 2), size(turns)) - s),
                               t -> t.text)))""").alias("blocks"))


def format_chat(conversations: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, formatted, segments.

    ``segments`` cuts ``formatted`` into pieces with a loss flag: true exactly
    for the (escaped) texts of ``loss_role`` turns, never for markers.  Null
    texts and roles count as empty, a null conv_id is a conversation of its
    own, an empty table gives no rows, and further columns are not read.
    """
    blocks = merge_turns(conversations)

    def pieces(block: Column) -> Column:
        def one(text: Column, i: Column) -> Column:
            lead = F.when(i == 0, F.lit("")).otherwise(F.lit(SEP))
            return F.array(F.struct(lead.alias("text"), F.lit(False).alias("loss")),
                           F.struct(escape(text).alias("text"), (block["role"] == loss_role).alias("loss")))
        head = F.struct(F.concat(F.lit(START), escape_role(block["role"]), F.lit("\n")).alias("text"),
                        F.lit(False).alias("loss"))
        tail = F.struct(F.lit(END).alias("text"), F.lit(False).alias("loss"))
        return F.concat(F.array(head), F.flatten(F.transform(block["texts"], one)), F.array(tail))

    segments = blocks.select("conv_id", F.flatten(F.transform("blocks", pieces)).alias("segments"))
    return segments.select("conv_id", F.array_join(F.col("segments.text"), "").alias("formatted"), "segments")


def read_back(formatted: Column) -> Column:
    """The turns (role, text) that a formatted text holds."""
    blocks = F.filter(F.split(formatted, r"<\|im_start\|>"), lambda b: b != "")

    def turns(block: Column) -> Column:
        role = unescape_role(F.substring_index(block, "\n", 1))
        body = F.regexp_replace(F.regexp_replace(block, r"(?s)^[^\n]*\n", ""), r"<\|im_end\|>\n$", "")
        return F.transform(F.split(body, r"<\|im_sep\|>"),
                           lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))
    return F.flatten(F.transform(blocks, turns))


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")


def formatted_digests(chats: DataFrame) -> DataFrame:
    """Counts and digests read back from the output of ``format_chat``."""
    read = chats.select("conv_id", "formatted", read_back(F.col("formatted")).alias("turns"),
                        loss_text(F.col("segments")).alias("loss"))
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))
