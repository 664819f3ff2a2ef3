"""Chat formatting with a grammar round trip; DataFrame functions only.

Grammar of a formatted conversation::

    conversation = { turn }
    turn         = "### " role ": " body " </turn>" newline
    role         = percent-encoded, so it has neither space nor colon
    body         = text in which a backslash quotes the character after it

The parser is deterministic: it cuts after each turn end, takes the role up to the
first ": ", and drops quoting backslashes. A text is first rendered as it is; if the
parser does not give back exactly that one turn, the next escaping level is tried
(backslashes, then control strings too) until it does. So most texts stay as they are.
The whole conversation is then parsed and compared with its source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import prefix_sums

# The template.
BEGIN, MIDDLE, END = "### ", ": ", " </turn>\n"
LOSS_ROLE = "assistant"

_TURN = "struct<role:string,text:string>"


def _levels(text: Column) -> list[Column]:
    """Bodies to try, in order; the last quotes everything that the grammar could take for its own."""
    quoted = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return [text, quoted, F.replace(F.replace(quoted, F.lit("</turn>"), F.lit("<\\/turn>")), F.lit("#"), F.lit("\\#"))]


def _unquoted(body: Column) -> Column:
    parts = F.split(body, r"\\\\")
    return F.array_join(F.transform(parts, lambda p: F.replace(p, F.lit("\\"), F.lit(""))), "\\")


def render_turn(role: Column, body: Column) -> Column:
    return F.concat(F.lit(BEGIN), F.url_encode(role), F.lit(MIDDLE), body, F.lit(END))


def parse(formatted: Column) -> Column:
    """array<struct<role, text>> of a formatted conversation."""
    pieces = F.split(formatted, END)
    whole = F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0)))

    def turn(piece: Column) -> Column:
        at = F.instr(piece, MIDDLE)
        role = F.url_decode(F.substr(piece, F.lit(len(BEGIN) + 1), at - len(BEGIN) - 1))
        return F.struct(role.alias("role"), _unquoted(F.substr(piece, at + len(MIDDLE))).alias("text"))

    return F.transform(whole, turn)


def escape(rows: DataFrame) -> DataFrame:
    """``rows(role, text)`` plus ``body``: the first level whose rendering parses back to exactly that turn."""
    source = F.array(F.struct(F.col("role"), F.col("text")))
    body = F.raise_error(F.lit("a turn does not survive the round trip"))
    for level in reversed(_levels(F.col("text"))):
        body = F.when(parse(render_turn(F.col("role"), level)) == source, level).otherwise(body)
    plain = ~F.contains("text", F.lit("\\")) & ~F.contains("text", F.lit("</turn>"))
    return rows.withColumn("body", F.when(plain & (parse(render_turn(F.col("role"), F.col("text"))) == source), F.col("text")).otherwise(body))


def format_conversations(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id``, ``formatted``, ``mask`` (array<struct<start, end>>, code points of bodies under the loss), ``turns`` read back.

    Rows are ordered by turn; equal turns by role, then text, then nothing (such rows
    are the same). A null turn comes first, a null role or text is empty, null ids are
    one conversation. Only these four columns are read. The digest of a conversation
    needs all of it in order, so a conversation is one row, as large as its texts; rows
    are gathered before the shuffle, as arrays.
    """
    own = rows.select(
        F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    # Most bodies are the text: only others are carried beside it.
    body = F.when(F.col("body") != F.col("text"), F.col("body")).alias("body")
    rendered = escape(own).select("conv_id", F.struct("turn", "role", "text", body).alias("t"))
    grouped = rendered.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    shown = lambda t: F.coalesce(t["body"], t["text"])
    formatted = F.array_join(F.transform("ts", lambda t: render_turn(t["role"], shown(t))), "")
    head = lambda t: F.length(F.url_encode(t["role"])) + len(BEGIN) + len(MIDDLE)
    starts = prefix_sums(F.transform("ts", lambda t: (head(t) + F.length(shown(t)) + len(END)).cast("long")))
    bodies = F.filter(F.arrays_zip(F.col("ts").alias("t"), starts.alias("at")), lambda z: z["t"]["role"] == LOSS_ROLE)
    begin = lambda z: z["at"] + head(z["t"])
    mask = F.transform(bodies, lambda z: F.struct(begin(z).alias("start"), (begin(z) + F.length(shown(z["t"]))).alias("end")))
    source = F.transform("ts", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    found = grouped.select("conv_id", formatted.alias("formatted"), mask.alias("mask"), source.alias("source")).withColumn("turns", parse(F.col("formatted")))
    same = F.when(F.col("turns") == F.col("source"), F.col("turns")).otherwise(F.raise_error(F.lit("a conversation does not survive the round trip")))
    return found.select("conv_id", "formatted", "mask", same.alias("turns"))


def report(rows: DataFrame) -> DataFrame:
    """Counts and digests read back from the formatted conversations.

    Nulls, ties and repeated rows as ``format_conversations`` says; a role other than the
    loss role counts as a turn without loss. Texts are rendered whole. An empty table
    gives an empty result.
    """
    found = format_conversations(rows)
    line = lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))
    under = F.array_join(F.transform(F.filter("turns", lambda t: t["role"] == LOSS_ROLE), lambda t: t["text"]), "")
    return found.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", line), ""), 256).alias("turns_sha256"),
        F.length(under).cast("long").alias("loss_chars"),
        F.sha2(under, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
