r"""Chat formatting with typed content parts, all in DataFrame functions.

A message holds parts of type text, image, audio or document. Visiting the
parts of a conversation in order gives

    ### user: What is this? <attachment 1 image></turn>
    ### assistant: A cat.</turn>

so each attachment becomes one placeholder, numbered through the conversation;
its reference and the tokens it expands to are recorded beside the text.

Control strings inside a text are escaped by a backslash after their first
character, and each backslash is doubled, so `unescape` gives every text back
and no text can forge a turn or an attachment. A role is escaped likewise, its
colons too. Null texts, roles and parts are empty. Turns stand in the order of
`turn` (null first), then role, then content; a repeated row is a turn of its
own. An empty table has no conversation; further columns are not looked at,
whatever their names. A conversation is one row and so must fit in one (2 GB);
what is shuffled is each turn once, by conversation. Work is linear in the turns,
parts and characters of a conversation, however long.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vouch.llm.common import table

OPEN, CLOSE = "### ", "</turn>\n"
CONTROL = r"\\|#(?=##)|<(?=/turn>|attachment )"
PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
#: What an attachment expands to: an image token a PATCH x PATCH square, an audio token each 1 / AUDIO_RATE s, DOCUMENT_PAGE tokens a page.
PATCH, AUDIO_RATE, DOCUMENT_PAGE = 28, 25, 256


def escape(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), CONTROL, r"$0\\")


def escape_role(role: Column) -> Column:
    r"""As escape, and `:` to `\c`, a newline to `\n`."""
    return F.replace(F.replace(escape(role), F.lit(":"), F.lit("\\c")), F.lit("\n"), F.lit("\\n"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def unescape_role(text: Column) -> Column:
    r"""Doubled backslashes stand apart first, so that `\\c` isn't read as a colon."""
    parts = F.split(text, r"\\\\")
    plain = F.transform(parts, lambda p: unescape(F.replace(F.replace(p, F.lit("\\c"), F.lit(":")), F.lit("\\n"), F.lit("\n"))))
    return F.array_join(plain, "\\")


def text_parts(text: Column) -> Column:
    """A plain text as the only part of a message."""
    blank = {"ref": "string", "width": "int", "height": "int", "seconds": "double", "pages": "int"}
    fields = [F.lit("text").alias("type"), text.alias("text"), *[F.lit(None).cast(t).alias(n) for n, t in blank.items()]]
    return F.array(F.struct(*fields))


def is_attachment(part: Column) -> Column:
    return part["type"].isin("image", "audio", "document")


def expanded_tokens(part: Column) -> Column:
    """Tokens that take the place of an attachment; a missing measure counts as the least there can be."""
    side = lambda c: F.ceil(F.greatest(F.coalesce(c, F.lit(1)), F.lit(1)) / PATCH)
    return (
        F.when(part["type"] == "image", side(part["width"]) * side(part["height"]))
        .when(part["type"] == "audio", F.ceil(F.greatest(F.coalesce(part["seconds"], F.lit(0.0)), F.lit(0.0)) * AUDIO_RATE))
        .when(part["type"] == "document", F.greatest(F.coalesce(part["pages"], F.lit(1)), F.lit(1)) * DOCUMENT_PAGE)
        .otherwise(0)
        .cast("long")
    )


def format_chats(messages: DataFrame) -> DataFrame:
    """One row a conversation from messages (conv_id, turn, role, parts array<PART>).

    Returns conv_id, n_turns, formatted, loss_spans (code point offsets of each
    assistant content in formatted, end exclusive), attachments (number, type,
    ref, turn, tokens) and expanded_tokens. Parts of an unknown type are kept
    as text.

    Turns are shuffled once and sorted. Numbers of attachments and offsets of
    spans are running sums over a conversation's parts and turns, which lie in
    that one order; so the work is linear in turns and parts.
    """
    parts = F.coalesce(F.col("parts"), F.array().cast(f"array<{PART}>"))
    turns = messages.select("conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), parts.alias("parts")).alias("m"))
    chats = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("m")).alias("m"))

    # The visitor: a row a part, in order.
    each = chats.select("conv_id", F.posexplode("m").alias("i", "m"))
    each = each.select("conv_id", "i", "m.turn", "m.role", F.posexplode_outer("m.parts").alias("k", "part"))
    in_order = Window.partitionBy("conv_id").orderBy("i", "k").rowsBetween(Window.unboundedPreceding, 0)
    attached = F.coalesce(is_attachment(F.col("part")), F.lit(False))
    each = each.withColumn("number", F.sum(attached.cast("int")).over(in_order).cast("int"))
    mark = F.concat(F.lit("<attachment "), F.col("number").cast("string"), F.lit(" "), F.col("part.type"), F.lit(">"))
    shown = F.when(attached, mark).when(F.col("part").isNotNull(), escape(F.col("part.text"))).otherwise("")
    record = F.struct(F.col("number"), F.col("part.type").alias("type"), F.col("part.ref").alias("ref"), F.col("turn"), expanded_tokens(F.col("part")).alias("tokens"))
    each = each.select("conv_id", "i", "role", F.struct("k", shown.alias("shown"), F.when(attached, record).alias("attachment")).alias("p"))

    # A row a turn: its text, and where that begins.
    lines = each.groupBy("conv_id", "i").agg(F.first("role").alias("role"), F.sort_array(F.collect_list("p")).alias("p"))
    lines = lines.select(
        "conv_id", "i", (F.col("role") == "assistant").alias("loss"), F.concat(F.lit(OPEN), escape_role(F.col("role")), F.lit(": ")).alias("head"),
        F.array_join(F.transform("p", lambda p: p["shown"]), "").alias("body"), F.array_compact(F.transform("p", lambda p: p["attachment"])).alias("attachments"),
    )
    before = Window.partitionBy("conv_id").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    head, body = F.length("head").cast("long"), F.length("body").cast("long")
    begin = F.coalesce(F.sum(head + body + len(CLOSE)).over(before), F.lit(0).cast("long")) + head
    span = F.when(F.col("loss"), F.struct(begin.alias("start"), (begin + body).alias("end")))
    lines = lines.select("conv_id", F.struct("i", F.concat("head", "body", F.lit(CLOSE)).alias("line"), span.alias("span"), "attachments").alias("t"))
    whole = lines.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return whole.select(
        "conv_id",
        F.size("t").cast("long").alias("n_turns"),
        F.array_join(F.transform("t", lambda t: t["line"]), "").alias("formatted"),
        F.flatten(F.transform("t", lambda t: t["attachments"])).alias("attachments"),
        F.array_compact(F.transform("t", lambda t: t["span"])).alias("loss_spans"),
    ).withColumn("expanded_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda s, a: s + a["tokens"]))


def read_turn(line: Column) -> Column:
    """The (role, text) of a formatted turn without its end mark, escapes undone."""
    return F.struct(
        unescape_role(F.regexp_extract(line, r"(?s)^### ([^:]*): ", 1)).alias("role"),
        unescape(F.regexp_extract(line, r"(?s)^### [^:]*: (.*)$", 1)).alias("text"),
    )


def read_back(chats: DataFrame) -> DataFrame:
    """(conv_id, turns, loss, formatted_chars) of chats (conv_id, formatted, loss_spans), escapes undone.

    turns are (role, text); loss is the text under the loss mask. Each span ends
    where a turn does: turns, with their ends by a running sum, and spans are put
    in one order, so a span's turn stands right before it. Conversations stay
    where they are; nothing is shuffled for this.
    """
    blank = lambda kind: F.lit(None).cast(kind)
    split = F.split("formatted", CLOSE)
    pieces = F.transform(F.slice(split, 1, F.size(split) - 1), lambda x, i: F.struct(F.lit(0).alias("kind"), i.alias("n"), x.alias("text"), blank("long").alias("start"), blank("long").alias("end")))
    spans = F.transform("loss_spans", lambda x, i: F.struct(F.lit(1).alias("kind"), i.alias("n"), blank("string").alias("text"), x["start"].alias("start"), x["end"].alias("end")))
    rows = chats.select("conv_id", F.explode(F.concat(pieces, spans)).alias("x")).select("conv_id", "x.*")
    through = Window.partitionBy("conv_id").orderBy("kind", "n").rowsBetween(Window.unboundedPreceding, 0)
    size = F.length("text").cast("long") + len(CLOSE)
    rows = rows.withColumn("end", F.coalesce("end", F.sum(size).over(through) - len(CLOSE)))
    rows = rows.withColumn("turn", F.lag("text").over(Window.partitionBy("conv_id").orderBy("end", "kind")))
    begin = F.col("end") - F.length("turn")
    cut = unescape(F.substring("turn", (F.col("start") - begin + 1).cast("int"), (F.col("end") - F.col("start")).cast("int")))
    own, masked = F.col("kind") == 0, F.col("kind") == 1
    got = rows.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.when(own, F.struct("n", read_turn(F.col("text")).alias("turn"))))).alias("turns"),
        F.sort_array(F.collect_list(F.when(masked, F.struct("n", cut.alias("text"))))).alias("loss"), F.sum(size).alias("formatted_chars"),
    )
    return got.select("conv_id", F.transform("turns", lambda t: t["turn"]).alias("turns"), F.array_join(F.transform("loss", lambda t: t["text"]), "").alias("loss"), "formatted_chars")


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    chats = format_chats(rows.select("conv_id", "turn", "role", text_parts(F.col("text")).alias("parts")))
    line = lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))
    return read_back(chats).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", line), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )


QUERIES = {"op2_chat_format": op2_chat_format}
ORACLE_SQL = {
    "op2_chat_format": r"""
with rows as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
sized as (
  select *, length(text) + length(text) - length(replace(text, '\', ''))
    + length(text) - length(replace(text, '</turn>', '/turn>')) + length(text) - length(replace(text, '<attachment ', 'attachment '))
    + coalesce(list_sum(list_transform(regexp_extract_all(text, '###+'), lambda x: length(x) - 2)), 0) as body from rows)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  cast(sum(4 + length(role) + 2 + body + 8) as bigint) as formatted_chars
from sized group by conv_id
"""
}
