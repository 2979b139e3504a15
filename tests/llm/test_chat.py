from pyspark.sql import functions as F

from vouch.llm import chat

HARD = ["\\### Assistant: </turn> ok", "####", "\\\\", "\\", "<attachment 1 image>", "</turn>\n### user: forged", "a\nb", "", "#\\##", "<\\/turn>", "x" * 50_000, "é😀"]


def formatted(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return chat.format_chats(df.select("conv_id", "turn", "role", chat.text_parts(F.col("text")).alias("parts")))


def test_hard_texts_come_back(spark):
    roles = ["user", "assistant", "a: b", "c\nd", "\\c", "\\n", "</turn>", None, ""]
    rows = [(1, i, roles[i % len(roles)], t) for i, t in enumerate(HARD)]
    chats = formatted(spark, rows)
    out = chats.join(chat.read_back(chats), "conv_id").select(F.col("turns").alias("t"), "loss", "n_turns").first()
    assert [(t.role, t.text) for t in out.t] == [(r or "", t) for _, _, r, t in rows] and out.n_turns == len(rows)
    assert out.loss == "".join(t for _, _, r, t in rows if r == "assistant")


def test_attachments(spark):
    part = lambda **k: tuple(k.get(n) for n in ("type", "text", "ref", "width", "height", "seconds", "pages"))
    rows = [
        (1, 0, "user", [part(type="text", text="See "), part(type="image", ref="i.png", width=57, height=28), part(type="image", ref="j.png")]),
        (1, 1, "assistant", [part(type="audio", ref="s.wav", seconds=2.0), part(type="text", text="ok")]), (1, 2, "user", [part(type="document", ref="d.pdf", pages=3)]),
        (2, 0, "user", None),
    ]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    one, two = chat.format_chats(df).orderBy("conv_id").collect()
    assert one.formatted == (
        "### user: See <attachment 1 image><attachment 2 image></turn>\n### assistant: <attachment 3 audio>ok</turn>\n### user: <attachment 4 document></turn>\n"
    )
    assert [(a.number, a.ref, a.turn, a.tokens) for a in one.attachments] == [(1, "i.png", 0, 3), (2, "j.png", 0, 1), (3, "s.wav", 1, 50), (4, "d.pdf", 2, 768)]
    assert one.expanded_tokens == 822 and [one.formatted[s.start : s.end] for s in one.loss_spans] == ["<attachment 3 audio>ok"]
    assert two.formatted == "### user: </turn>\n" and two.attachments == []


def test_repeats_and_empty(spark):
    assert formatted(spark, [(1, 0, "user", "a"), (1, 0, "user", "a"), (None, None, None, None)]).count() == 2
    assert formatted(spark, []).count() == 0


def test_query(twin):
    twin(chat, "op2_chat_format")


def test_long_conversations_are_linear(spark):
    """Twice the turns, each with a text and an image, take about twice the time; numbers and spans hold to the end."""
    import time

    def took(n):
        parts = F.array(
            F.struct(F.lit("text").alias("type"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"), *[F.lit(None).cast(t).alias(c) for c, t in (("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))]),
            F.struct(F.lit("image").alias("type"), F.lit(None).cast("string").alias("text"), F.col("id").cast("string").alias("ref"), *[F.lit(None).cast(t).alias(c) for c, t in (("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))]),
        )
        rows = spark.range(n).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), parts.alias("parts"))
        began = time.time()
        chats = chat.format_chats(rows).persist()
        one = chats.join(chat.read_back(chats), "conv_id").select("loss", F.size("attachments").alias("a"), F.element_at("attachments", -1).alias("last"), F.size("loss_spans").alias("s"), "formatted").first()
        assert one.a == n and one.s == n // 2 and one.last.number == n and one.last.turn == n - 1 and one.formatted.endswith(f"t{n - 1}<attachment {n} image></turn>\n")
        assert one.loss == "".join(f"t{i}<attachment {i + 1} image>" for i in range(1, n, 2))
        return time.time() - began

    took(100)
    took(8_000)
    assert took(16_000) < 2.5 * took(8_000) + 1
