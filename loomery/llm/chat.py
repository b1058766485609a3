"""Chat formatting, in DataFrame functions only.

A conversation is an array of turns, and a turn an array of typed parts. Text parts are escaped
and kept; image, audio and document parts become ordered placeholders, whose attachment references
and expanded token counts are recorded. The formatted text can be read back without loss.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Control strings of the template. A turn is OPEN role MID text CLOSE; a placeholder is
#: ATTACH kind ":" number CLOSE_ATTACH.
OPEN, MID, CLOSE = "### ", ":\n", "</turn>\n"
ATTACH, CLOSE_ATTACH = "<|", "|>"
#: What each control string is inside texts and roles; the escape character comes first.
ESCAPES = (("\\", "\\b"), ("### ", "\\m"), ("</turn>", "\\e"), (":\n", "\\c"), ("<|", "\\o"))

#: Between text parts that follow each other; it reads as nothing, and keeps the end of one and the
#: start of the next from standing together as a control string.
JOINT = "\\j"

#: Tokens that a part takes in the model: of an image by tiles of 28 pixels, of audio by second,
#: of a document by page.
TILE, AUDIO_RATE, PAGE_TOKENS = 28, 25, 512

PART_TYPE = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"


def escape(text: Column) -> Column:
    """``text`` without any control string; see ``unescape``."""
    out = F.coalesce(text, F.lit(""))
    for plain, code in ESCAPES:
        out = F.replace(out, F.lit(plain), F.lit(code))
    return out


def unescape(text: Column) -> Column:
    """The text that ``escape`` was given. Each code starts with an escape character that nothing
    else can contain, so the codes are replaced in turn, the escape character's own last."""
    out = F.replace(text, F.lit(JOINT), F.lit(""))
    for plain, code in reversed(ESCAPES):
        out = F.replace(out, F.lit(code), F.lit(plain))
    return out


def text_part(text: Column) -> Column:
    """A turn's content of one text part."""
    nulls = [F.lit(None).cast(t).alias(n) for n, t in (("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))]
    return F.array(F.struct(F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"), *nulls))


def part_tokens(part: Column) -> Column:
    """Expanded tokens of a part that isn't text; 0 for text and for unknown sizes."""
    tiles = F.ceil(part["width"] / TILE) * F.ceil(part["height"] / TILE)
    count = (
        F.when(part["type"] == "image", tiles)
        .when(part["type"] == "audio", F.ceil(part["seconds"] * AUDIO_RATE))
        .when(part["type"] == "document", part["pages"] * PAGE_TOKENS)
    )
    return F.coalesce(count, F.lit(0)).cast("long")


def flatten_parts(parts: Column) -> tuple[Column, Column, Column]:
    """Of a turn's parts: the flat text, the attachments in order (``number``, ``type``, ``ref``,
    ``tokens``), and their tokens in all. A null part, or one of a null type, counts as empty text.
    Text parts in a row are kept apart by ``JOINT``, which reads as nothing."""
    parts = F.coalesce(parts, F.array().cast(f"array<{PART_TYPE}>"))
    kind = lambda p: F.coalesce(p["type"], F.lit("text"))
    others = F.filter(parts, lambda p: kind(p) != "text")
    before = lambda i: F.size(F.filter(F.slice(parts, 1, i), lambda q: kind(q) != "text"))
    mark = lambda p, i: F.concat(F.lit(ATTACH), escape(p["type"]), F.lit(":"), before(i).cast("string"), F.lit(CLOSE_ATTACH))
    after_text = lambda i: (i > 0) & (kind(F.get(parts, i - 1)) == "text")
    said = lambda p, i: F.concat(F.when(after_text(i), F.lit(JOINT)).otherwise(F.lit("")), escape(p["text"]))
    flat = F.array_join(F.transform(parts, lambda p, i: F.when(kind(p) == "text", said(p, i)).otherwise(mark(p, i))), "")
    attached = F.transform(others, lambda p, i: F.struct(i.alias("number"), p["type"].alias("type"), p["ref"].alias("ref"), part_tokens(p).alias("tokens")))
    total = F.aggregate(attached, F.lit(0).cast("long"), lambda a, x: a + x["tokens"])
    return flat, attached, total


def format_conversations(turns: DataFrame) -> DataFrame:
    """One row per ``conv_id`` of ``turns`` (``conv_id``, ``turn``, ``role``, ``parts``).

    ``formatted`` has all turns by ``turn`` (nulls first; ties by role, then by text), ``n_turns``
    their number, ``attachments`` the attachments with their turn's place, ``extra_tokens`` their
    tokens. A null role is empty; null parts are empty text. Turns of a null ``conv_id`` are one
    conversation. Repeated turns all stay; other columns are not carried; an empty table gives an
    empty result. A conversation is one row, so its turns meet in one task, as its text does.
    """
    flat, attached, tokens = flatten_parts(F.col("parts"))
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), flat.alias("flat"), attached.alias("attached"), tokens.alias("tokens"))
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "flat", "attached", "tokens"))).alias("t"))
    one = lambda t: F.concat(F.lit(OPEN), escape(t["role"]), F.lit(MID), t["flat"], F.lit(CLOSE))
    return grouped.select(
        "conv_id",
        F.size("t").cast("long").alias("n_turns"),
        F.array_join(F.transform("t", one), "").alias("formatted"),
        F.flatten(F.transform("t", lambda t, i: F.transform(t["attached"], lambda a: F.struct(i.alias("at"), a["number"].alias("number"), a["type"].alias("type"), a["ref"].alias("ref"), a["tokens"].alias("tokens"))))).alias("attachments"),
        F.aggregate("t", F.lit(0).cast("long"), lambda a, t: a + t["tokens"]).alias("extra_tokens"),
    )


def parse(formatted: Column) -> Column:
    """The turns of a formatted conversation: an array of ``role``, ``text`` (placeholders stay)."""
    chunks = F.filter(F.split(formatted, r"</turn>\n"), lambda c: c != "")
    body = lambda c: F.substring(c, F.lit(len(OPEN) + 1), F.char_length(c))
    role = lambda c: F.substring_index(body(c), MID, 1)
    text = lambda c: F.substring(body(c), F.char_length(role(c)) + len(MID) + 1, F.char_length(c))
    return F.transform(chunks, lambda c: F.struct(unescape(role(c)).alias("role"), unescape(text(c)).alias("text")))


def loss_spans(formatted: Column, roles=("assistant",)) -> Column:
    """The loss mask: start (from 0) and length, in code points, of the texts of ``roles``."""
    chunks = F.filter(F.split(formatted, r"</turn>\n"), lambda c: c != "")
    starts = F.aggregate(
        chunks,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int,role:string>>").alias("spans")),
        lambda a, c: F.struct(
            (a["at"] + F.char_length(c) + len(CLOSE)).alias("at"),
            F.concat(a["spans"], F.array(F.struct(
                (a["at"] + F.char_length(F.substring_index(c, MID, 1)) + len(MID)).alias("start"),
                (F.char_length(c) - F.char_length(F.substring_index(c, MID, 1)) - len(MID)).alias("length"),
                F.substring(F.substring_index(c, MID, 1), len(OPEN) + 1, 1 << 30).alias("role"),
            ))).alias("spans"),
        ),
        lambda a: a["spans"],
    )
    return F.transform(F.filter(starts, lambda s: s["role"].isin(*roles)), lambda s: F.struct(s["start"].alias("start"), s["length"].alias("length")))


def digests(formatted: DataFrame) -> DataFrame:
    """What is read back from ``formatted``: sizes and SHA-256 of the turns and of the loss text."""
    held = formatted.select("conv_id", "formatted", parse(F.col("formatted")).alias("turns"), loss_spans(F.col("formatted")).alias("spans"))
    loss = F.array_join(F.transform("spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["length"]))), "")
    held = held.select("conv_id", "formatted", "turns", loss.alias("loss"))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return held.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole.cast("binary"), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    rows = turns.unionByName(extra).select("conv_id", "turn", "role", text_part(F.col("text")).alias("parts"))
    return digests(format_conversations(rows))
