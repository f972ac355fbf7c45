"""Conversations as one marked string each, from typed content parts, with a loss mask.

A visitor flattens the parts of a turn in order: text is escaped, and an image, audio or document
part becomes a placeholder whose reference and expanded token count are recorded.  DataFrame
functions only.

Null texts, roles and references read as empty; null parts are skipped and unknown kinds read as
text; rows without a turn number come first.  Rows that repeat a turn are all kept, in the order
of role and content.  Rows without a conversation id form one conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

TURN, SAYS, END = "<|turn|>", "<|says|>", "<|end|>"
ATTACHED = ("image", "audio", "document")
# Control strings of common chat templates.  All of ours begin with the first.
RESERVED = ("<|", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]")
CHUNK_TURNS = 256
PART = ("struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>")


def _quoted(text: str) -> str:
    return "".join("\\" + c if not c.isalnum() else c for c in text)


def _after(opening: str) -> str:
    rests = "|".join(_quoted(s[1:]) for s in RESERVED if s[0] == opening)
    return rf"(?=\\*(?:{rests}))"


def escape(text: Column) -> Column:
    """Put one more backslash after the first character of every reserved string in the text.

    A reserved string may have any number of backslashes there already, so each level of escaping
    is distinct and `unescape` takes exactly one away.
    """
    openings = sorted({s[0] for s in RESERVED})
    return F.regexp_replace(text, "|".join(f"{_quoted(c)}{_after(c)}" for c in openings), "$0\\\\")


def unescape(text: Column) -> Column:
    openings = sorted({s[0] for s in RESERVED})
    pattern = "|".join(rf"({_quoted(c)})\\{_after(c)}" for c in openings)
    return F.regexp_replace(text, pattern, "".join(f"${k + 1}" for k in range(len(openings))))


def text_part(text: Column) -> Column:
    """A list of one text part."""
    return F.array(F.named_struct(F.lit("kind"), F.lit("text"), F.lit("text"), text,
                                  F.lit("ref"), F.lit(None), F.lit("width"), F.lit(None),
                                  F.lit("height"), F.lit(None), F.lit("seconds"), F.lit(None),
                                  F.lit("pages"), F.lit(None)).cast(PART))


def _visit(part: Column, patch: int, per_second: float, per_page: int) -> Column:
    """(body, attachment) of one part."""
    tokens = (
        F.when(part["kind"] == "image",
               F.ceil(F.coalesce(part["width"], F.lit(0)) / F.lit(patch))
               * F.ceil(F.coalesce(part["height"], F.lit(0)) / F.lit(patch)))
        .when(part["kind"] == "audio",
              F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * F.lit(per_second)))
        .when(part["kind"] == "document", F.coalesce(part["pages"], F.lit(0)) * F.lit(per_page)))
    attached = F.coalesce(part["kind"].isin(*ATTACHED), F.lit(False))
    return F.struct(
        F.when(attached, F.concat(F.lit("<|"), part["kind"], F.lit("|>")))
        .otherwise(escape(F.coalesce(part["text"], F.lit("")))).alias("body"),
        F.when(attached, F.struct(
            part["kind"].alias("kind"), F.coalesce(part["ref"], F.lit("")).alias("ref"),
            tokens.cast("long").alias("tokens"))).alias("attachment"))


def _joined(items: Column, field: str) -> Column:
    return F.array_join(F.transform(items, lambda x: x[field]), "")


def _starts(items: Column) -> Column:
    """Running start of each item by its `chars`."""
    return F.aggregate(
        items, F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<long>").alias("starts")),
        lambda acc, x: F.struct((acc["at"] + x["chars"]).alias("at"),
                                F.concat(acc["starts"], F.array(acc["at"])).alias("starts")),
        lambda acc: acc["starts"])


def _spans(items: Column) -> Column:
    """Loss spans of all items, moved to where the item begins."""
    return F.flatten(F.transform(
        F.arrays_zip(items.alias("item"), _starts(items).alias("at")),
        lambda x: F.transform(x["item"]["loss"], lambda s: F.struct(
            (s["start"] + x["at"]).alias("start"), s["length"].alias("length")))))


def format_chats(turns: DataFrame, loss_roles: tuple[str, ...] = ("assistant",), patch: int = 14,
                 tokens_per_second: float = 25.0, tokens_per_page: int = 256) -> DataFrame:
    """Rows (conv_id, turn, role, parts) to one row per conversation.

    `formatted`; `loss`, the spans (start, length in code points) to learn from; `attachments`
    (kind, ref, tokens) in the order of the placeholders; `attached_tokens`, their expanded count.
    Turns are formatted before the shuffle and joined in two steps, first within 256 turns, so a
    very long conversation is not gathered row by row in one task.
    """
    visited = F.transform(F.filter("parts", lambda p: p.isNotNull()),
                          lambda p: _visit(p, patch, tokens_per_second, tokens_per_page))
    head = F.concat(F.lit(TURN), escape(F.coalesce("role", F.lit(""))), F.lit(SAYS))
    rows = (
        turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"),
                     F.coalesce(visited, F.array().cast(
                         "array<struct<body:string,attachment:struct<kind:string,ref:string,tokens:bigint>>>"
                     )).alias("seen"))
        .withColumn("body", _joined(F.col("seen"), "body"))
        .withColumn("piece", F.concat(head, "body", F.lit(END)))
        .withColumn("loss", F.when(F.col("role").isin(*loss_roles), F.array(F.struct(
            F.length(head).cast("long").alias("start"),
            F.length("body").cast("long").alias("length")))).otherwise(
                F.array().cast("array<struct<start:bigint,length:bigint>>")))
        .select("conv_id", F.floor(F.col("turn") / CHUNK_TURNS).alias("chunk"), F.struct(
            "turn", "role", "piece", F.length("piece").cast("long").alias("chars"), "loss",
            F.filter(F.transform("seen", lambda s: s["attachment"]),
                     lambda a: a.isNotNull()).alias("attachments")).alias("item"))
    )
    for level in ("chunk", None):
        keys = ["conv_id"] + ([level] if level else [])
        items = F.col("items")
        rows = (
            rows.groupBy(*keys).agg(F.array_sort(F.collect_list("item")).alias("items"))
            .select(*keys, F.struct(
                *([F.col(level).alias("turn"), F.lit("").alias("role")] if level else []),
                _joined(items, "piece").alias("piece"),
                F.aggregate(items, F.lit(0).cast("long"), lambda n, x: n + x["chars"]).alias("chars"),
                _spans(items).alias("loss"),
                F.flatten(F.transform(items, lambda x: x["attachments"])).alias("attachments"),
            ).alias("item")))
    return rows.select(
        "conv_id", F.col("item.piece").alias("formatted"), F.col("item.loss").alias("loss"),
        F.col("item.attachments").alias("attachments"),
        F.aggregate("item.attachments", F.lit(0).cast("long"),
                    lambda n, a: n + a["tokens"]).alias("attached_tokens"))


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) of a formatted string, unescaped; placeholders stay in the text."""
    pieces = F.split(formatted, _quoted(TURN))
    def turn(piece: Column) -> Column:
        said = F.split(piece, _quoted(SAYS))
        body = said.getItem(1)
        return F.struct(unescape(said.getItem(0)).alias("role"), unescape(
            F.substring(body, F.lit(1), F.length(body) - len(END))).alias("text"))
    return F.transform(F.slice(pieces, F.lit(2), F.size(pieces)), turn)


def learned_text(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(loss, lambda s: unescape(
        F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
