r"""Chat formatting with a grammar round trip, in DataFrame functions only.

A conversation is rendered as ``<|chatL|>`` and, for each turn,
``<|turn|>role<|text|>text<|end|>``; L is the escape level. The rendered string is parsed
again by splitting on the marks, the recovered turns are compared with the source, and the
level rises until they are identical:

* level 0: role and text as they are, if they hold none of the control strings ``CONTROL``;
* level 1: ``\`` becomes ``\\``, ``<`` becomes ``\l`` and ``[`` becomes ``\b``, so that no content
  holds a mark or another control string;
* level 2: role and text in hexadecimal (any content round-trips).

Defined cases: a null role or text counts as empty; turns sort by (turn, role, text), null
turns first, so ties and repeated rows are all kept in one fixed order; rows with a null
conv_id form one conversation; an empty table gives an empty result; other columns of the
input are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: What may steer a model: the marks of this template and of others. Contents that hold any are escaped.
CONTROL = ("<|", "<s>", "</s>", "[INST]", "[/INST]")


def _esc(c: Column, level: int) -> Column:
    if level == 0:
        return c
    if level == 1:
        for what, by in (("\\", "\\\\"), ("<", "\\l"), ("[", "\\b")):
            c = F.replace(c, F.lit(what), F.lit(by))
        return c
    return F.hex(F.encode(c, "UTF-8"))


def _unesc(c: Column, level: int) -> Column:
    if level == 0:
        return c
    if level == 1:
        # no "<" or "[" is left in escaped content, so "<" may stand for an escaped backslash
        for what, by in (("\\\\", "<"), ("\\b", "["), ("\\l", "\\")):
            c = F.replace(c, F.lit(what), F.lit(by))
        return F.translate(c, "<\\", "\\<")
    return F.decode(F.unhex(c), "UTF-8")


def render(turns: Column, level: int) -> Column:
    """The formatted string of an array of (role, text)."""
    each = F.transform(
        turns,
        lambda t: F.concat(F.lit(TURN), _esc(t["role"], level), F.lit(TEXT), _esc(t["text"], level), F.lit(END)),
    )
    return F.concat(F.lit(f"<|chat{level}|>"), F.array_join(each, ""))


def parse(formatted: Column, level: int) -> Column:
    """The deterministic parser: turns as (role, text) with the raw content between the marks."""
    body = F.substring(formatted, F.lit(len("<|chat0|>") + 1), F.lit(2**31 - 1))
    pieces = F.split(body, r"\Q<|turn|>\E")
    pieces = F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0)))

    def one(p: Column) -> Column:
        role = F.substring_index(p, TEXT, 1)
        raw = F.substring_index(F.substring(p, F.length(role) + len(TEXT) + 1, F.lit(2**31 - 1)), END, 1)
        return F.struct(_unesc(role, level).alias("role"), _unesc(raw, level).alias("text"), role.alias("raw_role"), raw.alias("raw_text"))

    return F.transform(pieces, one)


def _plain(turns: Column) -> Column:
    return F.transform(turns, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))


def _with(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with the value worked out once even where ``use`` goes through an array."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _length(c: Column, level: int) -> Column:
    return F.octet_length(c) * 2 if level == 2 else F.length(_esc(c, level))


def format_chats(rows: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, level, formatted, turns (read back), loss_spans.

    ``turns`` are what the parser recovers from ``formatted``. ``loss_spans`` lists, for each
    assistant turn in order, the half-open character span of its content in ``formatted``; where a
    turn starts is a running sum over the rows, so a conversation costs in proportion to its turns.
    """
    rows = rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    before = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    size = lambda level: _length(F.col("role"), level) + _length(F.col("text"), level) + len(TURN + TEXT + END)
    rows = rows.withColumns({f"at{k}": F.coalesce(F.sum(size(k)).over(before), F.lit(0)) + len("<|chat0|>") for k in (0, 1, 2)})
    chats = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text", "at0", "at1", "at2"))).alias("_t"))
    chats = chats.withColumn("_source", _plain(F.col("_t")))
    for level in (0, 1):
        chats = chats.withColumn(f"_f{level}", render(F.col("_source"), level))
        chats = chats.withColumn(f"_p{level}", parse(F.col(f"_f{level}"), level))
        chats = chats.withColumn(f"_ok{level}", _plain(F.col(f"_p{level}")).eqNullSafe(F.col("_source")))
    held = lambda c: reduce(or_, (F.contains(c, F.lit(x)) for x in CONTROL))
    chats = chats.withColumn("_ok0", F.col("_ok0") & ~F.exists("_source", lambda t: held(t["role"]) | held(t["text"])))
    safe = render(F.col("_source"), 2)
    choose = lambda a, b, c: F.when(F.col("_ok0"), a).when(F.col("_ok1"), b).otherwise(c)
    at = lambda k: F.transform("_t", lambda t: t[f"at{k}"])
    chats = chats.select(
        "conv_id",
        choose(F.lit(0), F.lit(1), F.lit(2)).alias("level"),
        choose(F.col("_f0"), F.col("_f1"), safe).alias("formatted"),
        choose(F.col("_p0"), F.col("_p1"), parse(safe, 2)).alias("turns"),
        choose(at(0), at(1), at(2)).alias("_at"),
    )
    spans = F.zip_with(
        F.col("turns"),
        F.col("_at"),
        lambda t, a: F.struct(
            t["role"].alias("role"),
            (a + len(TURN) + F.length(t["raw_role"]) + len(TEXT)).alias("start"),
            F.length(t["raw_text"]).alias("n"),
        ),
    )
    loss = F.transform(
        F.filter(spans, lambda s: s["role"] == "assistant"),
        lambda s: F.struct(s["start"].alias("start"), (s["start"] + s["n"]).alias("end")),
    )
    return chats.select("conv_id", "level", "formatted", _plain(F.col("turns")).alias("turns"), loss.alias("loss_spans"))


def digests(chats: DataFrame) -> DataFrame:
    """The contract's columns, all derived from ``formatted``, ``turns`` and ``loss_spans``.

    Spans are cut out of the string in UTF-32, where a character's place is known without counting.
    """
    cut = lambda wide, s: F.decode(F.substring(wide, (4 * s["start"] + 1).cast("int"), (4 * (s["end"] - s["start"])).cast("int")), "UTF-32")
    plain = lambda c: F.when(F.col("level") == 0, c).when(F.col("level") == 1, _unesc(c, 1)).otherwise(_unesc(c, 2))
    loss = F.array_join(_with(F.encode("formatted", "UTF-32"), lambda wide: F.transform("loss_spans", lambda s: plain(cut(wide, s)))), "")
    said = F.array_join(F.transform(F.col("turns"), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return chats.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.encode(said, "UTF-8"), 256).alias("turns_sha256"),
        loss.alias("_loss"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    ).select(
        "conv_id",
        "n_turns",
        "turns_sha256",
        F.length("_loss").cast("long").alias("loss_chars"),
        F.sha2(F.encode("_loss", "UTF-8"), 256).alias("loss_sha256"),
        "formatted_chars",
    )
