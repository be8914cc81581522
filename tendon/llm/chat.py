"""Chat formatting with a grammar round trip, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The template. A conversation is a run of turns: OPEN role MIDDLE text CLOSE; a turn whose role and text are escaped has OPEN_ESCAPED.
OPEN, OPEN_ESCAPED, MIDDLE, CLOSE, END = "### ", "###\\ ", ": ", "</turn>", "\n"
TURNS = "array<struct<role:string,text:string>>"


def escape(text: Column) -> Column:
    """Double every backslash, then break every control string by a new one."""
    for sign, broken in (("\\", "\\\\"), ("#", "\\#"), (MIDDLE, ":\\ "), (CLOSE, "<\\/turn>")):
        text = F.replace(text, F.lit(sign), F.lit(broken))
    return text


def unescape(text: Column) -> Column:
    """Undo `escape`: a backslash gives way to the sign behind it, from left to right."""
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def render_turn(turn: Column, escaped: Column) -> Column:
    """The turn in two parts: what stands before its text, and its text as written."""
    role, text = turn["role"], turn["text"]
    return F.struct(F.when(escaped, F.concat(F.lit(OPEN_ESCAPED), escape(role), F.lit(MIDDLE))).otherwise(F.concat(F.lit(OPEN), role, F.lit(MIDDLE))).alias("head"),
                    F.when(escaped, escape(text)).otherwise(text).alias("body"), escaped.alias("escaped"))


def written(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(t["head"], t["body"], F.lit(CLOSE + END))), "")


def parse(formatted: Column) -> Column:
    """Turns (role, text) that the grammar reads, as an array.

    The string is split at CLOSE and the line feed behind it; a part opens with OPEN or OPEN_ESCAPED, holds OPEN nowhere else, and its role
    ends at the first MIDDLE. A part that does not is read as a turn without role and text.
    """
    parts = F.split(formatted, CLOSE + END + "?", -1)
    return F.transform(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), _parse_turn)


def _parse_turn(part: Column) -> Column:
    escaped = part.startswith(F.lit(OPEN_ESCAPED))
    size = F.when(escaped, F.lit(len(OPEN_ESCAPED))).when(part.startswith(F.lit(OPEN)), F.lit(len(OPEN)))
    body = F.substring(part, size + 1, F.length(part))
    at = F.when(~F.contains(body, F.lit(OPEN)), F.nullif(F.instr(body, MIDDLE), F.lit(0)))
    role, text = F.substring(body, F.lit(1), at - 1), F.substring(body, at + len(MIDDLE), F.length(body))
    return F.struct(F.when(escaped, unescape(role)).otherwise(role).alias("role"), F.when(escaped, unescape(text)).otherwise(text).alias("text"))


def format_chats(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", learn: str = "assistant") -> DataFrame:
    """(conversation, formatted, loss): one row per conversation; loss is an array of (start, length, escaped), the texts of role `learn` in
    `formatted`, by code points from 1.

    Every turn is first written as it is and the whole string is parsed. Where the turns that come back differ from the source, the turns that
    do not survive a round trip of their own are escaped, then, should a difference remain, all turns; escaped text holds
    no control string, so the last form always comes back. A form that did not would stop the query.

    Very long texts are written and parsed whole. Null roles and texts count as empty. Turns go by number (null first), ties by role and text; repeated rows are turns of their own. A
    null conversation id is a conversation. An empty table gives no rows. Other columns are not looked at.
    A conversation is one string in the result, so its turns meet in one row; nothing else is gathered.
    """
    one = F.struct(F.col(turn).alias("n"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    chats = rows.groupBy(conv).agg(F.array_sort(F.collect_list(one)).alias("__rows"))
    chats = chats.select(conv, F.transform("__rows", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).cast(TURNS).alias("__turns"))

    def form(when):
        return F.transform("__turns", lambda t: render_turn(t, when(t)))

    def holds(col: str) -> Column:
        return parse(written(F.col(col))).cast(TURNS) == F.col("__turns")

    def lone(t: Column) -> Column:
        return ~(parse(written(F.array(render_turn(t, F.lit(False))))).cast(TURNS) == F.array(t).cast(TURNS))

    plain = chats.withColumn("__plain", form(lambda t: F.lit(False)))
    some = plain.withColumn("__some", F.when(~holds("__plain"), form(lone)).otherwise(F.col("__plain")))
    done = some.withColumn("__form", F.when(~holds("__some"), form(lambda t: F.lit(True))).otherwise(F.col("__some")))
    done = done.withColumn("__form", F.when(holds("__form"), F.col("__form")).otherwise(F.raise_error(F.lit("a conversation does not come back from its template"))))
    start = F.aggregate(F.col("__form"), F.struct(F.lit(0).cast("long").alias("end"), F.array().cast("array<bigint>").alias("starts")), lambda a, t: F.struct(
        (a["end"] + F.length(t["head"]) + F.length(t["body"]) + len(CLOSE + END)).alias("end"),
        F.concat(a["starts"], F.array(a["end"] + F.length(t["head"]) + 1)).alias("starts")))["starts"]
    spans = F.transform(F.arrays_zip(F.col("__turns").alias("t"), F.col("__form").alias("f"), F.col("__starts").alias("s")), lambda z: F.when(
        z["t"]["role"] == learn, F.struct(z["s"].alias("start"), F.length(z["f"]["body"]).cast("long").alias("length"), z["f"]["escaped"].alias("escaped"))))
    return (done.withColumn("__starts", start).select(conv, written(F.col("__form")).alias("formatted"), F.filter(spans, lambda x: x.isNotNull()).alias("loss")))


def loss_text(formatted: Column, loss: Column) -> Column:
    """Text under the loss mask, unescaped, nothing between."""
    def part(s: Column) -> Column:
        raw = F.substring(formatted, s["start"].cast("int"), s["length"].cast("int"))
        return F.when(s["escaped"], unescape(raw)).otherwise(raw)
    return F.array_join(F.transform(loss, part), "")
