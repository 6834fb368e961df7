"""Chat formatting whose output is parsed again and compared with its source.

A turn is rendered as

    <s>[INST]role LINE_END text[/INST]      text that is only context
    <s>role LINE_END text</s>               text to be learned (role ``assistant``)

with no blanks around the marks. The grammar allows none of the four marks inside a turn. Text
is first rendered as it is; if parsing the turn does not give back its role and
text, the marks inside get a backslash after their first character (those that
already look like that get one more), which the parser always takes off.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

TRAINED = "assistant"
START, END, OPEN, CLOSE = "<s>", "</s>", "[INST]", "[/INST]"
_MARK = r"</?s>|\[/?INST\]"


def escaped(text: Column) -> Column:
    text = F.regexp_replace(text, r"<(\\*/?s>)", r"<\\$1")
    return F.regexp_replace(text, r"\[(\\*/?INST\])", r"[\\$1")


def unescaped(text: Column) -> Column:
    text = F.regexp_replace(text, r"<\\(\\*/?s>)", "<$1")
    return F.regexp_replace(text, r"\[\\(\\*/?INST\])", "[$1")


# Roles stand before the line end, so that and the first characters of marks are coded.
_ROLE_CODES = (("%", "%25"), ("\n", "%0A"), ("<", "%3C"), ("[", "%5B"))


def role_code(role: Column) -> Column:
    for plain, code in _ROLE_CODES:
        role = F.replace(role, F.lit(plain), F.lit(code))
    return role


def role_of(code: Column) -> Column:
    for plain, text in reversed(_ROLE_CODES):
        code = F.replace(code, F.lit(text), F.lit(plain))
    return code


def render_turn(role: Column, text: Column) -> Column:
    inner = F.concat(role_code(role), F.lit("\n"), text)
    trained = F.concat(F.lit(START), inner, F.lit(END))
    return F.when(role == TRAINED, trained).otherwise(F.concat(F.lit(START + OPEN), inner, F.lit(CLOSE)))


def _parse_piece(piece: Column) -> Column:
    """(trained, role, text) of what stands between two starts; null if it
    isn't a turn of the grammar."""
    context = F.startswith(piece, F.lit(OPEN))
    ends = F.when(context, F.endswith(piece, F.lit(CLOSE))).otherwise(F.endswith(piece, F.lit(END)))
    first = F.when(context, len(OPEN) + 1).otherwise(1)
    marks = F.when(context, len(OPEN + CLOSE)).otherwise(len(END))
    body = F.substr(piece, first, F.length(piece) - marks)
    line_end = F.instr(body, "\n")
    turn = F.struct(
        (~context).alias("trained"),
        role_of(F.substr(body, F.lit(1), line_end - 1)).alias("role"),
        unescaped(F.substr(body, line_end + 1)).alias("text"),
    )
    good = ends & (F.length(piece) >= marks) & (line_end > 0) & ~body.rlike(_MARK)
    return F.when(good & ((turn["role"] == TRAINED) == turn["trained"]), turn)


def parsed(formatted: Column) -> Column:
    """The turns of a formatted text, in order; a null element where it breaks
    the grammar."""
    pieces = F.split(formatted, START, -1)
    head = F.when(F.element_at(pieces, 1) != "", F.array(F.lit(None).cast("struct<trained:boolean,role:string,text:string>")))
    turns = F.transform(F.slice(pieces, F.lit(2), F.size(pieces)), _parse_piece)
    return F.concat(F.coalesce(head, F.array().cast("array<struct<trained:boolean,role:string,text:string>>")), turns)


def format_chats(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, ``formatted``, ``loss_spans`` (code points, end
    exclusive) and ``parsed`` for each conversation.

    Turns are ordered by turn, role and text, nulls first; repeated rows are
    turns of their own. Null roles and texts are empty; rows of null conv_id
    form one conversation. Other columns are ignored. An empty table gives no
    row. A conversation becomes one row, so it has to fit a string. The job
    fails if reading back ever differs from the source.
    """
    role = F.coalesce(F.col("role"), F.lit(""))
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    plain = parsed(render_turn(F.col("role"), F.col("text")))
    same = (F.size(plain) == 1) & (plain[0]["role"] == F.col("role")) & (plain[0]["text"] == F.col("text"))
    rows = rows.withColumn("_same", F.coalesce(same, F.lit(False)))
    safe = F.when(F.col("_same"), F.col("text")).otherwise(escaped(F.col("text")))
    rows = rows.withColumn("_safe", safe).withColumn("_out", render_turn(F.col("role"), F.col("_safe")))
    # The window and the grouping share one exchange by conv_id.
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_end", F.sum(F.length("_out")).over(order))
    turn = F.struct(F.col("_end").alias("end"), F.length("_safe").cast("long").alias("chars"), "role", "text", F.col("_out").alias("out"))
    chats = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("_turns"))
    spans = F.transform(
        F.filter("_turns", lambda t: t["role"] == TRAINED),
        lambda t: F.struct((t["end"] - len(END) - t["chars"]).alias("start"), (t["end"] - len(END)).alias("end")),
    )
    chats = chats.select(
        "conv_id",
        F.size("_turns").cast("long").alias("n_turns"),
        F.array_join(F.transform("_turns", lambda t: t["out"]), "").alias("formatted"),
        spans.alias("loss_spans"),
        F.transform("_turns", lambda t: F.struct((t["role"] == TRAINED).alias("trained"), t["role"], t["text"])).alias("_source"),
    )
    chats = chats.withColumn("parsed", parsed(F.col("formatted")))
    checked = F.when(F.col("parsed") == F.col("_source"), F.col("formatted")).otherwise(
        F.raise_error(F.concat(F.lit("a conversation does not come back from its format: "), F.coalesce(F.col("conv_id").cast("string"), F.lit("null"))))
    )
    return chats.withColumn("formatted", checked).drop("_source")


#: Code points of a text that are cut at one time, so that a long conversation of many turns isn't walked once a turn.
CUT = 4096


def with_learned(chats: DataFrame) -> DataFrame:
    """``chats`` with ``learned``, the texts that the loss mask covers, read
    from ``formatted`` and without escapes."""
    steps = F.sequence(F.lit(0).cast("long"), F.length("formatted").cast("long"), F.lit(CUT).cast("long"))
    blocks = F.transform(steps, lambda at: F.substr("formatted", (at + 1).cast("int"), F.lit(CUT)))

    def part(span: Column) -> Column:
        first, last = F.floor(span["start"] / CUT), F.floor(span["end"] / CUT)
        near = F.array_join(F.slice("_blocks", (first + 1).cast("int"), (last - first + 1).cast("int")), "")
        return unescaped(F.substr(near, (span["start"] - first * CUT + 1).cast("int"), (span["end"] - span["start"]).cast("int")))

    return chats.withColumn("_blocks", blocks).withColumn("learned", F.transform("loss_spans", part)).drop("_blocks")


def digest(chats: DataFrame) -> DataFrame:
    """Digests of what is read back: the turns by the grammar, the learned
    text through the loss mask."""
    said = F.transform("parsed", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    chats = with_learned(chats).withColumn("_learned", F.array_join("learned", ""))
    return chats.select(
        "conv_id",
        "n_turns",
        F.sha2(F.array_join(said, ""), 256).alias("turns_sha256"),
        F.length("_learned").cast("long").alias("loss_chars"),
        F.sha2("_learned", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
