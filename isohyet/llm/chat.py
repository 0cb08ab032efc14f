"""Chat formatting with a grammar round trip, in SQL functions only.

Grammar (one alternative per turn, texts possibly escaped):

    user       <s>[INST](blank)TEXT [/INST]
    assistant  (blank)TEXT </s>
    system     <<SYS>>(newline)TEXT(newline)<</SYS>>(newline)(newline)
    others     <role:ROLE>(blank)TEXT </role>

A rendered text is read again by the same grammar, and content is escaped until what is
recovered is identical to the source. Any control string of the template inside a text is
a conflict, whether or not the parser happens to read it back. There are two escaped forms:

* Stand-ins, for texts that hold a control string and survive a reading of their turn: ``[``
  and ``<`` change places with U+E000 and U+E001, and a tab stands for the
  character that opens the text (the blank or newline above). Lengths stay the same.
* Backslashes, for texts that do not survive on their own, and for all turns of a
  conversation that still differs: one before each backslash and each of ``[ < >``. The parser takes
  those backslashes away again, so a text that happens to hold such a pair is a conflict too.

Roles of other kinds write ``\\ [ < >`` as ``\\b \\i \\l \\g``, so that no role can end its own marker.

Defined results: null texts and roles are empty; rows are ordered by turn (nulls first),
ties by role and text; repeated rows are turns of their own; a null conversation id is
one conversation; an empty table gives no rows; other columns are not looked at. A
conversation is one row of the result, and so must fit in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isohyet.llm.common import let, part, running, wide

#: The template's turns as patterns; the group is the text, for other roles the second group.
USER = r"<s>\[INST\][ \t]((?s:.*?)) \[/INST\]"
ASSISTANT = r"[ \t]((?s:.*?)) </s>"
SYSTEM = r"<<SYS>>[\n\t]((?s:.*?))\n<</SYS>>\n\n"
OTHER = r"<role:([^>]*+)>[ \t]((?s:.*?)) </role>"
TURN = f"{USER}|{ASSISTANT}|{SYSTEM}|{OTHER}"
#: What no text may hold as it is.
CONTROL = r"</?s>|\[/?INST\]|<</?SYS>>|<role:|</role>"
#: Characters that stand for each other in the form with stand-ins.
PLAIN, STAND_INS = "[<\ue000\ue001", "\ue000\ue001[<"
ROLE_MARKS = {"\\": "\\b", "[": "\\i", "<": "\\l", ">": "\\g"}


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\\[<>])", r"\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\\\[<>])", "$1")


def swap(text: Column) -> Column:
    return F.translate(text, PLAIN, STAND_INS)


def escape_role(role: Column) -> Column:
    for plain, mark in ROLE_MARKS.items():  # the backslash first
        role = F.replace(role, F.lit(plain), F.lit(mark))
    return role


def unescape_role(role: Column) -> Column:
    for plain, mark in reversed(ROLE_MARKS.items()):  # the backslash last
        role = F.replace(role, F.lit(mark), F.lit(plain))
    return role


def render(role: Column, text: Column, stand_ins: Column | None = None) -> Column:
    """One turn; the text as it is to stand there, and whether that is the form with stand-ins."""
    first = lambda c: F.lit(c) if stand_ins is None else F.when(stand_ins, "\t").otherwise(c)
    return (
        F.when(role == "user", F.concat(F.lit("<s>[INST]"), first(" "), text, F.lit(" [/INST]")))
        .when(role == "assistant", F.concat(first(" "), text, F.lit(" </s>")))
        .when(role == "system", F.concat(F.lit("<<SYS>>"), first("\n"), text, F.lit("\n<</SYS>>\n\n")))
        .otherwise(F.concat(F.lit("<role:"), escape_role(role), F.lit(">"), first(" "), text, F.lit(" </role>")))
    )


def _turn(piece: Column) -> Column:
    """(role, raw, lead) of one rendered turn; lead: characters before the text."""

    def whole(pattern: str, group: int = 1) -> Column:
        return F.regexp_extract(piece, f"^(?:{pattern})$", group)

    head = F.regexp_extract(piece, r"^<role:[^>]*+>[ \t]", 0)
    return (
        F.when(piece.startswith("<s>[INST]"), F.struct(F.lit("user").alias("role"), whole(USER).alias("raw"), F.lit(10).alias("lead")))
        .when(piece.startswith(" ") | piece.startswith("\t"), F.struct(F.lit("assistant").alias("role"), whole(ASSISTANT).alias("raw"), F.lit(1).alias("lead")))
        .when(piece.startswith("<<SYS>>"), F.struct(F.lit("system").alias("role"), whole(SYSTEM).alias("raw"), F.lit(8).alias("lead")))
        .otherwise(F.struct(unescape_role(whole(OTHER, 1)).alias("role"), whole(OTHER, 2).alias("raw"), F.length(head).alias("lead")))
    )


def source_text(raw: Column, opened_by: Column) -> Column:
    """The text that stands as *raw* behind its opening character."""
    return F.when(opened_by == "\t", swap(raw)).otherwise(unescape(raw))


def parse(formatted: Column) -> Column:
    """The turns of a formatted text: role, text, and the text's span in code points."""

    def turn(piece: Column, at: Column) -> Column:
        def made(t: Column) -> Column:
            begin = at + t["lead"]
            text = source_text(t["raw"], F.substring(piece, t["lead"], F.lit(1)))
            return F.struct(t["role"].alias("role"), text.alias("text"), begin.alias("start"), (begin + F.length(t["raw"])).alias("end"))

        return let(_turn(piece), made)

    return let(F.regexp_extract_all(formatted, F.lit(TURN), 0), lambda pieces: F.zip_with(pieces, running(F.transform(pieces, F.length)), turn))


def _same(formatted: str, turns: str, parsed: str) -> Column:
    """Whether the parsed turns are the source's and make up the whole text."""
    own = F.transform(F.col(turns), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    read = F.transform(F.col(parsed), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    return (own == read) & (F.concat_ws("", F.regexp_extract_all(F.col(formatted), F.lit(TURN), 0)) == F.col(formatted))


def format_chats(df: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(id, formatted, turns, mask, escaped): turns as read back, with the spans of their texts.

    mask: spans of the assistants' texts; escaped: 0 none, 1 single turns, 2 all turns.
    """
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(F.col(id_col).alias("id"), F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"))
    alone = rows.withColumn("piece", render(F.col("role"), F.col("text"))).withColumn("own", parse(F.col("piece")))
    survives = (F.size("own") == 1) & (F.col("own")[0]["role"] == F.col("role")) & (F.col("own")[0]["text"] == F.col("text"))
    survives &= F.concat_ws("", F.regexp_extract_all(F.col("piece"), F.lit(TURN), 0)) == F.col("piece")
    control = F.col("text").rlike(CONTROL)
    form = F.when(~survives | (control & swap(F.col("text")).rlike(CONTROL)), 2).when(control, 1).otherwise(0)
    turns = alone.select("id", F.struct("turn", "role", "text", form.alias("form")).alias("t"))
    chats = turns.groupBy("id").agg(F.array_sort(F.collect_list("t")).alias("source"))

    def joined(every: bool) -> Column:
        own = lambda t: F.when(t["form"] == 2, escape(t["text"])).when(t["form"] == 1, swap(t["text"])).otherwise(t["text"])
        return F.concat_ws("", F.transform("source", lambda t: render(t["role"], escape(t["text"])) if every else render(t["role"], own(t), t["form"] == 1)))

    chats = chats.withColumn("formatted", joined(False)).withColumn("turns", parse(F.col("formatted")))
    chats = chats.withColumn("identical", _same("formatted", "source", "turns"))
    chats = chats.withColumn("formatted", F.when(F.col("identical"), F.col("formatted")).otherwise(joined(True)))
    chats = chats.withColumn("turns", F.when(F.col("identical"), F.col("turns")).otherwise(parse(F.col("formatted"))))
    level = F.when(~F.col("identical"), 2).when(F.exists("source", lambda t: t["form"] > 0), 1).otherwise(0)
    checked = F.when(F.col("identical") | _same("formatted", "source", "turns"), F.col("formatted")).otherwise(F.raise_error(F.lit("a conversation can't be read back")))
    mask = F.transform(F.filter("turns", lambda t: t["role"] == "assistant"), lambda t: F.struct(t["start"], t["end"]))
    return chats.select(F.col("id").alias(id_col), checked.alias("formatted"), "turns", mask.alias("mask"), level.alias("escaped"))


def masked_text(formatted: Column, mask: Column) -> Column:
    """All text under the mask, unescaped."""
    return let(wide(formatted), lambda w: F.concat_ws("", F.transform(mask, lambda m: source_text(part(w, m["start"], m["end"]), part(w, m["start"] - 1, m["start"])))))
