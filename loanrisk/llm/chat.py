"""Chat formatting by a finite-state machine over roles (operator 7, native).

A template is declarative: the marks that open and close a turn of each role,
which roles' texts bear loss, and the machine, a list of transitions
``(state, role, next state)`` with its final states. Per conversation, ordered by
turn, the machine runs over the roles (a fold over the array); the first turn
without a transition makes the conversation invalid and is reported, its text is
still formatted. Segments are the pieces of the formatted text, in order, each
with its loss flag: an opening mark, the escaped text, a closing mark.

Control strings inside texts are escaped: ``&`` becomes ``&amp;`` and each control
string a name between ``&`` and ``;``. An escaped text holds no control string, so
the formatted text can be split at its marks again, and undoing the names in
reverse order returns the text.

Defined results: null text is empty, null role the empty role; a role unknown to
the template gets the general marks with its escaped name; rows with the same turn
keep an order by role and text (null turns first); a null ``conv_id`` is a
conversation of its own; an empty table gives no rows; other columns are ignored.
A conversation is one output row, so it is held whole in one task.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    #: role -> (opening mark, closing mark, loss)
    roles: dict[str, tuple[str, str, bool]]
    transitions: list[tuple[str, str, str]]
    start: str
    final: tuple[str, ...]
    #: marks of other roles; the role's escaped name stands between the first two
    general: tuple[str, str, str] = ("<<ROLE:", ">>", "<</ROLE>>")
    controls: list[tuple[str, str]] = field(default_factory=list)


#: The marks of a widely used instruction format, one pair a role.
INSTRUCT = Template(
    roles={"system": ("<<SYS>>", "<</SYS>>", False),
           "user": ("[INST]", "[/INST]", False),
           "assistant": ("<s>", "</s>", True)},
    transitions=[("start", "system", "instructed"), ("start", "user", "asked"), ("instructed", "user", "asked"),
                 ("asked", "assistant", "answered"), ("answered", "user", "asked")],
    start="start",
    final=("asked", "answered"),
    controls=[("<<SYS>>", "sys"), ("<</SYS>>", "endsys"), ("[INST]", "inst"), ("[/INST]", "endinst"),
              ("<s>", "bos"), ("</s>", "eos"), ("<<ROLE:", "role"), ("<</ROLE>>", "endrole"), (">>", "close")],
)


def escaped(text: Column, template: Template) -> Column:
    text = F.replace(text, F.lit("&"), F.lit("&amp;"))
    for control, name in template.controls:
        text = F.replace(text, F.lit(control), F.lit(f"&{name};"))
    return text


def unescaped(text: Column, template: Template) -> Column:
    for control, name in reversed(template.controls):
        text = F.replace(text, F.lit(f"&{name};"), F.lit(control))
    return F.replace(text, F.lit("&amp;"), F.lit("&"))


def _turn_segments(turn: Column, template: Template) -> Column:
    """The three segments of a turn, a struct of role and text."""
    role, body = turn["role"], escaped(turn["text"], template)
    before, middle, after = template.general
    # a name must not complete a mark with what stands beside it, so it holds no "<" or ">" either
    name = F.replace(F.replace(escaped(role, template), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    opening = F.concat(F.lit(before), name, F.lit(middle))
    closing, loss = F.lit(after), F.lit(False)
    for name, (o, c, bears) in template.roles.items():
        opening = F.when(role == name, o).otherwise(opening)
        closing = F.when(role == name, c).otherwise(closing)
        loss = F.when(role == name, bears).otherwise(loss)
    return F.array(F.struct(opening.alias("text"), F.lit(False).alias("loss")),
                   F.struct(body.alias("text"), loss.alias("loss")),
                   F.struct(closing.alias("text"), F.lit(False).alias("loss")))


def _run_machine(turns: Column, template: Template) -> Column:
    """Fold over the roles: the state reached (empty once a turn has no
    transition) and the number of turns accepted."""
    def step(acc, turn):
        state = F.lit("")
        for s, role, to in template.transitions:
            state = F.when((acc["state"] == s) & (turn["role"] == role), to).otherwise(state)
        return F.struct(state.alias("state"), (acc["accepted"] + (state != "").cast("long")).alias("accepted"))
    begin = F.struct(F.lit(template.start).alias("state"), F.lit(0).cast("long").alias("accepted"))
    return F.aggregate(turns, begin, step)


def format_conversations(df: DataFrame, template: Template = INSTRUCT, conv_col: str = "conv_id", turn_col: str = "turn",
                         role_col: str = "role", text_col: str = "text") -> DataFrame:
    """A row per conversation: ``conv_id, valid, error_turn`` (place of the first
    refused turn, null if none; the number of turns when only the end is wrong),
    ``segments`` (array of text and loss) and ``formatted``, their concatenation."""
    turns = df.select(F.col(conv_col).alias("conv_id"), F.struct(
        F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).alias("t"))
    whole = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    run = whole.select("conv_id", "turns", _run_machine(F.col("turns"), template).alias("end"),
                       F.flatten(F.transform("turns", lambda t: _turn_segments(t, template))).alias("segments"))
    finished = F.col("end.state").isin(*template.final)
    return run.select("conv_id", finished.alias("valid"), F.when(~finished, F.col("end.accepted")).alias("error_turn"),
                      "segments", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"))


def parse_turns(formatted: Column, template: Template = INSTRUCT) -> Column:
    """The array of (role, text) that a formatted text stands for."""
    def literal(mark: str) -> str:
        return "".join("\\" + c if not c.isalnum() else c for c in mark)

    closings = [c for _, c, _ in template.roles.values()] + [template.general[2]]
    pieces = F.filter(F.split(formatted, "(?<=" + "|".join(map(literal, closings)) + ")"), lambda p: p != "")

    def turn(piece):
        before, middle, after = template.general
        name = F.substring_index(F.substring(piece, F.lit(len(before) + 1), F.length(piece)), middle, 1)
        head = F.length(name) + len(before) + len(middle)
        role = F.replace(F.replace(name, F.lit("&gt;"), F.lit(">")), F.lit("&lt;"), F.lit("<"))
        role = unescaped(role, template)
        text = F.substring(piece, head + 1, F.length(piece) - head - len(after))
        for r, (o, c, _) in template.roles.items():
            here = F.startswith(piece, F.lit(o))
            role = F.when(here, r).otherwise(role)
            text = F.when(here, F.substring(piece, F.lit(len(o) + 1), F.length(piece) - (len(o) + len(c)))).otherwise(text)
        return F.struct(role.alias("role"), unescaped(text, template).alias("text"))

    return F.transform(pieces, turn)
