"""Chat formatting: a finite-state machine over roles and a template.

The template names the marks around each role's text, the roles whose text
counts for the loss, and the transitions of the machine.  Control strings
inside texts are escaped, so that the turns can be read back.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

START, END = "start", "end"


@dataclass(frozen=True)
class Template:
    """``marks``: opening and closing string of each role.

    A role that is not in ``marks`` is written as ``[ROLE name] .. [/ROLE]``.
    Every mark begins with ``[`` or ``<``, possibly after blanks, and
    ``control`` is a pattern for what may follow that character.
    """
    begin: str = "<s>"
    marks: dict[str, tuple[str, str]] = field(default_factory=lambda: {
        "system": ("[SYS] ", " [/SYS]"),
        "user": ("[INST] ", " [/INST]"),
        "assistant": ("[OUT] ", " </s>")})
    loss: tuple[str, ...] = ("assistant",)
    control: str = r"/?(?:SYS\]|INST\]|OUT\]|ROLE[ \]]|s>)"
    moves: tuple[tuple[str, str], ...] = (
        (START, "system"), (START, "user"), ("system", "user"),
        ("user", "assistant"), ("assistant", "user"), ("assistant", END))


#: Other roles; percent signs and brackets in a name are percent-encoded.
OTHER = ("[ROLE ", "] ", " [/ROLE]")
LLAMA_LIKE = Template()


def escape(text: Column, template: Template = LLAMA_LIKE) -> Column:
    r"""Put a backslash after the first character of control strings.

    ``[\\..\INST]`` gets one backslash more, so that ``unescape`` is exact.
    """
    return F.regexp_replace(
        text, F.lit(rf"([\[<])(\\*)({template.control})"),
        F.lit(r"$1\\$2$3"))


def unescape(text: Column, template: Template = LLAMA_LIKE) -> Column:
    return F.regexp_replace(
        text, F.lit(rf"([\[<])\\(\\*)({template.control})"),
        F.lit(r"$1$2$3"))


def _encode(name: Column) -> Column:
    for raw, coded in (("%", "%25"), ("]", "%5D"), ("[", "%5B"),
                       ("<", "%3C")):
        name = F.replace(name, F.lit(raw), F.lit(coded))
    return name


def _decode(name: Column) -> Column:
    for raw, coded in (("<", "%3C"), ("[", "%5B"), ("]", "%5D"),
                       ("%", "%25")):
        name = F.replace(name, F.lit(coded), F.lit(raw))
    return name


def _by_role(role: Column, template: Template, at: int,
             other: Column) -> Column:
    found = other
    for name, marks in template.marks.items():
        found = F.when(role == name, F.lit(marks[at])).otherwise(found)
    return found


def format_conversations(turns: DataFrame, template: Template = LLAMA_LIKE,
                         conv_id: str = "conv_id", turn: str = "turn",
                         role: str = "role",
                         text: str = "text") -> DataFrame:
    """One row per conversation, in the order of (turn, role, text).

    Columns: conv_id, n_turns, formatted, segments (array of text and loss,
    whose texts joined are ``formatted``), valid and bad_turn (the position
    from 0 of the first turn that the machine refuses; n_turns if the
    conversation ends too early; null if valid).  Invalid conversations are
    formatted too.  Null text and null role are empty strings, null turns
    come first, repeated turns are all kept, null conv_id is one
    conversation; an empty table gives no row.  A conversation is one sample
    and so one row.
    """
    rows = turns.select(
        F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"))
    name = F.col("role")
    opening = _by_role(name, template, 0, F.concat(
        F.lit(OTHER[0]), _encode(name), F.lit(OTHER[1])))
    rows = rows.select("conv_id", F.struct(
        "turn", "role", "text", opening.alias("opening"),
        escape(F.col("text"), template).alias("body"),
        _by_role(name, template, 1, F.lit(OTHER[2])).alias("closing"))
        .alias("t"))
    sample = rows.groupBy("conv_id").agg(
        F.array_sort(F.collect_list("t")).alias("turns"))
    segments = F.flatten(F.transform("turns", lambda t: F.array(
        _segment(t.opening, F.lit(False)),
        _segment(t.body, t.role.isin(*template.loss)),
        _segment(t.closing, F.lit(False)))))
    sample = sample.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.concat(F.array(_segment(F.lit(template.begin), F.lit(False))),
                 segments).alias("segments"),
        _first_refused(F.col("turns"), template).alias("bad_turn"))
    return sample.select(
        "conv_id", "n_turns", F.array_join(F.transform(
            "segments", lambda s: s.text), "").alias("formatted"),
        "segments", F.col("bad_turn").isNull().alias("valid"), "bad_turn")


def _segment(text: Column, loss: Column) -> Column:
    return F.struct(text.alias("text"), loss.alias("loss"))


def _first_refused(turns: Column, template: Template) -> Column:
    """Run the machine; the state is the role last taken, null once stuck."""
    def allowed(state: Column, role: Column) -> Column:
        taken = F.lit(False)
        for before, after in template.moves:
            taken = taken | ((state == before) & (role == after))
        return taken

    begin = F.struct(F.lit(START).alias("state"),
                     F.lit(0).cast("long").alias("at"))
    end = F.aggregate(turns, begin, lambda s, t: F.struct(
        F.when(s.state.isNotNull() & allowed(s.state, t.role), t.role)
        .alias("state"),
        F.when(s.state.isNotNull() & allowed(s.state, t.role), s["at"] + 1)
        .otherwise(s["at"]).alias("at")),
        lambda s: F.when(s.state.isNull() | ~allowed(s.state, F.lit(END)),
                         s["at"]))
    return end


def read_turns(formatted: Column,
               template: Template = LLAMA_LIKE) -> Column:
    """The turns of a formatted text: array of role and unescaped text."""
    closings = [marks[1] for marks in template.marks.values()] + [OTHER[2]]
    # a closing mark in the output is never inside a text
    behind = "|".join(r"\Q" + c + r"\E" for c in closings)
    body = F.substr(formatted, F.lit(len(template.begin) + 1))
    parts = F.filter(F.split(body, f"(?<={behind})", -1),
                     lambda part: part != "")

    def turn(part: Column) -> Column:
        stop = F.locate("] ", part)
        name = _decode(F.substr(part, F.lit(len(OTHER[0]) + 1),
                                stop - F.lit(len(OTHER[0]) + 1)))
        first, last = stop + len(OTHER[1]), F.lit(len(OTHER[2]))
        for role, (opening, closing) in template.marks.items():
            here = part.startswith(opening)
            name = F.when(here, F.lit(role)).otherwise(name)
            first = F.when(here, F.lit(len(opening) + 1)).otherwise(first)
            last = F.when(here, F.lit(len(closing))).otherwise(last)
        text = F.substr(part, first, F.length(part) - last - first + 1)
        return F.struct(name.alias("role"),
                        unescape(text, template).alias("text"))
    return F.transform(parts, turn)


def digests(samples: DataFrame,
            template: Template = LLAMA_LIKE) -> DataFrame:
    """Counts and digests read back from formatted text and segments."""
    turns = read_turns(F.col("formatted"), template)
    lost = F.array_join(F.transform(
        F.filter("segments", lambda s: s.loss),
        lambda s: unescape(s.text, template)), "")
    return samples.withColumns({"_turns": turns, "_loss": lost}).select(
        "conv_id", F.size("_turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("_turns", lambda t: F.concat(
            t.role, F.lit("\n"), t.text, F.lit("\n"))), ""), 256)
        .alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"),
        F.sha2("_loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid")
