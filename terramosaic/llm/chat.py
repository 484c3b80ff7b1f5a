r"""Chat formatting: a declarative template, a state machine over roles, loss flags a segment.

Everything is DataFrame expressions. A template names the strings around a
turn, the roles whose text is trained on, the transitions that are allowed, and
the control strings that a text must not contain. Escaping is reversible: the
backslash becomes a backslash and code 0, control string number k a backslash
and code k. A code is one character that stands in no control string (0, 1, 2
... where they do not), so an escaped text holds no control string, every
backslash in it begins a pair, and any number of control strings works. A
template whose turns could not be told apart again is refused.

The state machine is run over the roles of a conversation: it gives the state
at the end, the first turn that it has no transition for, and, if the template
says so, takes that turn and all behind it out of the loss.

A conversation becomes one row with its segments (text, loss flag) in order;
the formatted text is the segments joined. A conversation is the unit of
output, so its turns come together in one row; escaping and segmenting are done
by turn, before that.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """What surrounds a turn, and which turns may follow each other."""

    open: str = "### "
    after_role: str = ": "
    close: str = "</turn>\n"
    #: Strings that escaped texts and roles never hold; ``open`` and ``close`` need one each.
    controls: tuple[str, ...] = ("###", "</turn>")
    #: Beyond these, a role never holds what ends it.
    role_controls: tuple[str, ...] = (":",)
    trained: tuple[str, ...] = ("assistant",)
    start: str = "start"
    #: (state, role) -> state; anything else leads to ``error`` for good.
    transitions: dict[tuple[str, str], str] = field(
        default_factory=lambda: {
            ("start", "system"): "system",
            ("start", "user"): "user",
            ("system", "user"): "user",
            ("user", "assistant"): "assistant",
            ("assistant", "user"): "user",
        }
    )
    final: tuple[str, ...] = ("user", "assistant")
    #: Whether a turn without a transition, and all behind it, lose their loss flags.
    mask_errors: bool = False

    def __post_init__(self):
        every = self.controls + self.role_controls
        if any(not c or "\\" in c for c in every) or len(set(every)) < len(every):
            raise ValueError("control strings must be distinct, not empty, and without a backslash")
        if not opens_with(self.close, self.controls):
            raise ValueError("close must start with a control string that no part of itself can overlap")
        if not opens_with(self.after_role, every):
            raise ValueError("after_role must start with a control string that no part of itself can overlap")
        if not any(c in self.open for c in self.controls):
            raise ValueError("open must hold a control string")
        codes(every)


def opens_with(mark: str, controls: tuple[str, ...]) -> bool:
    """Whether ``mark`` can be found behind any escaped text: it starts with a control string that has no border."""
    return any(mark.startswith(c) and not any(c.startswith(c[k:]) for k in range(1, len(c))) for c in controls)


def codes(controls: tuple[str, ...]) -> str:
    """One character for the backslash and one for each control string, none of which stands in a control string."""
    used = set("".join(controls)) | {"\\"}
    free = [c for c in map(chr, (*range(48, 58), *range(97, 123), *range(65, 91), *range(0x100, 0x3000))) if c not in used]
    return "".join(free[: len(controls) + 1])


DEFAULT = Template()


def escaped(text: Column, controls: tuple[str, ...]) -> Column:
    code = codes(controls)
    out = F.replace(text, F.lit("\\"), F.lit(f"\\{code[0]}"))
    for control, c in zip(controls, code[1:], strict=True):
        out = F.replace(out, F.lit(control), F.lit(f"\\{c}"))
    return out


def unescaped(text: Column, controls: tuple[str, ...]) -> Column:
    out, code = text, codes(controls)
    for control, c in zip(controls, code[1:], strict=True):
        out = F.replace(out, F.lit(f"\\{c}"), F.lit(control))
    return F.replace(out, F.lit(f"\\{code[0]}"), F.lit("\\"))


def machine(roles: Column, template: Template) -> Column:
    """The state machine over an array of roles: the state at its end, and the first turn (from 0) without a transition, or null."""
    table = F.create_map(*(F.lit(x) for (state, role), to in template.transitions.items() for x in (f"{state}\x1f{role}", to)))
    first = F.struct(F.lit(template.start).alias("state"), F.lit(0).alias("at"), F.lit(None).cast("int").alias("error"))

    def step(here: Column, role: Column) -> Column:
        to = F.try_element_at(table, F.concat(here["state"], F.lit("\x1f"), role))
        error = F.coalesce(here["error"], F.when(to.isNull(), here["at"]))
        return F.struct(F.coalesce(F.when(error.isNull(), to), F.lit("error")).alias("state"), (here["at"] + 1).alias("at"), error.alias("error"))

    return F.aggregate(roles, first, step)


def format_conversations(turns: DataFrame, template: Template = DEFAULT, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row a conversation: id, n_turns, segments (text, loss), state, error_turn, formatted, valid.

    Turns are ordered by turn, then role, then text; a null turn comes first and
    repeated rows are turns of their own. Null role and null text count as
    empty. Rows with a null conversation id form one conversation. Turns out of
    order are formatted all the same; they make ``valid`` false, and
    ``error_turn`` is the first of them (from 0, else null). Other columns are
    not read; an empty table gives no row. A conversation is one row, so its
    turns must fit into one (2 GB at most); escaping is done before, by turn.
    """
    role_controls = template.controls + template.role_controls
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    body = F.struct(escaped(text, template.controls).alias("text"), role.isin(*template.trained).alias("loss"))
    rows = turns.select(
        F.col(conv_col).alias("_conv"),
        F.struct(
            F.col(turn_col).alias("turn"),
            role.alias("role"),
            text.alias("raw"),
            F.struct(F.concat(F.lit(template.open), escaped(role, role_controls), F.lit(template.after_role)).alias("text"), F.lit(False).alias("loss")).alias("head"),
            body.alias("body"),
        ).alias("_row"),
    )
    close = F.struct(F.lit(template.close).alias("text"), F.lit(False).alias("loss"))
    grouped = rows.groupBy("_conv").agg(F.array_sort(F.collect_list("_row")).alias("_rows"))
    run = grouped.withColumn("_run", machine(F.transform("_rows", lambda r: r["role"]), template))

    def parts(row: Column, at: Column) -> Column:
        own = row["body"]
        if template.mask_errors:
            own = F.struct(own["text"].alias("text"), (own["loss"] & (F.col("_run.error").isNull() | (at < F.col("_run.error")))).alias("loss"))
        return F.array(row["head"], own, close)

    out = run.select(
        F.col("_conv").alias(conv_col),
        F.size("_rows").cast("long").alias("n_turns"),
        F.flatten(F.transform("_rows", parts)).alias("segments"),
        F.col("_run.state").alias("state"),
        F.col("_run.error").alias("error_turn"),
    )
    formatted = F.array_join(F.transform("segments", lambda s: s["text"]), "")
    return out.withColumn("formatted", formatted).withColumn("valid", F.col("state").isin(*template.final))


def parse_formatted(formatted: Column, template: Template = DEFAULT) -> Column:
    """Array of (role, text) read back from a formatted conversation."""
    quoted = "\\Q" + template.close.replace("\\E", "\\E\\\\E\\Q") + "\\E"  # as it stands, whatever marks it holds
    pieces = F.filter(F.split(formatted, quoted), lambda s: s != "")  # a turn holds ``open`` at least
    role_controls = template.controls + template.role_controls

    def turn(piece: Column) -> Column:
        rest = F.substring(piece, len(template.open) + 1, 2**31 - 1)
        role = F.substring_index(rest, template.after_role, 1)
        text = F.substr(rest, F.length(role) + len(template.after_role) + 1)
        return F.struct(unescaped(role, role_controls).alias("role"), unescaped(text, template.controls).alias("text"))

    return F.transform(pieces, turn)


def loss_text(segments: Column, template: Template = DEFAULT) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescaped(s["text"], template.controls)), "")


def digests(formatted: DataFrame, conv_col: str = "conv_id", template: Template = DEFAULT) -> DataFrame:
    """What reading the output back gives: turn count, digests and lengths."""
    read = formatted.withColumn("_turns", parse_formatted(F.col("formatted"), template)).withColumn("_loss", loss_text(F.col("segments"), template))
    turns = F.array_join(F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        conv_col,
        F.size("_turns").cast("long").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("_loss"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )
