r"""Operator 10: chat formatting with Spark expressions only.

A conversation's turns are collected as structs, sorted, runs of one role are
merged into one turn of several parts, and the parts are concatenated:

    ### <role> :\n<part>\n<next>\n<part>\n</turn>\n### <role> :\n ...

Inside roles and texts every control string and every backslash gets a
backslash in front, which one regular expression takes away again. Markers
start with a line break directly before ``<``; an escaped control string has a
backslash there, so splitting at a marker never cuts a text.

Defined cases: NULL text or role counts as empty; NULL turns come first; rows
that tie on the turn are ordered by role, then text; repeated rows are turns
of their own; rows with a NULL id form one conversation; extra columns are
ignored; an empty table gives an empty result. A conversation is one output
string, so its turns meet in one row by definition; no other group does.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dinelens.llm.common import computed, running

# Fixed values of the template.
HEAD, NAME_END, NEXT, END = "### ", " :\n", "\n<next>\n", "\n</turn>\n"
TEXT_CONTROLS = r"(\\|</turn>|<next>|###)"
ROLE_CONTROLS = r"(\\|</turn>|<next>|###|:)"
LOSS_ROLE = "assistant"
SPANS = "array<struct<begin:bigint,length:bigint,first_byte:bigint,bytes:bigint>>"


def _escape(text: Column, controls: str) -> Column:
    return F.regexp_replace(text, F.lit(controls), F.lit(r"\\$1"))


def _unescape(text: Column, controls: str) -> Column:
    return F.regexp_replace(text, F.lit(r"\\" + controls), F.lit("$1"))


def format_conversations(
    turns: DataFrame,
    id_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    loss_role: str = LOSS_ROLE,
) -> DataFrame:
    """One row per conversation: ``conv_id, formatted, loss_spans``.

    ``loss_spans`` is the loss mask: ``(begin, length)`` in code points of
    ``formatted``, one span for each text of ``loss_role``, markers left out;
    ``first_byte`` and ``bytes`` say the same of its UTF-8, where a span can be
    taken out without counting characters from the front.
    """
    row = F.struct(
        turns[turn_col].alias("turn"),
        F.coalesce(turns[role_col].cast("string"), F.lit("")).alias("role"),
        F.coalesce(turns[text_col].cast("string"), F.lit("")).alias("text"),
    )
    rows = turns.select(turns[id_col].alias("conv_id"), row.alias("row"))
    sorted_rows = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("row")).alias("rows"))

    n = F.size("rows")
    starts = F.filter(
        F.sequence(F.lit(1), n),
        lambda i: (i == 1) | (F.get("rows", i - 1)["role"] != F.get("rows", i - 2)["role"]),
    )
    with_starts = sorted_rows.withColumn("starts", starts)
    merged = F.transform(
        "starts",
        lambda s, k: F.struct(
            F.get("rows", s - 1)["role"].alias("role"),
            F.transform(
                F.slice("rows", s, F.coalesce(F.get("starts", k + 1), n + 1) - s),
                lambda r: _escape(r["text"], TEXT_CONTROLS),
            ).alias("parts"),
        ),
    )
    head = F.transform(
        merged,
        lambda t: F.struct(
            F.concat(F.lit(HEAD), _escape(t["role"], ROLE_CONTROLS), F.lit(NAME_END)).alias("head"),
            t["role"].alias("role"),
            t["parts"].alias("parts"),
        ),
    )
    built = computed(with_starts, ["conv_id"], turns=head)

    formatted = F.array_join(
        F.transform("turns", lambda t: F.concat(t["head"], F.array_join(t["parts"], NEXT), F.lit(END))), ""
    )
    # Parts with the characters in front of each (a header, or a separator or
    # terminator of the part before), then a running sum of the begins.
    pieces = F.flatten(
        F.transform(
            "turns",
            lambda t, k: F.transform(
                t["parts"],
                lambda p, i: F.struct(
                    _gap(F.length, t, k, i).alias("gap"),
                    F.length(p).cast("long").alias("length"),
                    _gap(F.octet_length, t, k, i).alias("byte_gap"),
                    F.octet_length(p).cast("long").alias("bytes"),
                    (t["role"] == F.lit(loss_role)).alias("loss"),
                ),
            ),
        )
    )
    cut = computed(built, ["conv_id"], formatted=formatted, pieces=pieces)

    def step(at: Column, p: Column) -> tuple[Column, Column, Column]:
        begin, first = at["char"] + p["gap"], at["byte"] + p["byte_gap"]
        span = F.struct(begin.alias("begin"), p["length"].alias("length"), first.alias("first_byte"), p["bytes"].alias("bytes"))
        return F.struct((begin + p["length"]).alias("char"), (first + p["bytes"]).alias("byte")), p["loss"], span

    zero = F.lit(0).cast("long")
    spans = running(F.col("pieces"), F.struct(zero.alias("char"), zero.alias("byte")), SPANS, step)
    return cut.select("conv_id", "formatted", spans.alias("loss_spans"))


def _gap(length: Callable[[Column], Column], turn: Column, number: Column, part: Column) -> Column:
    """What stands before a part: a separator, or the turn's head behind the end of the turn before."""
    head = length(turn["head"]) + F.when(number > 0, F.lit(len(END))).otherwise(F.lit(0))
    return F.when(part > 0, F.lit(len(NEXT))).otherwise(head).cast("long")


def read_back(formatted: DataFrame) -> DataFrame:
    """``conv_id, formatted, loss_spans, turns, loss_texts`` from the formatted strings.

    ``turns`` is ``array<struct<role, text>>``, one entry for each input row;
    ``loss_texts`` holds the unescaped texts under the loss mask, in order.
    """
    chunks = F.split("formatted", END, -1)
    chunks = F.slice(chunks, F.lit(1), F.size(chunks) - 1)
    # A role holds no unescaped colon, so the first end of a name ends the head.
    halves = F.transform(chunks, lambda c: F.split(c, NAME_END, 2))
    merged = F.transform(
        halves,
        lambda h: F.struct(
            _unescape(F.substring(F.get(h, F.lit(0)), F.lit(len(HEAD) + 1), F.length(F.get(h, F.lit(0)))), ROLE_CONTROLS).alias("role"),
            F.split(F.get(h, F.lit(1)), NEXT, -1).alias("parts"),
        ),
    )
    each = F.transform(merged, lambda t: F.transform(t["parts"], lambda p: F.struct(t["role"].alias("role"), _unescape(p, TEXT_CONTROLS).alias("text"))))
    raw = computed(formatted, ["conv_id", "formatted", "loss_spans"], raw=F.col("formatted").cast("binary"))
    under_mask = F.transform(
        "loss_spans",
        lambda s: _unescape(F.substring(F.col("raw"), (s["first_byte"] + 1).cast("int"), s["bytes"].cast("int")).cast("string"), TEXT_CONTROLS),
    )
    return raw.select("conv_id", "formatted", "loss_spans", F.flatten(each).alias("turns"), under_mask.alias("loss_texts"))


def digests(back: DataFrame) -> DataFrame:
    """Counts and digests of what ``read_back`` found."""
    line = F.lit("\n")
    turns_text = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], line, t["text"], line)), "")
    loss_text = F.array_join("loss_texts", "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(turns_text.cast("binary"), 256).alias("turns_sha256"),
        F.length(loss_text).cast("long").alias("loss_chars"),
        F.sha2(loss_text.cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
