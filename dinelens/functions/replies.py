"""Cleaning and parsing of model replies, as native JSON expressions.

A reply is text holding one JSON object, possibly wrapped in markdown
fences and preceded by ``<think>...</think>`` text. Parsing happens with
``json_object_keys`` and ``from_json`` with a fixed schema, so that a key that
is present with a null value stays NULL while a missing key takes its default.
The text must be one JSON value and nothing else: put into brackets, it must
be an array of one element (the JSON functions alone stop at the end of the
first value).

``once`` keeps a struct from being computed again by every reader of its
fields: Catalyst pushes filters and projections below other projections and
so repeats their expressions, but not below a generator.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dinelens.functions.cleaning import strip_ws

# Markdown fences and reasoning block removed from replies.
FENCE_OPEN = "```json"
FENCE = "```"
THINK_BLOCK = r"(?is)<think>.*?</think>"
OUTER_OBJECT = r"(?s)\{.*\}"

# Defaults of the review reply when a key is missing.
REVIEW_DEFAULTS = {"sentiment": "Neutral", "topics": "General", "summary": "No summary"}

REVIEW_REPLY_SCHEMA = T.StructType(
    [
        T.StructField("sentiment", T.StringType()),
        T.StructField("topics", T.StringType()),
        T.StructField("summary", T.StringType()),
    ]
)

# All fields are read as text: counts may be written as 3.0 or "2", and a
# theme list must be told from a text or null.
INSIGHT_COUNTS = ("positive_count", "negative_count", "neutral_count")
INSIGHT_THEMES = ("top_negative_themes", "top_positive_themes")
INSIGHT_REPLY_SCHEMA = T.StructType(
    [T.StructField(n, T.StringType()) for n in (*INSIGHT_COUNTS, *INSIGHT_THEMES, "summary")]
)


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_reply(c: str | Column) -> Column:
    """Remove markdown fences and ``<think>`` blocks, then outer white space."""
    out = F.replace(_c(c), F.lit(FENCE_OPEN), F.lit(""))
    out = F.replace(out, F.lit(FENCE), F.lit(""))
    out = strip_ws(out)
    return strip_ws(F.regexp_replace(out, F.lit(THINK_BLOCK), F.lit("")))


def review_object(stripped: str | Column) -> Column:
    """A stripped review reply if it is the object alone (``{`` first,
    ``}`` last, as a strict ``json.loads`` wants), else NULL."""
    s = _c(stripped)
    return F.when(s.rlike(r"(?s)^\{.*\}$"), s)


def insight_object(stripped: str | Column) -> Column:
    """The outermost ``{...}`` of a stripped restaurant reply (the whole
    text when it has none)."""
    s = _c(stripped)
    obj = F.regexp_extract(s, OUTER_OBJECT, 0)
    return F.when(obj == F.lit(""), s).otherwise(obj)


def once(df: DataFrame, keep: list[str], fields: dict[str, Column]) -> DataFrame:
    """``keep`` and the fields, each row's fields computed once."""
    row = F.struct(*[e.alias(n) for n, e in fields.items()])
    return df.select(*keep, F.inline(F.array(row)))


def parsed_object(
    df: DataFrame, keep: list[str], response: str, only_object: Callable[[str], Column], schema: T.StructType
) -> DataFrame:
    """``keep``, ``_keys`` (NULL unless the cleaned reply is exactly one JSON
    object) and ``_parsed``."""
    stripped = once(df, keep, {"_stripped": strip_reply(response)})
    cleaned = once(stripped, keep, {"_clean": only_object("_stripped")})
    c = F.col("_clean")
    alone = F.json_array_length(F.concat(F.lit("["), c, F.lit("]"))) == 1
    return once(cleaned, keep, {"_keys": F.when(alone, F.json_object_keys(c)), "_parsed": F.from_json(c, schema)})


def _field(name: str, default: Column) -> Column:
    value = F.col("_parsed")[name]
    return F.when(F.array_contains("_keys", F.lit(name)), value).otherwise(default)


def review_fields() -> dict[str, Column]:
    """``ok``, ``sentiment``, ``topics``, ``summary`` of a ``parsed_object``
    (``REVIEW_REPLY_SCHEMA``). An empty object counts as a failure."""
    out = {"ok": F.col("_keys").isNotNull() & (F.size("_keys") > 0)}
    for name, default in REVIEW_DEFAULTS.items():
        out[name] = _field(name, F.lit(default))
    return out


def insight_fields(max_themes: int | None = None) -> dict[str, Column]:
    """Fields of a restaurant reply (``INSIGHT_REPLY_SCHEMA``).

    Counts default to 0 and are rounded to whole numbers; theme lists are
    arrays, with at most ``max_themes`` entries if given. A count that is no
    number, or themes that are no list, make the reply a failure.
    """
    ok = F.col("_keys").isNotNull()
    out: dict[str, Column] = {}
    for name in INSIGHT_COUNTS:
        text = _field(name, F.lit("0"))
        number = text.try_cast("double")
        ok = ok & (text.isNull() | number.isNotNull())
        out[name] = F.bround(number).cast("int")
    for name in INSIGHT_THEMES:
        text = _field(name, F.lit("[]"))
        ok = ok & F.coalesce(F.json_array_length(text).isNotNull(), F.lit(False))
        themes = F.from_json(text, T.ArrayType(T.StringType()))
        out[name] = F.slice(themes, 1, max_themes) if max_themes else themes
    out["summary"] = _field("summary", F.lit(""))
    return {"ok": F.coalesce(ok, F.lit(False)), **out}
