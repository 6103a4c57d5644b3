"""Lists kept as text, as Python or JSON writes them. All built-in functions: tokens are found by one pattern and folded."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_ESCAPE = r"\\(?:x[0-9A-Fa-f]{2}|u[0-9A-Fa-f]{4}|[^xuUN])"
_STRING = rf"'(?:[^'\\\n]|{_ESCAPE})*'|\"(?:[^\"\\\n]|{_ESCAPE})*\""
_NUMBER = r"[+-]?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?"
_NAME = r"\b(?:None|True|False|null|true|false)\b"
_TOKEN = rf"{_STRING}|{_NUMBER}|{_NAME}|[\[\](),]"
_BLANK = r"[ \t\r\n\f]+"
_PIECE = r"\\x[0-9A-Fa-f]{2}|\\u[0-9A-Fa-f]{4}|\\[\s\S]|[^\\]+"

# The escapes of one character and what they stand for.
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "a": "\a", "v": "\v", "0": "\0", "\\": "\\", "'": "'", '"': '"', "\n": ""}

# what the last token was
_NOTHING, _OPENED, _TEXT, _VALUE, _COMMA, _ENDED = "", "o", "t", "v", "c", "e"


def literal_list(text: Column) -> Column:
    """The elements of a list or tuple written as text, as ``array<string>``; null where the text is neither.

    Strings are taken without quotes and escapes, and neighbours without a comma between them are one; ``None`` and ``null`` are null;
    numbers, ``True`` and the like stay as they are written, and so do nested lists. A comma may follow the last element.
    A single value in parentheses is no tuple, and characters are not named by ``\\N`` or ``\\U``. Names of JSON do not go with tuples, ``None``, ``True``, ``False`` or a last comma.
    """
    covered = F.regexp_replace(text, f"{_TOKEN}|{_BLANK}", "") == ""
    start = F.struct(
        F.lit(True).alias("ok"),
        F.lit("").alias("open"),
        F.lit(_NOTHING).alias("last"),
        F.array().cast("array<string>").alias("items"),
        F.lit("").alias("nested"),
        F.lit(0).alias("commas"),
        F.lit(False).alias("is_json"),
        F.lit(False).alias("is_python"),
    )
    end = F.aggregate(F.regexp_extract_all(text, F.lit(f"({_TOKEN})"), 1), start, _step)
    ended = end["ok"] & (end["last"] == _ENDED) & ~(end["is_json"] & end["is_python"])
    return F.when(covered & ended, end["items"])


def _step(state: Column, token: Column) -> Column:
    first, depth, last = F.substring(token, 1, 1), F.length(state["open"]), state["last"]
    opens, closes, is_comma = token.isin("[", "("), token.isin("]", ")"), token == ","
    is_text, is_scalar = first.isin("'", '"'), ~(opens | closes | is_comma)
    may_begin = last.isin(_OPENED, _COMMA)
    partner = F.when(token == "]", "[").otherwise("(")
    continues = is_text & (last == _TEXT)
    valid = (
        F.when(opens, may_begin | ((depth == 0) & (last == _NOTHING)))
        .when(closes, (F.substring(state["open"], -1, 1) == partner) & (depth > 0))
        .when(is_comma, (depth > 0) & last.isin(_TEXT, _VALUE))
        .otherwise((depth > 0) & (may_begin | continues))
    )
    ends_list, ends_element = closes & (depth == 1), closes & (depth == 2)
    # (value) is the value itself
    is_value = ends_list & (token == ")") & (state["commas"] == 0) & (F.size(state["items"]) > 0)
    # nested lists are written as Python writes them: a blank after a comma, unless it is the last of a tuple
    before = F.when((last == _COMMA) & (depth >= 2) & ~closes, " ").otherwise("")
    nested = F.when(
        (depth >= 2) | (opens & (depth == 1)), F.concat(state["nested"], before, token)
    ).otherwise(state["nested"])
    value = F.when(is_text, _unescaped(token)).when(~token.isin("None", "null"), token)
    joined = F.concat(F.slice(state["items"], 1, F.size(state["items"]) - 1), F.array(F.concat(F.element_at(state["items"], -1), value)))
    items = (
        F.when(ends_element, F.concat(state["items"], F.array(nested)))
        .when(is_scalar & (depth == 1) & continues, joined)
        .when(is_scalar & (depth == 1), F.concat(state["items"], F.array(value)))
        .otherwise(state["items"])
    )
    now = (
        F.when(opens, _OPENED).when(ends_list, _ENDED).when(closes, _VALUE).when(is_comma, _COMMA).when(is_text, _TEXT).otherwise(_VALUE)
    )
    python_only = token.isin("None", "True", "False", "(", ")") | (closes & (last == _COMMA))
    return F.struct(
        (state["ok"] & valid & ~is_value).alias("ok"),
        F.when(opens, F.concat(state["open"], token))
        .when(closes & (depth > 0), F.substring(state["open"], F.lit(1), depth - 1))
        .otherwise(state["open"])
        .alias("open"),
        now.alias("last"),
        items.alias("items"),
        F.when(ends_element, "").otherwise(nested).alias("nested"),
        (state["commas"] + (is_comma & (depth == 1)).cast("int")).alias("commas"),
        (state["is_json"] | token.isin("null", "true", "false")).alias("is_json"),
        (state["is_python"] | python_only).alias("is_python"),
    )


def _unescaped(token: Column) -> Column:
    """A string without its quotes and escapes. A backslash before any other character stands for itself."""
    body = F.substring(token, F.lit(2), F.length(token) - 2)
    simple = F.create_map(*[F.lit(x) for pair in _ESCAPES.items() for x in pair])

    def decoded(piece: Column) -> Column:
        digits = F.lpad(F.substring(piece, F.lit(3), F.length(piece)), 4, "0")
        is_code = (F.length(piece) > 2) & F.substring(piece, 1, 2).isin("\\x", "\\u")
        is_escape = (F.substring(piece, 1, 1) == "\\") & (F.length(piece) == 2)
        meant = F.coalesce(F.try_element_at(simple, F.substring(piece, 2, 1)), piece)
        return F.when(is_code, F.decode(F.unhex(digits), "UTF-16BE")).when(is_escape, meant).otherwise(piece)

    return F.when(
        F.contains(body, F.lit("\\")), F.array_join(F.transform(F.regexp_extract_all(body, F.lit(f"({_PIECE})"), 1), decoded), "")
    ).otherwise(body)
