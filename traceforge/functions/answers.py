"""Answer extraction and equivalence, as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from traceforge.constants import ANSWER_FORCE_STRING
from traceforge.functions.text import strip

# --- fixed values: answer formats ----------------------------------------
BRACE_PATTERN = r"(\\[{}]|[{}]|[^{}\\]++|\\)"
BOX = "\\boxed{"
# The content of most boxes: braces at most two deep, none escaped, and not so many that the matcher runs out of stack.
SIMPLE_BOX = r"^((?:[^{}\\]++|\\[^{}]|\{(?:[^{}\\]++|\\[^{}]|\{[^{}\\]*+\}){0,40}+\}){0,40}+)\}"
NUMBER_PATTERN = r"-?\d+(?:,\d+)*(?:\.\d+)?(?:/\d+)?"
INTEGER_PATTERN = r"^[+-]?\d+$"
# A number with a unit in a text command, a percent or a degree sign behind it.
UNIT_PATTERN = r"^([+-]?[\d.,/]*\d)(?:\\(?:text|mathrm|mbox)\{[^{}]*\}|\\?%|\^\{?\\circ\}?)+(\.?)$"
# A unit behind something: in a text command, as a sign, or as words behind a number.
UNIT_BEHIND = (
    r"(?<=[\d})»a-z.])\s*(\\(?:text|mathrm|mbox)\{[^{}]*\}(?:\^\{?\d\}?)?|\\?%|\^\{?\\circ\}?|°"
    r"|(?<=\d )(?<=\s)[A-Za-z]{2,}[A-Za-z ]*(?:\^\{?\d\}?)?)\s*\.?$"
)
BARE_NUMBER = r"^-?\d{1,15}(\.\d{1,15})?$"
NAMED_VALUE = r"^(?:[a-z]|\\[a-z]+)=[^=]+$"
MIXED_PATTERN = r"^(-?)\((\d+)\+(\d+)/(\d+)\)$"
# A whole number in one spelling before a closing brace, also where no other digit follows.
PLAIN_BOX = r"^(0|-?[1-9]\d{0,14})\}"
PLAIN_ONLY = r"^(0|-?[1-9]\d{0,14})\}\D*\z"
PLAIN_NUMBER_PATTERN = r"^[+-]?(\d+\.?\d*|\.\d+)(e[+-]?\d+)?$"
TOLERANCE = 1e-6


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _balanced(piece: Column) -> Column:
    """What stands before the brace that closes an open one, at any depth; null if none does.

    Escaped braces are text.
    """
    tokens = F.regexp_extract_all(piece, F.lit(BRACE_PATTERN), F.lit(1))

    def step(state: Column, token: Column) -> Column:
        change = F.when(token == "{", 1).when(token == "}", -1).otherwise(0)
        depth = state["depth"] + F.when(state["depth"] > 0, change).otherwise(0)
        size = state["size"] + F.when(depth > 0, F.length(token)).otherwise(0)
        return F.struct(depth.alias("depth"), size.alias("size"))

    start = F.struct(F.lit(1).alias("depth"), F.lit(0).alias("size"))
    scanned = bound(
        F.aggregate(tokens, start, step),
        lambda end: F.when(end["depth"] == 0, F.substring(piece, F.lit(1), end["size"])),
    )
    return F.when(piece.rlike(SIMPLE_BOX), F.regexp_extract(piece, SIMPLE_BOX, 1)).otherwise(scanned)


def extract_answer(text: Column) -> Column:
    """Content of the last balanced box, else the last number, else null.

    Boxes are scanned once, from the last one backwards.
    """

    def last_box(pieces: Column) -> Column:
        backwards = F.slice(F.reverse(pieces), F.lit(1), F.size(pieces) - 1)
        return F.aggregate(
            backwards, F.lit(None).cast("string"), lambda found, piece: F.coalesce(found, _balanced(piece))
        )

    tail = F.substring_index(text, BOX, -1)
    boxed = F.when(F.contains(text, F.lit(BOX)), F.when(tail.rlike(SIMPLE_BOX), F.regexp_extract(tail, SIMPLE_BOX, 1)).otherwise(
        bound(F.split(text, r"\\boxed\{"), last_box)
    ))
    numbers = F.regexp_extract_all(text, F.lit(NUMBER_PATTERN), F.lit(0))
    return F.coalesce(boxed, F.try_element_at(numbers, F.lit(-1)))


def normalise_answer(answer: Column) -> Column:
    """One spelling per answer: no spacing or sizing commands, no unit behind a number,
    plain fractions, lower case."""
    out = F.regexp_replace(answer, r"\\left|\\right|\\[!,;:$]|\$|\s+", "")
    out = F.regexp_replace(out, UNIT_PATTERN, "$1$2")
    out = bound(out, _without_group_commas)
    out = F.regexp_replace(out, r"\\text\{([^{}]*)\}", "$1")
    out = F.regexp_replace(out, r"\\[dt]frac", r"\\frac")
    out = F.regexp_replace(out, r"\\frac\{(-?\d+)\}\{(-?\d+)\}", "$1/$2")
    out = F.regexp_replace(out, r"\\frac(\d)(\d)", "$1/$2")
    return F.lower(F.regexp_replace(out, r"\.$", ""))


def _without_group_commas(text: Column) -> Column:
    """No commas before groups of three digits; text with brackets is left, so a list stays a list."""
    joined = F.regexp_replace(text, r"(?<=\d),(?=\d{3}(?!\d))", "")
    return F.when(text.rlike(r"[(\[{«]"), text).otherwise(joined)


def typed_answer(answer: Column) -> Column:
    """What an extracted answer says: ``text``, ``value`` of a plain number, ``unit``, ``name``.

    ``text`` has one spelling: no spacing, sizing or text commands, sets in «»,
    mixed numbers as sums in brackets, plain fractions, lower case. The unit is
    what stands in a text command behind the rest, a percent or degree sign, or
    a word of two letters or more behind a number; the name is a letter before
    the only equals sign. Both may lack. An empty answer is null.
    """

    def split_unit(raw: Column) -> Column:
        unit = F.regexp_extract(raw, UNIT_BEHIND, 1)
        body = F.when(unit == "", raw).otherwise(F.regexp_replace(raw, UNIT_BEHIND, ""))
        return F.struct(body.alias("body"), _plain_unit(unit).alias("unit"))

    def split_name(parts: Column) -> Column:
        body = F.lower(F.regexp_replace(F.regexp_replace(parts["body"], r"\\(?:text|mathrm|mbox)\{([^{}]*)\}", "$1"), r"\s+", ""))
        return bound(
            body,
            lambda b: F.struct(
                F.when(b.rlike(NAMED_VALUE), F.substring_index(b, "=", -1)).otherwise(b).alias("body"),
                parts["unit"].alias("unit"), F.when(b.rlike(NAMED_VALUE), F.substring_index(b, "=", 1)).alias("name"),
            ),
        )

    def spelled(parts: Column) -> Column:
        out = bound(F.regexp_replace(parts["body"], r"\.$", ""), _without_group_commas)
        out = F.regexp_replace(out, r"^\(([a-z])\)$", "$1")
        out = F.regexp_replace(out, r"\\frac(\d)(\d)", r"\\frac{$1}{$2}")
        out = F.regexp_replace(out, r"(?<![\d.])(\d+)\\frac\{(\d+)\}\{(\d+)\}", "($1+$2/$3)")
        out = F.regexp_replace(out, r"^(-?)\\frac\{(-?\d+)\}\{(-?\d+)\}$", "$1$2/$3")
        out = F.regexp_replace(out, r"^--", "")
        return bound(
            out,
            lambda t: F.struct(
                t.alias("text"), _number_value(t).alias("value"), parts["unit"].alias("unit"), parts["name"].alias("name")
            ),
        )

    raw = F.regexp_replace(answer, r"\\left|\\right|\\[!,;: $]|\\q?quad|\$", " ")
    raw = F.regexp_replace(F.regexp_replace(raw, r"\{,\}", ""), r"\\[dt]frac", r"\\frac")
    raw = strip(F.replace(F.replace(raw, F.lit("\\{"), F.lit("«")), F.lit("\\}"), F.lit("»")))
    typed = bound(bound(bound(raw, split_unit), split_name), spelled)
    none = F.lit(None).cast("string")
    plain = F.struct(answer.alias("text"), answer.try_cast("double").alias("value"), none.alias("unit"), none.alias("name"))
    return F.when(answer.rlike(BARE_NUMBER), plain).when(strip(answer) != "", typed)


def _plain_unit(unit: Column) -> Column:
    """One spelling per unit, null for none: no blanks, braces, full stop or plural."""
    out = F.regexp_replace(F.lower(unit), r"\\(?:text|mathrm|mbox)|[{}\s.]|\\(?=%)", "")
    out = F.regexp_replace(out, r"^(?:\^\\circ|°)$", "degree")
    out = F.regexp_replace(F.regexp_replace(out, r"^percent$", "%"), r"(?<=[a-z]{2})s$", "")
    return F.nullif(out, F.lit(""))


def _number_value(text: Column) -> Column:
    """``numeric_answer``, also for mixed numbers."""
    mixed = F.regexp_extract_all(text, F.lit(MIXED_PATTERN), F.lit(0))
    parts = [F.regexp_extract(text, MIXED_PATTERN, i).try_cast("double") for i in (2, 3, 4)]
    sign = F.when(F.startswith(text, F.lit("-")), -1.0).otherwise(1.0)
    return F.when(F.size(mixed) == 1, sign * (parts[0] + F.try_divide(parts[1], parts[2]))).otherwise(numeric_answer(text))


def numeric_answer(normalised: Column) -> Column:
    """Value of a plain number or of a quotient of two, else null."""

    def value(text):
        number = text.try_cast("double")
        return F.when(text.rlike(PLAIN_NUMBER_PATTERN) & (F.abs(number) < float("inf")), number)

    parts = F.split(normalised, "/", -1)
    top, bottom = F.try_element_at(parts, F.lit(1)), F.try_element_at(parts, F.lit(2))
    return F.when(F.size(parts) == 1, value(top)).when(
        F.size(parts) == 2, F.try_divide(value(top), value(bottom))
    )


def same_answer(gold: Column, other: Column, gold_key: Column, key: Column) -> Column:
    """Whether two ``typed_answer`` agree; never null.

    Names, and units, agree unless both are there and differ. The rest agrees as
    text, as values within the absolute or relative tolerance, or as formulas by
    their keys. Two whole numbers are equal only digit by digit.
    """
    whole = gold["text"].rlike(INTEGER_PATTERN) & other["text"].rlike(INTEGER_PATTERN)
    digits = [
        F.regexp_replace(F.regexp_replace(t["text"], r"^\+", ""), r"^(-?)0+(?=\d)", "$1") for t in (gold, other)
    ]
    near = F.abs(gold["value"] - other["value"]) <= TOLERANCE * F.greatest(
        F.lit(1.0), F.abs(gold["value"]), F.abs(other["value"])
    )
    equal = F.when(whole, digits[0] == digits[1]).when(near.isNotNull(), near).otherwise(gold_key == key)
    fits = [F.coalesce(gold[part] == other[part], F.lit(True)) for part in ("unit", "name")]
    return F.coalesce(F.when(gold["text"] == other["text"], F.lit(True)).otherwise(equal), F.lit(False)) & fits[0] & fits[1]


def plain_integer(text: Column) -> Column:
    """``extract_answer`` where it is a whole number without plus sign or leading zeros, else null.

    It stands alone in the last box; in a text without a box it opens the text
    before a closing brace, as behind a forced box, and no digit follows.
    """
    boxed = F.regexp_extract(F.substring_index(text, BOX, -1), PLAIN_BOX, 1)
    return F.nullif(F.when(F.contains(text, F.lit(BOX)), boxed).otherwise(F.regexp_extract(text, PLAIN_ONLY, 1)), F.lit(""))


def answer_variants(trace: Column) -> list[Column]:
    """The texts an answer may be read from: the whole trace and, when an answer
    was forced, what stands before and after the last forcing."""
    forced = F.contains(trace, F.lit(ANSWER_FORCE_STRING))
    tail = F.substring_index(trace, ANSWER_FORCE_STRING, -1)
    head_length = F.length(trace) - F.length(tail) - len(ANSWER_FORCE_STRING)
    head = F.substring(trace, F.lit(1), head_length)
    return [trace, F.when(forced, head), F.when(forced, tail)]
