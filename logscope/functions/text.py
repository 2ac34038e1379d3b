"""Small string expressions shared by the extraction functions.

Most name their argument once: Catalyst puts the whole argument in for every mention,
so nested functions with several mentions grow exponentially.
"""

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from logscope.functions.patterns import COMMENT, CONTROL_CHARACTERS

WHITE_SPACE = " \t\n\x0b\f\r"


def first_match(text: Column, pattern: str) -> Column:
    """Leftmost match of ``pattern``, NULL where there is none."""
    return F.nullif(F.regexp_extract(text, pattern, 0), F.lit(""))


def contains_any(text: Column, words) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def classify(text: Column, classes, default: str) -> Column:
    """First ``(label, words)`` class with a word in ``text``."""
    branches = [(contains_any(text, words), label) for label, words in classes]
    out = F.when(branches[0][0], branches[0][1])
    for test, label in branches[1:]:
        out = out.when(test, label)
    return out.otherwise(default)


def remove_first(text: Column, part: Column) -> Column:
    """``text`` without the first literal occurrence of ``part``; both should be plain columns."""
    at = F.instr(text, part)
    return F.when(
        at > 0, F.concat(F.substring(text, F.lit(1), at - 1), F.substring(text, at + F.length(part), F.length(text)))
    ).otherwise(text)


def after_first(text: Column, part: Column) -> Column:
    """What follows the first literal occurrence of ``part``; ``text`` if absent. Plain columns, too."""
    at = F.instr(text, part)
    return F.when(at > 0, F.substring(text, at + F.length(part), F.length(text))).otherwise(text)


def strip(text: Column) -> Column:
    """Both ends free of white space of any kind (``trim`` alone takes blanks only)."""
    return F.trim(text, F.lit(WHITE_SPACE))


def collapse_blanks(text: Column) -> Column:
    """Printed form of a counted line: runs of blanks and tabs become one blank."""
    return F.trim(F.regexp_replace(text, r"[ \t]+", " "))


def sanitize_text(text: Column) -> Column:
    """Drop control characters (TAB, LF, CR stay) and escape double quotes."""
    return F.replace(F.regexp_replace(text, CONTROL_CHARACTERS, ""), F.lit('"'), F.lit('\\"'))


def csv_field(text: Column) -> Column:
    """Double the quotes, as inside a quoted CSV field."""
    return F.replace(text, F.lit('"'), F.lit('""'))


def is_content(line: Column) -> Column:
    """Neither a comment nor blank."""
    return ~line.rlike(COMMENT) & (F.trim(line) != "")


def bar(count: Column, largest: Column, width: int = 50) -> Column:
    """A bar of ``#``, ``width`` long for the largest count."""
    return F.repeat(F.lit("#"), F.floor(count * width / largest).cast("int"))
