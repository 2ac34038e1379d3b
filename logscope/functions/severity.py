"""Severity of a line, under five different definitions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from logscope.functions import patterns as P
from logscope.functions.text import classify, first_match

PROFILES = ("csv", "api", "display", "contextual", "detected")


def severity(line: Column, profile: str = "csv") -> Column:
    if profile == "csv":
        both_cases = [(label, [w for word in words for w in (word.upper(), word)]) for label, words in P.CSV_SEVERITY_WORDS]
        return classify(line, both_cases, "UNKNOWN")
    if profile == "api":
        return classify(F.lower(line), P.API_SEVERITY_WORDS, "UNKNOWN")
    if profile == "display":
        return classify(F.lower(line), P.DISPLAY_SEVERITY_WORDS, "NONE")
    if profile == "contextual":
        out = F
        for label, words in P.CONTEXT_SEVERITY_WORDS:
            out = out.when(line.rlike(rf"(?i)\b(?:{words})\b"), label)
        return out.otherwise("UNKNOWN")
    if profile == "detected":
        levels = [level_text(line, p) for p in P.DETECT_SEVERITIES]
        return F.coalesce(*levels, keyword_severity(line))
    raise ValueError(f"unknown severity profile {profile!r}, use one of {PROFILES}")


def level_text(line: Column, pattern: str) -> Column:
    """Text of the first level word, as written; NULL if none."""
    return first_match(line, f"(?i){pattern}")


def keyword_severity(line: Column) -> Column:
    return classify(F.lower(line), P.FALLBACK_SEVERITY_WORDS, "UNKNOWN")
