"""Timestamps of log lines: extraction profiles, normalisation, comparison.

The profiles are different definitions of "the timestamp of a line" on purpose;
results depend on which one an operator uses.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

from logscope.functions import patterns as P
from logscope.functions.text import first_match

FORMAT = "yyyy-MM-dd HH:mm:ss"
PROFILES = ("csv", "lexical", "rich", "range", "detected", "view", "api")


def year_text(year: int | None = None) -> Column:
    """Year given to timestamps that carry none; the current one by default."""
    return F.date_format(F.current_date(), "yyyy") if year is None else F.lit(f"{year:04d}")


def _blank_for_t(ts: Column) -> Column:
    return F.replace(ts, F.lit("T"), F.lit(" "))


def _with_year(ts: Column, year: int | None) -> Column:
    """``ts`` followed by the year, if it ends with its seconds."""
    return F.regexp_replace(ts, F.lit(r"(:[0-9]{2})$"), F.concat(F.lit("$1 "), year_text(year)))


def _from_epoch(seconds: Column) -> Column:
    # Spark prints years above 9999 with a plus sign
    return F.ltrim(F.date_format(F.timestamp_seconds(seconds.try_cast("bigint")), FORMAT), F.lit("+"))


def _without_millis(digits: Column) -> Column:
    return F.regexp_replace(digits, "^([0-9]{10})[0-9]{3}$", "$1")


def extract_ts(line: Column, profile: str = "csv", year: int | None = None) -> Column:
    """Timestamp text of ``line`` under ``profile``; NULL where there is none.

    All forms but dates alone and epoch digits hold a clock; lines without one are
    not searched for the less frequent of them.
    """
    iso = [_blank_for_t(first_match(line, P.ISO_T)), first_match(line, P.ISO_SPACE)]

    def clocked(*forms):
        return F.when(line.rlike(P.CLOCK), F.coalesce(*forms))

    if profile == "csv":
        return F.coalesce(*iso, clocked(_with_year(first_match(line, P.SYSLOG), year), first_match(line, P.US)))
    if profile == "lexical":
        return F.coalesce(*iso)
    if profile == "view":
        return F.coalesce(*iso, clocked(first_match(line, P.SYSLOG_PADDED), first_match(line, P.US)))
    if profile == "api":
        return first_match(line, P.ISO_T_OR_SPACE)
    if profile == "detected":
        first, *others = [first_match(line, p) for p in P.DETECT_TIMESTAMPS]
        return F.coalesce(first, clocked(*others))
    if profile == "rich":
        return F.coalesce(
            iso[0],
            _blank_for_t(first_match(line, P.ISO_OPTIONAL_SEPARATOR)),
            clocked(
                _with_year(first_match(line, P.SYSLOG_MONTH_YEAR), year),
                first_match(line, P.US_BLANKS),
            ),
            _from_epoch(_without_millis(first_match(line, P.EPOCH_WORD))),
        )
    if profile == "range":
        noon = F.lit(" 12:00:00")
        return F.coalesce(
            iso[1],
            iso[0],
            clocked(F.replace(first_match(line, P.ISO_PIPE), F.lit(" | "), F.lit(" "))),
            F.concat(first_match(line, P.ISO_DATE), noon),
            clocked(first_match(line, P.US)),
            F.concat(first_match(line, P.US_DATE), noon),
            clocked(_with_year(first_match(line, P.SYSLOG_MONTH), year)),
        )
    raise ValueError(f"unknown timestamp profile {profile!r}, use one of {PROFILES}")


ISO_FORM = rf"^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}([T ]{P.CLOCK}(\.[0-9]+)?( ?(Z|[+-][0-9]{{2}}:?[0-9]{{2}}))?)?$"
MONTH_FORM = rf"^[A-Za-z]{{3}} [0-9]{{1,2}} {P.CLOCK} [0-9]{{4}}$"


def to_ts(text: Column, year: int | None = None) -> Column:
    """TIMESTAMP of any of the supported written forms; NULL if it is none of them.

    ``text`` should be a plain column. ISO with ``T`` or blank, fraction and zone optional; ``MM/DD/YYYY``; month name,
    day and clock with or without weekday and year; dates alone in the first two.
    """
    iso = F.regexp_replace(text, r"^([0-9]{2})/([0-9]{2})/([0-9]{4})( *)", "$3-$1-$2$4")
    iso = F.regexp_replace(F.translate(iso, "tz,", "TZ."), r"\s+", " ")
    month = F.regexp_replace(text, r"\s+", " ")
    month = _with_year(F.regexp_replace(month, "^[A-Za-z]{3} (?=[A-Za-z]{3} )", ""), year)
    plain = (F.length(text) == 19) & (F.instr(text, "-") == 5)  # by far the most frequent form
    return F.when(plain, F.try_to_timestamp(text)).otherwise(F.coalesce(
        F.try_to_timestamp(F.regexp_extract(iso, ISO_FORM, 0)),
        F.try_to_timestamp(F.regexp_extract(month, MONTH_FORM, 0), F.lit("MMM d HH:mm:ss yyyy")),
    ))


def normalize_ts(ts: Column, fmt: str | None = None, year: int | None = None) -> Column:
    """``ts`` as ``yyyy-MM-dd HH:mm:ss``; what cannot be read comes back unchanged.

    ``fmt`` is ``syslog``, ``apache`` or an output format (Spark datetime pattern).
    """
    parsed = F.date_format(to_ts(ts, year), FORMAT)
    if fmt == "syslog":
        return F.coalesce(parsed, ts)
    if fmt == "apache":
        wall = F.try_to_timestamp(F.split_part(ts, F.lit(" "), F.lit(1)), F.lit("dd/MMM/yyyy:HH:mm:ss"))
        return F.coalesce(F.date_format(wall, FORMAT), ts)
    if fmt is not None:
        return F.coalesce(F.date_format(to_ts(ts, year), fmt), ts)
    return (
        F.when(ts.rlike(rf"^{P.ISO_DATE}$"), F.concat(ts, F.lit(" 00:00:00")))
        .when(ts.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[Tt][0-9]{2}:[0-9]{2}:[0-9]{2}"),
              F.coalesce(parsed, F.substring_index(_blank_for_t(ts), ".", 1)))
        .when(ts.rlike(rf"^{P.ISO_SPACE}"), ts)
        .when(ts.rlike(r"^[0-9]{1,13}$"),
              _from_epoch(ts))
        .otherwise(F.coalesce(parsed, ts))
    )


def to_epoch(ts: Column, year: int | None = None) -> Column:
    """Epoch seconds; 10 digits are seconds, 13 are milliseconds, NULL if unreadable."""
    digits = _without_millis(F.regexp_extract(ts, "^([0-9]{10}|[0-9]{13})$", 0))
    return F.coalesce(digits.try_cast("bigint"), F.unix_seconds(to_ts(ts, year)))


def _instant(ts: Column, year: int | None) -> Column:
    """Epoch seconds of what ``normalize_ts`` would show."""
    digits = F.regexp_extract(ts, "^[0-9]{1,13}$", 0)
    return F.coalesce(F.unix_seconds(to_ts(ts, year)), digits.try_cast("bigint"))


def compare_ts(a: Column, b: Column, year: int | None = None) -> Column:
    """0 equal, 1 if ``a`` is later, 2 if earlier, NULL if either cannot be read."""
    return F.pmod(F.signum(_instant(a, year) - _instant(b, year)), F.lit(3)).cast("int")


EARLIEST, LATEST = "1970-01-01 00:00:00", "9999-12-31 23:59:59"


def within(seconds: Column, first: Column, last: Column) -> Column:
    """``seconds BETWEEN first AND last`` with one mention of ``seconds``: distance from the middle."""
    return F.abs(2 * seconds - (first + last)) <= last - first


def in_range(ts: Column, start: str | None = None, end: str | None = None, year: int | None = None) -> Column:
    """Inclusive test; an open end reaches 1970-01-01 or 9999-12-31."""
    first, last = _instant(F.lit(start or EARLIEST), year), _instant(F.lit(end or LATEST), year)
    return within(_instant(ts, year), first, last)
