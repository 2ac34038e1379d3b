"""Options of an analysis and their defaults."""

from dataclasses import dataclass


@dataclass(frozen=True)
class LogOptions:
    start: str | None = None
    end: str | None = None
    errors_only: bool = False
    text: str | None = None
    regex: bool = False
    dialect: str = "basic"  # of the regular expression; or "java"
    limit: int | None = None
    sample: bool = False
    top_errors: int = 5
    csv: bool = False
    window: str = "lexical"  # or "instant"
    year: int | None = None  # of timestamps without one; None is the current year

    interval: str = "hour"  # of the histogram and the anomalies
    error_threshold: int = 100  # timestamps on error lines that make an interval an anomaly
    page: int | None = None
    page_size: int = 40
    shown_lines: int = 20  # limit when lines are shown beside a summary

    def __post_init__(self):
        if self.limit is not None and self.limit < 0:
            raise ValueError("limit cannot be negative")
        if self.page_size < 1:
            raise ValueError("page_size must be at least 1")
        if self.window not in ("lexical", "instant"):
            raise ValueError("window is 'lexical' or 'instant'")
