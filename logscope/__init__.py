"""Log analytics on Spark DataFrames."""

from logscope.api import LogResult, analyze, analyze_frame, analyze_string
from logscope.frame import LogFrame, read, read_text
from logscope.operators.formats import REGISTRY, FormatRegistry, LogFormat, register_format
from logscope.options import LogOptions

__all__ = [
    "REGISTRY", "FormatRegistry", "LogFormat", "LogFrame", "LogOptions", "LogResult", "analyze", "analyze_frame",
    "analyze_string", "read", "read_text", "register_format",
]
