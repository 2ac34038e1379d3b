"""Regular expressions and word lists that define the results.

They are data, not logic. Every pattern is valid in Java regex (Spark). Where a
pattern has to see through ``\\r`` it carries its own ``(?s)`` flag at the place of
use.
"""

# --- timestamps (fixed values) ---------------------------------------------------
CLOCK = "[0-9]{2}:[0-9]{2}:[0-9]{2}"
ISO_T = r"[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}"
ISO_SPACE = r"[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}"
ISO_T_OR_SPACE = r"[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}:[0-9]{2}"
ISO_OPTIONAL_SEPARATOR = r"[0-9]{4}-[0-9]{2}-[0-9]{2}[T ]?[0-9]{2}:[0-9]{2}:[0-9]{2}"
ISO_PIPE = r"[0-9]{4}-[0-9]{2}-[0-9]{2} \| [0-9]{2}:[0-9]{2}:[0-9]{2}"
ISO_DATE = r"[0-9]{4}-[0-9]{2}-[0-9]{2}"
ISO_TAIL = r"(\.[0-9]+)?([+-][0-9]{2}:?[0-9]{2}|Z)?"
SYSLOG = r"[A-Za-z]{3} +[0-9]{1,2} [0-9]{2}:[0-9]{2}:[0-9]{2}"
SYSLOG_SINGLE_BLANK = r"[A-Za-z]{3} [0-9]{1,2} [0-9]{2}:[0-9]{2}:[0-9]{2}"
SYSLOG_PADDED = r"[A-Z][a-z][a-z] [ 0-9][0-9] [0-9][0-9]:[0-9][0-9]:[0-9][0-9]"
MONTHS = "Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec"
SYSLOG_MONTH_YEAR = rf"(?:{MONTHS})\s+[0-9]{{1,2}}\s+[0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}(?:\s+[0-9]{{4}})?"
SYSLOG_MONTH = rf"(?:{MONTHS})[ ]+[0-9]+[ ]+[0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}"
CTIME = r"[A-Za-z]{3} [A-Za-z]{3} [0-9 ]{2} [0-9]{2}:[0-9]{2}:[0-9]{2} [0-9]{4}"
US = r"[0-9]{2}/[0-9]{2}/[0-9]{4} [0-9]{2}:[0-9]{2}:[0-9]{2}"
US_BLANKS = r"[0-9]{2}/[0-9]{2}/[0-9]{4}\s+[0-9]{2}:[0-9]{2}:[0-9]{2}"
US_DATE = r"[0-9]{2}/[0-9]{2}/[0-9]{4}"
EPOCH_WORD = r"\b[0-9]{10,13}\b"

# Candidate patterns of a file, in order of preference.
DETECT_TIMESTAMPS = (
    r"[0-9]{4}-[0-9]{2}-[0-9]{2}[Tt ]?[0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?([+-][0-9]{2}:?[0-9]{2}|Z)?",
    CTIME,
    US,
)
# Patterns tried for the time range of a summary, in order.
RANGE_TIMESTAMPS = (ISO_T, ISO_SPACE, SYSLOG_SINGLE_BLANK)

# --- severities (fixed values) ---------------------------------------------------
DETECT_SEVERITIES = (
    "ERROR|WARN|INFO|DEBUG|TRACE|FATAL",
    "CRITICAL|NOTICE|WARNING",
    "ERR|EMERG|ALERT|CRIT|NOTICE",
)
# (class, words), first class with a word in the line wins; upper or lower case only.
CSV_SEVERITY_WORDS = (
    ("ERROR", ("error", "fail", "fatal", "exception", "critical")),
    ("WARNING", ("warn",)),
    ("INFO", ("info",)),
    ("DEBUG", ("debug",)),
    ("NOTICE", ("notice",)),
    ("INFO", ("started", "completed", "finished", "success")),
    ("ERROR", ("cannot", "not found")),
)
# Any case.
API_SEVERITY_WORDS = (
    ("ERROR", ("error", "fail", "fatal")),
    ("WARNING", ("warn",)),
    ("INFO", ("info",)),
    ("DEBUG", ("debug",)),
)
DISPLAY_SEVERITY_WORDS = (
    ("ERROR", ("error",)),
    ("WARNING", ("warn",)),
    ("INFO", ("info",)),
    ("DEBUG", ("debug",)),
)
# Any case, used where no level text was found.
FALLBACK_SEVERITY_WORDS = (
    ("ERROR", ("error",)),
    ("WARNING", ("warn",)),
    ("INFO", ("info",)),
    ("DEBUG", ("debug",)),
    ("NOTICE", ("notice",)),
    ("INFO", ("started", "completed", "finished", "success")),
    ("ERROR", ("failed", "cannot", "not found")),
)
# Whole words, any case; levels first, then cues.
CONTEXT_SEVERITY_WORDS = (
    ("ERROR", "error|err|crit|critical|fatal|fail|exception|emerg|alert"),
    ("WARNING", "warn|warning"),
    ("INFO", "info|information|notice"),
    ("DEBUG", "debug|trace|fine"),
    ("ERROR", "failed|failure|cannot|not found|denied|invalid|timeout|crash|exception|corrupt|broken|incorrect"),
    ("WARNING", "high|slow|approaching|latency|limitation|degradation|conflict|caution|attention|deprecated"),
    ("INFO", "started|completed|finished|success|created|connected|authenticated|established|loaded|running"),
)
BROAD_ERRORS = ("error", "critical", "fatal", "exception", "fail")
MESSAGE_LEVELS = "ERROR|ERR|WARNING|WARN|INFO|DEBUG|NOTICE|TRACE|FATAL|CRITICAL|CRIT|EMERG|ALERT"

# --- what stands before a message (fixed values) ----------------------------------
# Quantifiers are possessive and starts are looked behind, so that each run of letters,
# digits or blanks is read once however long it is.
CSV_LEAD = r"(?s)^.*?(?:(?<!\s)\s*+(?<![A-Za-z])[A-Za-z]++:\s+|(?<!\s)\s++[A-Za-z]++\s+)"
CSV_HOST = r"^[a-zA-Z0-9_-]++\s+"
LAST_SEPARATOR = r"(?s)^(?:.*:\s*|(?=.* - ).*- )"
CONTEXT_LEAD = (
    rf"(?s)^(?:(?i:.*?\b(?:{MESSAGE_LEVELS})[: ] *)"
    r"|.*?(?<![a-zA-Z0-9._-])[a-zA-Z0-9._-]++:[0-9]++: *|.*?(?<![a-zA-Z0-9._-])[a-zA-Z0-9._-]++\[[0-9]++\]: *)"
)
ERROR_LEADS = (
    rf"^{ISO_T_OR_SPACE}{ISO_TAIL}",
    r"^[A-Za-z]{3} +[0-9]+ +[0-9]{2}:[0-9]{2}:[0-9]{2} +(?:[0-9]{4})?",
    r"^[0-9]{2}/[0-9]{2}/[0-9]{4} +[0-9]{2}:[0-9]{2}:[0-9]{2}",
    r"(?s)^.*ERROR:?\s*",
)

# --- lines ------------------------------------------------------------------------
COMMENT = r"^\s*#"
CONTROL_CHARACTERS = r"[\x00-\x08\x0B\x0C\x0E-\x1F]"
