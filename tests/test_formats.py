"""One line of each named format, the registry, detection."""

import pytest

from logscope.operators import formats
from logscope.operators.formats import FormatRegistry

CLF = '192.0.2.1 - alice [15/Oct/2023:08:00:01 +0000] "GET /index.html HTTP/1.1" 200 2326'
SAMPLES = {
    "spring_boot": ("2023-10-15 08:00:01.123 [main] ERROR com.example.App - Start failed", {"logger": "com.example.App", "message": "Start failed"}),
    "winston": ("2023-10-15T08:00:01.123Z ERROR Database connection failed", {"severity": "ERROR"}),
    "django": ("2023-10-15 08:00:01,123 ERROR django.request: Internal Server Error: /api", {"module": "django.request", "message": "Internal Server Error: /api"}),
    "apache_common": (CLF, {"host": "192.0.2.1", "status": "200", "bytes": "2326"}),
    "apache_combined": (CLF + ' "https://example.com/" "Mozilla/5.0"', {"user_agent": "Mozilla/5.0"}),
    "nginx_access": ('192.0.2.1 - alice [15/Oct/2023:08:00:01 +0000] "GET / HTTP/1.1" 404 153 "-" "curl/8.0"', {"status": "404", "http_user_agent": "curl/8.0"}),
    "json": ('{"timestamp":"2023-10-15T08:00:01Z","level":"error","message":"boom"}', {}),
    "simple": ("2023-10-15 08:00:01 ERROR Database connection failed", {"message": "Database connection failed"}),
    "syslog": ("<34>1 2023-10-15T08:00:01.003Z host1 su 1234 ID47 - su root failed", {"hostname": "host1", "message": "su root failed"}),
    "postgresql": ('2023-10-15 08:00:01.123 UTC [1234] user=app,db=prod, ERROR: relation "x" does not exist', {"pid": "1234", "database": "prod"}),
    "mysql_error": ("2023-10-15T08:00:01.123456Z 8 [ERROR] [MY-010119] [Server] Aborting", {"subsystem": "MY-010119"}),
    "aws_cloudtrail": ('{"Records":[{"eventName":"ConsoleLogin"}]}', {}),
    "kubernetes": ("2023-10-15T08:00:01.123Z ERROR kubelet: Failed to pull image", {"component": "kubelet"}),
    "java_stacktrace": ("java.lang.NullPointerException: boom", {"exception": "java.lang.NullPointerException", "message": "boom"}),
    "w3c_iis": ("2023-10-15 08:00:01 GET /index.html 200", {"data": "2023-10-15 08:00:01 GET /index.html 200"}),
}


@pytest.mark.parametrize("name", SAMPLES)
def test_parse(lines, name):
    line, want = SAMPLES[name]
    marked = line.replace("8", "8\u0001", 1) if name == "json" else line
    rows = formats.parse_format(lines(line, "-- other", marked), name).orderBy("line_no").collect()
    fields = formats.REGISTRY[name].fields
    assert all(rows[0][f] is not None for f in fields)
    assert all(rows[1][f] is None for f in fields)
    assert all(rows[2][f] is not None for f in fields)
    for field, value in want.items():
        assert rows[0][field] == value


def test_mark_in_line_is_text(lines):
    row = formats.parse_format(lines("2023-10-15 08:00:01 ERROR a\u0001b"), "simple").first()
    assert (row.severity, row.message) == ("ERROR", "a\u0001b")
    assert formats.parse_format(lines("no\u0001ne"), "simple").first().message is None


def test_detect_each(lines):
    files = [(name, i, line) for name, (line, _) in SAMPLES.items() for i in (1, 2, 3)]
    files = [(f, i, "#Fields: date time m u s" if (f, i) == ("w3c_iis", 1) else line) for f, i, line in files]
    files.append(("none", 1, "hello"))
    found = {r.file: r.format for r in formats.detect_format(lines(files)).collect()}
    assert found == {**{n: n for n in SAMPLES}, "nginx_access": "apache_combined", "none": "custom"}


def test_detect_looks_at_twenty_lines(lines):
    late = ["hello"] * 20 + [SAMPLES["winston"][0]] * 30
    row = formats.detect_format(lines(*late)).first()
    assert (row.format, row.lines) == ("custom", 20)
    pattern = formats.detect_patterns(lines(*late)).first()
    assert pattern.timestamp_pattern is None and pattern.severity_pattern is None


def test_register(lines):
    registry = FormatRegistry()
    registry.register("rails", "timestamp severity request_id message", r"^([0-9TZ:.-]+) +([A-Z]+) +([a-z0-9-]+) +(.*)$")
    line = "2023-10-15T08:00:01Z ERROR ab-12 boom"
    assert formats.parse_format(lines(line), "rails", registry).first().request_id == "ab-12"
    assert formats.detect_format(lines(line), registry).first().format == "rails"
    registry.register("simple", "all", "^(.*)$")
    assert formats.parse_format(lines(line), "simple", registry).first()["all"] == line
    assert "timestamp" in formats.REGISTRY["simple"].fields


def test_json_fields(lines):
    rows = formats.json_fields(lines(
        '{"timestamp":"t","severity":"warn","message":"m \\"q\\""}', '{"level":"info","severity":"x"}', '{"level":', "text",
    )).orderBy("line_no").collect()
    assert [(r.timestamp, r.severity, r.message) for r in rows] == [("t", "warn", 'm "q"'), ("", "info", ""), ("", "", ""), ("", "", "")]


def test_parse_detected_per_file(lines):
    rows = formats.parse_detected(lines([
        ("a", 1, "2024-01-01 00:00:00 WARNING disk"), ("a", 2, "01/01/2024 00:00:00 info x"),
        ("b", 1, "01/02/2024 00:00:00 NOTICE y"), ("c", 1, "nothing"),
    ])).orderBy("file", "line_no").collect()
    assert [(r.timestamp, r.severity, r.message) for r in rows] == [
        ("2024-01-01 00:00:00", "WARN", "ING disk"), ("", "info", "01/01/2024 00:00:00  x"),
        ("01/02/2024 00:00:00", "NOTICE", "y"), ("", "", "nothing"),
    ]


def w3c(lines):
    """What each data line must give, file by file."""
    out = {}
    for file, _, line in sorted(lines):
        names = out.setdefault(file, [None, []])
        if line.startswith("#Fields: ") and len(line) > 9:
            names[0] = line[9:].split(" ")
        elif line[:1] in "0123456789-" and names[0]:
            names[1].append(dict(zip(names[0], line.split(" "))))
    return {f: rows for f, (_, rows) in out.items()}


@pytest.mark.parametrize("block", [1, 3, 10, 1000])
@pytest.mark.parametrize("limit", [0, 10**6])
def test_w3c_headers_over_blocks(lines, block, limit):
    """Blocks with no header, one, several, and with one that is too long to be handed round."""
    import random

    rng = random.Random(block)
    rows = []
    for file in "abc":
        for i in range(60):
            long = " ".join(f"field{k}" for k in range(100))
            kind = rng.random()
            line = (
                "#Fields: date time x" + rng.choice("123") if kind < 0.1 else f"#Fields: date time {long}" if kind < 0.13 else "#Fields: " if kind < 0.16
                else "# other" if kind < 0.2 else f"2024-01-01 00:00:{i % 60:02d} v{i} w{i}"
            )
            rows.append((file, i, line))
    found = {}
    for r in formats.w3c_rows(lines(rows), block=block, limit=limit).orderBy("file", "line_no").collect():
        found.setdefault(r.file, []).append(r.row)
    assert found == {f: rows for f, rows in w3c(rows).items() if rows}


def test_w3c_sorts_no_plain_lines(spark, tmp_path, measured):
    """Data lines of splits with a header at most reach the result without a shuffle or a sort."""
    from logscope import read

    (tmp_path / "a.log").write_text("#Fields: date time m\n" + "2024-01-01 00:00:00 GET\n" * 50)
    log = read(spark, str(tmp_path))
    rows, metrics = measured(lambda: log.w3c_rows().collect())
    assert len(rows) == 50 and metrics["shuffleWriteRecords"] < 15  # rows of block tables; none of the 50 lines
