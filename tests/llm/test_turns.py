"""Conversation repair against a search over all edits."""

import hashlib
import random
import zlib
from functools import cache

import pytest
from pyspark.sql import functions as F

from logscope.llm import turn_repair

SCHEMA = "conv_id long, turn long, role string, text string"
BLANKS = " \t\n\x0b\f\r"


def damaged(rows):
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        role, text, hit = " " if role is None else role, " " if text is None else text, zlib.crc32(key.encode()) % 20
        if hit:
            text = "" if hit == 1 else "".join(c for c in text if c not in ".!?") if hit == 2 else text
            yield from [(conv, turn, "user" if hit == 4 else role, text)] * (2 if hit == 3 else 1)


def cheapest(rows):
    """(cost, audit) of the best edits of (initial, forced, truncated) rows, letter by letter from the left."""
    step = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}

    @cache
    def best(i, state, inserted):
        found = [(0, "")] if i == len(rows) and state in ("", "a") else []
        if inserted < 4:
            for role in "ua":
                if role in step[state]:
                    found.append((2, "I", best(i, step[state][role], inserted + 1)))
        if i < len(rows):
            initial, forced, truncated = rows[i]
            found.append((3, "D", best(i + 1, state, 0)))
            if not forced:
                for role in "ua":
                    if role in step[state]:
                        found.append((2 + truncated, "R", best(i + 1, step[state][role], 0)))
                if initial in step[state]:
                    found.append((truncated, "K", best(i + 1, step[state][initial], 0)))
        made = [f if len(f) == 2 else (f[0] + f[2][0], f[1] + f[2][1]) for f in found]
        return min(made, default=(1 << 40, ""))

    return best(0, "", 0)


def repaired(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in damaged(rows) if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        seen, plain, blank, duplicate, truncated = set(), [], 0, 0, 0
        for _, _, role, text in own:
            said = text.strip(BLANKS)
            fault = "b" if not said else "d" if (role, text) in seen else "t" if said[-1] not in ".!?" else ""
            seen.add((role, text))
            blank, duplicate, truncated = blank + (fault == "b"), duplicate + (fault == "d"), truncated + (fault == "t")
            plain.append((role[:1], fault in ("b", "d"), fault == "t"))
        cost, audit = cheapest(plain)
        lines, left = [], iter(own)
        n = len(audit.replace("D", ""))
        for letter in audit:
            row = next(left) if letter != "I" else None
            if letter != "D":
                made = "user" if (len(lines) - n % 2) % 2 == 0 else "assistant"
                lines.append(f"{row[2] if letter == 'K' else made}:{row[3] if row else ''}")
        turns = [r[1] for r in own if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(plain, plain[1:]))
        out[conv] = (gaps, blank, duplicate, truncated, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def result(spark, rows, tmp_path, clash=False):
    frame = spark.createDataFrame(rows, SCHEMA)
    if clash:
        frame = frame.withColumns({c: F.lit("own") for c in ("conv", "n", "at", "block", "blank", "audit", "cost", "hit")})
    frame.write.parquet(str(tmp_path / "conversations.parquet"))
    done = turn_repair.op12_turn_repair(spark, str(tmp_path)).collect()
    assert len({r["conv_id"] for r in done}) == len(done)
    return {r["conv_id"]: tuple(r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")) for r in done}


def test_odd_conversations(spark, tmp_path):
    long = "word " * 100_000
    rows = [
        (1, None, "user", "a."), (1, None, None, None), (1, 5, "assistant", "b?"), (1, 5, "assistant", "b?"), (1, 5, "assistant", "b"),
        (2, 0, "tool", "x."), (2, 1, "", "y."), (2, 2, "system", "z!"), (None, 1, "user", "no name."), (None, None, "assistant", "é🎉"),
        (3, 1, "user", long), (3, 2, "assistant", long + "."), (3, 3, "assistant", long + "."), (4, 7, "system", "only."), (5, 1, "user", " \n"),
        (6, -3, "assistant", "q"), (6, 9, "user", "q"), *[(7, 1, "user", "same.")] * 50,
    ]
    assert result(spark, rows, tmp_path, clash=True) == repaired(rows)


def test_no_conversations(spark, tmp_path):
    assert result(spark, [], tmp_path) == {}


@pytest.mark.parametrize("bits", [1, 10])
def test_random_conversations(spark, tmp_path, monkeypatch, bits):
    """Also with blocks of two rows, so that conversations are cut many times."""
    monkeypatch.setattr(turn_repair, "BLOCK_BITS", bits)
    rng = random.Random(3)
    rows = [
        (c, rng.choice([t, t, t, None, t // 2]), rng.choice(["user", "assistant", "system", "user", "assistant", "tool", None]), rng.choice(["a.", "b?", "c", " ", None, f"d{t}.", f"e{t}"]))
        for c in range(60) for t in range(rng.randrange(1, 14))
    ]
    rows += [(1000, t, rng.choice(["user", "assistant", "system"]), f"t{t}" + rng.choice(["", ".", "!"])) for t in range(120)]
    assert result(spark, rows, tmp_path) == repaired(rows)


def test_weights_order_as_cost_and_letters():
    """The least integer is the least (cost, audit), for conversations cut or whole."""
    rng = random.Random(11)
    for _ in range(300):
        rows = [(rng.choice("suat"), rng.random() < 0.2, rng.random() < 0.3) for _ in range(rng.randrange(1, 9))]
        weights = turn_repair.Weights(3 * len(rows) + 2)
        least = weights.end()
        for row in reversed(rows):
            least = weights.row(least, *row)
        assert (least[0] >> weights.low, weights.letters(least[0])) == cheapest(rows)
