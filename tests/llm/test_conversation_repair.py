"""The repair of conversations against a plain search over whole edit strings, and on nulls, ties and empty tables."""

import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from speechlake.llm.conversation_repair import conversation_reports, repair_conversations

SCHEMA = "conv_id long, turn long, role string, text string"
BLANK = " \t\n\x0b\x0c\r"


def plain(rows):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, repaired lines) of one conversation."""
    rows = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, *r[1:]))
    seen, faults = set(), []
    for _, role, text in rows:
        body = text.rstrip(BLANK)
        faults.append(1 if not body else 2 if (role, text) in seen else 3 if body[-1] not in ".!?" else 0)
        seen.add((role, text))
    follow = {"": "u", "s": "u", "u": "a", "a": "u"}
    name = {"u": "user", "a": "assistant"}
    best = {"": (0, "", ())}  # by state: cost, audit, lines

    def better(table, state, way):
        if state not in table or way[:2] < table[state][:2]:
            table[state] = way
            return True
        return False

    # whole strings, from the front; a state's cheaper or smaller way replaces the other
    for (_, role, text), fault in zip(rows, faults, strict=True):
        best = inserted(best, follow, name, better)
        after = {}
        for state, (cost, audit, lines) in best.items():
            better(after, state, (cost + 4, audit + "D", lines))
            if fault in (0, 3):
                extra, to = 3 * (fault == 3), follow[state]
                if role[:1] == to or role[:1] == "s" and state == "":
                    better(after, role[:1], (cost + extra, audit + "K", (*lines, f"{role}:{text}")))
                better(after, to, (cost + 3 + extra, audit + "R", (*lines, f"{name[to]}:{text}")))
        best = after
    best = inserted(best, follow, name, better)
    cost, audit, lines = min((w for s, w in best.items() if s in ("", "a")), key=lambda w: w[:2])
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    return gaps, faults.count(1), faults.count(2), faults.count(3), illegal, cost, audit, lines


def inserted(best, follow, name, better):
    best = dict(best)
    for _ in range(3):
        for state, (cost, audit, lines) in [*best.items()]:
            better(best, follow[state], (cost + 3, audit + "I", (*lines, name[follow[state]] + ":")))
    return best


def odd_conversations(seed=5):
    rng = random.Random(seed)
    texts = ["yes.", "no", "maybe?", "", " \t", "so! ", "end.\n", "ü…", None]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", "unknown", None]
    rows = []
    for conv in [*range(60), None]:
        for i in range(rng.randint(1, 9)):
            rows.append((conv, rng.choice([i, i, i, i + 3, None]), rng.choice(roles), rng.choice(texts)))
    rows += [(500, i, rng.choice(roles), rng.choice(texts) if i % 3 else f"text {i}.") for i in range(3000)]  # many batches
    return rows + [rows[0], rows[0]]


@pytest.fixture(scope="module")
def messages(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "700")  # conversations cross batches
    df = spark.createDataFrame(odd_conversations(), SCHEMA).repartition(5)
    yield df.withColumns({c: F.lit(1) for c in ("initial", "fault", "edits", "_h", "_seen", "position")})
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def by_conversation():
    rows = defaultdict(list)
    for conv, *row in odd_conversations():
        rows[None if conv is None else str(conv)].append(row)
    return {c: plain(r) for c, r in rows.items()}


def test_reports(messages):
    got = conversation_reports(messages).collect()
    want = by_conversation()
    assert len(got) == len(want)
    for r in got:
        *counts, audit, lines = want[r.conv_id]
        assert (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit) == (*counts, audit)
        assert r.repaired_sha256 == hashlib.sha256("\n".join(lines).encode()).hexdigest()


def test_edits_are_those_of_the_reports(messages):
    found = defaultdict(list)
    for r in repair_conversations(messages).collect():
        found[r.conv_id].append(r)
    for conv, (*_, audit, lines) in by_conversation().items():
        rows = sorted(found[conv], key=lambda r: r.position)
        assert [r.position for r in rows] == [*range(len(rows))]
        assert "".join(r.edit for r in rows) == audit
        assert tuple(f"{r.role}:{r.text}" for r in rows if r.edit != "D") == lines
        assert all(r.edit == "D" for r in rows if r.fault in ("blank", "duplicate"))


def test_conversations_without_rows_and_empty_tables(spark):
    rows = [(1, 0, "user", "hi.", False), (1, 1, "assistant", "ho.", None), (2, 0, "user", "hi.", True), (2, 1, None, None, False)]
    got = {r.conv_id: r for r in conversation_reports(spark.createDataFrame(rows, SCHEMA + ", there boolean"), there="there").collect()}
    assert tuple(got["1"])[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert (got["2"].cost, got["2"].audit, got["2"].repaired_sha256) == (3, "KI", hashlib.sha256(b"user:hi.\nassistant:").hexdigest())
    nothing = spark.createDataFrame([], SCHEMA)
    assert conversation_reports(nothing).count() == 0 and repair_conversations(nothing).count() == 0
