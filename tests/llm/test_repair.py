"""Conversation repair against an exhaustive search over edits, and its odd cases."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from speechmart.llm import conversation_repair as C
from speechmart.llm.queries import op13_composed_repair

SCHEMA = "conv_id long, turn long, role string, text string"
GRAMMAR = re.compile("(s?(ua)+)?")
EMPTY = hashlib.sha256(b"").hexdigest()


def faults_of(rows):
    out, seen = [], set()
    for _, role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def exhaustive(rows, faults, spare=2):
    """All ways to edit every row and to insert up to ``spare`` turns in a gap: the least (cost, labels) and its turns."""
    best = None
    kinds = [[("D", 2)] if f in ("blank", "duplicate") else [("D", 2), ("K", 5 * (f == "truncated")), ("U", 1 + 5 * (f == "truncated")), ("A", 1 + 5 * (f == "truncated"))] for f in faults]
    inserts = [x for n in range(spare + 1) for x in itertools.product("ua", repeat=n)]
    for edits in itertools.product(*kinds):
        for gaps in itertools.product(inserts, repeat=len(rows) + 1):
            cost = sum(c for _, c in edits) + 5 * sum(map(len, gaps))
            if best and cost > best[0]:
                continue
            labels, turns = "", []
            for n in range(len(rows) + 1):
                labels += "I" * len(gaps[n])
                turns += [({"u": "user", "a": "assistant"}[x], "") for x in gaps[n]]
                if n < len(rows):
                    e = edits[n][0]
                    labels += "R" if e in "UA" else e
                    if e != "D":
                        turns.append(({"K": rows[n][1], "U": "user", "A": "assistant"}[e], rows[n][2]))
            if GRAMMAR.fullmatch("".join(r[:1] or "?" for r, _ in turns)) and (best is None or (cost, labels) < best[:2]):
                best = cost, labels, turns
    return best


def by_paths(rows, faults):
    """The same by a plain search over suffixes, for longer conversations."""
    moves = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    after = {"": (0, "", []), "a": (0, "", []), "u": (5, "I", [("assistant", "")]), "s": (10, "II", [("user", ""), ("assistant", "")])}
    for (_, role, text), fault in reversed(list(zip(rows, faults, strict=True))):
        now = {}
        for state in ("", "s", "u", "a"):
            ways = [(2 + after[state][0], "D" + after[state][1], after[state][2])]
            if fault not in ("blank", "duplicate"):
                for label, cost, name in (("K", 0, role), ("R", 1, "user"), ("R", 1, "assistant")):
                    if (to := moves.get((state, name[:1]))) is not None:
                        ways.append((cost + 5 * (fault == "truncated") + after[to][0], label + after[to][1], [(name, text), *after[to][2]]))
            now[state] = min(ways, key=lambda w: w[:2])
        for _ in range(2):  # inserted turns before this row
            for state in now:
                for name in ("user", "assistant"):
                    if (to := moves.get((state, name[0]))) is not None:
                        way = (5 + now[to][0], "I" + now[to][1], [(name, ""), *now[to][2]])
                        now[state] = min(now[state], way, key=lambda w: w[:2])
        after = now
    return after[""]


def reference(rows):
    """The contract for one conversation's rows after damage, in order."""
    faults = faults_of(rows)
    cost, audit, turns = by_paths(rows, faults)
    known = [t for t, _, _ in rows if t is not None]
    initials = [r[:1] for _, r, _ in rows]
    return (
        max(known) - min(known) + 1 - len(set(known)) if known else 0,
        *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
        sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False)),
        cost,
        audit,
        hashlib.sha256("\n".join(f"{r}:{t}" for r, t in turns).encode()).hexdigest(),
    )


def ordered(rows):
    mark = lambda r: hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, mark(r)))


def damaged(rows):
    out = {}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        kept = out.setdefault(conv, [])
        if fate:
            row = (turn, "user" if fate == 4 else role, "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text)
            kept += [row] * (2 if fate == 3 else 1)
    return {k: ordered(v) for k, v in out.items()}


def collected(df):
    columns = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return {r["conv_id"]: tuple(r[c] for c in columns) for r in df.collect()}


def test_path_search_equals_all_edits():
    rng = random.Random(5)
    for n in (0, 1, 2, 3):
        for _ in range(12):
            rows = [(k, rng.choice(["user", "assistant", "system", "tool", ""]), rng.choice(["a.", "b!", "open", "", "c?"])) for k in range(n)]
            faults = faults_of(rows)
            assert exhaustive(rows, faults, 2 if n < 3 else 1)[:2] == by_paths(rows, faults)[:2]


def test_block_matrices_chain_to_the_whole():
    rng = random.Random(6)
    for _ in range(200):
        kinds = "".join(rng.choices("suaxSUAX1234", k=rng.randint(1, 12)))
        cut = sorted(rng.choices(range(len(kinds) + 1), k=2))
        parts = [p for p in (kinds[: cut[0]], kinds[cut[0] : cut[1]], kinds[cut[1] :]) if p]
        at = [(0, "")] + [None] * 3
        for n, part in enumerate(parts):
            m = C.block_weights(part, n == 0)
            at = [min(((at[a][0] + m[a][b][0], at[a][1] + m[a][b][1]) for a in range(len(m)) if at[a] and m[a][b]), default=None) for b in range(4)]
        assert tuple(at) == C.block_weights(kinds, True)[0]


@pytest.fixture(scope="module")
def odd_conversations():
    rng = random.Random(7)
    texts = ["Fine.", "Good!", "Really?", "open end", "", "  \t", None, "x" * 3000 + ".", "line.\n", "emoji 😀."]
    rows = [(c, t, rng.choice(["user", "assistant", "system", "tool", None, "", "unknown", "User"]), rng.choice(texts)) for c in range(60) for t in range(rng.randint(1, 7))]
    rows += [(100, None, "user", "No turn."), (100, None, "assistant", "None either."), (100, 3, "user", "Third."), (100, 3, "user", "Third."), (None, 1, "user", "No id."), (None, None, "user", "No id.")]
    rows += [(200, t, ["user", "assistant"][t % 2], f"Turn {t}" + rng.choice([".", ""])) for t in range(1500)]  # several blocks
    rows += [(300, 0, "user", "Same.")] * 40
    return rows


def test_query_equals_reference(spark, odd_conversations):
    df = spark.createDataFrame(odd_conversations, SCHEMA).repartition(3)
    got = collected(C.audit_conversations(C.damage(df), df))
    want = {}
    for conv, rows in damaged(odd_conversations).items():
        want[conv] = reference(rows) if rows else (0, 0, 0, 0, 0, 0, "", EMPTY)
    assert got == want


def test_registered_query_equals_reference(spark, tmp_path):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert collected(op13_composed_repair(spark, "/root/testdata/sf0.001")) == {c: reference(r) if r else (0, 0, 0, 0, 0, 0, "", EMPTY) for c, r in damaged(rows).items()}


def test_repaired_turns_follow_the_grammar(spark, odd_conversations):
    df = spark.createDataFrame(odd_conversations, SCHEMA)
    turns = C.repaired_turns(df).collect()
    by = {}
    for r in sorted(turns, key=lambda r: (str(r["conv_id"]), r["place"])):
        by.setdefault(r["conv_id"], []).append(r)
    assert all(GRAMMAR.fullmatch("".join(r["role"][0] for r in rows)) for rows in by.values())
    assert all([r["place"] for r in rows] == list(range(len(rows))) for rows in by.values())


def test_empty_table_and_clashing_columns(spark, odd_conversations):
    none = spark.createDataFrame([], SCHEMA)
    assert C.audit_conversations(C.damage(none), none).count() == 0
    df = spark.createDataFrame([(1, 0, "user", "Hi.")], SCHEMA)
    wide = df.withColumns({c: F.lit("x") for c in ("_c", "pos", "block", "kinds", "cost", "audit", "mark", "_fate", "_copy")})
    assert collected(C.audit_conversations(wide)) == collected(C.audit_conversations(df)) == {1: (0, 0, 0, 0, 0, 2, "D", EMPTY)}
