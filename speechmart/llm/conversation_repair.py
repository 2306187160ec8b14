"""Repair of turn structure by weighted finite-state composition.

Three automata describe a repair. The input acceptor reads a conversation's rows in order. The edit
transducer keeps a row (K, cost 0), deletes it (D, 2), gives it the role user or assistant (R, 1) or
inserts an empty turn (I, 5); rows with a blank text or a copy of an earlier row must be deleted, and
rows whose text breaks off cost 5 more unless deleted. The grammar acceptor accepts role initials of
the form ``(s?(ua)+)?``. Their composition is made lazily, one kind of row at a time and only when such
a row occurs, and the shortest path through it in row order is taken over weights (cost, label string)
that compare lexicographically.

Inserted turns stand right before the row that is kept next, or at the end. Label strings that read the
same rows then all end in the label of a row, so none is a proper prefix of another, and the order of
two strings stays the same whatever is appended. The weights so form a semiring, and a long
conversation may be cut anywhere: each block of at most ``BLOCK`` rows gives one matrix of weights from
grammar state to grammar state, and the matrices are chained by their costs and the rank of their label
strings alone. No task holds a conversation's rows; the chain holds four bytes a block. Only the digest
of a repaired conversation reads its rows in one task, as a stream, since a digest is one sequential
fold; and a conversation's label string is one value of one row.

Nulls: a null role or text counts as one space, and a null turn comes first; rows with a null id are one
conversation. Rows with equal turns are ordered by the digest of role and text, so equal rows stand side
by side. Empty texts are blank; texts are read whole. An empty table gives an empty result; columns
other than the four named are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from speechmart.operators.ranking import positions

from .common import materialize, pick

BLOCK = 256
KEEP, REROLE, DELETE, INSERT, BROKEN = 0, 1, 2, 5, 5
#: Grammar states: nothing yet, after s, after u, after a; the moves by role initial; the accepting ones.
START, AFTER_S, AFTER_U, AFTER_A = range(4)
MOVES = {(START, "s"): AFTER_S, (START, "u"): AFTER_U, (AFTER_S, "u"): AFTER_U, (AFTER_U, "a"): AFTER_A, (AFTER_A, "u"): AFTER_U}
ACCEPTING = (START, AFTER_A)
LEGAL = ("su", "ua", "au")
WHITE = " \t\n\x0b\x0c\r"
_NEVER = 1 << 60
#: A row's kind is its role initial (x: none of the grammar's) in lower case, upper case for a broken-off text, or, for rows that must go, moved by this table.
_GONE = str.maketrans("suax", "1234")
_INITIAL = str.maketrans("SUAX1234", "suaxsuax")

Weight = tuple[int, str]


def _insertions() -> dict[int, dict[int, Weight]]:
    """From every state, the states that inserted turns alone lead to, with the cheapest weights."""
    out: dict[int, dict[int, Weight]] = {}
    for start in range(4):
        best: dict[int, Weight] = {start: (0, "")}
        edge = [start]
        while edge:
            at = edge.pop()
            for initial in "ua":
                to = MOVES.get((at, initial))
                weight = best[at][0] + INSERT, best[at][1] + "I"
                if to is not None and weight < best.get(to, (_NEVER, "")):
                    best[to] = weight
                    edge.append(to)
        out[start] = best
    return out


INSERTIONS = _insertions()
#: The weight of ending in a state.
CLOSING = [min(w for to, w in INSERTIONS[s].items() if to in ACCEPTING) for s in range(4)]


@lru_cache(maxsize=None)  # twelve kinds
def arcs(kind: str) -> tuple[tuple[int, int, int, str], ...]:
    """Arcs (from, to, cost, labels) that read one row of this kind: inserted turns, then the row's edit."""
    initial = kind.translate(_INITIAL)
    more = BROKEN if kind in "SUAX" else 0
    best: dict[tuple[int, int], Weight] = {}
    for start, reached in INSERTIONS.items():
        for at, (cost, labels) in reached.items():
            edits = [(at, DELETE, "D")]
            if kind not in "1234":
                edits += [(MOVES.get((at, initial)), KEEP + more, "K"), *[(MOVES.get((at, x)), REROLE + more, "R") for x in "ua"]]
            for to, price, label in edits:
                if to is not None:
                    best[start, to] = min(best.get((start, to), (_NEVER, "")), (cost + price, labels + label))
    return tuple((a, b, cost, labels) for (a, b), (cost, labels) in best.items())


@lru_cache(maxsize=2048)
def block_weights(kinds: str, first: bool) -> tuple[tuple[Weight | None, ...], ...]:
    """Cheapest weight from each grammar state to each over one block; from the start alone for a first block."""
    out: list[tuple[Weight | None, ...]] = []
    for start in range(1 if first else 4):
        now: list[Weight | None] = [None] * 4
        now[start] = (0, "")
        for kind in kinds:
            then: list[Weight | None] = [None] * 4
            for a, b, cost, labels in arcs(kind):
                if (w := now[a]) is not None:
                    new = w[0] + cost, w[1] + labels
                    if then[b] is None or new < then[b]:
                        then[b] = new
            now = then
        out.append(tuple(now))
    return tuple(out)


def _illegal(initials: str) -> int:
    return sum(initials[i : i + 2] not in LEGAL for i in range(len(initials) - 1))


def _summaries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per block: its 16 costs, the ranks of its label strings, and what its neighbours must know."""
    for pdf in batches:
        rows = []
        for key, block, kinds in zip(pdf["_c"], pdf["block"], pdf["kinds"], strict=True):
            flat = [w for row in block_weights(kinds, block == 0) for w in row]
            flat += [None] * (16 - len(flat))
            order = {s: n for n, s in enumerate(sorted({w[1] for w in flat if w}))}
            initials = kinds.translate(_INITIAL)
            rows.append((key, block, [w[0] if w else _NEVER for w in flat], [order[w[1]] if w else 0 for w in flat], initials[0], initials[-1], _illegal(initials)))
        yield pd.DataFrame(rows, columns=["_c", "block", "costs", "ranks", "head", "tail", "illegal"])


class _Chain:
    """The shortest path through one conversation's blocks, from their costs and ranks."""

    def __init__(self, key: str) -> None:
        self.key = key
        self.cost, self.order = [0, _NEVER, _NEVER, _NEVER], [0, 0, 0, 0]
        self.came = bytearray()
        self.tail = ""
        self.illegal = 0

    def add(self, costs: np.ndarray, ranks: np.ndarray, head: str, tail: str) -> None:
        cost, order, came = [_NEVER] * 4, [(0, 0)] * 4, [0] * 4
        for to in range(4):
            ways = [(self.cost[a] + int(costs[4 * a + to]), self.order[a], int(ranks[4 * a + to]), a) for a in range(4) if self.cost[a] < _NEVER and costs[4 * a + to] < _NEVER]
            if ways:
                best = min(ways)
                cost[to], order[to], came[to] = best[0], best[1:3], best[3]
        places = {o: n for n, o in enumerate(sorted(set(order)))}
        self.cost, self.order = cost, [places[o] for o in order]
        self.came += bytes(came)
        self.illegal += bool(self.tail) and self.tail + head not in LEGAL
        self.tail = tail

    def rows(self) -> Iterator[tuple]:
        """(key, block, from, to, cost of all, illegal between blocks); the last two on the last block's row alone."""
        total, _, _, state = min((self.cost[s] + CLOSING[s][0], self.order[s], CLOSING[s][1], s) for s in range(4) if self.cost[s] < _NEVER)
        last = len(self.came) // 4 - 1
        for block in range(last, -1, -1):
            before = self.came[4 * block + state]
            yield self.key, block, before, state, total if block == last else 0, self.illegal if block == last else 0, block == last
            state = before


def _chained(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Chains the blocks of each conversation, which come in order; one conversation is open at a time."""
    columns = ["_c", "block", "start", "stop", "cost", "between", "last"]
    chain: _Chain | None = None
    out: list[tuple] = []
    for pdf in batches:
        for key, costs, ranks, head, tail in zip(pdf["_c"], pdf["costs"], pdf["ranks"], pdf["head"], pdf["tail"], strict=True):
            if chain is None or chain.key != key:
                if chain is not None:
                    out.extend(chain.rows())
                chain = _Chain(key)
            chain.add(costs, ranks, head, tail)
            if len(out) >= 10_000:
                yield pd.DataFrame(out, columns=columns)
                out = []
    if chain is not None:
        out.extend(chain.rows())
    for at in range(0, len(out), 10_000):
        yield pd.DataFrame(out[at : at + 10_000], columns=columns)


def _labels(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The label string of each block's part of the path."""
    for pdf in batches:
        pdf["labels"] = [
            block_weights(kinds, block == 0)[a][b][1] + (CLOSING[b][1] if last else "")
            for kinds, block, a, b, last in zip(pdf["kinds"], pdf["block"], pdf["start"], pdf["stop"], pdf["last"], strict=True)
        ]
        yield pdf[["_c", "block", "labels", "cost", "between"]]


def _key(column: Column) -> Column:
    """A text that no two ids share; null has one of its own."""
    return F.coalesce(F.concat(F.lit("="), column.cast("string")), F.lit("-"))


def _turns(rows: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """Key, turn, role, text without nulls in the last two, and the digest that orders equal turns."""
    r = pick(rows, [id_col, turn_col, role_col, text_col]).toDF("_i", "_t", "_r", "_x")
    r = r.select(_key(F.col("_i")).alias("_c"), F.col("_t").alias("turn"), F.coalesce("_r", F.lit(" ")).alias("role"), F.coalesce("_x", F.lit(" ")).alias("text"))
    return r.withColumn("mark", F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)))


def damage(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The rows with planted faults, chosen by the crc32 of ``id:turn`` modulo 20.

    0 drops the row, 1 empties its text, 2 takes ``.``, ``!`` and ``?`` out of it, 3 repeats the row, 4
    sets the role to user. Nulls count as one space in the digest, the role and the text.
    """
    r = pick(rows, [id_col, turn_col, role_col, text_col])
    name = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" ")) for c in (id_col, turn_col)]
    text, role = F.coalesce(F.col(f"`{text_col}`"), F.lit(" ")), F.coalesce(F.col(f"`{role_col}`"), F.lit(" "))
    fate = F.crc32(F.concat(name[0], F.lit(":"), name[1]).cast("binary")) % 20
    return (
        r.withColumn("_fate", fate)
        .filter("_fate <> 0")
        .select(
            F.col(f"`{id_col}`"),
            F.col(f"`{turn_col}`"),
            F.when(F.col("_fate") == 4, "user").otherwise(role).alias(role_col),
            F.when(F.col("_fate") == 1, "").when(F.col("_fate") == 2, F.translate(text, ".!?", "")).otherwise(text).alias(text_col),
            F.explode(F.array_repeat(F.lit(0), F.when(F.col("_fate") == 3, 2).otherwise(1))).alias("_copy"),
        )
        .drop("_copy")
    )


def _report(turns: DataFrame) -> DataFrame:
    """One row per key: the counts of faults, the cost and the label string."""
    bare = F.rtrim("text", F.lit(WHITE))
    initial = F.substring("role", 1, 1)
    narrow = turns.select(
        "_c", "turn", "mark",
        F.when(initial.isin("s", "u", "a"), initial).otherwise("x").alias("initial"),
        (bare == "").alias("empty"),
        (~F.substring(bare, -1, 1).isin(".", "!", "?")).alias("open"),
    )
    placed = materialize(positions(narrow, ["_c"], ["turn", "mark"], "pos"), "repair-rows")
    copies = placed.groupBy("_c", "mark").agg(F.min("pos").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    judged = placed.join(copies, ["_c", "mark"], "left").withColumn(
        "fault", F.when(F.col("empty"), "blank").when(F.col("pos") > F.col("first"), "duplicate").when(F.col("open"), "truncated").otherwise("")
    )
    kind = F.when(F.col("fault").isin("blank", "duplicate"), F.translate("initial", "suax", "1234")).when(F.col("fault") == "truncated", F.upper("initial")).otherwise(F.col("initial"))
    parts = judged.withColumn("block", F.floor(F.col("pos") / BLOCK).cast("long")).groupBy("_c", "block")
    counts = [F.count_if(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")]
    blocks = materialize(
        parts.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", kind.alias("k")))), lambda x: x["k"]), "").alias("kinds"), *counts), "repair-blocks"
    )
    summaries = blocks.select("_c", "block", "kinds").mapInPandas(_summaries, "_c string, block long, costs array<long>, ranks array<int>, head string, tail string, illegal long")
    summaries = materialize(summaries, "repair-weights")
    along = summaries.repartition("_c").sortWithinPartitions("_c", "block")
    path = along.mapInPandas(_chained, "_c string, block long, start int, stop int, cost long, between long, last boolean")
    labelled = path.join(blocks.select("_c", "block", "kinds"), ["_c", "block"]).mapInPandas(_labels, "_c string, block long, labels string, cost long, between long")
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "labels"))), lambda x: x["labels"]), "")
    audits = labelled.groupBy("_c").agg(whole.alias("audit"), F.sum("cost").alias("cost"), F.sum("between").alias("between"))
    inner = summaries.groupBy("_c").agg(F.sum("illegal").alias("inner"))
    faults = blocks.groupBy("_c").agg(*[F.sum(f).alias(f) for f in ("blank", "duplicate", "truncated")])
    spans = placed.groupBy("_c").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn"), F.lit(0)).cast("long").alias("gaps"))
    return faults.join(spans, "_c").join(inner, "_c").join(audits, "_c").withColumn("illegal", F.col("inner") + F.col("between")).drop("inner", "between")


def _mended(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[str, str, str, str]]:
    """(key, label, role, text) of every turn that stays or is new; rows come by conversation, after its label string."""
    key, labels, at, state = None, "", 0, START

    def inserted() -> Iterator[tuple[str, str, str, str]]:
        nonlocal at, state
        while at < len(labels) and labels[at] == "I":
            role = "assistant" if state == AFTER_U else "user"
            at, state = at + 1, MOVES[state, role[0]]
            yield key, "I", role, ""

    for pdf in batches:
        for c, audit, role, text in zip(pdf["_c"], pdf["audit"], pdf["role"], pdf["text"], strict=True):
            if audit is not None:
                key, labels, at, state = c, audit, 0, START
                yield from inserted()  # before the first row
                continue
            label, at = labels[at], at + 1
            if label != "D":
                if label == "R":
                    role = "assistant" if state == AFTER_U else "user"
                state = MOVES[state, role[0]]
                yield key, label, role, text
            yield from inserted()  # before the next row, or at the end


def _streams(turns: DataFrame, report: DataFrame) -> DataFrame:
    """Rows of a conversation in order behind its label string, whole conversations to a partition."""
    nothing = [F.lit(None).cast(t).alias(c) for c, t in (("role", "string"), ("text", "string"), ("mark", "binary"))]
    heads = report.select("_c", "audit", F.lit(None).cast(turns.schema["turn"].dataType).alias("turn"), *nothing)
    rows = turns.select("_c", F.lit(None).cast("string").alias("audit"), "turn", "role", "text", "mark")
    joined = heads.unionByName(rows).repartition("_c").sortWithinPartitions("_c", F.col("audit").isNull(), F.col("turn").asc_nulls_first(), "mark")
    return joined.select("_c", "audit", "role", "text")


def _rows_out(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    last, place, out = None, 0, []
    for key, label, role, text in _mended(batches):
        last, place = key, place + 1 if key == last else 0
        out.append((key, place, label, role, text))
        if len(out) == 1000:
            yield pd.DataFrame(out, columns=["_c", "place", "edit", "role", "text"])
            out = []
    if out:
        yield pd.DataFrame(out, columns=["_c", "place", "edit", "role", "text"])


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The digest of ``role:text`` lines of every conversation with a turn, text by text."""
    key, fold, out = None, None, []
    for c, _, role, text in _mended(batches):
        if c != key:
            if fold is not None:
                out.append((key, fold.hexdigest()))
            key, fold = c, hashlib.sha256()
        else:
            fold.update(b"\n")
        fold.update(f"{role}:{text}".encode())
        if len(out) == 10_000:
            yield pd.DataFrame(out, columns=["_c", "repaired_sha256"])
            out = []
    if fold is not None:
        out.append((key, fold.hexdigest()))
    if out:
        yield pd.DataFrame(out, columns=["_c", "repaired_sha256"])


def repaired_turns(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """id (as text, null for null), place (from 0), edit (K, R or I), role and text of the repaired conversations."""
    turns = _turns(rows, id_col, turn_col, role_col, text_col)
    out = _streams(turns, _report(turns)).mapInPandas(_rows_out, "_c string, place long, edit string, role string, text string")
    return out.select(F.when(F.col("_c") != "-", F.expr("substring(_c, 2)")).alias(id_col), "place", "edit", "role", "text")


def audit_conversations(rows: DataFrame, ids: DataFrame | None = None, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Faults, cheapest repair and the repaired conversation's digest for every id of ``ids`` (by default of ``rows``).

    An id without rows has zeros, an empty label string and the digest of nothing.
    """
    turns = _turns(rows, id_col, turn_col, role_col, text_col)
    report = materialize(_report(turns), "repair-report")
    digests = _streams(turns, report).mapInPandas(_digests, "_c string, repaired_sha256 string")
    known = pick(rows if ids is None else ids, [id_col]).distinct().withColumn("_c", _key(F.col(f"`{id_col}`")))
    out = known.join(report, "_c", "left").join(digests, "_c", "left")
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return out.select(
        F.col(f"`{id_col}`"),
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in numbers],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )
