"""Conversation structure repair by Four-Russians block tables.

A conversation is repaired by the cheapest edits that give its role initials
the form ``(s?(ua)+)?``. Read from the end, the cost to go of the four states
of that form is a vector; less its smallest number it is one of a few dozen.
So the step over every block of ``BLOCK`` row symbols is a table entry (vector
in, vector and cost out), and a conversation is a look-up per block. To give
the edits, each block is expanded backward from the vector at its end; then the
edits are read forward, and of equally cheap ones the ASCII-least is taken,
which the costs to go show at once.

Rows are dealt by a range of (conversation, turn), so the largest conversation
is spread like any other. Conversations that end inside of a task are done
there. The others are chunks: a chunk is a function on vectors and states
(again block look-ups), a conversation composes the functions of its chunks,
and every chunk is then traced on its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from trialbraid.llm.arrowtext import Local
from trialbraid.llm.shared import stored

#: Row symbols of a block; rows and characters of a chunk.
BLOCK = 4
CHUNK_ROWS = 4096
CHUNK_CHARS = 1 << 20

#: Costs of the edits, by the letter in the audit; a truncated row that stays costs more.
DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
#: States: nothing yet, after the system row, after a user row, after an assistant row (or nothing) .
_NEXT = (2, 2, 3, 2)
_KEEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
_END = (0, 2 * INSERT, INSERT, 0)
_ROLE_OF = {2: "user", 3: "assistant"}
#: Marks of rows: blank, repeated, or the role class (other: o), in capitals where truncated.
_MARKS = "bdsuaoSUAO"
_SYMBOL = {"b": 0, "d": 0} | {m: i for i, m in enumerate("suaoSUAO", 1)}
_N = 9
_SPACE = " \t\n\x0b\x0c\r"


def _moves(symbol: int, after: tuple, state: int) -> list[tuple[str, int, int]]:
    """(letter, cost to go, state) of the edits that take a row, letters ascending."""
    moves = [("D", DELETE + after[state], state)]
    if symbol:
        role, extra = "suao"[(symbol - 1) % 4], TRUNCATED * (symbol > 4)
        kept = _KEEP.get((state, role))
        if kept is not None:
            moves.append(("K", extra + after[kept], kept))
        moves.append(("R", REROLE + extra + after[_NEXT[state]], _NEXT[state]))
    return moves


def _step(symbol: int, after: tuple) -> tuple:
    """Costs to go before a row."""
    best = [min(cost for _, cost, _ in _moves(symbol, after, q)) for q in range(4)]
    for _ in range(3):
        best = [min(best[q], INSERT + best[_NEXT[q]]) for q in range(4)]
    return tuple(best)


def _taken(symbol: int, after: tuple, state: int) -> tuple[str, int]:
    """Letters up to and with the one that takes the row, and the state behind it."""
    own, letters = _step(symbol, after), ""
    while True:
        options = _moves(symbol, after, state)
        options.append(("I", INSERT + own[_NEXT[state]], _NEXT[state]))
        letter, _, to = min(o for o in options if o[1] == own[state])
        letters, state = letters + letter, to
        if letter != "I":
            return letters, state


class Tables:
    """All normalised vectors, the steps over one row and over every block of rows."""

    def __init__(self):
        known = {_END: 0}
        self.vectors, steps = [_END], []
        for vector in self.vectors:
            row = []
            for symbol in range(_N):
                raw = _step(symbol, vector)
                low = min(raw)
                to = tuple(x - low for x in raw)
                if to not in known:
                    known[to] = len(self.vectors)
                    self.vectors.append(to)
                row.append((known[to], low))
            steps.append(row)
        n = len(self.vectors)
        self.step_to = np.array([[to for to, _ in row] for row in steps])
        self.step_cost = np.array([[cost for _, cost in row] for row in steps])
        self.taken = [
            [[_taken(s, v, q) for q in range(4)] for s in range(_N)] for v in self.vectors
        ]
        step_exit = np.array([[[q for _, q in row] for row in sy] for sy in self.taken])
        # Longer blocks: first symbol, then the block behind it.
        to, cost, leave = self.step_to, self.step_cost, step_exit
        for _ in range(BLOCK - 1):
            first = np.arange(_N)[None, :, None]
            behind = to[:, None, :]
            size = to.shape[1] * _N
            cost = (cost[:, None, :] + self.step_cost[behind, first]).reshape(n, size)
            via = step_exit[behind, first]
            rest = np.arange(to.shape[1])[None, None, :, None]
            leave = leave[np.arange(n)[:, None, None, None], rest, via].reshape(n, size, 4)
            to = self.step_to[behind, first].reshape(n, size)
        self.block_to, self.block_cost, self.block_exit = to, cost, leave
        self.traced: dict[tuple, tuple[str, int]] = {}

    def blocks(self, symbols: np.ndarray) -> tuple[list[int], list[int]]:
        """Codes of the whole blocks, and the symbols behind them."""
        whole = len(symbols) // BLOCK * BLOCK
        weights = _N ** np.arange(BLOCK - 1, -1, -1)
        return (symbols[:whole].reshape(-1, BLOCK) @ weights).tolist(), symbols[whole:].tolist()

    def forward(self, symbols: list[int], vector: int, state: int) -> tuple[str, int]:
        """The edits of a few rows: their vectors backward, then the letters forward."""
        behind = []
        for symbol in reversed(symbols):
            behind.append(vector)
            vector = int(self.step_to[vector, symbol])
        out = ""
        for symbol, after in zip(symbols, reversed(behind)):
            letters, state = self.taken[after][symbol][state]
            out += letters
        return out, state

    def trace(self, symbols: np.ndarray, vector: int, state: int) -> tuple[str, int, int, int]:
        """(letters, state behind, vector before, cost) of rows whose end has ``vector``."""
        codes, tail = self.blocks(symbols)
        cost, end = 0, vector
        for symbol in reversed(tail):
            cost += int(self.step_cost[vector, symbol])
            vector = int(self.step_to[vector, symbol])
        at_tail, behind = end, []
        for code in reversed(codes):
            behind.append(vector)
            cost += int(self.block_cost[vector, code])
            vector = int(self.block_to[vector, code])
        out = []
        for code, after in zip(codes, reversed(behind)):
            key = (after, code, state)
            if key not in self.traced:
                rows = [code // _N**i % _N for i in range(BLOCK - 1, -1, -1)]
                self.traced[key] = self.forward(rows, after, state)
            letters, state = self.traced[key]
            out.append(letters)
        letters, state = self.forward(tail, at_tail, state)
        return "".join([*out, letters]), state, vector, cost

    def function(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of rows, for every vector at their end: vector before, cost, state behind by state."""
        codes, tail = self.blocks(symbols)
        v = np.arange(len(self.vectors))
        cost, tail_at = np.zeros(len(v), np.int64), []
        for symbol in reversed(tail):
            tail_at.append(v)
            cost, v = cost + self.step_cost[v, symbol], self.step_to[v, symbol]
        block_at = []
        for code in reversed(codes):
            block_at.append(v)
            cost, v = cost + self.block_cost[v, code], self.block_to[v, code]
        state = np.tile(np.arange(4), (len(v), 1))
        for code, after in zip(codes, reversed(block_at)):
            state = np.take_along_axis(self.block_exit[after, code], state, 1)
        for symbol, after in zip(tail, reversed(tail_at)):
            leave = np.array([[self.taken[a][symbol][q][1] for q in range(4)] for a in after])
            state = np.take_along_axis(leave, state, 1)
        return v, cost, state


_tables = Local()


def tables() -> Tables:
    """The tables, built once per process."""
    if "all" not in _tables:
        _tables["all"] = Tables()
    return _tables["all"]


def finish(state: int) -> str:
    """Inserted rows behind the last one."""
    return "I" * (_END[state] // INSERT)


def mark_rows(roles: list[str], texts: list[str]) -> str:
    """One mark per row; a row is repeated if its role and text stand earlier in the lists."""
    seen, out = set(), []
    for role, text in zip(roles, texts):
        full = text.strip(_SPACE)
        if not full:
            out.append("b")
        elif (role, text) in seen:
            out.append("d")
        else:
            seen.add((role, text))
            known = role[:1] if role[:1] in ("s", "u", "a") else "o"
            out.append(known if full[-1] in ".!?" else known.upper())
    return "".join(out)


def _symbols(marks: str) -> np.ndarray:
    return np.array([_SYMBOL[m] for m in marks], np.int64)


def edited(audit: str, roles: list[str], texts: list[str], state: int) -> list[tuple[str, str]]:
    """(role, text) of the rows after the edits of ``audit``, from ``state`` on."""
    rows, out = iter(zip(roles, texts)), []
    for letter in audit:
        if letter == "I":
            state = _NEXT[state]
            out.append((_ROLE_OF[state], ""))
            continue
        role, text = next(rows)
        if letter == "R":
            state = _NEXT[state]
            out.append((_ROLE_OF[state], text))
        elif letter == "K":
            state = _KEEP[state, role[:1]]
            out.append((role, text))
    return out


def _illegal(roles: list[str]) -> int:
    return sum(a[:1] + b[:1] not in ("su", "ua", "au") for a, b in zip(roles, roles[1:]))


def _counts(marks: str) -> tuple[int, int, int]:
    return marks.count("b"), marks.count("d"), sum(marks.count(m) for m in "SUAO")


_RESULT = (
    "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, "
    "audit string, repaired_sha256 string, repaired array<struct<role: string, text: string>>"
)
_CHUNK = (
    "whole boolean, pid int, k int, first_turn bigint, last_turn bigint, n_turns bigint, "
    "roles array<string>, texts array<string>, marks string"
)


def _batches(rows: Iterator[dict], schema: pa.Schema, size: int = 2000, chars: int = 8 << 20):
    part, held = [], 0
    for row in rows:
        part.append(row)
        held += sum(map(len, row.get("texts") or ())) + len(row.get("text") or "")
        if len(part) >= size or held >= chars:
            yield pa.RecordBatch.from_pylist(part, schema)
            part, held = [], 0
    yield pa.RecordBatch.from_pylist(part, schema)


class _Chunk:
    """Rows of one conversation, in order, as far as they have come."""

    def __init__(self, conv, k: int, first: bool):
        self.conv, self.k, self.first = conv, k, first
        self.roles, self.texts, self.chars = [], [], 0
        self.turns, self.first_turn, self.last_turn = 0, None, None

    def add(self, turn, role: str, text: str) -> None:
        self.roles.append(role)
        self.texts.append(text)
        self.chars += len(text)
        if turn is not None:
            if self.first_turn is None:
                self.first_turn = turn
            self.turns += turn != self.last_turn
            self.last_turn = turn

    def full(self) -> bool:
        return len(self.roles) >= CHUNK_ROWS or self.chars >= CHUNK_CHARS

    def result(self, with_rows: bool) -> dict:
        marks = mark_rows(self.roles, self.texts)
        audit, state, vector, cost = tables().trace(_symbols(marks), 0, 0)
        audit += finish(state)
        rows = edited(audit, self.roles, self.texts, 0)
        blank, duplicate, truncated = _counts(marks)
        text = "\n".join(f"{role}:{text}" for role, text in rows)
        span = self.last_turn - self.first_turn + 1 - self.turns if self.turns else 0
        return {
            "conv_id": self.conv, "whole": True, "gaps": span, "blank": blank,
            "duplicate": duplicate, "truncated": truncated, "illegal": _illegal(self.roles),
            "cost": cost + tables().vectors[vector][0], "audit": audit,
            "repaired_sha256": hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest(),
            "repaired": [{"role": r, "text": t} for r, t in rows] if with_rows else None,
        }

    def part(self, pid: int) -> dict:
        return {
            "conv_id": self.conv, "whole": False, "pid": pid, "k": self.k,
            "first_turn": self.first_turn, "last_turn": self.last_turn, "n_turns": self.turns,
            "roles": self.roles, "texts": self.texts, "marks": mark_rows(self.roles, self.texts),
        }


def _read(batches: Iterator[pa.RecordBatch], with_rows: bool) -> Iterator[dict]:
    """Results of conversations that lie inside of this task, and chunks of the others."""
    pid, chunk, first = TaskContext.get().partitionId(), None, True
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "absent")]
        for conv, turn, role, text, absent in zip(*columns):
            if chunk is None or conv != chunk.conv:
                if chunk is not None:
                    # The first conversation of a task may have begun in an earlier one.
                    inside = not chunk.first and not chunk.k
                    yield chunk.result(with_rows) if inside else chunk.part(pid)
                    first = False
                chunk = _Chunk(conv, 0, first)
            elif chunk.full():
                yield chunk.part(pid)
                chunk = _Chunk(conv, chunk.k + 1, chunk.first)
            if not absent:
                chunk.add(turn, role, text)
    if chunk is not None:
        yield chunk.part(pid)


def _across_chunks(parts: DataFrame) -> DataFrame:
    """The chunks with the marks of rows that an earlier chunk of the conversation holds."""
    rows = parts.selectExpr("conv_id", "pid", "k", "marks", "posexplode(arrays_zip(roles, texts)) AS (i, r)")
    rows = rows.where("substring(marks, i + 1, 1) NOT IN ('b', 'd')").selectExpr(
        "conv_id", "struct(pid, k) AS at", "i",
        "md5(concat(length(r.roles), ':', r.roles, r.texts)) AS row",
    )
    first = rows.groupBy("conv_id", "row").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    first = first.where("n > 1").alias("f")
    same = F.col("r.conv_id").eqNullSafe(F.col("f.conv_id")) & (F.col("r.row") == F.col("f.row"))
    later = rows.alias("r").join(first, same).where("at != first")
    later = later.groupBy("r.conv_id", "at").agg(F.collect_set("i").alias("again")).alias("l")
    at = F.col("p.conv_id").eqNullSafe(F.col("l.conv_id")) & (F.struct("p.pid", "p.k") == F.col("l.at"))
    marks = (
        "if(again IS NULL, marks, array_join(transform(regexp_extract_all(marks, '.', 0), "
        "(m, i) -> if(array_contains(again, i), 'd', m)), ''))"
    )
    return parts.alias("p").join(later, at, "left").selectExpr(
        "p.conv_id", "pid", "k", "first_turn", "last_turn", "n_turns", "roles", "texts", f"{marks} AS marks"
    )


_SUMMARY = (
    "pid int, k int, first_turn bigint, last_turn bigint, n_turns bigint, n bigint, blank bigint, "
    "duplicate bigint, truncated bigint, illegal bigint, first_role string, last_role string, "
    "`to` array<int>, costs array<bigint>, `exits` array<int>"
)


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for row in batch.to_pylist():
            to, costs, leave = tables().function(_symbols(row["marks"]))
            blank, duplicate, truncated = _counts(row["marks"])
            roles = row.pop("roles")
            yield row | {
                "n": len(roles), "blank": blank, "duplicate": duplicate, "truncated": truncated,
                "illegal": _illegal(roles), "first_role": roles[0][:1] if roles else None,
                "last_role": roles[-1][:1] if roles else None, "to": to.tolist(),
                "costs": costs.tolist(), "exits": leave.ravel().tolist(),
            }


_PLACE = (
    "pid int, k int, vector int, state int, last boolean, gaps bigint, blank bigint, "
    "duplicate bigint, truncated bigint, illegal bigint, cost bigint"
)


def _compose(chunks: pd.DataFrame) -> pd.DataFrame:
    """Vector at the end and state at the start of every chunk of one conversation, and its totals.

    A conversation has at most 2**31 edits, as its audit is one text; these
    are half a million chunks of a few hundred bytes here.
    """
    chunks = chunks.sort_values(["pid", "k"], ignore_index=True)
    vector, cost, at_end = 0, 0, []
    for to, costs in zip(chunks["to"][::-1], chunks["costs"][::-1]):
        at_end.append(vector)
        cost, vector = cost + int(costs[vector]), int(to[vector])
    at_end.reverse()
    state, at_start = 0, []
    for v, leave in zip(at_end, chunks["exits"]):
        at_start.append(state)
        state = int(leave[4 * v + state])
    some = chunks[chunks["n"] > 0]
    pairs = zip(some["last_role"][:-1], some["first_role"][1:])
    illegal = int(chunks["illegal"].sum()) + sum(a + b not in ("su", "ua", "au") for a, b in pairs)
    told = chunks[chunks["n_turns"] > 0]
    shared = sum(a == b for a, b in zip(told["last_turn"][:-1], told["first_turn"][1:]))
    gaps = 0
    if len(told):
        span = int(told["last_turn"].iloc[-1]) - int(told["first_turn"].iloc[0])
        gaps = span + 1 - (int(told["n_turns"].sum()) - shared)
    out = chunks[["conv_id", "pid", "k"]].copy()
    out["vector"], out["state"] = at_end, at_start
    out["last"] = [False] * (len(out) - 1) + [True]
    out["gaps"], out["illegal"] = gaps, illegal
    for name in ("blank", "duplicate", "truncated"):
        out[name] = int(chunks[name].sum())
    out["cost"] = cost + tables().vectors[vector][0]
    return out


def _traced(batches: Iterator[pa.RecordBatch], with_rows: bool) -> Iterator[dict]:
    """Edits and repaired text of every chunk."""
    for batch in batches:
        for row in batch.to_pylist():
            roles, texts = row.pop("roles"), row.pop("texts")
            audit, state, _, _ = tables().trace(_symbols(row.pop("marks")), row.pop("vector"), row["state"])
            audit += finish(state) if row["last"] else ""
            rows = edited(audit, roles, texts, row.pop("state"))
            yield row | {
                "audit": audit,
                "text": "\n".join(f"{r}:{t}" for r, t in rows),
                "n_rows": len(rows),
                "repaired": [{"role": r, "text": t} for r, t in rows] if with_rows else None,
            }


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """One result per conversation from its traced chunks in order; the digest is a chain over them."""
    audit, rows, digest, begun = [], [], hashlib.sha256(), False
    for batch in batches:
        for row in batch.to_pylist():
            audit.append(row["audit"])
            rows += row["repaired"] or []
            if row["n_rows"]:
                text = ("\n" if begun else "") + row["text"]
                digest.update(text.encode("utf-8", "surrogatepass"))
                begun = True
            if row["last"]:
                names = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost")
                yield {c: row[c] for c in names} | {
                    "audit": "".join(audit),
                    "repaired_sha256": digest.hexdigest(),
                    "repaired": rows if row["repaired"] is not None else None,
                }
                audit, rows, digest, begun = [], [], hashlib.sha256(), False


def repair(conversations: DataFrame, with_rows: bool = False) -> DataFrame:
    """Faults, cheapest repair and repaired rows of every conversation.

    ``conversations``: conv_id, turn (an integer), role, text and, if given, a
    boolean ``absent`` for rows that only tell that their conversation exists.
    Returns conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256 (of the repaired ``role:text`` joined by line breaks) and
    repaired (role and text of the rows, null unless ``with_rows``).

    A null role or text counts as one space, so such a text is blank and such
    a role is never kept. Rows stand by turn, null turns first; rows of one turn
    by role and then by a hash of the text, so repeated rows are neighbours.
    All rows with a null conv_id are one conversation. A conversation without
    rows has zeros, an empty audit and the digest of the empty text. Other
    columns are not read.

    All work is split by rows but for two things: the functions of the chunks
    of one conversation are composed in one task (a few hundred bytes for
    ``CHUNK_ROWS`` rows), and the digest, a chain by its nature, runs through
    the repaired rows of a split conversation as a stream.
    """
    absent = "coalesce(absent, false)" if "absent" in conversations.columns else "false"
    rows = conversations.selectExpr(
        "conv_id", "cast(turn AS bigint) AS turn", "coalesce(role, ' ') AS role",
        "coalesce(text, ' ') AS text", f"{absent} AS absent",
    ).withColumns({"h": F.xxhash64("text"), "id": F.monotonically_increasing_id()})
    # The number only deals equal rows to several tasks.
    order = ["conv_id", "turn", "role", "h", "id"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    key = f"conv_id {conversations.schema['conv_id'].dataType.simpleString()}"

    def mapped(df: DataFrame, function, schema: str) -> DataFrame:
        schema = f"{key}, {schema}"
        arrow = to_arrow_schema(StructType.fromDDL(schema))
        return df.mapInArrow(lambda batches: _batches(function(batches), arrow), schema)

    rows = rows.select("conv_id", "turn", "role", "text", "absent")
    done = stored(mapped(rows, lambda b: _read(b, with_rows), f"{_RESULT}, {_CHUNK}"))
    results = [c.split()[0] for c in f"{key}, {_RESULT.split(', repaired array')[0]}".split(", ")]
    results.append("repaired")

    parts = stored(_across_chunks(done.where("NOT whole")))
    summary = mapped(parts.drop("texts"), _summaries, _SUMMARY)
    places = stored(summary.groupBy("conv_id").applyInPandas(_compose, f"{key}, {_PLACE}"))
    at = F.col("p.conv_id").eqNullSafe(F.col("c.conv_id")) & (F.col("p.pid") == F.col("c.pid"))
    both = parts.select("conv_id", "pid", "k", "roles", "texts", "marks").alias("p")
    both = both.join(places.alias("c"), at & (F.col("p.k") == F.col("c.k"))).select(
        "p.*", *[f"c.{n}" for n in places.columns if n not in ("conv_id", "pid", "k")]
    )
    numbers = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint"
    piece = (
        f"pid int, k int, last boolean, {numbers}, audit string, text string, n_rows bigint, "
        "repaired array<struct<role: string, text: string>>"
    )
    traced = mapped(both, lambda b: _traced(b, with_rows), piece)
    traced = traced.repartition("conv_id").sortWithinPartitions("conv_id", "pid", "k")
    joined = mapped(traced, _joined, _RESULT)
    return done.where("whole").select(results).union(joined.select(results))
