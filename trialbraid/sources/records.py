"""Records of CSV files, read by many tasks also where quoted cells hold line breaks.

A split starts in the middle of a file, so its first line may lie inside of a
quoted cell. What a line does to that is a function on two states, outside and
inside; so is what a split does, and the functions of the splits of a file
compose to the state at the start of each. A first pass gives the function of
every split, and the few lines at its ends that may belong to a record of two
splits. The second pass starts each split in its state and joins lines to
records. Records that cross splits come from the first pass.

A quote opens a cell only at its start, two quotes inside of a quoted cell are
one, and text behind a closing quote runs to the next comma. A record that
never closes is a fault of each of its lines, so nothing behind it is lost.
"""

from __future__ import annotations

import sys
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialbraid.sources.folders import work_folder

# The functions travel to the executors with their code.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Characters of one end of a split that a record of several splits may have there.
MAX_END = 8 << 20

_CELL = r'(?:"(?:[^"]|"")*"(?:[^",][^,]*)?|[^",][^,]*)?'
_OPEN = r'"(?:[^"]|"")*$'
#: Of a line: from outside it ends inside; from inside it never leaves; it leaves and ends inside.
_OPENS = f"^(?:{_CELL},)*{_OPEN}"
_STAYS = r'^(?:[^"]|"")*$'
_REOPENS = rf'^(?:[^"]|"")*"(?:[^",][^,]*)?,(?:{_CELL},)*{_OPEN}'
#: Of a record: text follows a closing quote.
_STRAY = rf'^(?:{_CELL},)*"(?:[^"]|"")*"[^",]'
UNCLOSED = "unclosed quote"
STRAY = "text behind a closing quote"


def read_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(value, file, block): physical lines by file and start of the split."""
    text = spark.read.option("lineSep", "\n").text(paths)
    return text.select(
        "value", F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
    )


def _changes(lines: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Of every line: ends inside if it starts outside, and if it starts inside."""
    quoted = pc.match_substring(lines, '"').to_numpy(zero_copy_only=False)
    opens, stays = np.zeros(len(lines), bool), np.ones(len(lines), bool)
    at = np.flatnonzero(quoted)
    if len(at):
        some = lines.take(pa.array(at))
        match = lambda pattern: pc.match_substring_regex(some, pattern).to_numpy(zero_copy_only=False)
        opens[at] = match(_OPENS)
        stays[at] = match(_STAYS) | match(_REOPENS)
    return opens, stays


def line_states(inside: bool, opens: np.ndarray, stays: np.ndarray) -> np.ndarray:
    """Whether each line starts inside a quoted cell, and the state behind the last one."""
    n, at = len(opens), 0
    out = np.empty(n + 1, bool)
    turns = np.flatnonzero(opens), np.flatnonzero(~stays)
    while at < n:
        events = turns[inside]
        k = np.searchsorted(events, at)
        to = int(events[k]) if k < len(events) else n
        out[at : to + 1] = inside
        if to == n:
            return out
        at, inside = to + 1, not inside
    out[n] = inside
    return out


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, pa.Array]]:
    """Lines of one split at a time (a split may come in several runs)."""
    for batch in batches:
        block = batch.column("block").to_numpy()
        files = batch.column("file").dictionary_encode()
        name = files.indices.to_numpy()
        new = np.flatnonzero((block[1:] != block[:-1]) | (name[1:] != name[:-1])) + 1
        for low, high in zip([0, *new], [*new, len(block)]):
            if high > low:
                lines = batch.column("value").slice(low, high - low)
                yield files.dictionary[int(name[low])].as_py(), int(block[low]), lines


@dataclass
class _End:
    """Lines of one end of a split, as long as they are not too many."""

    lines: list[str] = field(default_factory=list)
    size: int = 0

    def add(self, lines: pa.Array) -> None:
        if self.size <= MAX_END:
            self.size += lines.nbytes
            if self.size <= MAX_END:
                self.lines += lines.to_pylist()

    def text(self) -> str | None:
        return "\n".join(self.lines) if self.size <= MAX_END else None


class _Split:
    """What a split does from either state, and the lines at its ends."""

    def __init__(self, file: str, block: int):
        self.file, self.block, self.n, self.first = file, block, 0, None
        self.state, self.last = [False, True], [-1, -1]
        self.tail, self.head, self.left = [_End(), _End()], _End(), False

    def add(self, lines: pa.Array) -> None:
        if self.first is None:
            self.first = lines[0].as_py()
        opens, stays = _changes(lines)
        for start in (0, 1):
            states = line_states(self.state[start], opens, stays)
            outside = np.flatnonzero(~states[:-1])
            if start and not self.left:
                self.left = len(outside) > 0
                self.head.add(lines.slice(0, int(outside[0]) if self.left else len(lines)))
            if len(outside):
                self.last[start] = self.n + int(outside[-1])
                self.tail[start] = _End()
                if states[-1]:
                    self.tail[start].add(lines.slice(int(outside[-1])))
            elif states[-1] and self.last[start] >= 0:
                self.tail[start].add(lines)
            self.state[start] = bool(states[-1])
        self.n += len(lines)

    def row(self) -> dict:
        tails = [t.text() if s and last >= 0 else "" for t, s, last in zip(self.tail, self.state, self.last)]
        return {
            "file": self.file, "block": self.block, "first": self.first if self.block == 0 else None,
            "out_end": self.state[0], "out_last": self.last[0], "out_tail": tails[0],
            "in_end": self.state[1], "in_last": self.last[1], "in_tail": tails[1],
            "in_head": self.head.text(),
        }


_SPLIT = (
    "file string, block bigint, first string, out_end boolean, out_last bigint, out_tail string, "
    "in_end boolean, in_last bigint, in_tail string, in_head string"
)


def _functions(lines: DataFrame) -> DataFrame:
    """One row per split."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = None
        for file, block, part in _runs(batches):
            if split is None or (split.file, split.block) != (file, block):
                if split is not None:
                    yield pa.RecordBatch.from_pylist([split.row()], schema)
                split = _Split(file, block)
            split.add(part)
        if split is not None:
            yield pa.RecordBatch.from_pylist([split.row()], schema)

    kinds = {"string": pa.string(), "bigint": pa.int64(), "boolean": pa.bool_()}
    schema = pa.schema([(n, kinds[k]) for n, k in (c.split() for c in _SPLIT.split(", "))])
    return lines.mapInArrow(run, _SPLIT)


def _compose(splits: pd.DataFrame) -> pd.DataFrame:
    """Of one file: splits that start inside, records of several splits, and where one never closes.

    A file has one row per split here, whatever its size.
    """
    out, inside, open_lines, at = [], False, [], (0, 0)
    splits = splits.sort_values("block")
    file = splits["file"].iloc[0]
    for s in splits.itertuples():
        if inside:
            out.append((file, s.block, 0, "inside", None))
            open_lines.append(s.in_head)
        if inside and (s.in_last >= 0 or not s.in_end):
            out.append((file, *at, "record", open_lines))
            open_lines = []
        end, last, tail = (s.in_end, s.in_last, s.in_tail) if inside else (s.out_end, s.out_last, s.out_tail)
        if end and last >= 0:
            open_lines, at = [tail], (s.block, last)
        inside = bool(end)
    if inside:
        out.append((file, *at, "unclosed", None))
    rows = []
    for name, block, line, kind, parts in out:
        if kind == "record":
            if any(p is None for p in parts):
                raise ValueError(f"a record of more than {MAX_END} bytes in one split: {name}, {block}")
            parts = "\n".join(parts)
        rows.append((name, block, line, kind, parts))
    return pd.DataFrame(rows, columns=["file", "block", "line", "kind", "text"])


@dataclass
class Places:
    """What the splits of some files start in, and the records that cross splits.

    One entry per split at most, so this may be sent to all tasks.
    """

    inside: frozenset
    unclosed: dict
    crossing: DataFrame

    def of(self, files: list[str]) -> Places:
        """The places of some of the files."""
        own = set(files)
        return Places(
            frozenset(k for k in self.inside if k[0] in own),
            {f: at for f, at in self.unclosed.items() if f in own},
            self.crossing.where(F.col("file").isin(files)),
        )


def spans_lines(line: str) -> bool:
    """Whether a quoted cell of the line is open at its end."""
    return bool(_changes(pa.array([line]))[0][0])


def first_lines(spark: SparkSession, path: str | list[str]) -> dict[str, str]:
    """The first line of every file; only the beginning of each split is read."""
    # One split per task, so that a task may stop at its first line.
    heads = spark.newSession()
    heads.conf.set("spark.sql.files.openCostInBytes", str(1 << 40))
    heads.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch
                return

    lines = read_lines(heads, path).mapInArrow(run, "value string, file string, block bigint")
    return {r.file: r.value for r in lines.where("block = 0").collect()}


def find_places(spark: SparkSession, path: str | list[str]) -> tuple[dict[str, str], Places]:
    """First lines of the files, and the places of their records; one pass over the files."""
    folder = work_folder(spark, f"splits-{uuid.uuid4().hex}")
    _functions(read_lines(spark, path)).write.parquet(f"{folder}/functions")
    splits = spark.read.schema(_SPLIT).parquet(f"{folder}/functions")
    heads = {r.file: r.first for r in splits.where("block = 0").select("file", "first").collect()}
    kinds = "file string, block bigint, line bigint, kind string, text string"
    splits.groupBy("file").applyInPandas(_compose, kinds).write.parquet(f"{folder}/places")
    places = spark.read.schema(kinds).parquet(f"{folder}/places")
    told = places.where("kind != 'record'").drop("text").collect()
    return heads, Places(
        frozenset((r.file, r.block) for r in told if r.kind == "inside"),
        {r.file: (r.block, r.line) for r in told if r.kind == "unclosed"},
        places.where("kind = 'record'").select("file", "block", "line", "text"),
    )


def _fault(texts: pa.Array) -> pa.Array:
    ends = pc.utf8_rtrim(texts, "\r")
    return pc.if_else(pc.match_substring_regex(ends, _STRAY), STRAY, pa.scalar(None, pa.string()))


_RECORD = ["file", "block", "line", "text", "fault"]
RECORD_SCHEMA = "file string, block bigint, line bigint, text string, fault string"


def _out(file: str, block: int, line: np.ndarray, text: pa.Array, fault: pa.Array | None = None):
    n = len(text)
    columns = [
        pa.repeat(pa.scalar(file), n), pa.repeat(pa.scalar(block, pa.int64()), n), pa.array(line, pa.int64()),
        text, _fault(text) if fault is None else fault,
    ]
    return pa.RecordBatch.from_arrays(columns, names=_RECORD)


def records(lines: DataFrame, places: Places | None) -> DataFrame:
    """(file, block, line, text, fault): the records behind the first line of every file.

    Without ``places`` every line is a record, and a quote that it leaves open
    is a fault. Blank lines are no records, as for any CSV reader.
    """
    joined = places is not None
    context = lines.sparkSession.sparkContext
    shared = context.broadcast((places.inside, places.unclosed) if joined else (frozenset(), {}))

    def single(file: str, block: int, line: int, part: pa.Array) -> pa.RecordBatch:
        opens, _ = _changes(part)
        fault = pc.if_else(pa.array(opens), UNCLOSED, _fault(part))
        return _out(file, block, line + np.arange(len(part)), part, fault)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inside, unclosed = shared.value
        at, line, state, begun = None, 0, False, None
        for file, block, part in _runs(batches):
            if at != (file, block):
                at, line, state, begun = (file, block), 0, (file, block) in inside, None
            if block == 0 and line == 0:
                part, line = part.slice(1), 1
            if not joined:
                yield single(file, block, line, part)
                line += len(part)
                continue
            # Lines from the one on that never closes are faults one by one.
            stop = unclosed.get(file)
            n = len(part)
            if stop and block >= stop[0]:
                n = min(n, max(stop[1] - line, 0)) if block == stop[0] else 0
                lost = part.slice(n)
                faults = pa.repeat(pa.scalar(UNCLOSED), len(lost))
                yield _out(file, block, line + n + np.arange(len(lost)), lost, faults)
            own = part.slice(0, n)
            states = line_states(state, *_changes(own))
            starts = np.flatnonzero(~states[:-1])
            whole = starts[~states[starts + 1]]
            yield _out(file, block, line + whole, own.take(pa.array(whole)))
            # Records of several lines; the last one may go on in the next run.
            texts, places_of = [], []
            if begun is not None:
                stop_at = int(starts[0]) if len(starts) else n
                begun[1].extend(own.slice(0, stop_at).to_pylist())
                if len(starts) or not states[-1]:
                    places_of.append(begun[0])
                    texts.append("\n".join(begun[1]))
                    begun = None
            ends = np.append(starts[1:], n)
            for k in np.flatnonzero(states[starts + 1]):
                lines_of = own.slice(int(starts[k]), int(ends[k] - starts[k])).to_pylist()
                if k == len(starts) - 1 and states[-1]:
                    begun = (line + int(starts[k]), lines_of)
                else:
                    places_of.append(line + int(starts[k]))
                    texts.append("\n".join(lines_of))
            yield _out(file, block, np.array(places_of, np.int64), pa.array(texts, pa.string()))
            state, line = bool(states[-1]) if n else state, line + len(part)

    out = lines.mapInArrow(run, RECORD_SCHEMA)
    if joined:
        crossing = places.crossing.mapInArrow(
            lambda batches: (
                pa.RecordBatch.from_arrays([*b.columns, _fault(b.column("text"))], names=_RECORD)
                for b in batches
            ),
            RECORD_SCHEMA,
        )
        out = out.union(crossing.where("NOT (block = 0 AND line = 0)"))
    return out.where(r"text RLIKE '[^\\s]'")
