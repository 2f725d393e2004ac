"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model of words.

Trusted texts are counted as pairs of successive words, with a mark before and
after each text. The counts are shards: nothing of the vocabulary's or the
pairs' size passes through the driver or one task; totals of contexts,
continuation counts and discounts are joins and groupings of shards. Below the
words lies a spelling model of three symbols over the distinct trusted words,
which gives every word that no trusted text holds a probability of its own. Its
256 symbols are classes of characters, and each character has its own share of
its class, so its tables are bounded and may be broadcast.

The logarithm of a text is what spelling alone gives, which its task finds, and
a sum of gains, one for each word and each pair that trusted texts hold. Every
document is reduced to its distinct pairs, and these meet the pairs of trusted
texts by shard. The most frequent words (``HOT`` at most) have a rank in place of
a hash, so a pair takes few bytes, and their terms are broadcast, as are gains of the
most frequent pairs, so no key is frequent. Other words' terms go to the shards
that hold pairs of them. Gains are whole numbers, so sums do not depend on their order.

A trusted text would know its own pairs. So trusted texts are dealt into two
folds by their text and each is scored by the counts of the other fold; all
others by all counts.

A document's score is how far its mean negative log probability lies above the
trusted mean of its language, drawn towards that mean where it is short. A
document is rejected above a high quantile of the trusted scores of its language.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trialbraid.llm.arrowtext import Runs, mix, slices, text_bytes, tokens
from trialbraid.llm.shared import removed, scratch, small, small_batches, stored, tidy

#: Trusted share that a threshold keeps, characters of the prior, fewest trusted texts.
QUANTILE = 0.998
PRIOR_CHARS = 50
MIN_TRUSTED = 30
#: Scores are compared in steps of this size.
STEP = 0.001

#: Words whose terms, and pairs whose gains are broadcast, at most.
HOT = 300_000
#: Rounds in which texts meet the shards; the shuffle files of a round go before the next.
ROUNDS = 6
#: Gains are whole numbers of this size.
UNIT = 2.0**-20

_BITS = 8
#: Stands before and after a text.
_EDGE = np.uint64(0x51ED270B7A9F3C15)
#: Stands as second word where a word is meant alone.
_ALONE = np.int64(1 << 62)
#: More than any count.
_NEVER = 1 << 62
#: Counts that the two folds and the other documents are scored by.
_PARTS = ("n1", "n0", "n0 + n1")


def _alphabet() -> np.ndarray:
    """Symbol of each UTF-16 unit; 0 stands before a text."""
    own = [0x0A, 0x09, *range(0x20, 0x7F), *range(0xC0, 0x100)]
    unit = np.arange(1 << 16)
    classes = (1 << _BITS) - 1 - len(own)
    symbol = 1 + len(own) + (unit * 40503 >> 4) % classes
    symbol[own] = np.arange(1, len(own) + 1)
    return symbol.astype(np.uint8)


def _runs(texts: list[str], symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the three symbols that end at each character, and the bounds of the texts."""
    units = np.frombuffer("".join(f"\0\0{t}" for t in texts).encode("utf-16-le"), np.uint16)
    lengths = np.array([len(t.encode("utf-16-le")) // 2 for t in texts], np.int64)
    ends = np.cumsum(lengths + 2)
    codes = symbol[units].astype(np.uint32)
    starts = ends - lengths - 2
    codes[starts] = 0
    codes[starts + 1] = 0
    run = codes.copy()
    run[1:] |= codes[:-1] << _BITS
    run[2:] |= codes[:-2] << (2 * _BITS)
    inside = np.ones(len(units), bool)
    inside[starts] = inside[starts + 1] = False
    return run[inside], np.concatenate([[0], np.cumsum(lengths)])


def _count(texts: DataFrame) -> DataFrame:
    """(g, n): how often each run of three symbols stands in the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbol = _alphabet()
        for part in slices(batches):
            codes, _ = _runs([t or "" for t in part.column("text").to_pylist()], symbol)
            seen, n = np.unique(codes, return_counts=True)
            columns = [pa.array(seen.astype(np.int64)), pa.array(n.astype(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=["g", "n"])

    return texts.select("text").mapInArrow(run, "g bigint, n bigint").groupBy("g").agg(F.sum("n").alias("n"))


def _count_units(words: DataFrame) -> DataFrame:
    """(unit, n): UTF-16 units of the words; at most 2**16 rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            text = "".join(t or "" for t in part.column("text").to_pylist())
            seen, n = np.unique(np.frombuffer(text.encode("utf-16-le"), np.uint16), return_counts=True)
            columns = [pa.array(seen.astype(np.int32)), pa.array(n.astype(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=["unit", "n"])

    return words.select("text").mapInArrow(run, "unit int, n bigint").groupBy("unit").agg(F.sum("n").alias("n"))


def _discounts(counts: DataFrame) -> list[float]:
    """Discounts of runs seen once, twice and more often."""
    return _discounts_of(counts.agg(*[F.count_if(F.col("n") == k).alias(f"n{k}") for k in (1, 2, 3, 4)]).first())


def _discounts_of(seen: list[int]) -> list[float]:
    """The same of the numbers of runs seen once to four times."""
    n1, n2, n3, n4 = (max(int(x), 1) for x in seen)
    y = n1 / (n1 + 2 * n2)
    return [min(max(d, 0.05), k - 0.05) for k, d in ((1, 1 - 2 * y * n2 / n1), (2, 2 - 3 * y * n3 / n2), (3, 3 - 4 * y * n4 / n3))]


def _smoothed(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(g, share) of seen runs after discounting and (context, back) left for shorter runs."""
    d1, d2, d3 = _discounts(counts)
    counts = counts.withColumn("context", F.expr(f"shiftright(g, {_BITS})"))
    off = f"CASE n WHEN 1 THEN {d1}D WHEN 2 THEN {d2}D ELSE {d3}D END"
    totals = counts.groupBy("context").agg(F.sum("n").alias("t"), F.expr(f"sum({off})").alias("off"))
    seen = counts.join(totals, "context").selectExpr("g", f"(n - {off}) / t AS share")
    return seen, totals.selectExpr("context", "off / t AS back")


class Model:
    """Natural logarithms of p(c | a, b) for all runs of three symbols."""

    def __init__(self, trusted: DataFrame):
        three = stored(_count(trusted))
        two = three.groupBy(F.expr(f"g & {(1 << 2 * _BITS) - 1}").alias("g")).agg(F.count("*").alias("n"))
        two = stored(two)
        one = two.groupBy(F.expr(f"g & {(1 << _BITS) - 1}").alias("g")).agg(F.count("*").alias("n"))
        # At most 2**24, 2**16 and 2**8 rows.
        (g3, s3), (c3, b3) = (_columns(t) for t in _smoothed(three))
        (g2, s2), (c2, b2) = (_columns(t) for t in _smoothed(two))
        (g1, s1), (_, b1) = (_columns(t) for t in _smoothed(one))
        size = 1 << _BITS
        p1 = np.full(size, 1.0 / size)
        if len(b1):
            p1 *= b1[0]
            p1[g1] += s1
        back = np.ones(size)
        back[c2] = b2
        p2 = (back[:, None] * p1[None, :]).ravel()
        p2[g2] += s2
        self.p2 = p2.astype(np.float32)
        self.back = np.ones(size * size, np.float32)
        self.back[c3] = b3
        self.runs, self.shares = g3.astype(np.uint32), s3.astype(np.float32)

    def table(self) -> np.ndarray:
        """The logarithms as one array over all runs."""
        row, logs = self.rows()
        return logs.reshape(-1, 1 << _BITS)[row].ravel()

    def rows(self) -> tuple[np.ndarray, np.ndarray]:
        """Row of every context of two symbols, and logarithms of the rows.

        Contexts that no trusted text holds share the rows of their last symbol.
        """
        size = 1 << _BITS
        seen = np.unique(self.runs >> _BITS)
        row = np.tile(np.arange(size, dtype=np.int32), size)
        row[seen] = size + np.arange(len(seen))
        rows = self.p2.reshape(size, size)
        p = np.concatenate([rows, self.back[seen, None] * rows[seen & (size - 1)]]).ravel()
        p[(row[self.runs >> _BITS].astype(np.int64) << _BITS) | (self.runs & (size - 1))] += self.shares
        return row, np.log(p, out=p)


def _columns(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    table = df.toArrow()
    return tuple(c.to_numpy() for c in table.columns)


class Spelling:
    """Logarithms of words by their characters; an end of line ends a word."""

    def __init__(self, words: DataFrame):
        words = words.selectExpr("concat(word, '\n') AS text")
        self.model = Model(words)
        units, n = _columns(_count_units(words))
        count = np.ones(1 << 16)
        count[units] += n
        classes = _alphabet()
        self.own = np.log(count / np.bincount(classes, count, 1 << _BITS)[classes]).astype(np.float32)

    def __getstate__(self):
        m = self.model
        return m.p2, m.back, m.runs, m.shares, self.own

    def __setstate__(self, state):
        # Only the rows stay; a worker has no use for the model.
        model = Model.__new__(Model)
        model.p2, model.back, model.runs, model.shares, self.own = state
        self.row, self.table = model.rows()
        self.symbol = _alphabet()

    def logs(self, words: list[str]) -> np.ndarray:
        words = [f"{w}\n" for w in words]
        codes, bounds = _runs(words, self.symbol)
        at = (self.row[codes >> _BITS].astype(np.int64) << _BITS) | (codes & ((1 << _BITS) - 1))
        units = np.frombuffer("".join(words).encode("utf-16-le"), np.uint16)
        total = np.concatenate([[0.0], np.cumsum(self.table[at].astype(np.float64) + self.own[units])])
        return total[bounds[1:]] - total[bounds[:-1]]


def _known_words(runs: Runs, hot) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes of the distinct words and of the mark in ascending order, the place of each run and, last,
    of the mark among them; and a run of each distinct word (behind the last one: the mark) with its place.

    The code of a broadcast word is its rank, others have 63 bits of their hash and are below 0.
    """
    seen, at, place = np.unique(np.append(runs.hash, _EDGE), return_index=True, return_inverse=True)
    codes = _codes(seen, hot)
    order = np.argsort(codes)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return codes[order], rank[place], at, rank


def _codes(words: np.ndarray, hot: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    keys, rank = hot
    codes = (words | np.uint64(1 << 63)).view(np.int64)
    if len(keys):
        place = np.minimum(np.searchsorted(keys, words), len(keys) - 1)
        known = keys[place] == words
        codes[known] = rank[place[known]]
    return codes


def _framed(runs: Runs, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and second words of all pairs of the texts, and the text of each pair."""
    n = np.diff(runs.first)
    text = np.repeat(np.arange(len(n)), n + 2)
    line = np.full(len(text), places[-1])
    line[np.arange(len(runs.hash)) + 2 * runs.text_of() + 1] = places[:-1]
    pair = np.flatnonzero(text[1:] == text[:-1])
    return line[pair], line[pair + 1], text[pair]


def _pair_key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(mix(a.view(np.uint64)) + b.view(np.uint64))


def _home(words: np.ndarray, shards: int) -> np.ndarray:
    """The shard where all counts of a word meet."""
    return (_pair_key(words, np.full(len(words), _ALONE)) % np.uint64(shards)).astype(np.int32)


def _distinct(*keys: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows of the columns and how often each stands there."""
    order = np.lexsort(keys)
    keys = [k[order] for k in keys]
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    at = np.flatnonzero(new)
    return [k[at] for k in keys], np.diff(np.append(at, len(order)))


def _distinct_pairs(group: np.ndarray, a: np.ndarray, b: np.ndarray, places: int) -> list[np.ndarray]:
    """Distinct rows in ascending order and how often each stands there; a and b are below ``places``."""
    bits = np.uint64(places.bit_length())
    low = np.uint64((1 << places.bit_length()) - 1)
    key = (group.astype(np.uint64) << bits | a.astype(np.uint64)) << bits | b.astype(np.uint64)
    key.sort()
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    at = np.flatnonzero(new)
    key, n = key[at], np.diff(np.append(at, len(key)))
    return [*(x.astype(np.int64) for x in (key >> bits >> bits, key >> bits & low, key & low)), n]


def _packed(*columns: np.ndarray) -> bytes:
    """Columns of integers compressed byte by byte of all values, the first one as differences."""
    table = np.stack([np.asarray(c, np.int64) for c in columns])
    table[0, 1:] -= table[0, :-1].copy()
    table[0] = table[0] << 1 ^ table[0] >> 63
    raw = table.view(np.uint8).reshape(len(columns), -1, 8).transpose(0, 2, 1).tobytes()
    return table.shape[1].to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def _unpacked(blobs: pa.ChunkedArray, columns: int) -> np.ndarray:
    """The columns of all blobs, one after another."""
    tables = [np.empty((columns, 0), np.int64)]
    for blob in blobs.to_pylist():
        n = int.from_bytes(blob[:8], "little")
        raw = pa.decompress(blob[8:], 8 * columns * n, "zstd", asbytes=True)
        planes = np.frombuffer(raw, np.uint8).reshape(columns, 8, n).transpose(0, 2, 1)
        table = planes.copy().view(np.int64).reshape(columns, n)
        first = table[0].view(np.uint64)
        table[0] = np.cumsum((first >> np.uint64(1)).view(np.int64) ^ -(table[0] & 1))
        tables.append(table)
    return np.concatenate(tables, axis=1)


def _dealt(shard: np.ndarray, shards: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """Order by shard, and (shard, start, end) of the shards that have rows."""
    order = np.argsort(shard.astype(np.min_scalar_type(shards)), kind="stable")
    names, at = np.unique(shard[order], return_index=True)
    return order, [*zip(names.tolist(), at.tolist(), [*at[1:].tolist(), len(order)])]


def _vocabulary(trusted: DataFrame) -> DataFrame:
    """(w, word, n): distinct words of the texts and their number; the mark of the ends is the empty word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            data, offsets = text_bytes(part.column("text"))
            runs = tokens(data, offsets)
            marked = np.append(runs.hash, np.full(2 * part.num_rows, _EDGE))
            seen, at, n = np.unique(marked, return_index=True, return_counts=True)
            columns = [seen.view(np.int64), _words(data, runs, at), n]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["w", "word", "n"])

    words = trusted.select("text").mapInArrow(run, "w bigint, word string, n bigint")
    return words.groupBy("w", "word").agg(F.sum("n").alias("n"))


def _words(data: np.ndarray, runs: Runs, at: np.ndarray) -> list[str]:
    """Some runs as texts; the run behind the last one is empty."""
    raw, start, end = data.tobytes(), np.append(runs.start, 0), np.append(runs.end, 0)
    return [raw[i:j].decode() for i, j in zip(start[at].tolist(), end[at].tolist())]


#: What is counted of a word, for each of ``_PARTS``: its number as a first word, its distinct pairs seen
#: once, twice and in all, and its distinct pairs as a second word.
_COUNTS = [f"{c}{p}" for p in range(len(_PARTS)) for c in ("t", "one", "two", "m", "c")]

#: A shard's pairs (a, b, n0, n1), the most frequent ones again and numbers of pairs seen once to four times;
#: or what another shard (source) has counted of its words (w, then ``_COUNTS``).
_COUNTED = "shard int, source int, pairs binary, hot binary, stats array<bigint>, w binary"


def _count_pairs(trusted: DataFrame, hot, shards: int, most: int) -> DataFrame:
    """``_COUNTED``: how often word b follows word a in the texts of each fold."""

    def cells_of(part: pa.RecordBatch) -> pa.RecordBatch:
        runs = tokens(*text_bytes(part.column("text")))
        codes, places, _, _ = _known_words(runs, hot.value)
        a, b, text = _framed(runs, places)
        fold = part.column("part").to_numpy()[text]
        fold, a, b, n = _distinct_pairs(fold, a, b, len(codes))
        a, b = codes[a], codes[b]
        order, cells = _dealt(_pair_key(a, b) % np.uint64(shards), shards)
        a, b, fold, n = a[order], b[order], fold[order], n[order]
        blobs = [_packed(a[i:j], b[i:j], fold[i:j], n[i:j]) for _, i, j in cells]
        columns = [pa.array([c[0] for c in cells], pa.int32()), pa.array(blobs, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=["shard", "cell"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            yield cells_of(part)

    def merge(cells: pa.Table) -> pa.Table:
        a, b, fold, n = _unpacked(cells.column("cell"), 4)
        key = _pair_key(a, b)
        order = np.argsort(key)
        key = key[order]
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        at = np.flatnonzero(new)
        n0, n1 = (np.add.reduceat(np.where(fold[order] == f, n[order], 0), at) for f in (0, 1))
        a, b = a[order[at]], b[order[at]]
        order = np.lexsort((b, a))  # takes less when packed
        a, b, n0, n1 = a[order], b[order], n0[order], n1[order]
        both = n0 + n1

        w, place = np.unique(np.append(a, b), return_inverse=True)
        first, second = place[: len(a)], place[len(a) :]
        counts, stats = [], []
        total = lambda at, by: np.bincount(at, by, len(w)).astype(np.int64)
        for n in (n1, n0, both):  # as _PARTS
            counts += [total(first, x) for x in (n, n == 1, n == 2, n > 0)] + [total(second, n > 0)]
            stats += [int((n == k).sum()) for k in (1, 2, 3, 4)]
        home, there = _dealt(_home(w, shards), shards)
        counts = [c[home] for c in (w, *counts)]
        often = np.flatnonzero((a >= 0) & (b >= 0))
        if len(often) > most:
            often = often[np.argsort(-both[often], kind="stable")[:most]]
        own = cells.column("shard")[0].as_py()
        often = _packed(a[often], b[often], n0[often], n1[often])
        rows = [{"shard": own, "pairs": _packed(a, b, n0, n1), "hot": often, "stats": stats}]
        for shard, i, j in there:
            rows.append({"shard": shard, "source": own, "w": _packed(*(c[i:j] for c in counts))})
        blob, numbers = pa.binary(), pa.list_(pa.int64())
        kinds = [pa.int32(), pa.int32(), blob, blob, numbers, blob]
        return pa.Table.from_pylist(rows, pa.schema(list(zip(("shard", "source", "pairs", "hot", "stats", "w"), kinds))))

    cells = trusted.select("text", "part").mapInArrow(run, "shard int, cell binary")
    return cells.groupBy("shard").applyInArrow(merge, _COUNTED)


#: Words without a rank (w, then ``_COUNTS`` and the bits of what they are spelled by) for a shard that has
#: pairs of them, or that they are at home in; with the latter, words that have one, and of each of
#: ``_PARTS``, numbers of words behind one to four words and any, and of distinct pairs.
_WORDS = "shard int, w binary, hot binary, stats array<bigint>"


def _count_words(counted: DataFrame, spelled: DataFrame) -> DataFrame:
    """``_WORDS`` of all shards' counts of words."""

    def merge(cells: pa.Table, spelled: pa.Table) -> pa.Table:
        blobs = cells.column("w").combine_chunks()
        parts = [_unpacked(blobs[i : i + 1], 1 + len(_COUNTS)) for i in range(len(blobs))]
        every = np.concatenate(parts, axis=1)
        w, place = np.unique(every[0], return_inverse=True)
        spelled = spelled.sort_by("w")
        logs = spelled.column("spelled").to_numpy()[np.searchsorted(spelled.column("w").to_numpy(), w)]
        table = [w, *(np.bincount(place, c, len(w)).astype(np.int64) for c in every[1:]), logs.view(np.int64)]
        table = np.stack(table)
        stats = []
        for p in range(len(_PARTS)):
            c = table[1 + _COUNTS.index(f"c{p}")]
            stats += [int((c == k).sum()) for k in (1, 2, 3, 4)] + [int((c > 0).sum()), int(c.sum())]
        cold = int(np.searchsorted(w, 0))
        home = cells.column("shard")[0].as_py()
        rows = [{"shard": home, "w": _packed(*table[:, :cold]), "hot": _packed(*table[:, cold:]), "stats": stats}]
        for source, part in zip(cells.column("source").to_pylist(), parts):
            some = table[:, np.searchsorted(w, part[0][part[0] < 0])]
            if some.shape[1] and source != home:
                rows.append({"shard": source, "w": _packed(*some)})
        kinds = [pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64())]
        return pa.Table.from_pylist(rows, pa.schema(list(zip(("shard", "w", "hot", "stats"), kinds))))

    counted = counted.where("w IS NOT NULL").select("shard", "source", "w").groupBy("shard")
    return counted.cogroup(spelled.groupBy("shard")).applyInArrow(merge, _WORDS)


def _off(n: np.ndarray, d: list[float]) -> np.ndarray:
    """What is taken off counts."""
    return np.array([0, *d])[np.minimum(n, 3)]


def _stats(counted: DataFrame, each: int) -> list[list[int]]:
    """Sums of the stats of all shards, for each of ``_PARTS``."""
    n = each * len(_PARTS)
    row = counted.agg(*[F.coalesce(F.sum(F.expr(f"stats[{i}]")), F.lit(0)) for i in range(n)]).first()
    return [list(row[i : i + each]) for i in range(0, n, each)]


class Smoothing:
    """Discounts of pairs and words, and the logarithm of what spelling is weighted by, for each of ``_PARTS``."""

    def __init__(self, pairs: list[list[int]], words: list[list[int]]):
        self.pairs = [_discounts_of(seen) for seen in pairs]
        self.words = [_discounts_of(seen[:4]) for seen in words]
        self.total = [max(seen[5], 1) for seen in words]
        self.weight = []
        for d, (one, two, _, _, some, total) in zip(self.words, words):
            off = one * d[0] + two * d[1] + (some - one - two) * d[2]
            self.weight.append(float(np.log(off / total)) if total else 0.0)

    def terms(self, counts: np.ndarray) -> np.ndarray:
        """Of words (``_COUNTS`` and the bits of what they are spelled by) for each of ``_PARTS``: their number as
        a first word, the logarithm of what their pairs leave to the second word alone, their own
        logarithm alone, and their gain (whole).
        """
        spelled = counts[-1].view(np.float64)
        number, back, log, gain = [], [], [], []
        for p in range(len(_PARTS)):
            t, one, two, m, c = counts[5 * p : 5 * p + 5]
            d = self.pairs[p]
            left = one * d[0] + two * d[1] + (m - one - two) * d[2]
            with np.errstate(divide="ignore"):
                share = np.log((c - _off(c, self.words[p])) / self.total[p])
                back.append(np.where(t > 0, np.log(left / np.maximum(t, 1)), 0.0))
            number.append(t)
            log.append(np.logaddexp(share, self.weight[p] + spelled))
            gain.append(np.round((log[p] - spelled - self.weight[p] + back[p]) / UNIT))
        return np.stack([*number, *back, *log, *gain]).astype(np.float64)

    def gains(self, first: np.ndarray, second: np.ndarray, n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
        """Whole gains of pairs, by the terms of their words and the counts of the folds."""
        gains = np.empty((len(_PARTS), len(n0)), np.int64)
        for p, n in enumerate((n1, n0, n0 + n1)):
            share = (n - _off(n, self.pairs[p])) / np.maximum(first[p], 1)
            alone = first[3 + p] + second[6 + p]
            with np.errstate(divide="ignore"):
                gains[p] = np.round((np.logaddexp(np.log(share), alone) - alone) / UNIT)
        return gains


class WordModel:
    """Counts of pairs as shards, terms of words, and logarithms of what spelling is weighted by.

    ``trusted`` has text and part, the fold 0 or 1. Terms of the most frequent
    words are broadcast, those of others go to the shards that hold pairs of them.
    """

    def __init__(self, trusted: DataFrame):
        spark = trusted.sparkSession
        send = spark.sparkContext.broadcast
        self.folder = scratch(spark)
        self.shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
        vocabulary = stored(_vocabulary(trusted), f"{self.folder}/vocabulary")
        self.spelling = send(Spelling(vocabulary))
        least = self._least_hot(vocabulary.select("n"))
        keys, n = _columns(vocabulary.where(f"n >= {least}").select("w", "n"))
        keys = keys.view(np.uint64)[np.lexsort((keys, -n))]
        order = np.argsort(keys)
        self.ranks = send((keys[order], order))

        spelled = vocabulary.mapInArrow(self._spelled(), "shard int, w bigint, spelled double")
        spelled = stored(spelled, f"{self.folder}/spelled")
        removed(spark, f"{self.folder}/vocabulary")

        counted = stored(_count_pairs(trusted, self.ranks, self.shards, HOT // self.shards), f"{self.folder}/counted")
        words = stored(_count_words(counted, spelled), f"{self.folder}/words")
        removed(spark, f"{self.folder}/spelled")
        self.smoothing = Smoothing(_stats(counted, 4), _stats(words, 6))

        hot = _unpacked(words.where("hot IS NOT NULL").select("hot").toArrow().column("hot"), 2 + len(_COUNTS))
        terms = np.zeros((12, len(keys)))
        terms[:, hot[0]] = self.smoothing.terms(hot[1:])
        self.gains = send(terms[9:].astype(np.int64))
        self.terms = send(terms[:9].copy())
        a, b, *n = _unpacked(counted.where("hot IS NOT NULL").select("hot").toArrow().column("hot"), 4)
        key = _pair_key(a, b)
        order = np.argsort(key)
        gains = self.smoothing.gains(terms[:, a], terms[:, b], *n)
        self.hot = send((key[order], gains[:, order]))

        pairs = counted.where("pairs IS NOT NULL").selectExpr("shard", "pairs", "CAST(NULL AS binary) AS w")
        rare = pairs.unionAll(words.where("w IS NOT NULL").selectExpr("shard", "NULL AS pairs", "w"))
        self.rare = stored(rare, f"{self.folder}/rare")
        removed(spark, f"{self.folder}/counted")
        removed(spark, f"{self.folder}/words")

    def _spelled(self):
        spelling, ranks, shards = self.spelling, self.ranks, self.shards

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in slices(batches, "word"):
                codes = _codes(part.column("w").to_numpy().view(np.uint64), ranks.value)
                logs = spelling.value.logs(part.column("word").to_pylist())
                columns = [pa.array(c) for c in (_home(codes, shards), codes, logs)]
                yield pa.RecordBatch.from_arrays(columns, names=["shard", "w", "spelled"])

        return run

    @staticmethod
    def _least_hot(counts: DataFrame) -> int:
        """Least count of the words that are broadcast, at most ``HOT`` of them."""
        both = counts.selectExpr(f"least(n, {HOT}) AS n").groupBy("n").count()
        running = F.sum("count").over(Window.orderBy(F.desc("n")))  # one row for each count up to HOT
        return both.select("n", running.alias("upto")).where(f"upto <= {HOT}").agg(F.min("n")).first()[0] or _NEVER


def _cells(text_key, part, own, copies, text, a, b, n, shard, shards: int) -> pa.RecordBatch:
    """A slice's words and pairs by shard: texts with the number of their rows (size), and all of these rows
    with their counts; own and copies stand in one cell of a slice. ``text`` ascends.
    """
    order, cells = _dealt(shard, shards)
    text, a, b, n = text[order], a[order], b[order], n[order]
    rows = [(int(text_key[0] % shards), _packed(text_key, part, 0 * own, own * copies, copies), _packed(n[:0], n[:0], n[:0]))]
    for name, i, j in cells:
        run = np.flatnonzero(np.append(True, text[i + 1 : j] != text[i : j - 1]))
        at, zeros = text[i:j][run], np.zeros(len(run), np.int64)
        texts = _packed(text_key[at], part[at], np.diff(np.append(run, j - i)), zeros, zeros)
        rows.append((name, texts, _packed(a[i:j], b[i:j], n[i:j])))
    columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary()))]
    return pa.RecordBatch.from_arrays(columns, names=["shard", "texts", "rows"])


def score_documents(docs: DataFrame, model: WordModel) -> DataFrame:
    """(doc_id, text_key, lang, n_chars, part, nll): characters and summed negative log probability.

    ``docs`` has part, the index in ``_PARTS`` of the counts that score it.
    """
    spelling, ranks, ones, hot, terms = model.spelling, model.ranks, model.gains, model.hot, model.terms
    smoothing, shards = model.smoothing, model.shards
    weight = np.array(smoothing.weight)

    def cells_of(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys, gains = hot.value
        # Repeated texts of a slice once, with their number.
        (part, text_key), at, copies = _first_rows(batch)
        data, offsets = text_bytes(batch.column("text").take(pa.array(at)))
        runs = tokens(data, offsets)
        codes, places, first, rank = _known_words(runs, ranks.value)
        logs = np.empty(len(codes))
        logs[rank] = spelling.value.logs(_words(data, runs, first))
        a, b, text = _framed(runs, places)
        cold = b < np.searchsorted(codes, 0)
        own = np.round((logs[b] + weight[part[text]]) / UNIT).astype(np.int64)
        own[~cold] += ones.value[part[text[~cold]], codes[b[~cold]]]
        total = _sums(own, text, len(at))
        # Words without a rank are rows of their own.
        alone = np.full(int(cold.sum()), len(codes))
        text, a, b, n = _distinct_pairs(
            np.append(text, text[cold]), np.append(a, b[cold]), np.append(b, alone), len(codes)
        )
        a, b = codes[a], np.append(codes, _ALONE)[b]
        key = _pair_key(a, b)
        if len(keys):
            place = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            known = keys[place] == key
            total += _sums(gains[part[text[known]], place[known]] * n[known], text[known], len(at))
            text, a, b, n, key = (x[~known] for x in (text, a, b, n, key))
        return _cells(text_key, part, total, copies, text, a, b, copies[text] * n, key % np.uint64(shards), shards)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # What a slice takes is free before the next one, and at the end.
        for batch in slices(batches):
            yield cells_of(batch)

    def add(cells: pa.Table, rare: pa.Table) -> pa.Table:
        """What a shard's pairs and words add to the texts of its cells (text_key, part, total, copies), by text."""
        text_key, part, size, own, copies = _unpacked(cells.column("texts"), 5)
        a, b, n = _unpacked(cells.column("rows"), 3)
        text = np.repeat(np.arange(len(size)), size)
        words = _unpacked(rare.column("w").drop_null(), 2 + len(_COUNTS))
        words = words[:, np.argsort(words[0])]
        cold, table = words[0], smoothing.terms(words[1:])
        first, second, *counts = _unpacked(rare.column("pairs").drop_null(), 4)

        def of(words: np.ndarray) -> np.ndarray:
            out = np.empty((9, len(words)))
            rank = words >= 0
            out[:, rank] = terms.value[:, words[rank]]
            out[:, ~rank] = table[:9, np.searchsorted(cold, words[~rank])]
            return out

        gains = smoothing.gains(of(first), of(second), *counts)
        total = own.copy()
        keys = _pair_key(first, second)
        order = np.argsort(keys)
        keys, gains, lone = keys[order], gains[:, order], b == _ALONE
        for keys, sought, gains, at in (
            (keys, _pair_key(a, b), gains, np.flatnonzero(~lone)),
            (cold, a, table[9:].astype(np.int64), np.flatnonzero(lone)),
        ):
            if len(keys):
                place = np.minimum(np.searchsorted(keys, sought[at]), len(keys) - 1)
                known = keys[place] == sought[at]
                at, place = at[known], place[known]
                total += _sums(gains[part[text[at]], place] * n[at], text[at], len(total))
        some = np.flatnonzero((total != 0) | (copies != 0))
        order, homes = _dealt(text_key[some] % shards, shards)
        rows = [c[some[order]] for c in (text_key, part, total, copies)]
        blobs = [_packed(*(c[i:j] for c in rows)) for _, i, j in homes]
        columns = [pa.array([h[0] for h in homes], pa.int32()), pa.array(blobs, pa.binary())]
        return pa.table(columns, ["shard", "sums"])

    def merge(sums: pa.Table) -> pa.Table:
        text_key, part, total, copies = _unpacked(sums.column("sums"), 4)
        order = np.lexsort((part, text_key))
        (part, text_key), n = _distinct(part, text_key)
        at = np.cumsum(n) - n
        columns = [text_key, part.astype(np.int32), *(np.add.reduceat(c[order], at) for c in (total, copies))]
        return pa.table([pa.array(c) for c in columns], ["text_key", "part", "total", "copies"])

    docs = docs.select(
        "doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"), "lang", "part", "text"
    )
    rounds = []
    for k in range(ROUNDS):
        some = docs.where(f"pmod(text_key, {ROUNDS}) = {k}").select("text_key", "part", "text")
        cells = some.mapInArrow(run, "shard int, texts binary, rows binary").groupBy("shard")
        sums = cells.cogroup(model.rare.groupBy("shard"))
        sums = sums.applyInArrow(add, "shard int, sums binary").groupBy("shard")
        sums = sums.applyInArrow(merge, "text_key bigint, part int, total bigint, copies bigint")
        sums = sums.selectExpr("text_key", "part", f"-(total div copies) * {UNIT}D AS nll")
        rounds.append(stored(sums, f"{model.folder}/sums{k}"))
    sums = reduce(DataFrame.unionAll, rounds)
    docs = docs.withColumn("n_chars", F.expr("octet_length(encode(coalesce(text, ''), 'UTF-16LE')) div 2"))
    return docs.drop("text").join(sums, ["text_key", "part"]).select(
        "doc_id", "text_key", "lang", "n_chars", "part", "nll"
    )


def _sums(values: np.ndarray, group: np.ndarray, groups: int) -> np.ndarray:
    """Sum of the values of each group; ``group`` ascends."""
    upto = np.concatenate([[0], np.cumsum(values)])
    ends = np.searchsorted(group, np.arange(groups + 1))
    return upto[ends[1:]] - upto[ends[:-1]]


def _first_rows(batch: pa.RecordBatch) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Distinct part and text_key, a row of each and the number of its rows."""
    part, key = (batch.column(c).to_numpy() for c in ("part", "text_key"))
    order = np.lexsort((key, part))
    columns, copies = _distinct(key, part)
    return columns[::-1], order[np.cumsum(copies) - copies], copies


def _thresholds(trusted: DataFrame, quantile: float) -> DataFrame:
    """(group, threshold): smallest score step that ``quantile`` of the trusted scores keep to."""
    steps = trusted.groupBy("group", F.ceil(F.col("score") / STEP).alias("step")).count()
    whole = Window.partitionBy("group")
    running = whole.orderBy("step")
    steps = steps.withColumns(
        {"upto": F.sum("count").over(running), "all": F.sum("count").over(whole)}
    )
    kept = steps.where(f"upto >= {quantile} * all AND all >= {MIN_TRUSTED}")
    return kept.groupBy("group").agg((F.min("step") * STEP).alias("threshold"))


def classify_documents(
    docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, prior_chars: int = PRIOR_CHARS
) -> DataFrame:
    """Score and verdict of every whole document.

    ``labels`` (doc_id, quality) name the trusted documents (quality 1; of
    repeated labels the lowest counts). Returns doc_id, text_key, lang,
    n_chars, perplexity (per character), score, threshold, kept. Languages
    without enough trusted documents, and a null language, use the threshold
    of the deviations over all languages. A text without characters has perplexity and score null
    and is rejected as it holds nothing. Without any trusted document nothing
    can be judged and all texts with characters are kept. Rows are told apart
    by doc_id and text; repeated rows repeat their result.
    """
    trusted_ids = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("q"))
    trusted_ids = small(stored(trusted_ids.where("q = 1").selectExpr("doc_id", "true AS trusted")))
    docs = docs.select("doc_id", "lang", "text").join(trusted_ids, "doc_id", "left").withColumn(
        "part", F.expr("if(trusted, cast(xxhash64(coalesce(text, '')) & 1 AS int), 2)")
    )
    with tidy(docs.sparkSession), small_batches(docs.sparkSession):
        model = WordModel(docs.where("part < 2"))
        scored = stored(score_documents(docs, model))
    removed(docs.sparkSession, model.folder)

    trusted = scored.where("part < 2 AND n_chars > 0")
    means = trusted.groupBy("lang").agg((F.sum("nll") / F.sum("n_chars")).alias("mean"))
    overall = trusted.agg((F.sum("nll") / F.sum("n_chars")).alias("overall"))

    def with_score(rows: DataFrame) -> DataFrame:
        rows = rows.alias("s").join(means.alias("m"), F.col("s.lang") == F.col("m.lang"), "left")
        rows = rows.select("s.*", "mean").crossJoin(F.broadcast(overall))  # one row
        prior = f"{prior_chars} * coalesce(mean, overall)"
        return rows.selectExpr(
            "doc_id", "text_key", "lang", "n_chars", "nll",
            f"if(n_chars > 0, (nll + {prior}) / (n_chars + {prior_chars}) - coalesce(mean, overall), "
            "NULL) AS score",
        )

    kept_by = with_score(trusted)
    by_lang = _thresholds(kept_by.selectExpr("lang AS `group`", "score"), quantile)
    over_all = _thresholds(kept_by.selectExpr("'' AS `group`", "score"), quantile)
    over_all = over_all.agg(F.max("threshold").alias("any_threshold"))
    out = with_score(scored).alias("s").join(
        by_lang.alias("t"), F.col("s.lang") == F.col("t.group"), "left"
    )
    out = out.select("s.*", "threshold").crossJoin(F.broadcast(over_all))  # one row
    return out.selectExpr(
        "doc_id",
        "text_key",
        "lang",
        "n_chars",
        "if(n_chars > 0, exp(nll / n_chars), NULL) AS perplexity",
        "score",
        "coalesce(threshold, any_threshold) AS threshold",
        "n_chars > 0 AND coalesce(score <= coalesce(threshold, any_threshold), true) AS kept",
    )


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents that are not rejected, with all their columns."""
    bad = classify_documents(docs, labels, **options).where("NOT kept").select("doc_id", "text_key")
    bad = small(stored(bad.distinct()))
    same = F.col("d.doc_id").eqNullSafe(F.col("b.doc_id")) & (
        F.xxhash64(F.coalesce("d.text", F.lit(""))) == F.col("b.text_key")
    )
    return docs.alias("d").join(bad.alias("b"), same, "left_anti")
