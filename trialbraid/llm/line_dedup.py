"""Line dedup by pairwise alignment.

Every run of consecutive lines that just reaches ``MIN_WORDS`` words, counted
from its first line on or from its last line back, is an anchor. All holders of
an anchor are paired with its first holder only, so an anchor that a third of
the documents share costs one pair per document. No block is lost by that: each
line of a block that two documents share stands in an anchor within the block
(that of the block's first line, or the one that ends with the line), and the
first holder of that anchor has the line too. Each pair is aligned over
its lines; all common blocks of at least ``MIN_WORDS`` words go from the later
document. One rising chain of lines, as patience diff takes it, would leave out
blocks that are moved, repeated or crossed by short lines, so every maximal
common run is taken instead. What is left is aligned again.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialbraid.llm.arrowtext import lines, mix, slices, text_bytes, words
from trialbraid.llm.shared import small, small_batches, stored

#: Words of a common block that is worth deleting. Shorter shared lines
#: (headings, licences, menus) also stand in clean documents.
MIN_WORDS = 30

#: Order of documents: doc_id, null last; texts of one doc_id by their hash.
_ORDER = ["no_id", "id", "text_key"]


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumns(
        {
            "no_id": F.col("doc_id").isNull(),
            "id": F.coalesce("doc_id", F.lit(0)),
            "text_key": F.xxhash64(F.coalesce("text", F.lit(""))),
        }
    )


def _line_table(docs: DataFrame, min_words: int) -> DataFrame:
    """Per document: hash, words and place of each line with a word, and its anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            data, offsets = text_bytes(part.column("text"))
            line, word = lines(data, offsets), words(data, offsets)
            n_words = np.searchsorted(word.start, line.end) - np.searchsorted(word.start, line.start)
            breaks = np.concatenate([[0], np.cumsum(data == 0x0A)])
            place = breaks[line.start] - np.repeat(breaks[offsets[:-1]], np.diff(line.first))
            full = np.flatnonzero(n_words > 0)
            hashes, n_words, place = line.hash[full], n_words[full], place[full]
            first = np.searchsorted(full, line.first)
            # The anchors of a line end, or start, with the first line that brings enough words.
            total = np.concatenate([[0], np.cumsum(n_words)])
            end = np.searchsorted(total, total[:-1] + min_words)
            start = np.searchsorted(total, total[1:] - min_words, "right") - 1
            anchors = []
            for a, b in zip(first[:-1], first[1:]):
                runs = {(i, e) for i, e in zip(range(a, b), end[a:b].tolist()) if e <= b}
                runs |= {(i, e + 1) for i, e in zip(start[a:b].tolist(), range(a, b)) if i >= a}
                anchors.append([_chain(hashes[i:e]) for i, e in runs])
            offsets32 = pa.array(first.astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    *(part.column(c) for c in _ORDER),
                    pa.ListArray.from_arrays(offsets32, pa.array(hashes.view(np.int64))),
                    pa.ListArray.from_arrays(offsets32, pa.array(n_words.astype(np.int32))),
                    pa.ListArray.from_arrays(offsets32, pa.array(place.astype(np.int32))),
                    pa.array([sorted(set(a)) for a in anchors], pa.list_(pa.int64())),
                ],
                names=[*_ORDER, "hashes", "words", "places", "anchors"],
            )

    return docs.select(*_ORDER, "text").mapInArrow(
        run,
        "no_id boolean, id bigint, text_key bigint, hashes array<bigint>, words array<int>, "
        "places array<int>, anchors array<bigint>",
    )


def _chain(hashes: np.ndarray) -> int:
    """One hash of a run of line hashes."""
    value = np.uint64(len(hashes))
    with np.errstate(over="ignore"):
        for h in hashes:
            value = value * np.uint64(0x9DDFEA08EB382D69) + h
    return int(mix(np.array([value]))[:1].view(np.int64)[0])


def _substrings(symbols: Sequence[object]) -> tuple[list[dict], list[int], list[int]]:
    """Transitions, suffix links and lengths of the suffix automaton of a sequence."""
    step: list[dict] = [{}]
    link, length = [-1], [0]
    last = 0
    for s in symbols:
        new = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and s not in step[p]:
            step[p][s] = new
            p = link[p]
        if p >= 0:
            q = step[p][s]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                clone = len(step)
                step.append(dict(step[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and step[p].get(s) == q:
                    step[p][s] = clone
                    p = link[p]
                link[q] = link[new] = clone
        last = new
    return step, link, length


def common_blocks(
    earlier: Sequence[int], later: Sequence[int], n_words: Sequence[int], min_words: int = MIN_WORDS
) -> list[int]:
    """Indexes of the lines of the later document that stand in common blocks.

    A block is a run of lines that follow each other in both documents. All
    blocks of ``min_words`` words are found, wherever they stand: at each line
    of the later document the suffix automaton of the earlier one gives the
    longest run that ends there. After each pass the rest is aligned anew with
    the whole earlier document.
    """
    known = set(later)
    # Lines that the later document lacks only part the runs.
    shared = [h if h in known else None for h in earlier]
    shared = [h for i, h in enumerate(shared) if h is not None or (i and shared[i - 1] is not None)]
    step, link, length = _substrings(shared)
    left = list(range(len(later)))
    deleted: list[int] = []
    while left:
        total = [0, *accumulate(n_words[j] for j in left)]
        found: list[int] = []
        state = matched = done = 0
        for k, j in enumerate(left):
            while state and later[j] not in step[state]:
                state = link[state]
                matched = length[state]
            if later[j] in step[state]:
                state = step[state][later[j]]
                matched += 1
            start = k + 1 - matched
            if matched and total[k + 1] - total[start] >= min_words:
                # Starts never fall, so what lies before ``done`` is settled.
                found += left[max(start, done) : k + 1]
                done = k + 1
        if not found:
            break
        deleted += found
        gone = set(found)
        left = [j for j in left if j not in gone]
    return sorted(deleted)


def _alignments(pairs: DataFrame, min_words: int) -> DataFrame:
    """Places of deleted lines of the later document of each pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, counts = [], []
            for i in range(batch.num_rows):
                # Values of one row at a time; as Python's numbers those of a batch take much.
                e, h, w, p = (batch.column(c)[i].as_py() for c in ("earlier", "hashes", "words", "places"))
                found = common_blocks(e, h, w, min_words)
                places.append([p[j] for j in found])
                counts.append([w[j] for j in found])
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in _ORDER),
                    pa.array(places, pa.list_(pa.int32())),
                    pa.array(counts, pa.list_(pa.int32())),
                ],
                names=[*_ORDER, "deleted", "n"],
            )

    return pairs.mapInArrow(
        run, "no_id boolean, id bigint, text_key bigint, deleted array<int>, n array<int>"
    )


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Documents without the blocks of lines that earlier documents hold.

    Returns all columns of ``docs`` with the new ``text``, and n_lines,
    n_deleted, n_deleted_words, emptied (every line with a word was deleted).
    Lines end at \\n only. Earlier means a smaller doc_id, null last; of
    different texts with one doc_id, the smaller hash. Rows equal in doc_id and
    text are one document and keep the same result. A null text stays null, an
    empty one empty. An input column named like an added one is replaced.
    """
    own = docs.columns
    keyed = _keyed(docs)
    with small_batches(docs.sparkSession):
        table = stored(_line_table(keyed, min_words))
    anchors = table.select(F.struct(*_ORDER).alias("doc"), F.explode("anchors").alias("anchor"))
    first = anchors.groupBy("anchor").agg(F.min("doc").alias("first"), F.max("doc").alias("last"))
    first = stored(first.where("first != last").select("anchor", "first"))
    pairs = anchors.join(first, "anchor").where("doc != first").select("doc", "first").distinct()
    pairs = pairs.select("doc.*", *[F.col(f"first.{c}").alias(f"e_{c}") for c in _ORDER])
    shapes = table.drop("anchors").dropDuplicates(_ORDER)
    earlier = shapes.select(
        *[F.col(c).alias(f"e_{c}") for c in _ORDER], F.col("hashes").alias("earlier")
    )
    joined = pairs.join(shapes, _ORDER).join(earlier, [f"e_{c}" for c in _ORDER])
    deleted = _alignments(joined, min_words).where("size(deleted) > 0")
    deleted = (
        deleted.selectExpr(*_ORDER, "explode(arrays_zip(deleted, n)) AS line")
        .groupBy(*_ORDER)
        .agg(F.collect_set("line").alias("gone"))
    )
    with small_batches(docs.sparkSession):
        deleted = stored(deleted)
    deleted = small(deleted, "count(*) + sum(size(gone))")

    cut = keyed.join(deleted, _ORDER, "left")
    cut = cut.withColumn("old_lines", F.expr("split(text, '\\n', -1)"))
    kept = (
        "transform(array_except(sequence(0, size(old_lines) - 1), gone.deleted), i -> old_lines[i])"
    )
    added = {
        "text": f"if(gone IS NULL, text, array_join({kept}, '\\n'))",
        "n_lines": "cast(coalesce(size(old_lines), 0) AS bigint)",
        "n_deleted": "cast(coalesce(size(gone), 0) AS bigint)",
        "n_deleted_words": "cast(coalesce(aggregate(gone.n, 0, (a, x) -> a + x), 0) AS bigint)",
    }
    others = [f"`{c}`" for c in own if c not in [*added, "emptied"]]
    cut = cut.selectExpr(*others, *[f"{e} AS {c}" for c, e in added.items()])
    return cut.withColumn(
        "emptied", F.expr(r"n_deleted > 0 AND NOT text RLIKE '[^\\x20\\x09-\\x0D]'")
    )


def without_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The documents with their repeated blocks deleted, without those that held nothing else.

    All columns stay; where there is an ``n_chars``, it follows the text.
    """
    kept = dedup_lines(docs, min_words).where("NOT coalesce(emptied, false)")
    if "n_chars" in docs.columns:
        length = F.when(F.col("n_deleted") > 0, F.length("text")).otherwise(F.col("n_chars"))
        kept = kept.withColumn("n_chars", length.cast(docs.schema["n_chars"].dataType))
    return kept.select(docs.columns)
