"""Ranked lexical search: term at a time, with a limited number of accumulators.

The documents are read once and become rows of hashed terms with their
frequencies, reduced to terms that some item may hold. Corpus numbers
(documents, terms, documents per term) are counted over these rows by Spark.
Then each task ranks its own documents for a block of items: the terms of an
item are taken rarest first; a document gets an accumulator only while the
bounds of the terms still to come reach the k-th best partial score; after
that only documents with an accumulator are updated, exactly, and those that
cannot reach the k-th score any more are let go. The best of all tasks are
merged by rank.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from trialbraid.llm.arrowtext import slices, term_runs, text_bytes
from trialbraid.llm.shared import stored

#: Results of an item; (item, term) entries that one pass over the documents serves.
BEST = 50
BLOCK_ENTRIES = 250_000
#: Bits of the filter that keeps terms of items: a broadcast of 512 KB at any size.
FILTER_BITS = 22
#: Documents scored together, and groups of tasks whose results are merged first.
BATCH_DOCS = 8192
MERGES = 64


def _filter_bit(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def _term_rows(texts: DataFrame, key: str, wanted: np.ndarray | None = None) -> DataFrame:
    """(key, n, terms, tfs): terms with repeats, distinct hashed terms and their frequencies.

    ``wanted`` are the packed bits of the terms to keep; ``n`` counts all terms.
    """
    shared = None if wanted is None else texts.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if shared is None else np.unpackbits(shared.value).astype(bool)
        for part in slices(batches):
            runs = term_runs(*text_bytes(part.column("text")))
            hashes, owner = runs.hash, runs.text_of()
            if bits is not None:
                kept = bits[_filter_bit(hashes)]
                hashes, owner = hashes[kept], owner[kept]
            order = np.lexsort((hashes, owner))
            hashes, owner = hashes[order], owner[order]
            new = np.ones(len(hashes), bool)
            new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
            at = np.flatnonzero(new)
            bounds = pa.array(np.searchsorted(owner[at], np.arange(part.num_rows + 1)), pa.int32())
            tfs = np.diff(np.append(at, len(hashes)))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(key),
                    pa.array(np.diff(runs.first)),
                    pa.ListArray.from_arrays(bounds, pa.array(hashes[at].view(np.int64))),
                    pa.ListArray.from_arrays(bounds, pa.array(tfs.astype(np.int32))),
                ],
                names=[key, "n", "terms", "tfs"],
            )

    texts = texts.select(key, "text")
    kind = texts.schema[key].dataType.simpleString()
    return texts.mapInArrow(run, f"{key} {kind}, n bigint, terms array<bigint>, tfs array<int>")


def _filter_of(items: DataFrame) -> np.ndarray:
    """The packed filter bits of all terms of the items; at most 2**22 numbers come here."""
    bit = f"cast(shiftrightunsigned(term, {64 - FILTER_BITS}) AS int)"
    seen = items.selectExpr("explode(terms) AS term").selectExpr(f"{bit} AS bit").distinct()
    flags = np.zeros(1 << FILTER_BITS, np.uint8)
    flags[seen.toArrow().column("bit").to_numpy()] = 1
    return np.packbits(flags)


def _block(entries: pa.Table) -> tuple[np.ndarray, ...]:
    """Items with their terms, rarest first, as flat arrays over a sorted vocabulary.

    Items, bounds of their terms, places of the terms in the vocabulary, weights, vocabulary.
    """
    item, term, weight = (entries.column(c).to_numpy() for c in ("item", "term", "w"))
    order = np.lexsort((term, -weight, item))
    item, term, weight = item[order], term[order], weight[order]
    vocabulary, places = np.unique(term, return_inverse=True)
    items, start = np.unique(item, return_index=True)
    return items, np.append(start, len(item)), places, weight, vocabulary


def _postings(batch: pa.RecordBatch, vocabulary: np.ndarray, n_docs: int, n_terms: int):
    """By term of the vocabulary: bounds, rows, tf parts of the score, and the largest part."""
    lists = batch.column("terms")
    terms = lists.flatten().to_numpy(zero_copy_only=False)
    tf = batch.column("tfs").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
    at = np.searchsorted(vocabulary, terms)
    at[at == len(vocabulary)] = 0
    known = vocabulary[at] == terms
    at, tf, row = at[known], tf[known], row[known]
    order = np.argsort(at, kind="stable")
    at, tf, row = at[order], tf[order], row[order]
    n = batch.column("n").to_numpy(zero_copy_only=False)
    m = 100 - 50 + (50 * n * n_docs) // max(n_terms, 1)
    part = (1_000_000_000 * tf) // (1000 * tf + 20 * m[row])
    bounds = np.searchsorted(at, np.arange(len(vocabulary) + 1))
    top = np.zeros(len(vocabulary), np.int64)
    some = np.flatnonzero(np.diff(bounds))
    if len(some):
        top[some] = np.maximum.reduceat(part, bounds[some])
    return bounds, row, part, top


def best_rows(terms, weights, postings, scores: np.ndarray, k: int, floor: int) -> np.ndarray:
    """Rows that may be among the k best for one item; ``scores`` then holds their exact scores.

    ``scores`` is all zero before and is left with the accumulators; ``floor``
    is a score that k documents reach already (0: none known).
    """
    bounds, rows, parts, top = postings
    bound = weights * top[terms]
    rest = np.append(np.cumsum(bound[::-1])[::-1], 0)
    kth, j = floor, 0
    # New accumulators, as long as a document without one could still be among the k best.
    while j < len(terms) and rest[j] >= kth and rest[j]:
        low, high = bounds[terms[j]], bounds[terms[j] + 1]
        scores[rows[low:high]] += weights[j] * parts[low:high]
        j += 1
        if len(scores) > k and scores.max(initial=0) > rest[j]:
            kth = max(kth, int(np.partition(scores, -k)[-k]))
    found = np.flatnonzero(scores)
    # The survivors are updated term by term.
    while j < len(terms) and rest[j] and len(found):
        found = found[scores[found] + rest[j] >= kth]
        low, high = bounds[terms[j]], bounds[terms[j] + 1]
        own = rows[low:high]
        at = np.searchsorted(own, found)
        at[at == len(own)] = 0
        met = own[at] == found if len(own) else np.zeros(len(found), bool)
        scores[found[met]] += weights[j] * parts[low:high][at[met]]
        j += 1
    found = found[scores[found] >= max(kth, 1)]
    if len(found) > k:
        found = found[scores[found] >= np.partition(scores[found], -k)[-k]]
    return found


def _best_first(pair):
    score, doc = pair
    return (-score, doc is not None, doc)


def _search(rows: DataFrame, block: tuple, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """(item, doc_id, score): the k best documents of every task for every item of the block."""
    shared = rows.sparkSession.sparkContext.broadcast(block)
    kind = rows.schema["doc_id"].dataType
    id_type = to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, bounds, places, weights, vocabulary = shared.value
        best: list[list] = [[] for _ in items]
        for whole in batches:
            for low in range(0, whole.num_rows, BATCH_DOCS):
                batch = whole.slice(low, BATCH_DOCS)
                postings = _postings(batch, vocabulary, n_docs, n_terms)
                ids = batch.column("doc_id")
                scores = np.zeros(batch.num_rows, np.int64)
                for i in range(len(items)):
                    some = slice(bounds[i], bounds[i + 1])
                    floor = best[i][-1][0] if len(best[i]) == k else 0
                    found = best_rows(places[some], weights[some], postings, scores, k, floor)
                    if len(found):
                        pairs = zip(scores[found].tolist(), ids.take(pa.array(found)).to_pylist())
                        best[i] = sorted([*best[i], *pairs], key=_best_first)[:k]
                    scores[:] = 0
        item = np.repeat(items, [len(b) for b in best])
        flat = [pair for b in best for pair in b]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(item, pa.int64()),
                pa.array([d for _, d in flat], id_type),
                pa.array([s for s, _ in flat], pa.int64()),
            ],
            names=["item", "doc_id", "score"],
        )

    schema = f"item bigint, doc_id {kind.simpleString()}, score bigint"
    return rows.select("doc_id", "n", "terms", "tfs").mapInArrow(run, schema)


def _ranked(found: DataFrame, k: int, *group: str) -> DataFrame:
    order = Window.partitionBy(*group).orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(f"rank <= {k}")


def search(docs: DataFrame, items: DataFrame, k: int = BEST, entries: int = BLOCK_ENTRIES) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of every item, scores above 0.

    A term is a run of ASCII digits, letters and characters above ASCII, A-Z
    lower-cased. Every row of ``docs`` (doc_id, text) is a document and every
    row of ``items`` (item_id, text) an item, so repeated rows repeat in the
    results. Equal scores stand by doc_id, a null doc_id first. A null or
    empty text has no terms; items without a term that some document holds
    have no result. Other columns are not read.

    Terms are compared by 64-bit hashes. Items are served in blocks of about
    ``entries`` terms, one pass over the reduced documents each.
    """
    numbered = items.select("item_id", "text").withColumn("item", F.monotonically_increasing_id())
    numbered = stored(numbered)
    asked = stored(_term_rows(numbered.select("item", "text"), "item"))
    rows = stored(_term_rows(docs, "doc_id", _filter_of(asked)))
    n_docs, n_terms = rows.selectExpr("count_if(n > 0)", "coalesce(sum(n), 0L)").first()

    held = rows.selectExpr("explode(terms) AS term").groupBy("term").agg(F.count("*").alias("df"))
    weight = f"cast(floor(1000 * ln((2 * {n_docs}D + 2) / (2 * df + 1))) AS bigint)"
    weighed = held.selectExpr("term", f"{weight} AS w")
    weighed = asked.selectExpr("item", "explode(terms) AS term").join(weighed, "term")
    weighed = stored(weighed)
    blocks = max(1, -(-weighed.count() // entries))
    found = None
    for b in range(blocks):
        part = weighed.where(f"pmod(xxhash64(item), {blocks}) = {b}")
        own = _search(rows, _block(part.toArrow()), n_docs, n_terms, k)
        found = own if found is None else found.union(own)
    # Two steps, so that no task reads the results of all tasks for one item.
    found = found.withColumn("merge", F.expr(f"pmod(spark_partition_id(), {MERGES})"))
    found = _ranked(_ranked(found, k, "item", "merge").drop("rank", "merge"), k, "item")
    return found.join(numbered.select("item", "item_id"), "item").select(
        "item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"
    )
