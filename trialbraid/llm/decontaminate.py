"""Benchmark decontamination by winnowed fingerprints.

Winnowing keeps the smallest hash of every ``WINDOW`` consecutive k-grams. Two
texts that share ``GRAM + WINDOW - 1`` words in a row share such a minimum, so
with 5 and 9 every shared run of 13 words is found. Documents that share a
fingerprint with an item are then read again and the hits are extended: the
positions of the full windows of the items are looked up word by word. Items
shorter than a window are one window each; one document gram length is added
for each such length. Everything is SQL functions on arrays, so words never
leave the JVM, and only fingerprints are joined.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trialbraid.llm.shared import small, stored

#: Words of a full window, of a k-gram, and k-grams of a winnowing window.
SPAN = 13
GRAM = 5
WINDOW = SPAN - GRAM + 1
#: Words are runs of digits, letters and all characters above ASCII.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _grams(words: str, length: int, salt: int = 0) -> str:
    """SQL: hashes of all runs of ``length`` words, by position; no run is copied."""
    seed = f"{salt}, " if salt else ""
    behind = "".join(f", get({words}, i + {j})" for j in range(1, length))
    return (
        f"transform(slice({words}, 1, greatest(size({words}) - {length - 1}, 0)), "
        f"(x, i) -> xxhash64({seed}x{behind}))"
    )


def _least(values: str, step: int, count: int) -> str:
    """SQL: by position, the least of ``count`` values that lie ``step`` apart."""
    behind = ", ".join(f"get({values}, i + {step * j})" for j in range(1, count))
    return f"transform({values}, (x, i) -> least(x, {behind}))"


def _prints(texts: DataFrame, *keep: str) -> DataFrame:
    """Number of words, distinct minima of all winnowing windows, and hashes of the words.

    The words are taken once; a word's case is folded alone, so equal words stay equal.
    """
    words = texts.selectExpr(*keep, f"regexp_extract_all(text, r'{WORD}', 0) AS words")
    words = words.selectExpr(*keep, "transform(words, w -> xxhash64(lower(w))) AS hashes")
    grams = words.selectExpr(*keep, "hashes", f"{_grams('hashes', GRAM)} AS grams")
    # A window of nine grams is three neighbours of three.
    three = grams.selectExpr(*keep, "hashes", f"{_least('grams', 1, 3)} AS three")
    nine = three.selectExpr(*keep, "hashes", f"{_least('three', 3, WINDOW // 3)} AS nine")
    return nine.selectExpr(
        *keep,
        "cast(size(hashes) AS bigint) AS n_words",
        f"array_distinct(slice(nine, 1, greatest(size(nine) - {WINDOW - 1}, 0))) AS prints",
        "hashes",
    )


def _exact_words(texts: DataFrame, *keep: str) -> DataFrame:
    """Words with A-Z lower-cased and nothing else."""
    return texts.selectExpr(
        *keep,
        f"transform(regexp_extract_all(text, r'{WORD}', 0), "
        f"w -> translate(w, '{_UPPER}', '{_LOWER}')) AS words",
    )


def _positions(words: DataFrame, length: int, *keep: str) -> DataFrame:
    """Every run of ``length`` words as 128 bits, with its position.

    The outer form, because below a plain explode the optimizer puts a test of
    the array that computes it a second time, with the words inside of it anew.
    """
    pairs = words.selectExpr(
        *keep,
        f"posexplode_outer(arrays_zip({_grams('words', length)}, {_grams('words', length, 1)})) "
        "AS (pos, run)",
    )
    pairs = pairs.where("pos IS NOT NULL")
    return pairs.selectExpr(*keep, "pos", f"{length} AS len", "run.`0` AS h1", "run.`1` AS h2")


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Words of every whole document that stand inside a window of an item.

    Returns doc_id, text_key, n_words, n_hit, n_items, item_ids (sorted as strings),
    contaminated (n_hit > 0 and 20 * n_hit >= n_words). A null text has no
    words. Rows are told apart by doc_id (null included) and text, so repeated
    rows repeat their result. An empty benchmark hits nothing; items without
    words are ignored. A null item_id hits as any other, but item_ids and n_items
    leave it out. Other columns are not read.
    """
    docs = docs.selectExpr(
        "doc_id", "coalesce(text, '') AS text", "xxhash64(coalesce(text, '')) AS text_key"
    )
    items = _exact_words(benchmark.select("item_id", "text"), "item_id").where("size(words) > 0")
    items = stored(items)
    short = sorted(
        r.n for r in items.selectExpr("size(words) AS n").where(f"n < {SPAN}").distinct().collect()
    )

    # Documents that share a fingerprint, or the whole of a short item. All words are hashed
    # once; the hashes themselves are stored only where short items look them up.
    hashed = _prints(docs, "doc_id", "text_key")
    hashed = stored(hashed if short else hashed.drop("hashes"))
    prints = _prints(benchmark, "item_id").selectExpr("explode_outer(prints) AS print").distinct()
    found = hashed.selectExpr("doc_id", "text_key", "explode_outer(prints) AS print")
    suspects = found.join(prints, "print", "left_semi").select("doc_id", "text_key")
    for n in short:
        own = items.where(f"size(words) = {n}").selectExpr(
            f"explode_outer({_grams('transform(words, w -> xxhash64(lower(w)))', n)}) AS print"
        )
        grams = hashed.selectExpr("doc_id", "text_key", f"explode_outer({_grams('hashes', n)}) AS print")
        own = own.distinct()
        suspects = suspects.union(grams.join(own, "print", "left_semi").select("doc_id", "text_key"))
    suspects = stored(suspects.distinct())

    # Positions of the full windows in these documents.
    same = (F.col("d.doc_id").eqNullSafe(F.col("s.doc_id"))) & (
        F.col("d.text_key") == F.col("s.text_key")
    )
    again = docs.alias("d").join(small(suspects).alias("s"), same, "left_semi")
    words = _exact_words(again, "doc_id", "text_key")
    hits = None
    for n in [*short, SPAN]:
        wanted = items.where(f"size(words) {'>=' if n == SPAN else '='} {n}")
        # Broadcast where measured as small, so that shared passages move no words of documents.
        wanted = small(stored(_positions(wanted, n, "item_id").drop("pos").distinct()))
        met = _positions(words, n, "doc_id", "text_key").join(wanted, ["len", "h1", "h2"])
        met = met.select("doc_id", "text_key", "pos", "len", "item_id")
        hits = met if hits is None else hits.union(met)
    hits = stored(hits)

    row = ["doc_id", "text_key"]
    before = Window.partitionBy(*row).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    spans = hits.groupBy(*row, "pos").agg((F.col("pos") + F.max("len")).alias("end"))
    covered = spans.withColumn("from", F.greatest("pos", F.coalesce(F.max("end").over(before), F.lit(0))))
    n_hit = covered.groupBy(*row).agg(F.sum(F.greatest(F.col("end") - F.col("from"), F.lit(0))).alias("n_hit"))
    by_item = hits.groupBy(*row).agg(
        F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("item_ids")
    )
    summary = n_hit.alias("a").join(
        by_item.alias("b"),
        F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.text_key") == F.col("b.text_key")),
    )
    summary = summary.selectExpr("a.doc_id", "a.text_key", "n_hit", "item_ids")
    counted = hashed.select("doc_id", "text_key", "n_words")
    result = counted.alias("d").join(summary.alias("s"), same, "left")
    return result.selectExpr(
        "d.doc_id",
        "d.text_key",
        "n_words",
        "coalesce(n_hit, 0L) AS n_hit",
        "cast(coalesce(size(item_ids), 0) AS bigint) AS n_items",
        "coalesce(item_ids, array()) AS item_ids",
        "coalesce(n_hit, 0L) > 0 AND 20 * coalesce(n_hit, 0L) >= n_words AS contaminated",
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that are not contaminated, with all their columns."""
    bad = decontaminate(docs, benchmark).where("contaminated").select("doc_id", "text_key")
    same = F.col("d.doc_id").eqNullSafe(F.col("b.doc_id")) & (
        F.xxhash64(F.coalesce("d.text", F.lit(""))) == F.col("b.text_key")
    )
    return docs.alias("d").join(small(stored(bad.distinct())).alias("b"), same, "left_anti")
