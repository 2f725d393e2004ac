"""N-gram Jaccard join over count-vector R-trees.

The shingles of a document are hashed into ``GROUPS`` groups; the counts of the
groups are a point. The overlap of two sets is at most the sum of the smaller
coordinates of their points, and so at most that sum with the upper corner of
a box of points. A link needs an overlap of 4/9 of both sizes together (at 0.8),
which prunes boxes, then points; only surviving pairs are compared in full.

One tree over all documents cannot be searched in reasonable time: most
documents of one size have points of about equal distance, so their boxes
always meet the bound. The top of the tree is therefore a partition by shared
shingle. Linked sets share one of the first fifth of their shingles under any
common order (here: thin groups of a corpus-wide count vector first, so widely
shared passages come last). Each such cell holds an R-tree of its own.

1. Sets that are equal are one node.
2. Every member of a cell is compared with the cell's centre, the member that
   shares most shingles with others, through the bound and then in full. Links give components: a group of thousands
   of near copies takes one comparison per copy and cell, not all pairs.
3. Cells whose other members lie in several components are joined within by
   their R-tree, in blocks of bounded size, and survivors compared in full.
   No link is lost: of two linked sets, either a common cell has already put
   them into one component, or they are compared here.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trialbraid.llm.arrowtext import Runs, mix, shingles, slices, text_bytes, words
from trialbraid.llm.components import connected_components
from trialbraid.llm.shared import small, small_batches, stored

#: Words of a shingle.
WIDTH = 5
#: Coordinates of a point, and of the folded points (sums of neighbours) in the nodes of a tree.
GROUPS = 256
FOLDED = 64
#: Groups of the corpus-wide count vector; its logarithms are a broadcast of this many bytes.
CORPUS_GROUPS = 1 << 18
#: Points of a leaf of a tree, and points of a block of a cell.
LEAF = 32
BLOCK = 4096


def _sets(part: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles of all texts of a slice, and the bounds of each text."""
    data, offsets = text_bytes(part.column("text"))
    runs = words(data, offsets, lower=True)
    value, at = shingles(runs, width)
    text = runs.text_of()[at]
    # A text of fewer words has its whole sequence as one shingle.
    n_words = np.diff(runs.first)
    for n in range(1, width):
        short = np.flatnonzero(n_words == n)
        if len(short):
            own = runs.hash[(runs.first[short][:, None] + np.arange(n)).ravel()]
            alone = Runs(own, own, own, np.arange(len(short) + 1) * n)
            value = np.concatenate([value, shingles(alone, n)[0]])
            text = np.concatenate([text, short])
    order = np.lexsort((value, text))
    value, text = value[order], text[order]
    fresh = np.ones(len(value), bool)
    fresh[1:] = (value[1:] != value[:-1]) | (text[1:] != text[:-1])
    value, text = value[fresh], text[fresh]
    return value, np.searchsorted(text, np.arange(part.num_rows + 1))


def _corpus_counts(docs: DataFrame, width: int) -> np.ndarray:
    """Logarithms of the shingles per group over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CORPUS_GROUPS, np.int64)
        for part in slices(batches):
            value, _ = _sets(part, width)
            total += np.bincount(
                (value % np.uint64(CORPUS_GROUPS)).astype(np.int64), minlength=CORPUS_GROUPS
            )
        group = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(group), pa.array(total[group])], names=["g", "n"])

    counts = docs.select("text").mapInArrow(run, "g bigint, n bigint").groupBy("g").agg(F.sum("n").alias("n"))
    # At most CORPUS_GROUPS rows, whatever the input.
    table = counts.toArrow()
    out = np.zeros(CORPUS_GROUPS)
    out[table["g"].to_numpy()] = table["n"].to_numpy()
    return np.minimum(np.log2(out + 1) * 8, 255).astype(np.uint8)


def _shapes(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Per document: size, hash and point of its set, and its rarest shingles."""
    heat = _corpus_counts(docs, width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            value, bounds = _sets(part, width)
            n = np.diff(bounds)
            text = np.repeat(np.arange(len(n)), n)
            total = np.zeros((2, len(value) + 1), np.uint64)
            np.cumsum(mix(value + np.uint64(1)), out=total[0, 1:])
            np.cumsum(mix(value ^ np.uint64(0x5851F42D4C957F2D)), out=total[1, 1:])
            h1, h2 = ((t[bounds[1:]] - t[bounds[:-1]]).view(np.int64) for t in total)
            spread = (mix(value) >> np.uint64(40)).astype(np.int64) % GROUPS
            points = np.bincount(text * GROUPS + spread, minlength=len(n) * GROUPS)
            points = points.reshape(len(n), GROUPS).astype("<u4")
            keep = np.where(n > 3, n - -(-n * percent // 100) + 1, 0)
            cold = heat[(value % np.uint64(CORPUS_GROUPS)).astype(np.int64)]
            order = np.lexsort((value, cold, text))
            rank = np.arange(len(value)) - np.repeat(bounds[:-1], n)
            first = value[order][rank < np.repeat(keep, n)].view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    pa.array(n.astype(np.int64)),
                    pa.array(h1),
                    pa.array(h2),
                    pa.array([p.tobytes() for p in points], pa.binary()),
                    pa.ListArray.from_arrays(
                        pa.array(np.concatenate([[0], np.cumsum(keep)]).astype(np.int32)), pa.array(first)
                    ),
                ],
                names=["doc_id", "n", "h1", "h2", "point", "rare"],
            )

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id bigint, n bigint, h1 bigint, h2 bigint, point binary, rare array<bigint>"
    )


def overlap_bound(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Largest possible overlap of sets: the sum of the smaller coordinates."""
    return np.minimum(a, b).sum(-1, dtype=np.int64)


def _folded(points: np.ndarray) -> np.ndarray:
    return points.reshape(len(points), FOLDED, -1).sum(-1)


def _may_link(overlap: np.ndarray, sizes: np.ndarray, percent: int) -> np.ndarray:
    """100 * i >= percent * (a + b - i) for the largest possible overlap i."""
    return (100 + percent) * overlap >= percent * sizes


def tree_pairs(
    points: np.ndarray, sizes: np.ndarray, queries: np.ndarray, query_sizes: np.ndarray, percent: int
) -> tuple[np.ndarray, np.ndarray]:
    """(query, point) indexes whose overlap bound admits a link, by an R-tree of the points.

    Leaves are packed by size and then by the halves with the larger share of
    the coordinates; each node keeps the upper corner and the smallest size.
    Nodes are pruned by folded points, pairs by the folded and the full ones.
    """
    full, full_queries = points, queries
    points, queries = _folded(points), _folded(queries)
    lean = points[:, : points.shape[1] // 2].sum(1) / np.maximum(sizes, 1)
    slab = np.argsort(sizes, kind="stable")
    width = LEAF * max(int(np.sqrt(len(sizes) / LEAF)), 1)
    order = np.concatenate(
        [s[np.argsort(lean[s], kind="stable")] for s in np.split(slab, range(width, len(slab), width))]
    )
    starts = np.arange(0, len(order), LEAF)
    corner = np.maximum.reduceat(points[order], starts, axis=0)
    least = np.minimum.reduceat(sizes[order], starts)
    hits_q, hits_p = [], []
    for low in range(0, len(queries), 256):
        q, nq = queries[low : low + 256], query_sizes[low : low + 256]
        # An inner node is the corner of LEAF leaves; its leaves are visited where it may link.
        inner = np.arange(0, len(starts), LEAF)
        top = np.maximum.reduceat(corner, inner, axis=0)
        top_least = np.minimum.reduceat(least, inner)
        open_q, open_n = np.nonzero(
            _may_link(overlap_bound(q[:, None], top[None]), nq[:, None] + top_least[None], percent)
        )
        for node in np.unique(open_n):
            own = open_q[open_n == node]
            leaf = np.arange(inner[node], min(inner[node] + LEAF, len(starts)))
            in_q, in_l = np.nonzero(
                _may_link(
                    overlap_bound(q[own][:, None], corner[leaf][None]),
                    nq[own][:, None] + least[leaf][None],
                    percent,
                )
            )
            for k in np.unique(in_l):
                mine = own[in_q[in_l == k]]
                members = order[starts[leaf[k]] : starts[leaf[k]] + LEAF]
                at_q, at_p = np.nonzero(
                    _may_link(
                        overlap_bound(q[mine][:, None], points[members][None]),
                        nq[mine][:, None] + sizes[members][None],
                        percent,
                    )
                )
                at_q, at_p = low + mine[at_q], members[at_p]
                fine = _may_link(
                    overlap_bound(full_queries[at_q], full[at_p]), query_sizes[at_q] + sizes[at_p], percent
                )
                hits_q.append(at_q[fine])
                hits_p.append(at_p[fine])
    none = np.empty(0, np.int64)
    return np.concatenate([none, *hits_q]), np.concatenate([none, *hits_p])


def _points(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u4").reshape(-1, GROUPS)


def _within_bound(pairs: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose points admit a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = _points(batch.column("pa")), _points(batch.column("pb"))
            sizes = a.sum(1, dtype=np.int64) + b.sum(1, dtype=np.int64)
            keep = pa.array(_may_link(overlap_bound(a, b), sizes, percent))
            yield batch.select(["a", "b"]).filter(keep)

    return pairs.mapInArrow(run, "a bigint, b bigint")


def _compare(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Pairs (a, b) of documents that link, by their full sets."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            value, bounds = _sets(part, width)
            raw = value.tobytes()
            cut = [raw[8 * i : 8 * j] for i, j in zip(bounds[:-1], bounds[1:])]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(cut, pa.binary())], names=["id", "members"]
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for x, y in zip(batch.column("ma").to_pylist(), batch.column("mb").to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))

    wanted = stored(pairs.selectExpr("explode(array(a, b)) AS id").distinct())
    texts = docs.join(small(wanted), docs.doc_id == wanted.id, "left_semi").select("doc_id", "text")
    full = stored(texts.mapInArrow(sets, "id bigint, members binary"))
    joined = pairs.join(full.select(F.col("id").alias("b"), F.col("members").alias("mb")), "b")
    joined = joined.join(full.select(F.col("id").alias("a"), F.col("members").alias("ma")), "a")
    return joined.select("a", "b", "ma", "mb").mapInArrow(run, "a bigint, b bigint")


def _cell_pairs(cells: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components within the blocks of each cell, by its R-tree."""

    def run(group: pa.Table) -> pa.Table:
        own = group.column("own").to_numpy(zero_copy_only=False)
        ids, parts = group.column("id").to_numpy(), group.column("component").to_numpy()
        points = _points(group.column("point"))
        sizes = points.sum(1, dtype=np.int64)
        mine = np.flatnonzero(own)
        q, p = tree_pairs(points[mine], sizes[mine], points, sizes, percent)
        p = mine[p]
        keep = (ids[q] < ids[p]) & (parts[q] != parts[p])
        return pa.table({"a": ids[q][keep], "b": ids[p][keep]})

    sized = cells.groupBy("token").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    spread = cells.join(sized, "token").selectExpr(
        "*", "explode(sequence(0L, blocks - 1)) AS block", "pmod(xxhash64(id), blocks) AS home"
    )
    spread = spread.selectExpr("token", "block", "id", "component", "point", "home = block AS own")
    return spread.groupBy("token", "block").applyInArrow(run, "a bigint, b bigint")


def join_documents(docs: DataFrame, width: int = WIDTH, percent: int = 80) -> DataFrame:
    """Components of documents whose shingle sets have a Jaccard similarity of ``percent`` or more.

    Returns doc_id, n_shingles, component_id (smallest doc_id reachable by
    links), n_copies (documents with the same set). A null, empty or wordless
    text has no shingles and links with nothing. A null doc_id is never linked
    and has a null component. Rows with one doc_id are one node: their texts'
    links hold together. Other columns are not read.
    """
    with small_batches(docs.sparkSession):
        return _joined(docs, width, percent)


def _joined(docs: DataFrame, width: int, percent: int) -> DataFrame:
    shapes = stored(_shapes(docs, width, percent))
    known = shapes.where("n > 0 AND doc_id IS NOT NULL")
    sets = known.groupBy("h1", "h2", "n").agg(
        F.min("doc_id").alias("id"), F.count("*").alias("n_copies")
    )
    sets = stored(sets)
    nodes = known.join(sets, ["h1", "h2", "n"]).where("doc_id = id").dropDuplicates(["id", "h1", "h2"])
    # Shingles of at least two different sets; copies collapse before the shuffle.
    shared = known.selectExpr("h1", "explode(rare) AS token").groupBy("token")
    shared = shared.agg(F.min("h1").alias("x"), F.max("h1").alias("y"), F.count("*").alias("n"))
    shared = stored(shared.where("x != y").select("token", "n"))
    cells = stored(nodes.selectExpr("id", "explode(rare) AS token").join(shared, "token"))
    # The member with the most company is the one that others were copied from, if any was.
    weight = cells.groupBy("id").agg(F.sum("n").alias("w"))
    centre = cells.join(weight, "id").groupBy("token").agg(F.max_by("id", "w").alias("first"))
    cells = cells.select("token", "id").join(stored(centre), "token")
    points = stored(nodes.select("id", "point"))

    def compared(pairs: DataFrame) -> DataFrame:
        near = pairs.join(points.selectExpr("id AS a", "point AS pa"), "a")
        near = near.join(points.selectExpr("id AS b", "point AS pb"), "b")
        near = stored(_within_bound(near.select("a", "b", "pa", "pb"), percent))
        return _compare(near, docs, width, percent)

    stars = cells.where("first != id").selectExpr("least(first, id) AS a", "greatest(first, id) AS b")
    stars = stars.distinct()
    # Texts of one doc_id hold together.
    same = known.join(sets, ["h1", "h2", "n"]).groupBy("doc_id").agg(
        F.min("id").alias("a"), F.max("id").alias("b")
    )
    links = stored(compared(stars).union(same.where("a != b").select("a", "b")))
    component = connected_components(links)

    # Cells whose members besides the centre still lie in several components.
    rest = cells.where("first != id").join(component, "id", "left")
    rest = rest.selectExpr("token", "id", "coalesce(component, id) AS component").distinct()
    split = rest.groupBy("token").agg(
        F.min("component").alias("x"),
        F.max("component").alias("y"),
        F.count("*").alias("members"),
        F.expr("bit_xor(xxhash64(id))").alias("u"),
        F.expr("bit_xor(xxhash64(id, 1))").alias("v"),
    )
    # Of cells with the same members (the shingles of one shared passage) one is enough.
    split = split.where("x != y").groupBy("members", "u", "v").agg(F.min("token").alias("token"))
    rest = stored(rest.join(stored(split.select("token")), "token", "left_semi"))
    pairs = _cell_pairs(rest.join(points, "id"), percent).distinct()
    more = stored(compared(pairs))
    component = connected_components(links.union(more))

    labels = sets.join(component, "id", "left").selectExpr(
        "h1", "h2", "n", "coalesce(component, id) AS component_id", "n_copies"
    )
    linked = known.join(labels, ["h1", "h2", "n"]).selectExpr(
        "doc_id", "n AS n_shingles", "component_id", "n_copies"
    )
    alone = shapes.where("n = 0 OR doc_id IS NULL").selectExpr(
        "doc_id", "n AS n_shingles", "doc_id AS component_id", "1L AS n_copies"
    )
    return linked.union(alone)


def keep_one(docs: DataFrame, width: int = WIDTH, percent: int = 80) -> DataFrame:
    """One document of each component, the one with the smallest doc_id, with all its columns.

    Documents without words or without a doc_id stay. Of rows that share a
    doc_id, the one with the smallest text hash stays.
    """
    joined = join_documents(docs, width, percent)
    dropped = small(stored(joined.where("doc_id != component_id").select("doc_id").distinct()))
    repeated = docs.groupBy("doc_id").count().where("count > 1 AND doc_id IS NOT NULL")
    repeated = small(stored(repeated.select("doc_id")))
    kept = docs.join(dropped, "doc_id", "left_anti").select(docs.columns)
    single = kept.join(repeated, "doc_id", "left_anti").select(docs.columns)
    order = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"))
    again = kept.join(repeated, "doc_id", "left_semi").select(docs.columns)
    ranked = again.select(F.struct("*").alias("row"), F.row_number().over(order).alias("k"))
    return single.union(ranked.where("k = 1").select("row.*"))
