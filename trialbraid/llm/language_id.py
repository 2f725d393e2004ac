"""Language identification by cross-parsing entropy.

A suffix automaton holds all substrings of a sample of a language. A text is
parsed greedily into the longest phrases that stand in the sample; the
language that needs the fewest phrases for the letters of the text wins. All
texts of a slice step through the automata of all languages together.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trialbraid.llm.arrowtext import slices

#: The sample of a language: passages, and characters of each. Texts to be
#: judged are always whole; the sample bounds the automata only.
PASSAGES = 48
PASSAGE_CHARS = 512
#: Symbols: 0 for anything but a letter, letters with a symbol of their own, hashed letters.
OWN_LETTERS = 127
HASHED_LETTERS = 64
#: A long text is parsed in segments; a phrase ends with its segment.
SEGMENT = 2048


def training_sample(docs: DataFrame, passages: int = PASSAGES, chars: int = PASSAGE_CHARS) -> dict[str, list[str]]:
    """The first characters of some documents of each language, chosen by a hash of doc_id."""
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "passage")
    some = docs.where("lang IS NOT NULL AND length(text) > 0").select(
        "lang", "doc_id", F.substring("text", 1, chars).alias("passage")
    )
    # The limit applies in each task before the shuffle.
    some = some.withColumn("k", F.row_number().over(order)).where(F.col("k") <= passages)
    sample: dict[str, list[str]] = {}
    for row in sorted(some.select("lang", "k", "passage").collect()):
        sample.setdefault(row.lang, []).append(row.passage)
    return sample


def letters_only(text: str) -> np.ndarray:
    """Lower-cased code points, with one 0 for each run of anything but letters."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    points = np.where(_LETTER[points], points, 0)
    keep = points != 0
    keep[1:] |= points[:-1] != 0
    return points[keep]


_LETTER = np.zeros(0x110000, bool)


def _fill_letters() -> None:
    if not _LETTER[0x61]:
        _LETTER[[c for c in range(0x110000) if chr(c).isalpha()]] = True


class SuffixAutomaton:
    """All substrings of a sequence of symbols, as a table of transitions."""

    def __init__(self, symbols: list[int], size: int):
        step: list[dict[int, int]] = [{}]
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
        self.table = np.full((len(step), size), -1, np.int32)
        for state, moves in enumerate(step):
            self.table[state, list(moves)] = list(moves.values())


class CrossParser:
    """The automata of all languages over one alphabet."""

    def __init__(self, sample: dict[str, list[str]]):
        _fill_letters()
        self.languages = sorted(sample)
        parsed = {lang: [letters_only(t) for t in texts] for lang, texts in sample.items()}
        common = Counter()
        for texts in parsed.values():
            for t in texts:
                common.update(t[t > 0].tolist())
        own = sorted(sorted(common), key=lambda c: -common[c])[:OWN_LETTERS]
        self.own = np.array(sorted(own), np.int64)
        # The last symbol parts passages and stands in no text.
        size = 1 + len(own) + HASHED_LETTERS + 1
        tables, self.roots, base = [], [], 0
        for lang in self.languages:
            symbols: list[int] = []
            for t in parsed[lang]:
                symbols += self.symbols(t).tolist()
                symbols.append(size - 1)
            table = SuffixAutomaton(symbols, size).table
            tables.append(np.where(table >= 0, table + base, -1))
            self.roots.append(base)
            base += len(table)
        self.table = np.concatenate(tables).astype(np.int32) if tables else np.zeros((0, size), np.int32)

    def symbols(self, points: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.own, points)
        known = self.own[np.minimum(at, len(self.own) - 1)] == points if len(self.own) else points < 0
        hashed = 1 + len(self.own) + points.astype(np.int64) % HASHED_LETTERS
        return np.where(points == 0, 0, np.where(known, 1 + at, hashed))

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """Phrases of each text (symbols) under each language."""
        sizes = np.array([len(t) for t in texts], np.int64)
        flat = np.concatenate(texts) if len(texts) else np.empty(0, np.int64)
        ends = np.cumsum(sizes)
        pieces = -(-sizes // SEGMENT)
        text = np.repeat(np.arange(len(texts)), pieces)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = (ends - sizes)[text] + nth * SEGMENT
        length = np.minimum(ends[text] - start, SEGMENT)
        order = np.argsort(-length, kind="stable")
        start, length, text = start[order], length[order], text[order]
        roots = np.array(self.roots, np.int64)[:, None]
        state = np.repeat(roots, len(text), axis=1)
        count = np.zeros((len(roots), len(text)), np.int64)
        moves, width = self.table.ravel(), self.table.shape[1]
        live = np.searchsorted(-length, -np.arange(1, SEGMENT + 1), "right")
        for step in range(int(length[0]) if len(length) else 0):
            n = live[step]
            symbol = flat[start[:n] + step]
            after = moves[state[:, :n] * width + symbol]
            ended = after < 0
            # A phrase starts behind the last one; a letter that no sample holds is a phrase.
            count[:, :n] += ended | (state[:, :n] == roots)
            anew = moves[roots * width + symbol]
            after = np.where(ended, np.where(anew >= 0, anew, roots), after)
            state[:, :n] = after
        out = np.zeros((len(texts), len(roots)), np.int64)
        for k in range(len(roots)):
            out[:, k] = np.bincount(text, count[k], minlength=len(texts)).astype(np.int64)
        return out


def predict_language(docs: DataFrame, sample: dict[str, list[str]]) -> DataFrame:
    """(doc_id, lang_pred, score, n_phrases, n_letters) of every whole text.

    The score is how many phrases fewer, as a share, the best language needs
    than the next (0 to 1; 1 with a single language). Ties go to the first name. A
    null text or one without a letter, and any text where nothing was learned,
    is ``und`` with score 0. Only doc_id and text are read; repeated rows
    repeat their result.
    """
    parser = docs.sparkSession.sparkContext.broadcast(CrossParser(sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _fill_letters()
        own = parser.value
        names = np.array([*own.languages, "und"], dtype=object)
        for part in slices(batches):
            points = [letters_only(t or "") for t in part.column("text").to_pylist()]
            letters = np.array([int((p > 0).sum()) for p in points])
            phrases = own.phrases([own.symbols(p) for p in points])
            best = np.full(len(points), len(own.languages))
            score, fewest = np.zeros(len(points)), np.zeros(len(points), np.int64)
            judged = np.flatnonzero(letters > 0) if own.languages else np.empty(0, np.int64)
            if len(judged):
                ranked = np.sort(phrases[judged], axis=1)
                best[judged] = phrases[judged].argmin(1)
                fewest[judged] = ranked[:, 0]
                score[judged] = 1 - ranked[:, 0] / ranked[:, 1] if ranked.shape[1] > 1 else 1.0
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    pa.array(names[best].tolist(), pa.string()),
                    pa.array(score),
                    pa.array(fewest),
                    pa.array(letters.astype(np.int64)),
                ],
                names=["doc_id", "lang_pred", "score", "n_phrases", "n_letters"],
            )

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id bigint, lang_pred string, score double, n_phrases bigint, n_letters bigint"
    )
