"""Quality rules on tokeniser fertility, after a set of plain base rules.

A public vocabulary is a cheap model of ordinary text: text it was made for
takes few tokens per character, hardly any byte fallback and many different
tokens. Each script has a band for each of the three measures; a text outside
of a band is rejected. Texts of a few tokens say nothing about any measure and
are left to the base rules.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from trialbraid.llm.arrowtext import lines, mix, shingles, slices, text_bytes, words
from trialbraid.llm.subword import ChunkTable, piece_model

#: Words of a window that counts as repeated, fewest words, largest share of repeated words.
REPEAT_WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
SYMBOLS = b"#*$%&|<>"
#: Texts with fewer tokens are not measured.
MEASURED_TOKENS = 50


@dataclass(frozen=True)
class Band:
    """Accepted ranges of the measures of a script."""

    chars_per_token: tuple[float, float]
    byte_share: float
    min_entropy: float


#: The vocabulary holds mostly Latin and Cyrillic pieces; other scripts take a
#: token or several bytes for each character.
BANDS: Mapping[str, Band] = {
    "latin": Band((1.55, 8.0), 0.20, 3.0),
    "greek": Band((0.8, 4.0), 0.30, 3.0),
    "cyrillic": Band((1.2, 6.0), 0.30, 3.0),
    "cjk": Band((0.25, 3.0), 0.97, 3.0),
    "other": Band((0.2, 8.0), 0.99, 2.0),
}
_SCRIPTS = list(BANDS)
#: Script of a letter by the first byte of its UTF-8 form; -1 is no letter.
_SCRIPT_OF_LEAD = np.full(256, -1, np.int64)
for _name, _ranges in {
    "latin": [(0x41, 0x5A), (0x61, 0x7A), (0xC3, 0xC9)],
    "greek": [(0xCE, 0xCF)],
    "cyrillic": [(0xD0, 0xD3)],
    "cjk": [(0xE3, 0xE9), (0xEA, 0xED)],
    "other": [(0xD4, 0xDF), (0xE0, 0xE1)],
}.items():
    for _low, _high in _ranges:
        _SCRIPT_OF_LEAD[_low : _high + 1] = _SCRIPTS.index(_name)
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True


def _per_text(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of flags between consecutive bounds."""
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return np.diff(total[bounds])


def base_measures(texts: pa.Array) -> dict[str, np.ndarray]:
    """Counts of the base rules for each text; a null text has no words."""
    data, offsets = text_bytes(texts)
    runs = words(data, offsets)
    n = len(offsets) - 1
    character = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80, dtype=np.int64)])
    word_chars = _per_text(character[runs.end] - character[runs.start], runs.first)

    # Lines with a word that stand earlier in their text.
    line = lines(data, offsets)
    word_before = np.searchsorted(runs.start, line.start)
    has_word = np.searchsorted(runs.start, line.end) > word_before
    text = line.text_of()
    key = mix(line.hash + mix(text.astype(np.uint64) + np.uint64(1)))
    worded = np.flatnonzero(has_word)
    _, first = np.unique(key[worded], return_index=True)
    earlier = np.ones(len(worded), bool)
    earlier[first] = False
    n_dup_lines = np.bincount(text[worded][earlier], minlength=n)

    # Words in windows that stand in their text twice or more.
    window, at = shingles(runs, REPEAT_WINDOW)
    owner = runs.text_of()[at]
    _, inverse, count = np.unique(
        mix(window + mix(owner.astype(np.uint64) + np.uint64(1))),
        return_inverse=True,
        return_counts=True,
    )
    twice = at[count[inverse] > 1]
    cover = np.zeros(len(runs.hash) + 1, np.int64)
    np.add.at(cover, twice, 1)
    np.subtract.at(cover, twice + REPEAT_WINDOW, 1)
    n_repeat_words = _per_text(np.cumsum(cover[:-1]) > 0, runs.first)

    script = _SCRIPT_OF_LEAD[data]
    letters = np.stack([_per_text(script == k, offsets) for k in range(len(_SCRIPTS))])
    return {
        "n_words": np.diff(runs.first),
        "word_chars": word_chars,
        "n_symbols": _per_text(_SYMBOL[data], offsets),
        "n_dup_lines": n_dup_lines,
        "n_repeat_words": n_repeat_words,
        "chars": np.diff(character[offsets]),
        "script": np.where(letters.sum(0) > 0, letters.argmax(0), _SCRIPTS.index("other")),
    }


def token_measures(table: ChunkTable, texts: list[str | None]) -> dict[str, np.ndarray]:
    """Tokens, byte-fallback share and token entropy (bits) of each text."""
    chunked = [table.chunks(t or "") for t in texts]
    table.learn(chunked)
    n_tokens, byte_share, entropy = (np.zeros(len(texts)) for _ in range(3))
    is_byte = np.array([table.library.is_byte(i) for i in range(table.library.vocab_size())])
    for k, chunks in enumerate(chunked):
        ids = np.frombuffer(table.join_ids(chunks), "<u4")
        if len(ids):
            ids = np.sort(ids)
            edge = np.flatnonzero(np.diff(ids)) + 1
            share = np.diff(np.concatenate([[0], edge, [len(ids)]])) / len(ids)
            n_tokens[k] = len(ids)
            byte_share[k] = is_byte[ids].mean()
            entropy[k] = -(share * np.log2(share)).sum()
    return {"n_tokens": n_tokens, "byte_share": byte_share, "entropy": entropy}


def judge_documents(
    docs: DataFrame, model_path: str | None = None, bands: Mapping[str, Band] = BANDS
) -> DataFrame:
    """Base counts, token measures and verdict of every whole text.

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, script, n_tokens, chars_per_token,
    byte_share, token_entropy, kept. A null or empty text has no words and so
    fails the base rules. Repeated rows give repeated results; other columns
    are not read.
    """
    low, high, most_bytes, least_entropy = (
        np.array([f(bands[s]) for s in _SCRIPTS])
        for f in (
            lambda b: b.chars_per_token[0],
            lambda b: b.chars_per_token[1],
            lambda b: b.byte_share,
            lambda b: b.min_entropy,
        )
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ChunkTable(model_path or piece_model())
        for part in slices(batches):
            base = base_measures(part.column("text"))
            token = token_measures(table, part.column("text").to_pylist())
            failed = (base["n_words"] < MIN_WORDS) | (
                100 * base["n_repeat_words"] > MAX_REPEAT_PERCENT * base["n_words"]
            )
            per_token = base["chars"] / np.maximum(token["n_tokens"], 1)
            script = base["script"]
            inside = (
                (per_token >= low[script])
                & (per_token <= high[script])
                & (token["byte_share"] <= most_bytes[script])
                & (token["entropy"] >= least_entropy[script])
            )
            kept = ~failed & (inside | (token["n_tokens"] < MEASURED_TOKENS))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    *(
                        pa.array(base[c].astype(np.int64))
                        for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
                    ),
                    pa.array(failed),
                    pa.array([_SCRIPTS[s] for s in script], pa.string()),
                    pa.array(token["n_tokens"].astype(np.int64)),
                    pa.array(per_token),
                    pa.array(token["byte_share"]),
                    pa.array(token["entropy"]),
                    pa.array(kept),
                ],
                names=[
                    "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                    "base_failed", "script", "n_tokens", "chars_per_token", "byte_share",
                    "token_entropy", "kept",
                ],
            )

    return docs.select("doc_id", "text").mapInArrow(
        run,
        "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, "
        "n_repeat_words bigint, base_failed boolean, script string, n_tokens bigint, "
        "chars_per_token double, byte_share double, token_entropy double, kept boolean",
    )
