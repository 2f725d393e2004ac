"""Token counts, with overlap resynchronisation for huge documents.

A huge document is encoded in overlapping chunks. Token ends come from the
byte lengths of the ids. Inside an overlap both encodings must share a token
boundary at a place where every encoding of the whole text has one: after a
letter and before a space or closing mark. The pattern that parts texts before
the merges takes letters greedily and never a letter together with what
follows it, whatever stood before, so such a place is a boundary in any
context. The counts are spliced there. Where an overlap holds no such place
it is doubled, at the end up to the whole rest of the document.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from trialbraid.llm.arrowtext import slices

#: Characters of a chunk, and of the overlap of two chunks at first.
CHUNK_CHARS = 1 << 16
OVERLAP_CHARS = 1 << 10
#: A place after a letter and before a mark that no letter run or special string holds.
_STABLE = re.compile(r"(?<=[^\W\d_])(?=[ \n.,;:!?)\]。，、！？」])")


class RankEncoder:
    """Encoding by a rank file; special strings in a text are single tokens."""

    def __init__(self, ranks_path: str | None = None, special: dict[str, int] | None = None):
        import public_tokenizers
        import tiktoken

        path = ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken")
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.special = {"<|endoftext|>": 50256} if special is None else special
        self.encoding = tiktoken.Encoding(
            "ranks",
            pat_str=public_tokenizers.PATTERN,
            mergeable_ranks=ranks,
            special_tokens=self.special,
        )
        self._ranks = ranks

    @cached_property
    def byte_lengths(self) -> np.ndarray:
        sizes = {**{i: len(t) for t, i in self._ranks.items()}}
        sizes |= {i: len(t.encode()) for t, i in self.special.items()}
        out = np.zeros(max(sizes) + 1, np.int64)
        out[list(sizes)] = list(sizes.values())
        return out

    def encode(self, text: str) -> np.ndarray:
        return self.encoding.encode_to_numpy(text, allowed_special="all")

    def token_ends(self, text: str) -> np.ndarray:
        """Byte offsets at which the tokens of a text end."""
        return np.cumsum(self.byte_lengths[self.encode(text)])


def stable_places(text: str, low: int, high: int) -> list[int]:
    """Places in [low, high] where any encoding of the text has a boundary."""
    return [m.start() for m in _STABLE.finditer(text, low, min(high + 1, len(text))) if low < m.start() <= high]


def count_huge(
    encoder: RankEncoder, text: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS
) -> int:
    """Tokens of one text, encoded in overlapping chunks and spliced."""
    total, start = 0, 0
    while True:
        wide = overlap
        end = start + chunk
        if end + wide >= len(text):
            return total + len(encoder.encode(text[start:]))
        left = text[start : end + wide]
        left_ends = encoder.token_ends(left)
        splice = None
        while splice is None:
            # The last third stays free: what was cut off cannot reach back over it.
            places = stable_places(text, end, end + wide - wide // 3)
            right_ends = encoder.token_ends(text[end : end + wide])
            for p in places:
                in_left = len(text[start:p].encode())
                in_right = len(text[end:p].encode())
                i = int(np.searchsorted(left_ends, in_left))
                j = int(np.searchsorted(right_ends, in_right))
                if left_ends[i : i + 1] == in_left and right_ends[j : j + 1] == in_right:
                    splice = (p, i + 1)
                    break
            else:
                wide *= 2
                if end + wide >= len(text):
                    return total + len(encoder.encode(text[start:]))
                left_ends = encoder.token_ends(text[start : end + wide])
        total += splice[1]
        start = splice[0]


def count_tokens(
    docs: DataFrame, limit: int = 1024, ranks_path: str | None = None, chunk: int = CHUNK_CHARS
) -> DataFrame:
    """Bytes and tokens of every whole text, and whether it has more than ``limit`` tokens.

    Returns doc_id, n_bytes, n_tokens, over_limit. A null or empty text has
    no tokens; repeated rows give repeated results; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = RankEncoder(ranks_path)
        for part in slices(batches):
            texts = [t or "" for t in part.column("text").to_pylist()]
            counts = [
                count_huge(encoder, t, chunk) if len(t) > chunk else len(encoder.encode(t))
                for t in texts
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    pa.array([len(t.encode()) for t in texts], pa.int64()),
                    pa.array(counts, pa.int64()),
                    pa.array([n > limit for n in counts], pa.bool_()),
                ],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean"
    )
