"""SentencePiece encoding and decoding through a table of distinct chunks.

No piece of a suitable vocabulary crosses a whitespace marker or a line
break. The merges of one marked word then never touch the next, so each
distinct marked word is segmented once and its ids are joined back by
position. The table belongs to a task: the words of a partition repeat, so a
shuffle of every word of the corpus (tens of bytes for a word of six) would
only replace a look-up in memory. The table is emptied when it is full; that
costs time, never a result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from trialbraid.llm.arrowtext import slices

MARKER = "▁"
#: Line breaks stand alone; a word keeps the markers before it.
_CHUNK = re.compile(f"\n|{MARKER}*[^{MARKER}\n]+|{MARKER}+")
#: Bytes of text whose chunks are held as strings at once.
SLICE_BYTES = 512 << 10
#: Entries of the table before it is emptied.
TABLE_ENTRIES = 100_000


def piece_model(name: str = "piece_bpe_32k.model") -> str:
    """Where the vocabulary file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


class ChunkTable:
    """Packed ids and decoded text of distinct chunks, by the library itself."""

    def __init__(self, path: str, entries: int = TABLE_ENTRIES):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.entries = entries
        self.ids: dict[str, bytes] = {}
        #: Decoded text of the chunks whose marker-free form it is not.
        self.changed: dict[str, str] = {}
        self._lead = self.library.encode("\n")
        self._require_closed_chunks()

    def _require_closed_chunks(self) -> None:
        """Raise where a piece could cross the border of a chunk."""
        crossing = re.compile(f"[^{MARKER}].*{MARKER}|{MARKER}{MARKER}+[^{MARKER}]|\n")
        for i in range(self.library.vocab_size()):
            piece = self.library.id_to_piece(i)
            if not self.library.is_byte(i) and crossing.search(piece):
                raise ValueError(f"piece {piece!r} crosses a chunk border")
        if len(self._lead) != 2 or not self.library.is_byte(self._lead[1]):
            raise ValueError("a line break must be one byte piece after the marker")

    def _segment(self, fresh: list[str]) -> None:
        """Segment distinct chunks in one call, separated by line breaks.

        The library puts its marker before the first line break only, and a
        line break is always its own byte piece, so its id parts the chunks.
        """
        for start in range(0, len(fresh), 4096):
            part = [c for c in fresh[start : start + 4096] if c != "\n"]
            ids = self.library.encode("\n" + "\n".join(part), num_threads=1)
            packed = np.array(ids, "<u4")
            at = np.flatnonzero(packed == self._lead[1])
            ends = [*(at[1:] * 4).tolist(), packed.nbytes]
            raw = packed.tobytes()
            pieces = [raw[a:b] for a, b in zip(((at + 1) * 4).tolist(), ends)]
            self.ids.update(zip(part, pieces))
            decoded = self.library.decode(ids)
            if decoded != "\n" + "\n".join(part).replace(MARKER, " "):
                texts = zip(part, decoded.split("\n")[1:], strict=True)
                self.changed.update((c, t) for c, t in texts if t != c.replace(MARKER, " "))
        self.ids["\n"] = np.array(self._lead[1:], "<u4").tobytes()

    def chunks(self, text: str) -> list[str]:
        if not text:
            return []
        return _CHUNK.findall(MARKER + text.replace(" ", MARKER))

    def learn(self, texts_chunks: list[list[str]]) -> None:
        """Segment the chunks that are not in the table."""
        distinct = set().union(*texts_chunks)
        fresh = distinct - self.ids.keys()
        if len(self.ids) + len(fresh) > self.entries:
            self.ids, self.changed, fresh = {}, {}, distinct
        if fresh:
            self._segment(list(fresh))

    def join_ids(self, chunks: list[str]) -> bytes:
        """Ids of a text as packed little-endian integers, without begin and end."""
        return b"".join(map(self.ids.__getitem__, chunks))

    def join_text(self, chunks: list[str]) -> str:
        """The decoded text; the library drops the marker it put in front."""
        if self.changed:
            chunks = [self.changed.get(c, c) for c in chunks]
        return "".join(chunks)[1:].replace(MARKER, " ")


#: What can be returned for a text, with its SQL type.
OUTPUTS = {
    "n_tokens": "bigint",
    "ids_sha256": "string",
    "decoded_sha256": "string",
    "ids": "array<int>",
    "decoded": "string",
}


def encode_documents(
    docs: DataFrame,
    outputs: Sequence[str] = tuple(OUTPUTS),
    keep: Sequence[str] = ("doc_id",),
    model_path: str | None = None,
) -> DataFrame:
    """Encode every whole text, with begin and end ids, and decode it again.

    Returns the ``keep`` columns and the ``outputs``: n_tokens (all ids), ids,
    decoded, and lowercase SHA-256 of the ids as little-endian unsigned 32-bit
    integers and of the decoded text in UTF-8. A null or empty text has the
    begin and end ids only and decodes to ''. Repeated rows give repeated
    results; other columns are not read.
    """

    def arrays(table: ChunkTable, texts: list[str | None]) -> dict[str, pa.Array]:
        chunked = [table.chunks(t or "") for t in texts]
        table.learn(chunked)
        begin, end = (
            np.array([i], "<u4").tobytes() for i in (table.library.bos_id(), table.library.eos_id())
        )
        ids = [begin + table.join_ids(c) + end for c in chunked]
        made: dict[str, pa.Array] = {"n_tokens": pa.array([len(i) // 4 for i in ids], pa.int64())}
        if "ids_sha256" in outputs:
            made["ids_sha256"] = pa.array([hashlib.sha256(i).hexdigest() for i in ids])
        if "ids" in outputs:
            bounds = np.cumsum([0, *(len(i) // 4 for i in ids)]).astype(np.int32)
            flat = pa.array(np.frombuffer(b"".join(ids), "<i4"))
            made["ids"] = pa.ListArray.from_arrays(pa.array(bounds), flat)
        if {"decoded", "decoded_sha256"} & set(outputs):
            decoded = [table.join_text(c) for c in chunked]
            made["decoded"] = pa.array(decoded, pa.string())
            digests = [hashlib.sha256(t.encode()).hexdigest() for t in decoded]
            made["decoded_sha256"] = pa.array(digests, pa.string())
        return made

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ChunkTable(model_path or piece_model())
        for part in slices(batches, size=SLICE_BYTES):
            made = arrays(table, part.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*(part.column(c) for c in keep), *(made[c] for c in outputs)],
                names=[*keep, *outputs],
            )

    source = docs.select(*keep, "text")
    kept = [f"`{c}` {source.schema[c].dataType.simpleString()}" for c in keep]
    return source.mapInArrow(run, ", ".join([*kept, *(f"{c} {OUTPUTS[c]}" for c in outputs)]))
