"""SentencePiece encoding and decoding with an Aho-Corasick automaton and a Viterbi search.

The automaton runs over the UTF-8 bytes of a text. At each byte the pieces that end there are
the state's output links, from the longest to the shortest; each relaxes the best score of
its end. No piece spans the start of a run of blanks or a line end (this is checked when the model is read),
so texts fall into chunks that are solved on their own, many at a time in step, and
common chunks are remembered.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traitloom.llm.common import batch_pieces, shared, text_bytes, text_or_empty, widened
from traitloom.llm.words import WordTable, gather

BLANK = "▁"
UNKNOWN_PENALTY = 10.0
STEP_BYTES = 1 << 21  # padded bytes that are solved together


class Pieces:
    """Pieces, scores and byte pieces of a model file; the automaton is built where it is used.

    ``add_blank`` puts one blank before the text, as the model's own encoder does. A character
    without a piece of its own costs the least score minus ``UNKNOWN_PENALTY`` and becomes byte pieces.
    Ties go to the longest last piece.
    """

    def __init__(self, pieces: list[tuple[bytes, float, int]], byte_ids: list[int], add_blank: bool = True):
        self.pieces, self.byte_ids, self.add_blank = pieces, np.array(byte_ids, np.int32), add_blank
        self._ready = False

    @classmethod
    def read(cls, path: str, add_blank: bool = True) -> Pieces:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces, byte_ids = [], [0] * 256
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                byte_ids[int(piece[3:5], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                pieces.append((piece.replace(BLANK, " ").encode(), float(model.get_score(i)), i))
        return cls(pieces, byte_ids, add_blank)

    def _build(self) -> None:
        """Dense byte automaton, the first output of each state and the next of each output."""
        by_text = {p: (s, i) for p, s, i in self.pieces}
        self.chunked = not any(b"\n" in p or b" " in p.lstrip(b" ") for p in by_text)
        self.count = max([i for _, _, i in self.pieces] + self.byte_ids.tolist()) + 1
        used = sorted({b for p in by_text for b in p})
        self.column = np.zeros(256, np.int64)  # bytes outside all pieces share column 0
        self.column[used] = np.arange(1, len(used) + 1)
        children: list[dict[int, int]] = [{}]
        end_of: dict[int, bytes] = {}
        for piece in by_text:
            state = 0
            for b in piece:
                nxt = children[state].get(b)
                if nxt is None:
                    nxt = children[state][b] = len(children)
                    children.append({})
                state = nxt
            end_of[state] = piece
        n = len(children)
        self.go = np.zeros((n, len(used) + 1), np.int32)
        fail = np.zeros(n, np.int32)
        self.size = np.zeros(n, np.int32)
        self.score = np.zeros(n)
        self.piece = np.full(n, -1, np.int32)
        for state, piece in end_of.items():
            self.size[state], (self.score[state], self.piece[state]) = len(piece), by_text[piece]
        self.first = np.zeros(n, np.int32)  # the state itself if a piece ends here, else its output link
        self.next = np.zeros(n, np.int32)
        queue = deque([0])
        while queue:
            state = queue.popleft()
            if state:
                self.go[state] = self.go[fail[state]]
                self.next[state] = self.first[fail[state]]
                self.first[state] = state if self.size[state] else self.next[state]
            for b, child in children[state].items():
                column = self.column[b]
                fail[child] = self.go[state, column] if state else 0
                self.go[state, column] = child
                queue.append(child)
        self.worst = min((s for _, s, _ in self.pieces), default=0.0) - UNKNOWN_PENALTY
        self.bytes_of = [b""] * self.count
        for piece, _, i in self.pieces:
            self.bytes_of[i] = piece
        for b, i in enumerate(self.byte_ids.tolist()):
            self.bytes_of[i] = bytes([b])
        self.table = WordTable(self._encode)
        self._ready = True

    def __getstate__(self):
        return {"pieces": self.pieces, "byte_ids": self.byte_ids, "add_blank": self.add_blank, "_ready": False}

    def _encode(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Best segmentation of each chunk; chunks of like length go together."""
        length = np.array([len(c) for c in chunks])
        order = np.argsort(length, kind="stable")
        ordered = [chunks[i] for i in order.tolist()]
        widths = length[order]
        sizes, parts, k = [], [], 0
        while k < len(ordered):
            # As many as fit when padded to the longest of them, at least one.
            room = np.arange(1, len(ordered) - k + 1) * widths[k:] <= STEP_BYTES
            stop = k + max(1, int(np.argmin(room)) if not room.all() else len(room))
            size, flat = self._viterbi(ordered[k:stop])
            sizes.append(size)
            parts.append(flat)
            k = stop
        if not sizes:
            return np.zeros(0, np.int64), np.zeros(0, np.int32)
        size, flat = np.concatenate(sizes), np.concatenate(parts)
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        begin = np.cumsum(size) - size
        return size[back], gather(begin[back], size[back], flat)

    def _viterbi(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """One pass over the bytes of all chunks in step; chunks come in order of length."""
        n, length = len(chunks), np.array([len(c) for c in chunks])
        width = int(length.max(initial=0))
        text = np.frombuffer(b"".join(c.ljust(width, b"\0") for c in chunks), np.uint8).reshape(n, width)
        column = self.column[text]
        lead = (text & 0xC0) != 0x80
        best = np.full((width + 1, n), -np.inf)
        best[0] = 0.0
        back_size, back_piece = np.zeros((width + 1, n), np.int32), np.full((width + 1, n), -1, np.int32)
        state, char = np.zeros(n, np.int32), np.zeros(n, np.int64)
        for j in range(width):
            first = int(np.searchsorted(length, j, side="right"))  # chunks before it have ended
            live = np.arange(first, n)
            state[first:] = self.go[state[first:], column[first:, j]]
            char[first:] = np.where(lead[first:, j], j, char[first:])
            whole = (j + 1 == length[first:]) | lead[first:, min(j + 1, width - 1)]
            single = np.zeros(n - first, bool)
            out, rows = self.first[state[first:]], live
            while True:
                keep = out > 0
                out, rows = out[keep], rows[keep]
                if not len(rows):
                    break
                size = self.size[out]
                found = best[j + 1 - size, rows] + self.score[out]
                better = found > best[j + 1, rows]
                some = rows[better]
                best[j + 1, some], back_size[j + 1, some], back_piece[j + 1, some] = found[better], size[better], self.piece[out[better]]
                single[rows - first] |= size == j + 1 - char[rows]
                out = self.next[out]
            rows = live[whole & ~single]
            if len(rows):
                size = j + 1 - char[rows]
                found = best[char[rows], rows] + self.worst
                better = found > best[j + 1, rows]
                some = rows[better]
                best[j + 1, some], back_size[j + 1, some], back_piece[j + 1, some] = found[better], size[better], -1
        # Back from the ends; unknown characters become their bytes, last byte first.
        at, live, who, ids = length.copy(), np.flatnonzero(length), [], []
        while len(live):
            size, piece = back_size[at[live], live], back_piece[at[live], live]
            known = piece >= 0
            who.append(live[known])
            ids.append(piece[known])
            odd, span = live[~known], size[~known]
            for b in range(int(span.max(initial=0))):
                has = span > b
                who.append(odd[has])
                ids.append(self.byte_ids[text[odd[has], at[odd[has]] - 1 - b]])
            at[live] -= size
            live = live[at[live] > 0]
        rows = np.concatenate(who) if who else np.zeros(0, np.int64)
        order = np.argsort(rows[::-1], kind="stable")
        flat = (np.concatenate(ids) if ids else np.zeros(0, np.int32))[::-1][order]
        return np.bincount(rows, minlength=n), flat.astype(np.int32)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each text and the ids of all; null is empty and has none."""
        if not self._ready:
            self._build()
        raw, at = text_bytes(column)
        size = np.diff(at)
        if self.add_blank:
            raw = np.insert(raw, at[:-1][size > 0], 32)
            at = np.concatenate([[0], np.cumsum(size + (size > 0))])
        count = np.zeros(len(size), np.int64)
        if not len(raw):
            return count, np.zeros(0, np.int32)
        start = np.zeros(len(raw), bool)
        start[at[:-1][size > 0]] = True
        if self.chunked:
            blank, line = raw == 32, raw == 10
            prev_blank = np.concatenate([[False], blank[:-1]])
            start |= blank & ~prev_blank | line | np.concatenate([[False], line[:-1]])
        begin = np.flatnonzero(start)
        end = np.append(begin[1:], len(raw))
        sizes, flat = self.table.values(raw, begin, end)
        row = np.searchsorted(at, begin, side="right") - 1
        return np.bincount(row, weights=sizes, minlength=len(size)).astype(np.int64), flat

    def decode(self, ids: list[int] | np.ndarray) -> str:
        """Text of ids; the added blank goes. Bytes that are no UTF-8 become U+FFFD, ids that
        are no pieces are left out."""
        if not self._ready:
            self._build()
        data = b"".join(self.bytes_of[i] for i in ids if 0 <= i < self.count)
        if self.add_blank and data[:1] == b" ":
            data = data[1:]
        return data.decode("utf-8", "replace")


def encode(docs: DataFrame, pieces: Pieces, text_col: str = "text", name: str = "ids") -> DataFrame:
    """All columns and ``name``: the piece ids of the whole text, empty for null and empty texts."""
    docs = docs.drop(name)
    model = shared(docs.sparkSession, pieces)  # the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batch_pieces(batches, text_col):
            count, flat = model.value.encode(batch.column(batch.schema.get_field_index(text_col)))
            stop = np.concatenate([[0], np.cumsum(count)]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(stop, pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, ids], [*batch.schema.names, name])

    return docs.mapInArrow(run, widened(docs, **{name: "array<int>"}))


def decode(rows: DataFrame, pieces: Pieces, ids_col: str = "ids", name: str = "decoded") -> DataFrame:
    """All columns and ``name``: the text of the ids; null ids give empty text."""
    rows = rows.drop(name)
    model = shared(rows.sparkSession, pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index(ids_col))
            out = [model.value.decode(x.values.to_numpy(zero_copy_only=False).tolist()) if x.is_valid else "" for x in lists]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], [*batch.schema.names, name])

    return rows.mapInArrow(run, widened(rows, **{name: "string"}))


def encoded_digests(docs: DataFrame, pieces: Pieces, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_ids, n_bytes (byte pieces), ids_crc32 (little-endian 32-bit ids), round_trip.

    Encoding and decoding share a worker, so a task holds the automaton once.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    model = shared(docs.sparkSession, pieces)
    low, high = int(pieces.byte_ids.min()), int(pieces.byte_ids.max())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batch_pieces(batches, "text"):
            count, flat = model.value.encode(batch.column(1))
            out: dict[str, list] = {"n_bytes": [], "ids_crc32": [], "round_trip": []}
            for text, ids in zip(batch.column(1).to_pylist(), np.split(flat, np.cumsum(count)[:-1])):
                out["n_bytes"].append(int(((ids >= low) & (ids <= high)).sum()))
                out["ids_crc32"].append(zlib.crc32(ids.astype("<u4")))
                out["round_trip"].append(model.value.decode(ids.tolist()) == text)
            arrays = [batch.column(0), pa.array(count), *(pa.array(out[k], pa.int64()) for k in ("n_bytes", "ids_crc32")), pa.array(out["round_trip"], pa.bool_())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_ids", "n_bytes", "ids_crc32", "round_trip"])

    kind = dict(docs.dtypes)[id_col]
    return rows.mapInArrow(run, f"doc_id {kind}, n_ids long, n_bytes long, ids_crc32 long, round_trip boolean")
