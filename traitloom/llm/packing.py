"""Packing token sequences into fixed windows by minimum bin slack.

A document of more than a window is cut into full windows; what remains of each document
waits in its task. For each further window the longest remainder is taken, and a subset-sum
program over the counts of all remaining lengths, with the reachable sums as the bits of one
integer, finds the multiset that leaves the least room; its counts are read back from the
stored bits. A multiset is used as often as the counts allow; where none fills a window, the longest
piece left is cut to fit. Packing stays within the task of the scan, so no text or id moves,
and only the last window of a partition is open.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traitloom.llm.common import batch_pieces, lean, shared
from traitloom.llm.tokens import TextIds

WINDOW = 2048
END_ID = 1
BATCH = 1 << 20  # ids in a batch of pieces that leaves a task
HOLD = 1 << 22  # ids that wait in a task before full windows leave
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def fullest(counts: dict[int, int], room: int) -> list[tuple[int, int]]:
    """The (length, number) multiset within ``counts`` whose sum is the largest up to ``room``.

    Long lengths come first, so short ones stay for later windows. The program stops at the
    first item that makes the sum exact.
    """
    mask, reach, trail = (1 << (room + 1)) - 1, 1, []
    goal = 1 << room
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, power = min(counts[length], room // length), 1
        while left and not reach & goal:
            take = min(power, left)
            trail.append((length, take, reach))
            reach |= (reach << (take * length)) & mask
            left, power = left - take, power * 2
        if reach & goal:
            break
    total = reach.bit_length() - 1
    used: dict[int, int] = defaultdict(int)
    for length, take, before in reversed(trail):
        if not before >> total & 1:
            used[length] += take
            total -= take * length
    return list(used.items())


class Waiting:
    """Pieces shorter than a window, by length: (doc, start, tokens of the document, ids)."""

    def __init__(self, window: int):
        self.window, self.held = window, 0
        self.by_length: dict[int, list] = defaultdict(list)

    def add(self, piece: tuple) -> None:
        if len(piece[3]):
            self.by_length[len(piece[3])].append(piece)
            self.held += len(piece[3])

    def _take(self, length: int) -> tuple:
        pieces = self.by_length[length]
        piece = pieces.pop()
        if not pieces:
            del self.by_length[length]
        self.held -= length
        return piece

    def filled(self, cut: bool) -> Iterator[list[tuple]]:
        """Contents of windows. Without ``cut`` only exact ones, as long as there are any; with
        it all: a window that no multiset fills takes the front of the longest piece left."""
        while self.by_length:
            counts = {k: len(v) for k, v in self.by_length.items()}
            longest = max(counts)
            counts[longest] -= 1
            chosen = dict(fullest({k: n for k, n in counts.items() if n}, self.window - longest))
            chosen[longest] = chosen.get(longest, 0) + 1
            slack = self.window - sum(k * n for k, n in chosen.items())
            if slack and not cut:
                return
            times = 1 if slack else min(len(self.by_length[k]) // n for k, n in chosen.items())
            for _ in range(times):
                content = [self._take(k) for k, n in sorted(chosen.items(), reverse=True) for _ in range(n)]
                if slack and self.by_length:
                    doc, start, total, ids = self._take(max(self.by_length))
                    content.append((doc, start, total, ids[:slack]))
                    self.add((doc, start + slack, total, ids[slack:]))
                yield content


def pack(
    docs: DataFrame,
    vocab: str,
    ranks: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    end_id: int = END_ID,
    with_ids: bool = True,
    hold: int = HOLD,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids.

    A document is its token ids and ``end_id``; null text is empty, so every row has a piece,
    also repeated rows and rows without an id. Whole texts are encoded. Pieces of a sequence
    lie without gaps from offset 0. ``sequence_id`` is unique over all partitions. An empty
    table gives no rows. Without ``with_ids`` the column ``ids`` is left out.
    """
    encoder = shared(docs.sparkSession, TextIds(vocab, ranks))  # two paths
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence = TaskContext.get().partitionId() << 33
        waiting, out, room = Waiting(window), [], BATCH

        def place(contents: Iterator[list[tuple]]) -> Iterator[pa.RecordBatch]:
            nonlocal sequence, out, room
            for content in contents:
                offset = 0
                for doc, start, total, ids in content:
                    out.append((doc, start, len(ids), zlib.crc32(ids), total, sequence, offset, ids))
                    offset += len(ids)
                sequence += 1
                room -= offset
                if room <= 0:
                    yield _pieces(out, with_ids)
                    out, room = [], BATCH

        for batch in batch_pieces(batches, "text"):
            count, flat = encoder.value.ids(batch.column(1))
            ids = np.insert(flat, np.cumsum(count), end_id).astype("<u4")
            stop = np.cumsum(count + 1).tolist()
            for doc, a, b in zip(batch.column(0).to_pylist(), [0, *stop[:-1]], stop):
                whole = (b - a) // window
                yield from place([(doc, k * window, b - a, ids[a + k * window : a + (k + 1) * window])] for k in range(whole))
                waiting.add((doc, whole * window, b - a, ids[a + whole * window : b].copy()))
            if waiting.held > hold:
                yield from place(waiting.filled(cut=False))
                if waiting.held > hold:  # lengths that hardly combine
                    yield from place(waiting.filled(cut=True))
        yield from place(waiting.filled(cut=True))
        yield _pieces(out, with_ids)

    return rows.mapInArrow(run, PIECES + (", ids array<int>" if with_ids else ""))


def _pieces(rows: list[tuple], with_ids: bool) -> pa.RecordBatch:
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    columns = list(zip(*rows)) if rows else [()] * 8
    arrays = [pa.array(c, pa.int64()) for c in columns[:7]]
    if with_ids:
        sizes = np.concatenate([[0], np.cumsum([len(x) for x in columns[7]])]).astype(np.int32)
        values = np.concatenate(columns[7]).view(np.int32) if rows else np.zeros(0, np.int32)
        arrays.append(pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(values, pa.int32())))
    return pa.RecordBatch.from_arrays(arrays, names + ["ids"] * with_ids)
