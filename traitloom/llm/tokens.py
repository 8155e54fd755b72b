"""Token ids of texts by a public byte-level vocabulary, words encoded once and remembered."""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa

from traitloom.llm.common import text_bytes
from traitloom.llm.words import WordTable

LETTER, DIGIT, SPACE, OTHER, RARE = 0, 1, 2, 3, 4


def _classes() -> tuple[np.ndarray, np.ndarray]:
    """Class of each ASCII byte and of each code point below 640.

    Apostrophes (contractions), '<' (special tokens) and white space beyond ASCII are rare:
    texts with them, or with larger code points, take the plain way through the tokenizer.
    """
    points = np.full(640, RARE, np.uint8)
    for p in range(640):
        c = chr(p)
        if p in (0x85, 0xA0) or c in "'<" or not c.isprintable() and p > 127:
            continue
        if p in (9, 10, 11, 12, 13, 32):
            points[p] = SPACE
        elif c.isalpha():
            points[p] = LETTER
        elif c.isnumeric():
            points[p] = RARE if p > 127 else DIGIT
        elif p < 128 and p >= 32:
            points[p] = OTHER
    table = np.full(256, RARE, np.uint8)
    table[:128] = points[:128]
    return table, points


class TextIds:
    """Ids of whole texts by ``tokenizers`` (``vocab``); common words by way of a table.

    ``ranks`` is the same vocabulary as merge ranks; words that a text of plain letters, digits
    and signs falls into are encoded with it once per worker, which gives the same ids.
    Lives in a broadcast variable: every worker opens the files and fills its table itself.
    """

    def __init__(self, vocab: str, ranks: str):
        self.vocab, self.ranks = vocab, ranks
        self._ready = False

    def __getstate__(self):
        return {"vocab": self.vocab, "ranks": self.ranks, "_ready": False}

    def _open(self) -> None:
        import tiktoken
        from public_tokenizers import PATTERN

        with open(self.ranks, "rb") as f:
            merge = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=merge, special_tokens={})
        self.plain = None  # opened with the first text that needs it
        self.bytes_of = np.zeros(max(merge.values()) + 1, np.int64)
        self.bytes_of[list(merge.values())] = [len(k) for k in merge]
        self.table, self.points = _classes()
        self.words = WordTable(self._encode)
        self._ready = True

    def _encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Words of a blank and letters are encoded as one text, which falls into them again."""
        head = np.array([w[1] if w[:1] == b" " and len(w) > 1 else 32 for w in words], np.uint8)
        joins = np.isin(self.table[head], (LETTER, RARE))
        size = np.zeros(len(words), np.int64)
        together = [w for w, j in zip(words, joins.tolist()) if j]
        flat = np.array(self.fast.encode_ordinary(b"".join(together).decode()), np.int32)
        if together:
            ends = np.cumsum([len(w) for w in together])
            stop = np.searchsorted(np.cumsum(self.bytes_of[flat]), ends, side="left") + 1
            size[joins] = np.diff(stop, prepend=0)
        alone = [np.array(self.fast.encode_ordinary(w.decode()), np.int32) for w, j in zip(words, joins.tolist()) if not j]
        if not alone:
            return size, flat
        size[~joins] = [len(x) for x in alone]
        out = np.empty(int(size.sum()), np.int32)
        of_joined = np.repeat(joins, size)
        out[of_joined], out[~of_joined] = flat, np.concatenate(alone)
        return size, out

    def ids(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows, one after the other, and the number of each row; null is empty."""
        if not self._ready:
            self._open()
        raw, at = text_bytes(column)
        count = np.zeros(len(column), np.int64)
        if not len(raw):
            return count, np.zeros(0, np.int32)
        kind = self.table[raw]
        lead = np.flatnonzero((raw >= 0xC2) & (raw < 0xCA))
        kind[lead] = self.points[((raw[lead] & 31).astype(np.int64) << 6) | (raw[lead + 1] & 63)]
        kind[lead + 1] = kind[lead]
        rare = np.flatnonzero(kind == RARE)
        slow = np.unique(np.searchsorted(at, rare, side="right") - 1)
        size = np.diff(at)
        quick = size > 0
        quick[slow] = False
        first = np.zeros(len(raw), bool)
        first[at[:-1][size > 0]] = True
        prev = np.concatenate([[SPACE], kind[:-1]])
        after = np.concatenate([kind[1:], [SPACE]])
        last = np.concatenate([first[1:], [True]])
        blank = np.concatenate([[False], raw[:-1] == 32])
        gap = kind == SPACE
        start = first | (gap & ((prev != SPACE) | ((after != SPACE) & ~last))) | (~gap & (prev != kind) & ~blank)
        begin = np.flatnonzero(start)
        end = np.append(begin[1:], len(raw))
        row = np.searchsorted(at, begin, side="right") - 1
        use = quick[row]
        begin, end, row = begin[use], end[use], row[use]
        sizes, flat = self.words.values(raw, begin, end)
        count = np.bincount(row, weights=sizes, minlength=len(column)).astype(np.int64)
        if not len(slow):
            return count, flat
        if self.plain is None:
            from tokenizers import Tokenizer

            self.plain = Tokenizer.from_file(self.vocab)
        plain = [np.array(e.ids, np.int32) for e in self.plain.encode_batch(column.take(pa.array(slow)).to_pylist(), add_special_tokens=False)]
        count[slow] = [len(p) for p in plain]
        out = np.empty(int(count.sum()), np.int32)
        late = np.repeat(np.isin(np.arange(len(column)), slow), count)
        out[late], out[~late] = np.concatenate(plain), flat
        return count, out
