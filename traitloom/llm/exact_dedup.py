"""Exact deduplication with compressed radix (Patricia) tries.

Each task of the scan first owns a trie of its own rows, so a text that fills a third of the
table leaves a task once. The distinct texts then go to partitions by (length, content hash),
where a second trie over the full byte strings finds the owner of each text. A trie that
outgrows its budget writes its largest subtree to a file and settles it after the others.
"""

from __future__ import annotations

import hashlib
import os
import pickle
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traitloom.llm.common import batch_pieces, keep_matching, lean, text_bytes, text_or_empty, widened

TRIE_BYTES = 128 << 20


class Trie:
    """Compressed radix trie over byte strings with a merged value per terminal node.

    ``merge(old, new)`` has to be associative and commutative. ``items`` ends the use of the
    trie. With ``folder`` None nothing is written: ``add`` then reports when the budget is
    reached and the caller empties the trie (partial aggregation).
    """

    # A node is [label, terminal value or None, children by first byte or None].
    def __init__(self, merge: Callable, budget: int = TRIE_BYTES, folder: str | None = None):
        self.merge, self.budget, self.folder = merge, budget, folder
        self.root: list = [b"", None, {}]
        self.held, self.by_branch, self.files = 0, {}, {}

    def add(self, text: bytes, value) -> bool:
        """Insert; True once the trie holds more than its budget."""
        branch = text[:1]
        if branch in self.files:
            pickle.dump((text, value), self.files[branch])
            return False
        cost = self._insert(text, value)
        self.held += cost
        self.by_branch[branch] = self.by_branch.get(branch, 0) + cost
        if self.held <= self.budget:
            return False
        if self.folder is None:
            return True
        self._spill()
        return False

    def _insert(self, text: bytes, value) -> int:
        """Walk from the root; returns the bytes that the new node takes."""
        node, at, end = self.root, 0, len(text)
        while at < end:
            child = node[2].get(text[at]) if node[2] else None
            if child is None:
                if node[2] is None:
                    node[2] = {}
                node[2][text[at]] = [text[at:], value, None]
                return end - at + 300
            label = child[0]
            if text.startswith(label, at):
                node, at = child, at + len(label)
                continue
            same = _common(label, text, at)
            upper = [label[:same], None, {label[same]: child}]
            child[0] = label[same:]
            node[2][text[at]] = upper
            node, at = upper, at + same
        new = node[1] is None
        node[1] = value if new else self.merge(node[1], value)
        return 100 if new else 0

    def _spill(self) -> None:
        """Move the largest subtree below the root to a file; later rows of it follow."""
        branch = max(self.by_branch, key=self.by_branch.get)
        if not branch:
            return
        subtree = self.root[2].pop(branch[0])
        handle, name = tempfile.mkstemp(dir=self.folder)
        out = self.files[branch] = os.fdopen(handle, "w+b")
        os.unlink(name)
        for text, value in _walk(subtree, b""):
            pickle.dump((text, value), out)
        self.held -= self.by_branch.pop(branch)

    def items(self) -> Iterator[tuple[bytes, object]]:
        """All (text, value), each text once; spilled subtrees are rebuilt one at a time."""
        yield from _walk(self.root, b"")
        self.root = [b"", None, {}]
        for branch, out in self.files.items():
            # The inner trie leaves out what all rows of the file begin with, so it does branch.
            shared = None
            for text, _ in _load(out):
                shared = text if shared is None else shared[: _common(shared, text, 0)]
            inner = Trie(self.merge, self.budget, self.folder)
            for text, value in _load(out):
                inner.add(text[len(shared) :], value)
            out.close()
            for rest, value in inner.items():
                yield shared + rest, value


def _load(file) -> Iterator[tuple[bytes, object]]:
    file.seek(0)
    while True:
        try:
            yield pickle.load(file)
        except EOFError:
            return


def _common(label: bytes, text: bytes, at: int) -> int:
    """Length of the common prefix of ``label`` and ``text[at:]`` by halving."""
    low, high = 0, min(len(label), len(text) - at)
    while low < high:
        mid = (low + high + 1) // 2
        if text.startswith(label[:mid], at):
            low = mid
        else:
            high = mid - 1
    return low


def _walk(node: list, prefix: bytes) -> Iterator[tuple[bytes, object]]:
    stack = [(node, prefix)]
    while stack:
        node, prefix = stack.pop()
        text = prefix + node[0]
        if node[1] is not None:
            yield text, node[1]
        for child in (node[2] or {}).values():
            stack.append((child, text))


def _better(keep: str) -> Callable:
    def merge(a: tuple, b: tuple) -> tuple:
        """(id or None, rows): the kept id, None only if there is no other; rows add up."""
        if a[0] is None or b[0] is None:
            best = b[0] if a[0] is None else a[0]
        else:
            best = max(a[0], b[0]) if keep == "largest" else min(a[0], b[0])
        return best, a[1] + b[1]

    return merge


def with_digest(df: DataFrame, text_col: str, name: str = "text_sha256") -> DataFrame:
    """All columns and ``name``: SHA-256 of the text with A-Z lower-cased; null is empty."""
    if name in df.columns:
        df = df.drop(name)
    schema = widened(df, **{name: "string"})

    @lean
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batch_pieces(batches, text_col):
            i = batch.schema.get_field_index(text_col)
            raw, at = text_bytes(batch.column(i))
            data = raw.tobytes().lower()
            out = [hashlib.sha256(data[a:b]).hexdigest() for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], [*batch.schema.names, name])

    return df.mapInArrow(digest, schema)


def text_owners(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", trie_bytes: int = TRIE_BYTES
) -> DataFrame:
    """One row per distinct text: text_sha256, keep_id, group_size.

    Texts are equal when their bytes are, after lower-casing A-Z. ``keep`` names the id that
    a terminal node stores, ``smallest`` or ``largest``; null ids lose to any other. A null
    text is empty, and empty texts are one group. Repeated rows count in ``group_size``.
    Other columns are not read, whatever their names.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    merge = _better(keep)

    @lean
    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(merge, trie_bytes)
        for batch in batch_pieces(batches, "text"):
            raw, at = text_bytes(batch.column(1))
            data = raw.tobytes().lower()
            for i, a, b in zip(batch.column(0).to_pylist(), at[:-1].tolist(), at[1:].tolist()):
                if trie.add(data[a:b], (i, 1)):
                    yield from _texts(trie)
                    trie = Trie(merge, trie_bytes)
        yield from _texts(trie)

    parts = rows.mapInArrow(local, "size long, text binary, id long, n long")
    dealt = parts.repartition(F.col("size"), F.xxhash64("text"))

    @lean
    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with tempfile.TemporaryDirectory() as folder:
            trie = Trie(merge, trie_bytes, folder)
            for batch in batch_pieces(batches, "text"):
                for text, i, n in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3))):
                    trie.add(text, (i, n))
            digests, ids, counts = [], [], []
            for text, (i, n) in trie.items():
                digests.append(hashlib.sha256(text).hexdigest())
                ids.append(i)
                counts.append(n)
        yield pa.RecordBatch.from_pydict(
            {"text_sha256": pa.array(digests, pa.string()), "keep_id": pa.array(ids, pa.int64()), "group_size": pa.array(counts, pa.int64())}
        )

    return dealt.mapInArrow(settle, "text_sha256 string, keep_id long, group_size long")


def _texts(trie: Trie, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The content of a trie in batches of about ``limit`` bytes."""
    rows, held = [], 0
    for text, (i, n) in trie.items():
        rows.append((len(text), text, i, n))
        held += len(text) + 64
        if held > limit:
            yield _batch(rows)
            rows, held = [], 0
    yield _batch(rows)


def _batch(rows: list) -> pa.RecordBatch:
    size, text, ids, n = zip(*rows) if rows else ((), (), (), ())
    return pa.RecordBatch.from_arrays(
        [pa.array(size, pa.int64()), pa.array(text, pa.binary()), pa.array(ids, pa.int64()), pa.array(n, pa.int64())],
        ["size", "text", "id", "n"],
    )


def exact_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", trie_bytes: int = TRIE_BYTES
) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    ``kept`` marks rows whose id is the kept one; rows that repeat one id and one text are one
    document listed as often as it comes, and a group without any id keeps all its rows. An
    empty table gives an empty result.
    """
    owners = text_owners(docs, id_col, text_col, keep, trie_bytes)
    rows = with_digest(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), "text").drop("text")
    out = rows.join(owners, "text_sha256")
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_exact_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", trie_bytes: int = TRIE_BYTES
) -> DataFrame:
    """The documents with one row of each text left, all columns; a repeated row stays once."""
    owners = text_owners(docs, id_col, text_col, keep, trie_bytes)
    id0, missing = F.coalesce(F.col(id_col).cast("long"), F.lit(0)), F.col(id_col).isNull()
    rows = with_digest(docs, text_col, "__sha").withColumns({"__id": id0, "__null": missing})
    own = owners.select(
        F.col("text_sha256").alias("__sha"), F.coalesce("keep_id", F.lit(0)).alias("__id"), F.col("keep_id").isNull().alias("__null")
    )
    return keep_matching(rows, own, ["__sha", "__id", "__null"]).drop("__sha", "__id", "__null")
