"""Document quality: logistic regression on hashed word n-grams, trained with FTRL-proximal.

Tokens are runs of letters and digits or runs of signs. Their unigrams and bigrams are hashed
into a fixed number of weights; a score is a sparse dot product with the share of each feature in the text.
Training reads the documents of a bounded sample once per pass, in several shards that each
follow the regularised leader; the mean of their weights is the model.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traitloom.llm.common import batch_pieces, crc_mod, shared, text_bytes, text_or_empty, widened
from traitloom.llm.words import word_keys

BITS = 18
SAMPLE_ROWS = 16_000
SHARDS = 8
PASSES = 3
ALPHA, BETA, L1, L2 = 1.0, 1.0, 0.02, 0.1
GAIN = 30.0  # features of a text are its shares times this
_KIND = np.full(256, 2, np.uint8)  # 0 white space, 1 letters, digits and longer characters, 2 signs
_KIND[[32, *range(9, 14)]] = 0
_KIND[128:] = 1
for _a, _b in ((48, 58), (65, 91), (97, 123)):
    _KIND[_a:_b] = 1
_PAIR = np.uint64(0x9E3779B97F4A7C15)


def hashed(raw: np.ndarray, at: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of every unigram and bigram of the rows of a byte buffer."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = _KIND[raw]
    first = np.zeros(len(raw), bool)
    first[at[:-1][at[:-1] < len(raw)]] = True
    edge = first | (kind != np.concatenate([[0], kind[:-1]]))
    begin = np.flatnonzero(edge)
    end = np.append(begin[1:], len(raw))
    word = kind[begin] > 0
    begin, end = begin[word], end[word]
    key = word_keys(raw, begin, end)
    row = np.searchsorted(at, begin, side="right") - 1
    both = row[1:] == row[:-1]
    pair = (key[:-1] * _PAIR ^ key[1:])[both] * _PAIR
    shift = np.uint64(64 - bits)
    one = (key * _PAIR) >> shift
    return np.concatenate([row, row[1:][both]]), np.concatenate([one, pair >> shift]).astype(np.int64)


class Ftrl:
    """FTRL-proximal with per-coordinate rates; ``w`` is computed where it is needed."""

    def __init__(self, bits: int):
        self.z, self.n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)  # the last one is the intercept

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2)
        return np.where(np.abs(z) <= L1, 0.0, w)

    def learn(self, at: np.ndarray, x: np.ndarray, y: float) -> None:
        w = self.weights(at)
        p = 1.0 / (1.0 + np.exp(-np.clip(w @ x, -35, 35)))
        g = (p - y) * x
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / ALPHA
        self.z[at] += g - sigma * w
        self.n[at] += g * g


def _examples(raw: np.ndarray, at: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct features and their values, row by row, with the intercept."""
    row, feature = hashed(raw, at, bits)
    order = np.argsort(row, kind="stable")
    stop = np.searchsorted(row[order], np.arange(len(at)))
    for i in range(len(at) - 1):
        ids, n = np.unique(feature[order[stop[i] : stop[i + 1]]], return_counts=True)
        yield np.append(ids, 1 << bits), np.append(GAIN * n / max(1, n.sum()), 1.0)


def fit(rows: DataFrame, sample_rows: int = SAMPLE_ROWS, bits: int = BITS) -> np.ndarray:
    """Weights (2^bits and the intercept) from rows (id, text, label 0/1).

    About ``sample_rows`` rows are used, chosen by a hash of the id; each shard holds its share
    in memory in id order, so a rerun gives the same weights. Zeros if there is no row.
    """
    total = rows.count()
    chance = F.pmod(F.xxhash64(F.lit("quality"), "id"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    picked = rows.where(chance < min(1.0, sample_rows / max(1, total)))
    picked = picked.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(SHARDS)).cast("int"))

    def train(table: pa.Table) -> pa.Table:
        order = np.lexsort((table["text"].to_pandas().str.len().to_numpy(), table["id"].fill_null(0).to_numpy()))
        table = table.take(pa.array(order)).combine_chunks()
        raw, at = text_bytes(table["text"].chunk(0))
        label = table["label"].to_numpy()
        examples = []
        for a in range(0, len(label), 256):
            stop = at[a : a + 257]
            examples += list(_examples(raw[stop[0] : stop[-1]], stop - stop[0], bits))
        # Passes go through the rows in a fixed shuffle, so runs of one label do no harm.
        deal, model = np.random.default_rng(5), Ftrl(bits)
        for _ in range(PASSES):
            for i in deal.permutation(len(label)):
                model.learn(*examples[i], float(label[i]))
        w = model.weights(slice(None))
        used = np.flatnonzero(w)
        return pa.table({"at": used, "w": w[used]})

    parts = picked.select("shard", "id", "text", "label").groupBy("shard").applyInArrow(train, "at long, w double").collect()
    weights = np.zeros((1 << bits) + 1)
    shards = max(1, picked.select("shard").distinct().count())
    for r in sorted(parts, key=lambda r: (r["at"], r["w"])):  # at most SHARDS * (2^bits + 1) rows
        weights[r["at"]] += r["w"] / shards
    return weights


def score(docs: DataFrame, weights: np.ndarray, text_col: str = "text", name: str = "score", bits: int = BITS) -> DataFrame:
    """All columns and ``name``: the chance of label 1 for the whole text; an earlier column goes.

    Null and empty texts, and texts without a token, get the score of the intercept.
    """
    docs = docs.drop(name)
    model = shared(docs.sparkSession, weights)  # 2^bits + 1 numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = model.value
        for batch in batch_pieces(batches, text_col):
            raw, at = text_bytes(batch.column(batch.schema.get_field_index(text_col)))
            row, feature = hashed(raw, at, bits)
            n = np.bincount(row, minlength=batch.num_rows)
            dot = np.bincount(row, weights=w[feature], minlength=batch.num_rows) * GAIN / np.maximum(n, 1) + w[-1]
            out = 1.0 / (1.0 + np.exp(-np.clip(dot, -35, 35)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], [*batch.schema.names, name])

    return docs.mapInArrow(run, widened(docs, **{name: "double"}))


def learn_and_score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """doc_id, held_out, score, predicted; learnt from rows whose crc32(id) mod 3 is not 1.

    Labels may repeat: an id takes the more frequent one, 1 if even; null labels teach nothing.
    """
    held = crc_mod(id_col, 3) == 1
    known = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(
        (F.avg(F.col(label_col).cast("double")) >= 0.5).cast("int").alias("label")
    )
    teach = docs.where(~held).select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    # The sample is drawn from the labels, so only its texts are looked up.
    total = max(1, known.count())
    chance = F.pmod(F.xxhash64(F.lit("labels"), "id"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    picked = known.where(chance < min(1.0, 1.5 * SAMPLE_ROWS / total))  # about 24,000 rows of two numbers
    weights = fit(teach.join(F.broadcast(picked), "id"))
    rows = docs.select(F.col(id_col).alias("doc_id"), held.alias("held_out"), text_or_empty(text_col).alias("text"))
    out = score(rows, weights, "text")
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
