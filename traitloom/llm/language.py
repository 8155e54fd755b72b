"""Language identification by rank-order n-gram profiles.

A language's profile is the list of its most frequent byte n-grams (one to three bytes of
lower-cased text, runs of other than letters as one space). A document's own list is compared
with each profile by the out-of-place distance: the sum of the differences in rank, with the
largest difference for an n-gram that the profile lacks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traitloom.llm.common import batch_pieces, crc_mod, lean, shared, text_or_empty, widened

TOP = 300
SAMPLE_ROWS = 8000
MIN_SCORE = 0.05
UNKNOWN = "und"
_PLAIN_LETTER = re.compile(r"[A-Za-z]")


def _letters() -> np.ndarray:
    """Byte classes: ASCII letters lower-cased, bytes of longer characters as they are, else a space."""
    table = np.full(256, 32, np.uint8)
    table[128:] = np.arange(128, 256)
    for b in range(ord("a"), ord("z") + 1):
        table[b] = table[b - 32] = b
    return table


_TABLE = _letters()


def has_letter(text: str) -> bool:
    """Whether a character of the Unicode letter categories occurs; superscripts, fractions and numerals are none."""
    return bool(_PLAIN_LETTER.search(text)) or any(map(str.isalpha, text))


def top_ngrams(text: str, top: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``top`` most frequent n-grams (codes) and their counts; ties by smaller code."""
    raw = _TABLE[np.frombuffer(text.lower().encode(), np.uint8)]
    space = raw == 32
    raw = raw[~(space & np.concatenate([[True], space[:-1]]))] if len(raw) else raw
    raw = np.concatenate([[32], raw, [32]]).astype(np.uint32)
    one = raw
    two = raw[:-1] << np.uint32(8) | raw[1:]
    three = two[:-1] << np.uint32(8) | raw[2:]
    codes = np.concatenate([one[one != 32], two, three])
    codes.sort()
    edge = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
    count = np.diff(np.append(edge, len(codes)))
    found = codes[edge]
    order = np.argsort(-count, kind="stable")[:top]
    return found[order], count[order]


def fit_profiles(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = SAMPLE_ROWS, top: int = TOP
) -> dict[str, list[int]]:
    """Profiles by language from labelled documents with text.

    Fitted on a sample of about ``sample_rows`` rows, spread evenly over the languages that a
    count finds, chosen by a hash of the id. A document adds its n-gram shares, so a long one
    does not outvote the rest. The result has ``top`` codes per language.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(sample_rows).collect()}
    if not sizes:
        return {}
    each = max(1, sample_rows // len(sizes))
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, each / n))])
    chance = F.pmod(F.xxhash64(F.lit("profile"), "id"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    rows = rows.where(chance < share[F.col("lang")])

    @lean
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, codes, shares = [], [], []
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                code, n = top_ngrams(text, 4 * top)
                langs += [lang] * len(code)
                codes.append(code.astype(np.int64))
                # Whole millionths: sums do not depend on the order of the rows.
                shares.append((1_000_000 * n / max(1, n.sum())).astype(np.int64))
            if langs:
                yield pa.RecordBatch.from_pydict({"lang": langs, "code": np.concatenate(codes), "share": np.concatenate(shares)})

    grams = rows.select("text", "lang").mapInArrow(count, "lang string, code long, share long")
    total = grams.groupBy("lang", "code").agg(F.sum("share").alias("share"))
    ranked = total.groupBy("lang").agg(
        F.slice(F.sort_array(F.collect_list(F.struct((-F.col("share")).alias("s"), "code"))), 1, top).alias("best")
    )  # a language has at most 2^24 n-grams, and the sample bounds them further
    return {r["lang"]: [b["code"] for b in r["best"]] for r in ranked.collect()}


class Profiles:
    """Rank of every profiled n-gram in every language, and the distances of a text."""

    def __init__(self, profiles: dict[str, list[int]], top: int = TOP):
        self.langs, self.top = sorted(profiles), top
        self.codes = np.unique(np.array([c for p in profiles.values() for c in p], np.int64))
        self.rank = np.full((len(self.langs), len(self.codes) + 1), -1, np.int64)
        for k, lang in enumerate(self.langs):
            self.rank[k, np.searchsorted(self.codes, profiles[lang])] = np.arange(len(profiles[lang]))

    def best(self, text: str | None) -> tuple[str, float]:
        """Language with the least distance (ties: first by name) and 1 - distance / worst."""
        if not text or not self.langs or not has_letter(text):
            return UNKNOWN, 0.0
        code, _ = top_ngrams(text, self.top)
        at = np.searchsorted(self.codes, code)
        at[at == len(self.codes)] = 0
        at = np.where(self.codes[at] == code, at, len(self.codes))
        rank = self.rank[:, at]
        apart = np.where(rank < 0, self.top, np.abs(rank - np.arange(len(code))[None, :]))
        total = apart.sum(axis=1)
        k = int(np.argmin(total))
        return self.langs[k], float(1.0 - total[k] / (self.top * len(code)))


def identify(docs: DataFrame, profiles: dict[str, list[int]], text_col: str = "text", top: int = TOP) -> DataFrame:
    """All columns with lang_pred and score (0 to 1); earlier columns of these names go.

    Whole texts are read. Null text or text without a letter is ``und`` with score 0, and so is
    every text if no profile was learnt.
    """
    docs = docs.drop("lang_pred", "score")
    model = shared(docs.sparkSession, Profiles(profiles, top))  # top codes per learnt language

    @lean
    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batch_pieces(batches, text_col):
            texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
            found = [model.value.best(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                [*batch.schema.names, "lang_pred", "score"],
            )

    return docs.mapInArrow(label, widened(docs, lang_pred="string", score="double"))


def learn_and_identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score; profiles from rows whose crc32(id) mod 4 is not 2."""
    held = crc_mod(id_col, 4) == 2
    profiles = fit_profiles(docs.where(~held), id_col, text_col, lang_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), held.alias("held_out"), text_or_empty(text_col).alias("text"))
    return identify(rows, profiles).select("doc_id", "held_out", "lang_pred", "score")


def drop_unidentified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", min_score: float = MIN_SCORE) -> DataFrame:
    """The documents whose language is found with at least ``min_score``; columns as they were."""
    profiles = fit_profiles(docs, id_col, text_col, lang_col)
    names = {c: f"__in_{c}" for c in ("lang_pred", "score") if c in docs.columns}
    rows = docs.withColumnsRenamed(names)
    seen = identify(rows, profiles, names.get(text_col, text_col))
    kept = seen.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= min_score)).drop("lang_pred", "score")
    return kept.withColumnsRenamed({v: k for k, v in names.items()}).select(*docs.columns)
