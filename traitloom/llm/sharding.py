"""Reproducible shuffle into shards: a Feistel permutation with cycle walking over global row numbers.

Rows get numbers 0 to n - 1 in the order of id, text size, checksum and hash. The permutation maps a number
to a position; position ``p`` is slot ``p div shards`` of shard ``p mod shards``, so shard sizes differ by one
row at most. Both directions are arithmetic: a number gives its shard and slot without a look at other rows,
and a shard and slot give the number back.

The network works on a rectangle of ``a`` by ``b`` cells with ``a * b`` just above n, so fewer than ``a``
cells are outside and hardly a row walks. How far the longest walk goes is measured on those cells, exactly.

Only DataFrame functions run here.

Edge cases: a null text has no bytes (size 1, checksum 0); a null id sorts first; equal rows are
interchangeable (which of them has which slot does not change the result); an empty table gives an empty
result; columns of the input named like a result column are replaced.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from traitloom.llm.common import text_or_empty
from traitloom.operators.ordering import row_index
from traitloom.session import cut

SHARDS = 8
SEED = 20_240_229
ROUNDS = 6
LAW = "rows"


@dataclass(frozen=True)
class Shuffle:
    """A permutation of 0 .. rows - 1, dealt over ``shards``. ``walk``: most steps a walk needs."""

    rows: int
    shards: int = SHARDS
    seed: int = SEED
    walk: int = 0

    @property
    def sides(self) -> tuple[int, int]:
        a = max(1, math.isqrt(max(0, self.rows - 1)) + 1)
        return a, max(1, -(-self.rows // a))

    def _mixed(self, half: Column, turn: int, side: int) -> Column:
        return F.pmod(F.xxhash64(F.lit(self.seed), F.lit(turn), half), F.lit(side))

    def once(self, number: Column, back: bool = False) -> Column:
        """One pass of the network over a cell number of the rectangle, or its inverse."""
        a, b = self.sides
        left, right = F.call_function("div", number, F.lit(b)), F.pmod(number, F.lit(b))
        for turn in reversed(range(ROUNDS)) if back else range(ROUNDS):
            if turn % 2 == 0:
                mixed = self._mixed(right, turn, a)
                left = F.pmod(left - mixed if back else left + mixed, F.lit(a))
            else:
                mixed = self._mixed(left, turn, b)
                right = F.pmod(right - mixed if back else right + mixed, F.lit(b))
        return left * F.lit(b) + right

    def _walked(self, df: DataFrame, number: str, name: str, back: bool) -> DataFrame:
        df = df.withColumn(name, self.once(F.col(number), back))
        if not self.walk:
            return df
        on = F.aggregate(
            F.sequence(F.lit(1), F.lit(self.walk)), F.col(name),
            lambda p, _: F.when(p < self.rows, p).otherwise(self.once(p, back)),
        )
        return df.withColumn(name, F.when(F.col(name) < self.rows, F.col(name)).otherwise(on))

    def place(self, df: DataFrame, number: str) -> DataFrame:
        """Add ``shard`` and ``slot`` of the row numbers in ``number``."""
        out = self._walked(df, number, "__position", False)
        slot = F.call_function("div", F.col("__position"), F.lit(self.shards)).cast("bigint")
        return out.withColumns(
            {"shard": F.pmod(F.col("__position"), F.lit(self.shards)).cast("int"), "slot": slot}
        ).drop("__position")

    def numbers(self, df: DataFrame, name: str) -> DataFrame:
        """Add the row number at each ``shard`` and ``slot``: the way back."""
        cell = F.col("slot").cast("bigint") * F.lit(self.shards) + F.col("shard")
        return self._walked(df.withColumn("__position", cell), "__position", name, True).drop("__position")


def shuffle_of(spark: SparkSession, rows: int, shards: int = SHARDS, seed: int = SEED) -> Shuffle:
    """The permutation of ``rows`` numbers, its longest walk measured on the cells outside (fewer than sqrt(rows) + 1).

    A walk begins at an outside cell whose predecessor is inside; outside cells that only lead to each other are on none.
    """
    plain = Shuffle(rows, shards, seed)
    a, b = plain.sides
    longest = 0
    for back in (False, True):
        outside = spark.range(rows, max(rows, a * b)).select(F.col("id").alias("p"))
        steps, outside = 0, outside.where(plain.once(F.col("p"), not back) < rows)
        while outside.count():
            steps += 1
            outside = cut(outside.select(plain.once(F.col("p"), back).alias("p")).where(F.col("p") >= rows))
        longest = max(longest, steps)
    return Shuffle(rows, shards, seed, longest)


def sharded(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, seed: int = SEED, keep: list[str] | None = None
) -> DataFrame:
    """``docs`` with ``size``, ``text_crc32``, ``row_no``, ``shard`` and ``slot``.

    ``keep`` names the columns that go along (all by default); what is not kept does not move. The sort
    spreads equal keys, so an id or a text of a third of the rows does not fill one task.
    """
    made = ("size", "text_crc32", "row_no", "shard", "slot")
    keep = [c for c in (docs.columns if keep is None else keep) if c not in made]
    raw = text_or_empty(text_col).cast("binary")
    rows = docs.select(
        *[F.col(c) for c in keep],
        (F.octet_length(raw) + 1).cast("bigint").alias("size"), F.crc32(raw).alias("text_crc32"),
        F.col(id_col).alias("__id"), F.xxhash64(raw).alias("__hash"), F.monotonically_increasing_id().alias("__tie"),
    )
    numbered = row_index(rows, ["__id", "size", "text_crc32", "__hash", "__tie"], name="row_no")
    numbered = numbered.drop("__id", "__hash", "__tie").withColumn("row_no", F.col("row_no") - 1)
    return shuffle_of(docs.sparkSession, numbered.count(), shards, seed).place(numbered, "row_no")


def write_shards(docs: DataFrame, path: str, **options) -> None:
    """Write ``sharded(docs)`` as one folder per shard; the files of a folder hold runs of slots in order."""
    placed = sharded(docs, **options)
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = placed.repartitionByRange(n, "shard", "slot").sortWithinPartitions("shard", "slot")
    ordered.write.partitionBy("shard").parquet(path)


def shard_table(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """One row per document: where it is, under the law that shard counts are one apart at most."""
    placed = sharded(docs, shards=shards, keep=["doc_id"])
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row_no"
    )
