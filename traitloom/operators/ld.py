"""Linkage disequilibrium: correlations, pruning, scores, shrinkage, sparse matrices.

An LD matrix is a table (chr, i, j, r) of its upper triangle, ``i`` before ``j`` by
position; the diagonal is one and not stored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traitloom.operators.ordering import row_index
from traitloom.session import cut, drop_cut, large, spread, work_path

HARD_CALL = 0.1


def variant_blocks(variants: DataFrame, size: int = 5000) -> DataFrame:
    """Add ``block``: runs of ``size`` variants per chromosome in position order, from 0."""
    indexed = row_index(variants, ["pos", "row_id"], "__idx", keys=["chr"])
    return indexed.withColumn("block", F.floor((F.col("__idx") - 1) / size)).drop("__idx")


def near_blocks(placed: DataFrame, window_bp: int) -> DataFrame:
    """Pairs of blocks (b1 <= b2) that hold variants within the window of one another."""
    span = placed.groupBy("chr", "block").agg(F.min("pos").cast("bigint").alias("lo"), F.max("pos").cast("bigint").alias("hi"))
    reach = F.sequence(F.floor(F.col("lo") / window_bp), F.floor((F.col("hi") + window_bp) / window_bp))
    left = span.select("chr", F.col("block").alias("b1"), "hi", F.explode(reach).alias("bin"))
    right = span.select(
        "chr", F.col("block").alias("b2"), F.col("lo").alias("lo2"), F.floor(F.col("lo") / window_bp).alias("bin")
    )
    hit = large(left).join(right, ["chr", "bin"]).where("b2 >= b1 AND lo2 <= hi + " + str(int(window_bp)))
    return hit.select("chr", "b1", "b2")


class _Tile:
    """Sums of products of two blocks of variants, added up over sample blocks."""

    def __init__(self, size: int):
        self.rows: tuple[dict, dict] = ({}, {})
        self.pos: tuple[list, list] = ([], [])
        self.sums = {k: np.zeros((size, size)) for k in ("n", "sx", "sy", "sxx", "syy", "sxy")}

    def place(self, side: int, row: list, pos: list) -> np.ndarray:
        """Numbers of the variants within the tile; new ones are added."""
        known = self.rows[side]
        for r, p in zip(row, pos):
            if r not in known:
                known[r] = len(known)
                self.pos[side].append(p)
        return np.array([known[r] for r in row], dtype=np.int64)

    def add(self, table: pa.Table, hard_calls: bool) -> None:
        """One sample block. ``rint`` keeps calls, half precision would not."""
        dtype = np.float32 if hard_calls else np.float64
        doses = table["doses"].combine_chunks()
        x = doses.flatten().to_numpy(zero_copy_only=False).reshape(len(doses), -1).astype(dtype)
        if hard_calls:
            called = np.rint(x)
            x = np.where(np.abs(x - called) <= HARD_CALL, called, np.nan).astype(dtype)
        side = table["side"].to_numpy()
        row, pos = table["row_id"].to_pylist(), table["pos"].to_pylist()
        known = ~np.isnan(x)
        value, known = np.where(known, x, 0).astype(dtype), known.astype(dtype)
        of = [np.flatnonzero(side == s) for s in (0, 1)]
        if table["b1"][0] == table["b2"][0]:
            of[1] = of[0]
        at = [self.place(s, [row[i] for i in of[s]], [pos[i] for i in of[s]]) for s in (0, 1)]
        (ka, kb), (va, vb) = [known[i] for i in of], [value[i] for i in of]
        cell = np.ix_(*at)
        for name, left, right in (
            ("n", ka, kb), ("sx", va, kb), ("sy", ka, vb), ("sxx", va * va, kb), ("syy", ka, vb * vb), ("sxy", va, vb)
        ):
            self.sums[name][cell] += left @ right.T

    def pairs(self, window: int, min_r2: float) -> dict[str, np.ndarray]:
        """Pairs in position order within the window whose r2 reaches the bound."""
        row = [np.array(list(r), dtype=object) for r in self.rows]
        pos = [np.array(p, dtype=np.int64) for p in self.pos]
        gap = pos[1][None, :] - pos[0][:, None]
        rank = [np.array([r for r in rows]) for rows in row]
        later = (gap > 0) | ((gap == 0) & (rank[1][None, :] > rank[0][:, None]))
        p, q = np.nonzero(later & (gap <= window))
        n, sx, sy, sxx, syy, sxy = (v[p, q] for v in self.sums.values())
        cov, vx, vy = n * sxy - sx * sy, n * sxx - sx * sx, n * syy - sy * sy
        ok = (vx > 0) & (vy > 0)
        r = np.zeros(len(n))
        r[ok] = cov[ok] / np.sqrt(vx[ok] * vy[ok])
        ok &= r * r >= min_r2
        return {"i": row[0][p[ok]], "j": row[1][q[ok]], "r": r[ok], "n": n[ok].astype(np.int64)}


def ld_pairs(
    packed: DataFrame,
    variants: DataFrame,
    window_bp: int,
    min_r2: float = 0.0,
    block_size: int = 512,
    hard_calls: bool = True,
) -> DataFrame:
    """Correlation ``r`` of all variant pairs within ``window_bp``, from complete pairs.

    Variants are cut into blocks of ``block_size`` by rank, so dense regions give more
    blocks, not larger ones. Each near pair of blocks is one task's group; its rows come in the
    order of the sample blocks, so a task holds one sample block of two variant blocks and
    the sums, however large the cohort is, and the threshold applies before anything leaves.
    Pairs with a constant member have no correlation and are left out.
    """
    placed = cut(variant_blocks(variants.select("chr", "pos", "row_id"), block_size))
    near = near_blocks(placed, window_bp)
    roles = near.select("chr", F.col("b1").alias("block"), "b1", "b2", F.lit(0).alias("side")).unionByName(
        near.where("b1 < b2").select("chr", F.col("b2").alias("block"), "b1", "b2", F.lit(1).alias("side"))
    )
    # Variants take their roles first: neither the roles are broadcast nor the genotypes moved once more for them.
    tiles = large(packed).join(large(placed).join(cut(roles), ["chr", "block"]), "row_id")
    tiles = tiles.select("chr", "b1", "b2", "sample_block", "side", "row_id", "pos", "doses")
    window, limit, calls, size = int(window_bp), float(min_r2), hard_calls, int(block_size)
    row_type = dict(variants.dtypes)["row_id"]
    ids = pa.string() if row_type == "string" else pa.int64()

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, chrom, held, block = _Tile(size), None, [], None
        for batch in batches:
            sample = batch.column(batch.schema.get_field_index("sample_block")).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(sample)) + 1).tolist(), len(sample)]
            for a, b in zip(edges[:-1], edges[1:]):
                if held and sample[a] != block:
                    tile.add(pa.Table.from_batches(held), calls)
                    held = []
                chrom, block = batch.column(0)[a].as_py(), sample[a]
                held.append(batch.slice(a, b - a))
        tile.add(pa.Table.from_batches(held), calls)
        found = tile.pairs(window, limit)
        cols = [pa.array([chrom] * len(found["r"]), pa.int32()), pa.array(found["i"].tolist(), ids), pa.array(found["j"].tolist(), ids)]
        yield pa.RecordBatch.from_arrays([*cols, pa.array(found["r"]), pa.array(found["n"])], ["chr", "i", "j", "r", "n"])

    unit = ["chr", "b1", "b2"]
    # The grouping needs the rows sorted by its keys, which this order already is.
    ordered = spread(tiles, *unit).sortWithinPartitions(*unit, "sample_block")
    return ordered.groupBy(*unit).applyInArrow(product, f"chr int, i {row_type}, j {row_type}, r double, n bigint")


def ld_prune(pairs: DataFrame, variants: DataFrame, max_r2: float, max_rounds: int = 10_000) -> DataFrame:
    """Variants left when, of each pair above ``max_r2``, the lesser one goes.

    Greedy by priority (larger ``maf``, then smaller ``row_id``): a variant stays unless a
    staying, better one is correlated with it. Each round settles every variant that has
    no undecided better neighbour; the edges left are written out between rounds.
    """
    variants = cut(variants)
    rank = variants.select("row_id", "maf")
    strong = pairs.where(F.col("r") * F.col("r") > max_r2).select("i", "j")
    edges = (
        large(strong).join(large(rank.select(F.col("row_id").alias("i"), F.col("maf").alias("maf_i"))), "i")
        .join(large(rank.select(F.col("row_id").alias("j"), F.col("maf").alias("maf_j"))), "j")
    )
    i_first = (F.col("maf_i") > F.col("maf_j")) | ((F.col("maf_i") == F.col("maf_j")) & (F.col("i") < F.col("j")))
    edges = cut(
        edges.select(
            F.when(i_first, F.col("i")).otherwise(F.col("j")).alias("better"),
            F.when(i_first, F.col("j")).otherwise(F.col("i")).alias("worse"),
        ).distinct()
    )
    # Losers of all rounds go to one folder, so the end is one anti join.
    lost = work_path(variants.sparkSession, "pruned")
    gone_type = variants.select("row_id").schema
    variants.select("row_id").limit(0).write.parquet(lost)
    for _ in range(max_rounds):
        if edges.isEmpty():
            break
        tops = large(edges.select("better").distinct()).join(
            edges.select(F.col("worse").alias("better")).distinct(), "better", "left_anti"
        )
        gone = cut(large(edges).join(tops, "better", "left_semi").select(F.col("worse").alias("row_id")).distinct())
        gone.write.mode("append").parquet(lost)
        settled = tops.withColumnRenamed("better", "row_id").unionByName(gone)
        left = large(edges).join(settled.withColumnRenamed("row_id", "better"), "better", "left_anti")
        left = large(left).join(gone.withColumnRenamed("row_id", "worse"), "worse", "left_anti")
        new = cut(left.select("better", "worse"))
        drop_cut(edges, gone)
        edges = new
    else:
        raise RuntimeError("pruning did not settle")
    drop_cut(edges)
    gone = variants.sparkSession.read.schema(gone_type).parquet(lost)
    return large(variants).join(gone, "row_id", "left_anti")


def ld_score(ld: DataFrame, passing: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Sum of r2 with all passing variants, itself included, per passing variant.

    With ``by`` (say phenotype) each group has a passing set of its own in ``passing``.
    """
    by = list(by)
    ids = cut(passing.select(*by, "row_id").distinct())
    inner = large(ld).join(ids.withColumnRenamed("row_id", "i"), "i").join(large(ids.withColumnRenamed("row_id", "j")), [*by, "j"])
    both = inner.select(*by, F.explode(F.array("i", "j")).alias("row_id"), (F.col("r") * F.col("r")).alias("r2"))
    own = ids.select(*by, "row_id", F.lit(1.0).alias("r2"))
    return both.unionByName(own).groupBy(*by, "row_id").agg(F.sum("r2").alias("ld_score"))


def interpolate_map(variants: DataFrame, gmap: DataFrame, bin_bp: int = 1_000_000) -> DataFrame:
    """Genetic position ``cm`` of each variant, linear between map knots, flat beyond them.

    Knots become intervals, intervals are spread over position bins, and variants meet them
    by (chromosome, bin). Chromosomes without a map have no ``cm``.
    """
    from pyspark.sql import Window

    # A genetic map is a fixed public table of some ten thousand knots per chromosome.
    nxt = Window.partitionBy("chr").orderBy("pos")
    knots = gmap.groupBy("chr", "pos").agg(F.max("cm").alias("cm"))
    spans = knots.select(
        "chr", F.col("pos").alias("p0"), F.col("cm").alias("c0"),
        F.lead("pos").over(nxt).alias("p1"), F.lead("cm").over(nxt).alias("c1"),
    )
    ends = knots.groupBy("chr").agg(F.min("pos").alias("first"), F.max("pos").alias("last"))
    # The last knot is an interval of its own, closed and empty.
    spans = spans.select("chr", "p0", "c0", F.coalesce("p1", F.col("p0") + 1).alias("p1"), F.coalesce("c1", "c0").alias("c1"))
    spread = F.sequence(F.floor(F.col("p0") / bin_bp), F.floor((F.col("p1") - 1) / bin_bp))
    spans = spans.withColumn("bin", F.explode(spread))
    clamped = variants.join(ends, "chr", "left").withColumn(
        "__p", F.least(F.greatest(F.col("pos"), F.col("first")), F.col("last"))
    )
    clamped = clamped.withColumn("bin", F.floor(F.col("__p") / bin_bp)).alias("v")
    s = spans.alias("s")
    hit = clamped.join(
        s,
        (F.col("v.chr") == F.col("s.chr")) & (F.col("v.bin") == F.col("s.bin"))
        & (F.col("v.__p") >= F.col("s.p0")) & (F.col("v.__p") < F.col("s.p1")),
        "left",
    )
    share = (F.col("v.__p") - F.col("s.p0")) / (F.col("s.p1") - F.col("s.p0"))
    cm = F.col("s.c0") + (F.col("s.c1") - F.col("s.c0")) * share
    return hit.select(*[F.col(f"v.{c}").alias(c) for c in variants.columns], cm.alias("cm"))


def shrink_ld(
    ld: DataFrame, positions: DataFrame, ne: float = 11490.672741, map_n: float = 183.0, cutoff: float = 1e-5
) -> DataFrame:
    """Correlations shrunk by the recombination between the two variants.

    ``positions``: row_id, cm. The factor is ``exp(-4 Ne d / 100 / (2 m))`` with ``d`` the
    distance in centimorgan; entries whose factor is below ``cutoff`` are zero and dropped.
    """
    ci = positions.select(F.col("row_id").alias("i"), F.col("cm").alias("cm_i"))
    cj = positions.select(F.col("row_id").alias("j"), F.col("cm").alias("cm_j"))
    d = F.abs(F.col("cm_j") - F.col("cm_i"))
    factor = F.exp(-4.0 * ne * d / 100.0 / (2.0 * map_n))
    out = large(ld).join(ci, "i").join(large(cj), "j").withColumn("__f", factor).where(F.col("__f") >= cutoff)
    return out.select("chr", "i", "j", (F.col("r") * F.col("__f")).alias("r"))


def sparsify_ld(ld: DataFrame, n: float, chisq: float = 0.0) -> DataFrame:
    """Entries whose chi-square ``n r^2`` exceeds the bound."""
    return ld.where(n * F.col("r") * F.col("r") > chisq)


def merge_ld(pieces: Sequence[DataFrame], variants: DataFrame) -> DataFrame:
    """One matrix from pieces, with indices over all variants in genomic order (from 1)."""
    merged = pieces[0]
    for piece in pieces[1:]:
        merged = merged.unionByName(piece)
    index = row_index(variants.select("chr", "pos", "row_id"), ["chr", "pos", "row_id"], "idx").select("row_id", "idx")
    return (
        large(merged).join(index.select(F.col("row_id").alias("i"), F.col("idx").alias("i_idx")), "i")
        .join(large(index.select(F.col("row_id").alias("j"), F.col("idx").alias("j_idx"))), "j")
        .select("chr", "i", "j", "i_idx", "j_idx", "r")
    )
