"""Prefix trie of conversations, its subtree sums by the Euler-tour technique.

Every distinct sequence of first turns is a node. Each node has an arc that enters it and one that leaves it;
each arc knows the next one of a depth-first tour. The list is ranked distributedly: runs of arcs that lie
in one Arrow batch become one arc each (arcs are sorted by conversation and depth, so a stretch of a
conversation shared with no other is such a run), then rounds of random splicing take out about a quarter of
the arcs each, and the last few thousand are ranked at once. Going back through the rounds gives each arc
its position. Prefix sums over positions then give what lies between entering and leaving a node.

No step gathers a conversation, a node or a level: prefix sums run over blocks of positions, equal prefixes
are counted before they move, the digest of the conversations that end at a node is read as a sorted stream
of chunks (a digest is a chain, so one task reads those bytes, but holds one chunk at a time).

Edge cases: rows without a conversation id belong to no conversation; a null role or text is empty; a null
turn comes first; turns with equal numbers follow role, then digest, and repeated rows are turns of their
own; an empty table has no node, one with conversations that all lose their turns has the root alone.
Columns of the input with other names play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from traitloom.llm.common import drop_tables
from traitloom.operators.ordering import row_index
from traitloom.session import cut

FAMILY = 100
HEAD = 6
BLOCK = 4096
#: So many arcs are ranked in one task at the end.
LAST = 4096
_PIECES = ("a", "b", "c", "d")
_MOD = 1 << 40
_NO_TURN = "0" * 40


def prefix_sums(df: DataFrame, keys: list[str], at: str, values: list[str], block: int = BLOCK, modulus: int | None = None) -> DataFrame:
    """Replace ``values`` (whole numbers) by their inclusive sums up to the position ``at`` (from 0) in each key.

    Sums run inside blocks of positions; the totals of blocks are summed the same way, block by block of
    blocks, so neither a key nor a total of blocks has to fit in a task.
    """
    rows = df.withColumn("__block", F.call_function("div", F.col(at), F.lit(block)))

    def held(c: Column) -> Column:
        return F.pmod(c, F.lit(modulus)) if modulus else c

    window = Window.partitionBy(*keys, "__block").orderBy(at)
    inside = rows.withColumns({v: held(F.sum(v).over(window)) for v in values})
    top = rows.agg(F.max("__block")).first()[0]
    if not top:
        return inside.drop("__block")
    totals = cut(rows.groupBy(*keys, "__block").agg(*[held(F.sum(v)).alias(v) for v in values]))
    before = prefix_sums(totals.withColumnRenamed("__block", "__at"), keys, "__at", values, block, modulus)
    before = before.select(*keys, (F.col("__at") + 1).alias("__block"), *[F.col(v).alias(f"__{v}") for v in values])
    out = inside.join(before, [*keys, "__block"], "left")
    return out.withColumns({v: held(F.col(v) + F.coalesce(f"__{v}", F.lit(0))) for v in values}).select(*df.columns)


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rebuilt conversations: rows (conv_id, at from 1, sha, chars) and one row (conv_id, turns) each.

    A conversation starts with the first turns of the first conversation of its family, as many as its
    checksum says, and goes on with its own turns behind as many. Texts stay where they are: what moves is
    their digest and length.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = turns.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("bigint").alias("conv_id"), "turn", role.alias("role"),
        F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256).alias("sha"),
        F.char_length(text).cast("bigint").alias("chars"), F.monotonically_increasing_id().alias("__tie"),
    )
    own = cut(row_index(rows, ["turn", "role", "sha", "__tie"], "at", ["conv_id"]).select("conv_id", "at", "sha", "chars"))
    convs = own.groupBy("conv_id").agg(F.max("at").alias("own")).select(
        "conv_id", "own", (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("first"),
        (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEAD).alias("h"),
    )
    heads = own.where(F.col("at") < HEAD).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("at", "sha", "chars"))).alias("head"))
    joined = convs.join(heads.withColumnRenamed("conv_id", "first"), "first", "left")
    convs = cut(joined.select("conv_id", "own", "h", F.slice(F.coalesce("head", F.array()), 1, F.col("h").cast("int")).alias("head")))
    k = F.size("head")
    copied = convs.select("conv_id", F.inline("head"))
    rest = own.join(convs.select("conv_id", "h", k.alias("k")), "conv_id").where("at > h")
    rest = rest.select("conv_id", (F.col("k") + F.col("at") - F.col("h")).alias("at"), "sha", "chars")
    lengths = convs.select("conv_id", (k + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("turns"))
    return copied.unionByName(rest), lengths


def _pieces(sha: Column) -> dict[str, Column]:
    """Four numbers of 40 bits of a turn at its depth."""
    return {p: F.conv(F.substring(sha, 10 * i + 1, 10), 16, 10).cast("bigint") for i, p in enumerate(_PIECES)}


def _key(pieces: list[Column]) -> Column:
    return F.concat(*[F.lpad(F.hex(p), 10, "0") for p in pieces])


def prefixes(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """(conv_id, at, chars, key, parent_key) per turn: keys name the sequence of turns up to here and up to before.

    A key is the sum, four times modulo 2^40, of the digests of (depth, turn), so it comes from prefix sums.
    """
    own = F.sha2(F.concat(F.col("at").cast("string"), F.lit(":"), F.col("sha")).cast("binary"), 256)
    rows = turns.select("conv_id", "chars", (F.col("at") - 1).alias("at"), own.alias("__own"))
    rows = rows.withColumns(_pieces(F.col("__own"))).withColumns({f"{p}0": F.col(p) for p in _PIECES}).drop("__own")
    sums = prefix_sums(cut(rows), ["conv_id"], "at", list(_PIECES), block, _MOD)
    before = [F.pmod(F.col(p) - F.col(f"{p}0"), F.lit(_MOD)) for p in _PIECES]
    key = _key([F.col(p) for p in _PIECES])
    return cut(sums.select("conv_id", (F.col("at") + 1).alias("at"), "chars", key.alias("key"), _key(before).alias("parent_key")))


def ends_digests(ends: DataFrame) -> DataFrame:
    """(key, sha256) of the decimal ids of ``ends`` (key, conv_id), ascending and comma-joined, per key."""

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            starts = [i for i in range(len(keys)) if not i or keys[i] != keys[i - 1]]
            runs = list(zip(starts, [*starts[1:], len(keys)]))
            yield pa.RecordBatch.from_pydict({
                "key": [keys[a] for a, _ in runs], "first": [ids[a] for a, _ in runs],
                "part": [",".join(map(str, ids[a:b])) for a, b in runs],
            }, pa.schema([("key", pa.string()), ("first", pa.int64()), ("part", pa.string())]))

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = pa.schema([("key", pa.string()), ("ends_sha256", pa.string())])
        last, state = None, None
        for batch in batches:
            done = []
            for key, part in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if key == last:
                    state.update(b"," + part.encode())
                    continue
                if last is not None:
                    done.append((last, state.hexdigest()))
                last, state = key, hashlib.sha256(part.encode())
            yield pa.RecordBatch.from_pydict({"key": [k for k, _ in done], "ends_sha256": [s for _, s in done]}, out)
        if last is not None:
            yield pa.RecordBatch.from_pydict({"key": [last], "ends_sha256": [state.hexdigest()]}, out)

    parts = ends.select("key", "conv_id").orderBy("key", "conv_id").mapInArrow(chunks, "key string, first bigint, part string")
    streams = parts.repartition("key").sortWithinPartitions("key", "first")
    return streams.mapInArrow(digests, "key string, ends_sha256 string")


def _walk(arcs: np.ndarray, follows: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For arcs of one batch: index of the head of each one's run, the way from it, index of the run's tail.

    ``follows``: id of the next arc, below 0 behind the last one.
    """
    n, order = len(arcs), np.argsort(arcs)
    spot = np.minimum(np.searchsorted(arcs[order], follows), n - 1)
    after = np.where(arcs[order][spot] == follows, order[spot], -1)
    head, way = np.arange(n), np.zeros(n, np.int64)
    inner = np.nonzero(after >= 0)[0]
    head[after[inner]], way[after[inner]] = inner, weights[inner]
    while True:
        further = head[head]
        if (further == head).all():
            break
        way, head = way + way[head], further
    tail = np.zeros(n, np.int64)
    ends = np.nonzero(after < 0)[0]
    tail[head[ends]] = ends
    return head, way, tail


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contract the runs of each batch of (arc, next, leaves, saved)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        arc, follows = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        head, way, tail = _walk(arc, follows, np.ones(len(arc), np.int64))
        first = head == np.arange(len(arc))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), batch.column(3), pa.array(arc[head]), pa.array(way), pa.array(first),
             pa.array(np.where(first, follows[tail], -1)), pa.array(np.where(first, way[tail] + 1, 0))],
            names=["arc", "leaves", "saved", "head", "way", "first", "next", "weight"],
        )


def _positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Positions of the last arcs of the list, all of them in one task."""
    if held := list(batches):
        table = pa.Table.from_batches(held)
        arc, follows, weight = [table.column(i).to_numpy() for i in range(3)]
        _, way, _ = _walk(arc, follows, weight)
        yield pa.RecordBatch.from_arrays([pa.array(arc), pa.array(way)], names=["arc", "pos"])


def rank_list(arcs: DataFrame, last: int = LAST) -> DataFrame:
    """Positions from 0 of a linked list of arcs (arc, next, leaves, saved), ``next`` -1 at its end."""
    runs = cut(arcs.mapInArrow(_runs, "arc bigint, leaves bigint, saved bigint, head bigint, way bigint, first boolean, next bigint, weight bigint"))
    live = runs.where("first").select("arc", "next", "weight")
    rounds: list[DataFrame] = []
    while live.count() > last:
        # An arc with coin 0 takes over the next one if that has coin 1; both then meet at the next one's id.
        def coin(c: str, turn: int = len(rounds)) -> Column:
            return F.pmod(F.xxhash64(F.lit(turn), F.col(c)), F.lit(2))

        takes = (coin("arc") == 0) & (F.col("next") >= 0) & (coin("next") == 1)
        row = F.struct("arc", "next", "weight")
        met = live.groupBy(F.when(takes, F.col("next")).otherwise(F.col("arc")).alias("at")).agg(
            F.max(F.when(takes, row)).alias("taker"), F.max(F.when(~takes, row)).alias("own")
        )
        taker, own = F.col("taker"), F.col("own")
        rounds.append(cut(met.select(
            F.coalesce(taker["arc"], own["arc"]).alias("arc"), own["next"].alias("next"),
            (F.coalesce(taker["weight"], F.lit(0)) + own["weight"]).alias("weight"),
            F.when(taker.isNotNull(), own["arc"]).alias("taken"), taker["weight"].alias("way"),
        )))
        live = rounds[-1].select("arc", "next", "weight")
    known = cut(live.repartition(1).mapInArrow(_positions, "arc bigint, pos bigint"))
    for table in reversed(rounds):
        both = F.array(
            F.struct("arc", "pos"), F.struct(F.col("taken").alias("arc"), (F.col("pos") + F.col("way")).alias("pos"))
        )
        wider = cut(table.join(known, "arc").select(F.inline(both)).where(F.col("arc").isNotNull()))
        drop_tables(known, table)
        known = wider
    heads = known.withColumnRenamed("arc", "head")
    return runs.join(heads, "head").select("arc", (F.col("pos") + F.col("way")).alias("pos"), "leaves", "saved")


def trie(turns: DataFrame, lengths: DataFrame, block: int = BLOCK, last: int = LAST) -> DataFrame:
    """One row per node of the trie of conversations given as (conv_id, at, sha, chars) and (conv_id, turns)."""
    steps = prefixes(turns, block)
    root = lengths.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0")
    root = root.select(F.lit(_NO_TURN).alias("key"), F.lit(None).cast("string").alias("parent_key"), F.lit(0).cast("bigint").alias("depth"), "conv_id", "n_convs", F.lit(0).cast("bigint").alias("chars"))
    nodes = steps.groupBy("key", "parent_key", F.col("at").cast("bigint").alias("depth")).agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("chars").alias("chars")
    )
    nodes = cut(nodes.unionByName(root))
    named = nodes.join(nodes.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id")), "parent_key", "left")
    # Children of a node get numbers in a row, the smallest member first.
    named = cut(row_index(named, ["depth", "parent_conv_id", "conv_id"], "num"))
    children = named.where("depth > 0").groupBy("parent_key").agg(
        F.min("num").alias("child"), F.max("num").alias("last"), F.count(F.lit(1)).alias("n_children")
    )
    info = cut(named.join(children.withColumnRenamed("parent_key", "key"), "key", "left").select(
        "key", "parent_key", "conv_id", "depth", "parent_conv_id", "n_convs", "num", "child", "last",
        F.coalesce("n_children", F.lit(0)).cast("bigint").alias("n_children"),
        ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"),
    ))
    over = info.where("n_children > 0").select(F.col("key").alias("parent_key"), F.col("num").alias("up"), F.col("last").alias("youngest"))
    linked = info.join(over, "parent_key", "left")
    enter, leave = F.col("num") * 2, F.col("num") * 2 + 1
    behind = F.when(F.col("up").isNull(), -1).when(F.col("num") < F.col("youngest"), enter + 2).otherwise(F.col("up") * 2 + 1)
    leaf = (F.col("n_children") == 0).cast("bigint")
    arcs = linked.select("conv_id", "depth", F.inline(F.array(
        F.struct(enter.alias("arc"), F.coalesce(F.col("child") * 2, leave).alias("next"), leaf.alias("leaves"), F.col("saved").alias("saved")),
        F.struct(leave.alias("arc"), behind.cast("bigint").alias("next"), F.lit(0).cast("bigint").alias("leaves"), F.lit(0).cast("bigint").alias("saved")),
    )))
    ordered = arcs.orderBy("conv_id", "depth", "arc").select("arc", "next", "leaves", "saved")
    placed = rank_list(ordered, last).withColumns({"leaves0": F.col("leaves"), "saved0": F.col("saved")})
    summed = prefix_sums(cut(placed), [], "pos", ["leaves", "saved"], block)
    # From before entering to leaving.
    sign = F.when(F.col("arc") % 2 == 1, 1).otherwise(-1)
    inside = summed.groupBy(F.expr("arc div 2").alias("num")).agg(*[
        F.sum(sign * (F.col(v) - F.when(F.col("arc") % 2 == 1, 0).otherwise(F.col(f"{v}0")))).alias(name)
        for v, name in (("leaves", "n_leaves"), ("saved", "saved_tokens"))
    ])
    stops = steps.join(lengths, "conv_id").where("at = turns").select("key", "conv_id")
    stops = stops.unionByName(lengths.where("turns = 0").select(F.lit(_NO_TURN).alias("key"), "conv_id"))
    out = info.drop("saved").join(inside, "num").join(ends_digests(stops), "key", "left")
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def prefix_trie(turns: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations of (conv_id, turn, role, text)."""
    return trie(*rebuilt(turns))
