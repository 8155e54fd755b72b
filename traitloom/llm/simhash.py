"""Near-duplicate documents: SimHash fingerprints joined through vantage-point trees.

Fingerprints that differ in at most three of 64 bits differ in at most one bit of one 32-bit
half, and at most seven in at most one bit of one 16-bit quarter. So each part has its own tree
and a search radius of one. A tree node holds a vantage
code and a Hamming radius: codes within it go to one side, the rest to the other, and a
query follows every side that the triangle inequality cannot rule out. The leaves are the
shards: each fingerprint is indexed in one and asked in all that its ball overlaps. Inside a
shard the tree goes on until a leaf is small or cannot be divided, and pairs are compared on
all 64 bits. A shard hands out a spanning forest of its links, which keeps the components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traitloom.llm.common import batch_pieces, cut, drop_tables, keep_matching, lean, shared, text_bytes, text_or_empty, widened

MAX_BITS = 3
SECOND_BITS = 16
SHARD = 2048
LEAF = 512
SAMPLE = 20_000
SEED = 42
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
# Row 256 * k + v: the bits of value v in byte k of a big-endian hash, counted into 64 columns.
_BITS = np.zeros((2048, 64))
for _k in range(8):
    _BITS[256 * _k : 256 * _k + 256, 8 * _k : 8 * _k + 8] = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_BYTE_BASE = (256 * np.arange(8))[None, :]


def fingerprints_of(raw: np.ndarray, at: np.ndarray, shingle: int, prints: int = 1) -> np.ndarray:
    """SimHashes per row of a byte buffer with row offsets ``at``: rows x ``prints``.

    The first one takes the shingles' hashes as they are, the others a mixture of them each.
    """
    n = len(at) - 1
    out = np.zeros((n, prints), np.uint64)
    if not len(raw):
        return out
    buf = _LOWER[raw]
    space = _SPACE[buf]
    first = np.zeros(len(buf), bool)
    first[at[:-1][at[:-1] < len(buf)]] = True
    before = np.concatenate([[True], space[:-1]]) | first
    start = ~space & before
    # One blank before every word but the first of a row; other white space goes.
    lead = np.flatnonzero(start)
    row = np.searchsorted(at, lead, side="right") - 1
    inner = np.concatenate([[False], row[1:] == row[:-1]])
    text = buf[~space]
    place = np.cumsum(~space) - 1  # of each byte without white space
    size = np.diff(np.append(place[lead], len(text)))
    begin = place[lead] + np.cumsum(inner)
    joined = np.full(len(text) + int(inner.sum()), 32, np.uint8)
    joined[np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(len(text))] = text
    end = begin + size
    data = joined.tobytes()
    words = np.bincount(row, minlength=n)
    base = np.cumsum(words) - words
    count = np.where(words >= shingle, words - shingle + 1, np.minimum(words, 1))
    head = np.repeat(base - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
    tail = np.minimum(head + shingle, np.repeat(base + words, count)) - 1
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (digest(data[a:b], SEED) for a, b in zip(begin[head].tolist(), end[tail].tolist())), np.uint64, count=len(head)
    )
    stop = np.cumsum(count)
    for k in range(prints):
        if k:
            hashes = (hashes ^ (hashes >> np.uint64(29))) * _MIX
            hashes ^= hashes >> np.uint64(32)
        cells = hashes.astype(">u8").view(np.uint8).reshape(-1, 8) + _BYTE_BASE
        for i in np.flatnonzero(count):
            seen = np.bincount(cells[stop[i] - count[i] : stop[i]].ravel(), minlength=2048)
            ones = seen @ _BITS * 2 > count[i]
            out[i, k] = np.packbits(ones).view(">u8")[0]
    return out


def with_fingerprint(docs: DataFrame, text_col: str = "text", name: str = "fp", shingle: int = 5, prints: int = 1) -> DataFrame:
    """All columns and ``name``: the SimHash of the whole text as a long; with ``prints`` above
    one an array of as many independent ones.

    A-Z are lower-cased, words are runs of other than ASCII white space, a feature is a run of
    ``shingle`` words joined by blanks (all words if there are fewer), repeats included. Text
    without words, or null, gives zero.
    """
    docs = docs.drop(name)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batch_pieces(batches, text_col):
            raw, at = text_bytes(batch.column(batch.schema.get_field_index(text_col)))
            found = fingerprints_of(raw, at, shingle, prints).view(np.int64)
            column = pa.array(found[:, 0]) if prints == 1 else pa.FixedSizeListArray.from_arrays(found.ravel(), prints).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, column], [*batch.schema.names, name])

    return docs.mapInArrow(run, widened(docs, **{name: "long" if prints == 1 else "array<long>"}))


def parts_for(bits: int) -> int:
    """Into how many parts 64 bits go so that one of them differs in one bit at most."""
    if not 0 <= bits <= 7:
        raise ValueError("bits has to be 0 to 7")
    return 2 if bits <= 3 else 4


def part_of(prints: np.ndarray, part: int, parts: int) -> np.ndarray:
    width = 64 // parts
    return ((prints >> np.uint64(width * part)) & np.uint64((1 << width) - 1)).astype(np.uint32)


def _divide(codes: np.ndarray) -> tuple[int, int] | None:
    """Vantage code and radius that split ``codes`` most evenly; None if nothing splits them.

    Vantage candidates are codes of the set at fixed places, so a rerun divides alike.
    """
    best, split = 0, None
    for v in codes[np.linspace(0, len(codes) - 1, 5).astype(int)]:
        away = np.bitwise_count(codes ^ v)
        upto = np.cumsum(np.bincount(away, minlength=33))
        radius = int(np.argmin(np.abs(2 * upto - len(codes))))
        even = min(int(upto[radius]), len(codes) - int(upto[radius]))
        if even > best:
            best, split = even, (int(v), radius)
    return split


class Shards:
    """A vantage-point tree fitted on sampled codes; leaves are numbered from 0."""

    def __init__(self, codes: np.ndarray, leaves: int, reach: int = 1):
        self.reach, self.leaves = reach, 0
        self.tree = self._grow(codes, leaves)

    def _grow(self, codes: np.ndarray, leaves: int):
        split = _divide(codes) if leaves > 1 and len(codes) > 1 else None
        if split is None:
            self.leaves += 1
            return self.leaves - 1
        near = np.bitwise_count(codes ^ np.uint32(split[0])) <= split[1]
        inside = max(1, min(leaves - 1, round(leaves * float(near.mean()))))
        return (*split, self._grow(codes[near], inside), self._grow(codes[~near], leaves - inside))

    def route(self, codes: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(leaf, rows whose ball reaches it, whether it is the row's own leaf)."""
        stack = [(self.tree, np.arange(len(codes)), np.ones(len(codes), bool))]
        while stack:
            node, rows, own = stack.pop()
            if not len(rows):
                continue
            if isinstance(node, int):
                yield node, rows, own
                continue
            vantage, radius, inside, outside = node
            away = np.bitwise_count(codes[rows] ^ np.uint32(vantage)).astype(np.int64)
            near, far = away <= radius + self.reach, away > radius - self.reach
            stack.append((inside, rows[near], (own & (away <= radius))[near]))
            stack.append((outside, rows[far], (own & (away > radius))[far]))


class Forest:
    """Union of numbered members, with the smallest number as root."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def roots(self, members: np.ndarray) -> np.ndarray:
        at = self.root[members]
        while True:
            up = self.root[at]
            if (up == at).all():
                self.root[members] = at
                return at
            at = up

    def join(self, members: np.ndarray) -> None:
        top = np.unique(self.roots(members))
        self.root[top] = top[0]


def link_shard(
    prints: np.ndarray, own: np.ndarray, part: int, bits: int = MAX_BITS, leaf: int = LEAF,
    seconds: np.ndarray | None = None, second_bits: int = SECOND_BITS,
) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest (row, root) of the links between own fingerprints and all others here.

    With ``seconds``, another fingerprint per row, a link also needs those within ``second_bits``.
    """
    parts = parts_for(bits)
    codes, forest, reach = part_of(prints, part, parts), Forest(len(prints)), bits // parts
    stack = [(np.flatnonzero(own), np.arange(len(prints)))]
    while stack:
        mine, asked = stack.pop()
        if not len(mine) or len(asked) < 2:
            continue
        split = _divide(codes[mine]) if len(mine) > leaf else None
        if split is not None:
            vantage, radius = np.uint32(split[0]), split[1]
            d_mine = np.bitwise_count(codes[mine] ^ vantage).astype(np.int64)
            d_ask = np.bitwise_count(codes[asked] ^ vantage).astype(np.int64)
            stack.append((mine[d_mine <= radius], asked[d_ask <= radius + reach]))
            stack.append((mine[d_mine > radius], asked[d_ask > radius - reach]))
            continue
        values = prints[mine]
        step = max(1, (1 << 22) // len(mine))
        for k in range(0, len(asked), step):
            some = asked[k : k + step]
            hit = np.bitwise_count(prints[some][:, None] ^ values[None, :]) <= bits
            if seconds is not None:
                i, j = np.nonzero(hit)
                hit[i, j] = np.bitwise_count(seconds[some[i]] ^ seconds[mine[j]]) <= second_bits
            full = hit.sum(axis=1) > 1  # one hit may be the row itself
            lone = np.flatnonzero(~full & hit.any(axis=1))
            full[lone] = some[lone] != mine[hit[lone].argmax(axis=1)]
            for i in np.flatnonzero(full):
                forest.join(np.append(mine[hit[i]], some[i]))
    root = forest.roots(np.arange(len(prints)))
    linked = np.flatnonzero(root != np.arange(len(prints)))
    return linked, root[linked]


def links(prints: DataFrame, shard: int = SHARD, sample: int = SAMPLE, bits: int = MAX_BITS, second_bits: int = SECOND_BITS) -> DataFrame:
    """Links (a, b) that keep the components of the graph of all pairs at most ``bits`` (7 or fewer) apart.

    ``prints`` has one row per fingerprint ``fp``, which also names it; or rows (node, fp, second)
    where nodes link if ``fp`` is within ``bits`` and ``second`` within ``second_bits``. A hash
    sample of at most ``sample`` rows places the tops of the trees; it changes the balance of the
    shards, not the links.
    """
    parts = parts_for(bits)
    paired = "second" in prints.columns
    rows = prints.select("fp", *(["node", "second"] if paired else []))
    total = rows.count()
    seen = rows.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(sample).collect()
    picked = np.array([r["fp"] for r in seen], np.int64).view(np.uint64)
    # At most sample / 8 leaves, so the trees sent to the tasks have a fixed bound; a shard
    # that holds more than ``shard`` rows divides itself further.
    leaves = max(1, min(total // shard, sample // 8))
    tops = [Shards(part_of(picked, part, parts), leaves, bits // parts) for part in range(parts)]
    trees = shared(prints.sparkSession, tops)
    names = ["shard", "own", *rows.columns]

    @lean
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.column(0).to_numpy().view(np.uint64)
            for part, tree in enumerate(trees.value):
                for leaf, at, own in tree.route(part_of(held, part, parts)):
                    place = pa.array(np.full(len(at), parts * leaf + part, np.int32))
                    yield pa.RecordBatch.from_arrays([place, pa.array(own), *batch.take(pa.array(at)).columns], names)

    def search(table: pa.Table) -> pa.Table:
        held, own = table["fp"].to_numpy().view(np.uint64), table["own"].to_numpy()
        second = table["second"].to_numpy().view(np.uint64) if paired else None
        row, root = link_shard(held, own, table["shard"][0].as_py() % parts, bits, LEAF, second, second_bits)
        name = table["node" if paired else "fp"].to_numpy()
        return pa.table({"a": name[row], "b": name[root]})

    more = ", node long, second long" if paired else ""
    dealt = rows.mapInArrow(deal, "shard int, own boolean, fp long" + more)
    return dealt.groupBy("shard").applyInArrow(search, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """Smallest member (``root``) of the component of every node of the links (a, b).

    Alternating stars: nodes hang themselves on the least neighbour seen, first from above,
    then from below, until nothing changes. Minima combine before the shuffle, links are
    written after each round and old rounds are deleted.
    """
    hi, lo = F.greatest("a", "b"), F.least("a", "b")
    now = cut(edges.where("a <> b").select(hi.alias("u"), lo.alias("v")).distinct())
    old_sum = None
    while True:
        both = now.select(F.col("u").alias("x"), F.col("v").alias("y")).union(now.select(F.col("v").alias("x"), F.col("u").alias("y")))
        least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = both.where("y > x").join(least, "x").where("y <> m").select(F.col("y").alias("u"), F.col("m").alias("v")).distinct()
        mid = cut(large)
        least = mid.groupBy("u").agg(F.min("v").alias("m"))
        small = mid.join(least, "u")
        step = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        new = cut(step.distinct())
        # Links are (node, smaller node); nothing changed if both sides of the table are alike.
        digest = new.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if old_sum == tuple(digest):
            drop_tables(now, mid)
            return new.select(F.col("u").alias("node"), F.col("v").alias("root"))
        old_sum = tuple(digest)
        drop_tables(now, mid)
        now = new


def classes(prints: DataFrame, bits: int = MAX_BITS) -> DataFrame:
    """fp, root, component_id for a table (fp, doc_id): a fingerprint that names the component, and its smallest doc_id."""
    distinct = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(distinct.select("fp"), bits=bits))
    named = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = cut(named)
    best = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return named.join(best, "root").select("fp", "root", "component_id")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, bits: int = MAX_BITS) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id.

    Fingerprints at most ``bits`` apart link, the component is the smallest id reachable.
    Texts without words share fingerprint zero and link like any other. Null ids belong to
    their component; its id is null if it has no other. Repeated rows come as often as given.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    prints = cut(with_fingerprint(rows, "text", "fp", shingle).select("doc_id", "fp"))
    out = prints.join(classes(prints, bits), "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, bits: int = 7, prints: int = 4
) -> DataFrame:
    """The documents with one of each component left, the one with the smallest id; all columns.

    Documents link if one of their ``prints`` (two or more) independent fingerprints differs in at most ``bits``
    and the next one in at most ``SECOND_BITS``, which chance alone does as rarely as three bits in
    one. A text takes part as its combination of fingerprints, so equal ones search once.
    """
    marked = with_fingerprint(docs, text_col, "__fps", shingle, prints)
    marked = marked.withColumn("__node", F.xxhash64("__fps"))
    ident = {"__id": F.coalesce(F.col(id_col).cast("long"), F.lit(0)), "__null": F.col(id_col).isNull()}
    seen = cut(marked.select("__node", F.col("__fps").alias("fps"), F.col(id_col).cast("long").alias("doc_id")))
    nodes = cut(seen.groupBy(F.col("__node").alias("node")).agg(F.first("fps").alias("fps"), F.min("doc_id").alias("least")))
    edges = None
    for k in range(prints):
        one = nodes.select("node", F.get("fps", F.lit(k)).alias("fp"), F.get("fps", F.lit((k + 1) % prints)).alias("second"))
        found = cut(links(one, bits=bits))
        edges = found if edges is None else edges.union(found)
    roots = components(edges)
    placed = nodes.join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    # The smallest id of each component, and of the texts that share it the smallest node.
    best = placed.groupBy("root").agg(F.min(F.struct(F.col("least").isNull(), "least", "node")).alias("b"))
    kept = best.select(
        F.col("b.node").alias("__node"), F.coalesce("b.least", F.lit(0)).alias("__id"), F.col("b.least").isNull().alias("__null")
    )
    return keep_matching(marked.withColumns(ident), kept, ["__node", "__id", "__null"]).drop("__node", "__id", "__null", "__fps")
