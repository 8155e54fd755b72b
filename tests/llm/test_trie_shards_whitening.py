"""Conversation trie, sharding and whitening against plain versions, and their edge cases."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest

from traitloom.llm import conversation_trie, sharding, whitening

TURNS = "conv_id bigint, turn bigint, role string, text string"


def plain_trie(rows):
    """The nodes of the rebuilt conversations of (conv_id, turn, role, text)."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts, key=lambda t: t[:2])] for c, ts in own.items()}
    members = defaultdict(list)
    full = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        full[c] = own.get(c - c % 100, [])[:h] + turns[h:]
        for d in range(len(full[c]) + 1):
            members[tuple(full[c][:d])].append(c)
    out = []
    for path, cs in members.items():
        under = [p for p in members if p[: len(path)] == path]
        parents = {p[:-1] for p in under if p}
        ends = sorted(c for c in cs if len(full[c]) == len(path))
        out.append((
            min(cs), len(path), min(members[path[:-1]]) if path else None, len(cs),
            sum(p[:-1] == path and len(p) == len(path) + 1 for p in members), sum(p not in parents for p in under),
            sum((len(members[p]) - 1) * len(p[-1][1]) for p in under if p), hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def nodes(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize(("block", "last", "batch"), [(4096, 4096, 10_000), (2, 3, 7)])
def test_trie(spark, sf_dir, block, last, batch):
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    rows = [tuple(r) for r in turns.select("conv_id", "turn", "role", "text").collect()]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        assert nodes(conversation_trie.trie(*conversation_trie.rebuilt(turns), block, last)) == plain_trie(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_trie_of_odd_rows(spark):
    rows = [(100 * k + j, t, r, x) for k in range(4) for j in (0, 1, 7, 50) for t, r, x in ((1, "u", "hi"), (2, None, None), (None, "a", "🙂é"), (3, "u", ""))]
    rows += [(7, 9, "u", "again")] * 3  # repeated rows
    rows += [(901, 1, "u", "x"), (903, 1, "u", "x")]  # no conversation 900: all that stands in front is lost
    rows += [(None, 1, "u", "nobody's")]
    rows += [(1200, i, "u", f"turn {i % 3}") for i in range(300)] + [(1201 + j, i, "u", f"turn {i % 3}") for j in range(3) for i in range(300)]
    df = spark.createDataFrame(rows, TURNS).selectExpr("*", "'x' AS depth", "1 AS key", "2 AS n_convs").repartition(5)
    for block, last in ((4096, 4096), (16, 4)):
        assert nodes(conversation_trie.trie(*conversation_trie.rebuilt(df), block, last)) == plain_trie(rows)


def test_trie_of_nothing(spark):
    assert conversation_trie.prefix_trie(spark.createDataFrame([], TURNS)).collect() == []
    c = next(c for c in range(1, 100) if zlib.crc32(str(c).encode()) % 6)
    only = conversation_trie.prefix_trie(spark.createDataFrame([(c, 1, "u", "gone")], TURNS)).collect()
    assert [tuple(r)[:7] for r in only] == [(c, 0, None, 1, 0, 1, 0)]
    assert only[0]["ends_sha256"] == hashlib.sha256(str(c).encode()).hexdigest()


def test_large_group_ends_in_order(spark):
    rows = spark.range(30_000).selectExpr("'k' AS key", "(id * 7919) % 30000 AS conv_id").repartition(9)
    got = conversation_trie.ends_digests(rows).collect()
    assert [tuple(r) for r in got] == [("k", hashlib.sha256(",".join(map(str, range(30_000))).encode()).hexdigest())]


DOCS = "doc_id bigint, text string, shard string, size string, note int"


@pytest.mark.parametrize("n", [1, 2, 3, 10, 37, 400, 1601])
def test_permutation_and_its_inverse(spark, n):
    shuffle = sharding.shuffle_of(spark, n, 8, 3)
    rows = shuffle.numbers(shuffle.place(spark.range(n).toDF("i"), "i"), "j").collect()
    assert all(r["i"] == r["j"] for r in rows)
    assert sorted(r["slot"] * 8 + r["shard"] for r in rows) == list(range(n))
    if n > 100:
        moved = sorted(rows, key=lambda r: r["slot"] * 8 + r["shard"])
        assert abs(np.corrcoef([r["i"] for r in moved], range(n))[0, 1]) < 0.2


def test_walks_of_any_length(spark):
    """A rectangle with many cells outside: walks take several steps."""
    class Wide(sharding.Shuffle):
        @property
        def sides(self):
            return 16, 16

    shuffle = Wide(20, 8, 1, 236)
    rows = shuffle.numbers(shuffle.place(spark.range(20).toDF("i"), "i"), "j").collect()
    assert all(r["i"] == r["j"] for r in rows)
    assert sorted(r["slot"] * 8 + r["shard"] for r in rows) == list(range(20))


def test_shards(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}
    rows = sharding.shard_table(docs).collect()
    again = sharding.shard_table(docs.repartition(7, "lang")).collect()
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, again), key=str)
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in rows} == {i: (len(t) + 1, zlib.crc32(t)) for i, t in texts.items()}
    assert all(r["law"] == "rows" and r["grown_shard"] is None for r in rows)
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert set(slots) == set(range(8)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def test_shards_of_odd_rows(spark, tmp_path):
    rows = [(None, None, "a", "b", 1)] * 40 + [(5, "same", "a", "b", 2)] * 40 + [(5, "é🙂" * 9, "a", "b", 3), (-1, "", None, None, None), (6, "x" * 200_000, "a", "b", 4)]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    out = sharding.sharded(docs, shards=4)
    got = out.collect()
    assert len(got) == len(rows) and len({(r["shard"], r["slot"]) for r in got}) == len(rows)
    assert sorted((r["doc_id"], r["text"], r["note"]) for r in got if r["doc_id"]) == sorted((r[0], r[1], r[4]) for r in rows if r[0])
    assert {r["size"] for r in got if r["text"] is None} == {1}
    sharding.write_shards(docs, str(tmp_path / "shards"), shards=4)
    back = spark.read.parquet(str(tmp_path / "shards")).collect()
    assert sorted((r["shard"], r["slot"]) for r in back) == sorted((r["shard"], r["slot"]) for r in got)
    assert sharding.shard_table(spark.createDataFrame([], DOCS)).collect() == []


def plain_whitening(vectors):
    good = [(i, np.floor(256 * np.array(v, float)).astype(np.int64)) for i, v in vectors if v is not None and None not in v and np.isfinite(np.array(v, float)).all()]
    x = np.array([v for _, v in good])
    fit = np.unique(x, axis=0)
    n, total = len(fit), fit.sum(0)
    centred = fit - total / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1][:4], axes[:, ::-1][:, :4]
    return [i for i, _ in good], n, ((n * x - total) ** 2).sum(1), (x - total / n) @ axes / np.sqrt(values), values / np.trace(centred.T @ centred / n)


def test_whitening(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    rows = [(r[0], list(r[1])) for r in table.collect()]
    odd = [(900_001, None), (900_002, [None] + rows[0][1][1:]), (900_003, [float("nan")] + rows[0][1][1:]), (900_004, [float("inf")] + rows[0][1][1:])]
    odd += [(900_005, rows[0][1])] * 3 + [(None, rows[1][1])]
    more = spark.createDataFrame(odd, table.schema).unionByName(table).selectExpr("*", "1 AS component", "'x' AS n")
    ids, n, deviation, whitened, explained = plain_whitening(rows + odd)
    got = whitening.whiten(more).collect()
    assert len(got) == 4 * len(ids)
    assert {r["n"] for r in got} == {n} and max(r["identity_error"] for r in got) < 1e-9
    want = sorted(((-1 if i is None else i), c + 1, int(d), round(abs(w[c]), 7), round(explained[c], 9)) for i, d, w in zip(ids, deviation, whitened) for c in range(4))
    have = sorted(((-1 if r["vec_id"] is None else r["vec_id"]), r["component"], r["deviation"], round(abs(r["whitened"]), 7), round(r["explained"], 9)) for r in got)
    assert [w[:3] for w in want] == [h[:3] for h in have]
    assert np.allclose([w[3:] for w in want], [h[3:] for h in have], atol=2e-7)
    signs = defaultdict(set)
    place = {i: k for k, i in enumerate(ids)}
    for r in got:
        if abs(r["whitened"]) > 1e-3 and r["vec_id"] is not None:
            signs[r["component"]].add(np.sign(r["whitened"]) == np.sign(whitened[place[r["vec_id"]], r["component"] - 1]))
    assert all(len(s) == 1 for s in signs.values())


def test_whitening_of_few_rows(spark):
    kind = "vec_id bigint, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], kind)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, None)], kind)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0])] * 5, kind)).collect() == []  # no variance
    line = whitening.whiten(spark.createDataFrame([(i, [float(i), 2.0 * i]) for i in range(6)] + [(9, [3.0])], kind)).collect()
    assert {r["component"] for r in line} == {1, 2} and {r["vec_id"] for r in line} == {*range(6), 9}
    one = whitening.whiten(spark.createDataFrame([(i, [float(i), 2.0 * i]) for i in range(6)], kind)).collect()
    assert {r["component"] for r in one} == {1} and max(r["identity_error"] for r in one) < 1e-12


def test_large_deviations_are_exact(spark):
    kind = "vec_id bigint, embedding array<double>"
    rows = [(i, [float(i * 10_000_019 % 1_000_003), 1.0]) for i in range(9)] + [(10, [1e14, 0.0])]
    got = {r["vec_id"]: r["deviation"] for r in whitening.whiten(spark.createDataFrame(rows, kind)).collect()}
    x = {i: [int(np.floor(256 * c)) for c in v] for i, v in rows}
    total = [sum(c) for c in zip(*x.values())]
    want = {i: sum((len(rows) * c - s) ** 2 for c, s in zip(v, total)) for i, v in x.items()}
    assert got == {i: v if v < 2**63 else None for i, v in want.items()}


@pytest.mark.parametrize("values", [[5, 5, 5, 1, 1], [1, 0, 0, 0], [3, 3 - 1e-9, 3 - 2e-9, 2, 1], [1], [0, 0]])
def test_slicing_numbers_close_and_equal_values(values):
    d = len(values)
    q = np.linalg.qr(np.random.default_rng(d).standard_normal((d, d)))[0]
    matrix = (q * values) @ q.T
    got, axes = whitening.leading((matrix + matrix.T) / 2, 4)
    kept = [v for v in sorted(values, reverse=True)[:4] if v > 1e-12]
    assert np.allclose(got, kept, atol=1e-13, rtol=1e-13)
    assert np.allclose(axes @ axes.T, np.eye(len(kept)), atol=1e-13) and np.allclose(matrix @ axes.T, axes.T * got, atol=1e-12)


def test_counts_match_eigenvalues():
    rng = np.random.default_rng(4)
    for d in (1, 2, 3, 8, 40):
        a = rng.standard_normal((d, d))
        a = a + a.T
        for shift in rng.uniform(-3, 3, 8):
            assert whitening.above(a, shift) == (np.linalg.eigvalsh(a) > shift).sum()
    assert whitening.above(np.array([[0.0, 1.0], [1.0, 0.0]]), 0.0) == 1
