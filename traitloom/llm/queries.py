"""Registered queries of the operators and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


from traitloom.llm import conversation_trie, exact_dedup, language, licenses, neighbours, packing, pieces, pii, quality, secrets, sharding
from traitloom.llm import simhash, whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@_query(
    "op1_exact_dedup",
    f"""
WITH d AS (SELECT doc_id, sha256({_LOWERED}) AS text_sha256, {_LOWERED} AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM d JOIN g USING (t)""",
)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_table(spark, sf_dir, "documents"), keep="largest")


@_query("op2_quality")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.learn_and_score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@_query("op3_sentencepiece")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    model = pieces.Pieces.read(public_tokenizers.path("piece_bpe_32k.model"))
    return pieces.encoded_digests(_table(spark, sf_dir, "documents"), model)


@_query("op4_simhash")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(_table(spark, sf_dir, "documents"), shingle=3)


@_query("op5_language")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.learn_and_identify(_table(spark, sf_dir, "documents"))


@_query("op6_licenses")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.learn_and_scan(_table(spark, sf_dir, "documents"))


def tokenizer_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


@_query("op7_packing")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), *tokenizer_paths(), with_ids=False)


@_query("op8_secrets")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.spans_of(_table(spark, sf_dir, "documents"))


@_query("op9_neighbours")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return neighbours.nearest(vectors, vectors.where("vec_id % 50 = 0"))


@_query("op10_pii")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.spans_of(_table(spark, sf_dir, "documents"))


# CRC-32 of a short text, bit by bit; the conversations rebuilt; a node by its turns, its subtree by the nodes below.
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(range(1, len(t) + 1),
    lambda i: [ord(t[i])::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
    lambda c, x: CASE WHEN xor(c, x) & 1 = 1 THEN xor(xor(c, x) >> 1, 3988292384) ELSE xor(c, x) >> 1 END), 4294967295)"""


@_query(
    "op11_conversation_trie",
    f"""
WITH r AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos,
    coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
w AS (SELECT conv_id, list(struct_pack(role := role, text := text) ORDER BY pos) AS own, CAST(conv_id AS VARCHAR) AS t FROM r GROUP BY conv_id),
h AS (SELECT conv_id, own, CAST({_CRC} % 6 AS BIGINT) AS h FROM w),
c AS (SELECT h.conv_id, list_concat(coalesce(b.own[1:h.h], []), h.own[h.h + 1:]) AS turns
    FROM h LEFT JOIN h b ON b.conv_id = h.conv_id - h.conv_id % 100),
p AS (SELECT conv_id, unnest(range(len(turns) + 1)) AS depth, turns FROM c),
s AS (SELECT conv_id, depth, turns[1:depth] AS path, len(turns) = depth AS stops FROM p),
n AS (SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (stops), '')) AS ends_sha256 FROM s GROUP BY path, depth),
k AS (SELECT path[1:depth - 1] AS path, depth - 1 AS depth, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL),
m AS (SELECT n.*, coalesce(n_children, 0) AS n_children, u.conv_id AS parent_conv_id,
    CASE WHEN n.depth > 0 THEN (n.n_convs - 1) * length(n.path[n.depth].text) ELSE 0 END AS saved
    FROM n LEFT JOIN k ON k.path = n.path AND k.depth = n.depth LEFT JOIN n u ON n.depth > 0 AND u.path = n.path[1:n.depth - 1] AND u.depth = n.depth - 1),
a AS (SELECT path[1:d] AS path, d AS depth, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(saved) AS saved_tokens
    FROM (SELECT path, n_children, saved, unnest(range(depth + 1)) AS d FROM m) GROUP BY ALL)
SELECT conv_id, m.depth, parent_conv_id, n_convs, n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
    CAST(saved_tokens AS BIGINT) AS saved_tokens, ends_sha256
FROM m JOIN a ON a.path = m.path AND a.depth = m.depth""",
)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.prefix_trie(_table(spark, sf_dir, "conversations"))


@_query("op12_sharding")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_table(_table(spark, sf_dir, "documents"))


@_query("op13_whitening")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))
