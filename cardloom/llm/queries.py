"""One query for each operator over its whole table, and SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardloom.llm import (
    bpe_sql,
    dart_minhash,
    languages,
    mixing,
    near_vectors,
    packing,
    posting_lists,
    quality,
    token_counts,
    token_files,
    turn_trie,
    url_rules,
    whitening,
)
from cardloom.llm.common import ready, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return fn(ready(spark), folder)

    run.__name__, run.__doc__ = fn.__name__, fn.__doc__
    QUERIES[fn.__name__] = run
    return run


@query
def op7_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of all documents through files of bit planes and back."""
    return token_files.token_file_digest(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)


@query
def op10_packing(spark: SparkSession, folder: str) -> DataFrame:
    """All documents packed into sequences of at most 1024 tokens."""
    packed = packing.pack(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    return packing.piece_digest(packed)


@query
def op5_bpe_codec(spark: SparkSession, folder: str) -> DataFrame:
    """Byte-level BPE ids of all documents, and what they decode to, as checksums."""
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe_sql.encode_digest(table(spark, folder, "documents"), ranks, public_tokenizers.PATTERN)


@query
def op8_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of all documents by the compiled transducer."""
    return token_counts.token_counts(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op2_nearest_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 nearest vectors by inner product of every 20th vector."""
    return posting_lists.nearest(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


@query
def op6_near_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Links of cosine 0.95 or more between all vectors, and their components."""
    return near_vectors.near_duplicates(table(spark, folder, "embeddings"), threshold=0.95)


ORACLES["op6_near_vectors"] = """
WITH RECURSIVE v AS (
    SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len(embedding) > 0
      AND NOT list_bool_or(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x)))
      AND list_bool_or(list_transform(embedding, lambda x: x <> 0))
),
links AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id
    WHERE len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95
),
reach(a, b) AS (
    SELECT a, b FROM links
    UNION
    SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
),
counts AS (SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY a),
least_of AS (SELECT a AS vec_id, min(b) AS near FROM reach GROUP BY a)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links,
       least(vec_id, coalesce(near, vec_id)) AS component_id,
       vec_id = least(vec_id, coalesce(near, vec_id)) AS kept
FROM embeddings LEFT JOIN counts USING (vec_id) LEFT JOIN least_of USING (vec_id)
"""


@query
def op1_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Quality of all documents, learned from the labels."""
    return quality.score_quality(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query
def op9_languages(spark: SparkSession, folder: str) -> DataFrame:
    """Language of all documents."""
    return languages.predict_languages(table(spark, folder, "documents"))


@query
def op4_near_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Classes of near-duplicate documents: five-word shingles, similarity of 0.8 or more."""
    return dart_minhash.classes(table(spark, folder, "documents")).select("doc_id", "class_id", "kept")


@query
def op3_text_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Log probabilities of all documents by mixed bit predictors, beside the counted base."""
    return mixing.score_texts(table(spark, folder, "documents"))


@query
def op11_turn_trie(spark: SparkSession, folder: str) -> DataFrame:
    """The prefix trie of all conversations, rebuilt on shared heads."""
    return turn_trie.conversation_trie(table(spark, folder, "conversations"))


@query
def op12_whitened(spark: SparkSession, folder: str) -> DataFrame:
    """All vectors whitened by the 16 leading eigenvectors of their covariance."""
    return whitening.whiten(table(spark, folder, "embeddings"))


URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


@query
def op13_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    """Verdict on every page's URL."""
    return url_rules.judge_urls(table(spark, folder, "pages"), URL_RULES)


ORACLES["op13_url_filters"] = """
WITH rules(host, path, verdict) AS (
    VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
),
places AS (
    SELECT page_id, url,
        coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
        coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
    FROM pages
)
SELECT page_id, host, path, won.rule AS rule, coalesce(won.verdict, 'allow') AS verdict FROM (
    SELECT page_id, host, path, (
        SELECT arg_max({'rule': r.host || r.path, 'verdict': r.verdict}, length(r.host || r.path)) FROM rules r
        WHERE (places.host = r.host OR ends_with(places.host, '.' || r.host)) AND starts_with(places.path, r.path)
    ) AS won FROM places
)
"""

# The unsigned crc32 of the decimal conversation id, bit by bit.
ORACLES["op11_turn_trie"] = """
WITH own AS (
    SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
        {'role': coalesce(role, ''), 'text': coalesce(text, '')} AS turn
    FROM conversations WHERE conv_id IS NOT NULL
),
listed AS (
    SELECT c, list(turn ORDER BY i) AS turns,
        xor(4294967295, list_reduce(list_transform(string_split(c::VARCHAR, ''), lambda x: ord(x)::BIGINT),
            lambda crc, byte: list_reduce(range(8), lambda x, k: xor(x >> 1, (x & 1) * 3988292384), xor(crc, byte)),
            4294967295::BIGINT)) % 6 AS h
    FROM own GROUP BY c
),
rebuilt AS (
    SELECT a.c, list_concat(coalesce(b.turns[1:a.h], []), a.turns[a.h + 1:]) AS turns
    FROM listed a LEFT JOIN listed b ON b.c = a.c - a.c % 100
),
passed AS (
    SELECT c, d, turns[1:d] AS path, len(turns) = d AS ends FROM (SELECT c, turns, unnest(range(0, len(turns) + 1)) AS d FROM rebuilt)
),
nodes AS (
    SELECT d, path, min(c) AS conv_id, count(*) AS n_convs, string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ends) AS ends,
        (count(*) - 1) * coalesce(length(path[d].text), 0) AS saved
    FROM passed GROUP BY d, path
),
children AS (SELECT path[1:d - 1] AS path, count(*) AS n FROM nodes WHERE d > 0 GROUP BY ALL),
below AS (
    SELECT path[1:top] AS path, count(*) FILTER (NOT inner_node) AS leaves, sum(saved) AS saved FROM (
        SELECT nodes.path, nodes.saved, children.path IS NOT NULL AS inner_node, unnest(range(0, d + 1)) AS top
        FROM nodes LEFT JOIN children ON children.path = nodes.path
    ) GROUP BY ALL
)
SELECT nodes.conv_id, nodes.d AS depth, parent.conv_id AS parent_conv_id, nodes.n_convs, coalesce(children.n, 0) AS n_children,
    below.leaves AS n_leaves, below.saved::BIGINT AS saved_tokens, sha256(coalesce(nodes.ends, '')) AS ends_sha256
FROM nodes JOIN below ON below.path = nodes.path LEFT JOIN children ON children.path = nodes.path
LEFT JOIN nodes parent ON parent.d = nodes.d - 1 AND parent.path = nodes.path[1:nodes.d - 1]
"""
