"""The ``opN`` queries and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from flipframe.llm import (
    bpe_automaton,
    butterfly_manifest,
    byte_shards,
    covering_simhash,
    grid_order_join,
    host_suffixes,
    interval_search,
    licence_automaton,
    pruned_graph,
    quality_gam,
    url_automaton,
    warc_derivatives,
    wu_manber,
)
from flipframe.llm.common import table


def op1_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score and verdict of every document; fitted on labelled rows outside the held-out fifth."""
    return quality_gam.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_html_host_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return host_suffixes.page_texts(table(spark, sf_dir, "pages"))


def op3_url_shift_and(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page's url."""
    return url_automaton.url_verdicts(table(spark, sf_dir, "pages"))


def op4_shard_prefix_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document under the law `bytes`."""
    return byte_shards.byte_shards(table(spark, sf_dir, "documents"))


def op5_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata and conversion records of every page's response, their bytes as a digest."""
    made = warc_derivatives.derivatives(warc_derivatives.page_responses(table(spark, sf_dir, "pages")))
    return warc_derivatives.record_bytes(made).select(
        "page_id", "warc_type", "record_id", "refers_to", "target_uri", "warc_date", "content_type", "source_headers",
        "source_digest", "block_digest", "content_length", F.sha2("record", 256).alias("record_sha256"),
    )


def op6_decontaminate_wu_manber(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark words, items and verdict of every document."""
    return wu_manber.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_licence_suffix_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases, labels and score of every document; the operator's spans are left out."""
    return licence_automaton.licence_scan(table(spark, sf_dir, "documents")).drop("spans")


def op8_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count and digests of ids and decoded text of every document."""
    return bpe_automaton.encode_texts(table(spark, sf_dir, "documents"), corpus_pipeline.tokenizer_path())


def op9_simhash_covering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return covering_simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_embedding_grid_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector."""
    return grid_order_join.near_vectors(table(spark, sf_dir, "embeddings"))


def op11_pruned_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest vectors found for every row whose vec_id is divisible by 50."""
    vectors = table(spark, sf_dir, "embeddings")
    return pruned_graph.nearest_vectors(vectors, vectors.where(F.col("vec_id") % 50 == 0))


def op12_interval_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 best documents of every benchmark item."""
    return interval_search.ranked_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_merkle_butterfly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots and proof digest of every document, and the check against sampled tampering."""
    return butterfly_manifest.checked_manifest(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality_gam, op2_html_host_suffixes, op3_url_shift_and, op4_shard_prefix_sums, op5_warc_derivatives,
        op6_decontaminate_wu_manber, op7_licence_suffix_automaton, op8_bpe_transducer, op9_simhash_covering,
        op10_embedding_grid_order, op11_pruned_graph, op12_interval_search,
        op13_merkle_butterfly,
    )
} | {"pipeline": corpus_pipeline.run}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_OP3 = f"""
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN regexp_extract(url, '^(?s:.)*?://([^?#]*)', 1) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/]*'), '{_UPPER}', '{_LOWER}') AS host,
             CASE WHEN contains(rest, '/') THEN substr(rest, position('/' IN rest)) ELSE '' END AS path FROM u),
r AS (SELECT *, CASE
  WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
  WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
  WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
  WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
  WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/' END AS rule,
  CASE {' '.join(f"WHEN contains(host || path, '{g.strip('*')}') THEN '{g}'" for g in url_automaton.BLOCK_GLOBS)} END AS block_glob FROM p)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL OR block_glob IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict, block_glob FROM r
"""

_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

_OP6 = f"""
WITH item AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item, least(10, len(w)) AS m, array_to_string(list_slice(w, i, i + least(10, len(w)) - 1), ' ') AS gram
        FROM (SELECT item, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM item WHERE len(w) > 0)),
doc AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
pos AS (SELECT rid, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM doc CROSS JOIN (SELECT DISTINCT m FROM win) WHERE len(w) >= m),
gram AS (SELECT rid, m, i, array_to_string(list_slice(w, i, i + m - 1), ' ') AS gram FROM pos),
met AS (SELECT rid, g.m, i, item FROM gram g JOIN win USING (m, gram)),
hit AS (SELECT rid, count(DISTINCT k) AS n_hit FROM (SELECT rid, unnest(range(i, i + m)) AS k FROM met) GROUP BY rid),
ids AS (SELECT rid, count(*) AS n, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT rid, item FROM met) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN hit USING (rid) LEFT JOIN ids USING (rid)
"""

_OP10 = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL),
link AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
         WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach AS (SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT r.x, l.y FROM reach r JOIN link l ON l.x = r.y),
comp AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x)
SELECT vec_id, (SELECT count(*) FROM link WHERE x = vec_id) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN comp ON x = vec_id
"""

_OP12 = f"""
WITH doc AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
item AS (SELECT row_number() OVER () AS q, item_id, list_distinct({_WORDS}) AS w FROM benchmark),
asked AS (SELECT q, item_id, unnest(w) AS term FROM item),
n AS (SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_terms FROM doc WHERE len(w) > 0),
tf AS (SELECT rid, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT rid, unnest(w) AS term FROM doc) WHERE term IN (SELECT term FROM asked) GROUP BY rid, term),
wt AS (SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * n_docs + 2) / (2.0::DOUBLE * count(*) + 1))) AS BIGINT) AS w FROM tf, n GROUP BY term, n_docs),
part AS (SELECT rid, term, (1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * len(w) * n_docs) // n_terms)) AS f FROM tf JOIN doc USING (rid), n),
score AS (SELECT q, item_id, rid, CAST(sum(w * f) AS BIGINT) AS score FROM asked JOIN part USING (term) JOIN wt USING (term) GROUP BY q, item_id, rid)
SELECT item_id, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS FIRST) AS INTEGER) AS rank, doc_id, score
FROM score JOIN doc USING (rid) WHERE score > 0 QUALIFY rank <= 10
"""

_TREE_LEVELS = (5, 4)  # levels that the SQL spells out below and above the subroots: 16**5 leaves, 16**4 sources


def _tree_sql(nodes: str, levels: int, tag: str) -> str:
    """CTEs that fold ``nodes`` (grp, idx, h) by 16: {tag}s0.. with left and right siblings per level, and {tag}n{levels}."""
    out = [f"{tag}n0 AS (SELECT grp, idx, h FROM {nodes})"]
    for k in range(levels):
        near = "PARTITION BY grp, idx // 16 ORDER BY idx ROWS BETWEEN"
        out.append(f"""{tag}s{k} AS (SELECT grp, idx, h, count(*) OVER (PARTITION BY grp) AS c,
  coalesce(string_agg(h, '') OVER ({near} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
  coalesce(string_agg(h, '') OVER ({near} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {tag}n{k})""")
        out.append(f"""{tag}n{k + 1} AS (SELECT grp, idx // 16 AS idx, CASE WHEN max(c) > 1 THEN sha256(string_agg(h, '' ORDER BY idx)) ELSE min(h) END AS h
  FROM {tag}s{k} GROUP BY grp, idx // 16)""")
    return ",\n".join(out)


def _climb_sql(start: str, levels: int, tag: str) -> str:
    """CTEs that carry ``start`` (grp, idx, acc, proof, ...) up the levels: {tag}c{levels}."""
    out = [f"{tag}c0 AS (SELECT * FROM {start})"]
    for k in range(levels):
        out.append(f"""{tag}c{k + 1} AS (SELECT c.* REPLACE (c.idx // 16 AS idx, CASE WHEN s.c > 1 THEN sha256(s.l || c.acc || s.r) ELSE c.acc END AS acc,
  CASE WHEN s.c > 1 THEN c.proof || s.l || s.r ELSE c.proof END AS proof) FROM {tag}c{k} c JOIN {tag}s{k} s ON s.grp = c.grp AND s.idx = c.idx)""")
    return ",\n".join(out)


_LEAF = " || ".join(
    f"CASE WHEN {f} IS NULL THEN '-' ELSE octet_length(encode({f}::VARCHAR))::VARCHAR || ':' || {f}::VARCHAR END"
    for f in ("doc_id", "source", "lang", "n_chars", "{text}")
)
_CRC32 = """xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
  lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))))"""

_OP13 = f"""
WITH d AS (SELECT doc_id, coalesce('=' || source, '') AS grp, sha256({_LEAF.format(text="text")}) AS leaf, sha256({_LEAF.format(text="low")}) AS claimed
  FROM (SELECT *, CASE WHEN {_CRC32} % 5 = 0 THEN translate(text, '{_UPPER}', '{_LOWER}') ELSE text END AS low FROM documents)),
p AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, leaf AS h FROM d),
{_tree_sql("p", _TREE_LEVELS[0], "a")},
{_climb_sql("(SELECT doc_id, grp, idx, leaf, claimed AS acc, '' AS proof FROM p)", _TREE_LEVELS[0], "a")},
top AS (SELECT '' AS grp, row_number() OVER (ORDER BY encode(grp)) - 1 AS idx, h, grp AS source FROM an{_TREE_LEVELS[0]}),
{_tree_sql("top", _TREE_LEVELS[1], "b")},
{_climb_sql(f"(SELECT a.doc_id, t.grp, t.idx, a.leaf, t.h AS subroot, a.acc, a.proof FROM ac{_TREE_LEVELS[0]} a JOIN top t ON t.source = a.grp)", _TREE_LEVELS[1], "b")}
SELECT doc_id, leaf, subroot, r.h AS root, sha256(proof) AS proof_sha256, acc AS folded_root, acc = r.h AS verified FROM bc{_TREE_LEVELS[1]} JOIN bn{_TREE_LEVELS[1]} r ON true
"""

ORACLES: dict[str, str] = {"op3_url_shift_and": _OP3, "op6_decontaminate_wu_manber": _OP6, "op10_embedding_grid_order": _OP10, "op12_interval_search": _OP12, "op13_merkle_butterfly": _OP13}
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
