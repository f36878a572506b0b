"""Named queries of this subpackage on the driver's tables, and the same questions in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelfx.llm.byte_bpe import read_ranks, token_digests
from panelfx.llm.fill_middle import fill_in_middle, restored
from panelfx.llm.html_text import extract_text
from panelfx.llm.iblt import version_fingerprints
from panelfx.llm.jaccard_join import JaccardOptions, jaccard_groups
from panelfx.llm.lattice_lm import lattice_scores
from panelfx.llm.mixing import MixOptions, planned_copies
from panelfx.llm.near_vectors import near_groups
from panelfx.llm.prefix_trie import borrowed_turns, conversations_of, prefix_trie
from panelfx.llm.secrets import secret_spans, spelled
from panelfx.llm.token_files import TokenFileOptions, token_file_rows
from panelfx.llm.toxicity import toxicity_scores
from panelfx.llm.url_filter import filter_urls
from panelfx.session import small_batches

Query = Callable[[SparkSession, str], DataFrame]

URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url against the fixed rules."""
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages, rules).select("page_id", "host", "path", "rule", "verdict")


def near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and groups of all vectors at a cosine of 0.95."""
    return near_groups(table(spark, sf_dir, "embeddings"))


def fold(n: int) -> Column:
    """Fold of a document: crc32 of its id as text, modulo n."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(n))


def toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learnt from the labels of three folds of four."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(fold(4) != 2)
    scored = toxicity_scores(docs, labels)
    return scored.select(
        "doc_id", (fold(4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and its edited text, and their likeness."""
    return version_fingerprints(table(spark, sf_dir, "documents"))


def mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each document occurs in a mixture of as many tokens, its entropy half way to that of equal weights."""
    plan = planned_copies(table(spark, sf_dir, "documents"), MixOptions())
    return plan.select("doc_id", "source", "n_tokens", "source_tokens", "weight", "budget", "copies")


def secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: the base patterns' and those the Markov models add."""
    found = secret_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))

    def count(kind: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint")

    return found.select(
        "doc_id",
        count(1).alias("n_assign"),
        count(2).alias("n_access"),
        count(3).alias("n_hex"),
        F.sha2(spelled(F.col("base")), 256).alias("base_sha256"),
        spelled(F.col("spans")).alias("spans"),
    )


def jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents whose three-word shingles agree in nine tenths."""
    return jaccard_groups(table(spark, sf_dir, "documents"), JaccardOptions(90, 100, 3))


def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probability of every document, learnt from four folds of five."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    pieces = read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    scored = lattice_scores(docs.where(fold(5) != 1), docs, pieces)
    return scored.select(
        "doc_id", (fold(5) == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


def byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document and the text they decode to, as digests."""
    tokens = read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return token_digests(table(spark, sf_dir, "documents"), tokens, public_tokenizers.PATTERN)


def conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prefix trie of all conversations, each beginning with turns of the first of its hundred."""
    return prefix_trie(conversations_of(table(spark, sf_dir, "conversations"), borrowed_turns, 5, 100))


def token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place, number and checksum of every document's ids, read back from files of ids."""
    with open(public_tokenizers.path("word_bpe_49k.json")) as spec:
        rows = token_file_rows(table(spark, sf_dir, "documents"), spec.read(), TokenFileOptions(end_id=2))
    return rows.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in its order for infilling, and the text rebuilt from it, as digests."""
    rows = fill_in_middle(table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored("output", "form"), 256).alias("restored_sha256"),
    )


def llm_queries() -> dict[str, Query]:
    return {
        "op1_url_filter": url_filter,
        "op2_near_vectors": near_vectors,
        "op3_mixing": mixing,
        "op4_toxicity": toxicity,
        "op5_fingerprints": fingerprints,
        "op6_jaccard_join": jaccard,
        "op7_html_text": html_text,
        "op8_lattice_lm": lattice_lm,
        "op9_byte_bpe": byte_bpe,
        "op10_secrets": secrets,
        "op11_prefix_trie": conversation_trie,
        "op12_token_files": token_files,
        "op13_fill_middle": fill_middle,
    }


URL_SQL = """
WITH rest AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages
), parts AS (
  SELECT page_id,
         translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path
  FROM rest
), rules(h, p, v) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
         ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), hits AS (
  SELECT host, path, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS verdict
  FROM (SELECT DISTINCT host, path FROM parts) u JOIN rules
    ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
  GROUP BY host, path
)
SELECT page_id, parts.host, parts.path, rule, coalesce(verdict, 'allow') AS verdict
FROM parts LEFT JOIN hits ON parts.host = hits.host AND parts.path = hits.path
"""


# CRC-32 (reversed polynomial) of decimal ids: a table of 256 remainders, then one step a digit.
TRIE_SQL = """
WITH crc_table AS (
  SELECT list(list_reduce(list_prepend(i, range(8)),
              lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
  FROM range(256) r(i)
), ids AS (
  SELECT conv_id, CAST(conv_id AS VARCHAR) AS s FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), crcs AS (
  SELECT conv_id, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(s) + 1), lambda i: ascii(substr(s, i, 1))::BIGINT)),
           lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295) AS crc
  FROM ids, crc_table
), heads AS (
  SELECT conv_id, conv_id - conv_id % 100 AS base, crc % 6 AS h FROM crcs
), digests AS (
  SELECT conv_id, turn, length(coalesce(text, '')) AS chars,
         sha256(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))) AS d
  FROM conversations WHERE conv_id IS NOT NULL
), turns AS (
  SELECT conv_id, chars, d, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, d) - 1 AS pos FROM digests
), rebuilt AS (
  SELECT h.conv_id, t.chars, t.d, t.pos FROM heads h JOIN turns t ON t.conv_id = h.base AND t.pos < h.h
  UNION ALL
  SELECT h.conv_id, t.chars, t.d, t.pos FROM heads h JOIN turns t ON t.conv_id = h.conv_id AND t.pos >= h.h
), placed AS (
  SELECT conv_id, chars, d, row_number() OVER (PARTITION BY conv_id ORDER BY pos) AS depth FROM rebuilt
), prefixes AS (
  SELECT conv_id, 0 AS depth, 0 AS chars, '' AS node FROM ids
  UNION ALL
  SELECT conv_id, depth, chars, sha256(string_agg(d, ',') OVER (PARTITION BY conv_id ORDER BY depth)) FROM placed
), lengths AS (
  SELECT conv_id, max(depth) AS len FROM prefixes GROUP BY conv_id
), nodes AS (
  SELECT node, p.depth, any_value(chars) AS chars, min(p.conv_id) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(CAST(p.conv_id AS VARCHAR), ',' ORDER BY p.conv_id) FILTER (len = p.depth), '')) AS ends_sha256
  FROM prefixes p JOIN lengths USING (conv_id) GROUP BY node, p.depth
), above AS (
  SELECT n.node, n.depth, n.chars, n.conv_id, n.n_convs, n.ends_sha256, p.node AS parent, m.conv_id AS parent_conv_id
  FROM nodes n LEFT JOIN prefixes p ON p.conv_id = n.conv_id AND p.depth = n.depth - 1 LEFT JOIN nodes m ON m.node = p.node
), children AS (
  SELECT parent AS node, count(*) AS n FROM above WHERE parent IS NOT NULL GROUP BY parent
), sums AS (
  SELECT p.node, sum(CASE WHEN c.n IS NULL THEN 1 ELSE 0 END) AS n_leaves, sum((b.n_convs - 1) * b.chars) AS saved_tokens
  FROM above b JOIN prefixes p ON p.conv_id = b.conv_id AND p.depth <= b.depth LEFT JOIN children c ON c.node = b.node
  GROUP BY p.node
)
SELECT a.conv_id, a.depth, a.parent_conv_id, a.n_convs, coalesce(c.n, 0) AS n_children, CAST(s.n_leaves AS BIGINT) AS n_leaves,
       CAST(s.saved_tokens AS BIGINT) AS saved_tokens, a.ends_sha256
FROM above a JOIN sums s ON s.node = a.node LEFT JOIN children c ON c.node = a.node
"""

FIM_SQL = r"""
WITH docs AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), tokens AS (
  SELECT doc_id, text, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u,
         ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4
  FROM docs
), cuts AS (
  SELECT *, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain'
              WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM tokens
), parts AS (
  SELECT doc_id, text, len(u) AS n, form, array_to_string(u[1:a], '') AS pre, array_to_string(u[a + 1:b], '') AS mid,
         array_to_string(u[b + 1:], '') AS suf
  FROM cuts
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN concat('<P>', pre, '<S>', suf, '<M>', mid)
                        ELSE concat('<S>', suf, '<P>', pre, '<M>', mid) END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parts
"""


def llm_oracles() -> dict[str, str]:
    return {"op1_url_filter": URL_SQL, "op11_prefix_trie": TRIE_SQL, "op13_fill_middle": FIM_SQL}
