"""The queries ``opN_<name>`` and, where SQL can express them, their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cuckoo_dedup, dac, line_dedup, merkle, mixing, mtree, ngram_join, pieces, resampling, sharding, toxicity, transducer, warc
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def tokenizer(name: str) -> str:
    """Place of a public tokenizer's file; on a cluster the package is installed on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op1_dac_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' ids, written in directly addressable codes and read back."""
    return dac.tokens_roundtrip(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), end_id=2)


@query
def op2_transducer_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of all documents, counted by the compiled transducer."""
    return transducer.token_counts(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), limit=1024)


@query
def op3_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded with source alignment, and decoded."""
    return pieces.encode_documents(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"), output="digests")


@query
def op4_mtree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 highest integer inner products of every hundredth vector, against all rows."""
    return mtree.nearest(table(spark, sf_dir, "embeddings"), k=10, every=100)


ORACLE["op4_mtree_topk"] = """
WITH v AS (SELECT vec_id, [floor(1024 * x::DOUBLE) FOR x IN embedding] AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score
FROM s QUALIFY rank <= 10
"""


@query
def op5_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 contiguous shards of near equal bytes."""
    return sharding.byte_shards(table(spark, sf_dir, "documents"))


@query
def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources mixed to weights 1, 2, 3 (repeating) over 100 % of all words, 3 copies at most."""
    return mixing.mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


@query
def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of all documents linked by 4-word shingles with a Jaccard similarity of 0.85 or more."""
    return ngram_join.ngram_classes(table(spark, sf_dir, "documents"), n=4, threshold="0.85")


ORACLE["op7_ngram_jaccard"] = r"""
WITH RECURSIVE w AS (SELECT doc_id, [x FOR x IN string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') IF x <> ''] AS w FROM documents),
s AS (SELECT doc_id, list_distinct([array_to_string(w[i:i + 3], ' ') FOR i IN range(1, greatest(len(w) - 3, 1) + 1)]) AS s FROM w WHERE len(w) > 0),
g AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
links AS (SELECT x.doc_id AS a, y.doc_id AS b FROM g x JOIN g y ON x.g = y.g AND x.doc_id <> y.doc_id
          GROUP BY x.doc_id, y.doc_id HAVING 100 * count(*) >= 85 * (any_value(x.n) + any_value(y.n) - count(*))),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT doc_id, coalesce(len(s), 0)::BIGINT AS n_shingles, least(doc_id, (SELECT min(b) FROM reach WHERE a = doc_id)) AS component_id
FROM documents LEFT JOIN s USING (doc_id)
"""


@query
def op8_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to WARC archives and read back."""
    return warc.archive_roundtrip(table(spark, sf_dir, "pages"), least=0).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "sound")


ORACLE["op8_warc_archives"] = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload) AS payload_bytes, unhex(sha1(payload))::BIT::VARCHAR AS bits, max(page_id) OVER (PARTITION BY payload) AS top FROM p)
SELECT page_id, payload_bytes,
       array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + 16 * bits[5 * i + 1]::INT + 8 * bits[5 * i + 2]::INT + 4 * bits[5 * i + 3]::INT + 2 * bits[5 * i + 4]::INT + bits[5 * i + 5]::INT, 1) FOR i IN range(32)], '') AS payload_digest,
       CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to, true AS sound
FROM d
"""


@query
def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact duplicates of all documents; the largest id of each group stays."""
    return cuckoo_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


@query
def op10_mil_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, from sentences trained by document labels."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_documents(docs, toxicity.fit(docs, table(spark, sf_dir, "labels"), "toxic"))


ORACLE["op9_exact_dedup"] = """
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""


@query
def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the lines that an earlier document holds."""
    kept = line_dedup.drop_repeated_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE["op11_line_dedup"] = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
e AS (SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS place FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM e),
r AS (SELECT k, min(doc_id) AS first FROM k WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2),
m AS (SELECT k.*, coalesce(doc_id <> first, false) AS gone FROM k LEFT JOIN r USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

#: A 256-entry table of the reflected CRC-32 polynomial, and the checksum of the UTF-8 bytes of an expression.
SQL_CRC_TABLE = "crc AS (SELECT list(c ORDER BY i) AS tab FROM (SELECT i, list_reduce([i] || range(8), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS c FROM range(256) r(i)))"


def sql_crc(text: str) -> str:
    at = f"[('0x' || substr(hex(encode({text})), (2 * k + 1)::INT, 2))::BIGINT FOR k IN range(strlen({text}))]"
    return f"xor(list_reduce([4294967295::BIGINT] || {at}, lambda a, b: xor(tab[(xor(a, b) & 255) + 1], a >> 8)), 4294967295)"


@query
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in one Merkle tree a language, with proofs; every seventh by checksum is tampered with."""
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    return merkle.manifest(table(spark, sf_dir, "documents"), tampered=tampered)


def _sql_leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(f"coalesce(strlen(({c})::VARCHAR) || ':' || ({c})::VARCHAR, '-')" for c in ("doc_id", "source", "lang", n_chars, "text")) + ")"


def _sql_levels(name: str, leaves: str) -> str:
    """Nodes (lvl, tree, i, h) from leaves (tree, i, h), up to a single one a tree."""
    return (f"{name} AS (SELECT 0 AS lvl, tree, i, h FROM {leaves} UNION ALL SELECT lvl + 1, tree, i // 2, sha256(string_agg(h, '' ORDER BY i)) "
            f"FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS n FROM {name}) WHERE n > 1 GROUP BY lvl, tree, i // 2)")


def _sql_fold(name: str, start: str, nodes: str) -> str:
    """Rows (doc_id, lvl, tree, i, h, proof) from ``start``, folded level by level up the nodes."""
    return (f"{name} AS (SELECT * FROM {start} UNION ALL SELECT f.doc_id, f.lvl + 1, f.tree, f.i // 2, "
            f"sha256(CASE WHEN s.h IS NULL THEN f.h WHEN s.i < f.i THEN s.h || f.h ELSE f.h || s.h END), f.proof || coalesce(s.h, '') "
            f"FROM {name} f JOIN {nodes} p ON p.lvl = f.lvl + 1 AND p.tree = f.tree AND p.i = f.i // 2 "
            f"LEFT JOIN {nodes} s ON s.lvl = f.lvl AND s.tree = f.tree AND s.i = xor(f.i, 1))")


ORACLE["op12_merkle_manifest"] = f"""
WITH RECURSIVE {SQL_CRC_TABLE},
d AS (SELECT doc_id, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS i,
             {_sql_leaf("n_chars")} AS h, {_sql_leaf("n_chars + 1")} AS changed, {sql_crc("doc_id::VARCHAR")} % 7 = 0 AS tampered FROM documents, crc),
{_sql_levels("low", "d")},
sub AS (SELECT tree, arg_max(h, lvl) AS h FROM low GROUP BY tree),
high_leaves AS (SELECT 0 AS tree, tree AS i, h FROM sub),
{_sql_levels("high", "high_leaves")},
root AS (SELECT arg_max(h, lvl) AS root FROM high),
start AS (SELECT doc_id, 0 AS lvl, tree, i, CASE WHEN tampered THEN changed ELSE h END AS h, '' AS proof FROM d),
{_sql_fold("f", "start", "low")},
mid AS (SELECT doc_id, 0 AS lvl, 0 AS tree, any_value(tree) AS i, arg_max(h, lvl) AS h, arg_max(proof, lvl) AS proof FROM f GROUP BY doc_id),
{_sql_fold("g", "mid", "high")},
ends AS (SELECT doc_id, arg_max(h, lvl) AS folded_root, sha256(arg_max(proof, lvl)) AS proof_sha256 FROM g GROUP BY doc_id)
SELECT doc_id, d.h AS leaf, sub.h AS subroot, root, proof_sha256, folded_root, folded_root = root AS verified
FROM d JOIN sub USING (tree) JOIN ends USING (doc_id), root
"""


@query
def op13_importance_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of all documents of 20 words or more, drawn towards the distribution of ``benchmark``."""
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", "n_features", "weight", "score", "rank")


def _sql_features(table_: str, key: str) -> str:
    words = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return (f"SELECT {key} AS id, unnest(w || [w[k] || ' ' || w[k + 1] FOR k IN range(1, len(w))]) AS f "
            f"FROM (SELECT {key}, {words} AS w FROM {table_})")


ORACLE["op13_importance_draw"] = f"""
WITH {SQL_CRC_TABLE},
fd AS ({_sql_features("documents", "doc_id")}), ft AS ({_sql_features("benchmark", "item_id")}),
c AS (SELECT f, {sql_crc("f")} % 10000 AS b FROM (SELECT DISTINCT f FROM (SELECT f FROM fd UNION ALL SELECT f FROM ft)), crc),
s AS (SELECT b, count(*) AS s FROM fd JOIN c USING (f) GROUP BY b), t AS (SELECT b, count(*) AS t FROM ft JOIN c USING (f) GROUP BY b),
g AS (SELECT b, floor(1000 * ln(((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM fd) + 10000)::DOUBLE)
                                / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT count(*) FROM ft) + 10000)::DOUBLE)))::BIGINT AS gain
      FROM range(10000) r(b) LEFT JOIN s USING (b) LEFT JOIN t USING (b)),
w AS (SELECT id AS doc_id, count(*) AS n, floor(sum(gain)::HUGEINT / count(*))::BIGINT AS weight, count(*) FILTER (NOT contains(f, ' ')) AS words
      FROM fd JOIN c USING (f) JOIN g USING (b) GROUP BY id),
d AS (SELECT doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(words, 0) >= 20 AS able,
             coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
      FROM documents LEFT JOIN w USING (doc_id)),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM d WHERE able)
SELECT doc_id, n_features, weight, score, CASE WHEN r <= (SELECT count(*) FROM r) * 25 // 100 THEN r END AS rank FROM d LEFT JOIN r USING (doc_id)
"""
