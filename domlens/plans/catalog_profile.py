"""Catalog: feature profiling (A4-A6), unwired lexical helpers (L27), label and
schema preparation (P10-P13, P16, P20)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.domain import load_suffix_rules
from ..operators import prep as P
from ..operators import profile as PR
from ..operators import tls as TLS
from ..operators.blocks import saved
from ..operators.lexical import extra_lexical_columns, lexical_features, with_intermediates
from . import oracle as O
from . import records_sql as RS
from .bindings import SQL_PAGE_HOSTS, page_hosts, table
from .catalog import query
from .records import as_of, star_records

_TLS_CTES, _TLS_COLS = RS.tls_sql()
TLS_FEATURES = [c for c, _ in _TLS_COLS]
SQL_TLS_TABLE = f"WITH {RS.RECORDS_SQL}, {_TLS_CTES} SELECT label, " + \
    ", ".join(f"{e} AS {c}" for c, e in _TLS_COLS) + " FROM t7"


def _tls_table(spark, sf_dir):
    return TLS.tls_features(star_records(spark, sf_dir), as_of()).select("label", *TLS_FEATURES)


@query("A4_nonnull_ratio", "SELECT *, neg_count::DOUBLE / pos_count AS ratio FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, count(CASE WHEN label = 'benign' THEN {c} END)::BIGINT AS neg_count, "
    f"count(CASE WHEN label = 'phishing' THEN {c} END)::BIGINT AS pos_count FROM ({SQL_TLS_TABLE})"
    for c in TLS_FEATURES) + ") WHERE pos_count <> 0 "
    "ORDER BY neg_count::DOUBLE / pos_count DESC, feature LIMIT 16")
def nonnull_ratio(spark, sf_dir):
    """A4: benign / phishing ratio of non-NULL counts of the TLS features, top 16."""
    return PR.nonnull_ratio(_tls_table(spark, sf_dir), TLS_FEATURES, "label", "phishing", "benign")


HIST_FEATURES = TLS_FEATURES
_HIST_LONG = " UNION ALL ".join(f"SELECT label AS class, '{c}' AS feature, coalesce(({c})::DOUBLE, -1.0) AS value "
                                f"FROM f" for c in HIST_FEATURES)


@query("A5_histograms", f"""
WITH f AS ({SQL_TLS_TABLE}), l AS ({_HIST_LONG}),
s0 AS (SELECT feature, class, min(value) AS lo, max(value) AS hi, count(*) AS n FROM l GROUP BY 1, 2),
s AS (SELECT feature, class, CASE WHEN lo = hi THEN lo - 0.5 ELSE lo END AS lo,
             CASE WHEN lo = hi THEN hi + 0.5 ELSE hi END AS hi, n FROM s0),
b AS (SELECT l.feature, l.class, least(floor((value - lo) / (hi - lo) * {PR.BINS}), {PR.BINS - 1})::INTEGER AS bin,
             lo, hi, n FROM l JOIN s ON l.feature = s.feature AND l.class = s.class),
c AS (SELECT feature, class, bin, count(*)::BIGINT AS count FROM b GROUP BY 1, 2, 3),
a AS (SELECT s.*, r.bin::INTEGER AS bin FROM s, range({PR.BINS}) r(bin))
SELECT a.feature, a.class, a.bin, lo + a.bin * ((hi - lo) / {PR.BINS}) AS bin_start, coalesce(count, 0)::BIGINT AS count,
       coalesce(count, 0) / (n * ((hi - lo) / {PR.BINS})) AS density
FROM a LEFT JOIN c ON a.feature = c.feature AND a.class = c.class AND a.bin = c.bin
""")
def histograms(spark, sf_dir):
    """A5: 20-bin density histograms of all TLS features per class (NULL -> -1)."""
    return PR.histograms(_tls_table(spark, sf_dir), HIST_FEATURES, "label")


CORR_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber", "label_code"]


@query("A6_correlations", "WITH t AS (SELECT *, dense_rank() OVER (ORDER BY l_returnflag) - 1 AS label_code "
       "FROM lineitem), w AS (SELECT " + ", ".join(
           f"corr(({a})::DOUBLE, ({b})::DOUBLE) AS {a}__{b}" for i, a in enumerate(CORR_COLUMNS)
           for b in CORR_COLUMNS[i:]) + " FROM t) " + " UNION ALL ".join(
    f"SELECT '{x}' AS feature_a, '{y}' AS feature_b, {a}__{b} AS corr FROM w"
    for i, a in enumerate(CORR_COLUMNS) for b in CORR_COLUMNS[i:]
    for x, y in ([(a, b)] if a == b else [(a, b), (b, a)])))
def correlations(spark, sf_dir):
    """Pairwise Pearson correlation of lineitem numerics and the encoded return flag."""
    li = PR.label_codes(table(spark, sf_dir, "lineitem"), "l_returnflag")
    return PR.correlations(li, CORR_COLUMNS)


TLS_CORR_COLUMNS = [*TLS_FEATURES, "label_code"]


@query("A6_feature_correlations", f"WITH f AS ({SQL_TLS_TABLE}), t AS (SELECT *, dense_rank() OVER (ORDER BY label) - 1 "
       "AS label_code FROM f), w AS (SELECT " + ", ".join(
           f"corr(({a})::DOUBLE, ({b})::DOUBLE) AS {a}__{b}" for i, a in enumerate(TLS_CORR_COLUMNS)
           for b in TLS_CORR_COLUMNS[i:]) + " FROM t) " + " UNION ALL ".join(
    f"SELECT '{x}' AS feature_a, '{y}' AS feature_b, {a}__{b} AS corr FROM w"
    for i, a in enumerate(TLS_CORR_COLUMNS) for b in TLS_CORR_COLUMNS[i:]
    for x, y in ([(a, b)] if a == b else [(a, b), (b, a)])))
def feature_correlations(spark, sf_dir):
    """Pairwise Pearson correlation of all TLS features and the encoded label."""
    t = saved(_tls_table(spark, sf_dir), "tls-features")  # read for the codes and for the sums
    return PR.gram_correlations(PR.label_codes(t, "label"), TLS_CORR_COLUMNS).drop("n")


# ---------------------------------------------------------------- L27
_X = ["lex_consonant_ratio", "lex_hex_ratio", "lex_known_tld", "lex_subdomain_list", "lex_underscore_hyphen_count"]


@query("L27_extra_lexical", f"""
WITH base AS ({SQL_PAGE_HOSTS}), {O.lexical_ctes('base')},
x AS (SELECT *, CASE WHEN tmp_sub = '' THEN []::VARCHAR[] ELSE string_split(tmp_sub, '.') END AS _subs FROM _lexin)
SELECT page_id, domain_name,
  CASE WHEN {O.count_matching('lower(domain_name)', '[bcdfghjklmnpqrstvwxyz]')} > 0
       THEN {O.count_matching('lower(domain_name)', '[bcdfghjklmnpqrstvwxyz]')}::DOUBLE / length(domain_name)
       ELSE 0.0 END AS lex_consonant_ratio,
  {O.ratio(O.count_matching('domain_name', '[0-9A-Fa-f]'), 'length(domain_name)')} AS lex_hex_ratio,
  (tmp_tld <> '')::BIGINT AS lex_known_tld,
  array_to_string(list_concat(CASE WHEN list_position(_subs, 'www') IS NOT NULL
       THEN list_concat(_subs[1:list_position(_subs, 'www') - 1], _subs[list_position(_subs, 'www') + 1:])
       ELSE _subs END, [tmp_sld]), '|') AS lex_subdomain_list,
  {O.count_matching('domain_name', '[_-]')}::BIGINT AS lex_underscore_hyphen_count
FROM x
""")
def extra_lexical(spark, sf_dir):
    """The unwired lexical helpers (consonant / hex ratio, known suffix, subdomain list,
    underscore + hyphen count); the list is joined with '|' for comparison."""
    df = with_intermediates(page_hosts(spark, sf_dir).select("page_id", "domain_name"), load_suffix_rules(spark))
    cols = extra_lexical_columns()
    cols["lex_subdomain_list"] = F.array_join(cols["lex_subdomain_list"], "|")
    return df.select("page_id", "domain_name", *[cols[c].alias(c) for c in _X])


# ---------------------------------------------------------------- P16, P10-P13, P20
SEGMENTS = ["automobile", "building", "furniture", "household", "machinery"]
CLASSES = [f"{lab}:{seg}" for lab in ("benign", "phishing") for seg in SEGMENTS]  # class id = position


@query("P16_label_index", f"""
WITH l AS (SELECT CASE WHEN l_returnflag = 'R' THEN 'phishing' ELSE 'benign' END || ':' || lower(c_mktsegment)
                  AS label FROM lineitem li JOIN orders o ON li.l_orderkey = o.o_orderkey
                  JOIN customer c ON o.o_custkey = c.c_custkey)
SELECT label, (list_position({O.str_list(CLASSES)}, label) - 1)::INTEGER AS class_id, count(*)::BIGINT AS n
FROM l GROUP BY 1, 2
""")
def label_index(spark, sf_dir):
    """Label:category -> class index through a class table (an unmapped label raises)."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    j = li.join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey)
    lab = j.select(F.when(F.col("l_returnflag") == "R", "phishing").otherwise("benign").alias("label"),
                   F.lower("c_mktsegment").alias("category"))
    classes = spark.createDataFrame(list(zip(CLASSES, range(len(CLASSES)))), "label STRING, class_id INT")
    indexed = P.label_to_index(P.combine_label(lab), classes)
    return indexed.groupBy("label", "class_id").agg(F.count(F.lit(1)).alias("n"))


RENAMES = {"lex_name_len": "name_len", "lex_sld_len": "sld_len", "lex_tld_abuse_score": "tld_abuse"}


@query("P10_P13_schema_ops", f"""
WITH base AS ({SQL_PAGE_HOSTS}), {O.lexical_ctes('base')}
SELECT page_id, domain_name, length(domain_name)::DOUBLE AS name_len, length(tmp_sld)::DOUBLE AS sld_len,
       {O.tld_abuse('tmp_tld')} AS tld_abuse, {O.count_subdomains('tmp_sub')} AS lex_sub_count
FROM _lexin
""")
def schema_ops(spark, sf_dir):
    """P10 select by prefix, P11 curated list, P12 renames, P13 realign / cast, P20 ablation."""
    feats = lexical_features(page_hosts(spark, sf_dir).select("page_id", "domain_name"), load_suffix_rules(spark))
    feats = P.select_features(feats, extra=("page_id", "domain_name"))                         # P10
    feats, _unused = P.select_curated(feats, ["domain_name", "lex_name_len", "lex_sld_len", "lex_tld_abuse_score",
                                              "lex_sub_count", "lex_www_flag"], label="page_id")  # P11
    feats = P.ablate(feats, "lex_www_flag")                                                     # P20
    feats = P.rename(feats, RENAMES)                                                            # P12
    ref = "page_id BIGINT, domain_name STRING, name_len DOUBLE, sld_len DOUBLE, tld_abuse DOUBLE, lex_sub_count BIGINT"
    from pyspark.sql.types import StructType
    return P.realign(feats, StructType.fromDDL(ref))                                           # P13


@query("F7_false_positives", """
SELECT d.doc_id, d.n_chars, l.quality AS label, (d.n_chars >= 2000)::INTEGER AS prediction
FROM documents d JOIN labels l ON d.doc_id = l.doc_id
WHERE (d.n_chars >= 2000)::INTEGER = 1 AND l.quality = 0
""")
def false_positives(spark, sf_dir):
    """documents the len2000 rule flags as good although labelled poor; the key travels
    with the row (no offset arithmetic)."""
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    lab = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    scored = d.join(lab, "doc_id").withColumn("prediction", (F.col("n_chars") >= 2000).cast("int"))
    return P.false_positives(scored)


@query("P14_P15_labels", """
SELECT doc_id, 'listed' AS label, regexp_replace(lang || ':dga', ':dga$', '') AS family FROM documents
""")
def constant_and_clean_labels(spark, sf_dir):
    """A constant label column; P15: the ':dga' suffix stripped from a label."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.col("lang"), F.lit(":dga")).alias("family"))
    return P.clean_label(P.constant_label(d, "listed"), column="family").select("doc_id", "label", "family")
