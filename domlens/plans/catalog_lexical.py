"""Catalog: suffix split, lexical features, n-gram dictionaries (L*, A1, A2, L20)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.domain import load_suffix_rules, with_domain_parts, without_suffix
from ..operators import ngrams as NG
from ..operators.lexical import lexical_columns, lexical_features, with_intermediates
from . import oracle as O
from .bindings import SQL_PAGE_HOSTS, page_hosts
from .catalog import query

# ---------------------------------------------------------------- flagship (survey 7.1)
FLAGSHIP_SQL = f"""
WITH base AS ({SQL_PAGE_HOSTS}), {O.lexical_ctes('base')},
f AS (SELECT tmp_tld, domain_name, {', '.join(f'{e} AS {c}' for c, e in O.lexical_select_list()
                                             if c in ('lex_name_len', 'lex_sld_len', 'lex_sld_norm_entropy',
                                                      'lex_sub_norm_entropy', 'lex_sub_digit_ratio',
                                                      'lex_sub_vowel_ratio', 'lex_sub_count'))} FROM _lexin)
SELECT tmp_tld AS suffix, count(*)::BIGINT AS n_pages, count(DISTINCT domain_name)::BIGINT AS n_hosts,
       round(avg(lex_name_len), 6) AS avg_name_len, round(avg(lex_sld_len), 6) AS avg_sld_len,
       round(avg(lex_sld_norm_entropy), 6) AS avg_sld_entropy, round(avg(lex_sub_norm_entropy), 6) AS avg_sub_entropy,
       round(avg(lex_sub_digit_ratio), 6) AS avg_sub_digit_ratio,
       round(avg(lex_sub_vowel_ratio), 6) AS avg_sub_vowel_ratio,
       round(avg(lex_sub_count), 6) AS avg_sub_count, max(lex_sub_count)::BIGINT AS max_sub_count
FROM f GROUP BY tmp_tld
"""


@query("flagship_suffix_profile", FLAGSHIP_SQL)
def flagship_suffix_profile(spark, sf_dir):
    """pages.url -> host -> suffix split -> lexical features, profiled per public suffix."""
    rules = load_suffix_rules(spark)
    feats = with_intermediates(page_hosts(spark, sf_dir), rules)
    cols = lexical_columns()
    feats = feats.select("tmp_tld", "domain_name", *[cols[c].alias(c) for c in (
        "lex_name_len", "lex_sld_len", "lex_sld_norm_entropy", "lex_sub_norm_entropy",
        "lex_sub_digit_ratio", "lex_sub_vowel_ratio", "lex_sub_count")])
    return feats.groupBy(F.col("tmp_tld").alias("suffix")).agg(
        F.count(F.lit(1)).alias("n_pages"),
        F.countDistinct("domain_name").alias("n_hosts"),
        F.avg("lex_name_len").alias("avg_name_len"),
        F.avg("lex_sld_len").alias("avg_sld_len"),
        F.avg("lex_sld_norm_entropy").alias("avg_sld_entropy"),
        F.avg("lex_sub_norm_entropy").alias("avg_sub_entropy"),
        F.avg("lex_sub_digit_ratio").alias("avg_sub_digit_ratio"),
        F.avg("lex_sub_vowel_ratio").alias("avg_sub_vowel_ratio"),
        F.avg("lex_sub_count").alias("avg_sub_count"),
        F.max("lex_sub_count").cast("long").alias("max_sub_count"),
    )


# ---------------------------------------------------------------- L1 / L2: suffix split
SPLIT_SQL = f"""
WITH base AS ({SQL_PAGE_HOSTS}), {O.suffix_split_ctes('base')}
SELECT page_id, domain_name, tmp_tld AS suffix, tmp_sld AS registrable, tmp_sub AS subdomain,
       CASE WHEN tmp_sub <> '' THEN tmp_sub || '.' || tmp_sld ELSE tmp_sld END AS without_suffix
FROM _s3
"""


@query("L1_suffix_split", SPLIT_SQL)
def suffix_split(spark, sf_dir):
    """L1 + L2: public suffix, registrable label, subdomain and the suffix-less name per page."""
    parts = with_domain_parts(page_hosts(spark, sf_dir), "domain_name", load_suffix_rules(spark))
    return parts.select("page_id", "domain_name", F.col("tmp_tld").alias("suffix"),
                        F.col("tmp_sld").alias("registrable"), F.col("tmp_sub").alias("subdomain"),
                        without_suffix("tmp_sub", "tmp_sld").alias("without_suffix"))


# ---------------------------------------------------------------- A1: n-gram counts
def _sql_grams(text: str, n: str) -> str:
    return (f"CASE WHEN length({text}) >= {n} THEN list_transform(range(1, length({text}) - {n} + 2), "
            f"lambda i: substr({text}, i, {n})) ELSE []::VARCHAR[] END")


STRIPPED_CTE = f"""base AS ({SQL_PAGE_HOSTS}), {O.suffix_split_ctes('base')},
stripped AS (SELECT *, CASE WHEN tmp_sub <> '' THEN tmp_sub || '.' || tmp_sld ELSE tmp_sld END AS t,
                    replace(CASE WHEN tmp_sub <> '' THEN tmp_sub || '.' || tmp_sld ELSE tmp_sld END, '.', '') AS tc
             FROM _s3)"""

NGRAM_COUNTS_SQL = f"""
WITH {STRIPPED_CTE},
g AS (SELECT v.n AS n, unnest({_sql_grams('t', 'v.n')}) AS gram FROM stripped, (VALUES (2), (3), (4), (5)) v(n))
SELECT n::INTEGER AS n, gram, count(*)::BIGINT AS cnt FROM g GROUP BY n, gram
"""


def _stripped_hosts(spark, sf_dir):
    parts = with_domain_parts(page_hosts(spark, sf_dir), "domain_name", load_suffix_rules(spark))
    return parts.withColumn("t", without_suffix("tmp_sub", "tmp_sld"))


@query("A1_ngram_counts", NGRAM_COUNTS_SQL)
def ngram_counts(spark, sf_dir):
    """A1: frequency of every 2..5-gram over suffix-stripped page hosts."""
    return NG.ngram_counts(_stripped_hosts(spark, sf_dir), "t", (2, 3, 4, 5))


def _sql_top(src_where: str, family: str, top_n: dict[int, int]) -> str:
    g = (f"SELECT v.n AS n, unnest({_sql_grams('t', 'v.n')}) AS gram FROM stripped, "
         f"(VALUES (2), (3), (4), (5)) v(n) WHERE {src_where}")
    c = f"SELECT n, gram, count(*)::BIGINT AS cnt FROM ({g}) GROUP BY n, gram"
    r = f"SELECT *, row_number() OVER (PARTITION BY n ORDER BY cnt DESC, gram ASC) AS rk FROM ({c})"
    cond = " OR ".join(f"(n = {n} AND rk <= {k})" for n, k in top_n.items())
    return f"SELECT {O.q(family)} AS family, n::INTEGER AS n, gram, cnt FROM ({r}) WHERE {cond}"


TOP_SQL = f"WITH {STRIPPED_CTE} {_sql_top('TRUE', 'pages', NG.TOP_N_DEFAULT)}"


@query("A2_top_ngrams", TOP_SQL)
def top_ngrams(spark, sf_dir):
    """A2: the 300 / 2000 / 5000 / 10000 most common 2- / 3- / 4- / 5-grams (ties: gram)."""
    hosts = page_hosts(spark, sf_dir).select("domain_name")
    return NG.domain_ngram_dictionary(hosts, load_suffix_rules(spark), "pages", NG.TOP_N_DEFAULT)


@query("A2_heavy_ngrams", TOP_SQL)
def heavy_ngrams(spark, sf_dir):
    """A2: the same rows from summaries of bounded size and a recount."""
    return NG.heavy_ngram_dictionary(_stripped_hosts(spark, sf_dir), "t", "pages", NG.TOP_N_DEFAULT)


# ---------------------------------------------------------------- L20: dictionary matches
FAMILY_SETS = {  # family -> (url predicate in Spark, in SQL, top-N)
    "phishing": (lambda u: u.startswith("https:"), "starts_with(url, 'https:')", NG.TOP_N_DEFAULT),
    "malware": (lambda u: u.startswith("http:"), "starts_with(url, 'http:')", NG.TOP_N_DEFAULT),
    "dga": (lambda u: u.contains("?"), "contains(url, '?')", NG.TOP_N_DGA),
}


def family_dictionary(spark, sf_dir):
    """The dictionaries of all families, from one scan of the pages."""
    hosts = page_hosts(spark, sf_dir)
    families = F.filter(F.array(*[F.when(pred(F.col("url")), F.lit(fam)) for fam, (pred, _, _) in FAMILY_SETS.items()]), lambda f: f.isNotNull())
    return NG.family_ngram_dictionary(hosts.select("domain_name", families.alias("families")), load_suffix_rules(spark), {f: top for f, (_, _, top) in FAMILY_SETS.items()})


_MATCH_COLS = NG.match_columns()
DICT_SQL = f"""WITH {STRIPPED_CTE}
{' UNION ALL '.join(f"SELECT * FROM ({_sql_top(w, fam, top)})" for fam, (_, w, top) in FAMILY_SETS.items())}"""


def sql_matches(texts: str) -> str:
    """(tc, one count per dictionary) of the distinct names ``tc`` of ``texts`` that match any."""
    return f"""SELECT g.tc, {', '.join(f"count(CASE WHEN d.family = '{f}' AND d.n = {n} THEN 1 END)::BIGINT AS {NG.match_column_name(f, n)}" for f, ns in NG.MATCHED.items() for n in ns)}
FROM (SELECT DISTINCT tc, v.n AS n, unnest({_sql_grams('tc', 'v.n')}) AS gram FROM (SELECT DISTINCT tc FROM {texts}), (VALUES (2), (3), (4), (5)) v(n)) g
JOIN ({DICT_SQL}) d ON g.n = d.n AND g.gram = d.gram GROUP BY g.tc"""


MATCH_LIST = ", ".join(f"coalesce({c}, 0)::BIGINT AS {c}" for c in _MATCH_COLS)


@query("L20_ngram_matches", f"""
WITH {STRIPPED_CTE}, m AS ({sql_matches('stripped')})
SELECT s.page_id, {MATCH_LIST} FROM stripped s LEFT JOIN m ON s.tc = m.tc
""")
def ngram_matches(spark, sf_dir):
    """Per page, how many grams of each family dictionary occur in its dot-free name."""
    hosts = _stripped_hosts(spark, sf_dir).withColumn("tc", F.replace(F.col("t"), F.lit("."), F.lit("")))
    return NG.with_ngram_matches(hosts.select("page_id", "tc"), "tc", family_dictionary(spark, sf_dir)).drop("tc")


# ---------------------------------------------------------------- all lexical features
_LEX = O.lexical_select_list()
LEXICAL_SQL = f"""
WITH base AS ({SQL_PAGE_HOSTS}), {O.lexical_ctes('base')}, m AS ({sql_matches('(SELECT tmp_concat AS tc FROM _lexin)')})
SELECT page_id, domain_name, {', '.join(f'{e} AS {c}' for c, e in _LEX)}, {MATCH_LIST} FROM _lexin LEFT JOIN m ON _lexin.tmp_concat = m.tc
"""
_LEX_DOUBLES = [c for c, _ in _LEX if c.endswith(("ratio", "entropy", "score", "avg_part_len", "stdev_part_lens",
                                                   "digit_count")) and c != "lex_suffix_score"]


@query("L_lexical_features", O.rounded(LEXICAL_SQL, _LEX_DOUBLES))
def lexical(spark, sf_dir):
    """The lexical feature vector of every page host (62 columns)."""
    hosts = page_hosts(spark, sf_dir).select("page_id", "domain_name")
    return lexical_features(hosts, load_suffix_rules(spark), ngram_dictionary=family_dictionary(spark, sf_dir))
