"""Catalog: keyed set operations, joins and the rule filter (U*, J*, F2, J7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.lexicon import BENIGN_KEYWORDS, PHISHING_KEYWORDS
from ..operators import rules as R
from ..operators import setops as S
from . import oracle as O
from .bindings import SQL_HTTP, SQL_HTTPS, SQL_QUERY, http_set, https_set, query_set
from .catalog import query

_COLS = "page_id, url, domain_name"


@query("U1_keyed_union", f"""
WITH a AS ({SQL_HTTPS}), b AS ({SQL_HTTP})
SELECT {_COLS} FROM a
UNION ALL
SELECT {_COLS} FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.domain_name IS NOT DISTINCT FROM b.domain_name)
""")
def keyed_union(spark, sf_dir):
    """Https pages plus the http pages whose host is not served over https."""
    return S.keyed_union(https_set(spark, sf_dir), http_set(spark, sf_dir))


@query("U2_keyed_union_fold", f"""
WITH t AS (SELECT {_COLS}, 0 AS r FROM ({SQL_QUERY}) UNION ALL SELECT {_COLS}, 1 FROM ({SQL_HTTPS})
           UNION ALL SELECT {_COLS}, 2 FROM ({SQL_HTTP})),
m AS (SELECT domain_name, min(r) AS r FROM t WHERE domain_name IS NOT NULL GROUP BY domain_name)
SELECT {_COLS} FROM t WHERE domain_name IS NULL
   OR EXISTS (SELECT 1 FROM m WHERE m.domain_name = t.domain_name AND m.r = t.r)
""")
def keyed_union_fold(spark, sf_dir):
    """Fold of keyed unions over [query-string pages, https pages, http pages]; earlier wins."""
    return S.keyed_union_fold([query_set(spark, sf_dir), https_set(spark, sf_dir), http_set(spark, sf_dir)])


@query("J1_semi_join", f"""
WITH a AS ({SQL_HTTPS}), b AS ({SQL_QUERY})
SELECT {_COLS} FROM a WHERE EXISTS (SELECT 1 FROM b WHERE a.domain_name IS NOT DISTINCT FROM b.domain_name)
""")
def semi_join(spark, sf_dir):
    """Https pages whose host also appears among query-string pages."""
    return S.semi_join(https_set(spark, sf_dir), query_set(spark, sf_dir))


@query("J2_anti_join", f"""
WITH a AS ({SQL_HTTPS}), b AS ({SQL_HTTP})
SELECT {_COLS} FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE a.domain_name IS NOT DISTINCT FROM b.domain_name)
""")
def anti_join(spark, sf_dir):
    """Https pages whose host never appears over http."""
    return S.anti_join(https_set(spark, sf_dir), http_set(spark, sf_dir))


@query("J3_right_anti_join", f"""
WITH a AS ({SQL_HTTPS}), b AS ({SQL_HTTP})
SELECT {_COLS} FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.domain_name = b.domain_name)
""")
def right_anti_join(spark, sf_dir):
    """The right-anti step of the union fold (http pages not in https)."""
    return S.right_anti_join(https_set(spark, sf_dir), http_set(spark, sf_dir))


@query("J4_lookup_copy", f"""
WITH names AS (SELECT domain_name FROM ({SQL_QUERY})), t AS ({SQL_HTTPS})
SELECT names.domain_name, t.page_id, t.url FROM names JOIN t ON names.domain_name = t.domain_name
""")
def lookup_copy(spark, sf_dir):
    """Copy the https pages of every listed host (list = hosts of query-string pages, duplicates kept)."""
    names = query_set(spark, sf_dir).select("domain_name")
    return S.lookup_copy(names, https_set(spark, sf_dir).select("domain_name", "page_id", "url"))


@query("U4_concat_all", f"""
SELECT {_COLS} FROM ({SQL_HTTPS}) UNION ALL SELECT {_COLS} FROM ({SQL_HTTP})
UNION ALL SELECT {_COLS} FROM ({SQL_QUERY})
""")
def concat_all(spark, sf_dir):
    """U4: bag union of the three labelled sets, columns realigned by name."""
    q = query_set(spark, sf_dir)
    return S.concat_all([https_set(spark, sf_dir), http_set(spark, sf_dir).select("url", "domain_name", "page_id"), q])


@query("U5_merge_keep_first", f"""
WITH t AS (SELECT {_COLS}, 0 AS is_new FROM ({SQL_HTTPS}) UNION ALL SELECT {_COLS}, 1 FROM ({SQL_QUERY})),
r AS (SELECT *, row_number() OVER (PARTITION BY domain_name ORDER BY is_new, page_id) AS rk FROM t)
SELECT {_COLS} FROM r WHERE rk = 1
""")
def merge_keep_first(spark, sf_dir):
    """Merge old (https) and new (query-string) results by host; old wins, then lowest page_id."""
    return S.merge_keep_first(https_set(spark, sf_dir), query_set(spark, sf_dir), order="page_id")


@query("U6_distinct_values", f"SELECT DISTINCT domain_name FROM ({SQL_HTTPS})")
def distinct_values(spark, sf_dir):
    """Distinct hosts of the https set."""
    return S.distinct_values(https_set(spark, sf_dir), "domain_name")


@query("U6_distinct_count", f"""
SELECT count(DISTINCT domain_name)::BIGINT AS n_distinct_domain_name, count(*)::BIGINT AS n_rows FROM ({SQL_HTTPS})
""")
def distinct_count(spark, sf_dir):
    """How many distinct hosts (and rows) the https set holds."""
    df = https_set(spark, sf_dir)
    return df.agg(F.countDistinct("domain_name").alias("n_distinct_domain_name"), F.count(F.lit(1)).alias("n_rows"))


# ---------------------------------------------------------------- F2 / J7: rule filter
# Fixed rule list for the test binding (same file format as a shipped rule file).
RULE_LINES = [
    "# pages on blog hosts",
    r"^blog\.",
    "",
    "# mobile hosts",
    r"^m\.",
    r"(www\.)?.+\.example\.org$",
    r"(casino|pills|bets)",
]
RULES = R.parse_rules(RULE_LINES)


def _sql_first_rule(col: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({col}, {O.q(r)}) THEN {i + 1}" for i, r in enumerate(RULES)) + " END"


@query("F2_rule_filter", f"""
SELECT page_id, domain_name, ({_sql_first_rule('domain_name')}) IS NOT NULL AS filtered
FROM ({SQL_HTTPS.replace("starts_with(url, 'https:')", 'TRUE')})
""")
def rule_filter(spark, sf_dir):
    """split every page host into filtered (matches any rule) and passed."""
    from .bindings import page_hosts
    hosts = page_hosts(spark, sf_dir).select("page_id", "domain_name")
    return hosts.withColumn("filtered", R.any_rule_matches(F.col("domain_name"), RULES))


@query("J7_rule_theta_join", f"""
SELECT page_id, domain_name, r AS rule_no, list_extract({O.str_list(RULES)}, r) AS rule FROM (
  SELECT page_id, domain_name, ({_sql_first_rule('domain_name')})::INTEGER AS r
  FROM ({SQL_HTTPS.replace("starts_with(url, 'https:')", 'TRUE')}))
""")
def rule_theta_join(spark, sf_dir):
    """Each page host with the first rule (file order) it matches, or NULL."""
    from .bindings import page_hosts
    hosts = page_hosts(spark, sf_dir).select("page_id", "domain_name")
    return R.tag_rules(hosts, "domain_name", RULES)


# rules of keywords, each with and without a group or class beside its literal
MANY = RULES + [p for k in (*PHISHING_KEYWORDS, *BENIGN_KEYWORDS) for p in (rf"^{k}[0-9]*\\.", rf"(^|\\.){k}-?[a-z]+", rf"{k}\\.(com|net)$")] + [r"^[a-z]{4}\\.", r"[0-9]+\\.(com|org)$"]


@query("J7_many_rules", f"""
WITH h AS (SELECT page_id, domain_name FROM ({SQL_HTTPS.replace("starts_with(url, 'https:')", 'TRUE')})),
r AS (SELECT unnest({O.str_list(MANY)}) AS rule, unnest(range(1, {len(MANY) + 1}))::INTEGER AS rule_no),
m AS (SELECT d.domain_name, min(rule_no) AS rule_no FROM (SELECT DISTINCT domain_name FROM h) d JOIN r ON regexp_matches(d.domain_name, r.rule) GROUP BY 1)
SELECT page_id, h.domain_name, rule_no, rule FROM h LEFT JOIN m ON h.domain_name = m.domain_name LEFT JOIN r USING (rule_no)
""")
def many_rules(spark, sf_dir):
    """The first of a long list of rules that each page host matches, by an index of the rules' literals."""
    from .bindings import page_hosts
    hosts = page_hosts(spark, sf_dir).select("page_id", "domain_name")
    return R.tag_many_rules(hosts, "domain_name", MANY)
