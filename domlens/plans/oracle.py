"""DuckDB twins of the column expressions, used to write ``oracle_sql()``.

Each builder returns a DuckDB SQL expression string computing the same value as
its Spark counterpart in ``domlens.functions`` / ``domlens.operators``; the
catalog stitches them into whole queries over the registered test tables.
"""

from __future__ import annotations

from ..functions.domain import shipped_rules
from ..functions.lexicon import (
    BENIGN_KEYWORDS, CDN_SUFFIXES, CONSONANTS, HEX_CHARS, IMAGE_HOSTING_SUFFIXES, IPV4_DASHED,
    IPV4_DOTTED, PHISHING_KEYWORDS, SUFFIX_SCORE_WEIGHTS, TLD_ABUSE_SCORES, TRUSTED_SUFFIXES,
    VOWELS, VPS_SUFFIXES, WELL_KNOWN_SUFFIXES,
)


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def str_list(items) -> str:
    return "[" + ", ".join(q(x) for x in items) + "]::VARCHAR[]"


def chars(s: str) -> str:
    return f"(CASE WHEN {s} = '' THEN []::VARCHAR[] ELSE string_split({s}, '') END)"


def count_matching(s: str, cls: str) -> str:
    return f"(length({s}) - length(regexp_replace({s}, {q(cls)}, '', 'g')))"


def count_not_matching(s: str, cls: str) -> str:
    return f"length(regexp_replace({s}, {q(cls)}, '', 'g'))"


def ratio(num: str, den: str) -> str:
    return f"(CASE WHEN {den} = 0 THEN 0.0 ELSE ({num})::DOUBLE / ({den}) END)"


def value_entropy(arr: str) -> str:
    """Entropy in bits of a list's value distribution; [] -> 0."""
    return (f"(CASE WHEN len({arr}) = 0 THEN 0.0 ELSE coalesce(list_sum(list_transform(list_distinct({arr}), "
            f"lambda u: -(len(list_filter({arr}, lambda x: x = u))::DOUBLE / len({arr})) * "
            f"log2(len(list_filter({arr}, lambda x: x = u))::DOUBLE / len({arr})))), 0.0) END)")


def norm_entropy(s: str) -> str:
    return f"(CASE WHEN length({s}) = 0 THEN 0.0 ELSE {value_entropy(chars(s))} / length({s}) END)"


def md5_mod(s: str) -> str:
    acc = "0::BIGINT"
    for i in range(4):
        chunk = f"('0x' || substr(md5({s}), {8 * i + 1}, 8))::BIGINT"
        acc = f"((({acc}) * 4294967296 + {chunk}) % 2147483647)"
    return acc


def simhash32(s: str) -> str:
    hs = f"list_transform({chars(s)}, lambda c: ('0x' || right(md5(c), 8))::BIGINT)"
    n = f"len({chars(s)})"
    terms = [f"(CASE WHEN 2 * list_sum(list_transform({hs}, lambda h: (h >> {i}) & 1)) >= {n} "
             f"OR {n} = 0 THEN {1 << i} ELSE 0 END)" for i in range(32)]
    return "(" + " + ".join(terms) + ")::BIGINT"


def longest_run(s: str) -> str:
    step = ("CASE WHEN c = acc.p THEN acc.r + 1 ELSE 1 END")
    return (f"coalesce(list_reduce({chars(s)}, lambda acc, c: {{'p': c, 'r': {step}, "
            f"'b': greatest(acc.b, {step})}}, {{'p': '', 'r': 0, 'b': 0}}).b, 0)::BIGINT")


def longest_consonant_run(s: str) -> str:
    return (f"coalesce(list_max(list_transform(regexp_extract_all(lower({s}), '[{CONSONANTS}]+'), "
            f"lambda r: length(r))), 0)::BIGINT")


def keyword_count(s: str, kws) -> str:
    return "(" + " + ".join(f"(CASE WHEN contains({s}, {q(k)}) THEN 1 ELSE 0 END)" for k in kws) + ")::BIGINT"


def ends_with_any(s: str, sufs) -> str:
    return "(CASE WHEN " + " OR ".join(f"ends_with({s}, {q(x)})" for x in dict.fromkeys(sufs)) + \
        " THEN 1 ELSE 0 END)::BIGINT"


def tld_abuse(tld: str) -> str:
    cases = " ".join(f"WHEN {q(k)} THEN {v}" for k, v in TLD_ABUSE_SCORES.items())
    return f"(CASE regexp_replace({tld}, '^\\.+', '') {cases} ELSE 0.0 END)::DOUBLE"


def arr_stddev(arr: str) -> str:
    return (f"(CASE WHEN len({arr}) <= 1 THEN 0.0 ELSE "
            f"sqrt(list_sum(list_transform({arr}, lambda x: (x - list_avg({arr})) * (x - list_avg({arr})))) "
            f"/ len({arr})) END)")


def count_subdomains(sub: str) -> str:
    return (f"(CASE WHEN {sub} = '' THEN 0 ELSE len(string_split({sub}, '.')) - "
            f"(CASE WHEN list_contains(string_split({sub}, '.'), 'www') THEN 1 ELSE 0 END) END)::BIGINT")


def suffix_split_ctes(src: str, name: str = "domain_name", prefix: str = "tmp_", tag: str = "") -> str:
    """CTE text ``_s1{tag} .. _s3{tag}`` adding ``{prefix}tld/sld/sub`` to every row of ``src``."""
    rules = shipped_rules()
    normal = str_list([r for r, k in rules if k == "normal"])
    wild = str_list([r for r, k in rules if k == "wildcard"])
    exc = str_list([r for r, k in rules if k == "exception"])
    cand = "array_to_string(_low[_n - k + 1:_n], '.')"
    cand_w = "array_to_string(_low[_n - k + 2:_n], '.')"
    ip = f"regexp_full_match({name}, {q(IPV4_DOTTED)})"
    return f"""_s1{tag} AS (SELECT *, string_split({name}, '.') AS _lab, string_split(lower({name}), '.') AS _low,
                  len(string_split({name}, '.')) AS _n FROM {src}),
_s2{tag} AS (SELECT *, CASE WHEN {ip} THEN 0 ELSE coalesce(
          list_max(list_transform(range(1, _n + 1), lambda k: CASE WHEN list_contains({exc}, {cand}) THEN k - 1 END)),
          list_max(list_transform(range(1, _n + 1), lambda k: CASE WHEN list_contains({normal}, {cand})
                   OR (k >= 2 AND list_contains({wild}, {cand_w})) THEN k END)), 0) END AS _sl,
          {ip} AS _isip FROM _s1{tag}),
_s3{tag} AS (SELECT * EXCLUDE (_lab, _low, _n, _sl, _isip),
          CASE WHEN _sl > 0 THEN array_to_string(_lab[_n - _sl + 1:_n], '.') ELSE '' END AS {prefix}tld,
          CASE WHEN _isip THEN {name} WHEN _n - _sl >= 1 THEN _lab[_n - _sl] ELSE '' END AS {prefix}sld,
          CASE WHEN _isip THEN '' WHEN _n - _sl >= 2 THEN array_to_string(_lab[1:_n - _sl - 1], '.') ELSE '' END
            AS {prefix}sub FROM _s2{tag})"""


def _part_features(s: str, tag: str) -> list[tuple[str, str]]:
    n = f"length({s})"
    digits = count_matching(s, r"\p{Nd}")
    vowels = count_matching(f"lower({s})", f"[{VOWELS}]")
    cons = count_matching(s, f"[{CONSONANTS}]")
    nonal = count_not_matching(s, r"[\p{L}\p{N}]")
    hexes = count_matching(s, f"[{HEX_CHARS}]")
    return [
        (f"lex_{tag}_digit_count", f"({digits})::DOUBLE"),
        (f"lex_{tag}_digit_ratio", ratio(digits, n)),
        (f"lex_{tag}_vowel_count", f"({vowels})::BIGINT"),
        (f"lex_{tag}_vowel_ratio", ratio(vowels, n)),
        (f"lex_{tag}_consonant_count", f"({cons})::BIGINT"),
        (f"lex_{tag}_consonant_ratio", ratio(cons, n)),
        (f"lex_{tag}_non_alphanum_count", f"({nonal})::BIGINT"),
        (f"lex_{tag}_non_alphanum_ratio", ratio(nonal, n)),
        (f"lex_{tag}_hex_count", f"({hexes})::BIGINT"),
        (f"lex_{tag}_hex_ratio", ratio(hexes, n)),
    ]


def lexical_select_list(d: str = "domain_name") -> list[tuple[str, str]]:
    """(column, expression) pairs; expects tmp_tld/sld/sub/stld/concat/lens columns."""
    tld, sld, concat, lens = "tmp_tld", "tmp_sld", "tmp_concat", "tmp_lens"
    w = SUFFIX_SCORE_WEIGHTS
    trusted = ends_with_any(d, WELL_KNOWN_SUFFIXES)
    wellknown = ends_with_any(d, TRUSTED_SUFFIXES)
    cdn, vps, img = (ends_with_any(d, CDN_SUFFIXES), ends_with_any(d, VPS_SUFFIXES),
                     ends_with_any(d, IMAGE_HOSTING_SUFFIXES))
    sldp = _part_features(sld, "sld")
    subp = _part_features(concat, "sub")
    stld_nodots = "replace(tmp_stld, '.', '')"

    def bucket(cond):
        return f"len(list_filter({lens}, lambda x: {cond}))::BIGINT"

    return [
        ("lex_name_len", f"length({d})::BIGINT"),
        ("lex_has_digit", f"(CASE WHEN regexp_matches({d}, '\\p{{Nd}}') THEN 1 ELSE 0 END)::BIGINT"),
        ("lex_phishing_keyword_count", keyword_count(d, PHISHING_KEYWORDS)),
        ("lex_benign_keyword_count", keyword_count(d, BENIGN_KEYWORDS)),
        ("lex_consecutive_chars", longest_run(d)),
        ("lex_tld_len", f"length({tld})::BIGINT"),
        ("lex_tld_abuse_score", tld_abuse(tld)),
        ("lex_tld_hash", simhash32(tld)),
        ("lex_sld_len", f"length({sld})::BIGINT"),
        ("lex_sld_norm_entropy", norm_entropy(sld)),
        *sldp[:2],
        ("lex_sld_phishing_keyword_count", keyword_count(sld, PHISHING_KEYWORDS)),
        *sldp[2:],
        ("lex_sub_count", count_subdomains("tmp_sub")),
        ("lex_stld_unique_char_count", f"len(list_distinct({chars(stld_nodots)}))::BIGINT"),
        ("lex_begins_with_digit", f"(CASE WHEN regexp_matches(left({d}, 1), '^\\p{{Nd}}') THEN 1 ELSE 0 END)::BIGINT"),
        ("lex_www_flag", f"(CASE WHEN string_split({d}, '.')[1] = 'www' THEN 1 ELSE 0 END)::BIGINT"),
        ("lex_sub_max_consonant_len", longest_consonant_run(concat)),
        ("lex_sub_norm_entropy", norm_entropy(concat)),
        *subp,
        ("lex_avg_part_len", f"list_sum({lens})::DOUBLE / len({lens})"),
        ("lex_stdev_part_lens", arr_stddev(lens)),
        ("lex_longest_part_len", f"list_max({lens})::BIGINT"),
        ("lex_short_part_count", bucket("x <= 3")),
        ("lex_medium_part_count", bucket("x >= 4 AND x <= 10")),
        ("lex_long_part_count", bucket("x >= 11 AND x <= 30")),
        ("lex_superlong_part_count", bucket("x >= 31")),
        ("lex_shortest_sub_len", f"length({concat})::BIGINT"),
        ("lex_ipv4_in_domain", f"(CASE WHEN regexp_matches({d}, {q(IPV4_DOTTED)}) OR regexp_matches({d}, "
                               f"{q(IPV4_DASHED)}) THEN 1 ELSE 0 END)::BIGINT"),
        ("lex_has_trusted_suffix", trusted),
        ("lex_has_wellknown_suffix", wellknown),
        ("lex_has_cdn_suffix", cdn),
        ("lex_has_vps_suffix", vps),
        ("lex_has_img_suffix", img),
        ("lex_suffix_score", f"({trusted} * {w['trusted']} + {wellknown} * {w['wellknown']} + {cdn} * {w['cdn']} "
                             f"+ {vps} * {w['vps']} + {img} * {w['img']})::BIGINT"),
    ]


def lexical_ctes(src: str, d: str = "domain_name") -> str:
    """CTEs ending in ``_lexin``: ``src`` rows plus the tmp_* helper columns."""
    return suffix_split_ctes(src, d) + f""",
_lexin AS (SELECT *, tmp_sld || '.' || tmp_tld AS tmp_stld,
             replace(CASE WHEN tmp_sub <> '' THEN tmp_sub || '.' || tmp_sld ELSE tmp_sld END, '.', '') AS tmp_concat,
             list_transform(string_split({d}, '.'), lambda p: length(p)) AS tmp_lens FROM _s3)"""


def rounded(sql: str, double_cols, digits: int = 6) -> str:
    """Round the named DOUBLE columns of a query (and turn -0.0 into 0.0)."""
    if not double_cols:
        return sql
    rep = ", ".join(f"round({c}, {digits}) + 0.0 AS {c}" for c in double_cols)
    return f"SELECT * REPLACE ({rep}) FROM ({sql}) AS _r"
