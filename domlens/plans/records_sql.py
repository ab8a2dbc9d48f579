"""DuckDB twin of ``records.star_records`` and of the nested feature families.

Used only to write ``oracle_sql()`` strings; every expression mirrors its Spark
counterpart in ``domlens.operators``.
"""

from __future__ import annotations

from ..operators.dns import TXT_VERIFIERS
from ..functions.countries import COUNTRY_IDS
from ..operators.geo import MALICIOUS_HOSTING_COUNTRY_IDS, continent_of
from ..operators.tls import TLS_CIPHER_IDS, TLS_VERSION_IDS
from . import oracle as O
from .records import AS_OF, CIPHERS, NATION_COUNTRIES

TS_AS_OF = f"TIMESTAMP '{AS_OF}'"
NL = "chr(10)"


def _ip4(x: str) -> str:
    return (f"(({x} % 200) + 10)::VARCHAR || '.' || (({x} // 200) % 256)::VARCHAR || '.' || "
            f"({x} % 7)::VARCHAR || '.' || ({x} % 251)::VARCHAR")


def _country(k: str) -> str:
    return f"list_extract({O.str_list(NATION_COUNTRIES)}, ({k})::INTEGER + 1)"


def _days(ts: str, d: str) -> str:
    return f"({ts} + to_days(({d})::INTEGER))"


def _v4_entry() -> str:
    # lambda (x, i): i is 1-based in DuckDB, k = i - 1
    k = "(i - 1)"
    net = "(split_part(x, '.', 1) || '.' || split_part(x, '.', 2) || '.0.0')"
    return f"""struct_pack(
      ip := x,
      remarks := struct_pack(average_rtt := (CASE WHEN l_linenumber = 6 THEN NULL
                                             ELSE l_discount * 1000 + {k} END)::DOUBLE),
      rdap := CASE WHEN {k} = 2 THEN NULL ELSE struct_pack(
          ip_version := 4::BIGINT,
          network := struct_pack(prefix_length := (CASE WHEN {k} = 1 AND l_linenumber = 2 THEN NULL
                                                   ELSE 16 + l_linenumber - {k} END)::BIGINT,
                                 network_address := {net}),
          entities := struct_pack(administrative := [struct_pack(name := s_name,
                        email := CASE WHEN {k} = 0 THEN _sup || '@example.net' END)])) END,
      asn := CASE WHEN p_size % 3 = 0 THEN NULL ELSE struct_pack(asn := (64500 + s_nationkey + {k})::BIGINT,
                        network_address := {net}, prefix_len := 16::BIGINT) END,
      geo := CASE WHEN {k} = 1 THEN NULL ELSE struct_pack(
                        country := {_country(f"CASE WHEN {k} = 0 THEN s_nationkey ELSE c_nationkey END")},
                        latitude := s_acctbal / 111.0, longitude := c_acctbal / 55.6) END)"""


def _v6_entry() -> str:
    return f"""struct_pack(ip := _aaaa, remarks := struct_pack(average_rtt := NULL::DOUBLE),
      rdap := struct_pack(ip_version := 6::BIGINT,
                          network := struct_pack(prefix_length := 48::BIGINT, network_address := '2001:db8::'),
                          entities := struct_pack(administrative := NULL::STRUCT(name VARCHAR, email VARCHAR)[])),
      asn := struct_pack(asn := 64999::BIGINT, network_address := '2001:0db8:0000:0000:0000:0000:0000:0000',
                         prefix_len := 32::BIGINT),
      geo := struct_pack(country := {_country('c_nationkey')}, latitude := c_acctbal / 111.0,
                         longitude := s_acctbal / 55.6))"""


def _ext(crit: str, name: str, value: str) -> str:
    return f"struct_pack(critical := ({crit})::BIGINT, name := {O.q(name)}, value := ({value})::VARCHAR)"


def _cert() -> str:
    leaf = "[" + ", ".join([
        _ext("0", "subjectAltName", "'DNS:' || domain_name || ',DNS:www.' || domain_name || ', DNS:' || _sup || '.net'"),
        _ext("0", "extendedKeyUsage", "CASE WHEN p_size % 2 = 0 THEN 'TLS Web Server Authentication, "
                                      "TLS Web Client Authentication' ELSE 'TLS Web Server Authentication' END"),
        _ext("0", "authorityKeyIdentifier", "'k' || (l_partkey % 3)::VARCHAR"),
        _ext("0", "subjectKeyIdentifier", "'k' || (l_suppkey % 3)::VARCHAR"),
        _ext("CASE WHEN l_linenumber % 2 = 0 THEN 1 ELSE 0 END", "certificatePolicies",
             f"'Policy: 2.23.140.1.2.1' || {NL} || '  CPS: http://x,Policy: 1.3.6.1.4.1.' || p_size::VARCHAR"),
    ]) + "]"
    mid = "[" + _ext("1", "basicConstraints", "'CA:TRUE'") + ", " + _ext(
        "0", "certificatePolicies", "CASE WHEN p_size % 2 = 1 THEN 'Policy: X509v3 Any Policy' END") + "]"
    root = "[" + _ext("1", "basicConstraints", "'CA:TRUE'") + "]"
    return f"""struct_pack(
      common_name := CASE WHEN i = 0 THEN domain_name WHEN i = 1 THEN 'Intermediate ' || p_brand ELSE '' END,
      organization := CASE WHEN i = 0 THEN s_name WHEN i = 1 THEN p_brand END,
      is_root := (i = _ncert - 1 AND _ncert > 1),
      valid_len := ((p_size * 10 - 30 + i * 100) * 86400 + l_linenumber * 43200)::BIGINT,
      validity_start := o_orderdate,
      validity_end := {_days('o_orderdate', 'p_size * 40 + i * 365')},
      extensions := CASE WHEN i = 0 THEN {leaf} WHEN i = 1 THEN {mid} ELSE {root} END)"""


RECORDS_SQL = f"""
_j AS (SELECT l.l_orderkey, l.l_partkey, l.l_suppkey, l.l_linenumber, l.l_quantity, l.l_discount, l.l_tax,
              l.l_returnflag, l.l_linestatus, l.l_shipdate, o.o_orderkey, o.o_custkey, o.o_orderdate,
              p.p_name, p.p_brand, p.p_type, p.p_size, s.s_name, s.s_nationkey, s.s_acctbal,
              c.c_name, c.c_nationkey, c.c_acctbal, c.c_mktsegment
       FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN part p ON l.l_partkey = p.p_partkey
       JOIN supplier s ON l.l_suppkey = s.s_suppkey JOIN customer c ON o.o_custkey = c.c_custkey),
_j2 AS (SELECT *, lower(replace(p_brand, '#', '')) AS _brand, lower(replace(s_name, '#', '-')) AS _sup,
               lower(replace(p_name, ' ', '-')) || '.' || lower(replace(p_brand, '#', '')) || '.com' AS domain_name,
               [{_ip4('l_partkey')}, {_ip4('l_suppkey')}, {_ip4('o_custkey')}][1:l_linenumber % 4] AS _a,
               '2001:db8:' || lower(hex(l_suppkey)) || '::' || (l_partkey % 100)::VARCHAR AS _aaaa,
               1 + l_linenumber % 3 AS _ncert FROM _j),
rec AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, domain_name,
  CASE WHEN l_returnflag = 'R' THEN 'phishing' ELSE 'benign' END AS label, lower(c_mktsegment) AS category,
  struct_pack(A := (l_linenumber % 3)::BIGINT, AAAA := 1::BIGINT, CNAME := NULL::BIGINT,
              MX := (CASE WHEN p_size % 2 = 0 THEN 1 ELSE 2 END)::BIGINT, NS := 1::BIGINT, SOA := 1::BIGINT,
              TXT := NULL::BIGINT) AS dns_dnssec,
  struct_pack(A := (l_quantity * 10)::BIGINT, AAAA := (CASE WHEN l_linenumber % 2 = 0 THEN p_size * 20 END)::BIGINT,
              CNAME := NULL::BIGINT, MX := (p_size * 15)::BIGINT, NS := 86400::BIGINT,
              SOA := (CASE WHEN l_linenumber = 3 THEN NULL ELSE 3600 END)::BIGINT,
              TXT := (CASE WHEN l_tax > 0.04 THEN 300 ELSE 100 END)::BIGINT) AS dns_ttls,
  struct_pack(spf := p_size % 2 = 0, dkim := p_size % 3 = 0,
              dmarc := CASE WHEN p_size % 5 = 0 THEN NULL ELSE TRUE END) AS dns_email_extras,
  CASE WHEN l_linenumber = 1 THEN NULL WHEN l_linenumber = 2 THEN domain_name
       WHEN l_linenumber = 3 THEN 'www.' || domain_name ELSE _brand || '.com' END AS dns_zone,
  CASE WHEN l_linenumber = 7 THEN NULL ELSE l_linenumber % 2 = 0 END AS dns_has_dnskey,
  l_tax > 0.02 AS dns_zone_dnskey_selfsign_ok,
  CASE WHEN l_linenumber = 5 THEN NULL ELSE _a END AS dns_A,
  CASE WHEN l_linenumber % 2 = 0 THEN [_aaaa] END AS dns_AAAA,
  ['ns1.' || _sup || '.net', 'ns2.' || _sup || '.net'] AS dns_NS,
  CASE WHEN p_size % 9 = 0 THEN NULL ELSE list_concat(string_split(p_name, ' '),
       CASE WHEN p_size % 5 = 0 THEN ['google-site-verification=' || l_partkey::VARCHAR, '']
            ELSE ['v=spf1 include:' || domain_name] END) END AS dns_TXT,
  CASE WHEN p_size % 4 = 0 THEN 'cdn.' || domain_name END AS dns_CNAME,
  CASE WHEN l_linenumber = 3 THEN NULL ELSE struct_pack(primary_ns := 'ns1.' || _sup || '.net',
       resp_mailbox_dname := 'hostmaster.' || domain_name, serial := o_orderkey::BIGINT,
       refresh := (3600 + p_size)::BIGINT, retry := 600::BIGINT, expire := 86400::BIGINT,
       min_ttl := l_quantity::BIGINT) END AS dns_SOA,
  struct_pack(primary_ns := 'ns.' || _brand || '.com', resp_mailbox_dname := 'admin.' || _brand || '.com',
              serial := 1::BIGINT, refresh := 7200::BIGINT, retry := 900::BIGINT, expire := 604800::BIGINT,
              min_ttl := 60::BIGINT) AS dns_zone_SOA,
  CASE WHEN p_size % 6 = 0 THEN NULL WHEN p_size % 6 = 1 THEN []::STRUCT(name VARCHAR, priority BIGINT)[]
       ELSE [struct_pack(name := lower(p_type) || '.' || domain_name, priority := p_size::BIGINT),
             struct_pack(name := CASE WHEN l_linenumber = 2 THEN domain_name ELSE 'mx.' || _brand || '.com' END,
                         priority := 10::BIGINT)] END AS dns_MX,
  o_orderdate AS rdap_registration_date,
  CASE WHEN p_size % 7 = 0 THEN NULL ELSE {_days('o_orderdate', 'p_size * 60')} END AS rdap_expiration_date,
  l_shipdate AS rdap_last_changed_date,
  CASE WHEN p_size % 4 = 0 THEN NULL ELSE l_linenumber % 2 = 1 END AS rdap_dnssec,
  struct_pack(
    registrant := CASE WHEN l_linenumber = 4 THEN NULL ELSE [struct_pack(name := c_name, email := NULL::VARCHAR)] END,
    registrar := [struct_pack(name := s_name, email := NULL::VARCHAR)],
    administrative := [struct_pack(name := c_name || ' admin',
        email := CASE WHEN p_size % 3 = 0 THEN NULL ELSE lower(replace(c_name, '#', '')) || '@example.com' END)]
  ) AS rdap_entities,
  CASE WHEN l_returnflag = 'N' AND l_linestatus = 'O' THEN NULL ELSE struct_pack(
    protocol := 'TLSv1.' || (l_linenumber % 4)::VARCHAR,
    cipher := list_extract({O.str_list(CIPHERS)}, p_size % 17 + 1),
    count := _ncert::BIGINT,
    certificates := CASE WHEN p_size = 1 THEN [] ELSE list_transform(range(0, _ncert), lambda i: {_cert()}) END)
  END AS tls,
  CASE WHEN l_linenumber = 5 THEN NULL ELSE list_concat(
    list_transform(coalesce(_a, []), lambda x, i: {_v4_entry()}),
    CASE WHEN l_linenumber % 2 = 0 THEN [{_v6_entry()}] ELSE [] END) END AS ip_data
FROM _j2)"""

KEY_COLS = "l_orderkey, l_linenumber, l_partkey, l_suppkey, domain_name"


# ---------------------------------------------------------------- shared SQL helpers
def nonnull(arr: str) -> str:
    return f"list_filter({arr}, lambda x: x IS NOT NULL)"


def arr_mean(arr: str, empty: str = "0.0") -> str:
    v = nonnull(arr)
    return f"(CASE WHEN {arr} IS NULL OR len({v}) = 0 THEN {empty} ELSE list_sum({v})::DOUBLE / len({v}) END)"


def arr_min(arr: str) -> str:
    return f"coalesce(list_min({nonnull(arr)})::DOUBLE, 0.0)"


def arr_max(arr: str) -> str:
    return f"coalesce(list_max({nonnull(arr)})::DOUBLE, 0.0)"


def arr_stddev(arr: str) -> str:
    v = nonnull(arr)
    return (f"(CASE WHEN {arr} IS NULL OR len({v}) <= 1 THEN 0.0 ELSE sqrt(list_sum(list_transform({v}, "
            f"lambda y: (y - list_sum({v})::DOUBLE / len({v})) * (y - list_sum({v})::DOUBLE / len({v})))) "
            f"/ len({v})) END)")


def digits(s: str) -> str:
    return O.count_matching(s, r"\p{Nd}") + "::BIGINT"


def case_map(expr: str, mapping: dict, default: str = "NULL") -> str:
    return f"(CASE {expr} " + " ".join(f"WHEN {O.q(k)} THEN {v}" for k, v in mapping.items()) + f" ELSE {default} END)"


# ---------------------------------------------------------------- DNS
DNS_TYPES = ("A", "AAAA", "CNAME", "MX", "NS", "SOA", "TXT")


def dns_sql(src: str = "rec"):
    counts = ", ".join(f"coalesce(len(dns_{t}), 0)::BIGINT AS dns_{t}_count" for t in ("A", "AAAA", "MX", "NS", "TXT"))
    ctes = f"""d0 AS (SELECT *, {counts}, (dns_SOA IS NOT NULL)::BIGINT AS dns_SOA_count,
                 (dns_CNAME IS NOT NULL)::BIGINT AS dns_CNAME_count, coalesce(dns_zone, '') AS _zone FROM {src}),
{O.suffix_split_ctes('d0', '_zone', '_zone_', 'z')},
d1 AS (SELECT *, CASE WHEN _zone = '' THEN 0 ELSE {O.count_subdomains('_zone_sub')} END AS dns_zone_level FROM _s3z),
d2 AS (SELECT *, CASE WHEN dns_SOA IS NULL AND dns_zone_level > 0 THEN dns_zone_SOA ELSE dns_SOA END AS _soa FROM d1),
d3 AS (SELECT *, _soa.primary_ns AS _ns, _soa.resp_mailbox_dname AS _mail FROM d2),
{O.suffix_split_ctes('d3', '_ns', '_ns_', 'n')},
{O.suffix_split_ctes('_s3n', '_mail', '_mail_', 'm')}"""
    sec_terms = ", ".join(f"CASE WHEN dns_{t}_count > 0 THEN CASE WHEN dns_dnssec.{t} = 1 THEN 1.0 ELSE -2.0 END END"
                          for t in DNS_TYPES)
    sec_vals = f"list_filter([{sec_terms}], lambda x: x IS NOT NULL)"
    has_key = "coalesce(dns_has_dnskey::INTEGER, 0)"
    score = (f"CASE WHEN {has_key} = 0 THEN 0.0 WHEN NOT coalesce(dns_zone_dnskey_selfsign_ok, false) THEN -2.0 "
             f"WHEN dns_dnssec IS NULL THEN 0.0 WHEN len({sec_vals}) = 0 THEN 0.0 "
             f"ELSE list_sum({sec_vals}) / len({sec_vals}) END")
    ttl = "list_filter([" + ", ".join(f"dns_ttls.{t}" for t in DNS_TYPES) + "], lambda x: x IS NOT NULL)"
    empty = f"(dns_ttls IS NULL OR len({ttl}) = 0)"
    res = " + ".join(f"(dns_{t} IS NOT NULL)::BIGINT" for t in DNS_TYPES)

    def name_feats(prefix, col, sub):
        return [
            (f"{prefix}_level", f"CASE WHEN _soa IS NOT NULL THEN {O.count_subdomains(sub)} END"),
            (f"{prefix}_digit_count", f"CASE WHEN _soa IS NOT NULL THEN {digits(col)} END"),
            (f"{prefix}_len", f"CASE WHEN _soa IS NOT NULL THEN length({col})::BIGINT END"),
            (f"{prefix}_entropy", f"CASE WHEN _soa IS NOT NULL THEN {O.norm_entropy(col)} END"),
        ]
    ne = "list_filter(dns_TXT, lambda r: length(r) > 0)"
    ent_sum = f"coalesce(list_sum(list_transform({ne}, lambda r: {O.norm_entropy('r')})), 0.0)"
    hits = " + ".join(f"(CASE WHEN contains(lower(r), {O.q(v)}) THEN 1 ELSE 0 END)" for v in TXT_VERIFIERS)
    cols = [
        *[(f"dns_{t}_count", f"dns_{t}_count") for t in ("A", "AAAA", "MX", "NS", "TXT", "SOA", "CNAME")],
        ("dns_zone_level", "dns_zone_level::BIGINT"),
        ("dns_zone_digit_count", digits("_zone")),
        ("dns_zone_len", "length(_zone)::BIGINT"),
        ("dns_zone_entropy", O.norm_entropy("_zone")),
        ("dns_resolved_record_types", f"({res})::BIGINT"),
        ("dns_has_dnskey", f"{has_key}::BIGINT"),
        ("dns_dnssec_score", score),
        ("dns_ttl_avg", f"CASE WHEN NOT {empty} THEN list_sum({ttl})::DOUBLE / len({ttl}) END"),
        ("dns_ttl_stdev", f"CASE WHEN NOT {empty} THEN {arr_stddev(ttl)} END"),
        ("dns_ttl_low", f"CASE WHEN NOT {empty} THEN len(list_filter({ttl}, lambda x: x < 101))::DOUBLE / len({ttl}) END"),
        ("dns_ttl_mid", f"CASE WHEN NOT {empty} THEN len(list_filter({ttl}, lambda x: x >= 101 AND x < 501))::DOUBLE "
                        f"/ len({ttl}) END"),
        ("dns_ttl_distinct_count", f"CASE WHEN NOT {empty} THEN len(list_distinct({ttl}))::BIGINT END"),
        *name_feats("dns_soa_primary_ns", "_ns", "_ns_sub"),
        *name_feats("dns_soa_email", "_mail", "_mail_sub"),
        ("dns_soa_refresh", "_soa.refresh"), ("dns_soa_retry", "_soa.retry"),
        ("dns_soa_expire", "_soa.expire"), ("dns_soa_min_ttl", "_soa.min_ttl"),
        ("dns_domain_name_in_mx", "coalesce(len(list_filter(dns_MX, lambda m: m.name = domain_name)) > 0, false)"),
        ("dns_mx_avg_len", "CASE WHEN len(dns_MX) > 0 THEN list_sum(list_transform(dns_MX, lambda m: "
                           "length(m.name)))::DOUBLE / len(dns_MX) END"),
        ("dns_mx_avg_entropy", f"CASE WHEN len(dns_MX) > 0 THEN list_sum(list_transform(dns_MX, lambda m: "
                               f"{O.norm_entropy('m.name')})) / len(dns_MX) END"),
        ("dns_txt_avg_len", f"CASE WHEN dns_TXT IS NULL THEN NULL WHEN len(dns_TXT) > 0 THEN coalesce(list_sum("
                            f"list_transform({ne}, lambda r: length(r))), 0)::DOUBLE / len(dns_TXT) ELSE 0.0 END"),
        ("dns_txt_avg_entropy", f"CASE WHEN dns_TXT IS NOT NULL AND {ent_sum} > 0 THEN {ent_sum} / len({ne}) END"),
        ("dns_txt_external_verification_score",
         f"coalesce(list_sum(list_transform({ne}, lambda r: {hits})), 0)::BIGINT"),
        ("dns_txt_spf_exists", "coalesce(dns_email_extras.spf::BIGINT, 0)"),
        ("dns_txt_dkim_exists", "coalesce(dns_email_extras.dkim::BIGINT, 0)"),
        ("dns_txt_dmarc_exists", "coalesce(dns_email_extras.dmarc::BIGINT, 0)"),
    ]
    return ctes, cols


# ---------------------------------------------------------------- IP
def _hextets(part: str) -> str:
    return (f"flatten(list_transform(CASE WHEN {part} = '' THEN []::VARCHAR[] ELSE string_split({part}, ':') END, "
            f"lambda p: CASE WHEN contains(p, '.') THEN [lower(hex(split_part(p, '.', 1)::INTEGER * 256 + "
            f"split_part(p, '.', 2)::INTEGER)), lower(hex(split_part(p, '.', 3)::INTEGER * 256 + "
            f"split_part(p, '.', 4)::INTEGER))] ELSE [p] END))")


def ipv6_hextets(ip: str) -> str:
    left = _hextets(f"(CASE WHEN contains({ip}, '::') THEN split_part({ip}, '::', 1) ELSE {ip} END)")
    right = _hextets(f"(CASE WHEN contains({ip}, '::') THEN split_part({ip}, '::', 2) ELSE '' END)")
    fill = f"list_transform(range(greatest(8 - len({left}) - len({right}), 0)), lambda z: '0')"
    return f"list_transform(list_concat(list_concat({left}, {fill}), {right}), lambda h: lpad(lower(h), 4, '0'))"


def ipv4_value(ip: str) -> str:
    return (f"(split_part({ip}, '.', 1)::BIGINT * 16777216 + split_part({ip}, '.', 2)::BIGINT * 65536 + "
            f"split_part({ip}, '.', 3)::BIGINT * 256 + split_part({ip}, '.', 4)::BIGINT)")


def ip_sql() -> list[tuple[str, str]]:
    ips = "list_transform(ip_data, lambda e: e.ip)"
    v4p = (f"list_transform(list_filter({ips}, lambda q: NOT contains(q, ':')), lambda q: "
           f"split_part(q, '.', 1)::BIGINT * 256 + split_part(q, '.', 2)::BIGINT)")
    v6p = (f"list_transform(list_filter({ips}, lambda q: contains(q, ':')), lambda q: "
           f"array_to_string({ipv6_hextets('q')}[1:4], ':'))")
    asn = "list_transform(list_filter(ip_data, lambda e: e.asn IS NOT NULL), lambda e: e.asn)"
    nets = f"list_transform({asn}, lambda a: a.network_address)"
    v4n = f"list_transform(list_filter({nets}, lambda q: NOT contains(q, ':')), lambda q: {ipv4_value('q')})"
    v6n = f"list_transform(list_filter({nets}, lambda q: contains(q, ':')), lambda q: array_to_string({ipv6_hextets('q')}, ':'))"
    nums = f"list_transform({asn}, lambda a: a.asn)"
    ok = f"(ip_data IS NOT NULL AND len({asn}) > 0)"
    rtts = "list_transform(ip_data, lambda e: e.remarks.average_rtt)"
    cnt = "coalesce(len(ip_data), 0)::BIGINT"
    a, aaaa = "coalesce(len(dns_A), 0)", "coalesce(len(dns_AAAA), 0)"
    return [
        ("ip_count", cnt),
        ("ip_mean_average_rtt", f"CASE WHEN ip_data IS NULL THEN 0.0 ELSE {arr_mean(rtts, '-1.0')} END"),
        ("ip_v4_ratio", O.ratio(a, f"{a} + {aaaa}")),
        ("ip_a_aaaa_to_all_ratio", O.ratio(f"{a} + {aaaa}", cnt)),
        ("ip_entropy", f"CASE WHEN ip_data IS NULL THEN 0.0 ELSE {O.value_entropy(v4p)} + {O.value_entropy(v6p)} END"),
        ("ip_as_address_entropy", f"CASE WHEN {ok} THEN {O.value_entropy(v4n)} + {O.value_entropy(v6n)} END"),
        ("ip_asn_entropy", f"CASE WHEN {ok} THEN {O.value_entropy(nums)} END"),
        ("ip_distinct_as_count", f"CASE WHEN {ok} THEN len(list_distinct({nums}))::BIGINT END"),
    ]


# ---------------------------------------------------------------- geo
def geo_sql() -> list[tuple[str, str]]:
    kept = "list_filter(ip_data, lambda e: e.geo IS NOT NULL)"
    countries = f"list_transform({kept}, lambda e: e.geo.country)"
    lats = f"list_transform({kept}, lambda e: e.geo.latitude)"
    lons = f"list_transform({kept}, lambda e: e.geo.longitude)"
    none = f"(ip_data IS NULL OR len({countries}) = 0)"
    cont = f"list_distinct(list_transform({countries}, lambda c: {case_map('c', continent_of(), '0')}))"
    known = f"list_transform({countries}, lambda c: {case_map('c', COUNTRY_IDS)})"
    ids = f"list_sort(list_distinct(list_transform({countries}, lambda c: {case_map('c', COUNTRY_IDS, '300')})))"
    limit = len(COUNTRY_IDS)
    p = 2147483647
    step = (f"CASE WHEN acc.o OR acc.h + x > {limit} THEN struct_pack(o := true, h := ((acc.h + x) * 2) % {p}) "
            f"ELSE struct_pack(o := false, h := acc.h + x) END")
    chash = f"list_reduce({ids}, lambda acc, x: {step}, struct_pack(o := false, h := 0::BIGINT)).h % {p}"
    mal = ", ".join(str(i) for i in MALICIOUS_HOSTING_COUNTRY_IDS)
    mn_la, mx_la, mn_lo, mx_lo = arr_min(lats), arr_max(lats), arr_min(lons), arr_max(lons)
    return [
        ("geo_countries_count", f"coalesce(len(list_distinct({countries})), 0)::BIGINT"),
        ("geo_continents_count", f"(CASE WHEN {none} THEN 0 ELSE len({cont}) END)::BIGINT"),
        ("geo_malic_host_country", f"(CASE WHEN {none} THEN 0 ELSE (len(list_filter({known}, lambda i: i IN ({mal}))) "
                                   f"> 0)::INTEGER END)::BIGINT"),
        ("geo_lat_stdev", arr_stddev(lats)), ("geo_lon_stdev", arr_stddev(lons)),
        ("geo_mean_lat", arr_mean(lats)), ("geo_mean_lon", arr_mean(lons)),
        ("geo_min_lat", mn_la), ("geo_max_lat", mx_la), ("geo_min_lon", mn_lo), ("geo_max_lon", mx_lo),
        ("geo_lat_range", f"{mx_la} - {mn_la}"), ("geo_lon_range", f"{mx_lo} - {mn_lo}"),
        ("geo_centroid_lat", f"{mn_la} + {mx_la} / 2"), ("geo_centroid_lon", f"{mn_lo} + {mx_lo} / 2"),
        ("geo_estimated_area", f"({mx_la} - {mn_la}) * ({mx_lo} - {mn_lo})"),
        ("geo_continent_hash", f"(CASE WHEN {none} THEN 0 ELSE list_sum({cont}) % {p} END)::BIGINT"),
        ("geo_countries_hash", f"(CASE WHEN {none} THEN 0 ELSE {chash} END)::BIGINT"),
    ]


# ---------------------------------------------------------------- TLS
def tls_sql(src: str = "rec") -> tuple[str, list[tuple[str, str]]]:
    vdays = "round_even(c.valid_len / 86400.0, 0)"
    expiry = f"round_even((epoch_us(c.validity_end) - epoch_us({TS_AS_OF})) / 86400e6, 0)"
    cte = f"""t0 AS (SELECT *, coalesce(tls.certificates, []) AS _certs FROM {src}),
t1 AS (SELECT *, list_transform(_certs, lambda c: CASE WHEN {vdays} < 0 THEN 1 WHEN {expiry} < 0 THEN 2 ELSE 0 END)
                   AS _flags FROM t0),
t2 AS (SELECT *, coalesce(list_position(list_transform(_flags, lambda f: f > 0), true), 0) AS _stop FROM t1),
t3 AS (SELECT *, CASE WHEN _stop > 0 THEN _stop ELSE len(_certs) END AS _nseen,
              CASE WHEN _stop > 0 THEN _certs[1:_stop - 1] ELSE _certs END AS _walked,
              CASE WHEN _stop > 0 THEN _flags[_stop] END AS _stopflag FROM t2),
t4 AS (SELECT *, _walked[1] AS _leaf, list_filter(_walked, lambda c: coalesce(c.is_root, false))[-1] AS _root,
              flatten(list_transform(_walked, lambda c: coalesce(c.extensions, []))) AS _exts FROM t3),
t5 AS (SELECT *, list_filter(_exts, lambda e: e.value IS NOT NULL) AS _wv,
              coalesce(_leaf.extensions, []) AS _lx FROM t4),
t6 AS (SELECT *, list_filter(_wv, lambda e: e.name = 'subjectAltName')[-1].value AS _san,
              flatten(list_transform(list_filter(_wv, lambda e: e.name = 'extendedKeyUsage'),
                                     lambda e: string_split(e.value, ', '))) AS _eku,
              list_filter(_wv, lambda e: e.name = 'certificatePolicies') AS _pol FROM t5),
t7 AS (SELECT *, list_filter(flatten(list_transform(_pol, lambda e: list_transform(string_split(e.value, ','),
                   lambda x: split_part(x, {NL}, 1)))), lambda x: starts_with(x, 'Policy:')) AS _pols FROM t6)"""
    has = "(tls IS NOT NULL AND len(_certs) > 0)"
    items = "string_split(_san, ',')"
    slds = (f"list_transform(list_filter(list_transform(list_filter({items}, lambda x: contains(x, 'DNS:')), "
            f"lambda x: string_split(split_part(x, 'DNS:', 2), '.')), lambda q: len(q) >= 2), lambda q: q[-2])")
    org = "coalesce({c}.organization, '')"
    aki = "list_filter(_lx, lambda e: e.name = 'authorityKeyIdentifier')[-1].value"
    ski = "list_filter(_lx, lambda e: e.name = 'subjectKeyIdentifier')[-1].value"

    def when(x):
        return f"CASE WHEN {has} THEN {x} END"
    cols = [
        ("tls_has_tls", "tls IS NOT NULL"),
        ("tls_chain_len", when("tls.count")),
        ("tls_is_self_signed", when(f"(CASE WHEN _leaf IS NULL THEN 0 ELSE ({aki} IS NOT DISTINCT FROM {ski})::INTEGER "
                                    f"END)::BIGINT")),
        ("tls_root_authority_hash", when(O.md5_mod(f"CASE WHEN _root IS NULL THEN '' ELSE {org.format(c='_root')} END"))),
        ("tls_leaf_authority_hash", when(O.md5_mod(f"CASE WHEN _leaf IS NULL THEN '' ELSE {org.format(c='_leaf')} END"))),
        ("tls_negotiated_version_id", when(f"{case_map('tls.protocol', TLS_VERSION_IDS, '0')}::BIGINT")),
        ("tls_negotiated_cipher_id", when(f"{case_map('tls.cipher', TLS_CIPHER_IDS, '0')}::BIGINT")),
        ("tls_root_cert_validity_len", when("(CASE WHEN _root IS NULL THEN -1 ELSE "
                                            "round_even(_root.valid_len / 86400.0, 0) END)::BIGINT")),
        ("tls_leaf_cert_validity_len", when("(CASE WHEN _leaf IS NULL THEN -1 ELSE "
                                            "round_even(_leaf.valid_len / 86400.0, 0) END)::BIGINT")),
        ("tls_broken_chain", when("coalesce((_stopflag = 1)::BIGINT, 0)")),
        ("tls_expired_chain", when("coalesce((_stopflag = 2)::BIGINT, 0)")),
        ("tls_total_extension_count", when("(len(_exts) - 1)::BIGINT")),
        ("tls_critical_extensions", when("(len(list_filter(_exts, lambda e: coalesce(e.critical, 0) <> 0)) - 1)::BIGINT")),
        ("tls_with_policies_crt_count", when("len(_pol)::BIGINT")),
        ("tls_percentage_crt_with_policies", when("len(_pol)::DOUBLE / _nseen")),
        ("tls_x509_anypolicy_crt_count", when("len(list_filter(_pols, lambda x: contains(x, 'X509v3')))::BIGINT")),
        ("tls_iso_policy_crt_count", when("len(list_filter(_pols, lambda x: NOT contains(x, 'X509v3') AND "
                                          "starts_with(x, 'Policy: 1.')))::BIGINT")),
        ("tls_joint_isoitu_policy_crt_count", when("len(list_filter(_pols, lambda x: NOT contains(x, 'X509v3') AND "
                                                   "NOT starts_with(x, 'Policy: 1.') AND "
                                                   "starts_with(x, 'Policy: 2.')))::BIGINT")),
        ("tls_subject_count", when(f"(CASE WHEN _san IS NULL THEN 0 ELSE len({items}) END)::BIGINT")),
        ("tls_server_auth_crt_count", when("len(list_filter(_eku, lambda x: x = 'TLS Web Server Authentication'))::BIGINT")),
        ("tls_client_auth_crt_count", when("len(list_filter(_eku, lambda x: x = 'TLS Web Client Authentication'))::BIGINT")),
        ("tls_CA_certs_in_chain_ratio", when("len(list_filter(_exts, lambda e: e.name = 'basicConstraints' AND "
                                             "e.value = 'CA:TRUE'))::DOUBLE / _nseen")),
        ("tls_unique_SLD_count", when(f"(CASE WHEN _san IS NULL THEN 0 ELSE len(list_distinct({slds})) END)::BIGINT")),
        ("tls_common_name_count", when("len(list_filter(_walked, lambda c: coalesce(length(c.common_name), 0) > 0))"
                                       "::BIGINT")),
    ]
    return cte, cols


# ---------------------------------------------------------------- RDAP
def rdap_sql() -> list[tuple[str, str]]:
    ent = "rdap_entities"
    registrar, registrant = f"{ent}.registrar[1].name", f"{ent}.registrant[1].name"
    admin_name, admin_email = f"{ent}.administrative[1].name", f"{ent}.administrative[1].email"

    def ent0(s):
        return f"(CASE WHEN {s} IS NULL THEN 0.0 ELSE {O.norm_entropy(s)} END)"

    def len0(s):
        return f"coalesce(length({s}), 0)::BIGINT"
    ipd = "coalesce(ip_data, [])"
    rd = f"list_filter(list_transform({ipd}, lambda e: e.rdap), lambda r: r IS NOT NULL)"
    ver = f"list_filter({rd}, lambda r: r.ip_version IS NOT NULL)"
    wp = f"list_filter({ver}, lambda r: r.network.prefix_length IS NOT NULL)"

    def fold(cond):
        pre = f"list_transform(list_filter({wp}, lambda r: {cond}), lambda r: r.network.prefix_length)"
        step = ("struct_pack(s := CASE WHEN p < (CASE WHEN acc.s = 0 THEN p ELSE acc.s END) THEN p "
                "ELSE (CASE WHEN acc.s = 0 THEN p ELSE acc.s END) END, "
                "l := CASE WHEN p > (CASE WHEN acc.l = 0 THEN p ELSE acc.l END) THEN p "
                "ELSE (CASE WHEN acc.l = 0 THEN p ELSE acc.l END) END)")
        return f"list_reduce({pre}, lambda acc, p: {step}, struct_pack(s := 0::BIGINT, l := 0::BIGINT))"
    admins = f"list_transform({rd}, lambda r: r.entities.administrative[1])"
    names = f"list_filter(list_transform({admins}, lambda a: a.name), lambda x: x IS NOT NULL)"
    emails = f"list_filter(list_transform({admins}, lambda a: a.email), lambda x: x IS NOT NULL)"
    n = f"len({ipd})"

    def avg(arr, f):
        return f"(CASE WHEN {n} > 0 THEN coalesce(list_sum(list_transform({arr}, lambda w: {f('w')})), 0.0) / {n} ELSE 0.0 END)"
    exp, reg = "rdap_expiration_date", "rdap_registration_date"
    return [
        ("rdap_registration_period", f"(epoch_us({exp}) - epoch_us({reg})) / 1e6"),
        ("rdap_domain_age", f"(epoch_us({TS_AS_OF}) - epoch_us({reg}))::DOUBLE / 86400e6"),
        ("rdap_time_from_last_change", f"(epoch_us({TS_AS_OF}) - epoch_us(rdap_last_changed_date))::DOUBLE / 86400e6"),
        ("rdap_domain_active_time", f"(epoch_us(CASE WHEN {exp} IS NULL OR {TS_AS_OF} < {exp} THEN {TS_AS_OF} "
                                    f"ELSE {exp} END) - epoch_us({reg}))::DOUBLE / 86400e6"),
        ("rdap_has_dnssec", "coalesce(rdap_dnssec, false)"),
        ("rdap_registrar_name_len", len0(registrar)),
        ("rdap_registrar_name_entropy", ent0(registrar)),
        ("rdap_registrar_name_hash", f"(CASE WHEN {registrar} IS NULL THEN 0 ELSE {O.simhash32(registrar)} END)::BIGINT"),
        ("rdap_registrant_name_len", len0(registrant)),
        ("rdap_registrant_name_entropy", ent0(registrant)),
        ("rdap_admin_name_len", len0(admin_name)),
        ("rdap_admin_name_entropy", ent0(admin_name)),
        ("rdap_admin_email_len", len0(admin_email)),
        ("rdap_admin_email_entropy", f"CASE WHEN {admin_email} IS NOT NULL THEN {O.norm_entropy(admin_email)} "
                                     f"ELSE {ent0(registrant)} END"),
        ("rdap_ip_v4_count", f"len(list_filter({ver}, lambda r: r.ip_version = 4))::BIGINT"),
        ("rdap_ip_v6_count", f"len(list_filter({ver}, lambda r: r.ip_version <> 4))::BIGINT"),
        ("rdap_ip_shortest_v4_prefix_len", f"{fold('r.ip_version = 4')}.s"),
        ("rdap_ip_longest_v4_prefix_len", f"{fold('r.ip_version = 4')}.l"),
        ("rdap_ip_shortest_v6_prefix_len", f"{fold('r.ip_version <> 4')}.s"),
        ("rdap_ip_longest_v6_prefix_len", f"{fold('r.ip_version <> 4')}.l"),
        ("rdap_ip_avg_admin_name_len", avg(names, lambda w: f"length({w})::DOUBLE")),
        ("rdap_ip_avg_admin_name_entropy", avg(names, O.norm_entropy)),
        ("rdap_ip_avg_admin_email_len", avg(emails, lambda w: f"length({w})::DOUBLE")),
        ("rdap_ip_avg_admin_email_entropy", avg(emails, O.norm_entropy)),
    ]


def select_sql(ctes: str, src: str, cols: list[tuple[str, str]]) -> str:
    body = ", ".join(f"{e} AS {c}" for c, e in cols)
    return f"WITH {RECORDS_SQL}{', ' + ctes if ctes else ''}\nSELECT {KEY_COLS}, {body} FROM {src}"
