"""Catalog: nested-record feature families over records derived from the star tables
(D1-D13, I1-I6, P6 + G1-G9, C1-C17, R1-R8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.domain import load_suffix_rules
from ..operators import dns as DNS
from ..operators import geo as GEO
from ..operators import ip as IP
from ..operators import prep as P
from ..operators import rdap as RDAP
from ..operators import tls as TLS
from . import records_sql as RS
from .catalog import query
from .records import KEYS, as_of, star_records

_DNS_CTES, _DNS_COLS = RS.dns_sql()
_TLS_CTES, _TLS_COLS = RS.tls_sql()
_IP_COLS, _GEO_COLS, _RDAP_COLS = RS.ip_sql(), RS.geo_sql(), RS.rdap_sql()


def _out(df, cols):
    return df.select(*KEYS, "domain_name", *[c for c, _ in cols])


@query("D_dns_features", RS.select_sql(_DNS_CTES, "_s3m", _DNS_COLS))
def dns_features(spark, sf_dir):
    """DNS record counts, zone, DNSSEC score, TTL, SOA, MX and TXT features per record."""
    return _out(DNS.dns_features(star_records(spark, sf_dir), load_suffix_rules(spark)), _DNS_COLS)


@query("I_ip_features", RS.select_sql("", "rec", _IP_COLS))
def ip_features(spark, sf_dir):
    """IP count, RTT, address-family ratios, prefix and ASN entropies per record."""
    rec = star_records(spark, sf_dir)
    return _out(IP.ip_features(rec.withColumns(DNS.record_counts())), _IP_COLS)


@query("G_geo_features", RS.select_sql("", "rec", _GEO_COLS))
def geo_features(spark, sf_dir):
    """P6 + G1-G9: geo flatten, country / continent counts and hashes, coordinate statistics."""
    return _out(GEO.geo_features(GEO.flatten_geo(star_records(spark, sf_dir))), _GEO_COLS)


@query("C_tls_features", RS.select_sql(_TLS_CTES, "t7", _TLS_COLS))
def tls_features(spark, sf_dir):
    """Certificate-chain walk features per record (as of the binding's snapshot)."""
    return _out(TLS.tls_features(star_records(spark, sf_dir), as_of()), _TLS_COLS)


@query("R_rdap_features", RS.select_sql("", "rec", _RDAP_COLS))
def rdap_features(spark, sf_dir):
    """R1-R8 (+ P9 for the registration period): registration ages, entity and IP-RDAP features."""
    out = RDAP.rdap_features(star_records(spark, sf_dir), as_of())
    return P.cast_times(_out(out, _RDAP_COLS))


_X = "list_filter(_pols, lambda x: NOT contains(x, 'X509v3') AND starts_with(x, 'Policy: 1.'))"
_XI = ("list_filter(_pols, lambda x: NOT contains(x, 'X509v3') AND NOT starts_with(x, 'Policy: 1.') AND "
       "starts_with(x, 'Policy: 2.'))")
_XU = ("list_filter(_pols, lambda x: NOT contains(x, 'X509v3') AND NOT starts_with(x, 'Policy: 1.') AND "
       "NOT starts_with(x, 'Policy: 2.'))")


def _sql_encode(oid: str) -> str:
    return (f"(CASE WHEN coalesce(length({oid}), 0) = 0 THEN 0 ELSE "
            f"(replace({oid}, '.', '')::HUGEINT % 2147483647)::BIGINT END)")


def _sql_lifetime(c: str) -> str:
    return (f"(CASE WHEN {c} IS NULL THEN -1 ELSE round_even((epoch_us({RS.TS_AS_OF}) - "
            f"epoch_us({c}.validity_start)) / 86400e6, 0) END)::BIGINT")


_EXTRA = [
    ("tls_root_cert_lifetime", _sql_lifetime("_root")),
    ("tls_leaf_cert_lifetime", _sql_lifetime("_leaf")),
    ("tls_mean_certs_validity_len", "CASE WHEN len(_walked) = 0 THEN -1.0 ELSE round_even(list_sum(list_transform("
                                    "_walked, lambda c: round_even(c.valid_len / 86400.0, 0)))::DOUBLE / len(_walked), 1) END"),
    ("tls_iso_policy_oid", _sql_encode(f"regexp_extract({_X}[-1], '1\\.[0-9.]+', 0)")),
    ("tls_isoitu_policy_oid", _sql_encode(f"regexp_extract({_XI}[-1], '2\\.[0-9.]+', 0)")),
    ("tls_unknown_policy_crt_count", f"len({_XU})::BIGINT"),
]
_EXTRA_SQL = [(c, f"CASE WHEN (tls IS NOT NULL AND len(_certs) > 0) THEN {e} END") for c, e in _EXTRA]


@query("C16_tls_optional", RS.select_sql(_TLS_CTES, "t7", _EXTRA_SQL))
def tls_optional(spark, sf_dir):
    """The optional TLS columns (lifetimes, mean chain validity, encoded policy OIDs,
    unknown-policy count)."""
    out = TLS.tls_features(star_records(spark, sf_dir), as_of(), extras=True)
    return _out(out, _EXTRA)
