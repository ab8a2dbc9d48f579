"""TLS certificate-chain features (C1-C17): 24 ``tls_*`` columns, ``tls`` dropped.

The chain walk of the original (stop at the first certificate that is broken,
validity < 0 days, or expired at ``as_of``; only earlier certificates contribute,
the stopping one still counts in the divisor) becomes array expressions: one
flag per certificate, ``array_position`` of the first non-zero flag, ``slice``
of the walked prefix, then sizes / filters / folds over that prefix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import core as C

# Negotiated protocol and cipher ids (unknown -> 0; two ciphers share id 3).
TLS_VERSION_IDS = {"TLSv1.0": 0, "TLSv1.1": 1, "TLSv1.2": 2, "TLSv1.3": 3}
TLS_CIPHER_IDS = {
    "ECDHE-RSA-AES128-GCM-SHA256": 0, "TLS_AES_128_GCM_SHA256": 1, "TLS_AES_256_GCM_SHA384": 2,
    "ECDHE-ECDSA-CHACHA20-POLY1305": 3, "ECDHE-RSA-AES128-SHA": 3, "ECDHE-RSA-CHACHA20-POLY1305": 4,
    "ECDHE-RSA-AES256-GCM-SHA384": 5, "ECDHE-ECDSA-AES128-GCM-SHA256": 6, "TLS_CHACHA20_POLY1305_SHA256": 7,
    "ECDHE-ECDSA-AES256-GCM-SHA384": 8, "ECDHE-RSA-AES256-SHA384": 9, "AES128-SHA256": 10,
    "DHE-RSA-AES256-GCM-SHA384": 11, "AES256-SHA256": 12, "AES128-SHA": 13, "DHE-RSA-AES128-GCM-SHA256": 14,
}
# Extension names and values the walk looks at.
SAN, EKU, POLICIES, BASIC = "subjectAltName", "extendedKeyUsage", "certificatePolicies", "basicConstraints"
SERVER_AUTH, CLIENT_AUTH, CA_TRUE = "TLS Web Server Authentication", "TLS Web Client Authentication", "CA:TRUE"

TLS_COLUMNS = (
    "tls_has_tls", "tls_chain_len", "tls_is_self_signed", "tls_root_authority_hash", "tls_leaf_authority_hash",
    "tls_negotiated_version_id", "tls_negotiated_cipher_id", "tls_root_cert_validity_len",
    "tls_leaf_cert_validity_len", "tls_broken_chain", "tls_expired_chain", "tls_total_extension_count",
    "tls_critical_extensions", "tls_with_policies_crt_count", "tls_percentage_crt_with_policies",
    "tls_x509_anypolicy_crt_count", "tls_iso_policy_crt_count", "tls_joint_isoitu_policy_crt_count",
    "tls_subject_count", "tls_server_auth_crt_count", "tls_client_auth_crt_count", "tls_CA_certs_in_chain_ratio",
    "tls_unique_SLD_count", "tls_common_name_count",
)


def _map(d: dict) -> Column:
    return F.create_map(*[x for k, v in d.items() for x in (F.lit(k), F.lit(v))])


def validity_days(cert: Column) -> Column:
    """round(valid_len / 86400) half to even."""
    return F.bround(cert["valid_len"].cast("double") / 86400.0, 0).cast("long")


def days_to_expiry(cert: Column, as_of: Column) -> Column:
    return F.bround((F.unix_micros(cert["validity_end"]) - F.unix_micros(as_of)).cast("double") / 86400e6, 0)


def _last(arr: Column) -> Column:
    return F.try_element_at(arr, F.lit(-1))


def _ext_value(exts: Column, name: str) -> Column:
    """Value of the last extension called ``name`` (NULL when absent)."""
    return _last(F.filter(exts, lambda e: e["name"] == name))["value"]


def _count(arr: Column) -> Column:
    return F.size(arr).cast("long")


_HELPERS = ("_certs", "_flags", "_stop", "_seen", "_walked", "_stop_flag", "_leaf", "_root", "_exts", "_valued", "_san", "_names", "_policy_exts", "_policies")


def with_walk(df: DataFrame, as_of: Column) -> DataFrame:
    """The chain walk, evaluated once per record: every step is a column of a projection of its
    own, which the features then only refer to."""
    certs, walked = F.col("_certs"), F.col("_walked")
    df = df.withColumn("_certs", F.coalesce(F.col("tls.certificates"), F.array()))
    df = df.withColumn("_flags", F.transform(certs, lambda c: F.when(validity_days(c) < 0, F.lit(1))
                                             .when(days_to_expiry(c, as_of) < 0, F.lit(2)).otherwise(F.lit(0))))
    # 1-based place of the first broken or expired certificate, 0 = none
    df = df.withColumn("_stop", F.array_position(F.transform("_flags", lambda f: f > 0), True))
    df = df.withColumns({
        "_seen": F.when(F.col("_stop") > 0, F.col("_stop")).otherwise(F.size(certs)),  # visited, incl. the stopping one
        "_walked": F.when(F.col("_stop") > 0, F.slice(certs, F.lit(1), F.col("_stop").cast("int") - 1)).otherwise(certs),
        "_stop_flag": F.when(F.col("_stop") > 0, F.element_at("_flags", F.col("_stop").cast("int"))),
    })
    df = df.withColumns({
        "_leaf": F.try_element_at(walked, F.lit(1)),
        "_root": _last(F.filter(walked, lambda c: F.coalesce(c["is_root"], F.lit(False)))),
        "_exts": F.flatten(F.transform(walked, lambda c: F.coalesce(c["extensions"], F.array()))),
    })
    df = df.withColumn("_valued", F.filter("_exts", lambda e: e["value"].isNotNull()))
    df = df.withColumns({
        "_san": F.split(_last(F.filter("_valued", lambda e: e["name"] == SAN))["value"], ","),
        "_policy_exts": F.filter("_valued", lambda e: e["name"] == POLICIES),
    })
    return df.withColumns({
        "_names": F.transform(F.filter("_san", lambda x: x.contains("DNS:")), lambda x: F.split(F.element_at(F.split(x, "DNS:"), 2), r"\.")),
        "_policies": F.filter(F.flatten(F.transform("_policy_exts", lambda e: F.transform(
            F.split(e["value"], ","), lambda x: F.substring_index(x, "\n", 1)))), lambda x: x.startswith("Policy:")),
    })


def tls_columns() -> dict[str, Column]:
    """Features over the columns of ``with_walk``."""
    tls, certs, n_seen, walked, stop_flag = F.col("tls"), F.col("_certs"), F.col("_seen"), F.col("_walked"), F.col("_stop_flag")
    leaf, root, exts, with_value = F.col("_leaf"), F.col("_root"), F.col("_exts"), F.col("_valued")
    san_items, pol_exts, policies = F.col("_san"), F.col("_policy_exts"), F.col("_policies")
    san = san_items
    slds = F.transform(F.filter("_names", lambda p: F.size(p) >= 2), lambda p: F.element_at(p, -2))
    eku_items = F.flatten(F.transform(F.filter(with_value, lambda e: e["name"] == EKU),
                                      lambda e: F.split(e["value"], ", ")))
    x509 = F.filter(policies, lambda x: x.contains("X509v3"))
    iso = F.filter(policies, lambda x: ~x.contains("X509v3") & x.startswith("Policy: 1."))
    isoitu = F.filter(policies, lambda x: ~x.contains("X509v3") & ~x.startswith("Policy: 1.")
                      & x.startswith("Policy: 2."))
    ca = F.filter(exts, lambda e: (e["name"] == BASIC) & (e["value"] == CA_TRUE))
    leaf_exts = F.coalesce(leaf["extensions"], F.array())
    self_signed = F.when(leaf.isNull(), F.lit(0)).otherwise(
        _ext_value(leaf_exts, "authorityKeyIdentifier").eqNullSafe(_ext_value(leaf_exts, "subjectKeyIdentifier"))
        .cast("int"))
    org = lambda c: F.when(c.isNull(), F.lit("")).otherwise(F.coalesce(c["organization"], F.lit("")))
    policy_certs = _count(pol_exts)
    feats = {
        "tls_chain_len": tls["count"],
        "tls_is_self_signed": self_signed.cast("long"),
        "tls_root_authority_hash": C.md5_mod(org(root)),
        "tls_leaf_authority_hash": C.md5_mod(org(leaf)),
        "tls_negotiated_version_id": F.coalesce(F.try_element_at(_map(TLS_VERSION_IDS), tls["protocol"]),
                                                F.lit(0)).cast("long"),
        "tls_negotiated_cipher_id": F.coalesce(F.try_element_at(_map(TLS_CIPHER_IDS), tls["cipher"]),
                                               F.lit(0)).cast("long"),
        "tls_root_cert_validity_len": F.when(root.isNull(), F.lit(-1)).otherwise(validity_days(root)).cast("long"),
        "tls_leaf_cert_validity_len": F.when(leaf.isNull(), F.lit(-1)).otherwise(validity_days(leaf)).cast("long"),
        "tls_broken_chain": F.coalesce((stop_flag == 1).cast("long"), F.lit(0).cast("long")),
        "tls_expired_chain": F.coalesce((stop_flag == 2).cast("long"), F.lit(0).cast("long")),
        # both counters start at -1 in the original (kept)
        "tls_total_extension_count": _count(exts) - 1,
        "tls_critical_extensions": _count(F.filter(exts, lambda e: F.coalesce(e["critical"], F.lit(0)) != 0)) - 1,
        "tls_with_policies_crt_count": policy_certs,
        "tls_percentage_crt_with_policies": policy_certs.cast("double") / n_seen,
        "tls_x509_anypolicy_crt_count": _count(x509),
        "tls_iso_policy_crt_count": _count(iso),
        "tls_joint_isoitu_policy_crt_count": _count(isoitu),
        "tls_subject_count": F.when(san.isNull(), F.lit(0)).otherwise(F.size(san_items)).cast("long"),
        "tls_server_auth_crt_count": _count(F.filter(eku_items, lambda x: x == SERVER_AUTH)),
        "tls_client_auth_crt_count": _count(F.filter(eku_items, lambda x: x == CLIENT_AUTH)),
        "tls_CA_certs_in_chain_ratio": _count(ca).cast("double") / n_seen,
        "tls_unique_SLD_count": F.when(san.isNull(), F.lit(0)).otherwise(F.size(F.array_distinct(slds))).cast("long"),
        "tls_common_name_count": _count(F.filter(walked, lambda c: F.coalesce(F.char_length(c["common_name"]),
                                                                              F.lit(0)) > 0)),
    }
    has_certs = tls.isNotNull() & (F.size(certs) > 0)
    out = {"tls_has_tls": tls.isNotNull()}
    # no TLS -> every feature NULL; TLS without certificates -> NULL features (the original raised)
    out.update({k: F.when(has_certs, v) for k, v in feats.items()})
    return out


def encode_policy(oid: Column) -> Column:
    """int(oid without dots) mod (2**31 - 1), folded digit by digit (OIDs can exceed 64
    bits); NULL or '' -> 0."""
    digits = F.regexp_replace(oid, r"\.", "")
    folded = F.aggregate(C.chars(digits), F.lit(0).cast("long"),
                         lambda a, d: F.pmod(a * 10 + d.cast("long"), F.lit(C.HASH_MOD)))
    return F.when(F.coalesce(F.char_length(oid), F.lit(0)) == 0, F.lit(0).cast("long")).otherwise(folded)


def tls_extra_columns(as_of: Column) -> dict[str, Column]:
    """C16 (optional, off by default as in the original): root / leaf certificate lifetime
    at ``as_of`` in days (half-even), mean validity of the walked chain (one decimal),
    encoded ISO / joint ISO-ITU policy OIDs of the last such policy, unknown-policy count."""
    tls, certs, walked, leaf, root, pols = (F.col(c) for c in ("tls", "_certs", "_walked", "_leaf", "_root", "_policies"))

    def lifetime(c):
        return F.when(c.isNull(), F.lit(-1)).otherwise(F.bround(
            (F.unix_micros(as_of) - F.unix_micros(c["validity_start"])).cast("double") / 86400e6, 0)).cast("long")
    n = F.size(walked)
    total = F.aggregate(walked, F.lit(0).cast("long"), lambda a, c: a + validity_days(c))
    iso = F.filter(pols, lambda x: ~x.contains("X509v3") & x.startswith("Policy: 1."))
    isoitu = F.filter(pols, lambda x: ~x.contains("X509v3") & ~x.startswith("Policy: 1.")
                      & x.startswith("Policy: 2."))
    unknown = F.filter(pols, lambda x: ~x.contains("X509v3") & ~x.startswith("Policy: 1.")
                       & ~x.startswith("Policy: 2."))
    feats = {
        "tls_root_cert_lifetime": lifetime(root),
        "tls_leaf_cert_lifetime": lifetime(leaf),
        "tls_mean_certs_validity_len": F.when(n == 0, F.lit(-1.0)).otherwise(F.bround(total / n, 1)),
        "tls_iso_policy_oid": encode_policy(F.regexp_extract(_last(iso), r"1\.[0-9.]+", 0)),
        "tls_isoitu_policy_oid": encode_policy(F.regexp_extract(_last(isoitu), r"2\.[0-9.]+", 0)),
        "tls_unknown_policy_crt_count": F.size(unknown).cast("long"),
    }
    has_certs = tls.isNotNull() & (F.size(certs) > 0)
    return {k: F.when(has_certs, v) for k, v in feats.items()}


def tls_features(df: DataFrame, as_of: Column | None = None, extras: bool = False) -> DataFrame:
    """Replace ``tls`` by its features; ``as_of`` defaults to today's midnight (pass it for
    reproducible runs).  ``extras`` adds the optional C16 columns."""
    as_of = as_of if as_of is not None else C.midnight()
    cols = tls_columns()
    if extras:
        cols.update(tls_extra_columns(as_of))
    return with_walk(df, as_of).withColumns(cols).drop("tls", *_HELPERS)
