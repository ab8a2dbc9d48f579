"""Nested domain records derived from the star-schema test tables.

One record per ``lineitem`` row, joined to its order, part, supplier and
customer (many-to-one joins, no grouping), shaped like the projected domain
record of ``domlens.schema``: DNS arrays and structs, IP entries with RDAP / ASN
/ geo data, a TLS chain and RDAP dates and entities.  Every value is a
deterministic function of the joined row, so the work grows with ``lineitem``.
The same derivation is written for DuckDB in ``records_sql.py``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.tls import TLS_CIPHER_IDS
from .bindings import table

# Fixed values (binding): real country names for nation keys 0..24, and the snapshot time.
NATION_COUNTRIES = ["Algeria", "Argentina", "Brazil", "Canada", "Egypt", "Ethiopia", "France", "Germany", "India",
                    "Indonesia", "Iran", "Iraq", "Japan", "Jordan", "Kenya", "Morocco", "Mozambique", "Peru",
                    "China", "Romania", "Saudi Arabia", "Vietnam", "Russia", "United Kingdom", "United States"]
AS_OF = "1998-07-01 00:00:00"
CIPHERS = list(TLS_CIPHER_IDS) + ["UNKNOWN-CIPHER"]

KEYS = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def as_of() -> Column:
    return F.lit(AS_OF).cast("timestamp")


def _c(name: str) -> Column:
    return F.col(name)


def _ip4(x: Column) -> Column:
    return F.concat_ws(".", (x % 200 + 10).cast("string"), ((x / 200).cast("long") % 256).cast("string"),
                       (x % 7).cast("string"), (x % 251).cast("string"))


def _country(key: Column) -> Column:
    return F.element_at(F.array(*[F.lit(c) for c in NATION_COUNTRIES]), key.cast("int") + 1)


def _days(ts: Column, days: Column) -> Column:
    return ts + F.make_dt_interval(days.cast("int"))


def joined(spark, sf_dir) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount", "l_tax",
        "l_returnflag", "l_linestatus", F.col("l_shipdate").cast("timestamp").alias("l_shipdate"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey",
                                              F.col("o_orderdate").cast("timestamp").alias("o_orderdate"))
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey", "s_acctbal")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
    # an order gets its customer first: once tables are too large to broadcast, that shuffles orders and not all lines.
    # A join's size is unknown when the next one is planned, so that small lines would be broadcast to the orders and all
    # features be made in as many tasks as orders have files; merged, both sides are dealt by the order over all cores
    oc = o.join(c, o.o_custkey == c.c_custkey).hint("merge")
    return (li.join(oc, li.l_orderkey == oc.o_orderkey)
            .join(p, li.l_partkey == p.p_partkey)
            .join(s, li.l_suppkey == s.s_suppkey))


def _v4_entry(x: Column, k: Column) -> Column:
    ln, sz = _c("l_linenumber"), _c("p_size")
    net = F.concat(F.substring_index(x, ".", 2), F.lit(".0.0"))
    rdap = F.when(k == 2, F.lit(None)).otherwise(F.struct(
        F.lit(4).cast("long").alias("ip_version"),
        F.struct(F.when((k == 1) & (ln == 2), F.lit(None)).otherwise(16 + ln - k).cast("long").alias("prefix_length"),
                 net.alias("network_address")).alias("network"),
        F.struct(F.array(F.struct(_c("s_name").alias("name"),
                                  F.when(k == 0, F.concat(_c("_sup"), F.lit("@example.net"))).alias("email")))
                 .alias("administrative")).alias("entities")))
    asn = F.when(sz % 3 == 0, F.lit(None)).otherwise(F.struct(
        (64500 + _c("s_nationkey") + k).cast("long").alias("asn"), net.alias("network_address"),
        F.lit(16).cast("long").alias("prefix_len")))
    geo = F.when(k == 1, F.lit(None)).otherwise(F.struct(
        _country(F.when(k == 0, _c("s_nationkey")).otherwise(_c("c_nationkey"))).alias("country"),
        (_c("s_acctbal") / 111.0).alias("latitude"), (_c("c_acctbal") / 55.6).alias("longitude")))
    return F.struct(x.alias("ip"),
                    F.struct(F.when(ln == 6, F.lit(None)).otherwise(_c("l_discount") * 1000 + k)
                             .cast("double").alias("average_rtt")).alias("remarks"),
                    rdap.alias("rdap"), asn.alias("asn"), geo.alias("geo"))


def _v6_entry(x: Column) -> Column:
    return F.struct(
        x.alias("ip"), F.struct(F.lit(None).cast("double").alias("average_rtt")).alias("remarks"),
        F.struct(F.lit(6).cast("long").alias("ip_version"),
                 F.struct(F.lit(48).cast("long").alias("prefix_length"),
                          F.lit("2001:db8::").alias("network_address")).alias("network"),
                 F.struct(F.lit(None).cast("array<struct<name:string,email:string>>").alias("administrative"))
                 .alias("entities")).alias("rdap"),
        F.struct(F.lit(64999).cast("long").alias("asn"),
                 F.lit("2001:0db8:0000:0000:0000:0000:0000:0000").alias("network_address"),
                 F.lit(32).cast("long").alias("prefix_len")).alias("asn"),
        F.struct(_country(_c("c_nationkey")).alias("country"), (_c("c_acctbal") / 111.0).alias("latitude"),
                 (_c("s_acctbal") / 55.6).alias("longitude")).alias("geo"))


def _ext(critical, name, value) -> Column:
    return F.struct(F.lit(critical).cast("long").alias("critical") if not isinstance(critical, Column)
                    else critical.cast("long").alias("critical"),
                    F.lit(name).alias("name"), value.cast("string").alias("value"))


def _cert(i: Column, n: Column) -> Column:
    ln, sz, dom, sup = _c("l_linenumber"), _c("p_size"), _c("domain_name"), _c("_sup")
    leaf_exts = F.array(
        _ext(0, "subjectAltName", F.concat(F.lit("DNS:"), dom, F.lit(",DNS:www."), dom, F.lit(", DNS:"), sup,
                                           F.lit(".net"))),
        _ext(0, "extendedKeyUsage", F.when(sz % 2 == 0, F.lit("TLS Web Server Authentication, "
                                                                "TLS Web Client Authentication"))
             .otherwise(F.lit("TLS Web Server Authentication"))),
        _ext(0, "authorityKeyIdentifier", F.concat(F.lit("k"), (_c("l_partkey") % 3).cast("string"))),
        _ext(0, "subjectKeyIdentifier", F.concat(F.lit("k"), (_c("l_suppkey") % 3).cast("string"))),
        _ext(F.when(ln % 2 == 0, 1).otherwise(0), "certificatePolicies",
             F.concat(F.lit("Policy: 2.23.140.1.2.1\n  CPS: http://x,Policy: 1.3.6.1.4.1."), sz.cast("string"))))
    mid_exts = F.array(_ext(1, "basicConstraints", F.lit("CA:TRUE")),
                       _ext(0, "certificatePolicies", F.when(sz % 2 == 1, F.lit("Policy: X509v3 Any Policy"))))
    root_exts = F.array(_ext(1, "basicConstraints", F.lit("CA:TRUE")))
    return F.struct(
        F.when(i == 0, dom).when(i == 1, F.concat(F.lit("Intermediate "), _c("p_brand"))).otherwise(F.lit(""))
        .alias("common_name"),
        F.when(i == 0, _c("s_name")).when(i == 1, _c("p_brand")).alias("organization"),
        ((i == n - 1) & (n > 1)).alias("is_root"),
        ((sz * 10 - 30 + i * 100) * 86400 + ln * 43200).cast("long").alias("valid_len"),
        _c("o_orderdate").alias("validity_start"),
        _days(_c("o_orderdate"), sz * 40 + i * 365).alias("validity_end"),
        F.when(i == 0, leaf_exts).when(i == 1, mid_exts).otherwise(root_exts).alias("extensions"))


def star_records(spark, sf_dir) -> DataFrame:
    """The projected record for every lineitem row (keys + domain columns)."""
    j = joined(spark, sf_dir)
    ln, sz = _c("l_linenumber"), _c("p_size")
    j = j.withColumns({
        "_brand": F.lower(F.replace(_c("p_brand"), F.lit("#"), F.lit(""))),
        "_sup": F.lower(F.replace(_c("s_name"), F.lit("#"), F.lit("-"))),
    }).withColumn("domain_name", F.concat(F.lower(F.replace(_c("p_name"), F.lit(" "), F.lit("-"))), F.lit("."),
                                          _c("_brand"), F.lit(".com")))
    dom, brand, sup = _c("domain_name"), _c("_brand"), _c("_sup")
    a_list = F.slice(F.array(_ip4(_c("l_partkey")), _ip4(_c("l_suppkey")), _ip4(_c("o_custkey"))), 1, ln % 4)
    aaaa = F.concat(F.lit("2001:db8:"), F.lower(F.hex(_c("l_suppkey"))), F.lit("::"), (_c("l_partkey") % 100)
                    .cast("string"))
    soa = F.struct(F.concat(F.lit("ns1."), sup, F.lit(".net")).alias("primary_ns"),
                   F.concat(F.lit("hostmaster."), dom).alias("resp_mailbox_dname"),
                   _c("o_orderkey").cast("long").alias("serial"), (3600 + sz).cast("long").alias("refresh"),
                   F.lit(600).cast("long").alias("retry"), F.lit(86400).cast("long").alias("expire"),
                   _c("l_quantity").cast("long").alias("min_ttl"))
    zone_soa = F.struct(F.concat(F.lit("ns."), brand, F.lit(".com")).alias("primary_ns"),
                        F.concat(F.lit("admin."), brand, F.lit(".com")).alias("resp_mailbox_dname"),
                        F.lit(1).cast("long").alias("serial"), F.lit(7200).cast("long").alias("refresh"),
                        F.lit(900).cast("long").alias("retry"), F.lit(604800).cast("long").alias("expire"),
                        F.lit(60).cast("long").alias("min_ttl"))
    ncert = 1 + ln % 3
    chain = F.transform(F.sequence(F.lit(0), ncert - 1), lambda i: _cert(i, ncert))
    certs = F.filter(chain, lambda c: sz != 1)  # part size 1: TLS without certificates
    tls = F.when((_c("l_returnflag") == "N") & (_c("l_linestatus") == "O"), F.lit(None)).otherwise(F.struct(
        F.concat(F.lit("TLSv1."), (ln % 4).cast("string")).alias("protocol"),
        F.element_at(F.array(*[F.lit(x) for x in CIPHERS]), (sz % 17 + 1).cast("int")).alias("cipher"),
        ncert.cast("long").alias("count"), certs.alias("certificates")))
    entity = "array<struct<name:string,email:string>>"
    rec = j.select(
        *KEYS,
        "domain_name",
        F.when(_c("l_returnflag") == "R", F.lit("phishing")).otherwise(F.lit("benign")).alias("label"),
        F.lower(_c("c_mktsegment")).alias("category"),
        F.struct(*[x.alias(t) for t, x in zip(
            ("A", "AAAA", "CNAME", "MX", "NS", "SOA", "TXT"),
            ((ln % 3).cast("long"), F.lit(1).cast("long"), F.lit(None).cast("long"),
             F.when(sz % 2 == 0, 1).otherwise(2).cast("long"), F.lit(1).cast("long"), F.lit(1).cast("long"),
             F.lit(None).cast("long")))]).alias("dns_dnssec"),
        F.struct(*[x.alias(t) for t, x in zip(
            ("A", "AAAA", "CNAME", "MX", "NS", "SOA", "TXT"),
            ((_c("l_quantity") * 10).cast("long"), F.when(ln % 2 == 0, sz * 20).cast("long"),
             F.lit(None).cast("long"), (sz * 15).cast("long"), F.lit(86400).cast("long"),
             F.when(ln == 3, F.lit(None)).otherwise(F.lit(3600)).cast("long"),
             F.when(_c("l_tax") > 0.04, 300).otherwise(100).cast("long")))]).alias("dns_ttls"),
        F.struct((sz % 2 == 0).alias("spf"), (sz % 3 == 0).alias("dkim"),
                 F.when(sz % 5 == 0, F.lit(None)).otherwise(F.lit(True)).alias("dmarc")).alias("dns_email_extras"),
        F.when(ln == 1, F.lit(None)).when(ln == 2, dom).when(ln == 3, F.concat(F.lit("www."), dom))
        .otherwise(F.concat(brand, F.lit(".com"))).alias("dns_zone"),
        F.when(ln == 7, F.lit(None)).otherwise(ln % 2 == 0).alias("dns_has_dnskey"),
        (_c("l_tax") > 0.02).alias("dns_zone_dnskey_selfsign_ok"),
        F.when(ln == 5, F.lit(None)).otherwise(a_list).alias("dns_A"),
        F.when(ln % 2 == 0, F.array(aaaa)).alias("dns_AAAA"),
        F.array(F.concat(F.lit("ns1."), sup, F.lit(".net")), F.concat(F.lit("ns2."), sup, F.lit(".net")))
        .alias("dns_NS"),
        F.when(sz % 9 == 0, F.lit(None)).otherwise(F.concat(
            F.split(_c("p_name"), " "),
            F.when(sz % 5 == 0, F.array(F.concat(F.lit("google-site-verification="), _c("l_partkey").cast("string")),
                                        F.lit("")))
            .otherwise(F.array(F.concat(F.lit("v=spf1 include:"), dom))))).alias("dns_TXT"),
        F.when(sz % 4 == 0, F.concat(F.lit("cdn."), dom)).alias("dns_CNAME"),
        F.when(ln == 3, F.lit(None)).otherwise(soa).alias("dns_SOA"),
        zone_soa.alias("dns_zone_SOA"),
        F.when(sz % 6 == 0, F.lit(None)).when(sz % 6 == 1, F.array().cast("array<struct<name:string,priority:bigint>>"))
        .otherwise(F.array(F.struct(F.concat(F.lower(_c("p_type")), F.lit("."), dom).alias("name"),
                                    sz.cast("long").alias("priority")),
                           F.struct(F.when(ln == 2, dom).otherwise(F.concat(F.lit("mx."), brand, F.lit(".com")))
                                    .alias("name"), F.lit(10).cast("long").alias("priority")))).alias("dns_MX"),
        _c("o_orderdate").alias("rdap_registration_date"),
        F.when(sz % 7 == 0, F.lit(None)).otherwise(_days(_c("o_orderdate"), sz * 60)).alias("rdap_expiration_date"),
        _c("l_shipdate").alias("rdap_last_changed_date"),
        F.when(sz % 4 == 0, F.lit(None)).otherwise(ln % 2 == 1).alias("rdap_dnssec"),
        F.struct(
            F.when(ln == 4, F.lit(None).cast(entity)).otherwise(
                F.array(F.struct(_c("c_name").alias("name"), F.lit(None).cast("string").alias("email"))))
            .alias("registrant"),
            F.array(F.struct(_c("s_name").alias("name"), F.lit(None).cast("string").alias("email"))).alias("registrar"),
            F.array(F.struct(F.concat(_c("c_name"), F.lit(" admin")).alias("name"),
                             F.when(sz % 3 == 0, F.lit(None)).otherwise(
                                 F.concat(F.lower(F.replace(_c("c_name"), F.lit("#"), F.lit(""))),
                                          F.lit("@example.com"))).alias("email"))).alias("administrative"),
        ).alias("rdap_entities"),
        tls.alias("tls"),
        F.when(ln == 5, F.lit(None)).otherwise(F.concat(
            F.transform(F.coalesce(a_list, F.array()), _v4_entry),
            F.filter(F.array(_v6_entry(aaaa)), lambda e: ln % 2 == 0))).alias("ip_data"),
    )
    return rec
