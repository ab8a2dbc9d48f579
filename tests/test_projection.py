"""Raw document -> projected record (F1, P1-P4) and the driver entry point."""

import datetime as dt

from pyspark.sql import functions as F

from domlens.operators.prep import evaluated_only, project_documents
from domlens.schema import RAW_DOMAIN_DDL, raw_domain_schema


def _raw(spark):
    soa = {"primary_ns": "ns1.x.com", "resp_mailbox_dname": "h.x.com", "serial": 1, "refresh": 2, "retry": 3,
           "expire": 4, "min_ttl": 5}
    dns = {"dnssec": None, "ttls": None,
           "remarks": {"zone": "x.com", "has_dnskey": True, "zone_dnskey_selfsign_ok": False,
                       "has_spf": True, "has_dkim": None, "has_dmarc": False},
           "A": ["1.2.3.4"], "AAAA": None, "TXT": ["v=spf1"], "CNAME": {"value": "c.x.com"},
           "SOA": soa, "zone_SOA": None,
           "NS": {"ns1.x.com": {"related_ips": []}, "ns2.x.com": {"related_ips": None}},
           "MX": {"mx.x.com": {"priority": 10, "related_ips": None}}}
    now = dt.datetime(2024, 1, 1)
    rows = [
        {"domain_name": "x.com", "label": "benign", "category": "c", "evaluated_on": now,
         "remarks": {"dns_evaluated_on": now, "rdap_evaluated_on": None, "tls_evaluated_on": None},
         "dns": dns, "rdap": None, "tls": None, "ip_data": None},
        {"domain_name": "y.com", "label": "benign", "category": "c", "evaluated_on": now,
         "remarks": {"dns_evaluated_on": None, "rdap_evaluated_on": None, "tls_evaluated_on": None},
         "dns": {**dns, "MX": None}, "rdap": None, "tls": None, "ip_data": None},
        {"domain_name": "z.com", "label": "benign", "category": "c", "evaluated_on": None,
         "remarks": None, "dns": None, "rdap": None, "tls": None, "ip_data": None},
    ]
    return spark.createDataFrame(rows, raw_domain_schema())


def test_evaluated_only_and_projection(spark):
    raw = _raw(spark)
    kept = evaluated_only(raw)
    assert [r.domain_name for r in kept.collect()] == ["x.com"]
    rec = project_documents(raw).collect()
    by = {r.domain_name: r for r in rec}
    x = by["x.com"]
    assert sorted(x.dns_NS) == ["ns1.x.com", "ns2.x.com"]
    assert [(m.name, m.priority) for m in x.dns_MX] == [("mx.x.com", 10)]
    assert x.dns_CNAME == "c.x.com" and x.dns_zone == "x.com"
    assert (x.dns_email_extras.spf, x.dns_email_extras.dkim, x.dns_email_extras.dmarc) == (True, None, False)
    assert by["y.com"].dns_MX is None  # null map -> null, not []
    assert "RAW" not in RAW_DOMAIN_DDL


def test_entry_in_a_plain_session():
    from pyspark.sql import SparkSession

    import __spark_entry__ as E
    spark = SparkSession.builder.getOrCreate()  # whatever session the caller has
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) >= 1 and set(df.columns) >= {"suffix", "n_pages", "avg_sld_entropy"}
    assert df.schema == E.entry(spark).schema  # stable schema
