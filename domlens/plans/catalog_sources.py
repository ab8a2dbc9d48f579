"""Catalog: sources and sinks (S1-S15) and the projection of raw documents.

Each query writes a format from a given table into the shared folder and reads it back.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import dns as DNS
from ..operators import explain as X
from ..operators import geo as GEO
from ..operators import ngrams as NG
from ..operators import prep as P
from ..session import checkpoint_root
from ..sources import io as IO
from . import pipeline as PL
from . import records_sql as RS
from .bindings import SQL_PAGE_HOSTS, page_hosts, table
from .catalog import query
from .catalog_lexical import DICT_SQL, FAMILY_SETS, family_dictionary
from .catalog_metrics import SQL_MEAN_ABS, attributions
from .records import AS_OF, KEYS, star_records


SQL_KEYS = ", ".join(KEYS)


def folder(spark) -> str:
    """A fresh path in the shared folder."""
    return f"{checkpoint_root(spark)}/sources-{uuid.uuid4().hex[:12]}"


# ---------------------------------------------------------------- S1, F1, P1-P4: raw documents
def raw_documents(spark, sf_dir):
    """The records in their raw form: NS and MX are objects keyed by host name, CNAME an object, and each family is
    nested. Line 7 of an order was not evaluated, line 6 not for DNS."""
    r = star_records(spark, sf_dir)
    at = F.lit(AS_OF).cast("timestamp")
    names = F.array_distinct("dns_NS")
    mx = F.filter("dns_MX", lambda m: m["name"].isNotNull())
    remarks = F.struct(F.col("dns_zone").alias("zone"), F.col("dns_has_dnskey").alias("has_dnskey"), F.col("dns_zone_dnskey_selfsign_ok").alias("zone_dnskey_selfsign_ok"),
                       *[F.col(f"dns_email_extras.{c}").alias(f"has_{c}") for c in ("spf", "dkim", "dmarc")])
    dns = F.struct(
        F.col("dns_dnssec").alias("dnssec"), F.col("dns_ttls").alias("ttls"), remarks.alias("remarks"),
        *[F.col(f"dns_{t}").alias(t) for t in ("A", "AAAA", "TXT", "SOA", "zone_SOA")],
        F.when(F.col("dns_CNAME").isNotNull(), F.struct(F.col("dns_CNAME").alias("value"))).alias("CNAME"),
        F.map_from_arrays(names, F.transform(names, lambda _: F.struct(F.array().cast("array<string>").alias("related_ips")))).alias("NS"),
        F.map_from_arrays(F.transform(mx, lambda m: m["name"]), F.transform(mx, lambda m: F.struct(m["priority"].alias("priority"), F.array().cast("array<string>").alias("related_ips")))).alias("MX"))
    rdap = F.struct(*[F.col(f"rdap_{c}").alias(c) for c in ("registration_date", "expiration_date", "last_changed_date", "dnssec", "entities")])
    return r.select("domain_name", "label", "category", F.when(F.col("l_linenumber") != 7, at).alias("evaluated_on"),
                    F.struct(F.when(F.col("l_linenumber") != 6, at).alias("dns_evaluated_on"), at.alias("rdap_evaluated_on"), at.alias("tls_evaluated_on")).alias("remarks"),
                    dns.alias("dns"), rdap.alias("rdap"), "tls", "ip_data")


@query("S1_F1_P1_P4_raw_documents", f"""
WITH {RS.RECORDS_SQL}
SELECT domain_name, label, category, dns_zone, dns_has_dnskey, dns_email_extras.dmarc AS dmarc, dns_CNAME AS cname, list_aggregate(list_sort(dns_NS), 'string_agg', ',') AS ns,
       list_aggregate(list_sort(list_transform(dns_MX, lambda m: m.name || ':' || m.priority)), 'string_agg', ',') AS mx, list_aggregate(list_transform(ip_data, lambda e: e.ip), 'string_agg', ',') AS ips,
       epoch(rdap_registration_date)::BIGINT AS registered, dns_ttls.NS AS ttl_ns, len(tls.certificates)::INT AS certificates, dns_SOA.primary_ns AS primary_ns
FROM rec WHERE l_linenumber NOT IN (6, 7)
""")
def raw_projection(spark, sf_dir):
    """S1 + F1 + P1-P4: raw documents written as JSON, read with the declared schema, only evaluated ones, and projected."""
    path = folder(spark)
    # packed at the least effort, as the files are read once
    raw_documents(spark, sf_dir).write.option("zlib.compress.level", "BEST_SPEED").json(path, compression="gzip")
    r = IO.read_raw_documents(spark, path)

    def joined(c):
        return F.when(F.size(c) > 0, F.array_join(c, ","))
    return r.select("domain_name", "label", "category", "dns_zone", "dns_has_dnskey", F.col("dns_email_extras.dmarc").alias("dmarc"), F.col("dns_CNAME").alias("cname"),
                    joined(F.array_sort("dns_NS")).alias("ns"), joined(F.array_sort(F.transform("dns_MX", lambda m: F.concat(m["name"], F.lit(":"), m["priority"].cast("string"))))).alias("mx"),
                    joined(F.transform("ip_data", lambda e: e["ip"])).alias("ips"), F.unix_timestamp("rdap_registration_date").alias("registered"),
                    F.col("dns_ttls.NS").alias("ttl_ns"), F.size("tls.certificates").alias("certificates"), F.col("dns_SOA.primary_ns").alias("primary_ns"))


@query("P7_extra_geo", f"""
WITH {RS.RECORDS_SQL}, g AS (SELECT {SQL_KEYS}, list_filter(ip_data, lambda e: e.geo IS NOT NULL) AS k FROM rec)
SELECT {SQL_KEYS}, list_aggregate(list_transform(k, lambda e: 'isp ' || coalesce(e.asn.asn, 0)), 'string_agg', ',') AS isps,
       list_aggregate(list_transform(k, lambda e: 'org ' || e.geo.country), 'string_agg', ',') AS orgs, list_aggregate(list_transform(k, lambda e: left(e.geo.country, 3)), 'string_agg', ',') AS regions FROM g
""")
def extra_geo(spark, sf_dir):
    """Providers, organisations and regions of the addresses that have a place."""
    geo = F.col("ip_data")
    wider = F.transform(geo, lambda e: e.withField("geo", F.when(e["geo"].isNotNull(), F.struct(
        *[e["geo"][c].alias(c) for c in ("country", "latitude", "longitude")], F.concat(F.lit("isp "), F.coalesce(e["asn"]["asn"], F.lit(0).cast("long")).cast("string")).alias("isp"),
        F.concat(F.lit("org "), e["geo"]["country"]).alias("org"), F.substring(e["geo"]["country"], 1, 3).alias("region")))))
    out = GEO.flatten_geo(star_records(spark, sf_dir).withColumn("ip_data", wider), experimental=True)
    return out.select(*KEYS, *[F.when(F.size(c) > 0, F.array_join(c, ",")).alias(c) for c in ("isps", "orgs", "regions")])


@query("P8_drop_nontrain", f"""
WITH {RS.RECORDS_SQL}
SELECT {SQL_KEYS}, label, category, dns_has_dnskey, coalesce(len(dns_A), 0)::BIGINT AS dns_A_count, coalesce(len(dns_AAAA), 0)::BIGINT AS dns_AAAA_count, coalesce(len(dns_MX), 0)::BIGINT AS dns_MX_count,
       coalesce(len(dns_NS), 0)::BIGINT AS dns_NS_count, coalesce(len(dns_TXT), 0)::BIGINT AS dns_TXT_count, (dns_SOA IS NOT NULL)::BIGINT AS dns_SOA_count, (dns_CNAME IS NOT NULL)::BIGINT AS dns_CNAME_count FROM rec
""")
def drop_nontrain(spark, sf_dir):
    """Every column of a record table that isn't for training is gone, the key too."""
    return P.drop_nontrain(star_records(spark, sf_dir).withColumns(DNS.record_counts()).drop("tls"), keep_key=False)


# ---------------------------------------------------------------- S3 - S6
@query("S3_S4_saved_and_cached", "SELECT o_orderkey, o_orderstatus, o_totalprice, epoch_ms(o_orderdate) AS ordered_ms FROM orders")
def saved_and_cached(spark, sf_dir):
    """S3 + S4: a table saved with times in milliseconds, then read through the cache: built once, then read."""
    root = folder(spark)
    path = IO.save_table(table(spark, sf_dir, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp")), root, "orders", "tables")
    for mode in ("auto", "force-refresh", "force-local"):
        found = IO.cached_source(spark, "orders_cache", lambda: spark.read.parquet(path), root, mode)
    return found.select("o_orderkey", "o_orderstatus", "o_totalprice", F.unix_millis("o_orderdate").alias("ordered_ms"))


@query("S5_stage_snapshots", f"WITH {RS.RECORDS_SQL} SELECT {SQL_KEYS}, label || ':' || category AS label, coalesce(len(dns_MX), 0)::BIGINT AS dns_MX_count FROM rec")
def stage_snapshots(spark, sf_dir):
    """The snapshot that a stage of the feature build leaves."""
    root = folder(spark)
    stages = PL.Registry().register("label", P.combine_label).register("dns", lambda df: df.withColumns(DNS.record_counts()), save=True)
    PL.run(star_records(spark, sf_dir).drop("tls", "ip_data"), stages, snapshot_root=root)
    return spark.read.parquet(IO.table_path(root, "after_dns", "records")).select(*KEYS, "label", "dns_MX_count")


@query("S6_dataset_batch", " UNION ALL ".join(f"SELECT '{name}' AS dataset, page_id FROM pages WHERE {sql}" for name, (_, sql, _) in FAMILY_SETS.items()))
def dataset_batch(spark, sf_dir):
    """Labelled sets by path in one table; a set whose path is missing is skipped."""
    root = folder(spark)
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    specs = {name: f"{root}/{name}" for name in FAMILY_SETS}
    for name, (pred, _, _) in FAMILY_SETS.items():
        pages.filter(pred(F.col("url"))).select("page_id").write.parquet(specs[name])
    return IO.tag_dataset(IO.load_datasets(spark, specs | {"missing": f"{root}/none"}, IO.read_parquet)).select("dataset", "page_id")


# ---------------------------------------------------------------- S7 - S11
@query("S7_S10_text_lines", f"SELECT trim(domain_name) AS domain, count(*) AS n FROM ({SQL_PAGE_HOSTS}) WHERE trim(domain_name) <> '' GROUP BY 1")
def text_lines(spark, sf_dir):
    """S7 + S10: domains written one a line under the name made from the input's, and read back."""
    path = IO.write_lines(page_hosts(spark, sf_dir), "domain_name", folder(spark), "/in/report_2311.csv")
    return IO.read_lines(spark, path).groupBy("domain").agg(F.count(F.lit(1)).alias("n"))


CUSTOMER = "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING"


@query("S8_S9_csv_tsv", " UNION ALL ".join(f"SELECT '{k}' AS kind, c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer" for k in ("csv", "tsv")))
def csv_and_tsv(spark, sf_dir):
    """S8 + S9: customers written with a header as CSV and as TSV, read with a declared schema."""
    out = None
    for kind, sep in (("csv", ","), ("tsv", "\t")):
        path = folder(spark)
        IO.write_csv(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"), path, sep)
        part = IO.read_csv(spark, path, CUSTOMER, sep).withColumn("kind", F.lit(kind))
        out = part if out is None else out.unionByName(part)
    return out


@query("S11_dictionary_json", f"SELECT 'long' AS layout, * FROM ({DICT_SQL}) UNION ALL SELECT 'original' AS layout, * FROM ({DICT_SQL})")
def dictionary_files(spark, sf_dir):
    """The n-gram dictionaries as JSON in the long layout and in the original's, read back."""
    grams = family_dictionary(spark, sf_dir)
    long = folder(spark)
    NG.dictionary_to_json(grams, long)
    back = NG.dictionary_from_json(spark, long)
    out = back.withColumn("layout", F.lit("long"))
    for family in FAMILY_SETS:
        path = folder(spark)
        NG.dictionary_to_layout(back, family, path)
        out = out.unionByName(NG.dictionary_from_layout(spark, path, family).withColumn("layout", F.lit("original")))
    return out


# ---------------------------------------------------------------- S12 - S15
@query("S12_attribution_log", "SELECT 'user ' || user_id AS domain, event_type AS feature, coalesce(CASE WHEN event_id % 10 = 0 THEN NULL ELSE value END, -1) AS value, coalesce(event_id % 10 = 0 OR value IS NULL, true) AS missing FROM events WHERE user_id IS NOT NULL AND event_type IS NOT NULL")
def attribution_log(spark, sf_dir):
    """Attributions written as text lines and parsed back; every tenth one is 'nan'."""
    path = folder(spark)
    e = table(spark, sf_dir, "events").filter("user_id is not null and event_type is not null")
    value = F.when(F.col("event_id") % 10 == 0, F.lit(float("nan"))).otherwise(F.coalesce("value", F.lit(float("nan"))))
    IO.write_attribution_log(e.select(F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("domain"), F.col("event_type").alias("feature"), value.alias("value")), path)
    found = IO.read_attribution_log(spark, path)
    return found.select("domain", "feature", F.when(F.isnan("value"), -1.0).otherwise(F.col("value")).alias("value"), F.isnan("value").alias("missing"))


@query("S13_ranking_file", f"SELECT feature, mean_abs AS mean_value FROM ({SQL_MEAN_ABS})")
def ranking_file(spark, sf_dir):
    """The ranking of features as a text file, parsed back."""
    path = folder(spark)
    IO.write_ranking(X.mean_abs(attributions(spark, sf_dir)).withColumnRenamed("mean_abs", "mean_value"), path)
    return IO.read_ranking(spark, path)


@query("S14_count_and_first", "SELECT count(*) AS n, min(o_orderkey) AS first_key FROM orders")
def count_first(spark, sf_dir):
    """Record count and first record of a saved, sorted table."""
    path = folder(spark)
    table(spark, sf_dir, "orders").select("o_orderkey").sort("o_orderkey").write.parquet(path)
    n, first = IO.count_and_first(spark.read.parquet(path).sort("o_orderkey"))
    return spark.createDataFrame([(n, first[0]["o_orderkey"] if first else None)], "n long, first_key long")


@query("S15_preview", "SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 20")
def preview(spark, sf_dir):
    """The first rows of a sorted table."""
    return IO.preview(table(spark, sf_dir, "customer").select("c_custkey", "c_name").sort("c_custkey"), 20)
