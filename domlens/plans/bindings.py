"""Bindings of the operators to the driver's test tables.

The reference reads domain records from a document store; the test tables are
a star schema plus web pages.  These functions derive the domain-shaped inputs
from whole tables (no sampling, no id subsets):

* ``page_hosts``   -- one row per page: ``page_id, url, domain_name`` (URL host).
* ``labelled_sets``-- three keyed sets of page hosts: pages served over https,
  over plain http, and pages whose URL carries a query string (overlaps both).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.domain import host_of_url

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def page_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return pages.withColumn("domain_name", host_of_url("url"))


def https_set(spark, sf_dir) -> DataFrame:
    return page_hosts(spark, sf_dir).filter(F.col("url").startswith("https:"))


def http_set(spark, sf_dir) -> DataFrame:
    return page_hosts(spark, sf_dir).filter(F.col("url").startswith("http:"))


def query_set(spark, sf_dir) -> DataFrame:
    return page_hosts(spark, sf_dir).filter(F.col("url").contains("?"))


# SQL twins of the bindings (DuckDB; the test tables are registered as views).
SQL_HOST = "lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)', 1))"
SQL_PAGE_HOSTS = f"SELECT page_id, url, {SQL_HOST} AS domain_name FROM pages"
SQL_HTTPS = f"SELECT * FROM ({SQL_PAGE_HOSTS}) WHERE starts_with(url, 'https:')"
SQL_HTTP = f"SELECT * FROM ({SQL_PAGE_HOSTS}) WHERE starts_with(url, 'http:')"
SQL_QUERY = f"SELECT * FROM ({SQL_PAGE_HOSTS}) WHERE contains(url, '?')"
