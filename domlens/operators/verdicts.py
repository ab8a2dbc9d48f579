"""Threat-intelligence verdict tables from stored scan responses.

Input: ``(domain, response, live_status)`` where ``response`` is the stored JSON
body of a domain lookup.  Parsing is ``from_json`` with a declared schema;
rows whose response lacks the required statistics are dropped, as the original
skipped them.  Live probing and HTTP fetching are out of scope: ``live_status``
is an input column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RESPONSE_DDL = ("data STRUCT<attributes: STRUCT<last_analysis_stats: STRUCT<malicious: BIGINT, harmless: BIGINT, "
                "suspicious: BIGINT>, last_analysis_date: BIGINT, last_submission_date: BIGINT>>")

# Verdict labels and the titled report columns.
MALIGN, BENIGN = "Malign", "Benign"
REPORT_COLUMNS = {"domain": "Domain", "verdict": "Verdict", "detection_ratio": "Detection Ratio",
                  "detection_timestamp": "Detection Timestamp", "harmless": "Harmless", "malicious": "Malicious",
                  "suspicious": "Suspicious", "live_status": "Live Status"}


def verdict(malicious, suspicious):
    """V1: Malign when any engine says malicious or more than one says suspicious (missing = 0)."""
    return F.when((F.coalesce(malicious, F.lit(0)) > 0) | (F.coalesce(suspicious, F.lit(0)) > 1), F.lit(MALIGN)) \
        .otherwise(F.lit(BENIGN))


def format_epoch(ts):
    """V3: epoch seconds -> 'yyyy-MM-dd HH:mm:ss' (session time zone, UTC); 0 or missing -> 'N/A'."""
    return F.when(F.coalesce(ts, F.lit(0)) == 0, F.lit("N/A")) \
        .otherwise(F.date_format(F.timestamp_seconds(ts), "yyyy-MM-dd HH:mm:ss"))


def extract_verdicts(responses: DataFrame, domain: str = "domain", body: str = "response",
                     live: str = "live_status", keep: tuple[str, ...] = ()) -> DataFrame:
    """V2 (+ V1, V3): the verdict table of every parsable response."""
    j = F.from_json(F.col(body), RESPONSE_DDL)
    parsed = responses.select(*keep, F.col(domain).alias("domain"), F.col(live).alias("live_status"),
                              j.alias("_j"))
    a = F.col("_j.data.attributes")
    st = a["last_analysis_stats"]
    mal, harm, susp = st["malicious"], st["harmless"], st["suspicious"]
    ts = F.coalesce(a["last_analysis_date"], a["last_submission_date"], F.lit(0))
    return parsed.filter(mal.isNotNull() & harm.isNotNull()).select(
        *keep, "domain",
        verdict(mal, susp).alias("verdict"),
        F.concat(mal.cast("string"), F.lit("/"), (mal + harm).cast("string")).alias("detection_ratio"),
        format_epoch(ts).alias("detection_timestamp"),
        harm.alias("harmless"), mal.alias("malicious"), F.coalesce(susp, F.lit(0)).alias("suspicious"),
        "live_status")


def sort_verdicts(df: DataFrame) -> DataFrame:
    """V4: verdict then live status, both descending."""
    return df.orderBy(F.desc("verdict"), F.desc("live_status"))


def filter_by_mode(df: DataFrame, mode: str) -> DataFrame:
    """``malign`` keeps lower(trim(verdict)) = 'malign'; ``benign`` keeps everything else (no verdict included)."""
    is_malign = F.coalesce(F.lower(F.trim(F.col("verdict"))) == "malign", F.lit(False))
    return df.filter(is_malign if mode == "malign" else ~is_malign)


def not_yet_processed(domains: DataFrame, processed: DataFrame, key: str = "domain") -> DataFrame:
    """listed domains without a stored result (resume)."""
    return domains.join(processed.select(key).distinct(), key, "left_anti")


def verdict_counts(df: DataFrame) -> DataFrame:
    """A3: benign / malign / total counts (one row)."""
    return df.agg(F.sum(F.when(F.col("verdict") == BENIGN, 1).otherwise(0)).cast("long").alias("benign"),
                  F.sum(F.when(F.col("verdict") == MALIGN, 1).otherwise(0)).cast("long").alias("malign"),
                  F.count(F.lit(1)).alias("total"))


def with_summary_rows(df: DataFrame) -> DataFrame:
    """A3 report: the table plus 'Benign count' / 'Malign count' rows ('b/t' in the ratio column)."""
    c = verdict_counts(df)

    def row(label, col):
        cells = {k: F.lit(None).cast(t) for k, t in df.dtypes}
        cells["verdict"] = F.lit(label)
        cells["detection_ratio"] = F.concat(F.col(col).cast("string"), F.lit("/"), F.col("total").cast("string"))
        return F.struct(*[cells[k].alias(k) for k, _ in df.dtypes])
    both = c.select(F.explode(F.array(row("Benign count", "benign"), row("Malign count", "malign"))).alias("r"))
    return df.unionByName(both.select("r.*"))


def progress(processed: DataFrame, listed: DataFrame, key: str = "domain") -> DataFrame:
    """V5: how many listed domains have a result, and the percentage."""
    both = processed.select(F.col(key).alias("_k"), F.lit(True).alias("_p")).unionByName(
        listed.select(F.col(key).alias("_k"), F.lit(False).alias("_p")))
    c = both.agg(F.countDistinct(F.when(F.col("_p"), F.col("_k"))).alias("processed"),
                 F.countDistinct(F.when(~F.col("_p"), F.col("_k"))).alias("total"))
    return c.withColumn("percent", F.round(F.col("processed") * 100.0 / F.col("total"), 2))


def to_report(df: DataFrame) -> DataFrame:
    """Titled column names of the original CSV / report."""
    return df.withColumnsRenamed({k: v for k, v in REPORT_COLUMNS.items() if k in df.columns})
