"""Catalog: verdict tables from stored scan responses.

Binding: every ``events`` row is a stored lookup of domain ``u<user_id>.example.net``;
its JSON body is built from the event: malicious = k / 30, suspicious = k % 3 (k from
``props``), harmless = floor(value) except for ``error`` events (key missing, row
unusable), analysis date = event time unless value < 5, submission date = event
time - 1 h unless value < 2; live status from the event type.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import explain as X
from ..operators import verdicts as V
from .bindings import table
from ..session import checkpoint_root
from ..sources.snapshot import KeyedSnapshot
from .catalog import query


def responses(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    stats = F.struct((k / 30).cast("long").alias("malicious"),
                     F.when(F.col("event_type") != "error", F.floor("value").cast("long")).alias("harmless"),
                     F.pmod(k, F.lit(3)).alias("suspicious"))
    attrs = F.struct(stats.alias("last_analysis_stats"),
                     F.when(F.col("value") >= 5, F.unix_seconds(F.col("ts").cast("timestamp"))).alias("last_analysis_date"),
                     F.when(F.col("value") >= 2, F.unix_seconds(F.col("ts").cast("timestamp")) - 3600).alias("last_submission_date"))
    body = F.to_json(F.struct(F.struct(attrs.alias("attributes")).alias("data")))
    live = F.when(F.col("event_type") == "view", "Alive").when(F.col("event_type") == "click", "Dead") \
        .otherwise("Unknown")
    return ev.select("event_id", "event_type", F.concat(F.lit("u"), F.col("user_id"), F.lit(".example.net"))
                     .alias("domain"), body.alias("response"), live.alias("live_status"))


def verdict_table(spark, sf_dir):
    return V.extract_verdicts(responses(spark, sf_dir), keep=("event_id", "event_type"))


SQL_VERDICTS = """
SELECT event_id, event_type, 'u' || user_id || '.example.net' AS domain,
  CASE WHEN (props->>'k')::BIGINT // 30 > 0 OR (props->>'k')::BIGINT % 3 > 1 THEN 'Malign' ELSE 'Benign' END AS verdict,
  ((props->>'k')::BIGINT // 30)::VARCHAR || '/' || ((props->>'k')::BIGINT // 30 + floor(value)::BIGINT)::VARCHAR
    AS detection_ratio,
  CASE WHEN coalesce(CASE WHEN value >= 5 THEN floor(epoch(ts))::BIGINT END,
                     CASE WHEN value >= 2 THEN floor(epoch(ts))::BIGINT - 3600 END, 0) = 0 THEN 'N/A'
       ELSE strftime(make_timestamp(coalesce(CASE WHEN value >= 5 THEN floor(epoch(ts))::BIGINT END,
                     CASE WHEN value >= 2 THEN floor(epoch(ts))::BIGINT - 3600 END) * 1000000), '%Y-%m-%d %H:%M:%S') END
    AS detection_timestamp,
  floor(value)::BIGINT AS harmless, ((props->>'k')::BIGINT // 30) AS malicious,
  ((props->>'k')::BIGINT % 3) AS suspicious,
  CASE event_type WHEN 'view' THEN 'Alive' WHEN 'click' THEN 'Dead' ELSE 'Unknown' END AS live_status
FROM events WHERE event_type <> 'error'
"""


@query("V2_extract_verdicts", SQL_VERDICTS)
def extract_verdicts(spark, sf_dir):
    """V1-V3: verdict, detection ratio, formatted timestamp and counts per stored response."""
    return verdict_table(spark, sf_dir)


@query("A3_verdict_counts", f"""
SELECT sum(CASE WHEN verdict = 'Benign' THEN 1 ELSE 0 END)::BIGINT AS benign,
       sum(CASE WHEN verdict = 'Malign' THEN 1 ELSE 0 END)::BIGINT AS malign, count(*)::BIGINT AS total
FROM ({SQL_VERDICTS})
""")
def verdict_counts(spark, sf_dir):
    """A3: benign / malign / total over the verdict table."""
    return V.verdict_counts(verdict_table(spark, sf_dir))


_REPORT_COLS = "domain, verdict, detection_ratio, detection_timestamp, harmless, malicious, suspicious, live_status"


@query("A3_report_with_summary", f"""
WITH v AS (SELECT {_REPORT_COLS} FROM ({SQL_VERDICTS})),
c AS (SELECT sum(CASE WHEN verdict = 'Benign' THEN 1 ELSE 0 END) AS b,
             sum(CASE WHEN verdict = 'Malign' THEN 1 ELSE 0 END) AS m, count(*) AS t FROM v)
SELECT * FROM v
UNION ALL SELECT NULL, 'Benign count', b::VARCHAR || '/' || t::VARCHAR, NULL, NULL, NULL, NULL, NULL FROM c
UNION ALL SELECT NULL, 'Malign count', m::VARCHAR || '/' || t::VARCHAR, NULL, NULL, NULL, NULL, NULL FROM c
""")
def report_with_summary(spark, sf_dir):
    """A3: the report table with the two summary rows appended."""
    v = verdict_table(spark, sf_dir).select(*[c.strip() for c in _REPORT_COLS.split(",")])
    return V.with_summary_rows(v)


@query("V4_sorted_verdicts", f"""
SELECT row_number() OVER (ORDER BY verdict DESC NULLS LAST, live_status DESC NULLS LAST, event_id) AS place, event_id, verdict, live_status FROM ({SQL_VERDICTS})
""")
def sorted_verdicts(spark, sf_dir):
    """V4: the verdict table sorted by verdict and live status, both descending, with places."""
    v = verdict_table(spark, sf_dir).select("event_id", "verdict", "live_status")
    return X.sorted_places(v, [F.col("verdict").desc_nulls_last(), F.col("live_status").desc_nulls_last(), F.col("event_id").asc()])


@query("F3_filter_malign", f"SELECT domain, event_id FROM ({SQL_VERDICTS}) WHERE lower(trim(verdict)) = 'malign'")
def filter_malign(spark, sf_dir):
    """F3 (mode malign): domains whose verdict is Malign."""
    return V.filter_by_mode(verdict_table(spark, sf_dir), "malign").select("domain", "event_id")


@query("F3_filter_benign", f"SELECT domain, event_id FROM ({SQL_VERDICTS}) WHERE coalesce(lower(trim(verdict)) <> 'malign', true)")
def filter_benign(spark, sf_dir):
    """F3 (mode benign): every other domain."""
    return V.filter_by_mode(verdict_table(spark, sf_dir), "benign").select("domain", "event_id")


@query("U5_verdict_merge", f"""
WITH v AS (SELECT * FROM ({SQL_VERDICTS})),
r AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY (event_type <> 'view')::INT, event_id) AS rk FROM v)
SELECT {_REPORT_COLS}, event_id FROM r WHERE rk = 1
""")
def verdict_merge(spark, sf_dir):
    """Merge earlier results (``view`` lookups) with new ones by domain; earlier wins, then event order."""
    v = verdict_table(spark, sf_dir)
    cols = [c.strip() for c in _REPORT_COLS.split(",")] + ["event_id"]
    old = v.filter(F.col("event_type") == "view").select(*cols)
    new = v.filter(F.col("event_type") != "view").select(*cols)
    from ..operators.setops import merge_keep_first
    return merge_keep_first(old, new, order="event_id", key="domain")


EARLY = "2024-01-03 00:00:00"  # results stored before this time count as already processed


@query("F4_not_yet_processed", f"""
SELECT DISTINCT 'u' || user_id || '.example.net' AS domain FROM events
EXCEPT SELECT 'u' || user_id || '.example.net' FROM events
       WHERE event_type = 'view' AND ts < TIMESTAMP '{EARLY}'
""")
def not_yet_processed(spark, sf_dir):
    """listed domains (every user) without an early stored (``view``) result."""
    ev = table(spark, sf_dir, "events")
    dom = F.concat(F.lit("u"), F.col("user_id"), F.lit(".example.net")).alias("domain")
    listed = ev.select(dom).distinct()
    done = ev.filter((F.col("event_type") == "view") & (F.col("ts") < F.lit(EARLY).cast("timestamp_ntz"))) \
        .select(dom)
    return V.not_yet_processed(listed, done)


@query("V5_progress", f"""
SELECT (SELECT count(DISTINCT domain) FROM ({SQL_VERDICTS}) WHERE event_type = 'view')::BIGINT AS processed,
       (SELECT count(DISTINCT user_id) FROM events)::BIGINT AS total,
       round((SELECT count(DISTINCT domain) FROM ({SQL_VERDICTS}) WHERE event_type = 'view') * 100.0
             / (SELECT count(DISTINCT user_id) FROM events), 2) AS percent
""")
def progress(spark, sf_dir):
    """V5: processed / total domains and the percentage."""
    listed = table(spark, sf_dir, "events").select(
        F.concat(F.lit("u"), F.col("user_id"), F.lit(".example.net")).alias("domain"))
    done = verdict_table(spark, sf_dir).filter(F.col("event_type") == "view")
    return V.progress(done, listed)


@query("F5_dropna", """
SELECT d.doc_id, d.lang, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
WHERE l.quality IS NOT NULL AND l.toxic IS NOT NULL AND d.lang IS NOT NULL
""")
def dropna(spark, sf_dir):
    """drop rows with any NULL (documents left-joined to their labels)."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang")
    lab = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    return d.join(lab, "doc_id", "left").dropna()


@query("F4_U5_resumable_merge", f"""
WITH v AS (SELECT * FROM ({SQL_VERDICTS})),
r AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY (event_type <> 'view')::INT, event_id) AS rk FROM v)
SELECT {_REPORT_COLS}, event_id FROM r WHERE rk = 1
""")
def resumable_merge(spark, sf_dir):
    """F4 + U5 + S4: earlier results, then the new ones of domains without a result, merged into a keyed snapshot; each batch
    is sent twice, and counts once."""
    cols = [c.strip() for c in _REPORT_COLS.split(",")] + ["event_id"]
    v = verdict_table(spark, sf_dir)
    table_ = KeyedSnapshot(spark, f"{checkpoint_root(spark)}/snapshot-{uuid.uuid4().hex[:12]}", "domain", "event_id")
    for batch, part in (("early", F.col("event_type") == "view"), ("late", F.col("event_type") != "view")):
        for _ in range(2):
            table_.merge(table_.new_keys(v.filter(part).select(*cols)), batch)
    return table_.rows().select(*cols)
