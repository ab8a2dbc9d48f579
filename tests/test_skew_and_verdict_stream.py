"""Hot keys (one key holding a third of all rows) keep exact results, and the verdict
stream keeps the first result per domain across runs."""

import json
import os
import tempfile

from pyspark.sql import functions as F

from domlens.operators import explain as X
from domlens.operators import ngrams as NG
from domlens.operators import setops as S


def test_hot_key_semantics(spark):
    n = 3000
    hot = spark.range(n).select(F.when(F.col("id") % 3 == 0, F.lit("hot.example.com"))
                                .otherwise(F.concat(F.lit("h"), F.col("id").cast("string"), F.lit(".com")))
                                .alias("domain_name"), F.col("id").alias("v"))
    other = spark.range(n).select(F.lit("hot.example.com").alias("domain_name"), (F.col("id") + n).alias("v"))
    fold = S.keyed_union_fold([hot, other])
    assert fold.filter(F.col("domain_name") == "hot.example.com").count() == n // 3  # all of the first table's
    assert fold.count() == n
    merged = S.merge_keep_first(hot, other, order="v")
    assert merged.filter(F.col("domain_name") == "hot.example.com").collect()[0].v == 0
    attr = spark.range(n).select((F.col("id") % 2).alias("sample_id"),
                                 F.when(F.col("id") % 3 == 0, "f_hot").otherwise("f_cold").alias("feature"),
                                 (F.col("id") / n).alias("value"))
    top = {r.sample_id: (r.feature, r.value) for r in X.strongest_feature(attr).collect()}
    assert top[1][1] == (n - 1) / n and top[0][1] == (n - 2) / n
    counts = NG.ngram_counts(hot, "domain_name", (2,))
    assert counts.filter(F.col("gram") == "ho").collect()[0].cnt == n // 3


def test_verdict_stream_keeps_first_per_domain(spark):
    from domlens.streaming import incremental as S2
    d = tempfile.mkdtemp(prefix="domlens-vt-")
    src, sink, ck = os.path.join(d, "in"), os.path.join(d, "out"), os.path.join(d, "ck")
    os.makedirs(src)

    def resp(mal, harm):
        return json.dumps({"data": {"attributes": {"last_analysis_stats": {"malicious": mal, "harmless": harm},
                                                   "last_analysis_date": 1700000000}}})
    with open(os.path.join(src, "a.json"), "w") as fh:
        fh.write(json.dumps({"domain": "a.com", "response": resp(1, 9), "live_status": "Alive",
                             "ts": "2024-01-01T00:00:00"}) + "\n")
        fh.write(json.dumps({"domain": "b.com", "response": "{}", "live_status": "Dead",
                             "ts": "2024-01-01T00:00:00"}) + "\n")
    S2.verdict_stream(spark, src, sink, checkpoint=ck).awaitTermination()
    with open(os.path.join(src, "b.json"), "w") as fh:
        fh.write(json.dumps({"domain": "a.com", "response": resp(0, 10), "live_status": "Alive",
                             "ts": "2024-01-02T00:00:00"}) + "\n")
        fh.write(json.dumps({"domain": "c.com", "response": resp(0, 3), "live_status": "Dead",
                             "ts": "2024-01-02T00:00:00"}) + "\n")
    S2.verdict_stream(spark, src, sink, checkpoint=ck).awaitTermination()
    rows = {r.domain: r for r in spark.read.parquet(sink).collect()}
    assert set(rows) == {"a.com", "c.com"}  # b.com had no stats; a.com kept once
    assert rows["a.com"].verdict == "Malign" and rows["a.com"].detection_ratio == "1/10"
    assert rows["a.com"].detection_timestamp == "2023-11-14 22:13:20"
