"""Sources / sinks (S*) and the incremental streams, on throw-away folders under /tmp."""

import os
import tempfile

from pyspark.sql import functions as F

from domlens.sources import io as IO


def _tmp():
    return tempfile.mkdtemp(prefix="domlens-test-")


def test_text_csv_and_attribution_sources(spark):
    d = _tmp()
    with open(os.path.join(d, "domains.txt"), "w") as fh:
        fh.write(" a.com \n\n b.org\n")
    assert sorted(r.domain for r in IO.read_lines(spark, os.path.join(d, "domains.txt")).collect()) == ["a.com", "b.org"]
    with open(os.path.join(d, "shap.txt"), "w") as fh:
        fh.write("Domain: a.com, Feature: lex_x, SHAP Value: 0.5\nDomain: b.org, Feature: dns_y, SHAP Value: nan\n")
    rows = IO.read_attribution_log(spark, os.path.join(d, "shap.txt")).collect()
    assert rows[0].value == 0.5 and rows[1].value != rows[1].value  # NaN
    df = spark.createDataFrame([("a.com", "Malign")], "Domain string, Verdict string")
    IO.write_csv(df, os.path.join(d, "out.csv"))
    assert IO.read_csv(spark, os.path.join(d, "out.csv")).collect()[0].Verdict == "Malign"
    p = IO.write_lines(df, "Domain", os.path.join(d, "lists"), "/x/report_2311.csv")
    assert p.endswith("2311_finished_list.txt") and spark.read.text(p).count() == 1


def test_save_table_and_cached_source(spark):
    d = _tmp()
    df = spark.range(5).withColumn("ts", F.lit("2024-01-01 00:00:00.123456").cast("timestamp"))
    p = IO.save_table(df, d, "t", prefix="after_dns")
    assert p.endswith("after_dns/t")
    assert spark.read.parquet(p).collect()[0].ts.microsecond == 123000  # millisecond files
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)
    for mode in ("auto", "force-local", "bogus", "force-refresh"):
        assert IO.cached_source(spark, "c", build, d, mode).count() == 3
    assert len(calls) == 2  # first miss + forced refresh


def test_pipeline_snapshots_and_streams(spark, rules):
    from fixtures import AS_OF, records_df

    from domlens.plans import pipeline as PL
    from domlens.streaming import incremental as S
    d = _tmp()
    reg = PL.default_registry(rules, F.lit(AS_OF).cast("timestamp"))
    out = PL.run(records_df(spark), reg, snapshot_root=d, dataset="fixture")
    assert out.count() == 4 and "ip_data" not in out.columns and "lex_name_len" in out.columns
    assert sorted(os.listdir(os.path.join(d, "fixture"))) == [
        "after_dns", "after_ip", "after_lexical", "after_tls", "beforedrop_rdap"]
    # streaming: two files arrive, the second run only processes the new one
    src, sink, ck = os.path.join(d, "in"), os.path.join(d, "out"), os.path.join(d, "ck")
    records_df(spark).limit(2).write.mode("overwrite").parquet(os.path.join(src, "part1"))
    q = S.feature_stream(spark, os.path.join(src, "*"), sink, lambda b: PL.run(b, reg), checkpoint=ck)
    q.awaitTermination()
    records_df(spark).write.mode("overwrite").parquet(os.path.join(src, "part2"))
    q = S.feature_stream(spark, os.path.join(src, "*"), sink, lambda b: PL.run(b, reg), checkpoint=ck)
    q.awaitTermination()
    assert S.read_batches(spark, sink).count() == 6


def test_dataset_batch_skips_failures_and_tags(spark):
    d = _tmp()
    spark.range(3).write.parquet(os.path.join(d, "a"))
    spark.range(2).withColumn("extra", F.lit(1)).write.parquet(os.path.join(d, "b"))
    frames = IO.load_datasets(spark, {"a": os.path.join(d, "a"), "b": os.path.join(d, "b"),
                                      "missing": os.path.join(d, "nope")}, IO.read_parquet)
    assert sorted(frames) == ["a", "b"]
    tagged = IO.tag_dataset(frames)
    assert sorted((r.dataset, r.n) for r in tagged.groupBy("dataset").agg(F.count("*").alias("n")).collect()) == [
        ("a", 3), ("b", 2)]


def test_training_table_is_numeric_and_filled(spark, rules):
    from fixtures import AS_OF, records_df

    from domlens.plans import pipeline as PL
    reg = PL.default_registry(rules, F.lit(AS_OF).cast("timestamp"))
    feats = PL.run(records_df(spark), reg).drop("domain_name", "label")
    table = PL.training_table(feats)
    kinds = {t for _, t in table.dtypes}
    assert kinds <= {"bigint", "int", "double"}, kinds
    assert table.filter(F.col("dns_ttl_avg").isNull()).count() == 0
    assert table.filter(F.col("dns_ttl_avg") == -1).count() >= 1  # filled, not dropped


def test_dictionary_json_and_record_roundtrip(spark, rules):
    from fixtures import records_df

    from domlens.operators import ngrams as NG
    d = _tmp()
    hosts = spark.createDataFrame([("www.paypal-login.example.com",)], "domain_name string")
    dic = NG.domain_ngram_dictionary(hosts, rules, "phishing", {2: 5, 3: 5})
    NG.dictionary_to_json(dic, os.path.join(d, "dict"))
    back = NG.dictionary_from_json(spark, os.path.join(d, "dict"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, dic.collect()))
    records_df(spark).write.mode("overwrite").parquet(os.path.join(d, "records"))
    again = IO.read_domain_records(spark, os.path.join(d, "records"))
    assert again.count() == 4 and again.schema == records_df(spark).schema
