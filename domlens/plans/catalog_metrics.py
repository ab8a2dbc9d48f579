"""Catalog: classifier metrics, multi-seed summaries, attribution reports.

Bindings: ``labels.quality`` is the truth for documents; three rule "classifiers"
score them (``len500`` / ``len2000``: n_chars thresholds, ``nontoxic``: 1 - toxic).
Multiclass truth is ``documents.lang``, predicted by a stop-word rule.
Attributions are ``lineitem`` numerics unpivoted, feature names prefixed by
``l_linestatus`` (``o_`` / ``f_``).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import explain as X
from ..operators import metrics as M
from ..operators.ml import slot
from .bindings import table
from .catalog import query

# ---------------------------------------------------------------- bindings
CLASSIFIERS = {  # name -> (Spark prediction, SQL prediction)
    "len500": (lambda: (F.col("n_chars") >= 500).cast("int"), "(n_chars >= 500)::INTEGER"),
    "len2000": (lambda: (F.col("n_chars") >= 2000).cast("int"), "(n_chars >= 2000)::INTEGER"),
    "nontoxic": (lambda: (1 - F.col("toxic")).cast("int"), "(1 - toxic)::INTEGER"),
}
SEEDS = (0, 1, 2, 3, 4)
TEST_FRACTION = 0.3


def scored(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    lab = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    df = docs.join(lab, "doc_id")
    return df.withColumns({name: f() for name, (f, _) in CLASSIFIERS.items()})


SQL_SCORED = ("SELECT d.doc_id, d.n_chars, l.quality, l.toxic, "
              + ", ".join(f"{sql} AS {name}" for name, (_, sql) in CLASSIFIERS.items())
              + " FROM documents d JOIN labels l ON d.doc_id = l.doc_id")


def split_hash(key, seed: int):
    """Seeded pseudo-random fraction in [0, 1) of an integer key (same arithmetic in SQL)."""
    return slot(F.col(key), seed) / F.lit(1000003.0)


def sql_split_hash(key: str, seed: str) -> str:
    return f"((((({key}) % 1000003 + 1000003) % 1000003) * 2654435761 + (({seed}) + 1) * 40503) % 1000003) / 1000003.0"


def _bin_sql(pred: str, truth: str = "quality") -> str:
    return (f"sum(CASE WHEN {truth} <> 1 AND {pred} <> 1 THEN 1 ELSE 0 END)::BIGINT AS tn, "
            f"sum(CASE WHEN {truth} <> 1 AND {pred} = 1 THEN 1 ELSE 0 END)::BIGINT AS fp, "
            f"sum(CASE WHEN {truth} = 1 AND {pred} <> 1 THEN 1 ELSE 0 END)::BIGINT AS fn, "
            f"sum(CASE WHEN {truth} = 1 AND {pred} = 1 THEN 1 ELSE 0 END)::BIGINT AS tp")


def _div_sql(a: str, b: str, zero: str = "0.0") -> str:
    return f"(CASE WHEN ({b}) = 0 THEN {zero} ELSE ({a})::DOUBLE / ({b}) END)"


def _metrics_sql(src: str) -> str:
    return (f"SELECT *, {_div_sql('tp + tn', 'tn + fp + fn + tp')} AS accuracy, "
            f"{_div_sql('tp', 'tp + fp')} AS precision, {_div_sql('tp', 'tp + fn')} AS recall, "
            f"{_div_sql('2 * tp', '2 * tp + fp + fn')} AS f1, {_div_sql('fp', 'fp + tn')} AS fpr, "
            f"{_div_sql('tp', 'tp + fn')} AS tpr, "
            f"{_div_sql(_div_sql('tp', 'tp + fn') + ' * (tp + fn) + ' + _div_sql('tn', 'tn + fp') + ' * (tn + fp)', 'tn + fp + fn + tp')}"
            f" AS weighted_accuracy FROM ({src})")


# ---------------------------------------------------------------- A7 confusion
@query("A7_confusion_matrix", f"""
SELECT quality AS label, nontoxic AS prediction, count(*)::BIGINT AS n FROM ({SQL_SCORED}) GROUP BY 1, 2
""")
def confusion_matrix(spark, sf_dir):
    """Confusion cells of the ``nontoxic`` rule against document quality."""
    return M.confusion(scored(spark, sf_dir), "quality", "nontoxic")


@query("A8_binary_metrics", _metrics_sql(
    "SELECT c.classifier, " + _bin_sql("c.pred") + f" FROM (" + " UNION ALL ".join(
        f"SELECT '{name}' AS classifier, quality, {name} AS pred FROM ({SQL_SCORED})" for name in CLASSIFIERS)
    + ") c GROUP BY c.classifier"))
def binary_metrics(spark, sf_dir):
    """TN/FP/FN/TP, accuracy, precision, recall, F1, FPR, TPR, weighted accuracy per rule."""
    s = scored(spark, sf_dir)
    long = s.select("quality", F.explode(F.array(*[
        F.struct(F.lit(n).alias("classifier"), F.col(n).alias("pred")) for n in CLASSIFIERS])).alias("c")) \
        .select("quality", "c.classifier", "c.pred")
    return M.binary_metrics(M.binary_counts(long, "quality", "pred", 1, "classifier"))


# ---------------------------------------------------------------- A10 / A11 multiclass
LANG_RULE_SQL = ("CASE WHEN contains(lower(text), ' the ') THEN 'en' WHEN contains(lower(text), ' der ') THEN 'de' "
                 "WHEN contains(lower(text), ' le ') THEN 'fr' WHEN contains(lower(text), ' el ') THEN 'es' "
                 "ELSE 'en' END")


def lang_scored(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", F.lower("text").alias("t"))
    pred = (F.when(F.col("t").contains(" the "), "en").when(F.col("t").contains(" der "), "de")
            .when(F.col("t").contains(" le "), "fr").when(F.col("t").contains(" el "), "es").otherwise("en"))
    return d.select("doc_id", F.col("lang").alias("label"), pred.alias("prediction"))


SQL_LANG_CONF = (f"SELECT lang AS label, {LANG_RULE_SQL} AS prediction, count(*) AS n FROM documents "
                 "GROUP BY 1, 2")


@query("A10_micro_scores", f"""
SELECT {_div_sql("sum(CASE WHEN label = prediction THEN n ELSE 0 END)", "sum(n)")} AS micro_precision,
       {_div_sql("sum(CASE WHEN label = prediction THEN n ELSE 0 END)", "sum(n)")} AS micro_recall,
       {_div_sql("sum(CASE WHEN label = prediction THEN n ELSE 0 END)", "sum(n)")} AS micro_f1
FROM ({SQL_LANG_CONF})
""")
def micro_scores(spark, sf_dir):
    """A10: micro-averaged scores of the language rule."""
    return M.micro_scores(M.confusion(lang_scored(spark, sf_dir)))


@query("A11_per_class_report", f"""
WITH c AS ({SQL_LANG_CONF}),
cls AS (SELECT label AS cls FROM c UNION SELECT prediction FROM c),
per AS (SELECT cls AS class,
   coalesce((SELECT sum(n) FROM c WHERE label = cls AND prediction = cls), 0) AS tp,
   coalesce((SELECT sum(n) FROM c WHERE prediction = cls), 0) AS predicted,
   coalesce((SELECT sum(n) FROM c WHERE label = cls), 0) AS support FROM cls),
rep AS (SELECT class, {_div_sql('tp', 'predicted')} AS precision, {_div_sql('tp', 'support')} AS recall,
               {_div_sql('2 * tp', 'predicted + support')} AS f1, support::BIGINT AS support FROM per)
SELECT * FROM rep
UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support)::BIGINT FROM rep
UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
                 sum(f1 * support) / sum(support), sum(support)::BIGINT FROM rep
""")
def per_class_report(spark, sf_dir):
    """Per-language precision / recall / f1 / support with macro and weighted averages."""
    return M.per_class_report(M.confusion(lang_scored(spark, sf_dir)))


# ---------------------------------------------------------------- A12 / A13 multi-seed
def seed_runs(spark, sf_dir):
    """Long table (classifier, seed, metric, value): each rule scored on each seed's test split."""
    s = scored(spark, sf_dir)
    seeded = s.select("*", F.explode(F.array(*[F.lit(x) for x in SEEDS])).alias("seed"))
    h = F.pmod(F.pmod("doc_id", F.lit(1000003)) * F.lit(2654435761) + (F.col("seed") + 1) * F.lit(40503), F.lit(1000003)) \
        / F.lit(1000003.0)
    test = seeded.filter(h < TEST_FRACTION)
    long = test.select("quality", "seed", F.explode(F.array(*[
        F.struct(F.lit(n).alias("classifier"), F.col(n).alias("pred")) for n in CLASSIFIERS])).alias("c")) \
        .select("quality", "seed", "c.classifier", "c.pred")
    wide = M.binary_metrics(M.binary_counts(long, "quality", "pred", 1, "classifier", "seed"))
    return M.to_long(wide, ["classifier", "seed"])


SQL_SEED_RUNS = f"""
WITH s AS (SELECT * FROM ({SQL_SCORED}), (VALUES {', '.join(f'({x})' for x in SEEDS)}) v(seed)
           WHERE {sql_split_hash('doc_id', 'seed')} < {TEST_FRACTION}),
l AS ({' UNION ALL '.join(f"SELECT '{n}' AS classifier, seed, quality, {n} AS pred FROM s" for n in CLASSIFIERS)}),
w AS ({_metrics_sql("SELECT classifier, seed, " + _bin_sql("pred") + " FROM l GROUP BY classifier, seed")})
UNPIVOT w ON accuracy, precision, recall, f1, fpr INTO NAME metric VALUE value
"""


@query("A12_seed_mean_variance", f"""
WITH r AS (SELECT classifier, seed, metric, value FROM ({SQL_SEED_RUNS}))
SELECT classifier, metric, avg(value) AS mean, var_samp(value) AS variance, count(*)::BIGINT AS runs
FROM r GROUP BY classifier, metric
""")
def seed_mean_variance(spark, sf_dir):
    """Mean and sample variance of each metric over five seeded 30 % test splits."""
    return M.seed_summary(seed_runs(spark, sf_dir))


@query("A13_best_flags", f"""
WITH r AS (SELECT classifier, seed, metric, value FROM ({SQL_SEED_RUNS})),
s AS (SELECT classifier, metric, round(avg(value), 9) AS mean FROM r GROUP BY classifier, metric)
SELECT classifier, metric, mean, mean = (CASE WHEN metric = 'fpr' THEN min(mean) OVER (PARTITION BY metric)
                                        ELSE max(mean) OVER (PARTITION BY metric) END) AS is_best FROM s
""")
def best_flags(spark, sf_dir):
    """Best rule per metric (highest mean; lowest for FPR)."""
    summ = M.seed_summary(seed_runs(spark, sf_dir)).select(
        "classifier", "metric", F.round("mean", 9).alias("mean"))
    return M.best_flags(summ)


_M12_LONG = " UNION ALL ".join(f"SELECT '{name}' AS classifier, quality, {name} AS pred, {sql_split_hash('doc_id', '42')} < {TEST_FRACTION} AS held_out FROM ({SQL_SCORED})" for name in CLASSIFIERS)


@query("M12_weighted_score", f"""
WITH c AS ({_M12_LONG}),
t AS (SELECT classifier, avg((quality = pred)::INTEGER) AS train_accuracy FROM c WHERE NOT held_out GROUP BY 1),
m AS ({_metrics_sql("SELECT classifier, " + _bin_sql("pred") + " FROM c WHERE held_out GROUP BY classifier")})
SELECT classifier, accuracy, train_accuracy, precision, recall, f1, fpr,
       0.1 * precision + 0.2 * recall + 0.6 * f1 + 0.0 * fpr - 0.1 * (train_accuracy - accuracy) AS weighted_score
FROM m JOIN t USING (classifier)
""")
def custom_score(spark, sf_dir):
    """The weighted selection score (0.1 P + 0.2 R + 0.6 F1 + 0 FPR - 0.1 overfit) per rule on the
    held-out part, overfit being the accuracy on the training part less that on the held-out part."""
    s = scored(spark, sf_dir).withColumn("held_out", split_hash("doc_id", 42) < TEST_FRACTION)
    long = s.select("quality", "held_out", F.explode(F.array(*[
        F.struct(F.lit(n).alias("classifier"), F.col(n).alias("pred")) for n in CLASSIFIERS])).alias("c")) \
        .select("quality", "held_out", "c.classifier", "c.pred")
    both = M.binary_metrics(M.binary_counts(long, "quality", "pred", 1, "classifier", "held_out"))
    train = both.filter(~F.col("held_out")).select("classifier", F.col("accuracy").alias("train_accuracy"))
    m = M.weighted_score(both.filter("held_out").join(train, "classifier"), "train_accuracy")
    return m.select("classifier", "accuracy", "train_accuracy", "precision", "recall", "f1", "fpr", "weighted_score")


# ---------------------------------------------------------------- A18 class balance
@query("A18_class_weight", """
SELECT count(*)::BIGINT AS total, sum(quality)::BIGINT AS benign,
       100 - 100 * sum(quality)::DOUBLE / count(*) AS positive_weight FROM labels
""")
def class_weight(spark, sf_dir):
    """Positive-class weight 100 - 100 * benign / total (benign = quality 1)."""
    lab = table(spark, sf_dir, "labels")
    return lab.agg(F.count(F.lit(1)).alias("total"), F.sum("quality").cast("long").alias("benign")) \
        .withColumn("positive_weight", 100 - 100 * F.col("benign").cast("double") / F.col("total"))


# ---------------------------------------------------------------- attribution reports
ATTR_FEATURES = {  # name -> (Spark value, SQL value), centred so signs vary
    "quantity": (lambda: (F.col("l_quantity") - 25) / 25, "(l_quantity - 25) / 25"),
    "discount": (lambda: (F.col("l_discount") - 0.05) * 10, "(l_discount - 0.05) * 10"),
    "tax": (lambda: (F.col("l_tax") - 0.04) * 10, "(l_tax - 0.04) * 10"),
    "price": (lambda: (F.col("l_extendedprice") - 30000) / 30000, "(l_extendedprice - 30000) / 30000"),
}


def attributions(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    pre = F.concat(F.lower("l_linestatus"), F.lit("_"))
    return li.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("sample_id"),
        F.explode(F.array(*[F.struct(F.concat(pre, F.lit(n)).alias("feature"), f().cast("double").alias("value"))
                            for n, (f, _) in ATTR_FEATURES.items()])).alias("a")) \
        .select("sample_id", "a.feature", "a.value")


SQL_ATTR = " UNION ALL ".join(
    f"SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS sample_id, lower(l_linestatus) || '_{n}' AS feature, "
    f"({sql})::DOUBLE AS value FROM lineitem" for n, (_, sql) in ATTR_FEATURES.items())
SQL_MEAN_ABS = f"SELECT feature, avg(abs(value)) AS mean_abs FROM ({SQL_ATTR}) GROUP BY feature"


@query("A14_mean_abs_attribution", SQL_MEAN_ABS)
def mean_abs_attribution(spark, sf_dir):
    """Mean absolute attribution per feature."""
    return X.mean_abs(attributions(spark, sf_dir))


@query("A15_prefix_mean_attribution", f"""
SELECT regexp_extract(feature, '^[a-z]+_', 0) AS prefix, avg(mean_abs) AS prefix_mean_abs,
       count(*)::BIGINT AS n_features FROM ({SQL_MEAN_ABS}) GROUP BY 1
""")
def prefix_mean_attribution(spark, sf_dir):
    """Mean of A14 per feature prefix."""
    return X.prefix_means(X.mean_abs(attributions(spark, sf_dir)))


TOP_K = 3


@query("A16_topk_per_prefix", f"""
WITH m AS ({SQL_MEAN_ABS}),
t AS (SELECT feature FROM m ORDER BY mean_abs DESC, feature LIMIT {TOP_K})
SELECT p.prefix, count(t.feature)::BIGINT AS n_top
FROM (SELECT DISTINCT regexp_extract(feature, '^[a-z]+_', 0) AS prefix FROM m) p
LEFT JOIN t ON regexp_extract(t.feature, '^[a-z]+_', 0) = p.prefix GROUP BY p.prefix
""")
def topk_per_prefix(spark, sf_dir):
    """How many of the top-3 features each prefix holds."""
    return X.top_k_per_prefix(X.mean_abs(attributions(spark, sf_dir)), TOP_K)


@query("T1_top_features", f"SELECT * FROM ({SQL_MEAN_ABS}) ORDER BY mean_abs DESC, feature LIMIT 5")
def top_features(spark, sf_dir):
    """The five features with the largest mean |attribution|."""
    return X.top_k(X.mean_abs(attributions(spark, sf_dir)), 5)


@query("T1_bottom_features", f"SELECT * FROM ({SQL_MEAN_ABS}) ORDER BY mean_abs ASC, feature LIMIT 5")
def bottom_features(spark, sf_dir):
    """The five features with the smallest mean |attribution|."""
    return X.top_k(X.mean_abs(attributions(spark, sf_dir)), 5, ascending=True)


SQL_STRONGEST = f"""SELECT sample_id, feature, value FROM (
  SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY abs(value) DESC, feature DESC, value DESC) AS rk
  FROM ({SQL_ATTR})) WHERE rk = 1"""


@query("T3_strongest_feature", SQL_STRONGEST)
def strongest_feature(spark, sf_dir):
    """Per sample, the feature with the largest |attribution| and its value."""
    return X.strongest_feature(attributions(spark, sf_dir))


@query("A17_feature_summary", f"""
WITH s AS (SELECT sample_id, feature, value, round(value, 2) AS v FROM ({SQL_STRONGEST})),
c AS (SELECT feature, v, count(*) AS c FROM s GROUP BY feature, v),
m AS (SELECT feature, arg_max(v, (c, -v)) AS modal_value, sum(c)::BIGINT AS n_samples FROM c GROUP BY feature)
SELECT s.feature, s.sample_id, s.value, m.modal_value, m.n_samples FROM s JOIN m ON s.feature = m.feature
""")
def feature_summary(spark, sf_dir):
    """Per strongest feature, its modal value and sample count, exploded back per sample."""
    return X.feature_summary(X.strongest_feature(attributions(spark, sf_dir)))


@query("A19_minmax_importance", f"""
SELECT feature, mean_abs, CASE WHEN max(mean_abs) OVER () = min(mean_abs) OVER () THEN 0.0
  ELSE (mean_abs - min(mean_abs) OVER ()) / (max(mean_abs) OVER () - min(mean_abs) OVER ()) END AS normalised
FROM ({SQL_MEAN_ABS})
""")
def minmax_importance(spark, sf_dir):
    """Min-max normalised importance vector."""
    return X.min_max_normalise(X.mean_abs(attributions(spark, sf_dir)))
