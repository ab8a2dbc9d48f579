"""Catalog: boosted trees, kernel machine, net, grid search, exact ranking quality and attributions.

Trees of given splits and scores by rule have DuckDB twins in full; of fitted models the twins state what
does not hang on the fit: the rows of each fold and class.
"""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ..operators import attribution as AT
from ..operators import boosting as B
from ..operators import explain as X
from ..operators import kernel as K
from ..operators import metrics as M
from ..operators import ml as ML
from ..operators import network as N
from ..operators import ranking as R
from ..operators import trees as T
from ..operators import tuning as G
from ..operators.blocks import saved
from .bindings import table
from .catalog import query
from .catalog_ml import SQL_VECTORS, parts, sql_histogram, vectors
from .catalog_ml import _seed_runs as seed_runs

# ---------------------------------------------------------------- M17: attributions by tree, row by row
PAIRS = 32


def tree_attributions(spark, sf_dir):
    """Attributions of every embedding by the mean of 32 trees of given splits: dimension 2j, then 2j + 1, at 0."""
    df, names = vectors(spark, sf_dir)
    short = {n: ("lo_" if i < PAIRS else "hi_") + n for i, n in enumerate(names)}
    df = df.withColumnsRenamed(short)
    pairs = [((short[a], 0.0), (short[b], 0.0)) for a, b in zip(names[::2], names[1::2])]
    model = T.fixed_trees(df, pairs, "label")
    return AT.attributions(df, model, "vec_id"), model.features


def tree_attributions_long(spark, sf_dir):
    return AT.long_form(*tree_attributions(spark, sf_dir))


SQL_TREES = f"""
e AS (SELECT vec_id, (label < 5)::INT::DOUBLE AS y, embedding AS x FROM embeddings),
t AS (SELECT vec_id, y, j, (x[2 * j + 1] > 0)::INT AS a, (x[2 * j + 2] > 0)::INT AS b FROM e, range({PAIRS}) r(j)),
c AS (SELECT j, a, b, count(*) AS n, avg(y) AS v FROM t GROUP BY ALL),
ea AS (SELECT j, a, sum(n) AS n, sum(n * v) / sum(n) AS v FROM c GROUP BY ALL),
e0 AS (SELECT j, sum(n) AS n, sum(n * v) / sum(n) AS v FROM c GROUP BY ALL),
eb AS (SELECT c.j, c.b, sum(ea.n / e0.n * c.v) AS v FROM c JOIN ea ON ea.j = c.j AND ea.a = c.a JOIN e0 ON e0.j = c.j GROUP BY ALL),
p AS (SELECT vec_id, j, e0.v AS base, c.v AS leaf, 0.5 * (ea.v - e0.v + c.v - eb.v) / {PAIRS} AS va, 0.5 * (eb.v - e0.v + c.v - ea.v) / {PAIRS} AS vb
      FROM t JOIN c USING (j, a, b) JOIN ea ON ea.j = t.j AND ea.a = t.a JOIN eb ON eb.j = t.j AND eb.b = t.b JOIN e0 ON e0.j = t.j),
f AS (SELECT vec_id AS sample_id, 2 * j AS dim, va AS value FROM p UNION ALL SELECT vec_id, 2 * j + 1, vb FROM p),
attr AS (SELECT sample_id, CASE WHEN dim < {PAIRS} THEN 'lo_e' ELSE 'hi_e' END || dim AS feature, value FROM f),
imp AS (SELECT feature, avg(abs(value)) AS mean_abs FROM attr GROUP BY feature)
"""


@query("M17_tree_attributions", f"""WITH {SQL_TREES},
m AS (SELECT vec_id AS sample_id, avg(base) AS expected, avg(leaf) AS margin FROM p GROUP BY vec_id)
SELECT sample_id, feature, value, expected, margin FROM attr JOIN m USING (sample_id)
""")
def attributions(spark, sf_dir):
    """Exact Shapley values of every row and feature; they sum to margin - expected."""
    found, features = tree_attributions(spark, sf_dir)
    names = F.array(*[F.lit(f) for f in features])
    return found.select("sample_id", "expected", "margin", F.posexplode("values").alias("at", "value")).select("sample_id", F.get(names, F.col("at")).alias("feature"), "value", "expected", "margin")


@query("M17_A14_mean_abs", f"WITH {SQL_TREES} SELECT * FROM imp")
def attribution_means(spark, sf_dir):
    """A14 of tree attributions: mean absolute value of each feature."""
    return X.mean_abs(tree_attributions_long(spark, sf_dir))


@query("M17_A15_prefix_means", f"WITH {SQL_TREES} SELECT regexp_extract(feature, '^[a-z]+_') AS prefix, avg(mean_abs) AS prefix_mean_abs, count(*) AS n_features FROM imp GROUP BY 1")
def attribution_prefixes(spark, sf_dir):
    """A15 of tree attributions."""
    return X.prefix_means(X.mean_abs(tree_attributions_long(spark, sf_dir)))


@query("M17_T1_top_features", f"WITH {SQL_TREES} SELECT * FROM imp ORDER BY mean_abs DESC, feature LIMIT 20")
def attribution_top(spark, sf_dir):
    """T1 of tree attributions: the 20 features of the largest mean absolute value."""
    return X.top_k(X.mean_abs(tree_attributions_long(spark, sf_dir)), 20)


@query("M17_A16_top_per_prefix", f"""WITH {SQL_TREES}, top AS (SELECT feature FROM imp ORDER BY mean_abs DESC, feature LIMIT 20)
SELECT regexp_extract(feature, '^[a-z]+_') AS prefix, count(*) FILTER (feature IN (SELECT feature FROM top)) AS n_top FROM imp GROUP BY 1
""")
def attribution_top_per_prefix(spark, sf_dir):
    """A16 of tree attributions: how many of the 20 largest each prefix has."""
    return X.top_k_per_prefix(X.mean_abs(tree_attributions_long(spark, sf_dir)), 20)


def _steady(attr):
    """Values to 9 places, so that the strongest feature doesn't hang on the order of a sum."""
    return attr.withColumn("value", F.round("value", 9))


SQL_STRONGEST = "strong AS (SELECT sample_id, feature, round(value, 9) AS value FROM attr QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY abs(round(value, 9)) DESC, feature DESC, round(value, 9) DESC) = 1)"


@query("M17_T3_strongest_feature", f"WITH {SQL_TREES}, {SQL_STRONGEST} SELECT sample_id, feature, value FROM strong")
def attribution_strongest(spark, sf_dir):
    """T3 of tree attributions: each row's strongest feature."""
    return X.strongest_feature(_steady(tree_attributions_long(spark, sf_dir)))


@query("M17_A17_feature_summary", f"""WITH {SQL_TREES}, {SQL_STRONGEST},
r AS (SELECT *, round(value, 4) AS v FROM strong),
modes AS (SELECT feature, v, count(*) AS c FROM r GROUP BY ALL),
best AS (SELECT feature, v AS modal_value, sum(c) OVER (PARTITION BY feature)::BIGINT AS n_samples FROM modes QUALIFY row_number() OVER (PARTITION BY feature ORDER BY c DESC, v) = 1)
SELECT feature, sample_id, value, modal_value, n_samples FROM r JOIN best USING (feature)
""")
def attribution_summary(spark, sf_dir):
    """A17 of tree attributions: per strongest feature its modal value and its rows."""
    return X.feature_summary(X.strongest_feature(_steady(tree_attributions_long(spark, sf_dir))), digits=4)


@query("M17_forest_attributions", f"""{SQL_VECTORS} SELECT vec_id AS sample_id, true AS sums_to_margin FROM p WHERE held_out AND dim = 0""")
def forest_attributions(spark, sf_dir):
    """Attributions of a fitted forest (40 entropy trees, depth 8) for every held-out row; whether they sum to
    what the forest returns beyond its expectation."""
    df, features = vectors(spark, sf_dir)
    train, test = parts(df)
    model = Pipeline(stages=[ML.assemble(features), ML.random_forest(40, 8)]).fit(train)
    found = AT.attributions(test, T.from_spark(model.stages[-1], features), "vec_id", output=1)
    total = F.aggregate("values", F.lit(0.0), lambda a, v: a + v)
    return found.select("sample_id", (F.abs(F.col("margin") - F.col("expected") - total) < 1e-9).alias("sums_to_margin"))


# ---------------------------------------------------------------- M7 / M8: boosting
ROUNDS = 40        # of the queries' AdaBoost; the original has 320
SOFTMAX_ROUNDS = 20


def _class_counts(scored, name):
    """What a fitted model leaves as it is: held-out rows by true class."""
    return scored.groupBy("label").agg(F.count("prediction").alias("n")).select(F.lit(name).alias("classifier"), "label", "n")


def _sql_class_counts(names: dict[str, str]) -> str:
    """Held-out rows by class for classifiers over ``label < 5`` or over all labels."""
    each = []
    for name, label in names.items():
        h = sql_histogram("embeddings", label, "vec_id", 42)
        each.append(f"SELECT '{name}' AS classifier, label::DOUBLE AS label, sum(CASE WHEN last <= round(n_class * 0.3) THEN n ELSE 0 END)::BIGINT AS n FROM ({h}) GROUP BY label "
                    "HAVING sum(CASE WHEN last <= round(n_class * 0.3) THEN n ELSE 0 END) > 0")
    return " UNION ALL ".join(each)


def adaboost(df, features, rounds=320):
    """M7: AdaBoost of trees of depth 3, split from 5 rows on."""
    return B.fit(df, features, "label", B.AdaBoost(2), rounds, 3, split_rows=5)


def _ada_scored(spark, sf_dir):
    df, features = vectors(spark, sf_dir)
    train, test = parts(df)
    model = adaboost(train, features, ROUNDS)
    votes = T.margins(test, model.ensemble, ["vec_id", "label"])
    return model, votes.withColumn("prediction", (F.get("margin", F.lit(1)) > F.get("margin", F.lit(0))).cast("double"))


@query("M7_adaboost")
def adaboost_scores(spark, sf_dir):
    """M7: metrics of AdaBoost on the held-out rows."""
    return ML.evaluate(_ada_scored(spark, sf_dir)[1]).select(F.lit("adaboost").alias("classifier"), *M.METRICS)


@query("M7_adaboost_counts", _sql_class_counts({"adaboost": "(label < 5)"}))
def adaboost_counts(spark, sf_dir):
    """M7: held-out rows that AdaBoost gave a verdict, by true class."""
    return _class_counts(_ada_scored(spark, sf_dir)[1], "adaboost")


def softmax_trees(df, features, classes, rounds=400, least_rows=27):
    """M8: gradient boosting on the softmax objective, 31 leaves a tree at most, at least 27 rows in each."""
    return B.fit(df, features, "label", B.Softmax(classes, ridge=0.1), rounds, 20, least_rows=least_rows, max_leaves=31)


def _softmax_scored(spark, sf_dir):
    df, features = vectors(spark, sf_dir, binary=False)
    train, test = parts(df)
    model = softmax_trees(train, features, 10, SOFTMAX_ROUNDS, least_rows=5)
    scored = T.margins(test, model.ensemble, ["vec_id", "label"])
    return model, scored.withColumn("prediction", (F.array_position("margin", F.array_max("margin")) - 1).cast("double"))


@query("M8_softmax_boosting")
def softmax_scores(spark, sf_dir):
    """M8: micro scores of ten-class boosting on the held-out rows, and the log loss of the training rows before
    the first and the last round."""
    model, scored = _softmax_scored(spark, sf_dir)
    found = M.micro_scores(M.confusion(scored))
    return found.select(F.lit("softmax_trees").alias("classifier"), "*", F.lit(model.losses[0]).alias("first_loss"), F.lit(model.losses[-1]).alias("last_loss"))


@query("M8_softmax_counts", _sql_class_counts({"softmax_trees": "label"}))
def softmax_counts(spark, sf_dir):
    """M8: held-out rows that the boosted trees gave a class, by true class."""
    return _class_counts(_softmax_scored(spark, sf_dir)[1], "softmax_trees")


# ---------------------------------------------------------------- M4: radial kernel; M10: ReLU net
def _kernel_scored(spark, sf_dir):
    df, features = vectors(spark, sf_dir)
    train, test = parts(df)
    scaler = Pipeline(stages=[ML.assemble(features, "raw"), ML.minmax_scaler("raw", "scaled")]).fit(train)

    def scaled(rows):
        x = scaler.transform(rows).select("vec_id", "label", vector_to_array("scaled").alias("x"))
        return x.select("vec_id", "label", *[F.get("x", F.lit(i)).alias(n) for i, n in enumerate(features)])

    mapping = K.fit_kernel_map(scaled(train), features, "vec_id", gamma=0.1)
    z = saved(K.with_kernel_features(scaled(train), features, mapping, ["vec_id", "label"]), "kernel")  # read again in each iteration
    model = ML.linear_svc(train.count(), 59.0).fit(z)
    return model.transform(K.with_kernel_features(scaled(test), features, mapping, ["vec_id", "label"]))


@query("M4_rbf_svm")
def rbf_svm(spark, sf_dir):
    """M4: SVM with the radial kernel (gamma 0.1, C 59) on min-max scaled features, held-out metrics."""
    return ML.evaluate(_kernel_scored(spark, sf_dir)).select(F.lit("rbf_svm").alias("classifier"), *M.METRICS)


def _net_scored(spark, sf_dir):
    df, features = vectors(spark, sf_dir)
    train, test = parts(df)
    net, losses = N.fit(train, features, "label", N.LAYERS, steps=24, batches=2)
    return losses, N.score(test, net, features, ["vec_id", "label"])


@query("M10_relu_net")
def relu_net(spark, sf_dir):
    """Net with ReLU layers of 2500, 600 and 200 and a sigmoid output, held-out metrics at 0.5."""
    return ML.evaluate(_net_scored(spark, sf_dir)[1]).select(F.lit("relu_net").alias("classifier"), *M.METRICS)


@query("M4_M10_counts", _sql_class_counts({"rbf_svm": "(label < 5)", "relu_net": "(label < 5)"}))
def kernel_and_net_counts(spark, sf_dir):
    """Held-out rows that the kernel machine and the net gave a verdict, by true class."""
    return _class_counts(_kernel_scored(spark, sf_dir), "rbf_svm").unionByName(_class_counts(_net_scored(spark, sf_dir)[1], "relu_net"))


# ---------------------------------------------------------------- M9: closed form
@query("M9_nb_closed_form", f"""{SQL_VECTORS},
eps AS (SELECT 1e-9 * max(v) AS eps FROM (SELECT dim, var_pop(x) AS v FROM p WHERE NOT held_out GROUP BY dim)),
g AS (SELECT label, dim, avg(x) AS mean, var_pop(x) + any_value(eps) AS v FROM p, eps WHERE NOT held_out GROUP BY label, dim),
n AS (SELECT label, count(*) AS n FROM p WHERE NOT held_out AND dim = 0 GROUP BY label),
s AS (SELECT p.vec_id, any_value(p.label) AS truth, g.label, sum(-0.5 * ln(2 * pi() * v) - (x - mean) ** 2 / (2 * v)) + any_value(ln(n.n / (SELECT sum(n) FROM n))) AS score
      FROM p JOIN g ON p.dim = g.dim JOIN n ON n.label = g.label WHERE held_out GROUP BY p.vec_id, g.label)
SELECT vec_id, any_value(truth)::INT::DOUBLE AS label, (arg_max(label, score))::INT::DOUBLE AS prediction FROM s GROUP BY vec_id
""")
def naive_bayes_rows(spark, sf_dir):
    """M9: the verdict of Gaussian naive Bayes on every held-out row."""
    df, features = vectors(spark, sf_dir)
    train, test = parts(df)
    return ML.score(Pipeline(stages=[ML.assemble(features), ML.gaussian_nb()]).fit(train), test).select("vec_id", "label", "prediction")


# ---------------------------------------------------------------- M15: exact area under the curve and log loss
SQL_RULES = """
rules AS (SELECT model, quality AS label, score FROM (SELECT quality, toxic, n_chars, doc_id FROM labels JOIN documents USING (doc_id)) d,
          LATERAL (VALUES ('length', n_chars / (n_chars + 500.0)), ('toxic', CASE WHEN toxic = 1 THEN 0.2 ELSE 0.7 END), ('id', (doc_id % 1000 + 0.5) / 1000.0)) v(model, score))
"""


def rule_scores(spark, sf_dir):
    """(model, score, label) of every labelled document: probabilities by three rules."""
    d = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    n = F.col("n_chars").cast("double")
    rules = F.explode(F.array(F.struct(F.lit("length").alias("model"), (n / (n + 500.0)).alias("score")),
                              F.struct(F.lit("toxic").alias("model"), F.when(F.col("toxic") == 1, 0.2).otherwise(0.7).alias("score")),
                              F.struct(F.lit("id").alias("model"), ((F.col("doc_id") % 1000 + 0.5) / 1000.0).alias("score"))))
    return d.select(rules.alias("r"), F.col("quality").alias("label")).select("r.model", "r.score", "label")


@query("M15_auc_log_loss", f"""WITH {SQL_RULES},
k AS (SELECT model, label, score::DOUBLE AS score FROM rules),
r AS (SELECT *, (rank() OVER (PARTITION BY model ORDER BY score) + rank() OVER (PARTITION BY model ORDER BY score) + count(*) OVER (PARTITION BY model, score) - 1) / 2.0 AS mid FROM k),
a AS (SELECT model, count(*) FILTER (label = 1) AS n_pos, count(*) FILTER (label <> 1) AS n_neg, sum(mid) FILTER (label = 1) AS ranks,
             avg(-CASE WHEN label = 1 THEN ln(score) ELSE ln(1 - score) END) AS log_loss, avg(((label = 1) <> (score > 0.5))::INT) AS error FROM r GROUP BY model)
SELECT model, n_pos, n_neg, (ranks - n_pos * (n_pos + 1) / 2.0) / (n_pos::DOUBLE * n_neg) AS auc, log_loss, error FROM a
""")
def auc_log_loss(spark, sf_dir):
    """Exact area under the curve, log loss and error of three scores by rule, in one scoring."""
    return R.report(rule_scores(spark, sf_dir))


# ---------------------------------------------------------------- M11 + M12: grid search by the weighted score
GRID = [{"regParam": v} for v in (0.0001, 0.01, 1.0)]
FOLDS = 5


def _grid(spark, sf_dir):
    df, features = vectors(spark, sf_dir)
    df = ML.assemble(features).transform(ML.with_fold(df, "label", F.col("vec_id"), FOLDS, seed=7)).select("vec_id", "label", "fold", "features")
    return G.grid_scores(ML.logistic_regression(1), GRID, df, "fold", FOLDS)


@query("M11_grid_folds", f"""
WITH h AS (SELECT label, floor(first * {FOLDS} / n_class)::INT AS fold, n FROM ({sql_histogram('embeddings', '(label < 5)', 'vec_id', 7)})),
f AS (SELECT label, fold, sum(n) AS n FROM h GROUP BY ALL)
SELECT point::INT AS point, k::INT AS fold, CASE WHEN f.fold = k THEN 'test' ELSE 'train' END AS side, sum(n)::BIGINT AS n,
       sum(CASE WHEN label THEN n ELSE 0 END)::BIGINT AS positives
FROM f, range({len(GRID)}) p(point), range({FOLDS}) r(k) GROUP BY ALL
""")
def grid_folds(spark, sf_dir):
    """Rows and positives of every grid point, fold and side, as the confusion rows have them."""
    return _grid(spark, sf_dir).select("point", "fold", "side", "n", (F.col("tp") + F.col("fn")).alias("positives"))


@query("M11_M12_best_point")
def best_point(spark, sf_dir):
    """M11 + M12: mean weighted score on the folds left out, mean F1 on the rows fitted on, and the best grid point."""
    return G.best_point(_grid(spark, sf_dir))


# ---------------------------------------------------------------- M3, M5, M6, M13: what doesn't hang on the fit
_PLAIN = {
    "logreg": lambda n: ML.logistic_regression(n), "tree": lambda n: ML.decision_tree(24), "depth_2": lambda n: ML.decision_tree(2), "depth_8": lambda n: ML.decision_tree(8),
    "forest": lambda n: ML.random_forest(20, 10),
}


@query("M3_M5_M6_M13_counts", _sql_class_counts(dict.fromkeys(_PLAIN, "(label < 5)")))
def plain_counts(spark, sf_dir):
    """Held-out rows that each model gave a verdict, by true class."""
    df, features = vectors(spark, sf_dir)
    train, test = parts(df)
    train, n, out = saved(ML.assemble(features).transform(train).select("label", "features"), "train"), train.count(), None
    test = saved(ML.assemble(features).transform(test).select("vec_id", "label", "features"), "test")
    for name, make in _PLAIN.items():
        part = _class_counts(ML.score(make(n).fit(train), test), name)
        out = part if out is None else out.unionByName(part)
    return out


@query("M6_forest_seeds")
def forest_seeds(spark, sf_dir):
    """M6 + A12: entropy forest (40 trees, depth 17) over three seeded splits."""
    return seed_runs(spark, sf_dir, "forest", lambda n, s: ML.random_forest(40, 17, seed=s))
