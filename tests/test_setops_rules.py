"""Set operations, rule filter and lexical split properties."""

from pyspark.sql import functions as F

from domlens.operators import rules as R
from domlens.operators import setops as S


def _t(spark, rows, cols="domain_name string, v int"):
    return spark.createDataFrame(rows, cols)


def test_keyed_union_and_fold(spark):
    a = _t(spark, [("x", 1), ("y", 2), (None, 3)])
    b = _t(spark, [("y", 20), ("z", 30), ("z", 31), (None, 32)]).select("v", "domain_name")
    u = sorted((str(r.domain_name), r.v) for r in S.keyed_union(a, b).collect())
    # b's NULL key matches a's NULL key (isin semantics); z keeps its duplicates
    assert u == sorted([("x", 1), ("y", 2), ("None", 3), ("z", 30), ("z", 31)])
    fold = S.keyed_union_fold([a, b])
    f = sorted((str(r.domain_name), r.v) for r in fold.collect())
    assert ("y", 2) in f and ("y", 20) not in f and ("None", 32) in f and ("None", 3) in f
    # idempotent for non-NULL keys (a NULL key never matches, so NULL-key rows accumulate)
    nn = fold.filter(F.col("domain_name").isNotNull())
    again = S.keyed_union_fold([nn, nn])
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, nn.collect()))


def test_semi_plus_anti_is_whole(spark):
    a = _t(spark, [("x", 1), ("y", 2), ("y", 3), ("q", 4)])
    b = _t(spark, [("y", 0), ("q", 0), ("w", 0)])
    assert S.semi_join(a, b).count() + S.anti_join(a, b).count() == a.count()


def test_merge_keep_first(spark):
    old = _t(spark, [("x", 5), ("x", 1)])
    new = _t(spark, [("x", 0), ("y", 9)])
    got = {r.domain_name: r.v for r in S.merge_keep_first(old, new, order="v").collect()}
    assert got == {"x": 1, "y": 9}


def test_rule_filter_first_match_and_comments(spark):
    rules = R.parse_rules(["# comment", "", r"^blog\.", r"example\.org$", r"^blog\.x"])
    assert rules == [r"^blog\.", r"example\.org$", r"^blog\.x"]
    df = _t(spark, [("blog.x.org", 1), ("m.example.org", 2), ("a.com", 3)])
    tagged = {r.domain_name: (r.rule_no, r.rule) for r in R.tag_rules(df, "domain_name", rules).collect()}
    assert tagged["blog.x.org"] == (1, r"^blog\.") and tagged["m.example.org"][0] == 2
    assert tagged["a.com"] == (None, None)
    hit, miss = R.split_by_rules(df, "domain_name", rules)
    assert hit.count() == 2 and miss.count() == 1


def test_metrics_cells_sum_to_rows(spark):
    from domlens.operators import metrics as M
    df = spark.createDataFrame([(1, 1), (1, 0), (0, 0), (0, 1), (1, 1), (2, 1)], "label int, prediction int")
    c = M.binary_counts(df).collect()[0]
    assert c.tn + c.fp + c.fn + c.tp == 6
    rep = {r["class"]: r for r in M.per_class_report(M.confusion(df)).collect()}
    assert rep["macro avg"].support == 6 and rep["2"].precision == 0.0
    m = M.binary_metrics(M.binary_counts(spark.createDataFrame([(0, 0)], "label int, prediction int"))).collect()[0]
    assert m.precision == 0.0 and m.recall == 0.0 and m.accuracy == 1.0


def test_ngram_matches_bounded_by_dictionary(spark, rules):
    from domlens.operators import ngrams as NG
    hosts = spark.createDataFrame([("www.paypal-login.example.com",), ("login.example.com",)], "domain_name string")
    d = NG.domain_ngram_dictionary(hosts, rules, "phishing", {2: 5, 3: 5, 4: 5, 5: 5})
    assert d.groupBy("n").count().filter(F.col("count") > 5).count() == 0
    txt = spark.createDataFrame([(1, "paypallogin"), (2, "zzzz"), (3, None)], "k int, t string")
    m = {r.k: r for r in NG.with_ngram_matches(txt, "t", d).collect()}
    assert 0 < m[1].lex_phishing_bigram_matches <= 5
    assert all(m[k][c] == 0 for k in (2, 3) for c in NG.match_columns())


def test_family_dictionaries_and_matches_are_brute_force(spark, rules):
    from collections import Counter

    from domlens.operators import ngrams as NG
    rows = [("paypal-login.example.com", ["a", "b"]), ("secure-login.bank.example.net", ["a"]), ("blog.example.org", ["b"]),
            ("blog.example.org", ["b"]), ("x.example.org", [])]
    top = {"a": {2: 7, 3: 4}, "b": {2: 5, 3: 100}}
    d = NG.family_ngram_dictionary(spark.createDataFrame(rows, "domain_name string, families array<string>"), rules, top)
    texts = {"paypal-login.example.com": "paypal-login.example", "secure-login.bank.example.net": "secure-login.bank.example",
             "blog.example.org": "blog.example", "x.example.org": "x.example"}
    want = set()
    for family, sizes in top.items():
        for n, k in sizes.items():
            counts = Counter(t[i:i + n] for name, f in rows if family in f for t in [texts[name]] for i in range(len(t) - n + 1))
            want |= {(family, n, g, c) for g, c in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:k]}
    assert {tuple(r) for r in d.select("family", "n", "gram", "cnt").collect()} == want
    names = ["paypallogin", "zzzz", "securebank", "", None]
    txt = spark.createDataFrame(list(enumerate(names)), "k int, t string")
    got = {r.k: r for r in NG.with_ngram_matches(txt, "t", d, {"a": (2, 3), "b": (3,)}).collect()}
    for k, t in enumerate(names):
        for family, n in (("a", 2), ("a", 3), ("b", 3)):
            grams = {(t or "")[i:i + n] for i in range(len(t or "") - n + 1)}
            assert got[k][NG.match_column_name(family, n)] == len(grams & {g for f, m, g, _ in want if (f, m) == (family, n)})
