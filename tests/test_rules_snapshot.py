"""Rules by an index of literals, and the keyed snapshot."""

from __future__ import annotations

import random
import re
import tempfile

import pytest

from domlens.operators import rules as R
from domlens.operators import setops as S
from domlens.sources.snapshot import KeyedSnapshot


@pytest.mark.parametrize("rule,literal", [("^blog\\.", "blog."), ("abc?def", "def"), ("ab+cd", "ab"), ("(casino|pills)", ""), ("x|abcdef", ""), ("a[^]bc]xyz", "xyz"), ("shop[0-9]*\\.com$", "shop"),
                                          ("\\d+longword\\w", "longword"), ("abc{0,2}de", "ab"), ("(abc)?def", "def"), ("", ""), ("[abc", ""), ("www\\.a.b", "www.a")])
def test_required_literal(rule, literal):
    assert R.required_literal(rule) == literal


def test_many_rules_are_the_expression(spark):
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 6))) for _ in range(400)]
    names = [f"{rng.choice(words)}{rng.choice(['', '-', '.'])}{rng.choice(words)}.{rng.choice(['com', 'net', 'org'])}" for _ in range(1500)] + [None, "", "ab", "a.com"] * 3
    rules = [f"^{w}\\.|{w}$" if i % 50 == 0 else f"{w}[.-]{rng.choice(words)}" if i % 3 else f"^{w}.*net$" for i, w in enumerate(words * 8)]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "id long, name string").repartition(3)
    got = {r["id"]: (r["rule_no"], r["rule"]) for r in R.tag_many_rules(df, "name", rules).collect()}
    plain = [re.compile(r) for r in rules]
    for i, n in enumerate(names):
        first = next((k for k, r in enumerate(plain, 1) if n is not None and r.search(n)), None)
        assert got[i] == (first, rules[first - 1] if first else None)
    short = rules[:60]
    assert sorted(map(tuple, R.tag_many_rules(df, "name", short).collect()), key=str) == sorted(map(tuple, R.tag_rules(df, "name", short).collect()), key=str)
    assert R.tag_many_rules(df.limit(0), "name", rules[:5]).collect() == []


def test_lookup_copies(spark):
    names = spark.createDataFrame([("a",), ("a",), ("b",), (None,)] + [("hot",)] * 50, "domain_name string")
    table = spark.createDataFrame([("a", 1), ("a", 2), ("c", 3), (None, 4)] + [("hot", 5)] * 7, "domain_name string, v int")
    assert sorted(map(tuple, S.lookup_copy(names, table).collect())) == sorted([("a", 1), ("a", 2)] * 2 + [("hot", 5)] * 350)


def test_snapshot_survives_a_cut_off_batch(spark, monkeypatch):
    root = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    t = KeyedSnapshot(spark, f"{root}/t", "k", "o", buckets=8)

    def frame(*rows):
        return spark.createDataFrame(rows, "k string, o long, v string")

    def now():
        return sorted(((r["k"], r["v"]) for r in t.rows().collect()), key=str)

    assert t.rows() is None and t.merge(frame(("a", 2, "a2"), ("a", 1, "a1"), ("b", 1, "b1"), (None, 1, "n")), "one")
    assert now() == sorted([("a", "a1"), ("b", "b1"), (None, "n")], key=str)
    assert not t.merge(frame(("z", 1, "z")), "one")  # merged before
    commit = KeyedSnapshot._commit
    monkeypatch.setattr(KeyedSnapshot, "_commit", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
    with pytest.raises(RuntimeError):
        t.merge(frame(("a", 0, "a0"), ("c", 1, "c1")), "two")
    assert now() == sorted([("a", "a1"), ("b", "b1"), (None, "n")], key=str)  # nothing changed
    monkeypatch.setattr(KeyedSnapshot, "_commit", commit)
    before = {r["bucket"]: r["path"] for r in t._manifest() if r["bucket"] >= 0}
    assert t.merge(frame(("a", 0, "a0"), ("c", 1, "c1")), "two")
    assert now() == sorted([("a", "a1"), ("b", "b1"), ("c", "c1"), (None, "n")], key=str)
    after = {r["bucket"]: r["path"] for r in t._manifest() if r["bucket"] >= 0}
    assert sum(after.get(b) == p for b, p in before.items()) >= len(before) - 2  # other buckets stay where they are
    assert sorted(r["k"] for r in t.new_keys(frame(("a", 9, ""), ("d", 9, ""))).collect()) == ["d"]
    assert t.merge(frame(("q", 1, "q")).limit(0), "empty") and len(now()) == 4
