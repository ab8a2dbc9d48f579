"""Property and golden tests for the shared column functions."""

import hashlib
import math

import pytest
from pyspark.sql import functions as F

from domlens.functions import core as C


def py_norm_entropy(t):
    if not t:
        return 0.0
    cnt = {}
    for ch in t:
        cnt[ch] = cnt.get(ch, 0) + 1
    h = -sum((v / len(t)) * math.log(v / len(t), 2) for v in cnt.values())
    return h / len(t)


def py_simhash(t):
    v = [0] * 32
    for ch in t:
        h = int(hashlib.md5(ch.encode()).hexdigest(), 16)
        for i in range(32):
            v[i] += 1 if h >> i & 1 else -1
    return sum(1 << i for i in range(32) if v[i] >= 0)


WORDS = ["", "a", "aaaa", "example", "www.example.co.uk", "xn--mller-kva", "Supplier#000000079", "ÄÖÜ straße", "0123456789abcdef"]


@pytest.fixture(scope="module")
def words(spark):
    return spark.createDataFrame([(w,) for w in WORDS], "s string")


def test_entropy_and_hashes_match_plain_python(words):
    rows = words.select("s", C.norm_entropy(F.col("s")).alias("e"), C.simhash32(F.col("s")).alias("h"),
                        C.simhash32_expr(F.col("s")).alias("hx"), C.md5_mod(F.col("s")).alias("m")).collect()
    for r in rows:
        assert r["e"] == pytest.approx(py_norm_entropy(r["s"]), abs=1e-12)
        assert r["h"] == py_simhash(r["s"]) == r["hx"]
        assert r["m"] == int(hashlib.md5(r["s"].encode()).hexdigest(), 16) % 2147483647


def test_constant_string_entropy_is_zero_and_empty_simhash_all_ones(words):
    r = {x["s"]: x for x in words.select("s", C.norm_entropy(F.col("s")).alias("e"),
                                          C.simhash32(F.col("s")).alias("h")).collect()}
    assert r["aaaa"]["e"] == 0.0 and r[""]["e"] == 0.0
    assert r[""]["h"] == 4294967295


def test_array_statistics(spark):
    df = spark.createDataFrame([([1.0, None, 3.0],), (None,), ([],), ([5.0],)], "a array<double>")
    rows = df.select(C.arr_mean("a").alias("m"), C.arr_stddev("a").alias("s"), C.arr_min("a").alias("lo"),
                     C.arr_max("a").alias("hi"), C.arr_mean("a", empty=-1.0).alias("m3"),
                     C.value_entropy(C.non_null("a")).alias("h")).collect()
    assert [(r.m, r.s, r.lo, r.hi, r.m3) for r in rows] == [
        (2.0, 1.0, 1.0, 3.0, 2.0), (0.0, 0.0, 0.0, 0.0, -1.0), (0.0, 0.0, 0.0, 0.0, -1.0), (5.0, 0.0, 5.0, 5.0, 5.0)]
    assert rows[0].h == pytest.approx(1.0) and rows[3].h == 0.0


def test_half_even_rounding_of_days(spark):
    from domlens.operators.tls import validity_days
    df = spark.createDataFrame([(int(d * 86400),) for d in (0.5, 1.5, 2.5, -0.5, 10.4999)], "valid_len long")
    got = [r[0] for r in df.select(validity_days(F.struct("valid_len"))).collect()]
    assert got == [round(x) for x in (0.5, 1.5, 2.5, -0.5, 10.4999)]


def test_ipv6_canonical_forms_agree(spark):
    from domlens.operators.ip import ipv6_canonical, ipv6_prefix64
    df = spark.createDataFrame([("2001:db8::1",), ("2001:0DB8:0:0:0:0:0:1",), ("::ffff:1.2.3.4",), ("::",)], "ip string")
    rows = df.select(ipv6_canonical(F.col("ip")).alias("c"), ipv6_prefix64(F.col("ip")).alias("p")).collect()
    assert rows[0].c == rows[1].c == "2001:0db8:0000:0000:0000:0000:0000:0001"
    assert rows[2].c == "0000:0000:0000:0000:0000:ffff:0102:0304"
    assert rows[3].c == ":".join(["0000"] * 8) and rows[0].p == "2001:0db8:0000:0000"


def test_policy_oid_encoding_matches_big_integers(spark):
    from domlens.operators.tls import encode_policy
    oids = ["1.3.6.1.4.1.11129.2.5.3", "2.23.140.1.2.1", "1." + ".".join(str(i) for i in range(30, 60)), "", None]
    df = spark.createDataFrame([(o,) for o in oids], "o string")
    got = [r[0] for r in df.select(encode_policy(F.col("o"))).collect()]
    want = [int(o.replace(".", "")) % 2147483647 if o else 0 for o in oids]
    assert got == want


def test_ipv6_gap_positions(spark):
    import ipaddress

    from domlens.operators.ip import ipv6_canonical
    addrs = ["1::", "::1", "fe80::1:2", "2001:db8:0:0:1::", "a:b:c:d:e:f:1:2", "::"]
    df = spark.createDataFrame([(a,) for a in addrs], "ip string")
    got = [r[0] for r in df.select(ipv6_canonical(F.col("ip"))).collect()]
    assert got == [ipaddress.IPv6Address(a).exploded for a in addrs]


def test_entropies_sort_without_a_comparator(spark):
    """Entropies match plain Python, and no lambda compares the characters that are sorted."""
    def plain(v):
        return -sum(v.count(x) / len(v) * math.log2(v.count(x) / len(v)) for x in set(v)) if len(v) else 0.0

    texts = ["", "a", "aab", "www.example.com", "éa\nb\né"]
    lists = [[], [1], [3, 1, 3, 2], [7, 7]]
    df = spark.createDataFrame([(t, v) for t in texts for v in lists], "s string, v array<long>")
    out = df.select("s", "v", C.char_entropy("s").alias("hs"), C.value_entropy("v").alias("hv"))
    for r in out.collect():
        assert abs(r.hs - plain(r.s)) < 1e-12 and abs(r.hv - plain(r.v)) < 1e-12, r
    assert "array_sort(" not in out._jdf.queryExecution().optimizedPlan().toString()
