"""Shared column expressions (N1-N10 of the survey).

Everything here returns a ``Column`` built from ``pyspark.sql.functions`` so it
stays inside the JVM; higher-order lambdas (``transform`` / ``aggregate``) are
used only where a string or array must be walked element by element.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: modulus of the reference's integer hashes (2**31 - 1).
HASH_MOD = 2147483647

_C = "Column | str"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def chars(s) -> Column:
    """Characters of a string as an array; '' -> [] and NULL -> NULL."""
    s = col(s)
    return F.when(s == "", F.array().cast("array<string>")).otherwise(F.split(s, ""))


def count_chars_matching(s, char_class: str) -> Column:
    """Number of characters of ``s`` matching a regex character class."""
    s = col(s)
    return F.char_length(s) - F.char_length(F.regexp_replace(s, f"(?s){char_class}", ""))


def count_chars_not_matching(s, char_class: str) -> Column:
    s = col(s)
    return F.char_length(F.regexp_replace(s, f"(?s){char_class}", ""))


def safe_ratio(num, den) -> Column:
    """num / den as double, 0.0 when den is 0 (the reference's `if len(x) > 0 else 0`)."""
    return F.when(den == 0, F.lit(0.0)).otherwise(num.cast("double") / den)


def run_lengths(arr) -> Column:
    """Counts of equal values of an array (one sort, one pass; NULL-free input)."""
    srt = F.sort_array(col(arr))
    init = F.struct(F.lit(None).cast("string").alias("prev"), F.lit(0).alias("run"),
                    F.array().cast("array<int>").alias("counts"))

    def step(acc, x):
        x = x.cast("string")
        same = acc["prev"] == x
        return F.struct(x.alias("prev"),
                        F.when(same, acc["run"] + 1).otherwise(F.lit(1)).alias("run"),
                        F.when(same | (acc["run"] == 0), acc["counts"])
                        .otherwise(F.concat(acc["counts"], F.array(acc["run"]))).alias("counts"))

    def finish(acc):
        return F.when(acc["run"] > 0, F.concat(acc["counts"], F.array(acc["run"]))).otherwise(acc["counts"])
    return F.aggregate(srt, init, step, finish)


def value_entropy(arr) -> Column:
    """Shannon entropy (bits) of the value distribution of an array; [] -> 0.0.

    Value counts come from one sort and one run-length pass over the array.
    """
    arr = col(arr)
    n = F.size(arr)
    shares = F.transform(run_lengths(arr), lambda c: c / n)
    h = F.aggregate(shares, F.lit(0.0), lambda acc, p: acc - p * F.log2(p))
    return F.when(n == 0, F.lit(0.0)).otherwise(h + F.lit(0.0))


def char_entropy(s) -> Column:
    """Shannon entropy in bits of the character distribution of ``s``; '' -> 0.

    The characters are sorted and re-joined, so each run of equal characters is
    one match of a back-referencing regex (generated code); the lambda then only
    visits one element per distinct character.
    """
    s = col(s)
    n = F.char_length(s)
    runs = F.regexp_extract_all(F.array_join(F.sort_array(F.split(s, "")), ""), F.lit(r"(?s)(.)\1*"), 0)
    shares = F.transform(runs, lambda r: F.char_length(r) / n)  # each once: a lambda computes what it repeats again
    h = F.aggregate(shares, F.lit(0.0), lambda a, p: a - p * F.log2(p))
    return F.when(n == 0, F.lit(0.0)).otherwise(h + F.lit(0.0))


def norm_entropy(s) -> Column:
    """Character entropy divided by string length (kept as the reference does); '' -> 0."""
    s = col(s)
    n = F.char_length(s)
    return F.when(n == 0, F.lit(0.0)).otherwise(char_entropy(s) / n)


def md5_mod(s) -> Column:
    """int(md5(s), 16) mod (2**31 - 1) without 128-bit integers.

    The 128-bit value is folded 32 bits at a time: acc = (acc * 2**32 + chunk) mod p.
    acc < 2**31, so acc * 2**32 + chunk < 2**63 and LONG arithmetic is exact.
    """
    h = F.md5(col(s))
    acc = F.lit(0).cast("long")
    for i in range(4):
        chunk = F.conv(F.substring(h, 8 * i + 1, 8), 16, 10).cast("long")
        acc = F.pmod(acc * F.lit(1 << 32) + chunk, F.lit(HASH_MOD))
    return acc


def simhash32(s) -> Column:
    """32-bit simhash over the characters of ``s`` (Arrow-batched helper, see
    ``pyhelpers.simhash32_udf``; ``simhash32_expr`` is the pure-expression form)."""
    from .pyhelpers import simhash32_udf
    return simhash32_udf(col(s))


def simhash32_expr(s) -> Column:
    """N9 as a pure expression: 32-bit simhash over the characters of ``s``.

    Bit i of the result is set when at least half of the characters' MD5 values
    have bit i set (sign-sum >= 0); the empty string gives 2**32 - 1.  One pass:
    each character's MD5 is computed once and added into 32 bit counters.
    """
    cs = chars(s)
    low = F.transform(cs, lambda c: F.conv(F.substring(F.md5(c), 25, 8), 16, 10).cast("long"))
    n = F.char_length(col(s))
    zeros = F.array_repeat(F.lit(0), 32)
    # bit i of h: (h div 2^i) mod 2 (shift amounts must be literals, so divide instead)
    counts = F.aggregate(low, zeros, lambda acc, h: F.transform(
        acc, lambda a, i: a + (F.floor(h / F.pow(F.lit(2.0), i)) % 2).cast("int")))
    bits = F.transform(counts, lambda c, i: F.when(c * 2 >= n, F.pow(F.lit(2.0), i).cast("long"))
                       .otherwise(F.lit(0).cast("long")))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a + b)


# ---------------------------------------------------------------- in-row array statistics
def non_null(arr) -> Column:
    """Drop NULL elements; NULL array -> []."""
    return F.coalesce(F.array_compact(col(arr)), F.array())


def arr_mean(arr, empty=0.0) -> Column:
    """Mean of the non-NULL values; NULL or no values -> ``empty``."""
    v = F.array_compact(col(arr))
    n = F.size(v)
    s = F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double"))
    return F.when(v.isNull() | (n == 0), F.lit(empty)).otherwise(s / n)


def arr_min(arr, empty=0.0) -> Column:
    v = F.array_compact(col(arr))
    return F.coalesce(F.array_min(v).cast("double"), F.lit(empty))


def arr_max(arr, empty=0.0) -> Column:
    v = F.array_compact(col(arr))
    return F.coalesce(F.array_max(v).cast("double"), F.lit(empty))


def arr_stddev(arr) -> Column:
    """Population standard deviation of the non-NULL values; NULL or <= 1 value -> 0.0."""
    v = F.array_compact(col(arr))
    n = F.size(v)
    mean = F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double")) / n
    ss = F.aggregate(v, F.lit(0.0), lambda a, x: a + (x.cast("double") - mean) * (x.cast("double") - mean))
    return F.when(v.isNull() | (n <= 1), F.lit(0.0)).otherwise(F.sqrt(ss / n))


def midnight(as_of: str | _dt.date | _dt.datetime | None = None) -> Column:
    """The snapshot timestamp.  Always a literal, never ``current_date()`` in a job."""
    if as_of is None:
        as_of = _dt.date.today()
    if isinstance(as_of, _dt.datetime):
        as_of = as_of.replace(hour=0, minute=0, second=0, microsecond=0)
        return F.lit(as_of.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp")
    if isinstance(as_of, _dt.date):
        return F.lit(as_of.isoformat()).cast("timestamp")
    return F.lit(str(as_of)).cast("timestamp")


def days_between(later, earlier) -> Column:
    """(later - earlier) in fractional days, from microsecond epochs."""
    return (F.unix_micros(col(later)) - F.unix_micros(col(earlier))).cast("double") / 86400e6


def count_labels(name) -> Column:
    """Number of dot-separated labels of a name."""
    return F.size(F.split(col(name), r"\."))
