"""Public-suffix split of host names (L1, L2) as a Spark job.

The rules are grouped to one row per last label ("tld") with the normal, wildcard and exception
rules below it.  Hosts join that table on their last label -- Spark broadcasts it below its own
threshold (the public list is ~10k rules), and beyond that splits a hot label's partition -- and the
longest matching rule is then picked per row with array expressions.  No Python, and no job runs
while the plan is built.
"""

from __future__ import annotations

import os
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .lexicon import IPV4_DOTTED

RULES_PATH = os.path.join(os.path.dirname(os.path.dirname(__file__)), "data", "public_suffix_rules.txt")

HOST_FROM_URL = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)"


def host_of_url(url) -> Column:
    """Host part of a URL (lower-cased), '' when the URL has no authority."""
    u = F.col(url) if isinstance(url, str) else url
    return F.lower(F.regexp_extract(u, HOST_FROM_URL, 1))


def read_rule_lines(path: str = RULES_PATH) -> list[str]:
    out = []
    with open(path, encoding="utf-8") as fh:
        for line in fh:
            line = line.strip()
            if line and not line.startswith("//"):
                out.append(line.split()[0].lower())
    return out


def load_suffix_rules(spark: SparkSession, path: str | None = None) -> DataFrame:
    """Rules as ``(rule STRING, kind STRING)`` with kind in normal / wildcard / exception.

    ``path`` may be any text file Spark can read (one rule per line, public-suffix
    list syntax).  Without a path the shipped hand list is used.
    """
    if path is None:
        # from an Arrow table Spark knows the size when it plans, so the rules are broadcast: of rows from Python it
        # assumes the largest size, and the records would be shuffled by their last label, of which few names have most
        raw = spark.createDataFrame(pa.table({"line": pa.array(read_rule_lines(), pa.string())}))
    else:
        raw = spark.read.text(path).select(F.lower(F.trim("value")).alias("line"))
    raw = raw.filter((F.col("line") != "") & ~F.col("line").startswith("//"))
    raw = raw.select(F.split("line", r"\s+")[0].alias("line"))
    return raw.select(
        F.when(F.col("line").startswith("!"), F.substring("line", 2, 1 << 20))
        .when(F.col("line").startswith("*."), F.substring("line", 3, 1 << 20))
        .otherwise(F.col("line")).alias("rule"),
        F.when(F.col("line").startswith("!"), F.lit("exception"))
        .when(F.col("line").startswith("*."), F.lit("wildcard"))
        .otherwise(F.lit("normal")).alias("kind"),
    )


def rules_by_tld(rules: DataFrame) -> DataFrame:
    """One row per last label: arrays of normal / wildcard / exception rules under it."""
    def arr(kind):
        return F.array_compact(F.collect_set(F.when(F.col("kind") == kind, F.col("rule"))))
    return (rules.withColumn("_tld", F.substring_index("rule", ".", -1))
            .groupBy("_tld")
            .agg(arr("normal").alias("_normal"), arr("wildcard").alias("_wild"), arr("exception").alias("_exc"),
                 F.max(_label_count(F.col("rule"))).alias("_most")))


def with_domain_parts(df: DataFrame, host: str, rules: DataFrame, prefix: str = "tmp_") -> DataFrame:
    """Add ``{prefix}tld`` (public suffix), ``{prefix}sld`` (registrable label) and
    ``{prefix}sub`` (subdomain) for the host column ``host``.

    Matching follows the public-suffix algorithm: the longest matching rule wins,
    an exception rule beats every other rule and yields its parent, and a name
    whose last label is not in the list has an empty suffix (its last label is the
    registrable label).  A bare IPv4 address is all registrable label.
    """
    low = df.withColumn("_low", F.lower(F.col(host)))  # once: lower is slow, and the candidates are made of it
    tld = F.substring_index(F.coalesce(F.col("_low"), F.lit("")), ".", -1)
    joined = low.withColumn("_tld", tld).join(rules_by_tld(rules), "_tld", "left")
    # the suffix length is materialised once; the parts below only reference it
    with_len = joined.withColumn("_sl", suffix_labels(F.col(host), F.col("_low")))
    return with_len.withColumns(split_columns(F.col(host), prefix)).drop("_low", "_tld", "_normal", "_wild", "_exc", "_most", "_sl")


def _label_count(host: Column) -> Column:
    return F.char_length(host) - F.char_length(F.replace(host, F.lit("."), F.lit(""))) + 1


def _last_labels(host: Column, k: Column) -> Column:
    return F.call_function("substring_index", host, F.lit("."), -k)


def suffix_labels(host: Column, low: Column) -> Column:
    """How many trailing labels of ``host`` (``low``: in lower case) form its public suffix (0 = none), from the rules
    of its last label.  The candidates are the last 1, 2, ... labels, as many as the host and the longest of those rules
    have."""
    n = _label_count(host)
    candidates = F.transform(F.sequence(F.lit(1), F.least(n, F.col("_most"))), lambda k: _last_labels(low, k))

    def longest(rules: str, more: int) -> Column:
        """Labels of the longest candidate that ``rules`` has, and ``more``; few last labels have wildcards or exceptions."""
        found = F.transform(candidates, lambda c, i: F.when(F.array_contains(rules, c) & (i + 1 + more <= n), i + 1 + more))
        return F.when(F.size(rules) > 0, F.array_max(found))

    hit = F.greatest(longest("_normal", 0), longest("_wild", 1))  # a wildcard rule matches one label more than it spells
    return F.when(host.rlike(f"^{IPV4_DOTTED}$") | F.col("_normal").isNull(), F.lit(0)).otherwise(F.coalesce(longest("_exc", -1), hit, F.lit(0)))


def split_columns(host: Column, prefix: str = "tmp_") -> dict[str, Column]:
    """Suffix / registrable label / subdomain from the materialised ``_sl`` column."""
    n = _label_count(host)
    sl = F.col("_sl")
    is_ip = host.rlike(f"^{IPV4_DOTTED}$")
    suffix = F.when(sl > 0, _last_labels(host, sl)).otherwise(F.lit(""))
    # the part left of the suffix (and its dot)
    rest = F.when(sl == 0, host).when(n > sl, F.substring(host, F.lit(1), F.char_length(host)
                                                           - F.char_length(suffix) - 1)).otherwise(F.lit(""))
    sld = F.when(is_ip, host).otherwise(F.substring_index(rest, ".", -1))
    sub = F.when(is_ip | ~rest.contains("."), F.lit("")).otherwise(
        F.substring(rest, F.lit(1), F.char_length(rest) - F.char_length(F.substring_index(rest, ".", -1)) - 1))
    return {f"{prefix}tld": suffix, f"{prefix}sld": sld, f"{prefix}sub": sub}


def without_suffix(sub, sld) -> Column:
    """L2 ``remove_tld``: ``sub.sld`` when there is a subdomain, else ``sld``."""
    sub = F.col(sub) if isinstance(sub, str) else sub
    sld = F.col(sld) if isinstance(sld, str) else sld
    return F.when(sub != "", F.concat(sub, F.lit("."), sld)).otherwise(sld)


def count_subdomains(sub) -> Column:
    """Labels of the subdomain, minus one if any of them is ``www``; none -> 0."""
    sub = F.col(sub) if isinstance(sub, str) else sub
    parts = F.split(sub, r"\.")
    return F.when(sub == "", F.lit(0)).otherwise(
        F.size(parts) - F.array_contains(parts, "www").cast("int"))


@lru_cache(maxsize=1)
def shipped_rules() -> tuple[tuple[str, str], ...]:
    """The shipped rules as Python tuples (rule, kind) -- used by the SQL oracle."""
    out = []
    for line in read_rule_lines():
        if line.startswith("!"):
            out.append((line[1:], "exception"))
        elif line.startswith("*."):
            out.append((line[2:], "wildcard"))
        else:
            out.append((line, "normal"))
    return tuple(out)
