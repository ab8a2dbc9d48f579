"""Record projection and feature-table preparation.

All are column-list manipulations or per-row expressions: no shuffle, except
P16's join to a (bounded, broadcast) class table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import DNS_TYPES, FEATURE_PREFIXES


# ---------------------------------------------------------------- P1-P4, F1: projection of raw documents
def evaluated_only(raw: DataFrame) -> DataFrame:
    """documents whose evaluation and DNS evaluation timestamps are set (pushed to the scan)."""
    return raw.filter(F.col("evaluated_on").isNotNull() & F.col("remarks.dns_evaluated_on").isNotNull())


def project_documents(raw: DataFrame) -> DataFrame:
    """Nested paths to the flat record (renames, struct rebuild, map keys / entries,
    sub-field picks inside the IP array).  Only referenced fields are read (nested pruning)."""
    mx = F.col("dns.MX")
    return raw.select(
        "domain_name", "label", "category",
        F.col("dns.dnssec").alias("dns_dnssec"),
        F.struct(F.col("dns.remarks.has_spf").alias("spf"), F.col("dns.remarks.has_dkim").alias("dkim"),
                 F.col("dns.remarks.has_dmarc").alias("dmarc")).alias("dns_email_extras"),
        F.col("dns.ttls").alias("dns_ttls"),
        F.col("dns.remarks.zone").alias("dns_zone"),
        F.col("dns.remarks.has_dnskey").alias("dns_has_dnskey"),
        F.col("dns.remarks.zone_dnskey_selfsign_ok").alias("dns_zone_dnskey_selfsign_ok"),
        *[F.col(f"dns.{t}").alias(f"dns_{t}") for t in ("A", "AAAA", "SOA", "zone_SOA", "TXT")],
        F.col("dns.CNAME.value").alias("dns_CNAME"),
        F.map_keys("dns.NS").alias("dns_NS"),                                           # P2
        F.when(mx.isNotNull(), F.transform(F.map_entries(mx), lambda e: F.struct(      # P3
            e["key"].alias("name"), e["value"]["priority"].alias("priority")))).alias("dns_MX"),
        "tls",
        F.col("remarks.dns_evaluated_on").alias("dns_evaluated_on"),
        F.col("remarks.rdap_evaluated_on").alias("rdap_evaluated_on"),
        F.col("remarks.tls_evaluated_on").alias("tls_evaluated_on"),
        F.col("rdap.registration_date").alias("rdap_registration_date"),
        F.col("rdap.expiration_date").alias("rdap_expiration_date"),
        F.col("rdap.last_changed_date").alias("rdap_last_changed_date"),
        F.col("rdap.dnssec").alias("rdap_dnssec"),
        F.col("rdap.entities").alias("rdap_entities"),
        F.transform("ip_data", lambda e: F.struct(                                      # P4
            e["ip"].alias("ip"), e["remarks"].alias("remarks"), e["from_record"].alias("from_record"),
            e["rdap"].alias("rdap"), e["asn"].alias("asn"), e["geo"].alias("geo"))).alias("ip_data"),
    )


# ---------------------------------------------------------------- labels
MAX_BROADCAST_CLASSES = 100_000


def combine_label(df: DataFrame) -> DataFrame:
    """P5: label <- label ':' category (NULL if either is NULL); category dropped."""
    return df.withColumn("label", F.concat(F.col("label"), F.lit(":"), F.col("category"))).drop("category")


def constant_label(df: DataFrame, value: str, column: str = "label") -> DataFrame:
    """P14."""
    return df.withColumn(column, F.lit(value))


def clean_label(df: DataFrame, pattern: str = ":dga$", column: str = "label") -> DataFrame:
    """Strip a regex (default the ``:dga`` suffix) from the label."""
    return df.withColumn(column, F.regexp_replace(column, pattern, ""))


def label_to_index(df: DataFrame, classes: DataFrame, column: str = "label", out: str = "class_id") -> DataFrame:
    """Label -> class index through a class table ``(label, class_id)``; an unmapped
    label raises (``raise_error``), as the original's dict lookup did.  The class table is
    tiny (tens of classes) and broadcast."""
    cls = classes.select(F.col(classes.columns[0]).alias("_lbl"), F.col(classes.columns[1]).alias("_cid"))
    if cls.count() <= MAX_BROADCAST_CLASSES:  # class tables are tiny; checked, not assumed
        cls = F.broadcast(cls)
    j = df.join(cls, df[column] == cls["_lbl"], "left")
    checked = F.when(F.col("_cid").isNull(), F.raise_error(F.concat(F.lit("unknown label: "), F.col(column)))) \
        .otherwise(F.col("_cid"))
    return j.withColumn(out, checked.cast("int")).drop("_lbl", "_cid")


def index_to_label(df: DataFrame, classes: DataFrame, column: str = "prediction", out: str = "label") -> DataFrame:
    """P16 inverse."""
    cls = classes.select(F.col(classes.columns[1]).alias("_cid"), F.col(classes.columns[0]).alias(out))
    if cls.count() <= MAX_BROADCAST_CLASSES:
        cls = F.broadcast(cls)
    return df.join(cls, F.col(column).cast("int") == F.col("_cid"), "left").drop("_cid")


# ---------------------------------------------------------------- column sets
NONTRAIN_FIELDS = ("dns_evaluated_on", "rdap_evaluated_on", "tls_evaluated_on", "ip_data", "countries",
                   "latitudes", "longitudes", "dns_dnssec", "dns_zone_dnskey_selfsign_ok", "dns_email_extras",
                   "dns_ttls", "dns_zone", "dns_zone_SOA", *[f"dns_{t}" for t in DNS_TYPES],
                   "rdap_registration_date", "rdap_last_changed_date", "rdap_expiration_date", "rdap_dnssec",
                   "rdap_entities")


def drop_nontrain(df: DataFrame, keep_key: bool = True) -> DataFrame:
    """Drop the non-training columns that are present; ``keep_key=False`` also drops
    ``domain_name`` (the table variant of the original)."""
    fields = list(NONTRAIN_FIELDS) + ([] if keep_key else ["domain_name"])
    return df.drop(*[c for c in fields if c in df.columns])


def drop_if_present(df: DataFrame, columns) -> DataFrame:
    """Q20: drop columns only when present (older tables carry columns newer ones lack)."""
    return df.drop(*[c for c in columns if c in df.columns])


def cast_times(df: DataFrame) -> DataFrame:
    """Durations -> float seconds, timestamps -> integer epoch seconds (true seconds)."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DayTimeIntervalType):
            cols.append((F.unix_micros(F.lit("1970-01-01 00:00:00").cast("timestamp") + c) / 1e6).alias(f.name))
        elif isinstance(f.dataType, T.TimestampType):
            cols.append(F.unix_seconds(c).alias(f.name))
        elif isinstance(f.dataType, T.TimestampNTZType):
            cols.append(F.unix_seconds(c.cast("timestamp")).alias(f.name))
        else:
            cols.append(c)
    return df.select(*cols)


def feature_columns(df: DataFrame, prefixes=FEATURE_PREFIXES, extra=("label", "domain_name")) -> list[str]:
    """P10: columns with a feature prefix, plus the label and key."""
    return [c for c in df.columns if c.startswith(tuple(prefixes)) or c in extra]


def select_features(df: DataFrame, prefixes=FEATURE_PREFIXES, extra=("label", "domain_name")) -> DataFrame:
    cols = feature_columns(df, prefixes, extra)
    if not cols:
        raise ValueError("no feature columns found")
    return df.select(*cols)


def select_curated(df: DataFrame, features: list[str], label: str = "label") -> tuple[DataFrame, list[str]]:
    """Keep ``label`` + the curated list; also return the columns left unused."""
    unused = [c for c in df.columns if c not in set(features) | {label}]
    return df.select(label, *features), unused


def rename(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """P12."""
    return df.withColumnsRenamed({k: v for k, v in mapping.items() if k in df.columns})


def realign(df: DataFrame, reference: T.StructType) -> DataFrame:
    """The reference schema's columns, in its order, cast to its types."""
    return df.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in reference.fields])


def booleans_to_int(df: DataFrame) -> DataFrame:
    """P18."""
    return df.select(*[F.col(f"`{f.name}`").cast("int").alias(f.name) if isinstance(f.dataType, T.BooleanType)
                       else F.col(f"`{f.name}`") for f in df.schema.fields])


def fill_missing(df: DataFrame, value: float = -1) -> DataFrame:
    """Booleans to 0/1 first, then fill NULL (and NaN) numerics with ``value``."""
    return booleans_to_int(df).fillna(value)


def sigmoid_all(df: DataFrame, exclude=("label", "domain_name")) -> DataFrame:
    """1 / (1 + exp(-x)) for every numeric column."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if f.name not in exclude and isinstance(f.dataType, T.NumericType):
            out.append((1.0 / (1.0 + F.exp(-c.cast("double")))).alias(f.name))
        else:
            out.append(c)
    return df.select(*out)


def ablate(df: DataFrame, feature: str) -> DataFrame:
    """P20: drop one named feature, unless it is ``DEFAULT``."""
    return df if feature == "DEFAULT" else df.drop(feature)


def false_positives(scored: DataFrame, label: str = "label", pred: str = "prediction") -> DataFrame:
    """predicted positive but labelled negative; the key travels with the row."""
    return scored.filter((F.col(pred) == 1) & (F.col(label) == 0))


def nonzero(df: DataFrame, column: str) -> DataFrame:
    """F6."""
    return df.filter(F.col(column) != 0)


def sigmoid(c: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-c))
