"""Sources and sinks.

Everything is a Spark reader or writer on a path the cluster can see (HDFS,
object store, shared POSIX); nothing is staged on the driver.
"""

from __future__ import annotations

import logging
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.prep import evaluated_only, project_documents
from ..schema import DOMAIN_DDL, RAW_DOMAIN_DDL

LOG = logging.getLogger(__name__)
CACHE_MODES = ("auto", "force-refresh", "force-local")


# ---------------------------------------------------------------- S1, S2
def read_domain_records(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Projected domain records with the declared schema (never inferred)."""
    return spark.read.schema(DOMAIN_DDL).format(fmt).load(path)


def read_raw_documents(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """S1 + F1 + P1-P4: raw documents -> evaluated only -> projected records.  The
    filter and the referenced nested fields reach the scan (pushdown, nested pruning)."""
    raw = spark.read.schema(RAW_DOMAIN_DDL).format(fmt).load(path)
    return project_documents(evaluated_only(raw))


def read_parquet(spark: SparkSession, *paths: str) -> DataFrame:
    """S2."""
    return spark.read.parquet(*paths)


# ---------------------------------------------------------------- S3, S4
def table_path(root: str, name: str, prefix: str = "") -> str:
    return "/".join(p.strip("/") if i else p.rstrip("/") for i, p in enumerate([root, prefix, name]) if p)


def save_table(df: DataFrame, root: str, name: str, prefix: str = "", millis: bool = True) -> str:
    """S3: overwrite ``{root}/{prefix}/{name}`` as Parquet (directories made by the writer).
    ``millis`` truncates timestamps to milliseconds, the resolution of the original files."""
    if millis:
        df = df.select(*[F.date_trunc("millisecond", F.col(f"`{f.name}`")).alias(f.name)
                         if f.dataType.typeName() == "timestamp" else F.col(f"`{f.name}`")
                         for f in df.schema.fields])
    path = table_path(root, name, prefix)
    df.write.mode("overwrite").parquet(path)
    return path


def path_exists(spark: SparkSession, path: str) -> bool:
    """Existence check through the Hadoop file system of the path (works for any scheme)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(p))


def cached_source(spark: SparkSession, name: str, build: Callable[[], DataFrame], cache_root: str,
                  mode: str = "auto") -> DataFrame:
    """Read ``{cache_root}/{name}`` if cached whole (its writer left ``_SUCCESS``), else build,
    write and read back.

    ``force-refresh`` always rebuilds; ``force-local`` and ``auto`` use the cache when
    present (``auto`` has no staleness check, as in the original); an unknown mode
    falls back to ``auto``.
    """
    if mode not in CACHE_MODES:
        mode = "auto"
    path = table_path(cache_root, name)
    if mode != "force-refresh" and path_exists(spark, f"{path}/_SUCCESS"):
        return spark.read.parquet(path)
    build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


# ---------------------------------------------------------------- S6
def load_datasets(spark: SparkSession, specs: dict[str, str], loader: Callable[[SparkSession, str], DataFrame]
                  ) -> dict[str, DataFrame]:
    """Label -> DataFrame for every spec that loads; a failing one is skipped, which is reported."""
    out = {}
    for label, path in specs.items():
        try:
            df = loader(spark, path)
            df.schema  # resolve now so a missing path fails here  # noqa: B018
            out[label] = df
        except Exception as e:  # noqa: BLE001 - skipped and reported, as the original did
            LOG.warning("dataset %s (%s) is skipped: %s", label, path, str(e).splitlines()[0])
    return out


def tag_dataset(frames: dict[str, DataFrame], column: str = "dataset") -> DataFrame:
    """S6 as one scan: all datasets in one DataFrame with a ``dataset`` column."""
    items = list(frames.items())
    out = items[0][1].withColumn(column, F.lit(items[0][0]))
    for label, df in items[1:]:
        out = out.unionByName(df.withColumn(column, F.lit(label)), allowMissingColumns=True)
    return out


# ---------------------------------------------------------------- S7-S10
def read_lines(spark: SparkSession, path: str, column: str = "domain") -> DataFrame:
    """Text lines, trimmed, blanks dropped."""
    return spark.read.text(path).select(F.trim("value").alias(column)).filter(F.col(column) != "")


def read_csv(spark: SparkSession, path: str, schema: str | None = None, sep: str = ",") -> DataFrame:
    """S8 / S9 source: CSV (``sep='\\t'``: TSV) with a header (declared schema when given)."""
    r = spark.read.option("header", True).option("sep", sep)
    return (r.schema(schema) if schema else r).csv(path)


def write_csv(df: DataFrame, path: str, sep: str = ",") -> None:
    """S8 / S9 sink: header CSV (``sep='\\t'`` for the TSV extract)."""
    df.write.mode("overwrite").option("header", True).option("sep", sep).csv(path)


def finished_list_name(input_path: str) -> str:
    """Output name from the input's last ``_`` token: x_2024.csv -> 2024_finished_list.txt."""
    base = os.path.basename(input_path).split("_")[-1].split(".")[0]
    return f"{base}_finished_list.txt"


def write_lines(df: DataFrame, column: str, out_dir: str, input_path: str) -> str:
    """One value per line under ``{out_dir}/{base}_finished_list.txt`` (a directory of parts)."""
    path = table_path(out_dir, finished_list_name(input_path))
    df.select(F.col(column).cast("string")).write.mode("overwrite").text(path)
    return path


# ---------------------------------------------------------------- S12-S15
ATTRIBUTION_LINE = r"^Domain: (.*), Feature: (.*), SHAP Value: (.*)$"
RANKING_LINE = r"^Feature: (.*), Mean SHAP Value: (.*)$"


def parse_attribution_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """``Domain: d, Feature: f, SHAP Value: v`` -> (domain, feature, value); 'nan' -> NaN."""
    v = F.col(column)
    return lines.filter(v.rlike(ATTRIBUTION_LINE)).select(
        F.regexp_extract(v, ATTRIBUTION_LINE, 1).alias("domain"),
        F.regexp_extract(v, ATTRIBUTION_LINE, 2).alias("feature"),
        F.regexp_extract(v, ATTRIBUTION_LINE, 3).cast("double").alias("value"))


def parse_ranking_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """``Feature: f, Mean SHAP Value: v`` -> (feature, mean_value)."""
    v = F.col(column)
    return lines.filter(v.rlike(RANKING_LINE)).select(
        F.regexp_extract(v, RANKING_LINE, 1).alias("feature"),
        F.regexp_extract(v, RANKING_LINE, 2).cast("double").alias("mean_value"))


def write_attribution_log(attributions: DataFrame, path: str) -> None:
    """S12 sink: one line for each (domain, feature, value)."""
    line = F.concat(F.lit("Domain: "), "domain", F.lit(", Feature: "), "feature", F.lit(", SHAP Value: "), F.lower(F.col("value").cast("string")))
    attributions.select(line.alias("value")).write.mode("overwrite").text(path)


def write_ranking(ranking: DataFrame, path: str) -> None:
    """S13 sink: one line for each (feature, mean_value)."""
    line = F.concat(F.lit("Feature: "), "feature", F.lit(", Mean SHAP Value: "), F.col("mean_value").cast("string"))
    ranking.select(line.alias("value")).write.mode("overwrite").text(path)


def read_attribution_log(spark: SparkSession, path: str) -> DataFrame:
    return parse_attribution_lines(spark.read.text(path))


def read_ranking(spark: SparkSession, path: str) -> DataFrame:
    return parse_ranking_lines(spark.read.text(path))


def count_and_first(df: DataFrame):
    """Record count and the first record (an action; for inspection only)."""
    return df.count(), df.limit(1).collect()


def preview(df: DataFrame, n: int = 20) -> DataFrame:
    """S15."""
    return df.limit(n)
