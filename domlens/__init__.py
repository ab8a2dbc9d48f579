"""domlens: domain-name feature engineering and classifier evaluation on Apache Spark.

Entry points: ``domlens.plans.pipeline`` (the feature-build plan), ``domlens.operators``
(feature families, set operations, metrics, models), ``domlens.sources.io`` (readers and
writers), ``domlens.streaming.incremental`` (resumable jobs) and ``__spark_entry__.py``.
"""

__version__ = "0.1.0"
