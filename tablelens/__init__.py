"""tablelens: explore and enrich one table at a time on Spark.

Every operator is a plain function ``DataFrame -> DataFrame`` (or a small
driver-side fact derived from a schema), built on public Spark SQL and
``pyspark.ml``.  Chart operators return the aggregate that feeds a chart,
never a picture.
"""

from tablelens.session import ensure_checkpoint_dir, materialize  # noqa: F401

__all__ = ["ensure_checkpoint_dir", "materialize"]
