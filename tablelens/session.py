"""Session-level helpers: reliable checkpoints and size-checked broadcasts.

Nothing here changes session SQL settings; the caller owns the session.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Bounds for the small side of a join that we are willing to broadcast.
# Sides above either fall back to a shuffle join (AQE splits skewed partitions).
BROADCAST_MAX_ROWS = 2_000_000
BROADCAST_MAX_BYTES = 64 * 1024 * 1024

_FIXED_BYTES = {T.BooleanType: 1, T.ByteType: 1, T.ShortType: 2, T.IntegerType: 4, T.FloatType: 4, T.DateType: 4}


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder, setting it if needed.

    The cluster names a shared folder in ``spark.checkpoint.dir``; it is used
    as is.  Without that setting, a session whose tasks run inside the driver
    (master ``local`` or ``local[...]``, as in tests) gets a folder of its own;
    any other session has no folder that all executors see, and raises.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return sc.getCheckpointDir()
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not folder:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir is not set; point it at a shared folder (HDFS/S3/ABFS) that every executor can reach")
        folder = tempfile.mkdtemp(prefix="tablelens-ckpt-")
    sc.setCheckpointDir(folder)
    return sc.getCheckpointDir() or folder


def materialize(df: DataFrame) -> DataFrame:
    """Compute ``df`` once into the reliable checkpoint folder.

    Used for small derived tables (group statistics, bin edges) that are
    read more than once, and to cut lineage before iterative work.  A
    reliable checkpoint survives the loss of the executors that wrote it.
    Spark deletes its files once nothing refers to the result any more, if
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` is on.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _bytes_of(df: DataFrame):
    """Column expression: bytes of a row's values (text and binary by length, arrays and maps by their JSON text)."""
    total = F.lit(0).cast("long")
    for f in df.schema.fields:
        c = F.col("`" + f.name.replace("`", "``") + "`")
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            total = total + F.coalesce(F.octet_length(c), F.lit(0)) + F.lit(8)
        elif isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            total = total + F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0))
        else:
            total = total + F.lit(_FIXED_BYTES.get(type(f.dataType), 8))
    return total


def checked_broadcast(small: DataFrame, max_rows: int = BROADCAST_MAX_ROWS, max_bytes: int = BROADCAST_MAX_BYTES,
                      ready: bool = False) -> tuple[DataFrame, bool]:
    """Materialize ``small`` (unless it is: ``ready``) and broadcast it only if its rows *and* bytes are bounded.

    Returns ``(frame, broadcasted)``.  Both figures come from the materialized
    data, so the check is exact, not an estimate.
    """
    small = small if ready else materialize(small)
    rows, size = small.agg(F.count(F.lit(1)), F.coalesce(F.sum(_bytes_of(small)), F.lit(0))).first()
    if rows <= max_rows and size <= max_bytes:
        return F.broadcast(small), True
    return small, False


def default_parallelism(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
