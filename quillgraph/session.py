"""Session set-up and the one way lineage is cut.

``durable`` writes through the reliable checkpoint directory, so a lost
executor costs a re-read, never a recomputation of every earlier round.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def build_session(app: str = "quillgraph", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are tuned for.

    Nothing here is required: every operator also runs on a session made elsewhere.
    Keyword names use ``__`` for ``.`` (``spark__driver__memory="8g"``).
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # a split hot partition is worth an extra exchange above the join
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # long texts: Arrow batches are bounded by bytes, not only by rows
        "spark.sql.execution.arrow.maxBytesPerBatch": str(64 << 20),
        # rounds of an iterative job drop their files once unreachable
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    settings.update({k.replace("__", "."): v for k, v in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every node can reach: the one the context has, else ``spark.checkpoint.dir``.

    Only a local session that names neither gets a temporary folder, set on its context once.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get(CHECKPOINT_CONF, None)
        if not named:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise ValueError(f"set {CHECKPOINT_CONF} to a folder shared by all executors")
            named = tempfile.mkdtemp(prefix="quillgraph-")
        context.setCheckpointDir(named)
    return context.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """Compute ``df`` now, keep it in the shared folder, and forget how it was made."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
