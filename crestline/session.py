"""Session defaults and the shared working folder."""
from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def get_session(master: str | None = None, app: str = "crestline", **conf: str) -> SparkSession:
    """A session with the settings the operators expect; a cluster's own settings win."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_LOCAL: list[str] = []


def workspace(spark: SparkSession, purpose: str) -> str:
    """A fresh path for written tables, inside the shared folder named by ``spark.checkpoint.dir``.

    Only a local session without that setting (a test) gets a folder of its own, once; on a cluster it must be set.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if not _LOCAL:
            _LOCAL.append(tempfile.mkdtemp(prefix="crestline-"))
        root = _LOCAL[0]
    return f"{root.rstrip('/')}/crestline/{purpose}-{uuid.uuid4().hex}"


def checkpointed(df):
    """Reliable checkpoint in the shared folder; used where a plan is read more than once."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(workspace(spark, "checkpoints"))
    return df.checkpoint()
