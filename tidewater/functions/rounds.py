"""Driver loops over DataFrames: checkpointed rounds with a cap."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame

#: Rounds after which a loop gives up.
MOST_ROUNDS = 150


def settled(df: DataFrame) -> DataFrame:
    """``df`` computed and cut from its lineage, in the cluster's shared checkpoint folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder:  # only a local session may do without a shared folder
            if not (context.master == "local" or context.master.startswith("local[")):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the whole cluster shares")
            folder = tempfile.mkdtemp(prefix="rounds-")
        context.setCheckpointDir(folder)
    return df.checkpoint()


class DidNotSettle(RuntimeError):
    """A loop reached its cap of rounds."""
