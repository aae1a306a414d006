"""Tables that several results of a plan read."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame


def kept(df: DataFrame) -> DataFrame:
    """``df``, computed once and written to the checkpoint folder, which executors and driver share.

    With adaptive execution its partitioning isn't known any more, so what is grouped by the same keys is shuffled once
    more. Where no folder is set, a local master gets a temporary one; on a cluster that is an error.
    """
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        at = sc.getConf().get("spark.checkpoint.dir", None)
        if not at and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(at or tempfile.mkdtemp(prefix="refmill-"))
    return df.checkpoint()
