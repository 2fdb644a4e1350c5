"""Reading tables so that the work spreads over the cluster."""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lexweave.session import checkpoint_dir


def spread(df: DataFrame) -> DataFrame:
    """Redistribute an input that arrives in fewer pieces than there are cores.

    A large input already has far more splits than cores and is left alone; a small one (a single
    row group, say) would otherwise keep one core busy with all the parsing.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() <= cores else df


# Bytes of input files per piece: a million rows or so of narrow columns.
PIECE_BYTES = 16 << 20


def pieces(df: DataFrame) -> int:
    """How many pieces a table is dealt into so that a piece does not grow with it: by the size of its input files, one per core at least.

    Inputs that are no files have no known size (Spark says the largest long) and do not count.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-sum(s for s in sizes if s < 1 << 62) // PIECE_BYTES))


def read_table(spark: SparkSession, folder: str, name: str, heavy: bool = False) -> DataFrame:
    """One parquet table; ``heavy`` marks tables whose rows are expensive to process."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return spread(df) if heavy else df


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write an expensive intermediate once to the shared checkpoint folder and read it back.

    The result survives lost executors and keeps column pruning and filter pushdown.
    """
    path = f"{checkpoint_dir(df.sparkSession)}/stage-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
