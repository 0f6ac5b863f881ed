"""The same counts over a stream of reads (an extension): counts merge, so the batch plans run unchanged.

Counts are keyed by position, series and class: state stays as small as the result. Use output mode complete or
update; no watermark is needed, as nothing waits for time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from readqc.functions import reads as R
from readqc.operators import profiles as P
from readqc.operators.reads import RAW, derive


def stream_of_records(spark: SparkSession, folder: str, files_at_once: int = 100) -> DataFrame:
    """Records from Parquet files in the canonical schema, as they appear in a folder."""
    return spark.readStream.schema(RAW).option("maxFilesPerTrigger", files_at_once).parquet(folder)


def read_counts(records: DataFrame) -> DataFrame:
    return P.read_counts(derive(records))


def lengths(records: DataFrame) -> DataFrame:
    return P.lengths(derive(records))


def bases(records: DataFrame) -> DataFrame:
    """The plain plan: one aggregate and no Python."""
    return P.per_base(derive(records), P._forward("seq_o"), P.KEY, R.base_code)
