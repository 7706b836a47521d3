"""Files of JSON records as they arrive, aligned with one mapping that the first batch teaches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from concord.functions.convert import Target
from concord.operators import alignment, profile
from concord.plans.storage import cut


def align_stream(spark: SparkSession, source: str, out: str, checkpoint: str, fields: list[Target], once: bool = True, per_batch: int | None = None, after: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Conformant golden records of new files are written under ``out/batch=N``; a batch that is run again overwrites its own.

    The mapping is learned from the first batch and kept beside the checkpoint, so that later
    batches, and a stream that starts again, use the same one.
    """
    reader = spark.readStream.schema("rec_id long, record string")
    if per_batch:
        reader = reader.option("maxFilesPerTrigger", per_batch)
    kept = f"{checkpoint}-mapping"

    def mapping(batch: DataFrame) -> DataFrame:
        try:
            return spark.read.parquet(kept)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        long = cut(profile.cells(batch, ["rec_id"], "record"), "cells")
        found = alignment.infer_mapping(profile.profile(long, ["rec_id"], None, profile.totals(batch, "record")), alignment.target_table(spark, fields))
        found.write.mode("overwrite").parquet(kept)
        return spark.read.parquet(kept)

    def one(batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        golden = alignment.align(batch, ["rec_id"], "record", fields, mapping=mapping(batch))
        golden.where("conformant").drop("issues", "conformant", "provenance").write.mode("overwrite").parquet(f"{out}/batch={number}")
        if after:
            after(golden, number)

    writer = reader.json(source).writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
