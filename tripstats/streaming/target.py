"""The target of a complete-mode stream: the whole result, replaced by every micro-batch.

A complete-mode batch holds the current row of every key, so a target needs
no merging: each batch is written to a folder of its own, and then one small
commit record, replaced in a single rename, makes it the current one.
Readers see the state before or after a batch, never between.  A replayed
batch (``foreachBatch`` is at-least-once) writes the same folder again.

The commit record names the checkpoint (its query id) and the batch.  Batch
ids only have an order within one checkpoint, so a stream that starts from
another checkpoint than the target's is refused, unless it is told to reset
the target: it then reads its topic from the start and its first batch
replaces the target as a whole.
"""
from __future__ import annotations

import json
from typing import Literal

from pyspark.sql import DataFrame, SparkSession

from tripstats.sinks import files

OnOther = Literal["refuse", "reset"]


class OtherCheckpoint(ValueError):
    """The target was written from another checkpoint, or by a later batch."""


def checkpoint_id(spark: SparkSession, checkpoint: str) -> str | None:
    """The id that Spark gives a query's checkpoint when it first starts; None before."""
    text = files.read_text(spark, f"{checkpoint.rstrip('/')}/metadata")
    return json.loads(text)["id"] if text else None


class SnapshotTarget:
    def __init__(self, path: str, checkpoint: str, on_other: OnOther = "refuse"):
        self.path, self.checkpoint, self.on_other = path.rstrip("/"), checkpoint, on_other

    @property
    def record(self) -> str:
        return f"{self.path}/commit.json"

    def committed(self, spark: SparkSession) -> dict | None:
        """The commit record: ``checkpoint``, ``batch`` and the ``folder`` of the current state."""
        text = files.read_text(spark, self.record)
        return json.loads(text) if text else None

    def admit(self, spark: SparkSession) -> None:
        """Refuse, before a query starts, a checkpoint that is not the target's."""
        was, own = self.committed(spark), checkpoint_id(spark, self.checkpoint)
        if was and was["checkpoint"] != own and self.on_other != "reset":
            raise OtherCheckpoint(f"{self.path} was written from checkpoint {was['checkpoint']}, not from "
                                  f"{self.checkpoint}; start with on_other='reset' to replace it")

    def write_batch(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        was, own = self.committed(spark), checkpoint_id(spark, self.checkpoint)
        same = was is not None and was["checkpoint"] == own
        if was and not same and self.on_other != "reset":
            raise OtherCheckpoint(f"{self.path} belongs to checkpoint {was['checkpoint']}")
        if same and batch_id < was["batch"]:
            raise OtherCheckpoint(f"{self.path} holds batch {was['batch']}; the checkpoint went back to {batch_id}")
        folder = f"state-{own}-{batch_id}"
        batch.write.mode("overwrite").parquet(f"{self.path}/{folder}")
        files.replace_text(spark, self.record, json.dumps({"checkpoint": own, "batch": batch_id, "folder": folder}))
        # the state before this one stays for readers that have opened it; older ones go
        keep = {folder, was["folder"] if was else folder}
        for name in files.names(spark, self.path):
            if name.startswith("state-") and name not in keep:
                files.delete(spark, f"{self.path}/{name}")

    def read(self, spark: SparkSession) -> DataFrame:
        """The current state."""
        was = self.committed(spark)
        if was is None:
            raise FileNotFoundError(f"no batch committed to {self.path} yet")
        return spark.read.parquet(f"{self.path}/{was['folder']}")
