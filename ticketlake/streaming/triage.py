"""Streaming triage: new messages arrive as files in an inbox folder and are
triaged against the current version of a knowledge base.

A message delivered more than once is triaged once: `dropDuplicatesWithinWatermark`
keeps the ids of the last `keep_ids` of event time (the state's bound) in the
stream's checkpoint. Stateless columns (classification, retrieval gate) run in
the stream; the per-message top-k needs a ranking window, which streams do not
allow, so each micro-batch is finished in `foreachBatch`. Every batch reads the
store's current version, so a knowledge base published between two batches takes
effect, and a row says which version it was triaged with. Output goes to
`<run>/out/batch_id=<id>` with overwrite, so a replayed batch rewrites the same
files (exactly-once by batch id), and a stream started again on the same run
folder goes on where it stopped.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketlake.plans import kb_store as KS
from ticketlake.plans import pipeline as P
from ticketlake.session import ensure_checkpoint_dir


def start_triage_stream(spark: SparkSession, inbox: str, schema, store: str, run: str, available_now: bool = True,
                        max_files_per_trigger: int | None = None, event_time: str | None = None, keep_ids: str = "24 hours"):
    """Start the stream over `inbox` (Parquet message files: message_id,
    message and any other columns of `schema`) against the knowledge base
    published in `store`; returns the StreamingQuery. `event_time` names the
    messages' timestamp; without one the time of the file counts."""
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    at = F.col(event_time) if event_time else F.col("_metadata.file_modification_time")
    once = (reader.parquet(inbox).withColumn("_at", at).withWatermark("_at", keep_ids)
                  .dropDuplicatesWithinWatermark(["message_id"]).drop("_at"))
    stream = P.classified(once)

    def finish(batch: DataFrame, batch_id: int) -> None:
        now = KS.load(spark, store)
        cls = batch.persist()
        rr = P.reranked(cls, P.retrieved(cls, now.cases, index=now.index))
        out = P.triage(cls, P.evidence(rr)).withColumn("kb_version", F.lit(now.name))
        out.write.mode("overwrite").parquet(f"{run}/out/batch_id={batch_id}")
        cls.unpersist()

    w = stream.writeStream.foreachBatch(finish).option("checkpointLocation", f"{run}/checkpoint")
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def triage_stream(spark: SparkSession, d: str) -> DataFrame:
    """L2 on the test tables: the KB is built from the conversations, every
    case's problem is dropped into the inbox as a new message, the stream is
    run to completion and its output is read back (same columns as the
    batch triage query)."""
    run = f"{ensure_checkpoint_dir(spark).rstrip('/')}/triage-stream-{uuid.uuid4().hex}"
    kb = KS.publish(P.kb_table(spark, d), f"{run}/store", dense=False).cases
    msgs = kb.select(F.col("case_id").alias("message_id"), F.col("customer_problem").alias("message"))
    msgs.write.mode("overwrite").parquet(f"{run}/inbox")
    q = start_triage_stream(spark, f"{run}/inbox", msgs.schema, f"{run}/store", run)
    q.awaitTermination()
    t = spark.read.parquet(f"{run}/out")
    return t.select("message_id", "intent", "action", F.round("risk_score", 6).alias("risk_score"), "escalate",
                    "n_cases", F.array_join("evidence_case_ids", ",").alias("evidence_case_ids"), "response")
