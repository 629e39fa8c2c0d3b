"""Streaming jobs.

* ``start_audit_stream`` — append-only leakage audit: every micro-batch of new
  records is scanned and its hits written under ``batch_id=<n>`` with overwrite,
  so a retried batch replaces its own output (idempotent sink).
* ``start_window_monitor`` — event-time windows with a watermark: per (window,
  class) truth / prediction / hit counts are aggregated in the state store and
  emitted once the watermark passes; each emitted batch gets its macro-F1 per
  window and is appended.  Trigger logic (``operators.monitor.triggers``) runs on
  the resulting window table.
"""

from __future__ import annotations

import os
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import audit, metrics


def start_audit_stream(records: DataFrame, vocab: Mapping[str, Sequence[str]], out_path: str,
                       checkpoint: str, id_col: str = "sample_id", field_col: str = "field",
                       value_col: str = "value", trigger: dict | None = None) -> StreamingQuery:
    """``records`` is a streaming DataFrame of (id, field, value) rows; ``checkpoint``
    is this stream's own folder, the same at each restart."""
    hits = audit.scan(records, vocab, id_col, field_col, value_col)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(os.path.join(out_path, f"batch_id={batch_id}"))

    w = hits.writeStream.foreachBatch(write).option(
        "checkpointLocation", checkpoint)
    w = w.trigger(**trigger) if trigger else w.trigger(availableNow=True)
    return w.start()


def start_window_monitor(preds: DataFrame, out_path: str, checkpoint: str, ts: str = "ts",
                         y_true: str = "y_true", y_pred: str = "y_pred", window: str = "30 days",
                         watermark: str = "7 days", trigger: dict | None = None) -> StreamingQuery:
    """Streaming per-window class counts -> macro-F1 per closed window."""
    roles = F.explode(F.array(
        F.struct(F.col(y_true).alias("cls"), F.lit(1).alias("t"),
                 (F.col(y_true) == F.col(y_pred)).cast("int").alias("tp"), F.lit(0).alias("p")),
        F.struct(F.col(y_pred).alias("cls"), F.lit(0).alias("t"), F.lit(0).alias("tp"), F.lit(1).alias("p"))))
    counts = (preds.withWatermark(ts, watermark)
              .select(F.window(ts, window).alias("w"), roles.alias("r"))
              .groupBy("w", F.col("r.cls").alias("class"))
              .agg(F.sum("r.t").alias("support"), F.sum("r.tp").alias("tp"), F.sum("r.p").alias("n_pred")))

    def write(batch: DataFrame, batch_id: int) -> None:
        pc = metrics.prf(batch.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                                      "class", "support", "tp", "n_pred"))
        out = pc.groupBy("window_start", "window_end").agg(
            F.avg("f1").alias("macro_f1"), (F.sum("tp") / F.sum("support")).alias("accuracy"),
            F.sum("support").alias("n_test"))
        out.write.mode("overwrite").parquet(os.path.join(out_path, f"batch_id={batch_id}"))

    w = counts.writeStream.outputMode("append").foreachBatch(write).option(
        "checkpointLocation", checkpoint)
    w = w.trigger(**trigger) if trigger else w.trigger(availableNow=True)
    return w.start()
