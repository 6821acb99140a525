"""The group audit over a stream of predictions.

The reference only advises ongoing monitoring; no new operator is added
here. ``audit.group_counts`` is a plain partially-aggregated ``groupBy``, so
it runs unchanged on a streaming DataFrame (stateful aggregation,
``update`` / ``complete`` output). ``start_audit_monitor`` recomputes the
pairwise metrics and summary from the running counts in each micro-batch
(``foreachBatch``), where they are small static tables.
"""

from __future__ import annotations

from typing import Callable, Mapping, Optional, Sequence

from pyspark.sql import DataFrame

from evenkeel.operators import audit


def start_audit_monitor(pred_stream: DataFrame, attributes: Sequence[str],
                        on_summary: Callable[[DataFrame, int], None],
                        privileged: Optional[Mapping[str, str]] = None,
                        checkpoint: Optional[str] = None, trigger: Optional[dict] = None):
    """Start a query whose every micro-batch hands the current audit summary
    to ``on_summary(summary_df, batch_id)``."""
    counts = audit.group_counts(pred_stream, attributes)

    def handle(batch: DataFrame, batch_id: int) -> None:
        on_summary(audit.summary(audit.group_rates(batch, privileged)), batch_id)

    w = counts.writeStream.outputMode("complete").foreachBatch(handle)
    if checkpoint:
        w = w.option("checkpointLocation", checkpoint)
    if trigger:
        w = w.trigger(**trigger)
    return w.start()
