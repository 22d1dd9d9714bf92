"""Drift of arriving telemetry against fixed reference edges, per micro-batch."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from unitlife.operators.drift import DEFAULT_BINS, Fitted, expected_counts, fit_reference, histogram, psi_from_histograms


def batch_drift(batch: DataFrame, batch_id: int, fitted: Sequence[Fitted], expected: DataFrame,
                bins: int = DEFAULT_BINS) -> DataFrame:
    """The batch is aggregated once; features without a value in it are left out."""
    marked = F.lit(batch_id).cast("bigint").alias("batch_id")
    counts = histogram(batch, fitted, (), bins).filter("n > 0").select(marked, "*")
    report = psi_from_histograms(counts, expected, ["batch_id"], bins)
    return report.select("batch_id", "feature", "psi", "rating")


REPORT = "batch_id bigint, feature string, psi double, rating string"


def folder_sink(folder: str) -> Callable[[DataFrame, int], None]:
    """A folder per batch, written anew when a batch is repeated, so that a restart doubles nothing."""
    return lambda report, batch_id: report.write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")


def read_reports(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(REPORT).parquet(f"{folder}/batch=*")


def monitor(stream: DataFrame, reference: DataFrame, features: Sequence[str],
            sink: Callable[[DataFrame, int], None], checkpoint: str, *, bins: int = DEFAULT_BINS,
            digits: int | None = None, trigger: dict | None = None,
            fitted: Sequence[Fitted] | None = None) -> StreamingQuery:
    """Start the monitor; ``sink(report, batch_id)`` receives one small report per batch.

    The edges and reference counts are fitted once and kept as local rows (one per feature). A
    batch is independent of the others, so there is no state and no watermark; a batch without
    values for a feature reports nothing for it. ``sink`` must tolerate a repeated ``batch_id``, as ``folder_sink`` does.
    Pass ``fitted`` (of ``fit_reference``) to keep the edges over restarts instead of reading the reference again.
    A stream that limits files or bytes per trigger is cut into batches of that size.
    """
    spark = reference.sparkSession
    fitted = fitted or fit_reference(reference, features, bins, digits=digits)
    expected = expected_counts(spark, fitted, bins)

    def report(batch: DataFrame, batch_id: int) -> None:
        sink(batch_drift(batch, batch_id, fitted, expected, bins), batch_id)

    return (
        stream.writeStream.foreachBatch(report).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start()
    )
