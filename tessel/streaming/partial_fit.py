"""Models that learn from streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def class_moments(stream: DataFrame, label: str, value: str) -> DataFrame:
    """(class, n, s, ss): mergeable state of a Gaussian per class; a new class may come at any time. Batch or stream."""
    v = F.col(value).cast("double")
    return stream.groupBy(F.col(label).alias("class")).agg(F.count("*").alias("n"), F.sum(v).alias("s"), F.sum(v * v).alias("ss"))


def run_available(stream: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """What a streaming aggregate holds after all input that is there, as a table in memory (of small results)."""
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)


class MiniBatchKMeans:
    """Centres that move by 1 / count towards each row, batch by batch; rows of a batch go by key, as sums of its
    clusters: the mean of the batch's rows with the weight of their number."""

    def __init__(self, centers: list[list[float]]) -> None:
        self.centers, self.counts = centers, [0] * len(centers)

    def partial_fit(self, batch: DataFrame, key: str, vec: str) -> None:
        from tessel.operators.models import lloyd

        spark = batch.sparkSession
        now = spark.createDataFrame(list(enumerate(self.centers)), "cluster int, center array<double>")
        for r in lloyd(batch, key, vec, now).collect():
            i, n = r["cluster"], r["n"]
            self.counts[i] += n
            self.centers[i] = [a + (b - a) * n / self.counts[i] for a, b in zip(self.centers[i], r["center"], strict=True)]
