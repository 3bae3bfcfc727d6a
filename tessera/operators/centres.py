"""K-means clusters of vectors and rows drawn as first centres."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import Stage
from .vectors import _sum_of


def usable(df: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector isn't null or empty and has finite entries only."""
    return df.where((F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))))


def seed_rows(df: DataFrame, key: str, vector: str, k: int, seed: int = 0) -> DataFrame:
    """(pos, key, vector) of k rows drawn as first centres: the first evenly, each further one with chances that follow its squared distance
    from the centres drawn before; fewer, if there are fewer different vectors.

    A draw is a race: the row with the least -ln(u) / weight wins, where u follows from a hash of seed, draw and key. So a draw is one
    partial aggregate over rows that carry their distance so far, nothing is gathered, and a lost task gives the same rows again.
    """
    stage = Stage(df.sparkSession, "seeds")
    rows = stage(usable(df, vector).select(key, F.col(vector).cast("array<double>").alias("_v"), F.lit(1.0).alias("_d")))
    drawn: list[tuple] = []
    for pos in range(k):
        u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(pos), key), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
        best = rows.where("_d > 0").agg(F.min(F.struct((-F.ln(u) / F.col("_d")).alias("at"), F.col(key).alias("key"), F.col("_v").alias("v"))).alias("b")).first().b
        if best is None:
            break
        drawn.append((pos, best.key, best.v))
        centre = F.array(*[F.lit(x) for x in best.v])
        away = _sum_of(F.col("_v"), centre, lambda x, y: (x - y) * (x - y))
        before, rows = rows, stage(rows.withColumn("_d", away if pos == 0 else F.least("_d", away)))
        stage.drop(before)
    stage.drop(rows)
    return df.sparkSession.createDataFrame(drawn, f"pos int, {key} {dict(df.dtypes)[key]}, {vector} array<double>")


def kmeans(df: DataFrame, key: str, vector: str, k: int, seed: int = 0, rounds: int = 20) -> tuple[DataFrame, DataFrame]:
    """((key, cluster), (cluster, centre)): k-means clusters by Euclidean distance; rows that aren't usable() have none.

    Spark's parallel k-means: only the k centres pass through the driver.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = usable(df, vector).select(key, array_to_vector(F.col(vector).cast("array<double>")).alias("_f"))
    model = KMeans(k=k, seed=seed, maxIter=rounds, featuresCol="_f", predictionCol="cluster").fit(rows)
    centres = df.sparkSession.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], "cluster int, centre array<double>")
    return model.transform(rows).select(key, "cluster"), centres
