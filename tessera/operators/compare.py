"""Similarities by name, as series, matrices and means, and clusters by name, for frames with bit fingerprints."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import grouping, vectors
from .vectors import BROADCAST_BYTES


def identity(a: Column, b: Column) -> Column:
    """1 where two values are equal, 0 where they aren't; null where one is null."""
    return (a == b).cast("double")


#: Similarities by name, of two fingerprints (words of 32 bits) or of any two values.
SIMILARITIES: dict[str, Callable[[Column, Column], Column]] = {"tanimoto": vectors.tanimoto, "dice": vectors.dice, "identity": identity}


def series(df: DataFrame, value: str, like: Column, how: str = "tanimoto", distance: bool = False) -> DataFrame:
    """df with the similarity of value to a given one; distance: 1 less it."""
    s = SIMILARITIES[how](F.col(value), like)
    return df.withColumn("distance" if distance else "similarity", 1 - s if distance else s)


def matrix(left: DataFrame, right: DataFrame, key: str, value: str, how: str = "tanimoto", distance: bool = False) -> DataFrame:
    """(a, b, similarity or distance) of each row of left with each of right: stated sets, as the result has a row for each pair.

    right is broadcast if its measured values take up to BROADCAST_BYTES; a larger one meets left block by block in Spark's
    nested loops, which take the time that so many pairs take.
    """
    a = left.select(F.col(key).alias("a"), F.col(value).alias("_x"))
    b = right.select(F.col(key).alias("b"), F.col(value).alias("_y"))
    size = b.agg(F.coalesce(F.sum(F.length(F.col("_y").cast("string"))), F.lit(0))).first()[0]
    s = SIMILARITIES[how](F.col("_x"), F.col("_y"))
    return a.crossJoin(F.broadcast(b) if size <= BROADCAST_BYTES else b).select("a", "b", (1 - s if distance else s).alias("distance" if distance else "similarity"))


def mean(cells: DataFrame, value: str = "similarity") -> DataFrame:
    """One row: the mean of a matrix without its diagonal; null with fewer than two rows."""
    return cells.where("a <> b").agg(F.avg(value).alias("mean"))


def _butina(df: DataFrame, key: str, value: str, cutoff: float) -> DataFrame:
    rows = df.select(key, value)
    return grouping.butina(vectors.tanimoto_pairs(rows, key, value, cutoff), rows, key)


def _equal(df: DataFrame, key: str, value: str, cutoff: float) -> DataFrame:
    return vectors.clusters_of_equal(df, key, value)


#: Ways to cluster by name: f(df, key, value, cutoff) -> (key, cluster).
CLUSTERINGS: dict[str, Callable[[DataFrame, str, str, float], DataFrame]] = {"butina-tanimoto": _butina, "identity": _equal}


def cluster(df: DataFrame, key: str, value: str, how: str = "butina-tanimoto", cutoff: float = 0.6) -> DataFrame:
    """(key, cluster) of all rows by a named way; KeyError for an unknown one."""
    return CLUSTERINGS[how](df, key, value, cutoff)


def cluster_pairs(pairs: DataFrame, nodes: DataFrame, key: str, cutoff: float) -> DataFrame:
    """(key, cluster) from a similarity matrix (a, b, similarity): leader clusters of the pairs at or over the cutoff."""
    return grouping.butina(pairs.where((F.col("a") < F.col("b")) & (F.col("similarity") >= cutoff)).select("a", "b"), nodes, key)


def with_clusters(df: DataFrame, key: str, value: str, how: str = "butina-tanimoto", cutoff: float = 0.6) -> DataFrame:
    """df with the column cluster."""
    return df.join(cluster(df, key, value, how, cutoff), key)


def with_plane(df: DataFrame, key: str, vector: str) -> DataFrame:
    """df with x and y: its vectors' places on their two principal axes; signs are arbitrary."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = df.withColumn("_v", array_to_vector(F.col(vector).cast("array<double>")))
    placed = PCA(k=2, inputCol="_v", outputCol="_p").fit(rows).transform(rows).withColumn("_p", vector_to_array("_p"))
    return placed.withColumns({"x": F.col("_p")[0], "y": F.col("_p")[1]}).drop("_v", "_p")


def explained_plane(spark: SparkSession, df: DataFrame, vector: str) -> DataFrame:
    """One row (share_x, share_y): how much of the vectors' variance the two principal axes hold."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector

    model = PCA(k=2, inputCol="_v", outputCol="_p").fit(df.select(array_to_vector(F.col(vector).cast("array<double>")).alias("_v")))
    return spark.createDataFrame([tuple(float(x) for x in model.explainedVariance)], "share_x double, share_y double")
