"""Whitening of embeddings by the singular values of centred rows (operator 11).

Every entry becomes a whole number (``vectors.quantised``).  The fit list is each different vector once, so copies don't weigh in.  Its
rows, less their mean, are a distributed matrix of Spark MLlib whose ``computeSVD`` gives right singular vectors (the components) and
singular values s; s * s / n is the variance along a component, n the number of rows.  All singular values are asked for, so MLlib takes
the dense solver over the Gramian and no iteration is cut short.  The total variance doesn't come from there: the deviations
(n * x - S) ** 2, S being the exact sums, are added up as whole numbers.

Driver and tasks hold a square of the number of dimensions at most.  The rows pass through twice: once for sums and the Gramian, once to be projected.

Nulls: vectors that are null or hold null or non-finite entries are dropped, rows without vec_id are kept.  Short vectors are filled up
with zeros.  A component without variance (less than 1e-14 of the first) is left out, so copies of a single vector, like an empty
table, give no rows.  Repeated rows are given as often as they stand there.  Other columns are ignored.  ``deviation`` is a decimal of
38 digits; cast to a long, as the query does, it raises an error where it doesn't fit.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise
from .vectors import embeddings, matrix, quantised

COMPONENTS = 4
FACTOR = 256
#: Singular values below this share of the first are noise of the Gramian.
NOISE = 1e-7
_ROWS = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


def whiten(df: DataFrame, components: int = COMPONENTS, factor: int = FACTOR) -> DataFrame:
    """For each row and component: what stands in ``_ROWS``."""
    spark = df.sparkSession
    rows = quantised(df, factor, [F.col("vec_id").cast("long").alias("vec_id")])
    width = rows.agg(F.max(F.size("x"))).first()[0] or 0
    filled = F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("x")))
    rows = materialise(rows.select("vec_id", filled.alias("x")))
    fit = materialise(rows.select("x").distinct())
    n, *sums = fit.agg(F.count("*"), *(F.sum(F.col("x")[d]) for d in range(width))).first()
    if not n or not width:
        return spark.createDataFrame([], _ROWS)

    s = F.array(*(F.lit(v).cast("long") for v in sums))
    whole = lambda v: F.lit(Decimal(v))
    squares = F.aggregate("x", F.lit(0).cast("long"), lambda a, x: a + x * x).cast("decimal(20,0)")
    across = F.aggregate(F.zip_with("x", s, lambda x, t: x * t), F.lit(0).cast("long"), lambda a, x: a + x).cast("decimal(20,0)")
    # (n x - S) ** 2 summed over the dimensions, multiplied out: one product of long numbers for each row.
    deviation = (whole(n * n) * squares - whole(2 * n) * across + whole(sum(v * v for v in sums))).cast("decimal(38,0)")

    centred = F.zip_with("x", s, lambda x, t: (x * n - t).cast("double") / n)
    vectors = MLUtils.convertVectorColumnsFromML(fit.select(array_to_vector(centred).alias("v")), "v")
    found = RowMatrix(vectors, n, width).computeSVD(width, computeU=False, rCond=NOISE)
    variance = [v * v / n for v in found.s.toArray()[:components] if v > 0]
    ways = found.V.toArray()[:, : len(variance)] / np.sqrt(variance)
    total = int(fit.agg(F.sum(deviation)).first()[0]) / n**3
    mean = np.array(sums, dtype=object)

    def project(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        away = mean.astype(np.int64)
        for x in batches:
            yield pa.array(list(((matrix(x, width) * n - away) / n) @ ways), pa.list_(pa.float64()))

    projected = F.arrow_udf(project, "array<double>")("x")
    each = fit.select(projected.alias("w"))
    pairs = [(i, j) for i in range(len(variance)) for j in range(i + 1)]
    if not pairs:
        return spark.createDataFrame([], _ROWS)
    entries = each.agg(*(F.covar_pop(F.col("w")[i], F.col("w")[j]) for i, j in pairs)).first()
    error = max(abs(v - (i == j)) for v, (i, j) in zip(entries, pairs))
    if not math.isfinite(error):
        raise ValueError("the whitened rows have no finite covariance")

    explained = F.array(*(F.lit(float(e / total)) for e in variance))
    out = rows.select("vec_id", deviation.alias("deviation"), F.posexplode(projected).alias("at", "whitened"))
    return out.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", F.element_at(explained, F.col("at") + 1).alias("explained"), F.lit(float(error)).alias("identity_error"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(embeddings(spark, sf_dir)).withColumn("deviation", F.col("deviation").cast("long"))
