"""A synthetic cloud of three clusters, generated in parallel from a seed; each row depends on its number alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Centre, spread and colour of the clusters.
CLUSTERS = (((-1.5, 0.0, 0.0), 0.35, (0.9, 0.2, 0.2)), ((1.5, 0.5, 0.0), 0.45, (0.2, 0.9, 0.2)), ((0.0, -0.5, 1.5), 0.55, (0.2, 0.2, 0.9)))


def cloud(spark: SparkSession, n: int, seed: int = 7) -> DataFrame:
    def uniform(k: int):
        h = F.xxhash64(F.col("splat_id"), F.lit(seed), F.lit(k))
        return (F.pmod(h, F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)

    def normal(k: int):
        return F.sqrt(-2 * F.ln(uniform(2 * k))) * F.cos(6.283185307179586 * uniform(2 * k + 1))

    pick = F.pmod(F.col("splat_id"), F.lit(len(CLUSTERS)))
    choose = lambda values: F.element_at(F.array(*[F.lit(float(v)) for v in values]), (pick + 1).cast("int"))
    xyz = [choose([c[0][k] for c in CLUSTERS]) + choose([c[1] for c in CLUSTERS]) * normal(k) for k in range(3)]
    quat = [normal(10 + k) for k in range(4)]
    length = F.sqrt(sum((q * q for q in quat[1:]), quat[0] * quat[0]))
    sign = F.when(quat[3] < 0, -1.0).otherwise(1.0)
    color = F.array(*[((choose([c[2][k] for c in CLUSTERS]) - 0.5) / 0.28209479177387814).cast("float") for k in range(3)])
    return spark.range(n).withColumnRenamed("id", "splat_id").select("splat_id", *[v.cast("float").alias(c) for v, c in zip(xyz, "xyz")], *[(-4.5 + 0.5 * normal(20 + k)).cast("float").alias(f"s{k}") for k in range(3)], *[(q / length * sign).cast("float").alias(f"q{c}") for q, c in zip(quat, "xyzw")], (0.2 + 0.75 * uniform(60)).cast("float").alias("opacity"), color.alias("sh"))
