"""Vector arithmetic on array columns, in double precision (VEC-*, AGG-1 to AGG-4, STR-8, STR-9).

Null vectors give null. A zero vector stays zero when normalised; its cosine is null, or
NaN with ``compat`` as a database's distance operator gives it.
"""

from __future__ import annotations

import hashlib
import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _double(v: Column | str) -> Column:
    return (F.col(v) if isinstance(v, str) else v).cast("array<double>")


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(_double(a), _double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column | str) -> Column:
    return F.sqrt(F.aggregate(_double(v), F.lit(0.0), lambda s, x: s + x * x))


def l2norm(v: Column | str) -> Column:
    """Unit vector; a norm of zero or NaN divides by one."""

    def scaled(n: Column) -> Column:
        by = F.when((n == 0) | F.isnan(n), F.lit(1.0)).otherwise(n)
        return F.transform(_double(v), lambda x: x / by)

    # The norm as a lambda's variable is computed once, not for every component.
    return F.get(F.transform(F.array(norm(v)), scaled), F.lit(0))


def cosine(a: Column | str, b: Column | str, compat: bool = False) -> Column:
    """dot / sqrt(|a|^2 |b|^2), within [-1, 1]: exactly 1 for equal vectors."""
    product = dot(a, a) * dot(b, b)
    value = dot(a, b) / F.sqrt(F.when(product == 0, None).otherwise(product))
    bounded = F.least(F.greatest(value, F.lit(-1.0)), F.lit(1.0))
    none = F.lit(float("nan")) if compat else F.lit(None).cast("double")
    return F.when(product == 0, none).when(product.isNotNull(), bounded)


def blend(a: Column | str, b: Column | str, weight: float) -> Column:
    """weight a + (1 - weight) b."""
    return F.zip_with(_double(a), _double(b), lambda x, y: x * weight + y * (1 - weight))


def vector_mean(rows: DataFrame, keys: list[str], vector: str, name: str = "embedding") -> DataFrame:
    """Element-wise mean of the non-null vectors of each group; groups without one are absent.

    One row per component is aggregated before the shuffle, so a group of any size sends
    at most one row per component from each task.
    """
    parts = rows.where(F.col(vector).isNotNull()).select(*keys, F.posexplode(_double(vector)).alias("i", "x"))
    means = parts.groupBy(*keys, "i").agg(F.avg("x").alias("x"))
    packed = means.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("p"))
    return packed.select(*keys, F.col("p.x").alias(name))


def centroid(rows: DataFrame, keys: list[str], vector: str, name: str = "centroid") -> DataFrame:
    """Mean of unit vectors, normalised again (AGG-3)."""
    unit = rows.withColumn("_unit", l2norm(vector))
    return vector_mean(unit, keys, "_unit", "_mean").select(*keys, l2norm("_mean").alias(name))


def format_rounded(x: Column | str, digits: int = 3) -> Column:
    """A number with a fixed number of decimals, as playlists are listed (STR-8)."""
    return F.format_string(f"%.{digits}f", (F.col(x) if isinstance(x, str) else x).cast("double"))


def format_vector(v: Column | str) -> Column:
    """[0.123456,...] with six decimals, as C's printf gives them.

    The exact value is rounded, half to even; Java's formatter rounds its shortest decimal
    half up. Null components are left out.
    """

    def run(vectors: pa.Array) -> pa.Array:
        return pa.array([None if x is None else "[" + ",".join(["%.6f" % y for y in x if y is not None]) + "]" for x in vectors.to_pylist()], pa.string())

    return F.arrow_udf(run, "string")(_double(v))


def parse_vector(text: Column | str) -> Column:
    return F.from_json(text, "array<double>")


def has_nan(v: Column | str) -> Column:
    return F.exists(_double(v), lambda x: F.isnan(x))


# ---------------------------------------------------------------- seeded randomness


def hash_uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the parts' text: the same on every layout and engine (RND-6)."""
    text = F.concat_ws(":", *(p.cast("string") for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / 4294967296.0


def gumbel(*parts: Column) -> Column:
    """Gumbel noise: the argmax of score / T + noise is a softmax draw at temperature T."""
    return -F.log(-F.log(F.greatest(hash_uniform(*parts), F.lit(1e-12))))


def hash_number(*parts: object) -> float:
    """``hash_uniform`` of the same parts in a Python worker."""
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:8], 16) / 4294967296.0


def gumbel_number(*parts: object) -> float:
    """``gumbel`` of the same parts in a Python worker."""
    return -math.log(-math.log(max(hash_number(*parts), 1e-12)))
