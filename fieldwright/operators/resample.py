"""Cluster bootstrap whose resampling weights are hashes of draw and cluster, aggregated by Spark.

`times_of` gives the weights of many draws at once to the tasks that sum them; `with_times` is the same hash on Columns.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from fieldwright.code import ship_code

#: Hashes are numbers modulo this prime; products of two stay within 64 bits.
PRIME = 2_147_483_647
#: Multipliers of the hash (primitive roots of PRIME).
STEPS = (48_271, 69_621, 16_807)
#: A cluster comes at most so many times in a draw (more has a chance of 1e-10).
MOST = 12
#: From which hash on a cluster comes once, twice, ...: cumulated Poisson probabilities of mean 1.
BOUNDS = [math.ceil(PRIME * sum(math.exp(-1) / math.factorial(j) for j in range(k + 1))) for k in range(MOST)]


def cluster_hashes(cluster: Column) -> tuple[Column, Column]:
    """Two numbers below PRIME of a cluster's text."""
    digest = F.md5(cluster.cast("string"))
    return tuple(F.conv(F.substring(digest, at, 7), 16, 10).cast("long") for at in (1, 8))


def with_times(cells: DataFrame, seed: int) -> DataFrame:
    """cells(__draw, __one, __two, ...) with __times: how often the cluster comes in the draw, Poisson with mean 1.

    A hash of draw and cluster, squares between linear steps; each step is a projection, so all stay in generated code.
    """
    a, b, c = STEPS
    draw, one, two, x, y, z, u = (F.col(f"__{n}") for n in ("draw", "one", "two", "x", "y", "z", "u"))
    r = cells.withColumn("__x", (one + (draw + seed % PRIME) * b) % PRIME)
    r = r.withColumn("__y", (x * x % PRIME * a + two) % PRIME)
    r = r.withColumn("__z", (y * y % PRIME * b + draw * c + one) % PRIME)
    r = r.withColumn("__u", (z * z % PRIME * c + two + x) % PRIME)
    return r.withColumn("__times", sum(((u >= bound).cast("int") for bound in BOUNDS), F.lit(0))).drop("__x", "__y", "__z", "__u")


def _rest(x: np.ndarray) -> np.ndarray:
    """x modulo PRIME, which is 2 ** 31 - 1: the upper bits are added to the lower ones."""
    x = (x & PRIME) + (x >> 31)
    x = (x & PRIME) + (x >> 31)
    return np.where(x == PRIME, 0, x)


def times_of(one: np.ndarray, two: np.ndarray, draws: np.ndarray, seed: int) -> np.ndarray:
    """How often each cluster comes in each draw, as `with_times` tells: (cluster, draw)."""
    a, b, c = STEPS
    one, two, draw = one[:, None], two[:, None], draws[None, :]
    x = _rest(one + (draw + seed % PRIME) * b)
    y = _rest(_rest(x * x) * a + two)
    z = _rest(_rest(y * y) * b + draw * c + one)
    u = _rest(_rest(z * z) * c + two + x).astype(np.int32)
    times = np.zeros(u.shape, np.uint8)
    for bound in BOUNDS[:4]:
        times += u >= bound
    often = u >= BOUNDS[3]
    for bound in BOUNDS[4:]:
        times[often] += u[often] >= bound
    return times


#: Weights that are worked out at once, and sums that a task holds before it sends them on.
_CELLS, _HELD = 1 << 18, 1 << 21


def _draw_sums(n_by: int, n_parts: int, draws: int, seed: int, schema: pa.Schema) -> Callable:
    """Batches of (by, parts, __one, __two), equal clusters one after another, to sums by group and draw."""

    def send(held: dict) -> Iterator[pa.RecordBatch]:
        draw = pa.array(np.arange(-1, draws))
        for by, total in held.items():
            keys = [pa.array([v], f.type).take(pa.array(np.zeros(draws + 1, np.int32))) for v, f in zip(by, schema, strict=False)]
            counts = pa.array(total[:, -1].astype(np.int64))
            yield pa.RecordBatch.from_arrays([*keys, draw, *[pa.array(total[:, i]) for i in range(n_parts)], counts], schema=schema)

    def run(batches):
        held: dict[tuple, np.ndarray] = {}
        for batch in batches:
            group = np.zeros(batch.num_rows, np.int64)
            for i in range(n_by):
                coded = batch.column(i).dictionary_encode()
                codes = np.asarray(coded.indices.fill_null(len(coded.dictionary)), np.int64)
                group = np.unique(group * (len(coded.dictionary) + 1) + codes, return_inverse=True)[1]
            kinds, sample, group = np.unique(group, return_index=True, return_inverse=True)
            names = list(zip(*[batch.column(i).take(pa.array(sample)).to_pylist() for i in range(n_by)], strict=True)) if n_by else [()] * len(kinds)
            # A row is a column of the product, so a cluster's weights are made once for all rows that lie together.
            one, two = (np.asarray(batch.column(n_by + n_parts + i), np.int64) for i in range(2))
            new = np.ones(len(one), bool)
            new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
            begin, of = np.flatnonzero(new), np.cumsum(new) - 1
            values = np.stack([np.asarray(batch.column(n_by + i), np.float64) for i in range(n_parts)] + [np.ones(len(one))], 1)
            step = max(1, _CELLS // max(draws, 1))
            for lo in range(0, len(begin), step):
                first = begin[lo]
                last = begin[lo + step] if lo + step < len(begin) else len(one)
                weights = times_of(one[begin[lo : lo + step]], two[begin[lo : lo + step]], np.arange(draws), seed).astype(np.float64)
                here, at = group[first:last], of[first:last] - lo
                for g in np.unique(here).tolist():
                    rows = np.flatnonzero(here == g)
                    own = values[first:last][rows]
                    total = held.setdefault(names[g], np.zeros((draws + 1, n_parts + 1)))
                    total[0] += own.sum(0)
                    total[1:] += weights[at[rows]].T @ own
                if len(held) * (draws + 1) * (n_parts + 1) > _HELD:
                    yield from send(held)
                    held = {}
        yield from send(held)

    return run


def cluster_sums(rows: DataFrame, by: Iterable[str], cluster: Column, parts: dict[str, Column]) -> DataFrame:
    """(by, cluster, parts): what each cluster adds to the sums; `parts` are aggregates that add up, such as sums and counts."""
    return rows.groupBy(*by, cluster.alias("cluster")).agg(*[c.alias(n) for n, c in parts.items()])


def hash_bootstrap(
    clusters: DataFrame, by: Iterable[str], parts: Iterable[str], statistic: Callable[..., Column], draws: int = 1000, alpha: float = 0.05, seed: int = 20260101
) -> DataFrame:
    """(by, point, lo, hi, n_clusters): a statistic of sums over clusters and its percentile interval.

    clusters(by, cluster, parts) has a row a cluster (`cluster_sums`); statistic takes the sums of `parts`, in their order,
    and gives a Column, null where it has no value. Each cluster comes Poisson(1) times in each draw, told from draw and
    cluster alone, so reruns agree, no draw needs all clusters in one place, and partial sums are made before the shuffle:
    behind it there are `draws` rows a task and group, whatever the number of clusters. Draws without a value are left out
    of the percentiles, which interpolate. Null groups are a group; a null cluster is a cluster; null parts add nothing;
    an empty table gives no rows. A task makes the weights of a few hundred clusters at a time, once for all groups that
    have the cluster there, and sums by them are a product of matrices.
    """
    by, parts = list(by), list(parts)
    ship_code(clusters.sparkSession)
    own = [F.coalesce(F.col(p).cast("double"), F.lit(0.0)).alias(p) for p in parts]
    one, two = cluster_hashes(F.coalesce(F.concat(F.lit("="), F.col("cluster").cast("string")), F.lit("null")))
    base = clusters.select(*by, *own, one.alias("__one"), two.alias("__two")).sortWithinPartitions("__one", "__two")
    # Draw -1 has each cluster once: the point. So the clusters are made and read once.
    kinds = [base.schema[c] for c in by]
    kinds += [T.StructField(n, k) for n, k in (("__draw", T.LongType()), *((p, T.DoubleType()) for p in parts), ("__n", T.LongType()))]
    schema = T.StructType([T.StructField(k.name, k.dataType) for k in kinds])
    sums = base.mapInArrow(_draw_sums(len(by), len(parts), draws, seed, to_arrow_schema(schema)), schema)
    drawn = sums.groupBy(*by, "__draw").agg(*[F.sum(p).alias(p) for p in parts], F.sum("__n").alias("__n"))
    whole = F.col("__draw") < 0
    told = drawn.select(*by, whole.alias("__whole"), "__n", statistic(*[F.col(p) for p in parts]).alias("__value"))
    ends = F.percentile(F.when(~F.col("__whole"), F.col("__value")), F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2)))
    out = told.groupBy(*by).agg(F.max(F.when(F.col("__whole"), F.col("__value"))).alias("point"), ends.alias("__ends"), F.max(F.when(F.col("__whole"), F.col("__n"))).alias("n_clusters"))
    return out.select(*by, "point", F.get("__ends", F.lit(0)).alias("lo"), F.get("__ends", F.lit(1)).alias("hi"), "n_clusters")


def ratio(num: Column, den: Column) -> Column:
    """num over den, null where den is 0."""
    return F.try_divide(num, den)
