"""Whitening of vectors on the leading components of their covariance.

Entries become whole numbers, so sums and means are exact however the rows are split.
1. The fit list is every distinct vector once; its count and sums come from one aggregate.
2. Each partition of it adds up the products of centred entries; the rows of these
   partial matrices are added on the cluster, one row of the matrix at a time.
3. The driver gets the finished matrix, whose size is that of a vector, and finds its
   leading eigenpairs (``symmetric_eigen``).
4. Components are sent to all tasks, a few numbers per dimension, and every row is projected.

Vectors of different length are separate fits throughout.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from footfall.llm.common import materialize
from footfall.llm.symmetric_eigen import EPS, leading_pairs

COMPONENTS = 16
# Entries are counted in steps of 1/64, from below zero.
STEP, SHIFT = 64, 1_000_000
# An entry of a larger absolute value has no exact whole number of steps.
LARGEST = 2.0**46
_PART = "dims int, row int, part int, sums array<double>"


@dataclass(frozen=True)
class Fit:
    """Count and sums of the distinct vectors of a length, with their leading components as columns."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float = 0.0


def usable(vector: Column) -> Column:
    """True for a vector of finite entries."""
    return vector.isNotNull() & ~F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) > LARGEST))


def steps(vector: Column) -> Column:
    return F.transform(vector, lambda c: F.floor(c.cast("double") * STEP).cast("long") + SHIFT)


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n * x - sums, exact."""
    if int(np.abs(x).max(initial=0)) * n + int(np.abs(sums).max(initial=0)) < 1 << 62:
        return n * x - sums
    return n * x.astype(object) - sums.astype(object)


def _by_length(frame: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions in the frame, vectors as rows) for each length."""
    length = frame["x"].map(len).to_numpy()
    for dims in np.unique(length):
        at = np.flatnonzero(length == dims)
        yield at, np.array(frame["x"].iloc[at].tolist(), dtype=np.int64).reshape(len(at), dims)


def _matrix(fit_list: DataFrame, entries: Callable[[np.ndarray], np.ndarray]) -> dict[int, np.ndarray]:
    """Sums of products of each two entries over the fit list, by length of the vectors."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, x in _by_length(batch):
                c = entries(x)
                sums[x.shape[1]] = sums.get(x.shape[1], 0) + c.T @ c
        part = TaskContext.get().partitionId()
        for dims, m in sums.items():
            for row in range(0, len(m), 256):
                some = range(row, min(row + 256, len(m)))
                yield pd.DataFrame({"dims": dims, "row": list(some), "part": part, "sums": [m[i] for i in some]}).astype({"dims": "int32", "row": "int32", "part": "int32"})

    def added(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, total = None, None
        for batch in batches:
            done = []
            for dims, row, part, sums in zip(batch["dims"], batch["row"], batch["part"], batch["sums"]):
                if (dims, row) != key:
                    if key is not None:
                        done.append((*key, 0, total))
                    key, total = (dims, row), np.zeros(len(sums))
                total = total + sums
            yield pd.DataFrame(done, columns=["dims", "row", "part", "sums"])
        if key is not None:
            yield pd.DataFrame([(*key, 0, total)], columns=["dims", "row", "part", "sums"])

    parts = fit_list.mapInPandas(partial, _PART).repartition("dims", "row").sortWithinPartitions("dims", "row", "part")
    out: dict[int, dict[int, np.ndarray]] = {}
    for r in materialize(parts.mapInPandas(added, _PART), "products").toLocalIterator():
        out.setdefault(r.dims, {})[r.row] = np.array(r.sums)
    return {dims: np.array([rows[i] for i in sorted(rows)]) for dims, rows in out.items()}


def _sums(fit_list: DataFrame) -> dict[int, tuple[int, np.ndarray]]:
    """Count and exact sums of the fit list, by length."""
    entries = fit_list.select(F.size("x").alias("dims"), F.posexplode("x").alias("at", "value"))
    rows = entries.groupBy("dims", "at").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("s"))
    out: dict[int, tuple[int, dict[int, int]]] = {}
    for r in materialize(rows, "sums").toLocalIterator():
        out.setdefault(r.dims, (r.n, {}))[1][r.at] = r.s
    return {dims: (n, np.array([s[i] for i in sorted(s)], dtype=np.int64)) for dims, (n, s) in out.items()}


def _projected(c: np.ndarray, fit: Fit) -> np.ndarray:
    """Exact centred entries to whitened ones.

    Added up entry by entry: a row's result must not depend on the rows beside it.
    """
    centred = (c / fit.n).astype(np.float64)
    out = np.zeros((len(c), len(fit.values)))
    for k, weights in enumerate(fit.vectors):
        out += centred[:, k : k + 1] * weights
    return out / np.sqrt(fit.values)


def fits(fit_list: DataFrame, components: int = COMPONENTS) -> dict[int, Fit]:
    """The fit of each length of vector, from rows x of distinct vectors in steps.

    Components without variance, told by the precision of doubles, are left out.
    """
    spark = fit_list.sparkSession
    sums = _sums(fit_list)
    known = spark.sparkContext.broadcast(sums)

    def centred(x: np.ndarray) -> np.ndarray:
        n, s = known.value[x.shape[1]]
        return (_centred(x, n, s) / n).astype(np.float64)

    found = {}
    for dims, products in _matrix(fit_list.where(F.size("x") > 0), centred).items():
        n, s = sums[dims]
        covariance = products / n
        covariance = (covariance + covariance.T) / 2
        values, vectors = leading_pairs(covariance, components)
        real = values > dims * EPS * max(values.max(initial=0), 0)
        found[dims] = Fit(n, s, values[real], vectors[:, real], float(np.trace(covariance)))
    shared = spark.sparkContext.broadcast(found)

    def whitened(x: np.ndarray) -> np.ndarray:
        fit = shared.value[x.shape[1]]
        return _projected(_centred(x, fit.n, fit.sums), fit)

    for dims, products in _matrix(fit_list.where(F.size("x") > 0), whitened).items():
        fit = found[dims]
        error = float(np.abs(products / fit.n - np.eye(len(fit.values))).max(initial=0))
        found[dims] = Fit(fit.n, fit.sums, fit.values, fit.vectors, fit.trace, error)
    return found


def whiten(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Rows (key, component, n, deviation, whitened, explained, identity_error) of all usable vectors.

    A vector that is null or has an entry that is null, not finite or above 2^46 in size is
    dropped.  Entries are taken in steps of 1/64.  deviation is an exact decimal(38,0).  Rows that repeat a
    vector count once in the fit and are all returned, as are null and repeated keys.  Vectors of
    different length are fitted apart; where a fit has fewer components with variance (a single distinct
    vector has none), there are rows for those only.  Other columns are not returned.  An empty table gives none.
    """
    x = steps(F.col(f"`{vector}`").cast("array<double>"))
    rows = vectors.where(usable(F.col(f"`{vector}`").cast("array<double>"))).select(F.col(f"`{key}`"), x.alias("x"))
    fit_list = materialize(rows.select("x").distinct(), "fit_list")
    shared = rows.sparkSession.sparkContext.broadcast(fits(fit_list, components))

    @pandas_udf("deviation string, n long, identity_error double, whitened array<double>, explained array<double>")
    def project(x: pd.Series) -> pd.DataFrame:
        frame = pd.DataFrame({"x": x.to_numpy()})
        out: list = [("0", 0, 0.0, [], [])] * len(frame)
        for at, some in _by_length(frame):
            fit = shared.value.get(some.shape[1])
            if fit is None:
                continue
            c = _centred(some, fit.n, fit.sums)
            if c.dtype != object and int(np.abs(c).max(initial=0)) ** 2 * c.shape[1] >= 1 << 63:
                c = c.astype(object)
            deviation, white = (c * c).sum(axis=1), _projected(c, fit)
            share = fit.values / fit.trace
            for k, i in enumerate(at.tolist()):
                out[i] = (str(deviation[k]), fit.n, fit.identity_error, white[k], share)
        return pd.DataFrame(out, columns=["deviation", "n", "identity_error", "whitened", "explained"])

    made = rows.select(F.col(f"`{key}`"), project("x").alias("__made"))
    each = made.select(F.col(f"`{key}`"), "__made", F.posexplode("__made.whitened").alias("__at", "__white"))
    return each.select(
        F.col(f"`{key}`"), (F.col("__at") + 1).cast("int").alias("component"), F.col("__made.n").alias("n"),
        F.col("__made.deviation").cast("decimal(38,0)").alias("deviation"), F.col("__white").alias("whitened"),
        F.element_at("__made.explained", F.col("__at") + 1).alias("explained"), F.col("__made.identity_error").alias("identity_error"),
    )
