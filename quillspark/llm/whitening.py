"""Embedding whitening: principal components of the covariance by QDWH spectral divide and conquer, then one pass that projects every row."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame, functions as F

from quillspark.session import stored

EPS = float(np.finfo(float).eps)


def polar(a: np.ndarray) -> np.ndarray:
    """The orthogonal factor of a symmetric matrix's polar decomposition, by dynamically weighted Halley steps: with QR while the step's weights are large, then with Cholesky."""
    one = np.eye(len(a))
    x, least = a / max(np.linalg.norm(a), np.finfo(float).tiny), EPS / 4
    for _ in range(30):
        square = least * least
        d = np.cbrt(4 * (1 - square) / square / square)
        wide = np.sqrt(1 + d)
        p = wide + np.sqrt(8 - 4 * d + 8 * (2 - square) / (square * wide)) / 2
        q = (p - 1) ** 2 / 4
        r = p + q - 1
        if r > 100:
            both = np.linalg.qr(np.vstack((np.sqrt(r) * x, one)))[0]
            new = q / r * x + (p - q / r) / np.sqrt(r) * both[: len(a)] @ both[len(a) :].T
        else:
            low = np.linalg.cholesky(one + r * x.T @ x)
            new = q / r * x + (p - q / r) * np.linalg.solve(low.T, np.linalg.solve(low, x.T)).T
        new, least = (new + new.T) / 2, min(1.0, least * (p + q * square) / (1 + r * square))
        moved, x = np.linalg.norm(new - x), new
        if moved <= np.cbrt(4 * EPS) and 1 - least < 1e-8:
            break
    return x


def halves(a: np.ndarray, scale: float) -> tuple[np.ndarray, int] | None:
    """(q, r): an orthogonal q whose first r columns span the eigenvectors of ``a`` above some shift, the others those below; none if ``a`` is a multiple of one.

    The projector on the upper ones is (U + 1) / 2, U the polar factor of ``a`` less the shift. A shift that lies on an
    eigenvalue leaves the blocks coupled: then others are tried, and the least coupled is taken.
    """
    k, diagonal = len(a), np.diag(a)
    middle, spread = diagonal.mean(), np.linalg.norm(a - diagonal.mean() * np.eye(k)) / np.sqrt(k)
    if spread <= 4 * EPS * scale:
        return None
    draw, best = np.random.default_rng(k), None
    for shift in (np.median(diagonal), middle, *(middle + t * spread for t in (0.1, -0.1, 0.25, -0.25, 0.5, -0.5, 0.03, -0.03, 0.8, -0.8))):
        upper = (polar(a - shift * np.eye(k)) + np.eye(k)) / 2
        r = round(float(np.trace(upper)))
        if not 0 < r < k:
            continue
        q = np.linalg.qr(upper @ draw.standard_normal((k, r)), mode="complete")[0]
        for _ in range(2):
            q = np.linalg.qr(upper @ q[:, :r], mode="complete")[0]
        coupling = float(np.abs(q[:, :r].T @ a @ q[:, r:]).max())
        if best is None or coupling < best[0]:
            best = coupling, q, r
        if coupling <= 8 * EPS * scale:
            break
    return best and best[1:]


def components(covariance: np.ndarray, wanted: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(values, vectors): the ``wanted`` largest eigenvalues (all, if None) in falling order, and their unit eigenvectors as columns.

    Invariant subspaces are split again and again (``halves``) until each has one dimension, or one value; of two halves the lower one is split only where the
    upper one holds fewer than are wanted.
    """
    n, unit = len(covariance), float(np.abs(covariance).max(initial=0)) or 1.0
    covariance = covariance / unit  # squares of its entries neither overflow nor vanish
    wanted, scale = min(n, n if wanted is None else wanted), float(np.linalg.norm(covariance))
    vectors, todo = [], [np.eye(n)]
    while todo and len(vectors) < wanted:
        basis = todo.pop()
        block = basis.T @ covariance @ basis
        cut = halves((block + block.T) / 2, scale) if basis.shape[1] > 1 else None
        if cut is None:
            vectors += list(basis.T)
        else:
            todo += [basis @ cut[0][:, cut[1] :], basis @ cut[0][:, : cut[1]]]
    vectors = np.array(vectors).reshape(-1, n).T
    values = np.einsum("ij,ij->j", vectors, covariance @ vectors)
    order = np.argsort(-values, kind="stable")[:wanted]
    return values[order] * unit, vectors[:, order]


def integer_vectors(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """(vec_id, x): x holds floor(scale * c) of each component c. Rows whose vector is null or holds a null or non-finite component are left out; a null id stays."""
    bad = F.exists("c", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = table.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("c")).where(F.col("c").isNotNull()).where(~bad)
    return rows.select("vec_id", F.transform("c", lambda c: F.floor(scale * c.cast("double")).cast("long")).alias("x"))


def arrays(batch, width: int) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def summed(fit: DataFrame, width: int, rows_of: Callable[[np.ndarray], np.ndarray], kind: str) -> np.ndarray:
    """The matrix that ``rows_of`` makes of an integer matrix of vectors, summed up over all of ``fit``. A task adds up its batches and sends one row for each of the matrix's rows; those meet by row."""
    schema = f"i int, task int, v array<{kind}>"

    def add(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        total = None
        for batch in batches:
            if batch.num_rows:
                part = rows_of(arrays(batch, width))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_pydict({"i": pa.array(range(len(total)), pa.int32()), "task": pa.array([TaskContext.get().partitionId()] * len(total), pa.int32()), "v": pa.array(list(total))})

    def meet(batches: Iterator) -> Iterator:
        import pyarrow as pa

        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            values = batch.column("v").flatten().to_numpy().reshape(batch.num_rows, -1)
            for i, v in zip(batch.column("i").to_pylist(), values, strict=True):
                sums[i] = sums[i] + v if i in sums else v.copy()
        if sums:
            yield pa.RecordBatch.from_pydict({"i": pa.array(list(sums), pa.int32()), "task": pa.array([0] * len(sums), pa.int32()), "v": pa.array(list(sums.values()))})

    met = fit.mapInArrow(add, schema).repartition("i").sortWithinPartitions("i", "task").mapInArrow(meet, schema)
    return np.array([r.v for r in met.orderBy("i").collect()])  # a row for each dimension


def whitened(table: DataFrame, count: int = 4, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): each row's coordinates along the ``count`` leading components, in units of their standard deviation.

    A vector c becomes the integers x = floor(scale * c). The components are fitted on the n distinct x: their sums S are exact, their covariance (divisor n) is that of
    (n * x - S) / n, the numerator exact. What comes to the driver is one row for each dimension; ``components`` splits that matrix there, and the
    count * dimensions numbers of the projection go out with the tasks, whatever the number of rows. ``identity_error`` is measured by one more pass over the fit list.

    deviation: the sum of (n * x - S)^2, exact, null where it exceeds a long. explained: a component's share of the total variance.
    Rows whose vector is null or holds null or non-finite entries are left out. Shorter vectors count as
    filled up with zeros. Null and repeated ids stay, a row each. A component without variance beyond rounding is left out, so equal vectors, a single one or
    empty ones give no rows, nor does an empty table. Components of equal variance are any orthogonal ones. Other columns are ignored.
    """
    spark = table.sparkSession
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = integer_vectors(table, id_col, vector_col, scale)
    width = rows.agg(F.max(F.size("x"))).first()[0] or 0
    if not width:
        return spark.createDataFrame([], schema)
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("x"))).alias("x"))
    fit = stored(rows.select("x").distinct())
    sums = summed(fit, width, lambda x: np.vstack((x.sum(axis=0), np.full(width, len(x)))), "long")
    n, sums = int(sums[1, 0]), sums[0]
    largest = max(1, int(np.abs(sums).max()))

    def deviations(x: np.ndarray) -> np.ndarray:
        fits = n * int(np.abs(x).max(initial=0)) + largest < 2**62
        return n * (x if fits else x.astype(object)) - (sums if fits else sums.astype(object))

    def gram(x: np.ndarray) -> np.ndarray:
        y = deviations(x).astype(float) / n
        return y.T @ y

    covariance = summed(fit, width, gram, "double") / n
    values, vectors = components(covariance, min(count, width))
    good = values > width * EPS * max(values[0], np.finfo(float).tiny)
    values, vectors = values[good], vectors[:, good]
    if not len(values):
        return spark.createDataFrame([], schema)
    project, explained = vectors / np.sqrt(values), values / np.trace(covariance)

    def coordinates(x: np.ndarray) -> np.ndarray:
        return (deviations(x).astype(float) / n) @ project

    def spread(x: np.ndarray) -> np.ndarray:
        w = coordinates(x)
        return w.T @ w

    error = float(np.abs(summed(fit, width, spread, "double") / n - np.eye(len(values))).max())

    def told(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            x = arrays(batch, width)
            y, k = deviations(x), len(values)
            if y.dtype == object or width * int(np.abs(y).max(initial=0)) ** 2 >= 2**63:
                exact = [t if t < 2**63 else None for t in (sum(int(v) ** 2 for v in r) for r in y.tolist())]
            else:
                exact = (y * y).sum(axis=1)
            at = np.repeat(np.arange(len(x)), k)
            yield pa.RecordBatch.from_arrays([
                batch.column("vec_id").take(pa.array(at)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(at), n)), pa.array(exact, pa.int64()).take(pa.array(at)),
                pa.array(((y.astype(float) / n) @ project).ravel()), pa.array(np.tile(explained, len(x))), pa.array(np.full(len(at), error)),
            ], names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(told, schema)
