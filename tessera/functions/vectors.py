"""Column functions over dense vectors (arrays of double), evaluated inside the JVM.

Element access and sums are written with higher-order functions; a vector with a null element gives
null, so callers validate on ingestion (tessera.sources.tokens.validate).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZERO = 0.0


def _c(x):
    return F.col(x) if isinstance(x, str) else x


def doubles(v) -> Column:
    return _c(v).cast("array<double>")


def floats(v) -> Column:
    return _c(v).cast("array<float>")


def signed_round(x, digits=6) -> Column:
    """x rounded, with its sign also where it becomes zero, as SQL engines that round in doubles give it (-1e-7: -0.0)."""
    return F.abs(F.round(_c(x), digits)) * F.signum(_c(x))


def let(value, use) -> Column:
    """use(value) with the value computed once: inside a lambda an expression is computed for every element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def total(v) -> Column:
    return F.aggregate(_c(v), F.lit(ZERO), lambda s, x: s + x)


def dot(a, b) -> Column:
    """Inner product."""
    return total(F.zip_with(_c(a), _c(b), lambda x, y: x * y))


def squared_l2(a, b) -> Column:
    return total(F.zip_with(_c(a), _c(b), lambda x, y: (x - y) * (x - y)))


def squares(v) -> Column:
    return F.transform(_c(v), lambda x: x * x)


def norm(v) -> Column:
    return F.sqrt(total(squares(v)))


def normalize(v) -> Column:
    """Unit vector; a zero vector stays as it is."""
    return let(_c(v), lambda a: let(norm(a), lambda n: F.transform(a, lambda x: F.when(n > 0, x / n).otherwise(x))))


def prefix(v, k: int) -> Column:
    """The first k dimensions."""
    return F.slice(_c(v), 1, k)


def dims(v, start: int, stop: int) -> Column:
    """Dimensions start..stop-1, counted from 0."""
    return F.slice(_c(v), start + 1, stop - start)


def gather(v, order) -> Column:
    """The vector's elements in the given order of 0-based dimensions."""
    return let(_c(v), lambda values: F.transform(_c(order), lambda i: F.get(values, i)))


def argsort_desc(v) -> Column:
    """0-based dimensions by falling value; ties by rising dimension."""
    pairs = F.transform(_c(v), lambda x, i: F.struct((-x).alias("k"), i.alias("i")))
    return F.transform(F.array_sort(pairs), lambda p: p["i"])


def sort_within_parts(order, head: int) -> Column:
    """The first ``head`` dimensions of an order and the rest, either sorted by dimension."""
    rest = F.slice(_c(order), head + 1, F.greatest(F.size(_c(order)) - head, F.lit(0)))
    return F.concat(F.array_sort(F.slice(_c(order), 1, head)), F.array_sort(rest))


def tail_norm(v, k: int) -> Column:
    """Norm of the dimensions from k on: the residual that is safe for any vector."""
    rest = F.slice(_c(v), k + 1, F.greatest(F.size(_c(v)) - k, F.lit(0)))
    return F.sqrt(total(squares(rest)))


def unit_residual(v, k: int) -> Column:
    """sqrt(max(0, 1 - energy of the first k dimensions)): the residual of a unit vector."""
    return F.sqrt(F.greatest(F.lit(ZERO), 1 - total(squares(prefix(v, k)))))


def prefix_energy(v, checkpoints: list[int]) -> Column:
    """Energy of the first k dimensions for every checkpoint k."""
    return F.array(*(total(squares(prefix(v, k))) for k in checkpoints))


def centred_magnitude(q, mean) -> Column:
    return F.zip_with(_c(q), _c(mean), lambda a, b: F.abs(a - b))


def reflect(v, axis) -> Column:
    """Householder reflection, an orthogonal transform that keeps all inner products."""
    a = _c(axis)
    return let(_c(v), lambda x: let(2 * dot(x, a) / dot(a, a), lambda f: F.zip_with(x, a, lambda e, w: e - f * w)))


def decay(v, rate: float) -> Column:
    """Element z times rate**z, made a unit vector: an anisotropic variant."""
    return normalize(F.transform(_c(v), lambda x, z: x * F.pow(F.lit(rate), z)))


def confidence(k: int, width: int, shrink: float) -> float:
    """Factor on residuals at k of ``width`` dimensions: from nearly 1 at the start to ``shrink`` at the end."""
    return shrink + (1 - shrink) * (width - k) / width


def sampling_ratio(k: int, width: int, alpha: float) -> float:
    """Adaptive-sampling threshold (k/D)(1 + alpha/sqrt(k))**2 on a partial squared distance; 1 at k = D."""
    return 1.0 if k >= width else k / width * (1 + alpha / k**0.5) ** 2
