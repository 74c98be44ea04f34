"""Dense-vector column functions built from Spark higher-order functions.

Vectors are ``array<float>`` / ``array<double>`` columns; arithmetic is done in
double precision.  Spark 4.1 has no built-in cosine or L2 normalisation for
arrays, so they are written with ``aggregate`` / ``zip_with`` / ``transform``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def to_double(v) -> Column:
    return F.transform(_c(v), lambda x: x.cast("double"))


def dot(a, b) -> Column:
    """Dot product over the common prefix (``zip`` semantics: the shorter wins)."""
    prods = F.zip_with(_c(a), _c(b), lambda x, y: F.coalesce(x.cast("double") * y.cast("double"), F.lit(0.0)))
    return F.aggregate(prods, F.lit(0.0), lambda acc, x: acc + x)


def sq_norm(v) -> Column:
    return F.aggregate(_c(v), F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))


def norm(v) -> Column:
    return F.sqrt(sq_norm(v))


def cosine(a, b) -> Column:
    """Cosine similarity; 0 when either vector has zero norm."""
    na, nb = norm(a), norm(b)
    return F.when((na == 0) | (nb == 0), F.lit(0.0)).otherwise(dot(a, b) / (na * nb))


def l2_normalize(v) -> Column:
    """Divide by the L2 norm; a zero vector is returned unchanged (as doubles)."""
    vv = to_double(v)
    # the norm is bound to a lambda variable: evaluated once per vector, not once per component
    return F.transform(
        F.array(norm(vv)), lambda n: F.when(n > 0, F.transform(vv, lambda x: x / n)).otherwise(vv)
    )[0]


def is_valid_vector(v, dim: int | None = None) -> Column:
    """Non-null, no null/NaN/inf component, and of the expected size if given."""
    c = _c(v)
    inf = F.lit(float("inf"))
    # no function is called per component: NaN is the largest value, and a search
    # that ends without a find is null where a component is
    ok = c.isNotNull() & F.coalesce(
        ~F.array_contains(c, inf) & F.coalesce(F.array_max(c) < inf, F.lit(True)) & F.coalesce(F.array_min(c) > -inf, F.lit(True)),
        F.lit(False))
    if dim is not None:
        ok = ok & (F.size(c) == F.lit(dim))
    return ok


def pad_truncate(ids, max_len: int = 512, pad_id: int = 0) -> Column:
    """Cut a token-id array to ``max_len`` or right-pad it with ``pad_id``."""
    c = _c(ids)
    cut = F.slice(c, 1, max_len)
    pad = F.array_repeat(F.lit(pad_id).cast("long"), F.greatest(F.lit(max_len) - F.size(cut), F.lit(0)))
    return F.concat(F.transform(cut, lambda x: x.cast("long")), pad)


def attention_mask(ids) -> Column:
    """1 for a real token (id > 0), 0 for padding."""
    return F.transform(_c(ids), lambda x: F.when(x > 0, F.lit(1)).otherwise(F.lit(0)).cast("long"))


def masked_mean_pool(token_vectors, mask) -> Column:
    """Mean of the token vectors whose mask is 1 (array-of-arrays form).

    The denominator is the mask sum, or 1 when the mask is all zero (the result
    is then the zero vector).
    """
    tv, m = _c(token_vectors), _c(mask)
    denom = F.aggregate(m, F.lit(0.0), lambda acc, x: acc + x.cast("double"))
    denom = F.when(denom > 0, denom).otherwise(F.lit(1.0))
    dim = F.size(F.get(tv, 0))
    zero = F.array_repeat(F.lit(0.0), F.coalesce(dim, F.lit(0)))
    summed = F.aggregate(
        F.arrays_zip(tv.alias("v"), m.alias("m")),
        zero,
        lambda acc, e: F.zip_with(acc, e["v"], lambda s, x: s + x.cast("double") * e["m"].cast("double")),
    )
    return F.transform(F.array(denom), lambda d: F.transform(summed, lambda s: s / d))[0]


def round_array(v, digits: int = 6) -> Column:
    return F.transform(_c(v), lambda x: F.round(x, digits))
