"""Link scores of embedding models as column expressions over arrays.

Each takes the arrays of a head, relation, tail (and point in time) and returns a double; complex
vectors are a real and an imaginary array. ``functions.columns`` has the array arithmetic.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stratagraph.functions.columns import add, cosine, dot, mul, sub, total


def complex_product(a_re, a_im, b_re, b_im) -> tuple[Column, Column]:
    return sub(mul(a_re, b_re), mul(a_im, b_im)), add(mul(a_re, b_im), mul(a_im, b_re))


def complex_score(h_re, h_im, r_re, r_im, t_re, t_im) -> Column:
    """Re of the product of head, relation and the tail's conjugate."""
    re, im = complex_product(h_re, h_im, r_re, r_im)
    return dot(re, t_re) + dot(im, t_im)


def tcomplex(h_re, h_im, r_re, r_im, v_re, v_im, t_re, t_im) -> Column:
    """The same with the relation moved by its point in time."""
    return complex_score(h_re, h_im, add(r_re, v_re), add(r_im, v_im), t_re, t_im)


def transe(h, r, t) -> Column:
    return -total(F.transform(sub(add(h, r), t), F.abs))


def distmult(h, r, t) -> Column:
    return dot(mul(h, r), t)


def rotate(h_re, h_im, r_re, r_im, t_re, t_im) -> Column:
    """Minus the squared distance after rotation; the relation is put on the unit circle first."""
    size = F.zip_with(r_re, r_im, lambda x, y: F.sqrt(x * x + y * y) + 1e-12)
    re, im = complex_product(h_re, h_im, F.zip_with(r_re, size, lambda x, n: x / n), F.zip_with(r_im, size, lambda x, n: x / n))
    a, b = sub(re, t_re), sub(im, t_im)
    return -(dot(a, a) + dot(b, b))


def tucker_t(h, r, v, t) -> Column:
    return dot(mul(h, add(r, v)), t)


def attribute_bonus(base: Column, attr_h, attr_t, weight: float = 0.1) -> Column:
    return base + weight * cosine(attr_h, attr_t)


def causal_bonus(base: Column, effect: Column, beta: float = 0.05) -> Column:
    return base + beta * F.coalesce(effect, F.lit(0.0))


def projected(learned: Column, features: Column, weights: list[list[float]] | Column, bias: Column) -> Column:
    """A learned vector, or for an unseen entity its features times the weights (one array for each output) plus the bias."""
    made = F.zip_with(F.transform(weights, lambda w: dot(features, w)), bias, lambda x, b: x + b)
    return F.coalesce(learned, made)


def query_vector(model: str, h_re, h_im, r_re, r_im, v_re=None, v_im=None) -> Column:
    """Head, relation and time folded into one vector, so that a tail's score is one product or distance (``TAIL_SCORES``)."""
    if model == "transe":
        return add(h_re, r_re)
    if model == "distmult":
        return mul(h_re, r_re)
    if model == "tuckert":
        return mul(h_re, add(r_re, v_re))
    if model == "rotate":
        size = F.zip_with(r_re, r_im, lambda x, y: F.sqrt(x * x + y * y) + 1e-12)
        r_re, r_im = (F.zip_with(x, size, lambda a, n: a / n) for x in (r_re, r_im))
    elif model == "tcomplex":
        r_re, r_im = add(r_re, v_re), add(r_im, v_im)
    return F.concat(*complex_product(h_re, h_im, r_re, r_im))


def tail_vector(model: str, t_re, t_im) -> Column:
    return t_re if model in ("transe", "distmult", "tuckert") else F.concat(t_re, t_im)


#: How the two vectors of a model meet.
TAIL_SCORES = {"tcomplex": "dot", "complex": "dot", "distmult": "dot", "tuckert": "dot", "transe": "l1", "rotate": "l2"}
#: Models whose scores depend on the point in time.
TIMED = {"tcomplex", "tuckert"}
