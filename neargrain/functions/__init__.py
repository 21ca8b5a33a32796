"""Column expressions that the operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(top: Column | str, bottom: Column | str) -> Column:
    """top / bottom as a double; 0 where the bottom is 0."""
    top, bottom = (F.col(x) if isinstance(x, str) else x for x in (top, bottom))
    return F.coalesce(F.try_divide(top.cast("double"), bottom.cast("double")), F.lit(0.0))


def tf_idf(tf: Column | str, df: Column | str, n: Column, narrow: bool = False) -> Column:
    """ln(tf + 1) * ln(n / df); ``narrow`` rounds it to a float's precision."""
    tf, df = (F.col(x) if isinstance(x, str) else x for x in (tf, df))
    weight = F.log(tf + F.lit(1.0)) * F.log(n.cast("double") / df)
    return weight.cast("float").cast("double") if narrow else weight


def cosine(dot: Column | str, square_a: Column | str, square_b: Column | str) -> Column:
    """dot / sqrt(a * b) with squared norms; 0 for a zero norm. One form everywhere, so that
    equal cosines of whole numbers come out as equal doubles."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (square_a, square_b))
    return ratio(dot, F.sqrt(a.cast("double") * b.cast("double")))


def share(n: Column | str, part: float) -> Column:
    """part * n, truncated."""
    return F.floor(F.lit(float(part)) * n).cast("bigint")
