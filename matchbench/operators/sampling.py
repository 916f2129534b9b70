"""Bootstrap draws and score sampling by hash, equal in every engine that has md5."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.columns import hash32


def poisson_draw(seed: int, replicate: Column, *row: Column) -> Column:
    """How often a replicate holds a row: a Poisson(1) variate from a hash, the limit of drawing with
    replacement, without knowing the number of rows."""
    u = hash32(F.concat_ws("|", F.lit(str(seed)), replicate, *row)) / F.lit(4294967296.0)
    out, p, cum = F.lit(0), 0.36787944117144233, 0.0
    for k in range(8):
        cum += p
        out = out + (u >= F.lit(cum)).cast("int")
        p /= k + 1
    return out
