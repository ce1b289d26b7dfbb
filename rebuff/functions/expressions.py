"""Column expressions shared by the operators. All of them stay inside whole-stage codegen."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

#: 97.5 % point of the standard normal and its three-digit form used for proportions.
Z95 = 1.959964
WILSON_Z = 1.96


def safe_div(num: Column, den: Column) -> Column:
    """num/den, NULL ("not measured") unless the denominator is positive."""
    return F.when(den > 0, num / den)


def steady(c: Column | str) -> Column:
    """A mean without the last digits, which depend on the order of its rows: equal means tie, and one on a threshold stays there."""
    return F.round(c, 12)


def draw(seed: int | str, n: Column, *parts) -> Column:
    """Counter-based uniform draw in [0, n): the same (seed, parts) gives the same draw in any
    engine that has md5, on any partitioning, and after any task retry."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.col(p) if isinstance(p, str) else p for p in parts])
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long"), n)


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round the double columns of a result table; negative zero becomes zero."""
    return df.select(*[
        (F.round(F.col(f.name), digits) + F.lit(0.0)).alias(f.name)
        if isinstance(f.dataType, T.DoubleType) else F.col(f.name)
        for f in df.schema.fields
    ])


def row_mean(*cols: str) -> Column:
    """Mean over the columns that are not NULL; NULL when all are."""
    total = sum((F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in cols[1:]),
                F.coalesce(F.col(cols[0]).cast("double"), F.lit(0.0)))
    count = sum((F.col(c).isNotNull().cast("int") for c in cols[1:]), F.col(cols[0]).isNotNull().cast("int"))
    return F.when(count > 0, total / count)


def wilson(k: Column, n: Column, z: float = WILSON_Z) -> tuple[Column, Column]:
    """Wilson interval of k/n in percent, clamped to [0, 100]; NULL for n = 0."""
    n = n.cast("double")
    p = k / n
    den = 1 + z * z / n
    centre = (p + z * z / (2 * n)) / den
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / den
    low = F.when(n > 0, F.greatest(F.lit(0.0), 100 * (centre - half)))
    high = F.when(n > 0, F.least(F.lit(100.0), 100 * (centre + half)))
    return low, high


def unpivot(df: DataFrame, keys: list[str], columns: list[str], name: str = "feature", value: str = "value") -> DataFrame:
    """Wide to long: one map-side Expand, no shuffle."""
    return df.select(*keys, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        keys, columns, name, value)


def shift_frame(side: str, width: int):
    """Bounds of the window frame before or after the current row."""
    return (-width, -1) if side == "pre" else (1, width)


def solve(m: list[list[Column]], v: list[Column]) -> list[Column]:
    """Closed-form solution of a small linear system (Cramer); NULL when singular."""
    def det(a):
        if len(a) == 1:
            return a[0][0]
        out = None
        for c, head in enumerate(a[0]):
            term = head * det([row[:c] + row[c + 1:] for row in a[1:]])
            out = term if out is None else (out + term if c % 2 == 0 else out - term)
        return out
    base = det(m)
    size = range(len(m))
    return [F.when(F.abs(base) > 1e-12, det([[v[r] if c == k else m[r][c] for c in size] for r in size]) / base) for k in size]
