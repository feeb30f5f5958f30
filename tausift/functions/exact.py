"""Distribution functions that SQL lacks, on numbers and as vectorised column functions."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def normal_tail(z: float) -> float:
    """Both tails of the standard normal distribution beyond |z|."""
    return math.erfc(abs(z) / math.sqrt(2))


def kendall_exact(discordant: int, n: int) -> float:
    """Two-sided exact p-value of Kendall's tau without ties, from the number of inversions of n ranks."""
    pairs = n * (n - 1) // 2
    low = min(discordant, pairs - discordant)
    counts = [1]
    for k in range(2, n + 1):
        prefix, total, out = counts, 0, []
        for j in range(min(low, k * (k - 1) // 2) + 1):
            total += prefix[j] if j < len(prefix) else 0
            total -= prefix[j - k] if j >= k else 0
            out.append(total)
        counts = out
    return min(1.0, 2 * sum(counts[: low + 1]) / math.factorial(n)) if 2 * low != pairs else 1.0


def kendall_normal(concordant: int, discordant: int, n: int, x_ties: list[int], y_ties: list[int]) -> float:
    """Two-sided p-value of Kendall's tau by the normal approximation with ties; *_ties: sizes of tied groups."""
    if n < 2:
        return math.nan
    v = lambda t: t * (t - 1) * (2 * t + 5)
    base = (v(n) - sum(map(v, x_ties)) - sum(map(v, y_ties))) / 18
    x1, y1 = sum(t * (t - 1) for t in x_ties), sum(t * (t - 1) for t in y_ties)
    x2, y2 = sum(t * (t - 1) * (t - 2) for t in x_ties), sum(t * (t - 1) * (t - 2) for t in y_ties)
    variance = base + x1 * y1 / (2 * n * (n - 1)) + (x2 * y2 / (9 * n * (n - 1) * (n - 2)) if n > 2 else 0)
    return normal_tail((concordant - discordant) / math.sqrt(variance)) if variance > 0 else math.nan


def mann_whitney_exact(u: float, n1: int, n2: int) -> float:
    """P(U >= u) without ties, for groups of n1 and n2."""
    counts = [[[0] * (a * b + 1) for b in range(n2 + 1)] for a in range(n1 + 1)]
    for a in range(n1 + 1):
        for b in range(n2 + 1):
            if not a or not b:
                counts[a][b] = [1]
                continue
            row = [0] * (a * b + 1)
            for k, c in enumerate(counts[a - 1][b]):
                row[k + b] += c
            for k, c in enumerate(counts[a][b - 1]):
                row[k] += c
            counts[a][b] = row
    whole = counts[n1][n2]
    return sum(whole[max(0, math.ceil(u)) :]) / sum(whole)


def student_tail(t: float, df: float) -> float:
    """Both tails of Student's distribution beyond |t|, by the continued fraction of the incomplete beta function."""
    x, a, b = df / (df + t * t), df / 2, 0.5
    if t == 0:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))

    def fraction(p: float, q: float, z: float) -> float:
        c, d = 1.0, 1 - (p + q) * z / (p + 1)
        d = 1 / (d or 1e-300)
        h = d
        for m in range(1, 400):
            for num in (m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))):
                d = 1 / ((1 + num * d) or 1e-300)
                c = (1 + num / c) or 1e-300
                h *= d * c
            if abs(d * c - 1) < 1e-15:
                break
        return h

    return front * fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * fraction(b, a, 1 - x) / b


def student_p(t: Column, df: Column) -> Column:
    """Two-sided p-values of columns of t statistics and degrees of freedom."""

    @F.pandas_udf("double")
    def tail(values: pd.Series, free: pd.Series) -> pd.Series:
        return pd.Series([None if v != v or f != f or f < 1 else student_tail(v, f) for v, f in zip(values, free, strict=True)])

    return tail(t, df)


#: Entities up to which Kendall's p-value is exact without ties, and the smaller group up to which that of the rank sum is.
KENDALL_EXACT, RANK_SUM_EXACT = 33, 8


def kendall_p(concordant: Column, discordant: Column, n: Column, x_ties: Column, y_ties: Column) -> Column:
    """Two-sided p-values of Kendall's tau: exact without ties up to KENDALL_EXACT entities (or with at most one pair on either
    side), else by the normal approximation, whose variance takes the tied groups into account. *_ties: arrays of the sizes of
    tied groups, those of one entity left out."""

    @F.pandas_udf("double")
    def p(c: pd.Series, d: pd.Series, size: pd.Series, xs: pd.Series, ys: pd.Series) -> pd.Series:
        out = []
        for con, dis, k, a, b in zip(c, d, size, xs, ys, strict=True):
            a, b = [int(t) for t in a], [int(t) for t in b]
            exact = not a and not b and (k <= KENDALL_EXACT or min(dis, k * (k - 1) // 2 - dis) <= 1)
            out.append(kendall_exact(int(dis), int(k)) if exact else kendall_normal(int(con), int(dis), int(k), a, b))
        return pd.Series(out)

    return p(concordant, discordant, n, x_ties, y_ties)


def rank_sum_greater(u: float, n1: int, n2: int, ties: list[int]) -> float:
    """P of a rank sum as great as u, one-sided: exact without ties if either group has at most RANK_SUM_EXACT, else by the
    normal approximation with tie and continuity corrections. ties: sizes of tied groups."""
    if not ties and min(n1, n2) <= RANK_SUM_EXACT:
        return mann_whitney_exact(u, n1, n2)
    n = n1 + n2
    variance = n1 * n2 / 12 * (n + 1 - sum(t**3 - t for t in ties) / (n * (n - 1)))
    return math.erfc((u - n1 * n2 / 2 - 0.5) / math.sqrt(variance) / math.sqrt(2)) / 2 if variance > 0 else math.nan


def rank_sum_p(u: Column, n1: Column, n2: Column, ties: Column) -> Column:
    """`rank_sum_greater` of columns."""

    @F.pandas_udf("double")
    def p(us: pd.Series, a: pd.Series, b: pd.Series, ts: pd.Series) -> pd.Series:
        return pd.Series([rank_sum_greater(x, int(k), int(m), [int(t) for t in sizes]) for x, k, m, sizes in zip(us, a, b, ts, strict=True)])

    return p(u, n1, n2, ties)
