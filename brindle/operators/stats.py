"""Statistics: closed forms over sums that Spark aggregates, p-values from small numpy-free routines."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# --- distributions ---


def _beta_fraction(a: float, b: float, x: float) -> float:
    """The continued fraction of the incomplete beta function, by the modified Lentz method."""
    tiny = 1e-300
    c, d = 1.0, 1.0 / max(abs(1 - (a + b) * x / (a + 1)), tiny) * (1 if 1 - (a + b) * x / (a + 1) >= 0 else -1)
    h = d
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


def incomplete_beta(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1 - front * _beta_fraction(b, a, 1 - x) / b


def t_p(t: float, df: float) -> float:
    """Two-sided p of Student's t."""
    return incomplete_beta(df / 2, 0.5, df / (df + t * t))


def f_p(f: float, d1: float, d2: float) -> float:
    return incomplete_beta(d2 / 2, d1 / 2, d2 / (d2 + d1 * f)) if f > 0 else 1.0


def chi2_p1(x: float) -> float:
    """p of a chi-square with one degree of freedom."""
    return math.erfc(math.sqrt(x / 2)) if x > 0 else 1.0


def normal_quantile(p: float) -> float:
    """The quantile of the normal distribution, by Newton's method on erf."""
    lo, hi = -40.0, 40.0
    for _ in range(200):
        mid = (lo + hi) / 2
        if 0.5 * math.erfc(-mid / math.sqrt(2)) < p:
            lo = mid
        else:
            hi = mid
    return (lo + hi) / 2


# --- on tables ---


def corr(x: str | Column, y: str | Column) -> Column:
    """The correlation as an aggregate; null, not an error, where a column doesn't vary."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    both = x.isNotNull() & y.isNotNull()
    sx, sy = F.stddev_pop(F.when(both, x)), F.stddev_pop(F.when(both, y))
    return F.covar_pop(x, y) / F.nullif(sx * sy, F.lit(0.0))


def pearson(df: DataFrame, x: str, y: str, z: float = 1.959964) -> DataFrame:
    """One row (n, r, r2, t, lo, hi): correlation and its Fisher interval."""
    s = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).agg(F.count("*").alias("n"), corr(x, y).alias("r"))
    half = F.lit(z) / F.sqrt(F.nullif(F.col("n") - 3, F.lit(0)).cast("double"))
    return s.select("n", "r", (F.col("r") * F.col("r")).alias("r2"), (F.col("r") * F.sqrt((F.col("n") - 2) / F.nullif(1 - F.col("r") * F.col("r"), F.lit(0.0)))).alias("t"), F.tanh(F.atanh("r") - half).alias("lo"), F.tanh(F.atanh("r") + half).alias("hi"))


def average_rank(df: DataFrame, col: str, name: str, descending: bool = False) -> DataFrame:
    """A column's ranks with ties at their average: by the sizes of the tied groups, so that no window holds all rows of a large table."""
    groups = df.groupBy(col).agg(F.count("*").alias("_n"))
    order = Window.orderBy(F.desc(col) if descending else F.asc(col)).rowsBetween(Window.unboundedPreceding, -1)
    ranks = groups.select(col, (F.coalesce(F.sum("_n").over(order), F.lit(0)) + (F.col("_n") + 1) / 2.0).alias(name))
    return df.join(ranks, col)


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    return average_rank(average_rank(df.select(x, y), x, "_rx"), y, "_ry").agg(corr("_rx", "_ry").alias("rho"))


def ols1(df: DataFrame, y: str, x: str) -> DataFrame:
    """One row (n, slope, intercept, r2) of a regression on one variable."""
    return df.agg(F.regr_count(y, x).alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"))


def ols2(df: DataFrame, y: str, a: str, b: str) -> DataFrame:
    """One row (n, b0, b1, b2, r2, vif) of a regression on two variables, from sums of centred products."""
    c = df.agg(*[F.covar_pop(p, q).alias(n) for n, p, q in (("aa", a, a), ("bb", b, b), ("ab", a, b), ("ay", a, y), ("by", b, y), ("yy", y, y))], F.avg(a).alias("ma"), F.avg(b).alias("mb"), F.avg(y).alias("my"), F.count("*").alias("n"))
    det = F.col("aa") * F.col("bb") - F.col("ab") * F.col("ab")
    b1 = (F.col("ay") * F.col("bb") - F.col("by") * F.col("ab")) / F.nullif(det, F.lit(0.0))
    b2 = (F.col("by") * F.col("aa") - F.col("ay") * F.col("ab")) / F.nullif(det, F.lit(0.0))
    out = c.withColumn("b1", b1).withColumn("b2", b2)
    return out.select("n", (F.col("my") - F.col("b1") * F.col("ma") - F.col("b2") * F.col("mb")).alias("b0"), "b1", "b2", ((F.col("b1") * F.col("ay") + F.col("b2") * F.col("by")) / F.nullif(F.col("yy"), F.lit(0.0))).alias("r2"), (F.col("aa") * F.col("bb") / F.nullif(det, F.lit(0.0))).alias("vif"))


def with_line(df: DataFrame, y: str, x: str) -> DataFrame:
    """The table with the fitted line's n, slope, intercept, mean of x and its sum of squares as columns, from one row that is joined."""
    s = df.agg(F.regr_count(y, x).cast("double").alias("_n"), F.regr_slope(y, x).alias("_b"), F.regr_intercept(y, x).alias("_a"), F.avg(x).alias("_mx"), F.regr_sxx(y, x).alias("_sxx"), F.regr_syy(y, x).alias("_syy"), F.regr_sxy(y, x).alias("_sxy"))
    return df.join(F.broadcast(s))


def cooks(df: DataFrame, key: str, y: str, x: str) -> DataFrame:
    """(key, residual, leverage, student, cook, influential) of a regression on one variable; influential above 4/n."""
    s = with_line(df.select(key, y, x), y, x)
    e = F.col(y) - F.col("_a") - F.col("_b") * F.col(x)
    h = 1.0 / F.col("_n") + F.pow(F.col(x) - F.col("_mx"), 2) / F.nullif(F.col("_sxx"), F.lit(0.0))
    mse = (F.col("_syy") - F.col("_b") * F.col("_sxy")) / (F.col("_n") - 2)
    s = s.withColumn("residual", e).withColumn("leverage", h).withColumn("_mse", mse)
    cook = F.pow("residual", 2) / (2 * F.col("_mse")) * F.col("leverage") / F.pow(1 - F.col("leverage"), 2)
    return s.select(key, "residual", "leverage", (F.col("residual") / F.sqrt(F.col("_mse") * (1 - F.col("leverage")))).alias("student"), cook.alias("cook"), (cook > 4.0 / F.col("_n")).alias("influential"))


def leave_one_out(df: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """(key, r_without, delta): the correlation without each row, from the global sums less the row's own."""
    s = df.agg(F.count("*").cast("double").alias("n"), F.avg(x).alias("mx"), F.avg(y).alias("my"), F.var_pop(x).alias("vx"), F.var_pop(y).alias("vy"), F.covar_pop(x, y).alias("cxy"), corr(x, y).alias("r"))
    j = df.select(key, x, y).join(F.broadcast(s))
    dx, dy, n = F.col(x) - F.col("mx"), F.col(y) - F.col("my"), F.col("n")
    k = n / (n - 1)  # a row's removal lowers a centred sum of products by its own product times n/(n-1)
    sxy, sxx, syy = n * F.col("cxy") - k * dx * dy, n * F.col("vx") - k * dx * dx, n * F.col("vy") - k * dy * dy
    r = sxy / F.sqrt(F.nullif(sxx * syy, F.lit(0.0)))
    return j.select(key, r.alias("r_without"), (F.col("r") - r).alias("delta"))


def chi2_yates(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Chi-square of a 2x2 table with continuity correction."""
    a, b, c, d = (v.cast("double") for v in (a, b, c, d))
    n = a + b + c + d
    dev = F.greatest(F.abs(a * d - b * c) - n / 2, F.lit(0.0))
    return n * dev * dev / F.nullif((a + b) * (c + d) * (a + c) * (b + d), F.lit(0.0))


def contingency(df: DataFrame, x: Column, y: Column) -> DataFrame:
    """One row (a, b, c, d, chi2) of two conditions: both, only x, only y, neither."""
    t = df.agg(F.count_if(x & y).alias("a"), F.count_if(x & ~y).alias("b"), F.count_if(~x & y).alias("c"), F.count_if(~x & ~y).alias("d"))
    return t.withColumn("chi2", chi2_yates(*[F.col(v) for v in "abcd"]))


def partial_corr(df: DataFrame, x: str, y: str, z: str) -> DataFrame:
    s = df.agg(corr(x, y).alias("xy"), corr(x, z).alias("xz"), corr(y, z).alias("yz"))
    return s.select(((F.col("xy") - F.col("xz") * F.col("yz")) / F.sqrt((1 - F.pow("xz", 2)) * (1 - F.pow("yz", 2)))).alias("partial_r"))


def loglog_residual(df: DataFrame, key: str, y: str, x: str) -> DataFrame:
    """(key, residual) of log y on log x over the rows where both are positive."""
    d = df.where((F.col(x) > 0) & (F.col(y) > 0)).select(key, F.ln(x).alias("_lx"), F.ln(y).alias("_ly"))
    s = d.agg(F.regr_slope("_ly", "_lx").alias("_b"), F.regr_intercept("_ly", "_lx").alias("_a"))
    return d.join(F.broadcast(s)).select(key, (F.col("_ly") - F.col("_a") - F.col("_b") * F.col("_lx")).alias("residual"))


def wilson(k: Column, n: Column, z: float = 1.959964) -> tuple[Column, Column]:
    """The Wilson interval of a share."""
    n = F.nullif(n.cast("double"), F.lit(0.0))
    p = k / n
    mid, half, den = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)), 1 + z * z / n
    return (mid - half) / den, (mid + half) / den


def percentile_ci(df: DataFrame, col: str, lo: float = 0.025, hi: float = 0.975) -> DataFrame:
    p = F.percentile(col, F.array(F.lit(lo), F.lit(hi)))
    return df.agg(F.get(p, F.lit(0)).alias("lo"), F.get(p, F.lit(1)).alias("hi"))


# --- robust fits and normality, on a bounded number of points at the driver ---


def bounded(df: DataFrame, most: int = 100_000):
    """A small table at the driver; more than `most` rows are refused."""
    rows = df.limit(most + 1).toPandas()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows; aggregate first")
    return rows


def design(df: DataFrame, y: str, xs: list[str], most: int = 100_000) -> tuple[np.ndarray, np.ndarray]:
    """The variables of a small table as arrays, with a constant; more than `most` rows are refused."""
    rows = bounded(df.select(y, *xs).na.drop(), most).to_numpy(float)
    return rows[:, 0], np.column_stack([np.ones(len(rows)), rows[:, 1:]])


def ols(y: np.ndarray, x: np.ndarray) -> dict:
    """Coefficients, standard errors, t and p values, R2, adjusted R2, F and its p."""
    n, k = x.shape
    xtx = np.linalg.inv(x.T @ x)
    b = xtx @ x.T @ y
    e = y - x @ b
    rss, tss = float(e @ e), float(((y - y.mean()) ** 2).sum())
    s2 = rss / (n - k)
    se = np.sqrt(np.diag(xtx) * s2)
    r2 = 1 - rss / tss
    f = (r2 / (k - 1)) / ((1 - r2) / (n - k)) if k > 1 and r2 < 1 else float("nan")
    return {"coef": b, "se": se, "t": b / se, "p": [t_p(float(t), n - k) for t in b / se], "r2": r2, "adj_r2": 1 - (1 - r2) * (n - 1) / (n - k), "f": f, "f_p": f_p(f, k - 1, n - k)}


def huber(y: np.ndarray, x: np.ndarray, c: float = 1.345, rounds: int = 200) -> np.ndarray:
    """Huber's M-estimate by iteratively reweighted least squares, scaled by the median absolute deviation."""
    b = np.linalg.lstsq(x, y, rcond=None)[0]
    for _ in range(rounds):
        e = y - x @ b
        s = np.median(np.abs(e)) / 0.6744897501960817 or 1e-12
        w = np.minimum(1.0, c / np.maximum(np.abs(e / s), 1e-12))
        new = np.linalg.solve((x * w[:, None]).T @ x, (x * w[:, None]).T @ y)
        if np.max(np.abs(new - b)) < 1e-10:
            return new
        b = new
    return b


def median_regression(y: np.ndarray, x: np.ndarray, rounds: int = 2000) -> np.ndarray:
    """Least absolute deviations by iteratively reweighted least squares with a shrinking floor."""
    b = np.linalg.lstsq(x, y, rcond=None)[0]
    best, at = np.abs(y - x @ b).sum(), b
    for k in range(rounds):
        w = 1 / np.maximum(np.abs(y - x @ b), max(1e-9, 0.1 * 0.97**k))
        b = np.linalg.solve((x * w[:, None]).T @ x, (x * w[:, None]).T @ y)
        if (s := np.abs(y - x @ b).sum()) < best:
            best, at = s, b
    return at


def shapiro_wilk(v: np.ndarray) -> tuple[float, float]:
    """W and p of normality after Royston's approximation, for 12 to 5000 values."""
    v = np.sort(np.asarray(v, float))
    n = len(v)
    if not 12 <= n <= 5000:
        raise ValueError("12 to 5000 values")
    m = np.array([normal_quantile((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    u = 1 / math.sqrt(n)
    mm = float(m @ m)
    # fixed values: coefficients of the published approximation
    last = np.polyval([-2.706056, 4.434685, -2.07119, -0.147981, 0.221157, m[-1] / math.sqrt(mm)], u)
    second = np.polyval([-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, m[-2] / math.sqrt(mm)], u)
    phi = (mm - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last**2 - 2 * second**2)
    a = m / math.sqrt(phi)
    a[-1], a[-2], a[0], a[1] = last, second, -last, -second
    w = float((a @ v) ** 2 / ((v - v.mean()) ** 2).sum())
    ln = math.log(n)
    mu = np.polyval([0.0038915, -0.083751, -0.31082, -1.5861], ln)
    sd = math.exp(np.polyval([0.0030302, -0.082676, -0.4803], ln))
    z = (math.log(1 - w) - mu) / sd
    return w, 0.5 * math.erfc(z / math.sqrt(2))
