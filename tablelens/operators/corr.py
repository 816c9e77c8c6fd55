"""Pearson correlation (G1-G3), pairwise-complete, ANSI-safe.

One first pass counts missing values and finds constant columns.  Columns
with no missing value form a block whose pairs are complete on every row:
``pyspark.ml.stat.Correlation`` computes it from one distributed Gramian
pass, whatever the number of columns.  Only pairs that involve a column
with missing values need pairwise-complete moments: ``covar_pop / (stddev_pop
* stddev_pop)`` over the rows where both are present, with ``try_divide``
(``corr`` raises DIVIDE_BY_ZERO on a constant column under ANSI mode),
evaluated in batches so generated code stays small.  A constant column
gives NULL everywhere, its diagonal included.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablelens.session import materialize
from tablelens.sources.schema import is_plain_number, num

PAIRS_PER_BATCH = 120


def _pair_r(a: str, b: str) -> Column:
    """r over the rows that have both; NULL if either is constant there.

    Constant means least = greatest: the standard deviation of equal values
    that binary fractions cannot hold need not be exactly 0.
    """
    xa, xb = num(a), num(b)
    both = xa.isNotNull() & xb.isNotNull()
    va, vb = F.when(both, xa), F.when(both, xb)
    varied = (F.min(va) < F.max(va)) & (F.min(vb) < F.max(vb))
    return F.when(varied, F.try_divide(F.covar_pop(xa, xb), F.stddev_pop(va) * F.stddev_pop(vb)))


def _plain_numbers(df: DataFrame) -> list[str]:
    return [c for c in df.columns if is_plain_number(df, c)]


def correlation_columns(df: DataFrame, chosen=None, x: str | None = None, y: str | None = None,
                        max_cols: int | None = None) -> list[str]:
    """The columns a correlation view uses.

    Candidates in order, each once: the chosen columns (if any), X, Y, and as
    a reserve every numeric column.  Only existing numeric (non-boolean)
    ones count.  The reserve is used up without chosen columns, else only as
    far as two columns need it.  ``max_cols`` (none by default) keeps the
    first ones.
    """
    numbers = _plain_numbers(df)
    asked = dict.fromkeys(c for c in [*(chosen or []), x, y] if c in numbers)
    reserve = [c for c in numbers if c not in asked]
    if chosen:
        reserve = reserve[: max(0, 2 - len(asked))]
    return [*asked, *reserve][:max_cols]


def correlation_matrix(df: DataFrame, cols=None, digits: int | None = 2, max_cols: int | None = None) -> DataFrame:
    """G1: long-form matrix ``(col_a, col_b, r)`` over every ordered pair,
    diagonal included; r rounded to ``digits``; NULL for a constant column.

    The result has one row per pair of columns of the schema; the driver
    holds no more than that.
    """
    numbers = _plain_numbers(df)
    use = [c for c in (cols or numbers) if c in numbers][:max_cols]
    if len(use) < 2:
        raise ValueError("correlation needs at least 2 numeric columns")
    facts = df.agg(  # one cheap pass: missing values and constant columns
        *[F.count(F.when(num(c).isNull(), F.lit(1))).alias(f"m{i}") for i, c in enumerate(use)],
        *[(F.min(num(c)) < F.max(num(c))).alias(f"v{i}") for i, c in enumerate(use)],
    ).first()
    complete = [c for i, c in enumerate(use) if facts[f"m{i}"] == 0 and facts[f"v{i}"]]
    constant = {c for i, c in enumerate(use) if not facts[f"v{i}"]}
    # Columns without missing values: every pair is complete on every row, so
    # one Gramian pass (pyspark.ml) gives the whole block.
    known = _complete_block(df, complete) if len(complete) > 1 else {}
    known |= {(a, b): None for i, a in enumerate(use) for b in use[i:] if a in constant or b in constant}
    pairs = [(a, b) for i, a in enumerate(use) for b in use[i:] if (a, b) not in known]
    shown = lambda r: r if digits is None else F.round(r, digits)
    both_ways = lambda a, b: [(a, b)] if a == b else [(a, b), (b, a)]
    parts = []
    if known:
        rows = [(*ab, r) for pair, r in known.items() for ab in both_ways(*pair)]
        table = df.sparkSession.createDataFrame(rows, "col_a string, col_b string, r double")
        parts.append(table.withColumn("r", shown(F.col("r"))))
    # Pairs with a column that has missing values: pairwise-complete moments.
    for s in range(0, len(pairs), PAIRS_PER_BATCH):
        batch = pairs[s:s + PAIRS_PER_BATCH]
        row = df.agg(*[_pair_r(a, b).alias(f"r{i}") for i, (a, b) in enumerate(batch)])
        cells = [F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"), shown(F.col(f"r{i}")).alias("r"))
                 for i, pair in enumerate(batch) for a, b in both_ways(*pair)]
        parts.append(row.select(F.inline(F.array(*cells))))
    return reduce(DataFrame.unionByName, parts)


def _complete_block(df: DataFrame, cols: list[str]) -> dict[tuple[str, str], float | None]:
    """Pearson r for every pair of columns without missing values, from one
    distributed Gramian pass; a constant column gives NULL."""
    import math as _m

    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.stat import Correlation

    vec = VectorAssembler(inputCols=[f"__tl_c{i}" for i in range(len(cols))], outputCol="__tl_v").transform(
        df.select(*[num(c).alias(f"__tl_c{i}") for i, c in enumerate(cols)])
    ).select("__tl_v")
    m = Correlation.corr(vec, "__tl_v", "pearson").first()[0].toArray()
    out: dict[tuple[str, str], float | None] = {}
    for i, a in enumerate(cols):
        for j in range(i, len(cols)):
            v = float(m[i, j])
            out[(a, cols[j])] = None if _m.isnan(v) else v
    return out


def correlation_with_target(df: DataFrame, target: str, cols=None, digits: int | None = 2) -> DataFrame:
    """R of every other column with ``target``, largest first (missing
    r last), with a 0-based ``position``; one scan."""
    numbers = _plain_numbers(df)
    use = [c for c in (cols or numbers) if c in numbers and c != target]
    if target not in numbers or not use:
        raise ValueError("target and at least one other numeric column needed")
    row = df.agg(*[_pair_r(target, c).alias(f"r{i}") for i, c in enumerate(use)])
    shown = lambda r: r if digits is None else F.round(r, digits)
    cells = [F.struct(F.lit(c).alias("column"), shown(F.col(f"r{i}")).alias("r")) for i, c in enumerate(use)]
    return _placed(row.select(F.inline(F.array(*cells))))


def _placed(bars: DataFrame, by: list[str] | None = None) -> DataFrame:
    """0-based ``position`` by falling r (one row per column of the schema)."""
    w = Window.partitionBy(*[F.col(c) for c in by or []]).orderBy(F.col("r").desc_nulls_last(), F.col("column").asc())
    return bars.withColumn("position", (F.row_number().over(w) - 1).cast("int"))


def chart_correlation(df: DataFrame, chosen=None, x: str | None = None, y: str | None = None):
    """The correlation view: ``(matrix, bars)``.

    Columns per :func:`correlation_columns`.  ``bars`` holds, for the first two
    targets among X, Y and the used columns, the matrix rows of the target
    without itself: (target, column, r, position).  The matrix is computed
    once and kept.
    """
    use = correlation_columns(df, chosen, x, y)
    if len(use) < 2:
        raise ValueError("correlation needs at least 2 numeric columns")
    matrix = materialize(correlation_matrix(df, use))
    targets = [t for t in dict.fromkeys([x, y, *use]) if t in use][:2]
    bars = matrix.where(F.col("col_a").isin(targets) & (F.col("col_a") != F.col("col_b")))
    bars = bars.select(F.col("col_a").alias("target"), F.col("col_b").alias("column"), "r")
    return matrix, _placed(bars, ["target"])
