"""Matrices as rows (i, j, v), indices from 0: shapes, parts and products as relational steps; small square ones a group with decompositions.

A missing row is a zero. Every step is a projection, a filter or one join on an index, so matrices may have any number of rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans.session import table


def entries(i: Column, j: Column, v: Column | None = None) -> list[Column]:
    v = F.col("v") if v is None else v
    return [i.cast("long").alias("i"), j.cast("long").alias("j"), v.cast("double").alias("v")]


def transposed(m: DataFrame) -> DataFrame:
    return m.select(*entries(F.col("j"), F.col("i")))


def diagonal(m: DataFrame) -> DataFrame:
    """The diagonal as a column."""
    return m.filter(F.col("i") == F.col("j")).select(*entries(F.col("i"), F.lit(0)))


def diagonal_matrix(column: DataFrame) -> DataFrame:
    """A column on the diagonal of a square."""
    return column.select(*entries(F.col("i"), F.col("i")))


def lower(m: DataFrame) -> DataFrame:
    """At and below the diagonal."""
    return m.filter(F.col("i") >= F.col("j"))


def upper(m: DataFrame) -> DataFrame:
    """At and above the diagonal."""
    return m.filter(F.col("i") <= F.col("j"))


def symmetric_from_lower(m: DataFrame) -> DataFrame:
    """The lower triangle and its mirror image."""
    return lower(m).unionByName(transposed(m.filter(F.col("i") > F.col("j"))))


def part(m: DataFrame, top: int, left: int, rows: int, columns: int) -> DataFrame:
    """A rectangle, moved to the origin."""
    return m.filter(F.col("i").between(top, top + rows - 1) & F.col("j").between(left, left + columns - 1)).select(*entries(F.col("i") - top, F.col("j") - left))


def without_row(m: DataFrame, row: int) -> DataFrame:
    return m.filter(row != F.col("i")).select(*entries(F.when(row < F.col("i"), F.col("i") - 1).otherwise(F.col("i")), F.col("j")))


def without_column(m: DataFrame, column: int) -> DataFrame:
    return transposed(without_row(transposed(m), column))


def flipped_left_right(m: DataFrame, columns: int) -> DataFrame:
    return m.select(*entries(F.col("i"), columns - 1 - F.col("j")))


def flipped_up_down(m: DataFrame, rows: int) -> DataFrame:
    return m.select(*entries(rows - 1 - F.col("i"), F.col("j")))


def rolled(m: DataFrame, rows: int, columns: int, down: int, right: int) -> DataFrame:
    """Shifted down and right, around the edges."""
    return m.select(*entries(F.pmod(F.col("i") + down, F.lit(rows)), F.pmod(F.col("j") + right, F.lit(columns))))


def reshaped(m: DataFrame, columns: int, new_columns: int) -> DataFrame:
    """The same values in row order in rows of another width."""
    place = F.col("i") * columns + F.col("j")
    return m.select(*entries(F.floor(place / new_columns), F.pmod(place, F.lit(new_columns))))


def beside(a: DataFrame, b: DataFrame, columns: int) -> DataFrame:
    """b at the right of a."""
    return a.select(*entries(F.col("i"), F.col("j"))).unionByName(b.select(*entries(F.col("i"), F.col("j") + columns)))


def below(a: DataFrame, b: DataFrame, rows: int) -> DataFrame:
    """b under a."""
    return a.select(*entries(F.col("i"), F.col("j"))).unionByName(b.select(*entries(F.col("i") + rows, F.col("j"))))


def added(a: DataFrame, b: DataFrame, factor: float = 1.0) -> DataFrame:
    """a + factor * b."""
    both = a.select(*entries(F.col("i"), F.col("j"))).unionByName(b.select(*entries(F.col("i"), F.col("j"), F.col("v") * factor)))
    return both.groupBy("i", "j").agg(F.sum("v").alias("v"))


def times(a: DataFrame, b: DataFrame) -> DataFrame:
    """Value by value; zeros stay out."""
    return a.join(b.select("i", "j", F.col("v").alias("_w")), ["i", "j"]).select(*entries(F.col("i"), F.col("j"), F.col("v") * F.col("_w")))


def power(m: DataFrame, exponent: float) -> DataFrame:
    return m.select(*entries(F.col("i"), F.col("j"), F.pow(F.col("v"), F.lit(exponent))))


def rows_scaled(m: DataFrame, column: DataFrame) -> DataFrame:
    """Row i times place i of a column."""
    return m.join(column.select("i", F.col("v").alias("_w")), "i").select(*entries(F.col("i"), F.col("j"), F.col("v") * F.col("_w")))


def columns_scaled(m: DataFrame, column: DataFrame) -> DataFrame:
    """Column j times place j of a column."""
    return m.join(column.select(F.col("i").alias("j"), F.col("v").alias("_w")), "j").select(*entries(F.col("i"), F.col("j"), F.col("v") * F.col("_w")))


def row_sums(m: DataFrame) -> DataFrame:
    return m.groupBy("i").agg(F.sum("v").alias("v")).select(*entries(F.col("i"), F.lit(0)))


def column_sums(m: DataFrame) -> DataFrame:
    return m.groupBy("j").agg(F.sum("v").alias("v")).select(*entries(F.lit(0), F.col("j")))


def filled(spark: SparkSession, rows: int, columns: int, value: float) -> DataFrame:
    """All values equal: 0 and 1 give the zero and the one matrix."""
    place = F.col("id")
    return spark.range(rows * columns).select(*entries(F.floor(place / columns), F.pmod(place, F.lit(columns)), F.lit(value)))


def identity(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).select(*entries(F.col("id"), F.col("id"), F.lit(1.0)))


def spaced(spark: SparkSession, first: float, last: float, n: int, logarithmic: bool = False) -> DataFrame:
    """A row of n values at equal steps from first to last, or 10 to their power; a single one is the last."""
    x = F.lit(float(last)) if n == 1 else F.lit(float(first)) + F.col("id") * ((last - first) / (n - 1))
    return spark.range(n).select(*entries(F.lit(0), F.col("id"), F.pow(F.lit(10.0), x) if logarithmic else x))


#: Places of the matrix that kronecker() sends to every task.
SENT = 250_000


def kronecker(a: DataFrame, b: DataFrame, rows: int, columns: int) -> DataFrame:
    """Every value of a times all of b (rows by columns, at most SENT places, as it is sent to every task; more are an error)."""
    if rows * columns > SENT:
        raise ValueError(f"a matrix of {rows} by {columns} is too large to send")
    x = b.select(F.col("i").alias("_k"), F.col("j").alias("_l"), F.col("v").alias("_w")).filter((F.col("_k") < rows) & (F.col("_l") < columns))
    grid = x.agg(F.collect_list(F.struct("_k", "_l", "_w")).alias("_b"))  # one row
    y = a.crossJoin(F.broadcast(grid)).select("i", "j", "v", F.explode("_b").alias("_e"))
    return y.select(*entries(F.col("i") * rows + F.col("_e._k"), F.col("j") * columns + F.col("_e._l"), F.col("v") * F.col("_e._w")))


def decomposed(df: DataFrame, by: str, n: int) -> DataFrame:
    """(by, det, trace, largest, smallest) of the n by n matrix of each group (rows by, i, j, v): determinant, trace, largest and smallest singular value."""
    kinds = dict(df.dtypes)

    def run(f: pd.DataFrame) -> pd.DataFrame:
        a = np.zeros((n, n))
        a[f["i"].to_numpy(), f["j"].to_numpy()] = f["v"].to_numpy()
        s = np.linalg.svd(a, compute_uv=False)
        return pd.DataFrame({by: [f[by].iloc[0]], "det": [np.linalg.det(a)], "trace": [a.trace()], "largest": [s[0]], "smallest": [s[-1]]})

    return df.select(by, "i", "j", "v").groupBy(by).applyInPandas(run, f"`{by}` {kinds[by]}, det double, trace double, largest double, smallest double")


def inverted(df: DataFrame, by: str, n: int) -> DataFrame:
    """(by, i, j, v) of the inverse of each group's n by n matrix, the pseudo-inverse of a singular one."""
    kinds = dict(df.dtypes)

    def run(f: pd.DataFrame) -> pd.DataFrame:
        a = np.zeros((n, n))
        a[f["i"].to_numpy(), f["j"].to_numpy()] = f["v"].to_numpy()
        at = np.indices((n, n)).reshape(2, -1)
        return pd.DataFrame({by: f[by].iloc[0], "i": at[0], "j": at[1], "v": np.linalg.pinv(a).ravel()})

    return df.select(by, "i", "j", "v").groupBy(by).applyInPandas(run, f"`{by}` {kinds[by]}, i long, j long, v double")


ROWS, COLUMNS = 7, 5


def _m(s, d):
    return table(s, d, "lineitem").groupBy((F.col("l_linenumber") - 1).cast("long").alias("i"), F.pmod(F.col("l_partkey"), F.lit(COLUMNS)).cast("long").alias("j")).agg(F.sum("l_quantity").alias("v"))


def _tagged(parts: dict[str, DataFrame]) -> DataFrame:
    out = None
    for op, m in parts.items():
        x = m.select(F.lit(op).alias("op"), "i", "j", F.round("v", 4).alias("v"))
        out = x if out is None else out.unionByName(x)
    return out


def _shapes(s, d):
    m = _m(s, d)
    return _tagged(
        {
            "transposed": transposed(m), "diagonal": diagonal(m), "diagonal_matrix": diagonal_matrix(diagonal(m)), "lower": lower(m), "upper": upper(m), "symmetric": symmetric_from_lower(m.filter(f"i < {COLUMNS}")),
            "part": part(m, 1, 2, 3, 2), "without_row": without_row(m, 2), "without_column": without_column(m, 1), "left_right": flipped_left_right(m, COLUMNS), "up_down": flipped_up_down(m, ROWS),
            "rolled": rolled(m, ROWS, COLUMNS, 2, -1), "reshaped": reshaped(m, COLUMNS, ROWS), "beside": beside(m, m, COLUMNS), "below": below(m, m, ROWS),
        }
    )


def _values(s, d):
    m = _m(s, d)
    return _tagged(
        {
            "added": added(m, transposed(transposed(m)), -0.5), "times": times(m, m), "power": power(m, 0.5), "rows_scaled": rows_scaled(m, diagonal(m)), "columns_scaled": columns_scaled(m, diagonal(m)),
            "row_sums": row_sums(m), "column_sums": column_sums(m), "filled": filled(s, 2, 3, 4.0), "identity": identity(s, 3), "spaced": spaced(s, 1.0, 2.0, 5), "logarithmic": spaced(s, 0.0, 2.0, 3, True),
            "kronecker": kronecker(part(m, 0, 0, 2, 2), part(m, 0, 0, 2, 2), 2, 2),
        }
    )


def _squares(s, d):
    """The covariance matrix of quantity and price a return flag."""
    x = table(s, d, "lineitem").groupBy("l_returnflag").agg(F.var_samp("l_quantity").alias("a"), F.covar_samp("l_quantity", "l_tax").alias("b"), F.var_samp("l_tax").alias("c"))
    cells = F.array(*[F.struct(F.lit(i).cast("long").alias("i"), F.lit(j).cast("long").alias("j"), F.col(c).alias("v")) for i, j, c in ((0, 0, "a"), (0, 1, "b"), (1, 0, "b"), (1, 1, "c"))])
    return x.select("l_returnflag", F.explode(cells).alias("e")).select("l_returnflag", "e.*")


QUERIES = {
    "matrix_shapes": _shapes,
    "matrix_values": _values,
    "matrix_decompositions": lambda s, d: decomposed(_squares(s, d), "l_returnflag", 2).select("l_returnflag", *[F.round(c, 6).alias(c) for c in ("det", "trace", "largest")]),
    "matrix_inverse": lambda s, d: inverted(_squares(s, d), "l_returnflag", 2).withColumn("v", F.round("v", 4)),
}

_MATRIX = f"m AS (SELECT (l_linenumber - 1)::BIGINT AS i, (l_partkey % {COLUMNS})::BIGINT AS j, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2), g AS (SELECT i, v FROM m WHERE i = j)"
_COV = "c AS (SELECT l_returnflag, var_samp(l_quantity) AS a, covar_samp(l_quantity, l_tax) AS b, var_samp(l_tax) AS c FROM lineitem GROUP BY 1)"


def _union(parts: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT '{op}' AS op, i::BIGINT AS i, j::BIGINT AS j, round(v::DOUBLE, 4) AS v FROM ({q})" for op, q in parts.items())


ORACLES = {
    "matrix_shapes": f"WITH {_MATRIX} "
    + _union(
        {
            "transposed": "SELECT j AS i, i AS j, v FROM m", "diagonal": "SELECT i, 0 AS j, v FROM g", "diagonal_matrix": "SELECT i, i AS j, v FROM g", "lower": "SELECT * FROM m WHERE i >= j", "upper": "SELECT * FROM m WHERE i <= j",
            "symmetric": "SELECT * FROM m WHERE i >= j AND i < 5 UNION ALL SELECT j, i, v FROM m WHERE i > j AND i < 5", "part": "SELECT i - 1 AS i, j - 2 AS j, v FROM m WHERE i IN (1, 2, 3) AND j IN (2, 3)",
            "without_row": "SELECT i - (i > 2)::INT AS i, j, v FROM m WHERE i <> 2", "without_column": "SELECT i, j - (j > 1)::INT AS j, v FROM m WHERE j <> 1", "left_right": "SELECT i, 4 - j AS j, v FROM m", "up_down": "SELECT 6 - i AS i, j, v FROM m",
            "rolled": "SELECT (i + 2) % 7 AS i, (j + 4) % 5 AS j, v FROM m", "reshaped": "SELECT (i * 5 + j) // 7 AS i, (i * 5 + j) % 7 AS j, v FROM m", "beside": "SELECT * FROM m UNION ALL SELECT i, j + 5, v FROM m",
            "below": "SELECT * FROM m UNION ALL SELECT i + 7, j, v FROM m",
        }
    ),
    "matrix_values": f"WITH {_MATRIX} "
    + _union(
        {
            "added": "SELECT i, j, v / 2 AS v FROM m", "times": "SELECT i, j, v * v AS v FROM m", "power": "SELECT i, j, sqrt(v) AS v FROM m", "rows_scaled": "SELECT m.i, m.j, m.v * g.v AS v FROM m JOIN g USING (i)",
            "columns_scaled": "SELECT m.i, m.j, m.v * g.v AS v FROM m JOIN g ON m.j = g.i", "row_sums": "SELECT i, 0 AS j, sum(v) AS v FROM m GROUP BY i", "column_sums": "SELECT 0 AS i, j, sum(v) AS v FROM m GROUP BY j",
            "filled": "SELECT x AS i, y AS j, 4.0 AS v FROM range(2) a(x), range(3) b(y)", "identity": "SELECT x AS i, x AS j, 1.0 AS v FROM range(3) a(x)", "spaced": "SELECT 0 AS i, x AS j, 1 + x / 4 AS v FROM range(5) a(x)",
            "logarithmic": "SELECT 0 AS i, x AS j, pow(10, x) AS v FROM range(3) a(x)", "kronecker": "SELECT a.i * 2 + b.i AS i, a.j * 2 + b.j AS j, a.v * b.v AS v FROM m a JOIN m b ON a.i < 2 AND a.j < 2 AND b.i < 2 AND b.j < 2",
        }
    ),
    "matrix_decompositions": f"WITH {_COV} SELECT l_returnflag, round(a * c - b * b, 6) AS det, round(a + c, 6) AS trace, round((a + c + sqrt((a - c) * (a - c) + 4 * b * b)) / 2, 6) AS largest FROM c",
    "matrix_inverse": f"""WITH {_COV}, d AS (SELECT *, a * c - b * b AS det FROM c)
SELECT l_returnflag, i::BIGINT AS i, j::BIGINT AS j, round(CASE WHEN i = 0 AND j = 0 THEN c / det WHEN i = 1 AND j = 1 THEN a / det ELSE -b / det END, 4) AS v FROM d, range(2) x(i), range(2) y(j)""",
}
