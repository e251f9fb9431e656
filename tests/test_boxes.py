"""Boxes, lines and plane fits on hand-made values."""

import math

from pyspark.sql import functions as F
from tessera.functions import boxes


def values(spark, columns):
    return list(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


def box(*edges):
    return [F.lit(e).cast("long") for e in edges]


def test_edits(spark):
    assert values(spark, boxes.middle(box(-2, -3, -1, 0))) == [-1, -1]
    assert values(spark, boxes.grown(box(3, 3, 5, 5), -1, -1)) == [4, 4, 4, 4]
    assert values(spark, boxes.scaled(box(-1, 1, 3, 5), 0.5)) == [-1, 1, 2, 3]
    assert values(spark, boxes.with_aspect(box(0, 0, 9, 9), 4.0)) == [-6, 2, 13, 6]
    assert values(spark, boxes.with_aspect(box(0, 0, 9, 9), 0.25)) == [2, -6, 6, 13]


def test_points(spark):
    b = box(0, 0, 10, 6)
    assert values(spark, [boxes.edge_distance(b, F.lit(x), F.lit(y)) for x, y in ((5, 3), (5, 9), (12, 3), (12, 9), (0, 0))]) == [3, 3, 2, 5, 0]
    near = [boxes.nearest_box([(0, 0, 1, 1), (4, 0, 5, 1), (0, 0, 9, 9)], F.lit(x), F.lit(y)) for x, y in ((1, 1), (4, 1), (20, 1), (2, 0))]
    assert values(spark, near) == [0, 1, 2, 2]


def test_lines(spark):
    p = lambda x, y: [F.lit(float(x)), F.lit(float(y))]
    assert values(spark, boxes.crossing(p(0, 0), p(2, 2), p(0, 2), p(2, 0))) == [1.0, 1.0]
    assert values(spark, boxes.crossing(p(0, 0), p(2, 2), p(0, 1), p(2, 3))) == [math.inf, math.inf]
    square, dart = [p(0, 0), p(2, 0), p(2, 2), p(0, 2)], [p(0, 0), p(2, 0), p(0.5, 0.5), p(0, 2)]
    assert values(spark, [boxes.convex(square), boxes.convex(square[::-1]), boxes.convex(dart), boxes.convex([p(math.inf, 0), *square[1:]])]) == [True, True, False, False]


def test_fits_find_planted_transforms(spark):
    at = [(0, 0), (1, 0), (0, 2), (3, 1), (2, 5)]
    df = spark.createDataFrame([(float(x), float(y), 2.0 * x - 3 * y + 1, 3.0 * x + 2 * y - 4, 1.0 * x + 4 * y, -x + 0.5 * y + 7) for x, y in at], "x double, y double, u double, v double, p double, q double")
    assert list(boxes.similarity_fit(df, [], "x", "y", "u", "v").first()) == [2.0, 3.0, 1.0, -4.0]
    assert list(boxes.affine_fit(df, [], "x", "y", "p", "q").first()) == [1.0, 4.0, -1.0, 0.5, 0.0, 7.0]
    line = df.withColumn("y", F.col("x"))
    assert list(boxes.affine_fit(line, [], "x", "y", "p", "q").first())[:4] == [None] * 4
