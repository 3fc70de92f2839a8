"""A grid's full lines against its tokens one by one."""

import random

from folioscope.operators import selection


def test_lines_keep_the_same_tokens(spark):
    r = random.Random(3)
    lines = [(p, row, r.choice([0, 0, 1, 2, 3, 5, 8, 40])) for p in range(60) for row in r.sample(range(6), r.randint(1, 6))] + [(99, 0, 0)]
    rows = spark.createDataFrame(lines, "p long, row long, n int")
    tokens = spark.createDataFrame([(p, row, c) for p, row, n in lines for c in range(n)], "p long, row long, col long")
    for shape in ((3, 3), (2, 5), (1, 1)):
        want = {(x["p"], x["cell"], x["row"], x["col"]) for x in selection.spatial_keep(tokens, ["p"], "row", "col", *shape).collect()}
        got = [(x["p"], x["cell"], x["row"], x["col"]) for x in selection.spatial_keep_lines(rows, ["p"], "row", "n", *shape).collect()]
        assert set(got) == want and len(got) == len(want)
