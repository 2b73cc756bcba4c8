"""Gutters against trying every inner point on every block."""

import random

from weftline.operators import layout as P


def plain(blocks, width):
    best, n = None, len(blocks)
    for k in range(1, P.GUTTER["steps"]):
        x = width * (P.GUTTER["from"] + (P.GUTTER["to"] - P.GUTTER["from"]) * k / P.GUTTER["steps"])
        left, right = sum(b is not None and b <= x for _, b in blocks), sum(a is not None and a >= x for a, _ in blocks)
        cross = n - left - right
        if n >= 6 and left >= 4 and right >= 4 and cross <= max(2, int(n * 0.15)) and (best is None or min(left, right) - 3 * cross > best[0]):
            best = min(left, right) - 3 * cross, x
    return best and best[1]


def test_gutters(spark):
    """Ends on the very points, missing ends and pages of any width; and no array of a page's blocks is made."""
    r, rows, widths = random.Random(3), {}, {}
    for page in range(60):
        w = widths[page] = r.choice([600.0, 595.276, 1.0])
        on = lambda: w * (0.28 + (0.72 - 0.28) * r.randint(1, 239) / 240)  # noqa: B023, E731
        rows[page] = [r.choice([(w * 0.05, w * 0.45), (w * 0.55, w * 0.95), (w * 0.05, on()), (on(), w * 0.95), (None, w * 0.4)]) for _ in range(r.randint(4, 25))]
    blocks = spark.createDataFrame([(1, p, a, b) for p, own in rows.items() for a, b in own], "doc int, page int, x0 double, x1 double")
    found = P.gutters(blocks, spark.createDataFrame([(1, p, w) for p, w in widths.items()], "doc int, page int, width double"))
    got = {x.page: x.gutter for x in found.collect()}
    want = {p: plain(own, widths[p]) for p, own in rows.items()}
    assert got == {p: x for p, x in want.items() if x is not None} and len(got) > 5
    assert "collect_list" not in found._jdf.queryExecution().toString()
