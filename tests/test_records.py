"""Relation graphs, page layout, heads."""

import numpy as np
import pytest

from weftline.operators import encoders as E
from weftline.operators import heads as H
from weftline.operators import layout as P
from weftline.operators import records as R


@pytest.fixture(scope="module")
def records(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("records")
    text = '{"id":"%s","title":"T","venue":"V","year":2020,"problem":"P","methods":"M","authors":"A, B","domain":%s,"method":["m"],"task":[],"cites":%s}'
    (at / "a.json").write_text(text % ("a", '["x"]', '[{"target":"b","evidence":"page 2"},{"target":"z","evidence":"e"},{"target":"c"},{"target":"b","evidence":"page 3"}]'))
    (at / "b.json").write_text(text % ("b", '["x","y"]', "[]"))
    (at / "c.json").write_text(text % ("c", '["y"]', "[]"))
    (at / "d.json").write_text((text % ("d", "[]", "[]")).replace('"m"', '"other"').replace('"V"', '""'))
    return R.read(spark, str(at))


def test_relations(spark, records):
    assert {(r.id, r.rule) for r in R.record_errors(records).collect()} == {("d", "no venue"), ("d", "no domain")}
    declared = spark.createDataFrame(
        [("a", "b", "same", "r", "why", False), ("b", "d", "infer", "r", "why", False), ("b", "d", "same", "r", "why", False), ("c", "c", "same", "r", "w", False), ("c", "q", "same", "r", "w", False), ("q", "c", "same", "r", "w", False), ("c", "d", "guess", "r", "w", False), ("c", "d", "same", "r", "", False), ("c", "d", "explicit", "r", "w", False)],
        R.DECLARED,
    )
    edges, found = R.relations(records, declared)
    assert sorted((r["from"], r.to, r.basis) for r in edges.collect()) == [("a", "b", "explicit")] * 2 + [("b", "d", "infer")]
    assert sorted((r["from"], r.to, r.rule) for r in found.collect()) == sorted([("a", "z", "unknown target"), ("a", "c", "no evidence"), ("a", "b", "cited twice"), ("a", "b", "declared beside a citation"), ("b", "d", "declared twice"), ("c", "c", "loop"), ("c", "q", "unknown end"), ("q", "c", "unknown start"), ("c", "d", "unknown basis"), ("c", "d", "no reason"), ("c", "d", "explicit by declaration")])
    assert {(r["first"], r.second): r.shared for r in R.gaps(records, edges).collect()} == {("a", "c"): ["method:m"], ("b", "c"): ["domain:y", "method:m"]}
    assert [(r["from"], r.to) for r in R.weak(records, edges).collect()] == [("b", "d")]
    assert R.around(edges, "b").groupBy("side").count().count() == 2
    assert {r.id: r.subtitle for r in R.page(records).collect()}["a"] == "A et al. · V 2020"


def test_layout(spark):
    two = [(1, 0, 10.0, 100.0 + 20 * k, 280.0, 110.0 + 20 * k, f"l{k}") for k in range(5)] + [(1, 0, 320.0, 100.0 + 20 * k, 590.0, 110.0 + 20 * k, f"r{k}") for k in range(5)] + [(1, 0, 10.0, 20.0, 590.0, 40.0, "title")]
    one = [(1, 1, 10.0, 20.0 + 30 * k, 590.0, 40.0 + 30 * k, f"o{k}") for k in range(7)]
    blocks = spark.createDataFrame(two + one, "doc long, page long, x0 double, y0 double, x1 double, y1 double, text string")
    pages = spark.createDataFrame([(1, 0, 600.0, 800.0), (1, 1, 600.0, 800.0)], "doc long, page long, width double, height double")
    got = {r.page: r.gutter for r in P.gutters(blocks, pages).collect()}
    assert list(got) == [0] and 280 <= got[0] <= 320
    order = [r.text for r in P.ordered(blocks, pages).where("page = 0").orderBy("place").collect()]
    assert order == ["title", *[f"l{k}" for k in range(5)], *[f"r{k}" for k in range(5)]]
    assert [r.text for r in P.ordered(blocks, pages).where("page = 1").orderBy("place").collect()] == [f"o{k}" for k in range(7)]
    assert {r.text for r in P.edge_lines(blocks, pages).collect()} == {"title", "o0", "o1"}
    texts = spark.createDataFrame([(1, 0, "Page 1\nbody of it-\nself\n\n\n\nend"), (1, 1, "Page  2"), (1, 2, None)], "doc long, page long, text string")
    keys = spark.createDataFrame([("page #",)], "key string")
    assert [r.text for r in P.strip(texts, keys, ["doc", "page"]).orderBy("page").collect()] == ["body of itself\n\nend", "", ""]
    stats = P.page_stats(texts, P.gutters(blocks, pages)).collect()[0]
    assert (stats.pages, stats.two_columns) == (3, 1)
    ticks = spark.createDataFrame([("x", 10.0, 0.0), ("x", 110.0, 5.0), ("x", 60.0, 2.5)], "a string, position double, value double")
    line = P.axis(ticks, ["a"]).collect()[0]
    assert line.slope == pytest.approx(0.05) and line.offset == pytest.approx(-0.5)


def test_page_texts(spark):
    """Furniture by document, soft hyphens, both hyphen rules, headings and the files of an extraction."""
    body = [(1, k, 10.0, 200.0, 590.0, 400.0, f"soft\u00adware is bro-\nken and co- \n de\t\tof {k}") for k in range(4)] + [(1, k, 10.0, 10.0, 590.0, 30.0, f"Journal {k + 8}") for k in range(4)] + [(2, 0, 10.0, 200.0, 590.0, 400.0, "other")]
    blocks = spark.createDataFrame(body, "doc long, page long, x0 double, y0 double, x1 double, y1 double, text string")
    pages = spark.createDataFrame([(1, k, 600.0, 800.0) for k in range(4)] + [(2, 0, 600.0, 800.0), (2, 1, 600.0, 800.0)], "doc long, page long, width double, height double")
    made = P.page_texts(blocks, blocks, pages)
    got = {(r.doc, r.page): (r.cols, r.text) for r in made.collect()}
    assert got == {(1, k): (1, f"software is broken and code of {k}") for k in range(4)} | {(2, 0): (1, "other"), (2, 1): (0, "")}
    assert P.page_texts(blocks, blocks, pages, keep=True).where("text like 'Journal%'").count() == 4
    bar = "=" * 72
    assert {r.doc: r.text for r in P.documents(made).collect()}[2] == f"\n\n{bar}\n[page 1 / 2]  cols=1\n{bar}\n\nother\n\n{bar}\n[page 2 / 2]  cols=0\n{bar}\n\n"


@pytest.mark.parametrize("name", sorted(H.HEADS))
def test_heads(name):
    h = np.random.default_rng(0).normal(size=(6, 8))
    out = np.asarray(H.HEADS[name](h, E.Weights(3)))
    assert np.isfinite(out).all() and (out.ndim == 0 or len(out) == 6)
    p = np.array([3, 1, 0, 5, 4, 2])
    assert np.allclose(out if out.ndim == 0 else out[p], H.HEADS[name](h[p], E.Weights(3)))
    assert name != "distributional_q" or np.allclose(np.exp(out).sum(1), 1)
    legal = np.arange(6) < 3
    assert np.isclose(H.dueling_q(h, E.Weights(3), legal)[legal].mean(), H.critic(h, E.Weights(3), pool="sum"))
