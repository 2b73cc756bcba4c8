"""The pipeline stage by stage against plain versions of each stage on what it was given."""

import itertools
import re

import numpy as np
import pytest

import corpus_pipeline as C
from weftline.llm import mixing, quality

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, `_id` string, copy string"


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())


def alnum(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng = np.random.default_rng(8)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 5))
    item = " ".join(word() for _ in range(20))
    texts = []
    for k in range(60):
        lines = [" ".join(word() for _ in range(12)) for _ in range(4)]
        if k % 2:
            lines.insert(int(rng.integers(1, 4)), "Subscribe to our Letter")
        texts.append("\n".join(lines))
    texts += [texts[0], texts[2] + " tail", texts[4].replace("\n", " \n"), texts[6] + " " + item, item, "!!! " * 40, "?? " * 30, "", None, "word " * 3000]
    rows = [(k, t, "en", f"s{k % 7}" if k % 9 else None, len(t or ""), f"id{k}", "c") for k, t in enumerate(texts)] + [(None, texts[1], "en", "s1", 1, "x", "c"), (3, texts[3], "en", "s3", 1, "y", "c")]
    rows += [(200 + k, "!!! " * (5 + k), "en", f"s{k % 7}", 4, "z", "c") for k in range(80)]  # as many as the trees need to learn from
    at = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{at}/documents.parquet")
    labels = [(k, 1, 0) for k in range(60)] + [(k, 0, 0) for k in (65, *range(200, 280))] + [(1000 + k, 0, 0) for k in range(5)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def plain_lines(rows):
    seen = {}
    for r in rows:
        keys = [" ".join(words(x)) for x in (r.text or "").split("\n")] if r.text is not None else []
        for j, key in enumerate(keys):
            if key:
                seen.setdefault(key, []).append((r.source, tuple(keys), r.doc_id))
    spread = {k: min(x[2] for x in v if x[2] is not None) for k, v in seen.items() if len({x[0] for x in v}) >= 5 and len({x[1] for x in v}) >= 5}
    out = []
    for r in rows:
        lines = None if r.text is None else [x for x in r.text.split("\n") if r.doc_id is None or spread.get(" ".join(words(x)), r.doc_id) == r.doc_id]
        out.append((r.doc_id, None if lines is None else "\n".join(lines)))
    return out, spread


def plain_groups(rows):
    sets = {}
    for r in rows:
        w = words(r.text)
        sets.setdefault(r.doc_id, set()).update({tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()})
    up = {k: k for k in sets if k is not None}
    moved = True
    while moved:
        moved = False
        for a, b in itertools.combinations(sorted(up), 2):
            x, y = sets[a], sets[b]
            if x and y and up[a] != up[b] and 100 * len(x & y) >= 80 * len(x | y):
                up[a] = up[b] = min(up[a], up[b])
                moved = True
    return {k for k in up if up[k] == k}


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    step = {}
    for name, stage in C.STAGES:
        out = spark.createDataFrame(stage(spark, docs, sf_dir).collect(), COLUMNS if name != "mixing" else COLUMNS.replace(", copy string", ", copy long"))
        step[name] = (docs, docs.collect(), out.collect())
        assert name == "mixing" or out.columns == docs.columns
        docs = out
    given, before, after = step["quality classifier"]
    score = {(r.doc_id): r.score for r in quality.score(given, spark.read.parquet(f"{sf_dir}/labels.parquet")).collect()}
    assert sorted(map(str, (r.doc_id for r in after))) == sorted(str(r.doc_id) for r in before if score[r.doc_id] >= 0.3)
    assert {65, *range(200, 280)}.isdisjoint(r.doc_id for r in after) and set(range(60)) <= {r.doc_id for r in after}
    _, before, after = step["line dedup"]
    want, spread = plain_lines(before)
    assert list(spread) == ["subscribe to our letter"]
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.text)) for r in after)
    _, before, after = step["near-dedup"]
    kept = plain_groups(before)
    assert {r.doc_id for r in after if r.doc_id is not None} == kept and {60, 61, 62}.isdisjoint(kept)
    assert len({r.doc_id for r in after}) == len(after)
    _, before, after = step["decontamination"]
    item = alnum(spark.read.parquet(f"{sf_dir}/benchmark.parquet").where("item_id = 1").first().text)
    windows = {tuple(item[j : j + 13]) for j in range(len(item) - 12)}

    def dirty(t):
        w = alnum(t)
        hit = {x for j in range(len(w) - 12) if tuple(w[j : j + 13]) in windows for x in range(j, j + 13)}
        return bool(hit) and 20 * len(hit) >= len(w)

    assert sorted(str(r.doc_id) for r in after) == sorted(str(r.doc_id) for r in before if r.doc_id is None or not dirty(r.text))
    assert any(dirty(r.text) for r in before)
    given, before, after = step["mixing"]
    rate = {r.doc_id: r.mix_target / r.mix_source_size if r.mix_source_size else 0 for r in mixing.mix(given).collect()}
    for r in before:
        copies = sorted(x.copy for x in after if x.doc_id == r.doc_id)
        assert copies == list(range(1, len(copies) + 1)) and int(rate[r.doc_id]) <= len(copies) <= int(np.ceil(rate[r.doc_id]))
    assert sorted(str(tuple(r)) for r in C.run(spark, sf_dir).collect()) == sorted(str(tuple(r)) for r in after)


def test_stages_on_nothing(spark, sf_dir):
    none = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for name, stage in C.STAGES:
        out = stage(spark, none, sf_dir)
        assert out.count() == 0 and (name == "mixing" or out.columns == none.columns)
