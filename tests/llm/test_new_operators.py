"""Packing, fill-in-middle and the Merkle manifest against plain versions."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from weftline.llm import fim, merkle, packing

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
TEXTS = ["", None, "One two  three.\n\n\tfour", "  ", "é" * 40, "😀á b<|endoftext|>c", "has <M> inside", "a<P", "word " * 3000, "x" * 9000, "row\r\nrow 12345", "\x00\x1c \x85z", "ÀB C"]
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, fim_text string, path string, length long"


@pytest.fixture(scope="module")
def docs(spark):
    """Odd texts, null ids and sources, repeated rows and ids, negative ids, columns with the names of inner ones."""
    rows = [(k * 7 - 3, f"s{k % 3}" if k % 4 else None, "en" if k % 5 else None, k if k % 2 else None, t, "x", "y", k) for k, t in enumerate(TEXTS)]
    rows += [rows[2], rows[2], (rows[3][0], rows[3][1], "de", 3, "another text", "x", "y", 1), (None, "s1", "en", 2, "no id", None, None, None), (None, None, None, None, None, None, None, None)]
    rows += [(1 << 61, "s1", "en", 1, "far", "x", "y", 2), (-(1 << 60), "s1", "en", 1, "Far", "x", "y", 2), (5, "lone", "en", 1, "Alone", "x", "y", 2)]
    rows += [(1000 + k, "big", "en", k, f"Text {k % 50}", "x", "y", k) for k in range(700)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def tokens():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda text: [*t.encode(text, add_special_tokens=False).ids, 2]


def plain_pieces(ids: list[int], capacity: int) -> list[tuple]:
    ends = list(range(len(ids), 0, -capacity))[::-1]
    starts = [0, *ends[:-1]]
    return [(k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(starts, ends, strict=True))]


@pytest.mark.parametrize("capacity", [16, 1024])
def test_packing(docs, capacity):
    ids = tokens()
    got = [tuple(r) for r in packing.pack(docs, RANKS, PATTERN, capacity=capacity).collect()]
    want = [(r.doc_id, *p) for r in docs.collect() for p in plain_pieces(ids(r.text or ""), capacity)]
    key = lambda x: tuple((v is None, v or 0) for v in x)
    assert sorted((r[:5] for r in got), key=key) == sorted(want, key=key)
    held: dict[int, list] = {}
    for r in got:
        held.setdefault(r[5], []).append((r[6], r[3]))
    for own in held.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
    total = sum(r[3] for r in got)
    assert len(held) <= total / capacity * 1.1 + 2


def test_packing_again_and_empty(spark, docs):
    a, b = (sorted(map(str, packing.pack(d, RANKS, PATTERN, capacity=64).drop("sequence_id", "offset").collect())) for d in (docs, docs.repartition(2)))
    assert a == b
    assert packing.pack(docs.limit(0), RANKS, PATTERN).count() == 0


def test_stretches_keep_tokens(monkeypatch):
    monkeypatch.setattr(packing, "STRETCH", 20)
    mine, ids = packing.Tokens(RANKS, PATTERN), tokens()
    for text in [t or "" for t in TEXTS] + ["a  b \n c's   d   e " * 9, "\n\n x" * 30, "don't stop 12 " * 20]:
        assert np.frombuffer(mine.ids(text), "<u4").tolist() == ids(text)[:-1], text[:30]
        assert "".join(mine.stretches(text)) == text


@pytest.mark.parametrize("most", [1, 3, 40])
def test_best_fit_against_plain(most):
    rng, fit, bins, closed = random.Random(most), packing.BestFit(50, most), [], set()
    for _ in range(800):
        n = rng.randint(1, 50)
        at, offset = fit.put(n)
        fits = [50 - b for k, b in enumerate(bins) if k not in closed and 50 - b >= n]
        if fits:
            assert 50 - bins[at] == min(fits) and offset == bins[at] and at not in closed
            bins[at] += n
        else:
            open_now = [k for k, b in enumerate(bins) if k not in closed and b < 50]
            assert at == len(bins) and offset == 0
            if len(open_now) == most:
                # the fullest goes; which of equally full ones is the packer's choice
                fullest = max(bins[k] for k in open_now)
                closed.add(next(k for k in reversed(open_now) if bins[k] == fullest and k not in {x for s in fit.stacks for x in s}))
            bins.append(n)


def test_fill_in_middle(docs):
    out = fim.transform(docs)
    assert out.columns == [*docs.columns, *fim.ADDED]
    got = out.withColumn("again", fim.restored(F.col("fim_output"), F.col("fim_form"))).collect()
    assert len(got) == docs.count()
    forms = set()
    for r in got:
        text = r.text or ""
        digest = hashlib.sha256(f"1:{'null' if r.doc_id is None else r.doc_id}".encode()).hexdigest()
        h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
        n = len(text)
        assert r.fim_n == n and r.again == text
        if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
            assert (r.fim_form, r.fim_prefix_chars, r.fim_middle_chars, r.fim_output) == ("plain", None, None, text)
            continue
        a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
        forms.add(r.fim_form)
        assert (r.fim_prefix_chars, r.fim_middle_chars) == (a, b - a)
        p, m, s = text[:a], text[a:b], text[b:]
        assert r.fim_form == ("spm" if h[3] % 100 < 20 else "psm")
        assert r.fim_output == (f"<S>{s}<P>{p}<M>{m}" if r.fim_form == "spm" else f"<P>{p}<S>{s}<M>{m}")
    assert forms == {"psm", "spm"} and fim.transform(docs.limit(0)).count() == 0


def test_units_in_blocks():
    text = "aé😀\n\r\n\x00" * 200
    units = fim.Units(fim.splitters(), text)
    assert units.n == len(text) and [units.offset(k) for k in range(0, len(text) + 1, 97)] == list(range(0, len(text) + 1, 97)) and units.offset(units.n) == len(text)
    for n in (0, 1, 255, 256, 257, 1 << 16, (1 << 16) + 1):
        units = fim.Units(fim.splitters(), "\n" * n)
        assert units.n == n and units.offset(n) == n and units.offset(n // 2) == n // 2


def H(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_trie(digests: list[str], fanout: int):
    """The root, and each leaf's siblings (left, right) by level."""
    paths, at, level = [[] for _ in digests], list(range(len(digests))), digests
    while len(level) > 1:
        for k, place in enumerate(at):
            low = place // fanout * fanout
            paths[k].append(("".join(level[low:place]), "".join(level[place + 1 : low + fanout])))
        level = [H(*level[k : k + fanout]) for k in range(0, len(level), fanout)]
        at = [p // fanout for p in at]
    return level[0], paths


@pytest.mark.parametrize("fanout", [2, 16])
def test_merkle(docs, fanout):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = merkle.leaf(*map(F.col, ("doc_id", "source", "lang", "n_chars", "text")))
    got = merkle.manifest(docs.withColumn("leaf", leaf).select("doc_id", "source", "leaf", "lang"), fanout=fanout)
    got = got.withColumns({"proof": merkle.proof_digest(F.col("path")), "folded": merkle.folded(F.col("leaf"), F.col("path"))}).collect()
    groups: dict = {}
    for r in docs.collect():
        groups.setdefault(r.source, []).append((r.doc_id if r.doc_id is not None else -(1 << 63), H(*map(field, (r.doc_id, r.source, r.lang, r.n_chars, r.text)))))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    tries = {s: plain_trie([x[1] for x in sorted(groups[s])], fanout) for s in order}
    root, above = plain_trie([tries[s][0] for s in order], fanout)
    want = sorted((s or "", leaf, tries[s][0], root, H(*[a + b for a, b in path + above[k]])) for k, s in enumerate(order) for (_, leaf), path in zip(sorted(groups[s]), tries[s][1], strict=True))
    assert sorted((r.source or "", r.leaf, r.subroot, r.root, r.proof) for r in got) == want
    assert all(r.folded == r.root for r in got)


def test_merkle_small_tables(spark):
    none = spark.createDataFrame([], "doc_id long, source string, leaf string")
    assert merkle.manifest(none).count() == 0
    lone = merkle.manifest(spark.createDataFrame([(1, None, "ab")], none.schema)).first()
    assert (lone.subroot, lone.root, lone.path) == ("ab", "ab", [])
    pair = merkle.manifest(spark.createDataFrame([(1, None, "ab"), (1, "", "cd")], none.schema)).collect()
    assert {r.root for r in pair} == {H("ab", "cd")}
    with pytest.raises(ValueError):
        merkle.manifest(none, fanout=40)
