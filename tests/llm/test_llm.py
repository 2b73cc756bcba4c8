"""Every operator against a plain version on small tables, with nulls, empties, ties and repeated rows."""

import hashlib
import json
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from weftline.llm import ann, chat, decontam, html, line_dedup, lm, mixing, near_dedup, pii, quality, queries


def lower(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s or "")


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(5)
    words = [f"w{k}" for k in range(300)]
    base = [" ".join(rng.choice(words, 60)) for _ in range(12)]
    out = list(base)
    for b in base[:6]:
        for _ in range(4):
            w = b.split()
            w[rng.integers(60)] = "Changed"
            out.append(" ".join(w))
    return [*out, base[0], None, "", " \n\t", "one", "One", "two words", "w " * 5000, "é　x 😀 y"]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(k, t, f"s{k % 6}" if k % 7 else None, "clash") for k, t in enumerate(texts)] + [(None, "null id", "s1", "clash"), (3, texts[3], "s3", "clash")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, sig string")


def shingles(t, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


@pytest.mark.parametrize("limit", [600, 2])
def test_near_duplicates(docs, texts, limit):
    got = {r.doc_id: r for r in near_dedup.near_duplicates(docs, cfg=near_dedup.ChosenPath(shingle=4, node_limit=limit, block=3)).collect()}
    sets = [shingles(t, 4) for t in texts]
    label = list(range(len(sets)))
    for _ in sets:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and 100 * len(a & b) >= 80 * len(a | b):
                    label[i] = label[j] = min(label[i], label[j])
    assert [(got[k].n_shingles, got[k].component_id) for k in range(len(sets))] == [(len(s), c) for s, c in zip(sets, label, strict=True)]
    assert got[None].component_id is None and got[None].kept


def test_near_duplicates_of_nothing(docs):
    assert near_dedup.near_duplicates(docs.limit(0)).count() == 0
    assert near_dedup.keep_one(docs).groupBy("doc_id").count().where("count > 1").count() == 0


def test_pii(spark):
    texts = [None, "", "a@b.com_x@y.zz", "1.2.3.4.5.6.7.8 256.1.1.1", "4111 1111 1111 1111", "+1 (017) 555-7713", "😀 x@y.zz", "4" * 30000]
    texts += [f'filler {k} token = "{hashlib.sha1(str(k).encode()).hexdigest()}" end' for k in range(6)] + ['token = "unseen-77x1"']
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r for r in pii.report(pii.extract(rows)).collect()}
    assert got[0].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert got[2].spans == "email:0:7,email:7:14" and got[3].spans == "ip:0:7,ip:8:15"
    assert got[4].n_card == 1 and got[5].n_phone == 1 and got[6].spans == "email:2:8" and got[7].n_card == 0
    assert got[14].spans == "id:9:20"


def test_nearest(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1500, 16)).astype(np.float32)
    x[700:1000] = x[0]
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(5000, None), (5001, [0.0] * 16), (5002, [float("nan")] + [1.0] * 15), (5003, [None] + [1.0] * 15), (5004, [1.0, 2.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in ann.nearest(vectors, vectors.where("vec_id % 100 = 0"), cfg=ann.Graph(shard_rows=500, query_rows=7)).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    hits = 0
    for q in range(0, 1500, 100):
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(1))
        d[q] = np.inf
        best = np.lexsort((np.arange(1500), d))[:10]
        hits += len(set(best) & {v for v, _ in got[q].values()})
        assert all(abs(s - d[v]) < 1e-9 for v, s in got[q].values()) and sorted(got[q]) == list(range(1, 11))
    assert hits / 150 >= 0.9 and len(got) == 15
    assert [got[0][k][0] for k in range(1, 11)] == list(range(700, 710))


def test_lm(docs):
    rows = docs.collect()
    tokens = [[*re.findall(r"[^\x20\x09-\x0D]+", lower(r.text)), None] for r in rows]
    held = [r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 1 for r in rows]
    c = Counter(t for w, h in zip(tokens, held, strict=True) if not h for t in w)
    n, v = sum(c.values()), len(c)
    want = sorted((r.doc_id is None, r.doc_id, len(w), sum(c[t] > 0 for t in w), n, round(sum(math.log10((c[t] + 0.5) / (n + 0.5 * (v + 1))) for t in w), 6)) for r, w in zip(rows, tokens, strict=True))
    got = lm.score(docs, cfg=lm.LogBloom(frequent_limit=20, segment_tokens=2000)).collect()
    assert sorted((r.doc_id is None, r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score <= 0 for r in got) and lm.score(docs.limit(0)).count() == 0


def plain_lm(rows, cfg):
    """Scores from exact counts, quantised, by hand."""
    quantised = lambda n: cfg.decoded()[int(cfg.level(np.array([n]))[0])] if n else 0.0
    words = {k: [*re.findall(r"[^\x20\x09-\x0D]+", lower(t)), None] for k, t in rows}
    train = [w for k, w in words.items() if zlib.crc32(str(k).encode()) % 5 != 1]
    c, p = Counter(t for w in train for t in w), Counter(x for w in train for x in zip(w, w[1:], strict=False))
    n, v = sum(c.values()), len(c)
    level = lambda x: int(cfg.level(np.array([x]))[0]) if x else 0
    word = lambda x, less=0: (max(x - less, 0) + 0.5) / (max(n - less, 0) + 0.5 * (v + 1))
    step = lm.RATIOS[1] - lm.RATIOS[0]

    def parts(w, less=0):
        for left, t in zip([None, *w], w, strict=False):
            first = left is None
            pair, count, of = 0 if first else quantised(p[left, t]), quantised(c[t]), quantised(c[left]) if not first else 0
            ratio = min((pair - less) / max(of - less, 1), 1) / word(count, less) if pair > less else 0
            cell = min(max(math.floor((math.log10(ratio) - lm.RATIOS[0]) / step) + 1, 1), lm.CELLS - 1) if ratio else 0
            yield (lm.LEVELS - 1 if first else level(c[left])), cell, word(count)

    table = np.zeros(lm.LEVELS * lm.CELLS)
    for w in train:
        for at, cell, _ in parts(w, 1):
            table[at * lm.CELLS + cell] += 1
    gain = lm.gains(table)
    return {k: sum(gain[at * lm.CELLS + cell] + math.log10(x) for at, cell, x in parts(w)) for k, w in words.items()}


def test_lm_plain(spark, texts):
    """With bits enough for no false probe, the score is that of exact quantised counts."""
    rows, cfg = list(enumerate(texts)), lm.LogBloom(bits=60)
    got = {r.doc_id: r.score for r in lm.score(spark.createDataFrame(rows, "doc_id long, text string"), cfg=cfg).collect()}
    want = plain_lm(rows, cfg)
    assert all(abs(got[k] - want[k]) < 1e-6 * max(1, abs(want[k])) for k in want)


def test_lm_segments(docs):
    """Beyond the bound of the broadcast, with the production filter, every figure is the same."""
    by = lambda got: sorted(((r.doc_id is None, r.doc_id, r.n_tokens, r.n_known, r.base_score, r.score) for r in got.collect()), key=str)
    one = by(lm.score(docs, cfg=lm.LogBloom(segment_tokens=3000)))
    two = by(lm.score(docs, cfg=lm.LogBloom(segment_tokens=3000, most_broadcast=0, frequent_limit=30, group_tokens=500)))
    assert [x[:4] for x in one] == [x[:4] for x in two]
    assert np.allclose([x[4:] for x in one], [x[4:] for x in two], rtol=1e-9)
    assert lm.score(docs.limit(0), cfg=lm.LogBloom(most_broadcast=-1)).count() == 0


@pytest.mark.parametrize("how", [{}, {"most_broadcast": 0}])
def test_lm_pairs_seen_once(spark, how):
    """A pair seen once in training raises a held-out score, with the filter broadcast or not."""
    held = lambda k: zlib.crc32(str(k).encode()) % 5 == 1
    trained, (one, two) = [k for k in range(60) if not held(k)], [k for k in range(60) if held(k)][:2]
    texts = {k: f"common a{k} common words b{k}" for k in trained}
    texts |= {one: f"common a{trained[0]}", two: f"common b{trained[0]}"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r for r in lm.score(docs, cfg=lm.LogBloom(bits=40, **how)).collect()}
    assert abs(got[one].base_score - got[two].base_score) < 1e-9 and got[one].score > got[two].score + 0.1


def test_lines(spark):
    rows = [(k, f"body {k} a\nAll  Rights\nbody {k} b", f"s{k % 8}") for k in range(40)] + [(100 + k, "same text\nof copies", f"s{k}") for k in range(8)] + [(200, None, "s1"), (None, "all rights", "s2"), (201, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in line_dedup.drop_boilerplate(docs).collect()}
    assert got[0].text == rows[0][1] and all(got[k].text == f"body {k} a\nbody {k} b" and got[k].line_n_removed == 1 for k in range(1, 40))
    assert all(got[100 + k].line_n_removed == 0 for k in range(8)) and got[200].text is None and got[None].text == "all rights"


def test_lines_of_blocks(spark):
    """Three-line footers, lines between blank lines and lines that also ride in many copies are boilerplate; copies alone are not."""
    foot = "foot one\nfoot two\nfoot three"
    texts = [f"body {k}\n{foot}\n\nalone\n\nend {k}\nrides" for k in range(10)]
    copies = ["copied\nrides\nof all"] * 60
    docs = spark.createDataFrame([(k, t, f"s{k % 10}") for k, t in enumerate(texts + copies)], "doc_id long, text string, source string")
    got = [r.text for r in sorted(line_dedup.drop_boilerplate(docs).collect(), key=lambda r: r.doc_id)]
    assert got == texts[:1] + [f"body {k}\n\n\nend {k}" for k in range(1, 10)] + ["copied\nof all"] * 60


@pytest.mark.parametrize("bound", [1 << 20, 0])
def test_decontamination(spark, bound):
    item = " ".join(f"Q{k}" for k in range(20))
    texts = [f"x, {item}! y", " ".join(item.split()[:12]), "tiny Item here", None, "", "aa " * 3000 + item, item.split()[3] + " " + " ".join(item.split()[2:16])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([(1, item), (10, item), (2, "TINY item"), (3, None), (4, "!!"), (1, item)], "item_id long, text string")
    got = {r.doc_id: r for r in decontam.with_verdict(decontam.contamination(docs, bench, most_broadcast=bound)).collect()}
    digest = lambda *x: hashlib.sha256(",".join(x).encode()).hexdigest()
    assert [(got[k].n_words, got[k].n_hit, got[k].n_items, got[k].contaminated) for k in range(7)] == [(22, 20, 2, True), (12, 0, 0, False), (3, 2, 1, True), (0, 0, 0, False), (0, 0, 0, False), (3020, 20, 2, False), (15, 14, 2, True)]
    assert got[0].items_sha256 == digest("1", "10") and got[2].items_sha256 == digest("2") and got[3].items_sha256 == digest()


def test_quality(spark):
    rng = np.random.default_rng(2)
    good = [" ".join("".join(rng.choice(list("abcdefgh"), 5)) for _ in range(40)) for _ in range(150)]
    bad = ["!!! " * int(rng.integers(5, 60)) for _ in range(150)]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate([*good, *bad, "", None])], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k < 150), 0) for k in range(300)] + [(5, None, 0), (9999, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.score(docs, labels).collect()
    assert len(got) == 302 and all(0 <= r.score <= 1 for r in got)
    assert all(r.predicted == (r.doc_id < 150) for r in got if r.doc_id < 300 and r.held_out)
    kept = {r.doc_id for r in quality.keep_good(docs, labels).collect()}
    assert set(range(150)) <= kept and not kept & set(range(150, 300))
    assert quality.score(docs, labels.limit(0)).where("score != 0.5").count() == 0


def test_chat(spark):
    rows = [(1, 0, "us\ner", "a<|end|>\n<|start|>assistant\nx"), (1, 1, "assistant", "b<\\|x <\\\\| <||"), (2, 0, None, None), (2, 1, "assistant", ""), (3, 0, "a\\n<|q", "<|😀"), (3, 0, "a\\n<|q", "<|😀"), (None, 0, "assistant", "</s>[INST] $1")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.read_back(chat.format_chats(frame)).collect()}
    for key in (1, 2, 3, None):
        turns = [(r or "", t or "") for c, _, r, t in rows if c == key]
        loss = "".join(t for r, t in turns if r == "assistant")
        assert got[key].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert got[key].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest() and got[key].loss_chars == len(loss) and got[key].n_turns == len(turns)


MARKED = ["<|end|>", "<|end|>\nb", "a<|end|>", "<|end|><|end|>", "c <|end|> d", "<|start|>", "<\\|end|>", "<|end", "<|other|>", "<", "<|end|", "\\", "a\\nb", "<\\p", "\\\\", "x\ny", ""]


def plain_escapes(role, text):
    """As they are to be written: a turn that holds a marker's opening, a newline in its role, or what escaping would undo."""
    marked = "<|" in text or re.search(r"<\\+\|", text) or "<|" in role or "\n" in role or "\\" in role
    return (role.replace("\\", "\\\\").replace("\n", "\\n").replace("<|", "<\\p"), re.sub(r"<(\\*)\|", r"<\1\\|", text)) if marked else (role, text)


def plain_parse(formatted):
    """The stated grammar, character by character."""
    out, at = [], 0
    while at < len(formatted):
        if not formatted.startswith("<|start|>", at):
            return None
        cut = formatted.find("\n", at)
        stop = formatted.find("<|end|>", at)
        if cut < 0 or stop < cut or not formatted.startswith("\n", stop + 7) or "<|start|>" in formatted[at + 9 : stop]:
            return None
        out.append((formatted[at + 9 : cut], formatted[cut + 1 : stop]))
        at = stop + 8
    return out


def test_chat_markers(spark, tmp_path):
    """Markers alone, first, last and doubled, in texts and roles: a reader that stops at the end marker sees every turn whole; query and SQL agree."""
    turns = {k: [("user", m), ("assistant", "ok " + m)] for k, m in enumerate(MARKED)} | {100 + k: [(m, "q"), ("assistant", "<|other|>")] for k, m in enumerate(MARKED)}
    rows = [(c, n, r, t) for c, own in turns.items() for n, (r, t) in enumerate(own)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for r in chat.format_chats(frame).collect():
        read = plain_parse(r.formatted)
        assert read is not None and len(read) == 2, r
        own = turns[r.conv_id]
        assert read in (own, [plain_escapes(*t) for t in own]), r
        assert [(t.role, t.text) for t in r.turns] == own
        assert all("<|end|>" not in x and "<|start|>" not in x for t in read for x in t)
    frame.write.parquet(f"{tmp_path}/conversations.parquet")
    got = queries.op8_chat_format(spark, str(tmp_path)).toPandas().sort_values("conv_id").reset_index(drop=True)
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    want = con.execute(queries.oracle_sql()["op8_chat_format"]).df()[list(got.columns)].sort_values("conv_id").reset_index(drop=True)
    assert got.astype(str).equals(want.astype(str)), got.compare(want)


@pytest.mark.parametrize("bound", [1 << 20, -1])
def test_html(spark, bound):
    body = lambda k: f"<nav>menu</nav><div class=box>Same notice</div><div class=story><h1>T{k} &amp; x</h1><p>p{k}<br>b  c<p>d{k}</div><div id=comments>bad</div><footer>f"
    pages = [(k, "http://h.example/x", body(k)) for k in range(5)] + [(8, None, None), (9, "odd", "<article class=post><header><h1>H</h1></header><p>Same<script>var t='</p>'</script> text<aside>no</aside></article>out")]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(pages, "page_id long, url string, html string"), most_broadcast=bound).collect()}
    assert all(got[k] == f"T{k} & x\np{k} b c\nd{k}" for k in range(5)) and got[8] == "" and got[9] == "H\nSame text"


def extracted(spark, pages, **how):
    rows = spark.createDataFrame([(k, "http://h.example/x", p) for k, p in enumerate(pages)], "page_id long, url string, html string")
    return [r.text for r in sorted(html.extract(rows, **how).collect(), key=lambda r: r.page_id)]


def test_html_template_in_article(spark):
    """Constant blocks within an article go; a repeated article stays."""
    copy = "<article><h1>Copy</h1><div>of one</div></article>"
    pages = [f"<article><h1>T{k}</h1><div class=x>Licence line</div><div>text {k}</div></article>" for k in range(4)]
    assert extracted(spark, pages + [copy] * 4) == [f"T{k}\ntext {k}" for k in range(4)] + ["Copy\nof one"] * 4


def test_html_shared_sentence_stays(spark):
    """A sentence that three of eight articles of a host share is content; the line on all of them is template."""
    pages = [f"<article><h1>T{k}</h1><p>start {k}</p>{'<p>The shared sentence.</p>' if k in (1, 4, 6) else ''}<p>end {k}</p><p>All rights reserved by the host</p></article>" for k in range(8)]
    want = [f"T{k}\nstart {k}\n" + ("The shared sentence.\n" if k in (1, 4, 6) else "") + f"end {k}" for k in range(8)]
    assert extracted(spark, pages) == want


def test_html_odd_first_page(spark):
    """Template nodes of layouts that the first page lacks are learnt, in any order of the pages."""
    odd = "<div class=error>Gone</div>"
    pages = [f"<div class=l{'ab'[k % 2]}><section class=same>Notice {'ab'[k % 2]}</section><section>text {k}</section></div>" for k in range(8)]
    want = ["Gone", *(f"text {k}" for k in range(8))]
    assert extracted(spark, [odd, *pages]) == want and extracted(spark, [*pages[::-1], odd]) == want[::-1]


def test_html_rare_layouts(spark):
    """A notice that only pages of a layout of their own have, in a host with three commoner layouts, is template; what is found does not depend on which layouts count as common."""
    common = [f"<section class=l{'abc'[k % 3]}><p>text {k}</p><p>more {k}</p></section>" for k in range(12)]
    rare = [f"<div class=own><p>Notice of rare pages</p><p>rare {k}</p></div><div class={x}><b>{x} {k}</b></div>" for k, x in enumerate("defghi")]
    want = [f"text {k}\nmore {k}" for k in range(12)] + [f"rare {k}\n{x} {k}" for k, x in enumerate("defghi")]
    assert extracted(spark, common + rare) == want
    assert all(extracted(spark, common + rare, layouts=n) == want for n in (0, 1, 20))


def test_html_deep_and_among_siblings(spark):
    """Constants nested deeper than 12, or among varying siblings of one label, are template."""
    deep = lambda x: "<div>" * 20 + x + "</div>" * 20
    pages = [deep(f"<p>a{k}</p><p>Share this</p>" + f"<p>b{k}</p>" * (k % 3) + "<span class=y><h6>Deep notice</h6></span>") for k in range(6)]
    assert extracted(spark, pages) == ["\n".join([f"a{k}", *[f"b{k}"] * (k % 3)]) for k in range(6)]
    assert extracted(spark, ["<div>" * 3000 + f"x{k}" for k in range(4)]) == [f"x{k}" for k in range(4)]


def test_html_place_decides(spark):
    """One text on every page, but below other headings each time, is content; the headings, each at its place, are template. Counts of texts can't tell them apart."""
    page = lambda k: "<article>" + "".join(f"<h2>Part {x}</h2><p>{'As before.' if k % 3 == n else f'text {k} {x}'}</p>" for n, x in enumerate("ABC")) + "</article>"
    want = ["\n".join("As before." if k % 3 == n else f"text {k} {x}" for n, x in enumerate("ABC")) for k in range(9)]
    assert extracted(spark, [page(k) for k in range(9)]) == want


def test_tree_matching():
    """The weight of an alignment is the greatest of all, found by trying every one, on small random trees."""
    rng = np.random.default_rng(5)

    def some():
        parents = [-1, *(int(rng.integers(0, k)) for k in range(1, int(rng.integers(2, 9))))]
        inner = set(parents)
        return json.dumps([["", *("ab"[rng.integers(0, 2)] for _ in parents[1:])], parents, [0 if k in inner else int(rng.integers(1, 3)) for k in range(len(parents))]])

    def greatest(a, b, x, y):
        if a.codes[x] != b.codes[y]:
            return 0
        if a.texts[x] or b.texts[y]:
            return html.EQUAL if a.texts[x] == b.texts[y] else 1

        def lists(p, q):
            if not p or not q:
                return 0
            return max(lists(p[1:], q), lists(p, q[1:]), greatest(a, b, p[0], q[0]) + lists(p[1:], q[1:]) if greatest(a, b, p[0], q[0]) else 0)

        return 1 + lists(a.kids[x], b.kids[y])

    for _ in range(300):
        a, b = html.Tree(some()), html.Tree(some())
        got = html.alignment(a, b)
        up = dict(got)
        assert len(up) == len(set(up.values())) == len(got) and all(up[a.parents[x]] == b.parents[y] for x, y in got if x)
        assert sum(html.EQUAL if a.texts[x] and a.texts[x] == b.texts[y] else 1 for x, y in got) == greatest(a, b, 0, 0)


def test_mixing(docs):
    rows = docs.collect()
    got = mixing.mix(docs).collect()
    size = Counter()
    for r in rows:
        size[r.source] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    names = sorted((s for s in size if s is not None)) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, total, free = {}, 1.5 * sum(size.values()), set(names)
    while free:
        share = {s: total * weight[s] / sum(weight[f] for f in free) for s in free}
        over = {s for s in free if share[s] > 2 * size[s]}
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 2 * size[s]
            total -= 2 * size[s]
        free -= over
    assert all(abs(r.mix_target - target[r.source]) < 1e-6 and 0 <= r.mix_copies <= 2 for r in got) and len(got) == len(rows)
    emitted = mixing.emitted(docs)
    assert emitted.columns == [*docs.columns, "copy"] and emitted.count() == sum(r.mix_copies for r in got)
    assert mixing.mix(docs.limit(0)).count() == 0


def test_clashing_columns(spark):
    """Helper columns never take the place of a caller's; columns that an operator adds do."""
    names = ["_id", "_keys", "_kept", "_source", "Source_", "sig", "mix_size", "copy", "line_n_removed"]
    rows = [(k, f"line of {k}\nshared line here", f"s{k % 6}", *[f"{n}{k}" for n in names]) for k in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"`{n}` string" for n in names))
    own = {r.doc_id: r for r in line_dedup.drop_boilerplate(docs).collect()}
    assert sum(r.line_n_removed for r in own.values()) == 11 and all(r[n] == f"{n}{k}" for k, r in own.items() for n in names[:-1])
    mixed = mixing.emitted(docs)
    assert mixed.columns.count("copy") == 1 and "mix_size" not in mixed.columns
    assert all(r.copy >= 1 and r["_source"] == f"_source{r.doc_id}" and r["_id"] == f"_id{r.doc_id}" for r in mixed.collect())


def test_empty_tables(spark):
    none = lambda schema: spark.createDataFrame([], schema)
    assert pii.report(pii.extract(none("doc_id long, text string"))).count() == 0
    assert ann.nearest(none("vec_id long, embedding array<float>")).count() == 0
    assert chat.read_back(chat.format_chats(none("conv_id long, turn long, role string, text string"))).count() == 0
    assert html.extract(none("page_id long, url string, html string")).count() == 0
    docs, bench = none("doc_id long, text string"), none("item_id long, text string")
    assert decontam.contamination(docs, bench).count() == 0 and decontam.clean(docs, bench).count() == 0


def test_repeats_and_extra_columns(spark):
    """Repeated rows get the same result each time; columns with names that operators use inside do no harm."""
    docs = spark.createDataFrame([(1, "mail a@b.com", "x", 0, "y")] * 2 + [(2, "w " * 40000 + "c@d.org", "x", 0, "y")], "doc_id long, text string, base string, row int, pattern string")
    got = sorted((r.doc_id, r.spans) for r in pii.report(pii.extract(docs)).collect())
    assert got == [(1, "email:5:12")] * 2 + [(2, "email:80000:80007")]
    vectors = spark.createDataFrame([(k % 5, [float(k % 5), 1.0], 3, "s") for k in range(10)], "vec_id long, embedding array<double>, dim int, shard string")
    near = ann.nearest(vectors).where("query_id = 0").orderBy("rank").collect()
    assert [(r.rank, r.vec_id, r.score) for r in near] == [(k, k, float(k)) for k in range(1, 5)]
    turns = spark.createDataFrame([(1, 0, "user", "q" * 50000, "c"), (1, 1, "assistant", "<|end|>" * 3000, "c")], "conv_id long, turn long, role string, text string, formatted string")
    assert chat.read_back(chat.format_chats(turns)).first().loss_chars == 21000
    page = (1, "http://h/x", "<article><p>" + "long text " * 5000 + "</p></article>", "t")
    pages = spark.createDataFrame([page, page], "page_id long, url string, html string, text string")
    assert [r.text for r in html.extract(pages).collect()] == [("long text " * 5000).strip()] * 2


def test_patterns_beyond_matches(spark):
    """A context goes back as many words as it needs, however long, and across an earlier match."""
    word = "v" * 80
    texts = [f"{word} key of {k} = {hashlib.sha1(str(k).encode()).hexdigest()}" for k in range(6)] + [f"{word} key of 9 = unseen-12345"]
    got = {r.doc_id: r.spans for r in pii.report(pii.extract(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))).collect()}
    assert got[6] == "id:92:104"


def plain_spans(t):
    """Base spans by a plain reading of the contract."""
    found = {"email": [], "ip": [], "card": [], "phone": []}
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t):
        found["email"].append(m.span())
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(x) <= 255 for x in m[0].split(".")):
            found["ip"].append(m.span())
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(x) for x in m[0] if x.isdigit()][::-1]
        if 16 <= len(d) <= 19 and sum(x if k % 2 == 0 else 2 * x - 9 * (x > 4) for k, x in enumerate(d)) % 10 == 0:
            found["card"].append(m.span())
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 8 <= sum(x.isdigit() for x in m[0]) <= 15:
            found["phone"].append(m.span())
    return found


def test_pii_plain(spark):
    """Base spans of random texts of the signs that matter, against a plain reading."""
    rng = np.random.default_rng(4)
    bits = ["a@b.co", "x.y@z", "@", "1.2.3.4", "256.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (017) 555-7713", "+12", " ", ".", "-", "0", "77", "é", "😀", "a", ",", "\n"]
    texts = ["".join(rng.choice(bits, int(rng.integers(1, 14)))) for _ in range(400)]
    got = {r.doc_id: r for r in pii.report(pii.extract(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))).collect()}
    for k, t in enumerate(texts):
        want = plain_spans(t)
        written = ",".join(f"{kind}:{a}:{b}" for kind, spans in want.items() for a, b in spans)
        assert [got[k].n_email, got[k].n_ip, got[k].n_card, got[k].n_phone] == [len(x) for x in want.values()], t
        assert got[k].base_sha256 == hashlib.sha256(written.encode()).hexdigest(), t
