"""Odd inputs, large values, and every registered query of the subpackage on small tables."""

import collections
import fractions
import gzip
import math
import time

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from censorium.llm import jaccard_join, language_id, metric_topk, queries, warc, wrapper

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.sql(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    got, want = queries.queries()[name](spark, SMALL).toPandas(), con.sql(queries.oracle_sql()[name]).df()
    cols = sorted(got.columns)
    order = lambda d: d[cols].sort_values(cols).reset_index(drop=True)
    pd.testing.assert_frame_equal(order(got), order(want), check_dtype=False)


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    """A few documents and pages, and the same tables empty."""
    out = []
    for n in (1, 0):
        folder = tmp_path_factory.mktemp("tables")
        docs = [(1, "the quick brown fox jumps over the lazy dog " * 4, "en", "s", 176), (2, None, None, "s", 0), (3, "", "en", "s", 0), (4, "o rato roeu a roupa do rei de roma " * 4, "pt", "t", 140), (5, "The quick brown fox jumps over the lazy dog " * 4, "en", "s", 176)] * n
        spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(1, "http://a/x", "<p>one</p>"), (2, None, None)] * n, "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
        spark.createDataFrame([(50, [1.0, 2.0], 0), (1, [0.5, 0.5], 0), (2, None, 0)] * n, "vec_id long, embedding array<float>, label int").write.parquet(f"{folder}/embeddings.parquet")
        out.append(str(folder))
    return out


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_every_query_runs(spark, folders, name):
    run = queries.queries()[name]
    full = run(spark, folders[0])
    rows = {"op2_metric_topk": 1, "op4_main_text": 2, "op9_warc": 2}.get(name, 4 if name == "op10_packing" else 5)
    assert full.count() >= rows
    assert run(spark, folders[1]).count() == 0


def test_exact_scores_of_large_components(spark):
    rng = np.random.default_rng(4)
    x = np.floor(rng.normal(0, 1e6, (200, 8)) * 8) / 8
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(900, [1e300] * 8), (901, [1e7] * 8), (902, [float("inf")] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in metric_topk.top_k(df, df.where("vec_id % 50 = 0")).collect()}
    whole = [[int(np.floor(v * 256)) for v in r] for r in x]
    assert len(got) == 20
    for q in (0, 50, 100, 150):
        best = sorted(((-sum(a * b for a, b in zip(whole[q], whole[i], strict=True)), i) for i in range(200) if i != q))[:5]
        assert [got[q, k + 1] for k in range(5)] == [(i, -s) for s, i in best]


def test_deep_and_broken_pages(spark):
    pages = ["<div>" * 5000 + "deep" + "</div>" * 5000, "<div>" * 1500 + "open", "<a " * 20_000, "<p title=\"x>one</p>" * 2000, "</b>" * 20_000 + "<b>" * 20_000 + "x", "a < b <3 c", "<<<<p>two</p>", "", "<"]
    began = time.time()
    rows = spark.createDataFrame([(i, "http://h/", h) for i, h in enumerate(pages)], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in wrapper.main_text(rows).collect()}
    assert time.time() - began < 120
    assert got[0] == "deep" and got[1] == "open" and got[5] == "a < b <3 c" and "two" in got[6] and got[7] == ""
    began = time.time()
    wrapper.parse("<a " * 200_000)
    wrapper.parse("<p title=\"x>" * 100_000)
    assert time.time() - began < 20


def test_many_classes_are_told_apart():
    a, b = (wrapper.parse(f'<p class="a b c d {x}">t</p>').inside[0] for x in ("e", "f"))
    assert a.key != b.key


def test_more_than_two_hundred_languages():
    rng = np.random.default_rng(6)
    letters = "abcdefghijklmnopqrstuvwxyz"
    names, x, y = [f"l{i}" for i in range(250)], [], []
    for k in range(250):
        parts = ["".join(rng.choice(list(letters), 3)) for _ in range(4)]
        for _ in range(30):
            f = language_id.features(" ".join("".join(rng.choice(parts, 2)) for _ in range(30)))
            at = np.flatnonzero(f)
            x.append((at.astype("<u2"), f[at].astype("<f2")))
            y.append(k)
    sparse = language_id.SparseRows([a for a, _ in x], [v for _, v in x])
    model = language_id.train(sparse, np.array(y), np.ones(len(y), dtype=bool), names)
    best = np.concatenate([model.probabilities(sparse[np.arange(a, a + 500)]).argmax(axis=1) for a in range(0, len(y), 500)])
    assert len(model.languages) == 250 and (best == np.array(y)).mean() > 0.9


def test_archives_of_others(spark, tmp_path):
    """Compressed archives, headers in other case and without blanks, continued lines; an empty table; errors that say what is wrong."""
    warc.register(spark)
    one = b"WARC/1.0\r\nwarc-type:response\r\nWARC-Target-URI:  http://a/\r\n  b\r\ncontent-length:5\r\n\r\nhello\r\n\r\n"
    two = b"WARC/1.0\r\nWARC-Type: request\r\nContent-Length: 70000\r\n\r\n" + b"x" * 70_000 + b"\r\n\r\n"
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.warc.gz").write_bytes(gzip.compress(one) + gzip.compress(two) + gzip.compress(one))
    (tmp_path / "in" / "b.warc").write_bytes(one + two)
    (tmp_path / "in" / "c.warc").write_bytes(b"")
    rows = spark.read.format("warc").load(f"file://{tmp_path}/in").collect()
    assert sorted(len(r["payload"]) for r in rows) == [5, 5, 5, 70000, 70000]
    assert {r["uri"] for r in rows if r["record_type"] == "response"} == {"http://a/ b"}
    assert spark.read.format("warc").load(f"file://{tmp_path}/in").where("record_type = 'response'").count() == 3
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "a.warc").write_bytes(b"WARC/1.0\r\nWARC-Type: response\r\n\r\nhello")
    with pytest.raises(Exception, match="Content-Length"):
        spark.read.format("warc").load(f"file://{tmp_path}/bad").collect()
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    warc.page_records(empty).write.format("warc").mode("append").save(f"file://{tmp_path}/empty")
    assert spark.read.format("warc").load(f"file://{tmp_path}/empty").count() == 0
    raw = warc.record({"record_type": "revisit", "uri": "a\r\nb"})
    assert b"WARC-Profile: http" in raw and b"a%0D%0Ab" in raw


def test_open_long_lists_go_by_blocks(spark, monkeypatch):
    """Unlike sets of many sizes that share a passage, among them near copies: long lists are cut into blocks, links are those of all pairs."""
    for name, value in (("BLOCK", 4), ("PIVOTS", 1), ("PART", 6)):
        monkeypatch.setattr(jaccard_join, name, value)
    rng = np.random.default_rng(12)
    word = lambda n: " ".join(f"w{v}" for v in rng.integers(0, 10**6, n))
    passage, texts = word(30), []
    for i in range(60):
        own = word(4 + i % 9)
        texts += [f"{passage} {own}"] + ([f"{passage} {own} more"] if i % 4 == 0 else [])
    sets = []
    for t in texts:
        w = t.split()
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)})
    root = list(range(len(texts)))
    find = lambda v: v if root[v] == v else find(root[v])
    for a in range(len(texts)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.similar_components(df).collect()}
    assert got == {i: find(i) for i in range(len(texts))}
    assert 1 < len(set(got.values())) < len(texts)


def test_null_ids(spark):
    """Rows without an id stay rows; they name a component only if nothing else can."""
    df = spark.createDataFrame([(None, "a b c d e f g"), (None, "a b c d e f g"), (4, "a b c d e f g"), (None, None)], "doc_id long, text string")
    got = sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in jaccard_join.similar_components(df).collect())
    assert got == [("4", 3, "4"), ("None", 0, "None"), ("None", 3, "4"), ("None", 3, "4")]
    assert df.select(F.col("doc_id")).count() == 4


def test_every_finite_vector_takes_part(spark):
    """Vectors of any size, on both sides, against whole numbers without bounds; pairs whose score fits no long are left out."""
    rng = np.random.default_rng(9)
    data = [(i, [float(x) for x in rng.normal(size=2).round(2)]) for i in range(120)] + [(500, [1.0, 2.0]), (501, [9e6, 1.0]), (501, [9e6, 1.0]), (502, [1e306, 0.0]), (503, [0.0, -3e17]), (550, [4e6, -8e6]), (600, [0.0, 1e300])]
    data += [(700, [1.0, float("nan")]), (701, None), (None, [1.0, 1.0]), (702, [])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    got = collections.defaultdict(list)
    for r in metric_topk.top_k(df, df.where("vec_id % 50 = 0"), wide=True, block=2).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    whole = [(i, [math.floor(fractions.Fraction(x) * 256) for x in v]) for i, v in data[:127]]
    for q in (0, 50, 100, 500, 550, 600):
        v = dict(whole)[q]
        pairs = [(i, sum(a * b for a, b in zip(v, w, strict=True))) for i, w in whole if i != q]
        assert got[q] == sorted(((i, s) for i, s in pairs if -(2**63) <= s < 2**63), key=lambda x: (-x[1], x[0]))[:5]
    assert (501, 589824131072) in got[500]


def test_articles_are_whole(spark):
    """Layout names around an article, names of headings and anchors, formulas and labels, and sentences that pages share."""
    shared = "<p>Preheat the oven to 200 degrees.</p>"
    bodies = {
        "layout": "<div class='layout has-sidebar'><article><p>text {i}</p></article></div>",
        "search": "<div id='search-page'><main><article><p>text {i}</p></article></main></div>",
        "names": "<article><h2 class='section-header'>Head {i}</h2><section id='side-effects'><p>effects {i}</p></section><h3 id='comments'>On comments</h3></article>",
        "tags": "<article><p>x <math><mi>y</mi><mo>=</mo><mn>{i}</mn></math></p><label>label {i}</label> <svg><text>drawn {i}</text></svg></article>",
        "shared": "<article><h1>Recipe {i}</h1>" + shared + "<ul><li>item {i}</li></ul></article>",
        "hinted": "<article><p>text {i}</p><div class='article-footer'>Read our paper.</div><div class='comment-list'><article>me too</article></div><div class='sidebar'>side {i}</div><div class='newsletter-signup'>mail {i}</div></article>",
        "comments": "<body><div class='content'>text {i}</div><div class='comments'><article>me too {i}</article></div></body>",
        "box": "<main><div class='ad-box'>buy {i}</div><p>text {i}</p><div id='cookie-notice'>cookies {i}</div><div id='site-header'>head {i}</div></main>",
    }
    want = {
        "layout": "text {i}", "search": "text {i}", "names": "Head {i}\n\neffects {i}\n\nOn comments", "tags": "x y={i}\n\nlabel {i} drawn {i}",
        "shared": "Recipe {i}\n\nPreheat the oven to 200 degrees.\n\nitem {i}", "hinted": "text {i}", "comments": "text {i}", "box": "text {i}",
    }
    rows = [(100 * n + i, f"http://{name}.example/{i}", body.replace("{i}", str(i))) for n, (name, body) in enumerate(bodies.items()) for i in range(6)]
    got = {r["page_id"]: r["text"] for r in wrapper.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {100 * n + i: want[name].replace("{i}", str(i)) for n, name in enumerate(bodies) for i in range(6)}
