"""The operators on hand-made tables against brute force, with nulls, ties, repeats, empty tables and clashing columns."""

import base64
import collections
import hashlib
import json
import re
import unicodedata
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from censorium.llm import byte_bpe, fingerprints, jaccard_join, language_id, metric_topk, packing, suffix_dedup, token_files, warc, wrapper

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [f"{a}{b}" for a in ("ka", "lo", "mi", "né", "Tu", "ra") for b in ("bel", "dor", "fin", "gam", "hus", "jet")]


def prose(rng, n):
    return " ".join(rng.choice(WORDS, n))


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    base, passage = prose(rng, 120), prose(rng, 30)
    texts = [prose(rng, int(n)) for n in rng.integers(1, 90, 25)]
    texts += [base, base, base.replace(" ", "  "), base + " one more word", prose(rng, 40) + " " + passage, prose(rng, 50) + "\n" + passage + " end"]
    texts += [None, "", "   \t", "x", "a" * 300, "日本語のテキスト " * 12, "!!! 123", prose(rng, 3000)]
    return [(i * 3, t, "en" if i % 2 else "de", "s", len(t or "")) for i, t in enumerate(texts)] + [(0, texts[0], "de", "s", 1)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).withColumns({"kept": F.lit(1), "score": F.lit("x"), "token": F.lit(2)}).repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def test_suffix_dedup(docs, rows, empty):
    got = {(r["doc_id"], r["n_bytes"]): r for r in suffix_dedup.remove_repeats(docs, block_bytes=2000).collect()}
    seen, at_id = {}, {}
    for d, t, *_ in sorted(rows, key=lambda r: r[0]):
        raw = (t or "").encode()
        gone = np.zeros(len(raw), dtype=bool)
        for i in range(len(raw) - 49):
            if seen.setdefault(raw[i : i + 50], d) < d:
                gone[i : i + 50] = True
        left = np.frombuffer(raw, dtype=np.uint8)[~gone].tobytes()
        r = got[d, len(raw)]
        assert (r["n_removed"], r["kept_sha256"]) == (gone.sum(), hashlib.sha256(left).hexdigest())
        assert r["n_spans"] == (np.diff(np.concatenate(([0], gone.astype(int)))) > 0).sum()
    assert suffix_dedup.remove_repeats(empty).count() == 0


def test_levels_are_geometric():
    levels, seen = suffix_dedup.Levels(), set()
    rng = np.random.default_rng(0)
    for _ in range(50):
        keys = np.unique(rng.integers(0, 500, 20).astype(np.uint64))
        hit = levels.seen(keys)
        assert hit.tolist() == [int(k) in seen for k in keys]
        levels.add(keys[~hit])
        seen |= set(map(int, keys))
        sizes = [len(a) for a in levels.arrays]
        assert all(a > 2 * b for a, b in zip(sizes, sizes[1:], strict=False))


def test_equal_keys_with_other_second_hashes():
    """Keys that collide are told apart by what stands beside them, in a block and between blocks."""
    levels, seen = suffix_dedup.Levels(), set()
    rng = np.random.default_rng(1)
    for _ in range(40):
        h, e = rng.integers(0, 12, 30).astype(np.uint64), rng.integers(0, 6, 30).astype(np.uint64)
        keys, beside, of, at = suffix_dedup._distinct(h, e)
        pairs = list(zip(keys.tolist(), beside.tolist(), strict=True))
        assert len(set(pairs)) == len(pairs) == len(set(zip(h.tolist(), e.tolist(), strict=True)))
        assert (keys[of] == h).all() and (h[at] == keys).all() and (of[at] == np.arange(len(keys))).all()
        hit = levels.seen(keys, beside)
        assert hit.tolist() == [p in seen for p in pairs]
        levels.add(keys[~hit], beside[~hit])
        seen |= set(pairs)


def test_suffix_dedup_hot_gram(spark):
    """One string of fewer than 50 bytes in every document, in ever different contexts, beside repeats that go."""
    rng = np.random.default_rng(2)
    word = lambda n: "".join(rng.choice(list("abcdefgh"), n))
    hot, passage = "this common line is in all of it ", word(60)
    rows = [(i, word(40) + hot + word(40) + (passage if i % 7 == 0 else "")) for i in range(200)]
    got = {r["doc_id"]: (r["n_removed"], r["n_spans"]) for r in suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), block_bytes=1500).collect()}
    starts: dict[str, int] = {}
    for i, t in rows:
        gone = [False] * len(t)
        for k in range(len(t) - 49):
            if starts.setdefault(t[k : k + 50], i) < i:
                gone[k : k + 50] = [True] * 50
        assert got[i] == (sum(gone), sum(a and not b for a, b in zip(gone, [False, *gone], strict=False)))
    assert sum(n > 0 for n, _ in got.values()) == 28


def test_top_k(spark):
    rng = np.random.default_rng(1)
    data = [(i, [float(x) for x in rng.normal(size=6).round(2)]) for i in range(400)] + [(400 + i, [0.5] * 6) for i in range(300)]
    data += [(9000, None), (9001, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (9002, [float("nan")] * 6), (9003, [float("inf")] * 6), (9004, [1.0, 2.0])]
    table = spark.createDataFrame(data, "vec_id long, embedding array<double>").withColumn("score", F.lit("clash"))
    got = collections.defaultdict(list)
    for r in metric_topk.top_k(table, table.where("vec_id % 50 = 0")).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    fine = {i: np.floor(256 * np.array(v)).astype(int) for i, v in data[:700]}
    for q in range(0, 700, 50):
        want = sorted(((i, int(v @ fine[q])) for i, v in fine.items() if i != q), key=lambda x: (-x[1], x[0]))[:5]
        assert got[q] == want
    assert metric_topk.top_k(table.limit(0), table.limit(0)).count() == 0


def test_byte_bpe(docs, rows, empty, spark):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = byte_bpe.encode(docs, ranks_path=path).withColumn("bytes", byte_bpe.decoded(F.col("ids"), path)).collect()
    assert sorted((r["doc_id"], r["ids"], bytes(r["bytes"])) for r in got) == sorted((d, own.encode_ordinary(t or ""), (t or "").encode()) for d, t, *_ in rows)
    assert byte_bpe.encode(empty, ranks_path=path).count() == 0
    for word in ("a" * 700, "né" * 200, "é日本" * 90):
        assert byte_bpe.fold_long(word.encode(), ranks) == byte_bpe.fold(word.encode(), ranks)
    words = spark.createDataFrame([(w,) for w in ["", " hello", "né", "日本語", "unbelievably"]], "word string")
    assert {r["word"]: r["ids"] for r in byte_bpe.fold_words(words, ranks_path=path).collect()} == {w[0]: byte_bpe.fold(w[0].encode(), ranks) if w[0] else [] for w in words.collect()}


def test_main_text(spark):
    page = lambda body, nav="Home", ad="Buy": f"<html><head><title>t</title><script>var a='<p>no</p>';</script></head><body><nav><a href='/'>{nav}</a></nav><div class='ad'>{ad}</div><article><h1>T&eacute;st {ad}</h1>{body}<p>Read more</p><div class='comments'><p>me too</p></div><form>f</form></article><footer>&copy; x</footer></body></html>"
    pages = [(i, "http://a.example/x", page(f"<p><b>one {i} &amp; two.<br>three<p>  four\n {i} </p>", ad=f"ad{i}")) for i in range(8)]
    pages += [(100, None, None), (101, "bad", ""), (102, "http://b.example", "<p>only</p> text <b>here"), (0, "http://a.example/x", pages[0][2])]
    table = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("host", F.lit(1))
    got = collections.Counter((r["page_id"], r["text"]) for r in wrapper.main_text(table).collect())
    want = collections.Counter((i, f"Tést ad{i}\n\none {i} & two. three\n\nfour {i}\n\nRead more") for i in [*range(8), 0])
    want.update([(100, ""), (101, ""), (102, "only\n\ntext here")])
    assert got == want
    assert wrapper.main_text(table.limit(0)).count() == 0


def test_constant_slot_is_template(spark):
    pages = [(i, "http://a.example", f"<body><div><p>Always the same words.</p></div><section>story {i}</section></body>") for i in range(6)]
    got = {r["text"] for r in wrapper.main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == {f"story {i}" for i in range(6)}


def test_template_with_deviating_pages(spark):
    """A page or two with another text keep nothing in the others, and lose nothing themselves."""
    body = lambda i: f"<body><div><p>{'Log in again.' if i % 20 == 7 else 'Always the same words.'}</p></div><section>story {i}</section></body>"
    for n in (10, 40):
        pages = spark.createDataFrame([(i, "http://a.example", body(i)) for i in range(n)], "page_id long, url string, html string")
        got = {r["page_id"]: r["text"] for r in wrapper.main_text(pages).collect()}
        assert got == {i: f"Log in again.\n\nstory {i}" if i % 20 == 7 else f"story {i}" for i in range(n)}


def test_copies_in_other_surroundings_are_no_evidence(spark):
    """Copies of one article under different menus and adverts don't make its text template."""
    page = lambda i, main: f"<body><nav>menu {i}</nav><article>{main}<aside>advert {i}</aside></article><footer>foot {i}</footer></body>"
    copy = "<h1>One story</h1><p>Its text.</p><ul><li>a point</li></ul><table><tr><td>7</td></tr></table>"
    pages = [(i, "http://copies.example", page(i, copy)) for i in range(9)] + [(20 + i, "http://mixed.example", page(i, copy if i < 9 else f"<h1>Story {i}</h1><p>text {i}</p>")) for i in range(12)]
    got = {r["page_id"]: r["text"] for r in wrapper.main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    whole = "One story\n\nIts text.\n\na point\n\n7"
    assert got == {i: whole for i in [*range(9), *range(20, 29)]} | {20 + i: f"Story {i}\n\ntext {i}" for i in range(9, 12)}


def test_large_trees_are_aligned(spark):
    """Pages with thousands of slots lose their template text as small ones do."""
    page = lambda i, n: "<body><div><p>Always the same words.</p></div><section>" + f"<h2>h {i}</h2><p>p {i}</p><ul><li>l {i}</li></ul>" * n + "</section></body>"
    for sizes in ([2] * 4 + [900] * 4, [900 + i for i in range(8)]):
        pages = spark.createDataFrame([(i, "http://a.example", page(i, n)) for i, n in enumerate(sizes)], "page_id long, url string, html string")
        got = {r["page_id"]: r["text"] for r in wrapper.main_text(pages).collect()}
        assert got == {i: "\n\n".join([f"h {i}\n\np {i}\n\nl {i}"] * n) for i, n in enumerate(sizes)}


def test_aligned_is_a_largest_match():
    rng = np.random.default_rng(8)
    tree = lambda depth: [str(rng.choice(["a", "b", "c"])), True, [tree(depth - 1) for _ in range(rng.integers(0, 5))] if depth else []]
    order = lambda t: [t, *(x for c in t[2] for x in order(c))]

    def best(a, b):
        if a[0] != b[0]:
            return 0
        rows = [[0] * (len(b[2]) + 1)]
        for x in a[2]:
            rows.append([0])
            for j, y in enumerate(b[2]):
                rows[-1].append(max(rows[-2][j + 1], rows[-1][j], rows[-2][j] + best(x, y)))
        return 1 + rows[-1][-1]

    for _ in range(300):
        a, b = ["r", True, [tree(2) for _ in range(rng.integers(0, 9))]], ["r", True, [tree(2) for _ in range(rng.integers(0, 9))]]
        at = wrapper.aligned(json.dumps(a), json.dumps(b)).tolist()
        pairs = [(i, j) for j, i in enumerate(at) if i >= 0]
        assert len(pairs) == best(a, b) and pairs == sorted(pairs) and len({i for i, _ in pairs}) == len(pairs)
        parents = [{id(c): id(t) for t in order(x) for c in t[2]} for x in (a, b)]
        x, y = order(a), order(b)
        couples = {(id(x[i]), id(y[j])) for i, j in pairs}
        assert all(x[i][0] == y[j][0] and (j == 0 or (parents[0][id(x[i])], parents[1][id(y[j])]) in couples) for i, j in pairs)


def test_fingerprints(spark, docs, rows, empty):
    one = lambda t: " ".join(unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", t or "").casefold()).split())
    found = collections.defaultdict(set)
    for r in fingerprints.fingerprints(docs).join(spark.createDataFrame(rows, DOCS), "doc_id").collect():
        found[one(r["text"])].add(r["fingerprint"])
    assert all(len(v) == 1 for v in found.values()) and len({*map(tuple, found.values())}) == len(found)
    assert fingerprints.fingerprints(empty).count() == 0
    unique = list({r[0]: r for r in rows}.values())
    got = {r["doc_id"]: r for r in fingerprints.with_edited(spark.createDataFrame(unique, DOCS)).collect()}
    order = sorted(unique)
    for (d, t, *_), (_, u, *_) in zip(order, [*order[1:], order[0]], strict=True):
        new = fingerprints.edited(t or "", u or "")
        assert (got[d]["edited_sha256"], got[d]["near_edited"], got[d]["near_next"]) == (hashlib.sha256(new.encode()).hexdigest(), float(one(new) == one(t)), float(one(t) == one(u)))
    pairs = spark.createDataFrame([("b", b"1"), ("b", b"2"), ("c", b"1")], "bucket string, digest binary")
    apart = fingerprints.numbered(pairs, "bucket", "digest", "f", fingerprints.numbers(pairs, pairs.select("bucket").limit(0))).collect()
    assert sorted(r["f"] for r in apart) == ["b", "b-1", "c"]


def test_token_files_and_packing(spark, docs, rows, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    ids = sorted((d, tok.encode(t or "", add_special_tokens=False).ids) for d, t, *_ in rows)
    token_files.write_tokens(docs, str(tmp_path / "t"), tokenizer=path)
    got = sorted(((r["doc_id"], r["start"], r["n_tokens"]) for r in token_files.token_offsets(spark, str(tmp_path / "t")).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == [d for d, _ in ids] and got[-1][1] + got[-1][2] == sum(len(i) + 1 for _, i in ids)
    back = sorted((r["doc_id"], r["ids"]) for r in token_files.read_tokens(spark, str(tmp_path / "t")).collect())
    assert back == [(d, [*i, 2]) for d, i in ids]
    pieces = packing.pack_documents(docs.dropDuplicates(["doc_id"]), tokenizer=path, max_tokens=64, max_segments=3, with_ids=True).collect()
    whole, bins = collections.defaultdict(dict), collections.defaultdict(list)
    for p in pieces:
        whole[p["doc_id"]][p["start"]] = p["ids"]
        bins[p["sequence_id"]].append(p)
        assert zlib.crc32(np.array(p["ids"], dtype="<u4").tobytes()) == p["ids_crc32"]
    assert {d: [i for s in sorted(v) for i in v[s]] for d, v in whole.items()} == {d: [*i, 1] for d, i in ids}
    for b in bins.values():
        b.sort(key=lambda p: p["offset"])
        assert [p["offset"] for p in b] == [sum(q["length"] for q in b[:i]) for i in range(len(b))]
        n = sum(p["length"] for p in b)
        assert n <= 64 and len(b) <= 3 and n & (n - 1) == 0


def test_packing_limits_loss(spark):
    data = [(i, list(range(10 + i)), [j % 2 for j in range(10 + i)]) for i in range(20)]
    table = spark.createDataFrame([*data, (99, None, None), (98, [], [])], "k long, ids array<int>, loss array<int>")
    with pytest.raises(Exception, match="longer than a sequence"):
        packing.pack_tokens(table, id_col="k", loss_col="loss", max_tokens=40, max_segments=4, max_loss=12, cut=False).collect()
    got = packing.pack_tokens(table, id_col="k", loss_col="loss", max_tokens=40, max_segments=4, max_loss=15, cut=False).collect()
    sums = collections.Counter()
    for p in got:
        assert p["length"] == p["doc_tokens"]
        sums[p["sequence_id"]] += sum(data[p["k"]][2])
    assert len(got) == 20 and max(sums.values()) <= 15


def test_language_id(spark, rows):
    rng = np.random.default_rng(5)
    make = lambda parts: " ".join("".join(rng.choice(parts, 3)) for _ in range(30))
    data = [(i, make(["the", "ing", "wh"]) if i % 2 else make(["ção", "ñe", "ja"]), "xx" if i % 2 else "yy") for i in range(300)] + [(900, None, "xx"), (901, "12 !?", None), (902, "", "yy")]
    table = spark.createDataFrame(data, "doc_id long, text string, lang string").withColumn("rejected", F.lit(5))
    model = language_id.fit(table.where(~language_id.held_out()))
    got = {r["doc_id"]: r for r in language_id.predict(table, model).collect()}
    assert sum(got[d]["lang_pred"] == lang for d, _, lang in data[:300]) >= 298
    assert all(got[d]["lang_pred"] == "und" and got[d]["score"] == 0 and got[d]["rejected"] for d in (900, 901, 902))
    nothing = language_id.fit(table.limit(0))
    assert {r["lang_pred"] for r in language_id.predict(table, nothing).collect()} == {"und"}


def links(rows):
    word = re.compile(r"[^\x20\x09-\x0D]+")
    sets = []
    for _, t, *_ in rows:
        w = word.findall((t or "").translate({i: i + 32 for i in range(65, 91)}))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return collections.Counter((rows[i][0], len(sets[i]), min(rows[j][0] for j in range(len(rows)) if root[j] == root[i])) for i in range(len(rows)))


def test_jaccard_join(spark, docs, rows, empty):
    assert collections.Counter(tuple(r) for r in jaccard_join.similar_components(docs).collect()) == links(rows)
    assert jaccard_join.similar_components(empty).count() == 0
    rng = np.random.default_rng(9)
    base = rng.choice(WORDS, 200)
    many = [(i, " ".join(np.where(rng.random(200) < 0.02, "x%d" % i, base))) for i in range(330)]
    table = spark.createDataFrame(many, "doc_id long, text string")
    assert collections.Counter(tuple(r) for r in jaccard_join.similar_components(table).collect()) == links(many)


def test_jaccard_join_long_lists(spark, monkeypatch):
    """Lists longer than a block, of sets that are alike, nearly alike and unlike, over several rounds and parts."""
    for name, value in {"BLOCK": 6, "PIVOTS": 2, "PART": 4}.items():
        monkeypatch.setattr(jaccard_join, name, value)
    rng = np.random.default_rng(21)
    passage, tails = prose(rng, 50), [prose(rng, int(n)) for n in rng.integers(2, 9, 12)]
    rows = [(i, " ".join((tails[i % 12], passage, tails[i % 11], "z%d" % (i % 7)))) for i in range(80)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    assert collections.Counter(tuple(r) for r in jaccard_join.similar_components(table).collect()) == links(rows)


def test_jaccard_join_collects_no_classes(docs, rows, monkeypatch):
    """Only single rows of totals come to the driver."""
    kind, sizes = type(docs), []
    with monkeypatch.context() as m:
        m.setattr(kind, "collect", lambda self, f=kind.collect: [sizes.append(len(out := f(self))), out][1])
        found = jaccard_join.similar_components(docs)
    assert max(sizes, default=0) <= 1
    assert collections.Counter(tuple(r) for r in found.collect()) == links(rows)


def test_warc(spark, tmp_path):
    big, other = "<p>é" + "x" * 1200, "y" * 2000
    pages = [(1, "u1", big), (5, "u\n5", big), (3, None, big), (4, "u4", other), (7, "u7", None), (8, "u8", "s"), (9, "u9", "s"), (10, "", "WARC/1.1\r\n\r\nhello")]
    warc.register(spark)
    path = f"file://{tmp_path}/w"
    warc.page_records(spark.createDataFrame(pages, "page_id long, url string, html string")).write.format("warc").mode("append").save(path)
    rows = {r["record_id"]: r for r in spark.read.format("warc").load(path).collect()}
    assert len(rows) == 8
    for i, _, h in pages:
        r, raw = rows[f"<urn:page:{i}>"], (h or "").encode()
        assert (r["payload_bytes"], r["payload_digest"]) == (len(raw), "sha1:" + hashlib.sha1(raw).hexdigest())
        assert r["record_type"] == ("revisit" if i in (1, 3) else "response") and r["refers_to"] == ("<urn:page:5>" if i in (1, 3) else None)
        assert bytes(r["payload"]) == (b"" if i in (1, 3) else raw)
    heads = spark.read.format("warc").schema("record_id string, record_type string").load(path).where("record_type = 'revisit'")
    assert {r["record_id"] for r in heads.collect()} == {"<urn:page:1>", "<urn:page:3>"}


def test_pipeline(spark, rows):
    found = spark.createDataFrame(list({r[0]: r for r in rows}.values()), DOCS)
    for name, stage in corpus_pipeline.STAGES[1:-1]:
        before = {r["doc_id"]: r["text"] for r in found.collect()}
        found = stage(spark, found, "")
        assert found.columns == list(corpus_pipeline.COLUMNS)
        after = {r["doc_id"]: r["text"] for r in found.collect()}
        if name == "jaccard_join":
            assert set(after) == {k[2] for k in links([(d, t) for d, t in before.items()])} and all(before[d] == t for d, t in after.items())


def test_pipeline_keeps_one_row_of_a_component(spark, rows):
    """Repeated rows, rows with one doc_id and null ids: one row of each component, the smallest id first, null last."""
    rng = np.random.default_rng(31)
    a, b, c, d = (prose(rng, 60) for _ in range(4))
    data = [(7, a), (7, a), (7, a + " more"), (9, a), (None, a), (None, b), (None, b), (None, b + " more"), (5, c), (5, d), (3, None), (4, "!!!"), (4, "!!!"), (None, ""), (11, "\t")]
    table = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in data], DOCS).repartition(3)
    got = collections.Counter((r["doc_id"], r["text"]) for r in corpus_pipeline.jaccard_join(spark, table, "").collect())
    # ties of one id, or of none, are settled by hash
    first = {x for x in got if x[1] and x[1].startswith((a, b))}
    assert len(first) == 2 and any(x in first for x in ((7, a), (7, a + " more"))) and any(x in first for x in ((None, b), (None, b + " more")))
    assert got == collections.Counter([*first, (5, c), (5, d), (3, None), (4, "!!!"), (None, ""), (11, "\t")])


def test_pipeline_run(spark, tmp_path):
    """run() against each stage by brute force, with repeated rows and null ids."""
    rng = np.random.default_rng(33)
    make = lambda parts, n: " ".join("".join(rng.choice(parts, 3)) for _ in range(n))
    kinds = {"xx": ["the", "ing", "wh", "or"], "yy": ["ção", "ñe", "ja", "lu"]}
    data = [(i, make(kinds[k], 40), k) for i in range(240) for k in [("xx", "yy")[i % 2]]]
    passage = make(kinds["xx"], 25)
    data += [(300 + 2 * i, make(kinds["xx"], 60) + " " + passage, "xx") for i in range(4)]
    data += [data[3]] * 3 + [(500, data[4][1], "xx"), (None, data[6][1], "xx")] + [(None, make(kinds["yy"], 41), "yy")] * 3 + [(600, None, "xx"), (601, "12 !", "yy")]
    table = spark.createDataFrame([(i, t, k, "s", len(t or "")) for i, t, k in data], DOCS)
    table.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    model = language_id.fit(docs.where(~language_id.held_out()))
    wanted = collections.Counter((r["doc_id"], r["text"]) for r in language_id.predict(docs, model).where("not rejected").collect())
    assert len(wanted) > 200 and collections.Counter((r["doc_id"], r["text"]) for r in corpus_pipeline.language_id(spark, docs, "").collect()) == wanted
    # texts here are alike only if they are equal
    best = {}
    for i, t in wanted:
        best[t] = min(best.get(t, (True, 0)), (i is None, i or 0))
    kept = [(None if none else i, t) for t, (none, i) in best.items()]
    assert sum(i is None for i, _ in kept) == 1
    seen, cut = {}, []
    for i, t in sorted(kept, key=lambda x: (x[0] is None, x[0])):
        raw = t.encode()
        gone = np.zeros(len(raw), dtype=bool)
        for p in range(len(raw) - 49):
            if seen.setdefault(raw[p : p + 50], i) != i:
                gone[p : p + 50] = True
        cut.append((i, np.frombuffer(raw, dtype=np.uint8)[~gone].tobytes().decode()))
    assert sum(len(t) for _, t in cut) < sum(len(t) for _, t in kept)
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    whole = collections.defaultdict(dict)
    for p in corpus_pipeline.run(spark, str(tmp_path)).collect():
        assert p["start"] not in whole[p["doc_id"]]
        whole[p["doc_id"]][p["start"]] = p["ids"]
    assert {i: [x for q in sorted(v) for x in v[q]] for i, v in whole.items()} == {i: [*tok.encode(t, add_special_tokens=False).ids, 1] for i, t in cut}


def test_buckets_of_anchors_are_even():
    rng = np.random.default_rng(5)
    data = bytes(rng.integers(97, 123, 400_000).astype(np.uint8))
    block = suffix_dedup.Block(np.array([1]), np.array([len(data)]), data, 50, 4)
    block.anchors()
    keys, _ = block.grams()
    shares = np.diff(suffix_dedup._split(keys, 4, 36))
    assert shares.max() < 1.2 * shares.mean()
