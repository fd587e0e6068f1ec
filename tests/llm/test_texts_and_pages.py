"""SentencePiece, toxicity, personal data, URLs, pages, archives: against brute force and on odd rows."""

from __future__ import annotations

import hashlib
import itertools
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from corpus_fixtures import no_docs, odd_docs  # noqa: F401

from vendaflux.llm import html_extract, pii, sentencepiece_lattice, toxicity, url_filter, warc
from vendaflux.llm.sentencepiece_lattice import Model

PAGES = "page_id long, url string, html string, id string, digest string, type string, host string, text string"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, None, "d", "t", "h", None) for i, u, h in rows], PAGES)


# SentencePiece

@pytest.fixture(scope="module")
def bpe():
    return Model.load()


def test_ids_equal_the_library(spark, bpe, odd_docs, no_docs):
    """Brute force: op1_sentencepiece's ids, from the library."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_lattice.DEFAULT_MODEL)
    rng = np.random.default_rng(0)
    letters = list("aeinorstlhbc  \n\t.,;éß日😀▁")
    texts = ["".join(rng.choice(letters, rng.integers(1, 300))) for _ in range(60)] + ["interoperability" * 20, "  lead", "a  b", " ", "\u0000x"]
    docs = odd_docs.select("doc_id", "text", "row").unionByName(spark.createDataFrame([(100 + i, t, "r") for i, t in enumerate(texts)], "doc_id long, text string, row string"))
    got = sentencepiece_lattice.decode(sentencepiece_lattice.encode(docs, bpe), bpe).collect()
    assert len(got) == docs.count()
    for r in got:
        assert list(r.ids) == sp.encode(r.text or "")
        assert r.decoded == (r.text or "").replace("▁", " ")
    assert sentencepiece_lattice.encode(no_docs, bpe).count() == 0


def test_rare_units_come_by_join(spark, bpe, odd_docs):
    docs = odd_docs.select("doc_id", "text")
    all_ = sorted((str(r.doc_id), str(r.text), list(r.ids)) for r in sentencepiece_lattice.encode(docs, bpe).collect())
    few = sorted((str(r.doc_id), str(r.text), list(r.ids)) for r in sentencepiece_lattice.encode(docs, bpe, head=5).collect())
    assert all_ == few


def test_viterbi_finds_the_best_path(spark):
    pieces = {"▁": (3, -2.0), "a": (4, -1.5), "b": (5, -1.7), "ab": (6, -2.0), "ba": (7, -2.9), "aba": (8, -3.1), "▁ab": (9, -3.5), "bb": (10, -2.2)}
    model = Model(pieces, [], 0, bpe=False, names=["<unk>", "<s>", "</s>", "▁", "a", "b", "ab", "ba", "aba", "▁ab", "bb"])
    texts = ["".join(t) for n in range(1, 6) for t in itertools.product("abc", repeat=n)][:200]
    got = sentencepiece_lattice.encode(spark.createDataFrame([(t,) for t in texts], "text string"), model).collect()
    score = {i: s for i, s in pieces.values()} | {0: -3.1 - 10.0 - 0.4}
    worst = {i: s for i, s in pieces.values()} | {0: min(s for _, s in pieces.values()) - sentencepiece_lattice.UNKNOWN_PENALTY}
    assert score

    def best(u):
        ways = {0: 0.0}
        for e in range(1, len(u) + 1):
            ways[e] = max([ways[s] + pieces[u[s:e]][1] for s in range(e) if u[s:e] in pieces] + ([ways[e - 1] + worst[0]] if u[e - 1] not in pieces else []))
        return ways[len(u)]

    for r in got:
        assert sum(worst[i] for i in r.ids) == pytest.approx(best("▁" + r.text))
        long_ = sentencepiece_lattice.plain_ids("▁" + r.text, model)
        assert sum(worst[i] for i in long_) == pytest.approx(best("▁" + r.text))


def brute_units(text, model):
    """Words begin at space marks; characters that no piece has side by side are cut apart."""
    text, pairs, out = sentencepiece_lattice.normalised(text or "", model.prefix), model.pairs(), []
    for i, c in enumerate(text):
        before = text[i - 1: i]
        if not i or before + c not in pairs or (c == "▁" and before != "▁"):
            out.append("")
        out[-1] += c
    return out


def odd_texts():
    rng = np.random.default_rng(1)
    letters = list("aeinorstlhbc  \n\t.,;éß日😀▁\u0000")
    return ["", None, " ", "  lead", "a  b ", "▁x▁▁ y"] + ["".join(rng.choice(letters, rng.integers(0, 60))) for _ in range(200)] + [None, ""]


def test_units_of_many_texts_are_cut_at_once(bpe):
    """All characters of a slice are cut together, as word by word would."""
    spans = Model({"▁": (0, 0.0), "ab": (1, 0.0), "b▁": (2, -1.0), "▁a": (3, -2.0)}, [], 0, bpe=True)  # a piece across words
    texts = odd_texts() + ["ab ab  ab"]
    for model in (bpe, spans, Model(spans.pieces, [], 0, bpe=True, prefix=False)):
        units, bounds = sentencepiece_lattice.Cutter(model.pairs(), model.prefix)(texts)
        units = units.to_pylist()
        assert [units[a:b] for a, b in zip(bounds, bounds[1:], strict=False)] == [brute_units(t, model) for t in texts]
        assert len(sentencepiece_lattice.Cutter(model.pairs(), model.prefix)(["", None])[0]) == 0


def test_slices_hold_all_rows_in_order(monkeypatch):
    monkeypatch.setattr(sentencepiece_lattice, "SLICE", 100)
    batch = pa.record_batch([pa.array(range(209)), pa.array([*odd_texts(), "long" * 100], pa.string())], ["i", "text"])
    parts = list(sentencepiece_lattice.slices(batch, 1))
    assert len(parts) > 20 and all(p.num_rows for p in parts)
    assert pa.Table.from_batches(parts).to_pylist() == batch.to_pylist()
    assert sum(p.num_rows for p in sentencepiece_lattice.slices(batch.slice(0, 0), 1)) == 0


def test_units_are_counted_whole_when_tasks_hand_them_on(spark, bpe, monkeypatch):
    monkeypatch.setattr(sentencepiece_lattice, "COUNTED", 5)
    docs = spark.createDataFrame([(t,) for t in odd_texts()], "text string").repartition(3)
    got = {r.unit: r.n for r in sentencepiece_lattice.distinct_units(docs, bpe).collect()}
    assert got == Counter(u for t in odd_texts() for u in brute_units(t, bpe))


def test_each_unit_of_a_slice_is_looked_up_once(monkeypatch):
    hash_of, hashed = sentencepiece_lattice.xxhash.xxh64_intdigest, []
    names = [b"ab", b"c", "é".encode()]
    ids = {int(h): i for i, h in enumerate(np.array([hash_of(u, 42) for u in names], np.uint64).view(np.int64))}
    hashes = np.array(sorted(ids), np.int64)
    sizes = [ids[h] + 1 for h in hashes.tolist()]  # unit i has the ids i, i, ... (i + 1 of them)
    known = sentencepiece_lattice.Dictionary(hashes, np.cumsum([0, *sizes]).astype(np.uint32), np.repeat(np.array(sizes) - 1, sizes).astype(np.uint16))
    monkeypatch.setattr(sentencepiece_lattice.xxhash, "xxh64_intdigest", lambda u, seed: hashed.append(u) or hash_of(u, seed))
    got, bounds, lost = known.get(pa.array(["é", "ab", "zz", "c", "é"] * 100))
    assert got.tolist() == [2, 2, 2, 0, -1, 1, 1, 2, 2, 2] * 100
    assert bounds[:6].tolist() == [0, 3, 4, 5, 7, 10] and lost.tolist() == [False, False, True, False, False] * 100
    assert len(hashed) == 4
    none = sentencepiece_lattice.Dictionary(hashes[:0], np.zeros(1, np.uint32), np.zeros(0, np.uint16))
    assert [x.tolist() for x in none.get(pa.array(["é", "ab"]))] == [[-1, -1], [0, 1, 2], [True, True]]


def test_texts_that_do_not_come_back_are_told(spark):
    pieces = {"▁": (1, -2.0), "a": (2, -1.5), "b": (3, -1.7), "ab": (4, -2.0)}
    model = Model(pieces, [], 0, bpe=False, names=["<unk>", "▁", "a", "b", "ab"])
    docs = spark.createDataFrame([(t,) for t in ["ab a", "abc", "", None, " ", "▁a", " ⁇ "]], "text string").coalesce(1)
    for head in (100, 2):
        got = {r.text: r.back for r in sentencepiece_lattice.encode(docs, model, head=head, round_trip="back").where("text is not null").collect()}
        assert got == {"ab a": True, "abc": False, "": True, " ": True, "▁a": True, " ⁇ ": False}
    assert sentencepiece_lattice.encode(docs, model, round_trip="back").where("text is null").first().back


# toxicity

def test_toxic_documents_and_sentences_are_found(spark):
    rng = np.random.default_rng(4)
    words, bad = [f"{a}{b}{c}o" for a in "bdfg" for b in "aeiou" for c in "lmnr"], ["grumpf", "zorkel", "blaxity"]

    def text(toxic):
        said = [[str(w) for w in rng.choice(words, 8)] for _ in range(rng.integers(1, 9))]
        if toxic:
            for _ in range(2):
                said[rng.integers(len(said))][3] = str(rng.choice(bad)) + str(rng.choice(["", "s", "en"]))
        return ". ".join(" ".join(s) for s in said) + "."

    rows = [(i, text(i % 6 == 0), int(i % 6 == 0)) for i in range(1500)]
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows], "doc_id long, text string, label string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(0, None), (None, 1), (10**6, 1)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score_documents(docs, labels).collect()}
    held = [(got[i].predicted, y) for i, _, y in rows if got[i].held_out]
    assert len(held) > 200 and sum(p == y for p, y in held) / len(held) > 0.97
    model = toxicity.train(docs, labels)
    blamed = toxicity.toxic_sentences(docs, model).collect()
    right = [r for r in blamed if re.search("grumpf|zorkel|blaxity", r.sentence)]
    assert len(right) / len(blamed) > 0.95 and all(dict(zip([i for i, _, _ in rows], [t for _, t, _ in rows], strict=True))[r.id][r.start: r.end] == r.sentence for r in blamed)


def test_toxicity_on_odd_rows(spark, odd_docs, no_docs):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = toxicity.score_documents(odd_docs, none).collect()
    assert len(got) == odd_docs.count() and {r.predicted for r in got} == {0}
    assert {r.score for r in got if not (r.text or "").strip()} == {0.0}
    assert toxicity.score_documents(no_docs, none).count() == 0
    import zlib

    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)


# personal data

def luhn(s):
    d = [int(c) for c in reversed(s)]
    return sum(d[0::2]) + sum(x * 2 - 9 * (x > 4) for x in d[1::2]) if d else 1


PLAIN = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v: True),
         ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda v: all(int(x) <= 255 for x in v.split("."))),
         ("card", r"[0-9]([\x20-]?[0-9])+", lambda v: 13 <= len(re.sub("[^0-9]", "", v)) <= 19 and luhn(re.sub("[^0-9]", "", v)) % 10 == 0),
         ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: 9 <= len(re.sub("[^0-9]", "", v)) <= 15)]


def plain_spans(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, p, ok in PLAIN for m in re.finditer(p, text or "") if ok(m[0])]


def test_graph_scores_equal_brute_force(spark):
    """Brute force: op10_pii's confidence of patterns and strings."""
    rng = np.random.default_rng(3)
    edges = {(f"v{a}", f"p{b}"): False for a, b in rng.integers(0, 15, (60, 2))}
    edges = {(v, p): v in {"v1", "v2", "v7"} for v, p in edges}
    got_p, got_v = pii.score_graph(spark.createDataFrame([(v, p, s) for (v, p), s in edges.items()], "value string, pattern string, seed boolean"))
    values = {v: float(s) for (v, _), s in edges.items()}
    for _ in range(pii.ROUNDS):
        patterns = {p: sum(values[v] for v, q in edges if q == p) / (sum(q == p for _, q in edges) + pii.SMOOTHING) for _, p in edges}
        values = {v: 1.0 if edges[v, p] else float(np.mean([patterns[q] for w, q in edges if w == v])) for v, p in edges}
    assert {r.pattern: r.confidence for r in got_p.collect()} == pytest.approx(patterns)
    assert {r.value: r.score for r in got_v.collect()} == pytest.approx(values)


def test_base_spans_equal_the_expressions(spark, odd_docs, no_docs):
    rng = np.random.default_rng(6)
    bits = ["a@b.co", "x_y@c.d.e", "@", ".", "..", "-", " ", "+1", "(0)", "10.0.0.256", "1.2.3.4", "001.002.003.004", "é", "日", "%", "_q@r.s", "4111 1111-1111 1111",
            "4111111111111111", "+49 (30) 123456", "7", "0", "+", "\n", "a"]
    texts = ["".join(rng.choice(bits, rng.integers(1, 14))) for _ in range(600)] + ["1 " * 9000, "9" * 20000, "a@" + "b." * 3000 + "c", "+1" * 50]
    docs = odd_docs.select("doc_id", "text", "row").unionByName(spark.createDataFrame([(1000 + i, t, "r") for i, t in enumerate(texts)], "doc_id long, text string, row string"))
    want = sorted((str(r.doc_id), hashlib.sha256(",".join(plain_spans(r.text)).encode()).hexdigest()) for r in docs.collect())
    got = pii.digest(pii.find(docs)).collect()
    assert sorted((str(r.doc_id), r.base_sha256) for r in got) == want
    assert pii.digest(pii.find(no_docs)).count() == 0
    plain = {r.doc_id: r.text for r in docs.where("doc_id >= 1000").collect()}
    for r in pii.redact(docs.where("doc_id >= 1000 AND length(text) < 200")).collect():
        assert len(r.text) == len(plain[r.doc_id]) and not [s for s in plain_spans(r.text) if s.startswith("email")]


def test_one_text_with_very_many_spans(spark):
    """50,000 addresses in one text: positions are right, and time grows with the text, not with its square."""
    import time

    text = " ".join(f"to u{i}@m.example.org or ID{i:07}" for i in range(50_000))
    start = time.time()
    got = pii.digest(pii.find(spark.createDataFrame([(1, text)], "doc_id long, text string"))).collect()[0]
    assert time.time() - start < 120
    assert got.n_email == 50_000 and got.base_sha256 == hashlib.sha256(",".join(plain_spans(text)).encode()).hexdigest()


def test_redaction_masks_what_the_method_found(spark):
    """Base spans and discovered identifiers are masked at their length; null and repeated ids keep their own text."""
    rows = [(i % 3 or None, f"please write to user{i}@mail.example.org thanks") for i in range(12)] + [(50, "please write to Q7781-XK9 thanks"), (50, "chapter 12345678 begins"), (51, None)]
    got = sorted((str(r.doc_id), r.text) for r in pii.redact(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect())
    mask = lambda t: re.sub(r"user\S+|Q7781-XK9", lambda m: "█" * len(m[0]), t or "")
    assert got == sorted((str(i), mask(t)) for i, t in rows)


def test_patterns_discover_unseen_identifiers(spark):
    rows = [(i, f"please write to user{i}@mail.example.org thanks") for i in range(12)] + [(50, "please write to Q7781-XK9 thanks"), (51, "chapter 12345678 begins"),
            (52, "chapter 99999999 begins"), (53, "we write to Q7781-XK9 thanks a lot")]
    found = {r.doc_id: [s.value for s in r.found] for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[50] == ["Q7781-XK9"] and found[53] == ["Q7781-XK9"] and not found[51] and not found[0]


# URLs

def test_hosts_paths_and_rules(spark):
    urls = {None: ("", "", None), "no scheme": ("", "", None), "http://A.Example.COM/en/x?q#f": ("a.example.com", "/en/x", "example.com/en/"),
            "https://www.example.com/en/": ("www.example.com", "/en/", "www.example.com/en/"), "http://example.com": ("example.com", "", None),
            "http://b.com/": ("b.com", "/", "com/"), "http://xcom/": ("xcom", "/", None), "ftp://a.net/es/?x://y": ("a.net", "/es/", "net/es/"),
            "http://É.net/fr/": ("É.net", "/fr/", "net/fr/"), "http://a.org/x://b.com/": ("a.org", "/x://b.com/", None), "://h?x": ("h", "", None)}
    df = pages(spark, [(i, u, None) for i, u in enumerate(urls)])
    got = {r.page_id: r for r in url_filter.judge(df).collect()}
    for i, (host, path, rule) in enumerate(urls.values()):
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule)
        assert got[i].verdict == ("block" if rule in ("example.com/en/", "net/es/", "net/fr/") else "allow")
    assert url_filter.judge(df.where("page_id < 0")).count() == 0


def test_distrust_flows_against_links_and_trust_along(spark):
    a = lambda *hosts: "".join(f'<a href="https://{h}/x">t</a><a href="/own">o</a>' for h in hosts)
    rows = [(1, "http://good.com/a", a("friend.org")), (2, "http://bad.net/es/", a()), (3, "http://farm.org/", a("bad.net")), (4, "http://friend.org/", a()),
            (5, "http://lonely.org/", None), (6, "http://deep.org/", a("farm.org", "lonely.org")), (6, "http://deep.org/", a("farm.org", "lonely.org"))]
    got = [(r.page_id, r.verdict) for r in url_filter.judge(pages(spark, rows)).collect()]
    assert sorted(got) == [(1, "allow"), (2, "block"), (3, "block"), (4, "allow"), (5, "allow"), (6, "block"), (6, "block")]


def test_spread_equals_power_iteration(spark):
    rng = np.random.default_rng(8)
    n = 12
    links = {(int(a), int(b)) for a, b in rng.integers(0, n, (40, 2)) if a != b}
    seeds = [(f"h{i}", 1.0 if i == 0 else 0.0, 1.0 if i == 1 else 0.0) for i in range(n)]
    got = url_filter.spread(spark.createDataFrame(seeds, "host string, trusted double, blocked double"),
                            spark.createDataFrame([(f"h{a}", f"h{b}") for a, b in links], "src string, dst string"), tolerance=1e-13)
    m = np.zeros((n, n))
    for a, b in links:
        m[b, a] = 1
    for kind, seed, matrix in (("trust", 0, m), ("distrust", 1, m.T)):
        walk = np.divide(matrix, matrix.sum(axis=0), out=np.zeros((n, n)), where=matrix.sum(axis=0) > 0)
        s = np.eye(n)[seed] * (1 - url_filter.DAMPING)
        r = s.copy()
        for _ in range(300):
            r = s + url_filter.DAMPING * walk @ r
        mine = {x.host: x.score for x in got.where(f"kind = '{kind}'").collect()}
        assert [mine.get(f"h{i}", 0.0) for i in range(n)] == pytest.approx(r.tolist(), abs=1e-9)


def test_verdicts_equal_brute_force(spark):
    """Brute force: op5_url_filter's verdicts on hosts with links, a part of whose pages the rules decide."""
    rng = np.random.default_rng(12)
    hosts = [f"h{i}.{t}" for i, t in enumerate(rng.choice(["com", "net", "org", "net"], 40))]
    rows = []
    for h in hosts:
        for k in range(rng.integers(1, 9)):
            path = rng.choice(["/es/", "/fr/", "/en/", "/de/"], p=[0.2, 0.2, 0.3, 0.3])
            links = [str(x) for x in rng.choice(hosts, rng.integers(0, 3))]
            rows.append((len(rows), f"http://{h}{path}{k}", "".join(f"<a href='http://{x}/'>t</a>" for x in links)))
    rows.append((len(rows), "http://h0.org/", None))
    decide = lambda h, p: ("allow" if h.endswith(".com") else "block" if h.endswith(".net") and p[:4] in ("/es/", "/fr/") else None)
    split = {i: (u.split("/")[2], u[u.index("/", 8):]) for i, u, _ in rows}
    net, edges = {}, set()
    for i, _, html in rows:
        h, p = split[i]
        net.setdefault(h, []).append({"allow": 1, "block": -1, None: 0}[decide(h, p)])
        edges |= {(h, x) for x in re.findall("http://([^/]+)/", html or "") if x != h}
    nodes = sorted(set(net) | {x for e in edges for x in e})
    at = {h: i for i, h in enumerate(nodes)}
    scores = []
    for sign, flip in ((1, False), (-1, True)):
        seed = np.array([max(0.0, sign * np.mean(net.get(h, [0]))) for h in nodes]) * (1 - url_filter.DAMPING)
        m = np.zeros((len(nodes),) * 2)
        for a, b in edges:
            m[(at[a], at[b]) if flip else (at[b], at[a])] = 1
        walk = np.divide(m, m.sum(axis=0), out=np.zeros_like(m), where=m.sum(axis=0) > 0)
        r = seed
        for _ in range(300):
            r = seed + url_filter.DAMPING * walk @ r
        scores.append(r)
    bad = {h for h in nodes if scores[1][at[h]] >= url_filter.LEAST * (1 - url_filter.DAMPING) and scores[1][at[h]] > scores[0][at[h]]}
    got = {r.page_id: r.verdict for r in url_filter.judge(pages(spark, rows)).collect()}
    assert got == {i: decide(*split[i]) or ("block" if split[i][0] in bad else "allow") for i, _, _ in rows}
    assert {"block", "allow"} == {got[i] for i in got if decide(*split[i]) is None}


# pages

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header class="site-header"><p>Site name and slogan of it all.</p></header><nav><ul><li><a href="/">Home</a></li></ul></nav>
<div class="cookie-notice"><p>We use cookies. Please accept all of them now, it is good for you.</p></div>
<div id="content"><h1>Caf&eacute; &amp; more</h1><p>First   paragraph with <b>bold</b> words,<br>and a line. It has sentences. Really.<p>Second one&nbsp;here, also with enough words to be read.
<form><p>Your mail address for our letters, please write it here.</p><button>Go</button></form><ul><li>An item that tells something of the story.</ul></div>
<div class="ad">Buy this thing now, it is cheap. Very cheap.</div><aside><p>Related: another story that is long enough to look like text.</p></aside>
<div class="comments"><p>I do not agree with what is written here at all. Not one bit.</p></div><footer>&copy; 2020 Site</footer></body></html>"""


def test_main_text_of_a_page():
    """In place of brute force: op7_html_extract on a page with every kind of part, read by hand."""
    assert html_extract.main_text(PAGE).split("\n\n") == [
        "Café & more", "First paragraph with bold words, and a line. It has sentences. Really.", "Second one here, also with enough words to be read.",
        "An item that tells something of the story."]


def test_cut_is_minimal():
    rng = np.random.default_rng(9)
    for _ in range(60):
        n = int(rng.integers(2, 8))
        unary = rng.normal(0, 2, n).round(2).tolist()
        edges = [(i, j, round(float(rng.random()), 2)) for i in range(n) for j in range(i) if rng.random() < 0.5]
        cut = html_extract.Cut(unary)
        for a, b, c in edges:
            cut.join(a, b, c)
        cost = lambda s: (sum(u for u, x in zip(unary, s, strict=True) if u > 0 and not x) + sum(-u for u, x in zip(unary, s, strict=True) if u < 0 and x)  # noqa: E731, B023
                          + sum(c for a, b, c in edges if s[a] != s[b]))  # noqa: B023
        assert cost(cut.source_side()) == pytest.approx(min(cost(s) for s in itertools.product([False, True], repeat=n)))


def test_pages_of_any_kind(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "<p>"), (None, "u", PAGE), (None, "u", PAGE), (4, "u", "<article><p>" + "word. " * 20000), (5, "u", "plain words only"),
            (6, "u", "<ul>" * 3000 + "x"), (7, "u", "<!-- never closed <p>a"), (8, "u", '<p class="a>b">' + "Some words here. " * 5 + "</p>")]
    got = html_extract.extract(pages(spark, rows))
    texts = {r.page_id: r.text for r in got.collect()}
    assert got.count() == len(rows) and texts[1] == texts[2] == texts[3] == ""
    assert texts[4] == ("word. " * 20000).strip() and texts[8].startswith("Some words")
    assert html_extract.extract(pages(spark, [])).count() == 0


# archives

def test_archives_round_trip(spark):
    big, tricky = "x" * 200, "WARC/1.1\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n" + "y" * 120
    rows = [(5, "http://a/", big), (3, "http://b/\r\nX: y", big), (3, "http://b/", big), (9, None, None), (8, "http://c/", ""), (None, "http://d/", big), (7, "http://e/", "small"),
            (6, "http://e/", "small"), (1, "http://é/", tricky), (2, "http://f/", tricky), (11, "http://g/", "ü" * 50), (12, "http://g/", "ü" * 50), (13, "http://h/", "\n\r\n\r\n")]
    df = pages(spark, rows)
    got = sorted(((r.id and int(r.id)) or -1, r.record_type, r.refers_to, r.stated_bytes, r.payload_sha256 or r.digest) for r in warc.archive(df).collect())
    want = sorted((i or -1, t, f, len((h or "").encode()), hashlib.sha256((h or "").encode()).hexdigest()) for (i, _, h), t, f in zip(
        rows, ["revisit", "response", "revisit", "response", "response", "revisit", "response", "response", "response", "revisit", "response", "revisit", "response"],
        ["3", None, "3", None, None, "3", None, None, None, "1", None, "11", None], strict=True))
    assert got == want
    assert warc.archive(pages(spark, [])).count() == 0


def test_record_names_are_unique_and_referred_to(spark, tmp_path):
    """Rows with one id and different payloads, and equal rows, are records of their own; revisits name their response."""
    import gzip

    rows = [(1, "http://a/", "x" * 200), (1, "http://a/", "y" * 200), (2, "http://b/", "x" * 200), (3, "http://c/", "s"), (3, "http://c/", "s"), (None, "http://d/", "y" * 200)]
    df = pages(spark, rows)
    warc.write_archives(df, warc.resolve(warc.headers(df)), str(tmp_path / "w"))
    text = "".join(gzip.open(f, "rt", newline="").read() for f in (tmp_path / "w").glob("*.gz"))
    names, referred = re.findall(r"WARC-Record-ID: (\S+)", text), re.findall(r"WARC-Refers-To: (\S+)", text)
    assert len(names) == len(set(names)) == 6 and len(referred) == 2
    response = {n for n, kind in zip(names, re.findall(r"WARC-Type: (\S+)", text), strict=True) if kind == "response"}
    assert set(referred) <= response and len(set(referred)) == 2


def test_incoming_revisits_join_their_response(spark):
    rows = [(4, "u", "d1", 500, "response"), (2, "u", "d1", 500, "revisit"), (9, "u", "d2", 500, "revisit"), (6, "u", "d1", 500, "response"), (7, "u", "d3", 50, "response"), (8, "u", "d3", 50, "response")]
    got = {r.id: (r.record_type, r.refers_to) for r in warc.resolve(spark.createDataFrame(rows, "id long, url string, digest string, bytes long, type string")).collect()}
    assert got == {4: ("response", None), 2: ("revisit", 4), 9: ("revisit", None), 6: ("revisit", 4), 7: ("response", None), 8: ("response", None)}


@pytest.mark.parametrize("page", [
    "<html><body class='no-sidebar'><div><p>{a}</p><p>{b}</p></div></body></html>", "<body><div class='content with-sidebar'><p>{a}</p><p>{b}</p></div></body>",
    "<body class='has-menu sidebar'><main class='main-with-nav'><p>{a}</p><p>{b}</p></main><div class='sidebar'><p>Other pages. {a}</p></div></body>"])
def test_layout_names_do_not_hide_the_article(page):
    a = "The river rose during the night and the people of the lower town left their houses. " * 3
    b = "In the morning the water stood at the church door, and boats went from street to street. " * 3
    assert html_extract.main_text(page.format(a=a, b=b)) == f"{a.strip()}\n\n{b.strip()}"


def test_malformed_pages_take_linear_time():
    import time

    start = time.process_time()
    for html in ("<p>x" + "<b>" * 100_000 + "</i>" * 1000, "<div>" * 60_000 + "text", "<td>" + "<b>" * 50_000 + "</div>" * 50_000, "<p>a<li>b" * 30_000):
        html_extract.read_blocks(html)
    assert time.process_time() - start < 20


def test_words_with_one_beginning_differ():
    """All letters of a word are features: words with equal first five letters, also long ones, get different features."""
    assert set(toxicity.features("motherhood")) != set(toxicity.features("motherland")) and set(toxicity.features("mothe")) != set(toxicity.features("mother"))
    assert set(toxicity.features("a" * 40 + "b")) != set(toxicity.features("a" * 40 + "c"))
    assert toxicity.features("") == toxicity.features("") and len(toxicity.features("日本語")) > 1


def test_scores_equal_a_brute_force_scorer(spark):
    """Brute force: op8_toxicity's score, from the weights, letter by letter."""
    import zlib

    rng = np.random.default_rng(1)
    model = toxicity.Model(rng.normal(0, 0.3, toxicity.DIMENSIONS).astype(np.float32), -4.0)
    texts = ["", None, "One. two! three?\nFour five six", "...", "x" * 300 + " y. Ünder STRAẞE 12 a_b", "the same the same. " * 40]

    def chance(text):
        clean = 1.0
        for part in re.split(r"[.!?\n]", text or ""):
            if words := re.findall(r"[^\W\d_]+", part.lower()):
                z = model.bias
                for w in words:
                    grams = {w} | {f"^{w}$"[i:i + n] for n in toxicity.GRAMS for i in range(len(w) + 3 - n)}
                    z += sum(float(model.weights[zlib.crc32(g.encode()) % toxicity.DIMENSIONS]) for g in grams)
                clean *= 1 - 1 / (1 + np.exp(-z))
        return 1 - clean

    got = toxicity.score(spark.createDataFrame([(t,) for t in texts], "text string"), model).collect()
    assert [r.score for r in got] == pytest.approx([chance(t) for t in texts], abs=1e-6)
