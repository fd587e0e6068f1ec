"""Prefix trie, spelling variants, quality rules: against brute force and on odd rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from corpus_fixtures import no_docs, odd_docs  # noqa: F401

from vendaflux.llm import common, conversation_trie, line_frequency, spelling_variants

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TURNS = "conv_id long, turn long, role string, text string, at long, block int, level string"


# conversation prefix trie

def brute_trie(rows):
    turns = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            turns[c].append((t is not None, t or 0, r or "", x or ""))
    turns = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in turns.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        path = tuple(turns.get(c - c % 20, [])[:h] + own[h:])
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
        ends[path].append(c)
    kids = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        own = (len(m) - 1) * len(WORD.findall(p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            saved[p[:d]] += own
            leaves[p[:d]] += not kids[p]
    digest = {p: hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest() for p in members}
    return sorted(((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], digest[p]) for p, m in members.items()), key=str)


def conversations(seed):
    """Shared beginnings, copies, long and short conversations, ids that are missing."""
    rng = random.Random(seed)
    stems = [[(rng.choice(["user", "assistant"]), f"turn {rng.randrange(4)} of {k}") for _ in range(rng.choice([1, 3, 20]))] for k in range(4)]
    rows = []
    for c in rng.sample(range(90), 70):
        path = list(rng.choice(stems))[: rng.randrange(1, 21)] + [("user", f"x {rng.randrange(3)}") for _ in range(rng.choice([0, 1, 5, 17]))]
        rows += [(c, t, r, x) for t, (r, x) in enumerate(path)]
    return rows


@pytest.mark.parametrize(("width", "cell"), [(8, 1024), (2, 3), (3, 1)])
def test_trie_equals_brute_force(spark, monkeypatch, width, cell):
    """Blocks of any width and cells of any size give the same nodes; rows come in any order."""
    monkeypatch.setattr(conversation_trie, "CELL", cell)
    monkeypatch.setattr(conversation_trie, "PIECE", 7)
    rows = conversations(width)
    random.Random(1).shuffle(rows)
    turns = spark.createDataFrame([(*r, 0, 0, "l") for r in rows], TURNS).repartition(5)
    got = conversation_trie.trie(conversation_trie.rebuilt(turns), width).drop("node").collect()
    assert sorted(map(tuple, got), key=str) == brute_trie(rows)


def test_trie_on_odd_rows(spark):
    """Nulls anywhere, repeated rows, a turnless conversation, long texts, negative ids; no rows give no rows."""
    rows = [(0, None, None, None), (0, 1, "user", "a b"), (0, 1, "user", "a b"), (0, 2, None, "w " * 50_000), (20, 0, "", ""), (21, 0, "user", "only"),
            (None, 0, "user", "a"), (-3, 5, "user", "z"), (-40, None, "user", ""), (62, 1, "x", "y"), (62, None, "x", None), (10**12, 7, "user", "a b")]
    short = next(c for c in range(100, 1000) if zlib.crc32(str(c).encode()) % 4 > 1 and c % 20)
    rows.append((short, 0, "user", "gone"))  # its only turn is left out and there is no giver
    turns = spark.createDataFrame([(*r, 0, 0, "l") for r in rows], TURNS)
    got = conversation_trie.trie(conversation_trie.rebuilt(turns)).drop("node").collect()
    # the given remainder of a negative id is negative, as in Spark and SQL
    plain = [(c, t, r, x) for c, t, r, x in rows if c is None or c >= 0]
    positive = conversation_trie.trie(conversation_trie.rebuilt(turns.where("conv_id >= 0"))).drop("node").collect()
    assert sorted(map(tuple, positive), key=str) == brute_trie(plain)
    assert max(r.n_convs for r in got) == len({c for c, *_ in rows if c is not None})
    assert conversation_trie.trie(conversation_trie.rebuilt(turns.limit(0))).collect() == []


# spelling variants

def brute_words(docs):
    lower = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
    counts = Counter()
    for key, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1:]
            counts[run] += len(run) >= 5
    return {w: n for w, n in counts.items() if n >= 3}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_groups(words):
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    best = {w: min(near[w], key=lambda v: (-words[v], v), default=None) for w in words}
    form = {w: b if b and words[b] >= 2 * words[w] else None for w, b in best.items()}
    out = set()
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None))
    return out


@pytest.mark.parametrize("letters", ["ab", "abcdefgh", "aéÿ×z"])
def test_groups_equal_brute_force(spark, letters):
    """Few letters give many neighbours and runs of equal ones, many letters chains of forms."""
    rng = random.Random(len(letters))
    words = {}
    for _ in range(60):
        w = "".join(rng.choice(letters) for _ in range(rng.choice([5, 5, 6, 7, 11])))
        for _ in range(6):
            at, n = rng.randrange(len(w)), rng.choice([3, 5, 9, 20, 100])
            w = rng.choice([w[:at] + w[at + 1:], w[:at] + rng.choice(letters) + w[at:], w[:at] + rng.choice(letters) + w[at + 1:], w])
            words[w] = n
    words |= {"a" * k: k for k in (40, 41, 42, 44)} | {"": 3, "b": 9, "bc": 20}
    got = spelling_variants.group(spark.createDataFrame(list(words.items()), "word string, n long").repartition(4))
    assert {tuple(r) for r in got.collect()} == brute_groups(words)


def test_counts_and_variants_of_texts(spark, odd_docs, no_docs, monkeypatch):
    rng = random.Random(4)
    pool = ["Straße", "strasse", "house", "HOUSE", "hause", "mouse", "naïve", "naive", "ÀÉÎ×÷", "a" * 300, "x1y", "日本語テキスト", "don't", "abcd"]
    docs = [(rng.choice([None, i, i + 5]), " ".join(rng.choice(pool) for _ in range(rng.choice([0, 5, 400])))) for i in range(40)] + [(1, None), (None, ""), (10**15, "house " * 3000)]
    monkeypatch.setattr(spelling_variants, "HELD", 3)
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert {tuple(r) for r in spelling_variants.count_words(frame).collect()} == set(brute_words(docs).items())
    assert {tuple(r) for r in spelling_variants.variants(frame).collect()} == brute_groups(brute_words(docs))
    odd = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert {tuple(r) for r in spelling_variants.variants(odd_docs).collect()} == brute_groups(brute_words(odd))
    assert spelling_variants.variants(no_docs).collect() == []


def test_long_words_that_agree_far(spark):
    """Two words of 400 letters that differ near their end, and one that lacks a letter in the middle."""
    rng = random.Random(8)
    long_ = "".join(rng.choice("abcde") for _ in range(120))
    words = {long_: 10, long_[:-2] + "z" + long_[-1]: 4, long_[:60] + long_[61:]: 3, "z" + long_: 30}
    got = spelling_variants.group(spark.createDataFrame(list(words.items()), "word string, n long"))
    assert {tuple(r) for r in got.collect()} == brute_groups(words)


# quality rules

def brute_measures(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    repeated = {i + k for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeated))


def brute_quality(rows, share=0.05, least=20, remains=0.3):
    normal = lambda x: " ".join(WORD.findall(x)).lower()
    held, texts = defaultdict(set), defaultdict(set)
    for _, text, host in rows:
        texts[host].add(text or "")
        for line in {normal(x) for x in (text or "").split("\n")} - {""}:
            held[host, line].add(text or "")
    common = {k for k, v in held.items() if len(v) > least and len(v) > share * len(texts[k[0]])}
    out = []
    for key, text, host in rows:
        m = brute_measures(text)
        failed = m[0] < 50 or 100 * m[4] > 50 * m[0]
        removed = sum(len(WORD.findall(x)) for x in (text or "").split("\n") if (host, normal(x)) in common)
        out.append((key, *m, failed, removed, not failed and m[0] - removed >= remains * m[0]))
    return sorted(out, key=str)


def quality_rows():
    """Host a: a banner in a third of its texts, some of which hold little else.  Host b: the same lines, but rarely."""
    rng = random.Random(9)
    banner = "This Site  uses cookies\tand more words of the banner that every page of the host repeats in full"
    say = lambda n: " ".join(f"w{rng.randrange(5000)}" for _ in range(n))
    notices = [say(20) for _ in range(3)]
    rows = []
    for i in range(240):
        text = say(rng.choice([30, 60, 90]))
        if i % 3 == 0:
            text = f"{banner}\n{text}\n{banner.upper()}"
        if i % 24 == 0:
            text = "\n".join([*notices, say(8)])
        elif i % 3 == 1:
            text = "\n".join([text, *notices])
        rows.append((i, text, "a"))
    rows += [(1000 + i, (banner + "\n" if i < 15 else "") + say(60), "b") for i in range(200)]
    rows += [(2000 + i, banner + "\n" + "one text that is copied very often " * 8, "c") for i in range(60)]
    return rows + [(None, None, None), (None, "", "a"), (5, " \n\t\n", None), (6, "x y z " * 40, "b"), (7, "#*$%&|<> " * 60, "b"), (7, "l\nl\n\nl \n" * 20, None)]


def test_quality_equals_brute_force(spark, odd_docs, no_docs):
    rows = quality_rows()
    frame = spark.createDataFrame([(i, t, None, s, 0, "row", "h") for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long, row string, host string")
    got = line_frequency.judge(frame.repartition(6)).collect()
    assert sorted(map(tuple, got), key=str) == brute_quality(rows)
    assert any(not r.base_failed and not r.kept for r in got) and sum(r.kept for r in got) > 200
    odd = [(r.doc_id, r.text, r.source) for r in odd_docs.collect()]
    assert sorted(map(tuple, line_frequency.judge(odd_docs).collect()), key=str) == brute_quality(odd)
    assert line_frequency.judge(no_docs).collect() == []


def test_quality_runs_no_python(spark, odd_docs):
    plan = line_frequency.measures(odd_docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# intermediate tables

def test_intermediate_tables_lie_in_one_folder_that_can_go(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(common, "shared_dir", lambda spark: f"file://{tmp_path}")
    assert common.written(spark.range(3), "t").count() == 3
    assert list(tmp_path.glob("work-*/t-*/*.parquet"))
    common.clean_up(spark)
    common.clean_up(spark)
    assert list(tmp_path.iterdir()) == []
