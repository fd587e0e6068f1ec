"""Exact dedup, similarity join, fingerprints, mixing: against brute force and on odd rows."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from corpus_fixtures import near_docs, no_docs, odd_docs  # noqa: F401
from pyspark.sql import functions as F

from vendaflux.llm import components as components_module
from vendaflux.llm import exact_dedup, fingerprint, jaccard_join, mixing
from vendaflux.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# exact dedup

def test_filters_merge_without_loss():
    rng = np.random.default_rng(0)
    width, parts = 30, [rng.integers(0, 1 << 12, 500).astype(np.uint64) << np.uint64(7) for _ in range(4)]
    built = [exact_dedup.CountingQuotientFilter.build(p, np.ones(len(p)), width) for p in parts]
    whole = exact_dedup.CountingQuotientFilter.merge(built)
    prints, counts = whole.items()
    expected = Counter(np.concatenate(parts).tolist())
    assert dict(zip(prints.tolist(), counts.tolist(), strict=True)) == expected
    assert prints.tolist() == sorted(expected)


@pytest.mark.parametrize("bits", [0, 3])
def test_filters_count_across_partitions(spark, bits):
    rows = spark.createDataFrame([(h,) for h in [1, 1, -5, 7, 7, 7, 2**62, 2**62, -5, 9]], "fp long").repartition(4)
    twice = exact_dedup.repeated_prints(exact_dedup.partition_filters(rows, bits), bits)
    assert {(r.fp, r.n) for r in twice.collect()} == {(1, 2), (-5, 2), (7, 3), (2**62, 2)}


def test_exact_dedup_on_odd_rows(odd_docs, no_docs):
    got = exact_dedup.exact_dedup(odd_docs).collect()
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = defaultdict(list)
    for r in odd_docs.collect():
        groups[hashlib.sha256(norm(r.text).encode()).hexdigest()].append(r.doc_id)
    assert len(got) == odd_docs.count()
    for sha, ids in groups.items():
        mine = [r for r in got if r.text_sha256 == sha]
        least = min((i for i in ids if i is not None), default=None)
        assert sorted(str(r.doc_id) for r in mine) == sorted(map(str, ids))
        assert {(r.keep_id, r.group_size) for r in mine} == {(least, len(ids))}
        assert [r.doc_id for r in mine if r.kept] == [least]
    assert exact_dedup.exact_dedup(no_docs).count() == 0
    stay = exact_dedup.deduplicated(odd_docs)
    assert stay.columns == odd_docs.columns and stay.count() == len(groups)


# similarity join

def shingle_sets(rows, width):
    out = {}
    for i, t in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out[i] = {tuple(w[k: k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    return out


def brute_components(sets, percent):
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            inter = len(sets[a] & sets[b])
            if inter and 100 * inter >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize(("width", "percent"), [(4, 85), (5, 80), (2, 50)])
def test_join_equals_brute_force(near_docs, width, percent, monkeypatch):
    monkeypatch.setattr(jaccard_join, "COMMON", 20)
    sets = shingle_sets([tuple(r) for r in near_docs.collect()], width)
    want = brute_components(sets, percent)
    got = jaccard_join.join(near_docs, width=width, percent=percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {i: (len(sets[i]), want[i]) for i in sets}


def test_blocks_of_a_large_cell_find_the_same_links(spark):
    rng = np.random.default_rng(3)
    base = np.arange(1000, 1100, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[rng.random(100) > 0.06], rng.integers(0, 900, 3).astype(np.uint64)])) for _ in range(60)]
    cells = spark.createDataFrame([(1, i, len(s), i % 5, 5, s.tobytes()) for i, s in enumerate(sets)],
                                  "root long, node long, n long, block int, blocks int, shingles binary")
    links = components(jaccard_join.cell_links(cells, 80)).collect()
    want = brute_components({i: set(s.tolist()) for i, s in enumerate(sets)}, 80)
    got = {i: i for i in want} | {r.node: r.root for r in links}
    assert got == want


def test_join_on_odd_rows(odd_docs, no_docs):
    rows = {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.join(odd_docs, width=4, percent=85).collect()}
    assert {(1, 3, 1), (2, 3, 1), (8, 3, 1), (3, 0, 3), (4, 0, 4), (5, 0, 5), (None, 3, None), (11, 1, 11), (12, 1, 12)} <= rows
    assert {c for i, n, c in rows if i in (6, 7) and n > 900} == {6}
    assert jaccard_join.join(no_docs).count() == 0
    stay = jaccard_join.one_of_each(odd_docs, width=4, percent=85)
    assert stay.columns == odd_docs.columns
    assert sorted(str(r.doc_id) for r in stay.collect()) == sorted(map(str, [1, 3, 4, 5, 6, 7, None, 9, 10, 11, 12]))  # equal texts go, whatever their ids


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, j) for j in range(200, 260)] + [(7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 100 for i in range(100, 161)} | {j: 5 for j in [5, *range(200, 260)]}


def test_components_of_edges_that_fit_into_a_task_need_two_tables(spark, monkeypatch):
    tables = []
    monkeypatch.setattr(components_module, "written", lambda df, name, f=components_module.written: tables.append(name) or f(df, name))
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)], "a long, b long").repartition(20)
    assert {(r.node, r.root) for r in components(edges).collect()} == {(i, 0) for i in range(301)}
    assert len(tables) == 2


def test_components_across_tasks_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(components_module, "TOGETHER", 8)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        edges = [(k * 1000 + (i * 37) % 101, k * 1000 + ((i + 1) * 37) % 101) for k in range(3) for i in range(100)] * 2
        got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long").repartition(30)).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == {k * 1000 + i: k * 1000 for k in range(3) for i in range(101)}


def test_stars_have_the_least_node_of_each_component():
    got = components_module.stars(np.array([9, 4, -1, 7]), np.array([4, 2, -3, 7]))
    assert set(map(tuple, got.to_numpy().tolist())) == {(9, 2), (4, 2), (-1, -3)}


def test_sizes_are_compared_before_pairs_meet_their_bit_maps(spark):
    lists = spark.createDataFrame([(1, 10, 100, 3), (1, 11, 86, 3), (1, 12, 50, 3)], "h long, node long, n int, c long")
    bits = spark.createDataFrame([(i, 100, bytes(64)) for i in (10, 11, 12)], "node long, n long, bits binary")  # all alike here
    assert [tuple(r) for r in jaccard_join.short_list_edges(lists, bits, 85).collect()] == [(10, 11)]


# fingerprints

def paragraphs(text):
    return {p.strip(" ") for p in re.findall(r"[^\n]{%d,}?[.!?](?=\s)|[^\n]+" % fingerprint.LONG_LINE, text)} - {""}


def brute_fingerprints(rows):
    rows = sorted(rows, key=lambda r: -r[0])
    for k, (i, t) in enumerate(rows):
        nxt, n = rows[(k + 1) % len(rows)][1] or "", len(t or "")
        edited = (t or "")[: n - n // 2] + nxt[: n // 2]
        like = [1.0 if not a | b else len(a & b) / len(a | b) for a, b in ((paragraphs(t or ""), paragraphs(x)) for x in (edited, nxt))]
        yield i, (n, hashlib.sha256(edited.encode()).hexdigest(), *like)


def test_fingerprints_equal_brute_force(spark, monkeypatch):
    """Brute force: op3_fingerprints."""
    monkeypatch.setattr(fingerprint, "BUCKET", 7)
    rng = np.random.default_rng(1)
    lines = [f"line {i} of some text." for i in range(60)]
    rows = [(int(i) ** 3 - 50, "\n".join(lines[j] for j in rng.integers(0, 60, rng.choice([0, 1, 3, 12, 40, 150])))) for i in range(60)]
    got = fingerprint.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = dict(brute_fingerprints(rows))
    assert len(got) == len(rows)
    for r in got:
        n, sha, near_edited, near_next = want[r.doc_id]
        assert (r.n_chars, r.edited_sha256) == (n, sha)
        assert r.near_edited == pytest.approx(near_edited) and r.near_next == pytest.approx(near_next)


def test_fingerprints_on_odd_rows(spark, odd_docs, no_docs):
    rows = fingerprint.fingerprints(odd_docs).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    same = {r.fingerprint for r in rows if r.doc_id in (1, 8)}
    assert len(same) == 1
    assert len({r.fingerprint for r in rows if r.n_chars == 0}) == 1
    assert fingerprint.fingerprints(no_docs).count() == 0
    [only] = fingerprint.fingerprints(spark.createDataFrame([(1, "ab cd")], "doc_id long, text string")).collect()
    assert only.edited_sha256 == hashlib.sha256(b"ab ab").hexdigest() and only.near_next == 1.0


def test_half_of_a_short_or_unpunctuated_text_is_seen(spark):
    rng = np.random.default_rng(3)
    texts = [" ".join(f"{'abcdefgh'[rng.integers(8)]}{rng.integers(900)}" for _ in range(n)) for n in (40, 60, 6000)]
    texts += ["".join(chr(c) for c in rng.integers(0x4E00, 0x9FA5, 300)), "x" * 5000]
    rows = [(i, t) for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in fingerprint.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(0 < got[i].near_edited < 1 for i in range(len(texts)))
    assert 0.25 < got[2].near_edited < 0.6
    # a word put into the middle of an unpunctuated line moves no cut but those beside it
    words = texts[2].split()
    keys = [set(r.k) for r in spark.createDataFrame([(texts[2],), (" ".join(words[:3000] + ["new"] + words[3000:]),)], "t string").select(
        fingerprint.paragraph_keys(F.col("t")).alias("k")).collect()]
    assert len(keys[0]) > 500 and len(keys[0] ^ keys[1]) <= 6


def test_small_sketches_fail_and_larger_ones_succeed(spark):
    a, b = list(range(100)), list(range(50, 150))
    row = spark.createDataFrame([(a, b)], "a array<long>, b array<long>")
    [first] = row.select(fingerprint.difference(row.a, row.b, 0).alias("d")).collect()
    assert first.d is None
    assert fingerprint.likeness(row).first().likeness == pytest.approx(50 / 150)


# mixing

def targets_by_weight(sizes, cycle=(1, 2, 3), cap=3):
    """Brute force: op2_mixing's targets."""
    names = sorted(n for n in sizes if n is not None) + [None] * (None in sizes)
    weight = {n: cycle[i % len(cycle)] for i, n in enumerate(names)}
    capped = set()
    while True:
        left = sum(sizes.values()) - cap * sum(sizes[n] for n in capped)
        share = {n: left * w / sum(weight[m] for m in names if m not in capped) for n, w in weight.items() if n not in capped}
        above = {n for n in share if share[n] > cap * sizes[n]}
        if not above:
            return {n: float(cap * sizes[n]) if n in capped else share[n] for n in names}
        capped |= above


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 100, "c": 10, None: 90}, {"b": 5, None: 7, "a": 3, "é": 1000, "Z": 1}, {"x": 0, "y": 0}, {"only": 9},
                                   {f"s{i}": (i * 7919) % 1000 + (50_000 if i == 3 else 0) for i in range(20)}])
def test_targets_equal_brute_force(spark, sizes):
    got = mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, total long"))
    assert {r.source: r.target for r in got.collect()} == pytest.approx(targets_by_weight(sizes))


def brute_tilt(sizes, target, cap=3):
    """By halving: the multiplier at which the words taken are the target."""
    low, high = -800.0, float(np.log(cap))
    taken = lambda lam: sum(s * min(cap, np.exp(min(lam * s, 2.0))) for s in sizes)
    for _ in range(300):
        lam = (low + high) / 2
        low, high = (lam, high) if taken(lam) < target else (low, lam)
    return lam


def test_multipliers_for_every_ratio(spark):
    """Brute force: op2_mixing's rates, for targets from nothing to three times a source, with equal and unequal sizes."""
    rng = np.random.default_rng(6)
    ratios = [0.0, 0.01, 0.5, 0.999, 1.0, 1.3, 2.0, 2.05, 2.1, 2.5, 2.9, 2.99, 2.9999, 3.0]
    sources = {}
    for i, r in enumerate(ratios * 2):
        sizes = [40] * 30 if i < len(ratios) else [int(x) for x in rng.choice([1, 2, 30, 200, 5000], 60)]
        sources[f"s{i}" if i else None] = (sizes, r * sum(sizes))
    classes = [(n, size, count) for n, (sizes, _) in sources.items() for size, count in Counter(sizes).items()]
    goals = spark.createDataFrame([(n, sum(sizes), float(t)) for n, (sizes, t) in sources.items()], "source string, total long, target double")
    got = mixing.multipliers(spark.createDataFrame(classes, "source string, size long, n long"), goals)
    for r in got.collect():
        sizes, target = sources[r.source]
        taken = sum(s * min(3.0, np.exp(min(r.lam * s, 2.0))) for s in sizes)
        assert taken == pytest.approx(target, rel=1e-8, abs=1e-6)
        if 0 < target < 3 * sum(sizes):
            assert [min(3.0, np.exp(min(r.lam * s, 2.0))) for s in sizes] == pytest.approx([min(3.0, np.exp(min(brute_tilt(sizes, target) * s, 2.0))) for s in sizes], rel=1e-5)
    with pytest.raises(RuntimeError, match="settle"):
        mixing.multipliers(spark.createDataFrame(classes, "source string, size long, n long"), goals, steps=1)


def test_mix_takes_what_ratios_above_two_ask_for(spark):
    """Three sources of 6,200, 2,000 and 1,800 words: the third is to give 5,000, more than 2.7 times its size."""
    rng = np.random.default_rng(3)
    rows = []
    for source, words in (("a", 6200), ("b", 2000), ("c", 1800)):
        while words:
            n = min(words, int(rng.choice([1, 3, 17, 60])))
            rows.append((len(rows), "w " * n, source))
            words -= n
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    taken, goal = Counter(), {}
    for r in got:
        taken[r.source] += r.taken
        goal[r.source] = r.target
    assert goal["c"] == pytest.approx(5000) and all(abs(taken[s] - t) <= 2 for s, t in goal.items())


def test_balance_beyond_the_cap_and_unsettled(spark):
    """Targets of 2.1 to 2.9 times a group: the first step overshoots the cap, the dual still falls to its minimum."""
    cells = spark.createDataFrame([("a", "x", 100.0), ("a", "y", 50.0), ("b", "x", 70.0), ("b", "y", 80.0)], "source string, lang string, mass double")
    goals = {"source": {"a": 2.9 * 150, "b": 2.1 * 150}, "lang": {"x": 440.0, "y": 2.9 * 150 + 2.1 * 150 - 440.0}}
    lam = mixing.balance(cells, goals)
    mass = {(s, g): m * min(3.0, np.exp(lam["source"][s] + lam["lang"][g])) for s, g, m in cells.collect()}
    for s, t in goals["source"].items():
        assert sum(v for (k, _), v in mass.items() if k == s) == pytest.approx(t, rel=1e-6)
    with pytest.raises(RuntimeError, match="settle"):
        mixing.balance(cells, {"source": {"a": 151.0, "b": 149.0}, "lang": {"x": 9000.0, "y": 1.0}}, steps=5)


def test_balance_meets_overlapping_constraints(spark):
    cells = spark.createDataFrame([("a", "x", 100.0), ("a", "y", 50.0), ("b", "x", 70.0), ("b", "y", 80.0)], "source string, lang string, mass double")
    lam = mixing.balance(cells, {"source": {"a": 180.0, "b": 120.0}, "lang": {"x": 160.0, "y": 140.0}})
    mass = {(s, g): m * np.exp(lam["source"][s] + lam["lang"][g]) for s, g, m in cells.collect()}
    assert sum(v for (s, _), v in mass.items() if s == "a") == pytest.approx(180, abs=0.01)
    assert sum(v for (_, g), v in mass.items() if g == "y") == pytest.approx(140, abs=0.01)


def test_mix_meets_targets_and_the_cap(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANKED_ROWS", 8)
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(["w"] * int(rng.choice([1, 2, 3, 9, 40, 200]))), None if i % 11 == 0 else f"s{i % 6}") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs).collect()
    assert sorted(r.doc_id for r in got) == list(range(900))
    taken, target = Counter(), {}
    for r in got:
        assert r.taken <= 3 * r.size and r.taken == r.copies * r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert {s: (r.source_size) for s, r in ((r.source, r) for r in got)} == Counter({s: 0 for s in target}) + Counter(
        {s: sum(len(t.split()) for _, t, q in rows if q == s) for s in target})
    for s, t in target.items():
        assert abs(taken[s] - t) <= 2
    again = {(r.doc_id, r.taken) for r in mixing.mix(docs.repartition(5)).collect()}
    assert again == {(r.doc_id, r.taken) for r in got}


def test_mix_on_odd_rows(odd_docs, no_docs):
    got = mixing.mix(odd_docs).collect()
    assert len(got) == odd_docs.count() and all(r.taken <= 3 * r.size for r in got)
    assert {r.taken for r in got if r.doc_id in (3, 4, 5)} == {0}
    assert mixing.mix(no_docs).count() == 0 and mixing.mixed(no_docs).count() == 0
    rows = mixing.mixed(odd_docs)
    assert rows.columns == odd_docs.columns
