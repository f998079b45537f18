"""Operators across documents, held against plain versions."""

import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest

from simgrove.llm import jaccard_join, mixing, neighbours, suffix_dedup
from simgrove.llm.components import components
from simgrove.llm.jaccard_join import jaccard_components, keep_one_of_each
from simgrove.llm.line_windows import remove_repeated_windows
from simgrove.llm.mixing import mix_documents, repeats
from simgrove.llm.neighbours import nearest_neighbours
from simgrove.llm.store import Workspace, in_document_order, shared_dir
from simgrove.llm.suffix_dedup import RepeatArray, remove_repeated_bytes

from . import brute
from .conftest import near, prose, table


def check_bytes(rows, texts):
    for r, (runs, kept), t in zip(sorted(rows, key=lambda r: r.doc_id), brute.removed_bytes(texts), texts, strict=True):
        assert [(s.start, s.end) for s in r.spans] == runs and bytes(r.kept) == kept, r.doc_id
        assert (r.n_bytes, r.n_removed, r.n_spans) == (len((t or "").encode()), sum(b - a for a, b in runs), len(runs))


def test_repeated_bytes(docs, texts, none):
    check_bytes(remove_repeated_bytes(docs).collect(), texts)
    assert remove_repeated_bytes(none).collect() == []


def test_repeated_bytes_of_dealt_anchors(spark, monkeypatch):
    """A passage in many different surroundings, dealt over blocks of three segments."""
    monkeypatch.setattr(suffix_dedup, "GROUP", 3)
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", 400)
    passage = prose(5, 2, 30)
    texts = [prose(i, 2) + " " + passage + " " + prose(100 + i, 2) for i in range(25)] + [passage[7:190], "a" * 700, "ab" * 300, "a" * 120]
    check_bytes(remove_repeated_bytes(table(spark, texts).repartition(7)).collect(), texts)


@pytest.mark.parametrize("length", [30, 400])
def test_repeated_bytes_of_other_lengths(spark, length):
    passage = prose(8, 12, 20)
    texts = [prose(i, 2) + passage[i * 7 :] for i in range(6)] + ["a" * 1200, "ab" * 500]
    rows = sorted(remove_repeated_bytes(table(spark, texts), length).collect(), key=lambda r: r.doc_id)
    for r, (runs, kept) in zip(rows, brute.removed_bytes(texts, length), strict=True):
        assert [(s.start, s.end) for s in r.spans] == runs and bytes(r.kept) == kept


def test_repeated_bytes_of_repeated_rows(repeated):
    rows = remove_repeated_bytes(repeated).collect()
    by = {(r.doc_id, bytes(r.kept), r.n_removed) for r in rows}
    a, b, c = prose(1).encode(), prose(2).encode(), prose(3).encode()
    # Null ids come first; the text of id 5 that comes earlier by hash is judged without the other.
    assert len(rows) == repeated.count() and (None, b, 0) in by and (None, c, 0) in by and (5, a, 0) in by
    assert (5, b"", len(b)) in by and (9, b" tail", len(a)) in by


def test_repeat_groups_are_maximal_and_whole():
    texts = [b"xx" + b"abcdefgh" * 3, b"yy" + b"abcdefgh" * 3, b"zabcdefghz"]
    array = RepeatArray(texts, np.array([len(t) - 7 for t in texts]), 8)
    found = {}
    for size, lo, hi in array.maximal_repeats():
        places = {(int(array.segment[i]), int(array.offset[i])) for i in array.order[lo : hi + 1]}
        found[size] = found.get(size, set()) | places
    assert found[24] == {(0, 2), (1, 2)}
    assert {(2, 1), (0, 2), (1, 18)} <= found[8]
    # All occurrences of a string are in one group: seven of the eight bytes of the shortest repeat.
    assert len(found[8]) == 7


def test_anchors_of_short_texts():
    raw = np.frombuffer(b"q" * 99, np.uint8)
    assert len(suffix_dedup.segments(raw, np.array([0, 99]), 100)["doc"]) == 0
    raw = np.frombuffer(bytes(range(250)) * 2, np.uint8)
    s = suffix_dedup.segments(raw, np.array([0, 250, 250, 500]), 100)
    assert s["windows"].sum() == 2 * 151 and set(s["doc"]) == {0, 2}
    half = len(s["doc"]) // 2
    assert (s["a"][:half] == s["a"][half:]).all() and (s["anchor"][:half] == s["anchor"][half:]).all()


def test_line_windows(docs, texts, none):
    rows = sorted(remove_repeated_windows(docs).collect(), key=lambda r: r.doc_id)
    for r, (n, spans, body), t in zip(rows, brute.without_repeated_lines(texts), texts, strict=True):
        assert (r.n_removed, r.n_spans) == (n, spans) and r.text == (body if t is not None else None)
    assert remove_repeated_windows(none).collect() == []
    assert set(docs.columns) <= set(rows[0].asDict())


def test_line_windows_of_repeated_rows(repeated):
    rows = remove_repeated_windows(repeated).collect()
    assert len(rows) == repeated.count()
    found = Counter((r.doc_id, r.text) for r in rows)
    assert found[(5, prose(1))] == 3 and found[(9, prose(1).split("\n")[-1] + " tail")] == 1 and found[(None, None)] == 1


def check_components(rows, texts):
    label, sizes = brute.near_components(texts)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == {i: (sizes[i], label[i]) for i in range(len(texts))}


def test_jaccard_components(docs, texts, none):
    check_components(jaccard_components(docs).collect(), texts)
    assert jaccard_components(none).collect() == []


@pytest.mark.parametrize("share", [0.01, 0.025, 0.04])
def test_jaccard_components_of_large_groups(spark, share, monkeypatch):
    """Two large groups of near copies at the edge of the threshold, a shared passage, short texts; small chunks."""
    monkeypatch.setattr(jaccard_join, "CHUNK", 7)
    one, two = prose(1, 10, 30), prose(2, 6, 20)
    texts = [near(one, i, share) for i in range(60)] + [near(two, 100 + i, share / 2) for i in range(40)]
    texts += [prose(50 + i, 1, 8) + " " + two for i in range(10)] + ["few words", "few  WORDS", "one", "six words are in this text", "six words are in this texts"] * 2
    check_components(jaccard_components(table(spark, texts).repartition(6)).collect(), texts)


def edit_chain(seed, members=30):
    """Texts, each an edit of a random earlier one: 8 to 16 % of the shingles changed."""
    rng = random.Random(seed)
    chain = [prose(10000 + seed, 6, 30)]
    while len(chain) < members:
        words = rng.choice(chain).split()
        for _ in range(round(len(words) * rng.uniform(0.08, 0.16) / 5)):
            words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
        chain.append(" ".join(words))
    return chain


def test_jaccard_links_of_long_lists(spark, monkeypatch):
    """Sets of one long list are counted in blocks, each pair at the least list that both are in; they don't meet in a join."""
    import pyarrow as pa

    rng = random.Random(8)
    sets = [sorted(rng.sample(range(40), rng.randint(14, 30))) for _ in range(60)]
    orders = [[s[:6] for s in sets], [s[-6:] for s in sets]]
    lists = [[t for t in s if t < 6] for s in sets]
    run, found = jaccard_join._links_of_list(60), []
    for token in range(6):
        rows = [i for i, held in enumerate(lists) if token in held]
        made = pa.table({"token": [token] * len(rows), "lead": rows, "label": [i // 2 for i in rows], "n": [len(sets[i]) for i in rows], "tokens": [sets[i] for i in rows], "lists": [lists[i] for i in rows], "p1": [orders[0][i] for i in rows], "p2": [orders[1][i] for i in rows]})
        for k, (x, y) in enumerate(((0, 0), (0, 1), (1, 1))):
            parts = [made.take([n for n, i in enumerate(rows) if i % 2 == part]) for part in (x, y)]
            below, above = (t.append_column("i", pa.array([x] * t.num_rows)).append_column("j", pa.array([y] * t.num_rows)) for t in parts)
            found += [tuple(r.values()) for r in run(below, above).to_pylist()]
    expected = set()
    for u in range(60):
        for v in range(u):
            both, either = len({*sets[u]} & {*sets[v]}), len({*sets[u]} | {*sets[v]})
            meet = {*lists[u]} & {*lists[v]} and all({*o[u]} & {*o[v]} for o in orders)
            if meet and u // 2 != v // 2 and 100 * both >= 60 * either:
                expected.add((v, u, both, either))
    assert len(expected) > 20 and len(found) == len(expected)
    assert {(min(u, v), max(u, v), b, e) for u, v, b, e in found} == expected
    monkeypatch.setattr(jaccard_join, "MANY", 1)
    monkeypatch.setattr(jaccard_join, "CHUNK", 5)
    texts = [near(base, i, share) for base in (prose(5), prose(6)) for share in (0.02, 0.045) for i in range(30)]
    check_components(jaccard_components(table(spark, texts).repartition(6)).collect(), texts)


def test_jaccard_components_of_edit_chains(spark):
    """Pivots that are led by other pivots: the only member of a cluster needn't be the one it is named after."""
    texts, ids, label = [], [], {}
    for seed in (1, 32, 59, 79):
        chain, first = edit_chain(seed), 30 * seed
        texts += chain
        ids += range(first, first + len(chain))
        label |= {first + i: first + x for i, x in enumerate(brute.near_components(chain)[0])}
    rows = jaccard_components(table(spark, texts, ids=ids).repartition(6)).collect()
    assert {r.doc_id: r.component_id for r in rows} == label


@pytest.mark.parametrize("percent", [50, 90])
def test_other_thresholds(spark, percent):
    texts = [near(prose(1, 6, 20), i, 0.02) for i in range(20)] + [prose(9)]
    label, _ = brute.near_components(texts, percent)
    assert {r.doc_id: r.component_id for r in jaccard_components(table(spark, texts), percent).collect()} == dict(enumerate(label))


def test_jaccard_of_repeated_rows(repeated):
    rows = jaccard_components(repeated).collect()
    assert len(rows) == repeated.count()
    one = {r.component_id for r in rows if r.doc_id == 9}
    assert one == {5} and {r.component_id for r in rows if r.doc_id == 7} == {7}
    kept = keep_one_of_each(repeated)
    assert kept.columns == repeated.columns
    texts = Counter(r.text for r in kept.collect())
    assert texts[prose(1)] == texts[prose(2)] == texts[prose(3)] == 1 and texts[""] == texts[None] == 1


def test_one_of_each_stays(docs, texts, none):
    label, _ = brute.near_components(texts)
    assert {r.doc_id for r in keep_one_of_each(docs).collect()} == {i for i, x in enumerate(label) if i == x}
    assert keep_one_of_each(none).count() == 0


def test_components_of_chains(spark):
    links = [(i, i + 1) for i in range(0, 60)] + [(100, 90), (90, 95), (7, 7)]
    found = {r.node: r.label for r in components(spark.createDataFrame(links, "u bigint, v bigint"), Workspace(spark, "t"), "c").collect()}
    assert found == {i: 0 for i in range(61)} | {90: 90, 95: 90, 100: 90}


def sizes_of(texts):
    return [len(brute.WORD.findall(t or "")) for t in texts]


def check_mix(rows, texts, sources):
    sizes, by = sizes_of(texts), {}
    for s, n in zip(sources, sizes, strict=True):
        by[s] = by.get(s, 0) + n
    goal, taken = brute.mix_targets(by), Counter()
    for r in rows:
        s = sources[r.doc_id]
        assert r.size == sizes[r.doc_id] and r.source_size == by[s] and math.isclose(r.target, goal[s], rel_tol=1e-12) and 0 <= r.times <= 3
        taken[s] += r.size * r.times
    for s, g in goal.items():
        largest = max(n for t, n in zip(sources, sizes, strict=True) if t == s)
        assert abs(taken[s] - g) <= max(1, largest / 2), s


def test_mix(docs, texts, none):
    sources = [f"src{i % 3}" for i in range(len(texts))]
    check_mix(repeats(docs).collect(), texts, sources)
    assert repeats(none).collect() == []


def test_mix_with_sources_without_words(spark):
    """The weight of a source of empty texts is shared by the others."""
    texts = [prose(i, 2) for i in range(12)] + [None, "", " \n"]
    sources = ["a"] * 12 + ["b"] * 3
    rows = repeats(table(spark, texts, sources)).collect()
    check_mix(rows, texts, sources)
    assert {r.times for r in rows if r.doc_id < 12} == {1}


def test_mix_in_blocks_and_reruns(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 10)
    texts = [prose(i, 1 + i % 5) for i in range(150)]
    sources = [None if i % 9 == 0 else "ab"[i % 2] * (1 + (i > 140)) for i in range(150)]
    docs = table(spark, texts, sources)
    one = sorted((r.doc_id, r.times) for r in repeats(docs).collect())
    assert one == sorted((r.doc_id, r.times) for r in repeats(docs.repartition(9)).collect())
    check_mix(repeats(docs).collect(), texts, sources)
    assert Counter(r.doc_id for r in mix_documents(docs).collect()) == Counter({i: n for i, n in one if n})


def test_mix_of_repeated_rows(repeated, none):
    rows = repeats(repeated).collect()
    assert len(rows) == repeated.count()
    mixed = mix_documents(repeated)
    assert mixed.columns == repeated.columns
    words = sum(sizes_of([r.text for r in mixed.collect()]))
    assert words == sum(r.size * r.times for r in rows)
    assert mix_documents(none).count() == 0


def test_landing_leaves_the_flight_alone_and_comes_near():
    """Of fifty units only those kept for the landing, and the two that the flight leaves, are decided by the landing."""
    rng = np.random.default_rng(4)
    for _ in range(20):
        sizes, p = np.maximum(1, rng.lognormal(5, 1.2, 50)).astype(int), np.full(50, rng.uniform(0.1, 0.9))
        flying = np.setdiff1d(np.arange(50), mixing.reserve(sizes, p))
        flown = p.copy()
        flown[flying] = mixing.fly(p[flying], sizes[flying], rng)
        decided = (flown < 1e-9) | (flown > 1 - 1e-9)
        landed = mixing.land(flown, sizes)
        assert decided.sum() >= 50 - mixing.LANDING - 2 and (landed[decided] == flown[decided].round()).all() and set(landed) <= {0.0, 1.0}
        assert abs((landed * sizes).sum() - (p * sizes).sum()) < 0.02 * (p * sizes).sum()


def test_flight_takes_units_as_often_as_planned():
    rng = np.random.default_rng(6)
    sizes, p, taken = rng.integers(1, 500, 40), rng.uniform(0.1, 0.9, 40), np.zeros(40)
    for _ in range(3000):
        order = rng.permutation(40)
        flown = np.empty(40)
        flown[order] = mixing.fly(p[order], sizes[order], rng)
        taken += flown
    assert np.abs(taken / 3000 - p).max() < 0.04


def test_flight_keeps_both_totals():
    rng = np.random.default_rng(1)
    p, sizes = rng.uniform(0.05, 0.95, 500), rng.integers(1, 3000, 500)
    flown = mixing.fly(p, sizes, rng)
    assert ((flown > 1e-9) & (flown < 1 - 1e-9)).sum() <= 2
    assert math.isclose(flown.sum(), p.sum(), rel_tol=1e-6) and math.isclose((flown * sizes).sum(), (p * sizes).sum(), rel_tol=1e-6)
    assert ((mixing.fly(np.full(9, 0.5), np.full(9, 7), rng) % 1) > 0).sum() <= 2


def test_visits_are_the_likeliest_cells():
    """Against a list of all 3^k cells."""
    rng, r, success = np.random.default_rng(0), 0.9, 0.6
    unit = neighbours._unit(rng.normal(size=(40, 32)))
    a, b = neighbours._tables(32, 1, 5, 5)[0]
    query, code = neighbours.probes(unit, a, b, r, success)
    cell, inside = neighbours._cells(unit, a, b)
    spread = r / neighbours.WIDTH * math.sqrt(2)
    for i in range(40):
        every = []
        for step in itertools.product((-1, 0, 1), repeat=5):
            likely = math.prod((math.erf((d + 1 - x) / spread) - math.erf((d - x) / spread)) / 2 for d, x in zip(step, inside[i], strict=True))
            every.append((-likely, int(neighbours._code((cell[i] + np.array(step))[None])[0])))
        want, reached = set(), 0.0
        for likely, c in sorted(every):
            if reached >= success:
                break
            want.add(c)
            reached -= likely
        assert set(code[query == i].tolist()) == want


def vectors(spark, data, ids=None):
    rows = [(i, v, "x", 1.0) for i, v in zip(ids or range(len(data)), data, strict=True)]
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, rank string, score double")


def exact(data, query, nearest=5):
    a = np.array(data[query], np.float32).astype(np.float64)
    found = []
    for i, v in enumerate(data):
        if i == query or v is None or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        b = np.array(v, np.float32).astype(np.float64)
        found.append((-float((a * b).sum() / (np.sqrt((a * a).sum()) * np.sqrt((b * b).sum()))), i))
    return [(i, -s) for s, i in sorted(found)[:nearest]]


def test_neighbours_recall(spark):
    rng = np.random.default_rng(0)
    data = (rng.normal(size=(1500, 24)) + rng.normal(size=(30, 24))[rng.integers(0, 30, 1500)]).astype(np.float32).tolist()
    rows = nearest_neighbours(vectors(spark, data)).collect()
    hits = 0
    for q in range(0, 1500, 50):
        got = sorted((r.rank, r.vec_id, r.score) for r in rows if r.query_id == q)
        want = dict(exact(data, q, 1500))
        assert [x[0] for x in got] == [1, 2, 3, 4, 5] and all(want[i] == s for _, i, s in got)
        assert [(-s, i) for _, i, s in got] == sorted((-s, i) for _, i, s in got)
        hits += len({i for _, i, _ in got} & {i for i, _ in exact(data, q)})
    assert hits / 150 >= 0.9


def test_neighbours_of_odd_vectors(spark):
    rng = np.random.default_rng(3)
    data = rng.normal(size=(130, 4)).astype(np.float32).tolist()
    data[0] = data[100] = data[7] = data[8]
    for i in range(20, 60):
        data[i] = data[8]
    data[3], data[4], data[5], data[6] = None, [0.0] * 4, [1.0, None, 0.0, 0.0], [float("nan"), 1.0, 0.0, 0.0]
    data[9] = [float("inf"), 0.0, 0.0, 0.0]
    rows = nearest_neighbours(vectors(spark, data)).collect()
    assert {r.query_id for r in rows} == {0, 50, 100}
    for q in (0, 50, 100):
        assert [r.vec_id for r in sorted((r for r in rows if r.query_id == q), key=lambda r: r.rank)] == [i for i, _ in exact(data, q)]


def test_neighbours_of_few(spark):
    empty = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    assert nearest_neighbours(empty).collect() == []
    few = nearest_neighbours(vectors(spark, [[1.0, 0.0], [0.0, 1.0], [-1.0, 0.1]])).collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in sorted(few, key=lambda r: r.rank)] == [(0, 1, 1), (0, 2, 2)]
    assert nearest_neighbours(vectors(spark, [[1.0, 2.0]])).collect() == []


def test_document_order(spark, repeated, docs):
    found, unique = in_document_order(repeated, Workspace(spark, "order"))
    order = found.collect()
    assert len(order) == repeated.count() and not unique
    keys = {(r.doc_id, r.text): r.ord for r in order}
    assert len(set(keys.values())) == len(keys) and max(r.ord for r in order if r.doc_id is None) < min(r.ord for r in order if r.doc_id is not None)
    plain, unique = in_document_order(docs, Workspace(spark, "order"))
    assert unique and all(r.ord == r.doc_id for r in plain.collect())
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")


