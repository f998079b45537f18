import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from simgrove import api, cli
from simgrove.functions import reference_hash as R
from simgrove.operators import evaluate, graph, graph_features, index, search, sequences, simhash, train, training_data
from simgrove.plans import strategy
from simgrove.sources import readers, writers

CONSTANTS = [(0xBA5EBA11BEDABB1E, 0x0E1EC7EDBA11A575), (0xDEADBEEFDEADBEEF, 0x0BADCAFEC0FEC0FE), (0xFEE1DEADFEE1DEAD, 0xCAFED00DCAFED00D), (0x0123456789ABCDEF, 0xFEDCBA9876543210), (0xB105F00DB105F00D, 0xC0DEC0DEC0DEC0DE)]


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def random_hashes(spark, n, seed=0):
    rng = np.random.default_rng(seed)
    rows = [(i, *map(int, rng.integers(-(1 << 63), 1 << 63, 2))) for i in range(1, n + 1)]
    return rows, spark.createDataFrame(rows, "function_id bigint, hash_a bigint, hash_b bigint")


def test_trigrams_run_over_blocks(spark):
    tokens = spark.createDataFrame([("f", i, c) for i, c in enumerate("abcde")] + [("g", 0, "x"), ("g", 1, "y")], "key string, pos int, token string")
    assert [(r.key, r.pos, r.m1 + r.m2 + r.m3) for r in sequences.trigrams(tokens).orderBy("key", "pos").collect()] == [("f", 0, "abc"), ("f", 1, "bcd"), ("f", 2, "cde")]


def test_both_ways_to_number_occurrences_agree(spark):
    rng = random.Random(1)
    rows = [(k, p, rng.choice("ab")) for k in range(3) for p in range(10)]
    df = spark.createDataFrame(rows, "key int, pos int, feature string")
    one = {(r.key, r.feature, r.occurrence) for r in sequences.number_occurrences(df).collect()}
    assert one == {(r.key, r.feature, r.occurrence) for r in sequences.occurrence_counts(df).collect()}


def test_simhash_of_integers_is_order_free(spark):
    rows = [(0, "mnemonic", signed(a), signed(b)) for a, b in CONSTANTS] + [(1, "immediate", 5, -5)]
    features = spark.createDataFrame(rows, "key int, feature_type string, feature_a bigint, feature_b bigint")
    found = {r.key: (r.hash_a, r.hash_b) for r in simhash.simhash128(simhash.with_weights(features.repartition(3))).collect()}
    want = []
    for side in (0, 1):
        word = 0
        for n in range(64):
            if sum(1 if c[side] >> n & 1 else -1 for c in CONSTANTS) >= 0:
                word |= 1 << n
        want.append(signed(word))
    assert found == {0: tuple(want), 1: (5, -5)}
    nothing = features.withColumn("weight", F.lit(0.0)).select("feature_a", "weight")
    assert all(r.hash_a == r.hash_b == -1 for r in simhash.simhash128(simhash.with_weights(features, nothing)).collect())


def small_graphs(n=12, seed=3):
    rng = random.Random(seed)
    return {g: [(rng.randrange(9), rng.randrange(9)) for _ in range(rng.randint(1, 14))] for g in range(n)}


def edge_frame(spark, graphs):
    return spark.createDataFrame([(g, s, d, i) for g, es in graphs.items() for i, (s, d) in enumerate(es)], "graph_id bigint, src bigint, dst bigint, ord int")


def test_graph_operators(spark):
    graphs = small_graphs()
    edges = edge_frame(spark, graphs)
    plain = {g: R.Graph([], es) for g, es in graphs.items()}
    assert {(r.graph_id, r.node) for r in graph.nodes_of(edges).collect()} == {(g, n) for g, p in plain.items() for n in p.nodes}
    assert {(r.graph_id, r.node): (r.out_degree, r.in_degree) for r in graph.degrees(edges).collect()} == {(g, n): (len(p.out[n]), len(p.into[n])) for g, p in plain.items() for n in p.nodes}
    assert {r.graph_id: r.branching for r in graph.branching_nodes(edges).collect()} == {g: sum(len(t) > 1 for t in p.out.values()) for g, p in plain.items()}
    starts = edges.groupBy("graph_id").agg(F.min("src").alias("start"))
    want = {(g, n): d for g, p in plain.items() for n, d in p.hops(min(s for s, _ in graphs[g]), p.out).items()}
    assert {(r.graph_id, r.node): r.hop for r in graph.bfs_order(edges, starts).collect()} == want
    reached = {k: d for k, d in want.items() if 0 <= d <= 3}
    assert {(r.graph_id, r.node): r.hop for r in graph.hops(edges, starts, 3).collect()} == reached
    sizes = {(r.graph_id, r.radius, r.center): r.n for r in graph.balls(edges, 3, 5).groupBy("graph_id", "radius", "center").agg(F.count("*").alias("n")).collect()}
    assert sizes == {(g, k, c): len(b.nodes) for g, p in plain.items() for k in (1, 2, 3) for c in p.nodes if (b := p.ball(c, k, 5))}


def test_walks_have_no_cap(spark):
    """A chain of 41 nodes, a cycle at its end, and a node that nothing leads to."""
    edges = spark.createDataFrame([(0, i, i + 1, i) for i in range(40)] + [(0, 40, 35, 40), (0, 99, 0, 41)], "graph_id int, src bigint, dst bigint, ord int")
    starts = spark.createDataFrame([(0, 0)], "graph_id int, start bigint")
    assert {r.node: r.hop for r in graph.bfs_order(edges, starts).collect()} == {i: i for i in range(41)} | {99: -1}


def test_edges_inside_balls(spark):
    graphs = small_graphs(6)
    edges = edge_frame(spark, graphs)
    found = {(r.graph_id, r.radius, r.center): r.n for r in graph.induced_edges(graph.balls(edges, 2), edges).groupBy("graph_id", "radius", "center").agg(F.count("*").alias("n")).collect()}
    plain = {g: R.Graph([], es) for g, es in graphs.items()}
    assert found == {(g, k, c): n for g, p in plain.items() for k in (1, 2) for c in p.nodes if (n := sum(map(len, p.ball(c, k, 30).out.values())))}


def test_text_hash_equals_the_hash_of_feature_rows(spark):
    rng = random.Random(8)
    texts = [" ".join(rng.choice("abcd") * rng.randint(1, 2) for _ in range(n)) for n in (0, 2, 3, 40, 400)] + [None, "ä  ö\tü\nß ä ö ü"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    want = {tuple(r) for r in simhash.simhash128(simhash.with_weights(sequences.native_features(sequences.text_trigrams(docs)))).collect()}
    assert {tuple(r) for r in simhash.text_simhash(docs).collect()} == want and len(want) == 4


def test_blocks_don_t_change_the_nearest(spark, monkeypatch):
    """Small blocks and turns, equal hashes: the same rows as one block, and as a sweep in plain Python."""
    rows, functions = random_hashes(spark, 60)
    functions = functions.unionByName(spark.createDataFrame([(100 + i, rows[0][1], rows[0][2]) for i in range(9)], functions.schema))
    asked = functions.select(F.col("function_id").alias("query_id"), F.col("hash_a").alias("qa"), F.col("hash_b").alias("qb"))
    held = [(r.function_id, r.hash_a, r.hash_b) for r in functions.collect()]
    want = set()
    for q, a, b in held:
        near = sorted((((a ^ x) & R.MASK).bit_count() + ((b ^ y) & R.MASK).bit_count(), f) for f, x, y in held if f != q)[:5]
        want |= {(q, i + 1, f, d) for i, (d, f) in enumerate(near)}
    whole = {(r.query_id, r.rank, r.function_id, r.distance) for r in search.search_buckets(asked, functions, 5, distinct_ids=True).collect()}
    monkeypatch.setattr(search, "BLOCK", 7)
    monkeypatch.setattr(search, "TURN", 3)
    assert {(r.query_id, r.rank, r.function_id, r.distance) for r in search.search_exact(asked, functions, 5, distinct_ids=True).collect()} == want
    assert {(r.query_id, r.rank, r.function_id, r.distance) for r in search.search_buckets(asked, functions, 5, distinct_ids=True).collect()} == whole


def as_rows(spark, graphs):
    text = [(g, json.dumps({"name": "CFG", "nodes": [{"address": n, "instructions": [{"mnemonic": "mov", "operands": ["EAX", "4001h"]}, {"mnemonic": "jmp", "operands": ["1234567"]}]} for n in sorted({x for e in es for x in e})], "edges": [{"source": s, "destination": d} for s, d in es]})) for g, es in graphs.items()]
    return spark.createDataFrame(text, "graph_id bigint, value string").select("graph_id", readers.parse_graph("value").alias("graph"))


def test_bit_exact_features(spark):
    graphs = {g: [(s + (1 << 63), d + (1 << 63)) for s, d in es] for g, es in small_graphs(5).items()}
    parsed = as_rows(spark, graphs).select("graph_id", "graph.nodes", "graph.edges")
    for r in graph_features.graph_simhash(parsed).collect():
        g = R.Graph([], graphs[r.graph_id])
        want = R.simhash(R.function_features(g, ["mov", "jmp"] * len(g.nodes), [0x4001] * len(g.nodes)))
        assert (r.hash_a & R.MASK, r.hash_b & R.MASK) == want
    assert graph_features.graph_features(parsed, ("mnemonic",)).select("feature_type").distinct().collect()[0][0] == "mnemonic"
    for r in graph_features.whole_graph_hashes(parsed).collect():
        g = R.Graph([], graphs[r.graph_id])
        assert r.address & R.MASK == g.nodes[0] and r.hash & R.MASK == R.structural_hash(g.tuples(g.nodes[0]), R.SEEDS)


def test_graph_json_round_trip_and_missing_keys(spark):
    rows = as_rows(spark, small_graphs(3))
    again = rows.select("graph", readers.parse_graph(writers.graph_json("graph")).alias("again"))
    assert all(sorted(r.graph.nodes) == sorted(r.again.nodes) and r.graph.edges == r.again.edges for r in again.collect())
    broken = ['{"nodes": []}', "{", '{"nodes": [{"address": 1}], "edges": []}', '{"nodes": [], "edges": [{"source": 1}]}', '{"nodes": [], "edges": []}']
    found = spark.createDataFrame([(t,) for t in broken], "t string").select(readers.parse_graph("t").alias("g")).collect()
    assert [r.g is None for r in found] == [True, True, True, True, False]


def test_shared_blocks_and_addresses(spark):
    blocks = spark.createDataFrame([(0, 1, 10), (0, 2, 10), (0, 2, 11), (0, 3, 12), (1, 1, 13)], "file_id int, address bigint, graph_id bigint")
    assert [(r.file_id, r.address) for r in graph.shared_blocks(blocks).collect()] == [(0, 2)]
    assert sorted(r.graph_id for r in graph.without_shared_blocks(blocks).collect()) == [12, 13]
    nodes = spark.createDataFrame([(0, -1), (0, 5), (1, -(1 << 63))], "graph_id int, node bigint")
    assert {r.graph_id: r.address for r in graph.function_addresses(nodes).collect()} == {0: 5, 1: -(1 << 63)}


@pytest.mark.parametrize("permutations", [28, 50])
def test_each_hash_finds_itself_first(spark, permutations):
    functions = spark.createDataFrame([(i + 1, signed(a), signed(b)) for i, (a, b) in enumerate(CONSTANTS)], "function_id bigint, hash_a bigint, hash_b bigint")
    entries = index.index_entries(functions, permutations)
    assert entries.count() == permutations * len(CONSTANTS) and entries.filter("bucket < 0 or bucket > 255").count() == 0
    for mask in (0, 0x0180018001800180, 0x0181018101810181, 0x8101810181018101):
        asked = functions.select(F.col("function_id").alias("query_id"), F.col("hash_a").bitwiseXOR(F.lit(signed(mask))).alias("qa"), F.col("hash_b").bitwiseXOR(F.lit(signed(mask))).alias("qb"))
        found = search.search_buckets(asked, functions, 1, permutations).collect()
        assert len(found) == len(CONSTANTS) and all(r.query_id == r.function_id and r.distance == 2 * mask.bit_count() for r in found)


def test_bucket_search_agrees_with_the_sweep_on_near_hashes(spark):
    rows, functions = random_hashes(spark, 400)
    rng = np.random.default_rng(5)
    turned = [(i, a ^ signed(sum(1 << int(x) for x in rng.choice(64, 10, replace=False))), b ^ signed(sum(1 << int(x) for x in rng.choice(64, 10, replace=False)))) for i, a, b in rows[:200]]
    asked = spark.createDataFrame(turned, "query_id bigint, qa bigint, qb bigint")
    exact = {r.query_id: r.function_id for r in search.search_exact(asked, functions, 1).collect()}
    near = {r.query_id: r.function_id for r in search.search_buckets(asked, functions, 1).collect()}
    assert all(exact[i] == i for i, _, _ in turned)
    assert sum(near.get(i) == i for i in exact) / len(exact) >= 0.99


def test_strategy(spark):
    assert strategy.use_exact(1000, 5_000_000) and not strategy.use_exact(10_000, 5_000_000)
    assert strategy.small(spark.range(5), 5) and not strategy.small(spark.range(6), 5)
    _, functions = random_hashes(spark, 30)
    asked = functions.select(F.col("function_id").alias("query_id"), F.col("hash_a").alias("qa"), F.col("hash_b").alias("qb"))
    plan = search.search_buckets(asked, functions)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan and "Python" not in plan


def test_index_on_disk(spark, tmp_path):
    store = index.SimHashIndex(spark, f"file://{tmp_path}/index", create=True)
    rows = spark.createDataFrame([(7, 100 + i, signed(a), signed(b)) for i, (a, b) in enumerate(CONSTANTS)], "file_id bigint, address bigint, hash_a bigint, hash_b bigint")
    assert store.add(rows) == 5 and store.add(rows) == 5
    assert sorted(r.function_id for r in store.functions.collect()) == list(range(1, 11))
    assert store.stats().first().asDict() == {"entries": 280, "permutations": 28, "functions": 10}
    assert store.dump().count() == 10 and store.dump(True).count() == 280
    with pytest.raises(ValueError):
        index.SimHashIndex(spark, f"file://{tmp_path}/index", buckets=50)


def test_search_index_object(spark, tmp_path):
    a, b = CONSTANTS[1]
    store = api.SimHashSearchIndex(f"file://{tmp_path}/index", True, 28, spark)
    turns = [(0, 0), (3, 0), (7, 0), (15, 0), (31, 3), (31, 7), (31, 15), (31, 31), (63, 31)]
    store.add_functions([(a ^ x, b ^ y, 0x1D, 0x400000 + i) for i, (x, y) in enumerate(turns)])
    found = store.query_top_N(a, b, 9)
    assert found[0] == (128.0, 0x1D, 0x400000) and found[1][0] == 126 and [f[0] for f in found] == sorted((f[0] for f in found), reverse=True)
    assert store.indexed_functions() == 9 and store.odds_of_random_hit(110) > 1e6 and store.odds_of_random_hit(64.0) == 1 / 9
    assert api.distance(a, b, a ^ 3, b ^ 1) == 3


def test_flowgraph_object(spark):
    g = api.FlowgraphWithInstructions()
    data = [(0x5A5F6179, "mov shr xor jz"), (0x5A5F6187, "mov and cmp jz"), (0x5A5F6195, "mov jmp"), (0x5A5F6184, "mov ret"), (0x5A5F6182, "xor")]
    for n, text in data:
        g.add_node(n)
        g.add_instructions(n, [(m, ()) for m in text.split()])
    for e in ((0x5A5F6179, 0x5A5F6187), (0x5A5F6179, 0x5A5F6182), (0x5A5F6182, 0x5A5F6184), (0x5A5F6187, 0x5A5F6184), (0x5A5F6187, 0x5A5F5195)):
        g.add_edge(*e)
    assert g.size() == 6 and g.number_of_branching_nodes() == 2
    hasher = api.SimHasher(spark=spark)
    one = hasher.calculate_hash(g)
    copy = api.FlowgraphWithInstructions()
    assert copy.from_json(g.to_json()) and not copy.from_json('{"nodes": []}')
    assert hasher.calculate_hash(copy) == one
    g.add_edge(0, data[0][0])
    assert 1 - api.distance(*one, *hasher.calculate_hash(g)) / 128 > 0.7


def test_metadata_and_reports(spark):
    found = spark.createDataFrame([(0, 1, 128, 1), (0, 2, 110, 2), (0, 3, 90, 3)], "query_id int, function_id bigint, similarity int, rank int")
    functions = spark.createDataFrame([(1, 7, 100), (2, 7, 101), (3, 8, 5)], "function_id bigint, file_id bigint, address bigint")
    metadata = spark.createDataFrame([(7, 100, "a.so", "f", True)], "file_id bigint, address bigint, file_name string, function_name string, vulnerable boolean")
    named = {r.function_id: (r.file_name, r.function_name, r.vulnerable) for r in search.with_metadata(search.at_least(found), functions, metadata).collect()}
    assert named == {1: ("a.so", "f", True), 2: ("a.so", None, None)}
    assert [r.s for r in found.select(search.report_scale("similarity").alias("s")).collect()] == [1.0, 0.71875, 0.40625]
    best = spark.createDataFrame([("k", p, s) for p, s in enumerate([120, 110, 90, 128, 104, 105, 106])], "key string, position int, similarity int")
    assert sorted((r.first, r.last, r.length) for r in search.consecutive_matches(best).collect()) == [(0, 1, 2), (3, 3, 1), (5, 6, 2)]
    odds = {r.equal_bits: r.odds for r in search.odds_table(spark, 10).collect()}
    assert odds[64] == 0.1 and odds[128] == float("inf") and odds[80] == odds[48]


def test_training_pairs(spark):
    members = spark.createDataFrame([(i, i % 4) for i in range(40)], "key bigint, family int")
    assert training_data.attraction_pairs(members).count() == 4 * 45 and training_data.attraction_pairs(members, 10).count() == 10
    chain = training_data.chain_pairs(members).collect()
    assert len(chain) == 36 and all(r.a < r.b and r.a % 4 == r.b % 4 for r in chain)
    assert all(r.a < r.b and r.a % 4 != r.b % 4 for r in training_data.repulsion_pairs(members, blocks=2).collect())
    assert training_data.seen_split(members).filter("validation").count() == 4
    assert training_data.split_families(members).select("family", "validation").distinct().count() == 4
    assert training_data.families(members.limit(7), 2).count() <= 4


def test_loss_gradient():
    rng = np.random.default_rng(0)
    x, y, attract = rng.normal(size=(6, 128)), rng.normal(size=(6, 128)), np.array([True, False] * 3)
    loss, dx, dy = train.pair_loss(x, y, attract)
    step = 1e-6
    for i, j in ((0, 3), (1, 7), (5, 127)):
        for d, g in ((x, dx), (y, dy)):
            d[i, j] += step
            up = train.pair_loss(x, y, attract)[0][i]
            d[i, j] -= 2 * step
            down = train.pair_loss(x, y, attract)[0][i]
            d[i, j] += step
            assert abs((up - down) / (2 * step) - g[i, j]) < 1e-5


@pytest.mark.parametrize("solver", [train.lbfgs, train.sgd])
def test_solvers_find_a_bowl(solver):
    scale = np.array([1.0, 4.0, 9.0])
    w = solver(lambda v: (float((scale * (v - 2) ** 2).sum()) + 1.5, 2 * scale * (v - 2)), np.zeros(3), 200)
    assert np.abs(w - 2).max() < 0.2


def test_attraction_pulls_a_pair_together(spark):
    rng = np.random.default_rng(2)
    words = [(signed(int(a)), signed(int(b))) for a, b in rng.integers(0, 1 << 64, (7, 2), dtype=np.uint64)]
    features = spark.createDataFrame([("f", *w) for w in words[:5]] + [("g", *w) for w in words[2:]], "key string, feature_a bigint, feature_b bigint")
    pair = spark.createDataFrame([("f", "g")], "a string, b string")

    def apart(weights):
        hashes = simhash.simhash128(simhash.with_weights(features, weights, typed=False))
        return evaluate.pair_distances(pair, hashes).first().distance

    learnt = train.train(features, pair, pair.limit(0), steps=25)
    assert apart(learnt) < apart(None) and apart(learnt) <= 8
    assert learnt.count() == 7


def test_histograms_and_roc(spark):
    rows = [("f", d, d < 5) for d in range(10)] + [("g", 3, True)]
    found = spark.createDataFrame(rows, "family string, distance int, relevant boolean")
    curve = {r.threshold: r for r in evaluate.roc(found, spark).collect()}
    assert len(curve) == 128 and curve[4].tpr == 1.0 and curve[4].irr == 0.0 and curve[127].fpr == 1.0 and curve[0].tpr == pytest.approx(0.1)
    totals = spark.createDataFrame([("f", 10, 20), ("g", 2, 4), ("h", 1, 1)], "family string, all_good int, all_bad int")
    some = evaluate.roc(found, spark, totals).filter("threshold = 4").first()
    assert some.tpr == pytest.approx((5 / 10 + 1 / 2 + 0) / 3) and some.fpr == 0.0 and some.irr == 0.0
    hashes = spark.createDataFrame([(0, 0, 0), (1, 3, 0), (2, 7, 1)], "key int, hash_a bigint, hash_b bigint")
    assert evaluate.distance_statistics(hashes).first().asDict() == {"least": 2, "mean": pytest.approx(8 / 3), "most": 4}
    assert evaluate.distance_matrix(hashes).filter("a = b and distance <> 0").count() == 0


def write(path, text):
    path.write_text(text)
    return f"file://{path}"


def test_text_files(spark, tmp_path):
    name = "00000000000000aa:0000000000000001"
    functions = write(tmp_path / "functions.txt", f"{name} {'0' * 31}1 {'0' * 31}2 \n00000000000000aa:0000000000000002 {'0' * 31}2\n")
    write(tmp_path / "attract.txt", "00000000000000aa:0000000000000001 00000000000000aa:0000000000000002\n")
    rows = readers.read_functions(spark, functions).orderBy("address", "pos").collect()
    assert [(r.file_id, r.address, r.pos, r.feature_b) for r in rows] == [(170, 1, 0, 1), (170, 1, 1, 2), (170, 2, 0, 2)]
    assert readers.feature_set(readers.read_functions(spark, functions)).count() == 2
    features, attract, repulse = readers.load_training_set(spark, f"file://{tmp_path}")
    assert features.count() == 3 and attract.first().asDict() == {"a": "AA:1", "b": "AA:2"} and repulse.count() == 0
    weights = write(tmp_path / "weights.txt", f"{'0' * 15}1{'0' * 16} 0.5\n000000000000000f 2.5\nx\naa.{'0' * 15}1{'f' * 16} 0.25\n")
    assert {r.feature_a: r.weight for r in readers.read_weights(spark, weights).collect()} == {1: 0.25, 15: 2.5}
    meta = spark.createDataFrame([(-1, "lib name.so".replace(" ", "_"), 16, "int main(void)", True)], "file_id bigint, file_name string, address bigint, function_name string, vulnerable boolean")
    path = write(tmp_path / "index.meta", writers.metadata_lines(meta).first().value + "\nbroken line\n")
    assert readers.read_metadata(spark, path).collect() == meta.collect()
    dump = spark.createDataFrame([(0, -1, 2, 3, 4)], "perm int, hash_a bigint, hash_b bigint, file_id bigint, address bigint")
    path = write(tmp_path / "dump.txt", "[!] header\nperm hashA hashB\n\n" + writers.index_dump_lines(dump).first().value + "\n")
    assert readers.read_index_dump(spark, path).collect() == dump.collect()


def test_executables_and_dot(spark, tmp_path):
    g = {"name": "a", "nodes": [{"address": 2, "instructions": [{"mnemonic": "mov", "operands": ["EAX", "5h"]}]}], "edges": [{"source": 2, "destination": 3}]}
    path = write(tmp_path / "exe.json", json.dumps({"flowgraphs": [g, g]}))
    found = readers.read_executable(spark, path)
    assert [r.position for r in found.collect()] == [0, 1]
    lines = writers.dot_lines(edge_frame(spark, {0: [(2, 3), (3, 255)]})).first().value
    assert lines == "digraph G {\n  blk_2 -> blk_3;\n  blk_3 -> blk_ff;\n}\n"
    listing = writers.disassembly(spark.createDataFrame([(0, 255, [("mov", ["EAX", "1"]), ("ret", [])])], "graph_id bigint, address bigint, instructions array<struct<mnemonic:string,operands:array<string>>>")).first().value
    assert listing == "[ff]\n\t[ff] (2)\n\t\tmov EAX, 1\n\t\tret "
    assert readers.find_files(spark, f"file://{tmp_path}", "*.json").count() == 1


def test_symbol_listings(spark):
    elf = spark.createDataFrame([("0000000000001234 g     F .text\t0000000000000010              main",), ("0000000000001234 g     O .data\t0000000000000010 x",)], "value string")
    assert [(r.address, r.name) for r in readers.elf_symbols(elf).collect()] == [(0x1234, "main")]


def test_command_line(spark, tmp_path, capsys):
    g = {"name": "a", "nodes": [{"address": n, "instructions": [{"mnemonic": "mov", "operands": []}]} for n in range(1, 9)], "edges": [{"source": n, "destination": d} for n in range(1, 8) for d in (n + 1, 1)]}
    path, at = write(tmp_path / "exe.json", json.dumps({"flowgraphs": [g]})), f"file://{tmp_path}/index"
    cli.main(["createfunctionindex", "--index", at], spark)
    cli.main(["addfunctionstoindex", "--index", at, "--input", path], spark)
    cli.main(["functionfingerprints", "--input", path], spark)
    printed = capsys.readouterr().out.split("\n")
    assert printed[0] == "1 functions added"
    cli.main(["queryindexforhash", "--index", at, "--hash", printed[1].split()[1]], spark)
    cli.main(["matchfunctionsfromindex", "--index", at, "--input", path], spark)
    out = capsys.readouterr().out.strip().split("\n")
    assert out[0].startswith("128 ") and " 128 " in out[1]
    for command in (["graphhashes"], ["disassemble"], ["dumpsinglefunctionfeatures"], ["visualizeflowgraphs"], ["functionfingerprints", "--verbose", "--disable_graphs"]):
        cli.main([*command, "--input", path], spark)
        assert capsys.readouterr().out.strip()
    for command in ("dumpfunctionindex", "dumpfunctionindexinfo", "growfunctionindex"):
        cli.main([command, "--index", at], spark)
    cli.main(["stemsymbol", "--symbol", "void f(void)"], spark)
    assert capsys.readouterr().out.strip().endswith("f()")


def test_sql_functions(spark):
    api.register_functions(spark)
    row = spark.sql("SELECT hamming128(1L, 0L, 2L, 4L) AS d, hex128(1L, -1L) AS h, is_useful_immediate(11L) AS u, immediate_words('[ECX + 4]') AS w").first()
    assert row.asDict() == {"d": 3, "h": "0" * 15 + "1" + "f" * 16, "u": True, "w": ["4"]}


def test_streams(spark, tmp_path):
    from simgrove.streaming.ingest import ingest, match

    rows = [(7, i, signed(a), signed(b)) for i, (a, b) in enumerate(CONSTANTS)]
    schema = "file_id bigint, address bigint, hash_a bigint, hash_b bigint"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/in")
    store = index.SimHashIndex(spark, f"file://{tmp_path}/index", create=True)
    ingest(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), store, f"{tmp_path}/c1").awaitTermination()
    functions = spark.read.parquet(f"{tmp_path}/index/stream/functions")
    assert functions.count() == 5 and spark.read.parquet(f"{tmp_path}/index/stream/entries").count() == 140
    asked = spark.readStream.schema(schema).parquet(f"{tmp_path}/in").select(F.col("address").alias("query_id"), F.col("hash_a").alias("qa"), F.col("hash_b").alias("qb"))
    match(asked, functions, f"{tmp_path}/out", f"{tmp_path}/c2", 1).awaitTermination()
    assert [r.distance for r in spark.read.parquet(f"{tmp_path}/out").collect()] == [0] * 5


def test_nearest_by_strips_equals_sorting(monkeypatch):
    """Functions go by in strips, and of a strip only what is nearer than the n-th so far is ranked."""
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(search, "TURN", 7)
    monkeypatch.setattr(search, "STRIP", 48)
    rng = np.random.default_rng(3)
    words = rng.integers(-(2**63), 2**63 - 1, (400, 2))
    words[:150] = words[0]
    ids = rng.permutation(400)
    functions = pa.table({"function_id": ids, "hash_a": words[:, 0], "hash_b": words[:, 1]})
    queries = pa.table({"query_id": ids[100:200], "qa": words[100:200, 0], "qb": words[100:200, 1]})
    for n in (1, 5, 60, 1000):
        for distinct in (True, False):
            found = sorted(tuple(r.values()) for r in search._nearest(queries, functions, n, distinct).to_pylist())
            expected = []
            for i in range(100, 200):
                apart = np.bitwise_count(words[i].view(np.uint64) ^ words.view(np.uint64)).sum(axis=1)
                ranked = sorted((int(d), int(f)) for d, f in zip(apart, ids, strict=True) if not distinct or f != ids[i])
                expected += [(int(ids[i]), f, d) for d, f in ranked[:n]]
            assert found == sorted(expected)


def test_least_hashes_of_pairs_in_blocks(spark, monkeypatch):
    """Each pair of a family is hashed once, in blocks; the first of each set equal a sort of all pairs by MD5."""
    import hashlib

    monkeypatch.setattr(training_data, "BLOCK", 7)
    monkeypatch.setattr(training_data, "TURN", 40)
    rng = random.Random(4)
    for make in (lambda i: i * 37, lambda i: "k" * (i % 3 * 20) + str(i)):
        rows = [(make(i), rng.choice("abc"), rng.random() < 0.3) for i in range(90)]
        split = spark.createDataFrame(rows, f"key {'bigint' if isinstance(rows[0][0], int) else 'string'}, family string, validation boolean")
        for across in (False, True):
            found = {(r.validation, r.a, r.b) for r in training_data.training_sets(split, 40, across).filter("attract").collect()}
            expected = set()
            for wanted in (False, True):
                fits = (lambda v, w: v == w == wanted) if not across else (lambda v, w: (v != w) if wanted else not v and not w)
                pairs = [(x, y) for x, f, v in rows for y, g, w in rows if f == g and x < y and fits(v, w)]
                pairs.sort(key=lambda p: (hashlib.md5(f"attract:{p[0]}:{p[1]}".encode()).hexdigest(), p))
                expected |= {(wanted, *p) for p in pairs[:40]}
            assert found == expected and len(found) == 80


def test_weighted_text_simhash_equals_sums_of_feature_rows(spark, monkeypatch):
    """As simhash128 over feature rows and a join with weights; features leave no row in a shuffle."""
    monkeypatch.setattr(simhash, "SLICE", 3)
    monkeypatch.setattr(simhash, "GROUP", 4)
    monkeypatch.setattr(simhash, "UNPACKED", 5)
    rng = random.Random(6)
    texts = [None, "", "one two", "a b c", "a a a a a a", *[" ".join(rng.choice("abcdef") for _ in range(rng.randint(3, 60))) for _ in range(30)]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    features = sequences.native_features(sequences.text_trigrams(docs))
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(simhash.text_features(docs)) == rows(features.select("key", "feature_a", "feature_b"))
    some = features.filter("feature_a % 3 = 0").select("feature_a", ((F.abs("feature_a") % 5000) / 1000 - 2).alias("weight"))
    for weights in (some.unionByName(some), some.limit(0)):
        expected = simhash.simhash128(simhash.with_weights(features, weights.distinct()))
        found = simhash.weighted_text_simhash(docs, weights)
        assert rows(found) == rows(expected) and found.count() == 32
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "feature_b" not in plan and "hashpartitioning(key" not in plan
    assert simhash.weighted_text_simhash(docs.limit(0), some).count() == 0
