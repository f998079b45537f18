"""Registered queries: every operator on the driver's tables, and the SQL that gives the same rows.

Stand-ins: words of documents and events of users are instruction sequences; a user's events, by type and
six-hour slot, are nodes of a flow graph; embeddings are float states and labelled families.
Words of 64 bits leave as 16 hex digits, doubles are rounded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.bits import hex64, hex128, parse_feature_hash
from .functions.immediates import extract_immediates, is_useful
from .functions.symbols import decode_name, file_id, normalise_symbol
from .operators import evaluate, graph, index, search, sequences, simhash, train, training_data
from .plans.permutation import bucket_positions
from .plans.strategy import kept

PERMUTATIONS = 28
ROUND = 6


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- inputs ------------------------------------------------------------------------------------------------


def document_features(spark, sf_dir):
    return sequences.native_features(sequences.text_trigrams(table(spark, sf_dir, "documents")))


def document_hashes(spark, sf_dir) -> DataFrame:
    """key, hash_a, hash_b of documents of three words or more."""
    return simhash.text_simhash(table(spark, sf_dir, "documents"))


def vector_hashes(spark, sf_dir) -> DataFrame:
    """vec_id, hash_a (signs of the 64 floats), label."""
    e = table(spark, sf_dir, "embeddings")
    return simhash.floats_to_words(e, "vec_id", "embedding").join(e.select("vec_id", "label"), "vec_id").select("vec_id", F.col("word0").alias("hash_a"), "label")


def user_edges(spark, sf_dir) -> DataFrame:
    """graph_id (user), src, dst, ord. A node's number: 24 bits by event type, times 6, plus the slot of the day."""
    e = table(spark, sf_dir, "events")
    kind = F.conv(F.substring(F.md5("event_type"), 1, 6), 16, 10).cast("bigint")
    return graph.consecutive_edges(e.withColumn("node", kind * 6 + F.floor(F.hour("ts") / 4)), "user_id", "node", "ts", "event_id")


def members(spark, sf_dir) -> DataFrame:
    """key, family: vectors and their labels."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("key"), F.col("label").alias("family"))


def vector_keys(spark, sf_dir) -> DataFrame:
    return vector_hashes(spark, sf_dir).select(F.col("vec_id").alias("key"), "hash_a", F.lit(0).cast("bigint").alias("hash_b"))


# --- SQL building blocks -------------------------------------------------------------------------------------

_WORDS = r"""docwords AS (SELECT doc_id, regexp_extract_all(text, '[^ \t\r\n]+') AS w FROM documents)"""
_GRAMS = (
    _WORDS
    + """, grams AS (
  SELECT doc_id AS key, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: {'pos': i - 1, 'm1': w[i], 'm2': w[i + 1], 'm3': w[i + 2]}) ELSE [] END) AS g
  FROM docwords)"""
)
_FEATURES = (
    _GRAMS
    + """, counted AS (SELECT key, g.m1 || ' ' || g.m2 || ' ' || g.m3 AS feature, row_number() OVER (PARTITION BY key, g.m1 || ' ' || g.m2 || ' ' || g.m3 ORDER BY g.pos) - 1 AS occurrence FROM grams),
digests AS (SELECT key, occurrence, feature, md5('mnemonic:' || feature || '#' || occurrence) AS h FROM counted),
features AS (SELECT key, feature, occurrence, ('0x' || substr(h, 1, 16))::UBIGINT AS a, ('0x' || substr(h, 17, 16))::UBIGINT AS b FROM digests)"""
)
_SUMS = ", ".join(f"sum(CASE WHEN ({'a' if n < 64 else 'b'} >> {n % 64}) & 1 = 1 THEN 50000 ELSE -50000 END) AS s{n}" for n in range(128))
_STATES = _FEATURES + f", states AS (SELECT key, {_SUMS} FROM features GROUP BY key)"


def _pack_sql(first: int) -> str:
    return " | ".join(f"(CASE WHEN s{first + n} >= 0 THEN {1 << n}::UBIGINT ELSE 0::UBIGINT END)" for n in range(64))


_HASHES = _STATES + f", hashes AS (SELECT key, {_pack_sql(0)} AS a, {_pack_sql(64)} AS b FROM states)"
_FLOATS = " | ".join(f"(CASE WHEN embedding[{n + 1}] >= 0 THEN {1 << n}::UBIGINT ELSE 0::UBIGINT END)" for n in range(64))
_VECTORS = f"vectors AS (SELECT vec_id, label, {_FLOATS} AS a FROM embeddings)"
_EDGES = """seq AS (
  SELECT user_id, event_id, ts, ('0x' || substr(md5(event_type), 1, 6))::BIGINT * 6 + hour(ts) // 4 AS node FROM events),
steps AS (SELECT user_id, node AS src, lead(node) OVER w AS dst, row_number() OVER w AS spot FROM seq WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
firsts AS (SELECT user_id, src, dst, min(spot) AS spot FROM steps WHERE dst IS NOT NULL AND dst <> src GROUP BY ALL),
edges AS (SELECT user_id AS graph_id, src, dst, row_number() OVER (PARTITION BY user_id ORDER BY spot) - 1 AS ord FROM firsts),
ends AS (SELECT graph_id, src AS node, 1 AS o, 0 AS i FROM edges UNION ALL SELECT graph_id, dst, 0, 1 FROM edges),
degrees AS (SELECT graph_id, node, sum(o) AS out_degree, sum(i) AS in_degree FROM ends GROUP BY ALL)"""


def _bucket_sql(positions) -> str:
    return " | ".join(f"((({'a' if p >= 64 else 'b'} >> {p % 64}) & 1) << {7 - i})" for i, p in enumerate(positions))


_ENTRIES = "entries AS (" + " UNION ALL ".join(f"SELECT key, a, b, {k} AS perm, CAST({_bucket_sql(p)} AS INTEGER) AS bucket FROM hashes" for k, p in enumerate(bucket_positions(PERMUTATIONS))) + ")"
_DISTANCE = "bit_count(xor(x.a, y.a)) + bit_count(xor(x.b, y.b))"
_FOUND = _HASHES + ", " + _ENTRIES + f""", found AS (
  SELECT x.key AS query_id, y.key AS function_id, min({_DISTANCE}) AS distance
  FROM entries x JOIN entries y ON x.perm = y.perm AND x.bucket = y.bucket AND x.key <> y.key GROUP BY ALL),
best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, function_id) AS rank FROM found QUALIFY rank <= 5)"""


def _hex(x: str) -> str:
    return f"lpad(lower(hex({x})), 16, '0')"


QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def big(column) -> Column:
    return (F.col(column) if isinstance(column, str) else column).cast("bigint")


# --- sequences -----------------------------------------------------------------------------------------------


@query(f"WITH {_GRAMS} SELECT key AS doc_id, CAST(g.pos AS BIGINT) AS pos, g.m1 AS m1, g.m2 AS m2, g.m3 AS m3 FROM grams")
def token_trigrams(spark, sf_dir):
    return sequences.text_trigrams(table(spark, sf_dir, "documents")).select(F.col("key").alias("doc_id"), big("pos").alias("pos"), "m1", "m2", "m3")


@query("""SELECT user_id, CAST(pos AS BIGINT) AS pos, m1, m2, m3 FROM (
  SELECT user_id, row_number() OVER w - 1 AS pos, event_type AS m1, lead(event_type, 1) OVER w AS m2, lead(event_type, 2) OVER w AS m3
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE m3 IS NOT NULL""")
def event_trigrams(spark, sf_dir):
    grams = sequences.trigrams(table(spark, sf_dir, "events"), "user_id", ("ts", "event_id"), "event_type")
    return grams.select("user_id", big("pos").alias("pos"), "m1", "m2", "m3")


@query(f"WITH {_FEATURES} SELECT key AS doc_id, CAST(occurrence AS BIGINT) AS occurrence, {_hex('a')} || {_hex('b')} AS feature FROM features")
def feature_occurrence(spark, sf_dir):
    return document_features(spark, sf_dir).select(F.col("key").alias("doc_id"), big("occurrence").alias("occurrence"), hex128("feature_a", "feature_b").alias("feature"))


_OPERANDS = r"""operands AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^ \t\r\n]+')) AS operand FROM documents),
matched AS (SELECT doc_id, operand, regexp_extract_all(operand, '(?:[^0-9A-Za-z_]|0x|^)([[:xdigit:]]+)(?:h|[^0-9A-Za-z_]|$)', 0) AS w,
  regexp_extract_all(operand, '(?:[^0-9A-Za-z_]|0x|^)([[:xdigit:]]+)(?:h|[^0-9A-Za-z_]|$)', 1) AS g FROM operands),
paired AS (SELECT doc_id, operand, unnest(list_zip(w, g)) AS m, generate_subscripts(w, 1) AS spot FROM matched WHERE len(w) > 0),
texts AS (SELECT doc_id, operand, spot, 0 AS side, m[1] AS t FROM paired UNION ALL SELECT doc_id, operand, spot, 1, m[2] FROM paired),
numbers AS (SELECT doc_id, operand, spot, side, regexp_extract(t, '^\s*([-+]?)', 1) AS sign, regexp_extract(regexp_replace(t, '^(\s*[-+]?)0[xX]([[:xdigit:]])', '\1\2'), '^\s*[-+]?0*([[:xdigit:]]*)', 1) AS digits FROM texts),
words AS (SELECT doc_id, sign, ('0x' || CASE WHEN length(digits) > 16 THEN 'ffffffffffffffff' WHEN digits = '' THEN '0' ELSE digits END)::UBIGINT AS v, length(digits) > 16 AS most FROM numbers),
vals AS (SELECT doc_id, CASE WHEN sign = '-' AND NOT most AND v <> 0 THEN xor(v, 18446744073709551615::UBIGINT) + 1 ELSE v END AS v FROM words WHERE v <> 0)"""


@query(f"WITH {_OPERANDS} SELECT doc_id, {_hex('v')} AS value FROM vals GROUP BY ALL")
def extract_constants(spark, sf_dir):
    """Distinct constants of each document's words."""
    found = sequences.text_tokens(table(spark, sf_dir, "documents")).select(F.col("key").alias("doc_id"), F.explode(extract_immediates("token")).alias("v"))
    return found.select("doc_id", hex64("v").alias("value")).distinct()


@query(f"""WITH {_OPERANDS} SELECT doc_id, {_hex('v')} AS value FROM vals
  WHERE (v > 16384 AND v < 18446744073709535232::UBIGINT) OR (v % 4 <> 0 AND v > 10) GROUP BY ALL""")
def constant_filter(spark, sf_dir):
    found = sequences.text_tokens(table(spark, sf_dir, "documents")).select(F.col("key").alias("doc_id"), F.explode(extract_immediates("token")).alias("v"))
    return found.filter(is_useful("v")).select("doc_id", hex64("v").alias("value")).distinct()


@query("""WITH g AS (SELECT user_id, event_type || ' ' || lead(event_type, 1) OVER w || ' ' || lead(event_type, 2) OVER w AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
k AS (SELECT user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS v FROM events)
SELECT 'mnemonic' AS feature_type, count(*) AS features FROM g WHERE f IS NOT NULL
UNION ALL SELECT 'immediate', count(*) FROM k WHERE v % 4 <> 0 AND v > 10 OR v > 16384""")
def feature_toggle_counts(spark, sf_dir):
    """Features left when graphs are switched off."""
    e = table(spark, sf_dir, "events")
    grams = sequences.trigrams(e, "user_id", ("ts", "event_id"), "event_type").select(F.lit("mnemonic").alias("feature_type"))
    value = F.get_json_object("props", "$.k").cast("bigint")
    constants = e.select(value.alias("v")).filter(is_useful("v")).select(F.lit("immediate").alias("feature_type"))
    graphs = user_edges(spark, sf_dir).select(F.lit("graphlet").alias("feature_type"))
    every = graph.union_all([grams, constants, graphs])
    return sequences.use_features(every, graphs=False).groupBy("feature_type").agg(F.count(F.lit(1)).alias("features"))


@query("""WITH s AS (SELECT user_id, ts, event_id, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS block FROM events)
SELECT user_id, CAST(coalesce(block, 0) AS BIGINT) AS block, count(*) AS size FROM s GROUP BY ALL""")
def block_splitting(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.struct("ts", "event_id").alias("pos"), F.col("event_type").alias("mnemonic"))
    return sequences.split_blocks_after_calls(e, ("purchase",)).groupBy(F.col("key").alias("user_id"), big("block").alias("block")).agg(F.count(F.lit(1)).alias("size"))


# --- SimHash -------------------------------------------------------------------------------------------------


@query(f"WITH {_STATES} SELECT key AS doc_id, {', '.join(f's{n}::BIGINT AS s{n}' for n in range(128))} FROM states")
def weighted_state(spark, sf_dir):
    return simhash.bit_sums(simhash.with_weights(document_features(spark, sf_dir))).withColumnRenamed("key", "doc_id")


@query(f"WITH {_HASHES} SELECT key AS doc_id, {_hex('a')} || {_hex('b')} AS simhash FROM hashes")
def simhash_documents(spark, sf_dir):
    return document_hashes(spark, sf_dir).select(F.col("key").alias("doc_id"), hex128("hash_a", "hash_b").alias("simhash"))


_LEARNT = _FEATURES + """, learnt AS (SELECT a, 50000 + 1000 * CAST(a % 1000 AS BIGINT) AS micro FROM features WHERE a % 2 = 0 GROUP BY a),
w AS (SELECT f.key, f.a, f.b, coalesce(l.micro, 50000) AS micro FROM features f LEFT JOIN learnt l ON l.a = f.a)"""


def _learnt_weights(features: DataFrame, distinct: bool = True) -> DataFrame:
    """feature_a, weight: made from the ids of every second feature; distinct: one row each."""
    rest = F.pmod(F.col("feature_a"), F.lit(1000).cast("bigint"))
    # The remainder of the unsigned word: 2^64 leaves 616.
    unsigned = F.when(F.col("feature_a") < 0, F.pmod(rest + 616, F.lit(1000))).otherwise(rest)
    names = features.filter(F.col("feature_a").bitwiseAND(F.lit(1).cast("bigint")) == 0).select("feature_a")
    return (names.distinct() if distinct else names).select("feature_a", (0.05 + 0.001 * unsigned).alias("weight"))


@query(f"WITH {_LEARNT}, states AS (SELECT key, {', '.join(f'''sum(CASE WHEN ({'a' if n < 64 else 'b'} >> {n % 64}) & 1 = 1 THEN micro ELSE -micro END) AS s{n}''' for n in range(128))} FROM w GROUP BY key) SELECT key AS doc_id, {_hex(_pack_sql(0))} || {_hex(_pack_sql(64))} AS simhash FROM states")
def simhash_with_weights(spark, sf_dir):
    """Learnt weights (here made from the ids of every second feature), looked up by the first word."""
    docs = table(spark, sf_dir, "documents")
    hashed = simhash.weighted_text_simhash(docs, _learnt_weights(simhash.text_features(docs), distinct=False))
    return hashed.select(F.col("key").alias("doc_id"), hex128("hash_a", "hash_b").alias("simhash"))


@query(f"WITH {_VECTORS} SELECT vec_id, {_hex('a')} AS word FROM vectors")
def floats_to_bits(spark, sf_dir):
    return vector_hashes(spark, sf_dir).select("vec_id", hex64("hash_a").alias("word"))


@query(f"WITH {_VECTORS} SELECT x.vec_id AS a, y.vec_id AS b, CAST(bit_count(xor(x.a, y.a)) AS BIGINT) AS distance FROM vectors x JOIN vectors y ON x.label = y.label AND x.vec_id < y.vec_id")
def hamming_pairs(spark, sf_dir):
    """Distances of all pairs of one family."""
    pairs = training_data.attraction_pairs(members(spark, sf_dir))
    return evaluate.pair_distances(pairs, vector_keys(spark, sf_dir)).select("a", "b", big("distance").alias("distance"))


# --- graphs --------------------------------------------------------------------------------------------------


@query(f"WITH {_EDGES} SELECT graph_id, src, dst, CAST(ord AS BIGINT) AS ord FROM edges")
def graph_edges(spark, sf_dir):
    return user_edges(spark, sf_dir).select("graph_id", "src", "dst", big("ord").alias("ord"))


@query(f"WITH {_EDGES} SELECT DISTINCT graph_id, node FROM ends")
def graph_nodes(spark, sf_dir):
    return graph.nodes_of(user_edges(spark, sf_dir))


@query(f"WITH {_EDGES} SELECT graph_id, node, CAST(out_degree AS BIGINT) AS out_degree, CAST(in_degree AS BIGINT) AS in_degree FROM degrees")
def graph_degrees(spark, sf_dir):
    return graph.degrees(user_edges(spark, sf_dir))


@query("SELECT l_orderkey AS node, count(*) AS out_degree FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def order_part_degrees(spark, sf_dir):
    """Branching nodes of the order-part graph."""
    edges = table(spark, sf_dir, "lineitem").select(F.lit(0).alias("graph_id"), F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"))
    return edges.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("out_degree")).filter("out_degree > 1")


@query(f"WITH {_EDGES} SELECT graph_id, CAST(sum(CASE WHEN out_degree > 1 THEN 1 ELSE 0 END) AS BIGINT) AS branching FROM degrees GROUP BY ALL")
def branching_nodes(spark, sf_dir):
    return graph.branching_nodes(user_edges(spark, sf_dir))


_STARTS = "starts AS (SELECT graph_id, min(src) AS start FROM edges GROUP BY ALL)"


@query(f"""WITH RECURSIVE {_EDGES}, {_STARTS}, sizes AS (SELECT graph_id, count(DISTINCT node) AS n FROM ends GROUP BY ALL), walk(graph_id, start, node, hop) AS (
  SELECT graph_id, start, start, 0 FROM starts UNION SELECT w.graph_id, w.start, e.dst, w.hop + 1 FROM walk w JOIN edges e ON e.graph_id = w.graph_id AND e.src = w.node JOIN sizes s ON s.graph_id = w.graph_id WHERE w.hop < s.n),
reached AS (SELECT graph_id, start, node, min(hop) AS hop FROM walk GROUP BY ALL)
SELECT n.graph_id, s.start, n.node, CAST(coalesce(r.hop, -1) AS BIGINT) AS hop FROM (SELECT DISTINCT graph_id, node FROM ends) n JOIN starts s USING (graph_id) LEFT JOIN reached r ON r.graph_id = n.graph_id AND r.node = n.node""")
def bfs_order(spark, sf_dir):
    edges = user_edges(spark, sf_dir)
    starts = edges.groupBy("graph_id").agg(F.min("src").alias("start"))
    return graph.bfs_order(edges, starts).select("graph_id", "start", "node", big("hop").alias("hop"))


@query(f"""WITH {_EDGES}, u AS (SELECT graph_id, src, dst FROM edges UNION SELECT graph_id, dst, src FROM edges),
h0 AS (SELECT DISTINCT graph_id, node AS center, node, 0 AS hop FROM ends),
h1 AS (SELECT * FROM h0 UNION ALL SELECT h.graph_id, center, dst, 1 FROM h0 h JOIN u ON u.graph_id = h.graph_id AND u.src = h.node),
m1 AS (SELECT graph_id, center, node, min(hop) AS hop FROM h1 GROUP BY ALL),
h2 AS (SELECT * FROM m1 UNION ALL SELECT h.graph_id, center, dst, 2 FROM m1 h JOIN u ON u.graph_id = h.graph_id AND u.src = h.node),
m2 AS (SELECT graph_id, center, node, min(hop) AS hop FROM h2 GROUP BY ALL),
h3 AS (SELECT * FROM m2 UNION ALL SELECT h.graph_id, center, dst, 3 FROM m2 h JOIN u ON u.graph_id = h.graph_id AND u.src = h.node),
m3 AS (SELECT graph_id, center, node, min(hop) AS hop FROM h3 GROUP BY ALL)
SELECT graph_id, CAST(r AS BIGINT) AS radius, center, count(*) AS size FROM m3, (VALUES (1), (2), (3)) v(r) WHERE hop <= r GROUP BY ALL HAVING count(*) <= 30""")
def khop_subgraph_sizes(spark, sf_dir):
    found = graph.balls(user_edges(spark, sf_dir))
    return found.groupBy("graph_id", big("radius").alias("radius"), "center").agg(F.count(F.lit(1)).alias("size"))


@query(f"""WITH {_EDGES}, marks AS (SELECT e.graph_id, s.out_degree || ',' || s.in_degree || '>' || d.out_degree || ',' || d.in_degree AS t
  FROM edges e JOIN degrees s ON s.graph_id = e.graph_id AND s.node = e.src JOIN degrees d ON d.graph_id = e.graph_id AND d.node = e.dst)
SELECT graph_id, md5(string_agg(t, '|' ORDER BY t)) AS structure FROM marks GROUP BY ALL""")
def graph_structural_hash(spark, sf_dir):
    return graph.native_structure(user_edges(spark, sf_dir))


@query(f"WITH {_EDGES} SELECT graph_id, min(node) AS address FROM ends GROUP BY ALL")
def function_address_min(spark, sf_dir):
    return graph.function_addresses(graph.nodes_of(user_edges(spark, sf_dir)))


@query(f"WITH {_EDGES} SELECT node AS address, count(DISTINCT graph_id) AS functions FROM ends GROUP BY ALL HAVING count(DISTINCT graph_id) > 1")
def shared_blocks(spark, sf_dir):
    blocks = graph.nodes_of(user_edges(spark, sf_dir)).select(F.lit(0).alias("file_id"), F.col("node").alias("address"), "graph_id")
    return graph.shared_blocks(blocks).select("address", "functions")


@query(f"WITH {_EDGES} SELECT graph_id, count(*) AS edges, CAST(sum(src % 1000) AS BIGINT) AS sources, CAST(sum(dst % 1000) AS BIGINT) AS targets FROM edges GROUP BY ALL")
def graph_json_roundtrip(spark, sf_dir):
    """Graphs written as JSON and parsed again."""
    from .sources.readers import parse_graph
    from .sources.writers import graph_json

    edges = user_edges(spark, sf_dir).groupBy("graph_id").agg(F.array_sort(F.collect_list(F.struct("ord", "src", "dst"))).alias("e"))
    address = lambda x: x.cast("decimal(20,0)")
    ends = F.array_distinct(F.flatten(F.transform("e", lambda x: F.array(x["src"], x["dst"]))))
    made = edges.select("graph_id", F.struct(F.lit("CFG").alias("name"), F.transform(ends, lambda n: F.struct(address(n).alias("address"), F.array(F.struct(F.lit("nop").alias("mnemonic"), F.array(F.lit("EAX")).alias("operands"))).alias("instructions"))).alias("nodes"), F.transform("e", lambda x: F.struct(address(x["src"]).alias("source"), address(x["dst"]).alias("destination"))).alias("edges")).alias("graph"))
    parsed = made.select("graph_id", parse_graph(graph_json("graph")).alias("graph"))
    each = parsed.select("graph_id", F.explode("graph.edges").alias("x"))
    return each.groupBy("graph_id").agg(F.count(F.lit(1)).alias("edges"), big(F.sum(F.col("x.source") % 1000)).alias("sources"), big(F.sum(F.col("x.destination") % 1000)).alias("targets"))


@query()
def reference_family_hash(spark, sf_dir):
    """Bit-exact SimHash of each user's graph, its event types as mnemonics and props as operands."""
    from .operators.graph_features import graph_simhash

    found = graph_simhash(user_graphs(spark, sf_dir))
    return found.select("graph_id", hex128("hash_a", "hash_b").alias("simhash"))


@query()
def whole_graph_hash(spark, sf_dir):
    from .operators.graph_features import whole_graph_hashes

    return whole_graph_hashes(user_graphs(spark, sf_dir)).select("graph_id", "address", hex64("hash").alias("hash"))


def user_graphs(spark, sf_dir) -> DataFrame:
    """graph_id, nodes, edges in the graph schema; a node's instructions are its user's events there, in order."""
    e = table(spark, sf_dir, "events")
    kind = F.conv(F.substring(F.md5("event_type"), 1, 6), 16, 10).cast("bigint")
    e = e.withColumn("address", (kind * 6 + F.floor(F.hour("ts") / 4)).cast("decimal(20,0)"))
    step = F.struct("ts", "event_id", F.struct(F.col("event_type").alias("mnemonic"), F.array(F.get_json_object("props", "$.k")).alias("operands")).alias("i"))
    blocks = e.groupBy("user_id", "address").agg(F.transform(F.array_sort(F.collect_list(step)), lambda x: x["i"]).alias("instructions"))
    nodes = blocks.groupBy(F.col("user_id").alias("graph_id")).agg(F.collect_list(F.struct("address", "instructions")).alias("nodes"))
    edges = user_edges(spark, sf_dir).groupBy("graph_id").agg(F.array_sort(F.collect_list(F.struct("ord", "src", "dst"))).alias("e"))
    cast = lambda x: x.cast("decimal(20,0)")
    edges = edges.select("graph_id", F.transform("e", lambda x: F.struct(cast(x["src"]).alias("source"), cast(x["dst"]).alias("destination"))).alias("edges"))
    none = F.array().cast("array<struct<source:decimal(20,0),destination:decimal(20,0)>>")
    return nodes.join(edges, "graph_id", "left").withColumn("edges", F.coalesce("edges", none))


# --- index and search ----------------------------------------------------------------------------------------


def document_functions(spark, sf_dir) -> DataFrame:
    """Hashed once: what follows reads them several times."""
    return kept(document_hashes(spark, sf_dir).withColumnRenamed("key", "function_id"))


def as_queries(functions: DataFrame) -> DataFrame:
    return functions.select(F.col("function_id").alias("query_id"), F.col("hash_a").alias("qa"), F.col("hash_b").alias("qb"))


@query(f"WITH {_HASHES}, {_ENTRIES} SELECT key AS function_id, CAST(perm AS BIGINT) AS perm, CAST(bucket AS BIGINT) AS bucket FROM entries")
def index_entries(spark, sf_dir):
    found = index.index_entries(document_functions(spark, sf_dir), PERMUTATIONS)
    return found.select("function_id", big("perm").alias("perm"), big("bucket").alias("bucket"))


@query(f"WITH {_HASHES} SELECT count(*) * {PERMUTATIONS} AS entries, CAST({PERMUTATIONS} AS BIGINT) AS permutations, count(*) AS functions FROM hashes")
def index_stats(spark, sf_dir):
    functions = document_functions(spark, sf_dir)
    return index.index_stats(functions, index.index_entries(functions, PERMUTATIONS)).select("entries", big("permutations").alias("permutations"), "functions")


@query(f"WITH {_FOUND} SELECT query_id, function_id, CAST(distance AS BIGINT) AS distance, CAST(rank AS BIGINT) AS rank FROM best")
def query_topn_lsh(spark, sf_dir):
    functions = document_functions(spark, sf_dir)
    asked = as_queries(functions)
    found = search.search_buckets(asked, functions, 5, PERMUTATIONS, distinct_ids=True)
    return found.select("query_id", "function_id", big("distance").alias("distance"), big("rank").alias("rank"))


@query(f"""WITH {_HASHES} SELECT query_id, function_id, CAST(distance AS BIGINT) AS distance, CAST(rank AS BIGINT) AS rank FROM (
  SELECT x.key AS query_id, y.key AS function_id, {_DISTANCE} AS distance, row_number() OVER (PARTITION BY x.key ORDER BY {_DISTANCE}, y.key) AS rank
  FROM hashes x JOIN hashes y ON x.key <> y.key) WHERE rank <= 5""")
def query_topn_exact(spark, sf_dir):
    functions = document_functions(spark, sf_dir)
    asked = as_queries(functions)
    found = search.search_exact(asked, functions, 5, distinct_ids=True)
    return found.select("query_id", "function_id", big("distance").alias("distance"), big("rank").alias("rank"))


@query(f"""WITH {_FOUND}, files AS (SELECT doc_id % 100 AS file_id, min(source) AS file_name FROM documents GROUP BY ALL)
  SELECT b.query_id, b.function_id, CAST(128 - b.distance AS BIGINT) AS similarity, CAST(b.rank AS BIGINT) AS rank, f.file_name, p.url AS function_name, d.lang = 'en' AS vulnerable,
  round(greatest((128 - b.distance) / 128.0 - 0.5, 0) * 2, {ROUND}) AS report
  FROM best b JOIN documents d ON d.doc_id = b.function_id JOIN files f ON f.file_id = d.doc_id % 100 LEFT JOIN pages p ON p.page_id = b.function_id WHERE 128 - b.distance > 0.8 * 128""")
def match_with_metadata(spark, sf_dir):
    """The flagship: for each document the five most similar others above 80 % of the bits, with their metadata."""
    functions = document_functions(spark, sf_dir)
    asked = as_queries(functions)
    found = search.at_least(search.search_buckets(asked, functions, 5, PERMUTATIONS, distinct_ids=True))
    docs = table(spark, sf_dir, "documents").select((F.col("doc_id") % 100).alias("file_id"), F.col("doc_id").alias("address"), F.col("source").alias("file_name"), (F.col("lang") == "en").alias("vulnerable"))
    urls = table(spark, sf_dir, "pages").select(F.col("page_id").alias("address"), F.col("url").alias("function_name"))
    named = search.with_metadata(found, functions.select("function_id", (F.col("function_id") % 100).alias("file_id"), F.col("function_id").alias("address")), docs.join(urls, "address", "left"))
    return named.select("query_id", "function_id", big("similarity").alias("similarity"), big("rank").alias("rank"), "file_name", "function_name", "vulnerable", F.round(search.report_scale("similarity"), ROUND).alias("report"))


def _odds_sql() -> str:
    import math

    rows = [(c, 1 - math.erf(abs(c - 64) / math.sqrt(32) / math.sqrt(2))) for c in range(129)]
    return ", ".join(f"({c}, {p!r}::DOUBLE)" for c, p in rows)


@query(f"""WITH p(equal_bits, p) AS (VALUES {_odds_sql()}), n AS (SELECT count(*) AS n FROM documents)
SELECT CAST(equal_bits AS BIGINT) AS equal_bits, CASE WHEN p > 0 THEN round(log10(1 / p / n), {ROUND}) END AS log_odds FROM p, n""")
def odds_of_random_hit(spark, sf_dir):
    n = table(spark, sf_dir, "documents").count()
    odds = search.odds_table(spark, n)
    return odds.select(big("equal_bits").alias("equal_bits"), F.when(F.col("odds") < float("inf"), F.round(F.log10("odds"), ROUND)).alias("log_odds"))


@query(f"""WITH {_FOUND}, top AS (SELECT query_id, 128 - distance AS similarity FROM best WHERE rank = 1),
s AS (SELECT d.source, d.doc_id, row_number() OVER (PARTITION BY d.source ORDER BY d.doc_id) AS i, coalesce(t.similarity, 0) AS similarity FROM documents d LEFT JOIN top t ON t.query_id = d.doc_id),
r AS (SELECT source, doc_id, i - row_number() OVER (PARTITION BY source ORDER BY doc_id) AS run FROM s WHERE similarity > 104)
SELECT source, min(doc_id) AS first, max(doc_id) AS last, count(*) AS length FROM r GROUP BY source, run""")
def consecutive_matches(spark, sf_dir):
    functions = document_functions(spark, sf_dir)
    asked = as_queries(functions)
    top = search.search_buckets(asked, functions, 1, PERMUTATIONS, distinct_ids=True).select(F.col("query_id").alias("doc_id"), "similarity")
    placed = table(spark, sf_dir, "documents").select(F.col("source").alias("key"), "doc_id").join(top, "doc_id", "left").fillna(0, ["similarity"])
    return search.consecutive_matches(placed, "doc_id").withColumnRenamed("key", "source")


@query("""SELECT c_custkey AS file_id, CASE WHEN c_custkey % 3 = 0 THEN 'new' ELSE 'old' END AS name FROM customer""")
def metadata_merge(spark, sf_dir):
    """A metadata store with rows that override known ones."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("file_id"))
    return index.merge_metadata(c.withColumn("name", F.lit("old")), c.filter("file_id % 3 = 0").withColumn("name", F.lit("new")), ("file_id",))


# --- training data -------------------------------------------------------------------------------------------

_MEMBERS = "m AS (SELECT vec_id AS key, label AS family FROM embeddings)"


@query(f"WITH {_MEMBERS} SELECT x.family, x.key AS a, y.key AS b FROM m x JOIN m y ON x.family = y.family AND x.key < y.key")
def family_pairs(spark, sf_dir):
    return training_data.attraction_pairs(members(spark, sf_dir))


@query(f"""WITH {_MEMBERS}, c AS (SELECT family, key AS x, lead(key) OVER (PARTITION BY family ORDER BY md5('chain:' || key), key) AS y FROM m)
SELECT family, least(x, y) AS a, greatest(x, y) AS b FROM c WHERE y IS NOT NULL""")
def family_chain(spark, sf_dir):
    return training_data.chain_pairs(members(spark, sf_dir))


_REPULSION = f"""{_MEMBERS}, blocks AS (SELECT key, family, ('0x' || substr(md5('repulse-block:' || key), 1, 8))::BIGINT % 64 AS block FROM m),
c AS (SELECT key AS x, family AS fx, lead(key) OVER w AS y, lead(family) OVER w AS fy FROM blocks WINDOW w AS (PARTITION BY block ORDER BY md5('repulse:' || key), key)),
repulse AS (SELECT DISTINCT least(x, y) AS a, greatest(x, y) AS b FROM c WHERE y IS NOT NULL AND fx <> fy)"""


@query(f"WITH {_REPULSION} SELECT a, b FROM repulse")
def repulsion_pairs(spark, sf_dir):
    return training_data.repulsion_pairs(members(spark, sf_dir))


@query(f"WITH {_MEMBERS} SELECT key, family, row_number() OVER (PARTITION BY family ORDER BY md5('seen:' || key), key) = 1 AND count(*) OVER (PARTITION BY family) > 1 AS validation FROM m")
def seen_split(spark, sf_dir):
    return training_data.seen_split(members(spark, sf_dir))


@query(f"WITH {_MEMBERS} SELECT key, family, ('0x' || substr(md5('split:' || family), 1, 8))::BIGINT % 100 < 20 AS validation FROM m")
def unseen_split(spark, sf_dir):
    return training_data.split_families(members(spark, sf_dir))


@query("SELECT source AS family, count(*) AS size FROM documents GROUP BY ALL HAVING count(*) >= 5")
def family_filter(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), F.col("source").alias("family"))
    return training_data.families(docs, 5)


# --- evaluation ----------------------------------------------------------------------------------------------


def _pairs(spark, sf_dir) -> DataFrame:
    m = members(spark, sf_dir)
    attract = training_data.attraction_pairs(m).select("a", "b", F.lit(True).alias("attract"))
    return attract.unionByName(training_data.repulsion_pairs(m).select("a", "b", F.lit(False).alias("attract")))


_DISTANCES = f"""{_REPULSION}, {_VECTORS}, pairs AS (
  SELECT x.key AS a, y.key AS b, true AS attract FROM m x JOIN m y ON x.family = y.family AND x.key < y.key UNION ALL SELECT a, b, false FROM repulse),
distances AS (SELECT p.a, p.b, p.attract, bit_count(xor(x.a, y.a)) AS distance FROM pairs p JOIN vectors x ON x.vec_id = p.a JOIN vectors y ON y.vec_id = p.b)"""


@query(f"WITH {_DISTANCES} SELECT attract, CAST(distance AS BIGINT) AS distance, count(*) AS pairs FROM distances GROUP BY ALL")
def distance_histogram(spark, sf_dir):
    found = evaluate.pair_distances(_pairs(spark, sf_dir), vector_keys(spark, sf_dir))
    return evaluate.histogram(found, "attract").select("attract", big("distance").alias("distance"), "pairs")


@query(f"WITH {_DISTANCES}, s AS (SELECT avg(distance) FILTER (attract) AS n, avg(distance) FILTER (NOT attract) AS f FROM distances) SELECT round(n, {ROUND}) AS attraction, round(f, {ROUND}) AS repulsion, round(f - n, {ROUND}) AS difference FROM s")
def difference_of_means(spark, sf_dir):
    found = evaluate.difference_of_means(evaluate.pair_distances(_pairs(spark, sf_dir), vector_keys(spark, sf_dir)))
    return found.select(*[F.round(c, ROUND).alias(c) for c in found.columns])


@query(f"WITH {_VECTORS} SELECT CAST(min(bit_count(xor(x.a, y.a))) AS BIGINT) AS least, round(avg(bit_count(xor(x.a, y.a))), {ROUND}) AS mean, CAST(max(bit_count(xor(x.a, y.a))) AS BIGINT) AS most FROM vectors x JOIN vectors y ON x.vec_id < y.vec_id")
def distance_matrix_stats(spark, sf_dir):
    found = evaluate.distance_statistics(vector_keys(spark, sf_dir))
    return found.select(big("least").alias("least"), F.round("mean", ROUND).alias("mean"), big("most").alias("most"))


_RESULTS = f"""{_VECTORS}, q AS (SELECT label, min(vec_id) AS vec_id FROM vectors GROUP BY label),
r AS (SELECT x.label AS family, bit_count(xor(x.a, y.a)) AS distance, y.label = x.label AS relevant FROM q JOIN vectors x USING (vec_id, label) CROSS JOIN vectors y)"""
_REPORTED = 200_000
_ROC = f"""{_RESULTS}, hashes AS (SELECT vec_id AS key, a, 0::UBIGINT AS b FROM vectors), {_ENTRIES},
bucketed AS (SELECT DISTINCT x.key AS query_id, y.key AS function_id, bit_count(xor(x.a, y.a)) AS distance FROM entries x JOIN q ON q.vec_id = x.key JOIN entries y ON x.perm = y.perm AND x.bucket = y.bucket),
near AS (SELECT * FROM bucketed QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, function_id) <= {_REPORTED}),
ra AS (SELECT q.label AS family, n.distance, v.label = q.label AS relevant FROM near n JOIN q ON q.vec_id = n.query_id JOIN vectors v ON v.vec_id = n.function_id),
totals AS (SELECT family, sum(CASE WHEN relevant THEN 1 ELSE 0 END) AS ag, sum(CASE WHEN relevant THEN 0 ELSE 1 END) AS ab FROM r GROUP BY ALL),
every AS (SELECT 'exact' AS kind, * FROM r UNION ALL SELECT 'approx', * FROM ra),
cut AS (SELECT t, kind, family, sum(CASE WHEN relevant AND distance <= t THEN 1 ELSE 0 END) AS good, sum(CASE WHEN NOT relevant AND distance <= t THEN 1 ELSE 0 END) AS bad FROM every, range(128) AS s(t) GROUP BY ALL),
rates AS (SELECT t, kind, CASE WHEN ag > 0 THEN good / ag END AS tpr, CASE WHEN ab > 0 THEN bad / ab END AS fpr, CASE WHEN good + bad > 0 THEN bad / (good + bad) END AS irr FROM cut JOIN totals USING (family))"""


def _family_heads(spark, sf_dir) -> DataFrame:
    """family, query_id, qa, qb: one query for each family, its least member."""
    heads = vector_hashes(spark, sf_dir).groupBy("label").agg(F.min_by(F.struct("vec_id", "hash_a"), "vec_id").alias("head"))
    return heads.select(F.col("label").alias("family"), F.col("head.vec_id").alias("query_id"), F.col("head.hash_a").alias("qa"), F.lit(0).cast("bigint").alias("qb"))


def _family_results(spark, sf_dir) -> DataFrame:
    """family, distance, relevant: every family's query against all vectors; Spark broadcasts the queries where its threshold allows."""
    found = vector_hashes(spark, sf_dir).crossJoin(_family_heads(spark, sf_dir).select("family", "qa"))
    return found.select("family", F.bit_count(F.col("hash_a").bitwiseXOR(F.col("qa"))).alias("distance"), F.equal_null("label", "family").alias("relevant"))


@query("WITH " + _ROC + ", ".join([" SELECT t AS threshold", *[f"round(avg({m}) FILTER (kind = '{k}'), {ROUND}) AS {m}_{k}" for k in ("exact", "approx") for m in ("tpr", "fpr", "irr")]]) + " FROM rates GROUP BY t")
def roc_curve(spark, sf_dir):
    """Rates of exact and of bucket search (200 000 results at most, the report's own limit): one query for each family, its least member."""
    heads, functions = _family_heads(spark, sf_dir), vector_keys(spark, sf_dir).withColumnRenamed("key", "function_id")
    exact = _family_results(spark, sf_dir)
    totals = exact.groupBy("family").agg(F.sum(F.col("relevant").cast("int")).alias("all_good"), F.sum((~F.col("relevant")).cast("int")).alias("all_bad"))
    near = search.search_buckets(heads, functions, _REPORTED, PERMUTATIONS)
    labels = members(spark, sf_dir).select(F.col("key").alias("function_id"), F.col("family").alias("label"))
    approx = near.join(heads.select("query_id", "family"), "query_id").join(labels, "function_id").select("family", "distance", F.equal_null("label", "family").alias("relevant"))
    curves = [
        evaluate.roc(found, spark, totals).select("threshold", *[F.round(c, ROUND).alias(f"{c}_{kind}") for c in ("tpr", "fpr", "irr")])
        for kind, found in (("exact", exact), ("approx", approx))
    ]
    return curves[0].join(curves[1], "threshold").withColumn("threshold", big("threshold"))


@query(f"WITH {_RESULTS} SELECT family, CAST(sum(CASE WHEN relevant THEN 1 ELSE 0 END) AS BIGINT) AS relevant, count(*) AS results FROM r WHERE distance <= 26 GROUP BY ALL")
def relevant_count(spark, sf_dir):
    return evaluate.relevant_counts(_family_results(spark, sf_dir), 26)


@query("WITH f AS (SELECT source AS family, count(*) AS size FROM documents GROUP BY ALL HAVING count(*) >= 5) SELECT family, size FROM f ORDER BY md5('subset:' || family), family LIMIT 10")
def family_subset(spark, sf_dir):
    """Ten families of five members or more, in hash order: the report's own limit."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), F.col("source").alias("family"))
    return evaluate.family_subset(training_data.families(docs), 10, 5)


@query(f"WITH {_VECTORS} SELECT x.vec_id AS a, y.vec_id AS b, CAST(bit_count(xor(x.a, y.a)) AS BIGINT) AS distance FROM vectors x CROSS JOIN vectors y")
def distance_matrix(spark, sf_dir):
    """The whole distance matrix: every vector against every vector."""
    words = simhash.floats_to_words(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    hashes = words.select(F.col("vec_id").alias("key"), F.col("word0").alias("hash_a"), F.lit(0).cast("bigint").alias("hash_b"))
    return evaluate.distance_matrix(hashes).select("a", "b", big("distance").alias("distance"))


# --- scalars -------------------------------------------------------------------------------------------------


@query(f"""WITH h AS (SELECT doc_id, md5(coalesce(text, '')) AS h FROM documents),
t AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN h WHEN 1 THEN 'aa.' || h ELSE substr(h, 1, 20) END AS t FROM h),
p AS (SELECT doc_id, CASE WHEN length(t) = 35 THEN substr(t, 4, 32) WHEN length(t) = 32 THEN t ELSE repeat('0', 32) END AS p FROM t)
SELECT doc_id, substr(p, 1, 16) AS word_a, substr(p, 17, 16) AS word_b FROM p""")
def hash_parse(spark, sf_dir):
    digest = F.md5(F.coalesce("text", F.lit("")))
    name = F.when(F.col("doc_id") % 3 == 0, digest).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("aa."), digest)).otherwise(F.substring(digest, 1, 20))
    a, b = parse_feature_hash(name)
    return table(spark, sf_dir, "documents").select("doc_id", hex64(a).alias("word_a"), hex64(b).alias("word_b"))


@query("SELECT page_id, url AS name FROM pages")
def base64_names(spark, sf_dir):
    coded = table(spark, sf_dir, "pages").select("page_id", F.base64(F.encode("url", "UTF-8")).alias("coded"))
    return coded.select("page_id", decode_name("coded").alias("name"))


@query("SELECT page_id, substr(sha256(html), 1, 16) AS file_id FROM pages")
def file_id_sha256(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", file_id(F.col("html")).alias("file_id"))


def _stem_sql(column: str) -> str:
    from .functions.symbols import REPLACEMENTS

    for old, new in REPLACEMENTS:
        column = f"replace({column}, '{old}', '{new}')"
    return column


@query(f"SELECT p_partkey, {_stem_sql('''('class ' || p_name || ' * , struct ' || p_type || ' & (void)')''')} AS symbol FROM part")
def symbol_normalise(spark, sf_dir):
    name = F.concat(F.lit("class "), "p_name", F.lit(" * , struct "), "p_type", F.lit(" & (void)"))
    return table(spark, sf_dir, "part").select("p_partkey", normalise_symbol(name).alias("symbol"))


# --- learning ------------------------------------------------------------------------------------------------

_LOSS = "(1 - x * y / sqrt(x * y * x * y + 1)) * sqrt(sqrt((x - y) * (x - y) + 0.1) + 0.01)"


@query(f"""WITH {_REPULSION}, pairs AS (SELECT family, key AS a, lead(key) OVER (PARTITION BY family ORDER BY md5('chain:' || key), key) AS b FROM m),
every AS (SELECT least(a, b) AS a, greatest(a, b) AS b, true AS attract FROM pairs WHERE b IS NOT NULL UNION ALL SELECT a, b, false FROM repulse),
each AS (SELECT p.a, p.b, p.attract, unnest(e.embedding) AS x0, unnest(f.embedding) AS y FROM every p JOIN embeddings e ON e.vec_id = p.a JOIN embeddings f ON f.vec_id = p.b),
t AS (SELECT a, b, attract, CASE WHEN attract THEN x0::DOUBLE ELSE -x0::DOUBLE END AS x, y::DOUBLE AS y FROM each)
SELECT a, b, attract, round(sum({_LOSS}), 4) AS loss FROM t GROUP BY ALL""")
def pair_loss(spark, sf_dir):
    """Loss of chain and repulsion pairs, embeddings as float states."""
    m = members(spark, sf_dir)
    chain = training_data.chain_pairs(m).select("a", "b", F.lit(True).alias("attract"))
    pairs = chain.unionByName(training_data.repulsion_pairs(m).select("a", "b", F.lit(False).alias("attract")))
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    held = pairs.join(e.select(F.col("vec_id").alias("a"), F.col("v").alias("x")), "a").join(e.select(F.col("vec_id").alias("b"), F.col("v").alias("y")), "b")
    return train.pair_losses(held).select("a", "b", "attract", F.round("loss", 4).alias("loss"))


@query()
def weights_training_step(spark, sf_dir):
    """One gradient step on event-trigram features: families are users modulo 10."""
    grams = sequences.trigrams(table(spark, sf_dir, "events"), "user_id", ("ts", "event_id"), "event_type").withColumnRenamed("user_id", "key")
    features = sequences.native_features(grams).select("key", "feature_a", "feature_b")
    users = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), (F.col("user_id") % 10).alias("family")).distinct()
    learnt = train.train(features, training_data.chain_pairs(users).select("a", "b"), training_data.repulsion_pairs(users, blocks=4), steps=1)
    return learnt.select(hex128("feature_a", "feature_b").alias("feature"), F.round("weight", ROUND).alias("weight"))


@query("SELECT count(*) AS functions, count(*) AS ids, CAST(101 AS BIGINT) AS least, count(*) + 100 AS most FROM embeddings")
def assign_function_ids(spark, sf_dir):
    """Dense function ids that go on from the largest known one."""
    v = vector_hashes(spark, sf_dir).select(F.col("vec_id").alias("file_id"), F.lit(0).cast("bigint").alias("address"), "hash_a", F.lit(0).cast("bigint").alias("hash_b"))
    found = index.assign_ids(v, 100)
    return found.agg(F.count(F.lit(1)).alias("functions"), F.countDistinct("function_id").alias("ids"), F.min("function_id").alias("least"), F.max("function_id").alias("most"))


@query(f"""WITH {_EDGES} SELECT graph_id, 'digraph G {{' || chr(10) || string_agg('  blk_' || lower(hex(src)) || ' -> blk_' || lower(hex(dst)) || ';', chr(10) ORDER BY src, ord) || chr(10) || '}}' || chr(10) AS dot FROM edges GROUP BY ALL""")
def graph_dot(spark, sf_dir):
    from .sources.writers import dot_lines

    return dot_lines(user_edges(spark, sf_dir)).withColumnRenamed("value", "dot")




# --- more of the operators, each with SQL of its own -----------------------------------------------------------


@query(f"""WITH {_EDGES}, u AS (SELECT graph_id, src, dst FROM edges UNION SELECT graph_id, dst, src FROM edges),
h0 AS (SELECT DISTINCT graph_id, node AS center, node FROM ends),
h1 AS (SELECT * FROM h0 UNION SELECT h.graph_id, center, dst FROM h0 h JOIN u ON u.graph_id = h.graph_id AND u.src = h.node),
h2 AS (SELECT * FROM h1 UNION SELECT h.graph_id, center, dst FROM h1 h JOIN u ON u.graph_id = h.graph_id AND u.src = h.node),
every AS (SELECT 1 AS radius, * FROM h1 UNION ALL SELECT 2, * FROM h2),
b AS (SELECT * FROM every QUALIFY count(*) OVER (PARTITION BY graph_id, radius, center) <= 30)
SELECT x.graph_id, CAST(x.radius AS BIGINT) AS radius, x.center, count(*) AS edges FROM b x JOIN b y ON y.graph_id = x.graph_id AND y.radius = x.radius AND y.center = x.center
JOIN edges e ON e.graph_id = x.graph_id AND e.src = x.node AND e.dst = y.node GROUP BY ALL""")
def khop_induced_edges(spark, sf_dir):
    """Edges inside each ball of one or two hops."""
    edges = user_edges(spark, sf_dir)
    found = graph.induced_edges(graph.balls(edges, radius=2), edges)
    return found.groupBy("graph_id", big("radius").alias("radius"), "center").agg(F.count(F.lit(1)).alias("edges"))


@query(f"""WITH {_EDGES}, {_STARTS} SELECT 'out' AS way, e.graph_id, e.src, e.dst, CAST(e.ord AS BIGINT) AS ord FROM edges e JOIN starts s ON s.graph_id = e.graph_id AND e.src = s.start
UNION ALL SELECT 'in', e.graph_id, e.src, e.dst, CAST(e.ord AS BIGINT) FROM edges e JOIN starts s ON s.graph_id = e.graph_id AND e.dst = s.start""")
def start_node_edges(spark, sf_dir):
    """Edges out of and into each graph's start."""
    edges = user_edges(spark, sf_dir)
    placed = edges.join(edges.groupBy("graph_id").agg(F.min("src").alias("start")), "graph_id")
    out = [f(placed, F.col("start")).select(F.lit(way).alias("way"), "graph_id", "src", "dst", big("ord").alias("ord")) for way, f in (("out", graph.out_edges), ("in", graph.in_edges))]
    return out[0].unionByName(out[1])


_BLOCKS = """steps AS (SELECT user_id, ts, event_id, ('0x' || substr(md5(event_type), 1, 6))::BIGINT * 6 + hour(ts) // 4 AS address, event_type, json_extract_string(props, '$.k') AS k FROM events),
blocks AS (SELECT *, row_number() OVER (PARTITION BY user_id, address ORDER BY ts DESC, event_id DESC) AS behind FROM steps)"""


@query(f"""WITH {_BLOCKS}, v AS (SELECT user_id, address, ('0x' || k)::BIGINT AS v FROM blocks WHERE behind > 1 AND k IS NOT NULL)
SELECT user_id, address, lpad(lower(hex(v)), 16, '0') AS value, count(*) AS n FROM v WHERE v > 16384 OR (v % 4 <> 0 AND v > 10) GROUP BY ALL""")
def block_constants(spark, sf_dir):
    """Useful constants of all but each block's last instruction; a user's events at one address are a block."""
    blocks = user_graphs(spark, sf_dir).select(F.col("graph_id").alias("key"), F.explode("nodes").alias("n")).select("key", big("n.address").alias("address"), "n.instructions")
    found = sequences.immediates(blocks)
    return found.groupBy(F.col("key").alias("user_id"), "address", hex64("value").alias("value")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_BLOCKS}, t AS (SELECT user_id, address, count(*) AS n, string_agg(chr(9) || chr(9) || event_type || ' ' || coalesce(k, ''), chr(10) ORDER BY ts, event_id) AS body FROM blocks GROUP BY ALL),
b AS (SELECT user_id, address, chr(9) || '[' || lower(hex(address)) || '] (' || n || ')' || chr(10) || body AS body FROM t)
SELECT user_id, '[' || lower(hex(min(address))) || ']' || chr(10) || string_agg(body, chr(10) ORDER BY address) AS listing FROM b GROUP BY ALL""")
def disassembly_text(spark, sf_dir):
    from .sources.writers import disassembly

    nodes = user_graphs(spark, sf_dir).select("graph_id", F.explode("nodes").alias("n")).select("graph_id", big("n.address").alias("address"), "n.instructions")
    return disassembly(nodes).select(F.col("graph_id").alias("user_id"), F.col("value").alias("listing"))


@query("SELECT p_partkey, replace(p_name, ' ', '_') || '( Baz*, int)' AS stem FROM part")
def stem_symbols(spark, sf_dir):
    """Return types and calling conventions go, what stands in brackets stays together."""
    from .functions.symbols import stem_symbol

    name = F.concat(F.lit("public: unsigned int __cdecl "), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("(class Baz *,int)"))
    return table(spark, sf_dir, "part").select("p_partkey", stem_symbol(name).alias("stem"))


@query("""WITH w AS (SELECT doc_id, ('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 16))::UBIGINT::HUGEINT AS x FROM documents)
SELECT doc_id, lpad(lower(hex(((x * 128) % 18446744073709551616 + x // 144115188075855872)::UBIGINT)), 16, '0') AS by7, lpad(lower(hex(((x * 8192) % 18446744073709551616 + x // 2251799813685248)::UBIGINT)), 16, '0') AS by13 FROM w""")
def rotated_words(spark, sf_dir):
    from .functions.bits import md5_words, rotl64

    docs = table(spark, sf_dir, "documents").select("doc_id", md5_words(F.col("doc_id").cast("string"))[0].alias("x"))
    return docs.select("doc_id", hex64(rotl64("x", 7)).alias("by7"), hex64(rotl64("x", 13)).alias("by13"))


@query(f"WITH {_FOUND} SELECT query_id, function_id, CAST(128 - distance AS BIGINT) AS similarity FROM best WHERE 128 - distance > 0.9 * 128")
def search_with_minimum(spark, sf_dir):
    functions = document_functions(spark, sf_dir)
    found = search.at_least(search.search_buckets(as_queries(functions), functions, 5, PERMUTATIONS, distinct_ids=True), 0.9)
    return found.select("query_id", "function_id", big("similarity").alias("similarity"))


_HEADS = "q AS (SELECT label, min(vec_id) AS vec_id FROM vectors GROUP BY label)"


def _cut_sql(results: str) -> str:
    return f"""cut AS (SELECT t, family, sum(CASE WHEN relevant AND distance <= t THEN 1 ELSE 0 END) AS good, sum(CASE WHEN NOT relevant AND distance <= t THEN 1 ELSE 0 END) AS bad,
  sum(CASE WHEN relevant THEN 1 ELSE 0 END) AS ag, sum(CASE WHEN relevant THEN 0 ELSE 1 END) AS ab FROM {results}, range(128) AS s(t) GROUP BY ALL)
SELECT t AS threshold, round(avg(CASE WHEN ag > 0 THEN good / ag END), {ROUND}) AS tpr, round(avg(CASE WHEN ab > 0 THEN bad / ab END), {ROUND}) AS fpr, round(avg(CASE WHEN good + bad > 0 THEN bad / (good + bad) END), {ROUND}) AS irr FROM cut GROUP BY t"""


_VECTOR_ENTRIES = "entries AS (" + " UNION ALL ".join(f"SELECT vec_id, label, a, {k} AS perm, CAST({_bucket_sql(p).replace('(b >>', '(0::UBIGINT >>')} AS INTEGER) AS bucket FROM vectors" for k, p in enumerate(bucket_positions(PERMUTATIONS))) + ")"


@query(f"""WITH {_VECTORS}, {_HEADS}, {_VECTOR_ENTRIES}, r AS (
  SELECT DISTINCT x.label AS family, y.vec_id, bit_count(xor(x.a, y.a)) AS distance, y.label = x.label AS relevant FROM entries x JOIN q ON q.vec_id = x.vec_id JOIN entries y ON x.perm = y.perm AND x.bucket = y.bucket),
{_cut_sql('r')}""")
def roc_curve_buckets(spark, sf_dir):
    """As roc_curve, by bucket search of up to 200000 results, whose labels are joined to them."""
    v = kept(vector_hashes(spark, sf_dir))
    functions = v.select(F.col("vec_id").alias("function_id"), "hash_a", F.lit(0).cast("bigint").alias("hash_b"))
    heads = v.groupBy("label").agg(F.min("vec_id").alias("function_id")).join(functions, "function_id")
    found = search.search_buckets(as_queries(heads), functions, 200_000, PERMUTATIONS)
    labels = [v.select(F.col("vec_id").alias(k), F.col("label").alias(n)) for k, n in (("query_id", "family"), ("function_id", "label"))]
    named = found.join(labels[0], "query_id").join(labels[1], "function_id").select("family", "distance", (F.col("label") == F.col("family")).alias("relevant"))
    curve = evaluate.roc(named, spark)
    return curve.select(big("threshold").alias("threshold"), *[F.round(c, ROUND).alias(c) for c in ("tpr", "fpr", "irr")])


_SOURCE_PAIRS = """m AS (SELECT doc_id AS key, source AS family FROM documents),
c AS (SELECT key AS x, lead(key) OVER (PARTITION BY family ORDER BY md5('chain:' || key), key) AS y FROM m),
o AS (SELECT key, family, ('0x' || substr(md5('repulse-block:' || key), 1, 8))::BIGINT % 64 AS block FROM m),
n AS (SELECT key AS x, family AS fx, lead(key) OVER w AS y, lead(family) OVER w AS fy FROM o WINDOW w AS (PARTITION BY block ORDER BY md5('repulse:' || key), key)),
pairs AS (SELECT least(x, y) AS a, greatest(x, y) AS b, true AS attract FROM c WHERE y IS NOT NULL UNION ALL SELECT DISTINCT least(x, y), greatest(x, y), false FROM n WHERE y IS NOT NULL AND fx <> fy)"""
_LEARNT_SUMS = ", ".join(f"sum(CASE WHEN ({'a' if n < 64 else 'b'} >> {n % 64}) & 1 = 1 THEN micro ELSE -micro END) AS s{n}" for n in range(128))


@query(f"""WITH {_LEARNT}, {_SOURCE_PAIRS}, plain AS (SELECT key, {_SUMS} FROM features GROUP BY key), learned AS (SELECT key, {_LEARNT_SUMS} FROM w GROUP BY key),
h AS (SELECT false AS trained, key, {_pack_sql(0)} AS a, {_pack_sql(64)} AS b FROM plain UNION ALL SELECT true, key, {_pack_sql(0)}, {_pack_sql(64)} FROM learned)
SELECT x.trained, p.attract, CAST({_DISTANCE} AS BIGINT) AS distance, count(*) AS pairs FROM pairs p JOIN h x ON x.key = p.a JOIN h y ON y.key = p.b AND y.trained = x.trained GROUP BY ALL""")
def trained_and_untrained_distances(spark, sf_dir):
    """Distances of pairs of one source and of two, under default and under learnt weights."""
    texts = table(spark, sf_dir, "documents")
    docs = texts.select(F.col("doc_id").alias("key"), F.col("source").alias("family"))
    pairs = training_data.chain_pairs(docs).select("a", "b", F.lit(True).alias("attract")).unionByName(training_data.repulsion_pairs(docs).select("a", "b", F.lit(False).alias("attract")))
    found = []
    for trained in (False, True):
        hashes = kept(simhash.weighted_text_simhash(texts, _learnt_weights(simhash.text_features(texts), distinct=False)) if trained else simhash.text_simhash(texts))
        distances = evaluate.pair_distances(pairs, hashes).withColumn("trained", F.lit(trained))
        found.append(evaluate.histogram(distances, "trained", "attract").select("trained", "attract", big("distance").alias("distance"), "pairs"))
    return found[0].unionByName(found[1])


def _training_sql(split: str) -> str:
    return f"""WITH {_MEMBERS}, s AS ({split}),
attract AS (SELECT x.validation, x.key AS a, y.key AS b FROM s x JOIN s y ON x.family = y.family AND x.validation = y.validation AND x.key < y.key QUALIFY row_number() OVER (PARTITION BY x.validation ORDER BY md5('attract:' || x.key || ':' || y.key), x.key, y.key) <= 1000),
blocks AS (SELECT key, family, validation, ('0x' || substr(md5('repulse-block:' || key), 1, 8))::BIGINT % 64 AS block FROM s),
c AS (SELECT validation, key AS x, family AS fx, lead(key) OVER w AS y, lead(family) OVER w AS fy FROM blocks WINDOW w AS (PARTITION BY validation, block ORDER BY md5('repulse:' || key), key)),
r AS (SELECT DISTINCT validation, least(x, y) AS a, greatest(x, y) AS b FROM c WHERE y IS NOT NULL AND fx <> fy),
sizes AS (SELECT validation, count(*) AS n FROM attract GROUP BY ALL),
repulse AS (SELECT r.validation, a, b FROM r JOIN sizes z ON z.validation = r.validation QUALIFY row_number() OVER (PARTITION BY r.validation ORDER BY md5('match:' || a || ':' || b), a, b) <= max(n) OVER (PARTITION BY r.validation))
SELECT validation, true AS attract, a, b FROM attract UNION ALL SELECT validation, false, a, b FROM repulse"""


@query(_training_sql("SELECT key, family, ('0x' || substr(md5('split:' || family), 1, 8))::BIGINT % 100 < 20 AS validation FROM m"))
def unseen_training_sets(spark, sf_dir):
    """Pairs to train on and to validate with, of families that the other set doesn't hold."""
    return training_data.training_sets(training_data.split_families(members(spark, sf_dir)), most=1000)


@query(_training_sql("SELECT key, family, row_number() OVER (PARTITION BY family ORDER BY md5('seen:' || key), key) = 1 AND count(*) OVER (PARTITION BY family) > 1 AS validation FROM m").replace("x.family = y.family AND x.validation = y.validation AND x.key < y.key", "x.family = y.family AND x.key < y.key AND (NOT x.validation AND NOT y.validation OR x.validation <> y.validation)").replace("SELECT x.validation, x.key AS a", "SELECT x.validation OR y.validation AS validation, x.key AS a").replace("PARTITION BY x.validation ORDER", "PARTITION BY x.validation OR y.validation ORDER"))
def seen_training_sets(spark, sf_dir):
    """A member of each family validates, against the members that train."""
    return training_data.training_sets(training_data.seen_split(members(spark, sf_dir)), most=1000, across=True)


@query(f"WITH {_FEATURES} SELECT DISTINCT {_hex('a')} AS feature, CAST(round(0.05 + 0.001 * (a % 1000), 3) AS DOUBLE) AS weight FROM features WHERE a % 2 = 0")
def weights_file_round_trip(spark, sf_dir):
    """Learnt weights as lines of a weights file, and parsed again."""
    from .sources.readers import parse_weights
    from .sources.writers import weight_lines

    weights = _learnt_weights(simhash.text_features(table(spark, sf_dir, "documents"))).withColumn("feature_b", F.lit(0).cast("bigint"))
    parsed = parse_weights(weight_lines(weights).withColumn("line", F.lit(0)))
    return parsed.select(hex64("feature_a").alias("feature"), F.round(F.col("weight").cast("double"), 3).alias("weight"))


@query(f"WITH {_HASHES} SELECT CAST(0 AS BIGINT) AS perm, {_hex('a')} || {_hex('b')} AS hash, key AS address FROM hashes")
def index_dump_round_trip(spark, sf_dir):
    """The index as lines of a dump, and parsed again."""
    from .sources.readers import parse_index_dump
    from .sources.writers import index_dump_lines

    held = document_hashes(spark, sf_dir).select(F.lit(0).alias("perm"), "hash_a", "hash_b", F.lit(7).cast("bigint").alias("file_id"), F.col("key").alias("address"))
    return parse_index_dump(index_dump_lines(held)).select(big("perm").alias("perm"), hex128("hash_a", "hash_b").alias("hash"), "address")


@query("SELECT doc_id AS address, source AS file_name, 'f ' || doc_id AS function_name, lang = 'en' AS vulnerable FROM documents")
def metadata_round_trip(spark, sf_dir):
    from .sources.readers import parse_metadata
    from .sources.writers import metadata_lines

    docs = table(spark, sf_dir, "documents").select(F.lit(7).cast("bigint").alias("file_id"), F.col("source").alias("file_name"), F.col("doc_id").alias("address"), F.concat(F.lit("f "), F.col("doc_id").cast("string")).alias("function_name"), (F.col("lang") == "en").alias("vulnerable"))
    return parse_metadata(metadata_lines(docs)).select("address", "file_name", "function_name", "vulnerable")


@query(f"WITH {_REPULSION} SELECT a, b FROM repulse")
def pairs_round_trip(spark, sf_dir):
    from .sources.readers import parse_pairs
    from .sources.writers import pair_lines

    pairs = training_data.repulsion_pairs(members(spark, sf_dir)).select(F.lit(1).cast("bigint").alias("file_a"), F.col("a").alias("address_a"), F.lit(2).cast("bigint").alias("file_b"), F.col("b").alias("address_b"))
    return parse_pairs(pair_lines(pairs)).select(F.col("address_a").alias("a"), F.col("address_b").alias("b"))


@query(f"WITH {_HASHES} SELECT '0000000000000007:' || {_hex('key')} || ' ' || {_hex('a')} || {_hex('b')} AS line FROM hashes")
def fingerprint_dump(spark, sf_dir):
    from .sources.writers import fingerprint_lines

    return fingerprint_lines(document_hashes(spark, sf_dir).select(F.lit(7).cast("bigint").alias("file_id"), F.col("key").alias("address"), "hash_a", "hash_b")).withColumnRenamed("value", "line")


@query(f"WITH {_FEATURES} SELECT {_hex('a')} || {_hex('b')} AS feature, 'mnemonic' AS feature_type, min(feature) AS payload, count(*) AS functions FROM features GROUP BY ALL")
def feature_dictionary(spark, sf_dir):
    """Distinct features with what they stand for."""
    features = sequences.described_features(sequences.text_trigrams(table(spark, sf_dir, "documents")))
    found = features.groupBy("feature_a", "feature_b", "feature_type").agg(F.min("payload").alias("payload"), F.count(F.lit(1)).alias("functions"))
    return found.select(hex128("feature_a", "feature_b").alias("feature"), "feature_type", "payload", "functions")


@query("""SELECT d.source AS file_name, d.doc_id AS address, lower(p.url) AS function_name FROM documents d JOIN pages p ON p.page_id = d.doc_id WHERE len(regexp_extract_all(d.text, '[^ \t\r\n]+')) >= 3""")
def symbols_with_code(spark, sf_dir):
    """Symbols (here pages) of functions (documents) that were found."""
    functions = document_hashes(spark, sf_dir).select(F.lit(1).alias("file_id"), F.col("key").alias("address"))
    names = table(spark, sf_dir, "pages").select(F.lit(1).alias("file_id"), F.col("page_id").alias("address"), F.col("url").alias("function_name"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("address"), F.col("source").alias("file_name"))
    return training_data.symbols_with_code(names, functions).join(docs, "address").select("file_name", "address", F.lower("function_name").alias("function_name"))
