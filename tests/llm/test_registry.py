"""The registered queries over whole tables, and the pipeline stage by stage."""

import glob
import os
from collections import Counter

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from simgrove.llm import registry

from . import brute
from .conftest import near, prose, table

SF = "/root/testdata/sf0.001"


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 11))
    assert set(registry.QUERIES) | {"pipeline"} <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_line_windows_equal_sql(spark):
    import duckdb

    c = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    found, want = registry.QUERIES["op6_line_windows"](spark, SF).toPandas(), c.sql(registry.ORACLES["op6_line_windows"]).df()
    columns = sorted(want.columns)
    assert sorted(found[columns].itertuples(index=False, name=None)) == sorted(want[columns].itertuples(index=False, name=None))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_suffix_dedup_and_components_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    texts = [d.text for d in docs]
    found = {r.doc_id: r for r in registry.QUERIES["op1_suffix_dedup"](spark, SF).collect()}
    for d, (runs, kept) in zip(docs, brute.removed_bytes(texts), strict=True):
        r = found[d.doc_id]
        assert (r.n_removed, r.n_spans, r.kept_sha256) == (sum(b - a for a, b in runs), len(runs), brute.sha(kept))
    label, sizes = brute.near_components(texts)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in registry.QUERIES["op7_jaccard_components"](spark, SF).collect()}
    assert found == {d.doc_id: (sizes[i], docs[label[i]].doc_id) for i, d in enumerate(docs)}


def test_a_cluster_needs_a_shared_folder(spark):
    from simgrove.llm import store

    class Conf:
        def get(self, *_):
            return None

    class Cluster:
        conf, sparkContext = Conf(), type("Context", (), {"master": "spark://host:7077", "applicationId": "a"})

    with pytest.raises(ValueError, match="checkpoint"):
        store.shared_dir(Cluster())


def test_pipeline_stages(spark, tmp_path):
    """Each stage against its plain version, on what the stage before kept."""
    texts = [prose(i, 6) for i in range(30)] + [near(prose(0, 6), 9, 0.01), prose(1, 6), prose(2, 6) + "\n" + prose(88, 3), "too few words", None, "a b " * 30]
    sources = [f"s{i % 4}" for i in range(len(texts))]
    docs, names = table(spark, texts, sources), [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5

    def run(stage, docs):
        path = f"{tmp_path}/{stage}"
        corpus_pipeline.STAGES[stage][1](spark, docs, "").write.parquet(path)
        return spark.read.parquet(path)

    kept = run(0, docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, t in enumerate(texts) if not brute.statistics(t)["base_failed"]}
    order = kept.orderBy("doc_id").collect()
    cleaned = run(1, kept)
    want = brute.without_repeated_lines([r.text for r in order])
    assert {r.doc_id: (r.text, r.n_chars) for r in cleaned.collect()} == {r.doc_id: (w[2], len(w[2])) for r, w in zip(order, want, strict=True)}
    one = run(2, cleaned)
    order = cleaned.orderBy("doc_id").collect()
    label, _ = brute.near_components([r.text for r in order])
    assert {r.doc_id for r in one.collect()} == {r.doc_id for i, r in enumerate(order) if label[i] == i}
    mixed = run(3, one)
    assert mixed.columns == docs.columns and {r.doc_id for r in mixed.collect()} <= {r.doc_id for r in one.collect()}
    assert max(Counter(r.doc_id for r in mixed.collect()).values()) <= 3
    pieces = run(4, mixed)
    assert pieces.filter("start = 0").count() == mixed.count()
