"""Operators on single texts: token counts, packing, quality statistics, license scans, toxicity."""

import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from simgrove.llm import encoding, kernels, licenses, registry, toxicity
from simgrove.llm.licenses import scan_licenses
from simgrove.llm.mixing import word_count
from simgrove.llm.packing import pack
from simgrove.llm.quality import keep_good, quality, text_statistics
from simgrove.llm.registry import vocabulary
from simgrove.llm.token_counts import count_tokens
from simgrove.llm.toxicity import score_toxicity

from . import brute
from .conftest import prose, table

SF = "/root/testdata/sf0.01"
BYTE, PLAIN = "byte_bpe_50k.json", "word_bpe_49k.json"


def ids(name, text):
    return encoding.tokenizer(vocabulary(name)).encode(text or "", add_special_tokens=False).ids


def test_token_counts(docs, texts, none):
    rows = count_tokens(docs, vocabulary(BYTE)).collect()
    assert {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in rows} == {i: (len((t or "").encode()), n := len(ids(BYTE, t)), n > 512) for i, t in enumerate(texts)}
    assert count_tokens(none, vocabulary(BYTE)).collect() == []


@pytest.mark.parametrize("text", ["a  b", "a \n b\n\n c  <|endoftext|> d <|endoftext|>  e", " lead", "trail ", "x   y", "it's we'll 'tis", "a  b  c", "\x1c a \x1d", "tab\t b", "12 345 6,7"])
def test_counter_cuts_safely(text):
    assert encoding.TokenCounter(vocabulary(BYTE)).counts([text])[0] == len(ids(BYTE, text))


@pytest.mark.parametrize("text", ["It's a TEST's <|endoftext|>x <|ENDOFTEXT|>", "ä H̱ ΑΣ Σ", "foo_bar12.5...!!! İst ßx×y÷z", "''s 's's x'é µm", "\x1c a\tb\r\nc\x0bd", "中文abc éa  z"])
def test_encoder_cuts_safely(text):
    import pyarrow as pa

    out, bounds = encoding.WordEncoder(vocabulary(PLAIN)).encode(pa.array([text, None, text]), 2)
    want = [*ids(PLAIN, text), 2]
    assert out[bounds[0] : bounds[1]].tolist() == want == out[bounds[2] : bounds[3]].tolist()
    assert out[bounds[1] : bounds[2]].tolist() == [2]


def test_encoder_forgets_and_learns_again():
    import pyarrow as pa

    encoder = encoding.WordEncoder(vocabulary(PLAIN))
    encoder.MOST = 10
    for i in range(4):
        text = prose(i)
        out, _ = encoder.encode(pa.array([text]), 2)
        assert out.tolist() == [*ids(PLAIN, text), 2]


@pytest.mark.parametrize("window", [4096, 64, 1])
def test_packing(docs, texts, none, window):
    some = docs.filter("doc_id % 7 = 0") if window == 1 else docs
    rows = pack(some, vocabulary(PLAIN), window).collect()
    wanted = {i: [*ids(PLAIN, t), 2] for i, t in enumerate(texts) if window > 1 or i % 7 == 0}
    found = {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        tokens = np.frombuffer(r.tokens, "<u4").tolist()
        assert len(tokens) == r.length <= window and r.doc_tokens == len(wanted[r.doc_id]) and r.start == len(found.get(r.doc_id, []))
        found[r.doc_id] = found.get(r.doc_id, []) + tokens
    assert found == wanted
    fill = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == fill.get(r.sequence_id, 0)
        fill[r.sequence_id] = r.offset + r.length
    assert sorted(fill) == list(range(len(fill))) and all(fill[s] == window for s in range(len(fill) - 1))
    assert pack(none, vocabulary(PLAIN), window).collect() == []


def test_packing_of_repeated_rows(repeated):
    rows = pack(repeated, vocabulary(PLAIN)).withColumn("crc", F.crc32("tokens")).collect()
    assert len(rows) == repeated.count()
    assert all(r.crc == zlib.crc32(bytes(r.tokens)) for r in rows)


def test_statistics(docs, texts, none):
    rows = {r.doc_id: r.asDict() for r in quality(docs).collect()}
    for i, t in enumerate(texts):
        want = brute.statistics(t)
        assert {c: rows[i][c] for c in want} == want, (i, t)
        assert rows[i]["kept"] == (not want["base_failed"])
    assert quality(none).collect() == []


def test_words_that_a_polynomial_confuses():
    """Modulo 2^64 a polynomial in any odd base takes a sequence built by doubling for its mirror."""
    import pyarrow as pa

    a, b = "a", "b"
    for _ in range(11):
        a, b = a + b, b + a
    s = text_statistics(pa.array([f"{a}\n{b}"]))
    assert s["n_dup_lines"].tolist() == [0] and len(set(s["line"].tolist())) == 2
    sets, bounds = kernels.shingle_sets(pa.array([f"x {a}", f"x {b}"]))
    assert bounds.tolist() == [0, 1, 2] and sets[0] != sets[1]
    out, at = encoding.WordEncoder(vocabulary(PLAIN)).encode(pa.array([f"{a} {b}"]), 2)
    assert out.tolist() == [*ids(PLAIN, f"{a} {b}"), 2]


def test_units_of_one_hash_are_told_apart(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(kernels, "span_hashes", lambda raw, starts, ends, salt=0: raw[starts].astype(np.uint64) % np.uint64(3))
    text = "alpha beta alphabetical alphanumeric zeta alphabetical zoological zoologists"
    encoder = encoding.WordEncoder(vocabulary(PLAIN))
    for _ in range(2):
        assert encoder.encode(pa.array([text]), 2)[0].tolist() == [*ids(PLAIN, text), 2]


def test_other_tokenizers_encode_whole_texts():
    import pyarrow as pa

    encoder = encoding.WordEncoder(vocabulary(BYTE))
    assert not encoder.by_words and encoder.encode(pa.array(["Hello  World", None]), 2)[0].tolist() == [*ids(BYTE, "Hello  World"), 2, 2]


def test_counter_cuts_long_parts_safely(monkeypatch):
    monkeypatch.setattr(encoding, "LONG_PART", 3)
    rng, counter = random.Random(5), encoding.TokenCounter(vocabulary(BYTE))
    for i in range(500):
        text = "".join(rng.choice("ab漢字カ。，,.:(\n\t 　'<|>19é\x1c ") for _ in range(rng.randint(0, 40))) + "<|endoftext|>" * (i % 7 == 0)
        assert counter.counts([text])[0] == len(ids(BYTE, text)), repr(text)


def test_texts_of_some_megabytes(spark):
    """Blanks, a run of letters, lines and ideographs; each whole text counts."""
    texts = [" " * 1_000_000, "x" * 300_000, "漢字。" * 200_000, "a b\n" * 400_000]
    docs = table(spark, texts)
    rows = {r.doc_id: r for r in quality(docs).collect()}
    assert [rows[i].n_words for i in range(4)] == [0, 1, 1, 800_000] and rows[3].n_dup_lines == 399_999
    found = {r.doc_id: r.n_bytes for r in count_tokens(docs, vocabulary(BYTE)).collect()}
    assert found == {i: len(t.encode()) for i, t in enumerate(texts)}
    assert {r.doc_id: r.n_words for r in scan_licenses(docs).collect()} == {0: 0, 1: 1, 2: 1, 3: 800_000}
    pieces = pack(docs, vocabulary(PLAIN)).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("m")).collect()
    assert all(p.n == p.m for p in pieces) and {p.doc_id: p.n for p in pieces}[0] == 1
    sizes = docs.select("doc_id", word_count(F.col("text")).alias("n")).collect()
    assert {r.doc_id: r.n for r in sizes} == {0: 0, 1: 1, 2: 1, 3: 800_000}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_quality_equals_sql(spark):
    """Where hosts are small, too: the limits are met, lines go."""
    import duckdb

    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    found, want = registry.QUERIES["op4_line_frequency"](spark, SF).toPandas(), c.sql(registry.ORACLES["op4_line_frequency"]).df()
    columns = sorted(want.columns)
    assert sorted(found.columns) == columns and found["n_lines_removed"].sum() > 0
    assert sorted(found[columns].itertuples(index=False, name=None)) == sorted(want[columns].itertuples(index=False, name=None))


def test_rejects_of_one_source_only_go_there(spark):
    """A text that is depleted in one source stays in another."""
    footer = prose(31, 1, 40)
    texts = [prose(i, 1, 2) + "\n" + footer for i in range(20)]
    docs = table(spark, texts + texts[:1] + [prose(500 + i, 4) for i in range(30)], ["a"] * 20 + ["b"] * 31, [*range(20), 0, *range(100, 130)])
    assert Counter((r.doc_id, r.source) for r in keep_good(docs, min_words=3, left_share=0.5).collect() if r.doc_id < 100) == {(0, "b"): 1}


def test_frequent_lines_deplete(spark):
    """A line of site furniture goes, the documents that hold nothing else are rejected; clean ones stay."""
    furniture = "home about contact terms privacy help search login register today"
    pages = [f"{prose(i, 1, 6)}\n{furniture}\n{prose(i + 5000, 1, 3)}" for i in range(40)]
    good = [prose(i + 100, 4) + "\n" + furniture + "\n" + prose(i + 9000, 4) for i in range(20)]
    others = [prose(7777 + i, 6) for i in range(60)]
    sources = ["site"] * 60 + ["others"] * 60
    found = {r.doc_id: r for r in quality(table(spark, pages + good + others, sources), min_documents=10, left_share=0.6).collect()}
    assert all(found[i].n_lines_removed == 1 and not found[i].kept for i in range(40))
    assert all(found[i].n_lines_removed == 1 and found[i].kept for i in range(40, 60))
    assert all(found[i].n_lines_removed == 0 and found[i].kept for i in range(60, 120))


def test_blocks_of_frequent_lines_deplete(spark):
    """A footer of five lines goes whole, though its inner lines have the same neighbours everywhere."""
    footer = "\n".join(prose(600 + i, 1, 12) for i in range(5))
    pages = [prose(i, 1, 8) + "\n" + footer for i in range(40)]
    good = [prose(100 + i, 10) + "\n" + footer for i in range(10)]
    found = {r.doc_id: r for r in quality(table(spark, pages + good, ["site"] * 50), min_documents=10).collect()}
    assert all(found[i].n_lines_removed == 5 for i in range(50))
    assert not any(found[i].kept for i in range(40)) and all(found[i].kept for i in range(40, 50))


def test_rejected_rows_go(repeated, docs, none):
    assert keep_good(repeated).columns == repeated.columns
    assert sorted(r.doc_id or -1 for r in keep_good(repeated).collect()) == [-1, -1, 5, 5, 5, 5, 9]
    assert keep_good(none).count() == 0
    kept = {r.doc_id for r in quality(docs).filter("kept").collect()}
    assert {r.doc_id for r in keep_good(docs).collect()} == kept


def test_license_base(spark, docs, texts, none):
    extra = ["GNU general-public license; MIT  License! cc by-sa 4.0 CC BY", "apache license apache licenses the apache license, version 2.0", "mit lizenz und mit licenses", "spdx-license-identifier: MPL-2.0 ccc by"]
    rows = scan_licenses(docs.unionByName(table(spark, extra, ids=list(range(9000, 9004))))).collect()
    every = dict(enumerate(texts)) | dict(zip(range(9000, 9004), extra, strict=True))
    for r in rows:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (every[r.doc_id] or "").translate(brute.LOWER))
        places = [(i, label) for phrase, label in licenses.PHRASES for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
        at = [i for i, _ in places]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(words), len(at), min(at, default=None), max(at, default=None))
        assert r.base_labels == ",".join(sorted({x for _, x in places}))
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1
        assert r.labels == ",".join(sorted(set(r.labels.split(","))))
    assert {r.doc_id: r.labels for r in rows}[9003] == "mpl,mpl-2.0" and scan_licenses(none).collect() == []


def test_license_labels_equal_a_scan_rule_by_rule():
    """Without the gate, and with overlaps resolved pair by pair."""
    scanner, rng = licenses.Scanner(), random.Random(3)
    pieces = ["GNU Lesser General\n * Public License, version 2.1", "licensed under the Apache License", "Version 2.0", "cc-by-nc-sa 4.0", "SPDX-License-Identifier: GPL-2.0-or-later OR MIT", "MIT license", "redistribution and use in source\n# and binary forms", "Copyright (c) 2019", "all rights reserved", "gpl v3", "Mozilla Public License 2.0", "creativecommons.org/licenses/by-sa/4.0", "public domain", "mit freundlichen", "the general public", ",", "\n"]
    seen = set()
    for _ in range(150):
        text = " ".join(rng.choice(pieces) for _ in range(rng.randint(1, 8))).lower()
        hits = [(r[1], m.start(), m.end(), r[0]) for r in scanner.rules for m in r[4].finditer(text)]
        taken = []
        for priority, a, b, label in sorted(hits, key=lambda h: (-h[0], h[1] - h[2], h[1], h[3])):
            if not any(x <= a and b <= y for x, y, _ in taken):
                taken.append((a, b, label))
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
        base = {label for phrase, label in licenses.PHRASES for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()}
        want = base | {x[2] for x in taken}
        assert scanner.scan(text.encode())[4] == ",".join(sorted(want)), text
        seen |= want
    assert len(seen) >= 12


def test_each_license_rule_holds_its_keyword():
    """A rule can only match where its keyword stands."""
    for line in licenses.RULES.strip().split("\n"):
        label, priority, weight, keyword, expression = line.split(" ", 4)
        assert keyword in expression.replace("\\", "") and 0 < float(weight) <= 1 and int(priority) > 0, line


def test_license_rules_resolve_overlaps():
    scanner = licenses.Scanner()
    assert len(scanner.rules) >= 200

    def labels(text):
        text = text.lower()
        return [x[0] for x in scanner.detect(text, {i for _, found in scanner.gate.iter(text) for i in found})]

    assert labels("under the GNU Lesser General Public License, version 2.1") == ["lgpl-2.1"]
    assert labels("Licensed under the Apache License, Version 2.0") == ["apache", "apache-2.0"]
    assert labels("CC-BY-NC-SA") == ["cc-by-nc-sa"]
    assert labels("Permission is hereby granted, free of charge, to any person obtaining a copy") == ["mit"]
    assert labels("nothing of the kind, mit freundlichen Grüßen") == []


def toxic_texts(n):
    insults = "gubba frotz snarg blimp".split()
    out = []
    for i in range(n):
        lines = prose(i, 5).split("\n")
        if i % 4 == 0:
            lines[2] += f" you {insults[i % 3]} {insults[(i // 4) % 4]}."
        out.append("\n".join(lines))
    return out


def plain_matches(symbols):
    """The grammar word by word, by looking at the words around."""
    out, late = [0] * len(toxicity.CHANNELS), None
    for i, s in enumerate(symbols):
        before = symbols[max(0, i - toxicity.REACH) : i]
        doubted = "reported" in symbols[:i] or "negation" in before
        if s == "insult":
            channel = "insult doubted" if doubted else "insult aimed" if "target" in before else "insult"
            out[toxicity.CHANNELS.index(channel)] += 1
            late = i if channel == "insult" else None
        if s == "target" and late is not None:
            out[toxicity.CHANNELS.index("insult aimed")] += i - late <= toxicity.REACH
            late = None
        if s == "threat":
            out[toxicity.CHANNELS.index("threat doubted" if doubted else "threat")] += 1
    stage = 0
    for s in symbols:
        if s == "threat":
            stage = 2 if stage else 0
        elif s == "target" and stage == 2:
            out[toxicity.CHANNELS.index("threat aimed")] += 1
            stage = 0
        elif s == "modal":
            stage = max(stage, 1)
    return out


def test_composed_grammar_equals_its_plain_reading():
    import pyarrow as pa

    word = {"other": "house", "target": "you", "modal": "will", "reported": "said", "negation": "not", "threat": "kill", "insult": "gubba"}
    raw, bounds = kernels.text_bytes(pa.array(["gubba"]))
    grammar = toxicity.Grammar(kernels.span_hashes(raw, bounds[:-1], bounds[1:]), np.ones(1))
    rng = random.Random(2)
    documents = [[[rng.choice(toxicity.SYMBOLS) for _ in range(rng.randint(1, 12))] for _ in range(rng.randint(1, 4))] for _ in range(400)]
    found = grammar.evidence(pa.array([". ".join(" ".join(word[s] for s in clause) for clause in d) for d in documents]))
    for row, d in zip(found, documents, strict=True):
        each = [plain_matches(clause) for clause in d]
        assert row[1:].tolist() == [float(sum(c[k] for c in each)) for k in range(1, len(toxicity.CHANNELS))], d
        assert row[0] == max(c[1] + c[2] + c[5] for c in each)
    assert len(grammar.following) > 50


def test_toxicity_held_out(spark, none):
    texts = toxic_texts(400)
    docs = table(spark, texts)
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(400)], "doc_id bigint, quality int, toxic int")
    rows = score_toxicity(docs, labels).collect()
    assert len(rows) == 400
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
    held = [r for r in rows if r.held_out]
    assert sum(r.predicted == (r.doc_id % 4 == 0) for r in held) / len(held) > 0.95
    assert score_toxicity(none, labels).collect() == []


def test_toxicity_ignores_held_out_labels(spark):
    docs = table(spark, toxic_texts(200))
    labels = [(i, int(i % 4 == 0)) for i in range(200)]
    turned = [(i, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, t in labels]
    one, two = ({r.doc_id: r.score for r in score_toxicity(docs, spark.createDataFrame(x, "doc_id bigint, toxic int")).collect()} for x in (labels, turned))
    assert one == two


def test_toxicity_without_labels(spark, repeated):
    rows = score_toxicity(repeated, spark.createDataFrame([], "doc_id bigint, toxic int")).collect()
    assert len(rows) == repeated.count() and len({r.score for r in rows}) == 1 and not any(r.predicted for r in rows)
