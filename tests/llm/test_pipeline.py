"""The pipeline against its stages done plainly, and the registered queries against their SQL."""

import collections
import re

import pytest

import corpus_pipeline
from peakfold.llm import queries
from tests.conftest import SF
from tests.llm.test_jaccard import brute as components
from tests.llm.test_mixing_sharding import size, targets


def test_stages(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "decontamination", "mixing", "sharding"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        rows = out.collect()
        seen[name] = rows
        if name != "sharding":
            assert out.columns == names
            docs = spark.createDataFrame(rows, out.schema)
    given = spark.read.parquet(f"{SF}/documents.parquet").collect()
    lettered = {r.doc_id for r in given if re.search(r"[^\W\d_]", r.text or "")}
    assert {r.doc_id for r in seen["language_id"]} <= lettered and len(seen["language_id"]) >= 0.998 * len(lettered)
    first = components([(r.doc_id, r.text) for r in seen["language_id"]])
    assert {r.doc_id for r in seen["near_duplicates"]} == {d for d, n, c in first if d == c or not n}
    bare = lambda t: [w.lower().strip(".,;:!?\"'()[]{}") or w for w in t.split()]
    runs = [" ".join(bare(r.text)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    whole = {r.doc_id for r in seen["near_duplicates"] if any(f" {x} " in f" {' '.join(bare(r.text))} " for x in runs)}
    kept = {r.doc_id for r in seen["decontamination"]}
    assert kept <= {r.doc_id for r in seen["near_duplicates"]} - whole and len(kept) >= len(seen["near_duplicates"]) - len(whole) - 2
    sizes, taken = collections.Counter(), collections.Counter()
    source = {r.doc_id: r.source for r in seen["decontamination"]}
    for r in seen["decontamination"]:
        sizes[r.source] += size(r.text)
    for r in seen["mixing"]:
        taken[source[r.doc_id]] += size(r.text)
    for s, w in targets(sizes, (3, 1, 2), 1.5, 2.0).items():
        assert abs(taken[s] - w) <= 0.01 * w + 1
    counts = collections.Counter(r.shard for r in seen["sharding"])
    assert len(seen["sharding"]) == len(seen["mixing"]) and max(counts.values()) - min(counts.get(s, 0) for s in range(40)) <= 1


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, duck, name):
    df = queries.queries()[name](spark, SF)
    got = duck.execute(queries.oracle_sql()[name])
    order = [[x[0] for x in got.description].index(c) for c in df.columns]
    assert sorted((tuple(r) for r in df.collect()), key=str) == sorted((tuple(r[i] for i in order) for r in got.fetchall()), key=str)


@pytest.mark.parametrize("name", ["op1_toxicity", "op2_decontaminate", "op3_pii", "op4_language", "op5_mixing", "op6_sharding", "op7_jaccard", "op8_repeats"])
def test_contract_columns(spark, name):
    want = {
        "op1_toxicity": {"doc_id", "held_out", "score", "predicted"}, "op2_decontaminate": {"doc_id"}, "op3_pii": {"doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"}, "op4_language": {"doc_id", "held_out", "lang_pred", "score"},
        "op5_mixing": {"doc_id", "size", "source_size", "target", "taken"}, "op6_sharding": {"doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"}, "op7_jaccard": {"doc_id", "n_shingles", "component_id"}, "op8_repeats": {"doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"},
    }[name]
    df = queries.queries()[name](spark, SF)
    assert want <= set(df.columns)
    if name != "op2_decontaminate":
        assert df.count() == spark.read.parquet(f"{SF}/documents.parquet").count()


def test_stages_on_odd_rows(spark, odd, none):
    """Nulls in every column, empty and long texts, repeated rows and extra columns of clashing names, through the whole chain; then
    a table without rows."""
    docs, names = odd, odd.columns
    counts = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        rows = out.collect()
        assert {"doc_id", "text", "lang", "source", "n_chars"} <= set(out.columns)
        if name in ("language_id", "near_duplicates", "decontamination"):
            assert out.columns == names and all(r.text and r.text.strip() for r in rows)
        counts.append(len(rows))
        docs = spark.createDataFrame(rows, out.schema)
    # Texts without letters go, then copies of 1, 2, 3 and the repeated row; a row without doc_id is a document like any other.
    assert counts[0] >= counts[1] >= counts[2] >= counts[3] == counts[4] > 3
    docs = none
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() == 0
        docs = spark.createDataFrame([], out.schema)
