"""The stages on one input, and the registration."""

import base64
import hashlib
import zlib
from collections import Counter

import public_tokenizers
import pytest
import tiktoken

import __spark_entry__
import corpus_pipeline
from linkspark.llm import registry
from tests.llm.samples import SCHEMA, documents
from tests.llm.test_texts import brute_spans, shingles


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """(name, columns, rows in, rows out) of each stage over the small table with an odd column more."""
    root = tmp_path_factory.mktemp("pipeline")
    path = f"{root}/documents.parquet"
    odd = ["_mix_rate", "_mix_source", "_blob", "_spans", "_masked", "_class", "_key", "class", "label", "size", "block", "data"]
    table = spark.createDataFrame(documents(), SCHEMA)
    table.selectExpr("*", *[f"'{c}' AS `{c}`" for c in odd]).repartition(2).write.parquet(path)
    out = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = spark.read.parquet(path)
        path = f"{root}/{k}"
        stage(spark, before, str(root)).write.parquet(path)
        after = spark.read.parquet(path)
        out.append((name, after.columns, before.collect(), after.collect()))
    return out


def test_columns(stages):
    for _, columns, _, _ in stages[:-1]:
        assert columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"] and len(columns) == 17
    for _, _, _, after in stages[:-1]:
        assert after and all(r["_key"] == "_key" and r["label"] == "label" for r in after)


def test_language_keeps_all_with_letters(stages):
    _, _, before, after = stages[0]
    assert Counter(map(str, after)) == Counter(str(r) for r in before if any(c.isalpha() for c in r.text or ""))


def test_language_without_labels(spark):
    rows = [(i, t, None, s, n) for i, t, _, s, n in documents()]
    lettered = Counter(t for _, t, *_ in rows if any(c.isalpha() for c in t or ""))
    assert Counter(r.text for r in corpus_pipeline.identify_language(spark, spark.createDataFrame(rows, SCHEMA), "").collect()) == lettered
    fold = [k for k in range(100) if zlib.crc32(str(k).encode()) % 4 == 2][:3]
    rows = [(k, f"some words {k}", "en", None, None) for k in fold] + [(None, "12 !", None, None, None), (None, None, "en", None, None)]
    assert {r.doc_id for r in corpus_pipeline.identify_language(spark, spark.createDataFrame(rows, SCHEMA), "").collect()} == set(fold)


def test_one_of_each_group_stays(stages):
    _, _, before, after = stages[1]
    sets = [shingles(r.text, 5) for r in after]
    for k, a in enumerate(sets):
        for b in sets[:k]:
            assert 100 * len(a & b) < 80 * len(a | b)
    for r in before:
        s = shingles(r.text, 5)
        assert any(100 * len(s & a) >= 80 * len(s | a) for a in sets)


def test_secrets_are_masked(stages):
    _, _, before, after = stages[2]
    assert len(after) == len(before)
    assert not any(brute_spans(r.text) for r in after)
    clean = Counter(str(r) for r in before if not brute_spans(r.text))
    assert clean == Counter(str(r) for r in after if "[SECRET]" not in (r.text or ""))


def test_mix_and_ids(stages):
    _, _, before, after = stages[3]
    assert set(map(str, after)) <= set(map(str, before))
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    _, _, before, after = stages[4]
    assert Counter((r.doc_id, tuple(r.ids)) for r in after) == Counter((r.doc_id, tuple(own.encode_ordinary(r.text or ""))) for r in before)


def test_stages_on_nothing(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "0"))
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, spark.read.parquet(str(tmp_path / str(k))), str(tmp_path)).write.parquet(str(tmp_path / str(k + 1)))
        assert spark.read.parquet(str(tmp_path / str(k + 1))).count() == 0


def test_stages_on_nulls_and_long_texts(spark, tmp_path):
    rows = [(None, None, None, None, None)] * 2 + [(1, "word " * 400_000, "en", "a", None), (2, "x" * 1_000_000, "en", "a", 1)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "0"))
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, spark.read.parquet(str(tmp_path / str(k))), str(tmp_path)).write.parquet(str(tmp_path / str(k + 1)))
    assert {r.doc_id for r in spark.read.parquet(str(tmp_path / "2")).collect()} == {1, 2}
    ids = {r.doc_id: r.ids for r in spark.read.parquet(str(tmp_path / "5")).collect()}
    assert all(len(x) > 400_000 / 8 for x in ids.values())


def test_run_over_files(spark):
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    assert rows and hashlib.sha256(str(sorted(map(str, rows))).encode()).digest() == hashlib.sha256(str(sorted(map(str, corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()))).encode()).digest()


def test_registered():
    names = __spark_entry__.queries()
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10 and "pipeline" in names
    assert set(registry.oracle_sql()) <= set(registry.queries())


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql(spark, name):
    import duckdb

    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    df = registry.queries()[name](spark, d)
    result = con.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert Counter(map(str, map(tuple, df.select(*columns).collect()))) == Counter(map(str, result.fetchall()))
