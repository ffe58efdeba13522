"""Every registered query against its SQL on the smallest tables."""

import math
import re
from collections import Counter
from dataclasses import replace
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from linkspark.functions import similarity
from linkspark.operators import features
from linkspark.plans import record_queries, registry

D = "/root/testdata/sf0.001"


def tidy(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


@pytest.fixture(autouse=True)
def few_trees(monkeypatch):
    monkeypatch.setattr(record_queries, "_MODEL", replace(record_queries._MODEL, iterations=2))


def pairs_of(rows):
    return {(r.s1_id, r.cand_id) for r in rows}


def capped(spark):
    return pairs_of(record_queries.capped(spark, D).collect())


def names(spark, column="name_full"):
    return {r.entity_id: r[column] for r in record_queries.norm(spark, D).collect()}


def check_kernel(kernel):
    def check(spark, rows):
        full = names(spark)
        assert pairs_of(rows) == capped(spark)
        assert [r.score for r in rows] == [pytest.approx(kernel(full[r.s1_id], full[r.cand_id]), abs=1e-6) for r in rows]

    return check


def check_features(spark, rows):
    full, core = names(spark), names(spark, "name_core")
    assert pairs_of(rows) == capped(spark)
    for r in rows:
        assert r.name_full_partial_ratio == pytest.approx(similarity.partial_ratio(full[r.s1_id], full[r.cand_id]), abs=1e-4)
        assert r.name_core_jaro_winkler == pytest.approx(similarity.jaro_winkler(core[r.s1_id], core[r.cand_id]), abs=1e-4)
        assert r.name_full_len_diff == abs(len(full[r.s1_id]) - len(full[r.cand_id]))


def check_scores(spark, rows):
    assert pairs_of(rows) == capped(spark) and len(rows) == len(pairs_of(rows))
    assert all(0 <= r.proba <= 1 for r in rows) and len({r.proba for r in rows}) > 1


def check_linked(spark, rows):
    ids = {r.s1_id for r in record_queries.ids(spark, D).collect()}
    assert {r.s1_id for r in rows} == ids
    kept = [(r.s1_id, r.cand_id) for r in rows if r.cand_id is not None]
    assert set(kept) <= capped(spark) and len({c for _, c in kept}) == len(kept)


def check_importance(spark, rows):
    assert {r.feature for r in rows} == set(features.FEATURES) and sum(r.importance for r in rows) == pytest.approx(1)


def check_transliterated(spark, rows):
    raw = {r.entity_id: r.business_name for r in record_queries.all_names(spark, D).collect()}
    got = {r.entity_id: r.value for r in rows}
    assert got["S2-a"].startswith("rAma mArkeTiMga") and got["S1-g"] == "" and got["S2-g"] is None
    indic = [k for k, v in raw.items() if v and any(0x900 <= ord(c) <= 0xD7F for c in v)]
    assert len(indic) == 12 and all(not any(0x900 <= ord(c) <= 0xD7F for c in got[k]) for k in indic)
    assert all(got[k] == v for k, v in raw.items() if k not in indic)


def check_votes(spark, rows):
    full, want = names(spark), Counter()
    for a, b in capped(spark):
        for token in full[a].split():
            scores = [(similarity.ratio(token, other), -k, other) for k, other in enumerate(full[b].split())]
            if scores and max(scores)[0] >= 65 and max(scores)[2] != token:
                want[token, max(scores)[2]] += 1
    assert {(r.translit_token, r.latin_token): r.votes for r in rows} == want


def check_slice(spark, rows):
    assert sum(r.is_eval for r in rows) >= 30 and all(r.entity_id.startswith("S1-") for r in rows if r.is_eval)
    assert len({r.entity_id for r in rows}) == len(rows)


def check_scan(spark, rows):
    flat = {r.entity_id: " ".join(re.split(r"[\t\r\n]+", r.business_name)) for r in record_queries.raw(spark, D).collect()}
    assert {r.entity_id: r.business_name for r in rows} == flat


WITHOUT_SQL = {
    "sim_ratio": check_kernel(similarity.ratio), "sim_token_set": check_kernel(similarity.token_set_ratio), "sim_partial": check_kernel(similarity.partial_ratio), "pair_features": check_features,
    "oof_scores": check_scores, "ensemble_predict": check_scores, "linked": check_linked, "feature_importance": check_importance, "transliterate": check_transliterated, "align_votes": check_votes, "val_slice": check_slice, "scan_tsv": check_scan,
}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in Path(D).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, con, name):
    df = registry.queries()[name](spark, D)
    rows = df.collect()
    if name not in registry.oracle_sql():
        assert rows and name in WITHOUT_SQL
        WITHOUT_SQL[name](spark, rows)
        return
    result = con.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(df.columns)
    want = Counter(tuple(tidy(v) for v in r) for r in result.fetchall())
    assert Counter(tuple(tidy(r[c]) for c in columns) for r in rows) == want


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
