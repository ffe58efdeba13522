"""Blocks, decisions, metrics, learning, files."""

import dataclasses
import threading
from collections import Counter

import pytest
from pyspark.sql import functions as F

from linkspark.functions import similarity
from linkspark.operators import blocking, decide, evaluate, features, learning, model, products, replay, slices
from linkspark.operators.config import BlockingConfig, DecideConfig, ModelConfig
from linkspark.plans import record_queries
from linkspark.sources import records, sinks, storage

RECORD = "entity_id string, business_name string, business_address string, country string"


def pairs_of(df):
    return {(r.s1_id, r.cand_id) for r in df.collect()}


def table(spark, rows):
    return spark.createDataFrame([(*r, "US") if len(r) == 3 else r for r in rows], RECORD)


def no_suffixes(spark):
    return spark.createDataFrame([], "country string, token string")


def norm(spark, rows):
    return learning.normalized(table(spark, rows), no_suffixes(spark))


# ---- blocks


def test_exact_core_and_cap(spark):
    n = norm(spark, [("S1-1", "Acme", None), ("S1-2", "", None)] + [(f"S2-{k:02}", "ACME!", None) for k in range(30)] + [("S3-1", "", None), ("S3-2", "acme", None, "DE")])
    s1, cand = blocking.split_sources(n)
    assert pairs_of(blocking.block_exact_core(s1, cand)) == {("S1-1", f"S2-{k:02}") for k in range(20)}


def test_rare_token_prefers_rare_and_drops_stop_words(spark):
    n = norm(spark, [("S1-1", "zeta common stop", None), ("S2-1", "zeta", None), ("S2-2", "common", None), ("S2-3", "common", None), ("S2-4", "stop", None)])
    s1, cand = blocking.split_sources(n)
    stop = spark.createDataFrame([("US", "stop")], "country string, token string")
    run = lambda cfg: pairs_of(blocking.block_rare_token(blocking.name_tokens(s1), blocking.name_tokens(cand), stop, cfg))
    assert run(BlockingConfig()) == {("S1-1", "S2-1"), ("S1-1", "S2-2"), ("S1-1", "S2-3")}
    assert run(BlockingConfig(per_block_cap=1)) == {("S1-1", "S2-1")}
    assert run(BlockingConfig(max_name_token_df=1)) == {("S1-1", "S2-1")}


def test_postal_needs_a_shared_token(spark):
    n = norm(spark, [("S1-1", "alpha beta", "x 560001"), ("S2-1", "alpha beta", "y 560001"), ("S2-2", "gamma", "z 560001"), ("S2-3", "alpha", "q 560002")])
    s1, cand = blocking.split_sources(n)
    got = blocking.block_postal(s1, cand, blocking.name_tokens(s1), blocking.name_tokens(cand))
    assert sorted(map(tuple, got.collect())) == [("S1-1", "S2-1")] * 2


def test_sorted_neighborhood_by_brute_force(spark):
    rows = [(f"S{1 + k % 3}-{k:03}", f"name {(k * 7) % 40:02}", None, "US" if k % 4 else "DE") for k in range(120)]
    n = norm(spark, rows).repartition(7).cache()
    s1, cand = blocking.split_sources(n)
    want = set()
    for country in ("US", "DE"):
        order = sorted((r.name_core, r.entity_id) for r in n.filter(F.col("country") == country).collect())
        for i, (_, a) in enumerate(order):
            if a.startswith("S1"):
                near = sorted((abs(i - j), b) for j, (_, b) in enumerate(order) if 0 < abs(i - j) <= 10 and not b.startswith("S1"))
                want |= {(a, b) for _, b in near[:20]}
    assert pairs_of(blocking.block_sorted_neighborhood(s1, cand)) == want


def test_geo_cap(spark):
    rows = [("S1-1", "a", "1 Raretown Road"), ("S1-2", "b", "2 Commonplaza Road")]
    rows += [(f"S2-{k}", "c", "1 Raretown Road") for k in range(3)] + [(f"S3-{k}", "d", "2 Commonplaza Road") for k in range(4)]
    for most, want in ((3, 3), (10, 7)):
        cfg = BlockingConfig(min_geo_token_df=1, max_geo_token_df=most)
        s1, cand = blocking.split_sources(norm(spark, rows))
        assert blocking.block_geo(blocking.geo_tokens(s1, cfg), blocking.geo_tokens(cand, cfg), cfg).count() == want


def test_address_block(spark):
    n = norm(spark, [("S1-1", "a", "221 Zenithbrook Lane, Austin"), ("S2-1", "b", "221 Zenithbrook Lane, Austin"), ("S2-2", "c", "999 Main St, Reno")])
    s1, cand = blocking.split_sources(n)
    got = blocking.block_address(s1, cand, blocking.address_tokens(s1), blocking.address_tokens(cand), BlockingConfig(min_address_token_df=1))
    assert pairs_of(got) == {("S1-1", "S2-1")}


def test_gram_block(spark):
    n = norm(spark, [("S1-1", "butler hall", None), ("S1-2", "acme", None), ("S2-1", "butlerhallcom", None), ("S2-2", "unrelated widgets", None), ("S2-3", "acme", None)])
    s1, cand = blocking.split_sources(n)
    got = pairs_of(blocking.block_tfidf(s1, cand, BlockingConfig(gram_max_df=1.0, gram_min_similarity=0.1, per_block_cap=5)))
    assert ("S1-1", "S2-1") in got and ("S1-2", "S2-3") in got and ("S1-1", "S2-2") not in got
    assert blocking.block_tfidf(s1.limit(0), cand.limit(0)).count() == 0
    same = norm(spark, [("S1-1", "identical name", None)] + [(f"S2-{k:02}", "identical name", None) for k in range(30)])
    assert blocking.block_tfidf(*blocking.split_sources(same), BlockingConfig(gram_max_df=1.0, gram_min_similarity=0.0, per_block_cap=5)).count() == 5


@pytest.mark.parametrize("chunks", [(3, 4), (1 << 14, 1 << 16)])
def test_blocks_of_sums_make_no_rows_of_pairs(spark, monkeypatch, chunks):
    monkeypatch.setattr(products, "REFERENCES", chunks[0])
    monkeypatch.setattr(products, "CANDIDATES", chunks[1])
    words = ["alba", "brook", "cedar", "delta", "ember", "fjord"]
    rows = [(f"S{1 + k % 3}-{k:03}", " ".join(words[(k * j) % 6] for j in range(1, 2 + k % 4)), f"{k % 5} " + " ".join(words[(k + j * j) % 6] for j in range(k % 3)), "UV"[k % 7 == 0]) for k in range(60)] + [("S1-900", "alba", None, None), ("S2-900", "alba", None, None)]
    cfg = BlockingConfig(per_block_cap=4, min_address_token_df=1, gram_max_df=1.0)
    s1, cand = blocking.split_sources(storage.written(norm(spark, rows), "norm"))
    a, b, x, y = blocking.name_tokens(s1), blocking.name_tokens(cand), blocking.address_tokens(s1), blocking.address_tokens(cand)

    def best(scores):
        found = {}
        for (one, other), score in sorted(scores.items(), key=lambda z: (-z[1], z[0][1])):
            found.setdefault(one, []).append(other)
        return {(one, other) for one, others in found.items() for other in others[: cfg.per_block_cap]}

    def sums(tokens, others):
        return {(r.s1_id, r.cand_id): r.score for r in blocking.rarity_scores(tokens, others, blocking.token_df(others)).collect()}

    house = {r.entity_id: r.house_number for r in s1.unionByName(cand).collect()}
    near = {p: round(v + 2.0 * (house[p[0]] is not None and house[p[0]] == house[p[1]]), 9) for p, v in sums(x, y).items()}
    weight = {}
    for r in blocking.gram_weights(s1.unionByName(cand), cfg).filter("country is not null").collect():
        weight.setdefault((r.entity_id, r.country), {})[r.gram] = r.weight
    alike = {(p[0], q[0]): round(sum(w * v.get(g, 0) for g, w in u.items()), 9) for p, u in weight.items() for q, v in weight.items() if p[0] < "S2" <= q[0] and p[1] == q[1]}
    plain = BlockingConfig(per_block_cap=4, max_name_token_df=10_000)
    blocks = {"rare": (blocking.block_rare_token(a, b, no_suffixes(spark), plain), sums(a, b)), "address": (blocking.block_address(s1, cand, x, y, cfg), near), "grams": (blocking.block_tfidf(s1, cand, cfg), {p: v for p, v in alike.items() if v >= 0.3})}
    for found, scores in blocks.values():
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert pairs_of(found) == best(scores) and found.count() == len(best(scores))
        assert "FlatMapCoGroupsInArrow" in plan and "SortMergeJoin" not in plan


def test_replay_counts_what_each_block_finds(spark, monkeypatch):
    monkeypatch.setattr(replay, "REFERENCES", 5)
    words = ["alba", "brook", "cedar", "delta", "ember", "fjord"]
    rows = [(f"S{1 + k % 3}-{k:03}", " ".join(words[(k * j) % 6] for j in range(1, 2 + k % 4)), f"{k % 5} " + " ".join(words[(k + j * j) % 6] for j in range(k % 4)) + (" 12345" if k % 4 else ""), "UV"[k % 7 == 0]) for k in range(60)] + [("S1-900", "alba", None, None), ("S2-900", "alba", None, None), ("S1-901", "", "", "U")]
    records_ = storage.written(norm(spark, rows), "norm")
    truth = spark.createDataFrame([(f"S1-{k:03}", f"S2-{j:03}") for k in range(0, 60, 3) for j in range(1, 60, 15)] * 2 + [("S1-000", "S2-none"), ("S1-none", "S2-001")], "s1_id string, cand_id string")
    configs = {"first": BlockingConfig(per_block_cap=2, max_name_token_df=15, window=1), "more": BlockingConfig(per_block_cap=5, max_name_token_df=15, window=1), "most": BlockingConfig(per_block_cap=50, max_name_token_df=99, window=4)}
    configs = {name: dataclasses.replace(c, min_geo_token_df=1, min_address_token_df=1, gram_max_df=1.0, with_grams=True) for name, c in configs.items()}
    want, missed, true = set(), None, {(r.s1_id, r.cand_id) for r in truth.collect()}
    for name, cfg in configs.items():
        found = {block: pairs_of(pairs) for block, pairs in blocking.all_blocks(records_, no_suffixes(spark), cfg).items()}
        found["all"] = set().union(*found.values())
        missed = true - found["all"] if missed is None else missed
        want |= {(name, block, len(pairs), len(pairs & true), len(pairs & missed)) for block, pairs in found.items() if pairs}
    got = replay.relaxed_replay(truth, records_, no_suffixes(spark), configs)
    assert set(map(tuple, got.collect())) == want and len({x[1] for x in want}) > 5
    with pytest.raises(ValueError):
        replay.relaxed_replay(truth, records_, no_suffixes(spark), configs | {"other": BlockingConfig()})


def test_union_and_cap(spark):
    a = spark.createDataFrame([("S1-1", "S2-1"), ("S1-1", "S2-1"), ("S1-1", "S2-2")], "s1_id string, cand_id string")
    b = spark.createDataFrame([("S1-1", "S2-2")], "s1_id string, cand_id string")
    got = {tuple(r) for r in blocking.cap_candidates(blocking.union_and_score({"x": a, "y": b}), 1).collect()}
    assert got == {("S1-1", "S2-2", "x,y", 2, 1)}


def test_learned_stop_tokens(spark):
    rows = table(spark, [(f"S1-{k}", f"firm{k} ltd & co", None) for k in range(60)] + [("S1-x", "odd", None)])
    got = {r.token for r in learning.suffix_tokens(rows).collect()}
    assert got == {"limited", "and", "company"}


# ---- decisions and metrics

SCORED = "s1_id string, cand_id string, proba double"
PAIRS = "s1_id string, cand_id string"


def test_one_to_one(spark):
    got = decide.one_to_one(spark.createDataFrame([("S1-1", "S2-1", 0.6), ("S1-2", "S2-1", 0.9), ("S1-3", "S2-2", 0.3), ("S1-9", "S2-2", 0.3)], SCORED))
    assert pairs_of(got) == {("S1-2", "S2-1"), ("S1-3", "S2-2")}


@pytest.mark.parametrize(("probs", "kept"), [([0.95], 1), ([0.02], 0), ([0.9, 0.85, 0.05], 2), ([0.47], 0), ([0.48], 1), ([1.0, 1.0], 2), ([0.0], 0)])
def test_expected_f_subset(spark, probs, kept):
    rows = [("S1-1", f"S2-{k}", p) for k, p in enumerate(probs)]
    assert pairs_of(decide.expected_f_subset(spark.createDataFrame(rows, SCORED))) == {(a, b) for a, b, _ in rows[:kept]}


def test_threshold_and_decide(spark):
    scored = spark.createDataFrame([("S1-1", "S2-1", 0.9), ("S1-2", "S2-2", 0.3)], SCORED)
    truth = spark.createDataFrame([("S1-1", "S2-1")], PAIRS)
    ids = spark.createDataFrame([("S1-1",), ("S1-2",), ("S1-3",)], "s1_id string")
    best = decide.tune_threshold(scored, truth, ids, DecideConfig(thresholds=(0.5, 0.95))).first()
    assert (best.threshold, best.f) == (0.5, 1.0)
    assert pairs_of(decide.global_threshold(scored, 0.5)) == {("S1-1", "S2-1")}
    out = decide.decide(scored, ids, truth).collect()
    assert {(r.s1_id, r.cand_id) for r in out} == {("S1-1", "S2-1"), ("S1-2", None), ("S1-3", None)}
    assert {r.policy for r in decide.decide(scored, ids).collect()} == {"expected_f"}


def scores(spark, preds, truth, ids):
    p, t = (spark.createDataFrame(x, PAIRS) for x in (preds, truth))
    return p, t, spark.createDataFrame([(x,) for x in ids], "s1_id string")


def test_f_beta_edges(spark):
    truth = [("a", "x"), ("a", "y"), ("b", "z"), ("d", "x"), ("e", "x"), ("g", "1"), ("g", "2"), ("g", "3"), ("g", "4"), ("h", "1"), ("h", "2"), ("h", "3"), ("h", "4")]
    preds = [("a", "x"), ("a", "q"), ("a", "y"), ("c", "z"), ("d", "x"), ("e", "w"), *[("g", str(k)) for k in range(1, 6)], *[("h", str(k)) for k in range(1, 4)]]
    got = {r.s1_id: r.f for r in evaluate.entity_f_beta(*scores(spark, preds, truth, "abcdefgh")).collect()}
    assert got["a"] == pytest.approx(5 / 7)
    assert [got[k] for k in "bcdef"] == [0, 0, 1, 0, 1]
    assert got["g"] < got["h"]


def test_means(spark):
    args = scores(spark, [("hit", "1"), ("wrong", "1")], [("hit", "1"), ("miss", "2")], ["hit", "single", "miss"])
    assert evaluate.macro_f_beta(*args).first().f == pytest.approx(2 / 3)
    assert evaluate.macro_f_beta(*scores(spark, [], [], [])).first().f == 0
    two = scores(spark, [("s", "1")], [], ["s", "t"])
    assert evaluate.singleton_accuracy(*two).first().accuracy == 0.5
    assert evaluate.singleton_accuracy(*scores(spark, [], [("s", "1")], ["s"])).first().accuracy is None
    micro = evaluate.micro_pr(*scores(spark, [("a", "S2-1"), ("b", "S3-1"), ("b", "S3-2")], [("a", "S2-1"), ("a", "S2-2"), ("b", "S3-1")], ["a", "b"])).first()
    assert (micro.tp, micro.n_pred, micro.n_truth) == (2, 3, 3) and micro.precision == pytest.approx(2 / 3)
    groups = spark.createDataFrame([("a", "US"), ("b", "India")], "s1_id string, grp string")
    got = {r.grp: (r.n, r.f) for r in evaluate.group_metrics(*scores(spark, [("a", "1")], [("a", "1"), ("b", "2")], ["a", "b", "c"]), groups).collect()}
    assert got == {"US": (1, 1.0), "India": (1, 0.0), "unknown": (1, 1.0)}
    assert evaluate.score_report(*args, groups).count() >= 5


# ---- features and model


def test_context_and_labels(spark):
    f = spark.createDataFrame([("a", "x", 90.0), ("a", "y", 80.0), ("b", "x", 95.0)], "s1_id string, cand_id string, name_full_ratio double")
    got = {(r.s1_id, r.cand_id): (r.rank_by_s1, r.gap_to_best_by_s1, r.reverse_rank) for r in features.context_features(f).collect()}
    assert got == {("a", "x"): (1, 0.0, 2), ("a", "y"): (2, 10.0, 1), ("b", "x"): (1, 0.0, 1)}
    truth = spark.createDataFrame([("a", "x"), ("a", "x")], PAIRS)
    assert {(r.s1_id, r.cand_id): r.label for r in features.label_pairs(f, truth).collect()} == {("a", "x"): 1, ("a", "y"): 0, ("b", "x"): 0}


def test_pair_features(spark):
    n = norm(spark, [("S1-1", "Acme Corp", "12 Main St 560001"), ("S2-1", "acme corporation", "12 main street 560001"), ("S3-1", "other", None)])
    pairs = spark.createDataFrame([("S1-1", "S2-1", "b1_exact_core,b2_rare_token", 2), ("S1-1", "S3-1", "bgeo_address_token", 1)], "s1_id string, cand_id string, blocks string, n_blocks long")
    rows = {r.cand_id: r for r in features.pair_features(pairs, n).collect()}
    assert len(rows["S2-1"]) == 24
    a, b = rows["S2-1"], rows["S3-1"]
    assert a.name_full_ratio == a.name_core_jaro_winkler == 100 and a.digit_jaccard == 1 and a.postal_equal == 1 and a.source_is_s2 == 1
    assert (a.block_b1_exact_core, a.block_bgeo_address_token, a.n_blocks) == (1, 0, 2)
    assert b.postal_missing == 1 and b.address_ratio == 0 and b.digit_jaccard == 0 and b.source_is_s2 == 0


def test_folds_and_models(spark, tmp_path):
    rows = [(f"S1-{k % 40}", f"S2-{k}", float(k % 2), float(k % 2) + (k % 7) * 0.01) for k in range(200)]
    df = spark.createDataFrame(rows, "s1_id string, cand_id string, label double, x double")
    cfg = ModelConfig(folds=2, iterations=2, depth=2, min_instances=1)
    scored, models = model.train_oof(df, ["x"], cfg)
    got = scored.collect()
    assert len(got) == 200 and all((r.proba > 0.5) == (r.label == 1) for r in got)
    assert df.select("s1_id", model.group_fold(F.col("s1_id"), 2).alias("f")).distinct().count() == 40
    model.save(models, str(tmp_path))
    again = model.predict(model.load(str(tmp_path), 2), df, ["x"])
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, model.predict(models, df, ["x"]).collect()))
    assert model.importance(models, ["x"])[0][0] == "x"


def test_folds_are_trained_two_at_a_time(spark, monkeypatch):
    both, made = threading.Barrier(2), model._classifier

    def classifier(cfg, fold):
        both.wait(60)  # breaks if no other fold begins
        return made(cfg, fold)

    monkeypatch.setattr(model, "_classifier", classifier)
    df = spark.createDataFrame([(f"S1-{k}", f"S2-{k}", float(k % 2), k % 2 + (k % 7) * 0.01) for k in range(200)], "s1_id string, cand_id string, label double, x double")
    scored, models = model.train_oof(df, ["x"], ModelConfig(folds=2, iterations=2, depth=2, min_instances=1))
    assert len(models) == 2 and all((r.proba > 0.5) == (r.label == 1) for r in scored.collect())


def test_queries_train_every_tree(spark, monkeypatch):
    """What the trained queries ask of each fold, where only one tree is then grown."""
    asked, folders, made = [], [], model._classifier

    def classifier(cfg, fold):
        asked.append(made(cfg, fold).getMaxIter())
        return made(cfg, fold).setMaxIter(1)

    pairs = spark.range(200).select(F.concat(F.lit("S1-"), "id").alias("s1_id"), F.concat(F.lit("S2-"), "id").alias("cand_id"), *[(F.col("id") % 2).cast("float").alias(c) for c in features.FEATURES[:22]])
    monkeypatch.setattr(model, "_classifier", classifier)
    monkeypatch.setattr(spark.sparkContext, "getCheckpointDir", lambda: None)
    monkeypatch.setattr(spark.sparkContext, "setCheckpointDir", folders.append)
    monkeypatch.setattr(record_queries, "_features", lambda spark, d: pairs)
    monkeypatch.setattr(record_queries, "truth", lambda spark, d: pairs.filter("n_blocks = 1").select("s1_id", "cand_id"))
    _, scored, models = record_queries._trained(spark, "")
    assert scored.count() == 200 and len(models) == 5
    assert asked == [ModelConfig().iterations] * 5 == [300] * 5
    assert len(folders) == 1  # else the lineage of 300 trees is never cut


def test_alignment(spark):
    rows = [("praivet limited", "private limited")] * 6 + [("praivet", "pirate")]
    votes = learning.align_votes(spark.createDataFrame(rows, "translit string, latin string"))
    got = {(r.translit_token, r.latin_token): r.votes for r in votes.collect()}
    assert got[("praivet", "private")] == 6
    assert [(r.translit_token, r.latin_token) for r in learning.dominant_map(votes).collect()] == [("praivet", "private")]
    stages = learning.overlap_stages(spark.createDataFrame([("प्राइवेट", "private")], "native string, other string"), spark.createDataFrame([("praivet", "private")], "translit_token string, latin_token string"))
    assert {r.stage: r.n_overlap for r in stages.collect()} == {"none": 0, "schwa": 0, "map": 1}


@pytest.mark.parametrize("step", [5, 1 << 20])
def test_alignment_makes_no_rows_of_token_pairs(spark, monkeypatch, step):
    monkeypatch.setattr(learning, "_TOKEN_PAIRS", step)
    words = ["praivet", "private", "pirate", "limited", "limted", "ltd", "a", "ab", "bolt", "belt"]
    rows = [(" ".join(words[(k * j) % 10] for j in range(k % 7)), " ".join(words[(k + 3 * j) % 10] for j in range(k % 5))) for k in range(60)] + [(None, "ab"), ("ab", None), ("x " * 40, "y ab")]
    want = Counter()
    for a, b in rows:
        for x in (a or "").split():
            scored = [(-similarity.ratio(x, y), k, y) for k, y in enumerate((b or "").split())]
            if scored and -min(scored)[0] >= 65 and min(scored)[2] != x:
                want[x, min(scored)[2]] += 1
    votes = learning.align_votes(spark.createDataFrame(rows, "translit string, latin string"))
    plan = votes._jdf.queryExecution().executedPlan().toString()
    assert {(r.translit_token, r.latin_token): r.votes for r in votes.collect()} == want
    assert "Generate" not in plan and "Join" not in plan and plan.count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("most", [10, 0])
def test_token_map_by_value_or_join(spark, monkeypatch, most):
    monkeypatch.setattr(learning, "MAX_MAP_ENTRIES", most)
    table_ = spark.createDataFrame([(1, "a b a c"), (2, ""), (3, "c")], "k int, x string")
    token_map = spark.createDataFrame([("a", "z"), ("c", "y")], "translit_token string, latin_token string")
    got = learning.apply_token_map(table_, "k", "x", token_map)
    assert {r.k: r.x for r in got.collect()} == {1: "z b z y", 2: "", 3: "y"}


# ---- slices and files


def test_validation_slice(spark):
    rows = [(f"S1-{k}", f"n{k}", f"{k} elm grove oak{k % 3}") for k in range(9)] + [(f"S2-{k}", f"n{k}", f"{k} pine oak{k % 3}") for k in range(9)]
    r = table(spark, rows)
    truth = spark.createDataFrame([(f"S1-{k}", f"S2-{k}") for k in range(9)], PAIRS)
    got = slices.validation_slice(r, truth, 3).collect()
    evals = {x.entity_id for x in got if x.is_eval}
    assert len(evals) == 3 and all(f"S2-{e[3:]}" in {x.entity_id for x in got} for e in evals)
    assert all(x.entity_id.startswith("S1-") for x in got if x.is_eval)


def test_tsv_round_trip(spark, tmp_path):
    path = tmp_path / "in.tsv"
    path.write_text('entity_id\tbusiness_name\tbusiness_address\tcountry\nS1-1\tA "b" \\c\t\tUS\n', encoding="utf-8")
    assert [tuple(r) for r in records.scan_tsv(spark, str(path)).collect()] == [("S1-1", 'A "b" \\c', None, "US")]
    ids = spark.createDataFrame([("S1-2",), ("S1-1",)], "s1_id string")
    pairs = spark.createDataFrame([("S1-1", "S3-1"), ("S1-1", "S2-9"), ("S1-1", "S2-10")], PAIRS)
    sinks.write_id_lists(pairs, ids, sinks.MATCH_HEADER, str(tmp_path / "out"))
    lines = [x for p in sorted((tmp_path / "out").glob("part-*")) for x in p.read_text().splitlines()]
    assert [x for x in lines if not x.startswith("source1")] == ["S1-1\tS2-10,S2-9,S3-1", "S1-2\t"]
    loaded = {r[0]: r[1] for r in records.load_id_list(spark, str(tmp_path / "out"), *sinks.MATCH_HEADER).collect()}
    assert loaded == {"S1-1": ["S2-10", "S2-9", "S3-1"], "S1-2": []}
    assert pairs_of(records.explode_ids(spark.createDataFrame([("a", "x, y"), ("b", None), ("c", "")], "i string, l string"), "i", "l")) == {("a", "x"), ("a", " y")}


HEADER = "Source1_Entity_Id\tmatched_entity_ids"


@pytest.mark.parametrize(
    ("lines", "issues"),
    [
        ([HEADER, "S1-1\tS2-1", "", "S1-2\t"], {}),
        (["source1_entity_id,matched_entity_ids", "S1-1\tS2-1,S2-1"], {"header": 1}),
        ([], {"header": 1}),
        ([HEADER, "S1-1 S2-1", "S1-2\t"], {"row without tab": 1, "missing id": 1}),
        ([HEADER, "S1-1\tS2-1,S2-1", "S1-1\tS1-3", "S1-2\tQ-1,S2-8", "S1-7\t"], {"duplicate row": 1, "duplicate in list": 1, "reference id in list": 1, "id of no source": 1, "extra id": 1, "unknown id": 3}),
    ],
)
def test_validator(spark, lines, issues):
    table_ = spark.createDataFrame([(k, x) for k, x in enumerate(lines)], "line_no long, value string")
    required = spark.createDataFrame([("S1-1",), ("S1-2",)], "s1_id string")
    known = spark.createDataFrame([("S2-1",)], "id string")
    got = {r.check: r.n for r in sinks.validate_lines(table_, sinks.MATCH_HEADER, "m", required, known).collect()}
    assert got == issues


def test_match_warning_and_lines(spark, tmp_path):
    a = spark.createDataFrame([("S1-1", "S2-1"), ("S1-1", "S2-2")], PAIRS)
    assert [r.n for r in sinks.matches_outside_candidates(a, a.limit(1)).collect()] == [1]
    (tmp_path / "f.tsv").write_text("h\nx\n\ny\n")
    assert [tuple(r)[1:] for r in sinks.read_lines(spark, str(tmp_path / "f.tsv")).orderBy("line_no").collect()] == [(0, "h"), (1, "x"), (2, ""), (3, "y")]


def test_stage_runs_once(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.range(3)

    path = f"file://{tmp_path}/stage"
    assert storage.stage(spark, path, make).count() == storage.stage(spark, path, make).count() == 3
    assert made == [1]
    to = sinks.archive(spark, [path], {"f": 1}, f"file://{tmp_path}/archive", "stamp")
    assert spark.read.parquet(f"{to}/stage").count() == 3
    sinks.write_report(spark, {"x": 1}, f"file://{tmp_path}/r/report.json")
    assert storage.read_text(spark, f"file://{tmp_path}/r/report.json") == '{\n  "x": 1\n}'
