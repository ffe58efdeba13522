"""The stages end to end on a small made-up set of files."""

import random
import shutil

from linkspark.operators.config import BlockingConfig, ModelConfig
from linkspark.plans.linkage import Linkage, parse
from linkspark.sources import sinks


def write_files(root):
    rnd = random.Random(1)
    words = ["".join(rnd.choice("bcdfglmnprst") + rnd.choice("aeiou") for _ in range(3)) for _ in range(80)]
    for part in ("train", "test"):
        sources, truth = {1: [], 2: [], 3: []}, []
        for k in range(60):
            name, street = " ".join(rnd.sample(words, 2)), rnd.choice(words)
            sources[1].append((f"S1-{k}", f"{name} Ltd", f"{k} {street} St {560000 + k}", "US"))
            found = []
            for s in (2, 3):
                if rnd.random() < 0.7:
                    sources[s].append((f"S{s}-{k}", f"{name.upper()} limited", f"{k} {street} street", "US"))
                    found.append(f"S{s}-{k}")
            truth.append((f"S1-{k}", ",".join(found)))
        for s, rows in sources.items():
            (root / f"{part}_source{s}.tsv").write_text("entity_id\tbusiness_name\tbusiness_address\tcountry\n" + "".join("\t".join(r) + "\n" for r in rows))
        if part == "train":
            (root / "train_ground_truth.tsv").write_text("source1_entity_id\tmatched_entity_ids\n" + "".join("\t".join(r) + "\n" for r in truth))
    return truth


def test_linkage(spark, tmp_path):
    truth = {a: b for a, b in write_files(tmp_path)}
    run = Linkage(spark, f"file://{tmp_path}", f"file://{tmp_path}/work", f"file://{tmp_path}/out", BlockingConfig(), ModelConfig(folds=2, iterations=3, depth=3, min_instances=2))
    assert run.run("write").collect() == []
    report = {(r.metric, r.grp): r.value for r in run.report().collect()}
    assert report[("macro_f", "all")] > 0.8
    lines = [x for p in sorted((tmp_path / "out" / "matching_results").glob("part-*")) for x in p.read_text().splitlines() if not x.startswith("source1")]
    got = dict(x.split("\t") for x in lines)
    assert set(got) == set(truth) and sum(got[k] == truth[k] for k in truth) > 45
    before = (tmp_path / "work" / "test_features" / "_SUCCESS").stat().st_mtime
    run.features("test")
    assert (tmp_path / "work" / "test_features" / "_SUCCESS").stat().st_mtime == before


def test_stages_by_settings_and_mirror(spark, tmp_path):
    write_files(tmp_path)
    small = ModelConfig(folds=2, iterations=2, depth=2, min_instances=2)

    def job(**more):
        return Linkage(spark, f"file://{tmp_path}", f"file://{tmp_path}/work", f"file://{tmp_path}/out", model=small, mirror=f"file://{tmp_path}/mirror", val_target=20, skip_train=True, **more)

    few = BlockingConfig(per_block_cap=1, candidates_cap=1)
    run = job(blocking=few)
    assert run.run("val_slice").filter("is_eval").count() > 0
    assert {r.scope for r in run.run("val_blocking").collect()} == {"all", "country", "source"}
    assert run.run("report").count() > 0 and run.run("examples").count() > 0
    first = run.run("predict").count()
    assert not (tmp_path / "work" / "train_oof").exists() and run.candidates("test").count() <= 60
    shutil.rmtree(tmp_path / "work")
    again = job(blocking=few)
    assert again.run("predict").count() == first
    assert (tmp_path / "work" / "predictions").exists() and not (tmp_path / "work" / "test_features").exists()
    assert len(again.models()) == 2
    assert job(blocking=BlockingConfig(per_block_cap=2, candidates_cap=5)).candidates("test").count() > 60


def test_written_files_are_what_is_validated(spark, tmp_path):
    write_files(tmp_path)
    run = Linkage(spark, f"file://{tmp_path}", f"file://{tmp_path}/work", f"file://{tmp_path}/out", BlockingConfig(), ModelConfig(folds=2, iterations=2, depth=2, min_instances=2))
    assert run.run("write").collect() == []
    path = f"file://{tmp_path}/out/matching_results"

    def issues():
        lines = sinks.read_lines(spark, path)
        return {r.check: r.n for r in sinks.validate_lines(lines, sinks.MATCH_HEADER, "m", run.required()).collect()}

    assert issues() == {}
    part = next(p for p in sorted((tmp_path / "out" / "matching_results").glob("part-*")) if len(p.read_text().splitlines()) > 2)
    good = part.read_text()
    for crc in part.parent.glob(".*.crc"):
        crc.unlink()
    row = good.splitlines()[1]
    for text, found in ((good + row + "\n", {"duplicate row": 1}), (good + "no tab\n", {"row without tab": 1}), (good.replace("\t", ",", 1), {"header": 1}), (good.replace(row + "\n", ""), {"missing id": 1})):
        part.write_text(text)
        assert issues() == found


def test_command_line():
    args = parse(["--data", "a", "--work", "b", "--out", "c", "--no-grams", "--val-target", "7", "--skip-train", "--conf", "spark.x=1"])
    assert (args.no_grams, args.val_target, args.skip_train, args.conf, args.per_block_cap, args.stage) == (True, 7, True, ["spark.x=1"], 20, "all")
