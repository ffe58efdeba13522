"""The whole linkage as stages over TSV files: each stage is a written table, and a finished one isn't made again.

    python -m linkspark.plans.linkage --data DIR --work DIR --out DIR [--mirror DIR] [--stage all]

A stage's table is kept with the settings that made it and is made anew under others. With a mirror, finished stages are
copied there and brought back when the work folder is gone.
"""

from __future__ import annotations

import argparse
import datetime
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkspark.operators import blocking, decide, evaluate, features, learning, model, slices
from linkspark.operators.config import BlockingConfig, DecideConfig, ModelConfig
from linkspark.operators.features import FEATURES
from linkspark.sources import records, sinks, storage
@dataclass
class Linkage:
    """Train and test records are learned from together; models see train pairs only, or those of the validation slice."""

    spark: SparkSession
    data: str
    work: str
    out: str
    blocking: BlockingConfig = field(default_factory=lambda: BlockingConfig(with_grams=True))
    model: ModelConfig = field(default_factory=ModelConfig)
    decide: DecideConfig = field(default_factory=DecideConfig)
    mirror: str | None = None
    val_target: int = 45_000
    skip_train: bool = False

    def _settings(self, name: str) -> str:
        """What the stage's table hangs on besides the data."""
        used: list = [self.blocking] if name not in ("suffixes", "token_map") else [self.blocking.suffix_min_fraction]
        if name.startswith("val"):
            used.append(self.val_target)
        if name in ("predictions", "train_oof", "val_oof"):
            used += [self.model, self.decide, self.skip_train, self.val_target if self.skip_train else 0]
        return repr(used)

    def _stage(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        return storage.stage(self.spark, f"{self.work}/{name}", make, f"{self.mirror}/{name}" if self.mirror else None, self._settings(name))

    def _slice(self) -> DataFrame:
        """Records of the validation slice, with is_eval."""
        return self._stage("val_slice", lambda: slices.validation_slice(self._files("train"), self.truth(), self.val_target, cfg=self.blocking))

    def raw(self, part: str) -> DataFrame:
        """The records of train, test, or the validation slice (val)."""
        return self._slice().drop("is_eval") if part == "val" else self._files(part)

    def _files(self, part: str) -> DataFrame:
        files = [records.scan_tsv(self.spark, f"{self.data}/{part}_source{k}.tsv") for k in (1, 2, 3)]
        return files[0].unionByName(files[1]).unionByName(files[2])

    def truth(self) -> DataFrame:
        lists = records.scan_tsv(self.spark, f"{self.data}/train_ground_truth.tsv", records.TRUTH_SCHEMA)
        return records.explode_ids(lists, "source1_entity_id", "matched_entity_ids")

    def suffixes(self) -> DataFrame:
        return self._stage("suffixes", lambda: learning.suffix_tokens(self.raw("train").unionByName(self.raw("test")), self.blocking.suffix_min_fraction))

    def token_map(self) -> DataFrame:
        """Romanised tokens and what they are in the Latin names of true pairs."""

        def make() -> DataFrame:
            named = learning.attach_names(self.truth(), self.raw("train"))
            native = F.when(learning.text.has_devanagari(F.col("name_a")), F.struct(F.col("name_a").alias("n"), F.col("name_b").alias("o"))).when(learning.text.has_devanagari(F.col("name_b")), F.struct(F.col("name_b").alias("n"), F.col("name_a").alias("o")))
            mixed = named.filter(learning.text.has_devanagari(F.col("name_a")) != learning.text.has_devanagari(F.col("name_b"))).select(native.alias("p"))
            full = learning.text.normalize_full
            pairs = mixed.select(full(learning.translit.latin(F.col("p.n"))).alias("translit"), full(F.col("p.o")).alias("latin"))
            return learning.dominant_map(learning.align_votes(pairs)).select("translit_token", "latin_token")

        return self._stage("token_map", make)

    def normalized(self, part: str) -> DataFrame:
        return self._stage(f"{part}_normalized", lambda: learning.normalized(self.raw(part), self.suffixes(), self.token_map()))

    def candidates(self, part: str) -> DataFrame:
        return self._stage(f"{part}_candidates", lambda: blocking.cap_candidates(blocking.union_and_score(blocking.all_blocks(self.normalized(part), self.suffixes(), self.blocking)), self.blocking.candidates_cap))

    def features(self, part: str) -> DataFrame:
        return self._stage(f"{part}_features", lambda: features.context_features(features.pair_features(self.candidates(part), self.normalized(part))))

    def learned_from(self) -> str:
        return "val" if self.skip_train else "train"

    def models(self) -> list:
        """Fold models of the train pairs, or of the slice's where training on all is skipped."""
        part = self.learned_from()
        path = f"{self.work}/{part}_models"

        def make() -> DataFrame:
            data = features.label_pairs(self.features(part), self.truth()).withColumn("label", F.col("label").cast("double"))
            scored, models = model.train_oof(data, FEATURES, self.model)
            model.save(models, path)
            if self.mirror:
                storage.copy(self.spark, path, f"{self.mirror}/{part}_models")
            return scored

        self._stage(f"{part}_oof", make)
        if self.mirror and not storage.exists(self.spark, f"{path}/fold0/metadata"):
            storage.copy(self.spark, f"{self.mirror}/{part}_models", path)
        return model.load(path, self.model.folds)

    def report(self) -> DataFrame:
        """Metrics of the out-of-fold decision on the records that are scored: of the slice those to be evaluated."""
        self.models()
        part = self.learned_from()
        scored = self.spark.read.parquet(f"{self.work}/{part}_oof").select("s1_id", "cand_id", "proba")
        rows = self._slice().filter("is_eval") if part == "val" else self.raw(part).filter(F.col("entity_id").startswith("S1-"))
        s1 = rows.select(F.col("entity_id").alias("s1_id"), F.col("country").alias("grp"))
        kept = decide.decide(scored, s1, self.truth(), self.decide)
        return evaluate.score_report(kept, self.truth().join(s1, "s1_id", "left_semi"), s1, s1)

    def blocking_report(self, part: str) -> DataFrame:
        """Recall of the candidates by country and source, over the truth of the records at hand."""
        s1 = self.raw(part).filter(F.col("entity_id").startswith("S1-")).select(F.col("entity_id").alias("s1_id"), "country")
        return evaluate.blocking_recall(self.truth().join(s1, "s1_id"), self.candidates(part))

    def examples(self) -> DataFrame:
        return learning.normalization_examples(self.raw("train").unionByName(self.raw("test")), self.suffixes())

    def predictions(self) -> DataFrame:
        def make() -> DataFrame:
            scored = model.predict(self.models(), self.features("test"), FEATURES)
            return decide.decide(scored, self.required(), None, self.decide)

        return self._stage("predictions", make)

    def required(self) -> DataFrame:
        return self.raw("test").filter(F.col("entity_id").startswith("S1-")).select(F.col("entity_id").alias("s1_id"))

    def write(self) -> DataFrame:
        """Both output files and their archive; returns what the validator finds."""
        kept, pairs = self.predictions().filter("cand_id is not null"), self.candidates("test")
        outputs = {"matching_results": (kept, sinks.MATCH_HEADER), "candidate_pairs": (pairs, sinks.CANDIDATE_HEADER)}
        issues = sinks.matches_outside_candidates(kept.select("s1_id", "cand_id"), pairs.select("s1_id", "cand_id")).select(F.lit("matching_results").alias("file"), "severity", "check", "n")
        for name, (rows, header) in outputs.items():
            sinks.write_id_lists(rows, self.required(), header, f"{self.out}/{name}")
            issues = issues.unionByName(sinks.validate_lines(sinks.read_lines(self.spark, f"{self.out}/{name}"), header, name, self.required()))
        found = storage.written(issues, "issues")
        stamp = datetime.datetime.now().strftime("%Y%m%d-%H%M%S")
        sinks.archive(self.spark, [f"{self.out}/{name}" for name in outputs], {"issues": [r.asDict() for r in found.collect()]}, f"{self.out}/archive", stamp)
        return found

    def run(self, stage: str = "all") -> DataFrame | list:
        """One stage with what it needs, or all up to the written files."""
        stages = {
            "normalize": lambda: self.normalized("test"), "examples": self.examples,
            "val_slice": self._slice, "val_blocking": lambda: self.blocking_report("val"), "val_features": lambda: self.features("val"),
            "train_candidates": lambda: self.candidates("train"), "train_features": lambda: self.features("train"), "train": self.models, "report": self.report,
            "test_candidates": lambda: self.candidates("test"), "test_features": lambda: self.features("test"), "predict": self.predictions, "write": self.write, "all": self.write,
        }
        return stages[stage]()


def parse(args: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    for name in ("--data", "--work", "--out"):
        parser.add_argument(name, required=True)
    parser.add_argument("--mirror", help="a lasting folder for copies of finished stages")
    parser.add_argument("--stage", default="all")
    limits, settings = BlockingConfig(), ModelConfig()
    parser.add_argument("--no-grams", action="store_true", help="leave the character-gram block out")
    parser.add_argument("--per-block-cap", type=int, default=limits.per_block_cap)
    parser.add_argument("--candidates-cap", type=int, default=limits.candidates_cap)
    parser.add_argument("--max-name-token-df", type=int, default=limits.max_name_token_df)
    parser.add_argument("--max-geo-token-df", type=int, default=limits.max_geo_token_df)
    parser.add_argument("--window", type=int, default=limits.window)
    parser.add_argument("--iterations", type=int, default=settings.iterations)
    parser.add_argument("--max-bins", type=int, default=settings.max_bins)
    parser.add_argument("--val-target", type=int, default=45_000, help="records to evaluate in the validation slice")
    parser.add_argument("--skip-train", action="store_true", help="predict with models of the validation slice")
    parser.add_argument("--conf", action="append", default=[], metavar="KEY=VALUE", help="a Spark setting, such as memory, cores or local folders")
    return parser.parse_args(args)


def main() -> None:
    args = parse()
    builder = SparkSession.builder.appName("linkage")
    for pair in args.conf:
        builder = builder.config(*pair.split("=", 1))
    limits = BlockingConfig(per_block_cap=args.per_block_cap, candidates_cap=args.candidates_cap, max_name_token_df=args.max_name_token_df, max_geo_token_df=args.max_geo_token_df, window=args.window, with_grams=not args.no_grams)
    settings = ModelConfig(iterations=args.iterations, max_bins=args.max_bins)
    job = Linkage(builder.getOrCreate(), args.data, args.work, args.out, limits, settings, mirror=args.mirror, val_target=args.val_target, skip_train=args.skip_train)
    result = job.run(args.stage)
    if isinstance(result, DataFrame):
        result.show(50, truncate=False)


if __name__ == "__main__":
    main()
