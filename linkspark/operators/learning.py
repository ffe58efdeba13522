"""What is learned from the records: stop tokens, token maps and script reports."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkspark.functions import batches, text, translit
from linkspark.sources.storage import written


def name_token_df(records: DataFrame) -> DataFrame:
    """(country, token, df): how often a token occurs in names, repeats within a name counted."""
    return records.select("country", F.explode(text.name_words(F.col("business_name"))).alias("token")).groupBy("country", "token").agg(F.count("*").alias("df"))


def suffix_tokens(records: DataFrame, min_fraction: float = 0.02) -> DataFrame:
    """(country, token, df, n_names, frac): tokens as frequent as ``min_fraction`` of a country's names."""
    totals = records.groupBy("country").agg(F.count("*").alias("n_names"))
    joined = name_token_df(records).join(totals, "country").withColumn("frac", F.col("df").cast("double") / F.col("n_names"))
    return joined.filter(F.col("frac") >= min_fraction)


def suffix_sets(suffixes: DataFrame) -> DataFrame:
    """(country, suffixes array). A token is in at least a fixed share of a country's names, so the sets are small."""
    return suffixes.groupBy("country").agg(F.collect_set("token").alias("suffixes"))


#: A learned map goes to every task as one value up to this many entries; a longer one is joined token by token.
MAX_MAP_ENTRIES = 50_000


def apply_token_map(df: DataFrame, key: str, column: str, token_map: DataFrame) -> DataFrame:
    """``df`` with each token of ``column`` replaced by (translit_token, latin_token), where there is one.

    ``key`` names the rows of ``df``. The number of entries decides between a map value and a join; both give the same.
    """
    if token_map.limit(MAX_MAP_ENTRIES + 1).count() <= MAX_MAP_ENTRIES:
        table = token_map.agg(F.map_from_entries(F.collect_list(F.struct("translit_token", "latin_token"))).alias("_map"))
        return df.join(F.broadcast(table)).withColumn(column, text.map_tokens(F.col(column), F.col("_map"))).drop("_map")
    words = df.select(key, F.posexplode(text.tokens(F.col(column))).alias("_at", "translit_token"))
    mapped = words.join(token_map.select("translit_token", "latin_token"), "translit_token", "left")
    placed = F.array_sort(F.collect_list(F.struct("_at", F.coalesce("latin_token", "translit_token").alias("t"))))
    again = mapped.groupBy(key).agg(F.array_join(F.transform(placed, lambda x: x["t"]), " ").alias("_new"))
    return df.join(again, key, "left").withColumn(column, F.coalesce("_new", F.lit(""))).drop("_new")


def normalized(records: DataFrame, suffixes: DataFrame, token_map: DataFrame | None = None) -> DataFrame:
    """Records with name_full, name_core, postal_code and house_number.

    ``token_map`` (translit_token, latin_token) is applied to every name. Ids name records once.
    """
    name = translit.latin(F.col("business_name")) if token_map is not None else F.col("business_name")
    out = records.withColumn("name_full", text.normalize_full(name))
    if token_map is not None:
        out = apply_token_map(out, "entity_id", "name_full", token_map)
    out = out.join(suffix_sets(suffixes), "country", "left")
    out = out.withColumn("name_core", text.name_core(F.col("name_full"), F.col("suffixes")))
    out = out.withColumn("postal_code", text.postal_code(F.col("business_address"))).withColumn("house_number", text.house_number(F.col("business_address")))
    return out.select("entity_id", "business_name", "business_address", "country", "name_full", "name_core", "postal_code", "house_number")


def normalization_examples(records: DataFrame, suffixes: DataFrame, n: int = 5, seed: int = 42) -> DataFrame:
    """(entity_id, country, raw, normalized_full, name_core, transliterated, normalized_after): ``n`` names of each country
    by hash, and ``n`` of those in another script. The last two columns are null for names in Latin letters."""
    indic = text.detect_script(F.col("business_name")).isNotNull()
    order = Window.partitionBy("country", "_indic").orderBy(F.md5(F.concat("entity_id", F.lit(f":{seed}")).cast("binary")), "entity_id")
    some = records.withColumn("_indic", indic).withColumn("_k", F.row_number().over(order)).filter(F.col("_k") <= n).join(suffix_sets(suffixes), "country", "left")
    some = some.withColumn("full", text.normalize_full(F.col("business_name"))).withColumn("latin", F.when(F.col("_indic"), translit.transliterate(F.col("business_name"))))
    core = text.name_core(F.col("full"), F.col("suffixes"))
    return some.select("entity_id", "country", F.col("business_name").alias("raw"), F.col("full").alias("normalized_full"), core.alias("name_core"), F.col("latin").alias("transliterated"), F.when(F.col("latin").isNotNull(), text.normalize_full(F.col("latin"))).alias("normalized_after"))


def attach_names(pairs: DataFrame, records: DataFrame, column: str = "business_name") -> DataFrame:
    """Pairs (s1_id, cand_id, ...) with name_a and name_b."""
    a = records.select(F.col("entity_id").alias("s1_id"), F.col(column).alias("name_a"))
    b = records.select(F.col("entity_id").alias("cand_id"), F.col(column).alias("name_b"))
    return pairs.join(a, "s1_id").join(b, "cand_id")


def script_mismatch(pairs: DataFrame, records: DataFrame) -> DataFrame:
    """One row (n_pairs, n_a, n_b, n_mismatch): how often exactly one side of a true pair is in Devanagari."""
    named = attach_names(pairs, records).select(text.has_devanagari(F.col("name_a")).alias("a"), text.has_devanagari(F.col("name_b")).alias("b"))
    return named.agg(F.count("*").alias("n_pairs"), F.count(F.when(F.col("a"), 1)).alias("n_a"), F.count(F.when(F.col("b"), 1)).alias("n_b"), F.count(F.when(F.col("a") != F.col("b"), 1)).alias("n_mismatch"))


def token_overlap(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """One row (n_pairs, n_overlap): pairs whose two texts share a token."""
    shared = F.arrays_overlap(text.tokens(F.col(left)), text.tokens(F.col(right)))
    return pairs.agg(F.count("*").alias("n_pairs"), F.count(F.when(shared, 1)).alias("n_overlap"))


def overlap_stages(pairs: DataFrame, token_map: DataFrame) -> DataFrame:
    """(stage, n_pairs, n_overlap) of (native, other) names: as they are, romanised, and with the learned map."""
    full = text.normalize_full
    staged = pairs.select(F.monotonically_increasing_id().alias("_row"), full(F.col("other")).alias("other"), full(F.col("native")).alias("none"), full(translit.latin(F.col("native"))).alias("schwa"))
    staged = apply_token_map(written(staged.withColumn("map", F.col("schwa")), "overlap"), "_row", "map", token_map)
    out = None
    for stage in ("none", "schwa", "map"):
        part = token_overlap(staged, stage, "other").withColumn("stage", F.lit(stage))
        out = part if out is None else out.unionByName(part)
    return out


#: Pairs of tokens that a batch looks at in one step.
_TOKEN_PAIRS = 1 << 20


def _votes(a: pa.ListArray, b: pa.ListArray, min_ratio: float) -> pa.Table:
    """Votes of a batch; a token that its partner's text has too votes for itself, which doesn't count, so it is not compared."""
    n_a, n_b = (pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False).astype(np.int64) for x in (a, b))
    flat = [x.flatten() for x in (a, b)]
    coded = pa.concat_arrays(flat).dictionary_encode()
    words, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    left, right = codes[: len(flat[0])], codes[len(flat[0]) :]
    size = np.fromiter(map(len, words), np.int64, len(words))
    starts, partners = np.repeat(np.cumsum(n_b) - n_b, n_a), np.repeat(n_b, n_a)
    steps, found = np.cumsum(partners) // _TOKEN_PAIRS, []
    for step in np.unique(steps):
        here = slice(*np.searchsorted(steps, [step, step + 1]))
        m, token = partners[here], left[here]
        at = np.repeat(np.arange(len(m)), m)
        x, y = token[at], right[np.arange(len(at)) - np.repeat(np.cumsum(m) - m - starts[here], m)]
        same = np.zeros(len(m), bool)
        same[at[x == y]] = True
        some = ~same[at] & (200.0 * np.minimum(size[x], size[y]) / (size[x] + size[y]) >= min_ratio)
        keys, which = np.unique(x[some] * len(words) + y[some], return_inverse=True)
        score = batches.ratios([(words[k // len(words)], words[k % len(words)]) for k in keys.tolist()])[which]
        at, enough = at[some], score >= min_ratio
        at, score, which = at[enough], score[enough], which[enough]
        best = np.full(len(m), -1.0)
        np.maximum.at(best, at, score)
        top = score == best[at]
        found.append(keys[which[top][np.unique(at[top], return_index=True)[1]]])
    keys, votes = np.unique(np.concatenate([np.zeros(0, np.int64), *found]), return_counts=True)
    named = pa.array(words, pa.string())
    return pa.table({"translit_token": named.take(pa.array(keys // max(1, len(words)))), "latin_token": named.take(pa.array(keys % max(1, len(words)))), "votes": pa.array(votes, pa.int64())})


def align_votes(pairs: DataFrame, min_ratio: float = 65.0) -> DataFrame:
    """(translit_token, latin_token, votes) of (translit, latin) texts: each token's first best partner in its pair.

    Only partners that differ and are at least ``min_ratio`` alike count. Tokens are compared within batches of pairs, and only
    votes are exchanged: a row for each two tokens of a pair would be many times the input.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            yield from _votes(part.column(0), part.column(1), min_ratio).to_batches()

    words = pairs.select(text.tokens(F.col("translit")).alias("a"), text.tokens(F.col("latin")).alias("b"))
    votes = words.mapInArrow(run, "translit_token string, latin_token string, votes long")
    return votes.groupBy("translit_token", "latin_token").agg(F.sum("votes").alias("votes"))


def dominant_map(votes: DataFrame, min_votes: int = 5, min_share: float = 0.5) -> DataFrame:
    """(translit_token, latin_token): the most voted partner, if it has enough votes and share. Ties by partner."""
    total = Window.partitionBy("translit_token")
    ranked = votes.withColumn("total", F.sum("votes").over(total)).withColumn("k", F.row_number().over(total.orderBy(F.col("votes").desc(), F.col("latin_token"))))
    return ranked.filter((F.col("k") == 1) & (F.col("total") >= min_votes) & (F.col("votes") >= min_share * F.col("total"))).select("translit_token", "latin_token", "votes", "total")
