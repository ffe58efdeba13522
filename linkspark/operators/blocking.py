"""Candidate pairs by blocks. A block pairs a reference record (s1_id) with at most a cap of candidates (cand_id).

Country is a key of every join, never a loop. Where ids alone rank, a key's candidates are cut to a cap's least ids before the
join; where sums over shared tokens or grams rank, they are added up in lists, without a row for a pair (``products``). Each
block is cut to its cap before blocks are united.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkspark.functions import text
from linkspark.operators import products
from linkspark.operators.config import BlockingConfig
from linkspark.operators.learning import normalized, suffix_tokens
from linkspark.sources.storage import written

DEFAULT = BlockingConfig()


def split_sources(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Reference records and candidates, by id prefix."""
    return records.filter(F.col("entity_id").startswith("S1-")), records.filter(~F.col("entity_id").startswith("S1-"))


def name_tokens(records: DataFrame, min_len: int = 3) -> DataFrame:
    """(entity_id, country, token) of name_full; repeats stay."""
    return records.select("entity_id", "country", F.explode(F.split("name_full", " ")).alias("token")).filter(F.length("token") >= min_len)


def address_tokens(records: DataFrame, min_len: int = 3) -> DataFrame:
    """(entity_id, country, token) of addresses; short and all-digit tokens go, repeats stay."""
    words = records.select("entity_id", "country", F.explode(text.address_words(F.col("business_address"))).alias("token"))
    return words.filter((F.length("token") >= min_len) & ~F.col("token").rlike("^[0-9]+$"))


def token_df(tokens: DataFrame) -> DataFrame:
    """(country, token, df): occurrences, not records."""
    return tokens.groupBy("country", "token").agg(F.count("*").alias("df"))


def geo_tokens(records: DataFrame, cfg: BlockingConfig = DEFAULT) -> DataFrame:
    """(entity_id, country, geo_token, geo_df): a record's rarest address token among those with the least df."""
    words = address_tokens(records, cfg.min_token_len)
    counts = token_df(words).filter(F.col("df") >= cfg.min_geo_token_df)
    least = words.join(counts, ["country", "token"]).groupBy("entity_id", "country").agg(F.min(F.struct("df", "token")).alias("rarest"))
    return least.select("entity_id", "country", F.col("rarest.token").alias("geo_token"), F.col("rarest.df").alias("geo_df"))


def _top(pairs: DataFrame, order: list[Column], cap: int) -> DataFrame:
    return ranked(pairs, order, cap).select("s1_id", "cand_id")


def ranked(pairs: DataFrame, order: list[Column], cap: int) -> DataFrame:
    """The first ``cap`` pairs of each reference record, with their _rank."""
    return pairs.withColumn("_rank", F.row_number().over(Window.partitionBy("s1_id").orderBy(*order))).filter(F.col("_rank") <= cap)


def _sides(s1: DataFrame, cand: DataFrame, columns: list[str | Column]) -> tuple[DataFrame, DataFrame]:
    return s1.select(F.col("entity_id").alias("s1_id"), *columns), cand.select(F.col("entity_id").alias("cand_id"), *columns)


def _least_of_key(cand: DataFrame, keys: list[str], cap: int) -> DataFrame:
    """The ``cap`` least candidate ids of each key: where ids alone rank, no reference record with that key takes others.

    So a join on a hot key makes as many rows as the cap, not as the key has candidates.
    """
    return cand.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy("cand_id"))).filter(F.col("_rank") <= cap).drop("_rank")


def block_exact_core(s1: DataFrame, cand: DataFrame, cfg: BlockingConfig = DEFAULT) -> DataFrame:
    """Equal core names, least candidate ids first."""
    keys = ["country", "name_core"]
    a, b = _sides(s1.filter("name_core <> ''"), cand.filter("name_core <> ''"), keys)
    return _top(a.join(_least_of_key(b, keys, cfg.per_block_cap), keys), [F.col("cand_id")], cfg.per_block_cap)


def rarity_scores(s1_tokens: DataFrame, cand_tokens: DataFrame, counts: DataFrame) -> DataFrame:
    """(s1_id, cand_id, score): sums of 1 / df over shared tokens, counted as often as they occur; a row for every pair that shares one."""
    a = s1_tokens.select(F.col("entity_id").alias("s1_id"), "country", "token").join(counts, ["country", "token"])
    b = cand_tokens.select(F.col("entity_id").alias("cand_id"), "country", "token")
    return a.join(b, ["country", "token"]).groupBy("s1_id", "cand_id").agg(F.round(F.sum(F.lit(1.0) / F.col("df")), 9).alias("score"))


def rarity_vectors(s1_tokens: DataFrame, cand_tokens: DataFrame, counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vectors of both sides whose products are the scores of ``rarity_scores``."""
    terms = products.numbered(counts.withColumn("w", F.lit(1.0) / F.col("df")).withColumn("one", F.lit(1.0)), "terms")
    x = s1_tokens.withColumnRenamed("entity_id", "s1_id").join(terms, ["country", "token"])
    y = cand_tokens.withColumnRenamed("entity_id", "cand_id").join(terms, ["country", "token"])
    return products.vectors(x, "s1_id", "w"), products.vectors(y, "cand_id", "one")


def _best(scored: DataFrame, cap: int) -> DataFrame:
    return _top(scored, [F.col("score").desc(), F.col("cand_id")], cap)


def rare_token_df(cand_tokens: DataFrame, suffixes: DataFrame, most: int) -> DataFrame:
    return token_df(cand_tokens).filter(F.col("df") <= most).join(suffixes.select("country", "token"), ["country", "token"], "left_anti")


def block_rare_token(s1_tokens: DataFrame, cand_tokens: DataFrame, suffixes: DataFrame, cfg: BlockingConfig = DEFAULT) -> DataFrame:
    """Shared name tokens that are neither stop tokens nor common among candidates, rarer ones counting more."""
    a, b = rarity_vectors(s1_tokens, cand_tokens, rare_token_df(cand_tokens, suffixes, cfg.max_name_token_df))
    return _best(products.top_products(a, b, cfg.per_block_cap), cfg.per_block_cap)


def block_postal(s1: DataFrame, cand: DataFrame, s1_tokens: DataFrame, cand_tokens: DataFrame, cfg: BlockingConfig = DEFAULT) -> DataFrame:
    """Equal postal code and a shared name token; a pair stands once for each shared token, and the cap counts those."""
    return _top(postal_pairs(s1, cand, s1_tokens, cand_tokens, cfg.per_block_cap), [F.col("cand_id")], cfg.per_block_cap)


def postal_pairs(s1: DataFrame, cand: DataFrame, s1_tokens: DataFrame, cand_tokens: DataFrame, cap: int) -> DataFrame:
    a, b = _sides(s1.filter("postal_code is not null"), cand.filter("postal_code is not null"), ["country", "postal_code"])
    x = s1_tokens.select(F.col("entity_id").alias("s1_id"), "country", "token")
    y = cand_tokens.select(F.col("entity_id").alias("cand_id"), "country", "token")
    keys = ["country", "postal_code", "token"]
    return a.join(x, ["s1_id", "country"]).join(_least_of_key(b.join(y, ["cand_id", "country"]), keys, cap), keys)


def sorted_positions(s1: DataFrame, cand: DataFrame) -> DataFrame:
    """(entity_id, country, typ, pos): all records in order of country, core name, id, numbered over all partitions.

    Range partitions number their own rows, and the counts of earlier partitions (a row each) are added, so that no
    country is sorted by one task.
    """
    both = s1.select("entity_id", "country", "name_core", F.lit("s1").alias("typ")).unionByName(cand.select("entity_id", "country", "name_core", F.lit("cand").alias("typ")))
    order = ["country", "name_core", "entity_id"]
    dealt = written(both.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "sorted")
    local = dealt.withColumn("k", F.row_number().over(Window.partitionBy("part").orderBy(*order)))
    offsets = dealt.groupBy("part").agg(F.count("*").alias("n")).withColumn("offset", F.sum("n").over(Window.orderBy("part")) - F.col("n"))
    return local.join(F.broadcast(offsets), "part").select("entity_id", "country", "typ", (F.col("offset") + F.col("k")).alias("pos"))


def neighbors(s1: DataFrame, cand: DataFrame, window: int) -> DataFrame:
    """(s1_id, cand_id, dist) of candidates within ``window`` places in the order of core names; other records take up places."""
    placed = written(sorted_positions(s1, cand), "positions")
    offsets = F.array(*[F.lit(k) for k in range(-window, window + 1) if k])
    a = placed.filter("typ = 's1'").select(F.col("entity_id").alias("s1_id"), "country", "pos", F.explode(offsets).alias("off"))
    b = placed.filter("typ = 'cand'").select(F.col("entity_id").alias("cand_id"), "country", F.col("pos").alias("at"))
    return a.withColumn("at", F.col("pos") + F.col("off")).join(b, ["country", "at"]).select("s1_id", "cand_id", F.abs("off").alias("dist"))


def block_sorted_neighborhood(s1: DataFrame, cand: DataFrame, cfg: BlockingConfig = DEFAULT) -> DataFrame:
    """Candidates within ``window`` places in the order of core names, nearest first."""
    return _top(neighbors(s1, cand, cfg.window), [F.col("dist"), F.col("cand_id")], cfg.per_block_cap)


def block_geo(s1_geo: DataFrame, cand_geo: DataFrame, cfg: BlockingConfig = DEFAULT) -> DataFrame:
    """Equal rarest address token, if it isn't common among candidates."""
    keys = ["country", "geo_token"]
    a, b = _sides(s1_geo, cand_geo.filter(F.col("geo_df") <= cfg.max_geo_token_df), keys)
    return _top(a.join(_least_of_key(b, keys, cfg.per_block_cap), keys), [F.col("cand_id")], cfg.per_block_cap)


def address_token_df(cand_tokens: DataFrame, cfg: BlockingConfig) -> DataFrame:
    return token_df(cand_tokens).filter(F.col("df").between(cfg.min_address_token_df, cfg.max_address_token_df))


def block_address(s1: DataFrame, cand: DataFrame, s1_tokens: DataFrame, cand_tokens: DataFrame, cfg: BlockingConfig = DEFAULT) -> DataFrame:
    """Shared rare address tokens, with a bonus for equal house numbers."""
    a, b = rarity_vectors(s1_tokens, cand_tokens, address_token_df(cand_tokens, cfg))
    x, y = _sides(s1, cand, [F.col("house_number").alias("mark")])
    scored = products.top_products(a.join(x, "s1_id"), b.join(y, "cand_id"), cfg.per_block_cap, bonus=cfg.house_number_bonus)
    return _best(scored, cfg.per_block_cap)


def gram_weights(records: DataFrame, cfg: BlockingConfig = DEFAULT, column: str = "name_core") -> DataFrame:
    """(entity_id, country, gram, weight): TF-IDF of character grams, scaled to unit length, fitted per country.

    Grams in more than a share of a country's records go before the weights are scaled.
    """
    n = cfg.gram
    clean = F.regexp_replace(F.lower(column), r"\s\s+", " ")
    cut = F.when(F.length("_text") >= n, F.transform(F.sequence(F.lit(1), F.length("_text") - n + 1), lambda k: F.substring(F.col("_text"), k, F.lit(n))))
    grams = records.select("entity_id", "country", clean.alias("_text")).select("entity_id", "country", F.explode(cut).alias("gram"))
    tf = grams.groupBy("entity_id", "country", "gram").agg(F.count("*").alias("tf"))
    docs = records.groupBy("country").agg(F.count("*").alias("n_docs"))
    df = tf.groupBy("country", "gram").agg(F.count("*").alias("df")).join(docs, "country").filter(F.col("df") <= cfg.gram_max_df * F.col("n_docs"))
    idf = df.select("country", "gram", (F.log((1.0 + F.col("n_docs")) / (1.0 + F.col("df"))) + 1.0).alias("idf"))
    raw = tf.join(idf, ["country", "gram"]).withColumn("raw", F.col("tf") * F.col("idf"))
    norm = raw.groupBy("entity_id").agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm"))
    return raw.join(norm, "entity_id").select("entity_id", "country", "gram", (F.col("raw") / F.col("norm")).alias("weight"))


def block_tfidf(s1: DataFrame, cand: DataFrame, cfg: BlockingConfig = DEFAULT, column: str = "name_core") -> DataFrame:
    """Cosine of character-gram weights; the best of each reference record."""
    return _best(gram_products(s1, cand, cfg, column), cfg.per_block_cap)


def gram_products(s1: DataFrame, cand: DataFrame, cfg: BlockingConfig = DEFAULT, column: str = "name_core") -> DataFrame:
    both = s1.select("entity_id", "country", column).unionByName(cand.select("entity_id", "country", column))
    weights = written(gram_weights(both, cfg, column), "gram-weights")
    terms = products.numbered(weights.select("country", "gram").distinct(), "grams")

    def side(records: DataFrame, name: str) -> DataFrame:
        rows = weights.join(records.select("entity_id"), "entity_id", "left_semi").join(terms, ["country", "gram"])
        return products.vectors(rows.withColumnRenamed("entity_id", name), name, "weight")

    return products.top_products(side(s1, "s1_id"), side(cand, "cand_id"), cfg.per_block_cap, cfg.gram_min_similarity)


def union_and_score(blocks: dict[str, DataFrame]) -> DataFrame:
    """(s1_id, cand_id, blocks, n_blocks): the blocks that found a pair, comma-joined in order."""
    tagged = reduce(DataFrame.unionByName, [pairs.select("s1_id", "cand_id", F.lit(name).alias("block")) for name, pairs in blocks.items()])
    grouped = tagged.groupBy("s1_id", "cand_id").agg(F.array_sort(F.collect_set("block")).alias("found"))
    return grouped.select("s1_id", "cand_id", F.array_join("found", ",").alias("blocks"), F.size("found").cast("long").alias("n_blocks"))


def cap_candidates(scored: DataFrame, cap: int = DEFAULT.candidates_cap) -> DataFrame:
    """The candidates found by most blocks, with their rank."""
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("s1_id").orderBy(F.col("n_blocks").desc(), F.col("cand_id"))).cast("long"))
    return ranked.filter(F.col("rank") <= cap)


def all_blocks(records: DataFrame, suffixes: DataFrame, cfg: BlockingConfig = DEFAULT) -> dict[str, DataFrame]:
    """Every block over normalised records, as lazy plans by name."""
    s1, cand = split_sources(records)
    a, b = name_tokens(s1, cfg.min_token_len), name_tokens(cand, cfg.min_token_len)
    x, y = address_tokens(s1, cfg.min_token_len), address_tokens(cand, cfg.min_token_len)
    blocks = {
        "b1_exact_core": block_exact_core(s1, cand, cfg),
        "b2_rare_token": block_rare_token(a, b, suffixes, cfg),
        "b3_postal_minor": block_postal(s1, cand, a, b, cfg),
        "b_sorted_neighborhood": block_sorted_neighborhood(s1, cand, cfg),
        "bgeo_address_token": block_geo(geo_tokens(s1, cfg), geo_tokens(cand, cfg), cfg),
        "b_address_rare_tokens": block_address(s1, cand, x, y, cfg),
    }
    return blocks | ({"b_tfidf_char_ngram": block_tfidf(s1, cand, cfg)} if cfg.with_grams else {})


def candidate_pairs(records: DataFrame, cfg: BlockingConfig = DEFAULT) -> DataFrame:
    """Capped candidate pairs of raw records: learn stop tokens, normalise once, block, unite, cap."""
    suffixes = written(suffix_tokens(records, cfg.suffix_min_fraction), "suffixes")
    return cap_candidates(union_and_score(all_blocks(written(normalized(records, suffixes), "normalized"), suffixes, cfg)), cfg.candidates_cap)
