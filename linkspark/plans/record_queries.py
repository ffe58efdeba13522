"""Queries of the record-linkage operators over the record view of documents, with their SQL.

Each query is registered under a key; the SQL puts together the same named steps as common table expressions.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkspark.functions import batches, text, translit
from linkspark.operators import blocking, decide, evaluate, features, learning, model, replay, slices
from linkspark.operators.config import BlockingConfig, DecideConfig, ModelConfig
from linkspark.sources import records, sinks
from linkspark.sources.storage import new_path, written

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
CFG = BlockingConfig()


# ---- steps in SQL

_ABBREVIATED = "CASE t " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in text.ABBREVIATIONS.items()) + " ELSE t END"
_CLEAN = "coalesce(trim(regexp_replace(replace(strip_accents(lower({0})), '&', ' and '), '[^a-z0-9]+', ' ', 'g')), '')"
_POSTAL = r"coalesce(nullif(regexp_extract({0}, '(\d{{6}})\D*$', 1), ''), nullif(regexp_extract({0}, '(\d{{5}})(?:-\d{{4}})?\D*$', 1), ''))"
_HOUSE = r"nullif(regexp_extract({0}, '(\d+)', 1), '')"
_SPLIT = r"string_split({0}, ' ')"


def _expand(clean: str) -> str:
    return f"coalesce(array_to_string(list_transform(list_filter({_SPLIT.format(clean)}, lambda t: t <> ''), lambda t: {_ABBREVIATED}), ' '), '')"


def _top(rows: str, order: str, cap: int) -> str:
    return f"SELECT s1_id, cand_id FROM ({rows}) QUALIFY row_number() OVER (PARTITION BY s1_id ORDER BY {order}) <= {cap}"


STEPS: dict[str, tuple[tuple[str, ...], str]] = {
    "records": ((), r"""SELECT 'S' || (1 + doc_id % 3) || '-' || lpad(doc_id::VARCHAR, 8, '0') AS entity_id,
      regexp_extract(text, '^\s*(\S+(?:\s+\S+){0,5})', 1) AS business_name, regexp_extract(text, '(\S+(?:\s+\S+){0,7})\s*$', 1) AS business_address, lang AS country
      FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL"""),
    "truth": (("keyed",), """SELECT a.id AS s1_id, b.id AS cand_id, a.country FROM keyed a JOIN keyed b ON a.country = b.country AND a.key = b.key
      WHERE a.id LIKE 'S1-%' AND b.id NOT LIKE 'S1-%'"""),
    "keyed": ((), """SELECT 'S' || (1 + doc_id % 3) || '-' || lpad(doc_id::VARCHAR, 8, '0') AS id, lang AS country, substr(text, 200, 40) AS key FROM documents WHERE length(text) > 240"""),
    "name_words": (("records",), f"""SELECT country, {_ABBREVIATED} AS token FROM (SELECT country, unnest(string_split(regexp_replace(replace(lower(business_name), '&', ' and '), '[^a-z0-9]+', ' ', 'g'), ' ')) AS t FROM records) WHERE t <> ''"""),
    "name_df": (("name_words",), "SELECT country, token, count(*) AS df FROM name_words GROUP BY ALL"),
    "totals": (("records",), "SELECT country, count(*) AS n_names FROM records GROUP BY country"),
    "suffixes": (("name_df", "totals"), "SELECT country, token, df, n_names, df::DOUBLE / n_names AS frac FROM name_df JOIN totals USING (country) WHERE df::DOUBLE / n_names >= 0.02"),
    "suffix_sets": (("suffixes",), "SELECT country, list(token) AS suffixes FROM suffixes GROUP BY country"),
    "full_names": (("records",), f"SELECT *, {_expand(_CLEAN.format('business_name'))} AS name_full FROM records"),
    "norm": (("full_names", "suffix_sets"), f"""SELECT entity_id, business_name, business_address, country, name_full, CASE WHEN core = '' THEN name_full ELSE core END AS name_core,
      {_POSTAL.format('business_address')} AS postal_code, {_HOUSE.format('business_address')} AS house_number FROM (
      SELECT f.*, coalesce(array_to_string(list_filter(string_split(name_full, ' '), lambda t: t <> '' AND NOT coalesce(list_contains(suffixes, t), false)), ' '), '') AS core
      FROM full_names f LEFT JOIN suffix_sets USING (country))"""),
    "s1": (("norm",), "SELECT * FROM norm WHERE entity_id LIKE 'S1-%'"),
    "cand": (("norm",), "SELECT * FROM norm WHERE entity_id NOT LIKE 'S1-%'"),
    "tokens": (("norm",), "SELECT * FROM (SELECT entity_id, country, unnest(string_split(name_full, ' ')) AS token FROM norm) WHERE length(token) >= 3"),
    "address_tokens": (("norm",), "SELECT * FROM (SELECT entity_id, country, unnest(string_split(regexp_replace(lower(business_address), '[^a-z0-9]+', ' ', 'g'), ' ')) AS token FROM norm) WHERE length(token) >= 3 AND NOT regexp_matches(token, '^[0-9]+$')"),
    "cand_df": (("tokens",), "SELECT country, token, count(*) AS df FROM tokens WHERE entity_id NOT LIKE 'S1-%' GROUP BY ALL"),
    "cand_address_df": (("address_tokens",), "SELECT country, token, count(*) AS df FROM address_tokens WHERE entity_id NOT LIKE 'S1-%' GROUP BY ALL"),
    "geo": (("address_tokens",), """SELECT entity_id, country, token AS geo_token, df AS geo_df FROM (
      SELECT a.entity_id, a.country, a.token, d.df FROM address_tokens a JOIN (SELECT left(entity_id, 2) = 'S1' AS ref, country, token, count(*) AS df FROM address_tokens GROUP BY ALL) d
      ON a.country = d.country AND a.token = d.token AND d.ref = (left(a.entity_id, 2) = 'S1') WHERE d.df >= 3)
      QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY df, token) = 1"""),
    "placed": (("norm",), "SELECT entity_id, country, left(entity_id, 2) = 'S1' AS ref, row_number() OVER (PARTITION BY country ORDER BY name_core, entity_id) AS pos FROM norm"),
    "proba": (("capped",), "SELECT s1_id, cand_id, round((n_blocks + ('0x' || substr(md5(s1_id || cand_id), 1, 4))::BIGINT / 65536.0::DOUBLE) / 8.0::DOUBLE, 6) AS proba FROM capped"),
    "single": (("proba",), "SELECT * FROM proba QUALIFY row_number() OVER (PARTITION BY cand_id ORDER BY proba DESC, s1_id) = 1"),
    "subset": (("single",), """SELECT s1_id, cand_id FROM (SELECT *, max(f) OVER w AS best FROM (
      SELECT *, CASE WHEN 0.25 * cum / k + cum / total > 0 THEN round(1.25::DOUBLE * (cum / k) * (cum / total) / (0.25::DOUBLE * (cum / k) + cum / total), 9) ELSE 0 END AS f FROM (
      SELECT *, row_number() OVER o AS k, sum(proba) OVER (o ROWS UNBOUNDED PRECEDING) AS cum, sum(proba) OVER (PARTITION BY s1_id) AS total, round(product(1 - proba) OVER (PARTITION BY s1_id), 9) AS none
      FROM single WINDOW o AS (PARTITION BY s1_id ORDER BY proba DESC, cand_id))) WINDOW w AS (PARTITION BY s1_id))
      QUALIFY best > none AND k <= min(CASE WHEN f = best THEN k END) OVER (PARTITION BY s1_id)"""),
    "ids": (("s1",), "SELECT entity_id AS s1_id, country AS grp FROM s1"),
    "counts": (("subset", "truth", "keyed", "ids"), """SELECT i.s1_id, i.grp, coalesce(tp, 0) AS tp, coalesce(n_pred, 0) AS n_pred, coalesce(n_truth, 0) AS n_truth FROM ids i
      LEFT JOIN (SELECT s1_id, count(*) AS n_pred FROM subset GROUP BY s1_id) USING (s1_id) LEFT JOIN (SELECT s1_id, count(DISTINCT cand_id) AS n_truth FROM truth GROUP BY s1_id) USING (s1_id)
      LEFT JOIN (SELECT s1_id, count(*) AS tp FROM subset JOIN (SELECT DISTINCT s1_id, cand_id FROM truth) USING (s1_id, cand_id) GROUP BY s1_id) USING (s1_id)"""),
    "entity_f": (("counts",), """SELECT *, CASE WHEN n_pred = 0 AND n_truth = 0 THEN 1.0 WHEN n_pred = 0 OR n_truth = 0 OR tp = 0 THEN 0.0
      ELSE 1.25 * (tp::DOUBLE / n_pred) * (tp::DOUBLE / n_truth) / (0.25 * (tp::DOUBLE / n_pred) + tp::DOUBLE / n_truth) END::DOUBLE AS f FROM counts"""),
}

_BLOCK_NAMES = ("b1_exact_core", "b2_rare_token", "b3_postal_minor", "b_sorted_neighborhood", "bgeo_address_token", "b_address_rare_tokens")


def _block_steps(cap: int, name_df: int, window: int, tag: str = "") -> dict[str, tuple[tuple[str, ...], str]]:
    """The blocks under some limits, and their pairs with each block's name."""
    steps = {
        "b1": (("s1", "cand"), _top("SELECT s.entity_id AS s1_id, c.entity_id AS cand_id FROM s1 s JOIN cand c USING (country, name_core) WHERE name_core <> ''", "cand_id", cap)),
        "rare_scores": (("tokens", "cand_df", "suffixes"), f"""SELECT s.entity_id AS s1_id, c.entity_id AS cand_id, round(sum(1.0::DOUBLE / d.df), 9) AS score
          FROM tokens s JOIN cand_df d ON d.country = s.country AND d.token = s.token AND d.df <= {name_df} JOIN tokens c ON c.country = s.country AND c.token = s.token
          WHERE s.entity_id LIKE 'S1-%' AND c.entity_id NOT LIKE 'S1-%' AND NOT EXISTS (SELECT 1 FROM suffixes f WHERE f.country = s.country AND f.token = s.token) GROUP BY ALL"""),
        "b2": ((f"rare_scores{tag}",), _top(f"SELECT * FROM rare_scores{tag}", "score DESC, cand_id", cap)),
        "b3": (("s1", "cand", "tokens"), _top("""SELECT s.entity_id AS s1_id, c.entity_id AS cand_id FROM s1 s JOIN cand c ON s.country = c.country AND s.postal_code = c.postal_code
          JOIN tokens st ON st.entity_id = s.entity_id JOIN tokens ct ON ct.entity_id = c.entity_id AND ct.country = st.country AND ct.token = st.token""", "cand_id", cap)),
        "b4": (("placed",), _top(f"SELECT a.entity_id AS s1_id, b.entity_id AS cand_id, abs(a.pos - b.pos) AS dist FROM placed a JOIN placed b ON a.country = b.country AND b.pos BETWEEN a.pos - {window} AND a.pos + {window} WHERE a.ref AND NOT b.ref", "dist, cand_id", cap)),
        "b5": (("geo",), _top("SELECT s.entity_id AS s1_id, c.entity_id AS cand_id FROM geo s JOIN geo c ON s.country = c.country AND s.geo_token = c.geo_token AND c.geo_df <= 3000 WHERE s.entity_id LIKE 'S1-%' AND c.entity_id NOT LIKE 'S1-%'", "cand_id", cap)),
        "b6": (("norm", "address_tokens", "cand_address_df"), _top("""SELECT s1_id, cand_id, round(score + CASE WHEN s.house_number = c.house_number THEN 2.0 ELSE 0.0 END, 9) AS score FROM (
          SELECT s.entity_id AS s1_id, c.entity_id AS cand_id, round(sum(1.0::DOUBLE / d.df), 9) AS score FROM address_tokens s JOIN cand_address_df d ON d.country = s.country AND d.token = s.token AND d.df BETWEEN 3 AND 500
          JOIN address_tokens c ON c.country = s.country AND c.token = s.token WHERE s.entity_id LIKE 'S1-%' AND c.entity_id NOT LIKE 'S1-%' GROUP BY ALL) p
          JOIN norm s ON s.entity_id = p.s1_id JOIN norm c ON c.entity_id = p.cand_id""", "score DESC, cand_id", cap)),
    }
    out = {f"{name}{tag}": step for name, step in steps.items()}
    blocks = [f"b{k}{tag}" for k in range(1, 7)]
    out[f"tagged{tag}"] = (tuple(blocks), " UNION ALL ".join(f"SELECT s1_id, cand_id, '{name}' AS block FROM {b}" for name, b in zip(_BLOCK_NAMES, blocks, strict=True)))
    return out


STEPS |= _block_steps(20, 2000, 10)
STEPS["scored"] = (("tagged",), "SELECT s1_id, cand_id, string_agg(DISTINCT block, ',' ORDER BY block) AS blocks, count(DISTINCT block) AS n_blocks FROM tagged GROUP BY ALL")
STEPS["capped"] = (("scored",), "SELECT *, row_number() OVER (PARTITION BY s1_id ORDER BY n_blocks DESC, cand_id) AS rank FROM scored QUALIFY rank <= 75")


def sql(body: str, *steps: str) -> str:
    """``body`` after the steps it names and all they need."""
    order: list[str] = []

    def add(name: str) -> None:
        if name not in order:
            for below in STEPS[name][0]:
                add(below)
            order.append(name)

    for name in steps:
        add(name)
    return "WITH " + ",\n".join(f"{n} AS ({STEPS[n][1]})" for n in order) + "\n" + body if order else body


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if oracle is not None:
            SQL[name] = oracle
        return f

    return register


# ---- steps in Spark


def raw(spark: SparkSession, d: str) -> DataFrame:
    return records.surrogate_records(spark, d)


def truth(spark: SparkSession, d: str) -> DataFrame:
    return records.surrogate_truth(spark, d)


def suffixes(spark: SparkSession, d: str) -> DataFrame:
    return learning.suffix_tokens(raw(spark, d))


def norm(spark: SparkSession, d: str) -> DataFrame:
    return learning.normalized(raw(spark, d), suffixes(spark, d))


def sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return blocking.split_sources(written(norm(spark, d), "norm"))


def scored(spark: SparkSession, d: str) -> DataFrame:
    s = written(suffixes(spark, d), "suffixes")
    return blocking.union_and_score(blocking.all_blocks(written(learning.normalized(raw(spark, d), s), "norm"), s, CFG))


def capped(spark: SparkSession, d: str) -> DataFrame:
    return blocking.cap_candidates(scored(spark, d), CFG.candidates_cap)


def _capped_and_norm(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Capped pairs, and the written records that they are of."""
    s = written(suffixes(spark, d), "suffixes")
    n = written(learning.normalized(raw(spark, d), s), "norm")
    return blocking.cap_candidates(blocking.union_and_score(blocking.all_blocks(n, s, CFG)), CFG.candidates_cap), n


def with_proba(spark: SparkSession, d: str) -> DataFrame:
    """Capped pairs with a made-up probability that any engine reproduces."""
    noise = F.conv(F.substring(F.md5(F.concat("s1_id", "cand_id").cast("binary")), 1, 4), 16, 10).cast("double") / 65536.0
    return capped(spark, d).select("s1_id", "cand_id", F.round((F.col("n_blocks") + noise) / 8.0, 6).alias("proba"))


def ids(spark: SparkSession, d: str) -> DataFrame:
    return raw(spark, d).filter(F.col("entity_id").startswith("S1-")).select(F.col("entity_id").alias("s1_id"), F.col("country").alias("grp"))


def subset(spark: SparkSession, d: str) -> DataFrame:
    return decide.expected_f_subset(decide.one_to_one(with_proba(spark, d)))


def _cast_floats(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(F.col(f.name).cast("double"), 6).alias(f.name) if f.dataType.typeName() in ("float", "double") else F.col(f.name) for f in df.schema.fields])


# ---- normalisation

_CUST = "c_name || ', ' || c_custkey || ' ' || c_mktsegment || ' st, ' || (100000 + c_custkey * 7)"


def _addresses(spark: SparkSession, d: str) -> DataFrame:
    """Customers as addresses with numbers in them."""
    c = spark.read.parquet(f"{d}/customer.parquet")
    address = F.concat("c_name", F.lit(", "), F.col("c_custkey").cast("string"), F.lit(" "), "c_mktsegment", F.lit(" st, "), (100000 + F.col("c_custkey") * 7).cast("string"))
    return c.select("c_custkey", address.alias("address"))


def _named(key: str, build, expression: str | None = None) -> None:
    """A column function over all names, and its SQL if it has one."""
    QUERIES[key] = lambda spark, d: raw(spark, d).select("entity_id", build(F.col("business_name")).alias("value"))
    if expression is not None:
        SQL[key] = sql(f"SELECT entity_id, {expression} AS value FROM records", "records")


#: A name in each of the nine scripts, Latin ones, an empty one and none, and pairs of them.
_SCRIPTED = (
    ("S1-a", "Ram Marketing Private Limited"), ("S2-a", "राम मार्केटिंग प्राइवेट लिमिटेड"), ("S1-b", "Laxmi Traders"), ("S2-b", "লক্ষ্মী ট্রেডার্স"), ("S3-b", "ਲਕਸ਼ਮੀ ਟਰੇਡਰਜ਼"), ("S1-c", "Shakti Udyog"), ("S2-c", "શક્તિ ઉદ્યોગ"),
    ("S3-c", "ଶକ୍ତି ଉଦ୍ୟୋଗ"), ("S1-d", "Murugan Stores"), ("S2-d", "முருகன் ஸ்டோர்ஸ்"), ("S3-d", "మురుగన్ స్టోర్స్"), ("S1-e", "Kaveri Mills"), ("S2-e", "ಕಾವೇರಿ ಮಿಲ್ಸ್"), ("S3-e", "കാവേരി മിൽസ്"),
    ("S3-a", "Ram मार्केटिंग"), ("S1-f", "शक्ति"), ("S2-f", "शक्ति Udyog"), ("S1-g", ""), ("S2-g", None),
)
_SCRIPTED_PAIRS = (("S1-a", "S2-a"), ("S1-a", "S3-a"), ("S1-b", "S2-b"), ("S1-c", "S2-c"), ("S1-f", "S2-f"), ("S1-g", "S2-g"))
STEPS["scripted"] = ((), "SELECT * FROM (VALUES " + ", ".join(f"('{i}', " + ("NULL" if n is None else f"'{n}'") + ")" for i, n in _SCRIPTED) + ") v(entity_id, business_name)")
STEPS["all_names"] = (("records", "scripted"), "SELECT entity_id, business_name FROM records UNION ALL SELECT * FROM scripted")
STEPS["all_pairs"] = (("truth",), "SELECT s1_id, cand_id FROM truth UNION ALL SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in _SCRIPTED_PAIRS) + ") v(s1_id, cand_id)")


def all_names(spark: SparkSession, d: str) -> DataFrame:
    """The names of all records, and some in other scripts, of which documents have none."""
    return raw(spark, d).select("entity_id", "business_name").unionByName(spark.createDataFrame(_SCRIPTED, "entity_id string, business_name string"))


def all_pairs(spark: SparkSession, d: str) -> DataFrame:
    return truth(spark, d).select("s1_id", "cand_id").unionByName(spark.createDataFrame(_SCRIPTED_PAIRS, "s1_id string, cand_id string"))


def _scripted(key: str, build, expression: str | None = None) -> None:
    """A column function over the names in all scripts, and its SQL if it has one."""
    QUERIES[key] = lambda spark, d: all_names(spark, d).select("entity_id", build(F.col("business_name")).alias("value"))
    if expression is not None:
        SQL[key] = sql(f"SELECT entity_id, {expression} AS value FROM all_names", "all_names")


_named("strip_accents", text.strip_accents, "strip_accents(business_name)")
_named("basic_clean", text.basic_clean, _CLEAN.format("business_name"))
_named("expand_abbrev", lambda c: text.expand_abbreviations(text.basic_clean(c)), _expand(_CLEAN.format("business_name")))
_named("normalize_full", text.normalize_full, _expand(_CLEAN.format("business_name")))
_scripted("script_flag", text.has_devanagari, "coalesce(regexp_matches(business_name, '[\\x{0900}-\\x{097F}]'), false)")
_scripted("detect_script", text.detect_script, """CASE WHEN regexp_matches(business_name, '[\\x{0980}-\\x{09FF}]') THEN 'BENGALI' WHEN regexp_matches(business_name, '[\\x{0900}-\\x{097F}]') THEN 'DEVANAGARI'
  WHEN regexp_matches(business_name, '[\\x{0A80}-\\x{0AFF}]') THEN 'GUJARATI' WHEN regexp_matches(business_name, '[\\x{0A00}-\\x{0A7F}]') THEN 'GURMUKHI' WHEN regexp_matches(business_name, '[\\x{0C80}-\\x{0CFF}]') THEN 'KANNADA'
  WHEN regexp_matches(business_name, '[\\x{0D00}-\\x{0D7F}]') THEN 'MALAYALAM' WHEN regexp_matches(business_name, '[\\x{0B00}-\\x{0B7F}]') THEN 'ORIYA' WHEN regexp_matches(business_name, '[\\x{0B80}-\\x{0BFF}]') THEN 'TAMIL'
  WHEN regexp_matches(business_name, '[\\x{0C00}-\\x{0C7F}]') THEN 'TELUGU' END""")
_scripted("has_indic_script", lambda c: text.detect_script(c).isNotNull(), "coalesce(regexp_matches(business_name, '[\\x{0900}-\\x{0D7F}]'), false)")
_named("schwa_delete", text.schwa_delete, "array_to_string(list_transform(string_split(business_name, ' '), lambda t: CASE WHEN length(t) > 2 AND ends_with(t, 'a') AND NOT regexp_matches(substr(t, -2, 1), '[aeiouAEIOU]') THEN left(t, length(t) - 1) ELSE t END), ' ')")
_named("regex_clean", lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "), "regexp_replace(lower(business_name), '[^a-z0-9]+', ' ', 'g')")
_scripted("transliterate", translit.transliterate)


@query("name_core", sql("SELECT entity_id, name_core FROM norm", "norm"))
def _name_core(spark, d):
    return norm(spark, d).select("entity_id", "name_core")


@query("normalized_records", sql("SELECT * FROM norm", "norm"))
def _normalized_records(spark, d):
    return norm(spark, d)


@query("postal_extract", f"SELECT c_custkey, {_POSTAL.format('address')} AS postal FROM (SELECT c_custkey, {_CUST} AS address FROM customer)")
def _postal(spark, d):
    return _addresses(spark, d).select("c_custkey", text.postal_code(F.col("address")).alias("postal"))


@query("house_number", f"SELECT c_custkey, {_HOUSE.format('address')} AS house FROM (SELECT c_custkey, {_CUST} AS address FROM customer)")
def _house(spark, d):
    return _addresses(spark, d).select("c_custkey", text.house_number(F.col("address")).alias("house"))


@query("digit_tokens", f"SELECT c_custkey, array_to_string(list_sort(list_distinct(regexp_extract_all(address, '(\\d+)', 1))), ',') AS digits FROM (SELECT c_custkey, {_CUST} AS address FROM customer)")
def _digits(spark, d):
    return _addresses(spark, d).select("c_custkey", F.array_join(F.array_sort(text.digit_tokens(F.col("address"))), ",").alias("digits"))


@query("digit_jaccard", f"""WITH a AS (SELECT c_custkey, list_distinct(regexp_extract_all({_CUST}, '(\\d+)', 1)) AS x, list_distinct(regexp_extract_all(c_name || ' 7', '(\\d+)', 1)) AS y FROM customer)
  SELECT c_custkey, round(len(list_intersect(x, y))::DOUBLE / len(list_distinct(list_concat(x, y))), 6) AS jaccard FROM a""")
def _digit_jaccard(spark, d):
    c = _addresses(spark, d).join(spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", "c_name"), "c_custkey")
    return c.select("c_custkey", F.round(features.digit_jaccard(F.col("address"), F.concat("c_name", F.lit(" 7"))), 6).alias("jaccard"))


# ---- tokens and what is learned


@query("tokenize_name", sql("SELECT * FROM tokens", "tokens"))
def _tokenize_name(spark, d):
    return blocking.name_tokens(norm(spark, d))


@query("tokenize_address", sql("SELECT * FROM address_tokens", "address_tokens"))
def _tokenize_address(spark, d):
    return blocking.address_tokens(norm(spark, d))


@query("token_df", sql("SELECT country, token, count(*) AS df FROM tokens GROUP BY ALL", "tokens"))
def _token_df(spark, d):
    return blocking.token_df(blocking.name_tokens(norm(spark, d)))


@query("df_range_filter", sql("SELECT * FROM cand_address_df WHERE df BETWEEN 3 AND 500", "cand_address_df"))
def _df_range(spark, d):
    _, cand = blocking.split_sources(norm(spark, d))
    return blocking.token_df(blocking.address_tokens(cand)).filter(F.col("df").between(3, 500))


@query("name_token_df", sql("SELECT * FROM name_df", "name_df"))
def _name_token_df(spark, d):
    return learning.name_token_df(raw(spark, d))


@query("suffix_tokens", sql("SELECT * FROM suffixes", "suffixes"))
def _suffix_tokens(spark, d):
    return suffixes(spark, d)


@query("geo_token", sql("SELECT * FROM geo WHERE entity_id LIKE 'S1-%'", "geo"))
def _geo_token(spark, d):
    return blocking.geo_tokens(blocking.split_sources(norm(spark, d))[0])


@query("qualify_top1", sql("SELECT * FROM geo WHERE entity_id NOT LIKE 'S1-%'", "geo"))
def _qualify(spark, d):
    return blocking.geo_tokens(blocking.split_sources(norm(spark, d))[1])


@query("rarity_score", sql("SELECT s1_id, cand_id, round(score, 6) AS score FROM rare_scores", "rare_scores"))
def _rarity(spark, d):
    s1, cand = sides(spark, d)
    a, b = blocking.name_tokens(s1), blocking.name_tokens(cand)
    counts = blocking.token_df(b).filter("df <= 2000").join(suffixes(spark, d).select("country", "token"), ["country", "token"], "left_anti")
    return blocking.rarity_scores(a, b, counts).select("s1_id", "cand_id", F.round("score", 6).alias("score"))


@query("script_mismatch", sql("""SELECT count(*) AS n_pairs, count(*) FILTER (x) AS n_a, count(*) FILTER (y) AS n_b, count(*) FILTER (x <> y) AS n_mismatch FROM (
  SELECT coalesce(regexp_matches(a.business_name, '[\\x{0900}-\\x{097F}]'), false) AS x, coalesce(regexp_matches(b.business_name, '[\\x{0900}-\\x{097F}]'), false) AS y
  FROM all_pairs JOIN all_names a ON a.entity_id = s1_id JOIN all_names b ON b.entity_id = cand_id)""", "all_pairs", "all_names"))
def _script_mismatch(spark, d):
    return learning.script_mismatch(all_pairs(spark, d), all_names(spark, d))


@query("overlap_stages", "SELECT * FROM (VALUES ('none', 4::BIGINT, 1::BIGINT), ('schwa', 4, 2), ('map', 4, 3)) v(stage, n_pairs, n_overlap)")
def _overlap_stages(spark, d):
    """What romanisation, and a token map on top of it, add to the shared tokens of four pairs of names, counted by hand."""
    pairs = [("राम", "rama"), ("लिमिटेड", "limited"), ("प्राइवेट", "private"), ("राम ltd", "ltd")]
    token_map = spark.createDataFrame([("praiveta", "private"), ("praivet", "private"), ("prAiveT", "private")], "translit_token string, latin_token string")
    return learning.overlap_stages(spark.createDataFrame(pairs, "native string, other string"), token_map)


@query("token_overlap", sql("""SELECT count(*) AS n_pairs, count(*) FILTER (len(list_intersect(list_filter(string_split(a.name_full, ' '), lambda t: t <> ''), list_filter(string_split(b.name_full, ' '), lambda t: t <> ''))) > 0) AS n_overlap
  FROM truth JOIN norm a ON a.entity_id = s1_id JOIN norm b ON b.entity_id = cand_id""", "truth", "norm"))
def _token_overlap(spark, d):
    return learning.token_overlap(learning.attach_names(truth(spark, d), norm(spark, d), "name_full"), "name_a", "name_b")


@query("align_votes")
def _align(spark, d):
    pairs, n = _capped_and_norm(spark, d)
    named = learning.attach_names(pairs.select("s1_id", "cand_id"), n, "name_full")
    return learning.align_votes(named.select(F.col("name_a").alias("translit"), F.col("name_b").alias("latin")))


@query("dominant_map", """WITH v AS (SELECT o_orderpriority AS translit_token, o_orderstatus AS latin_token, count(*) AS votes FROM orders GROUP BY ALL)
  SELECT translit_token, latin_token, votes, total FROM (SELECT *, sum(votes) OVER (PARTITION BY translit_token)::BIGINT AS total, row_number() OVER (PARTITION BY translit_token ORDER BY votes DESC, latin_token) AS k FROM v) WHERE k = 1 AND total >= 5 AND votes >= 0.3 * total""")
def _dominant(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    votes = o.groupBy(F.col("o_orderpriority").alias("translit_token"), F.col("o_orderstatus").alias("latin_token")).agg(F.count("*").alias("votes"))
    return learning.dominant_map(votes, 5, 0.3)


# ---- blocks


def _block(key: str, step: str, build) -> None:
    QUERIES[key] = build
    SQL[key] = sql(f"SELECT s1_id, cand_id FROM {step}", step)


_block("block_exact_core", "b1", lambda s, d: blocking.block_exact_core(*sides(s, d)))
_block("block_rare_token", "b2", lambda s, d: (lambda a, b: blocking.block_rare_token(blocking.name_tokens(a), blocking.name_tokens(b), suffixes(s, d)))(*sides(s, d)))
_block("block_sorted_neighborhood", "b4", lambda s, d: blocking.block_sorted_neighborhood(*sides(s, d)))
_block("block_geo", "b5", lambda s, d: (lambda a, b: blocking.block_geo(blocking.geo_tokens(a), blocking.geo_tokens(b)))(*sides(s, d)))
_block("block_address", "b6", lambda s, d: (lambda a, b: blocking.block_address(a, b, blocking.address_tokens(a), blocking.address_tokens(b)))(*sides(s, d)))

_POSTAL_STEPS = {
    "people": f"SELECT CASE c_custkey % 3 WHEN 0 THEN 'S1-' ELSE 'S2-' END || c_custkey AS entity_id, c_mktsegment AS country, lower(c_mktsegment) || ' ' || (c_custkey % 5) || 'xyz' AS name_full, {_POSTAL.format("'x ' || (10000 + c_custkey % 50)")} AS postal_code FROM customer",
    "words": "SELECT * FROM (SELECT entity_id, country, unnest(string_split(name_full, ' ')) AS token FROM people) WHERE length(token) >= 3",
}


@query("block_postal", "WITH " + ", ".join(f"{k} AS ({v})" for k, v in _POSTAL_STEPS.items()) + " " + _top("""SELECT s.entity_id AS s1_id, c.entity_id AS cand_id FROM people s JOIN people c ON s.country = c.country AND s.postal_code = c.postal_code
  JOIN words st ON st.entity_id = s.entity_id JOIN words ct ON ct.entity_id = c.entity_id AND ct.country = st.country AND ct.token = st.token WHERE s.entity_id LIKE 'S1-%' AND c.entity_id NOT LIKE 'S1-%'""", "cand_id", 20))
def _block_postal(spark, d):
    c = spark.read.parquet(f"{d}/customer.parquet")
    key = F.col("c_custkey")
    people = c.select(F.concat(F.when(key % 3 == 0, "S1-").otherwise("S2-"), key.cast("string")).alias("entity_id"), F.col("c_mktsegment").alias("country"), F.concat(F.lower("c_mktsegment"), F.lit(" "), (key % 5).cast("string"), F.lit("xyz")).alias("name_full"), text.postal_code(F.concat(F.lit("x "), (10000 + key % 50).cast("string"))).alias("postal_code"))
    s1, cand = blocking.split_sources(people)
    return blocking.block_postal(s1, cand, blocking.name_tokens(s1), blocking.name_tokens(cand))


_TFIDF = (
    "clean AS (SELECT entity_id, country, regexp_replace(lower(name_core), '\\s\\s+', ' ', 'g') AS t FROM norm), "
    "grams AS (SELECT entity_id, country, unnest(list_transform(range(1, length(t) - 1), lambda k: substr(t, k, 3))) AS gram FROM clean WHERE length(t) >= 3), "
    "tf AS (SELECT entity_id, country, gram, count(*) AS tf FROM grams GROUP BY ALL), n AS (SELECT country, count(*) AS n_docs FROM norm GROUP BY country), "
    "idf AS (SELECT country, gram, ln((1.0::DOUBLE + any_value(n_docs)) / (1.0::DOUBLE + count(*))) + 1.0 AS idf FROM tf JOIN n USING (country) GROUP BY country, gram HAVING count(*) <= 0.3::DOUBLE * any_value(n_docs)), "
    "w AS (SELECT entity_id, country, gram, tf * idf AS r FROM tf JOIN idf USING (country, gram)), l AS (SELECT entity_id, sqrt(sum(r * r)) AS l FROM w GROUP BY entity_id), "
    "weight AS (SELECT entity_id, country, gram, r / l AS w FROM w JOIN l USING (entity_id)) "
)


@query("block_tfidf", sql("", "norm").rstrip() + ", " + _TFIDF + _top("SELECT a.entity_id AS s1_id, b.entity_id AS cand_id, round(sum(a.w * b.w), 9) AS score FROM weight a JOIN weight b USING (country, gram) WHERE a.entity_id LIKE 'S1-%' AND b.entity_id NOT LIKE 'S1-%' GROUP BY ALL HAVING score >= 0.3", "score DESC, cand_id", 20))
def _tfidf(spark, d):
    return blocking.block_tfidf(*sides(spark, d))


@query("union_and_score", sql("SELECT * FROM scored", "scored"))
def _union(spark, d):
    return scored(spark, d)


@query("cap_candidates", sql("SELECT *, row_number() OVER (PARTITION BY s1_id ORDER BY n_blocks DESC, cand_id) AS rank FROM scored QUALIFY rank <= 10", "scored"))
def _cap(spark, d):
    return blocking.cap_candidates(scored(spark, d), 10)


@query("candidate_pairs", sql("SELECT * FROM capped", "capped"))
def _candidate_pairs(spark, d):
    return blocking.candidate_pairs(raw(spark, d))


@query("string_agg_distinct", sql("SELECT s1_id, string_agg(DISTINCT block, ',' ORDER BY block) AS blocks FROM tagged GROUP BY s1_id", "tagged"))
def _string_agg(spark, d):
    one = scored(spark, d).select("s1_id", F.explode(F.split("blocks", ",")).alias("block"))
    return one.groupBy("s1_id").agg(F.array_join(F.array_sort(F.collect_set("block")), ",").alias("blocks"))


@query("block_flags", sql("SELECT s1_id, cand_id, " + ", ".join(f"list_contains(string_split(blocks, ','), '{b}')::INT::DOUBLE AS block_{b}" for b in features.FLAGGED_BLOCKS) + " FROM capped", "capped"))
def _block_flags(spark, d):
    return _cast_floats(capped(spark, d).select("s1_id", "cand_id", *features.block_flags(F.col("blocks"))))


#: Limits in growing order: cap of a block, df of a name token, places to either side.
RELAXED = {"current": (20, 2000, 10), "cap200": (200, 2000, 10), "cap2000": (2000, 2000, 10), "cap2000_nodf": (2000, 10_000_000, 10), "cap2000_nodf_window50": (2000, 10_000_000, 50)}
for _k, _limits in enumerate(RELAXED.values()):
    STEPS |= _block_steps(*_limits, f"_{_k}")
STEPS["replayed"] = (tuple(f"tagged_{k}" for k in range(len(RELAXED))), " UNION ".join(f"SELECT '{name}' AS config, s1_id, cand_id, block FROM tagged_{k}" for k, name in enumerate(RELAXED)))


@query("config_sweep", sql("""SELECT config, block, count(*) AS n_pairs, count(missed) AS n_found, count(*) FILTER (missed) AS n_recovered FROM (
  SELECT * FROM replayed UNION ALL SELECT DISTINCT config, s1_id, cand_id, 'all' FROM replayed) LEFT JOIN (
  SELECT DISTINCT t.s1_id, t.cand_id, NOT EXISTS (SELECT 1 FROM replayed r WHERE r.config = 'current' AND r.s1_id = t.s1_id AND r.cand_id = t.cand_id) AS missed FROM truth t) USING (s1_id, cand_id) GROUP BY ALL""", "replayed", "truth"))
def _config_sweep(spark, d):
    s = written(suffixes(spark, d), "suffixes")
    configs = {name: BlockingConfig(per_block_cap=cap, max_name_token_df=df, window=window) for name, (cap, df, window) in RELAXED.items()}
    return replay.relaxed_replay(truth(spark, d), written(learning.normalized(raw(spark, d), s), "norm"), s, configs)


# ---- features, labels, model


def _pairs(spark, d):
    return features.attach_records(written(capped(spark, d), "capped"), norm(spark, d))


@query("pair_attach", sql("SELECT s1_id, cand_id, a.name_full AS a_name_full, b.name_full AS b_name_full FROM capped JOIN norm a ON a.entity_id = s1_id JOIN norm b ON b.entity_id = cand_id", "capped", "norm"))
def _pair_attach(spark, d):
    return features.attach_records(capped(spark, d).select("s1_id", "cand_id"), norm(spark, d), ("name_full",))


@query("len_diff", sql("SELECT s1_id, cand_id, abs(length(a.name_full) - length(b.name_full))::BIGINT AS diff FROM capped JOIN norm a ON a.entity_id = s1_id JOIN norm b ON b.entity_id = cand_id", "capped", "norm"))
def _len_diff(spark, d):
    return _pairs(spark, d).select("s1_id", "cand_id", F.abs(F.length("a_name_full") - F.length("b_name_full")).cast("long").alias("diff"))


@query("postal_flags", """WITH p AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 > 0 THEN (o_custkey % 7)::VARCHAR END AS a, CASE WHEN o_orderkey % 5 > 0 THEN (o_orderkey % 7)::VARCHAR END AS b FROM orders)
  SELECT o_orderkey, coalesce(a = b, false)::INT::DOUBLE AS postal_equal, coalesce(a <> b, false)::INT::DOUBLE AS postal_conflict, (a IS NULL OR b IS NULL)::INT::DOUBLE AS postal_missing FROM p""")
def _postal_flags(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    a = F.when(F.col("o_orderkey") % 3 > 0, (F.col("o_custkey") % 7).cast("string"))
    b = F.when(F.col("o_orderkey") % 5 > 0, (F.col("o_orderkey") % 7).cast("string"))
    return _cast_floats(o.select("o_orderkey", *features.postal_flags(a, b)))


def _similarity(key: str, kernel, oracle: str | None = None) -> None:
    QUERIES[key] = lambda spark, d: _pairs(spark, d).repartition("s1_id", "cand_id").select("s1_id", "cand_id", F.round(kernel("a_name_full", "b_name_full"), 6).alias("score"))
    if oracle:
        SQL[key] = sql(f"SELECT s1_id, cand_id, round({oracle}, 6) AS score FROM capped JOIN norm a ON a.entity_id = s1_id JOIN norm b ON b.entity_id = cand_id", "capped", "norm")


_similarity("sim_ratio", batches.ratio_of)
_similarity("sim_token_set", batches.token_set_ratio_of)
_similarity("sim_partial", batches.partial_ratio_of)
_similarity("sim_jaro_winkler", batches.jaro_winkler_of, "100 * jaro_winkler_similarity(a.name_full, b.name_full)")


def _features(spark, d):
    pairs, n = _capped_and_norm(spark, d)
    return features.pair_features(written(pairs, "capped"), n)


@query("pair_features")
def _pair_features(spark, d):
    return _cast_floats(_features(spark, d))


_CONTEXT = """SELECT s1_id, cand_id, proba, row_number() OVER (PARTITION BY s1_id ORDER BY proba DESC, cand_id) AS rank_by_s1, round(max(proba) OVER (PARTITION BY s1_id) - proba, 6) AS gap_to_best_by_s1,
  row_number() OVER (PARTITION BY cand_id ORDER BY proba DESC, s1_id) AS reverse_rank FROM proba"""


def _context(spark, d):
    return features.context_features(with_proba(spark, d), "proba").withColumn("gap_to_best_by_s1", F.round("gap_to_best_by_s1", 6))


for _key, _columns in {"context_features": "*", "gap_to_best": "s1_id, cand_id, gap_to_best_by_s1", "rank_by_s1": "s1_id, cand_id, rank_by_s1", "reverse_rank": "s1_id, cand_id, reverse_rank"}.items():
    QUERIES[_key] = lambda spark, d, columns=_columns: _context(spark, d).select(*columns.split(", "))
    SQL[_key] = sql(f"SELECT {_columns} FROM ({_CONTEXT})", "proba")


@query("label_pairs", sql("SELECT c.s1_id, c.cand_id, (t.s1_id IS NOT NULL)::BIGINT AS label FROM capped c LEFT JOIN (SELECT DISTINCT s1_id, cand_id FROM truth) t USING (s1_id, cand_id)", "capped", "truth"))
def _label(spark, d):
    return features.label_pairs(capped(spark, d).select("s1_id", "cand_id"), truth(spark, d))


@query("group_kfold", sql("SELECT s1_id, ('0x' || substr(md5(s1_id || ':42'), 1, 8))::BIGINT % 5 AS fold FROM ids", "ids"))
def _kfold(spark, d):
    return ids(spark, d).select("s1_id", model.group_fold(F.col("s1_id")).alias("fold"))


#: All settings of the staged linkage, its 300 trees a fold too.
_MODEL = ModelConfig()


def _trained(spark, d):
    built = features.context_features(written(_features(spark, d), "features"))
    data = features.label_pairs(built, truth(spark, d)).withColumn("label", F.col("label").cast("double"))
    return data, *model.train_oof(data, features.FEATURES, _MODEL)


@query("oof_scores")
def _oof(spark, d):
    return _cast_floats(_trained(spark, d)[1])


@query("ensemble_predict")
def _ensemble(spark, d):
    data, _, models = _trained(spark, d)
    return _cast_floats(model.predict(models, data, features.FEATURES))


@query("feature_importance")
def _importance(spark, d):
    _, _, models = _trained(spark, d)
    return spark.createDataFrame(model.importance(models, features.FEATURES), "feature string, importance double")


@query("linked")
def _linked(spark, d):
    """From candidates over features and out-of-fold models to the decision."""
    _, found, _ = _trained(spark, d)
    return decide.decide(written(found.select("s1_id", "cand_id", "proba"), "proba"), ids(spark, d), truth(spark, d))


# ---- decision


@query("one_to_one", sql("SELECT * FROM single", "single"))
def _one_to_one(spark, d):
    return decide.one_to_one(with_proba(spark, d))


@query("global_threshold", sql("SELECT s1_id, cand_id FROM proba WHERE proba >= 0.3", "proba"))
def _threshold(spark, d):
    return decide.global_threshold(with_proba(spark, d), 0.3)


@query("expected_f_subset", sql("SELECT * FROM subset", "subset"))
def _subset(spark, d):
    return subset(spark, d)


_TUNE = """SELECT threshold, round(avg(f), 9) AS f FROM (SELECT t.threshold, CASE WHEN n_pred = 0 AND n_truth = 0 THEN 1.0 WHEN n_pred = 0 OR n_truth = 0 OR tp = 0 THEN 0.0
  ELSE 1.25 * (tp::DOUBLE / n_pred) * (tp::DOUBLE / n_truth) / (0.25 * (tp::DOUBLE / n_pred) + tp::DOUBLE / n_truth) END::DOUBLE AS f FROM (
  SELECT t.threshold, i.s1_id, count(p.cand_id) AS n_pred, count(h.cand_id) AS tp, any_value(coalesce(z.n, 0)) AS n_truth FROM ids i CROSS JOIN (SELECT unnest([{grid}])::DOUBLE AS threshold) t
  LEFT JOIN single p ON p.s1_id = i.s1_id AND p.proba >= t.threshold LEFT JOIN (SELECT DISTINCT s1_id, cand_id FROM truth) h ON h.s1_id = p.s1_id AND h.cand_id = p.cand_id
  LEFT JOIN (SELECT s1_id, count(DISTINCT cand_id) AS n FROM truth GROUP BY s1_id) z ON z.s1_id = i.s1_id GROUP BY t.threshold, i.s1_id) t) GROUP BY threshold""".format(grid=", ".join(map(str, DecideConfig().thresholds)))


@query("tune_threshold", sql(f"SELECT threshold, round(f, 6) AS f FROM ({_TUNE}) ORDER BY round(f, 9) DESC, threshold LIMIT 1", "single", "truth", "ids"))
def _tune(spark, d):
    return decide.tune_threshold(written(decide.one_to_one(with_proba(spark, d)), "single"), truth(spark, d), ids(spark, d)).withColumn("f", F.round("f", 6))


@query("decide", sql(f"""SELECT i.s1_id, k.cand_id, CASE WHEN b.f > base.f THEN 'threshold_' || b.threshold ELSE 'expected_f' END AS policy FROM ids i
  CROSS JOIN (SELECT threshold, f FROM ({_TUNE}) ORDER BY f DESC, threshold LIMIT 1) b CROSS JOIN (SELECT round(avg(f), 9) AS f FROM entity_f) base
  LEFT JOIN LATERAL (SELECT cand_id FROM single p WHERE p.s1_id = i.s1_id AND b.f > base.f AND p.proba >= b.threshold UNION ALL SELECT cand_id FROM subset p WHERE p.s1_id = i.s1_id AND NOT b.f > base.f) k ON true""", "single", "subset", "entity_f", "truth", "ids"))
def _decide(spark, d):
    return decide.decide(written(with_proba(spark, d), "proba"), ids(spark, d), truth(spark, d))


# ---- evaluation


def _evaluated(build):
    return lambda spark, d: build(written(subset(spark, d), "subset"), truth(spark, d), ids(spark, d))


QUERIES["f_beta"] = _evaluated(lambda p, t, i: evaluate.entity_f_beta(p, t, i).withColumn("f", F.round("f", 6)))
SQL["f_beta"] = sql("SELECT s1_id, tp, n_pred, n_truth, round(f, 6) AS f FROM entity_f", "entity_f")
QUERIES["macro_f_beta"] = _evaluated(lambda p, t, i: evaluate.macro_f_beta(p, t, i).select(F.round("f", 6).alias("f")))
SQL["macro_f_beta"] = sql("SELECT round(avg(f), 6) AS f FROM entity_f", "entity_f")
QUERIES["micro_pr"] = _evaluated(lambda p, t, i: _cast_floats(evaluate.micro_pr(p, t, i)))
SQL["micro_pr"] = sql("SELECT sum(tp)::BIGINT AS tp, sum(n_pred)::BIGINT AS n_pred, sum(n_truth)::BIGINT AS n_truth, round(sum(tp)::DOUBLE / sum(n_pred), 6) AS precision, round(sum(tp)::DOUBLE / sum(n_truth), 6) AS recall FROM counts", "counts")
QUERIES["singleton_acc"] = _evaluated(lambda p, t, i: evaluate.singleton_accuracy(p, t, i).select(F.round("accuracy", 6).alias("accuracy")))
SQL["singleton_acc"] = sql("SELECT round(avg((n_pred = 0)::INT), 6) AS accuracy FROM counts WHERE n_truth = 0", "counts")
QUERIES["group_metrics"] = _evaluated(lambda p, t, i: evaluate.group_metrics(p, t, i, i).withColumn("f", F.round("f", 6)))
SQL["group_metrics"] = sql("SELECT coalesce(grp, 'unknown') AS grp, count(*) AS n, round(avg(f), 6) AS f FROM entity_f GROUP BY 1", "entity_f")


@query("blocking_recall", sql("""SELECT scope, grp, count(*) AS n_truth, count(blocks) AS n_found, round(count(blocks)::DOUBLE / count(*), 6) AS recall FROM (
  SELECT 'all' AS scope, 'all' AS grp, blocks FROM t UNION ALL SELECT 'country', country, blocks FROM t UNION ALL SELECT 'source', left(cand_id, 2), blocks FROM t) GROUP BY ALL""".replace("FROM t", "FROM (SELECT truth.*, blocks FROM truth LEFT JOIN capped USING (s1_id, cand_id))"), "truth", "capped"))
def _recall(spark, d):
    return evaluate.blocking_recall(truth(spark, d), capped(spark, d))


_NAMES = list(_BLOCK_NAMES)


@query("block_marginal", sql("SELECT block, count(*) FILTER (list_contains(string_split(blocks, ','), block)) AS n_alone, count(*) FILTER (blocks IS NOT NULL AND blocks <> block) AS n_without, count(blocks) AS n_found FROM (SELECT truth.*, blocks FROM truth LEFT JOIN scored USING (s1_id, cand_id)), (SELECT unnest([" + ", ".join(f"'{n}'" for n in _NAMES) + "]) AS block) GROUP BY block", "truth", "scored"))
def _marginal(spark, d):
    return evaluate.block_marginal(truth(spark, d), scored(spark, d), _NAMES)


@query("candidate_stats", sql("SELECT count(*) AS n_ids, round(avg(n), 6) AS avg_n, round(quantile_cont(n, 0.99), 6) AS p99_n, max(n) AS max_n FROM (SELECT i.s1_id, count(c.cand_id) AS n FROM ids i LEFT JOIN capped c USING (s1_id) GROUP BY i.s1_id)", "ids", "capped"))
def _stats(spark, d):
    return evaluate.candidate_stats(capped(spark, d), ids(spark, d))


@query("miss_universe", sql("SELECT * FROM truth t WHERE NOT EXISTS (SELECT 1 FROM b1 s WHERE s.s1_id = t.s1_id AND s.cand_id = t.cand_id)", "truth", "b1"))
def _misses(spark, d):
    return evaluate.miss_universe(truth(spark, d), blocking.block_exact_core(*sides(spark, d))).select("s1_id", "cand_id", "country")


@query("cap_loss", sql("SELECT country, count(*) AS n_lost FROM truth JOIN scored s USING (s1_id, cand_id) WHERE NOT EXISTS (SELECT 1 FROM (SELECT *, row_number() OVER (PARTITION BY s1_id ORDER BY n_blocks DESC, cand_id) AS r FROM scored) c WHERE c.r <= 1 AND c.s1_id = s.s1_id AND c.cand_id = s.cand_id) GROUP BY country", "truth", "scored"))
def _cap_loss(spark, d):
    union = written(scored(spark, d), "scored")
    return evaluate.cap_loss(truth(spark, d), union, blocking.cap_candidates(union, 1))


@query("worst_misses", sql("SELECT t.s1_id, t.cand_id, t.country, a.business_name AS name_a, b.business_name AS name_b FROM truth t JOIN records a ON a.entity_id = t.s1_id JOIN records b ON b.entity_id = t.cand_id WHERE NOT EXISTS (SELECT 1 FROM b1 s WHERE s.s1_id = t.s1_id AND s.cand_id = t.cand_id) ORDER BY t.s1_id, t.cand_id LIMIT 30", "truth", "b1", "records"))
def _worst(spark, d):
    return evaluate.worst_misses(truth(spark, d), blocking.block_exact_core(*sides(spark, d)), raw(spark, d))


@query("cap_sweep", sql("SELECT cap, count(*) AS n_pairs, count(hit) AS n_found, round(count(hit)::DOUBLE / (SELECT count(*) FROM truth), 6) AS recall FROM (SELECT s.*, t.hit, row_number() OVER (PARTITION BY s1_id ORDER BY n_blocks DESC, cand_id) AS r FROM scored s LEFT JOIN (SELECT s1_id, cand_id, 1 AS hit FROM truth) t USING (s1_id, cand_id)), (SELECT unnest([5, 20, 75])::BIGINT AS cap) WHERE r <= cap GROUP BY cap", "truth", "scored"))
def _cap_sweep(spark, d):
    return evaluate.cap_sweep(truth(spark, d), scored(spark, d), [5, 20, 75])


# ---- slices

_ORDERED = "md5(country || '|' || geo_token || ':42')"
_GREEDY = f"""SELECT country, geo_token, n FROM (SELECT *, sum(n) OVER (PARTITION BY country ORDER BY {_ORDERED}, geo_token ROWS UNBOUNDED PRECEDING)::BIGINT - n AS before FROM (
  SELECT country, geo_token, count(*) AS n FROM geo WHERE entity_id LIKE 'S1-%' GROUP BY ALL HAVING count(*) <= 2000)) JOIN (
  SELECT country, round(n::DOUBLE / sum(n) OVER () * 60) AS share FROM (SELECT country, count(*) AS n FROM s1 GROUP BY country)) USING (country) WHERE before < share"""


@query("greedy_buckets", sql(_GREEDY, "geo", "s1"))
def _greedy(spark, d):
    s1, _ = blocking.split_sources(norm(spark, d))
    return slices.greedy_buckets(blocking.geo_tokens(s1), s1.groupBy("country").agg(F.count("*").alias("n_country")), 60)


STEPS["evaluated"] = (("geo", "s1"), f"SELECT g.entity_id AS s1_id FROM geo g JOIN ({_GREEDY}) USING (country, geo_token) WHERE g.entity_id LIKE 'S1-%'")
STEPS["pool"] = (("address_tokens", "geo", "evaluated"), "SELECT DISTINCT entity_id AS cand_id FROM address_tokens a WHERE entity_id NOT LIKE 'S1-%' AND EXISTS (SELECT 1 FROM geo g JOIN evaluated e ON e.s1_id = g.entity_id WHERE g.country = a.country AND g.geo_token = a.token)")


def _evaluated_ids(spark, d, geo):
    s1, _ = blocking.split_sources(norm(spark, d))
    buckets = slices.greedy_buckets(geo, s1.groupBy("country").agg(F.count("*").alias("n_country")), 60)
    return geo.join(buckets, ["country", "geo_token"], "left_semi").select(F.col("entity_id").alias("s1_id"))


def _pool(spark, d):
    s1, cand = sides(spark, d)
    geo = written(blocking.geo_tokens(s1), "geo")
    some = written(_evaluated_ids(spark, d, geo), "evaluated")
    return slices.geo_pool(geo, blocking.address_tokens(cand), some), some


@query("geo_pool", sql("SELECT * FROM pool", "pool"))
def _geo_pool(spark, d):
    return _pool(spark, d)[0]


@query("owners_of", sql("SELECT DISTINCT s1_id FROM truth WHERE cand_id IN (SELECT entity_id FROM cand WHERE entity_id LIKE 'S2-%') AND s1_id NOT IN (SELECT s1_id FROM evaluated)", "truth", "cand", "evaluated"))
def _owners(spark, d):
    s1, cand = sides(spark, d)
    second = cand.filter(F.col("entity_id").startswith("S2-")).select(F.col("entity_id").alias("cand_id"))
    return slices.owners_of(truth(spark, d), second, _evaluated_ids(spark, d, blocking.geo_tokens(s1)))


@query("decoy_rate", sql("SELECT n_pool, n_owned, n_own, round(1 - n_own::DOUBLE / n_pool, 6) AS naive, round(1 - n_owned::DOUBLE / n_pool, 6) AS effective FROM (SELECT count(*) AS n_pool, count(*) FILTER (cand_id IN (SELECT cand_id FROM truth)) AS n_owned, count(*) FILTER (cand_id IN (SELECT cand_id FROM truth WHERE s1_id IN (SELECT s1_id FROM evaluated))) AS n_own FROM pool)", "pool", "truth", "evaluated"))
def _decoys(spark, d):
    pool, some = _pool(spark, d)
    return slices.decoy_rate(pool, truth(spark, d), some)


@query("val_slice")
def _val_slice(spark, d):
    return slices.validation_slice(raw(spark, d), truth(spark, d), 60)


@query("hash_sample", sql("SELECT entity_id, country FROM records ORDER BY md5(entity_id || ':42'), entity_id LIMIT 50", "records"))
def _hash_sample(spark, d):
    return slices.hash_sample(raw(spark, d).select("entity_id", "country"), "entity_id", 50)


@query("stratified_sample", sql("SELECT entity_id, country, src FROM (SELECT entity_id, country, left(entity_id, 2) AS src FROM records) QUALIFY row_number() OVER (PARTITION BY country, src ORDER BY md5(entity_id || ':42'), entity_id) <= 5", "records"))
def _stratified(spark, d):
    return slices.stratified_sample(raw(spark, d).select("entity_id", "country", F.substring("entity_id", 1, 2).alias("src")), ["country", "src"], "entity_id", 5)


# ---- id lists and files


@query("collect_ids", sql("SELECT s1_id, string_agg(DISTINCT cand_id, ',' ORDER BY cand_id) AS ids FROM truth GROUP BY s1_id", "truth"))
def _collect_ids(spark, d):
    return truth(spark, d).groupBy("s1_id").agg(F.array_join(F.array_sort(F.collect_set("cand_id")), ",").alias("ids"))


@query("id_list_write", sql("SELECT i.s1_id AS source1_entity_id, coalesce(string_agg(DISTINCT t.cand_id, ',' ORDER BY t.cand_id), '') AS matched_entity_ids FROM ids i LEFT JOIN truth t USING (s1_id) GROUP BY 1", "ids", "truth"))
def _id_list_write(spark, d):
    path = new_path(spark, "id-lists")
    sinks.write_id_lists(truth(spark, d), ids(spark, d), sinks.MATCH_HEADER, path)
    lists = records.scan_tsv(spark, path, records.TRUTH_SCHEMA)
    return lists.fillna("", ["matched_entity_ids"])


@query("id_list_explode", sql("SELECT DISTINCT s1_id, cand_id FROM truth", "truth"))
def _id_list_explode(spark, d):
    return records.explode_ids(sinks.id_lists(truth(spark, d), ids(spark, d), "id", "list"), "id", "list")


@query("scan_tsv")
def _scan_tsv(spark, d):
    path = new_path(spark, "records")
    flat = [F.regexp_replace(c, r"[\t\r\n]+", " ").alias(c) for c in ("entity_id", "business_name", "business_address", "country")]
    raw(spark, d).select(*flat).write.csv(path, sep="\t", header=True, quote="", emptyValue="")
    return records.scan_tsv(spark, path)


#: The file holds the truth's lists but for the third sources' ids, its own id in each list, and is asked for all ids but the third digit's.
@query("validate_output", sql("""SELECT 'matches' AS file, 'error' AS severity, "check", n FROM (
  SELECT 'reference id in list' AS "check", count(*) AS n FROM ids UNION ALL SELECT 'unknown id', count(DISTINCT cand_id) FROM (SELECT cand_id FROM truth UNION ALL SELECT s1_id FROM ids) WHERE cand_id NOT LIKE 'S2-%'
  UNION ALL SELECT 'extra id', count(*) FROM ids WHERE s1_id IN (SELECT s1_id FROM truth) UNION ALL SELECT 'missing id', count(DISTINCT cand_id) FROM truth) WHERE n > 0""", "ids", "truth"))
def _validate(spark, d):
    path = new_path(spark, "matches")
    own = ids(spark, d).select("s1_id", F.col("s1_id").alias("cand_id"))
    pairs = truth(spark, d).select("s1_id", "cand_id")
    sinks.write_id_lists(pairs.unionByName(own), ids(spark, d), sinks.MATCH_HEADER, path)
    known = raw(spark, d).filter(F.col("entity_id").startswith("S2-")).select(F.col("entity_id").alias("id"))
    required = ids(spark, d).select("s1_id").join(pairs.select("s1_id"), "s1_id", "left_anti").unionByName(pairs.select(F.col("cand_id").alias("s1_id")).distinct())
    return sinks.validate_lines(sinks.read_lines(spark, path), sinks.MATCH_HEADER, "matches", required, known)


@query("normalization_examples", sql("SELECT entity_id, country, business_name AS raw, name_full AS normalized_full, name_core, NULL::VARCHAR AS transliterated, NULL::VARCHAR AS normalized_after FROM norm QUALIFY row_number() OVER (PARTITION BY country ORDER BY md5(entity_id || ':42'), entity_id) <= 5", "norm"))
def _examples(spark, d):
    return learning.normalization_examples(raw(spark, d), suffixes(spark, d))


@query("source_views", sql("SELECT 'train_source' || k AS name, count(r.entity_id) AS n FROM (VALUES ('1'), ('2'), ('3')) v(k) LEFT JOIN records r ON substr(r.entity_id, 2, 1) = k GROUP BY k UNION ALL SELECT 'test_source' || k, 0 FROM (VALUES ('1'), ('2'), ('3')) v(k) UNION ALL SELECT 'train_ground_truth', count(*) FROM ids", "records", "ids"))
def _source_views(spark, d):
    """Records and truth written as files, read back through the views of the catalog."""
    root = new_path(spark, "catalog")
    flat = raw(spark, d).select(*[F.regexp_replace(c, r"[\t\r\n]+", " ").alias(c) for c in ("entity_id", "business_name", "business_address", "country")])
    for k in (1, 2, 3):
        flat.filter(F.col("entity_id").startswith(f"S{k}-")).write.csv(f"{root}/train_source{k}.tsv", sep="\t", header=True, quote="", emptyValue="")
        flat.limit(0).write.csv(f"{root}/test_source{k}.tsv", sep="\t", header=True, quote="", emptyValue="")
    sinks.write_id_lists(truth(spark, d), ids(spark, d), sinks.MATCH_HEADER, f"{root}/train_ground_truth.tsv")
    counts = [spark.table(name).agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name in records.register_catalog(spark, root)]
    return reduce(DataFrame.unionByName, counts)
