"""Normalisation of names and addresses as column expressions; all of it runs in the JVM."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Whole tokens and what they stand for.
ABBREVIATIONS = {
    "corp": "corporation",
    "inc": "incorporated",
    "co": "company",
    "ltd": "limited",
    "llc": "limited liability company",
    "llp": "limited liability partnership",
    "pvt": "private",
    "assn": "association",
    "bros": "brothers",
    "mfg": "manufacturing",
    "intl": "international",
    "rd": "road",
    "st": "street",
    "ave": "avenue",
    "blvd": "boulevard",
    "dr": "drive",
    "ln": "lane",
    "ct": "court",
    "pl": "place",
    "apt": "apartment",
    "ste": "suite",
    "hwy": "highway",
    "pkwy": "parkway",
}

#: The first code points of 128-character blocks whose letters stand in the same places, in the order in
#: which a text's script is looked for.
SCRIPTS = {
    "BENGALI": 0x0980,
    "DEVANAGARI": 0x0900,
    "GUJARATI": 0x0A80,
    "GURMUKHI": 0x0A00,
    "KANNADA": 0x0C80,
    "MALAYALAM": 0x0D00,
    "ORIYA": 0x0B00,
    "TAMIL": 0x0B80,
    "TELUGU": 0x0C00,
}


def _folded(c: str) -> str:
    return "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))


@lru_cache(maxsize=1)
def _fold_tables() -> tuple[str, str, str, dict[str, str]]:
    """Letters that fold to one ASCII character, those characters, a class of combining marks, and what folds to more
    with ASCII in it."""
    one, to, marks, more = [], [], [], {}
    for k in range(0x80, 0x10000):
        c = chr(k)
        if 0xAC00 <= k < 0xD7B0 or 0xD800 <= k < 0xE000:
            continue
        if unicodedata.combining(c):
            marks.append(c)
        elif len(f := _folded(c)) == 1 and f.isascii():
            one.append(c)
            to.append(f)
        elif len(f) > 1 and any(x.isascii() and x.isalnum() for x in f):
            more[c] = f
    return "".join(one), "".join(to), "[" + "".join(marks) + "]", more


def strip_accents(text: Column) -> Column:
    """Compatibility-decomposed, without combining marks, as far as the result is ASCII; other scripts stay."""
    one, to, marks, more = _fold_tables()
    table = F.create_map(*[F.lit(x) for kv in more.items() for x in kv])
    spelled = F.array_join(F.transform(F.split(text, ""), lambda c: F.coalesce(F.element_at(table, c), c)), "")
    whole = F.when(text.rlike("[" + "".join(more) + "]"), spelled).otherwise(text)
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.regexp_replace(F.translate(whole, one, to), marks, "")).otherwise(text)


def basic_clean(text: Column) -> Column:
    """Lower case, no accents, & spelled out, runs of anything but a-z and 0-9 as one space; '' for null."""
    spelled = F.replace(strip_accents(F.lower(text)), F.lit("&"), F.lit(" and "))
    return F.coalesce(F.trim(F.regexp_replace(spelled, "[^a-z0-9]+", " ")), F.lit(""))


def tokens(text: Column) -> Column:
    return F.filter(F.split(text, " "), lambda t: t != "")


def expand_abbreviations(text: Column) -> Column:
    """Whole tokens by the table; empty tokens go."""
    table = F.create_map(*[F.lit(x) for kv in ABBREVIATIONS.items() for x in kv])
    return F.array_join(F.transform(tokens(text), lambda t: F.coalesce(F.element_at(table, t), t)), " ")


def map_tokens(text: Column, table: Column) -> Column:
    """Each token by a map column; tokens that it lacks stay."""
    return F.array_join(F.transform(tokens(text), lambda t: F.coalesce(F.element_at(table, t), t)), " ")


def script_class(name: str) -> str:
    return f"[{chr(SCRIPTS[name])}-{chr(SCRIPTS[name] + 0x7F)}]"


def has_devanagari(text: Column) -> Column:
    return F.coalesce(text.rlike(script_class("DEVANAGARI")), F.lit(False))


def detect_script(text: Column) -> Column:
    """The first script of the list that occurs in the text, else null."""
    return F.coalesce(*[F.when(text.rlike(script_class(name)), F.lit(name)) for name in SCRIPTS])


def schwa_delete(text: Column) -> Column:
    """Of tokens over two letters that end in one a after no vowel, that a goes. Tokens are parted by single spaces."""

    def token(t: Column) -> Column:
        return F.when((F.length(t) > 2) & t.endswith("a") & ~F.substring(t, -2, 1).rlike("[aeiouAEIOU]"), F.substring(t, F.lit(1), F.length(t) - 1)).otherwise(t)

    return F.array_join(F.transform(F.split(text, " "), token), " ")


def normalize_full(text: Column, token_map: Column | None = None) -> Column:
    """Clean and spelled out; texts of other scripts go through translit.latin() before."""
    full = expand_abbreviations(basic_clean(text))
    return full if token_map is None else map_tokens(full, token_map)


def name_core(full: Column, suffixes: Column) -> Column:
    """Without the tokens of an array; the whole name if nothing is left. A null array drops nothing."""
    core = F.array_join(F.filter(F.split(full, " "), lambda t: (t != "") & ~F.coalesce(F.array_contains(suffixes, t), F.lit(False))), " ")
    return F.when(core == "", full).otherwise(core)


def _group_or_null(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))


def postal_code(address: Column) -> Column:
    """The last run of six digits with no digit after it, else of five (plus four)."""
    return F.coalesce(_group_or_null(address, r"(\d{6})\D*$"), _group_or_null(address, r"(\d{5})(?:-\d{4})?\D*$"))


def house_number(address: Column) -> Column:
    """The first run of digits."""
    return _group_or_null(address, r"(\d+)")


def digit_tokens(address: Column) -> Column:
    """The distinct runs of digits; none for null."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(address, F.lit("")), F.lit(r"(\d+)"), F.lit(1)))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets: 1 if both are empty, 0 if one is."""
    both = F.size(F.array_intersect(a, b)).cast("double") / F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both)


def address_words(address: Column) -> Column:
    """Lower-case runs of a-z and 0-9, as an array."""
    return F.split(F.regexp_replace(F.lower(address), "[^a-z0-9]+", " "), " ")


def name_words(name: Column) -> Column:
    """Tokens for stop-word statistics: no accents stripped, abbreviations spelled out within one token."""
    table = F.create_map(*[F.lit(x) for kv in ABBREVIATIONS.items() for x in kv])
    words = F.split(F.regexp_replace(F.replace(F.lower(name), F.lit("&"), F.lit(" and ")), "[^a-z0-9]+", " "), " ")
    return F.transform(F.filter(words, lambda t: t != ""), lambda t: F.coalesce(F.element_at(table, t), t))
