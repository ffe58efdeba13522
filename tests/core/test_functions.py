"""Column functions and similarity kernels."""

import difflib
import random
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from linkspark.functions import batches, similarity, text, translit


def values(spark, build, inputs):
    table = spark.createDataFrame([(k, x) for k, x in enumerate(inputs)], "k int, x string")
    return [r[0] for r in table.orderBy("k").select(build(F.col("x"))).collect()]


def test_basic_clean(spark):
    inputs = ["  Smart   FINANCIAL Networks ", "Smith & Sons", "Café Francais", "A.B.C., Inc.", None, "", "ﬁne ½ Ⅷ ＡＢ", "ÀÉÎÕÜ\u0301"]
    assert values(spark, text.basic_clean, inputs) == ["smart financial networks", "smith and sons", "cafe francais", "a b c inc", "", "", "fine 1 2 viii ab", "aeiou"]


def test_accents_as_decomposed(spark):
    letters = "".join(chr(k) for k in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00), 0xFB01, 0x2460, 0x1D2C])
    inputs = [c + "x" for c in letters]
    want = []
    for c in inputs:
        folded = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        want.append(folded if folded.isascii() else None)
    got = values(spark, text.strip_accents, inputs)
    assert all(w is None or g == w for g, w in zip(got, want, strict=True))


def test_abbreviations(spark):
    assert values(spark, text.expand_abbreviations, ["st street", "coast rd", "a  llc", ""]) == ["street street", "coast road", "a limited liability company", ""]


def test_name_core(spark):
    drop = F.array(F.lit("private"), F.lit("limited"))
    build = lambda x: text.name_core(text.normalize_full(x), drop)
    assert values(spark, build, ["Anand Builders Private Limited", "private limited", None]) == ["anand builders", "private limited", ""]


def test_scripts(spark):
    inputs = ["தமிழ்", "ગુજરાતી", "राम", "Ram", None, "বাংলা", "ਪੰਜਾਬੀ", "ಕನ್ನಡ", "മലയാളം", "ଓଡ଼ିଆ", "తెలుగు"]
    assert values(spark, text.detect_script, inputs) == ["TAMIL", "GUJARATI", "DEVANAGARI", None, None, "BENGALI", "GURMUKHI", "KANNADA", "MALAYALAM", "ORIYA", "TELUGU"]
    assert values(spark, text.has_devanagari, ["राम मार्केटिंग प्राइवेट लिमिटेड", "Ram Marketing", None]) == [True, False, False]


def test_transliteration(spark):
    assert values(spark, translit.transliterate, ["राम मार्केटिंग", "Ram Marketing", None]) == ["rAma mArkeTiMga", "Ram Marketing", None]
    build = lambda x: text.normalize_full(translit.latin(x))
    got = values(spark, build, ["लिमिटेड", "தமிழ் நிறுவனம்", "Ltd"])
    assert got[0] == "limited" and got[1] and got[1].isascii() and got[2] == "limited"
    assert values(spark, text.schwa_delete, ["maa", "kaa", "limiTeDa", "rAma mArkeTiMga", "ca"]) == ["maa", "kaa", "limiTeD", "rAm mArkeTiMg", "ca"]
    mapped = lambda x: text.normalize_full(translit.latin(x), F.create_map(F.lit("marketimg"), F.lit("marketing")))
    assert "marketing" in values(spark, mapped, ["राम मार्केटिंग"])[0].split()


def test_numbers_in_addresses(spark):
    assert values(spark, text.postal_code, ["x 560001", "x 12345-6789", "x 1234", None, "560001 b 12345", "1234567"]) == ["560001", "12345", None, None, "12345", "234567"]
    assert values(spark, text.house_number, ["221B Baker Street", "no digit", None]) == ["221", None, None]
    sets = [("", "", 1.0), ("1", "", 0.0), ("1 2 2", "2 3", 1 / 3)]
    table = spark.createDataFrame(sets, "a string, b string, want double")
    for r in table.select(text.jaccard(text.digit_tokens(F.col("a")), text.digit_tokens(F.col("b"))).alias("got"), "want").collect():
        assert r.got == pytest.approx(r.want)


def slow_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.text("abc é", max_size=20), st.text("abc é", max_size=20))
def test_ratio_is_common_subsequence(a, b):
    assert similarity.lcs_length(a, b) == slow_lcs(a, b)
    assert similarity.ratio(a, b) == similarity.ratio(b, a)
    assert 0 <= similarity.partial_ratio(a, b) <= 100 and similarity.partial_ratio(a, a) == 100
    if a and b:
        assert similarity.partial_ratio(a, b) >= similarity.ratio(a, b) - 1e-9 or len(a) != len(b)


@settings(max_examples=100, deadline=None)
@given(st.text("ab c", min_size=1, max_size=8), st.text("ab c", min_size=1, max_size=16))
def test_partial_ratio_tries_all_windows(a, b):
    if len(a) > len(b):
        a, b = b, a
    windows = {b[max(0, k) : k + len(a)] for k in range(1 - len(a), len(b))}
    best = max(similarity.ratio(a, w) for w in windows)
    if len(a) == len(b):
        best = max(best, max(similarity.ratio(b, a[max(0, k) : k + len(b)]) for k in range(1 - len(b), len(a))))
    assert similarity.partial_ratio(a, b) == pytest.approx(best)


def test_kernels_by_hand():
    assert similarity.ratio("abcd", "abxd") == 75.0
    assert similarity.ratio("", "") == 100.0 and similarity.ratio("a", "") == 0.0
    assert similarity.jaro_winkler("martha", "marhta") == pytest.approx(96.1111, abs=1e-3)
    assert similarity.jaro_winkler("dwayne", "duane") == pytest.approx(84.0, abs=1e-3)
    assert similarity.token_set_ratio("fuzzy was a bear", "fuzzy fuzzy was a bear") == 100.0
    assert similarity.token_set_ratio("", "a") == 0.0
    assert similarity.token_set_ratio("a b", "c d") == similarity.ratio("a b", "c d")
    assert similarity.partial_ratio("abc", "xxabcxx") == 100.0 and similarity.partial_ratio("", "a") == 0.0


def test_jaro_winkler_against_sql():
    import duckdb

    rnd = random.Random(3)
    con = duckdb.connect()
    for _ in range(300):
        a, b = ("".join(rnd.choice("abcd") for _ in range(rnd.randint(1, 12))) for _ in range(2))
        want = con.execute("SELECT 100 * jaro_winkler_similarity(?, ?)", [a, b]).fetchone()[0]
        assert similarity.jaro_winkler(a, b) == pytest.approx(want, abs=1e-6)
    assert difflib.SequenceMatcher(None, "a", "a").ratio() == 1


def test_batches_follow_the_definitions():
    rnd = random.Random(1)
    sizes, pairs = [0, 1, 2, 3, 5, 10, 30, 60, 63, 64, 65, 70, 100], [("x" * 300, "xy" * 100), ("martha", "marhta"), (" ", "")]
    for letters in ("ab ", "abcdefgh ", "aé漢🂡 "):
        for _ in range(400):
            a, b = ("".join(rnd.choice(letters) for _ in range(rnd.choice(sizes))) for _ in range(2))
            if a and rnd.random() < 0.4:
                b = a.replace(rnd.choice(a), "z", 1) + b[:5]
            pairs += [(a, b), (b, a)]
    for name, kernel in {"ratio": similarity.ratio, "set": similarity.token_set_ratio, "partial": similarity.partial_ratio, "jw": similarity.jaro_winkler}.items():
        assert batches.KERNELS[name](pairs).tolist() == [kernel(a, b) for a, b in pairs]
        assert batches.KERNELS[name]([]).tolist() == []
    (both,) = batches.scores(["ratio"], ([None, "ab", "ab"], ["", "ab", "ax"]))
    assert both[0].tolist() == [100.0, 100.0, 50.0]
