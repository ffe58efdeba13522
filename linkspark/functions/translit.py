"""Romanisation of nine Indic scripts to ITRANS, as an Arrow UDF.

The scripts' blocks agree place by place, so a letter is looked up by its offset in its block. A consonant carries an
inherent a unless a vowel sign or a virama follows.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from linkspark.functions import text as T

#: Fixed values of the romanisation, by offset in a block: independent vowels and their signs, consonants, other signs.
VOWELS = {0x05: "a", 0x06: "A", 0x07: "i", 0x08: "I", 0x09: "u", 0x0A: "U", 0x0B: "RRi", 0x0C: "LLi", 0x0D: ".N", 0x0E: "e", 0x0F: "e", 0x10: "ai", 0x11: "A.c", 0x12: "o", 0x13: "o", 0x14: "au", 0x60: "RRI"}
SIGNS = {0x3E: "A", 0x3F: "i", 0x40: "I", 0x41: "u", 0x42: "U", 0x43: "RRi", 0x44: "RRI", 0x45: ".c", 0x46: "e", 0x47: "e", 0x48: "ai", 0x49: "A.c", 0x4A: "o", 0x4B: "o", 0x4C: "au"}
CONSONANTS = dict(enumerate("k kh g gh ~N ch Ch j jh ~n T Th D Dh N t th d dh n n2 p ph b bh m y r r2 l L zh v sh Sh s h".split(), 0x15)) | {0x58: "q", 0x59: "K", 0x5A: "G", 0x5B: "z", 0x5C: ".D", 0x5D: ".Dh", 0x5E: "f", 0x5F: "Y"}
MARKS = {0x01: ".N", 0x02: "M", 0x03: "H", 0x3D: ".a", 0x50: "OM", 0x64: "|", 0x65: "||"} | {0x66 + k: str(k) for k in range(10)}
VIRAMA, NUKTA = 0x4D, 0x3C
NUKTA_FORMS = {"k": "q", "kh": "K", "g": "G", "j": "z", "D": ".D", "Dh": ".Dh", "ph": "f", "y": "Y"}
_BASES = sorted(T.SCRIPTS.values())


def _offset(c: str) -> int | None:
    k = ord(c)
    return k & 0x7F if _BASES[0] <= k < _BASES[-1] + 0x80 else None


def romanize(s: str) -> str:
    """ITRANS of the Indic letters in a text; everything else stays as it is."""
    out: list[str] = []
    pending = False  # a consonant that may still get its inherent vowel
    for c in s:
        at = _offset(c)
        if at in SIGNS:
            out.append(SIGNS[at])
            pending = False
        elif at == VIRAMA:
            pending = False
        elif at == NUKTA:
            if out:
                out[-1] = NUKTA_FORMS.get(out[-1], out[-1])
        else:
            if pending:
                out.append("a")
            pending = at in CONSONANTS
            out.append(CONSONANTS.get(at) or VOWELS.get(at) or MARKS.get(at, c if at is None else ""))
    return "".join(out) + ("a" if pending else "")


@F.pandas_udf(StringType())
def _romanized(text: pd.Series) -> pd.Series:
    return text.map(lambda s: s if s is None or s.isascii() else romanize(s))


def latin(text: Column) -> Column:
    """Texts of the nine scripts romanised, with unspoken final vowels dropped; others as they are."""
    indic = T.detect_script(text).isNotNull()
    return F.when(indic, T.schwa_delete(_romanized(F.when(indic, text)))).otherwise(text)


def transliterate(text: Column) -> Column:
    return F.when(T.detect_script(text).isNotNull(), _romanized(text)).otherwise(text)
