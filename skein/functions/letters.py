"""Letters of the Latin, Cyrillic and Greek scripts in ASCII, as column expressions.

The table is made from the Unicode names of the letters: what a name says besides size, form and marks (`KA` of `CYRILLIC
SMALL LETTER KA WITH DESCENDER`) stands for a letter or a few. A letter whose name is not known gives that name's initial,
so none is lost; characters of other scripts stay as they are.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# The usual ASCII spelling of letters by their Unicode names; a Latin letter of a one-letter name is itself.
NAMES = {
    "CYRILLIC": {
        "A": "a", "BE": "b", "VE": "v", "GHE": "g", "DE": "d", "IE": "e", "IO": "io", "ZHE": "zh", "ZE": "z", "I": "i",
        "SHORT I": "i", "KA": "k", "EL": "l", "EM": "m", "EN": "n", "O": "o", "PE": "p", "ER": "r", "ES": "s", "TE": "t",
        "U": "u", "EF": "f", "HA": "kh", "TSE": "ts", "CHE": "ch", "SHA": "sh", "SHCHA": "shch", "HARD SIGN": '"',
        "YERU": "y", "SOFT SIGN": "'", "E": "e", "YU": "iu", "YA": "ia", "DJE": "dj", "GJE": "gj", "UKRAINIAN IE": "ie",
        "DZE": "dz", "BYELORUSSIAN-UKRAINIAN I": "i", "YI": "yi", "JE": "j", "LJE": "lj", "NJE": "nj", "TSHE": "tsh",
        "KJE": "kj", "SHORT U": "u", "DZHE": "dzh", "SCHWA": "e", "STRAIGHT U": "u", "SHHA": "h", "YAT": "e", "FITA": "f",
        "IZHITSA": "i", "PALOCHKA": "'",
    },
    "GREEK": {
        "ALPHA": "a", "BETA": "b", "GAMMA": "g", "DELTA": "d", "EPSILON": "e", "ZETA": "z", "ETA": "e", "THETA": "th",
        "IOTA": "i", "KAPPA": "k", "LAMDA": "l", "MU": "m", "NU": "n", "XI": "x", "OMICRON": "o", "PI": "p", "RHO": "r",
        "SIGMA": "s", "TAU": "t", "UPSILON": "u", "PHI": "ph", "CHI": "kh", "PSI": "ps", "OMEGA": "o",
    },
    "LATIN": {
        "SHARP S": "ss", "ETH": "d", "THORN": "th", "ENG": "ng", "SCHWA": "e", "EZH": "zh", "ESH": "sh", "KRA": "q",
        "YOGH": "gh", "WYNN": "w", "GLOTTAL STOP": "'", "IOTA": "i", "ALPHA": "a", "GAMMA": "g", "UPSILON": "u",
    },
}
_FORMS = set(
    "CAPITAL SMALL LETTER LIGATURE MODIFIER FINAL DOTLESS LONG REVERSED TURNED OPEN CLOSED INSULAR ARCHAIC SIDEWAYS SCRIPT "
    "BLACKLETTER STRETCHED INVERTED LUNATE BARRED DOTTED ROUND TALL NARROW WIDE LIGHT TOP BOTTOM HALF".split()
)
_ASCII = re.compile(r"[\x20-\x7e]+")


def plain(letter: str) -> str | None:
    """What stands for a letter of the three scripts, in lower case; None for other characters."""
    other = unicodedata.normalize("NFKC", letter)
    if other != letter:  # ligatures, full widths, superscripts
        return "".join(x if x.isascii() and x.isalpha() else plain(x) or "" for x in other).lower() or None
    said = unicodedata.name(letter, "").split(" WITH ")[0].split()
    if not unicodedata.category(letter).startswith("L") or not said or said[0] not in NAMES:
        return None
    known, own = NAMES[said[0]], " ".join(said)
    name = [x for x in said[1:] if x not in _FORMS] or said[-1:]
    for some in (re.sub(r".* LETTER ", "", own), " ".join(name), name[-1]):
        if some in known:
            return known[some]
    return name[-1].lower() if said[0] == "LATIN" and len(name[-1]) < 3 else name[-1][0].lower()


@cache
def table() -> dict[str, str]:
    """Letter to ASCII, for all letters beyond it whose name begins with a script of the table."""
    out = {ch: s for ch in map(chr, range(0x80, sys.maxunicode + 1)) if unicodedata.category(ch)[0] == "L" and unicodedata.name(ch, "").startswith((*NAMES, "FULLWIDTH LATIN")) and (s := plain(ch))}
    return {ch: s for ch, s in out.items() if _ASCII.fullmatch(s)}


def nfc(c: Column) -> Column:
    """Canonical composition, by the ICU class that Spark ships; ASCII text is left as it is."""
    full = F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), F.coalesce(c, F.lit("")), F.lit(False))
    return F.when(c.rlike(r"[^\x00-\x7F]"), full).otherwise(c)


def transliterate(c: Column) -> Column:
    """c in lower case with Latin, Cyrillic and Greek letters in ASCII and no combining marks; the rest as it is.

    Letters of one spelling become one letter first, so there are as many replacements as spellings of several letters.
    """
    first: dict[str, str] = {}
    for ch, s in table().items():
        if len(s) > 1 and len(ch.encode("utf-16-le")) == 2:
            first.setdefault(s, ch)
    one = {ch: s if len(s) == 1 else first[s] for ch, s in table().items() if len(s) == 1 or s in first}
    out = F.translate(nfc(F.lower(nfc(c))), "".join(one), "".join(one.values()))
    for s, ch in first.items():
        out = F.replace(out, F.lit(ch), F.lit(s))
    return F.when(c.rlike(r"[^\x00-\x7F]"), F.regexp_replace(out, r"\p{M}", "")).otherwise(F.lower(c))
