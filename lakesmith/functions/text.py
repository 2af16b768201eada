"""Text cleaning."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._column import ColumnOrName, as_column, let

# The characters a Unicode-aware strip removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Texts that stand for an absent value, compared in upper case.
ABSENCE_MARKERS = ("NA", "N/A", "NULL", "NONE", "-", "--")

# Characters whose ASCII spelling is not their base letter.
ASCII_SPELLINGS = {
    "Æ": "AE", "æ": "ae", "Œ": "OE", "œ": "oe", "Ø": "O", "ø": "o",
    "ß": "ss", "ẞ": "SS", "Đ": "D", "đ": "d", "Ð": "D", "ð": "d",
    "Þ": "Th", "þ": "th", "Ł": "L", "ł": "l", "Ħ": "H", "ħ": "h",
    "ı": "i", "Ŧ": "T", "ŧ": "t", "Ŋ": "NG", "ŋ": "ng", "Ĳ": "IJ", "ĳ": "ij",
    "\xa0": " ", "¡": "!", "¢": "C/", "£": "PS", "¤": "$?", "¥": "Y=",
    "¦": "|", "§": "SS", "¨": '"', "©": "(c)", "ª": "a", "«": "<<",
    "¬": "!", "\xad": "", "®": "(r)", "¯": "-", "°": "deg", "±": "+-",
    "²": "2", "³": "3", "´": "'", "µ": "u", "¶": "P", "·": "*",
    "¸": ",", "¹": "1", "º": "o", "»": ">>", "¼": "1/4", "½": "1/2",
    "¾": "3/4", "¿": "?", "×": "x", "÷": "/",
    "–": "-", "—": "--", "‘": "'", "’": "'", "“": '"', "”": '"',
    "…": "...", "€": "EUR", "™": "(tm)",
}


def _base_letters() -> dict[str, str]:
    """Latin letters whose decomposition is one ASCII letter plus combining marks."""
    table = {}
    for code in (*range(0x00C0, 0x0250), *range(0x1E00, 0x1F00)):
        char = chr(code)
        if char in ASCII_SPELLINGS:
            continue
        kept = [c for c in unicodedata.normalize("NFKD", char) if not unicodedata.combining(c)]
        if len(kept) == 1 and kept[0].isascii() and kept[0] != char:
            table[char] = kept[0]
    return table


_LETTERS = _base_letters()
_ONE_TO_ONE = {**_LETTERS, **{k: v for k, v in ASCII_SPELLINGS.items() if len(v) == 1}}
_LONGER = {k: v for k, v in ASCII_SPELLINGS.items() if len(v) > 1}
# translate() drops the characters that have no counterpart: combining marks, soft hyphen.
_DROPPED = "".join(map(chr, range(0x0300, 0x0370))) + "\xad"


def strip(value: ColumnOrName) -> Column:
    """Remove Unicode whitespace at both ends (``trim`` alone removes blanks only)."""
    return F.trim(as_column(value), F.lit(WHITESPACE))


def collapse_spaces(value: ColumnOrName) -> Column:
    return F.trim(F.regexp_replace(as_column(value), r"(?U)[\s\x1c-\x1f]+", " "))


def strip_accents(value: ColumnOrName, full: bool = False) -> Column:
    """ASCII spelling of Latin text; ``full`` transliterates every script.

    ASCII-only values are returned as they are. ``full`` runs a Pandas UDF for
    the values that still hold other scripts and needs the ``unidecode`` package.
    """

    def spelled_out(letters: Column) -> Column:
        longer = letters
        for char, spelling in _LONGER.items():
            longer = F.replace(longer, F.lit(char), F.lit(spelling))
        return F.when(_is_ascii(letters), letters).otherwise(longer)

    def latin(text: Column) -> Column:
        letters = F.translate(text, "".join(_ONE_TO_ONE) + _DROPPED, "".join(_ONE_TO_ONE.values()))
        return F.when(_is_ascii(text), text).otherwise(let(letters, spelled_out))

    plain = let(as_column(value), latin)
    if full:
        plain = F.when(_is_ascii(plain), plain).otherwise(_transliterate()(plain))
    return plain


def _is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.char_length(text)


def _transliterate():
    import pandas as pd
    from unidecode import unidecode

    @F.pandas_udf("string")
    def transliterate(values: pd.Series) -> pd.Series:
        return values.map(unidecode, na_action="ignore")

    return transliterate


def null_if_blank(value: ColumnOrName) -> Column:
    text = strip(value)
    # Only short texts are compared, so a long one is not copied in upper case.
    longest = max(map(len, ABSENCE_MARKERS))
    marker = (F.char_length(text) <= longest) & F.upper(text).isin(*ABSENCE_MARKERS)
    return F.when((text != "") & ~marker, text)


def normalize_text(value: ColumnOrName, *, upper: bool = True, accents: bool = False) -> Column:
    """Blank markers to null, spaces collapsed, accents removed unless ``accents``, upper case."""
    text = collapse_spaces(null_if_blank(value))
    if not accents:
        text = strip_accents(text)
    return F.upper(text) if upper else text


def digits_only(value: ColumnOrName) -> Column:
    return F.nullif(F.regexp_replace(as_column(value), "[^0-9]+", ""), F.lit(""))
