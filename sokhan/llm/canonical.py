"""Problem 5: one consistent form for text that looks alike but is made of other characters.

Method: quick checks by Unicode's normalisation properties find the places that aren't stable: characters with the quick-check value No or Maybe, and marks whose
order may change, both derived from the decompositions and combining classes; above them lies a layer of look-alike letters and digits, invisible characters, odd
spaces and misplaced half-spaces. Only the run of characters round each such place, its boundary context included, is normalised; the canonical runs are spliced
into the unchanged rest of the text. Texts that are surely stable never leave the JVM: a regular expression of a few ranges passes over them there.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ZWNJ = "‌"

# Letters of the Arabic block that look like a Persian letter, and that letter.
LOOKALIKE_ARABIC = {
    "ك": "ک", "ي": "ی", "ى": "ی", "ە": "ه", "ہ": "ه", "ھ": "ه", "ڪ": "ک", "ے": "ی", "ۍ": "ی", "ې": "ی",
}
# Cyrillic and Greek letters that look like a Latin letter, and that letter.
LOOKALIKE_LATIN = {
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P",
    "Ѕ": "S", "Т": "T", "Х": "X", "У": "Y", "а": "a", "с": "c", "е": "e", "і": "i", "ј": "j", "о": "o", "р": "p",
    "ѕ": "s", "х": "x", "у": "y",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P",
    "Τ": "T", "Υ": "Y", "Χ": "X", "ο": "o", "ν": "v", "ι": "i", "κ": "k", "ρ": "p", "υ": "u", "χ": "x", "α": "a",
}
# Characters that show nothing.
INVISIBLE = "­͏؜ـ᠎​‍‎‏‪-‮⁠-⁯﻿"
SPACES = "   -   　"


def _ranges(points: set[int] | list[int]) -> str:
    """Code points as the inside of a character class, which Python and Java read alike (none of them is ASCII)."""
    out, points = [], sorted(points)
    for i, c in enumerate(points):
        if i and points[i - 1] == c - 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "".join(chr(x) if x == y else f"{chr(x)}-{chr(y)}" for x, y in out)


def _properties() -> tuple[set[int], set[int], set[int], set[int]]:
    """(singletons, compatibility characters, second parts, marks) by Unicode's decompositions and combining classes.

    What normalisation may change: characters that composition doesn't give back (NFC quick check No), those with a compatibility form (NFKC quick check No), those that may
    join the character before them (quick check Maybe), and marks, whose order may change. Punctuation and spacing accents keep their look, so they are left alone.
    """
    single, compat, second, marks = set(), set(), set(range(0x1161, 0x1176)) | set(range(0x11A8, 0x11C3)), set()
    for c in (*range(0xA0, 0x3400), *range(0xA000, 0xAC00), *range(0xF900, 0x20000), *range(0x2F800, 0x2FA20)):
        x = chr(c)
        if unicodedata.combining(x):
            marks.add(c)
        form = unicodedata.decomposition(x)
        if not form:
            continue
        if form[0] == "<":
            if unicodedata.category(x)[0] != "P" and not form.endswith("0020") and " 0020 " not in form + " ":
                compat.add(c)
        else:
            parts = form.split()
            if unicodedata.normalize("NFC", x) != x:
                single.add(c)
            elif len(parts) > 1:
                second.add(int(parts[1], 16))
    return single, compat, second, marks


_single, _compatible, _second, _marks = _properties()
COMPAT = _ranges(_compatible)
_ARABIC = "".join(LOOKALIKE_ARABIC) + "٠-٩"
_FOREIGN = "Ͱ-ϿЀ-ӿ"
_LETTER = r"\p{L}\p{Mn}"
# vowel signs and tanwin belong to ordinary text, so long as one stands alone on its letter
_SIGNS = set(range(0x64B, 0x653)) | {0x670}
UNSTABLE = f"[{INVISIBLE}{SPACES}{_ranges((_single | _compatible | _second | _marks) - _SIGNS - set(range(0x370, 0x400)) - {ord(c) for c in SPACES})}{_ARABIC}{_FOREIGN}]"
#: What is surely stable: ASCII, Persian and Arabic letters that aren't look-alikes, Persian digits, Latin letters in one piece, common punctuation.
_SURE = "ء-غفقل-وپچژکگیۀ۰-۹ -~\n\r\t،؛؟«»À-ÖØ-öø-ÿ"
#: The quick check for the JVM, for texts that are surely stable from end to end: one pass over a few ranges, half-spaces and single signs only behind letters. Any other text goes to the check by properties.
STABLE = f"^(?:[{_SURE}]++|(?<=[{_LETTER}]){ZWNJ}(?=[{_LETTER}])|[ً-ْٰ](?![\\p{{Mn}}]))*+$"

_quick = re.compile(f"{UNSTABLE}|[{_ranges(_marks)}]{{2}}|{ZWNJ}(?!\\w)|(?<![\\wً-ٰٕ]){ZWNJ}")
# the same for Python, as far as the check by properties goes
_sure = re.compile(f"(?:[{_SURE}]++|(?<=[\\wً-ٰٕ]){ZWNJ}(?=\\w)|[ً-ْٰ](?![{_ranges(_marks)}]))*+")
_compat = re.compile(f"[{COMPAT}{SPACES}]+")
_invisible = re.compile(f"[{INVISIBLE}]+")
_arabic = str.maketrans(LOOKALIKE_ARABIC)
_to_persian = {0x660 + i: 0x6F0 + i for i in range(10)}
_to_ascii = {0x660 + i: 0x30 + i for i in range(10)}
_foreign = re.compile(f"[{_FOREIGN}]+")
_latin_word = re.compile(f"[A-Za-zÀ-ɏ{_FOREIGN}0-9٠-٩]+")
_joiner = re.compile(f"{ZWNJ}+")
_has_latin = re.compile("[A-Za-z]")
_latin_or_digit = re.compile("[A-Za-z0-9À-ɏ٠-٩]")
#: How far round a run, in characters and then on to the end of the word, it is asked whether the text there is of another alphabet.
CONTEXT = 24


def _imitations(word: re.Match, context: str) -> str:
    """A Latin-like word with the look-alike runs in it made Latin, if they imitate Latin letters."""
    text = word.group()
    if _has_latin.search(text):
        text = text.translate(_to_ascii)
    mixed = bool(_latin_or_digit.search(text))

    def one(m: re.Match) -> str:
        letters = m.group()
        if not all(c in LOOKALIKE_LATIN for c in letters):
            return letters
        if not mixed:  # stands alone: a whole word of its own alphabet, unless nothing near it is of that alphabet
            near = [w for w in _foreign.findall(context) if not all(c in LOOKALIKE_LATIN for c in w)]
            if near and letters == letters.lower():
                return letters
        return "".join(LOOKALIKE_LATIN[c] for c in letters)

    return _foreign.sub(one, text)


def _half_space(m: re.Match, text: str) -> str:
    """One half-space where letters stand on both sides (vowel signs belong to their letter), else nothing."""
    k = m.start()
    while k and (text[k - 1] == ZWNJ or unicodedata.category(text[k - 1]) == "Mn"):
        k -= 1
    return ZWNJ if text[k - 1 : k].isalpha() and text[m.end() : m.end() + 1].isalpha() else ""


def _settle(run: str, context: str) -> str:
    """The canonical form of one unstable run; what one step brings together may compose in the next, so steps go on until nothing changes."""
    while True:
        new = _compat.sub(lambda m: " " if m.group().isspace() and len(m.group()) == 1 else unicodedata.normalize("NFKC", m.group()), run)
        new = _invisible.sub("", new)
        new = unicodedata.normalize("NFC", new).translate(_arabic).replace("هٔ", "ۀ")
        new = _latin_word.sub(lambda m: _imitations(m, context), new).translate(_to_persian)
        new = _joiner.sub(lambda m, t=new: _half_space(m, t), new)
        if new == run:
            return run
        run = new


def canonicalize(text: str | None) -> str | None:
    """``text`` in its one consistent form; null stays null, text without unstable characters is returned as it is."""
    if not text or _sure.fullmatch(text):
        return text
    out, done, size = [], 0, len(text)
    while (m := _quick.search(text, done)) is not None:
        start = m.start()
        while start > done and text[start - 1] not in " \n\r\t":
            start -= 1
        end = m.end()
        while end < size and text[end] not in " \n\r\t":
            end += 1
        low, high = text.rfind(" ", 0, max(0, start - CONTEXT)) + 1, text.find(" ", end + CONTEXT)
        context = text[low : high if high >= 0 else size]
        out += (text[done:start], _settle(text[start:end], context))
        done = end
        if end == size:
            break
    out.append(text[done:])
    return "".join(out)


def needs_check(text: Column) -> Column:
    """True where the quick check can't tell that a text is stable; null for null."""
    return ~text.rlike(STABLE)


def canonical_changes(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Rows (key, field_name, value, canonical) for every stored value that isn't in the consistent form.

    One row for each distinct key, field and value, so rows delivered twice count once. Null and empty values are stable; rows with a null key are left out. Columns
    of ``df`` other than ``key`` and ``fields`` are not read. Texts of any length are processed whole. An empty table gives an
    empty result.
    """
    flagged = (
        df.select(F.col(key).alias("_key"), F.explode(F.array(*(F.struct(F.lit(f).alias("field_name"), F.col(f).alias("value")) for f in fields))).alias("_v"))
        .select("_key", "_v.field_name", "_v.value")
        .filter(needs_check(F.col("value")) & F.col("_key").isNotNull())
    )

    def settle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["canonical"] = [canonicalize(v) for v in b["value"]]
            yield b[b["canonical"] != b["value"]]

    kind = df.schema[key].dataType.simpleString()
    out = flagged.mapInPandas(settle, f"_key {kind}, field_name string, value string, canonical string")
    return out.dropDuplicates(["_key", "field_name", "value"]).withColumnRenamed("_key", key)


def canonical_text(df: DataFrame, fields: list[str]) -> DataFrame:
    """``df`` with every field in ``fields`` in the consistent form; other columns, nulls and repeats are kept as they are."""

    @F.pandas_udf("string")
    def settle(values: pd.Series) -> pd.Series:
        return values.map(canonicalize, na_action="ignore")

    return df.withColumns({f: F.when(needs_check(F.col(f)), settle(F.col(f))).otherwise(F.col(f)) for f in fields})
