"""Column functions over transcript text: words, normal forms, similarity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

ZWNJ = "‌"
#: Any white space of Unicode; the half-space is none.
SPACE = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"

# Punctuation that is set aside; "-" and "/" stay, they stand in codes.
PUNCTUATION = ".,،؛;:!?؟«»\"“”()[]…"
# Letters that are folded, and what they become.
LETTER_FROM, LETTER_TO = "ةؤئأإآٱ", "هویاااا"
# Colloquial spellings of numbers and the standard ones.
NUMBER_VARIANTS = {
    "دوازه": "دوازده", "سینزده": "سیزده", "شونزده": "شانزده", "شیش": "شش", "شیشصد": "ششصد", "نونزده": "نوزده", "هشصد": "هشتصد", "هیجده": "هجده",
    "هیفده": "هفده", "پونزده": "پانزده", "پونصد": "پانصد", "چار": "چهار", "چارده": "چهارده", "چارصد": "چهارصد", "یازه": "یازده",
}
# Words that are written attached to the word before them, and their attached form.
CLITICS = {"رو": "و", "را": "و", "هم": "م"}
# Attached forms of the object marker.
OBJECT_MARKERS = ("و", "رو")
# Number words.
NUMBER_WORDS = (
    "صفر یک دو سه چهار پنج شش هفت هشت نه ده یازده دوازده سیزده چهارده پانزده شانزده هفده "
    "هجده نوزده بیست سی چهل پنجاه شصت هفتاد هشتاد نود صد دویست سیصد چهارصد پانصد ششصد "
    "هفتصد هشتصد نهصد هزار میلیون میلیارد "
    "شونزده سینزده دوازه شیش شیشصد نونزده هشصد هیجده هیفده پونزده پونصد چار چارده چارصد یازه "
    "اول دوم سوم چهارم پنجم ششم هفتم هشتم نهم دهم"
).split()
# Words without meaning of their own.
FILLER_WORDS = (
    "بله آره آها اها الو آه اه ام امم اممم خب خوب و رو را هم دیگه یعنی حالا مرسی ممنون باشه چشم نه آقا خانم اینکه که "
    "این اون یه یک ببخشید بفرمایید بفرمایین عرض حتما الان جان اوکی اکی آهان اهان اهوم اوهوم بلی بعله"
).split()
# Informal words and their standard form, as far as they are publicly stated; a table of more can be passed instead.
INFORMAL = {"یه": "یک", "خب": "خوب", "دیگه": "دیگر", "تومن": "تومان"}
# Letters of one sound and the letter that stands for them.
SOUND_FROM, SOUND_TO = "ذضظصثطغه", "زززسستقح"


def words(text: Column) -> Column:
    """Words between white space, none empty; null for null."""
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def n_words(text: Column) -> Column:
    return F.size(words(F.coalesce(text, F.lit(""))))


def strip_zwnj(text: Column) -> Column:
    return F.translate(text, ZWNJ, "")


def squash(text: Column) -> Column:
    """Without spaces and half-spaces."""
    return F.translate(text, " " + ZWNJ, "")


def strip_punctuation(text: Column) -> Column:
    return F.array_join(words(F.translate(text, PUNCTUATION, "")), " ")


def fold_letters(word: Column) -> Column:
    return F.translate(word, LETTER_FROM, LETTER_TO)


def _lookup(table: dict[str, str], word: Column) -> Column:
    entries = F.create_map(*(F.lit(x) for kv in table.items() for x in kv))
    return F.coalesce(F.try_element_at(entries, word), word)


def canonical_word(word: Column) -> Column:
    """Letters folded, number spelled the standard way."""
    return _lookup(NUMBER_VARIANTS, fold_letters(word))


def join_clitics(ws: Column) -> Column:
    """Clitics written apart joined to the output word before them, unless that word is a clitic itself."""
    clitic = lambda w: w.isin(*CLITICS)

    def step(out: Column, w: Column) -> Column:
        last = F.try_element_at(out, F.lit(-1))
        joins = (F.size(out) > 0) & clitic(w) & ~clitic(last)
        fused = F.concat(F.rtrim(last, F.lit(ZWNJ)), _lookup(CLITICS, w))
        return F.when(joins, F.concat(F.slice(out, 1, F.size(out) - 1), F.array(fused))).otherwise(F.concat(out, F.array(w)))

    return F.aggregate(ws, F.array().cast("array<string>"), step)


def normalize_clitics(text: Column) -> Column:
    return F.array_join(join_clitics(F.transform(words(text), canonical_word)), " ")


def normalize_lenient(text: Column, informal: dict[str, str] = INFORMAL) -> Column:
    """Lenient normal form: ك and ي folded, a parted می joined by a half-space, words of ``informal`` made standard (شبا stays)."""
    t = F.translate(text, "كي", "کی")
    t = F.regexp_replace(F.array_join(words(t), " "), r"(?<!\S)(ن?می) (?=\S)", "$1" + ZWNJ)
    return F.array_join(F.transform(F.split(t, " "), lambda w: _lookup(informal, w)), " ")


def verb_endings_match(a: Column, b: Column) -> Column:
    """Same stem, one with the colloquial ending ین, the other with ید; both of four letters or more."""
    ends = lambda x, e: F.endswith(x, F.lit(e))
    stem = lambda x: F.substring(x, F.lit(1), F.length(x) - 2)
    pair = (ends(a, "ید") & ends(b, "ین")) | (ends(a, "ین") & ends(b, "ید"))
    return (F.length(a) >= 4) & (F.length(b) >= 4) & pair & (stem(a) == stem(b))


def object_markers_match(a: Column, b: Column) -> Column:
    """را and رو, or one word is the other with one of OBJECT_MARKERS attached."""
    x, y = F.rtrim(a, F.lit(ZWNJ)), F.rtrim(b, F.lit(ZWNJ))
    bare = F.array_sort(F.array(a, b)) == F.array_sort(F.array(F.lit("را"), F.lit("رو")))
    return reduce(lambda c, m: c | (F.concat(x, F.lit(m)) == y) | (F.concat(y, F.lit(m)) == x), OBJECT_MARKERS, bare)


def words_equivalent(a: Column, b: Column) -> Column:
    return (a == b) | verb_endings_match(a, b) | object_markers_match(a, b)


def sound_key(text: Column) -> Column:
    """Half-spaces dropped, letters of one sound made one."""
    return F.translate(strip_zwnj(text), SOUND_FROM, SOUND_TO)


def sound_similarity(a: Column, b: Column) -> Column:
    """1 - edit distance of the sound keys / the longer key's length; 1 for two empty ones. Spaces count."""
    x, y = sound_key(a), sound_key(b)
    longest = F.greatest(F.length(x), F.length(y))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(x, y) / longest)


def span_similarity(a: Column, b: Column) -> Column:
    """The same of squashed spans, so that spacing doesn't count."""
    return sound_similarity(squash(a), squash(b))


def occurrences(ws: Column) -> Column:
    """Each word with the number of its occurrence so far: as a set, these are the multiset of the words."""
    # the sorted array is bound once; an occurrence's number is its distance from the first of its kind
    numbered = lambda o: F.transform(o, lambda w, i: F.concat(w, F.lit(" "), (i - F.array_position(o, w)).cast("string")))
    return F.get(F.transform(F.array(F.array_sort(ws)), numbered), F.lit(0))


def shared_words(a: Column, b: Column) -> Column:
    """Size of the multiset intersection."""
    return F.size(F.array_intersect(occurrences(a), occurrences(b)))


def overlap_pct(a: Column, b: Column) -> Column:
    """Percentage of the words of ``a`` that ``b`` has too, 2 decimals; half to even; 100 for an ``a`` without words."""
    x, y = words(F.coalesce(a, F.lit(""))), words(F.coalesce(b, F.lit("")))
    return F.when(F.size(x) == 0, F.lit(100.0)).otherwise(F.bround(shared_words(x, y) / F.size(x) * 100, 2))


def character_overlap(a: Column, b: Column) -> Column:
    """Share of the distinct characters of ``a`` that ``b`` has, half-spaces aside; 0 for an empty ``a``."""
    chars = lambda x: F.array_distinct(F.filter(F.split(strip_zwnj(x), ""), lambda c: c != ""))
    return F.when(F.size(chars(a)) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(chars(a), chars(b))) / F.size(chars(a)))


def is_number_word(w: Column) -> Column:
    return w.rlike("[0-9۰-۹]") | F.trim(w, F.lit(ZWNJ)).isin(*NUMBER_WORDS)


def changes_number(original: Column, replacement: Column) -> Column:
    """A number word or digit on either side (arrays of words), and not only the spacing differs."""
    touches = F.exists(F.concat(original, replacement), is_number_word)
    flat = lambda ws: strip_zwnj(F.array_join(ws, ""))
    return touches & (flat(original) != flat(replacement))


def is_filler(original: Column, replacement: Column) -> Column:
    both = F.concat(original, replacement)
    return (F.size(both) > 0) & F.forall(both, lambda w: w.isin(*FILLER_WORDS))


def is_style(original: Column, replacement: Column) -> Column:
    """Only spelling, spacing or dialect differs between two arrays of words."""
    a, b = F.array_join(original, " "), F.array_join(replacement, " ")
    paired = lambda x, y, same: (F.size(x) == F.size(y)) & F.forall(F.arrays_zip(x.alias("a"), y.alias("b")), lambda p: same(p["a"], p["b"]))
    wordwise = paired(original, replacement, lambda x, y: words_equivalent(x, y) | (canonical_word(x) == canonical_word(y)))
    joined = paired(join_clitics(original), join_clitics(replacement), lambda x, y: (squash(x) == squash(y)) | words_equivalent(x, y))
    return (squash(a) == squash(b)) | (normalize_lenient(a) == normalize_lenient(b)) | wordwise | joined


def edit_kind(original: Column, replacement: Column) -> Column:
    return F.when(F.size(original) == 0, F.lit("insert")).when(F.size(replacement) == 0, F.lit("delete")).otherwise("substitute")


def hash_fraction(key: Column) -> Column:
    """First eight hex digits of the MD5 over 0xFFFFFFFF: the same number in every engine."""
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") / F.lit(4294967295.0)


def stable_id(*parts: Column) -> Column:
    """16 hex digits of the SHA-1 of the parts."""
    return F.substring(F.sha1(F.concat_ws("\x1f", *(p.cast("string") for p in parts))), 1, 16)


def padded(text: Column) -> Column:
    """Words joined by single spaces, with one at either end."""
    return F.concat(F.lit(" "), F.array_join(words(text), " "), F.lit(" "))


def padded_has(text: Column, span: Column) -> Column:
    """A ``padded`` text has the span's words side by side; false for an empty span."""
    return (F.trim(span) != "") & F.contains(text, padded(span))


def whole_span_in(text: Column, span: Column) -> Column:
    """The span stands in the text between white space or ends."""
    return padded_has(padded(text), span)


def strip(text: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(text, f"^{SPACE}|{SPACE}$", "")


def lenient_span_in(text: Column, span: Column) -> Column:
    """The span's words stand side by side in the text, both in the lenient normal form; false for an empty span."""
    return whole_span_in(normalize_lenient(text), normalize_lenient(span))
