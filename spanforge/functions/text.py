"""Scalar text functions as Spark columns.

Offsets and lengths are code points. Texts are taken as NFC; `spanforge.functions.unicode.normalized` makes others so.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: All white space of Unicode, for engines whose \s is ASCII.
SPACE = r"[\t\n\x{0B}\f\r \x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
#: A word is a run of letters, digits and underscores of any script.
WORD = r"[\p{L}\p{N}_]+"
STRENGTH = r"([0-9]+(?:[.,][0-9]+)?)[ \t\n\x{0B}\f\r]*([A-Za-z%µ]+(?:/[A-Za-z0-9.%µ]+)?)"
DOTLESS = r"^[A-Z][0-9]{2}[0-9A-Z]*$"
DOTTED = r"^[A-Z][0-9]{2}\.[0-9A-Z]+$"

# What begins an instruction rather than a title.
NOTE_MARKERS = ("bao gồm", "loại trừ", "incl.", "excl.", "includes", "excludes", "lưu ý", "tham khảo", "ghi chú", "chú ý", "note:")


def _accent_map() -> tuple[str, str]:
    """(accented letters, their base letters): those whose decomposition is one letter and marks."""
    pairs = []
    for point in range(0xC0, 0x1F00):
        rest = [c for c in unicodedata.normalize("NFD", chr(point)) if unicodedata.category(c) != "Mn"]
        if len(rest) == 1 and rest[0] != chr(point):
            pairs.append((chr(point), rest[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


ACCENTED, PLAIN = _accent_map()


def _accent_class() -> str:
    """A regex class of ACCENTED: a class tries its members one by one, so runs are one member, and one range goes first."""
    runs: list[list[int]] = []
    for point in map(ord, ACCENTED):
        if runs and runs[-1][1] == point - 1:
            runs[-1][1] = point
        else:
            runs.append([point, point])
    inner = "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in runs)
    return f"[\\x{{{runs[0][0]:X}}}-\\x{{{runs[-1][1]:X}}}&&[{inner}]]"


MARK = _accent_class()


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def fold(x: Column | str) -> Column:
    return F.replace(F.lower(F.coalesce(col(x), F.lit(""))), F.lit("ß"), F.lit("ss"))


def drop_accents(x: Column | str) -> Column:
    return F.translate(col(x), ACCENTED, PLAIN)


def squeeze(x: Column | str) -> Column:
    return F.trim(F.regexp_replace(col(x), f"{SPACE}+", " "))


def normalize_text(x: Column | str, strip_accents: bool = False) -> Column:
    return squeeze(drop_accents(fold(x)) if strip_accents else fold(x))


def words(x: Column | str) -> Column:
    return F.regexp_extract_all(col(x), F.lit(WORD), F.lit(0))


def tokens(x: Column | str, strip_accents: bool = True) -> Column:
    return words(normalize_text(x, strip_accents))


def let(value: Column, f) -> Column:
    """f(value), with the value made once: an expression inside a lambda is made anew for each element."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def running(values: Column, block: int = 64) -> Column:
    """Struct for upto(): running totals of an array within blocks, and of the blocks; a list that grows is copied each time."""
    grow = lambda acc, x: F.concat(acc, F.array(F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(0).cast("long")) + x))
    none = F.array().cast("array<bigint>")
    parts = lambda v: F.when(F.size(v) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / block).cast("int")), lambda b: F.aggregate(F.slice(v, b * block + 1, block), none, grow)))
    totals = lambda p: F.struct(p.alias("parts"), F.aggregate(p, none, lambda acc, q: grow(acc, F.get(q, F.size(q) - 1))).alias("totals"))
    return let(let(values, parts), totals)


def upto(sums: Column, i: Column, block: int = 64) -> Column:
    """The total of the values up to place i (from 0), of what running() returned."""
    b = F.floor(i / block).cast("int")
    return F.get(F.get(sums["parts"], b), (i % block).cast("int")) + F.coalesce(F.get(sums["totals"], b - 1), F.lit(0))


def char_ngrams(x: Column | str, n: int = 3, strip_accents: bool = True, marked: bool = False) -> Column:
    """Sorted distinct n-grams of the text with two spaces at each side; marked: only those that drop_accents() would change.

    One pass of a regex that looks n code points ahead and goes on by one: substring() counts from the start of the text
    each time, which is quadratic in its length.
    """
    padded = F.concat(F.lit("  "), normalize_text(x, strip_accents), F.lit("  "))
    gram = "|".join("." * k + MARK + "." * (n - 1 - k) for k in range(n)) if marked else "." * n
    return F.sort_array(F.array_distinct(F.regexp_extract_all(padded, F.lit(f"(?s)(?=({gram}))."), F.lit(1))))


def accent_marked(items: Column) -> Column:
    """Those that drop_accents() would change."""
    return F.filter(items, lambda t: t.rlike(MARK))


def form_key(x: Column | str) -> Column:
    return F.array_join(words(fold(x)), " ")


def strip_glyphs(x: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(col(x), F.lit("")), r"^[\s\-+*†‡•·\[\]()]+", ""))


def is_note(x: Column | str) -> Column:
    bare = fold(strip_glyphs(x))
    out = F.lit(False)
    for marker in NOTE_MARKERS:
        out = out | F.startswith(bare, F.lit(marker))
    return out


def is_damaged_title(x: Column | str) -> Column:
    """Empty, an instruction, cut off at a sign, or too short for a title."""
    text = F.trim(F.coalesce(col(x), F.lit("")))
    return (text == "") | is_note(text) | text.rlike(r"[,:(\-+/]$") | (F.length(strip_glyphs(text)) <= 6)


def normalize_unit(x: Column | str) -> Column:
    return F.regexp_replace(fold(x), f"{SPACE}+", "")


def normalize_value(x: Column | str) -> Column:
    """Whole numbers without a point, others with six significant digits and no trailing zeros."""
    text = F.replace(F.trim(col(x)), F.lit(","), F.lit("."))
    number = F.try_cast(text, "double") if hasattr(F, "try_cast") else text.cast("double")
    short = F.format_string("%.6g", number)
    mantissa = F.regexp_replace(F.regexp_replace(short, r"(\.[0-9]*?)0+(e|$)", "$1$2"), r"\.(e|$)", "$1")
    return F.when(number.isNull(), F.lower(text)).when(number == F.floor(number), F.format_string("%.0f", number)).otherwise(mantissa)


def strengths(x: Column | str) -> Column:
    """array<struct<value, unit, raw, key>> of each strength in order."""
    text = F.coalesce(col(x), F.lit(""))
    parts = F.arrays_zip(*[F.regexp_extract_all(text, F.lit(STRENGTH), F.lit(k)).alias(n) for k, n in ((1, "v"), (2, "u"), (0, "r"))])
    return F.transform(parts, lambda p: F.struct(normalize_value(p["v"]).alias("value"), normalize_unit(p["u"]).alias("unit"), F.trim(p["r"]).alias("raw"), F.concat(normalize_value(p["v"]), normalize_unit(p["u"])).alias("key")))


def strength_keys(x: Column | str) -> Column:
    return F.array_distinct(F.transform(strengths(x), lambda s: s["key"]))


def line_id(number: Column | str) -> Column:
    return F.format_string("L%03d", col(number))


def icd_class(code: Column | str) -> Column:
    return F.when(col(code).rlike(DOTTED), "dotted").when(col(code).rlike(DOTLESS), "dotless").otherwise("malformed")


def to_dotted(code: Column | str) -> Column:
    """Null for what is neither form."""
    c = col(code)
    dotless = F.when(F.length(c) > 3, F.concat(F.substring(c, 1, 3), F.lit("."), F.substring(c, 4, 100))).otherwise(c)
    return F.when(icd_class(c) == "dotted", c).when(icd_class(c) == "dotless", dotless)


def to_dotless(code: Column | str) -> Column:
    return F.when(icd_class(code) != "malformed", F.replace(col(code), F.lit("."), F.lit("")))


def checksum(x: Column | str) -> Column:
    return F.sha2(col(x), 256)


def checksum_list(values: Column) -> Column:
    """Of an ordered array, each value closed by a zero byte."""
    return F.sha2(F.concat(F.array_join(values, "\0"), F.lit("\0")), 256)


def is_commit(x: Column | str) -> Column:
    return F.coalesce(col(x).rlike(r"^[0-9a-f]{40}$"), F.lit(False))


def is_digest(x: Column | str) -> Column:
    return F.coalesce(col(x).rlike(r"^sha256:[0-9a-f]{64}$"), F.lit(False))


def is_pinned(x: Column | str) -> Column:
    return is_commit(x) | is_digest(x)


def expected_files(n: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.concat(i.cast("string"), F.lit(".json")))
