"""Text predicates and rewrites on Columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BULLETS = "•◦‣▪·∗*–—-"
#: Canonical Roman numerals of two letters and more, up to 39.
ROMAN = r"(?:X{1,3}(?:IX|IV|VI{0,3}|I{1,3})|XX{1,2}|I[VX]|VI{1,3}|II{1,2})"
_LABEL = rf"(?:[0-9]{{1,3}}|[A-Z]|{ROMAN})"
#: A section number: up to four parts; one with letters needs a full stop.
NUMBERED = rf"^(?:[0-9]{{1,3}}(?:\.[0-9]{{1,3}}){{0,3}}\.*|(?:{_LABEL}\.){{1,3}}{_LABEL}\.*|{_LABEL}\.+)\s+\p{{L}}"
CAPTION = r"^(?:figure|fig\.|table|algorithm|listing)"
SPACE = r"[\s\p{Z}]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def split_words(text: Column) -> Column:
    """Whitespace-separated words; none of null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def count_words(text: Column) -> Column:
    return F.size(split_words(text))


def normalise_words(text: Column) -> Column:
    """Small letters, without maths and punctuation, as an array of words.

    Compatibility forms are folded by ``quirework.evaluate.metrics.nfkc`` beforehand, where texts have any.
    """
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?s)\$\$.*?\$\$|\$[^$\n]*\$", " ")
    return split_words(F.regexp_replace(F.lower(bare), r"[^\p{L}\p{N}_\s]", " "))


def bigrams(words: Column) -> Column:
    """The distinct pairs of neighbours, each joined by a space."""

    def pairs(w: Column) -> Column:
        n = F.greatest(F.size(w) - 1, F.lit(0))
        return F.array_distinct(F.zip_with(F.slice(w, F.lit(1), n), F.slice(w, F.lit(2), n), lambda a, b: F.concat(a, F.lit(" "), b)))

    return let(words, pairs)


def signature(text: Column) -> Column:
    """Digits as ``#`` per run, no whitespace, small letters: equal for the running heads of a document."""
    return F.lower(F.regexp_replace(F.regexp_replace(text, r"[0-9]+", "#"), SPACE, ""))


#: Letters that are one capital letter by themselves, where ``upper`` gives several.
_SMALL = "ß" + "".join(chr(b + k) for b in (0x1F80, 0x1F90, 0x1FA0) for k in range(8)) + "ᾳῃῳ"
_GREAT = "ẞ" + "".join(chr(b + k) for b in (0x1F88, 0x1F98, 0x1FA8) for k in range(8)) + "ᾼῌῼ"


def capitalise(text: Column) -> Column:
    """With a capital first letter: always one letter, so that those of which ``upper`` makes several stay, or have their own."""
    first = lambda c: F.when(F.length(F.upper(c)) == 1, F.upper(c)).otherwise(F.translate(c, _SMALL, _GREAT))
    return let(text, lambda t: F.concat(first(F.substring(t, 1, 1)), F.substring(t, 2, 2**31 - 1)))


def is_caption(text: Column) -> Column:
    head = F.lower(F.substring(text, 1, 24))
    return head.rlike(CAPTION) & head.rlike("[0-9]")


def list_marker(text: Column) -> Column:
    """True for ordered items, false for bulleted ones, null for others."""
    bullet = text.rlike(rf"^[{BULLETS}][\s\p{{Z}}]")
    starts_with_bullet = text.rlike(rf"^[{BULLETS}]")
    head = F.regexp_extract(text, r"^\s*(\S+)\s+\S", 1)
    core = F.regexp_replace(F.regexp_replace(head, r"^\(+", ""), r"[).:]+$", "")
    ordered = (head != "") & (F.octet_length(head) <= 6) & (core != "") & (core != head) & core.rlike(r"^(?:[0-9]+|[ivxl]+|[A-Za-z])$")
    return F.when(starts_with_bullet, F.when(bullet, F.lit(False))).when(ordered, F.lit(True))


def numbered_heading(text: Column) -> Column:
    return F.coalesce(text.rlike(NUMBERED), F.lit(False))


def numbering_depth(text: Column) -> Column:
    """Parts of the section number, at most 6; null without one."""
    head = F.regexp_replace(F.regexp_extract(text, r"^\s*(\S+)", 1), r"\.+$", "")
    return F.when(numbered_heading(text), F.least(F.lit(6), F.size(F.filter(F.split(head, r"\."), lambda p: p != ""))))


def is_roman(text: Column) -> Column:
    return text.rlike(rf"^{ROMAN}$")


def roman_value(text: Column) -> Column:
    """The value of a numeral of I, V and X; a digit with a larger one after it is subtracted. Null for other texts."""
    digits = F.transform(F.split(text, ""), lambda c: F.when(c == "I", 1).when(c == "V", 5).when(c == "X", 10))
    at = F.sequence(F.lit(1), F.size(digits))
    signed = F.zip_with(digits, at, lambda d, i: F.when(F.coalesce(F.array_max(F.slice(digits, i + 1, F.size(digits))), F.lit(0)) > d, -d).otherwise(d))
    total = F.aggregate(signed, F.lit(0), lambda a, b: a + b)
    return F.when(text.rlike("^[IVX]+$") & (total > 0), total)


def to_roman(value: Column) -> Column:
    tens = F.repeat(F.lit("X"), F.floor(value / 10).cast("int"))
    ones = F.element_at(F.array(*map(F.lit, ("", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX"))), (value % 10 + 1).cast("int"))
    return F.concat(tens, ones)


def is_bibliography_heading(text: Column) -> Column:
    bare = F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\s]", ""))
    return bare.isin("bibliography", "literature cited", "references", "works cited")


def is_table_number(word: Column) -> Column:
    return word.rlike(r"^(?:[0-9]+|[IVXL]+)[.:)]*$")


def opens_table_caption(text: Column) -> Column:
    """``Table 3`` or ``Tab. IV`` at the start of a line."""
    return text.rlike(r"^\s*(?i:tab|table)[.:]*\s+(?:[0-9]+|[IVXL]+)[.:)]*(?:\s|$)")


def strip_marker(text: Column) -> Column:
    """The text of a list item without its bullet, or its first word of at most six bytes."""
    head = F.regexp_extract(text, r"^(\S*)\s", 1)
    short = text.rlike(r"^\S*\s") & (F.octet_length(head) <= 6)
    return F.when(text.rlike(rf"^[{BULLETS}]"), F.regexp_replace(text, rf"^[{BULLETS}]\s*", "")).when(short, F.regexp_replace(text, r"^\S*\s+", "")).otherwise(text)


def escape_markdown(text: Column) -> Column:
    """A backslash before a first sign that Markdown would take for markup."""
    return F.regexp_replace(text, r"^\s*([#>+=|-])", r"\\$1")


def escape_typst(text: Column) -> Column:
    """Backslashes before Typst's signs, but not between dollar signs."""
    pieces = F.split(text, r"\$")
    at = F.sequence(F.lit(0), F.size(pieces) - 1)
    return F.array_join(F.zip_with(pieces, at, lambda p, i: F.when(i % 2 == 0, F.regexp_replace(p, r"([#\[\]*_@\\<>])", r"\\$1")).otherwise(p)), "$")


def expand_ligatures(text: Column) -> Column:
    for sign, letters in (("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬅ", "st"), ("ﬆ", "st")):
        text = F.replace(text, F.lit(sign), F.lit(letters))
    return text


def vocabulary_key(word: Column) -> Column:
    """Small letters of a word of letters and hyphens, null for others."""
    return F.when(word.rlike(r"^[\p{L}-]+$"), F.lower(word))
