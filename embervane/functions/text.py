"""Text functions on Columns: normalisation, pre-tokenisation, display and chunking, all inside the JVM."""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import InvalidInput
from .binding import let

#: Regular expression classes; the same text is valid for Java and for RE2.
WHITE = r"\x{09}-\x{0D}\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
BLANK = r"\x{09}\x{0A}\x{0D}\x{20}\x{A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}"
CONTROL = r"\x{00}-\x{08}\x{0B}\x{0C}\x{0E}-\x{1F}\x{7F}-\x{9F}\x{200B}-\x{200D}\x{FEFF}\x{FFFD}"
IDEOGRAPH = r"\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{20000}-\x{2A6DF}\x{2A700}-\x{2B73F}\x{2B740}-\x{2B81F}\x{2B820}-\x{2CEAF}\x{F900}-\x{FAFF}\x{2F800}-\x{2FA1F}"
PUNCTUATION = (
    r"\x{21}-\x{2F}\x{3A}-\x{40}\x{5B}-\x{60}\x{7B}-\x{7E}\x{2010}-\x{2015}\x{2018}-\x{201F}\x{2020}-\x{2027}\x{2030}-\x{203E}"
    r"\x{3001}\x{3002}\x{3008}-\x{3011}\x{3014}-\x{301B}\x{FF01}-\x{FF0F}\x{FF1A}\x{FF1B}\x{FF1F}\x{FF20}\x{FF3B}\x{FF3D}\x{FF5B}\x{FF5D}"
)
TRIM = rf"^[{WHITE}]+|[{WHITE}]+\z"
TOKEN = rf"[{PUNCTUATION}]|[^{PUNCTUATION}{WHITE}]+"
#: The same for texts without a sign from U+0300 on, signs one by one: Java tests such a class by one look into a bitmap.
_LATIN_MARKS = "".join(rf"\x{{{c:X}}}" for a, b in ((0x21, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7E)) for c in range(a, b + 1))
LATIN_TOKEN = rf"[{_LATIN_MARKS}]|[^{_LATIN_MARKS}\x{{9}}\x{{A}}\x{{D}}\x{{20}}\x{{A0}}]+"
_LATIN_CONTROL = r"[\x{00}-\x{08}\x{0B}\x{0C}\x{0E}-\x{1F}\x{7F}-\x{9F}]"
_BEYOND_ASCII, _BEYOND_LATIN = r"[^\x{00}-\x{7F}]", r"[^\x{00}-\x{2FF}]"
#: Combining marks that accent stripping drops.
MARKS = ((0x0300, 0x036F), (0x1AB0, 0x1AFF), (0x1DC0, 0x1DFF), (0x20D0, 0x20FF), (0xFE20, 0xFE2F))

_WHITE_SIGNS = "".join(chr(c) for a, b in ((0x09, 0x0D), (0x20, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)) for c in range(a, b + 1))

CHUNK_SIZE, CHUNK_OVERLAP = 1500, 200


def trim_white(text: Column) -> Column:
    """Unicode white space off both ends. A pattern would be tried at every sign in between."""
    return F.btrim(text, F.lit(_WHITE_SIGNS))


def char_prefix(text: Column, n: int) -> Column:
    """The first ``n`` code points."""
    return F.substring(text, 1, n) if n > 0 else F.when(text.isNotNull(), F.lit(""))


def truncate_display(text: Column, n: int) -> Column:
    """At most ``n`` code points, and dots if there were more."""
    return F.when(F.char_length(text) <= n, text).otherwise(F.concat(char_prefix(text, n), F.lit("...")))


def clean_text(text: Column) -> Column:
    """Control signs dropped, white space made a blank."""
    return F.regexp_replace(F.regexp_replace(text, f"[{CONTROL}]", ""), f"[{BLANK}]", " ")


def space_ideographs(text: Column) -> Column:
    """A blank on either side of each CJK ideograph."""
    return F.regexp_replace(text, f"([{IDEOGRAPH}])", " $1 ")


def is_mark(code: int) -> bool:
    return any(a <= code <= b for a, b in MARKS)


def strip_accents_str(text: str) -> str:
    """Canonical decomposition without the marks; the plain form of ``strip_accents``."""
    return "".join(c for c in unicodedata.normalize("NFD", text) if not is_mark(ord(c)))


@cache
def _decompositions() -> tuple[str, str, dict[str, str], str]:
    """(signs that become one, what they become, signs that become several or leave the basic plane, class of those and Hangul)."""
    kept, single, several = [], [], {}
    for code in [*range(0x80, 0xAC00), *range(0xD7A4, 0xD800), *range(0xE000, sys.maxunicode + 1)]:
        plain = strip_accents_str(chr(code))
        if plain == chr(code):
            continue
        if len(plain) == 1 and code < 0x10000 and ord(plain) < 0x10000:
            kept.append(chr(code))
            single.append(plain)
        elif plain:
            several[chr(code)] = plain
    gone = "".join(chr(c) for a, b in MARKS for c in range(a, b + 1))
    codes = {ord(c) for c in several}
    begins, ends = sorted(c for c in codes if c - 1 not in codes), sorted(c for c in codes if c + 1 not in codes)
    spans = "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in zip(begins, ends))
    return "".join(kept) + gone, "".join(single), several, spans + r"\x{AC00}-\x{D7A3}"


def _strings(values: list[str]) -> Column:
    """A constant array from one literal."""
    return F.split(F.lit("\x01".join(values)), "\x01")


def _jamo(sign: Column) -> Column:
    """A Hangul syllable's two or three letters, by arithmetic on its code."""
    parts = [[chr(0x1100 + i) for i in range(19)], [chr(0x1161 + i) for i in range(21)], ["", *[chr(0x11A8 + i) for i in range(27)]]]
    lead, vowel, tail = map(_strings, parts)
    code = F.ascii(sign) - 0xAC00
    places = (F.floor(code / 588), F.floor(code % 588 / 28), code % 28)
    return F.concat(*[F.element_at(p, i.cast("int") + 1) for p, i in zip((lead, vowel, tail), places)])


def strip_accents(text: Column) -> Column:
    """Letters without their accents, not composed again.

    One-range tests come first: plain ASCII passes as it is, and the long class is tried only beyond the combining marks.
    """
    source, target, several, members = _decompositions()
    known = F.map_from_arrays(_strings(list(several)), _strings(list(several.values())))

    def sign(c: Column) -> Column:
        return F.when((c >= "\uac00") & (c <= "\ud7a3"), _jamo(c)).otherwise(F.coalesce(F.try_element_at(known, c), c))

    def plain(x: Column) -> Column:
        moved = F.translate(x, source, target)
        slow = x.rlike(r"[\x{340}-\x{10FFFF}]") & x.rlike(f"[{members}]")
        parts = F.transform(F.regexp_extract_all(moved, F.lit("(?s)."), F.lit(0)), sign)
        return F.when(~x.rlike(r"[^\x00-\x7F]"), x).when(slow, F.array_join(parts, "")).otherwise(moved)

    return let(text, plain)


def pre_tokenize(text: Column, do_lower_case: bool = True) -> Column:
    """array<string>: cleaned words, each punctuation sign and ideograph on its own.

    Texts in Latin letters, where no ideograph, no combining mark and no punctuation but ASCII's can be, take fewer and cheaper
    passes; plain ASCII doesn't look for accents. The result is that of the general way.
    """
    clean = space_ideographs(clean_text(text))
    latin = F.regexp_replace(text, _LATIN_CONTROL, "")
    if do_lower_case:
        source, target, _, _ = _decompositions()
        clean = strip_accents(F.lower(clean))
        latin = F.when(text.rlike(_BEYOND_ASCII), F.translate(F.lower(latin), source, target)).otherwise(F.lower(latin))
    general = F.regexp_extract_all(clean, F.lit(TOKEN), F.lit(0))
    return F.when(text.rlike(_BEYOND_LATIN), general).otherwise(F.regexp_extract_all(latin, F.lit(LATIN_TOKEN), F.lit(0)))


def chunk_array(text: Column, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> Column:
    """array<string>: overlapping pieces of at most ``size`` code points, trimmed, blank ones dropped; null for null."""
    if size < 0 or overlap < 0:
        raise InvalidInput("size and overlap can't be negative")
    if size == 0:
        return F.when(text.isNotNull(), F.array().cast("array<string>"))
    step = max(size - overlap, 1)

    def pieces(body: Column) -> Column:
        last = F.ceil((F.char_length(body) - size) / step).cast("int")
        parts = F.transform(F.sequence(F.lit(0), last), lambda w: trim_white(F.substring(body, w * step + 1, F.lit(size))))
        return (
            F.when(body == "", F.array().cast("array<string>"))
            .when(F.char_length(body) <= size, F.array(body))
            .when(body.isNotNull(), F.filter(parts, lambda p: p != ""))
        )

    return let(trim_white(text), pieces)
