"""Text decisions as Column expressions: white space, lengths, scripts, whether a segment is worth translating."""

from __future__ import annotations

from functools import cache

import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

# JavaScript's white space, Unicode's White_Space and the patterns of the gate, in Java's spelling.
BLANK = r"\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
WHITE = r"\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
EMAIL = rf"^[^{BLANK}@]+@[^{BLANK}@]+\.[^{BLANK}@]+\z"
URL = rf"(?i)^(?:(?:https?://|ftp://|www\.)[^{BLANK}]+|[a-z0-9](?:[a-z0-9-]*[a-z0-9])?(?:\.[a-z0-9-]+)*\.[a-z]{{2,}}(?:[/?#][^{BLANK}]*)?)\z"
PATH = rf"(?i)^(?:/|\.{{1,2}}/|~/|[a-z]:\\)[^{BLANK}]*\z"
NUMERIC = rf"^[\p{{Nd}}\p{{No}}\p{{Nl}}\p{{Sc}}.,%+\-–—−:/(){WHITE}]+\z"
EXTENSIONS = (
    "js ts jsx tsx mjs cjs json html htm css md txt csv xml yml yaml toml png jpg jpeg gif svg webp ico pdf "
    "zip tar gz rar 7z mp3 mp4 mov wav avi mkv swift py rb go rs c h cpp java sh"
).split()


@cache
def pictographs() -> str:
    """Ranges of Extended_Pictographic for a character class, which neither Java nor RE2 names, plus flags and joiners."""
    of = regex.compile(r"\p{Extended_Pictographic}")
    codes = [c for c in range(0x80, 0x20000) if of.match(chr(c))]
    ranges: list[list[int]] = []
    for c in codes:
        if ranges and ranges[-1][1] == c - 1:
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
    return "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in ranges) + r"\x{1F1E6}-\x{1F1FF}\x{FE0F}\x{200D}"


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, rf"^[{BLANK}]+|[{BLANK}]+\z", "")


def normalized(text: Column) -> Column:
    """White-space runs with a newline become a newline, others a space; the ends are trimmed."""
    # One search tells whether a text has anything to change.
    lines = F.regexp_replace(text, rf"[{BLANK}]*\n[{BLANK}]*", "\n")
    made = trimmed(F.regexp_replace(lines, rf"[{BLANK}&&[^\n]]+", " "))
    return F.when(text.rlike(rf"^[{BLANK}]|[{BLANK}]\z|[{BLANK}]{{2}}|[{BLANK}&&[^ \n]]"), made).otherwise(text)


def utf16_length(text: Column) -> Column:
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def has_letter(text: Column) -> Column:
    return text.rlike(r"\p{L}")


def has_han(text: Column) -> Column:
    return text.rlike(r"\p{IsHan}")


def has_kana_or_hangul(text: Column) -> Column:
    return text.rlike(r"[\p{IsHiragana}\p{IsKatakana}\p{IsHangul}]")


def is_filename(text: Column) -> Column:
    """One token with a known extension after a dot that is neither first nor last."""
    extension = F.lower(F.substring_index(text, ".", -1))
    return ~text.rlike(rf"[{BLANK}]") & F.contains(F.substr(text, F.lit(2)), F.lit(".")) & extension.isin(EXTENSIONS)


def gate_text(text: Column) -> Column:
    """What the gate looks at: text (in NFC) without zero-width spaces and soft hyphens, trimmed."""
    return trimmed(F.regexp_replace(text, r"[\x{200B}\x{AD}]", ""))


def skip_reason(t: Column, page_is_target: Column) -> Column:
    """Why a text, prepared by gate_text(), isn't worth translating; null if it is. The first reason that holds counts."""
    shell, body = rf"[{pictographs()}]", rf"^[{pictographs()}{WHITE}\p{{P}}\p{{S}}]*\z"
    token = ~t.rlike(rf"[{BLANK}]")
    letters = F.length(F.regexp_replace(t, r"[^\p{L}]", ""))
    # Plain prose, by far most texts, needs none of the other tests: it has two letters and a blank, so only its language can tell.
    prose = t.rlike(r"[A-Za-z]{2}") & F.contains(t, F.lit(" ")) & (~page_is_target | ~has_han(t))
    return (
        F.when(prose, None)
        .when(t.rlike(rf"^[{WHITE}]*\z"), "whitespace")
        .when(~has_letter(t) & t.rlike(shell) & t.rlike(body), "emoji")
        .when(t.rlike(rf"^[\p{{P}}\p{{S}}{WHITE}]+\z") & ~t.rlike(r"[\p{L}\p{N}]"), "punct")
        .when(t.rlike(NUMERIC) & t.rlike(r"[\p{Nd}\p{No}\p{Nl}]") & ~has_letter(t), "numeric")
        .when(token & t.rlike(EMAIL), "email")
        .when(token & t.rlike(URL), "url")
        .when(token & t.rlike(PATH), "path")
        .when(is_filename(t), "filename")
        .when(page_is_target & has_han(t) & ~has_kana_or_hangul(t), "already-target")
        .when(~has_han(t) & (letters < 2), "min-length")
    )
