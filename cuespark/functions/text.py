"""Text functions as Spark column expressions.

White space and word characters are spelled out as Unicode classes, because Java's ``\\s`` and ``\\w`` are
ASCII; the classes below equal Python's for every assigned code point that Java 17 knows.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Character classes.
# Java tests the members of a class in turn, so ASCII letters and marks, which are most, come first.
SPACE = r"[[^!-~]&&[\s\x1c-\x1f\x85\p{Z}]]"
NOT_SPACE = r"[!-~[^\s\x1c-\x1f\x85\p{Z}]]"
NOT_WORD = r"[^\p{L}\p{N}_]"
#: Scripts written without spaces, counted by character: CJK, kana, Hangul, Thai to Lao, Burmese, Khmer to Mongolian, Indic.
NO_SPACE_RANGES = (
    (0x4E00, 0x9FFF), (0x3040, 0x309F), (0x30A0, 0x30FF), (0xAC00, 0xD7AF), (0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x0900, 0x0DFF),
)
_NO_SPACE = "".join(rf"\x{{{a:04x}}}-\x{{{b:04x}}}" for a, b in NO_SPACE_RANGES)
NO_SPACE_SCRIPT = rf"[[^\x00-\x{{08ff}}]&&[{_NO_SPACE}]]"
#: Neither white space nor of those scripts.
SPACED_CHAR = rf"[!-~[^\s\x1c-\x1f\x85\p{{Z}}{_NO_SPACE}]]"
#: Letters of scripts written with spaces: Latin and digits, Cyrillic, Greek, Arabic, Hebrew, Thai.
SPACED_SCRIPT = r"[a-zA-Z0-9'\x{0400}-\x{04ff}\x{0370}-\x{03ff}\x{0600}-\x{06ff}\x{0590}-\x{05ff}\x{0e00}-\x{0e7f}]"
SENTENCE_END = f"[?!.？！。]{SPACE}*\\z"
ASCII_TOKEN = "[A-Za-z0-9]+(?:'[A-Za-z0-9]+)*"


def strip(text: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def not_blank(text: Column) -> Column:
    return F.coalesce(text.rlike(NOT_SPACE), F.lit(False))


def tokens(text: Column) -> Column:
    """Runs of non-space characters, in order."""
    return F.regexp_extract_all(text, F.lit(f"({NOT_SPACE}+)"), F.lit(1))


def compact(text: Column) -> Column:
    """Every run of white space becomes one space, none at the ends."""
    return strip(F.regexp_replace(text, f"{SPACE}+", " "))


def no_space_chars(text: Column) -> Column:
    return F.regexp_count(text, F.lit(NO_SPACE_SCRIPT))


def visible_chars(text: Column) -> Column:
    return F.length(F.regexp_replace(text, SPACE, ""))


def count_words(text: Column) -> Column:
    """Characters of scripts without spaces, plus the words of what remains; 0 for null."""
    mixed, plain = (F.regexp_count(text, F.lit(p)) for p in (f"{SPACED_CHAR}+|{NO_SPACE_SCRIPT}", f"{NOT_SPACE}+"))
    return F.coalesce(F.when(text.rlike(NO_SPACE_SCRIPT), mixed).otherwise(plain), F.lit(0)).cast("int")


def is_mainly_cjk(text: Column, threshold: float = 0.5) -> Column:
    """More than ``threshold`` of the visible characters are of scripts without spaces."""
    total = visible_chars(text)
    return F.coalesce(F.when(total > 0, no_space_chars(text) / total > threshold), F.lit(False))


def is_space_separated(text: Column) -> Column:
    """The stripped text is one word of a script that separates words by spaces."""
    return F.coalesce(strip(text).rlike(f"^{SPACED_SCRIPT}+$"), F.lit(False))


def is_pure_punctuation(text: Column) -> Column:
    """No letter, digit or underscore; true for the empty text."""
    return ~text.rlike(r"[\p{L}\p{N}_]")


def ends_sentence(text: Column) -> Column:
    return F.coalesce(text.rlike(SENTENCE_END), F.lit(False))


def normalize_token(raw: Column) -> Column:
    """First ASCII word, lower-cased; null without one."""
    return F.nullif(F.regexp_extract(F.lower(raw), ASCII_TOKEN, 0), F.lit(""))


def normalize_token_unicode(raw: Column) -> Column:
    """As ``normalize_token`` for letters and digits of any script (an option of ours)."""
    return F.nullif(F.regexp_extract(F.lower(raw), r"[\p{L}\p{N}]+(?:'[\p{L}\p{N}]+)*", 0), F.lit(""))


def token_parts(token: Column) -> Column:
    """``original`` (stripped), ``base`` and ``trailing_punctuation``."""
    whole = strip(token)
    trailing = F.regexp_extract(whole, f"{NOT_WORD}+$", 0)
    return F.struct(whole.alias("original"), F.substring(whole, F.lit(1), F.length(whole) - F.length(trailing)).alias("base"), trailing.alias("trailing_punctuation"))


def token_base(token: Column) -> Column:
    """Lower-cased, without punctuation at the edges; may be empty."""
    return F.lower(F.regexp_replace(token, f"^{NOT_WORD}+|{NOT_WORD}+$", ""))


def text_bases(text: Column) -> Column:
    return F.transform(tokens(text), token_base)


def split_parts(text: Column, mark: str = "<br>") -> Column:
    """Non-blank parts between literal marks, stripped."""
    return F.filter(F.transform(F.split(text, r"\Q" + mark + r"\E"), strip), lambda x: x != "")


def join_parts(parts: Column) -> Column:
    return F.array_join(F.filter(F.transform(parts, strip), lambda x: x != ""), " ")


def first_non_empty(*texts: Column) -> Column:
    """The first text that is neither null nor empty; the last one otherwise."""
    return F.coalesce(*[F.nullif(t, F.lit("")) for t in texts[:-1]], texts[-1])


def unescape_newlines(text: Column) -> Column:
    return F.replace(F.coalesce(text, F.lit("")), F.lit("\\n"), F.lit("\n"))


def safe_name(title: Column) -> Column:
    """A directory name: forbidden characters become ``_``, spaces are compacted, ends lose spaces and dots."""
    cleaned = F.regexp_replace(title, r'[<>:"/\\|?*\x00-\x1f]+', "_")
    return F.regexp_replace(compact(cleaned), r"^[ .]+|[ .]+$", "")
