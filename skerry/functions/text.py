"""Text functions as SQL expressions over Spark's built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
CJK = r"\x{3400}-\x{9fff}\x{f900}-\x{faff}\x{3040}-\x{30ff}\x{ac00}-\x{d7a3}"
SPACE = r"\t\n\x0b\x0c\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WORD = r"[\p{L}\p{N}_]+"
# Words after the Unicode word rules: letters may hold an inner stop or apostrophe, digits an inner stop or comma.
_A, _L, _N, _M1, _M2 = r"[\p{L}\p{M}\p{N}_]", r"[\p{L}\p{M}]", r"\p{N}", r"[.:'’·]", r"[.,;'’]"
TERM = rf"(?:{_A}*(?:{_L}(?:{_M1}{_L})+|{_N}(?:{_M2}{_N})+))+{_A}*|{_A}+"
# The same words without going back over them; for engines with look-around.
_FAST = rf"{_A}++(?:(?:(?<={_L}){_M1}(?={_L})|(?<={_N}){_M2}(?={_N})){_A}++)*+"
SEPARATORS = r"[/\\._\-]+"


def clean_text(c: Column) -> Column:
    return F.regexp_replace(c, CONTROL, "")


def textual(c: Column) -> Column:
    """Whether a cleaned page reads as text: half of it letters, digits or blanks, and if long, not without blanks."""
    n = F.length(c)
    kept = n - F.length(F.regexp_replace(c, rf"[\p{{L}}\p{{N}}{SPACE}]++", ""))
    cjk = n - F.length(F.regexp_replace(c, f"[{CJK}]++", ""))
    blanks = n - F.length(F.regexp_replace(c, f"[{SPACE}]++", ""))
    return (n > 0) & (kept * 2 >= n) & ~((n >= 200) & (cjk * 5 < n) & (blanks * 100 < n * 3))


def words(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(WORD), F.lit(0))


def bigrams(run: Column) -> Column:
    return F.when(F.length(run) == 1, F.array(run)).otherwise(F.transform(F.sequence(F.lit(1), F.length(run) - 1), lambda i: run.substr(i, F.lit(2))))


def terms(c: Column) -> Column:
    """Index terms before stemming: words of scripts with blanks, pairs of characters of the others."""
    latin = F.regexp_extract_all(F.lower(F.regexp_replace(c, f"[{CJK}]+", " ")), F.lit(_FAST), F.lit(0))
    runs = F.regexp_extract_all(c, F.lit(f"[{CJK}]+"), F.lit(0))
    return F.concat(latin, F.flatten(F.transform(runs, bigrams)))


# Words that the English analyzer leaves out.
ENGLISH_STOPS = (
    "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with"
).split()


def analyzed(c: Column, language: str) -> Column:
    """Terms by the rules of a language, before stemming: ``en`` leaves out possessives and stop words and parts
    Chinese, Japanese and Korean characters; all others are ``terms``."""
    if language != "en":
        return terms(c)
    latin = F.regexp_extract_all(F.lower(F.regexp_replace(c, f"[{CJK}]+", " ")), F.lit(_FAST), F.lit(0))
    latin = F.transform(latin, lambda t: F.regexp_replace(t, "['’]s$", ""))
    single = F.regexp_extract_all(c, F.lit(f"[{CJK}]"), F.lit(0))
    return F.concat(F.filter(latin, lambda t: (t != "") & ~t.isin(ENGLISH_STOPS)), single)


def stemmed(language: str) -> bool:
    """Whether a language's analyzer stems: English, and the mixed ones (``en+zh``, ``multi``, ``cjk``)."""
    return language == "en" or "+" in language or language in ("multi", "cjk")


def basename(c: Column) -> Column:
    return F.substring_index(c, "/", -1)


def spaced(c: Column) -> Column:
    """A path or file name as words."""
    return F.trim(F.regexp_replace(c, SEPARATORS, " "))


def extension(c: Column) -> Column:
    """In small letters; null without one, as for dot files."""
    return F.lower(F.nullif(F.regexp_extract(basename(c), r"^.+\.([^.]+)$", 1), F.lit("")))


def stem_name(c: Column) -> Column:
    return F.regexp_replace(basename(c), r"^(.+)\.[^.]*$", "$1")


def name_tokens(c: Column) -> Column:
    split = F.regexp_replace(c, "([a-z0-9])([A-Z])", "$1 $2")
    return F.transform(F.filter(F.regexp_extract_all(split, F.lit("[A-Za-z0-9]+"), F.lit(0)), lambda t: F.length(t) > 1), F.lower)


def parent_of(c: Column) -> Column:
    return F.when(c == "", None).otherwise(F.regexp_replace(c, r"/?[^/]*$", ""))


def snippet(c: Column, size: int = 240) -> Column:
    return F.substring(c, 1, size)


def without_front_matter(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)\A---\n.*?\n---\n", "")


def match_snippet(text: Column, query: Column, size: int = 240, before: int = 60) -> Column:
    """The part of a text about the first word of the query that it holds, else its head; blanks collapsed."""
    low = F.lower(text)
    at = F.coalesce(F.get(F.filter(F.transform(words(query), lambda w: F.position(w, low)), lambda p: p > 0), F.lit(0)), F.lit(1))
    return F.trim(F.regexp_replace(text.substr(F.greatest(F.lit(1), at - before), F.lit(size)), f"[{SPACE}]+", " "))


def highlight(text: Column, query: Column) -> Column:
    """Marks the words of the query, if longer than one character, in any case."""
    pats = F.transform(F.filter(F.regexp_extract_all(query, F.lit(r"\S+"), F.lit(0)), lambda w: F.length(w) > 1), lambda w: F.regexp_replace(w, r"([\\^$.|?*+()\[\]{}])", r"\\$1"))
    return F.when(F.size(pats) > 0, F.regexp_replace(text, F.concat(F.lit("(?i)("), F.array_join(pats, "|"), F.lit(")")), F.lit("<mark>$1</mark>"))).otherwise(text)


def content_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def cache_key(model: Column, text: Column) -> Column:
    return F.sha1(F.concat(model, F.lit("\x00"), text))


def depth_first_key(path: Column) -> Column:
    """Sorts the files of a folder before its subfolders, level by level."""
    parts = F.split(path, "/")
    return F.array_join(F.transform(parts, lambda p, i: F.concat(F.when(i == F.size(parts) - 1, "0").otherwise("1"), p)), "\x01")
