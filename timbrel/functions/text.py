"""Scalar functions as Column -> Column, all inside the JVM but for Unicode normal forms and sequence matching."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import likeness
from .likeness import ratio as alike

cloudpickle.register_pickle_by_value(likeness)  # workers need not have this package

#: Marks that end a sentence.
STOPS = ".؟!?۔…:؛"
#: Marks cut off words before a lookup.
EDGES = "،؛:.?!؟"


def words(c: Column) -> Column:
    """Words between Unicode white space; null and blank text have none."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), r"(?U)\s+"), lambda x: x != "")


def word_count(c: Column) -> Column:
    return F.size(words(c))


def ngrams(tokens: Column, n: int = 2) -> Column:
    """Neighbouring tokens joined by a space.

    Built by pairing shifted slices: a lambda that looked into ``tokens`` would work it out anew for each element.
    """
    most = F.greatest(F.size(tokens) - (n - 1), F.lit(0))
    out = F.slice(tokens, 1, most)
    for k in range(1, n):
        out = F.zip_with(out, F.slice(tokens, k + 1, most), lambda a, b: F.concat(a, F.lit(" "), b))
    return out


def first_words(c: Column, n: int) -> Column:
    return F.slice(words(c), 1, n)


def last_words(c: Column, n: int) -> Column:
    w = words(c)
    return F.slice(w, F.greatest(F.size(w) - (n - 1), F.lit(1)), n)


def _among(c: Column, items: Sequence[str]) -> Column:
    return c.isin(*items) if items else F.lit(False)


def starts_with_continuation(c: Column, items: Sequence[str]) -> Column:
    """The first word, or the first two, are listed; text without words counts as a continuation."""
    w = words(c)
    return F.coalesce((F.size(w) == 0) | _among(F.get(w, F.lit(0)), items) | _among(F.array_join(F.slice(w, 1, 2), " "), items), F.lit(False))


def ends_with_continuation(c: Column, items: Sequence[str]) -> Column:
    w = last_words(c, 2)
    return F.coalesce((F.size(w) == 0) | _among(F.element_at(F.when(F.size(w) > 0, w), -1), items) | _among(F.array_join(w, " "), items), F.lit(False))


def ends_with_stop(c: Column) -> Column:
    return F.coalesce(F.trim(c).rlike(f"[{STOPS}]$"), F.lit(False))


def bare_words(c: Column) -> Column:
    """Words without marks at their edges."""
    return F.filter(F.transform(words(c), lambda x: F.btrim(x, F.lit(EDGES))), lambda x: x != "")


def has_payoff(c: Column, items: Sequence[str]) -> Column:
    return F.arrays_overlap(bare_words(c), F.array(*[F.lit(x) for x in items]))


def slug(c: Column) -> Column:
    """Lower-case letters and digits with single hyphens; empty becomes ``untitled``."""
    s = F.regexp_replace(F.lower(F.trim(F.coalesce(c, F.lit("")))), r"[^\p{L}\p{N} _.-]", "")
    s = F.btrim(F.regexp_replace(s, r"[ _.-]+", "-"), F.lit("-"))
    return F.when(s == "", F.lit("untitled")).otherwise(s)


def url_title(url: Column) -> Column:
    """Words of a URL's last path part, without its trailing number or extension."""
    last = F.regexp_extract(url, r"([^/?#]*)/?(?:[?#].*)?$", 1)
    return F.trim(F.regexp_replace(F.regexp_replace(last, r"\.[a-z]+$", ""), r"[-_]+", " "))


def distinct_list(items: Column) -> Column:
    """Trimmed, non-empty, each once, in the order of first occurrence."""
    return F.array_distinct(F.filter(F.transform(F.coalesce(items, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != ""))


def srt_time(ms: Column) -> Column:
    """Milliseconds as HH:MM:SS,mmm; below zero is zero."""
    t = F.greatest(ms, F.lit(0)).cast("long")
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    hours = F.floor(t / 3600000).cast("long")
    h = F.when(hours > 99, hours.cast("string")).otherwise(two(hours))
    return F.concat(h, F.lit(":"), two(F.floor(t / 60000).cast("long") % 60), F.lit(":"), two(F.floor(t / 1000).cast("long") % 60), F.lit(","), F.lpad((t % 1000).cast("string"), 3, "0"))


def srt_ms(text: Column) -> Column:
    """HH:MM:SS,mmm as milliseconds; anything else is 0."""
    part = lambda k: F.regexp_extract(F.coalesce(text, F.lit("")), r"^(\d+):(\d\d):(\d\d)[,.](\d{3})$", k).try_cast("long")
    return F.coalesce(((part(1) * 60 + part(2)) * 60 + part(3)) * 1000 + part(4), F.lit(0))


def ass_time(cs: Column) -> Column:
    """Hundredths of a second as H:MM:SS.cc."""
    t = F.greatest(cs, F.lit(0)).cast("long")
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    return F.concat(F.floor(t / 360000).cast("long").cast("string"), F.lit(":"), two(F.floor(t / 6000).cast("long") % 60), F.lit(":"), two(F.floor(t / 100).cast("long") % 60), F.lit("."), two(t % 100))


def head_tail(c: Column, head: int, tail: int, gap: str = "\n...\n") -> Column:
    """The whole text, or its beginning and end if it is longer than both."""
    return F.when(F.length(c) <= head + tail, c).otherwise(F.concat(F.substring(c, 1, head), F.lit(gap), F.right(c, F.lit(tail))))


def without_terms(c: Column, terms: Sequence[str]) -> Column:
    """Remove listed terms at word boundaries, the longest first, and squeeze white space."""
    for t in sorted(terms, key=lambda x: (-len(x), x)):
        c = F.regexp_replace(c, r"(?iU)\b" + "".join("\\" + ch if ch in r".^$*+?{}[]\|()-" else ch for ch in t) + r"\b", " ")
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def frame_rate(c: Column) -> Column:
    """``a/b`` or a plain number; zero if it is neither, or b is zero."""
    a, b = F.split_part(c, F.lit("/"), F.lit(1)).try_cast("double"), F.split_part(c, F.lit("/"), F.lit(2))
    b = F.when(b == "", F.lit(1.0)).otherwise(b.try_cast("double"))
    return F.coalesce(F.when(b != 0, a / b), F.lit(0.0))


@F.pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


@F.pandas_udf(T.StringType())
def nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")


# Letters that are folded together, and marks that are dropped.
FOLD_FROM, FOLD_TO = "أإآٱىؤئة", "اااايويه"
CAPTION_KEEPS = r"\u0600-\u06FF\u0750-\u077F\u08A0-\u08FF\uFB50-\uFDFF\uFE70-\uFEFF\s0-9٠-٩.,!?:;\"'،؛؟-"
DIACRITICS = r"[\u0610-\u061A\u064B-\u065F\u0670\u06D6-\u06ED]"


def fold_arabic(c: Column) -> Column:
    """One spelling for matching: compatibility form, no diacritics or stretching, folded letters, words only."""
    s = F.regexp_replace(nfkc(F.coalesce(c, F.lit(""))), "\u0640", "")
    s = F.translate(F.regexp_replace(s, DIACRITICS, ""), FOLD_FROM, FOLD_TO)
    return F.trim(F.regexp_replace(F.regexp_replace(s, r"(?U)[^\u0600-\u06FF0-9\s]+", " "), r"(?U)\s+", " "))


def strip_diacritics(c: Column) -> Column:
    return F.regexp_replace(c, DIACRITICS, "")


def render_arabic(c: Column) -> Column:
    """For display: compatibility form, no stretching, single spaces; diacritics stay."""
    return F.trim(F.regexp_replace(F.regexp_replace(nfkc(F.coalesce(c, F.lit(""))), "\u0640", ""), r"(?U)\s+", " "))


def caption_arabic(c: Column) -> Column:
    """For captions: composed form, nothing but Arabic script, white space, digits and common marks."""
    return F.regexp_replace(nfc(F.coalesce(c, F.lit(""))), "(?U)[^" + CAPTION_KEEPS + "]", "")


def caption_words(c: Column, clean: bool = False) -> Column:
    """Words of a caption; a mark that ends a phrase ends a word too."""
    c = caption_arabic(c) if clean else F.coalesce(c, F.lit(""))
    return words(F.regexp_replace(c, "([،,:;؛.!?؟])", "$1 "))


def ends_with_mark(c: Column) -> Column:
    """The refiner's narrower rule of a closed end."""
    t = F.trim(c)
    return F.coalesce(t.endswith(".") | t.endswith("؟") | t.endswith("!") | t.endswith(":") | t.endswith("…"), F.lit(False))


def file_parts(name: Column) -> tuple[Column, Column]:
    """Source and preset of a file name ``source__clipNN__preset.ext``; what isn't there is the whole stem, or empty."""
    stem = F.regexp_replace(F.regexp_extract(name, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")
    parts = F.split(stem, "__")
    return F.split_part(stem, F.lit("__clip"), F.lit(1)), F.when(F.size(parts) >= 3, F.element_at(parts, -1)).otherwise("")


def ass_escape(c: Column) -> Column:
    """Braces escaped, as they open overrides; the soft line break stays."""
    return F.replace(F.replace(c, F.lit("{"), F.lit("\\{")), F.lit("}"), F.lit("\\}"))


def rtl_lines(c: Column) -> Column:
    """Each visible line between right-to-left marks, so that direction doesn't cross a soft line break."""
    parts = F.split(c, r"\\N")
    return F.array_join(F.transform(parts, lambda x: F.when(x != "", F.concat(F.lit("\u202B"), x, F.lit("\u202C"))).otherwise(x)), "\\N")


def revealed(words_: Column, i: Column) -> Column:
    """The first words up to place ``i`` (from 0)."""
    return F.array_join(F.slice(words_, 1, i + 1), " ")


def verse_order(key: Column) -> list[Column]:
    """Order of keys ``a:b`` by their numbers."""
    part = lambda k: F.split_part(key, F.lit(":"), F.lit(k)).try_cast("long")
    return [part(1), part(2), key]


def fold_latin(c: Column) -> Column:
    """Lower case, other than letters and digits to single spaces."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+", " "))


@F.pandas_udf(T.DoubleType())
def char_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity; SQL has no equal of it."""
    return pd.Series([alike(x, y) if x is not None and y is not None else None for x, y in zip(a, b, strict=True)], dtype="float64")
