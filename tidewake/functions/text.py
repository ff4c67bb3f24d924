"""Row-wise text and URL expressions. All are built-in functions, so they stay inside generated code."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewake.functions import fixed_values as fixed

WORD = r"[\p{L}\p{N}_]"


def lit_array(values) -> Column:
    return F.array(*map(F.lit, values))


def lit_map(values: dict) -> Column:
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))


def netloc(url: Column) -> Column:
    """What stands between ``scheme://`` and the path, port and user included; empty if there is none."""
    return F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][\w+.\-]*://([^/?#]*)", 1), F.lit(""))


def url_path(url: Column) -> Column:
    """The path without its closing slashes."""
    return F.rtrim(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][\w+.\-]*://[^/?#]*([^?#]*)", 1), F.lit("")), F.lit("/"))


def _bare(url: Column) -> Column:
    return F.regexp_replace(F.lower(netloc(url)), r"^www\.", "")


def domain_of_feed(url: Column, source: Column, feeds: tuple[str, ...] = fixed.FEEDS) -> Column:
    """The publisher's domain for rows of article feeds if it is longer than 3, else the source."""
    return F.when(source.isin(*feeds) & (F.length(_bare(url)) > 3), _bare(url)).otherwise(source)


def domain_or_unknown(url: Column, source: Column, feeds: tuple[str, ...] = fixed.FEEDS) -> Column:
    return F.when(source.isin(*feeds), F.coalesce(F.nullif(_bare(url), F.lit("")), F.lit("unknown"))).otherwise(source)


def domain_at_least(url: Column, length: int) -> Column:
    """The domain of any source, null if it is shorter than ``length``."""
    return F.when(F.length(_bare(url)) >= length, _bare(url))


def domain_for_credibility(url: Column) -> Column:
    """The authority, or what stands before the first slash; ``www.`` goes before lower-casing."""
    bare = F.coalesce(F.nullif(netloc(url), F.lit("")), F.split(F.coalesce(url, F.lit("")), "/")[0])
    return F.lower(F.regexp_replace(bare, r"^www\.", ""))


def domain_or_source(url: Column, source: Column) -> Column:
    return F.when(F.length(_bare(url)) > 3, _bare(url)).otherwise(F.lower(source))


def title_tokens(title: Column) -> Column:
    """Distinct words of over two characters without stop words."""
    found = F.regexp_extract_all(F.lower(F.coalesce(title, F.lit(""))), F.lit(rf"({WORD}[\p{{L}}\p{{N}}_'\-]+)"), 1)
    return F.array_except(F.array_distinct(F.filter(found, lambda t: F.length(t) > 2)), lit_array(fixed.TITLE_STOPWORDS))


def normal_title(title: Column) -> Column:
    """The title up to the first separator found, in the order of the list."""
    out = F.trim(title)
    for sep in reversed(fixed.TITLE_SEPARATORS):
        out = F.when(F.instr(title, sep) > 0, F.trim(F.substring_index(title, sep, 1))).otherwise(out)
    return out


def bag_tokens(title: Column) -> Column:
    found = F.regexp_extract_all(F.lower(F.coalesce(normal_title(title), F.lit(""))), F.lit(rf"({WORD}+)"), 1)
    return F.array_distinct(F.filter(found, lambda t: F.length(t) >= 2))


@F.pandas_udf(T.StringType())
def unescape(s: pd.Series) -> pd.Series:
    """Character references need the whole table of names: the one place here that leaves the JVM, for rows that hold an ``&``."""
    return s.map(html.unescape, na_action="ignore")


def fix_mojibake(s: Column) -> Column:
    """Text that was read as Latin-1 is read again as UTF-8 (wrong bytes become U+FFFD), if it shows the signs and fits Latin-1.

    References must be unescaped before.
    """
    marked = F.lit(False)
    for m in fixed.MOJIBAKE_MARKERS:
        marked = marked | F.contains(s, F.lit(m))
    fits = ~s.rlike(r"[^\x00-\xFF]")
    return F.when(marked & fits, F.make_valid_utf8(F.encode(F.when(fits, s).otherwise(""), "ISO-8859-1").cast("string"))).otherwise(s)


def printable_share(s: Column) -> Column:
    return F.try_divide(F.length(F.regexp_replace(s, r"[\p{C}\p{Zl}\p{Zp}]", "")), F.length(s))


def is_printable(s: Column) -> Column:
    return F.coalesce(printable_share(s) > 0.85, F.lit(False))


def theme_code_share(s: Column) -> Column:
    """Theme codes by words; no words count as all codes."""
    words = F.regexp_count(s, F.lit(rf"{WORD}+"))
    return F.when(words == 0, 1.0).otherwise(F.regexp_count(s, F.lit(r"\b[A-Z]+_[A-Z_0-9]+\b")) / words)


def reject_reason(title: Column, content: Column, url: Column) -> Column:
    """Why a record isn't content, in the order of the tests; null if it is."""
    left = F.lower(F.regexp_replace(F.concat_ws(" ", title, content), r"\b[A-Z]+_[A-Z_0-9]+\b", " "))
    words = F.array_except(F.array_distinct(F.filter(F.regexp_extract_all(left, F.lit(rf"({WORD}+)"), 1), lambda w: F.length(w) > 1)), lit_array(fixed.THIN_STOPWORDS))
    empty = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    return F.when(empty(url), "missing_url").when(empty(title), "empty_title").when(theme_code_share(title) > 0.30, "title_is_theme_codes").when(F.size(words) < 4, "thin_content")


def page_title(extras: Column, tag: str = "PAGE_TITLE") -> Column:
    return F.trim(F.regexp_extract(F.coalesce(extras, F.lit("")), rf"(?is)<{tag}>(.*?)</{tag}>", 1))


def language_of_url(url: Column, translated: Column) -> Column:
    """``translated`` wins; else by top-level domain; unknown elsewhere."""
    tld = F.regexp_extract(F.regexp_replace(F.lower(netloc(url)), r":[0-9]*$", ""), r"\.([a-z]+)$", 1)
    return F.when(translated, "translated").otherwise(F.coalesce(F.try_element_at(lit_map(fixed.TLD_LANGUAGE), tld), F.lit("unknown")))


def language_code(name: Column) -> Column:
    short = F.when(F.coalesce(name, F.lit("")) == "", "en").otherwise(F.substring(F.lower(name), 1, 2))
    return F.coalesce(F.try_element_at(lit_map(fixed.LANGUAGE_CODES), name), short)


def is_noise_title(title: Column) -> Column:
    t = F.coalesce(title, F.lit(""))
    return (F.length(t) < 20) | t.rlike("(?i)" + fixed.NOISE_TITLE)


def label_tokens(tokens: Column) -> Column:
    bad = "[" + "".join(fixed.MOJIBAKE_CHARS) + "]"
    low = F.transform(tokens, F.lower)
    return F.filter(low, lambda t: (F.length(t) >= 3) & ~F.array_contains(lit_array(fixed.LABEL_STOPWORDS), t) & ~t.rlike(bad) & ~t.rlike(fixed.TAXONOMY_CODE))


def is_domain_name(s: Column) -> Column:
    return F.trim(s).rlike(r"^[a-zA-Z0-9]([a-zA-Z0-9\-]*[a-zA-Z0-9])?(\.[a-zA-Z]{2,})+$")


def title_reject(title: Column) -> Column:
    """Why a title can't be a label; null if it can."""
    t = F.coalesce(title, F.lit(""))
    return F.when(F.length(t) < 15, "short").when(F.startswith(t, F.lit("http")), "url").when(is_domain_name(t), "domain").when(F.lower(t).rlike(r"\.(html|htm|php)$"), "file").when(F.length(F.trim(F.substring_index(t, " | ", 1))) < 10, "short_head")


def theme_name(theme: Column) -> Column:
    bare = F.regexp_replace(theme, "^(Soc |Econ |Ungp |Crisislex )", "")
    return F.coalesce(F.try_element_at(lit_map(fixed.THEME_NAMES), theme), bare)


def name_list(field: Column) -> Column:
    """Lower-case names of a ``;`` list: over two characters, no ``#``."""
    parts = F.transform(F.split(F.coalesce(field, F.lit("")), ";"), lambda x: F.lower(F.trim(x)))
    return F.array_distinct(F.filter(parts, lambda x: (F.length(x) > 2) & ~F.contains(x, F.lit("#"))))


def theme_list(field: Column) -> Column:
    parts = F.transform(F.split(F.coalesce(field, F.lit("")), ";"), lambda x: F.lower(F.trim(x)))
    return F.array_distinct(F.filter(parts, lambda x: x != ""))


def parse_tone(s: Column) -> Column:
    """The first six comma fields as a struct of doubles; null with fewer fields or a field that is no number."""
    parts = F.split(F.coalesce(s, F.lit("")), ",")
    names = ("tone", "positive", "negative", "polarity", "activity_density", "self_reference")
    numbers = [F.try_element_at(parts, F.lit(k + 1)).try_cast("double") for k in range(6)]
    good = F.size(parts) >= 6
    for x in numbers:
        good = good & x.isNotNull()
    return F.when(good, F.struct(*(x.alias(n) for x, n in zip(numbers, names))))


def relevance(text: Column) -> Column:
    """At least 30 characters and one strong phrase or two different weaker words."""
    low = F.lower(F.coalesce(text, F.lit("")))
    strong = low.rlike("|".join(w.replace("-", r"\-") for w in fixed.SIGNAL_PHRASES))
    weak = sum((F.contains(low, F.lit(w)).cast("int") for w in fixed.SIGNAL_WORDS), F.lit(0))
    return (F.length(text) >= 30) & (strong | (weak >= 2))


def high_signal(themes: Column, polarity: Column, density: Column) -> Column:
    return F.coalesce(F.arrays_overlap(themes, lit_array(fixed.HIGH_SIGNAL_THEMES)), F.lit(False)) | F.coalesce((polarity > 5) & (density > 3), F.lit(False))


def truncated(s: Column, most: int = 80) -> Column:
    return F.when(F.length(s) > most, F.concat(F.substring(s, 1, most - 3), F.lit("…"))).otherwise(s)


def python_title_case(s: Column) -> Column:
    """A capital after anything that isn't a letter, small letters elsewhere."""
    spaced = F.regexp_replace(F.lower(s), r"([^\p{L}]+)", "\u0001$1\u0001")
    return F.concat_ws("", F.transform(F.split(spaced, "\u0001"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1_000_000))))
