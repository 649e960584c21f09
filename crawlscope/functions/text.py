"""Text columns. Patterns run in the JVM; `(?U)` and `(?iu)` make them see accented letters as letters."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from crawlscope import constants as C


def literals(values: Iterable) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _accent_table() -> tuple[str, str]:
    """Accented Latin, Greek and Cyrillic letters beside their bare ones, built from Unicode decomposition."""
    accented, bare = [], []
    for code in [*range(0xC0, 0x530), *range(0x1E00, 0x2000)]:
        kept = [c for c in unicodedata.normalize("NFD", chr(code)) if unicodedata.category(c) != "Mn"]
        if len(kept) == 1 and kept[0] != chr(code):
            accented.append(chr(code))
            bare.append(kept[0])
    return "".join(accented), "".join(bare)


_ACCENTED, _BARE = _accent_table()


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(C.WHITESPACE))


def strip_vowel_accents(text: Column) -> Column:
    return F.translate(text, "áéíóú", "aeiou")


def strip_accents(text: Column) -> Column:
    return F.regexp_replace(F.translate(text, _ACCENTED, _BARE), r"\p{Mn}", "")


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def norm_text(text: Column) -> Column:
    return F.nullif(F.lower(collapse(text)), F.lit(""))


def count_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"(?U)\S+"))


def significant_words(text: Column) -> Column:
    """Distinct words of four letters and more, lower case, without vowel accents."""
    runs = F.regexp_extract_all(F.lower(text), F.lit(C.LETTER_RUN), F.lit(0))
    long_runs = F.filter(runs, lambda w: F.length(w) >= C.SIGNIFICANT_WORD_LENGTH)
    return F.array_distinct(F.transform(long_runs, strip_vowel_accents))


def normalize_phone(raw: Column) -> Column:
    digits = F.regexp_replace(raw, r"(?U)\D", "")
    enough = F.length(digits) >= C.PHONE_DIGITS
    return F.when(enough, F.right(digits, F.lit(C.PHONE_DIGITS))).otherwise(F.lit(""))


def extract_phones(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(C.PHONE), F.lit(0))


def csv_safe(text: Column) -> Column:
    """A leading formula character would be run by a spreadsheet; a quote in front disarms it."""
    value = F.coalesce(text, F.lit(""))
    return F.when(value.rlike(r"^[=+\-@]"), F.concat(F.lit("'"), value)).otherwise(value)


def x_robots_directives(header: Column) -> Column:
    parts = F.transform(F.split(F.coalesce(header, F.lit("")), ","), strip)

    def directive(part: Column) -> Column:
        prefix = F.lower(strip(F.substring_index(part, ":", 1)))
        rest = F.lower(strip(F.regexp_replace(part, r"^[^:]*:", "")))
        named_bot = part.contains(":") & prefix.isin(C.BOT_PREFIXES)
        return F.when(named_bot, rest).otherwise(prefix)

    return F.array_distinct(F.transform(F.filter(parts, lambda p: p != ""), directive))


def count_syllables(word: Column) -> Column:
    return F.greatest(F.lit(1), F.regexp_count(word, F.lit(C.READING_VOWELS)))


def flesch_huerta(text: Column) -> Column:
    """Spanish reading ease, one decimal.

    Vowel runs never cross words, so the syllables of a text are its vowel runs plus one for every word
    without a vowel; no list of words is built.
    """
    body = F.coalesce(text, F.lit(""))
    words = F.regexp_count(body, F.lit(C.READING_WORD))
    vowelless = F.regexp_count(
        body, F.lit(r"(?<![a-zA-ZáéíóúñÁÉÍÓÚÑüÜ])[b-df-hj-np-tv-zB-DF-HJ-NP-TV-ZñÑ]+(?![a-zA-ZáéíóúñÁÉÍÓÚÑüÜ])")
    )
    syllables = F.regexp_count(body, F.lit(C.READING_VOWELS)) + vowelless
    sentences = F.regexp_count(body, F.lit(r"(?U)[^.!?¡¿\s][^.!?¡¿]*"))
    n_words, n_sentences = F.greatest(F.lit(1), words), F.greatest(F.lit(1), sentences)
    ease = F.lit(206.84) - 60 * (syllables / n_words) - F.lit(1.02) * (n_words / n_sentences)
    return F.signum(ease) * F.abs(F.bround(ease, 1))  # bround alone turns -0.04 into 0.0, where it is -0.0


def readability_class(score: Column) -> Column:
    return F.when(score >= 60, "green").when(score >= 45, "yellow").when(score.isNotNull(), "red")


def looks_like_question(text: Column, seed: Column) -> Column:
    bare = strip_accents(F.lower(text))
    marked = F.exists(literals(C.QUESTION_MARKERS), lambda m: F.contains(bare, m))
    seed_words = F.filter(F.split(strip_accents(F.lower(seed)), r"(?U)\s+"), lambda w: F.length(w) > 3)
    return marked & ((F.size(seed_words) == 0) | F.exists(seed_words, lambda w: F.contains(bare, w)))


def language_mismatch(text: Column, expected: Column) -> Column:
    """English function words outnumber the Spanish ones on a site declared Spanish."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(C.LETTER_RUN), F.lit(0)))
    spanish = F.size(F.array_intersect(words, literals(C.SPANISH_WORDS)))
    english = F.size(F.array_intersect(words, literals(C.ENGLISH_WORDS)))
    return F.coalesce((expected == "es") & (english > spanish) & (english >= 2), F.lit(False))


def stuck_words(text: Column) -> Column:
    tokens = "|".join(sorted(C.BRAND_TOKENS, key=len, reverse=True))
    return F.regexp_replace(text, rf"(?iuU)\b(?:{tokens})\b", " ").rlike(C.STUCK_WORDS)


def duplicate_brand_suffix(title: Column) -> Column:
    return F.nullif(strip(F.regexp_extract(title, "(?iu)" + C.REPEATED_SUFFIX, 1)), F.lit(""))


def position_bucket(position: Column) -> Column:
    return (
        F.when(position <= 3, "1-3").when(position <= 10, "4-10").when(position <= 20, "11-20")
        .when(position.isNotNull(), "21+")
    )


def is_platform(domain: Column) -> Column:
    names = "|".join(d.replace(".", r"\.") for d in C.PLATFORM_DOMAINS)
    return domain.rlike(rf"^(?:.*\.)?(?:{names})$")


def is_spam_domain(domain: Column) -> Column:
    from crawlscope.functions.urls import top_level_domain

    return top_level_domain(domain).isin(C.SPAM_TLDS)
