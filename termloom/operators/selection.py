"""Which language and which caption track of a video to use."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The mark of tracks in a spoken language, and the language when nothing tells.
SPOKEN_MARK, DEFAULT_LANGUAGE = "-orig", "pt"


def _base(code: Column) -> Column:
    return F.lower(F.substring_index(code, "-", 1))


def spoken_codes(automatic: Column) -> Column:
    marked = F.filter(automatic, lambda c: c.endswith(SPOKEN_MARK))
    return F.transform(marked, lambda c: F.regexp_replace(c, f"{SPOKEN_MARK}$", ""))


def original_language(language: Column, automatic: Column) -> Column:
    """The spoken track's code that is the video's language, exactly or by its base, else an empty text."""
    codes = spoken_codes(automatic)
    exact = F.filter(codes, lambda c: F.lower(c) == F.lower(language))
    close = F.filter(codes, lambda c: _base(c) == _base(language))
    found = F.coalesce(F.try_element_at(exact, F.lit(1)), F.try_element_at(close, F.lit(1)), F.lit(""))
    return F.when(F.coalesce(language, F.lit("")) == "", "").otherwise(found)


def caption_language(language: Column, manual: Column, automatic: Column) -> Column:
    """The language to ask for when none is given: the video's own, the only spoken track's, the only manual one's."""
    own = F.coalesce(F.nullif(original_language(language, automatic), F.lit("")), language)
    codes = F.transform(F.concat(manual, automatic), lambda c: F.regexp_replace(c, f"{SPOKEN_MARK}$", ""))
    base = F.substring_index(own, "-", 1)
    only_base = ~F.array_contains(codes, own) & F.exists(codes, lambda c: F.substring_index(c, "-", 1) == base)
    spoken = spoken_codes(automatic)
    guess = F.when(F.size(spoken) == 1, F.element_at(spoken, 1)).when(F.size(manual) == 1, F.element_at(manual, 1)).otherwise(DEFAULT_LANGUAGE)
    return F.when(F.coalesce(language, F.lit("")) == "", guess).when(only_base, base).otherwise(own)


def choose_track(wanted: Column, language: Column, manual: Column, automatic: Column) -> Column:
    """``struct(code, source)`` of a wanted language: the channel's own, the spoken one, a dub's, a translation;
    in each the exact code, else the first regional variant. Null if there is none."""
    own = original_language(language, automatic)
    spoken = spoken_codes(automatic)
    original = F.filter(spoken, lambda c: (own == "") | (c == own))
    dubbed = F.filter(spoken, lambda c: (own != "") & (c != own))
    translated = F.filter(automatic, lambda c: ~c.endswith(SPOKEN_MARK))

    def pick(codes: Column, source: str, mark: str) -> Column:
        variants = F.array_sort(F.filter(codes, lambda c: F.substring_index(c, "-", 1) == wanted))
        code = F.when(F.array_contains(codes, wanted), wanted).otherwise(F.try_element_at(variants, F.lit(1)))
        return F.when(code.isNotNull(), F.struct(F.concat(code, F.lit(mark)).alias("code"), F.lit(source).alias("source")))

    return F.coalesce(pick(manual, "manual", ""), pick(original, "automatic original", SPOKEN_MARK), pick(dubbed, "automatic dubbed", SPOKEN_MARK), pick(translated, "automatic", ""))
