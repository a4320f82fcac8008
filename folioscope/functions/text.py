"""Column helpers for text: tokens, n-grams, normalisation, phrases. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioscope.functions.vocab import (
    NAME_PATTERN, NUMBER_PATTERN, QUOTE_PATTERN, TERM_PATTERN, java_pattern,
)

#: White space as the JVM patterns with Unicode classes see it.
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
TOKEN = r"[\p{L}\p{N}_]+"


def _all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def tokens(text: Column) -> Column:
    """Lower-cased letter/digit runs, in order."""
    return _all(F.lower(text), TOKEN)


def words(text: Column) -> Column:
    """White-space separated words, in order, without empties."""
    return _all(text, java_pattern(r"\S+"))


def strip(text: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.regexp_replace(text, java_pattern(r"\A\s+|\s+\z"), "")


def squeeze(text: Column) -> Column:
    """Runs of white space become one blank."""
    return strip(F.regexp_replace(text, java_pattern(r"\s+"), " "))


def bind(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once per row, also when lambdas refer to it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _ngrams(items: Column, n: int, glue: str) -> Column:
    return bind(items, lambda a: F.when(
        F.size(a) >= n,
        F.array_distinct(F.transform(
            F.sequence(F.lit(1), F.size(a) - (n - 1)),
            lambda i: F.array_join(F.slice(a, i, n), glue),
        )),
    ).otherwise(F.array().cast("array<string>")))


def char_ngrams(text: Column, n: int = 3) -> Column:
    return _ngrams(F.split(F.lower(text), ""), n, "")


def word_ngrams(text: Column, n: int = 3) -> Column:
    return _ngrams(words(F.lower(text)), n, " ")


def sentences(text: Column) -> Column:
    """Sentence texts as cut at runs of . ! ? — empties kept, as the cut leaves them."""
    return F.split(text, "[.!?]+", -1)


def _fold_case(word: Column) -> Column:
    inner_capital = F.substring(word, 2, 2**31 - 1).rlike(r"\p{Lu}")
    return F.when(inner_capital, word).otherwise(F.lower(word))


def normalized_sentences(text: Column) -> Column:
    """Per sentence: other punctuation blanked, words lower-cased unless they hold an inner capital."""
    cleaned = F.regexp_replace(text, java_pattern(r"""[^\w\s.,!?"']"""), " ")
    return F.transform(
        sentences(cleaned),
        lambda s: F.array_join(F.transform(words(s), _fold_case), " "),
    )


def normalize_text(text: Column) -> Column:
    return F.array_join(normalized_sentences(text), " ")


def capital_phrases(text: Column) -> Column:
    return F.array_distinct(_all(text, java_pattern(NAME_PATTERN)))


def key_phrases(text: Column) -> Column:
    """Capitalised phrases, numbers with units, quoted strings and technical terms."""
    numbers = _all(F.lower(text), java_pattern(NUMBER_PATTERN))
    quotes = _all(text, QUOTE_PATTERN, 1)
    terms = _all(text, java_pattern(TERM_PATTERN))
    return F.array_union(F.array_union(F.array_union(capital_phrases(text), numbers), quotes), terms)


def jaccard(a: Column, b: Column) -> Column:
    """|A∩B| / max(|A∪B|, 1) over arrays read as sets."""
    def share(p):
        joint = F.greatest(F.size(F.array_union(p["a"], p["b"])), F.lit(1))
        return F.size(F.array_intersect(p["a"], p["b"])).cast("double") / joint.cast("double")

    return bind(F.struct(a.alias("a"), b.alias("b")), share)


def extension(filename: Column) -> Column:
    return F.lower(F.element_at(F.split(filename, r"\."), -1))
