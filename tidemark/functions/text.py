"""Text: normal forms, n-grams, phrases, ids, quotes."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words too common to make a phrase by themselves.
FILLER = ("a", "an", "and", "i", "in", "is", "it", "like", "of", "oh", "okay", "so", "that", "the", "to", "uh", "um", "was", "you", "yeah")
_SMALL = "".join(c for c in map(chr, range(0x80, 0x10000)) if len(c.upper()) > 1)
_CAPITAL = "".join("ẞ" if c == "ß" else c.title() if len(c.title()) == 1 else c for c in _SMALL)


def normal(text: Column) -> Column:
    """Lower case; what isn't a letter, digit, underscore, space or apostrophe becomes a space, apostrophes go, spaces collapse."""
    kept = F.regexp_replace(F.lower(text), r"[^\p{L}\p{M}\p{N}_\s']", " ")
    return F.trim(F.regexp_replace(F.replace(kept, F.lit("'"), F.lit("")), r"\s+", " "))


def raised(text: Column) -> Column:
    """Upper case letter by letter, as SQL has it: a letter whose capital is more than one letter takes its single one (ß: ẞ) or stays, so that lower case leads back."""
    of = lambda c: F.when(F.length(F.upper(c)) > 1, F.translate(c, _SMALL, _CAPITAL)).otherwise(F.upper(c))
    return F.array_join(F.transform(F.split(text, ""), of), "")


def lowered(text: Column) -> Column:
    """Lower case letter by letter: a sigma is the same at the end of a word, a dotted capital I is an i."""
    return F.lower(F.translate(text, "Σİ", "σi"))


def folded(text: Column) -> Column:
    """Lower case, white space collapsed and trimmed."""
    return F.trim(F.regexp_replace(lowered(text), r"\s+", " "))


def ngrams(words: Column, low: int, high: int) -> Column:
    """All runs of low to high words, joined by spaces."""
    of = lambda n: F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.array_join(F.slice(words, i, F.lit(n)), " "))).otherwise(F.array().cast("array<string>"))
    return F.concat(*(of(n) for n in range(low, high + 1)))


def is_filler(words: Column, filler: tuple[str, ...] = FILLER) -> Column:
    return F.forall(words, lambda w: w.isin(*filler))


def contains_words(text: Column, phrase: Column) -> Column:
    """Whole words in sequence, not part of a word."""
    return F.contains(F.concat(F.lit(" "), text, F.lit(" ")), F.concat(F.lit(" "), phrase, F.lit(" ")))


def phrase_pattern(phrase: str) -> str:
    """A phrase as a pattern: word boundaries, any case, anything but letters and digits between words, apostrophes optional."""
    words = [r"\s*'?\s*".join(re.escape(c) for c in w.replace("'", "")) for w in phrase.split()]
    return r"(?iU)\b" + r"\W+".join(words) + r"\b"


def phrases_in(text: Column, phrases: tuple[str, ...]) -> Column:
    """Those of the phrases that the text has, each once."""
    return F.array_compact(F.array(*(F.when(F.regexp_like(text, F.lit(phrase_pattern(p))), F.lit(p)) for p in phrases)))


def aligned_words(words: Column) -> Column:
    """Of JSON words with start and end: the centres of those that have both, ascending, how many those are, and how many there are in all."""
    known = F.coalesce(F.from_json(words, "array<struct<start:double,end:double>>"), F.array().cast("array<struct<start:double,end:double>>"))
    centres = F.array_sort(F.transform(F.filter(known, lambda w: w["start"].isNotNull() & w["end"].isNotNull()), lambda w: (w["start"] + w["end"]) / 2))
    return F.struct(centres.alias("centres"), F.size(centres).cast("long").alias("aligned"), F.size(known).cast("long").alias("total"))


def _tail_json(text: str | None) -> str | None:
    found, at = None, (text or "").find("{")
    while at >= 0:
        try:
            _, end = json.JSONDecoder().raw_decode(text, at)
            found = text[at:end]
        except (ValueError, RecursionError):
            end = at + 1
        at = text.find("{", end)
    return found


def tail_json(text: Column) -> Column:
    """The last JSON object in a text that talks around it, with whatever is nested in it; null without any."""

    def last(texts: pd.Series) -> pd.Series:
        return texts.map(_tail_json)

    return F.pandas_udf(last, "string")(text)


def slug(text: Column, limit: int = 40) -> Column:
    whole = F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "_")
    return F.regexp_replace(F.substring(F.regexp_replace(whole, "^_+|_+$", ""), 1, limit), "_+$", "")


def relinked(path: Column, old: str, new: str) -> Column:
    """Paths that begin with old begin with new; others stay."""
    return F.when(F.startswith(path, F.lit(old)), F.concat(F.lit(new), F.substring(path, F.lit(len(old) + 1), F.length(path)))).otherwise(path)


def validated(claims: DataFrame, known: DataFrame, raw_id: str, quote: str) -> DataFrame:
    """Adds why a claim (id and quote) falls: malformed, unknown-id, no-quote, bad-quote, or kept. `known` has known_id and body."""
    c = claims.withColumn("_n", F.col(raw_id).try_cast("long")).join(known, F.col("_n") == F.col("known_id"), "left")
    reason = (
        F.when(F.col("_n").isNull(), "malformed").when(F.col("known_id").isNull(), "unknown-id").when(F.coalesce(F.trim(quote), F.lit("")) == "", "no-quote")
        .when(~F.coalesce(F.contains(folded(F.col("body")), folded(F.col(quote))), F.lit(False)), "bad-quote").otherwise("kept")
    )
    return c.withColumn("reason", reason).drop("_n", "known_id", "body")
