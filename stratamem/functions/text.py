"""Text functions as column expressions: tokens, stop words, compression, density, sentiment, chunks, slugs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from stratamem.functions import stemmers
from stratamem.functions.words import ENGLISH_SAFE, ENGLISH_STOP, ITALIAN_SAFE, ITALIAN_STOP, PROTECTED

TOKEN = r"[\p{L}0-9_]+"


def _array(words) -> Column:
    return F.array(*map(F.lit, sorted(words)))


def tokens(text: str | Column) -> Column:
    """Lower-case runs of letters, digits and underscores."""
    c = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.lower(c), F.lit(TOKEN), 0)


def without_stop_words(words: Column, language: str) -> Column:
    stop = {"english": ENGLISH_STOP, "italian": ITALIAN_STOP}[language]
    return F.filter(words, lambda w: ~w.isin(*sorted(stop)))


def stem(language: str):
    """A pandas UDF that stems a column of single words; meant for a distinct vocabulary."""
    one = {"english": stemmers.english, "italian": stemmers.italian}[language]

    @pandas_udf(T.StringType())
    def run(words: pd.Series) -> pd.Series:
        return words.map(one, na_action="ignore")

    return run


def compress(text: str | Column, language: str = "english") -> Column:
    """The words of a text without those safe to drop; negations and logical words stay, case stays, punctuation but ' and - goes."""
    c = F.col(text) if isinstance(text, str) else text
    drop = ({"italian": ITALIAN_SAFE, "it": ITALIAN_SAFE}.get(language, ENGLISH_SAFE)) - PROTECTED
    return F.array_join(F.filter(F.regexp_extract_all(c, F.lit(r"[\p{L}\p{N}'-]+"), 0), lambda w: ~F.lower(w).isin(*sorted(drop))), " ")


def compression_ratio(original: Column, compressed: Column) -> Column:
    """The share of white-space separated words that compression saved; 0 for a text without words."""
    count = lambda c: F.size(F.regexp_extract_all(c, F.lit(r"\S+"), 0))
    return F.when(count(original) == 0, F.lit(0.0)).otherwise((count(original) - count(compressed)) / count(original))


def density(text: str | Column) -> Column:
    """Distinct tokens over tokens; 0 without tokens."""
    t = tokens(text)
    return F.when(F.size(t) <= 0, F.lit(0.0)).otherwise(F.size(F.array_distinct(t)) / F.size(t))


def sentiment(text: str | Column, positive: list[str], negative: list[str]) -> Column:
    """Positive roots that the text contains minus the negative ones, each counted once."""
    c = F.lower(F.col(text) if isinstance(text, str) else text)
    out = F.lit(0)
    for word, sign in [*((w, 1) for w in positive), *((w, -1) for w in negative)]:
        out = out + F.when(c.contains(word), sign).otherwise(0)
    return out


def token_estimate(text: str | Column) -> Column:
    """A quarter of the bytes, rounded down."""
    return F.floor(F.octet_length(F.col(text) if isinstance(text, str) else text) / 4).cast("int")


def slug(name: str | Column) -> Column:
    """`entity:` and the name in lower snake case, without quotes."""
    c = F.col(name) if isinstance(name, str) else name
    return F.concat(F.lit("entity:"), F.regexp_replace(F.regexp_replace(F.trim(F.lower(c)), "[\"']", ""), " ", "_"))


def tags(text: str | Column) -> Column:
    """A comma-separated list as trimmed, non-empty tags."""
    c = F.col(text) if isinstance(text, str) else text
    return F.filter(F.transform(F.split(c, ","), F.trim), lambda x: x != "")


def fill_template(template: str, **values: Column) -> Column:
    """A template's ``{{name}}`` replaced by columns; unknown names stay."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{{" + name + "}}"), F.coalesce(value.cast("string"), F.lit("")))
    return out


def basename(path: str | Column) -> Column:
    return F.substring_index(F.col(path) if isinstance(path, str) else path, "/", -1)


def ellipsis(text: Column, length: int) -> Column:
    return F.when(F.length(text) > length, F.concat(F.substring(text, 1, length), F.lit("..."))).otherwise(text)


def fixed_chunks(text: str | Column, size: int, overlap: int = 0) -> Column:
    """Windows of ``size`` characters, each starting size - overlap after the last. Impossible sizes give the whole text, an empty text nothing."""
    c = F.col(text) if isinstance(text, str) else text
    if size <= 0 or overlap < 0 or overlap >= size:
        return F.when(F.length(c) > 0, F.array(c)).otherwise(F.array().cast("array<string>"))
    starts = F.sequence(F.lit(0), F.length(c) - 1, F.lit(size - overlap))
    return F.when(F.length(c) > 0, F.transform(starts, lambda i: F.substring(c, i + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


SEPARATORS = {
    "recursive": ["\n\n", "\n", " ", ""],
    "markdown": ["\n# ", "\n## ", "\n### ", "\n\n", "\n", " ", ""],
    "code": ["\nclass ", "\nfunc ", "\ndef ", "\n\n", "\n", " ", ""],
}


def split_recursively(text: str, size: int, overlap: int, separators: list[str]) -> list[str]:
    """Pieces of at most ``size`` characters, cut at the first separator that helps, each starting with a tail of the one before.

    A text is cut at the first separator that it holds; pieces that are still
    too long are cut at the next ones. Neighbouring pieces are put together
    while they fit; up to ``overlap`` characters of whole pieces are repeated.
    """
    if len(text) <= size:
        return [text] if text else []
    at = next((i for i, s in enumerate(separators) if s == "" or s in text), len(separators))
    if at == len(separators) or separators[at] == "":
        step = max(1, size - overlap)
        return [text[i : i + size] for i in range(0, max(1, len(text) - overlap), step)]
    mark, rest = separators[at], separators[at + 1 :]
    out: list[str] = []
    held: list[str] = []

    def close() -> None:
        if held:
            out.append(mark.join(held))

    for part in text.split(mark):
        if not part:
            continue
        if len(part) > size:
            close()
            held = []
            out += split_recursively(part, size, overlap, rest or [""])
            continue
        if held and len(mark.join([*held, part])) > size:
            close()
            while held and (len(mark.join(held)) > overlap or len(mark.join([*held, part])) > size):
                held.pop(0)
        held.append(part)
    close()
    return out


def recursive_chunks(size: int, overlap: int = 0, kind: str | list[str] = "recursive"):
    """A pandas UDF that splits texts; ``kind`` names separators or lists them."""
    separators = SEPARATORS[kind] if isinstance(kind, str) else [*kind, ""]
    overlap = overlap if 0 <= overlap < size else 0

    @pandas_udf(T.ArrayType(T.StringType()))
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield texts.map(lambda t: split_recursively(t, size, overlap, separators), na_action="ignore")

    return run
