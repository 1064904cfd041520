"""Text columns: case folding, word tokens, chunking."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tracewell.functions.privacy import bind

PRIVACY_TOKEN = r"<pii_[a-z0-9_]+_v1_[0-9a-f]{32}>"
WORD_RUN = r"[\p{L}\p{N}]+"


@lru_cache(maxsize=1)
def fold_table() -> tuple[str, dict[str, str], dict[str, str]]:
    """(characters whose fold is not their lower case, folds to one character, folds to several).

    Capital sigma counts as special because lower-casing it depends on its place in the word.
    """
    chars = [chr(point) for point in range(sys.maxunicode + 1)]
    folds = {char: char.casefold() for char in chars if char != char.casefold()}
    special = "Σ" + "".join(char for char in chars if char.casefold() != char.lower())
    single = {char: folded for char, folded in folds.items() if len(folded) == 1}
    several = {char: folded for char, folded in folds.items() if len(folded) > 1}
    return special, single, several


def _class_body(chars: str) -> str:
    """The characters as ranges of a pattern class; few ranges are much faster to test than many characters."""
    points = sorted(map(ord, chars))
    known = set(points)
    starts = [p for p in points if p - 1 not in known]
    ends = [p for p in points if p + 1 not in known]
    return "".join(f"\\x{{{first:X}}}-\\x{{{last:X}}}" for first, last in zip(starts, ends, strict=True))


def casefold(col: Column) -> Column:
    """Full Unicode case folding.

    Lower case is the fold of nearly every text once sharp s is spelled out; only texts that hold another
    special character take the table. Texts in Latin-1 letters are cleared by a test of two ranges.
    """
    special, single, several = fold_table()
    pairs = F.arrays_zip(
        F.split(F.lit(",".join(several)), ","), F.split(F.lit(",".join(several.values())), ",")
    )
    expanded = F.aggregate(pairs, col, lambda acc, pair: F.replace(acc, pair["0"], pair["1"]))
    by_table = F.translate(expanded, "".join(single), "".join(single.values()))
    beyond_latin = col.rlike(r"[µ\x{100}-\x{10FFFF}]")
    has_special = col.rlike(f"[{_class_body(special.replace('ß', ''))}]")
    lowered = F.lower(F.replace(col, F.lit("ß"), F.lit(several["ß"])))
    return F.when(beyond_latin & has_special, by_table).otherwise(lowered)


def words(col: Column) -> Column:
    """All words of a folded text in order, whole privacy tokens first; repeats are kept."""

    def split(folded: Column) -> Column:
        plain = F.regexp_extract_all(folded, F.lit(WORD_RUN), F.lit(0))
        tokens = F.regexp_extract_all(folded, F.lit(PRIVACY_TOKEN), F.lit(0))
        rest = F.regexp_extract_all(F.regexp_replace(folded, PRIVACY_TOKEN, " "), F.lit(WORD_RUN), F.lit(0))
        return F.when(folded.contains("<pii_"), F.concat(tokens, rest)).otherwise(plain)

    return bind(col, split)


def word_tokens(col: Column) -> Column:
    """Distinct words of a text, case folded; a privacy token counts as one word."""
    return F.array_distinct(words(casefold(col)))


def shared_words(left: Column, right: Column) -> Column:
    return F.size(F.array_intersect(left, right))


def chunk_fixed(col: Column, size: int = 800, overlap: int = 120) -> Column:
    """``array<string>`` of windows of ``size`` characters, each starting ``size - overlap`` after the last."""
    step = max(1, size - overlap)
    starts = F.sequence(F.lit(0), F.length(col) - 1, F.lit(step))
    return F.when(F.length(col) > 0, F.transform(starts, lambda at: F.substr(col, at + 1, F.lit(size)))).otherwise(
        F.array().cast("array<string>")
    )


SEPARATORS = ("\n\n", "\n", " ", "")


def _pieces(text: str, separators: tuple[str, ...]) -> tuple[list[str], tuple[str, ...]]:
    """Split at the first separator present; each later piece keeps the separator in front of it."""
    for level, separator in enumerate(separators):
        if separator == "":
            return list(text), ()
        if separator in text:
            first, *rest = text.split(separator)
            parts = [first] + [separator + part for part in rest]
            return [part for part in parts if part], separators[level + 1:]
    return [text], ()


def _merged(pieces: list[str], size: int, overlap: int) -> Iterator[str]:
    """Join neighbours up to ``size`` characters and carry at most ``overlap`` of them into the next chunk."""
    window: list[str] = []
    length = 0
    for piece in pieces:
        if window and length + len(piece) > size:
            yield "".join(window)
            while window and (length > overlap or length + len(piece) > size):
                length -= len(window.pop(0))
        window.append(piece)
        length += len(piece)
    if window:
        yield "".join(window)


def split_recursive(
    text: str, size: int = 800, overlap: int = 120, separators: tuple[str, ...] = SEPARATORS
) -> list[str]:
    """Chunks cut at the coarsest separator that keeps them within ``size``; outer white space is removed."""
    pieces, finer = _pieces(text, separators)
    chunks: list[str] = []
    fitting: list[str] = []
    for piece in pieces:
        if len(piece) < size:
            fitting.append(piece)
            continue
        chunks.extend(_merged(fitting, size, overlap))
        fitting = []
        chunks.extend(split_recursive(piece, size, overlap, finer) if finer else [piece])
    chunks.extend(_merged(fitting, size, overlap))
    return [chunk for chunk in (chunk.strip() for chunk in chunks) if chunk]


def chunk_recursive(col: Column, size: int = 800, overlap: int = 120) -> Column:
    """``array<string>`` cut at paragraphs, then lines, then spaces, then characters (Arrow batches)."""

    @F.pandas_udf("array<string>")
    def split_texts(texts: pd.Series) -> pd.Series:
        return texts.map(lambda text: None if text is None else split_recursive(text, size, overlap))

    return split_texts(col)


def chunk_id(request_id: Column, position: Column, text: Column) -> Column:
    """``request-position-hash8``: a replay of the same input gives the same ids."""
    return F.concat_ws("-", request_id, position.cast("string"), F.substring(F.sha2(text, 256), 1, 8))
