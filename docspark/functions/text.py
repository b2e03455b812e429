"""Text functions on columns; all but `clean_encoding`, `count_bpe` and `recursive_chunks` are built-ins."""

from __future__ import annotations

import bisect
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKEN = r"[\p{L}\p{N}_]+"
#: Fixed value: the English stop list of the analyzers.
STOP_WORDS = ("a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "from", "has", "in", "is", "it", "of", "on", "or", "that", "the", "to", "was", "were", "will", "with")


def let(value: Column, use) -> Column:
    """use(value), with the value computed once a row however often `use` reads it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def tokens(text: Column, lower: bool = True) -> Column:
    return F.regexp_extract_all(F.lower(text) if lower else text, F.lit(TOKEN), F.lit(0))


def _filled(parts: Column) -> Column:
    """How many of the parts of a text are not blank."""
    return F.size(F.filter(parts, lambda p: p.rlike(r"\S")))


def text_stats(text: Column) -> dict[str, Column]:
    """Characters, words, sentences and paragraphs: pieces that aren't blank, between terminators before blanks or the end, and between
    blank lines. Texts that aren't blank have at least one of each of the last two."""
    some = text.rlike(r"\S")
    floor1 = lambda c: F.when(some, F.greatest(c, F.lit(1))).otherwise(0).cast("long")
    return {
        "char_count": F.length(text).cast("long"),
        "word_count": F.when(some, F.regexp_count(text, F.lit(TOKEN))).otherwise(0).cast("long"),
        "sentence_count": floor1(_filled(F.split(text, r"[.!?]+(?=\s+|$)"))),
        "paragraph_count": floor1(_filled(F.split(text, r"\n\s*\n"))),
    }


#: Type and pattern of each kind that `redact` replaces.
PII = (
    ("EMAIL_ADDRESS", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"),
    ("IP_ADDRESS", r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b"),
    ("PHONE_NUMBER", r"\+[0-9]{1,3} \([0-9]{3}\) [0-9]{3}-[0-9]{4}"),
    ("CREDIT_CARD", r"\b[0-9]{16}\b"),
)


def redact(text: Column, kinds=PII) -> Column:
    for name, pattern in kinds:
        text = F.regexp_replace(text, pattern, f"[{name}]")
    return text


def normalise_alias(text: Column) -> Column:
    """Lower case and single blanks; full Unicode folding is in `fold_alias`."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


@F.pandas_udf(T.StringType())
def fold_alias(text: pd.Series) -> pd.Series:
    import unicodedata

    return text.map(lambda t: None if t is None else " ".join(unicodedata.normalize("NFKC", t).casefold().split()))


@F.pandas_udf(T.StringType())
def clean_encoding(text: pd.Series) -> pd.Series:
    """Undo UTF-8 read as Windows-1252 or Latin-1 where the round trip is exact, and drop control characters."""

    def fix(t: str | None) -> str | None:
        if t is None:
            return None
        if re.search("[ÂÃâ][\u0080-¿‐-™Œ-Ÿ]", t):
            for code in ("cp1252", "latin-1"):
                try:
                    t = t.encode(code).decode("utf-8")
                    break
                except UnicodeError:
                    continue
        return re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "", t).replace("\r\n", "\n").replace("﻿", "")

    return text.map(fix)


#: Frequent words by language.
COMMON = {
    "de": ("der", "die", "und", "das", "nicht", "mit", "den", "von", "zu", "ist", "auf", "dem"),
    "en": ("the", "and", "of", "to", "in", "is", "that", "for", "with", "was", "this", "are"),
    "es": ("el", "los", "que", "del", "las", "por", "con", "una", "para", "como", "su", "es"),
    "fr": ("le", "les", "et", "des", "est", "dans", "pour", "une", "sur", "pas", "qui", "du"),
}


def detect_language(text: Column, default: str | None = None) -> Column:
    """The language with most of its frequent words in the text; `default` for stripped texts under 10 characters or without any."""
    words = tokens(text)
    scores = F.array_sort(F.array(*(F.struct(_hits(words, v).alias("n"), F.lit(k).alias("lang")) for k, v in COMMON.items())))
    best = F.get(scores, F.lit(0))
    return F.when((F.length(F.trim(text)) < 10) | (best["n"] == 0), F.lit(default)).otherwise(best["lang"])


def _hits(words: Column, common: tuple[str, ...]) -> Column:
    return -F.size(F.filter(words, lambda w: w.isin(*common)))


def count_bpe(vocabulary: str):
    """Token counts of a tokenizer file of the `tokenizers` package, as a column function."""

    @F.pandas_udf(T.LongType())
    def count(text: pd.Series) -> pd.Series:
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(vocabulary)
        return pd.Series([len(e.ids) for e in tok.encode_batch([t or "" for t in text], add_special_tokens=False)])

    return count


#: The separators of the splitter, from the strongest; past the last one texts are cut hard.
SEPARATORS = ("\n\n", "\n", ". ", " ")


def _cut(text: str, at: int, size: int, level: int = 0) -> list[tuple[int, int]]:
    """(start, end) of pieces of at most `size` characters that together are the text, which begins at `at`. A piece ends behind the strongest
    separator that its stretch holds; stretches still too long are cut at the next one."""
    if len(text) <= size:
        return [(at, at + len(text))] if text else []
    while level < len(SEPARATORS) and SEPARATORS[level] not in text:
        level += 1
    if level == len(SEPARATORS):
        return [(at + i, min(at + i + size, at + len(text))) for i in range(0, len(text), size)]
    mark, out, start = SEPARATORS[level], [], 0
    while start < len(text):
        found = text.find(mark, start)
        end = len(text) if found < 0 else found + len(mark)
        out += _cut(text[start:end], at + start, size, level + 1)
        start = end
    return out


def _carried(text: str, start: int, end: int, overlap: int) -> int:
    """Where the chunk after text[start:end] begins: behind a separator near the requested overlap, from the strongest, and
    between half and twice of it; exactly there if none lies so."""
    n = end - start
    if overlap <= 0:
        return end
    if overlap >= n:
        return start
    body, target = text[start:end], n - overlap
    first, last = max(0, n - 2 * overlap), n - max(1, overlap // 2)
    for mark in SEPARATORS:
        places = [p + len(mark) for p in range(first, min(last, n)) if body.startswith(mark, p)]
        if places:
            return start + min(places, key=lambda p: abs(p - target))
    return end - overlap


def split_recursive(text: str, size: int, overlap: int = 0) -> list[tuple[int, int]]:
    """(start, end) of chunks: pieces of the separators are packed up to `size` characters, and a chunk begins with about `overlap`
    characters of the one before. Blanks at either end are left out, and so are blank chunks."""
    spans, start, end = [], 0, 0
    for a, b in _cut(text, 0, size):
        if end > start and b - start > size:
            spans.append((start, end))
            start = _carried(text, start, end, overlap)
        end = b
    spans.append((start, end))
    out = []
    for a, b in spans:
        body = text[a:b]
        if body.strip():
            a += len(body) - len(body.lstrip())
            out.append((a, a + len(body.strip())))
    return out


SEPARATOR_LINE = "---"


def metadata_block(fields: list[str]) -> Column:
    """`field: value` lines of a row, in the order given and without nulls, and a line of dashes; empty without any."""
    lines = F.concat_ws("\n", *(F.when(F.col(f).isNotNull(), F.concat(F.lit(f"{f}: "), F.col(f).cast("string"))) for f in fields))
    return F.when(lines == "", "").otherwise(F.concat(lines, F.lit(f"\n{SEPARATOR_LINE}\n")))


def headings(text: str) -> list[tuple[int, str]]:
    return [(m.start(), m.group(2).strip()) for m in re.finditer(r"(?m)^(#{1,6})\s+(.+)$", text)]


def recursive_chunks(size: int = 1000, overlap: int = 0):
    """Column function text -> array of (chunk_index, start, text, section)."""

    @F.pandas_udf("array<struct<chunk_index:int,start:int,text:string,section:string>>")
    def chunk(text: pd.Series) -> pd.Series:
        def one(t: str | None):
            marks = headings(t or "")
            at = [m[0] for m in marks]
            rows = []
            for i, (a, b) in enumerate(split_recursive(t or "", size, overlap)):
                k = bisect.bisect_right(at, a) - 1
                rows.append({"chunk_index": i, "start": a, "text": t[a:b], "section": marks[k][1] if k >= 0 else None})
            return rows

        return text.map(one)

    return chunk


def word_windows(text: Column, size: int, overlap: int) -> Column:
    """Array of windows of `size` tokens that start every size - overlap tokens and end with the text."""

    def cut(w: Column) -> Column:
        n = F.size(w)
        starts = F.when(n > 0, F.sequence(F.lit(0), F.greatest(n - overlap - 1, F.lit(0)), F.lit(size - overlap))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda s: F.array_join(F.slice(w, s + 1, F.lit(size)), " "))

    return let(tokens(text, lower=False), cut)


def trigrams(text: Column) -> Column:
    padded = F.concat(F.lit("  "), text, F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(padded) - 2, F.lit(1))), lambda i: F.substring(padded, i, F.lit(3))))
