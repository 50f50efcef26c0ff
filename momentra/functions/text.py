"""Text columns: normal form, accent folding, tokens, cues, answers. All run inside the JVM.

Word characters are spelled ``\\p{L}\\p{N}_``: the short class is ASCII-only there.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _fold_pairs() -> tuple[str, str]:
    """Latin letters that decompose to a base letter and marks, and their base letters."""
    pairs = {"đ": "d", "Đ": "D"}
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        base = unicodedata.normalize("NFD", chr(code))
        if len(base) > 1 and all(unicodedata.category(c) == "Mn" for c in base[1:]):
            pairs[chr(code)] = base[0]
    return "".join(pairs), "".join(pairs.values())


FOLD_FROM, FOLD_TO = _fold_pairs()


def normalize_text(c: Column) -> Column:
    """Lower case, anything but letters, digits, '_' a space, spaces collapsed and trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_\p{M}\s]", " "), r"\s+", " "))


def fold_diacritics(c: Column) -> Column:
    """Letters without their marks; d with stroke becomes d."""
    return F.regexp_replace(F.translate(c, FOLD_FROM, FOLD_TO), r"\p{Mn}", "")


def tokenize(c: Column) -> Column:
    """The words of the folded normal form, in one pass: folding neither joins nor parts words, so it may come first.

    A text of as many bytes as characters has nothing to fold.
    """
    low = F.lower(c)
    folded = F.when(F.octet_length(low) == F.char_length(low), low).otherwise(fold_diacritics(low))
    return F.array_remove(F.split(folded, r"[^\p{L}\p{N}_\p{M}]+"), "")


def normalize_answer(c: Column) -> Column:
    """Case-folded, spaces collapsed, closing punctuation removed."""
    folded = F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))
    return F.regexp_replace(F.trim(F.regexp_replace(folded, r"\s+", " ")), r"[.,;:!?…\"'”’)\]\s]+$", "")


def sanitize_answer(c: Column, most: int = 100) -> Column:
    """One line, spaces collapsed, cut to ``most`` characters, quoted for CSV where needed."""
    flat = F.left(F.trim(F.regexp_replace(c, r"\s+", " ")), F.lit(most))
    return F.when(flat.rlike("[\",]"), F.concat(F.lit('"'), F.replace(flat, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(flat)


def infer_task(name: Column) -> Column:
    """Task named in a file name; the first of trake, avs, qa, kis that occurs, else kis."""
    low = F.lower(name)
    return F.when(low.contains("trake"), "trake").when(low.contains("avs"), "avs").when(low.contains("qa"), "qa").otherwise("kis")


# Phrases that announce on-screen or spoken text.
OCR_CUES = ("dòng chữ", "chữ", "biển hiệu", "biển báo", "logo", "phụ đề", "tiêu đề", "banner", "text", "caption", "sign", "written")
ASR_CUES = ("nói", "phát biểu", "lời", "giọng", "phỏng vấn", "nhắc đến", "say", "says", "said", "speak", "speech", "interview", "mention")


def has_cue(c: Column, cues: tuple) -> Column:
    """Whether a cue occurs between word boundaries."""
    return F.lower(c).rlike(r"(?<![\p{L}\p{N}_])(" + "|".join(cues) + r")(?![\p{L}\p{N}_])")


def cue_scale(c: Column, cues: tuple, boost: float = 2.0) -> Column:
    return F.when(has_cue(c, cues), F.lit(boost)).otherwise(F.lit(1.0))


def classify_error(message: Column) -> Column:
    """Transient kinds first; any other 4xx is '4xx', the rest 'other'."""
    low = F.lower(message)
    return (
        F.when(low.contains("503") | low.contains("unavailable") | low.contains("overloaded"), "503")
        .when(low.contains("504") | low.contains("deadline"), "504")
        .when(low.contains("429") | low.contains("resource_exhausted") | low.contains("quota"), "429")
        .when(low.contains("timeout") | low.contains("timed out"), "timeout")
        .when(low.rlike(r"\b4\d\d\b"), "4xx")
        .otherwise("other")
    )


def watch_url(url: Column, seconds: Column) -> Column:
    """``url`` with a start time in whole seconds."""
    return F.concat(url, F.when(url.contains("?"), F.lit("&t=")).otherwise(F.lit("?t=")), F.floor(seconds).cast("long").cast("string"), F.lit("s"))


def cache_key(*parts: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 24)


def hash_share(c: Column) -> Column:
    """A number in [0, 1] from the first 32 bits of a SHA-1: deterministic splits."""
    return F.conv(F.substring(F.sha1(c.cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967295.0)


def strip_invisible(c: Column) -> Column:
    return F.regexp_replace(c, r"\p{Cf}", "")
