"""Column functions over text; all run inside the JVM."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

MIN_TERM_BYTES, MAX_TERM_BYTES = 3, 64
STOP_WORDS = ("the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "is", "are", "was", "were", "be", "been")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokenize(text: Column | str, stop_words: Iterable[str] = (), min_bytes: int = MIN_TERM_BYTES, max_bytes: int = MAX_TERM_BYTES) -> Column:
    """Lower-case runs of letters or of digits, by length in bytes, without stop words; null for null."""
    stops = sorted(set(stop_words))
    words = F.transform(F.regexp_extract_all(_col(text), F.lit(r"(\p{L}+|\p{N}+)"), 1), F.lower)
    kept = lambda w: F.octet_length(w).between(min_bytes, max_bytes) & (~w.isin(stops) if stops else F.lit(True))
    return F.filter(words, kept)


def fuzzy_distance(a: Column | str, b: Column | str, most: int) -> Column:
    """Edit distance over characters where it is at most ``most``, else null."""
    d = F.levenshtein(_col(a), _col(b), most)
    return F.when((F.abs(F.length(_col(a)) - F.length(_col(b))) <= most) & (d >= 0), d)


def fuzzy_score(distance: Column | str) -> Column:
    return 1.0 / (1.0 + _col(distance))


def snippet(text: Column | str, tokens: Iterable[str], size: int = 100) -> Column:
    """A window of the text around the earliest of the tokens, by characters; null where none occurs."""
    low = F.lower(_col(text))
    places = [F.when(F.instr(low, t) > 0, F.instr(low, t) - 1) for t in tokens]
    if not places:
        return F.lit(None).cast("string")
    at = F.least(*places) if len(places) > 1 else places[0]
    start = F.greatest(at - size // 2, F.lit(0))
    return F.when(at.isNotNull(), F.substring(_col(text), start + 1, F.least(at + size, F.length(_col(text))) - start))


def strip_tags(text: Column | str) -> Column:
    return F.trim(F.regexp_replace(_col(text), "<[^>]*>", ""))


def sanitize(text: Column | str, most_bytes: int = 4096) -> Column:
    """Without control characters other than newline and tab, cut at the first character that reaches ``most_bytes``."""
    clean = F.regexp_replace(_col(text), r"[\p{Cc}&&[^\n\t]]", "")
    cut = F.aggregate(
        F.filter(F.split(F.substring(clean, 1, most_bytes), ""), lambda c: c != ""),
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("chars")),
        lambda s, c: F.when(s["n"] >= most_bytes, s).otherwise(F.struct((s["n"] + F.octet_length(c)).alias("n"), (s["chars"] + 1).alias("chars"))),
        lambda s: s["chars"],
    )
    return F.when(F.octet_length(clean) <= most_bytes, clean).otherwise(F.substring(clean, F.lit(1), cut))


def lossy_text(data: Column | str) -> Column:
    """Bytes as text; sequences that are not UTF-8 become replacement characters."""
    return F.make_valid_utf8(_col(data).cast("string"))


def entry_links(text: Column | str) -> Column:
    """Target of an entry that only points to another headword, else null."""
    found = F.regexp_extract(_col(text), r"^@@@LINK=([^\r\n\x00]*)", 1)
    return F.when(found != "", F.trim(found))
