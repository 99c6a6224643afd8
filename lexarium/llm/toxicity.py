"""Operator 9: toxicity of documents, read through leetspeak, spacing and repetition.

Noisy-channel deobfuscation. A span whose characters may stand for others
(digits and signs among letters, single letters kept apart, a letter three
times or more) becomes a lattice: every character offers the letters it may
mean, a separator or a repeated letter may also be noise (or the gap between two
words; a letter at either end of such a span may be a word of its own), and each
choice has
a channel probability. Viterbi decoding under a character trigram model finds
the most likely reading. All other text has one reading, itself. The restored
text is scored with a lexicon of words and word beginnings.

The character model is counted over all documents. The lexicon is learned from
at most ``FIT_ROWS`` labelled documents (those with the least hashes of their
ids): a term must occur after many different words in toxic documents and
practically never in clean ones, so that copies of one document, or a rare
word, teach nothing. A word beginning that clean documents have now and then
counts only where two different words of a document begin with it, if that is
practically never so in clean ones.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .store import spread

FIT_ROWS = 10_000
MIN_CONTEXTS = 12
MIN_SPREAD = 0.1
PURITY = 0.98
PAIR_PURITY, MIN_PAIR_DOCS = 0.95, 10
MIN_PREFIX, MAX_PREFIX, MIN_FORMS = 4, 9, 5
THRESHOLD = 2.5

LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t"}
P_LEET, P_SEPARATOR, P_REPEAT, P_LITERAL, P_GAP = math.log(0.3), math.log(0.5), math.log(0.4), math.log(0.05), math.log(0.2)
LEXICON_SHARE = 0.5
_SYMBOLS = 28
_OTHER = 27
_CLASS = np.full(256, _OTHER, np.int64)
for _i in range(26):
    _CLASS[97 + _i] = _i + 1
    _CLASS[65 + _i] = _i + 1
_CLASS[[c for c in range(33) if c in (9, 10, 12, 13, 32)]] = 0
_CLASS[[ord(c) for c in ".,;:?()\"'-_"]] = 0

_WORD_BYTE = np.zeros(256, bool)
_WORD_BYTE[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_LETTER = np.zeros(257, bool)
_LETTER[97:123] = True
_LEET_BYTE = np.zeros(257, bool)
_LEET_BYTE[[ord(c) for c in LEET]] = True
_SIGN_BYTE = (_LETTER | _LEET_BYTE)[:256]

_SIGN = r"a-z0134578@$!|+"
_SPANS = re.compile(
    rf"(?<![{_SIGN}])(?:[{_SIGN}]([ .\-_*]))(?:[{_SIGN}]\1){{2,}}[{_SIGN}](?![{_SIGN}])"  # s p a c e d
    rf"|(?<![{_SIGN}])[{_SIGN}]*[0134578@$!|+]+[a-z][{_SIGN}]*"  # l33t
    r"|[a-z]*([a-z])\2\2[a-z]*"  # repeeeated
)

#: Disguises that ordinary text has as well: their reading counts only if it is a word of the lexicon.
_LOOSE = re.compile(
    rf"(?<![{_SIGN}])(?P<apart>[{_SIGN}](?:[\s.,;:/_*\-]+[{_SIGN}]){{2,}})(?![{_SIGN}])"  # s. c. u. m
    rf"|(?<![{_SIGN}])(?=[{_SIGN}]*[a-z])[a-z]*[0134578@$!|+][{_SIGN}]*"  # idio7, idi000t
    r"|[a-z]*(?:([a-z])\2([a-z])\3)[a-z]*"  # iiddiioott
)
_APART, _AGAIN = re.compile(r"[\s.,;:/_*\-]+"), re.compile(r"([0134578@$!|+])\1+")


def char_counts(docs: DataFrame) -> np.ndarray:
    """Counts of the character trigrams of all texts, by 28 classes: boundary, a to z, other."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(_SYMBOLS**3, np.int64)
        for batch in batches:
            for a, b in K.slices(batch.column(0)):
                raw, offsets = K.text_bytes(batch.column(0).slice(a, b - a))
                c = np.zeros(len(raw) + 2, np.int64)
                c[1:-1] = _CLASS[raw]
                total += np.bincount((c[:-2] * _SYMBOLS + c[1:-1]) * _SYMBOLS + c[2:], minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["i", "n"])

    counts = np.zeros(_SYMBOLS**3)
    for i, n in docs.select("text").mapInArrow(count, "i bigint, n bigint").groupBy("i").agg(F.sum("n")).collect():  # at most 28**3 rows
        counts[i] = n
    return counts


def fit_lexicon(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> dict[str, dict[str, float]]:
    """{"word": {word: weight}, "prefix": {beginning: weight}, "pair": {beginning: weight}}: weights are log odds of toxic against clean use."""
    sample = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    found = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("doc_id", "toxic", F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{M}\p{N}]+)"), 1).alias("w"))
    pairs = found.select("toxic", F.explode(F.transform("w", lambda w, i: F.struct(w.alias("w"), F.when(i > 0, F.get("w", i - 1)).alias("prev")))).alias("x")).filter(F.length("x.w") >= 3)
    words = pairs.groupBy("x.w", "x.prev").agg(F.sum(F.when(F.col("toxic") > 0, 1).otherwise(0)).alias("t"), F.sum(F.when(F.col("toxic") > 0, 0).otherwise(1)).alias("n")).groupBy("w").agg(F.count_if(F.col("t") > 0).alias("ctx"), F.sum("t").alias("t"), F.sum("n").alias("n"))
    forms = words.select("*", F.explode(F.concat(F.array(F.struct(F.lit(0).alias("size"), F.col("w").alias("term"))), F.transform(F.sequence(F.lit(MIN_PREFIX), F.lit(MAX_PREFIX)), lambda k: F.struct(k.alias("size"), F.when(F.length("w") > k, F.substring(F.col("w"), F.lit(1), k)).alias("term"))))).alias("f")).filter("f.term is not null")
    terms = forms.groupBy((F.col("f.size") > 0).alias("prefix"), "f.term").agg(F.sum("ctx").alias("ctx"), F.sum("t").alias("t"), F.sum("n").alias("n"), F.count_if(F.col("ctx") > 0).alias("forms"))
    known = terms.filter((F.col("ctx") >= MIN_CONTEXTS) & (F.col("ctx") >= MIN_SPREAD * F.col("t")) & (~F.col("prefix") | (F.col("forms") >= MIN_FORMS)))
    pure = F.col("t") >= PURITY * (F.col("t") + F.col("n"))
    began = found.select("doc_id", "toxic", F.explode(F.array_distinct("w")).alias("w")).select("doc_id", "toxic", F.explode(F.transform(F.sequence(F.lit(MIN_PREFIX), F.lit(MAX_PREFIX)), lambda k: F.when(F.length("w") > k, F.substring(F.col("w"), F.lit(1), k)))).alias("term"))
    mixed = known.filter(F.col("prefix") & ~pure & (F.col("t") >= F.col("n")))
    twice = began.join(mixed, "term").groupBy("term", "ctx", "doc_id", "toxic").count().filter("count > 1").groupBy("term", "ctx").agg(F.sum(F.when(F.col("toxic") > 0, 1).otherwise(0)).alias("t"), F.sum(F.when(F.col("toxic") > 0, 0).otherwise(1)).alias("n"))
    twice = twice.filter((F.col("t") >= MIN_PAIR_DOCS) & (F.col("t") >= PAIR_PURITY * (F.col("t") + F.col("n"))))
    out: dict[str, dict[str, float]] = {"word": {}, "prefix": {}, "pair": {}}
    kind = F.when(F.col("prefix"), "prefix").otherwise("word").alias("kind")
    rows = known.filter(pure).select(kind, "term", "ctx", "t", "n").union(twice.select(F.lit("pair"), "term", "ctx", "t", "n")).collect()  # bounded by the sample
    longer: dict[tuple[str, str], float] = {}
    for r in rows:
        if r["kind"] != "word" and len(r["term"]) > MIN_PREFIX:
            longer[r["kind"], r["term"][:-1]] = max(longer.get((r["kind"], r["term"][:-1]), 0), r["ctx"])
    for r in rows:
        if longer.get((r["kind"], r["term"]), 0) < 0.95 * r["ctx"]:  # else a longer beginning says as much
            out[r["kind"]].setdefault(r["term"], math.log((r["t"] + 0.5) / (r["n"] + 0.5)))
    return out


class Reader:
    """Reads obfuscated spans: the lattice, the channel and the character model."""

    def __init__(self, counts: np.ndarray, words: list[str]):
        own = np.zeros(_SYMBOLS**3)
        for w in words:
            c = [0, 0, *(_CLASS[b] for b in w.encode()), 0]
            for x, y, z in zip(c, c[1:], c[2:]):
                own[(x * _SYMBOLS + y) * _SYMBOLS + z] += 1
        shape = (_SYMBOLS, _SYMBOLS, _SYMBOLS)
        smooth = lambda c: (c.reshape(shape) + 0.01) / (c.reshape(shape) + 0.01).sum(2, keepdims=True)
        self.logp = np.log((1 - LEXICON_SHARE) * smooth(counts) + LEXICON_SHARE * smooth(own)).tolist()
        self.known: dict[str, str] = {}
        self.words = set(words)

    def read(self, span: str) -> str:
        """The most likely reading of one lower-case span; of equally likely ones the first in order."""
        if span in self.known:
            return self.known[span]
        logp = self.logp
        spaced = len(span) > 2 and span[1] in " .-_*" and not span[1].isalnum()
        # state: last two emitted classes and the last character read
        best: dict[tuple[int, int, str], tuple[float, str]] = {(0, 0, ""): (0.0, "")}
        for ch in span:
            after: dict[tuple[int, int, str], tuple[float, str]] = {}
            options = [(ch, 0.0)] if "a" <= ch <= "z" else [*((x, P_LEET) for x in LEET.get(ch, "")), (ch, P_LITERAL if ch in LEET else 0.0)]
            drop = spaced and ch in " .-_*"
            for (p, q, last), (score, text) in best.items():
                moves = [] if drop else options
                if drop:
                    key, value = (p, q, last), (score + P_SEPARATOR, text)
                    if key not in after or value[0] > after[key][0]:
                        after[key] = value
                    key, value = (q, 0, ch), (score + P_GAP + logp[p][q][0], text + " ")
                    if key not in after or value[0] > after[key][0]:
                        after[key] = value
                if ch == last and "a" <= ch <= "z":
                    key, value = (p, q, last), (score + P_REPEAT, text)
                    if key not in after or value[0] > after[key][0]:
                        after[key] = value
                for x, channel in moves:
                    c = ord(x) - 96 if "a" <= x <= "z" else _OTHER
                    key, value = (q, c, ch), (score + channel + logp[p][q][c], text + x)
                    if key not in after or value[0] > after[key][0]:
                        after[key] = value
            best = after
        _, text = max(((score + logp[p][q][0], text) for (p, q, _), (score, text) in best.items()), key=lambda v: v[0])
        if len(self.known) < 200_000:
            self.known[span] = text
        return text

    def restore(self, text: str) -> tuple[str, int]:
        """(text with every span read, number of spans that changed)."""
        changed = 0

        def one(match: re.Match) -> str:
            nonlocal changed
            span = match.group(0)
            got = self.read(span)
            if match.group(1) and got not in self.words:
                # a letter at either end may be a word of its own, if what is left is a word of the lexicon
                for a, b in ((2, len(span)), (0, len(span) - 2), (2, len(span) - 2)):
                    if b - a > 4 and (inner := self.read(span[a:b])) in self.words:
                        got = f"{span[:a]} {inner} {span[b:]}"
                        break
            changed += got != span
            return got

        def loose(match: re.Match) -> str:
            nonlocal changed
            span = match.group(0)
            signs = _APART.sub("", span)
            n = len(signs)
            cuts = ((0, n), (1, n), (0, n - 1), (1, n - 1)) if match.group("apart") else ((0, n), (0, len(signs.rstrip("!|+$"))))
            for a, b in cuts:
                for signs_ in dict.fromkeys((signs[a:b], _AGAIN.sub(r"\1", signs[a:b]))):
                    if len(signs_) > 2 and (got := self.read(signs_)) in self.words:
                        changed += got != span
                        return " ".join(x for x in (signs[:a], got, signs[b:]) if x)
            return span

        return _SPANS.sub(one, _LOOSE.sub(loose, text)), changed


def _regions(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text) of the byte ranges that hold all spans: signs in a row, or single signs one after another.

    A span has no white space between signs that are not single, so that a
    range can be read apart from the rest. The test never misses a span.
    """
    n = len(raw)
    r = np.full(n + 3, 256, np.int64)
    r[:n] = raw
    letter, leet = _LETTER[r], _LEET_BYTE[r]
    hit = (leet[:n] & letter[1 : n + 1]) | (letter[:n] & leet[1 : n + 1])
    twice = letter[:n] & (r[:n] == r[1 : n + 1])
    hit |= twice & ((r[:n] == r[2 : n + 2]) | (letter[2 : n + 2] & (r[2 : n + 2] == r[3 : n + 3])))
    start, end, first = K.token_spans(raw, offsets, _SIGN_BYTE)
    if not len(start):
        return start, start, start
    owner = K.owners(first)
    at = np.searchsorted(start, np.flatnonzero(hit), "right") - 1
    odd = np.zeros(len(start), bool)
    odd[at] = True
    single = end - start == 1
    odd &= ~single
    new = np.concatenate([[True], (single[1:] != single[:-1]) | (owner[1:] != owner[:-1])])
    begin = np.flatnonzero(new)
    size = np.diff(np.append(begin, len(start)))
    rows = begin[single[begin] & (size > 2)]
    last = rows + size[single[begin] & (size > 2)] - 1
    lone = np.flatnonzero(odd)
    head, tail = np.concatenate([lone, rows]), np.concatenate([lone, last])
    order = np.argsort(head)
    head, tail = head[order], tail[order]
    return start[head], end[tail], owner[head]


class Scorer:
    """score, hits and restored spans of an Arrow array of texts."""

    def __init__(self, lexicon: dict[str, dict[str, float]], counts: np.ndarray):
        self.reader = Reader(counts, [*lexicon["word"], *lexicon["prefix"], *lexicon["pair"]])
        self.seen: dict[bytes, tuple[bytes, int]] = {}
        self.tables: list[tuple[bool, int, np.ndarray, np.ndarray, np.ndarray]] = []
        groups: dict[tuple[bool, int], dict[str, float]] = {(False, 0): lexicon["word"]}
        for kind in ("prefix", "pair"):
            for term, weight in lexicon[kind].items():
                groups.setdefault((kind == "pair", len(term.encode())), {})[term] = weight
        for (pair, size), terms in groups.items():
            if terms:
                hashes = np.array([K.hash_word(t) for t in terms], np.uint64)
                order = np.argsort(hashes)
                coarse = np.zeros(1 << 16, bool)
                coarse[(hashes & np.uint64(0xFFFF)).astype(np.int64)] = True
                self.tables.append((pair, size, hashes[order], np.array([*terms.values()])[order], coarse))

    def __call__(self, column: pa.Array) -> pa.StructArray:
        parts = [self._slice(column.slice(a, b - a)) for a, b in K.slices(column)]
        names = ["score", "hits", "restored"]
        if not parts:
            return pa.StructArray.from_arrays([pa.array([], pa.float64()), pa.array([], pa.int64()), pa.array([], pa.int64())], names)
        return pa.StructArray.from_arrays([pa.array(np.concatenate([p[i] for p in parts])) for i in range(3)], names)

    def _read(self, raw: np.ndarray, offsets: np.ndarray, restored: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes and offsets of the texts with all spans read; counts the spans that changed."""
        data = raw.tobytes()
        pieces, at, last, more = [], [], 0, []
        for start, end, text in zip(*(x.tolist() for x in _regions(raw, offsets))):
            span = data[start:end]
            if span not in self.seen:
                if len(self.seen) >= 200_000:
                    self.seen.clear()
                read, changed = self.reader.restore(span.decode())
                self.seen[span] = (read.encode(), changed)
            read, changed = self.seen[span]
            if changed:
                restored[text] += changed
                pieces += [data[last:start], read]
                at.append(end)
                more.append(len(read) - len(span))
                last = end
        if not at:
            return raw, offsets
        pieces.append(data[last:])
        shift = np.concatenate([[0], np.cumsum(more)])
        return np.frombuffer(b"".join(pieces), np.uint8), offsets + shift[np.searchsorted(np.array(at), offsets, "right")]

    def _slice(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        restored = np.zeros(len(column), np.int64)
        if not self.tables:
            return np.zeros(len(column)), restored, restored
        column = pc.utf8_lower(pc.fill_null(column, ""))
        raw, offsets = K.text_bytes(column)
        raw, offsets = self._read(raw, offsets, restored)
        starts, ends, first = K.token_spans(raw, offsets, _WORD_BYTE)
        sums = K.prefix_sums(K.BYTE_CODE[raw])
        owner, term, weight = [], [], []
        for pair, size, hashes, weights, coarse in self.tables:
            if size:
                own = np.flatnonzero(ends - starts > size)
                h = K.span_hash(sums, starts[own], starts[own] + size)
            else:
                own = np.arange(len(starts))
                h = K.span_hash(sums, starts, ends)
            maybe = np.flatnonzero(coarse[(h & np.uint64(0xFFFF)).astype(np.int64)])
            at = np.minimum(np.searchsorted(hashes, h[maybe]), len(hashes) - 1)
            ok = hashes[at] == h[maybe]
            word, at = own[maybe[ok]], at[ok]
            doc = np.searchsorted(first, word, "right") - 1
            if pair:
                seen = np.stack([doc.astype(np.uint64), hashes[at], K.span_hash(sums, starts[word], ends[word])], 1)
                _, different = np.unique(seen, axis=0, return_index=True) if len(seen) else (None, np.zeros(0, np.int64))
                _, one, count = np.unique(seen[different, :2], axis=0, return_index=True, return_counts=True) if len(seen) else (None, different, different)
                chosen = different[one[count > 1]]
                doc, at = doc[chosen], at[chosen]
            owner.append(doc)
            term.append(hashes[at])
            weight.append(weights[at])
        owner, term, weight = np.concatenate(owner), np.concatenate(term), np.concatenate(weight)
        n = len(column)
        _, distinct = np.unique(np.stack([owner.astype(np.uint64), term], 1), axis=0, return_index=True) if len(owner) else (None, np.zeros(0, np.int64))
        return np.bincount(owner[distinct], weight[distinct], n).astype(float), np.bincount(owner, minlength=n), restored


_RESULT = "struct<score:double,hits:bigint,restored:bigint>"


def scorer_udf(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS):
    """A column function from text to (score, hits, restored), with the models fitted on these tables."""
    lexicon, counts = fit_lexicon(docs, labels, fit_rows), char_counts(docs)

    @F.arrow_udf(_RESULT)
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(lexicon, counts)
        for texts in batches:
            yield scorer(texts)

    return score


def rejected(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, fit_rows: int = FIT_ROWS) -> DataFrame:
    """Rows (doc_id, score, hits, restored, toxic) of the documents rejected as toxic.

    The score sums the weights of the distinct lexicon terms of the restored
    text. Null and empty texts score 0. A null doc_id is kept as null. Rows
    that repeat are judged one by one. Other columns are ignored. Without
    labels the lexicon is empty and nothing is rejected. Empty tables give no rows.
    """
    lexicon, counts = fit_lexicon(docs, labels, fit_rows), char_counts(docs)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(lexicon, counts)
        for batch in batches:
            found = scorer(batch.column(1))
            bad = pa.array(np.asarray(found.field("score")) >= threshold)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(bad), *(found.field(c).filter(bad) for c in ("score", "hits", "restored"))], names=["doc_id", "score", "hits", "restored"])

    scored = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(score, "doc_id bigint, score double, hits bigint, restored bigint")
    return scored.select("doc_id", F.round("score", 6).alias("score"), "hits", "restored", F.lit(True).alias("toxic"))


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, fit_rows: int = FIT_ROWS) -> DataFrame:
    """The documents that :func:`rejected` would not list, with their columns as they are.

    Rows with null or empty texts or a null doc_id stay like any other, rows
    that repeat are judged one by one, and an empty table stays empty.
    """
    score = scorer_udf(docs, labels, fit_rows)
    return docs.filter(score("text")["score"] < threshold)


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    return rejected(spread(spark.read.parquet(f"{sf_dir}/documents.parquet")), spark.read.parquet(f"{sf_dir}/labels.parquet"))
