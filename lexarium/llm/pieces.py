"""Operator 6: SentencePiece encoding and decoding as a relational lattice.

Texts fall into units no piece crosses: they are cut wherever two characters
meet that no piece has side by side. Only distinct units are encoded:
their substrings of bounded length are exploded and joined to the piece table,
the edges found are grouped by unit, and one fold (Spark's ``aggregate`` over
arrays) picks the segmentation. For a unigram model the fold is Viterbi over
piece scores. For a BPE model the path of greatest score is not what
SentencePiece returns, so the fold merges over the lattice instead: at each
step the best edge that joins two neighbouring symbols. Boundaries are bits of
a long, so units of more than ``MAX_FOLD`` characters are merged with a heap in
an Arrow function, with the same result. The edges are folded in the order of
their pieces; only where an edge may be wanted again after its turn, all edges
are looked at in each step.

The units of a scan partition are numbered as they first occur in it and sent
once each, in blocks, to buckets of their hashes. The codes go back to the
partition by number (:mod:`.parts`); a second scan numbers the units again and
gathers their codes. No text is shuffled.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from . import parts
from .store import spread

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MAX_FOLD = 62
FOLD_UNITS = 100_000
BUCKETS_A_PARTITION = 4
DECODE_ROWS = 500
_SPACE = "▁"


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            byte = data[at]
            at += 1
            out |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return out

    while at < len(data):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(tag & 7) or varint()
            yield tag >> 3, data[at : at + size]
            at += size


class Model:
    """Pieces of a model file: text, score, kind (1 normal, 2 unknown, 3 control, 6 byte), and the algorithm."""

    def __init__(self, path: str = MODEL):
        with open(path, "rb") as f:
            message = list(_fields(f.read()))
        self.pieces: list[tuple[str, float, int]] = []
        self.bpe, self.prefix = False, True
        for number, value in message:
            if number == 1:
                piece = dict(_fields(value))
                score = float(np.frombuffer(piece[2], "<f4")[0]) if 2 in piece else 0.0
                self.pieces.append((piece[1].decode(), score, piece.get(3, 1)))
            elif number == 2:
                self.bpe = dict(_fields(value)).get(3, 1) == 2
            elif number == 3:
                spec = dict(_fields(value))
                if spec.get(1, b"identity") != b"identity" or spec.get(4, 1):
                    raise ValueError("only models that keep texts as they are")
                self.prefix = bool(spec.get(3, 1))
        self._index()

    @classmethod
    def of(cls, pieces: list[tuple[str, float]], bpe: bool) -> Model:
        """A model of these pieces with bytes, for tests."""
        self = cls.__new__(cls)
        self.pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), *((f"<0x{i:02X}>", 0.0, 6) for i in range(256)), *((p, s, 1) for p, s in pieces)]
        self.bpe, self.prefix = bpe, True
        self._index()
        return self

    def _index(self) -> None:
        self.ids = {p: i for i, (p, _, kind) in enumerate(self.pieces) if kind == 1}
        self.longest = max(map(len, self.ids), default=1)
        order = sorted(self.ids.values(), key=lambda i: (-self.pieces[i][1], i))
        self.rank = {i: r for r, i in enumerate(order)}
        self.byte = {int(p[1:-1], 16): i for i, (p, _, kind) in enumerate(self.pieces) if kind == 6}
        if len(self.byte) < 256:
            raise ValueError("only models with byte pieces")
        chars = sorted({c for p in self.ids for c in p})
        self.place = np.zeros(0x110000, np.uint16)  # 0 for characters of no piece
        self.place[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.place[32] = self.place[ord(_SPACE)]
        self.meet = np.zeros((len(chars) + 1, len(chars) + 1), bool)
        for p in self.ids:
            at = self.place[[ord(c) for c in p]]
            self.meet[at[:-1], at[1:]] = True

    def table(self, spark: SparkSession) -> DataFrame:
        """Rows (piece, rank), and the empty piece at -1, which every unit has."""
        return spark.createDataFrame(pa.table({"piece": ["", *self.ids], "rank": pa.array([-1, *(self.rank[i] for i in self.ids.values())], pa.int64())}))

    def fallback(self, char: str) -> list[int]:
        return [self.byte[b] for b in char.encode()]

    def merge(self, unit: str) -> list[int]:
        """Codes of one unit (spaces written as the space mark) by merging with a heap."""
        text, right, left = list(unit), list(range(1, len(unit) + 1)), list(range(-1, len(unit) - 1))
        heap: list[tuple[int, int, str]] = []

        def offer(i: int) -> None:
            j = right[i]
            if 0 <= i and j < len(text) and (k := self.ids.get(text[i] + text[j])) is not None:
                heapq.heappush(heap, (self.rank[k], i, text[i] + text[j]))

        for i in range(len(text) - 1):
            offer(i)
        while heap:
            _, i, joined = heapq.heappop(heap)
            j = right[i] if text[i] else len(text)
            if j >= len(text) or text[i] + text[j] != joined:
                continue
            text[i], text[j] = joined, ""
            right[i] = right[j]
            if right[i] < len(text):
                left[right[i]] = i
            offer(i)
            if left[i] >= 0:
                offer(left[i])
        return [c for t in text if t for c in ([self.ids[t]] if t in self.ids else self.fallback(t))]

    def best_path(self, unit: str) -> list[int]:
        """Codes of one unit by Viterbi, as the fold has them."""
        worst = min((s for _, s, kind in self.pieces if kind == 1), default=0.0) - 10
        best: list[tuple[float, int, int | None]] = [(0.0, -1, None)]
        for e in range(1, len(unit) + 1):
            top = (-np.inf, -1, None)
            for s in range(max(0, e - self.longest), e):
                k = self.ids.get(unit[s:e])
                if k is None and e - s > 1:
                    continue
                score = best[s][0] + (self.pieces[k][1] if k is not None else worst)
                if score > top[0]:
                    top = (score, s, k)
            best.append(top)
        out, at = [], len(unit)
        while at:
            _, s, k = best[at]
            out.append([k] if k is not None else self.fallback(unit[s:at]))
            at = s
        return [c for x in reversed(out) for c in x]


def units(column: pa.Array, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, ends, first) of the units of each text, where a space stands for the space mark too."""
    column = pc.replace_substring(pc.fill_null(column, ""), _SPACE, " ")
    if model.prefix:
        column = pc.if_else(pc.equal(column, ""), "", pc.binary_join_element_wise(" ", column, ""))
    raw, offsets = K.text_bytes(column)
    at = np.flatnonzero((raw & 0xC0) != 0x80)
    place = model.place[np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32)]
    cut = np.ones(len(at), bool)
    cut[1:] = ~model.meet[place[:-1], place[1:]]
    begin = np.zeros(len(raw) + 1, bool)
    begin[at[cut]] = True
    begin[offsets] = True
    starts = np.flatnonzero(begin[:-1])
    return raw, starts, np.append(starts[1:], len(raw)), np.searchsorted(starts, offsets)


class _Numbers:
    """Units of a partition, numbered as they first occur."""

    def __init__(self) -> None:
        self.hashes, self.number, self.count = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0

    def add(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of each unit, places of the new ones in the order of their numbers)."""
        u, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.searchsorted(self.hashes, u)
        known = np.zeros(len(u), bool)
        inside = at < len(self.hashes)
        known[inside] = self.hashes[at[inside]] == u[inside]
        number = np.empty(len(u), np.int64)
        number[known] = self.number[at[known]]
        new = np.flatnonzero(~known)
        order = new[np.argsort(first[new])]
        number[order] = self.count + np.arange(len(order))
        self.count += len(order)
        self.hashes, self.number = np.insert(self.hashes, at[new], u[new]), np.insert(self.number, at[new], number[new])
        return number[back], first[order]


_SENT = "part bigint, source int, n int, numbers binary, units array<string>"


def _cut(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    size = ends - starts
    take = np.repeat(starts - np.cumsum(size) + size, size) + np.arange(size.sum())
    return pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(size)]).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(raw[take]))])


def _hashes(column: pa.Array) -> np.ndarray:
    raw, offsets = K.text_bytes(column)
    return K.span_hash(K.prefix_sums(K.BYTE_CODE[raw]), offsets[:-1], offsets[1:])


def _send(model: Model, buckets: int):
    """The distinct units of a scan partition, a row for each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, keys, found = _Numbers(), [], []
        for batch in batches:
            for a, b in K.slices(batch.column(0)):
                raw, starts, ends, _ = units(batch.column(0).slice(a, b - a), model)
                h = K.span_hash(K.prefix_sums(K.BYTE_CODE[raw]), starts, ends)
                _, new = seen.add(h)
                if len(new):
                    keys.append(h[new])
                    found.append(_cut(raw, starts[new], ends[new]))
        if not keys:
            return
        bucket = ((np.concatenate(keys) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        begin = np.flatnonzero(np.concatenate([[True], np.diff(bucket[order]) > 0]))
        ends = np.append(begin[1:], len(order))
        words = pa.concat_arrays(found).take(pa.array(order)).cast(pa.string())
        numbers = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(np.concatenate([begin, ends[-1:]]).astype(np.int32) * 4), pa.py_buffer(order.astype(np.uint32))])
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([begin, ends[-1:]]).astype(np.int32)), words)
        k = len(begin)
        yield pa.RecordBatch.from_arrays([pa.array(bucket[order][begin]), pa.array(np.full(k, TaskContext.get().partitionId(), np.int32)), pa.array((ends - begin).astype(np.int32)), numbers, lists], names=["part", "source", "n", "numbers", "units"])

    return run


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, unit) of blocks that come by bucket; a unit comes once from every bucket of a task."""
    bucket, seen = -1, np.zeros(0, np.uint64)
    for batch in batches:
        of = np.asarray(batch.column("part"), np.int64)
        begin = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if len(of) else []
        for a, b in zip(begin, np.append(begin[1:], len(of))):
            if of[a] != bucket:
                bucket, seen = int(of[a]), np.zeros(0, np.uint64)
            words = batch.column("units").slice(a, b - a).flatten()
            h, at = np.unique(_hashes(words), return_index=True)
            new = ~np.isin(h, seen, assume_unique=True)
            seen = np.union1d(seen, h)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(int(new.sum()), bucket)), words.take(pa.array(at[new]))], names=["bucket", "unit"])


#: Bits 0 to size are the boundaries; each step clears the one inside the best edge over two symbols.
_LATE = "shiftleft(1L, 63)"
_S, _E = "cast(shiftright(x, 8) & 255 as int)", "cast(x & 255 as int)"
_ENDS = f"(shiftleft(1L, {_S}) | shiftleft(1L, {_E}))"
_INNER = f"((shiftleft(1L, {_E}) - 1) & ~(shiftleft(1L, {_S} + 1) - 1))"
_PASS = f"""aggregate(edges, shiftleft(1L, size + 1) - 1, (m, x) ->
  if((m & {_ENDS}) = {_ENDS}, if(bit_count(m & {_INNER}) = 1, m & ~{_INNER}, m | {_LATE}), m))"""
_MERGE = f"""aggregate(sequence(1, size), shiftleft(1L, size + 1) - 1, (m, i) ->
  aggregate(slice(filter(edges, x -> (m & {_ENDS}) = {_ENDS} and bit_count(m & {_INNER}) = 1), 1, 1), m, (n, x) -> n & ~{_INNER}))"""
#: For each boundary the best score of a path to it and where its last edge starts; edges come by end, then start.
_VITERBI = """aggregate(edges,
  transform(sequence(0, size), i -> struct(if(i = 0, 0D, double('-infinity')) as score, -1 as s)),
  (p, x) -> transform(p, (c, i) -> if(i = {e} and get(p, {s}).score + get(scores, {r}) > c.score, struct(get(p, {s}).score + get(scores, {r}) as score, {s} as s), c)),
  p -> aggregate(sequence(1, size), struct(size as at, shiftleft(1L, size) as m), (b, i) ->
    if(b.at <= 0, b, struct(get(p, b.at).s as at, b.m | shiftleft(1L, greatest(get(p, b.at).s, 0)) as m)), b -> b.m))""".format(
    e="cast(shiftright(x, 40) as int)", s="cast(shiftright(x, 32) & 255 as int)", r="cast(x & 4294967295 as int)"
)


def encode_units(found: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """Rows (unit, codes) and the columns ``keep`` of distinct units, which should be partitioned by unit."""
    spark = found.sparkSession
    pieces = F.broadcast(model.table(spark))  # its size is that of the model
    sized = found.withColumn("marked", F.replace("unit", F.lit(" "), F.lit(_SPACE))).withColumn("size", F.length("marked"))
    # edges of one character cannot be merged, so only a unigram model needs them
    least = 2 if model.bpe else 1
    begun = sized.filter(F.col("size") <= MAX_FOLD).select("unit", *keep, "size", "marked", F.explode(F.expr("sequence(0, size - 1)")).alias("s"))
    ends = f"concat(if(s = 0, array(0), cast(array() as array<int>)), if(s + {least} <= size, sequence(s + {least}, least(s + {model.longest}, size)), cast(array() as array<int>)))"
    spans = begun.select("unit", *keep, "size", "marked", "s", F.explode(F.expr(ends)).alias("e"))
    packed = "shiftleft(rank, 16) | shiftleft(s, 8) | e" if model.bpe else "shiftleft(cast(e as bigint), 40) | shiftleft(cast(s as bigint), 32) | rank"
    edges = spans.select("unit", *keep, "size", "s", "e", F.expr("substring(marked, s + 1, e - s)").alias("piece")).join(pieces, "piece").select("unit", *keep, "size", F.expr(f"if(rank < 0, -1L, {packed})").alias("x"))
    folded = edges.groupBy("unit", *keep, "size").agg(F.array_sort(F.collect_list("x")).alias("edges")).withColumn("edges", F.expr("slice(edges, 2, size(edges))"))
    chars = [0] * (max((ord(c) for c in model.ids if len(c) == 1), default=0) + 1)
    for piece, i in model.ids.items():
        if len(piece) == 1:
            chars[ord(piece)] = i
    by_rank = sorted(model.rank, key=model.rank.get)
    whole = lambda values, kind: F.lit(np.array(values, kind))
    folded = folded.withColumn("marked", F.replace("unit", F.lit(" "), F.lit(_SPACE))).withColumn("chars", whole(chars, np.int32)).withColumn("ids", whole(by_rank or [0], np.int32)).withColumn("bytes", whole([model.byte[i] for i in range(256)], np.int32))
    single = "coalesce(get(chars, ascii(substring(marked, i + 1, 1))), 0)"
    if model.bpe:
        s, e, rank = _S, _E, "cast(shiftright(x, 16) as int)"
        folded = folded.withColumn("m", F.expr(_PASS)).withColumn("m", F.expr(f"if((m & {_LATE}) = 0, m, {_MERGE})"))
    else:
        # a character that is no piece costs more than any piece, so that it is only taken where it must be
        s, e, rank = "cast(shiftright(x, 32) & 255 as int)", "cast(shiftright(x, 40) as int)", "cast(x & 4294967295 as int)"
        scores = [model.pieces[i][1] for i in by_rank]
        folded = folded.withColumn("scores", whole([*scores, min(scores, default=0.0) - 10], np.float64))
        lone = f"transform(filter(sequence(0, size - 1), i -> {single} = 0), i -> shiftleft(cast(i + 1 as bigint), 40) | shiftleft(cast(i as bigint), 32) | {len(by_rank)})"
        folded = folded.withColumn("edges", F.expr(f"array_sort(concat(edges, {lone}))")).withColumn("m", F.expr(_VITERBI))
    both = f"(shiftleft(1L, {s}) | shiftleft(1L, {e}))"
    inside = f"((shiftleft(1L, {e}) - 1) & ~(shiftleft(1L, {s} + 1) - 1))"
    # a symbol is an edge with no boundary inside, or a character between two boundaries; one that is no piece is spelled in bytes
    wide = f"transform(filter(edges, x -> {e} > {s} + 1 and (m & {both}) = {both} and (m & {inside}) = 0), x -> shiftleft(cast({s} as bigint), 32) | get(ids, {rank}))"
    narrow = f"transform(filter(sequence(0, size - 1), i -> (shiftright(m, i) & 3) = 3), i -> shiftleft(cast(i as bigint), 32) | {single})"
    folded = folded.withColumn("symbols", F.expr(f"array_sort(concat({wide}, {narrow}))"))
    char = "cast(substring(marked, cast(shiftright(y, 32) as int) + 1, 1) as binary)"
    spelled = f"transform(sequence(1, octet_length({char})), k -> get(bytes, cast(conv(hex(substring({char}, k, 1)), 16, 10) as int)))"
    code = "cast(y & 4294967295 as int)"
    codes = f"if(exists(symbols, y -> {code} = 0), flatten(transform(symbols, y -> if({code} = 0, {spelled}, array({code})))), transform(symbols, y -> {code}))"
    folded = folded.select("unit", *keep, F.expr(codes).alias("codes"))

    @F.arrow_udf("array<int>")
    def merge_long(column: pa.Array) -> pa.Array:
        return pa.array([model.merge(u) if model.bpe else model.best_path(u) for u in column.to_pylist()], pa.list_(pa.int32()))

    return folded.unionByName(sized.filter(F.col("size") > MAX_FOLD).select("unit", *keep, merge_long("marked").alias("codes")))


_CODES = pa.schema([("unit", pa.string()), ("codes", pa.list_(pa.int32()))])
_ANSWER = "part int, n int, numbers binary, check binary, sizes binary, codes binary"
_ANSWERS = pa.schema([("n", pa.int32()), ("numbers", pa.binary()), ("check", pa.binary()), ("sizes", pa.binary()), ("codes", pa.binary())])


def _answer(coded: tuple, kind: type):
    """The codes of the units of every block, for the partition it came from."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket = None
        for batch in batches:
            of, source = batch.column("part").to_pylist(), batch.column("source")
            for i in range(batch.num_rows):
                if of[i] != bucket:
                    bucket = of[i]
                    table = parts.get(coded, bucket, _CODES).combine_chunks()
                    known = table.column("unit").combine_chunks() if len(table) else pa.array([], pa.string())
                    lists = table.column("codes").combine_chunks() if len(table) else pa.array([], pa.list_(pa.int32()))
                    hashes = _hashes(known)
                    order = np.argsort(hashes)
                words = batch.column("units").slice(i, 1).flatten()
                h = _hashes(words)
                at = order[np.minimum(np.searchsorted(hashes[order], h), len(order) - 1)]
                if not pc.all(pc.equal(known.take(pa.array(at)), words.cast(pa.string()))).as_py():
                    raise RuntimeError("a unit has no codes")
                codes = lists.take(pa.array(at))
                sizes = np.asarray(pc.list_value_length(codes)).astype(np.uint32)
                one = lambda x: pa.array([x.tobytes()], pa.binary())
                yield pa.RecordBatch.from_arrays([source.slice(i, 1), pa.array([len(h)], pa.int32()), batch.column("numbers").slice(i, 1), one(h.astype(np.uint8)), one(sizes), one(np.asarray(codes.flatten()).astype(kind))], names=["part", "n", "numbers", "check", "sizes", "codes"])

    return run


class _Encoder:
    """Codes of the texts of a partition, from the answers to its blocks."""

    def __init__(self, model: Model, where: tuple, kind: type):
        table = parts.get(where, TaskContext.get().partitionId(), _ANSWERS)
        column = lambda c, kind: np.frombuffer(b"".join(table.column(c).to_pylist()), kind)
        number, check, size, values = column("numbers", np.uint32), column("check", np.uint8), column("sizes", np.uint32).astype(np.int64), column("codes", kind)
        self.model, self.values, self.seen = model, values, _Numbers()
        self.check, self.size, self.start = np.zeros(len(number), np.uint8), np.zeros(len(number), np.int64), np.zeros(len(number), np.int64)
        self.check[number], self.size[number], self.start[number] = check, size, np.cumsum(size) - size

    def __call__(self, column: pa.Array) -> pa.Array:
        raw, starts, ends, first = units(column, self.model)
        h = K.span_hash(K.prefix_sums(K.BYTE_CODE[raw]), starts, ends)
        number, new = self.seen.add(h)
        if self.seen.count > len(self.size) or (self.check[self.seen.count - len(new) : self.seen.count] != h[new].astype(np.uint8)).any():
            raise parts.Moved
        size = self.size[number]
        ends = np.concatenate([[0], np.cumsum(size)])
        take = np.repeat(self.start[number] - ends[:-1], size) + np.arange(ends[-1])
        return pa.ListArray.from_arrays(pa.array(ends[first].astype(np.int32)), pa.array(self.values[take].astype(np.int32)))


def encode(docs: DataFrame, model: Model | None = None, restored: bool = False) -> DataFrame:
    """Rows (doc_id, text, codes) of all documents; with ``restored`` rows (doc_id, codes, restored), which tells whether decoding gives the text again.

    A null text has null codes and counts as restored, an empty one has none.
    Space marks in texts are read as spaces. Rows that repeat are encoded one
    by one; other columns are ignored; an empty table gives no rows.
    """
    spark, model = docs.sparkSession, model or Model()
    docs = parts.as_scan(docs.select("doc_id", "text"), "texts")
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = np.uint16 if len(model.pieces) <= 1 << 16 else np.uint32
    path, *_ = parts.put(docs.select("text").mapInArrow(_send(model, BUCKETS_A_PARTITION * partitions), _SENT), "units")
    blocks = spark.read.schema(_SENT).parquet(path)
    total = blocks.agg(F.sum("n")).first()[0] or 0
    distinct = blocks.mapInArrow(_distinct, "bucket bigint, unit string").repartition(max(partitions, -(-total // FOLD_UNITS)), "unit").distinct()
    coded = parts.put(encode_units(distinct, model, ["bucket"]).select(F.col("bucket").alias("part"), "unit", "codes"), "codes", pa.int64())
    answers = parts.put(blocks.mapInArrow(_answer(coded, kind), _ANSWER), "answers")

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = None, _Decoder(model) if restored else None
        for batch in batches:
            encoder = encoder or _Encoder(model, answers, kind)
            for a, b in K.slices(batch.column(1)):
                ids, text = (c.slice(a, b - a) for c in batch.columns)
                codes = encoder(text)
                if decoder:
                    same = pc.fill_null(pc.equal(decoder(codes), pc.replace_substring(text, _SPACE, " ")), True)
                codes = pc.if_else(pc.is_null(text), None, codes)
                if decoder:
                    yield pa.RecordBatch.from_arrays([ids, codes, same], names=["doc_id", "codes", "restored"])
                else:
                    yield pa.RecordBatch.from_arrays([ids, text, codes], names=["doc_id", "text", "codes"])

    kept = "codes array<int>, restored boolean" if restored else "text string, codes array<int>"
    return docs.mapInArrow(look_up, f"doc_id {dict(docs.dtypes)['doc_id']}, {kept}")


class _Decoder:
    """Texts of lists of codes."""

    def __init__(self, model: Model):
        self.prefix = model.prefix
        self.table = pa.array([b"" if kind in (2, 3) else bytes([int(p[1:-1], 16)]) if kind == 6 else p.replace(_SPACE, " ").encode() for p, _, kind in model.pieces], pa.large_binary())

    def __call__(self, column: pa.Array) -> pa.Array:
        lists = pc.if_else(pc.is_null(column), pa.scalar([], column.type), column)
        joined = self.table.take(lists.flatten())
        ends = np.concatenate([[0], np.cumsum(np.asarray(pc.binary_length(joined), dtype=np.int64))])
        bounds = ends[np.concatenate([[0], np.cumsum(np.asarray(pc.list_value_length(lists), dtype=np.int64))])]
        raw = b"".join(joined.to_pylist()) if joined.offset else (joined.buffers()[2] or pa.py_buffer(b"")).to_pybytes()
        whole = pa.Array.from_buffers(pa.large_binary(), len(lists), [None, pa.py_buffer(bounds), pa.py_buffer(raw)])
        try:
            text = whole.cast(pa.large_string())
        except pa.ArrowInvalid:
            text = pa.array([x.decode("utf-8", "replace") for x in whole.to_pylist()], pa.large_string())
        if self.prefix:
            text = pc.if_else(pc.starts_with(text, " "), pc.utf8_slice_codeunits(text, 1), text)
        return pc.if_else(pc.is_null(column), None, text).cast(pa.string())


def decode(coded: DataFrame, model: Model | None = None, column: str = "codes", to: str = "decoded") -> DataFrame:
    """``coded`` with the text of its codes: control and unknown codes are nothing, null codes null. No shuffle.

    Codes beyond the model raise; bytes that are not UTF-8 become replacement characters.
    """
    model = model or Model()

    @F.arrow_udf("string")
    def spell(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        decoder = _Decoder(model)
        for batch in batches:
            found = [decoder(batch.slice(at, DECODE_ROWS)) for at in range(0, len(batch), DECODE_ROWS)]
            yield pa.concat_arrays(found) if found else pa.array([], pa.string())

    return coded.withColumn(to, spell(column))


def op6_sentencepiece(spark, sf_dir: str) -> DataFrame:
    return encode(spread(spark.read.parquet(f"{sf_dir}/documents.parquet")), restored=True)
