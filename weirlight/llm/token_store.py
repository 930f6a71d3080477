"""Token ids in wavelet matrices: one succinct, compressed record per shard, with rank and select.

A shard holds the ids of consecutive documents, each document's ids followed by an end id. Its wavelet
matrix has one bit plane for each bit of an id, from the top; after each plane, the ids with bit 0 go
before those with bit 1, stably. From the planes alone come the id at a place (access), how often an
id comes before a place (rank) and where its k-th one is (select), each in one step for each plane.

A record begins with its directory: for every ``BLOCK`` bits of each plane, how many 1s come before
them and where their compressed bytes are. So each step of access, rank and select inflates one block
of one plane and counts within it; the rest of the record stays as it is.

The file format is a Parquet table with one row per shard: its range in the order of documents, the
documents' ids and lengths, and ``planes``, the record that ``pack`` writes: ``WMX2``, the number of
ids, of planes, of bits in a block, the zeros of each plane, the directory, and the blocks, packed and
compressed by zstandard. Parquet is the container because Spark's writers commit files whole, retry on
other machines after a loss, and reach any store that the cluster can; ``unpack`` reads a record by
itself. ``write_store`` keeps the table under a given path, else as a working table.

Cases: null texts are empty and have the end id only. Null doc_ids come first. Documents of the same id
are in the order of their text; each has a row. Texts of any length are encoded whole. An empty table
makes an empty store. Ids that are no whole numbers raise Spark's cast error. Other columns are not read.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections import OrderedDict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._shared import materialise, range_buckets, release

MAGIC = b"WMX2"
#: Bits of a plane that are compressed together.
BLOCK = 1 << 16
#: Inflated blocks that a matrix keeps.
KEPT_BLOCKS = 64


class WaveletMatrix:
    """A record as it lies; blocks are inflated when they are asked for. ``inflated`` counts them."""

    def __init__(self, record: bytes):
        if record[:4] != MAGIC:
            raise ValueError("not a wavelet matrix record")
        self.record = memoryview(record)
        self.n, bits, self.block = struct.unpack_from("<QII", record, 4)
        at = 20
        self.zeros = list(struct.unpack_from(f"<{bits}Q", record, at))
        at += 8 * bits
        self.blocks = -(-self.n // self.block)
        size = bits * (self.blocks + 1)
        self.ones = np.frombuffer(record, "<i8", size, at).reshape(bits, -1)
        self.places = np.frombuffer(record, "<i8", size, at + 8 * size).reshape(bits, -1)
        self.data = at + 16 * size
        self.inflated = 0
        self._kept: OrderedDict[tuple[int, int], np.ndarray] = OrderedDict()
        self._zstd = zstandard.ZstdDecompressor()

    @property
    def bits(self) -> int:
        return len(self.zeros)

    def _bytes(self, level: int, block: int) -> np.ndarray:
        lo, hi = self.data + int(self.places[level, block]), self.data + int(self.places[level, block + 1])
        return np.frombuffer(self._zstd.decompress(self.record[lo:hi]), np.uint8)

    def _block(self, level: int, block: int) -> np.ndarray:
        """A block's packed bits."""
        key = (level, block)
        if key in self._kept:
            self._kept.move_to_end(key)
        else:
            self.inflated += 1
            self._kept[key] = self._bytes(level, block)
            if len(self._kept) > KEPT_BLOCKS:
                self._kept.popitem(last=False)
        return self._kept[key]

    def _rank(self, level: int, at: int) -> int:
        """How many of the first ``at`` bits of a plane are 1."""
        block, rest = divmod(at, self.block)
        count = int(self.ones[level, block])
        if rest:
            packed = self._block(level, block)
            count += int(np.bitwise_count(packed[: rest >> 3]).sum())
            if rest & 7:
                count += (int(packed[rest >> 3]) >> (8 - (rest & 7))).bit_count()
        return count

    def access(self, at: int) -> int:
        """The id at a place."""
        if not 0 <= at < self.n:
            raise IndexError(at)
        value = 0
        for level in range(self.bits):
            bit = int(self._block(level, at // self.block)[(at % self.block) >> 3]) >> (7 - (at & 7)) & 1
            ones = self._rank(level, at)
            value = 2 * value + bit
            at = self.zeros[level] + ones if bit else at - ones
        return value

    def _range(self, value: int, end: int) -> tuple[int, int]:
        """Where the values among the first ``end`` ids lie after the last plane."""
        start = 0
        for level in range(self.bits):
            a, b = self._rank(level, start), self._rank(level, end)
            if value >> (self.bits - 1 - level) & 1:
                start, end = self.zeros[level] + a, self.zeros[level] + b
            else:
                start, end = start - a, end - b
            if start == end:
                break
        return start, end

    def rank(self, value: int, end: int) -> int:
        """How often value is among the first ``end`` ids."""
        if value < 0 or value >> self.bits:
            return 0
        start, end = self._range(value, min(max(end, 0), self.n))
        return end - start

    def _up(self, value: int, at: np.ndarray) -> np.ndarray:
        """The places in the sequence of places after the last plane, which rise."""
        for level in range(self.bits - 1, -1, -1):
            bit = value >> (self.bits - 1 - level) & 1
            before = self.ones[level] if bit else np.minimum(np.arange(self.blocks + 1) * self.block, self.n) - self.ones[level]
            k = at - self.zeros[level] if bit else at
            block = np.searchsorted(before, k, "right") - 1
            out = np.empty_like(at)
            for b in np.unique(block):
                mine = block == b
                count = min(self.block, self.n - int(b) * self.block)
                places = np.flatnonzero(np.unpackbits(self._block(level, int(b)), count=count) == bit)
                out[mine] = int(b) * self.block + places[k[mine] - before[b]]
            at = out
        return at

    def select(self, value: int, k: int) -> int:
        """The place of the k-th value, from 0; -1 if there are no more than k."""
        if value < 0 or value >> self.bits or k < 0:
            return -1
        start, end = self._range(value, self.n)
        return int(self._up(value, np.array([start + k]))[0]) if k < end - start else -1

    def occurrences(self, value: int) -> np.ndarray:
        """All places of value, in order."""
        if value < 0 or value >> self.bits:
            return np.zeros(0, np.int64)
        start, end = self._range(value, self.n)
        return self._up(value, np.arange(start, end)) if end > start else np.zeros(0, np.int64)

    def decode(self) -> np.ndarray:
        """All ids in order, from the lowest plane up: each step undoes one stable partition."""
        ids = np.zeros(self.n, np.uint32 if self.bits > 16 else np.uint16)
        for level in range(self.bits - 1, -1, -1):
            packed = b"".join(self._bytes(level, b) for b in range(self.blocks))
            plane = np.unpackbits(np.frombuffer(packed, np.uint8), count=self.n).view(bool)
            out = np.empty_like(ids)
            out[np.flatnonzero(~plane)] = ids[: self.zeros[level]]
            out[np.flatnonzero(plane)] = ids[self.zeros[level] :] | ids.dtype.type(1 << (self.bits - 1 - level))
            ids = out
        return ids


def pack(ids: np.ndarray, bits: int, block: int = BLOCK) -> bytes:
    """The record of unsigned ids under 2**bits; block is a multiple of 8."""
    n, blocks = len(ids), -(-len(ids) // block)
    zeros, data = [], []
    ones, places, at = np.zeros((bits, blocks + 1), "<i8"), np.zeros((bits, blocks + 1), "<i8"), 0
    press = zstandard.ZstdCompressor(level=1)
    for level in range(bits):
        one = ids.dtype.type(1 << (bits - 1 - level))
        plane = (ids & one) != 0
        left = np.compress(~plane, ids)
        zeros.append(len(left))
        ids = np.concatenate((left, np.compress(plane, ids)))
        if bits - 1 - level == 8 and ids.dtype == np.uint16:
            # The planes that are left look at the low eight bits only.
            ids = ids.astype(np.uint8)
        packed = np.packbits(plane)
        for b in range(blocks):
            part = packed[b * block // 8 : (b + 1) * block // 8]
            ones[level, b + 1] = ones[level, b] + int(np.bitwise_count(part).sum())
            places[level, b] = at
            data.append(press.compress(part.data))
            at += len(data[-1])
        places[level, blocks] = at
    head = MAGIC + struct.pack("<QII", n, bits, block) + struct.pack(f"<{bits}Q", *zeros)
    return b"".join((head, ones.tobytes(), places.tobytes(), *data))


def unpack(record: bytes) -> WaveletMatrix:
    return WaveletMatrix(record)


#: Kinds of code points by how a byte-level tokenizer cuts texts: Latin letters, digits, signs,
#: apostrophes, spaces, other white space, what is no white space but of unsure kind, and what may be any.
_L, _N, _S, _A, _P, _W, _U, _E = range(8)
_KINDS = np.full(256, _U, np.uint8)
_KINDS[:0x80] = _S
for _i in range(0x80):
    if chr(_i).isalpha():
        _KINDS[_i] = _L
    elif chr(_i).isdigit():
        _KINDS[_i] = _N
_KINDS[9:14], _KINDS[32], _KINDS[39], _KINDS[0x1C:0x20] = _W, _P, _A, _E
#: Lead bytes of U+00C0 to U+027F, which are letters but for two.
_KINDS[0xC3:0xCA] = _L
#: White space of three bytes in UTF-8, and two code points that were white space once.
_WIDE_SPACE = np.array([0x1680, 0x180E, *range(0x2000, 0x200C), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000], np.int64)

_NEVER, _ALWAYS, _LAST = 0, 1, 2
#: Whether a text is cut between two neighbours, by their kinds; _LAST: if the second ends its white space and something follows it.
_CUT = np.zeros((8, 8), np.uint8)
for _a in (_L, _N, _S, _A):
    for _b in (_L, _N, _S, _A):
        _CUT[_a, _b] = _ALWAYS if min(_a, _S) != min(_b, _S) and (_a, _b) != (_A, _L) else _NEVER
for _a in (_L, _N, _S, _A, _U):
    _CUT[_a, _P] = _CUT[_a, _W] = _CUT[_W, _a] = _ALWAYS
_CUT[_P : _W + 1, _P : _W + 1] = _LAST
_CUT = _CUT.ravel()


def byte_kinds(data: np.ndarray) -> np.ndarray:
    """The kind of the code point that each byte of UTF-8 text belongs to."""
    kind = _KINDS[data]
    high = np.flatnonzero(data >= 0xC2)
    if len(high):
        lead, second = data[high], data[high + 1]
        two = high[lead < 0xE0]
        kind[two + 1] = kind[two]
        odd = (lead == 0xC3) & ((second == 0x97) | (second == 0xB7))
        kind[high[odd]] = kind[high[odd] + 1] = _U
        space = high[(lead == 0xC2) & ((second == 0x85) | (second == 0xA0))]
        kind[space] = kind[space + 1] = _E
        three = high[(lead >= 0xE1) & (lead <= 0xE3)]
        if len(three):
            point = ((data[three].astype(np.int64) & 15) << 12) | ((data[three + 1].astype(np.int64) & 63) << 6) | (data[three + 2] & 63)
            space = three[np.isin(point, _WIDE_SPACE)]
            for k in range(3):
                kind[space + k] = _E
    return kind


def cut_places(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Where pieces of the texts data[offsets[i]:offsets[i + 1]] begin: each piece is encoded as it is within its text."""
    begin = np.zeros(len(data) + 1, bool)
    rule = _CUT[kind[:-1] * np.uint8(8) + kind[1:]]
    begin[1:-1] = rule == _ALWAYS
    last = np.flatnonzero(rule == _LAST) + 1
    if len(last):
        ends = np.zeros(len(data) + 1, bool)
        ends[offsets] = True
        last = last[~ends[last + 1]]
        begin[last[(kind[last + 1] <= _A) | (kind[last + 1] == _U)]] = True
    begin[offsets] = True
    begin[-1] = False
    return np.flatnonzero(begin)


class Encoder:
    """A tokenizers file, with the ids of pieces kept between calls.

    A byte-level BPE tokenizer with the usual pattern cuts texts between letters, digits, signs and white
    space, and encodes what lies between on its own. So texts are cut at places where that pattern surely
    cuts too, each distinct piece is encoded once by the library, and the pieces' ids are put together.
    Texts that hold one of the tokenizer's special tokens, and all texts if it is of another kind, are
    one piece each.
    """

    #: Pieces that are kept, those met first, and the longest of them in bytes.
    MOST, LONGEST = 2_000_000, 64
    #: Pieces that the library gets in one string: long strings take it longer for each word.
    TOGETHER = 50

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        pre, model = spec.get("pre_tokenizer") or {}, spec.get("model") or {}
        usual = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space", True)
        self.cuts = bool(usual and model.get("type") == "BPE" and not model.get("dropout") and not spec.get("normalizer") and not spec.get("truncation"))
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab()
        self.bits = max(1, max(vocabulary.values()).bit_length())
        self.dtype = np.uint16 if self.bits <= 16 else np.uint32
        #: Tokens that begin with a space: in a string of words with a space before each, they begin the words.
        self.leads = np.zeros(max(vocabulary.values()) + 1, bool)
        self.leads[[i for t, i in vocabulary.items() if t.startswith("Ġ")]] = True
        self._known, self._ids, self._ends = pa.array([], pa.binary()), np.zeros(0, self.dtype), np.zeros(1, np.int64)

    def _library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.dtype) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces, how many each has): words with a space before them go to the library many in a string."""
        data, offsets = _bytes_of(pieces)
        size = np.diff(offsets)
        bad = np.r_[0, np.cumsum(byte_kinds(data) != _L)][offsets] if len(data) else np.zeros(len(offsets), np.int64)
        # A space and Latin letters only, so that the pieces joined are cut into the same pieces.
        words = (np.diff(bad) == 1) & (size > 1) & (data[offsets[:-1]] == 32) if self.cuts else np.zeros(len(size), bool)
        counts, parts = np.zeros(len(size), np.int64), {}
        at = np.flatnonzero(words)
        for lo in range(0, len(at), 1000 * self.TOGETHER):
            rows = at[lo : lo + 1000 * self.TOGETHER]
            groups = [rows[k : k + self.TOGETHER] for k in range(0, len(rows), self.TOGETHER)]
            strings = ["".join(p.decode() for p in pieces.take(pa.array(g)).to_pylist()) for g in groups]
            ids = np.concatenate(self._library(strings))
            starts = np.flatnonzero(self.leads[ids])
            if len(starts) != len(rows):
                raise ValueError("a word's tokens don't begin with its space")
            counts[rows] = np.diff(np.r_[starts, len(ids)])
            parts[lo] = ids
        others = np.flatnonzero(~words)
        rest = []
        for lo in range(0, len(others), 1000):
            rest += self._library([p.decode() for p in pieces.take(pa.array(others[lo : lo + 1000])).to_pylist()])
        counts[others] = [len(x) for x in rest]
        out = np.empty(int(counts.sum()), self.dtype)
        ends = np.cumsum(counts)
        for rows, ids in ((at, list(parts.values())), (others, rest)):
            if len(rows):
                out[_runs((ends - counts)[rows], counts[rows])] = np.concatenate(ids)
        return out, counts

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, one after the other; how many each text has). Nulls have none."""
        texts = pc.fill_null(texts, "")
        data, offsets = _bytes_of(texts)
        if not len(data):
            return np.zeros(0, self.dtype), np.zeros(len(texts), np.int64)
        begin = cut_places(data, offsets, byte_kinds(data)) if self.cuts else np.unique(offsets[:-1][np.diff(offsets) > 0])
        if self.cuts and self.special:
            whole = np.zeros(len(texts), bool)
            for token in self.special:
                whole |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
            for i in np.flatnonzero(whole):
                begin = begin[(begin <= offsets[i]) | (begin >= offsets[i + 1])]
        bounds = np.append(begin, len(data)).astype(np.int32)
        pieces = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(bounds), pa.py_buffer(data)]).dictionary_encode()
        number, distinct = pieces.indices.to_numpy(), pieces.dictionary
        place = pc.index_in(distinct, value_set=self._known)
        new = distinct.filter(pc.is_null(place))
        ids, counts = self._learn(new)
        place = pc.fill_null(place, -1).to_numpy().astype(np.int64)
        place[place < 0] = len(self._known) + np.arange(len(new))
        pool = np.concatenate((self._ids, ids))
        ends = np.r_[self._ends, self._ends[-1] + np.cumsum(counts)]
        each = np.diff(ends)[place][number]
        out = pool[_runs(ends[place][number], each)]
        before = np.r_[0, np.cumsum(each)]
        self._keep(new, ids, counts)
        return out, np.diff(before[np.searchsorted(begin, offsets)])

    def _keep(self, new: pa.Array, ids: np.ndarray, counts: np.ndarray) -> None:
        if len(self._known) + len(new) > self.MOST:
            # The pieces that were kept first are the most frequent ones.
            half = min(len(self._known), self.MOST // 2)
            self._known, self._ends = pa.array(self._known[:half].to_pylist(), pa.binary()), self._ends[: half + 1].copy()
            self._ids = self._ids[: self._ends[-1]].copy()
        short = pc.less_equal(pc.binary_length(new), self.LONGEST).to_numpy(zero_copy_only=False)
        kept = np.flatnonzero(short)[: max(0, self.MOST - len(self._known))]
        first = np.cumsum(counts) - counts
        self._known = pa.concat_arrays([self._known, new.take(pa.array(kept))])
        self._ids = np.concatenate((self._ids, ids[_runs(first[kept], counts[kept])]))
        self._ends = np.r_[self._ends, self._ends[-1] + np.cumsum(counts[kept])]


def _bytes_of(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes, offsets) of a string or binary array without nulls."""
    n = len(strings)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, bounds, data = strings.buffers()
    wide = pa.types.is_large_string(strings.type) or pa.types.is_large_binary(strings.type)
    offsets = np.frombuffer(bounds, np.int64 if wide else np.int32)[strings.offset : strings.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def _runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1, ... for each i, sizes[i] of them."""
    kind = np.int32 if not len(starts) or int(starts.max()) + int(sizes.sum()) < 2**31 else np.int64
    shift = (starts - (np.cumsum(sizes) - sizes)).astype(kind)
    out = np.repeat(shift, sizes)
    out += np.arange(len(out), dtype=kind)
    return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each path and process."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


#: Bytes of text that are encoded at a time.
TOGETHER = 6_000_000


def _gathered(batches, column: str, size: int):
    """Record batches put together until their strings have that many bytes, long batches in slices."""
    held, total = [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            held.append(part)
            total += int(pc.sum(pc.binary_length(part.column(column))).as_py() or 0)
            if total >= size:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, total = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


SHARD = "part int, seq int, before long, n_tokens long, doc_ids binary, has_id binary, lengths binary, planes binary"
_FIELDS = [("part", pa.int32()), ("seq", pa.int32()), ("before", pa.int64()), ("n_tokens", pa.int64()), ("doc_ids", pa.binary()), ("has_id", pa.binary()), ("lengths", pa.binary()), ("planes", pa.binary())]


def _shards(batches, enc: Encoder, end_id: int, tokens_per_shard: int):
    """Shard rows of documents (part, id, text) that come by part."""
    bits = max(enc.bits, end_id.bit_length())
    kind = np.uint32 if bits > 16 else np.uint16
    held: list[tuple] = []
    part, seq, before, total = None, 0, 0, 0

    def shard() -> pa.RecordBatch:
        names, known, sizes = (np.concatenate([h[k] for h in held]) for k in range(3))
        ids = np.concatenate([h[3] for h in held])
        row = (part, seq, before, len(ids), names.astype("<i8").tobytes(), np.packbits(known).tobytes(), sizes.astype("<i8").tobytes(), pack(ids, bits))
        return pa.record_batch([pa.array([v], t) for v, (_, t) in zip(row, _FIELDS, strict=True)], names=[f for f, _ in _FIELDS])

    for batch in _gathered(batches, "text", TOGETHER):
        ids, counts = enc.encode(batch.column("text"))
        sizes = counts + 1
        # The end id after each document's own.
        closed = np.full(len(ids) + len(sizes), end_id, kind)
        own = np.ones(len(closed), bool)
        own[np.cumsum(sizes) - 1] = False
        closed[own] = ids
        parts = batch.column("part").to_numpy()
        names = pc.fill_null(batch.column("id"), 0).to_numpy()
        known = pc.is_valid(batch.column("id")).to_numpy(zero_copy_only=False)
        ends, at, first = np.cumsum(sizes), 0, 0
        for i, (p, size) in enumerate(zip(parts.tolist(), sizes.tolist(), strict=True)):
            if (held or i > first) and (p != part or total >= tokens_per_shard):
                if i > first:
                    held.append((names[first:i], known[first:i], sizes[first:i], closed[at : ends[i - 1]].copy()))
                yield shard()
                seq, before = (seq + 1, before + total) if p == part else (0, 0)
                held, total, first, at = [], 0, i, int(ends[i - 1]) if i else 0
            part = p
            total += size
        if len(sizes) > first:
            held.append((names[first:], known[first:], sizes[first:], closed[at:].copy()))
        del batch, ids, closed, own
        release()
    if held:
        yield shard()


def write_store(
    docs: DataFrame,
    tokenizer_path: str,
    path: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = 0,
    tokens_per_shard: int = 1 << 20,
    rows_per_part: int = 2000,
) -> DataFrame:
    """Encode docs in ascending id order and write their store; returns its table.

    The store is at ``path``, which must not exist yet, or without one among the working tables of the
    shared folder. Documents are dealt to ranges of ids, each range is one task's, and is cut into
    shards after the document that fills one.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"))
    tie = F.xxhash64("text")
    part, parts = range_buckets(rows, "id", tie, rows_per_part)
    dealt = rows.withColumn("part", part.cast("int"))
    ordered = dealt.repartitionById(parts, F.pmod("part", F.lit(parts)).cast("int")).sortWithinPartitions("part", F.col("id").asc_nulls_first(), tie, "text")

    def shards(batches):
        yield from _shards(batches, encoder(tokenizer_path), end_id, tokens_per_shard)

    table = ordered.select("part", "id", "text").mapInArrow(shards, SHARD)
    if path is None:
        return materialise(table, "token-store")
    table.write.parquet(path)
    return open_store(docs.sparkSession, path)


def open_store(spark, path: str) -> DataFrame:
    """The table of a store that write_store wrote under path."""
    return spark.read.schema(SHARD).parquet(path)


def read_store(store: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of each document, from the store alone."""
    per_part = store.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before_part = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_part.select("part", F.coalesce(F.sum("n").over(before_part), F.lit(0)).alias("part_start"))

    def documents(batches):
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("doc_ids", "has_id", "lengths", "shard_start")]
            for row, (ids, has, lengths, start) in enumerate(zip(*columns, strict=True)):
                names, sizes = np.frombuffer(ids, "<i8"), np.frombuffer(lengths, "<i8")
                known = np.unpackbits(np.frombuffer(has, np.uint8), count=len(names)).astype(bool)
                ends = np.cumsum(sizes)
                data = memoryview(unpack(batch.column("planes")[row].as_py()).decode().astype("<u4")).cast("B")
                crc = [zlib.crc32(data[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
                yield pa.record_batch(
                    [pa.array(names, pa.int64(), mask=~known), pa.array(start + ends - sizes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(crc, pa.int64())],
                    names=["id", "start", "n_tokens", "ids_crc32"],
                )
                del data
            release()

    # There are at most as many parts as range_buckets makes, so their starts can be sent to all executors.
    placed = store.join(F.broadcast(starts), "part").select("doc_ids", "has_id", "lengths", "planes", (F.col("part_start") + F.col("before")).alias("shard_start"))
    return placed.mapInArrow(documents, "id long, start long, n_tokens long, ids_crc32 long").withColumnRenamed("id", id_col)
