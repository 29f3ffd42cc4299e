"""Token-id files compressed by a static range asymmetric numeral system (rANS).

File format, little-endian
    magic `TRNS`, u8 version, u8 precision bits, u16 lanes, u32 block tokens, u32 symbols, u32 documents, u64 tokens, u32 blocks
    frequency table, zstd: symbol ids (u32), frequencies (u32), which sum up to 2**precision; all blocks share it
    document table, zstd: doc_ids (i64), token counts (u32)
    checkpoints, a row a block: u64 first token, u32 tokens, u64 offset of its words, u32 words, u32 CRC-32 of states and words
    lane states, u64 for each lane of each block
    words, u32
    CRC-32 of all before, u32
Blocks are independent.  Within a block token t belongs to lane t mod lanes; each lane is a 64-bit state
renormalised by 32-bit words, which all lanes of a block share in the order in which the decoder needs
them.  A reader can start at any checkpoint.

Texts are encoded, the id 0 is appended to each document, and documents are dealt to ranges of doc_id.  A
task writes the files of its range in ascending order.  Files are rows of a Parquet table (range,
sequence number, counts, bytes), so any store that Spark can write holds them, with its commit protocol.

Defined results
    null text       as the empty text: the end id alone
    null doc_id     before all ids
    repeated rows   one after the other, in the order of their ids' bytes
    no document     an empty table of files, an empty result
    extra columns   ignored
Memory in a worker: the ids of one file (`FILE_TOKENS` at most, and the longest document); while encoding, the kept cuts.
"""

from __future__ import annotations

import gc
import os
import re
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

RANGE_BYTES = 16 << 20
FILE_TOKENS = 8_000_000
PRECISION = 20
LANES = 128
BLOCK_TOKENS = 32_768
LOW = 1 << 31  # states stay in [LOW, LOW << 32)
MAGIC = b"TRNS"
HEAD = struct.Struct("<4sBBHIIIQI")
BLOCK = np.dtype([("first", "<u8"), ("tokens", "<u4"), ("offset", "<u8"), ("words", "<u4"), ("crc", "<u4")])
U = np.uint64
LIBRARY_ROWS = 10_000  # of a batch: the more at once, the fewer cuts are looked up twice
DENSE = 1 << 20  # ids below it are counted and looked up in arrays


class Corrupt(ValueError):
    """A checksum or a size does not fit."""


# -- the coder -------------------------------------------------------------------------------------


def table_of(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols that occur and their frequencies, scaled to 2**PRECISION with none at zero."""
    if len(ids) and ids.max() < DENSE:
        count = np.bincount(ids)
        symbols = np.flatnonzero(count)
        count = count[symbols]
    else:
        symbols, count = np.unique(ids, return_counts=True)
    if not len(symbols):
        return symbols.astype(np.uint32), count.astype(np.uint32)
    total = 1 << PRECISION
    scaled = np.maximum(1, count * (total - len(symbols)) // count.sum())
    scaled[np.argmax(scaled)] += total - scaled.sum()
    return symbols.astype(np.uint32), scaled.astype(np.uint32)


def places(symbols: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Where in the table each id stands."""
    if len(symbols) and symbols[-1] < DENSE:
        at = np.zeros(int(symbols[-1]) + 1, np.int32)
        at[symbols] = np.arange(len(symbols), dtype=np.int32)
        return at[ids]
    return np.searchsorted(symbols, ids)


def encode_blocks(place: np.ndarray, freq: np.ndarray, lanes: int, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lane states and words of each block, from table places; all blocks and lanes step together.

    Returns states (blocks, lanes), words of all blocks and the count of each block's.
    """
    full = len(place) // block * block
    if 0 < full < len(place):  # only the last block has a rest, so the others need no masks
        parts = [encode_blocks(p, freq, lanes, block) for p in (place[:full], place[full:])]
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))
    full = full == len(place)
    blocks, steps = -(-len(place) // block), block // lanes
    padded = np.full(blocks * block, -1, np.int32)
    padded[: len(place)] = place
    grid = padded.reshape(blocks, steps, lanes)
    start = (np.cumsum(freq) - freq).astype(U)
    freq = freq.astype(U)
    state = np.full((blocks, lanes), LOW, U)
    word = np.zeros((steps, blocks, lanes), np.uint32)
    wrote = np.zeros((steps, blocks, lanes), bool)
    for t in range(steps - 1, -1, -1):
        at = grid[:, t, :]
        f = freq[at] if full else np.where(at >= 0, freq[at], U(1))
        out = state >= f << U(63 - PRECISION)
        if not full:
            out &= at >= 0
        word[t], wrote[t] = state & U(0xFFFFFFFF), out
        state = np.where(out, state >> U(32), state)
        after = state + start[at] + state // f * (U(1 << PRECISION) - f)
        state = after if full else np.where(at >= 0, after, state)
    wrote = wrote.transpose(1, 0, 2)
    return state, word.transpose(1, 0, 2)[wrote], wrote.sum(axis=(1, 2))


def decode_blocks(state: np.ndarray, words: np.ndarray, offset: np.ndarray, tokens: np.ndarray, freq: np.ndarray, block: int) -> np.ndarray:
    """Table places of the blocks' tokens, in order."""
    blocks, lanes = state.shape
    if blocks > 1 and tokens[-1] < block:  # only the last block has a rest, so the others need no masks
        return np.concatenate([decode_blocks(state[k], words, offset[k], tokens[k], freq, block) for k in (slice(None, -1), slice(-1, None))])
    full = bool((tokens == block).all())
    steps = block // lanes
    freq = freq.astype(np.int64)
    slot = np.repeat(np.arange(len(freq), dtype=np.int32), freq)
    start = (np.cumsum(freq) - freq).astype(U)
    freq = freq.astype(U)
    words = np.append(words, np.uint32(0)).astype(U)
    state, at = state.copy(), offset.astype(np.int64)
    out = np.empty((blocks, steps, lanes), np.int32)
    lane = np.arange(lanes)
    mask = U((1 << PRECISION) - 1)
    for t in range(steps):
        low = state & mask
        s = slot[low]
        out[:, t, :] = s
        after = freq[s] * (state >> U(PRECISION)) + low - start[s]
        if full:
            state = after
            need = state < U(LOW)
        else:
            real = t * lanes + lane[None, :] < tokens[:, None]
            state = np.where(real, after, state)
            need = real & (state < U(LOW))
        rank = np.cumsum(need, axis=1)
        take = np.minimum(at[:, None] + rank - 1, len(words) - 1)
        state = np.where(need, (state << U(32)) | words[np.maximum(take, 0)], state)
        at = at + rank[:, -1]
    flat = out.reshape(blocks, block)
    return np.concatenate([flat[k, :n] for k, n in enumerate(tokens.tolist())]) if blocks else np.zeros(0, np.int32)


def write_file(doc_ids: np.ndarray, counts: np.ndarray, ids: np.ndarray, lanes: int = LANES, block: int = BLOCK_TOKENS) -> bytes:
    """One token file."""
    symbols, freq = table_of(ids)
    state, words, n_words = encode_blocks(places(symbols, ids), freq, lanes, block)
    blocks = np.zeros(len(state), BLOCK)
    blocks["first"] = np.arange(len(state)) * block
    blocks["tokens"] = np.minimum(block, len(ids) - blocks["first"].astype(np.int64))
    blocks["words"] = n_words
    blocks["offset"] = np.cumsum(n_words) - n_words
    for k in range(len(blocks)):
        o = int(blocks["offset"][k])
        blocks["crc"][k] = zlib.crc32(words[o : o + int(n_words[k])].tobytes(), zlib.crc32(state[k].tobytes()))
    pack = zstandard.ZstdCompressor(level=1).compress
    parts = [pack(symbols.astype("<u4").tobytes() + freq.astype("<u4").tobytes()), pack(doc_ids.astype("<i8").tobytes() + counts.astype("<u4").tobytes())]
    body = HEAD.pack(MAGIC, 1, PRECISION, lanes, block, len(symbols), len(doc_ids), len(ids), len(blocks))
    for p in parts:
        body += struct.pack("<I", len(p)) + p
    body += blocks.tobytes() + state.astype("<u8").tobytes() + words.astype("<u4").tobytes()
    return body + struct.pack("<I", zlib.crc32(body))


class TokenFile:
    """A parsed file; nothing is decoded until it is asked for."""

    def __init__(self, data: bytes):
        if len(data) < HEAD.size + 4 or data[:4] != MAGIC:
            raise Corrupt("not a token file")
        if zlib.crc32(memoryview(data)[:-4]) != struct.unpack("<I", data[-4:])[0]:
            raise Corrupt("checksum of the file")
        _, version, precision, self.lanes, self.block, n_symbols, n_docs, self.tokens, n_blocks = HEAD.unpack_from(data)
        if version != 1 or precision != PRECISION:
            raise Corrupt("unknown version")
        at, tables = HEAD.size, []
        for _ in range(2):
            (size,) = struct.unpack_from("<I", data, at)
            tables.append(zstandard.ZstdDecompressor().decompress(data[at + 4 : at + 4 + size]))
            at += 4 + size
        self.symbols, self.freq = np.frombuffer(tables[0], "<u4").reshape(2, n_symbols) if n_symbols else (np.zeros(0, np.uint32),) * 2
        self.doc_ids = np.frombuffer(tables[1], "<i8", n_docs)
        self.counts = np.frombuffer(tables[1], "<u4", n_docs, 8 * n_docs)
        self.blocks = np.frombuffer(data, BLOCK, n_blocks, at)
        at += BLOCK.itemsize * n_blocks
        self.states = np.frombuffer(data, "<u8", n_blocks * self.lanes, at).reshape(n_blocks, self.lanes)
        at += 8 * n_blocks * self.lanes
        self.words = np.frombuffer(data[at:-4], "<u4") if at < len(data) - 4 else np.zeros(0, np.uint32)

    def ids(self, first: int = 0, last: int | None = None) -> np.ndarray:
        """Ids of the blocks first to last (exclusive), each checked against its checksum."""
        chosen = self.blocks[first:last]
        for k, b in enumerate(chosen):
            o = int(b["offset"])
            if zlib.crc32(self.words[o : o + int(b["words"])].tobytes(), zlib.crc32(self.states[first + k].tobytes())) != b["crc"]:
                raise Corrupt(f"checksum of block {first + k}")
        return self.symbols[decode_blocks(self.states[first:last], self.words, chosen["offset"], chosen["tokens"].astype(np.int64), self.freq, self.block)] if len(chosen) else np.zeros(0, np.uint32)


# -- tokens ----------------------------------------------------------------------------------------

#: Code points on whose class regular-expression engines may differ: such texts go to the library whole.
ODD = re.compile("[\x00-\x08\x0e-\x1f\x7f-\x9f\xa0ɐ-\U0010ffff]")
#: Cuts that no piece of the byte-level pattern crosses: a word with the blank before it, and white space.
CUT = re.compile(r" ?[^\s]+|\s+(?!\S)|\s+")


#: Texts without these hold white space only as single blanks and line ends between words.
UNEVEN = ("  ", "\n\n", " \n", "\n ", "\t", "\r", "\x0b", "\x0c")
FIRST = "\x00"  # before a cut that has no blank before it; no plain text holds this character


def is_even(text: str) -> bool:
    return bool(text) and not text[0].isspace() and not text[-1].isspace() and not any([x in text for x in UNEVEN])


def uneven_cuts(text: str) -> list[str]:
    """A plain text's cuts: a word stands for itself with a blank before it, FIRST and a line end for what follows them."""
    return [c[1:] if c[0] == " " and c[1:2].strip() else FIRST + c for c in CUT.findall(text)]


def cut_lists(texts: list[str]) -> pa.LargeListArray:
    """The cuts of each plain text.  Splitting an even text at its blanks gives the same cuts, in native code."""
    even = [is_even(t) for t in texts]
    split = pc.split_pattern(pa.array([FIRST + t.replace("\n", " \n") for t, e in zip(texts, even, strict=True) if e], pa.large_string()), " ").cast(pa.large_list(pa.large_string()))
    if all(even):
        return split
    found = pa.array([uneven_cuts(t) for t, e in zip(texts, even, strict=True) if not e], pa.large_list(pa.large_string()))
    place = np.empty(len(texts), np.int64)
    even = np.array(even)
    place[even], place[~even] = np.arange(len(split)), len(split) + np.arange(len(found))
    return pa.concat_arrays([split, found]).take(pa.array(place))


def ids_array(data: np.ndarray, counts: np.ndarray) -> pa.LargeBinaryArray:
    """The bytes of so many ids each."""
    ends = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)]).astype(np.int64) * data.itemsize
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))])


MIX = U(0x9E3779B97F4A7C15)
BYTES_OF = np.array([(1 << 8 * k) - 1 for k in range(9)], U)  # the first k bytes of a word


def marks(cuts: pa.LargeStringArray) -> np.ndarray:
    """A hash of each cut's length and first 64 bytes; those who use it compare the cuts too."""
    offset = np.frombuffer(cuts.buffers()[1], np.int64, len(cuts) + 1, 8 * cuts.offset)
    data = np.append(np.frombuffer(cuts.buffers()[2], np.uint8)[offset[0] : offset[-1]], np.zeros(8, np.uint8))
    words = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
    start, size = offset[:-1] - offset[0], np.diff(offset)
    out = size.astype(U) * MIX
    for k in range(0, 64, 8):
        long = np.flatnonzero(size > k)
        if not len(long):
            break
        h = (out[long] ^ (words[start[long] + k] & BYTES_OF[np.minimum(size[long] - k, 8)])) * MIX
        out[long] = h ^ h >> U(29)
    return out


def raw_cut(cut: str) -> str:
    return cut[1:] if cut[0] == FIRST else cut if cut[0] == "\n" else " " + cut


class ByteCodec:
    """The library's byte-level encoder, with the ids of cuts that a worker has seen kept.

    The cuts and their ids are Arrow arrays, found by a sorted array of marks, so Python meets no cut by itself.  When they grow past
    KNOWN or KNOWN_BYTES, the half that was met last stays.
    """

    KNOWN = 1_500_000
    KNOWN_BYTES = 128 << 20  # so many cuts of prose take 50 MB with their ids; long ones may take more
    JOINED = 1_000  # cuts in a text that the library gets

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab()
        self.dtype = np.dtype("<u2" if max(vocabulary.values()) < 1 << 16 else "<u4")
        self.width = np.zeros(max(vocabulary.values()) + 1, np.int64)  # bytes of each id: a character of its name stands for one
        for name, i in vocabulary.items():
            self.width[i] = len(name)
        self.line_end = self.library(["\n"])[0]
        self.forget()

    def forget(self) -> None:
        self.cuts, self.ids = pa.array([], pa.large_string()), pa.array([], pa.large_binary())
        self.marks, self.place = np.zeros(0, U), np.zeros(0, np.int64)  # in ascending order, and where in cuts each stands
        self.met, self.call = np.zeros(0, np.int32), 0

    def library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def of_joined(self, cuts: pa.LargeStringArray, sizes: np.ndarray, first: np.ndarray) -> pa.LargeBinaryArray:
        """The ids of different cuts that hold a word, by few calls: no piece crosses the ends of cuts, and bytes tell which ids are whose.

        A line end goes before a cut that has no blank before it, and its id is dropped.
        """
        at = np.append(np.arange(0, len(cuts), self.JOINED), len(cuts))
        lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), cuts)
        texts = [(" " + t).replace(" \n", "\n").replace(" " + FIRST, "\n") for t in pc.binary_join(lists, pa.scalar(" ", pa.large_string())).to_pylist()]
        if not any(s in t for t in texts for s in self.special):
            ids = np.concatenate([np.array(e.ids, self.dtype) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)])
            ends, upto = np.cumsum(self.width[ids]), np.cumsum(sizes)
            last = np.searchsorted(ends, upto)
            if len(ids) and ends[-1] == upto[-1] and (ends[last] == upto).all():
                begin = np.concatenate([[0], last[:-1] + 1])
                drop = begin[first]
                if ids[drop].tobytes() == self.line_end * len(drop):
                    return ids_array(np.delete(ids, drop), last + 1 - begin - first)
        return pa.array(self.library([raw_cut(c) for c in cuts.to_pylist()]), pa.large_binary())

    def of_cuts(self, cuts: pa.LargeStringArray) -> pa.LargeBinaryArray:
        """The ids of different cuts."""
        if not len(cuts):
            return pa.array([], pa.large_binary())
        offset = np.frombuffer(cuts.buffers()[1], np.int64, len(cuts) + 1, 8 * cuts.offset)
        data = np.frombuffer(cuts.buffers()[2], np.uint8)
        head, sizes = data[offset[:-1]], np.diff(offset)
        first = head == ord(FIRST)
        space = first.copy()
        space[first] = np.isin(data[offset[:-1][first] + 1], np.frombuffer(b" \t\n\r\x0b\x0c", np.uint8))
        sizes = sizes + (~first & (head != ord("\n")))
        if not space.any():
            return self.of_joined(cuts, sizes, first)
        parts = [pa.array(self.library([raw_cut(c) for c in cuts.filter(pa.array(space)).to_pylist()]), pa.large_binary())]
        if not space.all():
            parts.append(self.of_joined(cuts.filter(pa.array(~space)), sizes[~space], first[~space]))
        place = np.empty(len(cuts), np.int64)
        place[np.concatenate([np.flatnonzero(space), np.flatnonzero(~space)])] = np.arange(len(cuts))
        return pa.concat_arrays(parts).take(pa.array(place))

    def places_of(self, cuts: pa.LargeStringArray) -> np.ndarray:
        """Where different cuts stand among the kept ones; new ones are added."""
        mark = marks(cuts)
        order = np.argsort(mark)
        at = np.minimum(np.searchsorted(self.marks, mark[order]), max(0, len(self.marks) - 1))
        there = np.flatnonzero(self.marks[at] == mark[order]) if len(self.marks) else np.zeros(0, np.int64)
        found, rows = self.place[at[there]], order[there]
        same = pc.equal(self.cuts.take(pa.array(found)), cuts.take(pa.array(rows))).to_numpy(zero_copy_only=False)
        place = np.full(len(cuts), -1, np.int64)
        place[rows[same]] = found[same]
        new = np.flatnonzero(place < 0)
        if len(new):
            place[new] = len(self.cuts) + np.arange(len(new))
            some = cuts.take(pa.array(new))
            self.ids, self.cuts = pa.concat_arrays([self.ids, self.of_cuts(some)]), pa.concat_arrays([self.cuts, some])
            self.met = np.append(self.met, np.zeros(len(new), np.int32))
            order = new[np.argsort(mark[new])]
            at = np.searchsorted(self.marks, mark[order])
            self.marks, self.place = np.insert(self.marks, at, mark[order]), np.insert(self.place, at, place[order])
        self.call += 1
        self.met[place] = self.call
        return place

    def shrink(self, count: int) -> None:
        """Keep so many cuts, those met last."""
        if not count:
            return self.forget()
        stay = np.sort(np.argsort(-self.met, kind="stable")[:count])
        self.cuts, self.ids, self.met = self.cuts.take(pa.array(stay)), self.ids.take(pa.array(stay)), self.met[stay]
        self.marks = marks(self.cuts)
        self.place = np.argsort(self.marks)
        self.marks = self.marks[self.place]

    def of_plain(self, texts: list[str]) -> list[bytes]:
        lists = cut_lists(texts)
        flat = lists.flatten()
        if not len(flat):
            return [b""] * len(texts)
        flat = flat.dictionary_encode()
        place = pa.array(self.places_of(flat.dictionary))
        ids = self.ids.take(place).take(flat.indices)
        while len(self.cuts) > self.KNOWN or len(self.cuts) and self.cuts.nbytes + self.ids.nbytes > self.KNOWN_BYTES:
            self.shrink(min(self.KNOWN, len(self.cuts)) // 2)
        ends = np.frombuffer(ids.buffers()[1], np.int64, len(ids) + 1, 8 * ids.offset)
        first = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
        data, at = memoryview(ids.buffers()[2] or b""), ends[first].tolist()
        return [bytes(data[s:e]) for s, e in zip(at, at[1:], strict=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian 32-bit words."""
        return [np.frombuffer(x, self.dtype).astype("<u4").tobytes() for x in self.packed(texts)]

    def packed(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian words of the width of `dtype`."""
        plain = [not ODD.search(t) and not any([s in t for s in self.special]) for t in texts]
        cut = iter(self.of_plain([t for t, p in zip(texts, plain, strict=True) if p]) if any(plain) else ())
        whole = iter(self.library([t for t, p in zip(texts, plain, strict=True) if not p]))
        return [next(cut if p else whole) for p in plain]


_codecs: dict[str, ByteCodec] = {}


def codec_at(path: str) -> ByteCodec:
    if path not in _codecs:
        _codecs[path] = ByteCodec(path)
    return _codecs[path]


def slices(texts: list[str], chars: int = 16_000_000) -> Iterator[tuple[int, int]]:
    start, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= chars:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def tokens(df: DataFrame, path: str, splits: list[int], end: int = 0) -> DataFrame:
    """place (of the range), doc_id and ids (16 or 32-bit words) of every row, the end id appended."""

    def run(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        gc.disable()  # nothing here makes cycles, and the collector would walk the remembered cuts again and again
        try:
            yield from encoded(batches)
        finally:
            gc.enable()

    def encoded(batches):
        codec = codec_at(path)
        tail = np.array([end], codec.dtype).tobytes()
        kind = b"\x00" if codec.dtype.itemsize == 2 else b"\x01"
        for batch in batches:
            ids = np.array([common.NO_ID if i is None else i for i in batch.column("doc_id").to_pylist()], np.int64)
            place = np.searchsorted(np.array(splits, np.int64), ids, side="right")
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for a, b in slices(texts):
                made = [b"".join((kind, x, tail)) for x in codec.packed(texts[a:b])]
                yield pa.RecordBatch.from_arrays([pa.array(place[a:b].astype(np.int32)), pa.array(ids[a:b]), pa.array(made, pa.binary())], names=["place", "doc_id", "ids"])

    return common.id_and_text(df, LIBRARY_ROWS).mapInArrow(run, "place int, doc_id long, ids binary")


def widen(data: bytes) -> np.ndarray:
    """Ids from 16-bit words behind a zero byte, or 32-bit words behind a one byte."""
    return np.frombuffer(data, "<u4" if data[0] else "<u2", offset=1).astype(np.uint32)


FILES = "place int, seq int, documents long, tokens long, bytes binary"


def files_of(rows: Iterable[tuple[int, int, bytes]], limit: int) -> Iterator[tuple]:
    """Files of rows (place, doc_id, ids) that come in order."""
    place, seq, ids, parts, held = None, 0, [], [], 0

    def made():
        flat = np.concatenate(parts)
        return place, seq, len(ids), len(flat), write_file(np.array(ids, np.int64), np.array([len(p) for p in parts]), flat)

    for p, i, data in rows:
        if ids and (p != place or held >= limit):
            yield made()
            seq, ids, parts, held = seq + 1 if p == place else 0, [], [], 0
        place = p
        ids.append(i)
        parts.append(widen(data))
        held += len(parts[-1])
    if ids:
        yield made()


def encode_files(df: DataFrame, path: str, end: int = 0, file_tokens: int = FILE_TOKENS) -> DataFrame:
    """The token files of df's documents, in ascending doc_id order by (place, seq)."""
    docs = common.id_and_text(df, LIBRARY_ROWS)
    splits, _ = common.range_splits(docs, common.partitions_for(df, RANGE_BYTES))

    def run(batches):
        rows = (r for batch in batches for r in zip(*(batch.column(n).to_pylist() for n in ("place", "doc_id", "ids")), strict=True))
        for f in files_of(rows, file_tokens):
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(f, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["place", "seq", "documents", "tokens", "bytes"])

    return tokens(docs, path, splits, end).repartitionById(len(splits) + 1, F.col("place")).sortWithinPartitions("place", "doc_id", "ids").mapInArrow(run, FILES)


def write_files(files: DataFrame, folder: str) -> None:
    """The files are compressed already, so Parquet stores them as they are."""
    files.write.mode("overwrite").option("compression", "none").parquet(folder)


def read_files(spark, folder: str) -> DataFrame:
    return spark.read.schema(FILES).parquet(folder)


STRETCH = 1024  # ranges whose files are numbered together


def offsets(files: DataFrame) -> DataFrame:
    """place, seq, before: the ids in all files before.  Files are summed up by stretches of ranges, then stretches by one row each."""
    counts = files.select("place", "seq", "tokens", F.expr(f"place div {STRETCH}").alias("stretch"))
    upto = lambda w: F.coalesce(F.sum("tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    whole = counts.groupBy("stretch").agg(F.sum("tokens").alias("tokens")).select("stretch", upto(Window.orderBy("stretch")).alias("start"))
    return counts.withColumn("inner", upto(Window.partitionBy("stretch").orderBy("place", "seq"))).join(whole, "stretch").select("place", "seq", (F.col("start") + F.col("inner")).alias("before"))


def decode_files(files: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens and ids_crc32 of every document in the files.

    The counts of the files before come from their columns alone.
    """

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                f = TokenFile(batch.column("bytes")[k].as_py())
                ids = f.ids().astype("<u4")
                ends = np.cumsum(f.counts.astype(np.int64))
                starts = ends - f.counts
                crc = [zlib.crc32(ids[s:e].tobytes()) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
                doc_ids = pa.array([None if i == common.NO_ID else i for i in f.doc_ids.tolist()], pa.int64())
                yield pa.RecordBatch.from_arrays([doc_ids, pa.array(starts + batch.column("before")[k].as_py()), pa.array(f.counts.astype(np.int64)), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.join(offsets(files), ["place", "seq"]).select("bytes", "before").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
