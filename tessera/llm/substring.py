"""Removal of repeated word passages by recompression.

Every window of `WINDOW` = 13 words whose word sequence also starts in a document with a smaller doc_id is
removed, judged on the input.

Recompression replaces a text by ever fewer symbols, level by level: a maximal run of one symbol becomes one
symbol, then each left symbol followed by a right one (a bit of its name decides) becomes one.  Names
are global: each level is a Spark round in which chunks of documents send the distinct words, runs and
pairs that they have, ranges of these number the ones that two documents share, and the numbers come
back.  So equal substrings get equal symbols except near their ends; each symbol carries the extent of
words that decides it (its context).  What no two documents share gets no name.  It ends every symbol
beside it, and no window that holds its context can repeat, so later levels work on what is left.

1. Documents are packed into chunks of about `chunk_bytes`, dealt by chunk and written once.  Answers go to where their chunk
   lies, by a shuffle of their own; nothing is broadcast and no chunk moves again.
2. A round names the words, which chunks send as 96-bit digests.  What of a chunk lies in windows all of whose words
   have names is written as its live part, a tenth of the words or so, closed up for what follows; `LEVELS` more rounds name its runs and pairs.
3. A window that holds no unnamed symbol of any level, and so may repeat, is led by one of its interior symbols: of the
   highest of the first `LEADING` levels that has any the one that comes first in a random order of names; so equal
   windows have equal leaders.
   Neighbouring windows under one leader go together as one row of word names to the range of the leader.
4. There windows under equal leaders are compared name by name, and each gets back whether a smaller doc_id
   has it.  What marking needs of the groups goes along with one of the chunk's rows and comes back with its answer, so the parse is not made again.  The
   words of removed windows are marked, and chunks hash the rest.

What is sent is made distinct by chunk, so a passage in a third of all documents is one entry a chunk; no
list of its occurrences meets in one task.  There are at most as many rows as entries.

Defined results
    null or empty text     no words
    fewer than 13 words    nothing removed
    very long text         a chunk of its own
    null doc_id            smaller than any id
    repeated rows          one document: equal ids do not remove each other's windows
    unlike texts of one id one document as well
    empty table            empty result
    extra columns          ignored
Memory in a worker: about 25 times max(chunk_bytes, the longest text), and one range of names.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WINDOW = 13
LEADING = 2  # levels, words included, of whose symbols one leads a window; longer ones leave little choice, so fewer neighbours would share a leader
LEVELS = 3  # of runs and pairs; the contexts of a fourth are longer than a window, so none of its symbols would be interior
CHUNK_BYTES = 2 << 20
RANGE_BYTES = 16 << 20  # of input for one range of names
LONG_WORD = 32  # bytes; longer words are hashed one by one

U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: The first 0 to 8 bytes of a little-endian word.
MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], U)
#: Two independent odd multipliers, for names and for the second half of window digests.
BASES = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_powers: dict[tuple[int, bool], np.ndarray] = {}


def powers(base: int, n: int, inverse: bool = False) -> np.ndarray:
    """base**0 .. base**(n - 1) modulo 2**64, or their inverses; kept and grown as asked for."""
    have = _powers.get((base, inverse))
    if have is None or len(have) < n:
        step = pow(base, -1, 2**64) if inverse else base
        full = np.full(max(n, 1 << 16), step, U)
        full[0] = 1
        _powers[base, inverse] = have = np.multiply.accumulate(full)
    return have[:n]


class RangeHash:
    """Hashes of ranges of a sequence of 64-bit words, by prefix sums."""

    def __init__(self, values: np.ndarray, base: int):
        self.sums = np.zeros(len(values) + 1, U)
        np.cumsum(values * powers(base, len(values)), out=self.sums[1:])
        self.inverse = powers(base, len(values) + 1, inverse=True)

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix((self.sums[stop] - self.sums[start]) * self.inverse[start] + (stop - start).astype(U) * U(0xA24BAED4963EE407))


def word_extents(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and stops of the maximal runs without white space."""
    blank = SPACE[data]
    edge = np.flatnonzero(np.diff(blank, prepend=True, append=True))
    return edge[0::2], edge[1::2]


class Words:
    """The words of a chunk: positions, hashes and documents.  Two marks separate documents from each other."""

    def __init__(self, texts: list[bytes]):
        self.texts = texts
        self.data = np.frombuffer(b" ".join([*texts, b""]) + bytes(LONG_WORD + 8), np.uint8)
        starts, stops = word_extents(self.data[: -LONG_WORD - 8])
        size = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        owner = np.searchsorted(np.cumsum(size), starts, side="right")
        self.count = np.bincount(owner, minlength=len(texts))
        self.first = np.cumsum(self.count) - self.count  # of each document, among words
        self.starts, self.stops, self.owner = starts, stops, owner
        # slots hold the words of each document between two marks before and after it
        self.slot = np.arange(len(starts)) + 2 * (owner + 1)
        self.slots = len(starts) + 2 * len(texts) + 2
        self.made: dict[int, np.ndarray] = {}

    def hashes(self, base: int) -> np.ndarray:
        """A name for each slot; marks get names of their own, so none repeats.

        A word's bytes are read eight at a time, with what lies behind its end masked out.
        """
        if base in self.made:
            return self.made[base]
        out = mix(np.arange(self.slots, dtype=U) ^ U(base))
        size = self.stops - self.starts
        eights = np.ndarray((len(self.data) - 7,), "<u8", self.data, 0, (1,))
        values = mix(size.astype(U) ^ U(base))
        for lane in range(0, LONG_WORD, 8):
            has = np.flatnonzero(size > lane)
            values[has] = mix((values[has] ^ (eights[self.starts[has] + lane] & MASKS[np.minimum(size[has] - lane, 8)])) + U(base))
        for k in np.flatnonzero(size > LONG_WORD).tolist():
            values[k] = xxhash.xxh64_intdigest(self.data[self.starts[k] : self.stops[k]].tobytes(), base & 0xFFFFFFFF)
        out[self.slot] = values
        self.made[base] = out
        return out


def parted(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Slot and document of each word, and the count of slots: two marks stand before and after each document."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return np.arange(len(owner)) + 2 * (owner + 1), owner, len(owner) + 2 * len(counts) + 2


def distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ascending distinct values, and each value's place among them; only the distinct ones are sorted."""
    coded = pa.array(values).dictionary_encode()
    found = coded.dictionary.to_numpy()
    order = np.argsort(found)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return found[order], place[coded.indices.to_numpy()]


class Level:
    """A level of the parse: names (0: none), first slots, and the slots from `low` to `high` that each symbol's form depends on."""

    def __init__(self, name: np.ndarray, at: np.ndarray, low: np.ndarray, high: np.ndarray):
        self.name, self.at, self.low, self.high = name, at, low, high

    def within(self, windows: np.ndarray, slots: int) -> Level:
        """Without the names of symbols that lie in none of the windows; of stretches without names the ends stay."""
        upto = np.concatenate([[0], np.cumsum(np.bincount(windows, minlength=slots))])
        held = (self.high - self.low < WINDOW) & (upto.take(self.low + 1) > upto.take(np.maximum(self.high - WINDOW + 1, 0)))
        name = np.where(held, self.name, U(0))
        known = name != 0
        keep = known.copy()
        keep[1:] |= known[:-1]
        keep[:-1] |= known[1:]
        keep[0] = True  # a level is never empty
        keep = np.flatnonzero(keep)
        return Level(*(x.take(keep) for x in (name, self.at, self.low, self.high)))

    def step(self, level: int) -> Step:
        """Runs, then pairs, with a key for each that needs a name."""
        n = len(self.name)
        same = (self.name[1:] == self.name[:-1]) & (self.name[1:] != 0)
        head = np.flatnonzero(np.concatenate([[True], ~same]))
        length = np.diff(np.append(head, n))
        name = self.name.take(head)
        key, run = name.copy(), np.flatnonzero(length > 1)
        key[run] = mix(name[run] + length[run].astype(U) * U(0x8EBC6AF09C88C6E3))
        low, high = self.low.take(np.maximum(head - 1, 0)), self.high.take(np.minimum(head + length, n - 1))
        n = len(head)
        known = name != 0
        left = (mix(key ^ U(0x589965CC75374CC3 + level)) & U(1)).astype(bool)
        opens = np.zeros(n, bool)
        opens[:-1] = known[:-1] & known[1:] & left[:-1] & ~left[1:]
        closes = np.zeros(n, bool)
        closes[1:] = opens[:-1]
        at = np.flatnonzero(~closes)
        after, before = np.minimum(at + 1, n - 1), np.maximum(at - 1, 0)
        paired, left = opens.take(at), left.take(at)
        asked = known.take(at) & (paired | (length.take(at) > 1))
        of, pair = key.take(at[asked]), paired[asked]
        of[pair] = mix(of[pair] * U(3) + mix(key.take(after[asked][pair]) + U(level)))
        # a single left symbol is known by its successor, a single right one by its predecessor
        return Step(name.take(at), self.at.take(head.take(at)), low.take(np.where(left, at, before)), high.take(np.where(left, after, at)), asked, of)


class Step(Level):
    """The next level before its round: `asked` marks the symbols that wait for a name, `key` says what they are."""

    def __init__(self, name, at, low, high, asked: np.ndarray, key: np.ndarray):
        super().__init__(name, at, low, high)
        self.asked, self.key = asked, key

        self.keys, self.of_key = np.unique(key >> U(1), return_inverse=True)

    def entries(self, doc: np.ndarray) -> np.ndarray:
        """Ascending distinct keys; the lowest bit says whether two documents of the chunk have it.  doc: document id of each slot."""
        return (self.keys << U(1)) | two_documents(self.of_key, doc[self.at[self.asked]], len(self.keys)).astype(U)

    def named(self, names: np.ndarray) -> tuple[Level, np.ndarray, np.ndarray]:
        """The level with the round's names, and low and high of the symbols that got none."""
        name = self.name.copy()
        name[self.asked] = names[self.of_key]
        lost = self.asked & (name == 0)
        return Level(name, self.at, self.low, self.high), self.low[lost], self.high[lost]


def two_documents(inverse: np.ndarray, ids: np.ndarray, count: int) -> np.ndarray:
    """Whether rows of two ids have each value."""
    low, high = np.full(count, np.iinfo(np.int64).max), np.full(count, np.iinfo(np.int64).min)
    np.minimum.at(low, inverse, ids)
    np.maximum.at(high, inverse, ids)
    return low < high


WORD_ENTRY = np.dtype([("a", "<u8"), ("b", "<u4")])


def distinct_words(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """The ascending table of a chunk's distinct words, and each word's place in it."""
    a, b = (words.hashes(base)[words.slot].astype(WORD_ENTRY[n]) for n, base in zip("ab", BASES, strict=True))
    names, codes = distinct(a)
    out = np.empty(len(names), WORD_ENTRY)
    out["a"] = names
    out["b"][codes] = b
    if (out["b"][codes] == b).all():
        return out, codes
    order = np.lexsort((b, a))  # two words share the first half
    new = np.concatenate([[True], (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])])[: len(order)]
    codes[order] = np.cumsum(new) - 1
    out = np.empty(int(new.sum()), WORD_ENTRY)
    out["a"], out["b"] = a[order][new], b[order][new]
    return out, codes


def word_entries(table: np.ndarray, codes: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The table; the lowest bit of b says whether two documents of the chunk have the word.  ids: of each word's document."""
    out = table.copy()
    out["b"] = (out["b"] & ~np.uint32(1)) | two_documents(codes, ids, len(out))
    return out


class Parse:
    """The levels that the rounds' names make of a chunk, and which windows symbols without a name rule out."""

    def __init__(self, word: np.ndarray, doc: np.ndarray):
        """Name (0: none) and document id of each slot."""
        self.word, self.doc, every = word, doc, np.arange(len(word))
        self.change = np.zeros(len(word) + 1, np.int64)
        self.levels: list[Level] = []
        dead = every[word == 0]
        self.take(Level(word, every, every, every), dead, dead)

    def live(self) -> np.ndarray:
        """Ascending slots that windows which may repeat cover."""
        return np.flatnonzero(covered(self.windows(), len(self.word)))

    def take(self, level: Level, low: np.ndarray, high: np.ndarray) -> None:
        """The next level; low and high: of symbols that a round gave no name."""
        self.rule_out(low, high)
        self.levels.append(level)
        self.next: Step | None = None

    @property
    def waits(self) -> Step:
        """The step after the last level, which first loses what lies in no window that may repeat; made when it is asked for."""
        if self.next is None:
            self.levels[-1] = self.levels[-1].within(self.windows(), len(self.word))
            self.next = self.levels[-1].step(len(self.levels) - 1)
        return self.next

    def rule_out(self, low: np.ndarray, high: np.ndarray) -> None:
        inside = high - low < WINDOW
        self.change += np.bincount(np.maximum(high[inside] - WINDOW + 1, 0), minlength=len(self.change))
        self.change -= np.bincount(low[inside] + 1, minlength=len(self.change))

    def add(self, names: np.ndarray) -> None:
        """names: of the entries of `waits`, in order."""
        self.take(*self.waits.named(names))

    def windows(self) -> np.ndarray:
        """First slots of the windows that may repeat."""
        return np.flatnonzero(np.cumsum(self.change)[: max(0, len(self.change) - WINDOW)] == 0)


def covered(begin: np.ndarray, slots: int) -> np.ndarray:
    """A flag for each slot: one of the windows (given by first slots) covers it."""
    change = np.bincount(begin, minlength=slots + WINDOW) - np.bincount(begin + WINDOW, minlength=slots + WINDOW)
    return np.cumsum(change)[:slots] > 0


class Groups:
    """Neighbouring windows of a chunk under one leader, and the distinct ones among these groups."""

    def __init__(self, parse: Parse):
        self.word = parse.word
        begin = parse.windows()
        leader, at = leaders(parse.levels[:LEADING], begin)
        head = np.flatnonzero(np.concatenate([[True], (begin[1:] != begin[:-1] + 1) | (at[1:] != at[:-1])]))[: len(begin)]
        self.begin, self.leader = begin[head], leader[head]
        self.size = np.diff(np.append(head, len(begin)))
        self.doc = parse.doc[self.begin]
        ranges = RangeHash(mix(self.word), BASES[0])
        content = ranges.of(self.begin, self.begin + self.size + WINDOW - 1)
        order = np.lexsort((content, mix(self.leader)))
        o = order
        alike = (self.leader[o[1:]] == self.leader[o[:-1]]) & (content[o[1:]] == content[o[:-1]]) & (self.size[o[1:]] == self.size[o[:-1]])
        alike[alike] = self.equal(o[1:][alike], o[:-1][alike])  # the digest only proposes
        new = np.concatenate([[True], ~alike])[: len(o)]
        self.entry = np.empty(len(o), np.int64)
        self.entry[o] = np.cumsum(new) - 1
        self.first = o[new]
        self.least = np.full(len(self.first), np.iinfo(np.int64).max)
        np.minimum.at(self.least, self.entry, self.doc)

    def spread(self, of: np.ndarray) -> np.ndarray:
        """The slots of the words of the groups, one group after the other."""
        size = self.size[of] + WINDOW - 1
        return np.repeat(self.begin[of] - (np.cumsum(size) - size), size) + np.arange(size.sum())

    def equal(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether groups of equal size have the same words."""
        if not len(a):
            return np.zeros(0, bool)
        size = self.size[a] + WINDOW - 1
        return np.logical_and.reduceat(self.word[self.spread(a)] == self.word[self.spread(b)], np.cumsum(size) - size)

    def places(self, parts: int) -> np.ndarray:
        return place_of(mix(self.leader[self.first]), parts)

    def packed(self, start: int, stop: int) -> bytes:
        of = self.first[start:stop]
        size = self.size[of].astype(np.uint8)
        return len(of).to_bytes(4, "little") + zstandard.ZstdCompressor(level=1).compress(size.tobytes() + self.least[start:stop].tobytes() + self.word[self.spread(of)].tobytes())

    def side(self) -> bytes:
        """What `removed_windows` needs of the groups: first slots, windows, entries, and whether the group's id is above its entry's least."""
        begin = np.diff(self.begin, prepend=0).astype(np.uint32)
        above = np.packbits(self.doc > self.least[self.entry])
        parts = (begin, self.size.astype(np.uint8), self.entry.astype(np.uint32), above)
        return len(begin).to_bytes(4, "little") + zstandard.ZstdCompressor(level=1).compress(b"".join(x.tobytes() for x in parts))


def removed_windows(side: bytes, bits: list[tuple[int, bytes]]) -> np.ndarray:
    """First slots of the removed windows of a chunk.  bits: the ranges' answers, for each window of each entry whether a smaller id than the entry's least has it."""
    n, data = int.from_bytes(side[:4], "little"), zstandard.ZstdDecompressor().decompress(side[4:])
    begin = np.cumsum(np.frombuffer(data, np.uint32, n), dtype=np.int64)
    size = np.frombuffer(data, np.uint8, n, 4 * n).astype(np.int64)
    entry = np.frombuffer(data, np.uint32, n, 5 * n).astype(np.int64)
    above = np.unpackbits(np.frombuffer(data, np.uint8, offset=9 * n), count=n).astype(bool)
    of_entry = np.zeros(int(entry.max(initial=-1)) + 1, np.int64)
    of_entry[entry] = size  # groups of one entry are of one size
    flags = gathered(bits, int(of_entry.sum()))
    at = np.cumsum(of_entry) - of_entry
    offset = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    gone = flags[np.repeat(at[entry], size) + offset] | np.repeat(above, size)
    return (np.repeat(begin, size) + offset)[gone]


def leaders(levels: list[Level], begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Name of the leader of each window, and which symbol of all levels it is."""
    name, at = np.zeros(len(begin), U), np.full(len(begin), -1)
    shift = 0
    for level in reversed(levels):
        left = np.flatnonzero(at < 0)
        short = np.flatnonzero((level.name != 0) & (level.high - level.low < WINDOW))
        low, high, names = level.low[short], level.high[short], level.name[short]
        order = mix(names ^ U(0x1D8E4E27C47D124F))
        first = np.searchsorted(low, begin[left], side="left")
        last = np.searchsorted(high, begin[left] + WINDOW, side="left")
        rank = np.full(len(left), np.iinfo(U).max, U)
        best = np.full(len(left), -1)
        for step in range(int((last - first).max(initial=0))):
            inside = np.flatnonzero(first + step < last)
            value = order[first[inside] + step]
            better = value < rank[inside]
            inside = inside[better]
            rank[inside], best[inside] = value[better], first[inside] + step
        found = best >= 0
        name[left[found]], at[left[found]] = names[best[found]], short[best[found]] + shift
        shift += len(level.name)
    return name, at


# -- what chunks send and get back -----------------------------------------------------------------


def place_of(high: np.ndarray, parts: int) -> np.ndarray:
    """The range of names, of `parts` equal ones, that each name falls into; ascending with the name."""
    return ((high >> U(32)) * U(parts)) >> U(32)


def sliced(place: np.ndarray, parts: int) -> Iterator[tuple[int, int, int]]:
    """(range, start, stop) of the non-empty slices of ascending places."""
    if not len(place):
        return
    edge = np.flatnonzero(np.diff(place, prepend=place[:1] + U(1)))
    for s, e in zip(edge.tolist(), [*edge[1:].tolist(), len(place)], strict=True):
        yield int(place[s]), s, e


def number(level: int, place: int, rank: np.ndarray) -> np.ndarray:
    """Global names: of the level, the range that gave it, and the rank there."""
    return U((level + 1) << 58 | place << 34) | (rank + U(1))


def naming(shared: np.ndarray) -> bytes:
    """Which entries have a name, from ascending ranks of which -1 is none."""
    flags = shared >= 0
    return answer(flags) + zstandard.ZstdCompressor(level=1).compress(np.diff(shared[flags], prepend=0).astype("<u8").tobytes())


def gathered(bits: list[tuple[int, bytes]], count: int) -> np.ndarray:
    """The flags of all ranges, in the order in which the chunk's entries were sent; a range's head is its entry count."""
    out = [np.unpackbits(np.frombuffer(b[4:], np.uint8), count=int.from_bytes(b[:4], "little")) for _, b in sorted(bits)]
    return whole(np.concatenate(out).astype(bool) if out else np.zeros(0, bool), count)


def names_of(bits: list[tuple[int, bytes]], level: int, count: int) -> np.ndarray:
    """The names of the chunk's entries in the order in which they were sent, 0 for those without."""
    out = []
    for place, b in sorted(bits):
        n = int.from_bytes(b[:4], "little")
        stop = 4 + -(-n // 8)
        flags = np.unpackbits(np.frombuffer(b[4:stop], np.uint8), count=n).astype(bool)
        names = np.zeros(n, U)
        names[flags] = number(level, place, np.cumsum(np.frombuffer(zstandard.ZstdDecompressor().decompress(b[stop:]), "<u8"), dtype=U))
        out.append(names)
    return whole(np.concatenate(out) if out else np.zeros(0, U), count)


def whole(flat: np.ndarray, count: int) -> np.ndarray:
    if len(flat) != count:
        raise ValueError(f"{len(flat)} answers for {count} entries")
    return flat


def answer(flags: np.ndarray) -> bytes:
    return len(flags).to_bytes(4, "little") + np.packbits(flags).tobytes()


CHUNK = "chunk long, ids binary, sizes binary, packed binary"
LIVE = "chunk long, ids binary, counts binary, live binary, names binary"
SENT = "place int, chunk long, entries binary"
REPLY = "chunk long, place int, bits binary"
#: What the last round sends besides: the groups' side data, with one of a chunk's rows; ranges pass it on.
SIDE = ", side binary"


def batch_of(rows: list[tuple], names: str) -> pa.RecordBatch:
    """Rows under the names and types of a schema in words."""
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [f.split() for f in names.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[kind]) for k, (_, kind) in enumerate(fields)], names=[n for n, _ in fields])


def chunks(df: DataFrame, chunk_bytes: int) -> DataFrame:
    """Documents packed together, as they lie in the input's partitions."""

    def run(batches):
        pack = zstandard.ZstdCompressor(level=3).compress
        task, made = TaskContext.get().partitionId(), 0
        ids: list[int] = []
        texts: list[bytes] = []
        held = 0

        def flush():
            row = np.array(ids, np.int64).tobytes(), np.fromiter(map(len, texts), np.int64, len(texts)).tobytes(), b"".join(texts)
            return pa.RecordBatch.from_arrays([pa.array([(task << 32) + made], pa.int64()), *(pa.array([pack(x)], pa.binary()) for x in row)], names=["chunk", "ids", "sizes", "packed"])

        for batch in batches:
            for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                ids.append(common.NO_ID if i is None else i)
                texts.append(t or b"")
                held += len(texts[-1])
                if held >= chunk_bytes:
                    yield flush()
                    made += 1
                    ids.clear()
                    texts.clear()
                    held = 0
        if ids:
            yield flush()

    return common.id_and_text(df).mapInArrow(common.lean(run), CHUNK)


def judged(sent: DataFrame, parts: int, judge) -> DataFrame:
    """chunk, place, bits: what each range answers to each chunk; written to the checkpoint folder.

    judge: from the entries of all chunks in one range to an answer for each chunk.  Further columns of sent come with the answers.
    """
    reply = REPLY + (SIDE if "side" in sent.columns else "")

    def run(batches):
        rows = [r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
        places: dict[int, list] = {}
        for place, chunk, entries, *rest in rows:
            places.setdefault(place, []).append((chunk, entries, *rest))
        for place, own in places.items():
            yield batch_of([(chunk, place, made, *rest) for (chunk, _, *rest), made in zip(own, judge([r[1] for r in own]), strict=True)], reply)

    return common.cut(sent.repartitionById(parts, F.col("place")).mapInArrow(common.lean(run), reply))


def split_flags(flags: np.ndarray, sizes: list[int]) -> list[np.ndarray]:
    return np.split(flags, np.cumsum(sizes)[:-1])


def ranked(parts: list[np.ndarray], same: np.ndarray, order: np.ndarray, twice: np.ndarray) -> list[bytes]:
    """Numbers for the values that two documents share.  order sorts all entries, same says which equal the one before them in it."""
    first = np.flatnonzero(~same)
    count = np.diff(np.append(first, len(order)))
    shared = (count > 1) | np.logical_or.reduceat(twice[order], first) if len(first) else np.zeros(0, bool)
    rank = np.where(shared, np.cumsum(shared) - 1, -1)
    out = np.empty(len(order), np.int64)
    out[order] = np.repeat(rank, count)
    return [naming(x) for x in split_flags(out, [len(p) for p in parts])]


def planes(ascending: np.ndarray) -> bytes:
    """Ascending 64-bit words as differences, byte after byte of all: the high ones are small and compress."""
    return np.diff(ascending, prepend=U(0)).view(np.uint8).reshape(-1, 8).T.tobytes()


def from_planes(data: bytes, count: int) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(data, np.uint8, 8 * count).reshape(8, count).T).view("<u8").ravel(), dtype=U)


def pack_words(entries: np.ndarray) -> bytes:
    return len(entries).to_bytes(4, "little") + zstandard.ZstdCompressor(level=1).compress(planes(entries["a"]) + entries["b"].tobytes())


def unpack_words(blob: bytes) -> np.ndarray:
    n, data = int.from_bytes(blob[:4], "little"), zstandard.ZstdDecompressor().decompress(blob[4:])
    out = np.empty(n, WORD_ENTRY)
    out["a"], out["b"] = from_planes(data, n), np.frombuffer(data, np.uint32, n, 8 * n)
    return out


def pack_symbols(entries: np.ndarray) -> bytes:
    return len(entries).to_bytes(4, "little") + zstandard.ZstdCompressor(level=1).compress(planes(entries))


def unpack_symbols(blob: bytes) -> np.ndarray:
    return from_planes(zstandard.ZstdDecompressor().decompress(blob[4:]), int.from_bytes(blob[:4], "little"))


def judge_words(blobs: list[bytes]) -> list[bytes]:
    """Names of words that one chunk has in two documents, or that two chunks sent."""
    parts = [unpack_words(b) for b in blobs]
    entries = np.concatenate(parts)
    a, b = entries["a"], entries["b"] >> np.uint32(1)
    order = np.lexsort((b, a))
    same = np.concatenate([[False], (a[order][1:] == a[order][:-1]) & (b[order][1:] == b[order][:-1])])
    return ranked(parts, same, order, (entries["b"] & np.uint32(1)).astype(bool))


def judge_symbols(blobs: list[bytes]) -> list[bytes]:
    """Names of runs and pairs that one chunk has in two documents, or that two chunks sent."""
    parts = [unpack_symbols(b) for b in blobs]
    entries = np.concatenate(parts)
    keys = entries >> U(1)
    order = np.argsort(keys, kind="stable")
    same = np.concatenate([[False], keys[order][1:] == keys[order][:-1]])
    return ranked(parts, same, order, (entries & U(1)).astype(bool))


def unpack_groups(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows, least ids and word names of a chunk's groups."""
    n, data = int.from_bytes(blob[:4], "little"), zstandard.ZstdDecompressor().decompress(blob[4:])
    return np.frombuffer(data, np.uint8, n).astype(np.int64), np.frombuffer(data, np.int64, n, n), np.frombuffer(data, U, offset=9 * n)


def judge_windows(blobs: list[bytes]) -> list[bytes]:
    """For each window of each group, whether a smaller doc_id than the group's least has the same words."""
    parts = [unpack_groups(b) for b in blobs]
    size, least, word = (np.concatenate(x) for x in zip(*parts, strict=True))
    total, long = int(size.sum()), size + WINDOW - 1
    at = np.repeat(np.cumsum(long) - long - (np.cumsum(size) - size), size) + np.arange(total)  # of each window's first word
    least = np.repeat(least, size)
    seed, digest = mix(word), np.zeros(total, U)
    for k in range(WINDOW):
        digest = digest * U(BASES[0]) + seed[at + k]
    order = np.lexsort((least, digest))
    near = digest[order][1:] == digest[order][:-1]
    for k in range(WINDOW):  # the digest only sorts: windows are equal if their words are
        x = word[at + k][order]
        if (near & (x[1:] != x[:-1])).any():
            order = np.lexsort((least, *(word[at + j] for j in range(WINDOW))))
            near = np.ones(max(0, total - 1), bool)
            for j in range(WINDOW):
                x = word[at + j][order]
                near &= x[1:] == x[:-1]
            break
    new = np.concatenate([[True], ~near])[:total]
    flags = np.empty(total, bool)
    ordered = least[order]
    flags[order] = ordered[np.flatnonzero(new)][np.cumsum(new) - 1] < ordered
    return [answer(f) for f in split_flags(flags, [int(p[0].sum()) for p in parts])]


def unpacked(data: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)


def rows_of(batches) -> Iterator[dict]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield {n: batch.column(n)[k].as_py() for n in batch.schema.names}


def texts_of(row: dict) -> tuple[np.ndarray, list[bytes]]:
    data, ends = zstandard.ZstdDecompressor().decompress(row["packed"]), np.cumsum(unpacked(row["sizes"], np.int64)).tolist()
    return unpacked(row["ids"], np.int64), [data[s:e] for s, e in zip([0, *ends], ends, strict=False)]


def answers_of(row: dict) -> dict[int, list[tuple[int, bytes]]]:
    """Answers by round."""
    out: dict[int, list[tuple[int, bytes]]] = {}
    for a in row["answers"] or []:
        out.setdefault(a["round"], []).append((a["place"], a["bits"]))
    return out


def documents_of_slots(ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
    slot, owner, slots = parted(counts)
    doc = np.zeros(slots, np.int64)
    doc[slot] = ids[owner]
    return doc


def live_row(row: dict) -> pa.RecordBatch:
    """What a chunk keeps for the later rounds: the names of the words in windows that may repeat."""
    pack = zstandard.ZstdCompressor(level=1).compress
    ids, texts = texts_of(row)
    words = Words(texts)
    table, codes = distinct_words(words)
    name = np.zeros(words.slots, U)
    name[words.slot] = names_of(answers_of(row).get(0, []), 0, len(table))[codes]
    parse = Parse(name, documents_of_slots(ids, words.count))
    live = parse.live()
    made = row["ids"], pack(words.count.astype(np.uint32).tobytes()), pack(np.diff(live, prepend=0).astype(np.uint32).tobytes()), pack(name[live].tobytes())
    return pa.RecordBatch.from_arrays([pa.array([row["chunk"]], pa.int64()), *(pa.array([x], pa.binary()) for x in made)], names=["chunk", "ids", "counts", "live", "names"])


def close_up(live: np.ndarray) -> np.ndarray:
    """New slots for ascending live ones: one slot without a name stands for each stretch between them, and one at either end."""
    return np.arange(len(live)) + np.cumsum(np.diff(live, prepend=-2) > 1)


def live_slots(row: dict) -> np.ndarray:
    return np.cumsum(unpacked(row["live"], np.uint32), dtype=np.int64)


def parsed(row: dict, rounds: int) -> Parse:
    """The parse of a live row, closed up, after so many rounds of runs and pairs; each round's entries are made again from the names of those before it."""
    live = live_slots(row)
    at = close_up(live)
    slots = int(at[-1]) + 2 if len(at) else 1
    word, doc = np.zeros(slots, U), np.zeros(slots, np.int64)
    word[at] = unpacked(row["names"], U)
    ends = np.cumsum(unpacked(row["counts"], np.uint32).astype(np.int64) + 2)  # of the slots of each document and the marks before it
    doc[at] = np.repeat(unpacked(row["ids"], np.int64), np.diff(np.searchsorted(live, ends), prepend=0))
    parse = Parse(word, doc)
    answers = answers_of(row) if rounds else {}
    for k in range(1, rounds + 1):
        parse.add(names_of(answers.get(k, []), k, len(parse.waits.keys)))
    return parse


def remove_repeats(df: DataFrame, chunk_bytes: int = CHUNK_BYTES, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 (and kept, the words left) of every row."""
    parts = common.partitions_for(df, RANGE_BYTES)

    def send_words(batches):
        for row in rows_of(batches):
            ids, texts = texts_of(row)
            words = Words(texts)
            table, codes = distinct_words(words)
            entries = word_entries(table, codes, ids[words.owner])
            yield batch_of([(p, row["chunk"], pack_words(entries[s:e])) for p, s, e in sliced(place_of(entries["a"], parts), parts)], SENT)

    def keep_live(batches):
        yield from map(live_row, rows_of(batches))

    def send_symbols(rounds: int):
        def send(batches):
            for row in rows_of(batches):
                parse = parsed(row, rounds)
                entries = parse.waits.entries(parse.doc)
                yield batch_of([(p, row["chunk"], pack_symbols(entries[s:e])) for p, s, e in sliced(place_of(entries, parts), parts)], SENT)

        return send

    def send_windows(batches):
        for row in rows_of(batches):
            groups = Groups(parsed(row, LEVELS))
            sent = [(p, row["chunk"], groups.packed(s, e)) for p, s, e in sliced(groups.places(parts), parts)]
            yield batch_of([(*r, groups.side() if k == 0 else None) for k, r in enumerate(sent)], SENT + SIDE)

    def mark(batches):
        """chunk and gone: a bit for each word that goes."""
        for row in rows_of(batches):
            slot, _, slots = parted(unpacked(row["counts"], np.uint32).astype(np.int64))
            gone, live = np.zeros(slots, bool), live_slots(row)
            if row["side"] is not None:  # else no window of the chunk may repeat
                at = close_up(live)
                begin = removed_windows(row["side"], answers_of(row)[LEVELS + 1])
                gone[live] = covered(begin, int(at[-1]) + 2)[at]
            bits = zstandard.ZstdCompressor(level=1).compress(np.packbits(gone[slot]).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([row["chunk"]], pa.int64()), pa.array([bits], pa.binary())], names=["chunk", "bits"])

    def finish(batches):
        for row in rows_of(batches):
            ids, texts = texts_of(row)
            split = [t.split() for t in texts]
            ends = np.cumsum([0, *map(len, split)]).tolist()
            gone = np.unpackbits(unpacked(row["bits"], np.uint8), count=ends[-1]).astype(bool)
            out: dict[str, list] = {n: [] for n in ("doc_id", "n_words", "n_removed", "kept_sha256", "kept")}
            for k, of_text in enumerate(split):
                own = gone[ends[k] : ends[k + 1]]
                lost = int(own.sum())
                kept = b" ".join([w for w, g in zip(of_text, own.tolist(), strict=True) if not g] if lost else of_text)
                for n, v in zip(out, (None if ids[k] == common.NO_ID else int(ids[k]), len(of_text), lost, sha256(kept).hexdigest(), kept.decode("utf-8", "replace") if with_text else None), strict=True):
                    out[n].append(v)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)], names=list(out))

    def joined(table: DataFrame, few: DataFrame) -> DataFrame:
        """The table with what few has of each chunk; only few moves."""
        own = few.repartition(parts, "chunk")
        if "round" in few.columns:
            side = [F.max("side").alias("side")] if "side" in few.columns else []
            own = own.groupBy("chunk").agg(F.collect_list(F.struct("round", "place", "bits")).alias("answers"), *side)
        return table.join(own.hint("shuffle_hash"), "chunk", "left")

    with common.brief_shuffles(df.sparkSession):
        packed = common.dealt(chunks(df, chunk_bytes), parts, "chunk")
        answers = judged(packed.mapInArrow(common.lean(send_words), SENT), parts, judge_words).withColumn("round", F.lit(0))
        live = common.dealt(joined(packed, answers).mapInArrow(common.lean(keep_live), LIVE), parts, "chunk")
        answers = None
        for k in range(LEVELS):
            made = judged((live if answers is None else joined(live, answers)).mapInArrow(common.lean(send_symbols(k)), SENT), parts, judge_symbols).withColumn("round", F.lit(k + 1))
            answers = made if answers is None else answers.unionByName(made)
        made = judged(joined(live, answers).mapInArrow(common.lean(send_windows), SENT + SIDE), parts, judge_windows).withColumn("round", F.lit(LEVELS + 1))
        marks = common.cut(joined(live.select("chunk", "counts", "live"), made).mapInArrow(common.lean(mark), "chunk long, bits binary"))
    done = joined(packed, marks).mapInArrow(common.lean(finish), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")
    return done if with_text else done.drop("kept")
