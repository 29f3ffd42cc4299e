"""BPE encoding and decoding with a pair occurrence index.

The text is cut at ASCII white space, which no token of these vocabularies crosses; the distinct cuts of a
batch are normalised and split into pieces as the vocabulary file says, and the distinct pieces that the
worker does not know yet are encoded together.  For them an index maps each adjacent pair that can be
merged to all its positions.  The ranks that occur wait in a heap and are applied in ascending order:
every position of the pair is merged, and the lists of the pairs to its left and right are updated.

A merge can in principle make a pair of a lower rank than its own; the pieces in which that happens are
encoded again one by one, so results equal those of the tokenizers library for any vocabulary.

Defined results
    null text        as the empty text: no ids, empty decoded text
    white space only no ids
    special tokens   their strings in a text become their ids, as in the library's default
    null doc_id      kept
    repeated rows    equal rows out
    empty table      empty result
    extra columns    ignored
Memory in a worker: the texts of one Arrow batch, twice about `KNOWN` remembered cuts, as many pieces (shared with them), and an index over
`INDEXED` pieces at a time.
"""

from __future__ import annotations

import gc
import heapq
import json
import re
from collections.abc import Callable, Iterable
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from . import common

KNOWN = 200_000
ENCODE_KNOWN = 15_000
INDEXED = 100_000
FREQUENT = 1500  # ranks below it have long lists of positions, which are merged as arrays
PLAIN = re.compile(rb"[\x21-\x7e]+")
ASCII_PIECE = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")
#: Latin letters that are composed already, and whose lower case is one letter of the same range.
LATIN = re.compile("[!-~À-ÖØ-öø-įı-ž]+")
LATIN_PIECE = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ž]+|[0-9]|[^a-zß-öø-ž0-9]+")
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def byte_characters() -> list[str]:
    """The characters that stand for bytes in byte-level vocabularies: printable ones for themselves, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b if b in plain else next(other)) for b in range(256)]


class PairIndexBPE:
    """Merge ranks of a BPE vocabulary, and the encoding of many pieces at once."""

    def __init__(self, vocab: dict[str, int], merges: Iterable[tuple[str, str]], word_end: str = ""):
        self.vocab, self.word_end, self.size = vocab, word_end, max(vocab.values()) + 1
        self.left, self.right, self.made, self.rank = [], [], [], {}
        for a, b in merges:
            r = len(self.made)
            self.left.append(vocab[a])
            self.right.append(vocab[b])
            self.made.append(vocab[a + b])
            self.rank[vocab[a] * self.size + vocab[b]] = r
        pairs = sorted(self.rank.items())
        self.pair_codes, self.pair_ranks = np.array([p for p, _ in pairs], np.int64), np.array([r for _, r in pairs], np.int64)
        char = byte_characters()
        self.of_byte = np.array([vocab.get(c, -1) for c in char], np.int64)
        self.of_last_byte = np.array([vocab.get(c + word_end, -1) for c in char], np.int64)

    def symbols(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces' bytes, the last of each with the word end, and how many each has; unknown ones are left out."""
        data = np.frombuffer(b"".join(pieces), np.uint8)
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        sym = self.of_byte[data]
        ends = (np.cumsum(size) - 1)[size > 0]
        sym[ends] = self.of_last_byte[data[ends]]
        known = sym >= 0
        if not known.all():
            size = np.bincount(np.repeat(np.arange(len(pieces)), size)[known], minlength=len(pieces))
        return sym[known], size

    def encode_one(self, piece: bytes) -> list[int]:
        """The lowest rank first, leftmost first, until none is left."""
        s = self.symbols([piece])[0].tolist()
        while len(s) > 1:
            r, k = min((self.rank.get(s[i] * self.size + s[i + 1], 1 << 60), i) for i in range(len(s) - 1))
            if r == 1 << 60:
                break
            s[k : k + 2] = [self.made[r]]
        return s

    def encode(self, pieces: list[bytes]) -> list[list[int]]:
        out: list[list[int]] = []
        for i in range(0, len(pieces), INDEXED):
            out += self.encode_together(pieces[i : i + INDEXED])
        return out

    def ranks_of(self, pairs: np.ndarray) -> np.ndarray:
        """Rank of each pair, or a number above all ranks."""
        at = np.minimum(np.searchsorted(self.pair_codes, pairs), len(self.pair_codes) - 1)
        return np.where(self.pair_codes[at] == pairs, self.pair_ranks[at], len(self.made))

    def links(self, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First position of each piece, and the position after and before each, -1 at a piece's ends."""
        first = np.concatenate([[0], np.cumsum(size)])
        after, before = np.arange(1, first[-1] + 1), np.arange(-1, first[-1] - 1)
        full = first[:-1][size > 0]
        if len(full):
            after[np.append(full[1:], first[-1]) - 1] = -1
            before[full] = -1
        return first, after, before

    def merge_low_ranks(self, sym: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[int]]:
        """Symbols and sizes after all ranks below FREQUENT, whose long position lists are merged as arrays.

        Also the pieces in which a merge made a pair of a lower rank.
        """
        first, after, before = self.links(size)
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def add(places: np.ndarray, ranks: np.ndarray) -> None:
            few = ranks < min(FREQUENT, len(self.made))
            places, ranks = places[few], ranks[few]
            order = np.argsort(ranks, kind="stable")
            different, starts = np.unique(ranks[order], return_index=True)
            for r, part in zip(different.tolist(), np.split(places[order], starts[1:]) if len(starts) else (), strict=True):
                if r in index:
                    index[r].append(part)
                else:
                    index[r] = [part]
                    heapq.heappush(heap, r)

        inner = np.flatnonzero(after >= 0)
        add(inner, self.ranks_of(sym[inner] * self.size + sym[inner + 1]))
        again = []
        while heap:
            r = heapq.heappop(heap)
            a, b, new = self.left[r], self.right[r], self.made[r]
            p = np.unique(np.concatenate(index.pop(r)))
            p = p[(sym[p] == a) & (after[p] >= 0)]
            p = p[sym[after[p]] == b]
            if a == b and len(p):  # of overlapping places the first, third, ... are merged
                taken, free = [], -1
                for x, y in zip(p.tolist(), after[p].tolist(), strict=True):
                    if x != free:
                        taken.append(x)
                        free = y
                p = np.array(taken, np.int64)
            if not len(p):
                continue
            q = after[p]
            n = after[q]
            sym[p], sym[q], after[p] = new, -1, n
            has = n >= 0
            before[n[has]] = p[has]
            n = after[p[has]]
            left = before[p]
            inside = left >= 0
            places = np.concatenate([p[has], left[inside]])
            ranks = self.ranks_of(np.concatenate([new * self.size + sym[n], sym[left[inside]] * self.size + new]))
            if (ranks < r).any():
                again += (np.searchsorted(first, places[ranks < r], side="right") - 1).tolist()
            add(places, ranks)
        alive = sym >= 0
        return sym[alive], np.bincount(np.repeat(np.arange(len(size)), size)[alive], minlength=len(size)), again

    def encode_together(self, pieces: list[bytes]) -> list[list[int]]:
        sym, size, redo = self.merge_low_ranks(*self.symbols(pieces))
        first, after, before = self.links(size)
        if not len(sym):
            return [[] for _ in pieces]
        # the index: a list of positions for each rank that occurs
        inner = np.flatnonzero(after >= 0)
        known = self.ranks_of(sym[inner] * self.size + sym[inner + 1])
        inner, known = inner[known < len(self.made)], known[known < len(self.made)]
        order = np.argsort(known, kind="stable")
        ranks, starts = np.unique(known[order], return_index=True)
        index: dict[int, list[int]] = {r: p.tolist() for r, p in zip(ranks.tolist(), np.split(inner[order], starts[1:]), strict=True)} if len(ranks) else {}
        heap, sym, after, before = list(index), sym.tolist(), after.tolist(), before.tolist()
        heapq.heapify(heap)
        size, get, again = self.size, self.rank.get, []
        while heap:
            r = heapq.heappop(heap)
            places = index.pop(r, None)
            if places is None:
                continue
            a, b, new = self.left[r], self.right[r], self.made[r]
            places.sort()
            for p in places:
                if sym[p] != a:
                    continue
                q = after[p]
                if q < 0 or sym[q] != b:
                    continue
                sym[p], sym[q] = new, -1
                n_after = after[p] = after[q]
                if n_after >= 0:
                    before[n_after] = p
                    nr = get(new * size + sym[n_after])
                    if nr is not None:
                        if nr in index:
                            index[nr].append(p)
                        else:
                            index[nr] = [p]
                            heapq.heappush(heap, nr)
                        if nr < r:
                            again.append(p)
                left = before[p]
                if left >= 0:
                    nr = get(sym[left] * size + new)
                    if nr is not None:
                        if nr in index:
                            index[nr].append(left)
                        else:
                            index[nr] = [left]
                            heapq.heappush(heap, nr)
                        if nr < r:
                            again.append(p)
        final = np.array(sym)
        alive = final >= 0
        ids = final[alive].tolist()
        ends = np.concatenate([[0], np.cumsum(alive)])[first].tolist()
        out = [ids[s:e] for s, e in zip(ends, ends[1:], strict=False)]
        for k in {*redo, *((np.searchsorted(first, again, side="right") - 1).tolist() if again else ())}:
            out[k] = self.encode_one(pieces[k])
        return out


class WordCodec:
    """Encoder and decoder of a tokenizer file of the kind `BPE with word ends`, without training or padding."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        split = spec["pre_tokenizer"]["pretokenizers"][0]
        if split["pattern"]["Regex"] != WORD_PATTERN or spec["decoder"] is not None or spec["model"]["end_of_word_suffix"] is None:
            raise ValueError(f"{path} is not a word-end BPE of the supported form")
        self.bpe = PairIndexBPE(spec["model"]["vocab"], map(tuple, spec["model"]["merges"]), spec["model"]["end_of_word_suffix"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.at_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        parts = Tokenizer.from_file(path)
        self.normalizer, self.pre_tokenizer = parts.normalizer, parts.pre_tokenizer
        self.seen: dict[bytes, list[int]] = {}  # pieces; cuts share them
        self.to_byte = {ord(c): b for b, c in enumerate(byte_characters())}
        self.strings = dict.fromkeys(range(self.bpe.size + len(self.special)), "") | {i: s for s, i in [*self.bpe.vocab.items(), *self.special.items()]}

    def pieces(self, cut: bytes) -> list[bytes | int]:
        """Pieces of one cut as bytes, and the ids of special tokens between them."""
        if cut.isalpha():
            return [cut.lower()]
        if cut[:-1].isalpha() and b"!" <= cut[-1:] <= b"~":
            return [cut[:-1].lower(), cut[-1:]]
        if PLAIN.fullmatch(cut) and b"<|" not in cut:
            return ASCII_PIECE.findall(cut.lower())
        text = cut.decode("utf-8", "replace")
        if LATIN.fullmatch(text) and "<|" not in text:
            if text.isalpha():
                return [text.lower().encode()]
            if text[:-1].isalpha():
                return [text[:-1].lower().encode(), text[-1:].encode()]
            return [p.encode() for p in LATIN_PIECE.findall(text.lower())]
        out: list[bytes | int] = []
        for part in self.at_special.split(text):
            if part in self.special:
                out.append(self.special[part])
            elif part:
                out += [p.translate(self.to_byte).encode("latin-1") for p, _ in self.pre_tokenizer.pre_tokenize_str(self.normalizer.normalize_str(part))]
        return out

    def encode_cuts(self, cuts: list[bytes]) -> list[list[int]]:
        split = list(map(self.pieces, cuts))
        ids = self.seen
        new = [p for p in {p for s in split for p in s} - ids.keys() if p.__class__ is bytes]
        ids.update(zip(new, self.bpe.encode(new), strict=True))
        return [ids[s[0]] if len(s) == 1 and s[0].__class__ is bytes else [x for p in s for x in (ids[p] if p.__class__ is bytes else (p,))] for s in split]

    def decode(self, ids: Iterable[int]) -> str:
        """As a tokenizer without a decoder does it: the tokens' strings, joined by a space."""
        return " ".join([self.strings[i] for i in ids])


class Remembered:
    """What a worker keeps of the cuts it has seen: what `render` makes of their pieces' ids, put together by `join`.

    A cut of one piece shares what is kept for the piece, and so do the cuts that differ in case or in what is beside it.
    Two generations of cuts and of pieces: one that is full becomes the old one, and what is asked for again moves up.
    """

    def __init__(self, codec: WordCodec, render: Callable[[list[int]], tuple], join: Callable[[list[tuple]], tuple], limit: int = KNOWN):
        self.codec, self.render, self.join, self.limit = codec, render, join, limit
        self.young: dict[bytes, tuple] = {}
        self.old: dict[bytes, tuple] = {}
        self.pieces: dict[bytes | int, tuple] = {}
        self.old_pieces: dict[bytes | int, tuple] = {}

    def of(self, texts: list[str | None]) -> Iterable[list[tuple]]:
        cut = [(t or "").encode("utf-8", "replace").split() for t in texts]
        if len(self.young) > self.limit:
            self.young, self.old = {}, self.young
        if len(self.pieces) > self.limit:
            self.pieces, self.old_pieces = {}, self.pieces
        new = []
        for c in set().union(*cut) - self.young.keys():
            seen = self.old.get(c)
            if seen is None:
                new.append(c)
            else:
                self.young[c] = seen
        gc.disable()  # nothing made here is cyclic, and each collection would walk all that is remembered
        try:
            for i in range(0, len(new), INDEXED):
                self.learn(new[i : i + INDEXED])
        finally:
            gc.enable()
        get = self.young.__getitem__
        for words in cut:
            yield list(map(get, words))

    def learn(self, cuts: list[bytes]) -> None:
        split = list(map(self.codec.pieces, cuts))
        known, old, new = self.pieces, self.old_pieces, []
        for p in set().union(*split) - known.keys():
            if p in old:
                known[p] = old[p]
            elif p.__class__ is bytes:
                new.append(p)
            else:
                known[p] = self.render([p])
        known.update(zip(new, map(self.render, self.codec.bpe.encode(new)), strict=True))
        join = self.join
        self.young.update(zip(cuts, [known[s[0]] if len(s) == 1 else join([known[p] for p in s]) for s in split], strict=True))


_codecs: dict[str, WordCodec] = {}
_memories: dict[str, Remembered] = {}


def codec_at(path: str) -> WordCodec:
    """One codec a worker process and file."""
    if path not in _codecs:
        _codecs[path] = WordCodec(path)
        common.give_back()
    return _codecs[path]


def spaced(parts: list[tuple]) -> tuple:
    """Counts of tokens, and two byte strings of each token joined by a space, of parts that may have no token."""
    if len(parts) == 2 and parts[0][0] and parts[1][0]:
        (m, a, b), (n, x, y) = parts
        return m + n, b"%b %b" % (a, x), b"%b %b" % (b, y)
    counts, ids, strings = zip(*parts, strict=True) if parts else ((), (), ())
    if 0 in counts:
        return spaced([p for p in parts if p[0]])
    return sum(counts), b" ".join(ids), b" ".join(strings)


def memory_at(path: str) -> Remembered:
    """One memory a worker process and file, of what digests are made of."""
    if path not in _memories:
        codec = codec_at(path)
        decimal, string = ([f(i) for i in range(len(codec.strings))] for f in (lambda i: b"%d" % i, lambda i: codec.strings[i].encode()))
        _memories[path] = Remembered(codec, lambda ids: (len(ids), b" ".join([decimal[i] for i in ids]), b" ".join([string[i] for i in ids])), spaced)
    return _memories[path]


def runs(lengths: list[int | None], most: int) -> Iterable[tuple[int, int]]:
    """Slices of a batch whose texts together have about so many bytes."""
    start, held = 0, 0
    for i, n in enumerate(lengths):
        held += n or 0
        if held >= most:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(lengths):
        yield start, len(lengths)


def encode(df: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids (array<int>) and decoded (string) of every row."""

    def run(batches):
        codec = WordCodec(path)  # ids and strings are larger than digests, so nothing outlives the partition
        common.give_back()  # what parsing the file took

        def join(parts):
            return sum([p[0] for p in parts]), b"".join([p[1] for p in parts]), " ".join([p[2] for p in parts if p[0]])

        memory = Remembered(codec, lambda ids: (len(ids), np.array(ids, np.int32).tobytes(), codec.decode(ids)), join, ENCODE_KNOWN)
        for batch in batches:
            lengths = pc.binary_length(batch.column("text")).to_pylist()
            for a, b in runs(lengths, 1_500_000):
                counts, flat, decoded = [], [], []
                for words in memory.of(batch.column("text").slice(a, b - a).to_pylist()):
                    counts.append(sum(w[0] for w in words))
                    flat += [w[1] for w in words]
                    decoded.append(" ".join([w[2] for w in words if w[0]]))
                ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(np.frombuffer(b"".join(flat), np.int32) if any(counts) else np.zeros(0, np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(counts, pa.int64()), ids, pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids", "decoded"])

    return common.id_and_text(df).mapInArrow(common.lean(run), "doc_id long, n_tokens long, ids array<int>, decoded string")


def digests(df: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens and the SHA-256 of the decimal ids and of the decoded text, of every row.

    The same encoder and decoder as `encode`; ids and strings stay in the worker.
    """

    def run(batches):
        memory = memory_at(path)
        for batch in batches:
            doc_ids, lengths = batch.column("doc_id"), pc.binary_length(batch.column("text")).to_pylist()
            for a, b in runs(lengths, 4_000_000):
                counts, of_ids, of_text = [], [], []
                for words in memory.of(batch.column("text").slice(a, b - a).to_pylist()):
                    n, ids, string = spaced(words)
                    counts.append(n)
                    of_ids.append(sha256(ids).hexdigest())
                    of_text.append(sha256(string).hexdigest())
                yield pa.RecordBatch.from_arrays([doc_ids.slice(a, b - a), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return common.id_and_text(df).mapInArrow(common.lean(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
