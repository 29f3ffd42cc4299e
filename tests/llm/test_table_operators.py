"""SimHash, sharding, token files, Matroska, mixing and the pipeline against brute force."""

from __future__ import annotations

import math
import random
import re
import struct
import zlib
from collections import Counter, defaultdict
from fractions import Fraction
from hashlib import md5, sha256

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from tokenizers import Tokenizer

from tessera.llm import matroska, mixing, queries, sharding, simhash, tokenfile

from .fixtures import awkward, documents, empty, sample

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# -- SimHash ---------------------------------------------------------------------------------------


def plain_fingerprint(text: str | None) -> int:
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(codes: list[int], radius: int = 2) -> list[int]:
    """Index of the first code that each reaches."""
    label = list(range(len(codes)))

    def root(k):
        while label[k] != k:
            k = label[k]
        return k

    for a in range(len(codes)):
        for b in range(a):
            if (codes[a] ^ codes[b]).bit_count() <= radius:
                x, y = sorted((root(a), root(b)))
                label[y] = x
    return [root(k) for k in range(len(codes))]


def test_fingerprint():
    for t in (None, "", "One", "A b", "The CAT sat\non the  mat É", "x y z " * 50):
        assert simhash.fingerprint(t) == plain_fingerprint(t)


@pytest.mark.parametrize("seed", range(4))
def test_gray_index_finds_all_near_pairs(seed):
    rng = random.Random(seed)
    codes = {rng.getrandbits(64) for _ in range(40)}
    for c in list(codes):
        for _ in range(rng.randrange(12)):
            for _ in range(rng.randrange(4)):
                c ^= 1 << rng.randrange(64)
            codes.add(c)
    codes = np.array(sorted(codes), np.uint64)
    order = np.argsort(simhash.gray_rank(codes))
    codes = codes[order]
    cut = len(codes) // 3
    found = {(int(a), int(b)) for i, j in simhash.GrayIndex(codes, np.array([0, cut, len(codes)])).near_pairs(2) for a, b in zip(i, j, strict=True)}
    want = {(a, b) for b in range(len(codes)) for a in range(b) if (int(codes[a]) ^ int(codes[b])).bit_count() <= 2 and (a < cut) == (b < cut)}
    assert found == want


def test_components_with_hot_buckets(spark):
    rng = random.Random(3)
    start, codes = rng.getrandbits(64), []
    for _ in range(150):  # chains that share nearly all bits, so that buckets pass the limit twice
        c = start
        for _ in range(rng.randrange(6)):
            c ^= 1 << rng.randrange(24)
        codes.append(c)
    codes += [rng.getrandbits(64) for _ in range(50)]
    codes = sorted(set(codes))
    frame = spark.createDataFrame([(simhash.signed(c),) for c in codes], "fp long")
    label = {c: c for c in codes} | {r.node % 2**64: r.root % 2**64 for r in simhash.components(simhash.near_links(frame, hot=4)).collect()}
    want = groups(codes)
    same = defaultdict(set)
    for c in codes:
        same[label[c]].add(c)
    expect = defaultdict(set)
    for c, w in zip(codes, want, strict=True):
        expect[w].add(c)
    assert sorted(map(sorted, same.values())) == sorted(map(sorted, expect.values()))


def test_near_duplicates_on_sample_and_awkward(spark):
    for frame in (sample(spark)[0], awkward(spark)):
        rows = sorted(((r.doc_id, r.text) for r in frame.select("doc_id", "text").collect()), key=lambda r: (r[0] is None, r[0] or 0))
        codes = [plain_fingerprint(t) for _, t in rows]
        want = Counter((i, simhash.signed(c), rows[k][0]) for (i, _), c, k in zip(rows, codes, groups(codes), strict=True))
        assert Counter(map(tuple, simhash.near_duplicates(frame).collect())) == want
    assert simhash.near_duplicates(empty(spark)).collect() == []


# -- sharding --------------------------------------------------------------------------------------


def plain_shard(key: str, tree: sharding.Tree) -> int:
    """Region, then rack of it, then shard of that, by the least weighted draw."""

    def pick(paths: dict[str, float]) -> str:
        value = lambda p: (int(md5(f"{key}/{p}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        return min(paths, key=lambda p: -math.log(value(p)) / paths[p])

    leaves = {f"{r}/{k}/{i}": w for r, k, weights in tree.racks for i, w in enumerate(weights)}
    under = lambda p, depth: {q: sum(w for x, w in leaves.items() if x.split("/")[: depth + 1] == q.split("/")) for q in dict.fromkeys("/".join(x.split("/")[: depth + 1]) for x in leaves if x.startswith(p))}
    region = pick(under("", 0))
    rack = pick(under(f"{region}/", 1))
    return list(leaves).index(pick(under(f"{rack}/", 2)))


def test_sharding(spark, monkeypatch):
    monkeypatch.setattr(sharding, "SLOT_ROWS", 3)
    one = sharding.Tree.even(24)
    more = one.grown()
    df, pdf = sample(spark)
    rows = sharding.assign(df, one, more).collect()
    text = dict(zip(pdf.doc_id, pdf.text, strict=True))
    assert len(rows) == len(pdf)
    for r in rows:
        assert r.shard == plain_shard(str(r.doc_id), one) and r.grown_shard == plain_shard(str(r.doc_id), more)
        assert r.grown_shard in (r.shard, 24)
        assert r.size == len(text[r.doc_id].encode()) + 8 and r.text_crc32 == zlib.crc32(text[r.doc_id].encode())
    for s in range(24):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    odd = sharding.assign(awkward(spark), one).collect()
    assert len(odd) == awkward(spark).count() and {r.size for r in odd if r.doc_id in (0, 1)} == {8}
    for s in range(24):
        assert sorted(r.slot for r in odd if r.shard == s) == list(range(sum(r.shard == s for r in odd)))
    assert sharding.assign(empty(spark), one).collect() == []


def test_weights_move_only_their_subtree(spark):
    ids = spark.range(4000).withColumnRenamed("id", "doc_id")
    before = sharding.Tree(((0, 0, (1.0, 2.0)), (0, 1, (1.0,)), (1, 2, (3.0, 1.0))))
    after = sharding.Tree(((0, 0, (1.0, 2.0)), (0, 1, (2.0,)), (1, 2, (3.0, 1.0))))
    both = sharding.descend(sharding.descend(ids, sharding.key_of(), before, "a"), sharding.key_of(), after, "b").collect()
    share = Counter(r.a for r in both)
    for s, w in enumerate((1, 2, 1, 3, 1)):
        assert abs(share[s] / 4000 - w / 8) < 0.04
    # the rack of shard 2 and its region weigh more: no row enters another region, nor moves between others
    moved = [(r.a, r.b) for r in both if r.a != r.b]
    assert moved and {b for a, b in moved if a in (3, 4)} <= {0, 1, 2} and not any(a == 2 or b in (3, 4) for a, b in moved)
    assert {b for a, b in moved if a in (0, 1)} == {2}


def test_every_shard_more_takes_rows_only_into_itself(spark):
    ids, tree = spark.range(3000).withColumnRenamed("id", "doc_id"), sharding.Tree.even(10)
    for n in range(10, 13):
        more = tree.grown(2.0 if n == 11 else 1.0)
        both = sharding.descend(sharding.descend(ids, sharding.key_of(), tree, "a"), sharding.key_of(), more, "b").collect()
        assert {r.b for r in both if r.a != r.b} == {n}
        tree = more


def test_sharding_sql(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    want = {r[0]: r[1:] for r in con.execute(queries.OP6_SQL).fetchall()}
    got = {r.doc_id: (r.size, r.shard, r.grown_shard) for r in queries.op6(spark, "/root/testdata/sf0.001").collect()}
    assert got == want


# -- token files -----------------------------------------------------------------------------------


def test_rans_round_trip():
    rng = np.random.default_rng(1)
    for n, top in ((1, 1), (3000, 2**32 - 1), (5, 3), (4096, 2), (40_000, 50_000), (32_768, 300)):
        ids = np.minimum(rng.zipf(1.3, n), top).astype(np.uint32)
        data = tokenfile.write_file(np.array([-5, 9]), np.array([n - n // 2, n // 2]), ids, lanes=16, block=1024)
        f = tokenfile.TokenFile(data)
        assert (f.ids() == ids).all() and f.doc_ids.tolist() == [-5, 9] and f.tokens == n
        if n > 5000:
            assert (f.ids(2, 4) == ids[2048:4096]).all()
            p = np.bincount(ids) / n
            assert len(f.words) * 32 < 1.05 * n * -(p[p > 0] * np.log2(p[p > 0])).sum() + 64 * 16 * len(f.blocks)


def test_rans_tells_of_damage():
    data = bytearray(tokenfile.write_file(np.array([1]), np.array([3000]), np.arange(3000).astype(np.uint32), lanes=16, block=1024))
    data[-40] ^= 1
    with pytest.raises(tokenfile.Corrupt):
        tokenfile.TokenFile(bytes(data))
    data[-4:] = struct.pack("<I", zlib.crc32(data[:-4]))
    with pytest.raises(tokenfile.Corrupt):
        tokenfile.TokenFile(bytes(data)).ids()


def test_token_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tokenfile, "RANGE_BYTES", 50_000)
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for k, frame in enumerate((sample(spark)[0], awkward(spark))):
        files = tokenfile.encode_files(frame, public_tokenizers.path("byte_bpe_50k.json"), file_tokens=5000)
        tokenfile.write_files(files, f"{tmp_path}/{k}")
        got = tokenfile.decode_files(tokenfile.read_files(spark, f"{tmp_path}/{k}")).collect()
        rows = [(r.doc_id, [*library.encode(r.text or "", add_special_tokens=False).ids, 0]) for r in frame.select("doc_id", "text").collect()]
        assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == Counter((i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in rows)
        at = 0
        for r in sorted(got, key=lambda r: r.start):
            assert r.start == at
            at += r.n_tokens
        order = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
        assert order == sorted(order, key=lambda i: (i is not None, i or 0))
    tokenfile.write_files(tokenfile.encode_files(empty(spark), public_tokenizers.path("byte_bpe_50k.json")), f"{tmp_path}/none")
    assert tokenfile.decode_files(tokenfile.read_files(spark, f"{tmp_path}/none")).collect() == []


def test_byte_codec_equals_the_library():
    path = public_tokenizers.path("byte_bpe_50k.json")
    codec, rng = tokenfile.ByteCodec(path), random.Random(2)
    alphabet = ["a", "B", " ", "  ", "\n", "\t", "'", "s", "'ll", "1", "!", "é", "\x1c", " ", "日", "<|endoftext|>"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(30))) for _ in range(2000)]
    got = [np.frombuffer(b, "<u4").tolist() for b in codec.encode(texts)]
    assert got == [e.ids for e in codec.tokenizer.encode_batch(texts, add_special_tokens=False)]


class Spy:
    """A tokenizer that tells what it was asked for."""

    def __init__(self, tokenizer):
        self.tokenizer, self.asked = tokenizer, []

    def encode_batch_fast(self, texts, **more):
        self.asked += texts
        return self.tokenizer.encode_batch_fast(texts, **more)


def test_byte_codec_asks_the_library_once_a_cut_and_without_marks(monkeypatch):
    monkeypatch.setattr(tokenfile.ByteCodec, "JOINED", 7, raising=False)
    codec, rng = tokenfile.ByteCodec(public_tokenizers.path("byte_bpe_50k.json")), random.Random(5)
    codec.tokenizer = spy = Spy(codec.tokenizer)
    words = ["".join(rng.choice("abcéß1,.'") for _ in range(rng.randrange(1, 9))) for _ in range(400)]
    texts = ["\n".join(" ".join(rng.choice(words) for _ in range(9)) for _ in range(4)) for _ in range(100)]
    texts += ["", " a", "a  b", "\ta\n\nb ", "  ", "\n", "a" * 3000]
    want = [np.array(e.ids, "<u4").tobytes() for e in spy.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert codec.encode(texts) == want
    cuts = set(re.findall(r"[ \n]?[^\s]+", "\n".join(texts))) | {t.split()[0] for t in texts if t.split()}
    assert not any("<|" in t for t in spy.asked) and sum(map(len, spy.asked)) < sum(len(c) + 1 for c in cuts) + 50
    spy.asked.clear()
    assert codec.encode(texts[::-1]) == want[::-1] and not spy.asked


def test_byte_codec_that_forgets_equals_the_library(monkeypatch):
    monkeypatch.setattr(tokenfile.ByteCodec, "KNOWN", 60)
    codec, rng = tokenfile.ByteCodec(public_tokenizers.path("byte_bpe_50k.json")), random.Random(6)
    for _ in range(60):
        texts = ["".join(rng.choice(["ab", "c", "é", "1", "'s", "!", " ", " ", "\n", "  ", "\t"]) for _ in range(rng.randrange(40))) for _ in range(6)]
        assert codec.encode(texts) == [np.array(e.ids, "<u4").tobytes() for e in codec.tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_byte_codec_keeps_few_bytes_of_long_cuts(monkeypatch):
    monkeypatch.setattr(tokenfile.ByteCodec, "KNOWN_BYTES", 20_000, raising=False)
    codec, rng = tokenfile.ByteCodec(public_tokenizers.path("byte_bpe_50k.json")), random.Random(8)
    for size in (*[900] * 20, 30_000, 10):
        texts = [" ".join("".join(rng.choice("abcdE1+/") for _ in range(size)) for _ in range(3)) for _ in range(2)]
        assert codec.encode(texts) == [np.array(e.ids, "<u4").tobytes() for e in codec.tokenizer.encode_batch(texts, add_special_tokens=False)]
        assert codec.cuts.nbytes + codec.ids.nbytes <= 20_000


def test_byte_codec_tells_cuts_of_equal_marks_apart(monkeypatch):
    words = ["x" * 70 + c + "y" * 9 for c in "abcdefgh"] + ["b", "é", "a" * 8, "a" * 9, "1,"]
    rng = random.Random(7)
    for equal in (False, True):
        if equal:
            monkeypatch.setattr(tokenfile, "marks", lambda cuts: np.zeros(len(cuts), np.uint64))
        codec = tokenfile.ByteCodec(public_tokenizers.path("byte_bpe_50k.json"))
        for _ in range(5):
            texts = [" ".join(rng.choice(words) for _ in range(6)) for _ in range(8)]
            assert codec.encode(texts) == [np.array(e.ids, "<u4").tobytes() for e in codec.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert len(set(tokenfile.marks(pa.array(words[8:], pa.large_string())).tolist())) == 1
    monkeypatch.undo()
    assert len(set(tokenfile.marks(pa.array(words[7:], pa.large_string())).tolist())) == 6


# -- Matroska --------------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 1024, 1088, 8192, 9000, 32_768, 100_001, 400_000])
def test_matroska_round_trip(n):
    text = random.Random(n).randbytes(n)
    payload = matroska.padded(text)
    assert len(payload) % 64 == 0 and len(payload) > 0 and len(payload) - n <= 64
    data = matroska.mux(payload)
    media = matroska.parse(data)
    assert matroska.payload_of(data, media) == payload
    assert len(media.cues) == len(media.clusters) and ":1;" in matroska.summary(media)
    ends = [p[1] + p[2] for p in media.packets]
    assert [p[1] for p in media.packets] == [0, *ends[:-1]] and ends[-1] == len(payload) * 125_000


def test_matroska_lacings_groups_and_unknown_sizes():
    m = matroska
    frames = [b"a" * 300, b"b" * 10, b"c" * 700, b"d" * 1]
    for kind in (1, 3):
        sizes, at = m.lace_sizes(body := m.laced(frames, kind), 0, len(body), kind)
        assert sizes == [300, 10, 700, 1] and body[at : at + 300] == frames[0]
    group = m.element(m.BLOCK_GROUP, m.element(m.BLOCK, m.vint(2) + struct.pack(">hB", -3, 0) + b"zz") + m.uint(m.BLOCK_DURATION, 40) + m.element(0xFB, b"\x01"))
    simple = m.block(1, 5, [b"x"], 0)
    unknown = b"\x01" + b"\xff" * 7
    cluster = m.CLUSTER.to_bytes(4, "big") + unknown + m.uint(m.CLUSTER_TIME, 100) + group + m.element(0xEC, b"\0\0")
    data = m.header() + m.SEGMENT.to_bytes(4, "big") + unknown + cluster + m.element(m.CLUSTER, m.uint(m.CLUSTER_TIME, 200) + simple)
    media = m.parse(data)
    assert [(p[0], p[1], p[2], p[5], p[7]) for p in media.packets] == [(2, 97_000_000, 40_000_000, False, 0), (1, 205_000_000, 0, True, 1)]
    for cut in range(len(data)):
        try:
            m.parse(data[:cut])
        except m.Broken:
            pass


def test_matroska_tables(spark):
    odd = awkward(spark)
    rows = matroska.described(matroska.stored(odd)).collect()
    text = {r.doc_id: r.text for r in odd.collect()}
    assert len(rows) == odd.count()
    for r in (r for r in rows if r.doc_id is not None):
        payload = matroska.padded((text[r.doc_id] or "").encode())
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len((text[r.doc_id] or "").encode()), len(payload), sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    media = spark.createDataFrame([(1, matroska.mux(bytes(64))), (2, b"junk"), (3, None)], "k long, media binary")
    assert [(r.k, r.size, r.error is None) for r in matroska.packets(media, "k", "media").collect()] == [(1, 64, True), (2, None, False)]
    assert matroska.described(matroska.stored(empty(spark))).collect() == []


# -- mixing ----------------------------------------------------------------------------------------


def plain_targets(sizes: dict) -> dict:
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    target, budget, free = {}, Fraction(3, 2) * sum(sizes.values()), set(names)
    while free:
        whole = sum(weight[s] for s in free)
        over = {s for s in free if budget * weight[s] / whole > 2 * sizes[s]}
        for s in over or free:
            target[s] = Fraction(2 * sizes[s]) if over else budget * weight[s] / whole
        free = free - over if over else set()
        budget -= sum(target[s] for s in over)
    return target


@pytest.mark.parametrize("seed", range(3))
def test_targets(spark, seed):
    rng = random.Random(seed)
    sizes = {None if k == 0 else f"é{k}" if k % 4 else f"Z{k}": rng.choice([0, 1, 10, 100, 5000]) for k in range(rng.randrange(1, 14))}
    rows = mixing.targets(spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")).collect()
    got = {None if r.no_source else r.source: r.target for r in rows}
    assert got == {s: float(t) for s, t in plain_targets(sizes).items()}


def test_mixing_rows(spark):
    df, pdf = sample(spark)
    rows = mixing.plan(df).collect()
    assert [tuple(r) for r in sorted(rows)] == [tuple(r) for r in sorted(mixing.plan(df).collect())]
    assert len(rows) == len(pdf) and all(r.taken <= 2 * r.size for r in rows)
    taken = mixing.emit(df).groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in taken} == {r.doc_id: r.copies for r in rows if r.copies}
    odd = mixing.plan(awkward(spark)).collect()
    assert len(odd) == awkward(spark).count() and all(r.taken == 0 for r in odd if r.size == 0)
    assert mixing.emit(awkward(spark)).columns == awkward(spark).columns
    assert mixing.plan(empty(spark)).collect() == [] and mixing.emit(empty(spark)).collect() == []


def test_mixing_comes_near_its_targets(spark):
    rows = [(k, "w " * 20, None, f"s{k % 4}", None) for k in range(8000)]
    r = mixing.plan(documents(spark, rows)).groupBy("source_size", "target").sum("taken").collect()
    total = sum(x["sum(taken)"] for x in r)
    assert abs(total / (1.5 * 8000 * 20) - 1) < 0.02


# -- all registered queries ------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(q for q in queries.ORACLE_SQL if "FROM documents" in queries.ORACLE_SQL[q]))
def test_oracle(spark, name):
    """Of the queries on documents; those on embeddings are compared in test_vector_operators."""
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    want = con.execute(queries.ORACLE_SQL[name])
    columns = sorted(d[0] for d in want.description)
    want = Counter(tuple(r) for r in con.execute(f"SELECT {', '.join(columns)} FROM ({queries.ORACLE_SQL[name]})").fetchall())
    got = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert sorted(got.columns) == columns
    assert Counter(map(tuple, got.select(columns).collect())) == want


def test_registered_queries_against_brute_force(spark):
    """The rows that the queries return, column by column, from plain code."""
    from tests.llm.test_text_operators import plain_spans

    sf = "/root/testdata/sf0.001"
    _, pdf = sample(spark)
    texts = dict(zip(pdf.doc_id, pdf.text, strict=True))
    ids = sorted(texts)
    rows = lambda name: {r.doc_id: r for r in queries.QUERIES[name](spark, sf).collect()}
    sha = lambda t: sha256(t.encode()).hexdigest()
    line = lambda spans: ",".join(f"{k}:{s}:{e}" for k, s, e in spans)

    found = rows("op1_pii_skip_chain")
    for i in ids:
        base = plain_spans(texts[i])
        assert found[i].base_sha256 == sha(line(base)) and [found[i][f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [sum(s[0] == k for s in base) for k in ("email", "ip", "card", "phone")]
        assert set(filter(None, line(base).split(","))) <= set(filter(None, found[i].spans.split(",")))

    codes = [plain_fingerprint(texts[i]) for i in ids]
    first = groups(codes)
    found = rows("op2_simhash_gray_index")
    least: dict[int, int] = {}
    for k, i in enumerate(ids):
        least[first[k]] = min(least.get(first[k], i), i)
    assert all(found[i].fingerprint == f"{codes[k]:016x}" and found[i].component_id == least[first[k]] for k, i in enumerate(ids))

    word, byte = (Tokenizer.from_file(public_tokenizers.path(n)) for n in (queries.WORD_BPE, queries.BYTE_BPE))
    found, files, start = rows("op4_bpe_pair_index"), rows("op7_rans_token_files"), 0
    for i in ids:
        own = word.encode(texts[i], add_special_tokens=False).ids
        assert (found[i].n_tokens, found[i].ids_sha256, found[i].decoded_sha256) == (len(own), sha(" ".join(map(str, own))), sha(word.decode(own, skip_special_tokens=False)))
        stored = [*byte.encode(texts[i], add_special_tokens=False).ids, 0]
        assert (files[i].start, files[i].n_tokens, files[i].ids_crc32) == (start, len(stored), zlib.crc32(np.array(stored, "<u4").tobytes()))
        start += len(stored)

    import unicodedata

    fold = lambda t: xxhash.xxh3_128_hexdigest(" ".join(unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", t).casefold()).split()).encode())
    found = rows("op5_canonical_digest")
    of_print: dict[str, int] = {}
    for i in ids:
        of_print.setdefault(fold(texts[i]), i)
    for k, i in enumerate(ids):
        t, n = texts[i], texts[ids[(k + 1) % len(ids)]]
        q = len(t) // 4
        changed = t[: len(t) - q] + n[:q]
        assert (found[i].n_chars, found[i].edited_sha256, found[i].fingerprint, found[i].edited_fingerprint) == (len(t), sha(changed), fold(t), fold(changed))
        assert (found[i].near_edited, found[i].near_next, found[i].same_as) == (float(fold(t) == fold(changed)), float(fold(t) == fold(n)), of_print[fold(t)])

    found = rows("op9_matroska_media")
    for i in ids:
        payload = matroska.padded(texts[i].encode())
        assert (found[i].n_bytes, found[i].payload_bytes, found[i].payload_sha256, found[i].tail_crc32) == (len(texts[i].encode()), len(payload), sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert len(payload) % 64 == 0 and len(payload) > 0 and payload.startswith(texts[i].encode())
    found = rows("op8_langid_centroids")
    assert set(found) == set(ids) and all(0 <= r.score <= 1 for r in found.values())


def test_offsets_across_stretches(spark, monkeypatch):
    monkeypatch.setattr(tokenfile, "STRETCH", 2)
    files = spark.createDataFrame([(p, s, 10 * p + s + 1) for p in range(7) for s in range(p % 3 + 1)], "place int, seq int, tokens long")
    got, total = {(r.place, r.seq): r.before for r in tokenfile.offsets(files).collect()}, 0
    for r in files.orderBy("place", "seq").collect():
        assert got[r.place, r.seq] == total
        total += r.tokens


@pytest.mark.parametrize("kind", ["empty", "awkward"])
def test_pipeline_on_odd_tables(spark, kind):
    """No rows; or nulls, repeats, long texts and columns whose names clash with those that stages make."""
    import corpus_pipeline

    docs = (empty if kind == "empty" else awkward)(spark)
    clash = docs.withColumns({"__node": docs["doc_id"], "size": docs["doc_id"], "root": docs["source"]}) if kind == "awkward" else docs
    columns, seen = clash.columns, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        clash = stage(spark, clash, "")
        assert clash.columns == columns
        seen.append(clash.count())
    last = corpus_pipeline.STAGES[-1][1](spark, clash, "")
    assert last.count() == seen[-1] and set(last.columns) == {"doc_id", "n_tokens", "ids", "decoded"}
    assert seen[0] == 0 if kind == "empty" else seen[2] == seen[1] <= seen[0] and seen[1] > 0


def test_pipeline(spark):
    import corpus_pipeline

    docs, schema, seen = spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), None, []
    for name, stage in corpus_pipeline.STAGES:
        schema = schema or docs.columns
        assert docs.columns == schema
        docs = stage(spark, docs, "/root/testdata/sf0.001")
        seen.append((name, docs.count()))
    assert seen[0][1] == 200 and seen[1][1] < 200 and seen[2][1] == seen[1][1] and seen[4][1] == seen[3][1]
    direct = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert Counter((r.doc_id, r.n_tokens) for r in direct.collect()) == Counter((r.doc_id, r.n_tokens) for r in docs.collect())
