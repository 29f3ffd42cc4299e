"""The near-copy stage of the pipeline against brute force."""

from __future__ import annotations

import random
import re
import time

import numpy as np

import corpus_pipeline
from tessera.llm import nearcopies, simhash

from .fixtures import awkward, documents, empty, sample

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_set(text: str | None) -> frozenset:
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()


def plain_kept(rows: list[tuple]) -> list:
    """The least id of each component of pairs at 0.8 or more."""
    sets, label = [plain_set(t) for _, t in rows], list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if label[a] != label[b] and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
                x, y = label[a], label[b]
                label = [y if k == x else k for k in label]
    return sorted(min(i for (i, _), k in zip(rows, label, strict=True) if k == c) for c in set(label))


def kept(spark, df) -> list:
    return sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, df, "").collect())


def edited(words: list[str], edits: int, rng: random.Random) -> str:
    words = list(words)
    for k in rng.sample(range(len(words)), edits):
        words[k] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def test_word_copies_at_any_similarity(spark):
    """Copies with 1 to 8 of 120 words changed lie around the limit; chains, short texts and a shared passage too."""
    rng = random.Random(7)
    passage = [f"common{k}" for k in range(40)]
    rows = []
    for family in range(12):
        base = [f"w{rng.randrange(3000)}" for _ in range(120)] + passage
        rows += [(len(rows) + k, edited(base, k % 9, rng)) for k in range(9)]
        rows.append((len(rows), " ".join([*base[60:120], *passage])))
    step = [f"s{k}" for k in range(100)]
    for k in range(12):
        rows.append((len(rows), " ".join(step[4 * k :] + [f"t{j}" for j in range(4 * k)])))
    rows += [(len(rows), "a b c"), (len(rows) + 1, "A  b\nc"), (len(rows) + 2, "a b d"), (len(rows) + 3, ""), (len(rows) + 4, None)]
    want = plain_kept(rows)
    assert len(want) < len(rows) - 20
    assert kept(spark, documents(spark, [(i, t, "en", "s", 0) for i, t in rows])) == want


def test_sample_awkward_and_empty(spark):
    df, plain = sample(spark)
    assert kept(spark, df) == plain_kept(list(zip(plain["doc_id"].tolist(), plain["text"].tolist(), strict=True)))
    got = corpus_pipeline.near_dedup(spark, awkward(spark), "")
    assert got.columns == awkward(spark).columns
    assert [r.text for r in got.where("doc_id IS NULL").orderBy("text").collect()] == [None, "no id here"]
    assert sorted(r.doc_id for r in got.where("doc_id IS NOT NULL").collect()) == plain_kept([(r.doc_id if r.doc_id is not None else 10**9, r.text) for r in awkward(spark).where("doc_id IS NOT NULL OR text IS NULL").collect()])
    assert corpus_pipeline.near_dedup(spark, empty(spark), "").collect() == []


def test_repeated_ids_on_unlike_texts(spark):
    """Each group keeps a row of its own, also where one id stands on rows of several groups."""
    a, b, c = (" ".join(f"{x}{k}" for k in range(60)) for x in "abc")
    rows = [(1, a), (1, b), (1, a), (2, b + " end"), (2, c), (3, c), (4, a.upper())]
    got = corpus_pipeline.near_dedup(spark, documents(spark, [(i, t, "en", "s", 0) for i, t in rows]), "").collect()
    assert sorted((r.doc_id, r.text) for r in got) == [(1, a), (1, b), (2, c)]


def test_rounds_leave_no_shuffle_files(spark):
    """A round's files go as it ends, whenever the driver collects its garbage; the plan that comes back has run nothing yet."""
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {name for name in re.findall(r"shuffle_\d+_\d+_\d+\.data", disk.getAllFiles().mkString(" "))}
    df, _ = sample(spark)
    before = files()
    corpus_pipeline.near_dedup(spark, df, "")
    until = time.time() + 20
    while (left := files() - before) and time.time() < until:
        time.sleep(0.2)
    assert not left


def plain_roots(edges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Each node that is not the least of its component, with the least."""
    above: dict[int, int] = {}

    def root(x: int) -> int:
        while above.setdefault(x, x) != x:
            above[x] = x = above[above[x]]
        return x

    for u, v in edges:
        a, b = root(u), root(v)
        above[max(a, b)] = min(a, b)
    return sorted((x, root(x)) for x in list(above) if root(x) != x)


def test_components_of_paths_hubs_and_random_edges(spark, monkeypatch):
    rng = random.Random(11)
    ids = [rng.randrange(-(2**63), 2**63) for _ in range(1500)]
    few, line = sorted(ids[:12]), sorted(ids)
    graphs = [
        list(zip(line, line[1:], strict=False))[:400],
        [(rng.choice(ids), rng.choice(ids)) for _ in range(1200)],
        [(few[k % 12], v) for k, v in enumerate(ids)] + list(zip(few, few[1:], strict=False)),  # a chain of hubs
        [(line[-1], v) for v in line[:-1]] + list(zip(ids, ids[700:], strict=False)),  # a hub above all others
        [],
    ]
    for least in (1, simhash.HUB_LEAST):
        monkeypatch.setattr(simhash, "HUB_LEAST", least)
        for graph in graphs:
            edges = [(max(e), min(e)) for e in graph if e[0] != e[1]]
            assert sorted(map(tuple, simhash.components(spark.createDataFrame(edges, "u long, v long")).collect())) == plain_roots(edges)


def test_no_task_gets_all_edges_of_a_hub(spark, monkeypatch):
    """Of a star's 8,000 edges, each seen by both ends, four tasks get about 4,000 rows each; by its hub one would get 8,000 more."""
    plain = {name: getattr(simhash, name) for name in ("large_star", "small_star")}

    def watched(name):
        def run(batches):
            batches = list(batches)
            assert sum(b.num_rows for b in batches) < 5000
            yield from plain[name](batches)

        return run

    for name in plain:
        monkeypatch.setattr(simhash, name, watched(name))
    rng = random.Random(13)
    leaves = [rng.randrange(2**63) for _ in range(8000)]
    got = simhash.components(spark.createDataFrame([(x, -1) for x in leaves], "u long, v long")).collect()
    assert sorted(map(tuple, got)) == sorted((x, -1) for x in leaves)


def test_sketches_drop_no_similar_pair():
    rng = np.random.default_rng(3)
    for _ in range(400):
        n = int(rng.integers(1, 400))
        x = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        y = np.unique(np.concatenate([x[int(rng.integers(0, len(x) // 5 + 1)) :], rng.integers(0, 2**63, int(rng.integers(0, len(x) // 5 + 1)), dtype=np.uint64)]))
        if 9 * len(np.intersect1d(x, y)) >= 4 * (len(x) + len(y)):
            assert nearcopies.close(nearcopies.sketch(x), nearcopies.sketch(y), len(x) + len(y))


def test_first_shared_shingles_give_all_similar_pairs_and_late_ones_none():
    rng = np.random.default_rng(5)
    similar = 0
    for _ in range(600):
        x = rng.permutation(np.unique(rng.integers(0, 10**6, int(rng.integers(1, 300)))))
        y = np.concatenate([x[int(rng.integers(0, len(x) // 4 + 1)) :], rng.integers(10**6, 2 * 10**6, int(rng.integers(0, len(x) // 4 + 1)))])
        x, y = np.sort(x), np.unique(y)
        if len(y) and rng.random() < 0.5:  # what only the second set has comes first in the order
            x, y = np.sort(-x), np.unique(-y)
        both = np.intersect1d(x, y)
        if not len(both) or 9 * len(both) < 4 * (len(x) + len(y)):
            continue
        similar += 1
        size, place = np.array([len(x), len(y)]), np.array([np.searchsorted(x, both[0]), np.searchsorted(y, both[0])])
        assert nearcopies.possible(size, place, 0, 1)
        assert (place <= size // 5).all()
    assert similar > 200
    rows = 40  # unlike sets of one size that share a shingle past a ninth of it, as a common passage makes them
    size, place, label, mark = np.full(rows, 900), np.full(rows, 101), np.arange(rows), np.zeros((rows, 4), np.uint64)
    assert list(nearcopies.pairs_of(np.array([0]), label, size, place, mark)) == []
    assert sum(len(i) for i, _ in nearcopies.pairs_of(np.array([0]), label, size, place - 1, mark)) == rows * (rows - 1) // 2
