"""The Jaccard join, vector codes and the prefix trie against brute force, on odd rows too."""

import hashlib
import itertools
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from rootweave.llm import jaccard_join, prefix_trie, vector_codes
from rootweave.llm.jaccard_join import differing, needed, shared, sketch, tile_keys, unpacked

SHAPE = "doc_id long, text string, node long, key string, root int"


def _sets(texts, width=4):
    out = []
    for text in texts:
        words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ") if w]
        out.append({tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if len(words) >= width else {tuple(words)} if words else set())
    return out


def _components(rows, percent=85):
    """By comparing all pairs; rows of one id are one node."""
    sets = _sets([t for _, t in rows])
    parent = {d: d for d, _ in rows if d is not None}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, (i, _)), (b, (j, _)) in itertools.combinations(enumerate(rows), 2):
        both = len(sets[a] & sets[b])
        if i is not None and j is not None and both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((top(i), top(j)))
            parent[y] = x
    return sorted((repr(d), len(s), repr(None if d is None else top(d))) for (d, _), s in zip(rows, sets, strict=True))


def _family(rng, n_words, size, edits):
    base = [f"w{rng.randrange(5000)}" for _ in range(n_words)]
    for _ in range(size):
        copy = list(base)
        for _ in range(rng.randrange(edits + 1)):
            at = rng.randrange(len(copy))
            copy[at : at + rng.randrange(2)] = [f"x{rng.randrange(10**6)}"] * rng.randrange(2)
        yield " ".join(copy)


@pytest.mark.parametrize("block", [1024, 2])
def test_join_equals_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    rng = random.Random(4)
    texts = [t for words, size, edits in ((6, 6, 1), (20, 8, 1), (60, 12, 3), (200, 12, 9), (700, 6, 30)) for t in _family(rng, words, size, edits)]
    texts += [None, "", " \t\n", "one", "One", "two words", "a b c", "A  b\tc", texts[3], texts[3], texts[30].upper(), " ".join(f"v{i}" for i in range(4000))]
    rows = [(i, t) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    rows += [rows[0], (None, texts[20]), (None, texts[20]), (900, texts[9]), (900, texts[40]), (-5, texts[22])]
    table = spark.createDataFrame([(*r, 1, "k", 2) for r in rows], SHAPE).repartition(3)
    got = jaccard_join.jaccard_components(table).collect()
    assert sorted((repr(r["doc_id"]), r["n_shingles"], repr(r["component_id"])) for r in got) == _components(rows)
    if block == 2:
        assert jaccard_join.jaccard_components(table.limit(0)).count() == 0


def test_linked_sets_share_a_tile_and_stay_within_the_bound():
    rng = np.random.default_rng(8)
    for size in [*range(1, 40), 64, 100, 333, 1000, 5000]:
        for _ in range(6):
            a = np.unique(rng.integers(0, 1 << 64, size, dtype=np.uint64))
            drop = rng.integers(0, len(a) + 1)
            b = a[np.sort(rng.permutation(len(a))[drop // 5 :])] if len(a) > 1 else a
            b = np.unique(np.concatenate([b, rng.integers(0, 1 << 64, rng.integers(0, 1 + len(a) // 6), dtype=np.uint64)]))
            both = len(np.intersect1d(a, b))
            assert shared(a, b) == both
            linked = 100 * both >= 85 * (len(a) + len(b) - both)
            assert linked == (both >= needed(len(a) + len(b), 85))
            sizes, maps = unpacked([sketch(a), sketch(b)])
            apart = int(np.bitwise_count(maps[0] ^ maps[1]).sum())
            assert sizes.tolist() == [len(a), len(b)] and (sizes.sum() - apart) // 2 >= both
            if linked and not np.array_equal(a, b):
                assert set(tile_keys(a, 85)) & set(tile_keys(b, 85))
    assert differing(0, 85) == 0


def _codes(rows, parts=16, entries=64, rounds=2):
    """As the definition reads."""
    kept = [(i, [min(max(math.floor(256 * x), -(1 << 22)), 1 << 22) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    width = max(1, -(-max(len(v) for _, v, _ in kept) // parts))
    kept = [(i, v + [0] * (parts * width - len(v)), lab) for i, v, lab in kept]
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for _, v, _ in kept]
    order = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, kept[k][1]))
    books = [[cut[k][p] for k in order[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda p, s: min((far(s, e), n) for n, e in enumerate(books[p]))
    for _ in range(rounds):
        for p in range(parts):
            held = defaultdict(list)
            for c in cut:
                held[nearest(p, c[p])[1]].append(c[p])
            books[p] = [[sum(col) // len(held[n]) for col in zip(*held[n], strict=True)] if n in held else e for n, e in enumerate(books[p])]
    digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    found = [[nearest(p, s) for p, s in enumerate(c)] for c in cut]
    errors = [sum(d for d, _ in f) for f in found]
    totals = defaultdict(int)
    for (_, _, lab), error in zip(kept, errors, strict=True):
        totals[lab] += error
    return [(i, "".join(f"{n:02x}" for _, n in f), e, totals[lab], digest) for (i, _, lab), f, e in zip(kept, found, errors, strict=True)]


@pytest.mark.parametrize("memo", [1 << 16, 40])
def test_codes_equal_the_definition(spark, monkeypatch, memo):
    monkeypatch.setattr(vector_codes, "MEMO", memo)
    monkeypatch.setattr(vector_codes, "ROWS", 32)
    rng = random.Random(2)
    vector = lambda n=32: [rng.gauss(0, 0.2) for _ in range(n)]
    rows = [(i, vector(), rng.choice([0, 1, None])) for i in range(150)]
    rows += [(200, None, 1), (201, [0.1] * 31 + [None], 1), (202, [float("nan")] * 32, 1), (203, [float("inf")] * 32, 1), (204, [], 2), (205, [0.5], 2), (206, [1e30, -1e30] * 16, 3), (-4, [-0.0] * 32, 3)]
    rows += [rows[5], rows[5], (5, rows[7][1], 1), (None, vector(), 4)]
    table = spark.createDataFrame([(a, b, c, "x", 1) for a, b, c in rows], "vec_id long, embedding array<double>, label int, code string, error int").repartition(3)
    got = vector_codes.vector_codes(table)
    assert got.columns == ["vec_id", "label", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(repr, (tuple(r) for r in got.drop("label").collect()))) == sorted(map(repr, _codes(rows)))
    few = rows[:3]
    got = vector_codes.vector_codes(table.limit(0).unionByName(spark.createDataFrame([(*r, "x", 1) for r in few], table.schema))).drop("label").collect()
    assert sorted(map(tuple, got)) == sorted(_codes(few))
    assert vector_codes.vector_codes(table.filter("vec_id IN (200, 201)")).count() == 0


def test_boxes_keep_all_entries_that_can_win():
    rng = np.random.default_rng(3)
    grid = vector_codes.Grid(np.array([[0, 0], [10, 10], [10, 10], [100, 100]]))
    points = rng.integers(-20, 130, (3000, 2))
    index, distance = grid.nearest(points)
    apart = ((points[:, None] - grid.entries[None]) ** 2).sum(axis=2)
    assert (index == apart.argmin(axis=1)).all() and (distance == apart.min(axis=1)).all() and grid.evaluated < 3 * len(points)
    grid.slot = dict.fromkeys(grid.slot, 0)  # every hash leads to one box, as if all collided
    assert (grid.nearest(points)[0] == index).all()


def _trie(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in own.items()}
    members = defaultdict(list)
    whole = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        whole[c] = own.get(c - int(math.fmod(c, 20)), [])[:h] + own[c][h:]
        for d in range(len(whole[c]) + 1):
            members[tuple(whole[c][:d])].append(c)
    out = []
    for node, held in members.items():
        below = [n for n in members if n[: len(node)] == node]
        leaves = [n for n in below if not any(len(m) == len(n) + 1 and m[: len(n)] == n for m in members)]
        saved = sum((len(members[n]) - 1) * len([w for w in n[-1][1].replace("\n", " ").split(" ") if w]) for n in below if n)
        ends = ",".join(str(c) for c in sorted(held) if len(whole[c]) == len(node))
        children = sum(len(m) == len(node) + 1 for m in below)
        out.append((min(held), len(node), min(members[node[:-1]]) if node else None, len(held), children, len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def test_trie_equals_the_definition(spark):
    rng = random.Random(12)
    texts = ["hello there", "hello", "one two  three", None, "", "a\nb"]
    rows = []
    for c in [*range(70), 100, 119, 1000, -3]:
        rows += [(c, t, rng.choice(["user", "assistant"]) if c % 3 else "user", rng.choice(texts[: 2 if c % 2 else 6])) for t in range(rng.randrange(1, 7))]
    for c in (40, 45, 51, 59):  # several blocks, which part only in the third
        rows = [r for r in rows if r[0] != c] + [(c, t, "user", f"step {t}" if t < 19 or c != 45 else "other") for t in range(25 if c != 59 else 9)]
    rows += [(3, None, "user", "first"), (3, None, None, "first"), (7, 1, "user", "tie"), (7, 1, "user", "tie"), (None, 1, "user", "lost"), (None, None, None, None)]
    rng.shuffle(rows)
    table = spark.createDataFrame([(*r, "k", 5) for r in rows], "conv_id long, turn long, role string, text string, key string, block int").repartition(3)
    got = prefix_trie.prefix_trie(table)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted(map(repr, (tuple(r) for r in got.collect()))) == sorted(map(repr, _trie(rows)))
    assert prefix_trie.prefix_trie(table.limit(0)).count() == 0


def test_ends_are_hashed_across_chunks(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK_BITS", 2)
    rows = [(20 * c, 0, "user", "same") for c in range(300)] + [(20 * c, 1, "user", "more") for c in range(0, 300, 7)]
    got = prefix_trie.prefix_trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5))
    assert sorted(map(repr, (tuple(r) for r in got.collect()))) == sorted(map(repr, _trie(rows)))
