import random
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from medlattice.llm import simhash
from medlattice.llm.components import components


def brute_fingerprint(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(n, edges):
    parent = list(range(n))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for a, b in edges:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("text", ["", " ", "One", "a b c", "a b c d", "A b C d e f a b C d", "é ß 日本 x y z É"])
def test_fingerprint_matches_definition(text):
    assert simhash.fingerprint(text.encode()) == brute_fingerprint(text)


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("radius", [0, 1, 4, 7])
def test_cells_span_the_groups(seed, radius):
    rng = random.Random(seed)
    fps = set()
    for _ in range(rng.choice([3, 70, 250])):
        x = rng.choice([0, 2**64 - 1, 0x123456789ABCDEF0])
        for _ in range(rng.randint(0, 9)):
            x ^= 1 << rng.randrange(64)
        fps.add(x)
    first, second = sorted(fps), sorted(rng.getrandbits(64) for _ in range(4))
    both = first + second
    links = simhash.link_cells(np.array(both, np.uint64), np.array([0, len(first), len(both)]), radius, slab=64)
    edges = [(i, j) for i in range(len(both)) for j in range(i) if (i < len(first)) == (j < len(first))
             and bin(both[i] ^ both[j]).count("1") <= radius]
    assert classes(len(both), links) == classes(len(both), edges)
    assert len(links) < len(both)            # a spanning forest, not all pairs


def test_components_of_a_long_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(100, 164)]
    star = [(7, i) for i in range(1000, 1400)]
    found = {r.node: r.root for r in components(spark.createDataFrame(chain + star + [(5, 5)], "a long, b long")).collect()}
    assert found == {**{i: 100 for i in range(100, 165)}, **{i: 7 for i in [7, *range(1000, 1400)]}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def expected(rows):
    fps = [brute_fingerprint(t) for _, t in rows]
    root = classes(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= 4])
    least = defaultdict(list)
    for r, (i, _) in zip(root, rows):
        least[r] += [i] if i is not None else []
    return sorted(((i, f, min(least[r], default=None)) for (i, _), f, r in zip(rows, fps, root)), key=repr)


@pytest.mark.parametrize("cell_rows", [2048, 3])
def test_groups_match_brute_force(frame, odd_rows, cell_rows):
    rng = random.Random(2)
    rows = list(odd_rows)
    for base in range(12):
        words = [f"w{rng.randrange(500)}" for _ in range(300)]
        for copy in range(rng.choice([1, 2, 8])):
            changed = list(words)
            for _ in range(copy):
                changed[rng.randrange(300)] = "new"
            rows.append((100 + 20 * base + copy, " ".join(changed)))
    got = simhash.simhash_groups(frame(rows), cell_rows=cell_rows)
    assert sorted(((r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in got.collect()), key=repr) == expected(rows)


def test_keep_one_leaves_the_smallest_of_each_group(frame):
    rng = random.Random(3)
    text = " ".join(f"w{rng.randrange(99)}" for _ in range(60))
    docs = frame([(3, text), (9, text.upper()), (4, "other words stand here now"), (5, ""), (6, None), (None, "alone with no id")])
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == [3, 4, 5, None]


def test_keep_one_leaves_one_row_of_each_group(frame):
    """Null-id copies, repeated rows, and one id with two texts."""
    rng = random.Random(4)
    texts = [" ".join(f"v{rng.randrange(99)}" for _ in range(60)) for _ in range(5)]
    docs = frame([(None, texts[0]), (None, texts[0].upper()), (None, texts[0]),          # among themselves
                  (None, texts[1]), (8, texts[1]), (9, texts[1]),                        # against a document with an id
                  (5, texts[2]), (5, texts[2]), (5, texts[2]),                           # repeated rows
                  (2, texts[3]), (1, texts[4]), (2, texts[4])])                          # id 2 with two texts
    kept = sorted(((r.doc_id, (r.text or "").lower()) for r in simhash.keep_one(docs).collect()), key=repr)
    assert kept == sorted([(None, texts[0]), (8, texts[1]), (5, texts[2]), (2, texts[3]), (1, texts[4])], key=repr)


def test_hex_digits(spark):
    rows = spark.createDataFrame([(-1,), (0,), (255,)], "fp long").select(simhash.hex_digits(F.col("fp")).alias("x")).collect()
    assert [r.x for r in rows] == ["f" * 16, "0" * 16, "0" * 14 + "ff"]


def test_empty_table(frame):
    assert simhash.simhash_groups(frame([])).count() == 0
