"""Near duplicates against brute force."""

import random
import re

import numpy as np

from tessera.llm.common import byte_buffers, segment_hashes_128
from tessera.llm.components import components
from tessera.llm.near_dups import near_duplicates
from tessera.llm.shingles import T, shingle_sets, sketches

import pyarrow as pa

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(texts):
    sets, parent = {i: shingles(t) for i, t in texts.items()}, {i: i for i in texts}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    ids = sorted(sets)
    for i in ids:
        for j in ids:
            if j < i and sets[i] and sets[j]:
                n = len(sets[i] & sets[j])
                if 100 * n >= 75 * (len(sets[i]) + len(sets[j]) - n):
                    a, b = sorted((find(i), find(j)))
                    parent[b] = a
    return {(i, len(sets[i]), find(i), find(i) == i) for i in ids}


def corpus(make_text):
    rng = random.Random(4)
    texts = {}
    for g in range(12):
        base = make_text(rng, rng.choice([3, 8, 40, 120])).split()
        for _ in range(rng.randrange(1, 9)):
            copy = list(base)
            for _ in range(rng.randrange(0, 4)):
                copy[rng.randrange(len(copy))] = f"edit{rng.randrange(9)}"
            texts[len(texts)] = " ".join(copy).upper() if rng.random() < 0.2 else "  ".join(copy)
    texts |= {len(texts): "", len(texts) + 1: " \n", len(texts) + 2: "one", len(texts) + 3: "ONE"}
    return texts


def test_against_brute_force(spark, make_text):
    texts = corpus(make_text)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {tuple(r) for r in near_duplicates(df).collect()} == brute(texts)


def test_odd_rows(odd_documents):
    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(odd_documents).collect()}
    assert {(2, 0, 2, True), (3, 0, 3, True), (5, 0, 5, True), (1, 2, 1, True), (6, 2, 1, False), (None, 4, None, True)} <= got
    assert near_duplicates(odd_documents.limit(0)).count() == 0


def test_sketches_fill_and_estimate():
    rng = np.random.default_rng(1)
    a = np.unique(rng.integers(0, 2**63, 1000).astype(np.uint64))
    b = np.concatenate([a[:750], np.unique(rng.integers(0, 2**63, 250).astype(np.uint64))])
    tiny = a[:1]
    s = sketches(np.concatenate([a, b, tiny]), np.cumsum([0, len(a), len(b), 1]))
    assert (s != np.uint64(2**64 - 1)).all()
    assert abs((s[0] == s[1]).mean() - 750 / 1250) < 4 * (0.6 * 0.4 / T) ** 0.5
    for hashes, offsets in shingle_sets(*byte_buffers(pa.array(["a b c d e a b c d e", "x", ""]))):
        assert np.diff(offsets).tolist() == [5, 1, 0]


def mirrored(n, a="a", b="b"):
    """Sequences that polynomials modulo a power of two do not tell apart: Thue and Morse's, and its complement."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return [(a, b)[x] for x in bits], [(b, a)[x] for x in bits]


def test_mirrored_words_and_texts_are_no_copies(spark):
    one, two = ("".join(x) for x in mirrored(1024))
    rows = [(1, one), (2, two), (3, f"{one} stands here"), (4, f"{two} stands here")]
    rows += [(5 + k, " ".join(x)) for k, x in enumerate(mirrored(1024, "ab", "cd"))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {tuple(r) for r in near_duplicates(df).collect()} == brute(dict(rows))
    for long in (200, 256, 257, 1024):
        raw, at = byte_buffers(pa.array(["".join(x) for x in mirrored(long)] * 2))
        for h in segment_hashes_128(raw, at[:-1], at[1:]):
            assert h[0] != h[1] and h[:2].tolist() == h[2:].tolist()


def test_components_of_a_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(100, 140)]
    star = [(7, i) for i in range(200, 230)]
    got = {(r.node, r.label) for r in components(spark.createDataFrame(path + star, "u long, v long")).collect()}
    assert got == {(i, 100) for i in range(100, 141)} | {(i, 7) for i in [7, *range(200, 230)]}
