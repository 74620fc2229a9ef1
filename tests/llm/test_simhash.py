"""SimHash near-duplicates against all pairs."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from tessera.llm import simhash as module
from tessera.llm.common import byte_buffers
from tessera.llm.simhash import fingerprints, links_between, simhash_groups

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    grams = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or [" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(fps, radius=4):
    """fps: a list; the number of each one's set."""
    label = list(range(len(fps)))

    def find(a):
        while label[a] != a:
            a = label[a]
        return a

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = sorted((find(i), find(j)))
                label[b] = a
    return [find(i) for i in range(len(fps))]


def brute(rows):
    fps = [fingerprint(t) for _, t in rows]
    sets = components(fps)
    least = {}
    for (i, _), s in zip(rows, sets):
        least[s] = min((x for x in (least.get(s), i) if x is not None), default=None)
    return sorted((str(i), format(f, "016x"), str(least[s])) for (i, _), f, s in zip(rows, fps, sets))


def rows_of(df):
    return sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in df.collect())


def test_odd_rows(spark, odd_documents):
    assert rows_of(simhash_groups(odd_documents)) == brute([(r.doc_id, r.text) for r in odd_documents.collect()])


def test_copies_and_edits(spark, make_text, monkeypatch):
    monkeypatch.setattr(module, "TILE", 16)
    rng = random.Random(8)
    rows = [(i, make_text(rng, rng.choice([1, 3, 4, 5, 60, 300]))) for i in range(150)]
    for i in range(200):
        words = rng.choice(rows[:150])[1].split(" ")
        if len(words) > 50:
            words[rng.randrange(len(words))] = "changed"
        rows.append((1000 + i, rng.choice([" ", "\n", "\t "]).join(words).upper() if i % 3 else " ".join(words)))
    rows += [(5000 + i, rng.choice([None, "", "  \n"])) for i in range(10)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = simhash_groups(df)
    assert rows_of(got) == brute(rows)
    assert got.select("component_id").distinct().count() < 250


def test_empty(spark):
    assert simhash_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_a_third_of_the_rows_is_one_text(spark, make_text):
    rng = random.Random(2)
    rows = [(i, make_text(rng, 40)) for i in range(60)] + [(100 + i, "the same five words here") for i in range(900)]
    assert rows_of(simhash_groups(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_pieces_of_hashes(monkeypatch, make_text):
    rng = random.Random(4)
    texts = [make_text(rng, n) for n in (200, 3, 0, 1, 90, 5)]
    want = [fingerprint(t) for t in texts]
    monkeypatch.setattr(module, "PIECE", 7)
    assert fingerprints(*byte_buffers(pa.array(texts))).tolist() == want
    assert fingerprints(*byte_buffers(pa.array([], pa.string()))).tolist() == []


@pytest.mark.parametrize("dense", [False, True])
def test_blocks_lose_no_link(monkeypatch, dense):
    monkeypatch.setattr(module, "BLOCK", 8)
    rng = random.Random(dense)
    base = [rng.getrandbits(64) for _ in range(3 if dense else 40)]
    fps = sorted({b ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(4))) & (1 << 64) - 1 for b in base for _ in range(12)})
    a, b = np.array(fps[::2], np.uint64), np.array(fps[1::2], np.uint64)
    found = [links_between(x, y, 4) for x, y in ((a, None), (b, None), (a, b))]
    u, v = (np.concatenate([f[k] for f in found]).tolist() for k in (0, 1))
    place = {f: i for i, f in enumerate(fps)}
    label = list(range(len(fps)))
    for _ in fps:
        for x, y in zip(u, v):
            label[place[x]] = label[place[y]] = min(label[place[x]], label[place[y]])
    want = components(fps)
    assert label == [min(i for i, w in enumerate(want) if w == s) for s in want]
    assert len(u) <= 2 * len(fps)
