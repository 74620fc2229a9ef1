import random
import re

import numpy as np

from tessera.llm import decontam
from tessera.llm.decontam import decontaminate, find_leaks


def word(rng):
    return "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(3, 8)))


def prose(rng, n):
    return " ".join(rng.choice(["the", "of", "and", "in"]) if rng.random() < 0.4 else word(rng) for _ in range(n))


def told(text):
    """Words of a text as the search sees them: lowered, and without those that repeat one of the two before."""
    words = re.findall(r"[a-z0-9]+", text.lower())
    return [w for i, w in enumerate(words) if w not in words[max(0, i - 2) : i]]


def subsequence(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j], row[j + 1])
    return row[-1]


def holds(item, text, slack=0.0):
    """Whether a stretch of the text holds the item, by trying all of them."""
    own, words, answer = told(item), told(text), told([p for p in item.split(".") if p.strip()][-1])
    size = len(own) + 4
    for s in range(0, max(1, len(words) - size + 1)):
        part = words[s : s + size]
        if sum(w in part for w in own) < 0.5 * len(own):
            continue
        share = subsequence(own, part) / len(own)
        around = words[max(0, s - len(own)) : s + size + len(own)]
        if share >= 0.7 + slack or share >= 0.5 + slack and subsequence(answer, around) >= 0.9 * len(answer):
            return True
    return False


def test_against_every_stretch_of_every_document(spark):
    rng = random.Random(41)
    items = {i: f"{prose(rng, rng.randrange(14, 50))}. {prose(rng, 6)}." for i in range(16)}
    docs = {}
    for d in range(240):
        body = prose(rng, rng.randrange(30, 120)).split()
        if d % 2 == 0:  # from word for word down to every second word
            keep = rng.choice([1.0, 0.9, 0.8, 0.7, 0.6, 0.5])
            put = [w if rng.random() < keep else word(rng) for w in items[d // 2 % 16].split()]
            at = rng.randrange(len(body))
            body[at:at] = put
        docs[d] = " ".join(body)
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in find_leaks(df, bench).collect()}
    sure = {(d, i) for d in docs for i in items if holds(items[i], docs[d], 0.05)}
    some = {(d, i) for d in docs for i in items if (d, i) in found and holds(items[i], docs[d], -0.05)}
    assert len(sure) > 60 and len(found & sure) >= 0.9 * len(sure)
    assert found == some


def test_a_passage_in_a_fifth_of_the_documents_is_found_in_all(spark, sf):
    rng = random.Random(42)
    items = spark.read.parquet(f"{sf}/benchmark.parquet").orderBy("item_id").collect()
    docs = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        words = (r.text or "").split()
        if r.doc_id % 5 == 0:
            at = rng.randrange(len(words) + 1)
            words[at:at] = items[3].text.split()
        docs[r.doc_id] = " ".join(words + (items[11].text.split() if r.doc_id == 7 else []))
    bench = spark.createDataFrame([(r.item_id, r.text) for r in items], "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in find_leaks(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), bench).collect()}
    assert {d for d, i in found if i == items[3].item_id} >= {d for d in docs if d % 5 == 0}
    assert (7, items[11].item_id) in found


def test_short_items_answers_and_repeated_items(spark):
    rng = random.Random(43)
    items = [(1, "who wrote the green river book", None), (2, "too short", None), (3, prose(rng, 30), "forty two"), (3, None, "x"), (None, prose(rng, 20), None), (4, "the of and in the of", None)]
    items += [items[0]] * 3
    half = [w if k % 20 < 10 else word(rng) for k, w in enumerate(items[2][1].split())]
    docs = {
        0: f"{prose(rng, 20)} Who wrote the green River book? {prose(rng, 9)}",
        1: f"who wrote a green river book {prose(rng, 20)} too short",
        2: f"{prose(rng, 10)} {' '.join(half)} forty two {prose(rng, 10)}",
        3: f"{prose(rng, 10)} {' '.join(half)} forty {prose(rng, 10)}",
        4: items[4][1],
    } | {d: prose(rng, rng.randrange(30, 200)) for d in range(5, 150)}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string, answer string")
    rows = find_leaks(df, bench).collect()
    assert sorted(((r.doc_id, r.item_id) for r in rows), key=str) == [(0, 1), (2, 3), (4, None)]
    first = next(r for r in rows if r.doc_id == 0)
    assert docs[0][first.start : first.end] == "Who wrote the green River book"


def test_items_in_a_third_of_the_rows_are_found_everywhere(spark):
    rng = random.Random(16)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(3, 8)))
    text = lambda n: " ".join(rng.choice(["the", "of", "and", "in"]) if rng.random() < 0.4 else word() for _ in range(n))
    items = {i: text(n) + "." for i, n in enumerate([40, 18, 60, 30])}
    hot = " ".join([text(50), items[0], text(30), items[1], text(20)])
    docs, leaked = {}, set()
    for d in range(240):
        body = text(rng.randrange(40, 200)).split()
        if d % 3 == 0:
            body = hot.split()
            leaked |= {(d, 0), (d, 1)}
        elif d % 10 == 1:  # items of the copied document, and others, outside it
            i = d // 10 % 4
            put = items[i].split()
            if d % 20 == 1:
                put = [word() if k % 9 == 4 else w for k, w in enumerate(put)]
            at = rng.randrange(len(body))
            body[at:at] = put
            leaked.add((d, i))
        docs[d] = " ".join(body)
    assert {i for d, i in leaked if d % 3} == set(items)
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    found = find_leaks(df, bench).collect()
    assert {(r.doc_id, r.item_id) for r in found} == leaked and len(found) == len(leaked)
    assert all(0 <= r.start < r.end <= len(docs[r.doc_id]) for r in found)
    assert {r.doc_id for r in decontaminate(df, bench).collect()} == set(docs) - {d for d, _ in leaked}


def test_items_of_one_to_seven_words_against_brute_force(spark):
    """`shortest=1` searches every item; a thousand short ones, some of them under several ids."""
    rng = random.Random(5)
    some = [word(rng) for _ in range(60)]

    def words_in_turn(n):  # none repeats one of the two before it
        out = []
        for _ in range(n):
            out.append(rng.choice([w for w in some if w not in out[-2:]]))
        return out

    docs = {d: words_in_turn(rng.randrange(0, 120)) for d in range(80)}
    items = {i: words_in_turn(1 + i % 7) for i in range(1000)}
    for i in range(0, 1000, 11):  # what stands somewhere
        d = docs[rng.randrange(80)]
        at, n = rng.randrange(len(d) + 1), 1 + rng.randrange(7)
        items[i] = d[at : at + n] or items[i]
    items[1001], items[1002] = items[0], items[0]
    want = {(d, i) for d, t in docs.items() for i, w in items.items() if any(t[s : s + len(w)] == w for s in range(len(t) - len(w) + 1))}
    df = spark.createDataFrame([(d, " ".join(t)) for d, t in docs.items()], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")
    rows = find_leaks(df, bench, shortest=1).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == want and len(rows) == len(want) > 300
    assert {len(items[i]) for _, i in want} == set(range(1, 8))
    assert all(" ".join(docs[r.doc_id])[r.start : r.end] == " ".join(items[r.item_id]) for r in rows)
    long = {(r.doc_id, r.item_id) for r in find_leaks(df, bench).collect()}
    assert long == {(d, i) for d, i in want if len(items[i]) >= 4}
    assert {r.doc_id for r in decontaminate(df, bench).collect()} == set(docs) - {d for d, _ in long}


def test_small_splits_share_their_sums(spark, monkeypatch, tmp_path):
    rng = random.Random(8)
    spark.createDataFrame([(prose(rng, 60),) for _ in range(200)], "text string").repartition(40).write.parquet(str(tmp_path / "docs"))
    sent, throw = spark.sparkContext.accumulator(0), decontam.throw

    def counted(batches, *rest):
        for batch in throw(batches, *rest):
            sent.add(1)
            yield batch

    monkeypatch.setattr(decontam, "throw", counted)
    monkeypatch.setattr(decontam, "MOST_SHARE", 1.0)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")  # a split for each file
    try:
        docs = spark.read.parquet(str(tmp_path / "docs"))
        splits = docs.rdd.getNumPartitions()
        space = decontam.latent_space(docs, decontam.weights(docs))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert splits >= 40
    assert 0 < sent.value <= max(2 * spark.sparkContext.defaultParallelism, -(-splits // decontam.SPLITS))
    one = decontam.latent_space(docs.coalesce(1), decontam.weights(docs))
    # the same space: directions may have another sign
    assert np.allclose(np.abs(space @ space[:50].T), np.abs(one @ one[:50].T), rtol=1e-2, atol=1e-4 * np.abs(one).max() ** 2)
