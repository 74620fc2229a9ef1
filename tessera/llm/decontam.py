"""Benchmark decontamination by latent semantic retrieval.

1. Document frequencies of hashed words over all passages (32 words).
2. A randomised SVD of the matrix of TF-IDF passages A, distributed: every task throws its passages
   on a random test matrix O, Z = A O, and adds up Z'Z and A'Z. From Z'Z = R'R follows the orthonormal
   basis Q = Z R^-1, and from A'Z the small matrix B = Q'A, whose SVD gives the latent directions.
   Tasks send sums of a fixed size, so small splits share a task; the driver gets one matrix of (buckets x rank).
3. Candidate search: windows of every document (16 words a step of 8, 32 words a step of 16) and the
   benchmark's items are projected and compared by cosine, in the pass that reads the texts.
4. Candidates are checked by the longest common subsequence of words of the item and the document
   around the window. A document contains an item if the subsequence covers `least_lcs` of the item,
   or `paraphrase_lcs` of it and nearly all of its answer.

A word that repeats one of the two before it does not count: a passage of one word over and over would
stand for nothing else. A word's weight is sqrt(passages / passages with it): with it all words have equal energy in A, so that
the directions follow which words go together and not which are frequent. Words in more than
`most_share` of the passages have no weight. Where a document is copied so often that its own words
have none, cosines do not find the item: items with weight in less than
`LEAST_HEAVY` of their words, or in fewer than `least_words`, are also searched exactly, by counting
their words in every stretch of their length; stretches that cannot hold `paraphrase_lcs` of the item
are passed over, the others checked as in 4. Items of fewer than `least_words` words are found where
they stand word for word: digests of as many words as they have, at every word of a text, are looked up
in the sorted digests of the items, so that their number does not multiply the texts'.

Documents are never shuffled, and a passage that many documents share costs what any other does. Items
are broadcast in blocks of bounded size.

Defined results: null and empty texts contain nothing; items without text or with fewer than
`shortest` words (four by default: shorter ones are common speech; with 1 all are searched) are left out; items without an answer are taken to have
their last sentence for one; null ids and repeated documents are treated like any others, an item that
repeats with id and answer is one; of several places the one that holds most of the item is reported, of
equal ones the first; an empty table on either side gives an empty result; other columns are ignored (or
kept, by `decontaminate`).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_bytes, byte_buffers, give_back, lower_ascii, mix64, partitions, segment_hashes, ship_code, text_or_empty, words_of
from .toxicity import _SPACE

Batches = Iterator[pa.RecordBatch]
BUCKETS = 1 << 15
RANK, EXTRA = 96, 8
STEP = 8
SMALL = 24
COSINE = 0.42
#: Least share of an item's weighted words (or of a window's, if the item has more) to go on to the subsequence.
BAG = 0.3
FOLD = 1 << 12
LEAST_LCS = 0.7
PARAPHRASE_LCS = 0.5
LEAST_WORDS = 8
SHORTEST = 4
LEAST_HEAVY = 1 / 3
MOST_SHARE = 0.02
ITEM_BLOCK = 4096
CHUNK = 1024
SLICE = 1 << 20
#: Tasks that make sums, at most; splits that share a task, where that leaves every core two; groups in which sums are
#: added up before they meet, at most, and tasks of a group, at least.
MOST_TASKS = 8192
SPLITS = 4
GROUPS = 8
GROUP_TASKS = 16


def tokens(raw: np.ndarray, offsets: np.ndarray):
    """Hashes of the words (letters and digits, lowered), their bytes, and each text's first word."""
    low = lower_ascii(raw)
    if len(low):
        latin = np.append(False, low[:-1] == 0xC3) & (low >= 0x80) & (low <= 0x9E) & (low != 0x97)
        low = low + (latin.astype(np.uint8) << 5)
    starts, ends, first = words_of(low, offsets, _SPACE[low])
    words = segment_hashes(low, starts, ends)
    new = np.ones(len(words), bool)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    for k in (1, 2):
        new[k:] &= (words[k:] != words[:-k]) | (row[k:] != row[:-k])
    return words[new], starts[new], ends[new], np.append(0, np.cumsum(new))[first]


def bucket_of(words: np.ndarray) -> np.ndarray:
    return (words % np.uint64(BUCKETS)).astype(np.int64)


def numbered(first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Blocks of `size` words: the block of each word, and the text of each block."""
    counts = np.diff(first)
    blocks = -(-counts // size)
    base = np.append(0, np.cumsum(blocks))
    place = np.arange(first[-1]) - np.repeat(first[:-1], counts)
    return np.repeat(base[:-1], counts) + place // size, np.repeat(np.arange(len(counts)), blocks)


def frequencies(batches: Batches) -> Batches:
    """(bucket, passages with it) of this task; bucket -1 counts its passages."""
    total, passages = np.zeros(BUCKETS, np.int64), 0
    for part in by_bytes(batches, "text", SLICE):
        words, _, _, first = tokens(*byte_buffers(part.column("text")))
        block, owner = numbered(first, 4 * STEP)
        passages += len(owner)
        pairs = block * BUCKETS + bucket_of(words)
        pairs = np.sort(pairs.astype(np.uint32) if len(owner) < 1 << 17 else pairs)
        new = pairs[np.append(True, pairs[1:] != pairs[:-1])[: len(pairs)]]
        total += np.bincount(new % BUCKETS, minlength=BUCKETS)
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(total[some], passages))], ["bucket", "n"])


def weights(docs: DataFrame) -> np.ndarray:
    counts = docs.mapInArrow(frequencies, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(BUCKETS)
    known = counts[counts.bucket >= 0]
    df[known.bucket.to_numpy()] = known.n.to_numpy()
    passages = max(1, int(counts[counts.bucket < 0].n.sum()))
    w = np.sqrt(passages / (df + 1))
    w[df > max(MOST_SHARE * passages, 20)] = 0
    return w.astype(np.float32)


def add_rows(out: np.ndarray, at: np.ndarray, table: np.ndarray, rows: np.ndarray, piece: int = 1 << 14) -> None:
    """out[at] += table[rows], for places in ascending order: piece by piece, which the processor's cache
    holds, and there in turns, within which no place comes twice."""
    lead = np.flatnonzero(np.append(True, at[1:] != at[:-1])[: len(at)])
    rank = np.arange(len(at)) - np.repeat(lead, np.diff(np.append(lead, len(at))))
    for k in range(0, len(at), piece):
        own = rank[k : k + piece]
        order = np.argsort(own.astype(np.uint16) if own.max() < 1 << 16 else own, kind="stable") + k
        cuts = np.cumsum(np.unique(own, return_counts=True)[1]).tolist()
        for a, b in zip([0, *cuts], cuts):
            some = order[a:b]
            out[at[some]] += table[rows[some]]


def project(words: np.ndarray, first: np.ndarray, weight: np.ndarray, table: np.ndarray, size: int):
    """Sum over each block of the words' weighted rows of `table`; the text of each block."""
    block, owner = numbered(first, size)
    bucket = bucket_of(words)
    some = np.flatnonzero(weight[bucket] > 0)
    out = np.zeros((len(owner), table.shape[1]), np.float32)
    add_rows(out, block[some], table, bucket[some])
    return out, owner


def throw(batches: Batches, weight: np.ndarray, seed: int, groups: int) -> Batches:
    """This task's Z'Z and A'Z as rows (chunk, part): chunk -1 is Z'Z."""
    test = np.random.default_rng(seed).normal(size=(BUCKETS, RANK + EXTRA)).astype(np.float32) * weight[:, None]
    zz, az = np.zeros((RANK + EXTRA,) * 2), np.zeros((BUCKETS, RANK + EXTRA), np.float32)
    for part in by_bytes(batches, "text", SLICE):
        words, _, _, first = tokens(*byte_buffers(part.column("text")))
        z, owner = project(words, first, weight, test, 4 * STEP)
        zz += z.T @ z
        block, _ = numbered(first, 4 * STEP)
        bucket = bucket_of(words)
        some = np.flatnonzero(weight[bucket] > 0)
        some = some[np.argsort(bucket[some].astype(np.uint16), kind="stable")]
        add_rows(az, bucket[some], z, block[some], len(some) or 1)
    az *= weight[:, None]
    parts = [(-1, zz.tobytes())] + [(c, az[c * CHUNK : (c + 1) * CHUNK].tobytes()) for c in range(BUCKETS // CHUNK)]
    group = TaskContext.get().partitionId() % groups
    yield pa.RecordBatch.from_arrays([pa.array([group] * len(parts), pa.int32()), pa.array([c for c, _ in parts], pa.int32()), pa.array([b for _, b in parts], pa.binary())], ["group", "chunk", "part"])


def add_up(batches: Batches, kind: type, out: type) -> Batches:
    """Rows of a group and chunk, of numbers of one kind, summed within this task in double precision, as another."""
    total: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        for i in range(batch.num_rows):
            key = group, chunk = batch.column("group")[i].as_py(), batch.column("chunk")[i].as_py()
            part = np.frombuffer(batch.column("part")[i].as_py(), np.float64 if chunk < 0 else kind)
            if key in total:
                total[key] += part
            else:
                total[key] = part.astype(np.float64)
    if total:
        yield pa.RecordBatch.from_arrays(
            [pa.array([g for g, _ in total], pa.int32()), pa.array([c for _, c in total], pa.int32()), pa.array([(x if c < 0 else x.astype(out)).tobytes() for (_, c), x in total.items()], pa.binary())], ["group", "chunk", "part"]
        )


def summing_tasks(docs: DataFrame) -> int:
    """Tasks that make sums of `docs`: a task's sums have a fixed size (14 MB), however little it reads, so splits
    share tasks."""
    cores = docs.sparkSession.sparkContext.defaultParallelism
    return min(MOST_TASKS, max(2 * cores, -(-docs.rdd.getNumPartitions() // SPLITS)))


def latent_space(docs: DataFrame, weight: np.ndarray, seed: int = 11) -> np.ndarray:
    """Each bucket's weighted coordinates along the leading right singular vectors of A, over their singular values."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(weight)
    tasks = summing_tasks(docs)
    groups = min(GROUPS, max(1, tasks // GROUP_TASKS))
    sums = docs.coalesce(tasks).mapInArrow(lambda b: throw(b, sent.value, seed, groups), "group int, chunk int, part binary")
    for keys, kind, kept in ((["group", "chunk"], np.float32, np.float64), (["chunk"], np.float64, np.float32)):
        sums = sums.repartition(partitions(spark), *keys).mapInArrow(lambda b, kind=kind, kept=kept: add_up(b, kind, kept), "group int, chunk int, part binary").withColumn("group", F.lit(0))
    found = {r["chunk"]: r["part"] for r in sums.collect()}
    if not found:
        return np.zeros((BUCKETS, RANK), np.float32)
    zz = np.frombuffer(found.pop(-1), np.float64).reshape(RANK + EXTRA, RANK + EXTRA)
    values, vectors = np.linalg.eigh(zz)
    good = values > 1e-9 * max(values.max(), 1e-30)
    if not good.any():  # no word has weight
        return np.zeros((BUCKETS, RANK), np.float32)
    basis = vectors[:, good] / np.sqrt(values[good])  # Z @ basis is orthonormal
    # B = Q'A chunk by chunk: its left singular vectors and values from BB', the right ones from these
    part = lambda c: np.frombuffer(found[c], np.float32).reshape(CHUNK, -1) @ basis
    gram = sum(x.T @ x for x in map(part, sorted(found)))
    squares, left = np.linalg.eigh(gram)
    keep = (squares > 1e-12 * max(squares.max(), 1e-30)) & (np.arange(len(squares)) >= len(squares) - RANK)
    out = np.zeros((BUCKETS, RANK), np.float32)
    for c in sorted(found):
        out[c * CHUNK : (c + 1) * CHUNK, : keep.sum()] = part(c) @ (left[:, keep] / squares[keep])
    out *= weight[:, None]
    return out


@dataclass
class Items:
    """A block of benchmark items: their words, answers, windows in latent space, by scale, those with too little weight for it,
    and the short ones by length: their digests in order, and their numbers."""

    ids: list[int]
    words: list[np.ndarray]
    answers: list[np.ndarray]
    bags: np.ndarray
    least: np.ndarray
    queries: dict[int, tuple[np.ndarray, np.ndarray]]
    weak: list[int]
    short: dict[int, tuple[np.ndarray, np.ndarray]]


def last_sentence(text: str) -> str:
    parts = [p for p in text.replace("\n", " ").replace("?", ".").replace("!", ".").split(".") if p.strip()]
    return parts[-1] if parts else ""


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """A digest of the n words from each word on."""
    out = np.zeros(max(0, len(words) - n + 1), np.uint64)
    for j in range(n):
        out = mix64(out ^ words[j : j + len(out)])
    return out


def prepare(rows: list[tuple[int, str, str | None]], weight: np.ndarray, space: np.ndarray, shortest: int) -> Items:
    words, _, _, first = tokens(*byte_buffers(pa.array([t for _, t, _ in rows], pa.string())))
    replies, _, _, at = tokens(*byte_buffers(pa.array([a if a else last_sentence(t) for _, t, a in rows], pa.string())))
    items = Items([], [], [], np.zeros((len(rows), FOLD), bool), np.zeros(len(rows)), {}, [], {})
    short: dict[int, list] = {}
    vectors: dict[int, list] = {2: [], 4: []}
    for i, (item, _, _) in enumerate(rows):
        own = words[first[i] : first[i + 1]]
        if len(own) < max(1, shortest):
            continue
        if len(own) < LEAST_WORDS:
            short.setdefault(len(own), []).append((int(grams(own, len(own))[0]), len(items.ids)))
            items.ids.append(item)
            items.words.append(own)
            items.answers.append(own)
            continue
        scale = 2 if len(own) < SMALL else 4
        length = scale * STEP
        begins = range(0, max(1, len(own) - length + 1), 4)
        for a in {*begins, max(0, len(own) - length)}:
            vectors[scale].append((len(items.ids), space[bucket_of(own[a : a + length])].sum(axis=0)))
        heavy = bucket_of(own)[weight[bucket_of(own)] > 0]
        if len(heavy) < max(LEAST_WORDS, LEAST_HEAVY * len(own)):
            items.weak.append(len(items.ids))
        items.bags[len(items.ids), heavy % FOLD] = True
        items.least[len(items.ids)] = BAG * min(len(heavy), len(heavy) * length / len(own))
        items.ids.append(item)
        items.words.append(own)
        items.answers.append(replies[at[i] : at[i + 1]])
    for n, some in short.items():
        digests, which = zip(*sorted(some))
        items.short[n] = np.array(digests, np.uint64), np.array(which)
    for scale, some in vectors.items():
        if some:
            v = np.stack([x for _, x in some])
            items.queries[scale] = np.array([i for i, _ in some]), normal(v)
    return items


def normal(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.sqrt(np.einsum("ij,ij->i", v, v)), 1e-20)[:, None]


def lcs(item: np.ndarray, region: np.ndarray) -> int:
    """Length of the longest common subsequence, by bits."""
    masks: dict[int, int] = {}
    for i, w in enumerate(item.tolist()):
        masks[w] = masks.get(w, 0) | (1 << i)
    full = (1 << len(item)) - 1
    v = full
    for w in region.tolist():
        m = masks.get(w)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(item) - v.bit_count()


def answered(answer: np.ndarray, region: np.ndarray) -> bool:
    return len(answer) > 0 and lcs(answer, region) >= 0.9 * len(answer)


def check(item: np.ndarray, answer: np.ndarray, words: np.ndarray, a: int, b: int) -> tuple[float, int, int] | None:
    """Share of the item in the words around [a, b), and the span of its words there, if it is contained."""
    low, high = max(0, a - len(item)), min(len(words), b + len(item))
    region = words[low:high]
    there = set(region.tolist())
    if sum(w in there for w in item.tolist()) < PARAPHRASE_LCS * len(item):  # no subsequence is longer
        return None
    share = lcs(item, region) / len(item)
    if share < PARAPHRASE_LCS:
        return None
    if share < LEAST_LCS and not answered(answer, region):
        return None
    # the densest stretch of about the item's length that still holds as much of it
    best = (0, low, high)
    for s in range(0, max(1, len(region) - len(item) + 1), 4):
        n = lcs(item, region[s : s + len(item) + 4])
        best = max(best, (n, -(low + s), 0))
    if best[0] < PARAPHRASE_LCS * len(item):
        return None
    s = -best[1]
    inside = np.flatnonzero(np.isin(words[s : s + len(item) + 4], item))
    share = best[0] / len(item)
    if share < LEAST_LCS and not answered(answer, region):
        return None
    return share, s + int(inside[0]), s + int(inside[-1]) + 1


def windows(blocks: np.ndarray, owner: np.ndarray, scale: int) -> np.ndarray:
    """Sum of the `scale` blocks from each block on, within its text."""
    out = blocks.copy()
    for j in range(1, scale):
        # all but the last of each text have a block j further on: those get a block of zeros instead
        other = np.flatnonzero(owner[j:] != owner[:-j])
        theirs = blocks[j:][other]
        blocks[j:][other] = 0
        out[: len(out) - j] += blocks[j:]
        blocks[j:][other] = theirs
    return out


def verbatim(words: np.ndarray, first: np.ndarray, items: Items) -> Iterator[tuple[int, int, int]]:
    """(item number, row, first word of all) where a short item stands word for word in a row for the first time."""
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    for n, (digests, which) in items.short.items():
        own = grams(words, n)
        low = np.searchsorted(digests, own)
        at = np.flatnonzero((digests[np.minimum(low, len(digests) - 1)] == own) & (row[: len(own)] == row[n - 1 :]))
        at = at[np.unique(row[at] * len(digests) + low[at], return_index=True)[1]]
        for x, k, end in zip(at.tolist(), low[at].tolist(), np.searchsorted(digests, own[at], side="right").tolist()):
            for i in which[k:end].tolist():
                if np.array_equal(words[x : x + n], items.words[i]):
                    yield i, int(row[x]), x


def stretches(words: np.ndarray, first: np.ndarray, items: Items) -> Iterator[tuple[int, int, int]]:
    """(item number, row, first word in it) of the stretches that may hold enough of an item of little weight, by row and place."""
    vocabulary = np.unique(np.concatenate([items.words[i] for i in items.weak]))
    near = np.minimum(np.searchsorted(vocabulary, words), len(vocabulary) - 1)
    code = np.append(np.where(vocabulary[near] == words, near, len(vocabulary)), len(vocabulary))
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    at = np.flatnonzero((np.arange(len(words)) - first[row]) % 4 == 0)
    for i in items.weak:
        own, times = np.unique(items.words[i], return_counts=True)
        least, size = PARAPHRASE_LCS * len(items.words[i]), len(items.words[i]) + 8
        number = np.full(len(vocabulary) + 1, len(own))
        number[np.searchsorted(vocabulary, own)] = np.arange(len(own))
        mine = number[code]
        total = np.append(0, np.cumsum(mine[:-1] < len(own)))
        end = np.minimum(at + size, first[row[at] + 1])
        dense = np.flatnonzero(total[end] - total[at] >= least)
        for k in range(0, len(dense), CHUNK):
            some = dense[k : k + CHUNK]
            place = at[some, None] + np.arange(size)
            there = np.zeros((len(some), len(own) + 1), bool)
            there[np.arange(len(some))[:, None], mine[np.where(place < end[some, None], place, len(words))]] = True
            for x in at[some[there[:, :-1] @ times >= least]].tolist():
                yield i, int(row[x]), x - int(first[row[x]])


def cosine_of(a: np.ndarray, b: np.ndarray, space: np.ndarray) -> float:
    p, q = (space[bucket_of(w)].sum(axis=0) for w in (a, b))
    return float(p @ q / max(np.linalg.norm(p) * np.linalg.norm(q), 1e-20))


def matches(part: pa.Array, items: Items, weight: np.ndarray, space: np.ndarray) -> dict[int, dict[int, tuple]]:
    """row -> item number -> (share, cosine, first byte, end byte), best of each."""
    words, starts, ends, first = tokens(*byte_buffers(part))
    found: dict[int, dict[int, tuple]] = {}
    if not len(words) or not items.ids:
        return found
    blocks, owner = project(words, first, weight, space, STEP)
    bucket = np.append(bucket_of(words), 0)
    folded, heavy = bucket % FOLD, np.append(weight[bucket[:-1]] > 0, False)
    base = np.searchsorted(owner, owner)  # first block of each block's text
    for scale, (which, queries) in items.queries.items():
        w = windows(blocks, owner, scale)
        number = np.arange(len(owner)) - base
        at = np.flatnonzero(number % (scale // 2) == 0)
        v = normal(w[at])
        for k in range(0, len(at), 4096):
            for q in range(0, len(queries), 4096):
                some = queries[q : q + 4096]
                r, c = np.divmod(np.flatnonzero(v[k : k + 4096] @ some.T >= COSINE), len(some))
                block, item = at[k + r], which[q + c]
                begin = first[owner[block]] + number[block] * STEP
                place = begin[:, None] + np.arange(scale * STEP)
                place = np.where(place < first[owner[block] + 1][:, None], place, len(words))
                shared = items.bags[item[:, None], folded[place]] & heavy[place]
                for x in np.flatnonzero(shared.sum(axis=1) >= items.least[item]).tolist():
                    row, i, a = int(owner[block[x]]), int(item[x]), int(number[block[x]]) * STEP
                    seen = found.setdefault(row, {})
                    if i in seen and (seen[i][4] == a or seen[i][0] == 1.0):
                        continue
                    hit = check(items.words[i], items.answers[i], words[first[row] : first[row + 1]], a, a + scale * STEP)
                    if hit and (i not in seen or hit[0] > seen[i][0]):
                        s, e = first[row] + hit[1], first[row] + hit[2] - 1
                        cosine = float(v[k + r[x]] @ queries[q + c[x]])
                        seen[i] = (hit[0], cosine, int(starts[s]), int(ends[e]), a)
    passed: dict[tuple[int, int], int] = {}
    for i, row, a in stretches(words, first, items) if items.weak else ():
        seen, size = found.setdefault(row, {}), len(items.words[i])
        if a <= passed.get((i, row), -1) or i in seen and seen[i][0] == 1.0:
            continue
        passed[i, row] = a + size // 2
        hit = check(items.words[i], items.answers[i], words[first[row] : first[row + 1]], a, a + size)
        if hit and (i not in seen or hit[0] > seen[i][0]):
            s, e = first[row] + hit[1], first[row] + hit[2] - 1
            seen[i] = (hit[0], cosine_of(words[s : e + 1], items.words[i], space), int(starts[s]), int(ends[e]), a)
    for i, row, s in verbatim(words, first, items):
        e = s + len(items.words[i]) - 1
        found.setdefault(row, {})[i] = (1.0, cosine_of(words[s : e + 1], items.words[i], space), int(starts[s]), int(ends[e]), s - int(first[row]))
    return {row: hits for row, hits in found.items() if hits}


def item_blocks(benchmark: DataFrame, weight: np.ndarray, space: np.ndarray, shortest: int) -> Iterator[Items]:
    """The items in blocks of about ITEM_BLOCK, each small enough to broadcast."""
    answer = F.col("answer").cast("string") if "answer" in benchmark.columns else F.lit(None).cast("string")
    rows = benchmark.where("text is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"), answer.alias("answer"))
    rows = rows.distinct()
    n = -(-rows.count() // ITEM_BLOCK)
    for k in range(n):
        some = rows.where(F.pmod(F.xxhash64("item_id", "text", "answer"), F.lit(n)) == k).collect()
        yield prepare([tuple(r) for r in some], weight, space, shortest)


def model_of(docs: DataFrame, text_col: str) -> tuple[np.ndarray, np.ndarray]:
    ship_code(docs.sparkSession)
    texts = docs.select(text_or_empty(text_col).alias("text"))
    weight = weights(texts)
    space = latent_space(texts, weight)
    give_back()  # the sums
    return weight, space


HITS = "doc_id long, item_id long, lcs double, cosine double, start int, end int"


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = SHORTEST) -> DataFrame:
    """doc_id, item_id, share of the item (lcs), cosine, and the span of characters, of every item found in a document."""
    spark = docs.sparkSession
    weight, space = model_of(docs, text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    out = spark.createDataFrame([], HITS)
    for items in item_blocks(benchmark, weight, space, shortest):
        sent = spark.sparkContext.broadcast((items, weight, space))

        def search(batches: Batches, sent=sent) -> Batches:
            items, weight, space = sent.value
            for part in by_bytes(batches, "text", SLICE):
                found = []
                for row, hits in matches(part.column("text"), items, weight, space).items():
                    doc, raw = part.column("doc_id")[row].as_py(), part.column("text")[row].as_py().encode()
                    _, off = byte_buffers(part.column("text").slice(0, row))
                    for item, (share, cosine, a, b, _) in hits.items():
                        a, b = (len(raw[: x - int(off[-1])].decode(errors="replace")) for x in (a, b))
                        found.append((doc, items.ids[item], share, cosine, a, b))
                if found:
                    kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int32(), pa.int32()]
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found), kinds)], ["doc_id", "item_id", "lcs", "cosine", "start", "end"])

        out = out.unionByName(rows.mapInArrow(search, HITS))
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", shortest: int = SHORTEST) -> DataFrame:
    """The rows of `docs`, with all their columns, that contain no item of the benchmark."""
    weight, space = model_of(docs, text_col)
    spark = docs.sparkSession
    out = docs
    for items in item_blocks(benchmark, weight, space, shortest):
        sent = spark.sparkContext.broadcast((items, weight, space))

        def keep(batches: Batches, sent=sent) -> Batches:
            for part in by_bytes(batches, text_col, SLICE):
                found = matches(part.column(text_col).fill_null(""), *sent.value)
                yield part.filter(pa.array([i not in found for i in range(part.num_rows)]))

        out = out.mapInArrow(keep, docs.schema)
    return out


def op2_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
