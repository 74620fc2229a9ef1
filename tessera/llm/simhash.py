"""SimHash near-duplicates: a 64-bit fingerprint a document, compared exactly in tiles.

A fingerprint bit is set where more than half of the text's shingle hashes set it. Equal fingerprints are one
class. The classes are dealt into tiles of one population count (number of set bits) each; only tiles whose
counts differ by the radius at most can hold links, so only such pairs of tiles meet. A pair of tiles is
compared whole by exclusive-or and bit counts in numpy, in blocks ordered by the counts of the fingerprints'
quarters, where blocks that these counts keep apart are left out. A pair of tiles reports the links that join
what was apart in it (a spanning forest, in chains), not every pair, so a group of M near fingerprints costs
M links a pair of tiles instead of M squared; components over them are those of all links.

Defined results: null and empty texts and texts without words have fingerprint 0 and are linked like any
other; a text with fewer words than a shingle is one shingle; component_id is null only where no document of
the component has an id; rows without an id, or with the same, take part like any other; rows that repeat
share a class; an empty table gives an empty one; other columns are not looked at. A text of n bytes takes
about 30 n bytes of its task's memory: its words' places, and hashes in pieces of PIECE.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_bytes, byte_buffers, hot_keys, lower_ascii, partitions, scratch, shared_dir, ship_code, text_or_empty, with_hot, words_of, written
from .components import components

WIDTH = 4
RADIUS = 4
SEED = 42
#: Fingerprints of a tile, about, and of a block in it.
TILE = 8192
BLOCK = 256
#: Shingle hashes whose bits are added up at once.
PIECE = 1 << 16

Batches = Iterator[pa.RecordBatch]


def joined_words(raw: np.ndarray, offsets: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """The words of all texts with one blank behind each: bytes, starts and ends of the words in them, first word of each text."""
    starts, ends, first = words_of(raw, offsets)
    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    sizes = ends - starts
    at = np.cumsum(sizes + 1) - (sizes + 1)
    out = np.full(int((sizes + 1).sum()), 32, np.uint8)
    inside = ~space
    place = np.arange(int(sizes.sum())) + np.repeat(at - (np.cumsum(sizes) - sizes), sizes)
    out[place] = raw[inside]
    return out.tobytes(), at, at + sizes, first


def bit_counts(hashes: np.ndarray, owner_starts: np.ndarray) -> np.ndarray:
    """How many hashes set each of the 64 bits, lowest first, summed over the runs that begin at `owner_starts`."""
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.add.reduceat(bits, owner_starts, axis=0, dtype=np.int64)


def fingerprints(raw: np.ndarray, offsets: np.ndarray, width: int = WIDTH, seed: int = SEED) -> np.ndarray:
    data, at, to, first = joined_words(lower_ascii(raw), offsets)
    words = np.diff(first)
    counts = np.where(words > 0, np.maximum(words - width + 1, 1), 0)
    owner = np.repeat(np.arange(len(words)), counts)
    begin = first[:-1][owner] + (np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts))
    last = np.minimum(begin + width, first[1:][owner]) - 1
    starts, ends = at[begin], to[last]
    sums = np.zeros((len(words), 64), np.int64)
    digest = xxhash.xxh64_digest
    for a in range(0, len(owner), PIECE):
        some = owner[a : a + PIECE]
        h = np.frombuffer(b"".join([digest(data[i:j], seed) for i, j in zip(starts[a : a + PIECE].tolist(), ends[a : a + PIECE].tolist())]), ">u8")
        heads = np.flatnonzero(np.append(True, some[1:] != some[:-1]))
        sums[some[heads]] += bit_counts(h, heads)
    set_bits = 2 * sums > counts[:, None]
    return np.packbits(set_bits, axis=1, bitorder="little").view("<u8").reshape(-1).astype(np.uint64)


def sign(batches: Batches, width: int, seed: int) -> Batches:
    for part in by_bytes(batches, "text"):
        found = fingerprints(*byte_buffers(part.column("text")), width, seed)
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found.view(np.int64))], ["doc_id", "fp"])


def quarters(fps: np.ndarray) -> np.ndarray:
    return np.bitwise_count(fps.view("<u2").reshape(-1, 4)).astype(np.int8)


def ordered(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprints in the order of their quarters' counts, and each block's least and greatest counts."""
    q = quarters(fps)
    order = np.lexsort((fps, q[:, 3], q[:, 2], q[:, 1], q[:, 0]))
    fps, q = fps[order], q[order]
    heads = np.arange(0, len(fps), BLOCK)
    return fps, np.minimum.reduceat(q, heads, axis=0), np.maximum.reduceat(q, heads, axis=0)


def joined(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The labels after the sets of places i and j have become one, pair by pair."""
    apart = label[i] != label[j]
    if not apart.any():
        return label
    parent = np.arange(len(label))
    for a, b in np.unique(np.stack([label[i[apart]], label[j[apart]]], axis=1), axis=0).tolist():
        while parent[a] != a:
            a = parent[a]
        while parent[b] != b:
            b = parent[b]
        parent[max(a, b)] = min(a, b)
    while (parent != parent[parent]).any():
        parent = parent[parent]
    return parent[label]


def links_between(a: np.ndarray, b: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (u, v) that join all fingerprints of a and b (None: of a alone) which differ by `radius` bits at
    most, directly or over others of them: chains over each component."""
    one, low_1, high_1 = ordered(a)
    two, low_2, high_2 = ordered(b) if b is not None else (one, low_1, high_1)
    every = np.concatenate([one, two]) if b is not None else one
    shift = len(every) - len(two)
    label = np.arange(len(every))
    gaps = np.zeros((len(low_1), len(low_2)), np.int16)
    for k in range(4):
        gaps += np.maximum(0, np.maximum(low_1[:, None, k] - high_2[None, :, k], low_2[None, :, k] - high_1[:, None, k]))
    for x, y in zip(*np.nonzero(gaps <= radius)):
        if b is None and y < x:
            continue
        i, j = np.nonzero(np.bitwise_count(one[x * BLOCK : (x + 1) * BLOCK, None] ^ two[None, y * BLOCK : (y + 1) * BLOCK]) <= radius)
        label = joined(label, i + x * BLOCK, j + y * BLOCK + shift)
    order = np.lexsort((every, label))
    near = label[order][1:] == label[order][:-1]
    chained = every[order]
    return chained[:-1][near], chained[1:][near]


def compare(batches: Batches, radius: int) -> Batches:
    for batch in batches:
        for own, met in zip(batch.column("own").to_pylist(), batch.column("met").to_pylist()):
            u, v = links_between(np.frombuffer(own, "<u8"), None if met is None else np.frombuffer(met, "<u8"), radius)
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])


def pack(key, frames):
    """One row for a tile: its fingerprints, end to end."""
    fps = frames.column("fp").to_numpy().view("<u8")
    return pa.table({"tile": frames.column("tile").slice(0, 1), "fps": pa.array([fps.tobytes()], pa.binary())})


def links(classes: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """u, v: links between distinct fingerprints (column fp) of which every pair within the radius is joined."""
    spark = classes.sparkSession
    ones = F.bit_count("fp").cast("int")
    # one row a population count: 65 at most
    sizes = classes.groupBy(ones.alias("ones")).agg(F.count("*").alias("n"))
    sizes = sizes.select("ones", F.ceil(F.col("n") / tile).cast("int").alias("tiles"))
    dealt = classes.select("fp", ones.alias("ones")).join(F.broadcast(sizes), "ones")
    name = lambda ones, i: F.shiftleft(ones.cast("long"), 32) + i
    dealt = dealt.select(name(F.col("ones"), F.pmod(F.xxhash64("fp"), F.col("tiles"))).alias("tile"), "fp")
    tiles = written(dealt.groupBy("tile").applyInArrow(pack, "tile long, fps binary"), "tiles")
    # which tiles meet: by the counts alone
    own = tiles.select("tile", F.shiftright("tile", 32).cast("int").alias("ones"))
    targets = own.select(F.col("tile").alias("met_tile"), F.explode(F.sequence(F.col("ones") - radius, F.col("ones"))).alias("ones"), F.col("ones").alias("met_ones"))
    pairs = own.join(targets, "ones").where("met_ones > ones or met_tile >= tile").select("tile", "met_tile")
    n = partitions(spark)
    first = pairs.join(tiles.select("tile", F.col("fps").alias("own")).hint("shuffle_hash"), "tile")
    both = first.join(tiles.select(F.col("tile").alias("met_tile"), F.col("fps").alias("met_fps")).hint("shuffle_hash"), "met_tile")
    both = both.select("tile", "met_tile", "own", F.when(F.col("tile") != F.col("met_tile"), F.col("met_fps")).alias("met"))
    return both.repartition(n, "tile", "met_tile").select("own", "met").mapInArrow(lambda x: compare(x, radius), "u long, v long")


def simhash_groups(docs: DataFrame, radius: int = RADIUS, width: int = WIDTH, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint, component_id for every row of `docs`.

    The result is written to the shared folder; the tables on the way to it are deleted.
    """
    spark = docs.sparkSession
    ship_code(spark)
    path = shared_dir(spark, "simhash")
    with scratch(spark, "simhash"):
        rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
        signed = written(rows.mapInArrow(lambda x: sign(x, width, seed), "doc_id long, fp long"), "signed")
        classes = written(signed.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "classes")
        labels = components(written(links(classes, radius), "links"))
        # components of one class have no label: theirs is the class itself
        named = classes.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
        named = written(named, "named")
        least = written(named.groupBy("label").agg(F.min("least").alias("component_id"), F.sum("n").alias("n")), "least")
        found = written(with_hot(named.select("fp", "label", "n"), least.select("label", "component_id"), "label", hot_keys(least)).select("fp", "n", "component_id"), "found")
        out = with_hot(signed, found.select("fp", "component_id"), "fp", hot_keys(found))
        out = out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
        out.write.parquet(path)
    return spark.read.schema(out.schema).parquet(path)


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
