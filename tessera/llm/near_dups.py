"""Near-duplicate documents by fast similarity sketches, banding and exact verification.

Words are `[^\\x20\\x09-\\x0D]+` of the text with A-Z lowered; a document's set holds its distinct
five-word shingles. Documents are linked where 100 * intersection >= 75 * union, and a document's
component is the smallest id reachable over links.

1. Documents with equal sets fall into one class; only one document of a class goes on.
2. Classes are sketched (128 coordinates) and banded (32 bands of 4: a pair at similarity 0.75 shares
   none with probability 5e-6).
3. Star round: each class meets the hub of one of its buckets, the one it shares most bands with; a
   bucket's hub is the member with the most company over all of its bands: what others are copies of. Links are confirmed on full sets; components are taken.
4. Bridge round: a bucket that holds several components compares a member of each with one of its
   largest, the members with the most company.
5. Closing round: where buckets still hold several components, every pair over components is
   compared by sketch, in blocks, and those whose sketches do not rule a link out are confirmed on
   full sets. So no link that banding found is lost, while within a component pairs need not be made.

Hot buckets are pre-aggregated or salted; no group is held whole by one task.

Defined results: null and empty texts, and texts without words, have empty sets, are linked with
nothing and are their own components; rows that share an id count as one document; a row without an
id takes part and gets the smallest id reachable, or null; ids lie below 2**62; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_bytes, byte_buffers, give_back, partitions, scratch, shared_dir, ship_code, text_or_empty, written
from .components import components
from .shingles import T, band_keys, set_digests, shingle_sets, similar, sketches, small_sketch

Batches = Iterator[pa.RecordBatch]
SIGNATURES = "doc_id long, n_shingles long, d1 long, d2 long, bands array<long>, sketch binary"
NO_ID = 1 << 62
BRIDGE_ROUNDS = 1
BLOCK = 1024
#: Least number of 128 equal coordinates: 0.75 less six standard deviations.
LEAST_EQUAL = int(0.75 * T - 6 * (T * 0.75 * 0.25) ** 0.5)


def sign(batches: Batches) -> Batches:
    for part in by_bytes(batches, "text", 2 << 20):
        one, two = shingle_sets(*byte_buffers(part.column("text")))
        d1, d2 = set_digests(one, two)
        s = sketches(*one)
        bands = band_keys(s).view(np.int64)
        small = small_sketch(s).tobytes()
        width = 2 * s.shape[1]
        yield pa.RecordBatch.from_arrays(
            [
                part.column("doc_id"),
                pa.array(np.diff(one[1])),
                pa.array(d1.view(np.int64)),
                pa.array(d2.view(np.int64)),
                pa.ListArray.from_arrays(pa.array(np.arange(0, bands.size + 1, bands.shape[1], dtype=np.int32)), pa.array(bands.reshape(-1))),
                pa.array([small[i : i + width] for i in range(0, len(small), width)], pa.binary()),
            ],
            ["doc_id", "n_shingles", "d1", "d2", "bands", "sketch"],
        )


def packed(batches: Batches) -> Batches:
    squeeze = zstandard.ZstdCompressor(level=1)
    for part in by_bytes(batches, "text", 2 << 20):
        texts = part.column("text").cast(pa.binary()).to_pylist()
        yield pa.RecordBatch.from_arrays([part.column("node"), pa.array([squeeze.compress(t) for t in texts], pa.binary())], ["node", "z"])


def confirm(batches: Batches) -> Batches:
    """Rows of a pivot and salt stand together, the pivot's texts first; gives the linked pairs."""
    expand = zstandard.ZstdDecompressor()
    key, pivots = None, []
    for batch in batches:
        for k in range(0, batch.num_rows, 256):
            part = batch.slice(k, 256)
            rows = part.to_pylist()
            texts = pa.array([expand.decompress(r["z"]) for r in rows], pa.binary())
            sets = shingle_sets(*byte_buffers(texts))
            found = []
            for i, r in enumerate(rows):
                own = tuple(hashes[at[i] : at[i + 1]] for hashes, at in sets)
                if (r["pivot"], r["salt"]) != key:
                    key, pivots = (r["pivot"], r["salt"]), []
                if r["kind"] == 0:
                    pivots.append(tuple(x.copy() for x in own))
                    continue
                if any(similar(p, own) for p in pivots):
                    found.append((r["node"], r["pivot"]))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], ["u", "v"])


def linked(pairs: DataFrame, texts: DataFrame, group: int = 256) -> DataFrame:
    """u, v: those of `pairs` (node, pivot) that are linked by their full sets.

    A pivot with many partners is copied to as many tasks as it has groups of partners.
    """
    n = partitions(pairs.sparkSession)
    pairs = written(pairs, "pairs")
    sizes = pairs.groupBy("pivot").agg(F.ceil(F.count("*") / group).cast("int").alias("salts"))
    salted = pairs.join(sizes, "pivot").select("node", "pivot", F.pmod(F.xxhash64("node"), F.col("salts")).cast("int").alias("salt"))
    others = salted.join(texts, "node").select("pivot", "salt", F.lit(1).alias("kind"), "node", "z")
    pivots = (
        salted.select("pivot", "salt")
        .distinct()
        .join(texts.select(F.col("node").alias("pivot"), "z"), "pivot")
        .select("pivot", "salt", F.lit(0).alias("kind"), F.col("pivot").alias("node"), "z")
    )
    rows = pivots.unionByName(others).repartition(n, "pivot", "salt").sortWithinPartitions("pivot", "salt", "kind")
    return rows.mapInArrow(confirm, "u long, v long")


class Sets:
    """Shingle sets of a block's texts, made when asked for; a bounded number of shingles is kept."""

    def __init__(self, texts: list[bytes], most: int = 1 << 23):
        self.texts, self.most, self.held, self.size = texts, most, {}, 0

    def __getitem__(self, i: int) -> tuple[np.ndarray, ...]:
        if i not in self.held:
            if self.size > self.most:
                self.held, self.size = {}, 0
            raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(self.texts[i]), np.uint8)
            self.held[i] = tuple(hashes for hashes, _ in shingle_sets(raw, np.array([0, len(raw)])))
            self.size += 2 * len(self.held[i][0])
        return self.held[i]


def close_block(held: list[dict]) -> pa.RecordBatch | None:
    """Links over components within a block: sketches first, full sets for those they do not rule out.

    A pair that meets in several buckets is compared in the first of them; two members outside of the
    bucket's largest component are compared once; two components that are linked need no second link.
    """
    side, main = (np.array([r[c] for r in held], bool) for c in ("outer", "main"))
    label, node = (np.array([r[c] for r in held], np.int64) for c in ("label", "node"))
    bands = np.array([r["bands"] for r in held], np.int64)
    sketch = np.frombuffer(b"".join(r["sketch"] for r in held), np.uint16).reshape(len(held), -1)
    sets = Sets([r["z"] for r in held])
    inner = np.flatnonzero(~side)
    found = []
    for o in np.flatnonzero(side).tolist():
        some = inner[(label[inner] != label[o]) & (main[inner] | (node[inner] < node[o]))]
        equal = (sketch[some] == sketch[o]).sum(axis=1)
        some = some[equal >= LEAST_EQUAL]
        if not len(some):
            continue
        first = (bands[some] == bands[o]).argmax(axis=1)
        some = some[bands[o][first] == held[o]["band"]]
        joined = set()
        for x in some.tolist():
            if label[x] in joined:
                continue
            if similar(sets[o], sets[x]):
                joined.add(label[x])
                found.append((int(node[o]), int(node[x])))
    if found:
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], ["u", "v"])
    return None


def close(batches: Batches) -> Batches:
    """Rows of a block stand together."""
    key, held = None, []
    for batch in batches:
        for k in range(0, batch.num_rows, 256):
            for r in batch.slice(k, 256).to_pylist():
                now = (r["band"], r["i"], r["o"])
                if now != key:
                    out = close_block(held) if held else None
                    if out is not None:
                        yield out
                    key, held = now, []
                held.append(r)
    out = close_block(held) if held else None
    if out is not None:
        yield out


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """The labels after `links` (u, v) between nodes: components of the graph of labels."""
    if not links.head(1):
        return labels
    own = labels.select(F.col("node").alias("u"), F.col("label").alias("lu"))
    other = labels.select(F.col("node").alias("v"), F.col("label").alias("lv"))
    edges = links.join(own, "u").join(other, "v").where("lu <> lv").select(F.col("lu").alias("u"), F.col("lv").alias("v")).distinct()
    found = components(edges).select(F.col("node").alias("label"), F.col("label").alias("smaller"))
    return written(labels.join(found, "label", "left").select("node", F.coalesce("smaller", "label").alias("label")), "labels")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of `docs`.

    The result is written to the shared folder; the tables on the way to it are deleted.
    """
    spark = docs.sparkSession
    ship_code(spark)
    give_back()
    path = shared_dir(spark, "near-dups")
    with scratch(spark, "near-dups"):
        out = found_groups(docs, id_col, text_col)
        out.write.parquet(path)
    return spark.read.schema(out.schema).parquet(path)


def found_groups(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    signed = written(rows.mapInArrow(sign, SIGNATURES), "signed")
    node = F.coalesce(F.min("doc_id"), F.min(F.col("d1").bitwiseAND(NO_ID - 1).bitwiseOR(NO_ID)))
    classes = signed.where("n_shingles > 0").groupBy("d1", "d2").agg(
        node.alias("node"), F.min("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")
    )
    classes = written(classes, "classes")
    entries = classes.select(F.explode("bands").alias("band"), "node", "n")
    buckets = entries.groupBy("band").agg(F.count("*").alias("m")).where("m > 1")
    shared = written(entries.join(buckets, "band"), "buckets")
    degrees = shared.groupBy("node").agg(F.sum("m").alias("degree"))
    shared = written(shared.drop("m").join(degrees, "node").select("band", "node", "n", "degree"), "buckets")
    hubs = shared.groupBy("band").agg(F.max(F.struct("degree", -F.col("node"), "n")).alias("hub"))
    hubs = hubs.select("band", (-F.col("hub.col2")).alias("pivot"), F.col("hub.n").alias("pn"), F.col("hub.degree").alias("pd"))
    met = (
        shared.join(hubs, "band")
        .where("node <> pivot and 4 * least(n, pn) >= 3 * greatest(n, pn)")
        .groupBy("node", "pivot", "pd")
        .agg(F.count("*").alias("times"))
        .groupBy("node")
        .agg(F.max_by("pivot", F.struct("times", "pd", -F.col("pivot"))).alias("pivot"))
    )
    nodes = shared.select("node").distinct()
    # a node stands for a class: the text of the row with its id, or of any row of a class without ids
    keys = classes.join(nodes, "node", "left_semi").select("node", F.when(F.col("node") < NO_ID, F.col("node")).alias("text_id"))
    with_id = rows.where("doc_id is not null").withColumnRenamed("doc_id", "node")
    texts = with_id.mapInArrow(packed, "node long, z binary").join(keys.where("text_id is not null").select("node").hint("shuffle_hash"), "node", "left_semi")
    orphans = rows.where("doc_id is null").mapInArrow(sign_and_pack, "d1 long, d2 long, z binary")
    orphans = orphans.join(classes.where(F.col("node") >= NO_ID).select("d1", "d2", "node"), ["d1", "d2"]).select("node", "z").dropDuplicates(["node"])
    texts = written(texts.unionByName(orphans), "texts")

    labels = nodes.select("node", F.col("node").alias("label"))
    labels = merged(written(labels, "labels"), written(linked(met, texts), "links"))
    for turn in range(BRIDGE_ROUNDS):
        split = open_buckets(shared, labels)
        order = F.struct(-F.col("degree") if turn == 0 else F.lit(0), F.xxhash64("node", "band", F.lit(turn)))
        reps = split.groupBy("band", "label").agg(F.count("*").alias("m"), F.min_by(F.struct("node", "n"), order).alias("rep"))
        mains = reps.groupBy("band").agg(F.max_by(F.struct("label", "rep"), F.struct("m", "label")).alias("main"))
        pairs = reps.join(mains, "band").where("label <> main.label").select(
            F.col("rep.node").alias("node"), F.col("main.rep.node").alias("pivot"), F.col("rep.n").alias("n"), F.col("main.rep.n").alias("pn")
        )
        pairs = pairs.where("4 * least(n, pn) >= 3 * greatest(n, pn)").select("node", "pivot").distinct()
        labels = merged(labels, written(linked(pairs, texts), "links"))
    labels = merged(labels, written(closing_links(shared, labels, classes, texts), "links"))

    found = classes.select("d1", "d2", "node").join(labels, "node", "left").select("d1", "d2", F.coalesce("label", "node").alias("label"))
    full = signed.select("doc_id", "n_shingles", "d1", "d2")
    some = full.where("n_shingles > 0").join(found, ["d1", "d2"]).select("doc_id", "n_shingles", F.when(F.col("label") < NO_ID, F.col("label")).alias("component_id"))
    none = full.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return some.unionByName(none).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def sign_and_pack(batches: Batches) -> Batches:
    squeeze = zstandard.ZstdCompressor(level=1)
    for part in by_bytes(batches, "text", 2 << 20):
        d1, d2 = set_digests(*shingle_sets(*byte_buffers(part.column("text"))))
        z = [squeeze.compress(t) for t in part.column("text").cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)), pa.array(z, pa.binary())], ["d1", "d2", "z"])


def open_buckets(shared: DataFrame, labels: DataFrame) -> DataFrame:
    """band, node, n, degree, label of the buckets that hold several components."""
    marked = written(shared.join(labels, "node"), "marked")
    several = marked.groupBy("band").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a <> b").select("band")
    return marked.join(several, "band", "left_semi")


def closing_links(shared: DataFrame, labels: DataFrame, classes: DataFrame, texts: DataFrame) -> DataFrame:
    """u, v: links over components within the buckets that still hold several, found in blocks."""
    split = written(open_buckets(shared, labels), "open")
    counts = split.groupBy("band", "label").agg(F.count("*").alias("m"))
    mains = counts.groupBy("band").agg(F.max_by("label", F.struct("m", "label")).alias("most"), F.sum("m").alias("all"), F.max("m").alias("m"))
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    mains = mains.select("band", "most", blocks(F.col("all")).alias("inner_blocks"), blocks(F.col("all") - F.col("m")).alias("outer_blocks"))
    nodes = classes.select("node", "bands", "sketch").join(split.select("node").distinct(), "node").join(texts, "node")
    place = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    rows = split.join(mains, "band").withColumn("main", F.col("label") == F.col("most"))
    inner = rows.withColumn("i", place("inner_blocks")).withColumn("o", every("outer_blocks")).withColumn("outer", F.lit(False))
    outer = rows.where("not main").withColumn("o", place("outer_blocks")).withColumn("i", every("inner_blocks")).withColumn("outer", F.lit(True))
    columns = ["band", "i", "o", "outer", "main", "node", "label"]
    both = inner.select(columns).unionByName(outer.select(columns)).join(nodes, "node")
    n = partitions(shared.sparkSession)
    return both.repartition(n, "band", "i", "o").sortWithinPartitions("band", "i", "o").mapInArrow(close, "u long, v long").distinct()


def op6_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
