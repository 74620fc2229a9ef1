"""Best-first search of many queries over a graph that is read in place.

Nodes stand in files of fixed records, ordered by position, their edges in files beside; a search maps the files and
touches the records of the nodes it meets, so a task holds a few queries' nodes and no part of the graph. Where the
shared folder is not a mounted one, a worker copies the files to its own temporary folder once.

A query is a row: qv_, pool_ (its nodes: POOL records by distance and position) and met_ (positions, ascending). Between
`expand` and `pack`, which share a stage, every new node is a row after its query's, on which Spark tests the filter.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from functools import lru_cache
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyarrow import fs

from ..plans.tiles import vectors_of

Batches = Iterator[pa.RecordBatch]
POOL = np.dtype([("pos", "<i8"), ("node", "<i8"), ("dist", "<f8"), ("passes", "?"), ("expanded", "?")])
#: Queries that are advanced together, and pairs measured at a time.
TOGETHER, PAIRS = 16, 2048


def record(dim: int, kind: str) -> np.dtype:
    """at: where a node's edges begin; near: how many stay within its group, all: how many it has."""
    return np.dtype([("at", "<i8"), ("vec_id", "<i8"), ("near", "<i4"), ("all", "<i4"), ("vec", kind, (dim,))])


def store(batches: Batches, folder: str, axes: list[str]) -> Batches:
    """One part of the files, from rows (pos_, vec_id, embedding, near_, axes) by position; its first position and stem."""
    place, path = fs.FileSystem.from_uri(folder)
    place.create_dir(path, recursive=True)
    stem, first, at, kept = uuid.uuid4().hex, None, 0, []
    with place.open_output_stream(f"{path}/{stem}.nodes") as nodes, place.open_output_stream(f"{path}/{stem}.edges") as edges:
        for batch in batches:
            if not len(batch):
                continue
            if first is None:
                first = batch.column("pos_")[0].as_py()
            vectors = batch.column("embedding")
            double = pa.types.is_float64(vectors.type.value_type)
            x = vectors_of(vectors)
            out = np.zeros(len(batch), record(x.shape[1], "<f8" if double else "<f4"))
            lists = batch.column("near_")
            out["all"] = np.asarray(lists.value_lengths().fill_null(0))
            flat = lists.flatten()
            ends = np.cumsum(out["all"].astype(np.int64))
            inside = np.r_[0, np.cumsum(~np.asarray(flat.field("far").to_numpy(zero_copy_only=False), bool))]
            out["near"] = inside[ends] - inside[ends - out["all"]]
            out["at"] = at + ends - out["all"]
            out["vec_id"], out["vec"] = batch.column("vec_id").to_numpy(), x
            at += len(flat)
            nodes.write(out.tobytes())
            edges.write(np.asarray(flat.field("pos").to_numpy(zero_copy_only=False), np.int64).tobytes())
            kept.append(batch.select(axes))
    if first is None:
        return
    whole = pa.Table.from_batches(kept).combine_chunks()
    about = {"record": f"{x.shape[1]} {'<f8' if double else '<f4'}"}
    with place.open_output_stream(f"{path}/{stem}.axes") as f, pa.ipc.new_file(f, whole.schema.with_metadata(about)) as out:
        out.write_table(whole.replace_schema_metadata(about))
    yield pa.RecordBatch.from_arrays([pa.array([first], pa.int64()), pa.array([stem])], ["first", "stem"])


def begin(batches: Batches) -> Batches:
    """Queries (qv, starts_, ...) as rows to advance: lists become bytes, which cost Spark less beside every node."""
    for batch in batches:
        x = vectors_of(batch.column("qv"))
        starts = [np.unique(np.array(s, np.int64)).tobytes() for s in batch.column("starts_").to_pylist()]
        rest = batch.drop_columns(["qv", "starts_"])
        new = [pa.array(v, pa.binary()) for v in ([q.tobytes() for q in x], starts, [b""] * len(batch), [b""] * len(batch))]
        columns = [*rest.columns, *new, pa.array(np.ones(len(batch), np.int32))]
        yield pa.RecordBatch.from_arrays(columns, [*rest.schema.names, "qv_", "starts_", "pool_", "met_", "going_"])


@lru_cache(maxsize=1)
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="tessera-walk-")


def _local(uri: str) -> str:
    parsed = urlparse(uri)
    if parsed.scheme in ("", "file"):
        return unquote(parsed.path)
    target = f"{_own_folder()}/{uri.rsplit('/', 1)[1]}"
    if not os.path.exists(target):
        fs.copy_files(uri, target)
    return target


@lru_cache(maxsize=1)
def opened(files: tuple[tuple[int, str], ...]):
    """First positions, and nodes, edges and attributes of each part, mapped."""
    parts = []
    for _, stem in files:
        axes = pa.ipc.open_file(pa.memory_map(_local(f"{stem}.axes"))).read_all()
        dim, kind = axes.schema.metadata[b"record"].decode().split()
        nodes = np.memmap(_local(f"{stem}.nodes"), record(int(dim), kind), "r")
        edges = _local(f"{stem}.edges")
        parts.append((nodes, np.memmap(edges, "<i8", "r") if os.path.getsize(edges) else np.zeros(0, np.int64), axes))
    return np.array([first for first, _ in files], np.int64), parts


def neighbours(graph, at: np.ndarray, across: bool) -> np.ndarray:
    """The nodes, each once, to which edges lead from those at the positions `at`."""
    firsts, parts = graph
    out = [np.zeros(0, np.int64)]
    for pos, p in zip(at.tolist(), (np.searchsorted(firsts, at, "right") - 1).tolist()):
        nodes, edges, _ = parts[p]
        node = nodes[pos - int(firsts[p])]
        begin = int(node["at"])
        out.append(edges[begin : begin + int(node["all" if across else "near"])])
    return np.unique(np.concatenate(out))


def measured(graph, pos: np.ndarray, asked: np.ndarray, qv: np.ndarray):
    """Ids, distances (summed up as l2sq does it) and attributes of the nodes at `pos`, for the queries qv[asked]."""
    firsts, parts = graph
    order = np.argsort(pos, kind="stable")
    pos, asked = pos[order], asked[order]
    ids, dist, axes = np.zeros(len(pos), np.int64), np.zeros(len(pos)), []
    ends = np.r_[np.searchsorted(pos, firsts), len(pos)]
    columns = np.ascontiguousarray(qv.T)
    for (nodes, _, attributes), first, a, b in zip(parts, firsts, ends, ends[1:]):
        if a < b:
            axes.append(attributes.take(pa.array(pos[a:b] - first)))
            for s in range(a, b, PAIRS):
                some = slice(s, min(b, s + PAIRS))
                found = nodes[pos[some] - first]
                gap = np.ascontiguousarray(found["vec"].T).astype(np.float64) - columns[:, asked[some]]
                ids[some], dist[some] = found["vec_id"], np.add.reduce(gap * gap, axis=0)
    back = np.empty(len(pos), np.int64)
    back[order] = np.arange(len(pos))
    return ids[back], dist[back], pa.concat_tables(axes or [parts[0][2].slice(0, 0)]).take(pa.array(back))


def expand(batches: Batches, files, axes: list[str], ef: int, across: bool, width: int) -> Batches:
    """Every query's row, and after it one for each node that its nearest unexpanded nodes lead to."""
    graph = opened(files) if files else None
    for batch in batches:
        for at in range(0, len(batch), TOGETHER):
            yield from advanced(batch.slice(at, TOGETHER), graph, axes, ef, across, width)


def advanced(rows: pa.RecordBatch, graph, axes: list[str], ef: int, across: bool, width: int) -> Batches:
    states, met, going, fresh = [], [], [], []
    for pool, seen, first in zip(*(rows.column(c).to_pylist() for c in ("pool_", "met_", "starts_"))):
        pool, seen = np.frombuffer(pool, POOL).copy(), np.frombuffer(seen, "<i8")
        if first:
            found, hops = np.frombuffer(first, np.int64), 1
        else:
            before = np.cumsum(pool["passes"]) - pool["passes"]
            go = ~pool["expanded"] & (before < ef) & (np.cumsum(~pool["expanded"]) <= width)
            hops = int(go.sum())
            found = neighbours(graph, pool["pos"][go], across) if hops else np.zeros(0, np.int64)
            pool["expanded"] |= go
        if len(seen) and len(found):
            at = np.searchsorted(seen, found)
            found = found[seen[np.minimum(at, len(seen) - 1)] != found]
        states.append(pool.tobytes())
        met.append(np.sort(np.concatenate([seen, found]), kind="stable").tobytes() if len(found) else seen.tobytes())
        going.append(hops)
        fresh.append(found)
    counts = [len(x) for x in fresh]
    pos, asked = np.concatenate(fresh), np.repeat(np.arange(len(rows)), counts)
    n = len(rows) + len(pos)
    # a query's row stands before its nodes
    own = np.cumsum([0, *counts[:-1]]) + np.arange(len(rows))
    new = np.ones(n, bool)
    new[own] = False
    query, gone = np.zeros(n, np.int64), np.where(new, -1, 0)
    query[own], query[new] = np.arange(len(rows)), asked
    gone[own] = np.arange(len(rows))
    ids, dist, attributes = measured(graph, pos, asked, np.stack([np.frombuffer(q, np.float64) for q in rows.column("qv_").to_pylist()])) if len(pos) else (pos, np.zeros(0), None)
    node = np.zeros(n, np.int64)
    node[new] = np.arange(len(pos))
    mask = lambda values, kind: pa.array(values, kind).take(pa.array(node, mask=~new)) if len(pos) else pa.nulls(n, kind)
    only = pa.array(gone, mask=new)
    held = {"pool_": pa.array(states, pa.binary()), "met_": pa.array(met, pa.binary()), "going_": pa.array(going, pa.int32()), "starts_": pa.array([b""] * len(rows), pa.binary())}
    names, columns = [], []
    for name in rows.schema.names:
        names.append(name)
        columns.append(held[name].take(only) if name in held else rows.column(name).take(only if name == "qv_" else pa.array(query)))
    for name, values, kind in (("pos_", pos, pa.int64()), ("node", ids, pa.int64()), ("dist", dist, pa.float64())):
        names.append(name)
        columns.append(mask(values, kind))
    for name in axes:
        names.append(name)
        if attributes is None:
            columns.append(graph[1][0][2].column(name).slice(0, 0).combine_chunks().take(pa.nulls(n, pa.int64())) if graph else pa.nulls(n))
        else:
            columns.append(attributes.column(name).combine_chunks().take(pa.array(node, mask=~new)))
    columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns]
    yield pa.RecordBatch.from_arrays(columns, names)


def pack(batches: Batches, ef: int | None) -> Batches:
    """The queries' rows with the nodes that follow them taken in. ef: nodes behind so many that pass are dropped."""
    row, new = None, []

    def closed():
        pool = np.concatenate([np.frombuffer(row.column("pool_")[0].as_py(), POOL), *new])
        if new:
            pool = pool[np.lexsort((pool["pos"], pool["dist"]))]
            if ef is not None:
                pool = pool[np.cumsum(pool["passes"]) - pool["passes"] < ef]
        return row.set_column(row.schema.get_field_index("pool_"), "pool_", pa.array([pool.tobytes()], pa.binary()))

    for batch in batches:
        pos = batch.column("pos_")
        heads = np.flatnonzero(pos.is_null().to_numpy(zero_copy_only=False))
        nodes = np.zeros(len(batch), POOL)
        for name, column in (("pos", "pos_"), ("node", "node"), ("dist", "dist"), ("passes", "passes_")):
            values = batch.column(column)
            nodes[name] = values.fill_null(False if column == "passes_" else 0).to_numpy(zero_copy_only=False)
        kept = batch.drop_columns(["pos_", "node", "dist", "passes_"])
        if len(nodes[: heads[0] if len(heads) else len(batch)]):
            new.append(nodes[: heads[0] if len(heads) else len(batch)])
        for at, end in zip(heads, [*heads[1:], len(batch)]):
            if row is not None:
                yield closed()
            row, new = kept.slice(at, 1), [nodes[at + 1 : end]] if end > at + 1 else []
    if row is not None:
        yield closed()


def listed(batches: Batches) -> Batches:
    """qid, node, dist, passes, expanded: the nodes of each query's row."""
    for batch in batches:
        for at in range(0, len(batch), TOGETHER):
            some = batch.slice(at, TOGETHER)
            pools = [np.frombuffer(x, POOL) for x in some.column("pool_").to_pylist()]
            nodes = np.concatenate(pools)
            whose = some.column("qid").take(pa.array(np.repeat(np.arange(len(some)), [len(p) for p in pools])))
            yield pa.RecordBatch.from_arrays([whose, *(pa.array(np.ascontiguousarray(nodes[c])) for c in ("node", "dist", "passes", "expanded"))], ["qid", "node", "dist", "passes", "expanded"])
