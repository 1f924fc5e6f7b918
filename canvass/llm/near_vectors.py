"""Near-duplicate vectors by small-world graphs per shard (operator 9).

Equal vectors become one class first.  Each shard of at most about ``SHARD`` classes gets a
graph (``hnsw``), written to the shared folder.  Every class queries every shard, in lots.  The
beam is doubled for all queries of a lot until an audit of some of them against the whole shard
passes, and for single queries whose beam is full of matches; beyond ``WIDEST`` the beam is the
whole shard.  Matches are verified in double precision.  A lot reports the number of links of
its queries and, of the links, a spanning forest, so a group of near copies costs as many rows
as it has members.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canvass.llm.components import components
from canvass.llm.hnsw import LOT, Hnsw
from canvass.llm.shared import prepare, stored
from canvass.session import work_dir

COSINE = 0.9
SHARD, QUERIES, BEAM, WIDEST = 1 << 16, 1 << 13, 32, 256
AUDITED, RECALL = 16, 1.0
MARGIN = 1e-5  # of single precision, in the search
GRAPH = pa.schema([("shard", pa.int32()), ("cls", pa.binary()), ("copies", pa.binary()), ("vectors", pa.binary()),
                   ("nodes", pa.list_(pa.binary())), ("links", pa.list_(pa.binary()))])
GRAPH_SQL = "shard int, cls binary, copies binary, vectors binary, nodes array<binary>, links array<binary>"
LINK = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("links", pa.int64())])


def units(vectors: pa.Array, size: int) -> np.ndarray:
    """Unit vectors in double precision; shorter ones end with zeros."""
    lengths = vectors.value_lengths().to_numpy()
    flat = vectors.flatten().to_numpy()
    out = np.zeros((len(lengths), size))
    out[np.repeat(np.arange(len(lengths)), lengths), np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    out /= np.abs(out).max(axis=1, keepdims=True, initial=1e-300)
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def graph_of(size: int):
    def build(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("cls")
        cls = table.column("cls").to_numpy()
        vectors = units(table.column("vector").combine_chunks(), size)
        graph = Hnsw.build(vectors, cls)
        row = (table.column("shard")[0].as_py(), cls.tobytes(), table.column("copies").to_numpy().tobytes(), vectors.tobytes(),
               [n.astype(np.int32).tobytes() for n, _ in graph.layers], [k.tobytes() for _, k in graph.layers])
        return pa.Table.from_arrays([pa.array([v], t.type) for v, t in zip(row, GRAPH, strict=True)], schema=GRAPH)

    return build


class Shard:
    def __init__(self, folder: str, number: int, size: int) -> None:
        system, path = fs.FileSystem.from_uri(f"{folder}/shard={number}")
        self.empty = system.get_file_info(path).type == fs.FileType.NotFound
        if self.empty:
            return
        row = pq.read_table(path, filesystem=system, partitioning=None).to_pylist()[0]
        self.cls, self.copies = np.frombuffer(row["cls"], np.int64), np.frombuffer(row["copies"], np.int64)
        self.vectors = np.frombuffer(row["vectors"]).reshape(-1, size)
        layers = [(np.frombuffer(n, np.int32).astype(np.int64), np.frombuffer(k, np.int32)) for n, k in zip(row["nodes"], row["links"], strict=True)]
        self.graph = Hnsw(self.vectors.astype(np.float32), [(n, k.reshape(len(n), -1)) for n, k in layers])

    def matches(self, queries: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, node) of at least that cosine."""
        single = queries.astype(np.float32)
        audited = np.linspace(0, len(queries) - 1, min(AUDITED, len(queries))).astype(int)
        truth = queries[audited] @ self.vectors.T >= least
        beam, left, pairs = BEAM, np.arange(len(queries)), []
        while len(left) and beam <= min(WIDEST, len(self.cls) // 2):
            found, near = self.graph.search(single[left], beam)
            good = (found >= 0) & (near >= least - MARGIN)
            if len(left) == len(queries):
                hit = sum(np.isin(np.flatnonzero(t), found[q][good[q]]).sum() for q, t in zip(audited, truth, strict=True))
                if hit < RECALL * truth.sum():
                    beam *= 2
                    continue
            full = good.all(axis=1)  # more matches may lie beyond the beam
            q, k = np.nonzero(good & ~full[:, None])
            pairs.append((left[q], found[q, k]))
            left, beam = left[full], beam * 2
        for part in np.array_split(left, max(1, -(-len(left) // LOT))):
            q, node = np.nonzero(single[part] @ self.graph.vectors.T >= least - MARGIN)
            pairs.append((part[q], node))
        q, node = (np.concatenate(x) for x in zip(*pairs, strict=True))
        exact = np.concatenate([np.einsum("pd,pd->p", queries[q[i:i + 65536]], self.vectors[node[i:i + 65536]])
                                for i in range(0, len(q), 65536)] or [np.zeros(0)])
        return q[exact >= least], node[exact >= least]


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges and the smallest node each is connected with."""
    nodes, where = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = where[:len(a)], where[len(a):]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return nodes, nodes[root]
        root = new


def linked_lots(folder: str, shards: int, size: int, least: float):
    def lot(cls: np.ndarray, queries: np.ndarray):
        for number in range(shards):
            shard = Shard(folder, number, size)
            if shard.empty:
                continue
            pairs = [shard.matches(queries[i:i + LOT], least) for i in range(0, len(cls), LOT)]
            q = np.concatenate([p[0] + i * LOT for i, p in enumerate(pairs)])
            node = np.concatenate([p[1] for p in pairs])
            other = cls[q] != shard.cls[node]
            q, node = q[other], node[other]
            links = np.bincount(q, shard.copies[node], len(cls)).astype(np.int64)
            nodes, root = forest(cls[q], shard.cls[node])
            linked = np.flatnonzero(links)
            a = np.concatenate([cls[linked], nodes])
            b = np.concatenate([cls[linked], root])
            count = np.concatenate([links[linked], np.zeros(len(nodes), np.int64)])
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (a, b, count)], schema=LINK)

    def run(batches):
        held, many = [], 0
        for batch in batches:
            held.append((batch.column("cls").to_numpy(), units(batch.column("vector"), size)))
            many += batch.num_rows
            if many >= QUERIES:
                yield from lot(*(np.concatenate(x) for x in zip(*held, strict=True)))
                held, many = [], 0
        if many:
            yield from lot(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return run


def near_vectors(embeddings: DataFrame, least: float = COSINE, shard: int = SHARD) -> DataFrame:
    """vec_id, n_links, component_id and kept of each row of ``embeddings``.

    Rows link if their cosine is at least ``least``.  A vector that is NULL, empty or zero, or
    has a NULL, NaN or infinite component, links with nothing and is a component of its own.
    Vectors of fewer dimensions are compared as if they ended with zeros.  Rows that repeat a
    vector, with the same id or another, link with each other.  A NULL vec_id is larger than
    all others.  Other columns, whatever their names, are not used.
    """
    spark = embeddings.sparkSession
    prepare(spark)
    vector = F.transform("embedding", lambda x: x.cast("double"))
    rows = embeddings.select(F.col("vec_id").cast("long"), vector.alias("vector"))
    sound = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    rows = rows.withColumn("sound", F.coalesce(sound, F.lit(False)))
    key = [F.when(F.col("sound"), F.xxhash64(F.lit(i), F.transform("vector", lambda x: x + F.lit(0.0)))).alias(f"k{i}") for i in range(2)]
    rows = rows.select("vec_id", "vector", *key)
    classes = rows.filter("k0 IS NOT NULL").groupBy("k0", "k1").agg(
        F.min("vec_id").alias("least_id"), F.count("*").alias("copies"), F.any_value("vector").alias("vector"))
    classes = stored(classes.withColumn("cls", F.monotonically_increasing_id()), "classes")
    many, size = classes.agg(F.count("*"), F.max(F.size("vector"))).first()
    shards = max(1, -(-many // shard))
    graphs = work_dir(spark, "graphs")
    placed = classes.select("cls", "copies", "vector", F.pmod("k0", F.lit(shards)).cast("int").alias("shard"))
    placed.groupBy("shard").applyInArrow(graph_of(size or 0), GRAPH_SQL).write.partitionBy("shard").parquet(graphs)
    queries = classes.select("cls", "vector").repartition(-(-many // QUERIES) or 1)
    found = stored(queries.mapInArrow(linked_lots(graphs, shards, size or 0, least), "a long, b long, links long"), "links")
    links = found.groupBy(F.col("a").alias("cls")).agg(F.sum("links").alias("links"))
    roots = components(found.select("a", "b"))
    known = classes.join(links, "cls", "left").join(roots, F.col("cls") == F.col("node"), "left").select(
        "k0", "k1", "least_id", "copies", "links", F.coalesce("root", "cls").alias("root"))
    lowest = known.groupBy("root").agg(F.min("least_id").alias("component_id"))
    known = known.join(lowest, "root").drop("root", "least_id").alias("c")
    joined = rows.select("vec_id", "k0", "k1").alias("r").join(known, F.expr("r.k0 = c.k0 AND r.k1 = c.k1"), "left")
    component = F.coalesce("c.component_id", "r.vec_id")
    return joined.select(
        "r.vec_id", F.coalesce(F.col("c.copies") - 1 + F.coalesce("c.links", F.lit(0)), F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"), component.eqNullSafe(F.col("r.vec_id")).alias("kept"))
