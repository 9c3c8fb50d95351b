"""All pairs of near-equal embeddings through inverted lists with product-quantised residuals.

Coarse k-means lists and subspace codebooks are fitted on a bounded sample; every
vector is indexed. With unit vectors a cosine threshold is a distance ``d``. A
partner of x that lies in list B is on B's side of the plane between B's centroid and
x's own, so x probes B unless that plane is farther away than ``d``: sufficient
probes, without loss. Asymmetric table distances are lower bounds once the stored
quantisation error of the member is subtracted, so the candidates keep every pair;
candidates are reranked by exact cosine in double precision.

Equal vectors are one class. A list is cut into blocks of bounded size, files in the shared
folder. A task holds one block and reads the blocks that its vectors probe one after the
other, so a vector is stored once, however many lists it probes. Two blocks return link
counts and a spanning forest, never pairs.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from particlelake.llm.common import Batches, filesystem, new_folder, stored, write_once
from particlelake.llm.components import linked_components

#: Vectors the centroids and codebooks are fitted on, about.
SAMPLE_ROWS = 32_768
LIST_ROWS = 4096
BLOCK_ROWS = 2048
QUERIES_AT_ONCE = 256
#: Tasks over all blocks, at most.
MOST_TASKS = 2_048
SUBSPACE = 8
CODES = 256
#: Classes whose ids are all null are numbered from here; real ids are smaller.
NAMELESS = 1 << 61


def as_matrix(values: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column as unit vectors in double precision; short rows end in zeros."""
    out = np.zeros((len(values), width))
    lengths = np.diff(values.offsets.to_numpy())
    flat = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(lengths) and (lengths == width).all():
        out[:] = flat.reshape(-1, width)
    else:
        at = np.concatenate(([0], np.cumsum(lengths)))
        for i, n in enumerate(lengths):
            out[i, :n] = flat[at[i]: at[i + 1]]
    return unit_rows(out)


def unit_rows(rows: np.ndarray) -> np.ndarray:
    """Scaled by the largest component first, so squares neither overflow nor vanish."""
    rows = rows / np.abs(rows).max(axis=1, initial=0.0)[:, None]
    return rows / np.sqrt((rows * rows).sum(axis=1))[:, None]


def squared_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T, 0)


def lloyd(rows: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """k-means centres from evenly spaced starts; empty centres stay where they are."""
    centres = rows[np.linspace(0, len(rows) - 1, min(k, len(rows))).astype(int)].copy()
    for _ in range(rounds):
        nearest = np.concatenate([squared_distances(rows[i: i + 4096], centres).argmin(1) for i in range(0, len(rows), 4096)])
        counts = np.bincount(nearest, minlength=len(centres))
        for j in range(rows.shape[1]):
            sums = np.bincount(nearest, weights=rows[:, j], minlength=len(centres))
            centres[:, j] = np.where(counts > 0, sums / np.maximum(counts, 1), centres[:, j])
    return centres


class ProductQuantiser:
    """Coarse centroids and one codebook per subspace of the residuals."""

    def __init__(self, sample: np.ndarray, lists: int):
        self.centres = lloyd(sample, lists)
        nearest = squared_distances(sample, self.centres).argmin(1)
        residuals = sample - self.centres[nearest]
        self.cuts = [(i, min(i + SUBSPACE, sample.shape[1])) for i in range(0, sample.shape[1], SUBSPACE)]
        self.books = [lloyd(residuals[:, a:b], CODES) for a, b in self.cuts]

    def planes(self, rows: np.ndarray, lists: np.ndarray) -> np.ndarray:
        """Distance of rows of some lists to the plane that divides theirs from every list."""
        far = squared_distances(rows, self.centres)
        own = far[np.arange(len(rows)), lists]
        apart = np.sqrt(squared_distances(self.centres, self.centres))[lists]
        return np.where(apart > 0, (far - own[:, None]) / np.where(apart > 0, 2 * apart, 1), 0)

    def encode(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """List, codes and quantisation error."""
        lists = squared_distances(rows, self.centres).argmin(1)
        residuals = rows - self.centres[lists]
        codes = np.empty((len(rows), len(self.cuts)), np.uint8)
        error = np.zeros(len(rows))
        for m, ((a, b), book) in enumerate(zip(self.cuts, self.books)):
            codes[:, m] = squared_distances(residuals[:, a:b], book).argmin(1)
            error += ((residuals[:, a:b] - book[codes[:, m]]) ** 2).sum(1)
        return lists, codes, np.sqrt(error)

    def table_distances(self, queries: np.ndarray, which: int, codes: np.ndarray) -> np.ndarray:
        """Distances of queries to decoded members of one list, summed from lookup tables."""
        residuals = queries - self.centres[which]
        total = np.zeros((len(queries), len(codes)), np.float32)
        for m, ((a, b), book) in enumerate(zip(self.cuts, self.books)):
            table = squared_distances(residuals[:, a:b], book).astype(np.float32)
            total += table.take(codes[:, m], axis=1)
        return np.sqrt(total)


def spanning_roots(count: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest member of each node's component among links between node numbers."""
    root = np.arange(count)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def valid_vector(column: str):
    """Not null, every component present and finite, and one of them not zero."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(F.forall(column, finite) & F.exists(column, lambda x: x != 0), F.lit(False))


@dataclass
class Block:
    """Some vectors of one list."""

    rep: np.ndarray
    weight: np.ndarray
    error: np.ndarray
    codes: np.ndarray
    unit: np.ndarray

    def write(self, folder: str) -> str:
        blobs = [pa.array([np.ascontiguousarray(v).tobytes()], pa.binary()) for v in (self.rep, self.weight, self.error, self.codes, self.unit)]
        batch = pa.RecordBatch.from_arrays(blobs, names=["rep", "weight", "error", "codes", "unit"])

        def fill(sink: pa.NativeFile) -> None:
            with pa.ipc.new_stream(sink, batch.schema) as out:
                out.write_batch(batch)

        return write_once(folder, "block", fill)

    @staticmethod
    def read(path: str) -> Block:
        fs, place = filesystem(path)
        with fs.open_input_file(place) as source:
            batch = pa.ipc.open_stream(source).read_next_batch()
        kinds = (np.int64, np.int64, np.float64, np.uint8, np.float64)
        rep, weight, error, codes, unit = (np.frombuffer(batch.column(i)[0].as_buffer(), kind) for i, kind in enumerate(kinds))
        return Block(rep, weight, error, codes.reshape(len(rep), -1), unit.reshape(len(rep), -1))


def block_links(quantiser: ProductQuantiser, ask: Block, member: Block, which: int, same: bool, threshold: float, reach: float) -> pa.Table:
    """Links of some vectors to the members of a block of list ``which``; within a list the larger id asks."""
    bound = (reach + member.error).astype(np.float32) + np.float32(1e-5)
    found_a, found_b = [np.zeros(0, int)], [np.zeros(0, int)]
    for at in range(0, len(ask.rep), QUERIES_AT_ONCE):
        some = slice(at, at + QUERIES_AT_ONCE)
        candidate = quantiser.table_distances(ask.unit[some], which, member.codes) <= bound[None, :]
        if same:
            candidate &= ask.rep[some][:, None] > member.rep[None, :]
        i, j = np.nonzero(candidate)
        for part in range(0, len(i), 100_000):
            a, b = at + i[part: part + 100_000], j[part: part + 100_000]
            close = np.einsum("ij,ij->i", ask.unit[a], member.unit[b]) >= threshold
            found_a.append(a[close])
            found_b.append(b[close])
    # vectors of one block may stand on both sides; a number is where an id comes first
    ids, number = np.unique(np.concatenate([ask.rep, member.rep]), return_inverse=True)
    a, b = number[np.concatenate(found_a)], number[len(ask.rep) + np.concatenate(found_b)]
    weights = np.zeros(len(ids), np.int64)
    weights[number] = np.concatenate([ask.weight, member.weight])
    links = np.zeros(len(ids), np.int64)
    np.add.at(links, a, weights[b])
    np.add.at(links, b, weights[a])
    root = ids[spanning_roots(len(ids), a, b)]
    met = links > 0
    return pa.table({"id": ids[met], "links": links[met], "root": root[met]})


def linked_blocks(
    classes: DataFrame, threshold: float, sample_rows: int, list_rows: int, block_rows: int
) -> DataFrame:
    """(id, links, root): per block and linked class, the vectors linked to it and its part's smallest id.

    ``classes`` has ``rep``, ``weight`` and ``vector``.
    """
    spark = classes.sparkSession
    rows, width = classes.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
    if not rows:
        return spark.createDataFrame([], "id long, links long, root long")
    near = F.pmod(F.xxhash64("rep"), F.lit(rows)) < sample_rows
    picked = classes.where(near).select("rep", "vector").limit(2 * sample_rows).toArrow().sort_by("rep")
    if not picked.num_rows:
        picked = classes.select("rep", "vector").limit(1).toArrow()
    sample = as_matrix(picked.column("vector").combine_chunks(), width)
    lists = max(1, min(-(-rows // list_rows), len(sample) // 32))
    fitted = spark.sparkContext.broadcast(ProductQuantiser(sample, lists))
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + 1e-7

    folder = new_folder(spark, "lists")

    def index(batches: Batches) -> Batches:
        quantiser = fitted.value
        for batch in batches:
            if not batch.num_rows:
                continue
            units = as_matrix(batch.column(2), width)
            own, codes, error = quantiser.encode(units)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), pa.array(own, pa.int64()), pa.array(error),
                    pa.array([c.tobytes() for c in codes], pa.binary()), pa.array([u.tobytes() for u in units], pa.binary()),
                ],
                names=["rep", "weight", "list", "error", "codes", "unit"],
            )

    def written(batches: Batches) -> Batches:
        held: list[pa.RecordBatch] = []

        def flush() -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            held.clear()
            rep, weight, error = (table.column(c).to_numpy() for c in ("rep", "weight", "error"))
            blob = lambda c, kind: np.frombuffer(b"".join(table.column(c).to_pylist()), kind).reshape(len(rep), -1)
            path = Block(rep, weight, error, blob("codes", np.uint8), blob("unit", np.float64)).write(folder)
            fields = [table.column("list").chunk(0).slice(0, 1), pa.array([rep[0]], pa.int64()), pa.array([path])]
            return pa.RecordBatch.from_arrays(fields, names=["list", "first", "path"])

        for batch in batches:
            at, lists = 0, batch.column("list").to_numpy()
            while at < batch.num_rows:
                if held and (sum(b.num_rows for b in held) >= block_rows or held[0].column("list")[0].as_py() != lists[at]):
                    yield flush()
                run = int(np.searchsorted(lists[at:], lists[at], side="right"))
                take = min(run, block_rows - sum(b.num_rows for b in held))
                held.append(batch.slice(at, take))
                at += take
        if held:
            yield flush()

    shape = "rep long, weight long, list long, error double, codes binary, unit binary"
    tasks = max(1, -(-rows // (4 * block_rows)))
    ordered = classes.select("rep", "weight", "vector").mapInArrow(index, shape).repartitionByRange(tasks, "list", "rep")
    files = stored(ordered.sortWithinPartitions("list", "rep").mapInArrow(written, "list long, first long, path string"), "index")
    blocks = [(r["list"], r["path"]) for r in files.orderBy("list", "first", "path").collect()]

    def link(batches: Batches) -> Batches:
        quantiser = fitted.value
        for batch in batches:
            for i in batch.column(0).to_pylist():
                own, path = blocks[i]
                block = Block.read(path)
                wanted = quantiser.planes(block.unit, np.full(len(block.rep), own)) <= reach
                # blocks of a list follow one another by id, and a smaller id asks nobody of its list
                others = [j for j, (which, _) in enumerate(blocks) if which > own or (which == own and j <= i)]
                for j in others:
                    which, path = blocks[j]
                    some = np.flatnonzero(wanted[:, which])
                    if not len(some):
                        continue
                    ask = Block(block.rep[some], block.weight[some], block.error[some], block.codes[some], block.unit[some])
                    met = block_links(quantiser, ask, block if j == i else Block.read(path), which, which == own, threshold, reach)
                    yield from met.to_batches()

    dealt = spark.range(0, len(blocks), numPartitions=min(len(blocks), MOST_TASKS))
    return dealt.mapInArrow(link, "id long, links long, root long")


def near_embeddings(
    vectors: DataFrame,
    threshold: float = 0.95,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    sample_rows: int = SAMPLE_ROWS,
    list_rows: int = LIST_ROWS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every vector.

    ``n_links`` counts the other rows with cosine of at least ``threshold``,
    ``component_id`` is the smallest id reachable by links and ``kept`` marks it. Null
    vectors, zero vectors and ones with null or non-finite components link with
    nothing. Shorter vectors are compared as if they ended in zeros. Repeated rows
    are rows of their own, linked with each other; a row with a null id takes the
    component of its vector, null if that has no id. An empty table gives an empty one.
    """
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").alias("vector"))
    rows = rows.withColumn("vector", F.when(valid_vector("vector"), F.col("vector")))
    classes = stored(
        rows.where("vector is not null").groupBy("vector").agg(F.min("vec_id").alias("low"), F.count(F.lit(1)).alias("weight"))
        .select("vector", "low", "weight", F.coalesce("low", F.pmod(F.xxhash64("vector"), F.lit(NAMELESS)) + NAMELESS).alias("rep")),
        "vectors",
    )
    blocks = stored(linked_blocks(classes, threshold, sample_rows, list_rows, block_rows), "blocks")
    roots = linked_components(blocks.select(F.col("id").alias("a"), F.col("root").alias("b")))
    counted = blocks.groupBy(F.col("id").alias("rep")).agg(F.sum("links").alias("links"))
    known = (
        classes.join(counted, "rep", "left").join(roots.withColumnRenamed("id", "rep"), "rep", "left")
        .select("vector", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("root", "rep").alias("root"))
        .withColumn("root", F.when(F.col("root") < NAMELESS, F.col("root")))
    )
    return rows.join(known, "vector", "left").select(
        "vec_id",
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("root", "vec_id").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.coalesce("root", "vec_id"), F.lit(False)).alias("kept"),
    )
