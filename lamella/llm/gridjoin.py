"""Embedding near-duplicates by an epsilon grid order join.

Unit vectors with a cosine of at least COSINE lie within EPSILON of each other. Vectors are sorted
by their grid cells (side EPSILON) on the leading principal dimensions and cut into blocks. Intervals of
the sequence are joined recursively, first as rows of bounding boxes over blocks, then inside a task
over parts of two blocks, and whatever lies farther apart than EPSILON is skipped. No link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamella.llm.common import py, settle, table
from lamella.llm.components import components

COSINE = 0.9
EPSILON = float(np.sqrt(2 - 2 * COSINE))
#: Room for rounding when boxes are compared.
SLACK = 1e-9
#: Principal dimensions of the grid.
LEADING = 8
#: Coordinates from which principal dimensions are found; longer vectors use their first ones.
SPREAD = 256
#: Vectors of a block, children of an interval, and vectors of the parts that are compared outright.
BLOCK, FAN, PART = 2048, 32, 256
#: Bytes of vectors that one tile of block pairs holds, and blocks of a side of it, at most.
TILE_BYTES, TILE = 16 << 20, 8
CELLS = [f"c{i}" for i in range(LEADING)]
LOW, HIGH = [f"lo{i}" for i in range(LEADING)], [f"hi{i}" for i in range(LEADING)]


def usable():
    """Whether a row's vector can be compared: with an id, not null, not zero, no null or non-finite components."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & fine & F.exists("embedding", lambda x: x != 0), F.lit(False))


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows at length one; scaled first, so that squares neither overflow nor vanish."""
    rows = rows.astype(np.float64)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def _matrix(column) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def principal(reps: DataFrame) -> dict[int, np.ndarray]:
    """The leading principal dimensions of the most frequent vector length, from all vectors; SPREAD ** 2 sums reach the driver."""
    sizes = reps.groupBy("dim").count().orderBy(F.desc("count"), "dim").first()
    if sizes is None:
        return {}
    d = min(sizes.dim, SPREAD)

    def run(batches):
        total, n = np.zeros((d + 1, d + 1)), 0
        for b in batches:
            for a in range(0, b.num_rows, 4096):
                x = unit(_matrix(b.column("e").slice(a, 4096)))[:, :d]
                x = np.c_[x, np.ones(len(x))]
                total += x.T @ x
                n += len(x)
        if n:
            i, j = np.indices(total.shape)
            yield pa.RecordBatch.from_arrays([pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), pa.array(total.ravel(), pa.float64())], ["i", "j", "s"])

    sums = py(reps.sparkSession, reps.where(F.col("dim") == sizes.dim).select("e"), run, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).toArrow()
    m = np.zeros((d + 1, d + 1))
    m[sums.column("i").to_numpy(), sums.column("j").to_numpy()] = sums.column("s").to_numpy()
    mean = m[:d, d] / m[d, d]
    _, vecs = np.linalg.eigh(m[:d, :d] / m[d, d] - np.outer(mean, mean))
    return {sizes.dim: vecs[:, ::-1][:, :LEADING]}


def coordinates(rows: np.ndarray, axes: dict[int, np.ndarray]) -> np.ndarray:
    """Coordinates of unit vectors on the leading dimensions; vectors of other lengths keep their own first ones."""
    found = axes.get(rows.shape[1])
    x = rows[:, : found.shape[0]] @ found if found is not None else rows[:, :LEADING]
    return np.c_[x, np.zeros((len(x), LEADING - x.shape[1]))]


def _grid(reps: DataFrame, axes) -> DataFrame:
    """Cells of each vector on the leading dimensions."""

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            dims = b.column("dim").to_numpy()
            cells = np.zeros((b.num_rows, LEADING), np.int32)
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                cells[at] = np.floor(coordinates(unit(_matrix(b.column("e").take(pa.array(at)))), axes) / EPSILON)
            yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array(c) for c in cells.T]], [*b.schema.names, *CELLS])

    kind = dict(reps.dtypes)["e"]
    return py(reps.sparkSession, reps.select("rep", "n", "dim", "e"), run, f"rep long, n long, dim int, e {kind}, " + ", ".join(f"{c} int" for c in CELLS))


def _blocks(reps: DataFrame, axes) -> DataFrame:
    """The sequence in grid order cut into blocks: (block, dim, ids, ns, vectors, box); a block of two lengths is two rows."""
    spark = reps.sparkSession
    order = ["dim", *CELLS, "rep"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    in_order = _grid(reps, axes).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    placed = settle(in_order.withColumn("at", F.monotonically_increasing_id()).select("rep", "n", "dim", "e", F.shiftright("at", 33).alias("part"), F.col("at").bitwiseAND((1 << 33) - 1).alias("pos")), "sequence")
    sizes = {r.part: r.n for r in placed.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each partition
    starts, total = [], 0
    for p in sorted(sizes):
        starts.append((p, total))
        total += sizes[p]
    if not starts:
        starts = [(0, 0)]
    offsets = spark.createDataFrame(starts, "part long, start long")
    numbered = placed.join(F.broadcast(offsets), "part").withColumn("block", F.floor((F.col("start") + F.col("pos")) / BLOCK))

    def pack(key, batches):
        t = pa.Table.from_batches(list(batches)).combine_chunks().sort_by([("start", "ascending"), ("pos", "ascending")])
        rows = _matrix(t.column("e").combine_chunks())
        where = coordinates(unit(rows), axes)
        yield pa.RecordBatch.from_arrays(
            [pa.array([key[0].as_py()], pa.int64()), pa.array([key[1].as_py()], pa.int32()), *[pa.array([t.column(c).to_numpy().astype("<i8").tobytes()], pa.binary()) for c in ("rep", "n")], pa.array([rows.tobytes()], pa.binary()), pa.array([where.tobytes()], pa.binary()), *[pa.array([x]) for x in (*where.min(axis=0), *where.max(axis=0))]],
            ["block", "dim", "ids", "ns", "vectors", "places", *LOW, *HIGH],
        )

    pack.__annotations__ = {"key": tuple[pa.Scalar, ...], "batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    schema = "block long, dim int, ids binary, ns binary, vectors binary, places binary, " + ", ".join(f"{c} double" for c in (*LOW, *HIGH))
    return settle(numbered.select("block", "dim", "rep", "n", "e", "start", "pos").groupBy("block", "dim").applyInArrow(pack, schema), "blocks")


def _near(blocks: DataFrame) -> DataFrame:
    """Pairs of block rows (a, b) of one vector length whose boxes lie within EPSILON, by recursion over intervals."""
    boxes = blocks.select("block", "dim", *LOW, *HIGH)
    last = boxes.agg(F.max("block")).first()[0] or 0
    levels = 0
    while last >= FAN**levels:
        levels += 1

    def interval(level: int) -> DataFrame:
        own = boxes.withColumn("i", F.floor(F.col("block") / FAN**level))
        return own.groupBy("i", "dim").agg(*[F.min(c).alias(c) for c in LOW], *[F.max(c).alias(c) for c in HIGH])

    pairs = interval(levels).select(F.col("i").alias("a"), F.col("i").alias("b"), "dim")
    for level in range(levels - 1, -1, -1):
        held = interval(level)
        left = held.select(F.col("i").alias("x"), F.floor(F.col("i") / FAN).alias("a"), "dim", *[F.col(c).alias(f"x_{c}") for c in (*LOW, *HIGH)])
        right = held.select(F.col("i").alias("y"), F.floor(F.col("i") / FAN).alias("b"), "dim", *[F.col(c).alias(f"y_{c}") for c in (*LOW, *HIGH)])
        gap = sum((F.pow(F.greatest(F.col(f"x_{lo}") - F.col(f"y_{hi}"), F.col(f"y_{lo}") - F.col(f"x_{hi}"), F.lit(0.0)), F.lit(2.0)) for lo, hi in zip(LOW, HIGH)), F.lit(0.0))
        pairs = pairs.join(left, ["a", "dim"]).join(right, ["b", "dim"]).where((F.col("x") <= F.col("y")) & (gap <= EPSILON**2 + SLACK)).select(F.col("x").alias("a"), F.col("y").alias("b"), "dim")
        pairs = settle(pairs, "intervals")
    return pairs


def _apart(x: np.ndarray, y: np.ndarray) -> bool:
    gap = np.maximum(0, np.maximum(x.min(axis=0) - y.max(axis=0), y.min(axis=0) - x.max(axis=0)))
    return float((gap * gap).sum()) > EPSILON**2 + SLACK


def forest(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For a matrix of links, (row nodes, column nodes) labels: nodes joined by links share the least label."""
    rows, cols = np.arange(s.shape[0]), np.arange(s.shape[1]) + s.shape[0]
    while True:
        r = np.minimum(rows, np.where(s, cols, 1 << 40).min(axis=1))
        c = np.minimum(cols, np.where(s, r[:, None], 1 << 40).min(axis=0))
        if (r == rows).all() and (c == cols).all():
            return rows, cols
        rows, cols = r, c


def join_blocks(ids: tuple[np.ndarray, np.ndarray], ns: tuple[np.ndarray, np.ndarray], vectors: tuple[np.ndarray, np.ndarray], places: tuple[np.ndarray, np.ndarray], same: bool):
    """(ids, links, least id joined) of vectors of two blocks that have links, by recursion over parts of both."""
    n, m = len(ids[0]), len(ids[1])
    links = np.zeros(n + m, np.int64)
    parent = list(range(n + m))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    def join(a: int, b: int, c: int, d: int) -> None:
        if same and a >= d or _apart(places[0][a:b], places[1][c:d]):
            return
        if b - a > PART or d - c > PART:
            if b - a >= d - c:
                mid = (a + b) // 2
                join(a, mid, c, d)
                join(mid, b, c, d)
            else:
                mid = (c + d) // 2
                join(a, b, c, mid)
                join(a, b, mid, d)
            return
        s = vectors[0][a:b] @ vectors[1][c:d].T >= COSINE
        if same:
            s &= np.arange(a, b)[:, None] < np.arange(c, d)[None, :]
        if not s.any():
            return
        links[a:b] += s @ ns[1][c:d]
        links[n + c : n + d] += ns[0][a:b] @ s
        for i, label in enumerate(np.concatenate(forest(s))):
            if label != i:
                x, y = (root(a + k if k < b - a else n + c + k - (b - a)) for k in (i, label))
                parent[max(x, y)] = min(x, y)

    join(0, n, 0, m)
    both = np.concatenate(ids)
    if same:
        links = links[:n] + links[n:]
        for i in range(n):
            x, y = root(i), root(n + i)
            parent[max(x, y)] = min(x, y)
    at = np.flatnonzero(links)
    least: dict[int, int] = {}
    roots = [root(i) for i in at]
    for i, r in zip(at, roots):
        least[r] = min(least.get(r, 1 << 62), int(both[i]))
    return both[at], links[at], np.array([least[r] for r in roots], np.int64)


def _links(blocks: DataFrame, pairs: DataFrame, kind: str) -> DataFrame:
    """(rep, links, least) of every near pair of blocks: as many rows as vectors with links, not as pairs of them.

    Pairs are dealt in tiles of neighbouring blocks, and a block is sent once to each tile, not to each pair.
    """
    side = F.greatest(F.lit(1), F.least(F.lit(TILE), (F.lit(TILE_BYTES) / (2 * BLOCK * int(kind[-1]) * F.col("dim"))).cast("int")))
    tiled = pairs.withColumns({"ta": F.col("a") - F.pmod("a", side), "tb": F.col("b") - F.pmod("b", side)})
    needed = tiled.select("ta", "tb", "dim", F.explode(F.array("a", "b")).alias("block")).distinct()
    content = needed.join(blocks.select("block", "dim", "ids", "ns", "vectors", "places"), ["block", "dim"])
    every = tiled.select("ta", "tb", "dim", "a", "b").unionByName(content, allowMissingColumns=True)

    def run(key, batches):
        t = pa.Table.from_batches(list(batches))
        held = {}
        for row in t.filter(pc.is_valid(t.column("block"))).select(["block", "ids", "ns", "vectors", "places"]).to_pylist():
            d = key[2].as_py()
            held[row["block"]] = (np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["ns"], "<i8"), unit(np.frombuffer(row["vectors"], kind).reshape(-1, d)), np.frombuffer(row["places"], np.float64).reshape(-1, LEADING))
        asked = t.filter(pc.is_valid(t.column("a")))
        for a, b in sorted(zip(asked.column("a").to_pylist(), asked.column("b").to_pylist())):
            out = join_blocks(*zip(held[a], held[b]), a == b)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["rep", "links", "least"])

    run.__annotations__ = {"key": tuple[pa.Scalar, ...], "batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    return settle(every.groupBy("ta", "tb", "dim").applyInArrow(run, "rep long, links long, least long"), "block-links")


def near_vectors(vectors: DataFrame) -> DataFrame:
    """Links and components of vectors (vec_id, embedding) whose cosine is at least COSINE, in double precision.

    Returns a row for each input row: vec_id, n_links (other rows linked directly), component_id (the
    smallest vec_id reachable) and kept. Equal vectors are one inside and linked to each other. Null or zero vectors and
    those with null or non-finite components stand alone, vectors of different lengths never link, rows
    with a null vec_id stand alone with a null component and aren't kept. Rows that repeat a vec_id are rows of their own,
    which share a component and, if their vectors differ, the sum of the links. An empty table gives an empty one.
    """
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    kind = "<f4" if dict(vectors.dtypes)["embedding"] == "array<float>" else "<f8"
    if kind == "<f8":
        vectors = vectors.withColumn("embedding", F.col("embedding").cast("array<double>"))
    key = [F.xxhash64("embedding").alias("h1"), F.xxhash64(F.lit(7), "embedding").alias("h2")]
    rows = vectors.where(usable())
    reps = settle(rows.select("vec_id", "embedding", *key).groupBy("h1", "h2").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n"), F.first("embedding").alias("e")).withColumn("dim", F.size("e").cast("int")), "vectors")
    rows = rows.select("vec_id", *key)
    blocks = _blocks(reps, principal(reps))
    found = _links(blocks, _near(blocks), kind)
    # a vec_id with several vectors joins them
    several = rows.groupBy("vec_id").agg(F.min(F.struct("h1", "h2")).alias("lo"), F.max(F.struct("h1", "h2")).alias("hi")).where("lo <> hi").select("vec_id")
    several = rows.join(several, "vec_id", "left_semi").join(reps.select("h1", "h2", "rep"), ["h1", "h2"]).select(F.col("vec_id").alias("a"), F.col("rep").alias("b"))
    parts = components(found.select(F.col("rep").alias("a"), F.col("least").alias("b")).unionByName(several).where("a <> b"))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    state = reps.select("h1", "h2", "rep", "n").join(links, "rep", "left").join(parts, F.col("rep") == F.col("node"), "left")
    state = settle(state.select("h1", "h2", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id")), "vector-state")
    linked = rows.join(state, ["h1", "h2"]).select("vec_id", "n_links", "component_id")
    alone = vectors.where(~usable()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op9_embedding_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components over every vector, whatever its label."""
    return near_vectors(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))
