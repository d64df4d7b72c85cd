"""Embedding near-duplicates by lattice hashing.

In each of several tables a random orthonormal projection takes a unit vector to eight dimensions, where it is decoded
to the nearest point of the E8 lattice. A vector is stored at its own point and looks into the points next to it. Within
a cell the tasks compare vectors by their exact cosine in double precision. A linked pair is counted in one cell only, the
first of those where it meets, so links are counted without ever being written out as pairs. For the components each linked
vector writes one row with the root of its links within the cell, a spanning forest of the pairs counted there.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.llm.common import connected_components, materialize

COSINE, TABLES, PROBES, SCALE, SEED = 0.95, 4, 8, 0.17, 20_231
#: Bytes of vectors that one block of a cell holds; larger cells are cut into blocks, and two blocks at a time are compared.
BLOCK_BYTES = 4 << 20
#: Pairs of a block that are looked at together.
_STRIP = 1 << 20


def _nearest_d8(x: np.ndarray) -> np.ndarray:
    """Nearest points of D8: whole coordinates with an even sum."""
    near = np.rint(x)
    off, row = x - near, np.arange(len(x))
    worst = np.argmax(np.abs(off), axis=1)
    odd = near.sum(1).astype(np.int64) % 2 != 0
    step = np.where(off[row, worst] >= 0, 1.0, -1.0)
    near[row[odd], worst[odd]] += step[odd]
    return near


def decode_e8(x: np.ndarray) -> np.ndarray:
    """Nearest points of E8, the union of D8 and D8 shifted by one half."""
    whole, half = _nearest_d8(x), _nearest_d8(x - 0.5) + 0.5
    return np.where((((x - whole) ** 2).sum(1) <= ((x - half) ** 2).sum(1))[:, None], whole, half)


def e8_roots() -> np.ndarray:
    """The 240 lattice points next to the origin."""
    pairs = [(i, j, a, b) for i, j in itertools.combinations(range(8), 2) for a in (1.0, -1.0) for b in (1.0, -1.0)]
    whole = np.zeros((len(pairs), 8))
    for k, (i, j, a, b) in enumerate(pairs):
        whole[k, i], whole[k, j] = a, b
    half = np.array([s for s in itertools.product((0.5, -0.5), repeat=8) if sum(v < 0 for v in s) % 2 == 0])
    return np.concatenate([whole, half])


def _cell(table: int, points: np.ndarray) -> np.ndarray:
    """A 64-bit name of a table's lattice points (twice their coordinates are whole numbers)."""
    name = np.full(points.shape[:-1], 0x9E3779B97F4A7C15 * (table + 1) % 2**64, np.uint64)
    for k in range(8):
        name = (name ^ (2 * points[..., k]).astype(np.int64).view(np.uint64)) * np.uint64(0xFF51AFD7ED558CCD)
        name ^= name >> np.uint64(32)
    return name.view(np.int64)


class Lattice:
    """The tables for vectors of dim components; the same in every task."""

    def __init__(self, dim: int, tables: int = TABLES, probes: int = PROBES, scale: float = SCALE) -> None:
        draw = np.random.default_rng(SEED)
        width = max(dim, 8)
        self.planes = [np.ascontiguousarray(np.linalg.qr(draw.normal(size=(width, 8)))[0][:dim].T) for _ in range(tables)]
        self.probes, self.scale, self.roots = probes, scale * np.sqrt(64 / width), e8_roots()

    def cells(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Own cells (rows, tables) and probed cells (rows, tables, probes). Each row's sums are its own, whatever stands beside it."""
        own, near = [], []
        for k, plane in enumerate(self.planes):
            x = (unit[:, None, :] * plane[None, :, :]).sum(-1) / self.scale
            at = decode_e8(x)
            closeness = ((x - at)[:, None, :] * self.roots[None, :, :]).sum(-1)
            first = np.argsort(-closeness, axis=1, kind="stable")[:, : self.probes]
            own.append(_cell(k, at))
            near.append(_cell(k, at[:, None, :] + self.roots[first]))
        return np.stack(own, 1), np.stack(near, 1)


def _unit(column, size: int) -> np.ndarray:
    """Unit vectors of a column of packed vectors of size components, scaled first so that no square overflows or vanishes."""
    v = np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, size)
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        body = [np.array(v, np.float64).tobytes() for v in b["vec"].to_pylist()]
        yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(body, pa.binary())], ["cid", "copies", "salt", "size", "vec"])


def _first_meeting(own: np.ndarray, near: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The cell in which each linked pair is counted: of the first table where it meets, the smallest common cell."""
    out, open_ = np.zeros(len(a), np.int64), np.ones(len(a), bool)
    for t in range(own.shape[1]):
        x, y = own[a, t], own[b, t]
        same = x == y
        y_seen, x_seen = (near[a, t] == y[:, None]).any(1), (near[b, t] == x[:, None]).any(1)  # a looks into b's cell, b into a's
        at = np.where(same, x, np.where(x_seen & y_seen, np.minimum(x, y), np.where(x_seen, x, y)))
        met = open_ & (same | x_seen | y_seen)
        out[met] = at[met]
        open_ &= ~met
    return out


def _local_roots(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each member the smallest member that the links behind root and the links a-b reach from it."""
    while True:
        x, y = root[a], root[b]
        low = np.minimum(x, y)
        now = root.copy()
        for at in (x, y, a, b):
            np.minimum.at(now, at, low)
        while (now[now] != now).any():
            now = now[now]
        if (now == root).all():
            return root
        root = now


_MEMBER = ["cell", "size", "owner", "cid", "copies", "salt", "vec"]


def _compared(tables: int, probes: int, scale: float, cosine: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattices: dict[int, Lattice] = {}
        names = ["cid", "links", "root"]

        def group(part: pa.Table) -> pa.RecordBatch | None:
            owner = part["owner"].to_numpy()
            if len(owner) < 2 or not owner.any():
                return None
            cell, size, i, j = (part[c][0].as_py() for c in ("cell", "size", "i", "j"))
            unit, block = _unit(part["vec"], size), part["block"].to_numpy()
            cid, copies = part["cid"].to_numpy(), part["copies"].to_numpy()
            left = np.flatnonzero(block == i) if i != j else np.arange(len(cid))
            right = np.flatnonzero(block == j) if i != j else left
            if not len(left) or not len(right):
                return None
            lattice = lattices.setdefault(size, Lattice(size, tables, probes, scale))
            links, root = np.zeros(len(cid), np.int64), np.arange(len(cid))
            place, cells = np.full(len(cid), -1), (np.zeros((0, tables), np.int64), np.zeros((0, tables, probes), np.int64))  # of members with a link
            strip = max(1, _STRIP // len(right))
            for k in range(0, len(left), strip):
                rows = left[k : k + strip]
                near = np.argwhere(unit[rows] @ unit[right].T >= cosine - 1e-9)
                a, b = rows[near[:, 0]], right[near[:, 1]]
                open_ = owner[a] | owner[b]
                if i == j:
                    open_ &= cid[a] < cid[b]
                a, b = a[open_], b[open_]
                sure = [np.zeros(0, bool), *((unit[a[m : m + 65536]] * unit[b[m : m + 65536]]).sum(1) >= cosine for m in range(0, len(a), 65536))]
                sure = np.concatenate(sure)
                a, b = a[sure], b[sure]
                if not len(a):
                    continue
                fresh = np.unique(np.concatenate([a, b]))
                fresh = fresh[place[fresh] < 0]
                if len(fresh):
                    place[fresh] = len(cells[0]) + np.arange(len(fresh))
                    cells = tuple(np.concatenate(pair) for pair in zip(cells, lattice.cells(unit[fresh]), strict=True))
                mine = _first_meeting(*cells, place[a], place[b]) == cell
                a, b = a[mine], b[mine]
                links += np.bincount(a, copies[b], len(cid)).astype(np.int64) + np.bincount(b, copies[a], len(cid)).astype(np.int64)
                if len(a):
                    root = _local_roots(root, a, b)
            hit = np.flatnonzero(links)
            return pa.RecordBatch.from_arrays([pa.array(cid[hit]), pa.array(links[hit]), pa.array(cid[root[hit]])], names)

        held: list[pa.RecordBatch] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                out = group(pa.Table.from_batches(held))
                held.clear()
                if out is not None and len(out):
                    yield out

        last = None
        for batch in batches:
            keys = np.stack([batch[n].to_numpy().astype(np.int64) for n in ("cell", "size", "i", "j")], 1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
            for x, y in itertools.pairwise(cuts):
                if x < y:
                    if last != (now := tuple(keys[x].tolist())):
                        yield from flush()
                        last = now
                    held.append(batch.slice(x, y - x))
        yield from flush()

    return run


def embedding_components(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE,
                         tables: int = TABLES, probes: int = PROBES, scale: float = SCALE) -> DataFrame:
    """vec, n_links, component_id, kept for each row of df.

    n_links counts the other rows linked directly, equal vectors included; component_id is the smallest identifier
    reachable. A null, zero or empty vector and one with a null or non-finite component link with nothing; vectors of
    different lengths do not link, and each length is a space of its own. Rows that repeat an identifier are rows like
    others. Equal vectors are one class, compared once. An empty table gives an empty result.
    """
    spark = df.sparkSession
    vector = F.col("raw").cast("array<double>")
    rows = df.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("raw")).withColumn("vec", vector)
    good = F.coalesce((F.size("vec") > 0) & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0), F.lit(False))
    rows = materialize(rows.select("vec_id", F.when(good, F.col("vec")).alias("vec")), "vectors")
    digest = F.sha2(F.to_binary(F.to_json(F.struct("vec")), F.lit("utf-8")), 256)
    rows = rows.withColumn("digest", F.when(F.col("vec").isNotNull(), digest))
    classes = rows.where("vec is not null").groupBy("digest").agg(F.min("vec_id").alias("least_id"), F.count(F.lit(1)).alias("copies"), F.first("vec").alias("vec"))
    classes = materialize(classes.withColumn("cid", F.monotonically_increasing_id()), "vector-classes")

    def membership(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattices: dict[int, Lattice] = {}
        for b in batches:
            sizes = b["size"].to_numpy()
            for size in np.unique(sizes).tolist():
                lattice = lattices.setdefault(size, Lattice(size, tables, probes, scale))
                alike = np.flatnonzero(sizes == size)
                for k in range(0, len(alike), 512):
                    part = b.take(pa.array(alike[k : k + 512]))
                    own, near = lattice.cells(_unit(part["vec"], size))
                    each = own.shape[1] * (1 + near.shape[2])
                    cell = np.concatenate([own[:, :, None], near], 2).reshape(len(part), each)
                    role = np.tile(np.arange(1 + near.shape[2]) == 0, own.shape[1])
                    index = pa.array(np.repeat(np.arange(len(part)), each))
                    columns = {n: part[n].take(index) for n in ("size", "cid", "copies", "salt", "vec")} | {"cell": pa.array(cell.ravel()), "owner": pa.array(np.tile(role, len(part)))}
                    yield pa.RecordBatch.from_arrays([columns[n] for n in _MEMBER], _MEMBER)

    layout = "cid long, copies long, salt long, size int, vec binary"
    slim = classes.select("cid", "copies", F.xxhash64("cid").alias("salt"), F.size("vec").alias("size"), "vec").mapInArrow(_packed, layout)
    members = slim.mapInArrow(membership, "cell long, size int, owner boolean, cid long, copies long, salt long, vec binary")
    room = F.greatest(F.lit(1), F.floor(F.lit(BLOCK_BYTES) / (8 * F.col("size"))))  # members of a block
    large = members.groupBy("cell", "size").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > room)
    large = materialize(large.select("cell", "size", F.ceil(F.col("n") / room).alias("blocks")), "large-cells")
    dealt = members.join(large, ["cell", "size"], "left").withColumn("block", F.coalesce(F.pmod("salt", "blocks"), F.lit(0)).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("blocks") - 1, F.lit(0)).cast("int")))
    dealt = dealt.select("cell", "size", "owner", "cid", "copies", "vec", "block", other.alias("other"))
    dealt = dealt.select("cell", "size", "owner", "cid", "copies", "vec", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = dealt.repartition(n, "cell", "size", "i", "j").sortWithinPartitions("cell", "size", "i", "j")
    found = materialize(blocks.mapInArrow(_compared(tables, probes, scale, cosine), "cid long, links long, root long"), "vector-links")
    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    groups = connected_components(found.where("root <> cid").select("cid", "root").distinct(), "cid", "root")
    named = classes.select("cid", "digest", "least_id", "copies").join(links, "cid", "left").join(groups.withColumnRenamed("node", "cid"), "cid", "left")
    named = materialize(named.withColumn("root", F.coalesce("component", "cid")), "vector-roots")
    names = named.groupBy("root").agg(F.min("least_id").alias("component"))
    by_class = named.drop("component").join(names, "root").select("digest", "component", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n"))
    out = rows.select("vec_id", "digest").join(by_class, "digest", "left")
    component = F.coalesce("component", "vec_id")
    return out.select(F.col("vec_id").alias("vec"), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return embedding_components(vectors).withColumnRenamed("vec", "vec_id")
