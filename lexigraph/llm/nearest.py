"""The k most similar vectors for every vector, by collision counting.

The search structure is a set of single-projection sorted arrays. A query opens
a window around its own position in each array; a vector that lies in at least
VOTES of the windows has collided with it often enough and is verified by its
exact cosine. Windows grow by virtual rehashing (the same arrays, a wider
interval): a query takes the narrowest windows with which at least ENOUGH
vectors reach the threshold, and only these are verified. The windows of all
queries are looked up in the arrays as sets of bits and counted in bit planes,
so no cosine is worked out before its pair has been counted.

Spark spreads the work by cells of about CELL_ROWS neighbouring rows. A vector
is kept in the cell of its nearest pivot, and asks the cells that hold its
`probes` nearest pivots; each cell has its own sorted arrays. The pivots start
as a sample, PIVOTS at most (16 MB), and are moved to the means of a larger
sample by sums in Spark; neighbouring pivots form a cell. A cell that the
sample finds larger than PART_ROWS is dealt to parts, all of which are asked, so
that no task grows with the input. Up to CELLS * CELL_ROWS (8 million) vectors
the work per vector stays the same; beyond that cells, and the parts asked,
grow in proportion. Every row is indexed. Equal vectors are one entry, known by
a 64-bit hash of their components (the chance that any two of n vectors clash is
n*n/2**65), so a vector that fills a third of the table costs one row per input
partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexigraph.session import cut

DIM = 64
#: Rows and sample rows a pivot, the most pivots (16 MB of vectors), and how often they are moved.
PIVOT_ROWS, SAMPLE_ROWS, PIVOTS, ROUNDS = 32, 8, 1 << 16, 2
#: Rows a cell, the most cells, and in how many cells a vector looks for its nearest pivots.
CELL_ROWS, CELLS, NEAR_CELLS = 1000, 1 << 13, 32
#: The most rows of a cell that one task searches; a larger cell is dealt to parts.
PART_ROWS = 2048
#: Windows (one per projection) in which a vector must lie to be verified.
VOTES = 56
#: Vectors that must reach the threshold before the windows stop growing: so many, and one in ENOUGH_OF of the cell.
ENOUGH, ENOUGH_OF = 64, 32
#: Half widths of the windows, tried by bisection; beyond them windows hold everything.
WIDTHS = 0.05 * 44.0 ** (np.arange(63) / 62)
#: Places to which a window's ends are rounded outwards in a sorted array.
PLACES = 128
#: Pairs counted at a time, so that a set of bits stays in a processor's cache.
TILE_BITS = 1 << 20


def centres_of(sample: np.ndarray, count: int, rounds: int = 6) -> np.ndarray:
    """Unit centres of a sample of unit vectors, by spherical k-means in tiles of rows."""
    centres = sample[:count].copy()
    for _ in range(rounds):
        near = nearest_centres(sample, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, sample)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norms > 1e-6, sums / np.maximum(norms, 1e-6), centres)
    return centres.astype(np.float32)


def nearest_centres(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    tiles = range(0, len(rows), 4096)
    found = [(rows[i : i + 4096] @ centres.T).argmax(axis=1) for i in tiles]
    return np.concatenate(found) if found else np.empty(0, np.int64)


def _projections(dim: int) -> np.ndarray:
    """One projection per dimension, at right angles, so that counts vary little at one distance."""
    turned, _ = np.linalg.qr(np.random.default_rng(20).standard_normal((dim, dim)))
    return (turned * np.sqrt(dim)).astype(np.float32)


class SortedArrays:
    """The projections of a cell's vectors; windows come out as sets of bits, one per vector."""

    def __init__(self, data: np.ndarray):
        own = data @ _projections(data.shape[1])
        self.low = own.min(axis=0)
        self.step = np.maximum((own.max(axis=0) - self.low) / PLACES * 1.0001, 1e-9)
        places = ((own - self.low) / self.step).astype(np.int16)
        below = np.arange(PLACES + 1, dtype=np.int16)[:, None]
        words = -(-len(data) // 64)
        bits = np.zeros((own.shape[1], PLACES + 1, words * 8), np.uint8)
        for p in range(own.shape[1]):
            packed = np.packbits(places[:, p][None] < below, axis=1, bitorder="little")
            bits[p, :, : packed.shape[1]] = packed
        self.before = bits.view(np.uint64)

    def colliding(self, at: np.ndarray, half: np.ndarray) -> np.ndarray:
        """Bits of the vectors that lie in at least VOTES of each query's windows."""
        wide = half[:, None]
        first = np.clip(np.floor((at - wide - self.low) / self.step), 0, PLACES).astype(np.int16)
        last = np.clip(np.ceil((at + wide - self.low) / self.step), 0, PLACES).astype(np.int16)
        windows = []
        for p in range(at.shape[1]):
            window = self.before[p].take(last[:, p], axis=0)
            window ^= self.before[p].take(first[:, p], axis=0)
            windows.append(window)
        return _at_least(_counted(windows), VOTES)


def _counted(sets: list[np.ndarray]) -> list[np.ndarray]:
    """Bit planes, lowest first, of how many of the sets hold each element; overwrites the sets."""
    planes, level = [], sets
    while level:
        carried = []
        while len(level) > 1:
            a, b = level.pop(), level.pop()
            half = a ^ b
            a &= b
            if level:
                c = level.pop()
                np.bitwise_and(half, c, out=b)
                a |= b
                half ^= c
            carried.append(a)
            level.insert(0, half)
        planes.append(level[0])
        level = carried
    return planes


def _at_least(planes: list[np.ndarray], least: int) -> np.ndarray:
    result = np.full_like(planes[0], ~np.uint64(0))
    for i, plane in enumerate(planes):
        result = plane & result if (least >> i) & 1 else plane | result
    return result if least >> len(planes) == 0 else np.zeros_like(result)


def search_cell(
    queries: np.ndarray, query_keys: np.ndarray, data: np.ndarray, data_keys: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray, int]:
    """Indexes and cosines of up to k data vectors per query (-1 where there are fewer), and the verified pairs.

    A query finds no entry of its own key.
    """
    best_i = np.full((len(queries), k), -1, np.int64)
    best_s = np.full((len(queries), k), -2.0, np.float32)
    verified = 0
    if len(data) == 0:
        return best_i, best_s, verified
    arrays, turn = SortedArrays(data), _projections(data.shape[1])
    everything = 4 * np.sqrt(data.shape[1])
    widths = np.append(WIDTHS, everything)
    enough = ENOUGH + len(data) // ENOUGH_OF
    rows_a_tile = max(32, TILE_BITS // len(data))
    for start in range(0, len(queries), rows_a_tile):
        tile = slice(start, start + rows_a_tile)
        asked = queries[tile]
        at = asked @ turn
        narrow, wide = np.zeros(len(asked), np.int64), np.full(len(asked), len(WIDTHS))
        hits = arrays.colliding(at, widths[wide])
        while (narrow < wide).any():
            middle = (narrow + wide) // 2
            inside = arrays.colliding(at, widths[middle])
            reached = np.bitwise_count(inside).sum(axis=1) >= enough
            hits[reached] = inside[reached]
            wide = np.where(reached, middle, wide)
            narrow = np.where(reached, narrow, np.minimum(middle + 1, wide))
        hits = hits.view(np.uint8)
        row, column = np.nonzero(np.unpackbits(hits, axis=1, count=len(data), bitorder="little"))
        other = query_keys[tile][row] != data_keys[column]
        row, column = row[other], column[other]
        verified += len(row)
        # verified pairs side by side, a row per query
        counts = np.bincount(row, minlength=len(asked))
        place = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
        cosines = np.full((len(asked), max(k, counts.max())), -2.0, np.float32)
        columns = np.full(cosines.shape, -1, np.int64)
        cosines[row, place] = np.einsum("ij,ij->i", asked[row], data[column])
        columns[row, place] = column
        top = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
        best_i[tile] = np.take_along_axis(columns, top, axis=1)
        best_s[tile] = np.take_along_axis(cosines, top, axis=1)
    return best_i, best_s, verified


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A column of equally long float lists or of equally long float32 bytes as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return np.empty((0, DIM), np.float32)
    if pa.types.is_binary(column.type):
        _, offsets, data = column.buffers()
        ends = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1]
        return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]].view(np.float32).reshape(len(column), -1)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _bytes(matrix: np.ndarray) -> pa.Array:
    rows = np.ascontiguousarray(matrix, np.float32)
    ends = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1] * 4
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(rows)])


def _unit(matrix: np.ndarray) -> np.ndarray:
    wide = matrix.astype(np.float64)
    return (wide / np.linalg.norm(wide, axis=1, keepdims=True)).astype(np.float32)


def usable_vectors(vector_index: DataFrame, dim: int = DIM) -> DataFrame:
    """(chunk_id, vkey, embedding): rows with an id and a full, finite, non-zero vector."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return (
        vector_index.where("chunk_id is not null and embedding is not null")
        .where(F.size("embedding") == dim)
        .where(~bad & F.exists("embedding", lambda x: x != 0))
        .select("chunk_id", F.xxhash64("embedding").alias("vkey"), "embedding")
    )


def _sampled(vectors: DataFrame, share: float) -> DataFrame:
    """(vkey, embedding) of that share of the distinct vectors, the same ones each time."""
    at = F.pmod(F.xxhash64(F.lit(5), "vkey"), F.lit(1 << 30))
    chosen = vectors.where(at <= int(min(share, 1.0) * (1 << 30))) if share < 1 else vectors
    return chosen.select("vkey", "embedding").dropDuplicates(["vkey"])


class Routes:
    """Pivots in cells of neighbouring pivots, and the parts of each cell."""

    def __init__(self, pivots: np.ndarray, rows: np.ndarray):
        """pivots: unit vectors; rows: how many rows of the table each pivot stands for."""
        count = min(CELLS, max(1, round(rows.sum() / CELL_ROWS)), len(pivots))
        centres = centres_of(pivots, count, 10)
        cell = nearest_centres(pivots, centres)
        order = np.argsort(cell, kind="stable")
        self.pivots, self.cell = pivots[order], cell[order]
        self.starts = np.searchsorted(self.cell, np.arange(count + 1))
        self.centres = centres
        self.parts = np.maximum(1, np.ceil(np.bincount(cell, rows, minlength=count) / PART_ROWS)).astype(np.int64)
        self.first = np.cumsum(self.parts) - self.parts

    def nearest(self, unit: np.ndarray, probes: int) -> np.ndarray:
        """The cells of the `probes` nearest pivots of each row, the nearest first.

        Pivots are looked for in the NEAR_CELLS cells of the nearest centres.
        """
        near = unit @ self.centres.T
        looked = min(NEAR_CELLS, len(self.centres))
        chosen = np.argpartition(-near, looked - 1, axis=1)[:, :looked]
        best_s = np.full((len(unit), probes), -3.0, np.float32)
        best_c = np.zeros((len(unit), probes), np.int64)
        by_cell = np.argsort(chosen, axis=None, kind="stable")
        ends = np.searchsorted(chosen.ravel()[by_cell], np.arange(len(self.centres) + 1))
        for c in range(len(self.centres)):
            rows = by_cell[ends[c] : ends[c + 1]] // looked
            held = self.pivots[self.starts[c] : self.starts[c + 1]]
            if not len(rows) or not len(held):
                continue
            cosines = np.hstack([best_s[rows], unit[rows] @ held.T])
            top = np.argpartition(-cosines, probes - 1, axis=1)[:, :probes]
            best_s[rows] = np.take_along_axis(cosines, top, axis=1)
            best_c[rows] = np.where(top < probes, np.take_along_axis(best_c[rows], np.minimum(top, probes - 1), axis=1), c)
        order = np.argsort(-best_s, axis=1, kind="stable")
        cells = np.take_along_axis(best_c, order, axis=1)
        # where there are fewer pivots than probes the nearest one stands in
        return np.where(np.take_along_axis(best_s, order, axis=1) > -3, cells, cells[:, :1])


def routes(vectors: DataFrame) -> Routes | None:
    """Pivots and cells for usable vectors; None where there are none.

    The pivots start as sampled vectors; each round moves them to the mean of
    the sample vectors next to them, which are summed up in Spark.
    """
    spark = vectors.sparkSession
    n = vectors.count()
    wanted = max(1, min(PIVOTS, n // PIVOT_ROWS))
    share = min(1.0, SAMPLE_ROWS * wanted / max(n, 1))
    sample = cut(_sampled(vectors, share))
    size = sample.count()
    start = sample.orderBy(F.xxhash64(F.lit(7), "vkey")).limit(wanted).toArrow()
    if start.num_rows == 0:
        return None
    pivots = _unit(_matrix(start["embedding"]))
    buckets = max(1, size // 20_000)

    for _ in range(ROUNDS):
        held = spark.sparkContext.broadcast(pivots)

        def summed(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                unit = _unit(_matrix(batch.column("embedding")))
                if not len(unit):
                    continue
                near, place = np.unique(nearest_centres(unit, held.value), return_inverse=True)
                sums = np.zeros((len(near), unit.shape[1]), np.float32)
                np.add.at(sums, place, unit)
                columns = [pa.array(near % buckets), pa.array(near), pa.array(np.bincount(place)), _bytes(sums)]
                yield pa.RecordBatch.from_arrays(columns, names=["bucket", "pivot", "rows", "vec"])

        def added(table: pa.Table) -> pa.Table:
            near, place = np.unique(table["pivot"].to_numpy(), return_inverse=True)
            parts = _matrix(table["vec"]).astype(np.float64)
            # in one order, whatever order the parts came in
            order = np.lexsort((parts[:, 0], place))
            sums = np.zeros((len(near), parts.shape[1]))
            np.add.at(sums, place[order], parts[order])
            rows = np.bincount(place, table["rows"].to_numpy()).astype(np.int64)
            return pa.table({"pivot": pa.array(near), "rows": pa.array(rows), "vec": _bytes(sums)})

        moved = (
            sample.mapInArrow(summed, "bucket bigint, pivot bigint, rows bigint, vec binary")
            .groupBy("bucket")
            .applyInArrow(added, "pivot bigint, rows bigint, vec binary")
            .toArrow()
        )
        moved = moved.sort_by("pivot")
        sums = _matrix(moved["vec"])
        # pivots that no sample vector is next to drop out
        pivots = _unit(np.where(np.abs(sums).sum(axis=1, keepdims=True) > 1e-6, sums, pivots[moved["pivot"].to_numpy()]))
        rows = moved["rows"].to_numpy() / max(share, size / n)
    return Routes(pivots, rows)


def neighbour_classes(
    vectors: DataFrame, k: int, probes: int = 8, min_cosine: float = -2.0
) -> DataFrame:
    """(vkey, nbr, cosine): up to k nearest other distinct vectors of each distinct vector.

    Neighbours under min_cosine are left out where they are found.
    """
    spark = vectors.sparkSession
    found_routes = routes(vectors)
    if found_routes is None:
        return spark.createDataFrame([], "vkey bigint, nbr bigint, cosine float")
    table = spark.sparkContext.broadcast(found_routes)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where = table.value
        seen: set[int] = set()
        for batch in batches:
            keys = batch.column("vkey").to_numpy()
            new = [i for i, x in enumerate(keys.tolist()) if not (x in seen or seen.add(x))]
            if not new:
                continue
            keys, unit = keys[new], _unit(_matrix(batch.column("embedding").take(pa.array(new))))
            cells = where.nearest(unit, probes)
            home = cells[:, 0]
            asked = np.sort(cells, axis=1)
            once = np.ones_like(asked, bool)
            once[:, 1:] = asked[:, 1:] != asked[:, :-1]
            row, column = np.nonzero(once)
            cell = asked[row, column]
            # every part of a cell is asked, one of them keeps the row
            parts = where.parts[cell]
            row, cell = np.repeat(row, parts), np.repeat(cell, parts)
            part = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
            own = (cell == home[row]) & (keys[row] % where.parts[cell] == part)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array((where.first[cell] + part).astype(np.int32)),
                    pa.array(own),
                    pa.array(keys[row]),
                    _bytes(unit[row]),
                ],
                names=["cell", "home", "vkey", "vec"],
            )

    def search(rows: pa.Table) -> pa.Table:
        keys, first = np.unique(rows["vkey"].to_numpy(), return_index=True)
        unit = _matrix(rows["vec"])[first]
        home = rows["home"].to_numpy()[first]
        ids, cosines, _ = search_cell(unit, keys, unit[home], keys[home], k)
        there = (ids >= 0) & (cosines >= min_cosine)
        row, _ = np.nonzero(there)
        nbrs = keys[home][ids[there]] if home.any() else np.empty(0, np.int64)
        return pa.table(
            {
                "vkey": pa.array(keys[row]),
                "nbr": pa.array(nbrs, pa.int64()),
                "cosine": pa.array(cosines[there], pa.float32()),
            }
        )

    routed = vectors.select("vkey", "embedding").mapInArrow(
        route, "cell int, home boolean, vkey bigint, vec binary"
    )
    found = routed.groupBy("cell").applyInArrow(search, "vkey bigint, nbr bigint, cosine float")
    best = Window.partitionBy("vkey").orderBy(F.desc("cosine"), "nbr")
    # at most k rows of each cell that was asked
    return found.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k).drop("_r")


def class_members(vectors: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """All (chunk_id, vkey), and the first k + 1 chunk_ids of each vkey.

    No list of k nearest reaches further into a class of equal vectors. The
    limit on the rank is applied in each map task before the shuffle. A
    chunk_id stored with several vectors counts with one of them.
    """
    ids = vectors.groupBy("chunk_id").agg(F.min("vkey").alias("vkey"))
    order = Window.partitionBy("vkey").orderBy("chunk_id")
    first = ids.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1).drop("r")
    return ids, first


def nearest_chunks(
    vector_index: DataFrame, k: int = 5, probes: int = 8, min_cosine: float | None = None
) -> DataFrame:
    """(chunk_id, rank, neighbour, cosine): the k most similar other chunks of each chunk.

    Order: cosine descending, then the neighbour's chunk_id. Rows whose vector
    is null, of another length, all zero or with null or non-finite parts take
    no part; repeated rows count once; equal vectors are each other's
    neighbours with cosine 1. With min_cosine only neighbours of at least that
    cosine are listed (their ranks do not change), and of a class of more than
    k + 1 equal vectors only the first k + 1 chunks, as no other of them is in
    any list; without it every chunk has its list.
    """
    vectors = usable_vectors(vector_index)
    near = neighbour_classes(vectors, k, probes, -2.0 if min_cosine is None else min_cosine)
    ids, first = class_members(vectors, k)
    if min_cosine is not None:
        ids = first
    same = first.groupBy("vkey").count().where("count > 1").select(
        "vkey", F.col("vkey").alias("nbr"), F.lit(1.0).cast("float").alias("cosine")
    )
    listed = near.unionByName(same).join(
        first.select(F.col("vkey").alias("nbr"), F.col("chunk_id").alias("neighbour")), "nbr"
    )
    rank = F.row_number().over(
        Window.partitionBy("chunk_id").orderBy(F.desc("cosine"), "neighbour")
    )
    return (
        ids.join(listed, "vkey")
        .where("chunk_id <> neighbour")
        .select("chunk_id", rank.alias("rank"), "neighbour", F.col("cosine").cast("double"))
        .where(F.col("rank") <= k)
    )


def mutual_pairs(vector_index: DataFrame, min_cosine: float, k: int = 5) -> DataFrame:
    """(chunk_id_a, chunk_id_b, cosine), a < b: each among the k nearest of the other."""
    lists = nearest_chunks(vector_index, k, min_cosine=min_cosine)
    return (
        lists.select(
            F.least("chunk_id", "neighbour").alias("chunk_id_a"),
            F.greatest("chunk_id", "neighbour").alias("chunk_id_b"),
            "cosine",
        )
        .groupBy("chunk_id_a", "chunk_id_b")
        .agg(F.count(F.lit(1)).alias("n"), F.max("cosine").alias("cosine"))
        .where("n = 2")
        .drop("n")
    )
