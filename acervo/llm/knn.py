"""Most similar vectors for every vector: block matrix join.

The vectors are scaled to length 1, quantised to int8 with one scale a block and written in blocks to
the shared folder, beside the vectors as given. A task holds one block of query vectors and streams
the codes of all blocks past it. A product tile of codes holds whole numbers below 2^24, which BLAS
adds exactly in float32, so with the two scales it gives every cosine with a bound on its quantisation
error; it is compared as it is with one whole-number threshold a query. Only pairs that can still
enter a row's k best are recomputed in float and merged into the row's heap; the float vectors of a
block are read if it has such a pair. Nothing is shuffled but the final lists, memory is a tile, and
the result is exact in double precision. The work is quadratic in the number of vectors.

A search that asks for a least cosine codes outlines: the vector's first components in a rotation
that gathers length there, and the length of the rest. By Cauchy and Schwarz the product of two
outlines is at least the cosine, so a tile over a third of the components rules out the same pairs
for certain, and the others are recomputed as above. Where pairs above the least cosine are few, a
pair of blocks is multiplied once and serves the lists of both.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from acervo.operators.latest import latest
from acervo.runtime import materialise, parallelism, write_shared

#: Vectors in a written block, and at most in a task's query block.
BLOCK, QUERIES = 4096, 32768
#: Query rows of a product tile (STRIP x BLOCK floats, 16 MB).
STRIP = 1024
#: Vectors that the outline is fitted on, products of a code that recomputing a pair costs, and twice the usual error of the codes.
FITTED, RECOMPUTED, LOOSE = 2048, 15_000, 0.02
_BLOCK = "ids array<string>, codes binary, scale double, errors binary, exact binary, block bigint"


def usable(df: DataFrame, key: str, vector: str, dim: int) -> DataFrame:
    """(id, v): rows with a key and `dim` finite numbers that aren't all zero. Rows are as given:
    resolve versions before. Null elements make a vector unusable."""
    v = F.col(f"`{vector}`")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = (F.size(v) == dim) & F.coalesce(finite, F.lit(False)) & F.exists(v, lambda x: x != 0)
    return df.select(F.col(f"`{key}`").cast("string").alias("id"), v.cast("array<float>").alias("v")).where(F.col("id").isNotNull() & F.coalesce(good, F.lit(False)))


def quantise(x: np.ndarray) -> tuple[np.ndarray, float]:
    """int8 codes of a block of vectors and their scale."""
    scale = float(np.abs(x).max()) / 127
    return np.rint(x / scale).astype(np.int8), scale


def unit(given: np.ndarray) -> np.ndarray:
    """Vectors of length 1 in double precision."""
    x = given.astype(np.float64)
    return x / np.linalg.norm(x, axis=1)[:, None]


def outline(x: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """Components of unit vectors along the columns of `turn`, which are orthonormal, and the length of
    the rest: the product of two outlines is at least that of the vectors."""
    kept = x @ turn
    return np.hstack([kept, np.sqrt(np.maximum(1 - np.einsum("ij,ij->i", kept, kept), 0))[:, None]])


def weights(dim: int, turn: np.ndarray | None) -> np.ndarray:
    """What a step of each component's code counts: the rest of an outline is longer than its other
    components and has twice their step, so that theirs can be small."""
    return np.ones(dim) if turn is None else np.append(np.ones(turn.shape[1]), 2.0)


def fit_outline(given: np.ndarray, least: float) -> tuple[np.ndarray | None, float]:
    """The columns for which outlines of the sampled vectors cost least (None: whole vectors cost less),
    and the share of pairs with at least the cosine `least`. Only the cost depends on them."""
    x = unit(given)
    dim = x.shape[1]
    turn = np.linalg.eigh(x.T @ x)[1][:, ::-1]
    y, other = (x @ turn).astype(np.float32), ~np.eye(len(x), dtype=bool)
    tile, best, cost = np.zeros((len(x), len(x)), dtype=np.float32), dim, float(dim)
    for kept in range(4, dim - 1, 4):
        tile += y[:, kept - 4 : kept] @ y[:, kept - 4 : kept].T
        rest = np.sqrt(np.maximum(1 - np.einsum("ij,ij->i", y[:, :kept], y[:, :kept]), 0))
        now = kept + 1 + RECOMPUTED * float((tile + np.outer(rest, rest) >= least - LOOSE)[other].mean())
        if now < cost:
            best, cost = kept, now
    return (np.ascontiguousarray(turn[:, :best]) if best < dim else None), float((y @ y.T >= least)[other].mean())


def _pack(dim: int, turn: np.ndarray | None = None):
    if dim * 127 * 127 >= 1 << 24:
        raise ValueError(f"products of {dim} codes don't fit whole numbers of float32")
    weight = weights(dim, turn)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, held, n = [], [], 0
        here, written = TaskContext.get(), 0

        def out() -> pa.RecordBatch:
            nonlocal written
            number = written * ((1 << 20) + 1) + (here.partitionId() if here else 0)
            written += 1
            given = np.concatenate(held)
            x = unit(given) if turn is None else outline(unit(given), turn)
            codes, scale = quantise(x / weight)
            errors = np.linalg.norm(x - codes * scale * weight, axis=1).astype(np.float32)
            cells = [pa.array([list(ids)], pa.list_(pa.string())), *[pa.array([v], t) for v, t in ((codes.tobytes(), pa.binary()), (scale, pa.float64()), (errors.tobytes(), pa.binary()), (given.tobytes(), pa.binary()), (number, pa.int64()))]]
            return pa.RecordBatch.from_arrays(cells, names=["ids", "codes", "scale", "errors", "exact", "block"])

        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, BLOCK - n)
                at += part.num_rows
                x = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float32)
                ids += part.column(0).to_pylist()
                held.append(x)
                n += len(x)
                if n == BLOCK:
                    yield out()
                    ids, held, n = [], [], 0
        if n:
            yield out()

    return run


class Heaps:
    """The k best (cosine, id) of every row, best first; ties by id."""

    def __init__(self, rows: int, k: int) -> None:
        self.k = k
        self.cos = np.full((rows, k), -np.inf)
        self.at = np.full((rows, k), -1, dtype=np.int64)
        self.names: list[str] = []

    def floor(self) -> np.ndarray:
        return self.cos[:, -1]

    def merge(self, rows: np.ndarray, cos: np.ndarray, ids: list[str], cols: np.ndarray) -> None:
        if not len(rows):
            return
        base = len(self.names)
        used, inverse = np.unique(cols, return_inverse=True)
        self.names += [ids[c] for c in used]
        touched, where = np.unique(rows, return_inverse=True)
        r = np.concatenate([np.repeat(np.arange(len(touched)), self.k), where])
        c = np.concatenate([self.cos[touched].ravel(), cos])
        a = np.concatenate([self.at[touched].ravel(), base + inverse])
        order = np.lexsort((-c, r))
        r, c, a = r[order], c[order], a[order]
        start = np.searchsorted(r, np.arange(len(touched)))
        rank = np.arange(len(r)) - start[r]
        # equal cosines at the k-th place: the smaller id stays
        edge = start + self.k - 1
        kth = c[edge]
        tied = (c == kth[r]) & np.isfinite(c)
        over = np.bincount(r[tied], minlength=len(touched)) + np.bincount(r[(c > kth[r])], minlength=len(touched)) > self.k
        keep = rank < self.k
        for t in np.flatnonzero(over):
            mine = np.flatnonzero((r == t) & (c >= kth[t]))
            mine = sorted(mine, key=lambda i: (-c[i], self.names[a[i]]))[: self.k]
            keep[start[t] : start[t + 1] if t + 1 < len(touched) else len(r)] = False
            keep[mine] = True
        self.cos[touched] = c[keep].reshape(-1, self.k)
        self.at[touched] = a[keep].reshape(-1, self.k)
        if len(self.names) > 4 * self.at.size + 100_000:
            live, back = np.unique(self.at, return_inverse=True)
            self.names = [self.names[i] if i >= 0 else "" for i in live]
            self.at = np.where(self.at >= 0, back.reshape(self.at.shape), -1)


def places(flags: np.ndarray) -> np.ndarray:
    """Flat positions of the few true flags: words of eight are looked at first."""
    if flags.size % 8:
        return np.flatnonzero(flags)
    flat = flags.reshape(-1)
    some = np.flatnonzero(flat.view(np.uint64) != 0)
    word, place = np.nonzero(flat.reshape(-1, 8)[some])
    return some[word] * 8 + place


def ahead(a: int, b: int) -> bool:
    """Whether block a multiplies block b, where each pair of blocks is multiplied once: like the white
    squares of a board on one side of its diagonal and the black ones on the other, half of each row."""
    return (a < b) == ((a + b) % 2 == 0)


def _search(folder: str, k: int, dim: int, least: float, turn: np.ndarray | None = None, once: bool = False):
    """once: a pair of blocks is multiplied once; every list then comes in parts, each of its k best."""
    weight = (weights(dim, turn) ** 2).astype(np.float32)
    wide, strip = len(weight), STRIP if turn is None else STRIP // 4  # short products: a tile that stays in the cache

    def blocks():
        """(ids, codes, scale, errors, block, exact) of all written blocks, one at a time; exact reads when called."""
        import pyarrow.parquet as pq
        from pyarrow import fs

        where, path = fs.FileSystem.from_uri(folder)
        for file in where.get_file_info(fs.FileSelector(path)):
            if not file.base_name.startswith(("_", ".")) and file.is_file:
                table = pq.ParquetFile(where.open_input_file(file.path))
                for group in range(table.num_row_groups):
                    rows = table.read_row_group(group, columns=["ids", "codes", "scale", "errors", "block"]).combine_chunks()
                    for i in range(len(rows)):
                        cells = [rows.column(j)[i] for j in range(5)]
                        yield *cells, lambda g=group, i=i, t=table: t.read_row_group(g, columns=["exact"]).column(0)[i]

    def numbers(cell, kind) -> np.ndarray:
        return np.frombuffer(cell.as_buffer(), dtype=kind)

    def lists(heaps: Heaps, ids: list[str], part: slice) -> pa.RecordBatch:
        row, rank = np.nonzero(heaps.at[part] >= 0)
        return pa.RecordBatch.from_arrays([pa.array([ids[part.start + r] for r in row], pa.string()), pa.array([heaps.names[i] for i in heaps.at[part][row, rank]], pa.string()), pa.array(heaps.cos[part][row, rank]), pa.array((rank + 1).astype(np.int32))], names=["id", "neighbour", "cosine", "rank"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, parts, own = [], [], {}
        for batch in batches:
            for i in range(batch.num_rows):
                own[batch.column(5)[i].as_py()] = len(ids)
                ids += batch.column(0)[i].as_py()
                codes, errors = numbers(batch.column(1)[i], np.int8).reshape(-1, wide), numbers(batch.column(3)[i], np.float32)
                parts.append((codes * weight, np.full(len(codes), batch.column(2)[i].as_py()), errors, unit(numbers(batch.column(4)[i], np.float32).reshape(-1, dim))))
        if not ids:
            return
        ends = [*list(own.values())[1:], len(ids)]
        codes, scale, error, x = (np.concatenate([p[j] for p in parts]) for j in range(4))
        heaps = Heaps(len(x), k)
        buffer, flags = np.empty(strip * BLOCK, dtype=np.float32), np.empty(strip * BLOCK, dtype=bool)
        held: list[pa.RecordBatch] = []
        found: list[tuple[np.ndarray, ...]] = []

        def shared(theirs: Heaps | None, found: list, names: list[str], size: int) -> Heaps | None:
            """Moves the pairs found with a block to the lists here and to those of the block."""
            if found:
                r, c, cos, both = (np.concatenate(f) for f in zip(*found, strict=True))
                found.clear()
                good = cos >= heaps.floor()[r]
                heaps.merge(r[good], cos[good], names, c[good])
                if both.any():
                    theirs = theirs or Heaps(size, k)
                    good = both & (cos >= theirs.floor()[c])
                    theirs.merge(c[good], cos[good], ids, r[good])
            return theirs

        for other, coded, scaled, errors, block, exact in blocks():
            number = block.as_py()
            # (first row, end, whether the block's own lists get the pairs too)
            todo = [(start, end, a != number) for (a, start), end in zip(own.items(), ends, strict=True) if a == number or ahead(a, number)] if once else [(0, len(x), False)]
            if not todo:
                continue
            z, step, e = numbers(coded, np.int8).reshape(-1, wide).astype(np.float32), scaled.as_py(), float(numbers(errors, np.float32).max())
            names, y, theirs = other.as_py(), None, None
            for at, end, both in ((i, min(i + strip, end), both) for start, end, both in todo for i in range(start, end, strip)):
                part = slice(at, end)
                tile = np.matmul(codes[part], z.T, out=buffer[: (end - at) * len(z)].reshape(-1, len(z)))
                if number in own:
                    j = np.arange(max(at, own[number]), min(end, own[number] + len(z)))
                    tile[j - at, j - own[number]] = -np.inf
                steps = scale[part] * step
                bound = error[part] * (1 + e) + e + 1e-6  # |x.y - x'.y'| <= |x-x'||y| + |x'||y-y'|
                floor = np.full(end - at, -np.inf) if once else heaps.floor()[part].copy()  # where both get a pair, it may be of use to one of them
                if turn is None and not once and len(names) > k and len(unset := np.flatnonzero(~np.isfinite(floor))):  # the tile's own k-th best gives a floor
                    floor[unset] = np.partition(tile[unset], -k, axis=1)[:, -k] * steps[unset] - bound[unset]
                whole = np.maximum(np.floor((np.maximum(floor, least) - bound) / steps), -(2.0**24)).astype(np.float32)
                passed = np.greater_equal(tile, whole.min() if once else whole[:, None], out=flags[: tile.size].reshape(tile.shape))  # one number is compared twice as fast
                rows, cols = np.divmod(places(passed), len(z))
                if len(rows) and y is None:
                    y = unit(numbers(exact(), np.float32).reshape(-1, dim))
                for lot in range(0, len(rows), 200_000):
                    r, c = rows[lot : lot + 200_000], cols[lot : lot + 200_000]
                    cos = np.einsum("ij,ij->i", x[part][r], y[c])
                    good = cos >= np.maximum(heaps.floor()[part][r], least)
                    if not once:
                        heaps.merge(at + r[good], cos[good], names, c[good])
                        continue
                    good |= both & (cos >= least)
                    found.append((at + r[good], c[good], cos[good], np.full(np.count_nonzero(good), both)))
                    if sum(len(f[0]) for f in found) > 200_000:
                        theirs = shared(theirs, found, names, len(z))
            theirs = shared(theirs, found, names, len(z))
            if theirs:
                held.append(lists(theirs, names, slice(0, len(z))))
                if sum(len(b) for b in held) > 50_000:
                    yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                    held = []
        if held:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        for at in range(0, len(x), BLOCK):
            yield lists(heaps, ids, slice(at, at + BLOCK))

    return run


def nearest(vectors: DataFrame, k: int = 10, dim: int = 96, least: float = -2.0) -> DataFrame:
    """vectors(id, v), ids distinct -> (id, neighbour, cosine, rank 1..k): for every vector the k others
    of largest cosine (at least `least`), all rows against all rows, in blocks. Ties: the smaller id.

    Fewer than k+1 vectors give shorter lists; no vectors, no rows. Equal vectors are neighbours with
    cosine 1 like any others.
    """
    spark = vectors.sparkSession
    vectors = materialise(vectors, "vectors")
    n = vectors.count()
    files = max(1, -(-n // BLOCK))
    spread = vectors.repartition(files, F.xxhash64("id"))
    turn, once = None, False
    if least > 0 and n > BLOCK:
        some = vectors.where(F.pmod(F.xxhash64("id"), F.lit(max(1, n // FITTED))) == 0).limit(2 * FITTED).select("v").toArrow()
        if some.num_rows > 1:
            turn, share = fit_outline(some.column(0).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim), least)
            once = share * n < 4 * k  # else the parts of the lists would outgrow the lists
    folder = write_shared(spread.mapInArrow(_pack(dim, turn), _BLOCK), "blocks")
    blocks = spark.read.schema(_BLOCK).parquet(folder)
    tasks = max(-(-n // QUERIES), min(files, 4 * parallelism(spark)))
    queries = blocks.repartition(tasks)
    lists = queries.mapInArrow(_search(folder, k, dim, least, turn, once), "id string, neighbour string, cosine double, rank int")
    if once:
        lists = lists.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("cosine"), "neighbour"))).where(F.col("rank") <= k)
    return lists


def mutual(lists: DataFrame, least: float) -> DataFrame:
    """(id_1, id_2, cosine), id_1 < id_2: pairs that are in each other's list, with at least this cosine."""
    near = lists.where(F.col("cosine") >= least).select(F.least("id", "neighbour").alias("id_1"), F.greatest("id", "neighbour").alias("id_2"), "cosine")
    return near.groupBy("id_1", "id_2").agg(F.count(F.lit(1)).alias("n"), F.max("cosine").alias("cosine")).where("n = 2").drop("n")


def newest_vectors(df: DataFrame, key: str, order: str, vector: str, dim: int) -> DataFrame:
    """The usable vectors of the newest rows; a key whose newest vector is unusable has none."""
    return usable(latest(df, [key], [order], [vector]), key, vector, dim)
