"""The most similar vectors of every vector, by collision counting over sorted projections.

Vectors are scaled to unit length. Each of several tables cuts the space into cells by windows over a few random
projections; inside a cell each vector looks at all others. Over a further set of projections the collisions are
counted, in windows of two widths centred on the vector: a pair that collides often enough in the narrow and in the wide
ones is a candidate, and only candidates are verified by their cosine. How many projections cut a cell, and how many
tables there are, follows from the number of vectors and the similarity asked for, so that at most MISS of the pairs at
that similarity never meet, at any size. Cells of more than CROWD vectors (counted over every EVERY-th vector, by hash) are
dealt out to salted blocks, and each pair of blocks is one task's group, in which the most similar of each vector are
found exactly; nothing in such a cell is lost.

Equal directions are one class from the start, so copies cost nothing: classes are compared, and a class gives its
members with the smallest hashes to its neighbours' lists, which is all a list of k needs. The cells' rows carry a
class number and 16 bytes, in crowded cells the vector; else vectors are shuffled once, for verifying.

Defined results: vectors that are null, of another length, all zero, or with NaN, infinite or null values take no part,
nor do rows without hash or model; repeated rows count once; of equal similarities the smaller hash comes first (own
copies before others); other columns are ignored. Pairs come out once, with hash_a < hash_b.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marginalia.llm.words import mix, slices

#: Width of the windows that cut cells, for unit vectors.
WIDTH = 2.2
STEP = 0.4
#: Windows, in steps of STEP that a projection is kept in, and in how many of COUNTED projections a pair must collide.
NARROW, WIDE = 1, 2
COUNTED = 32
LEAST_NARROW, LEAST_WIDE = 20, 28
#: Pairs whose projections are farther apart, in all, than those of all but very few pairs at the similarity asked for
#: aren't counted: this many standard deviations above the mean of the sum of squared steps.
SPREAD = 3.5
#: Vectors a cell should hold, and the share of pairs at the similarity asked for that may never meet in a cell.
CELL = 1024
MISS = 0.045
#: A cell is crowded if it holds more than CROWD vectors, by a count over one vector in EVERY; it gets one block for each
#: BLOCK of them. There is at most one such cell for each CROWD places, which bounds what is broadcast.
EVERY = 8
CROWD = 16384
BLOCK = 8192
#: Vectors of a block that are compared at once with the other block, and candidates kept beyond k for rounding.
AT_ONCE = 1024
SPARE = 6
ROUNDING = 1e-4
ROWS_AT_ONCE = 50_000
SEED = 20240229

_CELLS = "cell BIGINT, place FLOAT, class BIGINT, sketch BINARY"


def collision_share(distance: float, width: float) -> float:
    """The chance that two vectors at a distance fall into one window of a random projection."""
    t = width / distance
    tail = 0.5 * math.erfc(t / math.sqrt(2))
    return 1 - 2 * tail - 2 / (math.sqrt(2 * math.pi) * t) * (1 - math.exp(-t * t / 2))


def layout(n: int, similarity: float = 0.90, miss: float = MISS) -> tuple[int, int]:
    """Projections that cut a cell, and tables, for n vectors."""
    near = collision_share(math.sqrt(2 - 2 * similarity), WIDTH)
    far = collision_share(math.sqrt(2), WIDTH)
    cuts = max(2, math.ceil(math.log(max(n, 1) / CELL) / math.log(1 / far)))
    return cuts, math.ceil(math.log(1 / miss) / -math.log(1 - near**cuts))


def _directions(batch: pd.DataFrame, size: int) -> tuple[pd.DataFrame, np.ndarray, np.ndarray]:
    """The rows that take part, their unit vectors, and their classes: the same for equal directions of one model."""
    fits = batch["vector"].map(lambda v: v is not None and len(v) == size)
    rows = batch[fits & batch["content_hash"].notna() & batch["model_version"].notna()]
    raw = np.array(rows["vector"].tolist(), np.float64).reshape(len(rows), size)
    norm = np.sqrt((raw * raw).sum(axis=1))
    good = np.isfinite(norm) & (norm > 0)
    rows, unit = rows[good], raw[good] / norm[good][:, None]
    grid = np.round(unit * 1e5).astype(np.int32)
    models = rows["model_version"].tolist()
    classes = np.array([xxhash.xxh64_intdigest(m.encode() + g.tobytes()) for m, g in zip(models, grid, strict=True)], np.uint64).view(np.int64)
    return rows, unit.astype(np.float32), classes


def members(vectors: DataFrame, size: int) -> DataFrame:
    """class, model_version, content_hash of the vectors that take part, each once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows, _, classes = _directions(batch, size)
            yield pd.DataFrame({"class": classes, "model_version": rows["model_version"], "content_hash": rows["content_hash"]})

    return vectors.mapInPandas(run, "class BIGINT, model_version STRING, content_hash STRING").distinct()


def units(vectors: DataFrame, size: int) -> DataFrame:
    """class, unit: the direction of each class, as 4-byte numbers."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            _, unit, classes = _directions(batch, size)
            _, once = np.unique(classes, return_index=True)
            yield pd.DataFrame({"class": classes[once], "unit": [unit[i].tobytes() for i in once]})

    return vectors.mapInPandas(run, "class BIGINT, unit BINARY").groupBy("class").agg(F.first("unit").alias("unit"))


class _Tables:
    """The random projections of all tables, the same in every process."""

    def __init__(self, size: int, cuts: int, tables: int) -> None:
        rng = np.random.default_rng(SEED)
        self.cuts, self.tables = cuts, tables
        self.counted = rng.standard_normal((size, COUNTED)).astype(np.float32)
        self.by_cell = rng.standard_normal((size, tables * cuts)).astype(np.float32)
        self.shift = rng.uniform(0, WIDTH, tables * cuts).astype(np.float32)
        self.salt = rng.integers(1, 1 << 62, size)

    def cells(self, units: np.ndarray, models: np.ndarray, crowded: list[np.ndarray]) -> np.ndarray:
        """The cell of each vector in each table; crowded cells are cut into their blocks."""
        steps = np.floor((units @ self.by_cell + self.shift) / WIDTH).astype(np.int64).reshape(len(units), self.tables, self.cuts)
        cell = np.broadcast_to(models[:, None], steps.shape[:2]).astype(np.uint64) + np.arange(self.tables, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for i in range(self.cuts):
            cell = mix(cell * np.uint64(31) + steps[:, :, i].view(np.uint64))
        row, table, block, _ = self.blocks(units, cell, crowded)
        cell[row, table] = mix(cell[row, table] * np.uint64(31) + block)
        return cell

    def blocks(self, units: np.ndarray, cell: np.ndarray, crowded: list[np.ndarray]) -> tuple[np.ndarray, ...]:
        """Row, table, block and number of blocks of each place in a crowded cell. crowded: cells in order, and blocks of each."""
        if not crowded:
            none = np.zeros(0, np.int64)
            return none, none, none.view(np.uint64), none
        hot, number = crowded
        at = np.minimum(np.searchsorted(hot, cell), len(hot) - 1)
        row, table = np.nonzero(hot[at] == cell)
        number = number[at[row, table]]
        salt = mix((np.round(units * 1e5).astype(np.int64) @ self.salt).view(np.uint64))
        return row, table, salt[row] % number.astype(np.uint64), number

    def sketches(self, units: np.ndarray) -> np.ndarray:
        """The counted projections in steps, two to a byte."""
        steps = np.clip(np.floor(units @ self.counted / STEP) + 8, 0, 15).astype(np.uint8)
        return steps[:, ::2] | (steps[:, 1::2] << 4)


def _model_numbers(models: pd.Series) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(m.encode()) for m in models], np.uint64)


def crowded_cells(vectors: DataFrame, size: int, tables: _Tables) -> list[np.ndarray]:
    """Cells that hold more than CROWD of the vectors, in order, and the blocks of each."""
    sent = vectors.sparkSession.sparkContext.broadcast(tables)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows, unit, _ = _directions(batch, size)
            cell, count = np.unique(sent.value.cells(unit, _model_numbers(rows["model_version"]), []), return_counts=True)
            yield pd.DataFrame({"cell": cell.view(np.int64), "n": count})

    some = vectors.where(F.pmod(F.xxhash64("content_hash"), F.lit(EVERY)) == 0)
    # A text that is delivered again and again has one direction, and counts once in a cell.
    once = some.dropDuplicates(["model_version", "content_hash"])
    counts = once.mapInPandas(run, "cell BIGINT, n BIGINT").groupBy("cell").agg((F.sum("n") * EVERY).alias("n"))
    found = counts.where(F.col("n") > CROWD).toPandas()
    if not len(found):
        return []
    cell = found["cell"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(cell)
    return [cell[order], np.ceil(found["n"].to_numpy()[order] / BLOCK).astype(np.int64)]


def place_in_cells(vectors: DataFrame, size: int, tables: object) -> DataFrame:
    """_CELLS: a row for each class and table. tables: a broadcast of (_Tables, crowded cells).

    In a crowded cell a class has a row for each pair of blocks that its own is one of: with its vector, and with 0 or 1
    as the place, which tells the two blocks apart.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t, crowded = tables.value
        seen: set[int] = set()
        for batch in batches:
            rows, unit, classes = _directions(batch, size)
            _, once = np.unique(classes, return_index=True)
            once = once[[c not in seen for c in classes[once].tolist()]] if seen else once
            if len(seen) < 1_000_000:
                seen.update(classes[once].tolist())
            if not len(once):
                continue
            unit, classes = unit[once], classes[once]
            cell = t.cells(unit, _model_numbers(rows["model_version"].iloc[once]), [])
            row, table, block, number = t.blocks(unit, cell, crowded)
            sparse = np.ones(cell.shape, bool)
            sparse[row, table] = False
            sketch = [x.tobytes() for x in t.sketches(unit)]
            yield pd.DataFrame(
                {
                    "cell": cell[sparse].view(np.int64),
                    "place": np.zeros(sparse.sum(), np.float32),
                    "class": np.repeat(classes, sparse.sum(axis=1)),
                    "sketch": [sketch[i] for i in np.nonzero(sparse)[0].tolist()],
                }
            )
            # A slice of places at a time, as each has as many rows as its cell has blocks.
            for a, b in slices(number.tolist(), ROWS_AT_ONCE):
                of = np.repeat(np.arange(a, b), number[a:b])
                own = block[of]
                other = (np.arange(len(of)) - np.repeat(np.cumsum(number[a:b]) - number[a:b], number[a:b])).astype(np.uint64)
                pair = mix(cell[row[of], table[of]] * np.uint64(31) + np.minimum(own, other))
                yield pd.DataFrame(
                    {
                        "cell": mix(pair * np.uint64(31) + np.maximum(own, other)).view(np.int64),
                        "place": (own > other).astype(np.float32),
                        "class": classes[row[of]],
                        "sketch": [unit[i].tobytes() for i in row[of].tolist()],
                    }
                )

    return vectors.mapInPandas(run, _CELLS)


def _steps(sketch: pd.Series) -> np.ndarray:
    packed = np.frombuffer(b"".join(sketch), np.uint8).reshape(len(sketch), -1)
    out = np.empty((len(sketch), packed.shape[1] * 2), np.int8)
    out[:, ::2], out[:, 1::2] = packed & 15, packed >> 4
    return out


def colliding(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs of rows collide in enough projections, in windows of both widths."""
    apart = np.abs(a - b)
    return ((apart <= WIDE).sum(axis=1) >= LEAST_WIDE) & ((apart <= NARROW).sum(axis=1) >= LEAST_NARROW)


def most_similar(own: np.ndarray, others: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of pairs: for each of own, the k + SPARE most similar others at a cosine of at least `least`, up to rounding."""
    found_a, found_b = [], []
    for start in range(0, len(own), AT_ONCE):
        cosine = own[start : start + AT_ONCE] @ others.T
        if cosine.shape[1] > k + SPARE:
            best = np.argpartition(cosine, -(k + SPARE), axis=1)[:, -(k + SPARE) :]
        else:
            best = np.broadcast_to(np.arange(cosine.shape[1]), cosine.shape)
        row, nth = np.nonzero(np.take_along_axis(cosine, best, 1) >= least - ROUNDING)
        found_a.append(row + start)
        found_b.append(best[row, nth])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *found_a]), np.concatenate([none, *found_b])


def compare_blocks(cell: pd.DataFrame, k: int, least: float) -> pd.DataFrame:
    """a, b: the most similar of each vector of a pair of blocks in the other block (or in the only one), exactly."""
    cell = cell.drop_duplicates("class")
    side, cls = cell["place"].to_numpy() > 0, cell["class"].to_numpy()
    unit = np.frombuffer(b"".join(cell["sketch"]), np.float32).reshape(len(cell), -1)
    if side.any():
        a, b = most_similar(unit[~side], unit[side], k, least)
        c, d = most_similar(unit[side], unit[~side], k, least)
        x, y = np.concatenate([cls[~side][a], cls[~side][d]]), np.concatenate([cls[side][b], cls[side][c]])
    else:
        # One more, as each finds itself.
        a, b = most_similar(unit, unit, k + 1, least)
        x, y = cls[a], cls[b]
    found = pd.DataFrame({"a": np.minimum(x, y), "b": np.maximum(x, y)})
    return found[found["a"] != found["b"]].drop_duplicates()


def farthest(least: float) -> float:
    """The sum of squared steps over all counted projections up to which collisions are counted."""
    mean = COUNTED * ((2 - 2 * least) / STEP**2 + 1 / 6)
    return mean * (1 + SPREAD * math.sqrt(2 / COUNTED))


def compare_cell(cell: pd.DataFrame, least: float) -> pd.DataFrame:
    """a, b: pairs of one cell that collide in enough projections; no more than AT_ONCE rows are compared with all at once."""
    cell = cell.drop_duplicates("class")
    cls, steps = cell["class"].to_numpy(), _steps(cell["sketch"])
    x = steps.astype(np.float32) - 7.5
    squares = (x * x).sum(axis=1)
    most, found_a, found_b = farthest(least), [], []
    for start in range(0, len(x) - 1, AT_ONCE):
        stop = min(start + AT_ONCE, len(x))
        apart = squares[start:stop, None] + squares[None, start:] - 2 * (x[start:stop] @ x[start:].T)
        row, other = np.nonzero(apart <= most)
        keep = other > row
        row, other = row[keep] + start, other[keep] + start
        near = colliding(steps[row], steps[other])
        found_a.append(cls[row[near]])
        found_b.append(cls[other[near]])
    none = np.zeros(0, np.int64)
    a, b = np.concatenate([none, *found_a]), np.concatenate([none, *found_b])
    return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})


def count_collisions(batches: Iterator[pd.DataFrame], k: int = 10, least: float = 0.90) -> Iterator[pd.DataFrame]:
    """a, b: pairs of one cell that collide in enough projections; of crowded cells the most similar pairs.

    Rows come sorted by cell. Memory: a batch and what came before of its last cell.
    """

    def compared(cell: pd.DataFrame) -> pd.DataFrame:
        return compare_blocks(cell, k, least) if len(cell["sketch"].iloc[0]) > COUNTED // 2 else compare_cell(cell, least)

    held: pd.DataFrame | None = None
    for batch in batches:
        held = batch if held is None else pd.concat([held, batch])
        starts = np.flatnonzero(np.diff(held["cell"].to_numpy(), prepend=held["cell"].iloc[0] ^ 1))
        done = [compared(held.iloc[a:b]) for a, b in zip(starts[:-1], starts[1:], strict=True) if b > a + 1]
        held = held.iloc[starts[-1] :]
        if done:
            yield pd.concat(done).drop_duplicates()
    if held is not None and len(held) > 1:
        yield compared(held)


def candidates(vectors: DataFrame, size: int, k: int = 10, least: float = 0.90) -> DataFrame:
    """a, b: pairs of classes to verify."""
    spark = vectors.sparkSession
    n = vectors.count()
    tables = _Tables(size, *layout(n, least))
    sent = spark.sparkContext.broadcast((tables, crowded_cells(vectors, size, tables)))
    cells = place_in_cells(vectors, size, sent).repartition("cell").sortWithinPartitions("cell", "place")
    return cells.mapInPandas(lambda batches: count_collisions(batches, k, least), "a BIGINT, b BIGINT").distinct()


def verified(vectors: DataFrame, pairs: DataFrame, size: int, least: float) -> DataFrame:
    """a, b, cosine of the pairs of classes that are similar enough, in both directions."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch[c]), np.float32).reshape(len(batch), size) for c in ("unit_a", "unit_b"))
            cosine = np.einsum("ij,ij->i", a, b, dtype=np.float64)
            near = cosine >= least
            x, y, c = batch["a"].to_numpy()[near], batch["b"].to_numpy()[near], cosine[near]
            yield pd.DataFrame({"a": np.concatenate([x, y]), "b": np.concatenate([y, x]), "cosine": np.concatenate([c, c])})

    unit = units(vectors, size)
    both = pairs.join(unit.select(F.col("class").alias("a"), F.col("unit").alias("unit_a")), "a").join(
        unit.select(F.col("class").alias("b"), F.col("unit").alias("unit_b")), "b"
    )
    return both.mapInPandas(run, "a BIGINT, b BIGINT, cosine DOUBLE")


def similar_pairs(vectors: DataFrame, k: int = 10, least: float = 0.90, size: int = 64) -> DataFrame:
    """model_version, hash_a, hash_b: one is among the k most similar of the other, at a cosine of at least `least`."""
    # Rows that can't take part are dropped before anything is read into Python.
    vectors = vectors.where((F.size("vector") == size) & F.col("content_hash").isNotNull() & F.col("model_version").isNotNull())
    vectors = vectors.select("content_hash", "model_version", "vector")
    close = verified(vectors, candidates(vectors, size, k, least), size, least)
    everyone = members(vectors, size)
    in_class = Window.partitionBy("class").orderBy("content_hash")
    first = everyone.withColumn("nth", F.row_number().over(in_class)).where(F.col("nth") <= k + 1)
    best = close.withColumn("nth", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("cosine"), "b"))).where(F.col("nth") <= k)
    others = best.select("a", F.col("b").alias("class"), "cosine").join(first.select("class", "content_hash"), "class").select(
        F.col("a").alias("class"), F.col("content_hash").alias("other"), "cosine", F.lit(1).alias("own")
    )
    copied = first.where("nth = 2").select("class")
    own = first.join(copied, "class", "left_semi").select("class", F.col("content_hash").alias("other"), F.lit(2.0).alias("cosine"), F.lit(0).alias("own"))
    order = Window.partitionBy("class").orderBy("own", F.desc("cosine"), "other")
    lists = (
        others.unionByName(own)
        .withColumn("nth", F.row_number().over(order))
        .where(F.col("nth") <= k + 1)
        .groupBy("class")
        .agg(F.array_sort(F.collect_list(F.struct("nth", "other"))).alias("list"))
    )
    rest = F.slice(F.filter(F.col("list.other"), lambda x: x != F.col("content_hash")), 1, k)
    return (
        everyone.join(lists, "class")
        .select("model_version", "content_hash", F.explode(rest).alias("other"))
        .select("model_version", F.least("content_hash", "other").alias("hash_a"), F.greatest("content_hash", "other").alias("hash_b"))
        .distinct()
    )
