"""Percentiles of very large numeric columns: dyadic Count-sketches, merged by addition.

A value is encoded as an order-preserving integer of ``bits`` bits. For every binary resolution, the counts of the codes'
prefixes are kept: exactly where a resolution has few prefixes, else in a signed Count-sketch of ``depth`` rows by
``width`` cells. Sketches are tables (keys..., cell, weight); adding weights merges them, negative weights delete. A rank
is inverted by descending from the coarsest resolution.

A key with no more codes than a sketch has cells keeps the codes themselves, as negative cells (code - 2 ** bits), which
lose nothing: no sketch is larger than its data, and none larger than ``Dyadic.cells``. A merge that brings a key beyond
that turns its codes into updates of a sketch.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Dyadic:
    """Shape of a sketch. ``octaves``: magnitudes up to 2 ** octaves are told apart, larger ones count as the largest."""

    bits: int = 20
    octaves: int = 64
    depth: int = 3
    width: int = 512
    seed: int = 11

    @property
    def per_octave(self) -> float:
        return 2 ** (self.bits - 1) / self.octaves

    @property
    def relative_error(self) -> float:
        """Of 1 + |value|: half the width of a code's interval."""
        return 2 ** (0.5 / self.per_octave) - 1

    def exact(self, level: int) -> bool:
        return 2 ** (self.bits - level) <= self.depth * self.width

    def layout(self) -> list[tuple[int, int]]:
        """(level, its first cell), level 0 the finest; the single prefix of level ``bits`` is the total count."""
        out, base = [], 0
        for level in range(self.bits, -1, -1):
            out.append((level, base))
            base += 2 ** (self.bits - level) if self.exact(level) else self.depth * self.width
        return out

    @property
    def cells(self) -> int:
        level, base = self.layout()[-1]
        return base + (2 ** (self.bits - level) if self.exact(level) else self.depth * self.width)

    def encode(self, value: Column) -> Column:
        half = 2 ** (self.bits - 1)
        size = F.least(F.floor(F.log2(F.abs(value) + 1) * self.per_octave), F.lit(half - 1)).cast("int")
        return F.when(value < 0, half - 1 - size).otherwise(half + size)

    def decode(self, code: np.ndarray) -> np.ndarray:
        half = 2 ** (self.bits - 1)
        size = np.where(code >= half, code - half, half - 1 - code)
        middle = np.where(size > 0, 2 ** ((size + 0.5) / self.per_octave) - 1, 0.0)
        return np.where(code >= half, middle, -middle)


def _factor(level: int, row: int, seed: int) -> int:
    return (2 * (seed + 31 * level + 977 * row) + 1) * 2654435761 % 2**31


def _hash(x: np.ndarray | int, level: int, row: int, seed: int):
    """A 31-bit mix of a prefix, the same in numpy and in SQL (kept below 2 ** 63 throughout)."""
    a = _factor(level, row, seed)
    y = (x * a + 374761393 * (row + 1)) % 2**31
    y = (y ^ (y >> 15)) * 73244475 % 2**31
    return y ^ (y >> 13)


def build(df: DataFrame, keys: Sequence[str], value: str, *, weight: Column | None = None, shape: Dyadic = Dyadic(), most: int | None = None) -> DataFrame:
    """The sketches of ``value`` per key. A row adds ``weight`` (default 1; -1 deletes an earlier row).

    Rows are first reduced to one per key and code, before and after the shuffle, so the sketch updates are bounded by
    codes, not rows. Null keys, null and NaN values do not count; infinities count as the largest magnitude.
    ``most``: with how many codes a key still keeps them, by default as many as a sketch has cells.
    """
    named = [F.col(k) for k in keys]
    rows = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    for k in named:
        rows = rows.where(k.isNotNull())
    cell = (shape.encode(F.col(value).cast("double")) - F.lit(2**shape.bits)).cast("int").alias("cell")
    codes = rows.groupBy(*keys, cell).agg(F.sum(weight if weight is not None else F.lit(1)).cast("long").alias("weight"))
    return _fitted(codes.where("weight != 0"), shape, most)


def merge(*sketches: DataFrame, shape: Dyadic = Dyadic(), most: int | None = None) -> DataFrame:
    """Sketches of one shape added up: of other days, files or partitions."""
    together = reduce(DataFrame.unionByName, sketches)
    keys = [c for c in together.columns if c not in ("cell", "weight")]
    return _fitted(together.groupBy(*keys, "cell").agg(F.sum("weight").alias("weight")).where("weight != 0"), shape, most)


def _fitted(cells: DataFrame, shape: Dyadic, most: int | None) -> DataFrame:
    """Keys with more codes than ``most``, or with codes beside a sketch, have their codes turned into sketch updates."""
    keys = [c for c in cells.columns if c not in ("cell", "weight")]
    # weights of a key are few, whatever its data: at most as many as there are codes
    codes = F.count(F.when(F.col("cell") < 0, 1))
    large = cells.groupBy(*keys).agg(codes.alias("_codes"), F.count(F.lit(1)).alias("_all")).where((F.col("_codes") > (shape.cells if most is None else most)) | ((F.col("_codes") > 0) & (F.col("_codes") < F.col("_all"))))
    marked = cells.join(large.select(*keys, F.lit(True).alias("_large")), keys, "left")
    # a code's updates, as rows: where a level begins, and what its hash is made with (nothing where it is exact)
    updates = [(level, base, 0, 0) for level, base in shape.layout() if shape.exact(level)]
    updates += [(level, base + row * shape.width, _factor(level, row, shape.seed), row + 1) for level, base in shape.layout() if not shape.exact(level) for row in range(shape.depth)]
    row_of = lambda u: F.struct(F.lit(u[0]).alias("_level"), F.lit(u[1]).alias("_base"), F.lit(u[2]).cast("long").alias("_a"), F.lit(u[3]).cast("long").alias("_r"))
    turned = F.coalesce(F.col("_large") & (F.col("cell") < 0), F.lit(False))
    rows = marked.select(*keys, F.col("cell").alias("_cell"), F.col("weight").alias("_w"), F.inline(F.when(turned, F.array(*map(row_of, updates))).otherwise(F.array(row_of((-1, 0, 0, 0))))))
    mask = f"{2**31 - 1}L"
    rows = rows.withColumn("_prefix", F.expr(f"CASE WHEN _level < 0 THEN _cell ELSE shiftright(_cell + {2**shape.bits}, _level) END")).withColumn("_y", F.expr(f"(_prefix * _a + 374761393L * _r) & {mask}"))
    rows = rows.withColumn("_y", F.expr(f"((_y ^ shiftright(_y, 15)) * 73244475L) & {mask}")).withColumn("_y", F.expr("_y ^ shiftright(_y, 13)"))
    rows = rows.select(
        *keys, F.expr(f"CAST(_base + CASE WHEN _r = 0 THEN _prefix ELSE _y % {shape.width} END AS INT)").alias("cell"),
        F.expr("CASE WHEN _r = 0 THEN _w ELSE _w * (1 - 2 * (shiftright(_y, 20) & 1L)) END").alias("weight"),
    )
    return rows.groupBy(*keys, "cell").agg(F.sum("weight").alias("weight")).where("weight != 0")


def _of_codes(code: np.ndarray, weight: np.ndarray, starts: np.ndarray, qs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts and percentile codes of keys that keep their codes, all keys at once: codes rise within each key."""
    weight = np.maximum(weight, 0)
    run = np.cumsum(weight)
    ends = np.concatenate([starts[1:], [len(code)]])
    base = np.where(starts > 0, run[starts - 1], 0)
    n = run[ends - 1] - base
    rank = np.floor(qs[None, :] * np.maximum(n - 1, 0)[:, None]).astype(np.int64)
    return n, code[np.minimum(np.searchsorted(run, base[:, None] + rank, "right"), len(code) - 1)]


def _of_sketches(cells: np.ndarray, qs: np.ndarray, shape: Dyadic) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts, percentile codes and rank errors of sketches (one a row), descending all keys and percentiles together."""
    key = np.arange(len(cells))[:, None]
    n = cells[:, 0]
    rank = np.floor(qs[None, :] * np.maximum(n - 1, 0)[:, None])
    prefix, held = np.zeros(rank.shape, np.int64), np.repeat(n[:, None].astype(float), len(qs), 1)

    def count(p: np.ndarray, level: int, base: int) -> np.ndarray:
        if shape.exact(level):
            return cells[key, base + p].astype(float)
        seen = []
        for row in range(shape.depth):
            h = _hash(p, level, row, shape.seed)
            seen.append(cells[key, base + row * shape.width + h % shape.width] * (1 - 2 * ((h >> 20) & 1)))
        return np.median(np.stack(seen), axis=0)

    variance = np.zeros(len(cells))
    for level, base in shape.layout()[1:]:
        first, second = count(2 * prefix, level, base), count(2 * prefix + 1, level, base)
        if shape.exact(level):
            low = first
        else:
            # the parent's count is known, so both children's estimates tell of the first one
            low = np.clip((first + held - second) / 2, 0.0, held)
            table = cells[:, base : base + shape.depth * shape.width].reshape(len(cells), shape.depth, -1).astype(float)
            variance += np.median((table**2).sum(2), axis=1) / shape.width / 2
        left = rank < low
        prefix, rank, held = 2 * prefix + ~left, np.where(left, rank, rank - low), np.where(left, low, held - low)
    return n, prefix, 3 * np.sqrt(variance) / np.maximum(n, 1)


#: How many dense sketches are inverted together.
TOGETHER = 32


def percentiles(sketches: DataFrame, probabilities: dict[str, float], shape: Dyadic = Dyadic()) -> DataFrame:
    """Per key: n, the named percentiles, and their bounds.

    ``rank_error``: the share of rows by which a percentile's rank may be off, three standard deviations of the sketched
    levels' estimates (from the sketch's own second moments); 0 where the key keeps its codes. ``value_error``: the
    relative error of 1 + |value| that the encoding adds. A key whose count is not above 0, all of it deleted, gives no
    row. Keys come sorted and are taken as they stream by; a task holds one Arrow batch and one key's sketch beyond it.
    """
    keys = [f for f in sketches.schema.fields if f.name not in ("cell", "weight")]
    names = [k.name for k in keys]
    placed = sketches.repartition(*names).sortWithinPartitions(*names, "cell")
    out = T.StructType(
        [*keys, T.StructField("n", T.LongType()), *[T.StructField(p, T.DoubleType()) for p in probabilities], T.StructField("rank_error", T.DoubleType()), T.StructField("value_error", T.DoubleType())]
    )
    qs = np.array(list(probabilities.values()))

    def inverted(table: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        cell, weight = table.column("cell").to_numpy(), table.column("weight").to_numpy()
        ends = np.concatenate([starts[1:], [len(cell)]])
        dense = cell[ends - 1] >= 0
        n, error = np.zeros(len(starts), np.int64), np.zeros(len(starts))
        code = np.zeros((len(starts), len(qs)), np.int64)
        if not dense.all():
            rows = np.repeat(~dense, ends - starts)
            firsts = np.cumsum(np.concatenate([[0], (ends - starts)[~dense]]))[:-1]
            n[~dense], code[~dense] = _of_codes(cell[rows] + 2**shape.bits, weight[rows], firsts, qs)
        large = np.flatnonzero(dense)
        for i in range(0, len(large), TOGETHER):
            some = large[i : i + TOGETHER]
            cells = np.zeros((len(some), shape.cells), np.int64)
            for j, k in enumerate(some):
                cells[j, cell[starts[k] : ends[k]]] = weight[starts[k] : ends[k]]
            n[some], code[some], error[some] = _of_sketches(cells, qs, shape)
        kept = np.flatnonzero(n > 0)
        values = shape.decode(code[kept])
        arrays = [table.column(k).take(pa.array(starts[kept])).combine_chunks() for k in names] + [pa.array(n[kept])]
        arrays += [pa.array(values[:, j]) for j in range(len(qs))] + [pa.array(error[kept]), pa.array(np.full(len(kept), shape.relative_error))]
        return pa.RecordBatch.from_arrays(arrays, names=out.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried: list[pa.Table] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.concat_tables([*carried, pa.Table.from_batches([batch])]).combine_chunks()
            changed = np.zeros(table.num_rows - 1, bool)
            for k in names:
                c = table.column(k).combine_chunks()
                changed |= pa.compute.not_equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False)
            starts = np.concatenate([[0], np.flatnonzero(changed) + 1])
            carried = [table.slice(starts[-1])]
            if len(starts) > 1:
                yield inverted(table.slice(0, starts[-1]), starts[:-1])
        if carried:
            yield inverted(carried[0], np.zeros(1, np.int64))

    return placed.mapInArrow(run, out)
