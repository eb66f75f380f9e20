"""Rasters as blocks: square tiles of samples in array columns, neighbourhoods through an exchange of border strips.

A block is a row (scene_id, br, bc, height, width and one array<double> a band).
br and bc count blocks of ``size`` pixels a side, the last ones cut at the scene's
edge; height and width are the scene's.  A band is its block's samples, row by
row; null and NaN are missing samples.  Workers take few blocks at once, whatever
the scene's size, and only strips are sent to other blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEYS = ["scene_id", "br", "bc"]
#: Pixels a side of a block, where nothing else is asked for.
SIZE = 256
#: Pixels on each side of the neighbourhood.
REACH = 2


def to_blocks(pixels: DataFrame, bands: list[str], height: int, width: int, size: int = SIZE) -> DataFrame:
    """Blocks of pixel rows (scene_id, r, c and bands); pixels that no row names are NaN.  A group has size * size rows at most."""

    def gather(rows: pa.Table) -> pa.Table:
        r, c = (rows[x].to_numpy() for x in ("r", "c"))
        br, bc = int(r[0]) // size, int(c[0]) // size
        high, wide = min(size, height - br * size), min(size, width - bc * size)
        out = {"scene_id": rows["scene_id"].slice(0, 1), "br": pa.array([br], pa.int32()), "bc": pa.array([bc], pa.int32()), "height": pa.array([height], pa.int32()), "width": pa.array([width], pa.int32())}
        for b in bands:
            a = np.full((high, wide), np.nan)
            a[r - br * size, c - bc * size] = rows[b].cast(pa.float64()).to_numpy(zero_copy_only=False)
            out[b] = pa.ListArray.from_arrays(pa.array([0, a.size], pa.int32()), pa.array(a.ravel()))
        return pa.table(out)

    inside = pixels.select("scene_id", "r", "c", *bands).filter(F.col("r").between(0, height - 1) & F.col("c").between(0, width - 1))
    kind = pixels.schema["scene_id"].dataType.simpleString()
    placed = inside.groupBy("scene_id", F.floor(F.col("r") / size).alias("x"), F.floor(F.col("c") / size).alias("y"))
    return placed.applyInArrow(gather, f"scene_id {kind}, br int, bc int, height int, width int, {', '.join(f'{b} array<double>' for b in bands)}")


class Block:
    """One row of a block table in a worker: its place and its bands as arrays."""

    def __init__(self, row: dict, bands: list[str], size: int):
        self.scene, self.br, self.bc, self.height, self.width, self.size = row["scene_id"], row["br"], row["bc"], row["height"], row["width"], size
        self.top, self.left = self.br * size, self.bc * size
        self.high, self.wide = min(size, self.height - self.top), min(size, self.width - self.left)
        self.bands = {b: row[b].reshape(self.high, self.wide) for b in bands}
        self.halo = row.get("halo") or []
        self.more = row

    def neighbours(self) -> Iterator[tuple[int, int]]:
        """(dr, dc) to the blocks of this scene around this one."""
        for dr in (-1, 0, 1):
            for dc in (-1, 0, 1):
                if (dr or dc) and 0 <= self.top + dr * self.size < self.height and 0 <= self.left + dc * self.size < self.width:
                    yield dr, dc

    def strip(self, dr: int, dc: int, names: list[str], reach: int) -> bytes:
        """What the neighbour at (dr, dc) needs of this block."""
        rows = {-1: slice(0, reach), 0: slice(None), 1: slice(max(0, self.high - reach), None)}[dr]
        columns = {-1: slice(0, reach), 0: slice(None), 1: slice(max(0, self.wide - reach), None)}[dc]
        return np.stack([self.bands[b][rows, columns] for b in names]).astype("<f8").tobytes()

    def extended(self, names: list[str], reach: int) -> dict[str, np.ndarray]:
        """The bands with reach pixels more on each side: from the neighbours' strips, mirrored at the scene's edge with the edge itself repeated."""
        out = np.full((len(names), self.high + 2 * reach, self.wide + 2 * reach), np.nan)
        out[:, reach : reach + self.high, reach : reach + self.wide] = np.stack([self.bands[b] for b in names])
        spans = []
        for d, first, n, whole in ((0, self.top, self.high, self.height), (1, self.left, self.wide, self.width)):
            spans.append({-1: slice(reach - min(reach, first), reach), 0: slice(reach, reach + n), 1: slice(reach + n, reach + n + min(reach, whole - first - n))})
        for s in self.halo:
            part = out[:, spans[0][s["dr"]], spans[1][s["dc"]]]
            part[:] = np.frombuffer(s["data"], "<f8").reshape(part.shape)
        at = []
        for first, n, whole in ((self.top, self.high, self.height), (self.left, self.wide, self.width)):
            i = np.arange(first - reach, first + n + reach) % (2 * whole)
            at.append(np.where(i < whole, i, 2 * whole - 1 - i) - first + reach)
        return dict(zip(names, out[:, at[0][:, None], at[1][None, :]]))


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {n: _value(batch.column(j)[i]) for j, n in enumerate(batch.schema.names)}


def _value(x: pa.Scalar):
    numbers = isinstance(x, pa.ListScalar) and x.is_valid and pa.types.is_floating(x.type.value_type)
    return x.values.to_numpy(zero_copy_only=False) if numbers else x.as_py()


def with_halo(blocks: DataFrame, bands: list[str], size: int = SIZE, reach: int = REACH) -> DataFrame:
    """blocks with ``halo``: the border strips of the up to eight blocks around each, for Block.extended().

    Only strips are shuffled where blocks are already dealt out by scene_id, br, bc.
    """
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            b = Block(row, bands, size)
            to = list(b.neighbours())
            data = [b.strip(dr, dc, bands, reach) for dr, dc in to]
            columns = [[b.scene] * len(to), [b.br + dr for dr, _ in to], [b.bc + dc for _, dc in to], [-dr for dr, _ in to], [-dc for _, dc in to], data]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds)], ["scene_id", "br", "bc", "dr", "dc", "data"])

    scene = blocks.schema["scene_id"].dataType
    kinds = [pa.int64() if scene.simpleString() == "bigint" else pa.int32() if scene.simpleString() == "int" else pa.string(), *[pa.int32()] * 4, pa.binary()]
    strips = blocks.select(*KEYS, "height", "width", *bands).mapInArrow(send, f"scene_id {scene.simpleString()}, br int, bc int, dr int, dc int, data binary")
    halo = strips.groupBy(*KEYS).agg(F.collect_list(F.struct("dr", "dc", "data")).alias("halo"))  # eight at most
    return blocks.join(halo.hint("shuffle_hash"), KEYS, "left")


def to_pixels(blocks: DataFrame, values: Callable[[Block], dict[str, np.ndarray]], names: list[str], bands: list[str], size: int = SIZE) -> DataFrame:
    """(scene_id, r, c and names) of every pixel, from what values makes of each block."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            b = Block(row, bands, size)
            found = values(b)
            n = b.high * b.wide
            at = np.arange(n)
            columns = [pa.repeat(pa.scalar(b.scene, kinds[0]), n), pa.array(b.top + at // b.wide), pa.array(b.left + at % b.wide)]
            columns += [pa.array(np.ascontiguousarray(found[x]).reshape(n), mask=np.isnan(found[x]).reshape(n) if found[x].dtype.kind == "f" else None) for x in names]
            yield pa.RecordBatch.from_arrays([c if c.type == t else c.cast(t) for c, t in zip(columns, kinds)], ["scene_id", "r", "c", *names])

    scene = blocks.schema["scene_id"].dataType.simpleString()
    logical = {"water"}
    kinds = [{"bigint": pa.int64(), "int": pa.int32()}.get(scene, pa.string()), pa.int64(), pa.int64()] + [pa.bool_() if n in logical else pa.float64() for n in names]
    fields = ", ".join(f"{n} {'boolean' if n in logical else 'double'}" for n in names)
    return blocks.mapInArrow(spread, f"scene_id {scene}, r long, c long, {fields}")


def moving(a: np.ndarray, reach: int = REACH) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation over the square neighbourhood of an extended band; a missing sample makes those around it missing."""
    n = 2 * reach + 1

    def box(x: np.ndarray) -> np.ndarray:
        wide = sum(x[:, i : x.shape[1] - 2 * reach + i] for i in range(n)) / n
        return sum(wide[i : wide.shape[0] - 2 * reach + i] for i in range(n)) / n

    mean, square = box(a), box(a * a)
    return mean, np.sqrt(np.maximum(square - mean * mean, 0))


def texture(blocks: DataFrame, band: str, size: int = SIZE) -> DataFrame:
    """(scene_id, r, c, <band>_mean, <band>_std) over the 5 x 5 neighbourhood."""

    def values(b: Block) -> dict[str, np.ndarray]:
        mean, std = moving(b.extended([band], REACH)[band])
        return {f"{band}_mean": mean, f"{band}_std": std}

    return to_pixels(with_halo(blocks.select(*KEYS, "height", "width", band), [band], size), values, [f"{band}_mean", f"{band}_std"], [band], size)
