"""Edges of frames that come in tiles, and how much they change from frame to frame.

``tiles(video, frame, height, width, top, left, luma)``: rectangles of 8-bit luma, row by row, on a grid of ``tile`` pixels. Filters that look at
neighbours get them by exchange: each tile sends the strips that others need, and a tile works on itself with its halo, so that the result
doesn't depend on the size of tiles and no task holds a frame. Edges are the thinned ridges of the gradient above a low
limit that hang together with one above the high limit; the limits follow the median of the frame. What hangs together is
labelled within each tile, and labels of neighbouring tiles are joined as components of a graph.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .graph import components
from .tables import written

KEY = ["video", "frame", "top", "left"]
#: 2^15 times the tangent of 22.5 degrees, of the test for direction (a fixed value)
TANGENT = 13573
#: how far the limits lie from the median, as a share (a fixed value)
SIGMA = 1.0 / 3.0


def tiled(frames: DataFrame, tile: int) -> DataFrame:
    """Tiles of ``frames(video, frame, height, width, luma)``."""
    kind = frames.schema["video"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                image = np.frombuffer(row["luma"], dtype=np.uint8).reshape(row["height"], row["width"])
                cuts = [(y, x) for y in range(0, row["height"], tile) for x in range(0, row["width"], tile)]
                n = len(cuts)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["video"]] * n, batch.schema.field("video").type), pa.array([row["frame"]] * n, pa.int64()), pa.array([row["height"]] * n, pa.int32()), pa.array([row["width"]] * n, pa.int32()),
                        pa.array([y for y, _ in cuts], pa.int32()), pa.array([x for _, x in cuts], pa.int32()), pa.array([image[y : y + tile, x : x + tile].tobytes() for y, x in cuts], pa.binary()),
                    ],
                    names=["video", "frame", "height", "width", "top", "left", "luma"],
                )

    rows = frames.select("video", F.col("frame").cast("long").alias("frame"), F.col("height").cast("int").alias("height"), F.col("width").cast("int").alias("width"), "luma")
    return rows.mapInArrow(run, f"video {kind}, frame long, height int, width int, top int, left int, luma binary")


def kernel_size(width: int, height: int) -> int:
    """The side of the square by which edges grow, from the size of a frame: always odd."""
    side = 4 + round((width * height) ** 0.5 / 192)
    return side + 1 - side % 2


def _with_halo(tiles: DataFrame, column: str, halo: int, tile: int, work, extra: list[str], out: str) -> DataFrame:
    """Tiles with ``column`` made by ``work(padded, inside, row)``: ``padded`` is the tile with ``halo`` pixels around it, ``inside`` tells which of them lie in the frame."""
    kind = tiles.schema["video"].dataType.simpleString()
    head = f"video {kind}, frame long, top int, left int, height int, width int"
    more = "".join(f", {c} {tiles.schema[c].dataType.simpleString()}" for c in extra)
    far = -(-halo // tile)
    names = [*KEY, "height", "width", *extra, "y", "x", "rows", "part"]

    def send(batches):
        for batch in batches:
            sent = {n: [] for n in names}
            for row in batch.to_pylist():
                top, left, height, width = row["top"], row["left"], row["height"], row["width"]
                rows = min(tile, height - top)
                image = np.frombuffer(row[column], dtype=np.uint8).reshape(rows, -1)
                for to_top in range(top - far * tile, top + far * tile + 1, tile):
                    for to_left in range(left - far * tile, left + far * tile + 1, tile):
                        if not (0 <= to_top < height and 0 <= to_left < width):
                            continue
                        y, x = max(0, to_top - halo - top), max(0, to_left - halo - left)
                        part = image[y : max(y, min(to_top + tile, height) + halo - top), x : max(x, min(to_left + tile, width) + halo - left)]
                        if not part.size:
                            continue
                        values = [row["video"], row["frame"], to_top, to_left, height, width, *(row[c] for c in extra), top + y, left + x, part.shape[0], part.tobytes()]
                        for n, v in zip(names, values):
                            sent[n].append(v)
            yield pa.RecordBatch.from_pydict({n: pa.array(v, kinds[n]) for n, v in sent.items()})

    messages = f"{head}{more}, y int, x int, rows int, part binary"
    kinds = {f.name: f.type for f in to_arrow_schema(StructType.fromDDL(messages))}

    def meet(rows: list[dict]) -> list:
        first = rows[0]
        top, left, height, width = first["top"], first["left"], first["height"], first["width"]
        bottom, right = min(top + tile, height), min(left + tile, width)
        padded = np.zeros((bottom - top + 2 * halo, right - left + 2 * halo), dtype=np.uint8)
        for row in rows:
            part = np.frombuffer(row["part"], dtype=np.uint8).reshape(row["rows"], -1)
            y, x = row["y"] - top + halo, row["x"] - left + halo
            padded[y : y + part.shape[0], x : x + part.shape[1]] = part
        ys, xs = np.arange(top - halo, bottom + halo), np.arange(left - halo, right + halo)
        inside = ((ys >= 0) & (ys < height))[:, None] & ((xs >= 0) & (xs < width))[None, :]
        # what lies outside repeats the nearest pixel of the frame
        near_y, near_x = np.clip(ys, 0, height - 1) - (top - halo), np.clip(xs, 0, width - 1) - (left - halo)
        made = work(padded[np.ix_(near_y, near_x)], inside, first)
        return [first["video"], first["frame"], top, left, height, width, made.astype(np.uint8).tobytes()]

    def receive(batches):
        """Messages come in the order of tiles; a tile is done when the next one begins."""
        place, rows = None, []
        for batch in batches:
            done = []
            for row in batch.to_pylist():
                at = tuple(row[c] for c in KEY)
                if at != place:
                    if rows:
                        done.append(meet(rows))
                    place, rows = at, []
                rows.append(row)
            yield made_of(done)
        yield made_of([meet(rows)] if rows else [])

    def made_of(done: list) -> pa.RecordBatch:
        columns = zip(*done) if done else [[]] * (len(KEY) + 3)
        return pa.RecordBatch.from_pydict({n: pa.array(v, kinds.get(n, pa.binary())) for n, v in zip([*KEY, "height", "width", column], columns)})

    sent = tiles.select(*KEY, "height", "width", *extra, column).mapInArrow(send, messages)
    # tiles by the thousands in a task: a group of its own for each would take longer than its work
    sent = sent.repartition(*KEY).sortWithinPartitions(*KEY)
    return written(sent.mapInArrow(receive, f"{head}, {column} binary"), out)


def _thinned(padded: np.ndarray, inside: np.ndarray, row: dict) -> np.ndarray:
    """0, or 1 for a ridge of the gradient above the low limit, 2 above the high one; needs a halo of two."""
    v = padded.astype(np.int64)
    rows, cols = v.shape
    at = lambda dy, dx: v[1 + dy : rows - 1 + dy, 1 + dx : cols - 1 + dx]
    gx = at(-1, 1) + 2 * at(0, 1) + at(1, 1) - at(-1, -1) - 2 * at(0, -1) - at(1, -1)
    gy = at(1, -1) + 2 * at(1, 0) + at(1, 1) - at(-1, -1) - 2 * at(-1, 0) - at(-1, 1)
    size = np.where(inside[1:-1, 1:-1], np.abs(gx) + np.abs(gy), 0)
    rows, cols = size.shape
    by = lambda dy, dx: size[1 + dy : rows - 1 + dy, 1 + dx : cols - 1 + dx]
    gx, gy, m = gx[1:-1, 1:-1], gy[1:-1, 1:-1], by(0, 0)
    flat, steep = np.abs(gx) * TANGENT, np.abs(gy) << 15
    across, along = steep < flat, steep > flat + (np.abs(gx) << 16)
    level = (m > by(0, -1)) & (m >= by(0, 1))
    upright = (m > by(-1, 0)) & (m >= by(1, 0))
    slant = np.where((gx ^ gy) < 0, (m > by(-1, 1)) & (m > by(1, -1)), (m > by(-1, -1)) & (m > by(1, 1)))
    ridge = np.where(across, level, np.where(along, upright, slant)) & (m > row["low"])
    return ridge.astype(np.uint8) + (ridge & (m > row["high"]))


def _labels(marks: np.ndarray) -> np.ndarray:
    """For each marked pixel the number of the first pixel that it hangs together with; others have the number of pixels."""
    rows, cols = marks.shape
    none = rows * cols
    label = np.append(np.where(marks.ravel() > 0, np.arange(none), none), none)
    while True:
        grid = np.full((rows + 2, cols + 2), none)
        grid[1:-1, 1:-1] = label[:-1].reshape(rows, cols)
        low = grid[1:-1, 1:-1].copy()
        for dy in (0, 1, 2):
            for dx in (0, 1, 2):
                np.minimum(low, grid[dy : dy + rows, dx : dx + cols], out=low)
        new = np.append(np.where(marks.ravel() > 0, low.ravel(), none), none)
        new = new[new]
        if np.array_equal(new, label):
            return label[:-1].reshape(rows, cols)
        label = new


def limits(tiles: DataFrame) -> DataFrame:
    """(video, frame, low, high) from the exact median of each frame, by counts of its 256 values."""
    kind = tiles.schema["video"].dataType.simpleString()

    def count(batches):
        for batch in batches:
            found = {n: [] for n in ("video", "frame", "v", "n")}
            for row in batch.to_pylist():
                values, counts = np.unique(np.frombuffer(row["luma"], dtype=np.uint8), return_counts=True)
                found["video"] += [row["video"]] * len(values)
                found["frame"] += [row["frame"]] * len(values)
                found["v"] += values.tolist()
                found["n"] += counts.tolist()
            yield pa.RecordBatch.from_arrays([pa.array(found["video"], batch.schema.field("video").type), *(pa.array(found[n], t) for n, t in (("frame", pa.int64()), ("v", pa.int32()), ("n", pa.int64())))], names=list(found))

    counts = tiles.select("video", "frame", "luma").mapInArrow(count, f"video {kind}, frame long, v int, n long").groupBy("video", "frame", "v").agg(F.sum("n").alias("n"))
    # at most 256 rows a frame
    order = Window.partitionBy("video", "frame").orderBy("v")
    counts = counts.withColumn("upto", F.sum("n").over(order)).withColumn("all", F.sum("n").over(Window.partitionBy("video", "frame")))
    lower = F.min(F.when(F.col("upto") * 2 >= F.col("all"), F.col("v")))
    upper = F.min(F.when(F.col("upto") * 2 > F.col("all"), F.col("v")))
    middle = counts.groupBy("video", "frame").agg(((lower + upper) / 2.0).alias("median"))
    low, high = F.greatest(F.lit(0.0), F.lit(1.0 - SIGMA) * F.col("median")), F.least(F.lit(255.0), F.lit(1.0 + SIGMA) * F.col("median"))
    return middle.select("video", "frame", F.floor(low).cast("int").alias("low"), F.floor(high).cast("int").alias("high"))


def edge_maps(tiles: DataFrame, tile: int) -> DataFrame:
    """``tiles`` with ``edges`` instead of luma: 255 where there is an edge."""
    kind = tiles.schema["video"].dataType.simpleString()
    ready = tiles.join(limits(tiles), ["video", "frame"])
    marks = _with_halo(ready, "luma", 2, tile, _thinned, ["low", "high"], "marks").withColumnRenamed("luma", "marks")

    def pieces(batches):
        """A row for each piece of a tile (with null y), and one for each of its pixels on the tile's rim."""
        for batch in batches:
            out = {n: [] for n in (*KEY, "piece", "strong", "y", "x")}
            for row in batch.to_pylist():
                cols = min(tile, row["width"] - row["left"])
                marks = np.frombuffer(row["marks"], dtype=np.uint8).reshape(-1, cols)
                label = _labels(marks)
                strong = set(np.unique(label[marks == 2]).tolist())
                found = [(p, p in strong, None, None) for p in np.unique(label[marks > 0]).tolist()]
                rim = np.zeros(marks.shape, dtype=bool)
                rim[[0, -1], :] = rim[:, [0, -1]] = True
                found += [(int(label[y, x]), None, row["top"] + y, row["left"] + x) for y, x in np.argwhere(rim & (marks > 0)).tolist()]
                for c in KEY:
                    out[c] += [row[c]] * len(found)
                for n, values in zip(("piece", "strong", "y", "x"), zip(*found)):
                    out[n] += values
            kinds = [batch.schema.field("video").type, pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds)], names=list(out))

    schema = f"video {kind}, frame long, top int, left int, piece int, strong boolean, y int, x int"
    found = written(marks.select(*KEY, "width", "marks").mapInArrow(pieces, schema), "pieces")
    name = F.struct(*KEY, "piece")
    rim = found.where("y IS NOT NULL").select(name.alias("id"), "video", "frame", "y", "x")
    steps = F.array(*(F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in ((0, 1), (1, -1), (1, 0), (1, 1))))
    ahead = rim.select(F.col("id").alias("a"), "video", "frame", "y", "x", F.explode(steps).alias("s"))
    ahead = ahead.select("a", "video", "frame", (F.col("y") + F.col("s.dy")).alias("y"), (F.col("x") + F.col("s.dx")).alias("x"))
    links = ahead.join(rim.withColumnRenamed("id", "b"), ["video", "frame", "y", "x"]).where("a <> b").select("a", "b").distinct()
    whole = components(links)
    own = found.where("y IS NULL").select(name.alias("id"), *KEY, "piece", "strong").join(whole, "id", "left")
    own = written(own.withColumn("whole", F.coalesce("component_id", "id")), "wholes")
    kept = own.join(own.where("strong").select("whole").distinct(), "whole", "left_semi")
    # pieces of a tile: fewer than its pixels
    kept = kept.groupBy(*KEY).agg(F.collect_set("piece").alias("kept"))

    def paint(batches):
        for batch in batches:
            maps = []
            for row in batch.to_pylist():
                marks = np.frombuffer(row["marks"], dtype=np.uint8).reshape(-1, min(tile, row["width"] - row["left"]))
                good = np.isin(_labels(marks), row["kept"] or []) & (marks > 0) if row["kept"] else np.zeros(marks.shape, dtype=bool)
                maps.append((good * 255).astype(np.uint8).tobytes())
            yield batch.select([*KEY, "height", "width"]).append_column("edges", pa.array(maps, pa.binary()))

    rows = marks.join(kept, KEY, "left").select(*KEY, "height", "width", "marks", "kept")
    return rows.mapInArrow(paint, f"video {kind}, frame long, top int, left int, height int, width int, edges binary")


def grown(edges: DataFrame, tile: int, kernel: int) -> DataFrame:
    """``edges`` grown by a square of ``kernel`` pixels, which is odd."""
    reach = kernel // 2

    def work(padded, inside, row):
        on = np.where(inside, padded, 0)
        rows, cols = on.shape[0] - 2 * reach, on.shape[1] - 2 * reach
        wide = np.max([on[:, d : d + cols] for d in range(kernel)], axis=0)
        return np.max([wide[d : d + rows] for d in range(kernel)], axis=0)

    return _with_halo(edges, "edges", reach, tile, work, [], "grown")


def tile_deltas(tiles: DataFrame, column: str) -> DataFrame:
    """(video, frame, delta): mean distance of all pixels from those of the frame before, 0 for the first frame of a video."""
    kind = tiles.schema["video"].dataType.simpleString()
    frames = written(tiles.select("video", "frame", "height", "width").distinct(), "frames")
    before = frames.withColumn("before", F.lag("frame").over(Window.partitionBy("video").orderBy("frame")))
    old = tiles.select("video", F.col("frame").alias("before"), "top", "left", F.col(column).alias("old"))
    both = tiles.join(before.select("video", "frame", "before"), ["video", "frame"]).join(old, ["video", "before", "top", "left"])

    def run(batches):
        for batch in batches:
            far = [int(np.abs(np.frombuffer(a, np.uint8).astype(np.int64) - np.frombuffer(b, np.uint8)).sum()) for a, b in zip(batch.column(column).to_pylist(), batch.column("old").to_pylist())]
            yield batch.select(["video", "frame"]).append_column("far", pa.array(far, pa.int64()))

    sums = both.select("video", "frame", column, "old").mapInArrow(run, f"video {kind}, frame long, far long").groupBy("video", "frame").agg(F.sum("far").alias("far"))
    out = frames.join(sums, ["video", "frame"], "left")
    return out.select("video", "frame", (F.coalesce("far", F.lit(0)) / (F.col("height") * F.col("width"))).alias("delta"))


def edge_deltas(tiles: DataFrame, tile: int, kernel: int | None = None) -> DataFrame:
    """(video, frame, delta_edges). ``kernel`` follows from the largest frame where it isn't given."""
    if kernel is None:
        width, height = tiles.agg(F.max("width"), F.max("height")).first()
        kernel = kernel_size(width or 1, height or 1)
    return tile_deltas(grown(edge_maps(tiles, tile), tile, kernel), "edges").withColumnRenamed("delta", "delta_edges")
