"""Page images as rows of grey bytes: size, inversion, blank pages and small rotations, before a reader sees them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.functions import fixed

#: Columns whose ink counts as one strip, whose rows shift together when a page is turned a little.
STRIP = 4
#: Pixels that are turned, and points of ink that are moved, at a time; bytes of pages that are handed on together.
BLOCK, POINTS, OUT_BYTES = 1 << 16, 1 << 18, 4 << 20
PREPARED = "page_id long, width int, height int, grey binary, blank boolean, inverted boolean, turned double, warnings array<string>, error string"


def _levels(grey: np.ndarray) -> np.ndarray:
    """Pixels of each grey level."""
    return np.bincount(grey.ravel(), minlength=256)


def _percentile(levels: np.ndarray, percent: float) -> float:
    """The percentile of the pixels, between two levels in proportion, as numpy has it."""
    upto = levels.cumsum()
    at = (int(upto[-1]) - 1) * (percent / 100)
    low = int(at)
    a, b = (int(np.searchsorted(upto, min(i, int(upto[-1]) - 1), side="right")) for i in (low, low + 1))
    share = at - low
    return b - (b - a) * (1 - share) if share >= 0.5 else a + (b - a) * share


def _ink(levels: np.ndarray) -> float:
    light = _percentile(levels, fixed.INK_PERCENTILE)
    dark = int(np.ceil(min(fixed.DARK_BELOW, light - fixed.INK_STEP)))
    return int(levels[: max(dark, 0)].sum()) / int(levels.sum())


def ink_share(grey: np.ndarray) -> float:
    """Share of pixels clearly darker than the page's light ones."""
    return _ink(_levels(grey))


def _threshold(levels: np.ndarray) -> int:
    """The grey level that parts dark from light with the largest variance between them, from the number of pixels of each level."""
    weight, total = np.cumsum(levels), np.cumsum(levels * np.arange(256))
    both = weight * (weight[-1] - weight)
    between = np.divide((total[-1] * weight / weight[-1] - total) ** 2, both, out=np.full(256, -1.0), where=both > 0)
    return int(between.argmax())


def shrunk(grey: np.ndarray, most: int) -> np.ndarray:
    """A page of at most `most` pixels a side: means of square blocks, smaller ones at its ends."""
    k = -(-max(grey.shape) // most)
    if k <= 1:
        return grey
    ys, xs = (np.arange(0, n, k) for n in grey.shape)
    count = np.outer(*(np.diff(np.append(at, n)) for at, n in zip((ys, xs), grey.shape)))
    rows = np.add.reduceat(grey, ys, axis=0, dtype=np.int64)
    return (np.add.reduceat(rows, xs, axis=1) // count).astype(np.uint8)


def profiles(ink: np.ndarray, degrees: np.ndarray) -> np.ndarray:
    """Ink by row after each turn. One histogram of (row, strip of columns) serves all turns: a small one shifts each strip's rows by its distance from the middle."""
    h, w = ink.shape
    strips = -(-w // STRIP)
    wide = np.zeros((h, strips * STRIP), bool)
    wide[:, :w] = ink
    sums = wide.reshape(h, strips, STRIP).sum(axis=2)
    middle = STRIP * np.arange(strips) + (STRIP - 1) / 2 - w / 2
    room = int(np.ceil(np.tan(np.deg2rad(np.abs(degrees).max(initial=0))) * w / 2)) + 1
    shift = np.rint(np.tan(np.deg2rad(degrees))[:, None] * middle).astype(np.int64) + room
    out = np.zeros((len(degrees), h + 2 * room), np.int64)
    row, strip = np.nonzero(sums)
    count = sums[row, strip]
    step = max(1, POINTS // max(1, len(row)))
    for i in range(0, len(shift), step):
        some = shift[i : i + step]
        at = row + some[:, strip] + (h + 2 * room) * np.arange(len(some))[:, None]
        out[i : i + step] = np.bincount(at.ravel(), np.broadcast_to(count, at.shape).ravel(), len(some) * (h + 2 * room)).reshape(len(some), -1)
    return out


def skew(grey: np.ndarray) -> float:
    """Degrees by which a page should be turned so that its rows align; 0 without ink, with too much, or without a clear gain.

    All turns on the grid of fine steps are scored at once, by the squared steps between neighbouring rows. The best whole degree counts if it beats no turn
    by a clear factor; the answer is the best fine step around it.
    """
    small = shrunk(grey, fixed.SKEW_PIXELS)
    ink = small <= _threshold(_levels(small))
    if not fixed.LEAST_INK <= ink.mean() <= fixed.MOST_INK:
        return 0.0
    fine = round(1 / fixed.SKEW_STEP)
    grid = np.arange(-fixed.SKEW_RANGE * fine - fixed.SKEW_STEPS, fixed.SKEW_RANGE * fine + fixed.SKEW_STEPS + 1)
    score = np.square(np.diff(profiles(ink, grid / fine), axis=1)).sum(axis=1)
    whole = np.flatnonzero((grid % fine == 0) & (np.abs(grid) <= fixed.SKEW_RANGE * fine))
    none = int(np.flatnonzero(grid == 0)[0])
    best = whole[np.lexsort((np.abs(grid[whole]), -score[whole]))[0]]
    if best == none or score[best] < fixed.SKEW_GAIN * score[none]:
        return 0.0
    around = slice(best - fixed.SKEW_STEPS, best + fixed.SKEW_STEPS + 1)
    return round(float(grid[around][score[around].argmax()]) / fine, 1)


def turned(grey: np.ndarray, degrees: float) -> np.ndarray:
    """A page turned about its middle onto a page that holds all of it; what was outside is white, pixels are the nearest ones."""
    a, (h, w) = np.deg2rad(degrees), grey.shape
    high, wide = (int(np.ceil(x - 1e-9)) for x in (h * np.cos(a) + w * abs(np.sin(a)), w * np.cos(a) + h * abs(np.sin(a))))
    out = np.full((high, wide), 255, np.uint8)
    x, y = np.arange(wide) - (wide - 1) / 2, np.arange(high)[:, None] - (high - 1) / 2
    framed = np.pad(grey, 1, constant_values=255).ravel()
    for i in range(0, high, step := max(1, BLOCK // wide)):
        rows = y[i : i + step]
        at_y, at_x = rows * np.cos(a) - x * np.sin(a) + (h - 1) / 2, rows * np.sin(a) + x * np.cos(a) + (w - 1) / 2
        place = [np.clip(np.rint(at, out=at), -1, n, out=at).astype(np.int32) + 1 for at, n in ((at_y, h), (at_x, w))]
        np.take(framed, place[0] * (w + 2) + place[1], out=out[i : i + step])
    return out


#: Tells how far a page is rotated clockwise, and how sure it is: grey levels -> (90, 180, 270 or 0; confidence).
Orientation = Callable[[np.ndarray], tuple[int, float]]


def prepared(grey: np.ndarray, orientation: Orientation | None = None) -> tuple[np.ndarray, bool, bool, float, list[str]]:
    """A page made ready: (grey, blank, inverted, turned, warnings). A rotation counts if its teller is SURE_OF_ORIENTATION of it; it may raise ValueError or OSError."""
    notes = []
    if grey.size > fixed.MOST_PIXELS:
        small = shrunk(grey, int(np.sqrt(fixed.MOST_PIXELS * max(grey.shape) / min(grey.shape))))
        grey, notes = small, [fixed.SCAN_RESIZED]
    levels = _levels(grey)
    inverted = _percentile(levels, fixed.INVERT_PERCENTILE) < fixed.INVERT_BELOW
    grey, levels = (255 - grey, levels[::-1]) if inverted else (grey, levels)
    if _ink(levels) < fixed.BLANK_INK:
        return grey, True, inverted, 0.0, notes
    if orientation:
        try:
            quarter, sure = orientation(grey)
        except (ValueError, OSError):
            quarter, sure = 0, 0.0
        if sure >= fixed.SURE_OF_ORIENTATION:
            grey = np.ascontiguousarray(np.rot90(grey, quarter // 90 % 4))
    angle = skew(grey)
    return (turned(grey, angle) if angle else grey), False, inverted, angle, notes


def _prepare(batches: Iterator[pa.RecordBatch], orientation: Orientation | None) -> Iterator[pa.RecordBatch]:
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.bool_(), pa.bool_(), pa.float64(), pa.list_(pa.string()), pa.string())
    names = ("page_id", "width", "height", "grey", "blank", "inverted", "turned", "warnings", "error")
    rows, held = [], 0

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows), kinds, strict=True)], names=list(names))

    for batch in batches:
        for page, width, height, raw in zip(*(batch[c].to_pylist() for c in ("page_id", "width", "height")), batch["grey"], strict=True):
            size, raw = None if width is None or height is None else width * height, raw.as_buffer()
            if size is None or size <= 0 or raw is None or raw.size != size:
                row = page, width, height, None, None, None, None, [], fixed.BAD_IMAGE
            elif size > fixed.MOST_IMAGE_PIXELS:
                row = page, width, height, None, None, None, None, [], fixed.IMAGE_TOO_LARGE
            else:
                grey, blank, inverted, angle, notes = prepared(np.frombuffer(raw, np.uint8).reshape(height, width), orientation)
                row = page, grey.shape[1], grey.shape[0], grey.tobytes(), blank, inverted, angle, notes, None
            rows.append(row)
            held += len(row[3] or b"") + 256
            if held >= OUT_BYTES:
                yield out()
                rows, held = [], 0
    if rows:
        yield out()


def prepare(pages: DataFrame, orientation: Orientation | None = None) -> DataFrame:
    """PREPARED rows of page images (page_id, width, height, grey: a byte for each pixel, row by row). Small pages are handed on together, OUT_BYTES at most besides the last one.

    Over MOST_PIXELS a page is reduced, with a warning; a dark page is inverted; an almost uniform light one is blank and goes no further; one that
    lies on its side is set upright, if `orientation` is given, and a slightly turned one straight. A page without pixels, with a null field or another number of bytes, or over MOST_IMAGE_PIXELS has an error and no image.
    Rows of equal page_id are pages of their own. Other columns are not read.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("width").cast("int").alias("width"), F.col("height").cast("int").alias("height"), "grey")
    return rows.mapInArrow(lambda batches: _prepare(batches, orientation), PREPARED)
