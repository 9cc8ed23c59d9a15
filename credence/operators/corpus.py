"""Image corpus: one row per image in the layout of Spark's image source, statistics by Spark aggregates.

Rows have id, height, width and data (BGR bytes, row by row).  A picture is cut into bands of lines or rows of
blocks, each a record that carries its own bytes, so a large picture is many records.  A step in Arrow batches
turns a record into sums of whole numbers or into one row per block; everything else (means, deviations, shares, dark
levels, repeats) is grouped and computed by Spark, which only shuffles these sums and digests.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credence import fixed_values as fv

IMAGE_FEATURES = ["resolution", "sharpness", "edge_density", "white_ratio", "saturation", "texture", "noise", "clone_score"]
CHANNEL_STATS = ["blue_red", "header_bright", "sat_std", "laplace_var", "border_detail", "ink_std", "seal_hue_std", "seal_sat_mean", "gray_var"]

#: Place of a seal as shares of the picture: top, bottom, left, right.
SEAL_BOX = (0.75, 0.95, 0.35, 0.65)
#: Lines of a band, and how many beside it are read with it.
BAND_LINES, BESIDE = 128, 2
#: Records whose sums are sent on together; pictures that a task draws, and bytes of them that it sends on together.
RECORDS, DRAWN_PER_TASK, DRAWN_BYTES = 1024, 256, 4 << 20


# --- pictures cut into records ----------------------------------------------------------------------------------------------


def _readable(images: DataFrame, keys: list[str]) -> DataFrame:
    """Pictures whose bytes fit their size, the keys as one column."""
    fits = (F.col("height") > 0) & (F.col("width") > 0) & (F.length("data") == F.col("height").cast("bigint") * F.col("width") * 3)
    return images.where(fits).select(F.struct(*keys).alias("keys"), F.col("height").cast("int"), F.col("width").cast("int"), "data")


def _lines(first: Column, end: Column) -> Column:
    """Bytes of some lines of a picture."""
    return F.substring(F.col("data"), (first * F.col("width") * 3 + 1).cast("int"), ((end - first) * F.col("width") * 3).cast("int"))


def _window(part: str, top: Column, left: Column, high: Column, broad: Column, step: int = BAND_LINES, beside: int = BESIDE, last: Column | None = None) -> Column:
    """A part of a picture that is looked at on its own: cut every ``step`` lines, up to line ``last`` of it, with the lines beside."""
    whole = {"top": top, "left": left, "high": high, "broad": broad, "step": F.lit(step), "beside": F.lit(beside), "last": high - 1 if last is None else last}
    return F.struct(F.lit(part).alias("part"), *[c.cast("int").alias(n) for n, c in whole.items()])


def _whole() -> Column:
    return _window("whole", F.lit(0), F.lit(0), F.col("height"), F.col("width"))


def _strips(part: str, size: int) -> Column:
    """Rows of blocks; a block starts every ``size`` pixels before the last ``size``."""
    some = (F.col("height") > size) & (F.col("width") > size)
    return _window(part, F.lit(0), F.lit(0), F.when(some, F.col("height")).otherwise(0), F.col("width"), size, 0, F.col("height") - size - 1)


def _records(images: DataFrame, keys: list[str], windows: list[Column]) -> DataFrame:
    """(keys, part, width, left, high, broad, y, first, data): pieces of windows, and one record without data of the part "" per picture.

    Line y is the piece's first, ``first`` that of its bytes; both count from the top of the window.  A picture whose bytes do
    not fit its size has the part "" only, with sides of 0.  The picture itself is read once, whatever is asked of it.
    """
    fits = F.coalesce((F.col("height") > 0) & (F.col("width") > 0) & (F.length("data") == F.col("height").cast("bigint") * F.col("width") * 3), F.lit(False))
    side = lambda n: F.when(fits, F.col(n).cast("int")).otherwise(0).alias(n)
    pictures = images.select(F.struct(*keys).alias("keys"), side("height"), side("width"), "data")
    known = _window("", F.lit(0), F.lit(0), F.col("height"), F.col("width"), last=F.lit(0))
    parts = pictures.select("*", F.inline(F.array(known, *windows))).where("part = '' or (high > 0 and broad > 0)")
    pieces = parts.select("*", F.explode(F.sequence(F.lit(0), F.col("last"), F.col("step"))).alias("y"))
    first, end = F.greatest(F.col("y") - F.col("beside"), F.lit(0)), F.least(F.col("y") + F.col("step") + F.col("beside"), F.col("high"))
    lines = F.when(F.col("part") != "", _lines(F.col("top") + first, F.col("top") + end)).alias("data")
    return pieces.select("keys", "part", "width", "left", "high", "broad", "y", first.alias("first"), lines)


def _bgr(data: bytes, width: int) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(-1, width, 3)


def _gray(bgr: np.ndarray) -> np.ndarray:
    b, g, r = (bgr[:, :, i].astype(np.float64) for i in range(3))
    return np.floor(0.114 * b + 0.587 * g + 0.299 * r + 0.5).astype(np.int32)


# --- whole numbers of the pixels of one band ----------------------------------------------------------------------------------


class Band:
    """Lines of a window with those beside them; every method gives one whole number per pixel of the lines."""

    def __init__(self, width: int, left: int, high: int, broad: int, y: int, first: int, data: bytes) -> None:
        bgr = _bgr(data, width)[:, left : left + broad]
        self.high, self.broad, self.first = high, broad, first
        self.y, self.end = y, min(y + BAND_LINES, high)
        self.around = _gray(bgr)
        own = slice(y - first, self.end - first)
        self.grays, self.bgr = self.around[own], bgr[own].astype(np.int32)

    def _beside(self, lines: int, places: int, mirror: int) -> np.ndarray:
        """Grey values with lines and places beside them, mirrored at the edges or, in windows too narrow for ``mirror``, repeated."""

        def at(n: np.ndarray, size: int) -> np.ndarray:
            if min(self.high, self.broad) > mirror:
                n = np.abs(n)
                n = np.where(n >= size, 2 * size - 2 - n, n)
            return np.clip(n, 0, size - 1)

        rows = at(np.arange(self.y - lines, self.end + lines), self.high) - self.first
        return self.around[rows][:, at(np.arange(-places, self.broad + places), self.broad)]

    def gray(self) -> np.ndarray:
        return self.grays

    def blue(self) -> np.ndarray:
        return self.bgr[:, :, 0]

    def red(self) -> np.ndarray:
        return self.bgr[:, :, 2]

    def white(self) -> np.ndarray:
        return self.grays > 245

    def bright(self) -> np.ndarray:
        """Whether the mean of the three colours is over 220."""
        return self.blue() + self.bgr[:, :, 1] + self.red() > 660

    def _ends(self) -> tuple[np.ndarray, np.ndarray]:
        """The greatest and the least of the three colours."""
        b, g, r = (self.bgr[:, :, i] for i in range(3))
        return np.maximum(np.maximum(b, g), r), np.minimum(np.minimum(b, g), r)

    def saturation(self) -> np.ndarray:
        top, low = self._ends()
        return np.floor(255 * (top - low) / np.maximum(top, 1) + 0.5).astype(np.int64)

    def hue(self) -> np.ndarray:
        """Hue in half degrees, 0 to 179."""
        b, g, r = (self.bgr[:, :, i].astype(np.float64) for i in range(3))
        top, low = self._ends()
        d = np.maximum(top - low, 1)
        h = np.where(top == r, (g - b) / d, np.where(top == g, 2 + (b - r) / d, 4 + (r - g) / d)) * 60
        return np.where(top > low, np.floor((h % 360) / 2 + 0.5) % 180, 0).astype(np.int64)

    def laplacian(self) -> np.ndarray:
        p = self._beside(1, 1, 1)
        return p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * p[1:-1, 1:-1]

    def noise(self) -> np.ndarray:
        """What smoothing over five by five places takes from a grey value."""
        p, n, weights = self._beside(2, 2, 2), self.end - self.y, (1, 4, 6, 4, 1)
        rows = sum(w * p[i : i + n] for i, w in enumerate(weights))
        return self.grays - (sum(w * rows[:, i : i + self.broad] for i, w in enumerate(weights)) + 128) // 256

    def edge(self) -> np.ndarray:
        """A strong gradient, or a medium one beside a strong one.

        Two thresholds as in hysteresis edge detection; ridges are not thinned, so the share is higher
        than that of a thinned edge map.
        """
        p = self._beside(2, 1, 1)
        across = (p[:-2, 2:] + 2 * p[1:-1, 2:] + p[2:, 2:]) - (p[:-2, :-2] + 2 * p[1:-1, :-2] + p[2:, :-2])
        down = (p[2:, :-2] + 2 * p[2:, 1:-1] + p[2:, 2:]) - (p[:-2, :-2] + 2 * p[:-2, 1:-1] + p[:-2, 2:])
        size, lines = np.abs(across) + np.abs(down), np.arange(self.y - 1, self.end + 1)
        strong = (size > 150) & ((lines >= 0) & (lines < self.high))[:, None]
        tall = strong[:-2] | strong[1:-1] | strong[2:]
        wide = np.pad(tall, ((0, 0), (1, 1)))
        return (size[1:-1] > 50) & (wide[:, :-2] | wide[:, 1:-1] | wide[:, 2:])


def _strip(data: bytes, width: int, size: int, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Sums and summed squares of the blocks of one row of them, and a digest of each block's grey values at ``places``."""
    n = (width - 1) // size
    gray = _gray(_bgr(data, width))[:, : n * size]
    blocks = gray.reshape(size, n, size).swapaxes(0, 1).reshape(n, -1).astype(np.int64)
    digests = [hashlib.md5(b.tobytes()).hexdigest() for b in blocks[:, places].astype(np.uint8)] if len(places) else []
    return blocks.sum(axis=1), (blocks * blocks).sum(axis=1), digests


#: Parts that are rows of blocks: their size, and the places of a block that a digest is taken of.
_STRIPS = {
    "texture": (16, np.zeros(0, int)),
    "clone": (48, (np.arange(0, 48, 6)[:, None] * 48 + np.arange(0, 48, 6)).ravel()),
}


def _sums(images: DataFrame, keys: list[str], windows: list[Column], numbers: dict[str, list[str]], levels: str | None = None) -> DataFrame:
    """Sums of every piece of the windows, and a row of the part "" per picture.

    (keys, part, high, broad, pixels, levels, blocks, stds, digests, and per number its sum and NAME_squares), ``numbers`` by the window's
    part.  ``levels`` names the part whose pixels of each grey level from 0 to 255 are counted too.  Rows of blocks have the
    digests of their blocks, or, where none are taken, the blocks' number and summed deviations.
    """
    records, names = _records(images, keys, windows), sorted({n for some in numbers.values() for n in some})
    sums = [c for n in names for c in (n, f"{n}_squares")]

    def measured(part: str, place: list, data: pa.Scalar) -> dict:
        if not part:
            return {}
        if part in _STRIPS:
            size, places = _STRIPS[part]
            total, squares, digests = _strip(data.as_buffer(), place[0], size, places)
            if len(places):
                return {"digests": digests}
            return {"blocks": len(total), "stds": float((np.sqrt((squares * size * size - total * total).astype(float)) / (size * size)).sum())}
        band = Band(*place, data.as_buffer())
        row = {"pixels": band.grays.size, "levels": np.bincount(band.grays.ravel(), minlength=256).tolist() if part == levels else None}
        for n in numbers[part]:
            values = getattr(band, n)()
            if values.dtype == bool:
                row[n] = row[f"{n}_squares"] = int(np.count_nonzero(values))
            else:
                values = values.astype(np.int64).ravel()
                row[n], row[f"{n}_squares"] = int(values.sum()), int(values @ values)
        return row

    kinds = {"pixels": pa.int64(), "levels": pa.list_(pa.int64()), "blocks": pa.int64(), "stds": pa.float64(), "digests": pa.list_(pa.string()), **dict.fromkeys(sums, pa.int64())}

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, RECORDS):
                batch = whole.slice(start, RECORDS)
                places = zip(*[c.to_pylist() for c in batch.columns[2:8]])
                found = [measured(part, place, data) for part, place, data in zip(batch.column(1).to_pylist(), places, batch.column(8))]
                columns = [pa.array([row.get(n) for row in found], kind) for n, kind in kinds.items()]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(4), batch.column(5), *columns], names=["keys", "part", "high", "broad", *kinds])

    schema = f"keys {records.schema['keys'].dataType.simpleString()}, part string, high int, broad int, pixels long, levels array<long>, blocks long, stds double, digests array<string>"
    return records.mapInArrow(add, ", ".join([schema, *[f"{c} long" for c in sums]]))


def _mean(name: str) -> Column:
    return F.sum(name) / F.sum("pixels")


def _variance(name: str) -> Column:
    return F.greatest(F.sum(f"{name}_squares") / F.sum("pixels") - _mean(name) * _mean(name), F.lit(0.0))


# --- blocks ---------------------------------------------------------------------------------------------------------------


def _blocks(pictures: DataFrame, size: int, places: np.ndarray) -> DataFrame:
    """(keys, std, block): deviation of every square block's grey values, and a digest of those at ``places`` of it.

    A block starts every ``size`` pixels before the last ``size``.
    """
    rows = pictures.where((F.col("height") > size) & (F.col("width") > size)).select("*", F.explode(F.sequence(F.lit(0), F.col("height") - size - 1, F.lit(size))).alias("y"))
    rows = rows.select("keys", "width", _lines(F.col("y"), F.col("y") + size).alias("data"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, width in enumerate(batch.column(1).to_pylist()):
                total, squares, digests = _strip(batch.column(2)[i].as_buffer(), width, size, places)
                keys = pa.concat_arrays([batch.column(0).slice(i, 1)]).take(pa.array([0] * len(total)))
                yield pa.RecordBatch.from_arrays([keys, pa.array(total), pa.array(squares), pa.array(digests, pa.string())], names=["keys", "total", "squares", "block"])

    found = rows.mapInArrow(cut, f"keys {rows.schema['keys'].dataType.simpleString()}, total long, squares long, block string")
    area = size * size
    return found.select("keys", (F.sqrt((F.col("squares") * area - F.col("total") * F.col("total")).cast("double")) / area).alias("std"), "block")


def image_blocks(images: DataFrame, key: str, size: int = 32, step: int = 16, min_std: float = 2.0) -> DataFrame:
    """(key, block) rows: digest of every textured block, for ``consistency.clone_blocks``."""
    return _blocks(_readable(images, [key]), size, np.arange(0, size * size, step)).where(F.col("std") >= min_std).select(f"keys.{key}", "block")


def block_count(height: Column, width: Column, size: int = 32) -> Column:
    """Blocks of a picture, flat ones too; a block starts every ``size`` pixels before the last ``size``."""
    fit = lambda n: F.greatest(F.floor((n - 1) / size), F.lit(0))
    return fit(height) * fit(width)


# --- statistics per picture -----------------------------------------------------------------------------------------------


def resolution(width: Column, height: Column) -> Column:
    """The resolution feature from the size alone."""
    return F.least(F.lit(100.0), width * height / 480_000 * 100)


#: The number behind a feature, and the feature from its sums.
_PIXEL_FEATURES = {
    "sharpness": ("laplacian", lambda n: F.least(F.lit(100.0), _variance(n) / 5)),
    "edge_density": ("edge", lambda n: _mean(n) * 100),
    "white_ratio": ("white", lambda n: _mean(n) * 100),
    "saturation": ("saturation", _mean),
    "noise": ("noise", lambda n: F.sqrt(_variance(n))),
}


def image_features(images: DataFrame, keys: list[str], names: list[str] = IMAGE_FEATURES) -> DataFrame:
    """The named pixel features of the classifier, by default all eight, one row per distinct key.

    The keys tell pictures apart: a key must not stand for two different ones.  A picture whose bytes do not fit its size has NULLs.
    Texture is the mean deviation of blocks of 16, 0 without such blocks.  The clone score is ten points for every repeat of a block of
    48, compared by every sixth pixel of every sixth line; the digests of one picture, a two-hundredth of its bytes, meet in its row.
    """
    windows, pixel = [], [n for n in _PIXEL_FEATURES if n in names]
    if pixel:
        windows.append(_whole())
    windows += [_strips(part, _STRIPS[part][0]) for part, name in (("texture", "texture"), ("clone", "clone_score")) if name in names]
    sums = _sums(images, keys, windows, {"whole": [_PIXEL_FEATURES[n][0] for n in pixel]})
    stats = {n: _PIXEL_FEATURES[n][1](_PIXEL_FEATURES[n][0]) for n in pixel}
    stats["resolution"] = F.max(F.when(F.col("part") == "", resolution(F.col("broad").cast("double"), F.col("high").cast("double"))))
    stats["texture"] = F.coalesce(F.sum("stds") / F.sum("blocks").cast("double"), F.lit(0.0))
    digests = F.flatten(F.collect_list("digests"))
    stats["clone_score"] = F.least(F.lit(100.0), (F.size(digests) - F.size(F.array_distinct(digests))) * 10.0)
    readable = F.max(F.when(F.col("part") == "", F.col("broad"))) > 0
    return sums.groupBy("keys").agg(*[F.when(readable, stats[n]).alias(n) for n in names]).select("keys.*", *names)


def _ink_deviation(levels: Column) -> Column:
    """Deviation of the dark pixels, over 100 of them, out of the level counts of a picture's bands.

    The level that separates dark from light has the largest between-class variance.
    """
    counts = F.aggregate(levels, F.array_repeat(F.lit(0).cast("bigint"), 256), lambda a, b: F.zip_with(a, b, lambda x, y: x + y))
    bars = F.filter(F.transform(counts, lambda n, level: F.struct(level.cast("bigint").alias("level"), n.alias("n"))), lambda bar: bar["n"] > 0)

    def total(some: Column, value) -> Column:
        return F.aggregate(some, F.lit(0).cast("bigint"), lambda sofar, bar: sofar + value(bar))

    def split(have: Column) -> Column:
        some = have["bars"]
        start = F.struct(F.lit(0.0).alias("below"), F.lit(0.0).alias("mass"), F.lit(-1.0).alias("best"), F.lit(0).cast("bigint").alias("level"))

        def step(state, bar):
            below, mass = state["below"] + bar["n"], state["mass"] + bar["n"] * bar["level"]
            spread = F.when(below < have["total"], F.pow(have["mass"] * below / have["total"] - mass, F.lit(2.0)) / (below * (have["total"] - below))).otherwise(-1.0)
            better = spread > state["best"]
            return F.struct(below.alias("below"), mass.alias("mass"), F.when(better, spread).otherwise(state["best"]).alias("best"), F.when(better, bar["level"]).otherwise(state["level"]).alias("level"))

        return F.struct(some.alias("bars"), F.aggregate(some, start, step, lambda s: s["level"]).alias("dark"))

    def deviation(have: Column) -> Column:
        ink = have["ink"]
        n, mass, squares = total(ink, lambda bar: bar["n"]), total(ink, lambda bar: bar["n"] * bar["level"]), total(ink, lambda bar: bar["n"] * bar["level"] * bar["level"])
        return F.when(n > 100, F.sqrt(F.greatest(squares / n - (mass / n) * (mass / n), F.lit(0.0))))

    def then(value: Column, step) -> Column:
        """``step`` of a value that is computed once."""
        return F.element_at(F.transform(F.array(value), step), 1)

    whole = then(bars, lambda some: F.struct(some.alias("bars"), total(some, lambda bar: bar["n"]).cast("double").alias("total"), total(some, lambda bar: bar["n"] * bar["level"]).cast("double").alias("mass")))
    dark = then(whole, split)
    return then(then(dark, lambda have: F.struct(F.filter(have["bars"], lambda bar: bar["level"] <= have["dark"]).alias("ink"))), deviation)


def image_channels(images: DataFrame, keys: list[str], seal_box: tuple[float, float, float, float] = SEAL_BOX) -> DataFrame:
    """Statistics behind the security-feature rules, one row per distinct key; the seal box is given as shares of the image.

    The share of bright pixels is NULL for a picture without a header part, as is the deviation of ink with too little of it.
    """
    h, w, zero = F.col("height"), F.col("width"), F.lit(0)
    strip = lambda n: F.least(n, F.lit(50))
    y0, y1, x0, x1 = (F.floor(n * F.lit(share)) for n, share in zip((h, h, w, w), seal_box))
    windows = [
        _whole(), _window("top", zero, zero, strip(h), w), _window("bottom", h - strip(h), zero, strip(h), w), _window("left", zero, zero, h, strip(w)), _window("right", zero, w - strip(w), h, strip(w)),
        _window("header", zero, F.floor(w / 4), F.floor(h / 4), F.floor(3 * w / 4) - F.floor(w / 4)), _window("seal", y0, x0, y1 - y0, x1 - x0)]
    numbers = {"whole": ["blue", "red", "gray", "saturation", "laplacian"], **dict.fromkeys(("top", "bottom", "left", "right"), ["laplacian"]), "header": ["bright"], "seal": ["hue", "saturation"]}
    sums = _sums(images, keys, windows, numbers, levels="whole")
    stats = {
        "blue_red": _mean("blue") / (_mean("red") + 1), "gray_var": _variance("gray"), "saturation": _mean("saturation"), "saturation_std": F.sqrt(_variance("saturation")),
        "laplace_var": _variance("laplacian"), "bright": _mean("bright"), "hue_std": F.sqrt(_variance("hue"))}
    parts = sums.groupBy("keys", "part").agg(*[c.alias(n) for n, c in stats.items()], F.collect_list("levels").alias("levels"))
    of = lambda part, name: F.max(F.when(F.col("part") == part, F.col(name)))
    readable = F.max((F.col("part") == "whole").cast("int")) == 1
    measured = parts.withColumn("ink_std", F.when(F.col("part") == "whole", _ink_deviation(F.col("levels"))))
    return measured.groupBy("keys").agg(
        of("whole", "blue_red").alias("blue_red"), of("header", "bright").alias("header_bright"), of("whole", "saturation_std").alias("sat_std"), of("whole", "laplace_var").alias("laplace_var"),
        (reduce(lambda a, b: a + b, [of(p, "laplace_var") for p in ("top", "bottom", "left", "right")]) / 4).alias("border_detail"), F.max("ink_std").alias("ink_std"),
        F.when(readable, F.coalesce(of("seal", "hue_std"), F.lit(0.0))).alias("seal_hue_std"), F.when(readable, F.coalesce(of("seal", "saturation"), F.lit(0.0))).alias("seal_sat_mean"),
        of("whole", "gray_var").alias("gray_var")).select("keys.*", *CHANNEL_STATS)


# --- preparing and drawing ------------------------------------------------------------------------------------------------


def prepared_size(width: Column, height: Column) -> tuple[Column, Column]:
    """Width capped at 2000 pixels, ratio kept."""
    return F.least(width, F.lit(2000)), F.when(width > 2000, F.floor(height * (F.lit(2000) / width)).cast("bigint")).otherwise(height)


def augmentation_plan(images: DataFrame, multiplier: int = 5, stem: str | None = None) -> DataFrame:
    """Each image fanned out to its variants with their method and, given a name column, file name."""
    methods = F.array(*[F.lit(m) for m in fv.TAMPER_METHODS])
    rows = images.withColumn("variant", F.explode(F.sequence(F.lit(0), F.lit(multiplier - 1))))
    rows = rows.withColumn("method", F.element_at(methods, F.col("variant") % len(fv.TAMPER_METHODS) + 1))
    if stem is None:
        return rows
    return rows.withColumn("file", F.concat(F.lit("fake_"), F.col(stem), F.lit("_"), F.col("method"), F.lit("_"), F.col("variant").cast("string"), F.lit(".jpg")))


def vector_images(vectors: DataFrame, key: str, vector: str, scale: int = 16) -> DataFrame:
    """Square pictures out of embedding vectors (values near -0.5 to 0.5), for tables without pictures.

    A vector is small beside its picture, so the vectors are dealt to as many tasks as the pictures need, and
    a task gives its pictures in batches of at most DRAWN_BYTES.
    """
    kind = vectors.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, size = [], 0
            for i in range(batch.num_rows):
                v = batch.column(1)[i].values.to_numpy(zero_copy_only=False).astype(np.float64)
                side = int(len(v) ** 0.5)
                if side * side != len(v):
                    raise ValueError(f"a vector of {len(v)} values makes no square picture")
                g = np.clip((v + 0.5) * 255, 0, 255).reshape(side, side)
                cells = np.stack([255 - g, g, np.roll(g, 1, axis=1)], axis=2).astype(np.uint8)
                rows.append((side * scale, cells.repeat(scale, axis=0).repeat(scale, axis=1).tobytes()))
                size += len(rows[-1][1])
                if size >= DRAWN_BYTES or i == batch.num_rows - 1:
                    sides, pixels = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.binary()))]
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(i + 1 - len(rows), len(rows)), sides, sides, pixels], names=[key, "height", "width", "data"])
                    rows, size = [], 0

    dealt = vectors.select(key, vector).repartition(max(1, -(-vectors.count() // DRAWN_PER_TASK)))
    return dealt.mapInArrow(run, f"`{key}` {kind}, height int, width int, data binary")
