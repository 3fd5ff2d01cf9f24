"""Closed formulas of page layouts: image tokens, font sizes, page counts, fill rates and scores.

A page is square; a hundredth of its side is margin on each side; a character is 0.6 of the font size wide.
All constants below are fixed values.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veriscribe.functions.text import let

RATIOS = [1.0, 1.5, 2.0, 4.0, 6.0, 8.0, 16.0]
COMPRESSION_RATIOS = [0.5, 1.0, 1.5, 2.0, 4.0, 8.0]
RESOLUTIONS = [112 * i for i in range(1, 41)]
SMALL_RESOLUTIONS = [14, 28, 56]
SMALLEST_FONT, LARGEST_FONT = 4, 150
CHARS_PER_TOKEN = 3.5


def modes(ratios: list[float] | None = None) -> list[str]:
    """The names of the ways in which a text can be given: as text, as an image, as an image at each ratio."""
    return ["text_only", "image"] + [f"image_ratio{r:g}" for r in sorted(ratios or COMPRESSION_RATIOS)]


def image_tokens(width: Column, height: Column) -> Column:
    return F.floor((width / 16 * (height / 16)) / 4).cast("int")


def image_tokens_of(resolution: int) -> int:
    return int((resolution / 16 * resolution / 16) / 4)


def tile_tokens(width: Column, height: Column) -> Column:
    """Tokens of an image file by its tiles of 14; of an unreadable one (null sizes) 170."""
    return F.coalesce(170 + F.least(2 * F.ceil(width / 14) * F.ceil(height / 14), F.lit(100)), F.lit(170)).cast("long")


def room(resolution: Column) -> Column:
    return resolution - 2 * (resolution * F.lit(0.01).cast("double"))


def font(x: Column) -> Column:
    return F.greatest(F.lit(SMALLEST_FONT), F.least(F.lit(LARGEST_FONT), x.cast("int")))


def initial_font_size(tokens: Column, resolution: Column, line_height: float = 1.0) -> Column:
    width = room(resolution)
    size = F.sqrt(width * width * F.lit(0.95).cast("double") / (tokens * F.lit(CHARS_PER_TOKEN).cast("double") * F.lit(0.6).cast("double") * line_height))
    return F.when(tokens <= 0, 40).otherwise(font(F.floor(F.floor(size) * F.lit(1.1).cast("double"))))


def page_count(tokens: Column, resolution: Column, size: Column, line_height: float = 1.0) -> Column:
    across = F.greatest(F.lit(1), F.floor(room(resolution) / (size * F.lit(0.6).cast("double"))))
    down = F.greatest(F.lit(1), F.floor(room(resolution) / (size * line_height)))
    chars = tokens * F.lit(CHARS_PER_TOKEN).cast("double")
    needed = F.greatest(F.lit(1), F.ceil((chars * F.lit(1.3).cast("double") + chars / 50 * (across * F.lit(0.3).cast("double"))) / (across * down)))
    return F.when((size <= 0) | (room(resolution) <= 0), 999).otherwise(needed).cast("int")


def rough_fill_rate(resolution: Column, size: Column, mean_line: Column | float = 80.0) -> Column:
    mean = mean_line if isinstance(mean_line, Column) else F.lit(mean_line)
    return F.when((size <= 0) | (room(resolution) <= 0), 0.0).otherwise(F.least(F.lit(1.5), mean / (room(resolution) / (size * F.lit(0.6).cast("double")))))


def fill_rate_for_pages(tokens: Column, resolution: Column, pages: Column, line_height: float = 1.0, mean_line: float = 80.0) -> Column:
    chars = tokens * F.lit(CHARS_PER_TOKEN).cast("double") / pages
    size = F.sqrt(room(resolution) * room(resolution) / (chars * F.lit(0.6).cast("double") * line_height))
    size = F.greatest(F.lit(float(SMALLEST_FONT)), F.least(F.lit(float(LARGEST_FONT)), size))
    return F.when(chars <= 0, 1.5).otherwise(rough_fill_rate(resolution, size, mean_line))


def in_range(pages: Column, tokens: Column, target: Column, low: float = 0.9, high: float = 1.1) -> Column:
    return F.when(target <= 0, F.lit(False)).otherwise((pages * tokens / target >= F.lit(low)) & (pages * tokens / target <= F.lit(high)))


def token_ratio(pages: Column, tokens: Column, target: Column) -> Column:
    return F.when(target <= 0, 999.0).otherwise(pages * tokens / target)


def optimal_font_size(resolution: Column, pages: Column, num_lines: Column, max_line: Column, line_height: float = 1.0) -> Column:
    by_height = F.when(num_lines > 0, room(resolution) * pages / (num_lines * F.lit(line_height))).otherwise(150.0)
    by_width = F.when(max_line > 0, room(resolution) / (max_line * F.lit(0.6).cast("double"))).otherwise(150.0)
    return font(F.floor(F.least(by_height, by_width)))


def fill_rate(size: Column, resolution: Column, pages: Column, num_lines: Column, mean_line: Column, line_height: float = 1.0) -> Column:
    down = size * F.lit(line_height) * num_lines / (room(resolution) * pages)
    across = size * F.lit(0.6).cast("double") * mean_line / room(resolution)
    return F.least(F.lit(1.5), F.least(down, across))


def by_target(target: Column, bands: list[tuple[float | None, float]]) -> Column:
    """The value of the first band whose bound is above the target."""
    out = None
    for bound, value in bands:
        if bound is None:
            return out.otherwise(F.lit(value).cast("double"))
        out = (F if out is None else out).when(target < bound, F.lit(value).cast("double"))
    raise ValueError("the last band has no bound")


LOWEST = [(50, 0.5), (100, 0.7), (3000, 0.8), (5000, 0.9), (10000, 0.93), (None, 0.95)]
HIGHEST = [(50, 2.0), (100, 1.5), (3000, 1.25), (5000, 1.12), (10000, 1.08), (None, 1.05)]
PENALTY = [(50, 1.0), (100, 1.5), (3000, 2.0), (5000, 2.5), (10000, 3.0), (None, 3.5)]


def score(target: Column, ratio: Column, tokens_ratio: Column, fill: Column, resolution: Column, size: Column, is_new: Column) -> Column:
    """How good a layout is: near the target, full, large; used ones a little less."""
    d = lambda x: F.lit(x).cast("double")
    near = 1 / (1 + F.abs(tokens_ratio - 1) * by_target(target, PENALTY))
    easy = (target < 50) | (ratio >= 4)
    full = F.when(easy, F.when(fill >= d(0.2), d(0.9)).otherwise(d(0.5))).otherwise(
        F.when(fill >= d(0.9), d(1.0)).when(fill >= d(0.2), d(0.2) + (fill - d(0.2)) * (d(0.8) / d(0.7))).when(fill >= d(0.1), d(0.05)).otherwise(d(0.01))
    )
    large = 1 + (resolution - 112) / d(4368.0) * F.when(target >= 3000, d(0.5)).otherwise(d(0.3))
    small_ratio = F.when(ratio <= 2, d(1.2)).otherwise(d(1.0))
    tiny = F.when((target >= 5000) & (size < 8), d(0.8)).otherwise(d(1.0))
    value = F.when(easy, F.pow(near, d(2.5)) * F.pow(full, d(0.2)) * large * small_ratio)
    value = value.when(target < 100, F.pow(near, d(1.5)) * F.pow(full, d(0.75)) * large * small_ratio).otherwise(near * full * large * small_ratio * tiny)
    return value * F.when(is_new, d(1.0)).otherwise(d(0.95))


def closest_resolution(target: Column, resolutions: list[int], tolerance: float = 1.4) -> Column:
    """The resolution with tokens nearest to the target; of several about as near, and like each other, the largest."""
    rows = F.array(*[F.struct(F.lit(r).alias("r"), F.lit(image_tokens_of(r)).alias("t")) for r in resolutions])

    def choose(found: Column) -> Column:
        """Of resolutions with their distances, in ascending order."""
        least = F.array_min(F.transform(found, lambda x: x["d"]))

        def of(near: Column) -> Column:
            tokens = F.transform(near, lambda x: x["t"])
            alike = (F.size(near) > 1) & (F.array_max(tokens) <= F.array_min(tokens) * F.lit(tolerance).cast("double"))
            first = F.element_at(F.filter(near, lambda x: x["d"] == F.array_min(F.transform(near, lambda y: y["d"]))), 1)["r"]
            return F.when(alike, F.array_max(F.transform(near, lambda x: x["r"]))).otherwise(first)

        return let(let(least, lambda d: F.filter(found, lambda x: x["d"] <= d * F.lit(1.2).cast("double"))), of)

    return let(target, lambda want: let(F.transform(rows, lambda x: F.struct(F.abs(x["t"] - want).alias("d"), x["r"].alias("r"), x["t"].alias("t"))), choose))
