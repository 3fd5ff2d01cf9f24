"""Search for page layouts under token budgets: candidates as rows, their scores as columns, the best by an aggregate."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriscribe.functions import layout as L
from veriscribe.functions.text import let

ALL_RESOLUTIONS = L.SMALL_RESOLUTIONS + L.RESOLUTIONS
#: The resolutions of the plain search.
KEY_RESOLUTIONS = [112 * i for i in (1, 2, 4, 8, 12, 16, 20)]


def candidates(texts: DataFrame, page_limit: int = 100, line_height: float = 1.0) -> DataFrame:
    """Layouts of texts (key columns, text_tokens, num_lines, max_line_chars, avg_line_chars, compression_ratio[, used]).

    Each text meets the 40 resolutions as an array of its own row, and each of these the pages that its token band allows.
    """
    target = F.col("text_tokens") / F.col("compression_ratio")
    sizes = F.array(*[F.struct(F.lit(r).alias("resolution"), F.lit(L.image_tokens_of(r)).alias("per_image_tokens")) for r in L.RESOLUTIONS])
    df = texts.withColumn("target", target).withColumn("s", F.explode(sizes)).select("*", "s.*").drop("s")
    low = F.greatest(F.lit(1), F.ceil(F.col("target") * L.by_target(F.col("target"), L.LOWEST) / F.col("per_image_tokens"))).cast("int")
    high = F.least(F.floor(F.col("target") * L.by_target(F.col("target"), L.HIGHEST) / F.col("per_image_tokens")), F.lit(page_limit)).cast("int")
    df = df.withColumns({"low": low, "high": high}).where("low <= high").withColumn("pages", F.explode(F.sequence("low", "high"))).drop("low", "high")
    used = ~F.exists("used", lambda u: (u["resolution"] == F.col("resolution")) & (u["pages"] == F.col("pages"))) if "used" in texts.columns else F.lit(True)
    df = df.withColumn("font_size", L.optimal_font_size(F.col("resolution"), F.col("pages"), F.col("num_lines"), F.col("max_line_chars"), line_height))
    df = df.withColumns(
        {
            "fill_rate": L.fill_rate(F.col("font_size"), F.col("resolution"), F.col("pages"), F.col("num_lines"), F.col("avg_line_chars"), line_height),
            "tokens": F.col("pages") * F.col("per_image_tokens"),
            "token_ratio": F.when(F.col("target") > 0, F.col("pages") * F.col("per_image_tokens") / F.col("target")).otherwise(1.0),
            "is_new": used,
        }
    )
    poor = F.when(F.col("target") >= 10000, (F.col("fill_rate") < 0.03) & (F.col("font_size") < 6)).when(F.col("target") >= 3000, (F.col("fill_rate") < 0.1) & (F.col("font_size") < 5)).otherwise(F.lit(False))
    df = df.where(~poor)
    return df.withColumn("score", L.score(F.col("target"), F.col("compression_ratio"), F.col("token_ratio"), F.col("fill_rate"), F.col("resolution"), F.col("font_size"), F.col("is_new")))


def best(found: DataFrame, *keys: str) -> DataFrame:
    """The best layout of each text: of equals, the smaller resolution, then fewer pages. Needs no sort."""
    names = ["resolution", "pages", "font_size", "fill_rate", "tokens", "token_ratio", "score"]
    order = F.struct(F.col("score"), -F.col("resolution"), -F.col("pages"))
    return found.groupBy(*keys).agg(F.max_by(F.struct(*names), order).alias("b")).select(*keys, "b.*")


def fallback(texts: DataFrame, found: DataFrame, *keys: str, page_limit: int = 100) -> DataFrame:
    """Texts without any candidate: the smallest resolution, its smallest font, and the pages that the text needs."""
    pages = F.least(L.page_count(F.col("text_tokens"), F.lit(112), F.lit(3)), F.lit(page_limit))
    return texts.join(found.select(*keys).distinct(), list(keys), "left_anti").select(*keys, F.lit(112).alias("resolution"), pages.alias("pages"), F.lit(3).alias("font_size"))


def pages_needed(lengths: Column, resolution: Column, size: Column, line_height: float = 1.0) -> Column:
    """Pages of lines of the given lengths, wrapped at the width of a page."""
    across = F.greatest(F.lit(1), F.floor(L.room(resolution) / (size * 0.6))).cast("int")
    down = F.greatest(F.lit(1), F.floor(L.room(resolution) / F.floor(size * line_height))).cast("int")
    rows = F.aggregate(F.transform(lengths, lambda n: F.greatest(F.lit(1), F.ceil(n / across)).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    return F.greatest(F.lit(1), F.ceil(rows / down)).cast("int")


def largest(fits: Callable[[Column], Column]) -> Column:
    """The largest font size that fits, by bisection, where all smaller ones fit too; the smallest if none does."""
    start = F.struct(F.lit(L.SMALLEST_FONT).alias("low"), F.lit(L.LARGEST_FONT).alias("high"))

    def step(x: Column, _: Column) -> Column:
        mid = F.floor((x["low"] + x["high"] + 1) / 2).cast("int")
        ok = fits(mid)
        return F.struct(F.when(ok, mid).otherwise(x["low"]).alias("low"), F.when(ok, x["high"]).otherwise(F.greatest(mid - 1, x["low"])).alias("high"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(8)), start, step, lambda x: x["low"])


def largest_font(lengths: Column, resolution: Column, pages: Column, line_height: float = 1.0) -> Column:
    """The largest font size with which lines fit the pages, as pages grow with the size; the smallest if none does."""
    return largest(lambda size: pages_needed(lengths, resolution, size, line_height) <= pages)


def exhaustive(texts: DataFrame, *keys: str) -> DataFrame:
    """The plain search over seven resolutions and all font sizes of texts (key columns, text_tokens, compression_ratio[, used]).

    Each resolution has one candidate. It is strict if the smallest font stays within a quarter over the target, and has the
    largest font that does; else the largest font on as few pages as the smallest font needs. Of strict ones the largest
    resolution, new ones before used ones; without any, the fewest tokens, then the largest font and resolution, which a new
    one replaces if its tokens are within a tenth.
    """
    target, size = F.col("text_tokens") / F.col("compression_ratio"), F.col("resolution")
    per, pages = L.image_tokens(size, size), lambda font: L.page_count(F.col("text_tokens"), size, font)
    df = texts.withColumn("resolution", F.explode(F.array(*map(F.lit, KEY_RESOLUTIONS)))).withColumn("least", pages(F.lit(L.SMALLEST_FONT)))
    df = df.withColumn("strict", F.coalesce(F.col("least") * per <= 1.25 * target, F.lit(False)))
    df = df.withColumn("font_size", largest(lambda font: F.when(F.col("strict"), pages(font) * per <= 1.25 * target).otherwise(pages(font) <= F.col("least"))))
    df = df.withColumn("pages", pages(F.col("font_size"))).withColumn("tokens", F.col("pages") * per)
    new = ~F.exists("used", lambda u: (u["resolution"] == F.col("resolution")) & (u["pages"] == F.col("pages"))) if "used" in texts.columns else F.lit(True)
    df = df.withColumn("is_new", F.coalesce(new, F.lit(True)))
    value = F.when(F.col("strict"), F.col("resolution") * 1000 + F.col("font_size")).otherwise(-F.col("tokens"))
    rank = F.struct(F.col("strict"), (F.col("strict") & F.col("is_new")).alias("n"), value.alias("value"), F.col("font_size").alias("f"), F.col("resolution").alias("r"))
    layout = F.struct("resolution", "pages", "font_size", "tokens", "strict")
    found = df.groupBy(*keys).agg(F.max_by(layout, rank).alias("b"), F.max_by(layout, F.when(F.col("is_new"), rank)).alias("n"))
    close = ~F.col("b.strict") & F.coalesce(F.col("n.tokens") <= F.col("b.tokens") * F.lit(1.1).cast("double"), F.lit(False))
    return found.select(*keys, F.when(close, F.col("n")).otherwise(F.col("b")).alias("b")).select(*keys, "b.resolution", "b.pages", "b.font_size", "b.tokens")


def compression_plan(tokens: Column, images: Column, ratios: list[float]) -> Column:
    """For each ratio, ascending, the resolution to which pages are resized, by the order of the ratios.

    A fold: each choice sees the earlier ones, takes the resolution nearest to its share of tokens, and moves below
    (or, up to 2, above) them where it repeats one or breaks their order.
    """
    sizes, top = F.array(*map(F.lit, ALL_RESOLUTIONS)), max(ALL_RESOLUTIONS)
    tok = lambda r: L.image_tokens(r, r)
    above = lambda r: F.try_element_at(F.filter(sizes, lambda x: x > r), F.lit(1))
    under = lambda r: F.try_element_at(F.filter(sizes, lambda x: x < r), F.lit(-1))

    def nearest(ratio: Column, each: Column, ideal: Column) -> Column:
        """The choice without regard to earlier ones."""
        known = ideal % 112 == 0  # one of the resolutions, as it is between 224 and 4480
        first = let(above(ideal), lambda larger: F.when((ratio <= 1.5) & (ideal < top) & (tok(larger) <= each * 1.4), larger).otherwise(L.closest_resolution(each, ALL_RESOLUTIONS)))
        return let(first, lambda t: F.when(known & (F.abs(tok(ideal) - each) < F.abs(tok(t) - each)) & ((ratio > 1.5) | (ideal > t)), ideal).otherwise(t))

    def ordered(chosen: Column, ratio: Column, target: Column) -> Column:
        up, down = above(F.array_max(chosen)), under(F.array_min(chosen))
        moved = F.when(ratio < 2, F.coalesce(up, target)).when(ratio == 2, F.coalesce(up, down, target)).otherwise(F.coalesce(down, target))
        first = F.when(F.array_contains(chosen, target), moved).otherwise(target)
        # ratios ascend, so each earlier choice must be above
        return F.aggregate(chosen, first, lambda t, c: F.when(t >= c, F.coalesce(under(c), t)).otherwise(t))

    def pick(done: Column, ratio: Column) -> Column:
        each = F.when(images > 0, tokens / ratio / images).otherwise(tokens / ratio)
        ideal = lambda e: F.greatest(F.lit(224), F.least(F.lit(4480), (F.floor(F.floor(F.sqrt(e * 1024)) / 16) * 16).cast("int")))
        target = let(each, lambda e: let(ideal(e), lambda i: nearest(ratio, e, i)))
        return let(F.transform(done, lambda d: d["resolution"]), lambda chosen: let(target, lambda t: ordered(chosen, ratio, t)))

    empty = F.expr("cast(array() as array<struct<ratio:double,resolution:int>>)")
    return F.aggregate(F.array(*[F.lit(float(r)) for r in sorted(ratios)]), empty, lambda done, r: F.concat(done, F.array(F.struct(r.alias("ratio"), pick(done, r).cast("int").alias("resolution")))))


def dynamic_plan(tokens: Column, images: Column, base: Column, ratios: list[float], base_ratio: float = 1.0) -> Column:
    """From a base resolution at the base ratio, the others' resolutions: none used twice, none above the one before."""
    sizes = F.array(*map(F.lit, ALL_RESOLUTIONS))
    start_done = F.array(F.struct(F.lit(base_ratio).alias("ratio"), base.cast("int").alias("resolution"))) if base_ratio in ratios else F.expr("cast(array() as array<struct<ratio:double,resolution:int>>)")

    def step(done: Column, ratio: Column) -> Column:
        each = F.when(images > 0, tokens / ratio / images).otherwise(tokens / ratio)
        target = L.closest_resolution(each, ALL_RESOLUTIONS)
        used = F.transform(done, lambda d: d["resolution"])
        before = F.try_element_at(used, F.lit(-1))
        free = F.filter(sizes, lambda x: ~F.array_contains(used, x))
        smaller = F.filter(free, lambda x: before.isNull() | (x <= before))
        fits = F.array_max(F.filter(smaller, lambda x: x <= target))
        nearest = F.array_min(F.transform(free, lambda x: F.struct(F.abs(L.image_tokens(x, x) - each).alias("d"), x.alias("r"))))["r"]
        other = F.coalesce(fits, F.array_max(smaller), nearest, target)
        clash = F.array_contains(used, target) | F.coalesce(target > before, F.lit(False))
        return F.concat(done, F.array(F.struct(ratio.alias("ratio"), F.when(clash, other).otherwise(target).cast("int").alias("resolution"))))

    return F.aggregate(F.array(*[F.lit(float(r)) for r in sorted(ratios) if r != base_ratio]), start_done, step)


def fan_out(pages: DataFrame, ratios: list[float] | None = None) -> DataFrame:
    """Every page at every ratio."""
    return pages.withColumn("ratio", F.explode(F.array(*[F.lit(r) for r in (ratios or L.RATIOS)])))
