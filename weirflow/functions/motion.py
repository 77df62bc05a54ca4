"""Video stabilisation on pixel tables (frame, y, x, v)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def blocks(pixels: DataFrame, width: int, height: int, frame_width: int, frame_height: int) -> DataFrame:
    """Pixels with the number of their block in raster order; pixels outside whole blocks go."""
    across, down = frame_width // width, frame_height // height
    inside = pixels.where((F.col("x") < across * width) & (F.col("y") < down * height))
    return inside.selectExpr("*", f"(y div {height}) * {across} + x div {width} AS block")


def motion_vectors(blocked: DataFrame, before: DataFrame, reach_x: int, reach_y: int) -> DataFrame:
    """(frame, block, dx, dy, cost): for each block the shift of least mean
    squared error (whole numbers) against the frame before; the first in raster
    order wins a tie, and a shift that leaves under half of the block inside is
    not considered. Shifts are a bounded list, so each pixel meets
    (2 reach + 1)^2 others, by an equality join."""
    shifts = F.explode(F.expr(f"flatten(transform(sequence(-{reach_y}, {reach_y}), a -> transform(sequence(-{reach_x}, {reach_x}), b -> struct(b AS dx, a AS dy))))"))
    sizes = blocked.groupBy("frame", "block").agg(F.count("*").alias("n"))
    moved = blocked.select("frame", "block", "y", "x", "v", shifts.alias("s")).select("frame", "block", "v", F.col("s.dx").alias("dx"), F.col("s.dy").alias("dy"), (F.col("x") + F.col("s.dx")).alias("x"), (F.col("y") + F.col("s.dy")).alias("y"))
    other = before.select((F.col("frame") + 1).alias("frame"), "x", "y", F.col("v").alias("w"))
    costs = moved.join(other, ["frame", "x", "y"]).groupBy("frame", "block", "dx", "dy").agg(F.sum(F.pow(F.col("v") - F.col("w"), 2)).cast("bigint").alias("s"), F.count("*").alias("k"))
    kept = costs.join(sizes, ["frame", "block"]).where("2 * k >= n").selectExpr("frame", "block", "dx", "dy", "s div k AS cost")
    best = kept.groupBy("frame", "block").agg(F.min(F.struct("cost", "dy", "dx")).alias("m"))
    return best.selectExpr("frame", "block", "m.dx AS dx", "m.dy AS dy", "m.cost AS cost")


def block_statistics(vectors: DataFrame, by: str, x: str = "dx", y: str = "dy") -> DataFrame:
    """Means cut to whole numbers and the sample covariance around them."""
    sums = vectors.groupBy(by).agg(F.count("*").alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(F.col(x) * F.col(x)).alias("sxx"), F.sum(F.col(y) * F.col(y)).alias("syy"), F.sum(F.col(x) * F.col(y)).alias("sxy"))
    mean = sums.selectExpr("*", "sx div n AS mx", "sy div n AS my")
    around = lambda s, a, b, ma, mb: f"({s} - {mb} * {a} - {ma} * {b} + n * {ma} * {mb}) / (n - 1)"
    cov = [f"{around('sxx', 'sx', 'sx', 'mx', 'mx')} AS cxx", f"{around('syy', 'sy', 'sy', 'my', 'my')} AS cyy", f"{around('sxy', 'sx', 'sy', 'mx', 'my')} AS cxy"]
    return mean.where("n > 1").selectExpr(by, "n", "mx", "my", *cov)


def density(x: Column, y: Column, s: dict[str, Column]) -> Column:
    """Bivariate normal density; along one axis where the other does not vary."""
    a, b = x - s["mx"], y - s["my"]
    det = s["cxx"] * s["cyy"] - s["cxy"] * s["cxy"]
    two = F.exp(-(s["cyy"] * a * a - 2 * s["cxy"] * a * b + s["cxx"] * b * b) / (2 * det)) / (2 * F.pi() * F.sqrt(det))
    one = lambda d, c: F.exp(-d * d / (2 * c)) / F.sqrt(2 * F.pi() * c)
    return F.when(det > 0, two).when(s["cxx"] > 0, one(a, s["cxx"])).when(s["cyy"] > 0, one(b, s["cyy"])).otherwise(F.lit(1.0))


def dominating_motion(vectors: DataFrame, by: str = "frame", x: str = "dx", y: str = "dy") -> DataFrame:
    """(by, mx, my): the mean of the vectors whose density is over two thirds
    of the greatest."""
    stats = block_statistics(vectors, by, x, y)
    names = ("mx", "my", "cxx", "cyy", "cxy")
    scored = vectors.join(stats, by).withColumn("p", density(F.col(x), F.col(y), {k: F.col(k) for k in names})).drop(*names)
    most = scored.groupBy(by).agg(F.max("p").alias("most"))
    kept = scored.join(most, by).where("p > most * 2 / 3")
    return kept.groupBy(by).agg(F.avg(x).alias("mx"), F.avg(y).alias("my"))


def residue(accumulated: Column, tap: float) -> Column:
    """What a high-pass filter takes off the accumulated motion, halved: the part of it that moves the picture."""
    return accumulated * (1 - tap) / 2


def filtered(before: Column, accumulated: Column, tap: float) -> Column:
    """The filtered motion after a frame: what rounding left of the one before, and the residue."""
    return before - F.round(before) + residue(accumulated, tap)


def rendered(frame: DataFrame, shift_x: int, shift_y: int, before: DataFrame, fade: float = 0.9, by: tuple[str, ...] = ()) -> DataFrame:
    """The frame pasted at an offset over the faded frame before: (y, x, v);
    many frames at once, each over the one with its values in `by`."""
    pasted = frame.select(*by, (F.col("y") + shift_y).alias("y"), (F.col("x") + shift_x).alias("x"), F.col("v").alias("fresh"))
    old = before.select(*by, "y", "x", F.col("v").alias("old"))
    return old.join(pasted, [*by, "y", "x"], "left").select(*by, "y", "x", F.coalesce("fresh", (F.col("old") * fade).cast("bigint")).alias("v"))
