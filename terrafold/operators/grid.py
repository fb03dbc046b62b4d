"""Operators on regular grids kept as long tables with integer cells (cx, cy)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrafold.plans.ordered import dealt, spread
from terrafold.session import cut_lineage


def cell_of(v: Column, origin: float, res: float) -> Column:
    return F.floor((v - F.lit(float(origin))) / F.lit(float(res)))


def nearest_index(v: Column, origin: float, res: float) -> Column:
    return F.bround((v - F.lit(float(origin))) / F.lit(float(res))).cast("long")


def point_sample(points: DataFrame, grid: DataFrame, x: str, y: str, x0: float, y0: float, res: float) -> DataFrame:
    """Value of the cell holding each point; null outside."""
    p = points.withColumns({"cx": cell_of(F.col(x), x0, res), "cy": cell_of(F.col(y), y0, res)})
    return p.join(grid, ["cx", "cy"], "left")


def _offsets(radius: int) -> Column:
    return F.sequence(F.lit(-radius), F.lit(radius))


def neighbourhood_mean(
    points: DataFrame, key: str, grid: DataFrame, value: str, x: str, y: str, x0: float, y0: float, res: float, radius: int = 2
) -> DataFrame:
    """Mean of valid cells within ``radius`` cells of each point."""
    p = (
        points.select(key, cell_of(F.col(x), x0, res).alias("_x"), cell_of(F.col(y), y0, res).alias("_y"))
        .withColumn("_dx", F.explode(_offsets(radius))).withColumn("_dy", F.explode(_offsets(radius)))
        .select(key, (F.col("_x") + F.col("_dx")).alias("cx"), (F.col("_y") + F.col("_dy")).alias("cy"))
    )
    return p.join(grid.select("cx", "cy", value), ["cx", "cy"], "left").groupBy(key).agg(F.avg(value).alias(value))


def nearest_cell(
    points: DataFrame, keys: list[str], cells: DataFrame, carry: list[str], px: str = "px", py: str = "py",
    start: int = 2, growth: int = 4, rings: int = 2,
) -> DataFrame:
    """Nearest cell of ``cells`` to each point, both in cell units.

    Each distinct position is searched once. First ``rings`` growing
    neighbourhoods are tried: at bucket size s the 3 x 3 buckets around a point
    hold every cell closer than s, so a hit below s is final. A bucket carries
    the cells of its neighbourhood as an array, so a point stays one row. Points
    that are still unmatched go down a pyramid of occupied boxes, so that they
    meet few cells however dense the cells are. Ties go to the smaller (cy, cx).
    Points without coordinates, or without any cell to find, come back with nulls.
    """
    c = F.col
    at = ["_px", "_py"]
    all_points = points.select(*keys, c(px).cast("double").alias("_px"), c(py).cast("double").alias("_py"))
    todo = cut_lineage(all_points.dropna(subset=at).select(*at).distinct())
    cand = cut_lineage(cells.select("cx", "cy", *carry))
    n = max(todo.count(), 9 * cand.count())
    d2 = (c("cx") - c("_px")) ** 2 + (c("cy") - c("_py")) ** 2
    best = F.min_by(F.struct("cx", "cy", *carry, d2.alias("_d2")), F.struct(d2, "cy", "cx")).alias("_b")
    found = ["cx", "cy", *carry, "_d2"]

    def nearest(cell: Column) -> Column:
        d = (cell["cx"] - c("_px")) ** 2 + (cell["cy"] - c("_py")) ** 2
        return F.struct(d.alias("_d2"), *[cell[k].alias(k) for k in ("cy", "cx", *carry)])

    done: DataFrame | None = None
    size = start
    for _ in range(rings):
        b = lambda v: F.floor(v / size)
        reached = (
            cand.withColumn("_dx", F.explode(_offsets(1))).withColumn("_dy", F.explode(_offsets(1)))
            .select((b(c("cx")) + c("_dx")).alias("_bx"), (b(c("cy")) + c("_dy")).alias("_by"), F.struct(*cand.columns).alias("_c"))
        )
        # at most 9 s^2 cells of a grid
        near = dealt(reached, n, "_bx", "_by").groupBy("_bx", "_by").agg(F.collect_set("_c").alias("_cells")).hint("merge")
        own = dealt(todo.select(*at, b(c("_px")).alias("_bx"), b(c("_py")).alias("_by")), n, "_bx", "_by")
        met = own.join(near, ["_bx", "_by"], "left").select(*at, F.array_min(F.transform("_cells", nearest)).alias("_b"))
        met = cut_lineage(met.withColumn("_hit", F.coalesce(c("_b._d2") < float(size) ** 2, F.lit(False))))
        hit = met.where("_hit").select(*at, F.struct(*[c(f"_b.{k}").alias(k) for k in found]).alias("_b"))
        done = hit if done is None else done.unionByName(hit)
        todo = met.where("NOT _hit").select(*at)
        size *= growth
    far = _descend(todo, at, cand, start, growth).join(cand.withColumns({"_bx": F.floor(c("cx") / start), "_by": F.floor(c("cy") / start)}), ["_bx", "_by"])
    far = far.groupBy(*at).agg(best)
    done = far if done is None else done.unionByName(far)
    return dealt(all_points, all_points.count(), *at).join(done, at, "left").select(
        *keys, *[c(f"_b.{k}").alias(k) for k in ("cx", "cy", *carry)], F.sqrt("_b._d2").alias("distance")
    )


def _descend(points: DataFrame, keys: list[str], cells: DataFrame, start: int, growth: int) -> DataFrame:
    """Boxes (_bx, _by) of size ``start`` that may hold the nearest cell of a point.

    From boxes of the cells' whole extent downwards, a point goes on to those
    occupied boxes whose nearest corner is no farther than the farthest corner
    of another one. They lie along an arc, so they stay few.
    """
    c = F.col
    extent = cells.agg(F.max("cx") - F.min("cx"), F.max("cy") - F.min("cy")).first()
    sizes = [start]
    while sizes[-1] <= max(extent[0] or 0, extent[1] or 0):
        sizes.append(sizes[-1] * growth)
    floors = cells.select("cx", "cy").distinct()
    top = sizes[-1]
    # an extent below the box size touches four boxes at most
    roots = floors.agg(F.collect_set(F.struct(F.floor(c("cx") / top).alias("x"), F.floor(c("cy") / top).alias("y")))).scalar()
    open_ = points.withColumn("_r", F.explode(roots)).select(*points.columns, c("_r.x").alias("_bx"), c("_r.y").alias("_by"))
    for size in reversed(sizes[:-1]):
        boxes = floors.select(F.floor(c("cx") / size).alias("_cx"), F.floor(c("cy") / size).alias("_cy")).distinct()
        boxes = boxes.withColumns({"_bx": F.floor(c("_cx") / growth), "_by": F.floor(c("_cy") / growth)})

        def reach(p: str, b: str) -> tuple[Column, Column]:
            lo = c(b) * size
            hi = lo + (size - 1)
            return F.greatest(lo - c(p), c(p) - hi, F.lit(0.0)), F.greatest(F.abs(c(p) - lo), F.abs(c(p) - hi))

        (nx, fx), (ny, fy) = reach("_px", "_cx"), reach("_py", "_cy")
        tried = open_.join(boxes, ["_bx", "_by"]).withColumns({"_near": nx * nx + ny * ny, "_far": fx * fx + fy * fy})
        tried = tried.withColumn("_cut", F.min("_far").over(Window.partitionBy(*keys)))
        open_ = tried.where(c("_near") <= c("_cut")).select(*points.columns, c("_cx").alias("_bx"), c("_cy").alias("_by"))
    return open_


def fill_nearest(cells: DataFrame, label: str) -> DataFrame:
    """Label of the nearest labelled cell for cells without one.

    Only labelled cells next to a cell that is unlabelled or absent can be
    nearest to anything, so just that rim is searched.
    """
    cells = dealt(cells, cells.count(), "cx", "cy")
    have = cells.where(F.col(label).isNotNull())
    votes = (
        have.withColumn("_dx", F.explode(_offsets(1))).withColumn("_dy", F.explode(_offsets(1)))
        .groupBy((F.col("cx") + F.col("_dx")).alias("cx"), (F.col("cy") + F.col("_dy")).alias("cy"))
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    inner = votes.where(F.col("_n") == 9).select("cx", "cy")
    rim = have.join(inner, ["cx", "cy"], "left_anti").select("cx", "cy", label)
    miss = cells.where(F.col(label).isNull()).select(F.col("cx").alias("_tx"), F.col("cy").alias("_ty"))
    found = nearest_cell(miss, ["_tx", "_ty"], rim, [label], "_tx", "_ty").select(
        F.col("_tx").alias("cx"), F.col("_ty").alias("cy"), F.col(label).alias("_fill")
    )
    return cells.join(found, ["cx", "cy"], "left").withColumn(label, F.coalesce(label, "_fill")).drop("_fill")


def bilinear(points: DataFrame, keys: list[str], grid: DataFrame, values: list[str], fx: Column, fy: Column) -> DataFrame:
    """Values at fractional cell positions (fx, fy) from the four corners.

    Every point becomes four weighted corner rows and meets the grid in one
    equi-join. Null where a corner that counts is missing.
    """
    p = points.select(*keys, fx.alias("_fx"), fy.alias("_fy")).withColumns({"_ix": F.floor("_fx"), "_iy": F.floor("_fy")})
    u, v = F.col("_fx") - F.col("_ix"), F.col("_fy") - F.col("_iy")
    corner = lambda dx, dy, w: F.struct((F.col("_ix") + dx).alias("cx"), (F.col("_iy") + dy).alias("cy"), w.alias("w"))
    four = F.array(corner(0, 0, (1 - u) * (1 - v)), corner(1, 0, u * (1 - v)), corner(0, 1, (1 - u) * v), corner(1, 1, u * v))
    rows = p.select(*keys, F.explode(four).alias("_c")).where(F.col("_c.w") > 0)
    rows = rows.select(*keys, "_c.cx", "_c.cy", "_c.w")
    j = rows.join(grid.select("cx", "cy", *values), ["cx", "cy"], "left")
    return j.groupBy(*keys).agg(
        *[F.when(F.count(F.col(n)) == F.count(F.lit(1)), F.sum(F.col("w") * F.col(n))).alias(n) for n in values]
    )


def resample_nearest(points: DataFrame, grid: DataFrame, fx: Column, fy: Column) -> DataFrame:
    p = points.withColumns({"cx": F.bround(fx).cast("long"), "cy": F.bround(fy).cast("long")})
    return p.join(grid, ["cx", "cy"], "left")


def downsample(grid: DataFrame, factor: int, values: list[str]) -> DataFrame:
    """Block means of factor x factor cells."""
    return grid.groupBy(
        F.floor(F.col("cx") / factor).alias("cx"), F.floor(F.col("cy") / factor).alias("cy")
    ).agg(*[F.avg(v).alias(v) for v in values])


def screen_heights(grid: DataFrame, elev: str = "elev", top: float = 4634.0) -> DataFrame:
    """Heights of 0 or above the highest summit become null."""
    e = F.col(elev)
    return grid.withColumn(elev, F.when((e != 0) & (e < top), e))


def terrain(grid: DataFrame, res: float, elev: str = "elev") -> DataFrame:
    """Slope and aspect in degrees from the 3 x 3 neighbourhood (Horn 1981).

    Each cell sends its height with the two gradient coefficients to its
    neighbours; cells with all nine heights get a value. Rows grow with cy to
    the north.
    """
    dx, dy = F.col("_dx"), F.col("_dy")
    # a cell at offset (dx, dy) from its target weighs 2 on the axis, 1 off it
    kx = dx * F.when(dy == 0, 2).otherwise(1)
    ky = dy * F.when(dx == 0, 2).otherwise(1)
    sent = grid.where(F.col(elev).isNotNull()).withColumn("_dx", F.explode(_offsets(1))).withColumn("_dy", F.explode(_offsets(1)))
    g = sent.groupBy((F.col("cx") - dx).alias("cx"), (F.col("cy") - dy).alias("cy")).agg(
        F.count(F.lit(1)).alias("_n"), (F.sum(kx * F.col(elev)) / (8 * res)).alias("_gx"),
        (F.sum(ky * F.col(elev)) / (8 * res)).alias("_gy"),
    ).where(F.col("_n") == 9)
    slope = F.degrees(F.atan(F.sqrt(F.col("_gx") ** 2 + F.col("_gy") ** 2)))
    flat = (F.abs("_gx") < 1e-9) & (F.abs("_gy") < 1e-9)
    # direction of steepest descent, clockwise from north; adding 360 before
    # and after the remainder keeps tiny negatives at 0
    down = F.degrees(F.atan2(-F.col("_gx"), -F.col("_gy")))
    aspect = F.when(~flat, F.pmod(F.round(down, 9), F.lit(360.0)))
    return g.select("cx", "cy", slope.alias("slope"), aspect.alias("aspect"))


def block_fraction(cells: DataFrame, factor: int, flag: str) -> DataFrame:
    """Share of positive fine cells per block, for complete blocks only."""
    return (
        cells.groupBy(F.floor(F.col("cx") / factor).alias("bx"), F.floor(F.col("cy") / factor).alias("by"))
        .agg(F.avg((F.col(flag) > 0).cast("double")).alias("fraction"), F.count(flag).alias("n"))
        .where(F.col("n") == factor * factor)
    )


def trim_extent(cells: DataFrame, value: str) -> DataFrame:
    """Cells inside the bounding range of valid cells."""
    ok = cells.where(F.col(value).isNotNull())
    box = ok.agg(F.struct(F.min("cx").alias("a"), F.max("cx").alias("b"), F.min("cy").alias("c"), F.max("cy").alias("d"))).scalar()
    j = cells.withColumn("_box", box)
    inside = F.col("cx").between(F.col("_box.a"), F.col("_box.b")) & F.col("cy").between(F.col("_box.c"), F.col("_box.d"))
    return j.where(inside).select(*cells.columns)


def dense_grid(cells: DataFrame, values: list[str], block: int = 256) -> DataFrame:
    """The full rectangle of cells, null where there is no data.

    The rectangle is generated block by block on the executors.
    """
    e = cells.agg(F.min("cx").alias("_a"), F.max("cx").alias("_b"), F.min("cy").alias("_c"), F.max("cy").alias("_d"))
    seq = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / block), F.floor(F.col(hi) / block)))
    blocks = spread(e.withColumn("_i", seq("_a", "_b")).withColumn("_j", seq("_c", "_d")), "_i", "_j")
    part = lambda lo, hi, b: F.explode(
        F.sequence(F.greatest(F.col(lo), F.col(b) * block), F.least(F.col(hi), (F.col(b) + 1) * block - 1))
    )
    full = blocks.withColumn("cx", part("_a", "_b", "_i")).withColumn("cy", part("_c", "_d", "_j")).select("cx", "cy")
    return full.join(cells.select("cx", "cy", *values), ["cx", "cy"], "left")


def grid_id(df: DataFrame, x: str, y: str, size: float) -> DataFrame:
    """Coarse cell by floor division."""
    return df.withColumns({"grid_x": F.floor(F.col(x) / size).cast("long"), "grid_y": F.floor(F.col(y) / size).cast("long")})


def cell_mean(df: DataFrame, x: str, y: str, x0: float, y0: float, res: float, value: str) -> DataFrame:
    """Mean of station values that share a cell."""
    return df.groupBy(cell_of(F.col(x), x0, res).alias("cx"), cell_of(F.col(y), y0, res).alias("cy")).agg(
        F.avg(value).alias(value), F.count(value).alias("n")
    )


def morans_i(cells: DataFrame, value: str) -> DataFrame:
    """Moran's I with queen neighbours of weight one, from moment sums."""
    ok = cells.where(F.col(value).isNotNull()).select("cx", "cy", F.col(value).alias("_v"))
    nb = (
        ok.withColumn("_dx", F.explode(_offsets(1))).withColumn("_dy", F.explode(_offsets(1)))
        .where((F.col("_dx") != 0) | (F.col("_dy") != 0))
        .groupBy((F.col("cx") + F.col("_dx")).alias("cx"), (F.col("cy") + F.col("_dy")).alias("cy"))
        .agg(F.sum("_v").alias("_s"), F.count(F.lit(1)).alias("_c"))
    )
    j = ok.join(nb, ["cx", "cy"], "left").na.fill(0, ["_s", "_c"])
    v, s, k = F.col("_v"), F.col("_s"), F.col("_c")
    m = j.agg(
        F.count(F.lit(1)).alias("n"), F.sum(k).alias("w"), F.avg(v).alias("_m"), F.var_pop(v).alias("_var"),
        F.sum(v * s).alias("_vs"), F.sum(s + k * v).alias("_lin"),
    )
    cross = F.col("_vs") - F.col("_m") * F.col("_lin") + F.col("_m") * F.col("_m") * F.col("w")
    return m.select("n", "w", F.try_divide(cross, F.nullif(F.col("w") * F.col("_var"), F.lit(0.0))).alias("morans_i"))


def product_compare(
    monthly: DataFrame, stations: DataFrame, product: DataFrame, key: str, x: str, y: str, x0: float, y0: float, res: float, value: str
) -> DataFrame:
    """Monthly station totals beside the reference product at the station.

    Stations and the product are shuffled: files tell too little of their size
    to leave them to a broadcast, the less so where months are told apart.
    """
    at = stations.select(key, cell_of(F.col(x), x0, res).alias("cx"), cell_of(F.col(y), y0, res).alias("cy"))
    joined = monthly.join(at.hint("merge"), key).join(product.hint("merge"), ["cx", "cy", "month"], "left")
    return joined.select(key, "month", "EI_month", value)
