"""Joins in time and space, all of them as equi-joins on buckets.

No operator here forms a product: as-of matches are windows over a union,
nearest-neighbour searches join on grid cells, polygons on rows of cells.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brackish.session import settle

EARTH_KM = 6371.0088
KM_PER_DEGREE = 111.32


def join_streams(base: DataFrame, keys: Sequence[str], *streams: DataFrame) -> DataFrame:
    """Left-join daily streams onto the base rows.

    All are of one grain and meet by sort-merge on the same keys, so the base
    is shuffled once. The hint is there because a stream laid on a dense
    calendar looks to the planner as small as the file behind it.
    """
    for stream in streams:
        base = base.join(stream.hint("merge"), list(keys), "left")
    return base


def align_sensors(keys: Sequence[str], left: DataFrame, right: DataFrame) -> DataFrame:
    """Full outer join of two acquisition tables on their timestamp."""
    return left.join(right, list(keys), "full")


def lookup(df: DataFrame, table: DataFrame, key: str, value: str, default: str | Column) -> DataFrame:
    """Attach a label, falling back to a constant or another column (a site without an estuary is its own)."""
    fallback = F.lit(default) if isinstance(default, str) else default
    return df.join(table.select(key, value), key, "left").withColumn(value, F.coalesce(F.col(value), fallback))


def asof_nearest(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    t: str,
    tolerance: float,
    cols: Sequence[str],
) -> DataFrame:
    """Each left row with the nearest right row within `tolerance`; of two equally near, the earlier.

    `t` is numeric on both sides and unique per key on the right. Both sides
    are laid on one axis and the previous and next right row are carried by
    windows over time blocks; right rows close to a block edge are copied
    across it. Cost is that of a sort, however many rows lie within reach.
    Adds the columns, `{t}_match` and `{t}_gap`, null where nothing is near;
    a tolerance of zero matches equal times only. Every distinct time is
    matched once and the matches are joined back, so the pixels of one
    overpass never share a window.
    """
    times = left.select(*keys, t).distinct()
    return left.join(_asof_times(times, right, keys, t, tolerance, cols), [*keys, t], "left")


def _asof_times(
    left: DataFrame, right: DataFrame, keys: Sequence[str], t: str, tolerance: float, cols: Sequence[str]
) -> DataFrame:
    """`asof_nearest` for distinct times."""
    length = tolerance * 64 or 1
    block = F.floor(F.col(t) / length)
    from_start, to_end = F.col(t) - block * length, (block + 1) * length - F.col(t)
    homes = F.array_compact(
        F.array(
            block,
            F.when(from_start <= tolerance, block - 1),
            F.when(to_end <= tolerance, block + 1),
        )
    )
    found = F.struct(F.col(t).alias("t"), *cols)
    candidates = right.select(*keys, t, F.lit(0).alias("_side"), found.alias("_right"), F.explode(homes).alias("_block"))
    queries = left.withColumn("_side", F.lit(1)).withColumn("_block", block)
    both = queries.unionByName(candidates, allowMissingColumns=True)
    up = Window.partitionBy(*keys, "_block").orderBy(t, "_side").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(*keys, "_block").orderBy(F.desc(t), "_side").rowsBetween(Window.unboundedPreceding, 0)
    near = both.select(
        *left.columns,
        "_side",
        F.last("_right", ignorenulls=True).over(up).alias("_prev"),
        F.last("_right", ignorenulls=True).over(down).alias("_next"),
    ).where("_side = 1")
    back, ahead = F.col(t) - F.col("_prev.t"), F.col("_next.t") - F.col(t)
    choose = F.when(ahead.isNull() | (back <= ahead), F.col("_prev")).otherwise(F.col("_next"))
    matched = near.withColumn("_m", choose).withColumn("_gap", F.abs(F.col("_m.t") - F.col(t)))
    hit = F.col("_gap") <= tolerance
    return matched.select(
        *left.columns,
        F.when(hit, F.col("_m.t")).alias(f"{t}_match"),
        F.when(hit, F.col("_gap")).alias(f"{t}_gap"),
        *[F.when(hit, F.col(f"_m.{c}")).alias(c) for c in cols],
    )


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    dlat, dlon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    a = F.pow(F.sin(dlat), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon), 2)
    return F.asin(F.sqrt(F.least(a, F.lit(1.0)))) * (2 * EARTH_KM)


def local_km(lat: Column, lon: Column, lat2: Column, lon2: Column, scale: float = KM_PER_DEGREE) -> Column:
    """Flat-earth distance around (lat, lon)."""
    return F.hypot((lat2 - lat) * scale, (lon2 - lon) * scale * F.cos(F.radians(lat)))


# A cell is one 64-bit number: its level above three coordinates of 19 bits each.
_SIDE = 1 << 19
_LEVEL_SHIFT = 57


def _cells(dims: Sequence[Column], sizes: Sequence[float]) -> Column:
    """Array with the cell of a position at every level of the ladder, finest first."""

    def pack(level: int, size: float) -> Column:
        out = F.lit(level).cast("long")
        for d in [*dims, F.lit(0.0)][:3]:
            out = out * _SIDE + F.floor(d / size) + _SIDE // 2
        return out

    return F.array(*[pack(i, s) for i, s in enumerate(sizes)])


def _coordinate(cell: Column, j: int, dims: int) -> Column:
    return F.shiftright(cell, 19 * (2 - j)).bitwiseAND(_SIDE - 1) - _SIDE // 2


_LEAF = 64


def _nearest(
    points: DataFrame,
    objects: DataFrame,
    sizes: Sequence[float],
    dims: int,
    km: Column,
    answer: Column,
    lower: Callable[[list[tuple[Column, Column]]], Column],
    cover: Callable[[Column], Column],
    leaf: int = _LEAF,
) -> DataFrame:
    """`_pid` with the smallest `answer` (a struct led by the distance) over all objects, by bounds on cells.

    `points` has `_pid` and `_home` (its cells at every level of the ladder), `objects` has `_cells` (likewise) and a
    payload `_o`, a struct; `km` is their distance, `lower` the least distance between a point and what is filed in a cell, from
    the cell's box, and `cover` the cell size whose neighbourhood holds everything within a distance.

    Objects are written once a level, and every occupied cell has a count and one representative. The representative of the
    finest own cell that is occupied bounds the answer; the cells around the point at the level that covers this bound are its
    candidates. Representatives tighten the bound, cells farther away than it are dropped, and cells of more than `leaf`
    objects give way to their occupied parts. Only the objects of the small cells left are compared, so
    a cluster costs every point a few cells a level, however many objects it holds.
    """
    top = len(sizes) - 1
    filed = objects.select("_o", "_cells", F.posexplode("_cells").alias("_level", "_cell"))
    filed = settle(filed.select("_o", "_cell", F.get("_cells", F.col("_level") + 1).alias("_up")))
    tree = settle(filed.groupBy("_cell").agg(F.count(F.lit(1)).alias("_n"), F.min("_o").alias("_o"), F.first("_up").alias("_up")))
    any_one = filed.agg(F.min("_o").alias("_any"))

    own = points.select("*", F.explode("_home").alias("_cell")).join(tree.select("_cell", "_o"), "_cell")
    own = own.groupBy("_pid").agg(F.min_by("_o", "_cell").alias("_o"))  # the level leads the cell's number
    start = points.join(own, "_pid", "left").withColumn("_one", F.lit(1)).join(any_one.withColumn("_one", F.lit(1)), "_one")
    start = start.withColumn("_o", F.coalesce("_o", "_any")).where(F.col("_o").isNotNull()).withColumn("_u", km)
    level = F.lit(top)
    for i in reversed(range(top)):
        level = F.when(cover(F.col("_u")) <= sizes[i], i).otherwise(level)
    offsets = [0]
    for j in range(dims):
        offsets = [o + d * _SIDE ** (2 - j) for o in offsets for d in (-1, 0, 1)]
    around = F.transform(F.array(*[F.lit(o) for o in offsets]), lambda o: F.get("_home", level) + o)
    now = start.select("_pid", "_u", F.explode(around).alias("_cell")).join(tree, "_cell")

    size = F.element_at(F.array(*[F.lit(float(x)) for x in sizes]), (F.shiftright("_cell", _LEVEL_SHIFT) + 1).cast("int"))
    box = [(_coordinate(F.col("_cell"), j, dims) * size, (_coordinate(F.col("_cell"), j, dims) + 1) * size) for j in range(dims)]
    same = Window.partitionBy("_pid")
    leaves = []
    for _ in range(top + 1):
        now = now.withColumn("_u", F.least("_u", F.min(km).over(same)))
        now = settle(now.where(lower(box) <= F.col("_u") * (1 + 1e-9) + 1e-9).select("_pid", "_u", "_cell", "_n"))
        last = (F.col("_n") <= leaf) | (F.shiftright("_cell", _LEVEL_SHIFT) == 0)
        leaves.append(now.where(last))
        rest = now.where(~last)
        if rest.isEmpty():
            break
        parts = tree.select(F.col("_cell").alias("_part"), F.col("_n").alias("_m"), "_o", F.col("_up").alias("_cell"))
        now = rest.join(parts, "_cell").select("_pid", "_u", F.col("_part").alias("_cell"), F.col("_m").alias("_n"), "_o")
    found = reduce(DataFrame.unionByName, leaves)
    # bounds of later turns drop cells that earlier turns let through
    found = found.withColumn("_u", F.min("_u").over(same)).where(lower(box) <= F.col("_u") * (1 + 1e-9) + 1e-9)
    return found.join(filed.select("_cell", "_o"), "_cell").groupBy("_pid").agg(F.min(answer).alias("_best"))


def nearest_place(
    points: DataFrame,
    targets: DataFrame,
    lat: str,
    lon: str,
    target_id: str,
    target_lat: str,
    target_lon: str,
    finest_km: float = 0.05,
    distance: str = "haversine",
) -> DataFrame:
    """The nearest target of every point and its distance in km; of equally near ones the smaller id.

    By great circles the search runs on cubes around earth-centred coordinates, so neither the date line nor the poles are
    special; by the flat `local` distance it runs on cells of degrees. Cells grow fourfold per level. Identical
    positions are searched once, on either side.
    """
    if EARTH_KM / finest_km >= _SIDE // 2:
        raise ValueError(f"finest_km must exceed {2 * EARTH_KM / _SIDE:.3f}")
    spots = points.select(F.col(lat).alias("_la"), F.col(lon).alias("_lo")).distinct().dropna()
    spots = spots.withColumn("_pid", F.struct("_la", "_lo"))
    places = targets.groupBy(F.col(target_lat).cast("double").alias("_tla"), F.col(target_lon).cast("double").alias("_tlo")).agg(F.min(target_id).alias("_tid"))
    places = places.dropna().withColumn("_o", F.struct("_tid", "_tla", "_tlo"))
    here, there = (F.col("_pid._la"), F.col("_pid._lo")), (F.col("_o._tla"), F.col("_o._tlo"))
    if distance == "haversine":
        sizes = [finest_km * 4**i for i in range(16) if finest_km * 4 ** (i - 1) < 2 * EARTH_KM]

        def sphere(la: Column, lo: Column) -> list[Column]:
            a, b = F.radians(la), F.radians(lo)
            return [F.cos(a) * F.cos(b) * EARTH_KM, F.cos(a) * F.sin(b) * EARTH_KM, F.sin(a) * EARTH_KM]

        home, cells = _cells(sphere(F.col("_la"), F.col("_lo")), sizes), _cells(sphere(F.col("_tla"), F.col("_tlo")), sizes)
        km = haversine_km(*here, *there)

        def lower(box):
            # the chord to a box, and the arc that belongs to it
            chord = F.sqrt(sum((F.pow(_outside(x, *side), 2) for x, side in zip(sphere(*here), box)), F.lit(0.0)))
            return F.asin(F.least(chord / (2 * EARTH_KM), F.lit(1.0))) * (2 * EARTH_KM)

        best = _nearest(spots.select("_pid", home.alias("_home")), places.select("_o", cells.alias("_cells")), sizes, 3, km, F.struct(km.alias("km"), F.col("_o._tid").alias("id")), lower, lambda u: u)
    else:
        km = local_km(*here, *there)
        best = _nearest_flat(spots, places, [F.col("_tlo"), F.col("_tla")], km, F.struct(km.alias("km"), F.col("_o._tid").alias("id")), max(finest_km / KM_PER_DEGREE, 0.0015), 0.0, KM_PER_DEGREE)
    best = best.select(
        F.col("_pid._la").alias(lat),
        F.col("_pid._lo").alias(lon),
        F.col("_best.id").alias(target_id),
        F.col("_best.km").alias("dist_km"),
    )
    return points.join(best, [lat, lon], "left")


def _outside(x: Column, low: Column, high: Column) -> Column:
    """How far a coordinate is outside an interval."""
    return F.greatest(low - x, x - high, F.lit(0.0))


def _nearest_flat(spots: DataFrame, objects: DataFrame, middle: Sequence[Column], km: Column, answer: Column, finest: float, half: float, scale: float) -> DataFrame:
    """`_nearest` in a flat projection centred on each point; objects reach at most `half` degrees from their middle (lon, lat)."""
    sizes = [finest * 4**i for i in range(16) if finest * 4 ** (i - 1) < 720]
    if 360 / finest >= _SIDE // 2:
        raise ValueError(f"the finest cell must exceed {720 / _SIDE:.5f} degrees")
    la, lo = F.col("_pid._la"), F.col("_pid._lo")
    cos = F.cos(F.radians(la))

    def lower(box):
        dx, dy = _outside(lo, box[0][0] - half, box[0][1] + half), _outside(la, box[1][0] - half, box[1][1] + half)
        return F.hypot(dx * cos * scale, dy * scale)

    points = spots.select("_pid", _cells([F.col("_lo"), F.col("_la")], sizes).alias("_home"))
    filed = objects.select("_o", _cells(middle, sizes).alias("_cells"))
    return _nearest(points, filed, sizes, 2, km, answer, lower, lambda u: u / (F.greatest(cos, F.lit(1e-9)) * scale) + half)


def grid_key(value: Column, step: float, origin: float = 0.0) -> Column:
    """Index of the nearest node of a regular axis."""
    return F.round((value - origin) / step).cast("long")


def nearest_grid_cell(
    points: DataFrame, grid: DataFrame, lat: str, lon: str, step: float, cols: Sequence[str], origin=(0.0, 0.0)
) -> DataFrame:
    """The values of the regular-grid node nearest to each point, by an equi-join on its index."""
    keyed = grid.select(
        grid_key(F.col("lat"), step, origin[0]).alias("_gy"), grid_key(F.col("lon"), step, origin[1]).alias("_gx"), *cols
    )
    here = points.withColumn("_gy", grid_key(F.col(lat), step, origin[0])).withColumn(
        "_gx", grid_key(F.col(lon), step, origin[1])
    )
    return here.join(keyed, ["_gy", "_gx"], "left").drop("_gy", "_gx")


def nearest_valid_cell(
    points: DataFrame,
    grid: DataFrame,
    lat: str,
    lon: str,
    value: str,
    step: str,
    first_steps: int = 48,
    warn_km: float = 15.0,
) -> DataFrame:
    """The nearest grid cell that carries data in its first `first_steps` steps; far ones are flagged."""
    valid = (
        grid.where(F.col(step) < first_steps)
        .groupBy("cell", "cell_lat", "cell_lon")
        .agg(F.count(value).alias("_n"))
        .where("_n > 0")
        .drop("_n")
    )
    near = nearest_place(points, settle(valid), lat, lon, "cell", "cell_lat", "cell_lon", distance="local")
    return near.withColumn("far", F.col("dist_km") > warn_km)


def segments(lines: DataFrame, keys: Sequence[str], order: str, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Consecutive vertices of each line as segment rows. `order` numbers vertices without gaps."""
    ahead = lines.select(
        *keys, (F.col(order) - 1).alias(order), F.col(lat).alias("lat2"), F.col(lon).alias("lon2")
    )
    return lines.select(*keys, order, F.col(lat).alias("lat1"), F.col(lon).alias("lon1")).join(
        ahead, [*keys, order]
    )


def distance_to_lines_km(
    points: DataFrame, pieces: DataFrame, lat: str, lon: str, finest_deg: float = 0.25
) -> DataFrame:
    """Distance of every point to the nearest segment, in a flat projection centred on the point.

    Long segments are cut into stretches of at most one finest cell (cutting does not change the minimum), which are
    then found through bounds on cells (`_nearest`), at every latitude.
    """
    count = F.greatest(
        F.lit(1),
        F.ceil(
            F.greatest(F.abs(F.col("lat2") - F.col("lat1")), F.abs(F.col("lon2") - F.col("lon1"))) / finest_deg
        ),
    )
    cut = pieces.withColumn("_n", count).withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))

    def along(a: str, b: str, shift: int) -> Column:
        return F.col(a) + (F.col(b) - F.col(a)) * (F.col("_i") + shift) / F.col("_n")

    cut = cut.select(
        along("lat1", "lat2", 0).alias("_y1"),
        along("lon1", "lon2", 0).alias("_x1"),
        along("lat1", "lat2", 1).alias("_y2"),
        along("lon1", "lon2", 1).alias("_x2"),
    ).dropna()
    cut = cut.withColumn("_o", F.struct("_x1", "_y1", "_x2", "_y2"))
    spots = points.select(F.col(lat).alias("_la"), F.col(lon).alias("_lo")).distinct().dropna()
    spots = spots.withColumn("_pid", F.struct("_la", "_lo"))
    rad = 3.141592653589793 / 180.0 * EARTH_KM
    cos = F.cos(F.radians(F.col("_pid._la")))
    ax, ay = (F.col("_o._x1") - F.col("_pid._lo")) * cos * rad, (F.col("_o._y1") - F.col("_pid._la")) * rad
    bx, by = (F.col("_o._x2") - F.col("_pid._lo")) * cos * rad, (F.col("_o._y2") - F.col("_pid._la")) * rad
    dx, dy = bx - ax, by - ay
    size = dx * dx + dy * dy
    share = -(ax * dx + ay * dy) / F.when(size == 0, F.lit(1e-12)).otherwise(size)
    share = F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0))
    km = F.hypot(ax + share * dx, ay + share * dy)
    middle = [(F.col("_x1") + F.col("_x2")) / 2, (F.col("_y1") + F.col("_y2")) / 2]
    best = _nearest_flat(spots, cut, middle, km, F.struct(km.alias("km")), finest_deg, finest_deg / 2, rad)
    best = best.select(F.col("_pid._la").alias(lat), F.col("_pid._lo").alias(lon), F.col("_best.km").alias("dist_km"))
    return points.join(best, [lat, lon], "left")


def in_rings(
    pixels: DataFrame, ring_edges: DataFrame, region: str, x: str, y: str, keys: Sequence[str] = (), row: float = 30.0
) -> DataFrame:
    """Pixels inside each region by the even-odd rule; a pixel in two regions appears twice.

    `ring_edges` has (region, x1, y1, x2, y2), closed rings, and any `keys` shared with the pixels. The plane is cut into cells of
    height `row` and 32 times that width, off the round numbers on which vertices lie. A cell knows whether its lower right corner is
    inside, from the number of edges that cross its lower line farther right; a pixel then counts the edges of its own cell on
    the way from that corner (up the right side, then left). Cells without edges lie inside or outside as a whole. So no
    list grows with a row, and a pixel meets only what touches its own cell.
    """
    wide = row * 32
    off_x, off_y = wide * 0.6180339887, row * 0.3819660113

    def col_of(x: Column) -> Column:
        return F.floor((x - off_x) / wide)

    def row_of(y: Column) -> Column:
        return F.floor((y - off_y) / row)

    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    edges = ring_edges.select(*keys, region, *[F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")])
    edges = edges.withColumn("_row", F.explode(F.sequence(row_of(low), row_of(high))))
    bottom = F.col("_row") * row + off_y
    rise = F.nullif(F.col("y2") - F.col("y1"), F.lit(0.0))

    def x_at(y: Column) -> Column:
        return (F.col("x2") - F.col("x1")) * (y - F.col("y1")) / rise + F.col("x1")

    # the stretch of the edge within the row, with a little to spare
    ends = [F.greatest(bottom, low), F.least(bottom + row, high)]
    xs = [F.coalesce(x_at(y), x) for y, x in zip(ends, (F.col("x1"), F.col("x2")))]
    spare = wide * 1e-9
    first, last = F.greatest(F.least(*xs), F.least("x1", "x2")) - spare, F.least(F.greatest(*xs), F.greatest("x1", "x2")) + spare
    crosses = (F.col("y1") > bottom) != (F.col("y2") > bottom)
    edges = edges.withColumns({"_from": col_of(first), "_to": col_of(last), "_cross": F.when(crosses, col_of(x_at(bottom)))})
    edges = settle(edges)
    touched = edges.withColumn("_col", F.explode(F.sequence("_from", "_to")))
    place = [*keys, region, "_row", "_col"]
    lists = touched.groupBy(*place).agg(F.collect_list(F.struct("x1", "y1", "x2", "y2")).alias("_edges"))
    crossed = edges.where(F.col("_cross").isNotNull()).groupBy(*keys, region, "_row", F.col("_cross").alias("_col")).agg(F.count(F.lit(1)).alias("_m"))
    cells = settle(lists.join(crossed, place, "full").withColumn("_m", F.coalesce("_m", F.lit(0))))
    right = Window.partitionBy(*keys, region, "_row").orderBy(F.desc("_col"))
    marks = cells.select(*place, "_m")
    marks = marks.withColumn("_odd", F.coalesce(F.sum("_m").over(right.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) % 2)
    marks = settle(marks.withColumn("_left", F.lead("_col").over(right)))
    # between two cells with edges everything is inside when an odd number of edges is crossed from there on
    gap = marks.where(((F.col("_odd") + F.col("_m")) % 2 == 1) & (F.col("_left") < F.col("_col") - 1))
    whole = gap.select(*keys, region, "_row", F.explode(F.sequence(F.col("_left") + 1, F.col("_col") - 1)).alias("_col"), F.lit(1).cast("long").alias("_odd"), F.array().cast(cells.schema["_edges"].dataType).alias("_edges"))
    known = cells.drop("_m").join(marks.select(*place, "_odd"), place).select(*place, "_odd", F.coalesce("_edges", F.array().cast(cells.schema["_edges"].dataType)).alias("_edges"))
    known = settle(known.unionByName(whole))
    px, py = F.col(x).cast("double"), F.col(y).cast("double")
    here = pixels.withColumn("_row", row_of(py)).withColumn("_col", col_of(px))
    side, floor = (F.col("_col") + 1) * wide + off_x, F.col("_row") * row + off_y

    def counts(e: Column) -> Column:
        across = (e["x2"] - e["x1"]) * (py - e["y1"]) / F.nullif(e["y2"] - e["y1"], F.lit(0.0)) + e["x1"]
        level = ((e["y1"] > py) != (e["y2"] > py)) & (across > px) & (across <= side)
        along = (e["y2"] - e["y1"]) * (side - e["x1"]) / F.nullif(e["x2"] - e["x1"], F.lit(0.0)) + e["y1"]
        upright = ((e["x1"] > side) != (e["x2"] > side)) & (along > floor) & (along <= py)
        return F.when(F.coalesce(level, F.lit(False)), 1).otherwise(0) + F.when(F.coalesce(upright, F.lit(False)), 1).otherwise(0)

    joined = here.join(known, [*keys, "_row", "_col"])
    inside = (F.col("_odd") + F.aggregate("_edges", F.lit(0), lambda n, e: n + counts(e))) % 2 == 1
    return joined.where(inside).select(*pixels.columns, region)


def bilinear(
    pixels: DataFrame, nodes: DataFrame, keys: Sequence[str], x: str, y: str, step: float, value: str = "w"
) -> DataFrame:
    """Weight at each pixel from the four surrounding nodes (x, y multiples of `step`); zero outside.

    The node table is turned once into cells with their four corners, so the
    pixel table is joined a single time and is not exploded.
    """
    gx, gy = F.round(F.col("x") / step).cast("long"), F.round(F.col("y") / step).cast("long")
    corners = F.array(
        *[
            F.struct((gx - i).alias("_cx"), (gy - j).alias("_cy"), F.lit(2 * j + i).alias("_k"))
            for i in (0, 1)
            for j in (0, 1)
        ]
    )
    cells = (
        nodes.select(*keys, F.col(value).alias("_w"), F.explode(corners).alias("_c"))
        .groupBy(*keys, "_c._cx", "_c._cy")
        .agg(*[F.max(F.when(F.col("_c._k") == k, F.col("_w"))).alias(f"_w{k}") for k in range(4)])
    )
    cells = settle(cells)
    here = pixels.withColumn("_cx", F.floor(F.col(x) / step)).withColumn("_cy", F.floor(F.col(y) / step))
    fx, fy = F.col(x) / step - F.col("_cx"), F.col(y) / step - F.col("_cy")
    shares = [(1 - fx) * (1 - fy), fx * (1 - fy), (1 - fx) * fy, fx * fy]
    # A corner the lookup needs but the grid lacks means the pixel is outside.
    terms = [F.when(s == 0, F.lit(0.0)).otherwise(s * F.col(f"_w{k}")) for k, s in enumerate(shares)]
    weight = F.coalesce(terms[0] + terms[1] + terms[2] + terms[3], F.lit(0.0))
    return (
        here.join(cells, [*keys, "_cx", "_cy"], "left").withColumn("fp_weight", weight).select(*pixels.columns, "fp_weight")
    )


def inventory(sites: DataFrame, rows: DataFrame, site: str, lat: str) -> DataFrame:
    """Site table with the number of rows of each site, from south to north."""
    counts = rows.groupBy(site).agg(F.count(F.lit(1)).alias("n_rows"))
    return sites.join(counts, site, "left").fillna(0, ["n_rows"]).orderBy(lat, site)
