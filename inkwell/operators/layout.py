"""Page geometry: regions, columns and reading order.

Every join has the page as its equality key, so no page meets another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .blocks import joined

PAGE = ["doc_id", "page_no"]
#: Sizes, gaps and shares of page geometry.
LEAST_SIDE, MERGE_GAP, PAD, MARGIN_SHARE, FULL_SHARE = 64, 30, 30, 0.08, 0.5


def margin_number(width: Column) -> Column:
    """Whether a line is a line number in the outer margins."""
    centre = (F.col("x0") + F.col("x1")) / 2
    return ((centre < width * MARGIN_SHARE) | (centre > width - width * MARGIN_SHARE)) & F.col("text").rlike(r"(?U)^\s*\d{1,4}\s*$")


def line_class(width: Column) -> Column:
    """full, left or right."""
    full = (F.col("x0") < width / 2) & (F.col("x1") > width / 2) & (F.col("x1") - F.col("x0") > width * FULL_SHARE)
    return F.when(full, "full").when((F.col("x0") + F.col("x1")) / 2 < width / 2, "left").otherwise("right")


def outside_regions(lines: DataFrame, regions: DataFrame) -> DataFrame:
    """Lines whose centre height is in no region that they overlap sideways."""
    r = regions.select(*[F.col(c).alias(f"r_{c}") for c in (*PAGE, "x0", "y0", "x1", "y1")])
    y = (F.col("y0") + F.col("y1")) / 2
    same = [F.col(c) == F.col(f"r_{c}") for c in PAGE]
    inside = (y >= F.col("r_y0")) & (y <= F.col("r_y1")) & (F.col("x1") > F.col("r_x0")) & (F.col("x0") < F.col("r_x1"))
    return lines.join(r, [*same, inside], "left_anti")


#: Height of the bands in which boxes and obstacles of a page meet.
BAND = 256.0


def _banded(rows: DataFrame, low: str, high: str, prefix: str = "") -> DataFrame:
    """``rows`` in each band that they lie in between two sides."""
    n = lambda c: F.floor(F.col(c) / BAND)
    return rows.withColumn(f"{prefix}band", F.explode(F.sequence(F.least(n(low), n(high)), F.greatest(n(low), n(high)))))


def capped_padding(boxes: DataFrame, obstacles: DataFrame, pad: float = PAD) -> DataFrame:
    """``boxes`` (doc_id, page_no, box_no, x0..y1) padded, each side no further than
    the nearest obstacle in its way.

    An obstacle caps a side only if it lies within ``pad`` of it, so a box meets those in
    the bands that its padded form touches, not all of its page."""
    sides = ("x0", "y0", "x1", "y1")
    o = _banded(obstacles.select(*[F.col(c).alias(f"o_{c}") for c in (*PAGE, *sides)]), "o_y0", "o_y1", "o_")
    wide = _banded(boxes.select(*PAGE, "box_no", *sides, (F.col("y0") - pad).alias("lo"), (F.col("y1") + pad).alias("hi")), "lo", "hi")
    close = (F.col("o_x1") >= F.col("x0") - pad) & (F.col("o_x0") <= F.col("x1") + pad) & (F.col("o_y1") >= F.col("lo")) & (F.col("o_y0") <= F.col("hi"))
    met = wide.join(o, [*[F.col(c) == F.col(f"o_{c}") for c in PAGE], F.col("band") == F.col("o_band"), close], "left")
    across = (F.col("o_x1") > F.col("x0")) & (F.col("o_x0") < F.col("x1"))
    along = (F.col("o_y1") > F.col("y0")) & (F.col("o_y0") < F.col("y1"))
    near = lambda f, side, when: f(F.when(when, F.col(side)))
    caps = met.groupBy(*PAGE, "box_no", *sides).agg(
        near(F.max, "o_x1", (F.col("o_x1") <= F.col("x0")) & along).alias("left"), near(F.max, "o_y1", (F.col("o_y1") <= F.col("y0")) & across).alias("top"),
        near(F.min, "o_x0", (F.col("o_x0") >= F.col("x1")) & along).alias("right"), near(F.min, "o_y0", (F.col("o_y0") >= F.col("y1")) & across).alias("bottom"))
    return caps.select(*PAGE, "box_no", F.greatest(F.col("x0") - pad, "left").alias("x0"), F.greatest(F.col("y0") - pad, "top").alias("y0"), F.least(F.col("x1") + pad, "right").alias("x1"), F.least(F.col("y1") + pad, "bottom").alias("y1"))


class _Grid:
    """Hulls by the cells of a grid that they lie in, and those over many cells apart."""

    most = 64

    def __init__(self, side: float):
        self.side, self.cells, self.large = side, {}, {}

    def _cells(self, box: list[float], more: float = 0) -> list[tuple[int, int]] | None:
        lo = [int((box[k] - more) // self.side) for k in (0, 1)]
        hi = [int((box[k] + more) // self.side) for k in (2, 3)]
        n = max(0, hi[0] - lo[0] + 1) * max(0, hi[1] - lo[1] + 1)
        return None if n > self.most else [(i, j) for i in range(lo[0], hi[0] + 1) for j in range(lo[1], hi[1] + 1)]

    def add(self, key: int, box: list[float]) -> None:
        cells = self._cells(box)
        for c in ["large"] if cells is None else cells:
            (self.large if cells is None else self.cells.setdefault(c, {}))[key] = box

    def remove(self, key: int, box: list[float]) -> None:
        cells = self._cells(box)
        for c in ["large"] if cells is None else cells:
            del (self.large if cells is None else self.cells[c])[key]

    def near(self, box: list[float], gap: float) -> set[int]:
        cells = self._cells(box, gap)
        found = set(self.large)
        for c in self.cells if cells is None else cells:
            found |= self.cells.get(c, {}).keys()
        return found


def united(boxes: list[list[float]], gap: float) -> list[list[float]]:
    """Hulls of boxes, united while any two are within ``gap`` on both axes, by top
    then left.  A hull is compared with those in the cells around it; when it grows, it
    looks around again, so that each union costs one look."""
    if not boxes:
        return []
    within = lambda a, b: max(a[0] - b[2], b[0] - a[2]) <= gap and max(a[1] - b[3], b[1] - a[3]) <= gap
    spans = sorted(max(abs(b[2] - b[0]), abs(b[3] - b[1])) for b in boxes)
    grid, hulls = _Grid(max(spans[len(spans) // 2] + gap, 1e-9)), {}
    for key, b in enumerate(boxes):
        box, looking = list(b), True
        while looking:
            met = [k for k in grid.near(box, gap) if within(hulls[k], box)]
            looking = bool(met)
            for k in met:
                own = hulls.pop(k)
                grid.remove(k, own)
                box = [min(box[0], own[0]), min(box[1], own[1]), max(box[2], own[2]), max(box[3], own[3])]
        hulls[key] = box
        grid.add(key, box)
    return sorted(hulls.values(), key=lambda b: (b[1], b[0]))


def merge_boxes(boxes: DataFrame, gap: float = MERGE_GAP) -> DataFrame:
    """Picture boxes of a page united while any two hulls are within ``gap`` on both
    axes: doc_id, page_no, box_no (from 1, by top then left) and the hull.  A page's
    boxes meet in one row, and many pages go to Python in one batch."""
    sides = ("x0", "y0", "x1", "y1")

    @F.pandas_udf("array<array<double>>")
    def hulls(pages):
        return pages.map(lambda page: united([list(map(float, b)) for b in page], gap))

    box = F.array(*[F.col(c).cast("double") for c in sides])
    pages = boxes.groupBy(*PAGE).agg(F.array_sort(F.collect_list(box)).alias("boxes"))
    each = pages.select(*PAGE, F.posexplode(hulls("boxes")).alias("n", "b"))
    return each.select(*PAGE, (F.col("n") + 1).alias("box_no"), *[F.col("b")[i].alias(c) for i, c in enumerate(sides)])


def zip_tables(boxes: DataFrame, markdowns: DataFrame, summaries: DataFrame | None = None) -> DataFrame:
    """Table boxes with their text: the n-th box of a page by ``box_no`` meets its n-th
    pipe block, and the longer side is cut off.  A summary (doc_id, page_no, idx,
    summary) takes the block's place.  ``markdowns``: doc_id, page_no, table_no, markdown."""
    at = lambda rows, by: rows.withColumn("idx", F.row_number().over(Window.partitionBy(*PAGE).orderBy(by)))
    met = at(boxes.select(*PAGE, "box_no", "x0", "y0", "x1", "y1"), "box_no").join(at(markdowns.select(*PAGE, "table_no", "markdown"), "table_no"), [*PAGE, "idx"])
    if summaries is None:
        return met.select(*PAGE, "idx", "x0", "y0", "x1", "y1", F.col("markdown").alias("text"))
    told = met.join(summaries.select(*PAGE, "idx", "summary"), [*PAGE, "idx"], "left")
    return told.select(*PAGE, "idx", "x0", "y0", "x1", "y1", F.when(F.col("summary") != "", F.col("summary")).otherwise(F.col("markdown")).alias("text"))


def significant(boxes: DataFrame) -> DataFrame:
    return boxes.where((F.col("x1") - F.col("x0") > LEAST_SIDE) & (F.col("y1") - F.col("y0") > LEAST_SIDE))


def virtual_lines(pictures: DataFrame, tables: DataFrame, pages: DataFrame) -> DataFrame:
    """Lines that stand for summarised figures (at their bottom edge) and for tables
    (as wide as the page, at their top edge).  Both come with their ``text``."""
    figures = pictures.where("text IS NOT NULL").select(*PAGE, F.concat(F.lit("[Image: "), "text", F.lit("]")).alias("text"), "x0", F.col("y1").alias("y0"), "x1", (F.col("y1") + 1).alias("y1"))
    told = tables.where("text <> ''").join(pages, PAGE)
    return figures.unionByName(told.select(*PAGE, "text", F.lit(0.0).alias("x0"), "y0", F.col("width").cast("double").alias("x1"), (F.col("y0") + 1).alias("y1")))


def reading_order(lines: DataFrame, pages: DataFrame, regions: DataFrame | None = None) -> DataFrame:
    """``lines`` (doc_id, page_no, line_no, text, x0..y1) with ``place`` from 1.

    Margin numbers go.  A full-width line and each edge of a region end a segment; in
    a segment the left column comes before the right one.

    Pages are as many as documents, so that no list of them or of their edges is held
    whole: both are merged with the lines, in the order that numbers them.
    """
    seen = lines.join(pages.hint("merge"), PAGE)
    seen = seen.where(~margin_number(F.col("width"))).withColumn("cls", line_class(F.col("width")))
    down = Window.partitionBy(*PAGE).orderBy("y0", "line_no").rowsBetween(Window.unboundedPreceding, 0)
    seen = seen.withColumn("full", F.sum((F.col("cls") == "full").cast("int")).over(down))
    if regions is not None:
        edges = regions.select(*PAGE, F.explode(F.array("y0", "y1")).alias("e")).groupBy(*PAGE).agg(F.collect_set("e").alias("edges"))
        seen = seen.join(edges.hint("merge"), PAGE, "left").withColumn("passed", F.coalesce(F.size(F.filter("edges", lambda e: e <= F.col("y0"))), F.lit(0)))
        seen = seen.withColumn("passed", F.when(F.col("edges").isNull(), 0).otherwise(F.col("passed")))
    else:
        seen = seen.withColumn("passed", F.lit(0))
    rank = F.when(F.col("cls") == "full", 0).when(F.col("cls") == "left", 1).otherwise(2)
    place = F.row_number().over(Window.partitionBy(*PAGE).orderBy("full", "passed", rank, "y0", "line_no"))
    return seen.select(*lines.columns, place.alias("place"))


def page_texts(ordered: DataFrame) -> DataFrame:
    return ordered.groupBy(*PAGE).agg(joined(F.col("text"), F.col("place"), "\n").alias("text"))


def document_texts(pages: DataFrame, separator: str = "\n-----\n\n") -> DataFrame:
    return pages.groupBy("doc_id").agg(joined(F.col("text"), F.col("page_no"), separator).alias("text"))


def fallback_summaries(pages: DataFrame, summaries: DataFrame) -> DataFrame:
    """For pages without regions: image summaries 1, 2, ... up to the first gap."""
    # Numbered before they meet the pages: the join finds them in its order, without those
    # behind a gap.  Pages are many, so that their list is never held whole.
    n = F.row_number().over(Window.partitionBy(*PAGE).orderBy("idx"))
    told = summaries.withColumn("n", n).where("idx = n").join(pages.hint("merge"), PAGE, "left_semi")
    return told.select(*PAGE, "idx", F.concat(F.lit("[Image: "), "summary", F.lit("]")).alias("text"))
