"""Where links of a drawn graph begin and end, which of them a selection marks, and colours by place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: colours of themes.
PALETTE = 12


def _edge_of(block: Column, cx: Column, cy: Column, dx: Column, dy: Column, extra: float) -> tuple[Column, Column]:
    """The point of a block's border, widened by ``extra``, towards (dx, dy) from its middle."""
    wide, tall = F.greatest(F.lit(1.0), block["width"] / 2 + extra), F.greatest(F.lit(1.0), block["height"] / 2 + extra)
    scale = 1 / F.greatest(F.abs(dx) / wide, F.abs(dy) / tall, F.lit(0.001))
    return cx + dx * scale, cy + dy * scale


def block_segments(placed: DataFrame, links: DataFrame, padding: float = 5) -> DataFrame:
    """source, target, x1, y1, x2, y2: links from border to border of their blocks, the end a little before its own.

    placed: id, x, y, width, height; links of blocks that are not placed are left out.
    """
    block = placed.select("id", F.struct("x", "y", "width", "height").alias("b"))
    j = links.select("source", "target").join(block.select(F.col("id").alias("source"), F.col("b").alias("s")), "source").join(block.select(F.col("id").alias("target"), F.col("b").alias("t")), "target")
    s, t = F.col("s"), F.col("t")
    (sx, sy), (tx, ty) = ((b["x"] + b["width"] / 2, b["y"] + b["height"] / 2) for b in (s, t))
    x1, y1 = _edge_of(s, sx, sy, tx - sx, ty - sy, 0)
    x2, y2 = _edge_of(t, tx, ty, sx - tx, sy - ty, padding)
    return j.select("source", "target", x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"))


def circle_segment(source: dict[str, Column], target: dict[str, Column], padding: float = 6) -> dict[str, Column]:
    """x1, y1, x2, y2 of a link between circles (x, y, radius); the end stays ``padding`` off its circle."""
    dx, dy = target["x"] - source["x"], target["y"] - source["y"]
    far = F.greatest(F.lit(0.001), F.hypot(dx, dy))
    out, back = F.greatest(F.lit(0.0), F.coalesce(source["radius"], F.lit(0.0))), F.greatest(F.lit(0.0), F.coalesce(target["radius"], F.lit(0.0))) + padding
    return {"x1": source["x"] + dx / far * out, "y1": source["y"] + dy / far * out, "x2": target["x"] - dx / far * back, "y2": target["y"] - dy / far * back}


def focused(kind: str, selected: list[str], mode: str = "coauthors") -> Column:
    """Whether a link (source, target) is marked: where links are directed only those that go out from the selection."""
    goes_out = F.col("source").isin(selected)
    return goes_out if kind == "topic" or mode == "citations" else goes_out | F.col("target").isin(selected)


def palette_index(c: Column) -> Column:
    """The colour of a theme or band by its number, over and over."""
    return F.pmod(F.greatest(F.lit(0), F.floor(F.coalesce(c, F.lit(0)))), F.lit(PALETTE)).cast("int")
