"""Positions of blocks and cards: ranked and layered columns, gravity, force, and the year bands of a timeline."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioplan.compat import cut
from folioplan.operators.ranking import numbered


def _height(n: Column) -> Column:
    return F.greatest(F.lit(68), F.least(F.lit(96), 64 + n * 5))


def ranked(blocks: DataFrame, metric: str) -> DataFrame:
    """Blocks in columns by dense rank of a metric, in rows by papers and name.

    Ranks come from the aggregate of distinct metric values; most blocks share the lowest of them, so that rows within
    a column are numbered by parts where a column is large.
    """
    valued = cut(blocks.select("id", "name", "n_papers", F.coalesce(metric, F.lit(0)).alias("rank_value")))
    columns = numbered(valued.select("rank_value").distinct(), [], [F.desc("rank_value")], "column")
    placed = numbered(valued, ["rank_value"], [F.desc("n_papers"), F.col("name"), F.col("id")], "row").join(columns, "rank_value")
    placed = placed.withColumn("column", F.col("column") - 1).withColumn("row", F.col("row") - 1)
    return placed.select("id", "name", "n_papers", "rank_value", "column", "row", (34 + F.col("column") * 245).alias("x"), (54 + F.col("row") * 110).alias("y"), F.lit(210).alias("width"), _height(F.col("n_papers")).alias("height"))


def extent(placed: DataFrame, width: int = 1200, height: int = 720) -> DataFrame:
    """width, height of a ranked layout."""
    columns = F.coalesce(F.max("column") + 1, F.lit(0))
    rows = F.coalesce(F.max("row") + 1, F.lit(0))
    return placed.agg(
        F.when(F.count("*") == 0, max(800, width)).otherwise(F.greatest(F.lit(width), 68 + columns * 245)).alias("width"),
        F.when(F.count("*") == 0, max(520, height)).otherwise(F.greatest(F.lit(height), 94 + rows * 110)).alias("height"),
    )


def levels(blocks: DataFrame, links: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """id, level: longest path from a block without predecessors; blocks on or behind a cycle have NULL (G2, the DAG part)."""
    e = cut(links.where("source <> target").select("source", "target").distinct().join(blocks.select(F.col("id").alias("source")), "source", "left_semi").join(blocks.select(F.col("id").alias("target")), "target", "left_semi"))
    indegree = e.groupBy(F.col("target").alias("id")).agg(F.count("*").alias("need"))
    state = cut(blocks.select("id").join(indegree, "id", "left").select("id", F.coalesce("need", F.lit(0)).cast("bigint").alias("need"), F.lit(0).alias("level"), F.lit(False).alias("done")))
    for _ in range(max_rounds + 1):
        ready = state.where("NOT done AND need = 0").select(F.col("id").alias("source"), F.col("level").alias("from"))
        gone = e.join(ready, "source").groupBy(F.col("target").alias("id")).agg(F.count("*").alias("less"), F.max("from").alias("from"))
        if not ready.limit(1).count():
            break
        state = cut(
            state.join(gone, "id", "left").select(
                "id", (F.col("need") - F.coalesce("less", F.lit(0))).alias("need"), F.greatest(F.col("level"), F.coalesce(F.col("from") + 1, F.lit(0))).alias("level"), (F.col("done") | (F.col("need") == 0)).alias("done")
            )
        )
    else:
        raise RuntimeError(f"a path of more than {max_rounds} links")
    return state.select("id", F.when(F.col("done"), F.col("level")).alias("level"))


def hierarchy(blocks: DataFrame, links: DataFrame, height: int = 720) -> DataFrame:
    """Layered layout: levels, then columns of 4 to 8 rows in order of level, papers and name.

    What lies on cycles is placed after its predecessors in that order, on the driver: only those blocks and their
    links travel, and a layout for people has few of them.
    """
    known = cut(levels(blocks, links).join(blocks.select("id", "name", "n_papers"), "id"))
    open_ = known.where("level IS NULL")
    edges = links.where("source <> target").select("source", "target").distinct().join(open_.select(F.col("id").alias("target")), "target", "left_semi")
    rows = open_.orderBy(F.desc("n_papers"), "name", "id").limit(100_001).collect()
    if len(rows) > 100_000:
        raise ValueError("more than 100 000 blocks lie on cycles; a layout needs a narrower view")
    spark = blocks.sparkSession
    level = {r.id: r.level for r in known.where("level IS NOT NULL").join(edges.select(F.col("source").alias("id")).distinct(), "id", "left_semi").collect()} if rows else {}
    before: dict[str, list[str]] = {}
    after: dict[str, list[str]] = {}
    inside = {r.id for r in rows}
    for r in edges.orderBy("source", "target").collect() if rows else []:
        before.setdefault(r.target, []).append(r.source)
        if r.source in inside:
            after.setdefault(r.source, []).append(r.target)
    for r in rows:
        if r.id in level:
            continue
        done = [level[p] for p in before.get(r.id, ()) if p in level]
        level[r.id] = max(done) + 1 if done else 0
        queue = [r.id]
        while queue:
            s = queue.pop(0)
            for t in after.get(s, ()):
                if t not in level:
                    level[t] = level[s] + 1
                    queue.append(t)
    cyclic = spark.createDataFrame([(r.id, level[r.id]) for r in rows], "id string, cyclic int")
    full = known.join(cyclic, "id", "left").withColumn("level", F.coalesce("level", "cyclic"))
    per_column = max(4, min(8, (max(520, height) - 100) // 92))
    placed = numbered(full, [], [F.col("level"), F.desc("n_papers"), F.col("name"), F.col("id")], "k").withColumn("k", F.col("k") - 1).withColumn("column", F.floor(F.col("k") / per_column).cast("int")).withColumn("row", F.col("k") % per_column)
    return placed.select("id", "level", "column", "row", (34 + F.col("column") * 245).alias("x"), (54 + F.col("row") * 110).alias("y"), _height(F.col("n_papers")).alias("height"))


#: Fixed values of the force layouts below: iterations by size, spacing, damping, pull and push.
# ---- force layouts (G3-G6): numerically sequential, one task over one view ----------------------------------------


def iteration_budget(n: int, effort: float = 2.0) -> int:
    for most, base in ((40, 130), (100, 170), (250, 230), (500, 290)):
        if n <= most:
            return int(base * effort + 0.5)
    return int(340 * effort + 0.5)


def gravity_budget(n: int) -> int:
    return min(900, max(220, int(iteration_budget(n) * 2.5 + 0.5)))


def logical_size(width: int, height: int, n: int, spacing: float = 1.0) -> tuple[float, float]:
    w, h = max(800, width), max(520, height)
    scale = max(1.0, min(3.2, math.sqrt(max(1, n) * 8500 * spacing / (w * h))))
    return float(int(w * scale + 0.5)), float(int(h * scale + 0.5))


def fnv(text: str) -> int:
    h = 2166136261
    for c in text:
        h = ((h ^ ord(c)) * 16777619) & 0xFFFFFFFF
    return h


def repel(x: np.ndarray, y: np.ndarray, vx: np.ndarray, vy: np.ndarray, radius: np.ndarray, cooling: float, cell: float, padding: float) -> None:
    """Pushes apart what overlaps; candidates come from a grid of cells, each with its half of the neighbours."""
    cx, cy = np.floor(x / cell).astype(int), np.floor(y / cell).astype(int)
    grid: dict[tuple[int, int], list[int]] = {}
    for k, c in enumerate(zip(cx.tolist(), cy.tolist())):
        grid.setdefault(c, []).append(k)
    cells = {c: np.array(m) for c, m in grid.items()}
    for (a, b), members in cells.items():
        for da, db in ((0, 0), (1, -1), (1, 0), (1, 1), (0, 1)):
            j = cells.get((a + da, b + db))
            if j is None:
                continue
            own, wide = (da, db) == (0, 0), max(1, PAIRS // len(j))
            # Pairs are taken a block of rows at a time; sums keep the order of one pass over all pairs, first pushes of the
            # left sides, then of the right ones, so that the blocks change no digit.
            for sides in (("left",), ("right",)) if own else (("left", "right"),):
                for at in range(0, len(members), wide):
                    i = members[at : at + wide]
                    dx, dy = x[j][None, :] - x[i][:, None], y[j][None, :] - y[i][:, None]
                    square = dx * dx + dy * dy
                    same = square < 1  # on top of each other: apart by the parity of their places
                    if same.any():
                        dx, dy, square = np.where(same, np.where((i[:, None] + j[None, :]) % 2, 1.0, -1.0), dx), np.where(same, 1.0, dy), np.where(same, 2.0, square)
                    d = np.sqrt(square)
                    push = np.where(square > cell * cell, 0.0, np.where(d < radius[i][:, None] + radius[j][None, :] + padding, 2.2, 120 / square)) * cooling
                    if own:
                        push = np.where(i[:, None] < j[None, :], push, 0.0)
                    for v, step in ((vx, dx / d * push), (vy, dy / d * push)):
                        if "left" in sides:
                            v[i] = np.subtract.reduce(np.concatenate([v[i][:, None], step], axis=1), axis=1)
                        if "right" in sides:
                            v[j] = np.subtract.reduce(np.concatenate([v[j][None, :], -step]), axis=0)


PAIRS = 1 << 16  # pairs of blocks held at once


def gravity(blocks: DataFrame, links: DataFrame, width: int = 1200, height: int = 720) -> DataFrame:
    """id, x, y: springs, repulsion and gravity from seeded places; the same input gives the same layout.

    A force layout is one simulation over one view, so it runs in one task, whatever the number of blocks: it holds a few
    numbers per block and per link, and its time grows with the pairs of blocks that are near each other.
    """
    nodes = cut(numbered(blocks.select("id", F.col("n_papers").cast("double").alias("w")), [], [F.col("id")], "t").withColumn("t", F.col("t") - 1))
    springs = links.join(nodes.select(F.col("id").alias("source"), F.col("t").alias("s")), "source").join(nodes.select(F.col("id").alias("target"), "t"), "target")
    rows = nodes.select(F.lit(-1).alias("s"), "t", "w", "id").unionByName(springs.select("s", "t", F.col("weight").cast("double").alias("w"), F.lit(None).cast("string").alias("id")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids: list[str] = []
        weights, parts = [], []
        for b in batches:
            node = b["s"].to_numpy() < 0
            ids += b["id"][node].tolist()
            weights.append(b["w"].to_numpy(dtype=float)[node])
            parts.append((b["s"].to_numpy()[~node], b["t"].to_numpy()[~node], b["w"].to_numpy(dtype=float)[~node]))
        n = len(ids)
        if not n:
            return
        s, t, w = (np.concatenate(p) for p in zip(*parts))
        parts.clear()
        big_w, big_h = logical_size(width, height, n)
        seeds = np.array([fnv(i) for i in ids], dtype=np.int64)
        angle = (seeds % 360) / 180 * np.pi
        ring = 80 + (seeds >> 9) % max(100, int(min(big_w, big_h) * 0.36))
        tall = np.clip(64 + np.concatenate(weights) * 5, 68, 96)
        radius = np.hypot(105, tall / 2)
        x, y = big_w / 2 + np.cos(angle) * ring, big_h / 2 + np.sin(angle) * ring
        vx, vy = np.zeros(n), np.zeros(n)
        strength = np.minimum(2.5, 0.65 + np.log2(np.where(np.isnan(w), 1, w) + 1))
        rounds = gravity_budget(n)
        for k in range(rounds):
            cooling = max(0.08, 1 - k / rounds)
            vx = vx * 0.76 + (big_w / 2 - x) * 0.0007 * cooling
            vy = vy * 0.76 + (big_h / 2 - y) * 0.0007 * cooling
            repel(x, y, vx, vy, radius, cooling, 320, 34)
            dx, dy = x[t] - x[s], y[t] - y[s]
            d = np.maximum(1.0, np.hypot(dx, dy))
            pull = (d - 245) * 0.0018 * strength * cooling
            for v, step in ((vx, dx / d * pull), (vy, dy / d * pull)):
                np.add.at(v, s, step)
                np.subtract.at(v, t, step)
            x = np.clip(x + vx, 24, big_w - 234)
            y = np.clip(y + vy, 30, big_h - tall - 30)
        yield pd.DataFrame({"id": ids, "x": x, "y": y})

    return rows.repartition(1).sortWithinPartitions("s", "t").mapInPandas(run, "id string, x double, y double")


def aggregate_layout(kind: str, technique: str, blocks: DataFrame, links: DataFrame) -> DataFrame:
    """Dispatch by technique; ranked layouts order authors by co-authors and topics by papers."""
    if technique == "gravity":
        return gravity(blocks, links)
    if technique == "hierarchy":
        return hierarchy(blocks, links)
    return ranked(blocks, "coauthors" if kind == "author" else "n_papers")


# ---- timeline (W4-W6, V7) -----------------------------------------------------------------------------------------

#: Gutter, width of a year, height of a row, space above the first band.
LEFT, YEAR_STEP, ROW_STEP, TOP = 166, 205, 62, 28


def year_buckets(papers: DataFrame) -> DataFrame:
    """year, bucket: dense rank of the distinct years."""
    years = papers.where("year IS NOT NULL").select("year").distinct()
    return years.select("year", (F.row_number().over(Window.orderBy("year")) - 1).alias("bucket"))


def timeline(papers: DataFrame, assignment: DataFrame) -> DataFrame:
    """id, band, bucket, slot, x, y of every card; assignment: id, band.  A paper without a year stands in the middle (V7)."""
    buckets = year_buckets(papers)
    middle = (buckets.agg(F.max("bucket")).first()[0] or 0) // 2
    cells = papers.select("id", "year", "title").join(assignment, "id").join(buckets, "year", "left")
    cells = cells.withColumn("bucket", F.coalesce("bucket", F.lit(middle)))
    # All papers without a year stand in the middle: one slot of a band may hold a third of all rows.
    cells = cut(numbered(cells, ["band", "bucket"], [F.coalesce("year", F.lit(0)), F.col("title"), F.col("id")], "slot").withColumn("slot", F.col("slot") - 1))
    rows = cells.groupBy("band").agg((F.max("slot") + 1).alias("rows")).withColumn("height", F.greatest(F.lit(142), 64 + F.col("rows") * ROW_STEP))
    above = F.coalesce(F.sum(F.col("height") + 12).over(Window.orderBy("band").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bands = rows.select("band", "height", (TOP + above).alias("band_y"))
    return cells.join(bands, "band").select("id", "band", "bucket", "slot", (LEFT + F.col("bucket") * YEAR_STEP).cast("bigint").alias("x"), (F.col("band_y") + 64 + F.col("slot") * ROW_STEP).cast("bigint").alias("y"))
