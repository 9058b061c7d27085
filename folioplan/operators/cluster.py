"""Themes of papers: TF-IDF in long form, farthest-first seeds, spherical k-means, and labels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioplan.compat import cut
from folioplan.functions import normalize as N

WEIGHTS = {"title": 3, "keywords": 5, "abstract": 1, "authors": 2, "venue": 2}
DEFAULT_FIELDS = ("title", "keywords", "abstract")


def _weighted(tokens: Column, weight: int) -> Column:
    return F.transform(tokens, lambda t: F.struct(t.alias("term"), F.lit(weight).alias("w")))


def term_counts(papers: DataFrame, fields: tuple[str, ...] = DEFAULT_FIELDS) -> DataFrame:
    """id, term, tf: tokens of the chosen fields, each field with its weight (V1)."""
    fields = tuple(f for f in fields if f in WEIGHTS) or DEFAULT_FIELDS
    parts = []
    for f in fields:
        listed = f in ("keywords", "authors")
        tokens = F.flatten(F.transform(F.coalesce(f, F.array().cast("array<string>")), N.theme_tokens)) if listed else N.theme_tokens(F.col(f))
        parts.append(_weighted(tokens, WEIGHTS[f]))
    cells = papers.select("id", F.explode(reduce(lambda a, b: F.concat(a, b), parts)).alias("x"))
    return cells.groupBy("id", "x.term").agg(F.sum("x.w").alias("tf"))


def vectors(papers: DataFrame, fields: tuple[str, ...] = DEFAULT_FIELDS) -> DataFrame:
    """id, term, w: tf times ln((N+1)/(df+1))+1, of length one; a paper without terms has one term of its own (V2)."""
    tf = term_counts(papers, fields)
    n = papers.count()
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    raw = tf.join(df, "term").select("id", "term", (F.col("tf") * (F.log((F.lit(n) + 1) / (F.col("df") + 1)) + 1)).alias("w"))
    norm = raw.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    full = raw.join(norm, "id").select("id", "term", (F.col("w") / F.col("norm")).alias("w"))
    bare = papers.select("id").join(norm.select("id"), "id", "left_anti").select("id", F.concat(F.lit("__paper_"), "id").alias("term"), F.lit(1.0).alias("w"))
    return full.unionByName(bare)


def cosine_to(vecs: DataFrame, centroids: DataFrame) -> DataFrame:
    """id, band, sim; centroids: band, term, w, joined by term whatever their size (V3)."""
    joined = vecs.join(centroids.withColumnRenamed("w", "cw"), "term").groupBy("id", "band").agg(F.round(F.sum(F.col("w") * F.col("cw")), 12).alias("sim"))
    return joined


def seeds(vecs: DataFrame, k: int) -> list[str]:
    """Ids of the farthest-first seeds: the paper of most terms, then whoever is least like any seed; ties by id (V4)."""
    first = vecs.groupBy("id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "id").select("id").first()
    if first is None:
        return []
    chosen = [first.id]
    best = cut(vecs.select("id").distinct().withColumn("sim", F.lit(0.0)))
    while len(chosen) < k:
        seed = vecs.where(F.col("id") == chosen[-1]).select("term", F.col("w").alias("sw"))
        near = vecs.join(F.broadcast(seed), "term").groupBy("id").agg(F.round(F.sum(F.col("w") * F.col("sw")), 12).alias("s"))
        best = cut(best.join(near, "id", "left").select("id", F.greatest("sim", F.coalesce("s", F.lit(0.0))).alias("sim")))
        nxt = best.where(~F.col("id").isin(chosen)).orderBy("sim", "id").select("id").first()
        if nxt is None:
            break
        chosen.append(nxt.id)
    return chosen


def kmeans(papers: DataFrame, k: int = 5, fields: tuple[str, ...] = DEFAULT_FIELDS, rounds: int = 12, most: int = 2_000_000) -> tuple[DataFrame, DataFrame]:
    """(id, band) of every paper, and (band, term, w) of the centroids: spherical k-means from the seeds (V5).

    Ties go to the lower band, an empty band keeps its centroid, and it stops when nothing moves.  Similarities are
    rounded to twelve digits before ties are broken, so that the order of summation cannot move a paper.  Where the
    centroids have at most ``most`` cells (bands times distinct terms, counted first) they are broadcast as a matrix and
    a round is one pass over the papers; beyond that they are joined by term, with the same result.
    """
    vecs = cut(vectors(papers, fields))
    terms = vecs.select("term").distinct()
    if terms.count() * k <= most:
        return _by_matrix(vecs, sorted(r.term for r in terms.collect()), k, rounds)
    return _by_joins(papers.sparkSession, vecs, k, rounds)


def _by_matrix(vecs: DataFrame, terms: list[str], k: int, rounds: int) -> tuple[DataFrame, DataFrame]:
    """k-means with the centroids as a matrix of terms by bands; papers are arrays of term numbers and weights."""
    import numpy as np
    import pandas as pd

    spark = vecs.sparkSession
    names = spark.sparkContext.broadcast(terms)

    def encode(batches):
        place = {t: i for i, t in enumerate(names.value)}
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "t": [[place[x["term"]] for x in v] for v in b["v"]], "w": [[x["w"] for x in v] for v in b["v"]]})

    grouped = vecs.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("term", "w"))).alias("v"))
    docs = cut(grouped.mapInPandas(encode, "id string, t array<int>, w array<double>"))

    def similar(t, w, m):
        return np.round(np.asarray(w) @ m[np.asarray(t)], 12)

    def matrix(columns) -> np.ndarray:
        m = np.zeros((len(terms), len(columns)))
        for band, (t, w) in enumerate(columns):
            m[t, band] = w
        return m

    first = docs.orderBy(F.desc(F.size("t")), "id").first()
    if first is None:
        return spark.createDataFrame([], "id string, band int"), spark.createDataFrame([], "band int, term string, w double")
    chosen = [first]
    while len(chosen) < k:
        shared = spark.sparkContext.broadcast((matrix([(c.t, c.w) for c in chosen]), {c.id for c in chosen}))

        def farthest(batches, shared=shared):
            m, taken = shared.value
            best = None
            for b in batches:
                for i, t, w in zip(b["id"], b["t"], b["w"]):
                    if i not in taken:
                        one = (max(0.0, float(similar(t, w, m).max())), i)
                        best = one if best is None or one < best else best
            yield pd.DataFrame([best] if best else [], columns=["sim", "id"])

        nxt = docs.mapInPandas(farthest, "sim double, id string").orderBy("sim", "id").first()
        shared.unpersist()
        if nxt is None:
            break
        chosen.append(docs.where(F.col("id") == nxt.id).first())

    centroids, before = matrix([(c.t, c.w) for c in chosen]), None
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast((centroids, before))

        def gather(batches, shared=shared):
            now, then = shared.value
            sums, size, moved = np.zeros(now.shape), np.zeros(now.shape[1], int), 0
            for b in batches:
                for t, w in zip(b["t"], b["w"]):
                    band = int(np.argmax(similar(t, w, now)))
                    sums[np.asarray(t), band] += w
                    size[band] += 1
                    moved += then is None or int(np.argmax(similar(t, w, then))) != band
            t, band = np.nonzero(sums)
            yield pd.DataFrame({"band": band.astype("int32"), "t": t.astype("int32"), "w": sums[t, band]})
            yield pd.DataFrame({"band": np.arange(len(size), dtype="int32"), "t": np.full(len(size), -1, "int32"), "w": size.astype(float)})
            yield pd.DataFrame({"band": [-1], "t": [-1], "w": [float(moved)]})

        rows = docs.mapInPandas(gather, "band int, t int, w double").groupBy("band", "t").agg(F.sum("w").alias("w")).toPandas()
        shared.unpersist()
        moved = rows.loc[rows["band"] == -1, "w"].sum()
        size = np.zeros(centroids.shape[1])
        counts = rows[(rows["t"] == -1) & (rows["band"] >= 0)]
        size[counts["band"].to_numpy()] = counts["w"].to_numpy()
        cells = rows[rows["t"] >= 0]
        fresh = np.zeros(centroids.shape)
        fresh[cells["t"].to_numpy(), cells["band"].to_numpy()] = cells["w"].to_numpy()
        fresh /= np.maximum(size, 1)
        fresh /= np.maximum(np.sqrt((fresh * fresh).sum(axis=0)), 1e-300)
        before, centroids = centroids, np.where(size > 0, fresh, centroids)
        if not moved:
            break
    shared = spark.sparkContext.broadcast(before)

    def assign(batches):
        m = shared.value
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "band": [int(np.argmax(similar(t, w, m))) for t, w in zip(b["t"], b["w"])]})

    t, band = np.nonzero(centroids)
    made = pd.DataFrame({"band": band.astype("int32"), "term": [terms[i] for i in t], "w": centroids[t, band]})
    return docs.mapInPandas(assign, "id string, band int"), spark.createDataFrame(made, "band int, term string, w double")


def _by_joins(spark: SparkSession, vecs: DataFrame, k: int, rounds: int) -> tuple[DataFrame, DataFrame]:
    """k-means with the centroids as a table, joined by term."""
    # Kept partitioned by paper: similarities to a few centroids then need no exchange in any round.
    vecs = vecs.repartition("id").persist()
    chosen = seeds(vecs, k)
    place = spark.createDataFrame([(s, b) for b, s in enumerate(chosen)], "id string, band int")
    centroids = cut(vecs.join(F.broadcast(place), "id").select("band", "term", "w"))
    assigned = vecs.select("id").distinct().withColumn("band", F.lit(-1))
    for _ in range(rounds):
        best = cosine_to(vecs, centroids).groupBy("id").agg(F.min(F.struct((-F.col("sim")).alias("s"), "band")).alias("b"))
        # No term in common with any centroid: similarity 0 to all, so the first band.
        new = assigned.withColumnRenamed("band", "old").join(best, "id", "left").select("id", "old", F.when(F.col("b.s") < 0, F.col("b.band")).otherwise(0).alias("band"))
        new = cut(new)
        moved = new.where("band <> old").limit(1).count()
        assigned = new.select("id", "band")
        size = assigned.groupBy("band").agg(F.count("*").alias("n"))
        mean = vecs.join(assigned, "id").groupBy("band", "term").agg(F.sum("w").alias("w")).join(F.broadcast(size), "band").select("band", "term", (F.col("w") / F.col("n")).alias("w"))
        norm = mean.groupBy("band").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
        fresh = mean.join(F.broadcast(norm), "band").select("band", "term", (F.col("w") / F.col("norm")).alias("w"))
        kept = centroids.join(F.broadcast(size), "band", "left_anti")
        centroids = cut(fresh.unionByName(kept))
        if not moved:
            break
    vecs.unpersist()
    return assigned, centroids


def themes(assigned: DataFrame, centroids: DataFrame, top: int = 3) -> DataFrame:
    """band, theme (1-based, in order of label), label, n_papers: bands by their heaviest terms."""
    order = Window.partitionBy("band").orderBy(F.round("w", 12).desc(), "term")
    terms = centroids.where("NOT startswith(term, '__paper_')").withColumn("k", F.row_number().over(order)).where(F.col("k") <= top)
    label = terms.groupBy("band").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "term"))), lambda x: x["term"]), " · ").alias("label"))
    size = assigned.groupBy("band").agg(F.count("*").alias("n_papers"))
    named = size.join(label, "band", "left").withColumn("label", F.coalesce("label", F.lit("Miscellaneous")))
    sort = F.when(F.col("label") == "Miscellaneous", "miscellaneous").otherwise(F.replace("label", F.lit(" · "), F.lit(" ")))
    return named.withColumn("theme", F.row_number().over(Window.orderBy(sort, "band"))).select("band", "theme", "label", "n_papers")


def nearest_embeddings(embeddings: DataFrame, k: int = 5, every: int = 50, dim: int = 64) -> DataFrame:
    """vec_id, other, sim: the k nearest of all vectors for each query vector, by exact cosine in blocks (V3, dense).

    Queries are the vectors whose id is divisible by ``every``; they are a bounded set per block and meet all rows,
    block by block, as matrix products.  Each block keeps only its own best k, so nothing grows with the table.
    """
    import numpy as np
    import pandas as pd

    queries = embeddings.where(F.col("vec_id") % every == 0).select("vec_id", "embedding")
    blocks = max(1, -(-queries.count() // 20_000))
    out = None
    for b in range(blocks):
        rows = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).collect()
        ids = np.array([r.vec_id for r in rows], dtype=np.int64)
        q = np.array([r.embedding for r in rows], dtype=np.float32).reshape(len(rows), -1)
        q = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-12)
        shared = embeddings.sparkSession.sparkContext.broadcast((ids, q))

        def run(batches, shared=shared):
            ids, q = shared.value
            for pdf in batches:
                if not len(ids) or not len(pdf):
                    continue
                m = np.stack(pdf["embedding"].to_numpy()).astype(np.float32)
                m = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
                sims = q @ m.T
                other = pdf["vec_id"].to_numpy()
                sims[ids[:, None] == other[None, :]] = -2
                n = min(k, sims.shape[1])
                best = np.argpartition(-sims, n - 1, axis=1)[:, :n]
                yield pd.DataFrame({"vec_id": np.repeat(ids, n), "other": other[best].ravel(), "sim": np.take_along_axis(sims, best, 1).ravel().astype(float)})

        one = embeddings.select("vec_id", "embedding").mapInPandas(run, "vec_id bigint, other bigint, sim double").where("sim > -2")
        out = one if out is None else out.unionByName(one)
    rank = Window.partitionBy("vec_id").orderBy(F.round("sim", 5).desc(), "other")
    return out.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k).select("vec_id", "rank", "other", F.round("sim", 4).alias("sim"))
