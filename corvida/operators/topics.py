"""Topics from document vectors, and their words by class-based tf-idf."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .entities import top_per_group


def cluster_vectors(vectors: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding", seed: int = 42, min_size: int = 3) -> DataFrame:
    """(id, topic): k-means over vectors; clusters under min_size become topic -1, the others are numbered by size."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    from ..session import cut_lineage

    rows = vectors.filter(F.col(vec_col).isNotNull()).select(F.col(id_col).alias("id"), array_to_vector(F.col(vec_col).cast("array<double>")).alias("features"))
    if rows.isEmpty():
        return rows.select("id", F.lit(-1).alias("topic"))
    model = KMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster").fit(rows)
    found = cut_lineage(model.transform(rows).select("id", "cluster"))
    sizes = sorted(found.groupBy("cluster").count().collect(), key=lambda r: (-r["count"], r["cluster"]))  # at most k rows
    number = {r["cluster"]: (i if r["count"] >= min_size else -1) for i, r in enumerate(sizes)}
    labels = F.create_map(*[x for c, t in number.items() for x in (F.lit(c), F.lit(t))])
    return found.select("id", labels[F.col("cluster")].alias("topic"))


def density_topics(vectors: DataFrame, threshold: float = 0.5, min_points: int = 3, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, topic) by density: topics of any shape, and -1 for what lies in none.

    A vector is a core if min_points vectors, itself among them, are within the cosine
    threshold. Cores within it of each other are one topic; another vector goes with
    the most similar core within it, ties to the least id. Topics are numbered by
    size, equal ones by their least id. Null vectors are left out.
    """
    from ..session import cut_lineage
    from .graph import connected_components
    from .similarity import cluster_ranks, embedding_pairs

    ids = vectors.filter(F.col(vec_col).isNotNull()).select(F.col(id_col).cast("long").alias("id")).distinct()
    pairs = embedding_pairs(vectors, threshold, id_col, vec_col).select(F.col("vec_a").alias("a"), F.col("vec_b").alias("b"), F.round("similarity", 6).alias("s"))
    near = cut_lineage(pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "s")))
    cores = cut_lineage(ids.join(near.groupBy(F.col("a").alias("id")).agg(F.count(F.lit(1)).alias("n")), "id", "left").filter(F.coalesce("n", F.lit(0)) + 1 >= min_points).select("id"))
    beside = near.join(cores.withColumnRenamed("id", "b"), "b", "left_semi")
    inner = beside.join(cores.withColumnRenamed("id", "a"), "a", "left_semi").filter("a < b")
    groups = cut_lineage(connected_components(inner.select(F.col("a").alias("src"), F.col("b").alias("dst")), cores))
    outer = beside.join(cores.withColumnRenamed("id", "a"), "a", "left_anti")
    best = outer.groupBy("a").agg(F.min(F.struct((-F.col("s")).alias("m"), F.col("b").alias("id"))).alias("c")).select(F.col("a").alias("own"), F.col("c.id").alias("id"))
    placed = cut_lineage(groups.unionByName(best.join(groups, "id").select(F.col("own").alias("id"), "component")))
    number = F.regexp_extract("cluster_id", r"(\d+)$", 1).cast("int").alias("topic")
    named = placed.join(cluster_ranks(placed).select("component", number), "component").select("id", "topic")
    return ids.join(named, "id", "left").select("id", F.coalesce("topic", F.lit(-1)).alias("topic"))


def class_tfidf(words: DataFrame, top: int = 10) -> DataFrame:
    """(topic, word, score, place): the best words of each topic of words(topic, word) by tf * ln(1 + A / f).

    tf is the word's share of the topic, f its count in all topics, A the mean
    number of words a topic. Topic -1 holds outliers and has words like any other.
    """
    counts = words.groupBy("topic", "word").agg(F.count(F.lit(1)).alias("n"))
    sizes = counts.groupBy("topic").agg(F.sum("n").alias("size"))
    totals = counts.groupBy("word").agg(F.sum("n").alias("f"))
    mean = sizes.agg(F.avg("size").alias("a")).first().a or 0.0
    scored = counts.join(F.broadcast(sizes), "topic").join(totals, "word")  # one row a topic
    scored = scored.withColumn("score", F.round(F.col("n") / F.col("size") * F.log(1 + F.lit(mean) / F.col("f")), 6))
    best = top_per_group(scored.select("topic", "word", "score"), ["topic"], [F.desc("score"), F.asc("word")], top)
    from pyspark.sql import Window as W

    return best.withColumn("place", F.row_number().over(W.partitionBy("topic").orderBy(F.desc("score"), "word")))


def topic_info(assigned: DataFrame) -> DataFrame:
    """(topic, documents, share)."""
    counts = assigned.groupBy("topic").agg(F.count(F.lit(1)).alias("documents"))
    total = assigned.count() or 1
    return counts.select("topic", "documents", F.round(F.col("documents") / total, 6).alias("share"))
