"""Items that appear together: counts of pairs and their ratio to chance.

Pairs are put into one order and summed with map-side combination. Marginals are
sums of pair totals. Only pairs that can reach the count asked for look up their
marginals, and names that stand in a large share of those pairs are looked up by
broadcast, of which there can be only a bounded number; all others by shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

#: A name is hot if it stands in more than this share of the pairs; there are at most 2 / HOT_SHARE such names.
HOT_SHARE = 0.001


def clean_name(name: str) -> Column:
    """Trimmed, runs of white space as one space, upper case."""
    return F.upper(F.trim(F.regexp_replace(F.col(name), r"[\s ]+", " ")))


def pair_records(edges: DataFrame) -> DataFrame:
    """(name_a, name_b, weight) from delivered pairs, each edge_id once.

    Rows with a null name or weight are dropped first, then one row of each edge_id
    is kept (the least, should deliveries differ); rows without an edge_id count
    each. Names that are blank after trimming, and self pairs, are dropped.
    """
    known = edges.filter("from_name IS NOT NULL AND to_name IS NOT NULL AND weight IS NOT NULL").select(
        "edge_id", clean_name("from_name").alias("x"), clean_name("to_name").alias("y"), F.col("weight").cast("long").alias("w")
    )
    once = (
        known.filter("edge_id IS NOT NULL")
        .groupBy("edge_id")
        .agg(F.min(F.struct("x", "y", "w")).alias("r"))
        .select("r.x", "r.y", "r.w")
        .unionByName(known.filter("edge_id IS NULL").select("x", "y", "w"))
    )
    return once.filter("x <> y AND x <> '' AND y <> ''").select(
        F.least("x", "y").alias("name_a"), F.greatest("x", "y").alias("name_b"), F.col("w").alias("weight")
    )


def basket_pairs(baskets: DataFrame, id_col: str = "doc_id", items_col: str = "persons") -> DataFrame:
    """(name_a, name_b, weight = 1) for every two different items of a basket, items taken once.

    The rows of one id are one basket. Each item is one row, so a large basket's
    pairs are made by a join on the basket, which adaptive execution can split.
    """
    items = (
        baskets.filter(F.col(id_col).isNotNull())
        .select(F.col(id_col).alias("basket"), F.explode(items_col).alias("raw"))
        .select("basket", clean_name("raw").alias("item"))
        .filter("item IS NOT NULL AND item <> ''")
        .dropDuplicates()
    )
    x, y = items.withColumnRenamed("item", "name_a"), items.withColumnRenamed("item", "name_b")
    joined = x.join(y, (x.basket == y.basket) & (x.name_a < y.name_b))
    return joined.select("name_a", "name_b", F.lit(1).cast("long").alias("weight"))


def pair_association(pairs: DataFrame, min_weight: int = 1) -> DataFrame:
    """Totals, marginals, lift and pointwise mutual information of each pair.

    Input name_a < name_b and weight. w(a) sums over all pairs with a, N over all
    pairs; lift = w(a,b) * 2N / (w(a) * w(b)), pmi its base-2 logarithm. Pairs
    under min_weight count in the marginals but are not returned. Lift is null
    where a marginal is 0.
    """
    totals = cut_lineage(pairs.groupBy("name_a", "name_b").agg(F.sum("weight").alias("weight")))
    single = totals.select(F.explode(F.array("name_a", "name_b")).alias("name"), "weight")
    heavy_enough = F.col("weight") >= min_weight
    marginals = cut_lineage(
        single.groupBy("name").agg(F.sum("weight").alias("total"), F.sum(heavy_enough.cast("long")).alias("listed")).filter("listed > 0")
    )
    whole = totals.agg(F.sum("weight").alias("n"), F.sum(heavy_enough.cast("long")).alias("rows")).first()
    total, listed = whole.n or 0, whole.rows or 0
    hot_rows = max(10_000, int(HOT_SHARE * listed))
    hot = F.broadcast(marginals.filter(F.col("listed") > hot_rows).select("name", F.col("total").alias("hot")))
    cold = marginals.filter(F.col("listed") <= hot_rows).select("name", F.col("total").alias("cold"))

    def with_marginal(df: DataFrame, name: str, out: str) -> DataFrame:
        known = df.join(hot.withColumnRenamed("name", name), name, "left")
        frequent = known.filter("hot IS NOT NULL").withColumnRenamed("hot", out)
        rest = known.filter("hot IS NULL").drop("hot").join(cold.withColumnRenamed("name", name), name)
        return frequent.unionByName(rest.withColumnRenamed("cold", out))

    listed_pairs = totals.filter(heavy_enough)
    joined = with_marginal(with_marginal(listed_pairs, "name_a", "weight_a"), "name_b", "weight_b")
    product = F.col("weight_a").cast("double") * F.col("weight_b").cast("double")
    lift = F.when(product != 0, F.col("weight") * F.lit(2.0 * total) / product)
    return joined.select(
        "name_a", "name_b", "weight", "weight_a", "weight_b", lift.alias("lift"), F.when(lift > 0, F.log2(lift)).alias("pmi"),
        (F.col("weight").cast("decimal(38,0)") * F.lit(2 * total).cast("decimal(20,0)")
         >= F.lit(10).cast("decimal(2,0)") * F.col("weight_a").cast("decimal(18,0)") * F.col("weight_b").cast("decimal(18,0)")).alias("tenfold"),
    )
