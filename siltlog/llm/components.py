"""Connected components of a graph given as a DataFrame of links, without collecting it anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltlog.llm.common import dropped, swept, written

#: Rows of one key are dealt to so many tasks when they are joined with what was found for the key.
SALTS = 16


def salted_join(rows: DataFrame, found: DataFrame, key: str, spread: str) -> DataFrame:
    """rows left-joined with found, which has one row for each key; a hot key's rows go to SALTS tasks.

    `spread` is a column of rows whose values differ within a key.
    """
    left = rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
    right = found.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.join(right, [key, "_salt"], "left").drop("_salt")


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node that has a link to another: root is the smallest node it can reach.

    links has the columns u and v of one orderable type; nulls and links of a node to itself are left out, repeated
    links are harmless. Each round lets every node take the smallest root among its neighbours' roots and then follows
    roots of roots once more. Roots only get smaller, and a round that changes nothing ends it. Both steps shuffle
    one row for each link or node; hot nodes and hot roots are salted, and minima are taken before they are shuffled.
    """
    both = links.where("u is not null and v is not null and u != v").select("u", "v").distinct()
    both = written(both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "links")
    roots = written(both.groupBy("u").agg(F.min("v").alias("low")).select(F.col("u").alias("node"), F.least("u", "low").alias("root"), F.col("u").alias("was")), "roots")
    while True:
        near = salted_join(both.withColumnRenamed("v", "node"), roots.drop("was"), "node", "u").groupBy("u").agg(F.min("root").alias("low"))
        step = roots.drop("was").join(near.withColumnRenamed("u", "node"), "node").select("node", F.least("root", "low").alias("root"), F.col("root").alias("was"))
        # hooking: a root whose member found a smaller one takes that too
        hooked = step.groupBy(F.col("was").alias("node")).agg(F.min("root").alias("hook"))
        step = written(step.join(hooked, "node", "left").select("node", F.least("root", "hook").alias("root"), "was"), "step")
        up = step.select(F.col("node").alias("root"), F.col("root").alias("above"))
        after = written(salted_join(step, up, "root", "node").select("node", F.least("root", "above").alias("root"), "was"), "roots")
        dropped(step, roots)  # what the next round doesn't read
        roots = after
        if roots.where("root != was").isEmpty():
            dropped(both)
            swept(links.sparkSession)
            return roots.select("node", "root")
