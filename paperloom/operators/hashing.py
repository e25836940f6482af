"""SimHash and MinHash signatures, and near-duplicate links by banding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.session import cut

#: Slots of a MinHash signature, and slots of a band.
SLOTS, ROWS = 64, 4
_PRIME = (1 << 61) - 1


def hash60(token: Column) -> Column:
    """A 60-bit hash of a text that other engines can compute too."""
    return F.conv(F.substring(F.md5(token), 1, 15), 16, 10).cast("bigint")


def simhash(tokens: DataFrame, key: str, token: str = "token", bits: int = 60) -> DataFrame:
    """(key, simhash) of weighted token rows; one pass sums all bits of a document at once, before the shuffle."""
    h = F.col("_h")
    rows = tokens.withColumn("_h", hash60(F.col(token)))
    sums = [F.sum(F.when(F.shiftright(h, b).bitwiseAND(F.lit(1).cast("bigint")) == 1, 1).otherwise(-1)).alias(f"b{b}") for b in range(bits)]
    summed = rows.groupBy(key).agg(*sums)
    total = sum((F.when(F.col(f"b{b}") > 0, F.lit(1 << b).cast("bigint")).otherwise(F.lit(0).cast("bigint")) for b in range(1, bits)), F.when(F.col("b0") > 0, F.lit(1).cast("bigint")).otherwise(F.lit(0).cast("bigint")))
    return summed.select(key, total.alias("simhash"))


def minhash(shingles: DataFrame, key: str, shingle: str = "shingle") -> DataFrame:
    """(key, signature) of shingle rows: SLOTS seeded minima, aggregated before the shuffle."""
    minima = [F.min(F.xxhash64(F.lit(i), F.col(shingle))).alias(f"m{i}") for i in range(SLOTS)]
    return shingles.groupBy(key).agg(*minima).select(key, F.array(*[f"m{i}" for i in range(SLOTS)]).alias("signature"))


def near_duplicates(signatures: DataFrame, sets: DataFrame, key: str, least: float = 0.8) -> DataFrame:
    """(key, class_id, links): the class of each document of which another has a Jaccard of its shingle set from least on.

    signatures: (key, signature). sets: (key, shingles), arrays of the distinct shingles. Documents of one signature
    stand as one; the others meet where a band agrees, each pair once, and are verified on their sets. Classes are
    the connected components, found by passing the least key on along links and then on from each row to the label of its
    label (pointer jumping), until nothing moves.
    """
    alike = signatures.groupBy(F.xxhash64("signature").alias("sig")).agg(F.min(key).alias("rep"), F.first("signature").alias("signature"), F.count(F.lit(1)).alias("copies"))
    alike = cut(alike, "signatures")
    bands = alike.select("rep", F.explode(F.array(*[F.struct(F.lit(b).alias("no"), F.xxhash64(F.slice("signature", b * ROWS + 1, ROWS)).alias("h")) for b in range(SLOTS // ROWS)])).alias("band"))
    a, b = bands.alias("a"), bands.alias("b")
    met = a.join(b, (F.col("a.band") == F.col("b.band")) & (F.col("a.rep") < F.col("b.rep"))).select(F.col("a.rep").alias("x"), F.col("b.rep").alias("y")).distinct()
    own = lambda n: sets.select(F.col(key).alias(n), F.col("shingles").alias(f"s_{n}"))
    both = F.size(F.array_intersect("s_x", "s_y"))
    links = cut(met.join(own("x"), "x").join(own("y"), "y").filter(both >= least * (F.size("s_x") + F.size("s_y") - both)).select("x", "y"), "links")
    every = links.unionByName(links.select(F.col("y").alias("x"), F.col("x").alias("y")))
    label = alike.select(F.col("rep").alias("x"), F.col("rep").alias("class_id"))
    while True:
        passed = every.join(label.select(F.col("x").alias("y"), F.col("class_id").alias("other")), "y").groupBy("x").agg(F.min("other").alias("other"))
        moved = cut(label.join(passed, "x", "left").select("x", F.least("class_id", F.coalesce("other", "class_id")).alias("class_id"), (F.col("other") < F.col("class_id")).alias("moved")), "labels")
        label = moved.drop("moved")
        if moved.filter("moved").isEmpty():
            break
        # A label is the key of a document of the same component, whose own label is at most as great.
        on = label.select(F.col("x").alias("class_id"), F.col("class_id").alias("further"))
        label = cut(label.join(on, "class_id").select("x", F.col("further").alias("class_id")), "labels")
    degree = every.groupBy("x").agg(F.count(F.lit(1)).alias("links"))
    classes = label.join(degree, "x", "left").select(F.col("x").alias("rep"), "class_id", F.coalesce("links", F.lit(0)).alias("links"))
    members = signatures.select(key, F.xxhash64("signature").alias("sig")).join(alike.select("sig", "rep", "copies"), "sig").join(classes, "rep")
    return members.filter((F.col("links") > 0) | (F.col("copies") > 1)).select(key, "class_id", (F.col("links") + F.col("copies") - 1).alias("links"))
