"""Vector quantisation: assignment, moving-average update, usage statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strideflow.constants import CODEBOOK_SIZE


def histogram(tokens: DataFrame, token: str = "token_id", mask: Column | None = None, size: int = CODEBOOK_SIZE) -> DataFrame:
    """(token_id, n) for every code, unused ones with zero."""
    rows = tokens if mask is None else tokens.where(mask)
    counts = rows.groupBy(F.col(token).cast("long").alias("token_id")).agg(F.count("*").alias("n"))
    codes = tokens.sparkSession.range(size).withColumnRenamed("id", "token_id")
    return codes.join(counts, "token_id", "left").select("token_id", F.coalesce("n", F.lit(0)).alias("n"))


def usage(counts: DataFrame) -> DataFrame:
    """One row (total, used, dead_ratio, perplexity, lowest, highest) of a histogram; perplexity is exp of the entropy in nats."""
    total = counts.agg(F.sum("n").alias("total"))
    p = F.col("n") / F.col("total")
    joined = counts.crossJoin(F.broadcast(total))  # one row
    return joined.agg(
        F.max("total").alias("total"),
        F.count_if(F.col("n") > 0).alias("used"),
        F.avg((F.col("n") == 0).cast("double")).alias("dead_ratio"),
        F.exp(-F.sum(F.when(F.col("n") > 0, p * F.ln(p)).otherwise(0.0))).alias("perplexity"),
        F.min(F.when(F.col("n") > 0, F.col("token_id"))).alias("lowest"),
        F.max(F.when(F.col("n") > 0, F.col("token_id"))).alias("highest"),
    )


def assign(vectors: DataFrame, vector: str, codes: DataFrame, code: str = "code", centre: str = "centre") -> DataFrame:
    """Adds token_id and distance: the nearest code by squared distance, the lowest on ties.

    The codebook is one array of structs on one broadcast row (its size is fixed by the model), and a fold over it finds the
    nearest code within the vector's own row: no pairs are made.
    """
    table = codes.agg(F.sort_array(F.collect_list(F.struct(F.col(code).cast("long").alias("code"), F.col(centre).alias("centre")))).alias("_codes"))
    square = lambda c: F.round(F.aggregate(F.zip_with(vector, c, lambda a, b: (a.cast("double") - b) * (a.cast("double") - b)), F.lit(0.0), lambda s, x: s + x), 9)
    found = F.array_min(F.transform("_codes", lambda c: F.struct(square(c["centre"]).alias("d"), c["code"].alias("code"))))
    return vectors.crossJoin(F.broadcast(table)).withColumn("_f", found).withColumn("token_id", F.col("_f.code")).withColumn("distance", F.col("_f.d")).drop("_f", "_codes")  # one row


def centres(vectors: DataFrame, vector: str, code: str) -> DataFrame:
    """(code, n, centre): the mean vector of each code."""
    tall = vectors.select(code, F.posexplode(vector).alias("dim", "x"))
    means = tall.groupBy(code, "dim").agg(F.count("x").alias("n"), F.avg(F.col("x").cast("double")).alias("m"))
    return means.groupBy(code).agg(F.max("n").alias("n"), F.transform(F.sort_array(F.collect_list(F.struct("dim", "m"))), lambda r: r["m"]).alias("centre"))


def ema_update(codebook: DataFrame, assigned: DataFrame, vector: str, order: str, decay: float = 0.99) -> DataFrame:
    """(code, mass, sums, centre, dead): decayed counts and vector sums of a step. codebook: code from 0, mass, sums.

    A code whose mass falls below 1 is dead: it starts again at mass 1 from the step's vector that stands at its number in the order of a column,
    counted round when there are fewer vectors than codes.
    """
    tall = assigned.select(F.col("token_id").alias("code"), F.posexplode(vector).alias("dim", "x"))
    step = tall.groupBy("code", "dim").agg(F.count("x").alias("n"), F.sum(F.col("x").cast("double")).alias("s"))
    step = step.groupBy("code").agg(F.max("n").alias("n"), F.transform(F.sort_array(F.collect_list(F.struct("dim", "s"))), lambda r: r["s"]).alias("s"))
    joined = codebook.join(step, "code", "left")
    mass = decay * F.col("mass") + (1 - decay) * F.coalesce("n", F.lit(0))
    sums = F.when(F.col("s").isNull(), F.transform("sums", lambda x: decay * x)).otherwise(F.zip_with("sums", "s", lambda a, b: decay * a + (1 - decay) * b))
    size = (codebook.agg(F.max("code").alias("m")).first().m or 0) + 1  # fixed by the model
    seeds = seed_codes(assigned, vector, order, size).select("code", F.transform("centre", lambda x: x.cast("double")).alias("seed"))
    out = joined.select("code", mass.alias("mass"), sums.alias("sums")).join(F.broadcast(seeds), "code", "left").withColumn("dead", (F.col("mass") < 1) & F.col("seed").isNotNull())
    out = out.select("code", F.when(F.col("dead"), 1.0).otherwise(F.col("mass")).alias("mass"), F.when(F.col("dead"), F.col("seed")).otherwise(F.col("sums")).alias("sums"), "dead")
    return out.withColumn("centre", F.transform("sums", lambda x: x / F.greatest(F.col("mass"), F.lit(1e-5))))


def seed_codes(vectors: DataFrame, vector: str, order: str, size: int) -> DataFrame:
    """(code, centre): the first vectors in order, repeated until there are enough codes."""
    first = vectors.orderBy(order).limit(size)  # the codebook's size is the feature
    ranked = first.withColumn("r", F.row_number().over(Window.orderBy(order)) - 1)
    n = first.agg(F.count("*").alias("n"))
    codes = vectors.sparkSession.range(size).withColumnRenamed("id", "code").crossJoin(F.broadcast(n))  # one row
    return codes.join(ranked, F.pmod(F.col("code"), F.col("n")) == F.col("r")).select("code", F.col(vector).alias("centre"))
