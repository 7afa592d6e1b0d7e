"""Reading, subsetting and synthesising sample rows."""

from pyspark.sql import DataFrame, functions as F

from curadrift.functions.numbers import drawn


def load_samples(raw: DataFrame, metadata: list[str], embedding: str | None = None) -> DataFrame:
    """image_id, label (first tag or ``unknown``), metadata map of the given text columns."""
    first_tag = F.get(F.col("tags"), F.lit(0))
    pairs = F.create_map(*[x for name in metadata for x in (F.lit(name), F.col(name))])
    columns = [
        F.col("id").alias("image_id"),
        F.coalesce(first_tag, F.lit("unknown")).alias("label"),
        F.map_filter(pairs, lambda _, v: v.isNotNull()).alias("metadata"),
    ]
    return raw.select(*columns, *([F.col(embedding).alias("embedding")] if embedding else []))


def random_subset(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """``n`` rows without replacement; the same rows for the same seed on any partitioning."""
    return df.orderBy(drawn(F.col(key), F.lit(seed)), key).limit(n)


# Label names of the synthetic slice, in cycle order.
SYNTHETIC_LABELS = [
    "airplane", "automobile", "bird", "cat", "deer", "dog", "frog", "horse", "ship", "truck",
]


def synthetic_slice(rows: DataFrame, key: str, dim: int, seed: int) -> DataFrame:
    """One synthetic sample per input row: cycling label, normal vector around 0.5 * label number."""
    number = F.pmod(F.col(key), F.lit(len(SYNTHETIC_LABELS))).cast("int")
    mean = number * 0.5
    return rows.select(
        F.col(key).alias("image_id"),
        F.array(*[F.lit(s) for s in SYNTHETIC_LABELS])[number].alias("label"),
        F.array(*[F.randn(seed + i) + mean for i in range(dim)]).alias("embedding"),
        F.create_map(
            F.lit("batch"), F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(5)).cast("string")
        ).alias("metadata"),
    )
