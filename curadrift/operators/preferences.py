"""Preference data: diverging state trees, conversation pairs, preference loss, token log-probabilities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from curadrift.functions.vectors import total, with_value

# Fixed values.
IGNORED_LABEL = -100
MAX_DEPTH = 100
UNCHANGED = "Human accepted AI text unchanged"
TREE_CONFIDENCE = 0.9


def tree_divergence(ai: DataFrame, human: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """Per sample the preorder-first finding between two node tables (sample_id, path, text, n_children).

    Where texts differ and the human one is empty, nothing is found at that node or below it.
    kind ``text``: texts differ, ``text`` is the human one; ``topology``: child counts differ;
    ``depth``: a node deeper than ``max_depth``; ``same``: none. Path arrays compare in preorder, and a
    node missing on one side always has a topology finding above it, so nodes meet by an inner join
    and one minimum per sample remains.
    """
    a = ai.select("sample_id", "path", F.col("text").alias("a_text"), F.col("n_children").alias("a_n"))
    h = human.select("sample_id", "path", F.col("text").alias("h_text"), F.col("n_children").alias("h_n"))
    deep = F.size("path") > max_depth
    differs = F.col("a_text") != F.col("h_text")
    silent = differs & (F.col("h_text") == "") & ~deep
    kind = F.when(deep, "depth").when(silent, "silent").when(differs, "text").when(F.col("a_n") != F.col("h_n"), "topology")
    met = a.join(h, ["sample_id", "path"]).withColumn("kind", kind)
    # findings below a silent node do not count: a node looks for its ancestors among them
    hushed = met.filter("kind = 'silent'").select("sample_id", F.col("path").alias("above"))
    above = F.transform(F.sequence(F.lit(0), F.size("path")), lambda n: F.slice("path", F.lit(1), n))
    below = met.filter("kind IS NOT NULL").select("sample_id", "path", F.explode(above).alias("above")).join(hushed, ["sample_id", "above"])
    below = below.select("sample_id", "path").distinct().withColumn("hushed", F.lit(True))
    found = met.join(below, ["sample_id", "path"], "left").withColumn("kind", F.when(F.col("hushed").isNull(), F.col("kind")))
    first = F.min(F.when(F.col("kind").isNotNull(), F.struct("path", "kind", "h_text")))
    return found.groupBy("sample_id").agg(first.alias("f")).select(
        "sample_id", F.coalesce("f.kind", F.lit("same")).alias("kind"), F.col("f.path").alias("path"),
        F.when(F.col("f.kind") == "text", F.col("f.h_text")).alias("text"),
    )


def build_preference(divergence: DataFrame, prompts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pairs, errors): chosen = human text or the fixed text for no change, rejected = the AI root text."""
    joined = divergence.join(prompts.select("sample_id", "prompt", "ai_text"), "sample_id")
    fine = F.col("kind").isin("text", "same")
    pairs = joined.filter(fine).select(
        "sample_id", "prompt", F.coalesce("text", F.lit(UNCHANGED)).alias("chosen"), F.col("ai_text").alias("rejected"),
        F.lit(TREE_CONFIDENCE).alias("confidence"), F.lit(1).alias("turn_length"),
    )
    return pairs, joined.filter(~fine).select("sample_id", "kind")


def neg_log_sigmoid(x: Column) -> Column:
    """-log(sigmoid(x)) without overflow on either side."""
    return F.when(x >= 0, F.log1p(F.exp(-x))).otherwise(F.log1p(F.exp(x)) - x)


def dpo_rows(df: DataFrame, beta: float = 0.1) -> DataFrame:
    """Add loss, chosen_reward and rejected_reward to rows of four log-probabilities."""
    margin = (F.col("policy_chosen") - F.col("policy_rejected")) - (F.col("reference_chosen") - F.col("reference_rejected"))
    return df.withColumns({
        "loss": neg_log_sigmoid(beta * margin),
        "chosen_reward": beta * (F.col("policy_chosen") - F.col("reference_chosen")),
        "rejected_reward": beta * (F.col("policy_rejected") - F.col("reference_rejected")),
    })


def dpo_loss(df: DataFrame, beta: float = 0.1) -> DataFrame:
    return dpo_rows(df, beta).agg(
        F.avg("loss").alias("loss"), F.avg("chosen_reward").alias("chosen_reward"), F.avg("rejected_reward").alias("rejected_reward"),
        F.count(F.lit(1)).alias("pairs"),
    )


def sequence_logps(tokens: DataFrame) -> DataFrame:
    """Per sequence the summed log-softmax of the label logits; ignored labels add nothing."""
    top = F.array_max("logits")
    log_mass = top + F.log(total(with_value(F.col("logits"), top, lambda x, t: F.exp(x - t))))
    own = F.get(F.col("logits"), F.col("label").cast("int")) - log_mass
    part = F.when(F.col("label") == IGNORED_LABEL, 0.0).otherwise(own)
    return tokens.groupBy("seq").agg(F.sum(part).alias("logp"), F.count_if(F.col("label") != IGNORED_LABEL).alias("tokens"))
