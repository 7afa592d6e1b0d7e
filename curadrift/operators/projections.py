"""Row-wise rules: labels, features, log lines, filters, validation, actions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from curadrift.functions import labels as L, vectors as V
from curadrift.operators.ordered import indexed, neighbours

# Prefixes that give a log line its type, tested in this order.
LOG_PREFIXES = [
    ("code", [">>> ", "$ "]),
    ("error", ["[ERROR]", "Error:"]),
    ("stderr", ["[WARN]"]),
    ("info", ["[INFO]", "[OK]"]),
    ("separator", ["---", "==="]),
]
# A line holding this anywhere is an error line; section titles keep 60 characters.
ERROR_MARK = "Traceback"
TITLE_LENGTH = 60


def parse_annotations(df: DataFrame, json: str = "result") -> DataFrame:
    """JSON text -> ``items``, an array of (choices_list, choices_prob, labels, score)."""
    return df.withColumn("items", L.parse_result(F.col(json)))


def with_label(df: DataFrame, items: str = "items") -> DataFrame:
    return df.withColumn("label", L.extract_label(F.col(items)))


def label_counts_all(df: DataFrame, items: str = "items") -> DataFrame:
    """Count of every choice and label named in any item."""
    return df.select(F.explode(L.all_labels(F.col(items))).alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def stable_hash(text: Column, modulo: int = 1000) -> Column:
    """Bucket of a string: first 8 hex digits of its md5 modulo ``modulo``."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") % modulo


def features_long(df: DataFrame, key: str) -> DataFrame:
    """(key, feature, value): numbers pass, strings become a hash bucket, other types are dropped."""
    numeric = [f.name for f in df.schema if f.name != key and isinstance(f.dataType, T.NumericType)]
    text = [f.name for f in df.schema if f.name != key and isinstance(f.dataType, T.StringType)]
    wide = df.select(
        key, *[F.col(c).cast("double") for c in numeric], *[stable_hash(F.col(c)).cast("double").alias(c) for c in text]
    )
    return wide.unpivot([key], [*numeric, *text], "feature", "value").filter(F.col("value").isNotNull())


def features_vector(df: DataFrame, key: str) -> DataFrame:
    """(key, features): values in feature-name order, strings / 1000, zero-padded to the widest row."""
    names = sorted(
        f.name for f in df.schema if f.name != key and isinstance(f.dataType, (T.NumericType, T.StringType))
    )
    text = {f.name for f in df.schema if isinstance(f.dataType, T.StringType)}
    values = [
        (stable_hash(F.col(c)) / 1000 if c in text else F.col(c)).cast("double") for c in names
    ]
    # width is known from the columns: a row lacking some of them is padded on the right
    present = F.array_compact(F.array(*values))
    padded = F.concat(present, F.array_repeat(F.lit(0.0), F.lit(len(names)) - F.size(present)))
    return df.select(key, padded.alias("features"))


def flatten_json_columns(schema: T.StructType, prefix: str = "", path: str = "") -> list[Column]:
    """Leaf columns of a nested struct, named ``a_b_c``; arrays are kept whole."""
    out: list[Column] = []
    for field in schema:
        name, at = f"{prefix}{field.name}", f"{path}`{field.name}`"
        if isinstance(field.dataType, T.StructType):
            out += flatten_json_columns(field.dataType, f"{name}_", f"{at}.")
        else:
            out.append(F.col(at).alias(name))
    return out


def flatten_json(df: DataFrame, json: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Flat messages, and the ones that do not parse or lack ``type`` with the error text."""
    parsed = df.withColumn("msg", F.from_json(json, schema, {"mode": "PERMISSIVE"}))
    nested = parsed.schema["msg"].dataType
    has_type = F.coalesce(F.col("msg.type") != "", F.lit(False))
    keep = [c for c in df.columns if c != json]
    good = parsed.filter(has_type).select(*keep, *flatten_json_columns(nested, path="msg."))
    bad = parsed.filter(~has_type).select(*keep, json, F.lit("message has no type").alias("error"))
    return good, bad


def parse_log_lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, line_no, text, type, section_start, section_title; one row per line of the whole text."""
    lines = df.select(key, F.posexplode(F.split(text, "\n")).alias("pos", "text"))
    line = F.col("text")
    kind = None
    for name, prefixes in LOG_PREFIXES:
        test = F.lit(False)
        for prefix in prefixes:
            test = test | line.startswith(prefix)
        if name == "error":
            test = test | line.contains(ERROR_MARK)
        kind = F.when(test, name) if kind is None else kind.when(test, name)
    system = line.startswith("#") & (F.length(line) > 1) & (F.substring(line, 2, 1) != " ")
    kind = kind.when(system, "system").otherwise("stdout")
    typed = lines.select(key, (F.col("pos") + 1).alias("line_no"), "text", kind.alias("type"))
    section = F.col("type") == "code"
    return typed.select(
        "*", section.alias("section_start"),
        F.when(section, F.substring("text", 1, TITLE_LENGTH)).alias("section_title"),
    )


def dataset_filter(
    df: DataFrame, labels: list | None = None, severities: list | None = None, drift_only: bool = False, text: str = ""
) -> DataFrame:
    """Empty constraint = no constraint; text matches image id or label, any case."""
    if labels:
        df = df.filter(F.col("label").isin(labels))
    if severities:
        df = df.filter(F.col("severity").isin(severities))
    if drift_only:
        df = df.filter("is_drift")
    if text:
        wanted = F.lit(text.lower())
        df = df.filter(F.lower(F.col("image_id").cast("string")).contains(wanted) | F.lower("label").contains(wanted))
    return df


def filter_by_severity(df: DataFrame, severities: list[str]) -> DataFrame:
    return df.filter(F.col("severity").isin(severities))


def text_search(df: DataFrame, column: str, wanted: str) -> DataFrame:
    return df.filter(F.lower(column).contains(wanted.lower()))


def preference_problems() -> Column:
    """Reasons a preference pair is refused; empty for a valid one."""
    prompt_length = F.length(F.trim("prompt"))
    checks = [
        (F.col("prompt").isNull() | (prompt_length < 5), "prompt too short"),
        (F.length("prompt") > 8192, "prompt too long"),
        (F.col("chosen").isNull() | (F.trim("chosen") == ""), "chosen is blank"),
        (F.col("rejected").isNull() | (F.trim("rejected") == ""), "rejected is blank"),
        (~F.col("confidence").between(0.1, 1.0) | F.col("confidence").isNull(), "confidence out of range"),
        ((F.col("turn_length") <= 0) | F.col("turn_length").isNull(), "turn_length not positive"),
    ]
    return F.array_compact(F.array(*[F.when(c, reason) for c, reason in checks]))


def validate_preference(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid pairs, and quarantined ones with their reasons."""
    checked = pairs.withColumn("reasons", preference_problems())
    return checked.filter(F.size("reasons") == 0).drop("reasons"), checked.filter(F.size("reasons") > 0)


def actions_from_trajectory(
    df: DataFrame, group: str = "traj_id", order: list[str] | None = None, control: str = "position", dt: float = 0.1
) -> DataFrame:
    """Per step the move to the next state: displacement, or velocity = displacement / dt."""
    steps = neighbours(indexed(df, [group], order or ["step"]), [group], {"target": ("state", -1)})
    move = V.minus(F.col("target"), F.col("state"))
    if control == "velocity":
        move = V.scaled(move, F.lit(1 / dt))
    return steps.filter(F.col("target").isNotNull()).select(
        group, "idx", F.lit(control).alias("control"), move.alias("move"), ((F.col("idx") - 1) * dt).alias("at")
    )


def batch_inference(
    df: DataFrame, key: str, vector: str, fn: Callable[[np.ndarray], np.ndarray], batch_size: int = 512
) -> DataFrame:
    """Apply a matrix -> matrix function batch by batch: key, output, status, error.

    A batch whose call raises is kept with status FAILED and the message; the others go on.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for at in range(0, len(frame), batch_size):
                part = frame.iloc[at : at + batch_size]
                try:
                    out = fn(np.stack(part[vector].to_numpy()))
                    yield pd.DataFrame({key: part[key], "output": list(out), "status": "DONE", "error": None})
                except Exception as error:
                    yield pd.DataFrame({key: part[key], "output": None, "status": "FAILED", "error": str(error)})

    key_type = df.schema[key].dataType.simpleString()
    return df.select(key, vector).mapInPandas(run, f"{key} {key_type}, output array<double>, status string, error string")
