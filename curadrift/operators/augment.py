"""Augmented copies of rows; every random choice is a hash of key, copy number and seed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from curadrift.functions.numbers import drawn


def _copies(df: DataFrame, n: int) -> DataFrame:
    return df.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(n))))


def _pick(n: Column, key: str, salt: int) -> Column:
    return F.pmod(drawn(F.col(key), F.col("copy"), F.lit(salt)), n).cast("int")


def _uniform(key: str, salt: int) -> Column:
    return drawn(F.col(key), F.col("copy"), F.lit(salt)) / float(1 << 52)


def swapped(words: Column, i: Column, j: Column) -> Column:
    """Array with the words at zero-based i and j exchanged."""
    low, high = F.least(i, j), F.greatest(i, j)
    return F.concat(
        F.slice(words, F.lit(1), low), F.array(F.get(words, high)), F.slice(words, low + 2, high - low - 1),
        F.array(F.get(words, low)), F.slice(words, high + 2, F.size(words)),
    )


def augment_words(text: Column, key: str, seed: int, deletion: bool = True) -> Column:
    """Two words exchanged; with more than three words one is deleted."""
    words = F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " ")
    n = F.size(words)
    i = _pick(n, key, seed)
    j = F.pmod(i + 1 + _pick(F.greatest(n - 1, F.lit(1)), key, seed + 1), n).cast("int")
    mixed = F.when(n > 1, swapped(words, i, j)).otherwise(words)
    if deletion:
        gone = _pick(n, key, seed + 2)
        shorter = F.concat(F.slice(mixed, F.lit(1), gone), F.slice(mixed, gone + 2, n))
        mixed = F.when(n > 3, shorter).otherwise(mixed)
    return F.array_join(mixed, " ")


def augment_text(df: DataFrame, key: str, columns: list[str], copies: int = 1, seed: int = 1, deletion: bool = True) -> DataFrame:
    out = _copies(df, copies)
    return out.withColumns({c: augment_words(F.col(c), key, seed + 10 * i, deletion) for i, c in enumerate(columns)})


def _normal(key: str, salt: int) -> Column:
    """Standard normal from two hashed uniforms (Box-Muller), the same on every run and partitioning."""
    u = F.greatest(_uniform(key, salt), F.lit(1e-16))
    return F.sqrt(-2 * F.log(u)) * F.cos(2 * F.lit(3.141592653589793) * _uniform(key, salt + 1))


def augment_numeric(
    df: DataFrame, key: str, columns: list[str], copies: int = 1, seed: int = 1, noise: float = 0.1, scale: tuple[float, float] = (0.9, 1.1)
) -> DataFrame:
    """x * U(scale) + N(0, noise)."""
    low, high = scale
    return _copies(df, copies).withColumns({
        c: F.col(c) * (low + (high - low) * _uniform(key, seed + 10 * i)) + noise * _normal(key, seed + 10 * i + 1)
        for i, c in enumerate(columns)
    })


def augment_categorical(
    df: DataFrame, key: str, categories: dict[str, list[str]], copies: int = 1, seed: int = 1, probability: float = 0.1
) -> DataFrame:
    """With the given probability replace a value by a different allowed one."""
    changes = {}
    for i, (column, allowed) in enumerate(categories.items()):
        others = F.array_except(F.array(*[F.lit(a) for a in allowed]), F.array(F.col(column)))
        other = F.get(others, _pick(F.greatest(F.size(others), F.lit(1)), key, seed + 10 * i + 1))
        changes[column] = F.when(_uniform(key, seed + 10 * i) < probability, F.coalesce(other, F.col(column))).otherwise(F.col(column))
    return _copies(df, copies).withColumns(changes)


def augment_auto(df: DataFrame, key: str, categories: dict[str, list[str]], copies: int = 1, seed: int = 1) -> DataFrame:
    """Per row: text when any string is longer than 10 characters, else numeric when it has a number, else
    categorical. Adds ``augmenter``; only the columns of that kind change."""
    text = [f.name for f in df.schema if f.name != key and isinstance(f.dataType, T.StringType)]
    numbers = [f.name for f in df.schema if f.name != key and isinstance(f.dataType, T.NumericType)]
    is_text = F.lit(False)
    for c in text:
        is_text = is_text | (F.coalesce(F.length(c), F.lit(0)) > 10)
    is_number = F.lit(False)
    for c in numbers:
        is_number = is_number | F.col(c).isNotNull()
    tagged = df.withColumn("augmenter", F.when(is_text, "text").when(is_number, "numeric").otherwise("categorical"))
    floats = tagged.withColumns({c: F.col(c).cast("double") for c in numbers})
    parts = [
        augment_text(floats.filter("augmenter = 'text'"), key, text, copies, seed),
        augment_numeric(floats.filter("augmenter = 'numeric'"), key, numbers, copies, seed),
        augment_categorical(floats.filter("augmenter = 'categorical'"), key, categories, copies, seed),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
