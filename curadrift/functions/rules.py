"""Scalar rules: severities, levels, scores and reason texts."""

from pyspark.sql import Column, functions as F

# Severity names in rising order.
SEVERITIES = ["none", "low", "medium", "high", "critical"]


def _ladder(value: Column, edges: list[float], descending: bool) -> Column:
    """Pick a severity by the first edge passed; ``descending`` edges are tested with >."""
    first, *rest = list(zip(edges, SEVERITIES))
    test = (lambda e: value > e) if descending else (lambda e: value < e)
    out = F.when(test(first[0]), first[1])
    for edge, name in rest:
        out = out.when(test(edge), name)
    return out.otherwise(SEVERITIES[-1])


def severity_from_p(p: Column) -> Column:
    return _ladder(p, [0.1, 0.05, 0.01, 0.001], True)


def severity_from_distance(d: Column) -> Column:
    return _ladder(d, [0.05, 0.1, 0.2, 0.5], False)


def severity_from_psi(psi: Column) -> Column:
    return _ladder(psi, [0.1, 0.2, 0.3, 0.5], False)


def feature_drift_level(score: Column) -> Column:
    return _ladder(score, [0.1, 0.3, 0.5, 0.7], False)


def overall_drift_level(score: Column) -> Column:
    """Same cuts as the feature level, but a score on a cut falls to the lower level."""
    return (
        F.when(score > 0.7, "critical").when(score > 0.5, "high")
        .when(score > 0.3, "medium").when(score > 0.1, "low").otherwise("none")
    )


def severity_rank(severity: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), severity).cast("int")


def score_from_p(p: Column) -> Column:
    return F.when(p.isNull(), 0.5).otherwise(F.greatest(F.lit(0.0), 1 - p))


# Explanation texts, chosen by argument.
EXPLANATIONS = [
    "The data points %s drifted because they are significantly far from the cluster centroid (Score: %s).",
    "We detected anomalous behavior in %s due to unexpected feature distributions (Severity: %s).",
    "Drift is likely caused by an edge case pattern present in %s that was absent during training.",
]
NO_DRIFT = "No drift detected. System is operating normally."


def drift_explanation(ids: Column, n_ids: Column, score: Column, template: int = 0) -> Column:
    """``ids`` needs only the first three names; ``n_ids`` is the full count."""
    named = F.concat(
        F.array_join(F.slice(ids, 1, 3), ", "),
        F.when(n_ids > 3, F.concat(F.lit(" and "), (n_ids - 3).cast("string"), F.lit(" others"))).otherwise(""),
    )
    text = EXPLANATIONS[template]
    if template == 0:
        filled = F.format_string(text, named, F.format_string("%.2f", score))
    elif template == 1:
        level = F.when(score > 0.8, "High").when(score > 0.5, "Medium").otherwise("Low")
        filled = F.format_string(text, named, level)
    else:
        filled = F.format_string(text, named)
    return F.when(n_ids == 0, NO_DRIFT).otherwise(filled)
