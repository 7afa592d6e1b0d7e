"""Uncertainty and committee measures over probability arrays."""

from pyspark.sql import Column, functions as F

from curadrift.functions.vectors import divided, total, with_value

FLOOR = 1e-10


def renormalize(p: Column) -> Column:
    return divided(p, total(p))


def softmax(v: Column) -> Column:
    return renormalize(with_value(v, F.array_max(v), lambda x, top: F.exp(x - top)))


def least_confidence(p: Column) -> Column:
    return 1 - F.array_max(p)


def margin(p: Column, single_class: str = "one") -> Column:
    """1 - (p1 - p2); with one class either 1 or, ``single_class='rest'``, 1 - p1."""
    ranked = F.sort_array(p, asc=False)
    alone = F.lit(1.0) if single_class == "one" else 1 - ranked[0]
    return F.when(F.size(p) > 1, 1 - (F.get(ranked, F.lit(0)) - F.get(ranked, F.lit(1)))).otherwise(alone)


def raw_entropy(p: Column) -> Column:
    def term(x: Column) -> Column:
        kept = F.greatest(x, F.lit(FLOOR))
        return -kept * F.log(kept)

    return total(F.transform(p, term))


def entropy(p: Column) -> Column:
    """Entropy divided by its maximum, 0 for one class."""
    return F.when(F.size(p) > 1, raw_entropy(p) / F.log(F.size(p).cast("double"))).otherwise(0.0)


def argmax(p: Column) -> Column:
    """Zero-based position of the first largest entry."""
    return F.array_position(p, F.array_max(p)) - 1


def consensus(members: Column) -> Column:
    """Mean distribution of an ``ARRAY<ARRAY<DOUBLE>>`` committee."""
    summed = F.aggregate(
        F.slice(members, F.lit(2), F.greatest(F.size(members), F.lit(0))), members[0], lambda acc, p: F.zip_with(acc, p, lambda a, b: a + b)
    )
    return divided(summed, F.size(members).cast("double"))


def kl_to_consensus(members: Column) -> Column:
    """Mean over members of KL(member || consensus); 0 for fewer than two."""
    def kept(x: Column) -> Column:
        return F.greatest(x, F.lit(FLOOR))

    def divergence(p: Column, centre: Column) -> Column:
        return total(F.zip_with(p, centre, lambda x, c: kept(x) * F.log(kept(x) / kept(c))))

    per_member = with_value(members, consensus(members), divergence)
    return F.when(F.size(members) > 1, total(per_member) / F.size(members)).otherwise(0.0)


def vote_shares(members: Column) -> Column:
    """Per class the share of members whose argmax it is."""
    classes = F.sequence(F.lit(0), F.size(members[0]) - 1)
    return with_value(
        classes, F.transform(members, argmax), lambda c, votes: F.size(F.filter(votes, lambda v: v == c)) / F.size(votes)
    )


def vote_entropy(members: Column) -> Column:
    return raw_entropy(vote_shares(members))


def vote_entropy_normalized(members: Column) -> Column:
    """Entropy over the voted classes only, divided by the log of their number."""
    voted = F.filter(vote_shares(members), lambda s: s > 0)
    return F.when(F.size(voted) > 1, raw_entropy(voted) / F.log(F.size(voted).cast("double"))).otherwise(0.0)
