"""Reading annotation results and model predictions out of their JSON form."""

from pyspark.sql import Column, functions as F

# `choices` is a list of names or a map name -> probability, so it is kept as JSON text first.
RESULT_SCHEMA = "array<struct<value:struct<choices:string,labels:array<string>,score:double>>>"


def parse_result(json: Column) -> Column:
    """JSON ``result[]`` -> array of (choices_list, choices_prob, labels, score)."""
    def item(x: Column) -> Column:
        choices = x["value"]["choices"]
        return F.struct(
            F.when(choices.startswith("["), F.from_json(choices, "array<string>")).alias("choices_list"),
            F.when(choices.startswith("{"), F.from_json(choices, "map<string,double>")).alias("choices_prob"),
            x["value"]["labels"].alias("labels"),
            x["value"]["score"].alias("score"),
        )

    return F.transform(F.from_json(json, RESULT_SCHEMA), item)


def best_choice(prob: Column) -> Column:
    """Most probable name, the smaller name on a tie."""
    ranked = F.transform(
        F.map_entries(prob), lambda e: F.struct((-e["value"]).alias("p"), e["key"].alias("name"))
    )
    return F.array_min(ranked)["name"]


def item_label(item: Column) -> Column:
    return F.coalesce(
        F.get(item["choices_list"], F.lit(0)),
        F.when(F.size(F.map_keys(item["choices_prob"])) > 0, best_choice(item["choices_prob"])),
        F.get(item["labels"], F.lit(0)),
    )


def extract_label(result: Column) -> Column:
    """First usable label of a parsed result, else ``unknown``."""
    usable = F.filter(F.transform(result, item_label), lambda x: x.isNotNull())
    return F.coalesce(F.get(usable, F.lit(0)), F.lit("unknown"))


def all_labels(result: Column) -> Column:
    """Every choice or label of a parsed result, map keys included."""
    def names(item: Column) -> Column:
        return F.coalesce(
            item["choices_list"], F.map_keys(item["choices_prob"]), item["labels"], F.array().cast("array<string>")
        )

    return F.flatten(F.transform(result, names))


def extract_probabilities(item: Column) -> Column:
    """One prediction item -> probability array, NULL when it carries none."""
    by_map = F.when(F.size(F.map_keys(item["choices_prob"])) > 0, F.map_values(item["choices_prob"]))
    size = F.size(item["choices_list"])
    by_list = F.when(size > 0, F.array_repeat(1.0 / size, size))
    by_score = F.when(item["score"].isNotNull(), F.array(item["score"], 1 - item["score"]))
    return F.coalesce(by_map, by_list, by_score)
