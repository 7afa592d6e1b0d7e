"""Labels, probabilities, rules, preference data, augmentation, versions: small inputs with known answers."""

import math

import pytest
from pyspark.sql import functions as F

from curadrift.functions import labels as L, probabilities as P, rules as R, vectors as V
from curadrift.operators import augment as U, preferences as PR, projections as PJ, selection as S, trajectories as J, versions as Z


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def array(*xs):
    return F.array(*[F.lit(float(x)) for x in xs])


def test_uncertainty_of_known_distributions(spark):
    row = one(
        spark, uniform=P.entropy(array(0.5, 0.5)), certain=P.entropy(array(1, 0)), single=P.entropy(array(1)), lc=P.least_confidence(array(0.9, 0.1)),
        margin=P.margin(array(0.7, 0.3)), alone=P.margin(array(0.8)), rest=P.margin(array(0.8), "rest"),
    )
    assert row["uniform"] == pytest.approx(1.0) and row["certain"] == pytest.approx(0.0, abs=1e-8) and row["single"] == 0
    assert row["lc"] == pytest.approx(0.1) and row["margin"] == pytest.approx(0.6)
    assert row["alone"] == 1.0 and row["rest"] == pytest.approx(0.2)


def test_committee(spark):
    agree = F.array(array(0.9, 0.1), array(0.8, 0.2))
    split = F.array(array(1, 0), array(0, 1))
    row = one(
        spark, same=P.vote_entropy_normalized(agree), split=P.vote_entropy_normalized(split), kl=P.kl_to_consensus(split),
        lonely=P.kl_to_consensus(F.array(array(0.3, 0.7))), ce=P.entropy(P.consensus(split)),
    )
    assert row["same"] == 0 and row["split"] == pytest.approx(1) and row["lonely"] == 0
    assert row["kl"] == pytest.approx(math.log(2), abs=1e-6) and row["ce"] == pytest.approx(1)


def test_selection_by_uncertainty(spark):
    rows = [(1, [0.9, 0.1]), (2, [0.5, 0.5]), (3, [0.7, 0.3])]
    predictions = spark.createDataFrame(rows, "task_id int, probs array<double>")
    tasks = spark.createDataFrame([(1, False), (2, False), (3, False), (4, True)], "task_id int, is_labeled boolean")
    picked = S.select_tasks(tasks, predictions, 2).orderBy("rank").collect()
    assert [r["task_id"] for r in picked] == [2, 3] and picked[0]["score"] == 1.0
    assert S.select_tasks(tasks, predictions, 2, enabled=False).count() == 0
    assert S.candidate_tasks(tasks).count() == 3
    unseen = S.task_uncertainty(tasks, predictions, normalize=False).filter("task_id = 4").first()
    assert unseen["score"] == 1.0


def test_hybrid_weights(spark):
    part = spark.createDataFrame([(1, 0.2), (2, 0.8)], "task_id int, score double")
    with pytest.raises(ValueError):
        S.hybrid_scores({"a": part, "b": part}, {"a": 0.4, "b": 0.4})
    loose = {r["task_id"]: r["score"] for r in S.hybrid_scores({"a": part, "b": part}, {"a": 3.0, "b": 1.0}, strict=False).collect()}
    assert loose[2] == pytest.approx(0.8)


def test_equal_scores_become_half(spark):
    df = spark.createDataFrame([(1, 3.0), (2, 3.0)], "task_id int, score double")
    assert [r["score"] for r in S.min_max_normalize(df).collect()] == [0.5, 0.5]


def test_strategies_can_be_added(spark):
    S.register_strategy("by_id", lambda tasks, predictions, **kw: tasks.select("task_id", F.col("task_id").cast("double").alias("score")))
    tasks = spark.createDataFrame([(1, False), (9, False)], "task_id int, is_labeled boolean")
    assert S.select_tasks(tasks, tasks, 1, "by_id").first()["task_id"] == 9
    assert S.exploration_weight(0) == 0.7 and S.exploration_weight(100) == 0.2


@pytest.mark.parametrize("text,label", [
    ('[{"value":{"choices":["cat","dog"]}}]', "cat"),
    ('[{"value":{"choices":{"a":0.2,"b":0.8}}}]', "b"),
    ('[{"value":{"choices":{"b":0.5,"a":0.5}}}]', "a"),
    ('[{"value":{"choices":[]}},{"value":{"labels":["x"]}}]', "x"),
    ('[{"value":{}}]', "unknown"),
    ("[]", "unknown"),
    ("not json", "unknown"),
])
def test_label_of_a_result(spark, text, label):
    assert one(spark, label=L.extract_label(L.parse_result(F.lit(text))))["label"] == label


def test_rules(spark):
    row = one(
        spark, a=R.severity_from_p(F.lit(0.05)), b=R.severity_from_distance(F.lit(0.05)), c=R.feature_drift_level(F.lit(0.5)),
        d=R.overall_drift_level(F.lit(0.5)), e=R.score_from_p(F.lit(None).cast("double")), f=R.score_from_p(F.lit(1.5)),
        g=R.drift_explanation(F.array(F.lit("a"), F.lit("b"), F.lit("c")), F.lit(5), F.lit(0.9), 1),
        h=R.drift_explanation(F.array().cast("array<string>"), F.lit(0), F.lit(0.9)),
    )
    assert (row["a"], row["b"], row["c"], row["d"], row["e"], row["f"]) == ("medium", "low", "high", "medium", 0.5, 0.0)
    assert row["g"] == "We detected anomalous behavior in a, b, c and 2 others due to unexpected feature distributions (Severity: High)."
    assert row["h"].startswith("No drift detected")


def test_normalising_zero(spark):
    row = one(spark, z=V.l2_normalize(array(0, 0)), u=V.l2_normalize(array(3, 4)), c=V.cosine_similarity(array(0, 0), array(1, 0)), d=V.cosine_distance(array(0, 0), array(1, 0)))
    assert row["z"] == [0, 0] and row["u"] == pytest.approx([0.6, 0.8]) and row["c"] is None and row["d"] == 1


def test_log_lines(spark):
    text = "$ run\nplain\n[WARN] x\n# note\n#note\nTraceback here\n===\n[OK] fine\nError: e"
    lines = PJ.parse_log_lines(spark.createDataFrame([(1, text)], "id int, text string"), "id", "text").orderBy("line_no").collect()
    assert [r["type"] for r in lines] == ["code", "stdout", "stderr", "stdout", "system", "error", "separator", "info", "error"]
    assert lines[0]["section_start"] and lines[0]["section_title"] == "$ run" and lines[1]["section_title"] is None


def test_preference_contract(spark):
    rows = [("  hey  ", "a", "b", 0.9, 1), ("a good prompt", " ", "b", 0.9, 1), ("a good prompt", "a", "b", 0.05, 0), ("a good prompt", "a", "b", 1.0, 2)]
    df = spark.createDataFrame(rows, "prompt string, chosen string, rejected string, confidence double, turn_length int")
    good, bad = PJ.validate_preference(df)
    assert good.count() == 1
    assert sorted(len(r["reasons"]) for r in bad.collect()) == [1, 1, 2]


def nodes(spark, rows):
    return spark.createDataFrame(rows, "sample_id int, path array<int>, text string, n_children int")


def test_tree_divergence(spark):
    ai = nodes(spark, [(1, [], "", 2), (1, [0], "a", 1), (1, [0, 0], "x", 0), (1, [1], "b", 0), (2, [], "r", 1), (2, [0], "s", 0), (3, [], "q", 0), (4, list(range(101)), "t", 0)])
    human = nodes(spark, [(1, [], "", 2), (1, [0], "a", 1), (1, [0, 0], "y", 0), (1, [1], "c", 0), (2, [], "r", 2), (2, [0], "S", 0), (3, [], "q", 0), (4, list(range(101)), "t", 0)])
    got = {r["sample_id"]: (r["kind"], r["text"]) for r in PR.tree_divergence(ai, human).collect()}
    assert got == {1: ("text", "y"), 2: ("topology", None), 3: ("same", None), 4: ("depth", None)}
    prompts = spark.createDataFrame([(i, "prompt", "ai") for i in range(1, 5)], "sample_id int, prompt string, ai_text string")
    pairs, errors = PR.build_preference(PR.tree_divergence(ai, human), prompts)
    assert {r["sample_id"]: r["chosen"] for r in pairs.collect()} == {1: "y", 3: PR.UNCHANGED}
    assert errors.count() == 2


def test_preference_loss(spark):
    df = spark.createDataFrame([(1.0, 1.0, 0.0, 0.0), (5000.0, -5000.0, 0.0, 0.0), (-9000.0, 9000.0, 0.0, 0.0)],
                               "policy_chosen double, policy_rejected double, reference_chosen double, reference_rejected double")
    loss = [r["loss"] for r in PR.dpo_rows(df).collect()]
    assert loss[0] == pytest.approx(math.log(2)) and loss[1] == 0 and loss[2] == pytest.approx(1800)


def test_ignored_tokens(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0], 1), (1, [5.0, 1.0], -100)], "seq int, logits array<double>, label int")
    row = PR.sequence_logps(df).first()
    assert row["logp"] == pytest.approx(-math.log(2)) and row["tokens"] == 1


def test_trajectory_limits(spark):
    rows = [(1, 0, [0.0, 0.0, 0.0]), (1, 1, [0.5, 0.0, 0.0]), (1, 2, [3.0, 0.0, 0.0]), (1, 3, [3.2, 0.0, 0.0]), (2, 0, [9.0, 9.0, 9.0])]
    df = spark.createDataFrame(rows, "traj_id int, step int, state array<double>")
    wall = spark.createDataFrame([([3.2, 0.1, 0.0], None)], "position array<double>, radius double")
    out = {(r["traj_id"], r["step"]): r["violations"] for r in J.kinematics(df, "traj_id", ["step"], wall).collect()}
    assert out[(1, 1)] == [] and out[(1, 2)] == ["velocity"] and out[(1, 3)] == ["collision", "acceleration"]
    safe = {r["traj_id"]: r["safe"] for r in J.safety_report(J.kinematics(df, "traj_id", ["step"], wall), "traj_id").collect()}
    assert safe == {1: False, 2: True}
    moves = PJ.actions_from_trajectory(df, control="velocity").filter("traj_id = 1").orderBy("idx").collect()
    assert len(moves) == 3 and moves[0]["move"][0] == pytest.approx(5.0) and moves[1]["at"] == pytest.approx(0.1)


def test_augmented_text_keeps_its_words(spark):
    text = "one two three four five"
    df = spark.createDataFrame([(i, text) for i in range(40)], "id int, text string")
    kept = U.augment_text(df, "id", ["text"], copies=2, deletion=False).collect()
    assert len(kept) == 80 and all(sorted(r["text"].split()) == sorted(text.split()) for r in kept)
    assert all(sum(a != b for a, b in zip(r["text"].split(), text.split())) == 2 for r in kept)
    cut = U.augment_text(df, "id", ["text"]).collect()
    assert all(len(r["text"].split()) == 4 for r in cut)
    short = spark.createDataFrame([(1, "one two three"), (2, "word"), (3, "")], "id int, text string")
    assert {r["id"]: len(r["text"].split()) for r in U.augment_text(short, "id", ["text"]).collect()} == {1: 3, 2: 1, 3: 0}


def test_augmented_values(spark):
    df = spark.createDataFrame([(i, 100.0, "a") for i in range(2000)], "id int, x double, c string")
    x = [r["x"] for r in U.augment_numeric(df, "id", ["x"]).collect()]
    assert min(x) > 89 and max(x) < 111 and abs(sum(x) / 2000 - 100) < 1
    c = [r["c"] for r in U.augment_categorical(df, "id", {"c": ["a", "b", "d"]}).collect()]
    assert 0.07 < sum(v != "a" for v in c) / 2000 < 0.13 and set(c) == {"a", "b", "d"}


def test_table_hash_ignores_order_and_sees_changes(spark):
    df = spark.range(1000).select("id", F.md5(F.col("id").cast("string")).alias("t"))
    same = Z.table_hash(df.repartition(7).orderBy(F.desc("id"))).first()
    assert Z.table_hash(df).first() == same
    assert Z.table_hash(df.withColumn("t", F.when(F.col("id") == 500, "x").otherwise(F.col("t")))).first() != same
    assert Z.table_hash(df.unionByName(df.limit(1))).first() != same


def test_history_walks_to_the_root(spark):
    rows = [("v1", None, 1), ("v2", "v1", 2), ("v3", "v2", 3), ("w", "v1", 4)]
    versions = spark.createDataFrame(rows, "version_id string, parent_id string, number int")
    assert [r["version_id"] for r in Z.version_history(versions, "v3").orderBy(F.desc("steps_back")).collect()] == ["v1", "v2", "v3"]
    assert [r["version_id"] for r in Z.version_history(versions, "v1").collect()] == ["v1"]
