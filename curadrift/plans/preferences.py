"""Queries for preference data, augmentation and versions."""

from pyspark.sql import functions as F

from curadrift.functions.numbers import r6
from curadrift.operators import augment as U, preferences as P, versions as Z
from curadrift.plans.ctes import sql
from curadrift.plans.registry import query
from curadrift.sources.tables import ntz, preference_pairs, samples, table


def trees(spark, sf):
    """(ai, human) node tables: a root per document and a child per sentence. The human copy changes one
    sentence of two documents in three, and every ninth gets an extra sentence."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("sample_id"), F.split("text", r"\. ").alias("s"))
    n = F.size("s")
    root_path = F.array().cast("array<int>")
    root = docs.select("sample_id", root_path.alias("path"), F.lit("").alias("text"), n.alias("n_children"), n.alias("n"))
    children = docs.select("sample_id", n.alias("n"), F.posexplode("s").alias("pos", "text")).select(
        "sample_id", F.array("pos").alias("path"), "text", F.lit(0).alias("n_children"), "n"
    )
    ai = root.unionByName(children)
    target = F.col("sample_id") % F.col("n")
    edited = (F.size("path") == 1) & (F.col("sample_id") % 3 != 0) & (F.try_element_at("path", F.lit(1)) == target)
    human = ai.withColumns({
        "text": F.when(edited, F.concat(F.lit("edited "), F.col("text"))).otherwise(F.col("text")),
        "n_children": F.col("n_children") + F.when((F.size("path") == 0) & (F.col("sample_id") % 9 == 1), 1).otherwise(0),
    })
    return ai.drop("n"), human.drop("n")


SENT = "SELECT doc_id, list_filter(string_split(text, '. '), lambda x: true) AS s, len(string_split(text, '. ')) AS n FROM documents"
DIVERGE = "SELECT doc_id AS sample_id, CASE WHEN doc_id % 9 = 1 THEN 'topology' WHEN doc_id % 3 <> 0 THEN 'text' ELSE 'same' END AS kind, CASE WHEN doc_id % 9 = 1 THEN '' WHEN doc_id % 3 <> 0 THEN CAST(doc_id % n AS VARCHAR) END AS path, CASE WHEN doc_id % 9 <> 1 AND doc_id % 3 <> 0 THEN 'edited ' || s[doc_id % n + 1] END AS text FROM sent"


@query("tree_divergence", sql("SELECT sample_id, kind, path, md5(text) AS text_md5 FROM dv", sent=SENT, dv=DIVERGE))
def tree_divergence(spark, sf):
    out = P.tree_divergence(*trees(spark, sf))
    return out.select("sample_id", "kind", F.array_join(F.transform("path", lambda x: x.cast("string")), ",").alias("path"), F.md5("text").alias("text_md5"))


def prompts(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("sample_id"), F.col("source").alias("prompt"), F.col("text").alias("ai_text"))


@query("build_preference", sql(
    "SELECT sample_id, source AS prompt, md5(coalesce(dv.text, 'Human accepted AI text unchanged')) AS chosen_md5, md5(d.text) AS rejected_md5, 0.9::DOUBLE AS confidence, 1 AS turn_length FROM dv JOIN documents d ON d.doc_id = sample_id WHERE kind <> 'topology'", sent=SENT, dv=DIVERGE))
def build_preference(spark, sf):
    pairs, _ = P.build_preference(P.tree_divergence(*trees(spark, sf)), prompts(spark, sf))
    return pairs.withColumns({f"{c}_md5": F.md5(c) for c in ["chosen", "rejected"]}).drop("chosen", "rejected")


@query("conversation_pairs", sql("SELECT conv_id, turn, md5(prompt) AS prompt_md5, md5(chosen) AS chosen_md5, md5(rejected) AS rejected_md5, confidence, turn_length FROM pref", "pref"))
def conversation_pairs(spark, sf):
    hashed = [F.md5(c).alias(f"{c}_md5") for c in ["prompt", "chosen", "rejected"]]
    return preference_pairs(spark, sf).select("conv_id", "turn", *hashed, "confidence", "turn_length")


def logps(spark, sf):
    names = ["policy_chosen", "policy_rejected", "reference_chosen", "reference_rejected"]
    return samples(spark, sf).select("image_id", *[(F.col("embedding")[i] * 10 - 20).alias(n) for i, n in enumerate(names)])


DPO = "SELECT image_id, 0.1 * ((e[1] - e[2]) - (e[3] - e[4])) * 10 AS m, 0.1 * (e[1] - e[3]) * 10 AS cr, 0.1 * (e[2] - e[4]) * 10 AS rr FROM (SELECT image_id, embedding AS e FROM samples)"


@query("dpo_loss", sql("SELECT round(avg(ln(1 + exp(-m))), 6) AS loss, round(avg(cr), 6) + 0.0 AS chosen_reward, round(avg(rr), 6) + 0.0 AS rejected_reward, count(*) AS pairs FROM dp", "samples", dp=DPO))
def dpo_loss(spark, sf):
    out = P.dpo_loss(logps(spark, sf))
    return out.select(*[r6(F.col(c)).alias(c) for c in ["loss", "chosen_reward", "rejected_reward"]], "pairs")


@query("dpo_rows", sql("SELECT image_id, round(ln(1 + exp(-m)), 6) AS loss, round(cr, 6) + 0.0 AS chosen_reward, round(rr, 6) + 0.0 AS rejected_reward FROM dp", "samples", dp=DPO))
def dpo_rows(spark, sf):
    return P.dpo_rows(logps(spark, sf)).select("image_id", *[r6(F.col(c)).alias(c) for c in ["loss", "chosen_reward", "rejected_reward"]])


@query("sequence_logps", sql(
    "SELECT image_id AS seq, round(sum(CASE WHEN p % 5 = 0 THEN 0 ELSE w[(image_id + p) % 4 + 1] - ln(list_sum(list_transform(w, lambda x: exp(x)))) END), 6) AS logp, count(*) FILTER (WHERE p % 5 <> 0) AS tokens FROM (SELECT image_id, p, embedding[4*p+1:4*p+4] AS w FROM samples, range(16) r(p)) GROUP BY 1", "samples"))
def sequence_logps(spark, sf):
    pos = F.col("pos")
    tokens = samples(spark, sf).select(F.col("image_id").alias("seq"), "embedding", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("pos")).select(
        "seq", F.slice("embedding", 4 * pos + 1, 4).alias("logits"),
        F.when(pos % 5 == 0, P.IGNORED_LABEL).otherwise((F.col("seq") + pos) % 4).alias("label"),
    )
    return P.sequence_logps(tokens).withColumn("logp", r6(F.col("logp")))


# ---- augmentation ------------------------------------------------------------------------

def draw(key, salt):
    return f"CAST('0x' || substr(md5({key} || '|' || copy || '|{salt}'), 1, 13) AS BIGINT)"


WORDS = {
    "aw": "SELECT doc_id, copy, string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ') AS w FROM documents, (VALUES (1), (2)) c(copy)",
    "an": f"SELECT *, len(w) AS n, {draw('doc_id', 1)} % len(w) AS i, {draw('doc_id', 2)} % greatest(len(w) - 1, 1) AS o, {draw('doc_id', 3)} % len(w) AS gone FROM aw",
    "aj": "SELECT *, (i + 1 + o) % n AS j FROM an",
}


@query("augment_text", sql(
    "SELECT doc_id, copy, md5(array_to_string(list_transform(list_filter(range(n), lambda k: n <= 3 OR k <> gone), "
    "lambda k: CASE WHEN n > 1 AND k = i THEN w[j + 1] WHEN n > 1 AND k = j THEN w[i + 1] ELSE w[k + 1] END), ' ')) AS text_md5 FROM aj", **WORDS))
def augment_text(spark, sf):
    out = U.augment_text(table(spark, sf, "documents").select("doc_id", "text"), "doc_id", ["text"], copies=2)
    return out.select("doc_id", "copy", F.md5("text").alias("text_md5"))


UNIT = "4503599627370496.0::DOUBLE"


@query("augment_numeric", (
    f"SELECT o_orderkey, copy, round(o_totalprice * (0.9::DOUBLE + 0.2::DOUBLE * {draw('o_orderkey', 1)} / {UNIT}) + 0.1::DOUBLE * "
    f"sqrt(-2 * ln(greatest({draw('o_orderkey', 2)} / {UNIT}, 1e-16))) * cos(2 * pi() * {draw('o_orderkey', 3)} / {UNIT}), 4) AS o_totalprice FROM orders, (VALUES (1), (2)) c(copy)"))
def augment_numeric(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return U.augment_numeric(rows, "o_orderkey", ["o_totalprice"], copies=2).withColumn("o_totalprice", F.round("o_totalprice", 4))


# The order priorities.
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


OTHERS = "list_filter([" + ", ".join(f"'{p}'" for p in PRIORITIES) + "], lambda x: x <> o_orderpriority)"


@query("augment_categorical", (
    f"SELECT o_orderkey, copy, CASE WHEN {draw('o_orderkey', 1)} / {UNIT} < 0.1 THEN {OTHERS}[CAST({draw('o_orderkey', 2)} % len({OTHERS}) + 1 AS BIGINT)] ELSE o_orderpriority END AS o_orderpriority "
    "FROM orders, (VALUES (1), (2)) c(copy)"))
def augment_categorical(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    return U.augment_categorical(rows, "o_orderkey", {"o_orderpriority": PRIORITIES}, copies=2)


@query("augment_auto", "SELECT CASE WHEN length(o_orderpriority) > 10 THEN 'text' WHEN o_custkey % 4 <> 0 THEN 'numeric' ELSE 'categorical' END AS augmenter, count(*) * 2 AS copies FROM orders GROUP BY 1")
def augment_auto(spark, sf):
    rows = table(spark, sf, "orders").select(
        "o_orderkey", "o_orderpriority", F.when(F.col("o_custkey") % 4 != 0, F.col("o_totalprice")).alias("o_totalprice")
    )
    out = U.augment_auto(rows, "o_orderkey", {"o_orderpriority": PRIORITIES}, copies=2)
    return out.groupBy("augmenter").agg(F.count(F.lit(1)).alias("copies"))


# ---- versions ----------------------------------------------------------------------------

def order_rows(spark, sf):
    return table(spark, sf, "orders")


STAMP = "strftime({}, '%Y-%m-%dT%H:%M:%S.%f')"
ROWJ = (
    f"SELECT o_orderkey, sha256(CAST(json_object('o_custkey', o_custkey, 'o_orderdate', {STAMP.format('o_orderdate')}, 'o_orderkey', o_orderkey, "
    "'o_orderpriority', o_orderpriority, 'o_orderstatus', o_orderstatus, 'o_totalprice', o_totalprice) AS VARCHAR)) AS h FROM orders"
)
SUMS = "count(*) || '-' || " + " || '-' || ".join(f"CAST(sum(CAST('0x' || substr(h, {1 + 15 * i}, 15) AS BIGINT)) AS VARCHAR)" for i in range(4))


@query("data_hash_rows", sql("SELECT o_orderkey, substr(h, 1, 16) AS data_hash FROM rj", rj=ROWJ))
def data_hash_rows(spark, sf):
    return Z.row_hashes(order_rows(spark, sf)).select("o_orderkey", "data_hash")


@query("data_hash", sql(f"SELECT count(*) AS rows, substr(sha256({SUMS}), 1, 16) AS data_hash FROM rj", rj=ROWJ))
def data_hash(spark, sf):
    return Z.table_hash(order_rows(spark, sf))


def monthly_versions(spark, sf):
    """One version per day of events: number by day, parent the day before, hash of the day's rows."""
    days = table(spark, sf, "events").select(
        (F.timestamp_diff("DAY", ntz("2024-01-01"), F.col("ts")) + 1).alias("number"), "*"
    )
    hashed = Z.table_hash(days, by=["number"])
    return hashed.select(
        F.concat(F.lit("v"), F.col("number").cast("string")).alias("version_id"), "number",
        F.when(F.col("number") > 1, F.concat(F.lit("v"), (F.col("number") - 1).cast("string"))).alias("parent_id"),
        "data_hash", F.concat(F.lit("events of day "), F.col("number").cast("string")).alias("description"),
        F.timestamp_add("DAY", F.col("number").cast("int"), ntz("2024-01-01")).alias("created_at"),
    )


@query("list_versions", (
    "SELECT 'v' || n AS version_id, CASE WHEN n > 1 THEN 'v' || (n - 1) END AS parent_id, substr(sha256(" + SUMS + "), 1, 16) AS data_hash, TIMESTAMP '2024-01-01' + to_days(CAST(n AS INTEGER)) AS created_at FROM "
    "(SELECT n, sha256(CAST(json_object('event_id', event_id, 'event_type', event_type, 'number', n, 'props', props, 'ts', " + STAMP.format("ts") + ", 'user_id', user_id, 'value', value) AS VARCHAR)) AS h FROM (SELECT *, datediff('day', TIMESTAMP '2024-01-01', ts) + 1 AS n FROM events)) GROUP BY n"))
def list_versions(spark, sf):
    return Z.list_versions(monthly_versions(spark, sf)).select("version_id", "parent_id", "data_hash", "created_at")


@query("create_version", sql(
    "SELECT 'v' || (m + 1) AS version_id, m + 1 AS number, 'v' || m AS parent_id, 'next' AS description, data_hash FROM (SELECT max(datediff('day', TIMESTAMP '2024-01-01', ts) + 1) AS m FROM events), "
    f"(SELECT substr(sha256({SUMS}), 1, 16) AS data_hash FROM rj)", rj=ROWJ))
def create_version(spark, sf):
    hashed = Z.table_hash(order_rows(spark, sf))
    return Z.create_version(monthly_versions(spark, sf), hashed, "next", ntz("2024-03-01")).select("version_id", "number", "parent_id", "description", "data_hash")


@query("version_history", "SELECT 'v' || n AS version_id, 20 - n AS steps_back FROM (SELECT DISTINCT datediff('day', TIMESTAMP '2024-01-01', ts) + 1 AS n FROM events) WHERE n <= 20")
def version_history(spark, sf):
    return Z.version_history(monthly_versions(spark, sf), "v20").select("version_id", "steps_back")
