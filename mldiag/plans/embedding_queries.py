"""Similarity, text embedding, projection and projection-quality queries."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from mldiag.operators import embed, evaluate, neighbors, quality, reduce, scale, transforms, vector_index
from mldiag.operators.train import stratified_split
from mldiag.plans import workflows
from mldiag.plans.model_queries import N_DIMS, vectors
from mldiag.plans.registry import query, table
from mldiag.session import shared_folder

# A short list keeps the SQL readable; the operator's default is the list shipped with Spark ML.
STOP_WORDS = ["the", "of", "and", "to", "in", "is", "it", "on", "for", "that"]
_STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)
_PAIRS = """
v AS (SELECT vec_id AS id, CAST(label AS VARCHAR) AS label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
pairs AS (SELECT a.id, b.id AS neighbor, b.label AS label, {metric}(a.e, b.e) AS d FROM v a JOIN v b ON {on})"""


@query(
    "knn_cosine",
    "WITH "
    + _PAIRS.format(metric="list_cosine_distance", on="a.id = 7 AND b.id <> 7")
    + """ SELECT CAST(row_number() OVER (ORDER BY d, neighbor) AS INTEGER) AS rank, neighbor AS id,
round(d, 6) AS distance, label FROM pairs ORDER BY d, neighbor LIMIT 10""",
)
def knn_cosine(spark, folder):
    rows = table(spark, folder, "embeddings")
    return neighbors.similar_rows(rows, "vec_id", "embedding", 7, 10, label="label")


def _all_neighbors_sql(metric: str) -> str:
    return (
        "WITH "
        + _PAIRS.format(metric=metric, on="a.id <> b.id")
        + """ SELECT id, neighbor, round(d, 6) AS distance, CAST(rk AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, neighbor) AS rk FROM pairs) WHERE rk <= 5"""
    )


@query("knn_all_cosine", _all_neighbors_sql("list_cosine_distance"))
def knn_all_cosine(spark, folder):
    return _all_neighbors(spark, folder, "cosine")


@query("knn_all_euclidean", _all_neighbors_sql("list_distance"))
def knn_all_euclidean(spark, folder):
    return _all_neighbors(spark, folder, "euclidean")


def _all_neighbors(spark, folder, metric):
    rows = table(spark, folder, "embeddings")
    found = neighbors.knn_join(rows, rows, "vec_id", "embedding", 5, metric, exclude_self=True)
    return found.withColumn("distance", F.round("distance", 6) + F.lit(0.0)).drop("carried")


@query(
    "knn_classifier",
    """
WITH k AS (SELECT *, CAST('0x' || substr(md5(vec_id || ':42'), 1, 15) AS BIGINT) AS h FROM embeddings),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY h) AS rk, count(*) OVER (PARTITION BY label) AS n FROM k),
tr AS (SELECT vec_id, CAST(label AS VARCHAR) AS class, CAST(embedding AS DOUBLE[]) AS e FROM r WHERE rk > round(n * 0.2)),
p AS (SELECT q.vec_id, t.class, row_number() OVER (PARTITION BY q.vec_id
  ORDER BY list_distance(CAST(q.embedding AS DOUBLE[]), t.e), t.vec_id) AS nn FROM embeddings q CROSS JOIN tr t),
votes AS (SELECT vec_id, class, count(*) / 5 AS share FROM p WHERE nn <= 5 GROUP BY vec_id, class),
every AS (SELECT vec_id, class, coalesce(share, 0.0) AS share
  FROM (SELECT vec_id FROM embeddings) CROSS JOIN (SELECT DISTINCT class FROM tr) LEFT JOIN votes USING (vec_id, class))
SELECT vec_id, list(share ORDER BY class) AS probability,
  list(class ORDER BY share DESC, class)[1] AS prediction FROM every GROUP BY vec_id""",
)
def knn_classifier(spark, folder):
    rows = vectors(spark, folder)
    split = stratified_split(rows, "vec_id", "label", 0.2)
    classes = [str(i) for i in range(10)]
    scored = neighbors.knn_classify(
        split.where("split = 'train'"), rows, "vec_id", "embedding", "label", classes, 5
    )
    return scored.select("vec_id", "probability", "prediction")


@query("knn_lsh", "SELECT true AS recalled, count(*) > 0 AS rows_ FROM embeddings")
def knn_lsh(spark, folder):
    """Whether the hashed search finds at least nine tenths of the exact neighbours."""
    rows = table(spark, folder, "embeddings")
    near = neighbors.approximate_similar_rows(rows, "vec_id", "embedding", 7, bucket_length=8.0, n_tables=8)
    exact = neighbors.similar_rows(rows, "vec_id", "embedding", 7, 10)
    found = exact.join(near.select("id", F.lit(1).alias("hit")), "id", "left")
    return found.agg((F.sum("hit") >= 0.9 * F.count("*")).alias("recalled"), (F.count("*") > 0).alias("rows_"))


@query(
    "knn_index",
    """SELECT count(*) FILTER (vec_id % 50 = 0) AS queries, 10 * count(*) FILTER (vec_id % 50 = 0) AS answers, true AS recalled FROM embeddings""",
)
def knn_index(spark, folder):
    """Recall of the inverted-file index over all rows whose id is divisible by 50, held against the exact join."""
    rows = table(spark, folder, "embeddings")
    path = shared_folder(spark, "vector-index")
    vector_index.build(rows, "vec_id", "embedding", path, metric="cosine")
    asked = rows.where("vec_id % 50 = 0")
    found = vector_index.search(spark, path, asked, "vec_id", "embedding", 10, probes=24, candidates=60, metric="cosine", exclude_self=True)
    exact = neighbors.knn_join(asked, rows, "vec_id", "embedding", 10, "cosine", exclude_self=True)
    return vector_index.recall(found, exact).select("queries", "answers", (F.col("recall") >= 0.9).alias("recalled"))


@query(
    "nearest_point",
    """SELECT vec_id AS id, round(sqrt(pow(CAST(embedding[1] AS DOUBLE) - 0.05, 2) + pow(CAST(embedding[2] AS DOUBLE) + 0.1, 2)), 6) AS distance
FROM embeddings ORDER BY pow(CAST(embedding[1] AS DOUBLE) - 0.05, 2) + pow(CAST(embedding[2] AS DOUBLE) + 0.1, 2), vec_id LIMIT 1""",
)
def nearest_point(spark, folder):
    return neighbors.nearest_point(vectors(spark, folder), "vec_id", 0.05, -0.1)


@query("auto_cluster", "SELECT count(*) AS n, CAST(5 AS BIGINT) AS clusters, true AS nearest FROM embeddings")
def auto_cluster(spark, folder):
    """Whether (nearly) every row lies nearest to the mean of its own cluster, as k-means leaves it."""
    rows = neighbors.auto_cluster(vectors(spark, folder).drop("cluster"), "vec_id").select("vec_id", "x", "y", "cluster")
    means = rows.groupBy("cluster").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))
    every = means.agg(F.collect_list(F.struct("cluster", "mx", "my"))).scalar()  # one entry a cluster
    away = F.transform("_m", lambda m: F.struct(((F.col("x") - m["mx"]) ** 2 + (F.col("y") - m["my"]) ** 2).alias("d"), m["cluster"].alias("c")))
    best = rows.withColumn("_m", every).select("cluster", F.array_min(away)["c"].alias("best"))
    hits = F.count_if(F.col("cluster") == F.col("best"))
    return best.agg(F.count("*").alias("n"), F.count_distinct("cluster").alias("clusters"), (hits >= 0.95 * F.count("*")).alias("nearest"))


# -- text ------------------------------------------------------------------------------------------
_TOKENS = rf"""
tok AS (SELECT id, term, count(*) AS tf FROM (SELECT doc_id AS id,
  unnest(regexp_extract_all(lower(coalesce(text, 'nan')), '[\p{{L}}\p{{N}}_]{{2,}}')) AS term FROM documents)
  WHERE term NOT IN ({_STOPS}) GROUP BY ALL),
voc AS (SELECT term, CAST(sum(tf) AS BIGINT) AS total, count(*) AS df FROM tok GROUP BY term),
n AS (SELECT count(*) AS n FROM documents),
idf AS (SELECT term, total, df, ln((1 + n) / (1 + df)) + 1 AS idf FROM voc, n)"""


@query(
    "tfidf_vocabulary",
    "WITH " + _TOKENS + " SELECT term, total, df, round(idf, 6) AS idf FROM idf",
)
def tfidf_vocabulary(spark, folder):
    vocab = embed.vocabulary(table(spark, folder, "documents"), "doc_id", "text", stop_words=STOP_WORDS)
    return vocab.withColumn("idf", F.round("idf", 6))


@query(
    "tfidf_weights",
    "WITH "
    + _TOKENS
    + """, w AS (SELECT id, term, tf * idf AS w FROM tok JOIN idf USING (term))
SELECT id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY id)), 6) AS weight FROM w""",
)
def tfidf_weights(spark, folder):
    weights = embed.tfidf(table(spark, folder, "documents"), "doc_id", "text", stop_words=STOP_WORDS)
    return weights.withColumn("weight", F.round("weight", 6))


@query(
    "tfidf_vectors",
    "WITH "
    + _TOKENS
    + """, w AS (SELECT id, term, tf * idf AS w FROM tok JOIN idf USING (term))
SELECT id, count(*) AS terms, round(max(w) / sqrt(sum(w * w)), 6) AS largest, round(sum(w) / sqrt(sum(w * w)), 5) AS total
FROM w GROUP BY id""",
)
def tfidf_vectors(spark, folder):
    rows = embed.tfidf_vectors(table(spark, folder, "documents"), "doc_id", "text", stop_words=STOP_WORDS)
    held = F.udf(lambda v: v.values.tolist(), "array<double>")  # the vector type has no Arrow form
    per_row = rows.select(F.col("doc_id").alias("id"), held("embedding").alias("v")).where(F.size("v") > 0)
    return per_row.select(
        "id",
        F.size("v").cast("bigint").alias("terms"),
        F.round(F.array_max("v"), 6).alias("largest"),
        F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x), 5).alias("total"),
    )


# -- projections -----------------------------------------------------------------------------------
@query(
    "embedding_transform",
    "SELECT vec_id, " + ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS emb_{i}" for i in range(50)) + " FROM embeddings",
)
def embedding_transform(spark, folder):
    rows = table(spark, folder, "embeddings").select("vec_id", "embedding")
    return embed.embedding_transform(rows, "embedding", N_DIMS).drop("embedding")


_AXES = "SELECT count(*) AS n, true AS centred, true AS uncorrelated, true AS ordered, true AS beats_columns FROM "


def _axes(placed, largest=None):
    """Properties that principal coordinates must have; `largest` is the greatest variance of a column."""
    moments = placed.agg(
        F.count("x").alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"), F.covar_samp("x", "y").alias("c"),
        F.var_samp("x").alias("vx"), F.var_samp("y").alias("vy"),
    )
    beats = F.lit(True) if largest is None else F.col("vx") >= largest * (1 - 1e-9)
    return moments.select(
        "n",
        (F.greatest(F.abs("mx"), F.abs("my")) < 1e-9).alias("centred"),
        (F.abs("c") <= 1e-6 * F.col("vx")).alias("uncorrelated"),
        (F.col("vx") >= F.col("vy")).alias("ordered"),
        beats.alias("beats_columns"),
    )


@query("pca2d", _AXES + "embeddings")
def pca2d(spark, folder):
    rows = table(spark, folder, "embeddings")
    columns = [F.var_samp(F.col("embedding")[i].cast("double")) for i in range(N_DIMS)]
    return _axes(reduce.pca(rows, "embedding"), rows.agg(F.greatest(*columns)).scalar())


@query("pca_text", _AXES + "documents")
def pca_text(spark, folder):
    """Over all terms of all documents."""
    rows = embed.tfidf_vectors(table(spark, folder, "documents"), "doc_id", "text", stop_words=STOP_WORDS)
    return _axes(reduce.pca(rows, "embedding"))


@query(
    "pca_two_columns",
    """
WITH m AS (SELECT avg(p_size) AS ma, avg(p_retailprice / 100) AS mb, var_samp(p_size) AS a, var_samp(p_retailprice / 100) AS c,
  covar_samp(p_size, p_retailprice / 100) AS b FROM part),
e AS (SELECT *, (a + c) / 2 + sqrt(pow((a - c) / 2, 2) + b * b) AS l1 FROM m),
v AS (SELECT *, b / sqrt(b * b + pow(l1 - a, 2)) AS u, (l1 - a) / sqrt(b * b + pow(l1 - a, 2)) AS w FROM e)
SELECT p_partkey, round(((p_size - ma) * u + (p_retailprice / 100 - mb) * w) * sign(CASE WHEN abs(u) >= abs(w) THEN u ELSE w END), 6) + 0.0 AS x
FROM part, v""",
)
def pca_two_columns(spark, folder):
    """Two columns, whose first axis has a closed form."""
    rows = table(spark, folder, "part").select(
        "p_partkey", F.array(F.col("p_size").cast("double"), F.col("p_retailprice") / 100).alias("v")
    )
    return reduce.pca(rows, "v", 1).select("p_partkey", (F.round("x", 6) + F.lit(0.0)).alias("x"))


@query(
    "landmark_mds",
    """SELECT a.vec_id, round(sqrt(pow(a.embedding[1]::DOUBLE - b.embedding[1]::DOUBLE, 2) + pow(a.embedding[2]::DOUBLE - b.embedding[2]::DOUBLE, 2)), 6) AS distance
FROM embeddings a, embeddings b WHERE b.vec_id = 0""",
)
def landmark_mds(spark, folder):
    """Points of a plane keep their distances; shown are those to the first one."""
    plane = F.array(*[F.col("embedding")[i].cast("double") for i in range(2)])
    rows = table(spark, folder, "embeddings").select("vec_id", F.array_append(plane, F.lit(0.0)).alias("v"))
    placed = reduce.landmark_mds(rows, "vec_id", "v")
    first = placed.where("vec_id = 0").select(F.struct("x", "y")).scalar()
    away = F.sqrt(F.pow(F.col("x") - first["x"], F.lit(2)) + F.pow(F.col("y") - first["y"], F.lit(2)))
    return placed.select("vec_id", (F.round(away, 6) + F.lit(0.0)).alias("distance"))


@query("landmark_mds_text", "SELECT count(*) AS n, true AS placed FROM documents")
def landmark_mds_text(spark, folder):
    """TF-IDF vectors of all terms; every document gets coordinates."""
    found = workflows.explore(table(spark, folder, "documents"), "doc_id", text="text", reduction="landmark_mds", n_clusters=1)
    return found.frame.agg(F.count("*").alias("n"), (F.count("x") == F.count("*")).alias("placed"))


@query(
    "explore_features",
    """WITH m AS (SELECT p_partkey, CAST(p_size AS FLOAT)::DOUBLE AS a, CAST(p_retailprice AS FLOAT)::DOUBLE AS b FROM part)
SELECT p_partkey, round(sqrt(pow(a - (SELECT avg(a) FROM m), 2) + pow(b - (SELECT avg(b) FROM m), 2)), 4) AS radius FROM m""",
)
def explore_features(spark, folder):
    """No text column: the numeric features are the embedding, and a real reduction turns three of them (one is
    constant) to two axes, which keeps every distance from the mean."""
    rows = table(spark, folder, "part").select("p_partkey", F.col("p_size").cast("double").alias("a"), F.col("p_retailprice").alias("b"))
    found = workflows.explore(rows.withColumn("c", F.lit(1.0)), "p_partkey", n_clusters=1)
    axes = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y"))
    return found.frame.select("p_partkey", F.round(axes, 4).alias("radius"))


@query(
    "embed_encoder",
    "SELECT doc_id, CAST(length(text) AS DOUBLE) AS chars, CAST(length(text) - length(replace(text, ' ', '')) AS DOUBLE) AS spaces FROM documents",
)
def embed_encoder(spark, folder):
    """A user's encoder, called on lists of texts."""

    def encoder(texts):
        return np.array([[len(t), t.count(" ")] for t in texts])

    rows = embed.embed(table(spark, folder, "documents").select("doc_id", "text"), "text", text_col="text", encoder=encoder)
    return rows.select("doc_id", *[F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate(("chars", "spaces"))])


@query(
    "reduce_axes",
    """SELECT p_partkey, round(abs(p_size - (SELECT avg(p_size) FROM part)), 6) AS away FROM part""",
)
def reduce_axes(spark, folder):
    """Columns that vary along one line: the first axis of the reduction is the distance along it."""
    size = F.col("p_size").cast("double")
    rows = table(spark, folder, "part").select("p_partkey", (size * 0.6).alias("u"), (size * 0.8).alias("v"), F.lit(2.0).alias("w"))
    placed = reduce.reduce_transform(rows, columns=["u", "v", "w"])
    return placed.select("p_partkey", F.round(F.abs("x"), 6).alias("away"))


@query(
    "reduce_passthrough",
    "SELECT p_partkey, CAST(p_size AS DOUBLE) AS x, p_retailprice AS y FROM part",
)
def reduce_passthrough(spark, folder):
    rows = table(spark, folder, "part").select("p_partkey", "p_size", "p_retailprice")
    placed = reduce.reduce_transform(rows, columns=["p_size", "p_retailprice"])
    return placed.select("p_partkey", "x", "y")


# -- projection quality: two axis-aligned projections -----------------------------------------------
METHODS = {"first": ("x", "y"), "second": ("x2", "y2")}


def _projected(spark, folder):
    return vectors(spark, folder).withColumns(
        {"x2": F.col("embedding")[2].cast("double"), "y2": F.col("embedding")[3].cast("double")}
    )


_PROJ = """
p AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e,
  [CAST(embedding[1] AS DOUBLE), CAST(embedding[2] AS DOUBLE)] AS first,
  [CAST(embedding[3] AS DOUBLE), CAST(embedding[4] AS DOUBLE)] AS second FROM embeddings)"""
_RANKS = """
ab AS (SELECT a.id AS i, b.id AS j, list_distance(a.e, b.e) AS d, list_distance(a.first, b.first) AS f,
  list_distance(a.second, b.second) AS s FROM p a JOIN p b ON a.id <> b.id),
rk AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY d, j) AS ro,
  row_number() OVER (PARTITION BY i ORDER BY f, j) AS rf, row_number() OVER (PARTITION BY i ORDER BY s, j) AS rs FROM ab),
n AS (SELECT count(*) AS n FROM p),
m AS (SELECT 'first' AS method, ro, rf AS rr, d, f AS e FROM rk UNION ALL SELECT 'second', ro, rs, d, s FROM rk)"""
_CURVES = """
ks AS (SELECT unnest(generate_series(5, least(50, n - 1) - 1, 5)) AS k FROM n),
curves AS (SELECT method, k, round(1 - 2.0 / (n * k * (2 * n - 3 * k - 1)) * sum(greatest(ro - k, 0)), 6) AS trustworthiness,
  round(1 - count(*) FILTER (ro > k) / (n * k), 6) AS continuity
  FROM m, ks, n WHERE rr <= k AND 2 * k < n GROUP BY method, k, n)"""


@query(
    "quality_curves",
    "WITH "
    + _PROJ
    + ","
    + _RANKS
    + ","
    + _CURVES
    + " SELECT method, CAST(k AS INTEGER) AS k, trustworthiness, continuity FROM curves",
)
def quality_curves(spark, folder):
    return quality.quality_curves(_projected(spark, folder), "vec_id", "embedding", METHODS)


@query(
    "quality_metrics",
    "WITH "
    + _PROJ
    + ","
    + _RANKS
    + """, t AS (SELECT 1 - 2.0 / (n * 10 * (2 * n - 31)) * sum(greatest(ro - 10, 0)) AS t
  FROM m, n WHERE method = 'first' AND rr <= 10 GROUP BY n)
SELECT round(t, 6) AS trustworthiness, round(sqrt(sum(pow(d - e, 2)) / sum(d * d)), 6) AS stress,
  max(n.n) AS n_samples, CAST(10 AS INTEGER) AS k FROM m, n, t WHERE method = 'first' GROUP BY t""",
)
def quality_metrics(spark, folder):
    return quality.quality_metrics(_projected(spark, folder), "vec_id", "embedding")


_NUMBERED = """
pos AS (SELECT *, row_number() OVER (ORDER BY id) - 1 AS pos FROM p),
n AS (SELECT count(*) AS n FROM p),
raw AS (SELECT g AS pair_id, n, CAST('0x' || substr(md5(g || ':i:42'), 1, 8) AS BIGINT) % n AS i,
  CAST('0x' || substr(md5(g || ':j:42'), 1, 8) AS BIGINT) % (n - 1) AS j0
  FROM n, generate_series(0, {draws} - 1) AS s(g) WHERE g < n * (n - 1) // 2),
pr AS (SELECT pair_id, i, CASE WHEN j0 >= i THEN j0 + 1 ELSE j0 END AS j FROM raw),
dd AS (SELECT pair_id, i, j, list_distance(a.e, b.e) AS d, list_distance(a.first, b.first) AS f,
  list_distance(a.second, b.second) AS s FROM pr JOIN pos a ON a.pos = i JOIN pos b ON b.pos = j)"""
_STRESS = """
st AS (SELECT 'first' AS method, sqrt(sum(pow(d - f, 2)) / sum(d * d)) AS raw FROM dd
  UNION ALL SELECT 'second', sqrt(sum(pow(d - s, 2)) / sum(d * d)) FROM dd)"""


@query(
    "quality_stress_sampled",
    "WITH "
    + _PROJ
    + ","
    + _NUMBERED.format(draws=5000)
    + ","
    + _STRESS
    + """ SELECT method, round(raw, 4) AS stress,
  CASE WHEN raw < 0.1 THEN 'green' WHEN raw < 0.3 THEN 'orange' ELSE 'red' END AS level FROM st""",
)
def quality_stress_sampled(spark, folder):
    return quality.sampled_stress(_projected(spark, folder), "vec_id", "embedding", METHODS)


@query(
    "shepard_pairs",
    "WITH "
    + _PROJ
    + ","
    + _NUMBERED.format(draws=10000)
    + """ SELECT pair_id, round(d, 6) AS original, round(f, 6) AS reduced FROM dd WHERE i < j ORDER BY pair_id LIMIT 5000""",
)
def shepard_pairs(spark, folder):
    return quality.shepard_pairs(_projected(spark, folder), "vec_id", "embedding")


@query(
    "quality_recommend",
    "WITH "
    + _PROJ
    + ","
    + _RANKS
    + ","
    + _CURVES
    + ","
    + _NUMBERED.format(draws=5000).split("n AS (SELECT count(*) AS n FROM p),")[0]
    + _NUMBERED.format(draws=5000).split("n AS (SELECT count(*) AS n FROM p),")[1]
    + ","
    + _STRESS
    + """, sc AS (SELECT method, round((avg(trustworthiness) + avg(continuity)) / 2 - 0.1 * max(round(raw, 4)), 6) AS score
  FROM curves JOIN st USING (method) GROUP BY method)
SELECT method, score, row_number() OVER (ORDER BY score DESC, method) = 1 AS best FROM sc""",
)
def quality_recommend(spark, folder):
    rows = _projected(spark, folder)
    curves = quality.quality_curves(rows, "vec_id", "embedding", METHODS)
    stress = quality.sampled_stress(rows, "vec_id", "embedding", METHODS)
    return quality.recommend(curves, stress)


@query("reduce_with_quality", "SELECT count(*) AS n_samples, CAST(10 AS INTEGER) AS k, true AS better_than_axes FROM embeddings")
def reduce_with_quality(spark, folder):
    """Principal axes keep all-pairs distances at least as well as the first two columns do."""
    rows = _projected(spark, folder)
    _, metrics = quality.reduce_with_quality(rows.select("vec_id", "embedding"), "vec_id")
    axes = quality.quality_metrics(rows, "vec_id", "embedding").select("stress").scalar()
    return metrics.select("n_samples", "k", (F.col("stress") <= axes).alias("better_than_axes"))


@query(
    "feature_vector",
    "SELECT p_partkey, [CAST(p_size AS DOUBLE), p_retailprice] AS features FROM part",
)
def feature_vector(spark, folder):
    rows = transforms.feature_vector(table(spark, folder, "part"), ["p_size", "p_retailprice"], "features")
    return rows.select("p_partkey", "features")


@query(
    "hash_sample",
    "SELECT o_orderkey FROM orders ORDER BY md5(o_orderkey || ':42'), o_orderkey LIMIT 100",
)
def hash_sample(spark, folder):
    return scale.hash_sample(table(spark, folder, "orders").select("o_orderkey"), "o_orderkey", 100)


@query(
    "global_rank",
    "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS rank FROM orders",
)
def global_rank(spark, folder):
    return scale.global_rank(table(spark, folder, "orders").select("o_orderkey"), "o_orderkey")


@query(
    "global_rank_text",
    "SELECT 'customer-with-a-long-start-' || lpad(CAST(c_custkey AS VARCHAR), 12, '0') AS id, row_number() OVER (ORDER BY c_custkey) AS rank FROM customer",
)
def global_rank_text(spark, folder):
    """Ids that share a long start."""
    text = F.concat(F.lit("customer-with-a-long-start-"), F.lpad(F.col("c_custkey").cast("string"), 12, "0"))
    return scale.global_rank(table(spark, folder, "customer").select(text.alias("id")), "id")


@query(
    "categorical_columns",
    """SELECT 'label' AS "column", count(DISTINCT label) <= 20 AS categorical FROM embeddings
UNION ALL SELECT 'vec_id', count(DISTINCT vec_id) <= 20 FROM embeddings""",
)
def categorical_columns(spark, folder):
    rows = table(spark, folder, "embeddings").select("label", "vec_id")
    few = evaluate.low_cardinality(rows, ["label", "vec_id"])
    return spark.createDataFrame(list(few.items()), "column string, categorical boolean")
