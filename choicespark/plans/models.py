"""Factor and cluster plans on ``embeddings`` (item matrix = the 64-d vector,
true ``label`` as the cluster id wherever an oracle is wanted)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from choicespark import config as cfg
from choicespark.functions.nulls import scaled
from choicespark.operators import clusters as K
from choicespark.operators import cold_start as CS
from choicespark.operators import factors as FA
from choicespark.operators.joins import label_lookup
from choicespark.plans.registry import query, table
from choicespark.sources.files import scratch_path


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings")


def _items(p: int) -> list[str]:
    return [f"d{j}" for j in range(p)]


_UNNEST = """u AS (SELECT vec_id, label, generate_subscripts(embedding, 1) - 1 AS i,
                    CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)"""


@query("corr_matrix", "WITH " + _UNNEST + """
SELECT CAST(a.i AS INTEGER) AS i, CAST(b.i AS INTEGER) AS j, CAST(round(corr(a.x, b.x) * 1e6) AS BIGINT) AS corr_ppm
FROM u a JOIN u b ON a.vec_id = b.vec_id GROUP BY a.i, b.i""")
def q_corr_matrix(spark, sf_dir):
    v = FA.vectorize(embeddings(spark, sf_dir), "embedding")
    R = FA.correlation_matrix(v)
    p = R.shape[0]
    rows = [(i, j, float(R[i, j])) for i in range(p) for j in range(p)]
    m = spark.createDataFrame(rows, "i int, j int, corr double")
    return m.select("i", "j", scaled("corr").alias("corr_ppm"))


def factor_model(spark: SparkSession, sf_dir: str) -> FA.FactorModel:
    return FA.fit_factor_model(embeddings(spark, sf_dir), "embedding", cfg.N_FACTORS)


@query("factor_loadings")
def q_factor_loadings(spark, sf_dir):
    m = factor_model(spark, sf_dir)
    return FA.loadings_table(spark, m, _items(m.loadings.shape[0]), cfg.FACTOR_NAMES)


@query("factor_scores")
def q_factor_scores(spark, sf_dir):
    m = factor_model(spark, sf_dir)
    return FA.factor_scores(embeddings(spark, sf_dir), "embedding", m, cfg.FACTOR_NAMES).drop("embedding")


@query("noise_variance")
def q_noise_variance(spark, sf_dir):
    m = factor_model(spark, sf_dir)
    return spark.createDataFrame([(m.noise_variance_total, m.log_likelihood, m.n_iter)],
                                 "noise_variance_total double, log_likelihood double, n_iter int")


@query("top3_loadings", "WITH " + _UNNEST + """,
c AS (SELECT CAST(a.i AS INTEGER) AS item, CAST(b.i AS INTEGER) AS other, corr(a.x, b.x) AS r
      FROM u a JOIN u b ON a.vec_id = b.vec_id WHERE a.i <> b.i GROUP BY a.i, b.i),
k AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY abs(r) DESC, other) AS rank FROM c)
SELECT item, other, CAST(round(r * 1e6) AS BIGINT) AS corr_ppm, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 3""")
def q_top3_loadings(spark, sf_dir):
    """The three strongest entries of every row of the correlation matrix, signs kept."""
    R = FA.correlation_matrix(FA.vectorize(embeddings(spark, sf_dir), "embedding"))
    p = R.shape[0]
    m = spark.createDataFrame([(i, j, float(R[i, j])) for i in range(p) for j in range(p) if i != j], "item int, other int, r double")
    return K.top_abs(m, "item", "other", "r", 3).select("item", "other", scaled("r").alias("corr_ppm"), "rank")


def _kmeans(spark, sf_dir):
    v = FA.vectorize(embeddings(spark, sf_dir), "embedding")
    model, remap, centres = K.kmeans_fit(v, k=cfg.N_CLUSTERS, restarts=cfg.CLUSTER_RESTARTS, seed=cfg.SEED)
    return v, model, remap, centres


@query("kmeans_fit")
def q_kmeans_fit(spark, sf_dir):
    v, model, remap, _ = _kmeans(spark, sf_dir)
    return K.assign(v, model, remap).select("vec_id", "cluster")


@query("cold_start")
def q_cold_start(spark, sf_dir):
    """Fit factors and centres once, store them, and score rows with the stored model only."""
    emb = embeddings(spark, sf_dir)
    fm = factor_model(spark, sf_dir)
    scored = FA.factor_scores(emb, "embedding", fm, cfg.FACTOR_NAMES)
    fv = FA.vectorize(scored.withColumn("fvec", F.array(*[F.col(n) for n in cfg.FACTOR_NAMES])), "fvec")
    _, _, centres = K.kmeans_fit(fv, k=cfg.N_CLUSTERS, restarts=cfg.CLUSTER_RESTARTS, seed=cfg.SEED)
    path = scratch_path(spark, "cold-start")
    CS.save(spark, CS.ColdStartModel(fm, list(cfg.FACTOR_NAMES), centres), path)
    return CS.score(emb, "embedding", CS.load(spark, path)).select("vec_id", "cluster", "type_label")


@query("kmeans_checks", f"""
SELECT count(*) AS n, {cfg.N_CLUSTERS} AS clusters, CAST(0 AS BIGINT) AS moved_ppm, CAST(0 AS BIGINT) AS misassigned FROM embeddings""")
def q_kmeans_checks(spark, sf_dir):
    """What any finished k-means fit satisfies: each row is with its nearest centre, each centre is its rows' mean.

    ``moved_ppm`` is the largest distance of a centre from its rows' mean, in steps of the fit's tolerance.
    """
    v, model, remap, centres = _kmeans(spark, sf_dir)
    rows = K.assign(v, model, remap).withColumn("x", F.col("embedding").cast("array<double>"))
    rows = rows.withColumn("nearest", K.nearest_centre(F.col("x"), list(enumerate(centres))))
    own = K.cluster_stats(rows, "embedding", "cluster")
    moved = max(float(((y / n - centres[c]) ** 2).sum() ** 0.5) for c, n, y, _ in own)
    return rows.agg(F.count(F.lit(1)).alias("n"), F.lit(len(own)).alias("clusters"),
                    F.lit(int(moved // 1e-3)).cast("bigint").alias("moved_ppm"),
                    F.count_if(F.col("nearest") != F.col("cluster")).alias("misassigned"))


@query("factor_checks", "WITH " + _UNNEST + f"""
SELECT factor, CAST(0 AS BIGINT) AS mean_ppm, (SELECT count(*) FROM embeddings) AS n
FROM (SELECT unnest([{", ".join(f"'{f}'" for f in cfg.FACTOR_NAMES)}]) AS factor)""")
def q_factor_checks(spark, sf_dir):
    """Scores of standardised items have mean zero, whatever the loadings."""
    m = factor_model(spark, sf_dir)
    s = FA.factor_scores(embeddings(spark, sf_dir), "embedding", m, cfg.FACTOR_NAMES)
    long = s.select(*cfg.FACTOR_NAMES).unpivot([], cfg.FACTOR_NAMES, "factor", "x")
    return long.groupBy("factor").agg((scaled(F.avg("x") + 0.0)).alias("mean_ppm"), F.count("x").alias("n"))


_PER_LOADING = "WITH " + _UNNEST + f"""
SELECT 'd' || i AS question, factor, CAST(0 AS BIGINT) AS gap_ppm, CAST(0 AS BIGINT) AS mean_ppm, count(*) AS n
FROM u, (SELECT unnest([{", ".join(f"'{f}'" for f in cfg.FACTOR_NAMES)}]) AS factor) GROUP BY i, factor"""


def _loading_gaps(spark, sf_dir, m: FA.FactorModel) -> DataFrame:
    """Per item and factor, how far their covariance over the rows is from the loading."""
    cov, mean, n = FA.score_covariances(embeddings(spark, sf_dir), "embedding", m)
    items = _items(cov.shape[0])
    rows = [(items[j], f, float(abs(cov[j, i] - m.loadings[j, i])), float(mean[i] + 0.0), n)
            for i, f in enumerate(cfg.FACTOR_NAMES) for j in range(cov.shape[0])]
    long = spark.createDataFrame(rows, "question string, factor string, gap double, mean double, n long")
    return long.select("question", "factor", scaled("gap").alias("gap_ppm"), scaled(F.abs("mean")).alias("mean_ppm"), "n")


@query("factor_loading_checks", _PER_LOADING)
def q_factor_loading_checks(spark, sf_dir):
    """Item j and the scores of factor i covary by loading (j, i): false for any other loadings or weights."""
    return _loading_gaps(spark, sf_dir, factor_model(spark, sf_dir))


@query("factor_rotation_checks", _PER_LOADING)
def q_factor_rotation_checks(spark, sf_dir):
    """The same of the varimax-rotated factors and their turned weights."""
    return _loading_gaps(spark, sf_dir, FA.varimax_rotation(factor_model(spark, sf_dir)))


@query("factor_rotation", "WITH " + _UNNEST + """
SELECT 'd' || i AS question, CAST(0 AS BIGINT) AS moved_ppm, CAST(100 AS BIGINT) AS unity_centi, true AS simpler, stddev_pop(x) > 0 AS varies
FROM u GROUP BY i""")
def q_factor_rotation(spark, sf_dir):
    """Per item: varimax leaves its communality; communality and noise add up to one (to a
    hundredth, as the fit stops by its likelihood); the criterion does not fall."""
    m = factor_model(spark, sf_dir)
    r = FA.varimax_rotation(m)
    before, after = (m.loadings ** 2).sum(axis=1), (r.loadings ** 2).sum(axis=1)
    simpler = FA.varimax_criterion(r.loadings) >= FA.varimax_criterion(m.loadings)
    rows = [(q, float(abs(a - b)), float(a + noise), bool(simpler), j not in m.constant)
            for j, (q, b, a, noise) in enumerate(zip(_items(len(before)), before, after, r.noise))]
    t = spark.createDataFrame(rows, "question string, moved double, unity double, simpler boolean, varies boolean")
    return t.select("question", scaled("moved").alias("moved_ppm"), F.round(F.col("unity") * 100).cast("bigint").alias("unity_centi"), "simpler", "varies")


@query("pca_checks", "WITH " + _UNNEST + """,
m AS (SELECT i, avg(x) AS m FROM u GROUP BY i),
t AS (SELECT sum((x - m) * (x - m)) AS total FROM u JOIN m USING (i))
SELECT (SELECT count(*) FROM embeddings) AS n, CAST(round(total * 1e3) AS BIGINT) AS total_milli, CAST(0 AS BIGINT) AS ratio_gap_ppm,
       CAST(0 AS BIGINT) AS mixed_ppm FROM t""")
def q_pca_checks(spark, sf_dir):
    """Explained shares equal the components' sums of squares over the table's; the components are uncorrelated."""
    e = embeddings(spark, sf_dir)
    out, ratio = K.pca_2d(FA.vectorize(e, "embedding"))
    total = sum(float(psi - (y ** 2).sum() / n) for _, n, y, psi in K.cluster_stats(e.withColumn("one", F.lit(1)), "embedding", "one"))
    a = out.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("pc1") ** 2).alias("s1"), F.sum(F.col("pc2") ** 2).alias("s2"), F.corr("pc1", "pc2").alias("r"))
    gap = F.abs((F.col("s1") + F.col("s2")) / F.lit(total) - F.lit(sum(ratio)))
    return a.select("n", F.round(F.lit(total) * 1e3).cast("bigint").alias("total_milli"), scaled(gap).alias("ratio_gap_ppm"), scaled(F.abs("r")).alias("mixed_ppm"))


@query("pca_2d")
def q_pca_2d(spark, sf_dir):
    v = FA.vectorize(embeddings(spark, sf_dir), "embedding")
    out, ratio = K.pca_2d(v)
    return out.select("vec_id", "label", "pc1", "pc2", F.lit(ratio[0]).alias("explained_1"),
                      F.lit(ratio[1]).alias("explained_2"))


@query("nearest_centre", "WITH " + _UNNEST + """,
c AS (SELECT label AS cid, i, avg(x) AS m FROM u GROUP BY label, i),
d AS (SELECT u.vec_id, c.cid, sum((u.x - c.m) * (u.x - c.m)) AS dist FROM u JOIN c ON u.i = c.i GROUP BY u.vec_id, c.cid)
SELECT vec_id, cid AS nearest FROM (
  SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY dist, cid) AS rn FROM d) WHERE rn = 1""")
def q_nearest_centre(spark, sf_dir):
    emb = embeddings(spark, sf_dir)
    stats = K.cluster_stats(emb, "embedding", "label")
    centres = [(cid, y / n) for cid, n, y, _ in stats]
    return emb.select("vec_id", K.nearest_centre(F.col("embedding").cast("array<double>"), centres).alias("nearest"))


@query("silhouette_sq", "WITH " + _UNNEST + """,
cs AS (SELECT label AS cid, count(DISTINCT vec_id) AS n FROM u GROUP BY label),
cy AS (SELECT label AS cid, i, sum(x) AS y FROM u GROUP BY label, i),
cp AS (SELECT label AS cid, sum(x * x) AS psi FROM u GROUP BY label),
xx AS (SELECT vec_id, label, sum(x * x) AS xx FROM u GROUP BY vec_id, label),
dot AS (SELECT u.vec_id, cy.cid, sum(u.x * cy.y) AS xy FROM u JOIN cy ON u.i = cy.i GROUP BY u.vec_id, cy.cid),
dd AS (SELECT xx.vec_id, xx.label, dot.cid, cs.n, (cs.n * xx.xx - 2 * dot.xy + cp.psi) / cs.n AS d
       FROM xx JOIN dot ON xx.vec_id = dot.vec_id JOIN cs ON dot.cid = cs.cid JOIN cp ON dot.cid = cp.cid),
per AS (SELECT vec_id, max(CASE WHEN cid = label THEN d * n / (n - 1) END) AS a,
               min(CASE WHEN cid <> label THEN d END) AS b, max(CASE WHEN cid = label THEN n END) AS n_own
        FROM dd GROUP BY vec_id),
s AS (SELECT CASE WHEN n_own <= 1 THEN 0.0 WHEN a < b THEN 1 - a / b WHEN a > b THEN b / a - 1 ELSE 0.0 END AS s FROM per)
SELECT CAST(round(avg(s) * 1e6) AS BIGINT) AS silhouette_ppm, count(*) AS n FROM s""")
def q_silhouette_sq(spark, sf_dir):
    r = K.silhouette_squared(embeddings(spark, sf_dir), "embedding", "label")
    return r.select(scaled("silhouette").alias("silhouette_ppm"), "n")


@query("silhouette_euclid", """
WITH d AS (SELECT a.vec_id, a.label, b.label AS cid, sum(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[])) AS s, count(*) AS n
           FROM embeddings a, embeddings b GROUP BY a.vec_id, a.label, b.label),
p AS (SELECT vec_id, max(CASE WHEN cid = label THEN s / greatest(n - 1, 1) END) AS a, min(CASE WHEN cid <> label THEN s / n END) AS b,
             max(CASE WHEN cid = label THEN n END) AS own FROM d GROUP BY vec_id)
SELECT CAST(round(avg(CASE WHEN own <= 1 THEN 0.0 ELSE (b - a) / greatest(a, b) END) * 1e6) AS BIGINT) AS silhouette_ppm, count(*) AS n FROM p""")
def q_silhouette_euclid(spark, sf_dir):
    r = K.silhouette_euclidean(embeddings(spark, sf_dir), "embedding", "label")
    return r.select(scaled("silhouette").alias("silhouette_ppm"), "n")


_LONG = "l AS (SELECT label, 'f' || CAST(i AS VARCHAR) AS factor, x FROM u)"


@query("cluster_profile", "WITH " + _UNNEST + "," + _LONG + """
SELECT label, factor, count(*) AS size, CAST(round(avg(x) * 1e6) AS BIGINT) AS mean_ppm FROM l GROUP BY label, factor""")
def q_cluster_profile(spark, sf_dir):
    """Cluster size and mean of every vector component."""
    p = K.profile_long(K.unnest(embeddings(spark, sf_dir), ["label"], "embedding"), "label", "factor", "x")
    return p.select("label", "factor", "size", scaled("mean").alias("mean_ppm"))


@query("cluster_sizes", """
SELECT label, count(*) AS size, CAST(round(CAST(count(*) AS DOUBLE) / sum(count(*)) OVER () * 1e6) AS BIGINT) AS share_ppm
FROM embeddings GROUP BY label""")
def q_cluster_sizes(spark, sf_dir):
    s = K.sizes(embeddings(spark, sf_dir), "label")
    return s.select("label", "size", scaled("share").alias("share_ppm"))


@query("cluster_histogram", "WITH " + _UNNEST + "," + _LONG + """,
r AS (SELECT label, factor, min(x) AS lo, max(x) AS hi FROM l GROUP BY label, factor)
SELECT l.label, l.factor, CASE WHEN hi = lo THEN 0 ELSE CAST(least(floor((x - lo) / ((hi - lo) / 20.0)), 19) AS INTEGER) END
       AS bin, count(*) AS count
FROM l JOIN r ON l.label = r.label AND l.factor = r.factor GROUP BY ALL""")
def q_cluster_histogram(spark, sf_dir):
    h = K.histogram(K.unnest(embeddings(spark, sf_dir), ["label"], "embedding"), ["label", "factor"], "x", 20)
    return h.select("label", "factor", "bin", "count")


@query("top3_cluster_factors", "WITH " + _UNNEST + "," + _LONG + """,
m AS (SELECT label, factor, avg(x) AS mean FROM l GROUP BY label, factor),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY abs(mean) DESC, factor) AS rank FROM m)
SELECT label, factor, CAST(round(mean * 1e6) AS BIGINT) AS mean_ppm, CAST(rank AS INTEGER) AS rank
FROM r WHERE rank <= 3""")
def q_top3_cluster_factors(spark, sf_dir):
    m = K.profile_long(K.unnest(embeddings(spark, sf_dir), ["label"], "embedding"), "label", "factor", "x")
    t = K.top_abs(m, "label", "factor", "mean", 3)
    return t.select("label", "factor", scaled("mean").alias("mean_ppm"), "rank")


@query("cluster_labels", f"""
SELECT vec_id, label, CASE label {" ".join(f"WHEN {k} THEN '{v}'" for k, v in cfg.TYPE_LABELS.items())} END AS type_label
FROM embeddings""")
def q_cluster_labels(spark, sf_dir):
    labels = spark.createDataFrame(list(cfg.TYPE_LABELS.items()), "label int, type_label string")
    return label_lookup(embeddings(spark, sf_dir).select("vec_id", "label"), labels, "label")
