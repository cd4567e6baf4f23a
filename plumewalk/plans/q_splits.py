"""Queries over validation plans."""

from pyspark.sql import functions as F

from plumewalk.operators import splits as sl
from plumewalk.plans import views as v
from plumewalk.plans.registry import query
from plumewalk.plans.views import sql_with

KEYS, ORDER = ["subject_id"], ["ts", "event_id"]

def rows():
    return F.count(F.lit(1)).alias("n")
_P = "WITH p AS (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY ts, event_id) - 1 AS pos, count(*) OVER (PARTITION BY subject_id) AS n FROM obs) "


@query("l01_subject_holdout", sql_with("obs", "WITH s AS (SELECT subject_id, md5('42:' || subject_id) AS h FROM (SELECT DISTINCT subject_id FROM obs)), r AS (SELECT subject_id, row_number() OVER (ORDER BY h, subject_id) AS k, count(*) OVER () AS n FROM s) SELECT subject_id, CASE WHEN k <= greatest(1, floor(n * 0.2 + 1e-9)) THEN 'holdout' ELSE 'development' END AS role, count(*) AS n FROM r JOIN obs USING (subject_id) GROUP BY ALL"))
def l01_subject_holdout(spark, sf_dir):
    return sl.subject_holdout(v.obs(spark, sf_dir)).groupBy("subject_id", "role").agg(rows())


@query("l02_group_folds", sql_with("obs", "WITH s AS (SELECT subject_id, count(*) AS n FROM obs GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, subject_id) - 1 AS k FROM s) SELECT subject_id, n, (CASE WHEN (k // 4) % 2 = 0 THEN k % 4 ELSE 3 - k % 4 END)::INT AS fold FROM r"))
def l02_group_folds(spark, sf_dir):
    return sl.group_folds(v.obs(spark, sf_dir)).groupBy("subject_id", "fold").agg(rows())


@query(
    "l03_spatial_blocks",
    sql_with("loc", "WITH e AS (SELECT subject_id, max(x) - min(x) >= max(y) - min(y) AS w FROM loc GROUP BY 1), a AS (SELECT pid, subject_id, CASE WHEN w THEN x ELSE y END AS a FROM loc JOIN e USING (subject_id)), c AS (SELECT subject_id, quantile_cont(a, 1/3.0::DOUBLE) AS c1, quantile_cont(a, 2/3.0::DOUBLE) AS c2 FROM a GROUP BY 1) SELECT subject_id, ((c1 < a)::INT + (c2 < a)::INT) AS block, count(*) AS n FROM a JOIN c USING (subject_id) GROUP BY ALL"),
)
def l03_spatial_blocks(spark, sf_dir):
    return sl.spatial_blocks(v.loc(spark, sf_dir), KEYS).groupBy("subject_id", "block").agg(rows())


@query("l04_temporal_split", sql_with("obs", _P + "SELECT event_id, pos, CASE WHEN pos < floor(n * 0.8 + 1e-9) THEN 'train' WHEN pos >= floor(n * 0.8 + 1e-9) + 3 THEN 'test' END AS role FROM p"))
def l04_temporal_split(spark, sf_dir):
    return sl.temporal_split(v.obs(spark, sf_dir), KEYS, ORDER, gap=3).select("event_id", "pos", "role")


@query(
    "l05_walk_forward",
    sql_with("obs", _P + ", f AS (SELECT p.*, i::INT AS fold, n - (4 - i) * (n // 5) AS s, n // 5 AS m FROM p, range(0, 4) r(i)), l AS (SELECT event_id, fold, CASE WHEN pos >= greatest(0, s - 2 - 20) AND pos < s - 2 THEN 'train' WHEN pos >= s AND pos < s + m THEN 'test' END AS role FROM f) SELECT * FROM l WHERE role IS NOT NULL"),
)
def l05_walk_forward(spark, sf_dir):
    return sl.walk_forward(v.obs(spark, sf_dir), KEYS, ORDER, k=4, gap=2, max_train=20).select("event_id", "fold", "role")


@query(
    "l06_blocked_folds",
    sql_with("obs", _P + ", f AS (SELECT p.*, i::INT AS fold, greatest(n // 8, 1) AS b, n - (4 - i) * (n // 5) AS s, n // 5 AS m FROM p, range(0, 4) r(i)), g AS (SELECT *, n // b >= 5 AS ok FROM f), "
             "l AS (SELECT event_id, fold, CASE WHEN pos < CASE WHEN ok THEN (fold + 1) * b ELSE s END THEN 'train' WHEN ok AND pos >= (fold + 1) * b AND pos < least((fold + 2) * b, n) THEN 'test' WHEN NOT ok AND pos >= s AND pos < s + m THEN 'test' END AS role FROM g) SELECT * FROM l WHERE role IS NOT NULL"),
)
def l06_blocked_folds(spark, sf_dir):
    return sl.blocked_folds(v.obs(spark, sf_dir), KEYS, ORDER, k=4).select("event_id", "fold", "role")


@query("l07_forecast_holdout", sql_with("obs", _P + "SELECT event_id, CASE WHEN n - 18 < 0.7 * n THEN 'short' WHEN pos >= n - 18 THEN 'test' ELSE 'train' END AS role FROM p"))
def l07_forecast_holdout(spark, sf_dir):
    return sl.forecast_holdout(v.obs(spark, sf_dir), KEYS, ORDER, 18).select("event_id", "role")
