"""Queries for imputation, flags, scaling, encoding, splits, folds and oversampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskframe.operators import preprocess as R, split as L
from riskframe.operators.neighbor_graph import neighbor_graph, nodes_of
from riskframe.operators.neighbors import knn_join, knn_vote
from riskframe.operators.resample import class_distribution, smote
from riskframe.queries.registry import query
from riskframe.queries.tables import CASE_SPEC, CASES, cases, cases_with_nan, rounded, table, with_cases
from riskframe.session import stage_table

MEDIANS = "(SELECT median(amount) AS amount, median(hour) AS hour, median(k) AS k FROM cases)"


@query(
    "median_impute",
    with_cases(
        f"SELECT event_id, coalesce(c.amount, m.amount) AS amount, coalesce(CAST(c.hour AS DOUBLE), m.hour) AS hour"
        f" FROM cases c CROSS JOIN {MEDIANS} m"
    ),
)
def median_impute(spark, sf):
    df = cases_with_nan(spark, sf)
    fits = R.fit_numeric(df, ["amount", "hour"])
    return df.select("event_id", *[R.impute_numeric(f).alias(f["column"]) for f in fits])


MODES = """(SELECT
  (SELECT kind FROM cases WHERE kind IS NOT NULL GROUP BY kind ORDER BY count(*) DESC, kind LIMIT 1) AS kind,
  (SELECT grp FROM cases WHERE grp IS NOT NULL GROUP BY grp ORDER BY count(*) DESC, grp LIMIT 1) AS grp)"""


@query(
    "mode_impute",
    with_cases(f"SELECT event_id, coalesce(c.kind, m.kind) AS kind, coalesce(c.grp, m.grp) AS grp FROM cases c CROSS JOIN {MODES} m"),
)
def mode_impute(spark, sf):
    df = cases_with_nan(spark, sf)
    fits = R.fit_categorical(df, ["kind", "grp"])
    return df.select("event_id", *[R.impute_categorical(f).alias(f["column"]) for f in fits])


@query(
    "missing_indicator",
    with_cases(
        "SELECT event_id, " + ", ".join(
            f"CASE WHEN {c} IS NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS missing_{c}"
            for c in ("amount", "hour", "kind", "grp")
        ) + " FROM cases"
    ),
)
def missing_indicator(spark, sf):
    df = cases_with_nan(spark, sf)
    fits = R.fit_numeric(df, CASE_SPEC.numeric) + R.fit_categorical(df, CASE_SPEC.categorical)
    flagged = [f for f in fits if f["flag"]]
    return df.select("event_id", *[R.is_missing(f).alias(f"missing_{f['column']}") for f in flagged])


IMPUTED = f"""(SELECT event_id, coalesce(c.amount, m.amount) AS amount, coalesce(CAST(c.hour AS DOUBLE), m.hour) AS hour,
  CAST(coalesce(CAST(c.k AS DOUBLE), m.k) AS DOUBLE) AS k,
  CASE WHEN c.amount IS NULL THEN 1.0 ELSE 0.0 END AS f_amount, CASE WHEN c.hour IS NULL THEN 1.0 ELSE 0.0 END AS f_hour,
  coalesce(c.kind, o.kind) AS kind, coalesce(c.grp, o.grp) AS grp, c.kind IS NULL AS n_kind, c.grp IS NULL AS n_grp
  FROM cases c CROSS JOIN {MEDIANS} m CROSS JOIN {MODES} o)"""


def _z(c: str) -> str:
    return f"round(({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER (), 6) + 0.0"


@query(
    "standard_scale",
    with_cases(f"SELECT event_id, {_z('amount')} AS amount, {_z('hour')} AS hour, {_z('k')} AS k FROM {IMPUTED}"),
)
def standard_scale(spark, sf):
    df = cases_with_nan(spark, sf)
    model = R.preprocessor(CASE_SPEC).fit(df)
    named = model.encode(df, "event_id")
    out = named.select("event_id", *[F.col(f"num__{c}").alias(c) for c in CASE_SPEC.numeric])
    return rounded(out, *CASE_SPEC.numeric)


KINDS = ("click", "error", "purchase", "signup", "view")


def _hit(condition: str, name: str) -> str:
    return f"CASE WHEN {condition} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS {name}"


@query(
    "one_hot_encode",
    with_cases(
        "SELECT event_id, "
        + ", ".join(_hit(f"kind = '{v}'", f"cat__kind_{v}") for v in KINDS)
        + ", "
        + ", ".join(_hit(f"grp = {v}", f"cat__grp_{v}") for v in range(4))
        + f" FROM {IMPUTED}"
    ),
)
def one_hot_encode(spark, sf):
    df = cases(spark, sf)
    fits = R.fit_categorical(df, CASE_SPEC.categorical)
    named = [(n, e) for n, _, e in R.encoded_columns([], fits) if "missingindicator" not in n]
    return df.select("event_id", *[e.alias(n) for n, e in named])


@query(
    "encode_features",
    with_cases(
        f"SELECT event_id, {_z('amount')} AS num__amount, {_z('hour')} AS num__hour, {_z('k')} AS num__k,"
        f" {_z('f_amount')} AS num__missingindicator_amount, {_z('f_hour')} AS num__missingindicator_hour, "
        + ", ".join(_hit(f"kind = '{v}'", f"cat__kind_{v}") for v in KINDS)
        + ", "
        + ", ".join(_hit(f"grp = {v}", f"cat__grp_{v}") for v in range(4))
        + ", "
        + ", ".join(
            _hit(("" if v else "NOT ") + f"n_{c}", f"cat__missingindicator_{c}_{v}")
            for c in ("kind", "grp")
            for v in (0, 1)
        )
        + f" FROM {IMPUTED}"
    ),
)
def encode_features(spark, sf):
    df = cases(spark, sf)
    model = R.preprocessor(CASE_SPEC).fit(df)
    numeric = [n for n in model.feature_names if n.startswith("num__")]
    return rounded(model.encode(df, "event_id"), *numeric)


@query(
    "one_hot_long",
    with_cases(
        "SELECT event_id, 'kind' AS feature, kind AS category FROM cases WHERE kind IS NOT NULL"
        " UNION ALL SELECT event_id, 'grp', CAST(grp AS VARCHAR) FROM cases WHERE grp IS NOT NULL"
    ),
)
def one_hot_long(spark, sf):
    return R.one_hot_long(cases(spark, sf), "event_id", CASE_SPEC.categorical)


@query(
    "one_hot_wide",
    """WITH parts AS (SELECT CASE WHEN p_partkey % 13 <> 0 THEN printf('part %07d', p_partkey) END AS name FROM part),
      counts AS (SELECT name, count(*) AS n FROM parts WHERE name IS NOT NULL GROUP BY name),
      filled AS (SELECT coalesce(name, (SELECT name FROM counts ORDER BY n DESC, name LIMIT 1)) AS name FROM parts)
      SELECT 'cat__name_' || name AS feature, CAST(count(*) AS DOUBLE) AS n FROM filled GROUP BY name
      UNION ALL SELECT 'cat__missingindicator_name_' || CAST(CAST(name IS NULL AS INTEGER) AS VARCHAR), CAST(count(*) AS DOUBLE)
      FROM parts GROUP BY name IS NULL""",
)
def one_hot_wide(spark, sf):
    """A column with thousands of categories as a sparse block: the column sums of the encoded table."""
    name = F.when(F.col("p_partkey") % 13 != 0, F.format_string("part %07d", "p_partkey"))
    df = table(spark, sf, "part").select("p_partkey", name.alias("name"))
    model = R.TabularPreprocessor(numericCols=[], categoricalCols=["name"]).fit(df)
    sums = R.column_sums(model.transform(df))
    return model.names_table().join(sums, "pos", "left").select("feature", F.coalesce("n", F.lit(0.0)).alias("n"))


RANKED = f"""SELECT *, row_number() OVER (PARTITION BY target ORDER BY md5('42:' || CAST(event_id AS VARCHAR))) AS rn,
  count(*) OVER (PARTITION BY target) AS n FROM ({CASES})"""


@query("stratified_split", f"SELECT event_id, target, rn <= floor(n * 0.2 + 0.5) AS is_test FROM ({RANKED})")
def stratified_split(spark, sf):
    return L.stratified_split(cases(spark, sf).select("event_id", "target"), "target", "event_id")


@query("holdout_rows", f"SELECT event_id, amount, target FROM ({RANKED}) WHERE rn <= floor(n * 0.25 + 0.5)")
def holdout_rows(spark, sf):
    df = cases(spark, sf).select("event_id", "amount", "target")
    return L.optional_split(df, "target", "event_id", 0.25)[1]


@query("stratified_folds", f"SELECT event_id, target, CAST(((rn - 1) * 5) // n AS INTEGER) AS fold FROM ({RANKED})")
def stratified_folds(spark, sf):
    return L.stratified_folds(cases(spark, sf).select("event_id", "target"), "target", "event_id", k=5)


@query("split_sizes", f"SELECT target, rn <= floor(n * 0.2 + 0.5) AS is_test, CAST(count(*) AS BIGINT) AS n FROM ({RANKED}) r GROUP BY 1, 2")
def split_sizes(spark, sf):
    df = cases(spark, sf).select("event_id", "target")
    return L.split_sizes(L.stratified_split(df, "target", "event_id"), "target", "is_test")


@query("class_distribution", "SELECT toxic, CAST(count(*) AS BIGINT) AS n FROM labels GROUP BY toxic ORDER BY toxic")
def class_distribution_query(spark, sf):
    return class_distribution(table(spark, sf, "labels"), "toxic")


VECTORS = "SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, CASE WHEN label < 2 THEN 1 ELSE 0 END AS y FROM embeddings"
NEIGHBOURS = """SELECT a.vec_id, a.y, b.vec_id AS neighbor, b.y AS other, list_distance(a.v, b.v) AS distance,
  row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.v, b.v), b.vec_id) AS rank
  FROM vectors a JOIN vectors b ON a.vec_id <> b.vec_id"""
SELF = dict(query_id="vec_id", base_id="vec_id", query_vec="v", base_vec="v", exclude_self=True)


def _vectors(spark, sf):
    return table(spark, sf, "embeddings").select(
        "vec_id", F.col("embedding").alias("v"), (F.col("label") < 2).cast("int").alias("y")
    )


@query(
    "knn_join",
    f"WITH vectors AS ({VECTORS}), d AS ({NEIGHBOURS}) SELECT vec_id, CAST(rank AS INTEGER) AS rank, neighbor,"
    " round(distance, 6) AS distance FROM d WHERE rank <= 5",
)
def knn_join_query(spark, sf):
    v = _vectors(spark, sf)
    return rounded(knn_join(v, v, 5, **SELF), "distance")


@query(
    "knn_join_cells",
    f"WITH vectors AS ({VECTORS}), d AS ({NEIGHBOURS}) SELECT vec_id, CAST(rank AS INTEGER) AS rank, neighbor,"
    " round(distance, 6) AS distance FROM d WHERE rank <= 3",
)
def knn_join_cells(spark, sf):
    """The same join with blocks of a few rows, so that many cells meet and are merged."""
    v = _vectors(spark, sf)
    return rounded(knn_join(v, v, 3, **SELF, block_bytes=256 * 64 * 8), "distance")


@query(
    "knn_graph_by_descent",
    f"WITH vectors AS ({VECTORS}), nodes AS (SELECT count(DISTINCT v) AS n FROM vectors) SELECT n AS nodes, 10 * n AS links, TRUE AS recall_ok FROM nodes",
)
def knn_graph_by_descent(spark, sf):
    """The approximate graph of all embeddings; its recall is measured against the exact join over the same nodes."""
    v = _vectors(spark, sf)
    graph = stage_table(neighbor_graph(v, 10, "vec_id", "v"), "graph")
    nodes = nodes_of(v, "vec_id", "v").select(F.col("id").alias("vec_id"), "v")
    exact = knn_join(nodes, nodes, 10, **SELF).select(F.col("vec_id").alias("id"), "neighbor", F.lit(1).alias("hit"))
    found = graph.join(exact, ["id", "neighbor"], "left").agg(
        F.count_distinct("id").alias("nodes"), F.count(F.lit(1)).alias("links"), F.count("hit").alias("hits")
    )
    return found.select("nodes", "links", (F.col("hits") >= 0.9 * F.col("links")).alias("recall_ok"))


@query(
    "knn_vote_uniform",
    f"WITH vectors AS ({VECTORS}), d AS ({NEIGHBOURS}) SELECT vec_id, round(avg(CAST(other AS DOUBLE)), 6) AS probability"
    " FROM d WHERE rank <= 5 GROUP BY vec_id",
)
def knn_vote_uniform(spark, sf):
    v = _vectors(spark, sf)
    return rounded(knn_vote(v, v, "y", 5, **SELF), "probability")


@query(
    "knn_vote_distance",
    f"""WITH vectors AS ({VECTORS}), d AS ({NEIGHBOURS}) SELECT vec_id,
      round(coalesce(avg(CASE WHEN distance = 0 THEN CAST(other AS DOUBLE) END),
        sum(CASE WHEN distance > 0 THEN other / distance END) / sum(CASE WHEN distance > 0 THEN 1 / distance END)), 6) AS probability
      FROM d WHERE rank <= 7 GROUP BY vec_id""",
)
def knn_vote_distance(spark, sf):
    v = _vectors(spark, sf)
    return rounded(knn_vote(v, v, "y", 7, weights="distance", **SELF), "probability")


def _draw(tag: str) -> str:
    return f"CAST('0x' || substr(md5('{tag}:' || CAST(vec_id AS VARCHAR) || ':' || CAST(copy AS VARCHAR)), 1, 8) AS BIGINT)"


SMOTE_SQL = f"""
WITH vectors AS ({VECTORS}),
sizes AS (SELECT y, count(*) AS n, max(count(*)) OVER () - count(*) AS deficit FROM vectors GROUP BY y),
pairs AS (SELECT a.vec_id, b.vec_id AS neighbor, row_number() OVER (PARTITION BY a.vec_id
    ORDER BY list_distance(a.v, b.v), b.vec_id) AS rank
  FROM vectors a JOIN vectors b ON a.y = b.y AND a.vec_id <> b.vec_id JOIN sizes s ON s.y = a.y AND s.deficit > 0),
plan AS (SELECT vec_id, v, y, unnest(generate_series(1, CAST(copies AS BIGINT))) AS copy FROM (
  SELECT t.vec_id, t.v, t.y, s.deficit // s.n + CASE WHEN row_number() OVER (PARTITION BY t.y
    ORDER BY md5('42:' || CAST(t.vec_id AS VARCHAR))) <= s.deficit % s.n THEN 1 ELSE 0 END AS copies
  FROM vectors t JOIN sizes s ON s.y = t.y WHERE s.deficit > 0) WHERE copies > 0),
drawn AS (SELECT vec_id, v, y, copy, {_draw('42:pick')} % 5 + 1 AS pick, {_draw('42:u')} / 4294967296.0 AS u FROM plan),
grown AS (SELECT d.vec_id, d.copy, d.y, list_transform(generate_series(1, 64), lambda i: d.v[i] + d.u * (b.v[i] - d.v[i])) AS v
  FROM drawn d JOIN pairs p ON p.vec_id = d.vec_id AND p.rank = d.pick JOIN vectors b ON b.vec_id = p.neighbor)
SELECT vec_id, CAST(copy AS INTEGER) AS copy, y, round(v[1], 6) + 0.0 AS v1, round(v[64], 6) + 0.0 AS v64,
       round(list_sum(v), 6) + 0.0 AS total
FROM (SELECT vec_id, 0 AS copy, y, v FROM vectors UNION ALL SELECT vec_id, copy, y, v FROM grown)
"""


@query("smote", SMOTE_SQL)
def smote_query(spark, sf):
    out = smote(_vectors(spark, sf), "y", "vec_id", "v")
    total = F.aggregate("v", F.lit(0.0), lambda a, b: a + b)
    named = out.select(
        "vec_id", "copy", "y", F.col("v")[0].alias("v1"), F.col("v")[63].alias("v64"), total.alias("total")
    )
    return rounded(named, "v1", "v64", "total")


@query(
    "smote_distribution",
    f"WITH vectors AS ({VECTORS}) SELECT y, CAST((SELECT max(c) FROM (SELECT count(*) AS c FROM vectors GROUP BY y)) AS BIGINT) AS n"
    " FROM vectors GROUP BY y",
)
def smote_distribution(spark, sf):
    return class_distribution(smote(_vectors(spark, sf), "y", "vec_id", "v"), "y")
