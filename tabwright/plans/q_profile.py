"""Catalog: profiling, descriptive statistics and association tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabwright.functions import columns as C
from tabwright.operators import assoc, groups, joins, profile
from tabwright.plans.common import R4, RND, r4, rnd
from tabwright.plans.contracts import CUTOFF_YEAR, contracts, labelled_contracts, with_contracts
from tabwright.plans.q_prep import HOUSE_AGE_SQL, house_age
from tabwright.plans.registry import query

PERIOD_SQL = f"CASE WHEN coalesce(start_year < {CUTOFF_YEAR}, false) THEN 'before' ELSE 'after' END"


def period(col="start_year"):
    """Before / after the cut-off; a missing year counts as after (complement semantics)."""
    return F.when(C.is_true(F.col(col) < CUTOFF_YEAR), F.lit("before")).otherwise(F.lit("after"))


# ------------------------------------------------------------------ flagship: A8

@query("class_balance", with_contracts(f"""
SELECT period, label, CAST(count(*) AS BIGINT) AS n,
       {R4('count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY period)')} AS pct
FROM (SELECT {PERIOD_SQL} AS period, label FROM lc) WHERE label IS NOT NULL
GROUP BY period, label"""))
def q_class_balance(spark, d):
    """Short vs long contracts before and after the cut-off: scan, left joins with nulls,
    null-safe complement, shares."""
    df = labelled_contracts(spark, d).withColumn("period", period())
    return profile.class_balance(df, "label", by=["period"]).withColumn("pct", r4("pct"))


# ------------------------------------------------------------------ A1-A4

DESCRIBE_COLS = ("value", "area", "duration_days", "acctbal")


def _describe_sql(c):
    return (f"SELECT '{c}' AS column_name, CAST(count({c}) AS BIGINT) AS count, {R4(f'avg({c})')} AS mean, "
            f"{R4(f'stddev_samp({c})')} AS std, {R4(f'min({c})')} AS min, {R4(f'quantile_cont({c}, 0.25)')} AS p25, "
            f"{R4(f'quantile_cont({c}, 0.5)')} AS p50, {R4(f'quantile_cont({c}, 0.75)')} AS p75, {R4(f'max({c})')} AS max "
            f"FROM contracts")


@query("describe_numeric", with_contracts(" UNION ALL ".join(_describe_sql(c) for c in DESCRIBE_COLS)))
def q_describe(spark, d):
    out = profile.describe(contracts(spark, d), DESCRIBE_COLS)
    return out.select("column_name", "count", *[r4(c).alias(c) for c in ("mean", "std", "min", "p25", "p50", "p75", "max")])


SHAPE_COLS = ("value", "area", "duration_days")


@query("shape_stats", with_contracts(" UNION ALL ".join(
    f"SELECT '{c}' AS column_name, CAST(count({c}) AS BIGINT) AS n, {R4(f'skewness({c})')} AS skew, "
    f"{R4(f'kurtosis({c})')} AS kurt FROM contracts" for c in SHAPE_COLS)))
def q_shape(spark, d):
    out = profile.shape_stats(contracts(spark, d), SHAPE_COLS)
    return out.select("column_name", "n", r4("skew").alias("skew"), r4("kurt").alias("kurt"))


@query("zscore", with_contracts(f"""
SELECT contract_id, {R4('(value - avg(value) OVER ()) / stddev_samp(value) OVER ()')} AS value_z,
       {R4('(area - avg(area) OVER ()) / stddev_samp(area) OVER ()')} AS area_z
FROM contracts"""))
def q_zscore(spark, d):
    out = profile.zscore(contracts(spark, d), ["value", "area"])
    return out.select("contract_id", r4("value_z").alias("value_z"), r4("area_z").alias("area_z"))


# ------------------------------------------------------------------ A5-A7, A9-A10

MISSING_COLS = ("end_ts", "duration_days", "area", "room1", "room2", "room3", "discount", "prop_type")


@query("missing_profile", with_contracts(" UNION ALL ".join(
    f"SELECT grp, '{c}' AS column_name, CAST(count(*) FILTER (WHERE {c} IS NULL) AS BIGINT) AS n_missing, "
    f"{R4(f'count(*) FILTER (WHERE {c} IS NULL) * 100.0 / count(*)')} AS missing_pct FROM m GROUP BY grp"
    for c in MISSING_COLS), """m AS (
  SELECT CASE WHEN label IS NULL THEN 'unlabelled' ELSE 'labelled' END AS grp, end_ts, duration_days, area,
         room1, room2, room3, CASE WHEN discount = 0 THEN NULL ELSE discount END AS discount,
         CASE WHEN prop_type = 'BUILDING' THEN NULL ELSE prop_type END AS prop_type
  FROM lc)"""))
def q_missing_profile(spark, d):
    df = labelled_contracts(spark, d)
    df = C.null_out_columns(df, {"discount": [0.0], "prop_type": ["BUILDING"]})
    df = df.withColumn("grp", F.when(F.col("label").isNull(), F.lit("unlabelled")).otherwise(F.lit("labelled")))
    out = profile.missing_profile(df, MISSING_COLS, by="grp")
    return out.select("grp", "column_name", "n_missing", r4("missing_pct").alias("missing_pct"))


PRED_SQL = {
    "after_cutoff": f"start_year >= {CUTOFF_YEAR}",
    "labelled_after": f"label IS NOT NULL AND start_year >= {CUTOFF_YEAR}",
    "unlabelled_after": f"label IS NULL AND start_year >= {CUTOFF_YEAR}",
    "short_before": f"label = '<=3' AND start_year < {CUTOFF_YEAR}",
}


@query("predicate_shares", with_contracts(" UNION ALL ".join(
    f"SELECT '{k}' AS predicate, {R4(f'avg(CASE WHEN coalesce({v}, false) THEN 100.0 ELSE 0.0 END)')} AS pct FROM lc"
    for k, v in PRED_SQL.items())))
def q_predicate_shares(spark, d):
    df = labelled_contracts(spark, d)
    y, lab = F.col("start_year"), F.col("label")
    preds = {"after_cutoff": y >= CUTOFF_YEAR, "labelled_after": lab.isNotNull() & (y >= CUTOFF_YEAR),
             "unlabelled_after": lab.isNull() & (y >= CUTOFF_YEAR), "short_before": (lab == "<=3") & (y < CUTOFF_YEAR)}
    return profile.predicate_shares(df, preds).withColumn("pct", r4("pct"))


@query("bucket_counts", with_contracts("""
SELECT bucket_label, CAST(count(*) AS BIGINT) AS n FROM (
  SELECT CASE WHEN age >= 18 AND age < 100 THEN CAST(18 + 2 * CAST(floor((age - 18) / 2) AS INTEGER) AS VARCHAR) || '-' ||
                                             CAST(19 + 2 * CAST(floor((age - 18) / 2) AS INTEGER) AS VARCHAR) END AS bucket_label
  FROM (SELECT start_year - birth_year AS age FROM lc))
WHERE bucket_label IS NOT NULL GROUP BY bucket_label"""))
def q_bucket_counts(spark, d):
    df = labelled_contracts(spark, d)
    _, lab = C.bucketize(F.col("start_year") - F.col("birth_year"), 18, 100, 2)
    return profile.value_counts(df.select(lab.alias("bucket_label")), "bucket_label")


IQR_COLS = ("value", "area")


@query("iqr_outliers", with_contracts(" UNION ALL ".join(
    f"""SELECT '{c}' AS column_name, {R4('q1')} AS q1, {R4('q3')} AS q3, {R4('q1 - 1.5 * (q3 - q1)')} AS lower,
       {R4('q3 + 1.5 * (q3 - q1)')} AS upper,
       CAST((SELECT count(*) FROM contracts WHERE {c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) AS BIGINT) AS n_outliers
    FROM (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM contracts)""" for c in IQR_COLS)))
def q_iqr(spark, d):
    out = profile.iqr_outliers(contracts(spark, d), IQR_COLS)
    return out.select("column_name", *[r4(c).alias(c) for c in ("q1", "q3", "lower", "upper")], "n_outliers")


# ------------------------------------------------------------------ A21-A23

HIST_BINS = 20


@query("histogram", with_contracts(f"""
SELECT b.bin, {R4('mm.lo + b.bin * mm.w')} AS bin_lo, {R4('mm.lo + (b.bin + 1) * mm.w')} AS bin_hi,
       CAST(coalesce(c.n, 0) AS BIGINT) AS n, {R4('coalesce(c.n, 0) / (mm.total * mm.w)')} AS density
FROM (SELECT CAST(range AS INTEGER) AS bin FROM range({HIST_BINS})) b
CROSS JOIN mm
LEFT JOIN (SELECT LEAST(CAST(floor((value - mm.lo) / mm.w) AS INTEGER), {HIST_BINS - 1}) AS bin, count(*) AS n
           FROM contracts, mm WHERE value IS NOT NULL GROUP BY 1) c ON b.bin = c.bin""",
    f"mm AS (SELECT min(value) AS lo, (max(value) - min(value)) / {HIST_BINS} AS w, count(value) AS total FROM contracts)"))
def q_histogram(spark, d):
    out = profile.histogram(contracts(spark, d), "value", bins=HIST_BINS, density=True)
    return out.select("bin", r4("bin_lo").alias("bin_lo"), r4("bin_hi").alias("bin_hi"), "n", r4("density").alias("density"))


BOX_Q_SQL = """q AS (SELECT region, quantile_cont(area, 0.25) AS q1, quantile_cont(area, 0.5) AS median,
                  quantile_cont(area, 0.75) AS q3 FROM contracts WHERE area IS NOT NULL GROUP BY region)"""
BOX_IN = "c.area BETWEEN q.q1 - 1.5 * (q.q3 - q.q1) AND q.q3 + 1.5 * (q.q3 - q.q1)"


@query("box_stats_by", with_contracts(f"""
SELECT c.region, CAST(count(*) AS BIGINT) AS n, {R4('first(q.q1)')} AS q1, {R4('first(q.median)')} AS median,
       {R4('first(q.q3)')} AS q3, {R4(f'min(CASE WHEN {BOX_IN} THEN c.area END)')} AS whisker_lo,
       {R4(f'max(CASE WHEN {BOX_IN} THEN c.area END)')} AS whisker_hi,
       CAST(count(*) FILTER (WHERE NOT ({BOX_IN})) AS BIGINT) AS n_outliers
FROM contracts c JOIN q ON c.region = q.region WHERE c.area IS NOT NULL GROUP BY c.region""", BOX_Q_SQL))
def q_box(spark, d):
    out = profile.box_stats(contracts(spark, d), "area", by=["region"])
    return out.select("region", "n", *[r4(c).alias(c) for c in ("q1", "median", "q3", "whisker_lo", "whisker_hi")],
                      "n_outliers")


KDE_POINTS = 50


@query("kde_grid", with_contracts(f"""
SELECT g.grid_idx, {RND('g.x', 6)} AS x,
       {RND('sum(exp(-0.5 * pow((g.x - t.y) / s.h, 2))) / (s.n * s.h * sqrt(2 * pi()))', 6)} AS density
FROM (SELECT CAST(range AS INTEGER) AS grid_idx, s.lo + range * ((s.hi - s.lo) / {KDE_POINTS - 1}) AS x
      FROM range({KDE_POINTS}), s) g, s,
     (SELECT duration_days / 365.0 AS y FROM contracts WHERE duration_days IS NOT NULL) t
GROUP BY g.grid_idx, g.x, s.n, s.h""",
    """s AS (SELECT min(duration_days / 365.0) AS lo, max(duration_days / 365.0) AS hi, count(duration_days) AS n,
              stddev_samp(duration_days / 365.0) * pow(count(duration_days), -0.2) AS h FROM contracts)"""))
def q_kde(spark, d):
    df = contracts(spark, d).select((F.col("duration_days") / 365.0).alias("y"))
    out = profile.kde(df, "y", grid_points=KDE_POINTS)
    return out.select("grid_idx", rnd("x", 6).alias("x"), rnd("density", 6).alias("density"))


# ------------------------------------------------------------------ A16-A20, U3

CORR_COLS = ("value", "area", "room1", "discount", "acctbal", "n_lines", "build_year", "house_age", "const_one")


def corr_frame(spark, d):
    df = labelled_contracts(spark, d).where(F.col("label").isNotNull())
    return df.withColumns({"house_age": house_age(df), "const_one": F.lit(1.0)})


CORR_SRC_SQL = f"cf AS (SELECT *, {HOUSE_AGE_SQL} AS house_age, 1.0 AS const_one FROM lc WHERE label IS NOT NULL)"


def _corr_sql(c):
    both = f"{c} IS NOT NULL AND target IS NOT NULL"
    return (f"SELECT '{c}' AS column_name, CASE WHEN var_pop({c}) FILTER (WHERE {both}) > 0 "
            f"THEN {R4(f'corr({c}, target)')} END AS corr FROM cf")


CORR_SQL = " UNION ALL ".join(_corr_sql(c) for c in CORR_COLS)


@query("corr_with_label", with_contracts(CORR_SQL, CORR_SRC_SQL))
def q_corr(spark, d):
    return assoc.corr_with_label(corr_frame(spark, d), "target", CORR_COLS).withColumn("corr", r4("corr"))


@query("low_corr_columns", with_contracts(
    f"SELECT column_name FROM ({CORR_SQL}) WHERE coalesce(abs(corr) < 0.1, true)", CORR_SRC_SQL))
def q_low_corr(spark, d):
    corr = assoc.corr_with_label(corr_frame(spark, d), "target", CORR_COLS)
    return assoc.low_corr_columns(corr, 0.1)


MISS_ANY_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE {c} IS NULL) AS k FROM cf" for c in CORR_COLS)


@query("feature_overlap", with_contracts("""
SELECT column_name, 'both' AS part FROM (SELECT * FROM a INTERSECT SELECT * FROM b)
UNION ALL SELECT column_name, 'only_a' FROM (SELECT * FROM a EXCEPT SELECT * FROM b)
UNION ALL SELECT column_name, 'only_b' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""",
    f"""{CORR_SRC_SQL},
a AS (SELECT column_name FROM ({CORR_SQL}) WHERE coalesce(abs(corr) < 0.1, true)),
b AS (SELECT column_name FROM ({MISS_ANY_SQL}) WHERE k > 0)"""))
def q_overlap(spark, d):
    cf = corr_frame(spark, d)
    low = assoc.low_corr_columns(assoc.corr_with_label(cf, "target", CORR_COLS), 0.1)
    miss = profile.missing_profile(cf, CORR_COLS).where(F.col("n_missing") > 0).select("column_name")
    return joins.name_overlap(low, miss)


CHI_FEATURES = ("prop_type", "region", "priority", "status")


@query("contingency", with_contracts(" UNION ALL ".join(
    f"SELECT '{f}' AS feature, CAST({f} AS VARCHAR) AS level, label, CAST(count(*) AS BIGINT) AS n FROM lc "
    f"WHERE {f} IS NOT NULL AND label IS NOT NULL GROUP BY {f}, label" for f in CHI_FEATURES)))
def q_contingency(spark, d):
    return assoc.contingency(labelled_contracts(spark, d), CHI_FEATURES, "label")


CT_SQL = " UNION ALL ".join(
    f"SELECT '{f}' AS feature, CAST({f} AS VARCHAR) AS level, label, count(*) AS n FROM lc "
    f"WHERE {f} IS NOT NULL AND label IS NOT NULL GROUP BY {f}, label" for f in CHI_FEATURES)
CHI_CTES = f"""ct AS ({CT_SQL}),
lv AS (SELECT DISTINCT feature, level FROM ct), cl AS (SELECT DISTINCT feature, label FROM ct),
dense AS (SELECT lv.feature, lv.level, cl.label, coalesce(ct.n, 0) AS n
          FROM lv JOIN cl ON lv.feature = cl.feature
          LEFT JOIN ct ON ct.feature = lv.feature AND ct.level = lv.level AND ct.label = cl.label),
rs AS (SELECT feature, level, sum(n) AS row_n FROM dense GROUP BY ALL),
cs AS (SELECT feature, label, sum(n) AS col_n FROM dense GROUP BY ALL),
ts AS (SELECT feature, sum(n) AS total, count(DISTINCT level) AS nl, count(DISTINCT label) AS nc FROM dense GROUP BY ALL),
cells AS (SELECT d.feature, d.n, rs.row_n * cs.col_n / ts.total AS e, CAST((ts.nl - 1) * (ts.nc - 1) AS INTEGER) AS dof
          FROM dense d JOIN rs USING (feature, level) JOIN cs USING (feature, label) JOIN ts USING (feature))"""
YATES_TERM = "pow(CASE WHEN dof = 1 THEN abs(n - e) - least(0.5, abs(n - e)) ELSE abs(n - e) END, 2) / e"


@query("chi2_stat", with_contracts(f"""
SELECT feature, {R4(f'sum({YATES_TERM})')} AS statistic, first(dof) AS dof FROM cells GROUP BY feature""", CHI_CTES))
def q_chi2(spark, d):
    st = assoc.chi2_statistic(assoc.contingency(labelled_contracts(spark, d), CHI_FEATURES, "label"))
    return st.select("feature", r4("statistic").alias("statistic"), "dof")


# Upper 5 % points of the chi-squared distribution for 1 to 10 degrees of freedom
CHI2_CRITICAL = [3.841459, 5.991465, 7.814728, 9.487729, 11.070498, 12.591587, 14.067140, 15.507313, 16.918978, 18.307038]


@query("chi2_expected", with_contracts(f"""
SELECT feature, level, label, CAST(n AS BIGINT) AS n, {R4('e')} AS expected FROM cells2""", CHI_CTES + """,
cells2 AS (SELECT d.feature, d.level, d.label, d.n, rs.row_n * cs.col_n / ts.total AS e
           FROM dense d JOIN rs USING (feature, level) JOIN cs USING (feature, label) JOIN ts USING (feature))"""))
def q_chi2_expected(spark, d):
    cells = assoc.chi2_cells(assoc.contingency(labelled_contracts(spark, d), CHI_FEATURES, "label"))
    return cells.select("feature", "level", "label", "n", r4("expected").alias("expected"))


@query("chi2_verdict", with_contracts(f"""
SELECT feature, dof, CASE WHEN statistic > list_extract({CHI2_CRITICAL}, dof) THEN 'reject' ELSE 'keep' END AS verdict
FROM (SELECT feature, sum({YATES_TERM}) AS statistic, first(dof) AS dof FROM cells GROUP BY feature)""", CHI_CTES))
def q_chi2_verdict(spark, d):
    return assoc.chi2_test(labelled_contracts(spark, d), CHI_FEATURES, "label").select("feature", "dof", "verdict")


# the lower tail as a power series in x/2 with a log-gamma function, another form than the operator's
@query("chi2_test", with_contracts(f"""
SELECT feature, {R4('statistic')} AS statistic, dof, n_levels, n_classes, {RND('p', 6)} AS p_value,
       CASE WHEN p < 0.05 THEN 'reject' ELSE 'keep' END AS verdict
FROM (SELECT *, CASE WHEN statistic <= 0 THEN 1.0 ELSE 1 - list_sum(list_transform(range(0, 2000), lambda i:
               exp(-statistic / 2 + (dof / 2.0 + i) * ln(statistic / 2) - lgamma(dof / 2.0 + i + 1)))) END AS p
      FROM (SELECT feature, sum({YATES_TERM}) AS statistic, first(dof) AS dof, any_value(nl) AS n_levels,
                   any_value(nc) AS n_classes FROM cells JOIN ts USING (feature) GROUP BY feature))""", CHI_CTES))
def q_chi2_test(spark, d):
    """Statistic, p-value and verdict."""
    out = assoc.chi2_test(labelled_contracts(spark, d), CHI_FEATURES, "label")
    return out.withColumns({"statistic": r4("statistic"), "p_value": rnd("p_value", 6)})


# ------------------------------------------------------------------ A11-A15: group statistics on rows

def _labelled_with_age(spark, d):
    df = labelled_contracts(spark, d).where(F.col("label").isNotNull())
    return df.withColumn("house_age", house_age(df))


LABELLED_AGE_SQL = f"la AS (SELECT *, {HOUSE_AGE_SQL} AS house_age FROM lc WHERE label IS NOT NULL)"


@query("group_mean_property", with_contracts(f"""
SELECT contract_id, {R4('avg(duration_days) OVER (PARTITION BY property_id)')} AS avg_dur_property FROM la""",
    LABELLED_AGE_SQL))
def q_group_mean_property(spark, d):
    out = groups.group_mean(_labelled_with_age(spark, d), "property_id", "duration_days", "avg_dur_property")
    return out.select("contract_id", r4("avg_dur_property").alias("avg_dur_property"))


@query("group_mean_region", with_contracts(f"""
SELECT contract_id, {R4('avg(duration_days) OVER (PARTITION BY region)')} AS avg_dur_region FROM la""",
    LABELLED_AGE_SQL))
def q_group_mean_region(spark, d):
    out = groups.group_mean(_labelled_with_age(spark, d), "region", "duration_days", "avg_dur_region")
    return out.select("contract_id", r4("avg_dur_region").alias("avg_dur_region"))


HIST_SQL = f"""{LABELLED_AGE_SQL},
h AS (SELECT property_id, count(DISTINCT contract_id) AS n_tenants,
             count(DISTINCT CASE WHEN label = '<=3' THEN contract_id END) AS n_short,
             count(DISTINCT CASE WHEN label = '>3' THEN contract_id END) AS n_long
      FROM la GROUP BY property_id),
hist AS (SELECT la.contract_id, la.house_age, h.* EXCLUDE (property_id) FROM la JOIN h USING (property_id))"""


@query("group_nunique", with_contracts("SELECT contract_id, CAST(n_tenants AS BIGINT) AS n_tenants FROM hist", HIST_SQL))
def q_group_nunique(spark, d):
    out = groups.group_nunique(_labelled_with_age(spark, d), "property_id", "contract_id", "n_tenants")
    return out.select("contract_id", "n_tenants")


@query("group_nunique_if", with_contracts(
    "SELECT contract_id, CAST(n_short AS BIGINT) AS n_short, CAST(n_long AS BIGINT) AS n_long FROM hist", HIST_SQL))
def q_group_nunique_if(spark, d):
    out = groups.group_nunique_if(_labelled_with_age(spark, d), "property_id", "contract_id",
                                  {"n_short": F.col("label") == "<=3", "n_long": F.col("label") == ">3"})
    return out.select("contract_id", "n_short", "n_long")


@query("history_ratios", with_contracts(f"""
SELECT contract_id,
       {R4('coalesce(n_short * 1.0 / nullif(n_tenants, 0), 0.0)')} AS share_short,
       {R4('coalesce(n_long * 1.0 / nullif(n_tenants, 0), 0.0)')} AS share_long,
       {R4('n_short / (n_long + 1e-9)')} AS ratio_short_long,
       {R4('n_long / (n_short + 1e-9)')} AS ratio_long_short
FROM hist""", HIST_SQL))
def q_history_ratios(spark, d):
    out = groups.tenancy_history(_labelled_with_age(spark, d), "property_id", "contract_id", "label", "house_age")
    return out.select("contract_id", *[r4(c).alias(c) for c in
                                       ("share_short", "share_long", "ratio_short_long", "ratio_long_short")])


@query("turnover_rate", with_contracts(f"""
SELECT contract_id, {R4('coalesce(n_tenants * 1.0 / nullif(house_age, 0), 0.0)')} AS turnover FROM hist""", HIST_SQL))
def q_turnover(spark, d):
    out = groups.tenancy_history(_labelled_with_age(spark, d), "property_id", "contract_id", "label", "house_age")
    return out.select("contract_id", r4("turnover").alias("turnover"))
