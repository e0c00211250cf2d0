"""Registered queries: cleaning estimator C1-C12 over ``account_profile``."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.operators.anomaly import fit_impute_medians
from riskloom.operators.clean import Cleaner, category_counts, modes, vocabulary
from riskloom.plans.registry import register
from riskloom.plans.sqlgen import PROFILE_CLASS, PROFILE_COLS, corr_expr, filled, union_all
from riskloom.sources import fixtures as fx

SRC = "account_profile"
# The cleaner sees ids, categoricals, numerics, the open-date text and the label.
CLEAN_COLS = [c for c in PROFILE_COLS if c not in ("first_order", "last_order")]
FEATS = [c for c in CLEAN_COLS if c not in ("account_id",)]
NUM = [c for c in FEATS if PROFILE_CLASS[c] == "numeric" and c != "label"]
STR = [c for c in FEATS if PROFILE_CLASS[c] != "numeric"]


def _input(spark, sf_dir):
    return fx.account_profile(spark, sf_dir).select(*CLEAN_COLS)


def _fit(spark, sf_dir):
    return Cleaner("account_id", "label").fit(_input(spark, sf_dir))


def _in(name: str, sub: str) -> str:
    return f"'{name}' IN (SELECT c FROM {sub})"


def _decision_ctes() -> dict[str, str]:
    feats_nl = [c for c in FEATS if c != "label"]
    pairs = [(i, j) for j in range(len(feats_nl)) for i in range(j)
             if (PROFILE_CLASS[feats_nl[i]] == "numeric") == (PROFILE_CLASS[feats_nl[j]] == "numeric")]
    num_pairs = [(i, j) for i in range(len(NUM)) for j in range(i + 1, len(NUM))]
    ctes = {}
    ctes["rates"] = union_all([f"SELECT '{c}' AS c, (count(*) - count({c})) * 1.0 / count(*) AS rate FROM {SRC}"
                               for c in FEATS])
    ctes["drop1"] = "SELECT c FROM rates WHERE rate > 0.95 AND c <> 'label'"
    ctes["const0"] = union_all([f"SELECT '{c}' AS c FROM {SRC} HAVING min({c}) IS NOT DISTINCT FROM max({c})"
                                for c in feats_nl])
    ctes["drop2"] = "SELECT c FROM const0 WHERE c NOT IN (SELECT c FROM drop1)"
    ctes["eqs"] = "SELECT " + ", ".join(
        f"bool_and({filled(feats_nl[i])} = {filled(feats_nl[j])}) AS e{i}_{j}" for i, j in pairs) + f" FROM {SRC}"
    ctes["pairs_eq"] = union_all([f"SELECT '{feats_nl[i]}' AS a, '{feats_nl[j]}' AS b, e{i}_{j} AS eq FROM eqs"
                                  for i, j in pairs])
    ctes["gone12"] = "SELECT c FROM drop1 UNION SELECT c FROM drop2"
    ctes["dup"] = ("SELECT DISTINCT b AS c FROM pairs_eq WHERE eq AND a NOT IN (SELECT c FROM gone12) "
                   "AND b NOT IN (SELECT c FROM gone12)")
    ctes["gone123"] = "SELECT c FROM gone12 UNION SELECT c FROM dup"
    ctes["firsts"] = union_all([
        f"SELECT '{c}' AS c, (SELECT CAST({c} AS VARCHAR) FROM {SRC} WHERE {c} IS NOT NULL "
        f"ORDER BY account_id LIMIT 1) AS v" for c in STR])
    ctes["roles"] = ("SELECT c, CASE WHEN len(string_split(v, '-')) = 3 AND "
                     "regexp_full_match(replace(v, '-', ''), '[0-9]+') THEN 'date' ELSE 'categorical' END AS role "
                     "FROM firsts WHERE c NOT IN (SELECT c FROM gone123)")
    ctes["medians"] = "SELECT " + ", ".join(f"median({c}) AS med_{c}" for c in NUM) + f" FROM {SRC}"
    ctes["num"] = union_all([f"SELECT '{c}' AS c, {i} AS i FROM (SELECT 1) x WHERE '{c}' NOT IN (SELECT c FROM gone123)"
                             for i, c in enumerate(NUM)])
    ctes["imputed"] = ("SELECT " + ", ".join(f"coalesce(CAST(p.{c} AS DOUBLE), m.med_{c}, 0.0) AS {c}" for c in NUM)
                       + f", CAST(p.label AS DOUBLE) AS __y FROM {SRC} p, medians m")
    ctes["leak0"] = union_all([f"SELECT '{c}' AS c, abs({corr_expr(c, '__y')}) AS r FROM imputed" for c in NUM])
    ctes["leak"] = "SELECT c FROM leak0 WHERE r > 0.8 AND c IN (SELECT c FROM num)"
    ctes["corrs"] = union_all([f"SELECT '{NUM[i]}' AS a, '{NUM[j]}' AS b, abs({corr_expr(NUM[i], NUM[j])}) AS r "
                               f"FROM imputed" for i, j in num_pairs])
    ctes["num2"] = "SELECT c FROM num WHERE c NOT IN (SELECT c FROM leak)"
    ctes["multi"] = ("SELECT DISTINCT b AS c FROM corrs WHERE r > 0.95 AND a IN (SELECT c FROM num2) "
                     "AND b IN (SELECT c FROM num2)")
    ctes["decisions"] = """
SELECT c AS column_name, 'high_missing' AS decision FROM drop1
UNION ALL SELECT c, 'constant' FROM drop2
UNION ALL SELECT c, 'duplicate' FROM dup
UNION ALL SELECT c, 'leakage' FROM leak
UNION ALL SELECT c, 'multicollinear' FROM multi
UNION ALL SELECT c, 'indicator' FROM rates WHERE c NOT IN (SELECT c FROM drop1) AND rate > 0 AND rate <= 0.95
UNION ALL SELECT c, 'numeric' FROM num2 WHERE c NOT IN (SELECT c FROM multi)
UNION ALL SELECT c, role FROM roles"""
    return ctes


_DEC = _decision_ctes()


@register("clean_decisions", "SELECT column_name, decision FROM decisions", extra=_DEC)
def q_clean_decisions(spark, sf_dir):
    """Drop reasons (high_missing, constant, duplicate, leakage,
    multicollinear), missing indicators and column roles learned by the cleaner."""
    return Cleaner("account_id", "label").decisions(_fit(spark, sf_dir), spark)


@register("clean_medians", union_all([f"SELECT '{c}' AS column_name, coalesce(median({c}), 0.0) AS median FROM {SRC}"
                                      for c in NUM]), ("median",))
def q_clean_medians(spark, sf_dir):
    """Median of each numeric column (all-NULL -> 0.0)."""
    df = _input(spark, sf_dir)
    return spark.createDataFrame(list(fit_impute_medians(df, NUM).items()), "column_name string, median double")


def _vocab_sql(c: str, k: int = 10) -> str:
    return (f"SELECT value, cnt, row_number() OVER (ORDER BY cnt DESC, value) AS rank FROM "
            f"(SELECT CAST({c} AS VARCHAR) AS value, count(*) AS cnt FROM {SRC} WHERE {c} IS NOT NULL GROUP BY 1) g")


@register("clean_vocabulary", union_all([
    f"SELECT '{c}' AS column_name, value, cnt, CAST(rank AS INTEGER) AS rank FROM ({_vocab_sql(c)}) v WHERE rank <= 10"
    for c in STR]))
def q_clean_vocabulary(spark, sf_dir):
    """Top-10 values per string column (count desc, value asc)."""
    return vocabulary(category_counts(_input(spark, sf_dir), STR), 10)


@register("clean_modes", union_all([
    f"SELECT '{c}' AS column_name, value AS mode FROM ({_vocab_sql(c)}) v WHERE rank = 1" for c in STR]))
def q_clean_modes(spark, sf_dir):
    """Mode per string column, smallest value on ties."""
    return modes(category_counts(_input(spark, sf_dir), STR))


def _transform_sql() -> str:
    parts = []
    for c in FEATS:
        if c == "label":
            continue
        parts.append(f"SELECT account_id, '{c}_is_missing' AS feature, CAST({c} IS NULL AS DOUBLE) AS value "
                     f"FROM {SRC} WHERE '{c}' IN (SELECT column_name FROM decisions WHERE decision = 'indicator')")
    for c in NUM:
        parts.append(f"SELECT account_id, '{c}' AS feature, coalesce(CAST(p.{c} AS DOUBLE), m.med_{c}, 0.0) AS value "
                     f"FROM {SRC} p, medians m WHERE '{c}' IN (SELECT column_name FROM decisions WHERE decision = 'numeric')")
    for c in STR:
        d = f"try_strptime({c}, '%-m-%-d-%Y')"
        for part, e in (("year", f"year({d})"), ("month", f"month({d})"), ("day", f"day({d})"),
                        ("dayofweek", f"isodow({d}) - 1")):
            parts.append(f"SELECT account_id, '{c}_{part}' AS feature, CAST(coalesce({e}, -1) AS DOUBLE) AS value "
                         f"FROM {SRC} WHERE '{c}' IN (SELECT column_name FROM decisions WHERE decision = 'date')")
        voc = f"(SELECT value FROM ({_vocab_sql(c)}) v WHERE rank <= 10)"
        mode = f"(SELECT value FROM ({_vocab_sql(c)}) v WHERE rank = 1)"
        nd = f"(SELECT count(DISTINCT {c}) FROM {SRC})"
        dummies = (f"(SELECT v FROM (SELECT value AS v FROM {voc} x UNION SELECT 'Other' WHERE {nd} > 10 "
                   f"OR {nd} = 0) y ORDER BY v OFFSET 1)")
        mapped = (f"CASE WHEN coalesce(CAST({c} AS VARCHAR), {mode}, 'Unknown') IN {voc} "
                  f"THEN coalesce(CAST({c} AS VARCHAR), {mode}, 'Unknown') ELSE 'Other' END")
        parts.append(f"SELECT account_id, '{c}_' || d.v AS feature, CAST({mapped} = d.v AS DOUBLE) AS value "
                     f"FROM {SRC}, {dummies} d "
                     f"WHERE '{c}' IN (SELECT column_name FROM decisions WHERE decision = 'categorical')")
    return union_all(parts)


@register("clean_transform", _transform_sql(), ("value",), extra=_DEC)
def q_clean_transform(spark, sf_dir):
    """C2, C6, C7, C11, C12 applied: the cleaned table in long form
    (account_id, feature, value) — the schema is learned at fit time."""
    model = _fit(spark, sf_dir)
    out = model.transform(_input(spark, sf_dir))
    feats = model.output_columns()
    wide = out.select("account_id", *[F.col(c).cast("double").alias(c) for c in feats])
    return wide.unpivot(["account_id"], feats, "feature", "value")


@register("clean_date_parts", f"""
SELECT account_id,
  CAST(coalesce(year(d), -1) AS INTEGER) AS open_date_year, CAST(coalesce(month(d), -1) AS INTEGER) AS open_date_month,
  CAST(coalesce(day(d), -1) AS INTEGER) AS open_date_day, CAST(coalesce(isodow(d) - 1, -1) AS INTEGER) AS open_date_dayofweek
FROM (SELECT account_id, CAST(try_strptime(open_date, '%-m-%-d-%Y') AS DATE) AS d FROM {SRC}) t""")
def q_clean_date_parts(spark, sf_dir):
    """Year / month / day / weekday (Mon=0) of the M-D-YYYY open date; bad -> -1."""
    from riskloom.operators.clean import CleanerModel
    m = CleanerModel("account_id", "label", date_cols=["open_date"])
    return m.transform(_input(spark, sf_dir)).drop("label")
