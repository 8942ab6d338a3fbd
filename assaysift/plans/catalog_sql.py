"""Reference SQL for the catalog, in the dialect of DuckDB, over the same tables."""

from __future__ import annotations

from assaysift.operators.bins import quantile_edges
from assaysift.operators.splits import POISSON_CDF
from assaysift.sources import registry

M = registry.METHODS


def _case(value: str, pairs: dict) -> str:
    def quote(x):
        return f"'{x}'" if isinstance(x, str) else str(x)

    return "CASE " + value + "".join(f" WHEN {quote(k)} THEN {quote(v)}" for k, v in pairs.items()) + " END"


def _q(name: str) -> str:
    return f'"{name}"'


def _r(value: str, digits: int = 6) -> str:
    scale = float(10**digits)
    return f"(round_even(({value}) * {scale}, 0) / {scale})"


TARGET = _case("l_returnflag", {"A": "na_ph1n1", "N": "na_h3n2", "R": "na_h5n1"})
STRAIN = _case("target", {"na_ph1n1": "ph1n1", "na_h3n2": "h3n2", "na_h5n1": "h5n1"})

PRED = f"""pred AS (
  SELECT {_case("(l_linenumber - 1) % 6", dict(enumerate(M)))} AS method, CAST(l_partkey AS VARCHAR) AS id,
         {TARGET} AS target, max(floor(l_extendedprice / 500)) AS prediction, min(l_discount) AS spread
  FROM lineitem GROUP BY 1, 2, 3)"""
RANKED = f"""{PRED}, ranked AS (
  SELECT *, (rank() OVER (PARTITION BY method, target ORDER BY prediction)
             + (count(*) OVER (PARTITION BY method, target, prediction) - 1) / 2.0)
            / count(prediction) OVER (PARTITION BY method, target) AS pr
  FROM pred)"""
WIDE = f"""{RANKED}, wide AS (
  SELECT id, target, {", ".join(f"max(CASE WHEN method = '{m}' THEN prediction END) AS {_q(m + '_score')}" for m in M)},
         {", ".join(f"max(CASE WHEN method = '{m}' THEN pr END) AS {_q(m + '_rank')}" for m in M)}
  FROM ranked GROUP BY 1, 2 HAVING count(*) = 6)"""
_R = {m: _q(m + "_rank") for m in M}
_MEAN = "((" + " + ".join(_R.values()) + ") / 6.0)"
_BRANCH = {b: f"(({_R[x]} + {_R[y]}) / 2.0)" for b, (x, y) in registry.BRANCHES.items()}
_BMEAN = "((" + " + ".join(_BRANCH.values()) + ") / 3.0)"
_WEIGHTED = " + ".join(f"{_R[m]} * {w}" for m, w in registry.METHOD_WEIGHTS.items())
SUMMARY_COLUMNS = {
    **{f"{b}_rank_mean": e for b, e in _BRANCH.items()},
    "consensus_123_rank": f"(({_WEIGHTED}) / 12.0)",
    "method_rank_sd": "sqrt((" + " + ".join(f"({r} - {_MEAN}) * ({r} - {_MEAN})" for r in _R.values()) + ") / 5.0)",
    "method_rank_range": f"(greatest({', '.join(_R.values())}) - least({', '.join(_R.values())}))",
    "branch_rank_sd": "sqrt((" + " + ".join(f"({b} - {_BMEAN}) * ({b} - {_BMEAN})" for b in _BRANCH.values()) + ") / 2.0)",
    "structure_minus_pose_rank": f"({_BRANCH['structure']} - {_BRANCH['pose']})",
    "sequence_minus_structure_rank": f"({_BRANCH['sequence']} - {_BRANCH['structure']})",
}
SUMMARY = f"""{WIDE}, summary AS (
  SELECT *, {", ".join(f"{e} AS {n}" for n, e in SUMMARY_COLUMNS.items())} FROM wide)"""
ASSAY = f"""assay AS (
  SELECT CAST(o_custkey AS VARCHAR) AS id, {_case("o_orderstatus", {"F": "na_ph1n1", "O": "na_h3n2", "P": "na_h5n1"})} AS target,
         'round_' || CAST(o_orderkey % 3 AS VARCHAR) AS round_id, (CAST(floor(o_totalprice) AS BIGINT) % 50 + 1) / 8 AS label_pkd
  FROM orders)"""
LABELS = f"""{ASSAY}, labels_ AS (
  SELECT id, target, 'na' AS target_class, {STRAIN} AS strain, 'C' || id AS smiles, max(label_pkd) AS label_pkd
  FROM assay GROUP BY id, target)"""
LIBRARY = """library AS (
  SELECT lower(p_type) AS target_class, CAST(p_partkey AS VARCHAR) AS id, p_name AS smiles, p_brand || '/' || CAST(p_size AS VARCHAR) AS murcko_scaffold,
         CASE WHEN p_size % 5 = 0 THEN 'acyclic' ELSE 'murcko' END AS scaffold_type
  FROM part)"""
OOF = f"""{SUMMARY}, {LABELS}, oof0 AS (
  SELECT s.*, label_pkd, 1.0 + consensus_123_rank * 4.0 AS pred_mean, method_rank_range * 2.0 AS pred_err,
         'na' AS dataset_label, CAST(CAST(s.id AS BIGINT) % 5 AS INTEGER) AS outer_fold
  FROM summary s JOIN labels_ l ON s.id = l.id AND s.target = l.target),
oof AS (
  SELECT *, pred_mean - pred_err AS pred_lower, pred_mean + pred_err AS pred_upper, label_pkd - pred_mean AS residual,
         abs(label_pkd - pred_mean) AS abs_error,
         CASE WHEN label_pkd BETWEEN pred_mean - pred_err AND pred_mean + pred_err THEN 1.0 ELSE 0.0 END AS covered
  FROM oof0)"""
FINAL = f"""{SUMMARY}, {LABELS}, final AS (
  SELECT s.id, s.target, 1.0 + consensus_123_rank * 4.0 AS pred_mean,
         CASE WHEN l.id IS NULL THEN 0 ELSE 1 END AS in_experimental_data
  FROM summary s LEFT JOIN labels_ l ON s.id = l.id AND s.target = l.target)"""


def _fraction(column: str) -> str:
    return f"round_even(sum(CAST(round_even({column} * 100, 0) AS BIGINT)) / count(*) * 1024.0, 0) / 1024.0"


FOLDS = f"""folds AS (
  SELECT {_case("l_returnflag", {"A": "pa", "N": "na", "R": "fasn"})} AS dataset_label,
         CAST(l_suppkey % 5 AS INTEGER) AS outer_fold, 'method_scores_plus_' || lower(p_type) AS comparison_name,
         {_case("p_size % 3", {0: "ridge", 1: "xgboost", 2: "gaussian_process"})} AS model_type, length(p_type) AS p,
         'nested' AS tuning_mode, 'spearman' AS tuning_metric, CAST({_fraction("l_discount")} AS DOUBLE) AS tuning_score,
         count(*) AS n_test, CAST({_fraction("l_tax")} AS DOUBLE) AS rmse, CAST({_fraction("l_discount")} AS DOUBLE) AS spearman
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3, 4, 5)"""
FEATURE_LABEL = {
    "method_scores": "Scores",
    "method_ranks_plus_rank_summary": "Ranks + Rank summary",
    "method_scores_plus_custom_block": "Scores + Custom Block",
}
CLASS_LABEL = {"pa": "PA", "na": "NA", "furin": "Furin", "fasn": "FASN"}
TRACE = f"""trace AS (
  SELECT {_case("user_id % 3", {0: "pa", 1: "na", 2: "furin"})} AS dataset_label,
         CASE WHEN event_id % 7 <> 0 THEN CAST((event_id // 15) % 5 AS INTEGER) END AS outer_fold,
         {_case("event_id % 3", {0: "method_scores", 1: "method_ranks_plus_rank_summary", 2: "method_scores_plus_custom_block"})}
           AS comparison_name,
         CASE WHEN event_type IN ('view', 'click') THEN 'ridge' ELSE 'xgboost' END AS model_type,
         CAST(event_id % 3 + 6 AS INTEGER) AS p, CAST(event_id AS INTEGER) AS trial_number,
         round_even(value, 0) / 1024.0 AS tuning_score,
         CASE WHEN event_type IN ('view', 'click') THEN (event_id % 97 + 1) / 4.0 END AS alpha,
         CASE WHEN event_type NOT IN ('view', 'click') THEN (event_id % 29 + 1) / 128.0 END AS learning_rate,
         CASE WHEN event_type NOT IN ('view', 'click') THEN CAST(event_id % 7 + 2 AS DOUBLE) END AS max_depth,
         CASE WHEN event_type NOT IN ('view', 'click') THEN CAST(event_id % 11 * 50 + 100 AS DOUBLE) END AS n_estimators,
         CASE WHEN event_type NOT IN ('view', 'click') THEN (event_id % 33 + 32) / 64.0 END AS subsample
  FROM events)"""
SIGNATURE = """CASE WHEN model_type = 'ridge' THEN 'alpha=' || CAST(CAST(alpha AS DOUBLE) AS VARCHAR)
  ELSE 'learning_rate=' || CAST(CAST(learning_rate AS DOUBLE) AS VARCHAR) || ';max_depth=' || CAST(CAST(max_depth AS INTEGER) AS VARCHAR)
    || ';n_estimators=' || CAST(CAST(n_estimators AS INTEGER) AS VARCHAR) || ';subsample=' || CAST(CAST(subsample AS DOUBLE) AS VARCHAR) END"""


def _bin(position: str, total: str, bins: int) -> str:
    crossed = " + ".join(
        f"CASE WHEN 1.0::DOUBLE + ({total} - 1) * {t!r}::DOUBLE < {position} THEN 1 ELSE 0 END" for t in quantile_edges(bins)[:-1]
    )
    return f"greatest(1, {crossed})"


def _bins(position: str, total: str, allowed: str, bins: int = 10) -> str:
    cases = " ".join(f"WHEN {allowed} = {b} THEN {_bin(position, total, b)}" for b in range(2, bins + 1))
    return f"CAST(CASE {cases} ELSE 1 END AS INTEGER)"


def _avg_rank(value: str, partition: str) -> str:
    by = f"PARTITION BY {partition}" if partition else ""
    tie = f"PARTITION BY {partition}, {value}" if partition else f"PARTITION BY {value}"
    return f"(rank() OVER ({by} ORDER BY {value}) + (count(*) OVER ({tie}) - 1) / 2.0)"


def _corr(x: str, y: str) -> str:
    return (
        f"CASE WHEN count(*) >= 2 AND min({x}) < max({x}) AND min({y}) < max({y}) "
        f"THEN covar_pop({x}, {y}) / (stddev_pop({x}) * stddev_pop({y})) END"
    )


DIS_BINS = f"""{OOF}, binned AS (
  SELECT *, {_bins("rn", "n", "least(10, n, nd)")} AS disagreement_bin FROM (
    SELECT *, row_number() OVER (ORDER BY branch_rank_sd, id, target) AS rn, count(*) OVER () AS n,
           (SELECT count(DISTINCT branch_rank_sd) FROM oof) AS nd
    FROM oof))"""
LEVELS = f"""{OOF}, levels AS (
  SELECT 'dataset' AS summary_level, 'all' AS tgt, oof.* FROM oof
  UNION ALL SELECT 'target', target, oof.* FROM oof),
lr AS (SELECT *, {_avg_rank("label_pkd", "summary_level, tgt")} AS ry, {_avg_rank("pred_mean", "summary_level, tgt")} AS rp FROM levels)"""
TARGET_LABEL = _case("tgt", {"na_ph1n1": "NA pH1N1", "na_h3n2": "NA H3N2", "na_h5n1": "NA H5N1"})

GRADED = """graded AS (
  SELECT event_id, CAST(user_id % 5 AS INTEGER) AS fold, value / 100 + event_id % 3 AS label, value AS prediction FROM events)"""
_EF = {0.01: "ef_1pct", 0.05: "ef_5pct", 0.1: "ef_10pct"}


def _top_hits(k: str) -> str:
    return f"sum(CASE WHEN pos <= {k} THEN hit ELSE 0 END)"


FOLD_METRICS = f"""WITH {GRADED}, g AS (
  SELECT *, {_avg_rank("label", "fold")} AS ry, {_avg_rank("prediction", "fold")} AS rp,
         row_number() OVER (PARTITION BY fold ORDER BY prediction DESC, event_id) AS pos,
         count(*) OVER (PARTITION BY fold) AS n, CASE WHEN label >= 2.5 THEN 1 ELSE 0 END AS hit
  FROM graded)
SELECT fold, count(*) AS n_test, {_r("sqrt(avg((label - prediction) * (label - prediction)))")} AS rmse,
       {_r("avg(abs(label - prediction))")} AS mae,
       {_r("1 - sum((label - prediction) * (label - prediction)) / (var_pop(label) * count(*))")} AS r2,
       {_r(_corr("ry", "rp"))} AS spearman,
       {", ".join(_r(f"({_top_hits(f'greatest(1, ceil(n::DOUBLE * {f}::DOUBLE))')}::DOUBLE / max(greatest(1, ceil(n::DOUBLE * {f}::DOUBLE)))) / (sum(hit)::DOUBLE / count(*))") + f" AS {name}" for f, name in _EF.items())},
       {", ".join(_r(f"{_top_hits(str(k))}::DOUBLE / least({k}, count(*))") + f" AS precision_at_{k}" for k in (10, 25, 50))}
FROM g GROUP BY fold"""

CANDIDATE_CV = """cand AS (
  SELECT dataset_label, comparison_name, model_type, p, avg({m}) AS mean, coalesce(stddev_samp({m}), 0.0) AS std,
         count({m}) AS n_outer_folds, coalesce(stddev_samp({m}), 0.0) / sqrt(greatest(count({m}), 1)) AS sem,
         CASE model_type WHEN 'ridge' THEN 0 WHEN 'xgboost' THEN 1 ELSE 100 END AS model_complexity_rank
  FROM folds GROUP BY 1, 2, 3, 4)"""


def _select(metric: str, rule: str) -> str:
    down = metric == "spearman"
    by_mean = f"mean {'DESC' if down else 'ASC'}, p, model_complexity_rank, model_type, comparison_name"
    order = by_mean if rule == "best_mean" else (
        f"p, model_complexity_rank, mean {'DESC' if down else 'ASC'}, model_type, comparison_name"
    )
    threshold = "b.mean" if rule == "best_mean" else ("b.mean - b.sem" if down else "b.mean + b.sem")
    inside = "true" if rule == "best_mean" else ("c.mean >= t" if down else "c.mean <= t")
    return f"""WITH {FOLDS}, {CANDIDATE_CV.format(m=metric)},
b0 AS (SELECT *, row_number() OVER (PARTITION BY dataset_label ORDER BY {by_mean}) AS rn FROM cand),
b AS (SELECT *, {threshold} AS t FROM b0 b WHERE rn = 1),
j AS (SELECT c.*, b.mean AS bm, b.sem AS bs, b.comparison_name AS bc, b.model_type AS bt, b.p AS bp, t, {inside} AS ok
      FROM cand c JOIN b ON c.dataset_label = b.dataset_label),
k AS (SELECT *, row_number() OVER (PARTITION BY dataset_label, ok ORDER BY {order}) AS pick,
             sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER (PARTITION BY dataset_label) AS n_ok FROM j)
SELECT dataset_label, comparison_name, model_type, p, {_r("mean")} AS {metric}_mean, {_r("std")} AS {metric}_std,
       n_outer_folds, {_r("sem")} AS {metric}_sem, model_complexity_rank, '{metric}' AS selection_metric,
       '{rule}' AS selection_rule, {_r("bm")} AS best_metric_mean, {_r("bs")} AS best_metric_sem,
       {_r("t")} AS one_se_threshold, ok AS one_se_eligible, (ok AND pick = 1) AS official_selected,
       CAST(n_ok AS BIGINT) AS one_se_eligible_count, bc AS best_comparison_name, bt AS best_model_type, bp AS best_p
FROM k"""


def _winners(metric: str, direction: str) -> str:
    return f"""WITH {FOLDS}, w AS (
  SELECT *, row_number() OVER (PARTITION BY dataset_label, outer_fold
           ORDER BY {metric} {direction}, p, model_type, comparison_name) AS rn FROM folds)
SELECT * EXCLUDE (rn), model_type || ' | ' || comparison_name AS winner_label FROM w WHERE rn = 1"""


def _landscape_part(model: str, parameter: str, value: str, label: str, continuous: bool) -> str:
    base = f"SELECT *, {value} AS v FROM trace WHERE outer_fold IS NOT NULL AND model_type = '{model}'"
    if continuous:
        low, high = "lo + b * ((hi - lo) / 8.0)", "CASE WHEN b = 7 THEN hi ELSE (b + 1) * ((hi - lo) / 8.0) + lo END"
        inner = f"""SELECT *, {low} AS pl, {high} AS ph FROM (
          SELECT *, least(floor(8 * (v - lo) / (hi - lo)), 7) AS b FROM (
            SELECT *, min(v) OVER () AS lo, max(v) OVER () AS hi FROM ({base})))"""
        text = "{0} || ' to ' || {1}".format(_three("pl"), _three("ph"))
        middle = "(pl + ph) / 2.0"
    else:
        inner = f"SELECT *, v AS pl, v AS ph FROM ({base})"
        text, middle = _three("v"), "v"
    return f"""SELECT dataset_label, {_case("dataset_label", CLASS_LABEL)} AS target_class_label, model_type,
  '{parameter}' AS parameter, '{label}' AS parameter_label, comparison_name,
  {_case("comparison_name", FEATURE_LABEL)} AS feature_set_label, p, {text} AS parameter_bin,
  {_r(middle)} AS parameter_bin_sort, {_r("pl")} AS parameter_bin_lower, {_r("ph")} AS parameter_bin_upper,
  {_r("median(tuning_score)")} AS median_tuning_score, count(*) AS trial_count
FROM ({inner}) GROUP BY ALL"""


def _three(value: str) -> str:
    return (
        f"CASE WHEN abs({value} - round_even({value}, 0)) <= 1e-9 + 1e-5 * abs(round_even({value}, 0)) "
        f"THEN CAST(CAST(round_even({value}, 0) AS BIGINT) AS VARCHAR) ELSE printf('%.3g', CAST({value} AS DOUBLE)) END"
    )


LANDSCAPE = f"WITH {TRACE} " + " UNION ALL ".join(
    [
        _landscape_part("ridge", "log10_alpha", "log10(alpha)", "log10(alpha)", True),
        _landscape_part("xgboost", "log10_learning_rate", "log10(learning_rate)", "log10(learning rate)", True),
        _landscape_part("xgboost", "max_depth", "max_depth", "Max depth", False),
        _landscape_part("xgboost", "n_estimators", "n_estimators", "N estimators", False),
        _landscape_part("xgboost", "subsample", "subsample", "Subsample", True),
    ]
)

DECILES = f"""SELECT event_id, event_type AS target, value AS pred_mean, {_bins("a", "na", "least(10, na)")} AS pred_score_decile,
       {_bins("t", "nt", "least(10, nt)")} AS target_pred_score_decile
FROM (SELECT *, row_number() OVER (ORDER BY value, event_id) AS a, count(*) OVER () AS na,
             row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) AS t,
             count(*) OVER (PARTITION BY event_type) AS nt FROM events)"""

_Q = {"q25": 0.25, "median": 0.5, "q75": 0.75}
DIS_SUMMARY = f"""WITH {DIS_BINS}
SELECT dataset_label, 'NA' AS dataset_display, 'branch_rank_sd' AS disagreement_column, disagreement_bin, count(*) AS n,
       {_r("min(branch_rank_sd)")} AS disagreement_min, {_r("max(branch_rank_sd)")} AS disagreement_max,
       {", ".join(_r(f"quantile_cont({c}, {p})") + f" AS {s}_{n}" for s, c in (("disagreement", "branch_rank_sd"), ("residual", "residual"), ("abs_error", "abs_error")) for n, p in _Q.items())}
FROM binned GROUP BY 1, 4"""
PREDICTION_SUMMARY = f"""WITH {LEVELS}
SELECT summary_level, dataset_label, 'NA' AS dataset_display, tgt AS target,
       CASE WHEN summary_level = 'dataset' THEN 'All targets' ELSE {TARGET_LABEL} END AS target_display, count(*) AS n,
       {_r(_corr("ry", "rp"))} AS spearman, {_r(_corr("label_pkd", "pred_mean"))} AS pearson,
       {_r("sqrt(avg(residual * residual))")} AS rmse, {_r("avg(abs_error)")} AS mae, {_r("avg(residual)")} AS mean_residual,
       {_r("median(abs_error)")} AS median_abs_error, {_r("avg(covered)")} AS coverage
FROM lr GROUP BY summary_level, dataset_label, tgt"""

PERCENTILE = f"""SELECT event_id, event_type, value, {_avg_rank("value", "event_type")}
       / count(value) OVER (PARTITION BY event_type) AS pct_rank FROM events"""
METHOD_RANKS = f"WITH {WIDE} SELECT id, target, {', '.join(_R.values())} FROM wide"
SPEARMAN = f"""SELECT l_returnflag, count(*) AS n, {_r(_corr("rx", "ry"))} AS spearman,
       {_r(_corr("l_extendedprice", "l_quantity"))} AS pearson
FROM (SELECT *, {_avg_rank("l_extendedprice", "l_returnflag")} AS rx, {_avg_rank("l_quantity", "l_returnflag")} AS ry FROM lineitem)
GROUP BY l_returnflag"""
DIGEST_FOLDS = """SELECT c_custkey, CAST(CASE WHEN p < head THEN p // (base + 1) ELSE larger + (p - head) // base END AS INTEGER) AS fold
FROM (SELECT *, larger * (base + 1) AS head FROM (
  SELECT c_custkey, row_number() OVER (ORDER BY md5('42:' || CAST(c_custkey AS VARCHAR)), c_custkey) - 1 AS p,
         count(*) OVER () // 5 AS base, count(*) OVER () % 5 AS larger FROM customer))"""
NUMBERED = "SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS row_pos, count(*) OVER () AS n FROM customer"
RANDOM_KFOLD = f"""SELECT c_custkey, row_pos, CAST(CASE WHEN p < head THEN p // (base + 1) ELSE larger + (p - head) // base END AS INTEGER) AS fold
FROM (SELECT *, n // 7 AS base, n % 7 AS larger, (n % 7) * (n // 7 + 1) AS head,
        row_number() OVER (ORDER BY md5('42:' || CAST(row_pos AS VARCHAR)), row_pos) - 1 AS p FROM ({NUMBERED}))"""
RANDOM_HOLDOUT = f"""SELECT c_custkey, row_number() OVER (ORDER BY md5('43:' || CAST(row_pos AS VARCHAR)), row_pos) <= ceil(n * 0.2::DOUBLE) AS is_test
FROM ({NUMBERED})"""
BOOTSTRAP = f"""WITH r AS ({NUMBERED}), d AS (SELECT b, CAST(floor(
    CAST('0x' || substr(md5('42:' || CAST(b AS VARCHAR) || ':' || CAST(row_pos AS VARCHAR)), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE * n) AS BIGINT) AS hit
  FROM r, (SELECT unnest(range(3)) AS b))
SELECT c_custkey, {", ".join(f"CAST(count(hit) FILTER (b = {b}) AS INTEGER) AS w{b}" for b in range(3))}
FROM r LEFT JOIN d ON hit = row_pos GROUP BY c_custkey"""
VALUE_DECILES = f"""WITH e AS (SELECT list_distinct(quantile_cont(l_tax, [{", ".join(str(i / 10) for i in range(11))}])) AS edges FROM lineitem)
SELECT l_orderkey, l_linenumber, l_tax, CAST(greatest(0, len(list_filter(edges, lambda x: x < l_tax)) - 1) AS INTEGER) AS tax_bin FROM lineitem, e"""
STRATIFIED = """WITH s AS (SELECT p_brand, row_number() OVER (ORDER BY p_brand) - 1 AS i, count(*) OVER () AS k
           FROM (SELECT DISTINCT p_brand FROM part)),
q AS (SELECT p_brand, 101 // k + CASE WHEN i < 101 % k THEN 1 ELSE 0 END AS quota FROM s),
o AS (SELECT p_partkey, quota, row_number() OVER (PARTITION BY part.p_brand ORDER BY md5('7:' || CAST(p_partkey AS VARCHAR)), p_partkey) AS r
      FROM part JOIN q ON part.p_brand = q.p_brand),
f AS (SELECT p_partkey, row_number() OVER (ORDER BY CASE WHEN r <= quota THEN 0 ELSE 1 END,
        md5('8:' || CAST(p_partkey AS VARCHAR)), p_partkey) AS sample_pos FROM o)
SELECT p_partkey, sample_pos FROM f WHERE sample_pos <= 101"""
RANK_MAPPED = """WITH t AS (SELECT c_custkey AS k, coalesce(max(o_totalprice), 0) AS most FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1)
SELECT c_custkey, c_acctbal, most AS label_pkd
FROM (SELECT *, row_number() OVER (ORDER BY c_acctbal, c_custkey) AS i FROM customer) c
JOIN (SELECT *, row_number() OVER (ORDER BY most, k) AS i FROM t) s ON c.i = s.i"""
CALIBRATION = """cal AS (SELECT event_id, event_type, event_id % 5 = 0 AS is_cal, value AS label,
  CAST(user_id % 50 AS DOUBLE) AS mean, (user_id % 4) / 2.0 AS spread FROM events),
z AS (SELECT *, abs(label - mean) / greatest(spread, 1e-6::DOUBLE) AS z, abs(label - mean) AS a FROM cal)"""
CONFORMAL = f"""WITH {CALIBRATION}, q AS (SELECT event_type, quantile_cont(z, 0.9) AS q FROM z WHERE is_cal GROUP BY 1),
i AS (SELECT event_id, label, mean, q * greatest(spread, 1e-6::DOUBLE) AS e FROM z JOIN q ON z.event_type = q.event_type WHERE NOT is_cal)
SELECT event_id, {_r("e")} AS pred_err, {_r("mean - e")} AS pred_lower, {_r("mean + e")} AS pred_upper,
       CASE WHEN label BETWEEN mean - e AND mean + e THEN 1.0 ELSE 0.0 END AS covered FROM i"""
QUANTILES = f"""SELECT l_returnflag, {_r("quantile_cont(l_extendedprice, 0.05)")} AS q05, {_r("quantile_cont(l_extendedprice, 0.5)")} AS q50,
       {_r("quantile_cont(l_extendedprice, 0.95)")} AS q95, count(*) AS n FROM lineitem GROUP BY 1"""

_STRAINS = registry.STRAIN_ORDER
_SHOW = registry.STRAIN_DISPLAY
OOF_WIDE = f"""{OOF}, w AS (SELECT id, {", ".join(f"max(CASE WHEN target = 'na_{s}' THEN {v} END) AS {n}_{i}" for i, s in enumerate(_STRAINS) for n, v in (("label", "label_pkd"), ("pred", "pred_mean"), ("fold", "outer_fold"), ("residual", "residual"), ("abs_error", "abs_error")))}
  FROM oof GROUP BY id)"""


def _pair(a: int, b: int) -> str:
    sa, sb = _STRAINS[a], _STRAINS[b]
    return f"""SELECT 'na' AS dataset_label, 'NA' AS dataset_display, id, 'na_{sa}' AS target_a, 'na_{sb}' AS target_b,
  '{sa}' AS strain_a, '{sb}' AS strain_b, '{_SHOW[sa]}' AS strain_a_display, '{_SHOW[sb]}' AS strain_b_display,
  '{_SHOW[sa]} - {_SHOW[sb]}' AS strain_pair, label_{a} AS label_pkd_a, label_{b} AS label_pkd_b, pred_{a} AS pred_mean_a,
  pred_{b} AS pred_mean_b, label_{a} - label_{b} AS observed_delta_pkd, pred_{a} - pred_{b} AS predicted_delta_pkd,
  abs(label_{a} - label_{b}) AS observed_pair_divergence, abs(pred_{a} - pred_{b}) AS predicted_pair_divergence,
  (label_{a} - label_{b}) - (pred_{a} - pred_{b}) AS delta_residual,
  abs((label_{a} - label_{b}) - (pred_{a} - pred_{b})) AS abs_delta_error, fold_{a} AS outer_fold_a, fold_{b} AS outer_fold_b
FROM w WHERE label_{a} IS NOT NULL AND label_{b} IS NOT NULL AND pred_{a} IS NOT NULL AND pred_{b} IS NOT NULL"""


PAIRS = f"{OOF_WIDE}, pairs AS ({_pair(0, 1)} UNION ALL {_pair(0, 2)} UNION ALL {_pair(1, 2)})"


def _worst(prefix: str, names: tuple) -> str:
    low = f"least({prefix}_0, {prefix}_1, {prefix}_2)"
    return f"CASE WHEN {prefix}_0 = {low} THEN '{names[0]}' WHEN {prefix}_1 = {low} THEN '{names[1]}' ELSE '{names[2]}' END"


_SHOWN = tuple(_SHOW[s] for s in _STRAINS)


def _three_of(prefix: str) -> str:
    return f"{prefix}_0, {prefix}_1, {prefix}_2"


OOF_TRIPLETS = f"""{OOF_WIDE}, tri AS (
SELECT 'na' AS dataset_label, 'NA' AS dataset_display, id, (label_0 + label_1 + label_2) / 3.0 AS observed_mean_pkd,
  (pred_0 + pred_1 + pred_2) / 3.0 AS predicted_mean_pkd, {_worst("label", _STRAINS)} AS observed_worst_strain,
  {_worst("label", _SHOWN)} AS observed_worst_strain_display, {_worst("pred", _STRAINS)} AS predicted_worst_strain,
  {_worst("pred", _SHOWN)} AS predicted_worst_strain_display, least({_three_of("label")}) AS observed_worst_pkd,
  least({_three_of("pred")}) AS predicted_worst_pkd, greatest({_three_of("label")}) - least({_three_of("label")}) AS observed_strain_range,
  greatest({_three_of("pred")}) - least({_three_of("pred")}) AS predicted_strain_range,
  {", ".join(f"{k}_{i} AS {v}_{s}" for i, s in enumerate(_STRAINS) for k, v in (("label", "label_pkd"), ("pred", "pred_mean"), ("residual", "residual"), ("abs_error", "abs_error")))}
FROM w WHERE label_0 IS NOT NULL AND label_1 IS NOT NULL AND label_2 IS NOT NULL AND pred_0 IS NOT NULL AND pred_1 IS NOT NULL AND pred_2 IS NOT NULL)"""
HEATMAP = f"""WITH {OOF_TRIPLETS} SELECT *, row_number() OVER (ORDER BY observed_mean_pkd DESC, observed_strain_range DESC, id) AS heatmap_row FROM tri"""
FINAL_TRIPLETS = f"""{FINAL}, fw AS (
SELECT id, {", ".join(f"max(CASE WHEN target = 'na_{s}' THEN pred_mean END) AS pred_{i}, max(CASE WHEN target = 'na_{s}' THEN in_experimental_data END) AS seen_{i}" for i, s in enumerate(_STRAINS))}
FROM final GROUP BY id),
ft AS (SELECT 'na' AS dataset_label, 'NA' AS dataset_display, id, (pred_0 + pred_1 + pred_2) / 3.0 AS predicted_mean_pkd,
  list_sort([pred_0, pred_1, pred_2])[2] AS predicted_middle_pkd, greatest({_three_of("pred")}) AS predicted_max_pkd,
  {_worst("pred", _STRAINS)} AS worst_strain, {_worst("pred", _SHOWN)} AS worst_strain_display,
  least({_three_of("pred")}) AS worst_strain_pred_pkd, greatest({_three_of("pred")}) - least({_three_of("pred")}) AS predicted_strain_range,
  greatest(seen_0, seen_1, seen_2) AS in_experimental_data_any, {", ".join(f"pred_{i} AS pred_mean_{s}" for i, s in enumerate(_STRAINS))}
FROM fw WHERE pred_0 IS NOT NULL AND pred_1 IS NOT NULL AND pred_2 IS NOT NULL)"""
PROFILE = f"""WITH {FINAL_TRIPLETS} SELECT id, predicted_mean_pkd, row_number() OVER (
  ORDER BY predicted_mean_pkd DESC, predicted_middle_pkd DESC, predicted_max_pkd DESC, id) AS unassayed_prediction_rank
FROM ft WHERE coalesce(in_experimental_data_any, 0) = 0"""
# the final tables reuse the CTE names of the held-out ones, so the summary nests them
PAIR_SUMMARY = f"""WITH {PAIRS},
tri AS (SELECT count(*) AS c FROM w WHERE label_0 IS NOT NULL AND label_1 IS NOT NULL AND label_2 IS NOT NULL
        AND pred_0 IS NOT NULL AND pred_1 IS NOT NULL AND pred_2 IS NOT NULL),
fin AS (SELECT count(*) AS c FROM (SELECT id FROM summary GROUP BY id HAVING count(DISTINCT target) = 3)),
comp AS (SELECT count(DISTINCT id) AS c FROM oof),
lv AS (SELECT 'dataset' AS summary_level, 'all' AS sp, * FROM pairs UNION ALL SELECT 'pair', strain_pair, * FROM pairs),
rk AS (SELECT *, {_avg_rank("observed_delta_pkd", "sp")} AS ra, {_avg_rank("predicted_delta_pkd", "sp")} AS rb FROM lv)
SELECT summary_level, 'na' AS dataset_label, 'NA' AS dataset_display, sp AS strain_pair, count(*) AS n,
  {_r(_corr("ra", "rb"))} AS spearman, {_r("avg(abs_delta_error)")} AS mae, (SELECT c FROM comp) AS oof_compounds,
  (SELECT c FROM tri) AS complete_oof_triplets, greatest((SELECT c FROM comp) - (SELECT c FROM tri), 0) AS incomplete_oof_compounds,
  (SELECT c FROM fin) AS final_triplets
FROM rk GROUP BY summary_level, sp"""


def _words(text: str) -> str:
    return f"list_distinct(list_filter(string_split_regex(lower({text}), '\\s+'), lambda x: x <> ''))"


NEAREST = f"""d AS (SELECT doc_id AS id, lang AS target, {_words("text")} AS ws FROM documents),
b AS (SELECT item_id AS id, CASE item_id % 2 WHEN 0 THEN 'en' ELSE 'de' END AS target, {_words("text")} AS ws FROM benchmark),
dw AS (SELECT id, unnest(ws) AS w FROM d), bw AS (SELECT id, unnest(ws) AS w FROM b),
common AS (SELECT dw.id AS di, bw.id AS bi, count(*) AS c FROM dw JOIN bw ON dw.w = bw.w GROUP BY 1, 2),
sims AS (SELECT d.id, d.target, b.id AS bid, b.target AS btarget,
           coalesce(c, 0) / CAST(len(d.ws) + len(b.ws) - coalesce(c, 0) AS DOUBLE) AS s
         FROM d CROSS JOIN b LEFT JOIN common ON di = d.id AND bi = b.id),
near AS (SELECT id, target, bid, btarget, s, row_number() OVER (PARTITION BY id ORDER BY s DESC, bid, btarget) AS r1,
           row_number() OVER (PARTITION BY id, target = btarget ORDER BY s DESC, bid) AS r2 FROM sims),
nearest AS (SELECT id, target, max(CASE WHEN r1 = 1 THEN bid END) AS nid, max(CASE WHEN r1 = 1 THEN btarget END) AS nt,
           max(CASE WHEN r1 = 1 THEN s END) AS ns, max(CASE WHEN r2 = 1 AND target = btarget THEN bid END) AS sid,
           max(CASE WHEN r2 = 1 AND target = btarget THEN s END) AS ss FROM near GROUP BY id, target)"""
NEAREST_SQL = f"""WITH {NEAREST} SELECT 'text' AS target_class, id, target, nid AS nearest_labeled_id, nt AS nearest_labeled_target,
  {_r("ns", 9)} AS nearest_labeled_tanimoto, sid AS nearest_labeled_same_target_id,
  {_r("ss", 9)} AS nearest_labeled_same_target_tanimoto FROM nearest"""
EXTRAPOLATION = f"""{NEAREST},
sc AS (SELECT doc_id AS id, 's' || CAST(doc_id % 97 AS VARCHAR) AS scaffold, doc_id IN (SELECT item_id FROM benchmark) AS lab FROM documents),
cnt AS (SELECT scaffold, sum(CASE WHEN lab THEN 1 ELSE 0 END) AS nl FROM sc GROUP BY 1),
flags AS (SELECT sc.id, CASE WHEN nl = 0 THEN 1 ELSE 0 END AS u, CASE WHEN ns < 0.05 THEN 1 ELSE 0 END AS l
          FROM sc JOIN cnt ON sc.scaffold = cnt.scaffold JOIN nearest ON nearest.id = sc.id)"""
DISTANCES = f"""WITH v AS (SELECT vec_id, label, list_filter(list_transform(embedding, lambda x, i: CASE WHEN x > 0 THEN i END), lambda i: i IS NOT NULL) AS s
  FROM embeddings)
SELECT a.vec_id, a.label AS cluster, {_r("sum(1.0::DOUBLE - CAST(len(list_intersect(a.s, b.s)) AS DOUBLE) / (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s))))")} AS total
FROM v a JOIN v b ON a.label = b.label GROUP BY 1, 2"""
# The steps of k-medoids as two recursions over a table of distances: farthest seeds (s), then moves of the medoids (r).
K_MEDOIDS = """WITH RECURSIVE v AS (SELECT vec_id, list_filter(range(len(embedding)), lambda i: embedding[i + 1] > 0) AS bits FROM embeddings),
d AS MATERIALIZED (SELECT p.vec_id AS a, q.vec_id AS b,
    1.0 - coalesce(len(list_intersect(p.bits, q.bits))::DOUBLE / nullif(len(p.bits) + len(q.bits) - len(list_intersect(p.bits, q.bits)), 0), 1.0) AS x
  FROM v p, v q),
s(n, m) AS (
  SELECT 1, [(SELECT a FROM d GROUP BY a ORDER BY round(sum(x), 9), a LIMIT 1)]
  UNION ALL
  SELECT n + 1, list_append(m, list(a ORDER BY near DESC, a)[1])
  FROM (SELECT n, m, a, min(x) AS near FROM s JOIN d ON list_contains(m, b) WHERE n < 6 AND NOT list_contains(m, a) GROUP BY n, m, a) GROUP BY n, m),
r(step, m, cost, stop) AS (
  SELECT 0, m, (SELECT sum(near) FROM (SELECT min(x) AS near FROM d WHERE list_contains(s.m, b) GROUP BY a)), false FROM s WHERE n = 6
  UNION ALL
  (WITH c AS (SELECT step, m, cost, a, list(list_position(m, b) ORDER BY x, list_position(m, b))[1] AS k
     FROM r JOIN d ON list_contains(m, b) WHERE NOT stop AND step < 100 GROUP BY step, m, cost, a),
   t AS (SELECT c.step, c.m, c.cost, c.k, c.a, round(sum(d.x), 9) AS total FROM c JOIN d ON d.a = c.a JOIN c o ON o.a = d.b AND o.k = c.k GROUP BY ALL),
   e AS (SELECT step, m, cost, k, list(a ORDER BY total, a)[1] AS centre FROM t GROUP BY ALL),
   f AS (SELECT step, m, cost, list_transform(m, lambda x, i: coalesce(map(list(k), list(centre))[i], x)) AS moved FROM e GROUP BY step, m, cost),
   g AS (SELECT step, m, cost, moved, sum(near) AS fresh FROM (SELECT step, m, cost, moved, a, min(x) AS near FROM f JOIN d ON list_contains(moved, b) GROUP BY ALL) GROUP BY ALL)
   SELECT step + 1, CASE WHEN fresh < cost THEN moved ELSE m END, CASE WHEN fresh < cost THEN fresh ELSE cost END, moved = m OR fresh >= cost FROM g)),
z AS (SELECT m FROM r ORDER BY step DESC LIMIT 1),
y AS (SELECT a, list(list_position(m, b) - 1 ORDER BY x, list_position(m, b))[1] AS k FROM z JOIN d ON list_contains(m, b) GROUP BY a)
SELECT a AS vec_id, CAST(k AS INTEGER) AS chem_cluster_id, count(*) OVER (PARTITION BY k) AS chem_cluster_size FROM y"""

# ridge on two standardised features, in closed form
REG = """reg AS (SELECT l_returnflag, CAST(l_suppkey % 3 AS INTEGER) AS fold, l_extendedprice AS x1, l_discount AS x2, l_quantity AS y FROM lineitem)"""


def _ridge(group: str, alpha: str, standardize: bool = True, source: str = "reg") -> str:
    by = f"GROUP BY {group}" if group else ""
    key = f"{group}, " if group else ""
    s1, s2 = ("stddev_pop(x1)", "stddev_pop(x2)") if standardize else ("1.0", "1.0")
    return f"""(SELECT {key}my - b1 / s1 * m1 - b2 / s2 * m2 AS b0, b1 / s1 AS b1, b2 / s2 AS b2 FROM (
  SELECT *, (a22 * c1 - a12 * c2) / (a11 * a22 - a12 * a12) AS b1, (a11 * c2 - a12 * c1) / (a11 * a22 - a12 * a12) AS b2 FROM (
    SELECT {key}avg(x1) AS m1, avg(x2) AS m2, avg(y) AS my, {s1} AS s1, {s2} AS s2,
      count(*) * var_pop(x1) / ({s1} * {s1}) + {alpha} AS a11, count(*) * var_pop(x2) / ({s2} * {s2}) + {alpha} AS a22,
      count(*) * covar_pop(x1, x2) / ({s1} * {s2}) AS a12, count(*) * covar_pop(x1, y) / {s1} AS c1,
      count(*) * covar_pop(x2, y) / {s2} AS c2 FROM {source} {by})))"""


def _trial(alpha: float) -> str:
    folds = " UNION ALL ".join(
        f"SELECT sqrt(avg((y - b0 - b1 * x1 - b2 * x2) * (y - b0 - b1 * x1 - b2 * x2))) AS e FROM reg, "
        f"{_ridge('', str(alpha), source=f'(SELECT * FROM reg WHERE fold <> {k})')} WHERE fold = {k}"
        for k in range(3)
    )
    return f"SELECT CAST({alpha} AS DOUBLE) AS alpha, {_r('avg(e)')} AS rmse FROM ({folds})"


# resamples of the held-out scores: all rows, those of one flag, and all rows with those of another flag twice
RESAMPLES = ("reg", "(SELECT * FROM reg WHERE l_returnflag = 'N')", "(SELECT * FROM reg UNION ALL SELECT * FROM reg WHERE l_returnflag = 'A')")


def _fold_score(alpha: float, fold: int, replicate: int) -> str:
    source = RESAMPLES[replicate]
    error = "(y - b0 - b1 * x1 - b2 * x2) * (y - b0 - b1 * x1 - b2 * x2)"
    return (
        f"SELECT CAST({fold} AS INTEGER) AS fold, CAST({replicate} AS INTEGER) AS replicate, CAST({alpha} AS DOUBLE) AS alpha, "
        f"{_r(f'sqrt(avg({error}))')} AS rmse, {_r(f'1 - sum({error}) / (count(*) * var_pop(y))')} AS r2 FROM {source} s, "
        f"{_ridge('', str(alpha), source=f'(SELECT * FROM {source} WHERE fold <> {fold})')} WHERE fold = {fold}"
    )


def _square(g: str, h: str) -> str:
    return f"power(greatest(abs({g}) - alp, 0), 2) / ({h} + lam)"


def _leaf(g: str, h: str) -> str:
    return f"-sign({g}) * greatest(abs({g}) - alp, 0) / ({h} + lam)"


# the best first split of trees with penalties, without one fold each
SPLITS = f"""tr AS (SELECT CAST(l_suppkey % 3 AS INTEGER) AS fold, l_quantity AS y,
    [l_discount, nullif(CAST(l_linenumber AS DOUBLE), 3.0), l_tax] AS xs FROM lineitem),
u AS (SELECT fold, y, unnest([1, 2, 3]) AS f, unnest(xs) AS x FROM tr),
base AS (SELECT k, avg(y) AS m FROM (VALUES (0), (1), (2)) v(k) JOIN tr ON fold <> k GROUP BY k),
cell AS (SELECT k, f, x, sum(m - y) AS g, CAST(count(*) AS DOUBLE) AS h FROM base JOIN u ON fold <> k GROUP BY k, f, x),
pre AS (SELECT k, f, x, sum(g) OVER w AS ga, sum(h) OVER w AS ha, sum(CASE WHEN x IS NULL THEN g ELSE 0 END) OVER w AS gm,
    sum(CASE WHEN x IS NULL THEN h ELSE 0 END) OVER w AS hm, sum(CASE WHEN x IS NULL THEN 0 ELSE g END) OVER o AS gk,
    sum(CASE WHEN x IS NULL THEN 0 ELSE h END) OVER o AS hk FROM cell
    WINDOW w AS (PARTITION BY k, f), o AS (PARTITION BY k, f ORDER BY x NULLS FIRST)),
side AS (SELECT k, f, x, trial, lam, alp, rate, ml, ga, ha, gk + ml * gm AS gl, hk + ml * hm AS hl FROM pre,
    (VALUES (0, 1.0, 0.0, 0.5), (1, 50.0, 20.0, 1.0)) p(trial, lam, alp, rate), (VALUES (0), (1)) s(ml) WHERE x IS NOT NULL),
rated AS (SELECT *, {_square("gl", "hl")} + {_square("(ga - gl)", "(ha - hl)")} - {_square("ga", "ha")} AS gain FROM side WHERE hl >= 1 AND ha - hl >= 1),
best AS (SELECT *, {_leaf("gl", "hl")} AS lv, {_leaf("(ga - gl)", "(ha - hl)")} AS rv FROM rated
    QUALIFY row_number() OVER (PARTITION BY trial, k ORDER BY gain DESC, f, x, ml) = 1)"""


ENSEMBLE = f"""WITH {REG}, p AS (SELECT l_returnflag, {", ".join(f"m{k}.b0 + m{k}.b1 * x1 + m{k}.b2 * x2 AS p{k}" for k in range(3))}
  FROM reg, {", ".join(f"{_ridge('', '1.0', False, f'(SELECT * FROM reg WHERE fold = {k})')} m{k}" for k in range(3))}),
s AS (SELECT *, (p0 + p1 + p2) / 3.0 AS c FROM p),
t AS (SELECT *, sqrt(((p0 - c) * (p0 - c) + (p1 - c) * (p1 - c) + (p2 - c) * (p2 - c)) / 2.0) AS d FROM s)
SELECT l_returnflag, {_r("avg(c)")} AS mean_center, {_r("avg(d)")} AS mean_spread, {_r("max(d)")} AS max_spread FROM t GROUP BY 1"""

_COVERED = f"""{LIBRARY}, {ASSAY}, agg AS (
  SELECT id, count(*) AS n_assays, count(DISTINCT target) AS nt, string_agg(DISTINCT target, '|' ORDER BY target) AS ts,
         string_agg(DISTINCT round_id, '|' ORDER BY round_id) AS rs, avg(label_pkd) AS mean, max(label_pkd) AS mx, min(label_pkd) AS mn
  FROM assay GROUP BY id),
covered AS (SELECT library.*, agg.id IS NOT NULL AS assayed_any, coalesce(n_assays, 0) AS n_assays, coalesce(nt, 0) AS n_assayed_targets,
         coalesce(ts, '') AS assayed_targets, coalesce(rs, '') AS assay_rounds, mean, mx, mn
  FROM library LEFT JOIN agg ON library.id = agg.id)"""
SCAFFOLDS = f"""{_COVERED}, tg AS (
  SELECT target_class, murcko_scaffold, string_agg(DISTINCT t, '|' ORDER BY t) AS assayed_targets
  FROM (SELECT target_class, murcko_scaffold, unnest(string_split(assayed_targets, '|')) AS t FROM covered) WHERE t <> '' GROUP BY 1, 2),
sc AS (SELECT target_class, murcko_scaffold, string_agg(DISTINCT scaffold_type, '|' ORDER BY scaffold_type) AS scaffold_type,
         count(*) AS scaffold_library_count, CAST(sum(CASE WHEN assayed_any THEN 1 ELSE 0 END) AS BIGINT) AS scaffold_assayed_count,
         sum(CASE WHEN assayed_any THEN 1 ELSE 0 END)::DOUBLE / count(*) AS scaffold_assayed_fraction, CAST(sum(n_assays) AS BIGINT) AS n_assays
  FROM covered GROUP BY 1, 2),
scaffolds AS (SELECT sc.*, coalesce(tg.assayed_targets, '') AS assayed_targets
  FROM sc LEFT JOIN tg ON sc.target_class = tg.target_class AND sc.murcko_scaffold = tg.murcko_scaffold)"""
SETS_LABEL = "list_aggregate(list_transform(string_split(ts, '|'), lambda t: {}), 'string_agg', ' | ')".format(
    _case("t", {"na_ph1n1": "NA pH1N1", "na_h3n2": "NA H3N2", "na_h5n1": "NA H5N1"})
)
_CONTEXT = ", ".join(
    [f"CASE WHEN target = 'na_{s}' THEN 1 ELSE 0 END AS is_{s}" for s in ("h3n2", "h5n1")]
    + [
        f"{_q(m + '_score')} * CASE WHEN target = 'na_{s}' THEN 1 ELSE 0 END AS {_q(f'{m}_score_x_{s}')}"
        for s in ("h3n2", "h5n1")
        for m in M
    ]
)
_SCORES = ", ".join(_q(m + "_score") for m in M)
_SPREAD = "(SELECT id, target, spread FROM pred WHERE method = 'glide-sp')"


def _group_folds(key: str = "c_nationkey", n_splits: int = 5) -> str:
    """Greedy balancing as a recursion over groups in descending size."""
    lightest = "list_position(loads, list_aggregate(loads, 'min'))"
    return f"""WITH RECURSIVE c AS (SELECT c_custkey, {key} AS k FROM customer),
g AS (SELECT k, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, k DESC NULLS LAST) AS i FROM c GROUP BY k),
r(i, key, fold, loads) AS (
  SELECT CAST(0 AS BIGINT), CAST(NULL AS INTEGER), CAST(NULL AS INTEGER), {[0] * n_splits}::BIGINT[]
  UNION ALL
  SELECT g.i, g.k, CAST({lightest} - 1 AS INTEGER),
         list_transform(loads, lambda x, j: CASE WHEN j = {lightest} THEN x + g.n ELSE x END)
  FROM r JOIN g ON g.i = r.i + 1)
SELECT c_custkey, k AS c_nationkey, fold FROM c JOIN r ON r.key IS NOT DISTINCT FROM k WHERE i > 0"""


def _poisson(b: int) -> str:
    u = f"(CAST('0x' || substr(md5('42:{b}:' || CAST(c_custkey AS VARCHAR)), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE)"
    return " + ".join(f"CASE WHEN {u} >= {t!r}::DOUBLE THEN 1 ELSE 0 END" for t in POISSON_CDF)


def oracle_sql() -> dict[str, str]:
    """Return the SQL for every catalog query that SQL can express."""
    out = {
        "percentile_ranks": PERCENTILE,
        "method_scores": f"WITH {WIDE} SELECT id, target, {_SCORES} FROM wide",
        "method_ranks": METHOD_RANKS,
        "method_rank_summary": f"WITH {SUMMARY} SELECT id, target, {', '.join(registry.SUMMARY_COLUMNS)} FROM summary",
        "spread_feature": f'WITH {PRED} SELECT id, target, spread AS "{registry.SPREAD_COLUMN}" FROM pred WHERE method = \'glide-sp\'',
        "target_context": f"WITH {WIDE} SELECT id, target, {_CONTEXT} FROM wide",
        "observed_target_context": f"WITH {WIDE} SELECT id, target, "
        + ", ".join(
            [f"CASE WHEN target = 'na_{s}' THEN 1 ELSE 0 END AS is_{s}" for s in ("h3n2", "h5n1")]
            + [
                f"{_q(f)} * CASE WHEN target = 'na_{s}' THEN 1 ELSE 0 END AS {_q(f + '_x_' + s)}"
                for s in ("h3n2", "h5n1")
                for f in ("boltz-2_score", "balm_score")
            ]
        )
        + " FROM wide",
        "combined_features": f"WITH {SUMMARY} SELECT summary.*, spread AS \"{registry.SPREAD_COLUMN}\" FROM summary "
        f"JOIN {_SPREAD} g ON summary.id = g.id AND summary.target = g.target",
        "training_table": f"WITH {WIDE}, {LABELS} SELECT l.id, l.target, target_class, strain, smiles, label_pkd, {_SCORES} "
        "FROM labels_ l JOIN wide w ON l.id = w.id AND l.target = w.target",
        "inference_table": f"WITH {WIDE}, {LIBRARY} SELECT w.id, w.target, 'na' AS target_class, "
        f"{_case('w.target', {'na_ph1n1': 'ph1n1', 'na_h3n2': 'h3n2', 'na_h5n1': 'h5n1'})} AS strain, smiles, {_SCORES} "
        "FROM wide w JOIN library l ON l.id = w.id",
        "pooled_targets": f"WITH {PRED}, {LABELS} SELECT l.id, l.target, target_class, strain, smiles, label_pkd, "
        f'spread AS "{registry.SPREAD_COLUMN}" FROM labels_ l JOIN {_SPREAD} g ON l.id = g.id AND l.target = g.target',
        "row_universe": "SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders "
        "INTERSECT SELECT s_suppkey FROM supplier)",
        "overlap_flag": "SELECT c_custkey, CASE WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) "
        "THEN 1 ELSE 0 END AS in_orders, c_mktsegment FROM customer",
        "merged_predictions": f"WITH {PRED}, {LABELS}, one AS (SELECT id, target, "
        + ", ".join(
            f"max(CASE WHEN method = '{m}' THEN {v} END) AS {_q(f'{n}_{m}')}"
            for m in M
            for n, v in (
                (("pred_mean", "prediction"), ("pred_err", "spread")) if m in {"balm", "pignet2"} else (("pred", "prediction"),)
            )
        )
        + " FROM pred GROUP BY 1, 2 HAVING bool_or(method = 'balm')) SELECT one.*, CASE WHEN l.id IS NULL THEN 0 ELSE 1 END "
        "AS in_experimental_data FROM one LEFT JOIN labels_ l ON l.id = one.id AND l.target = one.target",
        "candidate_diagnostics": f"WITH {SUMMARY}, a AS (SELECT id, target, method_rank_sd FROM summary WHERE method_rank_sd > 0.25), "
        "b AS (SELECT id, target, branch_rank_sd FROM summary WHERE method_rank_sd < 0.3) "
        "SELECT coalesce(a.id, b.id) AS id, coalesce(a.target, b.target) AS target, method_rank_sd, branch_rank_sd "
        "FROM a FULL JOIN b ON a.id = b.id AND a.target = b.target",
        "registry_join": f"WITH {PRED} SELECT method, id, target, 'na' AS target_class, {STRAIN} AS strain FROM pred",
        "unlabelled_compounds": f"WITH {LIBRARY}, {ASSAY} SELECT id, target_class FROM library WHERE NOT EXISTS "
        "(SELECT 1 FROM assay WHERE assay.id = library.id)",
        "duplicate_keys": "SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
        "assay_coverage": f"WITH {_COVERED} SELECT target_class, id, assayed_any, n_assays, n_assayed_targets, assayed_targets, "
        f"assay_rounds, {_r('mean')} AS label_pkd_mean, mx AS label_pkd_max, mn AS label_pkd_min FROM covered",
        "assay_groups": f"WITH {_COVERED} SELECT id, CASE WHEN NOT assayed_any THEN 'Unassayed' WHEN n_assayed_targets > 1 THEN 'Multi-target' "
        f"ELSE {_case('assayed_targets', {'na_ph1n1': 'NA pH1N1', 'na_h3n2': 'NA H3N2', 'na_h5n1': 'NA H5N1'})} END AS assay_plot_group FROM covered",
        "scaffold_coverage": f"WITH {SCAFFOLDS} SELECT * FROM scaffolds",
        "scaffold_counts": f"WITH {_COVERED} SELECT id, murcko_scaffold, count(*) OVER (PARTITION BY murcko_scaffold) AS scaffold_library_count, "
        "CAST(sum(CASE WHEN assayed_any THEN 1 ELSE 0 END) OVER (PARTITION BY murcko_scaffold) AS BIGINT) AS scaffold_assayed_count FROM covered",
        "top_scaffolds": f"WITH {SCAFFOLDS} SELECT * FROM scaffolds ORDER BY scaffold_assayed_count DESC, scaffold_library_count DESC, "
        "murcko_scaffold LIMIT 20",
        "class_summary": f"WITH {SCAFFOLDS}, a AS (SELECT target_class, count(*) AS library_size, CAST(sum(CASE WHEN assayed_any THEN 1 ELSE 0 END) AS BIGINT) AS assayed_count FROM covered GROUP BY 1), "
        "b AS (SELECT target_class, count(*) AS scaffold_count, CAST(sum(CASE WHEN scaffold_assayed_count > 0 THEN 1 ELSE 0 END) AS BIGINT) AS assayed_scaffold_count FROM scaffolds GROUP BY 1) "
        "SELECT a.target_class, library_size, assayed_count, assayed_count::DOUBLE / library_size AS assay_fraction, scaffold_count, "
        "assayed_scaffold_count, assayed_scaffold_count::DOUBLE / scaffold_count AS scaffold_coverage_fraction FROM a JOIN b ON a.target_class = b.target_class",
        "scaffold_annotations": f"WITH {LIBRARY}, {ASSAY}, k AS (SELECT DISTINCT id FROM assay), "
        "c AS (SELECT library.id, murcko_scaffold, scaffold_type, count(*) OVER (PARTITION BY murcko_scaffold) AS scaffold_library_count, "
        "CAST(sum(CASE WHEN k.id IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY murcko_scaffold) AS BIGINT) AS scaffold_assayed_count "
        "FROM library LEFT JOIN k ON k.id = library.id), f AS (SELECT *, scaffold_assayed_count::DOUBLE / scaffold_library_count AS scaffold_coverage_fraction FROM c) "
        "SELECT *, CASE WHEN scaffold_coverage_fraction <= 0 THEN '0%' WHEN scaffold_coverage_fraction <= 0.10::DOUBLE THEN '0-10%' WHEN scaffold_coverage_fraction <= 0.25 THEN '10-25%' "
        "WHEN scaffold_coverage_fraction <= 0.5 THEN '25-50%' ELSE '>50%' END AS scaffold_coverage_group FROM f",
        "cv_summary": f"WITH {FOLDS} SELECT 'mean_across_outer_folds' AS summary, dataset_label, comparison_name, model_type, p, tuning_mode, tuning_metric, "
        f"{_r('avg(n_test)', 4)} AS n_test, {_r('avg(rmse)', 4)} AS rmse, {_r('avg(spearman)', 4)} AS spearman, {PARAMS_BY_FOLD} "
        "AS selected_model_params_by_outer_fold FROM folds GROUP BY 1, 2, 3, 4, 5, 6, 7",
        "family_summary": f"WITH {FOLDS} SELECT dataset_label, model_type, comparison_name, p, {_r('avg(spearman)')} AS spearman_mean, "
        f"{_r('stddev_samp(spearman)')} AS spearman_std, count(spearman) AS n_folds, dataset_label || ' | ' || model_type AS row_label FROM folds GROUP BY 1, 2, 3, 4",
        "fold_winners": _winners("spearman", "DESC"),
        "fold_winners_lowest": _winners("rmse", "ASC"),
        "candidate_cv": f"WITH {FOLDS}, {CANDIDATE_CV.format(m='spearman')} SELECT dataset_label, comparison_name, model_type, p, {_r('mean')} AS spearman_mean, "
        f"{_r('std')} AS spearman_std, n_outer_folds, {_r('sem')} AS spearman_sem, model_complexity_rank FROM cand",
        "one_se_selection": _select("spearman", "one_se_simpler"),
        "one_se_selection_lowest": _select("rmse", "one_se_simpler"),
        "best_mean_selection": _select("spearman", "best_mean"),
        "feature_set_order": f"WITH {FOLDS}, f AS (SELECT DISTINCT dataset_label, comparison_name, p FROM folds) SELECT *, "
        "'Scores + ' || upper(substr(comparison_name, 20, 1)) || substr(comparison_name, 21) AS feature_set_label FROM f",
        "expanded_params": f"WITH {TRACE} SELECT trial_number, CAST(alpha AS DOUBLE) AS param_alpha, CAST(learning_rate AS DOUBLE) AS param_learning_rate, "
        "max_depth AS param_max_depth, n_estimators AS param_n_estimators, CAST(subsample AS DOUBLE) AS param_subsample, "
        f"{_r('log10(alpha)', 9)} AS param_log10_alpha, {_r('log10(learning_rate)', 9)} AS param_log10_learning_rate, {SIGNATURE} AS param_signature FROM trace",
        "best_trials": f"WITH {TRACE}, s AS (SELECT *, {SIGNATURE} AS param_signature FROM trace WHERE outer_fold IS NOT NULL), r AS (SELECT *, row_number() OVER "
        "(PARTITION BY dataset_label, model_type, comparison_name, outer_fold ORDER BY tuning_score DESC, trial_number, param_signature) AS rn FROM s) "
        "SELECT dataset_label, model_type, comparison_name, outer_fold, trial_number, tuning_score, param_signature, p FROM r WHERE rn = 1",
        "inner_trials": f"WITH {TRACE} SELECT dataset_label, model_type, comparison_name, outer_fold, trial_number, tuning_score, "
        f"{_case('comparison_name', FEATURE_LABEL)} AS feature_set_label, {_case('dataset_label', CLASS_LABEL)} AS target_class_label FROM trace WHERE outer_fold IS NOT NULL",
        "score_landscape": LANDSCAPE,
        "outer_metric_trials": f"WITH {FOLDS}, {TRACE}, b AS (SELECT dataset_label, outer_fold, max(tuning_score) AS tuning_score FROM trace "
        "GROUP BY 1, 2) SELECT f.dataset_label, f.outer_fold, comparison_name, model_type, p, tuning_mode, "
        "b.tuning_score, spearman AS outer_fold_spearman FROM folds f JOIN b ON f.dataset_label = b.dataset_label AND f.outer_fold = b.outer_fold",
        "running_best": f"WITH {TRACE} SELECT dataset_label, comparison_name, model_type, outer_fold, trial_number, tuning_score, max(tuning_score) OVER "
        "(PARTITION BY dataset_label, comparison_name, model_type, outer_fold ORDER BY trial_number) AS best_tuning_score_so_far FROM trace WHERE outer_fold IS NOT NULL",
        "score_deciles": DECILES,
        "oof_intervals": f"WITH {OOF} SELECT dataset_label, outer_fold, id, target, label_pkd, pred_mean, pred_err, pred_lower, pred_upper, residual, abs_error, covered FROM oof",
        "disagreement_bins": f"WITH {DIS_BINS} SELECT id, target, disagreement_bin AS selected_disagreement_bin, 'NA' AS dataset_display, "
        f"{_case('target', {'na_ph1n1': 'NA pH1N1', 'na_h3n2': 'NA H3N2', 'na_h5n1': 'NA H5N1'})} AS target_display FROM binned",
        "disagreement_summary": DIS_SUMMARY,
        "prediction_summary": PREDICTION_SUMMARY,
        "fold_metrics": FOLD_METRICS,
        "mean_fold_metrics": f"WITH {FOLDS} SELECT dataset_label, {_r('avg(rmse)')} AS rmse, {_r('avg(spearman)')} AS spearman FROM folds GROUP BY 1",
        "spearman_by_group": SPEARMAN,
        "binary_hits": f"WITH {LABELS} SELECT id, target, CASE WHEN label_pkd >= 5.0 THEN 1 ELSE 0 END AS hit FROM labels_",
        "rounded_metrics": f"SELECT event_id, {_r('value / 7', 4)} AS value FROM events",
        "digest_folds": DIGEST_FOLDS,
        "random_kfold_sizes": "WITH n AS (SELECT count(*) AS n FROM customer), f AS (SELECT CAST(unnest(range(7)) AS INTEGER) AS fold) "
        "SELECT fold, n // 7 + CASE WHEN fold < n % 7 THEN 1 ELSE 0 END AS n, n // 7 + CASE WHEN fold < n % 7 THEN 1 ELSE 0 END AS n_ids FROM f, n",
        "random_kfold": RANDOM_KFOLD,
        "random_holdout": RANDOM_HOLDOUT,
        "bootstrap_weights": BOOTSTRAP,
        "value_deciles": VALUE_DECILES,
        "group_kfold_missing": _group_folds("CASE WHEN c_nationkey % 5 > 0 THEN c_nationkey END", 3),
        "group_kfold": _group_folds(),
        "random_holdout_sizes": "SELECT is_test, CASE WHEN is_test THEN CAST(ceil(n * 0.2::DOUBLE) AS BIGINT) ELSE n - CAST(ceil(n * 0.2::DOUBLE) AS BIGINT) END AS n "
        "FROM (SELECT count(*) AS n FROM customer), (SELECT unnest([true, false]) AS is_test)",
        "holdout_by_column": "SELECT c_custkey, c_mktsegment, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 0 END AS fold FROM customer",
        "bootstrap_totals": "SELECT CAST(unnest(range(4)) AS INTEGER) AS replicate, count(*) AS drawn FROM customer",
        "poisson_bootstrap": f"SELECT c_custkey, {', '.join(f'{_poisson(b)} AS w{b}' for b in range(3))} FROM customer",
        "stratified_sample": STRATIFIED,
        "rank_mapped_labels": RANK_MAPPED,
        "feature_scaling": f"SELECT 'l_extendedprice' AS feature, {_r('avg(l_extendedprice)')} AS mean, {_r('stddev_pop(l_extendedprice)')} AS scale FROM lineitem "
        f"UNION ALL SELECT 'l_discount', {_r('avg(l_discount)')}, {_r('stddev_pop(l_discount)')} FROM lineitem",
        "ridge_coefficients": f"WITH {REG} SELECT l_returnflag, {_r('b0', 8)} AS intercept, {_r('b1', 8)} AS b_price, {_r('b2', 8)} AS b_discount "
        f"FROM {_ridge('l_returnflag', '12.5')}",
        "ridge_predictions": f"WITH {REG} SELECT l_returnflag, {_r('avg(b0 + b1 * x1 + b2 * x2)')} AS mean_pred, {_r('max(b0 + b1 * x1 + b2 * x2)')} AS max_pred "
        f"FROM reg, {_ridge('', '3.0')} GROUP BY 1",
        "ridge_trial_scores": f"WITH {REG} " + " UNION ALL ".join(_trial(a) for a in (0.01, 1.0, 100000.0)),
        "ridge_fold_scores": f"WITH {REG} "
        + " UNION ALL ".join(_fold_score(a, k, b) for a in (0.01, 1.0, 100000.0) for k in range(3) for b in range(3)),
        "ensemble_intervals": ENSEMBLE,
        "conformal_intervals": CONFORMAL,
        "calibration_errors": f"WITH {CALIBRATION} SELECT {_r('median(a)', 3)} AS raw_abs_err_median, {_r('quantile_cont(a, 0.9)', 3)} AS raw_abs_err_q, "
        f"{_r('median(z)', 3)} AS standardized_err_median, {_r('quantile_cont(z, 0.9)', 3)} AS standardized_err_q FROM z WHERE is_cal",
        "value_quantiles": QUANTILES,
        "target_pairs": f"WITH {PAIRS} SELECT * FROM pairs",
        "oof_triplets": HEATMAP,
        "final_triplets": f"WITH {FINAL_TRIPLETS} SELECT * FROM ft",
        "unassayed_profile": PROFILE,
        "pair_summary": PAIR_SUMMARY,
        "nearest_labelled": NEAREST_SQL,
        "nearest_labelled_blocks": NEAREST_SQL,
        "tanimoto_distance_sums": DISTANCES,
        "k_medoids": K_MEDOIDS,
        "boosted_trees": "SELECT count(*) AS n_scored, true AS error_below_mean, true AS same_on_second_fit FROM lineitem",
        "boosted_splits": f"WITH {SPLITS} SELECT CAST(trial AS INTEGER) AS trial, CAST(best.k AS INTEGER) AS fold, {_r('m')} AS base, "
        "CASE WHEN gain > 1e-6 THEN ['discount', 'line', 'tax'][f] END AS feature, CASE WHEN gain > 1e-6 THEN x END AS cut, "
        "CASE WHEN gain > 1e-6 THEN ml = 1 END AS missing_left, "
        + ", ".join(f"CASE WHEN gain > 1e-6 THEN {_r(e)} END AS {n}" for e, n in (("gain", "gain"), ("lv", "left_value"), ("rv", "right_value")))
        + " FROM best JOIN base ON base.k = best.k",
        "tree_trial_scores": f"WITH {SPLITS}, e AS (SELECT trial, fold, sqrt(avg(power(y - m - CASE WHEN gain <= 1e-6 THEN 0 "
        "WHEN coalesce(xs[f] <= x, ml = 1) THEN rate * lv ELSE rate * rv END, 2))) AS e FROM tr JOIN best ON best.k = fold JOIN base ON base.k = fold "
        f"GROUP BY trial, fold) SELECT CAST(trial AS INTEGER) AS trial, {_r('avg(e)')} AS rmse FROM e GROUP BY trial",
        "tanimoto_distance_sums_blocks": DISTANCES,
        "scaffold_novelty": f"WITH {LIBRARY}, {ASSAY}, k AS (SELECT DISTINCT id FROM assay), "
        "c AS (SELECT library.id, target_class, murcko_scaffold, scaffold_type, count(*) OVER (PARTITION BY target_class, murcko_scaffold) AS scaffold_library_count, "
        "CAST(sum(CASE WHEN k.id IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY target_class, murcko_scaffold) AS BIGINT) AS scaffold_labeled_count "
        "FROM library LEFT JOIN k ON k.id = library.id) SELECT *, scaffold_labeled_count::DOUBLE / scaffold_library_count AS scaffold_labeled_fraction, "
        "CASE WHEN scaffold_labeled_count = 0 THEN 1 ELSE 0 END AS unseen_scaffold_flag FROM c",
        "extrapolation_flags": f"WITH {EXTRAPOLATION} SELECT id, u AS unseen_scaffold_flag, l AS low_similarity_flag, 0 AS no_labeled_compounds_flag, "
        "greatest(u, l) AS extrapolation_flag, concat_ws('|', CASE WHEN u = 1 THEN 'unseen_scaffold' END, CASE WHEN l = 1 THEN 'low_similarity' END) AS extrapolation_reason FROM flags",
        "extrapolation_summary": f"WITH {EXTRAPOLATION} SELECT 'text' AS dataset_label, 'text' AS target_class, count(*) AS n_rows, CAST(sum(greatest(u, l)) AS BIGINT) AS n_extrapolation, "
        f"{_r('avg(greatest(u, l))')} AS extrapolation_fraction, CAST(sum(u) AS BIGINT) AS n_unseen_scaffold, CAST(sum(l) AS BIGINT) AS n_low_similarity, CAST(0 AS BIGINT) AS n_no_labeled_compounds FROM flags",
        "display_labels": f"WITH {FOLDS}, f AS (SELECT DISTINCT dataset_label, comparison_name, model_type FROM folds), g AS (SELECT *, {_case('dataset_label', CLASS_LABEL)} AS dataset_display, "
        "'Scores + ' || upper(substr(comparison_name, 20, 1)) || substr(comparison_name, 21) AS feature_set_label, "
        "CASE model_type WHEN 'ridge' THEN 'Ridge' WHEN 'xgboost' THEN 'XGBoost' ELSE 'Gaussian Process' END AS model_label FROM f) "
        "SELECT *, model_label || ' | ' || feature_set_label AS candidate_label FROM g",
        "target_set_labels": f"WITH {ASSAY}, a AS (SELECT id, string_agg(DISTINCT target, '|' ORDER BY target) AS ts FROM assay GROUP BY id) SELECT id, {SETS_LABEL} AS display_assayed_targets FROM a",
    }
    for name in list(out):
        if name in SPLIT_TWINS:
            out[f"{name}_split"] = out[name]
    return out


PARAMS_BY_FOLD = (
    "string_agg('fold_' || CAST(outer_fold AS VARCHAR) || '={''alpha'': ' "
    "|| CAST(CAST(p + outer_fold / 4.0 AS DOUBLE) AS VARCHAR) || '}', ' | ' ORDER BY outer_fold)"
)
SPLIT_TWINS = {
    "percentile_ranks",
    "method_ranks",
    "score_landscape",
    "running_best",
    "score_deciles",
    "disagreement_summary",
    "prediction_summary",
    "fold_metrics",
    "spearman_by_group",
    "digest_folds",
    "stratified_sample",
    "rank_mapped_labels",
    "conformal_intervals",
    "value_quantiles",
    "oof_triplets",
    "unassayed_profile",
}
