"""Queries of the evaluation operators, each with the SQL it is compared with where SQL can express it."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.keys import DATE_PATTERN, call_id, classifier_text, date_texts, mentions_date, messages, settings_hash
from ..functions.labels import divergent_token_score, hard_label, parse_label, status
from ..functions.text import label_form, uid_form
from ..operators import audit, bootstrap, frame as fr, gates, metrics, models, reports, runlog, sampling, scoring
from ..operators.skew import prefix_sums, rank_within
from ..schema import CONDITIONS, FIELD_ORDER, STRATA, fields_of
from ..session import materialize, scratch_dir
from ..sources import files
from ..streaming import runlog as stream
from .bindings import ALERTS_SQL, CALLS_SQL, FRAME_SQL, PUBLISHED_SQL, SEED, TYPES_SQL, alerts, calls, frame, judged, label_sql, published, rule_types, serial_sql
from .training import UID_SQL, table

QUERIES: dict = {}
SQL: dict[str, str] = {}

RATES = ["tpr", "fpr", "precision", "f1"]
_C = {
    "tp": "coalesce(sum(w) FILTER (truth = 'Attack' AND e = 'Attack'), 0.0)", "fp": "coalesce(sum(w) FILTER (truth = 'Non-Attack' AND e = 'Attack'), 0.0)",
    "tn": "coalesce(sum(w) FILTER (truth = 'Non-Attack' AND e = 'Non-Attack'), 0.0)", "fn": "coalesce(sum(w) FILTER (truth = 'Attack' AND e = 'Non-Attack'), 0.0)",
}


def query(sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, because their sums depend on the order of addition."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def confusion_sql(source: str, by: str, weight: str = "1.0", invalid: str = "failure") -> str:
    eff = "coalesce(pred, CASE truth WHEN 'Attack' THEN 'Non-Attack' ELSE 'Attack' END)" if invalid == "failure" else "pred"
    return f"""SELECT {by}, {", ".join(f"{v} AS {k}" for k, v in _C.items())}, count(e) AS n, count(*) FILTER (pred IS NULL) AS n_invalid
        FROM (SELECT *, {weight} AS w, {eff} AS e FROM {source}) GROUP BY {by}"""


def rates_sql(counts: str, by: str) -> str:
    r = lambda x, n: f"round({x}, 6) AS {n}"
    cols = [r(c, c) for c in ("tp", "fp", "tn", "fn")] + ["n", "n_invalid"]
    tpr, fpr = "CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END", "CASE WHEN fp + tn > 0 THEN fp / (fp + tn) END"
    cols += [r(tpr, "tpr"), r(fpr, "fpr"), r("CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END", "precision"), r("CASE WHEN tp = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END", "f1")]
    cols += [r(f"(({tpr}) + 1 - ({fpr})) / 2", "balanced_accuracy")]
    return f"SELECT {by}, {', '.join(cols)} FROM ({counts})"


ZERO = {
    "tpr": "CASE WHEN tp + fn <> 0 THEN tp / (tp + fn) ELSE 0 END", "fpr": "CASE WHEN fp + tn <> 0 THEN fp / (fp + tn) ELSE 0 END",
    "precision": "CASE WHEN tp + fp <> 0 THEN tp / (tp + fp) ELSE 0 END",
}
ZERO["f1"] = f"CASE WHEN ({ZERO['precision']}) + ({ZERO['tpr']}) <> 0 THEN 2 * ({ZERO['precision']}) * ({ZERO['tpr']}) / (({ZERO['precision']}) + ({ZERO['tpr']})) ELSE 0 END"
FOLDS_SQL = f"fo AS (SELECT *, CAST((row_number() OVER (ORDER BY sha256('{SEED}|' || uid), uid) - 1) % 5 AS INTEGER) AS fold FROM fr)"
CROSS_SQL = """cf AS (
  SELECT t.*, CASE WHEN s.share >= 0.5 THEN 'Attack' ELSE 'Non-Attack' END AS pred, coalesce(s.share, b.base) AS score, s.share IS NOT NULL AS seen, t.label AS truth
  FROM fo t LEFT JOIN (SELECT f.fold, coalesce(o.rule_name, '') AS r, avg(CASE WHEN o.label = 'Attack' THEN 1.0 ELSE 0.0 END) AS share
    FROM (SELECT DISTINCT fold FROM fo) f JOIN fo o ON o.fold <> f.fold GROUP BY 1, 2) s ON s.fold = t.fold AND s.r = coalesce(t.rule_name, '')
  JOIN (SELECT f.fold, avg(CASE WHEN o.label = 'Attack' THEN 1.0 ELSE 0.0 END) AS base FROM (SELECT DISTINCT fold FROM fo) f JOIN fo o ON o.fold <> f.fold GROUP BY 1) b ON b.fold = t.fold)"""


def cv_sql(seed: int, grouped: bool, n: int) -> str:
    """FOLDS_SQL (or its grouped twin) and CROSS_SQL for a seed, as CTEs gr<n>, fo<n> and cf<n>."""
    folds = _GROUPED if grouped else FOLDS_SQL
    text = f"{folds}, {CROSS_SQL}".replace(f"'{SEED}|'", f"'{seed}|'")
    return re.sub(r"\b(gr|fo|cf)\b", rf"\g<1>{n}", text)


_GROUPED = f"""gr AS (SELECT rule_name, CAST((row_number() OVER (ORDER BY sha256('{SEED}|' || coalesce(rule_name, '')), rule_name NULLS FIRST) - 1) % 5 AS INTEGER) AS fold FROM (SELECT DISTINCT rule_name FROM fr)),
  fo AS (SELECT fr.*, gr.fold FROM fr JOIN gr ON gr.rule_name IS NOT DISTINCT FROM fr.rule_name)"""


def cross_fitted(spark: SparkSession, d: str) -> DataFrame:
    folds = sampling.random_folds(frame(spark, d), "uid", 5, SEED)
    return models.cross_fit_rule_majority(folds).withColumn("truth", F.col("label"))


# -- flagship ---------------------------------------------------------------------------------------------------------


@query(f"WITH {FRAME_SQL}, {FOLDS_SQL}, {CROSS_SQL} " + rates_sql(confusion_sql("cf", "stratum"), "stratum"))
def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Dedupe, drop conflicts, fit the rule model out of fold, weighted confusion and rates by stratum."""
    return rounded(metrics.hard_metrics(cross_fitted(spark, d), ["stratum"]))


# -- frame ------------------------------------------------------------------------------------------------------------


@query(f"WITH {ALERTS_SQL}, {TYPES_SQL} SELECT * FROM rt")
def a1_labels_per_rule(spark: SparkSession, d: str) -> DataFrame:
    return fr.labels_per_rule(alerts(spark, d))


@query(f"WITH {FRAME_SQL} SELECT * FROM fr")
def a2_frame(spark: SparkSession, d: str) -> DataFrame:
    return fr.build_frame(alerts(spark, d))


@query(f"WITH {ALERTS_SQL} SELECT key, substr(key, 1, 16) AS uid, count(*) AS n_duplicates FROM al GROUP BY key HAVING count(DISTINCT label) > 1")
def a2_conflicts(spark: SparkSession, d: str) -> DataFrame:
    return fr.build_frame(alerts(spark, d), keep_conflicts=True)


@query(f"WITH {FRAME_SQL} SELECT uid, count(DISTINCT key) AS n_keys FROM fr GROUP BY uid HAVING count(DISTINCT key) > 1")
def uid_collisions(spark: SparkSession, d: str) -> DataFrame:
    return fr.uid_collisions(fr.build_frame(alerts(spark, d)))


@query(f"WITH {FRAME_SQL} SELECT stratum, label, count(*) AS n, round(2.0 * count(*) / sum(count(*)) OVER (PARTITION BY label), 6) AS weight FROM fr GROUP BY stratum, label")
def a12_weights(spark: SparkSession, d: str) -> DataFrame:
    return rounded(fr.inverse_probability_weights(fr.build_frame(alerts(spark, d))))


@query(f"""WITH {FRAME_SQL}, g AS (SELECT grouping(stratum) AS o, stratum AS s, rule_name AS r, count(*) AS c FROM fr GROUP BY GROUPING SETS ((rule_name), (stratum, rule_name))),
  t AS (SELECT *, row_number() OVER (PARTITION BY o, s ORDER BY c DESC, r) AS k, sum(c) OVER (PARTITION BY o, s) AS n, count(*) OVER (PARTITION BY o, s) AS n_rules FROM g)
  SELECT CASE WHEN o = 1 THEN 'all' ELSE s END AS stratum, n::BIGINT AS n, n_rules, r AS top_rule, c AS top_n, round(100.0 * c / n, 1) AS top_percent FROM t WHERE k = 1""")
def a13_concentration(spark: SparkSession, d: str) -> DataFrame:
    return fr.concentration(frame(spark, d))


@query(f"WITH {ALERTS_SQL} SELECT count(*) AS duplicate_keys, coalesce(sum(c), 0)::BIGINT AS rows_in_groups FROM (SELECT count(*) AS c FROM al GROUP BY key HAVING count(*) > 1)")
def a14_duplicate_stats(spark: SparkSession, d: str) -> DataFrame:
    return fr.duplicate_stats(alerts(spark, d))


# -- metrics ----------------------------------------------------------------------------------------------------------

for _policy in metrics.INVALID_POLICIES:

    def _f(spark: SparkSession, d: str, policy: str = _policy) -> DataFrame:
        return metrics.confusion(judged(spark, d), ["model"], None, policy)

    _f.__name__ = f"a4_confusion_{_policy}"
    query(f"WITH {PUBLISHED_SQL} " + confusion_sql("ju", "model", "1.0", _policy))(_f)


@query(f"WITH {PUBLISHED_SQL} " + rates_sql(confusion_sql("ju", "model, split"), "model, split"))
def a7_hard_metrics(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.hard_metrics(judged(spark, d), ["model", "split"]))


@query(f"WITH {PUBLISHED_SQL} SELECT model, tp, fp, tn, fn, n, n_invalid, " + ", ".join(f"round({v}, 6) AS {k}" for k, v in ZERO.items()) + f" FROM ({confusion_sql('ju', 'model', '1.0', 'exclude')})")
def a6_zero_rates(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.zero_rates(metrics.confusion(judged(spark, d), ["model"], None, "exclude")))


@query(f"WITH {FRAME_SQL}, {FOLDS_SQL}, {CROSS_SQL}, cw AS (SELECT c.*, w.weight AS wt FROM cf c JOIN (SELECT stratum, 2.0 * count(*) / sum(count(*)) OVER (PARTITION BY label) AS weight FROM fr GROUP BY stratum, label) w USING (stratum)) "
       + rates_sql(confusion_sql("cw", "rule_type", "wt"), "rule_type"))
def a5_weighted_rates(spark: SparkSession, d: str) -> DataFrame:
    scored = materialize(cross_fitted(spark, d), "scored")
    weighted = scored.join(F.broadcast(fr.inverse_probability_weights(scored).select("stratum", "weight")), "stratum")  # four rows
    return rounded(metrics.hard_metrics(weighted, ["rule_type"], "weight"))


@query(f"WITH {PUBLISHED_SQL} SELECT model, split, round(count(pred) / count(*), 6) AS coverage FROM ju GROUP BY model, split")
def a8_coverage(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.valid_coverage(judged(spark, d), ["model", "split"]))


def auroc_sql(source: str, by: str, score: str = "score", weight: str = "1.0", name: str = "auroc") -> str:
    return f"""(WITH p AS (SELECT {by}, {score} AS s, sum(CASE WHEN truth = 'Attack' THEN {weight} ELSE 0 END) AS pos, sum(CASE WHEN truth = 'Attack' THEN 0 ELSE {weight} END) AS neg
      FROM {source} GROUP BY {by}, {score}), c AS (SELECT *, sum(neg) OVER (PARTITION BY {by} ORDER BY s) AS cum FROM p)
      SELECT {by}, CASE WHEN sum(pos) * sum(neg) > 0 THEN sum(pos * (cum - neg / 2)) / (sum(pos) * sum(neg)) END AS {name} FROM c GROUP BY {by})"""


@query(f"WITH {FRAME_SQL}, {FOLDS_SQL}, {CROSS_SQL} SELECT rule_type, round(auroc, 6) AS auroc FROM {auroc_sql('cf', 'rule_type')}")
def a9_auroc(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.auroc(cross_fitted(spark, d), ["rule_type"]))


_FILL = "coalesce(score, CASE WHEN truth = 'Attack' THEN {}.0 ELSE {}.0 END)"


@query(f"""WITH {CALLS_SQL}, co AS (SELECT day, count(*) AS n, count(score) AS n_available FROM ca GROUP BY day)
  SELECT day, n, n_available, round(n_available / n, 6) AS coverage, round(auroc, 6) AS auroc, round(lower, 6) AS lower, round(upper, 6) AS upper FROM co
  LEFT JOIN {auroc_sql('(SELECT * FROM ca WHERE score IS NOT NULL)', 'day')} USING (day)
  LEFT JOIN {auroc_sql('ca', 'day', _FILL.format(0, 1), '1.0', 'lower')} USING (day) LEFT JOIN {auroc_sql('ca', 'day', _FILL.format(1, 0), '1.0', 'upper')} USING (day)""")
def a10_auroc_bounds(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.auroc_bounds(calls(spark, d), ["day"]))


@query(f"""WITH {CALLS_SQL} SELECT 'truth' AS grouping, truth AS value, count(*) AS n, count(*) FILTER (pred IS NULL) AS invalid, round(count(*) FILTER (pred IS NULL) / count(*), 6) AS invalid_rate,
  count(score) AS score_available, round(count(score) / count(*), 6) AS score_coverage FROM ca GROUP BY truth UNION ALL
  SELECT 'day', day, count(*), count(*) FILTER (pred IS NULL), round(count(*) FILTER (pred IS NULL) / count(*), 6), count(score), round(count(score) / count(*), 6) FROM ca GROUP BY day""")
def a15_cells(spark: SparkSession, d: str) -> DataFrame:
    return rounded(reports.grouped_cells(calls(spark, d), ["truth", "day"]))


@query(f"""WITH {CALLS_SQL} SELECT 'error' AS counter, error AS value, count(*) AS n FROM ca GROUP BY error UNION ALL SELECT 'pred', pred, count(*) FROM ca GROUP BY pred
  UNION ALL SELECT 'raw', raw, count(*) FROM ca GROUP BY raw UNION ALL SELECT 'truth', truth, count(*) FROM ca GROUP BY truth""")
def a16_counters(spark: SparkSession, d: str) -> DataFrame:
    return runlog.counters(calls(spark, d), ["error", "pred", "raw", "truth"])


@query(f"""WITH {CALLS_SQL} SELECT day, count(*) AS n, round(avg(seconds), 4) AS mean, round(median(seconds), 4) AS median, round(min(seconds), 4) AS least, round(max(seconds), 4) AS most,
  round(quantile_cont(seconds, 0.95), 4) AS p95, round(avg(seconds) * 3000 / 3600, 4) AS projected_hours FROM ca WHERE seconds IS NOT NULL AND NOT isnan(seconds) GROUP BY day""")
def a17_latency(spark: SparkSession, d: str) -> DataFrame:
    return rounded(reports.latency_stats(calls(spark, d), ["day"], "seconds", 3000), 4)


@query(f"""WITH {CALLS_SQL}, v AS (SELECT seconds AS v, row_number() OVER (ORDER BY seconds) - 1 AS k, count(*) OVER () AS n FROM ca WHERE seconds IS NOT NULL AND NOT isnan(seconds))
  SELECT 'median_upper' AS statistic, n, v AS element FROM v WHERE k = n // 2 UNION ALL SELECT 'p95_rank', n, v FROM v WHERE k = floor(n * 0.95)::BIGINT""")
def a17_rank_elements(spark: SparkSession, d: str) -> DataFrame:
    c = calls(spark, d)
    at = {"median_upper": lambda n: F.floor(n / 2), "p95_rank": lambda n: F.floor(n * 0.95)}
    parts = [reports.rank_element(c, "seconds", f).select(F.lit(k).alias("statistic"), "n", "element") for k, f in at.items()]
    return parts[0].unionByName(parts[1])


@query(f"WITH {PUBLISHED_SQL} SELECT count(*) + 1 AS n_systems, " + ", ".join(f"round((sum({k}) + 0.5) / (count(*) + 1), 6) AS {k}" for k in RATES)
       + f" FROM (SELECT model, {', '.join(f'{v} AS {k}' for k, v in ZERO.items())} FROM ({confusion_sql('ju', 'model', '1.0', 'exclude')}))")
def a18_macro_average(spark: SparkSession, d: str) -> DataFrame:
    per_model = metrics.zero_rates(metrics.confusion(judged(spark, d), ["model"], None, "exclude"))
    return rounded(metrics.macro_average(per_model, RATES, [dict.fromkeys(RATES, 0.5)]))


@query(f"WITH {ALERTS_SQL}, {TYPES_SQL}, {PUBLISHED_SQL}, sl AS (SELECT ju.* FROM ju SEMI JOIN (SELECT * FROM rt WHERE rule_type = 'mixed') m ON m.rule_name = ju.rule_name WHERE pred IS NOT NULL) "
       + "SELECT model, n, " + ", ".join(f"round({v}, 6) AS {k}" for k, v in ZERO.items()) + f" FROM ({confusion_sql('sl', 'model', '1.0', 'exclude')})")
def a19_mixed_slice(spark: SparkSession, d: str) -> DataFrame:
    mixed = rule_types(spark, d).filter("rule_type = 'mixed'")
    rows = judged(spark, d).filter("pred is not null").join(mixed, "rule_name", "left_semi")
    return rounded(metrics.zero_rates(metrics.confusion(rows, ["model"], None, "exclude")).select("model", "n", *RATES))


@query(f"""WITH {CALLS_SQL} SELECT day, max(prompt_tokens) AS longest, count(*) FILTER (prompt_tokens > 4000) AS over_limit FROM ca GROUP BY day""")
def a21_over_limit(spark: SparkSession, d: str) -> DataFrame:
    return reports.over_limit(calls(spark, d), ["day"], "prompt_tokens", 4000)


@query(" UNION ALL ".join(f"SELECT '{c}' AS column_name, CASE WHEN {c} IS NULL THEN 'null' ELSE '{'int' if c in ('dport', 'sport') else 'string'}' END AS value_type, count(*) AS n FROM secalertbench GROUP BY 2" for c in FIELD_ORDER))
def a22_value_types(spark: SparkSession, d: str) -> DataFrame:
    return reports.value_types(table(spark, d, "secalertbench"), list(FIELD_ORDER))


@query(f"WITH {ALERTS_SQL} " + " UNION ALL ".join(
    f"SELECT '{c}' AS condition, label, count(*) AS n, count(*) FILTER (contains(lower(concat_ws(chr(10), {', '.join(fields_of(c))})), 'attack')) AS n_with_word FROM al GROUP BY label" for c in CONDITIONS))
def a22_keyword_by_condition(spark: SparkSession, d: str) -> DataFrame:
    a = alerts(spark, d)
    texts = F.array(*[F.struct(F.lit(c).alias("condition"), F.concat_ws("\n", *[F.col(f).cast("string") for f in fields_of(c)]).alias("text")) for c in CONDITIONS])
    return reports.keyword_counts(a.select("label", F.explode(texts).alias("x")).select("label", "x.*"), ["condition", "label"], "text", "attack")


@query(f"""WITH {PUBLISHED_SQL}, a AS (SELECT model, {', '.join(f'round({v}, 6) AS {k}' for k, v in ZERO.items())} FROM ({confusion_sql('ju', 'model', '1.0', 'exclude')})),
  b AS (SELECT model, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END, 6) AS tpr, round(CASE WHEN tp = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END, 6) AS f1 FROM ({confusion_sql('ju', 'model')}))
  SELECT model, 'tpr' AS column_name, b.tpr AS reported, a.tpr AS recomputed, a.tpr IS NOT DISTINCT FROM b.tpr AS same FROM a JOIN b USING (model)
  UNION ALL SELECT model, 'f1', b.f1, a.f1, a.f1 IS NOT DISTINCT FROM b.f1 FROM a JOIN b USING (model)""")
def a24_reported_vs_recomputed(spark: SparkSession, d: str) -> DataFrame:
    """The primary metrics as the reported ones, the other family's as recomputed: they differ where answers are invalid."""
    j = judged(spark, d)
    other = metrics.zero_rates(metrics.confusion(j, ["model"], None, "exclude"))
    return reports.reported_vs_recomputed(metrics.hard_metrics(j, ["model"]), other, "model", ["tpr", "f1"])


# -- models -----------------------------------------------------------------------------------------------------------


@query(f"""WITH {FRAME_SQL} SELECT rule_name, count(*) AS n, round(avg(CASE WHEN label = 'Attack' THEN 1.0 ELSE 0 END), 6) AS share,
  round((SELECT avg(CASE WHEN label = 'Attack' THEN 1.0 ELSE 0 END) FROM fr), 6) AS base_rate FROM fr GROUP BY rule_name""")
def a3_rule_majority(spark: SparkSession, d: str) -> DataFrame:
    return rounded(models.fit_rule_majority(frame(spark, d)))


@query(f"WITH {FRAME_SQL}, {PUBLISHED_SQL} SELECT fr.* FROM fr ANTI JOIN pu ON pu.key = fr.key")
def j3_training_set(spark: SparkSession, d: str) -> DataFrame:
    return models.training_set(frame(spark, d), published(spark, d))


@query(f"""WITH {FRAME_SQL}, {PUBLISHED_SQL}, tr AS (SELECT fr.* FROM fr ANTI JOIN pu ON pu.key = fr.key),
  m AS (SELECT rule_name, avg(CASE WHEN label = 'Attack' THEN 1.0 ELSE 0 END) AS share FROM tr GROUP BY rule_name)
  SELECT pred_id, CASE WHEN m.share >= 0.5 THEN 'Attack' ELSE 'Non-Attack' END AS pred, round(coalesce(m.share, (SELECT avg(CASE WHEN label = 'Attack' THEN 1.0 ELSE 0 END) FROM tr)), 6) AS score,
    m.share IS NOT NULL AS seen FROM pu LEFT JOIN m ON m.rule_name IS NOT DISTINCT FROM pu.rule_name""")
def j7_rule_predictions(spark: SparkSession, d: str) -> DataFrame:
    test = published(spark, d).select("pred_id", "key", "rule_name")
    train = models.training_set(frame(spark, d), test)
    return rounded(models.predict_rule_majority(models.fit_rule_majority(train), test).select("pred_id", "pred", "score", "seen"))


@query(f"WITH {PUBLISHED_SQL} " + rates_sql(confusion_sql("(SELECT model, truth, 'Attack' AS pred FROM ju)", "model"), "model"))
def m5_always_attack(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.hard_metrics(models.always_attack(judged(spark, d)), ["model"]))


@query(" UNION ALL ".join(
    f"SELECT doc_id, {n} AS n, greatest(length(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r][ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) - {n - 1}, 0) AS n_grams FROM documents WHERE text IS NOT NULL" for n in (3, 4, 5)))
def m1_gram_counts(spark: SparkSession, d: str) -> DataFrame:
    """Character 3-, 4- and 5-grams of every text."""
    grams = models.with_char_ngrams(table(spark, d, "documents").filter("text is not null").select("doc_id", "text"))
    each = grams.select("doc_id", F.explode(F.array(*[F.lit(n) for n in (3, 4, 5)])).alias("n"), "grams")
    return each.select("doc_id", "n", F.size(F.filter("grams", lambda g: F.length(g) == F.col("n"))).alias("n_grams"))


@query()
def m4_tfidf(spark: SparkSession, d: str) -> DataFrame:
    """Hashed n-gram TF-IDF and logistic regression per condition, each of five folds of rules scored by the fit on the others."""
    folds = sampling.grouped_folds(frame(spark, d), "rule_name", 5, SEED)
    a = alerts(spark, d)
    kinds = dict(a.dtypes)
    texts = a.select("row_index", *[classifier_text(fields_of(c), kinds).alias(f"text_{c}") for c in CONDITIONS])
    rows = materialize(folds.join(texts, "row_index").select("uid", "label", "fold", *[f"text_{c}" for c in CONDITIONS]), "texts")
    scored = [models.cross_fit_tfidf(rows.select("uid", "label", "fold", F.col(f"text_{c}").alias("text"))).withColumn("condition", F.lit(c)) for c in CONDITIONS]
    return reduce(DataFrame.unionByName, scored).select("uid", "condition", "fold", "label", "score", "pred")


# -- joins and audits -------------------------------------------------------------------------------------------------


@query(f"""WITH {ALERTS_SQL}, {PUBLISHED_SQL}, k AS (SELECT key, count(*) AS n, min(label) AS l1, max(label) AS l2, min(coalesce(rule_name, '')) AS r1, max(coalesce(rule_name, '')) AS r2 FROM al GROUP BY key)
  SELECT model, count(*) AS n_rows, count(*) FILTER (k.n IS NULL) AS unmatched, count(*) FILTER (k.n > 1) AS ambiguous, count(*) FILTER (l1 <> truth OR l2 <> truth) AS label_conflict,
    count(*) FILTER (r1 <> coalesce(rule_name, '') OR r2 <> coalesce(rule_name, '')) AS rule_conflict FROM ju LEFT JOIN k USING (key) GROUP BY model""")
def j1_content_match(spark: SparkSession, d: str) -> DataFrame:
    a = fr.content_key()
    return audit.content_match(judged(spark, d), alerts(spark, d).select(a.alias("key"), "label", "rule_name"), ["model"])


@query(f"WITH {FRAME_SQL}, {PUBLISHED_SQL} SELECT pred_id, key IN (SELECT key FROM fr) AS matched FROM pu")
def j2_matched(spark: SparkSession, d: str) -> DataFrame:
    return audit.matched_flag(published(spark, d).select("pred_id", "key"), frame(spark, d)).select("pred_id", "matched")


@query("SELECT s.sample_id, b.uid, b.rule_name, b.attack_type FROM dryrun_sample s JOIN secalertbench b USING (row_index)")
def j5_position_lookup(spark: SparkSession, d: str) -> DataFrame:
    data = table(spark, d, "secalertbench").select("row_index", "uid", "rule_name", "attack_type")
    return table(spark, d, "dryrun_sample").select("sample_id", "row_index").join(data, "row_index").drop("row_index")


_SPLITS = ["test", "train", "validation"]


@query(f"""WITH {PUBLISHED_SQL}, l AS (SELECT uid, split, length(uri) AS v FROM pu), w AS (SELECT uid, {", ".join(f"max(v) FILTER (split = '{s}') AS {s}" for s in _SPLITS)} FROM l GROUP BY uid)
  SELECT *, greatest({", ".join(_SPLITS)}) AS longest, {" AND ".join(f"{s} IS NOT NULL" for s in _SPLITS)} AS complete FROM w""")
def j6_completeness(spark: SparkSession, d: str) -> DataFrame:
    lengths = published(spark, d).select("uid", "split", F.length("uri").alias("v"))
    return audit.complete_lengths(lengths, "uid", "split", "v", _SPLITS)


@query(f"""WITH {FRAME_SQL}, p AS (SELECT uid, row_number() OVER (ORDER BY sha256('{SEED}|' || uid), uid) - 1 AS position FROM fr)
  SELECT uid, position, c.condition, position * 3 + c.k AS call_position FROM p CROSS JOIN (VALUES ('a', 0), ('b', 1), ('c', 2)) c(condition, k)""")
def j8_call_order(spark: SparkSession, d: str) -> DataFrame:
    return sampling.call_order(frame(spark, d).select("uid"), "uid", SEED, list(CONDITIONS))


def _runs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The first and the last call of every alert, as two runs."""
    c = calls(spark, d)
    pick = lambda f: c.groupBy("uid").agg(f(F.struct("pred", "score"), "i").alias("x")).select("uid", "x.*")
    return pick(F.min_by), pick(F.max_by)


@query(f"""WITH {CALLS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY i) AS f, row_number() OVER (PARTITION BY uid ORDER BY i DESC) AS l FROM ca)
  SELECT count(*) AS paired, count(*) FILTER (a.pred IS NOT DISTINCT FROM b.pred) AS identical_labels, count(*) FILTER ((a.score IS NULL) = (b.score IS NULL)) AS availability_identical,
    count(a.score + b.score) AS scores_compared, round(max(abs(a.score - b.score)), 6) AS max_abs_delta FROM r a JOIN r b ON a.uid = b.uid AND a.f = 1 AND b.l = 1""")
def j9_compare_runs(spark: SparkSession, d: str) -> DataFrame:
    first, last = _runs(spark, d)
    return rounded(audit.compare_runs(first, last, ["uid"], "pred", "score"))


def _log(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """expected: the alerts; attempts: every call; log: calls that ended without an error."""
    data = table(spark, d, "secalertbench").filter("uid is not null").withColumn("attack_type", F.coalesce("attack_type", F.lit("")))
    expected = data.groupBy(F.col("uid").alias("call_id")).agg(F.min("row_index").alias("row_index"), F.min("attack_type").alias("attack_type"), F.min(F.coalesce("rule_name", F.lit(""))).alias("rule_name"))
    raw = table(spark, d, "throughput_qwen3_4b").filter("uid is not null").withColumn("status", F.when(F.col("error").isNull(), "ok").otherwise("error"))
    attempts = raw.select(F.col("uid").alias("call_id"), F.col("i").alias("attempt"), "status")
    done = raw.filter("status = 'ok'").select(F.col("uid").alias("call_id"))
    return expected, attempts, done


_LOG_SQL = """ex AS (SELECT uid AS call_id, min(row_index) AS row_index, min(coalesce(attack_type, '')) AS attack_type, min(coalesce(rule_name, '')) AS rule_name FROM secalertbench WHERE uid IS NOT NULL GROUP BY uid),
  atm AS (SELECT uid AS call_id, i AS attempt, CASE WHEN error IS NULL THEN 'ok' ELSE 'error' END AS status FROM throughput_qwen3_4b WHERE uid IS NOT NULL),
  dn AS (SELECT call_id FROM atm WHERE status = 'ok'),
  la AS (SELECT call_id, count(*) AS n_attempts, count(*) FILTER (status = 'ok') AS n_ok, arg_max(status, attempt) AS final_status FROM atm GROUP BY call_id)"""


@query(f"""WITH {_LOG_SQL}, c AS (SELECT call_id, count(*) AS c FROM dn GROUP BY call_id), j AS (
    SELECT ex.call_id AS e, c.c AS c, la.n_attempts AS a, la.n_ok AS ok FROM ex FULL JOIN c ON ex.call_id = c.call_id FULL JOIN la ON la.call_id = coalesce(ex.call_id, c.call_id))
  SELECT count(e) AS expected, count(c) AS done, count(*) FILTER (e IS NOT NULL AND c IS NULL) AS missing, count(*) FILTER (e IS NULL AND c IS NOT NULL) AS unexpected, count(*) FILTER (c > 1) AS duplicates,
    count(*) FILTER (a IS NOT NULL AND c IS NULL) AS failed, count(*) FILTER (c IS NOT NULL AND coalesce(ok, 0) = 0) AS no_attempt, count(*) FILTER (ok > 1) AS resent FROM j""")
def j10_reconcile(spark: SparkSession, d: str) -> DataFrame:
    expected, attempts, done = _log(spark, d)
    return runlog.reconcile(expected, done, attempts)


@query(f"""WITH {PUBLISHED_SQL} """ + " UNION ALL ".join(
    f"""SELECT '{c}' AS column_name, count(*) AS n_test_values, count(*) FILTER (i) AS n_overlap, coalesce(sum(n) FILTER (NOT i), 0)::BIGINT AS n_absent_rows
      FROM (SELECT x.{c}, x.n, EXISTS (SELECT 1 FROM pu t WHERE t.split = 'train' AND t.{c} IS NOT DISTINCT FROM x.{c}) AS i FROM (SELECT {c}, count(*) AS n FROM pu WHERE split = 'test' GROUP BY {c}) x)""" for c in ("key", "rule_name", "uid")))
def j11_split_audit(spark: SparkSession, d: str) -> DataFrame:
    p = published(spark, d)
    return audit.split_audit(p.filter("split = 'train'"), p.filter("split = 'test'"), ["key", "rule_name", "uid"])


@query(f"""WITH {PUBLISHED_SQL}, k AS (SELECT key, count(DISTINCT model) AS k FROM pu GROUP BY key)
  SELECT (SELECT count(DISTINCT model) FROM pu) AS n_groups, count(*) FILTER (k = (SELECT count(DISTINCT model) FROM pu)) AS in_all, count(*) AS in_any FROM k""")
def set_intersection_union(spark: SparkSession, d: str) -> DataFrame:
    return audit.set_report(published(spark, d), "key", "model")


@query(f"""WITH {PUBLISHED_SQL} SELECT model, count(DISTINCT key) AS n_common FROM pu WHERE key IN (SELECT key FROM pu WHERE model = (SELECT min(model) FROM pu)) GROUP BY model""")
def set_overlap_with_first(spark: SparkSession, d: str) -> DataFrame:
    return audit.overlap_with(published(spark, d), "key", "model")


@query(f"""WITH a AS (SELECT {UID_SQL.format('uid')} AS uid FROM dryrun_sample), b AS (SELECT {UID_SQL.format('uid')} AS uid FROM shared_sample)
  SELECT *, only_a = 0 AND only_b = 0 AS same FROM (SELECT count(*) AS only_a FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)), (SELECT count(*) AS only_b FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a))""")
def set_difference(spark: SparkSession, d: str) -> DataFrame:
    one = lambda t: table(spark, d, t).select(uid_form(F.col("uid")).alias("uid"))
    return audit.same_rows(one("dryrun_sample"), one("shared_sample"))


@query("""SELECT 'dryrun_sample' AS manifest, sample_id, uid, stratum, split FROM dryrun_sample UNION ALL SELECT 'shared_sample', sample_id, uid, stratum, NULL FROM shared_sample""")
def set_concatenate(spark: SparkSession, d: str) -> DataFrame:
    both = audit.concatenated({n: table(spark, d, n) for n in ("dryrun_sample", "shared_sample")})
    return both.select("manifest", "sample_id", "uid", "stratum", "split")


# -- sampling and folds -----------------------------------------------------------------------------------------------

_DRAW = "row_number() OVER (PARTITION BY {} ORDER BY sha256('{}|' || uid), uid)"


@query(f"WITH {FRAME_SQL} SELECT uid, stratum, label, row_index FROM fr QUALIFY {_DRAW.format('stratum', SEED)} <= 50")
def r1_stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    return sampling.stratified_sample(frame(spark, d), "stratum", "uid", 50, SEED).select("uid", "stratum", "label", "row_index")


@query(f"""WITH {FRAME_SQL}, a AS (SELECT uid, stratum FROM fr QUALIFY {_DRAW.format('stratum', SEED)} <= 10), r AS (SELECT * FROM fr ANTI JOIN a USING (uid)),
  b AS (SELECT uid, stratum FROM r QUALIFY {_DRAW.format('stratum', SEED + 1)} <= 40) SELECT uid, stratum, 'first' AS phase FROM a UNION ALL SELECT uid, stratum, 'second' FROM b""")
def r2_two_phase(spark: SparkSession, d: str) -> DataFrame:
    return sampling.two_phase_sample(frame(spark, d), "stratum", "uid", 10, 40, SEED).select("uid", "stratum", "phase")


@query(f"""WITH {FRAME_SQL}, s AS (SELECT uid, label FROM fr QUALIFY {_DRAW.format('label', SEED)} <= 100)
  SELECT uid, label, row_number() OVER (ORDER BY sha256('{SEED + 1}|' || uid), uid) - 1 AS position FROM s""")
def r3_class_balanced(spark: SparkSession, d: str) -> DataFrame:
    """As many of each class, then all of them shuffled."""
    drawn = sampling.stratified_sample(frame(spark, d), "label", "uid", 100, SEED, strict=False).select("uid", "label")
    return sampling.permutation(drawn, "uid", SEED + 1)


@query(f"WITH {FRAME_SQL} SELECT uid, row_number() OVER (ORDER BY sha256('{SEED}|' || uid), uid) - 1 AS position FROM fr")
def r4_permutation(spark: SparkSession, d: str) -> DataFrame:
    return sampling.permutation(frame(spark, d).select("uid"), "uid", SEED)


REPS = 2000


def _mult_sql(units: str, unit: str, group: str) -> str:
    return f"""rk AS (SELECT *, {group} AS g, row_number() OVER (PARTITION BY {group} ORDER BY {unit}) AS rank, count(*) OVER (PARTITION BY {group}) AS size FROM {units}),
      dr AS (SELECT b.rep, g, ('0x' || substr(md5('{SEED}|' || b.rep || '|' || g || '|' || rank), 1, 8))::BIGINT % size + 1 AS rank
        FROM rk CROSS JOIN (SELECT unnest(range(1, {REPS + 1})) AS rep) b)"""


@query(f"""WITH {FRAME_SQL}, {_mult_sql('fr', 'uid', 'stratum')}, mu AS (SELECT rep, g, rank, count(*) AS m FROM dr GROUP BY ALL)
  SELECT rep, g AS stratum, sum(m)::BIGINT AS n_drawn, count(*) AS n_units, max(m) AS most, sum(m * row_index)::BIGINT AS index_sum FROM mu JOIN rk USING (g, rank) GROUP BY ALL""")
def r5_stratified_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    """All 2,000 replicates, each summed up: draws, distinct units, the unit drawn most often, and a sum that tells who was drawn."""
    f = frame(spark, d)
    reps = bootstrap.multiplicities(f, "uid", "stratum", REPS, SEED, ["stratum", "row_index"])
    return reps.groupBy("rep", "stratum").agg(
        F.sum("m").alias("n_drawn"), F.count(F.lit(1)).alias("n_units"), F.max("m").alias("most"), F.sum(F.col("m") * F.col("row_index")).alias("index_sum")
    )


_CLUSTERS = "cl AS (SELECT coalesce(rule_name, '') AS rule, rule_type, count(*) AS n_rows FROM fr GROUP BY ALL)"


@query(f"""WITH {FRAME_SQL}, {_CLUSTERS}, {_mult_sql('cl', 'rule', 'rule_type')}, mu AS (SELECT rep, g, rank, count(*) AS m FROM dr GROUP BY ALL)
  SELECT rep, g AS rule_type, sum(m)::BIGINT AS n_drawn, count(*) AS n_rules, sum(m * n_rows)::BIGINT AS n_rows FROM mu JOIN rk USING (g, rank) GROUP BY ALL""")
def r6_cluster_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    """All 2,000 replicates of whole rules, each summed up; replicates differ in their number of alerts."""
    units = frame(spark, d).select(F.coalesce("rule_name", F.lit("")).alias("rule"), "rule_type")
    reps = bootstrap.cluster_multiplicities(units, "rule", "rule_type", REPS, SEED)
    per = units.groupBy("rule", "rule_type").agg(F.count(F.lit(1)).alias("n"))
    return reps.join(per, "rule").groupBy("rep", "rule_type").agg(F.sum("m").alias("n_drawn"), F.count(F.lit(1)).alias("n_rules"), F.sum(F.col("m") * F.col("n")).alias("n_rows"))


_SYSTEMS = {"rule_majority": "pred", "always_attack": "always"}
_PAIRS = [("rule_majority", "always_attack")]


def _scored(spark: SparkSession, d: str) -> DataFrame:
    """Two systems on the frame: the out-of-fold rule model and the constant one."""
    s = cross_fitted(spark, d).select("uid", "stratum", F.coalesce("rule_name", F.lit("")).alias("rule"), "rule_type", "truth", "pred", F.lit("Attack").alias("always"))
    return materialize(s, "scored")


def _replicates(spark: SparkSession, d: str) -> DataFrame:
    """F1 of both systems on the same replicates; replicate 0 is the frame itself."""
    cells = bootstrap.weighted_cells(_scored(spark, d), "uid", "stratum", ["truth", "pred", "always"], REPS, SEED)
    return bootstrap.replicate_values(cells, bootstrap.f1_by_system("truth", _SYSTEMS))


_F1 = "CASE WHEN tp = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END AS f1"
_SY = """sy AS (SELECT c.*, 'rule_majority' AS system, pred AS p FROM cf c UNION ALL SELECT c.*, 'always_attack', 'Attack' FROM cf c),
  sq AS (SELECT * EXCLUDE (pred, p), p AS pred FROM sy)"""
_REPS_SQL = f"""{FRAME_SQL}, {FOLDS_SQL}, {CROSS_SQL}, {_SY}, {_mult_sql('fr', 'uid', 'stratum')},
  mu AS (SELECT rep, uid, count(*) AS m FROM dr JOIN rk USING (g, rank) GROUP BY ALL), sm AS (SELECT sq.system, sq.truth, sq.pred, mu.rep, mu.m FROM sq JOIN mu USING (uid)),
  rm AS (SELECT rep, system, {_F1} FROM ({confusion_sql('sm', 'rep, system', 'm::DOUBLE')})), pt AS (SELECT system, {_F1} FROM ({confusion_sql('sq', 'system')}))"""
_CI = "round(quantile_cont(f1, 0.025), 6) AS lo, round(quantile_cont(f1, 0.975), 6) AS hi, count(*) FILTER (f1 IS NULL) AS n_undefined"


@query(f"WITH {_REPS_SQL} SELECT system, round((SELECT f1 FROM pt WHERE pt.system = rm.system), 6) AS point, {_CI} FROM rm GROUP BY system")
def a11_percentile_ci(spark: SparkSession, d: str) -> DataFrame:
    return rounded(bootstrap.intervals(_replicates(spark, d), ["system"]))


@query(f"WITH {_REPS_SQL} SELECT a.rep, a.system AS a, b.system AS b, round(a.f1 - b.f1, 6) AS difference FROM rm a JOIN rm b ON a.rep = b.rep AND a.system = 'rule_majority' AND b.system = 'always_attack'")
def r7_paired_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    return rounded(bootstrap.paired_differences(_replicates(spark, d).filter("rep > 0"), "system", "value", _PAIRS))


@query(f"""WITH {_REPS_SQL}, df AS (SELECT a.f1 - b.f1 AS f1 FROM rm a JOIN rm b ON a.rep = b.rep AND a.system = 'rule_majority' AND b.system = 'always_attack')
  SELECT 'rule_majority' AS a, 'always_attack' AS b, round((SELECT f1 FROM pt WHERE system = 'rule_majority') - (SELECT f1 FROM pt WHERE system = 'always_attack'), 6) AS point, {_CI} FROM df""")
def r7_difference_interval(spark: SparkSession, d: str) -> DataFrame:
    diffs = bootstrap.paired_differences(_replicates(spark, d), "system", "value", _PAIRS)
    return rounded(bootstrap.intervals(diffs.withColumnRenamed("difference", "value"), ["a", "b"]))


@query(f"""WITH {FRAME_SQL}, {FOLDS_SQL}, {CROSS_SQL}, {_SY}, {_CLUSTERS}, {_mult_sql('cl', 'rule', 'rule_type')}, mu AS (SELECT rep, rule, count(*) AS m FROM dr JOIN rk USING (g, rank) GROUP BY ALL),
  ce AS (SELECT coalesce(rule_name, '') AS rule, system, truth, pred, count(*) AS c FROM sq GROUP BY ALL), sm AS (SELECT system, truth, pred, rep, m * c AS m FROM ce JOIN mu USING (rule)),
  rm AS (SELECT rep, system, {_F1} FROM ({confusion_sql('sm', 'rep, system', 'm::DOUBLE')})), pt AS (SELECT system, {_F1} FROM ({confusion_sql('sq', 'system')}))
  SELECT system, round((SELECT f1 FROM pt WHERE pt.system = rm.system), 6) AS point, {_CI} FROM rm GROUP BY system""")
def r6_cluster_interval(spark: SparkSession, d: str) -> DataFrame:
    """The metric over cluster replicates: F1 of both systems where whole rules are drawn within their type."""
    cells = bootstrap.cluster_cells(_scored(spark, d), "rule", "rule_type", ["truth", "pred", "always"], REPS, SEED)
    return rounded(bootstrap.intervals(bootstrap.replicate_values(cells, bootstrap.f1_by_system("truth", _SYSTEMS)), ["system"]))


def _auroc_per_rep(cells: DataFrame) -> DataFrame:
    return metrics.auroc(cells, ["rep"], weight="m").select("rep", F.col("auroc").alias("value"))


@query(f"""WITH {FRAME_SQL}, {FOLDS_SQL}, {CROSS_SQL}, {_mult_sql('fr', 'uid', 'stratum')}, mu AS (SELECT rep, uid, count(*) AS m FROM dr JOIN rk USING (g, rank) GROUP BY ALL),
  sm AS (SELECT rep, truth, score, m FROM cf JOIN mu USING (uid) UNION ALL SELECT 0, truth, score, 1 FROM cf), rm AS (SELECT rep, auroc AS f1 FROM {auroc_sql('sm', 'rep', 'score', 'm::DOUBLE')})
  SELECT round(max(f1) FILTER (rep = 0), 6) AS point, round(quantile_cont(f1, 0.025) FILTER (rep > 0), 6) AS lo, round(quantile_cont(f1, 0.975) FILTER (rep > 0), 6) AS hi, count(*) FILTER (rep > 0 AND f1 IS NULL) AS n_undefined FROM rm""")
def r7_any_statistic(spark: SparkSession, d: str) -> DataFrame:
    """The hook for any statistic, with AUROC: its interval over the stratified replicates."""
    scored = materialize(cross_fitted(spark, d).select("uid", "stratum", "truth", "score"), "scored")
    cells = bootstrap.weighted_cells(scored, "uid", "stratum", ["truth", "score"], REPS, SEED)
    return rounded(bootstrap.intervals(bootstrap.replicate_values(cells, _auroc_per_rep), []))


@query(f"""WITH {CALLS_SQL}, ok AS (SELECT lpad(i::VARCHAR, 12, '0') AS unit, 'all' AS grp, seconds FROM ca WHERE error IS NULL AND seconds IS NOT NULL AND NOT isnan(seconds)), {_mult_sql('ok', 'unit', 'grp')},
  me AS (SELECT rep, avg(seconds) AS mean FROM dr JOIN rk USING (g, rank) GROUP BY rep), se AS (SELECT mean, row_number() OVER (ORDER BY mean) - 1 AS k FROM me)
  SELECT round((SELECT avg(seconds) FROM ok), 6) AS point, round(min(mean), 6) AS lowest, round(max(mean), 6) AS highest, round(quantile_cont(mean, 0.5), 6) AS middle,
    round(max(mean) FILTER (k = 50), 6) AS lower, round(max(mean) FILTER (k = 1949), 6) AS upper FROM se""")
def r8_mean_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    """2,000 replicates of the mean latency; lower and upper are the 51st and the 1,950th of them in order."""
    ok = calls(spark, d).filter("error is null and seconds is not null and not isnan(seconds)")
    units = ok.select(F.lpad(F.col("i").cast("string"), 12, "0").alias("unit"), F.lit("all").alias("grp"), "seconds")
    means = materialize(bootstrap.resample(units, "unit", "grp", ["seconds"], REPS, SEED).groupBy("rep").agg(F.avg("seconds").alias("mean")), "means")
    ends = means.agg(F.min("mean").alias("lowest"), F.max("mean").alias("highest"), F.percentile("mean", 0.5).alias("middle"), F.sort_array(F.collect_list("mean")).alias("_s"))  # one number a replicate
    point = units.agg(F.avg("seconds").alias("point"))
    return rounded(point.crossJoin(ends).select("point", "lowest", "highest", "middle", F.element_at("_s", 51).alias("lower"), F.element_at("_s", 1950).alias("upper")))  # one row each


MODEL_REPS = 300


@query(f"""WITH {FRAME_SQL}, {PUBLISHED_SQL}, tr AS (SELECT fr.* FROM fr ANTI JOIN pu ON pu.key = fr.key), m AS (SELECT rule_name, avg(CASE WHEN label = 'Attack' THEN 1.0 ELSE 0 END) AS share FROM tr GROUP BY rule_name),
  un AS (SELECT model, lpad(pred_id::VARCHAR, 12, '0') AS unit, truth, CASE WHEN m.share >= 0.5 THEN 'Attack' ELSE 'Non-Attack' END AS pred FROM ju LEFT JOIN m ON m.rule_name IS NOT DISTINCT FROM ju.rule_name),
  {_mult_sql('un', 'unit', 'model').replace(str(REPS + 1), str(MODEL_REPS + 1))}, sm AS (SELECT rep, model, truth, pred FROM dr JOIN rk USING (g, rank) UNION ALL SELECT 0, model, truth, pred FROM un),
  pm AS (SELECT rep, avg(f1) AS f1 FROM (SELECT rep, model, {ZERO['f1']} AS f1 FROM ({confusion_sql('sm', 'rep, model')})) GROUP BY rep)
  SELECT round(max(f1) FILTER (rep = 0), 6) AS point, round(quantile_cont(f1, 0.025) FILTER (rep > 0), 6) AS lo, round(quantile_cont(f1, 0.975) FILTER (rep > 0), 6) AS hi, count(*) FILTER (rep > 0 AND f1 IS NULL) AS n_undefined FROM pm""")
def r8_model_f1(spark: SparkSession, d: str) -> DataFrame:
    """300 replicates within every model's rows: the rule model's F1 on each, averaged over the models."""
    test = judged(spark, d).drop("pred")
    model = models.fit_rule_majority(models.training_set(frame(spark, d), published(spark, d)))
    scored = models.predict_rule_majority(model, test).select(F.lpad(F.col("pred_id").cast("string"), 12, "0").alias("unit"), "model", "truth", "pred")
    cells = bootstrap.weighted_cells(materialize(scored, "scored"), "unit", "model", ["model", "truth", "pred"], MODEL_REPS, SEED)

    def mean_f1(rows: DataFrame) -> DataFrame:
        per = metrics.zero_rates(metrics.confusion(rows, ["rep", "model"], "m", "failure"))
        return per.groupBy("rep").agg(F.avg("f1").alias("value"))

    return rounded(bootstrap.intervals(bootstrap.replicate_values(cells, mean_f1), []))


@query()
def r9_stratified_group_folds(spark: SparkSession, d: str) -> DataFrame:
    return sampling.stratified_group_folds(frame(spark, d), "rule_name", "stratum", 5, SEED).select("uid", "rule_name", "stratum", "fold")


@query(f"""WITH {FRAME_SQL} SELECT stratum, count(*) AS n, 0::BIGINT AS split_rules, 0::BIGINT AS lost FROM fr GROUP BY stratum""")
def r9_fold_invariants(spark: SparkSession, d: str) -> DataFrame:
    """Per stratum: its rows over all folds, rows whose rule lies in several folds, and rows without a fold."""
    dealt = materialize(sampling.stratified_group_folds(frame(spark, d), "rule_name", "stratum", 5, SEED), "folds")
    per = dealt.groupBy("rule_name").agg(F.count_distinct("fold").alias("k"))
    j = dealt.join(per, dealt["rule_name"].eqNullSafe(per["rule_name"])).drop(per["rule_name"])
    return j.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("k") > 1).alias("split_rules"), F.count_if(F.col("fold").isNull()).alias("lost"))


@query(f"WITH {FRAME_SQL}, {FOLDS_SQL} SELECT uid, fold FROM fo")
def r10_random_folds(spark: SparkSession, d: str) -> DataFrame:
    return sampling.random_folds(frame(spark, d), "uid", 5, SEED).select("uid", "fold")


@query(f"WITH {FRAME_SQL}, {_GROUPED}, {CROSS_SQL} " + rates_sql(confusion_sql("cf", "fold"), "fold"))
def r10_grouped_cv(spark: SparkSession, d: str) -> DataFrame:
    """Every held-out rule is unseen, so the rule model answers Non-Attack throughout."""
    folds = sampling.grouped_folds(frame(spark, d), "rule_name", 5, SEED)
    scored = models.cross_fit_rule_majority(materialize(folds, "folds")).withColumn("truth", F.col("label"))
    return rounded(metrics.hard_metrics(scored, ["fold"]))


SEEDS = (SEED, SEED + 1, SEED + 2)
_HALVES = "CASE truth WHEN 'Attack' THEN 0.5 / (SELECT avg(CASE label WHEN 'Attack' THEN 1.0 ELSE 0 END) FROM fr) ELSE 0.5 / (SELECT avg(CASE label WHEN 'Attack' THEN 0 ELSE 1.0 END) FROM fr) END"


def _cv_average_sql() -> str:
    kinds = [("random", False, 0), ("grouped", True, 3)]
    ctes = ", ".join(cv_sql(seed, grouped, at + i) for _, grouped, at in kinds for i, seed in enumerate(SEEDS))
    one = " UNION ALL ".join(
        f"SELECT '{kind}' AS folds, {at + i} AS run, p.*, q.f1 AS balanced_f1 FROM (SELECT {', '.join(f'{v} AS {k}' for k, v in ZERO.items())} FROM ({confusion_sql(f'cf{at + i}', 'true').replace('GROUP BY true', '')})) p, "
        f"(SELECT {ZERO['f1']} AS f1 FROM ({confusion_sql(f'cf{at + i}', 'true', _HALVES).replace('GROUP BY true', '')})) q"
        for kind, _, at in kinds for i in range(len(SEEDS))
    )
    return f"WITH {FRAME_SQL}, {ctes} SELECT folds, {', '.join(f'round(avg({k}), 6) AS {k}' for k in (*RATES, 'balanced_f1'))} FROM ({one}) GROUP BY folds"


@query(_cv_average_sql())
def r10_cv_average(spark: SparkSession, d: str) -> DataFrame:
    """Random and grouped five-fold cross-validation over three seeds, averaged; F1 also with both classes weighted to one half."""
    f = frame(spark, d)
    base = f.agg(F.avg((F.col("label") == "Attack").cast("double")).alias("share"))
    parts = []
    for kind, deal in (("random", lambda x: sampling.random_folds(f, "uid", 5, x)), ("grouped", lambda x: sampling.grouped_folds(f, "rule_name", 5, x))):
        for seed in SEEDS:
            scored = models.cross_fit_rule_majority(materialize(deal(seed), "folds")).withColumn("truth", F.col("label")).crossJoin(F.broadcast(base))  # base: one row
            halves = F.when(F.col("truth") == "Attack", 0.5 / F.col("share")).otherwise(0.5 / (1 - F.col("share")))
            scored = materialize(scored.select("truth", "pred", halves.alias("half")), "scored")
            plain = metrics.zero_rates(metrics.confusion(scored, [], None, "exclude")).select(*RATES)
            even = metrics.zero_rates(metrics.confusion(scored, [], "half", "exclude")).select(F.col("f1").alias("balanced_f1"))
            parts.append(plain.crossJoin(even).select(F.lit(kind).alias("folds"), "*"))  # one row each
    return rounded(reduce(DataFrame.unionByName, parts).groupBy("folds").agg(*[F.avg(c).alias(c) for c in (*RATES, "balanced_f1")]))


@query(f"""WITH {FRAME_SQL}, {FOLDS_SQL}, rr AS (SELECT r FROM (SELECT DISTINCT coalesce(rule_name, '') AS r, fold FROM fo) GROUP BY r HAVING count(*) > 1)
  SELECT fold, count(*) AS n, count(DISTINCT coalesce(rule_name, '')) AS n_rules, count(*) FILTER (label = 'Attack') AS attack, count(*) FILTER (label = 'Non-Attack') AS non_attack,
    {", ".join(f"count(*) FILTER (stratum = '{s}') AS {s}" for s in STRATA)}, count(DISTINCT coalesce(rule_name, '')) FILTER (coalesce(rule_name, '') IN (SELECT r FROM rr)) AS rule_overlap, 0::BIGINT AS key_overlap,
    (SELECT count(*) FROM fo) - count(*) AS train_n, concat_ws(',', CASE WHEN count(*) FILTER (label = 'Attack') = 0 THEN 'Attack' END, CASE WHEN count(*) FILTER (label = 'Non-Attack') = 0 THEN 'Non-Attack' END) AS missing_class
  FROM fo GROUP BY fold""")
def a20_fold_report(spark: SparkSession, d: str) -> DataFrame:
    return reports.fold_report(materialize(sampling.random_folds(frame(spark, d), "uid", 5, SEED), "folds"), list(STRATA))


# -- order, limits, windows -------------------------------------------------------------------------------------------


@query("""SELECT day, v AS hour, c AS n, cum FROM (SELECT *, sum(c) OVER (PARTITION BY day ORDER BY v)::BIGINT AS cum FROM
  (SELECT CAST(CAST(called_at AS DATE) AS VARCHAR) AS day, hour(called_at)::INTEGER AS v, count(*) AS c FROM throughput_qwen3_4b GROUP BY 1, 2))""")
def w1_running_total(spark: SparkSession, d: str) -> DataFrame:
    per = calls(spark, d).groupBy("day", F.hour("called_at").alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    return prefix_sums(per, ["day"], "hour", ["n"]).withColumnRenamed("n_cum", "cum")


@query(f"WITH {FRAME_SQL} SELECT uid, stratum, row_number() OVER (PARTITION BY stratum ORDER BY uid) AS rank FROM fr")
def w2_order_in_stratum(spark: SparkSession, d: str) -> DataFrame:
    return rank_within(frame(spark, d).select("uid", "stratum"), "stratum", ["uid"])


@query(f"""WITH {CALLS_SQL}, g AS (SELECT day, rule_name, count(*) AS n FROM ca WHERE rule_name IS NOT NULL GROUP BY 1, 2)
  SELECT day, rule_name, n FROM g QUALIFY row_number() OVER (PARTITION BY day ORDER BY n DESC, rule_name) = 1""")
def w3_top_rule_per_day(spark: SparkSession, d: str) -> DataFrame:
    per = calls(spark, d).filter("rule_name is not null").groupBy("day", "rule_name").agg(F.count(F.lit(1)).alias("n"))
    most = per.groupBy("day").agg(F.max("n").alias("n"))
    return per.join(most, ["day", "n"]).groupBy("day", "n").agg(F.min("rule_name").alias("rule_name"))


@query(f"WITH {ALERTS_SQL} SELECT rule_name, count(*) AS c FROM al GROUP BY rule_name ORDER BY c DESC, rule_name NULLS FIRST LIMIT 30")
def w4_top_values(spark: SparkSession, d: str) -> DataFrame:
    return reports.top_values(alerts(spark, d), "rule_name", 30)


@query(f"WITH {FRAME_SQL} SELECT uid, row_number() OVER (ORDER BY sha256('{SEED}|' || uid), uid) - 1 AS position FROM fr QUALIFY position < 20")
def w5_first_in_call_order(spark: SparkSession, d: str) -> DataFrame:
    return sampling.first_in_order(frame(spark, d).select("uid"), "uid", SEED, 20)


# -- scalar derivations -----------------------------------------------------------------------------------------------


def _shown(c: str, f: str) -> str:
    return f if f in fields_of(c) else f"NULL AS {f}"


@query(f"WITH {ALERTS_SQL} " + " UNION ALL ".join(f"SELECT row_index, '{c}' AS condition, {', '.join(_shown(c, f) for f in FIELD_ORDER)} FROM al" for c in CONDITIONS))
def proj_condition(spark: SparkSession, d: str) -> DataFrame:
    """What every condition shows of every alert; the columns that it removes are null."""
    a = alerts(spark, d)
    kinds = dict(a.dtypes)
    hide = lambda c: [F.col(f) if f in fields_of(c) else F.lit(None).cast(kinds[f]).alias(f) for f in FIELD_ORDER]
    return reduce(DataFrame.unionByName, [a.select("row_index", F.lit(c).alias("condition"), *hide(c)) for c in CONDITIONS])


_SYSTEM, _HEADER = "Label the alert.", "Alert record:\n"


def _json_sql(c: str) -> str:
    lines = ["'  \"" + f + "\": ' || coalesce(to_json(" + f + ")::VARCHAR, 'null')" for f in fields_of(c)]
    return "'Alert record:' || chr(10) || '{' || chr(10) || " + " || ',' || chr(10) || ".join(lines) + " || chr(10) || '}'"


@query(f"WITH {ALERTS_SQL} " + " UNION ALL ".join(f"SELECT row_index, '{c}' AS condition, '{_SYSTEM}' AS system_text, {_json_sql(c)} AS user_text FROM al" for c in CONDITIONS))
def proj_messages(spark: SparkSession, d: str) -> DataFrame:
    """The two messages of a call under every condition."""
    a = alerts(spark, d)
    parts = [a.select("row_index", F.lit(c).alias("condition"), messages(_SYSTEM, _HEADER, fields_of(c)).alias("m")) for c in CONDITIONS]
    each = reduce(DataFrame.unionByName, parts)
    return each.select("row_index", "condition", F.col("m")[0]["content"].alias("system_text"), F.col("m")[1]["content"].alias("user_text"))


@query(f"""WITH {ALERTS_SQL} SELECT row_index, lower(nfc_normalize(concat_ws(chr(10), {", ".join(f"replace(replace(coalesce(CAST({f} AS VARCHAR), ''), chr(13) || chr(10), chr(10)), chr(13), chr(10))" for f in fields_of('c'))}))) AS text FROM al""")
def proj_classifier_text(spark: SparkSession, d: str) -> DataFrame:
    a = alerts(spark, d)
    return a.select("row_index", classifier_text(fields_of("c"), dict(a.dtypes)).alias("text"))


@query(f"WITH {CALLS_SQL} SELECT i, pred, CASE WHEN pred IS NULL THEN 'invalid' ELSE 'ok' END AS status FROM ca")
def proj_parse_label(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "throughput_qwen3_4b").select("i", parse_label(F.col("raw")).alias("pred")).withColumn("status", status(F.col("pred")))


@query("SELECT i, CASE WHEN prompt_tokens / 10000.0 >= 0.1 THEN 'Attack' WHEN prompt_tokens IS NOT NULL THEN 'Non-Attack' END AS pred FROM throughput_qwen3_4b")
def proj_hard_label(spark: SparkSession, d: str) -> DataFrame:
    return calls(spark, d).select("i", hard_label(F.col("score"), 0.1).alias("pred"))


@query("SELECT i, prompt_tokens, completion_tokens FROM throughput_qwen3_4b WHERE greatest(prompt_tokens, completion_tokens) <= 4000")
def proj_length_filter(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "throughput_qwen3_4b").select("i", "prompt_tokens", "completion_tokens").filter(F.greatest("prompt_tokens", "completion_tokens") <= 4000)


@query("""SELECT i, seconds IS NOT NULL AND prompt_tokens IS NOT NULL AND NOT isnan(seconds) AS available,
  round(CASE WHEN seconds IS NOT NULL AND NOT isnan(seconds) AND prompt_tokens IS NOT NULL THEN exp(-seconds / 10) / (exp(-seconds / 10) + exp(-prompt_tokens / 1000)) END, 6) AS s,
  CASE WHEN (seconds IS NULL OR isnan(seconds)) AND prompt_tokens IS NULL THEN 'neither_listed' WHEN prompt_tokens IS NULL THEN 'negative_unlisted'
    WHEN seconds IS NULL OR isnan(seconds) THEN 'positive_unlisted' END AS reason FROM throughput_qwen3_4b""")
def proj_token_score(spark: SparkSession, d: str) -> DataFrame:
    """Token log-probabilities made up from latency and prompt length; the label texts share their first token."""
    t = table(spark, d, "throughput_qwen3_4b")
    cand = lambda i, v: F.struct(F.lit(i).alias("id"), v.alias("logprob"))
    sec = F.when(~F.isnan("seconds"), -F.col("seconds") / 10)
    top = F.filter(F.array(cand(10, sec), cand(20, -F.col("prompt_tokens") / 1000)), lambda x: x["logprob"].isNotNull())
    pos = lambda i, xs: F.struct(F.lit(i).alias("id"), xs.alias("top_logprobs"))
    score = divergent_token_score(F.array(pos(5, top), pos(10, top)), F.array(F.lit(5), F.lit(10)), F.array(F.lit(5), F.lit(20), F.lit(21)))
    return rounded(t.select("i", score.alias("x")).select("i", "x.available", "x.s", "x.reason"))


_PARAMS = settings_hash({"temperature": 0.0, "max_tokens": 16})


@query(f"SELECT pred_id, sha256(model || '|a|' || uid || '|' || sha256('{_SYSTEM}') || '|' || sha256(record) || '|' || '{_PARAMS}') AS call_id FROM published WHERE uid IS NOT NULL AND record IS NOT NULL AND model IS NOT NULL")
def proj_call_id(spark: SparkSession, d: str) -> DataFrame:
    """Model, condition, uid and the hashes of system text, user text and parameters."""
    t = table(spark, d, "published").filter("uid is not null and record is not null and model is not null")
    parts = [F.col("model"), F.lit("a"), F.col("uid"), F.sha2(F.lit(_SYSTEM), 256), F.sha2("record", 256), F.lit(_PARAMS)]
    return t.select("pred_id", call_id(*parts).alias("call_id"))


@query("""SELECT doc_id, strftime(loaded_at, '%d %b %Y') AS form_1, strftime(loaded_at, '%-d %b %Y') AS form_2, strftime(loaded_at, '%Y-%m-%d') AS form_3, strftime(loaded_at, '%B %d, %Y') AS form_4,
  strftime(loaded_at, '%d %B %Y') AS form_5 FROM documents""")
def proj_date_forms(spark: SparkSession, d: str) -> DataFrame:
    forms = date_texts(F.col("loaded_at"))
    return table(spark, d, "documents").select("doc_id", *[forms[i].alias(f"form_{i + 1}") for i in range(5)])


@query("""SELECT count(*) FILTER (starts_with(stratum, 'mixed')) AS mixed, count(*) FILTER (starts_with(stratum, 'single')) AS single, count(*) FILTER (contains(stratum, 'non')) AS negative FROM dryrun_sample""")
def proj_prefixes(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("stratum")
    return table(spark, d, "dryrun_sample").agg(F.count_if(s.startswith("mixed")).alias("mixed"), F.count_if(s.startswith("single")).alias("single"), F.count_if(s.contains("non")).alias("negative"))


@query(f"""WITH x AS (SELECT s.rule_name AS r, b.rule_name AS r2, {label_sql('s.label')} AS l, {label_sql('b.label')} AS l2, {UID_SQL.format('s.uid')} AS u, {UID_SQL.format('b.uid')} AS u2 FROM dryrun_sample s JOIN secalertbench b USING (row_index))
  SELECT 'rule_name' AS field_name, count(*) FILTER (r IS DISTINCT FROM r2) AS n FROM x UNION ALL SELECT 'label', count(*) FILTER (l IS DISTINCT FROM l2) FROM x UNION ALL SELECT 'uid', count(*) FILTER (u IS DISTINCT FROM u2) FROM x""")
def proj_field_mismatches(spark: SparkSession, d: str) -> DataFrame:
    clean = lambda t: table(spark, d, t).select("row_index", "rule_name", label_form(F.col("label")).alias("label"), uid_form(F.col("uid")).alias("uid"))
    return runlog.field_mismatches(clean("dryrun_sample"), clean("secalertbench"), ["rule_name", "label", "uid"], "row_index")


@query(f"SELECT lang, count(*) AS n, count(*) FILTER (regexp_matches(text, '{DATE_PATTERN}')) AS with_date FROM documents GROUP BY lang")
def proj_date_texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count_if(mentions_date(F.col("text"))).alias("with_date"))


# -- run log ----------------------------------------------------------------------------------------------------------


@query(f"WITH {_LOG_SQL} SELECT call_id, row_index FROM ex ANTI JOIN dn USING (call_id)")
def l1_pending(spark: SparkSession, d: str) -> DataFrame:
    expected, _, done = _log(spark, d)
    return runlog.pending(expected, done).select("call_id", "row_index")


@query(f"WITH {_LOG_SQL} SELECT * FROM la")
def l2_last_attempts(spark: SparkSession, d: str) -> DataFrame:
    return runlog.last_attempts(_log(spark, d)[1])


@query(f"""WITH {_LOG_SQL} SELECT (SELECT count(*) FROM dn) AS n_before, (SELECT count(*) FROM dn) + (SELECT count(*) FROM ex ANTI JOIN dn USING (call_id)) AS n_after""")
def l4_append_once(spark: SparkSession, d: str) -> DataFrame:
    expected, _, done = _log(spark, d)
    grown = runlog.append_once(done, expected.select("call_id"))
    count = lambda x, n: x.agg(F.count(F.lit(1)).alias(n))
    return count(done, "n_before").crossJoin(count(grown, "n_after"))  # one row each


_L5_SQL = f"""WITH {_LOG_SQL}, cl AS (SELECT s.uid AS call_id, s.row_index, coalesce(s.rule_name, '') AS rule_name, coalesce(b.attack_type, '') AS attack_type, s.split AS harness, {label_sql('s.label')} AS l
    FROM dryrun_sample s LEFT JOIN secalertbench b USING (row_index)),
  c AS (SELECT call_id, count(*) AS c FROM cl GROUP BY call_id), ax AS (SELECT call_id, count(*) AS a, count(*) FILTER (status = 'ok') AS ok FROM atm GROUP BY call_id),
  j AS (SELECT ex.call_id AS e, c.c, ax.a, ax.ok FROM ex FULL JOIN c ON ex.call_id = c.call_id FULL JOIN ax ON ax.call_id = coalesce(ex.call_id, c.call_id)),
  mm AS (SELECT count(*) FILTER (cl.row_index IS DISTINCT FROM ex.row_index) AS a, count(*) FILTER (cl.rule_name IS DISTINCT FROM ex.rule_name) AS b, count(*) FILTER (cl.attack_type IS DISTINCT FROM ex.attack_type) AS c FROM cl JOIN ex USING (call_id)),"""


@query(f"""{_L5_SQL} t AS (SELECT count(e) AS expected, count(c) AS done, count(*) FILTER (e IS NOT NULL AND c IS NULL) AS missing, count(*) FILTER (e IS NULL AND c IS NOT NULL) AS unexpected, count(*) FILTER (c > 1) AS duplicates,
    count(*) FILTER (a IS NOT NULL AND c IS NULL) AS failed, count(*) FILTER (c IS NOT NULL AND coalesce(ok, 0) = 0) AS no_attempt, count(*) FILTER (ok > 1) AS resent,
    (SELECT a + b + c FROM mm) AS mismatches, (SELECT count(DISTINCT harness) FROM cl) AS harnesses, (SELECT count(l) FROM cl) AS ok, (SELECT count(*) FILTER (l IS NULL) FROM cl) AS invalid FROM j),
  p AS (SELECT *, concat_ws(',', CASE WHEN duplicates > 0 THEN 'duplicates' END, CASE WHEN unexpected > 0 THEN 'unexpected' END, CASE WHEN mismatches > 0 THEN 'mismatches' END, CASE WHEN harnesses > 1 THEN 'harnesses' END,
    CASE WHEN resent > 0 THEN 'resent' END, CASE WHEN no_attempt > 0 THEN 'no_attempt' END) AS problems FROM t)
  SELECT *, missing = 0 AS complete, problems = '' AND missing = 0 AS passes FROM p""")
def l5_validate_run(spark: SparkSession, d: str) -> DataFrame:
    """dryrun_sample as the call log: its splits as harnesses, a readable label as an ok status."""
    expected, attempts, _ = _log(spark, d)
    return runlog.validate_run(expected, _sample_log(spark, d), attempts, ["row_index", "rule_name", "attack_type"])


@query(f"{_L5_SQL} x AS (SELECT 1) SELECT 'row_index' AS field_name, a AS n FROM mm UNION ALL SELECT 'rule_name', b FROM mm UNION ALL SELECT 'attack_type', c FROM mm")
def l5_field_mismatches(spark: SparkSession, d: str) -> DataFrame:
    return runlog.field_mismatches(_sample_log(spark, d), _log(spark, d)[0], ["row_index", "rule_name", "attack_type"])


def _sample_log(spark: SparkSession, d: str) -> DataFrame:
    data = table(spark, d, "secalertbench").select("row_index", F.coalesce("attack_type", F.lit("")).alias("attack_type"))
    log = table(spark, d, "dryrun_sample").join(data, "row_index", "left")
    return log.select(F.col("uid").alias("call_id"), "row_index", F.coalesce("rule_name", F.lit("")).alias("rule_name"), F.coalesce("attack_type", F.lit("")).alias("attack_type"), F.col("split").alias("harness"), status(label_form(F.col("label"))).alias("status"))


def _made_up_scorer(call: dict) -> str:
    """Fails a call as often as its number modulo 8 says, every fifth of them for good."""
    if call["i"] % 8 >= call["attempt"]:
        raise scoring.ScorerError("refused", 403) if call["i"] % 5 == 0 else scoring.ScorerError("busy", 503, retry_after=3.0)
    return call["raw"]


@query(f"""WITH f AS (SELECT i, i % 8 AS f, i % 5 = 0 AS dead FROM throughput_qwen3_4b), n AS (SELECT *, CASE WHEN f > 0 AND dead THEN 1 ELSE least(f + 1, {len(scoring.WAITS)}) END AS k FROM f)
  SELECT i::VARCHAR AS call_id, k::BIGINT AS n_attempts, CASE WHEN f > 0 AND dead THEN 'fatal' WHEN f >= {len(scoring.WAITS)} THEN 'error' ELSE 'ok' END AS final_status,
    CASE WHEN f > 0 AND dead THEN 0.0 ELSE coalesce(list_sum(list_transform(range(1, least(f, {len(scoring.WAITS) - 1}) + 1), lambda a: greatest(3.0, {list(map(float, scoring.WAITS))}[a]))), 0.0) END AS waited FROM n""")
def l2_scored_calls(spark: SparkSession, d: str) -> DataFrame:
    """Calls through a scorer that fails in a known pattern: attempts, how each call ended, and seconds it waited (not slept here)."""
    calls_in = table(spark, d, "throughput_qwen3_4b").select(F.col("i").cast("string").alias("call_id"), "i", "raw")
    tries = scoring.attempt_calls(calls_in, _made_up_scorer, jitter=0.0, sleep=lambda seconds: None, stop_on_fatal=False)
    return tries.groupBy("call_id").agg(F.count(F.lit(1)).alias("n_attempts"), F.max_by("status", "attempt").alias("final_status"), F.sum("waited").alias("waited"))


@query("""WITH a AS (SELECT uid AS path, max(sha256(coalesce(rule_name, ''))) AS h FROM secalertbench GROUP BY uid), b AS (SELECT uid AS path, max(sha256(coalesce(rule_name, ''))) AS h FROM dryrun_sample GROUP BY uid)
  SELECT * FROM (SELECT coalesce(a.path, b.path) AS path, CASE WHEN b.h IS NULL THEN 'missing' WHEN a.h IS NULL THEN 'new' WHEN a.h <> b.h THEN 'changed' END AS problem FROM a FULL JOIN b ON a.path = b.path) WHERE problem IS NOT NULL""")
def l6_lock_diff(spark: SparkSession, d: str) -> DataFrame:
    hashed = lambda t: table(spark, d, t).groupBy(F.col("uid").alias("path")).agg(F.max(F.sha2(F.coalesce("rule_name", F.lit("")), 256)).alias("sha256"))
    return audit.lock_diff(hashed("secalertbench"), hashed("dryrun_sample"))


# -- sources and sinks ------------------------------------------------------------------------------------------------


def _out(spark: SparkSession, name: str) -> str:
    import uuid

    return f"{scratch_dir(spark)}/alertmill-{name}-{uuid.uuid4().hex}"


@query("SELECT * FROM dryrun_sample")
def s3_jsonl_round_trip(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "dryrun_sample")
    files.write_jsonl(df, path := _out(spark, "jsonl"))
    return files.read_jsonl(spark, path, df.schema)


@query("SELECT plan_id, stratum, label, target_permille, frame_permille, min_rows FROM sample_target")
def s14_csv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "sample_target")
    files.write_csv(df, path := _out(spark, "csv"))
    return files.read_csv(spark, path, df.schema)


def _one_file_each(df: DataFrame, name: str) -> str:
    """A folder with one file <name>.json of the column value for each value of name: how published results are shipped."""
    spark = df.sparkSession
    df.repartition(name).write.partitionBy(name).text(path := _out(spark, "parts"))
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = fs_path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(fs_path(out := _out(spark, "files")))
    for folder in fs.listStatus(fs_path(path)):
        if folder.isDirectory():
            part = next(f for f in fs.listStatus(folder.getPath()) if f.getPath().getName().startswith("part-"))
            fs.rename(part.getPath(), fs_path(f"{out}/{folder.getPath().getName().split('=', 1)[1]}.json"))
    return out


@query("SELECT model, count(*) AS n, count(*) FILTER (llm_label IN ('Attack', 'Non-Attack')) AS n_valid FROM published GROUP BY model")
def s6_files_by_stem(spark: SparkSession, d: str) -> DataFrame:
    """One file of JSON lines per model, read back with the model taken from the file's name."""
    lines = table(spark, d, "published").select("model", F.to_json(F.struct("pred_id", "llm_label")).alias("value"))
    back = spark.read.schema("pred_id long, llm_label string").json(_one_file_each(lines, "model")).withColumn("model", files.file_stem())
    return back.groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("llm_label").isin("Attack", "Non-Attack")).alias("n_valid"))


@query(f"""WITH {PUBLISHED_SQL}, v AS (SELECT model, count(*) AS n, count(*) FILTER (llm_label IN ('Attack', 'Non-Attack')) AS n_valid, count(DISTINCT json_extract_string(record, '$.uri')) AS n_uris FROM published GROUP BY model)
  SELECT v.*, tp AS reported_tp, fn AS reported_fn FROM v JOIN ({confusion_sql('ju', 'model', '1.0', 'exclude')}) USING (model)""")
def s5_published_files(spark: SparkSession, d: str) -> DataFrame:
    """One file per model with its results and the summary of its metrics, read back."""
    record = T.StructType([T.StructField(f, T.StringType()) for f in FIELD_ORDER])
    t = table(spark, d, "published").withColumn("record", F.from_json("record", record))
    results = t.groupBy("model").agg(F.collect_list(F.struct("record", "true_label", "llm_label")).alias("results"))  # a file is one object
    cells = metrics.confusion(judged(spark, d), ["model"], None, "exclude").select("model", *[F.col(c).cast("long").alias(c.upper()) for c in ("tp", "fp", "tn", "fn")])
    made = results.join(cells, "model").select("model", F.struct("results", F.struct(F.struct(F.struct("TP", "FP", "TN", "FN").alias("confusion_matrix")).alias("metrics")).alias("summary")).alias("o"))
    rows, summaries = files.read_published(spark, _one_file_each(made.select("model", F.to_json("o").alias("value")), "model"), record)
    per = rows.groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.count("llm_label").alias("n_valid"), F.count_distinct("record.uri").alias("n_uris"))
    return per.join(summaries.select("model", F.col("confusion_matrix.TP").cast("double").alias("reported_tp"), F.col("confusion_matrix.FN").cast("double").alias("reported_fn")), "model")


@query(f"SELECT (row_number() OVER (ORDER BY row_index) - 1)::INTEGER AS row_index, {', '.join(FIELD_ORDER)}, label FROM secalertbench")
def s1_array_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """The alerts as one JSON array in one file, scanned with its hash pinned and its field order checked."""
    t = table(spark, d, "secalertbench")
    files.write_array_file(t.select("row_index", *FIELD_ORDER, "label"), "row_index", path := f"{_out(spark, 'array')}.json")
    schema = T.StructType([t.schema[f] for f in (*FIELD_ORDER, "label")])
    return files.read_array_file(spark, path, schema, files.file_hashes(spark, path).first()["sha256"], in_order=True)


@query("SELECT key, count(*) AS n FROM (SELECT unnest(json_keys(record)) AS key FROM published) GROUP BY key")
def s7_nested_keys(spark: SparkSession, d: str) -> DataFrame:
    return files.nested_key_counts(table(spark, d, "published"), "record")


@query("""SELECT count(*) FILTER (error IS NULL) AS good, count(*) FILTER (error IS NOT NULL) AS bad, count(*) AS n_lines FROM throughput_qwen3_4b""")
def s9_tolerant_scan(spark: SparkSession, d: str) -> DataFrame:
    """The call log as JSON lines, of which those of failed calls are torn in the middle."""
    whole = F.to_json(F.struct("i", "uid", "pred"))
    lines = table(spark, d, "throughput_qwen3_4b").select(F.when(F.col("error").isNull(), whole).otherwise(F.substring(whole, 1, 12)).alias("value"))
    lines.write.text(path := _out(spark, "torn"))
    schema = T.StructType([T.StructField("i", T.LongType()), T.StructField("uid", T.StringType()), T.StructField("pred", T.StringType())])
    good, bad, read = files.read_tolerant(spark, path, schema)
    n = lambda x, name: x.agg(F.count(F.lit(1)).alias(name))
    return n(good, "good").crossJoin(n(bad, "bad")).crossJoin(read.agg(F.sum("n_lines").alias("n_lines")))  # one row each


@query("SELECT count(*) AS n_calls, count(DISTINCT i) AS n_ids, 0::BIGINT AS n_torn FROM throughput_qwen3_4b WHERE i IS NOT NULL")
def s10_recovered_log(spark: SparkSession, d: str) -> DataFrame:
    """The call log written as JSON lines and recovered; whole files lose nothing and nothing is set aside."""
    table(spark, d, "throughput_qwen3_4b").filter("i is not null").select(F.to_json(F.struct("i", "uid")).alias("value")).write.text(path := _out(spark, "log"))
    log = files.recover_log(spark, path, T.StructType([T.StructField("i", T.LongType()), T.StructField("uid", T.StringType())]), _out(spark, "quarantine"), "i")
    torn = files.numbered_lines(spark, path)[1].agg(F.count_if("torn").alias("n_torn"))
    return log.agg(F.count(F.lit(1)).alias("n_calls"), F.count_distinct("i").alias("n_ids")).crossJoin(torn)  # one row each


@query(f"SELECT row_index, sha256({serial_sql('{}')}) AS sha256 FROM secalertbench")
def s11_row_hashes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "secalertbench").select("row_index", fr.content_key().alias("sha256"))


@query("SELECT uid, called_at FROM throughput_qwen3_4b GROUP BY uid, called_at")
def stream_distinct_calls(spark: SparkSession, d: str) -> DataFrame:
    """Calls logged twice enter the log once: file source, watermark, exactly-once file sink."""
    schema = table(spark, d, "throughput_qwen3_4b").schema
    log, mark = _out(spark, "stream"), _out(spark, "mark")
    calls_in = stream.call_stream(spark, f"{d}/throughput_qwen3_4b.parquet", schema)
    once = stream.distinct_calls(calls_in.select("uid", "called_at"), ["uid", "called_at"], "called_at", "400 days")
    stream.run_available(once, log, mark)
    return spark.read.schema(once.schema).parquet(log).select("uid", F.col("called_at").cast("timestamp_ntz").alias("called_at"))


@query("""SELECT CAST(CAST(called_at AS DATE) AS VARCHAR) AS day, count(*) AS n_calls, count(seconds) FILTER (NOT isnan(seconds)) AS n_values, round(sum(seconds) FILTER (NOT isnan(seconds)), 6) AS total,
  round(max(seconds) FILTER (NOT isnan(seconds)), 6) AS most FROM throughput_qwen3_4b GROUP BY 1""")
def stream_daily_latency(spark: SparkSession, d: str) -> DataFrame:
    schema = table(spark, d, "throughput_qwen3_4b").schema
    target, mark = _out(spark, "daily"), _out(spark, "mark")
    calls_in = stream.call_stream(spark, f"{d}/throughput_qwen3_4b.parquet", schema)
    stream.run_available(stream.windowed_latency(calls_in, "called_at", "seconds"), target, mark, "complete")
    got = stream.latest_batch(spark, target)
    return rounded(got.select(F.to_date("w.start").cast("string").alias("day"), "n_calls", "n_values", "total", "most"))


# -- gates ------------------------------------------------------------------------------------------------------------


def run_gates_on(spark: SparkSession, d: str, names: list[str] | None = None) -> DataFrame:
    """(gate, passed, detail) on the driver's tables. What a project would have recorded is recorded here first."""
    f = frame(spark, d)
    dealt = lambda: materialize(sampling.stratified_group_folds(f, "rule_name", "stratum", 5, SEED), "folds")
    expected, attempts, _ = _log(spark, d)
    j = judged(spark, d)
    summaries = metrics.zero_rates(metrics.confusion(j, ["model"], None, "exclude")).select("model", "tp", "fp", "tn", "fn", "f1")
    inputs = {
        "spark": spark, "frame": f, "alerts": alerts(spark, d), "calls": calls(spark, d), "judged": j, "folds": dealt(), "recorded_folds": dealt(), "expected": expected, "attempts": attempts,
        "sample": lambda: sampling.two_phase_sample(f, "stratum", "uid", 10, 40, SEED).select("uid", "stratum", "phase"), "phases": {"first": 10, "second": 40},
        "weights": materialize(fr.inverse_probability_weights(f), "weights"), "concentration": materialize(fr.concentration(f), "concentration"),
        "summaries": materialize(summaries, "summaries"), "runs": _runs(spark, d), "header": _HEADER, "most_completion_tokens": 1024,
    }
    return gates.run_gates(inputs, names)


_ALWAYS = [g for g in gates.GATES if g not in (
    "prompts fit the context", "no call is lost in transport", "invalid answers at most a tenth of each class", "scores cover 95 percent of each class",
    "repeated calls give the same labels and scores", "answers cut off at most 2 percent", "projected time below the limit",
)]


@query(f"""WITH {CALLS_SQL}, {_LOG_SQL}, cells AS (SELECT count(*) FILTER (pred IS NULL) / count(*) AS inv, count(score) / count(*) AS cov FROM ca GROUP BY truth),
  r AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY i) AS f, row_number() OVER (PARTITION BY uid ORDER BY i DESC) AS l FROM ca),
  p AS (SELECT a.pred IS NOT DISTINCT FROM b.pred AND (a.score IS NULL) = (b.score IS NULL) AND coalesce(abs(a.score - b.score) < 1e-3, true) AS same FROM r a JOIN r b ON a.uid = b.uid AND a.f = 1 AND b.l = 1)
  SELECT 'prompts fit the context' AS gate, coalesce(bool_and(prompt_tokens <= 8176), true) AS passed FROM ca
  UNION ALL SELECT 'no call is lost in transport', bool_and(n_ok > 0) FROM la
  UNION ALL SELECT 'invalid answers at most a tenth of each class', max(inv) <= 0.1 FROM cells UNION ALL SELECT 'scores cover 95 percent of each class', min(cov) >= 0.95 FROM cells
  UNION ALL SELECT 'repeated calls give the same labels and scores', bool_and(same) FROM p
  UNION ALL SELECT 'answers cut off at most 2 percent', count(*) FILTER (completion_tokens >= 1024) / count(*) <= 0.02 FROM ca
  UNION ALL SELECT 'projected time below the limit', avg(seconds) * 3000 / 3600 < 20 FROM ca WHERE seconds IS NOT NULL AND NOT isnan(seconds) """ + "".join(f" UNION ALL SELECT '{g}', true" for g in _ALWAYS))
def gates_report(spark: SparkSession, d: str) -> DataFrame:
    """(gate, passed) of every registered gate. Those on the engine itself must pass on any data."""
    return run_gates_on(spark, d).select("gate", "passed")


@query()
def gates_details(spark: SparkSession, d: str) -> DataFrame:
    return run_gates_on(spark, d)
