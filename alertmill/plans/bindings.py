"""The driver's tables as the evaluation's inputs, in Spark and as SQL that the oracles start from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import content_key
from ..functions.labels import parse_label
from ..functions.text import label_form, uid_form
from ..operators.frame import build_frame, labels_per_rule
from ..schema import CONTENT_FIELDS, FIELD_ORDER, RECORD_AS_TEXT
from ..session import materialize
from .training import PLAIN_SQL, UID_SQL, table

SEED = 7


def alerts(spark: SparkSession, d: str) -> DataFrame:
    """Deliveries with a readable label; fields as delivered."""
    t = table(spark, d, "secalertbench").withColumn("label", label_form(F.col("label")))
    return t.filter("label is not null")


def frame(spark: SparkSession, d: str) -> DataFrame:
    return materialize(build_frame(alerts(spark, d)), "frame")


def published(spark: SparkSession, d: str) -> DataFrame:
    """Published rows: fields of the record as columns, key, truth, pred (null if invalid), text forms as shipped."""
    t = table(spark, d, "published").withColumn("r", F.from_json("record", RECORD_AS_TEXT))
    wide = t.select("pred_id", "model", "split", uid_form(F.col("uid")).alias("uid"), "r.*", label_form(F.col("true_label")).alias("truth"), parse_label(F.col("llm_label")).alias("pred"))
    return wide.withColumn("key", content_key(CONTENT_FIELDS))


def judged(spark: SparkSession, d: str) -> DataFrame:
    return published(spark, d).filter("truth is not null").select("pred_id", "model", "split", "uid", "rule_name", "key", "truth", "pred")


def calls(spark: SparkSession, d: str) -> DataFrame:
    """Model calls: day, truth, parsed prediction, score in [0, 1] (null if the call has no prompt length)."""
    t = table(spark, d, "throughput_qwen3_4b")
    return t.select(
        "i", "uid", "rule_name", "truth", parse_label(F.col("raw")).alias("pred"), "error", "raw", "seconds", "prompt_tokens", "completion_tokens", "called_at", "logged_at",
        F.to_date("called_at").cast("string").alias("day"), (F.col("prompt_tokens") / 10000.0).alias("score"),
    )


def rule_types(spark: SparkSession, d: str) -> DataFrame:
    return labels_per_rule(alerts(spark, d)).select("rule_name", "rule_type")


def label_sql(c: str) -> str:
    return f"CASE {PLAIN_SQL.format(c)} WHEN 'attack' THEN 'Attack' WHEN 'nonattack' THEN 'Non-Attack' END"


def parse_sql(c: str) -> str:
    return f"CASE WHEN trim({c}) IN ('Attack', 'Non-Attack') THEN trim({c}) WHEN contains({c}, 'Non-Attack') THEN 'Non-Attack' WHEN contains({c}, 'Attack') THEN 'Attack' END"


def serial_sql(source: str, fields: tuple[str, ...] = CONTENT_FIELDS) -> str:
    part = lambda f: f"coalesce(length(CAST({source.format(f)} AS VARCHAR))::VARCHAR || ':' || CAST({source.format(f)} AS VARCHAR), 'n')"
    return " || ';' || ".join(part(f) for f in sorted(fields))


ALERTS_SQL = f"""al AS (
  SELECT * FROM (SELECT row_index, uid, {", ".join(FIELD_ORDER)}, {label_sql('label')} AS label, seen_at, ingested_at,
    sha256({serial_sql('{}')}) AS key FROM secalertbench) WHERE label IS NOT NULL)"""
TYPES_SQL = """rt AS (SELECT rule_name, count(*) AS n, count(*) FILTER (label = 'Attack') AS n_attack,
  CASE WHEN count(DISTINCT label) = 2 THEN 'mixed' ELSE 'single' END AS rule_type FROM al GROUP BY rule_name)"""
FRAME_SQL = f"""{ALERTS_SQL}, {TYPES_SQL}, fr AS (
  SELECT g.key, substr(g.key, 1, 16) AS uid, g.row_index, g.label, g.rule_name, rt.rule_type,
    rt.rule_type || CASE g.label WHEN 'Attack' THEN '_attack' ELSE '_non_attack' END AS stratum, g.n_duplicates
  FROM (SELECT key, min(row_index) AS row_index, arg_min(coalesce(rule_name, chr(1)), row_index) AS rn0, min(label) AS label, count(*) AS n_duplicates,
    nullif(rn0, chr(1)) AS rule_name FROM al GROUP BY key HAVING count(DISTINCT label) = 1) g JOIN rt ON g.rule_name IS NOT DISTINCT FROM rt.rule_name)"""
_J = "json_extract_string(record, '$.{}')"
PUBLISHED_SQL = f"""pu AS (
  SELECT pred_id, model, split, {UID_SQL.format('uid')} AS uid, {", ".join(_J.format(f) + f" AS {f}" for f in FIELD_ORDER)},
    {label_sql('true_label')} AS truth, {parse_sql('llm_label')} AS pred, sha256({serial_sql(_J)}) AS key FROM published),
ju AS (SELECT pred_id, model, split, uid, rule_name, key, truth, pred FROM pu WHERE truth IS NOT NULL)"""
CALLS_SQL = f"""ca AS (SELECT i, uid, rule_name, truth, {parse_sql('raw')} AS pred, error, raw, seconds, prompt_tokens, completion_tokens, called_at, logged_at,
  CAST(CAST(called_at AS DATE) AS VARCHAR) AS day, prompt_tokens / 10000.0 AS score FROM throughput_qwen3_4b)"""
