"""Queries p3_ and p5_: skewed keys and differences between copies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import plain_form, uid_form
from ..operators.diff import diff_tables
from ..operators.skew import heavy_keys, per_key_profile
from ..schema import CONTENT_FIELDS, RECORD_AS_TEXT
from ..session import spread

#: A rule is heavy from this many thousandths of the rows.
HEAVY_PERMILLE = 40


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heavy_keys(table(spark, sf_dir, "dryrun_sample"), "rule_name", "sample_id", HEAVY_PERMILLE).select("rule_name")


def p3_rule_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return per_key_profile(table(spark, sf_dir, "dryrun_sample"), "rule_name", "label", "drawn_at", "sample_id", "weight")


def alert_side(df: DataFrame) -> DataFrame:
    return spread(df.select("uid", *CONTENT_FIELDS, "label", "ingested_at", "row_index")).select(
        uid_form(F.col("uid")).alias("uid"), *[plain_form(F.col(f)).alias(f) for f in CONTENT_FIELDS],
        plain_form(F.col("label")).alias("label"), "ingested_at", "row_index",
    )


def published_side(df: DataFrame) -> DataFrame:
    r = spread(df.select("uid", "record", "true_label")).withColumn("r", F.from_json("record", RECORD_AS_TEXT))
    return r.select(
        uid_form(F.col("uid")).alias("uid"), *[plain_form(F.col(f"r.{f}")).alias(f) for f in CONTENT_FIELDS], plain_form(F.col("true_label")).alias("label")
    )


def _differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff_tables(
        alert_side(table(spark, sf_dir, "secalertbench")), published_side(table(spark, sf_dir, "published")),
        "uid", [*CONTENT_FIELDS, "label"], ("secalertbench", "published"), newest_left=["ingested_at", "row_index"],
    )


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = ("only_secalertbench", "only_published", "differs")
    return _differences(spark, sf_dir).filter(F.col("kind").isin(*kinds)).select("uid", "kind", "field_name")


def p5_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per kind and field: keys concerned and their rows, with versions of a key that disagree and rows without a key."""
    return _differences(spark, sf_dir).groupBy("kind", "field_name").agg(F.count("uid").alias("n_keys"), F.sum("n_rows").alias("n_rows"))


QUERIES = {"p3_found": p3_found, "p3_rule_profile": p3_rule_profile, "p5_found": p5_found, "p5_report": p5_report}

PLAIN_SQL = r"regexp_replace(lower(CAST({} AS VARCHAR)), '[^\p{{L}}\p{{N}}]+', '', 'g')"
UID_SQL = r"regexp_replace(regexp_replace(lower({}), '^[\s\p{{Z}}]+', ''), '[\s\p{{Z}}]+$', '')"


def _plain_columns(source: str) -> str:
    return ", ".join(PLAIN_SQL.format(source.format(f)) + f" AS {f}" for f in CONTENT_FIELDS)


SQL = {
    "p3_found": f"""
        SELECT rule_name FROM dryrun_sample WHERE rule_name IS NOT NULL GROUP BY rule_name
        HAVING count(*) * 1000 >= {HEAVY_PERMILLE} * (SELECT count(*) FROM dryrun_sample)""",
    "p3_rule_profile": """
        WITH s AS (
          SELECT rule_name, drawn_at, CASE WHEN weight > 0 THEN weight ELSE 0 END AS w,
            CASE WHEN row_number() OVER o = 1 THEN 0 WHEN label IS NOT DISTINCT FROM lag(label) OVER o THEN 0 ELSE 1 END AS ch,
            (epoch_us(drawn_at) - epoch_us(lag(drawn_at) OVER o)) / 1e6 AS gap
          FROM dryrun_sample WINDOW o AS (PARTITION BY rule_name ORDER BY drawn_at NULLS FIRST, sample_id))
        SELECT rule_name, count(*) AS n_rows, round(sum(w), 6) AS weight_sum, sum(ch)::BIGINT AS n_changes,
          round(max(gap), 6) AS longest_gap_s, min(drawn_at) AS first_at, max(drawn_at) AS last_at
        FROM s GROUP BY rule_name""",
    "p5_found": f"""
        WITH a AS (
          SELECT {UID_SQL.format('uid')} AS uid, {_plain_columns('{}')}, {PLAIN_SQL.format('label')} AS label FROM secalertbench WHERE uid IS NOT NULL
          QUALIFY row_number() OVER (PARTITION BY {UID_SQL.format('uid')} ORDER BY ingested_at DESC, row_index DESC) = 1),
        b AS (
          SELECT DISTINCT {UID_SQL.format('uid')} AS uid, {_plain_columns("json_extract_string(record, '$.{}')")}, {PLAIN_SQL.format('true_label')} AS label
          FROM published WHERE uid IS NOT NULL),
        m AS (SELECT a.uid AS ua, b.uid AS ub, {", ".join(f"a.{f} IS DISTINCT FROM b.{f} AS d_{f}" for f in (*CONTENT_FIELDS, "label"))}
              FROM a FULL JOIN b ON a.uid = b.uid)
        SELECT ua AS uid, 'only_secalertbench' AS kind, 'row' AS field_name FROM m WHERE ub IS NULL
        UNION ALL SELECT ub, 'only_published', 'row' FROM m WHERE ua IS NULL
        """ + "".join(
        f" UNION ALL SELECT ua, 'differs', '{f}' FROM m WHERE ua IS NOT NULL AND ub IS NOT NULL AND d_{f}" for f in (*CONTENT_FIELDS, "label")
    ),
    "p5_report": f"""
        WITH a AS (
          SELECT {UID_SQL.format('uid')} AS uid, {_plain_columns('{}')}, {PLAIN_SQL.format('label')} AS label,
            row_number() OVER (PARTITION BY {UID_SQL.format('uid')} ORDER BY ingested_at DESC, row_index DESC) AS k, count(*) OVER (PARTITION BY {UID_SQL.format('uid')}) AS n FROM secalertbench),
        b AS (SELECT {UID_SQL.format('uid')} AS uid, {_plain_columns("json_extract_string(record, '$.{}')")}, {PLAIN_SQL.format('true_label')} AS label FROM published),
        l AS (SELECT * FROM a WHERE uid IS NOT NULL AND k = 1), r AS (SELECT uid, count(*) AS n FROM b WHERE uid IS NOT NULL GROUP BY uid),
        v AS (SELECT DISTINCT uid, x.f, x.v FROM (SELECT uid, unnest([{", ".join(f"{{'f': '{f}', 'v': {f}}}" for f in (*CONTENT_FIELDS, "label"))}]) AS x FROM b WHERE uid IS NOT NULL)),
        u AS (SELECT uid, f, v FROM v WHERE uid IN (SELECT uid FROM l) UNION SELECT uid, x.f, x.v FROM (SELECT uid, unnest([{", ".join(f"{{'f': '{f}', 'v': {f}}}" for f in (*CONTENT_FIELDS, "label"))}]) AS x FROM l WHERE uid IN (SELECT uid FROM r))),
        c AS (
          SELECT 'only_secalertbench' AS kind, 'row' AS field_name, uid, n FROM l WHERE uid NOT IN (SELECT uid FROM r)
          UNION ALL SELECT 'only_published', 'row', uid, n FROM r WHERE uid NOT IN (SELECT uid FROM l)
          UNION ALL SELECT 'differs', d.f, d.uid, l.n + r.n FROM (SELECT uid, f FROM u GROUP BY uid, f HAVING count(*) > 1) d JOIN l USING (uid) JOIN r USING (uid)
          UNION ALL SELECT 'versions_published', d.f, d.uid, r.n FROM (SELECT uid, f FROM v GROUP BY uid, f HAVING count(*) > 1) d JOIN r USING (uid)
          UNION ALL SELECT 'no_key_secalertbench', 'row', NULL, count(*) FROM a WHERE uid IS NULL HAVING count(*) > 0
          UNION ALL SELECT 'no_key_published', 'row', NULL, count(*) FROM b WHERE uid IS NULL HAVING count(*) > 0)
        SELECT kind, field_name, count(uid) AS n_keys, sum(n)::BIGINT AS n_rows FROM c GROUP BY kind, field_name""",
}
