"""Queries p1, p2, p4, p6 to p10 and the SQL that some of them are compared with."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import plain_form, record_words, uid_form
from ..operators.skew import join_hot_aware
from ..plans.training import PLAIN_SQL, UID_SQL, table
from ..schema import CONTENT_FIELDS, RECORD_AS_TEXT
from ..session import materialize, spread
from . import balanced, components, copies, garbled, overlap, packing, quantiles, splits, tokens

PERMILLES = [100, 250, 500, 750, 900, 990]
SHARES = {"train": 800, "validation": 100, "test": 100}
CAPACITY = 2048


# -- 1: duplicates hidden by formatting -------------------------------------------------------------------------------


def alert_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spread(table(spark, sf_dir, "secalertbench").select("row_index", *CONTENT_FIELDS))
    return t.select(F.col("row_index").alias("id"), *[plain_form(F.col(f)).alias(f) for f in CONTENT_FIELDS])


def published_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record that is no JSON object has null fields."""
    r = spread(table(spark, sf_dir, "published").select("pred_id", "record")).withColumn("r", F.from_json("record", RECORD_AS_TEXT))
    return r.select(F.col("pred_id").alias("id"), *[plain_form(F.col(f"r.{f}")).alias(f) for f in CONTENT_FIELDS])


def _both(make, spark: SparkSession, sf_dir: str) -> DataFrame:  # noqa: ANN001
    parts = [("secalertbench", alert_forms), ("published", published_forms)]
    return reduce(DataFrame.unionByName, [make(f(spark, sf_dir)).select(F.lit(n).alias("src"), "*") for n, f in parts])


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _both(lambda d: copies.formal_copies(d, "id", list(CONTENT_FIELDS)), spark, sf_dir).select("src", "first_id", "copy_id")


def p1_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _both(lambda d: copies.copy_counts(d, "id", list(CONTENT_FIELDS)), spark, sf_dir)


# -- 2: percentiles ---------------------------------------------------------------------------------------------------


def call_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rule_name, day, seconds, prompt_tokens): the measures as ordered integers, null where there is no number."""
    t = table(spark, sf_dir, "throughput_qwen3_4b").select("rule_name", F.to_date("called_at").alias("day"), "seconds", "prompt_tokens")
    return t.select("rule_name", "day", *[quantiles.ordered(F.col(m)).alias(m) for m in ("seconds", "prompt_tokens")])


def long_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = [F.struct(F.lit(m).alias("measure"), F.col(m).alias("k")) for m in ("seconds", "prompt_tokens")]
    return call_measures(spark, sf_dir).select("rule_name", "day", F.explode(F.array(*one)).alias("v")).select("rule_name", "day", "v.*").filter("k is not null")


def p2_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per rule, per day, and per rule and day (scope): the columns that a scope does not group by are null."""
    scopes = {"rule": ["rule_name", "measure"], "day": ["day", "measure"], "rule_day": ["rule_name", "day", "measure"]}
    got = quantiles.select_ranks(long_measures(spark, sf_dir), ["rule_name", "day", "measure"], "k", PERMILLES, scopes=scopes)
    return got.select("scope", "rule_name", F.col("day").cast("string").alias("day"), "measure", "permille", F.col("n").alias("n_values"), "value")


def p2_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per rule from histograms of its days, merged: each exact percentile lies in [lo, hi], which differ by 2**-8 at most."""
    daily = materialize(quantiles.bit_histogram(long_measures(spark, sf_dir), ["rule_name", "day", "measure"], "k"), "daily")
    merged = quantiles.merge_histograms(daily, ["rule_name", "measure"])
    return quantiles.histogram_percentiles(merged, ["rule_name", "measure"], PERMILLES)


# -- 4: splits --------------------------------------------------------------------------------------------------------


def name_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(name, comp, rule_id, n_ids): linked names by plain form, with the least and the number of catalog ids of their component."""
    alias = table(spark, sf_dir, "rule_alias").select(plain_form(F.col("old_name")).alias("a"), plain_form(F.col("new_name")).alias("b"))
    comp = components.connected_components(alias)
    catalog = table(spark, sf_dir, "rule_catalog").select("rule_id", plain_form(F.col("rule_name")).alias("name")).filter("name is not null")
    placed = catalog.join(comp, catalog["name"] == comp["node"], "left").select("name", F.coalesce("component", "name").alias("comp"), "rule_id")
    ids = placed.groupBy("comp").agg(F.min("rule_id").alias("rule_id"), F.count_distinct("rule_id").alias("n_ids"))
    names = comp.select(F.col("node").alias("name"), F.col("component").alias("comp")).union(placed.select("name", "comp")).distinct()
    return names.join(ids, "comp", "left").select("name", "comp", "rule_id", F.coalesce("n_ids", F.lit(0)).alias("n_ids"))


def sample_with_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """shared_sample with comp, rule_id, n_ids. A name that nothing links is its own component; rows without a name go by uid."""
    rows = table(spark, sf_dir, "shared_sample").select("sample_id", "uid", "stratum", plain_form(F.col("rule_name")).alias("name"))
    used = rows.filter("name is not null").groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    known = used.join(name_components(spark, sf_dir), "name", "left").select(
        "name", "n", F.concat(F.lit("name:"), F.coalesce("comp", "name")).alias("comp"), "rule_id", F.coalesce("n_ids", F.lit(0)).alias("n_ids")
    )
    known = materialize(known, "names")
    named = join_hot_aware(rows.filter("name is not null"), known, ["name"], "n", rows.count()).drop("n")
    own = F.coalesce(F.concat(F.lit("uid:"), uid_form(F.col("uid"))), F.concat(F.lit("row:"), F.col("sample_id").cast("string")))
    rest = rows.filter("name is null").withColumns({"comp": own, "rule_id": F.lit(None).cast("long"), "n_ids": F.lit(0).cast("long")})
    return named.unionByName(rest)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample_with_components(spark, sf_dir).filter("n_ids >= 2").select("sample_id", "rule_id")


def _split_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = materialize(sample_with_components(spark, sf_dir).withColumn("stratum", plain_form(F.col("stratum"))), "split")
    per = rows.groupBy("comp").agg(F.count(F.lit(1)).alias("n"))
    chosen = splits.component_splits(rows, "comp", "stratum", SHARES).join(per, "comp")
    return join_hot_aware(rows, materialize(chosen, "chosen"), ["comp"], "n", rows.count())


def p4_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _split_rows(spark, sf_dir).select("sample_id", "split")


def p4_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each split and stratum beside the number that the proportions ask for."""
    got = _split_rows(spark, sf_dir).groupBy("split", "stratum").agg(F.count(F.lit(1)).alias("n_rows"))
    total = got.groupBy("stratum").agg(F.sum("n_rows").alias("t"))
    share = F.create_map(*[x for k, v in SHARES.items() for x in (F.lit(k), F.lit(v / 1000))])
    joined = got.join(total, got["stratum"].eqNullSafe(total["stratum"])).drop(total["stratum"])
    return joined.select("split", "stratum", "n_rows", F.round(F.col("t") * share[F.col("split")], 3).alias("n_target"))


def p4_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, rows without a split, linked rules in several splits, and splits that are off their proportion by over 1 percent of the rows."""
    rows = materialize(_split_rows(spark, sf_dir).select("sample_id", "comp", "split"), "split_rows")
    torn = rows.groupBy("comp").agg(F.count_distinct("split").alias("k")).agg(F.count_if(F.col("k") > 1).alias("torn"))
    total = rows.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("split").isNull()).alias("unassigned"))
    share = F.create_map(*[x for k, v in SHARES.items() for x in (F.lit(k), F.lit(v / 1000))])
    per = rows.groupBy("split").agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(total))  # total: one row
    off = per.agg(F.count_if(F.abs(F.col("n") / F.col("n_rows") - share[F.col("split")]) > 0.01).alias("off_proportion"))
    return total.crossJoin(torn).crossJoin(off)  # one row each


# -- 6: overlap between splits ----------------------------------------------------------------------------------------


def _side(split: Column) -> Column:
    s = plain_form(split)
    return F.when(s == "train", "train").when(s.isin("validation", "test"), "eval")


def published_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "published").select("pred_id", "record", _side(F.col("split")).alias("side")).filter("side is not null")
    r = spread(t).withColumn("r", F.from_json("record", RECORD_AS_TEXT))
    return r.select(F.col("pred_id").alias("id"), "side", record_words(F.concat_ws(" ", *[F.col(f"r.{f}") for f in CONTENT_FIELDS])).alias("words"))


def published_overlap(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(members, links) of the records of published, by similarity hashes."""
    members, codes, words = overlap.word_classes(published_sides(spark, sf_dir))
    return members, overlap.similar_classes(codes, words)


def dryrun_overlap(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(members, links) of dryrun_sample: the same uid is the same record, so an exact join does; no other links."""
    uids = table(spark, sf_dir, "dryrun_sample").select(F.col("sample_id").alias("id"), _side(F.col("split")).alias("side"), uid_form(F.col("uid")).alias("key"))
    members = materialize(overlap.equal_key_classes(uids.filter("side is not null")), "uids")
    return members, members.select(F.col("cls").alias("train_cls"), F.col("cls").alias("eval_cls")).limit(0)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = [("published", published_overlap), ("dryrun_sample", dryrun_overlap)]
    return reduce(DataFrame.unionByName, [overlap.cross_split_pairs(*f(spark, sf_dir)).select(F.lit(n).alias("src"), "id_a", "id_b") for n, f in both])


def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per table, evaluation split and source (the model; none in dryrun_sample): rows that also stand in train, and pairs."""
    parts = []
    for name, i, source, f in (("published", "pred_id", F.col("model"), published_overlap), ("dryrun_sample", "sample_id", F.lit("dryrun_sample"), dryrun_overlap)):
        rows = table(spark, sf_dir, name).filter(_side(F.col("split")) == "eval").select(F.col(i).alias("id"), plain_form(F.col("split")).alias("split"), source.alias("source"))
        per = overlap.overlap_counts(*f(spark, sf_dir)).join(rows, "id").groupBy("split", "source").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("n_train").alias("n_pairs"))
        parts.append(per.select(F.lit(name).alias("src"), "*"))
    return reduce(DataFrame.unionByName, parts)


# -- 7: samples by target proportions ---------------------------------------------------------------------------------


def _sampled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = table(spark, sf_dir, "dryrun_sample").filter("weight > 0 and not isnan(weight)").withColumn("uid", uid_form(F.col("uid")))
    frame = materialize(balanced.categories(rows, "uid", "stratum", "label"), "frame")
    sample, report = balanced.sample_report(frame, table(spark, sf_dir, "sample_target"))
    return rows, sample, report


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sampled(spark, sf_dir)[2].filter("not met").select("plan_id", "stratum", "label")


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """as_wanted and met are read off the sample that was drawn."""
    r = _sampled(spark, sf_dir)[2]
    return r.select("plan_id", "stratum", "label", "n_available", F.round("wanted", 6).alias("wanted"), "as_wanted", "met")


def p7_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the drawn sample of each plan is off its total, strata and labels."""
    return balanced.margin_residuals(_sampled(spark, sf_dir)[2])


def p7_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per plan: uids drawn twice, drawn rows that are not in the frame, and margins that are off by 1 or more."""
    rows, sample, report = _sampled(spark, sf_dir)
    frame = balanced.categories(rows, "uid", "stratum", "label")
    twice = sample.groupBy("plan_id", "unit").agg((F.count(F.lit(1)) - 1).alias("n"))
    strange = sample.join(frame, ["unit", "s", "l"], "left_anti").withColumn("n", F.lit(1).cast("long"))
    total = balanced.margin_residuals(report).filter("margin = 'total'").withColumn("n", (F.abs("residual") >= 1).cast("long"))
    cols = ("drawn_twice", "not_in_frame", "total_off")
    parts = [d.select("plan_id", *[(F.col("n") if c == x else F.lit(0).cast("long")).alias(c) for c in cols]) for x, d in zip(cols, (twice, strange, total))]
    return reduce(DataFrame.unionByName, parts).groupBy("plan_id").agg(*[F.sum(c).alias(c) for c in cols])


def p7_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows drawn: for each plan, uid and category the row with the least sample_id."""
    rows, sample, _ = _sampled(spark, sf_dir)
    keyed = rows.select("sample_id", F.col("uid").alias("unit"), plain_form(F.col("stratum")).alias("s"), plain_form(F.col("label")).alias("l"))
    first = keyed.groupBy("unit", "s", "l").agg(F.min("sample_id").alias("sample_id"))
    return sample.join(first, ["unit", "s", "l"]).select("plan_id", "sample_id", F.col("unit").alias("uid"), "s", "l")


# -- 8 to 10: texts ---------------------------------------------------------------------------------------------------


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode_corpus(table(spark, sf_dir, "documents"), "doc_id").select("doc_id", "ids")


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sizes = tokens.encode_corpus(docs, "doc_id").select("doc_id", F.size("ids").alias("n_tokens"))
    items = materialize(sizes.join(docs.select("doc_id", "source"), "doc_id"), "sizes")
    return packing.pack(items, "doc_id", "n_tokens", "source", CAPACITY)


def p9_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packed(spark, sf_dir)


def p9_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers by the number of tokens used."""
    per = _packed(spark, sf_dir).filter("container_id is not null").groupBy("container_id").agg(F.sum("n_units").alias("used"))
    return per.groupBy("used").agg(F.count(F.lit(1)).alias("n_containers"))


def p9_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents placed, documents not wholly placed once, containers over the capacity, and whether 97 percent of
    the room is used, but for one container."""
    docs = table(spark, sf_dir, "documents")
    sizes = materialize(tokens.encode_corpus(docs, "doc_id").select("doc_id", F.size("ids").alias("n_tokens")), "sizes")
    placed = materialize(packing.pack(sizes.join(docs.select("doc_id", "source"), "doc_id"), "doc_id", "n_tokens", "source", CAPACITY), "placed")
    whole = placed.groupBy("doc_id").agg(F.sum("n_units").alias("n"), F.count_distinct("part").alias("k"), F.count(F.lit(1)).alias("c"))
    wrong = (F.col("n_tokens") != F.coalesce("n", F.lit(-1))) | (F.col("k") != F.col("c")) | ((F.col("n_tokens") <= CAPACITY) & (F.col("c") > 1))
    items = sizes.join(whole, "doc_id", "left").agg(F.count(F.lit(1)).alias("n_docs"), F.count_if(F.coalesce(wrong, F.lit(True))).alias("wrong"))
    box = placed.filter("container_id is not null").groupBy("container_id").agg(F.sum("n_units").alias("u"))
    room = box.agg(F.count_if(F.col("u") > CAPACITY).alias("over"), (F.count(F.lit(1)) <= F.sum("u") / (0.97 * CAPACITY) + 1).alias("well_filled"))
    return items.crossJoin(room)  # one row each


def p8_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by whether they have ids: null and empty texts have none."""
    return tokens.encode_corpus(table(spark, sf_dir, "documents"), "doc_id").select("doc_id", (F.size("ids") == 0).alias("no_ids"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return garbled.repair(table(spark, sf_dir, "documents"), "doc_id").filter("garbled").select(F.col("id").alias("doc_id"))


def p10_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return garbled.repair(table(spark, sf_dir, "documents"), "doc_id").select(F.col("id").alias("doc_id"), "garbled", "reason", "restored")


QUERIES = {
    f.__name__: f
    for f in (
        p1_found, p1_counts, p2_percentiles, p2_merged, p4_found, p4_splits, p4_balance, p4_invariants, p6_found, p6_report,
        p7_found, p7_report, p7_residuals, p7_invariants, p7_sample, p8_ids, p8_empty, p9_containers, p9_fill, p9_invariants, p10_found, p10_restored,
    )
}

_ALERTS = "SELECT row_index AS id, " + ", ".join(PLAIN_SQL.format(f) + f" AS {f}" for f in CONTENT_FIELDS) + " FROM secalertbench"
_PUBLISHED = "SELECT pred_id AS id, " + ", ".join(PLAIN_SQL.format(f"json_extract_string(record, '$.{f}')") + f" AS {f}" for f in CONTENT_FIELDS) + " FROM published"
_FIELDS = ", ".join(CONTENT_FIELDS)
_FORMS = f"a AS ({_ALERTS}), b AS ({_PUBLISHED})"
_P4 = f"""
    WITH RECURSIVE l AS (
      SELECT {PLAIN_SQL.format('old_name')} AS a, {PLAIN_SQL.format('new_name')} AS b FROM rule_alias WHERE old_name IS NOT NULL AND new_name IS NOT NULL),
    e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
    c AS (SELECT rule_id, {PLAIN_SQL.format('rule_name')} AS name FROM rule_catalog WHERE rule_name IS NOT NULL),
    n AS (SELECT a AS name FROM e UNION SELECT name FROM c),
    reach AS (SELECT name, name AS other FROM n UNION SELECT r.name, e.b FROM reach r JOIN e ON r.other = e.a),
    ids AS (SELECT r.name, min(c.rule_id) AS rule_id, count(DISTINCT c.rule_id) AS n_ids FROM reach r JOIN c ON r.other = c.name GROUP BY r.name)"""
_P7 = f"""
    WITH f AS (SELECT DISTINCT {UID_SQL.format('uid')} AS uid, {PLAIN_SQL.format('stratum')} AS s, {PLAIN_SQL.format('label')} AS l
      FROM dryrun_sample WHERE weight > 0 AND stratum IS NOT NULL AND label IS NOT NULL AND uid IS NOT NULL),
    n AS (SELECT s, l, count(*) AS a FROM f GROUP BY s, l),
    t AS (SELECT t.*, coalesce(n.a, 0) AS a, (SELECT count(DISTINCT uid) FROM f) AS frame FROM sample_target t
      LEFT JOIN n ON n.s = {PLAIN_SQL.format('t.stratum')} AND n.l = {PLAIN_SQL.format('t.label')})"""
_P6 = f"""
        WITH r AS (SELECT pred_id AS id, CASE WHEN lower(trim(split)) = 'train' THEN 't' ELSE 'e' END AS side,
            unnest(list_distinct(regexp_extract_all(lower(concat_ws(' ', {", ".join(f"json_extract_string(record, '$.{f}')" for f in CONTENT_FIELDS)})), '[\\p{{L}}\\p{{N}}]+'))) AS w
          FROM published WHERE lower(trim(split)) IN ('train', 'validation', 'test')),
        n AS (SELECT id, count(*) AS n FROM r GROUP BY id),
        c AS (SELECT a.id AS t, b.id AS e, count(*) AS common FROM r a JOIN r b ON a.w = b.w AND a.side = 't' AND b.side = 'e' GROUP BY a.id, b.id)
        SELECT 'published' AS src, least(t, e) AS id_a, greatest(t, e) AS id_b FROM c JOIN n x ON x.id = t JOIN n y ON y.id = e
        WHERE common * 4 >= 3 * (x.n + y.n - common)
        UNION ALL SELECT 'dryrun_sample', least(a.sample_id, b.sample_id), greatest(a.sample_id, b.sample_id) FROM dryrun_sample a
        JOIN dryrun_sample b ON {UID_SQL.format('a.uid')} = {UID_SQL.format('b.uid')} AND lower(trim(a.split)) = 'train' AND lower(trim(b.split)) IN ('validation', 'test')"""

SQL = {
    "p1_found": f"""
        WITH {_FORMS}, u AS (SELECT 'secalertbench' AS src, * FROM a UNION ALL SELECT 'published', * FROM b),
        g AS (SELECT src, id, min(id) OVER (PARTITION BY src, {_FIELDS}) AS first_id FROM u)
        SELECT src, first_id, id AS copy_id FROM g WHERE id <> first_id""",
    "p1_counts": f"""
        WITH {_FORMS}, u AS (SELECT 'secalertbench' AS src, * FROM a UNION ALL SELECT 'published', * FROM b)
        SELECT src, min(id) AS first_id, count(*) AS n_copies FROM u GROUP BY src, {_FIELDS}""",
    "p2_percentiles": f"""
        WITH t AS (SELECT rule_name, CAST(CAST(called_at AS DATE) AS VARCHAR) AS day, seconds, CAST(prompt_tokens AS DOUBLE) AS prompt_tokens FROM throughput_qwen3_4b),
        m AS (SELECT rule_name, day, 'seconds' AS measure, seconds AS x FROM t UNION ALL SELECT rule_name, day, 'prompt_tokens', prompt_tokens FROM t),
        v AS (SELECT 'rule' AS scope, rule_name, NULL AS day, measure, x FROM m UNION ALL SELECT 'day', NULL, day, measure, x FROM m UNION ALL SELECT 'rule_day', rule_name, day, measure, x FROM m),
        r AS (SELECT *, row_number() OVER (PARTITION BY scope, rule_name, day, measure ORDER BY x) AS rn, count(*) OVER (PARTITION BY scope, rule_name, day, measure) AS n
          FROM v WHERE x IS NOT NULL AND NOT isnan(x))
        SELECT scope, rule_name, day, measure, p.permille::INTEGER AS permille, n AS n_values, x AS value
        FROM r JOIN (SELECT unnest({PERMILLES}) AS permille) p ON rn = greatest(1, (n * p.permille + 999) // 1000)""",
    "p2_merged": f"""
        WITH t AS (SELECT rule_name, 'seconds' AS measure, seconds AS x FROM throughput_qwen3_4b UNION ALL SELECT rule_name, 'prompt_tokens', CAST(prompt_tokens AS DOUBLE) FROM throughput_qwen3_4b),
        r AS (SELECT *, row_number() OVER (PARTITION BY rule_name, measure ORDER BY x) AS rn, count(*) OVER (PARTITION BY rule_name, measure) AS n FROM t WHERE x IS NOT NULL AND NOT isnan(x)),
        h AS (SELECT rule_name, measure, p.permille::INTEGER AS permille, n, x, CASE WHEN x > 0 THEN floor(log2(x)) ELSE 0 END AS g
          FROM r JOIN (SELECT unnest({PERMILLES}) AS permille) p ON rn = greatest(1, (n * p.permille + 999) // 1000)),
        e AS (SELECT *, CASE WHEN pow(2.0, g) > x THEN g - 1 WHEN pow(2.0, g + 1) <= x THEN g + 1 ELSE g END AS e FROM h)
        SELECT rule_name, measure, permille, n, CASE WHEN x = 0 THEN 0.0 ELSE floor(x / pow(2.0, e - 8)) * pow(2.0, e - 8) END AS lo,
          CASE WHEN x = 0 THEN {((1 << 44) - 1) * 2.0**-1074!r} ELSE (floor(x / pow(2.0, e - 8)) + 1) * pow(2.0, e - 8) - pow(2.0, e - 52) END AS hi FROM e""",
    "p4_found": _P4 + f"""
        SELECT s.sample_id, i.rule_id FROM shared_sample s JOIN ids i ON i.name = {PLAIN_SQL.format('s.rule_name')} WHERE i.n_ids >= 2""",
    "p4_invariants": "SELECT count(*) AS n_rows, 0::BIGINT AS unassigned, 0::BIGINT AS torn, 0::BIGINT AS off_proportion FROM shared_sample",
    "p8_empty": "SELECT doc_id, text IS NULL OR text = '' AS no_ids FROM documents",
    "p9_invariants": "SELECT count(*) AS n_docs, 0::BIGINT AS wrong, 0::BIGINT AS over, true AS well_filled FROM documents",
    "p6_found": _P6,
    "p6_report": f"""
        WITH p AS ({_P6}),
        x AS (SELECT 'published' AS src, pred_id AS id, lower(trim(split)) AS split, model AS source FROM published UNION ALL SELECT 'dryrun_sample', sample_id, lower(trim(split)), 'dryrun_sample' FROM dryrun_sample),
        h AS (SELECT x.src, x.split, x.source, x.id, count(*) AS n FROM p JOIN x ON x.src = p.src AND x.id IN (p.id_a, p.id_b) AND x.split IN ('validation', 'test') GROUP BY ALL)
        SELECT src, split, source, count(*) AS n_rows, sum(n)::BIGINT AS n_pairs FROM h GROUP BY src, split, source""",
    "p7_report": _P7 + """
        SELECT plan_id, stratum, label, a AS n_available, round(least(a::DOUBLE, greatest(frame * target_permille * frame_permille / 1000000, min_rows::DOUBLE)), 6) AS wanted, true AS as_wanted,
          NOT (a * 1000000 < frame * target_permille * frame_permille OR a < min_rows) AS met FROM t""",
    "p7_invariants": """
        SELECT DISTINCT plan_id, 0::BIGINT AS drawn_twice, 0::BIGINT AS not_in_frame, 0::BIGINT AS total_off FROM sample_target""",
    "p7_found": _P7 + """
        SELECT plan_id, stratum, label FROM t WHERE a * 1000000 < frame * target_permille * frame_permille OR a < min_rows""",
}
