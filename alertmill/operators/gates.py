"""Acceptance gates: named checks that each return one row (passed, detail)."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.keys import classifier_text, indented_json
from ..functions.labels import parse_label
from ..schema import ATTACK, CONDITIONS, NON_ATTACK, STRATA, fields_of
from . import audit, metrics, reports, runlog
from .frame import concentration, inverse_probability_weights

GATES: dict[str, Callable[[dict], DataFrame]] = {}


def gate(name: str) -> Callable:
    def add(f: Callable[[dict], DataFrame]) -> Callable[[dict], DataFrame]:
        GATES[name] = f
        return f

    return add


def _row(df: DataFrame, passed, detail) -> DataFrame:  # noqa: ANN001
    return df.select(F.coalesce(passed, F.lit(False)).alias("passed"), detail.cast("string").alias("detail"))


def _all_true(df: DataFrame, n: str = "n") -> DataFrame:
    """Passes if the count in column n is 0."""
    return _row(df, F.col(n) == 0, F.col(n))


@gate("sample rebuilds to the same rows")
def rebuild(x: dict) -> DataFrame:
    r = audit.same_rows(x["sample"](), x["sample"]())
    return _row(r, F.col("same"), F.col("only_a") + F.col("only_b"))


@gate("phases of the sample are disjoint")
def disjoint(x: dict) -> DataFrame:
    return _all_true(x["sample"]().groupBy("uid").agg(F.count(F.lit(1)).alias("c")).agg(F.count_if(F.col("c") > 1).alias("n")))


@gate("strata of the sample are exact")
def exact_strata(x: dict) -> DataFrame:
    """Every stratum has in each phase what was asked for, or all that the frame holds of it."""
    have = x["frame"].groupBy("stratum").agg(F.count(F.lit(1)).alias("all"))
    got = x["sample"]().groupBy("stratum").agg(*[F.count_if(F.col("phase") == p).alias(p) for p in x["phases"]])
    want, left = [], F.col("all")
    for p, n in x["phases"].items():
        want.append(F.coalesce(p, F.lit(0)) != F.least(F.lit(n), left))
        left = F.greatest(left - n, F.lit(0))
    return _all_true(have.join(got, "stratum", "left").agg(F.count_if(reduce(lambda a, b: a | b, want)).alias("n")))


@gate("weights of the strata are those recorded")
def weights(x: dict) -> DataFrame:
    """To four decimals; a stratum on one side only differs."""
    now = inverse_probability_weights(x["frame"]).select("stratum", F.bround("weight", 4).alias("_w"))
    j = x["weights"].select("stratum", F.bround("weight", 4).alias("_r")).join(now, "stratum", "full_outer")
    return _all_true(j.agg(F.count_if(~F.col("_w").eqNullSafe(F.col("_r"))).alias("n")))


@gate("frame has no uid collisions")
def unique_uids(x: dict) -> DataFrame:
    return _all_true(x["frame"].agg((F.count(F.lit(1)) - F.count_distinct("uid")).alias("n")))


@gate("prompts show what their condition leaves")
def prompts(x: dict) -> DataFrame:
    """Read back from the rendered text: the keys are the condition's fields in order, the values those of the alert."""
    off = []
    for c in CONDITIONS:
        fields, text = fields_of(c), F.col(f"_{c}")
        shown = F.from_json(text, T.MapType(T.StringType(), T.StringType()))
        same = F.json_object_keys(text) == F.array(*[F.lit(f) for f in fields])
        off.append(F.count_if(~F.coalesce(reduce(lambda a, b: a & b, [shown[f].eqNullSafe(F.col(f).cast("string")) for f in fields], same), F.lit(False))))
    rendered = x["alerts"].select("*", *[indented_json(F.struct(*fields_of(c))).alias(f"_{c}") for c in CONDITIONS])
    return _all_true(rendered.agg(reduce(lambda a, b: a + b, off).alias("n")))


@gate("parser agrees with a plain reading of answers")
def parser(x: dict) -> DataFrame:
    def plain(answer: str | None) -> str | None:
        words = (answer or "").strip()
        return words if words in (ATTACK, NON_ATTACK) else next((w for w in (NON_ATTACK, ATTACK) if w in words), None)

    made = [None, "", " ", *[pre + w + post for w in (ATTACK, NON_ATTACK, "attack", "none") for pre in ("", " ", "Verdict: ") for post in ("", ".", "\n", f" rather than {ATTACK}")]]
    cases = x["spark"].createDataFrame([(m, plain(m)) for m in made], "answer string, want string")
    return _all_true(cases.agg(F.count_if(~parse_label(F.col("answer")).eqNullSafe(F.col("want"))).alias("n")))


@gate("classifier texts equal a second construction")
def texts(x: dict) -> DataFrame:
    """Record by record in Python against the column expression, under every condition, and without the prompt's own words."""
    kinds = dict(x["alerts"].dtypes)

    def second(fields: list[str]):  # noqa: ANN202
        def build(values: pd.DataFrame) -> pd.Series:
            lines = [["" if v is None or v != v else unicodedata.normalize("NFC", v if isinstance(v, str) else str(int(v))) for v in r] for r in values[fields].astype(object).to_numpy()]
            return pd.Series(["\n".join(r).replace("\r\n", "\n").replace("\r", "\n").lower() for r in lines])

        return F.pandas_udf(build, T.StringType())

    off = []
    for c in CONDITIONS:
        text, other = classifier_text(fields_of(c), kinds), second(fields_of(c))(F.struct(*fields_of(c)))
        off.append(((~text.eqNullSafe(other)) | F.contains(text, F.lit(x["header"].strip().lower()))).cast("int"))
    return _all_true(x["alerts"].select(reduce(lambda a, b: a + b, off).alias("_o")).agg(F.coalesce(F.sum("_o"), F.lit(0)).alias("n")))


@gate("prompts fit the context")
def context_fit(x: dict) -> DataFrame:
    r = reports.over_limit(x["calls"], [], "prompt_tokens", 8176)
    return _row(r, F.col("over_limit") == 0, F.col("longest"))


@gate("no call is lost in transport")
def transport(x: dict) -> DataFrame:
    """Every call that was tried has an attempt that ended well."""
    last = runlog.last_attempts(x["attempts"])
    return _all_true(last.agg(F.count_if(F.col("n_ok") == 0).alias("n")))


@gate("invalid answers at most a tenth of each class")
def validity(x: dict) -> DataFrame:
    cells = reports.grouped_cells(x["calls"], ["truth"]).agg(F.max("invalid_rate").alias("r"))
    return _row(cells, F.col("r") <= 0.10, F.round("r", 6))


@gate("scores cover 95 percent of each class")
def coverage(x: dict) -> DataFrame:
    cells = reports.grouped_cells(x["calls"], ["truth"]).agg(F.min("score_coverage").alias("r"))
    return _row(cells, F.col("r") >= 0.95, F.round("r", 6))


@gate("repeated calls give the same labels and scores")
def determinism(x: dict) -> DataFrame:
    r = audit.compare_runs(*x["runs"], ["uid"], "pred", "score")
    same = (F.col("identical_labels") == F.col("paired")) & (F.col("availability_identical") == F.col("paired")) & (F.coalesce("max_abs_delta", F.lit(0.0)) < 1e-3)
    return _row(r, same, F.col("paired") - F.col("identical_labels"))


@gate("a stopped run resumes to the expected calls, once each")
def resume(x: dict) -> DataFrame:
    """Stopped after the calls of half of the ids, resumed twice: nothing is missing, nothing is sent again."""
    expected = x["expected"].select("call_id")
    half = expected.filter(F.pmod(F.xxhash64("call_id"), F.lit(2)) == 0)
    once = runlog.append_once(half, runlog.pending(expected, half))
    again = runlog.append_once(once, runlog.pending(expected, once).unionByName(half))
    return _row(r := audit.same_rows(again, expected), F.col("same"), F.col("only_a") + r["only_b"])


@gate("metrics equal the published summaries")
def published(x: dict) -> DataFrame:
    """x["summaries"] (model, tp, fp, tn, fn, f1) against what the rows give, to six decimals."""
    now = metrics.zero_rates(metrics.confusion(x["judged"], ["model"], None, "exclude"))
    r = reports.reported_vs_recomputed(x["summaries"], now, "model", ["tp", "fp", "tn", "fn", "f1"])
    return _all_true(r.agg(F.count_if(~F.col("same")).alias("n")))


@gate("rank auroc equals counting all pairs")
def auroc_pairs(x: dict) -> DataFrame:
    made = [(ATTACK if i * 7 % 5 < 2 else NON_ATTACK, (i * i % 11) / 10, 1 + i % 3 / 2) for i in range(60)]
    rows = x["spark"].createDataFrame(made, "truth string, score double, w double")
    pos = [(s, w) for t, s, w in made if t == ATTACK]
    neg = [(s, w) for t, s, w in made if t == NON_ATTACK]
    want = sum(a * b * ((s > r) + (s == r) / 2) for s, a in pos for r, b in neg) / (sum(w for _, w in pos) * sum(w for _, w in neg))
    got = metrics.auroc(rows, [], weight="w").select(F.abs(F.col("auroc") - want).alias("d"))
    return _row(got, F.col("d") < 1e-12, F.col("d") < 1e-12)


@gate("answers cut off at most 2 percent")
def truncation(x: dict) -> DataFrame:
    r = x["calls"].agg((F.count_if(F.col("completion_tokens") >= x["most_completion_tokens"]) / F.count(F.lit(1))).alias("r"))
    return _row(r, F.coalesce("r", F.lit(0.0)) <= 0.02, F.round("r", 6))


@gate("concentration of the sample is that recorded")
def concentration_recorded(x: dict) -> DataFrame:
    r = audit.same_rows(concentration(x["frame"]), x["concentration"])
    return _row(r, F.col("same"), F.col("only_a") + F.col("only_b"))


@gate("folds share no rule and no content")
def folds(x: dict) -> DataFrame:
    r = reports.fold_report(x["folds"], list(STRATA)).agg(F.sum(F.col("rule_overlap") + F.col("key_overlap")).alias("n"))
    return _all_true(r)


@gate("folds are those recorded")
def folds_recorded(x: dict) -> DataFrame:
    r = audit.same_rows(x["folds"].select("uid", "fold"), x["recorded_folds"].select("uid", "fold"))
    return _row(r, F.col("same"), F.col("only_a") + F.col("only_b"))


@gate("projected time below the limit")
def projection(x: dict) -> DataFrame:
    seconds = x["calls"].filter(F.col("seconds").isNotNull() & ~F.isnan("seconds"))
    r = seconds.agg((F.avg("seconds") * 3000 / 3600).alias("h"))
    return _row(r, F.col("h") < 20, F.round("h", 3))


def run_gates(inputs: dict, names: list[str] | None = None) -> DataFrame:
    """(gate, passed, detail): one row per gate; unknown names raise."""
    chosen = names or list(GATES)
    parts = [GATES[n](inputs).select(F.lit(n).alias("gate"), "passed", "detail") for n in chosen]
    return reduce(DataFrame.unionByName, parts)
