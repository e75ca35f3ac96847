import gzip
import hashlib
import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from alertmill.operators import audit, gates, runlog, scoring
from alertmill.session import materialize
from alertmill.sources import files
from alertmill.streaming import runlog as stream

CALLS = "call_id string, row_index long, harness string, status string"
TRY = "call_id string, attempt long, status string"


def test_clean_and_corrupted_runs(spark):
    expected = spark.createDataFrame([("c1", 1), ("c2", 2), ("c3", 3)], "call_id string, row_index long")
    calls = spark.createDataFrame([("c1", 1, "h", "ok"), ("c2", 2, "h", "invalid"), ("c3", 3, "h", "ok")], CALLS)
    tries = spark.createDataFrame([("c1", 1, "error"), ("c1", 2, "ok"), ("c2", 1, "ok"), ("c3", 1, "ok")], TRY)
    r = runlog.validate_run(expected, calls, tries, ["row_index"]).first()
    assert r["passes"] and r["complete"] and r["problems"] == "" and r["invalid"] == 1
    bad = spark.createDataFrame([("c1", 1, "h", "ok"), ("c1", 1, "h", "ok"), ("c2", 9, "g", "ok"), ("c9", 1, "h", "ok")], CALLS)
    tries = spark.createDataFrame([("c1", 1, "ok"), ("c1", 2, "ok"), ("c2", 1, "error"), ("c3", 1, "fatal"), ("c9", 1, "ok")], TRY)
    r = runlog.validate_run(expected, bad, tries, ["row_index"], torn_tail=True).first()
    assert not r["passes"] and not r["complete"]
    assert r["problems"] == "duplicates,bad_lines,unexpected,mismatches,harnesses,resent,no_attempt"
    assert (r["missing"], r["unexpected"], r["failed"]) == (1, 1, 1)


def test_resume_appends_once(spark, rows):
    log = spark.createDataFrame([("c1",)], "call_id string")
    new = spark.createDataFrame([("c1",), ("c2",), ("c2",)], "call_id string")
    assert rows(runlog.append_once(log, new)) == [("c1",), ("c2",)]
    assert rows(runlog.pending(new.distinct(), log)) == [("c2",)]
    with pytest.raises(ValueError):
        runlog.refuse_duplicates(new)
    assert runlog.start_refusals(False, None, "h", None, "x") == []
    assert len(runlog.start_refusals(True, "old", "h", "y", "x")) == 3


LOG = T.StructType([T.StructField("call_id", T.StringType())])


def test_numbered_lines_across_blocks(spark, tmp_path):
    """Files that several tasks read in blocks: numbers go on from block to block, blank lines count."""
    lines = {"a.jsonl": [f"line {i} " + "x" * (i % 50) for i in range(3000)], "b.jsonl": ["", "é", "", "last"], "c.jsonl": ["only"]}
    for n, body in lines.items():
        (tmp_path / n).write_text("\n".join(body) + ("" if n == "b.jsonl" else "\n"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got, found = files.numbered_lines(spark, str(tmp_path))
        assert got.rdd.getNumPartitions() > 3
        rows = [(r["file"].rsplit("/", 1)[1], r["line_no"], r["value"]) for r in got.collect()]
        marks = {r["file"].rsplit("/", 1)[1]: (r["n_lines"], r["torn"]) for r in found.collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted(rows) == sorted((n, i, v) for n, body in lines.items() for i, v in enumerate(body, 1))
    assert marks == {"a.jsonl": (3000, False), "b.jsonl": (4, True), "c.jsonl": (1, False)}


def test_tolerant_and_recovering_scans(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    (log / "1.jsonl").write_text('{"call_id": "x1"}\n\n{"call_id": "x2"}\n')
    (log / "2.jsonl").write_text('{"call_id": "x3"}\n{"call_')
    good, bad, found = files.read_tolerant(spark, str(log), LOG)
    assert sorted(r[0] for r in good.collect()) == ["x1", "x2", "x3"]
    assert [(r["line_no"], r["value"]) for r in bad.collect()] == [(2, '{"call_')] and found.filter("torn").count() == 1
    aside = str(tmp_path / "aside")
    kept = files.recover_log(spark, str(log), LOG, aside)
    assert kept.count() == 3 and [r["value"] for r in spark.read.json(aside).collect()] == ['{"call_']
    (log / "3.jsonl").write_text('{"call_id": "x1"}\n')
    with pytest.raises(ValueError, match="duplicate"):
        files.recover_log(spark, str(log), LOG, aside)
    (log / "3.jsonl").write_text('{"call_id": \n{"call_id": "x9"}\n')
    with pytest.raises(ValueError, match="bad lines"):
        files.recover_log(spark, str(log), LOG, aside)
    with pytest.raises(Exception):  # noqa: B017, PT011
        files.read_jsonl(spark, str(log), "call_id string").collect()
    one = str(tmp_path / "own.jsonl")
    files.append_durably(one, {"call_id": "x4"})
    files.append_durably(one, {"call_id": "x5"})
    assert files.recover_log(spark, one, LOG, aside).count() == 2


def test_array_file_with_pin_and_order(spark, tmp_path):
    p = tmp_path / "d.json"
    p.write_text(json.dumps([{"b": 1, "a": "x"}, {"b": None, "a": "y"}]))
    schema = T.StructType([T.StructField("b", T.LongType()), T.StructField("a", T.StringType())])
    pin = files.sha256_text(p.read_text())
    got = files.read_array_file(spark, str(p), schema, pin, in_order=True)
    assert got.columns == ["row_index", "b", "a"] and sorted(map(tuple, got.collect())) == [(0, 1, "x"), (1, None, "y")]
    with pytest.raises(ValueError):
        files.read_array_file(spark, str(p), schema, "0" * 64)
    p.write_text(json.dumps([{"b": 1, "a": "x"}, {"a": "y", "b": None}]))
    assert files.read_array_file(spark, str(p), schema).count() == 2
    with pytest.raises(PySparkException):
        files.read_array_file(spark, str(p), schema, in_order=True).collect()


def _array_rows(n):
    texts = ['],[{"', "\\", '\\"', "it's, é \\\\\"", "}" * 40, "x" * 300, "\n\t", ""]
    return [{"b": i if i % 7 else None, "a": texts[i % len(texts)] * (i % 3 + 1)} for i in range(n)]


def test_array_file_is_read_in_blocks(spark, tmp_path):
    """Blocks that begin anywhere, in strings and behind backslashes, give the rows that a read of the whole file gives."""
    schema = T.StructType([T.StructField("b", T.LongType()), T.StructField("a", T.StringType())])
    made = _array_rows(200)
    for name, text in {"dense": json.dumps(made), "wide file": json.dumps(made, indent=2, ensure_ascii=False) + "\n" * 99}.items():
        (tmp_path / f"{name}.json").write_text(text)
        with gzip.open(tmp_path / f"{name}.json.gz", "wt") as f:
            f.write(text)
    whole = [(i, r["b"], r["a"]) for i, r in enumerate(made)]
    for path in ("dense.json", "wide file.json", "dense.json.gz"):
        for block in (97, 1000, files.BLOCK):
            got = files.read_array_file(spark, f"{tmp_path}/{path}", schema, in_order=True, block=block)
            assert sorted(map(tuple, got.collect())) == whole
    read = files.read_array_file(spark, f"{tmp_path}/*", schema, block=1000)  # positions of each file
    assert sorted(map(tuple, read.collect())) == sorted(whole * 4)
    parts = files.read_array_file(spark, f"{tmp_path}/dense.json", schema, block=97).select(F.spark_partition_id()).distinct().count()
    assert parts > 1


DAMAGED = [
    lambda t: t[:-1], lambda t: t[:-2], lambda t: t[:700], lambda t: t[1:], lambda t: t + t, lambda t: t + " x", lambda t: "x" + t, lambda t: "", lambda t: "null", lambda t: t[1:-1], lambda t: t[:-1] + "}",
    lambda t: t.replace("}, {", "} {"), lambda t: t.replace("}, {", "}, , {"), lambda t: t.replace("}, {", "} 1, {"), lambda t: t[:-1] + ",]", lambda t: t.replace('{"b"', "{'b'"),
]


def test_damaged_array_files_raise(spark, tmp_path):
    p, schema = tmp_path / "d.json", T.StructType([T.StructField("b", T.LongType()), T.StructField("a", T.StringType())])
    sound = json.dumps(_array_rows(30))
    assert len(list(files._elements(iter([sound.encode()]), 0, False, 0, 0, -1))) == 30
    for damage in DAMAGED:
        with pytest.raises(ValueError):
            list(files._elements(iter([damage(sound).encode()] if damage(sound) else []), 0, False, 0, 0, -1))
    for damage in DAMAGED[::3]:
        p.write_text(damage(sound))
        with pytest.raises((ValueError, PySparkException)):
            files.read_array_file(spark, str(p), schema, block=300).collect()


def test_array_file_is_written_row_by_row(spark, tmp_path):
    """One file with all rows in order, written by several tasks; no task and no value holds the array."""
    df = spark.createDataFrame([(i if i else None, f'"{i}\n', None if i % 2 else "é") for i in range(500)], "at long, b string, a string").repartition(7)
    files.write_array_file(df, "at", str(tmp_path / "w.json"))
    got = json.loads((tmp_path / "w.json").read_text())
    assert [list(o) for o in got] == [["b", "a"]] * 500  # the null at the end
    assert [(o["b"], o["a"]) for o in got] == [(f'"{i}\n', None if i % 2 else "é") for i in [*range(1, 500), 0]]
    assert [x.name for x in tmp_path.iterdir() if not x.name.startswith(".")] == ["w.json"]
    files.write_array_file(df.limit(0), "at", str(tmp_path / "none.json"))
    assert json.loads((tmp_path / "none.json").read_text()) == []
    assert files.read_array_file(spark, str(tmp_path / "none.json"), df.select("b", "a").schema).count() == 0


def test_array_round_trip_holds_no_whole_file(spark, tmp_path):
    """The rows are in no aggregate, and the file is read by several tasks."""
    from alertmill.plans.evaluation import s1_array_round_trip

    one = spark.read.parquet("/root/testdata/sf0.01/secalertbench.parquet")
    step = one.agg(F.max("row_index") + 1).first()[0]
    more = one.crossJoin(spark.range(8)).withColumn("row_index", F.col("row_index") + F.col("id") * step).drop("id")
    more.write.parquet(f"{tmp_path}/secalertbench.parquet")
    got = s1_array_round_trip(spark, str(tmp_path))
    assert "wholetext" not in (plan := got._jdf.queryExecution().toString()).lower() and "collect_list" not in plan
    assert got.select(F.spark_partition_id()).distinct().count() > 1
    fields = got.columns[1:]
    assert got.exceptAll(more.select(F.col("row_index").cast("int").alias("row_index"), *fields)).isEmpty() and got.count() == more.count()


def test_hashes_and_locks_of_files(spark, tmp_path):
    (tmp_path / "one.bin").write_bytes(bytes(range(256)) * 20_000)  # several pieces
    (tmp_path / "two.txt").write_text("é")
    got = {r["path"].rsplit("/", 1)[1]: r["sha256"] for r in files.file_hashes(spark, str(tmp_path)).collect()}
    assert got == {p.name: hashlib.sha256(p.read_bytes()).hexdigest() for p in tmp_path.iterdir()}
    lock = lambda seed: audit.lock_entries(files.file_hashes(spark, str(tmp_path)), {"seed": seed, "names": ["x"]})
    before = materialize(lock(1))
    (tmp_path / "two.txt").write_text("changed")
    (tmp_path / "three").write_text("")
    assert sorted((r["path"].rsplit("/", 1)[-1], r["problem"]) for r in audit.lock_diff(before, lock(2)).collect()) == [("setting:seed", "changed"), ("three", "new"), ("two.txt", "changed")]


def test_scorer_attempts(spark):
    def scorer(call):
        if call["kind"] == "dead":
            raise scoring.ScorerError("no", 401)
        if call["kind"] == "never" or call["attempt"] < call["n"]:
            raise scoring.ScorerError("busy", 429 if call["kind"] == "asked" else None, 90.0 if call["kind"] == "asked" else None)
        return f"{call['kind']} {call['attempt']}"

    calls = spark.createDataFrame([("a", "fine", 1), ("b", "fine", 3), ("c", "asked", 2), ("d", "never", 9), ("e", "dead", 1)], "call_id string, kind string, n int")
    tries = scoring.attempt_calls(calls, scorer, sleep=lambda seconds: None, stop_on_fatal=False).collect()
    by = {c: [(r["attempt"], r["status"], r["http_status"], r["answer"]) for r in tries if r["call_id"] == c] for c in "abcde"}
    assert by["a"] == [(1, "ok", None, "fine 1")] and [x[1] for x in by["b"]] == ["error", "error", "ok"]
    assert by["c"][0][1:3] == ("error", 429) and [x[1] for x in by["d"]] == ["error"] * len(scoring.WAITS) and by["e"] == [(1, "fatal", 401, None)]
    waited = {r["call_id"]: r["waited"] for r in tries if r["attempt"] == 1}
    assert waited["c"] == 90.0 and waited["e"] == 0 and 0.9 * scoring.WAITS[0] <= waited["d"] <= 1.1 * scoring.WAITS[0]
    done = spark.createDataFrame([tuple(r) for r in tries], scoring.ATTEMPT)
    assert sorted(r[0] for r in scoring.finished_calls(done).collect()) == ["a", "b", "c"]
    with pytest.raises(PySparkException, match="FatalScorerError"):
        scoring.attempt_calls(calls, scorer, sleep=lambda seconds: None).collect()


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    from alertmill import __main__ as cli

    monkeypatch.setattr(cli, "build_session", lambda: spark)
    assert cli.main(["queries"]) == 0 and "p3_found" in capsys.readouterr().out
    assert cli.main(["run", "w4_top_values", "/root/testdata/sf0.001", f"{tmp_path}/out"]) == 0
    assert spark.read.parquet(f"{tmp_path}/out").count() == 30
    assert cli.main(["gates", "/root/testdata/sf0.001", "frame has no uid collisions", "rank auroc equals counting all pairs"]) == 0
    assert capsys.readouterr().out.count("PASS") == 2
    with pytest.raises(SystemExit):
        cli.main(["run", "unknown", "x", "y"])


def test_published_files(spark, tmp_path):
    body = {"results": [{"record": {"uri": "/"}, "true_label": "Attack", "llm_label": "maybe"}], "summary": {"metrics": {"confusion_matrix": {"TP": 1, "FP": 0, "TN": 0, "FN": 0}, "f1_score": 1.0, "precision": 1.0, "recall_tpr": 1.0, "fpr": 0.0, "valid_eval_count": 1}}}
    for m in ("m-1", "m.2"):
        (tmp_path / f"{m}.json").write_text(json.dumps(body))
    rows_, summaries = files.read_published(spark, str(tmp_path), T.StructType([T.StructField("uri", T.StringType())]))
    assert sorted((r["model"], r["llm_label"]) for r in rows_.collect()) == [("m-1", None), ("m.2", None)]
    assert summaries.filter("f1_score = 1").count() == 2


def test_json_and_csv_sinks_keep_nulls(spark, tmp_path, rows):
    df = spark.createDataFrame([("é", None, 1.5), ("", "x", None)], "b string, a string, c double")
    files.write_jsonl(df, f"{tmp_path}/j")
    assert rows(files.read_jsonl(spark, f"{tmp_path}/j", df.schema)) == rows(df)
    line = spark.read.text(f"{tmp_path}/j").orderBy("value").first()[0]
    assert list(json.loads(line)) == ["a", "b", "c"]
    files.write_csv(df, f"{tmp_path}/c")
    assert rows(files.read_csv(spark, f"{tmp_path}/c", df.schema)) == rows(df)
    files.write_json_report({"b": 1, "a": "é"}, f"{tmp_path}/r.json")
    assert json.loads((tmp_path / "r.json").read_text()) == {"a": "é", "b": 1}


def test_stream_is_exactly_once_across_restarts(spark, tmp_path):
    src, out, mark = (str(tmp_path / x) for x in ("src", "out", "mark"))
    df = spark.sql("select 'c' || id as call_id, timestamp_ntz'2026-01-01 00:00:00' + make_interval(0,0,0,0,id,0,0) as at, cast(id as double) as v from range(20)")
    df.write.parquet(src)
    once = lambda: stream.distinct_calls(stream.call_stream(spark, src, df.schema).select("call_id", "at"), ["call_id"], "at")
    stream.run_available(once(), out, mark)
    df.write.mode("append").parquet(src)
    stream.run_available(once(), out, mark)
    assert spark.read.parquet(out).count() == 20
    stream.run_available(stream.windowed_latency(stream.call_stream(spark, src, df.schema), "at", "v"), str(tmp_path / "w"), str(tmp_path / "m2"), "complete")
    assert stream.latest_batch(spark, str(tmp_path / "w")).agg(F.sum("n_calls")).first()[0] == 40


def test_gate_registry(spark):
    calls = spark.createDataFrame([("Attack", "Attack", 0.1, 100, 5.0), ("Non-Attack", None, None, 9000, 6.0)], "truth string, pred string, score double, prompt_tokens int, seconds double")
    got = {r["gate"]: r["passed"] for r in gates.run_gates({"calls": calls}, ["prompts fit the context", "invalid answers at most a tenth of each class", "projected time below the limit"]).collect()}
    assert list(got.values()).count(True) == 1 and got["projected time below the limit"]
