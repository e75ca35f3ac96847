import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from alertmill.llm import garbled, packing, tokens

JSON = "byte_bpe_50k.json"
ODD = [
    None, "", " ", "\n\n  \t", "a", "don't they're I'll 'S 'll", "<|endoftext|> x <|endoftext|>", "aaaa" * 9000, "a b" * 4000, " " * 3000 + "x", "é" * 500 + "é",
    "价格很好，值得。" * 200, "うれしい。" * 50, "Привет, мир! " * 300, "👩‍👧 ½ ​   \x1c \x85 x×,÷,", "12345,678.90 " * 400, "it's'll'm 'd \"quoted\" (x)… " * 150, "ﬁ� \U0001f600" * 99,
]


WORDS = ["the", "strap", "is", "great,", "don't", "—", "值得。", "10°C", "\n", "  ", "étui", "x'll", "'s", "🙂", "ÃO?", "1234567", "   "]


def direct(texts, name=JSON):
    return tokens.encode_all(name if "/" in name else tokens.default_path(name), texts)


@pytest.fixture(scope="module")
def other_splitting(tmp_path_factory):
    """The vocabulary of the default tokenizer behind another splitting: runs of three digits, words without spaces."""
    from tokenizers import Regex, Tokenizer, pre_tokenizers

    t = Tokenizer.from_file(tokens.default_path(JSON))
    parts = [pre_tokenizers.Split(Regex(r"\p{N}{1,3}|\p{L}+|\s+|[^\s\p{L}\p{N}]+"), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
    t.pre_tokenizer = pre_tokenizers.Sequence(parts)
    t.save(path := str(tmp_path_factory.mktemp("tokenizer") / "other.json"))
    return path


def corpus(seed=2):
    r = random.Random(seed)
    some = lambda n, sep=" ": sep.join(r.choice(WORDS) for _ in range(n))
    shared, dense = some(300), some(200, "")
    texts = [*ODD, *ODD[12:], *[shared + " " + some(r.randrange(200)) for _ in range(20)], *[some(r.randrange(90)) + shared + some(30, "") + dense for _ in range(20)]]
    return texts + [some(120, "") for _ in range(20)] + ["1" * r.randrange(900) + "7" * 1500 for _ in range(6)] + ["one and the same text"] * 5


@pytest.mark.parametrize("name", [JSON, tokens.DEFAULT_TOKENIZER, "byte_bpe_multi_50k.tiktoken", "word_bpe_49k.json", "piece_bpe_32k.model", "other"])
def test_ids_equal_whole_text_encoding(spark, name, other_splitting):
    path = other_splitting if name == "other" else tokens.default_path(name)
    texts = corpus()
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, ids string, n int")
    got = {x["doc_id"]: x["ids"] for x in tokens.encode_corpus(df, "doc_id", tokenizer=path).collect()}
    want = direct([t or "" for t in texts], path)
    assert len(got) == len(texts)
    assert [i for i in range(len(texts)) if got[i] != want[i]] == []
    assert got[0] == [] and got[1] == []
    assert tokens.encode_corpus(df.limit(0), "doc_id", tokenizer=path).count() == 0


def test_rows_that_repeat_an_id(spark, rows):
    long = " ".join(str(i) for i in range(400))
    data = [(1, "a text"), (1, "a text"), (1, "another"), (2, long), (2, "x " + long), (3, None), (3, "")]
    got = tokens.encode_corpus(spark.createDataFrame(data, "id string, text string"), "id").collect()
    want = direct([t or "" for _, t in data])
    assert sorted((x["id"], x["ids"]) for x in got) == sorted((str(i), w) for (i, _), w in zip(data, want))


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=300), st.text(max_size=300), st.integers(1, 4), st.sampled_from([tokens.DEFAULT_TOKENIZER, JSON]))
def test_joins_are_repaired_exactly(left, right, times, name):
    path = tokens.default_path(name)
    middle = (right + " and so on, it's. ") * times
    chunk = (middle * 30)[:600]
    text = left + chunk + right + chunk
    spans = [(0, len(left), None), (len(left), len(left) + len(chunk), tokens.encode_chunk(path, chunk))]
    spans += [(len(left + chunk), len(left + chunk + right), None), (len(left + chunk + right), len(text), tokens.encode_chunk(path, chunk))]
    got = []
    for x in tokens.join_parts(path, text, spans):
        got += direct([x], name)[0] if isinstance(x, str) else x
    assert got == direct([text], name)[0]


def test_shared_passages_share_chunks():
    r = random.Random(3)
    passage = " ".join(str(r.randrange(10**6)) for _ in range(1200)).encode()
    chunks = []
    for before, after in ((b"one start, ", b""), ("étui ".encode() * 200, b" end")):
        data = before + passage + after
        ends = tokens.cut(b"skipped" + data, np.array([0, 7, 7 + len(data)]))
        assert ends[0] == [7] and ends[1][-1] == 7 + len(data)
        chunks.append({(b"skipped" + data)[x:y] for x, y in zip([7, *ends[1]], ends[1])})
    assert len(chunks[0] & chunks[1]) >= len(chunks[0]) - 3 and len(chunks[0]) > 10
    assert any(len(x) > 1 for x in [tokens.join_parts(tokens.default_path(), "étui " + passage.decode(), [(5, 5 + len(passage), tokens.encode_chunk(tokens.default_path(), passage.decode()))])])


@pytest.mark.parametrize(("bucket", "n"), [(10**9, 500), (4, 3000), (2, 0)])
def test_containers(spark, monkeypatch, bucket, n):
    monkeypatch.setattr(packing, "BUCKET_CONTAINERS", bucket)
    monkeypatch.setattr(packing, "FAN_IN", 3)
    r = random.Random(n)
    items = [(i, r.choice([0, None, 5000, 1000]) if i % 50 == 0 else r.randrange(1, 400), r.choice(["a", "a", "a", "b", None]), "clash") for i in range(n)]
    df = spark.createDataFrame(items, "id long, n long, source string, bucket string")
    got = packing.pack(df, "id", "n", "source", 1000).collect()
    size = {i: s or 0 for i, s, *_ in items}
    covered, boxes = {i: [] for i in size}, {}
    for x in got:
        if x["container_id"] is None:
            assert size[x["id"]] == 0
            continue
        covered[x["id"]].append((x["start"], x["n_units"]))
        boxes.setdefault(x["container_id"], []).append((x["slot"], x["n_units"]))
    for i, parts in covered.items():
        at = 0
        for start, units in sorted(parts):
            assert start == at
            at += units
        assert at == size[i] and (size[i] > 1000 or len(parts) == (size[i] > 0))
    for b in boxes.values():
        at = 0
        for slot, units in sorted(b):
            assert slot == at
            at += units
        assert at <= 1000
    assert {x["id"] for x in got} == set(size)
    if n:
        assert sum(size.values()) / (1000 * len(boxes)) > 0.985


def test_windows_keep_the_mixture():
    r = random.Random(1)
    queues = {q: [(r.randrange(5, 60), (q, i)) for i in range(n)] for q, n in ((0, 4000), (1, 1000))}
    total = sum(s for q in queues.values() for s, _ in q)
    shares = {k: sum(s for s, _ in v) / total for k, v in queues.items()}
    closed, left, _ = packing.fill_windows(queues, shares, {}, 500, False)
    for at in range(0, len(closed) - 32, 16):
        window = [x for box in closed[at : at + 16] for x in box]
        share = sum(s for s, (q, _) in window if q == 1) / sum(s for s, _ in window)
        assert abs(share - shares[1]) < 0.08


def shares_of(placed, source, first):
    """Shares of the sources in the units of the first containers of every bucket."""
    got = Counter()
    for x in placed:
        if x["container_id"] is not None and x["container_id"] % (1 << 24) < first:
            got[source[x["id"]]] += x["n_units"]
    return {k: v / sum(got.values()) for k, v in got.items()}


def test_every_source_has_a_queue_and_its_target(spark):
    """80 sources, targets on the ten smallest and none on the rest: the rest comes after them, and nothing is lost."""
    r = random.Random(4)
    source = {i: f"s{i % 80:02d}" for i in range(16_000)}
    items = [(i, r.randrange(20, 60), s) for i, s in source.items()]
    target = {f"s{k}": float(k - 69) for k in range(70, 80)} | {"s00": 0.0}
    placed = packing.pack(spark.createDataFrame(items, "id long, n long, source string"), "id", "n", "source", 500, target).collect()
    assert {x["id"] for x in placed} == set(source)
    got = shares_of(placed, source, 16)
    assert set(got) == {f"s{k}" for k in range(70, 80)}
    for k in range(70, 80):
        assert abs(got[f"s{k}"] - (k - 69) / 55) < 0.03


def test_sizes_that_do_not_fit_stay_bounded(spark, monkeypatch):
    """Items of 55 % of the capacity never share a container: each level closes most of them instead of handing them all up."""
    monkeypatch.setattr(packing, "BUCKET_CONTAINERS", 8)
    monkeypatch.setattr(packing, "FAN_IN", 2)
    queues = {"a": [(550, i) for i in range(40)]}
    closed, left, _ = packing.fill_windows(queues, {"a": 1.0}, {}, 1000, False, 4)
    assert len(closed) == 36 and len(left) == 4
    df = spark.createDataFrame([(i, 550, "a") for i in range(100)], "id long, n long, source string")
    got = packing.pack(df, "id", "n", "source", 1000).collect()
    assert len({x["container_id"] for x in got}) == 100


TEXT = {
    "en": "I’ve used the café tray for weeks – it’s “lovely” and costs £20, near 25 °C.", "fr": "Après quatre semaines, la crème reste très agréable à côté de l’étui.",
    "de": "Größe laut Etikett: für schöne Tücher, natürlich äußerst leise.", "ru": "Подарила маме, говорит очень красиво и надёжно, модель удобная.",
    "zh": "花了三十元，屏幕安静，值得。家里老人说很结实，客服不回。", "ja": "三週間使いましたが、外箱は丈夫です。温度は良いでした。", "es": "El año pasado tenía un envío en avión, ¡qué maravilla la cámara!",
}
WRONG = [
    ("en", "utf-8", "cp1252"), ("en", "utf-8", "mac_roman"), ("fr", "utf-8", "latin_1"), ("fr", "cp1252", "mac_roman"), ("de", "utf-8", "cp437"), ("ru", "utf-8", "cp1251"), ("ru", "cp1251", "latin_1"),
    ("ru", "koi8_r", "cp1251"), ("zh", "gbk", "latin_1"), ("ja", "utf-8", "latin_1"), ("es", "utf-8", "latin_1"), ("zh", "utf-8", "latin_1"),
]


@pytest.fixture(scope="module")
def repaired(spark):
    natural = [(i * 100 + j, t) for i, t in enumerate(TEXT.values()) for j in range(60)]
    bad = [(10_000 + k, TEXT[lang].encode(true).decode(wrong, "strict" if wrong != "cp1252" else "ignore"), TEXT[lang]) for k, (lang, true, wrong) in enumerate(WRONG)]
    twice = TEXT["fr"].encode().decode("latin_1").encode().decode("latin_1")
    part = TEXT["de"] + " " + TEXT["fr"].encode().decode("latin_1")
    bad += [(11_000, twice, TEXT["fr"]), (11_001, part, TEXT["de"] + " " + TEXT["fr"])]
    fine = [(12_000, "Ω ├── box Ελλάδα Þórsmörk ÃO? COMPREI E NÃO ME ARREPENDO Âge"), (12_001, None), (12_002, ""), (12_003, "plain"), (12_004, "&eacute; <b>étui</b> étui")]
    lost = [(13_000, "caf� tray")]
    df = spark.createDataFrame([*natural, *[b[:2] for b in bad], *fine, *lost], "doc_id long, text string")
    return {r["id"]: r for r in garbled.repair(df, "doc_id").collect()}, natural, bad, fine, lost


def test_garbled_texts_are_restored(repaired):
    got, _, bad, _, lost = repaired
    assert [k for k, *_ in bad if not got[k]["garbled"]] == []
    wrong = [(k, got[k]["restored"], want) for k, _, want in bad if got[k]["restored"] != want]
    assert len(wrong) <= 1, wrong
    assert got[lost[0][0]]["garbled"] and got[lost[0][0]]["reason"] == garbled.LOST_LETTERS


def test_correct_texts_stay(repaired):
    got, natural, _, fine, _ = repaired
    assert all(not got[k]["garbled"] and got[k]["restored"] == t for k, t in [*natural, *fine])


def test_garbling_in_numeric_references(spark):
    natural = [(i * 100 + j, t) for i, t in enumerate(TEXT.values()) for j in range(60)]
    refs = lambda t: t.encode("ascii", "xmlcharrefreplace").decode()
    bad = {1000 + i: (TEXT[lang].encode().decode("latin_1"), TEXT[lang]) for i, lang in enumerate(("en", "de", "ru", "ja"))}
    part = (2000, "étui " + refs("für schöne Tücher".encode().decode("latin_1")))
    fine = [(3000 + i, refs(t)) for i, t in enumerate(TEXT.values())] + [(4000, "it&#146;s &#60;b&#62; &#0; &#xD800; &#9999999; &#"), (4001, "étui &#xe9;tui")]
    rows = [*natural, *[(k, refs(b)) for k, (b, _) in bad.items()], part, *fine]
    got = {r["id"]: r for r in garbled.repair(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id").collect()}
    assert {k: got[k]["restored"] for k in bad} == {k: want for k, (_, want) in bad.items()} and all(got[k]["garbled"] for k in bad)
    assert got[2000]["garbled"] and got[2000]["restored"] == "étui für schöne Tücher"
    assert all(not got[k]["garbled"] and got[k]["restored"] == t for k, t in fine)


@pytest.mark.parametrize(("lang", "true", "wrong"), [("ru", "cp1251", "latin_1"), ("es", "cp1252", "mac_roman"), ("de", "utf-8", "cp437"), ("fr", "cp1252", "mac_roman")])
@pytest.mark.parametrize("copies", [True, False])
def test_a_garbled_third_does_not_vouch_for_itself(spark, lang, true, wrong, copies):
    bad = TEXT[lang].encode(true).decode(wrong)
    rows = [(i * 100 + j, t) for i, t in enumerate(TEXT.values()) for j in range(60)]
    rows += [(10_000 + k, bad if copies else f"{bad} No {k}.") for k in range(210)]
    got = {r["id"]: r["garbled"] for r in garbled.repair(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id").collect()}
    assert all(g == (k >= 10_000) for k, g in got.items())


def test_copies_hardly_add_to_the_letter_pairs(spark):
    one = spark.createDataFrame([("abc étui",), ("x",), (None,)], "text string")
    many = spark.createDataFrame([("abc étui",)] * 700 + [("x",)] + [(None,)], "text string")
    a, b = garbled.pair_counts(one), garbled.pair_counts(many)
    assert b.total - a.total == 9 * (garbled.COPIES - 1) and a.pairs.tolist() == b.pairs.tolist()  # nine pairs


@pytest.mark.parametrize(("layers", "wrong"), [(3, ["latin_1", "latin_1", "mac_roman"]), (4, ["latin_1"]), (4, ["latin_1", "latin_1", "mac_roman"]), (5, ["latin_1"]), (7, ["latin_1"])])
def test_any_number_of_layers_is_undone(spark, layers, wrong):
    bad = TEXT["fr"]
    for i in range(layers):
        bad = bad.encode().decode(wrong[i % len(wrong)])
    rows = [(i * 100 + j, t) for i, t in enumerate(TEXT.values()) for j in range(60)] + [(9000, bad)]
    got = {r["id"]: r for r in garbled.repair(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id").collect()}
    assert got[9000]["garbled"] and got[9000]["reason"] == garbled.ROUND_TRIP and got[9000]["restored"] == TEXT["fr"]


def test_rare_pairs_leave_the_table(spark, monkeypatch):
    df = spark.createDataFrame([("ab " * 500 + "q",)], "text string")
    assert len(garbled.pair_counts(df).pairs) == 5  # space-a, ab, b-space, space-q, q-space
    monkeypatch.setattr(garbled, "MOST_PAIRS", 100)
    t = garbled.pair_counts(df)
    assert len(t.pairs) == 3 and t.total == 1502
    assert garbled.Repairer(garbled.PairTable(t.pairs[:0], t.counts[:0], 0)).measure("ab")[1] == 0


@pytest.mark.parametrize(("lang", "true", "wrong"), [("zh", "utf-8", "latin_1"), ("ja", "utf-8", "cp1252"), ("zh", "gbk", "latin_1")])
def test_correct_text_touching_a_garbled_passage(spark, lang, true, wrong):
    passage = "花了三十元" if lang == "zh" else "三週間使い"
    raw = passage.encode(true)
    bad = garbled.decode(raw, "sloppy") if wrong == "cp1252" else raw.decode(wrong)
    rows = [(i * 100 + j, t) for i, t in enumerate(TEXT.values()) for j in range(60)] + [(9000, passage + bad + passage), (9001, passage * 2)]
    got = {r["id"]: r for r in garbled.repair(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id").collect()}
    assert got[9000]["garbled"] and got[9000]["restored"] == passage * 3
    assert not got[9001]["garbled"] and not any(got[k]["garbled"] for k, _ in rows if k < 9000)


def test_empty_table(spark):
    assert garbled.repair(spark.createDataFrame([], "doc_id long, text string"), "doc_id").count() == 0
