"""Sources, store and streams: what each of them promises."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mailgrade.functions import dates
from mailgrade.functions.charset import detected
from mailgrade.operators import metrics
from mailgrade.sources import fixture, folder, messages, quoted, snapshots, store, tabular
from mailgrade.streaming import scoring as streaming

TEXTS = {
    "windows-1251": ["Здравствуйте, коллеги! Прошу прислать отчёт до пятницы.", "Привет"],
    "koi8-r": ["Добрый день, напоминаю о встрече завтра в десять часов утра."],
    "iso-8859-5": ["Просьба подтвердить участие в совещании."],
    "shift_jis": ["お世話になっております。明日の会議の資料をお送りします。", "カタカナのテスト"],
    "euc-jp": ["お世話になっております。明日の会議の資料をお送りします。"],
    "iso-2022-jp": ["明日の会議の資料"],
    "gb18030": ["您好，请在星期五之前把报告发给我，谢谢。", "会议改到下午三点"],
    "big5": ["您好，請在星期五之前把報告發給我，謝謝。"],
    "euc-kr": ["안녕하세요, 내일 회의 자료를 보내 드립니다."],
    "windows-1253": ["Καλημέρα σας, παρακαλώ στείλτε την αναφορά μέχρι την Παρασκευή."],
    "windows-1252": ["Können Sie mir den Bericht für morgen schicken? Grüße", "¿vendrá mañana el señor Muñoz? “Sí” – café"],
    "utf-8": ["déjà vu", "plain", ""],
}


@pytest.mark.parametrize("charset", TEXTS)
def test_charset_is_found(charset):
    for text in TEXTS[charset]:
        raw = text.encode(charset)
        assert raw.decode(detected(raw)) == text
        assert messages._readable(raw, "no-such-charset") == text
        assert messages._readable(f"see below:\n{text}\n".encode(charset), None) == f"see below:\n{text}\n"


def test_any_bytes_can_be_read():
    r = random.Random(1)
    for n in (1, 2, 50, 3000):
        assert isinstance(messages._readable(bytes(r.randrange(256) for _ in range(n)), None), str)


@pytest.mark.parametrize("header, want", [
    ("14 May 2001 16:39", "2001-05-14 16:39:00"), ("Sept 3, 2001 9 a.m.", "2001-09-03 09:00:00"), ("3/9/2001 9:05 pm", "2001-03-09 21:05:00"),
    ("13/9/2001", "2001-09-13 00:00:00"), ("2001.9.13 7:08:09", "2001-09-13 07:08:09"), ("13 Sep 70", "1970-09-13 00:00:00"),
    ("Thu Sep 13 07:08:09 GMT+0200 2001", "2001-09-13 07:08:09"), ("12:00 am Sep 13 2001", "2001-09-13 00:00:00"), ("30.2.2001", None),
    ("25:00 1 May 2001", None), ("99999999999999999999", None), ("Sep", None), (None, None),
])
def test_free_dates(spark, header, want):
    row = spark.createDataFrame([(header,)], "h string").select(dates.local_time(F.col("h")).cast("string").alias("t")).first()
    assert row["t"] == want


def test_folder_lists_underscores_and_packs_small_files(spark, tmp_path):
    names = {f"u/_in/{i}": b"x" * i for i in range(1, 41)} | {"_top": b"t", "u/.gone": b"g", "u/_in/big": b"b" * 5000}
    for name, content in names.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(content)
    spark.dataSource.register(folder.MessageFolder)
    frame = spark.read.format("messages").option("taskBytes", "1000").load(str(tmp_path))
    got = {r["path"]: r for r in frame.collect()}
    assert {k: bytes(r["content"]) for k, r in got.items()} == {f"{tmp_path}/{k}": v for k, v in names.items() if "." not in k}
    assert all(r["length"] == len(r["content"]) and r["modificationTime"] for r in got.values())
    assert 2 <= frame.rdd.getNumPartitions() <= 4
    assert folder.read_folder(spark, str(tmp_path / "none")).count() == 0
    assert folder.dealt([("a", 5), ("b", 5), ("c", 90), ("d", 1)], 10) == [["a", "b"], ["c"], ["d"]]


def test_files_are_written_and_read_back(spark, tmp_path):
    rows = spark.createDataFrame([("/a/_1", b"one"), ("b/2", b""), ("b/3", None)], "path string, content binary")
    folder.write_folder(rows, f"file://{tmp_path}")
    got = {r["path"]: bytes(r["content"]) for r in folder.read_folder(spark, f"file://{tmp_path}").collect()}
    assert got == {f"file://{tmp_path}/a/_1": b"one", f"file://{tmp_path}/b/2": b""}


def results(spark, ids, day="2024-01-01"):
    frame = spark.createDataFrame([(i,) for i in ids], "id long")
    return frame.select("id", F.lit("a@b").alias("sender"), F.lit("s").alias("subject"), F.lit("b").alias("body"), F.lit("high").alias("priority"), F.lit(f"{day} 10:00:00").cast("timestamp").alias("created_at"))


def ids(frame):
    return sorted(r["id"] for r in frame.select("id").collect())


def test_deletes_are_marks_until_compaction(spark, tmp_path):
    path = str(tmp_path / "s")
    gone = lambda *x: spark.createDataFrame([(i,) for i in x], "id long")
    store.delete(spark, path, gone(1))  # nothing to delete from
    store.append(results(spark, range(10)), path)
    store.append(results(spark, range(20, 24), "2024-01-02"), path)
    files = sorted(p.name for p in (tmp_path / "s").rglob("*.parquet"))
    store.delete(spark, path, gone(3, 4, 99))
    store.delete(spark, path, gone(4, 20, 21, 22, 23))
    assert sorted(p.name for p in (tmp_path / "s").rglob("*.parquet")) == files
    assert ids(store.read(spark, path)) == [0, 1, 2, 5, 6, 7, 8, 9]
    store.append(results(spark, [4]), path)  # after its delete: counts again
    assert ids(store.read(spark, path)) == [0, 1, 2, 4, 5, 6, 7, 8, 9]
    store.compact(spark, path)
    assert not (tmp_path / "s.deletes").exists() and not (tmp_path / "s" / "ingest_date=2024-01-02").exists()
    assert ids(store.read(spark, path)) == [0, 1, 2, 4, 5, 6, 7, 8, 9]
    store.compact(spark, path)
    assert ids(spark.read.parquet(path)) == [0, 1, 2, 4, 5, 6, 7, 8, 9]


def test_readers_meet_whole_versions_only(spark, tmp_path):
    path = str(tmp_path / "v")
    with pytest.raises(FileNotFoundError):
        snapshots.read(spark, path)
    for version in range(4):
        snapshots.write(spark.range(version + 1), path, version)
        assert snapshots.read(spark, path).count() == version + 1
    assert sorted(p.name for p in (tmp_path / "v").iterdir()) == ["version=2", "version=3"]
    (tmp_path / "v" / "version=4").mkdir()  # a writer that failed half-way
    assert snapshots.read(spark, path).count() == 4
    snapshots.write(spark.range(9), path, 4)
    assert snapshots.read(spark, path).count() == 9


@pytest.mark.parametrize("buckets", [2, 16, 1024])
def test_thinned_curves_keep_their_bends_and_area(spark, buckets):
    r = random.Random(7)
    rows = [(int(s > 0.5 or r.random() < 0.1), [float(round(1 - s, 2)), float(round(s, 2))]) for s in (r.random() for _ in range(900))]
    points = metrics.roc_points(spark.createDataFrame(rows, "y_true int, probability array<double>"))
    thin = metrics.thinned(points, buckets)
    for c in (0, 1):
        own = sorted((x for x in points.collect() if x["class_id"] == c), key=lambda x: -x["score"])
        kept = sorted((x for x in thin.collect() if x["class_id"] == c), key=lambda x: -x["score"])
        steps = [(x["tp_step"], x["fp_step"]) for x in own]
        want = [x["score"] for i, x in enumerate(own) if i in (0, len(own) - 1) or steps[i] != steps[i + 1]]
        assert [x["score"] for x in kept] == want
        area = lambda xs: sum((b["fp"] - a["fp"]) * (a["tp"] + b["tp"]) / 2 for a, b in zip(xs, xs[1:]))
        assert area(own) == pytest.approx(area(kept))


@pytest.mark.parametrize("size", [40, 300, 1 << 20])
def test_quoted_csv_is_split_anywhere(spark, tmp_path, size):
    r = random.Random(size)
    piece = lambda: r.choice(["a", '"', "\n", ",", '""', "é", " ", "\n\n", "x" * 30])
    rows = [(str(i), "".join(piece() for _ in range(r.randint(0, 25))), i if i % 3 else None) for i in range(120)] + [("big", "l\n" * 400, 7)]
    frame = spark.createDataFrame(rows, "id string, body string, n int")
    tabular.write_csv(frame.repartition(3), str(tmp_path / "csv"))
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", 0)
        if size < 1000:
            assert quoted._lines(spark, str(tmp_path / "csv")).rdd.getNumPartitions() > 10
        got = tabular.read_csv(spark, str(tmp_path / "csv"), frame.schema)
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(rows, key=repr)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_the_first_by_path_wins_on_a_stream(spark, tmp_path):
    """Copies in other batches, late ones, undated ones; ids leave the state in the end."""
    batches = [
        [("m1", "2024-01-01 10:00:00", "c"), ("m2", None, "z"), ("m3", "2024-01-01 11:00:00", "k")],
        [("m1", "2024-01-01 12:00:00", "b"), ("m2", None, "y"), ("m3", "2024-01-01 11:00:00", "l")],
        [("m4", "2024-01-09 00:00:00", "q")],
        [("m1", "2024-01-01 10:00:00", "a"), ("m5", "2024-01-20 00:00:00", None)],
        [("m6", "2024-03-01 00:00:00", "w")],
    ]
    schema = "message_id string, date timestamp, path string"
    source = tmp_path / "in"
    for i, rows in enumerate(batches):
        frame = spark.createDataFrame([(m, d, p) for m, d, p in rows], "message_id string, d string, path string")
        frame.select("message_id", F.col("d").cast("timestamp").alias("date"), "path").coalesce(1).write.parquet(str(source / f"b{i}"))
        out, state = str(tmp_path / "out"), str(tmp_path / "state")
        stream = spark.readStream.schema(schema).parquet(str(source / "*"))
        streaming.write_files(streaming.keep_first_stream(stream), out, state).awaitTermination()
    got = sorted((r["message_id"], r["path"]) for r in spark.read.parquet(out).collect())
    assert got == [("m1", "b"), ("m2", "y"), ("m3", "k"), ("m4", "q"), ("m5", None)]


@pytest.mark.parametrize("files", [0, 3])
def test_a_table_streams_from_a_file_and_from_a_folder_of_files(spark, tmp_path, files):
    documents = spark.createDataFrame([(i, "web", f"text {i}") for i in range(9)], "doc_id long, source string, text string")
    events = spark.createDataFrame([(1, 2, "2024-01-01")], "event_id long, user_id long, ts string")
    events.write.parquet(str(tmp_path / "events.parquet"))
    if files:
        documents.repartition(files).write.parquet(str(tmp_path / "documents.parquet"))
    else:
        documents.toPandas().to_parquet(tmp_path / "documents.parquet")
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    streaming.write_files(fixture.mail_stream(spark, str(tmp_path)).select("id"), out, state).awaitTermination()
    assert sorted(r["id"] for r in spark.read.parquet(out).collect()) == list(range(9))


def test_a_large_batch_of_messages_is_taken_apart_in_steps():
    files = [(f"/mail/{i}", None if i % 7 == 0 else b"From: a@b.example\nSubject: s%d\n\n" % i + b"x" * 9000) for i in range(1000)]
    batch = pa.RecordBatch.from_pylist([{"path": p, "content": c} for p, c in files])
    steps = list(messages._batches(iter([batch, batch.slice(0, 0)])))
    assert max(sum(len(b or "") for b in s.column("body").to_pylist()) for s in steps) <= messages.STEP_BYTES
    rows = [r for s in steps for r in s.to_pylist()]
    assert [r["path"] for r in rows] == [p for p, _ in files]
    assert all((r["reject_reason"], r["subject"]) == (("unreadable", None) if c is None else (None, f"s{i}")) for i, (r, (_, c)) in enumerate(zip(rows, files)))


def test_words_of_a_text_are_the_same_in_arrays(spark):
    """Folded letters, marks that join words, letters beyond ASCII, upper-case foldings."""
    from mailgrade.functions import terms as tm
    from mailgrade.functions import wordcounts

    odd = ["", "Plain WORDS a b2 2b x_y", "café ﬁsh ½ áb ᴬb 日本ab cd Жz", "Kelvin ßx İstanbul", "a\U00010791b ꟴc d—e"]
    odd += [f"ab{chr(c)}cd x{chr(c)}" for c in range(0x80, 0x2100)]
    df = spark.createDataFrame([(t,) for t in odd], "t string")
    for compact in (False, True):
        find = wordcounts._finder(compact)
        for r in df.select("t", tm.words(F.col("t"), compact).alias("w"), tm.word_text(F.col("t"), compact).alias("x")).collect():
            assert find(r["x"]) == r["w"], ascii(r["t"])


def test_terms_are_counted_alike_from_text_and_from_arrays(spark, monkeypatch):
    from mailgrade.functions import wordcounts
    from mailgrade.operators import tfidf

    monkeypatch.setattr(wordcounts, "STEP_BYTES", 40)
    texts = ["apple apple pear", None, "Apple plum café apple plum", "", "pear", "plum pear plum pear plum", "x 1 _"]
    docs = tfidf.with_terms(spark.createDataFrame([(i, "go on", t) for i, t in enumerate(texts * 3)], "id int, subject string, body string"))
    alone = docs.select("id", "terms")
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(tfidf.term_counts(docs)) == key(tfidf.term_counts(alone))
    model = tfidf.MailTfidf(maxTerms=6).fit(docs)
    assert model.getOrDefault(model.terms) == (other := tfidf.MailTfidf(maxTerms=6).fit(alone)).getOrDefault(other.terms)
    assert key(model.weights(docs, "id")) == key(model.weights(alone, "id"))


def test_fitting_the_features_reads_only_the_text(spark):
    """No sender, date or folder: none of the other columns is computed for the vocabulary."""
    from mailgrade.operators import training

    mail = spark.createDataFrame([(i, "re: plum", "apple pear") for i in range(3)] + [(3, "x", "kiwi")], "id int, subject string, body string")
    model = training.feature_pipeline().fit(mail)
    assert training.vector_names(model)[-7:] == ["apple", "apple pear", "pear", "plum", "plum apple", "re", "re plum"]


def test_fixed_attribution_computes_its_columns_once(monkeypatch, spark, sf_dir):
    from mailgrade.plans import catalog

    kept = []
    monkeypatch.setattr(catalog, "materialise", lambda df: kept.append(df.columns) or df.limit(0))
    catalog.attribution_fixed(spark, sf_dir)
    assert kept == [["id", "features"]]


def test_equal_headers_of_messages_are_parsed_once(monkeypatch):
    from email import headerregistry

    seen = []
    parse = headerregistry.ContentTypeHeader.value_parser
    monkeypatch.setattr(headerregistry.ContentTypeHeader, "value_parser", staticmethod(lambda v: seen.append(v) or parse(v)))
    kind = "text/plain; charset=windows-1251; x=once"
    raw = f"From: a@b.example\nSubject: =?utf-8?q?Gr=C3=BC=C3=9Fe?=\nContent-Type: {kind}\n\n".encode() + "Привет".encode("windows-1251")
    rows = [messages._take_apart(str(i), raw) for i in range(20)]
    assert all(r[-3:] == ("Grüße", "Привет", None) for r in rows) and len(seen) == 1


def test_ids_that_share_a_group_keep_their_own_rows_and_waits(spark, tmp_path, monkeypatch):
    """Whole numbers stay whole beside nulls; an id ends when its own wait does; calls are as many as groups, not as ids."""
    monkeypatch.setattr(streaming, "GROUPS", 3)
    calls = spark.sparkContext.accumulator(0)
    monkeypatch.setattr(streaming, "_packed", lambda rows, types, plain=streaming._packed: calls.add(1) or plain(rows, types))
    large = (1 << 60) + 1
    days = ["2024-01-01 10:00:00", "2024-01-02 10:00:00", None, "2024-01-09 00:00:00"]
    batches = [
        [(f"m{i}", large + i if i % 3 else None, days[i % 4], f"p{i}") for i in range(400)] + [(None, 1, days[0], "n")],
        [(f"m{i}", large, days[0], f"a{i}") for i in range(0, 400, 40)] + [("later", None, "2024-02-01 00:00:00", "x")],
        [("last", 5, "2024-03-01 00:00:00", "y")],
    ]
    schema, source = "message_id string, n long, date timestamp, path string", tmp_path / "in"
    for i, rows in enumerate(batches):
        frame = spark.createDataFrame(rows, "message_id string, n long, d string, path string")
        frame.select("message_id", "n", F.col("d").cast("timestamp").alias("date"), "path").coalesce(1).write.parquet(str(source / f"b{i}"))
        out, state = str(tmp_path / "out"), str(tmp_path / "state")
        stream = spark.readStream.schema(schema).parquet(str(source / "*"))
        streaming.write_files(streaming.keep_first_stream(stream), out, state).awaitTermination()
    got = {r["message_id"]: (r["n"], r["date"] and str(r["date"]), r["path"]) for r in spark.read.parquet(out).collect()}
    # The first copies of every 40th id had ended before the second ones came; those are late.
    want = {m: (n, d, p) for m, n, d, p in [*batches[0], batches[1][-1]]}
    assert got == want
    assert 0 < calls.value < 40
