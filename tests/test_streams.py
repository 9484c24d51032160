import json

import pytest
from pyspark.sql import functions as F

from lectern.operators.embed import embedder, generator, hashing_model
from lectern.sources import ledger
from lectern.streaming import ingest, status


def run(stream, path, tmp_path, mode="append"):
    q = stream.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(str(path))
    q.awaitTermination()


def test_two_loads_equal_one(spark, tmp_path):
    embed = embedder(hashing_model(32))

    def load(folder, store):
        ingest.start_ingest(ingest.file_stream(spark, str(folder)), str(store), str(store) + "-cp", "org", embed).awaitTermination()

    both, parts = tmp_path / "both", tmp_path / "parts"
    both.mkdir(), parts.mkdir()
    texts = {"a.txt": "first document text, long enough", "b.md": "second document text, long enough", "copy.txt": "first document text, long enough", "bad.exe": "x", "empty.txt": ""}
    for name, text in texts.items():
        (both / name).write_text(text)
    load(both, tmp_path / "s1")
    for name in ("a.txt", "bad.exe"):
        (parts / name).write_text(texts[name])
    load(parts, tmp_path / "s2")
    for name in ("b.md", "copy.txt", "empty.txt"):
        (parts / name).write_text(texts[name])
    load(parts, tmp_path / "s2")
    for name, columns in {"documents": ["sha256", "status"], "chunks": ["doc_id", "content_hash"], "embeddings": ["chunk_id", "dimensions"], "rejected": ["name", "reason"]}.items():
        one, two = (sorted(map(tuple, spark.read.parquet(str(tmp_path / s / name)).select(*columns).collect())) for s in ("s1", "s2"))
        assert one == two and one, name
    assert spark.read.parquet(str(tmp_path / "s1" / "documents")).count() == 2


def test_broken_batch_counts_only_after_its_second_run(spark, tmp_path, monkeypatch):
    store = str(tmp_path / "store")
    rows = lambda names: spark.createDataFrame(
        [(n, len(t), t.encode()) for n, t in names.items()], "path string, length bigint, content binary"
    )
    take = lambda names, n: ingest.ingest_batch(rows(names), store, "org", embedder(hashing_model(8)), n, buckets=4)
    read = lambda name: ledger.stored_rows(spark, store, name)
    assert take({"a.txt": "the first text, long enough", "b.txt": "the second text, long enough"}, 0)
    before = sorted(read("chunks").collect())
    real = ledger.write_rows

    def breaks(rows, store, table, *rest):
        if table == "documents":
            raise RuntimeError("executor lost")
        real(rows, store, table, *rest)

    late = {"c.txt": "the third text, long enough", "copy.txt": "the first text, long enough"}
    monkeypatch.setattr(ledger, "write_rows", breaks)
    with pytest.raises(RuntimeError):
        take(late, 1)
    # Its chunks are there, but do not count.
    assert sorted(read("chunks").collect()) == before and read("documents").count() == 2
    monkeypatch.setattr(ledger, "write_rows", real)
    assert take(late, 1)
    assert read("documents").count() == 3 and read("chunks").count() == 3 and read("embeddings").count() == 3
    # A batch that counts is not run again; a later copy of known contents adds nothing.
    assert not take(late, 1)
    assert take({"again.txt": "the third text, long enough"}, 2)
    assert read("documents").count() == 3
    assert sorted(map(tuple, ledger.ledger(spark, store).select("batch", "documents", "chunks").collect())) == [(0, 2, 2), (1, 1, 1), (2, 0, 0)]


def test_append_reads_touched_buckets_only(spark, tmp_path):
    store = str(tmp_path / "store")
    rows = spark.range(400).select(F.col("id"))
    assert ledger.run_batch(spark, store, 0, lambda: (ledger.write_rows(rows, store, "t", "id", 0, 16), spark.range(1))[1])
    fresh = ledger.unknown_rows(spark.createDataFrame([(5,), (1000,)], "id bigint"), store, "t", "id", 16)
    assert [r["id"] for r in fresh.collect()] == [1000]
    assert len({f.rsplit("/", 3)[1] for f in ledger.stored_rows(spark, store, "t", [3, 7]).inputFiles() if "/t/" in f}) == 2


def test_summary_triggers_across_batches(spark, tmp_path):
    src = tmp_path / "in"
    for n, rows in enumerate([[(1,)] * 7 + [(2,)] * 3, [(1,)] * 10]):
        spark.createDataFrame(rows, "conv_id bigint").coalesce(1).write.mode("append").parquet(str(src))
        stream = spark.readStream.schema("conv_id bigint").parquet(str(src))
        run(status.summary_triggers(stream), tmp_path / "out", tmp_path)
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()))
    assert got == [(1, 1, 8), (1, 2, 16)]


def test_stalled_alerts(spark, tmp_path):
    src = tmp_path / "in"
    schema = "doc_id bigint, event_id bigint, status string, ts timestamp"
    at = lambda m: f"timestamp'2024-01-01 {m // 60:02d}:{m % 60:02d}:00'"

    def add(rows):
        sql = " UNION ALL ".join(f"SELECT {d}L doc_id, {e}L event_id, '{s}' status, {at(m)} ts" for d, e, s, m in rows)
        spark.sql(sql).coalesce(1).write.mode("append").parquet(str(src))
        stream = spark.readStream.schema(schema).parquet(str(src))
        run(status.stalled_alerts(stream, ["READY", "FAILED"]), tmp_path / "out", tmp_path)

    # Document 1 pauses for 14 minutes, document 2 for 16, document 3 is done.
    add([(1, 1, "CHUNKING", 0), (2, 2, "CHUNKING", 0), (3, 3, "READY", 0)])
    add([(1, 4, "READY", 14), (2, 5, "READY", 16)])
    add([(9, 6, "READY", 200)])
    got = [(r["doc_id"], r["status"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert got == [(2, "CHUNKING")]


def test_windowed_counts(spark, tmp_path):
    df = spark.sql("SELECT timestamp'2024-01-01 00:10:00' ts, 'a' s UNION ALL SELECT timestamp'2024-01-01 01:10:00', 'a'")
    assert status.windowed_counts(df, "s", "ts").count() == 2


def test_generation_hook_retries(spark):
    def load():
        calls = {"n": 0}

        def model(prompts):
            calls["n"] += 1
            if calls["n"] % 2 == 1:
                raise RuntimeError("busy, try again in 0.01s")
            if "boom" in prompts[0]:
                raise RuntimeError("down, try again in 0.01s")
            return [p.upper() for p in prompts]

        return model

    df = spark.createDataFrame([("hi",), ("boom",), (None,)], "p string").coalesce(1)
    assert [r[0] for r in df.select(generator(load, retries=2)(F.col("p"))).collect()] == ["HI", None, None]


def test_vectors_have_unit_length(spark):
    df = spark.createDataFrame([("alpha beta alpha",), ("",), (None,)], "t string")
    rows = [r[0] for r in df.select(embedder(hashing_model(48))(F.col("t"))).collect()]
    assert len(rows[0]) == 48 and abs(sum(x * x for x in rows[0]) - 1) < 1e-5
    assert sum(map(abs, rows[1])) == 0 and rows[2] is None


def test_ingest_reads_by_type_and_tells_failures(spark, tmp_path):
    import io
    import zipfile

    def package(parts):
        data = io.BytesIO()
        with zipfile.ZipFile(data, "w") as z:
            for name, body in parts.items():
                z.writestr(name, body)
        return data.getvalue()

    src, store = tmp_path / "files", tmp_path / "store"
    src.mkdir()
    files = {
        "page.html": b"<html><script>var hidden = 1</script><h1>Heading of it</h1><p>A paragraph that is long enough.</p></html>",
        "data.json": b'{"outer": {"inner": ["first value here", "second value"]}}',
        "bad.yaml": b"key: [unclosed and long enough to be a chunk",
        "letter.docx": package({"word/document.xml": "<w:document><w:p><w:r><w:t>A letter with enough text</w:t></w:r></w:p></w:document>"}),
        "notes.zip": package({"a.txt": "text of the first member", "b.exe": "x"}),
        "broken.zip": b"PK\x03\x04 cut off",
        "scan.pdf": b"%PDF-1.7 no text here",
    }
    for name, data in files.items():
        (src / name).write_bytes(data)
    ingest.start_ingest(ingest.file_stream(spark, str(src)), str(store), str(store) + "-cp", "org", embedder(hashing_model(16))).awaitTermination()
    rows = {r["name"]: r for r in spark.read.parquet(str(store / "documents")).collect()}
    assert {n for n, r in rows.items() if r["status"] == "FAILED"} == {"broken.zip", "scan.pdf"}
    assert set(rows) == set(files)
    text = {}
    for r in spark.read.parquet(str(store / "chunks")).collect():
        text[r["doc_id"]] = text.get(r["doc_id"], "") + r["content"]
    of = lambda name: text[rows[name]["id"]]
    assert "hidden" not in of("page.html") and "# Heading of it" in of("page.html")
    assert "outer.inner[0]" not in of("data.json") and "first value here" in of("data.json")
    assert "A letter with enough text" in of("letter.docx")
    assert "text of the first member" in of("notes.zip") and "unclosed" in of("bad.yaml")


def test_a_table_of_one_file_or_of_a_folder_streams(spark, tmp_path):
    from lectern.plans.reports import summary_triggers as registered

    rows = spark.range(30).select((F.col("id") % 3).alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.lit("x").alias("text"))
    (tmp_path / "folder").mkdir()
    (tmp_path / "file").mkdir()
    rows.repartition(3).write.parquet(str(tmp_path / "folder" / "conversations.parquet"))
    rows.toPandas().to_parquet(tmp_path / "file" / "conversations.parquet")
    for kind in ("folder", "file"):
        assert sorted(map(tuple, registered(spark, str(tmp_path / kind)).collect())) == [(0, 1, 8), (1, 1, 8), (2, 1, 8)]


def test_words_that_cancel_each_other_out_still_have_a_vector():
    import zlib

    signs = {}
    for n in range(1000):
        code = zlib.crc32(f"w{n}".encode())
        signs.setdefault(code % 4, {})[bool(code & 0x80000000)] = f"w{n}"
    both = next(pair for pair in signs.values() if len(pair) == 2)
    found = hashing_model(4)()([" ".join(both.values()), "", "plain"])
    assert [round(float((v * v).sum()), 9) for v in found] == [1.0, 0.0, 1.0]


def test_a_batch_makes_each_text_once(spark, tmp_path, monkeypatch):
    plans = {}
    real = ingest.kept
    monkeypatch.setattr(ingest, "kept", lambda df, label: (plans.setdefault(label, df._jdf.queryExecution().optimizedPlan().toString()), real(df, label))[1])
    files = spark.createDataFrame([("a.txt", 25, b"a text that is long enough")], "path string, length bigint, content binary")
    assert ingest.ingest_batch(files, str(tmp_path / "store"), "org", embedder(hashing_model(8)), 0, buckets=2)
    # Cleaned in two places, members of archives and all other texts; a filter on the text had each a second time.
    assert plans["chunks"].count("{160,}") == 2
