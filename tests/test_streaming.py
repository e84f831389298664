from pyspark.sql import functions as F

from quirion.operators import events
from quirion.operators.chunk import page_chunks
from quirion.operators.images import first_copies
from quirion.sources import derived as D
from quirion.sources import objects, sinks
from quirion.streaming import pages as S

SF = "/root/testdata/sf0.001"


def test_chunks_of_a_stream_equal_those_of_a_batch(spark, tmp_path):
    rows = D.derived(spark, SF, D.TURNS)
    rows.repartition(4, "doc_id").write.parquet(f"{tmp_path}/in")
    for _ in range(2):  # a second run finds nothing new
        S.chunk_stream(S.page_stream(spark, f"{tmp_path}/in", rows.schema, 1), f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").drop("batch")
    want = page_chunks(rows)
    assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))


def test_distinct_images_over_batches(spark, tmp_path):
    rows = D.derived(spark, SF, D.IMAGES)
    rows.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = S.distinct_images(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"))
    stream.select("doc_id", "image_hash").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    got = sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect()))
    assert got == sorted(map(tuple, first_copies(rows).select("doc_id", "image_hash").collect()))


def test_files_and_sink(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.pdf").write_bytes(b"one")
    (tmp_path / "in/b.txt").write_bytes(b"two")
    found = objects.files(spark, f"{tmp_path}/in")
    assert [bytes(r.content) for r in found.collect()] == [b"one"]

    class Decoder:
        def pages(self, content):
            yield {"page_number": 1, "spans": [{"block_no": 0, "line_no": 0, "span_no": 0, "block_type": 0, "text": content.decode(), "size": 9.0, "flags": 0}]}

    assert [r.text for r in objects.spans(found, Decoder()).collect()] == ["one"]
    requests = spark.createDataFrame([("b", "x.PDF"), ("b", "x.txt"), ("b", "gone.pdf")], "bucket string, file_key string")
    got = {r.file_key: (r.exists, r.supported, r.message) for r in objects.validated(requests, requests.filter("file_key not like 'gone%'")).collect()}
    assert got == {"x.PDF": (True, True, "OK"), "x.txt": (True, False, "Documento inválido"), "gone.pdf": (False, True, "Documento inválido")}
    chunks = page_chunks(spark.createDataFrame([(1, 1, "é")], "doc_id long, page_number int, text string"))
    assert '"char_count":1' in events.chunk_metadata(chunks).first().chunk_metadata
    sinks.write_events(events.events(chunks.select("doc_id", "chunk_index", "page_numbers", "content", "chunking_method"), chunks.select("doc_id")), f"{tmp_path}/out")
    assert spark.read.parquet(f"{tmp_path}/out").filter(F.col("status") == "PROCESSING").first().text == "é"
