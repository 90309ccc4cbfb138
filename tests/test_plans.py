from pyspark.sql import functions as F

from mediaspark.plans.resolve import chosen_items, dead_letters


def test_stored_records_to_choice(spark):
    media = spark.createDataFrame([(1, "A", "1", "one", False), (2, "A", "2", "two", False), (3, "A", "3", "skip", False), (4, "A", "4", None, False)],
                                  "media_id int, extractor_key string, id string, title string, is_live boolean")
    schema = "media_id int, pos int, format_id string, url string, ext string, vcodec string, acodec string, tbr double"
    formats = spark.createDataFrame([(1, 0, "v", "http://e/v.mp4", "mp4", "avc1", "none", 5.0), (1, 1, "a", "http://e/a.webm", "webm", "none", "opus", 1.0),
                                     (2, 0, "b", "http://e/b.mp4", "mp4", None, None, None), (3, 0, "b", "http://e/b.mp4", "mp4", None, None, None)], schema)
    archive = spark.createDataFrame([("a 3",)], "archive_id string")
    out = {r["media_id"]: (r["format_id"], r["ext"]) for r in chosen_items(media, formats, archive).collect()}
    assert out == {1: ("v+a", "mkv"), 2: ("b", "mp4"), 4: (None, None)}
    assert {r["media_id"]: r["reason"] for r in dead_letters(media, formats).collect()} == {4: 'missing "title"'}
