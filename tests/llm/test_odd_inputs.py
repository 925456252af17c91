"""Extra columns with clashing names, broken media, bounds and the pipeline on odd rows."""

import struct

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from terraloom.llm import common, media, mixing, quality_rules, substring_dedup

CLASHES = ["id", "_id", "row", "size", "taken", "copy", "_copy", "words", "_words", "spans", "_spans", "whole", "lang2", "_stratum", "_cut_repeat_share", "stratum", "kept", "_q_kept", "n_words", "plan"]


def with_clashes(docs):
    return docs.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASHES)])


def test_clashing_columns_pass_through(make_docs):
    prose = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty more"
    docs = with_clashes(make_docs([(1, prose, "a"), (2, f"{prose} {prose}", "b"), (3, None, "a")]))
    labels = docs.sparkSession.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    for out, ids in (
        (mixing.mixed_documents(docs), None),
        (substring_dedup.without_repeats(docs), {1, 2, 3}),
        (quality_rules.filter_documents(docs, labels), {1}),
    ):
        rows = out.collect()
        assert out.columns == docs.columns and rows
        assert all(r[c] == i for r in rows for i, c in enumerate(CLASHES))
        assert ids is None or {r.doc_id for r in rows} == ids


def test_pipeline_stages_take_odd_rows_and_empty_tables(spark, odd, sf):
    for name, step in corpus_pipeline.STAGES:
        docs = with_clashes(odd) if name != "packing" else odd
        out = step(spark, docs, sf)
        out.count()
        if name != "packing":
            assert out.columns == docs.columns
        assert step(spark, odd.limit(0), sf).count() == 0


def nested(depth):
    body = b"x" * 8
    for _ in range(depth):
        body = b"LIST" + struct.pack("<I", len(body) + 4) + b"hdrl" + body
    return b"RIFF" + struct.pack("<I", len(body) + 4) + b"AVI " + body


def frame(height, width, sampling=0x11, n=1):
    sof = struct.pack(">BHHB", 8, height, width, n) + bytes([1, sampling, 0]) * n
    return b"\xff\xd8\xff\xc0" + struct.pack(">H", 2 + len(sof)) + sof + b"\xff\xda" + struct.pack(">H", 8) + bytes([1, 1, 0, 0, 63, 0]) + b"\x00" * 40 + b"\xff\xd9"


@pytest.mark.parametrize("image", [frame(65535, 65535), frame(8, 8, 0x00), frame(0, 8), frame(8, 8, n=0), b"\xff\xd8\xff\xda\x00\x02", b"", b"\xff\xd8"])
def test_broken_images_raise_what_clips_catches(image):
    with pytest.raises(media.BROKEN):
        media.decode_jpeg(image)


def test_broken_media_are_rows_with_an_error(spark):
    def avi(image):
        movi = b"movi00dc" + struct.pack("<I", len(image)) + image + b"\0" * (len(image) % 2)
        body = b"LIST" + struct.pack("<I", len(movi)) + movi
        return b"RIFF" + struct.pack("<I", len(body) + 4) + b"AVI " + body

    values = [nested(5000), nested(3), avi(frame(65535, 65535)), avi(frame(8, 8, 0x00)), b"", None, media.text_to_avi("some text")[1]]
    rows = media.clips(spark.createDataFrame(list(enumerate(values)), "doc_id long, media binary")).collect()
    by = {r.id: r for r in rows}
    assert all(by[i].error and by[i].clip is None for i in range(6)) and by[6].error is None and by[6].n_frames == 1


def test_bounded_sample(spark):
    df = common.cut(spark.range(5000))
    rows = common.bounded_sample(df, F.xxhash64("id"), 300).collect()
    want = sorted(r.id for r in df.orderBy(F.xxhash64("id")).limit(300).collect())
    assert sorted(r.id for r in rows) == want
    assert common.bounded_sample(df.limit(10), F.xxhash64("id"), 300).count() == 10
