import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from winnow.llm import digest, html_crf, langid, line_dedup, near_dedup, packing, pieces, sharding, vectors, warc

from .edges import LONG, documents

PER_ROW = {
    "op1": (lambda d: pieces.encode(d, decoded=True), 14),
    "op2": (sharding.shard, 14),
    "op6": (near_dedup.near_duplicates, 14),
    "op9": (langid.identify, 14),
    "op10": (digest.fingerprints, 14),
    "op4": (line_dedup.dedup_lines, 13),
}


@pytest.mark.parametrize("name", PER_ROW)
def test_every_row_comes_back(spark, name):
    run, rows = PER_ROW[name]
    assert run(documents(spark)).count() == rows
    assert run(documents(spark, empty=True)).count() == 0


def test_pieces_of_edges(spark):
    got = {r.doc_id: r for r in pieces.encode(documents(spark), decoded=True).where("doc_id is not null").collect()}
    assert got[3].ids == [] and got[4].decoded == "" and got[5].decoded == LONG
    assert got[11].decoded == "🎉 漢字 \x00 ﬁ ß " + "é" * 50


def test_shards_of_edges(spark):
    got = sharding.shard(documents(spark), target_bytes=4096).collect()
    assert {(r.bytes, r.tokens) for r in got if r.doc_id in (3, 4)} == {(0, 0)}
    assert len({r.shard for r in got if r.doc_id == 2}) == 1


def test_packs_of_edges(spark):
    got = packing.pack(documents(spark), window=512, grid=8).collect()
    assert sum(r.n_tokens for r in got if r.doc_id == 5) == 80_000
    assert [r.pack_id for r in got if r.doc_id in (3, 4, 7)] == [None] * 3
    used = {}
    for r in got:
        if r.pack_id is not None:
            used.setdefault(r.pack_id, []).append((r.pack_offset, r.n_tokens))
    for spans in used.values():
        spans.sort()
        assert all(a + n <= b for (a, n), (b, _) in zip(spans, spans[1:])) and spans[-1][0] + spans[-1][1] <= 512
    assert packing.pack(documents(spark, empty=True)).count() == 0


def test_groups_of_edges(spark):
    got = near_dedup.near_duplicates(documents(spark)).collect()
    assert sorted(r.kept for r in got if r.doc_id in (1, 2)) == [False, False, True]
    assert all(r.kept for r in got if r.doc_id in (4, 5, 6, 7, 8, 9, 10, 11))
    kept = near_dedup.drop_near_duplicates(documents(spark))
    assert kept.columns == documents(spark).columns
    assert kept.where("doc_id in (1, 2)").count() == 1


def test_languages_of_edges(spark):
    got = {r.doc_id: r for r in langid.identify(documents(spark)).collect()}
    assert not got[3].accepted and not got[4].accepted and not got[7].accepted and not got[10].accepted
    assert got[1].accepted and got[8].lang_id == "de" and got[9].family == "romance"
    assert langid.identify(documents(spark).withColumn("lang", F.lit(None).cast("string"))).where("accepted").count() == 0


def test_lines_of_edges(spark):
    got = {r.doc_id: r for r in line_dedup.dedup_lines(documents(spark)).where("doc_id is not null").collect()}
    assert got[1].n_dropped == 0 and got[2].text == "" and got[3].text is None and got[4].text == "" and got[5].text == LONG
    kept = line_dedup.drop_repeated_lines(documents(spark))
    assert kept.columns == documents(spark).columns and kept.where("doc_id = 2").count() == 0


def test_own_columns_stay_and_the_survivor_does_not_depend_on_order(spark):
    text = "One line that stands here alone.\nAnother line that nobody repeats."
    rows = [(1, text, "en", "x"), (1, text, "de", "y"), (1, text, None, None), (2, "Something else altogether, with words.", "fr", "z")]
    for run in (line_dedup.drop_repeated_lines, near_dedup.drop_near_duplicates):
        kept = []
        for order in (rows, rows[::-1]):
            docs = spark.createDataFrame(order, "doc_id long, text string, lang string, __w_a string").withColumns({"__W_N": F.lit(1), "__w_text": F.lit(2), "extra": F.create_map(F.lit("k"), F.col("lang"))})
            out = run(docs)
            assert out.columns == docs.columns
            kept.append(sorted(map(repr, out.collect())))
        assert len(kept[0]) == 2 and kept[0] == kept[1]


def test_digests_of_edges(spark):
    got = digest.fingerprints(documents(spark)).collect()
    one = {r.doc_id: r for r in got}
    assert one[3].digest is None and one[5].n_filters > 1 and one[1].group_id == one[2].group_id == 1 and one[2].score == 100.0


@pytest.mark.parametrize("k", range(len(corpus_pipeline.STAGES)))
def test_stages_on_edges(spark, k):
    stage = corpus_pipeline.STAGES[k][1]
    for empty in (False, True):
        docs = documents(spark, empty)
        out = stage(spark, docs, "")
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.schema.names == docs.schema.names
        assert (out.count() == 0) == empty


def pages(spark, rows):
    return spark.createDataFrame([(*r, "c", "d") for r in rows], "page_id long, url string, html string, record_id string, text string")


PAGES = [
    (1, "http://a.org/x", "<html><head><title>T &amp; t</title></head><body><nav><a href='/'>home</a></nav><article><p>One, two.</p><p>Three<br>four</article></body></html>"),
    (1, "http://a.org/x", "<p>"),
    (2, None, None),
    (None, "", ""),
    (3, "x", "no tags, just text"),
    (4, "x", "<div>" * 3000 + "deep" + "</p></span>" * 50),
    (5, "x", "<script>if (a < b) {}</script><!-- never closed"),
    (6, "x", "<p>" + "long text, " * 30_000),
]


def test_html_edges(spark):
    got = html_crf.extract(pages(spark, PAGES)).collect()
    assert len(got) == len(PAGES)
    by = {r.page_id: r for r in got}
    assert by[2].text == "" and by[None].n_text == 0 and by[5].text == ""
    assert html_crf.extract(pages(spark, [])).count() == 0
    free = html_crf.extract(pages(spark, PAGES[4:5])).first()
    assert free.text == "no tags, just text" and free.marginal == 0.5


def test_warc_edges(spark):
    got = warc.derive(warc.responses(pages(spark, PAGES))).collect()
    assert len(got) == 2 * len(PAGES)
    null = [r for r in got if r.page_id == 2]
    assert {r.target_uri for r in null} == {"urn:page:2"} and {r.block for r in null if r.warc_type == "conversion"} == {""}
    assert all(r.header.count("WARC-Refers-To: " + r.refers_to) == 1 and len(r.block.encode()) == r.content_length for r in got)
    assert warc.derive(warc.responses(pages(spark, []))).count() == 0


def test_vector_edges(spark):
    unit = [1.0] + [0.0] * 7
    rows = [(1, unit), (2, unit), (2, unit), (3, None), (4, []), (5, [0.0] * 8), (6, [1.0, 2.0]), (7, [float("nan")] * 8), (None, unit), (8, [0.0, 1.0] + [0.0] * 6), (9, [None] + [1.0] * 7), (10, [5.0, 0.1] + [0.0] * 6)]
    frame = spark.createDataFrame([(a, b, 1, 2) for a, b in rows], "vec_id long, embedding array<float>, node int, good int")
    got = vectors.near_duplicates(frame).collect()
    assert len(got) == len(rows)
    assert {r.vec_id for r in got if r.group_id == 1} == {1, 2, None, 10}
    assert sum(r.kept for r in got if r.group_id == 1) == 1 and all(r.group_size == 1 for r in got if r.vec_id in (3, 4, 5, 6, 7, 8, 9))
    assert vectors.near_duplicates(frame.limit(0)).count() == 0
