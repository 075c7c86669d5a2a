"""Every operator on nulls, empty and very long texts, repeated rows, empty tables and clashing column names."""

import pytest
from pyspark.sql import functions as F

from tessera.llm import decontam, langid, linededup, mixing, neardup, quality, secrets, sharding, toxicity, warc

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, row string, _text_id string, text_id string, node long, size long, label int, shard int, copies int, _match int, _lang int, _toxicity int, _secrets int, _gone int, _d long, _t string, turn int"
LONG = " ".join(f"word{i % 5000}x" for i in range(30_000))
TEXTS = [None, "", "   \n\t", "one", "The same words here\nand there, with more of them.", "The same words here\nand there, with more of them.", "!!! 123 $$$", LONG, LONG, None, "token = abcdefgh12345678"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 2 else None, "s" if i % 3 else None, None, *[None] * 16) for i, t in enumerate(TEXTS)]
    rows += [rows[4], (None, "no id at all here", None, None, 3, *[None] * 16), (4, "another text of the same id", "fr", "s", 1, *[None] * 16)]
    return spark.createDataFrame(rows, COLUMNS).cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(4, 1, 0), (5, 0, 1), (5, 1, 0), (99, 1, 1), (None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int")


N = len(TEXTS) + 3


def test_langid(docs, empty):
    rows = langid.query(docs).collect()
    assert len(rows) == N
    assert all((r.lang_pred, r.score) == ("und", 0.0) for r in rows if r.doc_id in (0, 1, 2, 6, 9))
    assert langid.query(empty).count() == 0
    signs = docs.sparkSession.createDataFrame([(1, "½"), (2, "12 ² Ⅷ"), (3, "½ cup of tea")], "doc_id long, text string")
    assert [r["_lang"].lang_pred == "und" for r in langid.identify(signs, langid.fit(docs)).orderBy("doc_id").collect()] == [True, True, False]
    found = langid.identify(docs, langid.fit(docs))
    assert found.columns == [*docs.columns, "_lang_"]


def test_neardup(docs, empty):
    rows = neardup.classes(docs).collect()
    assert len(rows) == N
    by = {(r.doc_id, bytes(r.text_id)): r.class_id for r in rows}
    classes = {d: {c for (x, _), c in by.items() if x == d} for d in (0, 5, 7, 8, 9)}
    assert classes == {0: {0}, 5: {4}, 7: {7}, 8: {7}, 9: {9}}
    kept = neardup.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [0, 1, 2, 3, 4, 4, 6, 7, 9, 10]
    assert neardup.query(empty).count() == 0


def test_quality(docs, empty, labels):
    rows = quality.query(docs, labels).collect()
    assert len(rows) == N
    assert all(r.n_words == 0 and r.base_failed and not r.kept for r in rows if r.doc_id in (0, 1, 2, 9))
    assert quality.query(empty, labels).count() == 0
    assert quality.query(docs, labels.limit(0)).count() == N


def test_mixing(docs, empty):
    rows = mixing.query(docs).collect()
    assert len(rows) == N
    assert all(r.taken == 0 for r in rows if not r.size)
    assert all(r.taken <= 3 * r.size for r in rows)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert mixed.count() == mixing.plan_copies(docs).agg(F.sum("copies")).first()[0]
    assert mixing.query(empty).count() == 0 and mixing.mix(empty).count() == 0


def test_mix_of_one_row_many_times(spark):
    rows = spark.range(0, 3000, 1, 6).select(F.lit(7).cast("long").alias("doc_id"), F.lit("a b c").alias("text"), F.lit("s").alias("source"), F.col("id").alias("turn"), F.lit(1).alias("copies"))
    mixed = mixing.mix(rows.union(rows.limit(5).withColumn("source", F.lit("t"))))
    assert mixed.columns == rows.columns
    n = {r.source: r["count"] for r in mixed.groupBy("source").count().collect()}
    assert abs(n["t"] - 15) <= 1 and abs(n["s"] - 2990) <= 1


def test_secrets(docs, empty):
    rows = {r.doc_id: r for r in secrets.query(docs).collect()}
    assert rows[0].spans == "" and rows[10].n_assign == 1 and rows[10].spans == "assign:0:24"
    assert secrets.find(docs).columns[-1] == "_secrets_"
    assert secrets.query(empty).count() == 0


def test_decontamination(spark, docs, empty):
    items = spark.createDataFrame([(1, "same WORDS here"), (2, None), (None, "and there"), (3, "..."), (1, "same WORDS here")], "item_id long, text string")
    for most in (100, 0):
        seen = {(r.row.doc_id, r.row.text): r._match for r in decontam.matches(docs, items, most_broadcast=most).collect()}
        hit = seen[4, TEXTS[4]]
        assert (hit.n_words, hit.n_hit, hit["items"]) == (10, 5, ["1"])
        assert sum(m.n_hit > 0 for m in seen.values()) == 2
    kept = decontam.drop_documents(docs, items)
    assert kept.columns == docs.columns and kept.count() == N - 3
    cut = {r.doc_id: r.text for r in decontam.cut_spans(docs, items).collect()}
    assert cut[5] == "The with more of them." and cut[0] is None
    assert decontam.query(empty, items).count() == 0 and decontam.query(docs, items.limit(0)).filter("contaminated").count() == 0


def test_linededup(docs, empty):
    found = linededup.dedup(docs)
    assert found.columns == [*docs.columns, "_gone_"]
    rows = {(r.doc_id, tuple(r["_gone_"])): r.text for r in found.collect()}
    assert rows[5, (0, 1)] == "" and rows[4, ()] is not None and rows[0, ()] is None
    assert linededup.query(docs).count() == N and linededup.query(empty).count() == 0


def test_toxicity(docs, empty, labels):
    rows = toxicity.query(docs, labels).collect()
    assert len(rows) == N and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.query(empty, labels).count() == 0
    assert toxicity.query(docs, labels.limit(0)).filter("score > 0").count() == 0
    assert toxicity.score(docs, toxicity.character_model(docs), None).columns[-1] == "_toxicity_"


def test_warc(spark):
    pages = spark.createDataFrame([(1, "http://a/\r\nX: y", "body"), (2, None, "body"), (3, "u", None), (None, "u", "body"), (5, "u", "a\r\n\r\nb"), (5, "u", "a\r\n\r\nb"), (6, "u", "x" * 3_000_000)], "page_id long, url string, html string")
    rows = {(r.page_id, r.payload_bytes): (r.record_type, r.refers_to) for r in warc.query(pages).collect()}
    assert rows == {(1, 4): ("response", None), (2, 4): ("revisit", 1), (3, 0): ("response", None), (None, 4): ("revisit", 1), (5, 6): ("response", None), (6, 3_000_000): ("response", None)}
    assert warc.query(pages.limit(0)).count() == 0


def test_sharding(docs, empty):
    rows = sharding.query(docs).collect()
    assert len(rows) == N
    assert {r.size for r in rows if r.doc_id in (0, 1, 9)} == {1}
    assert len({r.shard for r in rows if r.doc_id in (0, 1, 9)}) == 1
    for s in {r.shard for r in rows}:
        slots = sorted(r.slot for r in rows if r.shard == s)
        assert slots == list(range(len(slots)))
    assert sharding.query(empty).count() == 0


def test_pipeline(spark, tmp_path, docs, empty, labels):
    import corpus_pipeline as p

    items = spark.createDataFrame([(1, "No ID at all here"), (2, None)], "item_id long, text string")
    for name, rows in (("some", docs), ("none", empty)):
        for what, df in (("documents", rows), ("labels", labels), ("benchmark", items)):
            df.write.parquet(f"{tmp_path}/{name}/{what}.parquet")
        found = p.run(spark, f"{tmp_path}/{name}").collect()
        assert {r.doc_id for r in found} <= {0, 1, 2, 3, 4, 6, 7, 9, 10} and bool(found) == (name == "some")
        for s in {r.shard for r in found}:
            slots = sorted(r.slot for r in found if r.shard == s)
            assert slots == list(range(len(slots)))
    for stage in (p.drop_benchmark, p.mix_sources):
        assert stage(spark, docs, f"{tmp_path}/some").columns == p.COLUMNS
