"""The pipeline's stages against brute force on a small corpus with planted documents."""

import random

import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from cairnspark.llm import vocabulary  # noqa: E402

SHARED = " ".join(f"bench{i}" for i in range(14))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(8)
    path = str(tmp_path_factory.mktemp("corpus"))
    rows, labels = [], []
    for i in range(120):
        text = " ".join(f"{rng.choice('abcdefgh')}word{rng.randrange(900)}" for _ in range(70)) + "."
        rows.append((i, text, "en", "s", len(text)))
        labels.append((i, 1, 0))
    for i in range(120, 160):
        text = "CLICK!! HERE!! " * rng.randrange(8, 40)
        rows.append((i, text, "en", "s", len(text)))
        labels.append((i, 0, 0))
    near = rows[3][1].replace(rows[3][1].split()[40], "changed")
    planted = {200: rows[3][1], 201: near, 202: " ".join(rows[10][1].split()[:30]) + " " + SHARED + " end.", 203: rows[11][1][::-1].replace("drow", "term") + " mail me@site.org now.", 204: None}
    rows += [(i, t, "en", "p", None if t is None else len(t)) for i, t in planted.items()]
    rows.append((None, " ".join(f"other{k}" for k in range(60)), None, None, 1))
    rows.append(rows[5])
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, SHARED)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, ids = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == columns, name
        ids.append(sorted(r.doc_id for r in docs.where("doc_id is not null").select("doc_id").collect()))
    good, single, clean, redacted = ids
    assert set(range(120)) <= set(good) and not set(range(120, 160)) & set(good)
    assert [i for i in single if i in (3, 200, 201)] == [3] and single.count(5) == 1 and set(range(120)) <= set(single)
    assert set(single) - set(clean) == {202}
    assert redacted == clean
    text = docs.where("doc_id = 203").first()
    assert "<EMAIL>" in text.text and "me@site.org" not in text.text and text.n_chars == len(text.text)


def test_run(spark, folder):
    import tiktoken
    import public_tokenizers

    out = {r.doc_id: r for r in corpus_pipeline.run(spark, folder).collect()}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary.read_ranks(corpus_pipeline.VOCABULARY), special_tokens={})
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").where(F.col("doc_id").between(0, 119)).collect()}
    for i, t in texts.items():
        assert list(out[i].ids) == library.encode_ordinary(t) and out[i].text == t and out[i].n_tokens == len(out[i].ids)
    assert corpus_pipeline.ORACLE_SQL is None


def test_empty(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        assert docs.count() == 0


def test_leaks_go_by_row(spark, folder):
    rows = [(None, "clean words of one without an id"), (None, f"a {SHARED} leak"), (None, None), (7, f"b {SHARED} leak"), (7, "clean words of seven"), (8, "clean words of eight")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = [tuple(r) for r in corpus_pipeline.drop_leaks(spark, docs, folder).collect()]
    assert sorted(left, key=repr) == sorted((r for r in rows if SHARED not in (r[1] or "")), key=repr)


def test_copies_go_by_row(spark, folder):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(60)) for x in "abcd")
    kept = [(3, a), (7, b), (9, c), (9, None), (9, ""), (None, d), (None, "lone")]
    docs = spark.createDataFrame([*kept, (7, a), (7, b), (9, c + " more"), (None, d), (None, a + " more"), (11, b)], "doc_id long, text string")
    left = [tuple(r) for r in corpus_pipeline.keep_one_of_each(spark, docs, folder).collect()]
    same = lambda r: (r[0], "c" if (r[1] or "").startswith(c) else r[1])
    assert sorted(map(same, left), key=repr) == sorted(map(same, kept), key=repr)


def test_clashing_columns_and_long_texts(spark, folder):
    text = " ".join(f"long{k % 3000}" for k in range(40_000))
    rows = [(i, t, 1, 2, "k", i) for i, t in enumerate([text, text + " one more", "mail me@site.org now and then", "", None])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _quality int, _spans int, _key string, component_id long")
    for name, stage in corpus_pipeline.STAGES[1:-1]:
        columns = docs.columns
        docs = stage(spark, docs, folder)
        assert docs.columns == columns, name
    got = {r.doc_id: r for r in docs.collect()}
    assert set(got) == {0, 2, 3, 4} and got[2].text == "mail <EMAIL> now and then" and got[4].text is None
    assert corpus_pipeline.keep_good(spark, docs, folder).columns == docs.columns
