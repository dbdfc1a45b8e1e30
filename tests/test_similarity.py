import random

import __spark_entry__
import pytest
from pyspark.sql import functions as F

from cairnspark.operators import similarity as M
from cairnspark.plans import ledger_queries
from cairnspark.sources import objects as O


@pytest.fixture(scope="module")
def counts(spark):
    rng = random.Random(3)
    rows = {(i, str(rng.randrange(rng.choice([4, 30, 2000])))): rng.randrange(1, 4) for i in range(150) for _ in range(rng.randrange(8))}
    return spark.createDataFrame([(*k, n) for k, n in rows.items()], "ord long, feature string, n long").cache()


@pytest.mark.parametrize("often", [0, 3, 1000])
def test_nearest_without_sizes(spark, counts, often):
    found = M.nearest(counts.withColumn("n", F.lit(1)), sized=False, latest=False, often=often).select("ord", "base", "shared", "rank")
    assert sorted(found.collect()) == sorted(M.top(M.overlaps(counts), F.desc("shared"), F.col("base")).select("ord", "base", "shared", "rank").collect())


@pytest.mark.parametrize("latest", [False, True])
def test_nearest_by_ratio(spark, counts, latest):
    every = M.normalised(counts)
    ranked = M.top(every, F.desc("ratio"), F.desc("shared"), F.desc("base") if latest else F.col("base")).select("ord", "base", "shared", "ratio", "rank")
    for often in (1, 20):
        assert sorted(M.nearest(counts, True, latest, often=often).select(*ranked.columns).collect()) == sorted(ranked.collect())


@pytest.fixture(scope="module")
def alike(spark, tmp_path_factory):
    """60,000 documents with one line in common: 1.8 billion pairs."""
    folder = str(tmp_path_factory.mktemp("alike"))
    text = F.concat(F.lit("a line\n"), F.when(F.col("id") % 20_000 == 7, F.lit("another")).otherwise(F.col("id").cast("string")))
    spark.range(60_000).select(F.col("id").alias("doc_id"), text.alias("text"), F.lit("en").alias("lang"), F.concat(F.lit("s"), F.col("id") % 2).alias("source")).write.parquet(f"{folder}/documents.parquet")
    return folder


def test_a_line_of_every_document_to_the_earliest(spark, alike):
    rows = __spark_entry__.queries()["feature_overlap_topk"](spark, alike)
    assert rows.count() == 3 * 60_000 - 6
    assert [tuple(r) for r in rows.where("ord = 40007").orderBy("rank").select("base", "shared").collect()] == [(7, 2), (20_007, 2), (0, 1)]
    assert rows.where("ord > 2 and ord % 20000 <> 7").groupBy("base", "rank").count().count() == 3


def test_a_line_of_every_document_to_the_latest(spark, alike):
    rows = __spark_entry__.queries()["overlap_normalised"](spark, alike)
    assert rows.count() == 3 * 60_000 - 6
    assert [tuple(r) for r in rows.where("ord = 40007").orderBy("rank").select("base", "shared", "ratio").collect()] == [(20_007, 2, 1.0), (7, 2, 1.0), (40_006, 1, 0.5)]
    assert rows.where("ord % 20000 <> 7 and base <> ord - rank").isEmpty()


def test_drawings_with_a_circle_in_common(spark, tmp_path):
    """20,000 drawings with the same circle: 200 million pairs."""
    rows = spark.range(40_000).select(F.floor(F.col("id") / 2).alias("l_orderkey"), (F.col("id") % 2 + 1).cast("int").alias("l_linenumber"), F.lit("N").alias("l_returnflag"), F.lit(5.0).alias("l_quantity"), F.when(F.col("id") == 39_998, 100.0).otherwise(F.col("id") + 100.0).alias("l_extendedprice"))
    rows.write.parquet(f"{tmp_path}/lineitem.parquet")
    found = __spark_entry__.queries()["geometry_ranked_bases"](spark, str(tmp_path))
    assert found.count() == 3 * 20_000 - 6
    assert [tuple(r) for r in found.where("ord = 19999").orderBy("rank").select("base", "shared").collect()] == [(0, 2), (1, 1), (2, 1)]
    assert found.where("ord > 2 and ord < 19999").groupBy("base", "rank").count().count() == 3


def test_a_base_that_many_files_propose(spark):
    """Every file on the same base, in two arms: each is tried once, and sizes are those of plain patches."""
    objects = spark.createDataFrame([(i, bytes(range(256)) * 20 + b"%d" % i) for i in range(40)], "ord long, bytes binary")
    proposals = spark.range(1, 40).select(F.explode(F.array(F.lit("a"), F.lit("b"))).alias("arm"), F.col("id").alias("ord"), F.lit(0).cast("long").alias("base"))
    found = M.choose_for_arms(objects, proposals, {"a": -(1 << 30), "b": 1 << 30, "c": 1}).collect()
    base = objects.where("ord = 0").select(F.col("bytes").alias("b"))
    sizes = {r.ord: r.size for r in objects.join(base).select("ord", F.octet_length(M.patch("b", "bytes")).alias("size")).collect()}
    assert len(found) == 120 and all(r.exact for r in found)
    assert all((r.base, r.selected, r.attempts) == ((0, sizes[r.ord], 1) if r.arm == "a" and r.ord else (None, r.standalone, int(r.arm != "c" and r.ord > 0))) for r in found)


def test_a_funnel_over_a_line_of_every_document(spark, alike):
    r = __spark_entry__.queries()["proposal_funnel"](spark, alike).first()
    assert (r.n_files, r.proposed, r.accepted, r.too_small, r.unproposed) == (60_000, 59_999, 0, 59_999, 1)


def test_candidates_over_a_line_of_every_document(spark, alike):
    counts = {r.arm: r["count"] for r in __spark_entry__.queries()["arm_candidates"](spark, alike).groupBy("arm").count().collect()}
    assert counts["name"] == 59_998 and counts["key"] == 3 * 60_000 - 6


def test_arms_over_a_line_of_every_document(spark, alike):
    rows = {r.arm: r for r in __spark_entry__.queries()["arm_comparison"](spark, alike).collect()}
    assert rows["name"].n_files == 60_000 and rows["name"].comparable == 59_998 and rows["name"].other_only == 1


def test_patches_over_a_line_of_every_document(spark, alike):
    rows = __spark_entry__.queries()["base_arms_exact"](spark, alike).collect()
    assert len(rows) == 6 and all(r.n_files == 60_000 and r.exact for r in rows)


def test_patches_of_drawings_with_a_circle_in_common(spark, tmp_path):
    """12,000 drawings of one circle: 72 million pairs."""
    rows = spark.range(24_000).select(F.floor(F.col("id") / 2).alias("l_orderkey"), (F.col("id") % 2 + 1).cast("int").alias("l_linenumber"), F.lit("N").alias("l_returnflag"), F.lit(5.0).alias("l_quantity"), (F.col("id") + 100.0).alias("l_extendedprice"))
    rows.write.parquet(f"{tmp_path}/lineitem.parquet")
    found = __spark_entry__.queries()["geometry_ranked_patches"](spark, str(tmp_path)).collect()
    assert len(found) == 11_999 and all(r.patched and r.exact and r.tried <= 4 for r in found)


def _told(spark, df):
    """The rows, and a count of how many of them were read so far."""
    seen = spark.sparkContext.accumulator(0)

    def run(batches):
        for rows in batches:
            seen.add(rows.num_rows)
            yield rows

    return df.mapInArrow(run, df.schema), seen


def test_files_are_read_and_compressed_once(spark):
    objects, seen = _told(spark, spark.createDataFrame([(i, bytes(range(200)) * 20 + b"%d" % i) for i in range(40)], "ord long, bytes binary"))
    proposals = spark.range(1, 40).select(F.explode(F.array(F.lit("a"), F.lit("b"))).alias("arm"), F.col("id").alias("ord"), F.explode(F.array(F.lit(0).cast("long"), F.col("id") - 1)).alias("base"))
    found = M.choose_for_arms(objects, proposals, {"a": 1, "b": 1 << 30}).collect()
    assert seen.value == 40
    assert [(r.arm, r.base is not None, r.attempts) for r in sorted(found, key=lambda r: (r.arm, r.ord))] == [("a", i > 0, min(i, 2)) for i in range(40)] + [("b", False, min(i, 2)) for i in range(40)]


@pytest.mark.parametrize("name, sized", [("proposal_funnel", [False]), ("arm_candidates", [True]), ("arm_comparison", [True])])
def test_only_rankings_that_are_asked_for_are_made(spark, monkeypatch, name, sized):
    calls, nearest = [], M.nearest
    monkeypatch.setattr(M, "nearest", lambda counts, sized, latest: calls.append(sized) or nearest(counts, sized, latest))
    assert __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001").count() > 0
    assert calls == sized


def test_drawings_are_made_once(spark, monkeypatch):
    made = []

    def told(*a):
        made.append(_told(spark, objects(*a)))
        return made[-1][0]

    objects = ledger_queries._objects
    monkeypatch.setattr(ledger_queries, "_objects", told)
    found = __spark_entry__.queries()["geometry_ranked_patches"](spark, "/root/testdata/sf0.001").collect()
    assert len(found) > 100 and all(r.patched and r.exact for r in found)
    assert [seen.value for _, seen in made] == [objects(spark, "/root/testdata/sf0.001").count()]


@pytest.mark.parametrize("sized", [False, True])
def test_classes_in_many_parts(spark, sized):
    rng = random.Random(3)
    counts = spark.createDataFrame([(o, f, rng.randrange(1, 4)) for o in range(120) for f in rng.sample("abcdefgh", 3)], "ord long, feature string, n long")
    one, many = (sorted(M.nearest(counts, sized, False, often=1, each=e).collect()) for e in (1 << 20, 1))
    assert one and one == many


@pytest.mark.parametrize("sized, latest", [(False, False), (True, False), (True, True)])
def test_copies_are_one_text(spark, monkeypatch, sized, latest):
    """400 files of 24 texts, some without copies: nothing is written by file or by pair of files, whatever the features' frequency, and ranks are those of all pairs."""
    rng = random.Random(5)
    texts = [{rng.choice("abcdefghijkl"): rng.randrange(1, 4) for _ in range(rng.randrange(1, 5))} for _ in range(24)]
    of = [*range(24), *(rng.randrange(12) for _ in range(376))]
    rng.shuffle(of)
    counts = spark.createDataFrame([(o, f, n if sized else 1) for o, t in enumerate(of) for f, n in texts[t].items()], "ord long, feature string, n long")
    best = M.normalised(counts) if sized else M.overlaps(counts).withColumn("ratio", F.col("shared").cast("double"))
    every = M.top(best, F.desc("ratio"), F.desc("shared"), F.desc("base") if latest else F.col("base"))
    rows, written = [], M.written

    def told(df):
        out = written(df)
        rows.append(out.count())
        return out

    monkeypatch.setattr(M, "written", told)
    wanted = sorted(every.select("ord", "base", "shared", "ratio", "rank").collect())
    for often in (2, 1000):
        assert sorted(M.nearest(counts, sized, latest, often=often).select("ord", "base", "shared", "ratio", "rank").collect()) == wanted
    assert max(rows) <= 24 * 23 / 2


@pytest.mark.parametrize("name, times", [("arm_candidates", 1), ("arm_comparison", 2)])
def test_documents_are_read_once_for_names_and_lines(spark, monkeypatch, name, times):
    """The comparison reads the ids of its files besides."""
    made, table = [], O.table

    def told(*a):
        df, seen = _told(spark, table(*a))
        made.append(seen)
        return df

    monkeypatch.setattr(O, "table", told)
    assert __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001").collect()
    assert sum(seen.value for seen in made) == times * table(spark, "/root/testdata/sf0.001", "documents").count()


def test_a_funnel_over_copies(spark, monkeypatch, tmp_path):
    """240 documents of four texts are ranked as four."""
    text = F.concat_ws("\n", F.lit("a line"), F.concat(F.lit("text "), F.col("id") % 4))
    spark.range(240).select(F.col("id").alias("doc_id"), text.alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source")).write.parquet(f"{tmp_path}/documents.parquet")
    ranked, written = [], M.written

    def told(df):
        out = written(df)
        if "entries" in out.columns:
            ranked.append(out.count())
        return out

    monkeypatch.setattr(M, "written", told)
    r = __spark_entry__.queries()["proposal_funnel"](spark, str(tmp_path)).first()
    assert (r.n_files, r.proposed, r.accepted, r.too_small, r.unproposed) == (240, 239, 0, 239, 1)
    assert ranked == [4]


def test_lists_are_the_multisets_of_their_features(spark):
    """Files as lists of features, one of them in two rows, one empty, and several equal: ranks are those of the counted features, also if only the best is asked for."""
    rng = random.Random(9)
    lists = [(i % 70, sorted(rng.choice("abcdefghijkl").encode() for _ in range(rng.randrange(6)))) for i in range(71)]
    listed = spark.createDataFrame([*lists, (None, [b"a"])], "ord long, features array<binary>")
    counts = listed.select("ord", F.explode("features").alias("feature")).groupBy("ord", "feature").agg(F.count("*").alias("n"))
    for sized, latest in ((False, False), (True, False), (True, True)):
        wanted = M.nearest(counts if sized else counts.withColumn("n", F.lit(1)), sized, latest, often=3)
        wanted = sorted(wanted.select("ord", "base", "shared", "ratio", "rank").collect())
        for k in (1, 3):
            texts = M.texts(listed, k)
            found = M.nearest(texts if sized else texts.once(), sized, latest, often=3).select("ord", "base", "shared", "ratio", "rank")
            assert sorted(found.collect()) == [r for r in wanted if r.rank <= k]
    assert len(wanted) > 100


def test_a_comparison_asks_for_the_best_base_only(spark, monkeypatch):
    """Three bases for each document were ranked before; and lines are counted for one document of each text."""
    asked, nearest = [], M.nearest
    monkeypatch.setattr(M, "nearest", lambda counts, sized, latest: asked.append(nearest(counts, sized, latest)) or asked[-1])
    rows = {r.arm: r for r in __spark_entry__.queries()["arm_comparison"](spark, "/root/testdata/sf0.001").collect()}
    assert len(rows) == 2 and rows["name"].n_files == rows["key"].n_files
    assert [r.rank for r in asked[0].select("rank").distinct().collect()] == [1]


def test_a_pair_of_texts_is_patched_once(spark, monkeypatch):
    """40 files of two texts, all on all earlier ones: sizes are those of plain patches, and four patches are made."""
    made, tries = spark.sparkContext.accumulator(0), M._tries

    def told(rows):
        out = tries(rows)
        made.add(len(out))
        return out

    monkeypatch.setattr(M, "_tries", told)
    objects = spark.createDataFrame([(i, bytes(range(200 + i % 2)) * 20) for i in range(40)], "ord long, bytes binary")
    proposals = spark.range(40).select(F.col("id").alias("ord")).join(spark.range(40).select(F.col("id").alias("base"))).where("base < ord")
    found = sorted(M.choose_bases(objects, proposals, 1).collect(), key=lambda r: r.ord)
    assert made.value == 4
    sizes = {(r.ord, r.base): r.size for r in proposals.where("base < 2").join(objects, "ord").join(objects.select(F.col("ord").alias("base"), F.col("bytes").alias("b")), "base").select("ord", "base", F.octet_length(M.patch("b", "bytes")).alias("size")).collect()}
    for r in found[1:]:
        size, base = min((sizes[r.ord, b], b) for b in (0, 1) if b < r.ord)
        assert (r.attempts, r.exact, r.base, r.selected) == (r.ord, True, *((base, size) if size < r.standalone else (None, r.standalone)))


def test_files_too_small_for_a_gain_are_not_patched(spark):
    rng = random.Random(2)
    objects = spark.createDataFrame([(i, bytes(rng.randrange(256) for _ in range(300 * (i // 2 + 1)))) for i in range(12)], "ord long, bytes binary")
    objects = objects.unionByName(objects.select(F.col("ord") + 12, "bytes").toDF("ord", "bytes"))
    proposals = spark.range(12, 24).select(F.col("id").alias("ord"), (F.col("id") - 12).alias("base"))
    every, some = (sorted(M.choose_bases(objects, proposals, 1024, bounded).collect()) for bounded in (False, True))
    assert [(r.ord, r.base, r.selected) for r in every] == [(r.ord, r.base, r.selected) for r in some]
    assert sum(r.attempts for r in every) == 12 and sum(r.attempts for r in some) == 6 and sum(r.base is not None for r in some) == 6


@pytest.mark.parametrize("sized, few, mean", [(True, 16, 1 << 20), (True, 2, 1 << 20), (True, 16, 2), (True, 16, 0), (False, 16, 1 << 20), (False, 1, 1 << 20)])
def test_many_classes_meet_by_what_they_have_in_common(spark, monkeypatch, sized, few, mean):
    """Few classes in all are held against each other at once, whatever their number, and ranks are those of all pairs."""
    rng = random.Random(7)
    rows = {(i, rng.choice("abcdefgh")): rng.randrange(1, 3) if sized else 1 for i in range(160) for _ in range(rng.randrange(6))}
    counts = spark.createDataFrame([(*x, n) for x, n in rows.items()] + [(i, f"rare{i // 2}", 1) for i in range(0, 160, 3)], "ord long, feature string, n long").cache()
    every = M.normalised(counts) if sized else M.overlaps(counts).withColumn("ratio", F.col("shared").cast("double"))
    ranked = M.top(every, F.desc("ratio"), F.desc("shared"), F.col("base")).select("ord", "base", "shared", "ratio", "rank")
    taken, among = spark.sparkContext.accumulator(0), M._among_classes

    def told(*a):
        run = among(*a)

        def counted(found):
            if mean > 2 and few > 2:
                taken.add(len(found))
            assert len(found) <= 48
            return run(found)

        return counted

    monkeypatch.setattr(M, "_among_classes", told)
    for name, value in (("PARTS", 1), ("FEW", few), ("MEAN", mean), ("HELD", 8), ("SUBSETS", 100), ("SLICE", 2)):
        monkeypatch.setattr(M, name, value, raising=False)
    found = M.nearest(counts, sized, False, often=2, each=8).select(*ranked.columns)
    assert sorted(found.collect()) == sorted(ranked.collect())
    assert taken.value == 0


def test_patches_on_bases_of_many_classes(spark, monkeypatch):
    """Where drawings' classes are many no task takes all of them, and the choices are those made where they are few."""
    query, among = __spark_entry__.queries()["geometry_ranked_patches"], M._among_classes
    rows = sorted(query(spark, "/root/testdata/sf0.001").collect())
    taken = spark.sparkContext.accumulator(0)

    def told(*a):
        run = among(*a)

        def counted(found):
            taken.add(len(found))
            return run(found)

        return counted

    monkeypatch.setattr(M, "_among_classes", told)
    monkeypatch.setattr(M, "PARTS", 0)
    assert sorted(query(spark, "/root/testdata/sf0.001").collect()) == rows
    assert len(rows) > 100 and taken.value == 0
