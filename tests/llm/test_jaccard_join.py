import random
import time

from pyspark.sql import functions as F

from cairnspark.llm import jaccard_join, shared

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, width, link):
    sets = []
    for _, text in rows:
        words = [w for w in (text or "").translate(LOWER).replace("\t", " ").replace("\n", " ").split(" ") if w]
        sets.append({tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if len(words) >= width else ({tuple(words)} if words else set()))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= link * len(a | sets[j]):
                root[find(i)] = find(j)
    out = []
    for i, (key, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((key, len(sets[i]), min(ids) if ids and sets[i] else key))
    return sorted(out, key=str)


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted((tuple(r) for r in jaccard_join.linked(df, **kw).collect()), key=str)


def test_components_name_each_id_once(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 105), (105, 103), (7, 7), (50, 51), (51, 50)]
    found = jaccard_join.components(spark.createDataFrame(chain, "a long, b long")).collect()
    assert len({r.id for r in found}) == len(found)
    assert {r.id: r.root for r in found} == {i: 0 for i in range(1, 41)} | {105: 100, 103: 100, 51: 50}


def test_no_edges(spark):
    assert jaccard_join.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_against_all_pairs(spark):
    rng = random.Random(4)
    base = [[f"w{rng.randrange(400)}" for _ in range(rng.choice([5, 30, 90]))] for _ in range(6)]
    rows = []
    for k in range(150):
        words = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 4])):
            words[rng.randrange(len(words))] = f"x{rng.randrange(50)}"
        rows.append((k, " ".join(words)))
    rows += [(200, None), (201, ""), (202, "one two"), (203, "ONE two"), (204, "one"), (205, " \n"), (None, "one two"), (None, rows[3][1]), (3, rows[3][1]), (7, "a b c d"), (7, "e f g h")]
    assert run(spark, rows) == brute(rows, 4, 85)
    assert run(spark, rows, width=5, link=80) == brute(rows, 5, 80)


def test_a_group_that_straddles_the_threshold(spark):
    """Many variants of one text, of which few pairs link: the blocked product must find what two pivots miss."""
    rng = random.Random(9)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for k in range(120):
        words = list(base)
        for _ in range(rng.choice([1, 2, 3])):
            words[rng.randrange(60)] = f"v{k}"
        rows.append((k, " ".join(words)))
    assert run(spark, rows) == brute(rows, 4, 85)


def test_empty_table_and_extra_columns(spark):
    df = spark.createDataFrame([], "n long, node string, doc_id long, text string")
    assert jaccard_join.linked(df).collect() == []


def test_shuffle_files_of_what_is_kept_go(spark):
    """Before, those of every round stayed until the driver happened to collect its garbage."""
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def files():
        found = manager.getAllFiles()
        return {name for i in range(found.size()) if (name := found.apply(i).getName()).startswith("shuffle_")}

    name, before = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", files()
    set_to = spark.conf.get(name)
    rows = shared.kept(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    until = time.time() + 20  # they go in the background
    while not files() <= before and time.time() < until:
        time.sleep(0.1)
    assert files() <= before
    assert sorted(r["count"] for r in rows.collect()) == [142] + [143] * 6
    assert spark.conf.get(name) == set_to
