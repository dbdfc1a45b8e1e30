"""Operator 5, benchmark decontamination by winnowing, in DataFrame operations only.

Of every window of consecutive gram hashes, a text keeps the smallest.  Two
texts that share a long enough run of words share a kept hash, so a join of
training and test fingerprints misses no such run.  Around each hit the
candidate windows are then compared word by word.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of a window that counts as contamination.
WINDOW = 10
#: Words of a gram.  WINDOW - GRAM + 1 grams lie in a window, and the smallest of them is kept.
GRAM = 4
#: Rows of fingerprints or windows of the test set up to which they are broadcast; larger ones are shuffled.
BROADCAST_ROWS = 200_000

WORD = r"[0-9a-z\x80-\x{10FFFF}]+"
ANY_WORD = r"[0-9A-Za-z\x80-\x{10FFFF}]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, _UPPER, _LOWER), F.lit(WORD), F.lit(0))


def _next(a: Column, step: int) -> Column:
    """The array without its first ``step`` entries."""
    return F.slice(a, step + 1, F.greatest(F.size(a) - step, F.lit(0)))


def _marked(length: int, name: str) -> Callable[[Column], Column]:
    """A value with the length of its window."""
    return lambda x: F.struct(F.lit(length).alias("length"), x.alias(name))


def _of_length(length: int) -> Callable[[Column], Column]:
    return lambda x: x["length"] == length


def _chained(hashes: Column, n: int) -> Column:
    """Hashes of n consecutive words, one for each word; the last n-1 run over the end."""
    out = hashes
    for k in range(1, n):
        out = F.zip_with(out, _next(hashes, k), lambda a, b: F.xxhash64(a, b))
    return out


def with_grams(df: DataFrame, short: list[int]) -> DataFrame:
    """From a column ``words``: ``grams`` (hashes of GRAM words, one for each place) and ``prints``, structs of a window length and a hash.

    Windows of WINDOW words get winnowed hashes.  ``short`` lists the lengths
    of test items below WINDOW words; for each, the hash of every run of so
    many words is kept.
    """
    n = F.size("words")
    df = df.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    df = df.withColumn("pairs", F.zip_with("hashes", _next(F.col("hashes"), 1), lambda a, b: F.xxhash64(a, b)))
    df = df.withColumn("grams", F.slice(F.zip_with("pairs", _next(F.col("pairs"), 2), lambda a, b: F.xxhash64(a, b)), 1, F.greatest(n - (GRAM - 1), F.lit(0))))
    # The minimum of 7 by those of 2 and 4; at the end of a text the windows are shorter, which keeps more.
    low = F.col("grams")
    for k, (name, step) in enumerate((("low2", 1), ("low4", 2), ("low7", 3))):
        df = df.withColumn(name, F.zip_with(low, _next(low, step), lambda a, b: F.least(a, b)))
        low = F.col(name)
    assert WINDOW - GRAM + 1 == 7
    prints = F.transform(F.array_distinct("low7"), _marked(WINDOW, "print"))
    for length in short:
        runs = F.slice(_chained(F.col("hashes"), length), 1, F.greatest(n - (length - 1), F.lit(0)))
        prints = F.concat(prints, F.transform(F.array_distinct(runs), _marked(length, "print")))
    return df.withColumn("prints", prints)


def _small(df: DataFrame) -> DataFrame:
    """Broadcast if its counted rows are few."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _window_text(start: Column, length: Column) -> Column:
    return F.array_join(F.slice(F.col("words"), start + 1, length), " ")


def text_mark(text: Column) -> Column:
    """The hash by which texts are told apart; a null text is an empty one."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def contaminated(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", mark_col: str | None = None) -> DataFrame:
    """Finds test items in documents: (id, n_words, spans, items) for every row of ``docs``.

    A window is WINDOW consecutive words of an item, or the whole item if it
    has fewer but not none.  ``spans``: [start, end) of words, one for each
    occurrence of a window; ``items``: ids, as sorted strings, of the items
    with occurring windows; both empty if there are none.  A null text has no
    words; a null item id is an empty string.  Rows of ``docs`` equal in id and
    text get the same result each, null ids included; further columns are
    ignored; empty tables give empty results.  ``mark_col`` names a further
    column of ``text_mark``, which tells rows of one id apart.
    """
    tests = items.select(F.coalesce(F.col(item_id_col).cast("string"), F.lit("")).alias("item"), words(F.col(item_text_col)).alias("words")).where(F.size("words") > 0)
    sizes = [r[0] for r in tests.where(F.size("words") < WINDOW).select(F.size("words")).distinct().collect()]  # 1 to 9
    length = F.least(F.size("words"), F.lit(WINDOW))
    test_windows = tests.select("item", length.alias("length"), F.explode_outer(F.transform(F.sequence(F.lit(0), F.size("words") - length), lambda s: _window_text(s, length))).alias("window"))
    test_prints = with_grams(tests, sorted(sizes)).select(F.size("words").alias("n"), F.explode_outer("prints").alias("p")).where((F.col("p.length") == F.col("n")) | ((F.col("p.length") == WINDOW) & (F.col("n") >= WINDOW))).select("p.length", "p.print").distinct()

    # An inner explode would have the optimiser push a test of the array's size down through the projections, writing each of them out
    # several times in the next; the outer one, without its nulls, is the same and does not.
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("mark", text_mark(F.col("text")))
    printed = with_grams(rows.select("id", "mark", words(F.col("text")).alias("words")), sorted(sizes)).select("id", "mark", F.explode_outer("prints").alias("p")).where("p is not null").select("id", "mark", "p.length", "p.print")
    hits = printed.join(_small(test_prints), ["length", "print"]).groupBy("id", "mark").agg(F.collect_set(F.struct("length", "print")).alias("hits"))

    # Extension: every window that holds a hit, compared by its words.
    same = lambda a, b: F.col(f"{a}.id").eqNullSafe(F.col(f"{b}.id")) & (F.col(f"{a}.mark") == F.col(f"{b}.mark"))
    found = rows.alias("d").join(hits.alias("h"), same("d", "h")).select("d.id", "d.mark", words(F.col("d.text")).alias("words"), "h.hits").dropDuplicates(["id", "mark"])
    n = F.size("words")
    none = F.array().cast("array<int>")
    found = with_grams(found, []).withColumn("wanted", F.transform(F.filter("hits", _of_length(WINDOW)), lambda x: x["print"]))
    found = found.withColumn("places", F.when((n >= WINDOW) & (F.size("wanted") > 0), F.filter(F.sequence(F.lit(0), n - GRAM), lambda p: F.array_contains("wanted", F.get(F.col("grams"), p)))).otherwise(none))
    around = F.transform("places", lambda p: F.sequence(F.greatest(p - (WINDOW - GRAM), F.lit(0)), F.least(p, n - WINDOW)))
    starts = [F.transform(F.array_distinct(F.flatten(around)), _marked(WINDOW, "start"))]
    for size in sorted(sizes):
        wanted = F.size(F.filter("hits", _of_length(size))) > 0
        every = F.when(wanted & (n >= size), F.sequence(F.lit(0), n - size)).otherwise(none)
        starts.append(F.transform(every, _marked(size, "start")))
    placed = found.select("id", "mark", "words", F.concat(*starts).alias("starts"))
    texts = F.transform("starts", lambda s: F.struct(s["start"].alias("start"), s["length"].alias("length"), _window_text(s["start"], s["length"]).alias("window")))
    candidates = placed.select("id", "mark", F.explode_outer(texts).alias("w")).where("w is not null").select("id", "mark", "w.start", "w.length", "w.window")
    matched = candidates.join(_small(test_windows.select("length", "window").distinct()), ["length", "window"])
    spans = matched.groupBy("id", "mark").agg(F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("length")).alias("end")))).alias("spans"))
    held = matched.select("id", "mark", "length", "window").distinct().join(test_windows, ["length", "window"]).select("id", "mark", "item").distinct()
    listed = held.groupBy("id", "mark").agg(F.array_sort(F.collect_list("item")).alias("items"))
    both = spans.alias("s").join(listed.alias("i"), same("s", "i")).select("s.id", "s.mark", "s.spans", "i.items")
    counted = rows.select("id", "mark", F.regexp_count("text", F.lit(ANY_WORD)).cast("long").alias("n_words"))
    out = counted.alias("c").join(both.alias("b"), same("c", "b"), "left").select(
        F.col("c.id").alias(id_col),
        "n_words",
        F.coalesce("b.spans", F.array().cast("array<struct<start: int, end: int>>")).alias("spans"),
        F.coalesce("b.items", F.array().cast("array<string>")).alias("items"),
        *([F.col("c.mark").alias(mark_col)] if mark_col else []),
    )
    return out


def covered(spans: str) -> Column:
    """Words inside any of the spans: each adds what reaches beyond those before it."""
    step = F.aggregate(
        spans,
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("to")),
        lambda a, s: F.struct((a["n"] + F.greatest(s["end"] - F.greatest(s["start"], a["to"]), F.lit(0))).alias("n"), F.greatest(a["to"], s["end"]).alias("to")),
    )
    return step["n"].cast("long")
