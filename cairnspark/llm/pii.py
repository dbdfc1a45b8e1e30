"""Operator 10, personal data by bootstrapped contextual extraction, in DataFrame operations only.

Seeds are the matches of fixed patterns for e-mail and network addresses, card
and phone numbers, and of values that words for credentials introduce.  What
stands around a seed, and its form, are its lexical patterns: the two words
before it, the label that it is assigned to, and for numbers their shape.
Patterns and the identifiers that they mark form a graph; rounds of scoring
trust patterns that mostly mark known identifiers, and identifiers that trusted
patterns mark, so that those which no fixed pattern matches are found: numbers
run together with others, values that don't look like any seed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import kept

#: Kinds of the contract's patterns, and the kind that the method adds.
KINDS = ("email", "ip", "card", "phone")
NAMES = (*KINDS, "secret")
SECRET, CANDIDATE, RUN = 4, 5, 6

# The contract's patterns, written so that they take linear time and no deep recursion: possessive where what follows can't
# begin as the repeated part does, and tried only where a leftmost match can begin.  A card is a maximal run of digits with
# single separators, so its bounds on digits are part of the pattern.
_LOCAL = r"[A-Za-z0-9._%+-]"
_DOMAIN = r"[A-Za-z0-9-]"
_TOKEN = r"[0-9A-Za-z._%+@-]"
PATTERNS = (
    rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@{_DOMAIN}++(?:\.{_DOMAIN}++)++",
    r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){13,18}+(?![ -]?[0-9])",
    r"\+[0-9][ ().0-9-]+[0-9]",
    None,
    rf"(?<!{_TOKEN})(?=AKIA|[A-Za-z._%+-]*+[0-9@]){_TOKEN}{{6,}}+",
    r"(?<![0-9().+-])[0-9+(][0-9().+-]*+(?: [0-9+(][0-9().+-]*+)++",
)
#: What a text must have for a pattern to be tried.
HINTS = ("@", "[0-9]", "[0-9]", "[+]", None, "[0-9@]|AKIA", "[0-9] [0-9+(]|[0-9)] [0-9(]")
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"

#: Words for credentials, whose random-looking values are seeds, and the fixed form of access-key ids; fixed values.
CREDENTIAL = r"""(?:password|passwd|pwd|secret|token|api_?key|access_?key|credential)s?\s*[=:]\s*["'`]?$"""
ACCESS_KEY = "^AKIA[A-Z0-9]{16}$"
#: A random-looking value: so long, with a digit after a letter twice.
RANDOM = "^(?=.{12})[^A-Za-z]*+[A-Za-z]++[^A-Za-z0-9]*+[0-9]++[^A-Za-z]*+[A-Za-z]++[^A-Za-z0-9]*+[0-9]"
#: Signs before an identifier of which patterns are made, and the words taken.
REACH, PATTERN_WORDS = 80, 2
#: Pieces of a run of numbers that make one candidate; digits of a number that has a shape.
PIECES, SHAPED = 4, (7, 32)
#: A pattern counts from so many distinct known identifiers of a kind, and such a share of all others that it marks.
LEAST_SEEDS, LEAST_SHARE = 3, 0.5
#: A new identifier's patterns together give it such a confidence; one pattern with that share is enough.
LEAST_CONFIDENCE = 0.8
ROUNDS = 3
#: Parts of a pattern's identifiers in the join with trusted patterns, so that a pattern of very many is no hot key.
SALTS = 16


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(text: Column) -> Column:
    back = F.reverse(_digits(text))
    value = lambda i: F.substring(back, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
    total = F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(back), F.lit(1))), F.lit(0), lambda a, i: a + value(i) - F.when(value(i) > 9, 9).otherwise(0))
    return total % 10 == 0


def _valid(kind: Column, text: Column) -> Column:
    n = F.length(_digits(text))
    return (
        F.when(kind == 1, text.rlike(rf"^(?:{_PART}\.){{3}}{_PART}$"))
        .when(kind == 2, n.between(14, 19) & _luhn(text))
        .when(kind == 3, n.between(10, 15))
        .when(kind == CANDIDATE, (n >= 4) | F.contains(text, F.lit("@")) | (F.length(text) >= 12))
        .when(kind == RUN, n.between(*SHAPED))
        .otherwise(True)
    )


def _found(kind: int, text: Column) -> Column:
    """Structs of a match, the length of the text since the match before, and the end of that text."""
    pattern = PATTERNS[kind]
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    pair: Callable[[Column, Column], Column] = lambda m, s: F.struct(F.lit(kind).alias("kind"), m.alias("found"), F.char_length(s).alias("gap"), F.right(s, F.lit(REACH)).alias("before"))
    both = F.filter(F.zip_with(matches, between, pair), lambda x: x["found"].isNotNull())
    hint = F.contains(text, F.lit(HINTS[kind])) if HINTS[kind] == "@" else text.rlike(HINTS[kind])
    return F.when(hint, both).otherwise(F.array().cast("array<struct<kind: int, found: string, gap: int, before: string>>"))


def _pieces(placed: DataFrame) -> DataFrame:
    """Candidates from runs of numbers with single spaces: two to PIECES neighbouring pieces."""
    by = Window.partitionBy("id", "mark", "kind", "pos").orderBy("piece_no")
    each = placed.where(F.col("kind") == RUN).select("id", "mark", "kind", "pos", "start", "before", F.posexplode(F.split("found", " ")).alias("piece_no", "piece"))
    at = F.coalesce(F.sum(F.char_length("piece") + 1).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    several = each.select("*", at.alias("at"), *(F.lead("piece", k).over(by).alias(f"next{k}") for k in range(1, PIECES)))
    text = lambda k: F.when(F.col(f"next{k}").isNotNull(), F.concat_ws(" ", "piece", *(f"next{x}" for x in range(1, k + 1))))
    joined = several.select("id", "mark", "kind", "pos", "at", "start", "before", F.explode(F.array_compact(F.array(*(text(k) for k in range(1, PIECES))))).alias("found"))
    start = F.col("start") + F.col("at")
    # Only the first piece has the words before the run.
    return joined.select("id", "mark", "kind", start.alias("start"), (start + F.char_length("found")).alias("end"), "found", F.when(F.col("at") == 0, F.col("before")).otherwise(F.lit("")).alias("before"))


def _patterns(kind: Column, found: Column, before: Column) -> Column:
    """The lexical patterns of a mention: words before, label, shape."""
    tail = F.lower(F.regexp_extract(before, rf"(?:\S++\s+){{0,{PATTERN_WORDS - 1}}}\S++\s*$", 0))
    words = F.trim(F.regexp_replace(tail, r"[\s0-9]+", " "))
    label = F.regexp_replace(F.lower(F.regexp_extract(before, r"""[\p{L}_][\p{L}0-9_.-]*\s*[=:]\s*["'`]?$""", 0)), r"\s+", " ")
    digits = F.length(_digits(found))
    numeric = ~found.rlike("[A-Za-z@%_]") & digits.between(*SHAPED) & ~found.rlike(r"^[0-9]+(?:\.[0-9]+)+$")
    checked = F.when(digits.between(14, 19), F.when(_luhn(found), F.lit(" checked"))).otherwise(F.lit(""))
    shape = F.when(numeric, F.concat(F.regexp_replace(found, "[0-9]", "9"), checked))
    return F.array_compact(F.array(F.when(words.rlike(r"\p{L}"), F.concat(F.lit("words "), words)), F.when(label != "", F.concat(F.lit("label "), label)), F.concat(F.lit("shape "), shape)))


def mentions(docs: DataFrame) -> DataFrame:
    """(id, mark, kind, start, end, found, seed, patterns) of valid matches and of candidates that touch none.

    ``docs`` has id, mark, text; rows equal in id and mark count once.  Places
    are running sums of lengths within a document.  ``seed``: the kind of a
    known identifier, else null.
    """
    each = docs.select("id", "mark", F.posexplode_outer(F.concat(*(_found(k, F.col("text")) for k, p in enumerate(PATTERNS) if p)))).where("col is not null").select("id", "mark", "pos", "col.*").dropDuplicates(["id", "mark", "pos"])
    so_far = Window.partitionBy("id", "mark", "kind").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    size = F.char_length("found")
    placed = each.withColumn("end", F.sum(F.col("gap") + size).over(so_far)).withColumn("start", F.col("end") - size)
    whole = placed.where(F.col("kind") != RUN).select("id", "mark", "kind", "start", "end", "found", "before").unionByName(_pieces(placed))
    # Signs that end a sentence are no part of a candidate.
    cut = F.when(F.col("kind") >= CANDIDATE, F.regexp_replace("found", r"[._%+(-]++$", "")).otherwise(F.col("found"))
    whole = whole.withColumn("cut", cut).withColumn("end", F.col("end") - F.char_length("found") + F.char_length("cut")).drop("found").withColumnRenamed("cut", "found")
    whole = whole.where(_valid(F.col("kind"), F.col("found")))
    is_base = F.col("kind") < SECRET
    up, down = (Window.partitionBy("id", "mark").orderBy(*o).rowsBetween(Window.unboundedPreceding, -1) for o in (("start", "kind", "end"), (F.desc("start"), F.desc("kind"), F.desc("end"))))
    reached, following = F.max(F.when(is_base, F.col("end"))).over(up), F.min(F.when(is_base, F.col("start"))).over(down)
    clear = (F.coalesce(reached, F.lit(0)) <= F.col("start")) & (F.coalesce(following, F.col("end")) >= F.col("end"))
    placed = whole.withColumn("clear", is_base | clear).where("clear")
    secret = F.col("found").rlike(ACCESS_KEY) | (F.lower("before").rlike(CREDENTIAL) & F.col("found").rlike(RANDOM))
    seed = F.when(is_base, F.col("kind")).when((F.col("kind") == CANDIDATE) & secret, SECRET)
    return placed.select("id", "mark", "kind", "start", "end", "found", seed.alias("seed"), _patterns(F.col("kind"), F.col("found"), F.col("before")).alias("patterns"))


def identifiers(found: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(found, kind, round): the known identifiers (round 0) and those that trusted patterns mark, from the graph of patterns and mentions.

    Edges are distinct, so a pattern before very many mentions costs a row per
    identifier and task.  A kind's known identifiers of a pattern over all
    others that it marks, but for the one in question, are the pattern's share;
    an identifier's confidence is the chance that not all of its patterns err.
    Of kinds with equal confidence the first counts.
    """
    edges = kept(found.select(F.explode("patterns").alias("pattern"), "found", "seed").groupBy("pattern", "found").agg(F.min("seed").alias("seed")))
    seeds = kept(found.where("seed is not null").groupBy("found").agg(F.min("seed").alias("kind")).withColumn("round", F.lit(0)))
    unknown = kept(edges.select("pattern", "found").join(seeds.select("found").hint("merge"), "found", "left_anti").withColumn("salt", F.pmod(F.xxhash64("found"), F.lit(SALTS)).cast("int")))
    total = edges.groupBy("pattern").agg(F.count("*").alias("n"))
    known = seeds
    for k in range(1, rounds + 1):
        scored = edges.select("pattern", "found").join(known.hint("merge"), "found").groupBy("pattern", "kind").agg(F.count("*").alias("hits")).where(F.col("hits") >= LEAST_SEEDS).join(total, "pattern")
        share = F.col("hits") / F.greatest(F.col("n") - 1, F.col("hits"))
        trusted = scored.where(share >= LEAST_SHARE).select("pattern", "kind", F.least(share, F.lit(0.99)).alias("trust"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        voted = unknown.join(trusted, ["pattern", "salt"]).groupBy("found", "kind").agg((1 - F.exp(F.sum(F.log(1 - F.col("trust"))))).alias("confidence")).where(F.round("confidence", 9) >= LEAST_CONFIDENCE)
        best = voted.groupBy("found").agg(F.max_by("kind", F.struct("confidence", -F.col("kind"))).alias("kind"))
        known = kept(seeds.unionByName(best.withColumn("round", F.lit(k))))
    return known


def spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, mark, spans): per document with any, its spans in order of start and kind.

    A span has start, kind (its place in NAMES), end (code points, exclusive)
    and base (whether one of the contract's patterns matched it).  Null and
    empty texts have none; rows equal in id and text, null ids included, have
    one result.  Candidates are unbroken tokens of six or more ASCII signs with
    a digit or an at sign (four digits, an at sign, or twelve signs), and two to
    four neighbouring pieces of a run of numbers; patterns are read off the 80
    code points before.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("mark", F.xxhash64("text"))
    found = kept(mentions(rows))
    more = found.where(F.col("kind") >= CANDIDATE).drop("kind").join(identifiers(found).select("found", "kind").hint("merge"), "found").select("id", "mark", "start", "end", "kind")
    # Of candidates within one another the longest counts.
    before = Window.partitionBy("id", "mark").orderBy("start", F.desc("end"), "kind").rowsBetween(Window.unboundedPreceding, -1)
    more = more.withColumn("reached", F.coalesce(F.max("end").over(before), F.lit(0))).where("end > reached").drop("reached")
    every = found.where(F.col("kind") < SECRET).select("id", "mark", "start", "end", "kind", F.lit(True).alias("base")).unionByName(more.withColumn("base", F.lit(False)))
    one = F.struct(F.col("start").cast("int").alias("start"), "kind", F.col("end").cast("int").alias("end"), "base")
    return every.groupBy("id", "mark").agg(F.array_sort(F.collect_list(one)).alias("spans"))


def with_spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", out_col: str = "spans") -> DataFrame:
    """Every input row with the spans of personal data in its whole text; see ``spans``.

    All columns stay; a column named ``out_col`` is an error.  An empty table
    stays empty.
    """
    if out_col in docs.columns:
        raise ValueError(f"the input has a column named {out_col}")
    found = spans(docs, id_col=id_col, text_col=text_col).alias("f")
    left = docs.alias("d")
    same = F.col(f"d.`{id_col}`").eqNullSafe(F.col("f.id")) & (F.xxhash64(F.coalesce(F.col(f"d.`{text_col}`"), F.lit(""))) == F.col("f.mark"))
    none = F.array().cast("array<struct<start: int, kind: int, end: int, base: boolean>>")
    return left.join(found, same, "left").select("d.*", F.coalesce("f.spans", none).alias(out_col))


def written(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    name = lambda k: F.element_at(F.array(*map(F.lit, NAMES)), k + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s["kind"]), s["start"], s["end"])), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in angle brackets; of overlapping spans the first counts, and what later ones add to it goes too."""
    name = lambda k: F.element_at(F.array(*(F.lit(f"<{x.upper()}>") for x in NAMES)), k + 1)
    start = F.struct(F.array().cast("array<string>").alias("parts"), F.lit(0).alias("at"))

    def step(a: Column, s: Column) -> Column:
        apart = s["start"] >= a["at"]
        added = F.array(F.substring(text, a["at"] + 1, s["start"] - a["at"]), name(s["kind"]))
        return F.struct(F.when(apart, F.concat(a["parts"], added)).otherwise(a["parts"]).alias("parts"), F.greatest(a["at"], s["end"]).alias("at"))

    done = F.aggregate(spans, start, step, lambda a: F.concat(F.array_join(a["parts"], ""), F.substring(text, a["at"] + 1, F.char_length(text))))
    return F.when(F.size(spans) == 0, text).otherwise(done)
