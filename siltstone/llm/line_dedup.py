"""Line deduplication by a segment-partition edit join (DataFrame functions only).

Two lines are linked if their edit distance is at most THRESHOLD = 1, so a line
falls into THRESHOLD + 1 = 2 segments of which one must be intact.  The index
is aware of lengths: a line of n characters is listed by its two segments
under n, and probes the lists under n and n - 1; segments are taken from the
left before the edit and from the right after it, so no shifts are needed.
Pairs are verified by a banded bit-parallel automaton with 2 * THRESHOLD + 1
diagonals.

A bucket of more than HOT lines is not paired.  Its unmatched segment is cut
into WAYS windows and its lines are listed again under "everything but this
window", round after round, until the window is a single character, where all
lines of one length are linked to the first, and a longer line to the ones it
extends.  So the work stays in proportion to the lines, and no link is lost
between classes.

Lines of MIN_CHARS characters or more take part in the join.  With ``short``,
as the query and the pipeline have it, shorter lines that are not blank take
part too, by equality alone; without it they stay.  Of a class of linked lines
the occurrence with the least (doc_id, text, line number) stays and the later
ones are dropped.  A line is known by 128 bits of hashes and gets a number of
its own, by which it is linked.  Occurrences of a line meet its first one by a
join; lines that make up more than 1 / HEAVY_SHARE of all are met by a broadcast, as
there are fewer than HEAVY_SHARE of them.

Edge cases: null and empty texts have no lines to drop; rows with a null id
are left as they are; repeated rows of a document share its occurrences and
are treated alike; rows with one id and different texts are told apart by a hash
of the text, and are ordered by it; very long texts are split into their lines
like others, and put together again in one pass; an empty table gives no rows;
the operators read doc_id and text only, and ``without_dropped`` carries all
columns in a struct, so other columns may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm import shared

THRESHOLD = 1
MIN_CHARS = 20
HOT, WAYS = 64, 16
#: Lines with more occurrences than HEAVY and than one in HEAVY_SHARE of all are hot.
HEAVY, HEAVY_SHARE = 1000, 100_000


def _let(value: Column, body) -> Column:
    """Bind ``value`` to a lambda variable so that it is evaluated once a row."""
    return F.transform(F.array(value), body)[0]


def within(x: Column, y: Column, t: int = THRESHOLD) -> Column:
    """Whether the edit distance of two strings is at most ``t``.

    Bit d + t of row e says that the first i characters of y match the first
    i + d of x with at most e errors; a row has 2 * t + 1 bits and the rows are
    packed into one long.
    """
    width = 2 * t + 1
    full = (1 << width) - 1
    start = sum((((1 << (e + 1)) - 1) << t & full) << (e * width) for e in range(t + 1))

    def row(state: Column, e: int) -> Column:
        return F.shiftright(state, e * width).bitwiseAND(F.lit(full).cast("long"))

    def step(cx: Column, cy: Column):
        def run(state: Column, i: Column) -> Column:
            same = F.lit(0).cast("long")
            for d in range(width):
                equal = F.coalesce(F.get(cx, i + d - t) == F.get(cy, i), F.lit(False))
                same = same + F.when(equal, F.lit(1 << d).cast("long")).otherwise(F.lit(0).cast("long"))

            def rows(m: Column) -> Column:
                out, packed = None, None
                for e in range(t + 1):
                    new = row(state, e).bitwiseAND(m)
                    if e:
                        less = row(state, e - 1)
                        new = new.bitwiseOR(less).bitwiseOR(F.shiftright(less, 1))
                        new = new.bitwiseOR(F.shiftleft(out, 1)).bitwiseAND(F.lit(full).cast("long"))
                    out = new
                    part = F.shiftleft(new, e * width)
                    packed = part if packed is None else packed.bitwiseOR(part)
                return packed

            return _let(same, rows)

        return run

    def match(p: Column) -> Column:
        end = F.aggregate(
            F.when(F.size(p["y"]) > 0, F.sequence(F.lit(0), F.size(p["y"]) - 1)).otherwise(F.array().cast("array<int>")),
            F.lit(start).cast("long"),
            step(p["x"], p["y"]),
        )
        d = F.size(p["x"]) - F.size(p["y"]) + t
        last = _let(end, lambda s: F.call_function("shiftright", row(s, t), d))
        return last.bitwiseAND(F.lit(1).cast("long")) == 1

    chars = lambda s: F.when(F.length(s) > 0, F.split(s, "")).otherwise(F.array().cast("array<string>"))
    return (F.abs(F.length(x) - F.length(y)) <= t) & _let(F.struct(chars(x).alias("x"), chars(y).alias("y")), match)


def _text_hash() -> Column:
    return F.xxhash64(F.col("text").cast("string"))


def occurrences(docs: DataFrame, short: bool = False) -> DataFrame:
    """Every line that takes part: doc_id, t (hash of the text), line_no, 128 bits h and g of the line, its length n, and the line."""
    cut = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(
        F.col("doc_id").cast("long").alias("doc_id"), _text_hash().alias("t"),
        F.posexplode(F.split(F.col("text").cast("string"), "\n")).alias("line_no", "line"),
    )
    long = F.length("line") >= MIN_CHARS
    return cut.where(long | F.col("line").rlike(r"(?U)\S") if short else long).select(
        "doc_id", "t", "line_no", F.xxhash64("line").alias("h"), F.xxhash64(F.lit(1), "line").alias("g"), F.length("line").alias("n"), "line"
    )


def _key(n: Column, start: Column, end: Column, line: Column) -> Column:
    """What a line of about n characters has outside the window from start to end."""
    return F.xxhash64(n, start, end, F.left(line, start), F.right(line, n - end))


def distinct_lines(rows: DataFrame) -> DataFrame:
    """One row a line: number, hashes, first occurrence, number of occurrences, and its four keys (null for short lines).

    The numbers hold once this is written.
    """
    line, n = F.col("line"), F.col("n")
    keys = []
    for less in (0, 1):
        m = n - less
        half = F.floor(m / 2).cast("int")
        keys += [_key(m, half, m, line), _key(m, F.lit(0), half, line)]
    return (
        rows.select("h", "g", "n", "doc_id", "t", "line_no", *[F.when(n >= MIN_CHARS, k).alias(f"k{i}") for i, k in enumerate(keys)])
        .groupBy("h", "g")
        .agg(
            F.min("n").alias("n"),
            F.min(F.struct("doc_id", "t", "line_no")).alias("first"),
            F.count(F.lit(1)).alias("copies"),
            *[F.min(f"k{i}").alias(f"k{i}") for i in range(4)],
        )
        .withColumn("id", F.monotonically_increasing_id())
    )


def _shared_buckets(listed: DataFrame) -> DataFrame:
    """Rows whose key is shared with a line that it may link with, and the bucket's size."""
    size = (
        listed.groupBy("key")
        .agg(F.count(F.lit(1)).alias("members"), F.min("longer").alias("least"))
        .where("members > 1 AND least = 0")
        .select("key", "members")
    )
    return listed.join(size, "key")


def _pairs(members: DataFrame, texts: DataFrame) -> DataFrame:
    """Verified links of the small buckets: only what lies in the window is compared."""
    a = members.where("longer = 0").select("key", F.col("id").alias("a"), "n", "s", "e")
    b = members.select("key", F.col("id").alias("b"), "longer")
    pairs = a.join(b, "key").where("a <> b AND (longer = 1 OR a < b)")
    pairs = pairs.join(texts.select(F.col("id").alias("a"), F.col("line").alias("x")), "a").join(
        texts.select(F.col("id").alias("b"), F.col("line").alias("y")), "b"
    )
    window = lambda c, more: F.substring(F.col(c), F.col("s") + 1, F.col("e") - F.col("s") + more)
    return pairs.where(within(window("x", F.lit(0)), window("y", F.col("longer")))).select("a", "b")


def _single(members: DataFrame, texts: DataFrame) -> DataFrame:
    """Links of large buckets whose window is one character of the shorter lines."""
    rows = members.join(texts, "id").select("key", "id", "longer", F.substring("line", F.col("s") + 1, F.lit(2)).alias("c"))
    same = rows.where("longer = 0")
    least = same.groupBy("key").agg(F.min("id").alias("a"))
    stars = same.join(least, "key").where("a <> id").select("a", F.col("id").alias("b"))
    held = same.select("key", F.left("c", F.lit(1)).alias("one"), F.col("id").alias("a"))
    longer = rows.where("longer = 1").select(
        "key", F.explode(F.array_distinct(F.array(F.left("c", F.lit(1)), F.right("c", F.lit(1))))).alias("one"), F.col("id").alias("b")
    )
    return stars.unionByName(held.join(longer, ["key", "one"]).select("a", "b"))


def links(rows: DataFrame, lines: DataFrame) -> DataFrame:
    """Pairs (a, b) of numbers of lines within the threshold, enough to connect each class."""
    spark = rows.sparkSession
    rows, lines = rows.where(F.col("n") >= MIN_CHARS), lines.where(F.col("n") >= MIN_CHARS)
    n, zero = F.col("n"), F.lit(0)
    entries = []
    for less in (0, 1):
        m = n - less
        h = F.floor(m / 2).cast("int")
        for k, (s, e) in enumerate(((h, m), (zero, h))):
            entries.append(
                F.struct(
                    F.col(f"k{2 * less + k}").alias("key"), F.lit(less).alias("longer"),
                    m.cast("int").alias("n"), s.cast("int").alias("s"), e.cast("int").alias("e"),
                )
            )
    listed = lines.select("id", F.explode(F.array(*entries)).alias("x")).select("id", "x.*")
    members, at = shared.table(_shared_buckets(listed))
    paths = [at]
    wanted = lines.select("id", "h", "g").join(members.select("id").distinct(), "id", "left_semi")
    # copies of a line are reduced before the exchange; the join then meets lines by the same partitioning
    each = rows.groupBy("h", "g").agg(F.first("line").alias("line"))
    texts, at = shared.table(each.join(wanted.hint("merge"), ["h", "g"]).select("id", "line"))
    paths.append(at)
    found = []
    while True:
        out, _ = shared.table(_pairs(members.where(F.col("members") <= HOT), texts))
        found.append(out)
        hot = members.where(F.col("members") > HOT)
        if not hot.limit(1).count():
            break
        done, _ = shared.table(_single(hot.where("e - s <= 1"), texts))
        found.append(done)
        size = F.greatest(F.lit(1), F.ceil((F.col("e") - F.col("s")) / F.lit(WAYS))).cast("int")
        cut = hot.where("e - s > 1").join(texts, "id").withColumn("size", size)
        cut = cut.withColumn("from", F.explode(F.sequence(F.col("s"), F.col("e") - 1, F.col("size"))))
        cut = cut.withColumn("to", F.least("e", F.col("from") + F.col("size")))
        again = cut.select(
            "id", _key(F.col("n"), F.col("from"), F.col("to"), F.col("line")).alias("key"), "longer", "n",
            F.col("from").alias("s"), F.col("to").alias("e"),
        ).distinct()
        members, at = shared.table(_shared_buckets(again))
        paths.append(at)
    shared.drop(spark, *paths)
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def dropped_lines(docs: DataFrame, short: bool = False) -> DataFrame:
    """doc_id, t, dropped (line numbers, from 0) and kept_in (documents with the occurrences that stay)."""
    spark = docs.sparkSession
    place = shared.mark()
    rows = occurrences(docs, short)
    lines, _ = shared.table(distinct_lines(rows))
    labels = shared.components(links(rows, lines))
    # A line with one occurrence and no link keeps it; all others are looked up.
    several = lines.select("id", "h", "g", "first", "copies").join(labels.select(F.col("node").alias("id"), "label"), "id")
    heads = several.groupBy("label").agg(F.min("first").alias("head"))
    linked = several.join(heads, "label").select("h", "g", "head", "copies")
    alone = lines.where("copies > 1").join(labels.select(F.col("node").alias("id")), "id", "left_anti")
    alone = alone.select("h", "g", F.col("first").alias("head"), "copies")
    known, known_path = shared.table(linked.unionByName(alone))
    total = lines.agg(F.sum("copies")).first()[0] or 0
    shared.drop_since(spark, place, known_path)
    most = max(HEAVY, total // HEAVY_SHARE)
    places = rows.select("h", "g", "doc_id", "t", "line_no")
    heavy = F.broadcast(known.where(F.col("copies") > most).select("h", "g", "head"))  # fewer than HEAVY_SHARE rows
    few = known.where(F.col("copies") <= most).select("h", "g", "head")
    hit = places.join(heavy, ["h", "g"], "left_anti").join(few, ["h", "g"]).unionByName(places.join(heavy, ["h", "g"]))
    later = hit.where(F.struct("doc_id", "t", "line_no") != F.col("head"))
    return later.groupBy("doc_id", "t").agg(
        F.sort_array(F.collect_set("line_no")).alias("dropped"), F.sort_array(F.collect_set("head.doc_id")).alias("kept_in")
    )


def line_dedup(docs: DataFrame, short: bool = False) -> DataFrame:
    """doc_id, n_lines, n_dropped, dropped and kept_in of every document."""
    gone = dropped_lines(docs, short)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    mine = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), _text_hash().alias("t"),
        F.when(text == "", 0).otherwise(F.size(F.split(text, "\n"))).cast("long").alias("n_lines"),
    )
    return mine.join(gone, ["doc_id", "t"], "left").select(
        "doc_id", "n_lines", F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"),
        F.coalesce("dropped", F.array().cast("array<int>")).alias("dropped"),
        F.coalesce("kept_in", F.array().cast("array<bigint>")).alias("kept_in"),
    )


def without_dropped(docs: DataFrame, short: bool = False) -> DataFrame:
    """The documents with the lines left out that ``dropped_lines`` names; all columns stay."""
    gone = dropped_lines(docs, short).select("doc_id", "t", "dropped")
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), _text_hash().alias("t"))
    rows = rows.join(gone, ["doc_id", "t"], "left")
    lines = F.split(F.col("row").getField("text").cast("string"), "\n")
    places = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("dropped"))
    kept = F.array_join(F.transform(places, lambda i: F.get("lines", i)), "\n")
    rows = rows.withColumn("lines", F.when(F.col("dropped").isNotNull(), lines))
    text = F.when(F.col("dropped").isNull(), F.col("row").getField("text")).otherwise(kept)
    return rows.select(*[(text if c == "text" else F.col("row").getField(c)).alias(c) for c in docs.columns])
