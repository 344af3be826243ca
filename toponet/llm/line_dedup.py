"""Line dedup over content-defined runs of lines, in DataFrame functions only.

A text is split at line feeds. From every line that isn't blank a run goes on, and back,
until it has ``LONG_WORDS`` words or ``LONG_BYTES`` bytes; content alone decides where a
run ends, so runs move with it when lines are put in before. A shared passage of whole
lines of at least that size is exactly covered by the runs inside it, whatever its
lines and its neighbours are; a smaller one (headings, stock lines) is never touched.
Of each distinct run the first occurrence (smallest doc_id, then place) stays; the lines
of later ones are removed. A later run of the same document counts from the end of the
first one on, so an equal, earlier line of every removed one is kept.

Repeated runs are found by two 64-bit hashes with different seeds over the hashes of their
lines. Before a line goes its bytes are compared with those of its line in the first
occurrence: all lines held against one first line are reduced to the different ones, per
task and then together, and where any but its own is left the lines that differ stay.
Counting has partial sums, so a passage that a third of all documents hold is a few rows
before the shuffle; the later occurrences meet the one first row of their hash in a join
that splits large keys. Null text stays null and has no lines. Rows that share a doc_id
are told apart by their text; repeated equal rows are one document. Blank lines have no
size and are passed over; those inside a removed run go with it. An empty table gives an
empty result; other columns pass through ``remove_repeats``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .tables import forget, written

c = F.col

#: Least size of a repeated run: so many words, or so many bytes.
LONG_WORDS, LONG_BYTES = 40, 320
#: Lines looked at first for the end of a run; LONG_WORDS lines with a word each always are one.
FEW = 6
#: More than the lines of any run.
WIDE = 64


def split_chunks(text: Column) -> Column:
    """Lines of a text; joined by line feeds they are the text again."""
    return F.split(text, "\n", -1)


def _words(line: Column) -> Column:
    """Number of words between spaces, tabs and the like."""
    return F.regexp_count(line, F.lit(r"[^ \t\r\f\x0B]++"))


def _hashes(line: Column) -> tuple[Column, Column]:
    return F.xxhash64(line), F.xxhash64(F.lit(1), line)


def _said(text: Column) -> Column:
    """(place, h, g, words, bytes) of the lines with a word."""
    marked = F.transform(
        split_chunks(text),
        lambda x, i: F.struct(
            i.alias("place"), _hashes(x)[0].alias("h"), _hashes(x)[1].alias("g"),
            _words(x).alias("words"), F.octet_length(x).alias("bytes"),
        ),
    )
    return F.filter(marked, lambda x: x["words"] > 0)


def _enough(run: Column) -> Column:
    return (run["words"] >= LONG_WORDS) | (run["bytes"] >= LONG_BYTES)


def _reach(lines: Column) -> Column:
    """(words, bytes, n) of the shortest long run at the start of ``lines``, or of all of them."""
    return F.aggregate(
        lines, F.struct(F.lit(0).alias("words"), F.lit(0).alias("bytes"), F.lit(0).alias("n")),
        lambda run, x: F.when(_enough(run), run).otherwise(F.struct(
            (run["words"] + x["words"]).alias("words"), (run["bytes"] + x["bytes"]).alias("bytes"),
            (run["n"] + 1).alias("n"),
        )),
    )


def _spans(lines: Column) -> Column:
    """``at * WIDE + n`` of the shortest long runs from every line on and up to every line.

    ``at`` counts from 1. Numbers, since only of those Spark finds the different ones by hash.
    """

    def ahead(at: Column, n: int) -> Column:
        return F.slice(lines, at, F.lit(n))

    def behind(at: Column, n: int) -> Column:
        return F.reverse(F.slice(lines, F.greatest(at - n + 1, F.lit(1)), F.least(at, F.lit(n))))

    def lengths(side) -> Column:
        def length(at: Column) -> Column:
            few = _reach(side(at, FEW))
            all_of_it = _reach(side(at, LONG_WORDS))
            return F.when(_enough(few), few["n"]).when(_enough(all_of_it), all_of_it["n"])

        return F.transform(lines, lambda _, i: length(i + 1))

    on = F.transform(lengths(ahead), lambda n, i: (i + 1).cast("long") * WIDE + n)
    back = F.transform(lengths(behind), lambda n, i: (i + 2 - n).cast("long") * WIDE + n)
    return F.array_distinct(F.array_compact(F.concat(on, back)))


def runs(docs: DataFrame) -> DataFrame:
    """(h, g, doc_id, key, place, end, line, n) of every long run.

    ``place`` and ``end`` are the places of its first and last line; it has ``n`` lines
    with a word, the first of which is the ``line``-th such line of its text.
    """
    keyed = docs.select(
        c("doc_id").cast("long").alias("doc_id"), c("text").cast("string").alias("text")
    ).filter(c("text").isNotNull())
    lines = keyed.select("doc_id", F.xxhash64("doc_id", "text").alias("key"), _said(c("text")).alias("lines"))

    def described(span: Column) -> Column:
        at, n = (span / WIDE).cast("int"), (span % WIDE).cast("int")
        run = F.slice("lines", at, n)
        return F.struct(
            F.xxhash64(F.transform(run, lambda x: x["h"])).alias("h"),
            F.xxhash64(F.lit(1), F.transform(run, lambda x: x["g"])).alias("g"),
            F.get("lines", at - 1)["place"].alias("place"), F.get("lines", at + n - 2)["place"].alias("end"),
            at.alias("line"), n.alias("n"),
        )

    # Described inside their text, so that no run carries all lines of it.
    spans = lines.withColumn("spans", _spans(c("lines")))
    return spans.select("doc_id", "key", F.explode(F.transform("spans", described)).alias("x")).select(
        "x.h", "x.g", "doc_id", "key", "x.place", "x.end", "x.line", "x.n"
    )


def _flags(places: Column) -> Column:
    """A byte per place up to the last of ``places`` (sorted, from 0): 1 there, 0 elsewhere."""
    return F.array_join(
        F.zip_with(
            F.concat(F.array(F.lit(-1)), places), places,
            lambda before, at: F.concat(F.repeat(F.lit("0"), at - before - 1), F.lit("1")),
        ),
        "",
    ).cast("binary")


def _flagged(flags: Column, place: Column) -> Column:
    return F.substring(flags, place + 1, F.lit(1)) == F.lit(b"1")


def repeats(docs: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """A row per document with later runs or with lines that others are compared with (``key``).

    ``gone``: flags of the places to remove, ``n_gone`` of them, both null for none.
    ``held``: (line, own, first_key, first_line) by line, ``own`` where another line is
    compared with this one, ``first_key`` and ``first_line`` where this one is compared;
    ``looked``: flags of these lines among the lines with a word. Beside it, the written
    tables that it reads.
    """
    marks = cut_lineage(runs(docs))
    at = F.struct("doc_id", "key", "place", "end", "line")
    again = (
        marks.groupBy("h", "g").agg(F.min(at).alias("at"), F.max(at).alias("last")).filter(c("at") != c("last"))
        .select(
            "h", "g", c("at.key").alias("first_key"), c("at.end").alias("first_end"),
            c("at.line").alias("first_line"),
        )
    )
    later = written(
        marks.join(again, ["h", "g"]).filter((c("key") != c("first_key")) | (c("place") > c("first_end")))
        .select("key", "place", "end", "line", "n", "first_key", "first_line"),
        "later-runs",
    )
    # A line stands in many runs; it is compared with the line of one of them.
    places = later.select("key", "place", "end").distinct().select(
        "key", F.explode(F.sequence("place", "end")).alias("place")
    )
    gone = places.groupBy("key").agg(F.sort_array(F.collect_set("place")).alias("gone")).select(
        "key", _flags(c("gone")).alias("gone"), F.size("gone").alias("n_gone")
    )
    # Written, as both sides of every comparison must come from one choice.
    compared = written(later.select(
        "key", "line", "first_key", "first_line", F.explode(F.sequence(F.lit(0), c("n") - 1)).alias("i")
    ).select(
        "key", (c("line") + c("i")).alias("line"), "first_key", (c("first_line") + c("i")).alias("first_line"),
        F.lit(False).alias("own"),
    ).dropDuplicates(["key", "line"]), "compared-lines")
    own = compared.select(
        c("first_key").alias("key"), c("first_line").alias("line"), F.lit(None).cast("long").alias("first_key"),
        F.lit(None).cast("int").alias("first_line"), F.lit(True).alias("own"),
    ).distinct()
    held = (
        compared.unionByName(own).groupBy("key", "line")
        .agg(F.max("own").alias("own"), F.max("first_key").alias("first_key"), F.max("first_line").alias("first_line"))
        .groupBy("key")
        .agg(F.sort_array(F.collect_list(F.struct("line", "own", "first_key", "first_line"))).alias("held"))
        .select("key", "held", _flags(F.transform("held", lambda x: x["line"] - 1)).alias("looked"))
    )
    return held.join(gone, "key", "left"), [later, compared]


def _compared_lines(rows: DataFrame) -> DataFrame:
    """(key, place, line, own, first_key, first_line, said) of the lines in ``held``."""
    marked = F.transform(split_chunks(c("text")), lambda x, i: F.struct(x.alias("said"), i.alias("place")))
    spoken = F.filter(marked, lambda x: _words(x["said"]) > 0)
    lines = F.filter(spoken, lambda _, i: _flagged(c("looked"), i))
    pairs = F.arrays_zip(lines.alias("x"), c("held").alias("y"))
    return rows.filter(c("held").isNotNull()).select("key", F.explode(pairs).alias("p")).select(
        "key", c("p.x.place").alias("place"), c("p.y.line").alias("line"), c("p.y.own").alias("own"),
        c("p.y.first_key").alias("first_key"), c("p.y.first_line").alias("first_line"), c("p.x.said").alias("said"),
    )


def _unequal(lines: DataFrame) -> DataFrame:
    """(first_key, first_line, said): what is held against a first line and isn't its text."""
    sides = F.array_compact(F.array(
        F.when(c("own"), F.struct(c("key").alias("k"), c("line").alias("n"), F.lit(True).alias("same"))),
        F.when(
            c("first_key").isNotNull(),
            F.struct(c("first_key").alias("k"), c("first_line").alias("n"), F.lit(False).alias("same")),
        ),
    ))
    return (
        lines.select(F.explode(sides).alias("s"), "said")
        .select(c("s.k").alias("first_key"), c("s.n").alias("first_line"), "said", c("s.same").alias("same"))
        .groupBy("first_key", "first_line", "said").agg(F.max("same").alias("same"))
        .filter(~c("same")).drop("same")
    )


def with_gone(docs: DataFrame) -> DataFrame:
    """(row, text, gone, n_gone, stay, n_stay) of every document; null where nothing goes or stays.

    ``stay`` flags places in ``gone`` whose bytes are not those of the first occurrence.
    """
    found, spent = repeats(docs)
    rows = docs.select(
        F.struct(*[c(x) for x in docs.columns if x != "text"], F.lit(0).alias("_")).alias("row"),
        c("text").cast("string").alias("text"),
        F.xxhash64(c("doc_id").cast("long"), c("text").cast("string")).alias("key"),
    )
    rows = written(rows.join(found, "key", "left"), "lines-found")
    forget(*spent)
    lines = _compared_lines(rows)
    unequal = _unequal(lines)
    if unequal.isEmpty():
        rows = rows.withColumn("stay", F.lit(None).cast("binary")).withColumn("n_stay", F.lit(0))
    else:
        stay = (
            lines.join(unequal, ["first_key", "first_line", "said"])
            .groupBy("key").agg(F.sort_array(F.collect_set("place")).alias("stay"))
            .select("key", _flags(c("stay")).alias("stay"), F.size("stay").alias("n_stay"))
        )
        rows = rows.join(stay, "key", "left")
    return rows.select("row", "text", "gone", "n_gone", "stay", "n_stay")


def _kept_text() -> Column:
    """The text without the lines at the places ``gone``, but for those in ``stay``."""
    left = F.filter(
        split_chunks(c("text")),
        lambda _, i: ~_flagged(c("gone"), i) | F.coalesce(_flagged(c("stay"), i), F.lit(False)),
    )
    return F.when(c("gone").isNull(), c("text")).otherwise(F.array_join(left, "\n"))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """The documents without repeated runs of lines; all other columns stay."""
    made = with_gone(docs).withColumn("text", _kept_text())
    return made.select(*[c("text") if x == "text" else c("row").getField(x).alias(x) for x in docs.columns])


def report(docs: DataFrame) -> DataFrame:
    """Cleaned text and number of removed lines of every document."""
    return with_gone(docs).select(
        c("row.doc_id").cast("long").alias("doc_id"),
        (F.coalesce("n_gone", F.lit(0)) - F.coalesce("n_stay", F.lit(0))).cast("long").alias("n_removed"),
        _kept_text().alias("text"),
    )
