"""Titles and quotes found in texts through shared runs of words.

A text's runs are hashed in its scan task and only those leave it that some title or
quote begins with, so what is shuffled grows with the finds and not with the texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import phrases
from ..session import computed

c = F.col

# Run lengths in words used as join keys.
RUN_WORDS = [1, 2, 3, 4, 6, 8, 12]
CLAIM_WINDOW = 60
SHORT_RUN = 10
#: Bits of the membership filter: eight for each run, and at most so many (16 MB).
#: A full filter lets more runs pass to the join and loses none.
MOST_BITS = 1 << 27
#: Bytes of text hashed at once; a longer text is a block of its own.
BLOCK = 1 << 20

_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)


def _hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans: equal spans have equal hashes wherever they stand."""
    power = np.cumprod(np.full(len(data), _BASE, np.uint64))
    back = np.cumprod(np.full(len(data) + 1, _BACK, np.uint64))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power, out=sums[1:])
    h = (sums[ends] - sums[starts]) * back[starts]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def _blocks(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of consecutive whole texts; null counts as empty."""
    texts = pa.concat_arrays([texts.cast(pa.large_string()).fill_null("")])
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + BLOCK, "right")) - 1)
        yield lo, data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


def _runs(data: np.ndarray, at: np.ndarray, lengths: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text) of all runs of every length in words, or of ten characters for length 0."""
    parts = []
    space = data == 0x20
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    inside = ~space
    starts = np.flatnonzero(inside & (np.concatenate([[True], space])[: len(data)] | edge[: len(data)]))
    ends = np.flatnonzero(inside & (np.concatenate([space, [True]])[1:] | edge[1:])) + 1
    for n in lengths:
        if n:
            a, b = starts[: max(len(starts) - n + 1, 0)], ends[n - 1 :]
        else:
            chars = np.flatnonzero((data & 0xC0) != 0x80)
            stops = np.append(chars, len(data))
            a, b = chars[: max(len(chars) - SHORT_RUN + 1, 0)], stops[SHORT_RUN:]
        owner = np.searchsorted(at, a, "right") - 1
        whole = b <= at[owner + 1]
        parts.append((a[whole], b[whole], owner[whole]))
    a, b, owner = (np.concatenate(x) for x in zip(*parts))
    return a, b, owner


def _hashed(leads: DataFrame, run: str) -> DataFrame:
    """``leads`` with ``_run``, the hash of the string column ``run``."""
    place = leads.columns.index(run)

    def hash_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, data, at in _blocks(batch.column(place)):
                rows = batch.slice(lo, len(at) - 1)
                h = _hash_spans(data, at[:-1], at[1:]).view(np.int64)
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(h)], [*rows.schema.names, "_run"])

    return leads.mapInArrow(hash_rows, T.StructType([*leads.schema.fields, T.StructField("_run", T.LongType())]))


def _filter_bits(runs: DataFrame) -> np.ndarray:
    """Bit per ``_run``, summed up in Spark; the driver gets words of 64 bits, ``MOST_BITS`` at most."""
    bits = min(MOST_BITS, max(1 << 16, 1 << (8 * runs.count()).bit_length()))
    place = F.pmod("_run", F.lit(bits))
    words = runs.groupBy(F.floor(place / 64).cast("int").alias("at")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(_run, {bits}L) % 64 as int))")).alias("bits")
    )
    out = np.zeros(bits // 64, "<i8")
    for batch in words.toArrow().to_batches():
        out[batch.column(0).to_numpy()] = batch.column(1).to_numpy()
    return out.view(np.uint8)


def found_runs(texts: DataFrame, key: str, text: str, leads: DataFrame) -> DataFrame:
    """(key, _run) of the runs in texts that may be runs of ``leads`` (_run, _words), each once a block of texts."""
    lengths = sorted(r[0] for r in leads.select("_words").distinct().collect())
    shared = texts.sparkSession.sparkContext.broadcast(_filter_bits(leads.select("_run").distinct()))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            for lo, data, at in _blocks(batch.column(1)):
                a, b, owner = _runs(data, at, lengths)
                h = _hash_spans(data, a, b)
                place = (h % np.uint64(8 * len(bits))).astype(np.int64)
                use = (bits[place >> 3] >> (place & 7) & 1).astype(bool)
                pairs = np.unique(np.stack([owner[use].astype(np.uint64), h[use]], 1), axis=0)
                rows = batch.column(0).take(pa.array(pairs[:, 0].astype(np.int64) + lo))
                yield pa.RecordBatch.from_arrays(
                    [rows, pa.array(np.ascontiguousarray(pairs[:, 1]).view(np.int64))], [key, "_run"]
                )

    rows = texts.select(key, text)
    if not lengths:
        return rows.select(key, F.lit(0).cast("long").alias("_run")).limit(0)
    schema = T.StructType([rows.schema[key], T.StructField("_run", T.LongType())])
    return rows.mapInArrow(search, schema)


def lead_run(words: Column) -> Column:
    """(_words, _text): the first words, as many as the largest run length that fits; NULL without words."""
    key = F.lit(None).cast("struct<_words:int,_text:string>")
    for n in RUN_WORDS:
        run = F.struct(F.lit(n).alias("_words"), F.array_join(F.slice(words, 1, n), " ").alias("_text"))
        key = F.when(F.size(words) >= n, run).otherwise(key)
    return key


def ascii_words(text: Column) -> Column:
    """Runs of ASCII letters and digits with one space between, the units a title border respects."""
    return F.trim(F.regexp_replace(text, "[^A-Za-z0-9]+", " "))


def matchable_title(title: Column) -> Column:
    """At least two words and eight characters."""
    text = F.trim(title)
    return (phrases.word_count(text) >= 2) & (F.char_length(text) >= 8)


def title_claims(texts: DataFrame, works: DataFrame, key: str) -> DataFrame:
    """Work whose title a text states near a word that ties it to such a work.

    A title in a text shares its words with it, so both sides meet on the title's
    leading run of words (as long as possible). Only those pairs are tested for the
    exact title with word borders and the claim word within 60 characters. The
    first work (smallest id) per text wins; the pairs carry ids and the text is
    joined back for the test, so long texts are not copied per run.
    """
    # What a text says near a title is the same for all works of that title and kind.
    titles = works.filter(matchable_title(c("title"))).groupBy("title", "kind").agg(F.min("work_id").alias("work_id"))
    words = F.filter(F.split(ascii_words(c("title")), " "), lambda w: w != "")
    leads = _hashed(
        titles.withColumn("_lead", lead_run(words)).filter(c("_lead").isNotNull())
        .select("work_id", "title", "kind", "_lead._words", "_lead._text"), "_text",
    )
    plain = texts.select(key, ascii_words(c("text")).alias("_plain")).filter(c("_plain") != "")
    pairs = found_runs(plain, key, "_plain", leads).join(leads, "_run").select(
        key, "work_id", "title", "kind"
    )
    rows = pairs.join(texts.select(key, "text"), key)
    quoted = F.concat(F.lit("\\Q"), F.replace("title", F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    border = F.concat(F.lit("(?<![A-Za-z0-9])"), quoted, F.lit("(?![A-Za-z0-9])"))
    start = F.greatest(c("at") - CLAIM_WINDOW, F.lit(1))
    context = F.substring(
        c("text"), start, c("at") + F.char_length("title") + CLAIM_WINDOW - start
    )
    # Only a text that holds the title as it is written is worth the pattern, which runs once a pair.
    at = F.when(c("text").contains(c("title")), F.regexp_instr(c("text"), border))
    hits = computed(rows, at=at).filter(c("at") > 0)
    hits = computed(hits, context=context).drop("text").filter(phrases.has_claim_word(c("context"), c("kind")))
    return hits.groupBy(key).agg(F.min(F.struct("work_id", "at", "context")).alias("_b")).select(
        key,
        c("_b.work_id").alias("work_id"),
        (c("_b.at") - 1).alias("at"),
        c("_b.context").alias("context"),
    )


def quotes_in_texts(quotes: DataFrame, texts: DataFrame, quote_key: str, text_key: str) -> DataFrame:
    """Pairs of a quote and a text that contains it, both in comparison form.

    A quote may start and end inside a word, but its inner words are whole in the
    text; the pairs meet on the quote's inner run of words. Quotes of one or two
    words have none: they meet on their first ten characters, and only where there
    are such quotes are texts cut into runs of characters.
    """
    asked = quotes.select(quote_key, phrases.quote_form(c("text")).alias("quote")).filter(
        F.char_length("quote") >= SHORT_RUN
    )
    held = texts.select(text_key, phrases.quote_form(c("text")).alias("prose"))
    words = F.split("quote", " ")
    inner = F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0)))
    opening = F.struct(F.lit(0).alias("_words"), F.left("quote", F.lit(SHORT_RUN)).alias("_text"))
    lead = F.when(F.size(words) >= 3, lead_run(inner)).otherwise(opening)
    leads = _hashed(
        asked.withColumn("_lead", lead).select(quote_key, "quote", "_lead._words", "_lead._text"), "_text"
    )
    found = found_runs(held.filter(F.char_length("prose") >= SHORT_RUN), text_key, "prose", leads)
    # Hashes may meet by chance or on several lengths: a pair is tested and returned once.
    pairs = found.join(leads, "_run").select(quote_key, "quote", text_key)
    return pairs.join(held, text_key).filter(c("prose").contains(c("quote"))).select(
        quote_key, text_key, (F.instr("prose", c("quote")) - 1).alias("at")
    )
