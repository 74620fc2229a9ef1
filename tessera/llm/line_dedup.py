"""Substring deduplication by line hashing.

A line (what stands between line feeds) is normalised (A-Z lowered, white space left out of account) and
reduced to a 128-bit digest. Digests are grouped over the corpus; the occurrence that ranks earliest, by
document id and offset, stays, every other one of `unit_words` words or more is removed, and its span of
characters in the original text is reported.

Passages also begin and end within lines. So lines are cut into units, which are digested, grouped and
ranked like lines: a unit begins with its line, after a word that ends in `.`, `!`, `?` or their wide
forms, and at a capitalised word. A unit of more than `LONG_UNITS` times `unit_words` words is cut before
words that their hash chooses, so that a passage inside unbroken text meets the same cuts in every
document. Characters of scripts without white space are words that count half; longer unbroken strings
are cut by a hash of the bytes before. Short units repeat by chance, and so do runs of units of which
each repeats somewhere: what is digested is a stretch of units, the shortest of `unit_words` words or
more that ends with a unit, and the shortest that begins with it. A stretch is removed if it stood as a
whole before, so each word that goes is one of `unit_words` or more that stood side by side. At either
end of a passage that ends within lines, words up to its first and last cut stay. With `within=False`
whole lines alone are compared.

The corpus is cut twice, and neither texts nor spans travel with digests: the first pass finds the
digests that several documents hold (counted before they are shuffled), the second joins them to the
units' numbers, from which the units' places in the texts follow again. A stretch that its own document
repeats, apart from the first, needs no join. Digests in a share of all units are few, so they are broadcast and joined without
a shuffle.

Defined results: a null text stays null; a null id ranks last; rows equal in id and text are one
document and treated alike; rows that share an id only rank by a hash of the text; an empty table
gives an empty result; other columns are returned as they were (a column named like the operator's own
`removed` is replaced by it). Texts are taken whole. A line of fewer than `unit_words` words is removed
only as part of a stretch. A stretch that overlaps its first equal in the same text is no repeat of it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_bytes, byte_buffers, hashes_128, hot_keys, lower_ascii, mix64, segment_hashes, ship_code, words_of, written

Batches = Iterator[pa.RecordBatch]
UNIT_WORDS = 8
#: Units of more than so many times `unit_words` are cut further; bytes from which a word is.
LONG_UNITS = 6
UNBROKEN = 64
UNITS = "id long, t long, unit int, again boolean, h1 long, h2 long"
SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
SPANS_ARROW = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def pieces(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words without white space inside are cut further, and where those characters begin that are words of their own.

    Characters of scripts without spaces (Han, kana, Thai, Lao) are words; words of over `UNBROKEN` bytes
    are cut where a hash of the eight bytes before is one in sixteen.
    """
    one, two, three = low, np.append(low[1:], np.uint8(0)), np.append(low[2:], (np.uint8(0),) * 2)[: len(low)]
    wide = (one >= 0xE3) & (one <= 0xE9) & ~((one == 0xE3) & (two == 0x80) & (three < 0xA0)) | (one == 0xE0) & (two >= 0xB8) & (two <= 0xBB)
    wide = np.flatnonzero(wide)
    cuts = [wide, wide + 3]
    for i in np.flatnonzero(ends - starts > UNBROKEN).tolist():
        a, b = int(starts[i]), int(ends[i])
        eight = np.lib.stride_tricks.sliding_window_view(low[a:b], 8)
        at = a + 8 + np.flatnonzero(mix64(np.ascontiguousarray(eight).view(np.uint64).ravel()) % np.uint64(16) == 0)
        cuts.append(at[at < b])
    at = np.unique(np.concatenate(cuts))
    owner = np.searchsorted(starts, at, side="right") - 1
    inside = (owner >= 0) & (at > starts[owner]) & (at < ends[owner]) if len(starts) else at < 0
    at = at[inside]
    at = at[(low[at] & 0xC0) != 0x80]
    # full stops and the like stay with the character before
    at = at[~((low[at] == 0xE3) & (low[at + 1] == 0x80) | (low[at] == 0xEF) & (low[at + 1] == 0xBC) | (low[at] < 0x30))]
    return at, wide


class Units:
    """Lines and stretches of units of a slice of texts, as ranges of its words from `begin` to `stop`.

    number: twice the number in its text of the unit that a stretch ends with, or one more than twice that
    of the unit it begins with; lines are numbered -1, -2, ...
    """

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, unit_words: int, within: bool):
        self.raw, self.offsets, self.unit_words = raw, offsets, unit_words
        self.low = low = lower_ascii(raw)
        starts, ends, first = words_of(low, offsets)
        more, wide = pieces(low, starts, ends)
        if len(more):
            first = first + np.searchsorted(more, offsets)
            starts, ends = np.sort(np.append(starts, more)), np.sort(np.append(ends, more))
        self.starts, self.ends = starts, ends
        n = len(starts)
        rows = np.repeat(np.arange(len(first) - 1), np.diff(first))
        begins = np.zeros(n, bool)
        begins[first[:-1][np.diff(first) > 0]] = True
        feeds = np.append(0, np.cumsum(raw == 10))
        begins[1:] |= feeds[starts[1:]] > feeds[ends[:-1]]
        self.halves = np.append(0, np.cumsum(2 - np.isin(starts, wide))) if len(wide) else 2 * np.arange(n + 1)
        at = np.flatnonzero(begins)
        stop = np.append(at[1:], n) if len(at) else at
        number = -1 - (np.arange(len(at)) - np.searchsorted(rows[at], rows[at]))
        long = self.words(at, stop) >= unit_words
        self.lines = int(long.sum())
        lines = at[long], stop[long], rows[at][long], number[long]
        if within:
            begins |= self.sentences(begins, more, wide)
            at = np.flatnonzero(begins)
            stop = np.append(at[1:], n) if len(at) else at
            row = rows[at]
            begin, stop, row, number = self.stretches(at, stop, row)
        else:
            begin = stop = row = number = at[:0]
        self.begin, self.stop, self.row, self.number = (np.append(a, b) for a, b in zip(lines, (begin, stop, row, number)))

    def words(self, at: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return -(-(self.halves[stop] - self.halves[at]) // 2)

    def stretches(self, at: np.ndarray, stop: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, ...]:
        """begin, stop, row and number of the shortest stretches of `unit_words` words that end or begin with each unit."""
        number = np.arange(len(at)) - np.searchsorted(row, row)
        first = np.arange(len(at)) - number
        last = np.searchsorted(row, row, side="right") - 1
        least = 2 * self.unit_words - 1
        back = np.searchsorted(self.halves[at], self.halves[stop] - least, side="right") - 1
        ends = np.flatnonzero(back >= first)
        on = np.searchsorted(self.halves[stop], self.halves[at] + least)
        begins = np.flatnonzero(on <= last)
        begins = begins[back[on[begins]] != begins]  # the others are the same stretch
        return (
            np.append(at[back[ends]], at[begins]),
            np.append(stop[ends], stop[on[begins]]),
            np.append(row[ends], row[begins]),
            np.append(2 * number[ends], 2 * number[begins] + 1),
        )

    def sentences(self, lines: np.ndarray, more: np.ndarray, wide: np.ndarray) -> np.ndarray:
        """Where units begin within lines."""
        raw, starts, ends = self.raw, self.starts, self.ends
        n = len(starts)
        begins = lines.copy()
        final = raw[ends - 1] if n else raw[:0]
        begins[1:] |= np.isin(final[:-1], (33, 46, 63))
        if len(wide):
            stops = (raw[ends - 3] == 0xE3) & (raw[ends - 2] == 0x80) & (final == 0x82) | (raw[ends - 3] == 0xEF) & (raw[ends - 2] == 0xBC) & ((final == 0x81) | (final == 0x9F))
            begins[1:] |= (stops & (ends - starts >= 3))[:-1]
        padded = np.append(raw, (0, 0))
        a, b = padded[starts], padded[starts + 1]
        capital = (a >= 65) & (a <= 90) & ~((b >= 65) & (b <= 90)) | (a == 0xC3) & (b >= 0x80) & (b <= 0x9E)
        if len(more):
            capital &= ~np.isin(starts, more)
        begins |= capital
        # units without an end are cut before words that their hash chooses
        at = np.flatnonzero(begins)
        size = np.diff(np.append(at, n))
        long = np.flatnonzero(np.repeat(size > LONG_UNITS * self.unit_words, size))
        words = segment_hashes(self.low, starts[long], ends[long])
        chosen = words % np.uint64(self.unit_words) == 0
        chosen[1:] &= (words[1:] != words[:-1]) | (long[1:] != long[:-1] + 1)
        begins[long[chosen]] = True
        return begins

    def digests(self) -> tuple[np.ndarray, np.ndarray]:
        """128 bits of the words of each line and stretch; those of lines are of another kind."""
        n = len(self.starts)
        size = self.ends - self.starts
        places = np.append(0, np.cumsum(size + 1))
        between = np.zeros(places[-1], bool)
        between[places[1:] - 1] = True
        text = np.full(places[-1], 32, np.uint8)
        edge = np.zeros(len(self.low) + 1, np.int8)
        edge[self.starts] = 1
        edge[self.ends] -= 1
        text[~between] = self.low[np.cumsum(edge[:-1], dtype=np.int8).view(bool)] if n else text[:0]
        data, a, b = text.tobytes(), places[self.begin], places[self.stop]
        k = self.lines
        found = hashes_128(data, a[:k], b[:k], 1), hashes_128(data, a[k:], b[k:])
        return tuple(np.append(x, y) for x, y in zip(*found))

    def spans(self, chosen: np.ndarray) -> np.ndarray:
        """(row, start, end) in characters of the original, in order, of what the chosen lines and stretches remove."""
        begin, stop, row = self.begin[chosen], self.stop[chosen], self.row[chosen]
        if not len(begin):
            return np.zeros((0, 3), np.int64)
        order = np.argsort(begin, kind="stable")
        begin, row, reach = begin[order], row[order], np.maximum.accumulate(stop[order])
        lead = np.append(True, (begin[1:] > reach[:-1]) | (row[1:] != row[:-1]))  # what overlaps or touches is one span
        last = np.append(lead[1:], True)
        characters = np.append(0, np.cumsum((self.raw & 0xC0) != 0x80))
        base = characters[self.offsets[row[lead]]]
        return np.stack([row[lead], characters[self.starts[begin[lead]]] - base, characters[self.ends[reach[last] - 1]] - base], axis=1)


def cut(batches: Batches, unit_words: int, within: bool) -> Batches:
    """The digest of each line and stretch; `again` where the text holds it before, apart from it."""
    for part in by_bytes(batches, "text", 2 << 20):
        units = Units(*byte_buffers(part.column("text")), unit_words, within)
        if not len(units.row):
            continue
        h1, h2 = units.digests()
        order = np.lexsort((units.begin, h2, h1, units.row))
        row, a, b = units.row[order], h1[order], h2[order]
        lead = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
        first = np.repeat(order[lead], np.diff(np.append(lead, len(order))))
        again = np.zeros(len(order), bool)
        again[order] = units.begin[order] >= units.stop[first]
        yield pa.RecordBatch.from_arrays(
            [
                part.column("id").take(pa.array(units.row)),
                part.column("t").take(pa.array(units.row)),
                pa.array(units.number.astype(np.int32)),
                pa.array(again),
                pa.array(h1.view(np.int64)),
                pa.array(h2.view(np.int64)),
            ],
            ["id", "t", "unit", "again", "h1", "h2"],
        )


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the spans and the white space after each."""
    kept, at = [], 0
    for a, b in spans:
        kept.append(text[at:a])
        while b < len(text) and text[b] in " \t\n\v\f\r":
            b += 1
        at = b
    return "".join(kept) + text[at:]


def remove(batches: Batches, unit_words: int, within: bool) -> Batches:
    """Takes out of each text what its repeated lines and stretches (repeats_) cover."""
    for part in by_bytes(batches, "text_", 2 << 20):
        texts, lists = part.column("text_").to_pylist(), part.column("repeats_")
        found = [[] for _ in texts]
        hit = np.flatnonzero(np.asarray(pc.is_valid(lists)))
        if len(hit):
            units = Units(*byte_buffers(part.column("text_").take(pa.array(hit))), unit_words, within)
            own = lists.take(pa.array(hit))
            place = np.repeat(np.arange(len(hit)), np.asarray(pc.list_value_length(own)))
            wanted = (place << 32) + own.flatten().to_numpy(zero_copy_only=False)
            chosen = np.flatnonzero(np.isin((units.row << 32) + units.number, wanted))
            for row, a, b in units.spans(chosen).tolist():
                found[hit[row]].append((a, b))
        texts = [without(t, f) if f else t for t, f in zip(texts, found)]
        spans = pa.array([[{"start": a, "end": b} for a, b in f] for f in found], SPANS_ARROW)
        rest = [c for c in part.schema.names if c not in ("text_", "repeats_")]
        yield pa.RecordBatch.from_arrays([*(part.column(c) for c in rest), pa.array(texts, pa.string()), spans], [*rest, "text_", "removed_"])


def repeated(units: DataFrame) -> DataFrame:
    """id, t, unit of every line and stretch that an earlier one equals."""
    place = F.struct(F.col("id").isNull().alias("x"), F.col("id"), F.col("t"))
    firsts = units.where("not again").groupBy("h1", "h2").agg(F.min(place).alias("earliest"), F.count("*").alias("n"))
    dups = written(firsts.where("n > 1"), "repeated-digests")
    hot = hot_keys(dups).select(F.col("h1").alias("a1"), F.col("h2").alias("a2"), F.col("earliest").alias("e"))
    rows = units.join(F.broadcast(hot), (F.col("h1") == F.col("a1")) & (F.col("h2") == F.col("a2")), "left")
    known = F.col("again") | F.col("e").isNotNull()
    rows = rows.select(
        "id", "t", "unit", (F.col("again") | ~F.coalesce(F.col("e") == place, F.lit(True))).alias("repeat"), known.alias("known"),
        # what is known already meets nothing, and is dealt evenly
        F.when(known, F.xxhash64("id", "t", "unit")).otherwise(F.col("h1")).alias("h1"), F.when(known, F.lit(0)).otherwise(F.col("h2")).alias("h2"),
    ).where("repeat or not known")
    rows = rows.drop("known").join(dups.select("h1", "h2", "earliest"), ["h1", "h2"], "left")
    return rows.where(F.col("repeat") | (F.col("earliest") != place)).select("id", "t", "unit")


def dedup_lines(docs: DataFrame, unit_words: int = UNIT_WORDS, id_col: str = "doc_id", text_col: str = "text", within: bool = True) -> DataFrame:
    """`docs` with repeated lines and passages taken out of the text, and `removed`: their spans in the original."""
    ship_code(docs.sparkSession)
    own = [c for c in docs.columns if c not in ("removed", text_col)]
    keyed = docs.select(
        F.struct(F.lit(0).alias("x"), *(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(own))).alias("rest_"),
        F.col(text_col).cast("string").alias("text_"),
        F.col(id_col).cast("long").alias("id_"),
        F.xxhash64(F.col(text_col).cast("string")).alias("t_"),
    )
    texts = keyed.where("text_ is not null").select(F.col("id_").alias("id"), F.col("t_").alias("t"), F.col("text_").alias("text"))
    units = texts.mapInArrow(lambda b: cut(b, unit_words, within), UNITS)
    lists = repeated(units).groupBy("id", "t").agg(F.collect_set("unit").alias("repeats_")).select(F.col("id").alias("i"), F.col("t").alias("h"), "repeats_")
    joined = keyed.join(lists, F.col("id_").eqNullSafe(F.col("i")) & (F.col("t_") == F.col("h")), "left").select("rest_", "text_", "repeats_")
    schema = T.StructType([joined.schema["rest_"], joined.schema["text_"], T.StructField("removed_", SPANS)])
    out = joined.mapInArrow(lambda b: remove(b, unit_words, within), schema)
    columns = {c: F.col(f"rest_.c{i}") for i, c in enumerate(own)} | {text_col: F.col("text_")}
    return out.select(*(columns[c].alias(c) for c in docs.columns if c in columns), F.col("removed_").alias("removed"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(
        "doc_id",
        F.col("removed.start").alias("removed_starts"),
        F.col("removed.end").alias("removed_ends"),
        F.length("text").cast("long").alias("kept_chars"),
        "text",
    )


def dedup_whole_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each document, without white space, if whole lines alone are compared."""
    out = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"), within=False)
    left = F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", "")
    return out.select("doc_id", F.length(left).cast("long").alias("kept_chars"), F.md5(left.cast("binary")).alias("kept_md5"))


#: For tables without scripts that have no white space, and without words of over 64 bytes.
WHOLE_LINES_SQL = f"""
WITH l AS (
  SELECT doc_id, i, regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g') AS plain,
         trim(regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g')) AS words
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)
), r AS (SELECT *, len(string_split(words, ' ')) >= {UNIT_WORDS} AND row_number() OVER (PARTITION BY words ORDER BY doc_id, i) > 1 AS gone FROM l),
t AS (SELECT doc_id, string_agg(CASE WHEN gone THEN '' ELSE plain END, '' ORDER BY i) AS kept FROM r GROUP BY doc_id)
SELECT doc_id, CAST(length(kept) AS BIGINT) AS kept_chars, md5(kept) AS kept_md5 FROM t
"""
