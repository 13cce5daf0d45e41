"""Substring dedup: word windows that occur again are removed at every place but the first.

Anchors. Each window of `width` words has an anchor: the least hash among its five-word phrases,
the leftmost on ties. Equal windows have equal anchors, so a window can only recur where its
anchor's phrase does. Anchors are counted over the whole corpus; only the windows of recurring
ones go on, as passages: the words of all windows that share one anchor occurrence.

Automata. Passages are dealt to shards by their anchor. A shard confirms which windows recur in
its portion by counting their hashes, compiles the confirmed ones, a character for each word, into
an Aho-Corasick automaton, and streams every passage of every document through it; what the
automaton finds are the occurrences, and each but the first is removed. The passages of a very
common anchor are dealt over many portions; the first place of each window in its portion is then
compared over all portions by one minimum for each window, so no task ever gathers one anchor's
passages. The 4096 most frequent anchors, among them each that holds more than 1/4096 of all
occurrences, are known to every task, so that no common key meets in one. The texts are shuffled once: both joins on doc_id read the
same exchange.

Words are runs outside white space, unchanged. Null and short texts have no window and lose
nothing. Order is (doc_id, start): rows that repeat a doc_id are judged as one document would
be at equal starts, and repeated rows get equal results. Rows without doc_id have no place in
the order: they keep all words and remove none elsewhere. An empty table gives an empty result;
extra columns are ignored. Words are compared by 64-bit hashes.
"""

from __future__ import annotations

import hashlib

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .jaccard_join import by_group
from .shared import arrow_map, read_table, text_buffer
from .words import Words, combined, factors, find_words, mix, window_starts

PHRASE = 5
#: Passages of one anchor above this number are dealt over several portions.
PORTION = 4096
#: Passages that one automaton takes, besides those of one more anchor's portion.
COMPILED = 2048
#: Anchors that every task knows, if their passages are dealt over several portions.
HOT = 4096


def anchor_runs(w: Words, hashes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hash, first window and number of windows of each anchor occurrence (indices of words)."""
    span = width - PHRASE + 1
    grams = combined(hashes, PHRASE)
    starts = window_starts(w.first, width)
    if len(starts) == 0:
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), z, z
    at = np.arange(len(grams))
    reach = 1
    while reach < span:  # at[i]: place of the least gram in i .. i + reach - 1
        step = min(reach, span - reach)
        n = len(at) - step
        left, right = at[:n], at[step : step + n]
        at = np.where(grams[left] <= grams[right], left, right)
        reach += step
    anchor = at[starts]
    new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)])
    first = np.flatnonzero(new)
    return grams[anchor[first]], starts[first], np.diff(np.append(first, len(starts)))


def anchors(docs: DataFrame, width: int, places: bool) -> DataFrame:
    """anchor (and doc_id, start of its windows) of each anchor occurrence of rows with an id."""

    def make():
        def work(part):
            part = part.filter(part.column("doc_id").is_valid())
            w = find_words(*text_buffer(part.column("text")))
            h, start, _ = anchor_runs(w, w.hashes(), width)
            out = {"anchor": h.view(np.int64)}
            if places:
                doc = np.searchsorted(w.first, start, "right") - 1
                out |= {"doc_id": part.column("doc_id").to_numpy()[doc], "start": (start - w.first[doc]).astype(np.int32)}
            return out

        return work

    return arrow_map(docs, "anchor long" + ", doc_id long, start int" * places, make)


def passages(docs: DataFrame, hits: DataFrame, width: int) -> DataFrame:
    """The words of the windows of each hit; a document's hits come as one list, bounded by its length.

    A hit is a start and a portion (-1 but for hot anchors); its anchor and its number of windows
    are found in the text again, which is less than to shuffle them.
    """
    lists = hits.groupBy("doc_id").agg(F.collect_list(F.struct("start", "portion")).alias("hits"))

    def make():
        def work(part):
            w = find_words(*text_buffer(part.column("text")))
            anchor, begin, count = anchor_runs(w, w.hashes(), width)
            raw = w.data.tobytes()
            column = part.column("hits")
            flat = column.flatten()
            doc = np.repeat(np.arange(part.num_rows), column.value_lengths().to_numpy())
            first = w.first[doc] + flat.field("start").to_numpy().astype(np.int64)
            portion = flat.field("portion").to_numpy()
            at = np.minimum(np.searchsorted(begin, first), max(len(begin) - 1, 0))
            ok = (begin[at] == first) & (first < w.first[doc + 1]) if len(begin) else np.zeros(len(first), bool)  # rows that repeat a doc_id may have another text
            doc, first, portion, at = doc[ok], first[ok], portion[ok], at[ok]
            ends = w.ends[first + count[at] + width - 2]
            text = [raw[a:b] for a, b in zip(w.starts[first].tolist(), ends.tolist())]
            return {
                "anchor": anchor[at].view(np.int64), "portion": portion, "doc_id": part.column("doc_id").to_numpy()[doc], "start": (first - w.first[doc]).astype(np.int32), "words": pa.array(text, pa.binary()),
            }

        return work

    return arrow_map(docs.join(lists, "doc_id"), "anchor long, portion int, doc_id long, start int, words binary", make)


def confirmed(hashes: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word of every window; whether it occurs again; and the number of its sequence of words."""
    at = window_starts(first, width)
    _, number, times = np.unique(combined(hashes, width)[at], return_inverse=True, return_counts=True)
    return at, times[number] > 1, number


def occurrences(text: str, phrases: list[str]) -> np.ndarray:
    """Rows (first character, number of the phrase) of every occurrence in `text` of phrases of one length, found by an automaton."""
    if not phrases:
        return np.zeros((0, 2), np.int64)
    automaton = ahocorasick.Automaton()
    for k, phrase in enumerate(phrases):
        automaton.add_word(phrase, k)
    automaton.make_automaton()
    found = np.array([end << 32 | k for end, k in automaton.iter(text)], np.int64)
    return np.column_stack([(found >> 32) - len(phrases[0]) + 1, found & 0xFFFFFFFF])


def removals(rows: DataFrame, width: int) -> DataFrame:
    """Removed word ranges (doc_id, start, stop); for hot anchors also (w1, w2) of windows first in their portion."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int32()), ("stop", pa.int32()), ("w1", pa.int64()), ("w2", pa.int64())])

    def batch(d, a, b, k1=None, k2=None) -> pa.RecordBatch:
        none = pa.nulls(len(d), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(np.asarray(a, np.int32)), pa.array(np.asarray(b, np.int32)), none if k1 is None else pa.array(k1), none if k2 is None else pa.array(k2)], schema=schema)

    def work(table: pa.Table):
        words = table.column("words").combine_chunks()
        w = find_words(*text_buffer(words.combine_chunks() if isinstance(words, pa.ChunkedArray) else words))
        if len(w.starts) == 0:
            return
        hashes = w.hashes()
        at, again, number = confirmed(hashes, w.first, width)
        _, letter = np.unique(hashes, return_inverse=True)
        # a character for each word, and one that is no word after each passage; the surrogates have none
        ends = w.first[1:] + np.arange(len(w.counts))
        line = np.full(len(hashes) + len(ends), 0xE000, "<u4")
        line[np.arange(len(hashes)) + w.doc()] = letter + 0xE001
        text = line.tobytes().decode("utf-32-le")
        doc, start, portion = (table.column(c).to_numpy() for c in ("doc_id", "start", "portion"))
        passage = np.searchsorted(w.first, at, "right") - 1
        begins = at + passage  # in `text`
        _, sample = np.unique(number[again], return_index=True)
        found = occurrences(text, [text[i : i + width] for i in begins[again][sample].tolist()])
        of = np.searchsorted(ends, found[:, 0])
        place = start[of] + found[:, 0] - (ends - w.counts)[of]
        order = np.lexsort((place, doc[of], found[:, 1]))
        of, place, k = of[order], place[order], found[order, 1]
        new = np.append(True, k[1:] != k[:-1])[: len(k)]
        head = np.flatnonzero(new)[np.cumsum(new) - 1]
        gone = (doc[of] != doc[of[head]]) | (place != place[head])
        if gone.any():
            i, j = of[gone], place[gone]
            order = np.lexsort((j, i))
            i, j = i[order], j[order]
            edge = np.flatnonzero(np.append(True, (i[1:] != i[:-1]) | (j[1:] > j[:-1] + 1)))
            last = np.append(edge[1:], len(i)) - 1
            yield batch(doc[i[edge]], j[edge], j[last] + width)
        if (portion >= 0).any():  # the first place of each window of a hot anchor in its portion
            lone = ~again & (portion[passage] >= 0)
            i = np.concatenate([passage[lone], of[new & (portion[of] >= 0)]])
            j = np.concatenate([start[passage[lone]] + at[lone] - w.first[passage[lone]], place[new & (portion[of] >= 0)]])
            if len(i):
                words_at = w.first[i] + j - start[i]
                yield batch(doc[i], j, j + width, *[_window_keys(hashes, words_at, width, salt) for salt in (1, 2)])

    def run(batches):
        held, rows_held = [], 0
        for group in by_group(batches, ["anchor", "portion"]):
            held.append(group)
            rows_held += group.num_rows
            if rows_held >= COMPILED:
                yield from work(pa.concat_tables(held))
                held, rows_held = [], 0
        if held:
            yield from work(pa.concat_tables(held))

    return rows.repartition("anchor", "portion").sortWithinPartitions("anchor", "portion").mapInArrow(run, "doc_id long, start int, stop int, w1 long, w2 long")


def _window_keys(hashes: np.ndarray, at: np.ndarray, width: int, salt: int) -> np.ndarray:
    f = factors(width * 4)
    total = np.full(len(at), salt, np.uint64)
    for k in range(width):
        total += mix(hashes[at + k] ^ np.uint64(salt)) * f[k + salt * width]
    return mix(total).view(np.int64)


def dedup(spark: SparkSession, documents: DataFrame, width: int = 20, texts: bool = False, portion: int = PORTION) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and the kept text) of every row of `documents`."""
    # a cast would hide from Spark that both joins read the same exchange
    every = documents.select("doc_id" if dict(documents.dtypes)["doc_id"] == "bigint" else F.col("doc_id").cast("long").alias("doc_id"), "text")
    docs = every.filter("doc_id is not null")
    # joins filter null keys; done here, the counts have one plan and one exchange for both uses
    again = anchors(docs, width, False).filter("anchor is not null").groupBy("anchor").agg(F.count("*").alias("times")).filter("times > 1")
    hot = again.orderBy(F.desc("times"), "anchor").limit(HOT).filter(F.col("times") > portion).withColumnRenamed("times", "hot")
    places = anchors(docs, width, True).join(F.broadcast(hot), "anchor", "left")
    # occurrences of hot anchors need no join: they get any key
    places = places.withColumn("key", F.when(F.col("hot").isNull(), F.col("anchor")).otherwise(F.xxhash64("doc_id", "start")))
    hits = places.join(again.select(F.col("anchor").alias("key"), "times"), "key", "left").withColumn("times", F.coalesce("hot", "times")).filter("times is not null")
    spread = F.pmod(F.xxhash64("doc_id", "start"), F.ceil(F.col("times") * 2 / portion))
    hits = hits.select("doc_id", "start", F.when(F.col("times") > portion, spread).otherwise(-1).cast("int").alias("portion"))
    # one exchange brings the ranges of a document together and the first places of a hot window
    alone = F.col("w1").isNull()
    found = removals(passages(docs, hits, width), width).withColumn("meet", F.when(alone, F.xxhash64("doc_id")).otherwise(F.xxhash64("w1", "w2"))).repartition("meet")
    same = Window.partitionBy("meet", "w1", "w2", F.when(alone, F.col("doc_id")), F.when(alone, F.col("start")))
    found = found.withColumn("least", F.min(F.struct("doc_id", "start")).over(same)).filter(alone | (F.struct("doc_id", "start") != F.col("least")))
    lists = found.groupBy("meet", "doc_id").agg(F.collect_list(F.struct("start", "stop")).alias("ranges")).groupBy("doc_id").agg(F.flatten(F.collect_list("ranges")).alias("ranges"))

    def make():
        def work(part):
            w = find_words(*text_buffer(part.column("text")))
            raw = w.data.tobytes()
            column = part.column("ranges")
            lengths = column.value_lengths().fill_null(0).to_numpy()
            flat = column.flatten()
            doc = np.repeat(np.arange(part.num_rows), lengths)
            step = np.zeros(len(w.starts) + 1, np.int64)
            end = w.first[doc + 1]
            np.add.at(step, np.minimum(w.first[doc] + flat.field("start").to_numpy(), end), 1)
            np.add.at(step, np.minimum(w.first[doc] + flat.field("stop").to_numpy(), end), -1)
            kept = np.cumsum(step[:-1]) == 0
            starts, ends = w.starts.tolist(), w.ends.tolist()
            texts_out = []
            for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist()):
                texts_out.append(b" ".join([raw[starts[k] : ends[k]] for k in (np.flatnonzero(kept[a:b]) + a).tolist()]))
            c = np.concatenate([[0], np.cumsum(~kept)])
            return {"doc_id": part.column("doc_id"), "n_words": w.counts, "n_removed": c[w.first[1:]] - c[w.first[:-1]], "kept_sha256": [hashlib.sha256(t).hexdigest() for t in texts_out], "kept": [t.decode() for t in texts_out] if texts else None}

        return work

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * texts
    nameless = every.filter("doc_id is null").withColumn("ranges", F.lit(None).cast("array<struct<start:int,stop:int>>"))
    return arrow_map(docs.join(lists, "doc_id", "left").unionByName(nameless), schema, make)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(spark, read_table(spark, sf_dir, "documents"))
