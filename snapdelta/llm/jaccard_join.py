"""N-gram Jaccard join: documents whose sets of word shingles are alike, by T-occurrence search.

A document's set has its distinct k-word shingles as 64-bit hashes. Two stages find all links.

Blocks. Sets of like size whose similarity reaches the threshold differ in at most D shingles.
If the hash range is cut into more than D segments, some segments have the same shingles in
both; so equal segments (hashed, with the size band and the place) bring every linked pair
together. Each set is told how many of its segments a linked set must share; sets that share
fewer, with any others, are dropped before blocks are made, so that common passages join no
strangers; the rest keep only the rarest of their segments, enough to meet each linked set in one.
Documents that share these segments in one size band, over any number of steps, then form a block
of that band; equal sets count once, whatever the number of copies. A segment crosses the network once, and once only for
each portion of a task's documents, however many of them hold it.

Search. Within a block, T-occurrence by DivideSkip: each shingle has an inverted list of the
documents that hold it. For a document with the required overlap T, the L longest of its lists
are set aside, the others are heap-merged, documents that occur T - L times or more are probed
by binary search in the long lists, and those that reach the overlap are linked. Documents that
links already join are not compared again and leave the lists before they are merged. Blocks above
a bound of rows or shingles are cut into parts: first each part alone, then every pair of parts that
can hold a link between different components, so that no task holds a whole large block and no link
is lost.

Words are runs outside white space, lower-cased in A-Z. Texts with fewer than k words have one
shingle, the whole sequence; null texts and texts without words have none and are linked with
nothing. Rows without doc_id keep a row, name no component and make no links for others.
Repeated rows and copies share a component. An empty table gives an empty result; extra columns
are ignored. Order of rows and ties of size change nothing, as components don't depend on them.
Sets are told apart by a 64-bit hash; two of n different sets collide with chance n**2 / 2**65.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .shared import arrow_map, cut, discard, give_back, may_hold, read_table, rewrite, slices, text_buffer, without
from .words import LOWER, factors, find_words, mix, windows

#: A block above this many documents or shingles is cut into parts.
PART_ROWS, PART_SHINGLES = 4096, 1 << 21
_U = np.uint64


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """Sorted distinct shingles of each text."""
    w = find_words(LOWER[data], offsets)
    h = w.hashes()
    grams, at = windows(h, w.first, k)
    bounds = np.searchsorted(at, w.first)
    out = []
    f = factors(k + 1)
    for i, n in enumerate(w.counts.tolist()):
        if n >= k:
            out.append(np.unique(grams[bounds[i] : bounds[i + 1]]))
        elif n:
            out.append(mix(np.array([(h[w.first[i] : w.first[i + 1]] * f[1 : n + 1]).sum(dtype=np.uint64) + _U(n)])))
        else:
            out.append(h[:0])
    return out


def set_key(s: np.ndarray) -> int:
    """Signed 64-bit name of a set."""
    x = mix((mix(s) * (mix(np.arange(1, len(s) + 1, dtype=np.uint64)) | _U(1))).sum(dtype=np.uint64, keepdims=True) + _U(len(s)))
    return int(x.view(np.int64)[0])


#: Low bits of a signature that hold the number of its size band.
BAND_BITS = 7
#: Cuts of a set by different hashes, at most.
CUTS = 32


class Segments:
    """Signatures of sets: for each size band the hash range is cut into D + 1 + spare segments.

    Two alike sets agree on spare + 1 segments at least. Empty segments give no signature, as
    strangers agree on them too; so a set with e <= spare of them shares spare + 1 - e signatures
    at least with each set like it. A set with more is cut again, by another hash, until it has
    at most `spare`, and gives the signatures of all its cuts: of two alike sets the first that
    is done has such a cut, and the other gives signatures for the same one. After CUTS cuts,
    which chance hardly ever needs, a set gives its empty segments as well, and every set with
    that many cuts does.
    """

    def __init__(self, percent: int):
        self.percent = percent
        self.low = [1]

    def bands(self, n: int) -> Iterator[tuple[int, int, int]]:
        """(number, segments, spare) of the band of `n` and of the next where `n` may be the smaller set."""
        while self.low[-1] * self.percent <= n * 100:
            self.low.append(max(self.low[-1] + 1, int(self.low[-1] * 1.25)))
        b = int(np.searchsorted(self.low, n, "right")) - 1
        while self.low[b] * self.percent <= n * 100:
            if b + 1 == len(self.low):
                self.low.append(max(self.low[-1] + 1, int(self.low[-1] * 1.25)))
            apart = 2 * (self.low[b + 1] - 1) * (100 - self.percent) // (100 + self.percent)
            spare = 3 + apart // 6 if apart else 0
            yield b, apart + 1 + spare, spare
            b += 1

    def band_of(self, n: Column) -> Column:
        """Number of the band of the size `n`."""
        for _ in self.bands(1 << 40):
            pass
        return F.size(F.filter(F.array(*map(F.lit, self.low)), lambda x: x <= n)) - 1

    def signatures(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Signatures of a set, the band in their low bits, and how many of a band a like set shares at least."""
        if len(s) == 0:
            return s, np.zeros(0, np.int32)
        cuts = [self._summed(s, 0)]
        out, needs = [], []
        for band, m, spare in self.bands(len(s)):
            edges = ((np.arange(m + 1, dtype=np.uint64) << _U(32)) + _U(m - 1)) // _U(m)
            own = []
            for salt in range(CUTS):
                if salt == len(cuts):
                    cuts.append(self._summed(s, salt))
                top, sums = cuts[salt]
                at = np.searchsorted(top, edges)
                at[-1] = len(s)
                sig = mix((sums[at[1:]] - sums[at[:-1]]) ^ mix(np.arange(m, dtype=np.uint64) + _U(band << 32 | salt << 48)))
                full = at[1:] > at[:-1]
                n_empty = m - int(full.sum())
                own.append(sig if salt == CUTS - 1 else sig[full])
                if n_empty <= spare:
                    break
            own = np.concatenate(own)
            out.append(own >> _U(BAND_BITS) << _U(BAND_BITS) | _U(band))
            needs.append(np.full(len(own), 1 if salt else spare + 1 - n_empty, np.int32))
        return np.concatenate(out), np.concatenate(needs)

    @staticmethod
    def _summed(s: np.ndarray, salt: int) -> tuple[np.ndarray, np.ndarray]:
        """Upper halves of the sorted hashes of a cut, and sums over the shingles before each."""
        if salt:
            s = np.sort(mix(s ^ mix(np.array([salt], np.uint64))))
        return s >> _U(32), np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(s ^ _U(0x5851F42D4C957F2D)), dtype=np.uint64)])


def identities(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n_shingles and node (the set's name; null for an empty set) of every row."""

    def make():
        def work(part):
            sets = shingle_sets(*text_buffer(part.column("text")), k)
            node = pa.array([set_key(s) if len(s) else None for s in sets], pa.int64())
            return {"doc_id": part.column("doc_id"), "n_shingles": [len(s) for s in sets], "node": node}

        return work

    return arrow_map(docs, "doc_id long, n_shingles long, node long", make)


#: Signatures that a task sorts at a time, and what became of one there.
HELD = 1 << 20
LONE, SHARED, AGAIN = 0, 1, 2


def signature_rows(docs: DataFrame, k: int, percent: int, held: int = HELD) -> DataFrame:
    """(sig, node, mark) of the sets of every row with an id, each (sig, node) once for `held` signatures.

    mark = 4 * need + LONE, SHARED (others in the same portion have the signature too) or AGAIN (such another).
    """
    schema = pa.schema([("sig", pa.int64()), ("node", pa.int64()), ("mark", pa.int32())])

    def flush(sigs: list, needs: list, nodes: list) -> pa.RecordBatch:
        sig, need, node = np.concatenate(sigs), np.concatenate(needs), np.concatenate(nodes)
        order = np.argsort(sig)
        ranked = sig[order]
        first = np.concatenate([[True], ranked[1:] != ranked[:-1]])
        mark = np.empty(len(sig), np.int32)
        mark[order] = np.where(first, np.where(np.append(first[1:], True), LONE, SHARED), AGAIN)
        # in the order of the sets, as rows that repeat a node beside each other are written smaller
        return pa.RecordBatch.from_arrays([pa.array(sig.view(np.int64)), pa.array(node), pa.array(need * 4 + mark, pa.int32())], schema=schema)

    def run(batches):
        segments = Segments(percent)
        seen: set[int] = set()
        sigs, needs, nodes, n = [], [], [], 0
        for batch in batches:
            for part in slices(batch, "text"):
                for s, known in zip(shingle_sets(*text_buffer(part.column("text")), k), part.column("doc_id").is_valid().to_pylist()):
                    if len(s) and known and (key := set_key(s)) not in seen:
                        seen.add(key)
                        sig, need = segments.signatures(s)
                        sigs.append(sig)
                        needs.append(need)
                        nodes.append(np.full(len(sig), key, np.int64))
                        n += len(sig)
                        if n >= held:
                            yield flush(sigs, needs, nodes)
                            seen.clear()
                            sigs, needs, nodes, n = [], [], [], 0
        if n:
            yield flush(sigs, needs, nodes)
        del sigs, needs, nodes, seen
        give_back()

    return docs.select("doc_id", "text").mapInArrow(run, "sig long, node long, mark int")


def shared_signatures(rows: DataFrame) -> DataFrame:
    """(sig, node, need) of the signatures that two different nodes have; a row for each portion that holds it.

    One row a portion and signature meets the others of its signature; the portion's further rows
    are known to be shared and go anywhere. The rows come sorted, so a task holds one batch.
    """
    schema = pa.schema([("sig", pa.int64()), ("node", pa.int64()), ("need", pa.int32())])

    def run(batches):
        empty = np.zeros(0, np.int64)
        s0, n0, m0, before0 = empty, empty, empty.astype(np.int32), np.zeros(0, bool)

        def out(sig, node, mark, keep):
            return pa.RecordBatch.from_arrays([pa.array(sig[keep]), pa.array(node[keep]), pa.array(mark[keep] >> 2, pa.int32())], schema=schema)

        for batch in batches:
            if batch.num_rows == 0:
                continue
            s, n, m = (np.concatenate([x, batch.column(c).to_numpy()]) for x, c in ((s0, "sig"), (n0, "node"), (m0, "mark")))
            first = np.flatnonzero(np.concatenate([[True], (s[1:] != s[:-1]) | (n[1:] != n[:-1])]))
            s, n, m = s[first], n[first], np.maximum.reduceat(m, first)  # a node's need is the same in all its rows of a signature
            like = s[1:] == s[:-1]
            before = np.concatenate([before0 if len(before0) else [False], like])
            shared = before | np.append(like, False) | (m & 3 > 0)
            s0, n0, m0, before0 = s[-1:], n[-1:], m[-1:], before[-1:]
            shared[-1] = False
            if shared.any():
                yield out(s, n, m, shared)
        if len(s0):
            yield out(s0, n0, m0, before0 | (m0 & 3 > 0))

    key = F.when(F.col("mark").bitwiseAND(3) == AGAIN, F.xxhash64("sig", "node")).otherwise(F.col("sig"))
    return rows.repartition(key).sortWithinPartitions("sig", "node").mapInArrow(run, "sig long, node long, need int")


def near_pairs(shared: DataFrame, rounds: int = 2) -> DataFrame:
    """(node, centre, band): each node beside the least node of every signature they share.

    Before that, nodes that share fewer signatures of a band than a like set would are dropped,
    and again, as others then share fewer. In the last round each node keeps its rarest
    signatures of a band, without need - 1 of the most frequent (prefix filter): two alike sets
    share as many as each of them needs, so both keep the rarest of these, while signatures of
    common passages bring few strangers together.
    """
    band = F.col("sig").bitwiseAND((1 << BAND_BITS) - 1)
    last = None
    shared = shared.withColumn("n", F.lit(0).cast("long"))
    for _ in range(rounds):
        own = shared.groupBy("node", band.alias("band")).agg(F.collect_set(F.struct("n", "sig")).alias("sigs"), F.first("need").alias("need"))  # at most as many as one set has segments
        own = own.filter(F.size("sigs") >= F.col("need"))
        if last is not None:
            own = own.withColumn("sigs", F.slice(F.sort_array("sigs"), F.lit(1), F.size("sigs") - F.col("need") + 1))
        enough = rewrite(own.select("node", "need", F.explode("sigs.sig").alias("sig")), "signatures")
        if last is not None:
            discard(last)
        last = enough
        centres = enough.groupBy("sig").agg(F.min("node").alias("centre"), F.max("node").alias("other"), F.count("*").alias("n")).filter("centre < other").select("sig", "centre", "n")
        shared = enough.join(centres, "sig")
    pairs = rewrite(shared.filter("node <> centre").select("node", "centre", band.alias("band")).distinct(), "pairs")
    discard(last)
    return pairs


def blocks(pairs: DataFrame) -> DataFrame:
    """(node, band, block): the nodes that the pairs of one band join, over any number of steps.

    Two alike sets meet in the band of the larger one. No step goes from band to band.
    """
    at = lambda name: F.xxhash64(name, "band")
    found = components(pairs.select(at("node").alias("u"), at("centre").alias("v")))
    ends = pairs.select("node", "band").union(pairs.select("centre", "band")).distinct()
    return ends.withColumn("id", at("node")).join(found, "id").select("node", "band", F.col("label").alias("block"))


class Joined:
    """Which documents of a task links already join: equal labels; a join relabels the smaller side."""

    def __init__(self, labels: np.ndarray):
        _, self.label = np.unique(labels, return_inverse=True)
        order = np.argsort(self.label, kind="stable")
        self.members = np.split(order, np.cumsum(np.bincount(self.label))[:-1]) if len(labels) else []

    def join(self, x: int, y: int) -> None:
        a, b = int(self.label[x]), int(self.label[y])
        if len(self.members[a]) < len(self.members[b]):
            a, b = b, a
        self.label[self.members[b]] = a
        self.members[a] = np.concatenate([self.members[a], self.members[b]])
        self.members[b] = self.members[b][:0]


def merge_counts(lists: list[np.ndarray]) -> tuple[list[int], list[int]]:
    """Documents in the sorted lists, and in how many, by a heap merge."""
    docs, counts, last = [], [], -1
    for d in heapq.merge(*[x.tolist() for x in lists]):
        if d == last:
            counts[-1] += 1
        else:
            docs.append(d)
            counts.append(1)
            last = d
    return docs, counts


def divide_skip(sets: list[np.ndarray], labels: np.ndarray, percent: int, asks: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that join all linked documents of one task.

    All lists have one order, the shortest first. A document of n shingles, of which a linked one
    holds T at least, sets its T - l longest lists aside and is posted in the others alone; so two
    linked documents share at least the smaller l of theirs among postings of both. Documents met
    so often are probed in all lists. Near copies of one text that are not linked with each other
    differ in many short lists, so they are not posted in the long ones of what they have in common.

    Documents of equal `labels` are joined from the start. Where `asks` is given, only pairs with
    at least one asking document are compared.
    """
    order = np.argsort([len(s) for s in sets], kind="stable")
    size = np.array([len(sets[i]) for i in order])
    n = len(order)
    values = np.concatenate([sets[i] for i in order])
    first = np.concatenate([[0], np.cumsum(size)])
    by_value = np.argsort(values, kind="stable")
    ranked = values[by_value]
    new = np.append(True, ranked[1:] != ranked[:-1])
    start = np.append(np.flatnonzero(new), len(values))
    del values, ranked
    of_rank = np.cumsum(new, dtype=np.int32) - 1
    of = np.empty(len(by_value), np.int32)  # number of the inverted list of each shingle of each document
    of[by_value] = of_rank
    holder = np.repeat(np.arange(n, dtype=np.int32), size)[by_value]
    del by_value, new
    length = np.diff(start)
    rank = np.empty(len(length), np.int64)
    rank[np.argsort(length, kind="stable")] = np.arange(len(length))  # one order of all lists, the shortest first
    probe = of_rank.astype(np.int64) * n + holder  # sorted: a list's documents are found by binary search
    del of_rank, holder
    joined = Joined(labels[order])
    ask = None if asks is None else asks[order]
    links = []
    low = np.searchsorted(size * 100, size * percent)
    spare = 1 + size // 64
    # each document is posted in its shortest lists alone, those that it does not set aside for any document of its size or larger
    posts = np.minimum(size, size - -(-2 * percent * size // (100 + percent)) + spare)
    shortest = np.argsort((np.repeat(np.arange(n, dtype=np.int64), size) << 32) + rank[of])  # of each document, from first[x] on, by rank
    kept = shortest[np.arange(len(of)) - np.repeat(first[:-1], size) < np.repeat(posts, size)]
    kept = kept[length[of[kept]] > 1]
    at = of[kept]
    by_list = np.argsort(at, kind="stable")  # documents stay in order
    posted = np.repeat(np.arange(n, dtype=np.int32), size)[kept][by_list]
    start = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=len(length)))])
    del kept, at, by_list

    def alike(x: int, y: int, common: int) -> bool:
        if 100 * common < percent * (int(size[x]) + int(size[y]) - common):
            return False
        joined.join(x, y)
        links.append((int(order[x]), int(order[y])))
        return True

    for x in range(1, n):
        nx = int(size[x])
        if low[x] == x:
            continue
        need = -(-percent * (nx + int(size[low[x]])) // (100 + percent))  # T for the smallest document that may be linked
        least = int(spare[low[x]])
        mine = of[shortest[first[x] : first[x] + min(nx, nx - need + int(spare[x]))]]  # all but the L longest lists, which are probed
        lists = []
        for a, b in zip(start[mine].tolist(), start[mine + 1].tolist()):
            if b - a > 1:
                p = posted[a:b]
                if b - a > 8:
                    p = p[np.searchsorted(p, low[x]) : np.searchsorted(p, x)]
                else:
                    p = p[(p >= low[x]) & (p < x)]
                if len(p):
                    lists.append(p)
            elif b > a and low[x] <= posted[a] < x:
                lists.append(posted[a:b])
        strangers = lambda p: p[joined.label[p] != joined.label[x]] if ask is None or ask[x] else p[(joined.label[p] != joined.label[x]) & ask[p]]
        lists = [p for p in map(strangers, lists) if len(p)]
        while len(lists) >= least:  # while the nearest of the shortest list is a link, its whole component leaves the lists
            y = int(min(lists, key=len)[-1])
            if not alike(x, y, len(np.intersect1d(sets[order[x]], sets[order[y]], assume_unique=True))):
                break
            lists = [p for p in map(strangers, lists) if len(p)]
        if len(lists) < least:
            continue
        own = of[first[x] : first[x + 1]].astype(np.int64) * n
        for y, c in sorted(zip(*merge_counts(lists)), key=lambda t: -t[1]):
            if c < least:
                break
            if c < spare[y] or joined.label[x] == joined.label[y]:
                continue
            at = np.minimum(np.searchsorted(probe, own + y), len(probe) - 1)
            alike(x, y, int((probe[at] == own + y).sum()))
    return links


def by_group(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of equal keys of rows that come sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        edges = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            key = tuple(c[a] for c in columns)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def search(rows: DataFrame, k: int, percent: int) -> DataFrame:
    """Links (u, v) among the rows of each task (block, part); rows: block, part, node, label, ask, text."""

    def run(batches):
        schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])
        for group in by_group(batches, ["block", "part"]):
            nodes, labels, ask, sets = [], [], [], []
            for batch in group.to_batches():
                for piece in slices(batch, "text"):
                    sets += shingle_sets(*text_buffer(piece.column("text")), k)
                nodes += batch.column("node").to_pylist()
                labels += batch.column("label").to_pylist()
                ask += batch.column("ask").to_pylist()
            node = np.array(nodes, np.int64)
            _, keep = np.unique(node, return_index=True)
            keep = np.array([i for i in keep.tolist() if len(sets[i]) and set_key(sets[i]) == nodes[i]], np.int64)
            if len(keep) < 2:
                continue
            got = divide_skip([sets[i] for i in keep.tolist()], np.array(labels, np.int64)[keep], percent, None if all(ask) else np.array(ask, bool)[keep])
            if got:
                pairs = node[keep][np.array(got)]
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], schema=schema)
            del sets
        give_back()

    return rows.repartition("block", "part").sortWithinPartitions("block", "part").mapInArrow(run, "u long, v long")


def join(spark: SparkSession, documents: DataFrame, k: int = 5, percent: int = 80, part_rows: int = PART_ROWS, part_shingles: int = PART_SHINGLES) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of `documents`."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ids = cut(identities(docs, k))
    pairs = near_pairs(shared_signatures(signature_rows(docs, k, percent)))
    one = ids.filter("node is not null and doc_id is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n_shingles"))
    # a set asks in the band of its size; in those of larger sets it only answers
    members = cut(one.join(blocks(pairs), "node").withColumn("ask", Segments(percent).band_of(F.col("n_shingles")) == F.col("band")).drop("band"))
    discard(pairs)
    members = cut(members.join(_parts(members, part_rows, part_shingles), "block").withColumn("part", F.pmod(F.xxhash64("node", F.lit(1)), F.col("parts")).cast("int")))
    docs = docs.filter(may_hold(members)(F.col("doc_id")))
    texts = docs.join(members.select("doc_id", "node", "block", "part", "ask"), "doc_id")
    links = cut(search(texts.select("block", "part", "node", F.col("node").alias("label"), "ask", "text"), k, percent))
    large = members.filter("parts > 1")
    if large.limit(1).count():
        links = cut(links.union(across(docs, large, links, k, percent, part_rows, part_shingles)))
    found = components(links)
    named = ids.join(found.withColumnRenamed("id", "node"), "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = named.filter("label is not null").groupBy("label").agg(F.min("doc_id").alias("least"))
    return named.join(least, "label", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNull(), F.lit(None).cast("long")).otherwise(F.coalesce("least", "doc_id")).alias("component_id"))


def _parts(members: DataFrame, part_rows: int, part_shingles: int) -> DataFrame:
    """In how many parts each block has to be searched; blocks where none asks are left out."""
    return members.groupBy("block").agg(F.max("ask").alias("asked"), F.greatest(F.ceil(F.count("*") / part_rows), F.ceil(F.sum("n_shingles") / part_shingles)).cast("int").alias("parts")).filter("asked").drop("asked")


def across(docs: DataFrame, large: DataFrame, links: DataFrame, k: int, percent: int, part_rows: int, part_shingles: int) -> DataFrame:
    """Links between the parts of large blocks.

    Documents outside the largest component of their block ask all parts; pairs inside it need
    no link. Askers go in portions, so that a task holds one part and one portion at most.
    """
    found = components(links)
    labelled = cut(large.drop("ask").join(found.withColumnRenamed("id", "node"), "node", "left").withColumn("label", F.coalesce("label", "node")))
    most = labelled.groupBy("block", "label").count().groupBy("block").agg(F.max_by("label", F.struct("count", F.col("label"))).alias("main"))
    labelled = labelled.join(most, "block").withColumn("ask", F.col("label") != F.col("main"))
    portions = labelled.filter("ask").groupBy("block").agg(F.greatest(F.ceil(F.count("*") / part_rows), F.ceil(F.sum("n_shingles") / part_shingles)).cast("int").alias("portions"))
    rows = cut(labelled.join(portions, "block").withColumn("portion", F.pmod(F.xxhash64("node", F.lit(2)), F.col("portions")).cast("int")))
    resting = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("portions") - 1))).select("doc_id", "node", "block", "label", F.lit(False).alias("ask"), (F.col("other") * F.col("parts") + F.col("part")).alias("part"))
    asking = rows.filter("ask").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("doc_id", "node", "block", "label", F.lit(True).alias("ask"), (F.col("portion") * F.col("parts") + F.col("other")).alias("part"))
    tasks = resting.union(asking).groupBy("doc_id", "node", "block", "label", "part").agg(F.max("ask").alias("ask"))
    return search(docs.join(tasks, "doc_id").select("block", "part", "node", "label", "ask", "text"), k, percent)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(spark, read_table(spark, sf_dir, "documents"), k=3, percent=90)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component stays: that of the smallest doc_id. Rows without id stay."""
    named = join(spark, docs).filter("doc_id is not null")
    gone = named.groupBy("doc_id").agg(F.bool_or(F.col("doc_id") == F.col("component_id")).alias("stays")).filter("not stays")
    return without(docs, cut(gone.select("doc_id")))
