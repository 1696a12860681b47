"""Periodic runs of words by suffix trees, constant-time common extensions and Lyndon roots.

A run is a stretch of consecutive words with smallest period q, at least two periods (and
``least`` words) long, that no neighbouring word extends. All runs of a text are found:

1. two Ukkonen trees, of the words and of the words reversed, built online with suffix links;
2. an Euler tour of each tree with the string depth at every step. The smallest depth between
   two leaves is the depth of their lowest common ancestor, that is the length of the common
   prefix of two suffixes (in the reversed tree: of the common suffix of two prefixes), and a
   sparse table answers it in constant time;
3. the leaves of the first tree in both alphabet orders (the end stands first in either) give
   the longest Lyndon word at every place: it ends at the next smaller suffix. Every run has
   such a word of length q as its root under one of the orders;
4. each root is extended in both directions by one common extension each; it is a run when
   the stretch holds the root twice.

Trees are built only where a run can be. A run of length L >= least and period q <= L / 2 has
at least ``least // 2`` consecutive words that are repeated q places on, so each of its words lies
in a window of ``least // 2`` words that occurs twice. Words outside such windows are in no run and
cut the text. Windows are compared by hash: a collision keeps more words, never fewer. The
cut is repeated inside the stretches that are left, since copies far apart are then no longer
both in one stretch.

Each text is handled in its own row, so no key can be hot and nothing is shuffled. A worker
holds the longest text of a batch, and some 600 bytes for each word of one stretch.

Cases: a null text has no words; texts of blanks have no words and an empty collapsed text;
repeated rows give repeated results; an empty table gives no rows; a null ``doc_id`` is passed
on; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from evalspark.functions.binding import bind
from evalspark.llm import arrays as A

#: Words of the shortest run.
LEAST = 12
#: Rounds of cutting; more of them only save work.
ROUNDS = 3

RUNS_SCHEMA = "doc_id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


class SuffixTree:
    """Ukkonen's tree of a list of symbols 1..k; the end is symbol 0."""

    def __init__(self, symbols: list[int], k: int) -> None:
        s = [*symbols, 0]
        n, base = len(s), k + 1
        first, last, link, suffix = array("q", [0]), array("q", [0]), array("q", [0]), array("q", [-1])
        edge: dict[int, int] = {}
        node = reach = place = 0  # the active point: `reach` symbols down the edge that begins with s[place]
        waiting, leaves = 0, 0
        for i, symbol in enumerate(s):
            waiting += 1
            open_link = 0
            while waiting:
                if not reach:
                    place = i
                key = node * base + s[place]
                child = edge.get(key)
                if child is None:
                    edge[key] = len(first)
                    first.append(i), last.append(n), link.append(0), suffix.append(leaves)
                    leaves += 1
                    if open_link:
                        link[open_link] = node
                        open_link = 0
                else:
                    begin = first[child]
                    size = min(last[child], i + 1) - begin
                    if reach >= size:
                        node, reach, place = child, reach - size, place + size
                        continue
                    if s[begin + reach] == symbol:
                        reach += 1
                        if open_link:
                            link[open_link] = node
                        break
                    split = len(first)
                    edge[key] = split
                    first.append(begin), last.append(begin + reach), link.append(0), suffix.append(-1)
                    first[child] = begin + reach
                    edge[split * base + s[begin + reach]] = child
                    edge[split * base + symbol] = split + 1
                    first.append(i), last.append(n), link.append(0), suffix.append(leaves)
                    leaves += 1
                    if open_link:
                        link[open_link] = split
                    open_link = split
                waiting -= 1
                if node:
                    node = link[node]
                elif reach:
                    reach -= 1
                    place = i - waiting + 1
        self._suffix = suffix
        self._span = (np.frombuffer(last, np.int64) - np.frombuffer(first, np.int64)).tolist()
        keys = np.fromiter(edge.keys(), np.int64, len(edge))
        order = np.argsort(keys)
        self._child = np.fromiter(edge.values(), np.int64, len(edge))[order].tolist()
        keys = keys[order]
        borders = np.searchsorted(keys, np.arange(len(first) + 1) * base)
        self._from = borders.tolist()
        ended = np.zeros(len(first), bool)
        ended[keys[keys % base == 0] // base] = True
        self._ended = ended.tolist()  # nodes whose first child is the end
        self._n = n

    def tour(self) -> tuple[np.ndarray, np.ndarray]:
        """String depths along the Euler tour, and the place of every suffix's leaf in it."""
        suffix, span, child, upto = self._suffix, self._span, self._child, self._from[1:]
        following, depth, place, depths, path = self._from[:-1], [0] * len(self._span), [0] * self._n, [0], [0]
        while path:
            node = path[-1]
            at = following[node]
            if at < upto[node]:
                following[node] = at + 1
                below = child[at]
                reached = depth[below] = depth[node] + span[below]
                if suffix[below] >= 0:
                    place[suffix[below]] = len(depths)
                    depths += (reached, depth[node])
                else:
                    depths.append(reached)
                    path.append(below)
            else:
                path.pop()
                if path:
                    depths.append(depth[path[-1]])
        return np.array(depths, np.int32), np.array(place, np.int64)

    def ranks_downwards(self) -> np.ndarray:
        """Rank of every suffix when larger symbols stand first and the end before all."""
        suffix, child, start, ended, order, path = self._suffix, self._child, self._from, self._ended, [], [0]
        while path:
            node = path.pop()
            if suffix[node] >= 0:
                order.append(suffix[node])
                continue
            a, b = start[node], start[node + 1]
            if ended[node]:
                path += child[a + 1:b]
                path.append(child[a])
            else:
                path += child[a:b]
        ranks = np.empty(self._n, np.int64)
        ranks[order] = np.arange(self._n)
        return ranks


class Extensions:
    """Length of the common prefix of any two suffixes, by the smallest depth between their leaves."""

    def __init__(self, tree: SuffixTree) -> None:
        depths, self.place = tree.tour()
        self._levels = [depths]
        width = 1
        while 2 * width <= len(depths):
            below = self._levels[-1]
            self._levels.append(np.minimum(below[:-width], below[width:]))
            width *= 2

    def __call__(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        a, b = self.place[x], self.place[y]
        a, b = np.minimum(a, b), np.maximum(a, b) + 1
        level = np.frexp((b - a).astype(np.float64))[1] - 1
        out = np.empty(len(a), np.int64)
        for k in np.unique(level).tolist():
            mine = level == k
            out[mine] = np.minimum(self._levels[k][a[mine]], self._levels[k][b[mine] - (1 << k)])
        return out


def _next_smaller(ranks: list[int]) -> list[int]:
    """For every suffix but the last, which is smallest, the next one that is smaller."""
    out, path = [0] * (len(ranks) - 1), [len(ranks) - 1]
    for i in range(len(ranks) - 2, -1, -1):
        while ranks[path[-1]] > ranks[i]:
            path.pop()
        out[i] = path[-1]
        path.append(i)
    return out


def runs_of(symbols: list[int], least: int = LEAST) -> np.ndarray:
    """All runs of a list of symbols as rows ``(start, length, period)``, by start, then period."""
    n = len(symbols)
    if n < max(least, 2):
        return np.zeros((0, 3), np.int64)
    names = {x: i + 1 for i, x in enumerate(dict.fromkeys(symbols))}
    coded = [names[x] for x in symbols]
    tree = SuffixTree(coded, len(names))
    forward = Extensions(tree)
    upwards = np.argsort(np.argsort(forward.place))
    roots = np.array(_next_smaller(upwards.tolist()) + _next_smaller(tree.ranks_downwards().tolist()), np.int64)
    del tree
    i, j = np.tile(np.arange(n), 2), roots
    right = forward(i, j)
    del forward
    backward = Extensions(SuffixTree(coded[::-1], len(names)))
    left = backward(n - i, n - j)
    period, start, end = j - i, i - left, j + right
    found = end - start >= np.maximum(2 * period, least)
    return np.unique(np.stack([start, end - start, period], 1)[found], axis=0)


def _repeated(grams: np.ndarray, usable: np.ndarray, width: int) -> np.ndarray:
    """Words inside a window that occurs twice among the usable ones."""
    places = np.flatnonzero(usable)
    order = places[np.argsort(grams[places])]
    equal = grams[order[1:]] == grams[order[:-1]]
    change = np.zeros(len(grams) + width, np.int32)
    twice = np.zeros(len(grams), bool)
    twice[order[1:][equal]] = True
    twice[order[:-1][equal]] = True
    at = np.flatnonzero(twice)
    change[at] += 1
    change[at + width] -= 1
    return np.cumsum(change[:-1])[:len(grams) + width - 1] > 0


def candidate_stretches(hashes: np.ndarray, rows: np.ndarray, least: int = LEAST) -> list[tuple[int, int]]:
    """Stretches of words that can hold a run; words outside of them lie in none."""
    width = max(least // 2, 1)
    if len(hashes) < least:
        return []
    grams = A.ngram_hashes(hashes, width)
    group, active = rows.astype(np.int64), np.ones(len(hashes), bool)
    for _ in range(ROUNDS):
        usable = active[:len(grams)] & active[width - 1:] & (group[:len(grams)] == group[width - 1:])
        kept = _repeated(A.mix(grams ^ A.mix(group[:len(grams)].astype(np.uint64))), usable, width)
        starts = np.flatnonzero(kept & ~np.concatenate([[False], kept[:-1] & (group[1:] == group[:-1])]))
        ends = np.flatnonzero(kept & ~np.concatenate([kept[1:] & (group[1:] == group[:-1]), [False]])) + 1
        long = ends - starts >= least
        starts, ends = starts[long], ends[long]
        change = np.zeros(len(hashes) + 1, np.int32)
        np.add.at(change, starts, 1)
        np.add.at(change, ends, -1)
        before, active = active, np.cumsum(change[:-1]) > 0
        group = np.full(len(hashes), -1, np.int64)
        group[active] = np.repeat(np.arange(len(starts)), ends - starts)
        if (before == active).all():
            break
    return list(zip(starts.tolist(), ends.tolist()))


def _collapsed(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray, rows: np.ndarray, keep: np.ndarray) -> pa.Array:
    """The kept words of every row, joined by one space."""
    starts, ends, rows = starts[keep], ends[keep], rows[keep]
    change = np.zeros(len(data) + 1, np.int8)
    change[starts] += 1
    change[ends] -= 1
    taken = np.cumsum(change[:-1], dtype=np.int8).astype(bool)
    between = ends[:-1][rows[1:] == rows[:-1]]
    taken[between] = True
    out = data.copy()
    out[between] = 0x20
    sizes = np.concatenate([[0], np.cumsum(taken)])[offsets].astype(np.int32)
    return pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(sizes), pa.py_buffer(out[taken].tobytes()))


def _scan(least: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    run_type = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    for batch in batches:
        for first, data, offsets in A.pieces(batch.column(1)):
            n = len(offsets) - 1
            starts, ends, rows = A.word_bounds(data, offsets, A.NOT_BLANK)
            borders = np.searchsorted(rows, np.arange(n + 1))
            keep, found, owners = np.ones(len(starts), bool), [], []
            text = data.tobytes()
            for a, b in candidate_stretches(A.word_hashes(data, starts, ends, lower=False), rows, least):
                runs = runs_of([text[x:y] for x, y in zip(starts[a:b].tolist(), ends[a:b].tolist())], least)
                if len(runs):
                    change = np.zeros(b - a + 1, np.int32)
                    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
                    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
                    keep[a:b] &= np.cumsum(change[:-1]) == 0
                    runs[:, 0] += a - borders[rows[a]]
                    found.append(runs)
                    owners.append(np.full(len(runs), rows[a]))
            runs = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
            counts = np.bincount(np.concatenate(owners), minlength=n) if owners else np.zeros(n, np.int64)
            lists = pa.ListArray.from_arrays(
                pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()),
                pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(runs[:, k])) for k in range(3)], fields=list(run_type)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(first, n), pa.array(np.diff(borders), pa.int64()), lists,
                 _collapsed(data, offsets, starts, ends, rows, keep)], ["doc_id", "n_words", "runs", "collapsed"])


def find_runs(documents: DataFrame, least: int = LEAST) -> DataFrame:
    """Per document: its number of words, its runs by start, then period, and the text without repetition.

    ``collapsed`` joins by one space the words that no run contains after its first period.
    """
    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(lambda b: _scan(least, b), RUNS_SCHEMA.format(kind=kind))


def with_periodic_tails(documents: DataFrame) -> DataFrame:
    """The documents, where one in ten (by a hash of its id) repeats a stretch of words up to its end."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def rebuilt(w: Column) -> Column:
        n = F.size(w)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        tail = F.transform(F.sequence(a, n - F.lit(1).cast("bigint")), lambda i: F.get(w, (a + (i - a) % p).cast("int")))
        return F.when(n > 0, F.array_join(F.concat(F.slice(w, F.lit(1), a.cast("int")), tail), " ")).otherwise("")
    return documents.select("doc_id", F.when(h % 10 == 0, bind(words, rebuilt)).otherwise(F.col("text")).alias("text"))


def run_digests(found: DataFrame) -> DataFrame:
    """Counts, the longest run and digests of the results of ``find_runs``."""
    best = F.get(F.array_sort("runs", lambda x, y: F.when(x["length"] != y["length"], y["length"] - x["length"]).when(
        x["start"] != y["start"], x["start"] - y["start"]).otherwise(x["period"] - y["period"]).cast("int")), F.lit(0))
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","),
                                                   r["period"].cast("string"), F.lit("\n")))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(F.lit(1000).cast("bigint") * F.col("best.length") / F.col("best.period")).cast("bigint").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
