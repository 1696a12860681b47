"""Exact Jaccard self join on word shingles, with filters under several token orders.

Two documents link when ``percent`` of their shingles' union is shared. The work is cut
down in steps that never lose a link:

1. equal shingle sets collapse into one class (copies, however many, are one row);
2. order one, ascending hash: of a set's first ``d + m`` shingles (d may differ, m = depth * d + 1)
   at least ``m`` of the partner's size must also stand in another class's first ones.
   Sets below that leave. A shingle that two sets of one piece of text share is settled in
   that piece; of every other only one row a piece is shuffled, once;
3. order two, rarity among the sets that are left: partners share a shingle of their
   prefixes, at places and lengths that still allow the needed overlap;
4. order three, descending hash, and order one again: both prefixes must meet;
5. the pairs that pass all orders are verified on whole sets.

Pairs of a group are not listed. Every posting list first offers its members only its
pivot; the links found give components, and only members of different components are
compared after that. So a large group of near copies costs about one comparison per member
and list, and what is left to compare lies between components.

Cases: a text without words (null, empty, blank) has the empty set and links with nothing;
fewer than ``size`` words form one shingle; repeated rows are copies; ties go to the
smallest id; a null id stays null unless a linked row has an id; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from evalspark.llm import arrays as A
from evalspark.llm.components import components
from evalspark.llm.decontaminate import hash_bitmap
from evalspark.session import cut_lineage

BITS = 24


def _shingle_sets(column: pa.Array, size: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """First row of a piece, and its rows' sorted distinct shingle hashes."""
    for first, data, offsets in A.pieces(column):
        n = len(offsets) - 1
        starts, ends, rows = A.word_bounds(data, offsets, A.NOT_BLANK)
        hashes = A.word_hashes(data, starts, ends, lower=True)
        grams = A.ngram_hashes(hashes, size)
        borders = np.searchsorted(rows, np.arange(n + 1)).tolist()
        sets = []
        for a, b in zip(borders, borders[1:]):
            if b - a >= size:
                sets.append(np.unique(grams[a:b - size + 1]))
            else:
                sets.append(A.ngram_hashes(hashes[a:b], b - a) if b > a else grams[:0])
        yield first, sets


def _slack(n: int, percent: int) -> int:
    """Shingles of a set of ``n`` that a partner may lack."""
    return n + (-percent * n // 100)


def _describe(size: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, sets in _shingle_sets(batch.column(1), size):
            keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(first, len(sets)), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary())],
                ["doc_id", "n", "set_key"])


def _first_tokens(size: int, percent: int, depth: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The ``d + m`` smallest hashes of every set, with the set's short key and its copies in the piece.

    A hash that two keys of the piece share is known to be shared: its sets get their count at once,
    in a row of weight below zero, and only its first and last key go on, as witnesses without weight.
    """
    for batch in batches:
        for _, sets in _shingle_sets(batch.column(0), size):
            by_key: dict[bytes, list] = {}
            for s in sets:
                if len(s):
                    by_key.setdefault(hashlib.blake2b(s.tobytes(), digest_size=16).digest()[:8], []).append(s)
            if not by_key:
                continue
            heads = [g[0][:(depth + 1) * _slack(len(g[0]), percent) + 1] for g in by_key.values()]
            copies = np.array([len(g) for g in by_key.values()], np.int64)
            names = np.frombuffer(b"".join(by_key), ">i8").astype(np.int64)
            tokens, owners = np.concatenate(heads), np.repeat(np.arange(len(heads)), [len(h) for h in heads])
            order = np.argsort(tokens, kind="stable")
            tokens, owners = tokens[order], owners[order]
            begins = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
            sizes = np.diff(np.append(begins, len(tokens)))
            one, many = begins[sizes == 1], begins[sizes > 1]
            settled = np.repeat(sizes > 1, sizes)
            met = np.bincount(owners[settled], minlength=len(heads)) * copies
            mine = np.flatnonzero(met)
            witnesses = np.concatenate([many, many + sizes[sizes > 1] - 1])
            sent = np.concatenate([one, witnesses])
            weights = np.concatenate([copies[owners[one]], np.zeros(len(witnesses), np.int64), -met[mine]])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([tokens[sent].astype(np.int64), names[mine]])), pa.array(np.concatenate([names[owners[sent]], names[mine]])),
                 pa.array(weights.astype(np.int32))], ["token", "owner", "weight"])


def _whole_sets(size: int, packed: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole sets of the rows whose id hash is in the bitmap."""
    bitmap = np.unpackbits(packed).view(bool)
    for batch in batches:
        slots = batch.column(1).to_numpy().view(np.uint64) >> np.uint64(64 - BITS)
        chosen = batch.take(pa.array(np.flatnonzero(bitmap[slots.astype(np.int64)])))
        for first, sets in _shingle_sets(chosen.column(2), size):
            keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
            tokens = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(s) for s in sets])]), pa.int32()),
                                              pa.array(np.concatenate(sets).astype(np.int64)))
            yield pa.RecordBatch.from_arrays([chosen.column(0).slice(first, len(sets)), pa.array(keys, pa.binary()), tokens],
                                             ["doc_id", "set_key", "tokens"])


def _slack_column(n: Column, percent: int) -> Column:
    return (n - F.ceil(n * percent / 100)).cast("bigint")


def _needed(nx: Column, ny: Column, percent: int) -> Column:
    """Shared shingles that two sets of these sizes need."""
    return F.ceil((nx + ny) * percent / (100 + percent))


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs that pass the prefix filters of both hash orders and hold the similarity."""
    def side(name: str) -> DataFrame:
        prefix = (_slack_column(F.col("n"), percent) + 1).cast("int")
        return sets.select(F.col("id").alias(name), F.col("n").alias(f"n_{name}"), F.col("tokens").alias(f"t_{name}"),
                           F.slice("tokens", 1, prefix).alias(f"up_{name}"), F.slice("tokens", -prefix, prefix).alias(f"down_{name}"))
    shared = F.size(F.array_intersect("t_a", "t_b"))
    return (pairs.join(side("a"), "a").join(side("b"), "b")
            .where(F.arrays_overlap("up_a", "up_b") & F.arrays_overlap("down_a", "down_b"))
            .withColumn("shared", shared.cast("bigint"))
            .where(F.col("shared") * 100 >= (F.col("n_a") + F.col("n_b") - F.col("shared")) * percent).select("a", "b"))


def _possible(a: str, b: str, percent: int) -> Column:
    """Length and position bounds of two posting entries."""
    n_a, n_b = F.col(f"{a}.n"), F.col(f"{b}.n")
    lengths = (n_a * 100 >= n_b * percent) & (n_b * 100 >= n_a * percent)
    return lengths & (F.least(n_a - F.col(f"{a}.at"), n_b - F.col(f"{b}.at")) >= _needed(n_a, n_b, percent))


def near_sets(documents: DataFrame, described: DataFrame, size: int, percent: int, depth: int) -> DataFrame:
    """Sets that can have a partner: ``(id, set_key, n, tokens)``, one row per class."""
    classes = (described.where("n > 0").groupBy("set_key")
               .agg(F.first("n").alias("n"), F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies")))
    classes = cut_lineage(classes.withColumn("owner", F.conv(F.hex(F.substring("set_key", 1, 8)), 16, -10).cast("bigint")))
    heads = documents.select("text").mapInArrow(lambda b: _first_tokens(size, percent, depth, b), "token long, owner long, weight int")
    # two rows a piece at most for one token: also a token in a third of all sets is a small share of its task
    token = W.partitionBy("token")
    smallest = F.ceil(F.col("n") * percent / 100)
    least = depth * _slack_column(smallest, percent) + 1
    met = (heads.withColumns({"lo": F.min("owner").over(token), "hi": F.max("owner").over(token)})
           .where("weight < 0 OR (lo != hi AND weight > 0)").groupBy("owner").agg(F.sum(F.abs("weight")).alias("met")))
    # copies emit the same rows; two classes under one short key both stay
    owners = classes.groupBy("owner").agg(F.sum("copies").alias("rows"), F.count(F.lit(1)).alias("n_classes"))
    left = (classes.join(owners, "owner").join(met, "owner")
            .where((F.col("met") >= least * F.col("rows")) | (F.col("n_classes") > 1)).select("doc_id", "set_key", "n"))
    left = cut_lineage(left)
    bitmap = hash_bitmap(left.select(F.xxhash64("doc_id").alias("hash")))
    kind = documents.schema["doc_id"].dataType.simpleString()
    whole = (documents.select("doc_id", F.xxhash64("doc_id").alias("hash"), "text")
             .mapInArrow(lambda b: _whole_sets(size, bitmap, b), f"doc_id {kind}, set_key binary, tokens array<long>"))
    return cut_lineage(whole.join(left.withColumnRenamed("doc_id", "_doc_id"), "set_key")
                       .where(F.col("doc_id").eqNullSafe(F.col("_doc_id"))).drop("_doc_id")
                       .dropDuplicates(["set_key"]).withColumn("id", F.monotonically_increasing_id()))


def postings(sets: DataFrame, percent: int) -> DataFrame:
    """Prefix tokens by rarity among ``sets``: ``(token, id, n, at)``; tokens of one set only are passed over."""
    tokens = sets.select("id", "n", F.explode("tokens").alias("token"))
    counts = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    ranked = (tokens.join(counts, "token").groupBy("id", "n")
              .agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("common")))
    alone = F.col("n") - F.size("common")
    room = F.greatest(_slack_column(F.col("n"), percent) + 1 - alone, F.lit(0)).cast("int")
    return (ranked.withColumn("alone", alone).withColumn("common", F.slice("common", 1, room))
            .select("id", "n", "alone", F.posexplode("common").alias("place", "entry"))
            .select(F.col("entry.token").alias("token"), "id", "n", (F.col("alone") + F.col("place")).alias("at")))


def set_components(documents: DataFrame, described: DataFrame, size: int, percent: int, depth: int) -> DataFrame:
    """``(set_key, component)`` of the classes that link with another class; a component is a number."""
    sets = near_sets(documents, described, size, percent, depth)
    lists = cut_lineage(postings(sets, percent))
    # written first: a join of two tables is one that skewed sides can be split in
    pivots = cut_lineage(lists.groupBy("token").agg(F.min(F.struct("at", "id", "n")).alias("p")).select("token", "p.*"))
    star = (lists.alias("x").join(pivots.alias("y"), "token").where((F.col("x.id") != F.col("y.id")) & _possible("x", "y", percent))
            .select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct())
    links = cut_lineage(_verified(star, sets, percent))
    found = components(links)

    named = lists.join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
    mixed = named.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo != hi").select("token")
    named = cut_lineage(named.join(mixed, "token"))
    largest = (named.groupBy("token", "component").agg(F.count(F.lit(1)).alias("c"))
               .groupBy("token").agg(F.max(F.struct("c", "component")).alias("m")).select("token", F.col("m.component").alias("major")))
    ranked = cut_lineage(named.join(largest, "token"))
    apart = ((F.col("x.component") != F.col("y.component"))
             & ((F.col("y.component") == F.col("x.major")) | (F.col("x.component") < F.col("y.component"))))
    rest = (ranked.where("component != major").alias("x").join(named.alias("y"), "token").where(apart & _possible("x", "y", percent))
            .select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct())
    more = cut_lineage(_verified(rest.join(star, ["a", "b"], "left_anti"), sets, percent))
    # links between components are rare: without any the components stand
    final = found if more.isEmpty() else components(links.unionByName(more))
    return sets.select("id", "set_key").join(final, "id").select("set_key", "component")


def _fresh(name: str, taken: list[str]) -> str:
    """A column name that is not taken."""
    while name in taken:
        name = f"_{name}"
    return name


def similar_groups(documents: DataFrame, size: int = 5, percent: int = 80, depth: int = 1) -> DataFrame:
    """Per document: its number of distinct shingles and the smallest id it is linked with, over any path.

    ``depth`` only moves work: a larger one ships more shingles in the first filter and lets
    fewer sets pass it, which pays for short shingles that many texts share.
    """
    kind = documents.schema["doc_id"].dataType.simpleString()
    docs = documents.select("doc_id", "text")
    described = cut_lineage(docs.mapInArrow(lambda b: _describe(size, b), f"doc_id {kind}, n long, set_key binary"))
    linked = set_components(docs, described, size, percent, depth)
    classes = described.where("n > 0").groupBy("set_key").agg(F.min("doc_id").alias("first_id")).join(linked, "set_key", "left")
    groups = classes.where("component is not null").groupBy("component").agg(F.min("first_id").alias("group_id"))
    named = classes.join(groups, "component", "left").select("set_key", F.coalesce("group_id", "first_id").alias("group_id"))
    return (described.join(named.withColumnRenamed("set_key", "_key"), (F.col("set_key") == F.col("_key")) & (F.col("n") > 0), "left")
            .select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("group_id", "doc_id").alias("component_id")))


def one_per_group(documents: DataFrame, size: int = 5, percent: int = 80, depth: int = 1) -> DataFrame:
    """The documents without those that are linked with one of a smaller id.

    A row is told by its id and its text, so a null id or one that stands on several texts decides for no
    other row. Of one group the smallest id stays, null last; of its equal rows under one id one stays.
    Rows without words are in no group and stay.
    """
    key = F.struct(F.col("doc_id").alias("doc_id"), F.md5(F.col("text")).alias("digest"))
    rows = cut_lineage(documents.select(key.alias("doc_id"), "text").mapInArrow(
        lambda b: _describe(size, b), f"doc_id struct<doc_id:{documents.schema['doc_id'].dataType.simpleString()},digest:string>, n long, set_key binary"))
    linked = set_components(documents.select(key.alias("doc_id"), "text"), rows, size, percent, depth)
    order = F.struct(F.col("doc_id.doc_id").isNull().alias("none"), F.col("doc_id").alias("key"))
    classes = rows.where("n > 0").groupBy("set_key").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("copies")).join(linked, "set_key", "left")
    # a row that is alone in its class and links with none stays unmarked; the other classes are written once, as they are read three times
    classes = cut_lineage(classes.where("copies > 1 OR component IS NOT NULL").drop("copies"))
    alone = classes.where("component IS NULL").select("set_key", "first")
    grouped = classes.where("component IS NOT NULL")
    named = grouped.join(grouped.groupBy("component").agg(F.min("first").alias("_best")), "component").select("set_key", F.col("_best").alias("first"))
    best = alone.unionByName(named).withColumnRenamed("set_key", "_key")
    marked = rows.where("n > 0").join(best, F.col("set_key") == F.col("_key")).select(
        F.col("doc_id.doc_id").alias("_id"), F.col("doc_id.digest").alias("_digest"), (F.col("doc_id") == F.col("first.key")).alias("stays"))
    marked = cut_lineage(marked.groupBy("_id", "_digest").agg(F.max("stays").alias("stays"), F.count(F.lit(1)).alias("copies")))

    own, doc_id, digest = (_fresh(name, documents.columns) for name in ("_text_digest", "_marked_id", "_marked_digest"))
    keyed = documents.withColumn(own, F.md5(F.col("text")))
    same = (F.col(own) == F.col(digest)) & F.col("doc_id").eqNullSafe(F.col(doc_id))
    named = marked.select("stays", "copies", F.col("_id").alias(doc_id), F.col("_digest").alias(digest))
    kept = keyed.join(named.where("NOT stays OR copies > 1").select(doc_id, digest), same, "left_anti")
    equal = keyed.join(named.where("stays AND copies > 1").select(doc_id, digest), same, "left_semi").dropDuplicates(["doc_id", own])
    return kept.unionByName(equal).select(*[F.col(f"`{c}`") for c in documents.columns])
