"""Near-duplicates by bottom-k sketches from one hash function.

1. Each text's set of distinct word shingles is hashed once; the ``K`` smallest
   values are its sketch.  Texts with equal sets are one class from here on,
   represented by the smallest id, so exact copies cost one row each and no pair.
2. Inverted lists of retained values generate candidates.  Two sets of Jaccard 0.8
   share about 0.8 K of the retained values and, but for a chance near 1e-6, at least
   half of them; so it is enough to list each class under the (half + 1) of its
   values that come first in one global order (prefix filtering).  The order puts
   values held by few classes first: a passage that thousands of otherwise different
   texts share fills no list.
3. Candidates are estimated by the bottom-k sketch of the union of both sets and
   dropped if the estimate lies over 4.5 standard errors below the threshold; what
   remains is verified exactly on the full sets of both texts.
4. No list is expanded into all its pairs.  First every class meets the head of its
   lists - the member with the fewest rarer values, as a near copy's origin has - and
   the best estimated pair of each class is verified: big groups of near copies become
   one component.  From then on only pairs across components can change anything.  In
   lists with at most ``ROUND`` members outside their largest component these members
   meet all others.  The members of other lists are listed anew, by their full sets:
   what a set has of rarer values than the shared one is missing in the other, and this
   exact bound leaves of a group of near copies only those that its origin links, which
   meet it next.  What is still across components then meets in rounds, each four times
   as large as the one before, dealt over blocks of the list's members.

Links only serve the components, so a pair inside a component is never needed; no
link between different components is lost but by the chance named above.

Nulls, empty texts and texts without words have an empty set and no link.  Ids may be
of any type that can be ordered; rows that share an id are judged each by its own text.
A row with a null id follows its class: it is never ``kept``, and its component is null
if no named document is in it.  Further columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweft.llm.bitfilter import bit_filter, packed_slices, packed_texts, unpacked
from docweft.llm.graphs import Labels
from docweft.llm.learning import map_texts
from docweft.llm.shared import hot_keys, spread_join, stored
from docweft.llm.textvec import distinct_sorted, flat, shingle_names, word_names, words

#: Retained values of a sketch.
K = 48
#: A value held by more classes comes after all others in the global order.
FREQUENT = 24
#: Members of a list, outside its largest component, that meet all others in one round.
ROUND = 32
#: Members of a list that one task meets with those whose turn it is.
BLOCK = 1024
#: Pairs of one class that meet its sketch or text in one task: a hub's is sent to several.
PART = 512


def shingle_sets(data: np.ndarray, offs: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, and each text's first."""
    found = words(data, offs, lower=True)
    return distinct_sorted(*shingle_names(word_names(found), found.first, width))


def _binary(values: np.ndarray, first: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(first) - 1, [None, pa.py_buffer((8 * first).astype(np.int32).tobytes()), pa.py_buffer(values.tobytes())])


def _unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, offs = flat(column)
    return np.frombuffer(data.tobytes(), np.uint64), offs // 8


def sketches(docs: DataFrame, width: int, k: int = K) -> DataFrame:
    """(doc_id, n_shingles, key_a, key_b, sketch) of every text; the keys name the set."""

    def kernel(data: np.ndarray, offs: np.ndarray) -> list[pa.Array]:
        name, first = shingle_sets(data, offs, width)
        n = np.diff(first)
        some = np.flatnonzero(n)
        keys = np.zeros((2, len(n)), dtype=np.uint64)
        if len(some):
            keys[0, some] = np.add.reduceat(name * np.uint64(0x9E3779B97F4A7C15), first[some])
            keys[1, some] = np.add.reduceat((name ^ (name >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93) ^ (name >> np.uint64(17)), first[some])
        take = np.minimum(n, k)
        out_first = np.concatenate([[0], np.cumsum(take)])
        low = name[np.arange(out_first[-1]) + np.repeat(first[:-1] - out_first[:-1], take)]
        return [pa.array(n), pa.array(keys[0].view(np.int64)), pa.array(keys[1].view(np.int64)), _binary(low, out_first)]

    fields = [T.StructField("n_shingles", T.LongType()), T.StructField("key_a", T.LongType()), T.StructField("key_b", T.LongType()), T.StructField("sketch", T.BinaryType())]
    return map_texts(docs.select("doc_id", F.col("text").cast("string").alias("text")), ["doc_id"], fields, kernel)


def _values(classes: DataFrame) -> DataFrame:
    """(value, rep) for every retained value of every class."""
    schema = T.StructType([T.StructField("value", T.LongType()), classes.schema["rep"]])

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value, first = _unpacked(batch.column("sketch"))
            rep = batch.column("rep").take(pa.array(np.repeat(np.arange(batch.num_rows), np.diff(first))))
            yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), rep], schema.names)

    return classes.select("rep", "sketch").mapInArrow(explode, schema)


def postings(classes: DataFrame) -> DataFrame:
    """(value, rep, n, at): each class under the values of its prefix in the global order, stored; ``at`` is the value's place there."""
    values = _values(classes)
    frequent = stored(values.groupBy("value").count().filter(F.col("count") > FREQUENT).select("value", F.col("count").alias("held_by")), "frequent")
    common = spread_join(values, frequent, "value", hot_keys(frequent, "value", "held_by"))
    of_class = common.groupBy("rep").agg(F.collect_list("value").alias("values"), F.collect_list("held_by").alias("held_by"))  # K entries at most
    joined = classes.select("rep", "n", "sketch").join(of_class, "rep", "left")
    schema = T.StructType([T.StructField("value", T.LongType()), classes.schema["rep"], classes.schema["n"], T.StructField("at", T.LongType())])

    def prefix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value, first = _unpacked(batch.column("sketch"))
            size = np.diff(first)
            row = np.repeat(np.arange(len(size)), size)
            rank = np.zeros(len(value), dtype=np.int64)
            seen = batch.column("values")
            if seen.null_count < len(seen):
                which = np.repeat(np.arange(len(size)), np.nan_to_num(seen.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64))
                known, held = seen.flatten().to_numpy().view(np.uint64), batch.column("held_by").flatten().to_numpy()
                at = np.lexsort((known, which))  # (row, value) pairs of both sides in one order
                both = np.concatenate([np.stack([which[at].astype(np.uint64), known[at]]), np.stack([row.astype(np.uint64), value])], axis=1)
                order = np.lexsort((np.arange(both.shape[1]), both[1], both[0]))
                same = np.zeros(both.shape[1], dtype=bool)
                same[1:] = (both[:, order[1:]] == both[:, order[:-1]]).all(axis=0)
                hit = np.flatnonzero(same & (order >= len(known)))
                rank[order[hit] - len(known)] = held[at][order[hit - 1]]
            order = np.lexsort((value, rank, row))
            place = np.arange(len(value)) - np.repeat(first[:-1], size)
            early = place < np.repeat(size - np.maximum(size // 2, 1) + 1, size)
            keep, own = order[early], pa.array(row[early])
            yield pa.RecordBatch.from_arrays([pa.array(value[keep].view(np.int64)), batch.column("rep").take(own), batch.column("n").take(own), pa.array(place[early])], schema.names)

    return stored(joined.mapInArrow(prefix, schema), "postings")


def _similar_size(a: str, b: str, percent: int):
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _met(pairs: DataFrame, rows: DataFrame, key: str, value: str) -> DataFrame:
    """(a, b, va, vb) of (stored) pairs: what ``rows`` has for both ends.

    An end of more than ``PART`` pairs that is hot has its row sent to as many tasks as its
    pairs need, so that no task has all pairs of a hub; there are at most a thousand such ends.
    """
    ends = pairs.select(F.col("a").alias("end")).unionByName(pairs.select(F.col("b").alias("end"))).groupBy("end").agg(F.count("*").alias("m"))
    hot = stored(hot_keys(stored(ends, "ends"), "end", "m").filter(F.col("m") > PART).select("end", F.ceil(F.col("m") / PART).alias("parts")), "hubs")

    def parts(frame: DataFrame, end: str, name: str) -> DataFrame:
        found = frame.join(F.broadcast(hot.select(F.col("end").alias("_end"), F.col("parts").alias(name))), F.col(end) == F.col("_end"), "left")
        return found.drop("_end").withColumn(name, F.coalesce(name, F.lit(1)))

    dealt = parts(parts(pairs.select("a", "b"), "a", "pa"), "b", "pb").withColumns({"pa": F.pmod(F.xxhash64("b"), "pa"), "pb": F.pmod(F.xxhash64("a"), "pb")})
    copies = parts(rows.select(key, value), key, "parts").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    left, right = (copies.select(F.col(key).alias(end), F.col("part").alias(f"p{end}"), F.col(value).alias(f"v{end}")) for end in ("a", "b"))
    return dealt.join(left, ["a", "pa"]).join(right, ["b", "pb"]).select("a", "b", "va", "vb")


def estimated(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """(a, b, estimate) of the pairs whose union sketch does not rule the threshold out."""
    joined = _met(stored(pairs.select("a", "b"), "met"), classes, "rep", "sketch")
    schema = T.StructType([pairs.schema["a"], pairs.schema["b"], T.StructField("estimate", T.DoubleType())])
    j = percent / 100

    def estimate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (va, fa), (vb, fb) = _unpacked(batch.column("va")), _unpacked(batch.column("vb"))
            na, nb = np.diff(fa), np.diff(fb)
            pair = np.concatenate([np.repeat(np.arange(len(na)), na), np.repeat(np.arange(len(nb)), nb)])
            value = np.concatenate([va, vb])
            order = np.lexsort((value, pair))
            value, pair = value[order], pair[order]
            fresh = np.ones(len(value), dtype=bool)
            fresh[1:] = (value[1:] != value[:-1]) | (pair[1:] != pair[:-1])
            both = np.zeros(len(value), dtype=bool)
            both[:-1] = ~fresh[1:]
            at = np.flatnonzero(fresh)
            owner, union = pair[at], np.bincount(pair[at], minlength=len(na))
            rank = np.arange(len(at)) - np.repeat(np.cumsum(union) - union, union)
            own_k = np.where(np.maximum(na, nb) < K, np.maximum(union, 1), K)  # two whole sets: the exact value
            shared = np.bincount(owner, weights=both[at] & (rank < own_k[owner]), minlength=len(na))
            exact = np.maximum(na, nb) < K
            score = shared / np.minimum(own_k, np.maximum(union, 1))
            ok = score >= np.where(exact, j - 1e-9, j - 4.5 * np.sqrt(j * (1 - j) / K))
            keep = np.flatnonzero(ok)
            yield pa.RecordBatch.from_arrays([batch.column("a").take(pa.array(keep)), batch.column("b").take(pa.array(keep)), pa.array(score[keep])], schema.names)

    return joined.mapInArrow(estimate, schema)


def _texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, packed) of the rows whose id a filter of ``ids`` lets through: no other text is shuffled, and those compressed."""
    source = docs.filter(F.col("doc_id").isNotNull()).select("doc_id", F.col("text").cast("string").alias("text"))
    return packed_texts(source, "doc_id", bit_filter(ids))


def verified(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(a, b) of the (stored) pairs with 100 |A & B| >= percent |A | B| on full sets, stored."""
    texts = stored(_texts_of(docs, pairs.select("a").union(pairs.select("b"))), "texts")
    joined = _met(pairs, texts, "doc_id", "packed")
    out = T.StructType([pairs.schema["a"], pairs.schema["b"]])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in packed_slices(batch, "va", "vb"):
                sets = []
                for c in ("va", "vb"):
                    sets.append(shingle_sets(*flat(unpacked(part.column(c))), width))
                (va, fa), (vb, fb) = sets
                na, nb = np.diff(fa), np.diff(fb)
                row = np.concatenate([np.repeat(np.arange(len(na)), na), np.repeat(np.arange(len(nb)), nb)])
                value = np.concatenate([va, vb])
                order = np.lexsort((value, row))
                value, row = value[order], row[order]
                same = (value[1:] == value[:-1]) & (row[1:] == row[:-1])
                shared = np.bincount(row[1:][same], minlength=len(na)) if len(value) else np.zeros(len(na), np.int64)
                union = na + nb - shared
                ok = (union > 0) & (100 * shared >= percent * union)
                keep = pa.array(np.flatnonzero(ok))
                yield pa.RecordBatch.from_arrays([part.column("a").take(keep), part.column("b").take(keep)], out.names)

    return stored(joined.mapInArrow(verify, out), "links")


def _heads(lists: DataFrame) -> DataFrame:
    """(value, a, na, at_a, m) of lists of two and more members (m): the member that has the least before the value, the smallest among equals."""
    heads = lists.groupBy("value").agg(F.min(F.struct("at", "rep", "n")).alias("head"), F.count("*").alias("m")).filter("m > 1")
    return heads.select("value", F.col("head.rep").alias("a"), F.col("head.n").alias("na"), F.col("head.at").alias("at_a"), "m")


def _with(lists: DataFrame, by_value: DataFrame, count: str = "m") -> DataFrame:
    """Lists joined with a (stored) table of one row a value, of which ``count`` has the members: a long list is dealt over all tasks."""
    return spread_join(lists, by_value, "value", hot_keys(by_value, "value", count))


class _Search:
    """Components of the links found so far."""

    def __init__(self, docs: DataFrame, classes: DataFrame, width: int, percent: int):
        self.docs, self.classes, self.width, self.percent = docs, classes, width, percent
        self.labels = Labels()

    def add(self, pairs: DataFrame) -> None:
        """Verify candidate pairs and take the links in."""
        pairs = stored(pairs.select("a", "b"), "candidates")
        if not pairs.isEmpty():
            self.labels.add(verified(pairs, self.docs, self.width, self.percent))

    def mixed(self, lists: DataFrame) -> DataFrame:
        """Members of the lists that span several components, with how many are outside of the list's largest one, its members, and a turn for each outside; stored."""
        member = stored(self.labels.of(lists.select("value", "rep", "n", "at"), "rep", "component"), "members")
        count = member.groupBy("value", "component").count()
        top = count.groupBy("value").agg(F.max(F.struct("count", "component")).alias("top"), F.sum("count").alias("m"))
        some = stored(top.select("value", F.col("top.component").alias("largest"), (F.col("m") - F.col("top.count")).alias("others"), "m").filter("others > 0"), "spanning")
        turn = F.when(F.col("component") != F.col("largest"), F.pmod(F.xxhash64("rep", "value"), F.ceil(F.col("others") / ROUND)))
        return stored(_with(member, some).withColumn("turn", turn).drop("largest"), "mixed")

    def still_mixed(self, mixed: DataFrame) -> DataFrame:
        """The same rows by the components of now, without lists that have become one."""
        member = stored(self.labels.of(mixed.drop("component"), "rep", "component"), "members")
        apart = member.groupBy("value").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("here")).filter("lo != hi").select("value", "here")
        return stored(_with(member, stored(apart, "apart"), "here").drop("here"), "mixed")

    def pairs(self, mixed: DataFrame, turns: tuple[int, int], placed: bool) -> DataFrame:
        """(a, b): the members outside their list's largest component whose turn it is, with all members of other components.

        A list's members are dealt into blocks, and those whose turn it is go to each block, so no task has a whole list.
        """
        blocks = F.ceil(F.col("m") / BLOCK).cast("int")
        mine = mixed.filter((F.col("turn") >= turns[0]) & (F.col("turn") < turns[1]))
        mine = mine.select("value", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), F.col("rep").alias("x"), F.col("n").alias("nx"), F.col("at").alias("px"), F.col("component").alias("cx"))
        others = mixed.select("value", F.pmod(F.xxhash64("rep"), blocks).cast("int").alias("block"), F.col("rep").alias("y"), F.col("n").alias("ny"), F.col("at").alias("py"), F.col("component").alias("cy"))
        fits = (F.col("cx") != F.col("cy")) & _similar_size("nx", "ny", self.percent)
        if placed:  # of two full sets, nothing before the first shared value is shared
            fits &= F.least(F.col("nx") - F.col("px"), F.col("ny") - F.col("py")) * (100 + self.percent) >= self.percent * (F.col("nx") + F.col("ny"))
        return mine.join(others, ["value", "block"]).filter(fits).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()

    def cross(self, lists: DataFrame, placed: bool) -> None:
        """Meet all members outside their list's largest component with all others.

        Each has its turn from the start, and each round takes four times as many turns, so the
        number of rounds grows with the logarithm of the longest list; what a round has linked
        needs no pair in the next.
        """
        lists = self.mixed(lists)
        turns = lists.agg(F.max("turn")).first()[0]
        at, many = 0, 1
        while turns is not None and at <= turns:
            self.add(estimated(self.pairs(lists, (at, at + many), placed), self.classes, self.percent))
            at, many = at + many, 4 * many
            if at <= turns:
                lists = self.still_mixed(lists)
                if lists.isEmpty():
                    return

    def full_lists(self, members: DataFrame) -> DataFrame:
        """(value, rep, n, at): exact inverted lists over the full sets of the given classes (rep).

        All values are in one order by how many of these classes hold them.  A set can
        only reach the threshold with another if they share a value among its first
        n - ceil(percent n / 100) + 1; values that it alone holds come first and fill places.
        """
        texts = _texts_of(self.docs, members.select("rep")).join(members.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")
        schema = T.StructType([T.StructField("value", T.LongType()), T.StructField("rep", texts.schema["doc_id"].dataType), T.StructField("n", T.LongType())])
        width = self.width

        def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in packed_slices(batch, "packed"):
                    name, first = shingle_sets(*flat(unpacked(part.column("packed"))), width)
                    n = np.diff(first)
                    yield pa.RecordBatch.from_arrays([pa.array(name.view(np.int64)), part.column("doc_id").take(pa.array(np.repeat(np.arange(len(n)), n))), pa.array(np.repeat(n, n))], schema.names)

        value = stored(texts.mapInArrow(values, schema), "values")
        common = stored(value.groupBy("value").count().filter("count > 1"), "common")
        own = _with(value, common, "count").groupBy("rep", "n").agg(F.sort_array(F.collect_list(F.struct("count", "value"))).alias("l"))
        placed = own.select("rep", "n", F.size("l").alias("m"), F.posexplode("l").alias("i", "v")).select(F.col("v.value").alias("value"), "rep", "n", (F.col("i") + F.col("n") - F.col("m")).alias("at"))
        return stored(placed.filter(F.col("at") < F.col("n") - F.ceil(F.lit(self.percent) * F.col("n") / 100) + 1), "full")

    def dense(self, members: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Exact lists of the full sets of classes from lists with many members outside the largest component, and the pairs of classes with a head of theirs."""
        lists = self.full_lists(members)
        least = stored(lists.groupBy("value").agg(F.min("n").alias("least"), F.count("*").alias("m")).filter("m > 1"), "least")
        smallest = F.greatest(F.col("least"), F.ceil(F.lit(self.percent) * F.col("n") / 100))
        fits = (F.col("n") - F.col("at")) * (100 + self.percent) >= self.percent * (F.col("n") + smallest)
        lists = stored(_with(lists, least).filter(fits).select("value", "rep", "n", "at"), "dense")
        met = _with(lists, stored(_heads(lists), "heads")).filter(F.col("rep") != F.col("a")).filter(_similar_size("n", "na", self.percent))
        near = met.groupBy(F.col("rep").alias("b")).agg(F.min_by("a", F.struct("at_a", "a")).alias("a"))
        return lists, near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs`` (doc_id, text); ids are of any type that can be ordered."""
    docs = docs.select("doc_id", "text")
    rows = stored(sketches(docs, width), "sketches")
    keys = ["key_a", "key_b", "n_shingles"]
    named = rows.filter("n_shingles > 0").groupBy(*keys).agg(F.min("doc_id").alias("rep"), F.first("sketch").alias("sketch"))  # equal sets, equal sketches
    named = stored(named, "classes")
    classes = named.filter("rep IS NOT NULL").select("rep", F.col("n_shingles").alias("n"), "sketch")
    lists = postings(classes)
    search = _Search(docs, classes, width, percent)
    heads = stored(_heads(lists), "heads")
    met = _with(lists, heads).filter(F.col("rep") != F.col("a")).filter(_similar_size("n", "na", percent)).select("a", F.col("rep").alias("b")).distinct()
    search.add(estimated(met, classes, percent).groupBy("b").agg(F.max_by("a", F.struct("estimate", "a")).alias("a")))
    mixed = search.mixed(_with(lists, heads.select("value", "m")))
    pairs = search.pairs(mixed.filter(F.col("others") <= ROUND), (0, 1), placed=False)
    many = stored(mixed.filter(F.col("others") > ROUND).select("rep").distinct(), "many")
    exact = None
    if not many.isEmpty():
        exact, near = search.dense(many)
        pairs = pairs.unionByName(near).distinct()
    search.add(estimated(pairs, classes, percent))
    if exact is not None:
        search.cross(exact, placed=True)
    final = search.labels.of(named.select(*keys, "rep"), "rep", "component_id").select(*keys, "component_id")
    out = rows.select("doc_id", *keys).join(final, keys, "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def deduplicated(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row of each group of near-duplicates, with all its columns: the one with the smallest id.

    A row with a null id counts as one with a very large id made of its text's hash, so
    it stays only where its group has no named document.  Of rows that share the kept id
    one stays.  Columns keep their names and order, whatever they are called.
    """
    kind = docs.schema["doc_id"].dataType
    if isinstance(kind, T.IntegralType):
        own, made = F.col("doc_id").cast("long"), F.lit(1 << 62) + F.xxhash64("text").bitwiseAND(F.lit((1 << 62) - 1))
    else:
        own, made = F.col("doc_id").cast("string"), F.concat(F.lit("\U0010ffff"), F.hex(F.xxhash64("text")))
    named = docs.withColumn("_docweft_id", F.coalesce(own, made))
    found = near_duplicates(named.select(F.col("_docweft_id").alias("doc_id"), "text"), width, percent)
    kept = found.filter("kept").select(F.col("doc_id").alias("_docweft_kept")).distinct()
    one = Window.partitionBy("_docweft_id").orderBy(F.xxhash64("text"))
    rows = named.join(kept, F.col("_docweft_id") == F.col("_docweft_kept")).withColumn("_docweft_row", F.row_number().over(one))
    return rows.filter("_docweft_row = 1").select(*docs.columns)
