"""Exact Jaccard self-join on word n-gram sets, and the components of its links.

Prefix filter with set relations.  Documents with one set form a class, which
joins once.  A set's elements have one order everywhere (hash order, elements of
many sets last); two sets that reach the threshold share an element of their
prefixes, so only prefix elements are listed.  A list is ordered by size block
and position: a probe leaves a block at the first position from which no element
can reach the needed overlap, and leaves the list at the first block that is too
large.  Candidates pass an exact bound (the parities of the hashed elements
differ in at most as many places as the sets do).  Of those that are left, each
set is compared once with the root of its group of candidates, and a pair's
answer derives from the two differences: x and y differ in exactly the elements
in which their differences from a third set differ.

Long lists are those of groups of similar sets.  There, only neighbours are laid
side by side.  The sets that these candidates connect form a group, whose centre
has the elements of most members.  With e(x) the elements in which x differs from
the centre, x and y link when

    (num + den) |e(x) ^ e(y)| <= (den - num) (|x| + |y|).

Let V(x) = (num + den) |e(x)| - (den - num) |x|.  Pairs of V(x) + V(y) <= 0 link
whatever their differences are, and then both link with the member of least V,
the hub, with which every member is compared.  All others share at least
(V(x) + V(y)) / (2 (num + den)) elements of their differences: a second prefix
filter, over differences ordered by how few members have them, finds these.
Members that edit their texts independently share hardly any, so a group of n near
copies costs about n pairs.  What remains of a long list meets across groups only.

Elements are 64-bit hashes of word n-grams (A-Z lowered), classes 128-bit
digests of their sorted sets; beyond that every step is exact.

Defined cases: null text, or one without words, has an empty set and is its own
component; fewer words than n make one element; repeated rows share a class; a
null identifier never names a component unless the whole component has none;
an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hygroflow.llm import tables
from hygroflow.llm import words as wd
from hygroflow.llm.components import components
from hygroflow.llm.tables import stored

#: A list is long beyond so many sets ...
LONG = 8
#: ... or beyond this share of all list entries, which bounds what is broadcast to 8 MB.
MOST_LONG = 1 << 20
#: Bits of the smallest parity sketch; a set has a power of two of them, one per element at least.
PARITIES = 64
#: Sets that are compared with one copy of their root, about.
ROOT_MEMBERS = 256
#: Ways in which a long list is dealt; the way depends on list and set.
SALT = 4

ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
    ELSE list_distinct(list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2])) END AS grams
  FROM w),
e AS (SELECT doc_id, len(grams) AS n, unnest(grams) AS gram FROM s),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM e a JOIN e b ON a.gram = b.gram AND a.doc_id < b.doc_id AND 10 * a.n >= 9 * b.n AND 10 * b.n >= 9 * a.n
  GROUP BY a.doc_id, b.doc_id, a.n, b.n
  HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
edges AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
reach AS (SELECT doc_id AS a, doc_id AS b FROM s UNION SELECT r.a, l.b FROM reach r JOIN edges l ON r.b = l.a)
SELECT s.doc_id, CAST(len(grams) AS BIGINT) AS n_shingles, c.component_id
FROM s JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) c USING (doc_id)
"""


class Rule:
    """Words per element and the similarity ``num / den``."""

    def __init__(self, words: int = 5, num: int = 80, den: int = 100):
        self.words, self.num, self.den = words, num, den

    def prefix(self, n: int) -> int:
        return n + 1 + (-self.num * n) // self.den

    def sizes_fit(self, a, b):
        return (self.den * a >= self.num * b) & (self.den * b >= self.num * a)


def _sets(texts: pa.Array, k: int):
    for _, h, bounds in wd.hashed(texts):
        for grams in wd.shingles(h, bounds, k):
            yield wd.distinct(grams)


def _digest(values: np.ndarray) -> bytes:
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest()


def _sketch(values: np.ndarray) -> np.ndarray:
    bits = max(PARITIES, 1 << (len(values) - 1).bit_length())
    odd = np.bincount((values >> np.uint64(20)).astype(np.int64) % bits, minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _lists(values: list[np.ndarray]) -> pa.Array:
    """List column of 64-bit values."""
    ends = np.cumsum([0] + [len(v) for v in values])
    flat = np.concatenate(values).view(np.int64) if values else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))


def _described(rule: Rule):
    """Set size, digest, prefix in hash order and parity sketch of every text."""

    def one(batch: pa.RecordBatch):
        sizes, digests, prefixes, sketches = [], [], [], []
        for s in _sets(batch["text"], rule.words):
            sizes.append(len(s))
            digests.append(_digest(s) if len(s) else None)
            prefixes.append(s[: rule.prefix(len(s))] if len(s) else s)
            sketches.append(_sketch(s) if len(s) else np.empty(0, np.int64))
        made = [pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), _lists(prefixes), _lists(sketches)]
        yield pa.RecordBatch.from_arrays(
            [batch["doc_id"], batch["text_key"], *made], ["doc_id", "text_key", "n", "set_id", "prefix", "sketch"]
        )

    return one


def _within(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are in a sorted array."""
    if not len(known):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return known[at] == values


def _reordered(rule: Rule, frequent):
    """Prefixes in the final order of those sets whose hash-order prefix has a frequent element."""

    def one(batch: pa.RecordBatch):
        digests, prefixes = [], []
        for s in _sets(batch["text"], rule.words):
            p = rule.prefix(len(s))
            if len(s) and _within(s[:p], frequent.value).any():
                often = _within(s, frequent.value)
                digests.append(_digest(s))
                prefixes.append(np.concatenate((s[~often][:p], s[often][:p]))[:p])
        yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), _lists(prefixes)], ["set_id", "prefix"])

    return one


def _entries(long, of_long: bool):
    """One list entry per prefix element, of the long lists or of the others."""

    def one(batch: pa.RecordBatch):
        lists = batch["prefix"]
        lengths = np.diff(lists.offsets.to_numpy())
        element = lists.flatten().to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(lengths)), lengths)
        first = np.cumsum(lengths) - lengths
        position = (np.arange(len(element)) - first[row]).astype(np.int32)
        kept = np.flatnonzero(_within(element.view(np.uint64), long.value) == of_long)
        at = pa.array(row[kept])
        yield pa.RecordBatch.from_arrays(
            [pa.array(element[kept]), pa.array(position[kept]), batch["n"].take(at), batch["cid"].take(at)],
            ["element", "position", "n", "cid"],
        )

    return one


def _list_pairs(rule: Rule):
    """Candidate pairs of lists that arrive ordered by (element, block, position)."""
    t = rule.num / (rule.num + rule.den)

    def pairs(element, block, n, position, cid):
        m = len(element)
        new = np.concatenate(([True], (element[1:] != element[:-1]) | (block[1:] != block[:-1])))
        heads = np.flatnonzero(new)
        number = np.cumsum(new) - 1  # of the block that each entry is in
        after = np.append(heads[1:], m)  # where each block ends
        low, high = np.minimum.reduceat(n, heads), np.maximum.reduceat(n, heads)
        probe, at = np.arange(m - 1), np.arange(1, m)
        while len(probe):
            b = number[at]
            going = (element[at] == element[probe]) & (rule.num * low[b] <= rule.den * n[probe])
            probe, at, b = probe[going], at[going], b[going]
            # from here on in this block, positions leave too few elements
            skip = position[at] > high[b] * (1 - t) - t * n[probe]
            need = rule.num * (n[probe] + n[at])
            left = 1 + np.minimum(n[probe] - position[probe], n[at] - position[at]) - 1
            ok = ~skip & rule.sizes_fit(n[probe], n[at]) & ((rule.num + rule.den) * left >= need)
            if ok.any():
                x, y = cid[probe[ok]], cid[at[ok]]
                apart = x != y
                yield np.minimum(x, y)[apart], np.maximum(x, y)[apart]
            at = np.where(skip, after[b], at + 1)
            inside = at < m
            probe, at = probe[inside], at[inside]

    def run(batches):
        held = None
        for batch in _with_end(batches):
            if batch is None:
                ready, held = held, None
            else:
                columns = [batch[c].to_numpy() for c in _COLUMNS]
                if held is not None:
                    columns = [np.concatenate(both) for both in zip(held, columns, strict=True)]
                cut = int(np.searchsorted(columns[0], columns[0][-1]))  # the last list may go on
                ready, held = [c[:cut] for c in columns], [c[cut:] for c in columns]
            if ready is None or len(ready[0]) < 2:
                continue
            same = ready[0][1:] == ready[0][:-1]
            shared = np.concatenate((same, [False])) | np.concatenate(([False], same))
            ready = [c[shared] for c in ready]
            if len(ready[0]):
                for a, b in pairs(*ready):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return run


_COLUMNS = ("element", "block", "n", "position", "cid")


def _with_end(batches):
    yield from (b for b in batches if b.num_rows)
    yield None


def _neighbours(batches):
    """Each entry of a long list with the one before it; the lists are never held."""
    last = None, None
    for batch in batches:
        a, b = [], []
        for e, c in zip(batch["element"].to_pylist(), batch["cid"].to_pylist(), strict=True):
            if last[0] == e and last[1] != c:
                a.append(min(last[1], c))
                b.append(max(last[1], c))
            last = e, c
        yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _apart(rule: Rule):
    """How each set differs from the set of its root, which comes first of its group."""

    def run(batches):
        group, leader, last = None, None, None
        for batch in batches:
            found = []
            columns = [batch[c].to_pylist() for c in ("root", "salt", "cid", "set_id")]
            for root, salt, cid, set_id, values in zip(*columns, _sets(batch["text"], rule.words), strict=True):
                # another text of the same name, or a repeated row
                if _digest(values) != set_id or (root, salt, cid) == last:
                    continue
                last = root, salt, cid
                if group != (root, salt):
                    group, leader = (root, salt), values
                if cid != root or salt == 0:
                    found.append((root, cid, len(values), np.setxor1d(leader, values, assume_unique=True).tobytes()))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array([f[i] for f in found], t) for i, t in enumerate(types)], ["root", "cid", "n", "differs"]
            )

    return run


def _elements(batch: pa.RecordBatch):
    """One row per element of a difference."""
    values = [np.frombuffer(v.as_buffer(), np.int64) for v in batch["differs"]]
    at = pa.array(np.repeat(np.arange(len(values)), [len(v) for v in values]))
    yield pa.RecordBatch.from_arrays(
        [batch["root"].take(at), batch["cid"].take(at), pa.array(np.concatenate(values))], ["root", "cid", "element"]
    )


def _from_centre(rule: Rule):
    """Differences from the centre out of those from the root, whose difference from the centre is ``common``."""

    def one(batch: pa.RecordBatch):
        sizes, differs = [], []
        for values, common in zip(batch["differs"], batch["common"].to_pylist(), strict=True):
            values = np.frombuffer(values.as_buffer(), np.uint64)
            if common:
                values = np.setxor1d(values, np.array(common, np.int64).view(np.uint64), assume_unique=True)
            sizes.append(len(values))
            differs.append(values.tobytes())
        n = batch["n"].to_numpy()
        v = (rule.num + rule.den) * np.array(sizes, np.int64) - (rule.den - rule.num) * n
        yield pa.RecordBatch.from_arrays(
            [batch["root"], batch["cid"], batch["n"], pa.array(sizes, pa.int64()), pa.array(v), pa.array(differs, pa.binary())],
            ["root", "cid", "n", "size", "v", "differs"],
        )

    return one


def _linked(rule: Rule):
    """Which pairs reach the similarity: what differs between two sets is what differs between their differences."""

    def one(batch: pa.RecordBatch):
        kept = []
        columns = [batch[c].to_pylist() for c in ("n_a", "n_b")]
        for n_a, n_b, x, y in zip(*columns, batch["differs_a"], batch["differs_b"], strict=True):
            x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
            both = int((_within(x, y) if len(x) < len(y) else _within(y, x)).sum())
            common = (n_a + n_b - (len(x) + len(y) - 2 * both)) // 2
            kept.append(rule.den * common >= rule.num * (n_a + n_b - common))
        yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], ["a", "b"]).filter(pa.array(kept, pa.bool_()))

    return one


def _folded(sketch: F.Column, other: F.Column) -> F.Column:
    """A sketch of twice the other's length as one of the same length; else as it is."""
    half = (F.size(sketch) / 2).cast("int")
    low, high = F.slice(sketch, 1, half), F.slice(sketch, half + 1, half)
    return F.when(F.size(sketch) > F.size(other), F.zip_with(low, high, lambda x, y: x.bitwiseXOR(y))).otherwise(sketch)


def _near(rule: Rule, a: str, b: str, na: str, nb: str) -> F.Column:
    """Whether so few parities differ that two sets can reach the similarity."""
    x, y = F.col(a), F.col(b)
    for _ in range(max(1, (rule.den - 1) // rule.num)):  # sizes that fit differ by den / num at most
        x, y = _folded(x, y), _folded(y, x)
    differing = F.zip_with(x, y, lambda v, w: F.bit_count(v.bitwiseXOR(w)))
    far = F.aggregate(differing, F.lit(0), lambda s, v: s + v)
    return (rule.num + rule.den) * far <= (rule.den - rule.num) * (F.col(na) + F.col(nb))


def _name(doc_id: str, text_key: str) -> F.Column:
    """Identifier and text together: rows that share an identifier, or have none, stay apart."""
    return F.concat_ws(":", F.coalesce(F.col(doc_id).cast("string"), F.lit("-")), F.col(text_key).cast("string")).alias("name")


class _Join:
    def __init__(self, docs: DataFrame, rule: Rule):
        self.rule, self.spark = rule, docs.sparkSession
        self.docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_key"))
        schema = "doc_id long, text_key long, n long, set_id binary, prefix array<long>, sketch array<long>"
        self.described = stored(tables.whole(self.docs, _described(rule), schema), "sets")
        self.classes = stored(
            self.described.where("n > 0")
            .groupBy("set_id")
            .agg(
                F.min("doc_id").alias("rep"),
                F.min(F.struct("doc_id", "text_key")).alias("member"),
                *[F.first(c).alias(c) for c in ("n", "prefix", "sketch")],
            )
            .withColumn("cid", F.monotonically_increasing_id()),
            "classes",
        )

    def _long(self, prefixes: DataFrame):
        """Elements of more than LONG prefixes; at most MOST_LONG of them, as each has its share of all entries."""
        counted = prefixes.select(F.explode("prefix").alias("element")).groupBy("element").count()
        entries = prefixes.agg(F.sum(F.size("prefix"))).first()[0] or 0
        rows = counted.where(F.col("count") > max(LONG, entries // MOST_LONG)).select("element").toArrow()
        found = np.sort(rows["element"].to_numpy().view(np.uint64))
        return self.spark.sparkContext.broadcast(found)

    def entries(self) -> tuple[DataFrame, DataFrame]:
        """Entries of ordinary lists and of long ones."""
        prefixes = self.classes.select("set_id", "cid", "n", "prefix")
        frequent = self._long(prefixes)
        none = self.spark.sparkContext.broadcast(np.empty(0, np.uint64))
        long = none
        if len(frequent.value):
            moved = tables.whole(self.docs, _reordered(self.rule, frequent), "set_id binary, prefix array<long>")
            moved = stored(moved.groupBy("set_id").agg(F.first("prefix").alias("new")), "prefixes")
            long = self._long(moved.select(F.col("new").alias("prefix")))
            prefixes = prefixes.join(moved, "set_id", "left").withColumn("prefix", F.coalesce("new", "prefix"))
        prefixes = prefixes.select("cid", "n", "prefix")
        schema = "element long, position int, n long, cid long"
        every = tables.whole(prefixes, _entries(long, False), schema)
        rare = tables.whole(prefixes, _entries(long, True), schema) if len(long.value) else None
        block = F.floor(F.log(F.col("n").cast("double")) / np.log(self.rule.den / self.rule.num)).cast("long")
        return every.withColumn("block", block), rare.withColumn("block", block) if rare is not None else None

    def close(self, pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) of classes that the sketches do not rule out."""
        about = self.classes.select("cid", "n", "sketch")
        pairs = pairs.distinct()
        for side in ("a", "b"):
            pairs = pairs.join(about.toDF(side, f"n_{side}", f"sketch_{side}"), side)
        near = pairs.where(_near(self.rule, "sketch_a", "sketch_b", "n_a", "n_b")).select("a", "b")
        return stored(near, "close-pairs")

    def derived(self, pairs: DataFrame, differs: DataFrame) -> DataFrame:
        """Those pairs that reach the similarity, out of the differences from a third set."""
        differs = differs.select("cid", "n", "differs")
        for side in ("a", "b"):
            pairs = pairs.join(differs.toDF(side, f"n_{side}", f"differs_{side}"), side)
        return tables.whole(pairs, _linked(self.rule), "a long, b long")

    def checked(self, pairs: DataFrame) -> DataFrame:
        close = self.close(pairs)
        return stored(self.derived(close, self._differences(close, components(close).toDF("cid", "root"))), "links")

    def _differences(self, close: DataFrame, roots: DataFrame) -> DataFrame:
        """Classes of close pairs and how their sets differ from the set of their group's root.

        The roots come from the close pairs alone, so most differences are small
        and derive each pair's answer without a second look at the sets.  A root
        goes to every part of a large group.
        """
        ids = close.select(F.explode(F.array("a", "b")).alias("cid")).distinct()
        needed = self.classes.select("cid", "set_id", _name("member.doc_id", "member.text_key")).join(ids, "cid")
        needed = needed.join(roots, "cid", "left")
        needed = stored(needed.withColumn("root", F.coalesce("root", "cid")), "needed")
        parts = needed.groupBy("root").agg((F.floor(F.count(F.lit(1)) / ROOT_MEMBERS) + 1).alias("parts"))
        salts = F.when(F.col("cid") == F.col("root"), F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).otherwise(
            F.array(F.pmod(F.xxhash64("cid"), F.col("parts")))
        )
        dealt = needed.join(parts, "root").select("cid", "set_id", "root", "name", F.explode(salts).alias("salt"))
        texts = self.docs.select(_name("doc_id", "text_key"), "text")
        texts = tables.possible(texts, "name", tables.bloom_words(needed.select("name"), "name"))
        grouped = texts.join(dealt, "name").repartition("root", "salt")
        order = ["root", "salt", F.col("cid") != F.col("root"), "cid"]
        sorted_rows = grouped.sortWithinPartitions(*order).select("root", "salt", "cid", "set_id", "text")
        return stored(sorted_rows.mapInArrow(_apart(self.rule), "root long, cid long, n long, differs binary"), "differences")

    def links(self) -> DataFrame:
        """Edges that connect every pair of linked classes, directly or through others."""
        every, rare = self.entries()
        dealt = every.repartition("element").sortWithinPartitions(*_COLUMNS[:2], "position")
        pairs = dealt.select(*_COLUMNS).mapInArrow(_list_pairs(self.rule), "a long, b long")
        if rare is None:
            return self.checked(pairs)
        rare = stored(rare, "long-lists")
        way = F.pmod(F.xxhash64("element", "cid"), F.lit(SALT))
        near = rare.repartition("element", way).sortWithinPartitions("element", way, "n", "cid")
        near = near.select("element", "cid").mapInArrow(_neighbours, "a long, b long")
        close = self.close(pairs.unionByName(near))
        groups = components(close).toDF("cid", "root")
        differs = self._differences(close, groups)
        found = stored(self.derived(close, differs), "links")
        rows = rare.join(groups.toDF("cid", "grp"), "cid", "left").withColumn("grp", F.coalesce("grp", "cid"))
        rows = stored(rows, "long-lists")
        inside, hubs = self._inside(differs.join(rows.select(F.col("grp").alias("root")).distinct(), "root", "left_semi"), found)
        found = found.unionByName(inside)
        found = found.unionByName(self.checked(self._to_hubs(rows, hubs)))
        return found.unionByName(self.checked(self._across(rows, components(found))))

    def _inside(self, differs: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Edges that connect all linked pairs of one group, and the groups' hubs."""
        rule, twice = self.rule, 2 * (self.rule.num + self.rule.den)
        one = "root long, cid long, element long"
        counts = tables.whole(differs, _elements, one).groupBy("root", "element").agg(F.count(F.lit(1)).alias("has"))
        most = counts.join(differs.groupBy("root").agg(F.count(F.lit(1)).alias("members")), "root")
        # at most twice the mean size of a group's differences
        common = most.where(2 * F.col("has") > F.col("members")).groupBy("root").agg(F.collect_list("element").alias("common"))
        schema = "root long, cid long, n long, size long, v long, differs binary"
        central = stored(tables.whole(differs.join(common, "root", "left"), _from_centre(rule), schema), "central")
        hubs = central.groupBy("root").agg(F.min_by(F.struct("cid", "n", "v", "differs"), F.struct("v", "cid")).alias("hub"))
        hubs = stored(hubs, "hubs")
        star = central.join(hubs, "root").where(F.col("cid") != F.col("hub.cid")).select(
            F.col("cid").alias("a"), F.col("hub.cid").alias("b"), F.col("n").alias("n_a"), F.col("hub.n").alias("n_b"),
            F.col("differs").alias("differs_a"), F.col("hub.differs").alias("differs_b"),
        )
        star = stored(tables.whole(star, _linked(rule), "a long, b long"), "links")

        known = components(found.unionByName(star)).toDF("cid", "comp")
        members = central.join(hubs.select("root", F.col("hub.cid").alias("hub"), F.col("hub.v").alias("least")), "root")
        members = members.join(known, "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
        members = members.join(known.toDF("hub", "main"), "hub", "left").withColumn("main", F.coalesce("main", "hub"))
        # the least V of a partner in another component: the hub's, or more than links with the hub
        partner = F.when(F.col("v") + F.col("least") <= 0, 1 - F.col("least")).otherwise(F.col("least"))
        need = F.greatest(F.lit(1), F.ceil((F.col("v") + partner) / twice))
        members = members.select("root", "cid", "n", "size", "v", "comp", "main", (F.col("size") - need + 1).alias("prefix"))
        elements = tables.whole(central, _elements, one)
        has = elements.groupBy("root", "element").agg(F.count(F.lit(1)).alias("has"))
        order = Window.partitionBy("cid").orderBy("has", "element")
        elements = elements.join(has, ["root", "element"]).withColumn("position", F.row_number().over(order) - 1)
        lists = elements.where("has > 1").join(members, ["root", "cid"]).where("position < prefix")
        lists = stored(lists.select("root", "element", "cid", "n", "size", "v", "comp", "main", "position"), "difference-lists")
        outside = lists.where("comp <> main").select(
            "root", "element", *[F.col(c).alias(f"{c}_x") for c in ("cid", "n", "size", "v", "comp", "position")]
        )
        left = F.least(F.col("size") - F.col("position"), F.col("size_x") - F.col("position_x"))
        met = outside.join(lists, ["root", "element"]).where(
            (F.col("comp") != F.col("comp_x"))
            & rule.sizes_fit(F.col("n"), F.col("n_x"))
            & (twice * left >= F.col("v") + F.col("v_x"))
        )
        met = met.select(F.least("cid", "cid_x").alias("a"), F.greatest("cid", "cid_x").alias("b")).distinct()
        return star.unionByName(stored(self.derived(stored(met, "met"), central), "links")), hubs

    @staticmethod
    def _outside(rows: DataFrame) -> DataFrame:
        """Entries of long lists outside the list's largest group."""
        sums = rows.groupBy("element", "grp").count()
        main = sums.groupBy("element").agg(
            F.max_by("grp", F.struct("count", "grp")).alias("main"), F.count(F.lit(1)).alias("groups")
        )
        return rows.join(main.where("groups > 1").select("element", "main"), "element").where("grp <> main")

    def _to_hubs(self, rows: DataFrame, hubs: DataFrame) -> DataFrame:
        """Each set outside a long list's largest group with that group's hub."""
        hubs = hubs.select(F.col("root").alias("main"), F.col("hub.cid").alias("hub"))
        met = self._outside(rows).select("cid", "main").distinct().join(hubs, "main", "left")
        hub = F.coalesce("hub", "main")
        return met.where(hub != F.col("cid")).select(F.least("cid", hub).alias("a"), F.greatest("cid", hub).alias("b"))

    def _across(self, rows: DataFrame, known: DataFrame) -> DataFrame:
        """Pairs of a long list, of two groups that no known link connects.

        Of each list and size block, the entries outside its largest group
        meet the entries of that block and of the next ones that can fit.
        """
        rule = self.rule
        rows = rows.join(known.toDF("cid", "root"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
        rows = stored(rows.join(self.classes.select("cid", "sketch"), "cid"), "long-lists")
        minor = self._outside(rows).select(
            "element", F.explode(F.array(F.col("block") - 1, F.col("block"), F.col("block") + 1)).alias("block"),
            *[F.col(c).alias(f"{c}_x") for c in ("cid", "n", "position", "root", "grp", "sketch")],
        )
        left = F.least(F.col("n") - F.col("position"), F.col("n_x") - F.col("position_x"))
        total = F.col("n") + F.col("n_x")
        met = minor.join(rows, ["element", "block"]).where(
            (F.col("root") != F.col("root_x"))
            & (F.col("grp") != F.col("grp_x"))
            & rule.sizes_fit(F.col("n"), F.col("n_x"))
            & ((rule.num + rule.den) * left >= rule.num * total)
            & _near(rule, "sketch", "sketch_x", "n", "n_x")
        )
        return met.select(F.least("cid", "cid_x").alias("a"), F.greatest("cid", "cid_x").alias("b"))

    def grouped(self) -> DataFrame:
        roots = components(self.links()).toDF("cid", "root")
        named = self.classes.select("set_id", "cid", "rep").join(roots, "cid", "left")
        named = named.withColumn("root", F.coalesce("root", "cid"))
        least = named.groupBy("root").agg(F.min("rep").alias("component_id"))
        of_set = named.join(least, "root").select("set_id", "component_id")
        docs = self.described.select("doc_id", F.col("n").alias("n_shingles"), "set_id")
        return docs.join(of_set, "set_id", "left").select(
            "doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")
        )


def similar_groups(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``docs`` (doc_id, text): doc_id, n_shingles, component_id.

    All steps that need Python are stored on the way, in batches of few bytes.
    """
    with tables.small_batches(docs.sparkSession):
        return _Join(docs, Rule(words, num, den)).grouped()


def query(spark: SparkSession, folder: str) -> DataFrame:
    return similar_groups(tables.read(spark, folder, "documents", "doc_id", "text"), words=3, num=90)
