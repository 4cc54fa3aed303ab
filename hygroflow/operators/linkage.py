"""Record linkage of two name lists, blocked on the first characters.

The definition compares every pair inside a block; ``candidates`` builds these
pairs.  A block can hold a third of all names, so the matches are found without
enumerating them.  With the default weights a pair below 990 characters reaches the threshold only if one name contains the other
or the acronym test holds (see ``long_limit``), which leaves three exact sources:

* containment is an equality: a stretch of the longer name that starts with the
  block key and has the length of some name in the other list's block is a join
  key for the shorter name,
* "acronym equals name" is an equality as well,
* names with the same acronym are compared inside tiles of bounded size with an
  upper bound before every costly comparison; nothing but results leaves a tile.

Names are compared once per normalised form, so copies cost nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from hygroflow.functions import text
from hygroflow.functions.rounding import round_exact
from hygroflow.functions.similarity import jaro_winkler, token_set_ratio
from hygroflow.settings import MatchRule

TILE = 1000
BUNDLE = 5000
DIGITS = 4
_SIGNS = 64


def long_limit(rule: MatchRule) -> int:
    """Length below which a match needs containment or an acronym.

    Without both, token and Jaro-Winkler similarity must reach the threshold
    alone.  With the default weights Jaro-Winkler has to be 0.9998, hence Jaro
    0.99966 (four equal leading characters close 40 % of the distance): at most
    one character in a thousand unmatched or out of place.  Shorter names that
    close are equal, and equal names contain each other.  Other weights give
    other limits, down to 0, where all names of a block meet in tiles.
    """
    w = rule.weights
    needed = (rule.threshold - 0.5 * 10.0**-DIGITS - w["token"]) / w["char"]
    share = 3 * (1 - needed) / 0.6
    never = 2**31 - 1
    return min(max(0, int(1 / share) - 10), never) if share > 0 else never


# -- preparation -----------------------------------------------------------------
def prepared(names: DataFrame, rule: MatchRule = MatchRule()) -> DataFrame:
    """(raw, norm, acr, block) of a one-column name table."""
    raw = F.col(f"`{names.columns[0]}`").cast("string")
    return (
        names.select(raw.alias("raw"))
        .withColumn("norm", text.normalized(F.col("raw")))
        .withColumn("acr", text.acronym(F.col("norm")))
        .withColumn("block", text.block_key(F.col("norm"), rule.block_chars))
    )


def forms(rows: DataFrame) -> DataFrame:
    """One row per normalised name with its smallest spelling and number of rows.

    Empty forms go: two of them score 0.45, and they share a block only with
    each other.
    """
    return (
        rows.where(F.col("norm") != "")
        .groupBy("norm", "acr", "block")
        .agg(F.min("raw").alias("name"), F.count(F.lit(1)).alias("n_rows"))
    )


def _meet(left: DataFrame, right: DataFrame, on: str | list[str]) -> DataFrame:
    """Join by sorting both sides.

    Names and hashes grow with the lists, and their files are far smaller than
    their rows, so a broadcast chosen by size would fill the driver.
    """
    return left.join(right.hint("merge"), on)


def _dealt(
    left: DataFrame, right: DataFrame, on: list[str], by: list[str], size: int
) -> tuple[DataFrame, DataFrame]:
    """Both sides with tile numbers (i, j): at most about ``size`` rows of a side per group of ``on`` and tile.

    Every row of a group lands in one slice of its side, told by ``by``, and is
    repeated once per slice of the other side, so each pair of the group meets
    in one tile.
    """
    n_a = left.groupBy(*on).agg(F.count(F.lit(1)).alias("n_a"))
    n_b = right.groupBy(*on).agg(F.count(F.lit(1)).alias("n_b"))
    sizes = _meet(n_a, n_b, on).select(
        *on, F.ceil(F.col("n_a") / size).alias("t_a"), F.ceil(F.col("n_b") / size).alias("t_b")
    )

    def placed(rows: DataFrame, own: str, other: str, own_no: str, other_no: str) -> DataFrame:
        return (
            _meet(rows, sizes, on)
            .withColumn(own_no, F.pmod(F.xxhash64(*by), F.col(own)))
            .withColumn(other_no, F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1)))
        )

    return placed(left, "t_a", "t_b", "i", "j"), placed(right, "t_b", "t_a", "j", "i")


def candidates(a: DataFrame, b: DataFrame, size: int = TILE) -> DataFrame:
    """(block, raw_a, copy_a, raw_b, copy_b): every pair of rows with a common block.

    A join on the block alone would put all pairs of a heavy block into one
    task, so blocks are dealt into tiles.  Rows that repeat a spelling are told
    apart by their copy.
    """

    def numbered(rows: DataFrame) -> DataFrame:
        rows = rows.groupBy("block", "raw").agg(F.count(F.lit(1)).alias("n_rows"))
        return rows.select("block", "raw", F.explode(F.sequence(F.lit(1).cast("long"), "n_rows")).alias("copy"))

    left, right = _dealt(numbered(a), numbered(b), ["block"], ["raw", "copy"], size)
    on = ["block", "i", "j"]
    # tiles are few bytes and many pairs, so they are not put together by size
    parts = int(a.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left = left.select(*on, F.col("raw").alias("raw_a"), F.col("copy").alias("copy_a")).repartition(parts, *on)
    right = right.select(*on, F.col("raw").alias("raw_b"), F.col("copy").alias("copy_b")).repartition(parts, *on)
    return _meet(left, right, on).drop("i", "j")


def block_sizes(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows and pairs per common block, counted over the candidates."""
    return candidates(a, b).groupBy("block").agg(
        F.count_distinct("raw_a", "copy_a").alias("n_a"),
        F.count_distinct("raw_b", "copy_b").alias("n_b"),
        F.count(F.lit(1)).alias("n_pairs"),
    )


# -- equality sources ---------------------------------------------------------------
def name_lengths(rows: DataFrame) -> DataFrame:
    """The lengths that occur among the names of each block; their number is bounded by the longest name."""
    return rows.groupBy("block").agg(F.collect_set(F.length("norm")).alias("lengths"))


def _stretches(longer: DataFrame, shorter: DataFrame) -> DataFrame:
    """(id, key): hashes of the stretches of each name that a name of the other list can equal.

    Such a stretch starts with the block key and has a length that occurs in the
    other list's block.  Places and lengths are laid out one after the other, so
    no row carries all stretches of a name.
    """
    size = F.length("block")
    places = F.filter(
        F.sequence(F.lit(1), F.length("norm") - size + 1), lambda p: F.substr("norm", p, size) == F.col("block")
    )
    starts = _meet(longer, name_lengths(shorter), "block").select(
        F.xxhash64("norm").alias("id"), "norm", "lengths", F.explode(places).alias("place")
    )
    fitting = F.filter("lengths", lambda n: n <= F.length("norm") - F.col("place") + 1)
    return starts.select("id", "norm", "place", F.explode(fitting).alias("length")).select(
        "id", F.xxhash64(F.substr("norm", F.col("place"), F.col("length"))).alias("key")
    )


def _held_in(longer: DataFrame, shorter: DataFrame, longer_as: str, shorter_as: str) -> DataFrame:
    """Pairs in which the first name holds the second.

    Only two numbers per stretch are shuffled.  The texts come back for the
    hits and settle them, so a hash collision cannot add a pair.
    """
    number = F.xxhash64("norm")
    short = shorter.select(F.col("norm").alias(shorter_as), "block", number.alias("key"))
    hits = _meet(_stretches(longer, shorter), short, "key").select("id", shorter_as, "block")
    long = longer.select(F.col("norm").alias(longer_as), "block", number.alias("id"))
    return _meet(hits, long, ["id", "block"]).where(F.contains(F.col(longer_as), F.col(shorter_as)))


def equality_pairs(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs with containment, or with the acronym of one being the other name."""
    pair = ["norm_a", "norm_b"]
    inside = _held_in(a, b, "norm_a", "norm_b").select(*pair).unionByName(
        _held_in(b, a, "norm_b", "norm_a").select(*pair)
    )

    def keyed(rows: DataFrame, name: str, key: str) -> DataFrame:
        return rows.select(F.col("norm").alias(name), F.col(key).alias("key"), "block")

    on = ["key", "block"]
    as_name = (
        _meet(keyed(a, "norm_a", "acr"), keyed(b, "norm_b", "norm"), on)
        .select(*pair)
        .unionByName(_meet(keyed(b, "norm_b", "acr"), keyed(a, "norm_a", "norm"), on).select(*pair))
    )
    return inside.unionByName(as_name).distinct()


_PARTS = StructType([StructField("token", DoubleType()), StructField("char", DoubleType())])


@F.pandas_udf(_PARTS)
def similarities(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    """Token-set (0..1) and Jaro-Winkler similarity of two columns."""
    for left, right in batches:
        yield pd.DataFrame(
            {
                "token": [token_set_ratio(x, y) / 100 for x, y in zip(left, right)],
                "char": [jaro_winkler(x, y) for x, y in zip(left, right)],
            }
        )


# a filter on its result must not make it run again below a distinct
similarities = similarities.asNondeterministic()


def with_parts(pairs: DataFrame) -> DataFrame:
    """Add the four parts of the score to (norm_a, norm_b)."""
    a, b = F.col("norm_a"), F.col("norm_b")
    agree = text.acronyms_agree(a, b, text.acronym(a), text.acronym(b))
    return (
        pairs.withColumn("_s", similarities(a, b))
        .withColumn("contain", text.containment(a, b))
        .withColumn("acronym", F.when(agree, 1.0).otherwise(0.0))
        .select(*pairs.columns, F.col("_s.token").alias("token"), F.col("_s.char").alias("char"), "contain", "acronym")
    )


def score(rule: MatchRule) -> Column:
    """Weighted sum of the parts at four places."""
    w = rule.weights
    total = (
        w["token"] * F.col("token")
        + w["char"] * F.col("char")
        + w["contain"] * F.col("contain")
        + w["acronym"] * F.col("acronym")
    )
    return round_exact(total, DIGITS)


# -- tiles ---------------------------------------------------------------------------
def _grouped(rows: DataFrame, rule: MatchRule) -> DataFrame:
    """Comparison groups of every name: its acronym, and the long names of its block."""
    groups = F.array_compact(
        F.array(
            F.struct(F.lit("acr").alias("kind"), F.col("acr").alias("label")),
            F.when(
                F.length("norm") >= long_limit(rule), F.struct(F.lit("long").alias("kind"), F.lit("").alias("label"))
            ),
        )
    )
    return rows.select("norm", "acr", "block", "name", F.inline(groups))


GROUP = ["block", "kind", "label"]


def tiles(
    a: DataFrame, b: DataFrame, rule: MatchRule = MatchRule(), size: int = TILE
) -> tuple[DataFrame, DataFrame]:
    """Both sides with tile numbers (i, j): at most about ``size`` names of a side per tile."""
    left, right = _dealt(_grouped(a, rule), _grouped(b, rule), GROUP, ["norm"], size)
    columns = [*GROUP, "i", "j", "norm", "acr", "name"]
    return left.select(*columns), right.select(*columns)


class _Names:
    """The names of one side of a bundle: lengths, character counts and words, and the rows of each tile.

    Characters are counted in ``_SIGNS`` classes; a shared class can only raise
    the number of common characters, so bounds stay bounds.
    """

    def __init__(self, rows: pd.DataFrame):
        self.norm, self.acr, self.name = rows["norm"].tolist(), rows["acr"].tolist(), rows["name"].tolist()
        self.size = np.array([len(s) for s in self.norm], np.int32)
        self.signs = np.zeros((len(self.norm), _SIGNS), np.int32)
        for i, s in enumerate(self.norm):
            codes = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), "<u4")
            self.signs[i] = np.bincount(codes % _SIGNS, minlength=_SIGNS)
        self.words = [set(s.split()) for s in self.norm]
        # repeated words are dropped before the token ratio, which can only shorten the texts
        self.repeats = np.array([len(w) < len(s.split()) for w, s in zip(self.words, self.norm)], bool)
        self.tiles: dict[tuple, list[int]] = {}
        for i, key in enumerate(rows[[*GROUP, "i", "j"]].itertuples(index=False, name=None)):
            self.tiles.setdefault(key, []).append(i)


def _upper_bounds(a: _Names, b: _Names, left: list[int], right: list[int], weights: dict, acronym: np.ndarray) -> np.ndarray:
    """No pair of the tile (without containment) scores above its entry.

    Common characters limit both Jaro and the in-order matches of the token
    ratio; a shared word makes a full token ratio possible.
    """
    common = np.zeros((len(left), len(right)), np.int32)
    in_a, in_b = a.signs[left], b.signs[right]
    for sign in np.flatnonzero(in_a.any(0) & in_b.any(0)):
        common += np.minimum.outer(in_a[:, sign], in_b[:, sign])
    size_a, size_b = a.size[left][:, None], b.size[right][None, :]
    jaro = np.where(common > 0, (common / size_a + common / size_b + 1) / 3, 0.0)
    char = np.where(jaro > 0.7, jaro + 0.4 * (1 - jaro), jaro)
    token = np.minimum(1.0, 2.0 * common / np.maximum(1, size_a + size_b))
    token[a.repeats[left], :] = 1.0
    token[:, b.repeats[right]] = 1.0
    places: dict[str, list[int]] = {}
    for k, r in enumerate(right):
        for word in b.words[r]:
            places.setdefault(word, []).append(k)
    for i, r in enumerate(left):
        for word in a.words[r]:
            if word in places:
                token[i, places[word]] = 1.0
    return weights["token"] * token + weights["char"] * char + weights["acronym"] * acronym


def _tile_matches(a: _Names, b: _Names, left: list[int], right: list[int], rule: MatchRule, best_only: bool) -> list[tuple]:
    """Matches inside one tile; pairs from the equality sources are left to them."""
    w, found = rule.weights, []
    agree = np.array([[a.acr[i] == b.acr[j] for j in right] for i in left], float)
    bounds = _upper_bounds(a, b, left, right, w, agree)
    for row, i in enumerate(left):
        norm, acr, best = a.norm[i], a.acr[i], None
        for column in np.argsort(-bounds[row], kind="stable"):
            floor = rule.threshold if best is None else best[0]
            if bounds[row, column] < floor - 1e-4:  # rounding moves a score by half of that
                break
            j = right[column]
            other = b.norm[j]
            if norm in other or other in norm or acr == other or b.acr[j] == norm:
                continue
            total = (
                w["token"] * token_set_ratio(norm, other) / 100
                + w["char"] * jaro_winkler(norm, other)
                + w["acronym"] * agree[row, column]
            )
            rounded = round(float(total), DIGITS)
            if rounded < rule.threshold:
                continue
            if not best_only:
                found.append((norm, other, rounded))
            elif best is None or (-rounded, b.name[j]) < (-best[0], best[1]):
                best = (rounded, b.name[j], other)
        if best is not None:
            found.append((norm, best[2], best[0]))
    return found


def tile_matches(
    a: DataFrame, b: DataFrame, rule: MatchRule = MatchRule(), best_only: bool = True, size: int = TILE
) -> DataFrame:
    """Matches of all tiles.  Most groups are a few names, so tiles travel in bundles of about ``BUNDLE`` rows."""
    left, right = tiles(a, b, rule, size)
    bundles = 1 + (a.count() + b.count()) // BUNDLE
    bundle = F.pmod(F.xxhash64(*GROUP, "i", "j"), F.lit(bundles)).alias("bundle")
    left, right = left.select(bundle, "*"), right.select(bundle, "*")

    def compare(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        ours, theirs, found = _Names(x), _Names(y), []
        for key, rows in ours.tiles.items():
            if key in theirs.tiles:
                found += _tile_matches(ours, theirs, rows, theirs.tiles[key], rule, best_only)
        return pd.DataFrame(found, columns=["norm_a", "norm_b", "score"])

    return (
        left.groupBy("bundle")
        .cogroup(right.groupBy("bundle"))
        .applyInPandas(compare, "norm_a string, norm_b string, score double")
    )


# -- results --------------------------------------------------------------------------
def form_matches(
    a: DataFrame, b: DataFrame, rule: MatchRule = MatchRule(), best_only: bool = True
) -> DataFrame:
    """(norm_a, norm_b, score) at or above the threshold.

    With ``best_only`` a tile keeps its best partner per left name, which is
    all the final choice can need; otherwise every match is returned.
    """
    equal = (
        with_parts(equality_pairs(a, b))
        .withColumn("score", score(rule))
        .where(F.col("score") >= rule.threshold)
        .select("norm_a", "norm_b", "score")
    )
    # a long pair with equal acronyms meets in two groups
    return equal.unionByName(tile_matches(a, b, rule, best_only)).distinct()


def related_pairs(a: DataFrame, b: DataFrame, rule: MatchRule = MatchRule()) -> DataFrame:
    """(norm_a, norm_b) that match, hold each other, or of which one is the other's acronym, whatever they score."""
    matching = tile_matches(a, b, rule, best_only=False).select("norm_a", "norm_b")
    return equality_pairs(a, b).unionByName(matching).distinct()


def match_scored(a: DataFrame, b: DataFrame, rule: MatchRule = MatchRule()) -> DataFrame:
    """All matching forms with the number of rows behind them."""
    rows_a = a.select(F.col("norm").alias("norm_a"), F.col("n_rows").alias("n_rows_a"))
    rows_b = b.select(F.col("norm").alias("norm_b"), F.col("n_rows").alias("n_rows_b"))
    found = _meet(form_matches(a, b, rule, best_only=False), rows_a, "norm_a")
    return _meet(found, rows_b, "norm_b").select("norm_a", "norm_b", "n_rows_a", "n_rows_b", "score")


def match_rows(rows_a: DataFrame, rows_b: DataFrame, matches: DataFrame) -> DataFrame:
    """Matching spellings with the four parts and the score.

    ``matches`` (norm_a, norm_b, score) are the matching forms; the parts are
    computed once per pair of forms and spread over their spellings.
    """
    parts = with_parts(matches.select("norm_a", "norm_b", "score"))
    left = rows_a.select(F.col("raw").alias("company_a"), F.col("norm").alias("norm_a"))
    right = rows_b.select(F.col("raw").alias("company_b"), F.col("norm").alias("norm_b"))
    return _meet(_meet(parts, left, "norm_a"), right, "norm_b").select(
        "company_a", "company_b", "token", "char", "contain", "acronym", "score"
    )


def match_best(
    rows_a: DataFrame, a: DataFrame, b: DataFrame, rule: MatchRule = MatchRule()
) -> DataFrame:
    """Best partner of every left name; equal scores go to the first name in order.

    ``a`` and ``b`` are the forms of both lists.  They are read several times,
    so store them first; ``rows_a`` brings the winners back to all spellings.
    """
    winner = (
        _meet(form_matches(a, b, rule), b.select(F.col("norm").alias("norm_b"), "name"), "norm_b")
        .groupBy("norm_a")
        .agg(F.min(F.struct((-F.col("score")).alias("down"), F.col("name"))).alias("m"))
        .select("norm_a", F.col("m.name").alias("company_b"), (-F.col("m.down")).alias("score"))
    )
    spelled = rows_a.select(F.col("raw").alias("company_a"), F.col("norm").alias("norm_a")).distinct()
    return _meet(spelled, winner, "norm_a").select("company_a", "company_b", "score")
