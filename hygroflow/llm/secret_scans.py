"""Secrets in whole texts: fixed patterns, and a battery of randomness tests.

Assignments, access keys and hexadecimal runs are found by pattern.  Besides,
each run of key-like characters is a candidate: its encoding is inferred from the
characters it uses, and tests on the symbols of that encoding ask two questions.
Is it compatible with uniform random symbols (chi-squared uniformity, runs about
the median, serial correlation)?  And could ordinary text or an identifier look
as even, and change between letters, cases and digits as often (tails of the
chi-squared and of the run statistic under such a model, combined by Fisher's
method)?  The second answer is a p-value for each candidate; the false discovery
rate is controlled within classes of equal length, because short candidates carry
less evidence.  The control counts p-values in fixed bins, so that only a table
of bins is ordered.  All of it is column expressions.

Defined cases: null text is empty and has no spans; repeated rows give repeated
results; empty tables give no rows; added spans that overlap a pattern's span
are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hygroflow.llm.tables import read, stored

#: Kinds in their order, and their patterns.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
ASSIGN_LEAST = 12
#: A candidate of the randomness tests.
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}"

#: Encodings from the narrowest: name, characters, their order, and how likely two
#: characters of ordinary text in this encoding are equal.
LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
ENCODINGS = (
    ("hex", "^[0-9a-f]+$", DIGITS + "abcdef", 0.12),
    ("HEX", "^[0-9A-F]+$", DIGITS + "ABCDEF", 0.12),
    ("base32", "^[A-Z2-7]+$", UPPER + "234567", 0.066),
    ("base36", "^[a-z0-9]+$", LOWER + DIGITS, 0.062),
    ("base62", "^[A-Za-z0-9]+$", UPPER + LOWER + DIGITS, 0.055),
    ("base64", "^[A-Za-z0-9+/]+$", UPPER + LOWER + DIGITS + "+/", 0.055),
    ("base64url", "^[A-Za-z0-9_-]+$", UPPER + LOWER + DIGITS + "-_", 0.055),
    ("mixed", ".*", UPPER + LOWER + DIGITS + "+/-_", 0.055),
)
#: Share of neighbouring characters of an identifier that differ in class.
CHANGES = 0.12
#: A test statistic beyond so many standard deviations is not random.
MOST_DEVIATION = 3.5
#: False discovery rate, and bins per factor of ten of a p-value.
RATE = 0.001
BINS = 100
LEAST_P = 1e-30


def _cumulative(z: Column) -> Column:
    """Normal distribution function, by a polynomial in 1 / (1 + p|z|) times the density."""
    x = F.abs(z) / 2**0.5
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    tail = poly * F.exp(-x * x) / 2
    return F.when(z < 0, tail).otherwise(1 - tail)


def _matches(text: Column, pattern: str, kind: int) -> Column:
    """Every match: its kind, text and length, and the length of what lies between it and the match before."""
    found = F.arrays_zip(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("match"), F.split(text, pattern, -1).alias("before")
    )
    matched = lambda x: F.struct(
        F.lit(kind).alias("kind"), F.length(x["before"]).alias("skip"), F.length(x["match"]).alias("length"), x["match"].alias("value")
    )
    return F.transform(F.filter(found, lambda x: x["match"].isNotNull()), matched)


def _all_matches(text: Column) -> Column:
    """Matches of the three patterns and candidates; cheap conditions keep most texts from the costly part."""
    none = F.array().cast("array<struct<kind:int,skip:int,length:int,value:string>>")
    low = F.lower(text)
    named = low.contains("passw") | low.contains("secret") | low.contains("token") | low.contains("key")
    return F.concat(
        F.when(named, _matches(text, ASSIGN, 0)).otherwise(none),
        F.when(text.contains("AKIA"), _matches(text, ACCESS, 1)).otherwise(none),
        F.when(text.rlike(HEX), _matches(text, HEX, 2)).otherwise(none),
        F.when(text.rlike(CANDIDATE), _matches(text, CANDIDATE, 3)).otherwise(none),
    )


def _located(found: DataFrame) -> DataFrame:
    """Spans (row, span, value) with their places in code points, and whether a candidate is clear of pattern spans.

    Places are running sums over the matches of one text and kind; a candidate is
    clear when no pattern span before it reaches into it and none starts inside.
    """
    each = found.select("row", F.posexplode("matches").alias("nth", "match")).select("row", "nth", "match.*")
    end = F.sum(F.col("skip") + F.col("length")).over(Window.partitionBy("row", "kind").orderBy("nth"))
    each = each.withColumn("end", end).withColumn("start", F.col("end") - F.col("length"))
    each = each.where((F.col("kind") != 0) | (F.length(F.regexp_extract("value", ASSIGN, 2)) >= ASSIGN_LEAST))
    fixed = F.col("kind") != KINDS.index("random")
    reached = F.max(F.when(fixed, F.col("end"))).over(Window.partitionBy("row").orderBy("start"))
    following = F.min(F.when(fixed, F.col("start"))).over(Window.partitionBy("row").orderBy(F.desc("start")))
    clear = F.coalesce(reached <= F.col("start"), F.lit(True)) & F.coalesce(following >= F.col("end"), F.lit(True))
    return each.select("row", F.struct("start", "kind", "end").alias("span"), "value", (~fixed & clear).alias("clear"))


def _tested(tokens: DataFrame) -> DataFrame:
    """Candidates (value) with encoding, whether they pass as random, and the p-value under ordinary text."""
    value = F.col("value")
    name, alphabet, equal = F.lit(None), F.lit(None), F.lit(None)
    for n, characters, order, kappa in reversed(ENCODINGS):
        fits = value.rlike(characters)
        name = F.when(fits, n).otherwise(name)
        alphabet = F.when(fits, order).otherwise(alphabet)
        equal = F.when(fits, kappa).otherwise(equal)
    rows = tokens.withColumns({"encoding": name, "alphabet": alphabet, "equal": equal, "n": F.length("value")})
    rows = rows.withColumn("k", F.length("alphabet").cast("double"))
    symbols = F.transform(F.split("value", ""), lambda c: F.instr(F.col("alphabet"), c).cast("double") - 1)
    rows = rows.withColumn("symbols", F.filter(symbols, lambda x: x >= 0))
    distinct = F.array_distinct("symbols")
    counts = F.transform(distinct, lambda d: F.size(F.filter("symbols", lambda x: x == d)).cast("double"))
    total = lambda a, f: F.aggregate(a, F.lit(0.0), lambda s, x: s + f(x))
    n, k = F.col("n").cast("double"), F.col("k")
    rows = rows.withColumns(
        {
            "squares": total(counts, lambda c: c * c),
            "mean": total(F.col("symbols"), lambda x: x) / n,
            "high": total(F.col("symbols"), lambda x: F.when(x >= k / 2, 1.0).otherwise(0.0)),
        }
    )
    pairs = F.arrays_zip(F.slice("symbols", 1, F.col("n") - 1).alias("x"), F.slice("symbols", 2, F.col("n") - 1).alias("y"))
    letters = F.transform(
        F.split("value", ""),
        lambda c: F.when(c.rlike("[a-z]"), 0).when(c.rlike("[A-Z]"), 1).when(c.rlike("[0-9]"), 2).otherwise(3),
    )
    steps = F.zip_with(F.slice(letters, 1, F.col("n") - 1), F.slice(letters, 2, F.col("n") - 1), lambda a, b: (a != b).cast("int"))
    m = F.col("mean")
    rows = rows.withColumns(
        {
            "runs": 1 + total(pairs, lambda p: ((p["x"] >= k / 2) != (p["y"] >= k / 2)).cast("double")),
            "lagged": total(pairs, lambda p: (p["x"] - m) * (p["y"] - m)),
            "spread": total(F.col("symbols"), lambda x: (x - m) * (x - m)),
            "changes": F.aggregate(steps, F.lit(0), lambda s, x: s + x).cast("double"),
        }
    )
    chi = k / n * F.col("squares") - n  # chi-squared over equal expected counts
    even = (chi - (k - 1)) / F.sqrt(2 * (k - 1) * (n - 1) / n)
    high, low = F.col("high"), n - F.col("high")
    wanted = 1 + 2 * high * low / n
    variance = F.greatest((wanted - 1) * (wanted - 2) / (n - 1), F.lit(0.25))
    runs = (F.col("runs") - wanted) / F.sqrt(variance)
    serial = (F.col("lagged") / F.greatest(F.col("spread"), F.lit(1e-9)) + 1 / n) * F.sqrt(n)
    random = (even < MOST_DEVIATION) & (F.abs(runs) < MOST_DEVIATION) & (F.abs(serial) < MOST_DEVIATION)
    beyond = (n - 1) * F.greatest(k * F.col("equal") - 1, F.lit(0.0))  # what ordinary text adds to chi-squared
    p_even = _cumulative((chi - (k - 1) - beyond) / F.sqrt(2 * (k - 1) + 4 * beyond))
    p_changes = 1 - _cumulative(
        (F.col("changes") - 0.5 - (n - 1) * CHANGES) / F.sqrt((n - 1) * CHANGES * (1 - CHANGES))
    )
    half = -F.log(F.greatest(p_even, F.lit(LEAST_P))) - F.log(F.greatest(p_changes, F.lit(LEAST_P)))
    p = F.exp(-half) * (1 + half)  # upper tail of chi-squared with four degrees of freedom
    return rows.withColumns({"random": random & ~value.rlike("^[0-9]+$"), "p": F.least(p, F.lit(1.0))})


def _discovered(tests: DataFrame) -> DataFrame:
    """Random candidates whose p-value is within the false discovery rate of their length class."""
    found = tests.withColumns(
        {
            "lengths": F.floor(F.log2(F.col("n").cast("double")) * 2),
            "bin": F.ceil(F.log10(F.greatest("p", F.lit(LEAST_P))) * BINS).cast("int"),
        }
    )
    bins = found.groupBy("lengths", "bin").agg(F.count(F.lit(1)).alias("count"))
    up_to = Window.partitionBy("lengths").orderBy("bin")
    ranked = bins.withColumns(
        {"rank": F.sum("count").over(up_to), "all": F.sum("count").over(Window.partitionBy("lengths"))}
    )
    # a bin stands for its largest p-value
    within = ranked.where(F.pow(F.lit(10.0), F.col("bin") / BINS) * F.col("all") / F.col("rank") <= RATE)
    limits = within.groupBy("lengths").agg(F.max("bin").alias("limit"))
    return found.join(F.broadcast(limits), "lengths").where(F.col("random") & (F.col("bin") <= F.col("limit")))


def _named(spans: Column) -> Column:
    """Spans as kind:start:end, ordered by start and kind."""
    names = F.array(*map(F.lit, KINDS))
    text = lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(F.array_sort(spans), text), ",")


def scanned(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text): counts and spans of secrets per document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    found = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), _all_matches(text).alias("matches"))
    found = stored(found, "matches")  # matches only, no texts
    spans = stored(_located(found), "spans")
    tests = stored(_tested(spans.where("clear")).select("row", "span", "n", "encoding", "random", "p"), "tests")
    kind = F.col("span.kind")
    base = spans.where(kind != KINDS.index("random")).groupBy("row").agg(  # spans of one text
        *[F.count_if(kind == i).alias(f"n_{name}") for i, name in enumerate(KINDS[:3])], F.collect_list("span").alias("base")
    )
    added = _discovered(tests).groupBy("row").agg(F.collect_list("span").alias("added"))
    rows = found.select("doc_id", "row").join(base, "row", "left").join(added, "row", "left")
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    base, added = F.coalesce("base", none), F.coalesce("added", none)
    return rows.select(
        "doc_id",
        *[F.coalesce(f"n_{name}", F.lit(0).cast("long")).alias(f"n_{name}") for name in KINDS[:3]],
        F.sha2(_named(base).cast("binary"), 256).alias("base_sha256"),
        _named(F.concat(base, added)).alias("spans"),
    )


def query(spark: SparkSession, folder: str) -> DataFrame:
    return scanned(read(spark, folder, "documents", "doc_id", "text"))
