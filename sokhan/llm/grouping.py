"""Problem 6: splits that keep related records together.

Calls tied by an account, a case or a parent call form components (alternating large-star and small-star rounds over edges, every
key a star round its smallest call, so no key emits pairs of its members). Method for the splits: largest differencing. The weights
of the components are combined, extreme with extreme, into many equal bins, and whole bins go to the splits by target share.
Only the histogram of weight classes, of bounded length, reaches the driver: a number of components that every bin gets alike is dealt out at once, the rest, fewer than
two per bin and class, is differenced; components take planned bins by their rank within their class.
"""

from __future__ import annotations

import heapq
from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sokhan.materialize import discard, materialize
from sokhan.operators.ranking import rank_within

BINS = 100
_DIGITS = ("۰۱۲۳۴۵۶۷۸۹٠١٢٣٤٥٦٧٨٩", "01234567890123456789")


def _code(value: Column, shape: str) -> Column:
    """A code in its one notation (letters upper, digits ASCII, signs and spaces gone), null unless it has the given shape."""
    bare = F.upper(F.regexp_replace(F.translate(value, *_DIGITS), r"(?U)[^\p{L}\p{Nd}]", ""))
    return F.when(bare.rlike(f"^{shape}$"), bare)


def call_keys(calls: DataFrame) -> DataFrame:
    """(call_id, account, case_no, parent) of ``calls`` (id, client_metadata_json).

    Unreadable or null JSON, filler and probe records have null keys; placeholders are no codes and give null. Accounts are the letters
    AC with at least four digits, cases CS, a year and at least four digits; a number of one repeated digit (0000000) is a placeholder.
    """
    j = F.col("client_metadata_json")
    path = lambda p: F.get_json_object(j, p)
    readable = F.try_parse_json(j).isNotNull() & path("$.filler").isNull() & ~F.coalesce(path("$.call.request_id").startswith("probe"), F.lit(False))
    account = _code(path("$.customer.account"), r"AC\d{4,}")
    case = _code(path("$.crm.case_no"), r"CS\d{8,}")
    real = lambda c: F.when(~c.rlike(r"^(AC|CS\d{4})(\d)\2*$"), c)
    return calls.filter(F.col("id").isNotNull()).select(
        F.col("id").alias("call_id"),
        F.when(readable, real(account)).alias("account"),
        F.when(readable, real(case)).alias("case_no"),
        F.when(readable, F.lower(F.trim(path("$.call.parent_id")))).alias("parent"),
    )


def tie_edges(calls: DataFrame) -> DataFrame:
    """Distinct edges (u, v), u > v, between calls tied by account, case or an existing parent."""
    keys = materialize(call_keys(calls))
    tied = keys.select("call_id", F.explode(F.array(F.concat(F.lit("a"), "account"), F.concat(F.lit("c"), "case_no"))).alias("k")).filter(F.col("k").isNotNull()).distinct()
    heads = tied.groupBy("k").agg(F.min("call_id").alias("v"))
    stars = tied.join(heads, "k").select(F.col("call_id").alias("u"), "v")
    # a parent is a call that exists, whatever is on record about it
    known = keys.select(F.lower(F.trim("call_id")).alias("parent"), F.col("call_id").alias("p")).distinct()
    parents = keys.filter(F.col("parent").isNotNull()).select("call_id", "parent").distinct().join(known, "parent")
    up = parents.select(F.greatest("call_id", "p").alias("u"), F.least("call_id", "p").alias("v"))
    return stars.unionByName(up).filter(F.col("u") != F.col("v")).distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): every node of ``edges`` (u, v) with the smallest node of its component.

    Each round is two aggregations with map-side combine and two joins on their results, written to the shared folder; rounds grow with the
    logarithm of the longest chain. Raises if ``rounds`` don't suffice.
    """

    def fingerprint(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())

    e = materialize(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u != v").distinct())
    before = fingerprint(e)
    for _ in range(rounds):
        last = e
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        large = materialize(large)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        e = materialize(small.filter("u != v").distinct())
        now = fingerprint(e)
        discard(last, large)
        if now == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = now
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def call_groups(calls: DataFrame) -> DataFrame:
    """(call_id, group_id): each call of a group of two or more with the smallest call id of its group. Repeated rows count once."""
    return components(tie_edges(calls)).select(F.col("node").alias("call_id"), F.col("root").alias("group_id"))


def difference(weights: list[float], bins: int) -> list[list[int]]:
    """Largest differencing of ``weights`` into ``bins`` bins: the indexes of the weights in each bin."""
    heap, tie = [], count()
    for i, w in enumerate(weights):
        loads = [(0.0, [])] * (bins - 1) + [(float(w), [i])]
        heapq.heappush(heap, (-float(w), next(tie), loads))
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        # the heaviest bins of one meet the lightest of the other
        joined = sorted(((x + y, p + q) for (x, p), (y, q) in zip(a, reversed(b))), key=lambda t: t[0])
        floor = joined[0][0]
        joined = [(x - floor, p) for x, p in joined]
        heapq.heappush(heap, (-joined[-1][0], next(tie), joined))
    return [p for _, p in heap[0][2]] if heap else [[] for _ in range(bins)]


def plan_bins(histogram: list[tuple[int, int]], bins: int, mean: dict[int, float] | None = None) -> tuple[list[tuple[int, int, int, int]], list[float]]:
    """((class, first rank, last rank, bin) for the ranks that aren't dealt out alike, load of each bin) of (class, members).

    Of each class, n // bins - 1 members go to every bin alike, a member of rank r to bin r % bins; the rest, less than 2 * bins, is differenced. A member weighs its class, or the
    class's mean in ``mean``.
    """
    weigh = (lambda w: w) if mean is None else mean.__getitem__
    load, rest = [0] * bins, []
    for w, n in sorted(histogram, reverse=True):
        share = max(0, n // bins - 1)
        load = [x + weigh(w) * share for x in load]
        rest += [(w, r) for r in range(share * bins, n)]
    plan = []
    for b, members in enumerate(difference([weigh(w) for w, _ in rest], bins)):
        for i in members:
            w, r = rest[i]
            plan.append((w, r, r, b))
            load[b] += weigh(w)
    return plan, load


def allot(load: list[int], targets: list[tuple[str, float]]) -> list[str]:
    """The split of each bin: the heaviest bins first, each to the split that lacks most."""
    total, whole = sum(load), sum(s for _, s in targets)
    lack = {name: total * share / whole for name, share in targets}
    out = [""] * len(load)
    for b in sorted(range(len(load)), key=lambda b: (-load[b], b)):
        name = max(lack, key=lambda s: (lack[s], s))
        out[b] = name
        lack[name] -= load[b]
    return out


def weight_class(weight: Column) -> Column:
    """Weights below 100 are classes of their own, larger ones are of the class of their first two digits, so there are fewer than 2,000 classes."""
    unit = F.pow(F.lit(10.0), F.greatest(F.length(weight.cast("string")) - 2, F.lit(0))).cast("long")
    return F.floor(weight / unit).cast("long") * unit


def group_splits(units: DataFrame, targets: list[tuple[str, float]], bins: int = BINS) -> DataFrame:
    """(group_id, weight, bin, split) of ``units`` (group_id, weight): whole groups in splits whose weights come close to ``targets``.

    The targets needn't sum to 1. Groups are planned by the mean weight of their class. Groups of weight 0 or null are left out of the balance and go to the first target.
    """
    spark: SparkSession = units.sparkSession
    units = units.select("group_id", F.coalesce(F.col("weight"), F.lit(0)).cast("long").alias("weight")).withColumn("class", weight_class(F.col("weight")))
    rows = units.filter("weight > 0").groupBy("class").agg(F.count("*").alias("n"), F.sum("weight").alias("w")).collect()
    mean = {r["class"]: r.w / r.n for r in rows}
    plan, load = plan_bins([(r["class"], r.n) for r in rows], bins, mean)
    split = allot(load, targets)
    extra = spark.createDataFrame(plan or [(-1, 0, 0, 0)], "class long, rank long, last long, planned int").drop("last")
    names = spark.createDataFrame(list(enumerate(split)), "bin int, split string")
    ranked = rank_within(units.filter("weight > 0"), "class", "group_id")
    placed = ranked.join(F.broadcast(extra), ["class", "rank"], "left").select("group_id", "weight", F.coalesce("planned", F.pmod("rank", F.lit(bins))).cast("int").alias("bin"))
    out = placed.join(F.broadcast(names), "bin").select("group_id", "weight", "bin", "split")
    return out.unionByName(units.filter("weight = 0").select("group_id", "weight", F.lit(None).cast("int").alias("bin"), F.lit(targets[0][0]).alias("split")))


def call_splits(calls: DataFrame, windows: DataFrame, targets: list[tuple[str, float]], bins: int = BINS) -> DataFrame:
    """(call_id, group_id, n_windows, split) for every call; tied calls and all windows of a call share a split.

    ``windows``: (window_id, call_id), repeats count once. A group weighs its calls and their windows. Windows whose call is unknown or null
    have no split here.
    """
    ids = calls.select(F.col("id").alias("call_id")).filter(F.col("call_id").isNotNull()).distinct()
    n = windows.select("window_id", "call_id").distinct().groupBy("call_id").agg(F.count("*").alias("n_windows"))
    grouped = materialize(
        ids.join(call_groups(calls), "call_id", "left").join(n, "call_id", "left")
        .select("call_id", F.coalesce("group_id", "call_id").alias("group_id"), F.coalesce("n_windows", F.lit(0)).alias("n_windows"))
    )
    units = grouped.groupBy("group_id").agg((F.count("*") + F.sum("n_windows")).alias("weight"))
    return grouped.join(group_splits(units, targets, bins).select("group_id", "split"), "group_id").select("call_id", "group_id", "n_windows", "split")
