"""Problem 2: consensus from several annotators' labels.

Method: bipartite message passing on label edges, one class against the rest. An item tells each of its annotators how likely each class
is in the light of the *other* annotators; an annotator tells each of its items how much its label speaks for each class against the
rest, in the light of its *other* items. A round is one aggregation by annotator and label, combined before the shuffle, whose few rows are sent to the tasks,
and one pass over each item's labels; it is written once to the shared folder, and the round before it is deleted. Rounds end when no message moves by more
than a tolerance; if that doesn't come within ``ROUNDS``, a warning tells. An item has as many labels as there are annotators at most, so it fits into a task.
"""

from __future__ import annotations

import math
import warnings

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from sokhan.materialize import discard, materialize

CLASSES = ("A", "B", "either", "neither")
#: Weight, in labels, of the belief that an annotator is as good as the average one.
PRIOR = 4.0
#: The same for the average annotator.
BELIEF = 20.0
ROUNDS, TOLERANCE = 100, 0.01
#: Annotators whose tables are sent to the tasks, five rows each at most; more are joined.
MOST_BROADCAST = 50_000


def clean_verdict(verdict: Column) -> Column:
    """A, B, either, neither or unsure, however written; null for anything else."""
    v = F.lower(F.regexp_replace(verdict, r"(?U)[^\p{L}]", ""))
    out = F.when(v.isin("either", "neither", "unsure"), v)
    return F.when(v == "a", F.lit("A")).when(v == "b", F.lit("B")).otherwise(out)


def usable_labels(log: DataFrame) -> DataFrame:
    """(id, model, label): the last line with a readable verdict of each judge for each item, if it isn't an abstention.

    ``log``: (line_no, id, model, verdict). Failed lines (null or unreadable) never count; repeated lines count once; rows with a null id or
    model are left out.
    """
    lines = log.select("id", "model", "line_no", clean_verdict(F.col("verdict")).alias("label")).filter("label is not null and id is not null and model is not null")
    last = lines.groupBy("id", "model").agg(F.max_by("label", F.struct("line_no", "label")).alias("label"))
    return last.filter("label != 'unsure'")



def _by_model(rows: list[Row]) -> dict[str, list[Row]]:
    out: dict[str, list[Row]] = {}
    for r in rows:
        out.setdefault(r.model, []).append(r)
    return out


def _pooled(rows: list[Row], k: int) -> list[Row]:
    """The rows of (model, vote) added up by vote."""
    votes: dict[int, list[Row]] = {}
    for r in rows:
        votes.setdefault(r.vote, []).append(r)
    return [Row(vote=v, n=sum(r.nv for r in rs), moved=max(r.moved for r in rs), **{f"g{c}": sum(r[f"v{c}"] for r in rs) for c in range(k)}) for v, rs in votes.items()]


def message_passing(labels: DataFrame, rounds: int = ROUNDS, tolerance: float = TOLERANCE, prior: float = PRIOR) -> tuple[DataFrame, DataFrame]:
    """(items, edges) of ``labels`` (id, model, label) after the last round.

    items: (id, n_labels, s0 .. s3) with the log odds of each class against the rest; edges: (id, model, vote, p0 .. p3) with what the
    item told the annotator. An empty table gives empty tables.
    """
    k, spark = len(CLASSES), labels.sparkSession
    vote = F.array_position(F.array(*map(F.lit, CLASSES)), F.col("label")) - 1
    edges = labels.select("id", "model", vote.cast("int").alias("vote"))
    votes = edges.groupBy("id").agg(F.count("*").alias("n"), *(F.sum((F.col("vote") == c).cast("double")).alias(f"n{c}") for c in range(k)))
    # at first an item believes the shares of its other labels
    edges = edges.join(votes, "id").select(
        "id", "model", "vote",
        *(((F.col(f"n{c}") - (F.col("vote") == c).cast("double") + 0.3) / (F.col("n") - 1 + 0.3 * k)).alias(f"p{c}") for c in range(k)),
    )
    edges = materialize(edges.withColumn("moved", F.lit(1.0)))
    items = None
    # annotators and their labels are few against the edges; only if they are, their table is sent to the tasks
    small = edges.select("model").distinct().count() <= MOST_BROADCAST
    # the columns of a round, made once: what labels say, what items hear, what they answer, how far that moved
    names = range(k)
    p = [F.col(f"p{c}") for c in names]
    spoken = [F.col(x) for x in ("id", "model", "vote")] + p + [F.col(f"lp{c}") for c in names]
    for c in names:
        yes = (F.col(f"v{c}") - p[c] + prior * F.col(f"yes{c}")) / (F.col(f"a{c}") - p[c] + prior)
        no = (F.col("nv") - F.col(f"v{c}") - (1 - p[c]) + prior * F.col(f"no{c}")) / (F.col("na") - F.col(f"a{c}") - (1 - p[c]) + prior)
        spoken.append(F.log(F.greatest(yes, F.lit(1e-6)) / F.greatest(no, F.lit(1e-6))).alias(f"l{c}"))
    # an item's labels meet in one task, where it answers each of them; the round is written once
    item = Window.partitionBy("id")
    heard = [F.col("*"), F.count("*").over(item).alias("n_labels"), *((F.sum(f"l{c}").over(item) + F.col(f"lp{c}")).alias(f"s{c}") for c in names)]
    kept = [F.col(x) for x in ("id", "model", "vote", "n_labels", *(f"s{c}" for c in names))]
    answered = [*kept, *(F.col(f"p{c}").alias(f"old{c}") for c in names), *((1 / (1 + F.exp(-(F.col(f"s{c}") - F.col(f"l{c}"))))).alias(f"o{c}") for c in names)]
    norm = sum((F.col(f"o{c}") for c in range(1, k)), F.col("o0"))
    new = [F.col(f"o{c}") / norm for c in names]
    settled = [*kept, *(x.alias(f"p{c}") for c, x in enumerate(new)), F.greatest(*(F.abs(x - F.col(f"old{c}")) for c, x in enumerate(new))).alias("moved")]
    of_edges = [F.count("*").alias("nv"), F.max("moved").alias("moved"), *(F.sum(f"p{c}").alias(f"v{c}") for c in names)]
    for done in range(rounds + 1):
        of_vote = edges.groupBy("model", "vote").agg(*of_edges)
        rows = of_vote.collect() if small else None
        pooled = _pooled(rows, k) if rows is not None else of_vote.groupBy("vote").agg(F.sum("nv").alias("n"), F.max("moved").alias("moved"), *(F.sum(f"v{c}").alias(f"g{c}") for c in range(k))).collect()
        if not pooled or done and max(r.moved for r in pooled) < tolerance:
            break
        if done == rounds:
            warnings.warn(f"messages have not settled after {rounds} rounds", RuntimeWarning, stacklevel=2)
            break
        mass = [sum(r[f"g{c}"] for r in pooled) + 1e-9 for c in range(k)]
        total = sum(mass)
        # the average annotator, itself held to name the class rather than another until labels tell
        belief = lambda v, c: BELIEF * (0.7 if v == c else 0.3 / (k - 1))
        share = {(r.vote, c): (r[f"g{c}"] + belief(r.vote, c)) / (mass[c] + BELIEF) for r in pooled for c in range(k)}
        rest = {(r.vote, c): sum(r[f"g{d}"] + belief(r.vote, d) for d in range(k) if d != c) / (total - mass[c] + BELIEF * (k - 1)) for r in pooled for c in range(k)}
        # what all annotators share travels as columns, so that every round runs the same compiled code
        common = {v: [x for c in range(k) for x in (share.get((v, c), 0.01), rest.get((v, c), 0.01), math.log(mass[c] / (total - mass[c] + 1e-9)))] for v in range(k)}
        columns = ", ".join(f"yes{c} double, no{c} double, lp{c} double" for c in range(k))
        if small:
            all_of = {m: [sum(x) for x in zip(*((r.nv, *(r[f"v{c}"] for c in range(k))) for r in group))] for m, group in _by_model(rows).items()}
            schema = "model string, vote int, nv long, na long, " + ", ".join(f"v{c} double, a{c} double" for c in range(k)) + ", " + columns
            votes_of = spark.createDataFrame([(r.model, r.vote, r.nv, all_of[r.model][0], *(x for c in range(k) for x in (r[f"v{c}"], all_of[r.model][c + 1])), *common[r.vote]) for r in rows], schema)
        else:
            whole = of_vote.groupBy("model").agg(F.sum("nv").alias("na"), *(F.sum(f"v{c}").alias(f"a{c}") for c in range(k)))
            votes_of = of_vote.drop("moved").join(whole, "model").join(F.broadcast(spark.createDataFrame([(v, *x) for v, x in common.items()], "vote int, " + columns)), "vote")
        told = edges.join(F.broadcast(votes_of) if small else votes_of, ["model", "vote"])
        before, edges = edges, materialize(told.select(*spoken).select(*heard).select(*answered).select(*settled))
        discard(before)
        items = edges
    if items is None:
        items = labels.select("id", F.lit(0).alias("n_labels"), *(F.lit(0.0).alias(f"s{c}") for c in range(k))).limit(0)
    # the scores are an item's on each of its edges
    scores = [F.first(f"s{c}").alias(f"s{c}") for c in range(k)]
    return items.groupBy("id").agg(F.first("n_labels").alias("n_labels"), *scores), edges.select("id", "model", "vote", *(f"p{c}" for c in range(k)))


class Consensus:
    """Consensus, agreement and reliability from a verdict log; see ``usable_labels`` for what counts."""

    def __init__(self, log: DataFrame, **how: float):
        self.labels = materialize(usable_labels(log))
        self._items, self._edges = message_passing(self.labels, **how)

    def items(self) -> DataFrame:
        """(id, verdict, confidence, n_labels, agreement): agreement is the share of agreeing pairs of labels, null for a single label. Ties go to the class named first."""
        k = len(CLASSES)
        scores = F.array(*(F.col(f"s{c}") for c in range(k)))
        sure = [1 / (1 + F.exp(-F.col(f"s{c}"))) for c in range(k)]
        counts = self.labels.groupBy("id", "label").count().groupBy("id").agg(F.sum("count").alias("n"), F.sum(F.col("count") * (F.col("count") - 1)).alias("same"))
        best = self._items.select(
            "id", F.element_at(F.array(*map(F.lit, CLASSES)), F.array_position(scores, F.array_max(scores)).cast("int")).alias("verdict"),
            (F.greatest(*sure) / sum(sure[1:], sure[0])).alias("confidence"),
        )
        return best.join(counts, "id").select("id", "verdict", "confidence", F.col("n").alias("n_labels"), F.expr("try_divide(same, n * (n - 1))").alias("agreement"))

    def annotators(self) -> DataFrame:
        """(model, n_labels, reliability): the share of its labels that the items, judged by the others, hold for right."""
        own = F.element_at(F.array(*(F.col(f"p{c}") for c in range(len(CLASSES)))), F.col("vote") + 1)
        return self._edges.groupBy("model").agg(F.count("*").alias("n_labels"), F.avg(own).alias("reliability"))
