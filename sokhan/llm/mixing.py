"""Problem 9: mixing sources to target weights.

Method: iterative proportional fitting. The tokens of the cells source x language x topic are raked to the marginals (the sources' target
shares; languages and topics by default as they are in the corpus), never beyond the repeats a source allows. A cell's raked weight
over its tokens is the number of copies each of its documents is to have on average, and documents are drawn by these calibrated rates, by systematic sampling.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sokhan.materialize import materialize
from sokhan.operators.ranking import rank_within

Cell = tuple[str, str, str]
#: Starts of the systematic sample that each source may choose from.
STARTS = 64


def feasible_total(tokens: dict[str, int], targets: dict[str, float], repeats: dict[str, int]) -> float:
    """The largest mixture in which every source that has tokens reaches its share within its repeats."""
    there = [s for s in targets if tokens.get(s, 0) > 0 and targets[s] > 0]
    whole = sum(targets[s] for s in there)
    return min((tokens[s] * repeats[s] * whole / targets[s] for s in there), default=0.0)


def rake(cells: dict[Cell, float], targets: dict[str, float], repeats: dict[str, int], total: float, marginals: tuple[dict[str, float], dict[str, float]] | None = None, rounds: int = 200) -> dict[Cell, float]:
    """Weights of the cells, fitted in turn to topic, language and source; the sources, fitted last, are met exactly unless repeats forbid it."""
    cells = {c: t for c, t in cells.items() if targets.get(c[0], 0) > 0 and t > 0}
    if not cells:
        return {}
    there = {c[0] for c in cells}
    whole = sum(targets[s] for s in there)
    goal: list[dict[str, float]] = [{s: total * targets[s] / whole for s in there}]
    for axis in (1, 2):
        own: dict[str, float] = defaultdict(float)
        for c, t in cells.items():
            own[c[axis]] += t
        asked = marginals[axis - 1] if marginals else own
        norm = sum(asked.get(k, 0.0) for k in own) or 1.0
        goal.append({k: total * asked.get(k, 0.0) / norm for k in own})
    top = {c: t * repeats[c[0]] for c, t in cells.items()}
    w = {c: min(top[c], total * t / sum(cells.values())) for c, t in cells.items()}

    def fit(axis: int) -> None:
        for k, want in goal[axis].items():
            mine = [c for c in w if c[axis] == k]
            free, need = set(mine), want
            while free:  # what the full cells cannot take goes to the others
                now = sum(w[c] for c in free)
                if now <= 0:
                    break
                full = {c for c in free if w[c] * need / now > top[c]}
                if not full:
                    for c in free:
                        w[c] *= need / now
                    break
                for c in full:
                    w[c] = top[c]
                need = max(0.0, need - sum(top[c] for c in full))
                free -= full

    for _ in range(rounds):
        before = dict(w)
        for axis in (2, 1, 0):
            fit(axis)
        if max(abs(w[c] - before[c]) for c in w) <= 1e-6 * total:
            break
    return w


class Mixture:
    """A mixture of ``sizes`` (doc_id, source, lang, topic, n_tokens; ids unique) by ``targets`` rows (source_name, target_share, max_repeats).

    Documents whose source is null or has no target are not drawn. A source without documents can't reach its share; the others keep
    their proportions. ``total``: tokens of the mixture, by default the largest with which all reach their shares.
    """

    def __init__(self, sizes: DataFrame, targets: list[tuple[str, float, int]], total: float | None = None, marginals: tuple[dict[str, float], dict[str, float]] | None = None):
        self.targets, self._drawn = targets, None
        share, repeats = {s: t for s, t, _ in targets}, {s: r for s, _, r in targets}
        self.sizes = materialize(sizes.filter(F.col("source").isin([s for s, _, _ in targets])))
        rows = self.sizes.groupBy("source", "lang", "topic").agg(F.sum("n_tokens").alias("t")).collect()
        cells = {(r.source, r.lang, r.topic): float(r.t) for r in rows}
        tokens: dict[str, int] = defaultdict(int)
        for c, t in cells.items():
            tokens[c[0]] += int(t)
        self.total = feasible_total(tokens, share, repeats) if total is None else total
        self.weights = rake(cells, share, repeats, self.total, marginals)
        self.copies = {c: min(w / cells[c], repeats[c[0]]) for c, w in self.weights.items()}

    def draw(self) -> DataFrame:
        """(doc_id, source_name, n_tokens, copies): documents with at least one copy.

        A document's calibrated number of copies is its cell's rate. Systematic sampling: a source's documents are laid in a row, cell by cell and in hash order, each as long as its rate, and a document has as many
        copies as marks, one at each whole number and shifted by a start, fall on it. So every document has its rate as its expectation, and each cell its share of the marks but for one. Of ``STARTS``
        evenly spaced starts each source takes the one whose tokens come nearest to its aim. A document's place is its cell's beginning, from the table of cells, and its rank in the cell.
        """
        if self._drawn is not None:
            return self._drawn
        spark = self.sizes.sparkSession
        cells = self.sizes.groupBy("source", "lang", "topic").agg(F.count("*").alias("n")).collect()
        at: dict[str, float] = defaultdict(float)
        rows = []
        for r in sorted(cells, key=lambda r: (r.source, r.lang, r.topic)):
            rate = self.copies.get((r.source, r.lang, r.topic), 0.0)
            rows.append((r.source, r.lang, r.topic, rate, at[r.source]))
            at[r.source] += rate * r.n
        table = spark.createDataFrame(rows or [("", "", "", 0.0, 0.0)], "source string, lang string, topic string, _rate double, _at double").filter("_rate > 0")
        keyed = self.sizes.join(F.broadcast(table), ["source", "lang", "topic"]).withColumn("_cell", F.concat_ws("|", "source", "lang", "topic"))
        ranked = rank_within(keyed, "_cell", "doc_id", "_rank")
        placed = materialize(ranked.select("doc_id", "source", "n_tokens", (F.col("_at") + F.col("_rank") * F.col("_rate")).alias("_from"), (F.col("_at") + (F.col("_rank") + 1) * F.col("_rate")).alias("_to")))
        marks = lambda start: F.floor(F.col("_to") + start + 1e-9) - F.floor(F.col("_from") + start + 1e-9)
        starts = [(j + 0.5) / STARTS for j in range(STARTS)]
        totals = placed.groupBy("source").agg(F.array(*(F.sum(marks(F.lit(x)) * F.col("n_tokens")) for x in starts)).alias("t")).collect()
        aim: dict[str, float] = defaultdict(float)
        for c, w in self.weights.items():
            aim[c[0]] += w
        best = [(r.source, min(zip(r.t, starts), key=lambda x: (abs(x[0] - aim[r.source]), x[1]))[1]) for r in totals]
        chosen = spark.createDataFrame(best or [("", 0.5)], "source string, _start double")
        copies = marks(F.col("_start")).cast("int")
        self._drawn = placed.join(F.broadcast(chosen), "source").select("doc_id", F.col("source").alias("source_name"), "n_tokens", copies.alias("copies")).filter("copies > 0")
        return self._drawn

    def report(self) -> DataFrame:
        """(source_name, target_share, max_repeats, available_tokens, drawn_documents, drawn_tokens, actual_share): a row per target."""
        spark = self.sizes.sparkSession
        asked = spark.createDataFrame(self.targets, "source_name string, target_share double, max_repeats int")
        there = self.sizes.groupBy(F.col("source").alias("source_name")).agg(F.sum("n_tokens").alias("available_tokens"))
        drawn = self.draw().groupBy("source_name").agg(F.count("*").alias("drawn_documents"), F.sum(F.col("n_tokens").cast("long") * F.col("copies")).alias("drawn_tokens"))
        zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
        joined = asked.join(there, "source_name", "left").join(drawn, "source_name", "left")
        joined = joined.crossJoin(F.broadcast(drawn.agg(F.sum("drawn_tokens").alias("_all"))))
        return joined.select(
            "source_name", "target_share", "max_repeats", zero("available_tokens"), zero("drawn_documents"), zero("drawn_tokens"),
            F.coalesce(F.expr("try_divide(drawn_tokens, _all)"), F.lit(0.0)).alias("actual_share"),
        )

    def marginals(self) -> DataFrame:
        """(axis source | lang | topic, name, raked_share, available_tokens, drawn_tokens, actual_share): what the raking gave each marginal, and what was drawn."""
        spark = self.sizes.sparkSession
        axes = ("source", "lang", "topic")
        goal: dict[tuple[str, str], float] = defaultdict(float)
        for c, w in self.weights.items():
            for axis, name in zip(axes, c):
                goal[axis, name] += w / (sum(self.weights.values()) or 1.0)
        asked = spark.createDataFrame([(a, n, x) for (a, n), x in sorted(goal.items())] or [("", "", 0.0)], "axis string, name string, raked_share double").filter("axis != ''")
        each = self.sizes.join(self.draw().select("doc_id", "copies"), "doc_id", "left").select("source", "lang", "topic", F.col("n_tokens").cast("long").alias("t"), F.coalesce("copies", F.lit(0)).alias("copies"))
        cells = each.groupBy(*axes).agg(F.sum("t").alias("available"), F.sum(F.col("t") * F.col("copies")).alias("drawn"))
        long = cells.select(F.explode(F.array(*(F.struct(F.lit(a).alias("axis"), F.col(a).alias("name")) for a in axes))).alias("x"), "available", "drawn")
        sums = long.groupBy("x.axis", "x.name").agg(F.sum("available").alias("available_tokens"), F.sum("drawn").alias("drawn_tokens"))
        total = cells.agg(F.sum("drawn").alias("_all"))
        both = asked.join(sums, ["axis", "name"], "left").crossJoin(F.broadcast(total))
        return both.select("axis", "name", "raked_share", "available_tokens", "drawn_tokens", F.coalesce(F.expr("try_divide(drawn_tokens, _all)"), F.lit(0.0)).alias("actual_share"))
