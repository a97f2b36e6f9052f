"""Mixing sources to target weights as a min-cost flow over membership patterns.

Documents are summed up by pattern, the set of sources they belong to. Words flow from a pattern through arcs
for the first, second, ... use of its words, each dearer than the one before, to the quotas of its sources. The
cheapest flow repeats words only where a quota can't be met otherwise. Then each pattern's documents are picked
in the order of a seeded hash until its flow is reached.

The sums (a row for each pattern) come to the driver and are checked against max_patterns; documents do not. A million
patterns take it a few seconds to some minutes; only the memory of the driver bounds them.
Picking needs a running sum in hash order. Hash ranges are summed first, so only the one range in which a
pattern's flow ends is summed row by row; a pattern with a third of all rows is spread over all tasks.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scrivel.llm.common import WORD, persist, whole_text

MAX_PATTERNS = 5_000_000
RANGES = 4096


def targets(sizes: dict, weights: list[float], share: float, most: float) -> dict:
    """Targets that sum to share times all sizes, by weight, none above most times its size.

    Sources are in code point order, null last, and take the weights in turn. What a source can't take is
    dealt again by weight among the others until none is above; if all are at their limit the rest is not dealt.
    """
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    left, free, out = share * sum(sizes.values()), set(names), {}
    while free:
        total = sum(weight[s] for s in names if s in free)
        full = [s for s in names if s in free and left * weight[s] / total >= most * sizes[s]]
        if not full:
            return out | {s: left * weight[s] / total for s in free}
        for s in full:
            out[s] = float(most * sizes[s])
            free.discard(s)
        left -= sum(out[s] for s in full)
    return out


class Flow:
    """Words sent from patterns to quotas of their sources; raise_by adds words to patterns and sends as many as can be."""

    def __init__(self, sources: list[list[int]], quotas: list[int]):
        self.sources, self.left = sources, list(quotas)
        self.sent: list[dict[int, int]] = [dict.fromkeys(of, 0) for of in sources]
        self.patterns: list[list[int]] = [[] for _ in quotas]
        for p, of in enumerate(sources):
            for s in of:
                self.patterns[s].append(p)

    def raise_by(self, words: list[int]) -> list[int]:
        """The words of each pattern that were sent."""
        room = list(words)
        for p, of in enumerate(self.sources):
            for s in of:
                n = min(room[p], self.left[s])
                self.sent[p][s] += n
                self.left[s] -= n
                room[p] -= n
        while self._shortest_paths(room):
            pass
        return [w - r for w, r in zip(words, room, strict=True)]

    def _shortest_paths(self, room: list[int]) -> bool:
        """Sends along a blocking set of shortest paths, over words of other patterns that can go elsewhere; whether there is any."""
        starts = [p for p, r in enumerate(room) if r and self.sources[p]]
        # nodes: a pattern p, or ~s for a source s
        depth, edge, ends = dict.fromkeys(starts, 0), starts, False
        while edge and not ends:
            after = []
            for node in edge:
                for to in self._next(node):
                    if to not in depth:
                        depth[to] = depth[node] + 1
                        after.append(to)
            ends = any(to < 0 and self.left[~to] for to in after)
            edge = after
        if not ends:
            return False
        at: dict[int, int] = {}
        for start in starts:
            path = [start]
            while path and room[start]:
                node = path[-1]
                if node < 0 and self.left[~node]:
                    back = [self.sent[q][~s] for s, q in zip(path[1::2], path[2::2], strict=False)]
                    n = min(room[start], self.left[~node], *back)
                    room[start] -= n
                    self.left[~node] -= n
                    for p, s in zip(path[::2], path[1::2], strict=True):
                        self.sent[p][~s] += n
                    for s, q in zip(path[1::2], path[2::2], strict=False):
                        self.sent[q][~s] -= n
                    path = [start]
                    continue
                options = self.sources[node] if node >= 0 else self.patterns[~node]
                k = at.get(node, 0)
                while k < len(options) and not self._leads(node, options[k], depth):
                    k += 1
                at[node] = k
                if k < len(options):
                    path.append(~options[k] if node >= 0 else options[k])
                else:
                    path.pop()
                    if path:
                        at[path[-1]] += 1
        return True

    def _next(self, node: int) -> list[int]:
        return [~s for s in self.sources[node]] if node >= 0 else [p for p in self.patterns[~node] if self.sent[p][~node]]

    def _leads(self, node: int, option: int, depth: dict[int, int]) -> bool:
        to = ~option if node >= 0 else option
        return depth.get(to) == depth[node] + 1 and (node >= 0 or self.sent[option][~node] > 0)


def route(patterns: dict[tuple, int], quotas: dict, uses: int) -> dict[tuple, int]:
    """Words to take of each pattern: the cheapest of the largest flows to the quotas, the k-th use of a word costing k squared.

    A path costs what the use costs that it begins with, as all other arcs are free. So all paths of one cost are found before those of
    the next: for each use, a largest flow on top of the one before, by blocking sets of shortest paths.
    """
    keys, at = list(patterns), {s: k for k, s in enumerate(quotas)}
    flow = Flow([[at[s] for s in p if s in at] for p in keys], [round(q) for q in quotas.values()])
    words = [patterns[p] for p in keys]
    sent = [flow.raise_by(words) for _ in range(uses)]
    return {p: sum(n[k] for n in sent) for k, p in enumerate(keys)}


def mix(docs: DataFrame, membership: str = "source", weights: list[float] = (5, 2, 1), share: float = 1.5, uses: int = 2, seed: int = 42, id_column: str = "doc_id", text_column: str = "text", quotas: dict | None = None, max_patterns: int = MAX_PATTERNS) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies and text_hash (xxhash64 of the text) for every document.

    membership is a string column (one source) or an array of strings (overlapping sources). A document's target and
    source_size are the sums over its sources. Nulls are a source of their own, the empty string another; an empty
    array belongs to none and is not taken. taken is size times copies, copies at most `uses`. Null texts have size 0.
    Equal rows share a hash and are ordered by doc_id; identical rows may swap, which changes nothing. The mix
    depends on seed and rows only, not on their order. An empty table gives no rows; further columns are ignored.
    """
    spark = docs.sparkSession
    many = dict(docs.dtypes)[membership].startswith("array")
    text = whole_text(text_column)
    member = F.array_sort(F.array_distinct(F.coalesce(F.col(membership), F.array(F.lit(None).cast("string"))))) if many else F.array(F.col(membership).cast("string"))
    light = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), member.alias("pattern"), F.xxhash64(text).alias("text_hash"))
    h = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text_hash"))
    # The texts are read once; what follows needs a few dozen bytes a document.
    rows = persist(light.withColumn("h", h).withColumn("range", F.expr(f"pmod(shiftrightunsigned(h, 40), {RANGES})").cast("int")).withColumn("key", F.to_json(F.struct("pattern"), {"ignoreNullFields": "false"})), "mix-sizes")
    by_range = rows.groupBy("key", "range").agg(F.sum("size").alias("words"))
    sums = persist(rows.groupBy("pattern", "key").agg(F.sum("size").alias("words")), "mix-patterns")
    if (n := sums.count()) > max_patterns:
        raise ValueError(f"{n} membership patterns are more than max_patterns; raise it if the driver can hold them")
    by_pattern = sorted(sums.collect(), key=lambda r: r.key)
    patterns = {tuple(r.pattern): int(r.words) for r in by_pattern}
    sizes: dict = defaultdict(int)
    for p, words in patterns.items():
        for s in p:
            sizes[s] += words
    goal = quotas or targets(dict(sizes), list(weights), share, uses)
    flow = route(patterns, goal, uses)
    # of each pattern: whole uses for all its documents, and words of one more use for some of them
    table = []
    for r in by_pattern:
        p, words = tuple(r.pattern), max(int(r.words), 1)
        table.append((r.key, sum(sizes[s] for s in p), float(sum(goal.get(s, 0.0) for s in p)), int(flow.get(p, 0) // words), int(flow.get(p, 0) % words)))
    plan = spark.createDataFrame(table, "key string, source_size long, target double, whole int, more long")
    # A row for each pattern, at most max_patterns; only within a few MB it is sent to all tasks.
    near = F.broadcast if sum(60 + len(r.key) for r in by_pattern) < 8_000_000 else (lambda d: d)
    upto = Window.partitionBy("key").orderBy("range")
    ranges = by_range.join(near(plan.select("key", "more")), "key").withColumn("before", F.sum("words").over(upto) - F.col("words"))
    edge = near(ranges.where((F.col("before") < F.col("more")) & (F.col("before") + F.col("words") >= F.col("more"))).select("key", F.col("range").alias("edge_range"), "before"))
    marked = rows.join(near(plan), "key").join(edge, "key", "left")
    # Only the documents of the range in which a pattern's flow ends are summed one by one: one in RANGES.
    inside = F.coalesce(F.col("range") == F.col("edge_range"), F.lit(False))
    running = Window.partitionBy("key", "range").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    at_edge = marked.where(inside).withColumn("upto", F.col("before") + F.sum("size").over(running))
    # the document in which the flow ends is taken if that comes nearer to it
    in_edge = F.when(F.col("upto") <= F.col("more"), 1).when(F.col("upto") - F.col("size") >= F.col("more"), 0).when(2 * F.col("more") > 2 * F.col("upto") - F.col("size"), 1).otherwise(0)
    elsewhere = F.when((F.col("more") > 0) & (F.col("range") < F.coalesce("edge_range", F.lit(RANGES))), 1).otherwise(0)
    out = at_edge.withColumn("extra", in_edge).drop("upto").unionByName(marked.where(~inside).withColumn("extra", elsewhere))
    copies = F.least(F.col("whole") + F.col("extra"), F.lit(uses))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * copies).alias("taken"), copies.alias("copies"), "text_hash")


__all__ = ["Flow", "mix", "route", "targets"]
