"""SRC3: the tables of a page from its ruling lines and the spans of its text, by columns alone.

Lines become edges: near ones are snapped to one place, and what touches or overlaps is merged by a running reach. Where edges cross,
edges end: what sticks out over the first or last crossing is cut off. Edges that cross, directly or over others, are one table. A
table's levels (the places of its level edges) cut it into bands, upright edges cut bands into boxes, and boxes of the same width
go on from band to band until a level edge lies between them; such a run is a cell if an edge closes it above and below. There are two
ways to the same tables. `tables` takes rules and spans as rows, of any number a page: no edge is compared with all others, crossings,
walls and spans meet in strips of the page, the rest are windows. `held_tables` takes a page a row, with its rules and spans as arrays:
edges of a page are compared with each other there, so it is the cheaper way for pages of some hundred edges.

rules: doc_id, page, x0, y0, x1, y1 (thin ones are lines, others boxes with four edges); spans: doc_id, page, x0, y0, x1, y1 and text, y downwards.
Null places draw nothing and null texts say nothing; repeated rules are one edge, repeated spans come as often as they are;
spans at one place come in order of their text; a table of one cell is none; empty tables give no rows, further columns are ignored. A null
doc_id is a document of its own only where joins don't need it: it has no tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scrivel.functions.text import strip
from scrivel.streaming.shared import bucketed

#: Points within which edges are one, touch, or cross.
NEAR = 3.0
#: Height of a strip in which edges and spans meet.
STRIP = 64.0
_PAGE = ["doc_id", "page"]
_RULE = "struct<x0:double,y0:double,x1:double,y1:double>"


def _strip_of(y: Column) -> Column:
    return F.floor(y / STRIP).cast("long")


def _strips(low: Column, high: Column) -> Column:
    return F.explode(F.sequence(_strip_of(low), _strip_of(high)))


def edges(rules: DataFrame, near: float = NEAR) -> DataFrame:
    """doc_id, page, upright, at, low, high, edge: snapped and merged edges; edge is a number within its page and direction."""
    c = F.col
    lies, stands = F.abs(c("y1") - c("y0")) <= near, F.abs(c("x1") - c("x0")) <= near
    edge = lambda up, at, low, high: F.struct(F.lit(up).alias("upright"), at.alias("at"), F.least(low, high).alias("low"), F.greatest(low, high).alias("high"))
    level, upright = edge(False, (c("y0") + c("y1")) / 2, c("x0"), c("x1")), edge(True, (c("x0") + c("x1")) / 2, c("y0"), c("y1"))
    box = F.array(edge(False, c("y0"), c("x0"), c("x1")), edge(False, c("y1"), c("x0"), c("x1")), edge(True, c("x0"), c("y0"), c("y1")), edge(True, c("x1"), c("y0"), c("y1")))
    drawn = rules.where("x0 is not null and y0 is not null and x1 is not null and y1 is not null").select(*_PAGE, *(c(k).cast("double").alias(k) for k in ("x0", "y0", "x1", "y1"))).distinct()
    e = drawn.where(~(lies & stands)).select(*_PAGE, F.explode(F.when(lies, F.array(level)).when(stands, F.array(upright)).otherwise(box)).alias("e")).select(*_PAGE, "e.*")
    way = [*_PAGE, "upright"]
    by_place = Window.partitionBy(*way).orderBy("at")
    e = e.withColumn("jump", (c("at") - F.lag("at").over(by_place) > near).cast("int")).withColumn("place", F.coalesce(F.sum("jump").over(by_place.rangeBetween(Window.unboundedPreceding, 0)), F.lit(0)))
    e = e.withColumn("at", F.avg("at").over(Window.partitionBy(*way, "place")))
    along = Window.partitionBy(*way, "place").orderBy("low", "high")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    e = e.withColumn("gap", (c("low") > F.max("high").over(before) + near).cast("int")).withColumn("piece", F.coalesce(F.sum("gap").over(along.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)))
    merged = e.groupBy(*way, "place", "piece").agg(F.first("at").alias("at"), F.min("low").alias("low"), F.max("high").alias("high"))
    return merged.withColumn("edge", c("place").cast("long") * (1 << 31) + c("piece")).select(*way, "at", "low", "high", "edge")


def crossings(lines: DataFrame, near: float = NEAR) -> DataFrame:
    """doc_id, page, level, upright (edge numbers), x, y: where edges cross, cut back until each edge crosses two others or more."""
    c = F.col
    level = lines.where("not upright").select(*_PAGE, c("edge").alias("level"), c("at").alias("y"), c("low").alias("left"), c("high").alias("right"), _strip_of(c("at")).alias("strip"))
    upright = lines.where("upright").select(*_PAGE, c("edge").alias("upright"), c("at").alias("x"), c("low").alias("top"), c("high").alias("bottom"), _strips(c("low") - near, c("high") + near).alias("strip"))
    meet = level.join(upright.hint("merge"), [*_PAGE, "strip"]).where(c("y").between(c("top") - near, c("bottom") + near) & c("x").between(c("left") - near, c("right") + near))
    twice = lambda p, k: p.withColumn("n", F.count("*").over(Window.partitionBy(*_PAGE, k))).where("n > 1").drop("n")
    return twice(twice(meet.select(*_PAGE, "level", "upright", "x", "y"), "level"), "upright")


def with_tables(points: DataFrame) -> DataFrame:
    """Adds `tab`, the least level edge that a crossing's edges are connected with, and `k`, the number of its height within the table.

    Each round carries the least number along all edges at once, so a drawn table takes two or three rounds, whatever its size. The result is in buckets by document.
    So many are gone before crossings are written; pages on which some crossing still changed go on by themselves.
    """
    carried = lambda p: p.withColumn("least", F.min("tab").over(Window.partitionBy(*_PAGE, "upright"))).withColumn("least", F.min("least").over(Window.partitionBy(*_PAGE, "level")))
    further = lambda p: carried(p).withColumn("tab", F.col("least")).drop("least")
    told = lambda p: bucketed(carried(p).withColumns({"open": F.max(F.col("least") < F.col("tab")).over(Window.partitionBy(*_PAGE)), "k": F.dense_rank().over(Window.partitionBy(*_PAGE, "tab").orderBy("y"))}), "crossings", "doc_id")
    now = told(further(further(points.withColumn("tab", F.col("level")))))
    settled, rounds = now.where("not open"), 1
    while not (left := now.where("open")).isEmpty():
        now = told(further(left.withColumn("tab", F.col("least")).drop("least", "open")))
        settled, rounds = settled.unionByName(now.where("not open")), rounds + 1
    settled = settled.drop("least", "open")
    return settled if rounds == 1 else bucketed(by_document(settled), "crossings", "doc_id")


def cells(points: DataFrame) -> DataFrame:
    """doc_id, page, tab, x0, y0, x1, y1 of closed cells, from crossings with their tables and heights."""
    c, tab = F.col, [*_PAGE, "tab"]
    heights = points.select(*tab, "k", "y").distinct()
    lids = points.groupBy(*tab, "level", "k").agg(F.min("x").alias("left"), F.max("x").alias("right"))
    walls = points.groupBy(*tab, "upright").agg(F.first("x").alias("x"), F.min("k").alias("first"), F.max("k").alias("last")).where("last > first")
    walls = walls.select(*tab, c("x").alias("x0"), F.explode(F.sequence("first", c("last") - 1)).alias("k"))
    boxes = walls.withColumn("x1", F.lead("x0").over(Window.partitionBy(*tab, "k").orderBy("x0"))).where("x1 is not null")

    def lid(boxes: DataFrame, below: int, name: str) -> DataFrame:
        over = lids.select(*tab, (c("k") - below).alias("k"), "left", "right", F.lit(True).alias(name))
        held = boxes.join(over.hint("merge"), [*tab, "k"], "left").withColumn(name, F.coalesce(c(name) & (c("left") <= c("x0")) & (c("right") >= c("x1")), F.lit(False)))
        return held.groupBy(*boxes.columns).agg(F.max(name).alias(name))

    boxes = lid(lid(boxes, 0, "above"), 1, "below")
    column = Window.partitionBy(*tab, "x0", "x1").orderBy("k")
    goes_on = (F.lag("k").over(column) == c("k") - 1) & ~c("above")
    runs = boxes.withColumn("run", F.sum((~F.coalesce(goes_on, F.lit(False))).cast("int")).over(column))
    runs = runs.groupBy(*tab, "x0", "x1", "run").agg(F.min("k").alias("k"), F.max("k").alias("last"), F.min_by("above", "k").alias("above"), F.max_by("below", "k").alias("below")).where("above and below")
    top, bottom = heights.withColumnRenamed("y", "y0"), heights.select(*tab, (c("k") - 1).alias("last"), c("y").alias("y1"))
    return runs.join(top.hint("merge"), [*tab, "k"]).join(bottom.hint("merge"), [*tab, "last"]).select(*tab, "x0", "y0", "x1", "y1")


def cell_texts(boxes: DataFrame, spans: DataFrame, near: float = NEAR) -> DataFrame:
    """Boxes (doc_id, page, tab, x0, y0, x1, y1) with the text of the spans whose middle lies within, line by line."""
    c = F.col
    said = spans.where("text is not null").select(*_PAGE, ((c("x0") + c("x1")) / 2).alias("x"), ((c("y0") + c("y1")) / 2).alias("y"), c("x0").alias("from"), c("text").alias("word"))
    dealt = boxes.select("*", _strips(c("y0"), c("y1")).alias("strip"))
    key = boxes.columns
    inside = dealt.join(said.withColumn("strip", _strip_of(c("y"))).hint("merge"), [*_PAGE, "strip"]).where((c("x") >= c("x0")) & (c("x") < c("x1")) & (c("y") >= c("y0")) & (c("y") < c("y1")))
    down = Window.partitionBy(*key).orderBy("y", "from", "word")
    lined = inside.withColumn("jump", F.coalesce(c("y") - F.lag("y").over(down) > near, F.lit(False)).cast("int")).withColumn("line", F.sum("jump").over(down.rowsBetween(Window.unboundedPreceding, 0)))
    rows = lined.groupBy(*key, "line").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("from", "y", "word"))), lambda x: x["word"]), " ").alias("row"))
    texts = rows.groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "row"))), lambda x: x["row"]), "\n").alias("text"))
    return boxes.join(texts.hint("merge"), key, "left").withColumn("text", strip(F.coalesce("text", F.lit(""))))


def by_document(rows: DataFrame) -> DataFrame:
    """Rows dealt by their document; with this setting all that follows by it and more keys, joins too, needs no further dealing."""
    rows.sparkSession.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    return rows.repartition("doc_id")


def tables(rules: DataFrame, spans: DataFrame, dealt: bool = False) -> DataFrame:
    """doc_id, table_no, row_no, cells: the rows of all tables of more than one cell, for `spans.table_rows`.

    Tables are numbered by page, then from the top, then from the left; a row holds the cells that begin at one height, under the
    columns at which any cell of the table begins; a place that another cell covers is empty. dealt: rules and spans come from `by_document` already.
    """
    c, tab = F.col, [*_PAGE, "tab"]
    rules, spans = (rules, spans) if dealt else (by_document(rules), by_document(spans))
    found = cell_texts(cells(with_tables(crossings(edges(rules)))), spans)
    whole = Window.partitionBy(*tab)
    found = found.withColumns({"n": F.count("*").over(whole), "row_no": F.dense_rank().over(whole.orderBy("y0")) - 1, "column": F.dense_rank().over(whole.orderBy("x0")) - 1}).where("n > 1")
    found = bucketed(found.withColumn("width", F.max("column").over(whole) + 1), "cells", "doc_id")
    first = found.groupBy(*tab).agg(F.min(F.struct("y0", "x0")).alias("corner"))
    numbered = first.withColumn("table_no", F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "corner", "tab")) - 1).drop("corner")
    held = F.map_from_entries(F.array_sort(F.collect_list(F.struct("column", "text"))))
    rows = found.groupBy(*tab, "row_no").agg(F.first("width").alias("width"), held.alias("held"))
    line = F.transform(F.sequence(F.lit(0), c("width") - 1), lambda k: F.coalesce(F.try_element_at("held", k), F.lit("")))
    return rows.join(numbered.hint("merge"), tab).select("doc_id", "table_no", "row_no", line.alias("cells"))


def _let(value: Column, then) -> Column:
    """What `then` makes of a value, which is worked out once and, unlike an array's item in a transform, not copied."""
    return F.aggregate(F.array().cast("array<int>"), value, lambda v, x: v, then)


def _runs(items: Column, breaks, then) -> Column:
    """What `then` makes of items that follow each other; `breaks` tells of an item and its next whether new ones begin between them."""
    ends = _ends(F.size(items), lambda i: breaks(F.get(items, i - 1), F.get(items, i)))
    return _let(ends, lambda at: F.transform(at, lambda end, j: _let(_start(at, j), lambda start: _let(F.slice(items, start + 1, end - start), then))))


def _ends(n: Column, breaks) -> Column:
    """The places, counted from 1, at which runs of n items end; `breaks` tells of a place whether one ends there."""
    return F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: (i <= n) & ((i == n) | breaks(i)))


def _start(ends: Column, j: Column) -> Column:
    return F.coalesce(F.get(ends, j - 1), F.lit(0))


def _named(**parts: Column) -> Column:
    return F.struct(*(v.alias(k) for k, v in parts.items()))


def _step(held: DataFrame, *drop: str, **made) -> DataFrame:
    """Adds to the struct `s` what is made of it. Steps follow each other, as the analyser doesn't resolve all of them within one expression."""
    names = [k for k in held.schema["s"].dataType.names if k not in (*drop, *made)]
    return held.withColumn("s", _let(F.col("s"), lambda s: _named(**{k: s[k] for k in names}, **{k: f(s) for k, f in made.items()})))


def _first(items: Column) -> Column:
    return F.get(items, F.lit(0))


def _last(items: Column) -> Column:
    return F.element_at(items, -1)


def _held_edges(rules: Column, upright: bool, near: float) -> Column:
    """at, low, high of the edges that rules draw in one direction, in order."""
    place, along = ("x", "y") if upright else ("y", "x")
    thin = lambda r, k: F.abs(r[k + "1"] - r[k + "0"]) <= near
    edge = lambda r, at: _named(at=at, low=F.least(r[along + "0"], r[along + "1"]), high=F.greatest(r[along + "0"], r[along + "1"]))
    lines, boxes = F.filter(rules, lambda r: thin(r, place) & ~thin(r, along)), F.filter(rules, lambda r: ~thin(r, place) & ~thin(r, along))
    drawn = lambda rs, at: F.transform(rs, lambda r: edge(r, at(r[place + "0"], r[place + "1"])))
    return F.sort_array(F.concat(drawn(lines, lambda a, b: (a + b) / 2), drawn(boxes, lambda a, b: a), drawn(boxes, lambda a, b: b)))


def _merged(place: Column, near: float) -> Column:
    """at, low, high: what `edges` makes of the edges at one place, in order of their numbers.

    Lows and highs are in order each by themselves: if all of the first edges end before the next begins, their highs are the first of all highs.
    """
    at = F.aggregate(place["at"], F.lit(0.0), lambda s, a: s + a) / F.size(place)
    gaps = lambda lows, highs: _ends(F.size(lows), lambda i: F.get(lows, i) > F.get(highs, i - 1) + near)
    cut = lambda a, lows, highs, ends: F.transform(ends, lambda end, j: _named(at=a, low=F.get(lows, _start(ends, j)), high=F.get(highs, end - 1)))
    pieces = lambda a, lows, highs: _let(gaps(lows, highs), lambda ends: cut(a, lows, highs, ends))
    return _let(at, lambda a: _let(F.sort_array(place["low"]), lambda lows: _let(F.sort_array(place["high"]), lambda highs: pieces(a, lows, highs))))


def _connected(rows: Column) -> Column:
    """us, levels: the level edges (level, y, met) of a page by the table they are in, and the numbers of its uprights."""
    none = F.array().cast("array<struct<us:array<int>,levels:array<struct<level:int,y:double,met:array<struct<u:int,x:double,low:double,high:double>>>>>>")

    def taken(held: Column, row: Column) -> Column:
        meets = lambda t: F.arrays_overlap(t["us"], row["met"]["u"])
        whole = lambda hit: _named(us=F.array_union(F.flatten(hit["us"]), row["met"]["u"]), levels=F.array_append(F.flatten(hit["levels"]), row))
        return F.array_append(F.filter(held, lambda t: ~meets(t)), _let(F.filter(held, meets), whole))

    return F.aggregate(rows, none, taken)


def _boxes(heights: Column, walls: Column) -> Column:
    """x0, x1, k, above, below of the boxes between neighbouring walls (x, first, last) of each band of a table, in order."""
    closed = lambda k, x0, x1: F.exists(F.get(heights, k)["lids"], lambda e: (e["left"] <= x0) & (e["right"] >= x1))
    box = lambda k, x0, x1: _named(x0=x0, x1=x1, k=k, above=closed(k, x0, x1), below=closed(k + 1, x0, x1))
    between = lambda ws, k: F.transform(F.slice(ws, F.lit(1), F.greatest(F.size(ws) - 1, F.lit(0))), lambda w, i: box(k, w["x"], F.get(ws, i + 1)["x"]))
    band = lambda k: _let(F.filter(walls, lambda w: (w["first"] <= k) & (w["last"] > k)), lambda ws: between(ws, k))
    bands = F.filter(F.sequence(F.lit(0), F.size(heights)), lambda k: k < F.size(heights) - 1)
    return F.sort_array(F.flatten(F.transform(bands, band)))


def _text(cell: Column, said: Column, near: float) -> Column:
    """The text of a cell, from spans (y, from, word, x) in order."""
    inside = F.filter(said, lambda s: (s["y"] >= cell["y0"]) & (s["y"] < cell["y1"]) & (s["x"] >= cell["x0"]) & (s["x"] < cell["x1"]))
    line = lambda run: F.array_join(F.sort_array(F.transform(run, lambda s: F.struct(s["from"].alias("from"), s["y"].alias("y"), s["word"].alias("word"))))["word"], " ")
    text = lambda ss: F.when(F.size(ss) < 2, F.coalesce(_first(ss)["word"], F.lit(""))).otherwise(F.array_join(_runs(ss, lambda s, t: t["y"] - s["y"] > near, line), "\n"))
    return strip(_let(inside, text))


def _held_points(pages: DataFrame, near: float) -> DataFrame:
    """Pages with said, uprights (u, x, low, high) and tables (us, levels): what `with_tables` tells of their crossings."""
    whole = lambda r: r["x0"].isNotNull() & r["y0"].isNotNull() & r["x1"].isNotNull() & r["y1"].isNotNull()
    doubles = lambda rs: rs if pages.schema["rules"].dataType.elementType.simpleString() == _RULE else F.transform(rs, lambda r: F.struct(*(r[k].cast("double").alias(k) for k in ("x0", "y0", "x1", "y1"))))
    middle = lambda s, k: ((s[k + "0"] + s[k + "1"]) / 2).alias(k)
    held = _step(
        pages.select("doc_id", "page", F.struct("rules", "spans").alias("s")),
        "spans",
        rules=lambda s: F.sort_array(doubles(F.filter(s["rules"], whole))),
        said=lambda s: F.sort_array(F.transform(F.filter(s["spans"], lambda w: w["text"].isNotNull()), lambda w: F.struct(middle(w, "y"), w["x0"].alias("from"), w["text"].alias("word"), middle(w, "x")))),
    )
    held = _step(held, rules=lambda s: F.filter(s["rules"], lambda r, i: (i == 0) | (r != F.get(s["rules"], i - 1))))
    held = _step(held, "rules", levels=lambda s: _held_edges(s["rules"], False, near), uprights=lambda s: _held_edges(s["rules"], True, near))
    snapped = lambda es: F.flatten(_runs(es, lambda e, f: f["at"] - e["at"] > near, lambda place: _merged(place, near)))
    held = _step(held, levels=lambda s: snapped(s["levels"]), uprights=lambda s: snapped(s["uprights"]))
    held = _step(held, uprights=lambda s: F.transform(s["uprights"], lambda e, i: _named(u=i, x=e["at"], low=e["low"], high=e["high"])))
    crosses = lambda e, u: (u["low"] - near <= e["at"]) & (e["at"] <= u["high"] + near) & (e["low"] - near <= u["x"]) & (u["x"] <= e["high"] + near)
    met = lambda s: F.transform(s["levels"], lambda e, i: _named(level=i, y=e["at"], met=F.filter(s["uprights"], lambda u: crosses(e, u))))
    held = _step(held, levels=lambda s: F.filter(met(s), lambda r: F.size(r["met"]) > 1))
    held = _step(held, seen=lambda s: F.flatten(s["levels"]["met"])["u"])
    held = _step(held, "seen", lost=lambda s: F.filter(s["uprights"]["u"], lambda u: F.size(F.filter(s["seen"], lambda x: x == u)) == 1))
    left = lambda s, r: F.filter(r["met"], lambda m: ~F.array_contains(s["lost"], m["u"]))
    cut = lambda s: F.filter(F.transform(s["levels"], lambda r: _named(level=r["level"], y=r["y"], met=left(s, r))), lambda r: F.size(r["met"]) > 0)
    held = _step(held, "lost", levels=lambda s: F.when(F.size(s["lost"]) == 0, s["levels"]).otherwise(cut(s)))
    return _step(held, "levels", tables=lambda s: _connected(s["levels"]))


def _held_cells(tables: DataFrame) -> DataFrame:
    """Tables with cells (y0, x0, y1, x1) in order: what `cells` finds between their levels and uprights."""
    lid = lambda r: _named(left=_first(r["met"])["x"], right=_last(r["met"])["x"])
    height = lambda rows: _named(y=_first(rows)["y"], lids=F.transform(rows, lid), us=F.flatten(rows["met"])["u"])
    held = _step(tables, "levels", heights=lambda s: _runs(s["levels"], lambda r, t: r["y"] != t["y"], height))
    at = lambda s, u: F.filter(F.sequence(F.lit(0), F.size(s["heights"]) - 1), lambda k: F.array_contains(F.get(s["heights"], k)["us"], u["u"]))
    wall = lambda s, u: _let(at(s, u), lambda ks: _named(x=u["x"], first=_first(ks), last=_last(ks)))
    own = lambda s: F.transform(F.filter(s["uprights"], lambda u: F.array_contains(s["us"], u["u"])), lambda u: wall(s, u))
    held = _step(held, "us", "uprights", walls=lambda s: F.filter(own(s), lambda w: w["last"] > w["first"]))
    held = _step(held, "walls", cells=lambda s: _boxes(s["heights"], s["walls"]))
    ends = lambda a, b: b["above"] | (a["k"] + 1 != b["k"]) | (a["x0"] != b["x0"]) | (a["x1"] != b["x1"])
    cell = lambda s, a, b: F.when(a["above"] & b["below"], _named(y0=F.get(s["heights"], a["k"])["y"], x0=a["x0"], y1=F.get(s["heights"], b["k"] + 1)["y"], x1=a["x1"]))
    held = _step(held, cells=lambda s: _runs(s["cells"], ends, lambda run: cell(s, _first(run), _last(run))))
    return _step(held, "heights", cells=lambda s: F.sort_array(F.filter(s["cells"], lambda c: c.isNotNull())))


def held_tables(pages: DataFrame, near: float = NEAR) -> DataFrame:
    """What `tables` gives, from pages that are a row each: doc_id, page, and arrays of its rules and spans with the places and texts above."""
    points = _held_points(pages.where("doc_id is not null and page is not null"), near)
    # inner explodes and filters would have arrays worked out twice, for the filters that Spark infers from them or pushes down
    each = points.select("doc_id", "page", "s.said", "s.uprights", F.explode_outer("s.tables").alias("t"))
    held = _held_cells(each.select("doc_id", "page", _named(said=F.col("said"), uprights=F.col("uprights"), us=F.col("t.us"), levels=F.sort_array("t.levels"), tab=F.array_min("t.levels.level")).alias("s")))
    held = _step(held, lefts=lambda s: F.sort_array(F.array_distinct(s["cells"]["x0"])))
    text = lambda s, row, x: _let(_first(F.filter(row, lambda c: c["x0"] == x)), lambda c: F.when(c.isNotNull(), _text(c, s["said"], near)))
    rows = lambda s: _runs(s["cells"], lambda c, d: c["y0"] != d["y0"], lambda row: F.transform(s["lefts"], lambda x: F.coalesce(text(s, row, x), F.lit(""))))
    held = _step(held, "said", "lefts", "cells", corner=lambda s: _first(s["cells"]), rows=lambda s: F.when(F.size(s["cells"]) > 1, rows(s)))
    held = held.select("doc_id", "page", "s.*")
    order = Window.partitionBy("doc_id").orderBy(F.col("rows").isNull(), "page", "corner.y0", "corner.x0", "tab")
    numbered = held.select("doc_id", "rows", (F.row_number().over(order) - 1).alias("table_no"))
    return numbered.select("doc_id", "table_no", F.posexplode_outer("rows").alias("row_no", "cells")).where("row_no is not null")
