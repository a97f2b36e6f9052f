"""Queries over pages that are drawn from line items: ruling lines and spans, and their tables; the same results in SQL by another way."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scrivel.functions.text import SPACES
from scrivel.plans.inputs import PLACE, made, pick, q
from scrivel.plans.registry import CLEAN_SQL, query
from scrivel.sources import grid, spans
from scrivel.streaming.shared import bucketed

#: Line items up to which a document is held as one row; longer ones are drawn as rows.
HELD = 64
_ROWS = made("lineitem", doc_id="cast(l_orderkey as string)", n=PLACE, part="cast(l_partkey as bigint)", supp="cast(l_suppkey as bigint)", quantity="cast(cast(l_quantity as int) as string)", odd="l_orderkey % 2 = 1")
#: A row of the left table is one cell, two, or three; rows of three may share their first cell with the next row.
_FREE = "supp % 4 >= 2"
_TOP, _SHAKE = "(100 + 20 * k)", "((part % 3 - 1) * 0.5)"
_RULES = [
    ("true", f"CASE WHEN open_before THEN 150 ELSE 50 END + {_SHAKE}", f"{_TOP}", "CASE WHEN part % 7 = 0 THEN 250 ELSE 350 END", f"{_TOP} + 0.4"),
    ("part % 7 = 0", "249", f"{_TOP} + {_SHAKE}", "350", f"{_TOP} + {_SHAKE}"),
    ("true", f"50 + {_SHAKE}", _TOP, "50", f"{_TOP} + 20"),
    ("supp % 4 >= 1", "150", f"{_TOP} + 20", f"150 + {_SHAKE}", _TOP),
    (_FREE, f"250 - {_SHAKE}", f"{_TOP} - 1", "250", f"{_TOP} + 21"),
    ("true", f"350 + {_SHAKE}", _TOP, f"350 + {_SHAKE}", f"{_TOP} + CASE WHEN closing AND supp % 6 = 0 THEN 28 ELSE 20 END"),
    ("closing", "48", f"{_TOP} + 20", "352", f"{_TOP} + 20"),
    ("NOT odd OR k = 0", "400", f"{_TOP} + 5", "480", f"{_TOP} + 25"),
    ("NOT odd", "480", f"{_TOP} + 5", "560", f"{_TOP} + 25"),
    ("k = 0", "0", "20", "500", "20"),
    ("k = 1", "10", "20", "cast(null as double)", "20"),
]
_WORDS = pick("part", q("TRUE"), q("Page 1 of 2"), q("Acme"), q(" Hue\t"), "cast(null as string)", q("From *"), q(""))
_SPANS = [
    ("true", "90", "110", f"{_TOP} + 4", "CASE WHEN part % 4 = 0 THEN '____' ELSE concat('r', cast(part as string)) END"),
    ("true", "160", "240", f"{_TOP} + 5", _WORDS),
    ("part % 3 = 0", "255", "300", f"{_TOP} + 1", "quantity"),
    ("part % 3 = 0", "302", "340", f"{_TOP} + 9", "'pcs'"),
    ("true", "410", "470", f"{_TOP} + 9", "concat('n', cast(supp as string))"),
    ("NOT odd", "470", "492", f"{_TOP} + 9", "'edge'"),
]


def _numbered(spark: SparkSession, sf: str) -> DataFrame:
    order = Window.partitionBy("doc_id").orderBy("n", "quantity")
    shares = F.expr(f"part % 5 = 0 AND {_FREE}")
    rows = _ROWS[0](spark, sf).withColumns({"k": F.row_number().over(order) - 1, "open": F.coalesce(shares & F.lead(F.expr(_FREE)).over(order), F.lit(False)), "closing": F.lead("n").over(order).isNull(), "size": F.count("*").over(Window.partitionBy("doc_id"))})
    return bucketed(rows.withColumns({"open_before": F.coalesce(F.lag("open").over(order), F.lit(False)), "page": F.lit(0)}), "rows", "doc_id")


_NUMBERED = f"""numbered AS (SELECT *, coalesce(lag(open) OVER w, false) AS open_before FROM (SELECT *, row_number() OVER w - 1 AS k, coalesce(part % 5 = 0 AND {_FREE} AND lead({_FREE}) OVER w, false) AS open, lead(n) OVER w IS NULL AS closing FROM {_ROWS[1]} WINDOW w AS (PARTITION BY doc_id ORDER BY n, quantity)) WINDOW w AS (PARTITION BY doc_id ORDER BY n, quantity))"""
_AS_RULES = [(w, ("doc_id", "0 AS page", f"cast({a} as double) AS x0", f"cast({b} as double) AS y0", f"cast({x} as double) AS x1", f"cast({y} as double) AS y1")) for w, a, b, x, y in _RULES]
_AS_SPANS = [(w, ("doc_id", "0 AS page", f"cast({a} as double) AS x0", f"cast({y} as double) AS y0", f"cast({b} as double) AS x1", f"cast({y} + 6 as double) AS y1", f"{t} AS text")) for w, a, b, y, t in _SPANS]


def _drawn(rows: DataFrame, parts: list) -> DataFrame:
    """What is drawn for each row, in one pass."""
    drawn = [f"CASE WHEN {w} THEN struct({', '.join(e[2:])}) END" for w, e in parts]
    return rows.selectExpr("doc_id", "page", f"explode_outer(array_compact(array({', '.join(drawn)}))) AS e").selectExpr("doc_id", "page", "e.*").where("y0 is not null")


def _held(rows: DataFrame) -> DataFrame:
    """What is drawn for the line items of a document, as one row: the rules and spans of its one page."""
    names = [k for k in rows.columns if k not in ("doc_id", "page", "size", "n")]
    of_item = lambda e: re.sub(rf"'[^']*'|\b({'|'.join(names)})\b", lambda m: f"i.{m[1]}" if m[1] else m[0], e)
    drawn = lambda parts: f"flatten(transform(items, i -> array_compact(array({', '.join(f'CASE WHEN {of_item(w)} THEN struct({', '.join(map(of_item, e[2:]))}) END' for w, e in parts)}))))"
    items = rows.groupBy("doc_id").agg(F.collect_list(F.struct(*names)).alias("items"))
    return items.selectExpr("doc_id", "0 AS page", f"{drawn(_AS_RULES)} AS rules", f"{drawn(_AS_SPANS)} AS spans")


def _tables(spark: SparkSession, sf: str) -> DataFrame:
    """Short line items are dealt by document, once, not the edges and spans that are drawn from them."""
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    rows = _numbered(spark, sf)
    held, long = grid.held_tables(_held(rows.where(F.col("size") <= HELD))), rows.where(F.col("size") > HELD)
    return held if long.isEmpty() else held.unionByName(grid.tables(_drawn(long, _AS_RULES), _drawn(long, _AS_SPANS), dealt=True))


def _drawn_sql(parts: list) -> str:
    return " UNION ALL ".join(f"SELECT {', '.join(e)} FROM numbered WHERE {w}" for w, e in parts)


_N = grid.NEAR
#: Cells by their corners: of each crossing the first crossing below it, then the first to its right, whose fourth corner is there.
_GRID = f"""{_NUMBERED}, rules AS (SELECT DISTINCT * FROM ({_drawn_sql(_AS_RULES)}) WHERE x1 IS NOT NULL), spans AS ({_drawn_sql(_AS_SPANS)}),
kinds AS (SELECT *, abs(y1 - y0) <= {_N} AS lies, abs(x1 - x0) <= {_N} AS stands FROM rules),
e0 AS (SELECT doc_id, false AS up, (y0 + y1) / 2 AS spot, least(x0, x1) AS low, greatest(x0, x1) AS high FROM kinds WHERE lies AND NOT stands
 UNION ALL SELECT doc_id, true, (x0 + x1) / 2, least(y0, y1), greatest(y0, y1) FROM kinds WHERE stands AND NOT lies
 UNION ALL SELECT doc_id, u, spot, CASE WHEN u THEN y0 ELSE x0 END, CASE WHEN u THEN y1 ELSE x1 END FROM (SELECT *, unnest([true, true, false, false]) AS u, unnest([x0, x1, y0, y1]) AS spot FROM kinds WHERE NOT lies AND NOT stands)),
e1 AS (SELECT *, sum(j) OVER (PARTITION BY doc_id, up ORDER BY spot) AS place FROM (SELECT *, CASE WHEN spot - lag(spot) OVER (PARTITION BY doc_id, up ORDER BY spot) > {_N} THEN 1 ELSE 0 END AS j FROM e0)),
e2 AS (SELECT *, sum(g) OVER (PARTITION BY doc_id, up, place ORDER BY low, high ROWS UNBOUNDED PRECEDING) AS piece FROM (SELECT *, CASE WHEN low > max(high) OVER (PARTITION BY doc_id, up, place ORDER BY low, high ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + {_N} THEN 1 ELSE 0 END AS g FROM e1)),
e AS (SELECT doc_id, up, avg(avg(spot)) OVER (PARTITION BY doc_id, up, place) AS spot, min(low) AS low, max(high) AS high, place * 1000 + piece AS edge FROM e2 GROUP BY doc_id, up, place, piece),
p AS (SELECT h.doc_id, h.edge AS level, v.edge AS upright, v.spot AS x, h.spot AS y FROM e h JOIN e v ON h.doc_id = v.doc_id AND NOT h.up AND v.up AND h.spot BETWEEN v.low - {_N} AND v.high + {_N} AND v.spot BETWEEN h.low - {_N} AND h.high + {_N}),
corners AS (SELECT p.doc_id, p.level, p.x AS x0, p.y AS y0, r.x AS x1, b.y AS y1 FROM p JOIN p b ON b.doc_id = p.doc_id AND b.upright = p.upright AND b.y > p.y JOIN p r ON r.doc_id = p.doc_id AND r.level = p.level AND r.x > p.x
 JOIN p f ON f.doc_id = p.doc_id AND f.level = b.level AND f.upright = r.upright QUALIFY row_number() OVER (PARTITION BY p.doc_id, p.level, p.upright ORDER BY b.y, r.x) = 1),
linked AS (SELECT doc_id, level AS a, level AS b FROM p UNION SELECT linked.doc_id, a, p2.level FROM linked JOIN p p1 ON p1.doc_id = linked.doc_id AND p1.level = b JOIN p p2 ON p2.doc_id = p1.doc_id AND p2.upright = p1.upright),
tab AS (SELECT doc_id, a AS level, min(b) AS tab FROM linked GROUP BY 1, 2),
cells AS (SELECT *, row_number() OVER () AS id FROM (SELECT c.doc_id, tab, x0, y0, x1, y1, count(*) OVER (PARTITION BY c.doc_id, tab) AS n FROM corners c JOIN tab t ON t.doc_id = c.doc_id AND t.level = c.level) WHERE n > 1),
said AS (SELECT id, s.x0 AS from_, (s.y0 + s.y1) / 2 AS y, text FROM cells c JOIN spans s ON s.doc_id = c.doc_id AND s.text IS NOT NULL AND (s.x0 + s.x1) / 2 >= c.x0 AND (s.x0 + s.x1) / 2 < c.x1 AND (s.y0 + s.y1) / 2 >= c.y0 AND (s.y0 + s.y1) / 2 < c.y1),
lined AS (SELECT *, sum(j) OVER (PARTITION BY id ORDER BY y, from_, text ROWS UNBOUNDED PRECEDING) AS line FROM (SELECT *, CASE WHEN y - lag(y) OVER (PARTITION BY id ORDER BY y, from_, text) > {_N} THEN 1 ELSE 0 END AS j FROM said)),
texts AS (SELECT id, string_agg(t, chr(10) ORDER BY line) AS t FROM (SELECT id, line, string_agg(text, ' ' ORDER BY from_, y, text) AS t FROM lined GROUP BY 1, 2) GROUP BY 1),
placed AS (SELECT c.doc_id, c.tab, dense_rank() OVER (PARTITION BY c.doc_id, c.tab ORDER BY y0) - 1 AS row_no, dense_rank() OVER (PARTITION BY c.doc_id, c.tab ORDER BY x0) - 1 AS col, trim(coalesce(t, ''), {q(SPACES)}) AS t FROM cells c LEFT JOIN texts USING (id)),
numbers AS (SELECT doc_id, tab, row_number() OVER (PARTITION BY doc_id ORDER BY corner) - 1 AS table_no FROM (SELECT doc_id, tab, min(ROW(y0, x0)) AS corner FROM cells GROUP BY 1, 2)),
wide AS (SELECT doc_id, tab, max(col) AS w FROM placed GROUP BY 1, 2),
lines AS (SELECT doc_id, tab, row_no, map_from_entries(list(ROW(col, t))) AS m FROM placed GROUP BY 1, 2, 3),
found AS (SELECT l.doc_id, CAST(table_no AS INTEGER) AS table_no, CAST(row_no AS INTEGER) AS row_no, list_transform(range(0, w + 1), lambda k: coalesce(m[k], '')) AS cells FROM lines l JOIN numbers USING (doc_id, tab) JOIN wide USING (doc_id, tab))"""


@query(f"WITH RECURSIVE {_GRID} SELECT * FROM found")
def src3_cell_grid(spark, sf):
    return _tables(spark, sf)


@query(f"WITH RECURSIVE {_GRID} SELECT * FROM found WHERE len(list_filter(cells, lambda x: {CLEAN_SQL('x')})) > 0")
def src3_page_tables(spark, sf):
    """The cell grid of each page as the rows that parsers read."""
    return spans.table_rows(_tables(spark, sf))
