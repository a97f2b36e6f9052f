"""Which click a sale is owed to, by a stateful stream that is restarted for every batch of arrivals.

Clicks are keyed by (client, day). A sale is sent to the eight days that its seven days reach into, so that no client, however
busy, has its clicks in one place. When a sale closes, each of its keys tells the last click and the number of clicks that lie
within the sale's span on that day, and the reducer that follows takes the latest and the sum. Keys are dealt to shards; the state
of a shard holds its keys' clicks and open sales as flat arrays, and a shard's work is a sort and three searches in it.

How far time has come (`W`) is known for each batch from the batches before it: the smaller of the largest click time and the
largest sale time over all clients, less a delay. Every shard that holds something is called in every batch, by a timeout if no
row reaches it, so sales close in the first batch whose W is beyond them.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

from scrivel.llm.common import crc_sql, discard, persist, prepare, shared_dir

HOUR, DAY = 3_600_000_000, 86_400_000_000
SPAN, DELAY = 7 * DAY, DAY
BATCHES = 8
LATE_HOURS = 240
#: A shard gets about so many rows in all batches together.
SHARD_ROWS = 50_000
#: A file of a batch gets about so many rows.
FILE_ROWS = 250_000
NEVER, EVER = -(1 << 62), 1 << 62

_CLICK = np.dtype([("client", "<i8"), ("day", "<i8"), ("at", "<i8"), ("id", "<i8"), ("known", "<i8")])
_SALE = np.dtype([("client", "<i8"), ("day", "<i8"), ("at", "<i8"), ("id", "<i8"), ("known", "<i8"), ("copies", "<i8")])
_PART = "client long, at long, id long, known boolean, copies long, late boolean, last_at long, last_known boolean, last_id long, n long"


def micros(frame: DataFrame, name: str) -> Column:
    """Microseconds since 1970. Times without a zone are taken as they stand, whatever the zone of the session."""
    c = F.col(name)
    if dict(frame.dtypes)[name] != "timestamp_ntz":
        return F.unix_micros(c.cast("timestamp"))
    seconds = F.datediff(c.cast("date"), F.lit("1970-01-01").cast("date")).cast("long") * 86_400 + F.hour(c) * 3_600 + F.minute(c) * 60
    return seconds * 1_000_000 + (F.expr(f"extract(SECOND FROM `{name}`)") * 1_000_000).cast("long")


def _hours(frame: DataFrame, id_column: str) -> Column:
    """Whole hours of arrival; every fourth id, by checksum, comes ten days late. Rows without an arrival come first."""
    late = F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 4 == 0, F.lit(False))
    return F.floor(F.col("arrived") / HOUR) + F.when(late, LATE_HOURS).otherwise(0)


def cut(clicks: DataFrame, sales: DataFrame, batches: int = BATCHES) -> tuple[DataFrame, DataFrame]:
    """(clicks, sales) as one row for each click_id, and for each sale with the number of its copies; `batch` by the hour of arrival.

    Rows without a client or a time are dropped. Of rows that share a click_id the one with the least client, time and
    arrival stays; a null click_id is an id of its own. Columns: id, client, at, batch, and copies of sales.
    """
    c = F.col
    one = clicks.select(c("click_id").cast("long").alias("id"), c("client_id").cast("long").alias("client"), micros(clicks, "ts").alias("at"), micros(clicks, "arrived_at").alias("arrived"))
    one = one.where("client is not null and at is not null").groupBy("id").agg(F.min(F.struct("client", "at", "arrived")).alias("r")).select("id", "r.*")
    one = persist(one.withColumn("h", _hours(one, "id")), "clicks")
    lo, hi = one.agg(F.min("h"), F.max("h")).first()
    lo, hi = (0, 0) if lo is None else (lo, hi)
    batch = F.coalesce(F.floor((c("h") - lo) * batches / (hi - lo + 1)), F.lit(0))
    sold = sales.select(c("sale_id").cast("long").alias("id"), c("client_id").cast("long").alias("client"), micros(sales, "sold_at").alias("at"), micros(sales, "arrived_at").alias("arrived"))
    sold = sold.where("client is not null and at is not null").withColumn("h", _hours(sold, "id"))
    sold = sold.withColumn("batch", F.least(F.greatest(batch, F.lit(0)), F.lit(batches - 1)).cast("int")).groupBy("id", "client", "at", "batch").agg(F.count("*").alias("copies"))
    return one.select("id", "client", "at", batch.cast("int").alias("batch")), persist(sold, "sales")


def horizons(clicks: DataFrame, sales: DataFrame, batches: int = BATCHES, delay: int = DELAY) -> list[int]:
    """W of each batch, from the batches before it: NEVER until both a click and a sale have come. Two numbers a batch reach the driver."""
    by = {x: dict(t.groupBy("batch").agg(F.max("at")).collect()) for x, t in (("click", clicks), ("sale", sales))}
    out, most = [], {"click": NEVER, "sale": NEVER}
    for b in range(batches):
        out.append(NEVER if NEVER in most.values() else min(most.values()) - delay)
        most = {x: max(v, by[x].get(b, NEVER)) for x, v in most.items()}
    return out


def _shard(shards: int) -> Column:
    return F.pmod(F.xxhash64("client", "day"), F.lit(shards)).cast("int")


def keyed(clicks: DataFrame, sales: DataFrame, shards: int) -> DataFrame:
    """Clicks by (client, day) and each sale once for every day that its span reaches into."""
    c = F.col
    day = F.expr(f"cast(floor(at / {DAY}D) as long)")
    left = clicks.withColumn("day", day).select(_shard(shards).alias("shard"), F.lit(False).alias("sale"), "client", "day", "at", "id", F.lit(1).cast("long").alias("copies"))
    days = F.sequence(F.expr(f"cast(floor((at - {SPAN}) / {DAY}D) as long)"), day)
    right = sales.withColumn("day", F.explode(days)).select(_shard(shards).alias("shard"), F.lit(True).alias("sale"), "client", "day", "at", "id", c("copies").cast("long").alias("copies"))
    return left.unionByName(right)


def _codes(clicks: np.ndarray, sales: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number for each (client, day), in order, for the rows of both."""
    keys = np.concatenate([clicks[["client", "day"]], sales[["client", "day"]]])
    _, code = np.unique(keys, return_inverse=True)
    return code[: len(clicks)], code[len(clicks) :]


def last_and_count(clicks: np.ndarray, sales: np.ndarray, span: int = SPAN) -> tuple[np.ndarray, np.ndarray]:
    """For each sale: the place of its last click among `clicks` on its (client, day), and the number of those within the span.

    Ties of a time go to the larger id; the place means nothing where the number is zero. clicks must be sorted by
    client, day, at, known and id.
    """
    code, of = _codes(clicks, sales)
    within = lambda at, day: np.clip(at - day * DAY, -1, DAY) + 1  # noqa: E731  a time of the day; 0 and DAY + 1 stand for before and after
    place = code.astype(np.int64) << 38 | within(clicks["at"], clicks["day"])
    first = np.searchsorted(place, of.astype(np.int64) << 38 | within(sales["at"] - span, sales["day"]), "left")
    end = np.searchsorted(place, of.astype(np.int64) << 38 | within(sales["at"], sales["day"]), "right")
    return end - 1, end - first


def _step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState, w: int, span: int) -> Iterator[pd.DataFrame]:
    """One shard in one batch: discard, tell late sales, buffer, close, evict."""
    held_clicks, held_sales = state.get if state.exists else (b"", b"")
    clicks, sales = [np.frombuffer(held_clicks, dtype=_CLICK)], [np.frombuffer(held_sales, dtype=_SALE)]
    late = []
    for frame in frames if not state.hasTimedOut else ():
        known = frame["id"].notna().to_numpy()
        columns = {x: frame[x].to_numpy() for x in ("client", "day", "at", "copies")} | {"id": frame["id"].fillna(0).to_numpy().astype(np.int64), "known": known}
        is_sale, early = frame["sale"].to_numpy(dtype=bool), columns["at"] < w
        for where, kind, to in ((~is_sale & ~early, _CLICK, clicks), (is_sale & ~early, _SALE, sales), (is_sale & early, _SALE, late)):
            rows = np.empty(int(where.sum()), dtype=kind)
            for x in kind.names:
                rows[x] = columns[x][where]
            to.append(rows)
    clicks, sales = np.concatenate(clicks), np.concatenate(sales)
    clicks = clicks[np.lexsort((clicks["id"], clicks["known"], clicks["at"], clicks["day"], clicks["client"]))]
    closing = sales["at"] < w
    done, sales = sales[closing], sales[~closing]
    if len(done):
        at, n = last_and_count(clicks, done, span)
        # A key without clicks says nothing, but for the day of the sale itself, so that every sale is told of.
        tell = (n > 0) | (done["day"] == done["at"] // DAY)
        yield _told(done[tell], False, clicks[at[tell]] if len(clicks) else np.zeros(int(tell.sum()), dtype=_CLICK), n[tell])
    for rows in late:
        own = rows[rows["day"] == rows["at"] // DAY]
        if len(own):
            yield _told(own, True, np.zeros(len(own), dtype=_CLICK), np.zeros(len(own), dtype=np.int64))
    clicks = clicks[clicks["at"] >= w - span]
    if len(clicks) or len(sales):
        state.update((clicks.tobytes(), sales.tobytes()))
        state.setTimeoutDuration(1)  # so that the next batch calls this shard whether it has rows or not
    elif state.exists:
        state.remove()


def _told(sales: np.ndarray, late: bool, last: np.ndarray, n: np.ndarray) -> pd.DataFrame:
    """What keys say of closing sales; where n is 0 the last click means nothing."""
    out = {x: sales[x] for x in ("client", "at", "id", "copies")} | {"known": sales["known"] > 0, "late": late, "n": n}
    out |= {"last_at": last["at"], "last_known": last["known"] > 0, "last_id": last["id"]}
    return pd.DataFrame(out)[[x.split()[0] for x in _PART.split(", ")]]


def reduce_sales(parts: DataFrame, batch: int) -> DataFrame:
    """The reducer behind the keys: a sale's latest click over its days and the sum of their counts, a row for each copy of the sale."""
    c = F.col
    last = F.struct(c("last_at").alias("at"), c("last_known").alias("known"), c("last_id").alias("id"))
    some = parts.groupBy("id", "known", "client", "at", "copies", "late").agg(F.max(F.when(c("n") > 0, last)).alias("last"), F.sum("n").alias("n_clicks"))
    one = some.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return one.select(F.when(c("known"), c("id")).alias("sale_id"), F.lit(batch).alias("batch"), "late", F.when(c("last.known"), c("last.id")).alias("click_id"), "n_clicks")


def attribute(clicks: DataFrame, sales: DataFrame, batches: int = BATCHES, span: int = SPAN, delay: int = DELAY) -> DataFrame:
    """The last click of each sale's client within seven days before the sale, and how many there were.

    clicks: click_id, ts, arrived_at, client_id; sales: sale_id, client_id, sold_at, arrived_at; further columns, whatever their
    names, are not looked at. Returns sale_id, batch (in which the sale was told), late, click_id, n_clicks, one row for each
    row of `sales` that has a client and a time. Repeated clicks count once, repeated sales come as often as they are; ties
    of a time go to the larger click_id; a client without clicks gives null and 0; no sales give no rows, and without clicks or sales
    in the first batches nothing closes there.

    Nothing but two numbers a batch goes to the driver. What was read is cut into batches in the shared folder, each batch is
    one start of the stream on one checkpoint, and what a batch told is a table of its own that a repeated run overwrites.
    """
    spark = clicks.sparkSession
    prepare(spark)
    clicks, sales = cut(clicks, sales, batches)
    w = [*horizons(clicks, sales, batches, delay), EVER]
    rows = {name: dict(t.groupBy("batch").count().collect()) for name, t in (("clicks", clicks), ("sales", sales))}
    total = sum(rows["clicks"].values()) + 8 * sum(rows["sales"].values())
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")) * 4, -(-total // SHARD_ROWS))
    base = shared_dir(spark, "attribution")
    with _quiet(spark):
        for b in range(batches + 1):
            for name, table in (("clicks", clicks), ("sales", sales)):
                part = table.where(F.col("batch") == b).repartition(max(1, rows[name].get(b, 0) // FILE_ROWS))
                part.write.mode("append").parquet(f"{base}/{name}")
            _run(spark, base, b, w[b], shards, span)
    told = spark.read.schema("sale_id long, batch int, late boolean, click_id long, n_clicks long").parquet(*(f"{base}/told-{b}" for b in range(batches + 1)))
    for place in ("clicks", "sales", "checkpoint"):
        discard(spark, f"{base}/{place}")
    return told


def _run(spark: SparkSession, base: str, batch: int, w: int, shards: int, span: int) -> None:
    """One start of the stream on its checkpoint: it reads the files that have come since, as one micro-batch."""
    feeds = [spark.readStream.schema("id long, client long, at long, batch int" + more).parquet(f"{base}/{name}") for name, more in (("clicks", ""), ("sales", ", copies long"))]
    parts = keyed(*feeds, shards).groupBy("shard").applyInPandasWithState(partial(_step, w=w, span=span), _PART, "clicks binary, sales binary", "append", "ProcessingTimeTimeout")
    query = parts.writeStream.foreachBatch(lambda rows, _: reduce_sales(rows, batch).write.mode("overwrite").parquet(f"{base}/told-{batch}"))
    query.option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()


@contextlib.contextmanager
def _quiet(spark: SparkSession) -> Iterator[None]:
    """A start is one micro-batch: timeouts alone make no further one."""
    name = "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _cut_sql(table: str, key: str, at: str, distinct: str) -> str:
    return f"""SELECT id, client, t, a // {HOUR} + CASE WHEN {crc_sql("s")} % 4 = 0 THEN {LATE_HOURS} ELSE 0 END AS h
  FROM (SELECT {distinct} {key} AS id, client_id AS client, epoch_us({at}) AS t, epoch_us(arrived_at) AS a, CAST({key} AS VARCHAR) AS s FROM {table} WHERE client_id IS NOT NULL AND {at} IS NOT NULL)"""


#: A sale closes in the first batch from its own on whose W is beyond it; it may take the clicks that have come by then and were in time.
ORACLE = f"""
WITH ch AS ({_cut_sql("clicks", "click_id", "ts", "DISTINCT")}), sh AS ({_cut_sql("sales", "sale_id", "sold_at", "")}),
span AS (SELECT min(h) AS lo, max(h) AS hi FROM ch),
c AS (SELECT id, client, t, {BATCHES} * (h - lo) // (hi - lo + 1) AS b FROM ch, span),
s AS (SELECT id, client, t, least(greatest(CAST(floor({BATCHES} * (h - lo) / (hi - lo + 1)) AS BIGINT), 0), {BATCHES - 1}) AS b FROM sh, span),
w AS (SELECT b, CASE WHEN b = {BATCHES} THEN {EVER} ELSE least(x, y) - {DELAY} END AS w
  FROM (SELECT k AS b, (SELECT max(t) FROM c WHERE c.b < k) AS x, (SELECT max(t) FROM s WHERE s.b < k) AS y FROM range({BATCHES + 1}) AS r(k)) WHERE b = {BATCHES} OR (x IS NOT NULL AND y IS NOT NULL)),
kept AS (SELECT c.* FROM c LEFT JOIN w ON w.b = c.b WHERE w.w IS NULL OR t >= w.w),
shut AS (SELECT s.id, s.client, s.t, s.b, min(w.b) AS e, coalesce(min(own.w) > s.t, FALSE) AS late FROM s JOIN w ON w.b >= s.b AND w.w > s.t LEFT JOIN w AS own ON own.b = s.b GROUP BY 1, 2, 3, 4)
SELECT shut.id AS sale_id, CAST(e AS INTEGER) AS batch, late, CASE WHEN count(kept.id) > 0 THEN max(ROW(kept.t, kept.id))[2] END AS click_id, count(kept.id) AS n_clicks
FROM shut LEFT JOIN kept ON NOT late AND kept.client = shut.client AND kept.b <= e AND kept.t BETWEEN shut.t - {SPAN} AND shut.t GROUP BY shut.id, e, late
"""
