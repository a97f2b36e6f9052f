import bisect
import random
import zlib
from datetime import datetime, timedelta

import numpy as np
import pytest

from scrivel.llm import attribution as A

CLICKS = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, day long, shard string"
SALES = "sale_id long, client_id long, sold_at timestamp_ntz, arrived_at timestamp_ntz, at string, batch string"
ZERO = datetime(1970, 1, 1)


def us(x):
    return (x - ZERO) // timedelta(microseconds=1)


def hours(arrived, key):
    return us(arrived) // A.HOUR + 240 * (key is not None and zlib.crc32(str(key).encode()) % 4 == 0)


def brute(clicks, sales, batches=A.BATCHES):
    """Batch after batch by the rule, with all clicks of a client in one list."""
    one = {}
    for c in clicks:
        if c[1] is not None and c[3] is not None:
            one.setdefault(c[0], c)
    sales = [s for s in sales if s[1] is not None and s[2] is not None]
    h = [hours(c[2], c[0]) for c in one.values()] or [0]
    lo, hi = min(h), max(h)
    of = lambda arrived, key: min(max(batches * (hours(arrived, key) - lo) // (hi - lo + 1), 0), batches - 1)
    fed_c, fed_s = [[] for _ in range(batches + 1)], [[] for _ in range(batches + 1)]
    for c in one.values():
        fed_c[of(c[2], c[0])].append((c[3], us(c[1]), c[0]))
    for s in sales:
        fed_s[of(s[3], s[0])].append((s[1], us(s[2]), s[0]))
    held, open_, out, tops = {}, [], [], [None, None]
    for b in range(batches + 1):
        w = A.EVER if b == batches else min(tops) - A.DAY if None not in tops else None
        for client, at, key in fed_c[b]:
            if w is None or at >= w:
                bisect.insort(held.setdefault(client, []), (at, key))
        for s in fed_s[b]:
            if w is not None and s[1] < w:
                out.append((s[2], b, True, None, 0))
            else:
                open_.append(s)
        for s in [s for s in open_ if w is not None and s[1] < w]:
            own = held.get(s[0], [])
            own = own[bisect.bisect_left(own, (s[1] - A.SPAN,)) : bisect.bisect_left(own, (s[1] + 1,))]
            out.append((s[2], b, False, own[-1][1] if own else None, len(own)))
        open_ = [s for s in open_ if w is None or s[1] >= w]
        if w is not None:
            held = {k: [x for x in v if x[0] >= w - A.SPAN] for k, v in held.items()}
        for k, fed in enumerate((fed_c[b], fed_s[b])):
            tops[k] = max([x for x in [tops[k], *(f[1] for f in fed)] if x is not None], default=None)
    return sorted(map(repr, out))


def made(seed, n_clicks, n_sales, days=60):
    """Hot clients, ties, times on a day's edge, late arrivals, nulls, repeated clicks and sales."""
    rng = random.Random(seed)
    start = datetime(2024, 1, 1)

    def time():
        at = start + timedelta(days=rng.random() * days)
        return rng.choice([at, at.replace(minute=0, second=0, microsecond=0), at.replace(hour=0, minute=0, second=0, microsecond=0), at.replace(microsecond=1)])

    client = lambda: rng.choice([1, 1, 1, 2, 3, rng.randrange(20), None])
    lag = lambda: timedelta(seconds=rng.choice([0, 5, 4000, 400_000]))
    clicks, sales = [], []
    for k in range(n_clicks):
        at = time()
        clicks.append((k, rng.choice([at] * 20 + [None]), at + lag(), client(), 0, "s"))
    for k in range(n_sales):
        at = time()
        sales.append((k, client(), rng.choice([at] * 20 + [None]), at + lag(), "x", "y"))
    return clicks + clicks[: n_clicks // 10], sales + sales[: n_sales // 20]


def rows(frame):
    return sorted(repr(tuple(r)) for r in frame.select("sale_id", "batch", "late", "click_id", "n_clicks").collect())


@pytest.mark.parametrize("seed", [1])
def test_stream_against_brute_force(spark, seed):
    clicks, sales = made(seed, 1500, 500)
    got = A.attribute(spark.createDataFrame(clicks, CLICKS).repartition(3), spark.createDataFrame(sales, SALES).repartition(2))
    assert rows(got) == brute(clicks, sales)


def test_one_sided_and_empty(spark):
    clicks, sales = made(3, 40, 30)
    none_c, none_s = spark.createDataFrame([], CLICKS), spark.createDataFrame([], SALES)
    assert rows(A.attribute(none_c, spark.createDataFrame(sales, SALES))) == brute([], sales)
    assert A.attribute(spark.createDataFrame(clicks, CLICKS), none_s).count() == 0


def test_batches_without_rows(spark):
    """Everything arrives in the first and the last batch."""
    at = datetime(2024, 1, 1)
    far = at + timedelta(days=50)
    clicks = [(1, at, at, 5, 0, "s"), (2, at + timedelta(hours=1), at, 5, 0, "s"), (3, far, far, 5, 0, "s")]
    sales = [(1, 5, at + timedelta(hours=2), at, "x", "y"), (2, 5, far + timedelta(hours=1), far, "x", "y"), (3, 6, at, far, "x", "y")]
    assert rows(A.attribute(spark.createDataFrame(clicks, CLICKS), spark.createDataFrame(sales, SALES))) == brute(clicks, sales)


def test_last_and_count_within_a_shard():
    rng = np.random.default_rng(0)
    clicks = np.zeros(400, dtype=A._CLICK)
    clicks["client"], clicks["at"], clicks["id"], clicks["known"] = rng.integers(0, 4, 400), rng.integers(0, 20, 400) * A.DAY // 4, np.arange(400), 1
    clicks["day"] = clicks["at"] // A.DAY
    clicks = clicks[np.lexsort((clicks["id"], clicks["known"], clicks["at"], clicks["day"], clicks["client"]))]
    sales = np.zeros(60, dtype=A._SALE)
    sales["client"], sales["at"] = rng.integers(0, 5, 60), rng.integers(0, 48, 60) * A.DAY // 4
    for back in range(8):
        sales["day"] = sales["at"] // A.DAY - back
        at, n = A.last_and_count(clicks, sales)
        for k, s in enumerate(sales):
            own = [c for c in clicks if (c["client"], c["day"]) == (s["client"], s["day"]) and s["at"] - A.SPAN <= c["at"] <= s["at"]]
            assert n[k] == len(own) and (not own or clicks[at[k]]["id"] == max((c["at"], c["id"]) for c in own)[1])


def test_zone_of_the_session_does_not_matter(spark):
    frame = spark.createDataFrame([(datetime(2024, 3, 31, 2, 30, 0, 7),)], "ts timestamp_ntz")
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
        assert frame.select(A.micros(frame, "ts")).first()[0] == us(datetime(2024, 3, 31, 2, 30, 0, 7))
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
