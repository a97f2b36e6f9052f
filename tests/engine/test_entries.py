import random
import re
import time

from scrivel.functions import rules as R
from scrivel.operators import lines


def walk(text):
    """Line by line, the entry so far joined by spaces at every step."""
    year, date, bullet = (re.compile(p.replace("(?iu)", "(?i)")) for p in (R.YEAR_RANGE, R.DATE, R.BULLET))
    out, now, had = [], [], False
    for raw in text.split("\n"):
        s = raw.strip()
        if not s or s.startswith(("---", "===", "***")):
            out += ["\n".join(now)] if now else []
            had = had and not now
            now = []
            continue
        point = bool(bullet.match(s))
        fresh = False
        if had and not point:
            fresh = s[0].isupper() and bool(year.search(s) or "|" in s or date.search(s) or len(s) < 60)
        elif not point and now and year.search(s):
            fresh = bool(year.search(" ".join(now)))
        if fresh and now:
            out.append("\n".join(now))
            now, had = [s], False
        else:
            now.append(s)
            had = had or point
    out += ["\n".join(now)] if now else []
    return out or [text]


PARTS = ["2015 - 2018", "2015", "-", "- 2018", "2015 -", "2018", "2010 – hien", "tai", "hiện", "hiện tại là", "2012 — Hiện", "tại", "- hien", "hien", "present", "- did this", "• and that", "Head | Of", "Title", "small letters", "T7/2019 at X", "", "---", "***", "  ", "\tTabbed 2001-2002\r", "A line that begins in capitals and has neither a date nor a bar in it at all", "x 1999 -"]


def test_entries_as_walked(spark):
    rng = random.Random(1)
    texts = ["\n".join(rng.choice(PARTS) for _ in range(rng.randrange(1, 14))) for _ in range(1500)] + ["", "\n\n", "---"]
    texts += ["\n".join(rng.choice(PARTS) for _ in range(n)) for n in (511, 512, 513, 1025)]
    frame = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id int, text string")
    for r in lines.entries(frame).collect():
        assert r.entries == walk(r.text), r.text
    assert lines.entries(spark.createDataFrame([(1, None)], "doc_id int, text string")).first().entries == [None]


def test_a_long_section_takes_time_in_proportion(spark):
    rng = random.Random(2)
    text = "\n".join(rng.choice(["line of an entry", "- point", "2015 - 2018", "more"]) for _ in range(200_000))
    frame = spark.createDataFrame([(1, text)], "doc_id int, text string")
    began = time.perf_counter()
    got = lines.entries(frame).first().entries
    took = time.perf_counter() - began
    assert sum(e.count("\n") + 1 for e in got) == 200_000 and took < 60, took
