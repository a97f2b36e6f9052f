import random

import pytest

from scrivel.functions.fuzzy import indel, partial, wratio
from scrivel.operators import fuzzy_join

LABELS = ["Computer Science", "Information Technology", "Business Administration", "Hanoi University of Science and Technology", "Đại học Bách Khoa Hà Nội", "Ha Noi", "Hồ Chí Minh", "English", "Tiếng Anh", "Accounting and Finance", "Law", "Medicine", "Marketing", "Civil Engineering", "Mechanical engineering", "Tourism", "IT", "Thạc sĩ", "Cử nhân", "National Economics University"]


def pairs_of(rng, n_texts, n_names):
    words = [w for x in LABELS for w in x.split()] + ["of", "and", "the", "a"]

    def text():
        kind = rng.random()
        if kind < 0.3:
            base = list(rng.choice(LABELS))
            for _ in range(rng.randrange(4)):
                base[rng.randrange(len(base))] = rng.choice("abe xyz")
            return "".join(base)
        if kind < 0.7:
            return " ".join(rng.choice(words) for _ in range(rng.randrange(1, 9)))
        return "".join(rng.choice("abcdef ghiXY  éđ😀") for _ in range(rng.randrange(1, 40)))

    odd = ["", " ", "   ", "a  b", "x y z w", "a a a", "😀", "b a a", " ", "the the the law"]
    return [text() for _ in range(n_texts)] + odd, [text() for _ in range(n_names)] + LABELS + odd[1:]


@pytest.mark.parametrize("floor", [70.0, 61.0, 90.0])
def test_equals_all_pairs(spark, floor):
    texts, names = pairs_of(random.Random(int(floor)), 250, 60)
    asked = spark.createDataFrame([("p", t) for t in [*texts, None]] + [("q", t) for t in texts[:20]], "picklist_id string, text string")
    labels = spark.createDataFrame([("p", t) for t in [*names, None]] + [("q", t) for t in names[:5]], "picklist_id string, name string")
    want = {(p, t, n) for p, ts, ns in (("p", texts, names), ("q", texts[:20], names[:5])) for t in ts for n in ns if t and n and wratio(t, n) >= floor}
    got = {(r.picklist_id, r.text, r.name) for r in fuzzy_join.similar(asked, labels, floor).collect()}
    assert got == want


def test_few_pairs_are_scored(spark):
    """Names and misspelt names: pairs scored against all pairs."""
    rng = random.Random(2)
    syllables = ["nguy", "tran", "hoa", "binh", "minh", "thu", "lan", "phuc", "quang", "duong", "khanh", "vy", "xuan", "giang", "long", "son", "tuan", "hai", "yen", "chau"]
    names = sorted({" ".join(rng.choice(syllables).title() for _ in range(rng.randrange(1, 5))) + rng.choice(["", " Institute", " Group", " 7"]) for _ in range(300)})
    texts = sorted({"".join(c for c in rng.choice(names) if rng.random() > 0.1).replace(" ", rng.choice([" ", ""])) + rng.choice(["", "x", "zz"]) for _ in range(400)})
    frame = lambda xs, k: spark.createDataFrame([("p", x) for x in xs], f"picklist_id string, {k} string")
    scored = fuzzy_join.candidates(frame(texts, "text"), frame(names, "name"), 70.0).count()
    assert scored < 0.35 * len(texts) * len(names), scored / len(texts) / len(names)


def test_partial_is_the_best_piece():
    rng = random.Random(3)
    for _ in range(3000):
        a, b = ("".join(rng.choice("abc d") for _ in range(rng.randrange(1, n))) for n in (12, 30))
        short, long = sorted((a, b), key=len)
        assert partial(a, b) == pytest.approx(max(indel(short, long[max(0, k) : k + len(short)]) for k in range(1 - len(short), len(long))))


def test_floor(spark):
    with pytest.raises(ValueError):
        fuzzy_join.needs(60)
    assert fuzzy_join.least_common(10) == 7
    none = spark.createDataFrame([], "picklist_id string, text string")
    assert fuzzy_join.similar(none, none.withColumnRenamed("text", "name")).count() == 0


def test_ratio_as_the_standard_library_has_it(spark):
    import re
    from difflib import SequenceMatcher

    from scrivel.functions.fuzzy import ratio
    from scrivel.operators import scoring

    def plain(a, b):
        return SequenceMatcher(None, *(re.sub(r"\s+", " ", (t or "").lower().strip()) for t in (a, b))).ratio()

    rng = random.Random(6)
    pairs = []
    for k in range(1500):
        letters, n = rng.choice(["ab", "abc de", "abcdefghij klm", "abÀé\t\n "]), 300 if k % 5 == 0 else 40
        a, b = ("".join(rng.choice(letters) for _ in range(rng.randrange(n))) for _ in range(2))
        pairs.append((a, a[: rng.randrange(len(a) + 1)] + b if rng.random() < 0.5 else b))
    assert all(abs(ratio(a, b) - plain(a, b)) < 1e-12 for a, b in pairs)
    rows = pairs[:60] + [(None, None), (None, "x"), ("", ""), ("a\tb", "c d"), ("same", "same"), ("same", "same")]
    frame = spark.createDataFrame([(*p, 1.0, "z") for p in rows], "a string, b string, ratio double, mine string")
    got = sorted((r.a or "", r.b or "", round(r.ratio, 9), r.mine) for r in scoring.with_ratio(frame, "a", "b").collect())
    assert got == sorted((a or "", b or "", round(plain(a, b), 9), "z") for a, b in rows)
