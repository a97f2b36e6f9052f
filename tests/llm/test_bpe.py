import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from scrivel.llm import bpe

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def words():
    return bpe.Vocabulary(PATH, PATTERN, limit=100)


def noise(rng, n):
    sets = ["ab", "the inging er", "0123 456789", " \t\n\r\x0b\x85\xa0 ", "éèüßжд日本語😀́", "-=_*#!?.,;:'\"", "'s't're've'm'll'd aZ", "AaBb Zz"]
    return "".join(rng.choice(rng.choice(sets)) for _ in range(n))


def test_every_character_as_the_library_has_it(words, library):
    for low in range(0, 0x110000, 4096):
        text = "".join(f"a{chr(c)}1{chr(c)} {chr(c)}" for c in range(low, min(low + 4096, 0x110000)) if not 0xD800 <= c < 0xE000)
        assert words.encode(text)[0].tolist() == library.encode_ordinary(text), hex(low)


def test_random_texts_as_the_library_has_them(words, library, texts):
    rng = random.Random(3)
    alone = "".join(rng.choice("abcdeinorst") for _ in range(3000))
    for text in [*(t or "" for t in texts), alone, "a" * 5000, " " * 3000, "-" * 700 + "=" * 300, *(noise(rng, rng.randrange(400)) for _ in range(300))]:
        got = words.encode(text)[0]
        assert got.tolist() == library.encode_ordinary(text), text[:60]
        assert words.decode(got) == text.encode("utf-8", "replace")


def test_ranks_of_another_order():
    """Few tokens, ranks at random: some tokens are never made by merges, pairs overlap."""
    rng = random.Random(5)
    for _ in range(60):
        made = [bytes([x]) for x in b"abc"]
        while len(made) < 40:
            new = rng.choice(made) + rng.choice(made)
            if new not in made:
                made.append(new)
        library = tiktoken.Encoding("few", pat_str="[abc]+", mergeable_ranks={t: k for k, t in enumerate(made)}, special_tokens={})
        words = bpe.Vocabulary.__new__(bpe.Vocabulary)
        import tempfile

        with tempfile.NamedTemporaryFile() as file:
            file.write(b"\n".join(base64.b64encode(t) + b" %d" % k for k, t in enumerate(made)))
            file.flush()
            words.__init__(file.name, "[abc]+")
        for _ in range(40):
            text = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 60)))
            assert words.encode(text)[0].tolist() == library.encode_ordinary(text), (made, text)


def test_appends_and_edits(words, library):
    rng = random.Random(8)
    for k in range(250):
        table = bpe.Table(words, noise(rng, rng.randrange(80)))
        for _ in range(4):
            start = rng.randrange(len(table.text) + 1)
            stop = min(len(table.text), start + rng.choice([0, 0, 1, 3, 20]))
            more = noise(rng, rng.choice([0, 1, 2, 9, 40]))
            want = table.text[:start] + more + table.text[stop:]
            table.replace(start, stop, more)
            fresh = bpe.Table(words, want)
            assert table.text == want and table.ids() == library.encode_ordinary(want), (k, want)
            assert (table.chars, table.last) == (fresh.chars, fresh.last)
        table.append(more := noise(rng, 5))
        assert table.ids() == library.encode_ordinary(table.text)


def test_an_edit_costs_its_surroundings(words, library):
    rng = random.Random(9)
    long = "".join(rng.choice("abcdeinorst") for _ in range(20_000))
    table = bpe.Table(words, long)
    assert table.made == 20_000
    table.replace(10_000, 10_003, "xyz")
    assert table.ids() == library.encode_ordinary(table.text) and table.made < 600
    table.append("ing")
    assert table.ids() == library.encode_ordinary(table.text) and table.made == 3
    prose = bpe.Table(words, "some words, " * 5000)
    prose.replace(30_000, 30_000, " more")
    assert prose.ids() == library.encode_ordinary(prose.text) and prose.made < 40


def test_documents(spark, odd, empty, library):
    want = sorted((str(d), len(ids := library.encode_ordinary(t or "")), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for d, t in odd.select("doc_id", "text").collect())
    got = sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(odd, PATH, PATTERN).collect())
    assert got == want
    assert bpe.digests(empty, PATH, PATTERN).count() == 0


def test_stored_tables(spark, docs, library):
    stored = bpe.tables(docs, PATH, PATTERN)
    edits = spark.createDataFrame([(0, 2, 4, "xx"), (0, None, None, " end"), (3, 0, 0, None), (15, -5, 10**6, "all new"), (-7, 0, 0, "no such document")], "doc_id long, start int, stop int, replacement string")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    rows = bpe.edited(stored, edits, PATH, PATTERN).collect()
    assert len(rows) == 4 and all(r.ids == library.encode_ordinary(r.text) for r in rows)
    assert sorted(r.text for r in rows if r.doc_id == 0) == sorted([texts[0] + " end", texts[0][:2] + "xx" + texts[0][4:]])
    assert {r.text for r in rows if r.doc_id == 15} == {"all new"}
