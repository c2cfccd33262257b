import pytest

MID = "/root/testdata/sf0.01"
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, node long, sig string, chunk int, ids array<int>, "
          "score double, _block int, a long, `n` int, held_out string, spans string")


def prose(seed: int, n: int) -> str:
    import random
    r = random.Random(seed)
    return " ".join("".join(r.choice(["ba", "re", "thon", "ing", "qu", "é", "ß", "lo"]) for _ in range(r.randint(1, 4))) for _ in range(n))


def texts() -> list:
    """(doc_id, text): nulls, empties, short and very long texts, copies, near
    copies, repeated rows and odd characters."""
    base = prose(1, 80).split(" ")
    near = base[:40] + ["changed"] + base[41:]
    far = base[:30] + prose(2, 50).split(" ")
    rows = [(1, None), (2, ""), (3, " \n\t\r "), (4, "one"), (5, "One"), (6, "two three four five"), (7, "TWO three four  five"),
            (8, " ".join(base)), (9, "\n".join(base).upper().replace("É", "é")), (10, " ".join(near)), (11, " ".join(far)),
            (12, " ".join(base)), (12, " ".join(base)), (12, "another text under one id that is not a copy"), (None, " ".join(base)), (None, None),
            (13, prose(3, 30_000)), (14, prose(3, 30_000) + " end"), (15, "a\x1cb ΑΣ İstanbul ﬁne é <|endoftext|> it's we've 123 4.5  x"),
            (16, "same line here\n" * 60), (17, "*** ### $$$ " * 40), (18, "a b c d e f"), (19, "a b c d e f g"), (20, "0"), (21, "SHOUT LOUD " * 60),
            (22, "x" * 20_000), (23, "1" * 20_000 + " 4111 1111 1111 1111 and +1 (434) 555-2368, bob.1@mail.example.com or 10.0.0.255")]
    return rows


@pytest.fixture(scope="session")
def docs(spark):
    langs = ["en", "de", None]
    rows = [(i, t, langs[k % 3], "src", len(t or ""), 7, "x", 1, [1], 0.5, 3, 9, 2, "h", "s") for k, (i, t) in enumerate(texts())]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def collected(df) -> list:
    return [tuple(r) for r in df.collect()]
