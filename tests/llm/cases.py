"""Small documents with every edge case: nulls, empty, very long, ties, repeated rows and clashing names."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key long, n long, kept boolean, ids string, _i int"


def prose(seed: int, n: int) -> str:
    """n words from a small vocabulary with common English words among them."""
    rng = random.Random(seed)
    common = "the of and to a in is that it for was on with as be by this are at from".split()
    own = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(3, 9))) for _ in range(400)]
    words = [rng.choice(common) if rng.random() < 0.3 else rng.choice(own) for _ in range(n)]
    return "\n".join(" ".join(words[i : i + 12]).capitalize() + "." for i in range(0, n, 12))


def rows():
    base = prose(1, 300)
    words = base.split(" ")
    near = " ".join([*words[:100], "changed", *words[101:]])
    long_text = prose(2, 30_000)
    texts = [
        (1, base, "en", "b"), (2, base, "en", "b"), (3, near, None, "a"), (4, "", "en", None), (5, None, "en", "a"), (6, long_text, "en", "b"),
        (7, prose(3, 80), "xx", "c"), (7, prose(3, 80), "xx", "c"), (None, prose(4, 120), "en", "b"), (None, base, "en", "b"), (8, "one two", "en", None),
        (9, prose(5, 60) + " " + " ".join(words[20:130]) + " " + prose(6, 40), "en", "b"), (10, " \t\n\v\f\r ", "en", "c"), (11, "a\x1cb\x85c\xa0d 日本 é x", "fr", "a"),
    ]
    return [(i, t, lang, src, None if t is None else len(t), 1, 2, None, "x", 0) for i, t, lang, src in texts]


def documents(spark):
    return spark.createDataFrame(rows(), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
