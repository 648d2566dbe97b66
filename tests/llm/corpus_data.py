import os
import random
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)

SF = "/root/testdata/sf0.001"
# extra columns named like the operators' own inputs, outputs and helpers
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, id string, th string, "
          "kept string, body string, n int, component int, line int, shard int, part int, host int")


def odd_texts() -> list[tuple]:
    """Nulls, empty and blank texts, ties, repeated rows, copies, near
    copies, shared passages, odd characters and a long text."""
    rng = random.Random(4)
    vocab = [f"w{i}" if i % 7 else f"Wört{i}é" for i in range(400)]

    def prose(n, sep=" "):
        return sep.join(rng.choice(vocab) for _ in range(n))

    base = prose(150)
    passage = prose(70)
    w = base.split()
    near = [" ".join(w[:i] + ["changed"] + w[i + 1:]) for i in range(0, 150, 11)]
    far = " ".join(prose(60).split() + w[:40])
    lines = "\n".join(prose(9) + "." for _ in range(12))
    return [
        (1, base), (2, base), (3, base.upper()), *[(10 + i, t) for i, t in enumerate(near)], (30, far),
        (31, prose(50) + " " + passage + " " + prose(40)), (32, passage + " " + prose(100)), (33, prose(20) + "\n" + passage),
        (40, None), (41, ""), (42, "   \n\t \n"), (43, "1234 !!! 42"), (44, "one two three"), (45, "One  two\tTHREE"),
        (46, "a"), (47, "ab " * 300), (48, "x" * 500), (49, "xy" * 300), (50, lines), (51, lines.replace(".", "!")),
        (52, lines + "\n" + prose(30)), (53, "\n".join([prose(12)] * 6)), (54, "  İK \U0001f600 naïve\x1c\x85 tail"),
        (55, "<|endoftext|> it's 2024, <|ENDOFTEXT|> we'll"), (56, prose(6000)), (None, base), (None, prose(30)), (None, None),
        (60, prose(80)), (60, prose(80)), (61, passage), (61, passage), (62, "$$$ ### %% " * 20),
        (63, lines.replace("w1", "w1 extra", 1)),
    ]


@pytest.fixture(scope="session")
def odd(spark):
    rows = [(d, t, "en" if d is None or d % 3 else "de", None if d == 41 else f"s{(d or 0) % 3}", None, "x", "y", "z", "b",
             1, 2, 3, 4, 5, 6) for d, t in odd_texts()]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def both(odd, docs):
    """The odd rows and, with other ids, the generated table."""
    from pyspark.sql import functions as F
    more = docs.select((F.col("doc_id") + 1000).alias("doc_id"), "text", "lang", "source")
    return odd.unionByName(more, allowMissingColumns=True)
