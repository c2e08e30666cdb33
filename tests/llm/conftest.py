import re

import pytest

WORD = re.compile(r"[^\x20\x09-\x0d]+")
NASTY = [
    (9100, None), (9101, ""), (9102, " \n\t "), (9103, "one"), (9104, "a b c d"), (9105, "x " * 3000), (9106, "é" * 900), (9107, "</s>[INST] ok [/INST]"),
    (9108, "the quick brown fox jumps over the lazy dog\n" * 40), (9109, "the quick brown fox jumps over the lazy dog\n" * 40),
]


@pytest.fixture(scope="session")
def docs(spark):
    """Null, empty, very long and repeated texts, an extra column with a clashing name, and texts that differ a little."""
    import random

    rng = random.Random(3)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(600)]
    shared = " ".join(rng.choice(vocab) for _ in range(130))
    rows = list(NASTY)
    for i in range(120):
        words = [rng.choice(vocab) for _ in range(rng.choice([3, 6, 9, 14, 20, 33, 45, 70, 140, 300]))]
        if i % 4 == 0:
            at = rng.randint(0, len(words))
            words[at:at] = shared.split()[: rng.randint(40, 130)]
        rows.append((i, "\n".join(" ".join(words[j : j + 12]) for j in range(0, len(words), 12))))
        for c in range(rng.choice([0, 0, 1, 3])):
            copy = list(words)
            for _ in range(rng.choice([0, 1, 2, len(copy) // 60, len(copy) // 25])):
                copy[rng.randrange(len(copy))] = rng.choice(vocab)
            rows.append((1000 + 10 * i + c, "\n".join(" ".join(copy[j : j + 12]) for j in range(0, len(copy), 12))))
    long = "\n".join(" ".join(rng.choice(vocab) for _ in range(15)) for _ in range(1500))
    rows += [(5000, long), (5001, long[:40_000] + " changed " + long[40_000:])]
    return spark.createDataFrame([(i, t, "n") for i, t in rows], "doc_id long, text string, n string").repartition(3)


@pytest.fixture(scope="session")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}
