import random

import pytest

WORDS = [f"w{i}" for i in range(40)]


@pytest.fixture(scope="session")
def docs(spark):
    """Texts with copies, near copies, shared passages, empty and null texts, null ids, repeated rows, one long text.

    Further columns have names that operators use inside.
    """
    rng = random.Random(3)
    passage = " ".join(rng.choices(WORDS, k=20))
    rows = []
    for i in range(40):
        w = rng.choices(WORDS, k=rng.randint(1, 60))
        if i % 4 == 0:
            w += passage.split()
        rows.append((i, " ".join(w) + ("\n" if i % 3 else "\t\x0bend")))
    rows += [(50, rows[5][1]), (51, rows[5][1]), (52, rows[4][1] + " more"), (53, ""), (54, None), (55, "   \n"), (None, rows[4][1]), (None, None), (7, rows[7][1]), (7, rows[7][1])]
    rows += [(60, " ".join(rng.choices(WORDS, k=30_000))), (61, "a" * 50_000), (62, "é 日本 ſK <|endoftext|> 's"), (63, "the " * 3000)]
    rng.shuffle(rows)
    schema = "doc_id long, text string, lang string, source string, n_chars long, fp string, batch string, bucket string, spans string, score string, n string, length string, rank string"
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), *["x"] * 8) for i, t in rows], schema).repartition(3)


@pytest.fixture(scope="session")
def none(docs):
    return docs.limit(0)
