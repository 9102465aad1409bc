import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, block long, n long, score double, kind int, digest long, shard long"


def make_texts(seed=3):
    """Small texts with exact and near copies, repeated passages, and every odd shape."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice(["th", "er", "on", "an", "ré", "ing", "st"]) for _ in range(r.randint(1, 4)))
    line = lambda n: " ".join(word() for _ in range(n))
    passage = line(60)
    base = [line(12) for _ in range(8)]
    near = [[(line(12) if r.random() < p else x) for x in base] for p in (0.0, 0.05, 0.1, 0.12, 0.3, 0.0)]
    texts = ["\n".join(x) for x in near]
    texts += [f"{line(30)}\n{passage}\n{line(25)}", f"{passage}\n{line(9)}", f"{line(40)} {passage}", passage.upper()]
    texts += ["\n".join(["Hello there", "", "one two three four five six seven eight nine ten eleven twelve thirteen", "x", "Hello there"]) for _ in range(2)]
    texts += [None, "", "   \n\t ", "a", "a b c d", "a b c d", "ha " * 400, "ha " * 250, "\x00\x01 \x7f", "é" * 49, "é" * 60, "Σσς ŁÓDŹ ﬁ 中文 <|endoftext|> don't", "x" * 5000, line(20000)]
    return texts


@pytest.fixture(scope="session")
def doc_rows():
    """Rows with extra columns of clashing names, a repeated row, an id with two texts, and a row without id."""
    texts = make_texts()
    rows = [(i * 3 % 101, t, "en", ["a", "b", None][i % 3], len(t or ""), 7, 7, 0.5, 1, 1, 1) for i, t in enumerate(texts)]
    rows.append(rows[0])
    rows.append((rows[6][0], texts[7], *rows[6][2:]))
    rows.append((None, texts[0], *rows[0][2:]))
    return rows


@pytest.fixture(scope="session")
def docs(spark, doc_rows):
    return spark.createDataFrame(doc_rows, SCHEMA).repartition(3).persist()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def ranked(rows):
    """Rows with an id, once each, by id."""
    return sorted({(r[0], r[1] or "") for r in rows if r[0] is not None})
