import pytest
from llm_samples import prose

DOCS = "doc_id long, text string, lang string, source string, n_chars long, label long, node long, bucket long, runs string, rest string, shard int, bands string"

@pytest.fixture(scope="session")
def nasty():
    """Rows with nulls, empty, blank and very long texts, copies, repeated rows and clashing columns."""
    base = prose(1, 120)
    near = base.split()
    near[60] = "changed"
    texts = [
        base, base, " ".join(near), None, "", " \t\n", "one", "one two", "One TWO", "x" * 300_000, prose(2, 40_000), prose(3, 80) + "\n" + base[:400], "é" * 60 + "日本語 🙂 " + base[100:300],
        "a b c d e f g h " * 50, prose(4, 200), prose(4, 200) + " tail", "\x00 \x1f odd\x85signs", "İSTANBUL ΣΑΣ ﬁ", "1" * 5000, base,
    ]
    rows = [(i * 3, t, "en", "s", len(t) if t else None, 1, 2, 3, "r", "q", 4, "b") for i, t in enumerate(texts)]
    rows.append(rows[0])  # a repeated row
    rows.append((None, prose(9, 70), None, None, None, None, None, None, None, None, None, None))
    return rows


@pytest.fixture(scope="session")
def docs(spark, nasty):
    return spark.createDataFrame(nasty, DOCS).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCS)
