"""The pipeline against brute force, stage by stage and as a whole."""

import random
import re
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from llm_samples import prose
from pyspark.sql import functions as F
from test_edges import brute_groups, plain_groups

from tidemark.llm import packing, pii, toxicity
from tidemark.llm.common import stored

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """A folder with documents and labels: copies, near copies, shared passages, secrets, toxic words, nulls."""
    r, texts = random.Random(8), {}
    passage = prose(500, 40)
    for i in range(240):
        w = prose(i, 70).split()
        if i % 4 == 0:
            for _ in range(3):
                w.insert(r.randrange(len(w)), r.choice(["vilewort", "grublump", "snarkface"]))
        texts[i] = " ".join(w)
        if i % 10 == 5:
            texts[i] += "\n" + passage
        if i % 10 == 7:
            texts[i] += " write a.b@c.de or +1 (456) 555-2186 é"
    for i in range(240, 260):
        texts[i] = texts[r.randrange(240)] if i % 2 else texts[r.randrange(240)].replace("alpha", "ALPHA", 1)
    texts |= {260: None, 261: "", 262: "short"}
    rows = [(i, t, "en", "s", 0 if t is None else len(t)) for i, t in texts.items()] + [(262, "short", None, None, None)]
    folder = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(240)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def rows_of(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=lambda x: (x[0], x[1] or ""))


def brute_cut(rows, width=50):
    seen = {}
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - width + 1):
            seen[b[k : k + width]] = min(seen.get(b[k : k + width], i), i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - width + 1):
            if seen[b[k : k + width]] < i:
                gone[k : k + width] = b"\1" * width
        at, kept = 0, ""
        for c in t or "":
            n = len(c.encode())
            kept += "" if all(gone[at : at + n]) else c
            at += n
        out.append((i, t if t is None else kept))
    return out


def test_stages(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "near-dedup", "suffix-array-dedup", "pii", "packing"]
    field = toxicity.train(docs, spark.read.parquet(f"{corpus}/labels.parquet"))
    fine = {r["doc_id"] for r in toxicity.scored(docs, field).where("score < 0.5").collect()}
    rows = rows_of(docs)

    docs = stages["toxicity"](spark, docs, corpus)
    rows = [x for x in rows if x[0] in fine]
    assert rows_of(docs) == rows and 150 < len(rows) < 230 and {260, 261, 262} <= {i for i, _ in rows}

    docs = stages["near-dedup"](spark, docs, corpus)
    keep = [k for *_, k in brute_groups([(i, t or "") for i, t in rows], 5)]
    rows = [x for x, k in zip(rows, keep, strict=True) if k]
    assert rows.count((262, "short")) == 2
    rows.remove((262, "short"))  # one row of each group stays, so repeated rows go
    assert rows_of(docs) == rows

    docs = stages["suffix-array-dedup"](spark, docs, corpus)
    rows = brute_cut(rows)
    assert rows_of(docs) == rows and docs.where("n_chars <> coalesce(length(text), 0)").count() == 0

    docs = stages["pii"](spark, docs, corpus)
    model = pii.train()
    rows = [(i, t if t is None else pii.redacted(t, pii.spans_of(t, *model)[1])) for i, t in rows]
    assert rows_of(docs) == rows and any("[EMAIL]" in (t or "") for _, t in rows) and tuple(docs.columns) == corpus_pipeline.COLUMNS

    pieces = stages["packing"](spark, docs, corpus)
    encode = packing.encoder(packing.tokenizer_path())
    want = Counter()
    for i, t in rows:
        want[i] += len(encode([t or ""])[0]) // 2 + 1
    got = Counter()
    for r in pieces.collect():
        got[r["doc_id"]] += r["length"]
    assert got == want


def test_run_equals_the_stages(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, corpus)
    per_doc = lambda df: Counter({tuple(r)[:1]: r["n"] for r in df.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()})
    whole = corpus_pipeline.run(spark, corpus)
    assert per_doc(whole) == per_doc(docs)
    at = sorted((r["sequence_id"] * 2048 + r["offset"], r["length"]) for r in whole.collect())
    assert [a for a, _ in at] == np.concatenate([[0], np.cumsum([n for _, n in at])[:-1]]).tolist()


def test_awkward_rows(spark, docs, nasty, tmp_path):
    """Null ids, repeated rows, null and very long texts, clashing columns, labels without any clean or toxic row."""
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(None, None, None), (0, 1, None), (0, 1, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    told = lambda rows: sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or ""))
    rows, held, folder = told((x[0], x[1]) for x in nasty), spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path)

    for name, stage in corpus_pipeline.STAGES[:-1]:
        held = stored(stage(spark, held, folder), "held")
        assert tuple(held.columns) == corpus_pipeline.COLUMNS
        if name == "near-dedup":
            kept = [k for *_, k in plain_groups([(i, t or "") for i, t in rows], 5)]
            rows = told({x for x, k in zip(rows, kept, strict=True) if k})
        elif name == "suffix-array-dedup":
            cut = brute_cut([(-1 if i is None else i, t) for i, t in rows])
            rows = told((None if i == -1 else i, t) for i, t in cut)
        elif name == "pii":
            model = pii.train()
            rows = told((i, t if t is None else pii.redacted(t, pii.spans_of(t, *model)[1])) for i, t in rows)
        assert told((r["doc_id"], r["text"]) for r in held.collect()) == rows, name

    encode = packing.encoder(packing.tokenizer_path())
    got = Counter()
    for r in corpus_pipeline.run(spark, folder).collect():
        got[r["doc_id"]] += r["length"]
    assert got == Counter({i: len(encode([t or ""])[0]) // 2 + 1 for i, t in rows})


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_guard_leaves_the_rest(monkeypatch):
    """Without the subpackage and the pipeline the entry point still has the core queries."""
    import importlib
    import sys

    import __spark_entry__ as entry

    for name in [n for n in sys.modules if n.startswith("tidemark.llm") or n == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "tidemark.llm", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    monkeypatch.delattr(sys.modules["tidemark"], "llm", raising=False)
    try:
        bare = importlib.reload(entry)
        assert "lww_latest" in bare.queries() and not any(re.match("op[0-9]|pipeline", q) for q in bare.queries())
    finally:
        monkeypatch.undo()
        importlib.reload(entry)
