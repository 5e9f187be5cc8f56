"""Candidates of the near-duplicate stage."""

import numpy as np
import pyarrow as pa

import corpus_pipeline
from corpuslake.llm import graph, similar
from corpuslake.llm.common import written


def test_fingerprints_alone_find_texts_that_differ_in_a_word(spark, monkeypatch):
    """Without a single min-hash band the pigeonhole finds those within two bits; they are compared on their shingles."""
    monkeypatch.setattr(similar, "bands", lambda found: [])
    rng = np.random.default_rng(5)
    rows, want, near = [(None, None), (90, ""), (91, "one"), (92, "one two"), (93, "ONE  two")], {91, 92}, 0
    for i in range(12):
        words = [f"w{n}" for n in rng.integers(0, 9000, 3000)]
        copy = [*words[:1500], "changed", *words[1501:]]
        bits = [similar.fingerprint(similar.shingles(" ".join(w).encode(), 5)) for w in (words, copy)]
        close = (bits[0] ^ bits[1]).bit_count() <= similar.RADIUS
        near += close
        rows += [(100 + 2 * i, " ".join(words)), (101 + 2 * i, " ".join(copy))]
        want |= {100 + 2 * i} | ({101 + 2 * i} if not close else set())
    assert near >= 6
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id for r in corpus_pipeline.near_duplicate(spark, docs, "").collect()} == want | {90}
    assert similar.fingerprint(np.zeros(0, np.uint64)) is None


def test_clusters_come_as_stars_and_stars_need_no_round(spark, monkeypatch):
    """Each cluster of a cell is its least id with the others, whatever order merged it, and such edges are stored once."""
    stored = []
    monkeypatch.setattr(graph, "written", lambda df, name: stored.append(name) or written(df, name))
    sets = {"d": range(0, 100), "c": range(5, 105), "b": range(10, 110), "a": range(15, 115), "z": range(500, 600), "y": range(505, 605), "x": range(900, 905)}
    cell = pa.table({"id": list(sets), "shingles": pa.array([list(s) for s in sets.values()], pa.list_(pa.int64()))})
    linked = similar._linker(0.8)(cell).to_pylist()
    assert sorted((r["a"], r["b"]) for r in linked) == [("a", "b"), ("a", "c"), ("a", "d"), ("y", "z")]
    edges = spark.createDataFrame([(r["a"], r["b"]) for r in linked] + [("b", "a"), ("a", "a"), ("a", None)], "a string, b string")
    assert {r.node: r.root for r in graph.components(edges).collect()} == {"a": "a", "b": "a", "c": "a", "d": "a", "y": "y", "z": "y"}
    assert stored == ["edges"]
    chain = spark.createDataFrame([(i, i + 1) for i in range(0, 9)] + [(21, 20), (22, 20), (22, 21)], "a long, b long")
    assert {r.node: r.root for r in graph.components(chain).collect()} == {i: 0 for i in range(10)} | {20: 20, 21: 20, 22: 20}
