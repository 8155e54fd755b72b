"""The pipeline: what each stage keeps, and its rows against the stages in plain Python."""

import hashlib

import pyarrow as pa

import corpus_pipeline
from tests.llm import helpers
from traitloom.llm import language
from traitloom.session import cut


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, frames = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        frames.append(cut(stage(spark, frames[-1], sf_dir)))
        assert frames[-1].columns == columns, name
    whole, spoken, exact, near, clean = [{r["doc_id"]: r["text"] for r in f.collect()} for f in frames]
    # Language: every document of the four learnt languages stays.
    profiles = language.Profiles(language.fit_profiles(docs))
    assert set(spoken) == {i for i, t in whole.items() if profiles.best(t)[0] != "und" and profiles.best(t)[1] >= language.MIN_SCORE}
    # One of each text, the smallest id.
    least = {}
    for i, t in spoken.items():
        key = hashlib.sha256(t.translate(helpers.LOWER).encode()).digest()
        least[key] = min(i, least.get(key, i))
    assert set(exact) == set(least.values())
    # One of each component of fingerprints of five words.
    ids = sorted(exact)
    prints = [helpers.simhashes(exact[i], 5, 4) for i in ids]
    def close(a, b):
        apart = [(x ^ y).bit_count() for x, y in zip(a, b)]
        return any(apart[k] <= 7 and apart[(k + 1) % 4] <= 16 for k in range(4))

    root = helpers.components(prints, close)
    assert set(near) == {ids[r] for r in root}
    # Personal data is gone and the rest is as it was.
    assert set(clean) == set(near)
    assert not any(helpers.pii_base(t) for t in clean.values())
    assert all(clean[i] == t for i, t in near.items() if not any(c.isdigit() or c == "@" for c in t))
    name, stage = corpus_pipeline.STAGES[-1]
    packed = stage(spark, frames[-1], sf_dir)
    assert packed.select("doc_id").distinct().count() == len(clean)


def test_run(spark, sf_dir):
    rows = corpus_pipeline.run(spark, sf_dir)
    assert rows.count() > 0 and {"doc_id", "ids", "sequence_id", "offset"} <= set(rows.columns)


def test_arrow_tasks_of_the_stages_hand_free_memory_back_and_leave_in_pieces(spark, monkeypatch):
    """Each Arrow task ends by giving its free memory back; whole batches of texts are not held as Python objects."""
    from traitloom.llm import common, exact_dedup, language, packing, simhash
    from traitloom.llm.queries import tokenizer_paths

    docs = spark.createDataFrame([(1, "one text", "en"), (2, "another text", "en"), (3, None, None)], "doc_id long, text string, lang string")
    tasks, plain = [], type(docs).mapInArrow
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, f, *a, **b: tasks.append(f) or plain(self, f, *a, **b))
    language.drop_unidentified(docs)
    exact_dedup.drop_exact_copies(docs)
    simhash.with_fingerprint(docs)
    simhash.links(spark.createDataFrame([(5,), (7,)], "fp long"))
    packing.pack(docs, *tokenizer_paths())
    assert {f.__name__ for f in tasks} >= {"count", "label", "local", "settle", "digest", "run", "deal"}
    assert all(f.__module__.startswith("traitloom") and hasattr(f, "__wrapped__") for f in tasks)
    given = []
    monkeypatch.setattr(common, "give_back", lambda: given.append(1))
    texts = ["a" * (common.PIECE_BYTES // 2 + k) for k in range(4)]
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2, 3, 4], "text": texts, "lang": ["en"] * 4})
    for name in ("label", "digest"):
        out = list(next(f for f in tasks if f.__name__ == name)(iter([batch])))
        assert [row for b in out for row in b.column(0).to_pylist()] == [1, 2, 3, 4]
        assert max(b.num_rows for b in out) < 4
    assert len(given) == 2
