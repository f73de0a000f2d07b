import random

import corpus_pipeline as C
from strandline.llm.queries import tokenizer_path


def shingles(text):
    w = text.split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def corpus():
    rng = random.Random(11)
    word = lambda: rng.choice(["kor", "lam", "nis", "tev"]) + rng.choice(["ado", "ive", "ul"]) + str(rng.randrange(500))
    fresh = lambda n: " ".join(word() for _ in range(n))
    passage = fresh(90)
    rows = [fresh(rng.randrange(30, 200)) for _ in range(200)]
    rows += [fresh(40) + " " + passage + " " + fresh(40) for _ in range(5)]
    rows += [rows[0], rows[1] + " x", rows[2]]
    toxic = [fresh(20) + " gruntbag vilewort gruntbag " + fresh(10) for _ in range(60)]
    docs = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(rows + toxic)]
    labels = [(i, 1, int(i >= len(rows))) for i in range(len(docs))]
    return docs, labels, len(rows), passage


def test_stages_against_brute_force(spark, tmp_path):
    docs, labels, clean, passage = corpus()
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(docs, schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert [n for n, _ in C.STAGES] == ["toxicity", "near_duplicates", "repeated_passages", "mixing", "packing"]
    d = str(tmp_path)
    kept = [{}]
    frame = spark.read.parquet(d + "/documents.parquet")
    for name, stage in C.STAGES[:-1]:
        stage(spark, frame, d).write.parquet(f"{d}/{name}")
        frame = spark.read.parquet(f"{d}/{name}")
        assert frame.columns == [c.split()[0] for c in schema.split(", ")]
        kept.append({r.doc_id: r.text for r in frame.collect()})
    _, first, second, third, fourth = kept
    assert set(first) == set(range(clean))
    gone = set(first) - set(second)
    assert gone == {clean - 3, clean - 2, clean - 1}
    assert len(shingles(first[1]) & shingles(first[clean - 2])) > 0
    assert set(third) == set(second)
    for i in range(200, 205):
        assert passage not in third[i] and len(third[i]) < len(second[i]) - 400
    assert all(third[i] == second[i] for i in range(200))
    assert fourth == third
    pieces = C.run(spark, d).collect()
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    want = {i: len(t.encode(x, add_special_tokens=False).ids) + 1 for i, x in fourth.items()}
    got = {}
    for r in pieces:
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got == want


def test_edges_of_every_stage(spark, tmp_path):
    """Nulls in every column, empty and very long texts, repeated rows and a clashing column; then no rows at all."""
    rng = random.Random(2)
    long = " ".join(f"{rng.choice('abcdef')}{rng.randrange(10**6)}" for _ in range(60_000))
    rows = [(None, "no id here at all", "en", "s", 1, "x"), (1, None, None, None, None, None), (2, "", "en", "s", 0, "x"), (3, long, "en", "s", 1, "x"), (4, "one two three four five six", "en", None, 1, "x")]
    rows += [rows[4], (5, " \n ", "en", "t", 3, "x"), (None, None, None, None, None, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, slot string"
    labels = [(1, 1, 1), (2, 1, 0), (3, None, None), (None, 1, 1), (99, 0, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    d = str(tmp_path)
    want = [8, 7, 7, 7]  # the repeated row goes as a near copy
    frame = spark.createDataFrame(rows, schema)
    empty = frame.limit(0)
    for (name, stage), n in zip(C.STAGES, [*want, None], strict=True):
        stage(spark, frame, d).write.parquet(f"{d}/{name}")
        frame = spark.read.parquet(f"{d}/{name}")
        stage(spark, empty, d).write.parquet(f"{d}/{name}-empty")
        assert spark.read.parquet(f"{d}/{name}-empty").count() == 0
        if n is not None:
            assert frame.columns == [c.split()[0] for c in schema.split(", ")]
            assert frame.count() == n, name
            kept = frame.collect()
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    assert frame.agg({"length": "sum"}).first()[0] == sum(len(t.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in kept)
    assert {r.text for r in kept} == {r[1] for r in rows}
