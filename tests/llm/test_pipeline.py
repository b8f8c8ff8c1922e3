import random

import corpus_pipeline
from quirespark.llm import packing, quality, queries, secrets, simhash, suffixes


def folder(spark, tmp_path, rows, labels):
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def test_stages_are_the_operators_on_what_came_before(spark, tmp_path, prose):
    g = random.Random(2)
    shared = prose(70, 77)
    rows = []
    for i in range(160):
        good = i % 4 != 3
        t = prose(120, i) if good else " ".join(w + "!!" for w in prose(120, i).upper().split())
        if i % 9 == 0:
            t += " " + shared
        if i % 10 == 0:
            t += " AKIA" + "".join(g.choice("ABCDEFGH12345678") for _ in range(16)) + " ."
        rows.append((i, t, "en", "s", len(t)))
    rows += [(1000 + i, rows[i][1], "en", "s", rows[i][4]) for i in range(0, 20, 4)]
    sf = folder(spark, tmp_path, rows, [(i, int(i % 4 != 3), 0) for i in range(160)])
    frames, docs = [], spark.read.parquet(f"{sf}/documents.parquet")
    for n, (name, f) in enumerate(corpus_pipeline.STAGES):
        docs = f(spark, docs, sf)
        docs.write.parquet(f"{tmp_path}/stage{n}")
        docs = spark.read.parquet(f"{tmp_path}/stage{n}")
        frames.append({} if n == 4 else {r.doc_id: r for r in docs.collect()})
        if n < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
    one, two, three, four = frames[:4]
    assert sum(i % 4 == 3 for i in one) <= 2 and sum(i % 4 != 3 for i in one) >= 0.95 * 125
    assert not any(i >= 1000 for i in two) and set(two) <= set(one)
    assert sum(shared in r.text for r in three.values()) == 1 < sum(shared in r.text for r in two.values())
    assert all(r.n_chars == len(r.text) for r in three.values())
    assert any("[aws_access_key]" in r.text for r in four.values()) and not any("AKIA" in r.text for r in four.values())
    last = docs.groupBy("doc_id").sum("n_tokens").collect()
    assert {r[0]: r[1] for r in last} == {i: len(r.text.split()) for i, r in four.items() if r.text.split()}
    key = lambda r: tuple(r)
    assert sorted(map(key, corpus_pipeline.run(spark, sf).collect())) == sorted(map(key, docs.collect()))


def test_stages_on_nothing(spark, tmp_path):
    sf = folder(spark, tmp_path, [], [])
    assert corpus_pipeline.run(spark, sf).count() == 0


def test_stages_on_odd_rows(spark, tmp_path, odd, prose):
    """Nulls, repeats, a very long text and columns named like the operators' own go through every stage; extra columns stay up to the last."""
    spark.createDataFrame([(i, int(i % 2), 0) for i in range(1, 10)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = odd
    for name, f in corpus_pipeline.STAGES[:4]:
        docs = f(spark, docs, str(tmp_path))
        assert docs.columns == odd.columns and docs.dtypes == odd.dtypes, name
    assert docs.count() <= odd.count()
    assert corpus_pipeline.STAGES[4][1](spark, docs, str(tmp_path)).columns[:4] == ["bin_id", "slot", "bin_offset", "doc_id"]


def test_ids_that_are_no_integers(spark, prose):
    """Count as none."""
    rows = [("a7", prose(80, 1)), ("12", prose(80, 2)), ("99999999999999999999", prose(80, 3)), (None, prose(80, 4))]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    assert sorted(r.doc_id or 0 for r in simhash.near_duplicates(df).collect()) == [0, 0, 0, 12]
    assert secrets.scan(df).count() == 0 and suffixes.repeated_passages(df).count() == 0 and {r.doc_id for r in packing.pack(df).collect()} == {12, None}
    assert simhash.dedup(df).count() == 4


def test_every_query_has_its_number():
    assert [int(n[2:].split("_")[0]) for n in queries.queries()] == list(range(1, 11))
    assert [n for n, _ in corpus_pipeline.STAGES] and 4 <= len(corpus_pipeline.STAGES) <= 5
    assert all(m for m in (packing, quality, secrets, simhash, suffixes))
