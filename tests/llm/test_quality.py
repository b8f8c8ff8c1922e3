import numpy as np
import pytest

from quirespark.llm import quality


def test_isotonic_is_the_best_rising_fit():
    g = np.random.default_rng(0)
    x, y = g.normal(size=60), g.integers(0, 2, 60).astype(float)
    px, py = quality.isotonic(x, y)
    assert (np.diff(px) >= 0).all() and (np.diff(py) >= -1e-12).all()
    # Min-max formula of isotonic regression, point by point.
    o = np.argsort(x, kind="stable")
    s = y[o]
    for i in range(60):
        want = max(min(s[a : b + 1].mean() for b in range(i, 60)) for a in range(i + 1))
        assert np.interp(x[o][i], px, py) == pytest.approx(want)


def test_fourier_features_approximate_the_kernel():
    g = np.random.default_rng(1)
    d, k = 6, 4096
    m = quality.Model(None, None, np.zeros(d), np.ones(d), g.standard_normal((d, k)), g.uniform(0, 2 * np.pi, k), None, [])
    x = g.normal(size=(20, d)) * 0.5
    z = m.fourier(x)[:, :-1]
    assert np.abs(z @ z.T - np.exp(-((x[:, None] - x[None]) ** 2).sum(-1) / 2)).max() < 0.08


def test_normal_equations_equal_a_direct_fit(spark, docs, small):
    labels = spark.read.parquet(f"{small}/labels.parquet")
    a = quality.train(docs.repartition(5), labels, features=32)
    b = quality.train(docs.coalesce(1), labels, features=32)
    assert np.allclose(a.beta, b.beta, atol=1e-6) and np.allclose(a.mean, b.mean)


def test_held_out_accuracy(spark):
    """Labels of ids that training has not seen."""
    from pyspark.sql import functions as F

    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    seen = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(2)) == 0
    model = quality.train(docs, labels.where(seen))
    got = quality.score(docs.join(labels.where(~seen), "doc_id", "left_semi"), model).join(labels, "doc_id").toPandas()
    assert len(got) > 1000
    assert ((got.quality_probability >= 0.5) == (got.quality == 1)).mean() > 0.9
    assert ((got.toxic_probability >= 0.5) == (got.toxic == 1)).mean() > 0.95
    clean = got[(got.quality == 1) & (got.toxic == 0)]
    assert clean.keep.mean() > 0.95
    assert got[got.toxic == 1].keep.mean() < 0.1


def test_odd_rows(spark, odd, odd_rows, nothing, docs, small):
    labels = spark.read.parquet(f"{small}/labels.parquet")
    model = quality.train(docs, labels)
    rows = quality.score(odd, model).collect()
    assert len(rows) == len(odd_rows)
    assert all(r.keep is not None and 0 <= r.quality_probability <= 1 for r in rows)
    kept = quality.keep(odd, model)
    assert kept.schema == odd.schema and kept.count() == sum(r.keep for r in rows)
    assert quality.score(nothing, model).count() == 0 and quality.keep(nothing, model).count() == 0


def test_labels_missing_null_repeated_or_of_one_class(spark, odd, odd_rows):
    def table(rows):
        return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")

    assert quality.train(odd, table([])) is None
    assert quality.train(odd, table([(None, 1, 0), (4, None, 0), (99, 1, 0)])) is None
    assert quality.score(odd, None).where("keep").count() == len(odd_rows)
    one = quality.train(odd, table([(5, 1, 0), (5, 1, 0), (7, 1, 0), (9, 1, 0), (10, 1, 0), (8, 1, 0)]))
    assert one is not None and quality.score(odd, one).count() == len(odd_rows)
