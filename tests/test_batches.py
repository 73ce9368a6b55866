import pyarrow as pa

from quarrylark.functions import batches as B
from quarrylark.operators import articles as X

XML = "<article><front><article-meta><article-title>T{0}</article-title></article-meta></front><body><p>{1}</p><fig><label>F{0}</label><graphic href='f{0}.jpg'/></fig></body></article>"


def test_articles_go_out_a_few_at_a_time(spark):
    """What a worker holds of its results is bounded in bytes, not in rows."""
    xml = [XML.format(i, "word " * 20_000) for i in range(100)] + [None, ""]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(xml)), pa.int64()), pa.array(xml, pa.string())], ["key", "xml"])
    out = list(X._markdowns([batch]))
    assert len(out) >= 4 and max(b.nbytes for b in out) < B.BYTES + (1 << 18)
    assert [tuple(r.values()) for b in out for r in b.to_pylist()] == [(i, *X.article(x)) for i, x in enumerate(xml)]
    found = [tuple(r.values()) for b in X._captioned([batch]) for r in b.to_pylist()]
    assert found[:2] == [(0, "f0.jpg", "figure", "F0", ""), (0, "f0", "figure", "F0", "")] and len(found) == 200


def test_batches_that_come_in_are_short(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    try:
        for given, want in (("64MB", str(B.BYTES)), ("1k", "1k")):
            spark.conf.set(name, given)
            rows = X.markdown(spark.createDataFrame([(1, XML.format(1, "x"))], "k int, x string"), "k", "x").collect()
            assert spark.conf.get(name) == want and len(rows) == 1
    finally:
        spark.conf.set(name, before)
