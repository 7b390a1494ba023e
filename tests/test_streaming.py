import stratalog as S
from stratalog.sources.relations import KEYS
from stratalog.streaming.incremental import IncrementalInference
from stratalog.terms import key, term

P = "PREFIX : <http://x/> "
RULES = P + "DATA { :z :p :a } RULE { ?x :q ?y } WHERE { ?x :p ?y } RULE { ?x :q ?z } WHERE { ?x :q ?y . ?y :q ?z }"


def test_stream_equals_batch(spark, tmp_path):
    data = P + ":a :p :b . :b :p :c . :c :p :d . :d :p :a ."
    rows = [tuple(map(key, t)) for t in S.parse_data(data)]
    src = str(tmp_path / "in")
    for i in (0, 2):
        spark.createDataFrame(rows[i : i + 2], KEYS).coalesce(1).write.mode("append").parquet(src)
    inc = IncrementalInference(spark, RULES, str(tmp_path / "out"))
    inc.start()
    stream = spark.readStream.schema(KEYS).option("maxFilesPerTrigger", 1).parquet(src)
    q = inc.run(stream, str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {tuple(map(term, r)) for r in inc.triples().collect()}
    assert got == set(S.infer(RULES, data, include_base=True, spark=spark))
    # A batch delivered again replaces its epoch.
    inc.process(spark.createDataFrame(rows[2:], KEYS), 1)
    assert {tuple(map(term, r)) for r in inc.triples().collect()} == got


def test_only_monotone(spark, tmp_path):
    import pytest

    with pytest.raises(ValueError):
        IncrementalInference(spark, P + "RULE { ?x :q 1 } WHERE { ?x :p 1 NOT { ?x :r 1 } }", str(tmp_path))
