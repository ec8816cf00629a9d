from strandline.functions.pssm import Pwm, pssm
from strandline.operators import pwm
from strandline.streaming.motifs import find_in_stream, scan_stream, write_matches


def test_hits_of_a_stream(spark, tmp_path):
    spark.createDataFrame([("a", "TTACACA"), ("b", "GG")], "seq_id string, sequence string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("seq_id string, sequence string").parquet(str(tmp_path / "in"))
    query = write_matches(find_in_stream(stream, "ACA"), str(tmp_path / "out"), str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert sorted(tuple(r)[:2] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [("a", 2), ("a", 4)]


def test_scan_of_a_stream(spark, tmp_path):
    rows = spark.createDataFrame([("a", "TTACACATTGACA"), ("b", "GG")], "seq_id string, sequence string")
    rows.write.parquet(str(tmp_path / "in"))
    matrix = pssm(Pwm("m", "m", ((9, 0, 9), (0, 9, 0), (1, 0, 0), (0, 1, 1))))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    query = write_matches(scan_stream(stream, matrix, threshold=70), str(tmp_path / "out"), str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()))
    assert got and got == sorted(map(tuple, pwm.scan(rows, matrix, None, 70, scores=True).collect()))
