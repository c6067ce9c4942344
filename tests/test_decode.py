"""Decode, validation / quarantine and date parsing."""

from pyspark.sql import functions as F

from matchflow.functions.scalars import iso_to_wire, parse_ts_ntz
from matchflow.operators import decode
from matchflow.schemas import MATCH


def _records(spark, values):
    rows = [(i, v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "offset long, value string")


def test_reject_reasons(spark):
    vals = ['not json', None, '[{"match_id":9}]', '{"match_id":"x"}', '{"match_id":0}',
            '{"sport_id":1}', '{"match_id":null}', '{"match_id":5,"sport_id":1}', '"text"']
    tagged = decode.classify(decode.decode_json(_records(spark, vals), MATCH), "match_id", nonzero=True)
    got = {r["_offset"]: r["_reject_reason"] for r in tagged.collect()}
    assert got == {0: "not_an_object", 1: "not_an_object", 2: "not_an_object", 3: "bad_key",
                   4: "zero_key", 5: "missing_key", 6: "bad_key", 7: None, 8: "not_an_object"}


def test_split_valid_and_presence(spark):
    vals = ['{"match_id":1,"sport_nom":null}', '{"match_id":2}', 'bad']
    valid, bad = decode.split_valid(decode.decode_json(_records(spark, vals), MATCH), "match_id")
    assert sorted(r.match_id for r in valid.collect()) == [1, 2]
    assert bad.count() == 1
    keys = {r.match_id: r._keys for r in valid.collect()}
    assert keys[1] == ["match_id", "sport_nom"] and keys[2] == ["match_id"]


def test_wrong_typed_field_nulls_only_that_field(spark):
    dec = decode.decode_json(_records(spark, ['{"match_id":3,"score_domicile":"x","lieu":"L"}']), MATCH)
    r = dec.collect()[0]
    assert (r.match_id, r.score_domicile, r.lieu) == (3, None, "L")


def test_dates(spark):
    df = spark.createDataFrame([("2024-01-02 10:00:00",), ("2024-01-02T10:00:00Z",), ("2024-01-02",),
                                ("",), ("bad",), (None,)], "x string")
    got = [r.t for r in df.select(parse_ts_ntz("x").alias("t")).collect()]
    assert [str(t) if t else None for t in got] == [
        "2024-01-02 10:00:00", "2024-01-02 10:00:00", "2024-01-02 00:00:00", None, None, None]
    wire = [r.w for r in df.select(iso_to_wire("x").alias("w")).collect()]
    assert wire == ["2024-01-02 10:00:00", "2024-01-02 10:00:00", "2024-01-02", "", "bad", None]


def test_encode_keeps_nulls_for_round_trip(spark):
    df = spark.createDataFrame([(1, None)], "match_id int, sport_nom string")
    v = decode.encode_json(df).collect()[0].value
    assert v == '{"match_id":1,"sport_nom":null}'
    dec = decode.decode_json(spark.createDataFrame([(0, v)], "offset long, value string"), MATCH)
    assert dec.collect()[0]._keys == ["match_id", "sport_nom"]


def test_curate_partitions(spark):
    df = spark.createDataFrame([(1, "1996-03-04 05:06:07"), (2, None)], "match_id int, date_match string")
    r = {x.match_id: (x.year, x.month, x.day) for x in decode.curate_matches(df).collect()}
    assert r == {1: (1996, 3, 4), 2: (None, None, None)}


def test_kafka_probe_reports_missing_connector(spark):
    from matchflow.sources.topics import kafka_available
    assert kafka_available(spark) in (True, False)
