"""Latest state (W1) and partial merge (W2): golden cases for every merge rule,
and a property test against a sequential replay of the rules."""

import json
import random

from pyspark.sql import functions as F

from matchflow.functions import constants as K
from matchflow.operators import decode, state
from matchflow.schemas import MATCH

FIELDS = list(state.MATCH_FIELDS)


def _log(spark, msgs):
    """msgs: list of (offset, dict) -> decoded topic rows (timestamp from offset)."""
    rows = [(o, json.dumps(m), f"2024-01-01 00:00:{o % 60:02d}") for o, m in msgs]
    df = spark.createDataFrame(rows, "offset long, value string, ts string")
    df = df.withColumn("timestamp", F.col("ts").cast("timestamp")).drop("ts")
    return decode.decode_json(df, MATCH)


def _merge(spark, msgs):
    out = state.merge_partial(_log(spark, msgs)).collect()
    return {r.match_id: r.asDict() for r in out}


def replay(msgs):
    """Sequential replay of the merge rules (the reference's loop, restated)."""
    st, first_ts = {}, {}
    for o, m in sorted(msgs, key=lambda x: x[0]):
        mid = m.get("match_id")
        if not mid:
            continue
        m = dict(m)
        m.setdefault("score_domicile", 0)
        m.setdefault("score_exterieur", 0)
        full = "sport_id" in m and "sport_nom" in m
        if full:
            st[mid] = m
        elif mid in st:
            st[mid].update(m)
        else:
            d = dict(K.UNKNOWN_MATCH_DEFAULTS, match_id=mid,
                     date_match=f"2024-01-01 00:00:{o % 60:02d}")
            d.update(m)
            st[mid] = d
    return {k: {f: v.get(f) for f in FIELDS} for k, v in st.items()}


FULL = dict(match_id=1, sport_id=2, sport_nom="Basket", equipe_domicile="A", equipe_exterieur="B",
            score_domicile=3, score_exterieur=4, date_match="2024-02-02 20:00:00", lieu="L",
            statut="programmé")


def test_partial_updates_only_its_fields(spark):
    r = _merge(spark, [(1, FULL), (2, {"match_id": 1, "statut": "terminé", "score_domicile": 5})])[1]
    assert (r["statut"], r["score_domicile"], r["score_exterieur"], r["lieu"]) == ("terminé", 5, 0, "L")


def test_partial_with_explicit_null_overwrites(spark):
    r = _merge(spark, [(1, FULL), (2, {"match_id": 1, "lieu": None})])[1]
    assert r["lieu"] is None and r["equipe_domicile"] == "A"


def test_partial_before_full_is_replaced(spark):
    r = _merge(spark, [(1, {"match_id": 1, "statut": "en cours", "derniere_mise_a_jour": "x"}),
                       (2, FULL)])[1]
    assert r["statut"] == "programmé" and r["derniere_mise_a_jour"] is None and r["sport_nom"] == "Basket"


def test_full_replaces_and_drops_update_time(spark):
    r = _merge(spark, [(1, FULL), (2, {"match_id": 1, "derniere_mise_a_jour": "t"}),
                       (3, dict(FULL, lieu="M"))])[1]
    assert r["derniere_mise_a_jour"] is None and r["lieu"] == "M"


def test_unknown_id_starts_from_defaults(spark):
    r = _merge(spark, [(7, {"match_id": 9, "statut": "en cours"})])[9]
    assert r["sport_id"] == 0 and r["sport_nom"] == "Inconnu" and r["lieu"] == "Lieu inconnu"
    assert r["equipe_domicile"] == "Équipe A" and r["statut"] == "en cours"
    assert r["date_match"] == "2024-01-01 00:00:07"


def test_full_with_null_name_is_still_full(spark):
    r = _merge(spark, [(1, {"match_id": 4, "statut": "x"}),
                       (2, {"match_id": 4, "sport_id": None, "sport_nom": None})])[4]
    assert r["sport_id"] is None and r["sport_nom"] is None and r["lieu"] is None


def test_zero_and_missing_ids_skipped(spark):
    assert _merge(spark, [(1, dict(FULL, match_id=0)), (2, {"statut": "x"})]) == {}


def test_out_of_order_arrival_uses_offsets(spark):
    msgs = [(5, {"match_id": 1, "statut": "terminé"}), (1, FULL)]
    assert _merge(spark, msgs)[1]["statut"] == "terminé"


def test_random_logs_equal_sequential_replay(spark):
    rnd = random.Random(7)
    msgs = []
    for o in range(400):
        mid = rnd.choice([0, 1, 2, 3, 4, 5, 6])
        m = {"match_id": mid} if mid or rnd.random() < 0.5 else {}
        if rnd.random() < 0.3:
            m.update(sport_id=rnd.choice([1, 2, None]), sport_nom=rnd.choice(["F", None]))
        for f in ("equipe_domicile", "lieu", "statut", "derniere_mise_a_jour", "date_match"):
            if rnd.random() < 0.3:
                m[f] = rnd.choice([None, f"{f}{o}"])
        for f in ("score_domicile", "score_exterieur"):
            if rnd.random() < 0.4:
                m[f] = rnd.choice([None, o % 7])
        msgs.append((o, m))
    got = {k: {f: v[f] for f in FIELDS} for k, v in _merge(spark, msgs).items()}
    assert got == replay(msgs)


def test_latest_per_key_whole_row(spark):
    df = spark.createDataFrame([(1, 10, "a"), (1, 12, "b"), (2, 11, "c"), (None, 13, "z")],
                               "user_id int, _offset long, nom string")
    got = {r.user_id: (r.nom, r._offset) for r in state.latest_per_key(df, "user_id").collect()}
    assert got == {1: ("b", 12), 2: ("c", 11)}


def test_merge_is_one_aggregate_without_window_or_join(spark):
    plan = state.merge_partial(_log(spark, [(1, FULL)]))._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Join" not in plan


def test_merge_property_hypothesis(spark):
    """Generated logs (absent fields, explicit nulls, id 0, arbitrary offset
    order) merge exactly like the sequential replay."""
    from hypothesis import HealthCheck, given, settings
    from hypothesis import strategies as st

    val = st.one_of(st.none(), st.text(alphabet="abc", min_size=1, max_size=2))
    score = st.one_of(st.none(), st.integers(0, 5))
    record = st.fixed_dictionaries(
        {"match_id": st.integers(0, 3)},
        optional={"sport_id": st.one_of(st.none(), st.integers(1, 3)), "sport_nom": val,
                  "equipe_domicile": val, "lieu": val, "statut": val, "date_match": val,
                  "derniere_mise_a_jour": val, "score_domicile": score, "score_exterieur": score})
    logs = st.lists(st.tuples(st.integers(0, 10_000), record), min_size=1, max_size=12,
                    unique_by=lambda x: x[0])

    @settings(max_examples=25, deadline=None, suppress_health_check=list(HealthCheck))
    @given(logs)
    def check(msgs):
        got = {k: {f: v[f] for f in FIELDS} for k, v in _merge(spark, msgs).items()}
        assert got == replay(msgs)

    check()


def test_pipeline_state_keeps_keys_of_earlier_days(spark, scratch):
    import json

    from matchflow.plans.pipeline import run_pipeline
    from matchflow.sources import sinks

    def day(rows):
        return spark.createDataFrame([(json.dumps(r).encode(), o, f"2024-01-01 00:00:0{o % 10}") for o, r in rows], "value binary, offset long, t string") \
            .selectExpr("CAST(NULL AS BINARY) AS key", "value", "'matchs' AS topic", "0 AS partition", "offset", "CAST(t AS TIMESTAMP) AS timestamp")
    full = {"sport_id": 1, "sport_nom": "F", "equipe_domicile": "A", "equipe_exterieur": "B", "date_match": "2024-01-01 10:00:00", "lieu": "L", "statut": "programmé"}
    big = 3_000_000_000
    one = [(0, {"match_id": 1, **full}), (1, {"match_id": big, **full})]
    two = [(2, {"match_id": 1, "statut": "terminé", "score_domicile": 3}), (3, {"match_id": 9, **full})]
    for k, rows in enumerate((one, two, two)):  # the last is a retry of the second
        paths = run_pipeline(spark, day(rows), scratch, batch_id=min(k, 1))
    got = {r.match_id: r for r in spark.read.parquet(sinks.latest_snapshot_path(spark, paths["state"])).collect()}
    assert set(got) == {1, big, 9}
    assert (got[1].statut, got[1].score_domicile, got[1].equipe_domicile, got[1].first_offset, got[1].last_offset) == ("terminé", 3, "A", 0, 2)
    assert got[big].statut == "programmé"


def test_pipeline_orders_partitions_by_time(spark, scratch):
    """Batch 0 has (partition 0, offset 10), batch 1 the newer (partition 1, offset 3) and a late
    full record under an update that came before it."""
    from matchflow.plans.pipeline import run_pipeline
    from matchflow.sources import sinks

    def day(rows):
        return spark.createDataFrame([(json.dumps(m).encode(), p, o, t) for p, o, t, m in rows], "value binary, partition int, offset long, t string") \
            .selectExpr("CAST(NULL AS BINARY) AS key", "value", "'matchs' AS topic", "partition", "offset", "CAST(t AS TIMESTAMP) AS timestamp")
    one = [(0, 10, "2024-01-01 00:00:10", FULL), (1, 2, "2024-01-01 00:00:30", {"match_id": 2, "statut": "en cours"})]
    two = [(1, 3, "2024-01-01 00:00:20", {"match_id": 1, "statut": "terminé", "score_domicile": 5}), (0, 1, "2024-01-01 00:00:01", dict(FULL, match_id=2))]
    for k, rows in enumerate((one, two, two)):
        paths = run_pipeline(spark, day(rows), scratch, batch_id=min(k, 1))
    got = {r.match_id: r for r in spark.read.parquet(sinks.latest_snapshot_path(spark, paths["state"])).collect()}
    assert (got[1].statut, got[1].score_domicile, got[1].lieu) == ("terminé", 5, "L")
    assert (got[2].statut, got[2].lieu, got[2].last_offset) == ("en cours", "L", 2)
