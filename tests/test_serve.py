"""Serving queries: search filters, lookup, ordering, labels, branches."""

from pyspark.sql import functions as F

from matchflow.operators import serve
from matchflow.plans.pipeline import generation_branch


def _m(spark):
    return spark.createDataFrame(
        [(1, 1, "Football", "programmé", "2024-01-01 10:00:00"), (2, 2, "Tennis", "terminé", "2024-02-01 00:00:00"),
         (3, 1, "Football", "terminé", "2024-03-01 00:00:00")],
        "match_id int, sport_id int, sport_nom string, statut string, d string",
    ).withColumn("date_match", F.col("d").cast("timestamp_ntz"))


def test_search_absent_zero_empty_mean_no_filter(spark):
    m = _m(spark)
    assert serve.match_search(m, sport_id=0, statut="", date_debut=None).count() == 3
    assert [r.match_id for r in serve.match_search(m, sport_id=1, statut="terminé").collect()] == [3]
    got = serve.match_search(m, date_debut="2024-02-01", date_fin="2024-03-01 00:00:00")
    assert sorted(r.match_id for r in got.collect()) == [2, 3]
    assert [r.match_id for r in serve.match_search(m, sport_nom="Tennis").collect()] == [2]


def test_lookup_found_and_missing(spark):
    m = _m(spark)
    assert serve.match_lookup(m, 2).count() == 1 and serve.match_lookup(m, 99).count() == 0


def test_recent_bad_dates_last(spark):
    n = spark.createDataFrame([(1, "2024-01-01 00:00:00", "x"), (2, "bad", "x"), (3, "2024-05-01 00:00:00", "x")],
                              "notification_id long, date_envoi string, type string")
    assert [r.notification_id for r in serve.recent_notifications(n).collect()] == [3, 1, 2]


def test_colours_and_labels(spark):
    df = spark.createDataFrame([(1, "LIVE"), (2, "Annulé"), (3, "autre")], "match_id int, statut string")
    got = {r.match_id: r.couleur for r in serve.status_bucket(df).collect()}
    assert got == {1: "success", 2: "error", 3: "default"}
    u = spark.createDataFrame([(1, "Ada", "Lovelace", "A@X.org", None)],
                              "user_id int, prenom string, nom string, email string, notification_active boolean")
    r = serve.user_labels(u).collect()[0]
    assert (r.nom_complet, r.initiales, r.email, r.notifications) == ("Ada Lovelace", "AL", "a@x.org", "Désactivées")


def test_threshold_and_generation_branch(spark):
    p = spark.createDataFrame([(1, 10.0), (2, 2500.0)], "produit_id int, prix double")
    assert serve.threshold_branch(p).collect()[0].branche == "action1"
    assert serve.threshold_branch(p.where("prix < 100")).collect()[0].branche == "action2"
    assert generation_branch(_m(spark), 5).collect()[0].branche == "generate_matchs"
    assert generation_branch(_m(spark), 2).collect()[0].branche == "skip_generation"


def test_upcoming_window(spark):
    m = _m(spark)
    assert [r.match_id for r in serve.upcoming_matches(m, "2024-01-01", 7).collect()] == [1]


def test_random_pick_is_seeded_and_whole(spark):
    df = spark.range(1, 1000).withColumnRenamed("id", "k")
    a = [r.k for r in serve.random_pick(df, "k", 5, seed=1).collect()]
    b = [r.k for r in serve.random_pick(df, "k", 5, seed=1).collect()]
    c = [r.k for r in serve.random_pick(df, "k", 5, seed=2).collect()]
    assert a == b and a != c and len(set(a)) == 5


def test_seeds_and_parquet_table(spark, scratch):
    from matchflow.sources import seeds, sinks
    assert seeds.seed_sports(spark).count() == 5 and seeds.seed_products(spark).count() == 5
    sinks.create_parquet_table(spark, "robust_test_t", location=scratch + "/robust")
    spark.sql("INSERT INTO robust_test_t VALUES (1, 'a', TIMESTAMP '2024-01-01 00:00:00')")
    assert spark.table("robust_test_t").count() == 1
    spark.sql("DROP TABLE robust_test_t")


def test_run_pipeline_outputs(spark, scratch):
    from matchflow.plans.pipeline import run_pipeline
    from matchflow.sources import fixtures as fx
    from tests.conftest import SF_SMALL
    recs = fx.match_topic(spark, SF_SMALL)
    paths = run_pipeline(spark, recs, scratch, batch_id=3)
    n = fx.match_log(spark, SF_SMALL).count()
    assert spark.read.parquet(paths["matchs"]).count() == n
    run_pipeline(spark, recs, scratch, batch_id=3)  # retry: no duplicates
    assert spark.read.parquet(paths["matchs"]).count() == n
    st = spark.read.parquet(paths["state"] + "/v=3")
    assert st.count() == fx.match_log(spark, SF_SMALL).select("match_id").distinct().count()
