"""Marts: team totals (null teams, one-sided teams), fixed status counts, top-k."""

from matchflow.operators import marts, serve

COLS = "sport_id int, sport_nom string, equipe_domicile string, equipe_exterieur string, " \
       "score_domicile int, score_exterieur int, statut string"


def _m(spark, rows):
    return spark.createDataFrame(rows, COLS)


def _tt(df):
    return sorted((r.sport_id, r.equipe, r.total_matchs, r.total_buts_marques, r.total_buts_encaisses)
                  for r in df.collect())


def test_team_totals_home_away_both(spark):
    m = _m(spark, [(1, "F", "A", "B", 2, 1, "terminé"), (1, "F", "B", "C", 0, 0, "terminé"),
                   (1, "F", "A", "C", 1, 3, "terminé")])
    # A home-only, B both sides, C away-only
    assert _tt(marts.team_totals(m)) == [(1, "A", 2, 3, 4), (1, "B", 2, 1, 2), (1, "C", 2, 3, 1)]


def test_team_totals_null_team_two_rows_unless_equal(spark):
    m = _m(spark, [(None, None, None, None, 1, 2, "x")])
    assert _tt(marts.team_totals(m)) == [(None, None, 1, 1, 2), (None, None, 1, 2, 1)]
    eq = _m(spark, [(None, None, None, None, 1, 2, "x"), (None, None, None, None, 2, 1, "x")])
    assert _tt(marts.team_totals(eq)) == [(None, None, 2, 3, 3)]


def test_sum_over_only_nulls_stays_null(spark):
    m = _m(spark, [(1, "F", "A", "B", None, None, "programmé")])
    assert _tt(marts.team_totals(m)) == [(1, "A", 1, None, None), (1, "B", 1, None, None)]


def test_unpivot_variant_equals_faithful_on_valid_input(spark):
    m = _m(spark, [(1, "F", "A", "B", 2, 1, "t"), (2, "G", "B", "A", 0, 0, "t"), (1, "F", "B", "A", 4, 4, "t")])
    assert _tt(marts.team_totals(m)) == _tt(marts.team_totals_unpivot(m))


def test_stats_sportifs_counts_team_on_both_sides_twice(spark):
    m = _m(spark, [(1, "F", "A", "B", 1, 1, "t"), (1, "F", "B", "A", 1, 1, "t")])
    assert marts.stats_sportifs(m).collect()[0].nombre_equipes == 4


def test_matches_per_status_fixed_three_rows(spark):
    m = _m(spark, [(1, "F", "A", "B", 0, 0, "terminé"), (1, "F", "A", "B", 0, 0, "reporté")])
    got = {r.statut: r.nombre_matchs for r in marts.matches_per_status(m).collect()}
    assert got == {"programmé": 0, "en cours": 0, "terminé": 1}


def test_dashboard_total_is_sum_of_counted(spark):
    m = _m(spark, [(1, "F", "A", "B", 0, 0, "terminé"), (2, "G", "A", "B", 0, 0, "en cours"),
                   (2, "G", "A", "B", 0, 0, "annulé")])
    r = marts.dashboard_kpis(m).collect()[0]
    assert (r.sports, r.en_cours, r.termines, r.total) == (2, 1, 1, 2)


def test_top3_tie_broken_by_sport_id(spark):
    per = spark.createDataFrame([(3, "c", 5), (1, "a", 5), (2, "b", 5), (4, "d", 9)],
                                "sport_id int, sport_nom string, nombre_matchs long")
    assert [r.sport_id for r in serve.top_sports(per).collect()] == [4, 1, 2]


def test_favourite_counts_ignore_null_and_empty(spark):
    u = spark.createDataFrame([(1, [1, 1, 2]), (2, None), (3, [])], "user_id int, sports_favoris array<int>")
    got = {r.sport_id: r.nombre_utilisateurs for r in marts.favourite_counts(u).collect()}
    assert got == {1: 2, 2: 1}


def test_sum_of_per_sport_counts_is_total(spark):
    from matchflow.sources import fixtures as fx
    from tests.conftest import SF_SMALL
    lg = fx.match_log(spark, SF_SMALL)
    assert marts.matches_per_sport(lg).groupBy().sum("nombre_matchs").collect()[0][0] == lg.count()


def test_approx_distinct_counts_close_to_exact(spark):
    from matchflow.sources import fixtures as fx
    from tests.conftest import SF_SMALL
    n = fx.notifications(spark, SF_SMALL)
    exact = {r.type: r for r in marts.stats_notifications(n).collect()}
    approx = {r.type: r for r in marts.stats_notifications_approx(n, rsd=0.02).collect()}
    for t, e in exact.items():
        a = approx[t]
        assert a.nombre_notifications == e.nombre_notifications
        assert abs(a.nombre_utilisateurs_distincts - e.nombre_utilisateurs_distincts) <= 0.1 * e.nombre_utilisateurs_distincts + 1
        assert abs(a.nombre_matchs_distincts - e.nombre_matchs_distincts) <= 0.1 * e.nombre_matchs_distincts + 1
