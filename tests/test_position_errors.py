def test_far_pairs_count(spark, monkeypatch):
    """Names alike, re-ordered in case, repeated, and far apart; another area makes no match."""
    from hexloom.plans import record_queries as S

    own = [("overture", 1, "Rashidi", 25.0, 27.0, "a"), ("fsq", 2, "Rashidi", 25.0, 27.0, "a"), ("overture", 3, "Zumoto", 25.0, 27.0, "a"), ("fsq", 4, "zumoto", 25.1, 27.0, "a"), ("fsq", 5, "Zumoto", 25.0, 27.0, "b")]
    monkeypatch.setattr(S, "points", lambda s, d: s.createDataFrame(own, "source string, place_id long, name string, lat double, lon double, h3_res8 string"))
    got = S.position_errors(spark, "").first()
    assert got.pairs == 2 and 11_000 < got.max_m < 11_200
