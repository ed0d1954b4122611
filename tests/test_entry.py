"""The driver's contract."""

import __spark_entry__ as entry


def test_queries_have_matching_columns_and_oracles():
    queries, oracle = entry.queries(), entry.oracle_sql()
    assert set(oracle) <= set(queries) and len(queries) > 70


def test_flagship(spark):
    rows = entry.entry(spark).collect()
    assert {r.metric for r in rows} == {"Annualized Return", "Annualized Vol", "Sharpe", "Sortino", "Calmar", "Max Drawdown", "Max DD Duration (days)", "Total Return"}
    assert all(r.value is not None for r in rows)


def test_a_query_of_each_kind(spark):
    sf = "/root/testdata/sf0.001"
    for name in ("panel_smooth", "feat_momentum", "tgt_rank", "topn", "regime_macro", "bet_size"):
        df = entry.queries()[name](spark, sf)
        value = df.columns[-1]
        assert df.where(df[value].isNotNull()).count() > 0, name
