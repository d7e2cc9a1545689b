"""Names inside questions, against the registered SQL on a fixture that holds some."""

import duckdb

from terraza.plans import entities
from terraza.registry import ORACLE_SQL


def test_names_of_any_form_are_found(spark, tmp_path):
    spark.createDataFrame([(n,) for n in ("UNITED STATES", "CÔTE-D'OR", "NATION_1", "NATION_10", None)], "n_name string").write.parquet(f"{tmp_path}/nation.parquet")
    texts = ["flats in the United States?", "near côte-d'or", "nation_10 only", "nothing", None, "nation_1", "nation_1"]
    spark.createDataFrame([(1, i if i < 6 else 5, t) for i, t in enumerate(texts)], "conv_id long, turn int, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    db = duckdb.connect()
    for name in ("nation", "conversations"):
        db.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    want = sorted(db.sql(ORACLE_SQL["district_mention"]).fetchall())
    assert len(want) == 6 and sorted(tuple(r) for r in entities.mention(spark, str(tmp_path)).collect()) == want
