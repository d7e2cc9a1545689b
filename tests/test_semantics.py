"""Values that the rules must give, whatever the engine."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from terraza.functions import semantics as S
from terraza.functions import unicode as U
from terraza.functions.quantiles import exact
from terraza.operators import geo as G
from terraza.operators import history as H
from terraza.operators import scoring as C
from terraza.operators import text as T


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


@pytest.mark.parametrize(("rule", "x", "digits", "want"), [(S.half_up, 1.25, 1, 1.3), (S.half_up, -1.25, 1, -1.3), (S.round_away, -1.25, 1, -1.3), (S.round_js, -1.25, 1, -1.2), (S.half_up, 1.005, 2, 1.01), (S.half_up, None, 2, None), (S.half_up, 1e300, 2, None)])
def test_rounding(spark, rule, x, digits, want):
    assert one(spark, rule(F.lit(x).cast("double"), digits)) == (want,)


def test_quantiles_interpolate(spark):
    df = spark.createDataFrame([(10.0,), (20.0,), (30.0,), (40.0,)], "x double")
    assert exact(df.withColumn("g", F.lit(None).cast("string")), ["g"], "x", 0.25, 0.5, 0.75).first()["q"] == [17.5, 25.0, 32.5]
    rows = [(i % 3, float(i * 7919 % 101)) for i in range(500)] + [(3, None), (4, 2.0)]
    got = {r["g"]: r["q"] for r in exact(spark.createDataFrame(rows, "g int, x double").repartition(7), ["g"], "x", 0.0, 0.1, 0.5, 0.99, 1.0).collect()}
    want = {g: np.quantile([x for k, x in rows if k == g], [0, 0.1, 0.5, 0.99, 1]) for g in (0, 1, 2, 4)}
    assert set(got) == set(want) and all(np.allclose(got[g], want[g]) for g in want)


def test_text(spark):
    assert one(spark, S.words(F.lit("  Jesús-MARÍA ")), S.slug(F.lit("Ñandú & Cía.")), S.slug(F.lit("--")), S.clean(F.lit(" a \t b\n"))) == ("jesus maria", "nandu-cia", "unknown", "a b")
    assert one(spark, T.domain(F.lit("https://www.Example.com./a?b")), T.url_key(F.lit(" http://A.b/C// ")), T.safe_url(F.lit("ftp://x"))) == ("example.com", "http://a.b/c", None)


def test_intents(spark):
    rows = [("Dame un resumen", True, True, "ready"), ("¿Por qué subió el precio? resumen", True, True, "refused"), ("zzz", True, True, "unknown_intent"), (None, True, True, "invalid_input"), ("<> ", True, True, "invalid_input"), ("resumen " * 90, True, True, "invalid_input"), ("resumen", False, True, "contract_unavailable"), ("resumen", True, False, "insufficient")]
    df = spark.createDataFrame(rows, "text string, contract boolean, scenario boolean, want string").withColumn("q", T.normalised(F.col("text"))).withColumn("found", T.classify(F.col("q"), F.lit(None).cast("string")))
    assert [r[0] for r in df.select(T.guard(F.col("text"), F.col("q"), F.col("found"), F.col("contract"), F.col("scenario"))).collect()] == [r[3] for r in rows]
    one_by = lambda text, explicit=None: spark.range(1).select(T.classify(T.normalised(F.lit(text)), F.lit(explicit).cast("string"))).first()[0]
    asks = {  # what people ask, and what it should be taken for
        "¿Por qué se dio el aumento de los precios?": "causality", "¿Cuál fue el motivo de la baja?": "causality", "¿Qué provocó que subieran?": "causality", "¿Cuál será la absorción?": "prediction", "haz un forecast": "prediction", "Dame los leads": "personal_data", "busca en Google": "external_data",
        "¿Qué calidad tiene la muestra?": "coverage-quality", "Muéstrame los documentos": "qualitative-evidence", "diferencias entre proyectos": "project-comparison", "prioriza la agenda": "signal-priority", "evolución de precios": "market-changes", "límites de esta demo": "limitations", "panorama": "scenario-summary",
        "precio general del distrito": None, "subasta": None,
    }
    found = {q: one_by(q) for q in asks}
    assert {q: f["topic"] or f["intent"] for q, f in found.items()} == asks
    own = (T.Rule("intent", "greeting", (("hola ", "buenos dias "),)),)
    assert spark.range(1).select(T.classify(T.normalised(F.lit("¡Hola, hola!")), F.lit(None).cast("string"), own)["intent"]).first()[0] == "greeting"
    assert tuple(one_by("¿A qué precio de cierre se vendió?", "scenario-summary")) == ("limitations", "closing_price", "limitation")
    assert tuple(one_by("hola", "scenario-summary")) == ("scenario-summary", None, "explicit_intent")
    assert tuple(one_by("qué SEÑAL certificada conviene revisar primero")) == ("signal-priority", None, "suggested_question")
    assert tuple(one_by("Cobertura y proyectos seleccionados")) == ("coverage-quality", None, "keyword_catalog")
    assert tuple(one_by("hola")) == (None, None, "unknown")


def test_normal_forms(spark):
    """Marks go from letters of any script, however they were written; letters that only look marked stay."""
    assert one(spark, U.unmarked(F.lit("e\u0301ñŽởΆй łø")), U.words(F.lit("A\u030angströ\u0308m — ŻÓŁW"))) == ("enZoΑи łø", "angstrom zo w")
    assert one(spark, U.normal(F.lit("n\u0303"), "NFC"), U.normal(F.lit("ñ"), "NFD"), U.normal(F.lit(None).cast("string"))) == ("ñ", "n\u0303", None)
    assert one(spark, T.safe_text(F.lit(" <a>\x07b\tc\n")), T.safe_text(F.lit(None).cast("string"))) == ("ab\tc", "")


def test_distance_and_polygon(spark):
    metres = S.haversine(F.lit(0.0), F.lit(0.0), F.lit(0.00449660181862269), F.lit(0.0))
    assert one(spark, S.half_up(metres, 6)) == (500.0,)
    outer, hole = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)], [(1.0, 1.0), (2.0, 1.0), (2.0, 2.0), (1.0, 2.0)]
    inside = lambda x, y: G.in_polygon(F.lit(x), F.lit(y), [outer, hole])
    assert one(spark, inside(0.0, 2.0), inside(1.0, 1.5), inside(1.5, 1.5), inside(3.0, 3.0), inside(5.0, 1.0)) == (True, False, False, True, False)


def test_a_point_on_both_medians_is_north_east(spark):
    df = spark.createDataFrame([(1, "d", 1.0, 1.0), (2, "d", 2.0, 2.0), (3, "d", 3.0, 3.0)], "listing_id long, district string, lat double, lon double").withColumns({"price": F.lit(1.0), "ppm": F.lit(1.0), "agency": F.lit("a")})
    assert {r["listing_id"]: r["quadrant"] for r in G.quadrants(df).collect()} == {1: "SW", 2: "NE", 3: "NE"}


def test_score_counts_only_what_is_known(spark):
    t = C.Target(0.0, 0.0, 500.0, 80.0, 2, "a", 2027, 8000.0)
    rows = [(1, 0.001124150454655672, 0.0, 72.0, 2, 3, "a", 2026, 7200.0), (2, None, None, 72.0, None, None, "a", None, None), (3, None, None, None, None, None, None, None, None)]
    got = {r["listing_id"]: r for r in C.score(spark.createDataFrame(rows, "listing_id long, lat double, lon double, area double, bedrooms_min int, bedrooms_max int, typology string, delivery_year int, ppm double"), t).collect()}
    assert [got[1][k] for k in ("geography", "area", "bedrooms", "typology", "delivery", "ppm", "weight", "score", "label")] == [22.5, 18.0, 15.0, 10.0, 5.0, 13.5, 100, 84.0, "Alta"]
    assert got[2]["weight"] == 30 and got[2]["label"] == "Insuficiente" and got[3]["score"] is None


def test_changes(spark):
    rows = [(1, 7, "price", "2024-01-01", 600000.0), (2, 7, "price", "2024-02-01", 630000.0), (3, 7, "price", "2024-03-01", 0.0), (4, 7, "price", "2024-04-01", 5.0)]
    df = spark.createDataFrame(rows, "event_id long, entity_id long, field string, ts string, value double").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    got = {r["event_id"]: r for r in H.assess(H.lag_change(df), "2025-01-01 00:00:00").collect()}
    assert (got[2]["delta"], got[2]["percent"], got[2]["status"]) == (30000.0, 5.0, "certified")
    assert (got[3]["reasons"], got[3]["status"]) == ("extreme_change", "reviewable")
    assert (got[4]["percent"], got[4]["reasons"], got[4]["status"]) == (None, "base_zero", "reviewable")


def test_normal_forms_take_texts_piece_by_piece(monkeypatch):
    texts = [None, "", "e\u0301", "n\u0303o", "\u1100\u1161", "x" * 400, "é"] * 30
    seen = []
    monkeypatch.setattr(U, "PIECE", 100)
    monkeypatch.setattr(U.pa, "concat_arrays", lambda parts, own=U.pa.concat_arrays: seen.extend(map(len, parts)) or own(parts))
    for form in ("NFC", "NFD", "NFKC"):
        for own in (texts, texts[:1], []):
            assert U.composed(U.pa.array(own, U.pa.string()), form).to_pylist() == [x if x is None else U.unicodedata.normalize(form, x) for x in own]
    assert max(seen) < 20
