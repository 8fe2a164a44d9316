"""Grids and their columns, file manifests, schema histories, anchored series, commodities, assignments, HTML tables in SQL, countries."""

import datetime
import glob
import os

import pytest
from pyspark.sql import functions as F

from tallyhouse.functions import text
from tallyhouse.operators import directory, export, history, state
from tallyhouse.sources import pages, payloads


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_a_manifest_shows_every_fault(spark, tmp_path):
    folder = str(tmp_path / "bundle")
    rows = spark.range(60).select(F.col("id").alias("offer_id"), F.concat(F.lit("S"), F.col("id") % 3).alias("source_key"), F.lit("x").alias("text"))
    export.write_bundle({"current": rows, "empty": rows.limit(0)}, folder)
    sealed = spark.createDataFrame(payloads.manifest(spark, folder).collect())
    assert payloads.verified(sealed, payloads.manifest(spark, folder)).count() == 0
    whole = payloads.roots(sealed, 0).collect()
    parts = payloads.roots(sealed, 3)
    assert len(whole) == 1 and whole[0]["bytes"] == sum(r["bytes"] for r in sealed.collect()) and parts.count() == 6
    by = {f"S{k}": sorted(glob.glob(f"{folder}/json/current/source_key=S{k}/part-*")) for k in range(3)}
    with open(by["S0"][0], "r+b") as f:  # one byte, the same length
        f.seek(5)
        f.write(b"#")
    for hidden in glob.glob(f"{folder}/json/current/source_key=S*/.*.crc"):
        os.remove(hidden)
    os.remove(by["S1"][0])
    with open(f"{folder}/json/current/source_key=S2/part-extra.json", "w") as f:
        f.write("{}\n")
    with open(by["S2"][0], "a") as f:
        f.write("{}\n")
    found = {r["file"].rpartition("/")[2]: r["fault"] for r in payloads.verified(sealed, payloads.manifest(spark, folder)).collect()}
    name = lambda k: os.path.basename(by[k][0])
    assert found == {name("S0"): "changed", name("S1"): "missing", "part-extra.json": "unexpected", name("S2"): "resized"}
    now = {r["part"]: r["sha256"] for r in payloads.roots(payloads.manifest(spark, folder), 3).collect()}
    assert {r["part"] for r in parts.collect() if now.get(r["part"]) != r["sha256"]} == {f"json/current/source_key=S{k}" for k in range(3)}


def test_columns_follow_their_groups(spark):
    attributes = spark.createDataFrame(
        [(1, "Width", "Measures", "10", 1), (1, "Width", "Measures", "12", 2), (1, "Color", "Looks", "red", 1), (2, "Width", "Notes", "9", 1), (2, "Other", None, "o", 1), (2, "Blank", "Measures", "", 1), (9, "Price", "Measures", "p", 1)],
        "product_id long, label string, attribute_group string, raw_value string, at int",
    )
    assert [tuple(r) for r in export.ranked_labels(attributes, ("Measures", "Looks")).orderBy("place").collect()] == [("Blank", "Measures", 1), ("Price", "Measures", 2), ("Width", "Measures", 3), ("Color", "Looks", 4), ("Other", "", 5)]
    with pytest.raises(ValueError):
        export.columns_of(export.ranked_labels(attributes, ()), most=2)
    rows = spark.createDataFrame(
        [(k, p, float(price), "SAR", "*", s, 1.0 + k, 2.0 + k, tax, f"Color: {c}", a, "axis") for k, p, price, s, tax, c, a in [(1, 1, 5, 1, "t", "red", "in"), (2, 1, 5, 2, "t", "blue", "out"), (3, 1, 6, 3, "u", "green", "in"), (4, 2, 5, 4, None, "", "in"), (5, 3, 5, 5, "t", "", "in")]],
        "offer_id long, product_id long, price double, currency string, region string, sort int, price_min double, price_max double, tax string, variant string, availability string, Color string",
    )
    out = export.grid(rows, attributes, ("Measures", "Looks"), True, 4, axes=["Color"], joined=("variant",))
    assert out.columns[-4:] == ["Color", "Blank", "Width", "Other"]  # the axis has a label's name: it stays, once; product 9 isn't shown
    got = {r["offer_id"]: r for r in out.collect()}
    assert set(got) == {1, 3, 4} and all(r["truncated"] for r in got.values())
    first = got[1]
    assert (first["offer_ids"], first["variants"], first["variant"], first["availability"], first["price_min"], first["price_max"]) == ([1, 2], 2, "Color: blue, Color: red", None, 2.0, 4.0)
    assert (first["Width"], got[4]["Width"], got[4]["Other"], first["Other"]) == ("12", "9", "o", "")
    assert {r["tax"]: r["tax_id"] for r in got.values()} == {None: 1, "t": 2, "u": 3}
    plain = export.grid(rows, attributes.limit(0), (), False, 10)
    assert plain.count() == 5 and not any(r["truncated"] for r in plain.collect())


def test_a_whole_grid_keeps_what_a_page_cuts(spark):
    rows = spark.range(9).select(F.col("id").alias("offer_id"), F.col("id").alias("product_id"), F.lit(1.0).alias("price"), F.lit("SAR").alias("currency"), F.lit("*").alias("region"), F.col("id").alias("sort"), F.lit(1.0).alias("price_min"), F.lit(1.0).alias("price_max"), F.lit("t").alias("tax"))
    none = spark.createDataFrame([], "product_id long, label string, attribute_group string, raw_value string, at int")
    for fold in (False, True):
        got = {most: export.grid(rows, none, (), fold, most, whole=True).select("offer_id", "truncated").collect() for most in (4, 8, 9)}
        assert [(sorted(r["offer_id"] for r in x), {r["truncated"] for r in x}) for x in got.values()] == [(list(range(9)), {cut}) for cut in (True, True, False)]
        assert export.grid(rows, none, (), fold, 4).count() == 4


def test_schema_versions_go_on(spark):
    seen = [("d", k, f) for k, f in enumerate([["a"], ["a"], ["a", "b"], ["b"], ["c", "b", "a"], ["a"], ["b", "c", "a"], ["d"]])] + [("e", 1, ["x"])]
    got = state.schema_history(spark.createDataFrame(seen, "dataset string, at int, fields array<string>"), ["dataset"])
    assert [tuple(r)[1:] for r in got.where("dataset = 'd'").orderBy("at").collect()] == [(0, "first", 1), (1, "same", 1), (2, "widened", 2), (3, "refused", 2), (4, "widened", 3), (5, "known", 1), (6, "same", 3), (7, "refused", 3)]
    assert got.count() == 9


def test_only_anchored_series_count(spark):
    series = spark.createDataFrame([("a", 1, 5), ("a", 2, 5), ("a", 3, 6), ("b", 1, 5), ("c", 1, 5)], "k string, at int, price int")
    kept, verdicts = history.anchored(series, spark.createDataFrame([("a", 6), ("b", 9)], "k string, price int"), "k", ["at"], "price")
    assert rows_of(kept) == [("a", 1, 5), ("a", 3, 6)]
    assert rows_of(verdicts) == [("a", 3, "anchored"), ("b", 1, "unanchored"), ("c", 1, "no anchor")]


def test_commodities_are_products(spark):
    day = datetime.date(2020, 5, 1)
    rows = spark.createDataFrame(
        [("oil", " ", None, "EG", "EGP", 1.0, None, "", None, "2024-01-02T00:00:00Z"), ("oil", "Oil", "زيت", "EG", "EGP", 1.0, "USD/l", "reported", day, "2024-01-02T00:00:00Z"), ("oil", "Oil", "", "EG", "EGP", 1.0, "", "reported", None, "2024-01-02T00:00:00Z")],
        "material_key string, material_label string, material_label_ar string, country_code_alpha2 string, currency string, price double, unit string, provenance string, as_of_date date, scraped_at string",
    )
    got = directory.commodity_products(rows, "scraped_at").select("product_name", "product_name_ar", "unit", "provenance", "business_date").collect()
    crawled = datetime.date(2024, 1, 2)
    assert [tuple(r) for r in got] == [("oil", "", "", "observed", crawled), ("Oil", "زيت", "USD/l", "reported", day), ("Oil", "", "", "observed", crawled)]


def test_assignments_by_variant_and_region(spark):
    day = datetime.date(2024, 1, 1)
    feeds = spark.createDataFrame(
        [(1, 10, day, 1, None, "*", 30), (1, 11, day, 1, None, "north", 30), (1, 12, day, 1, 7, "*", 30), (1, 13, day, 0, 7, "north", 5), (1, 14, day, 2, 8, "south", 30)],
        "product_id long, source_id int, last_seen date, priority int, variant_id int, region string, days int",
    )
    fields = spark.createDataFrame([(1, v, r) for v in (7, 8) for r in ("north", "south")] + [(2, 7, "north")], "product_id long, variant_id int, region string")
    at = lambda today: {(r["of_variant"], r["of_region"]): r["source_id"] for r in directory.assignments(feeds, fields, F.col("days"), today).collect()}
    assert at("2024-01-03") == {(7, "north"): 13, (7, "south"): 12, (8, "north"): 11, (8, "south"): 10}
    assert at("2024-01-20") == {(7, "north"): 12, (7, "south"): 12, (8, "north"): 11, (8, "south"): 10}
    assert at("2025-01-20") == {}


def test_tables_in_sql(spark):
    pages.register_sql(spark)
    page = "<table><tr><th>a</th></tr><tr><td>1</td></tr></table><table><tr><td>x</td><td>y</td></tr></table>"
    got = spark.sql("SELECT t.* FROM VALUES (1, :page), (2, null), (3, '') AS p(id, html), LATERAL parse_html_tables(p.html) t", args={"page": page}).collect()
    assert [(r["table_no"], r["header"], r["rows"]) for r in got] == [(0, ["a"], [["1"]]), (1, ["Column 1", "Column 2"], [["x", "y"]])]
    with pytest.raises(Exception, match="one text"):
        spark.sql("SELECT * FROM parse_html_tables(3)").collect()


def test_every_country_has_a_name(spark):
    names = text.country_names(spark)
    assert len(names) > 240 and names["EG"] == "Egypt" and names["SA"] == "Saudi Arabia" and names["FR"] == "France"
    rows = spark.createDataFrame([("fr",), ("BR",), ("*",), (None,), ("XX",)], "code string")
    named = rows.select(text.region_name("code", names).alias("n"))
    assert [r["n"] for r in named.collect()] == ["France", "Brazil", "", "", "XX"]
    assert [r["c"] for r in named.select(text.region_code(F.upper("n"), names).alias("c")).collect()] == ["FR", "BR", "", "", ""]


def test_marks_with_points_leave_the_amount(spark):
    rows = spark.createDataFrame([(x,) for x in ("L.E. 1,234.50", "1.234,5 ر.س", "ج.م 7", "SAR12.5LE", "€-3", "..", "12,5", "1,234", None)], "t string")
    got = [None if r["m"] is None else float(r["m"]) for r in rows.select(text.parse_money("t").alias("m")).collect()]
    assert got == [1234.5, 1234.5, 7.0, 12.5, -3.0, None, 12.5, 1234.0, None]


def counting(spark):
    """A number, and a function whose rows are counted in it as often as they are computed."""
    made = spark.sparkContext.accumulator(0)

    def each(parts):
        for part in parts:
            made.add(part.num_rows)
            yield part

    return made, lambda df: df.mapInArrow(each, df.schema)


def test_a_bundle_computes_its_tables_once(spark, tmp_path):
    made, counted = counting(spark)
    folder = str(tmp_path / "bundle")
    rows = spark.range(60).select(F.col("id").alias("offer_id"), F.concat(F.lit("S"), F.col("id") % 3).alias("source_key"), F.lit('a "b", c').alias("text"), F.lit(None).cast("double").alias("price"))
    export.write_bundle({"current": counted(rows), "empty": rows.limit(0), "more": counted(rows)}, folder)
    assert made.value == 120
    assert [p.name for p in tmp_path.iterdir()] == ["bundle"] and not os.path.exists(f"{folder}/json/empty")
    schema = {k: "offer_id long, text string, price double, source_key string" for k in ("current", "more")}
    json, csv = (export.contents(spark, folder, schema, kind) for kind in ("json", "csv"))
    assert export.faults(json, csv, ["table", "source_key"]).isEmpty()
    assert rows_of(json.select("table", "source_key", "rows")) == [(t, f"S{k}", 20) for t in ("current", "more") for k in range(3)]


def test_two_exports_are_made_from_one_computation(spark, sf_dir, monkeypatch):
    from tallyhouse import catalog

    made, counted = counting(spark)
    latest, offers = history.latest_per_offer, []

    def watched(obs):
        offers.append(latest(obs).count())
        return counted(latest(obs))

    monkeypatch.setattr(history, "latest_per_offer", watched)
    found = catalog.queries()["s11_export_faults"](spark, sf_dir).collect()
    assert len(offers) == 1 and made.value == offers[0] > 0
    assert sorted(map(tuple, found)) == [("ASIA", "missing"), ("EUROPE", "changed"), ("ORIENT", "unexpected")]
