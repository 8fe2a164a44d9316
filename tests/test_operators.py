"""Operators on hand-written rows: edges that the given tables don't hold."""

import datetime

import pytest
from pyspark.sql import functions as F

from tallyhouse.functions import text as x
from tallyhouse.operators import history, ingest, lookups, matching, state
from tallyhouse.sources import pages, payloads


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(f(F.col("c")).alias("r")).first()["r"]


@pytest.mark.parametrize("said, amount", [("1,234.56", 1234.56), ("1.234,56", 1234.56), ("129.38 SAR", 129.38), ("1,234", 1234), ("12,5", 12.5), ("٣٬٤٥٠٫٥", 3450.5), ("", None), ("n/a", None), (None, None),
    ("129.38 ر.س", 129.38), ("ر.س 129.38", 129.38), ("L.E. 120", 120), ("120 L.E.", 120), ("ج.م 1,234.56", 1234.56), ("LE 12", 12), ("-5 €", -5), ("ريال ١٢", 12)])
def test_money(spark, said, amount):
    got = one(spark, said, x.parse_money)
    assert (None if got is None else float(got)) == amount
    assert one(spark, said, x.money_error) in ((True,) if said == "n/a" else (False, None))


UNITS = [
    ("USD/liter", "EGP", "liter"), ("sar/kg", "SAR", "kg"), ("kg/m2", "SAR", "kg/m2"), ("sqm", "", "m2"),
    ("Liters", "", "liter"), ("pcs.", "", "piece"), ("أمتار", "", "m"), ("kWh", "", "kWh"),
    (" ", "SAR", None), ("Metric Ton", "", "tonne"), ("SAR / m²", "EGP", "m2"), ("roll", "", "roll"),
]


@pytest.mark.parametrize("said, currency, unit", UNITS)
def test_units(spark, said, currency, unit):
    got = spark.createDataFrame([(said, currency)], "u string, c string").select(x.canonical_unit("u", "c").alias("r"), x.canonical_unit("u").alias("alone")).first()
    assert got["r"] == unit
    if not currency:
        assert got["alone"] == unit


def test_fingerprint_sorts_keys_as_written(spark):
    got = one(spark, {"Size": " ١٠ ", "color": "Red"}, x.option_fingerprint, "map<string,string>")
    assert got == "size=10|color=red"


def test_markup(spark):
    assert one(spark, "<p>a&amp;lt; <b>b</b><script>no()</script>&nbsp;c</p>", x.strip_markup) == "a&lt; b c"


def observations(spark, rows):
    schema = "offer_id long, observed_at timestamp, ord1 long, ord2 long, ord3 long, ord4 long, price decimal(18,4), currency string, tax_included int, provenance string, business_date date, availability string"
    out = []
    for k, (offer, day, price, currency, tax, *provenance) in enumerate(rows):
        at = datetime.datetime(2024, 1, day)
        out.append((offer, at, k, 0, 0, 0, __import__("decimal").Decimal(price), currency, tax, *(provenance or ["observed"]), at.date(), "in_stock"))
    return spark.createDataFrame(out, schema)


def test_timeline_reasons(spark):
    obs = observations(spark, [(1, 1, 10, "SAR", 0), (1, 2, 10, "SAR", 0), (1, 3, 12, "SAR", 0), (1, 4, 12, "EGP", 0), (1, 5, 12, "EGP", 1)])
    got = [(r["opened_because"], r["first_detected_at"].day, r["last_confirmed_at"].day, r["closed_at"] and r["closed_at"].day) for r in history.timeline(obs).orderBy("period_no").collect()]
    assert got == [("first_seen", 1, 2, 3), ("price_change", 3, 3, 4), ("currency_change", 4, 4, 5), ("fields_changed", 5, 5, None)]


def test_price_on(spark):
    periods = history.timeline(observations(spark, [(1, 5, 10, "SAR", 0), (1, 9, 10, "SAR", 0), (1, 15, 12, "SAR", 0)]))
    asked = spark.createDataFrame([(1, datetime.date(2024, 1, d)) for d in (1, 6, 12, 20)] + [(2, datetime.date(2024, 1, 6))], "offer_id long, day date")
    got = {(r["offer_id"], r["day"].day): (r["status"], r["price"] and int(r["price"])) for r in history.price_on(asked, periods).collect()}
    assert got == {(1, 1): ("before_tracking", None), (1, 6): ("confirmed", 10), (1, 12): ("last_known", 10), (1, 20): ("last_known", 12), (2, 6): ("no_history", None)}


def test_latest_takes_observed_before_reported(spark):
    obs = observations(spark, [(1, 1, 10, "SAR", 0), (1, 9, 99, "SAR", 0, "reported"), (2, 3, 5, "SAR", 0, "reported")])
    assert {(r["offer_id"], int(r["price"])) for r in history.latest_per_offer(obs).collect()} == {(1, 10), (2, 5)}


def test_week_numbers_start_on_monday(spark):
    days = [datetime.date(y, 1, 1) + datetime.timedelta(d) for y in (2023, 2024, 2025) for d in (0, 1, 5, 6, 7, 8, 200, 363, 364)]
    got = spark.createDataFrame([(d,) for d in days], "d date").select("d", history.week_of("d").alias("w")).collect()
    assert all(r["w"] == int(r["d"].strftime("%W")) for r in got)


def test_payload_reasons(spark, tmp_path):
    import json

    good = {"payload_version": 3, "source_key": "a", "scraped_at": "2024-01-01T00:00:00Z", "header": ["id", "price"], "rows": [["1", "2"]], "run_ref": "r"}
    files = {"good": good, "old": good | {"payload_version": 1}, "new": good | {"payload_version": 9}, "stamp": good | {"scraped_at": "today"}, "ragged": good | {"rows": [["1"]]}, "drift": good | {"header": ["id", "cost"]}}
    for name, body in files.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(body))
    (tmp_path / "torn.json").write_text('{"payload_version": 3, "rows": [[')
    ok, bad = payloads.checked(payloads.read_payloads(spark, str(tmp_path)), ["id", "price"])
    assert {r["reason"] for r in bad.collect()} == {"unreadable", "too old", "too new", "no UTC stamp", "ragged rows", "header drift"}
    assert [r.asDict() for r in payloads.named_rows(ok, ["id", "price", "extra"]).select("id", "price", "extra").collect()] == [{"id": "1", "price": "2", "extra": ""}]


def test_html_tables(spark):
    html = "<table aria-label='x'><tr><th>a<th>b</tr><tr><td>1</td><td colspan=2>2 <i>x</i></td></tr><tr><td>3</td></tr></table>"
    (caption, header, rows, confidence, warnings), = pages.tables_of(html)
    assert (caption, header, rows, confidence, warnings) == ("x", ["a", "b"], [["1", "2 x"], ["3", ""]], 0.88, ["merged cells", "uneven rows"])
    plain = "<table><tr><td>1<td>2</tr><tr><td>3<td>4</tr><tr><th>total<td>6</tr></table>"
    (caption, header, rows, confidence, warnings), = pages.tables_of(plain)
    assert (header, rows, confidence, warnings) == (["Column 1", "Column 2"], [["1", "2"], ["3", "4"], ["total", "6"]], 0.7, ["no header row"])
    two = "<table><caption>c</caption><thead><tr><td>x</tr><tr><th>a<td></tr></thead><tr><td>1<td>2<td>3</tr><tr><th>sum<td>2</tr></table>"
    (caption, header, rows, confidence, _), = pages.tables_of(two)
    assert (caption, header, rows, confidence) == ("c", ["a", "Column 2", "Column 3"], [["1", "2", "3"], ["sum", "2", ""]], 0.95)
    assert pages.tables_of("<table><thead><tr><th>a</tr></thead><tr><td>1</tr></table>")[0][3] == 0.88
    assert pages.html_tables(spark.createDataFrame([(1, None), (2, "<p>")], "page_id long, html string")).count() == 0


def test_rules_prefer_the_more_specific(spark):
    facts = spark.createDataFrame([("s", "r1", "m1"), ("s", "r1", "m2"), ("s", "r2", "m1"), ("t", "r1", "m1")], "source_key string, region string, material_key string")
    rules = spark.createDataFrame([("s", "*", "*", 1), ("s", "*", "m1", 2), ("s", "r1", "*", 3)], "source_key string, region string, material_key string, v int")
    got = {tuple(r)[:3]: r["v"] for r in lookups.most_specific(facts, rules, ["region", "material_key"], ["source_key"]).collect()}
    assert got == {("s", "r1", "m1"): 3, ("s", "r1", "m2"): 3, ("s", "r2", "m1"): 2, ("t", "r1", "m1"): None}


def test_fuzzy_names_equal_brute_force(spark):
    import itertools
    import random

    r = random.Random(1)
    name = lambda: " ".join(r.choice("red blue big small iron steel pipe rod".split()) for _ in range(r.randrange(1, 6)))
    ps, ms = [(k, name()) for k in range(60)], [(k, name()) for k in range(60)]
    got = {(x["product_id"], x["material_id"]) for x in matching.by_name(spark.createDataFrame(ps, "product_id long, n string"), spark.createDataFrame(ms, "material_id long, n string"), ["n"], ["n"]).collect()}
    want = {(a, b) for (a, p), (b, m) in itertools.product(ps, ms) if len(set(p.split()) & set(m.split())) / len(set(p.split()) | set(m.split())) >= 0.55}
    assert got == want


def test_upsert_never_clears(spark):
    state = spark.createDataFrame([(1, "a", True), (2, "b", False)], "k long, v string, active boolean")
    new, changes = ingest.upserted(state, spark.createDataFrame([(1, " "), (2, "c"), (3, None)], "k long, v string"), "k", ["v"])
    assert {tuple(r) for r in new.collect()} == {(1, "a", True), (2, "c", True), (3, None, True)}
    assert {(r["k"], r["change_type"]) for r in changes.collect()} == {(2, "returned"), (2, "changed"), (3, "new")}


def test_schema_verdicts(spark):
    rows = [(k, new, old) for k, (old, new) in enumerate([(["a", "b"], ["a"]), (["a", "b"], ["b", "a"]), (["a", "b"], ["a", "b", "c"]), (None, ["a"])])]
    got = state.schemas_after(spark.createDataFrame(rows, "k int, new array<string>, old array<string>")).orderBy("k").collect()
    assert [(r["verdict"], r["version"]) for r in got] == [("refused", 1), ("same", 1), ("widened", 2), ("first", 1)]
    assert got[0]["schema_hash"] == got[1]["schema_hash"] != got[2]["schema_hash"]


def test_rule_versions_close_and_open(spark):
    day = datetime.date
    stored = [("s", "r", "a", 1, day(2020, 1, 1), None), ("s", "r", "b", 1, day(2020, 1, 1), None), ("s", "r", "c", 1, day(2020, 1, 1), None), ("s", "r", "b", 9, day(2019, 1, 1), day(2020, 1, 1))]
    now = [("s", "r", "a", 1), ("s", "r", "b", 2), ("s", "r", "d", 3)]
    kind = "source_key string, region string, material_key string, rate int"
    keys = ["source_key", "region", "material_key"]
    after = state.rules_after(spark.createDataFrame(stored, f"{kind}, valid_from date, valid_to date"), spark.createDataFrame(now, kind), keys, ["rate"], "2021-05-05")
    t = day(2021, 5, 5)
    want = {("a", 1, day(2020, 1, 1), None), ("b", 1, day(2020, 1, 1), t), ("b", 2, t, None), ("c", 1, day(2020, 1, 1), t), ("d", 3, t, None), ("b", 9, day(2019, 1, 1), day(2020, 1, 1))}
    assert {(r["material_key"], r["rate"], r["valid_from"], r["valid_to"]) for r in after.collect()} == want


def test_confirmations_survive_a_rebuild(spark):
    obs = observations(spark, [(1, 1, 10, "SAR", 0), (1, 2, 10, "SAR", 0), (1, 3, 12, "SAR", 0), (1, 4, 12, "SAR", 0)])
    seen = lambda good: obs.withColumn("status", F.when(F.dayofmonth("observed_at").isin(good), "success").otherwise("partial"))
    first = state.confirmed_periods(seen([2, 4]))
    again = state.carried(state.confirmed_periods(seen([3])), first, ["offer_id", "first_detected_at", "price", "currency"])
    assert [r["confirmed_at"].day for r in first.orderBy("period_no").collect()] == [2, 4]
    assert [r["confirmed_at"].day for r in again.orderBy("period_no").collect()] == [2, 4]


def test_facts_are_never_pruned(spark):
    with pytest.raises(ValueError):
        state.pruned("obs", None, "business_date", "2024-01-01")


def test_append_new_is_idempotent(spark, tmp_path):
    from tallyhouse.streaming import jobs

    sink = jobs.append_new(["k", "day"], str(tmp_path / "t"), "day")
    for rows in ([(1, "a", 1), (1, "a", 1), (2, "b", 1)], [(1, "a", 1), (1, "a", 2), (3, "c", 1)]):
        for _ in range(2):
            sink(spark.createDataFrame(rows, "k long, v string, day int"), 0)
    got = spark.read.parquet(str(tmp_path / "t")).select("k", "day").collect()
    assert sorted(map(tuple, got)) == [(1, 1), (1, 2), (2, 1), (3, 1)]


def test_changes_carry_over_between_runs_and_late_rows_are_told(spark, tmp_path):
    from tallyhouse.streaming import jobs

    at = lambda day: datetime.datetime(2024, 1, day)
    runs = [[(1, at(1), 10.0, "SAR"), (1, at(2), 10.0, "SAR")], [(1, at(4), 10.0, "SAR"), (1, at(3), 11.0, "SAR")], [(1, at(2), 9.0, "SAR"), (1, at(9), 10.0, "EGP")]]
    schema = "offer_id long, observed_at timestamp, price double, currency string"
    for rows in runs:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        out = jobs.stored(jobs.price_changes(jobs.file_stream(spark, str(tmp_path / "in"), schema)), str(tmp_path / "work"))
    got = [(r["observed_at"].day, r["reason"]) for r in out.orderBy("batch", "observed_at").collect()]
    assert got == [(1, "first_seen"), (3, "price_change"), (4, "price_change"), (2, "late"), (9, "currency_change")]


def test_price_changes_need_no_python_for_each_offer(spark, tmp_path):
    from tallyhouse.streaming import jobs

    at = lambda day: datetime.datetime(2024, 1, day)
    schema = "offer_id long, observed_at timestamp, price double, currency string"
    rows = [[(1, at(2), 1.0, "SAR"), (2, at(2), None, "SAR"), (2, at(3), None, "SAR")], [(2, at(4), 5.0, "SAR"), (1, at(1), 9.0, "SAR")], [(1, at(2), 1.0, "SAR"), (2, at(4), 5.0, None)], [(1, at(3), 2.0, "SAR")]]
    seen, step = [], jobs.changes_after

    def watched(held, batch):
        out = step(held, batch)
        seen.append(sorted((r["offer_id"], r["price"]) for r in held.collect()))
        assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
        return out

    for part in rows:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = jobs.file_stream(spark, str(tmp_path / "in"), schema)
        out = jobs.stored(jobs.price_changes(stream)._replace(step=watched), str(tmp_path / "work"))
    got = sorted((r["batch"], r["offer_id"], r["reason"]) for r in out.collect())
    assert got == [(0, 1, "first_seen"), (0, 2, "first_seen"), (1, 1, "late"), (1, 2, "price_change"), (2, 2, "currency_change"), (3, 1, "price_change")]
    assert seen == [[], [(1, 1.0), (2, None)], [(1, 1.0), (2, 5.0)], [(1, 1.0), (2, 5.0)]]
    assert sorted(p.parent.name for p in (tmp_path / "work" / "out").glob("batch=*/kind=open")) == ["batch=2", "batch=3"]


def test_append_new_computes_a_batch_once_and_finds_rows_without_a_key(spark, tmp_path):
    from tallyhouse.streaming import jobs

    made = spark.sparkContext.accumulator(0)

    def counted(parts):
        for part in parts:
            made.add(part.num_rows)
            yield part

    sink = jobs.append_new(["k", "v"], str(tmp_path / "t"), "day")
    for rows in ([(1, "a", 1), (1, "a", 1), (None, "b", None)], [(1, "a", 1), (None, "b", None), (2, None, 2)]):
        schema = "k long, v string, day int"
        sink(spark.createDataFrame(rows, schema).mapInArrow(counted, schema), 0)
    got = spark.read.parquet(str(tmp_path / "t")).select("k", "v", "day").collect()
    assert sorted(map(tuple, got), key=str) == [(1, "a", 1), (2, None, 2), (None, "b", None)]
    assert made.value == 6


def test_a_streamed_batch_meets_the_facts_of_its_own_runs(spark, sf_dir, monkeypatch):
    from tallyhouse import catalog
    from tallyhouse.streaming import jobs

    append, touched = jobs.append_new, []

    def watched(keys, target, by):
        write = append(keys, target, by)

        def each(batch, number):
            touched.append((batch.select(by).distinct().count(), batch.select("run_ref").distinct().count()))
            write(batch, number)

        return each

    monkeypatch.setattr(jobs, "append_new", watched)
    out = catalog.queries()["r1_streaming_ingest"](spark, sf_dir)
    assert out.count() == out.distinct().count() > 0
    assert touched and all(parts == 1 < runs for parts, runs in touched)
