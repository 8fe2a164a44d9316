"""Tables that change together: killed runs, replays, planted losses, what was seen, periods over batches, trees of any depth."""

import datetime
import os
import uuid

import pytest
from pyspark.sql import functions as F

from tallyhouse.operators import history, ingest, retention
from tallyhouse.plans.generations import schema_of
from tallyhouse.sources.generations import Refused, Store, compare
from tallyhouse.streaming import jobs


@pytest.fixture
def folder(tmp_path):
    return str(tmp_path / uuid.uuid4().hex)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


OBS = "offer_id long, source_id int, business_date date, observed_at timestamp_ntz, ord1 long, ord2 long, ord3 long, ord4 long, price double, currency string, tax_included int"


def observations(spark, n=40):
    day = datetime.date(1997, 1, 1)
    rows = []
    for k in range(n):
        d = day + datetime.timedelta(days=k * 9)
        rows.append((k % 3, k % 2, d, datetime.datetime(d.year, d.month, d.day), k, 0, 0, 0, float((k * 7) % 5), "SAR", 1))
    return spark.createDataFrame(rows, OBS)


def test_a_commit_is_all_or_nothing(spark, folder):
    store = Store(spark, folder, {"a": "x long", "b": "x long"})
    assert store.current() == (0, {}) and store.read("a").count() == 0
    one = spark.range(3).select(F.col("id").alias("x"))
    assert store.commit("first", {"a": one, "b": one}) == 1
    broken = one.select(F.when(F.col("x") >= 0, F.raise_error(F.lit("killed"))).cast("long").alias("x"))
    with pytest.raises(Exception, match="killed"):
        store.commit("second", {"a": one, "b": broken})
    assert store.current()[0] == 1 and store.read("a").count() == 3  # the first table's folder is there, but no row names it
    assert store.commit("second", {"a": one, "b": one}) == 2
    assert store.commit("second", {"a": one, "b": one}) == 2  # again, and nothing happens
    assert (store.read("a").count(), store.read("b").count(), store.read("a", 1).count()) == (6, 6, 3)
    with pytest.raises(Refused):
        store.commit("third", replaced={"a": one}, check=lambda read: [] if read("a").count() > 5 else ["too few"])
    assert store.current()[0] == 2
    assert rows_of(compare({"a": store.read("a"), "b": one}, {"a": store.read("b"), "c": one})) == [("a", 6, 6, True), ("b", 3, None, False), ("c", None, 3, False)]


def test_retention_verifies_what_it_puts_in_force(spark, folder):
    obs = observations(spark)
    site = spark.createDataFrame([(0, "A"), (1, "B")], "source_id int, source_key string")
    store = Store(spark, folder, {"obs": OBS, "site": "source_id int, source_key string"})
    store.commit("load", replaced={"obs": obs, "site": site})
    keys = ["offer_id", "business_date", "ord1"]
    for _ in range(2):  # the second finds its generation committed
        got = {r["entity"]: r for r in retention.compacted(store, "keep", "obs", keys, {}, "archive_only", "1997-10-01").collect()}
        assert got["obs"]["verdict"] == got["site"]["verdict"] == "kept"
        assert got["obs"]["rows_before"] == 40 > got["obs"]["rows_after"] == store.read("obs").count() and store.current()[0] == 2
    before = {"obs": obs, "site": site}
    verdict = lambda after: {r["entity"]: r["verdict"] for r in retention.verification(before, after, "obs", keys).collect()}
    assert verdict({"obs": obs.where("ord1 > 2"), "site": site}) == {"obs": "protected rows lost", "site": "kept"}
    assert verdict({"obs": obs.withColumn("price", F.when(F.col("ord1") == 17, 99.0).otherwise(F.col("price"))), "site": site})["obs"] == "strange rows"
    assert verdict({"obs": obs.unionByName(obs.limit(1)), "site": site})["obs"] == "strange rows"
    assert verdict({"obs": obs, "site": site.limit(1)})["site"] == "not carried whole"
    assert verdict({"obs": obs})["site"] == "not carried whole"


def test_a_generation_is_verified_once_and_by_short_rows(spark, folder, monkeypatch):
    store = Store(spark, folder, {"obs": OBS})
    obs = observations(spark).withColumn("currency", F.when(F.col("ord1") % 2 == 0, F.col("currency")))
    store.commit("load", replaced={"obs": obs})
    verification, plans = retention.verification, []

    def watched(*args):
        out = verification(*args)
        plans.append(out._jdf.queryExecution().optimizedPlan().toString())
        return out

    monkeypatch.setattr(retention, "verification", watched)
    keys = ["offer_id", "business_date", "ord1"]
    first = rows_of(retention.compacted(store, "keep", "obs", keys, {}, "weekly", "1998-01-01"))
    assert len(plans) == 1 and not any("currency" in line.partition("[")[2].partition("]")[0] for line in plans[0].splitlines() if "Aggregate [" in line)
    assert first == rows_of(retention.compacted(store, "keep", "obs", keys, {}, "weekly", "1998-01-01"))
    # A null that changes its place is a strange row.
    moved = obs.where("ord1 <> 17").unionByName(obs.where("ord1 = 17").withColumns({"ord2": F.lit(None).cast("long"), "tax_included": F.lit(None).cast("int")}))
    assert {r["strangers"] for r in verification({"obs": obs}, {"obs": moved}, "obs", keys).collect()} == {1}


def test_a_planted_loss_is_refused(spark, folder, monkeypatch):
    store = Store(spark, folder, {"obs": OBS})
    store.commit("load", replaced={"obs": observations(spark)})
    monkeypatch.setattr(retention, "retained", lambda obs, *_: obs.where("ord1 <> 0"))  # the first of an offer
    with pytest.raises(Refused, match="protected rows lost"):
        retention.compacted(store, "bad", "obs", ["offer_id", "business_date", "ord1"], {}, "weekly", "1998-01-01")
    assert store.current()[0] == 1 and store.read("obs").count() == 40


PRICES = "offer_id long, product_id long, business_date date, record_hash string, price_key string, provenance string, at long, error string"


def prices(spark, *rows):
    return spark.createDataFrame([(o, o // 10, datetime.date(2024, 1, d), f"h{o}-{d}-{p}", str(p), kind, at, error) for o, d, p, at, kind, error in rows], PRICES)


def test_runs_against_the_open_price(spark, folder):
    store = Store(spark, folder, ingest.RUN_TABLES)
    first = prices(spark, (10, 1, 5, 1, "observed", None), (10, 2, 5, 2, "observed", None), (10, 3, 6, 3, "observed", None), (20, 1, 1, 4, "reported", None), (30, 1, 9, 5, "observed", "out of scope"))
    details = spark.createDataFrame([(1, "c", "red"), (1, "c", "blue"), (3, "c", "lost"), (2, "c", " ")], "product_id long, code string, raw_value string")
    broken = details.withColumn("raw_value", F.when(F.col("product_id") > 0, F.raise_error(F.lit("killed"))).cast("string"))
    with pytest.raises(Exception, match="killed"):
        ingest.ingested(store, "one", first, broken, ("at",))
    assert store.current()[0] == 0 and all(store.read(t).count() == 0 for t in ingest.RUN_TABLES)  # prices were written, and don't count
    for _ in range(2):
        ingest.ingested(store, "one", first, details, ("at",))
    report = store.read("run").collect()
    assert len(report) == 1
    r = report[0].asDict()
    assert (r["status"], r["rows_seen"], r["new"], r["confirmed"], r["duplicates"], r["errors"], r["details"]) == ("partial", 5, 3, 1, 0, 2, 3)
    assert rows_of(ingest.details_in_force(store)) == [(1, "c", "blue"), (1, "c", "red")]
    assert not os.path.isdir(f"{folder}/staged") or not os.listdir(f"{folder}/staged")  # a commit leaves nothing beside its tables
    # All of the first run again under another name, and a price that comes back.
    again = first.unionByName(prices(spark, (10, 4, 5, 6, "observed", None), (20, 5, 1, 7, "observed", None)))
    ingest.ingested(store, "two", again, spark.createDataFrame([(1, "c", "green")], "product_id long, code string, raw_value string"), ("at",))
    r = store.read("run").where("run_ref = 'two'").first()
    assert (r["new"], r["confirmed"], r["duplicates"], r["errors"]) == (2, 0, 4, 1)
    assert rows_of(ingest.details_in_force(store)) == [(1, "c", "green")]
    assert rows_of(ingest.newest(store.read("open_price"), ["offer_id"], "price_key")) == [(10, "5"), (20, "1")]
    assert rows_of(store.read("observation").groupBy("offer_id").count()) == [(10, 3), (20, 2)]
    ingest.ingested(store, "none", prices(spark, (40, 1, 1, 1, "observed", "unreadable price")), None, ("at",))
    assert store.read("run").where("run_ref = 'none'").first()["status"] == "failed"


def test_a_batch_is_sequenced_in_one_shuffle(spark):
    batch = prices(spark, (1, 1, 5, 1, "observed", None), (1, 2, 6, 2, "observed", None), (1, 2, 6, 3, "observed", None), (2, 1, 7, 4, "observed", None), (3, 1, 8, 5, "reported", None), (3, 2, 9, 6, "observed", None))
    blank = F.col("offer_id") == 2  # a key of nulls isn't the open price's row
    batch = batch.withColumns({"business_date": F.when(~blank, F.col("business_date")), "record_hash": F.when(~blank, F.col("record_hash"))})
    seen = batch.where("at = 1")
    open_ = spark.createDataFrame([(1, "6"), (2, "7"), (3, "9")], "offer_id long, price_key string")
    out = ingest.sequenced(batch, open_, seen, ["at"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    assert [(r["at"], r["outcome"], r["open_key"]) for r in out.orderBy("at").collect()] == [(1, "duplicate", "6"), (2, "confirmed", "6"), (3, "duplicate", "6"), (4, "confirmed", "7"), (5, "new", "9"), (6, "confirmed", "9")]


def test_duplicates_are_counted_and_never_staged(spark, folder):
    store, rows = Store(spark, folder, ingest.RUN_TABLES), prices(spark, (10, 1, 5, 1, "observed", None), (20, 1, 6, 2, "observed", None), (30, 1, 6, 3, "observed", "out of scope"))
    ingest.ingested(store, "one", rows)
    staged, sizes = store.staged, []

    def watched(df):
        out = staged(df)
        sizes.append(out.count())
        return out

    store.staged = watched
    ingest.ingested(store, "two", rows.unionByName(prices(spark, (10, 2, 5, 4, "observed", None))))
    r = store.read("run").where("run_ref = 'two'").first()
    assert (r["status"], r["rows_seen"], r["new"], r["confirmed"], r["duplicates"], r["errors"]) == ("partial", 4, 0, 1, 2, 1)
    assert sizes == [4, 1] and rows_of(ingest.newest(store.read("open_price"), ["offer_id"], "price_key")) == [(10, "5"), (20, "6")]


def test_filters_never_deny_what_was_seen(spark):
    keys = spark.range(4000).select(F.col("id").alias("offer_id"), F.lit("2024-01-01").cast("date").alias("business_date"), F.col("id").cast("string").alias("record_hash"))
    keys = keys.withColumn("bucket", ingest.seen_bucket())
    marked = ingest.maybe_seen(keys, ingest.filter_of(keys.where("offer_id % 2 = 0")))
    assert marked.count() == 4000 and marked.where("offer_id % 2 = 0 and not maybe").count() == 0
    assert marked.where("offer_id % 2 = 1 and maybe").count() < 100
    assert ingest.maybe_seen(keys, spark.createDataFrame([], ingest.RUN_TABLES["seen_filter"])).where("maybe").count() == 0


def test_periods_over_batches_are_those_of_the_whole(spark, folder):
    rows = observations(spark, 60)
    whole = history.timeline(rows)
    columns = ["offer_id", "period_no", "opened_because", "first_detected_at", "last_confirmed_at", "n_observations", "price", "currency", "tax_included"]
    period = history.PERIOD.format(at="timestamp_ntz", price="double")
    store = Store(spark, folder, {"period": period.partition(", last struct")[0] + ", closed_at timestamp_ntz", "open_period": f"{period}, generation long", "late": OBS})
    write = jobs.periods_into(store, "b")
    for k in range(4):
        batch = rows.where(f"ord1 div 15 = {k}")
        write(batch, k)
        write(batch, k)  # a replay
    write(rows.where("ord1 = 3"), 4)  # long past
    open_ = store.read("open_period")
    rest = [c for c in columns if c != "offer_id"]
    open_ = open_.groupBy("offer_id").agg(F.max_by(F.struct(*rest), "generation").alias("p")).select("offer_id", "p.*")
    assert rows_of(store.read("period").select(*columns).unionByName(open_)) == rows_of(whole.select(*columns))
    assert rows_of(store.read("period").select("offer_id", "period_no", "closed_at")) == rows_of(whole.where("closed_at is not null").select("offer_id", "period_no", "closed_at"))
    assert store.read("late").count() == 1


def test_ancestors_of_any_depth(spark):
    chain = [(f"n{k}", f"n{k - 1}" if k else None) for k in range(13)]
    tree = chain + [("side", "n4"), ("leaf", "side"), ("alone", ""), ("below a root that isn't listed", "elsewhere")]
    ring = [("a", "b"), ("b", "c"), ("c", "a"), ("under the ring", "a"), ("self", "self")]
    nodes = spark.createDataFrame(tree + ring, "node string, parent string")
    found, lost = ingest.ancestors(nodes, jobs.table_writer(spark, "test_ancestors"))
    parent = dict(tree)
    want = set()
    for node in parent:
        at, k = node, 0
        while at:
            want.add((node, at, k))
            at, k = parent.get(at), k + 1
    want |= {(n, n, 0) for n, _ in ring}
    assert {tuple(r) for r in found.collect()} == want and found.count() == len(want)
    assert {r["node"] for r in lost.collect()} == {n for n, _ in ring}
    none, lost = ingest.ancestors(nodes.limit(0), jobs.table_writer(spark, "test_ancestors"))
    assert none.count() == lost.count() == 0


def test_periods_follow_from_one_shuffle_and_are_written_once(spark, folder):
    day = lambda d, k: (datetime.datetime(1997, 1, d), k)
    of = lambda *rows: spark.createDataFrame([(o, at, k, 0, 0, 0, price, "SAR", 1) for o, (at, k), price in rows], "offer_id long, observed_at timestamp_ntz, ord1 long, ord2 long, ord3 long, ord4 long, price double, currency string, tax_included int")
    batches = [
        of((1, day(2, 1), 5.0), (1, day(3, 2), 5.0), (2, day(2, 3), None), (3, day(9, 4), 1.0)),
        of((1, day(3, 2), 6.0), (1, day(4, 5), 5.0), (2, day(3, 6), None), (3, day(8, 7), 2.0)),  # a row of the newest one's time is late, and offer 3 has only a late one
        of((1, day(3, 3), 7.0), (1, day(5, 8), 6.0), (2, day(4, 9), 4.0), (3, day(10, 10), 1.0)),
    ]
    period = history.PERIOD.format(at="timestamp_ntz", price="double")
    store = Store(spark, folder, {"period": period.partition(", last struct")[0] + ", closed_at timestamp_ntz", "open_period": f"{period}, generation long", "late": schema_of(batches[0])})
    store.staged = None  # nothing is written beside the tables
    for k, batch in enumerate(batches):
        found = history.periods_after(store.read("open_period"), batch)
        assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
        jobs.periods_into(store, "b")(batch, k)
    at = lambda d: datetime.datetime(1997, 1, d)
    closed = store.read("period").select("offer_id", "period_no", "opened_because", "first_detected_at", "last_confirmed_at", "n_observations", "price", "closed_at")
    assert rows_of(closed) == [(1, 1, "first_seen", at(2), at(4), 3, 5.0, at(5)), (2, 1, "first_seen", at(2), at(3), 2, None, at(4))]
    open_ = store.read("open_period").where("generation = 3").select("offer_id", "period_no", "opened_because", "first_detected_at", "n_observations", "price")
    assert rows_of(open_) == [(1, 2, "price_change", at(5), 1, 6.0), (2, 2, "price_change", at(4), 1, 4.0), (3, 1, "first_seen", at(9), 2, 1.0)]
    assert rows_of(store.read("open_period").where("generation = 2").select("offer_id")) == [(1,), (2,)]
    assert rows_of(store.read("late").select("offer_id", "observed_at", "ord1", "price")) == [(1, at(3), 2, 6.0), (1, at(3), 3, 7.0), (3, at(8), 7, 2.0)]
    assert sorted(os.listdir(f"{folder}/staged")) == []
