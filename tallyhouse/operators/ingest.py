"""Stateful jobs: each takes the state and a batch, and gives the new state and what happened."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyhouse.sources.generations import Store


def upserted(state: DataFrame, batch: DataFrame, key: str, tracked: list[str]) -> tuple[DataFrame, DataFrame]:
    """The state after a batch, and its changes (key, field, old, new, change_type).

    A blank value in the batch says nothing, so it never clears one. Keys that come back from inactive are 'returned'.
    ``state`` has the key, the tracked fields and ``active``.
    """
    was = state.select(key, *[F.col(c).alias(f"old_{c}") for c in tracked], F.col("active").alias("was_active"))
    now = batch.select(key, *[F.nullif(F.trim(F.col(c)), F.lit("")).alias(f"new_{c}") for c in tracked], F.lit(True).alias("in_batch"))
    both = was.join(now, key, "full_outer")
    kept = [F.coalesce(f"new_{c}", f"old_{c}").alias(c) for c in tracked]
    new_state = both.select(key, *kept, F.coalesce("in_batch", "was_active").alias("active"))
    known = F.col("was_active").isNotNull()
    events = F.array(
        F.when(~known, F.struct(F.lit("").alias("field"), F.lit(None).cast("string").alias("old"), F.lit(None).cast("string").alias("new"), F.lit("new").alias("change_type"))),
        F.when(known & ~F.col("was_active") & F.col("in_batch"), F.struct(F.lit("").alias("field"), F.lit(None).cast("string").alias("old"), F.lit(None).cast("string").alias("new"), F.lit("returned").alias("change_type"))),
        *[F.when(known & F.col(f"new_{c}").isNotNull() & ~F.col(f"new_{c}").eqNullSafe(F.col(f"old_{c}")), F.struct(F.lit(c).alias("field"), F.col(f"old_{c}").alias("old"), F.col(f"new_{c}").alias("new"), F.lit("changed").alias("change_type"))) for c in tracked],
    )
    changes = both.where("in_batch").select(key, F.explode(F.array_compact(events)).alias("e")).select(key, "e.*")
    return new_state, changes


def classified(batch: DataFrame, open_prices: DataFrame, seen: DataFrame) -> DataFrame:
    """``outcome`` of each observation: confirmed (same open price), duplicate (same offer, day and content), new; reported rows bypass the state."""
    rows = batch.join(open_prices.select("offer_id", F.col("price_key").alias("open_key")), "offer_id", "left")
    rows = rows.join(seen.select("offer_id", "business_date", "record_hash", F.lit(True).alias("known")).distinct(), ["offer_id", "business_date", "record_hash"], "left")
    return rows.withColumn("outcome", F.when(F.col("known"), "duplicate").when((F.col("provenance") == "observed") & (F.col("open_key") == F.col("price_key")), "confirmed").otherwise("new")).drop("known", "open_key")


def revised(state: DataFrame, batch: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Generic records by key: unchanged rows are only seen again, changed ones get a revision, new ones their first."""
    h = lambda: F.sha2(F.to_json(F.struct(*[F.col(c).alias(c) for c in sorted(fields)]), {"ignoreNullFields": "false"}), 256)
    a = state.select(key, "rev", h().alias("old_hash"))
    b = batch.select(key, h().alias("new_hash"))
    outcome = F.when(F.col("rev").isNull(), "new").when(F.col("old_hash") == F.col("new_hash"), "unchanged").otherwise("revised")
    return b.join(a, key, "left").select(key, outcome.alias("outcome"), (F.coalesce("rev", F.lit(0)) + F.when(outcome == "unchanged", 0).otherwise(1)).alias("rev"))


def field_changes(revisions: DataFrame, key: str, rev: str, fields: list[str]) -> DataFrame:
    """The fields in which each revision differs from the one before."""
    own = Window.partitionBy(key).orderBy(rev)
    rows = revisions.withColumn("_before", F.lag(F.struct(*fields)).over(own)).where("_before is not null")
    diffs = [F.when(~F.col(c).eqNullSafe(F.col(f"_before.{c}")), F.struct(F.lit(c).alias("field"), F.col(f"_before.{c}").cast("string").alias("old"), F.col(c).cast("string").alias("new"))) for c in fields]
    return rows.select(key, rev, F.explode(F.array_compact(F.array(*diffs))).alias("d")).select(key, rev, "d.*")


def retired_stand_ins(variants: DataFrame) -> DataFrame:
    """Product-level stand-ins (variant id = product id) of products that have real variants by now."""
    real = variants.where("variant_id <> product_id").select("product_id").distinct()
    return variants.where("variant_id = product_id").join(real, "product_id", "left_semi")


def restated(details: DataFrame, batch: DataFrame) -> DataFrame:
    """Details after a batch: (product, code) that it restates keep its values only, the rest stays."""
    kept = details.join(batch.select("product_id", "code").distinct(), ["product_id", "code"], "left_anti")
    return kept.unionByName(batch.dropDuplicates(["product_id", "code", "raw_value"]))


def taxonomy(paths: DataFrame, path: str, separator: str = " > ") -> DataFrame:
    """A node for every prefix of every path: identity by the prefix, its parent, level and how many paths pass it."""
    parts = F.split(path, separator)
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.struct(F.array_join(F.slice(parts, 1, k), separator).alias("node"), F.array_join(F.slice(parts, 1, k - 1), separator).alias("parent"), F.element_at(parts, k).alias("name"), k.alias("level")))
    return paths.select(F.explode(prefixes).alias("n")).select("n.*").groupBy("node", "parent", "name", "level").agg(F.count("*").alias("paths"))


def memberships(records: DataFrame, key: str, path: str) -> DataFrame:
    """Links of records to the leaf of their path, once each, with how often it was stated."""
    return records.groupBy(key, F.col(path).alias("node")).agg(F.count("*").alias("seen_count"))


def ancestors(nodes: DataFrame, write) -> tuple[DataFrame, DataFrame]:
    """(node, ancestor, distance) for every ancestor of every node, itself included, and the nodes that reach no root.

    ``nodes`` is an adjacency list of node and parent (null or blank: a root; a parent that isn't listed is one too). Known
    stretches are joined end to end, so their length doubles with each round: a tree of any depth takes a number of rounds that
    follows the logarithm of its depth. A node still under way after more rounds than there are nodes to pass is on a cycle or
    below one: such nodes are reported, and have no ancestors but themselves. ``write`` (a DataFrame and a label) stores a
    round's rows and reads them back.
    """
    edges = write(nodes.where("parent is not null and parent <> ''").select("node", F.col("parent").alias("up")).distinct(), "edges")
    # The farthest node known above each node: it doubles its distance until it has no parent itself.
    jumps, rounds, passed = edges.select("node", "up"), 0, 1
    total = edges.count()
    while passed <= total:
        further = jumps.alias("a").join(jumps.select(F.col("node").alias("up"), F.col("up").alias("next")), "up")
        further = write(further.select("node", F.col("next").alias("up")).distinct(), f"jumps{rounds}")
        rounds, passed, jumps = rounds + 1, passed * 2, further
        if jumps.isEmpty():
            break
    lost = jumps.select("node").distinct() if passed > total else edges.select("node").limit(0)
    lost = write(lost, "lost")
    known = write(edges.join(lost, "node", "left_anti").select("node", F.col("up").alias("ancestor"), F.lit(1).alias("distance")), "closure")
    for k in range(rounds):
        # All stretches of up to 2**k steps are known; those of exactly 2**k lead on to what is known above their ends.
        long = known.where(F.col("distance") == 1 << k).select("node", F.col("ancestor").alias("middle"))
        above = known.select(F.col("node").alias("middle"), "ancestor", (F.col("distance") + (1 << k)).alias("distance"))
        known = write(known.unionByName(long.join(above, "middle").select("node", "ancestor", "distance")), f"closure{k}")
    own = nodes.select("node", F.col("node").alias("ancestor"), F.lit(0).alias("distance")).distinct()
    return own.unionByName(known), lost


def registered(known: DataFrame, asked: DataFrame, key: str, definition: str) -> DataFrame:
    """Registrations: accepted when new or the same as before, conflict when they redefine, retired when the key is."""
    both = asked.join(known.select(key, F.col(definition).alias("_had"), "retired"), key, "left")
    return both.select(key, F.when(F.col("retired"), "retired").when(F.col("_had").isNull(), "accepted").when(F.col("_had") == F.col(definition), "already").otherwise("conflict").alias("verdict"))


def collapsed_new(changes: DataFrame) -> DataFrame:
    """A change feed without a variant's 'new' where the product's 'new' is in the same run."""
    product = changes.where("entity = 'product' and change_type = 'new'").select("product_id", "run_id")
    twice = changes.where("entity = 'variant' and change_type = 'new'").join(product, ["product_id", "run_id"], "left_anti")
    return changes.where("not (entity = 'variant' and change_type = 'new')").unionByName(twice)


#: Tables of a store that runs are committed to. ``detail`` is a log of what was stated, ``open_price`` of what was in force.
RUN_TABLES = {
    "observation": "offer_id long, product_id long, business_date date, record_hash string, price_key string, provenance string, at string, run_ref string, generation long",
    "open_price": "offer_id long, price_key string, generation long",
    "product": "product_id long, generation long",
    "detail": "product_id long, code string, raw_values array<string>, generation long",
    "seen": "offer_id long, business_date date, record_hash string, bucket int",
    "seen_filter": "bucket int, part long, bits binary",
    "run": "run_ref string, status string, rows_seen long, new long, confirmed long, duplicates long, errors long, details long, generation long",
}
#: Hash buckets of what was seen, and bits of each one's filter: 64 buckets of 32 KB are 2 MB, whatever the table.
SEEN_BUCKETS, FILTER_BITS = 64, 1 << 18
SEEN_KEY = ("offer_id", "business_date", "record_hash")


def seen_bucket(key: str = "offer_id") -> Column:
    return F.pmod(F.xxhash64(key), F.lit(SEEN_BUCKETS)).cast("int")


def _places() -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(seed), *SEEN_KEY), F.lit(FILTER_BITS)) for seed in (1, 2)]


def filter_of(rows: DataFrame) -> DataFrame:
    """bucket, part, bits: a Bloom filter with two hashes for each bucket of ``rows``, in parts of 32,768 bits."""
    at = rows.select("bucket", F.explode(F.array(*_places())).alias("at"))
    return at.groupBy("bucket", F.bitmap_bucket_number("at").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))


def maybe_seen(rows: DataFrame, filters: DataFrame) -> DataFrame:
    """Adds ``maybe``: false for rows that surely weren't seen. The filters, a few MB by their parameters, are broadcast."""
    merged = filters.groupBy("bucket", "part").agg(F.bitmap_or_agg("bits").alias("bits"))
    hits = []
    for k, at in enumerate(_places()):
        place = F.bitmap_bit_position(at)
        byte = F.conv(F.hex(F.substring(f"_bits{k}", (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        rows = rows.withColumn(f"_part{k}", F.bitmap_bucket_number(at))
        rows = rows.join(F.broadcast(merged.select("bucket", F.col("part").alias(f"_part{k}"), F.col("bits").alias(f"_bits{k}"))), ["bucket", f"_part{k}"], "left")
        hits.append(F.coalesce(F.getbit(byte, (place % 8).cast("int")) == 1, F.lit(False)))
    return rows.withColumn("maybe", hits[0] & hits[1]).drop(*[f"_{x}{k}" for x in ("part", "bits") for k in (0, 1)])


def sequenced(batch: DataFrame, open_prices: DataFrame, seen: DataFrame, order: list[str]) -> DataFrame:
    """``outcome`` of each observation of a batch, as if they came one by one in ``order``.

    duplicate: the same offer, day and content is among ``seen`` or came before in the batch; confirmed: observed at the price
    that is open then; new: any other. Duplicates and reported rows open nothing. ``open_key`` is the price open after the row.
    """
    # What is open and what was seen stand before the batch's rows: one shuffle by offer, as every key holds it, serves both.
    rows = batch.withColumn("_new", F.lit(True))
    kinds = {f.name: f.dataType for f in rows.schema}
    as_rows = lambda df: df.select(*[F.col(c) if c in df.columns else F.lit(False if c == "_new" else None).cast(kinds[c]).alias(c) for c in rows.columns])
    rows = rows.unionByName(as_rows(seen.select(*SEEN_KEY))).unionByName(as_rows(open_prices.select("offer_id", "price_key").where("price_key is not null")))
    rows = rows.repartition("offer_id")
    opens = ~F.col("_new") & F.col("price_key").isNotNull()  # says nothing of what was seen
    again = F.row_number().over(Window.partitionBy(*SEEN_KEY, opens).orderBy("_new", *order)) > 1
    rows = rows.withColumn("_again", F.col("_new") & again)
    moves = F.when(~F.col("_new") | ((F.col("provenance") == "observed") & ~F.col("_again")), F.col("price_key"))
    own = Window.partitionBy("offer_id").orderBy("_new", *order)
    before = F.last(moves, ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, -1))
    after = F.last(moves, ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, 0))
    outcome = F.when(F.col("_again"), "duplicate").when((F.col("provenance") == "observed") & (before == F.col("price_key")), "confirmed").otherwise("new")
    return rows.withColumn("outcome", outcome).withColumn("open_key", after).where("_new").drop("_new", "_again")


def newest(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The value that the last generation states for each key."""
    return rows.groupBy(*keys).agg(F.max_by(value, "generation").alias(value))


def details_in_force(store: Store) -> DataFrame:
    """product_id, code, raw_value as last stated: stating a (product, code) again retires the values it had."""
    return newest(store.read("detail"), ["product_id", "code"], "raw_values").select("product_id", "code", F.explode("raw_values").alias("raw_value"))


def ingested(store: Store, run_ref: str, prices: DataFrame, details: DataFrame | None = None, order: tuple[str, ...] = ("at",)) -> int:
    """One run as one commit over all tables: its products, observations, open prices, details and its report, or nothing.

    ``prices`` has offer_id, product_id, business_date, record_hash, price_key, provenance, the order's columns and ``error``
    (null where the row is usable; such rows are counted and left out). Details (product_id, code, raw_value) attach to
    products that earlier runs or this one's prices have registered, in whatever order they came; others are errors. A run
    under a reference that is committed already changes nothing; one that died before its commit is simply run again.
    Only what a run adds is written: no table is rewritten, and of what was seen only the buckets are read in which the
    filters find something.
    """
    if (done := store.generation_of(run_ref)) is not None:
        return done
    number = store.current()[0] + 1
    rows = store.staged(maybe_seen(prices.withColumn("bucket", seen_bucket()), store.read("seen_filter")))
    marked = rows.where("error is null").drop("error")
    good = marked.drop("maybe")
    buckets = [r[0] for r in marked.where("maybe").select("bucket").distinct().collect()]  # SEEN_BUCKETS at most
    # Of what was seen, only offers of the batch: their rows meet by the whole key where they are sequenced.
    asked = marked.where("maybe").select("offer_id").distinct()
    seen = store.read("seen").where(F.col("bucket").isin(buckets)).join(asked, "offer_id", "left_semi")
    offers = good.select("offer_id").distinct()
    open_ = newest(store.read("open_price").join(offers, "offer_id", "left_semi"), ["offer_id"], "price_key")
    # Duplicates leave nothing but their number, which is that of all others less.
    told = store.staged(sequenced(good.drop("bucket"), open_, seen, list(order)).where("outcome <> 'duplicate'").withColumn("bucket", seen_bucket()))
    stamp = F.lit(number).cast("long").alias("generation")
    at = F.concat_ws("|", *[F.col(c).cast("string") for c in order])
    fresh = told.where("outcome = 'new'").select(*SEEN_KEY[:1], "product_id", *SEEN_KEY[1:], "price_key", "provenance", at.alias("at"), F.lit(run_ref).alias("run_ref"), stamp)
    passed = told.select(*SEEN_KEY, "bucket")
    opened = told.where("open_key is not null").groupBy("offer_id").agg(F.max_by("open_key", F.struct(*order)).alias("price_key")).select("*", stamp)
    products = good.select("product_id").distinct().join(store.read("product"), "product_id", "left_anti").select("*", stamp)
    appended = {"observation": fresh, "open_price": opened, "product": products, "seen": passed, "seen_filter": filter_of(passed)}
    attached = F.lit(0).cast("long")
    strangers = F.lit(0).cast("long")
    if details is not None:
        known = store.read("product").select("product_id").unionByName(good.select("product_id")).distinct()
        stated = store.staged(details.join(known.withColumn("_known", F.lit(True)), "product_id", "left"))
        kept = stated.where("_known and trim(raw_value) <> ''")
        appended["detail"] = kept.groupBy("product_id", "code").agg(F.array_sort(F.collect_set("raw_value")).alias("raw_values")).select("*", stamp)
        n = stated.agg(F.count("_known"), F.count("*") - F.count("_known")).first()
        attached, strangers = F.lit(n[0]), F.lit(n[1])
    count = lambda what: F.count(F.when(F.col("outcome") == what, 1))
    totals = told.agg(count("new").alias("new"), count("confirmed").alias("confirmed"))
    errors = rows.agg(F.count("*").alias("rows_seen"), F.count("error").alias("_bad"), (F.count("error") + strangers).alias("errors"))
    stored = F.col("rows_seen") - F.col("_bad")
    status = F.when((F.col("errors") > 0) & (stored == 0), "failed").when(F.col("errors") > 0, "partial").otherwise("success")
    report = totals.join(errors).withColumn("duplicates", stored - F.col("new") - F.col("confirmed"))  # one row each
    appended["run"] = report.select(F.lit(run_ref).alias("run_ref"), status.alias("status"), "rows_seen", "new", "confirmed", "duplicates", "errors", attached.alias("details"), stamp)
    return store.commit(run_ref, appended, by={"seen": "bucket"})
