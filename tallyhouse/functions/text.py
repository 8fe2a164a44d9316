"""Cleaning of names, money, units, categories and markup, as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

#: Arabic-Indic and Eastern Arabic digits, decimal and thousands marks, and what they become.
DIGITS = "٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹٫٬"
PLAIN = "01234567890123456789.,"

ARABIC = "[\\u0600-\\u06FF\\u0750-\\u077F\\u08A0-\\u08FF\\uFB50-\\uFDFF\\uFE70-\\uFEFF]"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def fold_digits(c: str | Column) -> Column:
    return F.translate(_col(c), DIGITS, PLAIN)


#: Currency marks as sites write them, in the order in which they are taken out.
CURRENCY_MARKS = ("SAR", "EGP", "USD", "EUR", "AED", "KWD", "QAR", "ر.س", "ريال", "ج.م", "جنيه", "LE", "L.E.", "$", "€", "£")


#: One pass takes out all that is no part of an amount: marks that hold a point first, as it would be left of them; the others' letters go by themselves.
_NO_AMOUNT = "|".join([*(re.escape(m) for m in CURRENCY_MARKS if set(m) & set(".,-")), "[^0-9.,-]"])


def parse_money(c: str | Column) -> Column:
    """A decimal(18,4) from a price text; null for blank or unreadable ones (``money_error`` tells them apart).

    Currency marks go first, as some hold points. With both marks the one further right is the decimal mark. A comma alone
    is one if a single comma has one or two digits behind it; a point alone always is.
    """
    kept = F.regexp_replace(fold_digits(c), _NO_AMOUNT, "")
    comma, point = F.length(kept) - F.instr(F.reverse(kept), ","), F.length(kept) - F.instr(F.reverse(kept), ".")
    has_comma, has_point = kept.contains(","), kept.contains(".")
    plain = (
        F.when(has_comma & has_point & (comma > point), F.replace(F.replace(kept, F.lit("."), F.lit("")), F.lit(","), F.lit(".")))
        .when(has_comma & has_point, F.replace(kept, F.lit(","), F.lit("")))
        .when(has_comma & kept.rlike("^-?[0-9]*,[0-9]{1,2}$"), F.replace(kept, F.lit(","), F.lit(".")))
        .when(has_comma, F.replace(kept, F.lit(","), F.lit("")))
        .otherwise(kept)
    )
    return F.when(plain.rlike("[0-9]"), plain).try_cast("decimal(18,4)")


def money_error(c: str | Column) -> Column:
    """Whether a text that isn't blank gives no amount."""
    return (F.trim(_col(c)) != "") & parse_money(c).isNull()


def canonical_amount(c: str | Column) -> Column:
    """Fixed-point text without trailing zeros, for hashing."""
    text = _col(c).cast("decimal(18,4)").cast("string")
    return F.regexp_replace(F.regexp_replace(text, "(\\.[0-9]*?)0+$", "$1"), "\\.$", "")


def canonical_hash(**fields: Column) -> Column:
    """SHA-256 of the JSON object of the fields by sorted name, without spaces; nulls stay as null."""
    rows = F.struct(*[fields[k].alias(k) for k in sorted(fields)])
    return F.sha2(F.to_json(rows, {"ignoreNullFields": "false"}), 256)


def option_fingerprint(options: str | Column) -> Column:
    """``k=v|k=v`` of a map, by the key as written, then lowered, trimmed and with plain digits."""
    tidy = lambda x: F.lower(F.trim(fold_digits(x)))
    pairs = F.array_sort(F.map_entries(_col(options)))
    return F.array_join(F.transform(pairs, lambda e: F.concat(tidy(e["key"]), F.lit("="), tidy(e["value"]))), "|")


def option_axes(options: str | Column) -> Column:
    """A map as JSON, blank values left out."""
    return F.to_json(F.map_filter(_col(options), lambda k, x: F.trim(F.coalesce(x, F.lit(""))) != ""))


def normalize_name(c: str | Column) -> Column:
    """Lower case, plain digits, runs of anything but letters and digits as one space."""
    return F.trim(F.regexp_replace(F.lower(fold_digits(c)), "[^\\p{L}\\p{N}_]+", " "))


def name_tokens(c: str | Column) -> Column:
    return F.array_distinct(F.filter(F.split(normalize_name(c), " "), lambda t: t != ""))


def name_similarity(a: str | Column, b: str | Column) -> Column:
    """Jaccard similarity of two names' words; 0 if either has none."""
    x, y = name_tokens(a), name_tokens(b)
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))


#: Entities that occur in prices and names.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&nbsp;": " ", "&amp;": "&"}


def unescape(c: str | Column) -> Column:
    """The common entities as characters; the ampersand last, so nothing is undone twice."""
    out = _col(c)
    for entity, char in ENTITIES.items():
        out = F.replace(out, F.lit(entity), F.lit(char))
    return out


def strip_markup(c: str | Column, separator: str = " ") -> Column:
    """Text of an HTML fragment: scripts and styles go with their content, tags become the separator, white space is one space."""
    out = F.regexp_replace(_col(c), "(?is)<(script|style)\\b[^>]*>.*?</\\1\\s*>", separator)
    out = unescape(F.regexp_replace(F.regexp_replace(out, "(?s)<!--.*?-->", separator), "(?s)<[^>]*>", separator))
    return F.trim(F.regexp_replace(out, "[\\s\\u00a0]+", " "))


def split_brand(c: str | Column) -> tuple[Column, Column]:
    """The Arabic words and the other words of a brand, each joined by a space."""
    words = F.filter(F.split(F.trim(_col(c)), "\\s+"), lambda w: w != "")
    return F.array_join(F.filter(words, lambda w: w.rlike(ARABIC)), " "), F.array_join(F.filter(words, lambda w: ~w.rlike(ARABIC)), " ")


def joined_brand(arabic: Column, latin: Column) -> Column:
    return F.trim(F.concat_ws(" ", F.nullif(arabic, F.lit("")), F.nullif(latin, F.lit(""))))


def selling_unit(name: str | Column, weight: str | Column, unit: str = "kg") -> Column:
    """The unit a name states with a quantity, if that quantity is the weight field's (to 1e-6)."""
    said = F.regexp_extract(fold_digits(name), f"(?i)([0-9]+(?:\\.[0-9]+)?)\\s*{unit}\\b", 1).try_cast("double")
    return F.when(F.abs(said - _col(weight).cast("double")) <= 1e-6, unit)


#: Units as sites write them, and the codes they stand for.
UNIT_ALIASES = {
    "meter": "m", "meters": "m", "metre": "m", "metres": "m", "mtr": "m",
    "kilogram": "kg", "kilograms": "kg", "kilo": "kg", "kgs": "kg",
    "litre": "liter", "litres": "liter", "liters": "liter", "l": "liter",
    "ton": "tonne", "tons": "tonne", "tonnes": "tonne", "metric ton": "tonne",
    "square meter": "m2", "square metre": "m2", "sqm": "m2", "m²": "m2",
    "cubic meter": "m3", "cubic metre": "m3", "cbm": "m3", "m³": "m3",
    "pieces": "piece", "pcs": "piece", "pc": "piece", "each": "piece",
    "kwh": "kWh", "kw/h": "kWh",
    "متر": "m", "امتار": "m", "أمتار": "m",
    "كيلوجرام": "kg", "كجم": "kg", "كيلو": "kg",
    "لتر": "liter", "قطعة": "piece", "حبة": "piece",
}


def canonical_unit(c: str | Column, currency: str | Column | None = None) -> Column:
    """A unit's code by the table of aliases; unknown ones stay as they are, in lower case. Null for blank.

    What stands before a slash goes if it is the row's currency or all upper case, so ``USD/liter`` is a liter and ``kg/m2``
    stays whole.
    """
    raw = F.trim(_col(c))
    head, tail = F.trim(F.substring_index(raw, "/", 1)), F.regexp_replace(raw, "^[^/]*/", "")
    own = F.lit(False) if currency is None else F.upper(head) == F.upper(F.trim(F.coalesce(_col(currency), F.lit(""))))
    capitals = (head == F.upper(head)) & head.rlike("\\p{Lu}")
    text = F.when(raw.contains("/") & (own | capitals), tail).otherwise(raw)
    key = F.rtrim(F.lower(F.trim(text)), F.lit("."))
    known = F.create_map(*[F.lit(x) for pair in UNIT_ALIASES.items() for x in pair])
    return F.when(raw != "", F.coalesce(F.try_element_at(known, key), key))


def price_unit(unit: str | Column, quantity: str | Column) -> Column:
    """``per kg``, or ``per 5 kg`` for a basis other than one."""
    u, q = _col(unit), _col(quantity)
    return F.when(u.isNull() | (u == ""), "").when(q.isNull() | (q == 1), F.concat(F.lit("per "), u)).otherwise(F.concat(F.lit("per "), q.cast("string"), F.lit(" "), u))


def discount(regular: Column, effective: Column) -> dict[str, Column]:
    """Amount, percentage and text of a discount; null unless the regular price is above."""
    on = regular > effective
    amount = F.when(on, F.round(regular - effective, 2).cast("double"))
    pct = F.when(on & (regular != 0), F.round((regular - effective).cast("double") / regular.cast("double") * 100, 1))
    return {"amount": amount, "pct": pct, "text": F.when(on, F.format_string("-%.2f (-%.1f%%)", amount, pct))}


def change_text(before: Column, now: Column) -> Column:
    """``+1.00 (+10.0%)``; empty without a move, or from a price of zero."""
    delta = now - before
    shown = F.round(delta, 2).cast("double")
    exact = lambda c: c.cast("decimal(18,4)")  # noqa: E731  halves go away from zero, whatever their binary form
    share = F.round(exact(delta) * 100 / F.nullif(exact(before), exact(F.lit(0))), 1).cast("double")
    return F.when(before.isNull() | now.isNull() | (delta == 0) | (before == 0), "").otherwise(F.format_string("%+.2f (%+.1f%%)", shown, share))


def category_levels(path: str | Column, depth: int = 10) -> list[Column]:
    """level_1 .. level_<depth> of 'A > B > C', null beyond its end."""
    parts = F.filter(F.transform(F.split(_col(path), ">"), lambda p: F.trim(p)), lambda p: p != "")
    return [F.try_element_at(parts, F.lit(k + 1)).alias(f"level_{k + 1}") for k in range(depth)]


def category_leaf(path: str | Column) -> Column:
    parts = F.filter(F.transform(F.split(_col(path), ">"), lambda p: F.trim(p)), lambda p: p != "")
    return F.try_element_at(parts, F.lit(-1))


def _rate_text(rate: Column) -> Column:
    return F.concat(F.regexp_replace(rate.cast("decimal(9,2)").cast("string"), "\\.?0+$", ""), F.lit("%"))


def tax_label(mode: Column, rate: Column, evidence: Column) -> Column:
    """One phrase on a price's tax: what the row's figure holds (``mode``), at the rate its source states. It never implies a rate that isn't known."""
    side = F.when(mode == "incl", "Incl. ").otherwise("Excl. ")
    general = F.when(mode == "incl", "Tax included, rate not published").otherwise("Tax excluded, rate not published")
    stated = (evidence == "stated") & rate.isNotNull()
    return F.when(stated, F.concat(side, _rate_text(rate), F.lit(" tax"))).when(evidence == "general", general).otherwise("Tax treatment unverified")


def tax_short_label(mode: Column, rate: Column, evidence: Column) -> Column:
    """The same, short enough for a cell."""
    side = F.when(mode == "incl", "Incl. ").otherwise("Excl. ")
    stated = (evidence == "stated") & rate.isNotNull()
    return F.when(stated, F.concat(side, _rate_text(rate))).when(evidence == "general", F.concat(side, F.lit("—"))).otherwise("Unverified")


#: Countries by their two-letter codes, where sources are collected; ``country_names`` has all others too.
COUNTRIES = {
    "AE": "United Arab Emirates", "BH": "Bahrain", "DJ": "Djibouti", "DZ": "Algeria", "EG": "Egypt", "IQ": "Iraq", "JO": "Jordan",
    "KM": "Comoros", "KW": "Kuwait", "LB": "Lebanon", "LY": "Libya", "MA": "Morocco", "MR": "Mauritania", "OM": "Oman", "PS": "Palestine",
    "QA": "Qatar", "SA": "Saudi Arabia", "SD": "Sudan", "SO": "Somalia", "SY": "Syria", "TN": "Tunisia", "YE": "Yemen",
}


def country_names(spark) -> dict[str, str]:
    """All two-letter codes and English names, from the locale data that Java brings along; the names above go before it."""
    locale = spark.sparkContext._jvm.java.util.Locale
    english = locale.ENGLISH
    return {code: locale("", code).getDisplayCountry(english) for code in locale.getISOCountries()} | COUNTRIES


def region_name(code: str | Column, names: dict[str, str] = COUNTRIES) -> Column:
    """A country's name from its code, by ``names``; an unknown code stays, '*' and blank are no country."""
    raw = F.trim(_col(code))
    names = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.when(F.coalesce(raw, F.lit("")).isin("", "*"), "").otherwise(F.coalesce(F.try_element_at(names, F.upper(raw)), raw))


def region_code(name: str | Column, names: dict[str, str] = COUNTRIES) -> Column:
    """A country's code from its name, by ``names``; blank for anything else, and for texts of two letters, which are codes already."""
    raw = F.lower(F.trim(_col(name)))
    codes = F.create_map(*[F.lit(x) for code, said in names.items() for x in (said.lower(), code)])
    return F.when(F.length(raw) < 3, "").otherwise(F.coalesce(F.try_element_at(codes, raw), F.lit("")))


def storefront_price(price: Column, flash: Column, trade: Column | None = None, minor: Column | None = None) -> dict[str, Column]:
    """price, price_before and price_trade of a shop's product.

    A flash price above zero is the price, and the usual one stands before it; the trade tier never is the price. All are in
    major units if the minor unit's digits are given.
    """
    scale = F.pow(F.lit(10.0), minor) if minor is not None else F.lit(1.0)
    on = flash > 0
    out = {"price": F.when(on, flash).otherwise(price), "price_before": F.when(on, price), "price_trade": F.when(trade > 0, trade) if trade is not None else F.lit(None)}
    return {k: c.cast("double") / scale for k, c in out.items()}


def is_range(low: Column, high: Column) -> Column:
    """Whether a product's price is a range, which no one variant has."""
    return F.coalesce((low > 0) & (high > low), F.lit(False))


def availability(c: str | Column) -> Column:
    """in_stock, out_of_stock, preorder or unknown from schema.org addresses, booleans and status words."""
    raw = F.lower(F.trim(_col(c)))
    return F.when(raw.rlike("(out.?of.?stock|soldout|discontinued|^false$|^0$)"), "out_of_stock").when(raw.rlike("(pre.?order|back.?order)"), "preorder").when(raw.rlike("(in.?stock|limitedavailability|^true$|^1$|available)"), "in_stock").otherwise("unknown")


TYPES = {"integer": "bigint", "decimal": "decimal(18,4)", "boolean": "boolean", "date": "date", "datetime": "timestamp"}


def converted(c: str | Column, kind: str) -> Column:
    """A text as a value of a field type; null where it isn't one."""
    raw = F.trim(_col(c))
    if kind == "url":
        return F.when(raw.rlike("^https?://[^\\s/]+"), raw)
    if kind == "json":
        return F.when(F.try_parse_json(raw).isNotNull(), raw)
    return raw.try_cast(TYPES[kind]) if kind in TYPES else raw


def field_key(c: str | Column) -> Column:
    """A field's name as an ASCII key; names without ASCII letters or digits get a digest."""
    slug = F.regexp_replace(F.regexp_replace(F.lower(F.trim(_col(c))), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(slug == "", F.concat(F.lit("u"), F.substring(F.sha2(_col(c).cast("binary"), 256), 1, 10))).otherwise(slug)


def rate_of(c: str | Column) -> Column:
    """A rate that is finite, above zero and at most a million."""
    x = F.regexp_replace(fold_digits(c), "[^0-9.]", "").try_cast("double")
    return F.when((x > 0) & (x <= 1e6), x)


def city_and_region(c: str | Column) -> tuple[Column, Column]:
    """'City - Region' or 'City, Region' in two."""
    parts = F.split(_col(c), "\\s*[-,]\\s*", 2)
    return F.trim(parts[0]), F.trim(F.try_element_at(parts, F.lit(2)))


def optional_quantity(c: str | Column) -> Column:
    """A quantity where blank is unknown, not one."""
    x = fold_digits(c).try_cast("double")
    return F.when(x > 0, x)


def numbered_order(c: str | Column) -> list[Column]:
    """Sort keys of numbered codes: the code without its number, then the number."""
    raw = _col(c)
    return [F.regexp_replace(raw, "[0-9]+$", ""), F.coalesce(F.regexp_extract(raw, "([0-9]+)$", 1).try_cast("int"), F.lit(0))]


def measure_order(c: str | Column) -> list[Column]:
    """Sort keys of measures: blanks last, then the leading number, then the text."""
    raw = F.nullif(F.trim(_col(c)), F.lit(""))
    return [raw.isNull(), F.regexp_extract(raw, "^\\s*([+-]?[0-9]+(?:\\.[0-9]+)?)", 1).try_cast("double").asc_nulls_last(), raw.asc_nulls_last()]
