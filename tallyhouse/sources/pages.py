"""Stored pages to rows: tables, JSON-LD products, alternates, label/value boxes, galleries."""

from __future__ import annotations

from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from tallyhouse.functions.text import availability, strip_markup, unescape

TABLE = "page_id long, table_no int, caption string, header array<string>, rows array<array<string>>, confidence double, warnings array<string>"


class _Tables(HTMLParser):
    """Cells of every table, outermost first; a nested table's text also counts to the cell that holds it."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.done: list[dict] = []
        self.open: list[dict] = []

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            label = dict(attrs).get("aria-label") or ""
            t = {"rows": [], "head": [], "caption": label, "captioned": False, "warnings": set(), "in_head": False, "cell": None, "in_caption": False}
            self.done.append(t)
            self.open.append(t)
        elif self.open:
            t = self.open[-1]
            if tag == "thead":
                t["in_head"] = True
            elif tag == "tr":
                t["rows"].append([])
                t["head"].append([t["in_head"], False])
            elif tag in ("td", "th") and t["rows"]:
                if tag == "th":
                    t["head"][-1][1] = True
                if {"colspan", "rowspan"} & {k for k, x in attrs if x not in (None, "1")}:
                    t["warnings"].add("merged cells")
                t["rows"][-1].append("")
                t["cell"] = True
            elif tag == "caption":
                t |= {"in_caption": True, "captioned": True, "caption": ""}

    def handle_endtag(self, tag):
        if not self.open:
            return
        t = self.open[-1]
        if tag == "table":
            self.open.pop()
        elif tag == "thead":
            t["in_head"] = False
        elif tag in ("td", "th", "tr"):
            t["cell"] = None
        elif tag == "caption":
            t["in_caption"] = False

    def handle_data(self, data):
        for t in self.open:
            if t["in_caption"]:
                t["caption"] += data
            elif t["cell"] and t["rows"] and t["rows"][-1]:
                t["rows"][-1][-1] += data


#: How sure a table's header is with cells that say so and a caption, without the caption, and without either.
SURE = (0.95, 0.88, 0.7)


def tables_of(html: str) -> list[tuple]:
    """caption, header, rows, confidence, warnings of each table with rows.

    The header is the last row of the head, else the first row if it has header cells; else columns are numbered and every row
    is data. Rows of the head are never data, other rows always are, wherever header cells stand in them. Rows are padded to
    the widest.
    """
    parser = _Tables()
    parser.feed(html)
    out = []
    for t in parser.done:
        rows = [[" ".join(c.split()) for c in r] for r in t["rows"]]
        full = [k for k, r in enumerate(rows) if r]
        if not full:
            continue
        heads = [k for k in full if t["head"][k][0]]
        if not heads and t["head"][full[0]][1]:
            heads = full[:1]
        data = [k for k in full if k not in heads]
        width = max(len(rows[k]) for k in full)
        if len({len(rows[k]) for k in full}) > 1:
            t["warnings"].add("uneven rows")
        if not heads:
            t["warnings"].add("no header row")
        named = rows[heads[-1]] if heads else []
        header = [x or f"Column {k + 1}" for k, x in enumerate(named + [""] * (width - len(named)))]
        caption = " ".join(t["caption"].split())
        sure = SURE[2] if not heads else SURE[0] if t["captioned"] else SURE[1]
        out.append((caption, header, [rows[k] + [""] * (width - len(rows[k])) for k in data], sure, sorted(t["warnings"])))
    return out


def html_tables(pages: DataFrame) -> DataFrame:
    """A row for each table of each page (page_id, html)."""

    def run(batches):
        for batch in batches:
            rows = [(i, k, *t) for i, html in zip(batch.column("page_id").to_pylist(), batch.column("html").to_pylist()) for k, t in enumerate(tables_of(html or ""))]
            if rows:
                types = [pa.int64(), pa.int32(), pa.string(), pa.list_(pa.string()), pa.list_(pa.list_(pa.string())), pa.float64(), pa.list_(pa.string())]
                names = ["page_id", "table_no", "caption", "header", "rows", "confidence", "warnings"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return pages.select("page_id", "html").where(F.col("html").contains("<table")).mapInArrow(run, TABLE)


_TEXTS = T.ArrayType(T.StringType())
FOUND = T.StructType().add("table_no", T.IntegerType()).add("caption", T.StringType()).add("header", _TEXTS).add("rows", T.ArrayType(_TEXTS)).add("confidence", T.DoubleType()).add("warnings", _TEXTS)


class ParseHtmlTables:
    """Table function: a row for each table of a page's text, for SQL. Null and blank texts give none."""

    @staticmethod
    def analyze(html: AnalyzeArgument) -> AnalyzeResult:
        if html.isTable or html.dataType not in (T.StringType(), T.NullType()):
            raise ValueError("parse_html_tables takes one text")
        return AnalyzeResult(FOUND)

    def eval(self, html):
        yield from ((k, *t) for k, t in enumerate(tables_of(html or "")))


def register_sql(spark: SparkSession) -> None:
    """Makes ``parse_html_tables(html)`` known to a session's SQL: ``SELECT p.page_id, t.* FROM pages p, LATERAL parse_html_tables(p.html) t``."""
    spark.udtf.register("parse_html_tables", F.udtf(ParseHtmlTables))


def approved(tables: DataFrame, fields: list[str], sure: float) -> DataFrame:
    """Discovered tables that may be stored: sure enough of their header, with all fields in it, without merged cells, and not empty."""
    fit = (F.col("confidence") >= sure) & (F.size(F.array_except(F.array(*map(F.lit, fields)), "header")) == 0)
    return tables.where(fit & ~F.array_contains("warnings", "merged cells") & (F.size("rows") > 0))


NODE = "struct<`@type`:string,name:string,sku:string,brand:string,image:array<string>,offers:struct<price:string,lowPrice:string,priceCurrency:string,availability:string>>"


def jsonld_products(pages: DataFrame) -> DataFrame:
    """A row for each schema.org Product in a page's JSON-LD: alone, in a list, or in @graph. A price of zero counts as none, and the lowest price stands in."""
    blocks = pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit("(?is)<script[^>]*application/ld\\+json[^>]*>(.*?)</script>"), 1)).alias("j"))
    one, many = F.from_json("j", NODE), F.from_json("j", f"array<{NODE}>")
    graph = F.from_json("j", f"struct<`@graph`:array<{NODE}>>")["@graph"]
    nodes = F.when(F.trim("j").startswith("["), many).when(graph.isNotNull(), graph).otherwise(F.array(one))
    rows = blocks.select("page_id", F.explode(nodes).alias("n")).where(F.col("n.@type") == "Product")
    price = lambda c: F.nullif(F.col(c).try_cast("decimal(18,4)"), F.lit(0).cast("decimal(18,4)"))
    return rows.select(
        "page_id",
        F.col("n.name").alias("name"),
        F.col("n.sku").alias("sku"),
        F.col("n.brand").alias("brand"),
        F.coalesce(price("n.offers.price"), price("n.offers.lowPrice")).alias("price"),
        F.col("n.offers.priceCurrency").alias("currency"),
        availability("n.offers.availability").alias("availability"),
    )


def alternates(pages: DataFrame) -> DataFrame:
    """page_id, lang, href of a page's hreflang links; the first of a language counts."""
    tags = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit("(?is)<link\\b[^>]*hreflang[^>]*>"), 0)).alias("at", "tag"))
    of = lambda name: F.regexp_extract("tag", f"(?i){name}\\s*=\\s*[\"']([^\"']*)[\"']", 1)
    rows = tags.select("page_id", "at", F.lower(of("hreflang")).alias("lang"), of("href").alias("href")).where("lang <> '' and href <> ''")
    return rows.groupBy("page_id", "lang").agg(F.min_by("href", "at").alias("href"))


def english_alternate(links: DataFrame, region: str) -> DataFrame:
    """The English address of each page: of the region first, then plain, then any."""
    rank = F.when(F.col("lang") == f"en-{region}", 0).when(F.col("lang") == "en", 1).when(F.col("lang").startswith("en"), 2)
    return links.withColumn("_r", rank).where("_r is not null").groupBy("page_id").agg(F.min_by("href", F.struct("_r", "lang")).alias("href"))


def zipped(df: DataFrame, a: str, b: str) -> tuple[DataFrame, DataFrame]:
    """Rows of two arrays side by side, and the rows whose arrays differ in length: a layout that moved is refused, not guessed at."""
    fits = F.size(a) == F.size(b)
    others = [c for c in df.columns if c not in (a, b)]
    return df.where(fits).select(*others, F.posexplode(F.arrays_zip(a, b)).alias("at", "_z")).select(*others, "at", F.col(f"_z.{a}").alias(a), F.col(f"_z.{b}").alias(b)), df.where(~fits)


def boxes(html: str | Column, tag: str = "li") -> Column:
    """A map from label to value of ``label: value`` elements."""
    c = F.col(html) if isinstance(html, str) else html
    texts = F.transform(F.regexp_extract_all(c, F.lit(f"(?is)<{tag}\\b[^>]*>(.*?)</{tag}>"), 1), lambda x: strip_markup(x))
    pairs = F.filter(texts, lambda x: x.contains(":"))
    return F.map_from_entries(F.array_distinct(F.transform(pairs, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)), F.trim(F.regexp_replace(x, "^[^:]*:", ""))))))


def coordinates(c: str | Column) -> tuple[Column, Column]:
    """Latitude and longitude of a text, null where they are out of range."""
    c = F.col(c) if isinstance(c, str) else c
    number = lambda k: F.regexp_extract(c, "(-?[0-9]{1,3}\\.[0-9]+)\\s*,\\s*(-?[0-9]{1,3}\\.[0-9]+)", k).try_cast("double")
    lat, lon = number(1), number(2)
    ok = lat.between(-90, 90) & lon.between(-180, 180)
    return F.when(ok, lat), F.when(ok, lon)


def gallery(record: Column, summary: Column) -> Column:
    """Pictures of a record, then those of its summary that it lacks."""
    empty = F.array().cast("array<string>")
    return F.array_distinct(F.concat(F.coalesce(record, empty), F.coalesce(summary, empty)))


def embedded_variations(pages: DataFrame, attribute: str = "data-product_variations") -> DataFrame:
    """Variations that a page carries as escaped JSON in an attribute."""
    raw = unescape(F.regexp_extract("html", f"(?is){attribute}=\"([^\"]*)\"", 1))
    kind = "array<struct<variation_id:bigint,display_price:double,sku:string,attributes:map<string,string>>>"
    return pages.select("page_id", F.explode(F.from_json(raw, kind)).alias("v")).select("page_id", "v.*")
