"""Landed JSON, XML, TSV and HTML of feeds, registries, filings and classifications as DataFrames."""

from __future__ import annotations

import hashlib
import json
import sys

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from finstrata.functions.exprs import european_number, first_stated
from finstrata.operators.evidence import tables_of, visible_text_of
from finstrata.session import share_code

# Suffixes of documents, and the names feeds use for a field, in order.
DOCUMENT_SUFFIXES = (".xlsx", ".xls", ".pdf", ".zip", ".xhtml", ".html", ".xml")
FEED_FIELDS = {
    "native_id": ("id", "reportId", "publicationId"), "issuer_code": ("issuerCode", "ticker", "symbol"), "issuer_name": ("issuerName", "issuer", "companyName"),
    "title": ("title", "name"), "publish_date": ("publishDate", "publishedAt", "date"), "item_link": ("link", "url", "viewUrl"),
}


def document_urls_of(raw: str | None, base: str) -> list[str]:
    """Addresses of documents anywhere in a JSON text, in order of appearance, each once; paths are joined to `base`."""
    try:
        todo = [json.loads(raw)] if raw else []
    except ValueError:
        return []
    found: dict[str, None] = {}
    while todo:
        v = todo.pop()
        if isinstance(v, dict):
            todo.extend(reversed(v.values()))
        elif isinstance(v, list):
            todo.extend(reversed(v))
        elif isinstance(v, str) and v.strip().lower().split("?", 1)[0].endswith(DOCUMENT_SUFFIXES):
            url = v.strip()
            if url.startswith("/"):
                url = base.rstrip("/") + "/" + url.lstrip("/")
            if url.startswith(("http://", "https://")):
                found.setdefault(url)
    return list(found)


def canonical_id(variant: str, raw: str) -> str:
    """An id of an item's content, whatever the order of its keys."""
    text = json.dumps({"variant": variant, "item": json.loads(raw)}, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    return "auto-" + hashlib.sha256(text.encode()).hexdigest()[:24]


@F.pandas_udf(T.StringType())
def _canonical(variant: pd.Series, raw: pd.Series) -> pd.Series:
    return pd.Series([canonical_id(v, r) for v, r in zip(variant, raw, strict=True)])


def feed_items(payloads: DataFrame, base: str) -> DataFrame:
    """Items of landed feed answers (column payload): ids, fields under their first stated name, the raw item, its documents.

    An item without a native id gets one of its content. Payloads that aren't JSON, and items that aren't objects, give none.
    """

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def urls(raw: pd.Series) -> pd.Series:
        return raw.map(lambda x: document_urls_of(x, base))

    kind = F.coalesce(F.get_json_object("payload", "$.type"), F.lit("unknown"))
    items = share_code(payloads).select(kind.alias("variant"), F.explode(F.from_json(F.get_json_object("payload", "$.items"), "array<string>")).alias("raw")).filter(F.col("raw").startswith("{"))
    fields = [first_stated(*[F.get_json_object("raw", f"$.{k}") for k in keys]).alias(n) for n, keys in FEED_FIELDS.items()]
    out = items.select("variant", "raw", *fields, urls("raw").alias("document_urls"))
    return out.select(F.coalesce("native_id", _canonical("variant", "raw")).alias("source_id"), "variant", *[n for n in FEED_FIELDS if n != "native_id"], "raw", "document_urls")


def documents(items: DataFrame) -> DataFrame:
    """(source_id, variant, url): one row per document of an item."""
    return items.select("source_id", "variant", F.explode("document_urls").alias("url")).distinct()


def directory_rows(pages: DataFrame, html: str = "html") -> DataFrame:
    """Listed securities of directory pages: ticker, isin, name, sector, listed_quantity, nominal_value, listing and delisting date."""

    @F.pandas_udf(T.ArrayType(T.ArrayType(T.StringType())))
    def rows(s: pd.Series) -> pd.Series:
        return s.map(lambda x: [r for t in tables_of(x, *[sys.maxsize] * 4)[0] for r in t])

    r = share_code(pages).select(F.explode(rows(html)).alias("r")).filter(F.size("r") >= 5)
    cell = lambda i: F.trim(F.try_element_at("r", F.lit(i + 1)))
    stated = lambda i: F.when(~cell(i).isin("", "-"), cell(i))
    return r.select(
        F.upper(cell(0)).alias("ticker"), F.upper(cell(1)).alias("isin"), F.nullif(cell(2), F.lit("")).alias("name"), F.nullif(cell(3), F.lit("")).alias("sector"),
        F.regexp_replace(cell(4), r"[^0-9]", "").try_cast("bigint").alias("listed_quantity"), stated(5).alias("nominal_value"), stated(6).alias("listing_date"), stated(7).alias("delisting_date"),
    ).filter(F.col("isin").rlike("^[A-Z0-9]{12}$"))


def unique_active(rows: DataFrame) -> DataFrame:
    """(ticker, isin, choices): the security of each ticker: its only active one, else its only one, else null."""
    g = rows.groupBy("ticker").agg(F.count_if(F.col("delisting_date").isNull()).alias("active"), F.count(F.lit(1)).alias("choices"), F.max(F.when(F.col("delisting_date").isNull(), F.col("isin"))).alias("a"), F.max("isin").alias("o"))
    return g.select("ticker", F.when(F.col("active") == 1, F.col("a")).when(F.col("choices") == 1, F.col("o")).alias("isin"), "choices")


def instrument_pages(pages: DataFrame, html: str = "html") -> DataFrame:
    """`pages` with listed_quantity and market_cap_eur as their visible text states them."""

    @F.pandas_udf(T.StringType())
    def visible(s: pd.Series) -> pd.Series:
        return s.map(visible_text_of, na_action="ignore")

    t = F.col("__text")
    p = share_code(pages).withColumn("__text", visible(html))
    quantity = F.regexp_replace(F.regexp_extract(t, r"(?i)Listed\s+Quantity\s+([0-9][0-9,.\s]*)", 1), r"[^0-9]", "").try_cast("bigint")
    cap = F.regexp_replace(F.regexp_extract(t, r"(?i)Market\s+Cap\s+([0-9][0-9,.\s]*)\s*(?:mil\.?|million)\s*EUR", 1), r"[,\s]", "").try_cast("double")
    return p.withColumn("listed_quantity", quantity).withColumn("market_cap_eur", cap * 1_000_000).drop("__text")


XBRL = T.StructType().add("facts", T.MapType(T.StringType(), T.StructType().add("value", T.StringType()).add("decimals", T.StringType()).add("dimensions", T.MapType(T.StringType(), T.StringType()))))
# Dimensions every fact has.
CORE_DIMENSIONS = ("concept", "entity", "period", "unit", "language", "noteId")


def xbrl_facts(spark: SparkSession, path: str) -> DataFrame:
    """(path, fact, concept, entity, unit, language, period_start, period_end, value, dimensions) of xBRL-JSON files, gzip too.

    period_end is exclusive, as written; dimensions are those beyond the core ones. A file of any size is read, as one record.
    """
    j = spark.read.schema(XBRL).option("multiLine", "true").json(path).select("*", F.col("_metadata.file_path").alias("path"))
    f = j.select("path", F.explode("facts").alias("fact", "f")).select("path", "fact", "f.value", F.col("f.dimensions").alias("d"))
    get = lambda k: F.try_element_at("d", F.lit(k))
    day = lambda i: F.try_to_timestamp(F.substring(F.try_element_at(F.split(get("period"), "/"), F.lit(i)), 1, 10), F.lit("yyyy-MM-dd")).cast("date")
    return f.select("path", "fact", get("concept").alias("concept"), get("entity").alias("entity"), get("unit").alias("unit"), get("language").alias("language"), day(1).alias("period_start"), day(2).alias("period_end"), "value", F.map_filter("d", lambda k, _: ~k.isin(*CORE_DIMENSIONS)).alias("dimensions"))


def registry_records(payloads: DataFrame) -> DataFrame:
    """(lei, legal_name, country, city, entity_status, registration_status, authority_id, authority_entity_id) of landed registry answers.

    An answer's data is one record or a list of them.
    """
    record = "struct<id:string,attributes:struct<lei:string,entity:struct<legalName:struct<name:string>,legalAddress:struct<country:string,city:string>,status:string,registeredAt:struct<id:string>,registeredAs:string>,registration:struct<status:string>>>"
    data = F.get_json_object("payload", "$.data")
    r = payloads.select(F.explode(F.when(data.startswith("["), F.from_json(data, f"array<{record}>")).otherwise(F.array(F.from_json(data, record)))).alias("r")).filter("r IS NOT NULL")
    a = "r.attributes"
    return r.select(F.upper(F.coalesce(f"{a}.lei", "r.id")).alias("lei"), F.col(f"{a}.entity.legalName.name").alias("legal_name"), F.upper(f"{a}.entity.legalAddress.country").alias("country"), F.col(f"{a}.entity.legalAddress.city").alias("city"), F.col(f"{a}.entity.status").alias("entity_status"), F.col(f"{a}.registration.status").alias("registration_status"), F.col(f"{a}.entity.registeredAt.id").alias("authority_id"), F.col(f"{a}.entity.registeredAs").alias("authority_entity_id"))


def filings(payloads: DataFrame) -> DataFrame:
    """(filing_id, entity_id, entity_name, period_end, processed, json_url, errors, warnings) of landed filing lists.

    Entities come from the answer's `included` part, joined by id.
    """
    item = "struct<id:string,attributes:struct<period_end:string,processed:string,json_url:string,error_count:int,warning_count:int>,relationships:struct<entity:struct<data:struct<id:string>>>>"
    d = payloads.select(F.explode(F.from_json(F.get_json_object("payload", "$.data"), f"array<{item}>")).alias("d"))
    e = payloads.select(F.explode(F.from_json(F.get_json_object("payload", "$.included"), "array<struct<id:string,attributes:struct<identifier:string,name:string>>>")).alias("e")).select(F.col("e.id").alias("eid"), F.col("e.attributes.identifier").alias("entity_id"), F.col("e.attributes.name").alias("entity_name")).distinct()
    return d.join(e, F.col("d.relationships.entity.data.id") == F.col("eid"), "left").select(F.col("d.id").alias("filing_id"), "entity_id", "entity_name", F.col("d.attributes.period_end").cast("date").alias("period_end"), F.col("d.attributes.processed").alias("processed"), F.col("d.attributes.json_url").alias("json_url"), F.col("d.attributes.error_count").alias("errors"), F.col("d.attributes.warning_count").alias("warnings"))


def url_language(url: Column) -> Column:
    """The language a document's address ends with (`-hr.zip`, `_en.xhtml`), else null."""
    return F.nullif(F.lower(F.regexp_extract(url, r"(?i)[-_]([a-z]{2})\.(?:zip|xhtml|html|json)(?:\?.*)?$", 1)), F.lit(""))


def safe_url(url: Column, hosts: tuple[str, ...]) -> Column:
    """The address if it is https, of an allowed host, without user or port; else null."""
    host = F.try_parse_url(url, F.lit("HOST"))
    plain = F.try_parse_url(url, F.lit("AUTHORITY")) == host
    return F.when((F.try_parse_url(url, F.lit("PROTOCOL")) == "https") & F.lower(host).isin(*hosts) & plain, url)


def bindings(payloads: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """Rows of landed query answers in the JSON bindings form: value of each variable, and the language of the last."""
    schema = "array<map<string,struct<type:string,value:string,`xml:lang`:string>>>"
    b = payloads.select(F.explode(F.from_json(F.get_json_object("payload", "$.results.bindings"), schema)).alias("b"))
    return b.select(*[F.try_element_at("b", F.lit(n))["value"].alias(n) for n in names], F.try_element_at("b", F.lit(names[-1]))["xml:lang"].alias("language"))


def codelist_tsv(spark: SparkSession, path: str) -> DataFrame:
    """(code, label) of a tab-separated code list; raises on a line without a tab, an empty part or a code that repeats."""
    t = spark.read.text(path).filter("trim(value) <> ''")
    parts = F.split("value", "\t", 2)
    rows = t.select(F.trim(parts[0]).alias("code"), F.when(F.size(parts) == 2, F.trim(parts[1])).alias("label"))
    bad = rows.filter("code = '' OR label IS NULL OR label = ''").select("code").unionByName(rows.groupBy("code").count().filter("count > 1").select("code"))
    if found := bad.limit(5).collect():
        raise ValueError(f"bad lines in the code list: {[r.code for r in found]}")
    return rows


def correspondence(cells: DataFrame) -> DataFrame:
    """(path, from_code, to_code, change, note) of correspondence workbooks, from the sheet with most rows.

    A row counts if two of its cells, in the first and in a later column, look like classification codes; repeated rows count once.
    """
    code = F.regexp_extract(F.trim("text"), r"^(\d{4})(?:\.0)?$", 1)
    coded = cells.filter("error IS NULL").withColumn("code", F.nullif(code, F.lit("")))
    rows = coded.groupBy("path", "sheet", "row").agg(F.array_sort(F.collect_list(F.when(F.col("code").isNotNull(), F.struct("col", "code")))).alias("codes"), F.array_sort(F.collect_list(F.when(F.col("code").isNull() & (F.col("kind") == "text") & (F.length("text") > 1), F.struct("col", "text")))).alias("texts"))
    pairs = rows.filter(F.size("codes") >= 2).select("path", "sheet", F.col("codes")[0]["code"].alias("from_code"), F.col("codes")[1]["code"].alias("to_code"), F.try_element_at("texts", F.lit(-2))["text"].alias("change"), F.try_element_at("texts", F.lit(-1))["text"].alias("note")).distinct()
    best = pairs.groupBy("path", "sheet").agg(F.count(F.lit(1)).alias("n")).groupBy("path").agg(F.max_by("sheet", F.struct("n", "sheet")).alias("sheet"))
    return pairs.join(best, ["path", "sheet"]).drop("sheet")


def amounts(c: Column) -> Column:
    """Numbers written the European way."""
    return european_number(c)


class _Tokens:
    """Visible pieces of a page's text, in order."""

    def __new__(cls, html: str | None) -> list[str]:
        from finstrata.operators.evidence import _Visible

        p = _Visible()
        p.feed(html or "")
        p.close()
        return p.out


# Pieces of a page that aren't a company's name.
NAVIGATION = ("Home", "Market data", "Issuers", "Prices", "News", "Search", "Menu", "Contact", "Hrvatski", "English")


def issuer_pages(pages: DataFrame, html: str = "html") -> DataFrame:
    """`pages` with lei, leis (how many different ones the page shows), home_state and issuer_name.

    lei is null if the page shows none or several. home_state is the piece of text after its label, the name the
    last piece before the label that isn't navigation.
    """

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def tokens(s: pd.Series) -> pd.Series:
        return s.map(lambda x: list(_Tokens(x)))

    p = share_code(pages).withColumn("__t", tokens(html))
    found = F.array_distinct(F.regexp_extract_all(F.array_join("__t", " "), F.lit(r"\b([A-Z0-9]{18}[0-9]{2})\b"), F.lit(1)))
    at = F.array_position(F.transform("__t", lambda x: F.lower(x)), F.lit("home member state"))
    before = F.filter(F.slice("__t", F.lit(1), F.greatest(at.cast("int") - 1, F.lit(0))), lambda x: ~x.isin(*NAVIGATION))
    return p.select(
        *pages.columns, F.when(F.size(found) == 1, found[0]).alias("lei"), F.size(found).alias("leis"),
        F.when(at > 0, F.try_element_at("__t", at.cast("int") + 1)).alias("home_state"), F.when(at > 0, F.try_element_at(before, F.lit(-1))).alias("issuer_name"),
    )
