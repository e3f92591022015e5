"""Search results: nested result pages, citation URIs and download manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casepipe.functions.text import citation_uri

# --- fixed values: must equal the reference's for identical results -------
RESULT_FIELDS = ["Judgment Title", "Court Information", "Neutral Citation", "Date", "page"]
DOCUMENT_BASE = "https://caselaw.nationalarchives.gov.uk"
#: Folders of downloads by file type.
DOWNLOAD_ROOT = {"xml": "./data/xml_data", "pdf": "./data/pdf_data"}
DOWNLOAD_FOLDER = {"xml": "xml_page_", "pdf": "pdf_page_"}
# ---------------------------------------------------------------------------

#: Listing pages of one saved file.
PAGES_PER_FILE = 1000

RESULT_SCHEMA = (
    "ARRAY<STRUCT<`Judgment Title`: STRING, `Court Information`: STRING, "
    "`Neutral Citation`: STRING, `Date`: STRING, page: INT>>"
)


def nest_results(flat: DataFrame) -> DataFrame:
    """Flat results -> one JSON array of result objects per listing page
    (the inner arrays of the saved search-results file)."""
    obj = F.struct(
        F.col("title").alias("Judgment Title"),
        F.col("court").alias("Court Information"),
        F.col("citation").alias("Neutral Citation"),
        F.col("date").alias("Date"),
        F.col("page").cast("int").alias("page"),
    )
    per_page = flat.groupBy("page").agg(F.array_sort(F.collect_list(F.struct(F.col("item"), obj.alias("o")))).alias("_a"))
    return per_page.select(F.to_json(F.transform("_a", lambda x: x["o"])).alias("json"))


def flatten_search_results(json_pages: DataFrame, json_col: str = "json") -> DataFrame:
    """Parse result pages (``ARRAY<STRUCT>`` JSON text) and flatten to rows
    ``(page_item, title, court, citation, date, page)``.

    Each inner array of a saved file is one row here (``read_results``), so
    the flatten is a single ``posexplode`` per page -- no driver-side loops.
    """
    parsed = json_pages.select(F.from_json(F.col(json_col), RESULT_SCHEMA).alias("_r"))
    ex = parsed.select(F.posexplode("_r").alias("page_item", "o"))
    return ex.select(
        "page_item",
        F.col("o.`Judgment Title`").alias("title"),
        F.col("o.`Court Information`").alias("court"),
        F.col("o.`Neutral Citation`").alias("citation"),
        F.col("o.Date").alias("date"),
        F.col("o.page").alias("page"),
    )


def write_results(json_pages: DataFrame, path: str, order: str, json_col: str = "json") -> None:
    """Saved search-results files, each one JSON array of the arrays of
    ``PAGES_PER_FILE`` listing pages at most, by ranges of ``order`` (a number)."""
    pages = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(json_col).alias("j")))), lambda x: x["j"])
    ranges = json_pages.groupBy(F.floor(F.col(order) / PAGES_PER_FILE).alias("_range"))
    files = ranges.agg(F.concat(F.lit("["), F.array_join(pages, ",\n"), F.lit("]")).alias("value")).select("value")
    files.write.mode("overwrite").option("maxRecordsPerFile", 1).text(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """``(json)``: the inner arrays of saved search-results files."""
    whole = spark.read.text(path, wholetext=True)
    arrays = F.from_json("value", f"ARRAY<{RESULT_SCHEMA}>")
    return whole.select(F.explode(arrays).alias("_p")).select(F.to_json("_p").alias("json"))


def download_manifest(results: DataFrame, ext: str = "xml", order: str = "item_order") -> DataFrame:
    """Per result: URI, download URL and target path; keep-last per path.

    ``title`` with ``/`` -> ``_``; path ``./data/{ext}_data/{ext}_page_{page}/
    {title}.{ext}``.  Two results with the same path overwrite each other in
    the reference; here the last one (by ``order``) is kept and
    ``collisions`` counts the results that shared the path.
    """
    uri = citation_uri(F.col("citation"))
    safe = F.regexp_replace(F.col("title"), "/", "_")
    path = F.concat(F.lit(f"{DOWNLOAD_ROOT[ext]}/{DOWNLOAD_FOLDER[ext]}"), F.col("page").cast("string"), F.lit("/"), safe, F.lit(f".{ext}"))
    m = results.select(
        "title",
        "citation",
        F.col("page").cast("int").alias("page"),
        uri.alias("uri"),
        F.concat(F.lit(DOCUMENT_BASE + "/"), uri, F.lit(f"/data.{ext}")).alias("url"),
        path.alias("target_path"),
        F.col(order).alias("_o"),
    )
    last = m.groupBy("target_path").agg(
        F.max_by(F.struct("title", "citation", "page", "uri", "url"), F.col("_o")).alias("_r"),
        F.count(F.lit(1)).alias("collisions"),
    )
    return last.select("_r.title", "_r.citation", "_r.page", "_r.uri", "_r.url", "target_path", "collisions")


def page_folders(results: DataFrame, ext: str = "xml") -> DataFrame:
    """``xml_page_1 .. xml_page_{max(page)}``: one row per folder."""
    mx = results.agg(F.max(F.col("page").cast("int")).alias("m"))
    return mx.select(F.explode(F.sequence(F.lit(1), F.col("m"))).alias("page")).select(
        "page", F.concat(F.lit(DOWNLOAD_FOLDER[ext]), F.col("page").cast("string")).alias("folder")
    )


