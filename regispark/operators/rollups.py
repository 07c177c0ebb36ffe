"""Archive roll-ups, organisation statistics and sitemaps.

Years and months of one organisation share one scan: the sitemap's two granularities are GROUPING SETS. Small
dimensions are joined after aggregation, so that what is shuffled is groups, not documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regispark.functions.text import in_month, in_year, month_name, month_text, year_text
from regispark.functions.text import slug as slugged
from regispark.operators.search import RESTRICTED


def of_organisation(docs: DataFrame, orgs: DataFrame, slug: str) -> DataFrame:
    """Documents of the organisation with a slug; LookupError if there is none."""
    row = orgs.where(F.col("slug") == slug).select("id").first()
    if row is None:
        raise LookupError(f"no organisation {slug}")
    return docs.where(F.col("organisation_id") == row["id"])


def years(docs: DataFrame) -> DataFrame:
    """(year, n, n_restricted) of the documents given."""
    return docs.groupBy(year_text(F.col("registration_date")).alias("year")).agg(F.count("*").alias("n"), F.sum(F.when(F.col("restriction") == RESTRICTED, 1).otherwise(0)).alias("n_restricted"))


def months(docs: DataFrame, year: int) -> DataFrame:
    """(month, n, name) of one year; the year is a range of dates and prunes the scan."""
    rows = docs.where(in_year(F.col("registration_date"), year))
    return rows.groupBy(month_text(F.col("registration_date")).alias("month")).agg(F.count("*").alias("n"), F.first(month_name(F.col("registration_date"))).alias("name"))


def month_listing(docs: DataFrame, year: int, month: int) -> DataFrame:
    return docs.where(in_month(F.col("registration_date"), year, month)).orderBy(F.col("registration_date").desc_nulls_last(), F.col("original_id").desc_nulls_last(), "id")


def organisation_stats(docs: DataFrame, orgs: DataFrame) -> DataFrame:
    """Every organisation with its counts and span; those without documents have zero and no percentage."""
    by = docs.groupBy(F.col("organisation_id").alias("id")).agg(
        F.count("*").alias("n"), F.sum(F.when(F.col("restriction") == RESTRICTED, 1).otherwise(0)).alias("k"), F.min("registration_date").alias("first_date"), F.max("registration_date").alias("last_date"),
    )
    n, k = F.coalesce("n", F.lit(0)), F.coalesce("k", F.lit(0))
    return orgs.select("id", "name", "slug").join(by, "id", "left").select("id", "name", "slug", n.alias("n_docs"), k.alias("n_restricted"), F.when(n > 0, F.round(k / n * 100, 2)).alias("restricted_pct"), "first_date", "last_date")


def dossier(docs: DataFrame, name: str) -> DataFrame:
    """Documents of a dossier; the name may come percent-encoded."""
    return docs.where(F.col("dossier") == F.url_decode(F.lit(name))).orderBy("id")


def freshness(docs: DataFrame, orgs: DataFrame) -> DataFrame:
    """(slug, year, month, lastmod): month null for a whole year; both levels from one pass."""
    rows = docs.select("organisation_id", year_text(F.col("registration_date")).alias("year"), month_text(F.col("registration_date")).alias("month"), "updated_at").where("year is not null")
    sets = rows.groupingSets([[F.col("organisation_id"), F.col("year")], [F.col("organisation_id"), F.col("year"), F.col("month")]], "organisation_id", "year", "month").agg(F.max("updated_at").alias("lastmod"))
    return sets.join(orgs.select(F.col("id").alias("organisation_id"), "slug"), "organisation_id").select("slug", "year", "month", "lastmod")


def latest(docs: DataFrame, orgs: DataFrame) -> DataFrame:
    """(slug, lastmod) of every organisation with documents, and of all (slug null)."""
    by = docs.groupBy("organisation_id").agg(F.max("updated_at").alias("lastmod"))
    own = by.join(orgs.select(F.col("id").alias("organisation_id"), "slug"), "organisation_id").select("slug", "lastmod")
    return own.unionByName(by.agg(F.max("lastmod").alias("lastmod")).select(F.lit(None).cast("string").alias("slug"), "lastmod"))


def _iso(col: str):
    return F.date_format(F.col(col).cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ssXXX")


# Pages besides the archive, with their priority; the last did not change since.
FIXED_PAGES = [("", 1.0, "hourly", None), ("/arhiiv", 1.0, None, None), ("/projektist", 1.0, None, "2024-03-27")]


def sitemap_index(docs: DataFrame, orgs: DataFrame, base: str) -> DataFrame:
    """(loc, lastmod) of the sitemap of pages and of one sitemap for each organisation and year."""
    root = base.rstrip("/")
    parts = freshness(docs, orgs).where("month is null").select(F.concat(F.lit(f"{root}/sitemaps/"), "slug", F.lit("/"), "year", F.lit(".xml")).alias("loc"), _iso("lastmod").alias("lastmod"))
    return latest(docs, orgs).where("slug is null").select(F.lit(f"{root}/sitemap-pages.xml").alias("loc"), _iso("lastmod").alias("lastmod")).unionByName(parts)


def sitemap_documents(docs: DataFrame, orgs: DataFrame, slug: str, year: int, base: str) -> DataFrame:
    """(loc, lastmod, changefreq, priority) of the documents of one organisation and year."""
    rows = of_organisation(docs, orgs, slug).where(in_year(F.col("registration_date"), year))
    loc = F.concat_ws("/", F.lit(base.rstrip("/")), F.lit("dokumendid"), F.col("id").cast("string"), slugged(F.col("title")))
    return rows.select(loc.alias("loc"), _iso("updated_at").alias("lastmod"), F.lit(None).cast("string").alias("changefreq"), F.lit(0.6).alias("priority"))


def sitemap_urls(docs: DataFrame, orgs: DataFrame, base: str) -> DataFrame:
    """(loc, lastmod, changefreq, priority) of the fixed and all archive pages; only the first and the organisations have a priority."""
    root = base.rstrip("/")
    path = F.concat_ws("/", F.lit(root), F.lit("arhiiv"), "slug", "year", "month")
    pages = freshness(docs, orgs).unionByName(latest(docs, orgs).where("slug is not null").select("slug", F.lit(None).cast("string").alias("year"), F.lit(None).cast("string").alias("month"), "lastmod"))
    archive = pages.select(path.alias("loc"), _iso("lastmod").alias("lastmod"), F.lit(None).cast("string").alias("changefreq"), F.when(F.col("year").isNull(), 0.8).alias("priority"))
    of_all = docs.agg(F.max("updated_at").alias("lastmod"))
    fixed = F.explode(F.array(*[F.struct(F.lit(root + p).alias("loc"), F.lit(c).cast("string").alias("changefreq"), F.lit(w).alias("priority"), F.lit(d).cast("timestamp").alias("since")) for p, w, c, d in FIXED_PAGES]))
    first = of_all.select("lastmod", fixed.alias("p")).withColumn("lastmod", F.coalesce("p.since", F.col("lastmod").cast("timestamp")))
    return first.select("p.loc", _iso("lastmod").alias("lastmod"), "p.changefreq", "p.priority").unionByName(archive)


NAMESPACE = 'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'


def write_sitemap(urls: DataFrame, path: str) -> None:
    """Sitemap files as XML, one a partition; nulls leave their element out."""
    urls.write.mode("overwrite").format("xml").option("rootTag", f"urlset {NAMESPACE}").option("rowTag", "url").save(path)


def write_sitemap_index(parts: DataFrame, path: str) -> None:
    parts.write.mode("overwrite").format("xml").option("rootTag", f"sitemapindex {NAMESPACE}").option("rowTag", "sitemap").save(path)
