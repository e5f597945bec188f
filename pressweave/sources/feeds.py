"""Feeds as text to articles: items, dates, images; a broken feed stops no other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hours after which an item is too old, characters of a lead.
MOST_HOURS, LEAD = 72, 600
MEDIA = "struct<_url:string>"
ITEM = f"struct<title:string,link:string,pubDate:string,isoDate:string,description:string,`content:encoded`:string,enclosure:{MEDIA},`media:content`:array<{MEDIA}>,`media:thumbnail`:array<{MEDIA}>>"
#: The corrupt record is last: before other fields it leaves them all null.
CHANNEL = f"struct<channel:struct<title:string,item:array<{ITEM}>>,_corrupt_record:string>"
FORMATS = ["d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm:ss z", "d MMM yyyy HH:mm Z", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss.SSSXXX", "yyyy-MM-dd"]


def dated(text: Column) -> Column:
    """S3: the time that an RFC-822 or ISO date says, its weekday left out; null if it says none."""
    plain = F.trim(F.regexp_replace(text, r"^\s*[A-Za-z]+,\s*", ""))
    return F.coalesce(*[F.try_to_timestamp(plain, F.lit(f)) for f in FORMATS])


def escaped(text: Column) -> Column:
    """Text as it stands in an element or an attribute of a feed."""
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("\r", "&#13;")):
        text = F.replace(text, F.lit(sign), F.lit(entity))
    return text


def first_image(content: Column) -> Column:
    """The source of the first picture in a piece of HTML."""
    return F.nullif(F.regexp_extract(content, r"""(?i)<img[^>]+src=["']([^"']+)["']""", 1), F.lit(""))


def items(feeds: DataFrame, as_of: Column) -> DataFrame:
    """(source_id, title, link, published_at, lead, image) of feeds (source_id, xml), and one row with only ``broken`` true for each feed that is no XML.

    S2, S3, S10: an item needs a title and a link; one without a date that can
    be read is as of now; those of over MOST_HOURS are left out. The image is the
    enclosure's, else the media content's, the thumbnail's, or the first picture
    of the content. Null feeds are broken ones.
    """
    parsed = feeds.select("source_id", F.from_xml(F.regexp_replace(F.coalesce("xml", F.lit("")), r"(?s)^\s*<\?xml.*?\?>", ""), CHANNEL, {"mode": "PERMISSIVE"}).alias("feed"))
    broken = F.coalesce(F.col("feed._corrupt_record").isNotNull() | F.col("feed.channel").isNull(), F.lit(True))
    none = F.array(F.lit(None).cast(ITEM))
    rows = parsed.select("source_id", broken.alias("broken"), F.explode(F.when(broken, none).otherwise(F.coalesce("feed.channel.item", F.array().cast(f"array<{ITEM}>")))).alias("item"))
    published = F.coalesce(dated(F.coalesce("item.isoDate", "item.pubDate")), as_of)
    content = F.coalesce("item.`content:encoded`", "item.description")
    image = F.coalesce("item.enclosure._url", F.get("item.`media:content`", F.lit(0))["_url"], F.get("item.`media:thumbnail`", F.lit(0))["_url"], first_image(content))
    flat = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce("item.description", F.lit("")), "<[^>]*>", ""), r"\s+", " "))
    shaped = rows.select("source_id", "broken", F.trim("item.title").alias("title"), F.trim("item.link").alias("link"), F.when(~F.col("broken"), published).alias("published_at"), F.when(~F.col("broken"), F.left(flat, F.lit(LEAD))).alias("lead"), image.alias("image"))
    usable = (F.col("title") != "") & (F.col("link") != "") & (F.col("published_at") >= as_of - F.expr(f"INTERVAL {MOST_HOURS} HOURS"))
    return shaped.where(F.col("broken") | F.coalesce(usable, F.lit(False)))


def titles(xml: Column) -> Column:
    """The trimmed, lower-cased titles that begin an item, by pattern alone, as trend feeds are read."""
    return F.transform(F.regexp_extract_all(xml, F.lit(r"<item>\s*<title>([^<]+)</title>"), F.lit(1)), lambda t: F.lower(F.trim(t)))
