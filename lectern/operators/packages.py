"""Package documents and navigation of books as tables: read and written by Spark's XML functions, joined by the names of parts.

Defined results: a package that is null or no XML has no items; overlays of documents that the package does not name are added all
the same, as nothing links to them they play nowhere; null durations count as none; labels that are null are empty; rows that
repeat an ordinal come in the order of their names; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.operators.overlay import ACTIVE_CLASS

_ITEM = "struct<_id:string,_href:string,`_media-type`:string,`_media-overlay`:string,_properties:string>"
_META = "struct<_property:string,_refines:string,_VALUE:string>"
_PACKAGE = f"struct<metadata:struct<meta:array<{_META}>>,manifest:struct<item:array<{_ITEM}>>>"
#: Media types of what is added, and the properties that are said about it.
SMIL_TYPE, SOUND_TYPE = "application/smil+xml", "audio/mpeg"
DURATION, ACTIVE = "media:duration", "media:active-class"


def _parsed(packages: DataFrame) -> DataFrame:
    return packages.select("book_id", F.from_xml("opf", _PACKAGE, {"rowTag": "package"}).alias("p"))


def package_items(packages: DataFrame) -> DataFrame:
    """(book_id, ordinal, item_id, href, media_type, media_overlay) of packages (book_id, opf)."""
    rows = _parsed(packages).select("book_id", F.posexplode("p.manifest.item").alias("ordinal", "i"))
    return rows.select("book_id", F.col("ordinal").cast("long").alias("ordinal"), F.col("i._id").alias("item_id"), F.col("i._href").alias("href"), F.col("i.`_media-type`").alias("media_type"), F.col("i.`_media-overlay`").alias("media_overlay"))


def package_properties(packages: DataFrame) -> DataFrame:
    """(book_id, ordinal, property, refines, value) of packages (book_id, opf)."""
    rows = _parsed(packages).select("book_id", F.posexplode("p.metadata.meta").alias("ordinal", "m"))
    return rows.select("book_id", F.col("ordinal").cast("long").alias("ordinal"), F.col("m._property").alias("property"), F.col("m._refines").alias("refines"), F.col("m._VALUE").alias("value"))


def _clock(ms: Column) -> Column:
    return X.clock(F.coalesce(ms, F.lit(0)).cast("double") / 1000)


def wired_packages(items: DataFrame, overlays: DataFrame) -> DataFrame:
    """(book_id, opf): packages of items (book_id, ordinal, item_id, href, media_type) with overlays (book_id, ordinal, doc_href, smil_href, audio_href, duration_ms).

    Every overlay adds its two parts, numbered in the order of the overlays; the document it is for names it; its duration and the
    sum of a book's durations are properties, as is the class of what is read just now.
    """
    order = Window.partitionBy("book_id").orderBy("ordinal", "smil_href")
    numbered = overlays.withColumn("k", F.row_number().over(order) - 1).withColumn("smil_id", F.concat(F.lit("smil"), (F.row_number().over(order) - 1).cast("string")))
    first = numbered.groupBy("book_id", F.col("doc_href").alias("href")).agg(F.min_by("smil_id", "k").alias("overlay"))
    item = lambda name, href, kind, over: F.struct(name.alias("_id"), href.alias("_href"), kind.alias("_media-type"), over.alias("_media-overlay"))
    none = F.lit(None).cast("string")
    own = items.join(first, ["book_id", "href"], "left").select("book_id", F.lit(0).alias("part"), F.col("ordinal").cast("long").alias("at"), F.col("item_id").alias("name"), item(F.col("item_id"), F.col("href"), F.col("media_type"), F.col("overlay")).alias("i"))
    sound = F.concat(F.lit("sound"), F.col("k").cast("string"))
    added = numbered.select("book_id", F.lit(1).alias("part"), F.explode(F.array(F.struct((F.col("k") * 2).cast("long").alias("at"), F.col("smil_id").alias("name"), item(F.col("smil_id"), F.col("smil_href"), F.lit(SMIL_TYPE), none).alias("i")), F.struct((F.col("k") * 2 + 1).cast("long").alias("at"), sound.alias("name"), item(sound, F.col("audio_href"), F.lit(SOUND_TYPE), none).alias("i")))).alias("x")).select("book_id", "part", "x.*")
    listed = own.unionByName(added).groupBy("book_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("part", "at", "name", "i"))), lambda x: x["i"]).alias("item"))
    meta = lambda name, refines, value: F.struct(F.lit(name).alias("_property"), refines.alias("_refines"), value.alias("_VALUE"))
    each = numbered.groupBy("book_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", F.coalesce("duration_ms", F.lit(0)).alias("ms"), "smil_id"))), lambda x: meta(DURATION, F.concat(F.lit("#"), x["smil_id"]), _clock(x["ms"]))).alias("each"), F.sum("duration_ms").alias("total"))
    whole = F.array(meta(DURATION, none, _clock(F.col("total"))), meta(ACTIVE, none, F.lit(ACTIVE_CLASS)))
    both = listed.join(each, "book_id", "left")
    said = F.when(F.col("each").isNotNull(), F.concat("each", whole))
    return both.select("book_id", F.to_xml(F.struct(F.struct(said.alias("meta")).alias("metadata"), F.struct("item").alias("manifest")), {"rowTag": "package"}).alias("opf"))


def navigation_documents(entries: DataFrame, title: str = "Contents") -> DataFrame:
    """(book_id, nav): the navigation document of entries (book_id, ordinal, href, label)."""
    safe = lambda c: X.escape_markup(F.coalesce(c, F.lit("")))
    line = F.concat(F.lit('<li><a href="'), safe(F.col("href")), F.lit('">'), safe(F.col("label")), F.lit("</a></li>"))
    listed = entries.groupBy("book_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "href", line.alias("line")))), lambda x: x["line"]), "").alias("lines"))
    head = F.concat(F.lit('<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops"><head><title>'), safe(F.lit(title)), F.lit('</title></head><body><nav epub:type="toc"><ol>'))
    return listed.select("book_id", F.concat(head, "lines", F.lit("</ol></nav></body></html>")).alias("nav"))
