"""Files of book work folders as DataFrames: scripts, casts, voices, state, audit and timing manifests in, and the same out.

Every reader takes a path or a pattern and reads whole files; `path` tells the rows of one file from those of another. A path
with no file gives no rows, a file that is no JSON gives none either. Every writer writes one folder per book through Spark's own
writers, so a task that is repeated replaces what it wrote before. The `*_rows` functions work on rows (path, content) from anywhere.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.functions.constants import DEFAULT_CAST

_CHARACTER = "struct<name:string,description:string,voice:string,aliases:array<string>,audition_line:string>"
_SEGMENT = "struct<speaker:string,text:string,instruction:string>"
_ENTRY = "struct<kind:string,phase:string,chapter:string,segment:long,reason:string,text:string,suggested:struct<speaker:string,instruction:string>>"
_CHUNK = "struct<hash:string,start_s:double,end_s:double,script_idx:long,chunk_idx:long,speaker:string,text:string>"


def read_files(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, content) of whole text files; none where nothing matches."""
    try:
        found = spark.read.text(pattern, wholetext=True)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "path string, content string")
    # the writer ends every file with a line end
    return found.select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", r"\n\z", "").alias("content"))


def _is_list(content: Column) -> Column:
    return F.ltrim(content).startswith("[")


def _listed(files: DataFrame, item: str, wrapper: str | None = None, place: str = "ordinal") -> DataFrame:
    """(path, place, item fields) of a JSON list, bare or under a key."""
    bare = F.when(_is_list(F.col("content")), F.from_json("content", f"array<{item}>"))
    wrapped = F.from_json("content", f"struct<{wrapper}:array<{item}>>")[wrapper] if wrapper else F.lit(None)
    rows = files.select("path", F.posexplode(F.coalesce(bare, wrapped)).alias(place, "x"))
    return rows.where("x is not null").select("path", F.col(place).cast("long").alias(place), "x.*")


def script_rows(files: DataFrame) -> DataFrame:
    """(path, seg_idx, speaker, text, instruction) of saved scripts; a missing instruction is empty."""
    return _listed(files, _SEGMENT, "segments", "seg_idx").withColumn("instruction", F.coalesce("instruction", F.lit("")))


def cast_rows(files: DataFrame) -> DataFrame:
    """(path, ordinal, name, description, voice, aliases, audition_line) of saved casts, a list or under `characters`."""
    rows = _listed(files, _CHARACTER, "characters")
    return rows.withColumns({c: F.coalesce(c, F.lit("")) for c in ("voice", "audition_line")})


def with_default_cast(cast: DataFrame, books: DataFrame) -> DataFrame:
    """The casts of books (path), and the default one for a book that has none."""
    default = F.array(*(F.struct(F.lit(n).alias("name"), F.lit(d).alias("description"), F.lit(v).alias("voice")) for n, d, v in DEFAULT_CAST))
    none = books.select("path").distinct().join(cast.select("path").distinct(), "path", "left_anti")
    rows = none.select("path", F.posexplode(default).alias("ordinal", "x"))
    return cast.unionByName(rows.select("path", F.col("ordinal").cast("long").alias("ordinal"), "x.*", F.lit(None).cast("array<string>").alias("aliases"), F.lit("").alias("audition_line")))


def voice_rows(files: DataFrame) -> DataFrame:
    """(path, name, voice_id) of saved voice maps."""
    return files.select("path", F.explode(F.from_json("content", "map<string,string>")).alias("name", "voice_id"))


def state_rows(files: DataFrame) -> DataFrame:
    """(path, key, hash) of saved states; a value that is no string is kept as JSON."""
    return files.select("path", F.explode(F.from_json("content", "map<string,string>")).alias("key", "hash"))


def source_book(files: DataFrame) -> DataFrame:
    """(path, epub_path): the book that a folder was extracted from, null where it is not recorded."""
    return files.select("path", F.nullif(F.get_json_object("content", "$.epub_path"), F.lit("")).alias("epub_path"))


def audit_rows(files: DataFrame) -> DataFrame:
    """(path, ordinal, kind, phase, chapter, segment, reason, text, suggested) of audit logs."""
    return _listed(files, _ENTRY)


def chunk_rows(files: DataFrame) -> DataFrame:
    """(path, place, hash, start_s, end_s, script_idx, chunk_idx, speaker, text) of timing manifests."""
    return _listed(files, _CHUNK, "chunks", "place")


def env_rows(files: DataFrame, given: dict[str, str] | None = None) -> DataFrame:
    """(path, key, value) of lines KEY=value; comments and lines without a sign are none, quotes around a value go, given keys keep their given value."""
    line = F.trim("line")
    rows = files.select("path", F.posexplode(F.split("content", "\r?\n")).alias("at", "line")).where(line.contains("=") & ~line.startswith("#"))
    key = F.trim(F.regexp_replace(F.split_part(line, F.lit("="), F.lit(1)), r"^export\s+", ""))
    value = F.regexp_replace(F.trim(F.regexp_replace(line, "^[^=]*=", "")), "^([\"'])(.*)\\1$", "$2")
    fixed = F.coalesce(*(F.when(F.col("key") == k, F.lit(v)) for k, v in (given or {}).items()), F.col("value"))
    found = rows.select("path", "at", key.alias("key"), value.alias("value")).where("key <> ''")
    return found.groupBy("path", "key").agg(F.max_by("value", "at").alias("value")).select("path", "key", fixed.alias("value"))


def load_scripts(spark: SparkSession, pattern: str) -> DataFrame:
    return script_rows(read_files(spark, pattern))


def load_cast(spark: SparkSession, pattern: str) -> DataFrame:
    return cast_rows(read_files(spark, pattern))


def load_voices(spark: SparkSession, pattern: str) -> DataFrame:
    return voice_rows(read_files(spark, pattern))


def load_state(spark: SparkSession, pattern: str) -> DataFrame:
    return state_rows(read_files(spark, pattern))


def load_audit(spark: SparkSession, pattern: str) -> DataFrame:
    return audit_rows(read_files(spark, pattern))


def load_chunks(spark: SparkSession, pattern: str) -> DataFrame:
    return chunk_rows(read_files(spark, pattern))


def _listing(rows: DataFrame, key: str, order: str, item: Column, name: str) -> DataFrame:
    g = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), item.alias("x"))))["x"].alias(name))
    return g


def script_files(segments: DataFrame, key: str = "chapter_idx") -> DataFrame:
    """(key, content): scripts as they are saved, wrapping quotes off."""
    item = F.struct("speaker", X.strip_wrapping_quotes(F.col("text")).alias("text"), "instruction")
    return _listing(segments, key, "seg_idx", item, "s").select(key, F.to_json("s").alias("content"))


def cast_files(cast: DataFrame, key: str = "book_id") -> DataFrame:
    """(key, content): casts as they are saved, version 6."""
    item = F.struct("name", "description", "voice", "aliases", "audition_line")
    listed = _listing(cast, key, "ordinal", item, "characters")
    return listed.select(key, F.to_json(F.struct(F.lit(6).alias("version"), "characters"), {"ignoreNullFields": "false"}).alias("content"))


def map_files(rows: DataFrame, key: str, name: str, value: str) -> DataFrame:
    """(key, content): voice maps and states as they are saved, by name."""
    entries = F.array_sort(F.collect_list(F.struct(F.col(name).alias("key"), F.col(value).alias("value"))))
    return rows.groupBy(key).agg(F.to_json(F.map_from_entries(entries)).alias("content"))


def audit_files(entries: DataFrame, key: str = "book_id") -> DataFrame:
    """(key, content): audit logs as they are saved."""
    item = F.struct(*(c for c in ("kind", "phase", "chapter", "segment", "reason", "text", "suggested") if c in entries.columns))
    return _listing(entries, key, "ordinal", item, "e").select(key, F.to_json("e").alias("content"))


def extracted_files(chapters: DataFrame) -> DataFrame:
    """(book_id, name, content): a text per chapter and the metadata of each book. chapters (book_id, title, author, language, chapter_idx, chapter_title, href, text)."""
    base = X.filename_base(F.col("chapter_idx"), F.col("chapter_title"))
    texts = chapters.select("book_id", F.concat(base, F.lit(".txt")).alias("name"), F.col("text").alias("content"))
    item = F.struct(F.col("chapter_idx").alias("index"), F.col("chapter_title").alias("title"), base.alias("filename_base"), "href")
    books = chapters.groupBy("book_id").agg(*(F.first(c).alias(c) for c in ("title", "author", "language")), F.array_sort(F.collect_list(F.struct(F.col("chapter_idx").alias("at"), item.alias("x"))))["x"].alias("chapters"))
    return texts.unionByName(books.select("book_id", F.lit("metadata.json").alias("name"), F.to_json(F.struct("title", "author", "language", "chapters")).alias("content")))


def cover_files(covers: DataFrame) -> DataFrame:
    """(name, data) of covers (book_id, data) as files of their books' folders, as the media source writes them; a book without a cover has none."""
    return covers.where(F.length("data") > 0).select(F.concat(F.lit("book_id="), F.col("book_id").cast("string"), F.lit("/cover.jpg")).alias("name"), F.col("data").cast("binary").alias("data"))


def changed_files(new: DataFrame, old: DataFrame, key: str) -> DataFrame:
    """Rows (key, content) that differ from what is saved: files that would be written as they are stay untouched."""
    there = old.select(key, F.col("content").alias("saved"))
    return new.join(there, key, "left").where(~F.col("content").eqNullSafe(F.col("saved"))).drop("saved")


def write_files(files: DataFrame, root: str, keys: list[str]) -> None:
    """One text file in a folder per key (book_id=…/name=…); folders that files does not name stay as they are."""
    writer = files.select(*keys, F.col("content").alias("value")).repartition(*keys).write.partitionBy(*keys)
    writer.mode("overwrite").option("partitionOverwriteMode", "dynamic").text(root)
