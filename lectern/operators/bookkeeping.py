"""Word positions, cast checks, hash indexes, partial state, gates and assembly.

Defined results: null names, labels and hashes match nothing; a null `done` is not done; rows that repeat a key count as one where
a key's first or last is asked for; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.operators import audio
from lectern.operators.incremental import ready_prefix

#: The format of speech per dialect where a configuration names none.
FORMATS = {"openai": "pcm", "qwen": "wav"}


def word_rows(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, word_idx, word, start_char, end_char): lower-case words of each text with their places, in code points. A null text has none.

    What stands between the words gives the places: a running sum over gaps and words.
    """
    t = df.select(key, F.coalesce(F.col(text), F.lit("")).alias("t"))
    gaps, words = F.split("t", X.WORD, -1), F.regexp_extract_all("t", F.lit(f"({X.WORD})"), F.lit(1))
    sizes = F.transform(words, lambda w, i: F.struct(w.alias("w"), F.length(F.get(gaps, i)).alias("gap")))
    rows = t.select(key, F.posexplode(sizes).alias("word_idx", "x"))
    before = Window.partitionBy(key).orderBy("word_idx").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("x.gap") + F.length("x.w")).over(before)
    return rows.select(key, F.col("word_idx").cast("long").alias("word_idx"), F.lower("x.w").alias("word"), (end - F.length("x.w")).cast("long").alias("start_char"), end.cast("long").alias("end_char"))


def cast_problems(cast: DataFrame) -> DataFrame:
    """(book_id, ordinal, place, problem) of cast members (book_id, ordinal, name, aliases, description, voice): missing fields (places below zero), and labels that clash.

    A label belongs to the first member that uses it; an alias that is its member's own name, and a label that an earlier
    member has, are problems. Labels are compared normalised; empty ones are none.
    """
    who = F.concat(F.lit("character '"), F.col("name"), F.lit("'"))
    missing = [
        cast.where(F.coalesce(field, F.lit("")) == "").select("book_id", "ordinal", F.lit(place).cast("long").alias("place"), F.concat(F.lit("character "), F.col("ordinal").cast("string"), F.lit(" ("), "name", F.lit(f"): missing '{field}'")).alias("problem"))
        for place, field in ((-2, "description"), (-1, "voice"))
    ]
    labels = cast.select("book_id", "ordinal", "name", F.posexplode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("place", "label"))
    labels = labels.withColumn("norm", X.normalize_name(F.col("label"))).where("norm <> ''").withColumn("place", F.col("place").cast("long"))
    own = (F.col("label") != F.col("name")) & (F.col("norm") == X.normalize_name(F.col("name")))
    self_named = labels.where(own).select("book_id", "ordinal", "place", F.concat(who, F.lit(": alias '"), "label", F.lit("' conflicts with its own name")).alias("problem"))
    # a book's labels: a few hundred rows
    first = F.first("name").over(Window.partitionBy("book_id", "norm").orderBy("ordinal", "place"))
    used = labels.where(~own).withColumn("owner", first).where(F.col("owner") != F.col("name"))
    kind = F.when(F.col("label") == F.col("name"), "name").otherwise("alias")
    clashes = used.select("book_id", "ordinal", "place", F.concat(who, F.lit(": "), kind, F.lit(" '"), "label", F.lit("' already used by '"), "owner", F.lit("'")).alias("problem"))
    return missing[0].unionByName(missing[1]).unionByName(self_named).unionByName(clashes)


def named_members(segments: DataFrame, cast: DataFrame, fallback: str = "Narrator") -> DataFrame:
    """segments (book_id, speaker, …) with the member that speaks: whose name or alias the speaker is, letter by letter.

    Members are entered in their order, each with its name and then its aliases, and a later entry takes the place of an earlier one.
    Any other speaker, also null, is whoever the fallback names, and nobody (empty) where it names nobody.
    """
    forms = cast.select("book_id", "name", "ordinal", F.posexplode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("place", "form"))
    index = forms.groupBy("book_id", "form").agg(F.max_by("name", F.struct("ordinal", "place")).alias("member"))
    other = index.where(F.col("form") == fallback).select("book_id", F.col("member").alias("other"))
    joined = segments.join(index.withColumnRenamed("form", "speaker"), ["book_id", "speaker"], "left").join(other, "book_id", "left")
    return joined.withColumn("member", F.coalesce("member", "other", F.lit(""))).drop("other")


def hash_index(chunks: DataFrame) -> DataFrame:
    """(hash, path, script_idx): the first place (by path, then place) of each segment in timing manifests (path, place, hash, script_idx); chunks without a hash or a script place are none.

    Of chunks that repeat a path and a place the least script place counts.
    """
    rows = chunks.where("hash is not null and hash <> '' and script_idx is not null")
    first = F.min(F.struct("path", "place", "script_idx")).alias("x")
    return rows.groupBy("hash").agg(first).select("hash", "x.path", "x.script_idx")


def latest_change(files: DataFrame) -> DataFrame:
    """(folder, changed_at): the latest change under each folder of files (path, changed_at)."""
    return files.groupBy(F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("folder")).agg(F.max("changed_at").alias("changed_at"))


def first_changed_phase(before: DataFrame, after: DataFrame, phases: list[str]) -> DataFrame:
    """(book_id, phase): the first phase that wrote a file between two listings (book_id, phase, path, changed_at); a run that goes step by step ends there."""
    old = before.select("book_id", "phase", "path", F.col("changed_at").alias("was"))
    changed = after.join(old, ["book_id", "phase", "path"], "left").where(~F.col("was").eqNullSafe(F.col("changed_at")))
    rank = F.array_position(F.array(*map(F.lit, phases)), F.col("phase"))
    return changed.where(rank > 0).groupBy("book_id").agg(F.min_by("phase", rank).alias("phase"))


def partial_state(state: DataFrame) -> DataFrame:
    """State rows (key, hash, done, …) that were begun and not finished."""
    return state.where("hash is not null and hash <> '' and not coalesce(done, false)")


def without_partial(state: DataFrame, keys: DataFrame) -> DataFrame:
    """State without what was begun and not finished under the keys; finished rows stay."""
    gone = state.where(~F.coalesce("done", F.lit(False))).join(keys.select("key").distinct(), "key", "left_semi").select("key").distinct()
    return state.join(gone, "key", "left_anti")


def chapter_batch(tasks: DataFrame, size: int) -> DataFrame:
    """(book_id, hash, voice, needed): the batch of each book that serves its next chapter: tasks (book_id, voice, voice_order, hash, ordinal, needed) of the first voice with a needed one, needed ones first."""
    first = tasks.where("needed").groupBy("book_id").agg(F.min_by("voice", "voice_order").alias("voice"))
    order = Window.partitionBy("book_id").orderBy(F.desc("needed"), "ordinal")
    ranked = tasks.join(first, ["book_id", "voice"], "left_semi").withColumn("n", F.row_number().over(order))
    return ranked.where(F.col("n") <= size).select("book_id", "hash", "voice", "needed")


def gate(problems: DataFrame, chapters: DataFrame, key: str = "chapter_idx") -> DataFrame:
    """(key, n_missing, n_hallucinated, passed) of chapters, by the rows (key, kind) that a validation found."""
    n = problems.groupBy(key).agg(*(F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in ("missing", "hallucinated")))
    rows = chapters.select(key).distinct().join(n, key, "left").fillna(0, ["n_missing", "n_hallucinated"])
    return rows.withColumn("passed", (F.col("n_missing") == 0) & (F.col("n_hallucinated") == 0))


def assembled(chapters: DataFrame, segments: DataFrame, pause: int) -> DataFrame:
    """(book_id, chapter_idx, samples): sound of the chapters (book_id, chapter_idx, n_pending) up to the first that still waits, segments (book_id, chapter_idx, pos, samples) with pauses."""
    ready = ready_prefix(chapters).select("book_id", "chapter_idx")
    return audio.concatenated(segments.join(ready, ["book_id", "chapter_idx"], "left_semi"), ["book_id", "chapter_idx"], "pos", "samples", pause)


#: Hosts that take the strict dialect, and the names of both dialects.
STRICT_HOSTS = ("openrouter.ai", "api.openai.com")
STRICT, WIDE = "openai", "qwen"


def dialect(wanted: Column, address: Column) -> Column:
    """The wanted dialect; where it is `auto`, the strict one for the hosts that are known to take no other, else the wide one. An address without a host has none of these."""
    host = F.lower(F.coalesce(F.try_parse_url(address, F.lit("HOST")), F.lit("")))
    return F.when(wanted != "auto", wanted).when(host.isin(*STRICT_HOSTS), STRICT).otherwise(WIDE)


def response_format(wanted: Column, dialect: Column) -> Column:
    """The wanted format of speech, else what the dialect's services send."""
    return F.when(F.coalesce(wanted, F.lit("")) != "", wanted).when(dialect == "openai", FORMATS["openai"]).otherwise(FORMATS["qwen"])


def window_lines(window: DataFrame) -> Column:
    """Lines of a shown window of segments (seg_idx, speaker, instruction, text, flagged, recorded): an arrow at the flagged one, and the place it had when it was flagged."""
    style = F.when(F.coalesce("instruction", F.lit("")) != "", F.concat(F.lit("/"), "instruction")).otherwise("")
    line = F.concat(F.lit("  "), F.when(F.col("flagged"), ">").otherwise(" "), F.lit(" "), F.lpad(F.col("seg_idx").cast("string"), 4, " "), F.lit(" ("), "speaker", style, F.lit("): "), X.truncate(F.col("text")))
    moved = F.when(F.col("flagged") & (F.col("recorded") != F.col("seg_idx")), F.concat(F.lit("       (recorded as seg "), F.col("recorded").cast("string"), F.lit("; script re-split since)")))
    return F.concat_ws("\n", line, moved)


def voice_key(preset: Column, instruct: Column, ref_audio: Column, ref_text: Column) -> Column:
    """What tasks must share to be spoken in one batch: a preset voice and its direction, else a reference and its text."""
    chosen = F.coalesce(preset, F.lit("")) != ""
    return F.when(chosen, F.struct(F.lit("preset").alias("kind"), preset.alias("voice"), instruct.alias("with"))).otherwise(F.struct(F.lit("reference").alias("kind"), ref_audio.alias("voice"), ref_text.alias("with")))


def voice_references(tasks: DataFrame, clips: DataFrame, state: DataFrame, styles: DataFrame, sample_line: str) -> DataFrame:
    """tasks (name, emotion) with the reference clip of each: path, ref_text, sha.

    clips (name, emotion, path, sha) has a member's clip per style, and its base clip under no style; state (name, emotion,
    ref_text, sha) is what was recorded when a clip was made; styles (emotion, line) the standing lines. The style's clip
    goes before the base clip; the text is the recorded one of the clip that is used, then the style's line (not for a base
    clip), then the sample line; the digest is the recorded one of the style, else that of the clip.
    """
    own = clips.where("emotion is not null").select("name", "emotion", F.col("path").alias("own_path"), F.col("sha").alias("own_sha"))
    base = clips.where("emotion is null").select("name", F.col("path").alias("base_path"), F.col("sha").alias("base_sha"))
    told = state.where("emotion is not null").select("name", "emotion", F.col("ref_text").alias("own_text"), F.col("sha").alias("told_sha"))
    base_told = state.where("emotion is null").select("name", F.col("ref_text").alias("base_text"))
    rows = tasks.join(own, ["name", "emotion"], "left").join(base, "name", "left").join(told, ["name", "emotion"], "left").join(base_told, "name", "left").join(styles, "emotion", "left")
    some = lambda c: F.nullif(F.col(c), F.lit(""))
    styled = F.col("own_path").isNotNull()
    text = F.when(styled, F.coalesce(some("own_text"), some("line"))).otherwise(some("base_text"))
    sha = F.coalesce(some("told_sha"), F.when(styled, F.col("own_sha")).otherwise(F.col("base_sha")))
    return rows.select(*tasks.columns, F.coalesce("own_path", "base_path").alias("path"), F.coalesce(text, F.lit(sample_line)).alias("ref_text"), F.coalesce(sha, F.lit("")).alias("sha"))


def audit_contexts(entries: DataFrame, sources: DataFrame, before: int, after: int) -> DataFrame:
    """entries (chapter_idx, text, source_span, …) with the lines of their chapter around their text, else the span that was saved with them."""
    found = entries.join(sources.select("chapter_idx", F.col("text").alias("source")), "chapter_idx", "left")
    context = X.focused_context(F.col("source"), F.col("text"), before, after)
    return found.withColumn("context", F.coalesce(F.nullif(context, F.lit("")), "source_span", F.lit(""))).drop("source")
