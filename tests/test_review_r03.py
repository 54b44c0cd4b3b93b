"""Tables that findings of the third review were about."""

from __future__ import annotations

import os
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from lectern.functions.constants import ALIAS_STOPWORDS
from lectern.operators import bookkeeping, cast, locate, overlay, reviews
from lectern.plans import registry
from lectern.sources import media
from lectern.streaming import stateful
from test_delivery import fed


def test_hash_index_of_repeated_places(spark):
    """Chunks that repeat a path and a place: the least script place counts, in whatever order they come."""
    chunks = [("p", 1, "h", k) for k in (7, 3, 9, 5)] + [("p", 2, "h", 1), ("p", 0, "h", None)]
    for seed in range(3):
        random.Random(seed).shuffle(chunks)
        found = bookkeeping.hash_index(spark.createDataFrame(chunks, "path string, place int, hash string, script_idx long").coalesce(1)).collect()
        assert [tuple(r) for r in found] == [("h", "p", 3)]


def test_fill_missing_keeps_line_ends_where_told(spark):
    """A cut before a line end: by default all white space goes there, else only what the class says."""
    segments = spark.createDataFrame([(1, 0, "a", "one"), (1, 1, "a", "Ndes.\n To hain "), (1, 2, "a", " \tend")], "chapter_idx long, seg_idx long, speaker string, text string")
    pieces = spark.createDataFrame([(1, 1, 5, 0, "b", "piece")], "chapter_idx long, before long, offset long, ordinal long, speaker string, text string")
    found = lambda *blank: [r.text for r in reviews.fill_missing(segments, pieces, *blank).orderBy("seg_idx").collect()]
    assert found() == ["one Ndes.", "piece", "To hain end"]
    assert found(r"\p{Zs}") == ["one Ndes.", "piece", "\n To hain \tend"]


FIELDS = "name string, description string, voice string, audition_line string, aliases array<string>"


def _usable(aliases, name):
    norm = lambda a: re.sub("[.,;:]+$", "", a.strip()).lower()
    return [a for a in aliases if a is not None and norm(a) not in ("", name.lower()) and norm(a) not in ALIAS_STOPWORDS]


def _merged(members, events, overwrite):
    """The definition of upsert_batches, every row against every member."""
    members, told = [dict(m, aliases=list(m["aliases"] or [])) for m in members], []

    def holder(form):
        low = None if form is None else form.lower()
        by_name = [m for m in members if low is not None and m["name"].lower() == low]
        return next(iter(by_name or [m for m in members if low in [a.lower() for a in m["aliases"] if a is not None]]), None)

    for e in events:
        aliases = e["aliases"] or []
        m = next((h for f in [e["name"], *aliases] if (h := holder(f))), None)
        if m is None:
            members.append(dict(e, aliases=_usable(aliases, e["name"])))
            told.append((e["ordinal"], e["name"], "added", []))
            continue
        joined = m["name"].lower() != e["name"].lower()
        old = _usable(m["aliases"], m["name"])
        asked = dict.fromkeys(old + _usable(aliases + [e["name"]] * joined, m["name"]))
        kept = sorted(a for a in asked if holder(a) in (None, m))
        prompt = m["voice"] or m["description"]
        new = {"description": e["description"] or m["description"], "audition_line": m["audition_line"]}
        new["voice"] = e["voice"] if e["voice"] and e["voice"] != prompt else m["voice"]
        if e["audition_line"] and (overwrite or not m["audition_line"]):
            new["audition_line"] = e["audition_line"]
        changed = set(kept) - set(old) or any(new[c] != m[c] for c in new)
        told.append((e["ordinal"], m["name"], "merged" if joined else "updated" if changed else "unchanged", sorted(set(asked) - set(kept))))
        m.update(new, aliases=kept)
    return members, told


def test_cast_batches_by_brute_force(spark):
    """Names, aliases that several claim, pronouns, odd letters and nulls, in one book and in two, told twice."""
    r = random.Random(5)
    words = ["Ann", "ann.", "ANN", "Bob", "the She", "she", "They.", "Old Tom", "old tom", "É", "é", "x;", "X", "", "..."]

    def row(k, name):
        text = lambda: r.choice([None, "", "d1", "d2"])
        return dict(ordinal=k, name=name, description=text(), voice=text(), audition_line=text(), aliases=r.choice([None, r.choices([*words, None], k=r.randint(0, 4))]))

    for overwrite in (False, True):
        own = [dict(row(k, n), book_id=b) for b in (1, 2) for k, n in enumerate(["Ann", "Tom", "é"][: b + 1])]
        asked = [dict(row(k, r.choice([w for w in words if w] + [f"new {k}"])), book_id=1 + k % 2, batch=k // 20) for k in range(60)]
        left = spark.createDataFrame(own, f"book_id long, ordinal long, {FIELDS}")
        right = spark.createDataFrame(r.sample(asked, len(asked)), f"book_id long, batch long, ordinal long, {FIELDS}")
        found = cast.upsert_batches(left, right, overwrite).orderBy("book_id", "ordinal").collect()
        outcomes = cast.batch_outcomes(left, right, overwrite).orderBy("book_id", "ordinal").collect()
        for b in (1, 2):
            members, told = _merged([m for m in own if m["book_id"] == b], [e for e in asked if e["book_id"] == b], overwrite)
            assert [(x.name, x.description, x.voice, x.audition_line, x.aliases) for x in found if x.book_id == b] == [(m["name"], m["description"], m["voice"], m["audition_line"], m["aliases"]) for m in members]
            assert [(x.ordinal, x.member, x.outcome, x.rejected) for x in outcomes if x.book_id == b] == told


def test_batch_outcomes_of_a_large_book(spark):
    """One member that 20,000 rows join and 20,000 strangers: the work follows the rows, not rows times members."""
    k = F.col("id")
    asked = spark.range(40_000).select(F.lit(0).cast("long").alias("batch"), k.alias("ordinal"), F.concat(F.lit("n"), k.cast("string")).alias("name"), *(F.lit("d").alias(c) for c in ("description", "voice", "audition_line")), F.when(k % 2 == 0, F.array(F.lit("boss"))).alias("aliases"))
    start = time.monotonic()
    own = spark.createDataFrame([(0, "Boss", None, None, None, None)], f"ordinal long, {FIELDS}")
    found = {(x.outcome, x["count"]) for x in cast.batch_outcomes(own, asked).groupBy("outcome").count().collect()}
    assert found == {("merged", 20_000), ("added", 20_000)} and time.monotonic() - start < 120


def test_books_of_few_bytes_are_folded_apart(spark):
    """Casts of many books are folded in several tasks, though all their rows together are few bytes."""
    asked = spark.range(400).select((F.col("id") % 40).alias("book_id"), F.lit(0).cast("long").alias("batch"), F.col("id").alias("ordinal"), F.concat(F.lit("n"), F.col("id").cast("string")).alias("name"), *(F.lit("d").alias(c) for c in ("description", "voice", "audition_line")), F.array(F.lit("boss")).alias("aliases"))
    own = spark.createDataFrame([(b, 0, "Boss", None, None, None, None) for b in range(40)], f"book_id long, ordinal long, {FIELDS}")
    for found in (cast.upsert_batches(own, asked), cast.batch_outcomes(own, asked)):
        told = found.withColumn("p", F.spark_partition_id()).select("book_id", "p").distinct().collect()
        assert len(told) == 40 and len({x.p for x in told}) > 1


def test_chunks_of_a_text_of_few_words(spark):
    """A chapter that says the same few words again and again, in one paragraph: every chunk has its place, in their order, in a short time."""
    r = random.Random(2)
    words = [r.choice(["la", "le", "lo"]) for _ in range(12_000)]
    chunks = [" ".join(words[i : i + 40]) for i in range(0, 12_000, 40)]
    start = time.monotonic()
    rows = [(1, f"<html><body><p>{' '.join(words)}</p></body></html>", chunks), (2, "<p>broken", ["a"]), (None, "<p>a</p>", ["a"])]
    found = overlay.placements(spark.createDataFrame(rows, "chapter_idx long, xhtml string, chunks array<string>")).collect()
    assert sorted(x.chunk_idx for x in found if x.chapter_idx == 1) == list(range(300)) and all(x.fragment and (x.from_share, x.to_share) == (0.0, 1.0) for x in found if x.chapter_idx == 1)
    assert [(x.chapter_idx, x.problem is None) for x in found if x.chapter_idx != 1] == [(2, False)] and time.monotonic() - start < 60


def test_review_spans_write_nothing_on_the_way(spark):
    """Batches in other letters and other white space, found in one pass: no exchange, no table on the way."""
    rows = [(1, "One two  three four.\nFive six seven eight.", [["ONE TWO THREE FOUR!"], ["Five  six seven eight."], ["nothing like it"]])]
    df = locate.review_spans(spark.createDataFrame(rows, "chapter_idx long, text string, batches array<array<string>>"))
    assert [tuple(x) for x in df.orderBy("batch").collect()] == [(1, 0, 0, 19), (1, 1, 20, 42), (1, 2, 20, 42)]
    assert "Exchange" not in df._jdf.queryExecution().toString() and "parquet" not in df._jdf.queryExecution().toString()


def test_speech_events_by_batches(spark, tmp_path):
    """The form for many streams: lines of several streams, out of order and repeated over batches, give the events that whole streams give; a batch delivered twice changes nothing."""
    r = random.Random(3)
    streams, expected = {}, {}
    for s in range(6):
        lines, events = [], []
        for _ in range(r.randint(0, 5)):
            name, parts = r.choice([None, "speech.audio.delta", "x"]), [f"p{r.randint(0, 9)}" for _ in range(r.randint(0, 3))]
            own_lines = ([f"event: {name}"] if name else []) + [": note"] + [f"data: {p}" for p in parts]
            r.shuffle(own_lines)
            lines += [*own_lines, r.choice(["", "\r\n"])]
            events.append((name, "".join(x[6:] for x in own_lines if x.startswith("data:"))) if name or parts else None)
        lines += ["data: tail", None]
        events.append((None, "tail"))
        streams[s], expected[s] = lines, [(s, k, e[0] or "message", e[1]) for k, e in enumerate(events) if e]
    rows = [(s, k, x) for s, lines in streams.items() for k, x in enumerate(lines)]
    rows += r.sample(rows, 8) + [(None, 0, "data: lost")]
    r.shuffle(rows)
    stream = fed(spark, str(tmp_path / "in"), "stream_id long, line_no long, line string", [rows[k::4] for k in range(4)])
    seen = []

    def twice(write, batch, number):
        seen.append(number)
        write(batch, number)
        write(batch, number)

    found = stateful.run_speech_events(stream, str(tmp_path / "run"), twice).collect()
    assert sorted((x.stream_id, x.event_no, x.event, x.payload) for x in found) == sorted(e for s in expected.values() for e in s)
    assert len(seen) >= 4 and {x.batch for x in found} <= set(seen)


def test_delivered_files_are_not_listed(spark, sf):
    """The queries on files open what a table names: no folder is listed by the driver, no commit gathers names."""
    for name in ("book_files", "sound_files", "cover_files"):
        plan = registry.queries()[name](spark, sf)._jdf.queryExecution().toString()
        assert "binaryFile" not in plan and media.Media.name() not in plan


def test_files_by_tables_of_names(spark, tmp_path):
    """Written, moved and read by tasks; names that are given twice, taken or bad are errors and leave nothing; a row may be written again on demand."""
    out = str(tmp_path / "out")
    there = lambda: sorted(os.path.relpath(os.path.join(d, f), out) for d, _, fs in os.walk(out) for f in fs if not f.endswith(".crc"))
    rows = spark.range(0, 600, 1, 4).select(F.format_string("%d/a b%%%d", F.col("id") % 3, "id").alias("name"), F.when(F.col("id") % 5 != 0, F.encode(F.repeat(F.lit("x"), F.col("id").cast("int")), "utf-8")).alias("data"))
    files = media.write_files(rows, "file://" + out, suffix=".x")
    assert there() == sorted(f"{k % 3}/a b%{k}.x" for k in range(600)) and files.agg(F.sum("size")).first()[0] == sum(k for k in range(600) if k % 5)
    found = {r["name"]: len(r.data) for r in media.read_files(files, "file://" + out, suffix=".x").collect()}
    assert found == {f"{k % 3}/a b%{k}": k if k % 5 else 0 for k in range(600)}
    twice = rows.unionByName(rows).withColumn("name", F.concat(F.lit("new/"), "name"))
    for bad in (rows.limit(2), twice, rows.withColumn("name", F.lit("../up")), rows.withColumn("data", F.raise_error(F.lit("never")).cast("binary"))):
        with pytest.raises(Exception, match="files of one name|no name of a file|never"):
            media.write_files(bad, out, suffix=".x")
        assert len(there()) == 600 and not os.path.exists(f"{out}/{media.STAGING}")
    again = rows.where("name = '1/a b%7'").withColumn("data", F.encode(F.lit("new"), "utf-8"))
    assert [r.data for r in media.read_files(media.write_files(again, out, suffix=".x", overwrite=True), out, suffix=".x").collect()] == [b"new"]
    assert len(there()) == 600
    none = media.write_files(rows.where("false"), str(tmp_path / "none"))
    assert none.count() == 0 and media.read_files(none, str(tmp_path / "none")).count() == 0
