"""Stateful streams over several batches and restarts, files with failing tasks, reports on odd rows."""

import os
import random

import pytest
from pyspark.sql import functions as F

from lectern.operators import overlay, packages, reports
from lectern.sources import epub
from lectern.sources.media import STAGING, Media
from lectern.streaming import stateful


def fed(spark, folder, schema, batches):
    """A stream of batches, a file each, read one file at a time."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/b{k:03d}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(folder)


TASKS = "book_id long, chapter_idx long, pos long, n_tasks long, n_chapters long"


def test_ready_chapters_in_order(spark, tmp_path):
    """Tasks in any order, late, repeated, outside a chapter; each chapter is told once and in order, also over a restart."""
    own = stateful.with_state(spark)
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") != own.conf.get("spark.sql.streaming.stateStore.providerClass")
    t = lambda c, p, b=1: (b, c, p, 2, 3)
    first = [[t(1, 0), t(1, 1), t(0, 0), (None, 0, 0, 2, 3), (1, 0, 9, 2, 3)], [t(0, 0), t(0, 0)], [t(0, 1), t(0, 0, 2)]]
    stream = fed(own, str(tmp_path / "in"), TASKS, first)
    state = str(tmp_path / "run")
    told = stateful.run_stateful(stateful.ready_chapters(stream), state).collect()
    assert sorted((r.book_id, r.chapter_idx) for r in told) == [(1, 0), (1, 1)] and len({r.batch for r in told}) == 1
    # the same place goes on where it stopped: the rest of both books, with everything repeated
    for k, rows in enumerate([[t(0, 0), t(0, 1), t(2, 1)], [t(2, 0), t(2, 0), t(1, 1), t(0, 1, 2)], [t(2, 0), t(0, 0)]]):
        own.createDataFrame(rows, TASKS).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/c{k}"))
    told = stateful.run_stateful(stateful.ready_chapters(stream), state).collect()
    assert sorted((r.book_id, r.chapter_idx) for r in told) == [(1, 0), (1, 1), (1, 2), (2, 0)]


def test_speech_events_line_by_line(spark, tmp_path):
    """Lines of several streams, out of order and repeated over batches, give the events that whole streams give; a batch delivered twice changes nothing."""
    own = stateful.with_state(spark)
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
    stream = fed(own, str(tmp_path / "in"), "stream_id long, line_no long, line string", [rows[k::4] for k in range(4)])
    seen = []

    def twice(write, batch, number):
        seen.append(number)
        write(batch, number)
        write(batch, number)

    found = stateful.run_stateful(stateful.speech_events(stream), str(tmp_path / "run"), twice).collect()
    assert sorted((x.stream_id, x.event_no, x.event, x.payload) for x in found) == sorted(e for s in expected.values() for e in s)
    assert len(seen) >= 4 and {x.batch for x in found} <= set(seen)


def files(folder):
    return sorted(os.path.relpath(os.path.join(d, f), folder) for d, _, names in os.walk(folder) for f in names)


def test_media_round_trip(spark, tmp_path):
    spark.dataSource.register(Media)
    rows = [(f"a/{k}", 8000, [k / 128, -1.0, 0.5][: k % 4]) for k in range(20)] + [("none", None, None)]
    df = spark.createDataFrame(rows, "name string, rate int, samples array<double>").repartition(4)
    out = str(tmp_path / "sound")
    df.write.format("lectern_media").option("kind", "sound").option("suffix", ".wav").mode("append").save(out)
    assert len(files(out)) == 21 and files(out)[-1] == "none.wav"
    read = spark.read.format("lectern_media").option("kind", "sound").option("suffix", ".wav").load(out)
    assert {r["name"]: r.samples for r in read.collect()} == {n: s or [] for n, _, s in rows}
    with pytest.raises(Exception, match="files of one name"):
        df.limit(3).write.format("lectern_media").option("kind", "sound").option("suffix", ".wav").mode("append").save(out)
    with pytest.raises(Exception, match="no name of a file"):
        spark.createDataFrame([("../x", b"1")], "name string, data binary").write.format("lectern_media").mode("append").save(out)
    assert len(files(out)) == 21
    (tmp_path / "sound/broken.wav").write_bytes(b"no sound")
    again = spark.read.format("lectern_media").option("kind", "sound").option("suffix", ".wav").load(out)
    assert again.where("name = 'broken'").first().samples is None and again.count() == 22
    empty = str(tmp_path / "empty")
    df.where("false").write.format("lectern_media").option("kind", "sound").mode("append").save(empty)
    assert spark.read.format("lectern_media").load(empty).count() == 0


def test_media_with_failing_tasks(tmp_path):
    """A failed attempt leaves nothing that is read, and its retry writes the same files; a job that fails leaves nothing at all."""
    import subprocess
    import sys

    code = f"""
import os, sys
sys.path.insert(0, {os.getcwd()!r})
from lectern.session import build_session
from lectern.sources.media import Media
spark = build_session("retry", cores="2,3")
spark.dataSource.register(Media)
from pyspark.sql import functions as F
flag = {str(tmp_path / "failed")!r}
def once(batches):
    for batch in batches:
        yield batch
        if not os.path.exists(flag) and batch.num_rows and 5 in batch.column(0).to_pylist():
            open(flag, "w").close()
            raise RuntimeError("the task fails after it gave its rows")
rows = spark.range(0, 40, 1, 3).mapInArrow(once, "id long").select(F.concat(F.lit("f"), "id").alias("name"), F.encode(F.col("id").cast("string"), "utf-8").alias("data"))
rows.write.format("lectern_media").mode("append").save({str(tmp_path / "out")!r})
bad = rows.withColumn("data", F.when(F.col("name") == "f7", F.raise_error(F.lit("never")).cast("binary")).otherwise(F.col("data")))
try:
    bad.write.format("lectern_media").mode("append").save({str(tmp_path / "bad")!r})
except Exception:
    print("failed as it should")
"""
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300, env=os.environ | {"PYTHONPATH": os.getcwd()})
    assert "failed as it should" in done.stdout, done.stderr[-2000:]
    assert (tmp_path / "failed").exists()
    assert sorted(files(tmp_path / "out")) == sorted(f"f{k}" for k in range(40)) and STAGING not in os.listdir(tmp_path / "out")
    assert not (tmp_path / "bad").exists() or files(tmp_path / "bad") == []


def test_books_round_trip(spark, tmp_path):
    spark.dataSource.register(Media)
    words = "word " * 60
    rows = [("b1", "A & <B>", None, "en", [("One", f"first\x0b {words}\n\nlast"), (None, "short"), ("Three", words)]), ("b2", None, "Me", None, None)]
    books = spark.createDataFrame(rows, "name string, title string, author string, language string, chapters array<struct<title:string,text:string>>")
    epub.packaged(books).write.format("lectern_media").option("suffix", ".epub").mode("append").save(str(tmp_path))
    found = epub.read_books(spark, str(tmp_path)).orderBy("chapter_idx").collect()
    assert [(r.title, r.author, r.chapter_idx, r.chapter_title) for r in found] == [("A & <B>", "Unknown", 1, "One"), ("A & <B>", "Unknown", 2, "Three")]
    assert found[0].text == "first " + words.strip() + "\n\nlast"


def test_packages_and_navigation(spark):
    items = spark.createDataFrame([(1, 0, "a", "a.xhtml", "t"), (2, 0, "b", "b.xhtml", None)], "book_id int, ordinal int, item_id string, href string, media_type string")
    overlays = spark.createDataFrame([(1, 1, "a.xhtml", "a.smil", "a.mp3", None), (1, 0, "a.xhtml", "b.smil", "b.mp3", 1500)], "book_id int, ordinal int, doc_href string, smil_href string, audio_href string, duration_ms int")
    written = packages.wired_packages(items, overlays)
    found = {(r.book_id, r.item_id): (r.href, r.media_overlay) for r in packages.package_items(written).collect()}
    assert found == {(1, "a"): ("a.xhtml", "smil0"), (1, "smil0"): ("b.smil", None), (1, "smil1"): ("a.smil", None), (1, "sound0"): ("b.mp3", None), (1, "sound1"): ("a.mp3", None), (2, "b"): ("b.xhtml", None)}
    said = [(r.book_id, r.property, r.refines, r.value) for r in packages.package_properties(written).orderBy("ordinal").collect()]
    assert [x[2:] for x in said] == [("#smil0", "0:00:01.500"), ("#smil1", "0:00:00.000"), (None, "0:00:01.500"), (None, overlay.ACTIVE_CLASS)]
    broken = spark.createDataFrame([(1, None), (2, "no xml"), (3, "<package><manifest/></package>")], "book_id int, opf string")
    assert packages.package_items(broken).collect() == [] and packages.package_properties(broken).collect() == []
    nav = packages.navigation_documents(spark.createDataFrame([(1, 1, "b", None), (1, 0, "a&b", "<i>")], "book_id int, ordinal int, href string, label string")).first().nav
    assert nav.index("a&amp;b") < nav.index('href="b"') and "&lt;i&gt;" in nav


def test_verified_chapters(spark):
    told = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (2, 0, "a"), (3, 5, "a"), (4, 0, "x"), (9, 0, "no document")], "chapter_idx int, tag_idx int, text string")
    pages = spark.createDataFrame([(1, "<d><p>a</p><div> b </div><p/></d>"), (2, "<d><p>A</p></d>"), (3, "<d><p>a</p></d>"), (4, "<p>x"), (5, "<d/>"), (6, None)], "chapter_idx int, xhtml string")
    found = {r.chapter_idx: (r.n_wrong, r.verified) for r in overlay.verified_chapters(told, pages).collect()}
    assert found == {1: (0, True), 2: (1, False), 3: (1, False), 4: (1, False), 6: (0, False), 9: (1, False)}


def test_reports_of_odd_rows(spark):
    quoted = lambda x: spark.createDataFrame([(x,)], "t string").select(reports.quoted(F.col("t")).alias("q")).first().q
    for text in ("plain", "it's", 'both \' and "', "back\\slash\n\t\r", ""):
        assert quoted(text) == repr(text)
    merges = spark.createDataFrame([(1, 0, None, ["a"]), (1, 1, "A", None), (1, 2, "A", ["a.", None, "b", "B"])], "k int, ordinal int, into string, sources array<string>")
    found = sorted((r.ordinal, r.place, r.problem) for r in reports.merge_problems(merges, "k").collect())
    assert found == [(0, -1, "merge 0: 'into' is empty after normalization"), (2, 0, "merge 2: 'from' entry 'a.' equals 'into' 'A'"), (2, 1, "merge 2: empty entry in 'from'"), (2, 3, "merge 2: 'B' already folded into 'A'")]
    audit = spark.createDataFrame([(1, "flag"), (1, "edit"), (2, "edit"), (None, "flag")], "chapter_idx int, kind string")
    chapters = spark.createDataFrame([(1,), (1,), (2,), (3,)], "chapter_idx int")
    assert sorted(tuple(r) for r in reports.refusals(audit, chapters).collect()) == [(1, 1, True), (2, 0, False), (3, 0, False)]
    with pytest.raises(reports.OpenFlags, match="1 unresolved"):
        reports.refuse_open_flags(audit, chapters)
    assert reports.refuse_open_flags(audit, chapters, ignore=True) == 1 and reports.refuse_open_flags(audit, chapters.where("chapter_idx > 1")) == 0
