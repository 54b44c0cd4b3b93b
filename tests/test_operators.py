import io
import itertools
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from lectern.operators import alignment, audio, cast, chunking, generation, html, incremental, replies, script, timing
from lectern.sources import epub


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_paragraphs_nested_and_unclosed():
    page = "<html><head><title>T</title></head><body><nav><p>skip</p></nav><div>loose <p>one<p>two <b>bold</div><section><p>three</p></section><ul><li>x<li>y</ul><script>no</script></body></html>"
    assert [t for _, _, t in html.paragraphs_of(page)] == ["loose", "one", "two bold", "three", "x", "y"]
    assert html.title_of(page) == "T"
    assert html.title_of("<h2>two</h2><h1>one</h1>") == "one"
    assert html.title_of("<p>x</p>") is None
    assert html.paragraphs_of("") == []


def test_timing(spark):
    c = spark.createDataFrame([(1, 0, 1.0, "a", "x"), (1, 1, 2.0, " ", "x"), (1, 2, 0.5, "c", None)], "chapter_idx int, seg_idx int, duration_s double, text string, speaker string")
    t = timing.timing_manifest(c)
    assert [(r.start_s, r.end_s) for r in t.orderBy("seg_idx").collect()] == [(0.0, 1.0), (1.5, 3.5), (4.0, 4.5)]
    assert rows(timing.cues(t).select("cue_idx", "body"), "cue_idx") == [(1, "[x] a"), (2, "c")]
    probes = spark.createDataFrame([(0, 1, 1.2), (1, 1, 0.0), (2, 1, 4.5), (3, 1, 9.0), (4, 1, -1.0)], "probe_id int, chapter_idx int, t double")
    assert rows(timing.locate(probes, t).select("probe_id", "seg_idx"), "probe_id") == [(0, 1), (1, 0), (2, 2)]


def test_overlaps_and_pars(spark):
    spans = spark.createDataFrame([(1, 0, 0, 10), (1, 1, 10, 20)], "doc_id int, span_idx long, start long, end long")
    bounds = spark.createDataFrame([(1, 0, 0, 14), (1, 1, 16, 30)], "doc_id int, para_idx long, start_char long, end_char long")
    found = timing.interval_overlaps(spans, bounds, "doc_id", 7)
    assert rows(found.select("span_idx", "para_idx", "width", "from_share", "to_share"), "span_idx", "para_idx") == [(0, 0, 10, 0.0, 1.0), (1, 0, 4, 0.0, 0.5), (1, 1, 4, 0.5, 1.0)]
    placed = spark.createDataFrame([(1, 0, "a", 0.0, 1.0), (1, 1, "a", 1.5, 2.0), (1, 2, "b", 3.0, 4.0)], "chapter_idx int, pos int, fragment string, clip_begin double, clip_end double")
    pars = timing.merge_pars(placed)
    assert rows(pars.select("par_idx", "fragment", "clip_begin", "clip_end"), "par_idx") == [(0, "a", 0.0, 3.0), (1, "b", 3.0, 4.0)]
    assert timing.smil(pars, F.lit("d"), F.lit("a")).first().smil.count("<par ") == 2


def test_audio(spark):
    tone = [0.3 if i % 2 else -0.3 for i in range(200)]
    tone[0] = tone[-1] = 0.0
    takes = {"silent": [0.0] * 50, "click": [0.8, *[0.0] * 5, *tone[1:]], "truncated": [*tone[:-1], -0.6], "clipping": [0.0, *[1.0] * 20, *[0.01] * 2000, 0.0], "grazes": [0.0, *([1.0] * 4 + [0.01] * 200) * 5, 0.0], "empty": []}
    df = spark.createDataFrame(list(takes.items()), "id string, samples array<double>")
    found = {r.id: r.c for r in audio.metrics(df).select("id", audio.categories().alias("c")).collect()}
    assert found["silent"] == ["silent"] and found["empty"] == ["silent"]
    assert "click" in found["click"] and "truncated" in found["truncated"]
    assert found["clipping"] == ["clipping"] and "clipping" not in found["grazes"]
    runs = spark.createDataFrame([([],), ([0.0, 0.0],), ([1.0] * 5,), ([1.0, 0.0, 1.0, 1.0],)], "a array<double>")
    assert [r.n for r in runs.select(audio.longest_run(F.col("a"), 0.5).alias("n")).collect()] == [0, 0, 5, 2]


def test_speakers(spark):
    members = spark.createDataFrame([("Countess Mary", ["Mary", "the countess"], 0), ("Marydale", None, 1), ("Old Tom", ["Tom"], 2)], "name string, aliases array<string>, ordinal long")
    asked = ["Mary", "TOM.", "the  countess", "Old Tom", "Tommy", "dale", "Extra Male", "mary the elder", "stranger"]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(asked)], "i int, speaker string")
    found = {r.speaker: (r.resolved, r.problem and r.problem.split(":")[0]) for r in cast.resolve_speakers(df, members).collect()}
    assert found["Mary"] == ("Mary", None) and found["TOM."] == ("Tom", None) and found["the  countess"] == ("Mary", None)
    assert found["dale"] == ("Marydale", None) and found["Extra Male"] == ("Extra Male", None) and found["stranger"] == (None, "unknown")
    assert found["mary the elder"] == ("Mary", None)
    merges = spark.createDataFrame([("Old Tom", "Marydale"), ("Countess Mary", "Old Tom"), ("Nobody", "Old Tom")], "into string, source string")
    found = {r.name: r for r in cast.fold_merges(members, merges).collect()}
    assert {r.survivor for r in found.values()} == {"Countess Mary"}
    assert found["Countess Mary"].aliases == ["Mary", "Marydale", "Old Tom", "Tom", "the countess"] and found["Old Tom"].aliases is None


def test_merge_chains_cycles_and_books(spark):
    """Chains of any length, in either order, cycles, aliases and unknown names; books do not see each other."""
    names = [f"m{k}" for k in range(40)]
    cast_rows = [(1, n, [f"also {n}"], k) for k, n in enumerate(names)] + [(2, "m0", None, 0), (2, "m1", ["x"], 1), (3, "a", ["b"], 0), (3, "c", None, 1), (4, "only", None, 0)]
    members = spark.createDataFrame(cast_rows, "book_id int, name string, aliases array<string>, ordinal long")
    merges = [(1, f"m{k + 1}", f"m{k}", k) for k in range(12)] + [(1, f"m{k + 1}", f"ALSO m{k}", 100 - k) for k in range(20, 38)]
    merges += [(2, "m1", "m0", 0), (2, "m0", "m1", 1), (2, "m1", "nobody", 2), (2, None, "m0", 3), (3, "B", "c", 0)]
    found = {(r.book_id, r.name): r for r in cast.fold_merges(members, spark.createDataFrame(merges, "book_id int, into string, source string, ordinal long")).collect()}
    assert len(found) == len(cast_rows)
    assert {found[1, f"m{k}"].survivor for k in range(13)} == {"m12"} and {found[1, f"m{k}"].survivor for k in range(20, 39)} == {"m38"} and found[1, "m15"].survivor == "m15"
    assert set(found[1, "m12"].aliases) == {f"m{k}" for k in range(12)} | {f"also m{k}" for k in range(13)}
    # the first merge of a cycle stands
    assert found[2, "m0"].survivor == found[2, "m1"].survivor == "m1" and found[2, "m1"].aliases == ["m0", "x"]
    assert found[3, "c"].survivor == "a" and found[3, "a"].aliases == ["b", "c"] and found[4, "only"].survivor == "only"


def test_books_do_not_share_casts(spark):
    members = spark.createDataFrame([(1, "Anna", ["Ann"], 0), (2, "Annabel", None, 0)], "book_id int, name string, aliases array<string>, ordinal long")
    asked = spark.createDataFrame([(1, "annabel lee"), (2, "annabel lee"), (2, "Ann"), (3, "Anna"), (3, "Narrator"), (1, None)], "book_id int, speaker string")
    found = {(r.book_id, r.speaker): (r.resolved, r.problem) for r in cast.resolve_speakers(asked, members).collect()}
    assert found[1, "annabel lee"][0] == "Ann" and found[2, "annabel lee"][0] == "Annabel" and found[2, "Ann"][0] == "Annabel"
    assert found[3, "Anna"] == (None, "unknown") and found[3, "Narrator"] == ("Narrator", None)
    incoming = spark.createDataFrame([(1, 1, "ann", None), (2, 2, "ann", None)], "book_id int, id int, name string, aliases array<string>")
    assert {r.book_id: r.matched for r in cast.find_existing(incoming, members).collect()} == {1: "Anna", 2: None}


def test_upsert(spark):
    have = spark.createDataFrame([("Ann", "d", "v", "", ["A"]), ("Bob", "d", "v", "own", None)], "name string, description string, voice string, audition_line string, aliases array<string>")
    new = spark.createDataFrame([("ann", "new", "", "line", ["she", "Annie", "Bob"]), ("Cy", "c", "v", "l", None), ("BOB", "", "", "other", None)], have.schema)
    found = {r.name: (r.description, r.audition_line, r.aliases, r.outcome) for r in cast.upsert(have, new).collect()}
    assert found["Ann"] == ("new", "line", ["A", "Annie"], "updated")
    assert found["Bob"] == ("d", "own", [], "unchanged") and found["Cy"][3] == "added"


def test_upsert_by_alias(spark):
    have = spark.createDataFrame([("Ann", "d", "v", "", ["Annie"])], "name string, description string, voice string, audition_line string, aliases array<string>")
    new = spark.createDataFrame([("annie", "new", "", "", ["Nan"])], have.schema)
    (r,) = cast.upsert(have, new).collect()
    assert (r.name, r.description, r.aliases, r.outcome, r.audition_line) == ("Ann", "new", ["Annie", "Nan"], "updated", "")


def plain_fold(rows):
    """Every segment's home in its run: the next one with words, else the last one with words, else the run's end."""
    out = []
    for speaker, run in itertools.groupby(rows, lambda r: r[0]):
        texts = [t or "" for _, t in run]
        worded = [k for k, t in enumerate(texts) if any(map(str.isalnum, t))]
        home = [next((w for w in worded if w >= k), worded[-1] if worded else len(texts) - 1) for k in range(len(texts))]
        out += [(speaker, "".join(t for t, at in zip(texts, home) if at == h)) for h in sorted(set(home))]
    return out


def test_wordless_folding_by_brute_force(spark):
    r = random.Random(5)
    chapters = {c: [(r.choice(["a", "b", None]), r.choice(["word", "—", "“", None, "", "x1"])) for _ in range(r.randint(1, 12))] for c in range(150)}
    rows = [(c, k, s, t) for c, own in chapters.items() for k, (s, t) in enumerate(own)]
    found = script.fold_wordless(spark.createDataFrame(rows, "chapter_idx int, seg_idx int, speaker string, text string")).orderBy("chapter_idx", "seg_idx").collect()
    by = {c: [(x.speaker, x.text) for x in found if x.chapter_idx == c] for c in chapters}
    assert by == {c: plain_fold(own) for c, own in chapters.items()}


def test_islands_keep_the_first_instruction(spark):
    s = spark.createDataFrame([(1, 0, "a", "One", "sad"), (1, 1, "a", "two", "happy"), (1, 2, "b", "x", None)], "chapter_idx int, seg_idx int, speaker string, text string, instruction string")
    assert [(r.text, r.instruction) for r in script.speaker_islands(s).orderBy("seg_idx").collect()] == [("One two", "sad"), ("x", None)]


def test_wordless_folding(spark):
    s = spark.createDataFrame([(1, 0, "a", "One,"), (1, 1, "b", "noted,"), (1, 2, "a", "“"), (1, 3, "a", "that."), (1, 4, "a", "”"), (1, 5, "b", "—")], "chapter_idx int, seg_idx int, speaker string, text string")
    assert [r.text for r in script.fold_wordless(s).orderBy("seg_idx").collect()] == ["One,", "noted,", "“that.”", "—"]


def test_incremental(spark):
    t = spark.createDataFrame([("h", 2, 0), ("h", 1, 5), ("g", 3, 1), ("c", 1, 1)], "hash string, chapter_idx int, pos int")
    cached = spark.createDataFrame([("c",)], "hash string")
    assert rows(incremental.pending_tasks(t, cached, ["chapter_idx", "pos"]).select("hash", "chapter_idx", "pos"), "hash") == [("g", 3, 1), ("h", 1, 5)]
    ch = spark.createDataFrame([(1, 1, 0), (1, 2, 0), (1, 3, 1), (1, 4, 0), (2, 1, 0)], "book_id int, chapter_idx int, n_pending int")
    assert rows(incremental.ready_prefix(ch).select("book_id", "chapter_idx"), "book_id", "chapter_idx") == [(1, 1), (1, 2), (2, 1)]
    s = spark.createDataFrame([(1, 0, "a", "x"), (2, 0, "a", "y"), (3, 0, "a", None), (4, 0, "a", None)], "chapter_idx int, pos int, hash string, sha string")
    f = {r.chapter_idx: r.fingerprint for r in incremental.chapter_fingerprint(s).collect()}
    assert len({f[1], f[2], f[3]}) == 3 and f[3] == f[4]


@pytest.mark.parametrize(
    "content, value",
    [
        ('{"a": 1}', {"a": 1}),
        ('"just a text"', "just a text"),
        ('{"segments": [{"speaker": "A", "text": "' + "long \\" + '"' + "words " * 5000 + '"}]}', {"segments": [{"speaker": "A", "text": 'long "' + "words " * 5000}]}),
        ('```json\n[1, 2,]\n```', [1, 2]),
        ('<think>hm</think>{"a": [1,]} and more', {"a": [1]}),
        ('{"a": "open\n"b": 2}', {"a": "open", "b": 2}),
    ],
)
def test_replies(spark, content, value):
    import json

    r = spark.createDataFrame([(1, content)], "id int, content string")
    found = replies.parsed_replies(r, "id", "content").collect()[0]
    assert json.loads(found.json) == value and found.problem is None
    assert replies.broken_replies(r, "id", "content").collect() == []


def test_broken_reply(spark):
    r = spark.createDataFrame([(1, "no json"), (2, "[1]"), (3, None)], "id int, content string")
    found = {x.id: (x.json, x.problem is None) for x in replies.parsed_replies(r, "id", "content").collect()}
    assert found == {1: (None, False), 2: ("[1]", True), 3: (None, False)}
    r = spark.createDataFrame([(1, '{"a": 1,\n"b": oops, "c": 2}'), (2, "[1]")], "id int, content string")
    (bad,) = replies.broken_replies(r, "id", "content").collect()
    text, mark = bad.shown.split("\n")
    assert (bad.id, bad.line) == (1, 2) and text[mark.index("^") :].startswith("oops") and '\\n"b"' in text


def test_generation_loop(spark):
    tasks = spark.createDataFrame([("h1", "some words", "v", 0), ("h2", "x", "v", 0)], "hash string, text string, voice string, seed int")
    made = generation.synthesize(tasks, lambda: generation.tone_voice(800))
    assert made.count() == 2
    always = lambda df: df.select("hash", F.array(F.lit(1.0)).alias("samples"))
    with pytest.raises(RuntimeError):
        generation.until_clean(tasks, always, F.lit(True), lambda df: df.persist(), attempts=2)
    assert generation.until_clean(tasks, always, F.lit(False), lambda df: df.persist()).count() == 2
    assert generation.pcm_samples(generation.pcm_bytes([0.0, 0.5, -1.0])) == [0.0, 0.5, -1.0]


def test_epub_source(spark, tmp_path):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("mimetype", "application/epub+zip")
        z.writestr("META-INF/container.xml", '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OPS/p.opf"/></rootfiles></container>')
        z.writestr("OPS/p.opf", '<package xmlns="http://www.idpf.org/2007/opf" xmlns:dc="http://purl.org/dc/elements/1.1/"><metadata><dc:title>Book</dc:title></metadata><manifest><item id="a" href="a%20b.xhtml"/><item id="s" href="s.xhtml"/></manifest><spine><itemref idref="s"/><itemref idref="a"/></spine></package>')
        z.writestr("OPS/a b.xhtml", "<html><body><h1>One</h1><p>" + "word " * 60 + "</p></body></html>")
        z.writestr("OPS/s.xhtml", "<p>too short</p>")
    (tmp_path / "b.epub").write_bytes(out.getvalue())
    (tmp_path / "broken.epub").write_bytes(b"no archive")
    (tmp_path / "short.epub").write_bytes(out.getvalue()[:200])
    broken = {r.path.rpartition("/")[2]: r for r in epub.read_books(spark, str(tmp_path)).where("problem is not null").collect()}
    assert set(broken) == {"broken.epub", "short.epub"} and all(b.title is None and b.sha256 for b in broken.values())
    (r,) = epub.read_books(spark, str(tmp_path)).where("problem is null").collect()
    assert (r.title, r.author, r.language, r.chapter_idx, r.chapter_title) == ("Book", "Unknown", "en", 1, "One")
    copy = epub.with_parts(out.getvalue(), {"OPS/s.xhtml": b"new"}, {"OPS/x": b"added"})
    with zipfile.ZipFile(io.BytesIO(copy)) as z:
        assert z.namelist()[0] == "mimetype" and z.read("OPS/s.xhtml") == b"new" and z.read("OPS/x") == b"added"
    samples, rate = epub.wav_samples(epub.wav_bytes([0.0, 0.25, -0.25], 8000))
    assert rate == 8000 and samples == pytest.approx([0.0, 0.25, -0.25], abs=1e-4)


def test_overlay_placement():
    from xml.etree import ElementTree as ET

    from lectern.operators import overlay

    root = ET.fromstring('<html><head/><body><p id="lv0">It was late.  The road <i>lay</i> empty.</p><div>Loose <p>Nobody came. Nobody went.</p></div></body></html>')
    source = overlay.text_of(overlay.paragraphs(root))
    places = [(source.index(a), source.index(b) + len(b)) for a, b in (("It", "late"), ("The", "empty"), ("Loose", "came"), ("Nobody went", "went"))]
    placed = overlay.place_chunks(root, [*places, None])
    assert placed[0] == [("lv1", 0.0, 1.0)] and placed[1] == [("lv0", 0.0, 1.0)]
    assert len(placed[2]) == 2 and placed[2][0][1] == 0.0 and placed[2][-1][2] == 1.0 and placed[4] == []
    spans = {e.get("id"): e.text for e in root.iter() if e.tag == "span"}
    assert spans["lv1"] == "It was late" and spans[placed[3][0][0]] == "Nobody went"
    assert "".join("".join(root.itertext()).split()) == "Itwaslate.Theroadlayempty.LooseNobodycame.Nobodywent."
    assert overlay.with_highlight(root) and not overlay.with_highlight(ET.fromstring("<body/>"))


def test_overlay_of_broken_documents(spark):
    from lectern.operators import overlay

    rows = [(1, "<p>It was late.</p>", ["It was late.", None]), (2, "<p>open", ["x"]), (3, None, ["x"]), (4, "<p>a</p>", None)]
    found = overlay.placements(spark.createDataFrame(rows, "chapter_idx long, xhtml string, chunks array<string>")).collect()
    assert {(r.chapter_idx, r.chunk_idx, r.problem is None) for r in found} == {(1, 0, True), (2, None, False), (3, None, False)}


def test_overlay_by_brute_force():
    """Spans hold the text that was asked for, the rest of the document says what it said, and shares are those of a count of characters."""
    from xml.etree import ElementTree as ET

    from lectern.operators import overlay

    r = random.Random(9)
    words = "late road empty rain fell nobody came lay the and".split()
    for _ in range(200):
        body = "".join(f"<{t}>" + "".join(r.choice([r.choice(words) + r.choice([" ", "  ", "\n", ". "]), f"<i>{r.choice(words)}</i>"]) for _ in range(r.randint(0, 9))) + f"</{t}>" for t in [r.choice(["p", "div", "li"]) for _ in range(r.randint(1, 5))])
        root = ET.fromstring(f"<html><body>{body}</body></html>")
        whole = "".join("".join(root.itertext()).split())
        found = overlay.paragraphs(root)
        assert [p.text for p in found] == [t for e in root.iter() if e.tag in ("p", "div", "li") for t in [" ".join("".join(e.itertext()).split())] if t]
        source = "\n\n".join(p.text for p in found)
        cuts = sorted(r.randint(0, len(source)) for _ in range(4)) if source else []
        chunks = [source[a:b] for a, b in zip(cuts, cuts[1:])]
        placed = overlay.place_chunks(root, list(zip(cuts, cuts[1:])))
        assert "".join("".join(root.itertext()).split()) == whole and len({e.get("id") for e in root.iter() if e.get("id")}) == sum(e.get("id") is not None for e in root.iter())
        for chunk, places in zip(chunks, placed):
            for (_, _, high), (_, low, _) in zip(places, places[1:]):
                assert high == low
            assert not places or (places[0][1] == 0.0 and places[-1][2] == 1.0)
            spans = [e for e in root.iter("span") if places and e.get("id") == places[0][0]]
            assert not spans or " ".join(spans[0].text.split()) in " ".join(chunk.split())
    starts, ends = [0, 10, 25], [8, 20, 30]
    for a in range(32):
        for b in range(a + 1, 33):
            inside = [sum(a <= k < b for k in range(s, e)) for s, e in zip(starts, ends)]
            total = sum(inside)
            expected = [(k, sum(inside[:k]) / total, sum(inside[: k + 1]) / total) for k in range(3) if inside[k]]
            assert overlay.shares(ends, starts, a, b) == expected


def test_short_needles(spark):
    needles = spark.createDataFrame([(1, "the road lay empty"), (2, "Rain fell"), (3, "late"), (4, None), (5, "..."), (6, "one two three four five"), (6, "one two three four five")], "item_id int, text string")
    sources = spark.createDataFrame([(1, "the road lay quiet; rain fell late"), (1, "the road lay quiet; rain fell late"), (2, "zero one two three four"), (3, None), (4, "")], "doc_id int, text string")
    found = {(r.item_id, r.doc_id): (r.size, r.needle_at, r.source_at) for r in alignment.longest_shared_runs(needles, sources, "item_id", "doc_id").collect()}
    assert found == {(1, 1): (3, 0, 0), (2, 1): (2, 0, 4), (3, 1): (1, 0, 6), (6, 2): (4, 0, 1)}
    for (i, d), (size, at, _) in found.items():
        needle, source = (t.where(f"{k} = {v}").first().text for t, k, v in ((needles, "item_id", i), (sources, "doc_id", d)))
        assert needle and source
    assert alignment.longest_shared_runs(needles.where("item_id > 3 and item_id < 6"), sources, "item_id", "doc_id").collect() == []


def test_running_starts_of_large_groups(spark):
    df = spark.range(5000).select((F.col("id") % 3).alias("g"), F.col("id").alias("k"), (F.col("id") % 7).alias("size"))
    found = {r.k: r.start for r in timing.with_running_start(df, "start", F.col("size"), 2, "g", "k", 64).collect()}
    sums = {0: 0, 1: 0, 2: 0}
    for k in range(5000):
        assert found[k] == sums[k % 3]
        sums[k % 3] += k % 7 + 2


def test_conversations(spark, tmp_path):
    """Replies that are empty, broken or wrong are answered; rows end on their own."""
    saved = []

    def save(df):
        saved.append(str(tmp_path / f"round{len(saved)}"))
        df.write.parquet(saved[-1])
        return spark.read.parquet(saved[-1])

    def make():
        def write(talks):
            # what a row gets in each round, by the first prompt
            script = {"stays": ["", "no json", '{"b": 1}', '{"a": 0}', '{"a": 5}'], "quick": ['{"a": 1}'], "": ["never"] * 9}
            return [script[talk[1][1]][len(talk) // 2 - 1] for talk in talks]

        return write

    def problems(json):
        a = F.get_json_object(json, "$.a").cast("int")
        return F.when(a.isNull(), F.array(F.lit("'a' is missing"))).when(a <= 0, F.array(F.lit("'a' must be positive")))

    rows = spark.createDataFrame([(1, "s", "stays"), (2, None, "quick"), (3, None, None)], "id int, system string, prompt string")
    done = {r.id: r for r in generation.converse(rows, "id", make, problems, save, attempts=5).collect()}
    assert (done[1].json, done[1].n_attempts, done[1].problem) == ('{"a":5}', 5, None)
    assert (done[2].json, done[2].n_attempts) == ('{"a":1}', 1)
    assert done[3].json is None and done[3].n_attempts == 5 and done[3].problem.startswith("no JSON: never")
    talk = [m.content for m in spark.read.parquet(saved[4]).where("id = 1").first().talk]
    assert talk[:2] == ["s", "stays"] and len(talk) == 10 and "no content" in talk[3] and "'a' is missing" in talk[7] and "must be positive" in talk[9]
    assert generation.converse(rows.limit(0), "id", make, problems, save).collect() == []


def test_voices(spark):
    calls, gone = [], {"first"}

    def register(audio, text):
        calls.append((audio, text))
        return f"v{len(calls)}"

    def say(text, voice, seed):
        if "first" in gone and text == "again":
            gone.clear()
            raise generation.UnknownVoice(voice)
        return [float(len(text)), float(voice[1:])]

    speak = generation.cloned_voice(register, say)
    assert speak([("one", "a", "t", 0), ("two", "a", "t", 0), ("x", "b", "t", 0)]) == [[3.0, 1.0], [3.0, 1.0], [1.0, 2.0]]
    assert speak([("again", "a", "t", 0), ("again", "a", "t", 0)]) == [[5.0, 3.0], [5.0, 3.0]] and len(calls) == 3
    tasks = spark.createDataFrame([("h1", "one", "a", "t", 0), ("h2", None, None, None, 0)], "hash string, text string, ref_audio string, ref_text string, seed int")
    assert {r.hash: r.samples for r in generation.clone(tasks, lambda: lambda rows: [[float(len(t))] for t, _, _, _ in rows]).collect()} == {"h1": [3.0], "h2": [0.0]}
    long = spark.createDataFrame([("h1", "One two. " * 200, "v", 0), ("h2", " ", "v", 0)], "hash string, text string, voice string, seed int")
    found = {r.hash: r.samples for r in generation.synthesize_long(long, lambda: lambda rows: [[1.0] * len(t) for t, _, _ in rows], rate=10, pause_ms=500).collect()}
    pieces = [r.chunk for r in chunking.sentence_chunks(long, "hash", "text").collect()]
    assert found["h2"] == [] and sum(found["h1"]) == sum(map(len, pieces)) and len(found["h1"]) == sum(map(len, pieces)) + 5 * (len(pieces) - 1)
    assert generation.engine({})([("text", "v", 1)]) and generation.engine({"engine": "tone", "rate": 800})
    with pytest.raises(ValueError, match="unknown engine"):
        generation.engine({"engine": "x"})


def test_work_folders(spark, tmp_path):
    """Files out and in again; missing and broken ones; unchanged ones stay untouched."""
    from lectern.sources import workdir

    root = str(tmp_path / "voices")
    assert workdir.load_voices(spark, f"{root}/*/*").collect() == [] and workdir.load_scripts(spark, str(tmp_path / "none")).collect() == []
    voices = spark.createDataFrame([("a", "Ann", "v1"), ("a", "Bob", "v2"), ("b", "Cy", None)], "book_id string, name string, voice string")
    files = workdir.map_files(voices, "book_id", "name", "voice")
    workdir.write_files(files, root, ["book_id"])
    found = workdir.load_voices(spark, f"{root}/*/*.txt")
    assert sorted((r.name, r.voice_id) for r in found.collect()) == [("Ann", "v1"), ("Bob", "v2"), ("Cy", None)]
    before = {p: p.stat().st_mtime_ns for p in tmp_path.rglob("*.txt")}
    fresh = workdir.map_files(voices.where("book_id = 'b'").withColumn("voice", F.lit("v3")).unionByName(voices.where("book_id = 'a'")), "book_id", "name", "voice")
    changed = workdir.changed_files(fresh, files, "book_id")
    assert [r.book_id for r in changed.collect()] == ["b"]
    workdir.write_files(changed, root, ["book_id"])
    after = {p: p.stat().st_mtime_ns for p in tmp_path.rglob("*.txt")}
    assert sum(before.get(p) == t for p, t in after.items()) == 1 and {r.voice_id for r in workdir.load_voices(spark, f"{root}/*/*.txt").collect()} == {"v1", "v2", "v3"}
    (tmp_path / "broken.json").write_text("{")
    for load in (workdir.load_scripts, workdir.load_cast, workdir.load_voices, workdir.load_state, workdir.load_audit, workdir.load_chunks):
        assert load(spark, str(tmp_path / "broken.json")).collect() == []


def plain_words(page):
    """Words of a page once comments, skipped elements and tags are cut out by patterns."""
    import html as entities
    import re

    from lectern.functions.constants import SKIP_TAGS

    page = re.sub(r"(?is)<!--.*?-->|<!doctype[^>]*>", "", page)
    for tag in SKIP_TAGS:
        page = re.sub(rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", "", page)
    page = re.sub(r"(?i)<(?:meta|link)\b[^>]*>|</?(?:b|i|em|strong|span|a|u|small|sub|sup|code)\b[^>]*>", "", page)
    return entities.unescape(re.sub(r"<[^>]+>", " ", page)).split()


def test_paragraphs_hold_every_word_once(spark):
    """On real pages with unclosed tags, entities, comments and skipped parts the paragraphs say what the page says, in its order."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    found = {r.page_id: [] for r in pages.collect()}
    for r in html.extract_paragraphs(pages, "page_id", "html").collect():
        found[r.page_id].append((r.tag_idx, r.text))
    for page in pages.collect():
        assert " ".join(text for _, text in sorted(found[page.page_id])).split() == plain_words(page.html), page.page_id


def test_nulls_and_repeats_in_increments_and_timing(spark):
    from lectern.operators import bookkeeping, catalog, reviews

    current = spark.createDataFrame([(1, "h"), (None, "h"), (2, None), (3, "x"), (3, "x")], "key int, hash string")
    state = spark.createDataFrame([(1, "h", True), (None, "h", True), (2, None, True), (3, "x", None)], "key int, hash string, done boolean")
    assert sorted(map(repr, (r.key for r in incremental.stale(current, state).collect()))) == ["2", "3", "3", "None"]
    tasks = spark.createDataFrame([(None, 1), (None, 2), ("a", 3), ("a", 0)], "hash string, pos int")
    cached = spark.createDataFrame([(None,)], "hash string")
    assert sorted((repr(r.hash), r.pos) for r in incremental.pending_tasks(tasks, cached, ["pos"]).collect()) == [("'a'", 0), ("None", 1)]
    chapters = spark.createDataFrame([(1, 1, None), (1, 2, 1), (1, 3, 0)], "book_id int, chapter_idx int, n_pending int")
    assert [r.chapter_idx for r in incremental.ready_prefix(chapters).collect()] == [1]
    timed = timing.timing_manifest(spark.createDataFrame([(1, 0, 1.0), (1, 1, None), (1, 2, 2.0)], "chapter_idx int, seg_idx int, duration_s double"), 500)
    assert rows(timed.select("seg_idx", "start_s", "end_s"), "seg_idx") == [(0, 0.0, 1.0), (1, 1.5, None), (2, 1.5, 3.5)]
    models = spark.createDataFrame([(None,), ("Other",), ("my-Qwen-2",)], "model string")
    assert {r.model: r.voices for r in catalog.known_voices(models, {"qwen": ["a"]}).collect()} == {None: [], "Other": [], "my-Qwen-2": ["a"]}
    meta = spark.createDataFrame([(1, None), (2, "no json")], "book_id int, content string")
    assert catalog.metadata_rows(meta, "content").collect() == []
    assert [r.chapter for r in spark.createDataFrame([("x_1",), ("07_a",), (None,)], "n string").select(catalog.chapter_number(F.col("n")).alias("chapter")).collect()] == [None, 7, None]
    replies_ = spark.createDataFrame([(1, None), (2, "[]"), (3, "3")], "id int, json string")
    assert [(r.id, r.kind) for r in reviews.review_rows(replies_, "id").collect()] == [(3, "problem")]
    assert bookkeeping.partial_state(state).select("key").collect()[0].key == 3
    words = spark.createDataFrame([(1, None), (2, ""), (3, "¿Él, o_k?")], "id int, text string")
    assert rows(bookkeeping.word_rows(words, "id"), "word_idx") == [(3, 0, "él", 1, 3), (3, 1, "o_k", 5, 8)]
    empty = spark.createDataFrame([], "book_id int, ordinal int, name string, aliases array<string>, description string, voice string")
    assert bookkeeping.cast_problems(empty).collect() == [] and reviews.cast_list(empty, "book_id").collect() == []
