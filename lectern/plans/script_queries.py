"""Cast, script and incremental queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.constants import ALIAS_STOPWORDS, EMOTIONS
from lectern.operators import cast, incremental, script
from lectern.plans.common import SEGMENTS_SQL, segments, table


def _cast(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation")
    return n.select(F.col("n_name").alias("name"), F.array(F.substring("n_name", 1, 4), F.concat(F.lit("the "), F.col("n_name"))).alias("aliases"), F.col("n_nationkey").cast("long").alias("ordinal"))


CAST_SQL = "members AS (SELECT n_name AS name, [substr(n_name, 1, 4), 'the ' || n_name] AS aliases, n_nationkey::BIGINT AS ordinal FROM nation)"
_NORM = lambda x: f"lower(trim(regexp_replace(regexp_replace(trim({x}), '[.,;:]+$', ''), '\\s+', ' ', 'g')))"


def _spoken(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    forms = F.array(F.lower("n_name"), F.concat(F.lit("THE  "), "n_name", F.lit(".")), F.concat("n_name", F.lit(" and son")), F.substring("n_name", 1, 2), F.lit("nobody at all"), F.substring("n_name", 1, 4))
    return table(spark, d, "customer").join(n, "c_nationkey").select(F.col("c_custkey").alias("seg_id"), F.element_at(forms, (F.col("c_custkey") % 6 + 1).cast("int")).alias("speaker"))


SPOKEN_SQL = "spoken AS (SELECT c_custkey AS seg_id, [lower(n_name), 'THE  ' || n_name || '.', n_name || ' and son', substr(n_name, 1, 2), 'nobody at all', substr(n_name, 1, 4)][c_custkey % 6 + 1] AS speaker FROM customer JOIN nation ON c_nationkey = n_nationkey)"
RESOLVED_SQL = f"""{CAST_SQL}, {SPOKEN_SQL},
forms AS (SELECT ordinal, display, unnest(list_concat([name], aliases)) AS label, generate_subscripts(list_concat([name], aliases), 1) AS place FROM (SELECT *, list_filter(list_concat([name], aliases), lambda x: length(x) = list_min(list_transform(list_filter(list_concat([name], aliases), lambda z: length(z) >= 2), lambda y: length(y))))[1] AS display FROM members)),
every AS (SELECT ordinal, place, {_NORM('label')} AS norm, display FROM forms UNION ALL SELECT -1, 0, lower(x), x FROM (SELECT unnest(['Narrator', 'Extra Female', 'Extra Male', 'Retained', 'Unvoiced', 'Silent']) AS x)),
idx AS (SELECT norm, arg_min(display, (ordinal, place)) AS display FROM every GROUP BY norm),
sp AS (SELECT DISTINCT speaker, {_NORM('speaker')} AS norm FROM spoken),
loose AS (SELECT speaker, list_sort(list_distinct(list(display))) AS members FROM sp JOIN every ON ordinal >= 0 AND (contains(sp.norm, every.norm) OR contains(every.norm, sp.norm)) GROUP BY speaker),
found AS (SELECT sp.speaker, CASE WHEN sp.speaker IN (SELECT display FROM idx) THEN sp.speaker ELSE idx.display END AS known, coalesce(members, []) AS members FROM sp LEFT JOIN idx USING (norm) LEFT JOIN loose ON loose.speaker = sp.speaker),
resolved AS (SELECT speaker, CASE WHEN known IS NOT NULL THEN known WHEN len(members) = 1 THEN members[1] END AS resolved, CASE WHEN known IS NOT NULL OR len(members) = 1 THEN NULL WHEN len(members) > 1 THEN 'ambiguous: ' || array_to_string(members, ', ') ELSE 'unknown' END AS problem FROM found)"""


def resolve_speakers(spark: SparkSession, d: str) -> DataFrame:
    return cast.resolve_speakers(_spoken(spark, d), _cast(spark, d)).select("seg_id", "speaker", "resolved", "problem")


def group_errors(spark: SparkSession, d: str) -> DataFrame:
    r = resolve_speakers(spark, d).where("problem is not null").select(F.concat("speaker", F.lit(": "), "problem").alias("message"), "seg_id")
    return cast.grouped_errors(r, "message", "seg_id")


def usable_aliases(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select("c_custkey", "c_name", F.array("c_name", F.lit(" She. "), F.lit("the one"), F.lit("..."), F.col("c_mktsegment"), F.lit("Everyone;")).alias("a"))
    return c.select("c_custkey", F.array_join(cast.usable_aliases(F.col("a"), F.col("c_name")), "|").alias("kept"))


def find_existing(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    forms = F.array(F.lower("n_name"), F.concat(F.lit("The "), "n_name"), F.lit("stranger"), F.lit("visitor"))
    incoming = s.select(F.col("s_suppkey").alias("id"), F.element_at(forms, (F.col("s_suppkey") % 4 + 1).cast("int")).alias("name"), F.when(F.col("s_suppkey") % 4 == 2, F.array(F.lit("x"), F.substring("n_name", 1, 4))).alias("aliases"))
    return cast.find_existing(incoming, _cast(spark, d))


def cast_upsert(spark: SparkSession, d: str) -> DataFrame:
    c = _cast(spark, d).select("name", F.concat(F.lit("from "), "name").alias("description"), F.lit("low").alias("voice"), F.when(F.col("ordinal") % 2 == 0, "a line").otherwise("").alias("audition_line"), "aliases")
    new = table(spark, d, "nation").where("n_nationkey % 3 = 0").select(F.lower("n_name").alias("name"), F.when(F.col("n_nationkey") % 2 == 0, "new").otherwise("").alias("description"), F.lit("").alias("voice"), F.lit("said").alias("audition_line"), F.array(F.lit("she"), F.concat(F.lit("old "), "n_name"), F.lit("the FRANCE")).alias("aliases"))
    return cast.upsert(c, new).select("name", "description", "voice", "audition_line", F.array_join("aliases", "|").alias("aliases"), "outcome")


def _batches(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Nations as casts of their regions, and three batches of suppliers that come to them: under their names, under titles that several claim, and as strangers."""
    n = table(spark, d, "nation")
    k = F.col("n_nationkey")
    own = n.select(F.col("n_regionkey").alias("book_id"), k.cast("long").alias("ordinal"), F.col("n_name").alias("name"), F.concat(F.lit("from "), "n_name").alias("description"), F.when(k % 2 == 0, "low").otherwise("").alias("voice"), F.when(k % 3 == 0, "a line").otherwise("").alias("audition_line"), F.when(k % 4 != 3, F.array(F.lower("n_name"), F.lit("she"), F.concat(F.lit("title "), (k % 3).cast("string")))).alias("aliases"))
    s = F.col("s_suppkey")
    rows = table(spark, d, "supplier").join(n, F.col("s_nationkey") == k)
    title = lambda m: F.concat(F.lit("title "), (s % m).cast("string"))
    name = F.when(s % 5 == 0, F.col("n_name")).when(s % 5 == 1, F.lower("n_name")).when(s % 5 == 2, title(9)).when(s % 5 == 3, F.col("s_name")).otherwise(F.concat(F.lit("Old "), "n_name"))
    aliases = F.when(s % 4 != 1, F.array(title(11), F.concat(F.lit("Old "), "n_name"), F.lit("They"), F.concat(F.lit("guest "), (s % 13).cast("string"))))
    asked = rows.select(F.col("n_regionkey").alias("book_id"), (s % 3).cast("long").alias("batch"), s.cast("long").alias("ordinal"), name.alias("name"), F.when(s % 2 == 0, F.concat(F.lit("d"), (s % 4).cast("string"))).otherwise("").alias("description"), F.when(s % 7 == 0, F.concat(F.lit("v"), (s % 2).cast("string"))).alias("voice"), F.when(s % 6 == 0, F.concat(F.lit("said "), s.cast("string"))).alias("audition_line"), aliases.alias("aliases"))
    return own, asked


def cast_batches(spark: SparkSession, d: str) -> DataFrame:
    found = cast.upsert_batches(*_batches(spark, d))
    return found.withColumn("aliases", F.array_join("aliases", "|"))


def batch_outcomes(spark: SparkSession, d: str) -> DataFrame:
    found = cast.batch_outcomes(*_batches(spark, d))
    return found.withColumn("rejected", F.array_join("rejected", "|"))


def cast_merge(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation")
    nxt = n.select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("into"))
    merges = n.where("n_nationkey % 5 <> 4").join(nxt, F.col("n_nationkey") + 1 == F.col("k")).select("into", F.col("n_name").alias("source"))
    found = cast.fold_merges(_cast(spark, d), merges)
    return found.select("name", "survivor", F.array_join("aliases", "|").alias("aliases"))


def emote_tasks(spark: SparkSession, d: str) -> DataFrame:
    return cast.emote_tasks(_cast(spark, d)).select("name", F.col("emotion_idx").cast("long").alias("emotion_idx"), "emotion", incremental.content_hash(F.col("name"), F.col("emotion")).alias("hash"))


def round_robin_voices(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select("c_nationkey", F.col("c_custkey").alias("ordinal"), F.when(F.col("c_custkey") % 11 == 0, "Narrator").otherwise(F.col("c_name")).alias("name"), F.when(F.col("c_custkey") % 7 == 0, "kept").alias("had"))
    return cast.round_robin(c, ["v0", "v1", "v2", "v3"], "c_nationkey", "had").select("c_nationkey", "ordinal", "voice")


def voice_references(spark: SparkSession, d: str) -> DataFrame:
    """The reference of a supplier's voice: its own text, else that of its nation, else the shared line."""
    s, n = table(spark, d, "supplier"), table(spark, d, "nation")
    own = s.where("s_suppkey % 3 = 0").select(F.col("s_suppkey").alias("k"), F.concat(F.lit("own "), "s_name").alias("own"))
    shared = n.where("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("k2"), F.concat(F.lit("nation "), "n_name").alias("shared"))
    joined = s.join(own, s["s_suppkey"] == own["k"], "left").join(shared, s["s_nationkey"] == shared["k2"], "left")
    return joined.select("s_suppkey", cast.first_of(F.col("own"), F.col("shared"), F.lit("a shared line")).alias("reference"))


def speaker_islands(spark: SparkSession, d: str) -> DataFrame:
    s = segments(spark, d).withColumn("speaker", F.when(F.col("seg_idx") % 3 == 2, "user").otherwise(F.col("speaker")))
    return script.speaker_islands(s).select("chapter_idx", "seg_idx", "speaker", "n_segments", F.md5("text").alias("md5"))


def neighbor_context(spark: SparkSession, d: str) -> DataFrame:
    return script.neighbours(segments(spark, d), 2, 1).select("chapter_idx", "seg_idx", F.md5("context").alias("md5"))


def fold_wordless(spark: SparkSession, d: str) -> DataFrame:
    s = segments(spark, d).withColumn("text", F.when(F.col("seg_idx") % 3 == 1, "“").otherwise(F.col("text"))).withColumn("speaker", F.when(F.col("seg_idx") % 5 < 3, "a").otherwise("b"))
    return script.fold_wordless(s)


def _entries(spark: SparkSession, d: str) -> DataFrame:
    s = segments(spark, d)
    return s.select(F.concat_ws("-", "chapter_idx", "seg_idx").alias("entry_id"), "chapter_idx", (F.col("seg_idx") + F.col("chapter_idx") % 3).alias("seg_idx"), F.when(F.col("seg_idx") % 4 == 3, "gone").otherwise(F.col("text")).alias("text"))


def audit_segment_index(spark: SparkSession, d: str) -> DataFrame:
    return script.audit_positions(_entries(spark, d), segments(spark, d))


def apply_review_changes(spark: SparkSession, d: str) -> DataFrame:
    s = segments(spark, d).withColumn("instruction", F.lit("sad")).withColumn("speaker", F.when(F.col("speaker") == "system", "Retained").otherwise(F.col("speaker")))
    c = s.where("seg_idx % 2 = 0").select("chapter_idx", "seg_idx", F.explode(F.array(F.lit(1), F.lit(2))).alias("ordinal"), "text")
    c = c.select("chapter_idx", "seg_idx", "ordinal", F.when(F.col("ordinal") == 2, "Narrator").otherwise("x").alias("speaker"), F.when(F.col("chapter_idx") % 3 == 0, "grim").when(F.col("chapter_idx") % 3 == 1, "happy").alias("instruction"), F.when(F.col("chapter_idx") % 4 == 0, "changed").otherwise(F.concat(F.lit(" "), "text")).alias("text"))
    return script.apply_review(s, c).select("chapter_idx", "seg_idx", "speaker", F.md5("text").alias("md5"), "instruction", "text_mutation", "invalid_instruction", "retained_edit")


def remove_and_insert(spark: SparkSession, d: str) -> DataFrame:
    s = segments(spark, d)
    left = script.without(s, s.where("seg_idx % 4 = 1").select("chapter_idx", "seg_idx"))
    pieces = s.where("seg_idx <= 1").select("chapter_idx", F.col("seg_idx").alias("before"), F.col("seg_idx").alias("ordinal"), F.lit("Narrator").alias("speaker"), F.concat(F.lit("piece "), F.col("seg_idx").cast("string")).alias("text"))
    return script.inserted(left, pieces).select("chapter_idx", "seg_idx", "speaker", F.md5("text").alias("md5"))


def _tasks(spark: SparkSession, d: str) -> DataFrame:
    l = table(spark, d, "lineitem")
    return l.select(incremental.content_hash(F.col("l_partkey"), F.col("l_suppkey")).alias("hash"), F.col("l_orderkey").alias("chapter_idx"), F.col("l_linenumber").cast("long").alias("pos"), "l_partkey", F.concat_ws("-", F.lit("v"), F.col("l_suppkey") % 9).alias("voice"))


TASKS_SQL = "tasks AS (SELECT sha256(l_partkey || chr(31) || l_suppkey) AS hash, l_orderkey AS chapter_idx, l_linenumber::BIGINT AS pos, l_partkey, 'v-' || (l_suppkey % 9) AS voice FROM lineitem)"


def pending_tasks(spark: SparkSession, d: str) -> DataFrame:
    t = _tasks(spark, d)
    cached = t.where("l_partkey % 5 = 0").select("hash").distinct()
    return incremental.pending_tasks(t.select("hash", "chapter_idx", "pos", "voice"), cached, ["chapter_idx", "pos", "voice"])


def voice_batches(spark: SparkSession, d: str) -> DataFrame:
    t = _tasks(spark, d).groupBy("hash", "voice").agg(F.min("chapter_idx").alias("chapter_idx")).select("hash", F.concat("voice", F.lit("/"), (F.col("chapter_idx") % 16).cast("string")).alias("voice"), "chapter_idx", (F.col("chapter_idx") % 10 == 0).alias("needed"), F.col("hash").alias("ordinal"))
    return incremental.voice_batches(t, 8).select("hash", "voice", "needed", "batch")


def script_batches(spark: SparkSession, d: str) -> DataFrame:
    return incremental.fixed_batches(segments(spark, d), ["chapter_idx"], ["seg_idx"], 3).select("chapter_idx", "seg_idx", "batch")


def stale_chapters(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").select(F.col("doc_id").alias("key"), incremental.content_hash(F.col("text")).alias("hash"))
    state = t.select("key", F.when(F.col("key") % 3 == 0, "old").otherwise(F.col("hash")).alias("hash"), (F.col("key") % 5 != 1).alias("done"))
    return incremental.stale(t, state)


def state_upsert(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderstatus").alias("hash"), (F.col("o_orderkey") % 2 == 0).alias("done"), F.col("o_orderkey").alias("version"))
    return incremental.upsert_state(o.where("version % 3 <> 0"), o.where("version % 3 = 0"))


def chapter_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    s = segments(spark, d).select("chapter_idx", F.col("seg_idx").alias("pos"), F.md5("speaker").alias("hash"), F.when((F.col("chapter_idx") % 4 != 0) | (F.col("seg_idx") != 1), F.sha2("text", 256)).alias("sha"))
    return incremental.chapter_fingerprint(s)


def ready_prefix(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("book_id"), F.col("o_orderkey").alias("chapter_idx"), F.when(F.col("o_orderstatus") == "P", 1).otherwise(0).alias("n_pending"))
    return incremental.ready_prefix(o).select("book_id", "chapter_idx")


def _audit(spark: SparkSession, d: str) -> DataFrame:
    kinds = F.array(F.lit("flag"), F.lit("edit"), F.lit("validation"), F.lit("hallucination"))
    return segments(spark, d).select("chapter_idx", "seg_idx", F.element_at(kinds, (F.col("seg_idx") % 4 + 1).cast("int")).alias("kind"), F.when(F.col("seg_idx") % 3 == 0, "review").otherwise("revise").alias("phase"))


AUDIT_SQL = "audit AS (SELECT conv_id AS chapter_idx, turn AS seg_idx, ['flag', 'edit', 'validation', 'hallucination'][turn % 4 + 1] AS kind, CASE WHEN turn % 3 = 0 THEN 'review' ELSE 'revise' END AS phase FROM conversations)"


def audit_replace(spark: SparkSession, d: str) -> DataFrame:
    a = _audit(spark, d)
    chapters = a.where("chapter_idx % 2 = 0").select("chapter_idx").distinct()
    fresh = chapters.select("chapter_idx", F.lit(0).cast("long").alias("seg_idx"), F.lit("flag").alias("kind"), F.lit("review").alias("phase"))
    return incremental.replace_reviewed(a, fresh, chapters)


def audit_counts(spark: SparkSession, d: str) -> DataFrame:
    kinds = ("flag", "edit", "validation", "hallucination")
    return _audit(spark, d).groupBy("chapter_idx").agg(*(F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in kinds), F.count(F.lit(1)).alias("n"))


def unresolved_flags(spark: SparkSession, d: str) -> DataFrame:
    return incremental.unresolved_flags(_audit(spark, d), table(spark, d, "labels").where("toxic = 1").select(F.col("doc_id").alias("chapter_idx")))


def undismissed_flags(spark: SparkSession, d: str) -> DataFrame:
    s = segments(spark, d).withColumn("instruction", F.lit("sad"))
    f = s.select("chapter_idx", "seg_idx", F.when(F.col("seg_idx") % 2 == 0, "user").alias("suggested_speaker"), F.when(F.col("seg_idx") % 3 == 0, "sad").when(F.col("seg_idx") % 3 == 1, "happy").alias("suggested_instruction"))
    return incremental.undismissed(f, s)


_EMO = "[" + ", ".join(f"'{e}'" for e in EMOTIONS) + "]"
_STOP = "(" + ", ".join(f"'{w}'" for w in ALIAS_STOPWORDS) + ")"
_CLEAN = lambda x: f"lower(regexp_replace(trim({x}), '[.,;:]+$', ''))"

def _usable(aliases: str, name: str) -> str:
    norm = "lower(regexp_replace(trim({}), '[.,;:]+$', ''))".format("z")
    return f"list_filter({aliases}, lambda z: {norm} <> '' AND {norm} <> lower({name}) AND {norm} NOT IN {_STOP})"


def _holder(form: str, v: str) -> str:
    return f"coalesce(list_filter(members, lambda {v}: lower({v}.name) = lower({form}))[1].name, list_filter(members, lambda {v}: len(list_filter({v}.aliases, lambda {v}{v}: lower({v}{v}) = lower({form}))) > 0)[1].name)"


# the same fold as a recursion over the rows of each book
_FOLDED = f"""
WITH RECURSIVE own AS (
  SELECT n_regionkey AS book_id, list({{'name': n_name, 'description': 'from ' || n_name, 'voice': CASE WHEN n_nationkey % 2 = 0 THEN 'low' ELSE '' END, 'audition_line': CASE WHEN n_nationkey % 3 = 0 THEN 'a line' ELSE '' END,
    'aliases': CASE WHEN n_nationkey % 4 <> 3 THEN [lower(n_name), 'she', 'title ' || (n_nationkey % 3)] ELSE [] END}} ORDER BY n_nationkey) AS members FROM nation GROUP BY 1
), asked AS (
  SELECT n_regionkey AS book_id, list({{'batch': s_suppkey % 3, 'ordinal': s_suppkey, 'name': CASE s_suppkey % 5 WHEN 0 THEN n_name WHEN 1 THEN lower(n_name) WHEN 2 THEN 'title ' || (s_suppkey % 9) WHEN 3 THEN s_name ELSE 'Old ' || n_name END,
    'description': CASE WHEN s_suppkey % 2 = 0 THEN 'd' || (s_suppkey % 4) ELSE '' END, 'voice': CASE WHEN s_suppkey % 7 = 0 THEN 'v' || (s_suppkey % 2) END, 'audition_line': CASE WHEN s_suppkey % 6 = 0 THEN 'said ' || s_suppkey END,
    'aliases': CASE WHEN s_suppkey % 4 <> 1 THEN ['title ' || (s_suppkey % 11), 'Old ' || n_name, 'They', 'guest ' || (s_suppkey % 13)] ELSE [] END}} ORDER BY s_suppkey % 3, s_suppkey) AS events
  FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1
), s AS (
  SELECT book_id, events, 0 AS k, members, NULL::STRUCT(batch BIGINT, ordinal BIGINT, name VARCHAR, description VARCHAR, voice VARCHAR, audition_line VARCHAR, aliases VARCHAR[]) AS e, NULL::VARCHAR AS who, NULL::VARCHAR AS outcome, NULL::VARCHAR[] AS rejected FROM own LEFT JOIN asked USING (book_id)
  UNION ALL
  SELECT book_id, events, k + 1,
    CASE WHEN who IS NULL THEN list_append(members, {{'name': e.name, 'description': e.description, 'voice': e.voice, 'audition_line': e.audition_line, 'aliases': {_usable("e.aliases", "e.name")}}})
    ELSE list_transform(members, lambda m: CASE WHEN m.name = who THEN {{'name': who, 'description': CASE WHEN described THEN e.description ELSE m.description END, 'voice': CASE WHEN voiced THEN e.voice ELSE m.voice END, 'audition_line': CASE WHEN said THEN e.audition_line ELSE m.audition_line END, 'aliases': list_sort(kept)}} ELSE m END) END,
    e, who, CASE WHEN who IS NULL THEN 'added' WHEN lower(who) <> lower(e.name) THEN 'merged' WHEN described OR voiced OR said OR len(list_filter(kept, lambda z: NOT list_contains(old, z))) > 0 THEN 'updated' ELSE 'unchanged' END,
    CASE WHEN who IS NULL THEN [] ELSE list_sort(list_filter(wanted, lambda z: NOT list_contains(kept, z))) END
  FROM (
    SELECT *, list_filter(wanted, lambda z: coalesce({_holder("z", "y")}, who) = who) AS kept, coalesce(e.description, '') <> '' AND e.description IS DISTINCT FROM t.description AS described,
      coalesce(e.voice, '') <> '' AND e.voice IS DISTINCT FROM CASE WHEN coalesce(t.voice, '') = '' THEN t.description ELSE t.voice END AS voiced, coalesce(e.audition_line, '') <> '' AND coalesce(t.audition_line, '') = '' AS said
    FROM (
      SELECT *, {_usable("t.aliases", "who")} AS old, list_distinct(list_concat({_usable("t.aliases", "who")}, {_usable("list_concat(e.aliases, CASE WHEN lower(who) <> lower(e.name) THEN [e.name] ELSE [] END)", "who")})) AS wanted
      FROM (SELECT *, list_filter(members, lambda m: m.name = who)[1] AS t FROM (
        SELECT book_id, events, k, members, events[k + 1] AS e, list_filter(list_transform(list_concat([events[k + 1].name], events[k + 1].aliases), lambda f: {_holder("f", "y")}), lambda x: x IS NOT NULL)[1] AS who FROM s WHERE k < len(events)))
    )
  )
)"""

QUERIES = {
    "resolve_speakers": (resolve_speakers, f"WITH {RESOLVED_SQL} SELECT seg_id, speaker, resolved, problem FROM spoken JOIN resolved USING (speaker)"),
    "group_errors": (
        group_errors,
        f"WITH {RESOLVED_SQL}, e AS (SELECT speaker || ': ' || problem AS message, list(seg_id ORDER BY seg_id) AS l FROM spoken JOIN resolved USING (speaker) WHERE problem IS NOT NULL GROUP BY 1) "
        "SELECT message, len(l) AS n, array_to_string(l[:10], ', ') || CASE WHEN len(l) > 10 THEN ' (+' || (len(l) - 10) || ' more)' ELSE '' END AS preview FROM e",
    ),
    "usable_aliases": (
        usable_aliases,
        f"SELECT c_custkey, array_to_string(list_filter([c_name, ' She. ', 'the one', '...', c_mktsegment, 'Everyone;'], lambda a: {_CLEAN('a')} <> '' AND {_CLEAN('a')} <> lower(c_name) AND {_CLEAN('a')} NOT IN {_STOP}), '|') AS kept FROM customer",
    ),
    "find_existing": (
        find_existing,
        f"WITH {CAST_SQL}, i AS (SELECT s_suppkey AS id, [lower(n_name), 'The ' || n_name, 'stranger', 'visitor'][s_suppkey % 4 + 1] AS name, CASE WHEN s_suppkey % 4 = 2 THEN ['x', substr(n_name, 1, 4)] ELSE [] END AS aliases FROM supplier JOIN nation ON s_nationkey = n_nationkey), "
        "a AS (SELECT id, unnest(list_concat([name], aliases)) AS form, generate_subscripts(list_concat([name], aliases), 1) AS place FROM i), f AS (SELECT lower(name) AS form, name AS matched, 0 AS kind FROM members UNION ALL SELECT lower(unnest(aliases)), name, 1 FROM members) "
        "SELECT i.id, i.name, m.matched FROM i LEFT JOIN (SELECT id, arg_min(matched, (place, kind, matched)) AS matched FROM a JOIN f ON lower(a.form) = f.form GROUP BY id) m USING (id)",
    ),
    "cast_upsert": (
        cast_upsert,
        f"WITH {CAST_SQL}, c AS (SELECT name, lower(name) AS key, 'from ' || name AS description, CASE WHEN ordinal % 2 = 0 THEN 'a line' ELSE '' END AS line, aliases, ordinal FROM members), "
        "f AS (SELECT lower(unnest(list_concat([name], aliases))) AS form, key AS owner FROM c), "
        f"w AS (SELECT lower(name) AS key, a.alias FROM c, (SELECT unnest([1, 2, 3]) AS i) x, LATERAL (SELECT ['she', 'old ' || name, 'the FRANCE'][x.i] AS alias) a WHERE ordinal % 3 = 0), "
        f"k AS (SELECT key, list(alias) AS fresh FROM w WHERE {_CLEAN('alias')} <> '' AND {_CLEAN('alias')} <> key AND {_CLEAN('alias')} NOT IN {_STOP} AND NOT EXISTS (SELECT 1 FROM f WHERE f.form = lower(alias) AND f.owner <> w.key) GROUP BY key) "
        f"SELECT name, CASE WHEN ordinal % 6 = 0 THEN 'new' ELSE description END AS description, 'low' AS voice, CASE WHEN line = '' AND ordinal % 3 = 0 THEN 'said' ELSE line END AS audition_line, "
        f"array_to_string(list_sort(list_distinct(list_concat(list_filter(aliases, lambda a: {_CLEAN('a')} <> '' AND {_CLEAN('a')} <> key AND {_CLEAN('a')} NOT IN {_STOP}), coalesce(fresh, [])))), '|') AS aliases, "
        "CASE WHEN ordinal % 3 <> 0 THEN 'kept' ELSE 'updated' END AS outcome FROM c LEFT JOIN k USING (key)",
    ),
    "cast_batches": (cast_batches, f"{_FOLDED} SELECT book_id, i - 1 AS ordinal, m.name, m.description, m.voice, m.audition_line, array_to_string(m.aliases, '|') AS aliases FROM (SELECT book_id, unnest(members) AS m, generate_subscripts(members, 1) AS i FROM s WHERE k = coalesce(len(events), 0))"),
    "batch_outcomes": (batch_outcomes, f"{_FOLDED} SELECT book_id, e.batch, e.ordinal, e.name, coalesce(who, e.name) AS member, outcome, array_to_string(rejected, '|') AS rejected FROM s WHERE k > 0"),
    "cast_merge": (
        cast_merge,
        f"WITH {CAST_SQL}, t AS (SELECT m.name, m.aliases, s.name AS survivor FROM members m JOIN members s ON s.ordinal = least(m.ordinal - m.ordinal % 5 + 4, 24)), "
        "a AS (SELECT survivor, name, unnest(list_concat(aliases, CASE WHEN name = survivor THEN [] ELSE [name] END)) AS alias FROM t), "
        "g AS (SELECT survivor, array_to_string(list_sort(list(DISTINCT alias)), '|') AS aliases FROM a WHERE name = survivor OR lower(alias) <> lower(survivor) GROUP BY 1) "
        "SELECT name, survivor, CASE WHEN name = survivor THEN g.aliases END AS aliases FROM t JOIN g USING (survivor)",
    ),
    "emote_tasks": (emote_tasks, f"SELECT n_name AS name, i - 1 AS emotion_idx, {_EMO}[i] AS emotion, sha256(n_name || chr(31) || {_EMO}[i]) AS hash FROM nation, generate_series(1, {len(EMOTIONS)}) AS g(i)"),
    "round_robin_voices": (
        round_robin_voices,
        "WITH c AS (SELECT c_nationkey, c_custkey AS ordinal, c_custkey % 11 = 0 AS narrator, CASE WHEN c_custkey % 7 = 0 THEN 'kept' END AS had FROM customer) "
        "SELECT c_nationkey, ordinal, coalesce(had, CASE WHEN narrator THEN 'v0' ELSE ['v1', 'v2', 'v3'][CAST(sum(CASE WHEN narrator THEN 0 ELSE 1 END) OVER (PARTITION BY c_nationkey ORDER BY ordinal) - 1 AS BIGINT) % 3 + 1] END) AS voice FROM c",
    ),
    "voice_references": (
        voice_references,
        "SELECT s_suppkey, coalesce(CASE WHEN s_suppkey % 3 = 0 THEN 'own ' || s_name END, CASE WHEN n_nationkey % 2 = 0 THEN 'nation ' || n_name END, 'a shared line') AS reference FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey",
    ),
    "speaker_islands": (
        speaker_islands,
        f"WITH {SEGMENTS_SQL}, s AS (SELECT * REPLACE (CASE WHEN seg_idx % 3 = 2 THEN 'user' ELSE speaker END AS speaker) FROM segments), n AS (SELECT *, CASE WHEN lag(speaker) OVER w = speaker THEN 0 ELSE 1 END AS new FROM s WINDOW w AS (PARTITION BY chapter_idx ORDER BY seg_idx)), "
        "i AS (SELECT *, sum(new) OVER (PARTITION BY chapter_idx ORDER BY seg_idx) - 1 AS island FROM n) SELECT chapter_idx, CAST(island AS BIGINT) AS seg_idx, first(speaker) AS speaker, count(*) AS n_segments, md5(string_agg(trim(text, E' \\n\\t\\r'), ' ' ORDER BY seg_idx)) AS md5 FROM i GROUP BY chapter_idx, island",
    ),
    "neighbor_context": (
        neighbor_context,
        f"WITH {SEGMENTS_SQL} SELECT chapter_idx, seg_idx, md5(array_to_string(list(speaker || ': ' || text) OVER (PARTITION BY chapter_idx ORDER BY seg_idx ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING), chr(10))) AS md5 FROM segments",
    ),
    "fold_wordless": (
        fold_wordless,
        f"WITH {SEGMENTS_SQL}, r AS (SELECT chapter_idx, seg_idx, CASE WHEN seg_idx % 5 < 3 THEN 'a' ELSE 'b' END AS speaker, CASE WHEN seg_idx % 3 = 1 THEN '“' ELSE text END AS text FROM segments), "
        "w AS (SELECT *, regexp_matches(text, '[\\p{L}\\p{N}]') AS worded, coalesce(lag(speaker) OVER c <> speaker, true) AS new FROM r WINDOW c AS (PARTITION BY chapter_idx ORDER BY seg_idx)), "
        "i AS (SELECT *, sum(new::INT) OVER (PARTITION BY chapter_idx ORDER BY seg_idx) AS run FROM w), "
        # the next one with words in the run, else the last one, else the run's end
        "o AS (SELECT *, coalesce((SELECT min(n.seg_idx) FROM i n WHERE n.chapter_idx = i.chapter_idx AND n.run = i.run AND n.worded AND n.seg_idx >= i.seg_idx), "
        "(SELECT max(n.seg_idx) FROM i n WHERE n.chapter_idx = i.chapter_idx AND n.run = i.run AND n.worded), max(seg_idx) OVER (PARTITION BY chapter_idx, run)) AS home FROM i) "
        "SELECT chapter_idx, home AS seg_idx, any_value(speaker) AS speaker, string_agg(text, '' ORDER BY seg_idx) AS text FROM o GROUP BY chapter_idx, home",
    ),
    "audit_segment_index": (
        audit_segment_index,
        f"WITH {SEGMENTS_SQL}, e AS (SELECT chapter_idx || '-' || seg_idx AS entry_id, chapter_idx, seg_idx + chapter_idx % 3 AS seg_idx, CASE WHEN seg_idx % 4 = 3 THEN 'gone' ELSE text END AS text FROM segments), "
        "u AS (SELECT chapter_idx, text, min(seg_idx) AS only_ FROM segments GROUP BY 1, 2 HAVING count(*) = 1) "
        "SELECT e.entry_id, e.chapter_idx, e.seg_idx, CASE WHEN s.text = e.text THEN e.seg_idx ELSE coalesce(only_, CASE WHEN s.text IS NOT NULL THEN e.seg_idx END) END AS current_idx FROM e LEFT JOIN segments s ON s.chapter_idx = e.chapter_idx AND s.seg_idx = e.seg_idx LEFT JOIN u ON u.chapter_idx = e.chapter_idx AND u.text = e.text",
    ),
    "apply_review_changes": (
        apply_review_changes,
        f"WITH {SEGMENTS_SQL}, s AS (SELECT chapter_idx, seg_idx, CASE WHEN speaker = 'system' THEN 'Retained' ELSE speaker END AS speaker, text, seg_idx % 2 = 0 AS hit FROM segments) "
        "SELECT chapter_idx, seg_idx, CASE WHEN hit AND speaker <> 'Retained' THEN 'Narrator' ELSE speaker END AS speaker, md5(text) AS md5, CASE WHEN hit AND chapter_idx % 3 = 1 THEN 'happy' ELSE 'sad' END AS instruction, "
        "CASE WHEN hit AND chapter_idx % 4 = 0 AND trim(text) <> 'changed' THEN 'changed' END AS text_mutation, CASE WHEN hit AND chapter_idx % 3 = 0 THEN 'grim' END AS invalid_instruction, CASE WHEN hit AND speaker = 'Retained' THEN 'Narrator' END AS retained_edit FROM s",
    ),
    "remove_and_insert": (
        remove_and_insert,
        f"WITH {SEGMENTS_SQL}, l AS (SELECT chapter_idx, row_number() OVER (PARTITION BY chapter_idx ORDER BY seg_idx) - 1 AS place, 1 AS a, 0 AS o, speaker, text FROM segments WHERE seg_idx % 4 <> 1), "
        "u AS (SELECT * FROM l UNION ALL SELECT chapter_idx, seg_idx, 0, seg_idx, 'Narrator', 'piece ' || seg_idx FROM segments WHERE seg_idx <= 1) "
        "SELECT chapter_idx, row_number() OVER (PARTITION BY chapter_idx ORDER BY place, a, o) - 1 AS seg_idx, speaker, md5(text) AS md5 FROM u",
    ),
    "pending_tasks": (
        pending_tasks,
        f"WITH {TASKS_SQL} SELECT hash, chapter_idx, pos, voice FROM tasks WHERE hash NOT IN (SELECT hash FROM tasks WHERE l_partkey % 5 = 0) QUALIFY row_number() OVER (PARTITION BY hash ORDER BY chapter_idx, pos, voice) = 1",
    ),
    "voice_batches": (
        voice_batches,
        f"WITH {TASKS_SQL}, t AS (SELECT hash, voice, min(chapter_idx) AS c FROM tasks GROUP BY 1, 2), v AS (SELECT hash, voice || '/' || (c % 16) AS voice, c, c % 10 = 0 AS needed FROM t) "
        "SELECT hash, voice, needed, (row_number() OVER (PARTITION BY voice ORDER BY needed DESC, c, hash) - 1) // 8 AS batch FROM v",
    ),
    "script_batches": (script_batches, f"WITH {SEGMENTS_SQL} SELECT chapter_idx, seg_idx, (row_number() OVER (PARTITION BY chapter_idx ORDER BY seg_idx) - 1) // 3 AS batch FROM segments"),
    "stale_chapters": (stale_chapters, "SELECT doc_id AS key, sha256(text) AS hash FROM documents WHERE doc_id % 3 = 0 OR doc_id % 5 = 1"),
    "state_upsert": (state_upsert, "SELECT o_custkey AS key, arg_max(o_orderstatus, o_orderkey) AS hash, arg_max(o_orderkey % 2 = 0, o_orderkey) AS done, max(o_orderkey) AS version FROM orders GROUP BY 1"),
    "chapter_fingerprint": (
        chapter_fingerprint,
        f"WITH {SEGMENTS_SQL}, s AS (SELECT chapter_idx, seg_idx, md5(speaker) AS h, CASE WHEN chapter_idx % 4 <> 0 OR seg_idx <> 1 THEN sha256(text) END AS a FROM segments) "
        "SELECT chapter_idx, sha256(CASE WHEN bool_or(a IS NULL) THEN string_agg(h, '|' ORDER BY seg_idx) ELSE string_agg(h || ':' || a, '|' ORDER BY seg_idx) END) AS fingerprint FROM s GROUP BY chapter_idx",
    ),
    "ready_prefix": (ready_prefix, "SELECT o_custkey AS book_id, o_orderkey AS chapter_idx FROM orders QUALIFY coalesce(o_orderkey < min(o_orderkey) FILTER (o_orderstatus = 'P') OVER (PARTITION BY o_custkey), true)"),
    "audit_replace": (audit_replace, f"WITH {AUDIT_SQL} SELECT * FROM audit WHERE NOT (phase = 'review' AND chapter_idx % 2 = 0) UNION ALL SELECT DISTINCT chapter_idx, 0, 'flag', 'review' FROM audit WHERE chapter_idx % 2 = 0"),
    "audit_counts": (audit_counts, f"WITH {AUDIT_SQL} SELECT chapter_idx, count(*) FILTER (kind = 'flag') AS n_flag, count(*) FILTER (kind = 'edit') AS n_edit, count(*) FILTER (kind = 'validation') AS n_validation, count(*) FILTER (kind = 'hallucination') AS n_hallucination, count(*) AS n FROM audit GROUP BY 1"),
    "unresolved_flags": (unresolved_flags, f"WITH {AUDIT_SQL} SELECT chapter_idx, count(*) AS n FROM audit WHERE kind = 'flag' AND chapter_idx IN (SELECT doc_id FROM labels WHERE toxic = 1) GROUP BY 1"),
    "undismissed_flags": (
        undismissed_flags,
        f"WITH {SEGMENTS_SQL}, f AS (SELECT *, CASE WHEN seg_idx % 2 = 0 THEN 'user' END AS suggested_speaker, CASE WHEN seg_idx % 3 = 0 THEN 'sad' WHEN seg_idx % 3 = 1 THEN 'happy' END AS suggested_instruction FROM segments) "
        "SELECT chapter_idx, seg_idx, suggested_speaker, suggested_instruction FROM f WHERE (suggested_speaker IS NULL AND suggested_instruction IS NULL) OR coalesce(suggested_speaker, speaker) <> speaker OR coalesce(suggested_instruction, 'sad') <> 'sad'",
    ),
}
