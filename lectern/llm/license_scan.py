"""License scans by recognising sentences and matching their order.

A text is cut into sentences, each is normalised (lower case, letters and
digits only, one space between words) and mapped to the identifier of a
known licence sentence. Closing marks before white space, blank lines,
list marks and the words that open a licence text end a sentence. A single line end may be a wrap or an end: a
known sentence may run over line ends, any other text ends there. The
identifiers, in text order and with a mark wherever other text stands
between them, form a sequence; ordered rules name the licence that a run of
adjacent identifiers stands for. An earlier rule uses up the sentences that
it matches, and leaves a mark in their place, so full licence texts come
before single notices. All steps are column expressions; nothing is
shuffled.

Defined results: a null or empty text has no sentences; repeated rows get
equal results; a rule that matches several times is reported once; a null
id stays null; extra columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

import re
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Known licence sentences after normalisation (fixed values, from the published licence texts).
SENTENCES: dict[str, str] = {
    "mit-title": "mit license",
    "mit-the-title": "the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-short-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
    "mit-condition": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit-disclaimer": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "mit-short-disclaimer": "the software is provided as is without warranty of any kind express or implied",
    "mit-liability": "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "apache-title": "apache license",
    "apache-version": "version 2.0 january 2004 http www.apache.org licenses",
    "apache-notice": "licensed under the apache license version 2.0",
    "apache-defined": "licensed under the apache license version 2.0 the license",
    "apache-grant": "you may not use this file except in compliance with the license",
    "apache-copy": "you may obtain a copy of the license at",
    "apache-url": "http www.apache.org licenses license 2.0",
    "apache-secure-url": "https www.apache.org licenses license 2.0",
    "apache-disclaimer": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache-see": "see the license for the specific language governing permissions and limitations under the license",
    "gpl-program": "this program is free software",
    "gpl-library": "this library is free software",
    "gpl-merchantable": "without even the implied warranty of merchantability or fitness for a particular purpose",
    "gpl-hope": "this program is distributed in the hope that it will be useful but without any warranty",
    "lgpl-hope": "this library is distributed in the hope that it will be useful but without any warranty",
    "gpl-see-web": "if not see https www.gnu.org licenses",
    "gpl-see-plain-web": "if not see http www.gnu.org licenses",
    "bsd-title": "bsd license",
    "bsd-2-title": "bsd 2 clause license",
    "bsd-3-title": "bsd 3 clause license",
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-names": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-disclaimer": "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    "bsd-damages": "in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services",
    "bsd-owner-damages": "in no event shall the copyright owner or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services",
    "bsd-profits": "loss of use data or profits",
    "bsd-liability": "or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage",
    "isc-title": "isc license",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "isc-plain-grant": "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "isc-disclaimer": "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    "mpl-notice": "this source code form is subject to the terms of the mozilla public license v",
    "mpl-copy": "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla.org mpl 2.0",
    "mpl-plain-copy": "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla.org mpl 2.0",
    "boost-notice": "distributed under the boost software license version 1.0",
    "boost-see": "see accompanying file license 1 0.txt or copy at https www.boost.org license 1 0.txt",
    "zlib-disclaimer": "this software is provided as is without any express or implied warranty",
    "zlib-liability": "in no event will the authors be held liable for any damages arising from the use of this software",
    "zlib-grant": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "unlicense-domain": "this is free and unencumbered software released into the public domain",
    "unlicense-grant": "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    "gpl3-work": "this work is licensed under the gnu general public license version 3",
    "reserved": "all rights reserved",
}

#: Names that a notice gives a licence (fixed values): words of the name, licence.
NAMES: dict[str, str] = {
    "mit license": "MIT",
    "apache license": "Apache-2.0",
    "apache license version 2.0": "Apache-2.0",
    "bsd license": "BSD",
    "bsd 2 clause license": "BSD-2-Clause",
    "bsd 3 clause license": "BSD-3-Clause",
    "isc license": "ISC",
    "mozilla public license version 2.0": "MPL-2.0",
    "gnu general public license version 2": "GPL-2.0",
    "gnu general public license version 3": "GPL-3.0",
    "gnu lesser general public license version 3": "LGPL-3.0",
    "gnu affero general public license version 3": "AGPL-3.0",
    "cc by 4.0": "CC-BY-4.0",
    "cc by sa 4.0": "CC-BY-SA-4.0",
    "cc by nc 4.0": "CC-BY-NC-4.0",
    "cc by nd 4.0": "CC-BY-ND-4.0",
    "cc by nc sa 4.0": "CC-BY-NC-SA-4.0",
    "cc by nc nd 4.0": "CC-BY-NC-ND-4.0",
}
#: Short identifiers as they stand behind "SPDX-License-Identifier:" (fixed values).
SPDX = ("MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "MPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-3.0-only", "AGPL-3.0-only", "Unlicense", "Zlib", "BSL-1.0", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0")
#: Known sentences that follow one another without a closing mark when a text is not wrapped.
JOINED = (
    ("apache-copy", "apache-url"),
    ("apache-copy", "apache-secure-url"),
    ("apache-copy", "apache-url", "apache-disclaimer"),
    ("apache-copy", "apache-secure-url", "apache-disclaimer"),
    ("apache-title", "apache-version"),
)

Rule = tuple[str, str, tuple[str, ...]]


def _gnu(short: str, words: str, thing: str, version: str) -> tuple[dict[str, str], list[Rule]]:
    """Sentences and rules of the notice that the GNU licences ask for; version 3 writes it without the semicolons."""
    later = f"either version {version} of the license or at your option any later version"
    terms = f"you can redistribute it and or modify it under the terms of the {words} as published by the free software foundation"
    known = {f"{short}-terms": terms, f"{short}-terms-{version}": f"{terms} {later}", f"gpl-later-{version}": later, f"{short}-more": f"see the {words} for more details", f"{short}-received-{thing}": f"you should have received a copy of the {words} along with this {thing}"}
    head, hope = f"gpl-{thing}", "lgpl-hope" if thing == "library" else "gpl-hope"
    licence = f"{short.upper()}-{version if '.' in version else version + '.0'}"
    tail = (hope, "gpl-merchantable", f"{short}-more", f"{short}-received-{thing}")
    rules = [
        (f"{short}-{version}-{thing}-full", licence, (head, f"{short}-terms-{version}", *tail)),
        (f"{short}-{version}-{thing}-cut-full", licence, (head, f"{short}-terms", f"gpl-later-{version}", *tail)),
        (f"{short}-{version}-{thing}-terms", licence, (head, f"{short}-terms-{version}")),
        (f"{short}-{version}-{thing}-cut-terms", licence, (head, f"{short}-terms", f"gpl-later-{version}")),
    ]
    return known, rules


def _creative_commons() -> tuple[dict[str, str], list[Rule]]:
    known, rules = {}, []
    for short, words in {"by": "attribution", "by-sa": "attribution sharealike", "by-nc": "attribution noncommercial", "by-nd": "attribution noderivatives", "by-nc-sa": "attribution noncommercial sharealike", "by-nc-nd": "attribution noncommercial noderivatives"}.items():
        known[f"cc-{short}-long"] = f"this work is licensed under a creative commons {words} 4.0 international license"
        known[f"cc-{short}-the-long"] = f"this work is licensed under the creative commons {words} 4.0 international license"
        rules += [(f"cc-{short}-{form}", f"CC-{short.upper()}-4.0", (f"cc-{short}-{form}",)) for form in ("long", "the-long")]
    return known, rules


def _notices() -> tuple[dict[str, str], list[Rule]]:
    known, rules = {}, []
    for words, licence in NAMES.items():
        name = words.replace(" ", "-").replace(".", "_")
        article = "" if words.startswith("cc ") else "the "
        for verb in ("released", "licensed", "distributed"):
            key = f"{verb}-{name}"
            sentence = f"{verb} under {article}{words}"
            if sentence in SENTENCES.values():
                continue
            known[key] = sentence
            rules.append((key, licence, (key,)))
    for short in SPDX:
        key = f"spdx-{short.lower()}"
        known[key] = "spdx license identifier " + short.lower().replace("-", " ")
        rules.append((key, short, (key,)))
    return known, rules


_PARTS = [_gnu("gpl", "gnu general public license", "program", v) for v in ("3", "2")]
_PARTS += [_gnu("lgpl", "gnu lesser general public license", thing, v) for thing in ("library", "program") for v in ("3", "2.1")]
_PARTS += [_gnu("agpl", "gnu affero general public license", "program", "3"), _creative_commons(), _notices()]
KNOWN: dict[str, str] = {}
for _sentences in (SENTENCES, *(known for known, _ in _PARTS)):
    KNOWN |= _sentences

_BSD_END = (("bsd-disclaimer", damages, "bsd-profits", "bsd-liability") for damages in ("bsd-damages", "bsd-owner-damages"))
#: Ordered rules: (rule, licence, adjacent sentence identifiers). Longer runs come first, single notices last.
RULES: tuple[Rule, ...] = (
    ("mit-full", "MIT", ("mit-grant", "mit-condition", "mit-disclaimer", "mit-liability")),
    ("mit-terms", "MIT", ("mit-grant", "mit-condition", "mit-disclaimer")),
    ("mit-short-terms", "MIT", ("mit-short-grant", "mit-condition", "mit-short-disclaimer")),
    *((f"apache-header{k}", "Apache-2.0", ("apache-defined", "apache-grant", "apache-copy", url, "apache-disclaimer", "apache-see")) for k, url in enumerate(("apache-url", "apache-secure-url"))),
    ("apache-defined-grant", "Apache-2.0", ("apache-defined", "apache-grant")),
    ("apache-header", "Apache-2.0", ("apache-notice", "apache-grant")),
    ("apache-text", "Apache-2.0", ("apache-title", "apache-version")),
    *((f"bsd-3-full{k}", "BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names", *end)) for k, end in enumerate(list(_BSD_END))),
    *((f"bsd-2-full{k}", "BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-disclaimer", damages, "bsd-profits", "bsd-liability")) for k, damages in enumerate(("bsd-damages", "bsd-owner-damages"))),
    ("bsd-3-terms", "BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names")),
    ("bsd-2-terms", "BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("isc-full", "ISC", ("isc-grant", "isc-disclaimer")),
    ("isc-plain-full", "ISC", ("isc-plain-grant", "isc-disclaimer")),
    ("zlib-full", "Zlib", ("zlib-disclaimer", "zlib-liability", "zlib-grant")),
    ("unlicense-full", "Unlicense", ("unlicense-domain", "unlicense-grant")),
    *(rule for _, rules in _PARTS for rule in rules),
    ("mit-grant", "MIT", ("mit-grant",)),
    ("mit-short-grant", "MIT", ("mit-short-grant",)),
    ("mit-title", "MIT", ("mit-title",)),
    ("mit-the-title", "MIT", ("mit-the-title",)),
    ("apache-defined", "Apache-2.0", ("apache-defined",)),
    ("apache-notice", "Apache-2.0", ("apache-notice",)),
    ("bsd-3-title", "BSD-3-Clause", ("bsd-3-title",)),
    ("bsd-2-title", "BSD-2-Clause", ("bsd-2-title",)),
    ("bsd-grant", "BSD", ("bsd-grant",)),
    ("isc-grant", "ISC", ("isc-grant",)),
    ("isc-plain-grant", "ISC", ("isc-plain-grant",)),
    ("isc-title", "ISC", ("isc-title",)),
    ("mpl-notice", "MPL-2.0", ("mpl-notice",)),
    ("mpl-copy", "MPL-2.0", ("mpl-copy",)),
    ("mpl-plain-copy", "MPL-2.0", ("mpl-plain-copy",)),
    ("boost-notice", "BSL-1.0", ("boost-notice",)),
    ("zlib-grant", "Zlib", ("zlib-grant",)),
    ("unlicense-domain", "Unlicense", ("unlicense-domain",)),
    ("gpl3-work", "GPL-3.0", ("gpl3-work",)),
    ("reserved", "Proprietary", ("reserved",)),
)

#: Every known sentence has one of these, each within a word, so spacing cannot hide it; texts without any are not cut into sentences.
KEYS = ("licen", "permi", "warrant", "redistribut", "reserved", "provided", "liab", "software", "profits", "released", "distributed")

#: Words that open a licence text and end what stands before them on the same line, a title or a copyright notice (fixed values).
OPENINGS = ("permission is hereby granted free of charge", "permission to use copy modify", "redistribution and use in source and binary forms", "licensed under the apache license version 2.0 the license", "this program is free software", "this library is free software")


def _wrapped(sentence: str) -> str:
    """A pattern of the sentence with line ends anywhere between its words."""
    return " (?:~ )?".join(map(re.escape, sentence.split(" ")))


_SPACE = r"[ \t\n\x0B\f\r]"
#: Steps of normalisation after lower-casing: (pattern, replacement). What is left are words, | for ends and ~ for line ends.
_STEPS = (
    (r"(^|\n)[ \t]*(?:(?:[#/*;%>-]+|rem|dnl|\(?[a-z0-9]{1,2}[.)])[ \t]+){1,4}", r"\1"),
    (r"spdx-license-identifier[ \t]*:", "spdx license identifier "),
    (rf"[.!?:;][\"')>\]\x60]*({_SPACE}|$)", r"|\1"),
    (r"\n[ \t\x0B\f\r]*\n", "|"),
    (r"[\n\r]+", "~"),
    (r"[^a-z0-9.|~]+", " "),
    (r"[ .~]*[|][ .|~]*", " | "),
    (r"[ .]*~[ .~]*", " ~ "),
    (r"[|] [a-z0-9]{1,2} [|]", "|"),
    (f" ({'|'.join(map(_wrapped, OPENINGS))})", r" | \1"),
)


def _table() -> dict[str, str]:
    """Normalised sentence to its run of identifiers."""
    out = {s: f"|{name}|" for name, s in KNOWN.items()}
    for run in JOINED:
        out[" ".join(KNOWN[i] for i in run)] = _run(run)
    return out


def _run(ids: tuple[str, ...]) -> str:
    return "".join(f"|{i}|" for i in ids)


def _token_pattern() -> str:
    """A known sentence with its end, longer ones first, or any other text up to an end."""
    known = sorted(_table(), key=lambda s: (-len(s), s))
    return f"(?:{'|'.join(map(_wrapped, known))}) [|~]|[^ |~][^|~]*[|~]"


def sentences(text: Column) -> Column:
    """Normalised sentences of a text, each with its end mark; known ones are whole, whatever their line ends."""
    out = F.translate(text, string.ascii_uppercase + "|~", string.ascii_lowercase + "  ")
    for pattern, put in _STEPS:
        out = F.regexp_replace(out, pattern, put.replace("\\1", "$1"))
    # two spaces at most remain side by side, around an end that nothing stands before
    out = F.regexp_replace(F.concat(F.trim(out), F.lit(" |")), " +", " ")
    return F.transform(F.regexp_extract_all(out, F.lit(_token_pattern()), F.lit(0)), lambda s: F.trim(F.regexp_replace(s, "[|~] ?", "")))


def sequence(text: Column) -> Column:
    """Identifiers of the known sentences as |id||id|, with / wherever other text stands between them; empty if there are none."""
    known = F.create_map(*(F.lit(x) for pair in sorted(_table().items()) for x in pair))
    low = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    any_key = low.contains(KEYS[0])
    for key in KEYS[1:]:
        any_key = any_key | low.contains(key)
    found = F.array_join(F.transform(sentences(text), lambda s: F.coalesce(F.element_at(known, s), F.lit("/"))), "")
    # without a known sentence nothing but the mark is left
    return F.when(any_key, F.regexp_replace(F.regexp_replace(found, "/+", "/"), "^/$", "")).otherwise(F.lit(""))


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_sentences (known ones), sentence_ids, rules, licenses (comma-joined, in rule order, licences once)."""
    source = docs.select(docs[id_col].alias("doc_id"), sequence(F.coalesce(docs[text_col], F.lit(""))).alias("s"))

    # one lambda per row runs all rules: the sequence that is left, and the numbers of the rules that matched
    runs = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(_run(ids)).alias("run")) for k, (_, _, ids) in enumerate(RULES)))
    start = F.struct(F.col("s").alias("left"), F.array().cast("array<int>").alias("hit"))

    def apply(state: Column, rule: Column) -> Column:
        hit = state["left"].contains(rule["run"])
        return F.when(hit, F.struct(F.replace(state["left"], rule["run"], F.lit("/")).alias("left"), F.array_append(state["hit"], rule["k"]).alias("hit"))).otherwise(state)

    matched = F.when(F.col("s") == "", F.array().cast("array<int>")).otherwise(F.aggregate(runs, start, apply, lambda state: state["hit"]))
    out = source.select("doc_id", F.array_remove(F.split(F.regexp_replace("s", "[|/]+", ","), ","), "").alias("ids"), matched.alias("hit"))
    names, licences = (F.array(*(F.lit(rule[at]) for rule in RULES)) for at in (0, 1))
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_sentences"),
        F.array_join("ids", ",").alias("sentence_ids"),
        F.array_join(F.transform("hit", lambda k: F.get(names, k)), ",").alias("rules"),
        F.array_join(F.array_distinct(F.transform("hit", lambda k: F.get(licences, k))), ",").alias("licenses"),
    )


def oracle() -> str:
    """DuckDB SQL of the same over the table documents: every sentence by the table of known ones, every rule in turn."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    text = f"translate(coalesce(text, ''), '{string.ascii_uppercase}|~', '{string.ascii_lowercase}  ')"
    for pattern, put in _STEPS:
        text = f"regexp_replace({text}, {quote(pattern)}, {quote(put)}, 'g')"
    whole = f"regexp_replace(trim({text}) || ' |', ' +', ' ', 'g')"
    known = ", ".join(f"{quote(s)}: {quote(ids)}" for s, ids in sorted(_table().items()))
    rules = ", ".join(f"({k}, {quote(name)}, {quote(licence)}, {quote(_run(ids))})" for k, (name, licence, ids) in enumerate(RULES))
    return f"""
WITH RECURSIVE known AS (SELECT MAP {{{known}}} AS m),
rule(k, name, licence, run) AS (VALUES {rules}),
token AS (
  SELECT doc_id, list_transform(regexp_extract_all({whole}, {quote(_token_pattern())}), lambda s: trim(regexp_replace(s, '[|~] ?', '', 'g'))) AS parts FROM documents
), found AS (
  SELECT doc_id, row_number() OVER () AS row, regexp_replace(array_to_string(list_transform(parts, lambda s: coalesce(m[s], '/')), ''), '/+', '/', 'g') AS s FROM token, known
), step AS (
  SELECT row, 0 AS k, s, '' AS names, '' AS licences FROM found WHERE contains(s, '|')
  UNION ALL
  SELECT row, step.k + 1, replace(s, run, '/'), names || CASE WHEN contains(s, run) THEN ',' || name ELSE '' END,
    licences || CASE WHEN contains(s, run) AND NOT contains(licences || ',', ',' || licence || ',') THEN ',' || licence ELSE '' END
  FROM step JOIN rule ON rule.k = step.k
), ended AS (SELECT * FROM step WHERE k = {len(RULES)})
SELECT doc_id, len(list_filter(string_split_regex(found.s, '[|/]+'), lambda x: x <> '')) AS n_sentences,
  array_to_string(list_filter(string_split_regex(found.s, '[|/]+'), lambda x: x <> ''), ',') AS sentence_ids,
  coalesce(substr(names, 2), '') AS rules, coalesce(substr(licences, 2), '') AS licenses
FROM found LEFT JOIN ended USING (row)
"""
