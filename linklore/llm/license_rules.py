"""Licence scans by sentence-rule recognition.

After German, Manabe and Inoue: text is cut into sentences, a sentence is normalised and
looked up among known licence sentences, and the sequence of identifiers is matched
against ordered rules.  A rule that matches takes its identifiers out of the sequence, so
a longer licence is named before a part of it; what no rule takes stays as ``unmatched``.

Sentences end at ``.``, ``!``, ``?`` or ``:`` before white space, and at line ends; text wrapped
inside a sentence is recognised in a second reading that joins the lines of a paragraph.
List markers are dropped.  A sentence that only puts licence names behind a lead-in, and an
SPDX tag, are looked up by name: names joined by ``or`` and ``and`` give one identifier each,
in order, and an exception after ``with`` is not read.  A copyright notice with ``all rights
reserved`` is a licence only where no other is found.

``recognise_sql`` follows the same rules.  All expressions are Spark columns; no row moves,
and a text without a marker word costs one search.

Null and empty texts have no licence; repeated rows get equal results; a null id is
carried along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Identifier of each known sentence, normalised.
SENTENCES = {
    "apache2-grant": "licensed under the apache license version 2 0",
    "apache2-grant-long": "licensed under the apache license version 2 0 the license",
    "apache2-comply": "you may not use this file except in compliance with the license",
    "apache2-copy": "you may obtain a copy of the license at",
    "apache2-short": "apache license version 2 0",
    "mit-grant": "released under the mit license",
    "mit-under": "licensed under the mit license",
    "mit-project": "this project is licensed under the mit license",
    "mit-title": "the mit license",
    "mit-title-short": "mit license",
    "mit-permission": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "gpl3-work": "this work is licensed under the gnu general public license version 3",
    "gpl3-under": "licensed under the gnu general public license version 3",
    "gpl2-under": "licensed under the gnu general public license version 2",
    "gpl-redistribute": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl2-redistribute": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "lgpl3-under": "licensed under the gnu lesser general public license version 3",
    "agpl3-under": "licensed under the gnu affero general public license version 3",
    "gpl-warranty": "without even the implied warranty of merchantability or fitness for a particular purpose",
    "gpl-copy": "you should have received a copy of the gnu general public license along with this program",
    "bsd-redistribute": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd3-under": "licensed under the bsd 3 clause license",
    "bsd2-under": "licensed under the bsd 2 clause license",
    "mpl2-terms": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "mpl2-under": "licensed under the mozilla public license version 2 0",
    "ccby-nc4": "licensed under cc by nc 4 0",
    "ccby-sa4": "licensed under cc by sa 4 0",
    "ccby4": "licensed under cc by 4 0",
    "ccby-nc4-work": "this work is licensed under cc by nc 4 0",
    "ccby-sa4-work": "this work is licensed under cc by sa 4 0",
    "ccby4-work": "this work is licensed under cc by 4 0",
    "cc-attribution4": "this work is licensed under a creative commons attribution 4 0 international license",
    "cc0": "licensed under cc0 1 0",
    "isc-under": "licensed under the isc license",
    "unlicense": "this is free and unencumbered software released into the public domain",
    "rights": "all rights reserved",
}
#: Sentences with changing parts: identifier and pattern of the whole normalised sentence.
PATTERNS = (
    ("copyright", "^(copyright|c copyright|copyright c) [0-9]{4}.*$"),
    ("bsd-neither", "^neither the names? of .* may be used to endorse or promote products derived from this software without specific prior written permission$"),
    ("bsd-neither", "^the names? of .* may not be used to endorse or promote products derived from this software without specific prior written permission$"),
    ("bsd-neither-start", "^neither the names? of .*$"),
    ("bsd-neither-end", "^nor the names? of .* may be used to endorse or promote products derived from this software without specific prior written permission$"),
    ("apache2-title", "^apache license$"),
    ("apache2-version", "^version 2 0 january 2004$"),
    ("apache2-title-version", "^apache license version 2 0 january 2004( http.*)?$"),
)
#: Rules in order: licence and the identifiers it takes, one after the other.
RULES = (
    ("Apache-2.0", ("apache2-grant-long", "apache2-comply", "apache2-copy")),
    ("Apache-2.0", ("apache2-grant", "apache2-comply", "apache2-copy")),
    ("Apache-2.0", ("apache2-grant-long",)),
    ("Apache-2.0", ("apache2-grant",)),
    ("Apache-2.0", ("apache2-short",)),
    ("MIT", ("mit-title", "mit-permission", "mit-notice")),
    ("MIT", ("mit-title-short", "mit-permission", "mit-notice")),
    ("MIT", ("mit-permission", "mit-notice")),
    ("MIT", ("mit-grant",)),
    ("MIT", ("mit-under",)),
    ("MIT", ("mit-project",)),
    ("MIT", ("mit-title",)),
    ("MIT", ("mit-title-short",)),
    ("AGPL-3.0", ("agpl3-under",)),
    ("LGPL-3.0", ("lgpl3-under",)),
    ("GPL-3.0-or-later", ("gpl-redistribute", "gpl-warranty", "gpl-copy")),
    ("GPL-3.0-or-later", ("gpl-redistribute",)),
    ("GPL-2.0-or-later", ("gpl2-redistribute", "gpl-warranty", "gpl-copy")),
    ("GPL-2.0-or-later", ("gpl2-redistribute",)),
    ("GPL-3.0", ("gpl3-work",)),
    ("GPL-3.0", ("gpl3-under",)),
    ("GPL-2.0", ("gpl2-under",)),
    ("BSD-2-Clause", ("bsd-redistribute", "bsd-source", "bsd-binary")),
    ("BSD-3-Clause", ("bsd3-under",)),
    ("BSD-2-Clause", ("bsd2-under",)),
    ("MPL-2.0", ("mpl2-terms",)),
    ("MPL-2.0", ("mpl2-under",)),
    ("CC-BY-NC-4.0", ("ccby-nc4",)),
    ("CC-BY-NC-4.0", ("ccby-nc4-work",)),
    ("CC-BY-SA-4.0", ("ccby-sa4",)),
    ("CC-BY-SA-4.0", ("ccby-sa4-work",)),
    ("CC-BY-4.0", ("ccby4",)),
    ("CC-BY-4.0", ("ccby4-work",)),
    ("CC-BY-4.0", ("cc-attribution4",)),
    ("CC0-1.0", ("cc0",)),
    ("ISC", ("isc-under",)),
    ("Unlicense", ("unlicense",)),
)
#: Rules that come before those.
_BSD2 = ("bsd-redistribute", "bsd-source", "bsd-binary")
FIRST_RULES = (
    ("BSD-3-Clause", (*_BSD2, "bsd-neither")),
    ("BSD-3-Clause", (*_BSD2, "bsd-neither-start", "bsd-neither-end")),
    ("Apache-2.0", ("apache2-title", "apache2-version")),
    ("Apache-2.0", ("apache2-title-version",)),
)
#: Names behind a lead-in or an SPDX tag, normalised, without article and ``license`` at the end.
NAMES = {
    "Apache-2.0": ("apache license version 2 0", "apache license 2 0", "apache license v2 0", "apache 2 0", "apache 2", "apache version 2 0", "asl 2 0"),
    "MIT": ("mit", "expat", "mit expat"),
    "BSD-3-Clause": ("bsd 3 clause", "3 clause bsd", "new bsd", "modified bsd"),
    "BSD-2-Clause": ("bsd 2 clause", "2 clause bsd", "simplified bsd"),
    "0BSD": ("0bsd",),
    "MPL-2.0": ("mpl 2 0", "mpl v2 0", "mozilla public license version 2 0", "mozilla public license v 2 0", "mozilla public license 2 0"),
    "EPL-2.0": ("epl 2 0", "eclipse public license 2 0", "eclipse public license version 2 0", "eclipse public license v 2 0"),
    "BSL-1.0": ("bsl 1 0", "boost software license 1 0", "boost software license version 1 0"),
    "Zlib": ("zlib",),
    "CC0-1.0": ("cc0 1 0", "cc0", "cc0 1 0 universal"),
    "ISC": ("isc",),
    "Unlicense": ("unlicense",),
} | {
    f"CC-{short.upper().replace(' ', '-')}-4.0": (f"cc {short} 4 0", f"creative commons {full} 4 0 international", f"creative commons {full} 4 0")
    for short, full in (
        ("by", "attribution"), ("by sa", "attribution sharealike"), ("by nd", "attribution noderivatives"), ("by nc", "attribution noncommercial"),
        ("by nc sa", "attribution noncommercial sharealike"), ("by nc nd", "attribution noncommercial noderivatives"),
    )
} | {
    f"{short.upper()}-{n}.{m}{end}": tuple(
        head + v + plus
        for head in (short, f"gnu {short}", full)
        for v in (f" {n} {m}", f" v{n} {m}", f"v{n} {m}", f" version {n} {m}", *((f" {n}", f" v{n}", f"v{n}", f" version {n}") if m == 0 else ()))
    )
    for short, full, versions in (
        ("gpl", "gnu general public license", ((2, 0), (3, 0))),
        ("lgpl", "gnu lesser general public license", ((2, 1), (3, 0))),
        ("agpl", "gnu affero general public license", ((3, 0),)),
    )
    for n, m in versions
    for end, plus in (("", ""), ("-or-later", "+"))
}
#: A sentence that holds nothing but a lead-in and names; group 1 is the names.
LEAD = (
    r"^(?:(?:this|the|all|our) (?:[a-z0-9]+ ){1,3}(?:is|are) )?(?:(?:dual )?licensed|released|distributed|published|provided|made available|available) "
    r"under (?:the terms of )?(.+?)(?: the license)?(?: at your option)?(?: see .*)?$"
)
SPDX = r"^spdx license identifier (.+)$"
#: In this order: later versions become a plus, exceptions go, names are parted, articles
#: and ``license`` around a name go.
_LATER = r" or (?:at your option )?(?:any )?later(?: version)?"
_EXCEPTION = r" with (?:[a-z0-9]+ )*?exception(?: [0-9]+)*"
_BETWEEN = r" (?:or|and) "
_AROUND = r"^(?:(?:the|an?|either|both|of) )+|(?: licenses?| only)+$"
#: ``GPL-2.0+`` in a text means a later version too.
_PLUS = r"(?i)(gpl[- ]?v?[0-9](?:\.[0-9])?)\+"
#: A list marker before a sentence or alone; none before ``copyright``, as in ``(c) Copyright``.
_MARKER = "^(?:[0-9]{1,3}|[a-z]|i{2,3}|iv|vi{0,3}|ix)"
#: Rules of ``Proprietary`` that hold only where nothing else is found.
NOTICES = (("copyright", "-", "-", "rights"), ("copyright", "-", "rights"), ("copyright", "rights"))
#: Every known sentence holds one of these, so a text without them has none.
MARKERS = (
    "(?i)licen[cs]e|copyright|permission|warranty|redistribut|reserved|public[^a-z0-9]+domain|january[^a-z0-9]+2004|neither[^a-z0-9]+the[^a-z0-9]+name"
    "|(released|distributed|published|provided|available)[^a-z0-9]+under"
)
_END = r"([.!?:])\s+"
#: The colon of this tag ends no sentence.
_TAG = "(?i)(spdx-license-identifier):[ \t]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _normal(sentence: Column) -> Column:
    low = F.translate(sentence, _UPPER, _LOWER)
    words = F.trim(F.regexp_replace(low, "[^a-z0-9]+", " "))
    return F.regexp_replace(words, r"\blicence\b", "license")


def _named(sentence: Column) -> Column:
    """Identifiers of the names in an SPDX tag or behind a lead-in; ``-`` for an unknown one."""
    names = F.create_map(*[F.lit(x) for licence, all_ in NAMES.items() for n in all_ for x in (n, f"named-{licence}")])
    tag = sentence.rlike(SPDX)
    said = F.when(tag, F.regexp_extract(sentence, SPDX, 1)).otherwise(F.regexp_extract(sentence, LEAD, 1))
    said = F.regexp_replace(F.regexp_replace(said, _LATER, "+"), _EXCEPTION, "")
    one = lambda name: F.coalesce(F.element_at(names, F.regexp_replace(name, _AROUND, "")), F.lit("-"))
    return F.when(tag | sentence.rlike(LEAD), F.transform(F.split(said, _BETWEEN), one)).otherwise(F.array(F.lit("-")))


def _identifiers(sentences: Column) -> Column:
    """Identifiers of the known sentences, in order; an unknown sentence between gives ``-``."""
    known = F.create_map(*[F.lit(x) for name, text in SENTENCES.items() for x in (text, name)])

    def one(s: Column) -> Column:
        out = F.element_at(known, s)
        for name, pattern in PATTERNS:
            out = F.coalesce(out, F.when(s.rlike(pattern), F.lit(name)))
        return F.coalesce(F.when(out.isNotNull(), F.array(out)), _named(s))

    def unmarked(s: Column) -> Column:
        return F.when(s.rlike(_MARKER + " copyright"), s).otherwise(F.regexp_replace(s, _MARKER + "(?: |$)", ""))

    normal = F.filter(F.transform(F.transform(sentences, _normal), unmarked), lambda s: s != "")
    return F.flatten(F.transform(normal, one))


def _rules() -> list[tuple[str, tuple[str, ...], bool]]:
    """All rules in order: licence, identifiers, and whether it holds only where no other licence is found."""
    ordered = [*FIRST_RULES, *RULES, *[(n, (f"named-{n}",)) for n in NAMES]]
    return [(n, ids, False) for n, ids in ordered] + [("Proprietary", ids, True) for ids in NOTICES] + [("Proprietary", ("rights",), False)]


def _matched(sequence: Column) -> Column:
    """Struct (licences, rest) of a sequence written as ``,a,,b,``."""
    rules = F.array(*[
        F.struct(F.lit(n).alias("licence"), F.lit("," + ",,".join(ids) + ",").alias("ids"), F.lit(alone).alias("alone"))
        for n, ids, alone in _rules()
    ])
    start = F.struct(F.array().cast("array<string>").alias("found"), sequence.alias("rest"))

    def step(acc: Column, rule: Column) -> Column:
        hit = F.contains(acc.rest, rule.ids)
        named = hit & ~(rule.alone & F.exists(acc.found, lambda n: n != "Proprietary"))
        found = F.when(named, F.array_union(acc.found, F.array(rule.licence))).otherwise(acc.found)
        return F.struct(found.alias("found"), F.when(hit, F.replace(acc.rest, rule.ids, F.lit(""))).otherwise(acc.rest).alias("rest"))

    return F.aggregate(rules, start, step)


def _written(identifiers: Column) -> Column:
    """Every identifier between commas of its own, so that rules may stand side by side."""
    return F.concat(F.lit(","), F.array_join(identifiers, ",,"), F.lit(","))


def recognise(docs: DataFrame) -> DataFrame:
    """doc_id, n_sentences (known ones), sentences, licenses and unmatched of every row."""
    text = F.regexp_replace(F.coalesce(F.col("text").cast("string"), F.lit("")), _TAG, "$1 ")
    text = F.when(text.rlike(MARKERS), F.regexp_replace(text, _PLUS, "$1 or later")).otherwise(text)
    lines = F.split(F.regexp_replace(text, _END, "$1\n"), r"[\r\n]+")
    paragraphs = F.split(text, r"\r?\n[ \t]*\r?\n")
    joined = F.flatten(
        F.transform(paragraphs, lambda p: F.split(F.regexp_replace(F.regexp_replace(p, r"\s+", " "), r"([.!?:]) ", "$1\n"), "\n"))
    )
    none = F.array().cast("array<string>")
    marked = text.rlike(MARKERS)
    ids = docs.select(
        "doc_id",
        F.when(marked, _identifiers(lines)).otherwise(none).alias("_a"),
        F.when(marked, _identifiers(joined)).otherwise(none).alias("_b"),
    )
    # The joined reading counts where it knows more than the reading by lines.
    known = lambda c: F.filter(c, lambda x: x != "-")
    more = F.size(F.array_except(known("_b"), known("_a"))) > 0
    ids = ids.withColumn("_ids", F.when(more, F.col("_b")).otherwise(F.col("_a")))
    out = ids.withColumn("_m", F.when(F.size(known("_ids")) > 0, _matched(_written(F.col("_ids")))))
    rest = F.filter(F.split(F.coalesce(F.col("_m.rest"), F.lit("")), ","), lambda x: (x != "") & (x != "-"))
    return out.select(
        "doc_id",
        F.size(known("_ids")).cast("long").alias("n_sentences"),
        F.array_join(known("_ids"), ",").alias("sentences"),
        F.array_join(F.coalesce(F.col("_m.found"), none), ",").alias("licenses"),
        F.array_join(rest, ",").alias("unmatched"),
    )


def recognise_sql() -> str:
    """The same in DuckDB SQL."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    known = ", ".join(f"({quoted(t)}, {quoted(n)})" for n, t in SENTENCES.items())
    patterns = " ".join(f"WHEN regexp_matches(s, {quoted(p)}) THEN [{quoted(n)}]" for n, p in PATTERNS)
    names = [(n, f"named-{licence}") for licence, all_ in NAMES.items() for n in all_]
    named = f"map([{', '.join(quoted(n) for n, _ in names)}], [{', '.join(quoted(i) for _, i in names)}])"
    rules = ", ".join(f"({i}, {quoted(n)}, {quoted(',' + ',,'.join(ids) + ',')}, {alone})" for i, (n, ids, alone) in enumerate(_rules(), 1))
    reading = """
{name}_s AS (
  SELECT doc_id, n, CASE WHEN regexp_matches(s, {mark_c}) THEN s ELSE regexp_replace(s, {mark}, '') END AS s
  FROM (
    SELECT doc_id, n, regexp_replace(trim(regexp_replace(translate(part, '{up}', '{low}'), '[^a-z0-9]+', ' ', 'g')), '\\blicence\\b', 'license', 'g') AS s
    FROM (SELECT doc_id, unnest({parts}) AS part, generate_subscripts({parts}, 1) AS n FROM marked))),
{name}_t AS (
  SELECT *, regexp_replace(regexp_replace(
    CASE WHEN regexp_matches(s, {spdx}) THEN regexp_extract(s, {spdx}, 1) ELSE regexp_extract(s, {lead}, 1) END, {later}, '+', 'g'), {exception}, '', 'g') AS said
  FROM {name}_s WHERE s <> ''),
{name} AS (
  SELECT doc_id, flatten(list(CASE WHEN k.id IS NOT NULL THEN [k.id] {patterns}
    WHEN regexp_matches(s, {spdx}) OR regexp_matches(s, {lead})
    THEN list_transform(string_split_regex(said, {between}), lambda p: coalesce({named}[regexp_replace(p, {around}, '', 'g')], '-')) ELSE ['-'] END ORDER BY n)) AS ids
  FROM {name}_t LEFT JOIN known k ON k.sentence = s GROUP BY doc_id)"""
    lines = r"string_split_regex(regexp_replace(text, '([.!?:])[\s\x0b]+', '\1' || chr(10), 'g'), '[\r\n]+')"
    one_line = r"string_split(regexp_replace(regexp_replace(p, '[\s\x0b]+', ' ', 'g'), '([.!?:]) ', '\1' || chr(10), 'g'), chr(10))"
    joined = rf"flatten(list_transform(string_split_regex(text, '\r?\n[ \t]*\r?\n'), lambda p: {one_line}))"
    said = {"spdx": SPDX, "lead": LEAD, "later": _LATER, "exception": _EXCEPTION, "between": _BETWEEN, "around": _AROUND}
    said |= {"mark": _MARKER + "(?: |$)", "mark_c": _MARKER + " copyright"}
    said = {k: quoted(v) for k, v in said.items()}
    fill = lambda name, parts: reading.format(name=name, parts=parts, patterns=patterns, named=named, up=_UPPER, low=_LOWER, **said)
    return f"""
WITH RECURSIVE known(sentence, id) AS (VALUES {known}),
rules(i, name, ids, alone) AS (VALUES {rules}),
marked AS (
  SELECT doc_id, regexp_replace(regexp_replace(text, {quoted(_TAG)}, '\\1 ', 'g'), {quoted(_PLUS)}, '\\1 or later', 'g') AS text
  FROM documents WHERE regexp_matches(text, {quoted(MARKERS)})),
{fill("by_line", lines)},
{fill("by_joined", joined)},
chosen AS (
  SELECT doc_id, CASE WHEN len(list_filter(b.ids, lambda x: x <> '-' AND NOT list_contains(coalesce(a.ids, []), x))) > 0 THEN b.ids ELSE a.ids END AS ids
  FROM by_line a FULL JOIN by_joined b USING (doc_id)),
seq AS (SELECT doc_id, list_filter(ids, lambda x: x <> '-') AS found, ',' || array_to_string(ids, ',,') || ',' AS rest FROM chosen),
walk AS (
  SELECT doc_id, 0 AS i, rest, []::VARCHAR[] AS names FROM seq WHERE len(found) > 0
  UNION ALL
  SELECT doc_id, r.i, replace(rest, r.ids, ''),
    CASE WHEN contains(rest, r.ids) AND NOT list_contains(names, r.name)
      AND NOT (r.alone AND len(list_filter(names, lambda x: x <> 'Proprietary')) > 0) THEN list_append(names, r.name) ELSE names END
  FROM walk w JOIN rules r ON r.i = w.i + 1),
done AS (SELECT doc_id, array_to_string(names, ',') AS licenses,
    array_to_string(list_filter(string_split(rest, ','), lambda x: x <> '' AND x <> '-'), ',') AS unmatched
  FROM walk WHERE i = {len(_rules())})
SELECT d.doc_id, coalesce(len(found), 0)::BIGINT AS n_sentences, coalesce(array_to_string(found, ','), '') AS sentences,
  coalesce(licenses, '') AS licenses, coalesce(unmatched, '') AS unmatched
FROM documents d LEFT JOIN seq USING (doc_id) LEFT JOIN done USING (doc_id)
"""
