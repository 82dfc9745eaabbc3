"""Licence scan by sentence rules, with DataFrame functions only and without a shuffle.

A text (A-Z lowered) is cut into sentences at ``. ; : ! ?`` before white space, but not in ``v. 2.0`` and not after an SPDX
tag. Sentences are normalised (runs of other characters than a-z and 0-9 become one space) and looked up among known
licence sentences. One that isn't known is tried paragraph by paragraph (blank lines part them), what isn't known then
without the title and copyright lines in it, and what isn't known then line by line: the largest known form counts. The
identifiers found, in order, form the document's sequence. A rule is a sequence of identifiers that must occur in this
order, other identifiers between them allowed, but none before one that the rule marks with ``+``; all rules that match name
their licence.

The rows are those of the input. Null and empty texts, and texts without a licence, have no identifiers and no licence
(empty strings, 0). Nothing depends on a text's or sentence's length; repeated rows are reported each; other columns,
whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Identifier and normalised form of licence sentences, from the published texts.
SENTENCES = {
    "mit.title": "the mit license",
    "mit.title2": "mit license",
    "mit.released": "released under the mit license",
    "mit.licensed": "licensed under the mit license",
    "mit.grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit.notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit.warranty": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "apache.title": "apache license",
    "apache.licensed": "licensed under the apache license version 2 0",
    "apache.licensed2": "licensed under the apache license version 2 0 the license",
    "apache.copy": "you may not use this file except in compliance with the license",
    "apache.obtain": "you may obtain a copy of the license at",
    "apache.basis": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache.defined": "license shall mean the terms and conditions for use reproduction and distribution as defined by sections 1 through 9 of this document",
    "gpl.work2": "this work is licensed under the gnu general public license version 2 0",
    "gpl.work3": "this work is licensed under the gnu general public license version 3 0",
    "gpl.work2i": "this work is licensed under the gnu general public license version 2",
    "gpl.work3i": "this work is licensed under the gnu general public license version 3",
    "gpl.free": "this program is free software",
    "gpl.terms": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "gpl.terms2": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl.terms2o": "you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation",
    "gpl.terms3": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl.v2": "either version 2 of the license or at your option any later version",
    "gpl.v2o": "version 2 of the license",
    "gpl.v3": "either version 3 of the license or at your option any later version",
    "gpl.guarantee2": "by contrast the gnu general public license is intended to guarantee your freedom to share and change free software to make sure the software is free for all its users",
    "gpl.copyleft3": "the gnu general public license is a free copyleft license for software and other kinds of works",
    "lgpl.free": "this library is free software",
    "lgpl.terms": "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation",
    "lgpl.terms21": "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    "lgpl.terms3": "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "lgpl.v21": "either version 2 1 of the license or at your option any later version",
    "lgpl.designated": "this license the lesser general public license applies to some specially designated software packages typically libraries of the free software foundation and other authors who decide to use it",
    "lgpl.incorporates": "this version of the gnu lesser general public license incorporates the terms and conditions of version 3 of the gnu general public license supplemented by the additional permissions listed below",
    "agpl.terms": "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "agpl.copyleft": "the gnu affero general public license is a free copyleft license for software and other kinds of works specifically designed to ensure cooperation with the community in the case of network server software",
    "bsd.grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd.source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd.binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd.names": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd.disclaimer": "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    "mpl.terms": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "mpl.title": "mozilla public license version 2 0",
    "isc.grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "isc.grant2": "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "cc0.dedicated": "this work is licensed under cc0 1 0 universal license",
    "unlicense.free": "this is free and unencumbered software released into the public domain",
    "spdx.mit": "spdx license identifier mit",
    "spdx.apache": "spdx license identifier apache 2 0",
    "spdx.gpl2": "spdx license identifier gpl 2 0 only",
    "spdx.gpl2l": "spdx license identifier gpl 2 0 or later",
    "spdx.gpl3": "spdx license identifier gpl 3 0 only",
    "spdx.gpl3l": "spdx license identifier gpl 3 0 or later",
    "spdx.lgpl21": "spdx license identifier lgpl 2 1 only",
    "spdx.lgpl21l": "spdx license identifier lgpl 2 1 or later",
    "spdx.agpl3": "spdx license identifier agpl 3 0 only",
    "spdx.agpl3l": "spdx license identifier agpl 3 0 or later",
    "spdx.bsd2": "spdx license identifier bsd 2 clause",
    "spdx.bsd3": "spdx license identifier bsd 3 clause",
    "spdx.isc": "spdx license identifier isc",
    "spdx.mpl": "spdx license identifier mpl 2 0",
}
# Licence and the identifiers that must follow each other.
RULES = (
    ("MIT", ("mit.released",)),
    ("MIT", ("mit.licensed",)),
    ("MIT", ("mit.grant", "mit.notice", "mit.warranty")),
    ("MIT", ("spdx.mit",)),
    ("Apache-2.0", ("apache.licensed",)),
    ("Apache-2.0", ("apache.licensed2", "apache.copy")),
    ("Apache-2.0", ("apache.title", "apache.defined")),
    ("Apache-2.0", ("spdx.apache",)),
    ("GPL-2.0", ("gpl.work2",)),
    ("GPL-2.0", ("gpl.work2i",)),
    ("GPL-2.0", ("gpl.terms2",)),
    ("GPL-2.0", ("gpl.terms2o",)),
    ("GPL-2.0", ("gpl.terms", "+gpl.v2")),
    ("GPL-2.0", ("gpl.terms", "+gpl.v2o")),
    ("GPL-2.0", ("gpl.guarantee2",)),
    ("GPL-2.0", ("spdx.gpl2",)),
    ("GPL-2.0", ("spdx.gpl2l",)),
    ("GPL-3.0", ("gpl.work3",)),
    ("GPL-3.0", ("gpl.work3i",)),
    ("GPL-3.0", ("gpl.terms3",)),
    ("GPL-3.0", ("gpl.terms", "+gpl.v3")),
    ("GPL-3.0", ("gpl.copyleft3",)),
    ("GPL-3.0", ("spdx.gpl3",)),
    ("GPL-3.0", ("spdx.gpl3l",)),
    ("LGPL-2.1", ("lgpl.terms21",)),
    ("LGPL-2.1", ("lgpl.terms", "+lgpl.v21")),
    ("LGPL-2.1", ("lgpl.designated",)),
    ("LGPL-2.1", ("spdx.lgpl21",)),
    ("LGPL-2.1", ("spdx.lgpl21l",)),
    ("LGPL-3.0", ("lgpl.terms3",)),
    ("LGPL-3.0", ("lgpl.incorporates",)),
    ("AGPL-3.0", ("agpl.terms",)),
    ("AGPL-3.0", ("agpl.copyleft",)),
    ("AGPL-3.0", ("spdx.agpl3",)),
    ("AGPL-3.0", ("spdx.agpl3l",)),
    ("BSD-3-Clause", ("bsd.grant", "bsd.source", "bsd.binary", "bsd.names")),
    ("BSD-3-Clause", ("spdx.bsd3",)),
    ("BSD-2-Clause", ("bsd.grant", "bsd.source", "bsd.binary", "+bsd.disclaimer")),
    ("BSD-2-Clause", ("spdx.bsd2",)),
    ("BSD-style", ("bsd.grant", "bsd.source", "bsd.binary")),
    ("MPL-2.0", ("mpl.terms",)),
    ("MPL-2.0", ("mpl.title",)),
    ("MPL-2.0", ("spdx.mpl",)),
    ("ISC", ("isc.grant",)),
    ("ISC", ("isc.grant2",)),
    ("ISC", ("spdx.isc",)),
    ("CC0-1.0", ("cc0.dedicated",)),
    ("Unlicense", ("unlicense.free",)),
)
# The Creative Commons licences and their names.
CREATIVE_COMMONS = {
    "BY": "attribution",
    "BY-SA": "attribution sharealike",
    "BY-NC": "attribution noncommercial",
    "BY-NC-SA": "attribution noncommercial sharealike",
    "BY-ND": "attribution noderivatives",
    "BY-NC-ND": "attribution noncommercial noderivatives",
}
for _code, _name in CREATIVE_COMMONS.items():
    _id, _short = f"cc{_code.lower().replace('-', '')}", _code.lower().replace("-", " ")
    SENTENCES |= {
        f"{_id}.licensed": f"licensed under cc {_short} 4 0",
        f"{_id}.work": f"this work is licensed under cc {_short} 4 0",
        f"{_id}.international": f"this work is licensed under a creative commons {_name} 4 0 international license",
        f"{_id}.international2": f"this work is licensed under the creative commons {_name} 4 0 international license",
    }
    RULES += tuple((f"CC-{_code}-4.0", (f"{_id}.{form}",)) for form in ("licensed", "work", "international", "international2"))
#: A word of every known sentence holds one of these; texts without them need no further look.
ANCHORS = ("licen", "permission", "redistribut", "software")

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# All patterns read alike in the regular expressions of Java and of RE2.
_VERSION = r"(^|[^a-z0-9])v\.([ \t\n\r\f][^a-z0-9]*[0-9])"
_TAG = r"(spdx-license-identifier):"
_STOP = r"[.;:!?]+([ \t\n\r\f]|\z)"
_BLANK = r"\n([^a-z0-9\n]*\n)+"
#: Lines that end without a stop and aren't part of the sentence below: copyright, rights reserved, title.
_HEAD = (
    r"^[^a-z0-9]*(copyright([^a-z0-9]|$)|\(c\)|\x{a9}|all rights reserved"
    r"|([^\n]{0,60}[^a-z0-9])?licen[sc]e( \([a-z0-9 .-]+\))?(,? v(ersion)?\.? ?[0-9.]+)?[^a-z0-9]*$)"
)
_NO_HEAD = r"^[^a-z0-9]*copyright[^a-z0-9]*(notice|holder|owner|law)s?([^a-z0-9]|$)"


def _normalised(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, "[^a-z0-9]+", " "))


def _pattern(rule: tuple[str, ...]) -> str:
    first, *rest = (x.replace(".", "[.]") for x in rule)
    return "(^| )" + first + "".join(f" {x[1:]}" if x.startswith("+") else f"( [^|]*)? {x}" for x in rest) + "( |$)"


def sentence_ids(text: Column) -> Column:
    """Identifiers of the licence sentences of a text, in order."""
    known = F.create_map(*[F.lit(x) for i, s in SENTENCES.items() for x in (s, i)])
    found = lambda s: F.try_element_at(known, _normalised(s))
    else_by = lambda s, parts: F.when(found(s).isNotNull(), F.array(found(s))).otherwise(parts)
    each = lambda parts, f: F.flatten(F.transform(parts, f))
    lines = lambda s: F.filter(F.transform(F.split(s, "\n"), found), lambda i: i.isNotNull())
    set_apart = lambda line: F.when(line.rlike(_HEAD) & ~line.rlike(_NO_HEAD), F.concat(F.lit("\x02"), line, F.lit("\x02"))).otherwise(line)
    below_heads = lambda p: F.split(F.array_join(F.transform(F.split(p, "\n"), set_apart), "\n"), "\x02")
    of_paragraph = lambda p: else_by(p, F.when(p.contains("\n"), each(below_heads(p), lambda q: else_by(q, lines(q)))).otherwise(F.array().cast("array<string>")))
    of_sentence = lambda s: else_by(s, F.when(s.contains("\n"), each(F.split(s, _BLANK), of_paragraph)).otherwise(F.array().cast("array<string>")))
    plain = F.regexp_replace(F.regexp_replace(F.translate(text, _UPPER, _LOWER), _VERSION, "$1v $2"), _TAG, "$1 ")
    return each(F.split(F.regexp_replace(plain, _STOP, "\x01"), "\x01"), of_sentence)


def scan_licenses(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_sentences (licence sentences found), sentence_ids and licenses (sorted, joined by a space)."""
    anchored = F.col(text).rlike("(?i)" + "|".join(ANCHORS))
    ids = F.when(anchored, sentence_ids(F.col(text))).otherwise(F.array().cast("array<string>"))
    rows = docs.select(F.col(doc_id).alias("doc_id"), ids.alias("ids")).select("doc_id", F.size("ids").cast("long").alias("n_sentences"), F.array_join("ids", " ").alias("sentence_ids"))
    named = F.array_compact(F.array(*[F.when(F.col("sentence_ids").rlike(_pattern(rule)), F.lit(name)) for name, rule in RULES]))
    licenses = F.when(F.col("sentence_ids") == "", F.lit("")).otherwise(F.array_join(F.array_sort(F.array_distinct(named)), " "))
    return rows.withColumn("licenses", licenses)


def _oracle() -> str:
    """The same sentence by sentence, without anchors."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    known = f"MAP {{{', '.join(f'{quote(s)}: {quote(i)}' for i, s in SENTENCES.items())}}}"
    rules = ", ".join(f"CASE WHEN regexp_matches(sentence_ids, {quote(_pattern(r))}) THEN {quote(n)} END" for n, r in RULES)
    found = lambda s: f"k[trim(regexp_replace({s}, '[^a-z0-9]+', ' ', 'g'))]"
    else_by = lambda s, parts: f"CASE WHEN {found(s)} IS NOT NULL THEN [{found(s)}] ELSE {parts} END"
    each = lambda parts, v, body: f"flatten(list_transform({parts}, lambda {v}: {body}))"
    lines = f"list_filter(list_transform(string_split(q, chr(10)), lambda l: {found('l')}), lambda i: i IS NOT NULL)"
    heads = f"string_split(array_to_string(list_transform(string_split(p, chr(10)), lambda h: CASE WHEN regexp_matches(h, {quote(_HEAD)}) AND NOT regexp_matches(h, {quote(_NO_HEAD)}) THEN chr(2) || h || chr(2) ELSE h END), chr(10)), chr(2))"
    paragraph = else_by("p", f"CASE WHEN contains(p, chr(10)) THEN {each(heads, 'q', else_by('q', lines))} ELSE [] END")
    paragraphs = f"string_split(regexp_replace(s, {quote(_BLANK)}, chr(2), 'g'), chr(2))"
    sentence = else_by("s", f"CASE WHEN contains(s, chr(10)) THEN {each(paragraphs, 'p', paragraph)} ELSE [] END")
    return f"""
WITH t AS (SELECT doc_id, regexp_replace(regexp_replace(translate(text, '{_UPPER}', '{_LOWER}'), {quote(_VERSION)}, '\\1v \\2', 'g'), {quote(_TAG)}, '\\1 ', 'g') AS plain FROM documents),
c AS (SELECT doc_id, {known} AS k, string_split(regexp_replace(plain, {quote(_STOP)}, chr(1), 'g'), chr(1)) AS cut FROM t),
s AS (SELECT doc_id, coalesce({each('cut', 's', sentence)}, []) AS ids FROM c),
j AS (SELECT doc_id, CAST(len(ids) AS BIGINT) AS n_sentences, coalesce(array_to_string(ids, ' '), '') AS sentence_ids FROM s)
SELECT doc_id, n_sentences, sentence_ids,
       CASE WHEN sentence_ids = '' THEN '' ELSE array_to_string(list_sort(list_distinct(list_filter([{rules}], lambda x: x IS NOT NULL))), ' ') END AS licenses
FROM j
"""


ORACLE_SQL = _oracle()
