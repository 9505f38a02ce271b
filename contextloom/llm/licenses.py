"""License scans by sentence rules.

A text is cut into sentences, twice: at line ends, and with wrapped lines joined. Normalised sentences that are known get
their identifiers; a license is found where the identifiers of one of its rules follow each other, in order, among the known
sentences of a cut. All of it is array functions on the rows, without a shuffle; texts without any word that every known
sentence has one of are passed over at once.

Null and empty texts have no sentences. Rows that repeat are reported each for itself. An empty table gives an empty result.
Other columns are left alone.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Sentences of public license texts and notices, by identifier.
SENTENCES = {
    "apache2-notice": "Licensed under the Apache License, Version 2.0.",
    "apache2-grant": 'Licensed under the Apache License, Version 2.0 (the "License").',
    "apache2-comply": "You may not use this file except in compliance with the License.",
    "apache2-copy": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "apache2-asis": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "apache2-see": "See the License for the specific language governing permissions and limitations under the License.",
    "mit-notice": "Released under the MIT License.",
    "mit-licensed": "Licensed under the MIT License.",
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "mit-notice-kept": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-asis": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
    "mit-liability": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "bsd-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd-notice": "Licensed under the BSD License.",
    "gpl3-notice": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-redistribute": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY",
    "gpl-implied": "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "gpl-see": "See the GNU General Public License for more details.",
    "mpl2-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "ccby4-notice": "Licensed under CC BY 4.0.",
    "ccbysa4-notice": "Licensed under CC BY-SA 4.0.",
    "ccbync4-notice": "Licensed under CC BY-NC 4.0.",
    "ccby4-long": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc0-notice": "Licensed under CC0 1.0.",
    "gpl2-notice": "This work is licensed under the GNU General Public License, version 2.",
    "gpl2-terms": "under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
    "lgpl3-notice": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "lgpl-see": "See the GNU Lesser General Public License for more details.",
    "agpl3-notice": "This work is licensed under the GNU Affero General Public License, version 3.",
    "agpl-see": "See the GNU Affero General Public License for more details.",
    "epl2-notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
    "bsl1-grant": 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:',
    "bsl1-notice": "Distributed under the Boost Software License, Version 1.0.",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "psf-notice": "Licensed to PSF under a Contributor Agreement.",
    "ccbynd4-notice": "Licensed under CC BY-ND 4.0.",
    "ccbyncsa4-notice": "Licensed under CC BY-NC-SA 4.0.",
    "ccbysa4-long": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "unlicense": "This is free and unencumbered software released into the public domain; no license applies.",
}

#: Fixed values: (license, identifiers that must follow each other in this order).
RULES = [
    ("Apache-2.0", ["apache2-notice"]),
    ("Apache-2.0", ["apache2-grant", "apache2-comply", "apache2-copy", "apache2-asis", "apache2-see"]),
    ("Apache-2.0", ["apache2-grant", "apache2-comply"]),
    ("AGPL-3.0", ["agpl3-notice"]),
    ("AGPL-3.0", ["agpl-see"]),
    ("BSL-1.0", ["bsl1-grant"]),
    ("BSL-1.0", ["bsl1-notice"]),
    ("BSD-2-Clause", ["bsd-redistribution", "bsd-source", "bsd-binary"]),
    ("BSD-3-Clause", ["bsd-redistribution", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("BSD", ["bsd-notice"]),
    ("CC-BY-4.0", ["ccby4-notice"]),
    ("CC-BY-4.0", ["ccby4-long"]),
    ("CC-BY-NC-4.0", ["ccbync4-notice"]),
    ("CC-BY-SA-4.0", ["ccbysa4-notice"]),
    ("CC-BY-NC-SA-4.0", ["ccbyncsa4-notice"]),
    ("CC-BY-ND-4.0", ["ccbynd4-notice"]),
    ("CC-BY-SA-4.0", ["ccbysa4-long"]),
    ("CC0-1.0", ["cc0-notice"]),
    ("EPL-2.0", ["epl2-notice"]),
    ("GPL-2.0", ["gpl2-notice"]),
    ("GPL-2.0", ["gpl2-terms"]),
    ("GPL-3.0", ["gpl3-notice"]),
    ("GPL-3.0", ["gpl-redistribute", "gpl-hope", "gpl-implied", "gpl-see"]),
    ("GPL-3.0", ["gpl-redistribute"]),
    ("ISC", ["isc-grant"]),
    ("LGPL-3.0", ["lgpl3-notice"]),
    ("LGPL-3.0", ["lgpl-see"]),
    ("MIT", ["mit-notice"]),
    ("MIT", ["mit-licensed"]),
    ("MIT", ["mit-grant", "mit-notice-kept", "mit-asis", "mit-liability"]),
    ("MIT", ["mit-grant", "mit-notice-kept"]),
    ("MPL-2.0", ["mpl2-notice"]),
    ("PSF-2.0", ["psf-notice"]),
    ("Unlicense", ["unlicense"]),
    ("Zlib", ["zlib-grant"]),
]

#: Every known sentence has one of these.
CUES = ("licen", "permission", "copyright", "warrant", "redistribut")

#: Where a cut ends a sentence within a line.
ENDS = "(?<=[.!?;:])[ \\t]+"


def normalise(sentence: str) -> str:
    return re.sub(r"[^a-z0-9]+", " ", sentence.lower()).strip()


def _maximal() -> list[tuple[str, str, list[str]]]:
    """(license, rule as text, longer rules of other licenses that contain it): such a rule counts only where none of them does."""
    mark = lambda ids: f",{','.join(ids)},"
    return [(name, mark(ids), [mark(o) for other, o in RULES if other != name and len(o) > len(ids) and mark(ids) in mark(o)]) for name, ids in RULES]


def _parts() -> dict[str, list[str]]:
    """The normalised parts that the cut makes of each known sentence: some hold a sentence end inside."""
    return {k: [normalise(p) for p in re.split(ENDS, s)] for k, s in SENTENCES.items()}


def _known(sentences: Column) -> Column:
    """Identifiers of the known sentences, in order, as ",a,b,". A sentence that the cut divides counts where all its parts
    follow each other with nothing between."""
    parts = _parts()
    names = {k: [k] if len(ps) == 1 else [f"{k}/{i}" for i in range(len(ps))] for k, ps in parts.items()}
    table = {p: n for k, ps in parts.items() for p, n in zip(ps, names[k], strict=True)}
    # A part without a cue is looked for by its longest word.
    cues = [*CUES, *sorted({max(p.split(), key=len) for p in table if not any(c in p for c in CUES)})]
    pairs = F.create_map(*(F.lit(x) for kv in table.items() for x in kv))
    plain = lambda s: F.trim(F.regexp_replace(s, "[^a-z0-9]+", " "))
    name = lambda s: F.when(reduce(lambda a, b: a | b, (s.contains(c) for c in cues)), F.coalesce(pairs[plain(s)], F.lit("?"))).otherwise(F.lit("?"))
    out = F.concat(F.array_join(F.transform(sentences, name), ","), F.lit(","))
    for k, ns in names.items():
        if len(ns) > 1:
            out = F.replace(out, F.lit(f"{','.join(ns)},"), F.lit(f"{k},"))
    return F.concat(F.lit(","), F.regexp_replace(out, "(?:\\?|[a-z0-9-]+/[0-9]+),", ""))


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: n_known (known sentences, by lines or joined, whichever is more), sentence_ids (of that cut),
    licenses (sorted, joined by commas), n_licenses."""
    text = F.lower(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    any_cue = reduce(lambda a, b: a | b, (F.col("t").contains(c) for c in CUES))
    t = docs.select(F.col(id_col), text.alias("t")).withColumn("t", F.when(any_cue, F.col("t")).otherwise(F.lit("")))
    lines = F.split("t", f"\\n|{ENDS}")
    joined = F.split(F.regexp_replace("t", "([^\\n])\\n(?=[^\\n])", "$1 "), f"\\n\\n+|{ENDS}")
    t = t.select(id_col, _known(lines).alias("a"), _known(joined).alias("b"))
    inside = lambda rule: F.col("a").contains(rule) | F.col("b").contains(rule)
    hits = []
    for name, rule, longer in _maximal():
        ok = inside(rule)
        for o in longer:
            ok = ok & ~inside(o)
        hits.append(F.when(ok, F.lit(name)))
    n = lambda c: F.length(c) - F.length(F.replace(F.col(c), F.lit(","), F.lit("")))
    more = n("a") >= n("b")
    found = F.array_sort(F.array_distinct(F.array_compact(F.array(*hits))))
    best = F.when(more, F.col("a")).otherwise(F.col("b"))
    out = t.select(id_col, F.when(best == ",", F.lit("")).otherwise(F.trim(best, F.lit(","))).alias("sentence_ids"), found.alias("f"))
    count = F.when(F.col("sentence_ids") == "", 0).otherwise(F.size(F.split("sentence_ids", ",")))
    return out.select(id_col, count.cast("long").alias("n_known"), "sentence_ids", F.array_join("f", ",").alias("licenses"), F.size("f").cast("long").alias("n_licenses"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def oracle() -> str:
    """The same scan for DuckDB."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    known = ", ".join(f"({quote(normalise(s))}, {quote(k)})" for k, s in SENTENCES.items())
    rules = ", ".join(f"({quote(n)}, {quote(r)}, {'[' + ', '.join(map(quote, o)) + ']' if o else 'CAST([] AS VARCHAR[])'})" for n, r, o in _maximal())
    return rf"""
WITH known(s, id) AS (VALUES {known}),
rules(license, rule, longer) AS (VALUES {rules}),
t AS (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents),
-- RE2 looks neither ahead nor behind: a mark goes after each sentence end and for each line end.
m AS (SELECT doc_id, regexp_replace(t, '([.!?;:])[ \t]+', '\1' || chr(1), 'g') AS l,
             regexp_replace(regexp_replace(regexp_replace(t, '\n\n+', chr(2), 'g'), '\n', ' ', 'g'), '([.!?;:])[ \t]+', '\1' || chr(1), 'g') AS j FROM t),
s AS (SELECT doc_id, 'a' AS cut, string_split(replace(l, chr(10), chr(1)), chr(1)) AS ss FROM m
      UNION ALL SELECT doc_id, 'b', string_split(replace(j, chr(2), chr(1)), chr(1)) FROM m),
u AS (SELECT doc_id, cut, unnest(ss) AS x, generate_subscripts(ss, 1) AS k FROM s),
i AS (SELECT doc_id, cut, list(id ORDER BY k) AS ids FROM u JOIN known ON known.s = trim(regexp_replace(x, '[^a-z0-9]+', ' ', 'g')) GROUP BY 1, 2),
w AS (SELECT t.doc_id, coalesce(a.ids, []) AS a, coalesce(b.ids, []) AS b FROM t LEFT JOIN i a ON a.doc_id = t.doc_id AND a.cut = 'a' LEFT JOIN i b ON b.doc_id = t.doc_id AND b.cut = 'b'),
v AS (SELECT doc_id, CASE WHEN len(a) >= len(b) THEN a ELSE b END AS ids, ',' || array_to_string(a, ',') || ',' AS a, ',' || array_to_string(b, ',') || ',' AS b FROM w),
f AS (SELECT doc_id, list_sort(list(DISTINCT license)) AS f FROM v JOIN rules ON (contains(a, rule) OR contains(b, rule))
      WHERE len(list_filter(longer, lambda o: contains(a, o) OR contains(b, o))) = 0 GROUP BY doc_id)
SELECT v.doc_id, CAST(len(ids) AS BIGINT) AS n_known, array_to_string(ids, ',') AS sentence_ids, coalesce(array_to_string(f, ','), '') AS licenses, CAST(coalesce(len(f), 0) AS BIGINT) AS n_licenses
FROM v LEFT JOIN f USING (doc_id)
"""
