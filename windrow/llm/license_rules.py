"""Licence recognition by sentence rules, in DataFrame functions only.

A text is cut into sentences, each normalised and looked up among known licence sentences; a sentence may be wrapped over lines,
and one that is not known as a whole is looked up line by line.  The identifiers found, in text order, form a sequence.  Licence rules are ordered sequences of identifiers; the first rule in the list whose sequence occurs in the
text's sequence without a gap names the licence of those sentences, longer rules standing before their own parts.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from windrow.llm.common import BLANK, whole_text

#: fixed values: licence sentences, normalised, and their identifiers
SENTENCES = {
    "licensed under the apache license version 2 0": "apache2",
    "licensed under the apache license version 2 0 the license": "apache2",
    "you may not use this file except in compliance with the license": "apache2use",
    "you may obtain a copy of the license at": "apache2copy",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis": "apache2asis",
    "see the license for the specific language governing permissions and limitations under the license": "apache2see",
    "released under the mit license": "mit",
    "licensed under the mit license": "mit",
    "this software is released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "mitgrant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mitnotice",
    "the software is provided as is without warranty of any kind": "mitasis",
    "this work is licensed under the gnu general public license version 3": "gpl3",
    "this work is licensed under the gnu general public license version 2": "gpl2",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license": "gplfree",
    "either version 3 of the license or at your option any later version": "gpl3later",
    "either version 2 of the license or at your option any later version": "gpl2later",
    "either version 2 1 of the license or at your option any later version": "lgpl21later",
    "this program is distributed in the hope that it will be useful": "gplhope",
    "licensed under cc by 4 0": "ccby4",
    "licensed under cc by sa 4 0": "ccbysa4",
    "licensed under cc by nc 4 0": "ccbync4",
    "this work is licensed under a creative commons attribution 4 0 international license": "ccby4",
    "redistributions of source code must retain the above copyright notice": "bsdsource",
    "redistributions in binary form must reproduce the above copyright notice": "bsdbinary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products": "bsdendorse",
    "all rights reserved": "reserved",
    "this source code form is subject to the terms of the mozilla public license v": "mpl2",
    "licensed under the mozilla public license version 2 0": "mpl2",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "distributed under the boost software license version 1 0": "bsl1",
    "licensed under the isc license": "isc",
    "released under the zlib license": "zlib",
    "this work is licensed under the gnu lesser general public license version 3": "lgpl3",
    "this work is licensed under the gnu affero general public license version 3": "agpl3",
    "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0": "epl2",
}

#: fixed values: ordered rules, identifier sequence and licence
RULES = (
    (("apache2", "apache2use", "apache2copy", "apache2asis", "apache2see"), "Apache-2.0"),
    (("apache2", "apache2use"), "Apache-2.0"),
    (("apache2",), "Apache-2.0"),
    (("mitgrant", "mitnotice", "mitasis"), "MIT"),
    (("mitgrant", "mitasis"), "MIT"),
    (("mit",), "MIT"),
    (("gplfree", "gpl3later"), "GPL-3.0-or-later"),
    (("gplfree", "gpl2later"), "GPL-2.0-or-later"),
    (("gpl3",), "GPL-3.0"),
    (("gpl2",), "GPL-2.0"),
    (("ccbync4",), "CC-BY-NC-4.0"),
    (("ccbysa4",), "CC-BY-SA-4.0"),
    (("ccby4",), "CC-BY-4.0"),
    (("bsdsource", "bsdbinary", "bsdendorse"), "BSD-3-Clause"),
    (("bsdsource", "bsdbinary"), "BSD-2-Clause"),
    (("mpl2",), "MPL-2.0"),
    (("unlicense",), "Unlicense"),
    (("bsl1",), "BSL-1.0"),
    (("isc",), "ISC"),
    (("zlib",), "Zlib"),
    (("lgpl3",), "LGPL-3.0"),
    (("agpl3",), "AGPL-3.0"),
    (("epl2",), "EPL-2.0"),
    (("reserved",), "proprietary"),
)

#: fixed values: whole sentences of the licence texts as ``sentences`` cuts and normalises them, beside SENTENCES
WHOLE_SENTENCES = {
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis "
    "without warranties or conditions of any kind either express or implied": "apache2asis",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software "
    "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense "
    "and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mitgrant",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability "
    "fitness for a particular purpose and noninfringement": "mitasis",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation": "gplfree",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the "
    "free software foundation": "gplfree",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation "
    "either version 3 of the license or at your option any later version": "gplfree3later",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation "
    "either version 2 of the license or at your option any later version": "gplfree2later",
    "this program is distributed in the hope that it will be useful but without any warranty": "gplhope",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsdsource",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation "
    "and or other materials provided with the distribution": "bsdbinary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
    "without specific prior written permission": "bsdendorse",
    "neither the name of the university nor the names of its contributors may be used to endorse or promote products derived from this software "
    "without specific prior written permission": "bsdendorse",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above "
    "copyright notice and this permission notice appear in all copies": "isc",
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely "
    "subject to the following restrictions": "zlib",
    "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation": "lgplfree",
    "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation "
    "either version 3 of the license or at your option any later version": "lgplfree3later",
    "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation "
    "either version 3 of the license or at your option any later version": "agpl3later",
    "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0": "mpl2copy",
}

#: fixed values: rules of whole texts, before RULES; a BSD text's own "All rights reserved" names no second licence
WHOLE_RULES = (
    (("gplfree3later",), "GPL-3.0-or-later"),
    (("gplfree2later",), "GPL-2.0-or-later"),
    (("lgplfree3later",), "LGPL-3.0-or-later"),
    (("lgplfree", "gpl3later"), "LGPL-3.0-or-later"),
    (("lgplfree", "lgpl21later"), "LGPL-2.1-or-later"),
    (("agpl3later",), "AGPL-3.0-or-later"),
    (("mpl2", "mpl2copy"), "MPL-2.0"),
    (("reserved", "bsdsource", "bsdbinary", "bsdendorse"), "BSD-3-Clause"),
    (("reserved", "bsdsource", "bsdbinary"), "BSD-2-Clause"),
)

#: fixed values: stems one of which every known sentence holds; a text without any is not cut into sentences
STEMS = "licen[cs]e|software|redistribut|copyright|program|reserved|mpl"


def normalised(sentence: Column) -> Column:
    """A-Z lower-cased, every run of characters other than a-z and 0-9 one space, trimmed."""
    return F.trim(F.regexp_replace(F.translate(sentence, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), "[^a-z0-9]+", " "))


def sentences(text: Column) -> Column:
    """Sentences in text order, as they stand: one ends at a line without letters and digits, or at one of ``.!?;:`` before white space or the end."""
    return F.split(text, f"\\n[^A-Za-z0-9\\n]*(?=\\n)|[.!?;:](?=[{BLANK}]|\\z)")


def sentence_ids(text: Column, sentences_known: dict[str, str], tails: dict[str, str]) -> Column:
    """Identifiers of the known sentences in text order: of a whole sentence, line feeds as white space, or else of its lines.

    ``tails`` are long sentences that are also known after a title or copyright line without a full stop.
    """
    lookup = F.create_map(*[F.lit(x) for x in chain.from_iterable(sentences_known.items())])

    def known(x: Column) -> Column:
        # a set of literals is looked up by its hash, the map from its start: only sentences that are known reach the map
        return F.when(x.isin(*sentences_known), lookup[x])

    def parts(sentence: Column) -> Column:
        return F.struct(normalised(sentence).alias("whole"), F.transform(F.split(sentence, "\n"), lambda x: known(normalised(x))).alias("lines"))

    def found(s: Column) -> Column:
        tail = F.coalesce(F.lit(None).cast("string"), *[F.when(F.endswith(s["whole"], F.lit(" " + x)), F.lit(tails[x])) for x in sorted(tails, key=len, reverse=True)])
        whole = known(s["whole"])
        return F.when(whole.isNotNull(), F.array(whole)).otherwise(F.concat(s["lines"], F.array(F.when(F.element_at(s["lines"], -1).isNull(), tail))))

    return F.filter(F.flatten(F.transform(F.transform(sentences(text), parts), found)), lambda x: x.isNotNull())


def licence_scan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", known: dict[str, str] | None = None,
                 rules: Sequence[tuple[Sequence[str], str]] = WHOLE_RULES + RULES, stems: str = STEMS) -> DataFrame:
    """Per row: the id, n_known (known sentences), sequence (their identifiers, space-joined), licences (space-joined, in rule order).

    A rule matches where its identifiers stand next to each other in the sequence; what an earlier rule has matched is no
    longer open to later ones, so a part of a longer text does not name a second licence.  Texts are read whole, in a row of
    their own: no shuffle.  ``stems`` is a pattern that every known sentence contains (give ``.`` with a list of your own).  Null and empty texts give 0 and empty strings; repeated rows give repeated results.
    """
    known = known or SENTENCES | WHOLE_SENTENCES
    text = whole_text(text_column)
    ids = sentence_ids(text, known, {k: v for k, v in known.items() if k in WHOLE_SENTENCES})
    out = docs.select(F.col(id_column), F.when(text.rlike(f"(?i){stems}"), ids).otherwise(F.array().cast("array<string>")).alias("_ids"))
    # every identifier between bars, so that neighbours are found as text; matched stretches leave a bar
    rest = out.withColumns({"n_known": F.size("_ids").cast("long"), "sequence": F.array_join("_ids", " "),
                            "_rest": F.concat(F.lit("|"), F.array_join(F.transform("_ids", lambda x: F.concat(x, F.lit("|"))), "|"))})
    found = []
    for number, (parts, name) in enumerate(rules):
        needle = "|" + "||".join(parts) + "|"
        rest = rest.withColumn(f"_m{number}", F.when(F.contains("_rest", F.lit(needle)), F.lit(name))).withColumn("_rest", F.replace("_rest", F.lit(needle), F.lit("#")))
        found.append(F.col(f"_m{number}"))
    return rest.select(F.col(id_column), "n_known", "sequence", F.array_join(F.array_distinct(F.array_compact(F.array(*found))), " ").alias("licences"))


def _sql() -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    pairs = lambda table: ", ".join(f"({quoted(k)}, {quoted(v)})" for k, v in table.items())
    steps, last = [], "s"
    for number, (parts, name) in enumerate(WHOLE_RULES + RULES):
        needle = quoted("|" + "||".join(parts) + "|")
        steps.append(f"r{number} AS (SELECT doc_id, n_known, sequence, replace(rest, {needle}, '#') AS rest, CASE WHEN contains(rest, {needle}) AND NOT list_contains(found, {quoted(name)}) "
                     f"THEN list_append(found, {quoted(name)}) ELSE found END AS found FROM {last})")
        last = f"r{number}"
    clean = "trim(regexp_replace(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+', ' ', 'g'))"
    return f"""
WITH known(sentence, id) AS (VALUES {pairs(SENTENCES | WHOLE_SENTENCES)}), tails(sentence, id) AS (VALUES {pairs(WHOLE_SENTENCES)}),
marked AS (SELECT doc_id, regexp_replace(regexp_replace(text, '[.!?;:]([\x20\x09-\x0D]|$)', chr(1) || '\1', 'g'), '\n[^A-Za-z0-9\n]*\n', chr(1) || chr(10), 'g') AS t
           FROM documents WHERE regexp_matches(text, '(?i){STEMS}')),
cut AS (SELECT doc_id, string_split(t, chr(1)) AS parts FROM marked),
rows AS (SELECT doc_id, unnest(parts) AS part, unnest(range(len(parts))) AS no FROM cut),
whole AS (SELECT r.*, {clean.format('part')} AS sentence FROM rows r),
judged AS (SELECT w.*, k.id FROM whole w LEFT JOIN known k ON k.sentence = w.sentence),
lines AS (SELECT doc_id, no, sentence, unnest(string_split(part, chr(10))) AS line, unnest(range(len(string_split(part, chr(10))))) AS sub, len(string_split(part, chr(10))) AS n FROM judged WHERE id IS NULL),
known_lines AS (SELECT l.*, k.id FROM lines l LEFT JOIN known k ON k.sentence = {clean.format('l.line')}),
ends AS (SELECT l.doc_id, l.no, arg_max(t.id, length(t.sentence)) AS id FROM known_lines l JOIN tails t ON ends_with(l.sentence, ' ' || t.sentence) WHERE l.sub = l.n - 1 AND l.id IS NULL GROUP BY 1, 2),
ids AS (SELECT doc_id, no, -1 AS sub, id FROM judged WHERE id IS NOT NULL UNION ALL SELECT doc_id, no, sub, id FROM known_lines WHERE id IS NOT NULL UNION ALL SELECT doc_id, no, 1000000000, id FROM ends),
hits AS (SELECT doc_id, count(*) AS n_known, string_agg(id, ' ' ORDER BY no, sub) AS sequence, string_agg('|' || id || '|', '' ORDER BY no, sub) AS rest FROM ids GROUP BY doc_id),
s AS (SELECT d.doc_id, coalesce(n_known, 0) AS n_known, coalesce(sequence, '') AS sequence, coalesce(rest, '') AS rest, CAST([] AS VARCHAR[]) AS found FROM documents d LEFT JOIN hits h ON h.doc_id = d.doc_id),
{', '.join(steps)}
SELECT doc_id, n_known, sequence, array_to_string(found, ' ') AS licences FROM {last}
"""


#: DuckDB's form over ``documents`` (ids that do not repeat): the same sentences, whole or by line, and the same rules
SQL = _sql()
