"""License scans by sentence rules.

A text is cut into sentences, each is normalised and looked up among known
license sentences; the sequence of the identifiers found is matched against
ordered rules, of which the first that fits a place names the license there.
Everything happens inside the row: no join, no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

# License sentences (normalised: lower case, runs of other characters than a-z and 0-9 made one space) and their identifiers.
SENTENCES = {
    "licensed under the apache license version 2 0": "apache2_ref",
    "licensed under the apache license version 2 0 the license": "apache2_head",
    "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license": "apache2_notice",
    "you may not use this file except in compliance with the license": "apache_comply",
    "you may obtain a copy of the license at": "apache_copy",
    "you may obtain a copy of the license at http www apache org licenses license 2 0": "apache_copy",
    "you may obtain a copy of the license at https www apache org licenses license 2 0": "apache_copy",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "apache_asis",
    "see the license for the specific language governing permissions and limitations under the license": "apache_see",
    "released under the mit license": "mit_ref",
    "licensed under the mit license": "mit_ref",
    "this project is licensed under the mit license": "mit_ref",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction": "mit_grant",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit_grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit_notice",
    "the software is provided as is without warranty of any kind express or implied": "mit_asis",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "mit_asis",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc_grant",
    "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness": "isc_asis",
    "this work is licensed under the gnu general public license version 3": "gpl3_ref",
    "licensed under the gnu general public license version 3": "gpl3_ref",
    "licensed under the gnu general public license version 2": "gpl2_ref",
    "this work is licensed under the gnu general public license version 2": "gpl2_ref",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "gpl3_grant",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "gpl2_grant",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version": "agpl3_grant",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version": "lgpl21_grant",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version": "lgpl3_grant",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "gpl_asis",
    "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "gpl_asis",
    "licensed under cc by 4 0": "ccby4_ref",
    "licensed under cc by sa 4 0": "ccbysa4_ref",
    "licensed under cc by nc 4 0": "ccbync4_ref",
    "licensed under cc by nd 4 0": "ccbynd4_ref",
    "this work is licensed under a creative commons attribution 4 0 international license": "ccby4_ref",
    "this work is licensed under a creative commons attribution sharealike 4 0 international license": "ccbysa4_ref",
    "this work is licensed under a creative commons attribution noncommercial 4 0 international license": "ccbync4_ref",
    "this work is licensed under a creative commons attribution noderivatives 4 0 international license": "ccbynd4_ref",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd_grant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd_source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd_binary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd_endorse",
    "this software is provided by the copyright holders and contributors as is": "bsd_asis",
    "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed": "bsd_asis",
    "licensed under the bsd 3 clause license": "bsd3_ref",
    "licensed under the bsd 2 clause license": "bsd2_ref",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl2_ref",
    "this is free and unencumbered software released into the public domain": "unlicense_head",
    "boost software license version 1 0 august 17th 2003": "bsl1_head",
    "distributed under the boost software license version 1 0": "bsl1_ref",
    "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0": "epl2_ref",
    "this software is provided as is without any express or implied warranty": "zlib_asis",
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions": "zlib_grant",
    "all rights reserved": "reserved",
}
# Ordered rules, most specific first: a license and the identifiers that must follow one another.
RULES = [
    ("Apache-2.0", ["apache2_notice", "apache_copy", "apache_asis", "apache_see"]),
    ("Apache-2.0", ["apache2_head", "apache_comply", "apache_copy", "apache_see"]),
    ("Apache-2.0", ["apache2_ref", "apache_comply", "apache_copy"]),
    ("MIT", ["mit_grant", "mit_notice", "mit_asis"]),
    ("ISC", ["isc_grant", "isc_asis"]),
    ("AGPL-3.0-or-later", ["agpl3_grant", "gpl_asis"]),
    ("LGPL-2.1-or-later", ["lgpl21_grant", "gpl_asis"]),
    ("LGPL-3.0-or-later", ["lgpl3_grant", "gpl_asis"]),
    ("GPL-3.0-or-later", ["gpl3_grant", "gpl_asis"]),
    ("GPL-2.0-or-later", ["gpl2_grant", "gpl_asis"]),
    ("BSD-3-Clause", ["bsd_grant", "bsd_source", "bsd_binary", "bsd_endorse", "bsd_asis"]),
    ("BSD-3-Clause", ["bsd_grant", "bsd_endorse", "bsd_asis"]),
    ("BSD-2-Clause", ["bsd_grant", "bsd_source", "bsd_binary", "bsd_asis"]),
    ("BSD-2-Clause", ["bsd_grant", "bsd_asis"]),
    ("Zlib", ["zlib_asis", "zlib_grant"]),
    ("MIT", ["mit_grant"]),
    ("ISC", ["isc_grant"]),
    ("AGPL-3.0-or-later", ["agpl3_grant"]),
    ("LGPL-2.1-or-later", ["lgpl21_grant"]),
    ("LGPL-3.0-or-later", ["lgpl3_grant"]),
    ("GPL-3.0-or-later", ["gpl3_grant"]),
    ("GPL-2.0-or-later", ["gpl2_grant"]),
    ("Apache-2.0", ["apache2_notice"]),
    ("Apache-2.0", ["apache2_ref"]),
    ("Apache-2.0", ["apache2_head"]),
    ("MIT", ["mit_ref"]),
    ("GPL-3.0-only", ["gpl3_ref"]),
    ("GPL-2.0-only", ["gpl2_ref"]),
    ("CC-BY-4.0", ["ccby4_ref"]),
    ("CC-BY-SA-4.0", ["ccbysa4_ref"]),
    ("CC-BY-NC-4.0", ["ccbync4_ref"]),
    ("CC-BY-ND-4.0", ["ccbynd4_ref"]),
    ("BSD-3-Clause", ["bsd3_ref"]),
    ("BSD-2-Clause", ["bsd2_ref"]),
    ("MPL-2.0", ["mpl2_ref"]),
    ("Unlicense", ["unlicense_head"]),
    ("BSL-1.0", ["bsl1_head"]),
    ("BSL-1.0", ["bsl1_ref"]),
    ("EPL-2.0", ["epl2_ref"]),
    ("Zlib", ["zlib_grant"]),
]
# Every known sentence holds one of these; a text with none of them has no known sentence.
MARKS = ["licens", "permi", "software", "rights reserved", "distribut", "warrant"]
# White space, and what may stand between a sentence's last mark and it.
GAP = r"[\x20\x09-\x0D]+"
CLOSING = "[\"')\\]*_]*"
# A sentence ends at a mark before the number of a list, at one before what is no small letter or digit, at ; and : before what is no small letter, and at a blank line (one without letters or digits, such as an empty comment line).
ENDS = [rf"([.!?]{CLOSING}){GAP}([0-9]{{1,2}}[.)]{GAP})", rf"([.!?]{CLOSING}){GAP}([^a-z0-9\x20\x09-\x0D])", rf"([;:]{CLOSING}){GAP}([^a-z\x20\x09-\x0D])"]
BREAK = r"\n[^A-Za-z0-9\n]*\n"


def sentence_ids(text: Column, sentences: dict[str, str] = SENTENCES) -> Column:
    """The identifiers of a text's known sentences, in order.

    Lines of a sentence are joined, whatever wraps or comments them; of a sentence that is not
    known as a whole, its lines are looked up one by one, as titles and references stand alone.
    """
    known = F.create_map(*[F.lit(x) for pair in sentences.items() for x in pair])
    plain = lambda s: F.trim(F.regexp_replace(F.lower(s), "[^a-z0-9]+", " "))
    look = lambda s: F.try_element_at(known, plain(s))
    lines = lambda s: F.filter(F.transform(F.split(s, "\n"), look), lambda x: x.isNotNull())
    found = lambda s: common.let(look(s), lambda x: F.when(x.isNotNull(), F.array(x)).otherwise(lines(s)))
    cut = text
    for end in ENDS:
        cut = F.regexp_replace(cut, end, "$1\n\n$2")
    ids = F.flatten(F.transform(F.split(cut, BREAK), found))
    return F.when(F.lower(text).rlike("|".join(MARKS)), ids).otherwise(F.array().cast("array<string>"))


def match(ids: Column, rules: list[tuple[str, list[str]]] = RULES) -> Column:
    """The licenses the sequence stands for, sorted, once each.

    Rules are tried in order; what a rule has matched is taken out before the next is tried.
    """
    line = F.concat(F.lit(" "), F.array_join(ids, "  "), F.lit(" "))
    state = F.struct(line.alias("rest"), F.array().cast("array<string>").alias("out"))
    table = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(" " + "  ".join(seq) + " ").alias("seq")) for name, seq in rules])
    step = lambda a, r: F.struct(
        F.replace(a["rest"], r["seq"], F.lit(" | ")).alias("rest"),
        F.when(F.contains(a["rest"], r["seq"]), F.array_append(a["out"], r["name"])).otherwise(a["out"]).alias("out"),
    )
    found = F.aggregate(table, state, step, lambda a: F.array_sort(F.array_distinct(a["out"])))
    return F.when(F.size(ids) > 0, found).otherwise(F.array().cast("array<string>"))


def scan(df: DataFrame, text: str = "text", sentences: dict[str, str] = SENTENCES, rules: list[tuple[str, list[str]]] = RULES) -> DataFrame:
    """df's columns in the struct `row`, with sentence_ids and licenses (arrays, empty if none).

    Null and empty texts have neither. Unknown sentences between known ones do
    not part a sequence. Texts are read whole. Other columns travel inside `row`.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    body = F.coalesce(F.col(f"row.`{text}`"), F.lit(""))
    rows = df.select(row.alias("row")).withColumn("sentence_ids", sentence_ids(body, sentences))
    return rows.withColumn("licenses", common.let(F.col("sentence_ids"), lambda v: match(v, rules)))


def oracle(sentences: dict[str, str] = SENTENCES, rules: list[tuple[str, list[str]]] = RULES) -> str:
    """The same in DuckDB SQL, over documents: doc_id, sentence_ids and licenses joined by commas."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    known = "MAP {" + ", ".join(f"{quote(k)}: {quote(v)}" for k, v in sentences.items()) + "}"
    rest, outs = "line", []
    for k, (name, seq) in enumerate(rules):
        s = quote(" " + "  ".join(seq) + " ")
        outs.append((k, name, s))
    plain = "trim(regexp_replace(lower(x), '[^a-z0-9]+', ' ', 'g'))"
    cut = "coalesce(text, '')"
    for end in ENDS:
        cut = f"regexp_replace({cut}, {quote(end)}, '\\1' || chr(10) || chr(10) || '\\2', 'g')"
    steps = "WITH units AS (SELECT doc_id, unnest(u) AS x, generate_subscripts(u, 1) AS k FROM (SELECT doc_id, regexp_split_to_array(" + cut + ", " + quote(BREAK) + ") AS u FROM documents)),\n" + \
        f"known AS (SELECT doc_id, k, x, {known}[{plain}] AS id FROM units),\n" + \
        f"found AS (SELECT doc_id, k, CASE WHEN id IS NOT NULL THEN [id] ELSE list_filter(list_transform(string_split(x, chr(10)), lambda x: {known}[{plain}]), lambda x: x IS NOT NULL) END AS ids FROM known),\n" + \
        "s0 AS (SELECT doc_id, coalesce(flatten(list(ids ORDER BY k)), []) AS ids FROM found GROUP BY doc_id),\n" + \
        "t0 AS (SELECT doc_id, ids, ' ' || array_to_string(ids, '  ') || ' ' AS " + rest + ", CAST([] AS VARCHAR[]) AS found FROM s0)"
    for k, name, s in outs:
        steps += f",\nt{k + 1} AS (SELECT doc_id, ids, replace(line, {s}, ' | ') AS line, CASE WHEN contains(line, {s}) THEN list_append(found, {quote(name)}) ELSE found END AS found FROM t{k})"
    return steps + f"\nSELECT doc_id, coalesce(array_to_string(ids, ','), '') AS sentence_ids, coalesce(array_to_string(list_sort(list_distinct(found)), ','), '') AS licenses FROM t{len(outs)}"
