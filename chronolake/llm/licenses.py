"""License scan by sentence rules.

Known license sentences have identifiers.  A text becomes the sequence of identifiers of the sentences it
holds; ordered rules over sequences then name licenses.  Rules are tried in order, longer evidence first,
and what one rule has used is not seen by the next.

A known sentence is found between sentence or line ends.  Line ends, blank lines and comment prefixes may
stand anywhere inside it, and a ; where the sentence itself has one, so that hard-wrapped texts and
license headers of source files are read as well.

A text without any anchor word holds no known sentence, as every known sentence has one, and is not split.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_GNU = "This {what} is free software{first} you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation{second} either version {version} of the License, or (at your option) any later version"
#: (identifier, sentence); sentences are compared in normalised form.  Fixed values: wordings of published licenses and of references to them.
SENTENCES = [
    ("mit-ref", "Released under the MIT License"),
    ("mit-ref", "Licensed under the MIT License"),
    ("mit-grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("mit-notice", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("as-is", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT"),
    ("apache-ref", "Licensed under the Apache License, Version 2.0"),
    ("apache-ref", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License"),
    ("apache-copy", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache-copy", "You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0"),
    ("gpl3-ref", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl2-ref", "This work is licensed under the GNU General Public License, version 2"),
    ("gpl-grant", _GNU.format(what="program", first=":", second=",", name="GNU General Public License", version="3")),
    ("gpl2-grant", _GNU.format(what="program", first=";", second=";", name="GNU General Public License", version="2")),
    ("gpl2-only-grant", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation"),
    ("gpl-copy", "You should have received a copy of the GNU General Public License along with this program"),
    ("lgpl21-grant", _GNU.format(what="library", first=";", second=";", name="GNU Lesser General Public License", version="2.1")),
    ("lgpl3-grant", _GNU.format(what="program", first=":", second=",", name="GNU Lesser General Public License", version="3")),
    ("lgpl3-grant", _GNU.format(what="library", first=":", second=",", name="GNU Lesser General Public License", version="3")),
    ("lgpl21-ref", "Licensed under the GNU Lesser General Public License, version 2.1"),
    ("lgpl3-ref", "Licensed under the GNU Lesser General Public License, version 3"),
    ("agpl3-grant", _GNU.format(what="program", first=":", second=",", name="GNU Affero General Public License", version="3")),
    ("agpl3-ref", "Licensed under the GNU Affero General Public License, version 3"),
    ("mpl2-form", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("mpl2-ref", "Licensed under the Mozilla Public License 2.0"),
    ("mpl2-ref", "Licensed under the Mozilla Public License, version 2.0"),
    ("cc-by-nc4-ref", "Licensed under CC BY-NC 4.0"),
    ("cc-by4-ref", "Licensed under CC BY 4.0"),
    ("cc-by-sa4-ref", "Licensed under CC BY-SA 4.0"),
    ("cc-by4-ref", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa4-ref", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-nc4-ref", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc0-ref", "Licensed under CC0 1.0"),
    ("cc0-waiver", "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide"),
    ("unlicense-grant", "This is free and unencumbered software released into the public domain"),
    ("bsd-grant", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("bsd-source", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    ("bsd-binary", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"),
    ("bsd-endorse", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("isc-grant", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("zlib-as-is", "This software is provided 'as-is', without any express or implied warranty"),
    ("zlib-grant", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"),
    ("boost-ref", "Distributed under the Boost Software License, Version 1.0"),
    ("epl2-ref", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("epl2-ref", "Licensed under the Eclipse Public License 2.0"),
]
#: (license, sequence of sentence identifiers), in the order in which they are tried.
RULES = [
    ("MIT", ["mit-grant", "mit-notice", "as-is"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("Apache-2.0", ["apache-ref", "apache-copy"]),
    ("GPL-3.0-or-later", ["gpl-grant", "gpl-copy"]),
    ("GPL-2.0-or-later", ["gpl2-grant", "gpl-copy"]),
    ("GPL-2.0-only", ["gpl2-only-grant", "gpl-copy"]),
    ("Zlib", ["zlib-as-is", "zlib-grant"]),
    ("MIT", ["mit-grant", "mit-notice"]),
    ("GPL-3.0-or-later", ["gpl-grant"]),
    ("GPL-2.0-or-later", ["gpl2-grant"]),
    ("GPL-2.0-only", ["gpl2-only-grant"]),
    ("LGPL-2.1-or-later", ["lgpl21-grant"]),
    ("LGPL-3.0-or-later", ["lgpl3-grant"]),
    ("AGPL-3.0-or-later", ["agpl3-grant"]),
    ("MIT", ["mit-grant"]),
    ("MIT", ["mit-ref"]),
    ("Apache-2.0", ["apache-ref"]),
    ("GPL-3.0-only", ["gpl3-ref"]),
    ("GPL-2.0-only", ["gpl2-ref"]),
    ("LGPL-2.1-only", ["lgpl21-ref"]),
    ("LGPL-3.0-only", ["lgpl3-ref"]),
    ("AGPL-3.0-only", ["agpl3-ref"]),
    ("MPL-2.0", ["mpl2-form"]),
    ("MPL-2.0", ["mpl2-ref"]),
    ("CC-BY-NC-4.0", ["cc-by-nc4-ref"]),
    ("CC-BY-4.0", ["cc-by4-ref"]),
    ("CC-BY-SA-4.0", ["cc-by-sa4-ref"]),
    ("CC0-1.0", ["cc0-ref"]),
    ("CC0-1.0", ["cc0-waiver"]),
    ("Unlicense", ["unlicense-grant"]),
    ("BSD-2-Clause", ["bsd-grant"]),
    ("ISC", ["isc-grant"]),
    ("Zlib", ["zlib-grant"]),
    ("BSL-1.0", ["boost-ref"]),
    ("EPL-2.0", ["epl2-ref"]),
]
# a tag in a file's header is a sentence of its own for every license that a rule names
for _name in dict.fromkeys(name for name, _ in RULES):
    SENTENCES.append((f"spdx-{_name}", f"SPDX-License-Identifier: {_name}"))
    RULES.append((_name, [f"spdx-{_name}"]))
#: Every sentence has one of these (as a part of a word).
ANCHORS = "licen|permission|redistribut|copyright|software"
#: A sentence ends at a line end, or at . ! ? ; before white space or the end.
SENTENCE_END = r"[.!?;]*[\n\r]+|[.!?;]+(?:[ \t]+|$)"
#: The start of a text or a line end, with the comment prefix after it.
LINE_START = r"(?:\A|[\n\r])[^a-z0-9\n\r]*(?:(?:rem|dnl)\b[^a-z0-9\n\r]*)?"


def normal_sentence(sentence: str) -> str:
    return " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in sentence.lower()).split())


def known_sentences() -> dict[str, str]:
    """Identifiers by normalised sentence."""
    return {normal_sentence(sentence): name for name, sentence in SENTENCES}


def marked(text: Column) -> Column:
    """The lowered words of a text with a space between them, and L for line ends with the comment prefix
    that follows, S for a ; and E for . ! ? before white space or the end."""
    out = F.regexp_replace(F.lower(text), LINE_START, "L")
    out = F.regexp_replace(F.regexp_replace(out, r"[.!?](?=[ \tL]|$)", "E"), r";(?=[ \tL]|$)", "S")
    return F.regexp_replace(out, "[^a-z0-9LSE]+", " ")


def sentence_pattern(sentence: str) -> str:
    """The pattern of a sentence in a marked text; a ; or a . of its own may be marked as well."""
    parts = re.split(r"([;.])\s", sentence)
    marks = {";": "[ LS]+", ".": "[ LE]+"}
    return "".join(marks[part] if i % 2 else normal_sentence(part).replace(" ", "[ L]+") for i, part in enumerate(parts))


def sentence_ids(text: Column) -> Column:
    """The identifiers of the known sentences of a text, in order; of those that start at a place, the longest."""
    known = F.create_map(*(F.lit(x) for pair in known_sentences().items() for x in pair))
    any_known = "|".join(sentence_pattern(s) for _, s in sorted(SENTENCES, key=lambda x: -len(x[1])))
    found = F.regexp_extract_all(marked(text), F.lit(f"[LSE] ?({any_known})(?= ?(?:[LSE]|$))"), F.lit(1))
    return F.transform(found, lambda s: F.element_at(known, F.regexp_replace(s, "[ LSE]+", " ")))


def scan_licenses(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_sentences, sentence_ids, licenses) for every row; the last two joined by commas.

    licenses has a name for each rule match, in order of the rules.  Null and empty texts, and texts
    without a known sentence, have 0, '' and ''.  Repeated rows get the same row each; an empty table gives
    an empty table; columns other than the id and the text, whatever their names, are not read.
    """
    text = F.coalesce(F.col(text_column), F.lit(""))
    ids = F.when(F.lower(text).rlike(ANCHORS), sentence_ids(text)).otherwise(F.array().cast("array<string>"))
    out = docs.select(F.col(id_column).alias("doc_id"), ids.alias("ids"))
    out = out.select("doc_id", F.size("ids").cast("long").alias("n_sentences"), F.array_join("ids", ",").alias("sentence_ids"))
    # only texts with identifiers: rule by rule, count its sequence, then take it out
    left = F.concat(F.lit("|"), F.regexp_replace("sentence_ids", ",", "||"), F.lit("|"))
    rules = F.array(*(F.struct(F.lit(name).alias("name"), F.lit("".join(f"|{i}|" for i in sequence)).alias("found")) for name, sequence in RULES))

    def apply(state: Column, rule: Column) -> Column:
        times = F.floor((F.length(state["left"]) - F.length(F.replace(state["left"], rule["found"], F.lit("")))) / F.length(rule["found"])).cast("int")
        return F.struct(F.replace(state["left"], rule["found"], F.lit("/")).alias("left"), F.concat(state["names"], F.repeat(F.concat(F.lit(","), rule["name"]), times)).alias("names"))

    names = F.aggregate(rules, F.struct(left.alias("left"), F.lit("").alias("names")), apply, lambda state: state["names"])
    return out.select("doc_id", "n_sentences", "sentence_ids", F.when(F.col("n_sentences") > 0, F.substr(names, F.lit(2))).otherwise("").alias("licenses"))
