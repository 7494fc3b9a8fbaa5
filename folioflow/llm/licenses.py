"""Licences by sparse TF-IDF cosine against templates, inherited from the nearest ancestor directory.

What a file says about licensing (its statements) is compared with notice sentences, and licence files and headers as a
whole with full licence texts. Terms are weighed by their rarity among the licences, so the corpus has no part in a
score. The cosine decides; only where two licences score nearly alike does a name in the statement. A file that
states no licence takes that of the nearest directory above it in which a licence file lies.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, functions as F

from folioflow.llm.common import let, lower_words, written

# Notices in use, in their owners' wording. spdx id, wording.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License 2.0."),
    ("Apache-2.0", "You may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "The MIT License (MIT)"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-2-Clause", "Licensed under the Simplified BSD License."),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Licensed under the New BSD License."),
    ("BSD-3-Clause", "Licensed under the BSD License."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("ISC", "Licensed under the ISC License."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("ISC", "SPDX-License-Identifier: ISC"),
    ("GPL-1.0-or-later", "Licensed under the GNU General Public License."),
    ("GPL-1.0-or-later", "Under the terms of the GNU General Public License."),
    ("GPL-2.0-only", "Licensed under the GNU General Public License, version 2."),
    ("GPL-2.0-only", "Under the terms of the GNU General Public License, version 2."),
    ("GPL-2.0-only", "Under the terms of the GNU General Public License version 2 as published by the Free Software Foundation."),
    ("GPL-2.0-only", "Licensed under the GPL v2."),
    ("GPL-2.0-only", "SPDX-License-Identifier: GPL-2.0-only"),
    ("GPL-3.0-only", "Licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "Under the terms of the GNU General Public License, version 3."),
    ("GPL-3.0-only", "Under the terms of the GNU General Public License version 3 as published by the Free Software Foundation."),
    ("GPL-3.0-only", "Licensed under the GPL v3."),
    ("GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-only"),
    ("LGPL-2.1-only", "Licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-2.1-only", "Under the terms of the GNU Lesser General Public License version 2.1 as published by the Free Software Foundation."),
    ("LGPL-2.1-only", "SPDX-License-Identifier: LGPL-2.1-only"),
    ("LGPL-3.0-only", "Licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0-only", "Under the terms of the GNU Lesser General Public License version 3 as published by the Free Software Foundation."),
    ("LGPL-3.0-only", "SPDX-License-Identifier: LGPL-3.0-only"),
    ("AGPL-3.0-only", "Licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0-only", "Under the terms of the GNU Affero General Public License version 3 as published by the Free Software Foundation."),
    ("AGPL-3.0-only", "SPDX-License-Identifier: AGPL-3.0-only"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "Licensed under the Mozilla Public License, version 2.0."),
    ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"),
    ("EPL-2.0", "Made available under the terms of the Eclipse Public License 2.0."),
    ("EPL-2.0", "SPDX-License-Identifier: EPL-2.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "Creative Commons Attribution 4.0"),
    ("CC-BY-4.0", "Licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "Licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "Licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "Dedicated to the public domain, see CC0 1.0 Universal."),
    ("CC0-1.0", "CC0 1.0 Universal public domain dedication. No rights reserved."),
    ("CC0-1.0", "SPDX-License-Identifier: CC0-1.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Unlicense", "Licensed under The Unlicense."),
    ("Unlicense", "SPDX-License-Identifier: Unlicense"),
)
LEAST = 0.6  # cosine from which a template is taken
TIE = 0.02  # licences that score so near the best are told apart by name, if one is named
# The licences' names, between whose words blanks, line ends and comment marks may stand. Of the names
# in a statement the first counts, of those at one place the first listed.
_G = r"[\s#*/;,\x22'(]+"
_GNU = rf"GNU{_G}%sGeneral{_G}Public{_G}Licen[sc]e"
_V = rf"[^.]*?\b(?:version{_G}|v\.?\s?)"
_CC = rf"(?:CC|Creative{_G}Commons)[\s#*/-]+(?:BY|Attribution)"
NAMES = (
    ("AGPL-3.0-only", rf"{_GNU % f'Affero{_G}'}{_V}3|AGPL[-\s]?v?3(?:\.0)?"),
    ("LGPL-2.1-only", rf"{_GNU % f'(?:Lesser|Library){_G}'}{_V}2\.1|LGPL[-\s]?v?2\.1"),
    ("LGPL-3.0-only", rf"{_GNU % f'Lesser{_G}'}{_V}3|LGPL[-\s]?v?3(?:\.0)?"),
    ("GPL-2.0-only", rf"{_GNU % ''}{_V}2|GPL[-\s]?v?2(?:\.0)?"),
    ("GPL-3.0-only", rf"{_GNU % ''}{_V}3|GPL[-\s]?v?3(?:\.0)?"),
    ("GPL-1.0-or-later", _GNU % ""),
    ("Apache-2.0", rf"Apache{_G}(?:Software{_G})?Licen[sc]e{_G}(?:version{_G}|v\.?)?2|Apache[-\s]2(?:\.0)?"),
    ("MPL-2.0", rf"Mozilla{_G}Public{_G}Licen[sc]e{_G}(?:version{_G}|v\.?)?2|MPL[-\s]?v?2(?:\.0)?"),
    ("EPL-2.0", rf"Eclipse{_G}Public{_G}Licen[sc]e[\s#*/,-]+(?:version{_G}|v\.?\s?)?2|EPL[-\s]?v?2(?:\.0)?"),
    ("BSD-2-Clause", rf"BSD[-\s]2[-\s]Clause|(?:2|two)[-\s]Clause{_G}BSD|Simplified{_G}BSD"),
    ("BSD-3-Clause", rf"BSD[-\s]3[-\s]Clause|(?:3|three)[-\s]Clause{_G}BSD|(?:(?:New|Modified){_G})?BSD{_G}Licen[sc]e"),
    ("MIT", rf"MIT{_G}Licen[sc]ed?|SPDX-License-Identifier:\s*MIT\b"),
    ("ISC", rf"ISC{_G}Licen[sc]ed?|SPDX-License-Identifier:\s*ISC\b"),
    ("CC-BY-NC-4.0", rf"{_CC}[\s#*/-]*(?:NC|Non-?Commercial)\s+4\.0|CC-BY-NC-4\.0"),
    ("CC-BY-SA-4.0", rf"{_CC}[\s#*/-]*(?:SA|Share-?Alike)\s+4\.0|CC-BY-SA-4\.0"),
    ("CC-BY-4.0", rf"{_CC}\s+4\.0|CC-BY-4\.0"),
    ("CC0-1.0", r"CC0(?:[-\s]1\.0)?\b"),
    ("Unlicense", rf"The{_G}Unlicense\b|SPDX-License-Identifier:\s*Unlicense\b"),
)
FULL_LEAST = 0.6  # cosine of whole texts from which a full licence text is taken
_COMMENT = r"^\s*(?:#|//|--|;|%)"
# Who says so states a licence, be it one of these or not.
DECLARES = (
    rf"(?i)\b(?:licen[sc]ed|released|distributed|published|provided|(?:made{_G})?available){_G}under\b"
    r"|SPDX-License-Identifier:\s*\w"
)
# What may state a licence: these words, between which blanks, line ends and comment marks may stand.
KEYWORD = (
    rf"(?i)\b(?:licen[sc]ed?|licen[sc]es|spdx-license-identifier|copyleft|creative{_G}commons|cc0|cc[\s-]{{1,9}}by"
    rf"|gnu{_G}(?:\w+{_G})?general{_G}public|(?:mozilla|eclipse){_G}public{_G}licen[sc]e|(?:apache|mit|bsd|isc){_G}licen[sc]ed?"
    rf"|simplified{_G}bsd|(?:two|three|[23])[-\s]clause{_G}bsd|[al]?gpl[-\s]?v?[23](?:\.[01])?"
    rf"|(?:released|distributed|published|provided|available){_G}under"
    rf"|public{_G}domain|permission{_G}is{_G}hereby|permission{_G}to{_G}use|redistribution{_G}and{_G}use)\b"
)
# Where one statement ends and another begins: after a sentence, or at an empty line.
SENTENCE = r"(?<=[.!?])[\x20\t\r\n]+|\n[\x20\t\r]*\n"
# A sentence of more words is taken in parts: every keyword with so many words before and after it.
LONG, BEFORE, AFTER = 24, 6, 16
_AROUND = (
    rf"(?i)(?<!\S)(?:\S++\s++){{0,{BEFORE}}}?\S*?{KEYWORD.replace('(?i)', '')}\S*+(?:\s++\S++){{0,{AFTER}}}+"
)
LICENCE_FILE = r"(?i)(?:^|/)(?:licen[sc]e|copying|unlicense|notice)(?:[._-][^/]*)?$"
_BETWEEN = r"[^A-Za-z0-9]+"


def terms(text: Column) -> Column:
    """Words and pairs of neighbouring words, lower case."""

    def of(w: Column) -> Column:
        pairs = F.transform(F.slice(w, 2, F.greatest(F.size(w), F.lit(1))), lambda x, i: F.concat_ws(" ", F.get(w, i), x))
        return F.concat(w, pairs)

    return let(lower_words(text, _BETWEEN), of)


def statements(text: Column) -> Column:
    """array<string>: what a text says about licensing, wherever in it; empty without a keyword.

    A statement is a sentence with a keyword, over line ends; of a long sentence the words around each keyword.
    """
    none = F.array().cast("array<string>")

    def parts(sentence: Column) -> Column:
        long_ = F.size(F.split(sentence, r"\s+")) > LONG
        return F.when(long_, F.regexp_extract_all(sentence, F.lit(_AROUND), 0)).otherwise(F.array(sentence))

    said = F.flatten(F.transform(F.filter(F.split(text, SENTENCE, -1), lambda s: s.rlike(KEYWORD)), parts))
    return F.when(text.rlike(KEYWORD), said).otherwise(none)


def header(text: Column) -> Column:
    """The leading comment, else the first paragraph."""
    lines = lambda t: F.split(t, "\n", -1)
    open_lines = lambda t: let(
        lines(t),
        lambda w: let(
            F.array_position(F.transform(w, lambda x: ~x.rlike(_COMMENT)), F.lit(True)).cast("int"),
            lambda end: F.array_join(F.slice(w, F.lit(1), F.when(end > 0, end - 1).otherwise(F.size(w))), "\n"),
        ),
    )
    return let(
        F.regexp_replace(text, r"^\s+", ""),
        lambda t: F.when(t.rlike(r"^/\*"), F.regexp_extract(t, r"(?s)^/\*.*?(?:\*/|\z)", 0))
        .when(t.rlike("^<!--"), F.regexp_extract(t, r"(?s)^<!--.*?(?:-->|\z)", 0))
        .when(t.rlike(_COMMENT), open_lines(t))
        .otherwise(F.get(F.split(t, r"\n[\x20\t\r]*\n", 2), 0)),
    )


def compared_whole(path: Column, text: Column) -> Column:
    """What is compared with full licence texts: a licence file, or a header with a keyword; else null."""
    with_word = F.when(text.rlike(KEYWORD), header(text))
    return F.when(path.rlike(LICENCE_FILE), text).otherwise(let(with_word, lambda h: F.when(h.rlike(KEYWORD), h)))


def full_texts() -> list[tuple[str, str]]:
    """(licence, text) of the full texts that lie beside this file."""
    folder = Path(__file__).parent / "license_texts"
    return [(f.name.removesuffix(".txt"), f.read_text(encoding="utf-8")) for f in sorted(folder.glob("*.txt"))]


def _counted(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    return rows.select(*keys, F.explode_outer(terms(F.col(text))).alias("term")).filter("term is not null").groupBy(*keys, "term").agg(
        F.count("*").cast("double").alias("tf")
    )


def cosines(rows: DataFrame, keys: list[str], text: str, templates: list[tuple[str, str]], name: str) -> DataFrame:
    """(keys, license, score): the best cosine of every text with the templates of each licence it shares a term with.

    The weight of a term is (1 + ln tf) times its rarity ln((licences + 1) / (licences with it + 1)) + 1; a term of no
    template weighs 1, so that the words around a notice count little. Rounded to six digits.
    """
    given = [(i, licence, wording) for i, (licence, wording) in enumerate(templates)]
    own = _counted(rows.sparkSession.createDataFrame(given, "template int, license string, wording string"), ["template", "license"], "wording")
    own = written(own, f"{name}-templates")
    licences = len({licence for licence, _ in templates})
    rarity = own.groupBy("term").agg((F.log(F.lit(licences + 1.0) / (F.count_distinct("license") + 1)) + 1).alias("rarity"))
    weight = (1 + F.log("tf")) * F.coalesce("rarity", F.lit(1.0))
    length = F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length")
    vectors = own.join(rarity, "term").withColumn("w", weight)
    vectors = vectors.join(vectors.groupBy("template").agg(length), "template").withColumn("t", F.col("w") / F.col("length"))
    # All templates of a term in one row: each term of a text meets one row. As large as the list of templates.
    held = vectors.groupBy("term").agg(F.collect_list(F.struct("template", "license", "t")).alias("held"))
    held = written(held.join(rarity, "term"), f"{name}-terms")
    weighed = written(
        _counted(rows, keys, text).join(F.broadcast(held), "term", "left").withColumn("w", weight).select(*keys, "w", "held"), f"{name}-weighed"
    )
    product = (
        weighed.filter("held is not null").select(*keys, "w", F.explode("held").alias("h"))
        .groupBy(*keys, "h.template", "h.license").agg(F.sum(F.col("w") * F.col("h.t")).alias("p"))
    )
    score = F.max(F.round(F.col("p") / F.col("length"), 6)).alias("score")
    return product.join(weighed.groupBy(*keys).agg(length), keys).groupBy(*keys, "license").agg(score)


def like_full_text(wholes: DataFrame) -> DataFrame:
    """(key, full, full_score) of those of (key, whole) that are a full licence text by their cosine."""
    scored = cosines(wholes, ["key"], "whole", full_texts(), "licence-full").filter(F.col("score") >= FULL_LEAST)
    best = F.min(F.struct((-F.col("score")).alias("s"), F.col("license").alias("l"))).alias("b")
    return scored.groupBy("key").agg(best).select("key", F.col("b.l").alias("full"), (-F.col("b.s")).alias("full_score"))


def judged_statements(said: DataFrame, templates=TEMPLATES, least: float = LEAST) -> DataFrame:
    """(h1, h2, own, score, by, declares) of distinct statements (h1, h2, statement).

    ``own`` is the licence of the best cosine from ``least`` on, ``by`` "text", or "name" where licences within TIE of the best
    were told apart by the name in the statement; equal ones without a name go by the licence's name.
    """
    keys = ["h1", "h2"]
    scored = cosines(said, keys, "statement", list(templates), "licence-notices")
    best = scored.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("license").alias("l")))).alias("found"))
    near = F.filter("found", lambda x: x["s"] <= F.get("found", F.lit(0))["s"] + TIE)
    by_name = F.filter("near", lambda x: x["l"] == F.col("named"))
    top = F.get("near", F.lit(0))
    chosen = F.when(F.size(by_name) > 0, F.get(by_name, F.lit(0))).otherwise(top)
    judged = (
        said.select(*keys, named(F.col("statement")).alias("named"), F.col("statement").rlike(DECLARES).alias("declares"))
        .join(best, keys, "left").withColumn("near", near)
        .withColumns({"chosen": chosen, "top": top})
    )
    sure = -F.col("top.s") >= least
    return judged.select(
        *keys, F.when(sure, F.col("chosen.l")).alias("own"), F.coalesce(-F.col("chosen.s"), F.lit(0.0)).alias("score"),
        F.when(sure, F.when(F.col("chosen.l") != F.col("top.l"), "name").otherwise("text")).alias("by"), "declares",
    )


def named(said: Column) -> Column:
    """The licence whose name comes first in a statement, null without one."""
    at = [
        F.struct(F.regexp_instr(said, F.lit(rf"(?i)\b(?:{pattern})")).alias("at"), F.lit(i).alias("i"), F.lit(name).alias("name"))
        for i, (name, pattern) in enumerate(NAMES)
    ]
    return F.array_min(F.filter(F.array(*at), lambda x: x["at"] > 0))["name"]


def scan_licenses(files: DataFrame, templates=TEMPLATES, least: float = LEAST) -> DataFrame:
    """(doc_id, path, license, score, declared_by, inherited_from) of every row of (doc_id, path, text).

    Licence files as a whole and the leading comment or paragraph of other files are compared with full licence
    texts first, and are that licence from a cosine of ``FULL_LEAST`` on, which then is the ``score``. Else a file's
    licence is that of its statement with the best cosine, from ``least`` on (equal ones: the first statement).
    ``declared_by`` is "text", "name" (a name told near ties apart), "directory" or null. A statement that says
    "licensed under" and the like without reaching ``least`` states a licence that is not known here: ``license`` is
    null and ``declared_by`` "text". ``score`` is the best cosine of the file's statements (0 without any), rounded to six
    digits. A file that states a licence, known or not, inherits none. A licence file (LICENSE, COPYING ...) with a
    licence gives it to its directory and all below, unless a nearer one does; of several in one directory the
    best score and then the first name counts.

    Equal statements are judged once, under two 64-bit hashes; a statement meets only the templates, a fixed list that is
    broadcast. Directories are joined by path, level by level in the file's own row, with the licence files'
    directories. Null paths have no directory, null and empty texts state nothing, texts of any length are searched
    whole, repeated rows are judged alike and an empty table gives no rows. Other columns are not read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    given = files.select(
        "doc_id", F.col("path").cast("string").alias("path"), statements(text).alias("said"),
        compared_whole(F.col("path").cast("string"), text).alias("whole"), F.monotonically_increasing_id().alias("_row"),
    )
    stated = written(given, "licence-statements").withColumn("key", F.xxhash64("whole"))
    wholes = stated.filter("whole != ''").groupBy("key").agg(F.first("whole").alias("whole"))
    full = written(like_full_text(wholes), "licence-full-found")
    spoken = stated.filter("size(said) > 0").select("_row", F.posexplode("said").alias("at", "statement"))
    spoken = spoken.withColumns({"h1": F.xxhash64("statement"), "h2": F.xxhash64(F.lit("second"), "statement")})
    distinct = written(spoken.groupBy("h1", "h2").agg(F.first("statement").alias("statement")), "licence-distinct")
    judged = written(judged_statements(distinct, templates, least), "licence-judged")
    first = F.struct(F.col("own").isNull().alias("none"), (-F.col("score")).alias("s"), "at", "own", "by")
    per_file = (
        spoken.select("_row", "at", "h1", "h2").join(judged, ["h1", "h2"])
        .groupBy("_row").agg(F.min(first).alias("b"), F.max("declares").alias("declares"))
        .select("_row", F.col("b.own").alias("own"), (-F.col("b.s")).alias("score"), F.col("b.by").alias("by"), "declares")
    )
    # Most files state nothing; they stay out of the joins.
    silent = stated.filter("size(said) = 0 and coalesce(whole, '') = ''").select("doc_id", "path").withColumns(
        {"own": F.lit(None).cast("string"), "score": F.lit(0.0), "by": F.lit(None).cast("string"), "states": F.lit(False)}
    )
    loud = stated.filter("size(said) > 0 or whole != ''").drop("said", "whole").join(per_file, "_row", "left").join(full, "key", "left")
    loud = loud.select(
        "doc_id", "path", F.coalesce("full", "own").alias("own"), F.coalesce("full_score", "score", F.lit(0.0)).alias("score"),
        F.when(F.col("full").isNotNull(), "text").otherwise(F.col("by")).alias("by"),
        (F.coalesce("full", "own").isNotNull() | F.coalesce("declares", F.lit(False))).alias("states"),
    )
    judged = written(loud.unionByName(silent), "licence-own")
    declared = (
        judged.filter(F.col("own").isNotNull() & F.col("path").rlike(LICENCE_FILE))
        .groupBy(directory(F.col("path")).alias("dir"))
        .agg(F.min(F.struct((-F.col("score")).alias("s"), "own", "path")).alias("d"))
        .select("dir", F.col("d.own").alias("_license"), F.col("d.path").alias("_from"))
    )
    # Directories, not files, look upwards, so the join is as large as the tree and no directory is hot.
    below = judged.select(directory(F.col("path")).alias("dir")).filter("dir is not null").distinct()
    upward = below.select(F.col("dir").alias("_dir"), F.posexplode(ancestors(F.col("dir"))).alias("steps", "dir"))
    nearest = (
        upward.join(declared, "dir")
        .groupBy("_dir")
        .agg(F.min(F.struct("steps", "_license", "_from")).alias("n"))
        .select("_dir", "n._license", "n._from")
    )
    placed = judged.join(nearest, directory(F.col("path")) == F.col("_dir"), "left")
    return placed.select(
        "doc_id", "path",
        F.when(F.col("states"), F.col("own")).otherwise(F.col("_license")).alias("license"),
        "score",
        F.when(F.col("states"), F.coalesce("by", F.lit("text"))).when(F.col("_license").isNotNull(), "directory").alias("declared_by"),
        F.when(~F.col("states"), F.col("_from")).alias("inherited_from"),
    )


def directory(path: Column) -> Column:
    """Everything before the last slash; "" for a file at the top."""
    return F.regexp_replace(path, r"(?:^|/)[^/]*$", "")


def ancestors(folder: Column) -> Column:
    """array<string>: the directory itself and all above it, nearest first, "" last."""

    def of(parts: Column) -> Column:
        own = F.transform(
            F.sequence(F.lit(0), F.size(parts) - 1),
            lambda i: F.array_join(F.slice(parts, 1, F.size(parts) - i), "/"),
        )
        return F.when(folder == "", F.array(F.lit(""))).otherwise(F.array_append(own, F.lit("")))

    return let(F.split(folder, "/"), of)
