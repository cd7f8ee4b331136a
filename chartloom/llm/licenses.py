"""License scan: TF-IDF cosine of headers and licence files to templates, then inheritance from the nearest directory.

What is compared with the templates as sparse TF-IDF vectors: the lines of the whole text that use a licensing word, each alone and, where headers are wrapped, with its neighbours
(long lines as a whole, and cut where sentences end or licence statements open), and of licence files (told by name) the title, which is the first two blocks of lines, and the whole text.  Comment marks do not count.  A file that
is mostly licence statement, or a licence file, licenses its directory; a file without a statement of its own takes
the licence of its nearest ancestor directory that has one.  All of it is DataFrame functions and joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chartloom.llm.shared import let, materialize, small_side, word_count

#: Licence statements, headers, titles and short licences as a whole.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the software without restriction."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."),
    ("GPL-2.0", "This program is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This program is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License, CC BY 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License, CC BY-SA 4.0."),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0 Universal."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999 Copyright (C) 1991, 1999 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007 Copyright (C) 2007 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."),
    ("MPL-2.0", "Mozilla Public License Version 2.0 1. Definitions"),
    (
        "MIT",
        "MIT License Copyright (c) Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this "
        "permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A "
        "PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
        "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the "
        "following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of "
        "the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
]
#: Words without which a line is no licence statement; file names that are licence files; what comments put around their lines.
CUES = r"(?i)licen[sc]|permission is hereby|permission to use|redistribut|public domain|copyright|\bCC0\b"
LICENSE_NAMES = r"(?i)(?:^|/)(?:licen[sc]e|copying|unlicense|notice)(?:[.-][^/]*)?$"
COMMENT_MARKS = r"""^[\s#/*;%!<>"'-]+|[\s*/<>-]+$"""
MIN_COSINE, MIN_SHARE = 0.65, 0.3
#: Most characters of a line that may be part of a wrapped statement; a longer line is compared alone and in parts.
WRAPPED = 160
#: What licence statements open with.
OPENINGS = [
    "Distributed under", "Licensed under", "Permission is hereby", "Permission to use", "Redistribution and use", "Released under",
    "This Source Code Form", "This file is", "This library is", "This program is", "This project is", "This software is", "This work is",
]
#: Where a long line is cut, each with what stays of the match.
CUTS = [(r"([.!?])[ \t]+", r"\1\n"), (r"[ \t]+((?:" + "|".join(OPENINGS) + r")[ \t])", r"\n\1")]


def _statements(text: Column, licence_file: Column) -> Column:
    """What of a text is compared with the templates, without repeats."""

    def parts(line: Column) -> Column:
        for pattern, stays in CUTS:
            line = F.regexp_replace(line, pattern, stays.replace("\\1", "$1").replace("\\n", "\n"))
        return F.split(line, "\n")

    def windows(lines: Column) -> Column:
        cues = F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: F.get(lines, i).rlike(CUES))
        wrapped = lambda i: F.when(F.length(F.get(lines, i)) <= WRAPPED, F.get(lines, i))
        run = lambda i, a, b: F.when(F.length(F.get(lines, i)) <= WRAPPED, F.concat_ws(" ", *(wrapped(i + k) for k in range(a, b + 1))))
        return F.array_compact(F.flatten(F.transform(cues, lambda i: F.array(F.get(lines, i), run(i, -1, 0), run(i, 0, 1), run(i, -1, 1)))))

    def around(lines: Column) -> Column:
        long = lambda x: F.length(x) > WRAPPED
        cut = F.when(F.exists(lines, long), F.flatten(F.transform(lines, lambda x: F.when(long(x), parts(x)).otherwise(F.array(x))))).otherwise(lines)
        near = F.concat(F.filter(lines, lambda x: long(x) & x.rlike(CUES)), let(cut, windows))
        blocks = F.transform(F.split(F.array_join(lines, "\n"), "\n\n+"), lambda x: F.btrim(F.translate(x, "\n", " ")))
        whole = F.when(licence_file, let(blocks, lambda b: F.array(F.concat_ws(" ", F.slice(b, 1, 2)), F.array_join(b, " ")))).otherwise(F.array().cast("array<string>"))
        return F.array_distinct(F.transform(F.concat(near, whole), lambda x: F.btrim(x)))

    return let(F.transform(F.split(text, r"\R"), lambda x: F.regexp_replace(x, COMMENT_MARKS, "")), around)


def _tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def template_weights(spark: SparkSession, templates: list[tuple[str, str]] = TEMPLATES) -> tuple[DataFrame, DataFrame]:
    """(template, token, weight of unit vectors; token, idf).  As many rows as the templates have words."""
    rows = spark.createDataFrame([(i, name, text) for i, (name, text) in enumerate(templates)], "template int, license string, body string")
    counts = rows.select("template", "license", F.explode(_tokens(F.col("body"))).alias("token")).groupBy("template", "license", "token").agg(F.count("*").alias("tf"))
    idf = counts.groupBy("token").agg((F.log(F.lit(1.0 + len(templates)) / (1 + F.count_distinct("template"))) + 1).alias("idf"))
    weighted = counts.join(F.broadcast(idf), "token").withColumn("w", F.col("tf") * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("template")))
    return weighted.select("template", "license", "token", (F.col("w") / norm).alias("weight")), idf


def score_statements(statements: DataFrame, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """Distinct ``statement`` strings to ``statement, license, cosine`` of the best template; ties by name.

    Words that no template has weigh as much as a word of no template would: they lengthen the statement's vector only.
    """
    weights, idf = template_weights(statements.sparkSession, templates)
    unknown = F.log(F.lit(1.0 + len(templates))) + 1
    keyed = statements.select(F.unhex(F.sha2("statement", 256)).alias("key"), "statement")  # a word's row carries the key, not a text that may be long
    counts = keyed.select("key", F.explode(_tokens(F.col("statement"))).alias("token")).groupBy("key", "token").agg(F.count("*").alias("tf"))
    own = counts.join(F.broadcast(idf), "token", "left").withColumn("w", F.col("tf") * F.coalesce("idf", unknown))
    norms = own.groupBy("key").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = own.join(F.broadcast(weights), "token").groupBy("key", "template", "license").agg(F.sum(F.col("w") * F.col("weight")).alias("dot"))
    scored = dots.join(norms, "key").withColumn("cosine", F.round(F.col("dot") / F.col("norm"), 9))
    best = scored.groupBy("key").agg(F.min(F.struct((-F.col("cosine")).alias("c"), "license")).alias("best"))
    return keyed.join(best, "key").select("statement", F.col("best.license").alias("license"), (-F.col("best.c")).alias("cosine"))


def scan(files: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, id_column: str = "doc_id", text_column: str = "text", path_column: str = "path") -> DataFrame:
    """``doc_id, path, license, cosine, found_in, license_dir`` for every row.

    found_in: 'file' for a statement of its own (the one with the highest cosine, ties by licence name, then the one with the most words), 'directory' for
    an inherited licence (license_dir names the directory), null for none.  A directory's licence is that of its licence
    file with the highest cosine, then the smallest path.  Null and empty texts have no statement, long ones are read whole, null paths inherit nothing.
    Repeated rows repeat their result; an empty table gives an empty one; other columns are ignored, whatever their names.
    """
    text = F.coalesce(files[text_column], F.lit(""))
    base = files.select(files[id_column].alias("doc_id"), files[path_column].alias("path"), text.alias("body"))
    named = F.coalesce(F.col("path").rlike(LICENSE_NAMES), F.lit(False))
    none = F.array().cast("array<string>")
    base = base.select("doc_id", "path", word_count(F.col("body")).alias("n_words"), F.when(F.col("body").rlike(CUES), _statements(F.col("body"), named)).otherwise(none).alias("statements"))
    base = materialize(base, "license-lines")
    distinct = base.where(F.size("statements") > 0).select(F.explode("statements").alias("statement")).distinct()
    scored = materialize(score_statements(distinct, templates).where(F.col("cosine") >= MIN_COSINE), "license-scores")
    n_scored = scored.count()
    stated = base.where(F.size("statements") > 0).select("doc_id", "path", "n_words", F.explode("statements").alias("statement"))
    hits = stated.join(small_side(scored, n_scored), "statement")
    said = word_count(F.col("statement"))
    own = hits.groupBy("doc_id", "path").agg(F.min(F.struct((-F.col("cosine")).alias("c"), "license", (-said).alias("w"))).alias("best"), F.max("n_words").alias("n_words"))
    own = materialize(own.select("doc_id", "path", F.col("best.license").alias("license"), (-F.col("best.c")).alias("cosine"), (-F.col("best.w") >= MIN_SHARE * F.col("n_words")).alias("mostly")), "license-own")
    directory = F.regexp_replace(F.col("path"), r"/?[^/]*$", "")
    licensing = own.where(F.col("path").isNotNull() & (F.col("mostly") | F.col("path").rlike(LICENSE_NAMES)))
    of_directory = licensing.groupBy(directory.alias("license_dir")).agg(F.min(F.struct((-F.col("cosine")).alias("c"), "path", "license")).alias("best"))
    of_directory = materialize(of_directory.select("license_dir", F.col("best.license").alias("dir_license"), (-F.col("best.c")).alias("dir_cosine")), "license-dirs")
    # ancestors of the distinct directories, not of every file
    dirs = base.where("path is not null").select(directory.alias("dir")).distinct()
    parts = F.split("dir", "/")
    ancestors = dirs.select("dir", F.explode(F.sequence(F.lit(0), F.size(parts))).alias("depth"), parts.alias("parts"))
    ancestors = ancestors.select("dir", "depth", F.array_join(F.slice("parts", 1, F.col("depth")), "/").alias("license_dir")).where("depth = 0 or license_dir <> '' or dir = ''")
    nearest = ancestors.join(small_side(of_directory, of_directory.count()), "license_dir")
    nearest = nearest.groupBy("dir").agg(F.max_by(F.struct("license_dir", "dir_license", "dir_cosine"), "depth").alias("near"))
    nearest = materialize(nearest, "license-nearest")
    single = own.select(F.col("doc_id").alias("_id"), F.col("path").alias("_path"), "license", "cosine")
    joined = base.select("doc_id", "path", directory.alias("_dir")).join(single, F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("path").eqNullSafe(F.col("_path")), "left")
    joined = joined.join(small_side(nearest, nearest.count()), F.col("_dir") == F.col("dir"), "left")
    has_own, inherited = F.col("license").isNotNull(), F.col("near").isNotNull()
    return joined.select(
        "doc_id",
        "path",
        F.coalesce("license", "near.dir_license").alias("license"),
        F.coalesce("cosine", "near.dir_cosine").alias("cosine"),
        F.when(has_own, "file").when(inherited, "directory").alias("found_in"),
        F.when(~has_own & inherited, F.col("near.license_dir")).alias("license_dir"),
    )
