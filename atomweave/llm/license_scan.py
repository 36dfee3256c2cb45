"""License scans: TF-IDF cosine of headers and licence files to templates, then inheritance from the nearest ancestor directory.
DataFrame functions only.

What is compared of a text, as a sparse vector of term weights each: its header (the comment lines it begins with), each of
its lines, each of its paragraphs (lines between blank ones, so wrapped notices are whole), and, of a licence file, the whole
text; always only what holds a licence word. Equal parts are one row with a count from the start, so a notice that a third of
all files carry is scored once. Document frequencies are counted over all parts of the corpus; a part and a template
meet only on the terms both have (the templates are a fixed list, so that side is broadcast). A file's own licence is that of
its best part.

A file without one inherits from the licence files (named LICENSE, COPYING or NOTICE, with any ending) of the nearest
directory above it, up to the root: each distinct directory is joined by equality with the paths of its ancestors, and the
deepest hit is taken; files then join their directory. Relative paths have the root "", absolute ones "/", and neither
inherits from the other. Directories in which very many files lie, or which stand above very many, are broadcast (common.told).

Defined results: null text has no notice; a null path has no directory and inherits nothing; of several licence files of
a directory the least licence name counts; ties of score go to the least name; texts of any length are read whole; repeated
rows each get their row; other columns are never read; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, text_of, told

LEAST_COSINE = 0.6
NOTICE = r"(?i)licen[sc]e|copyright|spdx|public domain|permission is hereby granted|permission to use|redistribution and use|all rights reserved|unencumbered|as-is"
LICENSE_FILE = r"(?i)^(licen[sc]e|copying|notice)([.\-_].*)?$"
COMMENT = r"^\s*(?:$|//|/\*|\*|#|--|;|%|<!--|\"\"\"|''')"
#: Notices of public licences, and the short licences themselves.
TEMPLATES = [
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and dedicated this work to the public domain under CC0 1.0."),
    ("CC0-1.0", "SPDX-License-Identifier: CC0-1.0"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/."),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."),
    ("ISC", "SPDX-License-Identifier: ISC"),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-3.0", "SPDX-License-Identifier: LGPL-3.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."),
    ("MIT", "MIT License Copyright (c) Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"),
    ("proprietary", "Copyright. All rights reserved."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely."),
]


def terms_of(part: Column) -> Column:
    return F.filter(F.split(F.lower(part), r"[^a-z0-9.]+|\.(?![a-z0-9])"), lambda x: x != "")


def parts_of(text: Column, is_file: Column) -> Column:
    """The distinct parts of a text that hold a licence word: lines, paragraphs, the header, and the whole of a licence file."""
    lines = F.split(text, "\n", -1)
    code = F.array_position(F.transform(lines, lambda x: x.rlike(COMMENT)), F.lit(False)).cast("int")
    header = F.array_join(F.when(code == 0, lines).otherwise(F.slice(lines, F.lit(1), F.greatest(code - 1, F.lit(0)))), "\n")
    # a line of nothing but comment marks parts paragraphs as a blank one does
    paragraphs = F.split(text, r"\n[\s/#*;%-]*\n", -1)
    parts = F.concat(lines, paragraphs, F.array(header), F.when(is_file, F.array(text)).otherwise(F.array().cast("array<string>")))
    parts = F.array_distinct(F.transform(F.filter(parts, lambda x: x.rlike(NOTICE)), lambda x: F.trim(x)))  # trim by itself would take the index as what to trim
    return F.when(text.rlike(NOTICE), parts).otherwise(F.array().cast("array<string>"))


def part_licenses(parts: DataFrame, least: float = LEAST_COSINE) -> DataFrame:
    """parts(__p, __part, __n) distinct and checkpointed -> (__p, license, score) of those that reach the least cosine.

    First only the templates' terms are counted, which are a fixed list. With them the product of a part and a template is known, and a floor of the
    part's length: any other term weighs at least 1, as no document frequency exceeds the number of parts. Parts whose cosine can't reach
    the least under that floor are done; only the others are counted in all their terms. No part that reaches it is lost.
    """
    spark = parts.sparkSession
    numbered = parts.select(F.monotonically_increasing_id().alias("__i"), "__p", "__n", terms_of(F.col("__part")).alias("__terms"))
    total = F.broadcast(parts.agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("__total")))  # one row
    idf = F.log((F.col("__total") + 1) / (F.coalesce("__df", F.lit(0)) + 1)) + 1
    templates = spark.createDataFrame([(i, name, text) for i, (name, text) in enumerate(TEMPLATES)], "t int, license string, text string")
    own = templates.select("t", "license", F.explode(terms_of(F.col("text"))).alias("term")).groupBy("t", "license", "term").agg(F.count(F.lit(1)).alias("tf"))
    held = numbered.select("__i", "__n", F.size("__terms").alias("__size"), F.explode("__terms").alias("term")).join(F.broadcast(own.select("term").distinct()), "term")
    held = checkpointed(held.groupBy("__i", "__n", "__size", "term").agg(F.count(F.lit(1)).alias("tf")))
    df = held.groupBy("term").agg(F.sum("__n").alias("__df"))  # as many rows as the templates have terms
    known = own.join(df, "term", "left").crossJoin(total).select("t", "license", "term", (F.col("tf") * idf).alias("v"))
    known = known.join(known.groupBy("t").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("t_norm")), "t")
    weighed = held.join(F.broadcast(df), "term").crossJoin(total).withColumn("w", F.col("tf") * idf)
    floors = weighed.groupBy("__i").agg((F.sum(F.col("w") * F.col("w")) + F.max("__size") - F.sum("tf")).alias("__floor"))
    dots = weighed.join(F.broadcast(known), "term").groupBy("__i", "t", "license", "t_norm").agg(F.sum(F.col("w") * F.col("v")).alias("dot"))
    sure = checkpointed(dots.join(floors, "__i").filter(F.col("dot") >= (least - 1e-6) * F.sqrt("__floor") * F.col("t_norm")).drop("__floor"))
    some = numbered.join(sure.select("__i").distinct(), "__i", "left_semi")
    tf = some.select("__i", F.explode("__terms").alias("term")).groupBy("__i", "term").agg(F.count(F.lit(1)).alias("tf"))
    every = numbered.select("__n", F.explode(F.array_distinct("__terms")).alias("term")).groupBy("term").agg(F.sum("__n").alias("__df"))
    norms = tf.join(every, "term").crossJoin(total).groupBy("__i").agg(F.sqrt(F.sum(F.pow(F.col("tf") * idf, F.lit(2.0)))).alias("norm"))
    scored = sure.join(norms, "__i").withColumn("score", F.round(F.col("dot") / (F.col("norm") * F.col("t_norm")), 6)).filter(F.col("score") >= least)
    best = scored.groupBy("__i").agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("license"))).alias("b"))
    return best.join(numbered.select("__i", "__p"), "__i").select("__p", F.col("b.license").alias("license"), (-F.col("b.s")).alias("score"))


def ancestors(directory: Column) -> Column:
    """A directory ('' or ending in /) and all above it, up to the root of its kind of path."""
    names = F.split(directory, "/", -1)
    above = F.transform(F.sequence(F.lit(1), F.size(names)), lambda i: F.concat(F.array_join(F.slice(names, F.lit(1), i - 1), "/"), F.when(i > 1, F.lit("/")).otherwise(F.lit(""))))
    return F.filter(above, lambda x: ~(directory.startswith("/") & (x == "")))


def inherited(files: DataFrame) -> DataFrame:
    """files (__dir, __name, own_license, ...) -> with __near: (n, __above, __license) of the nearest directory above that gives one, or null."""
    given = files.filter(F.col("own_license").isNotNull() & F.col("__name").rlike(LICENSE_FILE)).groupBy(F.col("__dir").alias("__above")).agg(F.min("own_license").alias("__license"))
    dirs = checkpointed(files.filter(F.col("__dir").isNotNull()).groupBy("__dir").agg(F.count(F.lit(1)).alias("__n")))
    above = checkpointed(dirs.select("__dir", F.explode(ancestors(F.col("__dir"))).alias("__above")))
    given = checkpointed(above.groupBy("__above").agg(F.count(F.lit(1)).alias("__n")).join(given, "__above"))
    nearest = told(above, given, ["__above"]).groupBy("__dir").agg(F.max(F.struct(F.length("__above").alias("n"), F.col("__above"), F.col("__license"))).alias("__near"))
    return told(files, checkpointed(dirs.join(nearest, "__dir")), ["__dir"], how="left")


def scan(df: DataFrame, path: Column, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST_COSINE) -> DataFrame:
    """One row per row of df: identifier, path, own_license, own_score, license, inherited_from (the directory, null if its own)."""
    rows = df.select(F.col(id_col).alias("__id"), path.alias("__path"), text_of(text_col).alias("__text"))
    rows = rows.withColumn("__dir", F.regexp_extract("__path", r"^((?:.*/)?)[^/]*$", 1)).withColumn("__name", F.regexp_extract("__path", r"([^/]*)$", 1))
    is_file = F.coalesce(F.col("__name").rlike(LICENSE_FILE), F.lit(False))
    rows = checkpointed(rows.select("__id", "__path", "__dir", "__name", parts_of(F.col("__text"), is_file).alias("__parts"))).withColumn("__key", F.monotonically_increasing_id())  # a row's own number
    noted = rows.select("__key", F.explode("__parts").alias("__part")).select("__key", F.sha2("__part", 256).alias("__p"), "__part")
    parts = checkpointed(noted.groupBy("__p").agg(F.any_value("__part").alias("__part"), F.count(F.lit(1)).alias("__n")))
    named = checkpointed(parts.select("__p", "__n").join(part_licenses(parts, least), "__p"))
    best = told(noted.drop("__part"), named, ["__p"]).groupBy("__key").agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("license"))).alias("b"))
    files = rows.drop("__parts").join(best, "__key", "left").select("__id", "__path", "__dir", "__name", F.col("b.license").alias("own_license"), (-F.col("b.s")).alias("own_score"))
    out = inherited(checkpointed(files))
    lacks = F.col("own_license").isNull()
    return out.select(F.col("__id").alias(id_col), F.col("__path").alias("path"), "own_license", "own_score", F.coalesce("own_license", "__near.__license").alias("license"), F.when(lacks, F.col("__near.__above")).alias("inherited_from"))
