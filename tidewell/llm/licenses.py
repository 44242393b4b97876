"""License notices in documents: MinHash of overlapping windows proposes templates, shared shingles decide.

Templates and windows are sets of five-word shingles. A template of n shingles is looked for in windows of 2c
shingles that start every c, with c the power of two from n up: any occurrence lies whole in one of them, and its
similarity to the window is over 1/4 (over 0.19 if a fifth of the template is missing). Bands of one sample
then miss it with probability 0.81 ^ BANDS. A window can only agree on a band if it holds the very shingle that gave
the template its smallest value, so windows without any of these shingles are left out before any hashing.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHINGLE = 5
#: Misses a notice with four fifths of its shingles in place with probability 0.81 ^ 64 = 1.4e-6.
BANDS = 64
#: Shingles of a template that must be in the window, in percent.
PERCENT = 80

#: Notices of public licenses (fixed values): license and wording.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to
permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies
or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN
AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the
License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS"
BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("GPL-2.0", """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software
Foundation; either version 2 of the License, or (at your option) any later version."""),
    ("GPL-3.0", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software
Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without
even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""),
    ("LGPL-2.1", """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free
Software Foundation; either version 2.1 of the License, or (at your option) any later version."""),
    ("LGPL-3.0", """it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option)
any later version."""),
    ("AGPL-3.0", """it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option)
any later version."""),
    ("BSD-2-Clause", """Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form
must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""),
    ("BSD-3-Clause", """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without
specific prior written permission."""),
    ("BSD-4-Clause", "All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by"),
    ("BSD", """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED
OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this
permission notice appear in all copies."""),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED"),
    ("Zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this
software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following
restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software."""),
    ("Unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software,
either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""),
    ("BSL-1.0", """Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at"""),
    ("BSL-1.0", """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license
(the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software"""),
    ("EPL-2.0", """This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at"""),
    ("EPL-1.0", """All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution"""),
    ("CDDL-1.0", """The contents of this file are subject to the terms of the Common Development and Distribution License (the "License"). You may not use this file except in
compliance with the License."""),
    ("MPL-1.1", """The contents of this file are subject to the Mozilla Public License Version 1.1 (the "License"); you may not use this file except in compliance with the License."""),
    ("MPL-2.0", "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("CC0-1.0", """To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide."""),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-SA-3.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License."),
    ("CC-BY-SA", "Text is available under the Creative Commons Attribution-ShareAlike License; additional terms may apply."),
    ("CC-BY-ND-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-NC-SA-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ("CC-BY-NC-ND-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."),
    ("GFDL-1.3", """Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.3 or any later version
published by the Free Software Foundation"""),
    ("OFL-1.1", "This Font Software is licensed under the SIL Open Font License, Version 1.1. This license is copied below, and is also available with a FAQ at"),
    ("PostgreSQL", """Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby
granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies."""),
    ("WTFPL", "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed."),
    ("Artistic-2.0", "This is free software; you can redistribute it and/or modify it under the terms of the Artistic License 2.0."),
    ("NCSA", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal with the
Software without restriction"""),
    ("MS-PL", "This license governs use of the accompanying software. If you use the software, you accept this license. If you do not accept the license, do not use the software."),
)


def tokens(text: Column) -> Column:
    """Words of letters a-z and digits, in lower case."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda w: w != "")


def shingles(words: Column) -> Column:
    """Hash of every run of SHINGLE words, in order."""
    last = F.size(words) - SHINGLE
    runs = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(SHINGLE))))
    return F.when(last >= 0, runs).otherwise(F.array().cast("array<bigint>"))


def band_values(items: Column) -> Column:
    """The smallest value of every hash function over a set."""
    def smallest(i: int) -> Column:
        return F.array_min(F.transform(items, lambda s: F.xxhash64(s, F.lit(i))))

    return F.array(*(smallest(i) for i in range(BANDS)))


def template_table(spark: SparkSession, templates: Sequence[tuple[str, str]]) -> DataFrame:
    """(template, license, items, c, keys): shingle set, window unit and band values; templates of fewer than five words are left out."""
    rows = spark.createDataFrame([(i, name, text) for i, (name, text) in enumerate(templates)], "template int, license string, text string")
    sets = rows.withColumn("items", F.array_distinct(shingles(tokens(F.col("text"))))).where(F.size("items") > 0)
    unit = F.pow(F.lit(2.0), F.ceil(F.log2(F.size("items").cast("double")))).cast("int")
    return sets.withColumn("c", unit).withColumn("keys", band_values(F.col("items"))).drop("text")


def license_hits(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document id and template found: license, template, share of its shingles in the best window, first word.

    Null or empty texts, and texts of fewer than five words, hold nothing; a tie between windows goes to the first; repeated rows
    of one document give one row; other columns are not read; an empty table gives an empty table.
    """
    spark = docs.sparkSession
    # the list is a parameter of a few entries, not data that grows
    known = template_table(spark, templates).collect()
    table = spark.createDataFrame(
        [(r.template, r.license, r.items, r.c, r["keys"]) for r in known],
        "template int, license string, items array<bigint>, c int, keys array<bigint>",
    )
    # the shingles that give the templates their smallest values, by window unit
    seeds = (
        table.select("c", F.explode("items").alias("s"), "keys")
        .where(reduce(lambda a, b: a | b, (F.col("keys")[i] == F.xxhash64("s", F.lit(i)) for i in range(BANDS))))
        .groupBy("c").agg(F.collect_set("s").alias("s")).collect()
    )
    # the words are bound once for all shingles of a text, and the shingles are a row of their own before any filter,
    # or the optimiser would work them out again for each use
    hashed = F.transform(F.array(tokens(F.col(text))), shingles)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.explode(hashed).alias("all"))
    every = F.array(*(F.lit(s) for r in seeds for s in r.s)).cast("array<bigint>")
    rows = rows.where(F.arrays_overlap("all", every))

    def windows(c: int, own: list[int]) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size("all") - 1, F.lit(0)), F.lit(c))
        cut = F.transform(
            starts, lambda at: F.struct(F.lit(c).alias("c"), at.alias("start"), F.slice("all", at + 1, F.lit(2 * c)).alias("items"))
        )
        return F.filter(cut, lambda w: F.arrays_overlap(w["items"], F.array(*(F.lit(s) for s in own)).cast("array<bigint>")))

    opened = rows.select("doc_id", F.inline(F.concat(*(windows(r.c, r.s) for r in seeds)))) if seeds else None
    if opened is None:
        return spark.createDataFrame([], f"doc_id {docs.schema[doc_id].dataType.simpleString()}, license string, template bigint, contained_permille bigint, first_word bigint")
    bands = opened.select("doc_id", "c", "start", "items", F.posexplode(band_values(F.array_distinct("items"))).alias("band", "key"))
    buckets = table.select(
        F.col("template"), "license", F.col("items").alias("wanted"), F.col("c").alias("t_c"), F.posexplode("keys").alias("t_band", "t_key")
    )
    # the templates are a short list given by the caller: BANDS rows each
    met = bands.join(
        F.broadcast(buckets), (F.col("c") == F.col("t_c")) & (F.col("band") == F.col("t_band")) & (F.col("key") == F.col("t_key"))
    )
    shared = F.size(F.array_intersect("items", "wanted"))
    first = F.array_min(F.filter(F.transform("wanted", lambda s: F.array_position("items", s)), lambda p: p > 0))
    sure = met.where(shared * 100 >= F.size("wanted") * PERCENT).select(
        "doc_id", "license", "template",
        F.struct(
            F.floor(shared * 1000 / F.size("wanted")).alias("permille"), (-(F.col("start") + first - 1)).cast("bigint").alias("before")
        ).alias("hit"),
    )
    best = sure.groupBy("doc_id", "license", "template").agg(F.max("hit").alias("hit"))
    return best.select(
        "doc_id", "license", F.col("template").cast("bigint").alias("template"), F.col("hit.permille").alias("contained_permille"),
        (-F.col("hit.before")).alias("first_word"),
    )
