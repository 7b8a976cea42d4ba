"""License scan: MinHash bands over overlapping text windows retrieve templates, exact containment verifies them.

DataFrame functions only. Windows are as long as a template and overlap by 7/8, so one of them holds at least 15/16
of any passage that holds the template; only windows near an anchor (a five-word shingle of the template) are made, since
others contain none of it, and only for documents that may hold enough of it (see anchors). Windows and templates get
64 MinHash values in 32 bands of 2. What is accepted is containment 0.8, where the window's similarity can be as low as
0.6: then a band is shared with probability 1 - (1 - 0.36)**32, all but 1 in 1.5 million. Retrieved pairs are verified
by the exact share of the template's shingles that the window, widened by 1/8 at each end, contains.

Licenses share wording. Where another license's template holds half of a template's shingles, a pair counts only if the
window also contains OWN, half, of the shingles that this other one lacks (if there are any). Of hits of several licenses that
overlap by half of the shorter one's words the one with most containment stays, then the one of the longer template, then
the first by name: two clauses that a third follows are one notice of three.

Defined results: null and empty texts match nothing; templates of fewer than five words are one shingle; repeated
documents are reported each, once for a license (best, then first window); empty tables give empty ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_broadcast, kept, scratch, stage
from .native_text import anchors, keyed, shingle_hashes, word_list

BANDS, ROWS = 32, 2
#: Least share of the shingles that tell a template from its like; words of a cell in which overlapping hits meet.
OWN, CELL = 0.5, 64
#: Notices by which public licenses are declared: (license, text). Fixed values.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("Proprietary", "All rights reserved."),
    ("Proprietary", "All rights reserved. No part of this work may be reproduced without permission."),
)


def template_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(TEMPLATES), "license string, text string")


def minhash_bands(items: Column) -> Column:
    """Array of (band, value): each hashes the two least values of the shingles under two seeded hashes."""
    least = lambda k: F.array_min(F.transform(items, lambda h: F.xxhash64(h, F.lit(k))))
    return F.array(*[F.struct(F.lit(b).alias("band"), F.xxhash64(*[least(b * ROWS + r) for r in range(ROWS)]).alias("value")) for b in range(BANDS)])


def _set(words: Column, size: int) -> Column:
    return F.when(F.size(words) < size, F.array(F.xxhash64(F.array_join(words, "\x01")))).otherwise(F.array_distinct(shingle_hashes(words, size)))


def _against(known: DataFrame) -> DataFrame:
    """(pid, against): for each template of another license that holds half of this one's shingles, those it lacks.

    Templates are a list of licenses, so that their pairs are few."""
    each = known.select("pid", "license", "set", F.explode("set").alias("h"))
    other = known.select(F.col("pid").alias("p2"), F.col("license").alias("l2"), F.col("set").alias("s2"), F.explode("set").alias("h"))
    like = each.join(other, "h").where("license != l2").groupBy("pid", "p2").agg(F.count("*").alias("c"), F.first("set").alias("set"), F.first("s2").alias("s2"))
    lacks = like.where(F.col("c") * 2 >= F.size("set")).select("pid", F.array_except("set", "s2").alias("d")).where(F.size("d") > 0)
    return lacks.groupBy("pid").agg(F.collect_set("d").alias("against"))


def scan(docs: DataFrame, templates: DataFrame, id_col: str = "doc_id", text_col: str = "text", license_col: str = "license", template_text: str = "text", size: int = 5, containment: float = 0.8) -> DataFrame:
    """(doc_id, license, start_word, containment) for each document and license found in it."""
    with scratch(docs.sparkSession):
        known = templates.select(F.monotonically_increasing_id().alias("pid"), F.col(license_col).alias("license"), word_list(F.col(template_text)).alias("words")).where(F.size("words") > 0)
        known = stage(known.withColumn("n", F.size("words")).withColumn("set", _set(F.col("words"), size)), "templates")
        known = stage(known.join(_against(known), "pid", "left").withColumn("against", F.coalesce("against", F.array().cast("array<array<bigint>>"))), "templates")

        base = keyed(docs, id_col, text_col)
        found = stage(anchors(base.select("k", "text"), known.select("pid", "words"), size, containment), "anchors")
        wanted = stage(found.select("k").distinct(), "wanted")
        hit = stage(base.join(bounded_broadcast(wanted), "k").select("k", "doc_id", word_list(F.col("text")).alias("all")), "hit")
        step = F.greatest(F.lit(1), F.floor(F.col("n") / 8)).cast("int")
        grid = found.withColumn("step", step).withColumn("first", F.floor(F.greatest("at", F.lit(0)) / F.col("step")).cast("int"))
        spots = grid.select("k", "n", "step", F.explode(F.array("first", F.col("first") + 1)).alias("g")).select("k", "n", "step", (F.col("g") * F.col("step")).alias("at")).distinct()
        windows = hit.dropDuplicates(["k"]).join(spots, "k").withColumn("words", F.slice("all", F.col("at") + 1, F.col("n"))).where(F.size("words") > 0)
        wide = F.slice("all", F.greatest(F.lit(1), F.col("at") + 1 - F.col("step")), F.col("n") + 2 * F.col("step"))
        windows = windows.select("k", "n", "at", _set(F.col("words"), size).alias("own"), _set(wide, size).alias("wide"), F.array_join(wide, " ").alias("plain"))
        windows = stage(windows, "windows")

        asked = windows.select("k", "n", "at", F.explode(minhash_bands(F.col("own"))).alias("b")).select("k", "n", "at", "b.*")
        index = known.select("pid", "license", "n", F.explode(minhash_bands(F.col("set"))).alias("b")).select("pid", "license", "n", "b.*")
        pairs = asked.join(bounded_broadcast(index), ["n", "band", "value"]).select("k", "n", "at", "pid", "license").distinct()
        both = pairs.join(windows, ["k", "n", "at"]).join(bounded_broadcast(known.select("pid", "set", "against", F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" ")).alias("line"))), "pid")
        share = F.size(F.array_intersect("wide", "set")) / F.size("set")
        short = F.contains(F.concat(F.lit(" "), F.col("plain"), F.lit(" ")), F.col("line")).cast("double")
        theirs = (F.col("n") < size) | F.forall("against", lambda d: F.size(F.array_intersect(F.col("wide"), d)) >= F.size(d) * OWN)
        scored = both.withColumn("containment", F.round(F.when(F.col("n") < size, short).otherwise(share), 6)).where((F.col("containment") >= containment) & theirs)
        scored = stage(scored.select("k", "license", "at", "n", "containment"), "scored")
        # hits that overlap share a cell of words; hits stand on a grid, so a cell holds few whatever the text
        cell = F.explode(F.sequence(F.floor(F.col("at") / CELL), F.floor((F.col("at") + F.col("n") - 1) / CELL)))
        spread = scored.withColumn("cell", cell)
        rivals = spread.select("k", "cell", *[F.col(c).alias(f"r_{c}") for c in ("license", "at", "n", "containment")])
        first, last = F.greatest("at", "r_at"), F.least(F.col("at") + F.col("n"), F.col("r_at") + F.col("r_n"))
        rank = lambda t: F.struct(-F.col(f"{t}containment"), -F.col(f"{t}n"), F.col(f"{t}license"))
        met = spread.join(rivals, ["k", "cell"]).where((F.col("license") != F.col("r_license")) & ((last - first) * 2 >= F.least("n", "r_n")) & (rank("r_") < rank("")))
        scored = scored.join(met.select("k", "license", "at", "n").distinct(), ["k", "license", "at", "n"], "left_anti")
        best = scored.groupBy("k", "license").agg(F.max(F.struct("containment", -F.col("at"))).alias("t"))
        best = stage(best.select("k", "license", (-F.col("t.col2")).alias("start_word"), "t.containment"), "licenses")
        return kept(stage(hit.select("k", "doc_id").join(bounded_broadcast(best), "k").select("doc_id", "license", "start_word", "containment"), "found"))
