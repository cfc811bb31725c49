"""License scan with DataFrame expressions only: MinHash bands over overlapping windows, then exact shingle containment.

Words are runs of a-z and 0-9 after A-Z have been put in lower case; shingles are five words. Windows are of two sizes. A short
template (under ``WIDE`` shingles) is looked for by windows of one shingle: the MinHash of a set of one is its member, so that one band collides with
probability 1, and more bands or a larger window would only cost recall. A longer one is cut into
windows of ``WIDE`` shingles at every offset, and a text into windows of as many at every ``STEP`` shingles, so an unedited
stretch of WIDE + STEP - 1 shingles holds a window equal to one of the template's. Each window has ``len(SALTS)`` bands of one
row, the least value of shingle hash XOR salt; windows of Jaccard similarity s share a band with probability 1 - (1 - s)^8: 99.6 % at one half.

A template that shares a band with any window is verified on the whole text: it is found if at least 75 % of its distinct
shingles occur there. Two scans of the texts. The first gives rows of (doc_id, band) only, to a join with the template bands, which are broadcast if measured to be
small; up to ``LITERALS`` of them are tested in the scan itself, so that hardly a row leaves it. The second makes shingles again only of texts with hits, which are broadcast
if measured to be small. Neither shuffles a text unless the hits are too many for that; a template's shingles are kept once.

Cases: null and empty texts and those of fewer than five words match nothing, nor do templates of fewer than five words; rows with equal
doc_id are matched each and give equal rows once; extra columns are ignored. Very long texts are scanned whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import cut, drop_cut, small

SHINGLE = 5
WIDE, STEP = 8, 4
LEAST = 0.75
#: Template bands up to which the scan tests them itself; beyond it every band of a text goes to the join.
LITERALS = 20_000
SALTS = tuple((0x9E3779B97F4A7C15 * (i + 1)) % (1 << 63) for i in range(8))

# Public notices by which a license is declared, and texts of licenses.
_MIT_GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"
_MIT_REST = ", subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_NOTICE = ", provided that the above copyright notice and this permission notice appear in all copies."
_ISC_REST = " THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
_BSD_GRANT = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
_BSD_TWO = ": 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_THREE = " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_REST = " THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_GNU = "{0} is free software: you can redistribute it and/or modify it under the terms of the GNU {1} as published by the Free Software Foundation, either version {2} of the License, or (at your option) any later version."
_GNU_REST = " {0} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {1} for more details. You should have received a copy of the GNU {1} along with this program. If not, see <https://www.gnu.org/licenses/>."
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", _MIT_GRANT),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", _GNU.format("This program", "General Public License", "3")),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("BSD", _BSD_GRANT),
    ("ISC", _ISC_GRANT + _ISC_NOTICE),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("MIT", _MIT_GRANT + _MIT_REST),
    ("MIT", _MIT_REST),
    ("ISC", _ISC_GRANT + _ISC_NOTICE + _ISC_REST),
    ("0BSD", _ISC_GRANT + "." + _ISC_REST),
    ("BSD-2-Clause", _BSD_GRANT + _BSD_TWO + _BSD_REST),
    ("BSD-3-Clause", _BSD_GRANT + _BSD_TWO + _BSD_THREE + _BSD_REST),
    ("BSD", _BSD_REST),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("GPL-2.0", _GNU.format("This program", "General Public License", "2").replace("software:", "software;")),
    ("GPL-3.0", _GNU.format("This program", "General Public License", "3") + _GNU_REST.format("This program", "General Public License")),
    ("LGPL-2.1", _GNU.format("This library", "Lesser General Public License", "2.1").replace("software:", "software;")),
    ("LGPL-3.0", _GNU.format("This library", "Lesser General Public License", "3")),
    ("AGPL-3.0", _GNU.format("This program", "Affero General Public License", "3")),
    ("AGPL-3.0", _GNU.format("This program", "Affero General Public License", "3") + _GNU_REST.format("This program", "Affero General Public License")),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("BSL-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor."),
    ("PostgreSQL", "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies."),
    ("WTFPL", "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION 0. You just DO WHAT THE FUCK YOU WANT TO."),
)


def templates(spark: SparkSession, rows=TEMPLATES) -> DataFrame:
    """template (number), license, text."""
    made = F.array(*[F.struct(F.lit(i).alias("template"), F.lit(name).alias("license"), F.lit(text).alias("text")) for i, (name, text) in enumerate(rows)])
    return spark.range(1).select(F.explode(made).alias("x")).select("x.*")


def shingles(text: Column) -> tuple[Column, Column]:
    """The words, to be named __w, and from them the shingle hashes in order; an empty array for fewer than five words."""
    low = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.array_remove(F.split(low, "[^a-z0-9]+"), "")
    # items are got one by one: slice() copies the whole array each time
    made = F.transform(F.sequence(F.lit(0), F.size("__w") - SHINGLE), lambda i: F.xxhash64(*[F.get("__w", i + k) for k in range(SHINGLE)]))
    return words, F.when(F.size("__w") >= SHINGLE, made).otherwise(F.array().cast("array<bigint>"))


def with_shingles(df: DataFrame) -> DataFrame:
    """Adds ``sh``."""
    words, made = shingles(F.col("text"))
    return df.where(F.col("text").isNotNull()).withColumn("__w", words).withColumn("sh", made).drop("__w", "text")


def bands(windows: Column) -> Column:
    """The bands of all windows, flat."""
    salts = F.array(*[F.lit(s) for s in SALTS])
    return F.flatten(F.transform(windows, lambda w: F.transform(salts, lambda s: F.array_min(F.transform(w, lambda h: h.bitwiseXOR(s))))))


def windows(step: int, sh: str = "sh") -> Column:
    """Windows of WIDE shingles; the last may be shorter."""
    last = F.greatest(F.lit(0), F.size(sh) - (WIDE - step + 1))
    return F.transform(F.sequence(F.lit(0), last, F.lit(step)), lambda i: F.array(*[F.get(sh, i + k) for k in range(WIDE)]))


def scan(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """doc_id, template, license, n_found, containment of every match. ``known``: template, license, text."""
    spark = docs.sparkSession
    known = with_shingles((templates(spark) if known is None else known).select("template", "license", "text")).withColumn("sh", F.array_distinct("sh"))
    known = cut(known.where(F.size("sh") > 0).select("template", "license", F.col("sh").alias("t_sh")), "templates")
    short = F.size("t_sh") < WIDE
    bands_of = F.explode(F.array_distinct(F.when(short, F.col("t_sh")).otherwise(bands(windows(1, "t_sh")))))
    keyed = cut(known.select("template", bands_of.alias("key")), "bands")
    literals = [r[0] for r in keyed.select("key").distinct().limit(LITERALS + 1).collect()]

    # No filter on a derived array and no plain explode, from which one is inferred: pushed below, it would bring the expressions that make
    # the array into each step of the loops over it. An outer explode has a null key for texts without a hit, which the join drops.
    rows = with_shingles(docs.select("doc_id", "text"))
    keys = F.concat(F.col("sh"), bands(windows(STEP)))
    if len(literals) <= LITERALS:
        keys = F.filter(keys, lambda k: k.isin(literals))
    met = rows.withColumn("keys", keys).select("doc_id", F.explode_outer(F.array_distinct("keys")).alias("key")).join(small(keyed), "key")
    hits = cut(met.select(F.col("doc_id").alias("__id"), "template").distinct(), "hits")
    drop_cut(keyed)

    held = docs.select("doc_id", "text").join(small(hits.groupBy("__id").agg(F.collect_set("template").alias("__templates"))), F.col("doc_id").eqNullSafe(F.col("__id")))
    held = with_shingles(held.select("doc_id", "text", "__templates")).select("doc_id", F.array_distinct("sh").alias("sh"), F.explode("__templates").alias("template"))
    found = held.join(small(known), "template").select("doc_id", "template", "license", F.size(F.array_intersect("sh", "t_sh")).alias("n_found"), F.size("t_sh").alias("n"))
    return found.where(F.col("n_found") >= F.col("n") * LEAST).distinct().select("doc_id", "template", "license", "n_found", (F.col("n_found") / F.col("n")).alias("containment"))
