"""License scan by diagonal voting.

Every word pair of a document is hashed and joined to the pairs of a fixed set of license
templates, whole notices and their well-known sentences; a hit at document place p and
template place t votes for the diagonal p - t. Votes are gathered in bands of neighbouring
diagonals (words put in or left out move a notice's rest by a few diagonals), laid twice so
that a notice lies well inside one of them, and parted where a band has no vote for some
words or a template's place comes again. Each such run is a span; it is verified by how many
of its template's pairs stand in it, by its length, and by the pairs that tell the template
from relatives with other labels: each of those has to be there once, so a notice of another
version or variant is not taken for it. Of spans that overlap, the one that
holds most pairs stands, so a notice is not also taken for its relatives. Pairs of two
function words do not vote. Base phrases are templates too: one stands where a single
diagonal holds all its pairs, which is to say where its words follow one another.

All of it is DataFrame work: the texts are read once, split once and never shuffled. What
is shuffled is one row per document and one per hit.

Edge cases: null and empty texts have no words and no labels; an empty table gives an empty
result; null ids are allowed; equal rows (same id and text) are scanned once and returned
as often as they stand. Other columns of the input are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

#: Fixed values of the contract: phrase, label.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

WARRANTY = "is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."
AS_IS = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. "
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
ENDORSE = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
FSF = "Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA"

#: Well-known notices, as their licenses word them.
TEMPLATES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("mit", "Released under the MIT License"),
    ("apache-2", "Licensed under the Apache License, Version 2.0"),
    ("apache-2", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("gpl-2", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    # whole notices
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("apache-2", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("gpl-3", f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program {WARRANTY} See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."),
    ("gpl-2", f"This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program {WARRANTY} See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program; if not, write to the {FSF}."),
    ("lgpl", f"This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library {WARRANTY} See the GNU Lesser General Public License for more details. You should have received a copy of the GNU Lesser General Public License along with this library; if not, write to the {FSF}"),
    ("agpl-3", f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program {WARRANTY} See the GNU Affero General Public License for more details. You should have received a copy of the GNU Affero General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."),
    ("bsd-2", BSD + AS_IS),
    ("bsd-3", BSD + ENDORSE + AS_IS),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"),
    # relatives, of which a wrong word makes another license
    ("gpl-1", "This work is licensed under the GNU General Public License, version 1"),
    ("gpl-2", "This work is licensed under the GNU General Public License, version 2"),
    ("lgpl", "This work is licensed under the GNU Lesser General Public License, version 2.1"),
    ("lgpl-3", "This work is licensed under the GNU Lesser General Public License, version 3"),
    ("agpl-3", "This work is licensed under the GNU Affero General Public License, version 3"),
    ("agpl-3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("gpl-1", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 1, or (at your option) any later version"),
    ("lgpl-3", f"This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This library {WARRANTY} See the GNU Lesser General Public License for more details. You should have received a copy of the GNU Lesser General Public License along with this library. If not, see <https://www.gnu.org/licenses/>."),
    ("lgpl-3", f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program {WARRANTY} See the GNU Lesser General Public License for more details. You should have received a copy of the GNU Lesser General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."),
    ("lgpl-3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("lgpl-3", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("mpl-1.1", "The contents of this file are subject to the Mozilla Public License Version 1.1"),
    ("mpl-1.1", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 1.1"),
    ("cc-by-nc-sa", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"),
    ("cc-by-nc-nd", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"),
    ("cc-by-nd", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License"),
    ("cc0", "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this work to the public domain worldwide"),
)
#: A pair of two of these does not vote.
FUNCTION_WORDS = frozenset("a an and any are as at be but by for from in is it its may no not of on or that the this to was with you".split())
#: In a Java pattern; the complement of the word characters once A-Z are lower-cased.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """The lower-cased words; KELVIN SIGN, the one other character whose lower case is ASCII, is kept apart."""
    lowered = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit("ĸ")))
    return F.filter(F.split(lowered, NOT_WORD), lambda w: w != "")


def template_words(text: str) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower())


def template_entries(phrases=PHRASES, templates=TEMPLATES) -> list[tuple[str, list[str], bool, list[int]]]:
    """(label, words, whether a base phrase, places of the pairs that vote)."""
    out = []
    for label, text, base in [(label, t, True) for t, label in phrases] + [(label, t, False) for label, t in templates]:
        words = template_words(text)
        out.append((label, words, base, [i for i in range(len(words) - 1) if base or not {words[i], words[i + 1]} <= FUNCTION_WORDS]))
    return out


#: Share of a template's pairs that a relative has too.
RELATED = 0.6
#: Besides digits, as versions have them, the words that tell a license from its relatives.
VARIANTS = frozenset("lesser affero noncommercial sharealike noderivatives".split())


def telling_places(entries: list) -> list[dict[int, int]]:
    """For each template the places of the pairs that tell it from its relatives, with the number of the pair, from 1.

    A relative is a template of another label with most of its pairs. A pair that it does not
    have tells the two apart if a digit or a variant's name is in it, or stands in the
    relative between its words.
    """
    varies = lambda w: w in VARIANTS or (len(w) == 1 and w.isdigit())
    pairs = [{(w[i], w[i + 1]) for i in places} for _, w, _, places in entries]
    out = []
    for (label, words, base, places), own in zip(entries, pairs):
        found: dict[tuple[str, str], int] = {}
        at: dict[int, int] = {}
        for (other, _, other_base, _), theirs in zip(entries, pairs):
            if base or other_base or other == label or len(own & theirs) < RELATED * len(own):
                continue
            between = {(a, d) for a, b in theirs if varies(b) for c, d in theirs if c == b}
            for i in places:
                pair = (words[i], words[i + 1])
                if pair not in theirs and (varies(pair[0]) or varies(pair[1]) or pair in between):
                    at[i] = found.setdefault(pair, len(found) + 1)
        out.append(at)
    return out


def template_pairs(spark, phrases=PHRASES, templates=TEMPLATES) -> DataFrame:
    """(hash, template, place, length, pairs, tells, telling, label, base): the voting pairs of all phrases and templates, some thousand rows."""
    entries = template_entries(phrases, templates)
    telling = telling_places(entries)
    rows = [(i, at, words[at], words[at + 1], len(words), len(places), telling[i].get(at, 0), len(set(telling[i].values())), label, base) for i, (label, words, base, places) in enumerate(entries) for at in places]
    pairs = spark.createDataFrame(rows, "template int, place int, a string, b string, length int, pairs int, tells int, telling int, label string, base boolean")
    return pairs.select(F.xxhash64("a", "b").alias("hash"), "template", "place", "length", "pairs", "tells", "telling", "label", "base")


def license_hits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases=PHRASES, templates=TEMPLATES) -> DataFrame:
    """One row per document with place -1, carrying its word count, and one per pair that a template has."""
    words = words_of(F.col(text_col))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.xxhash64(text_col), F.lit(0)).alias("text_hash"), words.alias("words"))
    n = F.size("words")
    pairs = F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.struct((i - 1).alias("at"), F.xxhash64(F.element_at("words", i), F.element_at("words", i + 1)).alias("hash")))
    itself = F.array(F.struct(F.lit(-1).alias("at"), n.cast("long").alias("hash")))
    spread = rows.select("doc_id", "text_hash", F.explode(F.when(n > 1, F.concat(itself, pairs)).otherwise(itself)).alias("x")).select("doc_id", "text_hash", "x.at", "x.hash")
    known = template_pairs(docs.sparkSession, phrases, templates)
    # the templates are a constant of the program, so their broadcast is bounded
    joined = spread.join(F.broadcast(known.withColumnRenamed("hash", "known")), (F.col("at") >= 0) & (F.col("hash") == F.col("known")), "left")
    own = F.when(F.col("at") < 0, F.col("hash"))
    return joined.filter((F.col("at") < 0) | F.col("template").isNotNull()).select(
        "doc_id", "text_hash", F.coalesce("template", F.lit(-1)).alias("template"), "label", F.coalesce("base", F.lit(False)).alias("base"), "length", "pairs", "tells", "telling", "at", F.coalesce("place", F.lit(0)).alias("place"), own.alias("n_words"),
    )


def license_spans(hits: DataFrame, band: int = 16, max_gap: int = 8, min_cover: float = 0.75, min_words: int = 5) -> DataFrame:
    """Verified spans (doc_id, text_hash, template, label, base, begin, end, cover) and each document's own row.

    The document's row has template -1, its word count and in ``rows`` how often it stands.
    All steps group by the document first, so one shuffle serves them.
    """
    key = ["doc_id", "text_hash"]
    about = ("label", "base", "length", "pairs", "telling", "n_words")
    dealt = hits.repartition(*key)
    found = dealt.groupBy(*key, "template", "at", "place").agg(*(F.first(c).alias(c) for c in (*about, "tells")), F.count("*").alias("rows"))  # equal rows vote once
    single = F.col("base") | (F.col("template") < 0)
    phases = found.withColumn("phase", F.explode(F.when(single, F.array(F.lit(-1))).otherwise(F.array(F.lit(0), F.lit(1)))))
    diagonal = F.col("at") - F.col("place")
    banded = phases.withColumn("band", F.when(F.col("phase") < 0, diagonal).otherwise(F.floor((diagonal + F.col("phase") * (band // 2)) / band)))
    lane = [*key, "template", "phase", "band"]
    along = Window.partitionBy(*lane).orderBy("at", "place")
    fresh = F.when(F.col("at") - F.lag("at").over(along) > max_gap, 1).otherwise(0)
    runs = banded.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(along))
    again = Window.partitionBy(*lane, "run", "place").orderBy("at")
    copies = runs.withColumn("copy", F.row_number().over(again))
    spans = copies.groupBy(*lane, "run", "copy").agg(*(F.first(c).alias(c) for c in about), F.max("rows").alias("rows"), F.count("*").alias("votes"), F.size(F.collect_set(F.when(F.col("tells") > 0, F.col("tells")))).alias("told"), F.min("at").alias("begin"), (F.max("at") + 2).alias("end"))
    whole = F.col("votes") == F.col("pairs")
    covers = (F.col("votes") >= min_cover * F.col("pairs")) & (F.col("told") == F.col("telling")) & (F.col("length") >= min_words) & (F.col("end") - F.col("begin") <= 2 * F.col("length"))
    stand = spans.filter(F.when(F.col("template") < 0, True).when(F.col("base"), whole).otherwise(covers))
    stand = stand.withColumn("cover", F.when(F.col("template") >= 0, F.col("votes") / F.col("pairs")))
    # spans that overlap meet in a cluster; those of the method give way to better ones of another label
    onward = Window.partitionBy(*key, single).orderBy("begin", "end", "template", "phase", "copy")
    apart = F.coalesce(F.col("begin") >= F.max("end").over(onward.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    marked = stand.withColumn("single", single).withColumn("apart", apart.cast("int"))
    clustered = marked.withColumn("cluster", F.sum("apart").over(Window.partitionBy(*key, "single").orderBy("begin", "end", "template", "phase", "copy")))
    columns = ("votes", "cover", "label", "begin", "end", "template", "base", "n_words", "rows")
    met = clustered.groupBy(*key, "single", "cluster").agg(F.collect_list(F.struct(*columns)).alias("spans"))

    def beaten(x: Column, o: Column) -> Column:
        shared = F.least(x["end"], o["end"]) - F.greatest(x["begin"], o["begin"])
        close = shared * 2 >= F.least(x["end"] - x["begin"], o["end"] - o["begin"])
        return (o["label"] != x["label"]) & close & (F.struct(o["votes"], o["cover"], o["label"]) > F.struct(x["votes"], x["cover"], x["label"]))

    best = F.filter("spans", lambda x: ~F.exists("spans", lambda o: beaten(x, o)))
    return met.select(*key, F.explode(F.when(F.col("single"), F.col("spans")).otherwise(best)).alias("x")).select(*key, "x.*")


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, one row per input row."""
    spans = license_spans(license_hits(docs, id_col, text_col), **options)
    base = F.col("base")
    per_doc = spans.groupBy("doc_id", "text_hash").agg(
        F.max("n_words").alias("n_words"),
        F.max(F.when(F.col("template") < 0, F.col("rows"))).alias("rows"),
        F.count(F.when(base, 1)).alias("n_base"),
        F.min(F.when(base, F.col("begin"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("begin"))).cast("long").alias("last_word"),
        F.array_join(F.sort_array(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.collect_set("label")), ",").alias("labels"),
        F.round(F.coalesce(F.max("cover"), F.lit(0.0)), 6).alias("score"),
    )
    times = per_doc.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    return times.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
