"""License scans by diagonal voting, in DataFrame functions only.

Every rolling hash of three words of a document is joined to the places where
license templates have the same three words (and the words are compared). A
match at document word i and template word j votes for the diagonal i - j. Votes
are counted for each document, template and diagonal; diagonals next to each
other, which a word put in or left out makes of one, are merged; a span is
verified by the part of the template's grams it holds and by its length.

The templates are constants of this module: texts and notices of public licenses,
some two thousand grams, so their table is broadcast and the documents' grams
never move before they have joined. A mark goes with each document through the
same join, so one pass gives documents without any vote as well. Words are
letters, digits and everything above ASCII, with A-Z lower-cased.

Defined cases: null or empty texts have no words, places or labels and score 0;
rows with the same id are reported each; texts of one or two words have no
grams; a document of any length is one row of words; a table without rows gives
none; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ckptlake.llm import _text
from ckptlake.llm.store import Scratch

#: Fixed values. Phrases whose places are counted, and their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
#: Fixed values. Notices and texts of public licenses, by label; a placeholder's words are left out.
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction "
        "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so "
        "subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    ),
    (
        "mit",
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement "
        "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with "
        "the software or the use or other dealings in the software",
    ),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies "
        "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    ),
    (
        "apache-2",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at "
        "http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis "
        "without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
    ),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    ),
    (
        "bsd",
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    ),
    (
        "bsd",
        "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability "
        "and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages",
    ),
    (
        "gpl-3",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation "
        "either version 3 of the license or at your option any later version",
    ),
    (
        "gpl-2",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation "
        "either version 2 of the license or at your option any later version",
    ),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    (
        "lgpl-2.1",
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation "
        "either version 2 1 of the license or at your option any later version",
    ),
    (
        "agpl-3",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation "
        "either version 3 of the license or at your option any later version",
    ),
    (
        "mpl-2",
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0",
    ),
    (
        "zlib",
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software "
        "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely",
    ),
    (
        "boost",
        "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software "
        "to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software",
    ),
    (
        "unlicense",
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software "
        "either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    ),
    (
        "cc0",
        "to the extent possible under law the person who associated cc0 with this work has waived all copyright and related or neighboring rights to this work",
    ),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-nd", "this work is licensed under a creative commons attribution noderivatives 4 0 international license"),
]
GRAM = 3
#: How far merged diagonals may be apart, how many words may lie between their votes, and the part of a template's grams a span must hold.
DRIFT, GAP, COVER = 2, 6, 0.6


def templates() -> list[tuple[int, str, str, bool]]:
    """(number, label, words, whether its places are counted)."""
    rows = [(label, text, True) for text, label in PHRASES.items()] + [(label, text, False) for label, text in TEMPLATES]
    return [(k, label, text, base) for k, (label, text, base) in enumerate(rows)]


def _grams(spark) -> DataFrame:
    rows = [(k, label, base, j, w[j], w[j + 1], w[j + 2], len(w)) for k, label, text, base in templates() for w in [text.split()] for j in range(len(w) - GRAM + 1)]
    return spark.createDataFrame(rows, "template int, label string, base boolean, j int, a string, b string, c string, template_words int")


def words_of(text):
    """The words of a column of texts. The Kelvin sign is the one letter above ASCII that lower() would make an ASCII word of."""
    lowered = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit("ĸ")))
    return F.array_remove(F.split(lowered, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


#: The hash under which a document's mark meets that of the templates, and the mark's place.
MARK = 0


def votes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, template, label, base, template_words, diagonal, lo, hi, n, doc_id, n_words): the votes of each document's diagonals, from a join of all its grams; template -1 is the mark that each document has."""
    grams = _grams(docs.sparkSession).select("template", "label", "base", "j", "template_words", F.xxhash64("a", "b", "c").alias("h"), F.col("a").alias("ta"), F.col("b").alias("tb"), F.col("c").alias("tc"))
    marks = docs.sparkSession.range(1).select(F.lit(-1).alias("template"), F.lit("").alias("label"), F.lit(False).alias("base"), F.lit(0).alias("j"), F.lit(0).alias("template_words"), F.lit(MARK).cast("long").alias("h"), *(F.lit("").alias(c) for c in ("ta", "tb", "tc")))
    places = F.broadcast(grams.unionByName(marks))  # constants
    words = _text.select(docs, id_col, text_col).select(F.monotonically_increasing_id().alias("row"), "doc_id", words_of(F.col("text")).alias("words"))
    at = words.select("row", "doc_id", "words", F.explode(F.sequence(F.lit(-1), F.greatest(F.size("words") - GRAM, F.lit(-1)))).alias("i"))
    word = lambda k: F.get("words", F.col("i") + k)
    every = at.select("row", "doc_id", "i", F.size("words").alias("n_words"), *(word(k).alias(c) for k, c in enumerate("abc")))
    hashed = every.withColumn("h", F.when(F.col("i") < 0, F.lit(MARK).cast("long")).otherwise(F.xxhash64("a", "b", "c")))
    same = F.when(F.col("i") < 0, F.col("template") < 0).otherwise((F.col("a") == F.col("ta")) & (F.col("b") == F.col("tb")) & (F.col("c") == F.col("tc")))
    joined = hashed.join(places, "h").where(same).withColumn("diagonal", F.col("i") - F.col("j"))
    return joined.groupBy("row", "template", "label", "base", "template_words", "diagonal").agg(
        F.min("i").alias("lo"), F.max("i").alias("hi"), F.count("*").alias("n"), F.max("doc_id").alias("doc_id"), F.max("n_words").cast("long").alias("n_words")
    )


def spans(lines: DataFrame) -> DataFrame:
    """(row, label, base, first, last, cover) of merged diagonals that hold enough of their template."""
    whole = F.col("template_words") - GRAM + 1
    keys = ["row", "template", "label", "base", "template_words"]
    exact = lines.where(F.col("base")).where(F.col("n") == whole).select("row", "label", "base", F.col("diagonal").alias("first"), (F.col("diagonal") + F.col("template_words") - 1).alias("last"), F.lit(1.0).alias("cover"))
    order = Window.partitionBy(*keys).orderBy("lo", "diagonal")
    apart = F.coalesce((F.abs(F.col("diagonal") - F.lag("diagonal").over(order)) > DRIFT) | (F.col("lo") - F.lag("hi").over(order) > GAP) | (F.col("lo") <= F.lag("hi").over(order)), F.lit(True))
    runs = lines.where(~F.col("base") & (F.col("template") >= 0)).withColumn("new", apart.cast("int")).withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = runs.groupBy(*keys, "run").agg(F.min("lo").alias("first"), (F.max("hi") + GRAM - 1).alias("last"), F.sum("n").alias("n"))
    cover = F.least(F.col("n") / whole, F.lit(1.0))
    own = merged.withColumn("cover", cover).where((F.col("cover") >= COVER) & (F.col("last") - F.col("first") + 1 <= 1.5 * F.col("template_words"))).select("row", "label", "base", "first", "last", "cover")
    return exact.unionByName(own)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans) of every document; score: the best span's cover.

    The votes are written once: documents are told apart by a number that is given to them in that pass.
    """
    lines = Scratch(docs.sparkSession, "licenses").save(votes(docs, id_col, text_col), "votes")
    marks = lines.where("template < 0").select("row", "doc_id", "n_words")
    found = spans(lines).groupBy("row").agg(
        F.sum(F.col("base").cast("long")).alias("n_base"),
        F.min(F.when(F.col("base"), F.col("first"))).cast("long").alias("first_word"),
        F.max(F.when(F.col("base"), F.col("first"))).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("base"), F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
        F.max("cover").alias("score"),
        F.array_sort(F.collect_list(F.struct("first", "last", "label", "cover"))).alias("spans"),
    )
    none = F.array().cast("array<struct<first:int,last:int,label:string,cover:double>>")
    return marks.join(found, "row", "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"), "first_word", "last_word", F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("spans", none).alias("spans")
    )
