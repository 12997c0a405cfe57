"""License scans by diagonal voting, with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Phrases whose places are counted one by one, with their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Texts that the method recognises when most of their words stand in order: well-known public wording, sentences and
#: whole standard texts. Fixed values.
NOTICES = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files": "mit",
    "licensed under the apache license version 2 0 you may not use this file except in compliance with the license": "apache",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license": "gpl",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd",
    "this source code form is subject to the terms of the mozilla public license": "mpl",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "isc",
    "this work is licensed under a creative commons attribution": "cc",
    "licensed under cc by 4 0": "cc-by",
    "licensed under cc by sa 4 0": "cc-by-sa",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "licensed under cc by nc sa 4 0": "cc-by-nc-sa",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"
    " including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished"
    " to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"
    " the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and"
    " noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from"
    " out of or in connection with the software or the use or other dealings in the software": "mit",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the"
    " above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the"
    " following disclaimer in the documentation and or other materials provided with the distribution this software is provided by the copyright holders and contributors as is and any express"
    " or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed": "bsd",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-3",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear"
    " in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event"
    " shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract"
    " negligence or other tortious action arising out of or in connection with the use or performance of this software": "isc",
    "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses"
    " license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind"
    " either express or implied see the license for the specific language governing permissions and limitations under the license": "apache",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the"
    " license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or"
    " fitness for a particular purpose see the gnu general public license for more details": "gpl",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version"
    " 2 1 of the license or at your option any later version": "lgpl",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation": "agpl",
    "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0": "mpl",
    "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a"
    " compiled binary for any purpose commercial or non commercial and by any means": "unlicense",
    "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted"
    " to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely": "zlib",
    "boost software license version 1 0 permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license": "bsl",
}

#: A notice's pair of two of these words has no vote: such pairs stand everywhere and would only be shuffled.
COMMON = tuple("a and any by for in is it of on or that the this to with".split())
#: Words that may have been added or dropped in all, within one copy of a notice.
DRIFT = 12
#: Votes below which a notice must have them all: one pair less would be another notice.
SHORT = 10

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What separates words: every ASCII character that is neither a digit nor a letter, A-Z being lowered before.
_GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words of a whole text, A-Z in lower case; null counts as empty."""
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), _GAPS), lambda w: w != "")


def _grams(words: Column) -> Column:
    """Hashes of all rolling pairs of words, in order of place."""
    last = F.size(words) - 2
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1))))


def templates(spark: SparkSession, base: dict[str, str] | None = None, notices: dict[str, str] | None = None) -> DataFrame:
    """One row for each place of a template that votes: gram hash, template, label, whether it is a base phrase, place, places in all."""
    base, notices = BASE if base is None else base, NOTICES if notices is None else notices
    if short := [t for t in (*base, *notices) if len(t.split()) < 2]:
        raise ValueError(f"a template needs two words: {short}")
    rows = [(t, label, True) for t, label in base.items()] + [(t, label, False) for t, label in notices.items()]
    named = spark.createDataFrame(rows, "template string, label string, base boolean").withColumn("words", words_of(F.col("template")))
    common = lambda i: F.get("words", i).isin(*COMMON) & F.get("words", i + 1).isin(*COMMON)
    voting = named.withColumn("places", F.filter(F.sequence(F.lit(0), F.size("words") - 2), lambda i: F.col("base") | ~common(i)))
    each = voting.withColumn("total", F.size("places")).withColumn("place", F.explode("places"))
    return each.select(F.xxhash64(F.get("words", F.col("place")), F.get("words", F.col("place") + 1)).alias("gram"), F.xxhash64("template").alias("template"), "label", "base", "total", "place")


def scan(docs: DataFrame, base: dict[str, str] | None = None, notices: dict[str, str] | None = None, drift: int = DRIFT,
         least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """License texts in whole documents.

    All rolling word-pair hashes of a document are joined to the template places that hold the same pair. A match
    votes for its diagonal, the place in the document less that in the template: pairs of one copy share a diagonal. A
    base phrase, of two words or more, stands where a diagonal has every vote. A longer notice may have words added or
    dropped: from every diagonal on, it is merged with its neighbours up to ``drift`` further, and the span that these
    cover, the template's length and ``drift`` at most, is verified: the distinct template pairs seen in it, over all that
    vote, must be at least ``least``, and all of them for a notice of fewer than ``SHORT``. As each diagonal is such a beginning,
    what else stands near a copy, its own words again included, cannot hide it. Notices compete for the pairs of the
    document: a pair goes to the notice with the larger share seen, then with more pairs seen, and one that wins no pair anywhere
    is a part of another notice and gives no label. Equal notices both stay.

    One row for each row given: id column, n_words, n_base, first_word, last_word (smallest and largest start of a base
    phrase, words from 0; else null), base_labels, labels (distinct, sorted, comma-joined; empty if none) and score (1
    where a base phrase stands, else the best share of a verified notice, else 0). Null and empty texts have no words.
    Repeated rows are kept apart, other columns are ignored, an empty table gives an empty one. The templates are a
    fixed list and so a bounded broadcast; only matches are shuffled. What meets in one task is the diagonals that one
    document has for one template, sorted and not gathered; a frame of them holds ``drift`` + 1.
    """
    words = F.col("w")
    rows = docs.select(F.col(id_col).alias("id"), words_of(F.col(text_col)).alias("w")).withColumn("row", F.monotonically_increasing_id())
    grams = rows.select("row", "id", F.size(words).cast("long").alias("n_words"), F.posexplode_outer(_grams(words)).alias("at", "gram"))
    known = F.broadcast(templates(docs.sparkSession, base, notices).withColumnRenamed("gram", "known"))
    hits = grams.join(known, F.col("gram") == F.col("known"), "left")
    # every document keeps a row: its first place, or the null that stands for none
    hits = hits.where(F.col("template").isNotNull() | F.coalesce(F.col("at"), F.lit(0)).eqNullSafe(0))
    hits = hits.withColumn("diagonal", F.col("at") - F.col("place"))
    votes = hits.groupBy("row", "id", "n_words", "template", "label", "base", "total", "diagonal").agg(F.collect_list("place").alias("places"))
    phrase = F.col("base") & (F.size("places") == F.col("total"))
    standing = votes.select("row", "id", "n_words", F.when(phrase, F.col("diagonal")).alias("start"), F.when(phrase, F.col("label")).alias("base_label"), F.lit(None).cast("string").alias("label"), F.when(phrase, 1.0).alias("share"))

    near = Window.partitionBy("row", "template").orderBy("diagonal").rangeBetween(0, drift)
    met = F.transform("places", lambda p: F.struct(p.alias("place"), (F.col("diagonal") + p).alias("at")))
    framed = votes.where("not base").withColumn("met", F.flatten(F.collect_list(met).over(near))).withColumn("seen", F.size(F.array_distinct("met.place")))
    share = F.col("seen") / F.col("total")
    verified = framed.withColumn("share", share).where(F.col("share") >= F.when(F.col("total") < SHORT, 1.0).otherwise(least))
    claims = verified.select("row", "id", "n_words", "label", F.struct("share", "seen").alias("claim"), F.explode(F.array_distinct("met.at")).alias("at"))
    claims = claims.groupBy("row", "id", "n_words", "at", "label").agg(F.max("claim").alias("claim"))
    best = claims.groupBy("row", "id", "n_words", "at").agg(F.collect_list(F.struct("claim", "label")).alias("held"))  # one entry a label at most
    won = best.select("row", "id", "n_words", F.explode(F.filter("held", lambda x: x["claim"] == F.array_max("held.claim"))).alias("w"))
    won = won.select("row", "id", "n_words", F.lit(None).cast("long").alias("start"), F.lit(None).cast("string").alias("base_label"), "w.label", "w.claim.share")

    join = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    out = standing.unionByName(won).groupBy("row", "id", "n_words").agg(
        F.count("start").alias("n_base"), F.min("start").cast("long").alias("first_word"), F.max("start").cast("long").alias("last_word"),
        join("base_label").alias("base_labels"), join(F.coalesce("base_label", "label")).alias("labels"), F.coalesce(F.max("share"), F.lit(0.0)).alias("score"))
    return out.select(F.col("id").alias(id_col), "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
