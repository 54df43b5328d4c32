"""License scan by a positional rare-token index, in DataFrame functions only.

Templates (notices and whole short licences) are a table of postings: word, template, position and IDF, the
document frequencies counted over all files.  Files that hold one of the templates' rarest words are looked up:
each place of such a word, joined to the postings by word, aligns a template with the file at the
difference of their positions.  The template's other postings are intersected there, and a licence is named where enough of
their weight agrees and one of its mandatory key phrases stands word for word.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skarn.llm.common import LOWER, UPPER, if_small, written

#: Wording of well-known licence notices, lower-case words only.
NOTICES = {
    "agpl-3": ["gnu affero general public license version 3"],
    "apache-2": ["licensed under the apache license version 2 0"],
    "bsd": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "cc-by-nc": ["licensed under cc by nc 4 0"],
    "cc-by-sa": ["licensed under cc by sa 4 0"],
    "gpl-3": ["licensed under the gnu general public license version 3"],
    "isc": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"],
    "mit": ["released under the mit license", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"],
    "mpl-2": ["this source code form is subject to the terms of the mozilla public license v 2 0"],
    "reserved": ["all rights reserved"],
    "unlicense": ["this is free and unencumbered software released into the public domain"],
}
#: Phrases one of which must stand word for word in a notice that is named.
KEY_PHRASES = {
    "agpl-3": ["gnu affero general public license"],
    "apache-2": ["apache license version 2"],
    "bsd": ["redistribution and use in source and binary forms"],
    "cc-by-nc": ["cc by nc"],
    "cc-by-sa": ["cc by sa"],
    "gpl-3": ["gnu general public license version 3"],
    "isc": ["permission to use copy modify and or distribute this software"],
    "mit": ["mit license", "permission is hereby granted free of charge"],
    "mpl-2": ["mozilla public license v 2"],
    "reserved": ["all rights reserved"],
    "unlicense": ["free and unencumbered software"],
}
#: The versions of the GPL family; its standard header is that of any of them, by name and version.
FAMILY = {
    "agpl-3": ("gnu affero general public license", "3"),
    "gpl-1": ("gnu general public license", "1"),
    "gpl-2": ("gnu general public license", "2"),
    "gpl-3": ("gnu general public license", "3"),
    "lgpl-2": ("gnu library general public license", "2"),
    "lgpl-2.1": ("gnu lesser general public license", "2 1"),
    "lgpl-3": ("gnu lesser general public license", "3"),
}
for _label, (_name, _version) in FAMILY.items():
    _header = f"{_name} as published by the free software foundation either version {_version} {'of the license' if _version != '1' else 'or at your option'}"
    NOTICES[_label] = [*NOTICES.get(_label, []), _header]
    KEY_PHRASES[_label] = [*KEY_PHRASES.get(_label, []), _header]
#: The header of version 2 alone, and those of the Eclipse licences.
for _label, _header in [
    ("gpl-2", "gnu general public license version 2 as published by the free software foundation"),
    ("gpl-2", "gnu general public license as published by the free software foundation version 2 of the license"),
    ("epl-1", "made available under the terms of the eclipse public license v1 0"),
    ("epl-2", "made available under the terms of the eclipse public license 2 0"),
    ("epl-2", "made available under the terms of the eclipse public license v 2 0"),
    ("epl-2", "made available under the terms of the eclipse public license v2 0"),
]:
    NOTICES[_label] = [*NOTICES.get(_label, []), _header]
    KEY_PHRASES[_label] = [*KEY_PHRASES.get(_label, []), _header.removeprefix("made available under the terms of the ")]
#: Whole texts of short licences and headers, lower-case words only.
_WARRANTY = "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"
_BSD = "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met 1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer 2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
_BSD_WARRANTY = "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages"
for _label, _text, _key in [
    ("mit", f"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software {_WARRANTY}", "permission is hereby granted free of charge"),
    ("bsd", f"{_BSD} {_BSD_WARRANTY}", "redistribution and use in source and binary forms"),
    ("bsd", f"{_BSD} 3 neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission {_BSD_WARRANTY}", "redistribution and use in source and binary forms"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness", "permission to use copy modify and or distribute this software"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license", "apache license version 2"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0", "mozilla public license v 2"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions", "permission is granted to anyone to use this software for any purpose"),
    ("boost-1", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software", "to any person or organization obtaining a copy of the software"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means", "free and unencumbered software"),
]:
    NOTICES[_label] = [*NOTICES.get(_label, []), _text]
    KEY_PHRASES[_label] = sorted({*KEY_PHRASES.get(_label, []), _key})
#: The base phrases and their labels.
BASE_PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


def words_of(text: Column) -> Column:
    """Lower-cased (A-Z) words of a text: runs of digits, letters and all that isn't ASCII; null counts as empty."""
    folded = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.array_remove(F.split(folded, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def _array(words) -> Column:
    return F.array(*[F.lit(w) for w in words])


def document_frequencies(docs: DataFrame, text_col: str, vocabulary: list[str]) -> tuple[dict[str, int], int]:
    """In how many files each word of the (fixed, small) vocabulary occurs, and the number of files."""
    found = F.array_intersect(words_of(F.col(text_col)), _array(vocabulary))
    rows = docs.select(F.explode(F.array_append(found, F.lit(""))).alias("word")).groupBy("word").count().collect()
    df = {r["word"]: r["count"] for r in rows}
    return df, df.get("", 0)


def _table(rows: list[dict], schema: str) -> Column:
    """Rows as one constant array column."""
    return F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")


def scan_licenses(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    base: dict[str, str] | None = None,
    notices: dict[str, list[str]] | None = None,
    keys: dict[str, list[str]] | None = None,
    agree: float = 0.8,
    lookups: int = 3,
) -> DataFrame:
    """One row per file: doc_id, n_words, n_base (places of base phrases), first_word, last_word
    (their smallest and largest start, words from 0; null without any), base_labels, labels
    (with the notices'; both distinct, sorted, comma-joined; empty string for none), score (largest share,
    by IDF weight, of a notice's or base phrase's words that stand in their places; 0 to 1).

    A file's words are looked up if they are among the ``lookups`` of highest IDF of some notice, or the one of a base phrase, which must stand whole.
    Null or empty text: no words, no labels, score 0.  Repeated rows come out as
    often as they went in; ids may be null.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    base, notices, keys = base or BASE_PHRASES, notices or NOTICES, keys or KEY_PHRASES
    phrases = [(label, t.split(), True) for t, label in base.items()]
    templates = phrases + [(label, t.split(), False) for label, ts in sorted(notices.items()) for t in ts]
    df, n = document_frequencies(docs, text_col, sorted({w for _, ws, _ in templates for w in ws}))
    idf = lambda w: math.log((n + 1) / (df.get(w, 0) + 1)) + 1

    def places(ws, phrase):
        return [j for j in range(len(ws) - len(phrase) + 1) if ws[j : j + len(phrase)] == phrase]

    postings, table = [], []
    for t, (label, ws, whole) in enumerate(templates):
        for i in sorted(range(len(ws)), key=lambda i: (-idf(ws[i]), i))[: 1 if whole else lookups]:
            postings.append({"word": ws[i], "template": t, "position": i})
        total = sum(map(idf, ws))
        stands = [{"at": j, "words": k.split()} for k in ([] if whole else keys.get(label, [])) for j in places(ws, k.split())[:1]]
        table.append({"label": label, "whole": whole, "words": ws, "weights": [idf(w) / total for w in ws], "keys": stands, "free": whole or label not in keys})
    index = spark.range(1).select(F.explode(_table(postings, "word:string,template:int,position:int")).alias("p")).select("p.*")
    known = _table(table, "label:string,whole:boolean,words:array<string>,weights:array<double>,keys:array<struct<at:int,words:array<string>>>,free:boolean")
    rare = sorted({p["word"] for p in postings})

    # the files that hold a rare word, with its places; most files have none and go no further
    text = F.col(text_col)
    files = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("copy"), words_of(text).alias("words"))
    hits = F.filter(F.transform("words", lambda w, i: F.when(w.isin(rare), F.struct(i.alias("at"), w.alias("word")))), lambda x: x.isNotNull())
    found = written(files.where(F.arrays_overlap("words", _array(rare))).dropDuplicates(["doc_id", "copy"]).withColumn("hits", hits), "found")
    # where a template would start: its position from the word's, by a join on the word
    starts = found.select("doc_id", "copy", F.explode("hits").alias("h")).join(F.broadcast(index), F.col("h.word") == F.col("word"))
    starts = starts.groupBy("doc_id", "copy").agg(F.collect_set(F.struct("template", (F.col("h.at") - F.col("position")).alias("start"))).alias("starts"))
    starts = starts.withColumnsRenamed({"doc_id": "of", "copy": "of_copy"})
    aligned = found.select("doc_id", "copy", "words").join(starts, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("copy") == F.col("of_copy")))

    def stands(at: Column, phrase: Column) -> Column:
        return F.forall(F.sequence(F.lit(0), F.size(phrase) - 1), lambda i: F.coalesce(F.get("words", at + i) == F.get(phrase, i), F.lit(False)))

    def compared(s: Column) -> Column:
        t = F.get(known, s["template"])
        same = F.transform(t["weights"], lambda w, j: F.when(F.get("words", s["start"] + j) == F.get(t["words"], j), w).otherwise(0.0))
        share = F.aggregate(same, F.lit(0.0), lambda a, w: a + w)
        held = t["free"] | F.exists(t["keys"], lambda k: stands(s["start"] + k["at"], k["words"]))
        whole = t["whole"] & stands(s["start"], t["words"])
        return F.struct(t["label"].alias("label"), t["whole"].alias("base"), s["start"].alias("start"), share.alias("share"), (whole | ~t["whole"] & (share >= agree) & held).alias("named"))

    named = aligned.select("of", "of_copy", F.transform("starts", compared).alias("all"))
    named = named.withColumn("base", F.filter("all", lambda x: x["base"] & x["named"]))
    joined = lambda xs: F.array_join(F.array_sort(F.array_distinct(F.transform(xs, lambda x: x["label"]))), ",")
    best = F.array_max(F.transform("all", lambda x: F.when(~x["base"] | x["named"], x["share"]).otherwise(0.0)))
    named = named.select(
        "of",
        "of_copy",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(F.transform("base", lambda x: x["start"])).cast("long").alias("first_word"),
        F.array_max(F.transform("base", lambda x: x["start"])).cast("long").alias("last_word"),
        joined(F.col("base")).alias("base_labels"),
        joined(F.filter("all", lambda x: x["named"])).alias("labels"),
        F.least(F.lit(1.0), F.round(best, 9)).alias("score"),
    )
    named = written(named, "named")
    every = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("copy"), F.size(words_of(text)).cast("long").alias("n_words"))
    out = every.join(if_small(named, 400), F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("copy") == F.col("of_copy")), "left")
    return out.select("doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word", *[F.coalesce(c, F.lit("")).alias(c) for c in ("base_labels", "labels")], F.coalesce("score", F.lit(0.0)).alias("score"))
