"""License scans: ordered signature rules, with DataFrame functions only.

Texts that contain a keyword become words, each between single spaces (so that neighbours share none); hundreds of
regexes over them, each behind keywords of its own, give intervals of words: signatures of the licenses' own sentences
and addresses, and names in the forms in which texts refer to them. An interval inside another of no lower priority is
suppressed. Base phrases are counted in each text besides.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Base phrases and their labels.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
#: Licenses; a label, a word to look for before its names that hold it, and its names as regexes over words.
LICENSES = (
    ("mit", "mit", ("mit", "mit x11", "expat mit")),
    ("apache-1.1", "apache", ("apache software 1 1", "apache 1 1")),
    ("apache-2", "apache", ("apache", "apache 2(?: 0)?", "apache version 2(?: 0)?", "asf apache")),
    ("gpl-2", "2", ("gpl 2(?: 0)?", "gplv2", "gnu gpl 2(?: 0)?", "gnu general public 2(?: 0)?", "gpl v2")),
    ("gpl-3", "3", ("gpl 3(?: 0)?", "gplv3", "gnu gpl 3(?: 0)?", "gpl v3", "gnu gpl v3")),
    ("gpl", "gnu", ("gnu", "gnu gpl", "gnu general public")),
    ("lgpl", "lesser", ("lesser general public", "gnu lesser general public", "gnu lesser")),
    ("lgpl", "lgpl", ("lgpl", "gnu lgpl", "lgpl 2 1", "lgpl 3(?: 0)?")),
    ("agpl-3", "affero", ("affero general public", "gnu affero general public", "gnu affero")),
    ("agpl-3", "agpl", ("agpl", "gnu agpl", "agpl 3(?: 0)?", "agplv3")),
    ("bsd-2", "bsd", ("bsd 2 clause", "simplified bsd", "2 clause bsd", "freebsd bsd")),
    ("bsd-3", "bsd", ("bsd 3 clause", "new bsd", "3 clause bsd", "modified bsd", "revised bsd")),
    ("bsd-4", "bsd", ("bsd 4 clause", "original bsd", "4 clause bsd")),
    ("bsd", "bsd", ("bsd", "berkeley bsd")),
    ("isc", "isc", ("isc", "internet systems consortium isc")),
    ("mpl-1.1", "mozilla", ("mozilla public 1 1",)),
    ("mpl-2", "mozilla", ("mozilla public", "mozilla public 2(?: 0)?")),
    ("mpl-2", "mpl", ("mpl", "mpl 2(?: 0)?", "mplv2")),
    ("epl", "eclipse", ("eclipse public", "eclipse public 1 0", "eclipse public 2(?: 0)?", "eclipse distribution")),
    ("cddl", "cddl", ("cddl", "cddl 1 0", "cddl 1 1")),
    ("cddl", "distribution", ("common development and distribution",)),
    ("artistic-2", "artistic", ("artistic", "artistic 2(?: 0)?", "perl artistic")),
    ("zlib", "zlib", ("zlib", "zlib libpng")),
    ("boost", "boost", ("boost software", "boost")),
    ("unlicense", "unlicense", ("unlicense", "the unlicense")),
    ("wtfpl", "wtfpl", ("wtfpl",)),
    ("psf", "python", ("python software foundation", "python")),
    ("ofl", "ofl", ("ofl", "sil ofl", "ofl 1 1")),
    ("ofl", "font", ("sil open font", "open font")),
    ("odbl", "odbl", ("odbl", "odbl 1 0")),
    ("odbl", "database", ("open database", "open data commons open database")),
    ("eupl", "eupl", ("eupl", "eupl 1 2")),
    ("eupl", "european", ("european union public",)),
    ("ms-pl", "microsoft", ("microsoft public", "microsoft reciprocal")),
    ("postgresql", "postgresql", ("postgresql",)),
    ("openssl", "openssl", ("openssl",)),
    ("cc-by-nc-nd", "nc", ("cc by nc nd(?: [1-4] [0-9])?",)),
    ("cc-by-nc-sa", "nc", ("cc by nc sa(?: [1-4] [0-9])?",)),
    ("cc-by-nc", "nc", ("cc by nc(?: [1-4] [0-9])?",)),
    ("cc-by-nc", "noncommercial", ("creative commons attribution noncommercial",)),
    ("cc-by-sa", "sa", ("cc by sa(?: [1-4] [0-9])?",)),
    ("cc-by-sa", "sharealike", ("creative commons attribution sharealike",)),
    ("cc-by-nd", "nd", ("cc by nd(?: [1-4] [0-9])?",)),
    ("cc-by", "by", ("cc by(?: [1-4] [0-9])?",)),
    ("cc-by", "attribution", ("creative commons attribution",)),
    ("cc0", "cc0", ("cc0", "cc0 1 0", "creative commons zero cc0")),
)
#: Forms around a name; priority, confidence and the word that the form needs.
FORMS = (
    (5, 0.99, "spdx", "spdx license identifier {}"),
    (4, 0.95, "under", "(?:licensed|released|distributed|available|provided|published|offered) under (?:the )?(?:terms of (?:the )?)?{}(?: licen[cs]e)?(?: version [0-9](?: [0-9])?)?"),
    (3, 0.9, "license", "{} license(?: version [0-9](?: [0-9])?)?"),
    (3, 0.9, "licence", "{} licence(?: version [0-9](?: [0-9])?)?"),
    (2, 0.7, "licensed", "{} licensed"),
    (2, 0.7, "license", "license {}"),
)
#: Sentences of the licenses' own texts, and addresses; a label, priority, confidence, a word that each match holds, and a regex over words.
SIGNATURES = (
    ("mit", 7, 1.0, "hereby", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit", 6, 0.95, "substantial", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", 6, 0.9, "sublicense", "(?:use copy modify merge publish )?distribute sublicense and or sell copies of the software"),
    ("mit", 6, 0.95, "mit", "https? opensource org licenses mit"),
    ("isc", 7, 1.0, "fee", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", 6, 0.9, "redistribution", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", 5, 0.8, "redistributions", "redistributions of source code must retain the above copyright notice"),
    ("bsd", 5, 0.8, "redistributions", "redistributions in binary form must reproduce the above copyright notice"),
    ("bsd-3", 7, 0.97, "endorse", "neither the name of .{1,80}? nor the names of its contributors may be used to endorse or promote products"),
    ("bsd-4", 7, 0.97, "advertising", "all advertising materials mentioning features or use of this software must display"),
    ("bsd", 6, 0.9, "bsd", "use of this source code is governed by a bsd style license"),
    ("bsd-2", 6, 0.95, "bsd", "https? opensource org licenses bsd 2 clause"),
    ("bsd-3", 6, 0.95, "bsd", "https? opensource org licenses bsd 3 clause"),
    ("apache-2", 7, 1.0, "apache", "licensed under the apache license version 2 0(?: the license)?"),
    ("apache-2", 6, 0.95, "apache", "https? www apache org licenses license 2 0(?: txt| html)?"),
    ("apache-2", 6, 0.9, "compliance", "you may not use this file except in compliance with the license"),
    ("apache-2", 6, 0.95, "asf", "licensed to the apache software foundation asf under one or more contributor license agreements"),
    ("apache-1.1", 6, 0.9, "apache", "this product includes software developed by the apache software foundation"),
    ("gpl-2", 8, 1.0, "2", "gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("gpl-3", 8, 1.0, "3", "gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("lgpl", 8, 1.0, "lesser", "gnu lesser general public license as published by the free software foundation(?: either)?(?: version (?:2|2 1|3))?"),
    ("lgpl", 8, 1.0, "library", "gnu library general public license(?: as published by the free software foundation)?"),
    ("agpl-3", 8, 1.0, "affero", "gnu affero general public license as published by the free software foundation(?: either version 3)?"),
    ("gpl", 6, 0.9, "gnu", "you should have received a copy of the gnu general public license"),
    ("lgpl", 7, 0.9, "lesser", "you should have received a copy of the gnu lesser general public license"),
    ("agpl-3", 7, 0.9, "affero", "you should have received a copy of the gnu affero general public license"),
    ("gpl", 5, 0.85, "gnu", "https? www gnu org licenses(?: gpl)?(?: html)?"),
    ("gpl-2", 6, 0.95, "gnu", "https? www gnu org licenses(?: old licenses)? gpl 2 0(?: en)?(?: html)?"),
    ("gpl-3", 6, 0.95, "gnu", "https? www gnu org licenses gpl 3 0(?: en)?(?: html)?"),
    ("gpl", 5, 0.85, "warranty", "this program comes with absolutely no warranty"),
    ("gpl-2", 6, 0.9, "2", "gnu general public license version 2(?: only)?"),
    ("gpl-3", 6, 0.9, "3", "gnu general public license version 3(?: only)?"),
    ("gpl-2", 6, 0.9, "june", "gnu general public license version 2 june 1991"),
    ("gpl-3", 6, 0.9, "june", "gnu general public license version 3 29 june 2007"),
    ("agpl-3", 7, 0.9, "november", "gnu affero general public license version 3 19 november 2007"),
    ("mpl-2", 7, 1.0, "mozilla", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-2", 6, 0.95, "mozilla", "https? (?:www )?mozilla org mpl 2 0"),
    ("mpl-1.1", 7, 1.0, "mozilla", "the contents of this file are subject to the mozilla public license version 1 1"),
    ("mpl-2", 6, 0.9, "incompatible", "incompatible with secondary licenses as defined by the mozilla public license"),
    ("epl", 7, 1.0, "eclipse", "made available under the terms of the eclipse public license(?: v(?:ersion)?)?(?: [12] 0)?"),
    ("epl", 6, 0.95, "eclipse", "https? www eclipse org legal epl(?: v(?:10|20)| 2 0)?(?: html)?"),
    ("epl", 6, 0.95, "eclipse", "https? www eclipse org org documents edl v10(?: php| html)?"),
    ("cddl", 7, 1.0, "development", "subject to the terms of the common development and distribution license"),
    ("cddl", 6, 0.95, "cddl", "https? opensource org licenses cddl 1 0"),
    ("artistic-2", 6, 0.95, "artistic", "(?:redistribute it and or modify it )?under the terms of the artistic license 2 0"),
    ("artistic-2", 5, 0.85, "perl", "under the same terms as perl(?: itself)?"),
    ("artistic-2", 6, 0.95, "artistic", "https? (?:www )?opensource org licenses artistic license 2 0"),
    ("zlib", 7, 1.0, "freely", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely"),
    ("zlib", 6, 0.9, "misrepresented", "the origin of this software must not be misrepresented"),
    ("zlib", 6, 0.9, "altered", "altered source versions must be plainly marked as such"),
    ("boost", 7, 1.0, "boost", "distributed under the boost software license version 1 0"),
    ("boost", 6, 0.95, "boost", "https? www boost org license 1 0 txt"),
    ("unlicense", 7, 1.0, "unencumbered", "this is free and unencumbered software released into the public domain"),
    ("unlicense", 6, 0.95, "unlicense", "https? unlicense org"),
    ("wtfpl", 7, 1.0, "fuck", "do what the fuck you want to public license"),
    ("wtfpl", 6, 0.95, "wtfpl", "https? www wtfpl net"),
    ("psf", 7, 1.0, "python", "psf license agreement for python"),
    ("psf", 6, 0.9, "python", "python software foundation license version 2"),
    ("ofl", 7, 1.0, "sil", "this font software is licensed under the sil open font license version 1 1"),
    ("ofl", 6, 0.95, "ofl", "https? scripts sil org ofl"),
    ("ofl", 6, 0.9, "reserved", "with reserved font name"),
    ("odbl", 7, 1.0, "database", "made available under the open database license"),
    ("odbl", 6, 0.95, "odbl", "https? opendatacommons org licenses odbl(?: 1 0)?"),
    ("eupl", 7, 1.0, "eupl", "licensed under the eupl(?: version)?(?: 1 [12])?(?: or later)?"),
    ("ms-pl", 6, 0.95, "microsoft", "this license governs use of the accompanying software .{0,60}? microsoft"),
    ("ms-pl", 6, 0.95, "ms", "https? opensource org licenses ms pl"),
    ("postgresql", 7, 0.95, "agreement", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted"),
    ("openssl", 7, 0.95, "openssl", "this product includes software developed by the openssl project"),
    ("cc0", 7, 1.0, "cc0", "to the extent possible under law .{0,120}? cc0"),
    ("cc0", 6, 0.95, "zero", "https? creativecommons org publicdomain zero 1 0"),
    ("cc-pdm", 6, 0.95, "mark", "https? creativecommons org publicdomain mark 1 0"),
    ("cc-by", 6, 0.95, "creativecommons", "https? creativecommons org licenses by [1-4] [0-9]"),
    ("cc-by-sa", 6, 0.95, "sa", "https? creativecommons org licenses by sa [1-4] [0-9]"),
    ("cc-by-nd", 6, 0.95, "nd", "https? creativecommons org licenses by nd [1-4] [0-9]"),
    ("cc-by-nc", 6, 0.95, "nc", "https? creativecommons org licenses by nc [1-4] [0-9]"),
    ("cc-by-nc-sa", 6, 0.95, "nc", "https? creativecommons org licenses by nc sa [1-4] [0-9]"),
    ("cc-by-nc-nd", 6, 0.95, "nc", "https? creativecommons org licenses by nc nd [1-4] [0-9]"),
    ("cc-by-sa", 7, 1.0, "sharealike", "creative commons attribution sharealike [1-4] [0-9](?: international| unported)?(?: license)?"),
    ("cc-by-nc", 7, 1.0, "noncommercial", "creative commons attribution noncommercial [1-4] [0-9](?: international| unported)?(?: license)?"),
    ("cc-by-nc-sa", 8, 1.0, "noncommercial", "creative commons attribution noncommercial sharealike [1-4] [0-9](?: international| unported)?(?: license)?"),
    ("cc-by-nc-nd", 8, 1.0, "noncommercial", "creative commons attribution noncommercial noderivatives [1-4] [0-9](?: international| unported)?(?: license)?"),
    ("cc-by-nd", 7, 1.0, "noderivatives", "creative commons attribution noderivatives [1-4] [0-9](?: international| unported)?(?: license)?"),
    ("cc-by", 6, 1.0, "attribution", "creative commons attribution [1-4] [0-9](?: international| unported)?(?: license)?"),
    ("public-domain", 5, 0.8, "domain", "(?:is|are|was|placed) (?:hereby )?(?:released |placed )?in(?:to)? the public domain"),
    ("proprietary", 4, 0.7, "reserved", "all rights reserved"),
    ("proprietary", 5, 0.8, "confidential", "proprietary and confidential"),
    ("proprietary", 5, 0.8, "unauthorized", "unauthorized copying of this file via any medium is strictly prohibited"),
)


#: Any text with a detection contains one of these, whatever the case.
GATE = ("licens", "licenc", "spdx", "cc", "under", "permission", "redistribut", "reserved", "software", "copies", "domain", "propriet", "unauthori", "warranty", "altered", "perl", "endorse", "eclipse", "attribution", "creativecommons", "wtfpl", "opensource", "mozilla", "ofl")


def rules() -> list[tuple[str, int, float, str, str, str]]:
    """(label, priority, confidence, form's word, name's word, regex) in order of priority; a regex spans whole words of words_text()."""
    made = [(label, priority, confidence, word, word, _spaced(pattern)) for label, priority, confidence, word, pattern in SIGNATURES]
    for label, usual, names in LICENSES:
        for name in names:
            key = _key(name, usual)
            for priority, confidence, word, form in FORMS:
                made.append((label, priority, confidence, word, key, _spaced(form.format(name))))
            if name.startswith("cc"):
                made.append((label, 1, 0.6, "cc0" if key == "cc0" else "cc", key, _spaced(name)))
    return sorted(made, key=lambda r: (-r[1], r[0], r[5]))


def _key(name: str, usual: str) -> str:
    """A word that every match of the name holds: the usual one if it is such, else the longest."""
    needed = re.sub(r"\(\?:[^)]*\)\?", "", name).split()
    return usual if usual in needed else max(needed, key=len)


def _spaced(pattern: str) -> str:
    """A regex over words with single spaces between them as one over words_text()."""
    return f" {pattern.replace(" ", "  ")} "


def literal(pattern: str, key: str) -> str:
    """The longest text around the key, if there is one, that every match of a regex of rules() holds: no group, class, wild card or optional letter is in it."""
    out, depth, i = [], 0, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "[":
            i = pattern.index("]", i)
        elif c == ".":
            i = pattern.index("?", i)
        elif c == "?":
            out = out if depth or pattern[i - 1] in ")]" else out[:-1]
        depth += (c == "(") - (c == ")")
        plain = not depth and c not in "[].()?"
        out.append(c if plain else "\n")
        i += 1
    parts = "".join(out).split("\n")
    return max(parts, key=lambda p: (key in p.split(), len(p))).lstrip()


#: The ASCII characters that change: capitals to small letters, and to spaces what is in no word.
_FROM = "".join(chr(c) for c in range(128) if not (48 <= c < 58 or 97 <= c < 123))
_TO = "".join(c.lower() if "A" <= c <= "Z" else " " for c in _FROM)


def words_text(text: Column) -> Column:
    """' w1  w2  w3 ': each word of a text, A-Z lower-cased, between two spaces of its own; '' without words."""
    bare = F.trim(F.translate(text, _FROM, _TO))
    # runs of spaces to two each, without a regex: controls are gone, so they can stand for the ends of spaces
    ends = F.replace(F.replace(bare, F.lit(" "), F.lit("\x01\x02")), F.lit("\x02\x01"), F.lit(""))
    return F.when(bare == "", "").otherwise(F.concat(F.lit(" "), F.replace(ends, F.lit("\x01\x02"), F.lit("  ")), F.lit(" ")))


def _count_words(spaced: Column) -> Column:
    return ((F.octet_length(spaced) - F.octet_length(F.replace(spaced, F.lit(" "), F.lit("")))) / 2).cast("long")


def _gated(text: Column) -> Column:
    low = F.lower(text)
    gate = F.lit(False)
    for word in GATE:
        gate = gate | F.contains(low, F.lit(word))
    return gate


def detections(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keep..., text_key, label, priority, confidence, first, last) of every detection that no other suppresses; words count from 0.

    One is suppressed that lies within another of the same text of no lower priority: a longer one, or an equal one of
    a higher priority, or, those equal too, of a label that comes first. text_key is xxhash64 of the text. A regex
    runs over a text once, and once more where it is found; places are running sums of words, so many detections take time in proportion.
    """
    spark = docs.sparkSession
    table = F.broadcast(_rule_table(spark))  # hundreds of rows, whatever the data
    asked = docs.where(_gated(F.col("text"))).select(*keep, F.xxhash64("text").alias("text_key"), words_text(F.col("text")).alias("spaced"))
    keys = sorted({r[4] for r in rules()})
    # a search stops at each byte that could begin a match, so what begins with a space is looked for last
    stands = lambda word: F.contains(F.col("spaced"), F.concat(word, F.lit(" "))) & F.contains(F.col("spaced"), F.concat(F.lit(" "), word, F.lit(" ")))
    held = asked.select(*keep, "text_key", "spaced", F.explode(F.filter(F.array(*map(F.lit, keys)), stands)).alias("key"))
    met = held.join(table, "key").where(F.contains(F.col("spaced"), F.col("literal")) & stands(F.col("word"))).where(F.expr("spaced rlike pattern"))
    # words hold no control characters: they part what a regex finds (odd places) from what it doesn't (even ones)
    parts = F.split(F.regexp_replace("spaced", F.concat(F.lit("("), F.col("pattern"), F.lit(")")), F.lit("\x01$1\x01")), "\x01")
    counts = met.select(*keep, "text_key", "label", "priority", "confidence", "pattern", F.transform(parts, lambda p: _count_words(p)).alias("counts"))
    each = counts.select(*keep, "text_key", "label", "priority", "confidence", "pattern", F.posexplode("counts").alias("i", "words"))
    along = Window.partitionBy(*keep, "text_key", "pattern", "label").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    # rows that repeat an id and a text have the same detections
    placed = each.distinct().withColumn("first", F.coalesce(F.sum("words").over(along), F.lit(0).cast("long"))).where("i % 2 = 1")
    placed = placed.select(*keep, "text_key", "label", "priority", "confidence", "first", (F.col("first") + F.col("words") - 1).alias("last")).distinct()
    sooner = Window.partitionBy(*keep, "text_key").orderBy("first", F.desc("last"), F.desc("priority"), "label").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.lit(None).cast("long")
    for level in sorted({r[1] for r in rules()}, reverse=True):
        reach = F.when(F.col("priority") == level, F.max(F.when(F.col("priority") >= level, F.col("last"))).over(sooner)).otherwise(reach)
    return placed.withColumn("reach", reach).where("reach is null or reach < last").drop("reach")


def _rule_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(*r, literal(r[5], r[4])) for r in rules()], "label string, priority int, confidence double, word string, key string, pattern string, literal string")


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every row of docs.

    Null and empty texts have no words, no labels ('') and score 0. score is 1 with a base phrase, else the greatest
    confidence of the detections. Each row has the labels of its own text, whatever other rows have its id. Other
    columns are ignored.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    added = detections(slim.where("text <> ''")).groupBy("doc_id", "text_key").agg(F.collect_set("label").alias("more"), F.max("confidence").alias("sure"))
    # words are counted by what stands around them: regexp_count would make an object of each
    spaced = words_text(F.col("text"))
    base = slim.select("doc_id", F.xxhash64("text").alias("own_key"), _count_words(spaced).alias("n_words"), F.when(_gated(F.col("text")), spaced).otherwise("").alias("spaced"))
    counts, starts, ends, labels = F.lit(0).cast("long"), [F.lit(None).cast("long")], [F.lit(None).cast("long")], []
    for phrase, label in sorted(BASE, key=lambda b: b[1]):
        own = _spaced(phrase)
        at, back = F.locate(own, "spaced"), F.locate(own[::-1], F.reverse("spaced"))
        counts = counts + ((F.length("spaced") - F.length(F.replace("spaced", F.lit(own), F.lit("")))) / len(own)).cast("long")
        starts.append(F.when(at > 0, _count_words(F.substring("spaced", F.lit(1), at - 1))))
        ends.append(F.when(at > 0, F.col("n_words") - _count_words(F.substring(F.reverse("spaced"), F.lit(1), back - 1)) - len(phrase.split())))
        labels.append(F.when(at > 0, F.lit(label)))
    base = base.select("doc_id", "own_key", "n_words", counts.alias("n_base"), F.least(*starts).alias("first_word"), F.greatest(*ends).alias("last_word"), F.array_compact(F.array(*labels)).alias("own"))
    both = base.join(added.withColumnRenamed("doc_id", "its_id"), F.col("doc_id").eqNullSafe(F.col("its_id")) & (F.col("own_key") == F.col("text_key")), "left")
    every = F.array_sort(F.array_distinct(F.concat("own", F.coalesce("more", F.array().cast("array<string>")))))
    score = F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("sure", F.lit(0.0)))
    return both.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join(F.array_sort("own"), ",").alias("base_labels"), F.array_join(every, ",").alias("labels"), score.alias("score"))
