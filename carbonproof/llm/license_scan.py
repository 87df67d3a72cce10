"""License scan by ordered signature rules.

Hundreds of patterns are written out as sentences of licence texts, or from small tables of licence families, versions and wordings. Each
has a keyword, one word of its own: a pattern is tried only on texts that contain it and all other keywords among
the pattern's words, and a text without any keyword costs one pass of an alternation by letters. Rules are ordered by priority. A detection that lies inside a
detection of a higher priority, or inside a longer one of the same priority, is suppressed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from carbonproof.llm.common import computed, whole_text

#: A word character once A-Z are lower-cased: ASCII letters and digits, and all that is not ASCII.
WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]"
GAP = r"[^0-9A-Za-z\x{80}-\x{10FFFF}]+"
START, END = f"(?<!{WORD})", f"(?!{WORD})"

# The phrases and labels of the base scan.
BASE_PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Licence families as (label, names, versions).
FAMILIES = (
    ("gpl", ("gnu general public", "general public", "gnu gpl", "gpl"), ("1", "1.0", "2", "2.0", "3", "3.0")),
    ("lgpl", ("gnu lesser general public", "lesser general public", "gnu lgpl", "lgpl"), ("2", "2.0", "2.1", "3", "3.0")),
    ("agpl", ("gnu affero general public", "affero general public", "gnu agpl", "agpl"), ("1", "1.0", "3", "3.0")),
    ("gfdl", ("gnu free documentation", "free documentation", "gfdl"), ("1.1", "1.2", "1.3")),
    ("apache", ("apache", "apache software"), ("1.0", "1.1", "2", "2.0")),
    ("mpl", ("mozilla public", "mpl"), ("1.0", "1.1", "2", "2.0")),
    ("epl", ("eclipse public", "epl"), ("1.0", "2.0")),
    ("cddl", ("common development and distribution", "cddl"), ("1.0", "1.1")),
    ("eupl", ("european union public", "eupl"), ("1.0", "1.1", "1.2")),
    ("osl", ("open software", "osl"), ("1.0", "1.1", "2.0", "2.1", "3.0")),
    ("artistic", ("artistic", "perl artistic"), ("1.0", "2.0")),
    ("bsl", ("boost software", "bsl"), ("1.0",)),
    ("cpl", ("common public", "ibm public"), ("1.0",)),
    ("upl", ("universal permissive", "upl"), ("1.0",)),
    ("bsd", ("bsd", "berkeley software distribution"), ("2-clause", "3-clause", "4-clause", "0-clause")),
    ("mit", ("mit", "expat", "x11"), ()),
    ("isc", ("isc", "internet systems consortium"), ()),
    ("zlib", ("zlib", "libpng"), ()),
    ("wtfpl", ("do what the fuck you want to public", "wtfpl"), ("1", "2")),
    ("unlicense", ("the unlicense", "unlicense"), ()),
)
# The wordings around a family's name.
WORDINGS = (
    ("licensed under the {name}", 30, 0.9),
    ("released under the {name}", 30, 0.9),
    ("distributed under the {name}", 30, 0.9),
    ("under the terms of the {name}", 30, 0.9),
    ("licensed under {name}", 30, 0.9),
    ("released under {name}", 30, 0.9),
    ("license {name}", 25, 0.85),
    ("{name} license", 20, 0.8),
    ("{name} licence", 20, 0.8),
)
# The second words of gates.
CONTEXTS = ("licensed", "released", "distributed", "terms", "license", "licence")
# Creative Commons conditions and versions.
CC_CONDITIONS = ("by", "by sa", "by nc", "by nd", "by nc sa", "by nc nd")
CC_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")
# Sentences of licence texts, of their notices and exceptions, by label. Long ones identify a text by themselves.
TEXTS = {
    "mit": (
        "permission is hereby granted free of charge to any person obtaining a copy",
        "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies",
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    ),
    "x11": ("shall not be used in advertising or otherwise to promote the sale use or other dealings in this software",),
    "json": ("the software shall be used for good not evil",),
    "isc": (
        "permission to use copy modify and or distribute this software for any purpose",
        "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted",
    ),
    "0bsd": ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided",),
    "hpnd": ("permission to use copy modify distribute and sell this software and its documentation for any purpose is hereby granted without fee",),
    "bsd": (
        "redistribution and use in source and binary forms with or without modification",
        "redistributions of source code must retain the above copyright notice",
        "redistributions in binary form must reproduce the above copyright notice",
        "this software is provided by the copyright holders and contributors as is",
        "this software is provided by the regents and contributors as is",
        "in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages",
    ),
    "bsd-3-clause": (
        "neither the name of the copyright holder nor the names of its contributors",
        "neither the name of the university nor the names of its contributors may be used to endorse or promote products",
    ),
    "bsd-4-clause": ("all advertising materials mentioning features or use of this software must display the following acknowledgement",),
    "ncsa": ("university of illinois ncsa open source license",),
    "apache-1": ("the names apache server and apache group must not be used to endorse or promote products",),
    "apache-1.1": ("this product includes software developed by the apache software foundation",),
    "apache-2": (
        "licensed under the apache license version 2.0 the license you may not use this file except in compliance with the license",
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis",
        "you must cause any modified files to carry prominent notices stating that you changed the files",
        "each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license",
    ),
    "mpl-1.1": ("the contents of this file are subject to the mozilla public license",),
    "mpl-2": (
        "this source code form is subject to the terms of the mozilla public license",
        "if a copy of the mpl was not distributed with this file you can obtain one at",
    ),
    "mpl-2-no-copyleft-exception": ("incompatible with secondary licenses as defined by the mozilla public license",),
    "epl": (
        "this program and the accompanying materials are made available under the terms of the eclipse public license",
        "the accompanying program is provided under the terms of this eclipse public license",
    ),
    "cpl": ("the accompanying program is provided under the terms of this common public license",),
    "cddl": ("the contents of this file are subject to the terms of the common development and distribution license",),
    "eupl": ("this european union public licence the eupl applies to the work or software",),
    "osl": ("this open software license the license applies to any original work of authorship",),
    "afl": ("this academic free license the license applies to any original work of authorship",),
    "upl": ("subject to the condition set forth below permission is hereby granted to any person obtaining a copy of this software associated documentation and or data",),
    "artistic-1": ("the intent of this document is to state the conditions under which a package may be copied",),
    "artistic-2": ("this license establishes the terms under which a given free software package may be copied modified distributed and or redistributed",),
    "ruby": ("you may make and give away verbatim copies of the source form of the software without restriction",),
    "zlib": (
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable",
        "the origin of this software must not be misrepresented you must not claim that you wrote the original software",
        "altered source versions must be plainly marked as such and must not be misrepresented as being the original software",
    ),
    "bsl-1": ("permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license",),
    "unlicense": (
        "this is free and unencumbered software released into the public domain",
        "anyone is free to copy modify publish use compile sell or distribute this software",
        "in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest",
    ),
    "wtfpl": ("everyone is permitted to copy and distribute verbatim or modified copies of this license document", "you just do what the fuck you want to"),
    "beerware": ("as long as you retain this notice you can do whatever you want with this stuff",),
    "gpl": (
        "you should have received a copy of the gnu general public license",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license",
        "this program is distributed in the hope that it will be useful but without any warranty",
        "without even the implied warranty of merchantability or fitness for a particular purpose",
        "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed",
        "the licenses for most software are designed to take away your freedom to share and change it",
    ),
    "gpl-2-or-later": ("either version 2 of the license or at your option any later version",),
    "gpl-3-or-later": ("either version 3 of the license or at your option any later version",),
    "gpl-3": ("the licenses for most software and other practical works are designed to take away your freedom to share and change the works",),
    "lgpl": (
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license",
        "you should have received a copy of the gnu lesser general public license",
    ),
    "lgpl-2": ("this library is free software you can redistribute it and or modify it under the terms of the gnu library general public license",),
    "lgpl-2.1-or-later": ("either version 2.1 of the license or at your option any later version",),
    "agpl-3": (
        "under the terms of the gnu affero general public license as published by",
        "your modified version must prominently offer all users interacting with it remotely through a computer network",
    ),
    "gfdl": (
        "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license",
        "with no invariant sections no front cover texts and no back cover texts",
    ),
    "classpath-exception": (
        "linking this library statically or dynamically with other modules is making a combined work based on this library",
        "give you permission to link this library with independent modules to produce an executable",
    ),
    "gcc-exception": (
        "as a special exception you may use this file as part of a free software library without restriction",
        "you are granted additional permissions described in the gcc runtime library exception",
    ),
    "autoconf-exception": ("if you distribute this file as part of a program that contains a configuration script generated by autoconf",),
    "bison-exception": ("as a special exception you may create a larger work that contains part or all of the bison parser skeleton",),
    "openssl-exception": ("permission to link the code of portions of this program with the openssl library",),
    "openssl": ("this product includes software developed by the openssl project for use in the openssl toolkit",),
    "psf": ("this license agreement is between the python software foundation", "psf hereby grants licensee a nonexclusive royalty free world wide license"),
    "php": ("this product includes php software freely available from",),
    "sleepycat": ("redistributions in any form must be accompanied by information on how to obtain complete source code",),
    "ofl": ("this font software is licensed under the sil open font license", "the fonts and derivatives however cannot be released under any other type of license"),
    "lppl": ("this work may be distributed and or modified under the conditions of the latex project public license",),
    "cecill": ("this software is governed by the cecill license under french law",),
    "cc": (
        "the work as defined below is provided under the terms of this creative commons public license",
        "by exercising the licensed rights defined below you accept and agree to be bound by the terms and conditions of this creative commons",
        "the license may not give you all of the permissions necessary for your intended use",
    ),
    "cc0": (
        "has waived all copyright and related or neighboring rights",
        "affirmer hereby overtly fully permanently irrevocably and unconditionally waives abandons and surrenders",
    ),
    "odbl": ("this database is made available under the open database license",),
    "pddl": ("the person associating a work with this document has dedicated the work to the commons",),
    "busl": ("the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work",),
    "sspl": ("if you make the functionality of the program or a modified version available to third parties as a service",),
    "commons-clause": ("the license does not grant to you the right to sell the software",),
    "proprietary": ("this software is proprietary and confidential", "unauthorized copying of this file via any medium is strictly prohibited"),
    "all-rights-reserved": ("no part of this publication may be reproduced",),
}
# Names and notices as (words, label, priority, confidence).
SIGNATURES = (
    ("the software is provided as is without warranty of any kind", "warranty-disclaimer", 40, 0.6),
    ("creative commons attribution sharealike", "cc-by-sa", 40, 0.9),
    ("creative commons attribution noncommercial", "cc-by-nc", 40, 0.9),
    ("creative commons attribution noderivatives", "cc-by-nd", 40, 0.9),
    ("creative commons attribution", "cc-by", 30, 0.9),
    ("creative commons zero", "cc0", 30, 0.9),
    ("cc0 1.0 universal", "cc0", 30, 0.9),
    ("public domain dedication", "public-domain", 20, 0.7),
    ("dedicated to the public domain", "public-domain", 20, 0.7),
    ("all rights reserved", "all-rights-reserved", 10, 0.5),
    ("spdx license identifier", "spdx", 10, 0.5),
    ("microsoft public license", "ms-pl", 30, 0.9),
    ("microsoft reciprocal license", "ms-rl", 30, 0.9),
    ("zope public license", "zpl", 30, 0.9),
    ("q public license", "qpl", 30, 0.9),
    ("academic free license", "afl", 30, 0.9),
    ("server side public license", "sspl", 30, 0.9),
    ("business source license", "busl", 30, 0.9),
    ("elastic license", "elastic", 30, 0.9),
    ("open database license", "odbl", 30, 0.9),
    ("open data commons attribution license", "odc-by", 30, 0.9),
    ("sil open font license", "ofl", 30, 0.9),
    ("python software foundation license", "psf", 30, 0.9),
    ("latex project public license", "lppl", 30, 0.9),
)
#: Priority and confidence of a sentence of a licence text.
TEXT_RANK = (50, 1.0)


@dataclass(frozen=True)
class Rule:
    """A signature: its pattern is tried on texts that contain, in any case of A-Z, ``keyword``, ``context`` and those of ``words``,
    which every match has, that are keywords of any rule."""

    label: str
    keyword: str
    pattern: str
    priority: int
    confidence: float
    context: str = ""
    words: tuple[str, ...] = ()


def _context(words: str) -> str:
    return next((c for c in CONTEXTS if c in words.split()), "")


def _pattern(words: str) -> str:
    pieces = [w.replace(".", r"\.").replace("-", f"(?:{GAP})?") for w in words.split()]
    return f"(?i){START}{GAP.join(pieces)}{END}"


def rules() -> list[Rule]:
    """All rules, the most important first."""
    out = [Rule(label, phrase.split()[0], _pattern(phrase), 15, 0.8, _context(phrase), tuple(phrase.split())) for phrase, label in BASE_PHRASES.items()]
    out += [Rule(label, max(words.split(), key=len), _pattern(words), priority, sure, words=tuple(words.split())) for words, label, priority, sure in SIGNATURES]
    out += [Rule(label, max(words.split(), key=len), _pattern(words), *TEXT_RANK, words=tuple(words.split())) for label, texts in TEXTS.items() for words in texts]
    for label, names, versions in FAMILIES:
        for name in names:
            keyword = max(name.split(), key=len)
            for wording, priority, sure in WORDINGS:
                words = wording.format(name=name)
                out.append(Rule(label, keyword, _pattern(words), priority, sure, _context(wording), tuple(words.split())))
            for version in versions:
                short = version.removesuffix(".0") if version.endswith(".0") else version
                body = f"{name} license version {version}|{name} license v{version}|{name} version {version}|{name} v{version}|{name} {version}"
                if " " not in name:  # GPLv3, LGPLv2.1
                    body += f"|{name}v{version}|{name}{version}"
                out.append(Rule(f"{label}-{short}", keyword, "(?i)" + "|".join(_pattern(x)[4:] for x in body.split("|")), 35, 0.95, words=tuple(name.split())))
    for condition in CC_CONDITIONS:
        label = "cc-" + condition.replace(" ", "-")
        out.append(Rule(label, "cc", _pattern(f"cc {condition}"), 20 + len(condition), 0.85))
        out += [Rule(f"{label}-{v}", "cc", _pattern(f"cc {condition} {v}"), 36 + len(condition), 0.95) for v in CC_VERSIONS]
    return sorted(set(out), key=lambda r: (-r.priority, r.label, r.pattern))


#: Any base phrase.
ANY_PHRASE = "(?i)(?:" + "|".join(_pattern(p)[4:] for p in BASE_PHRASES) + ")"


def _count_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD + "+")).cast("bigint")


def base_places(text: Column) -> Column:
    """The base phrases of a whole text in order, as they stand there.

    Only texts that contain a part of every phrase, found without a pattern, are searched by one.
    """
    likely = F.exists(F.array(F.lower(text)), lambda low: F.contains(low, F.lit("license")) | F.contains(low, F.lit("cc")))
    return F.when(likely, F.regexp_extract_all(text, F.lit(ANY_PHRASE), F.lit(0))).otherwise(F.expr("cast(array() as array<string>)"))


def base_columns(text: Column, places: Column) -> dict[str, Column]:
    """n_words, n_base, first_word, last_word and base_labels of a whole text with these ``base_places``."""
    first_of = F.create_map(*[F.lit(x) for p, label in BASE_PHRASES.items() for x in (p.split()[0], label)])
    labels = F.transform(places, lambda m: first_of[F.lower(F.regexp_extract(m, "^[A-Za-z]+", 0))])
    found = F.size(places) > 0
    head = F.element_at(F.split(text, ANY_PHRASE, 2), 1)  # no offsets: these count UTF-16 units, substring code points
    rest = F.regexp_extract(text, f"(?s)^(.*){ANY_PHRASE}", 1)
    return {
        "n_words": _count_words(text),
        "n_base": F.size(places).cast("bigint"),
        "first_word": F.when(found, _count_words(head)),
        "last_word": F.when(found, _count_words(rest)),
        "base_labels": F.array_join(F.array_sort(F.array_distinct(labels)), ","),
    }


def _by_letters(words: list[str]) -> str:
    """A pattern of exactly these words that shares their beginnings, so that a position is given up after a letter or two."""
    longer: dict[str, list[str]] = {}
    for word in words:
        if word:
            longer.setdefault(word[0], []).append(word[1:])
    body = "|".join(letter + _by_letters(ends) for letter, ends in sorted(longer.items()))
    if not body:
        return ""
    return f"(?:{body})?" if "" in words else f"(?:{body})"


def detections(docs: DataFrame) -> DataFrame:
    """Kept detections of each text that has any: ``(doc_key, label, priority, confidence, start, stop)`` in ``found``.

    Rules meet texts by an equi-join on the keyword, so a text sees only the rules whose keyword it
    contains; the rule table has a fixed size and is broadcast.
    """
    spark = docs.sparkSession
    keywords = sorted({r.keyword for r in rules()})
    table = spark.createDataFrame(
        [(r.keyword, r.pattern, r.label, r.priority, r.confidence, r.context, sorted({*r.words} & {*keywords})) for r in rules()],
        "keyword string, pattern string, label string, priority int, confidence double, context string, needs array<string>",
    )
    letters = "".join(sorted({k[0] for k in keywords}))
    gate = f"(?=[{letters}]){START}({_by_letters(keywords)})(?:v?[0-9][0-9.]*)?{END}"
    present = F.array_distinct(F.regexp_extract_all(F.lower("content"), F.lit(gate), F.lit(1)))
    held = computed(docs, present=present).where(F.size("present") > 0)
    contexts = F.filter(F.array(*[F.lit(c) for c in ("", *CONTEXTS)]), lambda c: F.contains(F.lower("content"), c))
    held = computed(held, contexts=contexts).select("doc_key", "content", "present", "contexts").dropDuplicates(["doc_key"])
    tried = held.select("*", F.explode_outer("present").alias("keyword")).join(F.broadcast(table), "keyword")
    tried = tried.where(F.array_contains("contexts", F.col("context")) & (F.size(F.array_except("needs", "present")) == 0))
    found = F.regexp_extract_all("content", F.col("pattern"), F.lit(0))
    tried = tried.withColumn("found", found).where(F.size("found") > 0)
    around = F.transform(F.split("content", F.col("pattern")), lambda x: F.length(x))
    parts = F.arrays_zip(F.slice(around, F.lit(1), F.size("found")).alias("gap"), F.transform("found", lambda x: F.length(x)).alias("width"))
    columns = ["priority", "label", "confidence"]
    parts = tried.select("doc_key", "pattern", *columns, F.posexplode(parts).alias("at", "part")).repartition("doc_key")
    stop = F.sum(F.col("part.gap") + F.col("part.width")).over(Window.partitionBy("doc_key", "pattern", *columns).orderBy("at")).cast("int")
    spans = parts.withColumn("stop", stop).withColumn("start", F.col("stop") - F.col("part.width"))
    spans = _outermost(spans.select("doc_key", "start", "stop", *columns).distinct())
    span = F.struct("start", "stop", *columns)
    return spans.groupBy("doc_key").agg(F.array_sort(F.collect_list(span)).alias("found"))


def _outermost(spans: DataFrame) -> DataFrame:
    """Spans that lie in none of a higher priority and in no longer one of their own.

    Spans of a text are gone through once by their start: the furthest stop so far of each
    priority tells whether an earlier span holds the present one.
    """
    levels = sorted({r.priority for r in rules()})
    so_far = Window.partitionBy("doc_key").orderBy("start").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    alike = Window.partitionBy("doc_key", "priority").orderBy("start")
    reached = spans.select(
        "*", *[F.max(F.when(F.col("priority") == p, F.col("stop"))).over(so_far).alias(f"reach_{p}") for p in levels],
        F.max("stop").over(alike.rangeBetween(Window.unboundedPreceding, Window.currentRow)).alias("same_start"),
        F.max("stop").over(alike.rangeBetween(Window.unboundedPreceding, -1)).alias("before"),
    )
    higher = F.greatest(F.lit(-1), *[F.when(F.col("priority") < p, F.col(f"reach_{p}")) for p in levels])
    inside = (higher >= F.col("stop")) | (F.col("same_start") > F.col("stop")) | F.coalesce(F.col("before") >= F.col("stop"), F.lit(False))
    return reached.where(~inside).select(*spans.columns)


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Licences named in every whole text.

    Returns ``(id_col, n_words, n_base, first_word, last_word, base_labels, labels, score, detections)``;
    ``labels`` joins the base labels and those of the rules that were not suppressed, ``score`` is the
    highest confidence among them, 0 without any; ``detections`` are character spans with label,
    priority and confidence. Null texts count as empty, repeated rows give a row each, rows with a null id only have the base columns,
    an empty table gives an empty table, other columns are ignored.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).alias("doc_key"), whole_text(text_col).alias("content"))
    keyed = texts.where("doc_key is not null").withColumn("doc_key", F.struct("doc_key", F.xxhash64("content").alias("content_hash")))
    marked = detections(keyed).select("doc_key.doc_key", "doc_key.content_hash", "found")
    placed = computed(texts, places=base_places(F.col("content")))
    columns = base_columns(F.col("content"), F.col("places"))
    base = placed.select("doc_key", F.xxhash64("content").alias("content_hash"), *[c.alias(n) for n, c in columns.items()])
    joined = base.join(marked, ["doc_key", "content_hash"], "left")
    spans = F.coalesce("found", F.expr("cast(array() as array<struct<start:int,stop:int,priority:int,label:string,confidence:double>>)"))
    base_list = F.filter(F.split("base_labels", ","), lambda x: x != "")
    all_labels = F.array_sort(F.array_union(base_list, F.transform(spans, lambda s: s["label"])))
    score = F.coalesce(F.array_max(F.transform(spans, lambda s: s["confidence"])), F.when(F.col("n_base") > 0, F.lit(0.8)), F.lit(0.0))
    return joined.select(
        F.col("doc_key").alias(id_col), "n_words", "n_base", "first_word", "last_word", "base_labels",
        F.array_join(all_labels, ",").alias("labels"), score.alias("score"), spans.alias("detections"),
    )
