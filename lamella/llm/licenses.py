"""License scan: ordered signature rules on word sequences (DataFrame operations only)."""

from __future__ import annotations

import re
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lamella.llm.common import table

#: The base phrases and their labels.
BASE = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

#: Families: label, keyword that a text must contain, name as a regex over words with one space between.
FAMILIES = (
    ("agpl", "affero", r"gnu affero general public license(?: v(?:ersion)? ?[13](?: 0)?| version 3)?"),
    ("agpl", "agpl", r"agpl(?:v3| v?3(?: 0)?)?(?: only| or later)?"),
    ("lgpl", "lesser", r"gnu lesser general public license(?: v(?:ersion)? ?[23](?: [01])?| version [23](?: 1)?)?"),
    ("lgpl", "library general", r"gnu library general public license(?: v(?:ersion)? ?[23](?: [01])?| version [23](?: 1)?)?"),
    ("lgpl", "lgpl", r"lgpl(?:v[23]| v?[23](?: [01])?)?(?: only| or later)?"),
    ("gpl-3.0", "general public", r"(?:gnu )?general public license v(?:ersion)? ?3(?: 0)?"),
    ("gpl-2.0", "general public", r"(?:gnu )?general public license v(?:ersion)? ?2(?: 0)?"),
    ("gpl", "general public", r"(?:gnu )?general public licen[cs]e"),
    ("gpl-3.0", "gpl", r"(?:gnu )?gpl ?v?3(?: 0)?(?: only| or later)?"),
    ("gpl-2.0", "gpl", r"(?:gnu )?gpl ?v?2(?: 0)?(?: only| or later)?"),
    ("apache-2.0", "apache", r"apache (?:software )?licen[cs]e(?: version)? (?:v ?)?2(?: 0)?"),
    ("apache-1.1", "apache", r"apache (?:software )?licen[cs]e(?: version)? 1 1"),
    ("apache", "apache", r"apache (?:software )?licen[cs]e"),
    ("cc-by-nc-nd", "cc by", r"cc by nc nd(?: [1-4] [05])?"),
    ("cc-by-nc-sa", "cc by", r"cc by nc sa(?: [1-4] [05])?"),
    ("cc-by-nc", "cc by", r"cc by nc(?: [1-4] [05])?"),
    ("cc-by-nd", "cc by", r"cc by nd(?: [1-4] [05])?"),
    ("cc-by-sa", "cc by", r"cc by sa(?: [1-4] [05])?"),
    ("cc-by", "cc by", r"cc by(?: [1-4] [05])?"),
    ("cc-by-nc-nd", "creative", r"creative commons attribution non ?commercial no ?deriv(?:ative)?s(?: [1-4] [05])?"),
    ("cc-by-nc-sa", "creative", r"creative commons attribution non ?commercial share ?alike(?: [1-4] [05])?"),
    ("cc-by-nc", "creative", r"creative commons attribution non ?commercial(?: [1-4] [05])?"),
    ("cc-by-nd", "creative", r"creative commons attribution no ?deriv(?:ative)?s(?: [1-4] [05])?"),
    ("cc-by-sa", "creative", r"creative commons attribution share ?alike(?: [1-4] [05])?"),
    ("cc-by", "creative", r"creative commons attribution(?: [1-4] [05])?"),
    ("cc0-1.0", "cc0", r"cc0(?: 1 0)?(?: universal)?"),
    ("mit", "mit", r"mit licen[cs]e"),
    ("mit", "expat", r"expat licen[cs]e"),
    ("mit-0", "mit", r"mit no attribution(?: license)?"),
    ("bsd-4-clause", "bsd", r"(?:bsd 4 clause|4 clause bsd|original bsd)(?: license)?"),
    ("bsd-3-clause", "bsd", r"(?:bsd 3 clause|3 clause bsd|new bsd|modified bsd)(?: license)?"),
    ("bsd-2-clause", "bsd", r"(?:bsd 2 clause|2 clause bsd|simplified bsd|freebsd)(?: license)?"),
    ("bsd", "bsd", r"bsd (?:style )?licen[cs]e"),
    ("mpl-2.0", "mozilla", r"mozilla public license(?: version| v)? 2(?: 0)?"),
    ("mpl-1.1", "mozilla", r"mozilla public license(?: version| v)? 1 1"),
    ("mpl", "mozilla", r"mozilla public licen[cs]e"),
    ("epl-2.0", "eclipse", r"eclipse public license(?: version| v)? 2(?: 0)?"),
    ("epl", "eclipse", r"eclipse public licen[cs]e"),
    ("cddl", "common development", r"common development and distribution license(?: 1 [01])?"),
    ("isc", "isc licen", r"isc licen[cs]e"),
    ("zlib", "zlib", r"zlib(?: libpng)? licen[cs]e"),
    ("bsl-1.0", "boost", r"boost software license(?: version)?(?: 1 0)?"),
    ("artistic", "artistic", r"artistic license(?: 2 0)?"),
    ("eupl", "european union", r"european union public licen[cs]e(?: 1 [12])?"),
    ("unlicense", "unlicense", r"unlicense"),
    ("wtfpl", "wtfpl", r"wtfpl"),
    ("gfdl", "free documentation", r"gnu free documentation licen[cs]e(?: version)?(?: 1 [123])?"),
    ("ofl-1.1", "open font", r"sil open font licen[cs]e(?: version)?(?: 1 1)?"),
    ("odbl", "open database", r"open (?:data commons open )?database licen[cs]e"),
    ("python", "python software", r"python software foundation licen[cs]e(?: version 2)?"),
    ("openrail", "openrail", r"(?:creativeml )?openrail(?: m)?(?: license)?"),
    ("public-domain", "public domain", r"public domain"),
)

#: Written rules for notices, headers, tags, URLs and clauses that don't name their license as a family does: label, keyword, regex over words, weight.
NOTICES = (
    ("mit", "hereby granted", r"permission is hereby granted free of charge to any person obtaining a copy of this software", 1.0),
    ("mit", "noninfringement", r"warranties of merchantability fitness for a particular purpose and noninfringement", 0.6),
    ("mit", "above copyright", r"the above copyright notice and this permission notice shall be included in all copies", 0.9),
    ("mit", "opensource", r"(?:www )?opensource org licenses mit(?: license)?(?: php)?", 1.0),
    ("mit", "license mit", r"license mit", 0.6),
    ("x11", "consortium", r"permission to use copy modify and distribute this software .{0,40}x consortium", 0.8),
    ("isc", "permission to use", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", 1.0),
    ("isc", "opensource", r"(?:www )?opensource org licenses isc(?: license)?(?: txt)?", 1.0),
    ("0bsd", "permission to use", r"permission to use copy modify and or distribute this software for any purpose with or without fee", 0.7),
    ("0bsd", "0bsd", r"0bsd", 0.8),
    ("bsd-3-clause", "neither the name", r"neither the name of .{1,80} nor the names of its contributors may be used to endorse or promote", 1.0),
    ("bsd-4-clause", "advertising materials", r"all advertising materials mentioning features or use of this software must display", 1.0),
    ("bsd", "redistribution", r"redistribution and use in source and binary forms with or without modification are permitted", 0.9),
    ("bsd", "redistributions", r"redistributions of source code must retain the above copyright notice", 0.8),
    ("bsd", "redistributions", r"redistributions in binary form must reproduce the above copyright notice", 0.8),
    ("bsd-3-clause", "opensource", r"(?:www )?opensource org licenses bsd 3 clause", 1.0),
    ("bsd-2-clause", "opensource", r"(?:www )?opensource org licenses bsd 2 clause", 1.0),
    ("bsd-3-clause", "bsd 3", r"bsd 3 clause(?: clear)?(?: attribution)?", 0.6),
    ("apache-2.0", "apache org", r"(?:www )?apache org licenses license 2 0(?: txt| html)?", 1.0),
    ("apache-2.0", "apache license", r"licensed under the apache license version 2 0 the license you may not use this file except in compliance", 1.0),
    ("apache-2.0", "apache software", r"licensed to the apache software foundation asf under one or more contributor license agreements", 1.0),
    ("apache-2.0", "apache 2", r"apache 2(?: 0)?(?: license)?", 0.6),
    ("apache-1.1", "apache org", r"this product includes software developed by the apache software foundation (?:http )?(?:www )?apache org", 0.8),
    ("gpl", "gnu org", r"(?:www )?gnu org licenses gpl(?: \d \d)?(?: html| txt)?", 0.9),
    ("gpl", "gnu org", r"(?:www )?gnu org (?:copyleft|philosophy) (?:gpl|free sw)(?: html)?", 0.8),
    ("lgpl", "gnu org", r"(?:www )?gnu org licenses lgpl(?: \d \d)?(?: html| txt)?", 1.0),
    ("agpl", "gnu org", r"(?:www )?gnu org licenses agpl(?: \d \d)?(?: html| txt)?", 1.0),
    ("gfdl", "gnu org", r"(?:www )?gnu org licenses fdl(?: \d \d)?(?: html| txt)?", 1.0),
    ("gpl", "free software", r"this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", 1.0),
    ("gpl", "gnu general", r"you should have received a copy of the gnu general public license", 0.9),
    ("lgpl", "gnu lesser", r"you should have received a copy of the gnu lesser general public license", 1.0),
    ("agpl", "gnu affero", r"you should have received a copy of the gnu affero general public license", 1.0),
    ("lgpl", "free software", r"this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license", 1.0),
    ("gpl-2.0", "either version 2", r"either version 2 of the license or (?:at your option )?any later version", 0.8),
    ("gpl-3.0", "either version 3", r"either version 3 of the license or (?:at your option )?any later version", 0.8),
    ("gpl-2.0", "gpl 2", r"gpl 2 0 (?:only|or later)", 0.9),
    ("gpl-3.0", "gpl 3", r"gpl 3 0 (?:only|or later)", 0.9),
    ("gpl", "classpath", r"classpath exception(?: 2 0)?", 0.8),
    ("gpl", "runtime library", r"gcc runtime library exception", 0.8),
    ("gpl", "copyleft", r"copyleft licen[cs]e", 0.5),
    ("mpl-2.0", "mozilla org", r"(?:www )?mozilla org mpl 2 0", 1.0),
    ("mpl-2.0", "source code form", r"this source code form is subject to the terms of the mozilla public license v 2 0", 1.0),
    ("mpl-1.1", "mozilla org", r"(?:www )?mozilla org mpl mpl 1 1(?: html)?", 1.0),
    ("epl-2.0", "eclipse org", r"(?:www )?eclipse org legal epl 2 0(?: html)?", 1.0),
    ("epl", "eclipse org", r"(?:www )?eclipse org legal epl v10(?: html)?", 1.0),
    ("edl", "eclipse org", r"(?:www )?eclipse org org documents edl v10(?: html| php)?", 1.0),
    ("edl", "eclipse distribution", r"eclipse distribution license(?: v)?(?: 1 0)?", 0.9),
    ("cddl", "cddl", r"cddl(?: v)?(?: 1 [01])?", 0.7),
    ("cpl", "common public", r"common public license(?: version)?(?: 1 0)?", 0.9),
    ("bsl-1.0", "boost org", r"(?:www )?boost org license 1 0 txt", 1.0),
    ("bsl-1.1", "business source", r"business source license(?: 1 1)?", 0.9),
    ("zlib", "as is without", r"this software is provided as is without any express or implied warranty in no event will the authors be held liable", 0.9),
    ("zlib", "origin of this", r"the origin of this software must not be misrepresented", 0.9),
    ("libpng", "libpng", r"libpng licen[cs]e(?: version 2)?", 0.8),
    ("unlicense", "unlicense", r"(?:www )?unlicense org", 1.0),
    ("unlicense", "unencumbered", r"this is free and unencumbered software released into the public domain", 1.0),
    ("cc0-1.0", "creativecommons org", r"creativecommons org publicdomain zero 1 0", 1.0),
    ("cc0-1.0", "copyright and related", r"waived all copyright and related or neighboring rights", 0.9),
    ("cc-by", "creativecommons org", r"creativecommons org licenses by [1-4] [05]", 1.0),
    ("cc-by-sa", "creativecommons org", r"creativecommons org licenses by sa [1-4] [05]", 1.0),
    ("cc-by-nc", "creativecommons org", r"creativecommons org licenses by nc [1-4] [05]", 1.0),
    ("cc-by-nd", "creativecommons org", r"creativecommons org licenses by nd [1-4] [05]", 1.0),
    ("cc-by-nc-sa", "creativecommons org", r"creativecommons org licenses by nc sa [1-4] [05]", 1.0),
    ("cc-by-nc-nd", "creativecommons org", r"creativecommons org licenses by nc nd [1-4] [05]", 1.0),
    ("cc-pd-mark", "creativecommons org", r"creativecommons org publicdomain mark 1 0", 1.0),
    ("wtfpl", "what the fuck", r"do what the fuck you want to public license", 1.0),
    ("wtfpl", "wtfpl", r"(?:www )?wtfpl net", 1.0),
    ("ofl-1.1", "scripts sil", r"scripts sil org ofl", 1.0),
    ("artistic", "perlfoundation", r"(?:www )?perlfoundation org artistic license 2 0", 1.0),
    ("artistic", "same terms as perl", r"under the same terms as perl(?: itself)?", 0.9),
    ("eupl", "eupl", r"eupl(?: v)?(?: ?1 [012])?", 0.8),
    ("osl-3.0", "open software license", r"open software license(?: version)?(?: 3 0)?", 0.9),
    ("afl-3.0", "academic free", r"academic free license(?: version)?(?: 3 0)?", 0.9),
    ("ms-pl", "microsoft public", r"microsoft public licen[cs]e", 0.9),
    ("ms-rl", "microsoft reciprocal", r"microsoft reciprocal licen[cs]e", 0.9),
    ("ncsa", "ncsa", r"(?:university of illinois )?ncsa open source licen[cs]e", 0.9),
    ("postgresql", "postgresql licen", r"postgresql licen[cs]e", 0.9),
    ("php", "php license", r"php license(?: version)?(?: 3 01?)?", 0.9),
    ("ruby", "ruby licen", r"ruby licen[cs]e", 0.8),
    ("vim", "vim licen", r"vim licen[cs]e", 0.8),
    ("openssl", "openssl licen", r"openssl licen[cs]e", 0.9),
    ("openssl", "openssl project", r"this product includes software developed by the openssl project", 0.9),
    ("sspl-1.0", "server side public", r"server side public license(?: version)?(?: 1)?", 0.9),
    ("elastic-2.0", "elastic licen", r"elastic licen[cs]e(?: 2 0)?", 0.9),
    ("polyform", "polyform", r"polyform (?:noncommercial|shield|strict|small business) license(?: 1 0 0)?", 0.9),
    ("json", "good not evil", r"the software shall be used for good not evil", 1.0),
    ("beerware", "beer ware", r"(?:the )?beer ware license(?: revision 42)?", 0.9),
    ("mulan", "mulan", r"mulan (?:permissive software license|psl)(?: v ?2| 2 0)?", 0.9),
    ("llama", "llama", r"llama (?:\d(?: \d)? )?community license(?: agreement)?", 0.9),
    ("openrail", "responsible ai", r"(?:open )?responsible ai licen[cs]es?", 0.8),
    ("odbl", "opendatacommons", r"opendatacommons org licenses odbl(?: 1 0)?", 1.0),
    ("odc-by", "opendatacommons", r"opendatacommons org licenses by(?: 1 0)?", 1.0),
    ("odc-by", "open data commons attribution", r"open data commons attribution license(?: v)?(?: 1 0)?", 0.9),
    ("pddl", "opendatacommons", r"opendatacommons org licenses pddl(?: 1 0)?", 1.0),
    ("ogl-uk", "open government", r"open government licen[cs]e(?: v)?(?: ?[123] 0)?", 0.9),
    ("etalab", "etalab", r"licen[cs]e ouverte etalab(?: 2 0)?", 0.9),
    ("proprietary", "all rights reserved", r"all rights reserved", 0.3),
    ("proprietary", "confidential and proprietary", r"confidential and proprietary(?: information)?", 0.5),
    ("non-commercial", "non commercial use", r"(?:for )?non commercial use only", 0.5),
)

#: Kinds of rule from most to least telling: prefix before a family's name, weight.
KINDS = (
    (r"spdx license identifier ", 1.0),
    (r"(?:licensed|released|distributed|published|available) under (?:the )?(?:terms of (?:the )?)?", 0.9),
    (r"(?:subject to|governed by|according to|covered by) (?:the )?(?:terms of (?:the )?)?", 0.8),
    (r"(?:dedicated to|placed in|under) (?:the )?", 0.7),
    (r"", 0.5),
)


def signature_rules() -> list[tuple[int, str, str, str, float]]:
    """(priority, label, keyword, regex, weight), a lower priority number first.

    Written notices come first. Kinds come before families, so a grant outranks a mention, and among each the written order counts.
    """
    named = [(label, keyword, prefix + name, weight) for (prefix, weight), (label, keyword, name) in product(KINDS, FAMILIES)]
    return [(i, *rule) for i, rule in enumerate([*NOTICES, *named])]


WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _pieces(keyword: str, pattern: str) -> set[str]:
    """Strings without a space that every text holds in which a rule matches: of its keyword, and of its regex's fixed words."""
    fixed = pattern
    while (less := re.sub(r"\((?:\?:)?[^()]*\)\?", "#", fixed)) != fixed:
        fixed = less
    fixed = re.sub(r"\[[^\]]*\]\??|\.\{\d+,\d+\}|\\.\??|.\?", "#", fixed)
    return {x for part in (keyword, *([] if re.search(r"[|()]", fixed) else fixed.split("#"))) for x in part.split()}


def _cover(wanted: list[set[str]]) -> tuple[str, ...]:
    """Few pieces of which each set holds one, or one that contains one: the piece that serves most open sets first, short ones last."""
    open_, out = [s for s in wanted if s], []
    while open_:
        serves = {p: sum(any(p in x for x in s) for s in open_) for p in set().union(*open_)}
        best = min(serves, key=lambda p: (len(p) <= 3, -serves[p], p))
        out.append(best)
        open_ = [s for s in open_ if not any(best in x for x in s)]
    return tuple(out)


#: One of these strings is in every lower-cased text in which a rule or base phrase matches; derived from the rules themselves. "cc" is checked further.
GATES = _cover([_pieces(k, x) for rows in (FAMILIES, NOTICES) for _, k, x, *_ in rows if not k.startswith("cc")] + [set(p.split()) for p, _ in BASE if not p.startswith("cc")])


def _spaces(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))


def _gate(raw: Column) -> Column:
    """Whether lower-cased text may hold a rule or base phrase: byte searches, no regex but for the rare "cc"."""
    out = F.contains(raw, F.lit("cc")) & F.regexp_like(raw, F.lit(r"cc(?:0|[\x00-\x2F\x3A-\x60\x7B-\x7F]+by)"))
    for g in GATES:
        out = F.contains(raw, F.lit(g)) | out
    return out


def _matches(w: Column, rule: Column) -> Column:
    """The intervals of words at which a rule matches: the text is cut before each match, words are counted up to it."""
    look = F.concat(F.lit("(?= (?:"), rule["regex"], F.lit(") )"))
    anchored = F.concat(F.lit("^ ((?:"), rule["regex"], F.lit(")) "))
    start = F.struct(
        F.lit(0).cast("long").alias("at"),
        F.array().cast("array<struct<start:bigint,negative_end:bigint,rule:int,label:string,weight:double>>").alias("found"),
    )

    def step(acc: Column, piece: Column) -> Column:
        match = F.call_function("regexp_extract", F.concat(piece, F.lit(" ")), anchored, F.lit(1))
        one = F.array(
            F.struct(
                acc["at"].alias("start"),
                (-(acc["at"] + _spaces(match) + 1)).cast("long").alias("negative_end"),
                rule["rule"].alias("rule"),
                rule["label"].alias("label"),
                rule["weight"].alias("weight"),
            )
        )
        return F.struct((acc["at"] + _spaces(piece)).cast("long").alias("at"), F.when(match != "", F.concat(acc["found"], one)).otherwise(acc["found"]).alias("found"))

    return F.aggregate(F.split(w, look), start, step)["found"]


def _standing(found: Column) -> Column:
    """Fold over intervals sorted by start, the longer first, then rule order: one that ends within those before it is suppressed."""
    start = F.struct(F.lit(-1).cast("long").alias("reach"), F.array().cast("array<string>").alias("labels"), F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("n"))

    def step(acc: Column, x: Column) -> Column:
        end = -x["negative_end"]
        stands = end > acc["reach"]
        return F.struct(
            F.greatest(end, acc["reach"]).alias("reach"),
            F.when(stands, F.array_union(acc["labels"], F.array(x["label"]))).otherwise(acc["labels"]).alias("labels"),
            F.when(stands, F.greatest(acc["score"], x["weight"])).otherwise(acc["score"]).alias("score"),
            (acc["n"] + stands.cast("long")).alias("n"),
        )

    return F.aggregate(F.array_sort(found), start, step)


def scan(docs: DataFrame) -> DataFrame:
    """License detections per document (doc_id, text).

    Words are maximal runs of digits, ASCII letters (lower-cased) and non-ASCII characters. Base: every
    place where a base phrase's words stand consecutively. Rules: gated by their keyword, matched over
    words; a detection inside another's interval is suppressed (equal intervals: the rule earlier in
    order stays). Base labels always stay. ``score`` is the largest weight of a standing detection (a
    base place counts 0.5), else 0; ``n_detections`` counts those that stand. Null and empty texts
    have no words and score 0, rows that repeat a doc_id are returned each, an empty table gives an empty one.
    All work is inside the row: no shuffle, no Python.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    words = F.concat(F.lit(". "), F.trim(F.regexp_replace(F.translate("text", UPPER, LOWER), GAP, " ")), F.lit(" "))
    gated = docs.select("doc_id", F.regexp_count("text", F.lit(WORD)).cast("long").alias("n_words"), F.when(_gate(F.lower("text")), words).alias("w"))
    either = "|".join(p for p, _ in BASE)
    count = {label: F.coalesce(F.regexp_count("w", F.lit(rf" {phrase}(?= )")), F.lit(0)) for phrase, label in BASE}
    rules = F.array(*[F.struct(F.lit(p).alias("rule"), F.lit(label).alias("label"), F.lit(k).alias("keyword"), F.lit(x).alias("regex"), F.lit(float(weight)).alias("weight")) for p, label, k, x, weight in signature_rules()])
    found = F.flatten(F.transform(F.filter(rules, lambda r: F.contains(F.col("w"), r["keyword"])), lambda r: _matches(F.col("w"), r)))
    seen = gated.select(
        "doc_id",
        "n_words",
        sum(count.values(), F.lit(0)).cast("long").alias("n_base"),
        _spaces(F.regexp_extract("w", rf"(?s)^(.*?) (?:{either}) ", 1)).cast("long").alias("head"),
        _spaces(F.regexp_extract("w", rf"(?s)^(.*) (?:{either}) ", 1)).cast("long").alias("tail"),
        F.array_compact(F.array(*[F.when(c > 0, F.lit(label)) for label, c in count.items()])).alias("base"),
        F.when(F.col("w").isNotNull(), _standing(found)).alias("kept"),
    )
    based = F.col("n_base") > 0
    return seen.select(
        "doc_id",
        "n_words",
        "n_base",
        F.when(based, F.col("head")).alias("first_word"),
        F.when(based, F.col("tail")).alias("last_word"),
        F.array_join(F.array_sort("base"), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", F.coalesce("kept.labels", F.array().cast("array<string>")))), ",").alias("labels"),
        F.greatest(F.coalesce("kept.score", F.lit(0.0)), F.when(based, F.lit(0.5)).otherwise(F.lit(0.0))).alias("score"),
        F.coalesce("kept.n", F.lit(0).cast("long")).alias("n_detections"),
    )


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License detections of every document's whole text."""
    return scan(table(spark, sf_dir, "documents", "doc_id", "text"))
