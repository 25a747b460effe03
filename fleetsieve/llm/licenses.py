"""License scan with ordered signature rules, in DataFrame expressions only.

Texts become lower-cased words between single spaces, so a rule is a regular expression over words
and counts of spaces are word positions. A text without any keyword costs one search; for the others,
the rules whose keyword occurs are run, and every detection is an interval of words with the priority
of its rule. A detection that lies within one of the same or a higher priority is suppressed: the
sweep over intervals by start (longer ones first) keeps the furthest end seen for each priority.

Rules are hundreds, made from families of names and sentence forms. Base phrases are counted apart
and their labels always stay.
"""
import json

from pyspark.sql import Column, DataFrame, functions as F

from fleetsieve.llm.common import LOWER, UPPER

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Fixed values: (label, keyword, expression for its name). The keyword occurs in every form of the name.
NAMES = [
    ("0bsd", "0bsd", "0bsd"), ("afl", "academic", "academic free"), ("agpl", "affero", "(?:gnu )?affero general public"),
    ("apache", "apache", "apache(?: software)?"), ("apsl", "apple", "apple public source"), ("artistic", "artistic", "artistic"),
    ("beerware", "beerware", "beerware"), ("blueoak", "oak", "blue oak model"), ("bsd", "bsd", "(?:new |modified |simplified |original )?bsd"),
    ("bsd-2-clause", "clause", "(?:bsd 2 clause|2 clause bsd|two clause bsd)"), ("bsd-3-clause", "clause", "(?:bsd 3 clause|3 clause bsd|three clause bsd)"),
    ("bsd-4-clause", "clause", "(?:bsd 4 clause|4 clause bsd|four clause bsd)"), ("bsl", "boost", "boost software"),
    ("busl", "business", "business source"), ("caldera", "caldera", "caldera"), ("cc0", "cc0", "cc0"), ("cc0", "zero", "creative commons zero"),
    ("cc-by-nc-nd", "nd", "(?:cc|creative commons) by nc nd"), ("cc-by-nc-sa", "sa", "(?:cc|creative commons) by nc sa"),
    ("cc-by-nc", "nc", "(?:cc|creative commons) by nc"), ("cc-by-nd", "nd", "(?:cc|creative commons) by nd"),
    ("cc-by-sa", "sa", "(?:cc|creative commons) by sa"), ("cc-by", "cc", "cc by"), ("cc-by", "attribution", "creative commons attribution"),
    ("cc-by-nc", "noncommercial", "creative commons attribution noncommercial"), ("cc-by-sa", "sharealike", "creative commons attribution sharealike"),
    ("cc-by-nd", "noderivatives", "creative commons attribution noderivatives"), ("cddl", "cddl", "cddl"), ("cddl", "distribution", "common development and distribution"),
    ("cecill", "cecill", "cecill"), ("cpal", "cpal", "cpal"), ("cpl", "common", "common public"), ("ecl", "educational", "educational community"),
    ("eclipse", "eclipse", "eclipse public"), ("efl", "eiffel", "eiffel forum"), ("epl", "epl", "epl"), ("eupl", "eupl", "eupl"),
    ("eupl", "european", "european union public"), ("fdl", "documentation", "(?:gnu )?free documentation"), ("freetype", "freetype", "freetype"),
    ("gpl", "gpl", "(?:gnu )?gpl"), ("gpl", "gplv2", "gplv2"), ("gpl", "gplv3", "gplv3"), ("gpl", "general", "(?:gnu )?general public"),
    ("hpnd", "historical", "historical permission notice and disclaimer"), ("icu", "icu", "icu"), ("ijg", "jpeg", "independent jpeg group"),
    ("intel", "intel", "intel open source"), ("ipa", "ipa", "ipa font"), ("ipl", "ibm", "ibm public"), ("isc", "isc", "isc"),
    ("lgpl", "lgpl", "(?:gnu )?lgpl"), ("lgpl", "lesser", "(?:gnu )?lesser general public"), ("lgpl", "library", "(?:gnu )?library general public"),
    ("lppl", "latex", "latex project public"), ("lpl", "lucent", "lucent public"), ("miros", "miros", "miros"), ("mit", "mit", "mit"), ("mit", "expat", "expat"),
    ("mit-0", "attribution", "mit no attribution"), ("mpl", "mpl", "mpl"), ("mpl", "mozilla", "mozilla public"), ("ms-pl", "microsoft", "microsoft public"),
    ("ms-rl", "microsoft", "microsoft reciprocal"), ("mulan", "mulan", "mulan (?:psl|permissive software)"), ("ncsa", "illinois", "university of illinois ncsa open source"),
    ("nasa", "nasa", "nasa open source agreement"), ("nokia", "nokia", "nokia open source"), ("npl", "netscape", "netscape public"),
    ("odbl", "database", "open (?:data commons )?(?:open )?database"), ("odc-by", "commons", "open data commons attribution"), ("ofl", "font", "(?:sil )?open font"),
    ("ogl", "government", "open government"), ("openssl", "openssl", "openssl"), ("oldap", "openldap", "openldap public"), ("osl", "open", "open software"),
    ("pddl", "dedication", "public domain dedication and"), ("php", "php", "php"), ("postgresql", "postgresql", "postgresql"), ("psf", "python", "python software foundation"),
    ("qpl", "q", "q public"), ("rpl", "reciprocal", "reciprocal public"), ("ruby", "ruby", "ruby"), ("sgi", "sgi", "sgi free software"), ("sleepycat", "sleepycat", "sleepycat"),
    ("spl", "sun", "sun public"), ("sspl", "sspl", "sspl"), ("sspl", "server", "server side public"), ("unicode", "unicode", "unicode"), ("unlicense", "unlicense", "unlicense"),
    ("upl", "universal", "universal permissive"), ("vim", "vim", "vim"), ("w3c", "w3c", "w3c software"), ("watcom", "watcom", "sybase open watcom public"),
    ("wtfpl", "wtfpl", "wtfpl"), ("x11", "x11", "x11"), ("xfree86", "xfree86", "xfree86"), ("zend", "zend", "zend"), ("zlib", "zlib", "zlib"), ("zpl", "zope", "zope public"),
]
# Fixed values: (label, keyword, words) of clauses that only one family has.
CLAUSES = [
    ("mit", "charge", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("isc", "fee", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", "redistribution", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("zlib", "misrepresented", "the origin of this software must not be misrepresented"), ("unlicense", "unencumbered", "free and unencumbered software released into the public domain"),
    ("gpl", "redistribute", "redistribute it and or modify it under the terms of the gnu general public"),
    ("lgpl", "redistribute", "redistribute it and or modify it under the terms of the gnu lesser general public"),
    ("agpl", "redistribute", "redistribute it and or modify it under the terms of the gnu affero general public"),
    ("apache", "compliance", "you may not use this file except in compliance with the license"), ("mpl", "mozilla", "subject to the terms of the mozilla public license"),
    ("bsl", "boost", "distributed under the boost software license"), ("public-domain", "domain", "(?:dedicated to|released (?:in)?to|placed in|in) the public domain"),
    ("all-rights-reserved", "reserved", "all rights reserved"), ("wtfpl", "fuck", "do what the fuck you want to public"),
]
VERBS = "licensed|released|distributed|available|provided"
VERSION = r"(?: (?:version |v)?[0-9]+(?: [0-9]+)*)?"


def rules() -> list[tuple]:
    """(priority, confidence, label, keyword, expression); a lower priority number goes first."""
    out = [(1, 1.0, *x) for x in CLAUSES]
    for label, keyword, name in NAMES:
        out.append((2, 0.9, label, keyword, rf"spdx license identifier {name}{VERSION}(?: only| or later)?"))
        out.append((2, 0.95, label, keyword, rf"(?:{VERBS}) under (?:the )?(?:terms of )?(?:the )?{name}(?: licen[sc]e)?{VERSION}"))
        out.append((3, 0.7, label, keyword, rf"{name} licen[sc]e{VERSION}"))
    return out


def words(text: Column) -> Column:
    """' a b c ': the lower-cased words of a text between single spaces; ' ' if there are none."""
    lower = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.regexp_replace(F.concat(F.lit(" "), lower, F.lit(" ")), NOT_WORD, " ")


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def places(text: Column, expression: Column) -> Column:
    """Array of (start, end) in words, the end not included, of the matches of an expression in words(text)."""
    whole = F.concat(F.lit("(?<= )(?:"), expression, F.lit(")(?= )"))
    found = F.regexp_extract_all(text, whole, F.lit(0))
    between = F.split(text, whole, -1)
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))
    walked = F.aggregate(F.arrays_zip(found.alias("match"), F.slice(between, 1, F.size(found)).alias("gap")), zero, lambda acc, x: F.struct(
        (acc["at"] + _spaces(x["gap"]) + _spaces(x["match"])).cast("int").alias("at"),
        F.concat(acc["out"], F.array(F.struct((acc["at"] + _spaces(x["gap"]) - 1).cast("int").alias("start"),
                                              (acc["at"] + _spaces(x["gap"]) + _spaces(x["match"])).cast("int").alias("end")))).alias("out")))
    return walked["out"]


def detections(text: Column, keywords: Column) -> Column:
    """Of words(text) and the keywords in it: array of (start, end, priority, label, confidence)."""
    fields = ("priority", "confidence", "label", "keyword", "rule")
    table = F.from_json(F.lit(json.dumps([dict(zip(fields, x)) for x in rules()])),
                        "array<struct<priority:int,confidence:double,label:string,keyword:string,rule:string>>")
    gated = F.flatten(F.transform(F.array(keywords), lambda own: F.filter(table, lambda r: F.array_contains(own, r["keyword"]))))  # keywords found once
    return F.flatten(F.transform(gated, lambda r: F.transform(places(text, r["rule"]), lambda x: F.struct(
        x["start"].alias("start"), x["end"].alias("end"), r["priority"].alias("priority"), r["label"].alias("label"), r["confidence"].alias("confidence")))))


def surviving(found: Column) -> Column:
    """Detections that aren't contained in one of the same or a higher priority."""
    in_order = F.array_sort(found, lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).when(a["end"] != b["end"], b["end"] - a["end"])
                            .otherwise(a["priority"] - b["priority"]).cast("int"))
    item = "struct<start:int,end:int,priority:int,label:string,confidence:double>"
    start = F.struct(F.array(*[F.lit(-1)] * 3).alias("ends"), F.array().cast(f"array<{item}>").alias("out"))

    def step(acc, x):
        covered = F.array_max(F.slice(acc["ends"], 1, x["priority"])) >= x["end"]
        ends = F.transform(acc["ends"], lambda e, i: F.when(i + 1 == x["priority"], F.greatest(e, x["end"])).otherwise(e))
        return F.struct(ends.alias("ends"), F.when(covered, acc["out"]).otherwise(F.concat(acc["out"], F.array(x.cast(item)))).alias("out"))

    return F.aggregate(in_order, start, step)["out"]


def scan_licenses(docs: DataFrame, doc_id="doc_id", text="text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections of each row.

    A null text counts as empty: no words, empty label lists, no positions, score 0. Detections are the
    surviving intervals [start, end) in words; the score is the confidence of the surest one, 1 for a
    base phrase. Every row is judged by itself, without a shuffle.
    """
    # One search decides whether a text needs any rule: each clause has its keyword, and each other rule
    # and base phrase has the word license or a verb before "under". Keywords then choose the rules.
    clauses = "|".join(sorted({x[1] for x in CLAUSES}))
    gate = rf" (?:licen[sc]e|(?:{VERBS}) under|{clauses}) "
    names = sorted({r[3] for r in rules()})
    rows = docs.select(F.col(doc_id).alias("doc_id"), words(F.col(text)).alias("norm"))
    rows = rows.withColumn("hit", F.col("norm").rlike(gate))
    keywords = F.array_distinct(F.regexp_extract_all("norm", F.lit(rf"(?<= )({'|'.join(names)})(?= )"), F.lit(1)))
    def of_phrase(phrase, label):
        return F.transform(places(F.col("norm"), F.lit(phrase)), lambda x: F.struct(x["start"].alias("start"), F.lit(label).alias("label")))

    base = F.flatten(F.array(*[of_phrase(*x) for x in BASE.items()]))
    rows = rows.select("doc_id", (_spaces(F.col("norm")) - 1).cast("long").alias("n_words"),
                       F.when(F.col("hit"), base).alias("base"), F.when(F.col("hit"), surviving(detections(F.col("norm"), keywords))).alias("found"))
    base_labels = F.array_sort(F.array_distinct(F.transform("base", lambda x: x["label"])))
    labels = F.array_sort(F.array_union(F.transform("base", lambda x: x["label"]), F.transform("found", lambda x: x["label"])))
    return rows.select(
        "doc_id", "n_words", F.coalesce(F.size("base"), F.lit(0)).cast("long").alias("n_base"),
        F.array_min(F.transform("base", lambda x: x["start"])).cast("long").alias("first_word"),
        F.array_max(F.transform("base", lambda x: x["start"])).cast("long").alias("last_word"),
        F.coalesce(F.array_join(base_labels, ","), F.lit("")).alias("base_labels"), F.coalesce(F.array_join(labels, ","), F.lit("")).alias("labels"),
        F.when(F.size("base") > 0, 1.0).otherwise(F.coalesce(F.array_max(F.transform("found", lambda x: x["confidence"])), F.lit(0.0))).alias("score"),
        F.coalesce("found", F.array().cast("array<struct<start:int,end:int,priority:int,label:string,confidence:double>>")).alias("detections"))
