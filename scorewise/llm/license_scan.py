"""Operator 2, license scan by ordered signature rules (DataFrame functions only).

A rule is a pair of regular expressions over a document's words, written around
an anchor word: one must match just before the anchor, one from the anchor on.
Stages:

1. keyword prefilter: texts without any anchor keyword are not split into words;
2. every anchor word of the others gives a window of ``REACH`` words to both
   sides; only windows that some rule of the anchor matches (one literal
   pattern per anchor, compiled once a task) go on;
3. rules join these windows by anchor word (the rule table is a parameter and
   small) and give detections with start and end word;
4. license texts: a header and the clauses that follow it, within ``SCOPE`` words
   and before the next header, decide the label together (``TEXT_LABELS``);
5. suppression: of detections of one document, one that lies within another is
   dropped; of equal intervals the one of higher priority stays.

Base phrases are rules as well, counted at every place and never suppressed.
A null text counts as empty; a document without detections has empty labels
and score 0.  Rows that repeat a doc_id are scanned each.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorewise.llm.common import LOWER, UPPER, cut, text_of

#: Words of a window to each side of its anchor; ``check_rules`` refuses longer rules.
REACH = 24
#: Words in which the clauses of a license text follow its header.
SCOPE = 400
#: Fixed values of the method: base phrases and their labels.
BASE = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]
#: License families: label, words of the name, words of the SPDX identifier.
FAMILIES = [
    ("mit", "mit", "mit"), ("mit-0", "mit no attribution", "mit 0"), ("x11", "x11", "x11"),
    ("apache-1", "apache( software)?( license)? (version|v) ?1( [01])?", "apache 1 [01]"),
    ("apache-2", "apache( software)?( license)? (version|v) ?2( 0)?", "apache 2 0"),
    ("gpl-1", "(gnu )?(general public license|gpl)( (version|v))? ?1( 0)?", "gpl 1 0( only| or later)?"),
    ("gpl-2", "(gnu )?(general public license|gpl)( (version|v))? ?2( 0)?", "gpl 2 0( only| or later)?"),
    ("gpl-3", "(gnu )?(general public license|gpl)( (version|v))? ?3( 0)?", "gpl 3 0( only| or later)?"),
    ("lgpl-2", "(gnu )?(lesser|library) general public license( (version|v))? ?2( 0)?", "lgpl 2 0( only| or later)?"),
    ("lgpl-2.1", "(gnu )?lesser general public license( (version|v))? ?2 1", "lgpl 2 1( only| or later)?"),
    ("lgpl-3", "(gnu )?lesser general public license( (version|v))? ?3( 0)?", "lgpl 3 0( only| or later)?"),
    ("agpl-3", "(gnu )?affero general public license( (version|v))? ?3( 0)?", "agpl 3 0( only| or later)?"),
    ("gfdl-1.2", "(gnu )?free documentation license( (version|v))? ?1 2", "gfdl 1 2( only| or later)?"),
    ("gfdl-1.3", "(gnu )?free documentation license( (version|v))? ?1 3", "gfdl 1 3( only| or later)?"),
    ("bsd-0", "(bsd )?(zero clause|0 clause)( bsd)?", "0bsd"),
    ("bsd-2", "(simplified|2 clause|two clause|freebsd) bsd|bsd (2|two) clause", "bsd 2 clause"),
    ("bsd-3", "(modified|revised|new|3 clause|three clause) bsd|bsd (3|three) clause", "bsd 3 clause"),
    ("bsd-4", "(original|4 clause|four clause) bsd|bsd (4|four) clause", "bsd 4 clause"),
    ("isc", "isc", "isc"), ("zlib", "zlib( libpng)?", "zlib"), ("boost-1", "boost software( license)?( (version|v))?( 1 0)?", "bsl 1 0"),
    ("mpl-1", "mozilla public( license)?( (version|v))? ?1( [01])?", "mpl 1 [01]"),
    ("mpl-2", "mozilla public( license)?( (version|v))? ?2( 0)?", "mpl 2 0"),
    ("epl-1", "eclipse public( license)?( (version|v))? ?1( 0)?", "epl 1 0"),
    ("epl-2", "eclipse public( license)?( (version|v))? ?2( 0)?", "epl 2 0"),
    ("eupl-1.2", "european union public( (licence|license))?( (version|v))? ?1 2", "eupl 1 2"),
    ("cddl-1", "common development and distribution( license)?( (version|v))? ?1( [01])?", "cddl 1 [01]"),
    ("artistic-1", "artistic( license)?( (version|v))? ?1( 0)?", "artistic 1 0"),
    ("artistic-2", "artistic( license)?( (version|v))? ?2( 0)?", "artistic 2 0"),
    ("osl-3", "open software( license)?( (version|v))? ?3( 0)?", "osl 3 0"),
    ("afl-3", "academic free( license)?( (version|v))? ?3( 0)?", "afl 3 0"),
    ("ms-pl", "microsoft public", "ms pl"), ("ms-rl", "microsoft reciprocal", "ms rl"),
    ("ofl-1.1", "sil open font( license)?( (version|v))?( 1 1)?", "ofl 1 1"),
    ("php-3", "php( license)?( (version|v))? ?3( 0| 01)?", "php 3 0?1?"),
    ("python-2", "python software foundation( license)?( (version|v))?( 2)?", "psf 2 0"),
    ("postgresql", "postgresql", "postgresql"), ("openssl", "openssl", "openssl"), ("wtfpl", "wtfpl", "wtfpl"),
    ("unlicense", "unlicense", "unlicense"), ("upl-1", "universal permissive( license)?( (version|v))?( 1 0)?", "upl 1 0"),
    ("odbl-1", "open database( license)?( (version|v))?( 1 0)?", "odbl 1 0"),
    ("bsl-1.1", "business source( license)?( (version|v))?( 1 1)?", "busl 1 1"),
    ("sspl-1", "server side public( license)?( (version|v))?( 1)?", "sspl 1 0"),
]
#: Names that hold the word license: label, anchor word, words before, words from the anchor on, versions.
NAMED = [
    ("gpl", "general", "", "general public licen[cs]e", ["1", "2", "3"]), ("gpl", "general", "gnu ", "general public licen[cs]e", ["1", "2", "3"]),
    ("lgpl", "general", "(gnu )?(lesser|library) ", "general public licen[cs]e", ["2", "2 1", "3"]),
    ("agpl", "general", "(gnu )?affero ", "general public licen[cs]e", ["3"]), ("gfdl", "documentation", "(gnu )?free ", "documentation licen[cs]e", ["1 2", "1 3"]),
    ("apache", "apache", "", "apache( software)? licen[cs]e", ["1", "1 1", "2"]), ("mpl", "mozilla", "", "mozilla public licen[cs]e", ["1", "1 1", "2"]),
    ("epl", "eclipse", "", "eclipse public licen[cs]e", ["1", "2"]), ("eupl", "union", "european ", "union public licen[cs]e", ["1 1", "1 2"]),
    ("cddl", "cddl", "", "cddl", ["1", "1 1"]), ("artistic", "artistic", "", "artistic licen[cs]e", ["1", "2"]),
    ("boost", "boost", "", "boost software licen[cs]e", ["1"]), ("gpl", "gpl", "", "gpl", ["1", "2", "3"]), ("lgpl", "lgpl", "", "lgpl", ["2", "2 1", "3"]),
    ("agpl", "agpl", "", "agpl", ["3"]), ("mpl", "mpl", "", "mpl", ["1 1", "2"]),
]
#: Creative Commons elements: label part, words, words in the long name.
CC_PARTS = [("by", "by", "attribution"), ("by-sa", "by sa", "attribution share ?alike"), ("by-nd", "by nd", "attribution no ?deriv(s|atives)"),
            ("by-nc", "by nc", "attribution non ?commercial"), ("by-nc-sa", "by nc sa", "attribution non ?commercial share ?alike"),
            ("by-nc-nd", "by nc nd", "attribution non ?commercial no ?deriv(s|atives)")]
CC_VERSIONS = ["1 0", "2 0", "2 5", "3 0", "4 0"]
#: Single notices: label, anchor word, words before, words from the anchor on.
NOTICES = [
    ("public-domain", "domain", "(in|into|to) the public ", "domain"), ("public-domain", "domain", "public ", "domain dedication"),
    ("all-rights-reserved", "reserved", "all rights ", "reserved"), ("proprietary", "proprietary", "", "proprietary and confidential"),
    ("copyright-notice", "copyright", "", "copyright (c )?((19|20)[0-9]{2}|by)"), ("unlicense", "unencumbered", "free and ", "unencumbered software released into the public domain"),
    ("zlib", "authors", "in no event will the ", "authors be held liable for any damages"), ("wtfpl", "fuck", "do what the ", "fuck you want to( public licen[cs]e)?"),
    ("boost-1", "charge", "permission is hereby granted free of ", "charge to any person or organization obtaining a copy"),
    ("cc0", "cc0", "", "cc0( 1 0)?( universal)?"), ("gpl-2", "gplv2", "", "gplv2"), ("gpl-3", "gplv3", "", "gplv3"), ("lgpl-3", "lgplv3", "", "lgplv3"),
    ("agpl-3", "agplv3", "", "agplv3"), ("gpl", "gpl", "", "gpl"), ("lgpl", "lgpl", "", "lgpl"), ("agpl", "agpl", "", "agpl"), ("bsd", "bsd", "", "bsd"),
]
#: Frames that make the German word "mit" a license name: anchor word, words before, words from the anchor on.
MIT_FRAMES = [("(under|the|an?|is|uses|expat|and|or|of|same) mit ", "{}(?! plates?)"), ("mit ", "{}(?= (copyright|permission|c|see|version)| ?$)"),
              ("", "{} mit(?= (licen[cs]e|copyright|and|or|see|c|version|authors?)| ?$)")]
#: Headers of the free software foundation's notices: label, name before the anchor, versions.
GNU_NOTICES = [("gpl", "", ["1", "2", "3"]), ("lgpl", "(lesser|library) ", ["2", "2 1", "3"]), ("agpl", "affero ", ["3"])]
#: License texts: family, part (the header or a clause), anchor word, words before, words from the anchor on.
TEXTS = [
    ("bsd", "head", "redistribution", "", "redistribution and use in source and binary forms"),
    ("bsd", "binary", "redistributions", "", "redistributions in binary form must reproduce"), ("bsd", "names", "neither", "", "neither the names? of"),
    ("bsd", "names", "endorse", "be used to ", "endorse or promote products"), ("bsd", "advertising", "advertising", "all ", "advertising materials mentioning features"),
    ("mit", "head", "charge", "permission is hereby granted free of ", "charge to any person obtaining a copy"),
    ("mit", "notice", "permission", "above copyright notice and this ", "permission notice"), ("mit", "except", "except", "", "except as contained in this notice"),
    ("mit", "warranty", "merchantability", "limited to the warranties of ", "merchantability"),
    ("isc", "head", "purpose", "permission to use copy modify and( or)? distribute this software for any ", "purpose with or without fee"),
    ("isc", "notice", "provided", "", "provided that the above copyright notice"), ("isc", "warranty", "disclaims", "", "disclaims all warranties"),
]
#: Labels of a header by a clause that follows it, the first that fits; an empty clause always does.
TEXT_LABELS = [("bsd", "advertising", "bsd-4"), ("bsd", "names", "bsd-3"), ("bsd", "binary", "bsd-2"), ("bsd", "", "bsd"),
               ("mit", "except", "x11"), ("mit", "notice", "mit"), ("mit", "warranty", "mit-0"), ("mit", "", "mit"),
               ("isc", "notice", "isc"), ("isc", "warranty", "bsd-0"), ("isc", "", "isc")]
RULE_SCHEMA = ("rule string, label string, kind string, priority int, confidence double, anchor string, "
               "before string, after string")


def rules() -> list[tuple]:
    """The ordered rules: base phrases, SPDX tags, grants, mentions, Creative
    Commons names, notices, headers and clauses of license texts (kinds ``head``
    and ``clause``, label ``family:part``).  A higher priority wins over an equal
    interval."""
    out: list[tuple] = []

    def add(label, kind, priority, confidence, anchor, before, after):
        out.append((f"r{len(out):03d}", label, kind, priority, confidence, anchor, before, after))

    anchors = {"mit": ("license", "under the mit ", "license"), "apache-2": ("apache", "", "apache license version 2"),
               "cc-by-nc": ("cc", "", "cc by nc")}
    for _, label in BASE:
        anchor, before, after = anchors[label]
        add(label, "base", 100, 1.0, anchor, before, after)
    for label, name, spdx in FAMILIES:
        add(label, "method", 90, 1.0, "spdx", "", f"spdx license identifier ({spdx})")
        for word in ("licensed", "released", "distributed", "available"):
            add(label, "method", 80, 0.95, word, "", f"{word} under (the )?(terms of the )?({name})( licen[cs]e)?")
        for word in ("license", "licence"):
            if label == "mit":
                for before, after in MIT_FRAMES:
                    add(label, "method", 60, 0.8, word, before, after.format(word))
                continue
            add(label, "method", 60, 0.8, word, f"({name}) ", word)
            add(label, "method", 70, 0.9, word, "", f"{word} ({name})")
    for label, anchor, before, head, versions in NAMED:
        for v in versions:
            add(f"{label}-{v.replace(' ', '.')}", "method", 65, 0.85, anchor, before,
                f"{head}( (version|v))? ?{v}( 0)?( only| or( any)? later( version)?)?")
        add(label, "method", 40, 0.7, anchor, before, head)
    for part, words, long in CC_PARTS:
        for v in CC_VERSIONS:
            add(f"cc-{part}-{v.replace(' ', '.')}", "method", 75, 0.95, "cc", "", f"cc {words} {v}")
            add(f"cc-{part}-{v.replace(' ', '.')}", "method", 75, 0.95, "creative", "", f"creative commons {long} {v}( international| unported| generic)?")
        add(f"cc-{part}", "method", 50, 0.85, "cc", "", f"cc {words}")
        add(f"cc-{part}", "method", 50, 0.85, "creative", "", f"creative commons {long}")
    for label, anchor, before, after in NOTICES:
        add(label, "method", 30, 0.6, anchor, before, after)
    for label, name, versions in GNU_NOTICES:
        for v in versions:
            add(f"{label}-{v.replace(' ', '.')}", "method", 85, 0.95, "foundation", f"(gnu )?{name}general public licen[cs]e as published by the free software ",
                f"foundation( either)? version {v}( 0)? of the licen[cs]e( or( at your option)? any later version)?")
    for family, part, anchor, before, after in TEXTS:
        add(f"{family}:{part}", "head" if part == "head" else "clause", 85, 0.9, anchor, before, after)
    return out


def check_rules(table: list[tuple]) -> None:
    """Refuse rules that may be longer than a window.  Every blank of a pattern
    counts; blanks and groups may not repeat."""
    for rule, _, _, _, _, _, before, after in table:
        if re.search(r"[ ).\]][*+{]", re.sub(r"\[0-9\]\{\d\}", "", before + after)):
            raise ValueError(f"rule {rule}: words may not repeat without a bound")
        if max(before.count(" "), after.count(" ")) >= REACH:
            raise ValueError(f"rule {rule}: longer than a window of {REACH} words")
        if before and not before.endswith(" "):
            raise ValueError(f"rule {rule}: words before the anchor end with a blank")


def window_gates(table: list[tuple]) -> dict[str, str]:
    """By anchor word, the pattern over ``before#after`` that holds where any of its rules matches."""
    out = {}
    for word in anchors(table):
        mine = [(r[6], r[7]) for r in table if r[5] == word]
        framed = [f"(?:{b})#(?:{a}) " for b, a in mine if b]
        plain = [f"(?:{a}) " for b, a in mine if not b]
        out[word] = "|".join([f"(?<![^ ])(?:{'|'.join(framed)})"] * bool(framed) + [f"#(?:{'|'.join(plain)})"] * bool(plain))
    return out


def anchors(table: list[tuple]) -> list[str]:
    return sorted({r[5] for r in table})


_SEP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"      # before lower-casing


def _one_spaced(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, _SEP, " "))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", table: list[tuple] | None = None) -> tuple[DataFrame, DataFrame]:
    """``(rows, found)``: rows ``row, doc_id, n_words`` for every document, and
    detections ``row, rule, label, kind, priority, confidence, first, end``
    (words from 0, end exclusive) before suppression."""
    table = table or rules()
    check_rules(table)
    spark = docs.sparkSession
    words = anchors(table)
    gate = "(?i)" + "|".join(anchors([r for r in table if r[2] != "clause"]))
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    one = _one_spaced(F.col("text"))
    n_words = (F.octet_length(one) - F.octet_length(F.replace(one, F.lit(" "), F.lit(""))) + F.when(one == "", 0).otherwise(1)).cast("long")
    w = F.split(F.translate(one, UPPER, LOWER), " ")
    at = F.filter(F.transform(F.col("w"), lambda x, i: F.when(x.isin(words), i)), lambda i: i.isNotNull())
    near = F.transform("at", lambda i: F.struct(
        i.alias("i"), F.get("w", i).alias("anchor"),
        F.concat(F.array_join(F.slice("w", F.greatest(i - REACH, F.lit(0)) + 1, F.least(i, F.lit(REACH))), " "), F.lit(" ")).alias("before"),
        F.concat(F.array_join(F.slice("w", i + 1, REACH), " "), F.lit(" ")).alias("after")))
    rows = rows.select("doc_id", n_words.alias("n_words"), F.when(F.col("text").rlike(gate), w).alias("w"))


    def hit(x: Column) -> Column:
        window, out = F.concat(x["before"], F.lit("#"), x["after"]), F
        for word, pattern in window_gates(table).items():
            out = out.when(x["anchor"] == word, window.rlike(pattern))
        return out

    rows = rows.withColumn("at", at).select("doc_id", "n_words", F.filter(near, hit).alias("near"))
    rows = cut(rows.withColumn("row", F.monotonically_increasing_id()))
    near = rows.select("row", F.explode("near").alias("x")).select("row", "x.*")
    names = [c.split()[0] for c in RULE_SCHEMA.split(", ")]
    as_json = F.lit(json.dumps([dict(zip(names, t, strict=True)) for t in table]))
    r = F.broadcast(spark.range(1).select(F.inline(F.from_json(as_json, f"array<struct<{RULE_SCHEMA.replace(' ', ':').replace(',:', ',')}>>"))))
    hit_b = F.regexp_substr("before", F.concat(F.lit("(?<![^ ])("), F.col("r_before"), F.lit(")$")))
    hit_a = F.regexp_substr("after", F.concat(F.lit("^("), F.col("r_after"), F.lit(") ")))
    spaces = lambda s: F.octet_length(s) - F.octet_length(F.replace(s, F.lit(" "), F.lit("")))
    r = r.withColumnRenamed("before", "r_before").withColumnRenamed("after", "r_after")
    found = (near.join(r, "anchor").withColumn("a", hit_a).filter("a is not null").withColumn("b", hit_b)
             .filter("r_before = '' or b is not null").withColumn("b", F.coalesce("b", F.lit("")))
             .select("row", "rule", "label", "kind", "priority", "confidence",
                     (F.col("i") - spaces(F.col("b"))).cast("long").alias("first"),
                     (F.col("i") + spaces(F.col("a"))).cast("long").alias("end")))
    return rows.select("row", "doc_id", "n_words"), found


def with_texts(found: DataFrame) -> DataFrame:
    """``found`` with headers and clauses of license texts replaced by one
    detection per header, at the header's words."""
    part = F.split("label", ":")
    order = Window.partitionBy("row").orderBy("first", F.desc("end"), "rule")
    parts = (found.filter("kind in ('head', 'clause')").withColumn("family", part[0]).withColumn("part", part[1])
             .withColumn("head", F.last(F.when(F.col("kind") == "head", F.struct("rule", "family", "priority", "confidence", "first", "end")),
                                        ignorenulls=True).over(order))
             .filter(f"head.family = family and first - head.first <= {SCOPE}"))
    heads = parts.groupBy("row", "head").agg(F.collect_set("part").alias("parts"))
    label = F
    for family, clause, name in TEXT_LABELS:
        label = label.when((F.col("head.family") == family) & F.array_contains("parts", clause or "head"), name)
    texts = heads.select("row", "head.rule", label.alias("label"), F.lit("method").alias("kind"), "head.priority", "head.confidence", "head.first", "head.end")
    return found.filter("kind in ('base', 'method')").unionByName(texts)


def suppress(found: DataFrame) -> DataFrame:
    """Detections that lie in no other one; of equal intervals the one of the
    highest priority (then confidence, then rule order).  A running maximum of
    ends over a document's detections, longest first at each start, tells."""
    order = Window.partitionBy("row").orderBy("first", F.desc("end"), F.desc("priority"), F.desc("confidence"), "rule")
    ends = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return found.withColumn("_e", ends).filter("_e is null or _e < end").drop("_e")


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", table: list[tuple] | None = None) -> DataFrame:
    """One row per document: ``doc_id, n_words, n_base, first_word, last_word,
    base_labels, labels, score, n_detections``; score is the highest confidence
    of the detections that stay."""
    rows, found = scan(docs, id_col, text_col, table)
    found = with_texts(cut(found))
    names = lambda c: F.array_join(F.sort_array(F.collect_set(c)), ",")
    base = found.filter("kind = 'base'").groupBy("row").agg(
        F.count(F.lit(1)).alias("n_base"), F.min("first").alias("first_word"), F.max("first").alias("last_word"), names("label").alias("base_labels"))
    kept = suppress(found)
    every = (kept.select("row", "label", "confidence").unionByName(found.filter("kind = 'base'").select("row", "label", "confidence"))
             .groupBy("row").agg(names("label").alias("labels"), F.max("confidence").alias("score")))
    n = kept.groupBy("row").agg(F.count(F.lit(1)).alias("n_detections"))
    out = rows.join(base, "row", "left").join(every, "row", "left").join(n, "row", "left")
    zero = F.lit(0).cast("long")
    return out.select("doc_id", "n_words", F.coalesce("n_base", zero).alias("n_base"), "first_word", "last_word",
                      F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
                      F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("n_detections", zero).alias("n_detections"))
