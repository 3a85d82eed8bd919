"""License rules against a plain matcher, license texts, and words of other languages."""

import random
import re

import pytest

from scorewise.llm import license_scan as L

BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted. Redistributions in binary form must reproduce the above notice. "
NAMES = "Neither the name of the owner nor the names of its contributors may be used to endorse or promote products. "
MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software. "
MIT_NOTICE = "The above copyright notice and this permission notice shall be included. "
ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
GNU = "the GNU {}General Public License as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version."


def labels(spark, texts):
    t = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r["labels"] for r in L.scan_licenses(t).orderBy("doc_id").collect()]


def test_license_texts_of_one_family_are_told_apart(spark):
    texts = {BSD: "bsd-2", BSD + NAMES: "bsd-3", BSD + "All advertising materials mentioning features of it. " + NAMES: "bsd-4",
             "Redistribution and use in source and binary forms": "bsd",
             MIT + MIT_NOTICE: "mit", MIT + "limited to the warranties of MERCHANTABILITY": "mit-0", MIT + MIT_NOTICE + "Except as contained in this notice": "x11",
             ISC + ", provided that the above copyright notice appears.": "isc", ISC + ". THE AUTHOR DISCLAIMS ALL WARRANTIES": "bsd-0",
             GNU.format("", 2): "gpl-2", GNU.format("Lesser ", "2.1"): "lgpl-2.1", GNU.format("Affero ", 3): "agpl-3",
             BSD + MIT + MIT_NOTICE: "bsd-2,mit", BSD + "word " * 500 + NAMES: "bsd-2", NAMES: "", BSD + NAMES + BSD: "bsd-2,bsd-3"}
    assert labels(spark, texts) == list(texts.values())


def test_mit_needs_an_english_frame(spark):
    texts = {"license mit dem Bus": "", "my mit license plate": "", "the MIT license plate": "", "fahr mit license weiter": "",
             "The MIT License": "mit", "MIT License\n\nCopyright (c) 2020 X": "copyright-notice,mit", "License: MIT": "mit", "available under MIT": "mit",
             "under the MIT license plate": "mit"}           # the base phrase stays whatever follows
    assert labels(spark, texts) == list(texts.values())


def plain_scan(text):
    """Every rule at every place over the whole text, suppression by pairs."""
    words = re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    found = []
    for rule, label, kind, priority, confidence, anchor, before, after in L.rules():
        for i, w in enumerate(words):
            if w != anchor:
                continue
            a = re.match(f"(?:{after}) ", " ".join(words[i:]) + " ")
            b = re.search(f"(?<![^ ])(?:{before})$", " ".join(words[:i]) + " ") if before else None
            if a and (b or not before):
                found.append((i - (b[0].count(" ") if b else 0), i + a[0].count(" "), priority, confidence, rule, label, kind))
    heads = sorted(f for f in found if f[6] == "head")
    texts = []
    for n, h in enumerate(heads):
        until = heads[n + 1][0] if n + 1 < len(heads) else len(words)
        family = h[5].split(":")[0]
        parts = {f[5].split(":")[1] for f in found if f[6] == "clause" and f[5].split(":")[0] == family and h[0] < f[0] < until and f[0] - h[0] <= L.SCOPE}
        texts.append((*h[:5], next(name for fam, c, name in L.TEXT_LABELS if fam == family and (not c or c in parts)), "method"))
    found = [f for f in found if f[6] in ("base", "method")] + texts
    beats = lambda g, f: (g[0] <= f[0] and g[1] >= f[1]) and ((g[0], g[1]) != (f[0], f[1]) or (-g[2], -g[3], g[4]) < (-f[2], -f[3], f[4]))
    kept = [f for f in found if not any(beats(g, f) for g in found)]
    base = [f for f in found if f[6] == "base"]
    every = kept + base
    first = [f[0] for f in base]
    return (len(words), len(base), min(first, default=None), max(first, default=None), ",".join(sorted({f[5] for f in base})),
            ",".join(sorted({f[5] for f in every})), max((f[3] for f in every), default=0.0), len(kept))


def test_equals_a_plain_matcher(spark):
    rng = random.Random(3)
    pieces = [BSD, NAMES, MIT, MIT_NOTICE, ISC, GNU.format("", 3), GNU.format("Library ", 2), "under the MIT license", "Apache License, Version 2.0", "CC BY-NC-SA 4.0",
              "SPDX-License-Identifier: MPL-2.0", "licensed under the terms of the BSD 3-clause license", "Mozilla Public License v2.0", "all rights reserved",
              "Copyright (c) 2019", "license", "mit", "the", "under", "gpl", "version 2", "or later", "provided that the above copyright notice", "creative commons attribution 4.0",
              "except as contained in this notice", "general public licence", "é", "Wort", "GNU", "cc by nc", "license mit", "eclipse public license 2"]
    texts = [None, "", "...", "under the mit license " * 400] + [" ".join(rng.choice(pieces) for _ in range(rng.randint(1, 25))) for _ in range(80)]
    t = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [tuple(r)[1:] for r in L.scan_licenses(t).orderBy("doc_id").collect()]
    assert got == [plain_scan(x or "") for x in texts]


def test_rules_longer_than_a_window_are_refused(spark):
    t = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    for before, after in [("", "word" + " word" * L.REACH), ("", "word( word)+"), ("", "word( word){2}"), ("no blank", "word")]:
        with pytest.raises(ValueError):
            L.scan_licenses(t, table=[("r0", "x", "method", 1, 1.0, "word", before, after)])
