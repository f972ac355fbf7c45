"""The licence scan against plain Python, and that it stays in DataFrame functions."""

import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from laborlens.llm import licenses
from laborlens.llm.queries import op12_license_scan

MIT = ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and"
       ' associated documentation files (the "Software"), to deal in the Software without restriction')
BSD = ("Redistribution and use in source and binary forms, with or without modification, are permitted"
       " provided that the following conditions are met:")
GPL = ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU"
       " General Public License as published by the Free Software Foundation")


def frame(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("row", "key", "hits", "words", "n_words", "notice", "start", "w", "base", "finds", "rare"):
        docs = docs.withColumn(name, F.lit("x"))
    return docs


def plain_scan(rows):
    """(doc_id, n_words, {phrase label: starts}, {label: best score}) by the definitions."""
    texts = [(i, re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")))
             for i, t in rows]
    number = {w: k for k, w in enumerate(licenses.vocabulary())}
    postings = defaultdict(list)
    for w, notice, place in licenses.index():
        postings[w].append((notice, place))
    having = Counter(w for _, words in texts for w in {number[x] for x in words if x in number})

    def places(words, phrase):
        wanted = phrase.split()
        return [k for k in range(len(words)) if words[k:k + len(wanted)] == wanted]

    out = []
    for i, words in texts:
        own = sorted({number[x] for x in words if number.get(x) in postings}, key=lambda w: (having[w], w))
        own = own[:licenses.LOOKED_UP]
        asked = Counter(n for w in own for n in {n for n, _ in postings[w]})
        agree = defaultdict(set)
        for p, x in enumerate(words):
            if number.get(x) in own:
                for notice, place in postings[number[x]]:
                    agree[notice, p - place].add(x)
        finds = {}
        for (notice, start), some in agree.items():
            label, phrase, _ = licenses.NOTICES[notice]
            if len(some) >= licenses.LEAST_AGREE and 2 * len(some) >= asked[notice] and any(
                    abs(p - start - licenses._anchor(notice)) <= licenses.SLACK for p in places(words, phrase)):
                finds[label] = max(finds.get(label, 0), len(some) / asked[notice])
        base = {label: places(words, phrase) for phrase, label in licenses.BASE.items()}
        out.append((i, len(words), base, finds))
    return out


def scanned(spark, rows):
    return [(r["doc_id"], r["n_words"], {b["label"]: b["starts"] for b in r["base"]},
             {f["label"]: f["score"] for f in r["finds"]}) for r in licenses.scan(frame(spark, rows)).collect()]


def ordered(rows):
    return sorted(rows, key=repr)


def test_scan_like_plain_python(spark):
    rng = random.Random(4)
    notices = [text for _, _, text in licenses.NOTICES] + [MIT, BSD, GPL]
    filler = sorted({w for n in notices for w in n.lower().split()}) + ["lorem", "ipsum", "straße", "中文"]
    rows = []
    for k in range(150):
        words = rng.choices(filler, k=rng.randrange(60))
        for _ in range(rng.randrange(3)):
            notice = rng.choice(notices).split()
            if rng.random() < 0.4:  # a word goes missing or is changed
                notice[rng.randrange(len(notice))] = rng.choice(filler)
            at = rng.randrange(len(words) + 1)
            words[at:at] = notice
        rows.append((k, rng.choice([" ", "\n", " - ", "\x00"]).join(words)))
    rows += [(7, None), (7, ""), (None, "MIT License"), rows[0], rows[0]]
    got, wanted = scanned(spark, rows), plain_scan(rows)
    assert ordered(got) == ordered(wanted)
    assert sum(len(r[3]) for r in wanted) > 50


def test_notices_and_what_is_none(spark):
    rows = [(1, MIT), (2, BSD), (3, "# " + GPL.upper()), (4, "Licensed under CC BY-NC 4.0."),
            (5, "er kam mit license und ging"), (6, "the mit licence of general public interest"),
            (7, "Released under the MIT License." + " apache  LICENSE" * 2), (8, "work K mIt license")]
    got = {r[0]: ({k: v for k, v in r[2].items() if v}, set(r[3])) for r in scanned(spark, rows)}
    assert got == {
        1: ({}, {"mit"}), 2: ({}, {"bsd"}), 3: ({"gpl": [19]}, {"gpl"}), 4: ({}, {"cc-by-nc"}),
        5: ({"mit": [2]}, {"mit"}), 6: ({}, set()), 7: ({"mit": [3], "apache": [5, 7]}, {"apache", "mit"}), 8: ({}, set())}


def test_long_text_and_empty_table(spark):
    text = "word " * 300_000 + MIT + " license" * 20_000 + " mit license"
    (row,) = scanned(spark, [(1, text)])
    assert row[1] == 300_000 + len(re.findall(r"\w+", MIT)) + 20_000 + 2
    assert row[2]["mit"] == [row[1] - 2] and "mit" in row[3]
    assert scanned(spark, []) == []


def test_no_python_runs(spark):
    plan = op12_license_scan(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
