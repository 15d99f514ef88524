from __future__ import annotations

import re

from quillstone.llm import licenses, q_licenses
from tests.llm.rows import ODD, table
from tests.oracle import assert_same

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

TEXTS = [
    "MIT License mit-license MIT  LICENSE, mit licensed",
    "cc by cc by cc-by CC BY-SA by cc",
    "gnu general public license apache license",
    "xgnu general public license\nGNU General\nPublic License v3",
    "Licensed under CC BY-NC 4.0",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the",
    "Permission is hereby granted, free of cost, to some person obtaining a copy of that software",
    "filler " * 200 + "this is free and unencumbered software released into the public domain " + "filler " * 90,
    "released under a great many conditions, under the sun, mit der license",
    "All rights reserved.",
    "é mit license 😀 mit license",
]


def brute(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(WORD, low)
    places = [(k, label) for phrase, label in licenses.PHRASES.items() for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split()]
    found, best = set(), 0.0
    for label, template in licenses.TEMPLATES:
        t, c = set(template.split()), 8
        while c < len(template.split()):
            c *= 2
        for start in range(0, max(1, len(words) - c), c):
            block = t & set(words[start : start + 2 * c])
            if len(block) >= 0.9 * len(t) - 1e-9:
                found.add(label)
                best = max(best, len(block) / len(t))
    at = [k for k, _ in places]
    return len(words), len(places), min(at, default=None), max(at, default=None), sorted({x for _, x in places}), sorted(found), 1.0 if places else best


def test_by_brute_force(spark):
    texts = [*ODD, *TEXTS]
    rows = {r["doc_id"]: r for r in licenses.scan(table(spark, texts)).collect()}
    assert len(rows) == len(texts)
    for k, text in enumerate(texts):
        assert tuple(rows[k])[1:] == brute(text), text and text[:60]


MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal"
BSD = " * Redistribution and use in source and binary forms, with or without\r\n * modification, are permitted provided that the following conditions\r\n * are met:"
GPL = "# This program is free software: you can redistribute it and/or modify\n#\n# it under the terms of the GNU General Public License as published by"
SHORT = "Licensed\nunder the\n\nApache License"
LONG_MIT = "\n".join(re.findall(r"(?:\S+ ?){1,9}", max((t for x, t in licenses.TEMPLATES if x == "mit"), key=len)))
SCATTERED = "all " + "x " * 25 + "rights " + "y " * 25 + "reserved"  # no license: its words are far apart


def test_wrapped_headers(spark):
    filler = "plain words of a file\n" * 40
    cases = [(MIT, "mit"), (BSD, "bsd"), (GPL, "gpl"), (SHORT, "apache"), (LONG_MIT, "mit"), (SCATTERED, None)]
    texts = [before + text + after for text, _ in cases for before, after in (("", ""), (filler, "\n" + filler))]
    rows = {r["doc_id"]: r for r in licenses.scan(table(spark, texts)).collect()}
    for k, text in enumerate(texts):
        label = cases[k // 2][1]
        assert (label in rows[k]["method_labels"] and rows[k]["score"] >= licenses.CONTAINMENT) if label else not rows[k]["method_labels"], text[:80]
        assert tuple(rows[k])[1:] == brute(text), text[:80]


def test_a_run_as_long_as_its_span_lies_in_a_block(spark):
    """Wherever it starts and is broken, every template is found whole."""
    texts = []
    for k, (_, template) in enumerate(licenses.TEMPLATES):
        own = template.split()
        for before in (0, 1, 7 + k, 8, 63, 100):
            cut = 1 + before % (len(own) - 1)
            texts.append("w\n" * before + " ".join(own[:cut]) + "\n" + " ".join(own[cut:]) + "\nw" * 70)
    rows = {r["doc_id"]: r for r in licenses.scan(table(spark, texts)).collect()}
    assert all(r["score"] == 1.0 and licenses.TEMPLATES[k // 6][0] in r["method_labels"] for k, r in rows.items())


def test_repeated_rows_and_empty(spark):
    rows = licenses.scan(table(spark, ["mit license", "mit license", None], [1, 1, None])).collect()
    assert sorted(r["n_base"] for r in rows) == [0, 1, 1]
    assert licenses.scan(table(spark, [])).count() == 0


def test_other_templates(spark):
    rows = {r["doc_id"]: r["method_labels"] for r in licenses.scan(table(spark, ["one two three four", "one two"]), templates=[("x", "four three two one")]).collect()}
    assert rows == {0: ["x"], 1: []}


def test_query(spark, data):
    assert_same(q_licenses.op10_license_scan(spark, data), q_licenses.oracle(), data)
