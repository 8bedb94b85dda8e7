"""Licences, chat formatting, decontamination, and the pipeline."""

import glob
import os

import duckdb
import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from listinglens.llm import chat, decontam, licenses
from listinglens.llm import queries as K


@pytest.mark.parametrize("name", sorted(K.oracle_sql()))
def test_agrees_with_sql(spark, sf, name):
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    ours, theirs = K.queries()[name](spark, sf).toPandas(), con.execute(K.oracle_sql()[name]).df()
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    a, b = (x[columns].sort_values(columns).reset_index(drop=True).astype(object) for x in (ours, theirs))
    pd.testing.assert_frame_equal(a, b)


def test_licences(spark):
    mit = licenses.TEMPLATES[2][1]
    rows = [(1, f"text\n{mit.upper()}\nmore"), (2, "nothing here"), (3, None), (4, ""), (5, "Licensed under CC BY-NC 4.0"), (5, "Licensed under CC BY-NC 4.0"), (6, "word " * 40_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS license", "1.0 AS dice")
    found = sorted((r.doc_id, r.license) for r in licenses.scan(docs).collect())
    assert found == [(1, "MIT"), (5, "CC-BY-NC-4.0"), (5, "CC-BY-NC-4.0")]
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_size_bounds_lose_nothing():
    wide = licenses.Matcher()
    wide.low, wide.high = 0, 10**9
    rng = np.random.default_rng(2)
    for name, text in licenses.TEMPLATES:
        words = text.split()
        for _ in range(40):
            unit = " ".join(w for w in words if rng.random() > 0.1)
            assert licenses.Matcher().match(unit) == wide.match(unit), name


def test_whole_licences_are_found():
    matcher = licenses.Matcher()
    prose = "a house by the river. the people of the town met there. "
    for name, text in licenses.whole_texts():
        for body in (text, " ".join(text.split()), "\n".join("# " + x for x in text.split("\n"))):
            assert matcher.match(prose * 30 + "\n" + body + "\n" + prose * 30)[name] > 0.9, name
    first = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"
    full = first + ", including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
    assert matcher.match(full)["MIT"] == 1.0
    header = 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'
    assert "Apache-2.0" in matcher.match(prose + header + ". " + prose)
    assert matcher.match(prose * 500) == {}


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from("abcdefgh"), max_size=40), st.lists(st.sampled_from("abcdefgh"), min_size=2, max_size=9))
def test_best_run_against_every_run(words, template):
    given_pairs = licenses.bigrams(" ".join(template))
    best = 0.0
    for i in range(len(words)):
        for j in range(i + 2, len(words) + 1):
            pairs = licenses.bigrams(" ".join(words[i:j]))
            best = max(best, 2 * len(pairs & given_pairs) / (len(pairs) + len(given_pairs)))
    found = licenses.Matcher([("x", " ".join(template))], 0.5).match(" ".join(words))
    assert found == ({"x": pytest.approx(best)} if best >= 0.5 else {})


def test_versions_and_inline_notices():
    texts = dict(licenses.whole_texts()[: len(licenses.BODIES) + 1])
    matcher = licenses.Matcher()
    header = {name: next(t for n, t in licenses.whole_texts()[len(texts) :] if n == name) for name in ("GPL-2.0", "GPL-3.0", "LGPL-3.0", "AGPL-3.0")}
    for name, text in header.items():
        assert matcher.match(f"Notes of the day. {text} Thanks.") == {name: 1.0}
    assert set(matcher.match(texts["BSD-2-Clause"])) == {"BSD-2-Clause"}
    assert set(matcher.match(texts["BSD-3-Clause"])) == {"BSD-3-Clause"}
    assert set(matcher.match(texts["GPL-2.0"])) == {"GPL-2.0"}
    assert matcher.match("The code of the tool, released\nunder the MIT License since May, is small.") == {"MIT": 1.0}
    both = f"{header['GPL-2.0']} and other parts are {licenses.TEMPLATES[2][1]}"
    assert matcher.match(both) == {"GPL-2.0": 1.0, "MIT": 1.0}


@pytest.mark.parametrize(
    ("text", "licence"),
    [
        ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "ISC"),
        ("// SPDX-License-Identifier: GPL-2.0-only", "GPL-2.0"),
        ("# SPDX-License-Identifier: BSD-2-Clause", "BSD-2-Clause"),
        ("The code is licensed under Apache 2.0 and the rest is not", "Apache-2.0"),
        ("This work is licensed under a Creative Commons Attribution 4.0 International License.", "CC-BY-4.0"),
        ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "CC-BY-SA-4.0"),
        ("This is free and unencumbered software released into the public domain.", "Unlicense"),
        ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.", "GPL-2.0"),
        ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "AGPL-3.0"),
        ("SPDX-License-Identifier: LicenseRef-own", None),
    ],
)
def test_notices_in_use(text, licence):
    assert set(licenses.Matcher().match(f"some words before it\n{text}\nand some after")) == ({licence} if licence else set())


def test_licence_rows_without_ids(spark):
    text = licenses.TEMPLATES[2][1]
    docs = spark.createDataFrame([(None, text), (2**53 + 1, text), (None, None)], "doc_id long, text string")
    found = [(r.doc_id, r.license) for r in licenses.scan(docs.coalesce(1)).collect()]
    assert found == [(None, "MIT"), (2**53 + 1, "MIT")]
    long = "the licence of the work and of the parts of it " * 200_000 + text
    assert licenses.Matcher().match(long) == {"MIT": 1.0}


def test_preferences(spark):
    rows = [
        (0, "chosen", 0, "user", "hi"), (0, "chosen", 1, "assistant", "yes"), (0, "chosen", 2, "user", "ok"),
        (0, "rejected", 0, "user", "hi"), (0, "rejected", 1, "assistant", "no"), (0, "rejected", 1, "assistant", "no"),
        (1, "chosen", 0, "user", "alone"), (2, "chosen", 0, "user", "same"), (2, "rejected", 0, "user", "same"),
        (3, "chosen", 0, None, None), (3, "rejected", 5, "assistant", "late"), (None, "chosen", 0, "user", "x"),
    ]
    out = {r.pair_id: r for r in chat.format_preferences(spark.createDataFrame(rows, "pair_id long, side string, turn long, role string, text string")).collect()}
    assert sorted(out) == [0, 2, 3]
    first = out[0]
    assert (first.n_prompt_turns, first.prompt) == (1, "<|user|>\nhi\n<|end|>\n")
    assert first.chosen == "<|assistant|>\nyes\n<|end|>\n<|user|>\nok\n<|end|>\n"
    a, b = map(int, first.chosen_mask.split("-"))
    assert first.chosen[a:b] == "yes"
    c, d = map(int, first.rejected_mask.split("-"))
    assert first.rejected[c:d] == "no"
    assert (out[2].n_prompt_turns, out[2].chosen, out[2].rejected, out[2].chosen_mask) == (1, "", "", "")
    assert out[3].n_prompt_turns == 0
    assert chat.format_preferences(spark.createDataFrame([], "pair_id long, side string, turn long, role string, text string")).count() == 0


def test_masks_of_long_conversations(spark):
    rows = [(0, side, i, "assistant" if i % 2 else "user", f"{side if i > 5 else ''} turn {i}") for side in ("chosen", "rejected") for i in range(20_000)]
    turns = spark.createDataFrame(pd.DataFrame(rows, columns=["pair_id", "side", "turn", "role", "text"]))
    r = chat.format_preferences(turns.repartition(4)).first()
    assert r.n_prompt_turns == 6
    for text, mask, side in ((r.chosen, r.chosen_mask, "chosen"), (r.rejected, r.rejected_mask, "rejected")):
        spans = [text[a:b] for a, b in (map(int, m.split("-")) for m in mask.split(","))]
        assert spans == [f"{side} turn {i}" for i in range(7, 20_000, 2)]


def test_turns_with_clashing_columns(spark):
    rows = [(0, "chosen", 0, "user", "a", 1), (0, "rejected", 0, "user", "b", 2), (0, "rejected", None, "user", "b", 2), (0, None, 0, "user", "b", 2)]
    turns = spark.createDataFrame(rows, "pair_id long, side string, turn long, role string, text string, split int").withColumn("c_at", F.lit(1)).withColumn("turns", F.lit(2))
    assert [(r.prompt, r.n_prompt_turns) for r in chat.format_preferences(turns).collect()] == [("", 0)]


def test_chat_is_native(spark, sf):
    import re

    plan = K.op3_chat_preferences(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def plain_distance(item, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item):
        new = [i + 1]
        for j, b in enumerate(text):
            new.append(min(row[j] + (a != b), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


PASSAGE = "the quick brown fox jumps over the lazy dog and runs through the dark wet forest until night falls on the hill"


@settings(max_examples=60, deadline=None)
@given(st.data())
def test_search_finds_what_the_edit_budget_allows(data):
    chars = list(PASSAGE)
    budget = decontam.edit_budget(len(PASSAGE))
    for _ in range(data.draw(st.integers(0, budget + 4))):
        at = data.draw(st.integers(0, len(chars) - 1))
        kind = data.draw(st.sampled_from(["drop", "add", "change"]))
        if kind == "drop":
            del chars[at]
        elif kind == "add":
            chars.insert(at, "q")
        else:
            chars[at] = "x"
    text = "alpha beta gamma " + "".join(chars) + " delta epsilon"
    check_search(text)


def check_search(text):
    """The search folds runs of blanks to one, so the distance is that of the folded text."""
    best = plain_distance(PASSAGE, " ".join(text.split()))
    rows = list(decontam.search(decontam.Passages([7], [PASSAGE]), ["no match here", text]))
    assert bool(rows) == (best <= decontam.edit_budget(len(PASSAGE)))
    if rows:
        assert rows[0][0] == 1 and rows[0][4] == best


def test_search_where_a_cut_leaves_two_blanks():
    check_search("alpha beta gamma " + PASSAGE[9:] + " delta epsilon")


def test_leak_query(spark, sf):
    fold = lambda t: " ".join("".join(c.lower() if c.isalnum() else " " for c in t).split())
    items = {r.item_id: fold(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    texts = {r.doc_id: fold(r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    whole = {(d, i) for d, t in texts.items() for i, x in items.items() if x in t}
    found = {(r.doc_id, r.item_id): r.edits for r in K.op9_decontamination(spark, sf).collect()}
    assert whole <= set(found)
    for (d, i), edits in found.items():
        if (d, i) not in whole:
            assert plain_distance(items[i], texts[d]) == edits <= decontam.edit_budget(len(items[i]))


def test_leaks_in_odd_rows(spark):
    benchmark = spark.createDataFrame([(1, PASSAGE), (2, None), (3, ""), (4, "abc"), (5, PASSAGE)], "item_id long, text string")
    rows = [(1, None), (2, ""), (3, PASSAGE.upper().replace(" ", " -- ")), (3, PASSAGE.upper()), (4, "x abc y"), (5, "xabcy"), (6, "a\0b" * 20_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted((r.doc_id, r.item_id) for r in decontam.find_leaks(docs, benchmark).collect())
    assert found == [(3, 1), (3, 1), (3, 5), (3, 5), (4, 4)]
    kept = decontam.without_leaks(docs.withColumnRenamed("doc_id", "edits").withColumnsRenamed({"edits": "doc_id"}), benchmark)
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 5, 6]
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.find_leaks(docs, none).count() == 0
    assert decontam.without_leaks(docs, none).count() == 7
    assert decontam.find_leaks(spark.createDataFrame([], "doc_id long, text string"), benchmark).count() == 0


def test_blocks_of_passages(spark):
    benchmark = spark.createDataFrame([(i, f"passage number {i} of the list of passages") for i in range(7)], "item_id long, text string")
    assert [len(b.value.items) for b in decontam.blocks(benchmark, most=100)] == [2, 2, 2, 1]


def test_leaks_without_ids(spark):
    benchmark = spark.createDataFrame([(None, PASSAGE), (7, PASSAGE)], "item_id long, text string").withColumn("doc_id", F.lit("x"))
    docs = spark.createDataFrame([(None, PASSAGE, 1), (2**53 + 1, PASSAGE, 2), (3, "no " * 400_000 + PASSAGE, 3)], "doc_id long, text string, item_id int")
    found = {(r.doc_id, r.item_id) for r in decontam.find_leaks(docs.coalesce(1), benchmark).collect()}
    assert found == {(d, i) for d in (None, 2**53 + 1, 3) for i in (None, 7)}
    kept = decontam.without_leaks(docs.union(spark.createDataFrame([(None, None, None)], docs.schema)), benchmark)
    assert kept.columns == docs.columns and [tuple(r) for r in kept.collect()] == [(None, None, None)]


def test_pipeline(spark, sf):
    import corpus_pipeline as C

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = docs.columns
    before = docs.count()
    for _, stage in C.STAGES[:3]:
        docs = C.stage_table(stage(spark, docs, sf), "t")
        assert docs.columns == names
        assert 0 < docs.count() <= before
        before = docs.count()
    leaks = {r.doc_id for r in K.op9_decontamination(spark, sf).collect()}
    assert not leaks & {r.doc_id for r in docs.collect()}
    clean = C.stage_table(C.STAGES[3][1](spark, docs, sf), "t")
    assert clean.columns == names and clean.count() == before
    packed = C.run(spark, sf)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in clean.collect()}
