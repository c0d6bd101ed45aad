"""Licence scans: a trained paragraph classifier whose finds are confirmed against templates, in DataFrame operations.

A notice may be one line or wrapped over several. Consecutive lines that are neither blank nor mere markup form a
paragraph (comment signs at their ends do not count). Scored are every line, every paragraph, and from every line of a
paragraph the lines that follow it up to half, one and two times the longest template, so that a wrapped notice is also
found amid other text. Its features are the words and word pairs it has in common with the model's sparse vocabulary
(numbers count as ``#``). Multinomial logistic regression with an L1 penalty, trained on the driver from the templates
below with words dropped and foreign words added, from notices of licences of no family here, and from sentences that are
no licence, gives a probability for each family and for ``unknown``; a temperature fitted on examples kept out of
training, among them whole licences that training never saw, calibrates it. A family is confirmed if it wins and the
paragraph holds enough of one of its templates' features, and enough of those that no other family has.

The first pass looks for the words of ``needles``, derived from the templates: whatever holds ``confirm`` of a
template's features has one of them. What it keeps is scored once for each distinct text, and the scores are joined back
(by shuffle; a hot paragraph is split at run time).

Reported are lines with a cue word, confirmed lines, and confirmed runs of lines in which no line is confirmed for that
family: of runs that overlap, the one with the greatest share, then the shortest, then the most probable. Lines within a
reported run are not reported by themselves unless confirmed, and what is confirmed within a run that holds a greater share of
another family's template is a fragment of that.

Edge cases: null and empty texts have no paragraphs; repeated rows are each reported; ties between families go to the
first in alphabetical order; extra columns are not read; very long lines are scored like any other; an empty table gives
an empty result.
"""

from __future__ import annotations

import json
import random
import re
from dataclasses import dataclass
from functools import lru_cache, reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Short notices of well-known licences, by family, in our words or as commonly written in file headers.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "AGPL": ("Licensed under the GNU Affero General Public License, version 3.", "This program is free software under the terms of the GNU Affero General Public License as published by the Free Software Foundation."),
    "Apache": ("Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    "BSD": ("Distributed under the BSD license.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.", "Use of this source code is governed by a BSD-style license."),
    "CC-BY": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-NC": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-SA": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC0": ("Released under CC0 1.0 Universal.", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
    "GPL": ("This work is licensed under the GNU General Public License, version 3.", "This program is free software; you can redistribute it and modify it under the terms of the GNU General Public License.", "Licensed under the GPL."),
    "ISC": ("Released under the ISC License.", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted."),
    "LGPL": ("Licensed under the GNU Lesser General Public License, version 2.1.", "This library is free software under the terms of the GNU Lesser General Public License."),
    "MIT": ("Released under the MIT License.", "Licensed under the MIT license.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."),
    "MPL": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License."),
}
UNKNOWN = "unknown"
ORDINARY = (
    "The driver was asked to show a license and the registration.", "All rights reserved.", "Your permission is needed before we publish the picture.", "The warranty covers parts for two years.",
    "He moved to the country and free software was the least of it.", "Copyright law changed in that year.", "The terms of the agreement are public.", "General public opinion was against the version of the story.",
    "You may not use this door.", "A copy of the letter was granted to any person who asked.", "The source of the river and the form of the valley.", "The work is under way and the conditions are met.",
    "International attribution of the painting to the school is common.", "The license plate was under the seat.", "In this case the license of the bar was not renewed.", "Released under pressure, the captain gave in.",
)
#: Notices of licences that belong to no family: training calls them unknown, so that the frame of a notice alone
#: ("licensed under the ... license, version #") proves nothing.
OTHERS = (
    "Licensed under the Eclipse Public License 2.0.", "Licensed under the Boost Software License, Version 1.0.", "This software is provided under the zlib license.", "Released under the Artistic License 2.0.",
    "This is free and unencumbered software released into the public domain.", "Licensed under the Academic Free License, version 3.0.", "This program is licensed under the Common Public License, version 1.0.", "Distributed under the terms of the Open Database License.",
    "Use of this source code is governed by a proprietary license that can be found in the file.", "Licensed under the Acme License, Version 2.0; you may not copy this file.", "This work is licensed under a Free Art License.", "Permission to read this document is hereby granted to any person of the company.",
)
#: The same, but seen only when the temperature is fitted.
UNSEEN = (
    "Licensed under the European Union Public Licence, version 1.2.", "Licensed under the Common Development and Distribution License, version 1.0.", "Released under the Do What You Want License.", "This work is licensed under the Design Science License.",
    "This program is distributed under the terms of the Q Public License, version 1.0.", "Use of this library is governed by the vendor license agreement.",
)
CUE = r"(?i)licen[cs]|copyright|permission|redistribut|gpl|cc0"


@dataclass(frozen=True)
class Params:
    confirm: float = 0.6  # share of a template's features that a confirmed paragraph holds
    own: float = 0.5  # and of those of its features that no other family's templates have
    probability: float = 0.5
    penalty: float = 0.002
    steps: int = 400
    copies: int = 20


#: Also in the first pass, since lines with such a word are reported even if they are no notice.
CUES = ("licens", "licenc", "copyright", "permission", "redistribut", "gpl", "cc0")
COMMON = frozenset("a all any are as by for has in is it may met no not of on or that the this to under use v with without you".split())
MARKS = r"^[\s#*/;!%>|-]+|[\s#*/|-]+$"
MARKUP = r"^(\s*<[^>]*>)+\s*$"


def features(text: str) -> list[str]:
    """The driver's version of feature_column, for training and tests."""
    ws = [w for w in re.sub(r"[^a-z#]+", " ", re.sub("[0-9]+", "#", text.lower())).split(" ") if w]
    return sorted({*ws, *(f"{a} {b}" for a, b in zip(ws, ws[1:]))})


def feature_column(line: Column) -> Column:
    ws = F.filter(F.split(F.regexp_replace(F.regexp_replace(F.lower(line), "[0-9]+", "#"), "[^a-z#]+", " "), " "), lambda w: w != "")
    pairs = lambda x: F.when(F.size(x) > 1, F.zip_with(F.slice(x, 1, F.size(x) - 1), F.slice(x, F.lit(2), F.size(x) - 1), lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.get(F.transform(F.array(ws), lambda x: F.concat(x, pairs(x))), F.lit(0)))


@dataclass
class Model:
    classes: list[str]
    weights: dict[str, list[float]]  # sparse: only features with a weight
    bias: list[float]
    temperature: float

    def probabilities(self, text: str) -> list[float]:
        z = np.array(self.bias, float)
        for f in features(text):
            if f in self.weights:
                z += self.weights[f]
        z = z / self.temperature
        e = np.exp(z - z.max())
        return (e / e.sum()).tolist()


@lru_cache(4)
def train(p: Params = Params()) -> Model:
    rng = random.Random(5)
    classes = [*sorted(TEMPLATES), UNKNOWN]
    filler = sorted({w for s in ORDINARY for w in s.lower().rstrip(".").split()})
    texts, labels, aside = [], [], []
    for c, family in enumerate(classes):
        for t in TEMPLATES.get(family, ORDINARY + OTHERS + UNSEEN):
            for k in range(p.copies):
                ws = t.split(" ")
                if k:
                    ws = [w for w in ws if rng.random() > (0.04 if family != UNKNOWN else 0.1 if t in OTHERS + UNSEEN else 0.3)]
                    ws = [rng.choice(filler) for _ in range(rng.randint(0, 4))] + ws + [rng.choice(filler) for _ in range(rng.randint(0, 4))]
                texts.append(" ".join(ws))
                labels.append(c)
                aside.append(t in UNSEEN)
    for _ in range(len(texts) // 4):  # texts without any known word belong to no family
        texts.append(" ".join(rng.sample(filler, rng.randint(0, 3))))
        labels.append(len(classes) - 1)
        aside.append(False)
    known = sorted({f for ts in (*TEMPLATES.values(), ORDINARY, OTHERS) for t in ts for f in features(t)})
    index = {f: i for i, f in enumerate(known)}
    x, y = np.zeros((len(texts), len(known))), np.array(labels)
    for r, t in enumerate(texts):
        x[r, [index[f] for f in features(t) if f in index]] = 1
    held = (np.arange(len(texts)) % 5 == 0) | np.array(aside)
    w, b = np.zeros((len(known), len(classes))), np.zeros(len(classes))
    target = np.eye(len(classes))[y]
    xt, tt, rate = x[~held], target[~held], 4.0
    for _ in range(p.steps):
        z = xt @ w + b
        e = np.exp(z - z.max(1, keepdims=True))
        g = (e / e.sum(1, keepdims=True) - tt) / len(xt)
        w -= rate * (xt.T @ g)
        b -= rate * g.sum(0)
        w = np.sign(w) * np.maximum(np.abs(w) - rate * p.penalty / 20, 0)  # the L1 step that makes the model sparse
    z = x[held] @ w + b

    def loss(t: float) -> float:
        s = z / t
        s = s - s.max(1, keepdims=True)
        return float(-(s[np.arange(len(s)), y[held]] - np.log(np.exp(s).sum(1))).mean())

    temperature = min((0.25, 0.4, 0.5, 0.7, 0.85, 1.0, 1.25, 1.5, 2.0), key=loss)
    return Model(classes, {f: [round(float(v), 6) for v in w[i]] for f, i in index.items() if w[i].any()}, [round(float(v), 6) for v in b], temperature)


@lru_cache(1)
def own_features() -> dict[str, list[str]]:
    """Of every template the features that no other family's templates have."""
    of = {f: {g for t in ts for g in features(t)} for f, ts in TEMPLATES.items()}
    return {t: [g for g in features(t) if not any(g in x for o, x in of.items() if o != f)] for f, ts in TEMPLATES.items() for t in ts}


def needles(confirm: float) -> list[str]:
    """Words such that without any of them a text holds less than ``confirm`` of each template's features."""
    chosen: list[str] = []
    for own in (features(t) for ts in TEMPLATES.values() for t in ts):
        for w in sorted((f for f in own if re.fullmatch("[a-z]+", f)), key=lambda w: (w not in chosen, w in COMMON, -len(w), w)):
            if sum(not set(f.split(" ")) & set(chosen) for f in own) < (confirm - 0.001) * len(own):
                break
            if w not in chosen:
                chosen.append(w)
    return chosen


def worth(text: Column, p: Params) -> Column:
    """Whether a text has a cue word or may hold enough of a template."""
    ws = sorted({*CUES, *needles(p.confirm)})
    ws = [w for w in ws if not any(v != w and v in w for v in ws)]
    return F.get(F.transform(F.array(F.lower(text)), lambda t: reduce(lambda a, b: a | b, [F.contains(t, F.lit(w)) for w in ws])), F.lit(0))


def runs(texts: DataFrame) -> DataFrame:
    """text_id, line, last, paragraph: every line, and the runs of lines that are scored together."""
    lines = texts.select("text_id", F.posexplode(F.split("text", "\n")).alias("line", "paragraph"))
    bare = lines.withColumn("bare", F.when(F.col("paragraph").rlike(MARKUP), "").otherwise(F.regexp_replace("paragraph", MARKS, "")))
    bare = bare.withColumn("block", F.sum(F.when(F.col("bare") == "", 1).otherwise(0)).over(Window.partitionBy("text_id").orderBy("line")))
    row = F.struct("line", "bare", F.size(F.split("bare", r"\s+")).alias("n"))
    blocks = bare.where("bare <> ''").groupBy("text_id", "block").agg(F.array_sort(F.collect_list(row)).alias("rows")).where(F.size("rows") > 1)
    longest = max(len(t.split(" ")) for ts in TEMPLATES.values() for t in ts)

    def reach(after: Column, words: int) -> Column:
        start = F.struct(F.lit(0).alias("words"), F.lit(0).alias("taken"))
        return F.aggregate(after, start, lambda a, x: F.when(a["words"] >= words, a).otherwise(F.struct((a["words"] + x["n"]).alias("words"), (a["taken"] + 1).alias("taken"))))["taken"]

    def taken(i: Column) -> Column:
        after = F.slice("rows", i + 2, F.lit(2 * longest))  # each line has a word
        whole = F.when(i == 0, F.size("rows") - 1).otherwise(1)
        return F.array_distinct(F.array(*[reach(after, w) for w in (longest // 2, longest, 2 * longest)], whole))

    spans = blocks.select("text_id", "rows", F.posexplode(F.transform(F.sequence(F.lit(0), F.size("rows") - 2), taken)).alias("i", "taken"))
    spans = spans.select("text_id", "i", F.explode("taken").alias("taken"), "rows")
    part = F.slice("rows", F.col("i") + 1, F.col("taken") + 1)
    spans = spans.select("text_id", F.get("rows", F.col("i"))["line"].alias("line"), "taken", F.array_join(F.transform(part, lambda x: x["bare"]), " ").alias("paragraph"))
    return lines.select("text_id", "line", F.col("line").alias("last"), "paragraph").unionAll(spans.select("text_id", "line", (F.col("line") + F.col("taken")).alias("last"), "paragraph"))


def chosen(found: DataFrame) -> DataFrame:
    """Of scored lines and runs of lines, those to report."""
    alone = F.col("line") == F.col("last")
    within = F.when(alone & F.col("confirmed"), F.col("line"))
    sure = found.where("confirmed").withColumn("own", F.collect_set(within).over(Window.partitionBy("text_id", "family")))
    wide = sure.where(~alone & ~F.exists("own", lambda x: (x >= F.col("line")) & (x <= F.col("last"))))
    order = Window.partitionBy("text_id", "family").orderBy("line", "last")
    wide = wide.withColumn("before", F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    wide = wide.withColumn("island", F.sum(F.when(F.col("line") <= F.col("before"), 0).otherwise(1)).over(order))
    rank = F.struct("template_share", (F.col("line") - F.col("last")).alias("short"), "probability", "line", "last")
    wide = wide.groupBy("text_id", "family", "island").agg(F.max(rank).alias("r")).select("text_id", "r.line", "r.last", "family", "r.probability", "r.template_share", F.lit(True).alias("confirmed"))
    taken = wide.groupBy("text_id").agg(F.collect_list(F.struct("line", "last", "family", "template_share")).alias("taken"))
    inside = lambda x: (F.col("line") >= x["line"]) & (F.col("last") <= x["last"])
    single = found.where(alone & (F.col("confirmed") | F.col("cue"))).drop("cue")
    both = single.unionByName(wide.select(*single.columns)).join(taken, "text_id", "left").withColumn("taken", F.coalesce("taken", F.array().cast(taken.schema["taken"].dataType)))
    part = F.exists("taken", lambda x: inside(x) & (~F.col("confirmed") | (F.col("family") != x["family"]) & (F.col("template_share") < x["template_share"])))
    return both.where(~part).drop("last", "taken")


def scan(df: DataFrame, p: Params = Params(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, line (from 0), family, probability, template_share, confirmed: notices, and lines with a cue word; a run of lines by its first."""
    spark, model = df.sparkSession, train(p)
    # The first pass reads the corpus once; what it keeps is read several times.
    kept = cut(df.select(F.col(key), F.col(text).alias("text")).where(worth(F.col(text), p)).withColumn("text_id", F.sha2("text", 256)))
    lines = runs(kept.select("text_id", "text").dropDuplicates(["text_id"])).where(worth(F.col("paragraph"), p))
    lines = cut(lines)  # read several times
    distinct = lines.select("paragraph").distinct()
    wide = distinct.select("paragraph", feature_column(F.col("paragraph")).alias("features"))
    n = len(model.classes)
    table = json.dumps([{"feature": f, "w": w} for f, w in model.weights.items()])
    weights = F.broadcast(spark.range(1).select(F.inline(F.from_json(F.lit(table), "array<struct<feature:string,w:array<double>>>"))))
    sums = wide.select("paragraph", F.explode("features").alias("feature")).join(weights, "feature").groupBy("paragraph").agg(F.array(*[F.sum(F.get("w", F.lit(i))) for i in range(n)]).alias("z"))
    z = wide.join(sums, "paragraph", "left").withColumn("z", F.array(*[(F.coalesce(F.get("z", F.lit(i)), F.lit(0.0)) + model.bias[i]) / model.temperature for i in range(n)]))
    z = z.withColumn("top", F.array_max("z")).withColumn("best", F.array_position("z", F.col("top")).cast("int") - 1)
    total = F.aggregate("z", F.lit(0.0), lambda acc, v: acc + F.exp(v - F.col("top")))
    z = z.withColumn("probability", F.round(1 / total, 4)).withColumn("family", F.get(F.array(*map(F.lit, model.classes)), F.col("best")))
    shares, held = F.lit(None).cast("double"), F.lit(False)
    part = lambda fs: F.size(F.array_intersect("features", F.array(*map(F.lit, fs)))) / len(fs)
    for family, ts in TEMPLATES.items():
        each = [part(features(t)) for t in ts]
        enough = [(F.round(x, 4) >= p.confirm) & (part(own_features()[t]) >= p.own) for x, t in zip(each, ts)]
        is_it = F.col("family") == family
        shares = F.when(is_it, F.greatest(*each) if len(each) > 1 else each[0]).otherwise(shares)
        held = F.when(is_it, reduce(lambda a, b: a | b, enough)).otherwise(held)
    scored = z.select("paragraph", "family", "probability", F.round(F.coalesce(shares, F.lit(0.0)), 4).alias("template_share"), held.alias("held"))
    scored = scored.withColumn("confirmed", (F.col("family") != UNKNOWN) & (F.col("probability") >= p.probability) & F.col("held")).drop("held")
    found = chosen(cut(lines.join(scored, "paragraph").withColumn("cue", F.col("paragraph").rlike(CUE)).drop("paragraph")))
    return kept.select(key, "text_id").join(found, "text_id").select(key, "line", "family", "probability", "template_share", "confirmed")
