"""Licence notices in documents: a trained paragraph classifier, confirmed by comparison with templates.

A paragraph, which is a line or the lines that a notice is wrapped over, is scored by multinomial logistic regression
over the word n-grams of a fixed vocabulary, which is that of the templates. One class is "unknown": prose, and
licence-like text of no known family. A family is named where the paragraph shares enough n-grams with a template of
that family, and where its probability passes a threshold calibrated on templates that the classifier was not trained
on. All of it is DataFrame operations and Spark's own models.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from flowsift.llm.common import sample_rows, text_of
from flowsift.session import materialise

UNKNOWN = "unknown"

#: Notices by family, as they commonly stand in texts, amid other words too.
TEMPLATES = {
    "apache": (
        "licensed under the apache license version 2.0",
        "released under the apache license version 2.0 you may not use this file except in compliance with the license",
        "spdx-license-identifier apache-2.0",
        "this software is distributed under the apache 2.0 license",
    ),
    "mit": (
        "released under the mit license",
        "licensed under the mit license",
        "permission is hereby granted free of charge to any person obtaining a copy of this software",
        "spdx-license-identifier mit",
        "this project is available under the terms of the mit license",
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    ),
    "bsd": (
        "redistribution and use in source and binary forms with or without modification are permitted",
        "licensed under the bsd 3-clause license",
        "distributed under a bsd-style license",
        "spdx-license-identifier bsd-3-clause",
        "released under the bsd 2-clause license",
        "this software is provided by the copyright holders and contributors as is and any express or implied warranties are disclaimed",
    ),
    "gpl": (
        "this work is licensed under the gnu general public license version 3",
        "released under the gnu gpl version 2 or any later version",
        "you can redistribute it and or modify it under the terms of the gnu general public license",
        "spdx-license-identifier gpl-3.0-or-later",
        "licensed under the gnu lesser general public license version 2.1",
    ),
    "mpl": (
        "this source code form is subject to the terms of the mozilla public license version 2.0",
        "this source code form is subject to the terms of the mozilla public license v 2.0 if a copy of the mpl was not distributed with this file you can obtain one at",
        "licensed under the mozilla public license",
        "spdx-license-identifier mpl-2.0",
        "released under the mozilla public license version 2.0",
    ),
    "isc": (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
        "licensed under the isc license",
        "released under the isc license",
        "spdx-license-identifier isc",
    ),
    "epl": (
        "this program and the accompanying materials are made available under the terms of the eclipse public license",
        "licensed under the eclipse public license version 2.0",
        "released under the eclipse public license version 1.0",
        "spdx-license-identifier epl-2.0",
    ),
    "zlib": (
        "this software is provided as-is without any express or implied warranty in no event will the authors be held liable",
        "licensed under the zlib license",
        "released under the zlib license",
        "spdx-license-identifier zlib",
    ),
    "cc": (
        "licensed under cc by-nc 4.0",
        "licensed under cc by-sa 4.0",
        "this work is licensed under a creative commons attribution 4.0 international license",
        "available under the creative commons attribution noncommercial sharealike license",
        "dedicated to the public domain under cc0 1.0",
    ),
    "proprietary": (
        "all rights reserved",
        "copyright by the authors all rights reserved",
        "no part of this publication may be reproduced without prior written permission",
        "unauthorized copying of this file is strictly prohibited proprietary and confidential",
    ),
}

#: Headings by family; they count only in a paragraph of few other words.
HEADINGS = {
    "apache": ("apache license", "apache license version 2.0", "apache software license"),
    "mit": ("mit license", "the mit license", "license mit", "mit licensed"),
    "bsd": ("bsd license", "bsd 2-clause license", "bsd 3-clause license", "license bsd"),
    "gpl": ("gnu general public license", "gnu lesser general public license", "gnu affero general public license", "license gpl", "gpl license"),
    "mpl": ("mozilla public license", "mozilla public license v 2.0", "mozilla public license version 2.0"),
    "isc": ("isc license", "the isc license", "license isc"),
    "epl": ("eclipse public license", "eclipse public license v 2.0"),
    "zlib": ("zlib license", "the zlib license", "license zlib"),
    "cc": ("creative commons attribution 4.0 international", "creative commons license"),
}
HEADING_WORDS = 3  # that a paragraph may have beside its heading

#: Identifiers that name a family wherever they stand.
IDENTIFIERS = {
    "apache": ("apache-1.1", "apache-2.0"),
    "bsd": ("bsd-2-clause", "bsd-3-clause"),
    "gpl": tuple(g + end for g in ("gpl-2.0", "gpl-3.0", "lgpl-2.1", "lgpl-3.0", "agpl-3.0") for end in ("", "-only", "-or-later")),
    "mpl": ("mpl-1.1", "mpl-2.0"),
    "epl": ("epl-1.0", "epl-2.0"),
    "cc": ("cc-by-4.0", "cc-by-sa-4.0", "cc-by-nc-4.0", "cc0-1.0"),
}

#: Licence-like text of no family, for the unknown class.
DECOYS = (
    "the driving license was renewed by the general office",
    "the public may use the source of the river free of charge",
    "version 2.0 of the file was released under pressure",
    "rights of the person are reserved in the general terms",
    "a copy of the work is available to the public",
    "permission to use the road is granted to any person",
    "the apache helicopter and the mozilla browser",
    "creative work in the commons of the university",
    "the mit course on software without charge",
    "subject to the terms of the contract",
)

#: Words that prose and notices share; n-grams of these alone are no evidence.
COMMON = frozenset(
    "a all an and any are as at be but by can event fee for from held in including is it kind made may no not of on or part particular purpose"
    " the this to under use v will with without you".split()
)


def notices() -> list[tuple[str, str, int | None]]:
    """(family, template, words that may stand beside it or None) of all templates."""
    free = [(f, t, None) for table in (TEMPLATES, IDENTIFIERS) for f, texts in table.items() for t in texts]
    return free + [(f, t, HEADING_WORDS) for f, texts in HEADINGS.items() for t in texts]


@dataclass(frozen=True)
class LicenceModel:
    """Settings. ``sample_rows`` bounds the corpus paragraphs among the unlabelled training rows."""

    sample_rows: int = 2_000
    grams: int = 3
    regularisation: float = 0.001
    precision: float = 0.98
    least_probability: float = 0.5
    least_similarity: float = 0.6
    folds: int = 3


def gram_words(text: Column) -> Column:
    """Words of a paragraph: lower case, parted at slashes too, without the marks around them."""
    words = F.split(F.translate(F.lower(text), "\t\r\x0b\x0c/", "     "), " ")
    bare = F.transform(words, lambda w: F.trim(w, F.lit(".,;:!?()[]{}<>\"'*#|-=~_+`")))
    return F.filter(bare, lambda w: w != "")


def _runs(words: Column, n: int) -> Column:
    starts = F.sequence(F.lit(1), F.size(words) - (n - 1))
    runs = F.transform(starts, lambda i: F.array_join(F.slice(words, i, n), " "))
    return F.when(F.size(words) >= n, runs).otherwise(F.array().cast("array<string>"))


def grams(words: Column, most: int) -> Column:
    """Distinct n-grams of 1 to ``most`` words."""
    every = F.transform(F.array(words), lambda w: F.array_distinct(F.concat(*[_runs(w, n) for n in range(1, most + 1)])))
    return F.get(every, F.lit(0))


def template_grams(text: str, most: int) -> Column:
    """``grams`` of a template, as a fixed array."""
    words = text.split()
    return F.array(*map(F.lit, dict.fromkeys(" ".join(words[i : i + n]) for n in range(1, most + 1) for i in range(len(words) - n + 1))))


def cue_words() -> list[str]:
    """Template words that are no common ones: without any of them a paragraph has no feature."""
    return sorted({w for _, t, _ in notices() for w in t.split()} - COMMON)


def vocabulary(most: int) -> list[str]:
    """The n-grams of the templates that hold a cue word."""
    found, cues = set(), set(cue_words())
    for words in (t.split() for _, t, _ in notices()):
        for n in range(1, most + 1):
            found |= {" ".join(words[i : i + n]) for i in range(len(words) - n + 1) if cues & set(words[i : i + n])}
    return sorted(found)


#: Words of the longest template: as many, of a line and after it, can be part of a notice that begins in the line.
MOST_WORDS = max(len(t.split()) for _, t, _ in notices())


def _following(lines: Column, cues: Column) -> Column:
    """Array of (words, tail, lines): per line with a cue word its words, and those after it up to a blank line.

    ``tail`` ends after ``MOST_WORDS`` words, however many lines they take, and ``lines`` is how many that are. Each
    line before a blank one has a word, so no more lines than ``MOST_WORDS`` are looked at. Null for other lines.
    """

    def tail(after: Column) -> Column:
        blank = F.array_position(F.transform(after, lambda w: F.size(w) == 0), True)
        kept = F.when(blank > 0, F.slice(after, 1, (blank - 1).cast("int"))).otherwise(after)
        placed = F.transform(kept, lambda w, j: F.transform(F.slice(w, 1, MOST_WORDS), lambda x: F.struct(x.alias("word"), (j + 1).alias("line"))))
        return F.slice(F.flatten(placed), 1, MOST_WORDS)

    def one(words: Column, k: Column) -> Column:
        found = F.get(F.transform(F.array(F.slice(lines, k + 2, MOST_WORDS)), tail), F.lit(0))
        return F.when(F.arrays_overlap(words, cues), F.struct(words.alias("words"), found.alias("tail")))

    return F.transform(lines, one)


def wrapped(found: DataFrame) -> DataFrame:
    """(the columns, words, tail, last): each line with the words after it, those words alone, and their last line."""
    near = found.filter(F.size("tail") > 0)
    head = F.slice("words", F.greatest(F.size("words") - (MOST_WORDS - 1), F.lit(1)), MOST_WORDS)
    near = near.withColumn("last", F.col("paragraph") + F.element_at("tail", -1)["line"]).withColumn("tail", F.transform("tail", lambda x: x["word"]))
    return near.withColumn("words", F.concat(head, "tail"))


def paragraphs(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(row, key, paragraph, words, tail) of the lines that have a cue word; ``row`` tells the documents apart.

    The others have no feature, and the classifier gives them all the same answer, "unknown". Texts without a cue
    word are left out before they are cut into lines.
    """
    cues = F.array(*map(F.lit, cue_words()))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), key, text_of().alias("text"))
    likely = rows.filter(F.arrays_overlap(gram_words(F.translate("text", "\n", " ")), cues))
    lines = F.transform(F.split("text", "\n"), gram_words)
    bound = F.get(F.transform(F.array(lines), lambda x: _following(x, cues)), F.lit(0))
    each = likely.select("row", key, F.posexplode(bound).alias("paragraph", "line")).filter(F.col("line").isNotNull())
    return each.select("row", key, "paragraph", "line.*")


def _with_vector(rows: DataFrame, model: LicenceModel) -> DataFrame:
    counter = CountVectorizerModel.from_vocabulary(vocabulary(model.grams), inputCol="grams", outputCol="features", binary=True)
    return counter.transform(rows.withColumn("grams", grams(F.col("words"), model.grams)))


def training_rows(spark: SparkSession, corpus: DataFrame, model: LicenceModel) -> DataFrame:
    """(words, label, family, fold): notices of each family, whole and in part and amid other text, and text of no family.

    Labels are known by construction. All rows made from a template are in its fold. The corpus adds up to
    ``sample_rows`` of its paragraphs with a cue word but little likeness to a template, in the order of a hash.
    Scrambled notices teach that words alone are not enough.
    """
    families = [UNKNOWN, *TEMPLATES]
    known = [(f, t, i % model.folds) for i, (f, t, _) in enumerate(sorted(notices(), key=lambda n: n[:2]))]
    known += [(UNKNOWN, t, i % model.folds) for i, t in enumerate(DECOYS)]
    table = spark.createDataFrame(known, "family string, text string, fold int")
    words = table.withColumn("words", F.split("text", " "))
    size = F.size("words")
    lead = F.split(F.lit("note that the content below"), " ")
    tail = F.split(F.lit("for details see the file"), " ")
    versions = F.array(
        F.col("words"),
        F.concat(lead, F.col("words")),
        F.concat(F.col("words"), tail),
        F.concat(lead, F.col("words"), tail),
        F.concat(F.array(F.lit("copyright"), F.lit("2024")), F.col("words")),
        F.when(size > 8, F.slice("words", 1, size - 2)).otherwise(F.col("words")),
        F.when(size > 8, F.slice("words", 3, size)).otherwise(F.col("words")),
    )
    whole = words.select("family", F.explode(versions).alias("words"), "fold")
    odd = words.filter(size > 8)  # in another order, shorter ones may hold a heading
    scrambled = odd.select(F.lit(UNKNOWN).alias("family"), F.array_sort("words").alias("words"), "fold")
    backwards = odd.select(F.lit(UNKNOWN).alias("family"), F.reverse("words").alias("words"), "fold")
    templates = [template_grams(t, 2) for texts in TEMPLATES.values() for t in texts]
    likeness = F.greatest(*[F.size(F.array_intersect(F.col("grams"), t)) / F.size(t) for t in templates])
    picked = sample_rows(corpus.select("words"), model.sample_rows, ["words"])
    prose = picked.withColumn("grams", grams(F.col("words"), 2)).filter(likeness < 0.2)
    prose = prose.select(F.lit(UNKNOWN).alias("family"), "words", F.pmod(F.xxhash64("words"), F.lit(model.folds)).cast("int").alias("fold"))
    rows = reduce(DataFrame.union, [whole, scrambled, backwards, prose])
    label = F.array_position(F.array(*map(F.lit, families)), F.col("family")).cast("double") - 1
    return rows.withColumn("label", label)


def fit(spark: SparkSession, corpus: DataFrame, model: LicenceModel) -> tuple[LogisticRegressionModel, dict[str, float]]:
    """The classifier, and per family the smallest probability that is right often enough on templates kept from it.

    Each template is kept from the training once, with all rows made from it. What counts is whether rows that the
    comparison confirms get their family. A family without such a row is never named: its limit stays above one. The
    classifier that is used then learns from all rows.
    """
    rows = materialise(_with_vector(training_rows(spark, corpus, model), model).coalesce(2), "training").coalesce(2)
    learner = LogisticRegression(maxIter=50, regParam=model.regularisation, elasticNetParam=0.5, family="multinomial")
    tested = []
    for fold in range(model.folds):
        held = named(learner.fit(rows.filter(F.col("fold") != fold)), rows.filter(F.col("fold") == fold)).filter(F.col("predicted") != UNKNOWN)
        likeness = similarity(F.col("grams"), F.col("predicted"), model.grams, F.size("words"))
        sure = held.filter(likeness >= model.least_similarity)
        tested += sure.select("predicted", "probability", (F.col("predicted") == F.col("family")).alias("right")).collect()  # some hundreds
    limits = {}
    for family in TEMPLATES:
        good, reached, limits[family] = 0, 0, 1.01
        mine = sorted((r for r in tested if r["predicted"] == family), key=lambda r: -r["probability"])
        for n, r in enumerate(mine, 1):
            good += r["right"]
            if good >= model.precision * n:
                reached, limits[family] = n, max(model.least_probability, r["probability"])
        if mine and reached == len(mine):  # no row tells where it stops being right often enough
            limits[family] = model.least_probability
    return learner.fit(rows), limits


def named(classifier: LogisticRegressionModel, rows: DataFrame) -> DataFrame:
    """Rows with ``predicted``, the likeliest family, and its ``probability``."""
    families = F.array(*map(F.lit, [UNKNOWN, *TEMPLATES]))
    scores = classifier.transform(rows).withColumn("scores", vector_to_array("probability"))
    best = scores.withColumn("at", F.col("prediction").cast("int"))
    kept = [c for c in rows.columns if c not in ("features", "rawPrediction", "probability", "prediction")]
    return best.select(*kept, F.get(families, F.col("at")).alias("predicted"), F.get("scores", F.col("at")).alias("probability"))


#: As the words of a paragraph: too many for a heading.
NO_HEADING = 1 << 30


def similarity(found: Column, family: Column, most: int, words: Column) -> Column:
    """Largest share of a template's n-grams that a paragraph of so many words has, over the templates of its family.

    Templates of up to ``most`` words count as a whole or not at all, and headings only with few words beside them.
    """

    def share(text: str, beside: int | None) -> Column:
        size, grams_of = len(text.split()), template_grams(text, most)
        part = F.size(F.array_intersect(found, grams_of)) / F.size(grams_of) if size > most else F.array_contains(found, text).cast("double")
        return part if beside is None else F.when(words <= size + beside, part).otherwise(0.0)

    best = F.lit(0.0)
    for name in TEMPLATES:
        shares = [share(text, beside) for f, text, beside in notices() if f == name]
        best = F.when(family == name, F.greatest(*shares)).otherwise(best)
    return best


def licence_notices(docs: DataFrame, model: LicenceModel = LicenceModel()) -> DataFrame:
    """doc_id, paragraph, licence, probability, similarity: one row per paragraph that the classifier names.

    ``licence`` is the family, or "unknown" where the probability is below the calibrated threshold or no template
    confirms it. A notice that is wrapped over several lines is listed once, at its first line; a heading stands in one. Null and empty texts have
    no paragraph; repeated rows and repeated notices are all listed; a document with several notices has as many
    rows. Only lines with a cue word leave the scan, with some words of those after them.
    """
    found = materialise(paragraphs(docs), "paragraphs")
    classifier, limits = fit(docs.sparkSession, found, model)
    limit = reduce(lambda c, f: c.when(F.col("predicted") == f, F.lit(limits[f])), TEMPLATES, F.when(F.lit(False), F.lit(1.0)))

    def compared(rows: DataFrame, words: Column) -> DataFrame:
        scored = named(classifier, _with_vector(rows, model)).filter(F.col("predicted") != UNKNOWN)
        scored = scored.withColumn("similarity", similarity(F.col("grams"), F.col("predicted"), model.grams, words))
        return scored.withColumn("sure", (F.col("probability") >= limit) & (F.col("similarity") >= model.least_similarity))

    columns = ("row", "doc_id", "paragraph", "predicted", "probability", "similarity", "sure")
    lines = compared(found.drop("tail"), F.size("words")).select(*columns, F.lit(None).cast("int").alias("last"))
    joined = compared(wrapped(found), F.lit(NO_HEADING)).filter("sure")
    rest = similarity(grams(F.col("tail"), model.grams), F.col("predicted"), model.grams, F.lit(NO_HEADING))
    joined = joined.filter(rest < F.col("similarity")).select(*columns, "last")  # a notice begins in its first line
    rows = _without_repeats(lines.union(joined))
    licence = F.when(F.col("sure"), F.col("predicted")).otherwise(UNKNOWN)
    return rows.select("doc_id", "paragraph", licence.alias("licence"), "probability", "similarity")


def _without_repeats(rows: DataFrame) -> DataFrame:
    """Lines, and joined lines (``last``) that hold no named line of the family and don't go on from joined ones.

    Joined lines go on from those that begin in the line before, and from those that reach them and are likelier.

    Lines without a name are left out where joined ones that have one hold them.
    """
    joined, line = F.col("last").isNotNull(), F.col("last").isNull()
    family = Window.partitionBy("row", "predicted").orderBy("paragraph")
    named_line = F.min(F.when(line & F.col("sure"), F.col("paragraph"))).over(family.rangeBetween(0, Window.unboundedFollowing))
    before = F.max(F.when(joined, F.col("paragraph"))).over(family.rangeBetween(-1, -1))
    marked = rows.withColumn("named_line", named_line)
    marked = marked.filter(line | F.col("named_line").isNull() | (F.col("named_line") > F.col("last")))
    near = F.collect_list(F.when(joined, F.struct("last", "similarity"))).over(family.rangeBetween(-MOST_WORDS, -1))
    reached = F.exists("near", lambda x: (x["last"] >= F.col("paragraph")) & (x["similarity"] > F.col("similarity")))
    marked = marked.withColumn("before", before).withColumn("near", near).filter(line | (F.col("before").isNull() & ~reached))
    document = Window.partitionBy("row").orderBy("paragraph").rangeBetween(Window.unboundedPreceding, 0)
    marked = marked.withColumn("held", F.max("last").over(document))
    return marked.filter(joined | F.col("sure") | F.col("held").isNull() | (F.col("held") < F.col("paragraph")))
