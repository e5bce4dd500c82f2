"""The line operator against edit similarity computed for every pair of lines."""

from __future__ import annotations

import random

from conftest import SF
from pyspark.sql import functions as F

from wattlake.llm import lines
from wattlake.llm.common import documents, saved


def distinct_lines(spark, most: int):
    rows = documents(spark, SF).select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "raw")).withColumn("norm", lines.normalised("raw"))
    rows = rows.filter((F.size(F.split("norm", " ")) >= 5) & (F.length("norm") <= most))
    return saved(rows.groupBy("norm").agg(F.min(F.struct("doc_id", "at")).alias("spot")), "test-lines")


def near_pairs(frame):
    """Every pair of different lines of 80 per cent edit similarity."""
    a, b = frame.select(F.col("norm").alias("x")).repartition(8), frame.select(F.col("norm").alias("y"))
    size = F.greatest(F.length("x"), F.length("y"))
    pairs = a.join(F.broadcast(b), (F.col("x") < F.col("y")) & (5 * F.least(F.length("x"), F.length("y")) >= 4 * size))
    return [(r.x, r.y) for r in pairs.filter("levenshtein(x, y, cast(floor(greatest(length(x), length(y)) / 5) as int)) >= 0").collect()]


def together(spark, texts):
    """The component of each text, by the operator."""
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    table = lines.line_table(frame, 5)
    near = {r.line: r.component for r in lines.near_lines(saved(table, "test-table"), frame, 5).collect()}
    return {texts[r.doc_id]: near.get(r.line, r.line) for r in table.select("doc_id", "line").collect()}


def test_recall_of_given_lines(spark):
    frame = distinct_lines(spark, 300)
    truth = near_pairs(frame)
    part = together(spark, [r.norm for r in frame.collect()])
    assert len(truth) > 10
    found = sum(part[x] == part[y] for x, y in truth)
    print(f"given lines: {found} of {len(truth)}")
    assert found >= 0.98 * len(truth)


def test_recall_of_changed_lines(spark):
    rng = random.Random(5)
    given = sorted(r.norm for r in distinct_lines(spark, 300).collect())
    picked = rng.sample(given, 300)

    def word(text):
        every = text.split(" ")
        k = rng.randrange(len(every))
        every[k] = "".join(rng.choices("bdfgklmprstvz", k=len(every[k])))
        return " ".join(every)

    def letters(text):
        out = list(text)
        for k in rng.sample(range(len(out)), len(out) // 20):
            out[k] = rng.choice(["q", "", "xz"])
        return "".join(out).strip()

    for name, change in (("one word", word), ("one letter of twenty", letters)):
        pairs = [(t, change(t)) for t in picked]
        pairs = [(x, lines_norm) for x, y in pairs if (lines_norm := " ".join(y.split())) != x and len(lines_norm.split(" ")) >= 5]
        frame = spark.createDataFrame(pairs, "x string, y string")
        close = {r.x for r in frame.filter("levenshtein(x, y) <= floor(greatest(length(x), length(y)) / 5)").collect()}
        pairs = [p for p in pairs if p[0] in close]
        part = together(spark, sorted({t for p in pairs for t in p}))
        found = sum(part[x] == part[y] for x, y in pairs)
        print(f"{name}: {found} of {len(pairs)}")
        assert found >= 0.98 * len(pairs) > 200


def test_lines_without_simhash(spark):
    """Lines above 4,096 characters and lines of short words have no SimHash, yet their near copies go."""
    rng = random.Random(9)
    long = " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 9))) for _ in range(1_500))
    edited = "".join("" if k % 40 == 7 else c for k, c in enumerate(long))
    short = "we go up to it as he is at an inn by the sea"
    rows = [(1, long + "\n" + short), (2, edited), (3, short.replace("inn", "elm"))]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert len(edited) > 4_096 and all(r.simhash is None for r in lines.line_table(frame, 5).collect())
    assert {r.doc_id: r.removed_lines for r in lines.line_report(frame).collect()} == {1: [], 2: [0], 3: [0]}


def test_lines_of_few_words(spark):
    """A line of few words counts by its characters, and each letter of a script without spaces is a word."""
    han, thai = "数据处理需要清洗重复的内容", "การประมวลผล"
    rows = [(1, f"{han}\nacknowledgements bibliography\nshort line\n{thai}"), (2, f"{han[:-1]}\nAcknowledgements: bibliography.\nshort line\n{thai}")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.removed_lines for r in lines.line_report(frame).collect()} == {1: [], 2: [0, 1, 3]}
