"""Fuzzy line deduplication with DataFrame functions alone: SimHash, pigeonhole blocks, shared character runs, edit similarity."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattlake.llm.common import components, dropped, saved, shared_path
from wattlake.runtime import released

# Of 64 bits at most three may differ, so of these five blocks two at least are equal.
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
DIFFERENT_BITS = 3
STEPS = 0x0001000100010001  # the lowest bit of each of four lanes of 16
LONGEST = 4_096  # characters of a line that has a SimHash; so it has at most 2,048 words. Longer ones meet by their grams
TELLING = 5  # letters of a word that counts for the SimHash: short ones are the same in any line
FEWEST = 3  # such words that a line must have for a SimHash; others meet by their grams
# Characters of a gram, and the shortest and longest line that has them. Of two near lines the shorter one has 80 % of the length at
# least, so at 80 per cent both have grams of one size.
GRAMS = ((2, 1, 9), (3, 8, 24), (8, 20, 64), (12, 52, 1 << 30))
UNSPACED = r"[^\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}]"  # all but letters of scripts without spaces
BLOCK = 32  # characters of a line whose grams are cut from one piece
KEY_BITS = 48  # of a gram key: 2**24 different grams make a chance meeting likely, which the edit similarity tells apart
TURNS = 2  # the keys are shuffled one part after the other, so their files never lie on disk together
SLOTS_LOG = 5  # 2**5 classes of gram hashes; of each class the smallest hash is a key


def normalised(line: str | Column) -> Column:
    """Lower case, each run of signs and space as one space, none at the ends."""
    line = F.col(line) if isinstance(line, str) else line
    return F.trim(F.regexp_replace(F.lower(line), r"[^\p{L}\p{N}]+", " "))


def lane(j: int) -> Column:
    """Bits j, j + 16, j + 32 and j + 48 of a word's hash, each in a lane of its own."""
    return F.shiftrightunsigned("hash", j).bitwiseAND(F.lit(STEPS))


def majority(n: Column) -> Column:
    """64-bit SimHash from the 16 lane sums of up to 2,048 words: a bit is set if more than half of the words set it."""
    lift = (F.lit(4095) - F.shiftright(n, 1)).cast("long") * F.lit(STEPS)  # carries a lane above half of n to its bit 12
    out = F.lit(0).cast("long")
    for j in range(16):
        out = out.bitwiseOR(F.shiftleft(F.shiftrightunsigned(F.col(f"s{j}") + lift, 12).bitwiseAND(F.lit(STEPS)), j))
    return out


def gram_members(texts: DataFrame, part: int = 0, parts: int = 1) -> DataFrame:
    """(line, key) for each gram key of each (line, norm), by which lines meet that share a run of characters.

    The keys are hashes of all grams of a line of few, or of many the smallest of each class. Bit 40 is set, so none is a key of a SimHash. A line
    is taken in blocks, so a gram costs the same wherever it stands. Of ``parts`` parts of the classes only ``part`` is given.
    """
    chars, none = F.length("norm"), F.array().cast("array<int>")
    sizes = F.filter(F.array(*[F.when(chars.between(max(lo, n), hi), F.lit(n)) for n, lo, hi in GRAMS]), lambda n: n.isNotNull())
    grams = F.aggregate(sizes, F.lit(0), lambda total, n: total + chars - n + 1)
    rows = texts.select("line", (grams <= 1 << SLOTS_LOG).alias("few"), F.regexp_extract_all("norm", F.lit(f".{{1,{BLOCK}}}"), F.lit(0)).alias("b"), F.explode(sizes).alias("size"))
    pieces = F.transform("b", lambda x, i: F.concat(x, F.substring(F.coalesce(F.get("b", i + 1), F.lit("")), F.lit(1), F.col("size") - 1)))
    rows = rows.select("line", "few", "size", F.explode(pieces).alias("piece"))
    starts = F.least(F.lit(BLOCK), F.length("piece") - F.col("size") + 1)
    rows = rows.select("line", "few", "size", "piece", F.explode(F.when(starts > 0, F.sequence(F.lit(1), starts)).otherwise(none)).alias("i"))
    rows = rows.select("line", "few", F.xxhash64(F.substring("piece", F.col("i"), F.col("size"))).bitwiseOR(F.lit(1 << 40)).alias("hash"))
    slot = F.shiftright("hash", 64 - SLOTS_LOG)
    rows = rows.filter(F.pmod(slot, F.lit(parts)) == part) if parts > 1 else rows
    least = rows.groupBy("line", F.when(F.col("few"), F.col("hash")).otherwise(slot).alias("slot")).agg(F.min("hash").alias("hash"))
    return least.select("line", F.col("hash").bitwiseAND(F.lit((1 << KEY_BITS) - 1)).alias("key"))


def able(norm: str, min_words: int) -> Column:
    """Whether a line is compared: it has ``min_words`` words or four times as many characters; a letter of a script without spaces is a word."""
    letters = F.length(F.regexp_replace(norm, UNSPACED, ""))
    return (F.length(norm) >= 4 * min_words) | (F.size(F.split(norm, " ")) >= min_words) | (letters >= min_words)


def line_rows(docs: DataFrame, min_words: int) -> DataFrame:
    """(doc_id, text_key, at, line, norm) for each line that is ``able``; ``line`` names its normalised text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    rows = rows.select("doc_id", F.xxhash64("text").alias("text_key"), F.posexplode(F.split("text", "\n")).alias("at", "raw"))
    rows = rows.select("doc_id", "text_key", "at", normalised("raw").alias("norm")).filter(able("norm", min_words))
    return rows.select("doc_id", "text_key", "at", F.xxhash64("norm").alias("line"), "norm")


def text_table(docs: DataFrame, min_words: int) -> DataFrame:
    """(line, norm), one row for each line that is ``able``, written in buckets of lines: a join or a group by line does not move the texts again."""
    spark = docs.sparkSession
    buckets = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    path = shared_path(spark, "lines-texts")
    name = f"line_texts_{path.rsplit('-', 1)[1]}"
    rows = line_rows(docs, min_words).select("line", "norm").repartition(buckets, "line").groupBy("line").agg(F.min("norm").alias("norm"))
    with released(spark):
        rows.write.option("path", path).option("compression", "zstd").bucketBy(buckets, "line").format("parquet").saveAsTable(name)
    return spark.table(name)


def line_table(docs: DataFrame, min_words: int, texts: DataFrame | None = None) -> DataFrame:
    """(doc_id, text_key, at, line, simhash, chars) for each line that is ``able``. Words are counted once a text, where it lies in ``texts``."""
    texts = text_table(docs, min_words) if texts is None else texts
    words = texts.select("line", F.length("norm").alias("chars"), F.split("norm", " ").alias("words"))
    words = words.select("line", "chars", F.explode_outer(F.when(F.col("chars") <= LONGEST, F.col("words"))).alias("word"))
    words = words.withColumn("hash", F.when(F.length("word") >= TELLING, F.xxhash64("word")))
    summed = words.groupBy("line", "chars").agg(F.count("hash").cast("int").alias("told"), *[F.sum(lane(j)).alias(f"s{j}") for j in range(16)])
    known = summed.select("line", F.when(F.col("told") >= FEWEST, majority(F.col("told"))).alias("simhash"), "chars")
    return line_rows(docs, min_words).drop("norm").join(known, "line").select("doc_id", "text_key", "at", "line", "simhash", "chars")


def _near(a: str, b: str, percent: int, of_grams: Column) -> Column:
    """Whether two lines that share a key can be near by their lengths and, if they share keys of SimHashes alone, by their SimHashes."""
    bits = F.bit_count(F.col(f"{a}.simhash").bitwiseXOR(F.col(f"{b}.simhash"))) <= DIFFERENT_BITS
    bits = of_grams | bits
    x, y = F.col(f"{a}.chars"), F.col(f"{b}.chars")
    return bits & (100 * F.least(x, y) >= percent * F.greatest(x, y))


def _verified(pairs: DataFrame, texts: DataFrame, percent: int, name: str, likely: bool) -> DataFrame:
    """Of pairs (a, b) of lines those of enough edit similarity: one less the edit distance over the longer length.

    Where pairs are ``likely`` near, most differ in a few letters, so a narrow band is tried first and the full one only where that says no. One text of
    each pair travels; pairs go in as many rounds as there are pairs to a line, so a round moves about the texts once.
    """
    rounds = max(1, -(-pairs.count() // max(1, texts.count())))
    x = texts.select(F.col("line").alias("a"), F.col("norm").alias("x"))
    y = texts.select(F.col("line").alias("b"), F.col("norm").alias("y"))
    within = "levenshtein(x, y, cast(floor(greatest(length(x), length(y)) * {} / 100) as int)) >= 0"
    close = F.expr(" OR ".join(within.format(p) for p in ([min(4, 100 - percent)] if likely else []) + [100 - percent]))
    found = []
    for k in range(rounds):
        some = pairs.filter(F.pmod(F.xxhash64("a", "b"), F.lit(rounds)) == k) if rounds > 1 else pairs
        found.append(saved(some.join(x, "a").join(y, "b").filter(close).select("a", "b"), name))
    return reduce(DataFrame.unionByName, found)


def near_lines(lines: DataFrame, docs: DataFrame, min_words: int, percent: int = 80, texts: DataFrame | None = None) -> DataFrame:
    """(line, component) of lines that are near another: a shared key and edit similarity of ``percent`` per cent.

    Five blocks of the SimHash, two at a time, give ten keys; lines at most three bits apart share one. A word that changes moves the SimHash
    of a line further than that, so lines of any length also meet by their ``gram_members``: what an edit leaves in one piece. In a bucket every line is compared with the smallest one, and
    then, where a bucket still holds several components, with the lines of other components. So a large bucket of variants costs one
    comparison a line, and no near pair stays apart.
    """
    distinct = saved(lines.groupBy("line").agg(F.max("simhash").alias("simhash"), F.max("chars").alias("chars")), "lines-distinct")
    texts = text_table(docs, min_words) if texts is None else texts
    part = lambda lo, n: F.shiftrightunsigned("simhash", lo).bitwiseAND(F.lit((1 << n) - 1).cast("long"))
    keys = [
        (part(*p) * (1 << q[1]) + part(*q) + F.lit(k << 26).cast("long")) for k, (p, q) in enumerate(combinations(BLOCKS, 2))
    ]
    bucket, met = Window.partitionBy("key"), []
    for turn in range(TURNS):
        members = distinct.filter(F.col("simhash").isNotNull()).select("line", F.explode(F.array(*keys[turn::TURNS])).alias("key"))
        members = members.unionByName(gram_members(texts, turn, TURNS))
        found = members.select("key", "line", F.min("line").over(bucket).alias("first"), F.max("line").over(bucket).alias("last"), F.count("line").over(bucket).alias("n"))
        # A bucket of two is its one pair; of larger ones every line may be asked for again.
        found = found.filter("first < last AND (n > 2 OR line != first)").withColumn("of_grams", F.shiftrightunsigned("key", 32) != 0)
        met.append(saved(found.select("key", "line", "first", "of_grams", (F.col("n") > 2).alias("large")), "lines-met"))
    met_all = reduce(DataFrame.unionByName, met)
    pairs = met_all.filter("line != first").groupBy(F.col("first").alias("a"), F.col("line").alias("b")).agg(F.max("of_grams").alias("of_grams"))
    side = lambda x: distinct.select(F.col("line").alias(x), F.struct("simhash", "chars").alias(f"of_{x}"))
    tested = pairs.join(side("a"), "a").join(side("b"), "b").filter(_near("of_a", "of_b", percent, F.col("of_grams"))).select("a", "b")
    tested = saved(tested, "lines-stars")
    links = _verified(tested, texts, percent, "lines-links", True)
    reached = components(links, name="lines-stars")
    large = met_all.filter("large").select("key", "of_grams", "line")
    placed = large.join(reached, F.col("line") == F.col("node"), "left").select("key", "of_grams", "line", F.coalesce("component", "line").alias("part"))
    apart = placed.select("*", F.min("part").over(bucket).alias("p"), F.max("part").over(bucket).alias("q")).filter("p < q").select("key", "of_grams", "line", "part")
    apart = saved(apart, "lines-apart")
    dropped(*met)
    asked = apart.join(distinct, "line").select("key", "of_grams", "part", F.struct("line", "simhash", "chars").alias("m"))
    asked = saved(asked, "lines-asked")
    dropped(apart)
    others = []
    for turn in range(TURNS):
        some = asked.filter(F.pmod("key", F.lit(TURNS)) == turn)
        u = some.select("key", "of_grams", F.col("m").alias("u"), F.col("part").alias("p"))
        v = some.select("key", F.col("m").alias("v"), F.col("part").alias("q"))
        other = u.join(v, (u["key"] == v["key"]) & (F.col("p") < F.col("q")) & _near("u", "v", percent, F.col("of_grams")))
        others.append(saved(other.select(F.least("u.line", "v.line").alias("a"), F.greatest("u.line", "v.line").alias("b")).distinct(), "lines-others"))
    dropped(asked)
    more = reduce(DataFrame.unionByName, others).distinct().join(tested, ["a", "b"], "left_anti")
    more = saved(more, "lines-more")
    dropped(*others)
    links = links.union(_verified(more, texts, percent, "lines-rest", False))
    dropped(tested, more)
    return components(links, name="lines-all").select(F.col("node").alias("line"), "component")


def repeated_lines(docs: DataFrame, min_words: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, text_key, at): the lines that go, all but the first of each connected group of equal or near lines.

    The first is the one with the smallest (doc_id, text, line number); null ids come last. Lines of fewer than ``min_words`` words and
    fewer than four times as many characters stay; each letter of a script without spaces is a word. Longer lines of any length are compared whole. Rows repeated with the same doc_id and text share one
    decision.
    """
    texts = text_table(docs, min_words)
    lines = saved(line_table(docs, min_words, texts), "lines")
    near = near_lines(lines, docs, min_words, percent, texts)
    spots = lines.select("doc_id", "text_key", "at", "line").join(near, "line", "left")
    spots = spots.withColumns({"part": F.coalesce("component", "line"), "spot": F.struct(F.col("doc_id").isNull(), "doc_id", "text_key", "at")})
    firsts = spots.groupBy("part").agg(F.min("spot").alias("first"), F.max("spot").alias("last")).filter("first < last").select("part", "first")
    gone = spots.join(firsts, "part").filter(F.col("spot") != F.col("first"))
    return gone.select("doc_id", "text_key", "at").distinct()


def line_report(docs: DataFrame, min_words: int = 5, percent: int = 80) -> DataFrame:
    """Per row: doc_id, n_lines, n_removed and the sorted numbers (from 0) of the lines that go. Null text is one empty line, which stays."""
    gone = repeated_lines(docs, min_words, percent)
    lists = gone.groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_list("at")).alias("removed")).alias("g")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), F.size(F.split(text, "\n")).alias("n_lines")).alias("d")
    out = rows.join(lists, F.col("d.doc_id").eqNullSafe(F.col("g.doc_id")) & (F.col("d.text_key") == F.col("g.text_key")), "left")
    removed = F.coalesce("removed", F.array().cast("array<int>"))
    return out.select("d.doc_id", "n_lines", F.size(removed).alias("n_removed"), removed.alias("removed_lines"))


def without_repeated_lines(docs: DataFrame, min_words: int = 5, percent: int = 80) -> DataFrame:
    """The documents without those lines, with their own columns. A document all of whose text is gone by this goes too; others stay."""
    gone = repeated_lines(docs, min_words, percent)
    lists = gone.groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_list("at")).alias("_removed"))
    lists = saved(lists.withColumnsRenamed({"doc_id": "_doc", "text_key": "_key"}), "lines-gone")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = docs.withColumn("_text_key", F.xxhash64(text))
    joined = keyed.join(lists, F.col("doc_id").cast("long").eqNullSafe(F.col("_doc")) & (F.col("_text_key") == F.col("_key")), "left")
    # The stretches of lines between those that go, so a document of many lines costs its length.
    every = F.split("text", "\n")
    ends = F.concat(F.array(F.lit(-1)), F.col("_removed"), F.array(F.size(every)))
    stretch = lambda k: F.slice(every, F.get(ends, k) + 2, F.get(ends, k + 1) - F.get(ends, k) - 1)
    left = F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.size("_removed")), stretch)), "\n")
    rebuilt = joined.withColumn("_left", F.when(F.col("_removed").isNotNull(), left))
    kept = rebuilt.filter(F.col("_left").isNull() | (F.trim(F.regexp_replace("_left", r"\s+", " ")) != ""))
    return kept.withColumn("text", F.coalesce("_left", "text")).select(*docs.columns)
