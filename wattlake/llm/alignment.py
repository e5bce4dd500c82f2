"""Two tokenizers side by side: groups of tokens that cover the same bytes, composed from fragments of byte ranges."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattlake.llm.common import saved
from wattlake.llm.tokens import _byte_letters

LOT = 1024  # texts whose words are in memory at once
SHIFT = 32  # a pair's code is (a << SHIFT) | b
FAN = 16  # fragments that one task composes into one
# White space above U+007F, as UTF-8.
_WIDE = [rb"\xc2\x85", rb"\xc2\xa0", rb"\xe1\x9a\x80", rb"\xe2\x80[\x80-\x8a\xa8\xa9\xaf]", rb"\xe2\x81\x9f", rb"\xe3\x80\x80"]
_NARROW = rb"[\x09-\x0d\x1c-\x20]"
# A single blank between two characters that are not white space: no token of either tokenizer crosses the place before it.
CUT = re.compile(
    b"".join(rb"(?<!" + w + rb")" for w in [_NARROW, *_WIDE]) + rb"(?<=.) (?=.)" + b"".join(rb"(?!" + w + rb")" for w in [_NARROW, *_WIDE]), re.DOTALL
)
# What makes some blank no cut; a text without it is cut at every blank.
IRREGULAR = re.compile(b"|".join([rb" " + _NARROW, _NARROW + rb" ", rb" $", *_WIDE]))


class Fragment(NamedTuple):
    """What a byte range of a text holds: an open prefix, closed groups, an open suffix.

    Tokens belong to the range in which they end. A place where tokens of both sides end closes a group. ``closed`` says whether the range has one: up
    to the first, tokens belong to the prefix and may need more to the left; after the last, to the suffix. Without one, all are prefix.
    Ids are comma-joined; ``groups`` are the whole groups after the prefix, joined by semicolons. ``compose`` is associative.
    """

    closed: bool
    before_a: bytes
    before_b: bytes
    groups: bytes
    after_a: bytes
    after_b: bytes

    def compose(self, right: Fragment) -> Fragment:
        if not right.closed:
            if self.closed:
                return self._replace(after_a=_ids(self.after_a, right.before_a), after_b=_ids(self.after_b, right.before_b))
            return self._replace(before_a=_ids(self.before_a, right.before_a), before_b=_ids(self.before_b, right.before_b))
        if not self.closed:
            return right._replace(before_a=_ids(self.before_a, right.before_a), before_b=_ids(self.before_b, right.before_b))
        seam = _ids(self.after_a, right.before_a) + b"|" + _ids(self.after_b, right.before_b)
        groups = b";".join(x for x in (self.groups, seam, right.groups) if x)
        return Fragment(True, self.before_a, self.before_b, groups, right.after_a, right.after_b)

    def text(self) -> bytes:
        """All groups of a whole text, whose prefix has nothing to its left."""
        first = self.before_a + b"|" + self.before_b
        return first + b";" + self.groups if self.groups else first


NOTHING = Fragment(False, b"", b"", b"", b"", b"")


def _ids(left: bytes, right: bytes) -> bytes:
    return left + b"," + right if left and right else left or right


def _joined(ids: np.ndarray) -> bytes:
    return ",".join(map(str, ids.tolist())).encode()


class Tokenizers:
    """Both tokenizers with the bytes of every token. Files are opened once per worker."""

    def __init__(self, byte_level: str, pieces: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_level)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces)
        back = {c: b for b, c in _byte_letters().items()}
        self.bytes_a = [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab().items():
            self.bytes_a[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]
        self.size_a, self.size_b = (np.array([len(x) for x in side]) for side in (self.bytes_a, self.bytes_b))
        self.digits = [str(i) for i in range(max(len(self.bytes_a), len(self.bytes_b)))]

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of blank+text on both sides; None where the bytes of either differ from it or the text is empty."""
        if not text:
            return None
        a = self.a.encode_batch_fast([" " + text], add_special_tokens=False)[0].ids
        b = self.b.encode(text)
        data = b" " + text.encode()
        same = b"".join(map(self.bytes_a.__getitem__, a)) == data and b"".join(map(self.bytes_b.__getitem__, b)) == data
        return (np.array(a, np.int64), np.array(b, np.int64)) if same else None


class Aligned(NamedTuple):
    """One range: token and group counts, codes of the linked pairs in turn, and its fragment."""

    n_a: int
    n_b: int
    n_groups: int
    links: list[int]
    fragment: Fragment


def aligned(a: np.ndarray, ends_a: np.ndarray, b: np.ndarray, ends_b: np.ndarray) -> Aligned:
    """Tokens of a range by id and end. Each place where both sides end closes a group and links its last two tokens."""
    _, at_a, at_b = np.intersect1d(ends_a, ends_b, assume_unique=True, return_indices=True)
    links = ((a[at_a] << SHIFT) | b[at_b]).tolist()
    if not links:
        return Aligned(len(a), len(b), 0, [], Fragment(False, _joined(a), _joined(b), b"", b"", b""))
    cuts_a, cuts_b = np.split(a, at_a + 1), np.split(b, at_b + 1)
    pairs = [_joined(x) + b"|" + _joined(y) for x, y in zip(cuts_a[1:-1], cuts_b[1:-1], strict=True)]
    whole = Fragment(True, _joined(cuts_a[0]), _joined(cuts_b[0]), b";".join(pairs), _joined(cuts_a[-1]), _joined(cuts_b[-1]))
    return Aligned(len(a), len(b), len(links), links, whole)


@dataclass
class Words:
    """Alignments of words, remembered: a text is cut at every single blank between characters that are not white space.

    No token of either side crosses such a place, so a word with the blank before it is a fragment closed at both ends, and those of a text compose in turn.
    """

    tokenizers: Tokenizers
    limit: int = 300_000
    known: dict[bytes, tuple | None] = field(default_factory=dict)

    def learn(self, words: list[bytes]) -> None:
        """Align words that are not known yet, many in one call; where bytes differ, the lot is halved until the words that differ stand alone."""
        digits = self.tokenizers.digits
        # A word with white space at an end (the first or last of a text) would run together with the blank beside it.
        bare = [w for w in words if w and (t := w.decode()).strip() == t]
        lots = [bare[i : i + 4096] for i in range(0, len(bare), 4096)]
        if len(bare) < len(words):
            lots += [[w] for w in set(words).difference(bare)]
        while lots:
            lot = lots.pop()
            ids = self.tokenizers.encode(b" ".join(lot).decode())
            if ids is None:
                if len(lot) == 1:
                    self.known[lot[0]] = None
                else:
                    lots += [lot[: len(lot) // 2], lot[len(lot) // 2 :]]
                continue
            a, b = ids
            ends_a, ends_b = self.tokenizers.size_a[a].cumsum(), self.tokenizers.size_b[b].cumsum()
            common, at_a, at_b = np.intersect1d(ends_a, ends_b, assume_unique=True, return_indices=True)
            links = ((a[at_a] << SHIFT) | b[at_b]).tolist()
            a, b, at_a, at_b = [digits[x] for x in a.tolist()], [digits[x] for x in b.tolist()], (at_a + 1).tolist(), (at_b + 1).tolist()
            groups, p, q = [], 0, 0
            for i, j in zip(at_a, at_b, strict=True):
                groups.append(f"{a[p]}|{b[q]}" if i - p == j - q == 1 else f"{','.join(a[p:i])}|{','.join(b[q:j])}")
                p, q = i, j
            stops = np.searchsorted(common, np.cumsum([len(w) + 1 for w in lot]), "right").tolist()
            begin = p = q = 0
            for word, stop in zip(lot, stops, strict=True):
                i, j = at_a[stop - 1], at_b[stop - 1]
                self.known[word] = (i - p, j - q, stop - begin, ";".join(groups[begin:stop]), tuple(links[begin:stop]))
                begin, p, q = stop, i, j

    def texts(self, lot: list[bytes | None]) -> list[tuple[int, int, int, str, Counter]]:
        """Per whole text: token and group counts, digest of the groups and the linked pairs with their numbers."""
        split = [self.split(b" " + t) if t else [] for t in lot]
        distinct = set().union(*split)
        if len(self.known) > self.limit:
            self.known = {w: self.known[w] for w in distinct & self.known.keys()}
        self.learn(list(distinct - self.known.keys()))
        out = []
        for words in split:
            found = list(map(self.known.__getitem__, words))
            if not found or None in found:
                out.append((0, 0, 0, "", Counter()))
                continue
            n_a, n_b, n_groups, groups, links = zip(*found, strict=True)
            digest = hashlib.sha256(";".join(groups).encode()).hexdigest()
            out.append((sum(n_a), sum(n_b), sum(n_groups), digest, Counter(chain.from_iterable(links))))
        return out

    def split(self, data: bytes) -> list[bytes]:
        """The words of blank+text."""
        if not IRREGULAR.search(data):
            return data[1:].split(b" ")
        words, at = [], 1
        for cut in CUT.finditer(data, 1):
            words.append(data[at : cut.start()])
            at = cut.end()
        words.append(data[at:])
        return words


_OPEN: dict[tuple[str, str], Words] = {}


def words_of(byte_level: str, pieces: str) -> Words:
    if (byte_level, pieces) not in _OPEN:
        _OPEN[byte_level, pieces] = Words(Tokenizers(byte_level, pieces))
    return _OPEN[byte_level, pieces]


def windows(data: bytes, size: int) -> list[tuple[int, int, int, int]]:
    """Byte ranges (low, high] of about ``size`` of blank+text, each with the window [start, stop) between cuts around it.

    A range in which no cut lies is joined to the one before it, so that no stretch is read twice.
    """
    out, low, start = [], 0, 0
    while low < len(data):
        high = min(low + size, len(data))
        found = CUT.search(data, high) if high < len(data) else None
        stop = found.start() if found else len(data)
        if not found:
            high = len(data)
        out.append((low, high, start, stop))
        if high == len(data):
            break
        # The last cut at or before the range's end starts the next window.
        span = 256
        while not (cuts := [c.start() for c in CUT.finditer(data, max(0, high - span), min(len(data), high + 8)) if c.start() <= high]) and span < high - start:
            span *= 4
        if cuts and cuts[-1] > start:
            start = cuts[-1]
        elif stop < len(data):
            out[-1] = (low, stop, out[-1][2], stop)
            high = start = stop
        low = high
    return out


def _short(docs: DataFrame, files: tuple[str, str]) -> DataFrame:
    def align(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = words_of(*files)
        for batch in batches:
            for at in range(0, len(batch), LOT):
                lot = batch.iloc[at : at + LOT]
                rows = [(*x, list(counts), list(counts.values())) for *x, counts in words.texts(lot["text"].tolist())]
                out = pd.DataFrame(rows, columns=["n_a", "n_b", "n_groups", "groups_sha256", "pairs", "often"])
                out.insert(0, "doc_id", lot["doc_id"].to_numpy())
                yield out

    return docs.select("doc_id", "text").mapInPandas(align, f"doc_id long, {_COUNTS}, groups_sha256 string, {_PAIRS}")


_COUNTS = "n_a long, n_b long, n_groups long"
_PAIRS = "pairs array<long>, often array<long>"
_FRAGMENT = "whole boolean, closed boolean, before_a binary, before_b binary, groups binary, after_a binary, after_b binary"


def _long(docs: DataFrame, files: tuple[str, str], chunk_bytes: int) -> DataFrame:
    """Texts of many chunks: ranges go to different tasks, and rounds of sixteen neighbours compose their fragments."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row, doc, text in zip(batch["row"], batch["doc_id"], batch["text"], strict=True):
                data = b" " + text
                parts = windows(data, chunk_bytes)
                for i, (low, high, start, stop) in enumerate(parts):
                    yield pd.DataFrame({"row": [row], "doc_id": [doc], "chunk": [i], "low": [low - start], "high": [high - start], "data": [data[start:stop]]}).astype({"doc_id": "Int64"})

    rows = docs.withColumn("row", F.monotonically_increasing_id())
    chunks = saved(rows.mapInPandas(cut, "row long, doc_id long, chunk long, low long, high long, data binary"), "alignment-chunks")

    def align(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokenizers = words_of(*files).tokenizers
        for batch in batches:
            out = []
            for low, high, data in zip(batch["low"], batch["high"], batch["data"], strict=True):
                ids = tokenizers.encode(data[1:].decode())
                if ids is None:
                    out.append((0, 0, 0, [], [], False, *NOTHING))
                    continue
                inside = []
                for side, sizes in zip(ids, (tokenizers.size_a, tokenizers.size_b), strict=True):
                    ends = sizes[side].cumsum()
                    mine = (ends > low) & (ends <= high)
                    inside += [side[mine], ends[mine]]
                got = aligned(*inside)
                counts = Counter(got.links)
                out.append((got.n_a, got.n_b, got.n_groups, list(counts), list(counts.values()), True, *got.fragment))
            names = ["n_a", "n_b", "n_groups", "pairs", "often", "whole", *Fragment._fields]
            yield pd.concat([batch[["row", "doc_id", "chunk"]].astype({"doc_id": "Int64"}), pd.DataFrame(out, columns=names, index=batch.index)], axis=1)

    schema = f"row long, doc_id long, chunk long, {_COUNTS}, {_PAIRS}, {_FRAGMENT}"
    spread = chunks.repartition("row", "chunk")
    parts = saved(spread.mapInPandas(align, schema), "alignment-fragments")

    def compose(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("chunk")
        total = NOTHING
        for values in rows[list(Fragment._fields)].itertuples(index=False):
            total = total.compose(Fragment(*values))
        first = rows.iloc[:1]
        sums = {c: [int(rows[c].sum())] for c in ("n_a", "n_b", "n_groups")}
        head = {"row": first["row"].to_numpy(), "doc_id": first["doc_id"].astype("Int64").to_numpy(), "chunk": [int(first["chunk"].iat[0]) // FAN]}
        return pd.DataFrame(head | sums | {"whole": [bool(rows["whole"].all())]} | {c: [v] for c, v in zip(Fragment._fields, total, strict=True)})

    level = parts.drop("pairs", "often")
    kind = f"row long, doc_id long, chunk long, {_COUNTS}, {_FRAGMENT}"
    most, turn = parts.agg(F.max("chunk")).first()[0], 0
    while most is not None:
        turn += 1
        level = level.groupBy("row", F.floor(F.col("chunk") / FAN)).applyInPandas(compose, kind)
        if (most := most // FAN) == 0:
            break
        level = saved(level, f"alignment-level-{turn}")

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [Fragment(*f).text() for f in batch[list(Fragment._fields)].itertuples(index=False)]
            yield pd.DataFrame({"row": batch["row"], "groups_sha256": [hashlib.sha256(t).hexdigest() for t in texts]})

    level = saved(level, "alignment-whole")
    good = level.filter("whole")
    digests = good.mapInPandas(digest, "row long, groups_sha256 string")
    # One row a (text, chunk, pair) inside a task becomes one a (text, pair) before it is shuffled; a text has few pairs.
    counts = parts.join(good.select("row"), "row").select("row", F.explode(F.arrays_zip("pairs", "often")).alias("p"))
    counts = counts.groupBy("row", "p.pairs").agg(F.sum("p.often").alias("often"))
    counts = counts.groupBy("row").agg(F.collect_list(F.struct("pairs", "often")).alias("c")).select("row", F.col("c.pairs").alias("pairs"), F.col("c.often").alias("often"))
    known = digests.join(counts, "row", "left")
    zero = lambda c: F.when(F.col("whole"), F.col(c)).otherwise(F.lit(0)).alias(c)
    none = F.array().cast("array<long>")
    return level.join(known, "row", "left").select(
        "doc_id", zero("n_a"), zero("n_b"), zero("n_groups"), F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"),
        F.coalesce("pairs", none).alias("pairs"), F.coalesce("often", none).alias("often"),
    )


def align_documents(
    docs: DataFrame, byte_level: str, pieces: str, chunk_bytes: int = 65_536, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A is the byte-level tokenizer on blank+text, B the piece tokenizer on text. Places where tokens of both end cut a text into groups; the two tokens that
    end there are linked. Counts of linked id pairs are taken over all documents, and each document reports how many of its links have the
    highest count of their B id (ties included), and the sum of its links' counts.

    Byte ranges yield fragments (open prefix, closed groups, open suffix) that compose associatively. Of a text up to ``chunk_bytes`` the fragments are its
    words, remembered per worker; a longer one is cut into ranges of that size, aligned in different tasks and composed in rounds of
    sixteen neighbours. A stretch without a blank is one range.

    The pair counts are broadcast: of two tokens that end together one's bytes end the other's, so there are no more pairs than bytes in both
    vocabularies, some hundred thousand, whatever the corpus.

    Null and empty texts, and those whose token bytes differ from blank+text, have no tokens: zeros and an empty digest. Rows that repeat are documents of
    their own and count for each other's pairs; other columns are ignored; an empty table gives no row.
    """
    files = (byte_level, pieces)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    small = F.coalesce(F.octet_length("text"), F.lit(0)) < chunk_bytes
    done = _short(rows.filter(small), files).unionByName(_long(rows.filter(~small), files, chunk_bytes))
    done = saved(done.withColumn("row", F.monotonically_increasing_id()), "alignment-documents")

    links = done.select("row", F.explode(F.arrays_zip("pairs", "often")).alias("p")).select("row", "p.pairs", "p.often")
    counted = saved(links.groupBy("pairs").agg(F.sum("often").alias("n")), "alignment-pairs")
    b_id = F.col("pairs").bitwiseAND((1 << SHIFT) - 1)
    highest = counted.groupBy(b_id.alias("b")).agg(F.max("n").alias("top"))
    judged = counted.withColumn("b", b_id).join(highest, "b").select("pairs", "n", (F.col("n") == F.col("top")).alias("best"))
    # The bound on the pairs is in the docstring.
    scored = links.join(F.broadcast(judged), "pairs").groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("often")).otherwise(0)).alias("n_best"), F.sum(F.col("often") * F.col("n")).alias("count_sum")
    )
    zero = F.lit(0).cast("long")
    return done.drop("pairs", "often").join(scored, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), F.coalesce("n_best", zero).alias("n_best"),
        F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256",
    )
