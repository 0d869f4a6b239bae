"""Operator 5: near-duplicate classes by MinHash.

1. Every text gives its set of word shingles as 64-bit hashes, the minima of many universal hashes, and band keys of these.
2. Texts with equal sets form one class, which goes on as its smallest document.
3. Members of a band's bucket are tied to the bucket's smallest member: as many ties as members, never all pairs. The
   connected ties are the candidate clusters; the number of bands (51 of 7 hashes at 0.85) is such that two texts at the
   threshold meet in no bucket in 4 of a thousand million cases.
4. Each cluster is compared inside, in blocks of bounded size: first by signature, then on full sets. Only the links that
   join something new go on.
5. Components of the confirmed links by alternating large-star and small-star.
"""

from __future__ import annotations

import hashlib
import math
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorframe.llm.byte_bpe import _Words
from sensorframe.llm.common import arrow_append, arrow_rows, own_names, stage
from sensorframe.llm.components import components

WIDTH = 5
ROWS = 7
# The chance that two texts exactly at the threshold meet in no bucket.
MISS = 4e-9
# Documents compared at once are two blocks of this many at most.
BLOCK = 400
_MIX = np.uint64(0x9E3779B97F4A7C15)
_SHIFT = np.uint64(29)


def _word_hash(word: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(word)


_HASHES = _Words(_word_hash)


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of the word windows of a text; of all words, where they are fewer than ``width``."""
    words = text.encode().lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    width = min(width, len(w))
    h = np.full(len(w) - width + 1, width, np.uint64)
    for j in range(width):
        h = (h ^ w[j:len(w) - width + 1 + j]) * _MIX
        h ^= h >> _SHIFT
    return np.unique(h)


def band_count(percent: int) -> int:
    """Bands of ROWS hashes that two texts at the threshold miss with a chance of MISS."""
    if not 50 <= percent <= 100:
        raise ValueError("the threshold is from 50 to 100 percent")
    return 1 if percent == 100 else math.ceil(math.log(MISS) / math.log(1 - (percent / 100) ** ROWS))


@cache
def _hashes(many: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    return rng.integers(1, 2**63, (many, 1), np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, (many, 1), np.uint64)


def minima(s: np.ndarray, many: int) -> np.ndarray:
    """The smallest value of each of ``many`` universal hashes over a set that isn't empty."""
    times, plus = _hashes(many)
    low = None
    for at in range(0, len(s), 1024):
        x = ((times * s[None, at:at + 1024] + plus) >> np.uint64(32)).min(axis=1)
        low = x if low is None else np.minimum(low, x)
    return low


def band_keys(low: np.ndarray) -> np.ndarray:
    rows = low.reshape(-1, ROWS)
    key = np.arange(1, len(rows) + 1, dtype=np.uint64) * _MIX
    for j in range(ROWS):
        key = (key ^ rows[:, j]) * _MIX
        key ^= key >> _SHIFT
    return key.view(np.int64)


def signatures(documents: DataFrame, width: int, bands: int) -> DataFrame:
    """``doc_id, n, digest, signature, bands`` of every text; without words the last three are null."""
    def run(doc_id, text):
        out = {"doc_id": doc_id, "n": [], "digest": [], "signature": [], "bands": []}
        for t in text:
            s = shingles(t, width)
            out["n"].append(len(s))
            low = minima(s, bands * ROWS) if len(s) else None
            out["digest"].append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
            out["signature"].append(low.astype(np.uint8).tobytes() if len(s) else None)
            out["bands"].append(band_keys(low) if len(s) else None)
        return out

    return arrow_rows(documents, ["doc_id", "text"], "doc_id bigint, n bigint, digest binary, signature binary, bands array<bigint>", run)


def confirmed(ids: np.ndarray, sets: list[np.ndarray], sigs: np.ndarray, first: np.ndarray, second: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links between ``first`` and ``second`` (positions) that join something new, each with its two ids."""
    n = np.array([len(s) for s in sets])
    up = list(range(len(ids)))

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    # Six standard deviations below the threshold; equal low bytes of different minima only add.
    k = sigs.shape[1]
    j = percent / 100
    least = k * j - 6.3 * (k * j * (1 - j)) ** 0.5
    found = []
    for a in first:
        other = second[second > a] if first is second else second
        other = other[(np.minimum(n[other], n[a]) * 100 >= percent * np.maximum(n[other], n[a]))]
        if len(other):
            same = (sigs[other] == sigs[a]).sum(axis=1)
            keep = same >= least
            found += zip((-same[keep]).tolist(), [int(a)] * int(keep.sum()), other[keep].tolist())
    links = []
    for _, a, b in sorted(found):
        ra, rb = root(a), root(b)
        if ra != rb:
            both = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
            if 100 * both >= percent * (n[a] + n[b] - both):
                up[ra] = rb
                links.append((ids[a], ids[b]))
    return links


def _linked(documents: DataFrame, known: DataFrame, classes: DataFrame, width: int, percent: int, block: int) -> DataFrame:
    """Confirmed links ``u, v`` between the nodes of ``classes``: rows ``digest, rep, node``, of each class its smallest document."""
    # One row for each class: that of its smallest document.
    reps = known.join(classes.withColumnRenamed("rep", "doc_id"), ["digest", "doc_id"]).dropDuplicates(["digest"])
    reps = stage(reps.select("node", "doc_id", "digest", "n", "signature", "bands"), "reps")

    keyed = reps.select(F.explode("bands").alias("key"), F.col("node").alias("u"))
    hubs = keyed.groupBy("key").agg(F.min("u").alias("v"), F.max("u").alias("most")).where("v < most").drop("most")
    ties = keyed.join(hubs, "key").where("u <> v").select("u", "v")
    clusters = stage(components(ties), "clusters")

    sizes = clusters.groupBy("component").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    members = clusters.join(sizes, "component").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    members = members.join(reps.drop("bands"), "node")
    texts = documents.select(F.col("doc_id").alias("id"), "text")
    members = members.join(texts, F.col("doc_id") == F.col("id")).drop("id")
    # A document goes to each pair of blocks that its own is one of.
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    members = members.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        # Another text of the same doc_id is not this class.
        sets, rows = [], []
        seen = set()
        for r, (text, digest) in enumerate(zip(pdf["text"], pdf["digest"])):
            if digest in seen:
                continue
            s = shingles(text, width)
            if hashlib.blake2b(s.tobytes(), digest_size=16).digest() == digest:
                seen.add(digest)
                sets.append(s)
                rows.append(r)
        pdf = pdf.iloc[rows]
        own, i, j = pdf["own"].to_numpy(), pdf["i"].iloc[0], pdf["j"].iloc[0]
        low = np.flatnonzero(own == i)
        high = low if i == j else np.flatnonzero(own == j)
        sig = np.frombuffer(b"".join(pdf["signature"]), np.uint8).reshape(len(pdf), -1)
        return pd.DataFrame(confirmed(pdf["node"].to_numpy(), sets, sig, low, high, percent), columns=["u", "v"])

    links = members.select("component", "i", "j", "own", "node", "digest", "signature", "text")
    return links.groupBy("component", "i", "j").applyInPandas(compare, "u bigint, v bigint")


def near_duplicates(documents: DataFrame, width: int = WIDTH, percent: int = 85, block: int = BLOCK) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row.

    A null, empty or wordless text has no shingles and is linked with nothing. Rows that repeat a doc_id are one document
    with several texts and get the same component. A row without doc_id takes no part: its component is null and it is
    kept. An empty table gives no rows. Columns other than doc_id and text are not looked at.
    """
    sigs = stage(signatures(documents, width, band_count(percent)), "signatures")
    known = sigs.where("doc_id is not null and digest is not null")
    classes = stage(known.groupBy("digest").agg(F.min("doc_id").alias("rep")), "classes")
    links = _linked(documents, known, classes.withColumn("node", F.col("rep")), width, percent, block)
    # A doc_id with several texts ties their classes.
    of_doc = known.join(classes, "digest").select("doc_id", "rep").distinct()
    several = of_doc.groupBy("doc_id").agg(F.min("rep").alias("v"), F.max("rep").alias("most")).where("v < most")
    same_id = of_doc.join(several, "doc_id").select(F.col("rep").alias("u"), "v")
    found = stage(components(links.union(same_id)), "found")

    least = classes.join(found, F.col("rep") == F.col("node"), "left").select("digest", F.coalesce("component", "rep").alias("component_id"))
    out = sigs.select("doc_id", F.col("n").alias("n_shingles"), "digest").join(least, "digest", "left")
    out = out.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep(documents: DataFrame, width: int = WIDTH, percent: int = 85, block: int = BLOCK) -> DataFrame:
    """One row of each group of near-duplicates; all columns as they were.

    Rows are told apart by doc_id and text: unlike texts of one doc_id are not near each other. Of a group the class with the
    smallest doc_id stays, and of its rows with that doc_id the first by all columns. Rows without doc_id or words stay, null texts
    among them; an empty table gives no rows; names of other columns may be any.
    """
    names = documents.columns
    documents = own_names(documents, "doc_id", "text")
    sigs = stage(signatures(documents.select("doc_id", "text"), width, band_count(percent)), "signatures")
    known = sigs.where("doc_id is not null and digest is not null")
    # Numbered, as a doc_id may be the smallest of several classes; written, so that the numbers hold.
    classes = stage(known.groupBy("digest").agg(F.min("doc_id").alias("rep")).withColumn("node", F.monotonically_increasing_id()), "classes")
    found = stage(components(_linked(documents, known, classes, width, percent, block)), "found")
    group = F.coalesce("component", "node").alias("group")
    first = classes.join(found, "node", "left").groupBy(group).agg(F.min(F.struct("rep", "digest")).alias("first"))
    pairs = stage(first.select(F.col("first.rep").alias("doc_id"), "first.digest"), "kept")

    ids = pairs.select("doc_id").union(sigs.where("doc_id is not null and digest is null").select("doc_id")).distinct()
    repeated = stage(sigs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    stays = documents.where("doc_id is not null").join(ids, "doc_id", "left_semi").select(documents.columns)
    single = stays.join(repeated, "doc_id", "left_anti").select(documents.columns)

    def digest(text):
        return {"digest": [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s := shingles(t, width)) else None for t in text]}

    # Only rows of repeated ids are looked at once more.
    row = F.struct(*documents.columns)
    again = stays.join(repeated, "doc_id", "left_semi").select(row.alias("row"), "doc_id", "text")
    again = arrow_append(again, ["text"], "digest binary", digest)
    one = again.join(pairs, ["doc_id", "digest"], "left_semi").groupBy("doc_id", "digest").agg(F.min_by("row", F.to_json("row")).alias("row"))
    return single.union(one.select("row.*")).union(again.where("digest is null").select("row.*")).union(documents.where("doc_id is null")).toDF(*names)
