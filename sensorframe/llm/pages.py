"""Operator 9: the main text of web pages by differencing with the nearest pages of the host.

Pages are put in order of host and URL path, copies on a host as one; each is compared with the nearest unlike pages there. Text
lines are aligned by longest common subsequence, and lines that both pages have are deleted. Inside an article element a line that two
pages have may be quoted by both: it goes if all of the nearest pages have it whose articles aren't copies. Lines in elements that are beside an article by their kind (menus, footers, adverts
...) go too, for pages without a neighbour and for adverts that change from page to page.
"""

from __future__ import annotations

import re
from hashlib import blake2b
from itertools import takewhile
from urllib.parse import unquote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorframe.llm.common import arrow_rows, stage
from sensorframe.llm.html_lines import DROPPED, INSIDE, OUTSIDE, lines

_URL = re.compile(r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)(?::\d*)?([^?#]*)")
_NUMBER = re.compile(r"\d+")
# Distinct pages that are compared in one group, and how many more of each side it sees.
GROUP, BORDER = 64, 16
# Pages that must all have a line for it to be the template of articles, and the share of an article that makes two copies.
WITNESSES, COPY_PERCENT = 16, 80


def host_and_path(url: str | None) -> tuple[str, str]:
    """Host in lower case, and the path without its ending, numbers written so that they sort by value."""
    m = _URL.match(url or "")
    host, path = (m.group(1).lower(), m.group(2)) if m else ("", (url or "").split("?")[0].split("#")[0])
    path = re.sub(r"(?:/index)?\.(?:html?|php|aspx?)$", "", unquote(path).rstrip("/"))
    return host, _NUMBER.sub(lambda n: f"{len(n.group()):04d}{n.group()}", path)


def common(a: list[str], b: list[str]) -> list[bool]:
    """Which lines of ``a`` are in a longest common subsequence with ``b``; bit-parallel, one whole-number row for each line of ``a``."""
    where: dict[str, int] = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    row, rows = full, []
    for x in a:
        met = row & where.get(x, 0)
        row = ((row + met) | (row - met)) & full
        rows.append(row)
    shared = [False] * len(a)
    i, j = len(a), len(b)
    while i and j:
        if rows[i - 1] >> (j - 1) & 1:
            j -= 1
        else:
            i -= 1
            if i == 0 or rows[i - 1] >> (j - 1) & 1:
                shared[i] = True
                j -= 1
    return shared


def copied(place: list[int], size: list[int], shared: list[bool], partner: dict) -> bool:
    """Whether two articles are copies, by the characters of the smaller one that they share."""
    both, own, other = (sum(n for n, p, s in zip(sizes, kinds, of) if p == INSIDE and s) for sizes, kinds, of in ((size, place, shared), (size, place, [True] * len(size)), (partner["sizes"], partner["kinds"], [True] * len(partner["sizes"]))))
    return 100 * both >= COPY_PERCENT * min(own, other or own)


def deleted(page: dict, sides: list[list[dict]]) -> list[int]:
    """Which lines of a page go; each side has its other pages of the host from the nearest on.

    Outside of articles a line goes that the nearest unlike page of a side has too. Inside, pages quote common lines: a line goes
    if all of the nearest WITNESSES pages have it that aren't copies of the article, at least two.
    """
    own, place, size = page["keys"], page["kinds"], page["sizes"]
    drop = set()
    has_inside = INSIDE in place
    met: dict[tuple[int, int], list[bool]] = {}

    def shared_with(s: int, k: int) -> list[bool]:
        if (s, k) not in met:
            met[s, k] = common(own, sides[s][k]["keys"])
        return met[s, k]

    for s, side in enumerate(sides):
        for k in range(len(side) if OUTSIDE in place else 0):
            shared = shared_with(s, k)
            # A page that would lose everything is part of this one, which tells nothing; the next one is asked.
            if has_inside or not all(shared):
                drop.update(i for i, x in enumerate(shared) if x and place[i] == OUTSIDE)
                break
    if has_inside:
        left, witnesses = [i for i, p in enumerate(place) if p == INSIDE], 0
        for k, s in sorted((k, s) for s, side in enumerate(sides) for k in range(len(side))):
            shared = shared_with(s, k)
            if not copied(place, size, shared, sides[s][k]):
                left = [i for i in left if shared[i]]
                witnesses += 1
                if witnesses == WITNESSES or not left:
                    break
        if witnesses >= 2:
            drop.update(left)
    return sorted(drop)


def main_text(own: list[str], place: list[int], gone: list[int] | None) -> str:
    """A page's text without lines beside the article and without the deleted ones, which are numbered among the others."""
    lines_, gone = [x for x, p in zip(own, place) if p != DROPPED], set(gone or ())
    return "\n\n".join(x for k, x in enumerate(lines_) if k not in gone)


def _key(line: str) -> int:
    return int.from_bytes(blake2b(line.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _numbered(df: DataFrame, order: list[str]) -> DataFrame:
    """``df`` with its place ``pos`` in the order of some columns. Rows are sorted by range, numbered in each range, and the ranges' sizes added up."""
    schema = pa.schema([("part", pa.int32()), ("row", pa.int64()), ("uid", pa.int64()), ("host", pa.string())])

    def run(batches):
        part, row = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array([part] * n, pa.int32()), pa.array(range(row, row + n), pa.int64()), batch.column("uid"), batch.column("host")], schema=schema)
            row += n

    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).select("uid", "host")
    rows = stage(ranged.mapInArrow(run, "part int, row bigint, uid bigint, host string"), "order")
    # One row per range.
    total, starts = 0, []
    for r in sorted(rows.groupBy("part").agg(F.max("row").alias("last")).collect()):
        starts.append((r.part, total))
        total += r.last + 1
    start = df.sparkSession.createDataFrame(starts, "part int, start bigint")
    return rows.join(F.broadcast(start), "part").select("uid", "host", (F.col("start") + F.col("row")).alias("pos"))


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row.

    A null or empty html has empty text. A null or odd url belongs to the host without name. Repeated rows and other copies are
    one page for the comparison and get the same text. An empty table gives no rows; other columns are not looked at.
    """
    def run(page_id, url, html):
        context = TaskContext.get()
        at = (context.taskAttemptId(), context.partitionId())
        row = counter.get(at, 0)
        out = {"page_id": page_id, "url": url, "uid": [], "host": [], "path": [], "lines": [], "place": [], "keys": [], "digest": []}
        for u, h in zip(url, html):
            host, path = host_and_path(u)
            found = lines(h)
            keys = [_key(x) for x, p in found if p != DROPPED]
            kinds = bytes(p for _, p in found if p != DROPPED)
            out["uid"].append(context.partitionId() << 40 | row)
            out["host"].append(host)
            out["path"].append(path)
            out["lines"].append([x for x, _ in found])
            out["place"].append([p for _, p in found])
            out["keys"].append(keys)
            out["digest"].append(blake2b(repr((host, keys, kinds)).encode("utf-8", "surrogatepass"), digest_size=16).digest() if keys else None)
            row += 1
        counter.clear()
        counter[at] = row
        return out

    counter: dict = {}
    schema = "page_id bigint, url string, uid bigint, host string, path string, lines array<string>, place array<int>, keys array<bigint>, digest binary"
    split = stage(arrow_rows(pages, ["page_id", "url", "html"], schema, run), "lines")
    # Pages of a host with the same lines are one, at the place of the first.
    distinct = split.where("digest is not null").groupBy("host", "digest").agg(F.min(F.struct("path", "page_id", "uid")).alias("first")).select("host", "first.*")
    place = _numbered(distinct, ["host", "path", "page_id", "uid"])
    # Hashes of lines are moved, never texts: each page to its group, and to the groups beside it where it is near their border.
    kept = F.filter("place", lambda p: p != DROPPED).alias("kinds")
    sizes = F.transform(F.filter("lines", lambda x, i: F.get("place", i) != DROPPED), F.length).alias("sizes")
    met = split.select("uid", "digest", "keys", kept, sizes).join(place, "uid").drop("uid")
    spread = F.array_distinct(F.array(*(F.floor((F.col("pos") + d) / GROUP) for d in (-BORDER, 0, BORDER))))
    met = met.withColumn("group", F.explode(spread))

    def compare(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["pos"])
        out = []
        for at, r in enumerate(rows):
            if r["pos"] // GROUP == r["group"]:
                sides = [list(takewhile(lambda x: x["host"] == r["host"], side)) for side in (reversed(rows[max(0, at - BORDER):at]), rows[at + 1:at + 1 + BORDER])]
                gone = deleted(r, sides)
                if gone:
                    out.append({"digest": r["digest"], "gone": gone})
        return pa.Table.from_pylist(out, schema=pa.schema([("digest", pa.binary()), ("gone", pa.list_(pa.int32()))]))

    gone = stage(met.groupBy("group").applyInArrow(compare, "digest binary, gone array<int>"), "gone_distinct")
    # Written, so that its size is known: where few pages have such lines, the page texts are not moved for the join.
    gone = stage(split.select("uid", "digest").join(gone, "digest").select("uid", "gone"), "gone")
    done = split.select("page_id", "url", "uid", "lines", "place").join(gone, "uid", "left")

    def finish(page_id, url, own_lines, where_, gone_):
        text = [main_text(*x) for x in zip(own_lines, where_, gone_)]
        return {"page_id": page_id, "url": url, "text": text, "n_chars": [len(t) for t in text]}

    return arrow_rows(done, ["page_id", "url", "lines", "place", "gone"], "page_id bigint, url string, text string, n_chars bigint", finish)
