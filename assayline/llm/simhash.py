"""SimHash near-duplicates: 64-bit fingerprints linked by a binary trie self-join.

Two fingerprints within ``budget`` bits agree on at least one of ``budget + 1`` equal
parts, so the trie is entered below each part once (the fingerprint is rotated to
put the part first): fingerprints with the same part are a node.  A node is joined
with itself by walking pairs of subtrees together, adding one error where their
branches differ and dropping a pair beyond the budget.  Nodes of usual size are
walked inside tasks; larger ones are first split, in Spark, into pairs of subtrees
``STEP`` bits deeper, until all are of usual size (at 64 bits a subtree is one
fingerprint).

Only distinct fingerprints are joined, and a task returns a spanning forest of the
links that it found: thousands of copies cost one row, thousands of near copies one
link each.  :func:`graph.components` joins the forests.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from assayline.llm.common import pin
from assayline.llm.graph import components

BITS = 64
SEED = 42
#: Fingerprints of a node that one task walks at a time; larger nodes are split.
NODE_ROWS = 4096
#: Bits by which a large node is split.
STEP = 8
#: Pairs of fingerprints compared in one vector operation.
PAIRS = 1 << 20
#: Rows gathered, at a node's end, before they are walked.
ROWS = 1 << 17


def fingerprint(text: bytes | None, shingle: int = 3) -> int:
    """A bit is 1 if more than half of the shingles' XXH64 have it; no words: 0; fewer words than a shingle: one shingle."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < shingle:
        return xxh64_intdigest(joined, SEED)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    start = (end - size)[: len(words) - shingle + 1].tolist()
    pieces = [joined[a:b] for a, b in zip(start, end[shingle - 1 :].tolist(), strict=True)]
    h = np.fromiter(map(xxh64_intdigest, pieces, repeat(SEED)), ">u8", len(pieces))
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big")


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, fp): one row per row of ``docs``."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(t.as_py(), shingle) for t in b.column("text")), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    return rows.mapInArrow(each, "doc_id long, fp long")


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


class Forest:
    """Union of links among ``n`` places, kept as each place's smallest linked place."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        root = self.root
        while True:
            a, b = root[i], root[j]
            apart = a != b
            if not apart.any():
                return
            i, j = i[apart], j[apart]
            high, low = np.maximum(a, b)[apart], np.minimum(a, b)[apart]
            np.minimum.at(root, high, low)
            while not np.array_equal(up := root[root], root):
                root[:] = up


def crossed(a0: np.ndarray, a1: np.ndarray, b0: np.ndarray, b1: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All (i, j) with i in [a0, a1) and j in [b0, b1), pair by pair of ranges, at most about ``PAIRS`` at a time."""
    sizes = (a1 - a0) * (b1 - b0)
    ends = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
        which = np.repeat(np.arange(at, to), sizes[at:to])
        k = np.arange(len(which)) - np.repeat(ends[at:to] - sizes[at:to] - (ends[at - 1] if at else 0), sizes[at:to])
        width = (b1 - b0)[which]
        yield a0[which] + k // width, b0[which] + k % width
        at = to


def walk(node: np.ndarray, side: np.ndarray, value: np.ndarray, budget: int) -> np.ndarray:
    """Roots (places) after linking, in each node, values within the budget.

    Rows are sorted by (node, side, value).  A node with one side is joined with
    itself, one with two sides across.  Ranges of rows are subtrees: with the ones of
    a bit counted from the start, the split of any number of ranges is one subtraction.
    Values are whole, so errors are counted from the first bit, whatever a node was split by.
    """
    n = len(value)
    forest = Forest(n)
    key = np.flatnonzero(np.concatenate(([True], (node[1:] != node[:-1]) | (side[1:] != side[:-1])))) if n else np.empty(0, np.int64)
    stop = np.append(key[1:], n)
    first = np.concatenate(([True], node[key[1:]] != node[key[:-1]])) if n else np.empty(0, bool)
    two = np.append(~first[1:], False) if n else first
    lone = first & ~two & (side[key] == 0)
    a0 = np.concatenate((key[lone], key[two]))
    a1 = np.concatenate((stop[lone], stop[two]))
    b0 = np.concatenate((key[lone], key[np.flatnonzero(two) + 1]))
    b1 = np.concatenate((stop[lone], stop[np.flatnonzero(two) + 1]))
    e = np.zeros(len(a0), np.int64)
    for bit in range(BITS - 1, -2, -1):
        small = ((a1 - a0) * (b1 - b0) <= 256) | (bit < 0)
        for i, j in crossed(a0[small], a1[small], b0[small], b1[small]):
            near = distance(value[i], value[j]) <= budget
            forest.add(i[near], j[near])
        a0, a1, b0, b1, e = (x[~small] for x in (a0, a1, b0, b1, e))
        if not len(a0) or bit < 0:
            break
        ones = np.concatenate(([0], np.cumsum((value >> np.uint64(bit)) & np.uint64(1)).astype(np.int64)))
        am, bm = a1 - (ones[a1] - ones[a0]), b1 - (ones[b1] - ones[b0])
        own = a0 == b0
        x = ~own
        parts = [(a0, am, b0, bm, e), (am, a1, bm, b1, e), (a0, am, bm, b1, e + 1), (am[x], a1[x], b0[x], bm[x], e[x] + 1)]
        a0, a1, b0, b1, e = (np.concatenate(p) for p in zip(*parts, strict=True))
        go = (a1 > a0) & (b1 > b0) & (e <= budget) & ~((a0 == b0) & (a1 - a0 < 2))
        a0, a1, b0, b1, e = (p[go] for p in (a0, a1, b0, b1, e))
    return forest.root


def _rotated(fp: str, by: int) -> F.Column:
    return F.col(fp) if not by else F.shiftleft(fp, by).bitwiseOR(F.shiftrightunsigned(fp, BITS - by))


def _bits(value: str, skip: int, n: int) -> F.Column:
    """``n`` bits after the first ``skip``, as a number."""
    return F.shiftrightunsigned(F.shiftleft(value, skip) if skip else F.col(value), BITS - n)


def _split(large: DataFrame, depth: int, budget: int) -> DataFrame:
    """Rows of large nodes, in all pairs of subtrees ``STEP`` bits deeper that the budget allows."""
    masks = [m for m in range(1 << STEP) if m.bit_count() <= budget]
    mask = F.explode(F.array(*[F.struct(F.lit(m).cast("long").alias("mask"), F.lit(m.bit_count()).alias("more")) for m in masks])).alias("m")
    own = _bits("value", depth, STEP)
    rows = large.select("*", own.alias("own"), mask).where(F.col("err") + F.col("m.more") <= budget)
    other = F.col("own").bitwiseXOR(F.col("m.mask"))
    # A node that is joined with itself has each pair twice, as (a, b) and (b, a): sides go by order.  Else the first side leads.
    low = F.when(F.col("two"), F.when(F.col("side") == 0, F.col("own")).otherwise(other)).otherwise(F.least("own", other))
    high = F.when(F.col("two"), F.when(F.col("side") == 0, other).otherwise(F.col("own"))).otherwise(F.greatest("own", other))
    side = F.when(F.col("two"), F.col("side")).otherwise((F.col("own") > other).cast("int"))
    out = rows.select(F.concat_ws("/", "node", F.hex(low), F.hex(high)).alias("node"), side.alias("side"), "value", (F.col("err") + F.col("m.more")).alias("err"))
    return out


def _sizes(rows: DataFrame) -> DataFrame:
    """(node, n, two): rows and whether both sides are there."""
    return rows.groupBy("node").agg(F.count(F.lit(1)).alias("n"), (F.min("side") != F.max("side")).alias("two"))


def near_links(values: DataFrame, budget: int = 3, node_rows: int = NODE_ROWS) -> DataFrame:
    """Links (u, v) among the distinct fingerprints ``values`` (fp) that connect all pairs within ``budget`` bits, without listing them all."""
    part = BITS // (budget + 1)

    def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def links(rows: pa.Table) -> pa.RecordBatch:
            value = rows["value"].to_numpy().view(np.uint64)
            names = rows["node"].combine_chunks().dictionary_encode().indices.to_numpy()
            root = walk(names, rows["side"].to_numpy(), value, budget)
            fp = rows["fp"].to_numpy()
            linked = np.flatnonzero(root != np.arange(len(root)))
            return pa.RecordBatch.from_arrays([pa.array(fp[linked]), pa.array(fp[root[linked]])], ["u", "v"])

        for b in batches:
            held.append(pa.Table.from_batches([b]))
            if sum(t.num_rows for t in held) < ROWS:
                continue
            rows = pa.concat_tables(held).combine_chunks()
            last = rows["node"][-1].as_py()
            whole = np.searchsorted(np.asarray(rows["node"].to_pandas()) == last, True)
            if whole:
                yield links(rows.slice(0, whole))
            held = [rows.slice(whole)]
        if held and (rows := pa.concat_tables(held)).num_rows:
            yield links(rows)

    turns = F.explode(F.array(*[F.struct(F.lit(r).alias("r"), _rotated("fp", r * part).alias("value")) for r in range(budget + 1)]))
    rows = values.select(turns.alias("t")).select(
        F.concat_ws("/", F.col("t.r").cast("string"), F.hex(_bits("t.value", 0, part))).alias("node"),
        F.lit(0).alias("side"),
        F.col("t.value").alias("value"),
        F.lit(0).alias("err"),
    )
    ready, depth = [], part
    while True:
        sizes = pin(_sizes(rows).where(F.col("n") > node_rows)) if depth < BITS else None
        if sizes is None or sizes.isEmpty():
            ready.append(rows)
            break
        ready.append(rows.join(sizes, "node", "left_anti"))
        split = _split(rows.join(sizes, "node"), depth, budget)
        rows = pin(split.join(_sizes(split).where(F.col("two") | (F.regexp_extract("node", "([^/]+)/([^/]+)$", 1) == F.regexp_extract("node", "([^/]+)/([^/]+)$", 2))).select("node"), "node", "left_semi"))
        depth += STEP
    every = ready[0]
    for r in ready[1:]:
        every = every.unionByName(r)
    # The fingerprint itself, turned back, so that links carry it.
    turn = F.split("node", "/")[0].cast("int") * part
    back = F.lit(None).cast("long")
    for r in range(budget + 1):
        back = F.when(turn == r * part, _rotated("value", (BITS - r * part) % BITS)).otherwise(back)
    every = every.select("node", "side", "value", back.alias("fp"))
    # In numpy values are unsigned, in Spark signed: the sort follows the unsigned order.
    dealt = every.repartition("node").sortWithinPartitions("node", "side", F.col("value").bitwiseXOR(F.lit(-(2**63)).cast("long")))
    return dealt.mapInArrow(forest, "u long, v long")


def near_duplicates(docs: DataFrame, budget: int = 3, shingle: int = 3, doc_id: str = "doc_id", text: str = "text", node_rows: int = NODE_ROWS) -> DataFrame:
    """Per row of ``docs``: doc_id, fingerprint (16 hex digits) and component_id, the smallest doc_id reachable over links.

    Fingerprints link at ``budget`` or fewer differing bits; equal ones link too.
    Null and empty texts have fingerprint zero and link like any other.  Rows with a
    null id get their group's component_id, which is null if the group has no other
    rows.  Repeated rows stay; other columns are not read; no documents give no rows.
    """
    rows = pin(fingerprints(docs, doc_id, text, shingle))
    classes = pin(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    linked = components(near_links(classes.select("fp"), budget, node_rows)).withColumnRenamed("node", "fp")
    rooted = pin(classes.join(linked, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    groups = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(groups, "root").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
